"""Problem 6: postal addresses of one place written differently.

An address is read into components: the house's path (lane first: 'số 21 hẻm 212' and '212/21' are one),
the street's name as typed in either field, the ward and the district as entries of a reference. Equal
readings are one *form*, so copies of an address are compared once. Forms of one path are blocked by ward
with the street's first letter, by ward with the sound of its other words, and by the sound of the whole
street; forms without a street meet all of their path and ward. Number, lane and ward make the house by
definition: where both are known and differ there is nothing to weigh. Candidates are compared component by
component, and the levels of agreement, a missing value being a level of its own, are weighed in Fellegi and
Sunter's model of two classes. How often a level occurs by chance is counted on random pairs of forms; how
often it occurs within a house, and how many of all pairs of one path (and of no two wards) are one house, is
estimated by expectation-maximisation over the counts of level patterns. The weights alone decide which pairs
are linked.

Linked forms are one house, but a form that leaves something open (no ward, or only the first letter of the
street) never joins two: it keeps its best link to a form that says more (`settle`).

Defined cases
- no house number: the form is in no block and matches nothing, not even itself.
- null or empty fields are missing; ward and district fall back on what the old address says, in any order.
- a part that is a place's name with a number ('Phường 5') is that place; a number after 'số' is the house's,
  whatever numbers the street's name holds.
- a different number, lane, further lane or letter is another house, whatever else agrees.
- repeated rows and rows of one listing count once; a listing given at two houses is at both.
- an empty table gives an empty result. Very long fields are read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.llm.places import Resolver, edits_apart, fold, letters
from brocade.session import cut

#: Words before a number, for a lane, and before a street's name, without accents.
STREET_WORDS = frozenset(("duong", "d", "dg", "pho", "street", "st"))
_NUMBER = r"(?:\b(?:so nha|so|nha|sn|no)\s+)?"
_LANE = re.compile(_NUMBER + r"(\d+[a-z]?)\s*(?:hem|ngo|ngach|kiet|lane|alley)\s*(\d+[a-z]?(?:/\d+[a-z]?)*)")
_MARKED = re.compile(r"\b(?:so nha|so|nha|sn|no)\s+(\d+[a-z]?(?:/\d+[a-z]?)*)")
_PATH = re.compile(r"(\d+[a-z]?(?:/\d+[a-z]?)*)")
_PARTS = re.compile(r"[,;|]|\s[-–]\s")
_UPPER = re.compile(r"^(?:quan|huyen|thi xa|thanh pho|district|town|city)\b|\b(?:district|town|city)$|^(?:qu|q|h|tx|tp)[.\s]")
_TYPED = re.compile(r"^(?:phuong|xa|thi tran|quan|huyen|thi xa|thanh pho|ward|commune|district|ph|p|f|x|tt|qu|q|h)\b[.\s]*\d|^[pfq]\d")

#: Levels of agreement of a word of the street: missing, equal (accents that one side leaves out altogether say nothing),
#: one side only its first letter, so many letters to change (at most half of them), accents that differ, another word.
MISSING, SAME, SHORT, ONE, TWO, THREE, ACCENTS, OTHER = range(8)
#: Of the place: same ward; where a ward is missing: nothing to compare, same district, another one.
NO_PLACE, SAME_WARD, SAME_DISTRICT, OTHER_DISTRICT = range(4)
ROUNDS, CONVERGED, THRESHOLD, SEED = 500, 1e-9, 0.5, 6


def _street_word_before(plain: str, at: int) -> bool:
    before = plain[:at].split()
    return bool(before) and before[-1] in STREET_WORDS


def _find_path(plain: str) -> re.Match | None:
    """The house's number: the one after 'số' unless that names a street, else the first, but the last where the
    first one belongs to the street's name ('Đường 3 Tháng 2, 45')."""
    for m in _MARKED.finditer(plain):
        if not _street_word_before(plain, m.start()):
            return m
    found = list(_PATH.finditer(plain))
    if len(found) > 1 and _street_word_before(plain, found[0].start()):
        return found[-1]
    return found[0] if found else None


def read_street(text: str | None) -> tuple[str, str]:
    """(path, name): '' for what isn't there. The name keeps its accents, in lower case."""
    low = re.sub(r"[.,]", " ", letters(text or ""))
    plain = fold(low)
    if len(plain) != len(low):
        low = plain
    if m := _LANE.search(plain):
        path = f"{m[2]}/{m[1]}"
    elif m := _find_path(plain):
        path = m[1]
    else:
        return "", " ".join(_named(low.split()))
    return path, " ".join(_named((low[: m.start()] + " " + low[m.end() :]).split()))


def _named(words: list[str]) -> list[str]:
    kept = list(words)
    while len(kept) > 2 and fold(kept[0]) in STREET_WORDS:
        kept.pop(0)
    return kept


class Reader:
    """Reads the four fields of an address; places by a resolver, old wards mapped to what they belong to now."""

    def __init__(self, resolver: Resolver, ward_now: Mapping[int, int], district_of: Mapping[int, int]) -> None:
        self.resolver, self.ward_now, self.district_of = resolver, dict(ward_now), dict(district_of)

    def read(self, street: str | None, ward: str | None, old: str | None, district: str | None) -> tuple[str, str, str, int, int]:
        """path, street, street in the old address, ward id, district id; '' and 0 for missing."""
        path, name = read_street(street)
        old_path = old_name = ""
        wards: list[int] = []
        districts: list[int] = []
        for part in _PARTS.split(old or ""):
            numbered = re.search(r"\d", part) is not None
            if numbered and not (_TYPED.search(fold(letters(part))) and (self.resolver.resolve("ward_old", part.strip()) or self.resolver.resolve("district_old", part.strip()))):
                if not old_path:
                    old_path, old_name = read_street(part)
            elif part.strip():
                if not _UPPER.search(fold(letters(part))) and (w := self.resolver.resolve("ward_old", part.strip())):
                    wards.append(w)
                if d := self.resolver.resolve("district_old", part.strip()):
                    districts.append(d)
        if not path:
            path, name = old_path, old_name or name
        if old_path != path:
            old_name = ""
        place = self.resolver.resolve("ward_new", ward) if ward and ward.strip() else 0
        if district and district.strip() and not districts and (d := self.resolver.resolve("district_old", district)):
            districts.append(d)
        held = [w for w in wards if self.district_of.get(w) in districts] or wards
        if not place and held:
            place = self.ward_now.get(held[0], 0)
        in_district = districts[0] if districts else self.district_of.get(held[0], 0) if held else 0
        return path, name, old_name if old_name != name else "", place, in_district


FORM = "path string, street string, street_old string, ward long, district long"


def read_addresses(df: DataFrame, key: str, fields: tuple[str, str, str, str], reader: Reader) -> DataFrame:
    """key and the form's columns, distinct. fields: street, ward, old address, district."""
    out = f"key {df.schema[key].dataType.simpleString()}, {FORM}"
    once = df.select(F.col(key).alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).where("key is not null").distinct()

    shared = df.sparkSession.sparkContext.broadcast(reader)  # refuses long reference lists itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.read(*v) for v in zip(*(batch.column(f"f{i}").to_pylist() for i in range(4)))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["key", "path", "street", "street_old", "ward", "district"]
            )

    return once.mapInArrow(run, out).where("path != ''").distinct()


#: First consonants that sound alike in some region, and last ones; what isn't listed is itself.
_FIRST = {"ngh": "ng", "gh": "g", "ph": "f", "tr": "ch", "gi": "d", "r": "d", "v": "d", "c": "k", "q": "k", "qu": "k", "x": "s", "l": "n"}
_LAST = {"ng": "n", "nh": "n", "ch": "t", "c": "t", "p": "t"}
_LETTER = {"c": "k", "q": "k", "x": "s", "g": "d", "r": "d", "v": "d", "l": "n"}
_WORD = re.compile(r"(ngh|gi(?=[aeiouy])|qu|[bcdfghjklmnpqrstvwxz]*)([aeiouy]*)([bcdfghjklmnpqrstvwxz]*)")


def word_sound(word: str) -> str:
    """First and last consonants of a word without accents, those that sound alike as one; vowels are left out."""
    m = _WORD.match(word)
    return _FIRST.get(m[1], m[1]) + "-" + _LAST.get(m[3], m[3])


def street_keys(street: str) -> tuple[str, str]:
    """(first letter, sound of the other words): a shortened first word keeps its letter. Letters that begin
    sounds which are taken for one another are one."""
    words = fold(street).split()
    if not words:
        return "", ""
    return _LETTER.get(words[0][0], words[0][0]), " ".join(map(word_sound, words[1:] or words))


def word_level(a: str, b: str) -> tuple[int, int]:
    """(level, letters to change) of two typed words."""
    if a == b:
        return SAME, 0
    fa, fb = fold(a), fold(b)
    if fa == fb:
        return (SAME if a == fa or b == fb else ACCENTS), 0
    if len(fa) == 1 or len(fb) == 1:
        return (SHORT, 0) if fa[0] == fb[0] else (OTHER, len(fa))
    n = edits_apart(fa, fb) if a == fa or b == fb else edits_apart(a, b)  # accents are letters if both have some
    return ((ONE, TWO, THREE)[n - 1] if n <= 3 and 2 * n <= max(len(fa), len(fb)) else OTHER), n


def street_levels(a: str, b: str) -> tuple[int, int, int]:
    """(letters to change, level of the first word, level of the rest)."""
    if not a or not b:
        return 99, MISSING, MISSING
    wa, wb = a.split(), b.split()
    if len(wa) != len(wb) or len(wa) < 2:
        level, n = word_level("".join(wa), "".join(wb))
        return n, level, level
    first, rest = word_level(wa[0], wb[0]), word_level(" ".join(wa[1:]), " ".join(wb[1:]))
    return first[1] + rest[1], first[0], rest[0]


def best_levels(a: str, a_old: str, b: str, b_old: str) -> tuple[int, int]:
    """Of what either address says, the levels of the two names that differ least."""
    found = min(((x.count(OTHER), *x) for x in (street_levels(v, w) for v in {a, a_old} - {""} for w in {b, b_old} - {""})), default=(0, 99, MISSING, MISSING))
    return found[2], found[3]


def place_level(ward_a: int, district_a: int, ward_b: int, district_b: int) -> int:
    """Of two forms whose wards, if both are known, are the same."""
    if ward_a and ward_b:
        return SAME_WARD
    if district_a and district_b:
        return SAME_DISTRICT if district_a == district_b else OTHER_DISTRICT
    return NO_PLACE


COMPARED = ("street", "street_old", "ward", "district")
LEVELS = ("first_l", "rest_l", "place_l")
_SIZES = (8, 8, 4)
Pattern = tuple[int, ...]


def _levels(a: tuple, b: tuple) -> Pattern:
    return (*best_levels(a[0], a[1], b[0], b[1]), place_level(a[2], a[3], b[2], b[3]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _blocks(street: pd.Series, street_old: pd.Series, ward: pd.Series) -> pd.Series:
    out = []
    for a, b, w in zip(street, street_old, ward):
        keys = {street_keys(x) for x in (a, b) if x}
        out.append(sorted({f"s{k}.{r}" for k, r in keys} | ({f"f{w}.{k}" for k, _ in keys} | {f"r{w}.{r}" for _, r in keys} if w else set())))
    return pd.Series(out, dtype=object)


def compare_forms(forms: DataFrame) -> DataFrame:
    """a, b (form ids, a < b), a_rank, b_rank and LEVELS for every pair of forms that share a path and a block and
    aren't in two known wards."""
    known = forms.withColumn("rank", F.when(F.col("ward") != 0, F.lit(2)).otherwise(F.lit(0)) + F.when(F.greatest(*[F.length(F.substring_index(c, " ", 1)) for c in COMPARED[:2]]) > 1, F.lit(1)).otherwise(F.lit(0)))
    keyed = cut(known.withColumn("block", F.explode(_blocks("street", "street_old", "ward"))))
    side = lambda df, x, *more: df.select("path", *more, *[F.col(c).alias(f"{x}_{c}") for c in ("form", "rank", *COMPARED)])
    shared = side(keyed, "a", "block").join(side(keyed, "b", "block"), ["path", "block"]).where("a_form < b_form and (a_ward = b_ward or a_ward = 0 or b_ward = 0)").drop("block")
    # a form without a street has no key of its own; there is one a path, ward and district at most
    nameless = side(known.where("street = '' and street_old = '' and ward != 0"), "a").join(side(known, "b"), "path").where("a_ward = b_ward and a_form != b_form")
    pairs = shared.unionByName(nameless).dropDuplicates(["a_form", "b_form"])

    @F.pandas_udf(T.IntegerType())
    def compared(*c: pd.Series) -> pd.Series:
        rows = list(zip(*c))
        return pd.Series([100 * f + 10 * r + p for f, r, p in (_levels(v[:4], v[4:]) for v in rows)], dtype="int32")

    coded = pairs.withColumn("l", compared(*[f"{x}_{c}" for x in "ab" for c in COMPARED]))
    return coded.select(
        F.least("a_form", "b_form").alias("a"), F.greatest("a_form", "b_form").alias("b"),
        F.when(F.col("a_form") < F.col("b_form"), F.col("a_rank")).otherwise(F.col("b_rank")).alias("a_rank"),
        F.when(F.col("a_form") < F.col("b_form"), F.col("b_rank")).otherwise(F.col("a_rank")).alias("b_rank"),
        F.expr("l div 100").cast("int").alias("first_l"), F.expr("l div 10 % 10").cast("int").alias("rest_l"), F.expr("l % 10").cast("int").alias("place_l"),
    ).dropDuplicates(["a", "b"])


def chance(forms: DataFrame) -> list[np.ndarray]:
    """How often each level of each of LEVELS occurs by chance: every form is compared with another of its batch,
    drawn by a seeded permutation. What reaches the driver is one row for each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in COMPARED)))
            other = np.random.default_rng(SEED + i).permutation(len(rows))
            seen = [Counter() for _ in LEVELS]
            for a, b in enumerate(other):
                if a != b:
                    levels = _levels(rows[a], rows[b])
                    apart = rows[a][2] and rows[b][2] and rows[a][2] != rows[b][2]
                    for k, level in enumerate(levels[:2] if apart else levels):
                        seen[k][level] += 1
            flat = [(k, level, n) for k, c in enumerate(seen) for level, n in c.items()]
            yield pa.RecordBatch.from_pydict({"k": pa.array([x[0] for x in flat], pa.int32()), "level": pa.array([x[1] for x in flat], pa.int32()), "n": pa.array([x[2] for x in flat], pa.int64())})

    found = forms.select(*COMPARED).mapInArrow(run, "k int, level int, n long").groupBy("k", "level").agg(F.sum("n").alias("n")).collect()
    u = [np.full(size, 0.5) for size in _SIZES]
    for r in found:
        u[r["k"]][r["level"]] += r["n"]
    return [x / x.sum() for x in u]


def estimate(patterns: list[Pattern], counts: list[int], chance: Sequence[Sequence[float]], total: int) -> dict[Pattern, float]:
    """Posterior probability of one house for each pattern of LEVELS, by expectation-maximisation.

    total is the number of all pairs of one path and of no two wards; those that share no block are non-matches.
    chance, the levels without a house, is held fixed: among the candidates it can't be told from near misses.
    The levels within a house start from 'agreement is likelier' and are estimated, with a little smoothing, together
    with the share of matches."""
    if not patterns:
        return {}
    x, n, u = np.array(patterns), np.array(counts, dtype=float), [np.asarray(v, dtype=float) for v in chance]
    word = np.array([0.03, 0.65, 0.1, 0.12, 0.05, 0.02, 0.01, 0.02])
    m = [word, word.copy(), np.array([0.05, 0.85, 0.06, 0.04])]
    total = max(float(total), float(n.sum()))
    p, last = 0.1 * n.sum() / total, -np.inf
    for _ in range(ROUNDS):
        lm = np.log(p) + sum(np.log(m[k][x[:, k]]) for k in range(len(m)))
        lu = np.log1p(-p) + sum(np.log(u[k][x[:, k]]) for k in range(len(m)))
        both = np.logaddexp(lm, lu)
        g = np.exp(lm - both)
        for k in range(len(m)):
            inside = np.bincount(x[:, k], weights=n * g, minlength=_SIZES[k]) + 0.01
            m[k] = inside / inside.sum()
        p = float(np.clip((n * g).sum() / total, 1e-9, 1 - 1e-9))
        likelihood = float((n * both).sum() + (total - n.sum()) * np.log1p(-p))
        if abs(likelihood - last) < CONVERGED * abs(likelihood):
            break
        last = likelihood
    return {tuple(int(v) for v in row): float(v) for row, v in zip(x, g)}


def comparable(forms: DataFrame) -> int:
    """How many pairs of forms share a path and aren't in two known wards. Counted, not made."""
    by_ward = forms.groupBy("path", "ward").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("ward") != 0, F.col("n")).otherwise(F.lit(0))
    by_path = by_ward.groupBy("path").agg(F.sum("n").alias("n"), F.sum(known).alias("k"), F.sum(known * known).alias("q"))
    return int(by_path.agg(F.sum(F.expr("n * (n - 1) div 2 - (k * k - q) div 2"))).first()[0] or 0)


def weigh(pairs: DataFrame, forms: DataFrame) -> dict[Pattern, float]:
    """The weights of the level patterns that occur (at most 8 * 8 * 4)."""
    seen = pairs.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate([tuple(r[f] for f in LEVELS) for r in seen], [r["n"] for r in seen], chance(forms), comparable(forms))


def linked(pairs: DataFrame, weight: Mapping[Pattern, float], threshold: float = THRESHOLD) -> DataFrame:
    """a, b, a_rank, b_rank, weight of the pairs whose pattern weighs enough."""
    hits = {100 * k[0] + 10 * k[1] + k[2]: v for k, v in weight.items() if v >= threshold}
    code = F.col("first_l") * 100 + F.col("rest_l") * 10 + F.col("place_l")
    worth = F.lit(None).cast("double") if not hits else F.try_element_at(F.create_map(*[F.lit(v) for kv in hits.items() for v in kv]), code)
    return pairs.withColumn("weight", worth).where("weight is not null").select("a", "b", "a_rank", "b_rank", "weight")


def settle(links: DataFrame) -> DataFrame:
    """a, b of the links that stay. A form of lower rank (3: ward and full street, 2: without the street's full first
    word, 1: without the ward, 0: without both) keeps its best link to one of higher rank, and no other link then, so that it can't
    join two houses that aren't linked themselves. Ties go to the higher rank, then to the least form."""
    low = F.col("a_rank") < F.col("b_rank")
    uneven = links.where("a_rank != b_rank").select(
        F.when(low, F.col("a")).otherwise(F.col("b")).alias("lower"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("upper"),
        F.greatest("a_rank", "b_rank").alias("rank"), "weight",
    )
    best = uneven.groupBy("lower").agg(F.min_by("upper", F.struct(-F.round("weight", 6), -F.col("rank"), F.col("upper"))).alias("upper"))
    even, bound = links.where("a_rank = b_rank"), best.select("lower")
    free = even.where("a_rank < 3").join(bound, F.col("a") == F.col("lower"), "left_anti").join(bound, F.col("b") == F.col("lower"), "left_anti")
    up = best.select(F.least("lower", "upper").alias("a"), F.greatest("lower", "upper").alias("b"))
    return even.where("a_rank = 3").select("a", "b").unionByName(free.select("a", "b")).unionByName(up)


def houses(forms: DataFrame, links: DataFrame) -> DataFrame:
    """form, house: the least form id that links lead to. Each round takes the least label among a form's
    neighbours and then that label's own label, so labels travel twice as far with every round."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = both.select(F.col("a").alias("form")).distinct().withColumn("house", F.col("form"))
    while True:
        near = both.join(label, both["b"] == label["form"]).groupBy(F.col("a").alias("form")).agg(F.min("house").alias("near"))
        least = label.join(near, "form").select("form", F.least("house", "near").alias("to"), F.col("house").alias("was"))
        jump = least.select(F.col("form").alias("to"), F.col("to").alias("further"))
        step = cut(least.join(jump, "to", "left").select("form", F.least("to", F.coalesce("further", "to")).alias("house"), "was"))
        label = step.select("form", "house")
        if step.where("house != was").limit(1).count() == 0:
            break
    return forms.select("form").join(label, "form", "left").select("form", F.coalesce("house", "form").alias("house"))


def same_house(df: DataFrame, key: str, fields: tuple[str, str, str, str], reader: Reader) -> tuple[DataFrame, DataFrame]:
    """(key, house) for every key with a house number, and (a, b, a < b) for every two keys at one house."""
    parts = ("path", *COMPARED)
    # 128 bits, so that no two forms of any corpus share an id
    form = F.unhex(F.md5(F.to_json(F.struct(*parts))))
    read = cut(read_addresses(df, key, fields, reader).withColumn("form", form))
    forms = cut(read.select("form", *parts).distinct())
    pairs = cut(compare_forms(forms))
    at = houses(forms, settle(cut(linked(pairs, weigh(pairs, forms)))))
    placed = cut(read.select("key", "form").join(at, "form").select("key", F.hex("house").alias("house")).distinct())
    other = placed.select(F.col("key").alias("b"), "house")
    return placed, placed.select(F.col("key").alias("a"), "house").join(other, "house").where("a < b").select("a", "b").distinct()
