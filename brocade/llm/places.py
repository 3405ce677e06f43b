"""Problem 4: mapping freely typed values to the entries of a reference list.

A symmetric-delete dictionary holds every reference name, folded (no case, accents or spaces), with all its
deletes up to MAX_EDITS letters. A typed value is cut into the parts that may hold a name, each is cleaned
and folded, and its own deletes are looked up, which finds every entry within the edits that the name's length
allows (`allowed`; digits are never edited) without comparing it to all. The first part that means an entry counts. The
candidates are ranked by weighted Damerau-Levenshtein distance (an accent counts less than a letter, a
doubled letter less than a wrong one), then by how often the reference name occurs in the data. Values
without a candidate are reported as unmatched.

The dictionary is broadcast once: a reference list is small by nature, and `Resolver` refuses more than
MOST_ENTRIES names. Rows aren't shuffled at all; each batch resolves its distinct values once.

Defined cases
- null values stay null and aren't reported; blank ones and bare type words are unmatched (entry 0).
- a leading or trailing type word ('P.', 'Ward', 'commune') is no part of the name; whole value and value
  without it are both tried, since a name can begin with such a word.
- equal distance: the more frequent entry, then the smaller id. Repeated rows resolve alike.
- names of other kinds (decoys) may be given; a value nearer to one of those is unmatched.
- an empty reference leaves everything unmatched. Very long values are cleaned and looked up like others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Edits at most, in names of at least so many letters; shorter names and numbers must be typed as they are.
MAX_EDITS, EDITED_FROM = 1, 4
MOST_ENTRIES = 200_000
#: Weights of an accent, of a doubled or halved letter, and of any other edit.
ACCENT, DOUBLED, EDIT = 0.25, 0.8, 1.0

#: Type words of administrative units, as written out and as abbreviated, without accents.
WORDS = ("phuong", "xa", "thi tran", "quan", "huyen", "thi xa", "thanh pho", "ward", "commune", "district", "town", "city")
SHORT = ("ph", "p", "f", "x", "tt", "qu", "q", "h", "tx", "tp", "d", "w")
_LEAD = re.compile(rf"^(?:(?:{'|'.join(WORDS)}|{'|'.join(SHORT)})[.\s]\s*|(?:{'|'.join(SHORT)})(?:\.|(?=\d)))")
_GLUED = re.compile(rf"^(?:{'|'.join(w.replace(' ', '') for w in WORDS)})(?=[a-z]{{4}})")
_TAIL = re.compile(r"\s+(?:ward|commune|district|town|city)$")
#: Brackets are no part of a name; a dash, comma or slash ends one part of a value.
_BRACKETS = re.compile(r"\([^)]*\)")
_PARTS = re.compile(r"\s+-\s|[,;/|]")
_DIGITS = re.compile(r"\d+")
_LOWER_LEVEL = re.compile(r"^(?:phuong|xa|thi tran|ward|commune|ph|p|f|x|tt)\b|\b(?:ward|commune)$")
_UPPER_LEVEL = re.compile(r"^(?:quan|huyen|thi xa|thanh pho|district|town|city|qu|q|h|tx|tp)\b|\b(?:district|town|city)$|^(?:quan|huyen|thixa|thanhpho)[a-z]{4}")


@lru_cache(maxsize=200_000)
def letters(text: str) -> str:
    """Lower case, composed, one kind of space."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().lower()


def fold(text: str) -> str:
    """Without accents; a plain d for the barred one."""
    plain = unicodedata.normalize("NFKD", text.lower()).replace("đ", "d")
    return "".join(c for c in plain if not unicodedata.combining(c))


def parts(value: str) -> list[str]:
    """The parts of a typed value that may hold a name, accents kept, in order."""
    return [p for p in _PARTS.split(_BRACKETS.sub(" ", letters(value))) if p.strip(" .")]


def cores(part: str) -> list[str]:
    """What may be the name in a part, spaces out: without its type word, and whole."""
    text = letters(part)
    plain = fold(text)
    if len(plain) != len(text):
        text = plain
    found: list[str] = []
    keep = len(plain) - len(plain.lstrip(" ."))
    text, plain = text[keep:].rstrip(" ."), plain[keep:].rstrip(" .")
    a, b = 0, len(plain)
    if m := _LEAD.match(plain):
        a = m.end()
    if m := _TAIL.search(plain, a):
        b = m.start()
    if " " not in plain and not a and (m := _GLUED.match(plain)):
        a = m.end()
    for name in (text[a:b], text):
        name = re.sub(r"[\s.\-']+", "", name)
        if name and name not in found:
            found.append(name)
    return found


def allowed(name: str) -> int:
    """How many edits a folded name of the reference allows."""
    return MAX_EDITS if len(name) >= EDITED_FROM else 0


def deletes(word: str, edits: int) -> set[str]:
    """word and all it can become by taking out up to so many letters."""
    found, last = {word}, {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


def weighted_distance(a: str, b: str, bound: float) -> float:
    """Damerau-Levenshtein (adjacent letters may change places) with the weights above; inf beyond bound."""
    if abs(len(a) - len(b)) * DOUBLED > bound:
        return float("inf")
    fa, fb = fold(a), fold(b)
    if len(fa) != len(a) or len(fb) != len(b):
        a, b = fa, fb
    bare = a == fa or b == fb  # typed without any accent: accents then say nothing
    accent = 0.0 if bare else ACCENT
    two, one = None, [j * EDIT for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [i * EDIT] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            same = 0.0 if a[i - 1] == b[j - 1] else accent if fa[i - 1] == fb[j - 1] else EDIT
            out = DOUBLED if i > 1 and fa[i - 1] == fa[i - 2] else EDIT
            into = DOUBLED if j > 1 and fb[j - 1] == fb[j - 2] else EDIT
            best = min(one[j - 1] + same, one[j] + out, row[j - 1] + into)
            if two is not None and j > 1 and fa[i - 1] == fb[j - 2] and fa[i - 2] == fb[j - 1]:
                best = min(best, two[j - 2] + EDIT)
            row[j] = best
        if min(row) > bound:
            return float("inf")
        two, one = one, row
    return one[-1]


class Resolver:
    """entries: (kind, id, name); several names may share an id. decoys: kind -> kinds that compete with it."""

    def __init__(self, entries: Iterable[tuple[str, int, str]], decoys: Mapping[str, Sequence[str]] | None = None, frequency: Mapping[tuple[str, int], int] | None = None, edits: int = MAX_EDITS) -> None:
        self.edits, self.decoys, self.frequency = edits, dict(decoys or {}), dict(frequency or {})
        self.exact: dict[str, dict[str, int]] = defaultdict(dict)
        self.index: dict[str, dict[str, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
        self.longest: dict[str, int] = defaultdict(int)
        self.cache: dict[tuple[str, str], int] = {}
        n = 0
        for kind, place, name in entries:
            n += 1
            if n > MOST_ENTRIES:
                raise ValueError(f"a reference list of over {MOST_ENTRIES} names doesn't fit into a task")
            self.exact[kind].setdefault(name, place)
            for core in cores(name)[:1]:  # a reference name is one part
                self.longest[kind] = max(self.longest[kind], len(core) + edits)
                for key in deletes(fold(core), edits):
                    self.index[kind][key].append((core, place))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"exact": dict(self.exact), "index": {k: dict(v) for k, v in self.index.items()}, "cache": {}}

    def nearest(self, kind: str, part: str) -> list[tuple[float, int, int]]:
        """(distance, -frequency, id), best first."""
        index, best = self.index.get(kind, {}), {}
        for core in cores(part):
            if len(core) > self.longest.get(kind, 0):
                continue  # further from every name than the edits allow
            for key in deletes(fold(core), self.edits):
                for name, place in index.get(key, ()):
                    d = weighted_distance(core, name, self.edits + 4 * ACCENT)
                    if d < best.get(place, float("inf")) and self._may_be(fold(core), fold(name)):
                        best[place] = d
        return sorted((d, -self.frequency.get((kind, place), 0), place) for place, d in best.items())

    def _may_be(self, typed: str, name: str) -> bool:
        return _DIGITS.findall(typed) == _DIGITS.findall(name) and edits_apart(typed, name) <= min(self.edits, allowed(name))

    def resolve(self, kind: str, value: str | None) -> int:
        """The entry's id, 0 for none."""
        if value is None:
            return 0
        if (kind, value) not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[kind, value] = self._resolve(kind, value)
        return self.cache[kind, value]

    def _resolve(self, kind: str, value: str) -> int:
        if place := self.exact.get(kind, {}).get(value):
            return place
        found = parts(value)
        for part in found:
            plain = fold(part).strip(" .")
            other_level = _UPPER_LEVEL.search(plain) if kind.startswith("ward") else _LOWER_LEVEL.search(plain)
            if len(found) > 1 and other_level:
                continue
            if place := self._of_part(kind, part):
                return place
        return 0

    def _of_part(self, kind: str, part: str) -> int:
        own = self.nearest(kind, part)
        if not own:
            return 0
        for other in self.decoys.get(kind, ()):
            rivals = self.nearest(other, part)
            if rivals and (rivals[0][0] < own[0][0] or rivals[0][0] == own[0][0] and not _UPPER_LEVEL.search(fold(letters(part)))):
                return 0
        return own[0][2]


def edits_apart(a: str, b: str) -> int:
    """Plain Damerau-Levenshtein distance."""
    two, one = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(one[j - 1] + (a[i - 1] != b[j - 1]), one[j] + 1, row[j - 1] + 1)
            if two is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[-1]


def map_values(df: DataFrame, key: str, fields: Mapping[str, str], resolver: Resolver) -> DataFrame:
    """key, field_name, value, place_id (0: none) for every row and field with a value that isn't null.

    fields: column -> kind of the reference."""
    out = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("field_name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("place_id", T.LongType())])
    columns = list(fields)
    shared = df.sparkSession.sparkContext.broadcast(resolver)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in columns:
                coded = batch.column(name).dictionary_encode()
                places = pa.array([shared.value.resolve(fields[name], v.as_py()) for v in coded.dictionary], pa.int64())
                got = places.take(coded.indices)
                label = pa.array([name] * batch.num_rows, pa.string())
                whole = pa.table([batch.column("__key"), label, batch.column(name).cast(pa.string()), got], names=out.names)
                yield from whole.filter(batch.column(name).is_valid()).to_batches()

    renamed = df.select(df[key].alias("__key"), *[df[c] for c in columns])
    return renamed.mapInArrow(run, out).withColumnRenamed("key", key)
