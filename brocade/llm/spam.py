"""Problem 9: keyword-stuffed and link-list pages.

Each text is described whole, in Arrow batches, by content and link features (`FEATURES`) and by three signals
that are no features (`SIGNALS`): how much of it stands in lines with links or tags, how many of its word
pairs are fresh, and how much of it tells something, by tying words. The signals label only sure cases; the
rest, more than a third of the pages, stays open. Bagged decision trees (a random forest that looks
at all features in every split) learn from a bounded, hash-chosen sample of these labels and score every
page. The score is then smoothed towards its host: the log-odds are shifted by the host's own spam log-odds
against the whole crawl's, shrunk for small hosts.

Defined cases
- every row has a score. Texts without a letter or digit (null, empty, blank) have score 0 and are no spam.
- very short texts have little repetition and are judged as they are, very long ones are described whole.
- repeated rows are judged alike. A null host has no shift.
- if the signals label one side only, the trees have one answer and all pages get it (score 0 without a sure
  spam page); without any labelled page all scores are 0. An empty table gives an empty result.
- other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.session import cut

#: Rows of the training sample at most, per label.
SAMPLE = 20_000
TREES, DEPTH, SEED = 24, 7, 23
#: How much a host's spam rate shifts a page, how many pages' worth of prior a host starts with, and over how
#: many parts the pages of one host are spread when they meet its rate.
HOST_WEIGHT, HOST_PRIOR, SALTS = 1.0, 20.0, 16
THRESHOLD = 0.5
#: Sure signals: least share of segments with links or tags, most share of fresh word pairs and of telling text, for spam;
#: least shares of fresh word pairs and of telling text for prose; words that a text must have to be sure.
SPAM_LINKED, SPAM_FRESH, SPAM_TOLD, PROSE_FRESH, PROSE_TOLD, WORDS = 0.6, 0.45, 0.1, 0.65, 0.88, 20

#: Words that tie sentences together, Vietnamese without accents and English.
TIES = (
    "va la thi cua co khong cho da duoc nhung nen tu voi o mot cac khi neu ma con den toi nay do de trong vao ra len hon chi rat vi bi se dang theo phai hay roi "
    "truoc sau lai khoang gan moi nhieu luc vua xong chua noi ai it nhat the is are was to and of a in on for that it we you our but so which than has have had be "
    "with by at this they i my there not or if as can were from who what when while after before about more no"
).split()
_LINK = re.compile(r"<a\s[^>]*>|(?:https?:?//|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,8}(?:/[^\s\])>]*)?(?=[\s\])>,;]|$)")
_DOT = re.compile(r"\.[a-z]")
_BREAK = re.compile(r"<br\s*/?>|</?p>")
_ENDS = (".", "!", "?", "…", "。", "！", "？")
_DIGITS = "0123456789"
_MARKS = "|•»›·*,;~/"
_TIED = frozenset(TIES).__contains__
#: A segment tells something if at least so large a part of its words are tying ones; a text whose letters are
#: foreign for the most part can't be judged by them and counts as telling.
TELLING, FOREIGN = 0.2, 0.3

FEATURES = (
    "links_per_word", "tags_per_word", "marks_per_word", "ends_per_word", "numbers_per_word", "words_per_segment", "words_per_item",
    "variety", "lead_variety", "item_variety", "bare", "short", "foreign", "words",
)
SIGNALS = ("linked", "fresh", "told", "n")


def _folding() -> dict[int, str | None]:
    """Letters of Latin without their accents, combining accents to nothing, odd spaces to one kind, foreign
    letters of scripts without spaces apart from one another."""
    table: dict[int, str | None] = {i: chr(i) for i in range(0x3000)}  # a lookup that fails costs more than one that doesn't
    table |= {ord("đ"): "d", ord("¤"): " ", **dict.fromkeys(range(0x300, 0x370))}
    for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFKD", c)[0]
        if base != c and base.isascii() and base.isalpha():
            table[ord(c)] = base
    table |= {ord(c): " " for c in "\u00a0\u2002\u2003\u2009\u202f\u3000\u200b\ufeff\t"} | {ord("\r"): "\n"}
    return table | {c: f" {chr(c)} " for c in range(0x4E00, 0xA000)} | {c: f" {chr(c)} " for c in range(0x3040, 0x3100)}


_FOLD = _folding()
_NO_WORD = {c: " " for c in range(128) if chr(c) not in "\n" and not chr(c).isalpha()} | {ord(c): " " for c in "•»›·¤…。！？，、；：“”’‘–—"}
_TO_ITEMS = {i: chr(i) for i in range(0x3000)} | {ord(c): "\n" for c in _MARKS}


def describe(text: str | None) -> tuple[float, ...]:
    """The features and signals of one text, in the order of FEATURES and SIGNALS: one folding, one split."""
    if not text:
        return _NOTHING
    plain = text.lower().translate(_FOLD)
    if "<" in plain:
        plain = _BREAK.sub("\n", plain)
    solid = max(1, len(plain) - plain.count(" ") - plain.count("\n"))
    links = 0
    if "//" in plain or "<a " in plain or _DOT.search(plain):
        plain, links = _LINK.subn(" ¤ ", plain)
    tags = plain.count("#")
    for end in _ENDS:
        if end in plain:
            plain = plain.replace(end + " ", end + "\n")
    clean = plain.translate(_NO_WORD)
    words: list[str] = []
    once: list[str] = []  # without telling segments said before, word for word: a copied sentence isn't stuffing
    said: set[tuple[str, ...]] = set()
    leads, segments, size, bare, short, told, with_link = set(), 0, 0, 0, 0, 0, 0
    for raw, line in zip(plain.split("\n"), clean.split("\n")):
        ws = line.split()
        k = len(ws)
        own = raw.count("¤") if links else 0
        weight = k + 4 * own
        if not weight:
            continue
        if own or tags and "#" in raw:
            with_link += weight
        segments += 1
        ties = sum(map(_TIED, ws))
        size += weight
        words += ws
        leads.add(tuple(ws[:2]))
        if not raw.rstrip(" \"'”’)").endswith(_ENDS):
            bare += weight
        if k <= 6:
            short += weight
        if ties >= TELLING * k and k:
            told += weight
            if (whole := tuple(ws)) in said:
                continue
            said.add(whole)
        once += ws
    n = len(words)
    if not segments:
        return _NOTHING
    items = [tuple(i[:2]) for i in map(str.split, plain.translate(_TO_ITEMS).split("\n")) if i]
    some, foreign = max(1, n), sum(not c.isascii() for c in set(words)) / max(1, len(set(words)))
    return (
        links / some, tags / some, sum(map(plain.count, _MARKS)) / some, sum(map(plain.count, _ENDS)) / some, sum(map(plain.count, _DIGITS)) / solid,
        n / segments, n / max(1, len(items)), len(set(words)) / some, len(leads) / segments, len(set(items)) / max(1, len(items)), bare / size, short / size, foreign,
        float(min(n, 1000)), with_link / size, len(set(zip(once, once[1:]))) / max(1, len(once) - 1), 1.0 if foreign >= FOREIGN else told / size, float(n),
    )


_NOTHING = (0.0,) * (len(FEATURES) + len(SIGNALS))


def described(docs: DataFrame, text: str) -> DataFrame:
    """docs without its text, with one double column per feature (f_<feature>) and signal, from Arrow batches."""
    names = [*(f"f_{f}" for f in FEATURES), *SIGNALS]
    rest = [c for c in docs.columns if c != text]
    out = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(describe, batch.column(text).to_pylist()))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c, pa.float64()) for c in columns)], names=[*rest, *names])

    return docs.mapInArrow(run, out)


def weak_label() -> Column:
    """1 spam, 0 prose, null where no signal is sure."""
    long = F.col("n") >= WORDS
    spam = (F.col("linked") >= SPAM_LINKED) | long & ((F.col("fresh") <= SPAM_FRESH) | (F.col("told") <= SPAM_TOLD))
    prose = long & (F.col("linked") <= 0) & (F.col("fresh") >= PROSE_FRESH) & (F.col("told") >= PROSE_TOLD)
    return F.when(spam, F.lit(1.0)).when(prose, F.lit(0.0))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(0.005), F.least(F.lit(0.995), p))
    return F.log(p / (1 - p))


def spam_pages(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key, host, weak (the label of the signals, null if open), page_score (the trees' share for spam), score
    (smoothed by host) and spam, for every row of docs."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    given = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    given = given.withColumn("says", F.coalesce(F.rlike(F.col("text"), F.lit(r"[\p{L}\p{N}]")), F.lit(False)))
    pages = cut(described(given, "text").withColumn("weak", F.when(F.col("says"), weak_label())))
    draw = F.xxhash64(F.lit(SEED), F.col("key"))
    of = lambda label: pages.where(F.col("weak") == label).orderBy(draw, "key").limit(SAMPLE)
    # both labels are declared, so that the trees know two classes even if one doesn't occur
    label = F.col("weak").alias("label", metadata={"ml_attr": {"type": "nominal", "vals": ["prose", "spam"]}})
    sample = cut(of(1.0).unionByName(of(0.0)))
    assemble = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features")
    if sample.limit(1).count():
        trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", bootstrap=True, seed=SEED, maxBins=64)
        model = trees.fit(assemble.transform(sample.select(*[f"f_{f}" for f in FEATURES], label)))
        judged = F.when(F.col("says"), vector_to_array("probability")[1]).otherwise(F.lit(0.0))
        scored = model.transform(assemble.transform(pages)).select("key", "host", "weak", "says", judged.alias("page_score"))
    else:
        scored = pages.select("key", "host", "weak", "says", F.lit(0.0).alias("page_score"))
    judged = smooth_by_host(cut(scored))
    return judged.select(F.col("key").alias(key), "host", "weak", "page_score", "score", (F.col("score") >= THRESHOLD).alias("spam"))


def smooth_by_host(scored: DataFrame) -> DataFrame:
    """scored (key, host, page_score, says and others) with score. A host's rate is the mean of its pages' scores and of
    HOST_PRIOR pages of the whole crawl's rate. Pages of one host meet their rate in SALTS parts."""
    hosts = scored.where("host is not null and says").groupBy("host").agg(F.sum("page_score").alias("s"), F.count(F.lit(1)).alias("n"))
    crawl = scored.where("says").agg(F.coalesce(F.avg("page_score"), F.lit(0.0)).alias("all")).first()["all"]
    shift = F.lit(HOST_WEIGHT) * (_logit((F.col("s") + HOST_PRIOR * crawl) / (F.col("n") + HOST_PRIOR)) - _logit(F.lit(crawl)))
    rates = hosts.select("host", shift.alias("shift"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    smooth = 1 / (1 + F.exp(-(_logit(F.col("page_score")) + F.coalesce("shift", F.lit(0.0)))))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(rates, ["host", "salt"], "left").withColumn("score", F.when(F.col("says"), smooth).otherwise(F.lit(0.0))).drop("salt", "shift")
