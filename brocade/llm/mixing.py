"""Problem 8: mixing sources to target weights by subset-sum budget fitting.

Sizes are tokens of a public tokenizer. Each source's documents are counted by exact token length
(a histogram, bounded by the distinct lengths). A source's budget is its share of the mix; whole
passes over the source are used while they fit, and the rest of the budget is fitted from the
histogram: the same fraction of every length first, then single documents from long to short, and a
bounded knapsack for the last tokens. Which documents of a length are used is decided by a seeded hash.

The mix is as large as the corpus in tokens. A source whose documents are too few even at its cap gives
all it may, and what it lacks is shared among the others in proportion to their target shares, so
their shares among each other stay as asked; the report states target, budget and reached share.

Defined cases
- documents with no tokens (null, empty) are counted as documents but never chosen.
- documents of no source, or of one without target, count in the corpus size and are never chosen.
- a target source without documents reaches a share of 0. Empty corpora give an empty mix and zero shares.
- shares needn't add to 1: they are divided by their sum. Null or negative shares or caps count as 0.
- doc ids must be unique (a repeated row is a document of its own only under its own id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 17
#: Tokens left to the knapsack at most; the fill before it leaves less than the shortest usable document or this.
KNAPSACK = 1 << 16
BUCKETS = 4096
#: Sources with a target at most.
MOST_TARGETS = 10_000


def budgets(totals: list[tuple[str, float, int, int]], size: int) -> dict[str, int]:
    """source -> tokens, for (source, share, cap, tokens there): water-filling under cap * tokens."""
    left, open_, out = size, {s: (w, c * t) for s, w, c, t in totals}, {}
    while open_:
        weight = sum(w for w, _ in open_.values())
        if weight <= 0:
            out |= dict.fromkeys(open_, 0)
            break
        full = {s: m for s, (w, m) in open_.items() if m <= left * w / weight}
        if not full:
            out |= {s: round(left * w / weight) for s, (w, _) in open_.items()}
            break
        out |= full
        left -= sum(full.values())
        open_ = {s: x for s, x in open_.items() if s not in full}
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to use (0..count) so that the sum is at most budget and as near as the
    steps allow; exact whenever the knapsack can reach it."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # the fraction leaves room for the knapsack to choose freely
    room = min(budget, max(KNAPSACK // 2, 1))
    fraction = max(0, budget - room) / total
    take = np.floor(counts * fraction).astype(np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths):
        if left <= KNAPSACK:
            break
        more = min(int(counts[i] - take[i]), (left - KNAPSACK) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack with value = weight: the reachable sums are the bits of one integer; multiplicities
    are split into powers of two and the sets before each item are kept to walk back."""
    mask = (1 << (budget + 1)) - 1
    items, before, reach = [], [], 1
    for i in np.argsort(-lengths):
        n, k = min(int(counts[i]), budget // int(lengths[i])), 1
        while n > 0:
            k = min(k, n)
            before.append(reach)
            items.append((i, k))
            reach |= reach << (k * int(lengths[i])) & mask
            n -= k
            k *= 2
        if reach >> budget & 1:
            break
    use, s = np.zeros(len(lengths), dtype=np.int64), reach.bit_length() - 1
    for (i, k), was in zip(reversed(items), reversed(before)):
        if not was >> s & 1:
            use[i] += k
            s -= k * int(lengths[i])
    return use


def target_rows(targets: DataFrame) -> list:
    """The targets, or an error if they are more than the driver plans for."""
    rows = targets.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"a mix of over {MOST_TARGETS} sources can't be planned")
    return rows


PLAN = "source string, n_tokens int, passes int, extra long, budget long"


def plan_lengths(histogram: DataFrame, targets: DataFrame, corpus_tokens: int, source_totals: dict[str, int]) -> DataFrame:
    """source, n_tokens, passes, extra, budget: how often documents of each length are used in full, and how
    many of them once more. One task per source; its rows are that source's distinct lengths."""
    rows = [
        (r["source"], max(0.0, float(r["share"] or 0)), max(0, int(r["cap"] or 0)), source_totals.get(r["source"], 0))
        for r in target_rows(targets)
    ]
    budget = budgets(rows, corpus_tokens)
    cap = {r[0]: r[2] for r in rows}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        lengths, counts = pdf["n_tokens"].to_numpy(), pdf["n"].to_numpy()
        tokens = int((lengths.astype(np.int64) * counts).sum())
        passes = min(budget[source] // tokens, cap[source]) if tokens else 0
        rest = budget[source] - passes * tokens
        extra = fit_lengths(lengths, counts, rest) if passes < cap[source] else np.zeros(len(counts), dtype=np.int64)
        return pd.DataFrame({"source": source, "n_tokens": lengths, "passes": passes, "extra": extra, "budget": budget[source]})

    return histogram.where(F.col("source").isin(list(budget))).groupBy("source").applyInPandas(fit, PLAN)


def _rank(seed: int, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), key)


def choose(sized: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """key, source, n_tokens, uses (>= 1). Of each (source, length) the `extra` documents of smallest seeded
    hash are used once more. Hashes are cut into buckets first: whole buckets are taken by their counts, and
    only the one bucket that holds the border is ordered, so a source of one length isn't ordered in one task."""
    group = ["source", "n_tokens"]
    docs = sized.withColumn("__h", _rank(seed, F.col(key))).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    by_bucket = docs.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__b"))
    cut_at = (
        by_bucket.withColumn("__upto", upto).join(plan, group)
        .select(*group, "__b", "passes", (F.col("extra") - (F.col("__upto") - F.col("__n"))).alias("__left"), "__n")
        .where("passes > 0 or __left > 0")
    )
    joined = docs.join(cut_at, [*group, "__b"])
    whole = joined.where("__left <= 0 or __left >= __n").select(key, *group, (F.col("passes") + (F.col("__left") > 0).cast("int")).alias("uses"))
    border = joined.where("__left > 0 and __left < __n")
    nth = F.row_number().over(Window.partitionBy(*group, "__b").orderBy("__h", key))
    edge = border.select(key, *group, (F.col("passes") + (nth <= F.col("__left")).cast("int")).alias("uses"))
    return whole.unionByName(edge).where("uses > 0")
