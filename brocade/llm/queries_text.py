"""Queries of problems 7, 8 and 9 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.llm.mixing import choose, plan_lengths, target_rows
from brocade.llm.spam import spam_pages
from brocade.llm.tokenizer import encode_corpus, token_count
from brocade.session import cut
from brocade.sources.tables import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return encode_corpus(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, dict[str, int]]:
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    # the texts are encoded once; what is kept are three narrow columns
    sized = cut(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")))
    targets = table(spark, sf_dir, "source_target").select("source", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    of_source = sized.groupBy("source").agg(F.sum("n_tokens").cast("long").alias("t"))
    everything = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long")).first()[0]
    totals = {r["source"]: r["t"] for r in target_rows(of_source.join(targets, "source", "left_semi"))}
    usable = sized.where("n_tokens > 0 and source is not null")
    histogram = usable.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    plan = cut(plan_lengths(histogram, targets, everything, totals))
    return usable, plan, everything, totals


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, uses: the documents of the mix and how often each is used."""
    usable, plan, _, _ = _mix(spark, sf_dir)
    return choose(usable, plan).select("doc_id", "source", "n_tokens", F.col("uses").cast("int").alias("uses"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: target_share, max_repeats, available and chosen tokens, the share reached and the most uses."""
    usable, plan, everything, _ = _mix(spark, sf_dir)
    targets = table(spark, sf_dir, "source_target")
    got = choose(usable, plan).groupBy("source").agg(
        F.sum(F.col("n_tokens").cast("long") * F.col("uses")).alias("mix_tokens"), F.max("uses").cast("int").alias("most_uses"), F.count(F.lit(1)).alias("docs_used")
    )
    there = usable.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    total = got.agg(F.sum("mix_tokens").alias("all_tokens"))
    return (
        targets.join(there, "source", "left").join(got, "source", "left").crossJoin(F.broadcast(total))
        .select(
            "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
            F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.round(F.coalesce("mix_tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("reached_share"),
            F.lit(everything).cast("long").alias("corpus_tokens"),
        )
    )


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the label of the sure signals, the trees' score and the score smoothed by site."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "site"])
    return spam_pages(docs, "doc_id", "text", "site").withColumnRenamed("host", "site")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are spam pages."""
    return p9_scores(spark, sf_dir).where("spam").select("doc_id")


QUERIES = {"p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores}
SQL: dict[str, str] = {}
