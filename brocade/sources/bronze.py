"""Raw page batches: scans with a schema check, what the key layout says, and links on list pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.functions.exprs import DATASET_PREFIX
from brocade.functions.html import read_html
from brocade.sources.tables import require_columns

REQUIRED = ("url", "crawl_date", "html")
PARTS = 77
UNFINISHED = ".inprogress"
#: Fixed value: what a page asks before it shows a listing.
CAPTCHA = "Tôi không phải người máy"
SITE = "https://site.example"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The three required columns of a page batch, or an error naming those it lacks."""
    return require_columns(spark.read.option("recursiveFileLookup", "true").parquet(path), REQUIRED, path).select(*REQUIRED)


def write_pages(pages: DataFrame, path: str) -> None:
    """Append by day of crawl, so that later scans can skip days."""
    pages.withColumn("date", F.to_date("crawl_date")).write.mode("append").partitionBy("date").parquet(path)


def append_table(df: DataFrame, path: str, by: str = "source_bronze_key") -> None:
    """Replace the partitions of `by` that df holds and no other, so that a file that runs again leaves no copies."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def dataset_part(key: Column) -> Column:
    """The part number in a dataset key, null elsewhere."""
    number = F.regexp_extract(key, f"^{DATASET_PREFIX}part=(\\d+)\\.parquet$", 1)
    return F.nullif(number, F.lit("")).try_cast("int")


def run_key(day: Column, run_id: Column) -> Column:
    """The key of a crawl run's file: its day and its sanitised id."""
    clean = F.replace(F.replace(run_id, F.lit(":"), F.lit("-")), F.lit("+"), F.lit("-"))
    return F.concat(F.lit("bronze/web/date="), F.date_format(day, "yyyy-MM-dd"), F.lit("/part-"), clean, F.lit(".parquet"))


def missing_parts(keys: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Part numbers 1..parts without a key."""
    there = keys.select(dataset_part(F.col(key)).alias("part_number")).where("part_number is not null").distinct()
    wanted = keys.sparkSession.range(1, parts + 1).select(F.col("id").cast("int").alias("part_number"))
    return wanted.join(there, "part_number", "left_anti")


def orphaned(keys: DataFrame, key: str) -> DataFrame:
    """Unfinished keys whose finished key exists as well."""
    done = keys.select(F.col(key).alias("done"))
    open_ = keys.where(F.col(key).endswith(UNFINISHED)).withColumn("done", F.regexp_replace(key, r"\.inprogress$", ""))
    return open_.join(done, "done", "left_semi").select(key)


def new_files(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys found that aren't registered yet."""
    return found.select(key).distinct().join(known.select(key), key, "left_anti")


def asks_captcha(html: Column) -> Column:
    return F.instr(F.lower(html.cast("string")), CAPTCHA.lower()) > 0


def listing_page_url(province: Column, listing_type: Column, property_type: Column, page: Column, base: str = SITE) -> Column:
    root = F.concat(F.lit(f"{base}/"), listing_type, F.lit("-"), property_type, F.lit("/"), province)
    return F.when(page <= 1, root).otherwise(F.concat(root, F.lit("/trang-"), page.cast("string")))


def absolute_url(link: Column, base: str = SITE) -> Column:
    """A link as found on a page of base: with a scheme as it is, '//host' with base's scheme, anything else under base's
    host (a link without a leading slash too, since list pages lie at the root). '' and null stay."""
    scheme = base.split("//", 1)[0]
    bare = F.trim(link)
    return (
        F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (bare == ""), bare).when(bare.startswith("//"), F.concat(F.lit(scheme), bare))
        .otherwise(F.concat(F.lit(f"{base}/"), F.regexp_replace(bare, "^/+", "")))
    )


def page_cards(pages: DataFrame, key: str, html: str, base: str = SITE, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns to keep, cards, urls: how many listing cards a page shows (none is the end of the list) and the absolute
    links of those that have one, in order. A null page shows none."""
    known = [key, *keep]
    out = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in known) + ", cards int, urls array<string>"

    def links(page: bytes | None) -> tuple[int, list[str]]:
        if page is None:
            return 0, []
        cards = [n for n in read_html(page).walk() if n.name == "article" and "property-item" in n.classes()]
        urls = [a.attrs["href"] for c in cards if (a := c.find(lambda n: n.name == "a" and n.attrs.get("itemprop") == "url")) and a.attrs.get("href")]
        return len(cards), [u if u.startswith(("http://", "https://")) else f"{base}/{u.lstrip('/')}" for u in urls]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [links(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, known), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=[*known, "cards", "urls"]
            )

    return pages.select(*known, F.col(html).alias("__html")).mapInArrow(run, out)
