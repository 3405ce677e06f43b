"""Queries of the state operators over state tables made up from the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.operators import states
from brocade.sources import bronze
from brocade.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


AS_OF = "timestamp '2025-06-01 00:00:00'"
#: Made up: every page of bronze_page waits in a queue, every key of the batch is a file, every site a run.
_QUEUE = """queue as (select page_id as id, url, case page_id % 6 when 0 then 'pending' when 1 then 'processing' when 2 then 'fetched' when 3 then 'flushed' when 4 then 'done' else 'failed' end as status,
  crawl_date as discovered_at, case when page_id % 6 between 1 and 3 then crawl_date end as claimed_at from bronze_page)"""
_FILES = """files as (select source_bronze_key as key, min(obs_id) as n, case min(obs_id) % 4 when 0 then 'pending' when 1 then 'processing' when 2 then 'done' else 'failed' end as status,
  min(crawl_date) as discovered_at, repeat('e', cast(min(obs_id) % 4000 as int)) as last_error from listing_staging_batch group by source_bronze_key)"""
_RUNS = """runs as (select site as run_id, min(crawl_date) as started_at, case when length(site) % 3 = 0 then max(crawl_date) end as ended_at, count(*) as detail_pages_done from documents where site is not null group by site)"""


def _made(spark: SparkSession, d: str, sql: str, name: str, source: str) -> DataFrame:
    """One of the tables above by the same SQL, which both engines read alike."""
    body = sql.split(" as (", 1)[1].rsplit(")", 1)[0]
    return spark.sql(body.replace(f"from {source}", "from {given}"), given=table(spark, d, source))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, _QUEUE, "queue", "bronze_page")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, _FILES, "files", "listing_staging_batch")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, _RUNS, "runs", "documents")


def _shown(queue: DataFrame) -> DataFrame:
    return queue.select("id", "status", F.unix_micros("claimed_at").alias("claimed_us"))


@query(
    """select doc_id, case when doc_id % 11 = 0 then 'proxy_issue' when doc_id % 7 = 0 or doc_id % 9 = 0 then 'fetch_error' when doc_id % 9 = 1 then 'proxy_issue' when doc_id % 9 = 2 then 'fetch_error'
    when contains(lower(coalesce(text, '')), 'tôi không phải người máy') then 'proxy_issue' when doc_id % 9 = 3 then 'fetch_error' else 'ok' end as outcome from documents"""
)
def fetch_classification(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers, with made-up failures and states."""
    i = F.col("doc_id")
    status = F.when(i % 9 == 1, 429).when(i % 9 == 2, 503).when(i % 9 == 3, 404).when(i % 9 > 3, 200)
    error = F.when(i % 7 == 0, F.lit("timeout"))
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", states.fetch_outcome(i % 11 == 0, error, status, F.col("text")).alias("outcome"))


@query(f"with {_RUNS} select run_id, length(run_id) % 4 < 2 or detail_pages_done >= 50 as succeeded from runs")
def run_success(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("run_id") % 4
    reason = F.when(n == 0, "max_pages").when(n == 1, "no_more_data").when(n == 2, "fetch_error")
    return _runs(spark, d).select("run_id", states.run_succeeded(reason, F.col("detail_pages_done"), 50).alias("succeeded"))


@query(f"with {_QUEUE} select id, url from queue where status = 'pending' order by discovered_at, id limit 20")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty pages in line."""
    return states.claim(_queue(spark, d), 20, ["discovered_at"], "id", "pending", {})[1].select("id", "url")


@query(f"with {_RUNS} select run_id, detail_pages_done as page from runs order by detail_pages_done, run_id limit 1")
def progress_claim(spark: SparkSession, d: str) -> DataFrame:
    """The cursor that is least far, the first by name of several."""
    cursors = _runs(spark, d).select("run_id", F.col("detail_pages_done").alias("page"), F.lit("active").alias("status"))
    return states.claim(cursors, 1, ["page"], "run_id", "active", {"page": F.col("page") + 1})[1].select("run_id", "page")


@query(
    """with l as (select obs_id, case obs_id % 3 when 0 then listing_url when 1 then regexp_replace(listing_url, '^https?:', '') else regexp_replace(listing_url, '^https?://[^/]+', '') end as link from listing_staging_batch)
    select obs_id, case when regexp_matches(trim(link), '^[A-Za-z][A-Za-z0-9+.-]*:') or trim(link) = '' then trim(link) when trim(link) like '//%' then 'https:' || trim(link)
      else 'https://site.example/' || regexp_replace(trim(link), '^/+', '') end as url from l"""
)
def absolute_urls(spark: SparkSession, d: str) -> DataFrame:
    """The batch's urls with scheme or host cut off, made whole again."""
    i, url = F.col("obs_id"), F.col("listing_url")
    link = F.when(i % 3 == 0, url).when(i % 3 == 1, F.regexp_replace(url, "^https?:", "")).otherwise(F.regexp_replace(url, "^https?://[^/]+", ""))
    return table(spark, d, "listing_staging_batch", ["obs_id", "listing_url"]).select("obs_id", bronze.absolute_url(link).alias("url"))


@query(
    f"""with {_QUEUE}, first as (select id from queue where status = 'pending' order by discovered_at, id limit 20)
    select id, case when id in (select id from first) then 'processing' else status end as status, case when id in (select id from first) then epoch_us({AS_OF}) else epoch_us(claimed_at) end as claimed_us from queue"""
)
def queue_after_claim(spark: SparkSession, d: str) -> DataFrame:
    return _shown(states.claim(_queue(spark, d), 20, ["discovered_at"], "id", "pending", {"status": F.lit("processing"), "claimed_at": F.expr(AS_OF)})[0])


@query(
    f"""with {_QUEUE} select id, case when stale then 'pending' else status end as status, case when stale then null else epoch_us(claimed_at) end as claimed_us
    from (select *, coalesce(status in ('processing', 'fetched', 'flushed') and claimed_at < {AS_OF} - interval 1 day, false) as stale from queue)"""
)
def queue_reclaim(spark: SparkSession, d: str) -> DataFrame:
    stale = states.older_than(F.col("claimed_at"), 86_400, F.expr(AS_OF))
    return _shown(states.move(_queue(spark, d), stale, "pending", states.UNDER_WAY, {"claimed_at": F.lit(None).cast("timestamp")}))


@query(
    f"""with {_QUEUE}, hits as (select page_id as id from bronze_page where html is not null)
    select id, case when id in (select id from hits) and status in ('fetched', 'flushed') then 'done' else status end as status, epoch_us(claimed_at) as claimed_us from queue"""
)
def queue_done(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose html has been written are done, if they were fetched or flushed."""
    hits = table(spark, d, "bronze_page", ["page_id", "html"]).where("html is not null").select(F.col("page_id").alias("id"))
    return _shown(states.move_keys(_queue(spark, d), "id", hits, "done", ("fetched", "flushed")))


@query(
    f"""with {_QUEUE} select url, min(status) as status from queue group by url
    union all select listing_url, 'pending' from listing_staging_batch where listing_url not in (select url from queue where url is not null) and listing_url is not null group by listing_url"""
)
def queue_add(spark: SparkSession, d: str) -> DataFrame:
    """The batch's urls put in line, those that stand there left alone."""
    queue = _queue(spark, d).groupBy("url").agg(F.min("status").alias("status"))
    urls = table(spark, d, "listing_staging_batch", ["listing_url"]).where("listing_url is not null").select(F.col("listing_url").alias("url"), F.lit("pending").alias("status"))
    return states.add_missing(queue, urls, ["url"], ["status"])


@query(
    f"""with {_FILES} select key, case when status = 'processing' then 'failed' when status = 'failed' then 'pending' else status end as status,
    length(case when status = 'processing' then substr(repeat('x', 3000), 1, 2000) when status = 'failed' then null else last_error end) as error_length from files"""
)
def file_states(spark: SparkSession, d: str) -> DataFrame:
    """Failed files wait again, those in process fail with a shortened error."""
    again = states.move(_files(spark, d), F.lit(True), "pending", ("failed",), {"last_error": F.lit(None).cast("string")})
    failed = states.move(again, F.lit(True), "failed", ("processing",), {"last_error": states.shortened(F.lit("x" * 3000))})
    return failed.select("key", "status", F.length("last_error").alias("error_length"))


@query(f"with {_FILES} select key from files where status = 'pending' order by discovered_at, key")
def files_pending(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where("status = 'pending'").orderBy("discovered_at", "key").select("key")


_OPEN = "open as (select run_id, 'bronze/web/' || run_id || '.parquet.inprogress' as k from runs where length(run_id) % 2 = 0)"
_DECIDE = f"""select r.run_id, case when detail_pages_done >= 50 and k is not null then 'recovered' when r.run_id = 'nhadep.example' and detail_pages_done >= 50 then 'continued'
      when r.run_id = 'nhadep.example' then 'reset' else 'incomplete' end as decision, case when detail_pages_done >= 50 then substr(k, 1, length(k) - 11) end as final_key
    from runs r left join open o on o.run_id = r.run_id where ended_at is null and (r.run_id = 'nhadep.example' or started_at < {AS_OF} - interval 1 hour)"""


@query(f"with {_RUNS}, {_OPEN} {_DECIDE}")
def crash_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of runs without an end: promoted, reset or discarded."""
    runs = _runs(spark, d)
    open_ = runs.where(F.length("run_id") % 2 == 0).select("run_id", F.concat(F.lit("bronze/web/"), "run_id", F.lit(".parquet.inprogress")).alias("open_key"))
    return states.crash_decisions(runs, open_, "nhadep.example", 50, 3600, F.expr(AS_OF))


@query(
    f"""with {_RUNS}, {_OPEN}, decided as ({_DECIDE}) select r.run_id, case when decision = 'reset' then 0 else detail_pages_done end as pages,
    case when decision in ('recovered', 'incomplete') then decision end as stopped_reason, r.ended_at is not null or coalesce(decision in ('recovered', 'incomplete'), false) as ended
    from runs r left join decided d on d.run_id = r.run_id"""
)
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """The runs after those decisions."""
    decided = crash_decisions(spark, d)
    closed = F.coalesce(F.col("decision").isin("recovered", "incomplete"), F.lit(False))
    return _runs(spark, d).join(decided, "run_id", "left").select(
        "run_id", F.when(F.col("decision") == "reset", F.lit(0)).otherwise(F.col("detail_pages_done")).alias("pages"),
        F.when(closed, F.col("decision")).alias("stopped_reason"), (F.col("ended_at").isNotNull() | closed).alias("ended"),
    )


_PARTS = """parts as (select cast(i as int) as part_number, case when i % 3 = 0 then 'pending' when i % 10 = 1 then 'failed' else 'done' end as status,
  case when i % 4 <> 2 then 'bronze/dataset/part=' || i || '.parquet' end as s3_key from range(1, 78) t(i)), keys as (select distinct source_bronze_key as key from listing_staging_batch)"""


@query(f"with {_PARTS} select part_number from parts where status in ('pending', 'failed') or s3_key is null or s3_key not in (select key from keys where key is not null) order by part_number")
def parts_to_process(spark: SparkSession, d: str) -> DataFrame:
    """Parts that wait, failed, or are done without a file, in order."""
    i = F.col("id")
    parts = spark.range(1, bronze.PARTS + 1).select(
        i.cast("int").alias("part_number"), F.when(i % 3 == 0, F.lit("pending")).when(i % 10 == 1, F.lit("failed")).otherwise(F.lit("done")).alias("status"),
        F.when(i % 4 != 2, F.concat(F.lit("bronze/dataset/part="), i.cast("string"), F.lit(".parquet"))).alias("s3_key"),
    )
    return states.parts_to_process(parts, table(spark, d, "listing_staging_batch").select(F.col("source_bronze_key").alias("key")))


@query("select count(*) filter (where owner_direct is null) as undirected, count(*) as rows from listing_staging_batch")
def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a batch in one aggregate over one column."""
    rows = table(spark, d, "listing_staging_batch", ["owner_direct"])
    return rows.agg(F.count(F.when(F.col("owner_direct").isNull(), 1)).alias("undirected"), F.count(F.lit(1)).alias("rows"))


@query(
    """with all_days as (select p, l, t, cast(day as date) as day from (values ('ho-chi-minh'), ('binh-duong'), ('ba-ria-vung-tau')) a(p), (values ('can-ban'), ('cho-thue')) b(l),
    (values ('nha-mat-tien'), ('nha-trong-hem'), ('biet-thu-nha-lien-ke'), ('can-ho-chung-cu'), ('phong-tro-nha-tro')) c(t), (values ('2025-01-01'), ('2025-01-02')) e(day))
    select 'https://site.example/' || l || '-' || t || '/' || p as combination, day, case when day = date '2025-01-01' then 4 else 1 end as current_page, 'active' as status from all_days"""
)
def daily_reset(spark: SparkSession, d: str) -> DataFrame:
    """Thirty cursors of a day, added to those of the day before; asking twice adds nothing."""
    from brocade.plans.reference import page_combinations

    def cursors(day: str, page: int) -> DataFrame:
        return page_combinations(spark, d).select(F.col("first_page").alias("combination"), F.lit(day).cast("date").alias("day"), F.lit(page).alias("current_page"), F.lit("active").alias("status"))

    key, new = ["combination", "day"], cursors("2025-01-02", 1)
    return states.add_missing(states.add_missing(cursors("2025-01-01", 4), new, key, ["current_page"]), new, key, ["current_page"])
