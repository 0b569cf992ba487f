"""The streaming operators, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import select as S
from ..session import scratch_path
from ..streaming import live, watch
from ..streaming.first import FirstDeliveries
from ..streaming.table import LedgerTable
from ..streaming.tables import is_folder
from .pages import clean_sql
from .registry import query
from .sources import LINES_SQL


#: Files of repeated deliveries in one micro-batch.
FILES_PER_BATCH = 3


def streamed(t, name):
    """A given table, one file or a folder of files, as a stream of its files."""
    schema = getattr(t, name).schema
    path = f"{t.folder}/{name}.parquet"
    if is_folder(t.spark, path):
        return live.read_pages(t.spark, path, schema)
    return live.read_pages(t.spark, t.folder, schema, pattern=f"{name}.parquet")


@query("live_pages", f"""
SELECT conv_id, turn, CASE WHEN turn = 0 AND role = 'system' THEN chr(10) || '[Page ' || turn || ' - No text detected]' || chr(10) || chr(10)
  ELSE {clean_sql('text')} END AS text FROM conversations
""")
def live_pages(t):
    """Intake: clean every arriving page and append it to the page table."""
    root = scratch_path(t.spark, "live-pages")
    success = ~((F.col("turn") == 0) & (F.col("role") == "system"))
    pages = streamed(t, "conversations").select(
        "conv_id", "turn", S.text_or_placeholder(success, X.clean_text(F.col("text")), F.col("turn")).alias("text")
    )
    live.append_pages(pages, f"{root}/pages", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/pages")


@query("live_end_page", LINES_SQL + """
, marked AS (SELECT doc_id, pos, line, lag(line, 1) OVER w AS l1, lag(line, 2) OVER w AS l2
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, min(pos) AS end_page FROM marked WHERE line = l1 AND line = l2 GROUP BY doc_id
""")
def live_end_page(t):
    root = scratch_path(t.spark, "live-ends")
    pages = streamed(t, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ends = watch.watched(pages, "doc_id", "pos", "line", watch.Repeats(3), first_page=0)
    watch.start(ends, f"{root}/ends", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/ends").select("doc_id", F.col("end").alias("end_page"))


@query("live_failure_alarm", """
WITH l AS (SELECT event_id % 97 AS book, event_id // 97 AS page, event_type = 'error' AS failed FROM events),
r AS (SELECT book, page, failed AND lag(failed, 1) OVER w AND lag(failed, 2) OVER w AS hit FROM l WINDOW w AS (PARTITION BY book ORDER BY page))
SELECT book, min(page) AS alarm_page FROM r WHERE hit GROUP BY book
""")
def live_failure_alarm(t):
    root = scratch_path(t.spark, "live-alarms")
    pages = streamed(t, "events").select(
        (F.col("event_id") % 97).alias("book"),
        F.floor(F.col("event_id") / 97).alias("page"),
        (F.col("event_type") == "error").alias("failed"),
    )
    ends = watch.watched(pages, "book", "page", "failed", watch.Failures(3), first_page=0)
    watch.start(ends, f"{root}/alarms", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/alarms").select("book", F.col("end").alias("alarm_page"))


@query("live_ledger", """
SELECT user_id, page, event_id, event_type AS status FROM (SELECT *, hour(ts) AS page,
  row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def live_ledger(t):
    root = scratch_path(t.spark, "live-ledger")
    pages = streamed(t, "events").select(
        "user_id", F.hour("ts").cast("bigint").alias("page"), "event_id", F.col("event_type").alias("status")
    )
    ledger = LedgerTable(f"{root}/ledger", pages.schema, "user_id", "page", ["event_id"])
    ledger.start(pages, f"{root}/checkpoint").awaitTermination()
    ledger.compact(t.spark)
    return ledger.current(t.spark)


@query("live_first_delivery", "SELECT user_id, event_id, ts, event_type FROM events")
def live_first_delivery(t):
    """Every event is delivered twice, in files out of time order and over several batches, and kept once."""
    root = scratch_path(t.spark, "live-repeats")
    twice = t.events.select(
        "user_id", "event_id", "ts", "event_type",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"), F.pmod("event_id", F.lit(4)).alias("slice"),
    )
    twice.write.partitionBy("delivery", "slice").parquet(f"{root}/deliveries")
    files = t.spark.read.parquet(f"{root}/deliveries").schema
    delivered = live.read_pages(t.spark, f"{root}/deliveries", files, files_per_batch=FILES_PER_BATCH)
    pages = delivered.select("user_id", "event_id", "ts", "event_type")
    once = FirstDeliveries(f"{root}/pages", pages.schema, ["user_id", "event_id"], "ts")
    once.start(pages, f"{root}/checkpoint").awaitTermination()
    return once.pages(t.spark)
