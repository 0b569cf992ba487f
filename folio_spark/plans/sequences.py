"""Queries over ordered pages: run ends, failure runs, progress, ledger and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import progress as P
from ..operators import select as S
from ..operators import sequence as Q
from .registry import query
from .sources import LEDGER_SQL, LINES_SQL, PAGES_PER_BOOK, ledger, lines

STATES_SQL = LEDGER_SQL + f"""
, states AS (
  SELECT user_id, max(page) AS current_page, count(*) FILTER (NOT failed) AS processed,
         count(*) FILTER (failed) AS failed, {PAGES_PER_BOOK}::BIGINT AS total_pages,
         CASE WHEN max(page) >= {PAGES_PER_BOOK} THEN 'completed' ELSE 'in_progress' END AS status
  FROM ledger GROUP BY user_id)
"""


def states(t):
    """Pages need no numbers here: a book's frontier is its page count."""
    total = F.lit(PAGES_PER_BOOK).cast("bigint")
    pages = t.events.select("user_id", (F.col("event_type") == "error").alias("failed"))
    return L.list_states(pages, "user_id", None, "failed", total)


@query("page_numbers", LEDGER_SQL + "SELECT user_id, event_id, page FROM ledger")
def page_numbers(t):
    return ledger(t).select("user_id", "event_id", "page")


@query("end_page", LINES_SQL + """
, marked AS (SELECT doc_id, pos, line,
    lag(line, 1) OVER w AS l1, lag(line, 2) OVER w AS l2
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, min(pos) AS end_page FROM marked WHERE line = l1 AND line = l2 GROUP BY doc_id
""")
def end_page(t):
    return Q.end_of_sequence(lines(t), "doc_id", "pos", "line", n=3)


@query("truncate_at_end", LINES_SQL + """
, marked AS (SELECT doc_id, pos, line,
    lag(line, 1) OVER w AS l1, lag(line, 2) OVER w AS l2
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ends AS (SELECT doc_id, min(pos) AS e FROM marked WHERE line = l1 AND line = l2 GROUP BY doc_id)
SELECT doc_id, count(*) AS total_pages, max(pos) AS last_page, count(e) > 0 AS cut
FROM lines LEFT JOIN ends USING (doc_id) WHERE e IS NULL OR pos <= e GROUP BY doc_id
""")
def truncate_at_end(t):
    pages = lines(t)
    ends = Q.end_of_sequence(pages, "doc_id", "pos", "line", n=3)
    kept = Q.truncate_at_end(
        pages.select("doc_id", "pos"), ends.withColumn("cut_at", F.col("end_page")), "doc_id", "pos"
    )
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.max("pos").alias("last_page"),
        (F.count("cut_at") > 0).alias("cut"),
    )


def alarm_sql(k):
    lags = " AND ".join(f"lag(failed, {j}) OVER w" for j in range(1, k))
    return f"""
SELECT {k}::INT AS k, user_id, min(page) AS abort_page FROM (
  SELECT user_id, page, failed AND {lags} AS hit FROM ledger
  WINDOW w AS (PARTITION BY user_id ORDER BY page))
WHERE hit GROUP BY user_id"""


@query("failure_runs", LEDGER_SQL + alarm_sql(3) + " UNION ALL " + alarm_sql(5))
def failure_runs(t):
    return Q.failure_alarms(ledger(t), "user_id", "page", "failed", [3, 5])


@query("abort_on_failures", LEDGER_SQL + f"""
, cuts AS ({alarm_sql(3)})
SELECT l.user_id, count(*) AS attempted_pages, count(*) FILTER (NOT failed) AS processed,
       CASE WHEN min(abort_page) IS NULL THEN max(page) ELSE max(page) - 1 END AS current_page,
       CASE WHEN min(abort_page) IS NULL THEN 'in_progress' ELSE 'failed' END AS status
FROM ledger l LEFT JOIN cuts c ON l.user_id = c.user_id
WHERE abort_page IS NULL OR page <= abort_page GROUP BY l.user_id
""")
def abort_on_failures(t):
    pages = ledger(t)
    cuts = Q.failure_alarm(pages, "user_id", "page", "failed", 3)
    kept = Q.cut_after(
        pages, cuts.withColumn("_hit", F.col("abort_page")), "user_id", "page", "abort_page"
    )
    out = kept.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("attempted_pages"),
        F.count_if(~F.col("failed")).alias("processed"),
        F.max("page").alias("_last"),
        F.max("_hit").alias("_hit"),
    )
    aborted = F.col("_hit").isNotNull()
    return out.select(
        "user_id",
        "attempted_pages",
        "processed",
        F.when(aborted, F.col("_last") - 1).otherwise(F.col("_last")).alias("current_page"),
        F.when(aborted, F.lit(L.FAILED)).otherwise(F.lit(L.IN_PROGRESS)).alias("status"),
    )


SUMMARY_SQL = LEDGER_SQL + f"""
, timed AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY page), ts) / 1e6 AS s
  FROM ledger),
base AS (SELECT user_id, max(page) AS current_page, {PAGES_PER_BOOK}::BIGINT AS total_pages,
    date_diff('microsecond', min(ts), max(ts)) / 1e6 AS elapsed,
    avg(s) FILTER (NOT failed) AS mean, count(*) FILTER (failed) AS failed_pages_count
  FROM timed GROUP BY user_id),
summary AS (SELECT *, least(current_page / total_pages * 100.0, 100.0) AS pct,
    CASE WHEN mean IS NULL THEN NULL WHEN current_page >= total_pages THEN 0.0
         ELSE mean * (total_pages - current_page) END AS eta FROM base)
"""


@query("progress_summary", SUMMARY_SQL + """
SELECT user_id, current_page, total_pages, failed_pages_count,
       round(elapsed, 3) AS elapsed_seconds, round(mean, 3) AS average_page_time,
       round(pct, 4) AS progress_percentage, round(eta, 2) AS remaining_seconds,
       round(CASE WHEN mean <> 0 THEN 60.0 / mean END, 8) AS pages_per_minute
FROM summary
""")
def progress_summary(t):
    out = P.progress_summary(
        ledger(t), "user_id", "page", "ts", "failed", F.lit(PAGES_PER_BOOK).cast("bigint")
    )
    digits = {
        "elapsed_seconds": 3, "average_page_time": 3, "progress_percentage": 4,
        "remaining_seconds": 2, "pages_per_minute": 8,
    }
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


DURATION_SQL = """CASE WHEN {s} >= 3600 THEN (({s}) // 3600) || 'h ' || ((({s}) % 3600) // 60) || 'm ' || (({s}) % 60) || 's'
  WHEN {s} >= 60 THEN (({s}) // 60) || 'm ' || (({s}) % 60) || 's' ELSE ({s}) || 's' END"""


@query("progress_display", SUMMARY_SQL + f"""
, whole AS (SELECT user_id, current_page, total_pages, pct, floor(round(elapsed, 3))::BIGINT AS el, floor(round(eta, 3))::BIGINT AS re,
  round(mean, 6) AS mean, round(CASE WHEN mean <> 0 THEN 60.0 / mean END, 6) AS rate, failed_pages_count FROM summary)
SELECT user_id,
  '[' || repeat('█', floor(50 * pct / 100.0)::INT) || repeat('░', 50 - floor(50 * pct / 100.0)::INT) || '] '
     || (round(pct, 1)::DECIMAL(38,1)) || '%' AS bar,
  'Progress: ' || current_page || '/' || total_pages || ' pages (' || (round(pct, 1)::DECIMAL(38,1)) || '%)' || chr(10)
  || 'Elapsed: ' || {DURATION_SQL.format(s='el')} || chr(10)
  || 'Remaining: ' || coalesce({DURATION_SQL.format(s='re')}, 'Calculating...')
  || CASE WHEN mean IS NULL THEN '' ELSE chr(10) || 'Avg time per page: ' || (round(mean, 2)::DECIMAL(38,2)) || 's' END
  || CASE WHEN rate IS NULL THEN '' ELSE chr(10) || 'Pages per minute: ' || (round(rate, 1)::DECIMAL(38,1)) END
  || CASE WHEN failed_pages_count > 0 THEN chr(10) || 'Failed pages: ' || failed_pages_count ELSE '' END AS display
FROM whole
""")
def progress_display(t):
    out = P.progress_summary(
        ledger(t), "user_id", "page", "ts", "failed", F.lit(PAGES_PER_BOOK).cast("bigint")
    )
    out = out.withColumns({c: F.round(c, 3) for c in ("elapsed_seconds", "remaining_seconds")})
    out = out.withColumns({c: F.round(c, 6) for c in ("average_page_time", "pages_per_minute")})
    return P.progress_display(out, verbose=True).select("user_id", "bar", "display")


@query("since_restart", """
WITH last AS (SELECT user_id, max(ts) AS r FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.user_id, count(*) AS pages, count(*) FILTER (event_type = 'error') AS failed,
       round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) AS elapsed_seconds
FROM events e LEFT JOIN last l ON e.user_id = l.user_id WHERE r IS NULL OR ts >= r GROUP BY e.user_id
""")
def since_restart(t):
    events = t.events.select("user_id", "event_id", "ts", "event_type")
    kept = Q.pages_since_restart(events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", Q.time_chunk("ts"))
    span = (F.max(Q.micros("ts")) - F.min(Q.micros("ts"))) / 1_000_000.0
    return kept.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.round(span, 3).alias("elapsed_seconds"),
    )


@query("init_ledger", """
SELECT conv_id, 0::BIGINT AS current_page, count(*) AS total_pages, 0::BIGINT AS processed, 0::BIGINT AS failed,
       'in_progress' AS status FROM conversations GROUP BY conv_id
""")
def init_ledger(t):
    books = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return L.init_ledger(books, "conv_id", "n").drop("start_datetime", "last_update")


@query("list_states", STATES_SQL + "SELECT * FROM states")
def list_states(t):
    return states(t)


@query("state_lists", LEDGER_SQL + """
SELECT user_id, page // 1000 AS part,
       to_json(coalesce(list_sort(list(page) FILTER (NOT failed)), []))::VARCHAR AS processed_pages,
       to_json(coalesce(list_sort(list(page) FILTER (failed)), []))::VARCHAR AS failed_pages
FROM ledger GROUP BY ALL
""")
def state_lists(t):
    out = L.state_lists(ledger(t), "user_id", "page", "failed")
    return out.withColumns({c: F.to_json(c) for c in ("processed_pages", "failed_pages")})


@query("latest_state", """
SELECT user_id, event_id, event_type AS status, round(value, 2) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_state(t):
    attempts = t.events.select(
        "user_id", "ts", "event_id", F.col("event_type").alias("status"), F.round("value", 2).alias("value")
    )
    return L.latest_state(attempts, "user_id", ["ts", "event_id"]).drop("ts")


@query("ledger_cleanup", STATES_SQL + """
SELECT l.user_id, l.page, l.failed FROM ledger l
WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.user_id = l.user_id AND s.status = 'completed')
""")
def ledger_cleanup(t):
    return L.drop_completed(ledger(t), states(t), "user_id", "page").select("user_id", "page", "failed")


@query("delete_states", """
WITH named AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT n.user_id, count(e.event_id) > 0 AS deleted, count(e.event_id) AS pages
FROM named n LEFT JOIN events e USING (user_id) GROUP BY n.user_id
""")
def delete_states(t):
    """The answer for every named book; what is left is checked by the tests."""
    named = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    _, answers = L.delete_books(t.events.select("user_id", "event_id"), named, "user_id")
    return answers


@query("can_resume", STATES_SQL + """
SELECT user_id, current_page, total_pages FROM states WHERE status = 'in_progress' AND current_page < total_pages
""")
def can_resume(t):
    return S.eligible_for_resume(states(t)).select("user_id", "current_page", "total_pages")


@query("resume_todo", STATES_SQL + """
SELECT user_id, unnest(range(current_page + 1, total_pages + 1)) AS page FROM states WHERE status = 'in_progress'
""")
def resume_todo(t):
    return L.resume_todo(states(t), "user_id")


@query("retry_todo", LEDGER_SQL + f"""
SELECT u.user_id, p.page FROM (SELECT DISTINCT user_id FROM events) u, range(1, {PAGES_PER_BOOK} + 1) p(page)
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.user_id = u.user_id AND l.page = p.page AND NOT l.failed)
""")
def retry_todo(t):
    books = t.events.select("user_id").distinct()
    expected = L.expected_pages(books, "user_id", F.lit(1), F.lit(PAGES_PER_BOOK))
    return L.retry_todo(expected, ledger(t), "user_id", "page", "failed")


@query("run_summary", LEDGER_SQL + """
SELECT user_id, count(*) AS total, count(*) FILTER (NOT failed) AS processed, count(*) FILTER (failed) AS failed,
       min(page) FILTER (failed) AS first_failed, max(page) FILTER (failed) AS last_failed
FROM ledger GROUP BY user_id
""")
def run_summary(t):
    return L.run_summary(ledger(t), "user_id", "page", "failed")


@query("failed_pages", LEDGER_SQL + "SELECT user_id, page FROM ledger WHERE failed")
def failed_pages(t):
    return L.failed_pages(ledger(t), "user_id", "page", "failed")


@query("checkpoints", LEDGER_SQL + "SELECT user_id, page, event_id FROM ledger WHERE page % 10 = 0")
def checkpoints(t):
    return S.checkpoint_rows(ledger(t), "page", 10).select("user_id", "page", "event_id")


@query("attempted", """
WITH tried AS (SELECT user_id, hour(ts) AS page, event_type <> 'error' AS ok FROM events)
SELECT user_id, page, CASE WHEN bool_or(ok) THEN 'processed' ELSE 'failed' END AS status FROM tried GROUP BY ALL
""")
def attempted(t):
    pages = t.events.select("user_id", F.hour("ts").cast("bigint").alias("page"), "event_type")
    bad = F.col("event_type") == "error"
    return L.attempted(pages.filter(~bad), pages.filter(bad), "user_id", "page")


@query("missing_pages", """
SELECT o_orderkey, page::INT AS page FROM orders, range(1, 8) r(page)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = page)
""")
def missing_pages(t):
    expected = L.expected_pages(t.orders, "o_orderkey", F.lit(1), F.lit(7))
    expected = expected.withColumn("page", F.col("page").cast("int"))
    seen = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page"))
    return L.missing_pages(expected, seen, "o_orderkey", "page")


@query("dedupe_lines", LINES_SQL + "SELECT doc_id, min(pos) AS pos, line FROM lines GROUP BY doc_id, line")
def dedupe_lines(t):
    return L.dedupe_lines(lines(t), "doc_id", "line", "pos")


@query("avg_conf", """
SELECT doc_id // 10 AS book, coalesce(avg(quality), 0.0) AS plain,
       coalesce(avg(CASE WHEN toxic = 1 THEN NULL ELSE quality END), 0.95) AS defaulted
FROM labels GROUP BY book
""")
def avg_conf(t):
    kept = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("quality"))
    return t.labels.groupBy(F.floor(F.col("doc_id") / 10).alias("book")).agg(
        P.average_or(F.col("quality"), 0.0).alias("plain"),
        P.average_or(kept, P.DEFAULT_CONFIDENCE).alias("defaulted"),
    )


@query("avg_conf_sentinel", """
WITH raw AS (SELECT user_id, CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS conf FROM events)
SELECT user_id, round(coalesce(avg(CASE WHEN conf >= 0 THEN conf / 100.0 END), 0.0), 8) AS confidence FROM raw GROUP BY user_id
""")
def avg_conf_sentinel(t):
    raw = F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value"))
    return t.events.groupBy("user_id").agg(F.round(P.average_confidence(raw), 8).alias("confidence"))


STAGES = {"screenshot": "l_tax", "preprocessing": "l_discount", "ocr": "l_quantity", "total": "l_extendedprice"}


@query("stage_report", " UNION ALL ".join(f"""
SELECT '{stage}' AS stage, count(*) AS samples, round(sum({c}), 2) AS total, round(avg({c}), 6) AS average,
       min({c}) AS minimum, max({c}) AS maximum FROM lineitem""" for stage, c in STAGES.items()))
def stage_report(t):
    out = P.stage_report(t.lineitem, STAGES)
    return out.withColumns({"total": F.round("total", 2), "average": F.round("average", 6)})


@query("severity_counts", """
WITH i AS (SELECT o_orderstatus, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high'
    WHEN '3' THEN 'medium' ELSE 'low' END AS s FROM orders)
SELECT o_orderstatus, count(*) AS total_issues, count(*) FILTER (s = 'high') AS high_severity,
       count(*) FILTER (s = 'medium') AS medium_severity, count(*) FILTER (s = 'low') AS low_severity
FROM i GROUP BY o_orderstatus
""")
def severity_counts(t):
    return P.severity_counts(t.orders, severity_of("o_orderpriority"), ["o_orderstatus"])


def severity_of(priority: str):
    digit = F.substring(priority, 1, 1)
    return F.when(digit.isin("1", "2"), "high").when(digit == "3", "medium").otherwise("low")
