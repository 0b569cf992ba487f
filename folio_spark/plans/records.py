"""Queries of the JSON, option and report functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as R
from ..functions.binding import let
from ..operators import progress as P
from ..operators.assemble import assemble_pages
from ..operators.sequence import page_chunk
from .registry import query
from .sequences import severity_of

CONFIG_SQL = """WITH c AS (SELECT event_id, '{"ocr": {"engine": "' || event_type || '", "limits": ' || props || '}, "extra": 1}' AS j FROM events)
"""


def config():
    """Option records: the event properties nested below the event type."""
    return F.concat(
        F.lit('{"ocr": {"engine": "'), F.col("event_type"), F.lit('", "limits": '), F.col("props"),
        F.lit('}, "extra": 1}'),
    )


@query("json_get", CONFIG_SQL + """
SELECT event_id, json_extract_string(j, '$.ocr.limits.k') AS k, json_extract_string(j, '$.ocr.engine') AS engine,
  coalesce(json_extract_string(j, '$.ocr.mode'), 'default') AS mode, json_extract(j, '$.ocr.limits')::VARCHAR AS section FROM c
""")
def json_get(t):
    record = config()
    return t.events.select(
        "event_id",
        R.json_get(record, "ocr.limits.k").alias("k"),
        R.json_get(record, "ocr.engine").alias("engine"),
        R.json_get(record, "ocr.mode", "default").alias("mode"),
        R.json_section(record, "ocr.limits").alias("section"),
    )


@query("json_required", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'k,ocr.mode' ELSE 'ocr.mode' END AS missing FROM events
""")
def json_required(t):
    record = F.when(F.col("event_type") == "error", F.lit('{"a": 1}')).otherwise(F.col("props"))
    return t.events.select("event_id", F.array_join(R.missing_paths(record, ["k", "ocr.mode"]), ",").alias("missing"))


OPTIONS = T.StructType([
    T.StructField("ocr", T.StructType([
        T.StructField("engine", T.StringType()),
        T.StructField("timeout", T.IntegerType()),
        T.StructField("limits", T.StructType([T.StructField("k", T.IntegerType()), T.StructField("max", T.DoubleType())])),
    ])),
])


@query("json_typed", CONFIG_SQL + """
SELECT event_id, json_extract_string(j, '$.ocr.engine') AS engine, 30::INT AS timeout, json_extract(j, '$.ocr.limits.k')::INT AS k, 0.5::DOUBLE AS "max" FROM c
""")
def json_typed(t):
    options = R.typed_record(config(), OPTIONS, {"ocr": {"engine": "none", "timeout": 30, "limits": {"k": 0, "max": 0.5}}})
    return t.spread("events").select("event_id", options.alias("o")).select(
        "event_id", "o.ocr.engine", "o.ocr.timeout", "o.ocr.limits.k", "o.ocr.limits.max"
    )


@query("json_extract", """
SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'click') THEN value::BIGINT ELSE 0 END AS total_issues,
  CASE WHEN event_type IN ('error', 'view', 'click') THEN 'k ' || json_extract_string(props, '$.k')
       ELSE 'no record, only prose about ' || json_extract_string(props, '$.k') END AS comment
FROM events
""")
def json_extract(t):
    """Answers as a fenced record, a bare one, one within prose, or prose only."""
    k = F.get_json_object("props", "$.k")
    total = F.rint("value").cast("bigint")
    record = F.concat(
        F.lit('{"summary": {"total_issues": '), total, F.lit('}, "overall_comment": "k '), k, F.lit('"}')
    )
    kind = F.col("event_type")
    answer = (
        F.when(kind == "error", F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .when(kind == "view", record)
        .when(kind == "click", F.concat(F.lit("Here it is:\n"), record, F.lit("\nThat is all.")))
        .otherwise(F.concat(F.lit("no record, only prose about "), k))
    )
    return t.spread("events").select("event_id", R.review_record(answer).alias("r")).select(
        "event_id", "r.summary.total_issues", F.col("r.overall_comment").alias("comment")
    )


ISSUE_SQL = """WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS s,
  CASE o_orderstatus WHEN 'F' THEN 'bug' WHEN 'O' THEN 'security' ELSE 'other' END AS c, o_totalprice FROM orders)
"""


#: Order keys of one report: a customer with more orders gets several, each of bounded length.
ORDER_SPAN = 100_000


@query("md_report", ISSUE_SQL + """
SELECT o_custkey, '### 📊 Summary' || chr(10) || chr(10) || '- **Total Issues**: ' || count(*) || chr(10)
  || '- 🔴 High Severity: ' || count(*) FILTER (s = 'high') || chr(10) || '- 🟡 Medium Severity: ' || count(*) FILTER (s = 'medium') || chr(10)
  || '- 🔵 Low Severity: ' || count(*) FILTER (s = 'low') || chr(10) || chr(10) || '### 🔍 Findings' || chr(10) || chr(10)
  || string_agg('#### ' || o_orderkey || '. ' || CASE s WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' ELSE '🔵' END || ' '
     || CASE c WHEN 'bug' THEN '🐛' WHEN 'security' THEN '🔒' ELSE '📝' END || ' Order ' || o_orderkey
     || chr(10)||chr(10) || '**File**: `orders`' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10)||chr(10) || '**Line**: ' || o_orderkey ELSE '' END
     || chr(10)||chr(10) || '**Severity**: ' || upper(s[1]) || s[2:] || chr(10)||chr(10) || '**Category**: ' || c
     || chr(10)||chr(10) || '**Description**: status ' || c || CASE WHEN s = 'high' THEN chr(10)||chr(10) || '**Suggestion**: ship first' ELSE '' END
     || chr(10)||chr(10) || '---', chr(10)||chr(10) ORDER BY o_orderkey) AS report
FROM i GROUP BY o_custkey, o_orderkey // 100000
""")
def md_report(t):
    """One report per customer, its orders as issues, numbered by order key.

    Sections are assembled like pages, in parts of a key span; each part is a report with its own summary.
    """
    severity = severity_of("o_orderpriority")
    category = F.when(F.col("o_orderstatus") == "F", "bug").when(F.col("o_orderstatus") == "O", "security").otherwise("other")
    key = F.col("o_orderkey")
    section = R.issue_section(
        key, F.lit("orders"), F.when(key % 2 == 0, key.cast("string")), severity, category,
        F.concat(F.lit("Order "), key), F.concat(F.lit("status "), category),
        F.when(severity == "high", F.lit("ship first")),
    )
    issues = t.orders.select("o_custkey", "o_orderkey", section.alias("section"), severity.alias("severity"))
    body = assemble_pages(issues, "o_custkey", "o_orderkey", "section", sep="\n\n", part_pages=ORDER_SPAN)
    parts = issues.withColumn("part", page_chunk("o_orderkey", ORDER_SPAN))
    counts = P.severity_counts(parts, F.col("severity"), ["o_custkey", "part"])
    head = R.summary_section(*[F.col(c) for c in ("total_issues", "high_severity", "medium_severity", "low_severity")])
    report = F.concat(head, F.lit("\n\n### 🔍 Findings\n\n"), F.col("text"))
    return body.join(counts, ["o_custkey", "part"]).select("o_custkey", report.alias("report"))


@query("review_report", """
WITH i AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_linenumber, l_partkey, l_suppkey,
    floor(l_quantity)::BIGINT AS q, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS s,
    CASE l_linestatus WHEN 'F' THEN 'bug' ELSE 'performance' END AS c FROM lineitem)
SELECT l_orderkey, '### 📊 Summary' || chr(10) || chr(10) || '- **Total Issues**: ' || count(*) || chr(10)
  || '- 🔴 High Severity: ' || count(*) FILTER (s = 'high') || chr(10) || '- 🟡 Medium Severity: ' || count(*) FILTER (s = 'medium') || chr(10)
  || '- 🔵 Low Severity: ' || count(*) FILTER (s = 'low') || chr(10) || chr(10) || '### 🔍 Findings' || chr(10) || chr(10)
  || string_agg('#### ' || n || '. ' || CASE s WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' ELSE '🔵' END || ' '
     || CASE c WHEN 'bug' THEN '🐛' ELSE '⚡' END || ' Part ' || l_partkey
     || chr(10)||chr(10) || '**File**: `supplier-' || l_suppkey || '`'
     || CASE WHEN l_linenumber % 2 = 0 THEN chr(10)||chr(10) || '**Line**: ' || l_linenumber ELSE '' END
     || chr(10)||chr(10) || '**Severity**: ' || upper(s[1]) || s[2:] || chr(10)||chr(10) || '**Category**: ' || c
     || chr(10)||chr(10) || '**Description**: "quantity" ' || q || CASE WHEN s = 'high' THEN chr(10)||chr(10) || '**Suggestion**: return it' ELSE '' END
     || chr(10)||chr(10) || '---', chr(10)||chr(10) ORDER BY n)
  || CASE WHEN count(*) > 3 THEN chr(10)||chr(10) || '### 💬 Overall Assessment' || chr(10)||chr(10) || 'many lines' ELSE '' END AS report
FROM i GROUP BY l_orderkey
""")
def review_report(t):
    """One review per order, its lines as issues: written as a fenced JSON record, parsed again and shown as Markdown."""
    high, low = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    severity = F.when(high, "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    line = F.col("l_linenumber")
    issue = F.struct(
        F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("file"),
        F.when(line % 2 == 0, line.cast("string")).alias("line_range"),
        severity.alias("severity"),
        F.when(low, "bug").otherwise("performance").alias("category"),
        F.concat(F.lit("Part "), F.col("l_partkey")).alias("title"),
        F.concat(F.lit('"quantity" '), F.floor("l_quantity")).alias("description"),
        F.when(high, "return it").alias("suggestion"),
    )
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", issue.alias("issue"))))
    # An order has a handful of lines.
    orders = P.severity_counts(t.lineitem, severity, ["l_orderkey"]).join(
        t.lineitem.groupBy("l_orderkey").agg(lines.alias("lines")), "l_orderkey"
    )
    record = F.struct(
        F.struct("total_issues", "high_severity", "medium_severity", "low_severity").alias("summary"),
        F.transform("lines", lambda x: x["issue"]).alias("issues"),
        F.when(F.col("total_issues") > 3, "many lines").otherwise("").alias("overall_comment"),
    )
    text = F.concat(F.lit("```json\n"), F.to_json(record), F.lit("\n```"))
    return orders.select("l_orderkey", let(R.review_record(text), R.review_markdown).alias("report"))
