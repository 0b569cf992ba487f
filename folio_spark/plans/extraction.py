"""Queries of the extractors over raw web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assemble as A
from ..operators import extract as E
from .registry import query

ENTITY_SQL = "{t}"
for _entity, _char in E.ENTITIES.items():
    ENTITY_SQL = f"replace({ENTITY_SQL}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


def plain_sql(t):
    decoded = ENTITY_SQL.replace("{t}", f"regexp_replace({t}, '<[^>]*>', ' ', 'g')")
    return rf"trim(regexp_replace({decoded}, '\s+', ' ', 'g'))"


def sections_sql(t, tags):
    out = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags:
        out = rf"regexp_replace({out}, '(?is)<{tag}[\s>].*?</{tag}>', '', 'g')"
    return out


def blocks_sql(tags):
    marked = rf"regexp_replace({sections_sql('html', tags)}, '{E.OPENING_BLOCK}', chr(1) || '\1' || chr(2), 'g')"
    marked = f"regexp_replace({marked}, '{E.CLOSING_BLOCK}', chr(1), 'g')"
    return f"""WITH pieces AS (SELECT page_id, length(html) AS size, list_filter(string_split({marked}, chr(1)), lambda s: contains(s, chr(2))) AS ps FROM pages),
split AS (SELECT page_id, size, unnest(ps) AS piece, unnest(range(len(ps))) AS ord FROM pieces),
blocks AS (SELECT page_id, size, ord, lower(string_split(piece, chr(2))[1]) AS tag, {plain_sql("string_split(piece, chr(2))[-1]")} AS text FROM split),
sized AS (SELECT *, CASE tag WHEN 'h1' THEN 40 WHEN 'h2' THEN 30 WHEN 'h3' THEN 25 WHEN 'li' THEN 25 ELSE 20 END AS height FROM blocks)
"""


ALL_TAGS = ("script", "style")
ALL_BLOCKS_SQL = blocks_sql(ALL_TAGS)
BODY_BLOCKS_SQL = blocks_sql(E.DROPPED)
PLAIN_SQL = plain_sql(sections_sql("html", ALL_TAGS))


def block_rows(t):
    """Every block of every page, navigation included."""
    blocks = E.html_blocks(F.col("html"), ALL_TAGS)
    return t.spread("pages").select("page_id", F.posexplode(blocks).alias("ord", "b")).select("page_id", "ord", "b.*")


@query("extract_blocks", BODY_BLOCKS_SQL + """
, texts AS (SELECT page_id, any_value(size) AS size, string_agg(text, chr(10) ORDER BY ord) AS text, count(*) AS n
  FROM sized WHERE text <> '' GROUP BY page_id)
SELECT page_id, text, n AS blocks, round(length(text) / size, 6) AS confidence, true AS success FROM texts
""")
def extract_blocks(t):
    out = E.create("HTML_blocks").apply(t.spread("pages").select("page_id", "html"), "html")
    return out.select(
        "page_id",
        "result.text",
        F.size("result.blocks").cast("bigint").alias("blocks"),
        F.round("result.confidence", 6).alias("confidence"),
        "result.success",
    )


@query("extract_plain", f"""
WITH p AS (SELECT page_id, length(html) AS size, {PLAIN_SQL} AS text FROM pages)
SELECT page_id, text, round(length(text) / size, 6) AS confidence, text <> '' AS success FROM p
""")
def extract_plain(t):
    out = E.create("html_plain").apply(t.spread("pages").select("page_id", "html"), "html")
    return out.select("page_id", "result.text", F.round("result.confidence", 6).alias("confidence"), "result.success")


FALLBACK_SQL = BODY_BLOCKS_SQL + f"""
, primary_ AS (SELECT page_id, string_agg(text, chr(10) ORDER BY ord) AS text, length(string_agg(text, chr(10) ORDER BY ord)) / any_value(size) AS conf
  FROM sized WHERE text <> '' GROUP BY page_id),
second AS (SELECT page_id, {PLAIN_SQL} AS text, length({PLAIN_SQL}) / length(html) AS conf FROM pages)
"""


@query("extract_fallback", FALLBACK_SQL + """
SELECT s.page_id, CASE WHEN p.conf >= 0.7 THEN 'html_blocks' ELSE 'html_plain' END AS engine,
  CASE WHEN p.conf >= 0.7 THEN p.text ELSE s.text END AS text,
  CASE WHEN p.conf >= 0.7 THEN true ELSE s.conf >= 0.7 END AS success
FROM second s LEFT JOIN primary_ p USING (page_id)
""")
def extract_fallback(t):
    out = E.extract_with_fallback(
        t.spread("pages").select("page_id", "html"), "html", E.preference(["html_blocks"]), min_confidence=0.7
    )
    return out.select("page_id", "result.engine", "result.text", "result.success")


@query("best_attempt", """
WITH r AS (SELECT user_id, hour(ts) AS page, event_type, value / 100 AS confidence, event_id AS attempt, event_type <> 'error' AS success,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS priority FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY success DESC, priority, confidence DESC, attempt DESC) AS rn FROM r)
SELECT user_id, page, event_type AS engine, attempt, success FROM k WHERE rn = 1
""")
def best_attempt(t):
    """Events as repeated attempts of a few engines at the pages of a user's book."""
    kind = F.col("event_type")
    results = t.events.select(
        "user_id",
        F.hour("ts").cast("bigint").alias("page"),
        kind.alias("engine"),
        (F.col("value") / 100).alias("confidence"),
        F.col("event_id").alias("attempt"),
        (kind != "error").alias("success"),
        F.when(kind == "click", 1).when(kind == "view", 2).otherwise(3).alias("priority"),
    )
    return E.best_attempt(results, ["user_id", "page"], priority="priority").drop("confidence", "priority")


@query("engine_lookup", """
SELECT n_nationkey, r_regionkey AS engine_id, r_name AS engine
FROM nation LEFT JOIN region ON lower(r_name) = CASE n_nationkey % 3 WHEN 0 THEN 'asia' WHEN 1 THEN 'europe' ELSE lower(n_name) END
""")
def engine_lookup(t):
    """Nations ask for an engine by name in mixed case; regions are the registry."""
    asked = F.when(F.col("n_nationkey") % 3 == 0, "Asia").when(F.col("n_nationkey") % 3 == 1, "eUROPE").otherwise(F.col("n_name"))
    registry = t.region.select(F.col("r_regionkey").alias("engine_id"), F.col("r_name").alias("engine"))
    found = E.engine_lookup(t.nation.withColumn("asked", asked), "asked", registry, "engine")
    return found.select("n_nationkey", "engine_id", "engine")


@query("reading_order", ALL_BLOCKS_SQL + """
SELECT page_id, ord // 1000 AS part, count(*) AS blocks, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text
FROM sized WHERE text <> '' GROUP BY page_id, part
""")
def reading_order(t):
    blocks = block_rows(t).select("page_id", "ord", "text")
    return A.assemble_reading_order(blocks, "page_id", "ord", "text")


HEADING_SQL = ALL_BLOCKS_SQL + """
, avgs AS (SELECT *, avg(height) OVER (PARTITION BY page_id) AS mean FROM sized),
marked AS (SELECT *, height >= mean * 1.2 OR length(text) <= 30 AS heading, height >= mean * 1.2 AS tall,
  CASE WHEN height / mean >= 2.0 THEN 1 WHEN height / mean >= 1.5 THEN 2 ELSE 3 END AS level FROM avgs)
"""


@query("heading_blocks", HEADING_SQL + """
SELECT page_id, ord::INT AS ord, tag AS block_type, round(mean, 6) AS average, heading, CASE WHEN heading THEN level END AS level,
  CASE WHEN heading THEN repeat('#', level) || ' ' || text ELSE text END AS line FROM marked
""")
def heading_blocks(t):
    marked = E.mark_headings(E.html_blocks(F.col("html"), ALL_TAGS))
    rows = t.spread("pages").select("page_id", F.inline(marked)).drop("score", "text")
    return rows.withColumn("average", F.round("average", 6))


@query("heading_table", HEADING_SQL + "SELECT page_id, count(*) AS blocks, count(*) FILTER (heading) AS headings, sum(level) FILTER (heading) AS levels FROM marked GROUP BY page_id")
def heading_table(t):
    blocks = block_rows(t).withColumn("height", F.col("bounding_box.height"))
    marked = E.heading_blocks(blocks, "page_id", "ord", "height", "block_type", "text")
    return marked.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("heading").alias("headings"), F.sum("level").alias("levels")
    )


@query("heading_score", HEADING_SQL + """
SELECT page_id, ord::INT AS ord, round(0.3 * tall::INT + 0.7 * (ord = 0)::INT, 4)::DOUBLE AS score FROM marked
WHERE 0.3 * tall::INT + 0.7 * (ord = 0)::INT >= 0.5 OR heading
""")
def heading_score(t):
    marked = E.mark_headings(E.html_blocks(F.col("html"), ALL_TAGS))
    rows = t.spread("pages").select("page_id", F.inline(marked))
    kept = rows.filter((F.col("score") >= 0.5) | F.col("heading"))
    return kept.select("page_id", "ord", F.round("score", 4).alias("score"))


@query("contents_of_blocks", HEADING_SQL + """
SELECT page_id, coalesce(string_agg(repeat('  ', level - 1) || '- ' || text, chr(10) ORDER BY ord) FILTER (heading), '') AS toc
FROM marked GROUP BY page_id
""")
def contents_of_blocks(t):
    """Blocks to Markdown to a table of contents, all within the page's row."""
    marked = E.mark_headings(E.html_blocks(F.col("html"), ALL_TAGS))
    lines = F.array_join(F.transform(marked, lambda b: b["line"]), "\n")
    return t.spread("pages").select("page_id", X.table_of_contents(lines).alias("toc"))
