"""Queries over pages and blocks: selection, boxes, expectations, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators import assemble as A
from ..operators import quality as V
from ..operators import select as S
from ..session import scratch_path
from ..sources import books as B
from ..sources import sinks as K
from .registry import query
from .sources import LINES_SQL, lines

SEP_SQL = "chr(10)||chr(10)||'---'||chr(10)||chr(10)"
RULE_SQL = "chr(10)||repeat('=', 80)||chr(10)||chr(10)"


def clean_sql(t):
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({t},
   chr(13)||chr(10)||'|'||chr(13), chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'),
   '-'||chr(10), '', 'g'), '[ \t\x{{3000}}]+', ' ', 'g')"""


def strip_sql(t):
    blanks = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return f"regexp_replace({t}, '^[{blanks}]+|[{blanks}]+$', '', 'g')"


@query("assemble_pages", f"""
SELECT conv_id, turn // 1000 AS part, count(*) AS pages, min(turn) AS first_page, max(turn) AS last_page,
       string_agg({clean_sql('text')}, {SEP_SQL} ORDER BY turn) AS text
FROM conversations GROUP BY conv_id, part
""")
def assemble_pages(t):
    pages = t.spread("conversations").select("conv_id", "turn", X.clean_text(F.col("text")).alias("text"))
    return A.assemble_pages(pages, "conv_id", "turn", "text")


@query("page_range", "SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 2 AND 4")
def page_range(t):
    return S.page_range(t.conversations, "turn", 2, 4).select("conv_id", "turn", "text")


@query("placeholder", f"""
SELECT conv_id, string_agg(CASE WHEN role = 'user' AND turn % 3 = 0 THEN
   chr(10) || '[Page ' || turn || ' - No text detected]' || chr(10) || chr(10) ELSE text END, {RULE_SQL} ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def placeholder(t):
    """Every third user turn is taken as a page whose recognition found nothing."""
    empty = (F.col("role") == "user") & (F.col("turn") % 3 == 0)
    text = F.when(empty, F.lit(" \n")).otherwise(F.col("text"))
    pages = t.conversations.select("conv_id", "turn", text.alias("text"))
    filled = pages.withColumn("text", S.text_or_placeholder(F.lit(True), F.col("text"), F.col("turn")))
    return A.assemble_pages(filled, "conv_id", "turn", "text", sep=A.RULE_SEPARATOR).select("conv_id", "text")


@query("markdown_doc", """
SELECT conv_id, 0 AS section, 0::BIGINT AS part, '# Conversation ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || 'Pages: ' || count(*) || chr(10)
  || 'Title: conversation ' || conv_id || chr(10) || '---' || chr(10) || chr(10) || '## 目次' AS text FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 1, turn // 1000, string_agg('  - Turn ' || turn, chr(10) ORDER BY turn) FROM conversations GROUP BY ALL
UNION ALL SELECT conv_id, 2, turn // 1000, string_agg('## Turn ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FROM conversations GROUP BY ALL
""")
def markdown_doc(t):
    """Title with front matter, contents and pages of every conversation."""
    heading = F.concat(F.lit("## Turn "), F.col("turn"), F.lit("\n\n"), F.col("text"))
    named = lambda word: F.concat(F.lit(word + " "), F.col("conv_id"))
    meta = F.create_map(F.lit("title"), named("conversation"), F.lit("pages"), F.col("pages").cast("string"))
    pages = t.conversations.withColumn("text", heading)
    return K.markdown_parts(pages, "conv_id", "turn", "text", title=named("Conversation"), metadata=meta)


@query("nonblank_lines", LINES_SQL + f"""
, shifted AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN '  ' || chr(9) ELSE ' ' || line || chr(12288) END AS line FROM lines)
SELECT doc_id, pos, {strip_sql('line')} AS line FROM shifted WHERE {strip_sql('line')} <> ''
""")
def nonblank_lines(t):
    """Lines padded with blanks, every fifth one blanked."""
    padded = F.concat(F.lit(" "), F.col("line"), F.lit("　"))
    line = F.when(F.col("pos") % 5 == 0, F.lit("  \t")).otherwise(padded)
    return S.drop_blank_text(lines(t).withColumn("line", line), "line")


@query("conf_filter", """
SELECT event_id, event_type, round(greatest(raw / 100, 0), 6) AS confidence FROM (
  SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE value / 5 END AS raw FROM events)
WHERE greatest(raw / 100, 0) >= 0.02
""")
def conf_filter(t):
    raw = F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value") / 5)
    scored = t.events.select("event_id", "event_type", S.scaled_confidence(raw).alias("confidence"))
    kept = S.min_confidence(scored, "confidence", 0.02)
    return kept.withColumn("confidence", F.round("confidence", 6))


@query("low_conf", """
SELECT event_type, count(*) AS blocks, count(*) FILTER (value / 100 < 0.5) AS low FROM events GROUP BY event_type
""")
def low_conf(t):
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(S.low_confidence(F.col("value") / 100)).alias("low"),
    )


@query("block_type", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 2 THEN 'block' WHEN 3 THEN 'paragraph' WHEN 4 THEN 'line'
  WHEN 5 THEN 'word' ELSE 'text' END AS block_type FROM lineitem
""")
def block_type(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.block_type(F.col("l_linenumber")).alias("block_type"))


@query("bbox_polygon", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS a, (l_quantity + l_linenumber * 7)::INT AS b, l_linenumber * 3 AS c,
   (l_linenumber * 3 + l_quantity)::INT AS d FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE a END::INT AS "left", CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE c END::INT AS top,
  CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE b - a END::INT AS width, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE d - c END::INT AS height,
  CASE WHEN l_linenumber % 4 = 0 THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence
FROM p
""")
def bbox_polygon(t):
    """Four corner points per line item; every fourth line lacks one."""
    a = F.col("l_quantity").cast("int")
    b = (F.col("l_quantity") + F.col("l_linenumber") * 7).cast("int")
    c = F.col("l_linenumber") * 3
    d = (c + F.col("l_quantity")).cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(point(a, c), point(b, c), point(b, d), point(a, d))
    seen = F.when(F.col("l_linenumber") % 4 == 0, F.slice(corners, 1, 3)).otherwise(corners)
    box = S.bbox_from_polygon(seen)
    return t.spread("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("bbox_corners", """
WITH c AS (SELECT vec_id, label + n AS label, n::INT AS n, embedding[4 * n + 1]::DOUBLE * 100 AS fx1, embedding[4 * n + 2]::DOUBLE * 100 AS fy1,
   embedding[4 * n + 3]::DOUBLE * 100 AS fx2, embedding[4 * n + 4]::DOUBLE * 100 AS fy2, (label + n) % 3 = 0 AS gone
   FROM embeddings, range(16) r(n))
SELECT vec_id, n, CASE WHEN gone THEN 0 ELSE trunc(fx1) END::INT AS "left", CASE WHEN gone THEN label * 30 ELSE trunc(fy1) END::INT AS top,
  CASE WHEN gone THEN 800 ELSE trunc(fx2 - fx1) END::INT AS width, CASE WHEN gone THEN 30 ELSE trunc(fy2 - fy1) END::INT AS height
FROM c
""")
def bbox_corners(t):
    """Every four numbers of a vector are the corners of a box; of every third box they are missing."""
    numbers = F.transform("embedding", lambda v: v.cast("double") * 100)
    fours = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.slice(numbers, 4 * n + 1, F.lit(4)))
    boxes = t.embeddings.select("vec_id", "label", F.posexplode(fours).alias("n", "corners"))
    label = (F.col("label") + F.col("n")).cast("bigint")
    box = S.bbox_from_corners(F.when(label % 3 != 0, F.col("corners")), label, F.lit(1.0))
    return boxes.select("vec_id", "n", box.alias("b")).select("vec_id", "n", "b.left", "b.top", "b.width", "b.height")


@query("region", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_custkey % 10 = 0 THEN NULL
  ELSE '{"left":' || (o_custkey % 10) || ',"top":' || (o_custkey % 7) || ',"width":' || (o_orderkey % 100) || ',"height":' || (o_orderkey % 50) || '}' END AS region
FROM orders
""")
def region(t):
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    left = F.when(F.col("o_orderstatus") != "O", customer % 10)
    found = S.region_or_null(left, F.when(customer % 10 != 0, customer % 7), order % 100, order % 50)
    return t.orders.select("o_orderkey", F.to_json(found).alias("region"))


def dq_rules():
    return {
        "orders": [
            V.title_rule(F.concat(F.col("o_orderpriority"), F.col("o_orderstatus"))),
            V.page_number_rule(F.col("o_custkey"), 1, 1400),
            V.page_range_rule(F.col("o_custkey"), F.col("o_orderkey")),
            V.log_level_rule(F.element_at(F.split("o_orderpriority", "-"), -1)),
        ],
        "lineitem": [
            V.confidence_rule(F.col("l_discount") * 12),
            V.positive_rule(F.col("l_linenumber") - 1),
            V.non_negative_rule(F.col("l_tax") - 0.01),
        ],
        "documents": [
            V.image_format_rule(F.col("lang")),
            V.engine_rule(F.col("source"), [f"src{i}" for i in range(15)]),
        ],
    }


@query("dq_report", """
SELECT 'title' AS rule, count(*) AS checked, count(*) FILTER (NOT length(o_orderpriority || o_orderstatus) BETWEEN 1 AND 200) AS failed FROM orders
UNION ALL SELECT 'page_number', count(*), count(*) FILTER (NOT o_custkey BETWEEN 1 AND 1400) FROM orders
UNION ALL SELECT 'page_range', count(*), count(*) FILTER (NOT (o_custkey >= 1 AND o_orderkey >= o_custkey)) FROM orders
UNION ALL SELECT 'log_level', count(*), count(*) FILTER (upper(split_part(o_orderpriority, '-', -1)) NOT IN ('DEBUG','INFO','WARNING','ERROR','CRITICAL')) FROM orders
UNION ALL SELECT 'confidence', count(*), count(*) FILTER (NOT l_discount * 12 BETWEEN 0 AND 1) FROM lineitem
UNION ALL SELECT 'positive', count(*), count(*) FILTER (NOT l_linenumber - 1 > 0) FROM lineitem
UNION ALL SELECT 'non_negative', count(*), count(*) FILTER (NOT l_tax - 0.01 >= 0) FROM lineitem
UNION ALL SELECT 'image_format', count(*), count(*) FILTER (lower(lang) NOT IN ('png','jpg','jpeg','bmp','tiff')) FROM documents
UNION ALL SELECT 'engine', count(*), count(*) FILTER (NOT regexp_full_match(source, 'src([0-9]|1[0-4])')) FROM documents
""")
def dq_report(t):
    reports = [V.rule_report(getattr(t, name), rules).drop("message") for name, rules in dq_rules().items()]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("dq_quarantine", """
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT l_discount * 12 BETWEEN 0 AND 1 THEN 'confidence' END,
   CASE WHEN l_linenumber = 1 THEN 'positive' END, CASE WHEN NOT l_tax - 0.01 >= 0 THEN 'non_negative' END) AS violations
FROM lineitem WHERE NOT (l_discount * 12 BETWEEN 0 AND 1) OR l_linenumber = 1 OR NOT (l_tax - 0.01 >= 0)
""")
def dq_quarantine(t):
    _, bad = V.split_valid(t.lineitem, dq_rules()["lineitem"])
    return bad.select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"))


@query("safe_names", r"""
SELECT event_id, coalesce(nullif(regexp_replace(regexp_replace(n, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), ''), 'untitled') AS file_name,
  regexp_replace(trim(regexp_replace(n, '[^\pL\pN _-]', '_', 'g')), ' ', '_', 'g') || '_state.json' AS state_key,
  regexp_replace(trim(regexp_replace(n, '[^\pL\pN _-]', '', 'g')), ' ', '_', 'g') AS log_key
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '...' ELSE ' .' || event_type || ' ' || props || '/é?.' END AS n FROM events)
""")
def safe_names(t):
    messy = F.concat(F.lit(" ."), F.col("event_type"), F.lit(" "), F.col("props"), F.lit("/é?."))
    name = F.when(F.col("event_id") % 11 == 0, F.lit("...")).otherwise(messy)
    return t.events.select(
        "event_id",
        V.sanitize_filename(name).alias("file_name"),
        V.state_key(name).alias("state_key"),
        V.log_key(name).alias("log_key"),
    )


@query("template", """
SELECT conv_id, turn, 'conv_' || conv_id || '/page_' || CASE WHEN turn < 10000 THEN lpad(turn::VARCHAR, 4, '0') ELSE turn::VARCHAR END || '_' || role || '.png' AS path
FROM conversations
""")
def template(t):
    path = R.fill_template(
        "conv_{book}/{file}_{role}.png",
        {"book": F.col("conv_id").cast("string"), "file": R.page_file(F.col("turn")), "role": F.col("role")},
    )
    return t.conversations.select("conv_id", "turn", path.alias("path"))


@query("nested_text", LINES_SQL + """
SELECT doc_id, trim(string_agg(replace(line, ' ', '') || chr(10), '' ORDER BY pos), ' ' || chr(10)) AS text
FROM lines GROUP BY doc_id
""")
def nested_text(t):
    """Every document as blocks (lines) of one paragraph each, of words, of characters."""
    words = lambda line: F.transform(F.split(line, " "), lambda w: F.split(w, ""))
    blocks = F.transform(F.split("text", "\n"), lambda line: F.array(words(line)))
    return t.spread("documents").select("doc_id", A.nested_text(blocks).alias("text"))


@query("book_files", """
WITH d AS (SELECT conv_id, chr(65279) || replace('---' || chr(10) || 'Title: conversation ' || conv_id || chr(10) || '---' || chr(10) || chr(10)
  || string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn), chr(10), chr(13) || chr(10)) AS t
  FROM conversations GROUP BY conv_id)
SELECT conv_id, octet_length(encode(t)) AS bytes, sha256(t) AS digest FROM d
""")
def book_files(t):
    """One file per conversation with byte order mark and Windows line ends, and its bytes read back."""
    folder = scratch_path(t.spark, "book-files")
    head = F.create_map(F.lit("Title"), F.concat(F.lit("conversation "), F.col("conv_id")))
    B.write_books(t.conversations, folder, "conv_id", "turn", "text", metadata=head, bom=True, newline="\r\n")
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return files.select(
        name.cast("bigint").alias("conv_id"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest")
    )
