"""Queries of value rules, encodings, time stamps, layouts and switches, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators import extract as E
from ..operators import quality as V
from ..operators import select as S
from ..sources import sinks as K
from .pages import clean_sql, strip_sql
from .registry import query


@query("dq_membership", """
WITH v AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE ['PNG', ' jpg', 'JPeG', 'bmp ', 'tiff', 'gif', ''][user_id % 7 + 1] END AS f,
    CASE WHEN event_id % 3 = 1 THEN event_type ELSE ['Yomitoku', ' TESSERACT ', 'other'][user_id % 3 + 1] END AS e,
    CASE WHEN event_id % 3 = 2 THEN event_type ELSE ['debug', 'Info', ' WARNING', 'critical', 'trace'][user_id % 5 + 1] END AS l FROM events)
SELECT event_id, lower(trim(f)) IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff') AS format_ok,
  lower(trim(e)) IN ('yomitoku', 'tesseract') AS engine_ok,
  upper(trim(l)) IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL') AS level_ok FROM v
""")
def dq_membership(t):
    """Values in any letter case and with blanks around, accepted and refused, with the default lists."""

    def value(other, *names):
        own = F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % len(names) + 1).cast("int"))
        return F.when(F.col("event_id") % 3 == other, F.col("event_type")).otherwise(own)

    rules = {
        "format_ok": V.image_format_rule(value(0, "PNG", " jpg", "JPeG", "bmp ", "tiff", "gif", "")),
        "engine_ok": V.engine_rule(value(1, "Yomitoku", " TESSERACT ", "other")),
        "level_ok": V.log_level_rule(value(2, "debug", "Info", " WARNING", "critical", "trace")),
    }
    return t.events.select("event_id", *[(~rule.broken).alias(name) for name, rule in rules.items()])


@query("iso_stamps", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS micros FROM events
""")
def iso_stamps(t):
    """Time stamps as text and read back; of every fifth the text is broken."""
    iso = R.to_iso(F.col("ts"))
    text = F.when(F.col("event_id") % 5 == 0, F.replace(iso, F.lit("T"), F.lit("?"))).otherwise(iso)
    return t.events.select("event_id", iso.alias("iso"), F.unix_micros(R.iso_timestamp(text)).alias("micros"))


@query("output_switches", rf"""
WITH n AS (SELECT doc_id, replace(text, '. ', '.  ' || chr(9) || chr(12288)) || chr(10) || chr(10) || ' tail ' AS t FROM documents),
c AS (SELECT doc_id, {clean_sql('t')} AS cleaned, t FROM n)
SELECT doc_id, {strip_sql(r"regexp_replace(regexp_replace(t, '\n+', ' ', 'g'), '[ \t\x{3000}]+', ' ', 'g')")} AS one_line,
  regexp_replace(t, '\n+', ' ', 'g') AS loose, cleaned FROM c
""")
def output_switches(t):
    """The output switches all on but line breaks, and all off."""
    noisy = F.concat(F.replace("text", F.lit(". "), F.lit(".  \t　")), F.lit("\n\n tail "))
    return t.spread("documents", "doc_id", "text").select(
        "doc_id",
        X.output_text(noisy, preserve_linebreaks=False).alias("one_line"),
        X.output_text(noisy, preserve_linebreaks=False, trim_whitespace=False, normalize_spaces=False).alias("loose"),
        X.clean_text(noisy).alias("cleaned"),
    )


@query("single_block", """
SELECT conv_id, turn, 1 AS blocks, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS text, 0 AS "left", 0 AS top, 800 AS width, 600 AS height,
  CASE WHEN turn % 3 = 0 OR text = '' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, 'text' AS block_type, false AS is_bold FROM conversations
""")
def single_block(t):
    """The layout of an engine that knows none; of every third page it found no text."""
    text = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))
    pages = t.conversations.select("conv_id", "turn", E.single_block_layout(text).alias("blocks"))
    block = F.col("blocks")[0]
    box = block["bounding_box"]
    return pages.select(
        "conv_id", "turn", F.size("blocks").alias("blocks"), block["text"].alias("text"),
        *[box[side].alias(side) for side in ("left", "top", "width", "height")],
        block["confidence"].cast("double").alias("confidence"), block["block_type"].alias("block_type"),
        block["is_bold"].alias("is_bold"),
    )


@query("engine_sets", """
WITH registered AS (SELECT DISTINCT source AS engine FROM documents), present AS (SELECT DISTINCT source AS engine FROM documents WHERE lang <> 'en'),
preferred AS (SELECT DISTINCT source AS engine FROM documents WHERE doc_id % 50 = 0)
SELECT 'usable' AS kind, engine FROM (SELECT * FROM registered INTERSECT SELECT * FROM present)
UNION ALL SELECT 'extra', engine FROM (SELECT * FROM registered EXCEPT SELECT * FROM preferred)
""")
def engine_sets(t):
    """Sources as engines: those present beside those registered, and those registered but not preferred."""
    named = lambda df: df.select(F.col("source").alias("engine"))
    registered = named(t.documents)
    usable = E.usable_engines(registered, named(t.documents.where("lang <> 'en'")))
    extra = E.extra_engines(registered, named(t.documents.where("doc_id % 50 = 0")))
    kind = lambda name: F.lit(name).alias("kind")
    return usable.select(kind("usable"), "engine").unionByName(extra.select(kind("extra"), "engine"))


@query("encoded_text", """
SELECT conv_id, turn, sha256(chr(65279) || replace(text, chr(10), chr(13) || chr(10))) AS marked, sha256(text) AS plain,
  2 * length(text) + 2 * len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS wide FROM conversations
""")
def encoded_text(t):
    """Bytes with byte order mark and Windows line ends, plain ones, and the length in 16-bit units."""
    text = F.col("text")
    return t.conversations.select(
        "conv_id", "turn",
        F.sha2(K.encoded(text, "utf-8-sig", newline="\r\n"), 256).alias("marked"),
        F.sha2(K.encoded(text), 256).alias("plain"),
        F.octet_length(K.encoded(text, "utf-16le")).cast("bigint").alias("wide"),
    )


@query("known_fields", """
SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders
""")
def known_fields(t):
    """Updates of fields that the table has; the unknown one is ignored, the stamp is set (not compared)."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    updates = {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1, "nowhere": F.lit(1)}
    out = S.project_known_fields(rows, updates)
    return out.where("last_update IS NOT NULL").drop("last_update")
