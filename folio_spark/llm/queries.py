"""One query per operator over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio_spark.llm import (
    audit, decontam, fim, jaccard, langid, licenses, packing, pii, tokenfile, topk, toxicity, urls, warc,
)
from folio_spark.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
END_ID = 1
CAPACITY = 4096


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def joined_ids(ids: Column) -> Column:
    """Hexadecimal SHA-256 of ids sorted as strings."""
    return F.sha2(F.array_join(F.array_sort(ids.cast("array<string>")), ","), 256)


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
CONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(w), 10) AS l, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT l FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS win
  FROM d, lengths, unnest(generate_series(1, len(w) - l + 1)) t(i) WHERE len(w) >= l),
found AS (SELECT doc_id, i, l, item_id FROM doc_windows JOIN item_windows USING (win, l)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(generate_series(i, i + l - 1)) t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontamination", CONTAMINATION_SQL)
def contamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        joined_ids(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_tokenizer(), END_ID, CAPACITY)


@query("op7_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark, "token-files")
    tokenfile.write_tokens(table(spark, folder, "documents"), files, word_tokenizer(), END_ID)
    return tokenfile.read_tokens(spark, files).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op9_warc", WARC_SQL)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    archive = shared_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), archive)
    return warc.read_records(spark, archive).drop("url", "payload")


# The tables have neither lists nor fetch times, so both are derived from them: a page was fetched at
# a second of January 2024 that its id gives; an event is a dated report on the page whose id is its
# user's. Errors and purchases put the page's host, or its first path segment, on the block list and
# on the allow list; views take it off the block list and logins off the allow list.
FIRST_SECOND, SECONDS, STEP = 1704067200, 30 * urls.DAY, 7919
URL_FILTER_SQL = rf"""
WITH p AS (
  SELECT page_id, url, make_timestamp((({FIRST_SECOND} + (page_id * {STEP}) % {SECONDS}) * 1000000)::BIGINT) AS fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'),
                     lambda s: s <> '') AS segments
  FROM pages),
e AS (
  SELECT CASE WHEN event_type IN ('error', 'view') THEN 'block' ELSE 'allow' END AS list,
         CASE WHEN event_id % 2 = 0 OR len(segments) = 0 THEN host ELSE host || '/' || segments[1] END AS pattern,
         event_type IN ('error', 'purchase') AS added, ts AS since, event_id AS seq
  FROM events JOIN p ON user_id = page_id),
one AS (
  SELECT list, pattern, since, arg_max(added, seq) AS added FROM e
  WHERE since IS NOT NULL AND pattern IS NOT NULL GROUP BY ALL),
iv AS (
  SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS valid_to FROM one),
asked AS (
  SELECT page_id, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1),
      lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(segments) + 1),
      lambda i: host || '/' || array_to_string(list_slice(segments, 1, i), '/')))) AS pattern
  FROM p WHERE host IS NOT NULL),
active AS (
  SELECT page_id, list, pattern FROM asked JOIN iv USING (pattern)
  WHERE added AND since <= fetched AND (valid_to IS NULL OR fetched < valid_to)),
found AS (
  SELECT page_id, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow,
         arg_max(pattern, (length(pattern), pattern, list = 'block')) AS rule,
         arg_max(list = 'block', (length(pattern), pattern, list = 'block')) AS blocked
  FROM active GROUP BY page_id)
SELECT page_id, coalesce(n_block, 0)::BIGINT AS n_block, coalesce(n_allow, 0)::BIGINT AS n_allow, rule,
       coalesce(blocked, false) AS blocked
FROM p LEFT JOIN found USING (page_id)
"""


@query("op10_url_filters", URL_FILTER_SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    events = table(spark, folder, "events")
    second = F.lit(FIRST_SECOND) + F.pmod(F.col("page_id") * STEP, F.lit(SECONDS))
    captures = pages.withColumn("fetched", F.timestamp_seconds(second))
    segments = urls.path_of(F.col("url"))
    kind = F.col("event_type")
    pattern = F.when(
        (F.col("event_id") % 2 == 0) | (F.size(segments) == 0), urls.host_of(F.col("url"))
    ).otherwise(F.concat_ws("/", urls.host_of(F.col("url")), segments[0]))
    entries = events.join(pages, F.col("user_id") == F.col("page_id")).select(
        F.when(kind.isin("error", "view"), "block").otherwise("allow").alias("list"),
        pattern.alias("pattern"),
        kind.isin("error", "purchase").alias("added"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )
    return urls.judge(captures, entries).select("page_id", "n_block", "n_allow", "rule", "blocked")


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {UPPER_LOWER}),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS s
  FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT reached.doc_id, y FROM reached JOIN ways ON other = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


@query("op8_jaccard_join", JACCARD_SQL)
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_components(table(spark, folder, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op6_top_k", TOP_K_SQL)
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder of the CRC-32 of an id written out; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


@query("op3_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.learn(docs, ~held_out)
    return langid.label(docs.select("doc_id", "text"), model, spans=False).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query("op4_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    classifier, _ = toxicity.learn(docs, table(spark, folder, "labels"), lambda doc_id: fold(doc_id, 5) != 0)
    return toxicity.score(docs, classifier).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


@query("op1_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = pii.annotate(docs, pii.learn(docs))

    def count(number: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(pii.KINDS)]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(pii.shown(F.col("base_spans")), 256).alias("base_sha256"),
        pii.shown(F.col("pii_spans")).alias("spans"),
    )


FILL_IN_MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || substr(hex, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(hex, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(hex, 17, 8))::BIGINT % 100 AS plain, ('0x' || substr(hex, 25, 8))::BIGINT % 100 AS turned FROM d),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR plain >= 90 THEN 'plain'
                 WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form,
         '<P>' || substr(t, 1, least(a, b)) AS p, '<M>' || substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
         '<S>' || substr(t, greatest(a, b) + 1) AS s FROM h)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN least(a, b) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN p || s || m WHEN 'spm' THEN s || p || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


@query("op11_fill_in_middle", FILL_IN_MIDDLE_SQL)
def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


AUDIT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, doc_id, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN l USING (doc_id) GROUP BY ALL),
made(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM made, unnest(['A', 'B', 'C', 'D', 'E']) t(f) WHERE NOT contains(o, f)),
steps AS (
  SELECT o, step, 1 << (ascii(substr(o, step, 1)) - 65) AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INT AS before
  FROM made, unnest(range(1, 6)) t(step) WHERE length(o) = 5),
counts AS (
  SELECT part, o, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counts
"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    filters = audit.text_filters()
    cells = audit.mask_cells(table(spark, folder, "documents"), table(spark, folder, "labels"), filters)
    return audit.audit(cells, "".join(filters) + "E")


@query("op13_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
