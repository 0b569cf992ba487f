"""Queries over signatures: text fingerprints and groups of like pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as M
from .registry import query

FINGERPRINT_SQL = r"""
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS b
  FROM w),
h AS (SELECT doc_id, list_transform(b, lambda x: ('0x' || substr(md5(x), 1, 16))::UBIGINT) AS h FROM b),
bits AS (
  SELECT doc_id, CASE WHEN len(h) > 0 THEN array_to_string(list_transform(range(0, 64), lambda i:
    CASE WHEN 2 * list_sum(list_transform(h, lambda x: ((x >> i::UBIGINT) & 1::UBIGINT)::INT)) > len(h) THEN '1' ELSE '0' END), '') END
    AS bits FROM h)
"""


def fingerprints(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", M.text_fingerprint(F.col("text")).alias("signature"))


@query("text_fingerprint", f"WITH {FINGERPRINT_SQL} SELECT doc_id, bits FROM bits")
def text_fingerprint(t):
    """Shown as a string of bits, lowest first; null for a document without words."""
    return fingerprints(t).select("doc_id", M.bit_text(F.col("signature"), 64).alias("bits"))


@query("near_dups", f"""
WITH RECURSIVE {FINGERPRINT_SQL},
ways AS (SELECT a.doc_id AS x, b.doc_id AS y FROM bits a JOIN bits b ON a.doc_id <> b.doc_id AND hamming(a.bits, b.bits) <= 5),
reached(x, y) AS (SELECT doc_id, doc_id FROM bits UNION SELECT reached.x, ways.y FROM reached JOIN ways ON reached.y = ways.x),
grouped AS (SELECT x AS doc_id, min(y) AS group_id, count(*) AS n_members FROM reached GROUP BY x)
SELECT g.doc_id, g.group_id, g.n_members, hamming(a.bits, b.bits) AS distance
FROM grouped g JOIN bits a ON a.doc_id = g.doc_id JOIN bits b ON b.doc_id = g.group_id
""")
def near_dups(t):
    """Documents whose fingerprints differ in at most five bits, as groups."""
    return M.near_groups(fingerprints(t), "doc_id", "signature", bits=64, threshold=5)
