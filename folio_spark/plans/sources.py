"""How the given tables stand in for books, ledgers, lines, blocks and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_by_range
from .registry import Tables

# The same stand-ins as SQL, to be put in front of a checking query.
LEDGER_SQL = """
WITH ledger AS (
  SELECT user_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page,
         event_type = 'error' AS failed
  FROM events)
"""
LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents)
"""
PAGES_PER_BOOK = 70


def ledger(tables: Tables) -> DataFrame:
    """Events as a run ledger: one book per user, pages in time order."""
    events = tables.events.select("user_id", "event_id", "ts", "event_type", "value")
    numbered = number_by_range(events, "user_id", ["ts", "event_id"])
    return numbered.withColumn("failed", F.col("event_type") == "error")


def lines(tables: Tables) -> DataFrame:
    """Documents as books whose pages are their lines, numbered from 0."""
    split = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    return tables.documents.select("doc_id", split).withColumn("pos", F.col("pos").cast("bigint"))
