"""Joining a per-key table to rows without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_by_chunk(
    rows: DataFrame, per_key: DataFrame, keys: list[str], chunk: dict[str, Column], how: str = "inner"
) -> DataFrame:
    """Join rows to a table with at most one row per ``keys``.

    A plain join hashes the rows by ``keys``, so a key holding a third of them
    becomes one task, and a later aggregation by any wider key is planned without
    a shuffle on top of it. Here the per-key rows are first repeated for every
    chunk of rows that exists, and the join key is ``keys`` plus chunk. Only the
    chunk list, one row per chunk, meets the table by ``keys`` alone. ``chunk``
    names expressions over the row that cut a key's rows into bounded pieces.
    """
    names = list(chunk)
    marked = rows.withColumns(chunk)
    pieces = marked.select(*keys, *names).distinct()
    repeated = pieces.join(per_key, keys)
    return marked.join(repeated, [*keys, *names], how).drop(*names)


def salted_join(
    rows: DataFrame, per_key: DataFrame, key: str | list[str], deal: str | Column, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join rows to a table with one row per key, each key's rows dealt to ``salts`` tasks by ``deal``.

    Unlike ``join_by_chunk`` the rows are read once. The table is repeated, so it should have far fewer
    and narrow rows; ``deal`` differs among the rows of a key. Adaptive skew joins split what is still large.
    """
    keys = [key] if isinstance(key, str) else key
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def uneven_join(rows: DataFrame, per_key: DataFrame, key: str, deal: str, heavy: Column) -> DataFrame:
    """Inner join to a table with about as many keys as there are rows, of which few are ``heavy``.

    Only the heavy keys are repeated for a salted join; the rows that it leaves meet the others by key.
    """
    names = [c for c in per_key.columns if c != key]
    marked = salted_join(rows, per_key.where(heavy).withColumn("_heavy", F.lit(True)), key, deal, "left")
    light = marked.where(F.col("_heavy").isNull()).select(*rows.columns)
    met = light.join(per_key.where(~heavy), key)
    return marked.where("_heavy").select(*rows.columns, *names).unionByName(met.select(*rows.columns, *names))
