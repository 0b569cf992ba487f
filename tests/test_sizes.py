"""What keeps tasks, reads and calls bounded as tables grow."""

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__  # noqa: F401  (registers the queries)
from folio_spark.operators import grid as G
from folio_spark.operators import similar as M
from folio_spark.plans.registry import QUERIES, Tables
from folio_spark.streaming import watch


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of a single row group is read by one task, and worked on by as many as it has pieces."""
    rows = [(i, f"text {i}. " * 20) for i in range(500)]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    size = (tmp_path / "documents.parquet").stat().st_size
    table = Tables(spark, str(tmp_path))
    many = table.spread("documents", "doc_id", "text", piece=200)
    assert many.rdd.getNumPartitions() == max(8, -(-size // 200))
    assert sorted(map(tuple, many.collect())) == rows
    assert QUERIES["output_switches"](spark, str(tmp_path)).rdd.getNumPartitions() >= 8


def test_nearest_sends_a_cell_once(spark):
    """Cells are combined before they are enlarged; one that comes twice counts with its mean."""
    cells = [("a", y, x, float(3 * y + x)) for y in range(2) for x in range(3)] + [("a", 0, 0, 10.0), (None, 0, 0, 1.0)]
    grid = spark.createDataFrame(cells, "gid string, y int, x int, v double").withColumns({"h": F.lit(2), "w": F.lit(3)})
    out = G.resize(grid, 2.0, "nearest")
    assert plan(out).count("Exchange hashpartitioning") == 1
    got = {(r.gid, r.y, r.x): r.v for r in out.collect()}
    want = {("a", y, x): 5.0 if y < 2 and x < 2 else float(3 * (y // 2) + x // 2) for y in range(4) for x in range(6)}
    assert got == want | {(None, y, x): 1.0 for y in range(2) for x in range(2)}


def test_signatures_are_made_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(i, f"some words of text {i % 3}") for i in range(30)], "id long, t string").write.parquet(path)
    texts = spark.read.parquet(path).select("id", M.text_fingerprint(F.col("t")).alias("s"))
    groups = M.near_groups(texts, "id", "s")
    assert "FileScan" not in plan(groups) and groups.count() == 30


class Store:
    """A state variable that counts the calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = given[0]
            elif name == "clear":
                self.value, self.map = None, {}
            elif name == "containsKey":
                return given[0] in self.map
            elif name == "getValue":
                return self.map[given[0]]
            elif name == "updateValue":
                self.map[given[0]] = given[1]
            elif name == "removeKey":
                self.map.pop(given[0], None)

        return call


class Handle:
    """Gives the same state variables whenever an operator is made again."""

    def __init__(self):
        self.stores = {}

    def getValueState(self, name, *_):
        return self.stores.setdefault(name, Store())

    getListState = getMapState = getValueState


def test_round_trips_of_a_watch():
    """A chunk and a book cost one read and one write of the state a batch, and pages out of order still count."""
    rule, texts = watch.Repeats(3), [b"a", b"b", b"c", b"c", b"d", b"d", b"d"]
    states = {}

    def touch(operator, key, rows):
        handle = states.setdefault(key, Handle())
        operator.init(handle)
        before = sum(s.calls for s in handle.stores.values())
        out = list(operator.handleInputRows(key, iter(rows), None))
        return out, sum(s.calls for s in handle.stores.values()) - before

    ends = []
    for batch, pages in enumerate([[0, 1], [4, 5, 6], [3], [2]]):
        summaries = []
        for number in sorted({n for p in pages for n in (p // 4, (p + 1) // 4)}):
            rows = [Row(page=p, content=texts[p]) for p in pages if number in (p // 4, (p + 1) // 4)]
            out, calls = touch(watch.ChunkOfPages(["book"], T.BinaryType(), rule, 0, 4, None), ("x", number), rows)
            assert calls == 2
            summaries += out
        out, calls = touch(watch.BookOfChunks(["book"], rule, 0, 4, None), ("x",), [r.asDict(True) for r in summaries])
        assert calls == 2 or batch
        ends += [r.end for r in out]
    assert ends == [6]
