"""The registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import pytest
from harness import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folio_spark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    rows, problem = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert problem is None and rows


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13


def test_learned_queries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = docs.count()
    languages = queries.QUERIES["op3_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    held = languages.where("held_out").collect()
    assert languages.count() == n and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    scores = queries.QUERIES["op4_toxicity"](spark, FOLDER).collect()
    assert len(scores) == n and all(r.predicted == int(r.score >= 0.5) for r in scores)


def test_pipeline(spark):
    from llm.test_operators import ITEMS, brute_components, brute_contamination, brute_spans, ids_of  # noqa: F401

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # Columns of the documents' own that have the names of results stay as they are.
    own = ["score", "lang_pred", "hits", "n_hit", "base_spans", "_row", "_others", "_found"]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in own})
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept, folder = docs, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, FOLDER).persist()
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert all(r[c] == f"{c} {i}" for i, r in after.items() for c in own)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in after.values())
        if name == "near_duplicates":
            groups = brute_components([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not brute_contamination(r.text, items)[1]}
        if name == "personal_data":
            assert set(after) == set(before)
            for i, r in after.items():
                spans = brute_spans(before[i].text)
                assert r.n_chars == len(r.text) and (r.text != before[i].text or not spans)
                assert not any(before[i].text[a:b] in r.text for a, _, b in spans)
    total = sum(len(ids_of(r.text)) for r in kept.select("text").collect())
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sum(r.length for r in rows) == total and {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}


def test_near_duplicates_odd_ids(spark):
    one, two, three, four, five = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcde")
    rows = [
        (7, one), (7, one), (7, one + " x"),  # repeated and near rows of one id
        (None, two), (None, two), (3, two),  # copies without an id beside one that has an id
        (None, three), (None, three),  # no copy has an id
        (9, four), (2, four), (9, five),  # an id shared by a copy and a text of its own
        (None, "no window"), (4, None),
    ]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place long")
    kept = corpus_pipeline.near_duplicates(spark, docs.repartition(3), FOLDER)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    groups = [(2, four), (3, two), (7, one), (9, five), (None, three), (None, "no window"), (4, None)]
    assert [r for r in found if r[0] != 7] == sorted((g for g in groups if g[0] != 7), key=repr)
    assert len([r for r in found if r[0] == 7]) == 1
