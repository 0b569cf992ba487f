"""Fill-in-middle, filter audit and licence scan: odd cases against brute force, and the registered queries."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from harness import compare
from pyspark.sql import functions as F

from folio_spark.llm import audit, fim, licenses, queries

FOLDER = "/root/testdata/sf0.001"
RNG = random.Random(11)
LONG = "".join(RNG.choice(["é", "a", " ", "\n", "日本", "🙂", "word "]) for _ in range(200_000))
TEXTS = [
    None, "", " ", "a", "é", "日本語テキスト", "🙂🙃", "line one\nline two\n\n  three", "has <P> inside", "<S>", "x<M", "\n\n",
    LONG, LONG, "word " * 300, "tabs\tand\x0bfeeds\x0c" * 9,
]
SCHEMA = "doc_id long, text string, lang string, Output string, form int, _draws string, places int, N int, words string, digest int"


def rows_of(texts):
    rows = [(i, t, "en", "mine", 7, "own", 1, 2, "w", 3) for i, t in enumerate(texts)]
    return rows + [(None, "no id at all", None, *[None] * 7), (3, "a", "en", "mine", 7, "own", 1, 2, "w", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3).persist()


# ---------------------------------------------------------------- fill-in-middle


def test_wavelet_matrix():
    for size in (0, 1, 63, 64, 65, 1000):
        values = np.random.default_rng(size).integers(0, 6, size).astype("u1")
        matrix, places = fim.WaveletMatrix(values), np.arange(size + 1)
        for value in range(8):
            assert matrix.rank(value, places).tolist() == [int((values[:p] == value).sum()) for p in places]
        ones = np.flatnonzero(np.isin(values, (1, 2)))
        numbers = np.arange(len(ones) + 2)
        begins = matrix.begin_of((1, 2), np.zeros_like(numbers), np.full_like(numbers, size), numbers)
        assert begins.tolist() == ones.tolist() + [size] * 2


def brute_starts(text, unit):
    """Code points at which units begin."""
    if unit == "character":
        return list(range(len(text)))
    if unit == "line":
        return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
    space = "\t\n\x0b\x0c\r "
    return [i for i in range(len(text)) if text[i] not in space and (i == 0 or text[i - 1] in space)]


def brute_fim(doc_id, text, unit="character", seed=1):
    text = text or ""
    starts = brute_starts(text, unit)
    n = len(starts)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y = (starts[k] if k < n else len(text) for k in (one, two))
    p, m, s = "<P>" + text[:x], "<M>" + text[x:y], "<S>" + text[y:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", x, y - x, s + p + m if spm else p + s + m


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_fill_in_middle(docs, unit):
    made = fim.fill_in_middle(docs, unit=unit)
    kept = ["doc_id", "text", "lang", "_draws", "places", "words", "digest"]
    assert made.columns == kept + ["n", "form", "prefix_chars", "middle_chars", "output"]
    again = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(again) == len(TEXTS) + 2
    for r in again:
        expected = brute_fim(r.doc_id, r.text, unit)
        assert (r["n"], r["form"], r.prefix_chars, r.middle_chars, r["output"]) == expected
        assert r.again == (r.text or "") and r["_draws"] in ("own", None)


def test_fill_in_middle_empty(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuts_of_many_short_texts(spark):
    texts = ["".join(RNG.choice("aé日🙂 \n<PSM>") for _ in range(RNG.randrange(12))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in fim.fill_in_middle(frame).collect():
        assert (r["n"], r["form"], r.prefix_chars, r.middle_chars, r["output"]) == brute_fim(r.doc_id, r.text)


# ---------------------------------------------------------------- filter interaction audit


def brute_audit(rows, labels):
    """Rows (doc_id, lang, text) through every order of the filters, one document after the other."""
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails, parts = [], sorted({lang or "" for _, lang, _ in rows})
    for i, lang, text in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        own = "".join(
            letter
            for letter, bad in (
                ("A", len(words) < 200),
                ("B", 100 * len(set(words)) < 50 * len(words)),
                ("C", 100 * capitals > 3 * len(text)),
                ("D", any(c in text for c in "#$%&*|")),
                ("E", i is not None and i > least[text]),
            )
            if bad
        )
        fails.append((lang or "", own, i in good, i in toxic))
    out, shares = {}, {}
    for order in itertools.permutations("ABCDE"):
        for part in parts:
            own = [f for f in fails if f[0] == part]
            alive = list(own)
            for step, letter in enumerate(order):
                lost = [f for f in alive if letter in f[1]]
                gone = [f for f in own if letter in f[1] and f not in alive]
                alive = [f for f in alive if letter not in f[1]]
                key = (part, letter)
                shares[key] = shares.get(key, 0) + len(lost)
                out[part, "".join(order), step + 1] = (
                    len(alive), len(lost), len(gone), sum(f[1] == letter for f in own),
                    sum(f[2] for f in lost), sum(f[3] for f in lost),
                )
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(frame):
    names = (*audit.COUNTS, "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in frame.collect()}


def test_audit(spark):
    fine = " ".join(f"word{i}" for i in range(250))
    texts = [
        None, "", fine, fine, fine + " #", "A B C " * 100, "Few Words", fine.upper(), "w " * 250, fine + " x", "x\x0by\x0cz",
    ]
    rows = [(i, RNG.choice(["en", "de", None, ""]), RNG.choice(texts)) for i in range(120)]
    rows += [(None, "en", fine), (None, None, fine), (5, "en", rows[5][2]), (5, "de", "another text"), (-1, "fr", fine)]
    labels = [(i, RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    more = [(*r, "x", "y", 1) for r in rows]
    docs = spark.createDataFrame(more, "doc_id long, lang string, text string, words string, digest string, mask int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3)
    filters = audit.text_filters()
    found = audit_rows(audit.audit(audit.mask_cells(docs.repartition(4), table, filters), "ABCDE"))
    assert found == brute_audit(rows, labels)
    none = audit.mask_cells(docs.limit(0), table, filters)
    assert audit.audit(none, "ABCDE").count() == 0


def test_audit_of_other_filters(spark):
    rows = [(1, "a", "one two"), (2, "a", "one"), (3, "a", "one"), (4, "a", "#")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = audit.mask_cells(docs, labels, {"X": F.size("words") < 2})
    found = audit_rows(audit.audit(cells, "XE"))
    assert found[("a", "XE", 1)][:3] == (1, 3, 0) and found[("a", "XE", 2)][:3] == (1, 0, 1)
    assert found[("a", "EX", 1)][:3] == (3, 1, 0) and found[("a", "EX", 2)] == (1, 2, 1, 2, 0, 0, 5)


def test_audit_broadcasts_no_table(spark, tmp_path):
    """Labels and first ids grow with the texts; their size is guessed without the salted copies."""
    docs = spark.createDataFrame([(i, f"text {i % 90}", "en") for i in range(100)], "doc_id long, text string, lang string")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    labels = spark.read.parquet(f"{tmp_path}/labels")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 * 2**20
    cells = audit.mask_cells(docs, labels, audit.text_filters())
    assert sorted((r.n, r.good, r.toxic) for r in cells.collect()) == [(10, 10, 0), (90, 90, 0)]
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.split("== Initial Plan ==")[0].count("SortMergeJoin") == 2


def test_audit_reads_texts_once(spark):
    """What is joined and counted is a narrow table: no text, and no scan of the documents, is left in the plan."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = audit.mask_cells(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), audit.text_filters())
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in shown and "digest" in shown


# ---------------------------------------------------------------- licence scan


def brute_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(words):
    found = []
    for phrase, label in (
        ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
    ):
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return sorted(found)


def brute_notices(words, idf, share=licenses.SHARE, slop=licenses.SLOP):
    """Every start of every notice: label to greatest share of IDF."""
    best = {}
    for label, text, keys in licenses.NOTICES:
        own = brute_words(text)
        n, missing = len(own), len(own) - math.ceil(share * len(own) - 1e-9)
        for s in range(-missing, len(words) - n + missing + 1):
            here = [w in words[max(0, s + q - slop) : max(0, s + q + slop + 1)] for q, w in enumerate(own)]
            if here.count(False) > missing:
                continue
            a, b = s - slop, s + n + slop
            if all(
                any(words[i : i + len(k)] == k for i in range(max(0, a), min(b - len(k), len(words)) + 1))
                for k in map(brute_words, keys)
            ):
                weight = sum(idf[w] for w, h in zip(own, here) if h) / sum(idf[w] for w in own)
                best[label] = max(best.get(label, 0), weight)
    return best


def brute_scan(texts):
    held = [set(brute_words(t)) for t in texts]
    vocabulary = {w for t in [*licenses.PHRASES, *(n[1] for n in licenses.NOTICES)] for w in brute_words(t)}
    vocabulary |= {w for n in licenses.NOTICES for k in n[2] for w in brute_words(k)}
    idf = {w: math.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1 for w in vocabulary}
    out = []
    for text in texts:
        words = brute_words(text)
        base, notices = brute_base(words), brute_notices(words, idf)
        score = 1.0 if base else max(notices.values(), default=0.0)
        own = {label for _, label in base}
        out.append((len(words), base, sorted(own), sorted(own | set(notices)), round(score, 9)))
    return out


def licence_texts():
    texts = [
        None, "", "...", "MIT License", "the mit\nLICENSE and mit license, mit-license", "cc by cc by", "gnu general public",
        "MIT Licenses", "é mit license ü", "licenseé mit", "CC-BY-SA 4.0 and Apache  License!", "mit " * 2000,
        "license " * 3000, "cc by " * 2000, "apache license version 2 0",
    ]
    notices = [n[1] for n in licenses.NOTICES]
    for notice in notices:
        words = notice.split()
        texts += [notice, "Copyright. " + notice.upper() + " Thanks."]
        for _ in range(4):
            own = list(words)
            for _ in range(RNG.randrange(1, 4)):
                at = RNG.randrange(len(own))
                own[at : at + 1] = RNG.choice([[], ["zz"], [own[at], "zz"]])
            texts.append("filler " * RNG.randrange(3) + " ".join(own))
        texts.append(" ".join(words[: len(words) // 2]))
    texts.append((" ".join(f"w{i}" for i in range(200_000))) + " Permission is hereby granted MIT License")
    return texts + texts[3:5]


def test_licenses(spark):
    texts = licence_texts()
    rows = [(i, t, "mine", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Labels string, score int").repartition(3)
    found = licenses.scan(docs)
    assert found.columns[:2] == ["doc_id", "text"] and len(found.columns) == 7
    expected = brute_scan(texts)
    rows = {r.doc_id: r for r in found.collect()}
    for i, (n, base, base_labels, labels, score) in enumerate(expected):
        r = rows[i]
        assert (r.n_words, [(p.start, p.label) for p in r.places]) == (n, base), texts[i]
        assert (r.base_labels, r["labels"], round(r["score"], 9)) == (base_labels, labels, score), texts[i][:200]
    # The method adds labels to those of the phrases, and leaves clean texts alone.
    assert any(set(r["labels"]) - set(r.base_labels) for r in rows.values())
    assert not rows[1]["labels"] and rows[7]["score"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_of_long_text():
    """A text of many blocks: no word is cut, no phrase is lost at a border."""
    templates = licenses.Templates()
    text = b"The MIT License, " * 300_000
    file = licenses.File(text, templates.words)
    assert len(file.ids) == 900_000
    start, _ = file.starts(templates.all[3], templates.idf)
    assert len(start) == 300_000 and start[0] == 1 and start[-1] == 899_998


def test_registered_license_scan(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_scan([r.text for r in docs])
    rows = {r.doc_id: r for r in queries.QUERIES["op13_license_scan"](spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    for doc, (n, base, base_labels, labels, score) in zip(docs, expected):
        r = rows[doc.doc_id]
        places = [p for p, _ in base]
        ends = (min(places, default=None), max(places, default=None))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), *ends)
        assert (r.base_labels, r["labels"]) == (",".join(base_labels), ",".join(labels))
        assert abs(r["score"] - score) < 1e-6


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_filter_audit"])
def test_odd_tables_against_sql(spark, tmp_path, name):
    """The registered queries and their SQL on a table of odd rows."""
    rows = [(i, t, RNG.choice(["en", None, ""])) for i, t in enumerate(TEXTS + TEXTS)]
    rows += [(None, "no id", "en"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas().astype({"doc_id": "Int64"}).to_parquet(
        tmp_path / "documents.parquet"
    )
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").toPandas().to_parquet(tmp_path / "labels.parquet")
    count, problem = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], str(tmp_path))
    assert problem is None and count
