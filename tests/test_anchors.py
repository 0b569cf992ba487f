"""Pages against their anchors, by brute force along the book."""

import random

import pytest

from folio_spark.operators import anchors as A


def brute(pages, threshold):
    """``{page: (anchor page, distance)}`` of one book's (page, signature) in order."""
    out, anchor = {}, None
    for page, s in sorted(pages):
        if s is None:
            out[page] = (None, None)
        elif anchor is None:
            out[page], anchor = (None, None), (page, s)
        else:
            far = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(s, anchor[1]))
            out[page] = (anchor[0], far)
            if far > threshold:
                anchor = (page, s)
    return out


def check(spark, rows, threshold, width):
    frame = spark.createDataFrame(rows, "book string, page long, s array<bigint>, distance string").repartition(5)
    got = A.anchored(frame, "book", "page", "s", threshold, width=width)
    assert got.columns == ["book", "page", "s", "anchor_page", "distance"]
    got = {(r.book, r.page): (r.anchor_page, r.distance) for r in got.collect()}
    books = {}
    for book, page, s, _ in rows:
        books.setdefault(book, []).append((page, s))
    want = {(b, p): v for b, pages in books.items() for p, v in brute(pages, threshold).items()}
    assert got == want


def test_literal(spark):
    rows = [("a", 1, [0]), ("a", 2, [0x0F]), ("a", 3, [0xF0])]
    out = A.similarity_score(spark.createDataFrame(rows, "book string, page long, s array<bigint>"), "book", "page", "s", 64)
    assert [(r.anchor_page, r.distance, r.score) for r in out.orderBy("page").collect()] == [
        (None, None, None), (1, 4, 1 - 4 / 64), (1, 4, 1 - 4 / 64),
    ]


@pytest.mark.parametrize("width", [3, 16, 4096])
def test_anchors(spark, width):
    rng = random.Random(width)
    rows = []
    near = lambda s, most: [w ^ (1 << rng.randrange(62)) if rng.random() < most else w for w in s]
    fresh = lambda: [rng.getrandbits(62), rng.getrandbits(62)]
    # One run over all chunks; noise that no summary settles; a drift; changes everywhere; gaps and missing signatures.
    one, noisy, drift = fresh(), fresh(), fresh()
    for page in range(60):
        rows.append(("same", page, one, "x"))
        rows.append(("noise", page, near(near(noisy, 0.9), 0.9), "x"))
        drift = near(drift, 0.7)
        rows.append(("drift", page, drift, "x"))
        rows.append(("changes", page, fresh(), "x"))
        rows.append((None, page * 7 + 3, [rng.randrange(8), 0] if page % 4 else None, "x"))
    rows += [("none", page, None, "x") for page in range(10)] + [("one", 5, fresh(), "x")]
    rows += [("late", p, None if p < 8 else [p // 5, 0], "x") for p in range(20)]
    for threshold in (0, 2, 3, 5):
        check(spark, rows, threshold, width)


def test_no_pages(spark):
    frame = spark.createDataFrame([], "book string, page long, s array<bigint>")
    assert A.anchored(frame, "book", "page", "s").count() == 0
