"""Codebooks, URL filters and whitening against brute force and SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeloom.llm import codebooks, queries, urls, whitening

DATA = "/root/testdata/sf0.001"


def table(spark, vectors, ids=None, labels=None):
    rows = [(i if ids is None else ids[i], None if labels is None else labels[i], v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def brute_force(x, parts, entries, rounds):
    """Plain Lloyd rounds with Python integers."""
    cut = [p * len(x[0]) // parts for p in range(parts + 1)]
    pieces = [[row[a:b] for row in x] for a, b in zip(cut, cut[1:])]
    books = [[list(v) for v in piece[:entries]] for piece in pieces]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda j: (far(v, book[j]), j))
    for _ in range(rounds):
        for piece, book in zip(pieces, books):
            own = [nearest(v, book) for v in piece]
            for j in range(len(book)):
                if mine := [v for v, o in zip(piece, own) if o == j]:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine)]
    codes = [[nearest(v, book) for v in piece] for piece, book in zip(pieces, books)]
    error = [sum(far(piece[i], book[code[i]]) for piece, book, code in zip(pieces, books, codes)) for i in range(len(x))]
    digest = hashlib.sha256(",".join(str(c) for book in books for v in book for c in v).encode()).hexdigest()
    return [list(c) for c in zip(*codes)], error, digest


def floored(vectors, factor=1024):
    return [[math.floor(factor * c) for c in v] for v in vectors]


@pytest.mark.parametrize("kind", ["noise", "clusters", "ties", "huge"])
def test_codebooks_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "noise":
        vectors = rng.normal(0, 1, (300, 8))
    elif kind == "clusters":
        vectors = rng.normal(0, 5, (12, 8))[rng.integers(0, 12, 300)] + rng.normal(0, 0.05, (300, 8))
    elif kind == "ties":
        vectors = rng.integers(-2, 3, (300, 8)) / 1024
    else:
        vectors = rng.normal(0, 1, (120, 8)) * 10.0 ** rng.integers(0, 14, (120, 1))
    coded, known = codebooks.compress(table(spark, vectors.tolist()), entries=32, group=4)
    got = {r.vec_id: r for r in coded.collect()}
    codes, error, digest = brute_force(floored(vectors.tolist()), 4, 32, 4)
    assert [list(got[i].code) for i in range(len(vectors))] == codes
    assert [got[i].error for i in range(len(vectors))] == [min(e, (1 << 63) - 1) for e in error]
    assert known.digest(8) == digest
    if kind == "clusters":
        # The bounds spare most distances once entries settle.
        assert known.scanned[-1] < known.scanned[0] / 4


def test_codebooks_of_odd_rows(spark):
    vectors = [[0.5] * 8, None, [0.25, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [0.5] * 8, [1.0] * 8, [0.1, 0.2, 0.3], [], [0.5] * 8]
    ids = [None, 1, 2, 3, 4, 7, 5, 9, 10, 7]
    labels = [1, 1, 1, 1, 1, None, None, 2, 2, 2]
    coded, known = codebooks.compress(table(spark, vectors, ids, labels).withColumns({"code": F.lit("x"), "Error": F.lit("y"), "extra": F.lit("z")}))
    rows = codebooks.with_label_error(coded).collect()
    assert sorted((r.length, r.vec_id or 0, list(r.code), r.error) for r in rows) == [(0, 10, [0, 0, 0, 0], 0), (3, 9, [0, 0, 0, 0], 0), (8, 0, [1, 1, 1, 1], 0), (8, 5, [0, 0, 0, 0], 0), (8, 7, [1, 1, 1, 1], 0), (8, 7, [1, 1, 1, 1], 0)]
    assert {r.extra for r in rows} == {"z"} and len(coded.columns) == 6
    # Equal entries: the lower index is taken, the others stay without rows.
    assert [b.entries[:, 0].tolist() for b in known.books[8]] == [[1024, 512, 512, 512]] * 4
    empty, none = codebooks.compress(table(spark, [None]))
    assert empty.collect() == [] and none.books == {}


def test_errors_by_label(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3 if i % 2 else 100 + i, i) for i in range(60)], "vec_id long, label int, error long")
    want = {}
    for r in rows.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    for most in (10_000, 7):
        got = codebooks.with_label_error(rows, most=most).collect()
        assert len(got) == 60 and all(r.label_error == want[r.label] for r in got)
    big = spark.createDataFrame([(1, 1, (1 << 63) - 1), (2, 1, 5)], "vec_id long, label int, error long")
    assert {r.label_error for r in codebooks.with_label_error(big).collect()} == {(1 << 63) - 1}


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="needs the given tables")
def test_codebooks_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(codebooks.oracle_sql())
    got = queries.op11_codebooks(spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def whitened_by_numpy(x):
    n, sums = len(x), [sum(c) for c in zip(*x)]
    c = np.array([[v - s / n for v, s in zip(row, sums)] for row in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, c @ u[:, :8] / np.sqrt(e[:8]), e[:8] / e.sum()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_whitening_against_numpy(spark, scale):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 1, (400, 12)) @ rng.normal(0, 1, (12, 12)) * scale).tolist()
    x = [[v + 100_000 for v in row] for row in floored(vectors)]
    n, deviation, white, explained = whitened_by_numpy(x)
    got = {r.vec_id: r for r in whitening.whiten(table(spark, vectors).repartition(5)).collect()}
    found = np.array([got[i].whitened for i in range(400)])
    assert np.abs(found * np.sign((found * white).sum(axis=0)) - white).max() < 1e-9
    assert [got[i].deviation for i in range(400)] == [min(d, (1 << 63) - 1) for d in deviation]
    assert {r.n for r in got.values()} == {n} and np.allclose(got[0].explained, explained, rtol=1e-10)
    assert 0 <= got[0].identity_error < 1e-9 and len({r.identity_error for r in got.values()}) == 1


def test_an_offset_costs_no_precision(spark):
    """Values far from zero with a small spread: squares of the values themselves would lose it."""
    rng = np.random.default_rng(6)
    small = rng.integers(-3, 4, (200, 4))
    near, far = (((small + shift) / 1024).tolist() for shift in (0, 1 << 40))
    a, b = ({r.vec_id: r for r in whitening.whiten(table(spark, v)).collect()} for v in (near, far))
    assert np.allclose([a[i].whitened for i in range(200)], [b[i].whitened for i in range(200)], atol=1e-9)
    assert [a[i].deviation for i in range(200)] == [b[i].deviation for i in range(200)]


def test_whitening_of_odd_rows(spark):
    vectors = [[0.5, 1.0], [0.5, 2.0], None, [0.1, None], [float("nan"), 0.0], [float("-inf"), 1.0], [], [7.0], [0.5, 1.0]]
    rows = table(spark, vectors).withColumns({"N": F.lit(1), "whitened": F.lit("x"), "extra": F.lit("z")})
    got = {r.vec_id: r for r in whitening.whiten(rows).collect()}
    assert set(got) == {0, 1, 6, 7, 8} and got[0].extra == "z"
    assert (got[6].whitened, got[6].n, got[6].deviation, got[6].identity_error) == ([], 1, 0, None)
    assert (got[7].whitened, got[7].explained, got[7].identity_error) == ([None], [None], None)
    # The first dimension does not vary: one component, the other has no value.
    assert np.allclose([abs(got[i].whitened[0]) for i in (0, 1, 8)], [0.5**0.5, 2**0.5, 0.5**0.5]) and got[0].whitened[1] is None
    assert got[0].explained == [1.0, 0.0] and got[0].identity_error < 1e-12 and got[0].deviation == got[8].deviation == 1024**2
    assert whitening.whiten(table(spark, [None])).collect() == []


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


URLS = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.example.net/EN/x", "a.example.net", "/EN/x", "net/", "block"),
    ("x://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://b.net", "b.net", "", None, "allow"),
    ("http://b.net?/x", "b.net", "", None, "allow"),
    ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("https://my-example.com/de", "my-example.com", "/de", None, "allow"),
    ("ftp://x.org/fr/://net/", "x.org", "/fr/://net/", "org/fr/", "allow"),
    ("//no-scheme.net/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("://#a", "", "", None, "allow"),
    ("http://ÄÖ.Net/ä", "ÄÖ.net", "/ä", "net/", "block"),
    ("http://x.net:80/", "x.net:80", "/", None, "allow"),
]


def test_urls_by_rule(spark, model):
    rows = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumns({"HOST": F.lit(1), "grams": F.lit("g"), "features": F.lit("f")})
    for rules in (urls.RULES, spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")):
        got = sorted(urls.judge(rows, model, rules).collect(), key=lambda r: r.page_id)
        for r, (_, host, path, rule, verdict) in zip(got, URLS * 2):
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert rule is None or r.verdict == verdict
            assert host or (r.score, r.verdict) == (0.0, "allow")
        assert len(got) == 2 * len(URLS) and {r.grams + r.features for r in got} == {"gf"}
    assert urls.judge(rows.limit(0), model, urls.RULES).collect() == []


def test_many_rules_and_ties(spark, model):
    rules = [urls.Rule(f"h{i}.test", "/", "block") for i in range(urls.MAX_LITERAL_RULES)] + [urls.Rule("b.test", "/", "block"), urls.Rule("test", "/ab", "allow")]
    rows = spark.createDataFrame([("http://x.h7.test/ab",), ("http://b.test/ab",), ("http://h7.tes/ab",)], "url string")
    want = {"http://x.h7.test/ab": "h7.test/", "http://b.test/ab": "b.test/", "http://h7.tes/ab": None}
    for some in (rules, rules[-3:] + [urls.Rule("h7.test", "/", "block")]):
        assert {r.url: r.rule for r in urls.judge(rows, model, some).collect()} == want


def test_the_regression_is_the_optimum(spark, model):
    """The gradient of the regularised loss vanishes, and names that the table does not hold are told apart."""
    labelled = urls.labelled_urls(spark)
    regression = model.stages[-1]
    rows = model.transform(labelled.withColumn("grams", urls._grams(*urls.host_and_path(F.col("url"))))).select("features", "blocked").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.blocked for r in rows])
    w = regression.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + regression.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + urls.REGULARISATION * w).max() < 2e-3 and abs((p - y).mean()) < 2e-3
    fresh = [("http://casino-kings.example.com/en/9", 1), ("https://www.pills-4u.example.org/de/12", 1), ("http://my-ads.example.com/fr/3", 1), ("http://adult-zone.example.com/en/4", 1), ("http://heathland.example.com/en/9", 0), ("https://www.carpentry.example.org/de/12", 0), ("http://grammar-school.example.com/fr/3", 0), ("http://botanical.example.com/en/4", 0)]
    got = urls.judge(spark.createDataFrame(fresh, "url string, blocked int"), model).collect()
    right = [(r.verdict == "block") == bool(r.blocked) for r in got]
    assert sum(right) >= 7, [(r.url, r.score) for r in got]


def test_a_very_long_url(spark, model):
    rows = spark.createDataFrame([("http://example.net/en/" + "ab/" * 60_000,)], "url string")
    assert urls.judge(rows, model, urls.RULES).select("rule", F.length("path")).first() == ("example.net/en/", 4 + 180_000)
