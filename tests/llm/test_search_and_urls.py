"""Inverted multi-index search and URL filter."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, url_filter

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    for q in queries:
        own = ids == q
        score = x @ x[np.flatnonzero(own)[0]]
        order = [i for i in np.lexsort((ids, -score)) if not own[i]][:k]
        out[q] = [(int(ids[i]), round(float(score[i]), 9)) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_all_candidates_give_the_exact_result(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]  # many copies of one vector
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = found(ann.search(df, F.col("id") % 20 == 0, ann.Settings(effort=float("inf"), block=64, queries=8)))
    assert got == brute(rows, [i for i, _ in rows if i % 20 == 0], 20)


def test_recall_of_a_share_of_candidates(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    x = centers[rng.integers(30, size=3000)] + 0.5 * rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = found(ann.search(df, F.col("id") % 20 == 0, ann.Settings(effort=1.0)))
    want = brute(rows, range(0, 3000, 20), 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall > 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []), (7, [1.0]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, None), (40, [0.0, 1.0]), (40, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({"id": F.lit("clash"), "vector": F.lit(1), "rank": F.lit(2)})
    got = found(ann.search(df, F.col("id") % 20 == 0))
    assert got == {0: [(8, 0.5), (40, 0.0)], 40: [(8, 0.5), (0, 0.0)]}
    assert found(ann.search(df.limit(0), F.col("id") % 20 == 0)) == {}
    assert found(ann.search(df.where("vec_id = 2"), F.lit(True))) == {}


@pytest.mark.parametrize("budget", [1, 7, 40, 150, 10_000])
@pytest.mark.parametrize("spread", [1.0, 0.01, 30.0])
def test_walk_passes_the_pairs_of_the_lowest_sums(budget, spread):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=23) * spread, np.round(rng.normal(size=17), 1)  # ties within b
    counts = rng.integers(0, 3, size=(23, 17)).astype(np.int32)
    index = ann.Index(np.zeros((23, 1)), np.zeros((17, 1)), counts, np.zeros(391, np.int32), budget)
    cut, passed = ann.walk(index, a, b)
    sums = (a[:, None] + b[None, :]).ravel()
    order = np.argsort(sums, kind="stable")
    reached = np.cumsum(counts.ravel()[order])
    if reached[-1] < budget:
        want = set(order.tolist())
        assert cut == float("inf")
    else:
        assert cut == pytest.approx(sums[order[np.searchsorted(reached, budget)]])
        want = set(np.flatnonzero(sums <= cut + 1e-12).tolist())
    assert sorted(passed.tolist()) == sorted(c for c in want if counts.ravel()[c])


def test_ids_with_several_vectors_are_several_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100)] + [(0, rng.normal(size=6).tolist()), (0, None)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = ann.search(df, F.col("id") == 0, ann.Settings(k=5, effort=float("inf"))).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r.query_hash, []).append((r.vec_id, round(r.score, 9)))
    x = np.array([v for _, v in rows[1:100]], np.float32).astype(np.float64)
    want = []
    for q in (rows[0][1], rows[100][1]):
        score = x @ np.array(q, np.float32).astype(np.float64)
        want.append([(int(i) + 1, round(float(score[i]), 9)) for i in np.argsort(-score)[:5]])
    assert sorted(lists.values()) == sorted(want)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_production_settings_on_embeddings(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(ann.search(df, F.col("id") % 20 == 0))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


URLS = [
    ("https://www.A.Example.ORG/es/x", "www.a.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://com/de/x", "com", "/de/x", "com/de/", "block"),
    ("http://x.org", "x.org", "", None, "allow"),
    ("http://x.net?a=/b", "x.net", "", None, "allow"),
    ("http://x.net#/casino", "x.net", "", None, "allow"),
    ("http://m.casino-win.net/", "m.casino-win.net", "/", None, "block"),
    ("http://casinos.net/", "casinos.net", "/", None, "allow"),
    ("http://free-bets.net/", "free-bets.net", "/", None, "block"),
    ("http://free.net/free", "free.net", "/free", None, "allow"),
    ("http://x.net/FREE_Spam", "x.net", "/FREE_Spam", None, "block"),
    ("nothing", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.net/é", "É.net", "/é", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://" + "a" * 100_000 + ".net/casino", "a" * 100_000 + ".net", "/casino", None, "block"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, host string")
    got = url_filter.filter_urls(df).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [tuple(w) for _, *w in URLS]
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert url_filter.filter_urls(df.union(df)).count() == 2 * len(URLS)


@pytest.mark.parametrize("text", ["casino", "xcasino", "casino9", "a-casino-b", "free bets", "free free", "bets/free", "adult-x", "adult-xy", "pornporn", "porn.porn"])
def test_hits_equal_patterns(text):
    import ahocorasick

    a = ahocorasick.Automaton()
    terms = [*url_filter.STRICT, *url_filter.SOFT]
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    assert url_filter.hits(text, a) == {t for t in terms if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", text)}


def test_weights_of_a_table_equal_sql(spark):
    terms = [("Article", False, 2), ("blog", False, 3), ("news", False, None), ("page", False, 4), ("shop", True, 1), ("shop", False, 9), ("free", False, 5), ("bonus", False, 1), ("", True, 1), (None, True, 1), ("news", False, 2), ("www", False, 1), ("example", False, 2), ("login", True, None)]
    words = url_filter.vocabulary_of(spark.createDataFrame(terms, "term string, strict boolean, weight int"), threshold=5)
    assert words.strict == ("login", "shop")
    assert (words.soft["article"], words.soft["news"], words.soft["free"]) == (2, 2, 5)
    db = duckdb.connect()
    db.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = db.execute(f"select page_id, rule, verdict, n_strict, soft_weight from ({url_filter.oracle(vocabulary=words)})").fetchall()
    got = url_filter.filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), vocabulary=words).select("page_id", "rule", "verdict", "n_strict", "soft_weight").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r.soft_weight for r in got}) >= 4
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    with pytest.MonkeyPatch.context() as patch, pytest.raises(ValueError, match="terms"):
        patch.setattr(url_filter, "MOST_TERMS", 3)
        url_filter.vocabulary_of(spark.createDataFrame(terms, "term string, strict boolean, weight int"))
