"""Line dedup, Jaccard join and decontamination against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, jaccard_join, line_dedup

DOCS = "doc_id long, text string"


def _lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


# Line dedup


def brute_lines(rows, min_docs, keep_first=False):
    key = lambda line: _lower(line.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            where.setdefault(key(line), []).append((i is not None, i, p))
    gone = {k for k, v in where.items() if k and len({x[:2] for x in v}) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for p, line in enumerate(lines) if key(line) not in gone or keep_first and (i is not None, i, p) == min(where[key(line)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [1, 3])
def test_lines_equal_brute_force(spark, min_docs, keep_first):
    rng = random.Random(3)
    pieces = ["a", "A ", "\tb", "b\r", "", " ", "c d", "é", "É", " x", "long " * 2000]
    rows = [(i, "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (5, rows[5][1]), (5, rows[5][1]), (None, "a\nq"), (102, "\n" * 200 + "a"), (103, "solo\n" * 130)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("clash"), "h": F.lit(1)})
    got = line_dedup.dedup_lines(df, min_docs, keep_first=keep_first)
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_dropped", "kept_text"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute_lines(rows, min_docs, keep_first)


def test_lines_of_empty_table_and_plan_without_python(spark):
    df = spark.createDataFrame([], DOCS)
    got = line_dedup.dedup_lines(df)
    assert got.count() == 0
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


# Jaccard join


def brute_components(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed, groups=6, of=12, shared=True):
    rng = random.Random(seed)
    rows, n = [], 0
    passage = " ".join(f"p{i}" for i in range(30))
    for g in range(groups):
        words = [f"g{g}x{i}" for i in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(of):
            text = near(rng, words, rng.randint(0, max(1, len(words) // 20)))
            rows.append((n := n + rng.randint(1, 3), text + (" " + passage if shared and rng.random() < 0.5 else "")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), jaccard_join.Settings(paired_from=8))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rows = corpus(7, groups=2, of=60)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), jaccard_join.Settings(paired_from=8))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_component_edge_cases(spark):
    long_text = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b c"), (5, "A  b\nc"), (6, "a b"), (7, long_text), (8, long_text + " z"), (9, "x"), (9, "x"), (10, "x"), (11, "é è")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"cls": F.lit(0), "n": F.lit("x"), "tokens": F.lit(1)})
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29996, 7), (8, 29997, 7), (9, 1, 9), (9, 1, 9), (10, 1, 9), (11, 1, 11)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c")], DOCS)
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(nulls).collect()), key=str) == [(3, 3), (None, None), (None, None)]


def test_threshold_is_exact(spark):
    # 8 of 10 shingles shared is a link, 7 of 9 is not.
    base = [f"a{i}" for i in range(13)]  # nine shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:12] + ["z"])), (3, " ".join(base[:11] + ["y", "x"]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: c for d, _, c in brute_components(rows)}
    assert got[2] == 1


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[100 + i] == 100 for i in range(30))
    assert all(got[u] == got[v] for u, v in edges if u != v)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Decontamination


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "d1", "é", "日本"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 4, 6, 9, 10, 11, 25]))) for i in range(8)] + [(50, None), (51, "--"), (3, "a B c")]
    docs = [(i, sentence(rng.randint(0, 40))) for i in range(30)]
    docs += [(100 + i, f"{sentence(5)} x {t} y {sentence(5)}") for i, t in items if t]
    docs += [(200, None), (201, ""), (202, "long " * 30_000), (100, docs[0][1]), (0, docs[0][1]), (None, items[0][1])]
    own = spark.createDataFrame(docs, DOCS).withColumns({"key": F.lit("clash"), "n_words": F.lit(1), "id": F.lit(0)})
    got = decontaminate.contamination(own, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in got.collect()), key=str) == brute_hits(docs, items)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect()] == [False]
