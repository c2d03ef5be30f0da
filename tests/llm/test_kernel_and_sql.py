"""The text kernel against plain Python, and the registered queries against DuckDB."""

import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import queries
from tessera.llm import text as kernel

SF = "/root/testdata/sf0.001"


def _lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "日", " ", "\t", "\n", "\x1c", "\x85", "\xa0", "-", "9", "😀", "\x00", "_"]
    out = ["", None, " ", "x", "A b", "é" * 50, "word " * 400]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]


@pytest.mark.parametrize(("table", "pattern"), [(kernel.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (kernel.SPACE_WORDS, r"[^\x20\x09-\x0D]+")])
@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_words_equal_the_pattern(table, pattern, limit):
    rows = texts()
    got, seen = [], {}
    for first, end, raw, offsets in kernel.slices(pa.array(rows, pa.string()), limit):
        mapped, starts, ends, at = kernel.spans(raw, offsets, table)
        hashed = kernel.hashes(mapped, starts, ends)
        for t in range(end - first):
            words = [mapped[s:e].tobytes().replace(b"\xff", b"\0").decode() for s, e in zip(starts[at[t] : at[t + 1]], ends[at[t] : at[t + 1]], strict=True)]
            got.append(words)
            for w, h in zip(words, hashed[at[t] : at[t + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert got == [re.findall(pattern, _lower(r or "")) for r in rows]
    assert len(set(seen.values())) == len(seen)


def test_shingles_and_grams():
    words = np.arange(1, 13, dtype=np.uint64)
    at = np.array([0, 0, 3, 5, 12])
    got, where = kernel.shingles(words, at, 3)
    assert np.diff(where).tolist() == [0, 1, 1, 5]
    assert len(set(got.tolist())) == 7
    whole, keep = kernel.grams(words, at, 3)
    assert keep.tolist() == [True, False, False, False, False] + [True] * 5 + [False] * 2
    again, _ = kernel.shingles(np.array([1, 2, 3, 9], np.uint64), np.array([0, 4]), 3)
    assert again[0] == got[0]  # the same words give the same shingle wherever they stand


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in got.select(columns).collect()) == want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
