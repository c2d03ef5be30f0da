"""Every query with SQL gives the same rows as DuckDB; settings; the contract."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tessera.plans import oracle, queries
from tessera.sources.settings import Settings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def norm(rows):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    if name not in oracle.oracle_sql():
        assert rows
        return
    cursor = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert norm(rows) == norm(want)


def test_scanned_tables_may_be_folders(spark, duck, tmp_path):
    for i, t in enumerate(TABLES):
        if i % 2:
            (tmp_path / f"{t}.parquet").write_bytes(b"PAR1\0")
            continue
        (tmp_path / f"{t}.parquet" / "day=1").mkdir(parents=True)
        for part in ("_SUCCESS", "part-0.parquet", "day=1/part-1.parquet"):
            (tmp_path / f"{t}.parquet" / part).write_bytes(b"" if part == "_SUCCESS" else b"PAR1\0")
    sql = oracle.oracle_sql()["scan_tables"]
    got = queries.queries()["scan_tables"](spark, str(tmp_path))
    assert got.columns == [d[0] for d in duck.execute(sql).description]
    assert norm(got.collect()) == norm(duck.execute(sql).fetchall())
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.py").write_text("x")
    rows = {r.relative_path: r.category for r in queries.queries()["scan_tables"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(TABLES) and rows["other/a.py"] == "source"


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    if os.path.isdir(SF):
        assert contract.entry(spark).count() == 1


def test_settings(tmp_path):
    env = {f: "x" for f in Settings.__dataclass_fields__} | {"DEBUG": "true", "POSTGRES_PORT": "5432", "QDRANT_PORT": "1"}
    got = Settings.load(env, tmp_path / ".env")
    assert (got.DEBUG, got.POSTGRES_PORT, got.APP_NAME) == (True, 5432, "x")
    (tmp_path / ".env").write_text('# c\nAPP_NAME="from file"\n')
    assert Settings.load({k: v for k, v in env.items() if k != "APP_NAME"}, tmp_path / ".env").APP_NAME == "from file"
    with pytest.raises(ValueError, match="missing"):
        Settings.load({}, tmp_path / "none")
    with pytest.raises(ValueError):
        Settings.load(env | {"POSTGRES_PORT": "x"}, tmp_path / "none")
