"""Every registered query with SQL against DuckDB on the smallest tables, and that comparisons aren't empty."""

import os

import duckdb
import pytest

from weirflow import oracles, queries

SF = "/root/testdata/sf0.001"
#: Empty on the smallest tables, where no supplier is in the red.
MAY_BE_EMPTY = {"literal_surfaces", "fix_remedy", "net_destinations"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
    assert len(mine) or name in MAY_BE_EMPTY


def test_digest(spark):
    h = 0xCBF29CE484222325
    for b in "".join(f"app::region::r{i}\n" for i in range(5)).encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    got = {r["module"]: r["digest"] for r in queries.QUERIES["manifest_digest"](spark, SF).collect()}
    assert got["app::region"] == str(h)


def test_digest_of_every_module(spark):
    import pyarrow.parquet as pq

    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}
    want = {}
    for table, key in keys.items():
        module = f"app::{table.rstrip('s') if table == 'orders' else table}"
        h = 0xCBF29CE484222325
        for name in sorted({f"{module}::{table[0]}{k}".encode() for k in pq.read_table(f"{SF}/{table}.parquet")[key].to_pylist()}):
            for b in name + b"\n":
                h = (h ^ b) * 0x100000001B3 % (1 << 64)
        want[module] = str(h)
    assert {r["module"]: r["digest"] for r in queries.QUERIES["manifest_digest"](spark, SF).collect()} == want and len(want) == 6


def test_entry_without_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "effect_fixpoint" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_unknown_effects_are_refused(spark):
    from weirflow.operators import verbs

    f = queries.facts(spark, SF)
    with pytest.raises(verbs.Refused):
        verbs.where(f, "Network")
    assert verbs.where(f, "Ipc").isEmpty()
    with pytest.raises(verbs.Refused):
        verbs.path(f, queries.UNIT, "Fss")


def test_user_rules_text():
    from weirflow.operators import extensions

    rules = extensions.parse_rules("Net crate a\n\n# Fs crate b\nFoo crate c\nFs\n  Db\tpath  x::y  more")
    assert rules == [extensions.ClassRule("Net", True, "a"), extensions.ClassRule("Db", False, "x::y")]


def test_changed_tables_get_new_facts(spark, tmp_path):
    import shutil

    for t in os.listdir(SF):
        shutil.copy(f"{SF}/{t}", tmp_path)
    before = queries.facts(spark, str(tmp_path))
    assert queries.facts(spark, str(tmp_path)) is before
    spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 10").toPandas().to_parquet(tmp_path / "part.parquet")
    assert queries.facts(spark, str(tmp_path)) is not before
