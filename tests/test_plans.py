"""Every plan against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from reviewloom.plans import codebase, context, hosts, oracles, review, run, sources, streams

PLANS = {**review.queries(), **context.queries(), **hosts.queries(), **codebase.queries(), **sources.queries(), **streams.queries(), **run.queries()}
SQL = {**oracles.oracle_sql(), **context.oracle_sql(), **hosts.oracle_sql(), **codebase.oracle_sql(), **sources.oracle_sql(), **streams.oracle_sql(), **run.oracle_sql()}

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def shown(x):
        return "~" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(shown(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


#: Folds that SQL doesn't express; tests/test_context.py holds them against plain versions.
WITHOUT_SQL = {"yaml_key_paths", "context_pack", "snippet_compact", "context_sections"}


def test_every_plan_has_sql():
    assert set(PLANS) - WITHOUT_SQL == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan(name, spark, duck):
    ours, theirs = PLANS[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
