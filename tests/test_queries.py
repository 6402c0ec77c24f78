"""Every query with a SQL twin gives what DuckDB gives; the others run and have a stable schema."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairnmine import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their operators have tests of their own in test_models.py.
SLOW = {"cubeflow_plus", "beatlex_segments", "eaglemine_labels", "fraudar_block", "specgreedy_block", "eigenspokes", "spectral_block", "holoscope_block", "holoscope_signals_block", "dpgs_summary"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 8) + 0.0)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, sf, name):
    f = catalog.queries()[name]
    assert f(spark, sf).count() >= 0


def test_entry(spark):
    assert catalog.entry(spark, "/root/testdata/sf0.001").count() > 0
