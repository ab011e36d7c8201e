"""Queries with SQL twins, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tests.conftest import SF
from wayfare.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.execute(ORACLES[name])
    cols = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want
