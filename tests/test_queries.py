"""Every registered query against its SQL; SETTLELENS_SAMPLE=1 runs a few. The corpus queries have tests of their own."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from settlelens.plans import registered
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["a1_str_daily_vendor", "a5_onchain_daily_costs", "a8_blob_fee_state", "j11_monthly_cross_source", "n5_idempotent_append",
          "p17_contract_cast", "q3_manifest_validity", "w2_floor_runs", "x3_mann_kendall", "x11_fee_floor"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


def test_sql_gives_portable_types():
    con = connect(SF)
    kinds = {(k, r[0]): r[1] for k, q in oracle_sql().items() for r in con.execute("DESCRIBE " + q).fetchall()}
    assert {c: t for c, t in kinds.items() if t not in ("BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN")} == {}


@pytest.mark.parametrize("key", SAMPLE if os.environ.get("SETTLELENS_SAMPLE") else sorted(registered()))
def test_query_matches_sql(spark, key):
    df = queries()[key](spark, SF)
    if key in oracle_sql():
        message, _ = compare(df, connect(SF), oracle_sql()[key])
        assert message == ""
    else:
        df.collect()


def test_entry(spark):
    assert entry(spark).count() > 0
