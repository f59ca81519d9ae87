"""Every query with an oracle against DuckDB, and every other one for running at all."""

import os

import duckdb
import pytest

from gridsquall.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(frame, columns):
    return frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).sort_values(columns).values.tolist()


def close(a, b):
    try:
        return abs(float(a) - float(b)) <= 2e-6 * max(1, abs(float(a)))
    except ValueError:
        return a.replace(" 00:00:00", "") == b.replace(" 00:00:00", "")


#: Has no day with ten matches in the smallest tables.
MAY_BE_EMPTY = {"D19_daily_velocity"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) and (len(want) or name in MAY_BE_EMPTY)
    assert all(close(x, y) for a, b in zip(rows(got, columns), rows(want, columns), strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["D9_moving_block_index", "D10_bootstrap_interval", "D11_permutation_p_value", "E1_swinging_door", "E3_ramp_extraction", "H6_logistic_with_offset", "H8_cluster_bootstrap", "H11_position_uncertainty", "H14_model_implied_ensemble", "H17_poisson_backtest"])
def test_runs_and_repeats(spark, name):
    a, b = (registry.QUERIES[name](spark, SF).toPandas() for _ in range(2))
    columns = sorted(a.columns)
    assert len(a) and rows(a.round(9), columns) == rows(b.round(9), columns)
