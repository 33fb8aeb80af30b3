"""Queries of the catalogue against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from gridmill.plans import inputs, queries

DIR = "/root/testdata/sf0.001"
NAMES = ["parse_french_numbers", "classify_cells", "header_merge_dedupe", "table_body_stats", "bounds_check", "year_jump_check", "period_normalise", "unit_multiplier", "winner_selection", "portal_audit", "vocabulary_worklist", "html_tables", "sdmx_ml_obs", "codelists", "skip_reasons"]


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.12g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in inputs.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda r: [str((x is None, x)) for x in r]
    a = sorted(([plain(x) for x in r] for r in got.select(*cols).collect()), key=key)
    b = sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=key)
    assert a == b
