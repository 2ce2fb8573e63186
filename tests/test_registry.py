"""Every registered query against its SQL on the small tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# One query per family keeps the run short; all of them are compared by the driver.
CHOSEN = [
    "P14_P15_grid_bins", "C2_label_features", "A17_feature_table", "J5_parallax_gated_pct", "G4_hour_rain", "G5_hour_metrics",
    "Q11_wide_fields", "Q12_display_ranges", "Q14_rate_by_storm_class", "R4_diurnal_cycle", "F6_diurnal_by_surface", "H1_composite_p90",
    "H2_fixed_cape_lines", "E1_shear", "IO9_V5_compaction", "J9_granule_months", "T1_hourly_batch", "V3_ranges", "W3_cape_quartiles",
    "IO2_window_of_the_lake", "IO7_G18_month_run_twice", "IO9_changed_contents", "T1_late_and_repeated", "U4_missing_months", "V5_U6_contents",
    "W8_ordinal_of_files", "H12_exact_trees",
]


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def normal(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        if isinstance(v, bool):
            return (1, v)
        if isinstance(v, (int, float)):
            return (2, round(float(v), 5))
        return (3, v.isoformat() if isinstance(v, dt.datetime) else str(v))

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_agrees_with_sql(spark, duck, data_dir, name):
    df = entry_points.queries()[name](spark, data_dir)
    cols = sorted(df.columns)
    cur = duck.execute(f"SELECT {', '.join(cols)} FROM ({entry_points.oracle_sql()[name]})")
    assert normal(df.select(*cols).collect()) == normal(cur.fetchall())


def test_names_and_oracles_line_up():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    # rows-only: the fitted models
    own = {q for q in set(queries) - set(oracles) if not (q == "pipeline" or q.startswith("op"))}
    assert sorted(own) == [
        "H12_boosted_trees", "H13_local_effects", "H14_partial_effect", "H17_extreme_classifier",
    ]


def test_entry(spark, data_dir):
    assert entry_points.entry(spark).count() > 0
