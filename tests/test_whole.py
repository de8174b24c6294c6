"""Queries that take the whole table, at a scale with several fields of view."""

import math
import os

import pytest

from lumenframe.operators import drift, render
from lumenframe.plans import registry
from lumenframe.plans.locs import locs
from tests.oracle import connect, same

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are elsewhere")


def test_aim_drift_of_every_field(spark):
    got = {}
    for r in registry.QUERIES["aim_drift"](spark, SF).collect():
        got.setdefault(r.fov_index, {})[r.frame] = (r.dx, r.dy)
    assert sorted(got) == [0, 1, 2, 3]
    one = drift.aim(locs(spark, SF).where("fov_index = 2"), drift.Params(125, 0.25, 1.0)).collect()
    assert len(one) == len(got[2]) and all(got[2][r.frame] == pytest.approx((r.dx, r.dy), abs=2e-6) for r in one)


def test_fire_resolution_of_every_field(spark):
    got = {r.fov_index: (r.resolution_nm, r.spread_nm) for r in registry.QUERIES["fire_resolution"](spark, SF).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    want = render.fire(locs(spark, SF).where("fov_index = 2"), 128, 0.5, reps=4, pixel_nm=130.0)
    assert got[2] == pytest.approx(want, abs=2e-6, nan_ok=True) and not all(math.isnan(a) for a, _ in got.values())


@pytest.mark.parametrize("name", ["molecule_average", "roi_traces", "frame_offset_union", "minimum_rows_guard"])
def test_whole_table_against_its_twin(spark, name):
    same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE_SQL[name])


def test_no_molecule_or_field_is_left_out(spark):
    t = locs(spark, SF)
    assert registry.QUERIES["roi_traces"](spark, SF).select("punctum").distinct().count() == t.select("molecular_index").distinct().count() > 50
    assert registry.QUERIES["frame_offset_union"](spark, SF).count() == registry.QUERIES["minimum_rows_guard"](spark, SF).count() == t.count() > 7500


def test_molecules_beyond_the_brightest_hundred(spark):
    assert registry.QUERIES["molecule_average"](spark, SF).count() > 100


@pytest.mark.parametrize("name", ["lr_scan_gaussian", "lr_scan_poisson"])
def test_mirrored_splits_give_the_first(spark, tmp_path, name):
    # traces that read the same backwards: splits after k and n - k have one score but for its last bits
    con = connect(SF)
    con.sql(f"COPY (SELECT i * 40 + t AS event_id, i AS user_id, CAST((i * 37 + least(t, 39 - t) * (i + 11) * 53) % 101 AS DOUBLE) AS value FROM range(200) a(i), range(40) b(t)) TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert all(r.split <= 20 for r in got.collect())
    same(got, con, registry.ORACLE_SQL[name])
