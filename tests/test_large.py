"""What only shows on larger tables: values between two roundings, tubes that no task may hold."""

import math
import os

import pytest
from pyspark.sql import functions as F

from gatewise import queries
from gatewise.functions import formats
from gatewise.model import Panel
from gatewise.operators import autogate, quantiles
from gatewise.operators.compensation import compensate_tubes, tube_matrices
from gatewise.plans.gates import polygon_mask, shape_mask
from gatewise.sources import fcs_source


def test_rounding_by_binary_value(spark):
    """asinh(8035.95 / 150) is 4.67427948499999956..., whose shortest form ends in 5."""
    values = [4.674279485, -4.674279485, 0.125, -0.125, 2.5, 1e300, float("inf"), None, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows.select(formats.rounded(rows.x, 8)).collect()] == [4.67427948, -4.67427948, 0.125, -0.125, 2.5, 1e300, float("inf"), None, 0.0]
    assert [r[0] for r in rows.select(formats.rounded(rows.x, 2)).collect()][2:4] == [0.13, -0.13]


def test_transform_dump_between_two_roundings(spark, tmp_path):
    spark.createDataFrame([(1, 8035.95), (2, -20.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["raw"]: r["transformed"] for r in queries.queries()["k_transform_dump"](spark, str(tmp_path)).collect()}
    assert got == {"8035.950000": "4.6742794800", "-20.000000": "-0.1329414000"}


def large(spark, folder, n=200_000):
    """Events of three tubes, of more bytes than the session would send round below."""
    spark.range(n).selectExpr("concat('t', id % 3) AS sample_id", "id AS event_idx", "rand(1) * 1000 AS c0", "rand(2) * 1000 + 1 AS c1", "rand(3) AS c2").write.parquet(folder)
    return spark.read.parquet(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1MB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_singlet_ratios_are_not_sorted_by_tube(spark, tmp_path, monkeypatch, small_tables):
    seen, mode_of = [], autogate.mode_of
    monkeypatch.setattr(autogate, "mode_of", lambda values, *a: seen.append(values) or mode_of(values, *a))
    out = autogate.singlet_vertices(large(spark, f"{tmp_path}/ev"), "c0", "c1", ["sample_id"])
    assert "SortMergeJoin" not in plan(seen[0]) and "Exchange hashpartitioning" not in plan(seen[0])
    assert {r["sample_id"] for r in out.collect()} == {"t0", "t1", "t2"}


def test_a_tube_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """No task orders or decodes a whole tube: the one tube's events come as several ranges, and lie in its file in order."""
    seen, keep = [], fcs_source.written
    monkeypatch.setattr(fcs_source, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    ev = spark.range(20_000).selectExpr("'t' AS sample_id", "(id * 7919) % 20000 AS event_idx", "cast((id * 7919) % 20000 AS double) AS c0")
    assert [tuple(r)[:2] for r in fcs_source.save_events(ev, Panel(("FSC-A",)), f"{tmp_path}/out").collect()] == [("t", 20_000)]
    runs = [r["n"] for r in seen[0].collect()]
    assert len(runs) == 4 and sum(runs) == 20_000 and max(runs) < 8_000
    assert fcs_source.read_events(spark, f"{tmp_path}/out").where("c0 = event_idx").count() == 20_000
    assert os.listdir(f"{tmp_path}/out") == ["t.fcs"]


def test_matrices_of_tubes_do_not_sort_events(spark, tmp_path, small_tables):
    ev = large(spark, f"{tmp_path}/ev")
    names = ev.select("sample_id").distinct().selectExpr("sample_id", "array('FITC-A', 'PE-A', 'SSC-A') AS channels", "map('SPILL', '2,FITC-A,PE-A,1,0.1,0.2,1') AS keywords")
    out = compensate_tubes(ev, Panel(("FITC-A", "PE-A", "SSC-A"), ("c0", "c1", "c2")), tube_matrices(names))
    assert "SortMergeJoin" not in plan(out) and out.count() == 200_000


@pytest.mark.parametrize("corners", [64, 7, 40])
def test_polygons_by_slabs(spark, corners):
    """As if all edges were looked at, at the vertices' own heights too; a comb has too many edges in a slab to be parted."""
    ring = [[50 + 40 * math.cos(math.tau * i / corners), 50 + 40 * math.sin(math.tau * i / corners)] for i in range(corners)]
    points = [[i * 2.0, i % 2 * (50.0 + i)] for i in range(corners)] if corners == 40 else ring
    at = [(x * 3.0, y) for x in range(34) for y in [*range(0, 101, 9), *[v for _, v in points[::5]]]] + [(float("nan"), 50.0), (50.0, float("nan")), (None, 50.0)]
    rows = spark.createDataFrame([(i, x, float(y)) for i, (x, y) in enumerate(at)], "i int, x double, y double")
    got = {r[0] for r in rows.where(shape_mask({"shape": "polygon", "vertices": points}, rows.x, rows.y)).select("i").collect()}
    crossed = lambda x, y: sum((yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True) if yi != yj)
    assert got == {i for i, (x, y) in enumerate(at) if x is not None and crossed(x, y) % 2}
    if corners == 64:  # by halving, not by 64 comparisons of heights at each place
        assert polygon_mask(points, rows.x, rows.y)._jc.toString().count("!") == 0


@pytest.mark.parametrize("near", [0.003, -0.2])
def test_medians_between_sketched_ends(spark, monkeypatch, near):
    """As from one state of all values; where the ends (here the wrong way round) have no median between them, by ranges."""
    monkeypatch.setattr(quantiles, "NEAR", near)
    ev = spark.range(30_001).selectExpr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS s", "exp(id % 997 / 50.0) AS x", "CASE WHEN id % 4 <> 2 THEN CAST(id * 7919 % 30001 AS DOUBLE) END AS y", "CAST(id % 2 AS INT) AS z")
    ev = ev.unionByName(spark.createDataFrame([("one", 5.0, None, 1), ("two", -1.0, 3.0, 4), ("two", 2.0, 3.0, 9)], ev.schema))
    want = ev.groupBy("s").agg(F.count("x"), F.percentile("x", F.lit(0.5)), F.count("y"), F.percentile("y", F.lit(0.5)), F.percentile("z", F.lit(0.5)), F.sum("z"))
    got = quantiles.medians(ev, {n: F.col(n) for n in "xyz"}, ["s"], {"sum": F.sum("z")}).select("s", "x.n", "x.median", "y.n", "y.median", "z.median", "sum")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect()))) and got.count() == 6


def by_state(monkeypatch):
    def refuse(*_):
        raise AssertionError("a state of a tube's values")

    monkeypatch.setattr(F, "percentile", refuse)


def test_spillover_holds_no_tube(spark, tmp_path, monkeypatch, small_tables):
    """Neither in a state nor by sorting events by tube; what is counted by its value is a small share."""
    by_state(monkeypatch)
    seen = []
    monkeypatch.setattr(quantiles, "same_group", lambda left, right, by, how="inner", keep=quantiles.same_group: seen.append(keep(left, right, by, how)) or seen[-1])
    monkeypatch.setattr(autogate, "same_group", quantiles.same_group)
    ev = large(spark, f"{tmp_path}/ev").selectExpr("sample_id", "IF(sample_id = 't1', 9000 + c0, c2) AS c0", "IF(sample_id = 't2', 9000 + c1, c2) AS c1")
    m = autogate.compute_spillover(ev, Panel(("FITC-A", "PE-A")), autogate.Controls("t0", ("t1", "t2")))
    assert m.matrix[0][0] == m.matrix[1][1] == 1.0 and abs(m.matrix[0][1]) < 1e-3
    assert len(seen) > 5 and not [s for s in seen if "SortMergeJoin" in plan(s)]


def test_residuals_hold_no_tube(spark, tmp_path, monkeypatch, small_tables):
    ev, panel = large(spark, f"{tmp_path}/ev"), Panel(("FITC-A", "PE-A", "APC-A"), ("c0", "c1", "c2"))
    x, y = ("c0", "c1")
    half = lambda v, where: F.expr(f"percentile({v}, 0.5) FILTER (WHERE {where})")
    rise = lambda v: half(v, f"{x} > 500") - half(v, f"NOT {x} > 500")
    want = {r["sample_id"]: r["v"] for r in ev.groupBy("sample_id").agg((rise(y) / rise(x)).alias("v")).collect()}
    by_state(monkeypatch)
    got = autogate.cross_check(ev, panel, {"FITC-A": 500.0}).collect()
    assert {r["sample_id"]: r["residual"] for r in got if r["target"] == "PE-A"} == pytest.approx(want, rel=1e-12) and len(got) == 6
