"""Known answers of transforms, gates, statistics, matrices, files and exports."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.functions.formats import csv_number, file_token, numeric_tag
from gatewise.functions.transforms import forward, inverse, logicle
from gatewise.model import Gate, Panel, Session, Transform, boolean_gate, default_transforms, delete_gate, dump_gates, gate_path, load_gates, move_quadrant, quadrant_gates, reparent, tree_order
from gatewise.operators import autogate, density, qc, stats
from gatewise.operators.batch import batch, batch_tubes, channel_union
from gatewise.operators.compensation import Spillover, choose_spillover, compensate, compensate_tubes, range_mask, tube_matrices
from gatewise.operators.quantiles import exact_quantiles
from gatewise.operators.selfcheck import compare_probes
from gatewise.plans.gates import GatePlan, data_bounds, deepest_population, gate_at, missing_channels
from gatewise.sources import fcs, sinks
from gatewise.sources.gating_ml import read_gating_ml
from gatewise.sources.fcs_source import read_events, read_files, save_events, stream_events

# Published asinh(x / 150) and logicle (T 262144, W 0.5, M 4.5, A 0) results.
ASINH = {-2000: -3.284817639, -500: -1.918896472, -1: -0.006666617285, 0: 0.0, 100: 0.6251451173, 5000: 4.199930002, 262144: 8.159161218}
LOGICLE = {-2000: -1.362705422, -500: -0.7145863372, -1: 0.4949581053, 0: 0.5, 100: 0.9593148939, 5000: 2.772105464, 262144: 4.5}


def column(spark, values, expr):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_transforms(spark):
    assert column(spark, ASINH, forward(F.col("x"), Transform("asinh"))) == pytest.approx(list(ASINH.values()), rel=1e-8)
    assert column(spark, LOGICLE, forward(F.col("x"), Transform("logicle"))) == pytest.approx(list(LOGICLE.values()), rel=1e-8)
    assert column(spark, [-1e9], forward(F.col("x"), Transform("asinh", cofactor=1.0))) == pytest.approx([math.asinh(-1e9)])
    assert column(spark, [float("nan"), -5, 1000, None], forward(F.col("x"), Transform("log"))) == [0.0, 0.0, 3.0, None]
    assert column(spark, [7.0], forward(F.col("x"), Transform("logicle", w=9.0))) == [7.0]
    for tf in (Transform("log"), Transform("asinh"), Transform("logicle"), Transform()):
        x = [1.0, 37.5, 2000.0, 262144.0]
        assert column(spark, x, inverse(forward(F.col("x"), tf), tf)) == pytest.approx(x, rel=1e-9)
    k = logicle(262144.0, 0.5, 4.5, 0.0)
    s = np.linspace(-0.3, 1.0, 101)
    assert k.forward(k.inverse(s)) / k.m == pytest.approx(s, abs=1e-12)


PANEL = Panel(("FSC-A", "fitc-a", "Time"))


def rect(id, lo, hi, parent=None, channel="FSC-A", name=None):
    return Gate(id, name or f"g{id}", {"shape": "range", "x_min": lo, "x_max": hi}, parent, channel, channel)


def events(spark, values, sample="s"):
    return spark.createDataFrame([(sample, i, float(a), float(b), float(i)) for i, (a, b) in enumerate(values)], "sample_id string, event_idx long, c0 double, c1 double, c2 double")


def test_boolean_counts(spark):
    ev = events(spark, [(1, 0), (2, 0), (3, 0), (8, 0)])
    a, b = rect(1, 0, 2), rect(2, 2, 10)
    gates = [a, b, boolean_gate(3, "and", [a, b]), boolean_gate(4, "or", [a, b]), boolean_gate(5, "not", [a])]
    assert [r["n_in"] for r in stats.gate_counts(ev, gates, PANEL).orderBy("ord").collect()] == [2, 3, 1, 4, 2]


def test_unevaluable_gates(spark):
    ev = events(spark, [(1, 0), (2, 0)])
    lost, never = rect(1, 0, 9, channel="PE-A"), rect(2, 50, 60)
    gates = [lost, never, boolean_gate(3, "not", [lost]), boolean_gate(4, "not", [never]), Gate(5, "circle", {"shape": "boolean", "op": "not", "refs": [5]}), rect(6, 0, 9, parent=99)]
    assert [r["n_in"] for r in stats.gate_counts(ev, gates, PANEL).orderBy("ord").collect()] == [0, 0, 0, 2, 0, 2]
    assert missing_channels(gates, PANEL) == ["PE-A"]
    assert GatePlan(gates, PANEL).own[5] is None


def test_nan_lies_in_no_shape(spark):
    ev = events(spark, [(float("nan"), 1), (1, 1)])
    round_ = Gate(1, "r", {"shape": "ellipse", "cx": 1, "cy": 1, "rx": 1, "ry": 1, "angle": 0.3}, None, "FSC-A", "FITC-A")
    field = Gate(2, "f", {"shape": "polygon", "vertices": [[0, 0], [2, 0], [2, 2], [0, 2]]}, None, "FSC-A", "FITC-A")
    line = Gate(3, "l", {"shape": "polygon", "vertices": [[0, 0], [2, 0]]}, None, "FSC-A", "FITC-A")
    assert [r["n_in"] for r in stats.gate_counts(ev, [round_, field, line], PANEL).orderBy("ord").collect()] == [1, 1, 0]


def test_statistics(spark):
    got = stats.channel_stats(events(spark, [(v, 0) for v in (2, 4, 4, 4, 5, 5, 7, 9)]), PANEL).where("channel = 'FSC-A'").first()
    assert (got["mean"], got["median"], got["sd"] ** 2) == (5, 4.5, pytest.approx(32 / 7))
    odd = stats.channel_stats(events(spark, [(2, 1), (float("nan"), 1), (4, 1), (float("inf"), 1), (6, 1)]), PANEL).where("channel = 'FSC-A'").first()
    assert (odd["n"], odd["median"]) == (3, 4)
    one = stats.channel_stats(events(spark, [(3, 1)]), PANEL).where("channel = 'FSC-A'").first()
    assert (one["sd"], one["cv"]) == (0, 0)
    assert spark.range(11).agg(F.percentile(F.col("id").cast("double"), F.lit(0.84))).first()[0] == pytest.approx(8.4)
    assert column(spark, [1000.0], stats.stain_index(F.col("x"), F.lit(100.0), F.lit(50.0))) == [9.0]
    assert column(spark, [1000.0], stats.stain_index(F.col("x"), F.lit(100.0), F.lit(0.0))) == [None]


def close(a, b):
    return all(x == y or (x is not None and y is not None and x == pytest.approx(y, rel=1e-12)) for x, y in zip(a, b, strict=True))


def test_percentiles_by_ranges(spark):
    """The same figures as from one state: ties, outliers that make first steps useless, one value, none."""
    rng = np.random.default_rng(2)
    rows = [("a", float(x), float(y), 0.0) for x, y in zip(rng.normal(0, 1, 3000), rng.integers(0, 5, 3000), strict=True)]
    rows += [("b", float(x), 1.0, 0.0) for x in [*rng.lognormal(0, 3, 500), 1e200, -1e200, float("nan"), float("inf")]] + [("c", 5.0, float("nan"), 0.0), ("d", 1.0, 2.0, 0.0), ("d", 2.0, 2.0, 0.0)]
    ev = spark.createDataFrame(rows, "sample_id string, c0 double, c1 double, c2 double")
    told = lambda df: {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}
    one, many = (told(stats.channel_stats(ev, PANEL, state=n)) for n in (10**9, 0))
    assert one.keys() == many.keys() and len(one) == 8
    for k in one:
        assert close(many[k], one[k])
    gates = [rect(1, -0.5, 3), rect(2, 100, 101, parent=1)]
    one, many = (sorted(map(tuple, stats.population_stats(ev, gates, PANEL, state=n).collect())) for n in (10**9, 0))
    for a, b in zip(one, many, strict=True):
        assert a[:9] == b[:9] and close(a[9:], b[9:])
    found = exact_quantiles(ev.where("sample_id = 'a'"), "c0", (0.0, 0.1, 1.0), ["sample_id"], bins=3).first()
    assert tuple(found)[2:] == pytest.approx(tuple(np.quantile([r[1] for r in rows if r[0] == "a"], (0, 0.1, 1))))


def test_population_rows(spark):
    gates = [rect(1, 0, 5, name="low"), rect(2, 100, 200, parent=1, name="none"), rect(3, 0, 9, parent=77, name="orphan")]
    rows = stats.population_stats(events(spark, [(1, 10), (4, 20), (8, 30)]), gates, PANEL, channels=["fitc-a"]).orderBy("ord").collect()
    assert [(r["population"], r["parent"], r["depth"], r["count"]) for r in rows] == [("All events", "—", 0, 3), ("low", "All events", 1, 2), ("none", "low", 2, 0), ("orphan", "—", 1, 3)]
    assert rows[1]["median"] == 15 and rows[2]["median"] is None and rows[2]["pct_parent"] == 0


def test_gate_lists():
    a, b, c = rect(1, 0, 1), rect(2, 0, 1, parent=1), rect(3, 0, 1, parent=2)
    gates = [a, b, c, boolean_gate(4, "or", [b, c])]
    assert [(g.id, d) for g, d in tree_order(gates)] == [(1, 0), (2, 1), (3, 2), (4, 0)]
    left = delete_gate(gates, 2)
    assert [g.parent for g in left] == [None, 1, None] and left[2].shape["refs"] == [3]
    with pytest.raises(ValueError):
        reparent(gates, 1, 3)
    assert gate_path(gates, 3) == ["All events", "g1", "g2", "g3"]
    assert load_gates(dump_gates(gates)) == gates
    moved = move_quadrant(quadrant_gates(5, 1, "x", "y", 1.0, 1.0), 1, 2.0, 3.0)
    assert moved[1].shape["x_max"] == math.nextafter(2.0, -math.inf) and moved[0].shape["x_min"] == 2.0
    with pytest.raises(ValueError):
        boolean_gate(9, "not", [a, b])
    assert default_transforms(PANEL, {"FITC-A": Transform("asinh")})["fitc-a"].kind == "asinh"


def test_matrix(spark):
    m = Spillover.parse("2,FITC-A,FSC-A,1,0.2,0.1,1,extra")
    assert Spillover.parse(m.format()) == m == Spillover.load(m.to_csv()) == Spillover.load(m.to_json())
    true = np.array([[100.0, 50.0], [7.0, 3.0]])
    seen = true @ np.array(m.matrix)
    got = compensate(events(spark, [(b, a) for a, b in seen]), PANEL, m).orderBy("event_idx").select("c1", "c0").collect()
    assert np.array(got) == pytest.approx(true)
    for bad in ("2,A,B,1,1,1,1", "2,A,B,1,0"):
        with pytest.raises(ValueError):
            _ = Spillover.parse(bad).inverse
    with pytest.raises(ValueError):
        compensate(events(spark, [(1, 1)]), PANEL, Spillover(("X",), ((1.0,),)))
    assert choose_spillover(True, None, m.format()) == m and choose_spillover(False, m, None) is None and m.max_off_diagonal == 0.2
    assert [r[0] for r in spark.createDataFrame([(5000, 1024.0), (5000, 0.0)], "v long, r double").select(range_mask(F.col("v"), F.col("r"))).collect()] == [904, 5000]


def test_spillover_from_controls(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, a, b in (("none", 0, 0), ("fitc", 10000, 1000), ("pe", 200, 10000)):
        for i in range(400):
            on = i % 2
            rows.append((name, i, float(rng.normal(10, 1) + on * a), float(rng.normal(10, 1) + on * b)))
    ev = spark.createDataFrame(rows, "sample_id string, event_idx long, c0 double, c1 double")
    m = autogate.compute_spillover(ev, Panel(("FITC-A", "PE-A")), autogate.Controls("none", ("fitc", "pe")))
    assert np.array(m.matrix) == pytest.approx(np.array([[1, 0.1], [0.02, 1]]), abs=0.005)


def test_valley(spark):
    rng = np.random.default_rng(3)
    rows = {"two": [*rng.normal(1, 0.4, 3000), *rng.normal(5, 0.4, 3000)], "rare": [*rng.normal(1, 0.4, 9500), *rng.normal(5, 0.4, 500)], "one": rng.normal(3, 0.8, 4000), "few": [1.0, 5.0] * 20, "flat": [2.0] * 90}
    values = spark.createDataFrame([(k, float(v)) for k, vs in rows.items() for v in vs] + [("two", float("nan")), ("two", float("inf"))], "k string, v double")
    found = {r["k"]: r for r in autogate.valley_table(values, "v", 128, ["k"]).collect()}
    assert 2 < found["two"]["threshold"] < 4 and found["two"]["depth"] > 0.7 and found["two"]["top"] == max(rows["two"])
    assert 2 < found["rare"]["threshold"] < 4.5
    assert [found[k]["threshold"] for k in ("one", "few", "flat")] == [None] * 3
    counts = spark.createDataFrame([([60] * 8,), ([10, 0, 0, 0, 0, 0, 0, 10],)], "c array<long>")
    told = [r[0] for r in counts.select(autogate.valley(F.col("c"), F.lit(0.0), F.lit(8.0), F.lit(84), 8)).collect()]
    assert told == [None, None]


def test_valley_by_hand(spark):
    """Smoothing, peaks and the first lowest bin between the two tallest, step by step."""
    rng = np.random.default_rng(8)
    for bins in (24, 60, 128):
        counts = [int(x) for x in rng.integers(0, 40, bins)]
        w, y = max(bins // 48, 1), np.array(counts, float)
        for _ in range(3):
            y = np.array([sum(y[max(i - w, 0) : i + w + 1]) / len(y[max(i - w, 0) : i + w + 1]) for i in range(bins)])
        peaks = [i for i in range(1, bins - 1) if y[i] >= y[i - 1] and y[i] >= y[i + 1] and (y[i] > y[i - 1] or y[i] > y[i + 1]) and y[i] >= 0.02 * y.max()]
        first, last = sorted(sorted(peaks, key=lambda i: -y[i])[:2])
        at = first + int(np.argmin(y[first : last + 1]))
        low = min(y[first], y[last])
        df = spark.createDataFrame([(counts,)], "c array<long>")
        got = df.select(autogate.valley(F.col("c"), F.lit(-3.0), F.lit(5.0), F.lit(sum(counts)), bins).alias("v")).first()["v"]
        assert tuple(got) == pytest.approx((-3 + (at + 0.5) / bins * 8, (low - y[at]) / low))


def test_flow_rate(spark):
    even = spark.createDataFrame([("a", float(i)) for i in range(2000)] + [("flat", 1.0)] * 5, "sample_id string, t double")
    got = {r["sample_id"]: r for r in qc.flow_rate(even, "t").collect()}
    assert got["a"]["n_bins"] == 20 and got["a"]["max_dev_pct"] < 2 and got["flat"]["counts"] is None
    odd = spark.createDataFrame([("a", float(i)) for i in range(150)] + [("a", float("nan"))] * 50, "sample_id string, t double")
    assert qc.flow_rate(odd, "t").first()["n_bins"] == 2


def test_qc_flags(spark):
    rows = [("low", i, float(i), 990.0 if i < 2 else 1.0, float(i)) for i in range(200)] + [("good", i, 1.0, 1.0, float(i)) for i in range(6000)]
    ev = spark.createDataFrame(rows, "sample_id string, event_idx long, c0 double, c1 double, c2 double")
    live = [rect(1, 0, 40), rect(2, 0, 9, parent=1)]
    lost = spark.createDataFrame([("bad", "no header")], "sample_id string, reason string")
    scan = {r["sample_id"]: r for r in qc.qc_scan(ev, PANEL, {"fitc-a": 990.9, "Time": 200.0, "FSC-A": 1.0}, "c2", (live, 1), skipped=lost).collect()}
    assert scan["low"]["flags"] == ["low events (200)", "low viability (20%)"] and scan["low"]["offscale_pct"] == 1.0
    assert scan["good"]["offscale_channel"] == "Time" and scan["good"]["flags"] == ["96.7% off-scale on Time"]
    assert (scan["bad"]["n_events"], scan["bad"]["flags"], scan["bad"]["viable"]) == (0, ["skipped: no header"], None)
    assert {r["sample_id"]: r["viable"] for r in qc.qc_scan(ev, PANEL, {}, None, (live, 2)).collect()} == {"low": pytest.approx(100 * 10 / 41), "good": 100.0}
    assert qc.qc_scan(ev, PANEL, {}, None, (live, 9), ev).first()["viable"] is None
    only = qc.qc_scan(ev, PANEL, {}, None, (live, 1), ev.where("sample_id = 'low'")).collect()
    assert {r["sample_id"]: r["viable"] for r in only} == {"low": 20.5, "good": None}


def test_batch_skips(spark):
    ev = events(spark, [(1, 1)])
    found, skipped = batch({"a": (PANEL, ev), "b": (Panel(("SSC-A",), ("c0",)), ev)}, [rect(1, 0, 5)])
    assert [s[0] for s in skipped] == ["b"] and found.count() == 4
    assert channel_union([PANEL, Panel(("FITC-A", "PE-A"))]) == ["FSC-A", "fitc-a", "PE-A"]


def test_density(spark):
    values = [0.0, -5.0, 10.0, 11.0, float("nan"), 5.0]
    assert column(spark, values, density.clamped_bin(F.col("x"), 0.0, 10.0, 10)) == [0, 0, 9, 9, 0, 5]
    assert column(spark, [0, 50, 81, 90, 100], density.heat_bucket(F.col("x"), F.lit(100.0))) == [0, 9, 11, 12, 13]
    ev = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", float("nan"), 5.0), ("b", float("inf"), None)], "s string, x double, y double")
    assert {tuple(r) for r in density.display_box(ev, F.col("x"), F.col("y"), ["s"]).collect()} == {("a", 1.0, 3.0, 5.0, 6.0), ("b", 0.0, 1.0, 0.0, 1.0)}
    assert sorted(tuple(r)[5:] for r in density.density_grid(ev.where("s = 'a'"), F.col("x"), F.col("y"), ["s"], 4).collect()) == [(0, 0, 2), (3, 0, 1)]


def segments(spark, corners, level=0.5):
    """Lines of one cell over the square from 0 to 2, whose corner bins are centred on 0.5 and 1.5."""
    rows = [("t", 0.0, 2.0, 0.0, 2.0, x, y, n) for (x, y), n in zip([(0, 0), (1, 0), (1, 1), (0, 1)], corners, strict=True) if n]
    grid = spark.createDataFrame(rows, "s string, x0 double, x1 double, y0 double, y1 double, bx int, by_ int, n long")
    return [tuple(r)[5:] for r in density.contours(grid, ["s"], 2, (level,)).orderBy("part").collect()]


def test_contours(spark):
    left, bottom, right, top = (0.5, 1.0), (1.0, 0.5), (1.5, 1.0), (1.0, 1.5)
    want = {(9, 0, 0, 0): [left, bottom], (0, 9, 0, 0): [bottom, right], (0, 0, 9, 0): [right, top], (0, 0, 0, 9): [left, top], (9, 9, 0, 0): [left, right], (9, 0, 0, 9): [bottom, top]}
    want |= {(9, 0, 9, 0): [left, bottom, right, top], (0, 9, 0, 9): [bottom, right, top, left]}
    for corners, points in want.items():
        assert segments(spark, corners) == [(*a, *b) for a, b in zip(points[::2], points[1::2], strict=True)]
    assert segments(spark, (9, 9, 9, 9)) == [] and segments(spark, (8, 4, 0, 0)) == [(0.5, 1.0, 1.5, 0.5)]  # a corner at the level isn't over it


def test_samples_of_a_population(spark):
    ev = spark.createDataFrame([(s, 3 * i, float(i)) for s in "ab" for i in range(1000 if s == "a" else 10)], "sample_id string, event_idx long, c0 double")
    placed = density.population_index(ev, F.col("c0") >= 5, width=100)
    assert {(r["sample_id"], r["c0"] - 5, r["n_members"]) for r in placed.collect()} == {(r["sample_id"], r["position"], r["n_members"]) for r in placed.collect()}
    got = density.stride_sample(ev, F.col("c0") >= 5, 100).collect()
    assert sorted(r["c0"] for r in got if r["sample_id"] == "a") == list(range(5, 1000, 9)) and sum(r["sample_id"] == "b" for r in got) == 5
    both = density.backgate(ev.where("sample_id = 'a'"), F.col("c0") >= 995, F.col("c0") >= 900, 5, 10).collect()
    assert sorted(r["c0"] for r in both if r["layer"] == "population") == list(range(995, 1000)) and sorted(r["c0"] for r in both if r["layer"] == "parent") == list(range(900, 1000, 10))


def test_reference_overlay(spark):
    ev = events(spark, [(i, 10 * i) for i in range(100)])
    got = density.reference_overlay(ev, PANEL, ("fsc-a", Transform()), ("FITC-A", Transform("log")), most=10).orderBy("x").collect()
    assert [r["x"] for r in got] == list(range(0, 100, 10)) and got[1]["y"] == 2.0
    assert density.reference_overlay(ev, PANEL, ("PE-A", Transform()), ("FITC-A", Transform())) is None


def test_deepest_population(spark):
    gates = [rect(1, 0, 9, name="a"), rect(2, 2, 9, parent=1, name="b"), rect(3, 2, 5, parent=1, name="c"), rect(4, 4, 5, parent=99, name="lost")]
    got = [(r["population"], r["depth"], r["path"]) for r in deepest_population(events(spark, [(1, 0), (3, 0), (20, 0), (4, 0)]), gates, PANEL).orderBy("event_idx").collect()]
    assert got == [(1, 1, ["All events", "a"]), (2, 2, ["All events", "a", "b"]), (None, None, ["All events"]), (2, 2, ["All events", "a", "b"])]


def test_probes(spark):
    golden = spark.createDataFrame([("x", None, "1", 10.0), ("x", "c", "2", 0.0), ("y", None, "1", 1.0), ("z", None, "1", 1.0)], "layer string, channel string, key string, value double")
    computed = spark.createDataFrame([("x", None, "1", 10.0001), ("x", "c", "2", 5e-6), ("z", None, "1", float("nan")), ("z", None, "2", 3.0)], golden.schema)
    got = {r["layer"]: r for r in compare_probes(golden, computed).collect()}
    assert (got["x"]["probes"], got["x"]["missing"], got["x"]["pass"]) == (2, 0, True) and got["x"]["max_dev"] == pytest.approx(1e-4 / 11)
    assert (got["y"]["missing"], got["y"]["pass"]) == (1, False) and (got["z"]["unknown"], got["z"]["pass"]) == (1, False)
    published = [(n, None, str(x), v) for n, t in (("asinh", ASINH), ("logicle", LOGICLE)) for x, v in t.items()]
    shown = [(n, None, str(x), float(x)) for n, t in (("asinh", ASINH), ("logicle", LOGICLE)) for x in t]
    own = spark.createDataFrame(shown, golden.schema).withColumn("value", F.when(F.col("layer") == "asinh", forward(F.col("value"), Transform("asinh"))).otherwise(forward(F.col("value"), Transform("logicle"))))
    assert all(r["pass"] and r["probes"] == 7 for r in compare_probes(spark.createDataFrame(published, golden.schema), own).collect())


def test_tubes_with_their_own_matrices(spark):
    rng = np.random.default_rng(4)
    names = ["FSC-A", "A", "B", "C", "Time"]
    true = {s: rng.normal(0, 100, (6, 5)) for s in "abcdefghi"}
    m3 = np.array([[0.0, 0.2, 1.0], [1.0, 0.1, 0.0], [0.3, 1.0, 0.2]])
    text = lambda names, m: f"{len(names)},{','.join(names)}," + ",".join(map(str, np.ravel(m)))
    words = {"a": {"$SPILLOVER": text(["b", "a"], [[1, 0.5], [0.25, 1]]), "SPILL": "broken"}, "b": {"SPILL": text("CAB", m3)}, "c": {}, "d": {"SPILL": text("AB", [[1, 1], [1, 1]])}}
    words |= {"e": {"SPILL": text("AX", np.eye(2))}, "f": {"SPILL": "2,A,B,1,0,0"}, "g": {"SPILL": text("AB", [[1, 1], [1, 1 + 1e-9]])}, "h": {"SPILL": "2,A,B,1,0,nan,1"}, "i": {"SPILL": text("AB", np.eye(2))}}
    tubes = spark.createDataFrame([(s, names if s != "i" else names[1:], w) for s, w in words.items()], "sample_id string, channels array<string>, keywords map<string,string>")
    seen = {s: v.copy() for s, v in true.items()}
    seen["a"][:, [2, 1]] = true["a"][:, [2, 1]] @ np.array([[1, 0.5], [0.25, 1]])
    seen["b"][:, [3, 1, 2]] = true["b"][:, [3, 1, 2]] @ m3
    seen["a"][0, 0] = np.nan
    rows = [(s, i, *map(float, v)) for s, vs in seen.items() if s != "i" for i, v in enumerate(vs)]
    ev = spark.createDataFrame(rows, "sample_id string, event_idx long, c0 double, c1 double, c2 double, c3 double, c4 double")
    got = compensate_tubes(ev, Panel(tuple(names)), tube_matrices(tubes.where("sample_id <> 'i'"))).orderBy("sample_id", "event_idx").collect()
    assert [r["sample_id"] for r in got[::6]] == ["a", "b", "c"]
    for r in got:
        assert tuple(r)[3:] == pytest.approx(true[r["sample_id"]][r["event_idx"]][1:])
    gates = [rect(1, -1e9, 1e9, channel="FSC-A")]
    found, skipped = batch_tubes({"p": (Panel(tuple(names)), ev)}, gates, tubes)
    failed = "compensation failed: "
    assert {r["sample_id"]: r["reason"] for r in skipped.collect()} == {"d": failed + "the matrix is singular", "e": failed + "no channel X", "f": failed + "the matrix can't be read", "g": failed + "the matrix is ill-conditioned", "h": failed + "the matrix can't be read", "i": "missing channels: FSC-A"}
    assert {r["sample_id"] for r in found.collect()} == {"a", "b", "c"}
    over = batch_tubes({"p": (Panel(tuple(names)), ev)}, gates, tubes, Spillover(("A", "B"), ((1.0, 0.0), (0.0, 1.0))))
    assert [r["sample_id"] for r in over[1].collect()] == ["i"] and over[0].select("sample_id").distinct().count() == 8
    assert batch_tubes({"p": (Panel(tuple(names)), ev)}, gates, tubes, on=False)[1].count() == 1


def test_spillover_of_bad_controls(spark):
    rng = np.random.default_rng(1)
    ev = spark.createDataFrame([(n, float(rng.normal(10, 1) + a), float(rng.normal(10, 1) + b)) for n, a, b in (("none", 0, 0), ("x", 500, 50), ("y", 900, 20), ("dim", -50, -50)) for _ in range(200)], "sample_id string, c0 double, c1 double")
    panel = Panel(("FITC-A", "PE-A"))
    table = lambda *stains: {r["control"]: r["reason"] for r in autogate.spillover_table(ev, panel, autogate.Controls("none", stains)).collect()}
    assert table("x", "y") == {"x": "its channel is another control's", "y": "its channel is another control's"}
    assert table("x", "dim") == {"x": None, "dim": "no signal"} and table("x", "gone")["gone"] == "the control or the unstained one has no events"
    assert set(table("x").values()) == {"there is one control for each channel"}
    with pytest.raises(ValueError):
        autogate.compute_spillover(ev, panel, autogate.Controls("none", ("x", "y")))


def test_fcs_round_trip(spark, tmp_path):
    values = np.array([[1.5, -2.0], [3.0, 4.25], [5.0, 1e5]])
    raw = fcs.to_bytes(values, ["FSC-A", "FITC-A"], ["", "CD3"], {"$CYT": "x|y", "NOTE": "", "TUBE": "7"}, "2,A,B,1,0,0,1")
    head = fcs.read_header(raw)
    assert fcs.decode(head, raw[head.data_start : head.data_end + 1]) == pytest.approx(values)
    assert head.keywords["$CYT"] == "x|y" and head.keywords["SPILL"].startswith("2,") and "NOTE" not in head.keywords
    assert fcs.peek_events(raw) == 3
    (tmp_path / "t1.fcs").write_bytes(raw)
    (tmp_path / "bad.fcs").write_bytes(b"FCS9.9" + raw[6:])
    panels, rejects = fcs.read_panels(spark, str(tmp_path))
    panel, ev = panels[("FSC-A", "FITC-A")]
    assert [tuple(r)[2:] for r in ev.orderBy("event_idx").collect()] == [tuple(v) for v in values]
    assert rejects.count() == 1
    meta = fcs.info(fcs.read_metadata(spark, str(tmp_path / "t1.fcs"))).first()
    assert meta["cytometer"] == "x|y" and meta["channels"] == ["FSC-A", "FITC-A"]
    out = save_events(ev, panel, str(tmp_path / "out")).collect()
    assert out[0]["n_events"] == 3 and (tmp_path / "out" / "t1.fcs").exists()
    with pytest.raises(fcs.FcsError):
        fcs.to_bytes(values[:0], ["a", "b"])


def test_gated_export_keeps_each_tube_own_keywords(spark, tmp_path):
    values = np.array([[1.0, 5.0], [2.0, 6.0], [3.0, 7.0]])
    for i, spill in ((1, "2,FSC-A,FITC-A,1,0.1,0,1"), (2, None)):
        (tmp_path / f"t{i}.fcs").write_bytes(fcs.to_bytes(values * i, ["FSC-A", "FITC-A"], ["", f"CD{i}"], {"TUBE": str(i), "$P2R": "1024"}, spill))
    panel, ev = fcs.read_panels(spark, str(tmp_path))[0][("FSC-A", "FITC-A")]
    meta = fcs.read_metadata(spark, str(tmp_path))
    originals = fcs.samples(meta).join(meta.select("path", "keywords"), "path")
    out = fcs.export_population(ev, F.col("c0") >= 2, panel, originals, "Cells +", str(tmp_path / "out")).collect()
    assert sorted((r["sample_id"], r["n_events"]) for r in out) == [("t1", 2), ("t2", 3)]
    for i in (1, 2):
        h = fcs.read_header((tmp_path / "out" / f"t{i}_Cells__.fcs").read_bytes())
        assert (h.keywords["TUBE"], h.keywords["$P2S"], h.keywords["$P2R"]) == (str(i), f"CD{i}", "1024") and ("$SPILLOVER" in h.keywords) == (i == 1)
    assert sorted(r["n_events"] for r in fcs.peek_files(spark, str(tmp_path / "out")).collect()) == [2, 3]


def test_ranges_of_events_and_whole_files_agree(spark, tmp_path):
    values = np.arange(2 * 70_001, dtype=float).reshape(-1, 2)
    (tmp_path / "big.fcs").write_bytes(fcs.to_bytes(values, ["a", "b"]))
    meta = fcs.read_metadata(spark, str(tmp_path))
    assert meta.collect() == fcs.read_metadata(spark, str(tmp_path), whole=True).collect()
    got = fcs.decode_ranges(meta, 2, chunk=9_000).orderBy("event_idx").toPandas()
    assert got["event_idx"].tolist() == list(range(70_001)) and np.array_equal(got[["c0", "c1"]].to_numpy(), values)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert fcs.decode_files(files, 2, chunk=9_000).orderBy("event_idx").toPandas().equals(got)


def test_bounds_on_data_hold_wherever_the_gate_does(spark):
    values = [float(x) for x in np.random.default_rng(9).normal(0, 2000, 400)] + [-1e5, 1e5, 0.0]
    ev = spark.createDataFrame([(v, v / 2, 0.0) for v in values], "c0 double, c1 double, c2 double")
    for tf in (Transform(), Transform("log"), Transform("asinh"), Transform("logicle")):
        for shape in ({"shape": "range", "x_min": 0.5, "x_max": 2.0}, {"shape": "rect", "x_min": -1.0, "x_max": 2.5, "y_min": 0.1, "y_max": 1e12}):
            g = Gate(1, "g", shape, None, "FSC-A", "FITC-A", tf, tf)
            inside = ev.where(GatePlan([g], PANEL).effective(1))
            assert inside.count() == inside.where(data_bounds(g, PANEL)).count()


def test_session():
    gates = [rect(1, 0, 5), rect(4, 0, 5, parent=1)]
    kept = Session(("a.fcs", "b.fcs", "c.fcs"), ("x", "", "y"), 2, True, (Transform("asinh"),), tuple(gates), {"channels": ["A"], "rows": [[1.0]]}, {"x_ch": 1})
    assert Session.load(kept.dump()) == kept and kept.next_gate_id == 5
    left = Session.load(kept.dump(), ["b.fcs", "c.fcs"])
    assert (left.paths, left.groups, left.active) == (("b.fcs", "c.fcs"), ("", "y"), 1)
    assert Session.load(kept.dump(), ["a.fcs"]).active == 0
    odd = kept.dump().replace('"A"', '"A", "B"')
    assert Session.load(odd).spillover is None
    with pytest.raises(ValueError):
        Session.load(kept.dump(), [])


def test_gate_at_a_point():
    field = Gate(3, "f", {"shape": "polygon", "vertices": [[0, 0], [2, 0], [2, 2], [0, 2]]}, 1, "FSC-A", "fitc-a")
    round_ = Gate(4, "r", {"shape": "ellipse", "cx": 1, "cy": 1, "rx": 1, "ry": 0.5, "angle": math.pi / 2}, 3, "FSC-A", "FITC-A")
    log = Gate(5, "l", {"shape": "rect", "x_min": 2, "x_max": 4, "y_min": 0, "y_max": 9}, None, "FSC-A", "FITC-A", Transform("log"))
    gates = [rect(1, 0, 5), field, round_, log]
    at = lambda x, y, *tf: gate_at(gates, "fsc-a", "FITC-A", x, y, *tf)
    assert at(1, 1.9) == 4 and at(1.9, 1) == 3 and at(1000, 1) == 5 and at(50, 50) is None
    assert at(math.asinh(1000 / 150), 1, Transform("asinh")) == 5
    assert gate_at(gates, "FSC-A", "PE-A", 1, 1) is None


def test_suggested_gates(spark):
    rng = np.random.default_rng(5)
    panel = Panel(("fsc-a", "FSC-Width-H", "FITC-A", "Time"))
    area = rng.uniform(1e4, 1e5, 2000)
    rows = [(float(a * (1 + 0.01 * np.sin(i))), float(a * 0.5), float(v), 0.0) for i, (a, v) in enumerate(zip(area, np.concatenate([rng.normal(50, 20, 1200), rng.normal(9000, 900, 800)]), strict=True))]
    ev = spark.createDataFrame(rows, "c0 double, c1 double, c2 double, c3 double")
    g = autogate.singlet_gate(7, panel, ev, parent=1)
    order = np.sort(area) * 0.5
    assert (g.x_channel, g.y_channel, g.parent) == ("fsc-a", "FSC-Width-H", 1)
    assert [v[1] for v in g.shape["vertices"]] == [order[int(1999 * p)] for p in (0.02, 0.98, 0.98, 0.02)]
    assert [v[0] / v[1] for v in g.shape["vertices"]] == pytest.approx([1.7, 1.7, 2.3, 2.3], rel=0.02)
    assert autogate.singlet_gate(7, panel, ev.limit(49)) is None
    up = autogate.auto_threshold(8, panel, ev, "fitc-a", Transform("asinh"))
    assert 0.6 < up.shape["x_min"] < 4.2 and up.shape["x_max"] == pytest.approx(math.asinh(max(r[2] for r in rows) / 150))
    assert autogate.auto_threshold(8, panel, ev, "Time", Transform()) is None and autogate.singlet_gate(1, Panel(("FSC-A",)), ev) is None


def test_own_cuts_of_the_cross_check(spark):
    rng = np.random.default_rng(6)
    rows = [("s", float(x), float(0.04 * x + rng.normal(0, 1)), float(y)) for x, y in zip(np.concatenate([rng.normal(20, 90, 500), rng.normal(8000, 900, 500)]), rng.normal(100, 5, 1000), strict=True)]
    ev = spark.createDataFrame(rows, "sample_id string, c0 double, c1 double, c2 double")
    panel = Panel(("FITC-A", "PE-A", "APC-A"))
    got = {(r["source"], r["target"]): r["residual"] for r in autogate.cross_check(ev, panel, transforms={n: Transform("asinh") for n in panel.channels}).collect()}
    assert got["FITC-A", "PE-A"] == pytest.approx(0.04, abs=0.002) and abs(got["FITC-A", "APC-A"]) < 0.002
    assert [r[0] for r in spark.createDataFrame([(0.019,), (-0.03,), (0.05,), (None,)], "r double").select(autogate.residual_grade(F.col("r"))).collect()] == ["good", "fair", "poor", None]


def test_report_and_bundle(spark, tmp_path):
    gates = [rect(1, 0, 5, name="<low>"), rect(2, 1, 2, parent=1, name="in"), boolean_gate(3, "not", [rect(1, 0, 5)])]
    found = stats.population_stats(events(spark, [(1, 10), (4, 20), (8, 30)]), gates, PANEL).withColumn("group", F.lit("a"))
    m = Spillover(("FSC-A", "fitc-a"), ((1.0, 0.1), (0.0, 1.0)))
    parts = sinks.report_sections({"file": "t.fcs", "events": 3}, PANEL, ["", "CD3", None], {"fitc-a": Transform("asinh")}, gates, [r.asDict() for r in found.orderBy("ord").collect()], True, m)
    assert list(parts) == ["Sample", "Channels and transforms", "Compensation", "Compensation source", "Gating strategy", "Population statistics", "Gates as JSON"]
    page = sinks.html_report(parts)
    assert "asinh 150" in page and "&lt;low&gt;" in page and "0.1000" in page and "NOT of 1 gates" in page
    assert load_gates(parts["Gates as JSON"]) == gates and [r[0].strip() for r in parts["Population statistics"][1]] == ["All events", "<low>", "in", "NOT g1"]
    bare = sinks.report_sections({}, PANEL, [None] * 3, {}, [], None, False)
    assert bare["Compensation"].startswith("Not applied") and bare["Gating strategy"] == "No gates."
    script = sinks.r_bundle(found, str(tmp_path))
    assert 'levels = c("a")' in script and "<low>" in script
    table = spark.read.option("header", True).csv(str(tmp_path / "populations.csv"))
    assert table.columns == ["group", *sinks.POPULATION] and table.count() == found.count()
    header, rows = sinks.sheet_rows(found, "group")
    assert header[-1] == "rsd" and len(rows) == found.count() and sinks.xlsx(header, rows)[:2] == b"PK"
    assert sinks.tsv(found.select("population", "median").where("population = 'in' AND channel = 'FSC-A'")).first()[0].startswith("in\t")


def test_masks_of_wide_ranges(spark):
    rows = [(-1 & (2**62 - 1), float(2**53 + 2)), (2**62 + 5, float(2**62)), (7, 1.0), (9, 1.5), (1025, 1025.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "v long, r double").select(range_mask(F.col("v"), F.col("r"))).collect()]
    assert got == [2**54 - 1, 5, 0, 9, 1025]


def test_fcs_integers():
    text = b"/$PAR/1/$TOT/2/$DATATYPE/I/$BYTEORD/2,1/$P1N/a//b/$P1B/16/$P1R/1024/"
    begin = 58 + len(text)
    head = b"FCS3.0    " + b"".join(f"{x:>8d}".encode() for x in (58, begin - 1, begin, begin + 3, 0, 0))
    raw = head + text + (5000).to_bytes(2, "big") + (3).to_bytes(2, "big")
    h = fcs.read_header(raw)
    assert h.channels()[0]["name"] == "a/b" and fcs.decode(h, raw[begin:])[:, 0].tolist() == [904, 3]
    with pytest.raises(fcs.FcsError):
        fcs.read_header(raw[:-1])


def test_stream(spark, tmp_path):
    from gatewise.streaming.ingest import ingest, stream_events

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1.fcs").write_bytes(fcs.to_bytes(np.ones((4, 2)), ["a", "b"]))
    ingest(stream_events(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_exports(spark):
    gates = [rect(1, -1e12, 5), Gate(2, "e", {"shape": "ellipse", "cx": 1, "cy": 1, "rx": 1, "ry": 2, "angle": 0}, 1, "a<b", "y"), boolean_gate(3, "not", [rect(1, 0, 5)])]
    xml, warnings = sinks.gating_ml(gates)
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(xml.split("\n", 1)[1])) == 3 and not warnings and "min=" not in xml.split("</gating:RectangleGate>")[0]
    wide = Gate(7, "wide", {"shape": "range", "x_min": 1.0, "x_max": 1000.0}, None, "FITC-A", "FITC-A", Transform("asinh"), Transform("asinh"))
    lost = [wide, Gate(8, "wide", {"shape": "boolean", "op": "and", "refs": [99]}), Gate(9, "p", {"shape": "polygon", "vertices": [[0, 0], [1, 0], [1, 1]]}, 77, "FITC-A", "SSC-A", Transform("asinh"))]
    xml, warnings = sinks.gating_ml(lost, ["FITC-A"], compensated=True)
    assert len(ET.fromstring(xml.split("\n", 1)[1])) == 2 and len(warnings) == 2 and "max=" not in xml and "parent_id" not in xml
    assert xml.count('compensation-ref="FCS"') == 2 and xml.count('compensation-ref="uncompensated"') == 1
    assert sinks.gating_ml([wide])[0].count("uncompensated") == 1
    assert sinks.gate_idents([wide, Gate(8, "wide", {}), Gate(3, "a b+", {}), Gate(4, "", {})]) == {7: "wide", 8: "wide_8", 3: "a_b_", 4: "gate_4"}
    assert sinks.xlsx(["a", "b"], [(1, "x"), (float("nan"), None)])[:2] == b"PK"
    assert "&lt;b&gt;" in sinks.html_report({"<b>": (["h"], [(1.0,)])})
    assert "wilcox" in sinks.r_script("f.csv", ["a", "b"], ["p"]) and "kruskal" in sinks.r_script("f", ["a", "b", "c"], ["p"])
    none = sinks.r_script("f.csv", [], ["All events", 'B "x"'])
    assert "levels" not in none and ".test(" not in none and r'"B \"x\""' in none
    table = sinks.population_table(stats.population_stats(events(spark, [(1, 1)]), [rect(1, 5, 6)], PANEL, channels=["FSC-A"]).orderBy("ord"))
    assert table.columns == sinks.POPULATION and table.collect()[1]["median"] == "NA"
    assert column(spark, [1.23456, float("inf")], csv_number(F.col("x"))) == ["1.2346", "NA"]
    df = spark.createDataFrame([(" 1.5 ", "my_PE-Cy7 tube"), ("x", "pe"), ("inf", "none")], "t string, f string")
    assert [r[0] for r in df.select(numeric_tag(F.col("t"))).collect()] == [1.5, None, None]
    assert [r[0] for r in df.select(file_token(F.col("f"), ["PE-A", "PE-Cy7-A"])).collect()] == ["PE-Cy7-A", None, None]


def test_boolean_over_orphans(spark):
    """A NOT of a gate below an unknown parent, or in a circle of parents, holds nothing; of a merely empty gate, everything."""
    gates = [rect(1, 0, 5, parent=77, name="orphan"), rect(2, 0, 5, parent=3, name="a"), rect(3, 0, 5, parent=2, name="b"), rect(4, 90, 99, name="empty")]
    nots = [boolean_gate(10 + g.id, "not", [g]) for g in gates]
    df = GatePlan([*gates, *nots], PANEL).add_masks(events(spark, [(1, 1), (8, 8)]))
    assert [df.where(f"g{g.id}").count() for g in nots] == [0, 0, 0, 2]
    assert df.where("g1").count() == 1


def test_renamed_quadrant_moves():
    one = quadrant_gates(5, 1, "x", "y", 1.0, 1.0)
    renamed = [replace(g, name="any") for g in one]
    assert [g.shape for g in move_quadrant(renamed, 1, 2.0, 3.0)] == [g.shape for g in quadrant_gates(5, 1, "x", "y", 2.0, 3.0)]


def test_gating_ml_read_again():
    gates = [Gate(1, "a", {"shape": "rect", "x_min": 0.0, "x_max": 5.0, "y_min": -1.0, "y_max": 2.0}, None, "FSC-A", "FITC-A"), Gate(2, "b", {"shape": "range", "x_min": -1e12, "x_max": 7.5}, 1, "FSC-A", "FSC-A"), Gate(3, "c", {"shape": "polygon", "vertices": [[0.0, 1.0], [2.0, 3.0], [4.0, -1.5]]}, 2, "FSC-A", "fitc-a")]
    gates.append(boolean_gate(4, "or", [gates[0], gates[2]], parent=1))
    back = read_gating_ml(sinks.gating_ml(gates)[0])
    assert [(g.name, g.parent, g.kind) for g in back] == [("a", None, "rect"), ("b", 1, "range"), ("c", 2, "polygon"), ("a_OR_c", 1, "boolean")]
    assert back[0].shape == gates[0].shape and back[1].shape["x_min"] == -math.inf and back[1].shape["x_max"] == 7.5 and back[2].shape == gates[2].shape and back[3].shape["refs"] == [1, 3]
    text = sinks.gating_ml(gates[:1])[0]
    with pytest.raises(ValueError):
        read_gating_ml(text.replace("RectangleGate", "QuadrantGate"))
    with pytest.raises(ValueError):
        read_gating_ml(text.replace("<gating:dimension ", '<gating:dimension gating:transformation-ref="t" ', 1))
    assert read_gating_ml(sinks.gating_ml([replace(gates[0], parent=None)])[0].replace("<gating:RectangleGate ", '<gating:RectangleGate gating:parent_id="gone" '))[0].parent == 0


def test_numbers_of_matrix_files():
    m = Spillover(("a", "b"), ((1.0, 1e-7), (0.1, 1e20)))
    assert m.format() == "2,a,b,1,0.0000001,0.1,100000000000000000000" and Spillover.parse(m.format()) == m == Spillover.load(m.to_csv())
