"""Queries over the test tables, and the same in SQL for DuckDB.

Tubes are simulated from ``lineitem``: a tube is a return flag and line status; price, quantity,
discount and tax stand for FSC-A, SSC-A, FITC-A and PE-A, the ship day for Time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .functions.transforms import asinh_panel, forward, inverse, inverse_value, logicle
from .model import Gate, Panel, Session, Transform, boolean_gate, default_transforms, delete_gate, move_quadrant, quadrant_gates, reparent
from .operators import autogate, qc, stats
from .operators.batch import batch, batch_tubes, channel_names, chart_series
from .operators.compensation import Spillover, choose_spillover, compensate, parsed_spillover, range_mask, spillover_keyword, tube_matrices
from .operators.density import backgate, contours, density, density_grid, heat_bucket, overlay, stride_sample
from .operators.selfcheck import compare_probes
from .plans.gates import GatePlan, deepest_population, missing_by_sample
from .sources import fcs, sinks
from .sources.fcs_source import read_events, read_files, save_events, stream_events
from .sources.gating_ml import read_gating_ml
from .sources.shared import local_logs, shared_folder
from .streaming.ingest import store

PANEL = Panel(("FSC-A", "SSC-A", "FITC-A", "PE-A", "Time"))
SPILL = Spillover(("FITC-A", "PE-A"), ((1.0, 0.08), (0.03, 1.0)))
ASINH, LOGICLE = Transform("asinh", cofactor=150.0), Transform("logicle")
TUBES = """tubes AS (
  SELECT l_returnflag || l_linestatus AS sample_id, l_orderkey * 10 + l_linenumber AS event_idx, l_extendedprice AS c0, l_quantity AS c1,
         l_discount * 1e5 AS c2, l_tax * 1e5 AS c3, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS c4 FROM lineitem
)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("double")
    cols = [F.concat("l_returnflag", "l_linestatus").alias("sample_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_idx")]
    cols += [F.col("l_extendedprice").alias("c0"), F.col("l_quantity").alias("c1"), (F.col("l_discount") * 1e5).alias("c2"), (F.col("l_tax") * 1e5).alias("c3"), day.alias("c4")]
    return _table(spark, sf_dir, "lineitem").select(*cols)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[formats.rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CELLS = Gate(1, "Cells", {"shape": "rect", "x_min": 20000.5, "x_max": 80000.5, "y_min": 9.5, "y_max": 45.5}, None, "FSC-A", "SSC-A")
FITC = Gate(2, "FITC+", {"shape": "range", "x_min": 4500.5, "x_max": 9500.5}, 1, "FITC-A", "FITC-A")
ROUND = Gate(3, "Round", {"shape": "ellipse", "cx": 50000.0, "cy": 25.0, "rx": 20000.0, "ry": 12.0, "angle": 0.0003}, None, "FSC-A", "SSC-A")
FIELD = Gate(4, "Field", {"shape": "polygon", "vertices": [[10000.0, 5.0], [90000.0, 12.5], [70000.0, 47.5], [30000.0, 47.5]]}, None, "FSC-A", "SSC-A")
DIM = Gate(5, "Dim", {"shape": "range", "x_min": 3.0, "x_max": 4.2}, 1, "PE-A", "PE-A", ASINH, ASINH)
NONE = Gate(6, "Nothing", {"shape": "rect", "x_min": -5.0, "x_max": -1.0, "y_min": 0.0, "y_max": 1.0}, 1, "FSC-A", "SSC-A")
SQL_MASK = {
    1: "(c0 BETWEEN 20000.5 AND 80000.5 AND c1 BETWEEN 9.5 AND 45.5)",
    2: "(c2 BETWEEN 4500.5 AND 9500.5)",
    3: "(pow(((c0 - 50000.0) * cos(0.0003) + (c1 - 25.0) * sin(0.0003)) / 20000.0, 2) + pow((-(c0 - 50000.0) * sin(0.0003) + (c1 - 25.0) * cos(0.0003)) / 12.0, 2) <= 1.0)",
    5: "(asinh(c3 / 150.0) BETWEEN 3.0 AND 4.2)",
    6: "(c0 BETWEEN -5.0 AND -1.0 AND c1 BETWEEN 0.0 AND 1.0)",
}


def _polygon_sql(points: list, x: str = "c0", y: str = "c1") -> str:
    edges = [f"CASE WHEN ({yi} > {y}) <> ({yj} > {y}) AND {x} < ({xj} - {xi}) * ({y} - {yi}) / ({yj} - {yi}) + {xi} THEN 1 ELSE 0 END" for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True) if yi != yj]
    return f"(({' + '.join(edges)}) % 2 = 1)"


SQL_MASK[4] = _polygon_sql(FIELD.shape["vertices"])


def _counts_sql(rows: list[tuple[str, str, str]], ctes: str = TUBES) -> str:
    """rows: (name, mask of the gate, mask of its parent)."""
    parts = [
        f"SELECT sample_id, {i} AS ord, '{n}' AS gate, count(*) FILTER (WHERE {m}) AS n_in, count(*) FILTER (WHERE {p}) AS n_parent, count(*) AS n_total FROM tubes GROUP BY sample_id" for i, (n, m, p) in enumerate(rows)
    ]
    return f"WITH {ctes}, u AS ({' UNION ALL '.join(parts)}) SELECT *, round(CASE WHEN n_parent > 0 THEN 100.0 * n_in / n_parent ELSE 0 END, 6) AS pct_parent FROM u"


QUADRANTS = quadrant_gates(11, 1, "FITC-A", "PE-A", 5000.5, 4000.5)
_R, _U = "c2 >= 5000.5", "c3 >= 4000.5"
ANDS, ORS, NOTS = boolean_gate(7, "and", [CELLS, FITC]), boolean_gate(8, "or", [FITC, ROUND]), boolean_gate(9, "not", [FITC], parent=1)
_M = SQL_MASK
_FITC = f"({_M[1]} AND {_M[2]})"
#: Gates of each counting query, and (name, mask, parent's mask) of each gate in SQL.
COUNTS: dict[str, tuple[list[Gate], list[tuple[str, str, str]]]] = {
    "g_rect": ([CELLS], [("Cells", _M[1], "true")]),
    "g_range": ([CELLS, FITC], [("Cells", _M[1], "true"), ("FITC+", _FITC, _M[1])]),
    "g_ellipse": ([ROUND], [("Round", _M[3], "true")]),
    "g_polygon": ([FIELD], [("Field", _M[4], "true")]),
    "g_and": ([CELLS, FITC, ANDS], [("Cells", _M[1], "true"), ("FITC+", _FITC, _M[1]), (ANDS.name, _FITC, "true")]),
    "g_or": ([CELLS, FITC, ROUND, ORS], [("Cells", _M[1], "true"), ("FITC+", _FITC, _M[1]), ("Round", _M[3], "true"), (ORS.name, f"({_FITC} OR {_M[3]})", "true")]),
    "g_not": ([CELLS, FITC, NOTS], [("Cells", _M[1], "true"), ("FITC+", _FITC, _M[1]), (NOTS.name, f"({_M[1]} AND NOT {_FITC})", _M[1])]),
    "g_hierarchy": ([CELLS, FITC, DIM], [("Cells", _M[1], "true"), ("FITC+", _FITC, _M[1]), ("Dim", f"({_M[1]} AND {_M[5]})", _M[1])]),
    "g_quadrant": (QUADRANTS, [(g.name, m, "true") for g, m in zip(QUADRANTS, (f"({_R} AND {_U})", f"(NOT {_R} AND {_U})", f"(NOT {_R} AND NOT {_U})", f"({_R} AND NOT {_U})"), strict=True)]),
}
COUNTS["a_gate_counts"] = (COUNTS["g_not"][0] + [FIELD, ROUND], COUNTS["g_not"][1] + [("Field", _M[4], "true"), ("Round", _M[3], "true")])


def _count_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(stats.gate_counts(tubes(spark, sf_dir), COUNTS[name][0], PANEL))


TREE = [CELLS, FITC, ROUND]
POPS = [("All events", "—", 0, "true", "true"), ("Cells", "All events", 1, _M[1], "true"), ("FITC+", "Cells", 2, _FITC, _M[1]), ("Round", "All events", 1, _M[3], "true")]
WITH_EMPTY = [*POPS[:3], ("Nothing", "Cells", 2, f"({_M[1]} AND {_M[6]})", _M[1]), POPS[3]]


def _popstats_sql(pops: list[tuple], channels: list[tuple[str, str]], source: str = "tubes", ctes: str = TUBES, extra: str = "") -> str:
    parts = []
    for i, (name, parent, depth, mask, above) in enumerate(pops):
        for channel, c in channels:
            w = f"FILTER (WHERE {mask})"
            sd = f"CASE WHEN count({c}) {w} = 1 THEN 0 ELSE stddev_samp({c}) {w} END"
            parts.append(
                f"SELECT sample_id, {i} AS ord, '{name}' AS population, '{parent}' AS parent, {depth} AS depth, count(*) {w} AS count,"
                f" round(coalesce(100.0 * count(*) {w} / nullif(count(*) FILTER (WHERE {above}), 0), 0), 6) AS pct_parent, round(100.0 * count(*) {w} / count(*), 6) AS pct_total, '{channel}' AS channel,"
                f" round(quantile_cont({c}, 0.5) {w}, 6) AS median, round(avg({c}) {w}, 6) AS mean, round(CASE WHEN abs(avg({c}) {w}) > 1e-12 THEN 100 * ({sd}) / abs(avg({c}) {w}) END, 6) AS cv,"
                f" round((quantile_cont({c}, 0.84) {w} - quantile_cont({c}, 0.5) {w}) / 0.995, 6) AS rsd{extra} FROM {source} GROUP BY sample_id"
            )
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


STATS = [("FSC-A", "c0"), ("SSC-A", "c1"), ("FITC-A", "c2"), ("PE-A", "c3")]
_INV = SPILL.inverse
COMPENSATED = f"""{TUBES}, comp AS (
  SELECT sample_id, event_idx, c0, c1, c2 * {float(_INV[0][0])!r} + c3 * {float(_INV[1][0])!r} AS c2, c2 * {float(_INV[0][1])!r} + c3 * {float(_INV[1][1])!r} AS c3, c4 FROM tubes
)"""


def a_popstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.population_stats(compensate(tubes(spark, sf_dir), PANEL, SPILL), TREE, PANEL))


def a_popstats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.population_stats(tubes(spark, sf_dir), [CELLS, FITC, NONE, ROUND], PANEL, channels=["FITC-A"]))


def a_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.channel_stats(tubes(spark, sf_dir), PANEL))


def _channel_stats_sql() -> str:
    q = lambda c, p: f"round(quantile_cont({c}, {p}), 6)"
    sd = lambda c: f"CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END"
    rows = [
        f"SELECT sample_id, '{n}' AS channel, count({c}) AS n, round(avg({c}), 6) AS mean, round(exp(avg(ln({c})) FILTER (WHERE {c} > 0)), 6) AS geo_mean, {q(c, 0.5)} AS median, round({sd(c)}, 6) AS sd,"
        f" round(CASE WHEN abs(avg({c})) > 1e-12 THEN 100 * ({sd(c)}) / abs(avg({c})) END, 6) AS cv, round(min({c}), 6) AS min, round(max({c}), 6) AS max, {q(c, 0.05)} AS p05, {q(c, 0.25)} AS p25, {q(c, 0.75)} AS p75, {q(c, 0.95)} AS p95 FROM tubes GROUP BY sample_id"
        for n, c in STATS
    ]
    return f"WITH {TUBES} " + " UNION ALL ".join(rows).replace("ln(c2)", "ln(CASE WHEN c2 > 0 THEN c2 END)").replace("ln(c3)", "ln(CASE WHEN c3 > 0 THEN c3 END)")


def _column_query(out: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _table(spark, sf_dir, "customer").select("c_custkey", out().alias("value")).withColumn("value", formats.rounded(F.col("value"), 6))


def _logicle_inverse_sql() -> str:
    k, near = logicle(262144.0, 0.5, 4.5, 0.0), "0.0"
    for c in reversed(k.taylor):
        near = f"({near} + ({c!r})) * z"
    return f"""WITH a AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 * 4.5 / {k.m!r} AS s FROM customer),
b AS (SELECT c_custkey, s, CASE WHEN s < {k.x1!r} THEN {2 * k.x1!r} - s ELSE s END AS up FROM a), c AS (SELECT *, up - {k.x1!r} AS z FROM b)
SELECT c_custkey, round(CASE WHEN s < {k.x1!r} THEN -1 ELSE 1 END * CASE WHEN up < {k.series_to!r} THEN {near} ELSE {k.a!r} * exp({k.b!r} * up) + ({k.f!r}) - {k.c!r} * exp(-{k.d!r} * up) END, 6) AS value FROM c"""


def p_compensate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compensate(tubes(spark, sf_dir), PANEL, SPILL).select("event_idx", "sample_id", F.col("c2").alias("fitc"), F.col("c3").alias("pe")))


CONTROLS = autogate.Controls("NO", ("AF", "RF"))
CONTROL_PANEL = Panel(("FITC-A", "PE-A"), ("c2", "c3"))


def _control_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stained controls from the tubes: AF bright in FITC-A, RF in PE-A."""
    t, s = tubes(spark, sf_dir), F.col("sample_id")
    a = F.when(s == "AF", F.col("c0") + 0.1 * F.col("c2")).when(s == "RF", 0.02 * F.col("c0")).otherwise(F.col("c1"))
    b = F.when(s == "AF", 0.05 * F.col("c0")).when(s == "RF", F.col("c0") + 0.1 * F.col("c3")).otherwise(F.col("c1"))
    return t.select("sample_id", a.alias("c2"), b.alias("c3"))


def a_spillover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(autogate.spillover_table(_control_tubes(spark, sf_dir), CONTROL_PANEL, CONTROLS).select("source", "target", "value"))


def a_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel(("FITC-A", "PE-A", "APC-A"), ("c2", "c3", "c0"))
    return _rounded(autogate.cross_check(tubes(spark, sf_dir), panel, {"FITC-A": 5000.5, "APC-A": 50000.5}))


def _residual_sql() -> str:
    cells = [("FITC-A", "c2", 5000.5, "PE-A", "c3"), ("FITC-A", "c2", 5000.5, "APC-A", "c0"), ("APC-A", "c0", 50000.5, "FITC-A", "c2"), ("APC-A", "c0", 50000.5, "PE-A", "c3")]
    d = lambda v, c, cut: f"(quantile_cont({v}, 0.5) FILTER (WHERE {c} > {cut}) - quantile_cont({v}, 0.5) FILTER (WHERE NOT {c} > {cut}))"
    return f"WITH {TUBES} " + " UNION ALL ".join(
        f"SELECT sample_id, '{s}' AS source, '{t}' AS target, round(CASE WHEN count(*) FILTER (WHERE {cs} > {cut}) >= 20 AND count(*) FILTER (WHERE NOT {cs} > {cut}) >= 20 AND abs({d(cs, cs, cut)}) >= 1e-6 THEN {d(ct, cs, cut)} / {d(cs, cs, cut)} END, 6) AS residual FROM tubes GROUP BY sample_id"
        for s, cs, cut, t, ct in cells
    )


def _time_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("sample_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("value").alias("c0"))


def a_flow_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.flow_rate(_time_tubes(spark, sf_dir), "t").select("sample_id", "n_bins", F.array_join(F.transform("counts", lambda c: c.cast("string")), " ").alias("counts"), "max_dev_pct"))


FLOW = """ends AS (SELECT sample_id, min(t) AS lo, max(t) AS hi, count(t) AS n, CAST(least(20, greatest(floor(count(t) / 100), 1)) AS INTEGER) AS n_bins FROM ev GROUP BY sample_id),
binned AS (SELECT sample_id, least(CAST(floor((t - lo) / (hi - lo) * n_bins) AS INTEGER), n_bins - 1) AS bin, count(*) AS c FROM ev JOIN ends USING (sample_id) WHERE hi > lo GROUP BY ALL),
grid AS (SELECT sample_id, n_bins, b AS bin FROM ends, range(0, 20) r(b) WHERE hi > lo AND b < n_bins),
full_ AS (SELECT g.sample_id, g.n_bins, g.bin, coalesce(c, 0) AS c FROM grid g LEFT JOIN binned b ON g.sample_id = b.sample_id AND g.bin = b.bin),
lists AS (SELECT sample_id, n_bins, list(c ORDER BY c) AS s, string_agg(CAST(c AS VARCHAR), ' ' ORDER BY bin) AS counts FROM full_ GROUP BY sample_id, n_bins),
flow AS (SELECT sample_id, n_bins, counts, list_max(list_transform(s, lambda x: abs(x - greatest(s[CAST(floor(len(s) / 2) AS INTEGER) + 1], 1)) * 100.0 / greatest(s[CAST(floor(len(s) / 2) AS INTEGER) + 1], 1))) AS dev FROM lists)"""
EV = "ev AS (SELECT event_type AS sample_id, CAST(epoch_us(ts) AS DOUBLE) AS t, value AS c0 FROM events)"
RANGES = {"FSC-A": 100000.0, "SSC-A": 50.0, "FITC-A": 10000.0, "PE-A": 1.0, "Time": 10400.0}


def a_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.margin_shares(tubes(spark, sf_dir), PANEL, RANGES))


MARGINS = "marg AS (" + " UNION ALL ".join(f"SELECT sample_id, {i} AS ord, '{n}' AS channel, 100.0 * count(*) FILTER (WHERE {c} >= 0.999 * {RANGES[n]}) / count(*) AS pct FROM tubes GROUP BY sample_id" for i, (n, c) in enumerate([*STATS[:3], ("Time", "c4")])) + ")"


def a_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tubes(spark, sf_dir)
    lost = t.where("sample_id = 'NO'").select(F.concat("sample_id", F.lit("-copy")).alias("sample_id"), F.lit("no FCS file").alias("reason")).distinct()
    out = qc.qc_scan(t, PANEL, RANGES, "c4", ([CELLS, FITC], 2), skipped=lost)
    return _rounded(out.withColumn("flags", F.array_join("flags", "; ")))


QC_SQL = f"""WITH {TUBES}, ev AS (SELECT sample_id, c4 AS t FROM tubes), {FLOW}, {MARGINS},
worst AS (SELECT sample_id, channel AS offscale_channel, pct AS offscale_pct FROM marg QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY pct DESC, ord DESC) = 1),
v AS (SELECT sample_id, count(*) AS n_events, coalesce(100.0 * count(*) FILTER (WHERE {_FITC}) / nullif(count(*) FILTER (WHERE {_M[1]}), 0), 0) AS viable FROM tubes GROUP BY sample_id)
SELECT sample_id, n_events, round(viable, 6) AS viable, round(dev, 6) AS flow_dev, round(offscale_pct, 6) AS offscale_pct, offscale_channel,
  concat_ws('; ', CASE WHEN n_events < 5000 THEN 'low events (' || n_events || ')' END, CASE WHEN viable < 50 THEN printf('low viability (%.0f%%)', viable) END, CASE WHEN dev > 40 THEN printf('flow-rate Δ%.0f%%', dev) END, CASE WHEN offscale_pct > 1 THEN printf('%.1f%% off-scale on ', offscale_pct) || offscale_channel END) AS flags
FROM v LEFT JOIN flow USING (sample_id) LEFT JOIN worst USING (sample_id)
UNION ALL SELECT DISTINCT 'NO-copy', 0, NULL, NULL, NULL, NULL, 'skipped: no FCS file' FROM tubes WHERE sample_id = 'NO'"""


def a_titration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.titration(stats.population_stats(tubes(spark, sf_dir), TREE, PANEL, channels=["FSC-A"]), "FITC+", "Round", "fsc-a").drop("concentration"))


TITRATION_SQL = f"""WITH {TUBES}, t AS (SELECT sample_id, 100.0 * count(*) FILTER (WHERE {_FITC}) / count(*) FILTER (WHERE {_M[1]}) AS pct, quantile_cont(c0, 0.5) FILTER (WHERE {_FITC}) AS p, quantile_cont(c0, 0.5) FILTER (WHERE {_M[3]}) AS n,
  (quantile_cont(c0, 0.84) FILTER (WHERE {_M[3]}) - quantile_cont(c0, 0.5) FILTER (WHERE {_M[3]})) / 0.995 AS rsd FROM tubes GROUP BY sample_id)
SELECT sample_id, round(pct, 6) AS pct_positive, round(p, 6) AS mfi_pos, round(n, 6) AS mfi_neg, round(rsd, 6) AS rsd_neg, round(CASE WHEN abs(rsd) >= 1e-9 THEN (p - n) / (2 * rsd) END, 6) AS stain_index FROM t"""


def a_titration_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative population isn't among the gates: its figures and the index are undefined."""
    rows = stats.population_stats(tubes(spark, sf_dir), TREE, PANEL, channels=["FSC-A"])
    return _rounded(stats.titration(rows, "FITC+", "Unstained", "FSC-A").drop("concentration"))


def a_best_titration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.titration(stats.population_stats(tubes(spark, sf_dir), TREE, PANEL, channels=["FSC-A"]), "FITC+", "Round", "FSC-A")
    return _rounded(stats.best_titration(rows)).select("sample_id", "stain_index")


def a_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tubes(spark, sf_dir)
    small = Panel(("Fsc-a", "Ssc-a", "FITC-A"), ("c0", "c1", "c2"))
    panels = {"full": (PANEL, t.where("sample_id < 'N'")), "small": (small, t.where("sample_id >= 'N'").select("sample_id", "event_idx", "c0", "c1", "c2"))}
    return _rounded(batch(panels, [CELLS, FITC], {"full": SPILL})[0])


def _batch_sql() -> str:
    full = _popstats_sql(POPS[:3], STATS, "full_", COMPENSATED + ", full_ AS (SELECT * FROM comp WHERE sample_id < 'N'), small_ AS (SELECT * FROM tubes WHERE sample_id >= 'N')", ", 'full' AS panel")
    small = _popstats_sql(POPS[:3], [("Fsc-a", "c0"), ("Ssc-a", "c1"), ("FITC-A", "c2")], "small_", "", ", 'small' AS panel")
    return full + " UNION ALL " + small.removeprefix("WITH  ")


def a_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overlay(tubes(spark, sf_dir), "c0", "sample_id", 0.0, 100000.0, 64, modal=False))


HISTOGRAM_SQL = f"""WITH {TUBES}, grid AS (SELECT sample_id, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT sample_id FROM tubes), range(0, 64) r(b)),
h AS (SELECT sample_id, CAST(CASE WHEN c0 < 0 THEN 0 WHEN c0 >= 100000 THEN 63 ELSE floor(c0 / 100000.0 * 64) END AS INTEGER) AS bin, count(*) AS n FROM tubes GROUP BY ALL),
y AS (SELECT sample_id, bin, coalesce(n, 0) AS y FROM grid LEFT JOIN h USING (sample_id, bin)),
y1 AS (SELECT sample_id, bin, avg(y) OVER w AS y FROM y WINDOW w AS (PARTITION BY sample_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT sample_id, bin, round(avg(y) OVER (PARTITION BY sample_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS height FROM y1"""


def a_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density(tubes(spark, sf_dir), F.col("c0"), F.col("c1"), (0.0, 100000.0, 0.0, 50.0), 160, ["sample_id"])


def _bin_sql(c: str, hi: float, bins: int = 160) -> str:
    return f"CAST(CASE WHEN {c} < 0 THEN 0 WHEN {c} >= {hi} THEN {bins - 1} ELSE least(floor(({c} - 0.0) / {hi} * {bins}), {bins - 1}) END AS INTEGER)"


def a_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(autogate.mode_of(tubes(spark, sf_dir), "c0", 64, ["sample_id"]))


def a_singlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights and areas that part the three readings of the rule: ratios spread with the tax, areas have a floor."""
    out = autogate.singlet_vertices(_singlet_tubes(spark, sf_dir), "c0", "h", ["sample_id"])
    return _rounded(out.select("sample_id", "h_lo", "h_hi", "slope", *[F.element_at(F.element_at("vertices", i), 1).alias(f"area{i}") for i in (1, 2, 3, 4)]))


def _singlet_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events are doublets of twice the area; some heights aren't positive."""
    t = tubes(spark, sf_dir)
    height = F.when(F.col("event_idx") % 50 == 0, -1.0).otherwise(F.col("c0") * (0.8 + F.col("c3") / 1e5))
    return t.select("sample_id", F.when(F.col("event_idx") % 3 == 0, F.col("c0") * 2).otherwise(F.col("c0")).alias("c0"), height.alias("h"))


def _mode_ctes(v: str, source: str) -> str:
    return f"""e_ AS (SELECT sample_id, min({v}) AS lo, max({v}) AS hi FROM {source} GROUP BY sample_id),
b_ AS (SELECT sample_id, lo, hi, least(CAST(floor(({v} - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin, count(*) AS n FROM {source} JOIN e_ USING (sample_id) GROUP BY ALL),
m_ AS (SELECT sample_id, lo, hi, bin FROM b_ QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, bin DESC) = 1)"""


SINGLET_SQL = f"""WITH {TUBES}, s AS (
  SELECT sample_id, CASE WHEN event_idx % 3 = 0 THEN c0 * 2 ELSE c0 END AS a, CASE WHEN event_idx % 50 = 0 THEN -1.0 ELSE c0 * (0.8 + c3 / 1e5) END AS h FROM tubes
), hs AS (SELECT sample_id, h, row_number() OVER (PARTITION BY sample_id ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM s WHERE h > 0),
core AS (SELECT sample_id, max(h) FILTER (WHERE i = floor(CAST(0.02 AS DOUBLE) * (n - 1))) AS h_lo, max(h) FILTER (WHERE i = floor(CAST(0.98 AS DOUBLE) * (n - 1))) AS h_hi FROM hs WHERE n >= 50 GROUP BY sample_id),
rs AS (SELECT sample_id, a / h AS r FROM s JOIN core USING (sample_id) WHERE h_hi > h_lo AND h BETWEEN h_lo AND h_hi), {_mode_ctes('r', 'rs')},
fit AS (SELECT sample_id, h_lo, h_hi, lo + (bin + 0.5) / 64 * (hi - lo) AS slope FROM core JOIN m_ USING (sample_id) WHERE (SELECT count(*) FROM rs WHERE rs.sample_id = core.sample_id) >= 50)
SELECT sample_id, round(h_lo, 6) AS h_lo, round(h_hi, 6) AS h_hi, round(slope, 6) AS slope, round(slope * h_lo * (1 - 0.15), 6) AS area1, round(slope * h_hi * (1 - 0.15), 6) AS area2, round(slope * h_hi * (1 + 0.15), 6) AS area3, round(slope * h_lo * (1 + 0.15), 6) AS area4
FROM fit WHERE slope > 0"""


def s_range_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", range_mask(F.col("o_orderkey"), F.lit(1000.0)).alias("masked"))


def s_spillover_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", F.lit("2"), F.concat("n_name", F.lit("-A")), F.lit("PE-A"), F.lit("1"), (F.col("n_nationkey") / 100).cast("string"), F.lit("0.5"), F.lit("1"))
    p = _table(spark, sf_dir, "nation").select("n_nationkey", parsed_spillover(text).alias("p"))
    return p.select("n_nationkey", F.col("p.n").alias("n"), F.array_join("p.names", "|").alias("names"), F.round(F.aggregate("p.values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def s_spillover_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("n_nationkey") % 3 == 0, "SPILL").when(F.col("n_nationkey") % 3 == 1, "SPILLOVER").otherwise("$CYT")
    words = F.map_concat(F.create_map(key, F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("$SPILL"), F.lit("own"))).otherwise(F.create_map(F.lit("X"), F.lit("x"))))
    return _table(spark, sf_dir, "nation").select("n_nationkey", spillover_keyword(words).alias("spill"))


def a_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = density_grid(tubes(spark, sf_dir), F.col("c0"), F.col("c1"), ["sample_id"], 20)
    top = grid.groupBy("sample_id").agg(F.max("n").alias("top"))
    return grid.join(top, "sample_id").select("sample_id", "bx", "by_", heat_bucket(F.col("n"), F.col("top")).alias("bucket"))


def _grid_sql(bins: int, x: str = "c0", y: str = "c1") -> str:
    """CTEs up to ``g``: counts of each tube's grid over its own extent."""
    at = lambda v, lo, hi: f"CAST(floor(least(greatest((({v}) - {lo}) / ({hi} - {lo}) * {bins}, 0), {bins - 1})) AS INTEGER)"
    return f"""{TUBES}, box AS (SELECT sample_id, min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, max({y}) AS y1 FROM tubes GROUP BY sample_id),
g AS (SELECT sample_id, x0, x1, y0, y1, {at(x, 'x0', 'x1')} AS bx, {at(y, 'y0', 'y1')} AS by_, count(*) AS n FROM tubes JOIN box USING (sample_id) GROUP BY ALL)"""


def a_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours over irrational multiples, whose coordinates don't end on the digit that is rounded."""
    grid = density_grid(tubes(spark, sf_dir), F.col("c0") * F.sqrt(F.lit(0.5)), F.col("c1") * F.sqrt(F.lit(0.3)), ["sample_id"], 24)
    return _rounded(contours(grid, ["sample_id"], 24))


def _contours_sql(bins: int) -> str:
    cases = "(1,0,'l','b'), (14,0,'l','b'), (2,0,'b','r'), (13,0,'b','r'), (3,0,'l','r'), (12,0,'l','r'), (4,0,'r','t'), (11,0,'r','t'), (6,0,'b','t'), (9,0,'b','t'), (7,0,'l','t'), (8,0,'l','t'), (5,0,'l','b'), (5,1,'r','t'), (10,0,'b','r'), (10,1,'t','l')"
    f = lambda a, b: f"CASE WHEN abs({b} - {a}) < 1e-12 THEN 0.5 ELSE least(greatest((lev - {a}) / ({b} - {a}), 0), 1) END"
    pick = lambda e, c: "CASE " + " ".join(f"WHEN {e} = '{k}' THEN {k}{c}" for k in "brtl") + " END"
    return f"""WITH {_grid_sql(bins, "c0 * sqrt(0.5)", "c1 * sqrt(0.3)")},
full_ AS (SELECT box.*, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, coalesce(n, 0) AS n FROM box CROSS JOIN range(0, {bins}) a(i) CROSS JOIN range(0, {bins}) b(j) LEFT JOIN g ON g.sample_id = box.sample_id AND g.bx = i AND g.by_ = j),
cells AS (SELECT a.*, CAST(a.n AS DOUBLE) AS va, CAST(b.n AS DOUBLE) AS vb, CAST(c.n AS DOUBLE) AS vc, CAST(d.n AS DOUBLE) AS vd, max(a.n) OVER (PARTITION BY a.sample_id) AS inner_top
  FROM full_ a JOIN full_ b ON b.sample_id = a.sample_id AND b.i = a.i + 1 AND b.j = a.j JOIN full_ c ON c.sample_id = a.sample_id AND c.i = a.i + 1 AND c.j = a.j + 1 JOIN full_ d ON d.sample_id = a.sample_id AND d.i = a.i AND d.j = a.j + 1),
tops AS (SELECT sample_id, max(n) AS top FROM g GROUP BY sample_id),
levelled AS (SELECT cells.*, f AS level, f * top AS lev FROM cells JOIN tops USING (sample_id), (VALUES (CAST(0.04 AS DOUBLE)), (0.10), (0.20), (0.35), (0.55), (0.80)) l(f)),
ends AS (SELECT *, CASE WHEN va > lev THEN 1 ELSE 0 END + CASE WHEN vb > lev THEN 2 ELSE 0 END + CASE WHEN vc > lev THEN 4 ELSE 0 END + CASE WHEN vd > lev THEN 8 ELSE 0 END AS k,
  x0 + (i + 0.5) * (x1 - x0) / {bins} AS xi, x0 + (i + 1.5) * (x1 - x0) / {bins} AS xj, y0 + (j + 0.5) * (y1 - y0) / {bins} AS yi, y0 + (j + 1.5) * (y1 - y0) / {bins} AS yj FROM levelled),
edges AS (SELECT *, xi + {f('va', 'vb')} * (xj - xi) AS bx_, yi AS by__, xj AS rx_, yi + {f('vb', 'vc')} * (yj - yi) AS ry_, xj + {f('vc', 'vd')} * (xi - xj) AS tx_, yj AS ty_, xi AS lx_, yj + {f('vd', 'va')} * (yi - yj) AS ly_ FROM ends)
SELECT sample_id, level, i, j, part, round({pick('e1', 'x_')}, 6) AS xa, round({pick('e1', 'y_').replace('by_', 'by__')}, 6) AS ya, round({pick('e2', 'x_')}, 6) AS xb, round({pick('e2', 'y_').replace('by_', 'by__')}, 6) AS yb
FROM edges JOIN (VALUES {cases}) c(k, part, e1, e2) USING (k)"""


def a_stain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(stats.stain_index(F.col("p_retailprice"), F.col("p_size").cast("double"), F.col("p_size") - F.lit(10.0)), 6).alias("si"))


def _valley_ctes(values: str, by: str, bins: int, name: str = "valley") -> str:
    """CTEs up to ``name`` (by, thr, depth): the valley of ``v`` of the CTE ``values``, over its groups ``by``."""
    w, p = max(bins // 48, 1), f"{name}_"
    smooth = lambda to, of: f"{p}{to} AS (SELECT {by}, lo, hi, bin, avg(y) OVER (PARTITION BY {by} ORDER BY bin ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS y FROM {p}{of})"
    return f"""{p}e AS (SELECT {by}, min(v) AS lo, max(v) AS hi, count(v) AS n FROM {values} WHERE isfinite(v) GROUP BY {by}),
{p}c AS (SELECT {by}, least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS bin, count(*) AS k FROM {values} JOIN {p}e USING ({by}) WHERE hi > lo AND n >= 50 AND isfinite(v) GROUP BY ALL),
{p}g AS (SELECT {by}, lo, hi, CAST(b AS INTEGER) AS bin FROM {p}e, range(0, {bins}) r(b) WHERE hi > lo AND n >= 50),
{p}h AS (SELECT {by}, lo, hi, bin, CAST(coalesce(k, 0) AS DOUBLE) AS y FROM {p}g LEFT JOIN {p}c USING ({by}, bin)),
{smooth("s1", "h")}, {smooth("s2", "s1")}, {smooth("s3", "s2")},
{p}n AS (SELECT *, lag(y) OVER o AS b, lead(y) OVER o AS a, max(y) OVER (PARTITION BY {by}) AS top FROM {p}s3 WINDOW o AS (PARTITION BY {by} ORDER BY bin)),
{p}p AS (SELECT {by}, bin, y FROM {p}n WHERE y >= b AND y >= a AND (y > b OR y > a) AND y >= 0.02 * top QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY y DESC, bin) <= 2),
{p}t AS (SELECT {by}, min(bin) AS first, max(bin) AS last, min(y) AS low FROM {p}p GROUP BY {by} HAVING count(*) = 2),
{p}m AS (SELECT {by}, lo, hi, low, bin, y FROM {p}s3 JOIN {p}t USING ({by}) WHERE bin BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY y, bin) = 1),
{name} AS (SELECT {by}, lo + (bin + 0.5) / {bins} * (hi - lo) AS thr, CASE WHEN low > 0 THEN least(greatest((low - y) / low, 0), 1) ELSE 0 END AS depth FROM {p}m)"""


def _logicle_sql() -> str:
    """Bisection of the scale's closed form; the axis is mirrored about zero."""
    k = logicle(262144.0, 0.5, 4.5, 0.0)
    value = f"({k.a!r} * exp({k.b!r} * (lo + hi) / 2) + ({k.f!r}) - {k.c!r} * exp(-{k.d!r} * (lo + hi) / 2))"
    return f"""WITH RECURSIVE it AS (
  SELECT c_custkey, c_acctbal AS x, CAST({k.x1!r} AS DOUBLE) AS lo, CAST(3.0 AS DOUBLE) AS hi, 0 AS i FROM customer
  UNION ALL
  SELECT c_custkey, x, CASE WHEN {value} < abs(x) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {value} < abs(x) THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM it WHERE i < 60
)
SELECT c_custkey, round({k.m!r} * CASE WHEN x < 0 THEN {2 * k.x1!r} - (lo + hi) / 2 ELSE (lo + hi) / 2 END, 6) AS value FROM it WHERE i = 60"""


def _spillover_sql() -> str:
    """Controls AF and RF over NO: medians over background, of events over the valley in the channel of the greatest signal."""
    names = [n for n, _ in CONTROL_PANEL.fluorescence()]
    med = lambda c, where: f"coalesce(quantile_cont({c}, 0.5){where}, 0)"
    picked = lambda c: f"CASE WHEN count(*) FILTER (WHERE v > thr) >= 50 THEN {med(c, ' FILTER (WHERE v > thr)')} ELSE {med(c, '')} END"
    cells = " UNION ALL ".join(f"SELECT source, '{n}' AS target, round({c} / CASE WHEN source = '{names[0]}' THEN c2 ELSE c3 END, 6) AS value FROM r" for n, c in zip(names, ("c2", "c3"), strict=True))
    return f"""WITH {TUBES}, ctl AS (
  SELECT sample_id, CASE sample_id WHEN 'AF' THEN c0 + 0.1 * c2 WHEN 'RF' THEN 0.02 * c0 ELSE c1 END AS c2, CASE sample_id WHEN 'AF' THEN 0.05 * c0 WHEN 'RF' THEN c0 + 0.1 * c3 ELSE c1 END AS c3
  FROM tubes WHERE sample_id IN ('NO', 'AF', 'RF')
), plain AS (SELECT sample_id, quantile_cont(c2, 0.5) AS m2, quantile_cont(c3, 0.5) AS m3 FROM ctl GROUP BY sample_id),
bg AS (SELECT m2 AS b2, m3 AS b3 FROM plain WHERE sample_id = 'NO'),
own AS (SELECT sample_id, CASE WHEN m3 - b3 >= m2 - b2 THEN '{names[1]}' ELSE '{names[0]}' END AS source FROM plain, bg WHERE sample_id <> 'NO'),
shown AS (SELECT sample_id, source, c2, c3, asinh(CASE WHEN source = '{names[0]}' THEN c2 ELSE c3 END / 150.0) AS v FROM ctl JOIN own USING (sample_id)),
{_valley_ctes("shown", "sample_id", 128)},
med AS (SELECT source, {picked("c2")} AS m2, {picked("c3")} AS m3 FROM shown LEFT JOIN valley USING (sample_id) GROUP BY source),
r AS (SELECT source, m2 - b2 AS c2, m3 - b3 AS c3 FROM med, bg) {cells}"""


def a_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tubes(spark, sf_dir)
    shown = t.select("sample_id", forward(F.when(F.col("event_idx") % 3 == 0, F.col("c0") / 100).otherwise(F.col("c0")), ASINH).alias("v"))
    return _rounded(autogate.valley_table(shown, "v", 128, ["sample_id"]).select("sample_id", F.col("threshold").alias("thr"), "depth"))


def a_auto_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range gate that each tube's valley suggests, on the display axis."""
    shown = _bright_tubes(spark, sf_dir).select("sample_id", forward(F.col("c2"), ASINH).alias("v"))
    found = autogate.valley_table(shown, "v", 128, ["sample_id"]).where("threshold IS NOT NULL")
    return _rounded(found.select("sample_id", F.col("threshold").alias("x_min"), F.greatest("top", "threshold").alias("x_max")))


VALLEY_SQL = f"""WITH {TUBES}, shown AS (SELECT sample_id, asinh(CASE WHEN event_idx % 3 = 0 THEN c0 / 100 ELSE c0 END / 150.0) AS v FROM tubes), {_valley_ctes("shown", "sample_id", 128)}
SELECT sample_id, round(thr, 6) AS thr, round(depth, 6) AS depth FROM (SELECT DISTINCT sample_id FROM tubes) LEFT JOIN valley USING (sample_id)"""

BRIGHT = Panel(("FITC-A", "PE-A"), ("c2", "c3"))


def _bright_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tubes with a dim and a bright half in either channel; how dim depends on the tube."""
    t, odd = tubes(spark, sf_dir), F.col("event_idx") % 3 == 0
    even = F.col("event_idx") % 2 == 0
    return t.select("sample_id", F.when(odd, F.col("c0")).otherwise(F.col("c1") * 10 * F.when(F.col("sample_id") < "N", 1).otherwise(3)).alias("c2"), (F.when(even, F.col("c0")).otherwise(F.col("c1") * 10) + F.when(odd, 0.03 * F.col("c0")).otherwise(0.0)).alias("c3"))


_BRIGHT_SQL = """b AS (
  SELECT sample_id, CASE WHEN event_idx % 3 = 0 THEN c0 ELSE c1 * 10 * CASE WHEN sample_id < 'N' THEN 1 ELSE 3 END END AS c2, CASE WHEN event_idx % 2 = 0 THEN c0 ELSE c1 * 10 END + CASE WHEN event_idx % 3 = 0 THEN 0.03 * c0 ELSE 0 END AS c3 FROM tubes
)"""


def a_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals with cuts of each tube's own: valleys of 160 bins."""
    axes = {n: ASINH for n in BRIGHT.channels}
    out = autogate.cross_check(_bright_tubes(spark, sf_dir), BRIGHT, transforms=axes)
    return _rounded(out.withColumn("grade", autogate.residual_grade(F.col("residual"))))


def _cross_check_sql() -> str:
    d = lambda v, c: f"(quantile_cont({v}, 0.5) FILTER (WHERE {c} > cut) - quantile_cont({v}, 0.5) FILTER (WHERE {c} <= cut))"
    cell = lambda s, cs, t, ct: f"SELECT sample_id, '{s}' AS source, '{t}' AS target, CASE WHEN count(*) FILTER (WHERE {cs} > cut) >= 20 AND count(*) FILTER (WHERE {cs} <= cut) >= 20 AND abs({d(cs, cs)}) >= 1e-6 THEN {d(ct, cs)} / {d(cs, cs)} END AS r FROM b JOIN cuts USING (sample_id) WHERE channel = '{s}' GROUP BY sample_id"
    return f"""WITH {TUBES}, {_BRIGHT_SQL},
long_ AS (SELECT sample_id, 'FITC-A' AS channel, asinh(c2 / 150.0) AS v FROM b UNION ALL SELECT sample_id, 'PE-A', asinh(c3 / 150.0) FROM b), {_valley_ctes("long_", "sample_id, channel", 160)},
cuts AS (SELECT sample_id, channel, (exp(thr) - exp(-thr)) / 2 * 150.0 AS cut FROM valley WHERE depth >= 0.05),
cells AS ({cell("FITC-A", "c2", "PE-A", "c3")} UNION ALL {cell("PE-A", "c3", "FITC-A", "c2")})
SELECT sample_id, source, target, round(r, 6) AS residual, CASE WHEN abs(r) < 0.02 THEN 'good' WHEN abs(r) < 0.05 THEN 'fair' WHEN r IS NOT NULL THEN 'poor' END AS grade FROM cells"""


def k_population_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.population_table(_rounded(stats.population_stats(tubes(spark, sf_dir), TREE, PANEL)).withColumn("grp", F.substring("sample_id", 1, 1)), "grp")


def k_titration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.titration_table(a_titration(spark, sf_dir).withColumn("concentration", F.lit(None).cast("double")))


def k_qc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.qc_table(a_qc(spark, sf_dir).withColumn("flags", F.split("flags", "; ")))


def k_transform_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_acctbal", forward(F.col("c_acctbal"), ASINH).alias("shown"))
    return sinks.transform_dump(c, F.col("c_acctbal"), formats.rounded(F.col("shown"), 8))


def k_events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.events_text(tubes(spark, sf_dir), PANEL)


def p_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    tag = formats.numeric_tag(F.concat(F.lit(" "), F.substring("c_name", 10, 20), F.lit(" ")))
    return c.select("c_custkey", formats.csv_number(F.col("c_acctbal"), 2).alias("two"), formats.safe_name(F.col("c_name")).alias("safe"), tag.alias("tag"), formats.numeric_tag(F.col("c_mktsegment")).alias("no_tag"))


def p_utc_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", formats.utc_date(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("day"))


TOKENS = ["widget-A", "bolt-A", "Bolt-A", "large-A", "small bolt-A", "COLD-A"]


def p_file_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", formats.file_token(F.col("p_name"), TOKENS).alias("token"))


def _token_sql() -> str:
    """The longest token first, the first of equals."""
    order = sorted(TOKENS, key=lambda t: -len(t))
    return "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{t.removesuffix('-A')}') THEN '{t}'" for t in order) + " END AS token FROM part"


CHANNELS_SQL = """channels AS (
  SELECT n_name AS sample_id, n_nationkey * 10 + k AS ord, CASE k WHEN 0 THEN CASE WHEN n_regionkey = 0 THEN 'fsc-a' ELSE 'FSC-A' END WHEN 1 THEN 'SSC-A' WHEN 2 THEN 'Time' ELSE 'FITC-A' END AS name
  FROM nation, range(0, 4) r(k) WHERE k < 3 OR n_nationkey % 2 = 0
)"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of a tube for each nation; every other one has no FITC-A."""
    n = _table(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where("k < 3 OR n_nationkey % 2 = 0")
    name = F.when(F.col("k") == 0, F.when(F.col("n_regionkey") == 0, "fsc-a").otherwise("FSC-A")).when(F.col("k") == 1, "SSC-A").when(F.col("k") == 2, "Time").otherwise("FITC-A")
    return n.select(F.col("n_name").alias("sample_id"), (F.col("n_nationkey") * 10 + F.col("k")).cast("long").alias("ord"), name.alias("name"))


def g_missing_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_by_sample([CELLS, FITC, DIM], _channels(spark, sf_dir))


def a_channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_names(_channels(spark, sf_dir))


def a_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded(stats.population_stats(tubes(spark, sf_dir), TREE, PANEL, channels=["FSC-A"])).withColumn("grp", F.substring("sample_id", 1, 1))
    return chart_series(rows, "Cells", "fsc-a", "median", group="grp")


def p_asinh_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(asinh_panel(tubes(spark, sf_dir), PANEL))


def a_backgate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = GatePlan([CELLS, FITC], PANEL)
    return backgate(tubes(spark, sf_dir), plan.effective(2), plan.effective(1)).select("event_idx", "sample_id", "layer", "position", "n_members")


def a_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th member of a population, for at most about 700 of them."""
    plan = GatePlan([CELLS, FITC], PANEL)
    return stride_sample(tubes(spark, sf_dir), plan.effective(2), 700).select("event_idx", "sample_id", "position", "n_members")


def _sample_sql(mask: str, most: int) -> str:
    placed = f"SELECT event_idx, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY event_idx) - 1 AS position, count(*) OVER (PARTITION BY sample_id) AS n_members FROM tubes WHERE {mask}"
    return f"SELECT * FROM ({placed}) WHERE position % greatest(n_members // least({most}, n_members), 1) = 0"


DEEP = [ROUND, CELLS, FITC, DIM, boolean_gate(7, "not", [FITC], parent=1), FIELD]


def g_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = deepest_population(tubes(spark, sf_dir), DEEP, PANEL)
    return told.groupBy("sample_id", "population", "depth", F.array_join("path", " / ").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def _deepest_sql() -> str:
    """Depth 2 first (FITC+, Dim, NOT FITC+ in list order), then depth 1 (Round, Cells, Field)."""
    chain = [(2, 2, "Cells / FITC+", _FITC), (5, 2, "Cells / Dim", f"({_M[1]} AND {_M[5]})"), (7, 2, "Cells / NOT FITC+", f"({_M[1]} AND NOT {_FITC})"), (3, 1, "Round", _M[3]), (1, 1, "Cells", _M[1]), (4, 1, "Field", _M[4])]
    said = lambda i, last: "CASE " + " ".join(f"WHEN {c[3]} THEN {c[i]!r}" for c in chain) + f" {last} END"
    path = "CASE " + " ".join(f"WHEN {c[3]} THEN 'All events / {c[2]}'" for c in chain) + " ELSE 'All events' END"
    return f"WITH {TUBES} SELECT sample_id, {said(0, '')} AS population, {said(1, '')} AS depth, {path} AS path, count(*) AS n FROM tubes GROUP BY ALL"


#: Matrix keyword of each tube: two channels, the same in the other order, three; a singular one, one over a channel that isn't there, none.
TUBE_SPILL = {
    "AF": ("$SPILLOVER", "2,FITC-A,PE-A,1,0.08,0.03,1"),
    "AO": ("SPILL", "2,pe-a,FITC-A,1,0.02,0.1,1,ignored"),
    "NF": ("$SPILL", "3,FITC-A,SSC-A,PE-A,1,0.01,0.2,0.001,1,0.002,0.05,0.03,1"),
    "NO": ("SPILLOVER", "2,FITC-A,PE-A,1,0.5,2,1"),
    "RF": ("SPILL", "2,FITC-A,APC-A,1,0.1,0.1,1"),
}


def _tube_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tubes(spark, sf_dir).select("sample_id").distinct()
    words = F.coalesce(*[F.when(F.col("sample_id") == s, F.create_map(F.lit(k), F.lit(v))) for s, (k, v) in TUBE_SPILL.items()], F.create_map(F.lit("$CYT"), F.lit("none")))
    return names.select("sample_id", F.array(*[F.lit(c) for c in PANEL.channels]).alias("channels"), words.alias("keywords"))


def a_tube_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population statistics of tubes that bring their own matrices; two of them can't be compensated."""
    return _rounded(batch_tubes({"full": (PANEL, tubes(spark, sf_dir))}, TREE, _tube_table(spark, sf_dir))[0])


def a_tube_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tubes that a batch skips, with the reason: here every fourth has lost a channel that a gate names, besides those of ``a_tube_batch``."""
    t = _tube_table(spark, sf_dir).withColumn("channels", F.when(F.col("sample_id") == "RO", F.slice("channels", 2, 3)).otherwise(F.col("channels")))
    return batch_tubes({}, [*TREE, DIM], t)[1]


def p_tube_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each tube's inverse matrix."""
    m = tube_matrices(_tube_table(spark, sf_dir)).where("columns IS NOT NULL")
    return _rounded(m.select("sample_id", F.posexplode("columns").alias("target", "column")).select("sample_id", "target", F.posexplode("column").alias("source", "value")))


def _tube_batch_sql() -> str:
    """Each tube's unmixed columns by literals of its own inverse."""
    import numpy as np

    columns, parts = {n.upper(): c for n, c in zip(PANEL.channels, PANEL.columns, strict=True)}, []
    for s, (_, text) in TUBE_SPILL.items():
        if s in ("NO", "RF"):
            continue
        parts_ = text.split(",")
        n = int(parts_[0])
        own, inv = [columns[x.upper()] for x in parts_[1 : 1 + n]], np.linalg.inv(np.array(parts_[1 + n : 1 + n + n * n], float).reshape(n, n))
        mixed = {c: " + ".join(f"{r} * {float(inv[i][j])!r}" for i, r in enumerate(own)) for j, c in enumerate(own)}
        parts.append("SELECT sample_id, event_idx, " + ", ".join(f"{mixed.get(c, c)} AS {c}" for c in PANEL.columns) + f" FROM tubes WHERE sample_id = '{s}'")
    parts.append("SELECT * FROM tubes WHERE sample_id = 'RO'")
    return _popstats_sql(POPS, STATS, "own_", f"{TUBES}, own_ AS ({' UNION ALL '.join(parts)})", ", 'full' AS panel")


def _tube_inverse_sql() -> str:
    """Two channels by the closed form, three by cofactors."""
    rows = []
    for s, (_, text) in TUBE_SPILL.items():
        n, v = int(text[0]), text.split(",")
        m = f"CAST([{', '.join(v[1 + n : 1 + n + n * n])}] AS DOUBLE[])"
        if s in ("NO", "RF"):
            continue
        at = lambda i, j, n=n: f"m[{i % n * n + j % n + 1}]"
        minor = (lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})") if n == 3 else (lambda i, j: f"({'-' if i != j else ''}{at(i + 1, j + 1)})")
        det = " + ".join(f"{at(0, j)} * {minor(0, j)}" for j in range(n))
        rows += [f"SELECT '{s}' AS sample_id, {j} AS target, {i} AS source, {minor(j, i)} / ({det}) AS value FROM (SELECT {m} AS m)" for i in range(n) for j in range(n)]
    return f"SELECT sample_id, target, source, round(value, 6) AS value FROM ({' UNION ALL '.join(rows)}) WHERE sample_id IN (SELECT l_returnflag || l_linestatus FROM lineitem)"


def _self_check_sql() -> str:
    """All values come back, so nothing deviates in six digits; a tenth of one layer's probes aren't there."""
    n, lost = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM customer WHERE c_custkey % 10 = 0)"
    row = lambda layer, probes, missing: f"SELECT '{layer}' AS layer, {probes} AS probes, {missing} AS missing, 0 AS unknown, CAST(0 AS DOUBLE) AS max_dev, {missing} = 0 AS pass"
    return f"WITH {TUBES} " + " UNION ALL ".join([row("asinh", n, 0), row("logicle", n, 0), row("lost", n, lost), row("comp", "(SELECT count(*) FROM (SELECT DISTINCT sample_id, event_idx FROM tubes))", 0)])


def a_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against what they become on an axis and back, and raw events against compensated ones mixed again; one layer lacks probes."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").alias("x"))
    probe = lambda df, layer, value: df.select(F.lit(layer).alias("layer"), F.lit(None).cast("string").alias("channel"), "key", value.alias("value"))
    x, axes = F.col("x"), {"asinh": ASINH, "logicle": LOGICLE}
    golden, computed = [probe(c, n, x) for n in axes], [probe(c, n, inverse(forward(x, tf), tf)) for n, tf in axes.items()]
    golden.append(probe(c, "lost", x))
    computed.append(probe(c.where(F.col("key").cast("long") % 10 != 0), "lost", x))
    t = tubes(spark, sf_dir).groupBy("sample_id", "event_idx").agg(F.max("c2").alias("c2"), F.max("c3").alias("c3")).withColumn("key", F.concat_ws(":", "sample_id", "event_idx"))
    back = compensate(t, Panel(("FITC-A", "PE-A"), ("c2", "c3")), SPILL).withColumn("value", F.col("c2") + F.lit(SPILL.matrix[1][0]) * F.col("c3"))
    golden.append(probe(t, "comp", F.col("c2")))
    computed.append(probe(back, "comp", F.col("value")))
    rows = [compare_probes(g, k) for g, k in zip(golden, computed, strict=True)]
    return _rounded(reduce(DataFrame.unionByName, rows))


def g_logicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate on a logicle axis, over values that are below zero too."""
    t = tubes(spark, sf_dir).withColumn("c2", F.col("c2") - 4000.25)
    return _rounded(stats.gate_counts(t, [Gate(1, "Bright", {"shape": "range", "x_min": 0.1, "x_max": 2.7}, None, "FITC-A", "FITC-A", LOGICLE, LOGICLE)], PANEL))


def _logicle_counts_sql() -> str:
    lo, hi = (inverse_value(y, LOGICLE) for y in (0.1, 2.7))
    return _counts_sql([("Bright", f"(c2 - 4000.25 BETWEEN {lo!r} AND {hi!r})", "true")])


def _saved_tubes(spark: SparkSession, sf_dir: str) -> str:
    """The tubes as FCS files in a folder of their own, with their matrices and a cytometer's name."""
    folder, words = shared_folder(spark, "fcs"), _tube_table(spark, sf_dir).select("sample_id", "keywords")
    save_events(tubes(spark, sf_dir), PANEL, folder, {"$DATE": "01-JAN-2020"}, words)
    return folder


def s_fcs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tubes written and read again, by channel names in another order and case; files hold 32-bit floats."""
    ev = read_events(spark, _saved_tubes(spark, sf_dir), ["time", "PE-A", "FITC-A", "SSC-A", "fsc-a"], rangeBytes="400000")
    return ev.where("error IS NULL").select("sample_id", *[F.col(f"c{i}").alias(n) for i, n in enumerate(("day", "pe", "fitc", "ssc", "fsc"))])


def s_fcs_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read_files(spark, _saved_tubes(spark, sf_dir))
    told = fcs.info(meta).select("path", "version", "n_events", "n_params", "cytometer", "date", F.array_join("channels", "|").alias("channels"), "spillover")
    return told.join(meta.select("path", "sample_id"), "path").drop("path")


def k_fcs_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events of FITC+ of compensated data, a file for each tube, read again with its own keywords."""
    t, folder = tubes(spark, sf_dir), shared_folder(spark, "fcs")
    marked = t.withColumns({"c2_raw": F.col("c2"), "c3_raw": F.col("c3")})
    inside = compensate(marked, PANEL, SPILL).where(GatePlan([CELLS, FITC], PANEL).effective(2)).select("sample_id", "event_idx", "c0", "c1", F.col("c2_raw").alias("c2"), F.col("c3_raw").alias("c3"), "c4")
    fcs.export_population(inside, F.lit(True), PANEL, _tube_table(spark, sf_dir).select("sample_id", "keywords"), "FITC +", folder)
    words = read_files(spark, folder).select("path", F.coalesce(F.try_element_at("keywords", F.lit("SPILL")), F.lit("")).alias("spill"))
    read = read_events(spark, folder).groupBy("path", "sample_id").agg(F.count("event_idx").alias("n"), F.sum("c2").alias("fitc"), F.max("event_idx").alias("last"))
    return _rounded(read.join(words, "path").drop("path"), 2)


STREAMS = 16  # queries over the same files


def s_fcs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tubes' files as streams of ranges: batches of at most 5,000 events, so that files go over several; events for each tube and their greatest number.

    A batch is one task, so several queries share the files, each with a part of every file.
    """
    folder, work, queries = _saved_tubes(spark, sf_dir), shared_folder(spark, "stream"), []
    try:
        with local_logs(spark, work):
            for k in range(STREAMS):
                ev = stream_events(spark, folder, PANEL.channels, eventsPerBatch="5000", progress=f"{work}/{k}/progress", part=str(k), parts=str(STREAMS))
                events = ev.drop("path")
                queries.append(store(events, f"{work}/{k}/events", f"{work}/{k}/checkpoint"))
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    got = spark.read.schema(events.schema).parquet(*[f"{work}/{k}/events" for k in range(STREAMS)])
    return _rounded(got.groupBy("sample_id").agg(F.count("event_idx").alias("n"), F.count_distinct("event_idx").alias("n_distinct"), F.max("event_idx").alias("last"), F.sum("c1").alias("ssc")), 2)


def g_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after edits: FITC+ deleted between its parent and its child and out of an OR, Round put below Cells, a quadrant renamed and the four moved."""
    below = replace(DIM, parent=FITC.id)
    gates = [CELLS, FITC, below, ROUND, boolean_gate(8, "or", [FITC, ROUND]), replace(QUADRANTS[0], name="both"), *QUADRANTS[1:]]
    gates = move_quadrant(reparent(delete_gate(gates, FITC.id), ROUND.id, CELLS.id), 1, 7000.5, 3000.5)
    return _rounded(stats.gate_counts(tubes(spark, sf_dir), gates, PANEL))


def _edits_sql() -> str:
    right, up, inner = "c2 >= 7000.5", "c3 >= 3000.5", f"({_M[1]} AND {_M[3]})"
    corners = [("both", f"({right} AND {up})"), (QUADRANTS[1].name, f"(NOT {right} AND {up})"), (QUADRANTS[2].name, f"(NOT {right} AND NOT {up})"), (QUADRANTS[3].name, f"({right} AND NOT {up})")]
    return _counts_sql([("Cells", _M[1], "true"), ("Dim", f"({_M[1]} AND {_M[5]})", _M[1]), ("Round", inner, _M[1]), ("FITC+ OR Round", inner, "true"), *[(n, m, "true") for n, m in corners]])


def g_unevaluable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates out of order, on a channel that isn't there, below such a gate, below an unknown parent, in a circle, and what Boolean gates make of them."""
    lost = Gate(21, "Lost", {"shape": "range", "x_min": 0.0, "x_max": 1.0}, 1, "APC-A", "APC-A")
    child, orphan = replace(FITC, id=23, name="Child", parent=21), replace(FITC, id=25, name="Orphan", parent=99)
    nots = [boolean_gate(i, "not", [g]) for i, g in ((22, lost), (24, child), (26, orphan), (27, NONE))]
    circle = [Gate(28, "Circle A", {"shape": "boolean", "op": "or", "refs": [29, 1]}), Gate(29, "Circle B", {"shape": "boolean", "op": "not", "refs": [28]})]
    gates = [nots[0], orphan, lost, CELLS, child, *nots[1:], NONE, *circle]
    return _rounded(stats.population_stats(tubes(spark, sf_dir), gates, PANEL, channels=["FITC-A"]))


def _unevaluable_sql() -> str:
    """Only the NOT of a gate that is merely empty holds events; a NOT of an orphan never becomes ready."""
    none = f"({_M[1]} AND {_M[6]})"
    tops = lambda *rows: [(n, "All events", 1, m, "true") for n, m in rows]
    pops = [POPS[0], *tops(("NOT Lost", "false")), POPS[1], ("Lost", "Cells", 2, "false", _M[1]), ("Child", "Lost", 3, "false", "false"), ("Nothing", "Cells", 2, none, _M[1])]
    pops += tops(("NOT Child", "false"), ("NOT Orphan", "false"), ("NOT Nothing", f"NOT {none}"), ("Circle A", "false"), ("Circle B", "false"))
    return _popstats_sql([*pops, ("Orphan", "—", 1, _M[2], "true")], [("FITC-A", "c2")])


def k_gating_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates written as Gating-ML and read again: raw values counted in data space, an ellipse as a 64-gon."""
    text, _ = sinks.gating_ml([CELLS, FITC, DIM, ROUND, FIELD, NOTS, ORS])
    return _rounded(stats.gate_counts(tubes(spark, sf_dir), read_gating_ml(text), PANEL))


def _gating_ml_sql() -> str:
    dim = f"({_M[1]} AND c3 BETWEEN {150 * math.sinh(3.0)!r} AND {150 * math.sinh(4.2)!r})"
    turn, s = [math.tau * i / 64 for i in range(64)], ROUND.shape
    c, d = math.cos(s["angle"]), math.sin(s["angle"])
    ring = _polygon_sql([(s["cx"] + s["rx"] * math.cos(t) * c - s["ry"] * math.sin(t) * d, s["cy"] + s["rx"] * math.cos(t) * d + s["ry"] * math.sin(t) * c) for t in turn])
    rows = [("Cells", _M[1], "true"), ("FITC_", _FITC, _M[1]), ("Dim", dim, _M[1]), ("Round", ring, "true"), ("Field", _M[4], "true"), ("NOT_FITC_", f"({_M[1]} AND NOT {_FITC})", _M[1]), ("FITC__OR_Round", f"({_FITC} OR {ring})", "true")]
    return _counts_sql(rows)


def k_r_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouped table that goes with the R script, as a reader of the file finds it."""
    folder = shared_folder(spark, "r")
    sinks.r_bundle(_rounded(stats.population_stats(tubes(spark, sf_dir), TREE, PANEL)).withColumn("group", F.substring("sample_id", 1, 1)), folder)
    return spark.read.option("header", True).csv(f"{folder}/populations.csv")


def k_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.gate_counts(tubes(spark, sf_dir), COUNTS["g_not"][0], PANEL)
    return sinks.tsv(rows.select("sample_id", "ord", "gate", F.nullif("n_in", F.lit(0)).alias("n_in"), "n_parent", "n_total"))


def p_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under a matrix that went through its CSV and JSON files and beats the one embedded."""
    found = choose_spillover(True, Spillover.load(Spillover.load(SPILL.to_csv()).to_json()), "2,FITC-A,PE-A,1,0.5,0.5,1", strict=True)
    out = compensate(tubes(spark, sf_dir), PANEL, found)
    return _rounded(out.select("event_idx", "sample_id", F.col("c2").alias("fitc"), F.col("c3").alias("pe"), F.lit(found.format()).alias("keyword"), F.lit(found.max_off_diagonal).alias("spread")))


def p_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default axes of a panel: one carried over under another case, one logicle that can't be built (and so is linear), the rest by the kind of channel."""
    panel = Panel((*PANEL.channels, "APC-A"), (*PANEL.columns, "c5"))
    axes = default_transforms(panel, {"fitc-a": ASINH, "PE-A": Transform("logicle", w=-1.0)})
    t = tubes(spark, sf_dir).withColumn("c5", F.col("c1") * 100 - 1000)
    shown = {n: forward(F.col(c), axes[n]) for n, c in zip(panel.channels, panel.columns, strict=True)}
    names = {"fsc": "FSC-A", "fitc": "FITC-A", "pe": "PE-A", "day": "Time"}
    label = F.lit("|".join(axes[n].label for n in panel.channels))
    return _rounded(t.select("event_idx", "sample_id", *[shown[n].alias(k) for k, n in names.items()], inverse(shown["APC-A"], LOGICLE).alias("apc_back"), (shown["APC-A"] == F.col("c5")).alias("apc_linear"), label.alias("axes")))


def s_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved session opened again after one of its files was lost: its gates over the files that are left, with their groups and the active one."""
    folder = _saved_tubes(spark, sf_dir)
    meta = read_files(spark, folder).where("error IS NULL").select("path", "sample_id", "n_events", "n_params", "error")
    there = sorted(r["path"] for r in meta.select("path").collect())  # a session names its files
    saved = Session((f"{folder}/lost.fcs", *there), ("lost", *[f"group {i % 2}" for i in range(len(there))]), 2, True, (ASINH,), (CELLS, FITC), {"channels": ["FITC-A"], "rows": [[1.0, 2.0]]})
    session = Session.load(saved.dump(), found=there)
    tags = spark.createDataFrame([(p, g, i == session.active) for i, (p, g) in enumerate(zip(session.paths, session.groups, strict=True))], "path string, grp string, active boolean")
    tubes_ = meta.join(tags, "path").select("sample_id", "grp", "active", F.lit(session.spillover is None).alias("matrix_dropped"))
    peeked = fcs.peek_files(spark, f"{folder}/*.fcs").select(F.regexp_extract("path", r"([^/]*)\.fcs$", 1).alias("sample_id"), F.col("n_events").alias("n_peeked"))
    counts = stats.gate_counts(read_events(spark, folder, PANEL.channels).where("error IS NULL"), list(session.gates), PANEL)
    return _rounded(counts.join(tubes_, "sample_id").join(peeked, "sample_id"))


def _session_sql() -> str:
    floats = TUBES.replace("tubes AS", "exact AS", 1) + ", tubes AS (SELECT sample_id, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in PANEL.columns) + " FROM exact)"
    tags = "tags AS (SELECT sample_id, 'group ' || CAST((row_number() OVER (ORDER BY sample_id) - 1) % 2 AS VARCHAR) AS grp, row_number() OVER (ORDER BY sample_id) = 2 AS active FROM (SELECT DISTINCT sample_id FROM exact))"
    counts = _counts_sql([("Cells", _M[1], "true"), ("FITC+", _FITC, _M[1])], f"{floats}, {tags}")
    return f"SELECT * FROM ({counts}) JOIN (WITH {floats}, {tags} SELECT sample_id, grp, active, true AS matrix_dropped FROM tags) USING (sample_id) JOIN (WITH {TUBES} SELECT sample_id, count(*) AS n_peeked FROM tubes GROUP BY sample_id) USING (sample_id)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    x, y = F.col, F.col
    columns = {
        "p_log": lambda: forward(x("c_acctbal"), Transform("log")),
        "p_asinh": lambda: forward(x("c_acctbal"), ASINH),
        "p_asinh_inverse": lambda: inverse(y("c_acctbal") / 2000, ASINH),
        "p_log_inverse": lambda: inverse(y("c_acctbal") / 5000, Transform("log")),
        "p_logicle": lambda: forward(x("c_acctbal"), LOGICLE),
        "p_logicle_inverse": lambda: inverse((y("c_acctbal") + 1000) / 11000 * 4.5, LOGICLE),
    }
    named = (p_compensate, a_channel_stats, a_popstats, a_popstats_empty, a_spillover, a_residual, a_flow_rate, a_margins, a_qc, a_stain_index, a_titration, a_batch, a_histogram, a_density, a_singlet, a_mode, s_range_mask, s_spillover_parse)
    named += (g_edits, g_unevaluable, k_gating_ml, k_r_table, k_tsv, p_matrix_file, p_axes, s_session)
    named += (s_fcs_events, s_fcs_info, s_fcs_stream, k_fcs_gated)
    named += (a_titration_lost, a_contours, a_auto_threshold, a_sample, a_tube_batch, a_tube_rejects, a_self_check, g_deepest, g_logicle, p_tube_inverse)
    named += (a_best_titration, a_heat, s_spillover_keyword, a_valley, a_cross_check, a_channel_names, a_chart, a_backgate, k_population_table, k_titration_table, k_qc_table, k_transform_dump, k_events_text, p_formats, p_utc_date, p_file_token, p_asinh_panel, g_missing_channels)
    return {n: _column_query(c) for n, c in columns.items()} | {n: _count_query(n) for n in COUNTS} | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    customer = lambda e: f"SELECT c_custkey, round({e}, 6) AS value FROM customer"
    table = "WITH r AS (" + _popstats_sql(POPS, STATS) + """) SELECT substr(sample_id, 1, 1) AS "group", sample_id AS sample, population, parent, CAST(depth AS VARCHAR) AS depth, CAST(count AS VARCHAR) AS count,
          printf('%.4f', pct_parent) AS pct_parent, printf('%.4f', pct_total) AS pct_total, channel, coalesce(printf('%.4f', median), 'NA') AS median, coalesce(printf('%.4f', mean), 'NA') AS mean, coalesce(printf('%.4f', cv), 'NA') AS cv FROM r"""
    return {
        "p_log": customer("log10(greatest(c_acctbal, 1.0))"),
        "p_asinh": customer("asinh(c_acctbal / 150.0)"),
        "p_asinh_inverse": customer("(exp(c_acctbal / 2000) - exp(-c_acctbal / 2000)) / 2 * 150.0"),
        "p_log_inverse": customer("pow(10, c_acctbal / 5000)"),
        "p_logicle": _logicle_sql(),
        "p_logicle_inverse": _logicle_inverse_sql(),
        "a_spillover": _spillover_sql(),
        "a_valley": VALLEY_SQL,
        "a_cross_check": _cross_check_sql(),
        "k_population_table": table,
        "k_r_table": table,
        "k_tsv": f"SELECT concat_ws(chr(9), sample_id, ord, gate, coalesce(CAST(nullif(n_in, 0) AS VARCHAR), 'NA'), n_parent, n_total) AS value FROM ({_counts_sql(COUNTS['g_not'][1])})",
        "g_edits": _edits_sql(),
        "g_unevaluable": _unevaluable_sql(),
        "k_gating_ml": _gating_ml_sql(),
        "p_matrix_file": f"WITH {COMPENSATED} SELECT event_idx, sample_id, round(c2, 6) AS fitc, round(c3, 6) AS pe, '2,FITC-A,PE-A,1,0.08,0.03,1' AS keyword, CAST(0.08 AS DOUBLE) AS spread FROM comp",
        "p_axes": f"WITH {TUBES} SELECT event_idx, sample_id, round(c0, 6) AS fsc, round(asinh(c2 / 150.0), 6) AS fitc, round(c3, 6) AS pe, c4 AS day, round(c1 * 100 - 1000, 6) AS apc_back, false AS apc_linear, 'linear|linear|asinh 150|logicle T=262144 W=-1 M=4.5 A=0|linear|logicle T=262144 W=0.5 M=4.5 A=0' AS axes FROM tubes",
        "s_session": _session_sql(),
        "k_titration_table": "WITH r AS (" + TITRATION_SQL + """) SELECT '' AS "group", sample_id AS sample, '' AS concentration, """ + ", ".join(f"coalesce(printf('%.4f', {c}), 'NA') AS {c}" for c in sinks.TITRATION[3:]) + " FROM r",
        "k_qc_table": "WITH r AS (" + QC_SQL + """) SELECT '' AS "group", sample_id AS sample, CAST(n_events AS VARCHAR) AS events, coalesce(printf('%.2f', viable), '') AS pct_viable, coalesce(printf('%.2f', flow_dev), '') AS flow_dev_pct,
          coalesce(printf('%.2f', offscale_pct), '') AS offscale_pct, coalesce(offscale_channel, '') AS offscale_channel, flags FROM r""",
        "k_transform_dump": "SELECT printf('%.6f', c_acctbal) AS raw, printf('%.10f', round(asinh(c_acctbal / 150.0), 8)) AS transformed FROM customer",
        "k_events_text": f"WITH {TUBES} SELECT " + ", ".join(f"printf('%.4f', {c}) AS \"{n}\"" for n, c in zip(PANEL.channels, PANEL.columns, strict=True)) + " FROM tubes",
        "p_formats": "SELECT c_custkey, printf('%.2f', c_acctbal) AS two, regexp_replace(c_name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, TRY_CAST(trim(substr(c_name, 10, 20)) AS DOUBLE) AS tag, CAST(NULL AS DOUBLE) AS no_tag FROM customer",
        "p_utc_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders",
        "p_file_token": _token_sql(),
        "p_asinh_panel": f"WITH {TUBES} SELECT sample_id, event_idx, round(c0, 6) AS c0, round(c1, 6) AS c1, round(asinh(c2 / 150.0), 6) AS c2, round(asinh(c3 / 150.0), 6) AS c3, c4 FROM tubes",
        "g_missing_channels": f"WITH {CHANNELS_SQL}, wanted AS (SELECT DISTINCT sample_id, c AS channel FROM channels, unnest(['FSC-A', 'SSC-A', 'FITC-A', 'PE-A']) AS u(c)) SELECT w.sample_id, w.channel FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM channels c WHERE c.sample_id = w.sample_id AND upper(c.name) = upper(w.channel))",
        "a_channel_names": f"WITH {CHANNELS_SQL} SELECT CAST(min(ord) AS BIGINT) AS ord, arg_min(name, ord) AS channel FROM channels WHERE upper(name) <> 'TIME' GROUP BY upper(name)",
        "a_chart": f"WITH {TUBES} SELECT substr(sample_id, 1, 1) AS \"group\", sample_id, round(quantile_cont(c0, 0.5) FILTER (WHERE {_M[1]}), 6) AS value FROM tubes GROUP BY sample_id HAVING count(*) FILTER (WHERE {_M[1]}) > 0",
        "a_backgate": f"WITH {TUBES} SELECT *, 'population' AS layer FROM ({_sample_sql(_FITC, 20000)}) UNION ALL SELECT *, 'parent' FROM ({_sample_sql(_M[1], 8000)})",
        "s_fcs_events": f"WITH {TUBES} SELECT sample_id, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {n}" for c, n in zip(("c4", "c3", "c2", "c1", "c0"), ("day", "pe", "fitc", "ssc", "fsc"), strict=True)) + " FROM tubes",
        "s_fcs_info": f"WITH {TUBES}, n AS (SELECT sample_id, count(*) AS n_events FROM tubes GROUP BY sample_id) SELECT sample_id, 'FCS3.0' AS version, n_events, 5 AS n_params, CASE WHEN sample_id IN ('RO') THEN 'none' END AS cytometer, '01-JAN-2020' AS date, 'FSC-A|SSC-A|FITC-A|PE-A|Time' AS channels, CASE sample_id "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (_, v) in TUBE_SPILL.items()) + " END AS spillover FROM n",
        "s_fcs_stream": f"WITH {TUBES} SELECT sample_id, count(*) AS n, count(*) AS n_distinct, count(*) - 1 AS last, round(sum(CAST(CAST(c1 AS FLOAT) AS DOUBLE)), 2) AS ssc FROM tubes GROUP BY sample_id",
        "k_fcs_gated": f"WITH {COMPENSATED}, raw AS (SELECT tubes.sample_id, tubes.c2 FROM (SELECT *, c2 * {float(_INV[0][0])!r} + c3 * {float(_INV[1][0])!r} AS f FROM tubes) tubes WHERE {_M[1]} AND f BETWEEN 4500.5 AND 9500.5) SELECT sample_id || '_FITC__' AS sample_id, count(*) AS n, count(*) - 1 AS last, round(sum(CAST(CAST(c2 AS FLOAT) AS DOUBLE)), 2) AS fitc, CASE sample_id "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (_, v) in TUBE_SPILL.items()) + " ELSE '' END AS spill FROM raw GROUP BY sample_id",
        "a_sample": f"WITH {TUBES} {_sample_sql(_FITC, 700)}",
        "g_deepest": _deepest_sql(),
        "g_logicle": _logicle_counts_sql(),
        "a_contours": _contours_sql(24),
        "a_tube_batch": _tube_batch_sql(),
        "a_tube_rejects": f"WITH {TUBES} SELECT DISTINCT sample_id, CASE sample_id WHEN 'NO' THEN 'compensation failed: the matrix is singular' WHEN 'RF' THEN 'compensation failed: no channel APC-A' ELSE 'missing channels: FSC-A' END AS reason FROM tubes WHERE sample_id IN ('NO', 'RF', 'RO')",
        "p_tube_inverse": _tube_inverse_sql(),
        "a_self_check": _self_check_sql(),
        "a_titration_lost": f"SELECT sample_id, pct_positive, mfi_pos, CAST(NULL AS DOUBLE) AS mfi_neg, CAST(NULL AS DOUBLE) AS rsd_neg, CAST(NULL AS DOUBLE) AS stain_index FROM ({TITRATION_SQL})",
        "a_auto_threshold": f"WITH {TUBES}, {_BRIGHT_SQL}, shown AS (SELECT sample_id, asinh(c2 / 150.0) AS v FROM b), {_valley_ctes('shown', 'sample_id', 128)} SELECT sample_id, round(thr, 6) AS x_min, round(greatest(hi, thr), 6) AS x_max FROM valley JOIN valley_e USING (sample_id)",
        "p_compensate": f"WITH {COMPENSATED} SELECT event_idx, sample_id, round(c2, 6) AS fitc, round(c3, 6) AS pe FROM comp",
        **{n: _counts_sql(rows) for n, (_, rows) in COUNTS.items()},
        "a_channel_stats": _channel_stats_sql(),
        "a_popstats": _popstats_sql(POPS, STATS, "comp", COMPENSATED),
        "a_popstats_empty": _popstats_sql(WITH_EMPTY, [("FITC-A", "c2")]),
        "a_residual": _residual_sql(),
        "a_flow_rate": f"WITH {EV}, {FLOW} SELECT ends.sample_id, flow.n_bins, flow.counts, round(flow.dev, 6) AS max_dev_pct FROM ends LEFT JOIN flow USING (sample_id)",
        "a_margins": f"WITH {TUBES}, {MARGINS} SELECT sample_id, ord, channel, round(pct, 6) AS pct FROM marg",
        "a_qc": QC_SQL,
        "a_stain_index": "SELECT p_partkey, round(CASE WHEN abs(p_size - 10.0) >= 1e-9 THEN (p_retailprice - p_size) / (2 * (p_size - 10.0)) END, 6) AS si FROM part",
        "a_titration": TITRATION_SQL,
        "a_best_titration": f"SELECT sample_id, stain_index FROM ({TITRATION_SQL}) WHERE stain_index IS NOT NULL ORDER BY stain_index DESC, sample_id DESC LIMIT 1",
        "a_heat": f"WITH {_grid_sql(20)} SELECT sample_id, bx, by_, CAST(least(floor(sqrt(n / max(n) OVER (PARTITION BY sample_id)) * 13), 13) AS INTEGER) AS bucket FROM g",
        "s_spillover_keyword": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN n_name WHEN n_nationkey % 2 = 0 THEN 'own' WHEN n_nationkey % 3 = 0 THEN n_name END AS spill FROM nation",
        "a_batch": _batch_sql(),
        "a_histogram": HISTOGRAM_SQL,
        "a_density": f"WITH {TUBES} SELECT sample_id, {_bin_sql('c0', 100000.0)} AS bx, {_bin_sql('c1', 50.0)} AS by_, count(*) AS n FROM tubes GROUP BY ALL",
        "a_singlet": SINGLET_SQL,
        "a_mode": f"WITH {TUBES}, {_mode_ctes('c0', 'tubes')} SELECT sample_id, round(lo + (bin + 0.5) / 64 * (hi - lo), 6) AS mode FROM m_",
        "s_range_mask": "SELECT o_orderkey, o_orderkey & 1023 AS masked FROM orders",
        "s_spillover_parse": "SELECT n_nationkey, 2 AS n, n_name || '-A|PE-A' AS names, round(CAST(2.5 AS DOUBLE) + n_nationkey / 100.0, 6) AS total FROM nation",
    }
