"""Channel statistics, gate counts and population statistics.

Percentiles are exact. Where the largest tube's figures fit a bounded state they come with the other figures, from one pass; else they
are found by ranges (``quantiles``), so that no task holds a tube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import finite
from ..model import ALL_EVENTS, NO_PARENT, Gate, Panel, tree_order
from ..plans.gates import GatePlan
from ..sources.shared import written
from .quantiles import exact_quantiles

FLAT = 1e-12  # means and SDs up to here count as none


def sample_sd(x: Column) -> Column:
    """Of one value: 0."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def cv(x: Column) -> Column:
    mean = F.avg(x)
    return F.when(F.abs(mean) > FLAT, 100 * sample_sd(x) / F.abs(mean))


def percentiles(x: Column, *at: float) -> Column:
    """Exact percentiles, as an array, from one state of the distinct values."""
    return F.percentile(x, F.array(*[F.lit(p) for p in at]))


#: Values that the percentiles of one tube may hold in a task's state: events times figures.
STATE = 4_000_000


def _fits(events: DataFrame, figures: int, sample: str, limit: int) -> bool:
    """Whether the largest tube's percentiles fit the limit; one number comes to the driver."""
    largest = events.groupBy(sample).count().agg(F.max("count")).first()[0]
    return (largest or 0) * figures <= limit


def _with_quantiles(aggs: dict[int, list[Column]], cells: dict[int, Column], shares: tuple[float, ...], events: DataFrame, sample: str, limit: int) -> DataFrame:
    """(sample, _cell, s, q): for each cell the struct s of its figures ``aggs`` (n, lo and hi among them) and the percentiles q of its values."""
    small = _fits(events, len(cells), sample, limit)
    struct = lambda i: F.struct(*aggs[i], *([percentiles(cells[i], *shares).alias("q")] if small else []))
    out = events.groupBy(sample).agg(*[struct(i).alias(f"_{i}") for i in cells])
    out = out.select(sample, F.inline(F.array(*[F.struct(F.lit(i).alias("_cell"), F.col(f"_{i}").alias("s")) for i in cells])))
    if small:
        return out.select(sample, "_cell", "s", F.col("s.q").alias("q"))
    out = written(out, "figures")
    values = events.select(sample, F.inline(F.array(*[F.struct(F.lit(i).alias("_cell"), x.cast("double").alias("_v")) for i, x in cells.items()])))
    q = exact_quantiles(values, "_v", shares, [sample, "_cell"], ends=out.select(sample, "_cell", "s.n", "s.lo", "s.hi"))
    return out.join(q.select(sample, "_cell", F.array(*[f"q{i}" for i in range(len(shares))]).alias("q")), [sample, "_cell"], "left")


def channel_stats(events: DataFrame, panel: Panel, sample: str = "sample_id", state: int = STATE) -> DataFrame:
    """One row for each sample and channel; non-finite values are left out, undefined figures are null."""
    cells = {i: finite(F.col(c).cast("double")) for i, (_, c) in enumerate(panel.stat_channels())}

    def figures(x: Column) -> list[Column]:
        parts = {"n": F.count(x), "mean": F.avg(x), "geo_mean": F.exp(F.avg(F.when(x > 0, F.ln(x)))), "sd": sample_sd(x), "cv": cv(x), "lo": F.min(x), "hi": F.max(x)}
        return [v.alias(k) for k, v in parts.items()]

    out = _with_quantiles({i: figures(x) for i, x in cells.items()}, cells, (0.05, 0.25, 0.5, 0.75, 0.95), events, sample, state)
    name = F.get(F.array(*[F.lit(n) for n, _ in panel.stat_channels()]), F.col("_cell"))
    q = {k: F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("p05", "p25", "median", "p75", "p95"))}
    return out.select(sample, name.alias("channel"), "s.n", "s.mean", "s.geo_mean", q["median"], "s.sd", "s.cv", F.col("s.lo").alias("min"), F.col("s.hi").alias("max"), *[q[k] for k in ("p05", "p25", "p75", "p95")])


def gate_counts(events: DataFrame, gates: list[Gate], panel: Panel, sample: str = "sample_id") -> DataFrame:
    """(sample, ord, gate, n_in, n_parent, n_total, pct_parent) in list order, in one pass."""
    plan = GatePlan(gates, panel)
    parts, place = [], {id: i for i, id in enumerate(plan.known)}
    marked = events.select(sample, *[plan.effective(id).alias(f"_m{i}") for id, i in place.items()])
    for i, g in enumerate(gates):
        above = F.count(F.lit(1)) if g.parent not in plan.known else F.count_if(F.col(f"_m{place[g.parent]}"))
        parts.append(F.struct(F.lit(i).alias("ord"), F.lit(g.name).alias("gate"), F.count_if(F.col(f"_m{place[g.id]}")).alias("n_in"), above.alias("n_parent"), F.count(F.lit(1)).alias("n_total")))
    out = marked.groupBy(sample).agg(F.array(*parts).alias("rows")).select(sample, F.inline("rows"))
    return out.withColumn("pct_parent", F.when(F.col("n_parent") > 0, 100.0 * F.col("n_in") / F.col("n_parent")).otherwise(0.0))


def population_stats(events: DataFrame, gates: list[Gate], panel: Panel, sample: str = "sample_id", channels: list[str] | None = None, state: int = STATE) -> DataFrame:
    """Statistics of "All events" and of every gate, in tree order, for each channel.

    One aggregation over the events, with three more passes if their percentiles are beyond ``state``; populations without events have a row too. Counts include
    events whose value isn't finite, the other figures leave them out.
    """
    plan = GatePlan(gates, panel)
    pops = [(ALL_EVENTS, NO_PARENT, 0, F.lit(True), None)]
    for g, depth in tree_order(gates):
        parent = ALL_EVENTS if g.parent is None else plan.known[g.parent].name if g.parent in plan.known else NO_PARENT
        pops.append((g.name, parent, depth + 1, plan.effective(g.id), g.parent if g.parent in plan.known else None))
    marked = events.select(sample, *[c for c in panel.columns if c in events.columns], *[m.alias(f"_m{i}") for i, (*_, m, _) in enumerate(pops)])
    place = {g.id: i + 1 for i, (g, _) in enumerate(tree_order(gates))}
    wanted = [(n, c) for n, c in panel.stat_channels() if channels is None or n in channels]
    aggs, cells, rows = {}, {}, []
    for i, (name, parent, depth, _, above) in enumerate(pops):
        mask, base = F.col(f"_m{i}"), F.col(f"_m{place[above] if above is not None else 0}")
        for j, (channel, c) in enumerate(wanted):
            cell = i * len(wanted) + j
            x = cells[cell] = F.when(mask, finite(F.col(c).cast("double")))
            figures = {"count": F.count_if(mask), "above": F.count_if(base), "total": F.count(F.lit(1)), "n": F.count(x), "mean": F.avg(x), "cv": cv(x), "lo": F.min(x), "hi": F.max(x)}
            aggs[cell] = [v.alias(k) for k, v in figures.items()]
            rows.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("population"), F.lit(parent).alias("parent"), F.lit(depth).alias("depth"), F.lit(channel).alias("channel")))
    if not cells:
        raise ValueError("no channel is asked for")
    out = _with_quantiles(aggs, cells, (0.5, 0.84), marked, sample, state).withColumn("_row", F.get(F.array(*rows), F.col("_cell")))
    share = lambda d: F.when(F.col(d) > 0, 100.0 * F.col("s.count") / F.col(d)).otherwise(0.0)
    median = F.get("q", F.lit(0))
    return out.select(sample, "_row.ord", "_row.population", "_row.parent", "_row.depth", "s.count", share("s.above").alias("pct_parent"), share("s.total").alias("pct_total"), "_row.channel", median.alias("median"), "s.mean", "s.cv", ((F.get("q", F.lit(1)) - median) / F.lit(0.995)).alias("rsd"))


def stain_index(pos: Column, neg: Column, rsd: Column) -> Column:
    """(pos - neg) / (2 rsd); null if undefined."""
    return finite(F.when(F.abs(rsd) >= 1e-9, (pos - neg) / (2 * rsd)))


def titration(stats: DataFrame, positive: str, negative: str, channel: str, sample: str = "sample_id") -> DataFrame:
    """(sample, concentration, pct_positive, mfi_pos, mfi_neg, rsd_neg, stain_index) of ``population_stats``.

    The share is that of the positive population in its parent. The concentration is a number in a ``tag`` column if there is one. Of populations of one name the
    first counts; one that a sample hasn't leaves its figures undefined. Samples without the channel are left out.
    """
    tag = F.trim("tag").try_cast("double") if "tag" in stats.columns else F.lit(None).cast("double")
    one = lambda name, c: F.min_by(F.when(F.col("population") == name, F.col(c)), F.when(F.col("population") == name, F.col("ord")))
    rows = stats.where(F.upper("channel") == channel.upper()).withColumn("_c", finite(tag)).groupBy(sample).agg(
        F.max("_c").alias("concentration"), one(positive, "pct_parent").alias("pct_positive"), one(positive, "median").alias("mfi_pos"), one(negative, "median").alias("mfi_neg"), one(negative, "rsd").alias("rsd_neg")
    )
    return rows.withColumn("stain_index", stain_index(F.col("mfi_pos"), F.col("mfi_neg"), F.col("rsd_neg")))


def best_titration(rows: DataFrame, sample: str = "sample_id") -> DataFrame:
    """The sample of the greatest stain index, the last of equals by concentration and name."""
    best = F.max_by(F.struct(*rows.columns), F.struct("stain_index", F.coalesce("concentration", F.lit(float("-inf"))), sample))
    return rows.where("stain_index IS NOT NULL").agg(best.alias("r")).where("r IS NOT NULL").select("r.*")
