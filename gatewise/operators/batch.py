"""Many samples at once: panels that differ, samples that can't be gated."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Gate, Panel
from ..plans.gates import gate_channels, missing_channels
from .compensation import Spillover, compensate, compensate_tubes, tube_matrices
from .stats import population_stats


def batch(panels: Mapping[str, tuple[Panel, DataFrame]], gates: list[Gate], spillover: Mapping[str, Spillover] | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(population statistics of all samples, skipped panels with the reason).

    ``panels``: name -> (panel, events of all its samples). A panel without a gate's channel is skipped
    before its events are read. Results are unioned; channels that a panel hasn't are absent.
    """
    found, skipped = [], []
    for name, (panel, events) in panels.items():
        if gone := missing_channels(gates, panel):
            skipped.append((name, f"missing channels: {', '.join(gone)}"))
            continue
        try:
            events = compensate(events, panel, (spillover or {}).get(name))
        except ValueError as e:
            skipped.append((name, str(e)))
            continue
        found.append(population_stats(events, gates, panel).withColumn("panel", F.lit(name)))
    return (reduce(DataFrame.unionByName, found) if found else None), skipped


def batch_tubes(panels: Mapping[str, tuple[Panel, DataFrame]], gates: list[Gate], tubes: DataFrame, override: Spillover | None = None, on: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(population statistics, skipped tubes with the reason), each tube compensated by the override or by its own matrix.

    ``tubes`` has (sample_id, channels, keywords), ``panels`` the events of the tubes of each panel. A tube is skipped by itself: for channels that gates name
    and it hasn't, or for a matrix that can't be read, inverted or found in its channels. A tube without a matrix is taken as it is.
    """
    lost = F.filter(F.array(*[F.lit(c) for c in gate_channels(gates)]).cast("array<string>"), lambda c: ~F.exists("channels", lambda n: F.upper(n) == F.upper(c)))
    judged = tubes.withColumn("_lost", lost)
    absent = judged.where(F.size("_lost") > 0).select("sample_id", F.concat(F.lit("missing channels: "), F.array_join("_lost", ", ")).alias("reason"))
    matrices = tube_matrices(judged.where(F.size("_lost") == 0), override, on)
    skipped = absent.unionByName(matrices.where("reason IS NOT NULL").select("sample_id", "reason"))
    found = [population_stats(compensate_tubes(events, panel, matrices), gates, panel).withColumn("panel", F.lit(name)) for name, (panel, events) in panels.items() if not missing_channels(gates, panel)]
    return (reduce(DataFrame.unionByName, found) if found else None), skipped


def channel_union(panels: list[Panel]) -> list[str]:
    """Channel names of all panels, each once in any case, in the order of their first use."""
    seen: dict[str, str] = {}
    for p in panels:
        for n, _ in p.stat_channels():
            seen.setdefault(n.upper(), n)
    return list(seen.values())


def channel_names(channels: DataFrame) -> DataFrame:
    """(ord, channel) of all samples' channels, each once in any case, as first used; ``channels`` has (ord, name), ord the place of use."""
    first = channels.where(F.upper("name") != "TIME").groupBy(F.upper("name").alias("_upper")).agg(F.min(F.struct("ord", "name")).alias("f"))
    return first.select("f.ord", F.col("f.name").alias("channel"))


def chart_series(stats: DataFrame, population: str, channel: str, figure: str, sample: str = "sample_id", group: str | None = None) -> DataFrame:
    """(group, sample, value) of one figure; undefined values are left out."""
    rows = stats.where((F.col("population") == population) & (F.upper("channel") == channel.upper()))
    cols = [F.col(group).alias("group") if group else F.lit("").alias("group"), F.col(sample), F.col(figure).alias("value")]
    return rows.select(*cols).where("value IS NOT NULL AND abs(value) < double('Infinity')")
