"""Spillover matrices: one on the driver as linear combinations of columns, or one of each tube as a table that events are joined with."""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.formats import finite
from ..model import Panel
from ..sources.shared import written

#: Keywords that may hold a spillover matrix, in order.
SPILL_KEYWORDS = ("$SPILLOVER", "SPILLOVER", "$SPILL", "SPILL")
LARGEST_INVERSE = 1e6


def shortest(v: float) -> str:
    """The fewest digits that give the number back, without an exponent or an empty fraction."""
    return np.format_float_positional(float(v), trim="-")


@dataclass(frozen=True)
class Spillover:
    channels: tuple[str, ...]
    matrix: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        m = np.array(self.matrix, float)
        if m.shape != (len(self.channels),) * 2 or not len(self.channels) or not np.isfinite(m).all():
            raise ValueError("a spillover matrix is square and finite, with a name for each row")

    @classmethod
    def parse(cls, text: str) -> Spillover:
        """``n,name1..nameN,v11..vNN``; what follows is passed over."""
        parts = [p.strip() for p in text.split(",")]
        n = int(parts[0])
        values = [float(v) for v in parts[1 + n : 1 + n + n * n]]
        if n < 1 or len(values) != n * n:
            raise ValueError("too few values")
        return cls(tuple(parts[1 : 1 + n]), tuple(tuple(values[i * n : i * n + n]) for i in range(n)))

    @classmethod
    def load(cls, text: str) -> Spillover:
        """JSON ``{channels, matrix}`` or CSV with a corner cell."""
        if text.lstrip().startswith("{"):
            data = json.loads(text)
            return cls(tuple(data["channels"]), tuple(map(tuple, data["matrix"])))
        rows = [r for r in csv.reader(io.StringIO(text)) if r]
        return cls(tuple(c.strip() for c in rows[0][1:]), tuple(tuple(float(x) for x in r[1:]) for r in rows[1:]))

    @classmethod
    def of_table(cls, table: DataFrame, channels: list[str]) -> Spillover:
        """From rows (control, source, target, value, reason), as many as the matrix has cells; a reason is an error."""
        rows = table.collect()
        if bad := [f"{r['control']}: {r['reason']}" for r in rows if r["reason"]]:
            raise ValueError("; ".join(sorted(bad)))
        cells = {(r["source"], r["target"]): r["value"] for r in rows}
        return cls(tuple(channels), tuple(tuple(cells[s, t] for t in channels) for s in channels))

    def format(self) -> str:
        return ",".join([str(len(self.channels)), *self.channels, *(shortest(v) for row in self.matrix for v in row)])

    def to_csv(self) -> str:
        return "\n".join([",".join(["", *self.channels]), *(",".join([c, *(shortest(v) for v in r)]) for c, r in zip(self.channels, self.matrix, strict=True))]) + "\n"

    def to_json(self) -> str:
        return json.dumps({"channels": self.channels, "matrix": self.matrix})

    @property
    def inverse(self) -> np.ndarray:
        try:
            inv = np.linalg.inv(np.array(self.matrix, float))
        except np.linalg.LinAlgError as e:
            raise ValueError("singular matrix") from e
        if not np.isfinite(inv).all() or np.abs(inv).max() > LARGEST_INVERSE:
            raise ValueError("ill-conditioned matrix")
        return inv

    @property
    def max_off_diagonal(self) -> float:
        m = np.abs(np.array(self.matrix, float))
        np.fill_diagonal(m, 0)
        return float(m.max())


def compensate(events: DataFrame, panel: Panel, spillover: Spillover | None) -> DataFrame:
    """``events`` with the matrix's channels unmixed; others stay. A missing channel is an error."""
    if spillover is None:
        return events
    columns = [panel.find(c) for c in spillover.channels]
    if None in columns:
        raise ValueError(f"no channel {spillover.channels[columns.index(None)]}")
    inv, new = spillover.inverse, {}
    for j, to in enumerate(columns):
        out: Column = F.lit(0.0)
        for i, c in enumerate(columns):
            out = out + F.col(c) * F.lit(float(inv[i][j]))
        new[to] = out
    return events.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def choose_spillover(on: bool, override: Spillover | None, embedded: str | None, strict: bool = False) -> Spillover | None:
    """Off: none; else the override, else the embedded keyword; ``strict`` demands one."""
    if not on:
        return None
    found = override or (Spillover.parse(embedded) if embedded else None)
    if found is None and strict:
        raise ValueError("no spillover matrix")
    return found


def spillover_keyword(keywords: Column) -> Column:
    return F.coalesce(*[F.try_element_at(keywords, F.lit(k)) for k in SPILL_KEYWORDS])


def parsed_spillover(text: Column) -> Column:
    """Struct (n, names, values) of a spillover keyword column."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    n = parts[0].cast("int")
    return F.struct(n.alias("n"), F.slice(parts, F.lit(2), n).alias("names"), F.transform(F.slice(parts, n + 2, n * n), lambda v: v.cast("double")).alias("values"))


def range_mask(value: Column, span: Column) -> Column:
    """Integer data under the mask of their range: next power of two less one; a range under 1, not whole or of 63 bits and more masks nothing."""
    whole = (span >= 1) & (span == F.floor(span)) & (span <= 2.0**62)
    bits = F.when(span > 1, F.length(F.bin(F.when(whole, span).cast("long") - 1))).otherwise(0)
    return F.when(whole, value.bitwiseAND(F.when(bits > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(64) - bits)).otherwise(F.lit(0).cast("long")))).otherwise(value)


def inverse_matrix(values: Column, n: Column) -> Column:
    """Inverse of an n x n matrix given by rows in one array, as an array of its rows; null if it is singular.

    Gauss-Jordan elimination with the greatest pivot of each column, for all rows of a table at once.
    """
    at = F.sequence(F.lit(0), n - 1)
    start = F.transform(at, lambda r: F.concat(F.slice(values, r * n + 1, n), F.transform(at, lambda c: F.when(c == r, 1.0).otherwise(0.0))))

    def step(m: Column, k: Column) -> Column:
        pivot = F.array_max(F.transform(m, lambda row, i: F.when(i >= k, F.struct(F.abs(F.get(row, k)).alias("size"), (-i).alias("i")))))

        def reduced(lead: Column, p: Column) -> Column:
            rest = lambda row: F.zip_with(row, lead, lambda x, y: x - F.get(row, k) * y)
            return F.transform(m, lambda row, i: F.when(i == k, lead).otherwise(let(F.when(i == p, F.get(m, k)).otherwise(row), rest)))

        scaled = lambda row: F.transform(row, lambda x: x / F.get(row, k))
        return let(pivot, lambda b: F.when(b["size"] > 0, let(let(F.get(m, -b["i"]), scaled), lambda lead: reduced(lead, -b["i"]))))

    return F.aggregate(at, start, step, lambda m: F.transform(m, lambda row: F.slice(row, n + 1, n)))


def inverse_table(texts: DataFrame) -> DataFrame:
    """(text, names, inverse, reason) of distinct matrix keywords (text): the inverse by rows, or why there is none."""
    parts = F.transform(F.split("text", ","), lambda p: F.trim(p))
    df = texts.select("text").distinct().withColumn("_parts", parts).withColumn("_n", F.get("_parts", F.lit(0)).try_cast("int"))
    long_enough = (F.col("_n") >= 1) & (F.col("_n") <= 4096) & (F.size("_parts") >= 1 + F.col("_n") + F.col("_n") * F.col("_n"))
    df = df.withColumn("_n", F.when(long_enough, F.col("_n"))).withColumn("names", F.slice("_parts", F.lit(2), F.col("_n")))
    df = df.withColumn("_values", F.transform(F.slice("_parts", F.col("_n") + 2, F.col("_n") * F.col("_n")), lambda v: finite(v.try_cast("double"))))
    whole = F.col("_n").isNotNull() & ~F.exists("_values", lambda v: v.isNull())
    df = df.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumn("inverse", F.when(F.col("_whole"), inverse_matrix(F.col("_values"), F.col("_n"))))
    largest = F.array_max(F.transform(F.flatten("inverse"), lambda v: F.abs(v)))
    reason = F.when(~F.col("_whole"), "the matrix can't be read").when(F.col("inverse").isNull(), "the matrix is singular").when(~(largest <= LARGEST_INVERSE), "the matrix is ill-conditioned")
    return df.select("text", "names", F.when(reason.isNull(), F.col("inverse")).alias("inverse"), reason.alias("reason"))


def tube_matrices(tubes: DataFrame, override: Spillover | None = None, on: bool = True) -> DataFrame:
    """(sample_id, place, slot, columns, reason): how each tube is compensated, or why it can't be.

    ``tubes`` has (sample_id, channels, keywords). A tube takes the ``override``, else its own keyword, else none (nor any if not ``on``); each distinct matrix
    is inverted once. ``place``: channel number of each matrix row; ``slot``: matrix row of each channel, null of those that stay as they are; ``columns``: columns
    of the inverse. All three are null for a tube without a matrix. Channels are found by name in any case, the first of equals.
    """
    text = F.lit(None).cast("string") if not on else F.lit(override.format()) if override is not None else spillover_keyword(F.col("keywords"))
    own = tubes.select("sample_id", F.transform("channels", lambda c: F.upper(c)).alias("_channels"), text.alias("text"))
    out = own.join(inverse_table(own.where("text IS NOT NULL")), "text", "left")
    place = F.transform("names", lambda c: (F.array_position("_channels", F.upper(c)) - 1).cast("int"))
    out = out.withColumn("_place", F.when(F.col("reason").isNull(), place))
    lost = F.get(F.filter("names", lambda c: ~F.array_contains("_channels", F.upper(c))), F.lit(0))
    reason = F.coalesce("reason", F.when(lost.isNotNull(), F.concat(F.lit("no channel "), lost)))
    out = out.withColumn("reason", F.when(reason.isNotNull(), F.concat(F.lit("compensation failed: "), reason)))
    fine = F.col("reason").isNull() & F.col("inverse").isNotNull()
    slot = F.transform("_channels", lambda _, q: F.array_max(F.filter(F.transform("_place", lambda p, j: F.when(p == q, j)), lambda j: j.isNotNull())))
    columns = F.transform(F.sequence(F.lit(0), F.size("inverse") - 1), lambda j: F.transform("inverse", lambda row: F.get(row, j)))
    return out.select("sample_id", *[F.when(fine, c).alias(n) for c, n in ((F.col("_place"), "place"), (slot, "slot"), (columns, "columns"))], "reason")


def compensate_tubes(events: DataFrame, panel: Panel, matrices: DataFrame) -> DataFrame:
    """``events`` of tubes of one panel, each unmixed by its own matrix of ``tube_matrices``; tubes with a reason, or not in the table, have no rows.

    A join on the tube: Spark sends the small table round while it is under the session's threshold, and else splits large tubes. It is written first: of a
    table whose size isn't known Spark would sort the events by tube instead.
    """
    kept = written(matrices.where("reason IS NULL").select("sample_id", "place", "slot", "columns"), "matrices")
    raw = F.array(*[F.col(c).cast("double") for c in panel.columns])
    product = lambda v: F.transform("columns", lambda column: F.aggregate(F.zip_with(v, column, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))
    mixed = let(F.transform("place", lambda i: F.get(raw, i)), product)
    out = events.join(kept, "sample_id").withColumn("_mixed", mixed)
    at = {c: F.get("slot", F.lit(i)) for i, c in enumerate(panel.columns)}
    return out.select(*[F.when(at[c].isNull(), F.col(c)).otherwise(F.get("_mixed", at[c])).alias(c) if c in at else F.col(c) for c in events.columns])
