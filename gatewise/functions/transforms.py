"""Axis transforms as Columns."""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Panel, Transform
from .binding import let

#: Terms of the series near zero, steps of the root finder in Columns.
TERMS, STEPS = 16, 6


class Logicle:
    """Constants of a biexponential scale (Moore and Parks 2012), and both directions in numpy."""

    def __init__(self, t: float, w: float, m: float, a: float):
        if not (t > 0 and w >= 0 and m > 0 and 2 * w <= m and -a <= w and a + w <= m - w):
            raise ValueError("logicle parameters out of range")
        self.m = m
        self.w, self.x2 = w / (m + a), a / (m + a)
        self.x1, self.x0 = self.x2 + self.w, self.x2 + 2 * self.w
        self.b = (m + a) * math.log(10)
        self.d = self._solve()
        ca = math.exp(self.x0 * (self.b + self.d))
        mfa = math.exp(self.b * self.x1) - ca / math.exp(self.d * self.x1)
        self.a = t / ((math.exp(self.b) - mfa) - ca / math.exp(self.d))
        self.c, self.f = ca * self.a, -mfa * self.a
        self.series_to = self.x1 + self.w / 4
        up, down, self.taylor = self.a * math.exp(self.b * self.x1), -self.c / math.exp(self.d * self.x1), []
        for i in range(1, TERMS + 1):
            up, down = up * self.b / i, -down * self.d / i
            self.taylor.append(up + down)
        self.taylor[1] = 0.0

    def _solve(self) -> float:
        if self.w == 0:
            return self.b
        lo, hi = 0.0, self.b
        for _ in range(200):  # bisection down to neighbouring doubles
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            if 2 * (math.log(mid) - math.log(self.b)) + self.w * (self.b + mid) > 0:
                hi = mid
            else:
                lo = mid
        return (lo + hi) / 2

    def inverse(self, s: np.ndarray) -> np.ndarray:
        s = np.asarray(s, float)
        up = np.where(s < self.x1, 2 * self.x1 - s, s)
        with np.errstate(over="ignore"):  # far beyond the scale the value is infinite
            far = self.a * np.exp(self.b * up) + self.f - self.c * np.exp(-self.d * up)
        z, near = up - self.x1, np.zeros_like(up)
        for k in reversed(self.taylor):
            near = (near + k) * z
        return np.where(s < self.x1, -1, 1) * np.where(up < self.series_to, near, far)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Display position in decades, by Halley's iteration from above or below zero."""
        x = np.asarray(x, float)
        v = np.abs(x)
        with np.errstate(all="ignore"):
            s = np.where(v < self.a, self.x1 + v / self.taylor[0], np.log(v / self.a) / self.b)
            for _ in range(20):
                up, down = self.a * np.exp(self.b * s), self.c * np.exp(-self.d * s)
                z, near = s - self.x1, np.zeros_like(s)
                for k in reversed(self.taylor):
                    near = (near + k) * z
                y = np.where(s < self.series_to, near, up + self.f - down) - v
                d1, d2 = self.b * up + self.d * down, self.b * self.b * up - self.d * self.d * down
                step = y / (d1 * (1 - y * d2 / (2 * d1 * d1)))
                s = s - np.where(np.isfinite(step), step, 0)
                if np.all(~(np.abs(step) > 3 * np.finfo(float).eps * np.maximum(np.abs(s), 1))):
                    break
        s = np.where(v == 0, self.x1, np.where(x < 0, 2 * self.x1 - s, s))
        return np.where(np.isfinite(x), s, x) * self.m


@lru_cache(maxsize=64)
def logicle(t: float, w: float, m: float, a: float) -> Logicle:
    return Logicle(t, w, m, a)


def _valid(tf: Transform) -> bool:
    try:
        logicle(tf.t, tf.w, tf.m, tf.a)
    except (ValueError, OverflowError, ZeroDivisionError):
        return False
    return True


def asinh(x: Column) -> Column:
    """Exact for negative values too, where the built-in loses digits."""
    return F.signum(x) * F.asinh(F.abs(x))


def _logicle_column(x: Column, tf: Transform) -> Column:
    """Halley's iteration from a line near zero, else from the exponential: its error is cubed by each step, so ``STEPS`` reach the last digits."""
    k = logicle(tf.t, tf.w, tf.m, tf.a)
    v = F.abs(x)

    def step(s: Column) -> Column:
        def moved(up: Column, down: Column) -> Column:
            near, z = F.lit(0.0), s - k.x1
            for c in reversed(k.taylor):
                near = (near + c) * z
            y = F.when(s < k.series_to, near).otherwise(up + k.f - down) - v
            d1, d2 = k.b * up + k.d * down, k.b * k.b * up - k.d * k.d * down
            return let(F.try_divide(y, d1 * (1 - y * d2 / (2 * d1 * d1))), lambda d: F.when(F.abs(d) < float("inf"), s - d).otherwise(s))

        return let(k.a * F.exp(k.b * s), lambda up: let(k.c * F.exp(-k.d * s), lambda down: moved(up, down)))

    start = F.when(v < k.a, k.x1 + v / k.taylor[0]).otherwise(F.ln(v / k.a) / k.b)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(s))
    s = F.when(v == 0, k.x1).when(x < 0, 2 * k.x1 - found).otherwise(found)
    return F.when(v < float("inf"), s).otherwise(x) * k.m


def forward(x: Column, tf: Transform) -> Column:
    """Display position of a data value. A null stays null; an invalid logicle is linear; NaN counts as the floor of a log axis."""
    if tf.kind == "log":
        floor = F.lit(float(max(tf.floor, sys.float_info.min)))
        return F.when(x.isNotNull(), F.log10(F.when(F.isnan(x), floor).otherwise(F.greatest(x, floor))))
    if tf.kind == "asinh":
        return asinh(x / F.lit(float(tf.cofactor)))
    if tf.kind == "logicle" and _valid(tf):
        return _logicle_column(x, tf)
    return x


def inverse(y: Column, tf: Transform) -> Column:
    """Data value of a display position."""
    if tf.kind == "log":
        return F.pow(F.lit(10.0), y)
    if tf.kind == "asinh":
        return F.sinh(y) * F.lit(float(tf.cofactor))
    if tf.kind == "logicle" and _valid(tf):
        k = logicle(tf.t, tf.w, tf.m, tf.a)
        s = y / F.lit(k.m)
        up = F.when(s < k.x1, F.lit(2 * k.x1) - s).otherwise(s)
        near, z = F.lit(0.0), up - F.lit(k.x1)
        for c in reversed(k.taylor):
            near = (near + F.lit(c)) * z
        far = F.lit(k.a) * F.exp(F.lit(k.b) * up) + F.lit(k.f) - F.lit(k.c) * F.exp(F.lit(-k.d) * up)
        return F.when(s < k.x1, -1.0).otherwise(1.0) * F.when(up < k.series_to, near).otherwise(far)
    return y


def inverse_value(y: float, tf: Transform) -> float:
    """The same for one number, on the driver."""
    try:
        if tf.kind == "log":
            return 10.0**y
        if tf.kind == "asinh":
            return math.sinh(y) * tf.cofactor
    except OverflowError:
        return math.copysign(math.inf, y if tf.kind == "asinh" else 1.0)
    if tf.kind == "logicle" and _valid(tf):
        k = logicle(tf.t, tf.w, tf.m, tf.a)
        return float(k.inverse(np.array([y / k.m]))[0])
    return y


def forward_value(x: float, tf: Transform) -> float:
    """Display position of one number, on the driver."""
    if tf.kind == "log":
        floor = max(tf.floor, sys.float_info.min)
        return math.log10(floor if math.isnan(x) else max(x, floor))
    if tf.kind == "asinh":
        return math.asinh(x / tf.cofactor)
    if tf.kind == "logicle" and _valid(tf):
        return float(logicle(tf.t, tf.w, tf.m, tf.a).forward(np.array([x]))[0])
    return x


def asinh_panel(events: DataFrame, panel: Panel, cofactor: float = 150.0) -> DataFrame:
    """``events`` with every fluorescence channel on an asinh axis; other columns stay."""
    shown = {c for _, c in panel.fluorescence()}
    return events.select(*[asinh(F.col(c) / F.lit(float(cofactor))).alias(c) if c in shown else F.col(c) for c in events.columns])
