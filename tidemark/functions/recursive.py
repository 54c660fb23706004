"""Filters that carry their whole past in a few numbers, and the job that runs them over histories of any length.

`sequential` deals rows by key, sorts them and hands them through batch by batch with one
state a key: memory holds a batch and a state, and the result is that of one pass over
everything. A filter is an object whose `step` takes one value or bar and gives what is
known after it, NaN before it has seen enough.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from math import isnan, log2, nan

import pandas as pd
from pyspark.sql import DataFrame


def sequential(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Callable[..., tuple]], outputs: str) -> DataFrame:
    """All columns of rows and the outputs (a schema): start() makes a key's filter, which is called with the inputs of each row in order."""
    key_at, input_at = ([rows.columns.index(c) for c in some] for some in (keys, inputs))
    columns = [*rows.columns, *(x.split()[0] for x in outputs.split(", "))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), outputs])

    def run(batches):
        now, step = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                key = [r[i] for i in key_at]
                if step is None or key != now:
                    now, step = key, start()
                out.append(r + step(*(r[i] for i in input_at)))
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Smooth:
    """Exponential mean with weight a of the newest value, seeded by the mean of n values; `skip` values come before them."""

    def __init__(self, n: int, a: float, skip: int = 0):
        self.n, self.a, self.left, self.total, self.now, self.skip = n, a, n, 0.0, nan, skip

    def step(self, x: float) -> float:
        if isnan(x):
            return self.now
        if self.skip:
            self.skip -= 1
        elif self.left:
            self.total += x
            self.left -= 1
            if not self.left:
                self.now = self.total / self.n
        else:
            self.now += self.a * (x - self.now)
        return self.now


def ema(n: int, skip: int = 0) -> Smooth:
    return Smooth(n, 2.0 / (n + 1), skip)


def wilder(n: int) -> Smooth:
    return Smooth(n, 1.0 / n)


class Weighted:
    """Exponential mean in which all values so far have weights that sum to one; unknown while there are fewer than `least`."""

    def __init__(self, span: int, least: int = 1):
        self.keep, self.least, self.top, self.bottom, self.n = 1 - 2.0 / (span + 1), least, 0.0, 0.0, 0

    def step(self, x: float) -> float:
        if isnan(x):
            self.top, self.bottom = self.top * self.keep, self.bottom * self.keep
        else:
            self.top, self.bottom, self.n = x + self.keep * self.top, 1 + self.keep * self.bottom, self.n + 1
        return self.top / self.bottom if self.n >= self.least else nan


class Lagged:
    """The value n steps ago."""

    def __init__(self, n: int):
        self.values: deque[float] = deque(maxlen=n + 1)

    def step(self, x: float) -> float:
        self.values.append(x)
        return self.values[0] if len(self.values) == self.values.maxlen else nan


class Directional:
    """+DI, -DI, ADX and ADXR."""

    def __init__(self, n: int):
        self.plus, self.minus, self.range, self.adx, self.back, self.before = wilder(n), wilder(n), wilder(n), wilder(n), Lagged(n - 1), None

    def step(self, high: float, low: float, close: float) -> tuple[float, float, float, float]:
        if self.before is None:
            self.before = high, low, close
            return nan, nan, nan, nan
        h, l, c = self.before
        self.before = high, low, close
        up, down = high - h, l - low
        tr = self.range.step(max(high - low, abs(high - c), abs(low - c)))
        p, m = self.plus.step(up if up > down and up > 0 else 0.0), self.minus.step(down if down > up and down > 0 else 0.0)
        if isnan(tr) or tr == 0:
            return nan, nan, nan, nan
        p, m = 100 * p / tr, 100 * m / tr
        adx = self.adx.step(100 * abs(p - m) / (p + m) if p + m > 0 else 0.0)
        return p, m, adx, (adx + self.back.step(adx)) / 2


class Kama:
    def __init__(self, n: int = 10, fast: int = 2, slow: int = 30):
        self.n, self.fast, self.slow, self.values, self.now = n, 2 / (fast + 1), 2 / (slow + 1), deque(maxlen=n + 1), nan

    def step(self, close: float) -> float:
        before = self.values[-1] if self.values else nan
        self.values.append(close)
        if len(self.values) <= self.n:
            return nan
        if isnan(self.now):
            self.now = before
        v = list(self.values)
        path = sum(abs(b - a) for a, b in zip(v, v[1:]))
        ratio = abs(close - v[0]) / path if path else 0.0
        self.now += (ratio * (self.fast - self.slow) + self.slow) ** 2 * (close - self.now)
        return self.now


class Parabolic:
    """Stop-and-reverse level, and whether the position is long."""

    def __init__(self, pace: float = 0.02, most: float = 0.2):
        self.start, self.most, self.before, self.level = pace, most, None, nan

    def step(self, high: float, low: float) -> tuple[float, bool]:
        if self.before is None:
            self.before, self.long = (high, low), True
            return nan, True
        h, l = self.before
        if isnan(self.level):
            self.long = high - h >= l - low
            self.level, self.extreme, self.pace = (l, high, self.start) if self.long else (h, low, self.start)
        if self.long and low <= self.level or not self.long and high >= self.level:
            self.long, self.level, self.pace = not self.long, self.extreme, self.start
            self.extreme = high if self.long else low
        out = self.level
        if self.long and high > self.extreme or not self.long and low < self.extreme:
            self.extreme, self.pace = (high if self.long else low), min(self.pace + self.start, self.most)
        self.level += self.pace * (self.extreme - self.level)
        self.level = min(self.level, low, l) if self.long else max(self.level, high, h)
        self.before = high, low
        return out, self.long


class ZigZag:
    """The latest pivot, the latest high pivot and the latest low one: a pivot follows the trend until price turns by `share`."""

    def __init__(self, share: float = 0.05):
        self.share, self.pivot, self.trend, self.high, self.low = share, None, 0, nan, nan

    def step(self, high: float, low: float) -> tuple[float, float, float]:
        if self.pivot is None:
            self.pivot = self.high = self.low = high
        elif not self.trend:
            if high >= self.pivot * (1 + self.share):
                self._to(1, high)
            elif low <= self.pivot * (1 - self.share):
                self._to(-1, low)
        elif self.trend > 0:
            if low <= self.pivot * (1 - self.share):
                self._to(-1, low)
            elif high >= self.pivot:
                self._to(1, high)
        elif high >= self.pivot * (1 + self.share):
            self._to(1, high)
        elif low <= self.pivot:
            self._to(-1, low)
        return self.pivot, self.high, self.low

    def _to(self, trend: int, price: float) -> None:
        self.trend, self.pivot = trend, price
        if trend > 0:
            self.high = price
        else:
            self.low = price


class Runs:
    """Runs of equal sides among the last n steps: a run leaves as a whole once its first step is n steps back; the current one stays.

    Gives the longest, the mean and the number of buy and of sell runs, as shares of n, the
    difference of the numbers over their sum, and the entropy of the two shares in bits.
    """

    def __init__(self, n: int = 100):
        self.n, self.at, self.runs = n, 0, deque()  # of [side, first step, length]

    def step(self, side: int) -> tuple[float, ...]:
        if self.runs and self.runs[-1][0] == side:
            self.runs[-1][2] += 1
        else:
            self.runs.append([side, self.at, 1])
        self.at += 1
        while len(self.runs) > 1 and self.at - self.runs[0][1] > self.n:
            self.runs.popleft()
        buy, sell = ([min(k, self.n) for s, _, k in self.runs if (s > 0) == up] for up in (True, False))
        b, s = len(buy), len(sell)
        entropy = -sum(k / (b + s) * log2(k / (b + s)) for k in (b, s) if k)
        parts = (max(buy, default=0), max(sell, default=0), sum(buy) / b if b else 0, sum(sell) / s if s else 0, b, s)
        return (*(x / self.n for x in parts), (b - s) / (b + s), entropy)


RUNS = ("max_buy_run", "max_sell_run", "avg_buy_run", "avg_sell_run", "buy_run_count", "sell_run_count", "imbalance_ratio", "directional_entropy")

#: What `indicators` gives, in order.
COLUMNS = (
    "ema_10", "ema_20", "ema_50", "ema_100", "ema_200", "ema_1200", "ewm_10", "ewm_20", "ewm_50", "volume_ewm_20", "tema", "trix", "kama", "rsi", "rsi_7", "rsi_21", "cmo",
    "atr", "atr_7", "atr_21", "natr", "macd", "macd_signal", "macdfix", "macdfix_signal", "ppo", "plus_di", "minus_di", "adx", "adxr", "adx_50", "plus_di_200", "minus_di_200",
    "sar", "sar_ext", "adosc", "zigzag", "zz_high", "zz_low",
)


def indicators() -> Callable[..., tuple]:
    """A filter over (close, high, low, volume) of one symbol's bars: a tuple of COLUMNS."""
    emas = [ema(n) for n in (10, 20, 50, 100, 200, 1200)]
    ewms = [Weighted(n) for n in (10, 20, 50)]
    heavy = Weighted(20, 10)
    e1, e2, e3 = ema(10), ema(10), ema(10)
    t1, t2, t3 = ema(15), ema(15), ema(15)
    kama, sar, zig = Kama(), Parabolic(), ZigZag()
    gains = {n: (wilder(n), wilder(n)) for n in (7, 14, 21)}
    ranges = {n: wilder(n) for n in (7, 14, 21)}
    fast, slow, signal = ema(12, skip=14), ema(26), ema(9)
    fixed_fast, fixed_slow, fixed_signal = Smooth(12, 0.15, skip=14), Smooth(26, 0.075), ema(9)
    dmi, dmi_50, dmi_200 = Directional(14), Directional(50), Directional(200)
    ad_fast, ad_slow = ema(3), ema(10)
    before, flow, last_t3 = nan, 0.0, nan

    def step(close: float, high: float, low: float, volume: float) -> tuple:
        nonlocal before, flow, last_t3
        levels = [e.step(close) for e in emas]
        a = e1.step(close)
        b = e2.step(a)
        tema = 3 * a - 3 * b + e3.step(b)
        x = t3.step(t2.step(t1.step(close)))
        trix, last_t3 = 100 * (x / last_t3 - 1), x
        move = close - before
        tr = nan if isnan(before) else max(high - low, abs(high - before), abs(low - before))
        strength, cmo = {}, nan
        for n, (up, down) in gains.items():
            u, d = up.step(nan if isnan(move) else max(move, 0.0)), down.step(nan if isnan(move) else max(-move, 0.0))
            strength[n] = nan if isnan(u) else 100 * u / (u + d) if u + d > 0 else 50.0
            if n == 14:
                cmo = nan if isnan(u) else 100 * (u - d) / (u + d) if u + d > 0 else 0.0
        atr = {n: r.step(tr) for n, r in ranges.items()}
        macd = fast.step(close) - slow.step(close)
        fixed = fixed_fast.step(close) - fixed_slow.step(close)
        plus, minus, adx, adxr = dmi.step(high, low, close)
        adx_50 = dmi_50.step(high, low, close)[2]
        plus_200, minus_200, _, _ = dmi_200.step(high, low, close)
        level, long = sar.step(high, low)
        flow += (2 * close - high - low) / (high - low) * volume if high > low else 0.0
        before = close
        return (
            *levels, *(e.step(close) for e in ewms), heavy.step(volume), tema, trix, kama.step(close), strength[14], strength[7], strength[21], cmo,
            atr[14], atr[7], atr[21], 100 * atr[14] / close if close else nan, macd, signal.step(macd), fixed, fixed_signal.step(fixed), 100 * macd / slow.now if slow.now else nan, plus, minus, adx, adxr, adx_50, plus_200, minus_200,
            level, level if long else -level, ad_fast.step(flow) - ad_slow.step(flow), *zig.step(high, low),
        )

    return step


def with_indicators(bars: DataFrame) -> DataFrame:
    """The bars with COLUMNS; NaN is null."""
    return sequential(bars, ["symbol"], ["ts"], ["close", "high", "low", "volume"], indicators, ", ".join(f"{c} double" for c in COLUMNS))
