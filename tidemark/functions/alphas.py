"""Formulaic alphas over a panel of daily rows.

A formula is built in levels: every window or rank over earlier results is a column of
its own, since a window cannot stand inside a window. Symbol windows come first,
cross-sections over the names of a day after them; columns that are ready are computed
together, so the rows move once for each change between the two. The same levels can be
written as SQL text, which is how they are checked.

`ties`: values that agree in that many digits rank alike; without it, only equal ones do.
Sums of floating point numbers differ in the last digits between engines, so comparisons of
two engines set it.
"""

from __future__ import annotations

import re
from collections.abc import Callable


class Levels:
    """Collects columns; methods take and give SQL expressions over the columns so far."""

    def __init__(self, dialect: str = "spark", key: str = "symbol", time: str = "date", ties: bool = False):
        self.dialect, self.key, self.time, self.ties = dialect, key, time, ties
        self.steps: list[tuple[str, str]] = []
        self._known: dict[str, str] = {}
        self.o, self.h, self.l, self.c, self.v, self.vwap = "open", "high", "low", "close", "volume", "vwap"
        self.r = self.add(f"close / {self.lag_of('close', 1)} - 1")

    def near(self, x: str, digits: int) -> str:
        return f"round({x}, {digits})" if self.ties else x

    def add(self, expression: str) -> str:
        if expression not in self._known:
            self._known[expression] = f"x{len(self.steps)}"
            self.steps.append((self._known[expression], expression))
        return self._known[expression]

    @property
    def order(self) -> str:
        return f"PARTITION BY {self.key} ORDER BY {self.time}"

    def frame(self, n: int) -> str:
        return f"({self.order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def lag_of(self, x: str, n: int) -> str:
        return f"lag({x}, {n}) OVER ({self.order})"

    def lag(self, x: str, n: int) -> str:
        return self.add(self.lag_of(self.level(x), n))

    def level(self, x: str) -> str:
        return x if x.isidentifier() else self.add(x)

    def delta(self, x: str, n: int) -> str:
        x = self.level(x)
        return self.add(f"{x} - {self.lag_of(x, n)}")

    def ts(self, function: str, x: str, n: int) -> str:
        x = self.level(x)
        return self.add(f"CASE WHEN count({x}) OVER {self.frame(n)} >= {n} THEN {function}({x}) OVER {self.frame(n)} END")

    def sum(self, x: str, n: int) -> str:
        return self.ts("sum", x, n)

    def mean(self, x: str, n: int) -> str:
        return self.ts("avg", x, n)

    def std(self, x: str, n: int) -> str:
        return self.ts("stddev_samp", x, n)

    def low(self, x: str, n: int) -> str:
        return self.ts("min", x, n)

    def high(self, x: str, n: int) -> str:
        return self.ts("max", x, n)

    def adv(self, n: int) -> str:
        return self.mean("volume", n)

    def pair(self, function: str, a: str, b: str, n: int) -> str:
        """corr or covar_samp of two columns; null while a frame is short or one of them is constant."""
        a, b, w = self.level(a), self.level(b), self.frame(n)
        a, b = (self.add(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {x} END") for x in (a, b))
        value = f"covar_pop({a}, {b}) OVER {w} / nullif(stddev_pop({a}) OVER {w} * stddev_pop({b}) OVER {w}, 0)" if function == "corr" else f"{function}({a}, {b}) OVER {w}"
        return self.add(f"CASE WHEN count({a}) OVER {w} >= {n} AND max({a}) OVER {w} > min({a}) OVER {w} AND max({b}) OVER {w} > min({b}) OVER {w} THEN {self.near(value, 9)} END")

    def corr(self, a: str, b: str, n: int) -> str:
        return self.pair("corr", a, b, n)

    def cov(self, a: str, b: str, n: int) -> str:
        return self.pair("covar_samp", a, b, n)

    def rank(self, x: str) -> str:
        """Percentile rank among a day's names that have a value, ties averaged."""
        x = self.level(x)
        day = f"PARTITION BY {self.time}"
        return self.add(f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({day}, CASE WHEN {x} IS NULL THEN 1 ELSE 0 END ORDER BY {x}) + (count({x}) OVER ({day}, {x}) - 1) / 2e0) / count({x}) OVER ({day}) END")

    def scale(self, x: str) -> str:
        x = self.level(x)
        return self.add(f"{x} / nullif(sum(abs({x})) OVER (PARTITION BY {self.time}), 0)")

    def _list(self, x: str, n: int) -> str:
        if self.dialect == "spark":
            return f"collect_list({x}) OVER {self.frame(n)}"
        return f"list({x}) FILTER ({x} IS NOT NULL) OVER {self.frame(n)}"

    def ts_rank(self, x: str, n: int) -> str:
        """Rank of the last value in its frame, as a share of n, ties averaged."""
        x = self.level(x)
        values = self.add(self._list(x, n))
        if self.dialect == "spark":
            return self.add(f"CASE WHEN size({values}) = {n} AND {x} IS NOT NULL THEN (size(filter({values}, q -> q < {x})) + (size(filter({values}, q -> q = {x})) + 1) / 2e0) / {n} END")
        return self.add(f"CASE WHEN len({values}) = {n} AND {x} IS NOT NULL THEN (len(list_filter({values}, lambda q: q < {x})) + (len(list_filter({values}, lambda q: q = {x})) + 1) / 2e0) / {n} END")

    def argmax(self, x: str, n: int) -> str:
        x = self.level(x)
        values = self.add(self._list(x, n))
        if self.dialect == "spark":
            return self.add(f"CASE WHEN size({values}) = {n} THEN CAST(array_position({values}, array_max({values})) AS DOUBLE) END")
        return self.add(f"CASE WHEN len({values}) = {n} THEN CAST(list_position({values}, list_max({values})) AS DOUBLE) END")

    def argmin(self, x: str, n: int) -> str:
        return self.argmax(f"-{self.level(x)}", n)

    def product(self, x: str, n: int) -> str:
        """Of positive values: the sum of their logarithms."""
        return self.sum(f"ln({self.level(x)})", n)

    def weighted(self, x: str, n: int) -> str:
        """Mean with weights 1 to n, the newest heaviest."""
        x = self.level(x)
        values = self.add(self._list(x, n))
        total = f"{n * (n + 1) / 2:e}"
        if self.dialect == "spark":
            return self.add(f"CASE WHEN size({values}) = {n} THEN aggregate(transform({values}, (q, i) -> q * (i + 1)), 0D, (a, q) -> a + q) / {total} END")
        return self.add(f"CASE WHEN len({values}) = {n} THEN list_sum(list_transform({values}, lambda q, i: q * i)) / {total} END")


def _signed(p: Levels, limit: str) -> str:
    back, now = p.lag(p.delta(p.c, 10), 10), p.delta(p.c, 10)
    return f"CASE WHEN {back} / 10 - {now} / 10 < {limit} THEN 1 ELSE -{p.delta(p.c, 1)} END"


def _turning(p: Levels, n: int) -> str:
    d = p.delta(p.c, 1)
    return f"CASE WHEN {p.low(d, n)} > 0 THEN {d} WHEN {p.high(d, n)} < 0 THEN {d} ELSE -{d} END"


def _less(a: str, b: str, then: int) -> str:
    """`then` where a is below b, else 0, also where one of them is null."""
    return f"CASE WHEN {a} < {b} THEN {then} ELSE 0 END"


def _larger(p: Levels, a: str, b: str) -> str:
    a, b = p.level(a), p.level(b)
    return f"CASE WHEN {a} > {b} THEN {a} ELSE {b} END"


def _smaller(p: Levels, a: str, b: str) -> str:
    a, b = p.level(a), p.level(b)
    return f"CASE WHEN {a} < {b} THEN {a} ELSE {b} END"


FORMULAS: dict[str, Callable[[Levels], str]] = {
    "alpha001": lambda p: f"{p.rank(p.argmax(f'power(CASE WHEN {p.r} < 0 THEN {p.std(p.r, 20)} ELSE {p.c} END, 2)', 5))} - 5e-1",
    "alpha002": lambda p: f"-{p.corr(p.rank(p.near(p.delta('ln(volume)', 2), 9)), p.rank('(close - open) / open'), 6)}",
    "alpha003": lambda p: f"-{p.corr(p.rank(p.o), p.rank(p.v), 10)}",
    "alpha004": lambda p: f"-{p.ts_rank(p.rank(p.l), 9)}",
    "alpha005": lambda p: f"{p.rank(f'open - {p.mean(p.vwap, 10)}')} * -abs({p.rank('close - vwap')})",
    "alpha006": lambda p: f"-{p.corr(p.o, p.v, 10)}",
    "alpha007": lambda p: f"CASE WHEN {p.adv(20)} < volume THEN -{p.ts_rank(f'abs({p.delta(p.c, 7)})', 60)} * sign({p.delta(p.c, 7)}) ELSE -1 END",
    "alpha008": lambda p: (lambda x: f"-{p.rank(f'{x} - {p.lag(x, 10)}')}")(p.level(f"{p.sum(p.o, 5)} * {p.sum(p.r, 5)}")),
    "alpha009": lambda p: _turning(p, 5),
    "alpha010": lambda p: p.rank(_turning(p, 4)),
    "alpha011": lambda p: f"({p.rank(p.high('vwap - close', 3))} + {p.rank(p.low('vwap - close', 3))}) * {p.rank(p.delta(p.v, 3))}",
    "alpha012": lambda p: f"sign({p.delta(p.v, 1)}) * -{p.delta(p.c, 1)}",
    "alpha013": lambda p: f"-{p.rank(p.cov(p.rank(p.c), p.rank(p.v), 5))}",
    "alpha014": lambda p: f"-{p.rank(p.delta(p.r, 3))} * {p.corr(p.o, p.v, 10)}",
    "alpha015": lambda p: f"-{p.sum(p.rank(p.corr(p.rank(p.h), p.rank(p.v), 3)), 3)}",
    "alpha016": lambda p: f"-{p.rank(p.cov(p.rank(p.h), p.rank(p.v), 5))}",
    "alpha017": lambda p: f"-{p.rank(p.ts_rank(p.c, 10))} * {p.rank(p.delta(p.delta(p.c, 1), 1))} * {p.rank(p.ts_rank(f'volume / {p.adv(20)}', 5))}",
    "alpha018": lambda p: f"-{p.rank(p.near(f"{p.std('abs(close - open)', 5)} + (close - open) + {p.corr(p.c, p.o, 10)}", 6))}",
    "alpha019": lambda p: f"-sign(close - {p.lag(p.c, 7)} + {p.delta(p.c, 7)}) * (1 + {p.rank(p.near(f"1 + {p.sum(p.r, 250)}", 9))})",
    "alpha020": lambda p: f"-{p.rank(f'open - {p.lag(p.h, 1)}')} * {p.rank(f'open - {p.lag(p.c, 1)}')} * {p.rank(f'open - {p.lag(p.l, 1)}')}",
    "alpha022": lambda p: f"-{p.delta(p.corr(p.h, p.v, 5), 5)} * {p.rank(p.near(p.std(p.c, 20), 6))}",
    "alpha023": lambda p: f"CASE WHEN {p.mean(p.h, 20)} < high THEN -{p.delta(p.h, 2)} ELSE 0 END",
    "alpha024": lambda p: f"CASE WHEN {p.delta(p.mean(p.c, 100), 100)} / {p.lag(p.c, 100)} <= 5e-2 THEN -(close - {p.low(p.c, 100)}) ELSE -{p.delta(p.c, 3)} END",
    "alpha025": lambda p: p.rank(p.near(f"-{p.r} * {p.adv(20)} * vwap * (high - close)", 3)),
    "alpha026": lambda p: f"-{p.high(p.corr(p.ts_rank(p.v, 5), p.ts_rank(p.h, 5), 5), 3)}",
    "alpha028": lambda p: p.scale(f"{p.corr(p.adv(20), p.l, 5)} + (high + low) / 2 - close"),
    "alpha032": lambda p: f"{p.scale(f'{p.mean(p.c, 7)} - close')} + 20 * {p.scale(p.corr(p.vwap, p.lag(p.c, 5), 230))}",
    "alpha033": lambda p: p.rank("-(1 - open / close)"),
    "alpha034": lambda p: p.rank(f"(1 - {p.rank(p.near(f"{p.std(p.r, 2)} / {p.std(p.r, 5)}", 6))}) + (1 - {p.rank(p.delta(p.c, 1))})"),
    "alpha035": lambda p: f"{p.ts_rank(p.v, 32)} * (1 - {p.ts_rank('close + high - low', 16)}) * (1 - {p.ts_rank(p.r, 32)})",
    "alpha037": lambda p: f"{p.rank(p.corr(p.lag('open - close', 1), p.c, 200))} + {p.rank('open - close')}",
    "alpha038": lambda p: f"-{p.rank(p.ts_rank(p.c, 10))} * {p.rank('close / open')}",
    "alpha040": lambda p: f"-{p.rank(p.near(p.std(p.h, 10), 6))} * {p.corr(p.h, p.v, 10)}",
    "alpha041": lambda p: "power(high * low, 5e-1) - vwap",
    "alpha042": lambda p: f"{p.rank('vwap - close')} / {p.rank('vwap + close')}",
    "alpha043": lambda p: f"{p.ts_rank(f'volume / {p.adv(20)}', 20)} * {p.ts_rank(f'-{p.delta(p.c, 7)}', 8)}",
    "alpha044": lambda p: f"-{p.corr(p.h, p.rank(p.v), 5)}",
    "alpha049": lambda p: _signed(p, "-1e-1 * close"),
    "alpha051": lambda p: _signed(p, "-5e-2 * close"),
    "alpha050": lambda p: f"-{p.high(p.rank(p.corr(p.rank(p.v), p.rank(p.vwap), 5)), 5)}",
    "alpha053": lambda p: f"-{p.delta('1 - (high - close) / nullif(close - low, 0)', 9)}",
    "alpha054": lambda p: "-(low - close) * power(open, 5) / nullif((low - high) * power(close, 5), 0)",
    "alpha055": lambda p: f"-{p.corr(p.rank(f'(close - {p.low(p.l, 12)}) / nullif({p.high(p.h, 12)} - {p.low(p.l, 12)}, 0)'), p.rank(p.v), 6)}",
    "alpha057": lambda p: f"-(close - vwap) / nullif({p.weighted(p.rank(p.argmax(p.c, 30)), 2)}, 0)",
    "alpha060": lambda p: f"-(2 * {p.scale(p.rank(p.near("(close - low - (high - close)) / nullif(high - low, 0) * volume", 6)))} - {p.scale(p.rank(p.argmax(p.c, 10)))})",
    "alpha083": lambda p: (lambda x: f"{p.rank(p.near(p.lag(x, 2), 9))} * {p.rank(p.rank(p.v))} / nullif({x} / nullif(vwap - close, 0), 0)")(p.level(f"(high - low) / {p.mean(p.c, 5)}")),
    "alpha084": lambda p: f"power({p.ts_rank(f'vwap - {p.high(p.vwap, 15)}', 21)}, {p.delta(p.c, 5)} / 10000)",
    "alpha101": lambda p: "(close - open) / (high - low + 1e-3)",
    "alpha021": lambda p: f"CASE WHEN {p.mean(p.c, 8)} + {p.std(p.c, 8)} < {p.mean(p.c, 2)} THEN -1 WHEN {p.mean(p.c, 8)} + {p.std(p.c, 8)} > {p.mean(p.c, 2)} THEN 1 WHEN volume / {p.adv(20)} < 1 THEN -1 ELSE 1 END",
    "alpha027": lambda p: (lambda k: f"CASE WHEN {k} IS NULL THEN 0 WHEN {k} <= 5e-1 THEN 1 ELSE -1 END")(p.rank(p.near(p.mean(p.corr(p.rank(p.v), p.rank(p.vwap), 6), 2), 9))),
    "alpha029": lambda p: f"{p.low(p.rank(p.rank(p.near(p.scale(f'ln({p.sum(p.rank(p.rank(f"-{p.rank(p.delta(p.level('close - 1'), 5))}")), 2)})'), 9))), 5)} + {p.ts_rank(p.lag(f'-{p.r}', 6), 5)}",
    "alpha030": lambda p: (lambda d: f"(1 - {p.rank(f'sign({d}) + sign({p.lag(d, 1)}) + sign({p.lag(d, 2)})')}) * {p.sum(p.v, 5)} / {p.sum(p.v, 20)}")(p.delta(p.c, 1)),
    "alpha031": lambda p: f"{p.rank(p.rank(p.rank(p.near(p.weighted(f'-{p.rank(p.rank(p.delta(p.c, 10)))}', 10), 9))))} + {p.rank(f'-{p.delta(p.c, 3)}')} + sign({p.scale(p.corr(p.adv(20), p.l, 12))})",
    "alpha036": lambda p: f"221e-2 * {p.rank(p.corr('close - open', p.lag(p.v, 1), 15))} + 7e-1 * {p.rank('open - close')} + 73e-2 * {p.rank(p.ts_rank(p.lag(f'-{p.r}', 6), 5))} + {p.rank(f'abs({p.corr(p.vwap, p.adv(20), 6)})')} + 6e-1 * {p.rank(p.near(f'({p.mean(p.c, 200)} - open) * (close - open)', 3))}",
    "alpha039": lambda p: f"-{p.rank(p.near(f'{p.delta(p.c, 7)} * (1 - {p.rank(p.near(p.weighted(f"volume / {p.adv(20)}", 9), 9))})', 6))} * {p.rank(p.near(f'{p.mean(p.r, 250)} + 1', 9))}",
    "alpha045": lambda p: f"-{p.rank(p.near(p.mean(p.lag(p.c, 5), 20), 6))} * {p.corr(p.c, p.v, 2)} * {p.rank(p.corr(p.sum(p.c, 5), p.sum(p.c, 20), 2))}",
    "alpha046": lambda p: (lambda x: f"CASE WHEN {x} > 25e-2 THEN {x} WHEN {x} < 0 THEN 1 ELSE {p.delta(p.c, 1)} END")(p.level(f"{p.lag(p.delta(p.c, 10), 10)} / 10 - {p.delta(p.c, 10)} / 10")),
    "alpha047": lambda p: f"{p.rank('1 / close')} * volume / {p.adv(20)} * (high * {p.rank('high - close')} / {p.mean(p.h, 5)} - {p.rank(p.delta(p.vwap, 5))})",
    "alpha052": lambda p: f"{p.delta(p.low(p.l, 5), 5)} * {p.rank(p.near(f'({p.sum(p.r, 240)} - {p.sum(p.r, 20)}) / 220', 9))} * {p.ts_rank(p.v, 5)}",
    "alpha061": lambda p: _less(p.rank(f"vwap - {p.low(p.vwap, 16)}"), p.rank(p.corr(p.vwap, p.mean(p.v, 180), 18)), 1),
    "alpha062": lambda p: _less(p.rank(p.corr(p.vwap, p.sum(p.adv(20), 22), 9)), p.rank(_less(f"2 * {p.rank(p.o)}", f"{p.rank('(high + low) / 2')} + {p.rank(p.h)}", 1)), -1),
    "alpha064": lambda p: (lambda w: _less(p.rank(p.corr(p.sum(f"open * {w} + low * (1 - {w})", 12), p.sum(p.mean(p.v, 120), 12), 16)), p.rank(p.near(p.delta(f"(high + low) / 2 * {w} + vwap * (1 - {w})", 3), 6)), -1))("178404e-6"),
    "alpha065": lambda p: (lambda w: _less(p.rank(p.corr(f"open * {w} + vwap * (1 - {w})", p.mean(p.mean(p.v, 60), 9), 6)), p.rank(f"open - {p.low(p.o, 13)}"), -1))("817205e-8"),
    "alpha066": lambda p: (lambda w: f"-({p.rank(p.near(p.weighted(p.delta(p.vwap, 4), 7), 6))} + {p.ts_rank(p.near(p.weighted(f'(low * {w} + low * (1 - {w}) - vwap) / (open - (high + low) / 2 + 1e-3)', 11), 9), 7)})")("96633e-5"),
    "alpha068": lambda p: (lambda w: _less(p.ts_rank(p.corr(p.rank(p.h), p.rank(p.mean(p.v, 15)), 9), 14), p.rank(p.near(p.delta(f"close * {w} + low * (1 - {w})", 1), 6)), -1))("518371e-6"),
    "alpha071": lambda p: _larger(p, p.ts_rank(p.near(p.weighted(p.corr(p.ts_rank(p.c, 3), p.ts_rank(p.mean(p.v, 180), 12), 18), 4), 9), 16), p.ts_rank(p.near(p.weighted(f"power({p.rank('low + open - 2 * vwap')}, 2)", 16), 9), 4)),
    "alpha072": lambda p: f"{p.rank(p.near(p.weighted(p.corr('(high + low) / 2', p.mean(p.v, 40), 9), 10), 9))} / {p.rank(p.near(p.weighted(p.corr(p.ts_rank(p.vwap, 3), p.ts_rank(p.v, 18), 6), 2), 9))}",
    "alpha073": lambda p: (lambda w: f"-({_larger(p, p.rank(p.near(p.weighted(p.delta(p.vwap, 5), 3), 6)), p.ts_rank(p.near(p.weighted(f'-{p.delta(w, 2)} / {w}', 3), 9), 16))})")(p.level("open * 147155e-6 + low * (1 - 147155e-6)")),
    "alpha074": lambda p: (lambda w: _less(p.rank(p.corr(p.c, p.mean(p.mean(p.v, 30), 37), 15)), p.rank(p.corr(p.rank(f"high * {w} + vwap * (1 - {w})"), p.rank(p.v), 11)), -1))("261661e-7"),
    "alpha075": lambda p: _less(p.rank(p.corr(p.vwap, p.v, 4)), p.rank(p.corr(p.rank(p.l), p.rank(p.mean(p.v, 50)), 12)), 1),
    "alpha077": lambda p: _smaller(p, p.rank(p.near(p.weighted("(high + low) / 2 - vwap", 20), 6)), p.rank(p.near(p.weighted(p.corr("(high + low) / 2", p.mean(p.v, 40), 3), 5), 9))),
    "alpha078": lambda p: (lambda w: f"power({p.rank(p.corr(p.sum(f'low * {w} + vwap * (1 - {w})', 19), p.sum(p.mean(p.v, 40), 19), 6))}, {p.rank(p.corr(p.rank(p.vwap), p.rank(p.v), 5))})")("352233e-6"),
    "alpha081": lambda p: _less(p.rank(p.near(p.product(p.rank(f"power({p.rank(p.corr(p.vwap, p.sum(p.mean(p.v, 10), 50), 8))}, 4)"), 15), 9)), p.rank(p.corr(p.rank(p.vwap), p.rank(p.v), 5)), -1),
    "alpha085": lambda p: (lambda w: f"power({p.rank(p.corr(f'high * {w} + close * (1 - {w})', p.mean(p.v, 30), 10))}, {p.rank(p.corr(p.ts_rank('(high + low) / 2', 4), p.ts_rank(p.v, 10), 7))})")("876703e-6"),
    "alpha086": lambda p: _less(p.ts_rank(p.corr(p.c, p.mean(p.mean(p.v, 20), 15), 6), 20), p.rank("close - vwap"), -1),
    "alpha088": lambda p: _smaller(p, p.rank(p.near(p.weighted(f"{p.rank(p.o)} + {p.rank(p.l)} - {p.rank(p.h)} + {p.rank(p.c)}", 8), 9)), p.ts_rank(p.near(p.weighted(p.corr(p.ts_rank(p.c, 8), p.ts_rank(p.mean(p.v, 60), 20), 8), 6), 9), 2)),
    "alpha092": lambda p: _smaller(p, p.ts_rank(p.near(p.weighted(_less("(high + low) / 2 + close", "low + open", 1), 15), 9), 18), p.ts_rank(p.near(p.weighted(p.corr(p.rank(p.l), p.rank(p.mean(p.v, 30)), 7), 6), 9), 6)),
    "alpha094": lambda p: f"-power({p.rank(f'vwap - {p.low(p.vwap, 11)}')}, {p.ts_rank(p.corr(p.ts_rank(p.vwap, 20), p.ts_rank(p.mean(p.v, 60), 4), 18), 2)})",
    "alpha095": lambda p: _less(p.rank(f"open - {p.low(p.o, 12)}"), p.ts_rank(p.rank(p.near(f"power({p.corr(p.mean('(high + low) / 2', 19), p.sum(p.mean(p.v, 40), 19), 13)}, 5)", 12)), 12), 1),
    "alpha096": lambda p: f"-({_larger(p, p.ts_rank(p.near(p.weighted(p.corr(p.rank(p.vwap), p.rank(p.v), 10), 4), 9), 8), p.ts_rank(p.near(p.weighted(p.argmax(p.corr(p.ts_rank(p.c, 7), p.ts_rank(p.mean(p.v, 60), 10), 10), 12), 14), 9), 13))})",
    "alpha098": lambda p: f"{p.rank(p.near(p.weighted(p.corr(p.vwap, p.mean(p.adv(5), 26), 4), 7), 9))} - {p.rank(p.near(p.weighted(p.ts_rank(p.argmin(p.corr(p.rank(p.o), p.rank(p.mean(p.v, 15)), 20), 8), 6), 10), 9))}",
    "alpha099": lambda p: _less(p.rank(p.corr(p.sum("(high + low) / 2", 19), p.sum(p.mean(p.v, 60), 19), 8)), p.rank(p.corr(p.l, p.v, 6)), -1),
}


def batches(p: Levels) -> list[list[tuple[str, str]]]:
    """The steps in groups that need nothing of their own group: as long as any is ready those of symbols (or of no window), then those of days."""
    done: set[str] = set()
    left, out = list(p.steps), []
    of_day = {name: f"PARTITION BY {p.time}" in x for name, x in left}
    ready = lambda x: set(re.findall(r"\bx\d+\b", x)) <= done
    while left:
        group = [(n, x) for n, x in left if ready(x) and not of_day[n]] or [(n, x) for n, x in left if ready(x)]
        out.append(group)
        done |= {n for n, _ in group}
        left = [(n, x) for n, x in left if n not in done]
    return out


def as_sql(names: list[str], source: str, ties: bool = False) -> str:
    """The same for DuckDB: one CTE a level over `source`."""
    p = Levels("duckdb", ties=ties)
    made = {n: FORMULAS[n](p) for n in names}
    ctes, last = [], source
    for k, group in enumerate(batches(p)):
        ctes.append(f"l{k} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in group)} FROM {last})")
        last = f"l{k}"
    return ", ".join(ctes) + " SELECT symbol, date, " + ", ".join(f"CAST({x} AS DOUBLE) + 0e0 AS {n}" for n, x in made.items()) + f" FROM {last}"
