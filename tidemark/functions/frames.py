"""Column builders over ordered rows of a key: each looks at the current and earlier rows only, unless its name says otherwise.

`least` is the number of non-null values a frame needs, by default the whole frame; with
fewer the value is null, as in pandas' min_periods.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def correlation(a: Column | str, b: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without a null; null where one side is constant."""
    a, b = _col(a), _col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    f = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return f(F.covar_pop(a, b)) / F.nullif(f(F.stddev_pop(a)) * f(F.stddev_pop(b)), F.lit(0.0))


@dataclass(frozen=True)
class Frames:
    """Window functions for one key and order."""

    keys: Sequence[str] = ("symbol",)
    order: Sequence[str] = ("ts",)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def past(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.ordered.rowsBetween(-n, -1)

    def ahead(self, n: int, start: int = 1) -> WindowSpec:
        """Label side: rows start to start + n - 1 after the current one."""
        return self.ordered.rowsBetween(start, start + n - 1)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def _guarded(self, value: Column, c: Column, w: WindowSpec, least: int) -> Column:
        return F.when(F.count(c).over(w) >= least, value)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(_col(c), n).over(self.ordered)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(_col(c), n).over(self.ordered)

    def delta(self, c, n: int = 1) -> Column:
        return _col(c) - self.lag(c, n)

    def change(self, c, n: int = 1) -> Column:
        return _col(c) / self.lag(c, n) - 1

    def agg(self, f, c, n: int, least: int | None = None) -> Column:
        c, w = _col(c), self.past(n)
        return self._guarded(f(c).over(w), c, w, n if least is None else least)

    def sum(self, c, n: int, least: int | None = None) -> Column:
        return self.agg(F.sum, c, n, least)

    def mean(self, c, n: int, least: int | None = None) -> Column:
        return self.agg(F.avg, c, n, least)

    def std(self, c, n: int, least: int | None = None) -> Column:
        return self.agg(F.stddev_samp, c, n, least)

    def min(self, c, n: int, least: int | None = None) -> Column:
        return self.agg(F.min, c, n, least)

    def max(self, c, n: int, least: int | None = None) -> Column:
        return self.agg(F.max, c, n, least)

    def quantile(self, c, n: int, q: float, least: int | None = None) -> Column:
        """Linear interpolation between the two neighbours."""
        return self.agg(lambda x: F.percentile(x, F.lit(q)), c, n, least)

    def zscore(self, c, n: int, least: int | None = None, shift: int = 0) -> Column:
        c, w = _col(c), self.past(n) if not shift else self.ordered.rowsBetween(-(n - 1) - shift, -shift)
        sd = F.stddev_samp(c).over(w)
        return self._guarded(F.when(sd > 0, (c - F.avg(c).over(w)) / sd), c, w, n if least is None else least)

    def robust_z(self, c, n: int, least: int | None = None) -> Column:
        """(x - median) / (1.4826 * median absolute deviation) of the frame."""
        c, w = _col(c), self.past(n)
        middle = F.percentile(c, F.lit(0.5)).over(w)
        away = F.array_sort(F.transform(F.collect_list(c).over(w), lambda x: F.abs(x - middle)))
        size = F.size(away)
        low, high = F.element_at(away, F.floor((size + 1) / 2).cast("int")), F.element_at(away, F.floor((size + 2) / 2).cast("int"))
        mad = (low + high) / 2
        return self._guarded(F.when(mad > 0, (c - middle) / (1.4826 * mad)), c, w, n if least is None else least)

    def corr(self, a, b, n: int) -> Column:
        a, b, w = _col(a), _col(b), self.past(n)
        both = a.isNotNull() & b.isNotNull()
        return F.when(F.count(F.when(both, 1)).over(w) >= n, correlation(a, b, w))

    def cov(self, a, b, n: int) -> Column:
        a, b, w = _col(a), _col(b), self.past(n)
        both = a.isNotNull() & b.isNotNull()
        return F.when(F.count(F.when(both, 1)).over(w) >= n, F.covar_samp(a, b).over(w))

    def arg(self, extreme, c, n: int) -> Column:
        """1-based place in the frame of the first F.array_max or F.array_min."""
        c, w = _col(c), self.past(n)
        values = F.collect_list(c).over(w)
        return self._guarded(F.array_position(values, extreme(values)).cast("double"), c, w, n)

    def rank_last(self, c, n: int) -> Column:
        """Rank of the last value in the frame, ties averaged."""
        c, w = _col(c), self.past(n)
        values = F.collect_list(c).over(w)
        below, same = F.size(F.filter(values, lambda x: x < c)), F.size(F.filter(values, lambda x: x == c))
        return self._guarded(below + (same + 1) / 2, c, w, n)

    def rank_in_history(self, c, n: int, least: int | None = None) -> Column:
        """Share of the n rows before the current one that are at most its value."""
        c, w = _col(c), self.before(n)
        values = F.collect_list(c).over(w)
        return self._guarded(F.size(F.filter(values, lambda x: x <= c)) / F.size(values), c, w, n if least is None else least)

    def decay(self, c, n: int) -> Column:
        """Mean with weights 1 to n, the newest row heaviest."""
        c, w = _col(c), self.past(n)
        values = F.collect_list(c).over(w)
        weighted = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        return self._guarded(weighted / (n * (n + 1) / 2), c, w, n)

    def product(self, c, n: int) -> Column:
        c, w = _col(c), self.past(n)
        return self._guarded(F.aggregate(F.collect_list(c).over(w), F.lit(1.0), lambda a, x: a * x), c, w, n)

    def slope(self, c, clock, n: int) -> Column:
        c, w = _col(c), self.past(n)
        return self._guarded(F.regr_slope(c, _col(clock)).over(w), c, w, n)

    def r2(self, c, clock, n: int) -> Column:
        c, w = _col(c), self.past(n)
        return self._guarded(F.regr_r2(c, _col(clock)).over(w), c, w, n)

    def filled(self, c) -> Column:
        return F.last(_col(c), ignorenulls=True).over(self.so_far)

    def island(self, condition: Column) -> Column:
        """A number that stays the same while the condition holds, to group or partition by."""
        return F.sum(F.when(condition, 0).otherwise(1)).over(self.so_far)

    def crosses_above(self, a, b) -> Column:
        return F.coalesce((self.lag(a) <= self.lag(b)) & (_col(a) > _col(b)), F.lit(False))

    def drawdown(self, c) -> Column:
        return _col(c) / F.max(_col(c)).over(self.so_far) - 1

    def since_extreme(self, extreme, c, n: int) -> Column:
        return n - self.arg(extreme, c, n)


def across(*keys: str) -> WindowSpec:
    """All rows of one moment."""
    return Window.partitionBy(*keys)


def cross_rank(c, *keys: str) -> Column:
    """Percentile rank among the non-null rows of one moment, ties averaged."""
    c = _col(c)
    w = Window.partitionBy(*keys, c.isNull()).orderBy(c)
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(c).over(Window.partitionBy(*keys))
    return F.when(c.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / n)


def cross_z(c, *keys: str) -> Column:
    c, w = _col(c), Window.partitionBy(*keys)
    sd = F.stddev_samp(c).over(w)
    return F.when(sd > 0, (c - F.avg(c).over(w)) / sd)


def cross_scale(c, *keys: str) -> Column:
    c = _col(c)
    return c / F.sum(F.abs(c)).over(Window.partitionBy(*keys))
