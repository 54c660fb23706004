"""Alpha formulas over long panels: the same levels as in alphas.py, computed on arrays.

Levels fall into groups that need rows of a symbol together, or names of a day. Rows move
once for each change between the two, with only the columns that later groups read: a level
is computed in the group where the fewest columns have to move.

Windows over a symbol's rows add up row by row, in the order and with the formulas for
moments that DuckDB uses over short frames, so that ties of rounded values come out alike.
A chunk of rows is held at a time, behind it as many rows as the group looks back at; of
days, one whole day's names at least.

Nulls are masks beside the values; NaN is a value, larger than any other, and division by
zero gives what IEEE says, as in the SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.alphas import FORMULAS, Levels

#: Rows that are computed together.
CHUNK = 1 << 15


class Arrays(Levels):
    """Levels whose windows and ranks are calls of the functions below."""

    def __init__(self, key: str = "symbol", time: str = "date", ties: bool = False):
        super().__init__("arrays", key, time, ties)

    def lag_of(self, x: str, n: int) -> str:
        return f"lag({x}, {n})"

    def ts(self, function: str, x: str, n: int) -> str:
        return self.add(f"{function}({self.level(x)}, {n})")

    def pair(self, function: str, a: str, b: str, n: int) -> str:
        return self.add(self.near(f"{function}({self.level(a)}, {self.level(b)}, {n})", 9))

    def rank(self, x: str) -> str:
        return self.add(f"day_rank({self.level(x)})")

    def scale(self, x: str) -> str:
        x = self.level(x)
        return self.add(f"{x} / nullif(day_size({x}), 0)")

    def ts_rank(self, x: str, n: int) -> str:
        return self.ts("place", x, n)

    def argmax(self, x: str, n: int) -> str:
        return self.ts("first_of_max", x, n)

    def weighted(self, x: str, n: int) -> str:
        return self.ts("weighted", x, n)


TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:e[-+]?\d+)?)|(\w+)|(<=|>=|<>|[-+*/<>=(),]))")


def parsed(text: str) -> tuple:
    """("number", x), ("column", name), ("case", [(condition, value)], else) or (operator or function, *arguments)."""
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    tokens.append((None, None, None))
    at = 0

    def take(*these: str) -> str | None:
        nonlocal at
        _, word, sign = tokens[at]
        if (word or sign) in these:
            at += 1
            return word or sign

    def need(this: str) -> None:
        if not take(this):
            raise ValueError(f"{this} is missing in {text!r}")

    def left(deeper: Callable[[], tuple], *signs: str) -> tuple:
        x = deeper()
        while sign := take(*signs):
            x = (sign, x, deeper())
        return x

    def compared() -> tuple:
        return left(lambda: left(lambda: left(single, "*", "/"), "+", "-"), "<", ">", "=", "<=", ">=", "<>")

    def condition() -> tuple:
        x = compared()
        if take("IS"):
            x = ("known" if take("NOT") else "unknown", x)
            need("NULL")
        return x

    def single() -> tuple:
        nonlocal at
        if take("-"):
            return ("negative", single())
        if take("("):
            x = condition()
            need(")")
            return x
        if take("CASE"):
            branches, other = [], None
            while take("WHEN"):
                c = condition()
                need("THEN")
                branches.append((c, condition()))
            if take("ELSE"):
                other = condition()
            need("END")
            return ("case", branches, other)
        number, word, _ = tokens[at]
        at += 1
        if number:
            return ("number", float(number))
        if not word:
            raise ValueError(f"cannot read {text!r}")
        if not take("("):
            return ("column", word)
        arguments = [condition()]
        while take(","):
            arguments.append(condition())
        need(")")
        return (word, *arguments)

    x = condition()
    if tokens[at] != (None, None, None):
        raise ValueError(f"cannot read {text!r}")
    return x


def columns_of(tree) -> set[str]:
    if isinstance(tree, (list, tuple)):
        return {tree[1]} if tree and tree[0] == "column" else set().union(*map(columns_of, tree)) if tree else set()
    return set()


def larger(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b, NaN above all."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, after scaling."""
    m = 10.0**digits
    size = np.abs(x * m)
    low = np.floor(size)
    out = np.copysign(low + (size - low >= 0.5), x) / m
    return np.where(np.isfinite(out), out, x)


class Rows:
    """Columns of consecutive rows as (values, known); `first` marks the first row of a symbol, or of a day."""

    def __init__(self, columns: dict[str, tuple[np.ndarray, np.ndarray]], first: np.ndarray):
        self.columns, self.first, self.n = columns, first, len(first)
        self.at = np.arange(self.n)
        self.start = np.maximum.accumulate(np.where(first, self.at, 0))

    def of(self, tree: tuple) -> tuple[np.ndarray, np.ndarray]:
        kind = tree[0]
        if kind == "number":
            return np.full(self.n, tree[1]), np.ones(self.n, bool)
        if kind == "column":
            return self.columns[tree[1]]
        if kind == "case":
            out, known, open_rows = np.zeros(self.n), np.zeros(self.n, bool), np.ones(self.n, bool)
            for when, then in [*tree[1], *([(None, tree[2])] if tree[2] else [])]:
                (c, c_known), (v, v_known) = self.of(when) if when else (open_rows, open_rows), self.of(then)
                hit = open_rows & c & c_known
                out[hit], known[hit] = v[hit], v_known[hit]
                open_rows = open_rows & ~hit
            return out, known
        if kind in ELEMENTWISE:
            found = [self.of(x) for x in tree[1:]]
            known = np.logical_and.reduce([k for _, k in found])
            return ELEMENTWISE[kind](*(v for v, _ in found)), known
        if kind in ("known", "unknown"):
            known = self.of(tree[1])[1]
            return known if kind == "known" else ~known, np.ones(self.n, bool)
        if kind == "nullif":
            (a, known), (b, b_known) = self.of(tree[1]), self.of(tree[2])
            return a, known & ~(b_known & (a == b))
        if kind == "ln":
            x, known = self.of(tree[1])
            return np.log(x), known & ~(x <= 0)
        if kind == "round":
            x, known = self.of(tree[1])
            return rounded(x, int(tree[2][1])), known
        if kind.startswith("day_"):
            return getattr(self, kind)(*self.of(tree[1]))
        *inputs, n = tree[1:]
        n = int(n[1])
        if kind == "lag":
            x, known = self.of(inputs[0])
            return np.concatenate([np.zeros(min(n, self.n)), x[: self.n - n]]), np.concatenate([np.zeros(min(n, self.n), bool), known[: self.n - n]]) & (self.at - self.start >= n)
        found = [self.of(x) for x in inputs]
        known = np.logical_and.reduce([k for _, k in found])
        began = np.maximum.accumulate(np.where(known, self.start, self.at + 1))
        full = self.at - began >= n - 1
        values = [np.concatenate([np.zeros(n - 1), np.where(known, v, 0.0)]) for v, _ in found]
        if len(values) == 2:
            for x in values:
                full = full & ~self._constant(x[n - 1 :], n)
        out = getattr(self, "_" + kind)(*values, n)
        out, more = out if isinstance(out, tuple) else (out, True)
        return out, full & more

    def _constant(self, x: np.ndarray, n: int) -> np.ndarray:
        """Whether the n values up to a row are all equal; where it matters they are of one symbol and known."""
        changed = np.ones(self.n, bool)
        changed[1:] = ~((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1])))
        return self.at - np.maximum.accumulate(np.where(changed, self.at, 0)) >= n - 1

    def _sum(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(self.n)
        for k in range(n):
            out += x[k : k + self.n]
        return out

    def _avg(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._sum(x, n) / n

    def _moment(self, x: np.ndarray, n: int) -> np.ndarray:
        mean, out = np.zeros(self.n), np.zeros(self.n)
        for k in range(1, n + 1):
            now = x[k - 1 : k - 1 + self.n]
            d = now - mean
            mean += d / k
            out += (now - mean) * d
        return out

    def _stddev_samp(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.sqrt(self._moment(x, n) / (n - 1))

    def _moments(self, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a, of b and of both together."""
        mean_a, mean_b, aa, bb, ab = (np.zeros(self.n) for _ in range(5))
        for k in range(1, n + 1):
            x, y = a[k - 1 : k - 1 + self.n], b[k - 1 : k - 1 + self.n]
            da, db = x - mean_a, y - mean_b
            mean_a += da / k
            mean_b += db / k
            x = x - mean_a
            aa += x * da
            bb += (y - mean_b) * db
            x *= db
            ab += x
        return aa, bb, ab

    def _corr(self, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        aa, bb, ab = self._moments(a, b, n)
        under = np.sqrt(aa / n) * np.sqrt(bb / n)
        return ab / n / under, under != 0

    def _covar_samp(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        return self._moments(a, b, n)[2] / (n - 1)

    def _extreme(self, f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
        wide = 1
        while 2 * wide <= n:
            x = f(x[wide:], x[:-wide])
            wide *= 2
        return f(x[n - wide :], x[: self.n]) if wide < n else x

    def _max(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._extreme(np.maximum, x, n)

    def _min(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._extreme(np.fmin, x, n)

    def _place(self, x: np.ndarray, n: int) -> np.ndarray:
        """Rank of the last value in its frame, as a share of n, ties averaged."""
        last = x[n - 1 :]
        below, same = np.zeros(self.n), np.ones(self.n)
        odd = np.isnan(x).any()
        for k in range(n - 1):
            now = x[k : k + self.n]
            below += larger(last, now) if odd else now < last
            same += (now == last) | (np.isnan(now) & np.isnan(last)) if odd else now == last
        return (below + (same + 1) / 2) / n

    def _first_of_max(self, x: np.ndarray, n: int) -> np.ndarray:
        best, out = x[: self.n].copy(), np.ones(self.n)
        for k in range(1, n):
            now = x[k : k + self.n]
            up = larger(now, best)
            best[up], out[up] = now[up], k + 1
        return out

    def _weighted(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(self.n)
        for k in range(n):
            out += x[k : k + self.n] * (k + 1)
        return out / (n * (n + 1) / 2)

    def day_rank(self, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Percentile rank among the known values of a day, ties averaged."""
        rows = np.flatnonzero(known)
        day, v = self.start[rows], x[rows]
        order = np.lexsort((v, day))
        rows, day, v = rows[order], day[order], v[order]
        new_day = np.ones(len(v), bool)
        new_day[1:] = day[1:] != day[:-1]
        new = new_day.copy()
        new[1:] |= ~((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
        group, of_day = np.cumsum(new) - 1, np.cumsum(new_day) - 1
        first, size, names = np.flatnonzero(new), np.bincount(group), np.bincount(of_day)
        rank = first[group] - np.flatnonzero(new_day)[of_day] + 1
        out = np.zeros(self.n)
        out[rows] = (rank + (size[group] - 1) / 2) / names[of_day]
        return out, known

    def day_size(self, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of a day's absolute values; added from the smallest, so that the order of rows does not matter."""
        rows = np.flatnonzero(known)
        day, v = self.start[rows], np.abs(x[rows])
        order = np.lexsort((v, day))
        total, count = (np.bincount(day[order], w, minlength=self.n) for w in (v[order], np.ones(len(rows))))
        return total[self.start], count[self.start] > 0


ELEMENTWISE = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "negative": np.negative, "abs": np.abs, "sign": np.sign, "power": np.power,
    "<": lambda a, b: larger(b, a), ">": larger, "<=": lambda a, b: ~larger(a, b), ">=": lambda a, b: ~larger(b, a),
    "=": lambda a, b: ~(larger(a, b) | larger(b, a)), "<>": lambda a, b: larger(a, b) | larger(b, a),
}


def look_back(tree, known: dict[str, int]) -> int:
    """Earlier rows of a symbol that an expression reads."""
    if not isinstance(tree, (list, tuple)) or not tree or tree[0] == "number":
        return 0
    if tree[0] == "column":
        return known.get(tree[1], 0)
    inner = max((look_back(x, known) for x in tree), default=0)
    if tree[0] in WINDOWS:
        return inner + int(tree[-1][1]) - (tree[0] != "lag")
    return inner


WINDOWS = {"lag", "sum", "avg", "stddev_samp", "min", "max", "corr", "covar_samp", "place", "first_of_max", "weighted"}


def kind_of(tree) -> str | None:
    """"symbol" or "day" for an expression that looks at other rows, None for others."""
    if not isinstance(tree, (list, tuple)) or not tree:
        return None
    if isinstance(tree[0], str) and tree[0].startswith("day_"):
        return "day"
    if isinstance(tree[0], str) and tree[0] in WINDOWS:
        return "symbol"
    return next((k for x in tree if (k := kind_of(x))), None)


def groups(steps: dict[str, tuple], wanted: set[str], base: set[str]) -> list[list[str]]:
    """Names of steps by the group that computes them: groups of symbols and of days in turn, beginning with symbols."""
    kind, reads = {n: kind_of(x) for n, x in steps.items()}, {n: columns_of(x) for n, x in steps.items()}
    fits = lambda n, g: kind[n] is None or (kind[n] == "day") == bool(g % 2)
    first: dict[str, int] = {}
    for n in steps:
        g = max((first[x] for x in reads[n] if x in first), default=0)
        first[n] = g if fits(n, g) else g + 1
    ends = max(first.values(), default=0)
    users: dict[str, list[str]] = {}
    for n in steps:
        for x in reads[n]:
            users.setdefault(x, []).append(n)
    late: dict[str, int] = {}
    for n in reversed(list(steps)):
        g = min((late[u] for u in users.get(n, [])), default=ends)
        late[n] = g if fits(n, g) else g - 1

    def moved(at: dict[str, int]) -> int:
        """Columns that move, over all changes of group."""
        total = 0
        for x in [*base, *steps]:
            until = ends if x in wanted else max((at[u] for u in users.get(x, [])), default=-1)
            total += max(0, until - at.get(x, 0))
        return total

    best = None
    for at in (dict(first), dict(late)):
        cost = moved(at)
        while True:
            before = cost
            for n in [*steps, *reversed(list(steps))]:
                low = max((at[x] for x in reads[n] if x in at), default=0)
                high = min((at[u] for u in users.get(n, [])), default=ends)
                for g in range(low, high + 1):
                    if fits(n, g) and ((now := moved(at | {n: g})) < cost or now == cost and g > at[n]):
                        at[n], cost = g, now
            if cost == before:
                break
        if best is None or cost < best[0]:
            best = cost, at
    return [[n for n in steps if best[1][n] == g] for g in range(ends + 1)]


def _columns(batch: pa.Table, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for n in names:
        x = batch.column(n).combine_chunks()
        out[n] = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(x).to_numpy(zero_copy_only=False)
    return out


def _first(ids: pa.ChunkedArray) -> np.ndarray:
    """Whether a row's id is not that of the row before."""
    i = ids.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    out = np.ones(len(i), bool)
    out[1:] = i[1:] != i[:-1]
    return out


def kernel(steps: list[tuple[str, tuple]], outputs: list[str], ids: list[str], by: str, inputs: list[str], back: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Computes steps over sorted rows: with `back`, chunk by chunk behind so many earlier rows; without, over whole groups of equal `by`."""
    chunk = CHUNK

    def computed(rows: pa.Table, skip: int) -> pa.RecordBatch:
        found = Rows(_columns(rows, inputs), _first(rows.column(by)))
        with np.errstate(all="ignore"):
            for name, tree in steps:
                found.columns[name] = found.of(tree)
        out = [rows.column(i).slice(skip).combine_chunks() for i in ids]
        out += [pa.array(v[skip:] + 0.0, mask=~known[skip:]) for v, known in (found.columns[n] for n in outputs)]
        return pa.RecordBatch.from_arrays(out, [*ids, *outputs])

    def run(batches):
        held, size, skip = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.table(b))
            size += b.num_rows
            if size - skip < chunk or back is None and held[0].column(by)[0].equals(b.column(by)[-1]):
                continue
            rows = pa.concat_tables(held)
            if back is not None:
                yield computed(rows, skip)
                skip = size = min(back, len(rows))
                held = [rows.slice(len(rows) - size)]
            else:
                last = int(np.flatnonzero(_first(rows.column(by)))[-1])
                yield computed(rows.slice(0, last), 0)
                held = [rows.slice(last)]
                size = len(rows) - last
        if size > skip:
            yield computed(pa.concat_tables(held), skip)

    return run


def planned(names: list[str], ties: bool) -> tuple[dict[str, tuple], set[str], list[tuple[str, list[str]]]]:
    """The steps of formulas, the panel's columns that they read, and the groups of steps with the key by which rows are dealt."""
    p = Arrays(ties=ties)
    made = {n: FORMULAS[n](p) for n in names}
    every = {n: parsed(x) for n, x in [*p.steps, *made.items()]}
    used, todo = set(), [*names]
    while todo:
        used.add(n := todo.pop())
        todo += [x for x in columns_of(every[n]) if x in every and x not in used]
    steps = {n: x for n, x in every.items() if n in used}
    base = set().union(*map(columns_of, steps.values())) - set(steps)
    plan = [(p.time if g % 2 else p.key, some) for g, some in enumerate(groups(steps, set(names), base))]
    return steps, base, plan if plan[0][1] or len(plan) == 1 else plan[1:]


def computed(daily: Callable[[str], DataFrame], names: list[str], ties: bool = False) -> DataFrame:
    """symbol, date and the named formulas; daily(by) is a panel of which rows with one symbol, or one date, are in one partition."""
    steps, base, plan = planned(names, ties)
    panel, ids = daily(plan[0][0]), ["symbol", "date"]
    types = dict(panel.dtypes)
    rows = panel.select(*ids, *(F.col(c).cast("double").alias(c) for c in sorted(base)))
    for g, (by, group) in enumerate(plan):
        later = set().union(*(columns_of(steps[n]) for _, some in plan[g + 1 :] for n in some)) | set(names)
        have = rows.columns[2:]
        outputs = [c for c in [*have, *group] if c in later]
        back: dict[str, int] = {}
        for n in group:
            back[n] = look_back(steps[n], back)
        of_symbols = by == "symbol"
        run = kernel([(n, steps[n]) for n in group], outputs, ids, by, have, max(back.values(), default=0) if of_symbols else None)
        dealt = rows.repartition(by) if g else rows
        rows = dealt.sortWithinPartitions(*(ids if of_symbols else [by])).mapInArrow(run, ", ".join([*(f"{i} {types[i]}" for i in ids), *(f"{c} double" for c in outputs)]))
    return rows.select(*ids, *names)
