"""Rules as columns: conditions given as data become boolean algebra that Spark optimises."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt}
_ATOM = re.compile(r"(abs\()?\s*([A-Za-z_]\w*)\s*\)?\s*(<=|>=|==|!=|<|>)\s*(-?\d+(?:\.\d+)?(?:e-?\d+)?)")
PHASES = ("system_safety", "hard_gate", "guardrail")


def condition(feature: str, op: str, value: float, absolute: bool = False) -> Column:
    """One comparison; null compares false."""
    c = F.abs(feature) if absolute else F.col(feature)
    return F.coalesce(_COMPARE[op](c, F.lit(value)), F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def predicate(text: str, columns: Sequence[str]) -> Column:
    """`abs(x) >= v AND y < w` over known columns."""
    atoms = []
    for part in re.split(r"\s+AND\s+", text.strip(), flags=re.I):
        m = _ATOM.fullmatch(part.strip())
        if not m or m[2] not in columns:
            raise ValueError(f"not a condition over known columns: {part!r}")
        atoms.append(condition(m[2], m[3], float(m[4]), bool(m[1])))
    return all_of(atoms)


def when_clause(clause: Mapping) -> Column:
    """{'all_of': [...], 'any_of': [...]} or {'feature', 'op', 'value'}, nested."""
    parts = []
    if "feature" in clause:
        parts.append(condition(clause["feature"], clause["op"], clause["value"], clause.get("abs", False)))
    if "all_of" in clause:
        parts.append(all_of(map(when_clause, clause["all_of"])))
    if "any_of" in clause:
        parts.append(any_of(map(when_clause, clause["any_of"])))
    return all_of(parts)


def deny_tag(rules: Sequence[Mapping]) -> Column:
    """The tag of the first enabled rule that matches, by phase and then priority; null where all pass."""
    live = sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (PHASES.index(r["phase"]), r.get("priority", 0)))
    return F.coalesce(*(F.when(when_clause(r["when"]), F.lit(r["tag"])) for r in live), F.lit(None).cast("string"))


def vote(transforms: Sequence[tuple[str, str, float]], consensus: bool = False) -> Column:
    """Direction of (column, transform, parameter) rules: the first that is not 0, or what all non-zero ones agree on."""
    def one(c, kind, v):
        x = F.col(c)
        made = {"sign": F.signum(x), "negate_sign": -F.signum(x), "center_sign": F.signum(x - v), "threshold": F.when(x > v, 1.0).when(x < -v, -1.0).otherwise(0.0), "raw": x}[kind]
        return F.nullif(made, F.lit(0.0))

    votes = [one(*t) for t in transforms]
    if not consensus or len(votes) == 1:
        return F.coalesce(*votes, F.lit(0.0))
    low, high = F.least(*votes), F.greatest(*votes)
    return F.when(low == high, low).otherwise(0.0)


def agree_outside(a: str, b: str, dead: float) -> Column:
    """+1 or -1 where both positions exceed the dead band on one side."""
    return F.when(F.least(a, b) > dead, 1).when(F.greatest(a, b) < -dead, -1).otherwise(0)


def in_band(c: str, inner: float, outer: float) -> Column:
    return F.when((F.abs(c) > inner) & (F.abs(c) < outer), F.signum(c).cast("int")).otherwise(0)


def signals(quantile: str, confidence: str, lo: float, hi: float, least: float) -> Column:
    sure = F.col(confidence) >= least
    return F.when(sure & (F.col(quantile) >= hi), 1).when(sure & (F.col(quantile) <= lo), -1).otherwise(0)


def ladder(c: str, steps: Sequence[tuple[float, float]], default: float) -> Column:
    """The multiplier of the first step whose bound the value reaches, steps in descending order of bound."""
    return reduce(lambda out, s: out.when(F.col(c) >= s[0], s[1]), steps[1:], F.when(F.col(c) >= steps[0][0], steps[0][1])).otherwise(default)
