"""A registry of named feature columns: what each needs, and how to build it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    inputs: tuple[str, ...]
    build: Callable[[], Column]


_features: dict[str, Feature] = {}


def add(name: str, category: str, inputs: list[str], build: Callable[[], Column], overwrite: bool = False) -> Feature:
    if name in _features and not overwrite:
        raise ValueError(f"{name} is registered already")
    _features[name] = Feature(name, category, tuple(inputs), build)
    return _features[name]


def listed(category: str | None = None, text: str = "") -> list[Feature]:
    return [x for x in _features.values() if (category is None or x.category == category) and text in x.name]


def needed(names: list[str], have: list[str], known: dict[str, Feature] | None = None) -> list[Feature]:
    """The features of names that are not columns yet, those that others need first; a cycle or an unknown input is an error."""
    order: list[Feature] = []
    features = _features if known is None else known

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in have or any(x.name == name for x in order):
            return
        if name in above:
            raise ValueError("cycle: " + " -> ".join([*above, name]))
        if name not in features:
            raise KeyError(name)
        for i in features[name].inputs:
            visit(i, (*above, name))
        order.append(features[name])

    for n in names:
        visit(n, ())
    return order


def with_features(rows: DataFrame, names: list[str], known: dict[str, Feature] | None = None) -> DataFrame:
    """rows with the features, and those that they need, of the registry or of `known`."""
    for feature in needed(names, rows.columns, known):
        rows = rows.withColumn(feature.name, feature.build())
    return rows
