"""Operators by name: (DataFrame, **parameters) -> DataFrame. Users add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import bars, channels, levels, liquidity, pivots, profile, series, strategy, structure

Operator = Callable[..., DataFrame]
_operators: dict[str, Operator] = {}


def register(name: str, operator: Operator) -> Operator:
    if name in _operators:
        raise ValueError(f"there is an operator {name}")
    _operators[name] = operator
    return operator


def names() -> list[str]:
    return sorted(_operators)


def apply(name: str, df: DataFrame, **parameters) -> DataFrame:
    return _operators[name](df, **parameters)


for _module in (bars, series, pivots, liquidity, structure, strategy, channels, levels, profile):
    for _name, _f in vars(_module).items():
        if not _name.startswith("_") and callable(_f) and getattr(_f, "__module__", "") == _module.__name__ and not isinstance(_f, type):
            _operators[f"{_module.__name__.rsplit('.', 1)[1]}.{_name}"] = _f
