"""Model formulas: ``y ~ a + b``, ``y ~ .``, ``y ~ . - a``."""

from __future__ import annotations

import re


def variables(formula: str, columns: list[str]) -> tuple[str | None, list[str]]:
    """(response, predictors). ``.`` stands for all other columns; an empty left side means no response."""
    left, sep, right = formula.partition("~")
    if not sep:
        raise ValueError("a formula needs ~")
    response = left.strip() or None
    predictors: list[str] = []
    for sign, term in re.findall(r"([+-]?)\s*([^\s+-][^+-]*)", right):
        names = [c for c in columns if c != response] if term.strip() == "." else [term.strip()]
        predictors = [p for p in predictors if p not in names] + (names if sign != "-" else [])
    missing = [c for c in [*predictors, *([response] if response else [])] if c not in columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    if not predictors:
        raise ValueError("no predictors")
    return response, predictors
