"""Scalar expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2p1(value: str | Column) -> Column:
    """log2(x + 1); zero maps to zero, so absent entries stay absent."""
    value = F.col(value) if isinstance(value, str) else value
    return F.log2(value + F.lit(1.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Division with x/0 = +-Infinity and 0/0 = NULL."""
    return (
        F.when(bottom != 0, top / F.when(bottom != 0, bottom))
        .when(top > 0, F.lit(float("inf")))
        .when(top < 0, F.lit(float("-inf")))
    )


def decay_quota(size: Column, pinit, pfin, scale) -> Column:
    """Cells to draw from a group: the drawn share falls from ``pfin`` to
    ``pinit`` as the group grows. Half counts round to even."""
    pinit, pfin, scale = (x if isinstance(x, Column) else F.lit(float(x)) for x in (pinit, pfin, scale))
    share = pinit + F.exp(-size / scale) * (pfin - pinit)
    return F.bround(share * size).cast("long")


# Rational approximations of erfc by W. J. Cody (1969), as
# published in the public SPECFUN routines. Highest power first.
_ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
     3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2,
     1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
     6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
     1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
     1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
     3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
     1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1,
     6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _horner(coefficients, x: str) -> str:
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def erfc_sql(x: str, suffix: str = "D") -> str:
    """SQL text of erfc(x) for x >= 0; ``x`` must be a plain column name.

    ``suffix`` marks double literals and is empty for dialects without it.
    """
    square = f"({x} * {x})"
    inverse = f"(1.0D / {square})"
    small = f"1.0D - {x} * {_horner(_ERF_SMALL[0], square)} / {_horner(_ERF_SMALL[1], square)}"
    middle = f"exp(-{square}) * {_horner(_ERFC_MIDDLE[0], x)} / {_horner(_ERFC_MIDDLE[1], x)}"
    tail = f"{inverse} * {_horner(_ERFC_LARGE[0], inverse)} / {_horner(_ERFC_LARGE[1], inverse)}"
    large = f"exp(-{square}) * (0.56418958354775628695D - {tail}) / {x}"
    text = f"CASE WHEN {x} <= 0.46875D THEN {small} WHEN {x} <= 4.0D THEN {middle} ELSE {large} END"
    return text if suffix == "D" else _replace_suffix(text, suffix)


def _replace_suffix(text: str, suffix: str) -> str:
    import re

    return re.sub(r"(\d)D\b", lambda m: m.group(1) + suffix, text)
