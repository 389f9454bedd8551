"""Column expressions for the scalar rules used by the measures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = r"[ _-]+"


def simplify_name(name: str) -> str:
    """Measure-name key: lower case, without blanks, underscores and dashes."""
    return re.sub(_SEPARATORS, "", name).lower()


def simplified(name: Column) -> Column:
    """:func:`simplify_name` for a string column."""
    return F.lower(F.regexp_replace(name, _SEPARATORS, ""))


def zero_small_negative(d: Column, epsilon: float = 1e-7) -> Column:
    """0 where -epsilon < d < 0 (both bounds open), d elsewhere; NaN stays NaN."""
    return F.when((d > -epsilon) & (d < 0), F.lit(0.0)).otherwise(d)


def clamp_cosine(c: Column, epsilon: float = 1e-7) -> Column:
    """±1 where rounding pushed a cosine at most epsilon beyond it."""
    over = F.abs(c) - 1
    return F.when((over > 0) & (over <= epsilon), F.signum(c)).otherwise(c)


def clip_eigenvalues(values: Column, tolerance: float = 1e-3) -> Column:
    """Zero the eigenvalues in [-tolerance, 0); fail below that."""

    def clip(x: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("eigenvalue below tolerance: "), x.cast("string")))
        return F.when(x >= 0, x).when(x >= -tolerance, F.lit(0.0)).otherwise(bad.cast("double"))

    return F.transform(values, clip)


def noise_level(dim, noise_var: float | None, b: float):
    """Additive noise variance; ``noise_var`` wins over ``b``.

    ``dim`` may be a number or a Column and so is the result.
    """
    if noise_var is not None:
        return noise_var if not isinstance(dim, Column) else F.lit(float(noise_var))
    return dim * b / (1 + dim * b)


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
