"""Scalar column expressions.

Each function returns a ``Column`` so Catalyst can fold, push down and
code-generate it; none runs Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

# Text a number may be written as: Python float() syntax (digits with single
# underscores between them, optional fraction and exponent, inf/infinity/nan).
# Java-style suffixes such as '1d' or '1f' are not numbers here.
_DIGITS = r"\d(?:_?\d)*"
NUMBER_PATTERN = (
    r"^[+-]?(?:(?:" + _DIGITS + r"(?:\." + "(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
    r"(?:[eE][+-]?" + _DIGITS + r")?|(?i:inf|infinity|nan))$"
)
# The same pattern is valid RE2 syntax, for the SQL oracle.
NUMBER_PATTERN_SQL = NUMBER_PATTERN


def lenient_double(c: str | Column, dtype: DataType | None = None) -> Column:
    """String or number -> double; text that is not a number -> null.

    Whole-column form of "try float(value), else None".  Surrounding white
    space is ignored, as Python does.  Plain ``cast`` raises under ANSI mode,
    ``try_cast`` alone accepts '1d' and rejects '1_000', hence the guard.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, NumericType):
        return col.cast("double")
    s = F.regexp_replace(col.cast(StringType()), r"^\s+|\s+$", "")
    return F.when(s.rlike(NUMBER_PATTERN),
                  F.regexp_replace(s, "_", "").try_cast("double"))


def complete_row(cols) -> Column:
    """True when every column is neither null nor NaN (as ``na.drop``)."""
    conds = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in cols]
    return reduce(lambda a, b: a & b, conds)


def fault_code_match(codes, list_cols=("Faultlist", "Faultlist2")) -> Column:
    """OR over codes of '[code]' contained in any of the packed list columns.

    The brackets keep '168' from matching '[1682]'.  A null list is harmless
    as long as another list matches (null OR true is true).
    """
    codes = list(codes)
    if not codes:
        raise ValueError("fault code list is empty")
    conds = [F.col(lc).contains(f"[{code}]") for code in codes for lc in list_cols]
    return reduce(lambda a, b: a | b, conds)


def group_match(group_col: str, platforms, emissions) -> Column:
    """Token 0 of ``group_col`` split on '_' in ``platforms`` and token 1 in ``emissions``.

    Written as equality / prefix tests on the raw string, which are the same
    condition for tokens without '_' and, unlike ``split(...)[i]``, reach the
    Parquet reader as pushed filters (``StringStartsWith``).  Tokens that
    contain '_' can never equal a split token, so they match nothing.
    """
    pairs = [(p, e) for p in platforms for e in emissions if "_" not in p and "_" not in e]
    if not pairs:
        return F.lit(False)
    g = F.col(group_col)
    conds = [(g == f"{p}_{e}") | g.startswith(f"{p}_{e}_") for p, e in pairs]
    return reduce(lambda a, b: a | b, conds)


def holdout_bucket(key: str | Column, seed: int) -> Column:
    """Stable bucket in [0, 10000) from md5(seed ':' key).

    Depends on the key only, not on partitioning or row order, so the split is
    the same on every run and every cluster size; DuckDB can compute it too.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(10000)).cast("int")


def in_holdout(key: str | Column, seed: int, ratio: float) -> Column:
    return holdout_bucket(key, seed) < F.lit(int(round(ratio * 10000)))
