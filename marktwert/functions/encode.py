"""Column expressions (JVM-side, codegen-friendly) for encodings and
derived fields.  Each function returns a ``Column``; nothing here runs Python
per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age(year_col: str | Column, as_of_year: int | Column) -> Column:
    """``age = as_of_year - yearOfRegistration``."""
    ref = as_of_year if isinstance(as_of_year, Column) else F.lit(int(as_of_year))
    return (ref - col_(year_col)).cast("int")


def strict_code(c: str | Column, mapping: Mapping[str, int], name: str) -> Column:
    """Map values to codes; an unmapped non-null value fails the job."""
    c = col_(c)
    expr = None
    for key, code in mapping.items():
        expr = F.when(c == key, F.lit(code)) if expr is None else expr.when(c == key, F.lit(code))
    return (expr.when(c.isNull(), F.lit(None).cast("int"))
                .otherwise(F.raise_error(F.concat(F.lit(f"unmapped value in {name}: "), c)))
                .cast("int"))


def decode(c: str | Column, labels: Mapping[int, str]) -> Column:
    """Inverse of a binary code (null stays null)."""
    c = col_(c)
    expr = None
    for code, label in labels.items():
        expr = F.when(c == code, label) if expr is None else expr.when(c == code, label)
    return expr


def lenient_flag(c: str | Column, positive: str) -> Column:
    """P10: ``1 if lower(x) == positive else 0`` (null and anything else -> 0)."""
    return F.coalesce((F.lower(col_(c)) == positive).cast("int"), F.lit(0))


def translate(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary translation; unmapped values become null."""
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)[col_(c)]


def age_group(c: str | Column) -> Column:
    """Right-closed bins (0,3],(3,5],... ; outside -> null."""
    c = col_(c)
    expr = None
    for lo, hi, label in zip(C.AGE_BINS[:-1], C.AGE_BINS[1:], C.AGE_LABELS):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def age_group_order(c: str | Column) -> Column:
    """Ordinal of the P22 bin (1-based) for sorting; null outside."""
    c = col_(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(C.AGE_BINS[:-1], C.AGE_BINS[1:]), start=1):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def null_safe_clip(c: str | Column, lo: float, hi: float) -> Column:
    """Clip into [lo, hi]; null stays null (``least``/``greatest`` skip nulls)."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def round_half_away(c: str | Column, digits: int = 2) -> Column:
    """``round(x * 10^d) / 10^d`` with halves away from zero, evaluated on the
    scaled double (the rounding a C library ``round`` applies)."""
    scale = float(10 ** digits)
    return F.round(col_(c) * scale, 0) / scale


def price_band(pred: str | Column, margin: float | Column) -> tuple[Column, Column, Column]:
    """SC3: ``[max(0, p - m), p + m]`` rounded to cents plus the ``"lo - hi"`` text."""
    p = col_(pred)
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    lo = round_half_away(F.greatest(F.lit(0.0), p - m), 2)
    hi = round_half_away(p + m, 2)
    # max(0, x) keeps the integer 0 when x <= 0, which prints as "0".
    lo_text = F.when(p - m <= 0, F.lit("0")).otherwise(lo.cast("string"))
    text = F.concat_ws(" - ", lo_text, hi.cast("string"))
    return lo, hi, text


def first_forwarded_ip(forwarded: str | Column, client: str | Column) -> Column:
    """First entry of X-Forwarded-For, else the client address."""
    f = col_(forwarded)
    return F.when(f.isNotNull() & (f != ""), F.trim(F.split(f, ",")[0])).otherwise(col_(client))
