"""Column-level helpers (O1, O2, O9, O10, M9, M10) — all JVM-side expressions.

Numeric rules shared by every plan (they make Spark and the SQL oracle agree
bit for bit):

* money stays DECIMAL until the very last step;
* a ratio or average is ``double(exact numerator) / double(exact count)``;
* a day average follows the source dialect's integer ``avg``: it truncates
  toward zero (``sum div count``) unless ``int_avg=False``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.labels import (ACCENTED, DAY_BUCKETS, GRADE_DEFAULT,
                                         GRADE_EXACT, GRADE_RANGES, OTHER_BUCKET,
                                         STATUS_LABELS, UNACCENTED)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_diff(start, end) -> Column:
    """Calendar days from ``start`` to ``end`` (midnight crossings), int."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def ratio(num, den, scale: float | None = None) -> Column:
    """``double(num) [* scale] / double(den)``, null when ``den`` is 0 or null."""
    n = _c(num).cast("double")
    if scale is not None:
        n = n * F.lit(float(scale))
    d = _c(den).cast("double")
    return F.when(d != 0, n / d)


def safe_ratio(num, den, scale: float | None = None) -> Column:
    """O2: ``num * scale / nullif(den, 0)`` as a double."""
    return ratio(num, den, scale)


def pct(num, den) -> Column:
    return ratio(num, den, 100.0)


def at_least_one(x) -> Column:
    """m(x) = greatest(x, 1): rows a left join contributes for x matches."""
    return F.greatest(F.coalesce(_c(x), F.lit(0)), F.lit(1)).cast("bigint")


def int_div(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``); null on 0."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return F.when(b != 0, F.call_function("div", a, b))


def avg_days(total, count, int_avg: bool = True) -> Column:
    """Average of day differences from an exact sum and count.

    ``int_avg`` mimics the source dialect's integer ``avg``: truncation
    toward zero; otherwise a double.
    """
    return int_div(total, count) if int_avg else ratio(total, count)




AVG_SCALE = 9


def fixed(x) -> Column:
    """A per-group average fixed at 9 decimals, so that averaging it again
    sums exact decimals (order-independent) instead of doubles."""
    return _c(x).cast(f"decimal(38,{AVG_SCALE})")




def bucketize(days, buckets=DAY_BUCKETS, default: str = OTHER_BUCKET,
              invalid: str | None = None) -> Column:
    """First inclusive [low, high] range that holds ``days``; else default.

    With ``invalid`` set, negative values get that label instead.
    """
    d = _c(days)
    expr = None
    if invalid is not None:
        expr = F.when(d < 0, F.lit(invalid))
    for low, high, label in buckets:
        cond = d.between(low, high)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def grade(score, exact: bool = True) -> Column:
    """Grade label of an average score (exact equality or ranges)."""
    s = _c(score)
    table = GRADE_EXACT if exact else GRADE_RANGES
    expr = None
    for bound, label in table:
        cond = (s == F.lit(float(bound))) if exact else (s >= F.lit(float(bound)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(GRADE_DEFAULT))


def status_label(status) -> Column:
    """M9: display label of an order status code; unknown codes -> null."""
    m = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return m[_c(status)]


def normalize_text(text) -> Column:
    """Trim, collapse inner whitespace, lower-case and fold accents."""
    t = F.regexp_replace(F.trim(_c(text)), r"\s+", " ")
    return F.translate(F.lower(t), ACCENTED, UNACCENTED)
