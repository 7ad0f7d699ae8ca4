"""Row-wise rules as Spark ``Column`` expressions.

Each function returns a built-in expression, so a whole feature set becomes
one projection inside whole-stage codegen; no Python runs per row. Null
handling follows the notebooks' numeric semantics: a comparison with a
missing value is false, except ``!=`` which is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0 (null counts as false)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def right_closed_bucket(x, edges, labels) -> Column:
    """Label ``x`` by right-closed intervals ``(e[i], e[i+1]]``; the lowest
    edge is included; values outside every interval (and null) give null.

    ``Bucketizer`` is left-closed, so 30 would land in the next bucket; this
    is an explicit CASE instead.
    """
    x = col(x)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if i == 0 else (x > F.lit(lo))
        cond = lower & (x <= F.lit(hi)) if hi != float("inf") else lower
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def lead_time_bucket(lead_time="lead_time") -> Column:
    return right_closed_bucket(lead_time, S.LEAD_TIME_EDGES, S.LEAD_TIME_LABELS)


def adr_bucket(adr="adr") -> Column:
    """EDA bucket: null for negative (or missing) rates."""
    return right_closed_bucket(adr, S.ADR_EDGES, S.ADR_LABELS)


def adr_bucket_filled(adr="adr") -> Column:
    """Feature bucket: the missing bucket becomes ``Invalid ADR``."""
    return F.coalesce(adr_bucket(adr), F.lit(S.INVALID_ADR))


def stay_length_category(nights="total_nights") -> Column:
    n = col(nights)
    labels = S.STAY_LENGTH_ORDER
    return (F.when(n == 0, labels[0]).when(n <= 2, labels[1]).when(n <= 5, labels[2])
            .when(n <= 10, labels[3]).otherwise(labels[4]))


def month_number(month="arrival_date_month") -> Column:
    """Month name to 1..12; unknown names and null give null."""
    m = col(month)
    expr = None
    for i, name in enumerate(S.MONTHS, start=1):
        expr = F.when(m == name, F.lit(i)) if expr is None else expr.when(m == name, F.lit(i))
    return expr


def season(month="arrival_date_month") -> Column:
    m = col(month)
    expr = None
    for name, months in S.SEASONS.items():
        expr = F.when(m.isin(months), name) if expr is None else expr.when(m.isin(months), name)
    return expr.otherwise(S.SEASON_DEFAULT)


def safe_ratio(num, den) -> Column:
    """``num / den`` when ``den > 0`` else 0 (never divides by zero)."""
    n, d = col(num), col(den)
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))


def reaches(p, threshold: float) -> Column:
    """``p >= threshold``, false for null and NaN (which Spark orders above every
    number): the one rule by which scores become decisions."""
    p = col(p)
    return F.coalesce(~F.isnan(p) & (p >= F.lit(threshold)), F.lit(False))


def risk_tier(p=S.PROBABILITY, threshold: float = S.DEFAULT_THRESHOLD,
              high: float = S.HIGH_RISK_CUTOFF) -> Column:
    """High / Medium / Low. NaN and null compare false, so they are Low, as
    in the scoring app (Spark would otherwise order NaN above every value)."""
    return (F.when(reaches(p, high), S.RISK_LABELS[0])
            .when(reaches(p, threshold), S.RISK_LABELS[1])
            .otherwise(S.RISK_LABELS[2]))


def format_currency(x) -> Column:
    """``€1,234.56``; negative values keep the sign after the symbol."""
    return F.concat(F.lit(S.CURRENCY_SYMBOL), F.format_number(col(x), 2))


def format_percent(x, digits: int = 1) -> Column:
    """``0.1234`` -> ``12.3%``."""
    return F.concat(F.format_number(col(x) * 100, digits), F.lit("%"))
