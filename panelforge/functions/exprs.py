"""Column-expression builders (JVM-side, codegen friendly).

All statistics guard the ANSI-mode failure cases (division by zero,
constant columns) by returning NULL where pandas would give NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "safe_div", "adjusted_skew", "safe_corr", "r2_from_moments",
    "regression_metrics", "nan_to_null", "year_to_date", "slugify",
    "severity_bucket", "cluster_label",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col_(num), col_(den))


def nan_to_null(c) -> Column:
    """pandas NaN means missing; Spark aggregates skip NULL but not NaN."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def adjusted_skew(c) -> Column:
    """pandas' adjusted Fisher-Pearson skewness G1 = g1 * sqrt(n(n-1))/(n-2).

    Spark's ``skewness`` is the population g1; the factor closes the gap.
    NULL for n < 3 or a constant column (pandas gives NaN / 0).
    """
    c = col_(c)
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def safe_corr(a, b) -> Column:
    """Pearson correlation on pairwise-complete rows; NULL if either side
    is constant (Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI)."""
    a, b = col_(a), col_(b)
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a)
    y = F.when(both, b)
    sx = F.stddev_pop(x)
    sy = F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy))


def r2_from_moments(sse: Column, sst: Column, n: Column) -> Column:
    """sklearn's r2_score: 1 - SSE/SST; with constant actuals 1.0 if the
    fit is perfect else 0.0; NULL for fewer than two rows."""
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(1 - sse / sst))


def regression_metrics(actual: str, predicted: str, dp: int | None = 4) -> list[Column]:
    """[n, rmse, mae, r2] aggregate expressions over (actual, predicted).

    SST is computed as ``var_pop(y) * n`` (one pass, no self-join)."""
    e = F.col(actual) - F.col(predicted)
    n = F.count(e)
    sse = F.sum(e * e)
    sst = F.var_pop(F.when(e.isNotNull(), F.col(actual))) * n
    rmse = F.sqrt(sse / n)
    mae = F.avg(F.abs(e))
    r2 = r2_from_moments(sse, sst, n)
    if dp is not None:
        rmse, mae, r2 = F.round(rmse, dp), F.round(mae, dp), F.round(r2, dp)
    return [n.alias("N"), rmse.alias("RMSE"), mae.alias("MAE"), r2.alias("R2")]


def year_to_date(c) -> Column:
    """int year -> DATE of Jan 1st (pd.to_datetime(year, format='%Y'))."""
    return F.make_date(col_(c).cast("int"), F.lit(1), F.lit(1))


def slugify(c) -> Column:
    """lower-case, non-alphanumerics -> '_' (file-name slug)."""
    return F.regexp_replace(F.lower(col_(c)), r"[^a-z0-9]+", "_")


# VIF severity thresholds (>10 high, >5 moderate).
VIF_HIGH = 10.0
VIF_MODERATE = 5.0


def severity_bucket(c) -> Column:
    c = col_(c)
    return (F.when(c > VIF_HIGH, "red").when(c > VIF_MODERATE, "orange")
            .otherwise("green"))


def cluster_label(c) -> Column:
    return F.format_string("Cluster %d", col_(c).cast("int"))
