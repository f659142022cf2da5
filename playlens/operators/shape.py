"""Reshaping of aggregated tables.

Inputs here are results, one row per country, day or level, so the windows
without a partition work on a table whose size does not follow the event log.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions import ratio
from playlens.model import LABEL


def pivot_labels(
    df: DataFrame,
    key: str,
    columns: Mapping[str, str],
    value: Column | None = None,
    how: Callable[[Column], Column] = F.sum,
    label: str = LABEL,
) -> DataFrame:
    """One row per key and one column per label, ``columns`` naming them.

    Counts rows unless a value is given.  A key without a label has NULL there;
    rows of other labels only make sure that their key appears.
    """
    value = F.lit(1) if value is None else value
    return df.groupBy(key).agg(
        *(how(F.when(F.col(label) == name, value)).alias(out) for name, out in columns.items())
    )


def share_of_total(df: DataFrame, columns: Mapping[str, str], scale: float = 100) -> DataFrame:
    """Adds each column's share of its own sum, under the mapped name."""
    return df.withColumns(
        {
            out: ratio(F.col(column), F.sum(column).over(Window.partitionBy()), scale)
            for column, out in columns.items()
        }
    )


def with_baseline(
    df: DataFrame, key: str, at: int, columns: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Adds the value each column has at ``key = at``, NULL when that row is missing."""
    group = Window.partitionBy(*by)
    return df.withColumns(
        {
            out: F.max(F.when(F.col(key) == at, F.col(column))).over(group)
            for column, out in columns.items()
        }
    )


def centered_mean(
    df: DataFrame, columns: Mapping[str, str], order: str, size: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Adds the mean over ``size`` rows around each row; NULL unless all have a value."""
    reach = size // 2
    around = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, size - 1 - reach)
    return df.withColumns(
        {
            out: F.when(F.count(column).over(around) == size, F.avg(column).over(around))
            for column, out in columns.items()
        }
    )


def cumulative_distribution(
    df: DataFrame, order: str, count: str, half_even: bool = False
) -> DataFrame:
    """Adds the running count up to each value and its percentage of the total, to two places.

    A percentage half way between two, as a double, is rounded up, or to the even one if ``half_even``.
    """
    so_far = F.sum(count).over(
        Window.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.sum(count).over(Window.partitionBy())
    percent = F.try_divide(F.lit(100.0) * so_far, total)
    rounded = F.rint(percent * 100) / 100 if half_even else F.round(percent, 2)
    return df.withColumns({"accumulate": so_far, "pct_accumulate": rounded})


def merge_by_level(left: DataFrame, right: DataFrame, key: str = "level") -> DataFrame:
    """Both tables side by side; what one of them lacks becomes 0."""
    return left.join(right, key, "full_outer").na.fill(0)
