"""What stands before a row in an order, where one key may hold a third of all rows.

A window by such a key would sort all its rows in one task. Here each key's order is cut into buckets: a window inside each
bucket, one row a bucket for what it hands on, a window over those, and a join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a bucket.
WIDTH = 1 << 16


def bucket(order: str) -> Column:
    return F.floor(F.col(order) / WIDTH)


def before(rows: DataFrame, by: list[str], buckets: list[str], order: list[str], last: dict[str, Column], count: str | None = None, next_: bool = False) -> DataFrame:
    """``rows`` with, for each name of ``last``, its last value that is not null among the rows before (after, where
    ``next_``) in the same ``by``, and with the number of rows before as ``count``.

    ``buckets`` are columns that rise with ``order``. Null keys are a key of their own.
    """
    turn = (lambda c: F.desc(c)) if next_ else (lambda c: F.asc(c))
    inner = Window.partitionBy(*by, *buckets).orderBy(*map(turn, order))
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy(*map(turn, buckets)).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, *buckets]
    place = F.struct(*order)
    pick = F.min_by if next_ else F.max_by
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[pick(v, F.when(v.isNotNull(), place)).alias(f"__{k}") for k, v in last.items()])
    handed = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__c"), *[F.last(f"__{k}", ignorenulls=True).over(outer).alias(f"__{k}") for k in last])
    own = rows.withColumns({f"__own_{k}": F.last(v, ignorenulls=True).over(earlier) for k, v in last.items()} | {"__place": F.row_number().over(inner) - 1})
    same = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        same = test if same is None else same & test
    out = own.join(handed, same, "left")
    values = {k: F.coalesce(F.col(f"__own_{k}"), F.col(f"__{k}")) for k in last} | ({count: F.col("__c") + F.col("__place")} if count else {})
    return out.select(*rows.columns, *[v.alias(k) for k, v in values.items()])
