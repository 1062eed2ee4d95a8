"""Running totals whose windows stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, amount: Column, cell: Column, order: list[Column], span: list[Column] = []) -> DataFrame:  # noqa: B006
    """rows with `before`: the sum of amount over the earlier rows of the same span.

    The order must go along with the cells.  Rows are added up within a cell and cells over each other, so a window holds
    the rows of one cell, or one row for each cell of a span; no task sorts a whole span.
    """
    keyed = rows.withColumns({"_cell": cell, "_amount": amount, **{f"_span{k}": c for k, c in enumerate(span)}})
    spans = [f"_span{k}" for k in range(len(span))]
    totals = keyed.groupBy(*spans, "_cell").agg(F.sum("_amount").alias("_sum"))
    over = Window.partitionBy(*spans).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(s).alias(f"{s}t") for s in spans], F.col("_cell").alias("_cellt"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*spans, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_own", F.coalesce(F.sum("_amount").over(own), F.lit(0)))
    same = keyed["_cell"].eqNullSafe(totals["_cellt"])
    for s in spans:
        same = same & keyed[s].eqNullSafe(totals[f"{s}t"])
    return keyed.join(totals, same).withColumn("before", F.col("_base") + F.col("_own")).select(*rows.columns, "before")
