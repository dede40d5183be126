"""Places within groups, for groups of any size.

Rows are dealt to tasks by ranges of group and order, so a large group lies in many ranges, and sorted there. The table is written,
which numbers its rows; what a range holds of a group is one row of a summary, and sums over the summary, in order of ranges,
say how much of the group lies before. No task sorts or holds a whole group, and no row is ranked by a window over one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def placed(frame: DataFrame, by: list[str], order: list[Column], place: str = "place", size: str | None = None, before: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``frame`` with ``place``, from 1 in ``order`` within ``by``; ``size``, the group's number of rows; ``before``, sums over the group's rows that come earlier; ``sums``, those over all its rows.

    ``order`` must tell rows apart, or the places of equal rows are any of theirs. Nulls of ``by`` are a group; those of a summed column count as 0.
    """
    before, sums = before or {}, sums or {}
    whole = {**{f"_w_{n}": c for n, c in before.items()}, **{f"_s_{n}": c for n, c in sums.items()}}
    keys = [F.asc(c) for c in by]
    dealt = frame.withColumns({n: F.coalesce(c, F.lit(0)) for n, c in whole.items()}).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright("_at", 33)).withColumn("_g", F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_0")))
    held = laid.groupBy("_range", "_g").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in whole])
    # over the summary, of a row for each range of a group
    group, earlier = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = held.select(
        F.col("_range").alias("_r"),
        F.col("_g").alias("_h"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"),
        *([F.sum("_n").over(group).alias(size)] if size else []),
        *[F.coalesce(F.sum(f"_w_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in before],
        *[F.sum(f"_s_{n}").over(group).alias(n) for n in sums],
    )
    found = laid.join(heads, (F.col("_range") == F.col("_r")) & F.col("_g").eqNullSafe(F.col("_h")))
    inside = Window.partitionBy("_range", "_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # of one range
    more = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) for n in before}
    return found.select(*frame.columns, (F.col("_ahead") + F.col("_at") - F.col("_first") + 1).alias(place), *([size] if size else []), *[c.alias(n) for n, c in more.items()], *sums)
