"""Running sums and positions over ordered rows, whatever share of the rows one group holds.

Rows are cut into segments along their order. Sums inside a segment come from a window over that segment alone, sums of
whole segments from a small table with one row per group and segment; a join carries the latter to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regulith.session import materialise, scratch_path

SEGMENT = "_segment"


def range_segments(df: DataFrame, *order: Column, label: str = "segments", parts: int | None = None) -> DataFrame:
    """The table written once in slices of about equal row counts along ``order``, with the number of each row's slice.

    Spark's range sketch picks the borders; they are drawn anew in each run of a plan, hence the write. Rows equal in all
    of ``order`` share a slice, so let it end in a column that tells rows apart.
    """
    cut = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialise(cut.withColumn(SEGMENT, F.spark_partition_id()), label)


def running_sums(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], segment: str = SEGMENT) -> DataFrame:
    """For each name the sum of its value over the earlier rows of the group (0 for the first).

    ``segment`` is a column that never falls along the order, such as the slice of ``range_segments`` or a prefix of the
    first order column; it and the group must not be null. ``df`` is read twice.
    """
    earlier = W.partitionBy(*group).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*group, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = df.groupBy(*group, segment).agg(*(F.sum(value).alias(f"_in_{name}") for name, value in values.items()))
    sums = sums.select(*group, segment, *(none(F.sum(f"_in_{name}").over(earlier)).alias(f"_before_{name}") for name in values))
    rows = df.select("*", *(none(F.sum(value).over(inside)).alias(name) for name, value in values.items()))
    # Rows are partitioned and sorted by the keys already; the planner's guess of a size behind explode is no ground to broadcast.
    joined = rows.join(sums.hint("merge"), [*group, segment])
    return joined.select(*df.columns, *((F.col(name) + F.col(f"_before_{name}")).alias(name) for name in values))


def positions(df: DataFrame, *order: Column, name: str = "position", label: str = "positions") -> DataFrame:
    """Rows with their place (from 1) in the whole table's order, from the counts of sorted range partitions."""
    cut = range_segments(df, *order, label=label)
    place = running_sums(cut, [], list(order), {name: F.lit(1)})
    return place.withColumn(name, F.col(name) + 1).drop(SEGMENT)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, label: str = "page") -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of the table's order, with their ``position``.

    Counts of the slices tell which of them the page touches; only those are read and numbered, so what moves is the page,
    however far it lies. The counts, one row a slice, reach the driver.
    """
    path = scratch_path(df.sparkSession, label)
    cut = df.repartitionByRange(*order).withColumn(SEGMENT, F.spark_partition_id())
    cut.write.partitionBy(SEGMENT).parquet(path)
    cut = df.sparkSession.read.schema(cut.schema).parquet(path)
    before, touched = 0, {}
    for segment, n in sorted(cut.groupBy(SEGMENT).count().collect()):
        if before < offset + limit and before + n > offset:
            touched[segment] = before
        before += n
    held = cut.filter(F.col(SEGMENT).isin(list(touched)))
    start = F.create_map(*(F.lit(x) for pair in touched.items() for x in pair)) if touched else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(W.partitionBy(SEGMENT).orderBy(*order)) + F.element_at(start, F.col(SEGMENT))
    return held.withColumn("position", place).filter(f"position > {offset} and position <= {offset + limit}").drop(SEGMENT).orderBy("position")


def group_key(by: list[str]) -> Column:
    """One column that tells groups apart, also where some of their columns are null."""
    return F.struct(*by) if by else F.lit(0)


def quantiles(df: DataFrame, value: str, by: list[str], probs: tuple[float, ...]) -> DataFrame:
    """by, n and q0, q1, ...: exact quantiles with linear interpolation of the non-null values, one row a group.

    Values are counted, the distinct ones cut into slices of the order (group, value), and the counts below each summed up.
    A rank lies at the value whose counts span it, so each quantile is picked by a filter and a partial aggregate: no task
    holds the values of a group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(group_key(by).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cut = range_segments(counted, F.col("_g"), F.col("_v"), label="quantiles")
    ranked = running_sums(cut, ["_g"], [F.col("_v")], {"_below": F.col("_n")})
    sizes = cut.groupBy("_g").agg(F.sum("_n").alias("n"))
    rows = ranked.join(sizes, "_g")
    at = lambda rank: F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_v")))
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p))
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    found = rows.groupBy("_g", "n").agg(*picks)
    out = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        mixed = (high - place) * F.col(f"_lo{i}") + (place - low) * F.col(f"_hi{i}")
        out.append(F.when(low == high, F.col(f"_lo{i}").cast("double")).otherwise(mixed).alias(f"q{i}"))
    return found.select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", *out)
