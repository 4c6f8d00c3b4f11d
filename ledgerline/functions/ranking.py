"""Global positions, tiles, percentile ranks and percentiles without a task that sees all rows.

For positions, rows are dealt into ranges of the order, which are written to the shared folder when the plan is made: both
passes over them must see the same ranges. Percentiles need neither ranges nor a write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.storage import materialise

#: Ranks of a quantile sketch are at most values / ACCURACY away.
ACCURACY = 2_000
#: Brackets of so many groups are broadcast.
GROUPS = 10_000


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the place, from 1, of every row in the global order; order must end in a key.

    Rows are dealt into ranges of the order and written with their range's number, so the ranges stay the same for
    both passes; a row's place is its place in the range after all earlier ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = (
        ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("__range").orderBy(*order)
    return (
        ranged.withColumn("__place", F.row_number().over(within))
        .join(F.broadcast(starts), "__range")
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__range", "__place", "__start")
    )


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """NTILE from a position (from 1) among rows: the first rows % tiles tiles have one row more."""
    small = F.floor(rows / tiles)
    more = rows % tiles
    edge = more * (small + 1)
    return F.when(position <= edge, F.ceil(position / (small + 1))).otherwise(
        more + F.ceil((position - edge) / F.greatest(small, F.lit(1)))
    ).cast("bigint")


def with_tile(df: DataFrame, order: list[Column], tiles: int, name: str) -> DataFrame:
    """df with NTILE(tiles) over the global order; order must end in a key."""
    placed = with_position(df, order, "__position")
    rows = placed.agg(F.count(F.lit(1)).alias("__rows"))
    return (
        placed.crossJoin(F.broadcast(rows))  # one row
        .withColumn(name, tile(F.col("__position"), F.col("__rows"), tiles))
        .drop("__position", "__rows")
    )


def with_percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average-tie percentile rank of value: (first place + (ties - 1) / 2) / rows; null for nulls."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = with_position_weighted(counts, value).select(
        value, ((F.col("__before") + 1 + (F.col("__n") - 1) / 2.0) / F.col("__total")).cast("double").alias(name)
    )
    return df.join(ranks, value, "left")


def with_position_weighted(counts: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """counts (value, __n and, if named, group) with __before, the sum of __n over all smaller values, and __total, the
    sum over all values; both within the group, if named. A null group is a group."""
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group] if group else []
    ranged = materialise(
        counts.repartitionByRange(ranges, *keys, value).withColumn("__range", F.spark_partition_id()), "ranges"
    )
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside_group = Window.partitionBy(*keys)
    # A row for each range, and one more for each group that begins within a range.
    starts = ranged.groupBy("__range", *keys).agg(F.sum("__n").alias("__n")).select(
        F.col("__range").alias("__of"), *(F.col(k).alias("__group") for k in keys),
        before(inside_group.orderBy("__range")).alias("__start"), F.sum("__n").over(inside_group).alias("__total"),
    )
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col("__group"))
    return (
        ranged.withColumn("__inside", before(Window.partitionBy("__range", *keys).orderBy(value)))
        .join(starts, same)
        .withColumn("__before", F.col("__start") + F.col("__inside"))
        .drop("__of", "__group", "__start", "__inside", "__range")
    )


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], group: str | None = None) -> DataFrame:
    """Exact percentiles of value, a double, interpolated between neighbours: a column for each of shares (name, share from
    0 to 1), in one row or, with group, in a row for each group, null for a group without values. NaN is no value.

    df is read twice. Quantile sketches, one a group, bracket each place by ranks they cannot miss by more than one part in
    ACCURACY. Then rows are counted: those below a bracket together, those inside it by value. So what is shuffled are
    sketches and some thousandths of the values, and nothing is written. Groups meet their brackets by broadcast up to
    GROUPS groups, else in a join. A sketch that broke its bound would be an error, never a wrong value.
    """
    keys = [group] if group else []
    at_group = [F.col("__group")] if group else []
    known = df.select(*(F.col(k).alias("__group") for k in keys), F.when(~F.isnan(value), value).alias("__value"))
    slack = 4 / ACCURACY
    edges = [(max(0.0, p - slack), min(1.0, p + slack)) for p in map(float, shares.values())]
    sketch = F.percentile_approx("__value", F.array(*(F.lit(x) for edge in edges for x in edge)), F.lit(ACCURACY))
    marks = known.groupBy(*at_group).agg(F.count("__value").alias("__total"), sketch.alias("__marks"))
    if group:
        few = marks.limit(GROUPS + 1).collect()
        if len(few) <= GROUPS:
            marks = F.broadcast(df.sparkSession.createDataFrame(few, marks.schema))
        named = marks.select(F.col("__group").alias("__of"), "__total", "__marks")
        marked = known.join(named, F.col("__group").eqNullSafe(F.col("__of")))
    else:
        marked = known.crossJoin(F.broadcast(marks))  # one row

    def side(e: int) -> Column:
        """0 below the bracket, 1 inside, 2 above. A few values need no bracket."""
        low, high = edges[e]
        whole, v = F.col("__total") <= ACCURACY, F.col("__value")
        below = F.lit(low > 0) & ~whole & (v < F.col("__marks")[2 * e])
        above = F.lit(high < 1) & ~whole & (v > F.col("__marks")[2 * e + 1])
        return F.when(below, 0).when(above, 2).otherwise(1)

    sides = [side(e) for e in range(len(edges))]
    inside = reduce(Column.__or__, (x == 1 for x in sides))
    code = sum((x * 3**e for e, x in enumerate(sides)), F.lit(0)).cast("long")
    counts = marked.select(
        *at_group, "__total", F.when(F.col("__value").isNotNull(), code).alias("__code"), F.when(inside, F.col("__value")).alias("__v")
    ).groupBy(*at_group, "__total", "__code", "__v").agg(F.count(F.lit(1)).alias("__n"))
    digit = [F.floor(F.col("__code") / 3**e) % 3 for e in range(len(edges))]
    parts = F.array(*(
        F.when(d < 2, F.struct(F.lit(e).alias("e"), F.when(d == 1, F.col("__v")).alias("v"))) for e, d in enumerate(digit)
    ))
    # A group without values stays, without a place.
    by_place = counts.select(*at_group, "__total", "__n", F.explode_outer(F.filter(parts, lambda x: x.isNotNull())).alias("x"))
    by_value = by_place.groupBy(*at_group, "__total", "x.e", "x.v").agg(F.sum("__n").alias("__n"))
    # What lies below the bracket has no value and comes first.
    upto = F.sum("__n").over(Window.partitionBy(*at_group, "e").orderBy(F.col("v").asc_nulls_first()))
    summed = by_value.withColumn("__upto", upto)

    def found(e: int, share: float) -> list[Column]:
        place = (F.col("__total") - 1) * F.lit(float(share))
        hit = lambda p: (F.col("e") == e) & (F.col("__upto") - F.col("__n") <= p) & (p < F.col("__upto"))
        return [F.max(F.when(F.col("__total") > 0, place)), *(F.max(F.when(hit(p), F.col("v"))) for p in (F.floor(place), F.ceil(place)))]

    three = [(name, found(e, share)) for e, (name, share) in enumerate(shares.items())]
    ends = summed.groupBy(*at_group).agg(*(x.alias(f"{name}__{i}") for name, xs in three for i, x in enumerate(xs)))

    def between(name: str) -> Column:
        place, low, high = (F.col(f"{name}__{i}") for i in range(3))
        inside = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        missed = F.raise_error(F.lit(f"no value at the place of {name}: a sketch missed it")).cast("double")
        return F.when(place.isNull(), None).when(low.isNull() | high.isNull(), missed).when(low == high, low).otherwise(inside).alias(name)

    return ends.select(*(F.col("__group").alias(k) for k in keys), *(between(name) for name in shares))
