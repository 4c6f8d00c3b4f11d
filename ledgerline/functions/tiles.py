"""NTILE of several columns by their edges, without a sort, a shuffle or a write of the rows.

An edge is the last row of a tile in the order (value, key). A quantile sketch brackets each edge's value by ranks it
cannot miss by more than one part in ACCURACY; rows below the bracket are counted, equal values inside it are counted
one by one, and so the value at the edge is exact. Where rows of that value fall on both sides, the same is done once
more with their keys. All columns and edges share these passes, which are aggregations that collect a few numbers an edge;
a row's tile is then a comparison with the edges.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a sketch are at most rows / ACCURACY away.
ACCURACY = 10_000
LOW, HIGH = float("-inf"), float("inf")


class Edge(NamedTuple):
    """The last row of a tile: rows of this value up to key lie before the edge, all of them where key is None."""

    value: object
    key: int | None


class _Cut(NamedTuple):
    """A place, from 1, to be found among the values of the rows that the condition holds."""

    value: Column
    rows: Column
    among: int
    place: int


def _places(cuts: list[_Cut], df: DataFrame) -> list[tuple[object, int, int]]:
    """For each cut the value at its place, how many rows of that value come up to the place, and how many there are.
    Null is the smallest value."""
    number = [F.coalesce(c.value.cast("double"), F.lit(LOW)) for c in cuts]

    def bracket(c: _Cut, d: Column) -> Column:
        slack = 2 / ACCURACY + 2 / c.among
        shares = [max(0.0, c.place / c.among - slack), min(1.0, c.place / c.among + slack)]
        return F.percentile_approx(F.when(c.rows, d), F.array(*map(F.lit, shares)), ACCURACY)

    found = df.agg(*(bracket(c, d).alias(f"b{e}") for e, (c, d) in enumerate(zip(cuts, number)))).first()
    brackets = [tuple(b) for b in found]
    while True:
        lows = df.agg(*(F.count_if(c.rows & (d < low)).alias(f"n{e}") for e, (c, d, (low, _)) in enumerate(zip(cuts, number, brackets)))).first()
        inside = [c.rows & (d >= low) & (d <= high) for c, d, (low, high) in zip(cuts, number, brackets)]
        marked = F.filter(
            F.array(*(F.when(rows, F.struct(F.lit(e).alias("e"), c.value.alias("v"))) for e, (c, rows) in enumerate(zip(cuts, inside)))),
            lambda x: x.isNotNull(),
        )
        counts = df.select(F.explode(marked).alias("x")).groupBy("x.e", "x.v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("e").orderBy(F.col("v").asc_nulls_first()))
        target = F.element_at(F.array(*(F.lit(c.place - low).cast("long") for c, low in zip(cuts, lows))), F.col("e") + 1)
        hit = counts.withColumn("upto", upto).where((F.col("upto") >= target) & (F.col("upto") - F.col("n") < target))
        rows = {r["e"]: (r["v"], r["m"], r["n"]) for r in hit.select("e", "v", (target - F.col("upto") + F.col("n")).alias("m"), "n").collect()}
        missed = set(range(len(cuts))) - set(rows)
        if not missed:
            return [rows[e] for e in range(len(cuts))]
        # No sketch should miss; if one does, its edge is looked for among all values.
        brackets = [(LOW, HIGH) if e in missed else b for e, b in enumerate(brackets)]


def tile_edges(df: DataFrame, columns: dict[str, Column], key: str, tiles: int) -> dict[str, list[Edge]]:
    """The tiles - 1 edges of each of columns (name to value, in rising order, nulls first), ties by key, a whole number.

    The first rows % tiles tiles have one row more. No row, no edges.
    """
    source = df.select(F.col(key).cast("long").alias("k"), *(c.alias(f"v{i}") for i, c in enumerate(columns.values())))
    n = source.count()
    if not n:
        return {name: [] for name in columns}
    ends = [j * (n // tiles) + min(j, n % tiles) for j in range(1, tiles)]
    ends = [end for end in ends if 0 < end < n]
    cuts = [_Cut(F.col(f"v{i}"), F.lit(True), n, end) for i in range(len(columns)) for end in ends]
    found = _places(cuts, source) if cuts else []
    split = [e for e, (_, m, ties) in enumerate(found) if m < ties]
    keys: dict[int, int] = {}
    if split:
        same = lambda e: cuts[e].value.eqNullSafe(F.lit(found[e][0]))
        inner = _places([_Cut(F.col("k"), same(e), found[e][2], found[e][1]) for e in split], source)
        keys = {e: k for e, (k, _, _) in zip(split, inner)}
    edges = [Edge(v, keys.get(e)) for e, (v, _, _) in enumerate(found)]
    return {name: edges[i * len(ends) : (i + 1) * len(ends)] for i, name in enumerate(columns)}


def tile_of(value: Column, key: Column, edges: list[Edge]) -> Column:
    """The tile, from 1, of a row: one more than the edges it lies behind."""

    def behind(edge: Edge) -> Column:
        same = value.eqNullSafe(F.lit(edge.value)) & (key > edge.key) if edge.key is not None else F.lit(False)
        later = value.isNotNull() if edge.value is None else F.coalesce(value > F.lit(edge.value), F.lit(False))
        return F.when(later | same, 1).otherwise(0)

    return sum((behind(e) for e in edges), F.lit(1)).cast("bigint")


def with_tiles(df: DataFrame, columns: dict[str, Column], key: str, tiles: int) -> DataFrame:
    """df with NTILE(tiles) of each of columns, under its name. df is read several times: a table, or rows written before."""
    edges = tile_edges(df, columns, key, tiles)
    return df.select("*", *(tile_of(c, F.col(key).cast("long"), edges[name]).alias(name) for name, c in columns.items()))
