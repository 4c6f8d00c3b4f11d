"""Sets of whole numbers as words of 64 bits each: exact, merged by OR, counted by their bits, small where keys are dense.

A word is one long in a hash aggregation, so many members of a set are one row before anything is shuffled; at worst, where
keys are scattered, there is a row for each member.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.columns import col

#: Sets of so many words (16 bytes each) are broadcast; dense keys up to 64 times as many have no more.
WORDS = 1_000_000
WORD, BITS = "__word", "__bits"
#: Rows that hold one of so many combinations of values are broadcast as codes of their keys.
KINDS = 1 << 15


def word(c: str | Column) -> Column:
    """The number of the word that holds c; null for null."""
    return F.shiftright(col(c).cast("long"), 6)


def bit(c: str | Column) -> Column:
    """c's bit in its word."""
    place = col(c).cast("long").bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def with_members(rows: DataFrame, keys: Sequence[str], member: str, **sums: Column) -> DataFrame:
    """For each of keys (in groups, null a key like others) the set of member as rows (WORD, BITS), and sums (aggregates
    that add up) over the rows of each word. Rows whose member is null have a word null without bits."""
    return rows.groupBy(*keys, word(member).alias(WORD)).agg(F.bit_or(bit(member)).alias(BITS), *(x.alias(name) for name, x in sums.items()))


def rolled_up(sets: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """sets (of with_members) by fewer keys: members of the finer sets are united, sums are added."""
    return sets.groupBy(*keys, WORD).agg(F.bit_or(BITS).alias(BITS), *(F.sum(name).alias(name) for name in sums))


def counted(sets: DataFrame, keys: Sequence[str], name: str, sums: Sequence[str] = ()) -> DataFrame:
    """keys, the number of members under name, and the sums. sets hold each word once for the same keys."""
    members = F.coalesce(F.sum(F.bit_count(BITS)), F.lit(0)).cast("long").alias(name)
    return sets.groupBy(*keys).agg(members, *(F.sum(s).alias(s) for s in sums))


def distinct(rows: DataFrame, keys: Sequence[str], member: str, name: str, **sums: Column) -> DataFrame:
    """keys, the number of distinct values of member, a whole number, under name, and sums: one pass over rows."""
    return counted(with_members(rows, keys, member, **sums), keys, name, list(sums))


def key_set(df: DataFrame, key: str) -> DataFrame | None:
    """The keys of df as (WORD, BITS) if they are at most WORDS words, which are counted first; else None."""
    words = with_members(df.where(F.col(key).isNotNull()), [], key)
    found = words.limit(WORDS + 1).count()
    return words if found <= WORDS else None


def with_lost(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """rows with name: whether key is none of keys (of key_set, and broadcast); false where key is null. No row moves."""
    named = F.broadcast(keys.select(F.col(WORD).alias("__of"), F.col(BITS).alias("__has")))
    there = F.coalesce(F.col("__has").bitwiseAND(bit(key)) != 0, F.lit(False))
    joined = rows.join(named, word(key) == F.col("__of"), "left")
    return joined.withColumn(name, F.col(key).isNotNull() & ~there).drop("__of", "__has")


def few_values(df: DataFrame, c: str, most: int = 64) -> list | None:
    """The values of c but null, in order, if they are at most so many; else None."""
    values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect()]
    return sorted(values) if len(values) <= most else None


def value_bit(values: list, c: str) -> Column:
    """The bit in a long of c's place in values, of which there are at most 64; null for others."""
    one = F.lit(None).cast("long")
    for i, v in enumerate(values):
        one = F.when(F.col(c) == F.lit(v), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(one)
    return one


def bits_set(bits: Column) -> Column:
    """How many bits are set, 0 for null."""
    return F.coalesce(F.bit_count(bits).cast("long"), F.lit(0).cast("long"))


def few_distinct(df: DataFrame, c: str, condition: Column) -> Column:
    """An aggregate: the number of distinct values of c where condition holds. Up to 64 values that df has are bits of one long,
    so rows merge before they move; beyond that each value of a group moves."""
    values = few_values(df, c)
    if values is None:
        return F.count_distinct(F.when(condition, F.col(c)))
    return bits_set(F.bit_or(F.when(condition, value_bit(values, c))))


def unique_key_set(df: DataFrame, key: str) -> DataFrame | None:
    """key_set, but None too where a key repeats, so that rows which have their key in it are those of a join."""
    words = with_members(df.where(F.col(key).isNotNull()), [], key, __n=F.count(F.lit(1)))
    found = words.agg(F.count(F.lit(1)).alias("words"), F.sum("__n").alias("rows"), F.sum(F.bit_count(BITS)).alias("keys")).first()
    return words.drop("__n") if found.words <= WORDS and found.rows == found.keys else None


def with_values(rows: DataFrame, key: str, table: DataFrame, values: Sequence[str]) -> DataFrame:
    """rows joined with table, which has the same key, for its values. Where the values have few combinations and the keys are
    unique, the combinations are numbered, and each bit of a key's number is in a set of its own; the sets are broadcast,
    with at most WORDS words in all (so 7 million dense keys with 150 combinations are 8 MB), and no row moves. Elsewhere a join."""
    kinds = table.select(*values).distinct().limit(KINDS + 1).collect()
    planes = max(1, len(kinds).bit_length())
    keyed = table.where(F.col(key).isNotNull())
    words = with_members(keyed, [], key, __n=F.count(F.lit(1)))
    found = words.agg(F.count(F.lit(1)).alias("words"), F.sum("__n").alias("rows"), F.sum(F.bit_count(BITS)).alias("keys")).first()
    if not kinds or len(kinds) > KINDS or found.words * planes > WORDS or found.rows != found.keys:
        return rows.join(table, key)
    of = [f"__of{i}" for i in range(len(values))]
    numbered = table.sparkSession.createDataFrame(
        [(i, *kind) for i, kind in enumerate(kinds, 1)],
        T.StructType([T.StructField("__code", T.LongType()), *(T.StructField(o, table.schema[v].dataType) for o, v in zip(of, values))]),
    )
    same = reduce(Column.__and__, (F.col(v).eqNullSafe(F.col(o)) for v, o in zip(values, of)))
    coded = keyed.join(F.broadcast(numbered), same).select(word(key).alias("__of"), bit(key).alias("__bit"), "__code")
    one = F.lit(1).cast("long")
    sets = coded.groupBy("__of").agg(*(
        F.coalesce(F.bit_or(F.when(F.shiftright("__code", i).bitwiseAND(one) == 1, F.col("__bit"))), F.lit(0)).cast("long").alias(f"__plane{i}")
        for i in range(planes)
    ))
    code = sum((F.when(F.col(f"__plane{i}").bitwiseAND(bit(key)) != 0, 1 << i).otherwise(0) for i in range(planes)), F.lit(0)).cast("long")
    marked = rows.join(F.broadcast(sets), word(key) == F.col("__of")).withColumn("__code", code)
    named = numbered.select("__code", *(F.col(o).alias(v) for o, v in zip(of, values)))
    return marked.join(F.broadcast(named), "__code").drop("__code", "__of", *(f"__plane{i}" for i in range(planes)))
