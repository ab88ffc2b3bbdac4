"""Connected components and group leaders on narrow tables, without hot keys in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm.storage import forget, saved

SALTS = 64


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of an edge (a, b): the least id reachable.

    Alternating large-star and small-star steps: every step replaces the edges by
    as many or fewer that point to smaller ids, until all point to their
    component's least id.  Minima combine map-side, and the edges of an id with very
    many meet its minimum in salted pieces; each step is saved, so a lost
    executor never replays earlier ones, and takes the place of the step before it.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = None
    while True:
        # a step that changes nothing ends the work: the edges are compared by number and hash sum
        stats = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if not stats[0] or stats == mark:
            break
        mark = stats
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = with_totals(both, ["u"], "v", m=(F.min, F.col("v"))).withColumn("m", F.least("u", "m"))
        # every edge is kept by its higher end, so no edge is made twice
        large = saved(least.where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = with_totals(large, ["hi"], "lo", m=(F.min, F.col("lo")))
        small = lowest.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        before, now = now, saved(small.select("e.hi", "e.lo").where("hi <> lo").distinct())
        forget(before, large)
    members = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return members.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def salted(df: DataFrame, value: str) -> DataFrame:
    """`df` with a salt that spreads the rows of one key over SALTS groups (a hash: the same on every retry)."""
    return df.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))


def with_totals(df: DataFrame, keys: list[str], value: str, **totals) -> DataFrame:
    """`df` with totals over all rows of its keys: name=(F.min, F.max or F.sum, column).

    A key's rows are combined, and meet their totals, in SALTS pieces by a hash of `value`.
    """
    rows = salted(df, value)
    part = rows.groupBy(*keys, "salt").agg(*[fn(c).alias(name) for name, (fn, c) in totals.items()])
    whole = part.groupBy(*keys).agg(*[fn(name).alias(name) for name, (fn, _) in totals.items()])
    return rows.join(part.select(*keys, "salt").join(whole, keys), [*keys, "salt"]).drop("salt")


def leaders(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, salt, leader, size): the least `value` and the number of rows of every key, per salt.

    Join it to `salted(df)` on keys and salt: a key with very many rows meets it in
    SALTS pieces, and no group here has more than SALTS rows of one key.
    """
    part = salted(df, value).groupBy(*keys, "salt").agg(F.min(value).alias("least"), F.count("*").alias("n"))
    whole = part.groupBy(*keys).agg(F.min("least").alias("leader"), F.sum("n").alias("size"))
    return part.select(*keys, "salt").join(whole, keys)
