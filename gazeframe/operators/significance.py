"""Exact McNemar tests for all pairs of systems, and Holm's adjustment.

Items are grouped by which systems got them right: 2^K patterns at most, however many items. Pairs of systems are
formed from the patterns, never from items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discordant(rows: DataFrame) -> DataFrame:
    """(system_a, system_b, b, c) from (system, item_id, truth, label): b items only a has right, c only b has right.

    Items that either system misses don't count for that pair.
    """
    hit = F.struct("system", (F.col("label") == F.col("truth")).alias("ok"))
    known = rows.where("label is not null and truth is not null")
    patterns = known.groupBy("item_id").agg(F.array_sort(F.collect_list(hit)).alias("hits")).groupBy("hits").agg(F.count(F.lit(1)).alias("n"))
    one = patterns.select("n", "hits", F.posexplode("hits").alias("i", "a"))
    two = one.select("n", "a", F.explode(F.slice("hits", F.col("i") + 2, F.size("hits"))).alias("b"))
    only = lambda x, y: F.sum(F.when(F.col(f"{x}.ok") & ~F.col(f"{y}.ok"), F.col("n")).otherwise(0))
    return two.groupBy(F.col("a.system").alias("system_a"), F.col("b.system").alias("system_b")).agg(only("a", "b").alias("b"), only("b", "a").alias("c"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts; 1 if there are none. Terms are summed in logarithms."""
    m, size = F.least(b, c), b + c
    start = F.struct((-size * F.lit(0.6931471805599453)).alias("term"), F.lit(0.0).alias("total"))

    def step(state: Column, k: Column) -> Column:
        term = F.when(k == 0, state.term).otherwise(state.term + F.log((size - k + 1) / k))
        return F.struct(term.alias("term"), (state.total + F.exp(term)).alias("total"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), m), start, step, lambda s: s.total)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))


def mcnemar_pairs(rows: DataFrame) -> DataFrame:
    return discordant(rows).withColumn("p", mcnemar(F.col("b").cast("long"), F.col("c").cast("long")))


def holm(tests: DataFrame, keys: list[str], family: list[str] | None = None, p: str = "p") -> DataFrame:
    """Adds ``p_holm``: step-down adjusted over each family (all rows if none). A table of tests is small: K(K-1)/2 rows."""
    part = Window.partitionBy(*(family or [F.lit(0)]))
    by_p = part.orderBy(p, *keys)
    raw = (F.count(F.lit(1)).over(part) - F.row_number().over(by_p) + 1) * F.col(p)
    running = F.max("_raw").over(by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tests.withColumn("_raw", raw).withColumn("p_holm", F.least(F.lit(1.0), running)).drop("_raw")
