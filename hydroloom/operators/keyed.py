"""Group results handed back to rows, and ordered computations that never gather a whole key.

A window over a zone puts the zone in one task. `with_group` aggregates instead (partial sums are
made before the shuffle) and joins the one-row-per-key result back: AQE broadcasts it when its
measured size allows and otherwise splits the skewed partitions of the join. `running_by_block`,
`lag_by_block` and `row_index_by_block` work in two levels: inside blocks of the order column
(a year, say), and over the small table of block totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.session import cut_lineage

# Largest lookup side to broadcast, in bytes; the session setting of this name overrides it.
LOOKUP_SETTING, LOOKUP_BYTES = "spark.hydroloom.lookupBytes", 256 * 1024**2

# Rows a task should hold when a table is dealt over tasks.
TASK_ROWS = 1_000_000

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def lookup(df: DataFrame, table: DataFrame, keys: list[str], columns: list[str], rows: int | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join of a long table with a per-key table that is broadcast only after its rows were counted.

    A grid's attributes or a network's observations are small next to the series they describe:
    sent to the executors, they spare a shuffle of the series. Beyond the limit both sides are
    shuffled. `rows` gives a known bound, so that `table` need not be counted.
    """
    side = table.select(*keys, *columns)
    limit = int(df.sparkSession.conf.get(LOOKUP_SETTING, str(LOOKUP_BYTES)))
    # A hashed row costs about 16 bytes besides its fields; text counts as 32 bytes.
    width = 16 + sum(32 if kind == "string" else 8 for _, kind in side.dtypes)
    n = side.count() if rows is None else rows
    # Without a hint an estimate that is too low could still broadcast the longer table.
    return df.join(F.broadcast(side) if n * width <= limit else side.hint("merge"), keys, how)


def tasks_for(rows: int) -> int:
    """Tasks that hold `rows` at TASK_ROWS each."""
    return max(1, -(-rows // TASK_ROWS))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df`, written once, and its number of rows."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")), "dealt")
    return table, seen.get["rows"]


def dealt(df: DataFrame, keys: list[str], growth: int = 1) -> DataFrame:
    """`df`, written and counted once, dealt by `keys` over tasks of bounded size when each row becomes `growth` rows later on.

    Adaptive execution merges small partitions by their bytes and does not see that rows multiply behind the shuffle; a
    given number of tasks stays.
    """
    table, rows = counted(df)
    return table.repartition(tasks_for(rows * growth), *keys)


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Every row of `df` with the aggregates of its key group; NULL keys form a group."""
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return attach(df, grouped, keys)


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a one-row-per-key table by null-safe equality, keeping each key once."""
    names = [c for c in per_key.columns if c not in keys]
    right = per_key.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(right, same, how).drop(*[f"_k_{k}" for k in keys])


def running_by_block(
    df: DataFrame, keys: list[str], order: str, block: Column, outputs: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Cumulative sum / max / min / count over `keys` in `order`, current row included.

    `block` must not decrease along `order`; only one block of a key is ever in one task.
    """
    tagged = df.withColumn("_block", block)
    totals = tagged.groupBy(*keys, "_block").agg(*[_FOLD[how](c).alias(f"_t_{n}") for n, (how, c) in outputs.items()])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    merge = {"count": F.sum}
    offsets = totals.select(
        *keys, "_block", *[merge.get(how, _FOLD[how])(f"_t_{n}").over(before).alias(f"_o_{n}") for n, (how, _) in outputs.items()]
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = attach(tagged, offsets, [*keys, "_block"])
    out = joined
    for name, (how, col) in outputs.items():
        local, prior = _FOLD[how](col).over(inside), F.col(f"_o_{name}")
        if how == "max":
            total = F.greatest(local, prior)
        elif how == "min":
            total = F.least(local, prior)
        else:
            total = F.when(prior.isNull(), local).otherwise(prior + F.coalesce(local, F.lit(0)))
        out = out.withColumn(name, total)
    return out.drop("_block", *[f"_o_{n}" for n in outputs])


def row_index_by_block(df: DataFrame, keys: list[str], order: str, block: Column, name: str = "row_index") -> DataFrame:
    """1-based position of each row of its key in `order`."""
    return running_by_block(df, keys, order, block, {name: ("count", F.lit(1))})


def lag_by_block(df: DataFrame, keys: list[str], order: str, block: Column, value: str, name: str) -> DataFrame:
    """Value of the previous row of the key in `order`, across block borders."""
    tagged = df.withColumn("_block", block)
    last = tagged.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(
        *keys, "_block", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    joined = attach(tagged, carried, [*keys, "_block"])
    return (
        joined.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.lag(value).over(inside)))
        .drop("_block", "_carry", "_first")
    )
