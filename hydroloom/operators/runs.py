"""Calibration runs as tables: parameters, candidates, scores, best runs, parameter maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.operators.keyed import lookup, row_index_by_block
from hydroloom.session import cut_lineage

# Blend width, mutation spread and rate, and the shares of blends and mutations.
BLEND_ALPHA, MUTATION_SIGMA, MUTATION_RATE = 0.15, 0.3, 0.3
CROSSOVER_SHARE, MUTATION_SHARE = 0.7, 0.3


def denormalise(p: Column, low: Column, high: Column) -> Column:
    return p * (high - low) + low


def normalise_start(start: Column, low: Column, high: Column) -> Column:
    """Start value on 0..1, 0 for an empty range."""
    return F.when(high == low, 0.0).otherwise((start - low) / F.nullif(high - low, F.lit(0.0)))


def denormalise_params(candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    return candidates.join(ranges, "name").withColumn("param", denormalise(F.col("value"), F.col("min"), F.col("max")))


def run_label(run: Column) -> Column:
    """`gg_nnn` of a run number gen * 1000 + n."""
    return F.format_string("%02d_%03d", F.floor(run / 1000).cast("int"), (run % 1000).cast("int"))


def uniform(*parts: Column | str | int) -> Column:
    """Number in [0, 1) that depends on its arguments alone.

    Unlike `rand`, the same row gets the same number however the table is split, and when a lost
    task is run again.
    """
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(2**48)


PARAMETER_LIMIT = 10_000


def packed_ranges(ranges: DataFrame, *names: str):
    """All parameters in one array value, which every row then unrolls in place; more than PARAMETER_LIMIT are refused."""
    if ranges.limit(PARAMETER_LIMIT + 1).count() > PARAMETER_LIMIT:
        raise ValueError(f"a parameter table has at most {PARAMETER_LIMIT} rows")
    return ranges.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("r")).scalar()


def sample_params(stations: DataFrame, ranges: DataFrame, size: int, generation: int, seed: int) -> DataFrame:
    """`size` candidates per station, uniform on 0..1; candidate 0 holds the start values.

    Run numbers are gen * 1000 + 1, 2, ...; the start candidate has number 0.
    """
    candidates = stations.select("station_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("candidate"))
    packed = packed_ranges(ranges, "name", "min", "max", "start")
    rows = candidates.select("*", F.explode(packed).alias("r")).select("station_id", "candidate", "r.*")
    first = F.col("candidate") == 0
    value = F.when(first, normalise_start(F.col("start"), F.col("min"), F.col("max"))).otherwise(
        uniform(seed, generation, F.col("station_id"), F.col("candidate"), F.col("name"))
    )
    run = F.when(first, 0).otherwise(generation * 1000 + F.col("candidate") + 1)
    return rows.select("station_id", "candidate", run.alias("run_id"), "name", value.alias("value"))


def vary_params(population: DataFrame, size: int, offspring: int, generation: int, seed: int) -> DataFrame:
    """One generation of offspring per station as a table transform.

    `population(station_id, candidate, name, value)` with candidates 0..size-1. A child is a blend
    of two different parents or a mutation of one, clipped to 0..1.
    """
    kids = population.select("station_id").distinct().select(
        "station_id", F.explode(F.sequence(F.lit(0), F.lit(offspring - 1))).alias("child")
    )
    tag = (F.col("station_id"), F.col("child"))
    first = F.floor(uniform(seed, generation, "parent", *tag) * size).cast("int")
    other = F.floor(uniform(seed, generation, "other", *tag) * (size - 1)).cast("int")
    kids = kids.withColumn("_a", first).withColumn("_b", F.pmod(F.col("_a") + 1 + other, F.lit(size))).withColumn(
        "_blend", uniform(seed, generation, "kind", *tag) < CROSSOVER_SHARE
    )
    a = population.select("station_id", F.col("candidate").alias("_a"), "name", F.col("value").alias("_va"))
    b = population.select("station_id", F.col("candidate").alias("_b"), "name", F.col("value").alias("_vb"))
    genes = kids.join(a, ["station_id", "_a"]).join(b, ["station_id", "_b", "name"])
    gene = (*tag, F.col("name"))
    gamma = (1 + 2 * BLEND_ALPHA) * uniform(seed, generation, "gamma", *gene) - BLEND_ALPHA
    blended = (1 - gamma) * F.col("_va") + gamma * F.col("_vb")
    radius = F.sqrt(-2 * F.ln(1 - uniform(seed, generation, "u1", *gene)))
    normal = radius * F.cos(2 * math.pi * uniform(seed, generation, "u2", *gene))
    mutated = F.when(uniform(seed, generation, "hit", *gene) < MUTATION_RATE, F.col("_va") + MUTATION_SIGMA * normal).otherwise(F.col("_va"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("_blend"), blended).otherwise(mutated)))
    return genes.select("station_id", "child", (generation * 1000 + F.col("child") + 1).alias("run_id"), "name", value.alias("value"))


def order_by_area(gauges: DataFrame, area: str = "catchment_area") -> DataFrame:
    """Ascending catchment area: upstream stations come first."""
    return gauges.orderBy(area, "gauge_id")


def overall_efficiency(score: Column) -> Column:
    return 1 - F.sqrt((1 - score) * (1 - score))


def best_run(scores: DataFrame, key: str = "station_id", score: str = "kge") -> DataFrame:
    """Run with the highest efficiency per station, the smaller run number on a tie."""
    eff = overall_efficiency(F.col(score))
    names = [c for c in scores.columns if c not in (key, "run_id")]
    best = scores.withColumn("effover", eff).groupBy(key).agg(
        F.max_by(F.struct("run_id", *names, "effover"), F.struct(F.col("effover"), -F.col("run_id"))).alias("b")
    )
    return best.select(key, "b.*")


def front_table(scores: DataFrame, candidates: DataFrame, ranges: DataFrame, names: list[str], last_generation: bool = False) -> DataFrame:
    """Runs by efficiency with their parameters in real units.

    `last_generation` keeps the offspring of the last generation only.
    """
    ranked = scores.withColumn("effover", overall_efficiency(F.col("kge")))
    if last_generation:
        ranked = ranked.filter(F.floor(F.col("run_id") / 1000) == scores.select(F.max(F.floor(F.col("run_id") / 1000))).scalar())
    wide = denormalise_params(candidates, ranges).groupBy("station_id", "run_id").pivot("name", names).agg(F.first("param"))
    # Places are counted in bands of efficiency, so the runs of one station are not sorted in one task.
    # Scores may stand for a pass over all simulated days; they are written once and read twice.
    ranked = cut_lineage(ranked, "scores")
    order = F.struct((-F.col("effover")).alias("e"), F.col("run_id"))
    placed = row_index_by_block(ranked.withColumn("_order", order), ["station_id"], "_order", F.floor((1 - F.col("effover")) * 100), "place")
    return placed.drop("_order").join(wide, ["station_id", "run_id"])


def select_best_k(scores: DataFrame, k: int, key: str = "station_id", score: str = "kge") -> DataFrame:
    """The k best runs per station; Spark drops the others before the shuffle of the window."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), "run_id"))
    return scores.withColumn("place", place).filter(F.col("place") <= k)


def generation_best(scores: DataFrame, key: str = "station_id") -> DataFrame:
    """Best score per generation, and the best so far. A window holds one row per generation."""
    per = scores.groupBy(key, "gen").agg(F.max("kge").alias("best"))
    so_far = W.partitionBy(key).orderBy("gen").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("best_so_far", F.max("best").over(so_far))


def first_gauge(series: DataFrame, keys: list[str] = ("date",)) -> DataFrame:
    """Value at the gauge with the smallest id."""
    return series.groupBy(*keys).agg(F.min("gauge_id").alias("gauge_id"), F.min_by("value", "gauge_id").alias("value"))


def closest_name(name: Column, catalogue: list[str]) -> Column:
    """Catalogue entry with the smallest edit distance, the first in order on a tie.

    The catalogue is a short list of names, carried as an array: no join is needed.
    """
    names = F.array(*[F.lit(n) for n in sorted(catalogue)])
    scored = F.transform(names, lambda n: F.struct(F.levenshtein(name, n).alias("d"), n.alias("n")))
    return F.array_min(scored)["n"]


def zone_param_assign(cells: DataFrame, best: DataFrame, ranges: DataFrame) -> DataFrame:
    """Parameter value of each cell: its region's best, the start value in region -1, else 0.

    `cells(cell_id, region)`, `best(region, name, param)`. Results of regions without a cell are left out first, and the rest is
    counted: as a short table it spares a shuffle by a few hot regions.
    """
    packed = packed_ranges(ranges, "name", "start")
    rows = cells.select("cell_id", "region", F.explode(packed).alias("r")).select("cell_id", "region", "r.*")
    own = best.join(cells.select("region").distinct(), "region", "left_semi")
    joined = lookup(rows, own, ["region", "name"], ["param"], how="left")
    value = F.when(F.col("region") == -1, F.col("start")).otherwise(F.coalesce("param", F.lit(0.0)))
    return joined.select("name", "cell_id", value.alias("value"))


def run_counts(regions: DataFrame, results: DataFrame) -> DataFrame:
    """One row: catchments with and without a result."""
    flag = results.select("region").distinct().withColumn("_has", F.lit(True))
    return regions.select("region").distinct().join(flag, "region", "left").agg(
        F.count("_has").alias("n_with"), F.count_if(F.col("_has").isNull()).alias("n_without")
    )


def union_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key and date where files overlap: the earliest file's (`file_rank`)."""
    return rows.groupBy(*keys, "date").agg(F.min_by("value", "file_rank").alias("value"))


def union_population(population: DataFrame, offspring: DataFrame) -> DataFrame:
    return population.unionByName(offspring)
