"""Scoring of series: warm-up, alignment, per-station and per-run scores, rank histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.functions import skill as fn
from hydroloom.operators.keyed import attach, lookup, row_index_by_block, with_group


def filter_pairs(pairs: DataFrame) -> DataFrame:
    clean = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("s", "o")]
    others = [c for c in pairs.columns if c not in ("s", "o")]
    return pairs.select(*others, *clean).na.drop(subset=["s", "o"])


def drop_warmup(pairs: DataFrame, keys: list[str], rows: int, order: str = "date") -> DataFrame:
    """Rows of each key after the first `rows` in `order`; positions are counted year by year."""
    indexed = row_index_by_block(pairs, keys, order, F.year(order), "_n")
    return indexed.filter(F.col("_n") > rows).drop("_n")


def score(pairs: DataFrame, keys: list[str], names: list[str] | None = None, warmup: int | None = None) -> DataFrame:
    """Chosen scores per key in one aggregation.

    With `warmup`, the scores that honour it ignore the first `warmup + 1` rows of each key.
    """
    names = list(fn.SCORES) if names is None else names
    s, o = F.col("s"), F.col("o")
    if warmup is None:
        return pairs.groupBy(*keys).agg(*[fn.SCORES[n][0](s, o).alias(n) for n in names])
    indexed = row_index_by_block(pairs, keys, "date", F.year("date"), "_n")
    late = F.col("_n") > warmup + 1
    aggs = []
    for n in names:
        make, honours = fn.SCORES[n]
        aggs.append((make(F.when(late, s), F.when(late, o)) if honours else make(s, o)).alias(n))
    return indexed.groupBy(*keys).agg(*aggs)


def index_agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """1 - sum((o-s)^2) / sum((|s-mean o| + |o-mean o|)^2); the mean comes from a first pass."""
    valid = filter_pairs(pairs)
    centred = with_group(valid, keys, _mean=F.avg("o"))
    spread = F.abs(F.col("s") - F.col("_mean")) + F.abs(F.col("o") - F.col("_mean"))
    diff = F.col("o") - F.col("s")
    return centred.groupBy(*keys).agg(
        (1 - F.sum(diff * diff) / F.nullif(F.sum(spread * spread), F.lit(0.0))).alias("index_agreement")
    )


def mse_by_column(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(fn.mean_square(F.col("s"), F.col("o")).alias("mse"))


def kge_by_column(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """KGE, NSE, r and bias ratio with means and deviations of each side on its own, r over pairs."""
    s, o = F.col("s"), F.col("o")
    zero = F.lit(0.0)
    g = pairs.groupBy(*keys).agg(
        F.avg(s).alias("ms"), F.avg(o).alias("mo"), F.stddev_pop(s).alias("ds"), F.stddev_pop(o).alias("do"),
        fn.correlation(s, o).alias("r"), F.sum((s - o) * (s - o)).alias("sse"),
        (F.count(o) * F.var_pop(o)).alias("sst"),
    )
    beta = F.col("ms") / F.nullif(F.col("mo"), zero)
    gamma = (F.col("ds") / F.nullif(F.col("ms"), zero)) / F.nullif(F.col("do") / F.nullif(F.col("mo"), zero), zero)
    kge = 1 - F.sqrt((F.col("r") - 1) ** 2 + (beta - 1) ** 2 + (gamma - 1) ** 2)
    return g.select(
        *keys, kge.alias("kge"), (1 - F.col("sse") / F.nullif(F.col("sst"), zero)).alias("nse"), "r", beta.alias("pbias")
    )


def align_sim_obs(sim: DataFrame, obs: DataFrame, keys: list[str] = ("station_id", "date")) -> DataFrame:
    """Outer alignment by key; a missing side is NULL."""
    return sim.join(obs, list(keys), "full")


def length_mismatch(sim: DataFrame, obs: DataFrame, key: str = "station_id") -> DataFrame:
    """Stations whose simulated and observed row counts differ (the strict mode of run scoring)."""
    a = sim.groupBy(key).agg(F.count("*").alias("n_sim"))
    b = obs.groupBy(key).agg(F.count("*").alias("n_obs"))
    return a.join(b, key, "full").filter(~F.col("n_sim").eqNullSafe(F.col("n_obs")))


def run_score(sim: DataFrame, obs: DataFrame, keys: list[str] = ("run_id",)) -> DataFrame:
    """Scores of every run at once: sim + 1e-5, observed days only; KGE is -100 when the
    simulated peak (over all days) exceeds ten times the observed one.

    `sim(run keys, station_id, date, q)`, `obs(station_id, date, o)`.
    """
    s, o = F.col("q") + 1e-5, F.col("o")
    joined = lookup(sim, obs, ["station_id", "date"], ["o"], how="left")
    g = joined.groupBy(*keys).agg(
        fn.kge(s, o).alias("kge"), fn.correlation(s, o).alias("r"), fn.nse(s, o).alias("nse"),
        F.max(s).alias("_max_s"), F.max(o).alias("_max_o"),
    )
    wild = F.col("_max_s") / F.nullif(F.col("_max_o"), F.lit(0.0)) > 10
    return g.withColumn("kge", F.when(wild, F.lit(-100.0)).otherwise(F.col("kge"))).drop("_max_s", "_max_o")


def period_scores(pairs: DataFrame, periods: DataFrame, min_days: int = 730) -> DataFrame:
    """KGE, NSE, r and bias per station for its calibration and validation periods.

    Validation starts no earlier than the first simulated date and needs more than `min_days`
    observed values.
    """
    first = pairs.filter(F.col("s").isNotNull()).groupBy("station_id").agg(F.min("date").alias("_first"))
    spans = attach(periods, first, ["station_id"])
    spans = spans.select(
        "station_id",
        F.explode(
            F.array(
                F.struct(F.lit("calibration").alias("period"), F.col("cal_start").alias("start"), F.col("cal_end").alias("end")),
                F.struct(
                    F.lit("validation").alias("period"),
                    F.greatest("val_start", "_first").alias("start"), F.col("val_end").alias("end"),
                ),
            )
        ).alias("p"),
    ).select("station_id", "p.*")
    inside = pairs.join(spans, "station_id").filter(F.col("date").between(F.col("start"), F.col("end")))
    s, o = F.col("s"), F.col("o")
    g = inside.groupBy("station_id", "period").agg(
        F.count(o).alias("n_obs"), fn.kge(s, o).alias("kge"), fn.nse(s, o).alias("nse"),
        fn.correlation(s, o).alias("r"), fn.pc_bias2(s, o).alias("bias"),
    )
    return g.filter((F.col("period") == "calibration") | (F.col("n_obs") > min_days))


def monthly_climatology(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation by calendar month over full pairs, with the band mean +- half a deviation."""
    g = filter_pairs(pairs).groupBy(*keys, F.month("date").alias("month")).agg(
        F.avg("s").alias("s_mean"), F.stddev_pop("s").alias("s_std"),
        F.avg("o").alias("o_mean"), F.stddev_pop("o").alias("o_std"),
    )
    for side in ("s", "o"):
        mean, std = F.col(f"{side}_mean"), F.col(f"{side}_std")
        g = g.withColumn(f"{side}_low", F.greatest(F.lit(0.0), mean - 0.5 * std)).withColumn(f"{side}_high", mean + 0.5 * std)
    return g


# Fixed value: months in display order; September and October appear on both sides.
OVERLAP_ORDER = (9, 10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)


def with_display_order(climatology: DataFrame) -> DataFrame:
    """One row per display position: the months 9..12 and 1..10 in a row."""
    months = F.array(*[F.lit(m) for m in OVERLAP_ORDER])
    where = F.filter(F.transform(months, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: x["m"] == F.col("month"))
    return climatology.withColumn("position", F.explode(F.transform(where, lambda x: x["i"])))


def _rank(scores: DataFrame, value: Column, reached, thresholds: list[float], weights: list[float], station_weight: str | None) -> DataFrame:
    unit = F.col(station_weight) if station_weight else F.lit(1.0)
    classes = []
    for i, w in enumerate(weights):
        if i + 1 < len(thresholds):
            upper, lower = (F.sum(F.when(reached(value, thresholds[j]), unit).otherwise(0.0)) for j in (i, i + 1))
            count = F.coalesce(upper - lower, F.lit(0.0))
        else:
            count = F.lit(0.0)  # no class behind the last threshold
        classes.append((i, w, count))
    total = classes[0][2] * classes[0][1]
    for _, w, count in classes[1:]:
        total = total + count * w
    return scores.agg(total.alias("rank_sum"), *[c.cast("double").alias(f"class_{i}") for i, _, c in classes])


def rank_score(
    scores: DataFrame, column: str, thresholds: list[float], weights: list[float], station_weight: str | None = None
) -> DataFrame:
    """Weighted histogram of a score over ascending thresholds."""
    return _rank(scores, F.col(column), lambda v, t: v >= t, thresholds, weights, station_weight)


def rank_bias(
    scores: DataFrame, column: str, thresholds: list[float], weights: list[float], station_weight: str | None = None
) -> DataFrame:
    """The same for 100 * |bias| over descending thresholds."""
    return _rank(scores, 100 * F.abs(F.col(column)), lambda v, t: v <= t, thresholds, weights, station_weight)
