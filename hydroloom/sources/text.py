"""Id lists and coordinate lists as text, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_ids(df: DataFrame, text: str, name: str) -> DataFrame:
    """One row per id of a space-separated list; empty lists give none."""
    ids = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")
    return df.withColumn(name, F.explode(ids)).drop(text)


def join_ids(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Space-separated ids per key in ascending order."""
    ids = F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string"))
    return df.groupBy(key).agg(F.array_join(ids, " ").alias(name))


def coord_pairs(df: DataFrame, text: str) -> DataFrame:
    """(pos, lon, lat) rows of a `lon lat lon lat ...` list."""
    # The words are a column of their own: inside the lambda the list would be split again for every pair.
    listed = df.withColumn("_parts", F.split(F.trim(F.col(text)), r"\s+"))
    parts = F.col("_parts")
    # Even positions are longitudes; the value after each one is its latitude.
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(parts, i * 2).cast("double").alias("lon"), F.get(parts, i * 2 + 1).cast("double").alias("lat")),
    )
    others = [c for c in df.columns if c != text]
    return listed.select(*others, F.posexplode(pairs).alias("pos", "_p")).select(*others, "pos", "_p.lon", "_p.lat")


def coord_text(points: DataFrame, keys: list[str], order: str, name: str = "coords") -> DataFrame:
    """`lon lat lon lat ...` per key in the order of a column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("lon"), F.col("lat"))))
    words = F.transform(pairs, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return points.groupBy(*keys).agg(F.array_join(words, " ").alias(name))
