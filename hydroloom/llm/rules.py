"""Quality rules by robust multivariate outliers.

A few plain rules reject a document outright. All others become vectors of transformed statistics, and for every language and
source the minimum covariance determinant tells what its ordinary documents look like: of all halves of a group the one
whose covariance has the smallest determinant. Concentration steps find it from three deterministic starts; each is a
grouped aggregate over all rows, so a group of any size is spread over all tasks. Documents far from their group by
Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.session import cut_lineage, drop_path

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
UNIT = 1024  # vectors are whole numbers of 1/UNIT, so that sums do not depend on the order of rows
# Statistics of a vector and the least standard deviation each is given: finer differences never make an outlier.
FLOORS = {"symbols": 0.06, "doubled": 0.12, "repeats": 0.10, "length": 0.06, "variety": 0.04}
STATS = tuple(FLOORS)
VECTOR = [f"v{k}" for k in range(len(STATS))]
KEYS = ["lang", "source"]
TRIM = 0.975  # share of ordinary rows that the reweighting step keeps
CUTOFF = 1 - 1e-9  # share of ordinary rows whose distance is no reason to reject
STEPS_EACH, STEPS_MOST = 2, 30
SETTLED = 1e-3  # concentration ends once no group's log determinant falls by more
_BINS = 32  # steps of distance for each doubling


def words_covered(codes: np.ndarray, kinds: int, size: int = 3) -> int:
    """Words in windows of `size` that are found twice or more; `codes` numbers the words, `kinds` are their numbers."""
    count = len(codes) - size + 1
    if count < 2:
        return 0
    names = codes[:count]
    for k in range(1, size):
        if k > 1 and kinds ** (k + 1) >= 2**62:
            names = np.unique(names, return_inverse=True)[1]
        names = names * kinds + codes[k : count + k]
    _, own, found = np.unique(names, return_inverse=True, return_counts=True)
    covered = np.zeros(len(codes), bool)
    twice = found[own] > 1
    for k in range(size):
        covered[k : count + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, different words."""
    numbers: dict[bytes, int] = {}
    codes = [numbers.setdefault(word, len(numbers)) for word in text.encode().split()]
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(codes), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        words_covered(np.array(codes, np.int64), max(len(numbers), 1)), len(lines), len(numbers),
    )


def transformed(found: np.ndarray) -> np.ndarray:
    """Vectors of the statistics of `measure`, in whole units."""
    words, chars, symbols, doubled, repeats, lines, kinds = found.T.astype(float)
    words, lines = np.maximum(words, 1), np.maximum(lines, 1)
    columns = [
        np.sqrt(symbols / words),
        np.arcsin(np.sqrt(doubled / lines)),
        np.arcsin(np.sqrt(repeats / words)),
        np.log(np.maximum(chars, 1) / words),
        np.log(np.maximum(kinds, 1)) / np.log(words + 1),
    ]
    return np.rint(np.stack(columns, axis=1) * UNIT).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts, verdict of the plain rules and vector of every document, with its language and source."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in KEYS],
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = np.array([measure(text) for text in part.column("text").to_pylist()], np.int64).reshape(-1, 7)
                n, repeats = found[:, 0], found[:, 4]
                failed = (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
                out = {c: part.column(c) for c in ("doc_id", *KEYS)} | {c: found[:, k] for k, c in enumerate(names)}
                out |= {"base_failed": failed} | {c: v for c, v in zip(VECTOR, transformed(found).T, strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if isinstance(out[f.name], np.ndarray) else out[f.name] for f in arrow], schema=arrow)

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, "
    schema += ", ".join(f"{c} long" for c in VECTOR)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    a, half = p / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, p) < share else (low, middle)
    return high


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the inner `share` of normal rows that of all of them."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, p), p + 2)


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
_SUMS = ["n", *[f"s{k}" for k in range(len(STATS))], *[f"q{i}_{j}" for i, j in _PAIRS]]
_SHAPE = ["log_det", *[f"m{k}" for k in range(len(STATS))], *[f"w{i}_{j}" for i, j in _PAIRS]]


def _sums() -> list[Column]:
    """Exact count, sums and products of vectors; a sum beyond a long is an error, never a wrong number."""
    out = [F.count("*").alias("n")] + [F.sum(v).alias(f"s{k}") for k, v in enumerate(VECTOR)]
    return out + [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}_{j}") for i, j in _PAIRS]


def _shapes(rows: pd.DataFrame, center: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Centre, inverse Cholesky factor and log determinant of each covariance, which gets the floors first."""
    cov = cov + np.diag([(floor * UNIT) ** 2 for floor in FLOORS.values()])
    factor = np.linalg.cholesky(cov)
    white = np.linalg.inv(factor)
    log_det = 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1)
    columns = {"log_det": log_det} | {f"m{k}": center[:, k] for k in range(len(STATS))}
    columns |= {f"w{i}_{j}": white[:, i, j] for i, j in _PAIRS}
    keys = [c for c in rows.columns if c in (*KEYS, "start", "size")]
    return pd.concat([rows[keys].reset_index(drop=True), pd.DataFrame(columns)], axis=1)


def _moments(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances from exact sums: numerators are whole numbers of any size, so nothing cancels."""
    n = [int(x) for x in rows["n"]]
    sums = [[int(x) for x in row] for row in rows[[f"s{k}" for k in range(len(STATS))]].to_numpy(object)]
    center = np.array([[s / m for s in own] for own, m in zip(sums, n, strict=True)]).reshape(-1, len(STATS))
    cov = np.zeros((len(rows), len(STATS), len(STATS)))
    for (i, j), column in zip(_PAIRS, rows[[f"q{i}_{j}" for i, j in _PAIRS]].to_numpy(object).T, strict=True):
        cov[:, i, j] = cov[:, j, i] = [(m * int(q) - own[i] * own[j]) / (m * m) for q, own, m in zip(column, sums, n, strict=True)]
    return center, cov


def _shape_table(sums: DataFrame, keys: list[str], share: float | None) -> DataFrame:
    """Shapes from sums; the covariance is scaled to all rows by the share of rows in it: `n` of `size`, or a given one."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            center, cov = _moments(rows)
            shares = [share if share is not None else min(1.0, n / size) for n, size in zip(rows["n"], rows["size"], strict=True)]
            scale = np.array([consistency(s, len(STATS)) for s in shares])
            yield _shapes(rows, center, cov * scale[:, None, None])

    schema = ", ".join(f"{c} {'int' if c == 'start' else 'string'}" for c in keys) + ", size long, "
    return sums.mapInPandas(run, schema + ", ".join(f"{c} double" for c in _SHAPE))


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector from the shape in the same row."""
    total = F.lit(0.0)
    for i in range(len(STATS)):
        part = sum((F.col(f"w{i}_{j}") * (F.col(VECTOR[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + part * part
    return total


def placed(vectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every vector with each shape of its group, and its squared distance."""
    side = shapes.select(*[F.col(c).alias(f"k_{c}") if c in KEYS else F.col(c) for c in shapes.columns])
    on = F.lit(True)
    for key in KEYS:
        on = on & F.col(key).eqNullSafe(F.col(f"k_{key}"))
    return vectors.join(side, on).withColumn("distance", _distance()).drop(*[f"k_{c}" for c in KEYS], *[c for c in _SHAPE if c != "log_det"])


def _concentrated(vectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """One concentration step: the shape of the nearer half of each group, seen from each shape.

    Distances are compared in steps of 1/32 of a doubling, and all rows of the step that reaches the half belong to it: the
    same rows whatever the partitions.
    """
    bins = F.floor(F.log2(F.col("distance") + 1e-6) * _BINS).cast("int")
    far = placed(vectors, shapes).withColumn("bin", bins)
    counts = far.groupBy(*KEYS, "start", "bin").agg(F.count("*").alias("c"), F.max("size").alias("size"))
    # Distances have at most some thousand steps, which is what a group holds here.
    steps = counts.groupBy(*KEYS, "start").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("steps"))
    half = F.least(F.col("size"), F.floor((F.col("size") + len(STATS) + 1) / 2))
    reached = F.aggregate(
        "steps", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("bin")),
        lambda seen, own: F.when(seen["n"] >= half, seen).otherwise(F.struct((seen["n"] + own["c"]).alias("n"), own["bin"].alias("bin"))),
    )["bin"]
    border = steps.select(*KEYS, "start", reached.alias("border"))
    inner = far.alias("f").join(border.alias("b"), _same("f", "b", [*KEYS, "start"])).filter(F.col("bin") <= F.col("border"))
    keys = [F.col(f"f.{c}").alias(c) for c in (*KEYS, "start")]
    return _shape_table(inner.groupBy(*keys).agg(F.max("size").alias("size"), *_sums()), [*KEYS, "start"], None)


def _starts(vectors: DataFrame) -> DataFrame:
    """Three shapes of each group: quartiles alone, all rows, and the signs of rows seen from the median."""
    parts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    # Vectors are whole numbers, so the counts of different values behind an exact percentile stay few.
    quartiles = cut_lineage(
        vectors.groupBy(*KEYS).agg(
            *[F.percentile(v, parts).alias(f"p{k}") for k, v in enumerate(VECTOR)], F.count("*").alias("size"), *_sums()
        ),
        "rule-quartiles",
    )
    floors = [floor * UNIT for floor in FLOORS.values()]
    side = quartiles.select(
        *[F.col(c).alias(f"k_{c}") for c in KEYS],
        *[F.col(f"p{k}")[1].alias(f"m{k}") for k in range(len(STATS))],
        *[F.greatest((F.col(f"p{k}")[2] - F.col(f"p{k}")[0]) / 1.349, F.lit(floors[k])).alias(f"d{k}") for k in range(len(STATS))],
    )
    on = F.lit(True)
    for key in KEYS:
        on = on & F.col(key).eqNullSafe(F.col(f"k_{key}"))
    z = [(F.col(v) - F.col(f"m{k}")) / F.col(f"d{k}") for k, v in enumerate(VECTOR)]
    seen = vectors.join(side, on).select(*KEYS, *[x.alias(f"z{k}") for k, x in enumerate(z)])
    norm = sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(len(STATS))), F.lit(0.0))
    signs = seen.withColumn("norm", norm).groupBy(*KEYS).agg(
        *[F.sum(F.when(F.col("norm") > 0, F.rint(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") * 2**20).cast("long")).otherwise(0)).alias(f"u{i}_{j}") for i, j in _PAIRS]
    )
    both = quartiles.alias("q").join(signs.alias("s"), _same("q", "s", KEYS)).select("q.*", *[f"u{i}_{j}" for i, j in _PAIRS])

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            p = len(STATS)
            quart = np.array([[list(x) for x in rows[f"p{k}"]] for k in range(p)]).reshape(p, len(rows), 3)
            median = quart[:, :, 1].T
            wide = np.maximum((quart[:, :, 2] - quart[:, :, 0]).T / 1.349, floors)
            boxes = np.zeros((len(rows), p, p))
            boxes[:, range(p), range(p)] = wide**2
            turned = np.zeros_like(boxes)
            for i, j in _PAIRS:
                turned[:, i, j] = turned[:, j, i] = rows[f"u{i}_{j}"].to_numpy(float) / 2**20 / rows["size"].to_numpy(float) * p * wide[:, i] * wide[:, j]
            center, cov = _moments(rows)
            for start, (m, c) in enumerate(((median, boxes), (center, cov), (median, turned))):
                yield _shapes(rows.assign(start=start)[[*KEYS, "start", "size"]], m, c)

    schema = "lang string, source string, start int, size long, " + ", ".join(f"{c} double" for c in _SHAPE)
    return both.mapInPandas(run, schema)


def _best(shapes: DataFrame) -> DataFrame:
    """Of each group the shape with the smallest determinant, as start 0."""
    least = F.min(F.struct("log_det", "start", "size", *_SHAPE[1:])).alias("b")
    return shapes.groupBy(*KEYS).agg(least).select(
        *KEYS, F.lit(0).alias("start"), *[F.col(f"b.{c}").alias(c) for c in ("size", *_SHAPE)]
    )


def robust_shapes(vectors: DataFrame) -> DataFrame:
    """Centre and inverse factor of each group's reweighted minimum covariance determinant; `vectors(lang, source, v0...)`.

    A group of one row, or of equal rows, has the floors alone as its covariance.
    """
    shapes = cut_lineage(_starts(vectors), "rule-shapes")
    for _ in range(STEPS_EACH):
        shapes = cut_lineage(_concentrated(vectors, shapes), "rule-shapes", shapes)
    shapes = cut_lineage(_best(shapes), "rule-shapes", shapes)
    for _ in range(STEPS_MOST):
        moved = _concentrated(vectors, shapes)
        now = cut_lineage(moved, "rule-shapes")
        better = (
            now.alias("a").join(shapes.alias("b"), _same("a", "b", KEYS)).filter(F.col("a.log_det") < F.col("b.log_det") - SETTLED)
            .select("a.*")
        )
        better = cut_lineage(better, "rule-better")
        drop_path(vectors.sparkSession, now._scratch_path)
        if better.limit(1).count() == 0:
            drop_path(vectors.sparkSession, better._scratch_path)
            break
        shapes = cut_lineage(_best(shapes.unionByName(better)), "rule-shapes", shapes)
        drop_path(vectors.sparkSession, better._scratch_path)
    inside = placed(vectors, shapes).filter(F.col("distance") <= chi2_quantile(TRIM, len(STATS)))
    sums = inside.groupBy(*KEYS).agg(F.max("size").alias("size"), *_sums())
    return cut_lineage(_shape_table(sums, KEYS, TRIM), "rule-final")


def judge(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance` of every document.

    A null or empty text has no words and fails the plain rules; so do texts of under `MIN_WORDS` words and texts with over
    half of their words in repeated windows. All others are judged within their language and source, where null is a value of
    its own and a missing column counts as null. `distance` is the squared robust distance, NULL where the plain rules
    failed. Repeated rows count as often as they stand there and have equal results; other columns, whatever their names, are left out.
    """
    held = cut_lineage(statistics(docs), "rule-statistics")
    vectors = held.filter(~F.col("base_failed")).select(*KEYS, *VECTOR)
    shapes = robust_shapes(vectors)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    far = placed(held.filter(~F.col("base_failed")), shapes)
    judged = far.select(*names, (F.col("distance") <= chi2_quantile(CUTOFF, len(STATS))).alias("kept"), "distance")
    failed = held.filter("base_failed").select(*names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed)
