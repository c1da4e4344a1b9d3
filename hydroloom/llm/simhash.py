"""SimHash near-duplicates by a grid over segment popcounts.

A fingerprint is cut into segments of two bits; its embedding is the number of ones of each segment. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints. Embeddings are kept in unary code (0: 00, 1: 01,
2: 11), so that Manhattan distances are bit counts as well. Segments form groups, and a cell of the grid is an
embedding seen through some of the groups: points within distance d agree on all but d groups. Points of a cell are joined
under the Manhattan bound, then verified by the Hamming distance. Cells with more points than `CELL` go exact ways of their
own, so that no cell is cut and none is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.llm.components import components
from hydroloom.llm.text import map_batches, whole_texts
from hydroloom.session import cut_lineage

CELL = 64
TILE = 512
LOW_BITS = 0x5555555555555555
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of `size` words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) <= size:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a slice at a time bounds the bit matrix of a very long text
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def lanes(hashes: np.ndarray, count: int) -> list[int]:
    """`count` fingerprints of 64 bits from one set of hashes, mixed anew for each lane."""
    out = []
    for lane in range(count):
        value = hashes + np.uint64((_MIX[0] * (lane + 1)) % (1 << 64))
        for factor, shift in ((_MIX[1], 30), (_MIX[2], 27)):
            value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
        out.append(signed(majority(value ^ (value >> np.uint64(31)))))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """`doc_id, fp` of every whole text, A-Z in lower case, words parted by ASCII white space."""

    def run(ids: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "fp": [signed(majority(shingle_hashes(t.encode().lower().split(), shingle))) for t in texts]}

    return map_batches(docs, run, "doc_id long, fp long", slice_rows=200)


def embedding(fp: Column) -> Column:
    """Ones of each two-bit segment in unary code."""
    low = F.lit(LOW_BITS)
    shifted = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(low)
    both = fp.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def group_masks(groups: int) -> list[int]:
    """Masks that deal the 32 segments of a fingerprint into groups of about equal size."""
    cuts = [round(32 * g / groups) for g in range(groups + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def grid_cells(points: DataFrame, groups: int, free: int) -> DataFrame:
    """`cell, key` and the point's columns: one row for each choice of all groups but `free`."""
    masks = group_masks(groups)
    choices = [sum(masks[g] for g in chosen) for chosen in combinations(range(groups), groups - free)]
    seen = F.array(*[
        F.struct(F.lit(number).alias("cell"), embedding(F.col("fp")).bitwiseAND(F.lit(signed(mask))).alias("key"))
        for number, mask in enumerate(choices)
    ])
    return points.select("*", F.explode(seen).alias("at")).select("at.cell", "at.key", *points.columns)


def links(points: DataFrame, distance: int, groups: int) -> DataFrame:
    """`u, v`: edges whose components are those of all pairs of distinct fingerprints within `distance` (at most 2) bits.

    Cells of at most CELL points are joined: every pair of a cell within both bounds is an edge. Points of larger cells
    are linked over the values one bit away from them: two points within two bits share such a value, which at most 65
    points can share, so the number of rows is linear in the number of points.
    """
    if distance > 2:
        raise ValueError("large cells are linked over values one bit away, which reach two bits")
    cells = grid_cells(points, groups, distance)
    counted = cells.groupBy("cell", "key").agg(F.count("*").alias("n")).filter("n > 1")
    held = cut_lineage(cells.join(counted, ["cell", "key"]), "grid-cells")
    small = held.filter(F.col("n") <= CELL)
    a, b = small.alias("a"), small.alias("b")
    near = (
        (F.col("a.cell") == F.col("b.cell")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(embedding(F.col("a.fp")).bitwiseXOR(embedding(F.col("b.fp")))) <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    )
    pairs = a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << bit))) for bit in range(64 if distance else 0)])
    around = held.filter(F.col("n") > CELL).select("fp").distinct().select("fp", F.explode(values).alias("value"))
    stars = (
        around.groupBy("value").agg(F.collect_set("fp").alias("own")).filter(F.size("own") > 1)
        .select(F.array_min("own").alias("u"), F.explode("own").alias("v")).filter("u <> v")
    )
    return pairs.union(stars.distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, groups: int = 5) -> DataFrame:
    """`doc_id, fingerprint, component_id` of every document; the component is named by its smallest doc_id.

    Documents with one fingerprint are one point of the grid, so copies are never paired. A null or empty text has
    fingerprint zero and is linked like any other; a null doc_id names a component only where it has no other.
    Repeated rows have equal results.
    """
    marks = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    points = cut_lineage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-points")
    found = components(links(points.select("fp"), distance, groups))
    # The smallest fingerprint names a component until the smallest document of all its fingerprints is known.
    rooted = points.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# Similar texts: the same grid over wider fingerprints finds most links, the rarest shingles of each document all the others.

LANES = 4
WIDE_GROUPS = 16  # four groups of eight segments in each lane
WIDE_CHOICES = 40
NEAR_BITS = 64  # of 256: at a similarity of 0.8 the mean is 39, with a deviation of 6
SIMILARITY = 0.8
PREFIX = 5  # sets of n shingles that are similar share one of the first n // 5 + 1 of each, whatever the common order
SAMPLE_DOCS = 50_000  # of these, and of one in SAMPLE_PARTS at least, the common shingles are counted, which come last in that order
SAMPLE_PARTS = 4
COMMON = 3
COMMON_ROWS = 2_000_000  # 32 MB; of more the most common ones come last
DENSE = 2  # possible links a point, beyond which the points of a cell are compared by their sets
BITMAP = 16  # longs of a document's bitmap of shingles
BROADCAST_IDS = 1_000_000  # 8 MB of ids
_COLUMNS = 4096


def distinct_shingles(words: list[bytes], size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, size))


def _digest(shingles: np.ndarray) -> int:
    """Sum of the hashes, which tells sets of one size apart."""
    return int(shingles.sum(dtype=np.uint64)) >> 1


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """`doc_id, size, digest` of the distinct shingles, four lanes `w0..w3` over the distinct words and four `s0..s3` over
    the shingles, and `b0..`: the bits that the shingles set in a map of BITMAP longs."""
    names = ["size", "digest", *[f"w{k}" for k in range(LANES)], *[f"s{k}" for k in range(LANES)], *[f"b{k}" for k in range(BITMAP)]]

    def run(ids: list, texts: list) -> dict[str, list]:
        rows = []
        for text in texts:
            words = text.encode().lower().split()
            single = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in set(words)), np.uint64)
            own = distinct_shingles(words, shingle)
            bits = np.zeros(64 * BITMAP, np.uint8)
            bits[own % np.uint64(64 * BITMAP)] = 1
            bitmap = np.packbits(bits, bitorder="little").view(np.int64).tolist()
            rows.append([len(own), _digest(own), *lanes(single, LANES), *lanes(own, LANES), *bitmap])
        return {"doc_id": ids} | {name: [row[k] for row in rows] for k, name in enumerate(names)}

    return map_batches(docs, run, "doc_id long, " + ", ".join(f"{name} long" for name in names), slice_rows=200)


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """`doc_id, size, digest, shingles`: hashes of the distinct shingles."""

    def run(ids: list, texts: list) -> dict[str, list]:
        own = [distinct_shingles(t.encode().lower().split(), shingle) for t in texts]
        return {"doc_id": ids, "size": list(map(len, own)), "digest": list(map(_digest, own)), "shingles": [o.view(np.int64) for o in own]}

    return map_batches(docs, run, "doc_id long, size long, digest long, shingles array<long>", slice_rows=200)


def _longest(rows: DataFrame) -> DataFrame:
    """One row for each doc_id: the one with the most shingles stands for rows that share it."""
    names = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.max(F.struct(*names)).alias("r")).select("doc_id", "r.*")


def possible(pairs: DataFrame, marks: DataFrame, columns: list[str] = ()) -> DataFrame:
    """`pairs` (u, v) that may be similar, with `columns` of both sides as `u_...` and `v_...`; no similar pair is lost.

    A bit of one map that the other lacks stands for at least one shingle the other lacks, which bounds what both share.
    """
    bits = [f"b{k}" for k in range(BITMAP)]
    a, b = (marks.select(F.col("doc_id").alias(c), *[F.col(s).alias(f"{c}_{s}") for s in ("size", *bits, *columns)]) for c in "uv")

    def most(x: str, y: str) -> Column:
        alone = sum((F.bit_count(F.col(f"{x}_{s}").bitwiseAND(F.bitwise_not(f"{y}_{s}"))) for s in bits), F.lit(0))
        return F.col(f"{x}_size") - alone

    near = F.least(most("u", "v"), most("v", "u")) * 9 >= (F.col("u_size") + F.col("v_size")) * 4
    kept = [f"{c}_{s}" for c in "uv" for s in columns]
    return pairs.join(a, "u").join(b, "v").filter(near).select(*pairs.columns, *kept)


def wide_choices() -> list[tuple[int, int]]:
    """Pairs of groups, dealt evenly over all groups."""
    pairs = sorted(combinations(range(WIDE_GROUPS), 2), key=lambda p: ((p[1] - p[0]) * 7 % 15, p))
    return pairs[:WIDE_CHOICES]


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Similarities of all pairs of different sets, by products of their incidence matrix, a slice of columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1  # what one set has alone is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    sizes = np.array([len(s) for s in sets], np.float32)
    union = sizes[:, None] + sizes[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def similar_links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """`u, v`: documents linked with the first document of a cell they share, where both are similar.

    All points of a cell are joined with its first one alone, under the Manhattan bound and then by the bits themselves; of a
    document's partners the nearest is compared by the sets. So the rows are linear in the points, however large a cell is;
    what stays unlinked is left to `missing_links`, which is exact.
    """
    masks = group_masks(4)
    seen = []
    for number, pair in enumerate(wide_choices()):
        parts = [embedding(F.col(f"w{g // 4}")).bitwiseAND(F.lit(signed(masks[g % 4]))) for g in pair]
        seen.append(F.xxhash64(F.lit(number), *parts))
    cells = marks.select("doc_id", F.explode(F.array(*seen)).alias("cell"))
    first = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("doc_id").alias("v")).filter("n > 1").drop("n")
    stars = cells.withColumnRenamed("doc_id", "u").join(first, "cell").filter("u <> v").select("u", "v").distinct()
    stars = cut_lineage(stars, "near-stars")
    # Most cells of many documents are shared by chance; sizes tell that for a few bytes a row.
    u, v = (marks.select(F.col("doc_id").alias(c), F.col("size").alias(f"n{c}")) for c in "uv")
    alike = stars.join(u, "u").join(v, "v").filter(F.least("nu", "nv") * 5 >= F.greatest("nu", "nv") * 4).select("u", "v")
    stars = cut_lineage(alike, "near-stars", stars)
    bits = [f"s{k}" for k in range(LANES)]
    apart = sum((F.bit_count(F.col(f"u_{s}").bitwiseXOR(F.col(f"v_{s}"))) for s in bits), F.lit(0))
    bound = sum((F.bit_count(embedding(F.col(f"u_{s}")).bitwiseXOR(embedding(F.col(f"v_{s}")))) for s in bits), F.lit(0))
    near = possible(stars, marks, bits).filter((bound <= NEAR_BITS) & (apart <= NEAR_BITS))
    pairs = near.groupBy("u").agg(F.min(F.struct(apart.alias("apart"), "v")).alias("best")).select("u", "best.v")
    pairs = cut_lineage(pairs, "near-pairs", stars)
    sets = _sets_of(docs, pairs.select("u").union(pairs.select("v")))
    return cut_lineage(_verified(pairs, sets).select("u", "v"), "near-links", sets)


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`doc_id, shingles` of the documents of `ids`."""
    wanted = cut_lineage(ids.toDF("doc_id").distinct(), "wanted-documents")
    # Ids are sent to the texts while they are few; beyond that both sides are shuffled.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = shingle_sets(whole_texts(docs).join(side, "doc_id", "left_semi"))
    return cut_lineage(_longest(sets).select("doc_id", "shingles"), "shingle-sets", wanted)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of `pairs` (u, v) whose sets are similar."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"_{c}")) for c in "uv")
    shared = F.size(F.array_intersect("_u", "_v"))
    # In whole numbers shared >= 0.8 * (u + v - shared).
    return pairs.join(left, "u").join(right, "v").filter(shared * 9 >= (F.size("_u") + F.size("_v")) * 4).drop("_u", "_v")


def least_cells(u: str, v: str) -> Column:
    """Of the first n // 5 + 1 shingles of two similar sets of these sizes at least so many are the same.

    Similar sets share 4 / 9 of the sum of their sizes or more. All but these are what a set can have of its own among its first
    ones; the rest begins the shared ones in the common order, so the shorter of both rests is among the first ones of either.
    """
    shared = F.expr(f"(({u} + {v}) * 4 + 8) div 9")
    return F.least(*[F.expr(f"{n} div {PREFIX} + 1 - {n}") + shared for n in (u, v)])


def _tiles(large: DataFrame) -> DataFrame:
    """`large` (doc_id, cell, n, ...) dealt into slots of about TILE points: a row, with its `slot`, for each tile `i, j` of a point's cell."""
    slots = F.ceil(F.col("n") / TILE).cast("int")
    slot = F.pmod(F.xxhash64("doc_id"), slots).cast("int")
    dealt = large.select("*", slot.alias("slot"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("other"))
    return dealt.select(*[c for c in large.columns if c != "n"], "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in ascending order and counts of the shingles that over COMMON documents of a sample have.

    The sample grows with the table, else the cells of shingles that it does not show would grow instead.
    """
    parts = min(-(-docs.count() // SAMPLE_DOCS) or 1, SAMPLE_PARTS)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    counted = shingle_sets(sample).select(F.explode("shingles").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    table = cut_lineage(counted.filter(F.col("n") > COMMON), "common-shingles")
    least, rows = COMMON, 0
    for n, times in sorted(map(tuple, table.groupBy("n").count().collect()), reverse=True):
        rows += times
        if rows > COMMON_ROWS:
            least = n
            break
    found = table.filter(F.col("n") > least).toArrow()
    names = found["name"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], found["n"].to_numpy()[order]


def prefix_cells(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int = 5) -> DataFrame:
    """`cell, doc_id`: a row for each of a document's first shingles, common ones last, then by hash.

    Any order that all documents share gives the same links; this one keeps cells small.
    """
    names, counts = common

    def run(ids: list, texts: list) -> dict[str, list]:
        firsts = []
        for text in texts:
            own = distinct_shingles(text.encode().lower().split(), shingle)
            rank = np.zeros(len(own), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                rank = np.where(names[at] == own, counts[at], 0)
            # Texts without words have equal, empty sets; a cell of their own links them.
            firsts.append(own[np.argsort(rank, kind="stable")[: len(own) // PREFIX + 1]] if len(own) else np.zeros(1, np.uint64))
        lengths = [len(first) for first in firsts]
        return {"cell": np.concatenate(firsts).view(np.int64), "doc_id": np.repeat(np.array(ids, np.int64), lengths)}

    return map_batches(docs, run, "cell long, doc_id long", slice_rows=200)


def _tile_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one tile that may be similar by labels, sizes and bitmaps; of a dense tile one row that names it alone."""
    names = ["u", "v", "lu", "lv", "nu", "nv", "m"]
    place = {c: rows[c].iloc[0] for c in ("cell", "i", "j")}
    ids, labels, sizes = (rows[c].to_numpy(np.int64) for c in ("doc_id", "label", "size"))
    maps = np.ascontiguousarray(rows[[f"b{k}" for k in range(BITMAP)]].to_numpy(np.int64))
    bits = np.unpackbits(maps.view(np.uint8), axis=1).astype(np.float32)
    both = bits @ bits.T
    most = sizes[:, None] - (bits.sum(axis=1)[:, None] - both)
    close = np.minimum(most, most.T) * 9 >= (sizes[:, None] + sizes[None, :]) * 4
    close &= (labels[:, None] != labels[None, :]) & (ids[:, None] > ids[None, :])
    if place["i"] != place["j"]:  # the pairs inside a slot are those of its own tile
        slots = rows["slot"].to_numpy()
        close &= slots[:, None] != slots[None, :]
    a, b = np.nonzero(close)
    if len(a) > DENSE * len(rows):
        return pd.DataFrame([dict.fromkeys(names, 0) | place | {"dense": True}])
    values = [ids[a], ids[b], labels[a], labels[b], sizes[a], sizes[b], np.full(len(a), rows["m"].iloc[0], np.int64)]
    return pd.DataFrame(dict(zip(names, values, strict=True)) | place | {"dense": False})


def _open_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the groups of one tile, by all pairs of its points that are in different groups."""
    groups = rows["label"].to_numpy(np.int64)
    if (groups == groups[0]).all():
        return pd.DataFrame({"u": groups[:0], "v": groups[:0]})
    close = jaccard([np.asarray(s, np.int64) for s in rows["shingles"]]) >= SIMILARITY
    a, b = np.nonzero(close & (groups[:, None] > groups[None, :]))
    return pd.DataFrame(np.unique(np.stack([groups[a], groups[b]], axis=1), axis=0), columns=["u", "v"])


def _crowds(crowd: DataFrame) -> DataFrame:
    """The dense cells (cell, n, doc_id, label) of documents that share some as one cell, where this makes fewer rows in tiles.

    Near copies share most of their cells, and would have their sets sent and compared in each of them.
    """
    first = crowd.groupBy("cell").agg(F.min("doc_id").alias("v"))
    found = components(crowd.join(first, "cell").select(F.col("doc_id").alias("u"), "v"))
    grouped = crowd.join(found, F.col("doc_id") == F.col("u"), "left").withColumn("group", F.coalesce("v", "doc_id")).drop("u", "v")
    grouped = cut_lineage(grouped, "dense-groups", crowd)
    once = grouped.select("group", "doc_id", "label").distinct()
    cost = F.col("n") * F.ceil(F.col("n") / TILE)
    whole = once.groupBy("group").agg(F.count("*").alias("n")).withColumn("whole", cost)
    apart = grouped.select("group", "cell", "n").distinct().groupBy("group").agg(F.sum(cost).alias("apart"))
    chosen = whole.join(apart, "group").filter("whole <= apart").select("group", F.col("n").alias("size"))
    merged = once.join(chosen, "group").select(F.col("group").alias("cell"), F.col("size").alias("n"), "doc_id", "label")
    return cut_lineage(merged.union(grouped.join(chosen, "group", "left_anti").select("cell", "n", "doc_id", "label")), "dense-cells", grouped)


def missing_links(docs: DataFrame, labels: DataFrame, marks: DataFrame) -> DataFrame:
    """`u, v`: edges between the groups of `labels` (doc_id, label) that hold similar documents, none left out.

    Similar sets of n shingles share one of the first n // 5 + 1 of each in any common order, so these are the cells. Cells
    with the same members are one, and cells inside one group have nothing to add. A pair of the others has its cells counted,
    since similar sets must share several, and what is left is compared by the sets themselves. Large cells make their pairs in tiles;
    the points of dense cells are compared with each other by their sets instead.
    """
    # Both sides of the join read one shuffle: most cells have one document and end here.
    cells = prefix_cells(docs, common_shingles(docs)).repartition("cell")
    repeated = cells.groupBy("cell").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    shared = cut_lineage(cells.join(repeated.select("cell"), "cell"), "shared-cells")
    sized = labels.join(marks.select("doc_id", "size"), "doc_id")
    placed = cut_lineage(shared.join(sized, "doc_id"), "placed-cells", shared)
    mark = F.xxhash64("doc_id")
    members = [F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(mark, 32)).alias("high")]
    counted = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("label").alias("one"), F.max("label").alias("other"),
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *members,
    )
    wanted = counted.filter("one < other").groupBy("n", "first", "last", "low", "high").agg(
        F.min("cell").alias("cell"), F.count("*").alias("m")
    )
    held = cut_lineage(placed.join(wanted.select("cell", "n", "m"), "cell"), "open-cells", placed)
    small = held.filter(F.col("n") <= CELL)
    a, b = small.alias("a"), small.alias("b")
    sizes = F.col("a.size"), F.col("b.size")
    near = (
        (F.col("a.cell") == F.col("b.cell")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.label") != F.col("b.label"))
        & (F.least(*sizes) * 5 >= F.greatest(*sizes) * 4)
    )
    names = [
        F.col("b.doc_id").alias("u"), F.col("a.doc_id").alias("v"), F.col("b.label").alias("lu"), F.col("a.label").alias("lv"),
        F.col("b.size").alias("nu"), F.col("a.size").alias("nv"), F.col("a.m").alias("m"),
    ]
    large = held.filter(F.col("n") > CELL)
    tiles = _tiles(large)
    maps = marks.select("doc_id", *[f"b{k}" for k in range(BITMAP)])
    rows = ", ".join(f"{c} long" for c in ("u", "v", "lu", "lv", "nu", "nv", "m")) + ", cell long, i int, j int, dense boolean"

    def made(some: DataFrame) -> DataFrame:
        return cut_lineage(some.join(maps, "doc_id").groupBy("cell", "i", "j").applyInPandas(_tile_pairs, rows), "tile-pairs")

    # A cell whose first tile is dense makes no other one.
    first = made(tiles.filter("j = 0"))
    tiled = first.union(made(tiles.filter("j > 0").join(first.filter("dense").select("cell"), "cell", "left_anti")))
    met = a.join(b, near).select(*names).union(tiled.filter(~F.col("dense")).select("u", "v", "lu", "lv", "nu", "nv", "m"))
    pairs = met.groupBy("u", "v", "lu", "lv", "nu", "nv").agg(F.sum("m").alias("cells")).filter(F.col("cells") >= least_cells("nu", "nv"))
    pairs = cut_lineage(pairs.select("u", "v", "lu", "lv"), "open-pairs")
    pairs = cut_lineage(possible(pairs, marks), "open-pairs", pairs)  # few are left whose sets must be sent to each other
    # Pairs of a dense cell are compared there, so it does not matter that their cells were not all counted.
    crowd = large.join(tiled.filter("dense").select("cell").distinct(), "cell").select("cell", "n", "doc_id", "label").distinct()
    crowd = _crowds(cut_lineage(crowd, "dense-cells", held))
    sets = _sets_of(docs, pairs.select("u").union(pairs.select("v")).union(crowd.select("doc_id")))
    verified = _verified(pairs, sets).select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    crowded = _tiles(crowd).join(sets, "doc_id").groupBy("cell", "i", "j").applyInPandas(_open_links, "u long, v long")
    return cut_lineage(verified.union(crowded).distinct(), "open-links", sets)


def similar_groups(docs: DataFrame) -> DataFrame:
    """`doc_id, component_id` of every document whose doc_id is not null, for texts of Jaccard similarity 0.8 or more.

    Similarity is that of the sets of five-word shingles. A grid over fingerprints of the distinct words, which change less
    than shingles do, groups most of them; `missing_links` then links these groups wherever any two of their documents are
    similar, so no link is lost. Rows that share a doc_id are one document.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    marks = cut_lineage(_longest(wide_fingerprints(known)), "wide-fingerprints")
    found = components(similar_links(known, marks))
    labels = marks.select("doc_id").join(found, F.col("doc_id") == F.col("u"), "left")
    labels = cut_lineage(labels.select("doc_id", F.coalesce("v", "doc_id").alias("label")), "first-groups")
    merged = components(missing_links(known, labels, marks))
    return labels.join(merged, F.col("label") == F.col("u"), "left").select("doc_id", F.coalesce("v", "label").alias("component_id"))
