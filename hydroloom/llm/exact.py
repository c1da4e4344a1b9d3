"""Exact deduplication by counting quotient filters and byte verification.

A fingerprint of 64 bits is cut into a quotient (its leading bits) and a remainder. Each task builds filters of its own
rows: for every block of 256 quotients the lengths of their runs, the sorted remainders and the counts. Filters of one
block merge without loss by their sorted remainders. Fingerprints that stand for one row only are done; the others are
routed to a grouping by the bytes of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.llm.text import ascii_lower, map_batches, whole_texts
from hydroloom.session import cut_lineage

RUNS = 8  # bits of the quotient inside a block
ROWS_PER_BLOCK = 100_000
ROWS_PER_FILTER = 1_000_000
SALTS = 64
BROADCAST_ROWS = 1_000_000  # fingerprints of eight bytes


def text_keys(docs: DataFrame) -> DataFrame:
    """`doc_id, fp, sha`: XXH64 (seed 42) and SHA-256 of the text with A-Z in lower case."""

    def run(ids: list, texts: list) -> dict[str, list]:
        normal = [text.encode().lower() for text in texts]
        marks = np.fromiter((xxhash.xxh64_intdigest(data, 42) for data in normal), np.uint64, len(normal))
        return {"doc_id": ids, "fp": marks.view(np.int64).tolist(), "sha": [hashlib.sha256(data).digest() for data in normal]}

    return map_batches(docs, run, "doc_id long, fp long, sha binary")


def pack_filter(values: np.ndarray, counts: np.ndarray, block_bits: int) -> dict[str, list]:
    """Blocks of a filter from sorted distinct fingerprints (unsigned) and their counts."""
    low = 64 - block_bits - RUNS
    quotient = values >> np.uint64(low)
    block = (quotient >> np.uint64(RUNS)).astype(np.int64)
    remainder = values & np.uint64((1 << low) - 1)
    names, starts = np.unique(block, return_index=True)
    ends = np.append(starts[1:], len(block))
    runs = [np.bincount((quotient[a:b] & np.uint64(255)).astype(np.int64), minlength=256) for a, b in zip(starts, ends, strict=True)]
    return {
        "block": names.tolist(),
        "runs": [r.astype(np.uint32).tobytes() for r in runs],
        "remainders": [remainder[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
        "counts": [counts[a:b].astype(np.int64).tobytes() for a, b in zip(starts, ends, strict=True)],
    }


def unpack_block(block: int, runs: bytes, remainders: bytes, block_bits: int) -> np.ndarray:
    """Sorted fingerprints of a block."""
    low = 64 - block_bits - RUNS
    quotient = np.repeat(np.arange(256, dtype=np.uint64), np.frombuffer(runs, np.uint32))
    return (((np.uint64(block) << np.uint64(RUNS)) | quotient) << np.uint64(low)) | np.frombuffer(remainders, np.uint64)


def merge_blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted fingerprints and add the counts of equal ones."""
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))[: len(values)]
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(keys: DataFrame, blocks: int) -> DataFrame:
    """`fp, n` of the fingerprints with a count above one, by merging the filters of all tasks block by block."""
    block_bits = max(1, (max(2, blocks) - 1).bit_length())
    schema = "block long, runs binary, remainders binary, counts binary"

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict(
                pack_filter(values, counts, block_bits),
                schema=pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("runs", "remainders", "counts")]]),
            )

        for batch in source:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) > ROWS_PER_FILTER:
                yield flush()
        if held:
            yield flush()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [
            (unpack_block(key[0], r.runs, r.remainders, block_bits), np.frombuffer(r.counts, np.int64))
            for r in rows.itertuples()
        ]
        values, counts = merge_blocks(parts)
        several = counts > 1
        return pd.DataFrame({"fp": values[several].view(np.int64), "n": counts[several]})

    filters = keys.select("fp").mapInArrow(build, schema)
    return filters.groupBy("block").applyInPandas(merge, "fp long, n long")


def equal_texts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """`sha, keep_id, group_size` of the texts whose fingerprint is in `repeated`, grouped by their bytes.

    Up to BROADCAST_ROWS fingerprints are broadcast and texts are counted before their shuffle. Beyond that both sides
    are shuffled, salted by document; the copies of a hot text are then one row per salt when they come together.
    """
    texts = (
        whole_texts(docs)
        .select("doc_id", ascii_lower(F.col("text")).alias("normal"))
        .select("doc_id", "normal", F.xxhash64("normal").alias("fp"), F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    )
    if repeated.count() <= BROADCAST_ROWS:
        found = texts.join(F.broadcast(repeated.select("fp")), "fp")
    else:
        salted = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        found = texts.join(salted.hint("merge"), ["fp", "salt"])
    return (
        found.groupBy("fp", "salt", "normal")
        .agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .groupBy("fp", "normal")
        .agg(F.max("last").alias("keep_id"), F.sum("n").alias("group_size"))
        .select(F.unhex(F.sha2("normal", 256)).alias("sha"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when their bytes are, after lower-casing A-Z; the row with the largest doc_id stays. A null text
    counts as empty; rows that repeat the kept doc_id with the same text are all marked kept; a null doc_id is smaller
    than any other.
    """
    keys = cut_lineage(text_keys(docs), "exact-keys")
    repeated = cut_lineage(repeated_fingerprints(keys, keys.count() // ROWS_PER_BLOCK + 16), "exact-repeated")
    # A table of its own, so that adaptive execution can split the join on a hot text.
    groups = cut_lineage(equal_texts(docs, repeated), "exact-texts")
    return keys.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
