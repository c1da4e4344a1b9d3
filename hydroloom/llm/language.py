"""Language identification with bit-sliced Bloom filters of character n-grams.

Every slot of the filter is a word whose bit l belongs to language l, so one lookup tells all languages that hold an
n-gram: the words of its hash positions are combined by AND. A text is scored by the number of its n-grams in each
language, corrected for the filter's false positives. A language holds the n-grams that make up at least a stated share of
its training text, so the filter's size is bounded by parameters whatever the corpus.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.llm.text import map_batches

SIZES = (1, 2, 3, 4)
MIN_SHARE = 1e-5
HASHES = 3
SLICE = 63  # languages per word of a slot
UNDETERMINED = "und"
CACHED_WORDS = 300_000
# Superscripts, fractions and number letters are word characters but no letters.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMBERS}]+")
_RUNS = re.compile(r"[^\W\d_]+")  # runs that may hold such characters: a long class is slow, so few runs meet it
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    """Runs of letters of a text in lower case."""
    runs = _RUNS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in ((run,) if run.isalpha() else _LETTERS.findall(run))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, each framed by a space, and the number of the word each belongs to."""
    framed = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    for size in SIZES:
        if len(framed) < size:
            break
        last = len(framed) - size + 1
        value = np.full(last, size, np.uint64)
        for k in range(size):
            value = (value ^ framed[k : last + k]) * _MIX
            value ^= value >> np.uint64(29)
        inside = owner[:last] == owner[size - 1 :]
        if size == 1:
            inside &= framed != 32
        found.append(value[inside])
        owners.append(owner[:last][inside])
    return np.concatenate(found), np.concatenate(owners)


def gram_counts(docs: DataFrame) -> DataFrame:
    """`lang, gram, n`: weight of every n-gram in the texts of each language, counted per task before the shuffle."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(letter_words(text))
            for lang, words in by_lang.items():
                if not words:
                    continue
                values, owners = grams(list(words))
                weights = np.fromiter(words.values(), np.int64, len(words))[owners]
                names, inverse = np.unique(values, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * len(names),
                    "gram": names.view(np.int64),
                    "n": np.bincount(inverse, weights).astype(np.int64),
                }, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    return (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


@dataclass(frozen=True)
class Filters:
    """Slots of the bit-sliced filters, the languages of their bits, and each language's false-positive rate."""

    languages: tuple[str, ...]
    slots: np.ndarray  # slices x slots
    rates: np.ndarray

    def positions(self, values: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64(self.slots.shape[1] - 1)
        step = (values >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((values + np.uint64(k) * step) & mask).astype(np.int64)

    def masks(self, values: np.ndarray) -> np.ndarray:
        """slices x n-grams: bits of the languages that hold each n-gram."""
        found = np.full((self.slots.shape[0], len(values)), ~np.uint64(0))
        for at in self.positions(values):
            found &= self.slots[:, at]
        return found

    def word_hits(self, words: list[str]) -> np.ndarray:
        """Per word the number of its n-grams, then the hits of each language."""
        values, owners = grams(words)
        masks = self.masks(values)
        table = np.zeros((len(words), len(self.languages) + 1), np.int32)
        table[:, 0] = np.bincount(owners, minlength=len(words))
        for number in range(len(self.languages)):
            bit = (masks[number // SLICE] >> np.uint64(number % SLICE)) & np.uint64(1)
            table[:, number + 1] = np.bincount(owners[bit.astype(bool)], minlength=len(words))
        return table

    def predict(self, hits: np.ndarray) -> tuple[str, float]:
        """Language with most n-grams after the correction, and its corrected share; ties go to the first by name."""
        total = hits[0]
        if not total or not self.languages:
            return UNDETERMINED, 0.0
        share = (hits[1:] / total - self.rates) / (1 - self.rates)
        best = int(share.argmax())
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def build_filters(counts: DataFrame, min_share: float = MIN_SHARE) -> Filters:
    """Filters of the n-grams with at least `min_share` of a language's weight: at most 1/min_share for each language."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").filter(F.col("n") >= F.col("total") * F.lit(min_share)).select("lang", "gram")
    held = frequent.toPandas()
    languages = tuple(sorted(held["lang"].unique()))
    largest = int(held.groupby("lang").size().max()) if len(held) else 1
    slots = np.zeros((max(1, -(-len(languages) // SLICE)), 1 << max(10, (8 * largest - 1).bit_length())), np.uint64)
    filters = Filters(languages, slots, np.zeros(len(languages)))
    for number, lang in enumerate(languages):
        values = held.loc[held["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in filters.positions(values):
            slots[number // SLICE, at] |= np.uint64(1 << (number % SLICE))
        filled = ((slots[number // SLICE] >> np.uint64(number % SLICE)) & np.uint64(1)).mean()
        filters.rates[number] = filled**HASHES
    return filters


_known: dict = {}


def _score(texts: list[str], filters: Filters) -> list[tuple[str, float]]:
    """Predictions; hits of words already seen by this worker come from a bounded cache."""
    if _known.get("filters") is not filters or len(_known["row"]) > CACHED_WORDS:
        _known.update(filters=filters, row={}, table=np.zeros((0, len(filters.languages) + 1), np.int32))
    row = _known["row"]
    split = [letter_words(text) for text in texts]
    fresh = list(set().union(*split).difference(row)) if split else []
    if fresh:
        row.update(zip(fresh, range(len(row), len(row) + len(fresh)), strict=True))
        _known["table"] = np.concatenate([_known["table"], filters.word_hits(fresh)])
    table = _known["table"]
    return [
        filters.predict(table[np.fromiter(map(row.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.int64))
        if words else (UNDETERMINED, 0.0)
        for words in split
    ]


def held_out(doc_id: Column) -> Column:
    """Documents that no filter learns from: CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every whole text; learns from the documents not held out that name a language.

    A null text and one without letters is `und` with score 0, as is every text when nothing could be learnt. A null
    doc_id is not held out. Repeated rows give repeated results.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    filters = build_filters(gram_counts(docs.filter(~out)))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(ids: list, texts: list) -> dict[str, list]:
        found = _score(texts, shared.value)
        return {"doc_id": ids, "lang_pred": [lang for lang, _ in found], "score": [score for _, score in found]}

    scored = map_batches(docs, run, "doc_id long, lang_pred string, score double", slice_rows=200)
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score")
