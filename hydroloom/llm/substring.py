"""Substring deduplication over sliding spans of sentences.

A sentence ends with a word that closes with `.`, `!` or `?`, or at a line break. A sentence of more than `LONG` words is cut into
units, which count as sentences: cuts follow the words with the least hash of each `CUT` words in a row, so that a passage is
cut alike wherever it stands. A span is a run of at least two consecutive sentences with at least `MIN_WORDS` words, as
short as its first sentence or as its last one allows. All spans of all documents are hashed and meet globally; a sentence
goes when any span that covers it is a repeat of an earlier span (the first one by document and position stays).

Of a passage of 51 words, all cuts from its tenth to its 42nd word are the same wherever it stands, and no two are more than ten
words apart: at least 14 words in two or more whole units are found again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.llm.text import whole_texts
from hydroloom.session import cut_lineage

MIN_WORDS = 12
LONG = 16
CUT = 10
SLICE_DOCS, SLICE_BYTES = 2000, 8_000_000  # a slice ends once it holds so many documents or characters
CACHED_WORDS = 500_000
_PIECE = re.compile(r"\s*\S+\s*")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words:
    """Hash of each word (lower case, no white space around) and whether it ends a sentence; a bounded cache of a worker."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.ends = np.zeros(1 << 12, bool)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.number) > CACHED_WORDS:
            self.number.clear()
        for piece in set().union(*texts).difference(self.number):
            at = len(self.number)
            if at == len(self.hashes):
                self.hashes, self.ends = np.concatenate([self.hashes] * 2), np.concatenate([self.ends] * 2)
            word = piece.strip()
            self.hashes[at] = xxhash.xxh3_64_intdigest(word.lower())
            self.ends[at] = word.rstrip("\"')]}”’»").endswith((".", "!", "?")) or "\n" in piece
            self.number[piece] = at

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))


_words = _Words()


class _Powers:
    """Powers of the factors and of their inverses, as far as the longest text needed them."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64)] * 2
        self.down = [np.ones(1, np.uint64)] * 2

    def upto(self, count: int) -> None:
        if len(self.up[0]) <= count:
            size = max(2 * len(self.up[0]), count + 1)
            for k, factor in enumerate(_FACTORS.tolist()):
                for kind, base in ((self.up, factor), (self.down, pow(factor, -1, 1 << 64))):
                    kind[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))


_powers = _Powers()


def pieces_of(text: str) -> list[str]:
    """Words with the white space around them; joined they are the text, unless it has no word at all."""
    return _PIECE.findall(text)


def unit_ends(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of words before the end of each sentence or unit."""
    count = len(hashes)
    close = np.flatnonzero(ends) + 1
    if not len(close) or close[-1] < count:
        close = np.append(close, count)
    size = np.diff(close, prepend=0)
    if size.max(initial=0) <= LONG:
        return close
    # The word with the least hash of any CUT words of one long sentence is the last of its unit; of equal hashes the last one.
    rows = np.lib.stride_tricks.sliding_window_view(hashes, CUT)
    sentence = np.repeat(np.arange(len(size)), size)
    inside = (sentence[: len(rows)] == sentence[CUT - 1 :]) & (size[sentence[: len(rows)]] > LONG)
    first = np.flatnonzero(inside)
    cuts = first + CUT - rows[first, ::-1].argmin(axis=1)
    return np.union1d(close, cuts)


def spans(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-the-last sentence of every span, given the words before the end of each sentence."""
    total = np.concatenate([[0], ends])
    count = len(ends)
    starts = np.arange(count)
    until = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), starts + 2)
    fits = until <= count
    lasts = np.arange(1, count + 1)
    begin = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1, lasts - 2)
    known = begin >= 0
    both = np.concatenate([starts[fits] * (count + 1) + until[fits], begin[known] * (count + 1) + lasts[known]])
    both = np.unique(both)
    return both // (count + 1), both % (count + 1)


def span_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """128 bits for the words from `low` to before `high` of each span: two polynomials of the word hashes, mixed."""
    _powers.upto(len(hashes))
    out = np.empty((len(low), 2), np.uint64)
    for k in range(2):
        # With prefix sums of w[i] * f**-i, a span's polynomial is a difference times a power: no loop over words.
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _powers.down[k][: len(hashes)], out=sums[1:])
        value = (sums[high] - sums[low]) * _powers.up[k][low] + (high - low).astype(np.uint64) * _MIX[k]
        for shift, mix in ((30, _MIX[0]), (27, _MIX[1])):
            value = (value ^ (value >> np.uint64(shift))) * mix
        out[:, k] = value ^ (value >> np.uint64(31))
    return out.view(np.int64)


class Cut:
    """A text in words and sentences, with its spans."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        numbers = _words.numbers(self.pieces)
        hashes = _words.hashes[numbers]
        self.ends = unit_ends(hashes, _words.ends[numbers]) if len(hashes) else np.zeros(0, np.int64)
        self.first, self.behind = spans(self.ends)
        total = np.concatenate([[0], self.ends])
        self.marks = span_hashes(hashes, total[self.first], total[self.behind])

    def without(self, chosen: np.ndarray) -> tuple[int, str]:
        """Sentences that the chosen spans cover, and the text without them."""
        edge = np.zeros(len(self.ends) + 1, np.int64)
        np.add.at(edge, self.first[chosen], 1)
        np.add.at(edge, self.behind[chosen], -1)
        gone = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], self.ends]).tolist()
        kept = ["".join(self.pieces[total[k] : total[k + 1]]) for k in np.flatnonzero(~gone).tolist()]
        return int(gone.sum()), "".join(kept)


def cut_all(texts: list[str]) -> Iterator[Cut]:
    for at in range(0, len(texts), 100):
        split = [pieces_of(text) for text in texts[at : at + 100]]
        _words.learn(split)
        yield from map(Cut, split)


def _tie(text: str) -> int:
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def sliced(docs: DataFrame) -> DataFrame:
    """`slice, doc_id, text`: neighbours in one partition, some thousand of them, are a slice."""
    schema = pa.schema([("slice", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, count, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in source:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([pa.array([number] * part.num_rows, pa.int64()), part.column(0), part.column(1).cast(pa.string())], schema=schema)
                count, size = count + part.num_rows, size + part.column(1).nbytes
                if count >= SLICE_DOCS or size >= SLICE_BYTES:
                    number, count, size = number + 1, 0, 0

    return whole_texts(docs).mapInArrow(run, "slice long, doc_id long, text string")


def _distinct_places(ids: list, ties: np.ndarray, who: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """1 for each row of equal spans, in the order of their places, whose place is not that of the row before it."""
    known = np.array([doc_id is not None for doc_id in ids])
    number = np.array([doc_id or 0 for doc_id in ids], np.int64)
    same = np.zeros(len(who), bool)
    a, b = who[1:], who[:-1]
    same[1:] = (known[a] == known[b]) & (number[a] == number[b]) & (ties[a] == ties[b]) & (at[1:] == at[:-1])
    return (new | ~same).astype(np.int64)


def span_table(table: DataFrame) -> DataFrame:
    """`slice, a, b, doc_id, place`: the spans of a slice once each, with the first place that has them.

    A place is a hash of the text in 32 bits, the first sentence in 31, and a last bit for spans that the slice repeats. Places of
    one doc_id are in order; repeated rows have the same ones.
    """
    schema = pa.schema([(name, pa.int64()) for name in ("slice", "a", "b", "doc_id", "place")])

    def emit(number: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        # Texts in the order of their places, so that the first row of a span has its first place.
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, _tie(texts[k])))
        marks, owner, start = [], [], []
        for k, own in zip(order, cut_all([texts[k] for k in order]), strict=True):
            marks.append(own.marks)
            owner.append(np.full(len(own.marks), k))
            start.append(own.first)
        mark, who, at = np.concatenate(marks), np.concatenate(owner), np.concatenate(start)
        if not len(mark):
            return
        by = np.lexsort((np.arange(len(mark)), mark[:, 1], mark[:, 0]))
        new = np.ones(len(by), bool)
        new[1:] = (mark[by[1:]] != mark[by[:-1]]).any(axis=1)
        first = by[new]
        ties = np.array([_tie(text) for text in texts], np.int64)
        # Two rows alike in doc_id and text are one document: their spans repeat nothing.
        twice = np.add.reduceat(_distinct_places(ids, ties, who[by], at[by], new), np.flatnonzero(new)) > 1
        place = (ties[who[first]] << 32) | (at[first] << 1) | twice
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first), number)), pa.array(mark[first, 0]), pa.array(mark[first, 1]),
            pa.array(ids, pa.int64()).take(pa.array(who[first])), pa.array(place),
        ], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts = None, [], []
        for batch in source:
            for slice_, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if slice_ != number and ids:
                    yield from emit(number, ids, texts)
                    ids, texts = [], []
                number = slice_
                ids.append(doc_id)
                texts.append(text)
        if ids:
            yield from emit(number, ids, texts)

    return table.mapInArrow(run, "slice long, a long, b long, doc_id long, place long")


def repeats(found: DataFrame) -> DataFrame:
    """`slice, a, b, doc_id, place`: spans of a slice that stand more than once anywhere, with their first place of all.

    A span is a row for each slice that has it, however many documents repeat it, and all rows meet in one shuffle.
    """
    same = W.partitionBy("a", "b")
    first = F.min(F.struct("doc_id", F.shiftright("place", 1).alias("place"))).over(same)
    often = (F.count("*").over(same) > 1) | (F.max(F.col("place").bitwiseAND(F.lit(1))).over(same) > 0)
    return found.select("slice", "a", "b", first.alias("p"), often.alias("often")).filter("often").select("slice", "a", "b", "p.*")


def dedup(docs: DataFrame) -> DataFrame:
    """`doc_id, n_sentences, n_removed, text` of every document, `text` being what is kept.

    A null or empty text, and one of white space alone, has no sentences and stays as it is. Rows are told apart by doc_id and text: rows
    that share a doc_id, or have none, lose only what stands earlier elsewhere, and repeated rows are one document, with equal
    results. A null doc_id comes before all others; rows of one doc_id follow a hash of their texts.
    """
    table = cut_lineage(sliced(docs), "sliced-texts")
    known = cut_lineage(repeats(span_table(table)), "repeated-spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def remove(texts: pa.Table, firsts: pa.Table) -> pa.Table:
        a, b, place = (firsts.column(c).to_numpy() for c in ("a", "b", "place"))
        order = np.lexsort((b, a))
        a, b, place = a[order], b[order], place[order]
        ids = firsts.column("doc_id").combine_chunks().take(pa.array(order))
        absent, number = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        again = len(a) > 1 and bool((a[1:] == a[:-1]).any())  # equal first halves of different spans: not in practice
        out: dict[str, list] = {"n_sentences": [], "n_removed": [], "text": []}
        whole = texts.column("text").to_pylist()
        for doc_id, text, own in zip(texts.column("doc_id").to_pylist(), whole, cut_all(whole), strict=True):
            removed, kept = 0, text
            if len(a) and len(own.marks):
                at = np.minimum(np.searchsorted(a, own.marks[:, 0]), len(a) - 1)
                while again and (step := (a[at] == own.marks[:, 0]) & (b[at] < own.marks[:, 1]) & (at + 1 < len(a))).any():
                    at = at + step
                known = (a[at] == own.marks[:, 0]) & (b[at] == own.marks[:, 1])
                first = (absent[at] == (doc_id is None)) & (number[at] == (doc_id or 0)) & (place[at] == (_tie(text) << 31) + own.first)
                chosen = np.flatnonzero(known & ~first)
                if len(chosen):
                    removed, kept = own.without(chosen)
            out["n_sentences"].append(len(own.ends))
            out["n_removed"].append(removed)
            out["text"].append(kept)
        return pa.table([texts.column("doc_id"), *(pa.array(out[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    return table.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(
        remove, "doc_id long, n_sentences long, n_removed long, text string"
    )
