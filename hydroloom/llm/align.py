"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both token sequences of a text are arrays of end offsets in its bytes. Where they run one to one, the ends at a constant
shift of the index are equal: exponential probing compares ever longer pieces of both arrays at the current shift and jumps the
whole stretch. At an irregular place the side that is behind moves on until both end together; the tokens passed are
a group, and the shift is updated. Tokens of a group are linked. How many documents hold a pair of token ids linked is counted over
the whole corpus and handed back to the documents by slices of them, so that a pair travels once for a slice, not once
for each document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.llm.bpe import CACHED_PIECES, Packed, Splitter
from hydroloom.llm.text import whole_texts
from hydroloom.session import cut_lineage

SLICE_DOCS, SLICE_BYTES = 2000, 4_000_000  # a slice ends once it holds so many documents or bytes of text
BATCH_DOCS, BATCH_BYTES = 200, 1_000_000  # texts that are tokenized and aligned at once
PROBE = 4  # tokens of the first probe; each further one is twice as long
WIDE = 4096  # links of a group above which it is counted by its different ids
_SPACE = "▁"


def _byte_levels() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: a printable Latin-1 byte is itself, the others count up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class First:
    """Byte-level BPE from a `tokenizers` file; special tokens in a text are plain text.

    Matches of the vocabulary's own pattern are tokenized apart from each other, so every different one is asked for once.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        levels = _byte_levels()
        self.strings = [b""] * self.model.get_vocab_size(with_added_tokens=True)
        for token, number in self.model.get_vocab(with_added_tokens=True).items():
            known = all(c in levels for c in token)
            self.strings[number] = bytes(levels[c] for c in token) if known else token.encode()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(" " + text) for text in texts]
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        fresh = list(set().union(*split).difference(self.known))
        for piece, own in zip(fresh, self.model.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(own.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32) for pieces in split]


class Second:
    """Pieces of a `sentencepiece` model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.strings = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)
        ]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(own, np.int32) for own in self.model.encode(texts, num_threads=1)]


def _runs(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Stretches of one-to-one tokens (first token of A and of B, length) and the other groups' last tokens, flat by twos.

    Both lists end with the same offset.
    """
    starts, lengths, last_a, last_b = [], [], [], []
    i = j = 0
    total_a, total_b = len(ends_a), len(ends_b)
    while i < total_a and j < total_b:
        if ends_a[i] == ends_b[j]:
            begin, width = i, PROBE
            shift = j - i
            i += 1
            while True:
                left, right = ends_a[i : i + width], ends_b[i + shift : i + shift + width]
                if left == right and len(left) == width:
                    i += width
                    width *= 2
                    continue
                # The stretch ends inside this probe: halve it until the first difference is found.
                low, high = 0, min(len(left), len(right))
                while low < high:
                    middle = (low + high + 1) // 2
                    if left[low:middle] == right[low:middle]:
                        low = middle
                    else:
                        high = middle - 1
                i += low
                break
            starts += (begin, begin + shift)
            lengths.append(i - begin)
            j = i + shift
            continue
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        last_a.append(i)
        last_b.append(j)
        i += 1
        j += 1
    return starts, lengths, last_a, last_b


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token of A and of B of every group, by diagonal run skipping; the last ends must be equal."""
    starts, lengths, last_a, last_b = _runs(ends_a.tolist(), ends_b.tolist())
    size = np.array(lengths, np.int64)
    from_a, from_b = np.array(starts, np.int64).reshape(-1, 2).T
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    a = np.concatenate([np.repeat(from_a, size) + inside, np.array(last_a, np.int64)])
    b = np.concatenate([np.repeat(from_b, size) + inside, np.array(last_b, np.int64)])
    order = np.argsort(a)
    return a[order], b[order]


class Aligner:
    """Both tokenizers with their byte tables and decimals."""

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        self.a, self.b = First(path_a, pattern), Second(path_b)
        self.bytes_a, self.bytes_b = Packed(self.a.strings), Packed(self.b.strings)
        self.size_b = len(self.b.strings)
        top = max(len(self.a.strings), self.size_b)
        # Number 3 * id + k is the id in decimal with one of three marks behind it.
        self.decimals = Packed([f"{number}{mark}".encode() for number in range(top) for mark in ",|;"])

    def _kept(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tokens of every text, none where the bytes of either side are not those of the text."""
        ids_a, ids_b = self.a(texts), self.b(texts)
        out_a, out_b = [], []
        for text, a, b in zip(texts, ids_a, ids_b, strict=True):
            data = b" " + text.encode()
            same = bool(text) and self.bytes_a.gather(a) == data == self.bytes_b.gather(b)
            out_a.append(a if same else a[:0])
            out_b.append(b if same else b[:0])
        return out_a, out_b

    def run(self, texts: list[str]) -> dict[str, list]:
        """Counts, digest of the groups and different pairs (with how often they are linked) of each text."""
        kept_a, kept_b = self._kept(texts)
        n_a, n_b = (np.fromiter(map(len, kept), np.int64, len(texts)) for kept in (kept_a, kept_b))
        a, b = (np.concatenate(kept).astype(np.int64) for kept in (kept_a, kept_b))
        # One sequence for all texts: every text ends at the same offset on both sides, so no group crosses it.
        end_a, end_b = group_ends(np.cumsum(self.bytes_a.sizes[a]), np.cumsum(self.bytes_b.sizes[b]))
        group_of = np.repeat(np.arange(len(texts)), n_a)[end_a] if len(end_a) else np.zeros(0, np.int64)
        n_groups = np.bincount(group_of, minlength=len(texts))
        in_a, in_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, group_of, in_a * in_b)
        texts_of, pairs, times = self._pairs(a, b, end_a, end_b, in_a, in_b, group_of)
        cuts = np.searchsorted(texts_of, np.arange(len(texts) + 1))
        return {
            "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(),
            "groups_sha256": self._digests(a, b, end_a, end_b, in_a, in_b, n_a, n_b),
            "pairs": [pairs[s:e] for s, e in zip(cuts, cuts[1:], strict=False)],
            "times": [times[s:e] for s, e in zip(cuts, cuts[1:], strict=False)],
        }

    def _digests(self, a, b, end_a, end_b, in_a, in_b, n_a, n_b) -> list[str]:
        """Hash of `a1,a2|b1;a3|b2` of each text, both sides' tokens being put in place by their groups."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[end_a], mark_b[end_b] = 1, 2
        before_b, upto_a = np.repeat(end_b + 1 - in_b, in_a), np.repeat(end_a + 1, in_b)
        line = np.zeros(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + before_b] = 3 * a + mark_a
        line[np.arange(len(b)) + upto_a] = 3 * b + mark_b
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
        return [
            hashlib.sha256(self.decimals.gather(line[s:e])[:-1]).hexdigest() if e > s else ""
            for s, e in zip(cuts, cuts[1:], strict=False)
        ]

    def _pairs(self, a, b, end_a, end_b, in_a, in_b, group_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair and how often it is linked, by text and pair, once each."""
        links = in_a * in_b
        plain = links <= WIDE
        size = np.where(plain, links, 0)
        group = np.repeat(np.arange(len(links)), size)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        left = end_a[group] + 1 - in_a[group] + inside // in_b[group]
        right = end_b[group] + 1 - in_b[group] + inside % in_b[group]
        texts, pairs, times = [group_of[group]], [a[left] * self.size_b + b[right]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(~plain):
            # A long group: its different ids with their counts, so that repeats are not written out.
            own_a, times_a = np.unique(a[end_a[g] + 1 - in_a[g] : end_a[g] + 1], return_counts=True)
            own_b, times_b = np.unique(b[end_b[g] + 1 - in_b[g] : end_b[g] + 1], return_counts=True)
            pairs.append((own_a[:, None] * self.size_b + own_b[None, :]).ravel())
            times.append((times_a[:, None] * times_b[None, :]).ravel())
            texts.append(np.full(len(pairs[-1]), group_of[g]))
        text, pair, time = map(np.concatenate, (texts, pairs, times))
        order = np.lexsort((pair, text))
        text, pair, time = text[order], pair[order], time[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(new)
        return text[first], pair[first], np.add.reduceat(time, first) if len(first) else time


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    return Aligner(path_a, path_b, pattern)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "slice long, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, pairs array<long>, times array<long>"


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """Counts, digest and linked pairs of every document, and the slice it belongs to: neighbours in one input partition."""
    arrow = _arrow_schema(ALIGNED)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(path_a, path_b, pattern)
        number = TaskContext.get().partitionId() << 32
        docs_in = bytes_in = 0
        for batch in source:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < BATCH_DOCS and (size < BATCH_BYTES or end == at):
                    size += len(texts[end])
                    end += 1
                found = aligner.run(texts[at:end])
                rows = end - at
                found |= {"slice": [number] * rows, "doc_id": ids[at:end]}
                yield pa.RecordBatch.from_pydict({f.name: found[f.name] for f in arrow}, schema=arrow)
                docs_in, bytes_in, at = docs_in + rows, bytes_in + size, end
                if docs_in >= SLICE_DOCS or bytes_in >= SLICE_BYTES:
                    number, docs_in, bytes_in = number + 1, 0, 0

    return whole_texts(docs).mapInArrow(run, ALIGNED)


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """`pair, n, best`: documents that hold a pair linked, and whether no other pair of its first id has more."""
    # Explode and count in one stage: the partial counts of a task leave it once for each different pair.
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts, "pair-counts")
    top = counts.groupBy(F.expr(f"pair div {size_b}").alias("first")).agg(F.max("n").alias("top"))
    return counts.join(top, F.expr(f"pair div {size_b}") == F.col("first")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` of every document.

    A null or empty text, and one whose bytes either tokenizer does not give back, has no tokens: zeros and an empty
    digest. Repeated rows count as documents of their own. The files are read by the workers from their paths; `pattern` is
    the one by which the first vocabulary cuts texts.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    table = cut_lineage(aligned(docs, path_a, path_b, pattern), "aligned-tokens")
    scored = pair_counts(table, size_b)
    own = table.select("slice", F.explode("pairs").alias("pair")).distinct()
    own = cut_lineage(own, "slice-pairs")  # a table, so that the join can split the partitions of a frequent pair
    known = own.join(scored, "pair").select("slice", "pair", "n", "best")
    out = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", n_best long, count_sum long, groups_sha256 string"
    arrow = _arrow_schema(out)

    def fill(docs_: pa.Table, pairs_: pa.Table) -> pa.Table:
        """A slice of documents with the counts of all its pairs."""
        names = pairs_.column("pair").to_numpy()
        order = np.argsort(names)
        names, n = names[order], pairs_.column("n").to_numpy()[order]
        best = pairs_.column("best").to_numpy()[order].astype(np.int64)
        lists, times = (docs_.column(c).combine_chunks() for c in ("pairs", "times"))
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        at = np.searchsorted(names, lists.flatten().to_numpy())
        weight = times.flatten().to_numpy()
        ends = np.cumsum(sizes)
        sums = []
        for values in (weight * best[at], weight * n[at]):
            running = np.concatenate([[0], np.cumsum(values)])
            sums.append(running[ends] - running[ends - sizes])
        found = {c: docs_.column(c) for c in ("doc_id", *_COUNTS, "groups_sha256")} | {"n_best": sums[0], "count_sum": sums[1]}
        return pa.table([found[f.name] for f in arrow], schema=arrow)

    return table.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(fill, out)
