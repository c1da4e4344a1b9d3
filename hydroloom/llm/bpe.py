"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of text are dealt into matrices by length, one piece a row, padded on the right. In each round every row merges
its leftmost pair of minimum rank: the ranks of all neighbouring pairs stand in a second matrix, `argmin` finds the pair,
both matrices close the gap, and only the two pairs that touch the new token are looked up again. Rows without a pair to
merge leave the matrix. Pairs are found in an open-addressing hash table of numpy arrays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from hydroloom.llm.text import map_batches

NONE = np.int32(2**31 - 1)
CELLS = 1 << 19
LONG_PIECE = 1024
CACHED_PIECES = 600_000
_SLOT_BITS = 20
_PLACE_BITS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """Ranks of a vocabulary file as a hash table over pairs of token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.first = np.full(256, -1, np.int32)
        for value in range(256):
            self.first[value] = ranks[bytes([value])]
        left, right, rank = [], [], []
        for token, own in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(own)
        keys = self._key(np.array(left, np.int64), np.array(right, np.int64))
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.ranks = np.full(1 << _SLOT_BITS, NONE, np.int32)
        waiting, at, step = np.arange(len(keys)), self._slot(keys), 0
        values = np.array(rank, np.int32)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[waiting[free]]
            won = self.slots[at] == keys[waiting]
            self.ranks[at[won]] = values[waiting[won]]
            waiting, at, step = waiting[~won], (at[~won] + 1) & (len(self.slots) - 1), step + 1
        self.steps = step
        self._pairs: dict[int, int] | None = None

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge or one side is padding (-1)."""
        keys = self._key(left, right)
        at = self._slot(keys)
        found = np.where(self.slots[at] == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        for _ in range(self.steps):
            if not len(open_):
                break
            at_open = (at[open_] + 1) & (len(self.slots) - 1)
            at[open_] = at_open
            hit = self.slots[at_open] == keys[open_]
            found[open_[hit]] = self.ranks[at_open[hit]]
            open_ = open_[~hit & (self.slots[at_open] >= 0)]
        found[(left < 0) | (right < 0)] = NONE
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            if width > LONG_PIECE:
                out[order[at]] = self._encode_long(pieces[order[at]])
                at += 1
                continue
            # Pieces up to a quarter longer than the shortest share a matrix.
            top = min(LONG_PIECE, width + max(1, width // 4))
            end = int(np.searchsorted(lengths[order], top, side="right"))
            end = min(end, at + max(1, CELLS // max(1, top)))
            rows = order[at:end]
            for row, ids in zip(rows, self._encode_rows([pieces[r] for r in rows], lengths[rows]), strict=True):
                out[row] = ids
            at = end
        return out

    def _encode_rows(self, pieces: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        width = int(lengths.max(initial=0))
        out: list[list[int]] = [[] for _ in pieces]
        if not width:
            return out
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.first[flat], np.int32(-1))
        ranks = np.full((len(pieces), width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows = np.arange(len(pieces))
        while len(rows):
            best = ranks.argmin(axis=1)
            local = np.arange(len(rows))
            rank = ranks[local, best]
            done = rank == NONE
            if done.any():
                for row, line in zip(rows[done], ids[done].tolist(), strict=True):
                    out[row] = line[: line.index(-1)] if line[-1] < 0 else line
                going = ~done
                rows, ids, ranks, best, rank = rows[going], ids[going], ranks[going], best[going], rank[going]
                if not len(rows):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :used], ranks[:, :used]
                local = np.arange(len(rows))
            # The right half of the pair goes, what stands behind it moves up by one.
            size = ids.shape[1]
            source = np.arange(size) + (np.arange(size) > best[:, None])
            source[:, -1] = np.minimum(source[:, -1], size - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[local, best] = rank
            after = np.where(best + 1 < size, ids[local, np.minimum(best + 1, size - 1)], -1)
            ranks[local, best] = self.rank(rank, after)
            with_left = np.flatnonzero(best > 0)
            before = best[with_left] - 1
            ranks[with_left, before] = self.rank(ids[with_left, before], rank[with_left])
        return out

    def _encode_long(self, piece: bytes) -> list[int]:
        """One row of its own as a linked list: a heap holds its pairs by rank, then place, so work grows as n log n."""
        row = self.first[np.frombuffer(piece, np.uint8)]
        ids, size = array("i", row.tobytes()), len(row)
        after, before = array("q", range(1, size + 1)), array("q", range(-1, size - 1))
        ranks = self.rank(row[:-1], row[1:])
        merging = np.flatnonzero(ranks != NONE)
        heap = ((ranks[merging].astype(np.int64) << _PLACE_BITS) | merging).tolist()
        heapify(heap)
        known = self._by_pair()
        while heap:
            rank, at = divmod(heappop(heap), 1 << _PLACE_BITS)
            right = after[at]
            # A pair that changed since it was pushed is skipped; its new form has an entry of its own.
            if ids[at] < 0 or right == size or known.get((ids[at] << 32) | ids[right]) != rank:
                continue
            ids[at], ids[right] = rank, -1
            after[at] = further = after[right]
            if further < size:
                before[further] = at
                joined = known.get((rank << 32) | ids[further])
                if joined is not None:
                    heappush(heap, (joined << _PLACE_BITS) | at)
            left = before[at]
            if left >= 0:
                joined = known.get((ids[left] << 32) | rank)
                if joined is not None:
                    heappush(heap, (joined << _PLACE_BITS) | left)
        return [token for token in ids if token >= 0]

    def _by_pair(self) -> dict[int, int]:
        """The hash table's entries as a dictionary, for lookups one at a time; made when first needed."""
        if self._pairs is None:
            used = np.flatnonzero(self.slots >= 0)
            self._pairs = dict(zip(self.slots[used].tolist(), self.ranks[used].tolist(), strict=True))
        return self._pairs


def read_ranks(path: str) -> bytes:
    """Content of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as file:
        return file.read()


class Splitter:
    """Matches of a pattern, by the standard library's engine where a text is Latin-1, else by `regex`.

    Both give the same pieces: the classes of letters and numbers are written out for the first 256 characters, and texts
    with the four separators that only the standard library calls white space go to `regex`.
    """

    def __init__(self, pattern: str) -> None:
        self.wide = regex.compile(pattern)
        latin = "".join(map(chr, range(256)))
        narrow = pattern
        for kind in ("L", "N"):
            members = "".join(regex.findall(rf"\p{{{kind}}}", latin))
            narrow = re.sub(rf"\[([^\]]*)\\p\{{{kind}\}}", lambda m, own=members: f"[{m[1]}{own}", narrow)
            narrow = narrow.replace(f"\\p{{{kind}}}", f"[{members}]")
        self.narrow = re.compile(narrow)

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        if any(mark in text for mark in "\x1c\x1d\x1e\x1f"):
            return self.wide.findall(text)
        return self.narrow.findall(text)


@lru_cache(maxsize=2)
def _model(content: bytes, pattern: str):
    """Merge table, splitter, cache of pieces, and the tables of token bytes and decimals of a Python worker."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    merges = Merges(ranks)
    top = max(merges.bytes_of) + 1
    tokens = Packed([merges.bytes_of.get(i, b"") for i in range(top)])
    return merges, Splitter(pattern), {}, tokens, Packed([b"%d " % i for i in range(top)])


class Packed:
    """Byte strings by number, joined, so that numpy gathers the strings of an array of numbers in one step."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, numbers: np.ndarray) -> bytes:
        size = self.sizes[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.joined[np.repeat(self.starts[numbers] - (ends - size), size) + np.arange(total)].tobytes()


def encode_texts(texts: list[str], content: bytes, pattern: str) -> list[np.ndarray]:
    """Token ids of each text."""
    merges, splitter, known, _, _ = _model(content, pattern)
    split = [splitter(text) for text in texts]
    if len(known) > CACHED_PIECES:
        known.clear()
    fresh = list(set().union(*split).difference(known))
    for piece, ids in zip(fresh, merges.encode([piece.encode() for piece in fresh]), strict=True):
        known[piece] = pack(f"{len(ids)}i", *ids)
    return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in split]


def decimals(ids: np.ndarray, content: bytes, pattern: str) -> bytes:
    """Ids in decimal, joined by one space."""
    return _model(content, pattern)[4].gather(ids)[:-1]


def decode_ids(ids: np.ndarray, content: bytes, pattern: str) -> bytes:
    """Bytes of the tokens."""
    return _model(content, pattern)[3].gather(ids)


def encode_decode(docs: DataFrame, content: bytes, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: `doc_id, n_tokens, ids_sha256, decoded_sha256`, and `ids` if asked for.

    A null text counts as empty and has no tokens; a text of any length is one row; repeated rows give repeated results;
    an empty table gives none. No shuffle: each task streams its documents in slices and holds the vocabulary (broadcast;
    its size is that of the file) and a bounded cache of pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(ids: list, texts: list) -> dict[str, list]:
        coded = encode_texts(texts, shared.value, pattern)
        found = {
            "doc_id": ids,
            "n_tokens": [len(own) for own in coded],
            "ids_sha256": [hashlib.sha256(decimals(own, shared.value, pattern)).hexdigest() for own in coded],
            "decoded_sha256": [hashlib.sha256(decode_ids(own, shared.value, pattern)).hexdigest() for own in coded],
        }
        if keep_ids:
            found["ids"] = [own.tolist() for own in coded]
        return found

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(docs, run, schema, slice_rows=200)
