"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation maximisation over the counts of
vote patterns of the whole corpus estimates how each labeller votes on good and on bad documents, and so the probability
that a pattern is good. Those posteriors train a linear scorer over hashed word shapes and binned signals.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.llm.text import map_batches
from hydroloom.session import cut_lineage

LABELLERS = ("symbols", "capitals", "shouts", "top_word", "stutter", "variety", "lines", "letters", "length", "stops")
DIMENSIONS = 1024
SAMPLE_ROWS = 8_000  # bound of the rows that the scorer is fitted on; votes and posteriors cover all rows
EM_ROUNDS = 100
CACHED_WORDS = 300_000
_LARGEST = 2**63 - 1
REJECT_BELOW = 0.4  # below even odds, so that a doubtful document stays

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()’„“”«»¿¡–—-]")
_RUN = re.compile(r"(.)\1+", re.DOTALL)


class _Kinds(dict):
    """Translation of characters to their kinds: capital A, other letter a, digit 0, all else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_kinds = _Kinds()


def shape(word: str) -> str:
    """Kinds of characters of a word, runs of one kind as one: `Then,` is `Aa,`."""
    return _RUN.sub(r"\1", word.translate(_kinds))


def slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


def _word_row(word: str) -> tuple[int, ...]:
    """Letters, capitals, characters, symbol, shout, stop, slot of the shape."""
    kinds = word.translate(_kinds)
    capitals = kinds.count("A")
    return (
        kinds.count("a") + capitals, capitals, len(word), int(_SYMBOL.search(word) is not None),
        int(word.endswith("!")), int(word.endswith((".", "!", "?"))), slot("shape " + _RUN.sub(r"\1", kinds)),
    )


def _vote(value: float, good: tuple[float, float], fair: tuple[float, float]) -> int:
    """1 within the good range, 0 within the fair one, else -1."""
    return 1 if good[0] <= value <= good[1] else 0 if fair[0] <= value <= fair[1] else -1


def signals(text: str, order: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> dict[str, float | None]:
    """Value of each labeller's signal, None where a text is too short for it; `order` has the words by number."""
    n = int(counts.sum())
    letters, capitals, chars, symbols, shouts, stops = (counts @ rows[:, :6]).tolist() if n else (0,) * 6
    lines = [line for line in text.split("\n") if line.strip()]
    return {
        "symbols": symbols / n if n else 1.0,
        "capitals": capitals / letters if letters else 1.0,
        "shouts": shouts / n if n else None,
        "top_word": int(counts.max()) / n if n >= 20 else None,
        "stutter": float((order[1:] == order[:-1]).mean()) if n >= 10 else None,
        "variety": len(counts) / n**0.8 if n >= 50 else None,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else None,
        "letters": letters / chars if chars else 0.0,
        "length": chars / n if n else 0.0,
        "stops": stops / n if n >= 20 else None,
    }


RANGES = {  # good, then fair; what lies outside is bad
    "symbols": ((0, 0.1), (0, 0.3)),
    "capitals": ((0, 0.25), (0, 0.5)),
    "shouts": ((0, 0.1), (0, 0.3)),
    "top_word": ((0, 0.2), (0, 0.35)),
    "stutter": ((0, 0.05), (0, 0.15)),
    "variety": ((0.5, 10), (0.15, 10)),
    "lines": ((0, 0.2), (0, 0.5)),
    "letters": ((0.85, 1), (0.75, 1)),
    "length": ((2.5, 14), (1.5, 25)),
    "stops": ((0.01, 0.4), (0.002, 0.6)),
}


def votes_of(values: dict[str, float | None]) -> list[int]:
    return [0 if values[name] is None else _vote(values[name], *RANGES[name]) for name in LABELLERS]


class _Words:
    """Numbers and rows of the words a worker has seen; a bounded cache."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, 7), np.int64)

    def add(self, words: set[str]) -> None:
        if len(self.number) > CACHED_WORDS:
            self.number.clear()
        fresh = list(words.difference(self.number))
        at = len(self.number)
        while at + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(fresh)] = np.array([_word_row(word) for word in fresh], np.int64).reshape(-1, 7)
        self.number.update(zip(fresh, range(at, at + len(fresh)), strict=True))


_seen = _Words()


def features(docs: DataFrame) -> DataFrame:
    """`doc_id, votes, slots, weights` of every document: the votes, and the non-zero hashed features."""

    def run(ids: list, texts: list) -> dict[str, list]:
        split = [text.split() for text in texts]
        _seen.add(set().union(*split))
        row, held = _seen.number, _seen.rows
        found: dict[str, list] = {"doc_id": ids, "votes": [], "slots": [], "weights": []}
        for text, words in zip(texts, split, strict=True):
            order = np.fromiter(map(row.__getitem__, words), np.int64, len(words))
            numbers, counts = np.unique(order, return_counts=True)
            own = held[numbers]
            values = signals(text, order, counts, own)
            shares = np.bincount(own[:, 6], counts, DIMENSIONS) / max(1, len(words))
            for name, value in values.items():
                shares[slot(f"{name} {'none' if value is None else round(min(value, 20.0) * 10)}")] += 1.0
            used = np.flatnonzero(shares)
            found["votes"].append("".join("-0+"[v + 1] for v in votes_of(values)))
            found["slots"].append(used.tolist())
            found["weights"].append(shares[used].tolist())
        return found

    return map_batches(docs, run, "doc_id long, votes string, slots array<int>, weights array<float>", slice_rows=200)


def posteriors(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Probability of `good` for each vote pattern, by expectation maximisation over labellers independent given the class.

    Starts from the votes: a document with a bad vote is taken as bad. Counts are smoothed by one, so no labeller is taken as
    certain.
    """
    if not patterns:
        return {}
    names = [p for p, _ in patterns]
    weight = np.array([n for _, n in patterns], float)
    kind = np.array([["-0+".index(c) for c in p] for p in names])
    one_hot = np.eye(3)[kind][:, :, [0, 2]]  # patterns x labellers x (bad, good); an abstention tells nothing
    good = np.where((kind == 0).any(1), 0.2, 0.9)
    for _ in range(EM_ROUNDS):
        log_odds = np.zeros(len(names))
        for share, sign in ((good, 1), (1 - good, -1)):
            votes = np.einsum("p,plv->lv", weight * share, one_hot) + 1.0
            rates = np.log(votes / votes.sum(1, keepdims=True))
            prior = np.log((weight * share).sum() + 1)
            log_odds += sign * (prior + np.einsum("lv,plv->p", rates, one_hot))
        moved = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(moved - good).max() < 1e-9:
            break
        good = moved
    return dict(zip(names, good.tolist(), strict=True))


def fit_scorer(matrix: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a logistic scorer, by full gradient steps on soft labels."""
    weights, bias, speed = np.zeros(matrix.shape[1]), 0.0, np.zeros(matrix.shape[1] + 1)
    for _ in range(rounds if len(matrix) else 0):
        error = 1 / (1 + np.exp(-np.clip(matrix @ weights + bias, -30, 30))) - target
        gradient = np.append(matrix.T @ error / len(matrix) + decay * weights, error.mean())
        speed = 0.9 * speed + gradient
        weights, bias = weights - rate * 0.1 * speed[:-1], bias - rate * 0.1 * speed[-1]
    return np.append(weights, bias)


def classify(docs: DataFrame) -> DataFrame:
    """`doc_id, score, accepted, votes, posterior` of every document.

    A null or empty text votes bad where a labeller needs no length. Repeated rows count as often as they come and have equal results.
    The votes of all documents enter the estimate; their patterns, at most 3 to the number of labellers, are all that
    reaches the driver, besides the features of at most SAMPLE_ROWS documents, the least by a hash of id and features.
    """
    held = cut_lineage(features(docs), "quality-features")
    patterns = [(r["votes"], r["n"]) for r in held.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    good = posteriors(patterns)
    total = sum(n for _, n in patterns)
    # A threshold on 63 bits leaves little more rows than wanted, of which the least by hash are taken.
    place = F.xxhash64("doc_id", "votes", "slots", "weights").bitwiseAND(F.lit(_LARGEST))
    least = min(_LARGEST, 2 * SAMPLE_ROWS * _LARGEST // max(1, total))
    chosen = held.withColumn("place", place).filter(F.col("place") <= least).orderBy("place").limit(SAMPLE_ROWS)
    sample = chosen.select("votes", "slots", "weights").toPandas()
    matrix = np.zeros((len(sample), DIMENSIONS), np.float64)
    for at, row in enumerate(sample.itertuples()):
        matrix[at, row.slots] = row.weights
    scorer = fit_scorer(matrix, np.array([good[v] for v in sample["votes"]]))
    weights = F.array(*[F.lit(float(w)) for w in scorer[:-1]])
    logit = F.aggregate(
        F.zip_with("slots", "weights", lambda s, w: w * F.element_at(weights, s + 1)), F.lit(float(scorer[-1])), lambda a, x: a + x
    )
    scored = held.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"), "votes")
    by_pattern = held.sparkSession.createDataFrame(list(good.items()), "votes string, posterior double")
    return scored.join(F.broadcast(by_pattern), "votes").select(
        "doc_id", "score", (F.col("score") >= REJECT_BELOW).alias("accepted"), "votes", "posterior"
    )
