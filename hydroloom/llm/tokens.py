"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton enumerates the pieces that end at each character; the dynamic programme carries the best score
and the number of pieces of its path, never the path. Tie rules are those of the usual unigram tokenizers: candidates for an
end are taken from the earliest start to the latest and only a strictly better score replaces the one found before; a
character that is no piece of its own costs ten below the worst score and counts one token per byte (byte fallback).
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from hydroloom.llm.text import map_batches

SPACE = "▁"
CACHED_WORDS = 500_000
UNKNOWN_PENALTY = 10.0


def rank_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a model file with log probabilities by Zipf's law over their ranks; nothing is trained."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    total = math.log(sum(1.0 / (rank + 1) for rank in range(size)))
    return [(model.id_to_piece(rank), -math.log(rank + 1) - total) for rank in range(size)]


@lru_cache(maxsize=2)
def _model(vocabulary: tuple[tuple[str, float], ...]):
    automaton = ahocorasick.Automaton()
    for piece, score in vocabulary:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    return automaton, min(score for _, score in vocabulary) - UNKNOWN_PENALTY, {}


def count_word(word: str, automaton, unknown: float) -> tuple[int, float]:
    """Pieces and score of the best path of one word."""
    size = len(word)
    score = [0.0] * (size + 1)
    count = [0] * (size + 1)
    matches = automaton.iter(word)
    end, found = next(matches, (size, None))
    for at in range(size):
        best, pieces, single = -math.inf, 0, False
        # Matches of one end come from the longest to the shortest, that is from the earliest start on.
        while end == at:
            length, own = found
            start = at + 1 - length
            candidate = own + score[start]
            if candidate > best:
                best, pieces = candidate, count[start] + 1
            single = single or length == 1
            end, found = next(matches, (size, None))
        if not single:
            candidate = unknown + score[at]
            if candidate > best:
                best, pieces = candidate, count[at] + len(word[at].encode())
        score[at + 1], count[at + 1] = best, pieces
    return count[size], score[size]


def words_of(text: str) -> list[str]:
    """Words with the space mark in front; every space begins a word, the first one is added where it is missing."""
    marked = text.replace(SPACE, " ")
    if not marked:
        return []
    if not marked.startswith(" "):
        marked = " " + marked
    return [SPACE + word for word in marked[1:].split(" ")]


def count_texts(texts: list[str], vocabulary: tuple[tuple[str, float], ...]) -> list[tuple[int, int, float]]:
    """Words, tokens and score of each text."""
    automaton, unknown, known = _model(vocabulary)
    out = []
    for text in texts:
        if len(known) > CACHED_WORDS:
            known.clear()
        words = words_of(text)
        for word in set(words).difference(known):
            known[word] = count_word(word, automaton, unknown)
        found = [known[word] for word in words]
        out.append((len(words), sum([n for n, _ in found]), sum([s for _, s in found])))
    return out


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """`doc_id, n_words, n_tokens, score` of every whole text, without a shuffle.

    A null or empty text has no words, no tokens and score 0; repeated rows give repeated results. The vocabulary is
    broadcast: its size is that of the model file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def run(ids: list, texts: list) -> dict[str, list]:
        found = count_texts(texts, shared.value)
        return {
            "doc_id": ids,
            "n_words": [words for words, _, _ in found],
            "n_tokens": [tokens for _, tokens, _ in found],
            "score": [float(score) for _, _, score in found],
        }

    return map_batches(docs, run, "doc_id long, n_words long, n_tokens long, score double", slice_rows=200)
