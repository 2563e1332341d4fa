"""A smoothed n-gram model as a weighted automaton with failure arcs."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revisit.llm.key_counts import (
    Keys,
    batches_of,
    bucket_bits,
    key_totals,
    section_sums,
    sorted_keys,
    with_totals,
)
from revisit.llm.words import mix, words_of
from revisit.plans.durable import durable

END = np.uint64(0x5851F42D4C957F2D)  # the token after the last word
START = np.uint64(0x14057B7EF767814F)  # the context of the first
_STEP = np.uint64(0x9E3779B97F4A7C15)


def in_training(key: object, folds: int = 7, held: int = 2) -> bool:
    """Whether a document is learnt from; a null key counts as an empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds != held


@dataclass
class Grams:
    """Token sequences of one length in a batch of texts.

    The text's first token follows START, which is a context but no token: a text's place j ends
    sequences of up to j + 2 parts, START included.
    """

    at: np.ndarray  # positions that end such a sequence
    place: np.ndarray  # by position of ``at``: the sequence's number
    context: np.ndarray  # by sequence: the number of it without its last token
    keys: Keys


@dataclass
class Tokens:
    """Tokens of a batch of texts: words in lower case, then one end per text."""

    token: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def after_start(self) -> np.ndarray:
        return np.arange(len(self.token)) - self.first[self.doc]


def tokens_of(texts: pa.Array) -> Tokens:
    words = words_of(texts, lower=True)
    n_docs = len(texts)
    first = words.first + np.arange(n_docs + 1)
    token = np.full(len(words.starts) + n_docs, END, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[first[1:] - 1] = False
    token[is_word] = words.hashes()
    return Tokens(token, np.repeat(np.arange(n_docs), np.diff(first)), first)


def grams_of(t: Tokens, learnt: np.ndarray, order: int) -> list[Grams]:
    """Distinct sequences of 1 to ``order`` tokens with their counts in training texts.

    Of a text's first token the context of length one is START, numbered after all tokens.
    """
    n = len(t.token)
    where = t.after_start()
    made: list[Grams] = []
    key, number = t.token, np.empty(n, np.int64)
    before = np.empty(n, np.int64)
    for length in range(1, order + 1):
        at = np.arange(n) if length < 3 else np.flatnonzero(where >= length - 2)
        if length > 1:
            last = np.empty(n, np.uint64)  # the key of the sequence that ends before each position
            last[1:] = key[:-1]
            before[1:] = number[:-1]
            if length == 2:
                last[t.first[:-1]] = START
                before[t.first[:-1]] = len(made[0].keys.high)
            key = mix(last * _STEP + t.token)
        keys, place = sorted_keys(key[at], adds=learnt[at].astype(np.int64))
        number = np.full(n, -1, np.int64)
        number[at] = place
        context = np.zeros(len(keys.high), np.int64)
        context[place] = before[at] if length > 1 else 0
        made.append(Grams(at, place, context, keys))
    return made


def _grams(batch: pa.RecordBatch, training: np.ndarray, order: int) -> tuple[Tokens, list[Grams]]:
    t = tokens_of(batch.column(1))
    return t, grams_of(t, training[t.doc], order)


@dataclass
class Automaton:
    """The part of the model that one batch of texts can reach.

    States are the token sequences of up to ``order - 1`` parts that were seen in training; the root
    is the empty one. Arcs of a state are the tokens seen after it; an arc leads to the state
    of the sequence with that token (without its first part, if it is too long). A state without an
    arc for a token has a failure arc to the state that lacks the first part, down to the root, whose
    arcs are all tokens, known or not. Weights are log10 probabilities: an arc's
    (count(sequence) + m p(token after the shorter state)) / (count(state) + m), a failure
    arc's m / (count(state) + m), the root's (count + 1) / (N + V + 1). Each state's add up to one.
    """

    grams: list[Grams]
    counts: list[np.ndarray]  # by length and sequence, in training; of length one, START is the last
    root_arc: np.ndarray  # by token
    mass: float

    @classmethod
    def build(
        cls, grams: list[Grams], counts: list[np.ndarray], starts: int, total: int, distinct: int, mass: float
    ) -> Automaton:
        words = counts[0]
        with_start = [np.append(words, starts), *counts[1:]]
        return cls(grams, with_start, np.log10((words + 1) / (total + distinct + 1)), mass)

    def fail(self, length: int) -> np.ndarray:
        """Weights of the failure arcs of the states of a length."""
        return np.log10(self.mass / (self.counts[length - 1] + self.mass))

    def walk(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entered, taken): by token, the lengths of the state that is there before it, and of the
        one, down the failure arcs, whose arc it takes.

        One pass from left to right over each text, which begins in the state START.
        """
        top = len(self.grams) - 1
        n = len(self.grams[0].at)
        known = np.zeros(n, np.int64)  # parts of the longest seen sequence that ends at a token
        for length, g in enumerate(self.grams, 1):
            seen = self.counts[length - 1][g.place] > 0
            known[g.at[seen]] = length
        entered, taken = bytearray(n), bytearray(n)
        begin = min(top, 1) if self.counts[0][-1] else 0
        begins = set(first[:-1].tolist())
        state = begin
        for i, longest in enumerate(known.tolist()):
            if i in begins:
                state = begin
            entered[i] = state
            while state and longest <= state:  # no arc: the failure arc
                state -= 1
            taken[i] = state
            state = min(state + 1, longest, top)
        return np.frombuffer(entered, np.uint8), np.frombuffer(taken, np.uint8)

    def weights(self, first: np.ndarray) -> np.ndarray:
        """The log10 probability of every token after the state that the walk is in."""
        entered, taken = self.walk(first)
        weight = self.root_arc[self.grams[0].place]
        p = 10**weight  # after the state of the length before, failure arcs included
        for length in range(1, len(self.grams)):
            g = self.grams[length]
            state = g.context[g.place]
            seen = self.counts[length - 1][state] + self.mass
            p = p.copy()
            p[g.at] = (self.counts[length][g.place] + self.mass * p[g.at]) / seen
            arc = taken[g.at] == length
            weight[g.at[arc]] = np.log10(p[g.at[arc]])
            down = (taken[g.at] < length) & (entered[g.at] >= length)
            weight[g.at[down]] += self.fail(length)[state[down]]
        return weight


def _sums(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight, first[:-1]) if len(weight) else np.zeros(len(first) - 1)


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2,
    mass: float = 300.0, order: int = 2,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    The model learns all sequences of up to ``order`` words of the texts whose key is not in fold
    ``held``: counts grow with the corpus, nothing is pruned. Longer sequences are smoothed towards
    shorter ones with ``mass`` pseudo-counts. ``base_score`` is the add-one word model's log10 probability, ``score`` the
    automaton's. Null and empty texts are one end token; repeated rows count as often as they
    occur; a null key is in training; with nothing to learn from, every token has probability one.
    """
    batches = batches_of(docs, key, text)
    bits = bucket_bits(batches)

    def training(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([in_training(k, folds, held) for k in batch.column(0).to_pylist()], bool)

    def keys_of(batch: pa.RecordBatch) -> list[Keys]:
        return [g.keys for g in _grams(batch, training(batch), order)[1]]

    totals = durable(key_totals(batches, keys_of, bits), "gram-totals")
    total, distinct = section_sums(totals, bits, 0)

    def finish(batch: pa.RecordBatch, sections: list[np.ndarray]) -> pa.RecordBatch:
        learnt = training(batch)
        t, grams = _grams(batch, learnt, order)
        words, word = sections[0], grams[0].place
        starts = int(words[np.searchsorted(grams[0].keys.high, END)])  # one end per training text
        model = Automaton.build(grams, sections, starts, total, distinct, mass)
        score = _sums(model.weights(t.first), t.first)
        known = np.add.reduceat((words > 0)[word].astype(np.int64), t.first[:-1])
        arrays = [
            batch.column(0),
            pa.array(~learnt),
            pa.array(np.diff(t.first).astype(np.int64)),
            pa.array(known),
            pa.array(np.full(batch.num_rows, total, np.int64)),
            pa.array(_sums(model.root_arc[word], t.first)),
            pa.array(score),
        ]
        return pa.RecordBatch.from_arrays(arrays, _COLUMNS)

    kind = docs.schema[key].dataType.simpleString()
    types = ["boolean", "bigint", "bigint", "bigint", "double", "double"]
    schema = ", ".join([f"key {kind}", *(f"{c} {k}" for c, k in zip(_COLUMNS[1:], types))])
    return with_totals(batches, totals, bits, finish, schema).withColumnRenamed("key", key)


_COLUMNS = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
