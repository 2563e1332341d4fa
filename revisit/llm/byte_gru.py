"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in pieces of ``PIECE`` bytes. One network reads a piece forwards, one backwards; the
two states at a byte give its probabilities of the languages, so every position has a label, and a
text's probabilities are the mean over its letter positions. The network is trained in numpy by
backpropagation through time, in one task, on a bounded sample of labelled texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.words import text_slices
from revisit.plans.durable import durable

PIECE = 128
STATE = 12
UNKNOWN = "und"
LETTER = r"\p{L}"

# Bounds of the training sample: the commonest languages, texts of all, pieces of a text.
LANGUAGES = 64
SAMPLE_TEXTS = 2000
TEXT_PIECES = 6
_SPARE = 8  # so many times the texts that are wanted are ranked by hash

STEPS, BATCH, RATE, SEED = 360, 128, 0.01, 29  # training steps at any size of the sample
_ROWS = 2048  # pieces that are read side by side
_PAD = 256  # stands behind the end of a piece; states do not change there
_CLOSED = 20.0

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Network:
    """Weights; the first axis is the direction. Gates are z (keep), r (reset) and n (new state)."""

    languages: list[str]
    gates: np.ndarray  # (2, 257, 2H): what a byte adds to z and r
    new: np.ndarray  # (2, 257, H)
    gate_state: np.ndarray  # (2, H, 2H): what the last state adds
    new_state: np.ndarray  # (2, H, H)
    out: np.ndarray  # (2, H, L)
    bias: np.ndarray  # (L,)

    WEIGHTS = ("gates", "new", "gate_state", "new_state", "out", "bias")

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator, state: int = STATE) -> Network:
        def some(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(state), shape).astype(np.float32)

        made = cls(
            languages, some(2, 257, 2 * state), some(2, 257, state), some(2, state, 2 * state),
            some(2, state, state), some(2, state, len(languages)), np.zeros(len(languages), np.float32),
        )
        made.close_pads()
        return made

    def close_pads(self) -> None:
        h = self.new.shape[2]
        self.gates[:, _PAD, :h] = _CLOSED
        self.gates[:, _PAD, h:] = 0
        self.new[:, _PAD] = 0

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.WEIGHTS]

    def to_bytes(self) -> bytes:
        body = io.BytesIO()
        np.savez(body, languages=np.array(self.languages), **{n: getattr(self, n) for n in self.WEIGHTS})
        return body.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> Network:
        held = np.load(io.BytesIO(body))
        return cls(held["languages"].tolist(), *[held[n] for n in cls.WEIGHTS])


def _both_ways(pieces: np.ndarray) -> np.ndarray:
    """(step, direction, piece): rows of the weight tables of both directions, one after the other."""
    forward = pieces.T.astype(np.intp)
    return np.stack([forward, forward[::-1] + 257], 1)


def position_scores(net: Network, pieces: np.ndarray) -> np.ndarray:
    """(step, piece, language) scores of every position, before the softmax."""
    steps, n = pieces.shape[1], pieces.shape[0]
    size, count = net.new.shape[2], len(net.languages)
    # A sigmoid is half a hyperbolic tangent of half its argument, plus a half.
    gates, gate_state = (net.gates / 2).reshape(-1, 2 * size), net.gate_state / 2
    new = net.new.reshape(-1, size)
    at = _both_ways(pieces)
    h = np.zeros((2, n, size), np.float32)
    zr, a, m = np.empty((2, n, 2 * size), np.float32), np.empty_like(h), np.empty_like(h)
    x_gates, x_new = np.empty_like(zr), np.empty_like(h)
    scores = np.empty((steps, 2, n, count), np.float32)
    for t in range(steps):
        np.take(gates, at[t], axis=0, out=x_gates, mode="clip")
        np.take(new, at[t], axis=0, out=x_new, mode="clip")
        np.matmul(h, gate_state, out=zr)
        zr += x_gates
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.matmul(h, net.new_state, out=a)
        a *= zr[..., size:]
        a += x_new
        np.tanh(a, out=a)
        np.subtract(h, a, out=m)
        m *= zr[..., :size]
        np.add(a, m, out=h)
        np.matmul(h, net.out, out=scores[t])
    return scores[:, 0] + scores[::-1, 1] + net.bias


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(-1, keepdims=True)
    return scores


# ---------------------------------------------------------------------- training


def gradients(net: Network, pieces: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over letter positions, and its derivative by every weight."""
    steps, n = pieces.shape[1], pieces.shape[0]
    size = net.new.shape[2]
    at = _both_ways(pieces)
    gates, new = net.gates.reshape(-1, 2 * size), net.new.reshape(-1, size)
    h = np.zeros((steps + 1, 2, n, size), np.float32)
    z, r, fresh, inner = (np.empty((steps, 2, n, size), np.float32) for _ in range(4))
    for t in range(steps):
        zr = 1 / (1 + np.exp(-(gates[at[t]] + h[t] @ net.gate_state)))
        z[t], r[t] = zr[..., :size], zr[..., size:]
        inner[t] = h[t] @ net.new_state
        fresh[t] = np.tanh(new[at[t]] + r[t] * inner[t])
        h[t + 1] = fresh[t] + z[t] * (h[t] - fresh[t])
    scores = h[1:, 0] @ net.out[0] + h[:0:-1, 1] @ net.out[1] + net.bias
    p = _softmax(scores)
    counts = _is_letter(pieces).T  # (step, piece)
    total = max(int(counts.sum()), 1)
    own = np.take_along_axis(p, labels[None, :, None], 2)[..., 0]
    loss = float(-(np.log(np.maximum(own, 1e-12)) * counts).sum() / total)
    np.put_along_axis(p, np.broadcast_to(labels[None, :, None], (steps, n, 1)), own[..., None] - 1, 2)
    p *= counts[..., None] / np.float32(total)

    made = [np.zeros_like(w) for w in net.weights()]
    d_gates, d_new, d_gate_state, d_new_state, d_out, d_bias = made
    d_bias += p.sum((0, 1))
    p_both = np.stack([p, p[::-1]], 1)  # in each direction's own order of steps
    flat_gates, flat_new = d_gates.reshape(-1, 2 * size), d_new.reshape(-1, size)
    back = np.zeros((2, n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        d_out += h[t + 1].transpose(0, 2, 1) @ p_both[t]
        dh = back + p_both[t] @ net.out.transpose(0, 2, 1)
        d_fresh = dh * (1 - z[t]) * (1 - fresh[t] ** 2)
        d_z = dh * (h[t] - fresh[t]) * z[t] * (1 - z[t])
        d_r = d_fresh * inner[t] * r[t] * (1 - r[t])
        d_inner = d_fresh * r[t]
        d_zr = np.concatenate([d_z, d_r], 2)
        before = h[t].transpose(0, 2, 1)
        d_gate_state += before @ d_zr
        d_new_state += before @ d_inner
        _add_rows(flat_gates, at[t].ravel(), d_zr.reshape(-1, 2 * size))
        _add_rows(flat_new, at[t].ravel(), d_fresh.reshape(-1, size))
        back = dh * z[t] + d_zr @ net.gate_state.transpose(0, 2, 1) + d_inner @ net.new_state.transpose(0, 2, 1)
    d_gates[:, _PAD] = 0
    d_new[:, _PAD] = 0
    return loss, made


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    begin = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    table[sorted_rows[begin]] += np.add.reduceat(values[order], begin, axis=0)


def _is_letter(pieces: np.ndarray) -> np.ndarray:
    return np.append(_LETTERS, False)[pieces]


def fit(languages: list[str], pieces: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Network:
    """Train by Adam on pieces (rows of bytes, padded) and the numbers of their languages."""
    rng = np.random.default_rng(SEED)
    net = Network.fresh(languages, rng)
    # Every language weighs the same: rare ones' pieces are drawn more often.
    share = 1 / np.bincount(labels, minlength=len(languages))[labels]
    share = share / share.sum()
    mean, square = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        drawn = rng.choice(len(pieces), min(BATCH, len(pieces)), p=share)
        _, found = gradients(net, pieces[drawn], labels[drawn])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        rate = RATE * (1 - (step - 1) / steps)
        for w, g, m, s in zip(net.weights(), found, mean, square):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= (rate / (1 - 0.9**step)) * m / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        net.close_pads()
    return net


def _spread_pieces(text: bytes) -> list[bytes]:
    """At most ``TEXT_PIECES`` pieces, spread evenly over the text."""
    starts = range(0, max(len(text), 1), PIECE)
    places = sorted({round(i * (len(starts) - 1) / max(TEXT_PIECES - 1, 1)) for i in range(TEXT_PIECES)})
    return [text[starts[p] : starts[p] + PIECE] for p in places]


def _sample_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (order, lang, i, piece)
            for order, lang, text in zip(*(batch.column(c).to_pylist() for c in ("hash", "lang", "text")))
            for i, piece in enumerate(_spread_pieces(text.encode()))
        ]
        if rows:
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.binary()))],
                names=["hash", "lang", "i", "piece"],
            )


def _train(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["lang"], r["hash"], r["i"], r["piece"]))
    if not rows:
        return
    number = {lang: i for i, lang in enumerate(languages)}
    pieces = _padded([r["piece"] for r in rows], PIECE)
    net = fit(languages, pieces, np.array([number[r["lang"]] for r in rows]))
    yield pa.record_batch([pa.array([net.to_bytes()], pa.binary())], names=["net"])


def _padded(pieces: list[bytes], width: int) -> np.ndarray:
    made = np.full((len(pieces), width), _PAD, np.int32)
    for row, piece in zip(made, pieces):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    return made


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS) -> Network | None:
    """A network fitted to ``labelled``; None if no text with a letter has a language.

    The sample is bounded: the ``LANGUAGES`` commonest languages, of each an equal share of ``texts``
    distinct texts (chosen by their hashes), of each text ``TEXT_PIECES`` pieces all over it.
    """
    known = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["count"] for r in counts.collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    quota = max(texts // len(languages), 1)
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, _SPARE * quota / n))])
    hashed = known.withColumn("hash", F.xxhash64("text", F.lit(3)))
    some = F.pmod("hash", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30)
    few = hashed.where(F.col("lang").isin(languages)).where(some).select("lang", "hash").distinct()
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    chosen = durable(ranked.where(F.col("place") <= quota).drop("place"), "training-texts")
    # At most ``texts`` rows, or one a language; copies of a text give the same pieces.
    read = hashed.join(F.broadcast(chosen), ["lang", "hash"]).select("hash", "lang", "text")
    pieces = read.mapInArrow(_sample_pieces, "hash long, lang string, i long, piece binary")
    pieces = pieces.groupBy("hash", "lang", "i").agg(F.min("piece").alias("piece"))
    body = durable(
        durable(pieces, "training-pieces").repartition(1).mapInArrow(lambda b: _train(b, languages), "net binary"),
        "network",
    ).first()
    return Network.from_bytes(bytes(body["net"]))


# -------------------------------------------------------------------- prediction


def text_probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """(text, language) mean probabilities over the letter positions of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    size = int(bounds[-1] - bounds[0])
    data = np.frombuffer(raw, np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    per = -(-np.diff(bounds) // PIECE)
    owner = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = bounds[owner] + nth * PIECE
    length = np.minimum(bounds[owner + 1] - start, PIECE)
    order = np.argsort(length, kind="stable")
    sums = np.zeros((len(texts), len(net.languages)))
    counts = np.zeros(len(texts))
    for first in range(0, len(order), _ROWS):
        some = order[first : first + _ROWS]
        steps = int(length[some[-1]])
        place = start[some][:, None] + np.arange(steps)
        inside = np.arange(steps) < length[some][:, None]
        pieces = np.where(inside, data[np.minimum(place, size - 1)].astype(np.int16), np.int16(_PAD))
        p = _softmax(position_scores(net, pieces))
        letters = _is_letter(pieces)
        p *= letters.T[..., None]
        np.add.at(sums, owner[some], p.sum(0, dtype=np.float64))
        np.add.at(counts, owner[some], letters.sum(1))
    return sums / np.maximum(counts, 1)[:, None]


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = batch.column(batch.num_columns - 1)
        lettered = pa.compute.match_substring_regex(texts, LETTER).fill_null(False).to_numpy(zero_copy_only=False)
        lang, score = np.full(len(lettered), UNKNOWN, object), np.zeros(len(lettered))
        if net is not None and lettered.any():
            p = text_probabilities(net, texts.filter(pa.array(lettered)))
            lang[lettered] = np.array(net.languages, object)[p.argmax(1)]
            score[lettered] = np.clip(p.max(1), 0, 1)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.record_batch(
            [*kept, pa.array(lang, pa.string()), pa.array(score)],
            names=[*batch.schema.names[:-1], "lang_pred", "score"],
        )


def predict(docs: DataFrame, net: Network | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a network.
    """
    rows = docs.select(
        *[c.alias(f"kept {i}") for i, c in enumerate(keep.values())], F.col(text).cast("string").alias("read text")
    )
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some 100 KB
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    made = rows.mapInArrow(lambda b: _predict(b, sent.value), f"{kind}, lang_pred string, score double")
    return made.toDF(*keep, "lang_pred", "score")


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held: int = 1
) -> DataFrame:
    """(key, held_out, lang_pred, score): the language of every text.

    Rows whose crc32(key as text) mod ``folds`` is ``held`` are held out; a network is trained on
    the others' texts and languages. Neither language nor key are inputs of a prediction. A null key
    counts as the empty text. Rows of equal keys are predicted one by one; other columns are not read.
    """
    held_out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == held
    net = train(docs.where(~held_out), text, lang)
    return predict(docs, net, {key: F.col(key), "held_out": held_out}, text)
