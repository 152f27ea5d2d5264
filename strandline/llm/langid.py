"""Language identification by a bidirectional gated recurrent network over bytes.

One update gate per unit and direction, with piecewise-linear gate and activation; both
directions' states at a byte give that byte's language probabilities, and their mean over all
bytes of a text is the text's. Trained in numpy by backpropagation through time on windows of a
bounded sample; applied to whole texts, which are cut into windows with a margin of context on
both sides.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
there was nothing to learn from; rows with a null language or id teach nothing; repeated rows and
ids each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_slice

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Texts per language that train the network, the characters taken from each, the network's width.
SAMPLE, TAKEN, UNITS = 400, 400, 16
#: Bytes that a window labels, its context on either side, and windows run at once.
WINDOW, MARGIN, LANES = 240, 8, 1024
PAD = 0x20


class Network(NamedTuple):
    """For each of two directions: gate and candidate tables by byte, and recurrent weights; then the labels' weights."""

    gate_in: np.ndarray  # 2 x 256 x H
    new_in: np.ndarray
    gate_up: np.ndarray  # 2 x H x H
    new_up: np.ndarray
    out: np.ndarray  # 2 x H x L
    bias: np.ndarray  # L


def fresh(units: int, labels: int, seed: int) -> Network:
    draw = np.random.default_rng(seed)
    normal = lambda scale, *shape: (scale * draw.standard_normal(shape)).astype(np.float32)
    up = lambda: np.stack([0.5 * np.linalg.qr(draw.standard_normal((units, units)))[0] for _ in range(2)]).astype(np.float32)
    return Network(normal(0.5, 2, 256, units), normal(0.5, 2, 256, units), up(), up(), normal(0.3, 2, units, labels), np.zeros(labels, np.float32))


def states(net: Network, side: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States before and after every step, gates and candidates, for bytes x of shape T x B in the direction's order."""
    steps, lanes = x.shape
    units = net.gate_up.shape[1]
    h = np.zeros((steps + 1, lanes, units), np.float32)
    gates, news = np.empty((steps, lanes, units), np.float32), np.empty((steps, lanes, units), np.float32)
    for t in range(steps):
        g = h[t] @ net.gate_up[side]
        g += net.gate_in[side][x[t]]
        g *= 0.25
        g += 0.5
        gates[t] = np.clip(g, 0, 1, out=g)
        c = h[t] @ net.new_up[side]
        c += net.new_in[side][x[t]]
        news[t] = np.clip(c, -1, 1, out=c)
        c -= h[t]
        c *= g
        np.add(h[t], c, out=h[t + 1])
    return h, gates, news


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)
    return z


def gradient(net: Network, x: np.ndarray, labels: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy over all bytes of windows x (T x B) with one label each, and its gradient."""
    steps, lanes = x.shape
    order = (x, x[::-1])
    runs = [states(net, side, order[side]) for side in range(2)]
    after = (runs[0][0][1:], runs[1][0][1:][::-1])
    p = softmax(after[0] @ net.out[0] + after[1] @ net.out[1] + net.bias)
    loss = float(-np.log(np.maximum(p[:, np.arange(lanes), labels], 1e-9)).mean())
    p[:, np.arange(lanes), labels] -= 1
    p /= steps * lanes
    grads = Network(*[np.zeros_like(w) for w in net])
    grads.bias[:] = p.sum((0, 1))
    for side in range(2):
        h, gates, news = runs[side]
        grads.out[side] = np.tensordot(after[side], p, ((0, 1), (0, 1)))
        arriving = p @ net.out[side].T
        arriving = arriving if side == 0 else arriving[::-1]
        down = np.zeros_like(h[0])
        d_gate, d_new = np.empty_like(gates), np.empty_like(news)
        for t in range(steps - 1, -1, -1):
            down = down + arriving[t]
            g, c = gates[t], news[t]
            d_gate[t] = down * (c - h[t]) * 0.25 * ((g > 0) & (g < 1))
            d_new[t] = down * g * ((c > -1) & (c < 1))
            down = down * (1 - g) + d_gate[t] @ net.gate_up[side].T + d_new[t] @ net.new_up[side].T
        grads.gate_up[side] = np.tensordot(h[:-1], d_gate, ((0, 1), (0, 1)))
        grads.new_up[side] = np.tensordot(h[:-1], d_new, ((0, 1), (0, 1)))
        np.add.at(grads.gate_in[side], order[side].ravel(), d_gate.reshape(-1, d_gate.shape[-1]))
        np.add.at(grads.new_in[side], order[side].ravel(), d_new.reshape(-1, d_new.shape[-1]))
    return loss, grads


def train(samples: list[bytes], labels: np.ndarray, n_labels: int, units: int = UNITS, steps: int = 300, lanes: int = 96, length: int = 48, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on random windows, every label as often."""
    draw = np.random.default_rng(seed)
    net = fresh(units, n_labels, seed)
    m, v = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    by_label = [np.flatnonzero(labels == k) for k in range(n_labels)]
    padded = [np.frombuffer(s.ljust(length, bytes([PAD])), np.uint8) for s in samples]
    for step in range(1, steps + 1):
        y = draw.permutation(np.arange(lanes) % n_labels)
        x = np.empty((length, lanes), np.uint8)
        for i, k in enumerate(y):
            s = padded[draw.choice(by_label[k])]
            at = draw.integers(0, len(s) - length + 1)
            x[:, i] = s[at : at + length]
        _, grads = gradient(net, x, y)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        cool = rate * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1.0 / max(norm, 1e-9))
        for w, g, a, b in zip(net, grads, m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            w -= cool * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def pooled(net: Network, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum over a window's own bytes of their probabilities: x is T x B bytes, counts T x B of 0 or 1."""
    steps, lanes = x.shape
    total = np.zeros((lanes, len(net.bias)), np.float32)
    forward = advance(net, 0, x)
    h = np.zeros((lanes, net.gate_up.shape[1]), np.float32)
    for t in range(steps - 1, -1, -1):
        h = step_on(net, 1, h, x[t])
        z = forward[t] @ net.out[0]
        z += h @ net.out[1]
        z += net.bias
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        z *= (counts[t] / z.sum(1))[:, None]
        total += z
    return total


def step_on(net: Network, side: int, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    g = h @ net.gate_up[side]
    g += np.take(net.gate_in[side], x, axis=0)
    g *= 0.25
    g += 0.5
    np.clip(g, 0, 1, out=g)
    c = h @ net.new_up[side]
    c += np.take(net.new_in[side], x, axis=0)
    np.clip(c, -1, 1, out=c)
    c -= h
    c *= g
    c += h
    return c


def advance(net: Network, side: int, x: np.ndarray) -> np.ndarray:
    out = np.empty((*x.shape, net.gate_up.shape[1]), np.float32)
    h = np.zeros(out.shape[1:], np.float32)
    for t in range(len(x)):
        h = out[t] = step_on(net, side, h, x[t])
    return out


def probabilities(net: Network, raws: list[bytes]) -> np.ndarray:
    """Mean over each text's bytes of their label probabilities; zeros for an empty text."""
    span = WINDOW + 2 * MARGIN
    total = np.zeros((len(raws), len(net.bias)))
    lanes, owners, sizes = [], [], []

    def flush():
        x = np.stack(lanes, 1)
        counts = ((np.arange(span)[:, None] >= MARGIN) & (np.arange(span)[:, None] < MARGIN + np.array(sizes)[None, :])).astype(np.float32)
        longest = MARGIN + max(sizes) + MARGIN
        np.add.at(total, owners, pooled(net, x[:longest], counts[:longest]))
        lanes.clear(), owners.clear(), sizes.clear()

    for i, raw in enumerate(raws):
        if not raw:
            continue
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, len(data), WINDOW):
            lane = np.full(span, PAD, np.uint8)
            low, high = max(0, at - MARGIN), min(len(data), at + WINDOW + MARGIN)
            lane[MARGIN - (at - low) : MARGIN - (at - low) + high - low] = data[low:high]
            lanes.append(lane)
            owners.append(i)
            sizes.append(min(WINDOW, len(data) - at))
            if len(lanes) == LANES:
                flush()
    if lanes:
        flush()
    return total / np.maximum(1, [len(r) for r in raws])[:, None]


class LanguageModel(NamedTuple):
    labels: list[str]
    net: Network | None


def fit(docs: DataFrame, teaches: Column | None = None, sample: int = SAMPLE, taken: int = TAKEN, most_labels: int = 200) -> LanguageModel:
    """Learn from text and lang of the rows of docs(doc_id, text, lang) where ``teaches`` holds.

    The sample is bounded: about ``sample`` texts per language by a hash of the id, ``taken``
    characters of each from a place the hash gives. Every language is learnt; more than ``most_labels``
    of them are an error.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (teaches if teaches is not None else F.lit(True)))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} languages in lang: clean the column, or raise most_labels")
    if not counts:
        return LanguageModel([], None)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(v) for c in counts for v in (c["lang"], min(1_000_000, -(-1_500_000 * sample // c["count"])))])
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - taken, F.lit(1)))
    some = rows.where(place < share[F.col("lang")]).select("lang", F.xxhash64("doc_id").alias("place"), F.substring(F.col("text"), (at + 1).cast("int"), F.lit(taken)).alias("part"))
    found = some.orderBy("place", "part").limit(2 * sample * len(counts)).collect()
    found = [f for f in found if LETTER.search(f["part"])]
    labels = sorted({f["lang"] for f in found})
    if not labels:
        return LanguageModel([], None)
    index = {label: k for k, label in enumerate(labels)}
    net = train([f["part"].encode() for f in found], np.array([index[f["lang"]] for f in found]), len(labels))
    return LanguageModel(labels, net)


def identify(docs: DataFrame, model: LanguageModel, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, the extra columns, lang_pred, score) of every row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batch):
        some = batch["text"].to_pylist()
        raws = [t.encode("utf-8", "surrogatepass") if t and model.net is not None and LETTER.search(t) else b"" for t in some]
        p = probabilities(model.net, raws) if model.net is not None else np.zeros((len(raws), 1))
        best = p.argmax(1)
        return {
            "doc_id": batch["doc_id"],
            "lang_pred": [model.labels[k] if raw else UNKNOWN for k, raw in zip(best, raws)],
            "score": [float(min(1.0, p[i, k])) if raw else 0.0 for i, (k, raw) in enumerate(zip(best, raws))],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(per_slice(run, schema), "doc_id long, lang_pred string, score double")
    return found.withColumns(extra or {})
