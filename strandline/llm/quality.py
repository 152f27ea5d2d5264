"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a document, several of them on
every kind of junk. The counts of all vote patterns over the whole corpus (at most 3 to the number
of labellers, so bounded) go to the driver, where expectation-maximisation estimates how often each
labeller is wrong on good and on bad documents, and with it every pattern's posterior. Bad documents
come in kinds, on which different labellers agree, so the model is a mixture of classes, as many as
the Bayesian information criterion supports; nothing about a labeller's accuracy is fixed
beforehand. Good are the class with the fewest bad votes and those like it but for a single
labeller's dissent. A hashed linear scorer, trained on a bounded sample of documents with these
posteriors as labels, then scores every whole text.

Defined cases: a null text, or one without a word, gets score 0 and is rejected; repeated rows
and ids each get a result; an empty table gives an empty result. The labels table plays no part.
"""

from __future__ import annotations

import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice, slices, texts

#: Signs that don't end words in prose.
SIGNS = "#*$%&"
#: A sign twice in a row, other than dots and dashes.
DOUBLED = regex.compile(r"([^\p{L}\p{N}\s.\-–—_])\1")
#: Documents that train the scorer, the words taken from each, and the width of its hashed weights.
SAMPLE, TAKEN, WIDTH = 4_000, 2_000, 1 << 16
ENDS = (".", "!", "?", "…", ":", ";", '"', "”", "»", "。", ")")
LABELLERS = ("symbols", "sign_runs", "capitals", "exclamation", "bars", "lone_signs", "stutter", "variety", "line_ends", "repeated_lines", "word_length")
#: Labellers need so many words to say anything.
FEW = 5
#: Bad votes that a class has to have beyond the cleanest one's, on average, to be bad: more than one labeller's dissent.
DISSENT = 1.25
NEAR = 20


def vote(value: float, good: float, bad: float) -> int:
    """1 up to good, -1 from bad on, else 0."""
    return 1 if value <= good else -1 if value >= bad else 0


def votes(text: str | None) -> list[int]:
    """One vote for each of LABELLERS; all nothing if there are too few words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if n < FEW:
        return [0] * len(LABELLERS)
    chars = sum(map(len, words))
    letters = sum(map(str.isalpha, text))
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    repeated = sum(map(len, lines)) - sum(map(len, set(lines)))
    near = sum(len(set(words[i : i + NEAR])) for i in range(0, n - n % NEAR, NEAR)) / max(1, n - n % NEAR)
    length = chars / n
    return [
        vote(sum(map(text.count, SIGNS)) / chars, 0.02, 0.08),
        vote(sum(1 for _ in DOUBLED.finditer(text)) / n, 0.05, 0.2),
        vote(sum(map(str.isupper, text)) / max(1, letters), 0.25, 0.5),
        vote(text.count("!") / n, 0.1, 0.4),
        vote(text.count("|") / n, 0.02, 0.15),
        vote(sum(len(w) < 4 and not any(map(str.isalnum, w)) for w in words) / n, 0.05, 0.2),
        vote(sum(a == b for a, b in zip(words, words[1:])) / n, 0.05, 0.3),
        0 if n < NEAR else 1 if near >= 0.6 else -1 if near <= 0.4 else 0,
        vote(1 - sum(line.endswith(ENDS) for line in lines) / len(lines), 0.4, 0.8),
        vote(repeated / chars, 0.1, 0.5),
        1 if 2 <= length <= 14 else -1,
    ]


class VoteModel(NamedTuple):
    shares: np.ndarray  # of the classes
    bad_votes: np.ndarray  # classes x labellers: chance that a vote is bad
    good: np.ndarray  # which classes are good documents

    @property
    def prior(self) -> float:
        """Share of good documents."""
        return float(self.shares[self.good].sum())

    def _pooled(self, classes: np.ndarray) -> np.ndarray:
        weights = self.shares * classes
        return weights @ self.bad_votes / max(weights.sum(), 1e-12)

    @property
    def on_good(self) -> np.ndarray:
        """Each labeller's accuracy on good documents: the chance that its vote is good."""
        return 1 - self._pooled(self.good)

    @property
    def on_bad(self) -> np.ndarray:
        """Each labeller's accuracy on bad documents: the chance that its vote is bad."""
        return self._pooled(~self.good)

    def likelihoods(self, patterns: np.ndarray) -> np.ndarray:
        """Patterns x classes: log of share times the chance of the votes; labellers without a vote don't count."""
        up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
        return np.log(self.shares) + up @ np.log1p(-self.bad_votes).T + down @ np.log(self.bad_votes).T

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good for each row of votes; without votes the prior."""
        each = self.likelihoods(patterns)
        each = np.exp(each - each.max(1, keepdims=True))
        return each[:, self.good].sum(1) / each.sum(1)


def maximise(patterns: np.ndarray, counts: np.ndarray, model: VoteModel, rounds: int = 500) -> tuple[VoteModel, float]:
    """Expectation-maximisation from a model: the model where it rests, and the log-likelihood."""
    up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
    last = -np.inf
    for _ in range(rounds):
        each = model.likelihoods(patterns)
        top = each.max(1, keepdims=True)
        total = np.log(np.exp(each - top).sum(1)) + top[:, 0]
        fit = float(counts @ total)
        if fit - last < 1e-7 * abs(fit):
            break
        last = fit
        weight = np.exp(each - total[:, None]) * counts[:, None]
        # One vote of each kind besides keeps the chances off 0 and 1.
        bad = (weight.T @ down + 1) / (weight.T @ (up + down) + 2)
        model = VoteModel((weight.sum(0) + 1) / (counts.sum() + len(model.shares)), bad, model.good)
    return model, last


def fit_votes(patterns: np.ndarray, counts: np.ndarray, most_classes: int | None = None) -> VoteModel:
    """Classes one by one, each from the pattern that the others explain worst, while the criterion gains.

    ``most_classes`` is twice the number of labellers where it isn't given.
    """
    labellers, n = patterns.shape[1], counts.sum()
    if not n:
        return VoteModel(np.ones(1), np.full((1, labellers), 0.5), np.ones(1, bool))
    clean = ~(patterns < 0).any(1)
    model, fit = maximise(patterns, counts, VoteModel(np.ones(1), np.full((1, labellers), 0.1), np.ones(1, bool)))
    for _ in range((most_classes or 2 * labellers) - 1):
        each = model.likelihoods(patterns)
        top = each.max(1)
        lost = counts * (np.log(counts / n) - np.log(np.exp(each - top[:, None]).sum(1)) - top)
        tried = []
        # From the pattern explained worst, and from the worst one without a bad vote: either may be the missing class.
        for some in {int(lost.argmax()), int(np.where(clean, lost, -np.inf).argmax())}:
            seed = np.where(patterns[some] < 0, 0.9, 0.1)
            start = VoteModel(np.append(0.8 * model.shares, 0.2), np.vstack([model.bad_votes, seed]), np.ones(len(model.shares) + 1, bool))
            tried.append(maximise(patterns, counts, start))
        new, better = max(tried, key=lambda t: t[1])
        if 2 * (better - fit) <= (labellers + 1) * np.log(n):
            break
        model, fit = new, better
    expected = model.bad_votes.sum(1)
    return model._replace(good=(expected - expected.min() < DISSENT) & ((expected <= labellers / 2) | (expected == expected.min())))


PARTS = regex.compile(r"(\p{Lu}+)|(\p{L}+)|(\p{N}+)|([^\p{L}\p{N}])\4*")


def shape(word: str) -> str:
    """Upper-case runs as A, other letters as a, digits as 0, a sign or a run of it as one or two."""
    core, mark = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
    if core.isalpha():
        if core.islower():
            return "a" + mark
        if core[:1].isupper() and core[1:].islower():
            return "Aa" + mark
    return "".join("A" if m[1] else "a" if m[2] else "0" if m[3] else m[0][:2] for m in PARTS.finditer(word))


class Features:
    """Sparse hashed features of a text: shares of word shapes, of words, and of stuttered words."""

    def __init__(self, width: int = WIDTH, room: int = 300_000):
        self.width, self.room, self.known = width, room, {}

    def slot(self, kind: str, what: str) -> int:
        return zlib.crc32(f"{kind} {what}".encode("utf-8", "surrogatepass")) % self.width

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words, known = (text or "").split(), self.known
        found = list(map(known.get, words))
        if None in found:
            new = {w: (self.slot("shape", shape(w)), self.slot("word", w.lower())) for w in dict.fromkeys(w for w, f in zip(words, found) if f is None)}
            found = [f or new[w] for w, f in zip(words, found)]
            if len(known) < self.room:
                known.update(new)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        slots, counts = np.unique(np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)), return_counts=True)
        same = sum(a == b for a, b in zip(words, words[1:]))
        slots, counts = np.append(slots, self.slot("stutter", "")), np.append(counts, 4 * same)
        return slots, counts / len(words)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, rounds: int = 150, rate: float = 1.0, ridge: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last is the constant) by full-batch AdaGrad on soft labels."""
    lengths = np.array([len(s) for s, _ in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    slots = np.concatenate([s for s, _ in rows]) if rows else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    weights, squares = np.zeros(width + 1), np.full(width + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights[slots] * values, len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / max(1, len(rows))
        step = np.append(np.bincount(slots, values * error[row], width), error.sum()) + ridge * weights
        squares += step * step
        weights -= rate * step / np.sqrt(squares)
    return weights


def part(text: str | None, place: int, taken: int = TAKEN) -> str | None:
    """The text, or ``taken`` neighbouring words of a longer one."""
    words = (text or "").split()
    if len(words) <= taken:
        return text
    at = place % (len(words) - taken + 1)
    return " ".join(words[at : at + taken])


class QualityModel(NamedTuple):
    votes: VoteModel
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> QualityModel:
    """Vote patterns from all of docs(doc_id, text); the scorer from ``sample`` of them at most, by hash of the id.

    Of each of these TAKEN neighbouring words at most go to the driver as features, from a place its hash gives.
    """
    rows = texts(docs)
    voted = pa.schema([("pattern", pa.string())])
    spell = lambda text: "".join("-0+"[v + 1] for v in votes(text))
    patterns = rows.mapInArrow(per_slice(lambda b: {"pattern": [spell(t) for t in b["text"].to_pylist()]}, voted), "pattern string").groupBy("pattern").count().collect()
    read = lambda some: np.array([["-0+".index(c) - 1 for c in p] for p in some], float).reshape(-1, len(LABELLERS))
    model = fit_votes(read([p["pattern"] for p in patterns]), np.array([p["count"] for p in patterns], float))

    schema = pa.schema([("place", pa.int64()), ("pattern", pa.string()), ("slots", pa.list_(pa.int64())), ("shares", pa.list_(pa.float64()))])

    def featured(batches):
        features = Features(width)
        for batch in slices(batches):
            found = [(spell(t), *features.of(part(t, k))) for t, k in zip(batch["text"].to_pylist(), batch["place"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"place": batch["place"], "pattern": [p for p, _, _ in found], "slots": [s for _, s, _ in found], "shares": [v for _, _, v in found]}, schema=schema)

    place = F.xxhash64("doc_id", F.length("text"))
    n = sum(p["count"] for p in patterns)
    # About twice the sample, so that few texts are read and the sorted limit cuts the rest.
    chance = min(1.0, 2 * sample / max(1, n))
    some = rows.select(place.alias("place"), "text").where(F.pmod("place", F.lit(1_000_000)) < int(1_000_000 * chance) + 1)
    taken = some.mapInArrow(featured, "place long, pattern string, slots array<long>, shares array<double>").orderBy("place", "pattern").limit(sample).collect()
    taken = [t for t in taken if t["slots"]]
    weights = train([(np.array(t["slots"]), np.array(t["shares"])) for t in taken], model.posterior(read([t["pattern"] for t in taken])), width)
    return QualityModel(model, weights)


def scorer(model: QualityModel):
    weights = model.weights.astype(np.float32)
    width = len(weights) - 1

    def scores(features: Features, some: list[str | None]) -> list[float]:
        out = []
        for text in some:
            slots, shares = features.of(text)
            z = float(weights[slots] @ shares + weights[-1]) if len(slots) else -np.inf
            out.append(float(1 / (1 + np.exp(-max(z, -700)))) if len(slots) else 0.0)
        return out

    return width, scores


def score_documents(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, kept) of every row of docs(doc_id, text)."""
    width, scores = scorer(model or fit(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        features = Features(width)
        for batch in slices(batches):
            found = scores(features, batch["text"].to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": found, "kept": [s >= threshold for s in found]}, schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_documents(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the scorer keeps, all columns as they were.

    A null text, or one without a word, goes; repeated rows and ids are judged each, equal texts
    alike; other columns, whatever their names, play no part; an empty table gives an empty one.
    """
    width, scores = scorer(model or fit(docs))

    def run(batches):
        features = Features(width)
        for batch in slices(batches):
            yield batch.filter(pa.array([s >= threshold for s in scores(features, batch["text"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
