"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is linear in its own features and those of the lines before and after
it; neighbouring labels are tied by learnt transitions. The document's quality is the mean of the lines' marginal
probabilities of good (forward-backward), weighted by their lengths, and put on the scale of the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace.llm.common import held_out, labelled_sample, small_batches

SAMPLE = 5000  # labelled documents the field is fitted on at most
LONGEST = 20_000  # characters of such a document
SLICE = 1 << 20  # bytes whose features are computed at a time
EPOCHS = 25
DECAY = 1e-3


def _classes() -> bytes:
    """Class of each byte: line end, space, lower, upper, digit, sentence mark, loud mark, other symbol, part of a longer character."""
    kinds = []
    for code in range(256):
        c = chr(code)
        if code == 10:
            kinds.append(0)
        elif code > 127:
            kinds.append(8)
        elif code <= 32 or code == 127:
            kinds.append(1)
        elif c.islower():
            kinds.append(2)
        elif c.isupper():
            kinds.append(3)
        elif c.isdigit():
            kinds.append(4)
        elif c in ".,;:'\"-()":
            kinds.append(5)
        elif c in "!?":
            kinds.append(6)
        else:
            kinds.append(7)
    return bytes(kinds)


CLASSES = _classes()
KINDS = 9
WIDTH = KINDS * KINDS + 7


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the lines' bytes, and the lines of each text (an empty text has one)."""
    lines = [t.encode("utf-8", "replace").split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    flat = [line for x in lines for line in x]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    pairs = np.zeros(len(flat) * KINDS * KINDS, np.int64)
    kinds = np.frombuffer((b"\n".join(flat) + b"\n").translate(CLASSES), np.uint8)
    ends = np.cumsum(sizes + 1)
    for begin in range(0, len(kinds), SLICE):
        piece = kinds[max(0, begin - 1) : begin + SLICE].astype(np.int64)
        if begin == 0:
            piece = np.concatenate([[0], piece])
        place = np.searchsorted(ends, np.arange(begin, min(begin + SLICE, len(kinds))), "right")
        code = place * (KINDS * KINDS) + piece[:-1] * KINDS + piece[1:]
        low, high = int(place[0]) * KINDS * KINDS, (int(place[-1]) + 1) * KINDS * KINDS
        pairs[low:high] += np.bincount(code - low, minlength=high - low)
    share = np.sqrt(pairs.reshape(len(flat), -1) / (sizes[:, None] + 1))
    own = np.empty((len(flat), 7))
    at = 0
    for document in lines:
        seen: set[bytes] = set()
        for line in document:
            words = line.split()
            n = len(words) or 1
            kinds_of = set(words)
            same = sum(map(eq, words, words[1:]))
            new = len(kinds_of - seen)
            seen |= kinds_of
            own[at] = (1, math.log1p(len(line)), math.log1p(len(words)), len(line) / n / 10, len(kinds_of) / n, same / n, new / n)
            at += 1
    return np.concatenate([share, own], 1).astype(np.float32), sizes, counts


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after in the same document; zeros where there is none."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    ends = np.cumsum(counts)
    before[(ends - counts)[counts > 0]] = 0
    after[(ends - 1)[counts > 0]] = 0
    return np.concatenate([features, before, after], 1)


def padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line number of step t of each document, and which of them exist."""
    steps = np.arange(counts.max())
    real = steps < counts[:, None]
    return np.where(real, (np.cumsum(counts) - counts)[:, None] + steps, 0), real


def _lse(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(evidence: np.ndarray, counts: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and expected transitions summed over all documents.

    Documents advance together, the longest first, so step t only touches those that have a line t.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    firsts = (np.cumsum(counts) - counts)[order]
    score = np.stack([np.zeros_like(evidence), evidence], 1)
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")  # documents with a line t
    forward = np.empty_like(score)
    backward = np.zeros_like(score)
    forward[firsts] = score[firsts]
    for t in range(1, len(alive)):
        at = firsts[: alive[t]] + t
        forward[at] = _lse(forward[at - 1][:, None, :] + ties.T) + score[at]
    for t in range(len(alive) - 2, -1, -1):
        at = firsts[: alive[t + 1]] + t
        backward[at] = _lse(ties + (score[at + 1] + backward[at + 1])[:, None, :])
    total = _lse(forward + backward)
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    inner = np.ones(len(evidence), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] + ties + (score[at] + backward[at])[:, None, :] - total[at][:, None, None]
    return good, np.exp(joint).sum(0)


class Field:
    """Weights of the field, the scale of its features, and the scale of its scores."""

    def __init__(self, mean, deviation, weights, ties, slope=1.0, level=0.0):
        self.mean, self.deviation, self.weights, self.ties = mean, deviation, weights, ties
        self.slope, self.level = slope, level

    def qualities(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        features, sizes, counts = line_features(texts)
        return self.from_features(features, sizes, counts)

    def from_features(self, features, sizes, counts) -> np.ndarray:
        evidence = with_neighbours((features - self.mean) / self.deviation, counts) @ self.weights
        good, _ = marginals(evidence, counts, self.ties)
        starts = np.cumsum(counts) - counts
        weight = sizes + 1.0
        mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(mean / (1 - mean)) + self.level)))


def fit(texts: list[str], labels: np.ndarray) -> Field:
    """Fit on documents; each line is taught its document's label. Without both labels the score is the share of good (0.5 for none)."""
    labels = np.asarray(labels, np.float64)
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        return Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(3 * WIDTH), np.zeros((2, 2)), 0.0, math.log(share / (1 - share)))
    features, sizes, counts = line_features(texts)
    mean, deviation = features.mean(0), features.std(0) + 1e-2
    mean[KINDS * KINDS], deviation[KINDS * KINDS] = 0, 1  # the constant
    inputs = with_neighbours((features - mean) / deviation, counts)
    of_line = np.repeat(labels, counts)
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(0)
    weights, ties = np.zeros(inputs.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(ties), np.zeros_like(ties)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(counts))
        for begin in range(0, len(order), 128):
            docs = order[begin : begin + 128]
            own = counts[docs]
            rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in docs])
            good, pairs = marginals(inputs[rows] @ weights, own, ties)
            push = inputs[rows].T @ (good - of_line[rows]) / len(docs) + DECAY * weights
            seen = np.zeros((2, 2))
            for label in (0, 1):
                seen[label, label] = (own[labels[docs] == label] - 1).sum()
            tie_push = (pairs - seen) / len(docs) + DECAY * ties
            step += 1
            for value, gradient, first, second in ((weights, push, moments[0], moments[1]), (ties, tie_push, moments[2], moments[3])):
                first += 0.1 * (gradient - first)
                second += 0.001 * (gradient**2 - second)
                value -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    field = Field(mean, deviation, weights, ties)
    raw = field.from_features(features, sizes, counts)
    raw = np.log(raw / (1 - raw))
    for _ in range(200):  # scale of the scores: logistic regression on one number
        p = 1 / (1 + np.exp(-(field.slope * raw + field.level)))
        curve = p * (1 - p) + 1e-6
        gradient = np.array([((p - labels) * raw).sum() + 0.01 * field.slope, (p - labels).sum()])
        hessian = np.array([[(curve * raw**2).sum() + 0.01, (curve * raw).sum()], [(curve * raw).sum(), curve.sum()]])
        move = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        field.slope, field.level = field.slope - move[0], field.level - move[1]
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field:
    sample = labelled_sample(docs, labels, "quality", SAMPLE, LONGEST).collect()  # bounded by SAMPLE and LONGEST
    unique = {r.text: r.label for r in sample}  # copies of a text count once
    return fit(list(unique), np.array([float(v > 0) for v in unique.values()]))


def scores(docs: DataFrame, field: Field, out: str = "score") -> DataFrame:
    """`docs` with the quality of each text appended. Null and empty texts are one empty line."""
    small_batches(docs.sparkSession)
    whole = docs.select("*", F.coalesce("text", F.lit("")).alias("_text"))
    kept = [f"`{c}`" for c in docs.columns]
    known = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = np.empty(len(texts))
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) < SLICE):
                    size += len(texts[end])
                    end += 1
                found[begin:end] = known.value.qualities(texts[begin:end])
                begin = end
            columns = batch.columns[:-1] + [pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1] + [out])

    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).schema
    return whole.mapInArrow(score, schema)


def quality_rows(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted. Repeated rows stay; a null doc_id is never held out."""
    scored = scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
