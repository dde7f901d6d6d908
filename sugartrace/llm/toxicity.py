"""Toxicity from a bidirectional gated recurrent network with attention pooling, trained in numpy.

The network reads windows of WINDOW words, each word as a learnt vector of the word (if training saw it in enough
different contexts) beside the mean of learnt vectors of its character trigrams. Two gated recurrences run over the
window, attention pools their states, and a document is as toxic as its most toxic window. Windows overlap by
half and cover every word of every text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace.llm.common import held_out, labelled_sample, small_batches

SAMPLE = 3000  # labelled documents the network is trained on at most
LONGEST = 20_000  # characters of such a document
WINDOW, STRIDE = 32, 16
HIDDEN, WORD, CHAR = 8, 8, 8
TRIGRAMS = 4096
CONTEXTS = 8  # different neighbours a word needs to get a vector of its own
EPOCHS, STEPS = 8, 96  # passes and steps at least
TAUGHT = 256  # documents of a step
TOGETHER = 4096  # windows that run side by side
KNOWN = 200_000  # words whose inputs a worker keeps; only speed depends on it

_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_LETTERS).split()


def trigrams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words one after another (word ends marked by a space), and where each word's begin."""
    octets = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = ((octets[:-2] * 961 + octets[1:-1] * 31 + octets[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 2) - sizes - 2
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return code[inside] % TRIGRAMS, np.cumsum(sizes) - sizes


def windows_of(count: int) -> np.ndarray:
    """First words of the windows of a text of `count` words."""
    if count <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, count - WINDOW, STRIDE)
    return np.append(starts, count - WINDOW)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, and the forward and backward pass over a batch of windows."""

    def __init__(self, vocabulary: list[bytes], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        wide = WORD + CHAR
        self.weights = {
            "words": 0.1 * rng.standard_normal((len(vocabulary) + 1, WORD)).astype(np.float32),
            "chars": 0.1 * rng.standard_normal((TRIGRAMS, CHAR)).astype(np.float32),
            "v": draw(2 * HIDDEN),
            "out": draw(2 * HIDDEN),
            "bias": np.full(1, -2.0, np.float32),
        }
        self.weights["words"][0] = 0
        for way in "fb":
            self.weights |= {f"x{way}": draw(wide, 3 * HIDDEN), f"h{way}": draw(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.slope, self.level = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, trigrams and their starts, and the input vectors of `words`."""
        numbers = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, starts = trigrams_of(words)
        sums = np.add.reduceat(self.weights["chars"][grams], starts) if len(words) else np.zeros((0, CHAR), np.float32)
        sizes = np.diff(np.append(starts, len(grams)))
        return numbers, grams, starts, np.concatenate([self.weights["words"][numbers], sums / np.maximum(sizes, 1)[:, None]], 1)

    def gates(self, vectors: np.ndarray, way: str) -> np.ndarray:
        return vectors @ self.weights[f"x{way}"] + self.weights[f"c{way}"]

    def run(self, gates: dict[str, np.ndarray], ids: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logit of each window. `gates`: input part of the gates by word; ids, real: (windows, WINDOW)."""
        count, memory = len(ids), {}
        states = np.zeros((WINDOW, count, 2 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            recurrent = self.weights[f"h{way}"]
            h = np.zeros((count, HIDDEN), np.float32)
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                x = gates[way][ids[:, t]]
                two = sigmoid(x[:, : 2 * HIDDEN] + h @ recurrent[:, : 2 * HIDDEN])
                z, r = two[:, :HIDDEN], two[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ recurrent[:, 2 * HIDDEN :])
                step = z * real[:, t, None]
                if keep:
                    memory[way, t] = (h, z, r, c, step)
                h = h + step * (c - h)
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        attention = states @ self.weights["v"]
        attention = np.where(real.T, attention, -1e9)
        attention = np.exp(attention - attention.max(0))
        attention /= attention.sum(0)
        pooled = (attention[:, :, None] * states).sum(0)
        logit = pooled @ self.weights["out"] + self.weights["bias"]
        return (logit, memory, states, attention, pooled) if keep else logit

    def back(self, push: np.ndarray, ids, real, vectors, memory, states, attention, pooled) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the input vectors for d(loss)/d(logit) = push."""
        w = self.weights
        grads = {"bias": push.sum(keepdims=True), "out": pooled.T @ push}
        d_pooled = push[:, None] * w["out"]
        d_states = attention[:, :, None] * d_pooled
        d_attention = (states * d_pooled).sum(2)
        d_score = attention * (d_attention - (attention * d_attention).sum(0))
        grads["v"] = np.einsum("tnh,tn->h", states, d_score)
        d_states = d_states + d_score[:, :, None] * w["v"]
        d_vectors = np.zeros_like(vectors)
        for k, way in enumerate("fb"):
            recurrent = w[f"h{way}"]
            grads |= {f"x{way}": np.zeros_like(w[f"x{way}"]), f"h{way}": np.zeros_like(recurrent), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
            d_next = np.zeros((len(ids), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                h, z, r, c, step = memory[way, t]
                d_h = d_next + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_z = d_h * (c - h) * real[:, t, None] * z * (1 - z)
                d_c = d_h * step * (1 - c**2)
                d_rh = d_c @ recurrent[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                two = np.concatenate([d_z, d_r], 1)
                d_next = d_h * (1 - step) + d_rh * r + two @ recurrent[:, : 2 * HIDDEN].T
                grads[f"h{way}"][:, : 2 * HIDDEN] += h.T @ two
                grads[f"h{way}"][:, 2 * HIDDEN :] += (r * h).T @ d_c
                whole = np.concatenate([two, d_c], 1)
                grads[f"c{way}"] += whole.sum(0)
                grads[f"x{way}"] += vectors[ids[:, t]].T @ whole
                np.add.at(d_vectors, ids[:, t], whole @ w[f"x{way}"].T)
        return grads, d_vectors


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts with `counts` words laid end to end: word places (windows, WINDOW), which exist, and first window of each text."""
    firsts = [windows_of(int(n)) for n in counts]
    many = np.array([len(f) for f in firsts], np.int64)
    offset = np.repeat(np.cumsum(counts) - counts, many)
    local = np.concatenate(firsts)[:, None] + np.arange(WINDOW)
    real = local < np.repeat(counts, many)[:, None]
    return np.where(real, local + offset[:, None], 0), real, np.cumsum(many) - many


class Scorer:
    """A trained network applied to texts; inputs of words met before are kept."""

    def __init__(self, network: Network):
        self.network = network
        self.numbers: dict[bytes, int] = {}
        self.tables = {way: np.zeros((1, 3 * HIDDEN), np.float32) for way in "fb"}
        self.used = 1  # row 0 stands for a missing word

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if self.used > KNOWN:
            self.numbers.clear()
            self.used = 1
        new = [word for word in set(words) if word not in self.numbers]
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            _, _, _, vectors = self.network.inputs(part)
            end = self.used + len(part)
            for way, table in self.tables.items():
                if end > len(table):
                    self.tables[way] = table = np.concatenate([table, np.zeros((max(end - len(table), len(table)), 3 * HIDDEN), np.float32)])
                table[self.used : end] = self.network.gates(vectors, way)
            self.numbers.update(zip(part, range(self.used, end)))
            self.used = end
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str]) -> np.ndarray:
        """Logit of the most toxic window of each text; a text without words is one empty window."""
        words = [words_of(t) for t in texts]
        counts = np.array([len(x) for x in words], np.int64)
        ids = np.append(self.look_up([w for x in words for w in x]), 0)
        places, real, firsts = layout(counts)
        found = np.empty(len(places), np.float32)
        for begin in range(0, len(places), TOGETHER):
            some = slice(begin, begin + TOGETHER)
            found[some] = self.network.run(self.tables, np.where(real[some], ids[places[some]], 0), real[some])
        return np.maximum.reduceat(found, firsts) if len(firsts) else np.empty(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.network.slope * self.logits(texts).astype(np.float64) + self.network.level)


def vocabulary_of(documents: list[list[bytes]]) -> list[bytes]:
    """Words with at least CONTEXTS different pairs of neighbours, so copies of a text count once."""
    contexts: dict[bytes, set] = defaultdict(set)
    for words in documents:
        for left, word, right in zip([b"", *words], words, [*words[1:], b""]):
            if len(kept := contexts[word]) < CONTEXTS:
                kept.add(hash((left, right)))
    return sorted(w for w, kept in contexts.items() if len(kept) >= CONTEXTS)


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """Train by the most toxic window of each document. Without both labels every score is the share of label 1 (0 for none)."""
    labels = np.asarray(labels, np.float32)
    documents = [words_of(t) for t in texts]
    if len(set(labels.tolist())) < 2:
        network = Network([])
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
        network.slope, network.level = 0.0, math.log(share / (1 - share))
        return network
    network = Network(vocabulary_of(documents))
    weights = network.weights
    rng = np.random.default_rng(1)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    steps = 0
    epochs = max(EPOCHS, math.ceil(STEPS / math.ceil(len(documents) / TAUGHT)))
    for epoch in range(epochs):
        order = rng.permutation(len(documents))
        for begin in range(0, len(order), TAUGHT):
            chosen = order[begin : begin + TAUGHT]
            some = [documents[i] for i in chosen]
            counts = np.array([len(x) for x in some], np.int64)
            present = sorted({w for x in some for w in x}) or [b""]
            local = {w: i for i, w in enumerate(present)}
            ids = np.append(np.fromiter((local[w] for x in some for w in x), np.int64, int(counts.sum())), 0)
            word_ids, grams, starts, vectors = network.inputs(present)
            gates = {way: network.gates(vectors, way) for way in "fb"}
            places, real, firsts = layout(counts)
            ids = np.where(real, ids[places], 0)
            logits = np.concatenate([network.run(gates, ids[a : a + TOGETHER], real[a : a + TOGETHER]) for a in range(0, len(ids), TOGETHER)])
            ends = np.append(firsts[1:], len(ids))
            top = np.array([a + logits[a:b].argmax() for a, b in zip(firsts, ends)])
            logit, *kept = network.run(gates, ids[top], real[top], keep=True)
            push = (sigmoid(logit) - labels[chosen]) / len(chosen)
            grads, d_vectors = network.back(push.astype(np.float32), ids[top], real[top], vectors, *kept)
            grads["words"] = np.zeros_like(weights["words"])
            np.add.at(grads["words"], word_ids, d_vectors[:, :WORD])
            grads["words"][0] = 0
            sizes = np.diff(np.append(starts, len(grams)))
            share = d_vectors[:, WORD:] / np.maximum(sizes, 1)[:, None]
            touched = np.repeat(np.abs(d_vectors).sum(1) > 0, sizes)
            grads["chars"] = np.zeros_like(weights["chars"])
            np.add.at(grads["chars"], grams[touched], np.repeat(share, sizes, 0)[touched])
            steps += 1
            rate = 0.02 * (1 if epoch < epochs - max(4, epochs // 4) else 0.3)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)
                weights[k] *= 1 - 1e-4
    raw = Scorer(network).logits(texts).astype(np.float64)
    slope, level = 1.0, 0.0
    for _ in range(100):  # scale of the scores: logistic regression on one number
        p = sigmoid(slope * raw + level)
        curve = p * (1 - p) + 1e-6
        gradient = np.array([((p - labels) * raw).sum() + 0.1 * (slope - 1), (p - labels).sum()])
        hessian = np.array([[(curve * raw**2).sum() + 0.1, (curve * raw).sum()], [(curve * raw).sum(), curve.sum()]])
        move = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        slope, level = slope - move[0], level - move[1]
    network.slope, network.level = float(slope), float(level)
    return network


def train(docs: DataFrame, labels: DataFrame) -> Network:
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, LONGEST).collect()  # bounded by SAMPLE and LONGEST
    unique = {r.text: r.label for r in sample}  # copies of a text count once
    return fit(list(unique), np.array([float(v > 0) for v in unique.values()]))


def scores(docs: DataFrame, network: Network, out: str = "score") -> DataFrame:
    """`docs` with the toxicity of each text appended. Null and empty texts are one empty window."""
    small_batches(docs.sparkSession, 250)
    whole = docs.select("*", F.coalesce("text", F.lit("")).alias("_text"))
    schema = docs.withColumn(out, F.lit(0.0)).schema
    known = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(scorer.scores(texts))], batch.schema.names[:-1] + [out])

    return whole.mapInArrow(score, schema)


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted. Repeated rows stay; a null doc_id is never held out."""
    scored = scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
