"""Quality by random-indexing word vectors pooled per document and a two-layer network in numpy.

Random indexing: every context has a sparse index vector of +1 and -1, drawn from a hash of its name, and a word's vector
is the sum of the index vectors of the words beside it in the sample, as its left and its right neighbours, plus its own.
Contexts and words beyond the VOCABULARY most frequent ones go by their shape (letters, capitals, digits and marks,
runs folded), so every token of any text has a vector. A document is the mean of its tokens' vectors, with the shares of
different and of repeated tokens and the length beside it. The network's probabilities are divided by a temperature that
is fitted on a third of the sample which the weights never see.

Defined cases: null and empty texts are documents without tokens and get the network's value for a zero mean; without
labelled rows of both kinds every score is 0.5; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from bomlens.llm.common import crc_mod, tidied
from bomlens.llm.sampling import labelled_sample

HELD_OUT = (3, 1)
THRESHOLD = 0.5
#: Bounds of the labelled sample and of the words with vectors of their own.
PER_CLASS, MAX_CHARS, VOCABULARY = 2500, 50_000, 20_000
WIDTH, NONZERO, HIDDEN = 48, 6, 24
SHAPES = 2048
EPOCHS, BATCH, RATE, DECAY = 60, 64, 0.003, 1e-4
REMEMBERED = 150_000
_RUNS = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are; runs folded; tokens over 24 characters marked by +."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return _RUNS.sub(r"\1", kinds) + ("+" if len(token) > 24 else "")


def index_vector(name: str) -> np.ndarray:
    """The sparse vector of a context: NONZERO places of +1 or -1."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")))
    out = np.zeros(WIDTH, np.float32)
    out[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class TokenNumbers(dict):
    """The row of a token's vector: its own for frequent words, else that of its shape."""

    def __init__(self, words: dict[str, int], first: int):
        super().__init__(words)
        self.words, self.first = words, first

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(self.words)
        value = self[token] = self.first + xxhash.xxh3_64_intdigest(shape(token).encode("utf-8", "surrogatepass")) % SHAPES
        return value


class QualityModel:
    def __init__(self, words, vectors, mean, scale, layers, temperature):
        self.words, self.vectors, self.mean, self.scale, self.layers, self.temperature = words, vectors, mean, scale, layers, temperature

    def scores(self, texts: list, numbers: TokenNumbers) -> np.ndarray:
        x = (pooled(texts, numbers, self.vectors) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(logits(x, self.layers) / self.temperature, -50, 50)))


def pooled(texts: list, numbers: TokenNumbers, vectors: np.ndarray) -> np.ndarray:
    """The mean of the tokens' vectors, log length, share of different tokens, share that repeat their predecessor."""
    out = np.zeros((len(texts), vectors.shape[1] + 3), np.float32)
    for n, text in enumerate(texts):
        tokens = text.split() if text else []
        if tokens:
            ids = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
            out[n, :-3] = np.add.reduce([vectors[ids[at : at + 4096]].sum(axis=0) for at in range(0, len(ids), 4096)]) / len(ids)
            out[n, -3:] = np.log1p(len(tokens)), len(set(tokens)) / len(tokens), sum(map(eq, tokens, tokens[1:])) / len(tokens)
    return out


def logits(x: np.ndarray, layers: tuple) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def word_vectors(texts: list[str], words: dict[str, int]) -> np.ndarray:
    """Rows for words, then for SHAPES shapes: own index vector plus neighbours' index vectors, scaled to length 1."""
    first = len(words)
    numbers = TokenNumbers(words, first)
    size = first + SHAPES
    index = np.stack([index_vector(f"w{w}") for w in words] + [index_vector(f"s{k}") for k in range(SHAPES)])
    rows = np.zeros((size, WIDTH), np.float32)
    for text in texts:
        ids = np.fromiter(map(numbers.__getitem__, text.split()), dtype=np.int64)
        for left, right in ((ids[:-1], ids[1:]),):
            if len(left):
                np.add.at(rows, right, np.roll(index[left], 1, axis=1))
                np.add.at(rows, left, np.roll(index[right], -1, axis=1))
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)
    return np.concatenate([rows, index / np.sqrt(NONZERO)], axis=1)


def train(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple:
    """Two layers by Adam on the weighted log loss, in a fixed order of rows."""
    rng = np.random.default_rng(5)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            w1, b1, w2, b2 = params
            hidden = np.tanh(x[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -50, 50))) - y[part]) * cost[part] / len(part)
            back = np.outer(error, w2) * (1 - hidden**2)
            grads = [x[part].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(params)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, on a grid of powers."""
    grid = 2.0 ** np.arange(-3, 5.01, 0.1)
    losses = [np.mean(np.logaddexp(0, -np.where(y == 1, z, -z) / t)) for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(rows: list[tuple[str, int]]) -> QualityModel | None:
    """The model from labelled texts; None unless both labels occur."""
    labels = np.array([label for _, label in rows], dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        return None
    texts = [text for text, _ in rows]
    counts = Counter(w for text in texts for w in text.split())
    frequent = sorted((w for w, c in counts.items() if c >= 3), key=lambda w: (-counts[w], w))[:VOCABULARY]
    words = {w: n for n, w in enumerate(frequent)}
    vectors = word_vectors(texts, words).astype(np.float32)
    x = pooled(texts, TokenNumbers(words, len(words)), vectors).astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / scale
    apart = np.arange(len(x)) % 3 == 2
    cost = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    layers = train(x[~apart], labels[~apart], cost[~apart])
    temperature = fit_temperature(logits(x[apart], layers), labels[apart]) if apart.any() else 1.0
    return QualityModel(words, vectors, mean, scale, layers, temperature)


def quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    rows = labelled_sample(docs, labels, "quality", *HELD_OUT, PER_CLASS, MAX_CHARS)
    return fit(rows) if rows else None


def with_score(docs: DataFrame, model: QualityModel | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        fitted = shared.value
        numbers = None if fitted is None else TokenNumbers(fitted.words, len(fitted.words))
        for batch in batches:
            parts = [np.full(batch.num_rows, 0.5)] if fitted is None else [fitted.scores(batch.column(at).slice(k, 500).to_pylist(), numbers) for k in range(0, batch.num_rows, 500)]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the rows that are not held out."""
    selected = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col("text"))
    scored = with_score(selected, quality_model(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return with_score(docs, quality_model(docs, labels), name=name).filter(F.col(name) >= THRESHOLD).drop(name)
