"""Operator 3: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label. Each passage becomes a vector of counts
(kinds of characters, word lengths, words that repeat what stands shortly before), which a small layer encodes. Gated
attention, the product of a tanh and a sigmoid branch, weighs the passages; the weighted encoding is scored. All of it is
learned from the documents' labels alone, so attention finds the passages that decide.

The fit reads at most ``MOST_DOCS`` labelled documents, taken by the hash of their id. Fit and scoring read whole texts,
every passage of every document.

Cases: a null or empty text, or one of white space, is one empty passage and gets a score like any other. Of repeated
labels of an id the smallest counts; null labels don't. Without labels, or with one kind only, every score is the share of
label 1 (0.5 without any). Documents with a null id are scored and not held out. An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import release, slices, utf8, word_hashes, word_spans

PASSAGE, MOST_DOCS, THRESHOLD = 48, 6000, 0.3
HELD_OUT = 5

_KINDS = 12
_KIND = np.full(256, 10, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x20, 0x09, 0x0B, 0x0C]] = 3
_KIND[[0x0A, 0x0D]] = 4
_KIND[[ord(".")]] = 5
_KIND[[ord(c) for c in ",;:"]] = 6
_KIND[[ord(c) for c in "!?"]] = 7
_KIND[[ord("|")]] = 8
_KIND[[ord(c) for c in "#$%&*@~^+=<>_\\/"]] = 9
_KIND[0x80:] = 11
_LAGS = (1, 2, 3, 5, 8)
FEATURES = _KINDS + 1 + 4 + len(_LAGS) + 1


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of all texts, and where each text's begin (one more entry for the end)."""
    data, at = utf8(column)
    n = len(column)
    starts, ends, doc = word_spans(data, at)
    hashes, _ = word_hashes(column)
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    bags = np.maximum(1, -(-count // PASSAGE))
    first_word, first_bag = np.cumsum(count) - count, np.cumsum(bags) - bags
    total = int(bags.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if len(starts):
        in_doc = np.arange(len(starts)) - np.repeat(first_word, count)
        bag = np.repeat(first_bag, count) + in_doc // PASSAGE
        words = np.bincount(bag, minlength=total).astype(np.float32)
        some = np.maximum(words, 1)
        # Bytes from a passage's first word to the next passage's; white space before a text's first word has no part.
        opens = np.flatnonzero(np.diff(bag, prepend=-1))
        length = np.diff(np.append(starts[opens], len(data)))
        of_byte = np.repeat(bag[opens].astype(np.int32), length) * _KINDS
        rest = data[starts[0] :]
        kinds = np.bincount(of_byte + _KIND[rest], minlength=total * _KINDS).reshape(total, _KINDS).astype(np.float32)
        size = np.maximum(kinds.sum(axis=1), 1)
        out[:, :_KINDS] = kinds / size[:, None]
        # Capitals of the Latin-1 block take two bytes, the second from 0x80 to 0x9E.
        capital = np.flatnonzero((rest[1:] >= 0x80) & (rest[1:] <= 0x9E) & (rest[:-1] == 0xC3)) if len(rest) > 1 else np.zeros(0, np.int64)
        out[:, _KINDS] = np.bincount(of_byte[capital] // _KINDS, minlength=total) / size
        width = ends - starts
        last = _KIND[data[ends - 1]]
        for k, x in enumerate((np.minimum(width, 40) / 10, width <= 3, last >= 5, last == 7)):
            out[:, _KINDS + 1 + k] = np.bincount(bag, weights=x, minlength=total) / some
        for k, lag in enumerate(_LAGS):
            if len(hashes) > lag:
                same = (hashes[lag:] == hashes[:-lag]) & (in_doc[lag:] >= lag)
                out[:, _KINDS + 5 + k] = np.bincount(bag[lag:], weights=same, minlength=total) / some
        out[:, -1] = words == 0
    else:
        out[:, -1] = 1
    return out, np.append(first_bag, total)


@dataclass
class Model:
    """The encoder, the gated attention and the last layer; or a constant score."""

    constant: float | None = None
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES, np.float32))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        x = (x - self.mean) * self.scale
        e = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-(e @ w["U"])))
        a = (t * g) @ w["a"]
        size = np.diff(at)
        top = np.maximum.reduceat(a, at[:-1])
        p = np.exp(a - np.repeat(top, size))
        p /= np.repeat(np.add.reduceat(p, at[:-1]), size)
        z = np.add.reduceat(e * p[:, None], at[:-1])
        return z @ w["c"] + w["b"], (x, e, t, g, p, z, size)

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        out, _ = self.forward(x, at)
        return 1 / (1 + np.exp(-np.clip(out.astype(np.float64), -40, 40)))


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Model:
    """Learns a model from bags of passage vectors and labels 0 and 1, by Adam on the log loss."""
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.5)
    flat = np.concatenate(bags)
    mean, sd = flat.mean(axis=0), flat.std(axis=0)
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"E": normal(FEATURES, hidden), "e": np.zeros(hidden, np.float32), "V": normal(hidden, gate), "U": normal(hidden, gate), "a": normal(gate), "c": normal(hidden), "b": np.zeros(1, np.float32)}
    model = Model(mean=mean, scale=(1 / np.maximum(sd, 1e-3)).astype(np.float32), weights=w)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        now = rate * (1 - epoch / epochs) + rate / 50
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            at = np.cumsum([0, *(len(bags[k]) for k in own)])
            out, (x, e, t, g, p, z, size) = model.forward(np.concatenate([bags[k] for k in own]), at)
            error = ((1 / (1 + np.exp(-np.clip(out, -40, 40))) - labels[own]) / len(own)).astype(np.float32)
            dz = np.repeat(error[:, None] * w["c"], size, axis=0)
            dp = (dz * e).sum(axis=1)
            da = p * (dp - np.repeat(np.add.reduceat(dp * p, at[:-1]), size))
            dh = da[:, None] * w["a"]
            dt, dg = dh * g * (1 - t * t), dh * t * g * (1 - g)
            de = (dz * p[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - e * e)
            grads = {"E": x.T @ de, "e": de.sum(axis=0), "V": e.T @ dt, "U": e.T @ dg, "a": (t * g).T @ da, "c": z.T @ error, "b": error.sum(keepdims=True)}
            step += 1
            for k, d in grads.items():
                d = d + 1e-5 * w[k]
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of ``label_col`` from labelled documents that aren't held out, ``most`` of them at most."""
    own = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sample = own.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, column in slices(batches):
            x, at = passages(column)
            rows = [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    # Ids may repeat in a table of documents; the sample's bound holds for them all the same. The order decides the fit.
    rows = text.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, y int, x binary").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and score of every row; or where ``keep``, the rows that reach the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    if keep:

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch, column in slices(batches, text_col):
                yield batch.filter(pa.array(sent.value.score(*passages(column)) >= threshold))

        return docs.mapInArrow(reached, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, column in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(*passages(column)), pa.float64())], ["doc_id", "score"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, most: int = MOST_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs, train(docs, labels, label_col, most))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
