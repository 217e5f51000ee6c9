"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are laid out in overlapping chunks that cover all of it. Learned
filters run over each chunk and are max-pooled; the means and maxima of the chunks'
pooled filters go through a logistic unit.

The network is fitted on at most ``per_class`` labelled rows of either class (a bound
in rows; all chunks of their texts). Scoring reads whole texts. Rows with crc32(doc_id) mod 3 = 1 are never fitted on.

Defined cases: null text is the empty text, which gets the score of a chunk of
padding; a null id is not held out; without labelled rows of both classes every score
is the share of label 1 (0.5 without labels); null labels are ignored, repeated ones count each,
within the bound;
result columns replace input columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import boxed, importable_on_workers, text_of, unboxed

#: Labelled rows of each class that the network is fitted on at most.
PER_CLASS = 1000
CHUNK, OVERLAP = 512, 64
EMBEDDING, TAPS, FILTERS = 6, 8, 24
EPOCHS, BATCH, RATE = 10, 32, 0.01
PAD = 256
#: Chunks that go through the filters at a time.
AT_ONCE = 64
#: Chunks whose gradients are taken at a time; a text of any length is fitted on as a whole.
GRADIENT_CHUNKS = 2048


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks over the whole of ``data``, the last one padded."""
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.full((count - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class ByteNet:
    """Embedding, filters and logistic unit, with their gradients."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = weights or {
            "embedding": np.vstack([draw(256, EMBEDDING, scale=0.5), np.zeros((1, EMBEDDING), np.float32)]),
            "filters": draw(TAPS * EMBEDDING, FILTERS, scale=(TAPS * EMBEDDING) ** -0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "out": draw(2 * FILTERS, scale=0.1),
            "bias": np.zeros(1, np.float32),
        }

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        vectors = self.w["embedding"][chunks].reshape(len(chunks), CHUNK * EMBEDDING)
        view = np.lib.stride_tricks.sliding_window_view(vectors, TAPS * EMBEDDING, axis=1)
        return view[:, ::EMBEDDING].reshape(-1, TAPS * EMBEDDING)

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Largest response of each filter in each chunk, and where it is."""
        parts, places = [], []
        for a in range(0, len(chunks), AT_ONCE):
            part = chunks[a : a + AT_ONCE]
            response = (self.windows(part) @ self.w["filters"]).reshape(len(part), -1, FILTERS)
            if where:
                place = response.argmax(axis=1)
                places.append(place)
                parts.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
            else:
                parts.append(response.max(axis=1))
        out = np.maximum(np.concatenate(parts) + self.w["shift"], 0)
        return (out, np.concatenate(places)) if where else out

    def combined(self, pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Features of each text: mean and maximum over its chunks."""
        return np.hstack([np.add.reduceat(pooled, starts) / counts[:, None], np.maximum.reduceat(pooled, starts)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, held, rows = [], [], 0
        for data in texts:
            held.append(chunks_of(data))
            rows += len(held[-1])
            if rows > 4096:
                out.append(self._scores(held))
                held, rows = [], 0
        if held:
            out.append(self._scores(held))
        return np.concatenate(out) if out else np.zeros(0)

    def _scores(self, chunks: list[np.ndarray]) -> np.ndarray:
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        pooled = np.concatenate([self.pooled(c[a : a + 4096]) for c in [np.concatenate(chunks)] for a in range(0, len(c), 4096)])
        logit = self.combined(pooled, np.cumsum(counts) - counts, counts) @ self.w["out"] + self.w["bias"]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, chunks = np.cumsum(counts) - counts, np.concatenate(texts)
        pooled, place = self.pooled(chunks, where=True)
        features = self.combined(pooled, starts, counts)
        score = 1 / (1 + np.exp(-(features @ self.w["out"] + self.w["bias"])))
        error = ((score - labels) / len(labels)).astype(np.float32)
        down = error[:, None] * self.w["out"]
        owner = np.repeat(np.arange(len(texts)), counts)
        largest = pooled == features[owner, FILTERS:]
        pooled_down = (down[owner, :FILTERS] / counts[owner, None] + down[owner, FILTERS:] * largest) * (pooled > 0)
        embedding, filters = np.zeros((PAD + 1, EMBEDDING)), np.zeros_like(self.w["filters"])
        for a in range(0, len(chunks), GRADIENT_CHUNKS):
            some, back_some = chunks[a : a + GRADIENT_CHUNKS], pooled_down[a : a + GRADIENT_CHUNKS]
            spots = place[a : a + GRADIENT_CHUNKS, :, None] + np.arange(TAPS)
            symbols = some[np.arange(len(some))[:, None, None], spots]
            vectors = self.w["embedding"][symbols].reshape(len(some), FILTERS, -1)
            back = (back_some[:, :, None] * self.w["filters"].T).reshape(-1, EMBEDDING)
            embedding += np.stack([np.bincount(symbols.ravel(), back[:, e], PAD + 1) for e in range(EMBEDDING)], axis=1)
            filters += np.einsum("nfk,nf->kf", vectors, back_some, optimize=True)
        embedding[PAD] = 0
        return {
            "embedding": embedding.astype(np.float32),
            "filters": filters,
            "shift": pooled_down.sum(axis=0),
            "out": error @ features,
            "bias": error.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> ByteNet:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        laid = [chunks_of(data) for data in texts]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square, step = {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(laid))
            rate = RATE * (1 - epoch / epochs)
            for a in range(0, len(order), BATCH):
                mine, step = order[a : a + BATCH], step + 1
                for k, g in self.gradients([laid[i] for i in mine], labels[mine]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[str, np.ndarray], float]:
    """Weights from a bounded sample, and the log odds of label 1 among all rows to learn from.

    The fit runs in one task; only weights come to the driver.
    """
    usable = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-3), 1 - 1e-3) if counts else 0.5
        return {}, float(np.log(share / (1 - share)))
    pick = lambda k: usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id")
    # ids that repeat cannot make the sample larger
    sample = sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * per_class)

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["doc_id", "text"])
        net = ByteNet().fit([t.encode() for t in rows["text"]], rows["label"].to_numpy(np.float32))
        # the sample is balanced; the log odds are given back by the caller
        share = rows["label"].mean()
        net.w["bias"] = net.w["bias"] - np.float32(np.log(share / (1 - share)) if 0 < share < 1 else 0)
        yield pd.DataFrame({"name": list(net.w), "body": [v.astype("<f4").tobytes() for v in net.w.values()], "shape": [list(v.shape) for v in net.w.values()]})

    rows = sample.repartition(1).mapInPandas(learn, "name string, body binary, shape array<int>").collect()
    return {r.name: np.frombuffer(r.body, "<f4").reshape(r["shape"]) for r in rows}, float(np.log(counts[1] / counts[0]))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    importable_on_workers(docs.sparkSession)
    weights, odds = fitted(docs, labels, per_class)
    if weights:
        weights = weights | {"bias": weights["bias"] + np.float32(odds)}

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = ByteNet(weights)
        for texts in batches:
            yield pa.array(net.scores([t.as_py().encode() for t in texts]), pa.float64())

    rows = boxed(docs, text=text_of(), held_out=held_out(F.col("doc_id")))
    value = F.arrow_udf(score, "double")("text") if weights else F.lit(float(1 / (1 + np.exp(-odds))))
    scored = rows.select("row", "held_out", value.alias("score"))
    return unboxed(scored, docs.columns, held_out=F.col("held_out"), score=F.col("score"), predicted=(F.col("score") >= 0.5).cast("int"))
