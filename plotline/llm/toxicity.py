"""Operator 2: toxicity by a classifier chain, trained on out-of-fold predictions.

Categories are judged one after the other; each is a logistic model over hashed words, word
beginnings and the probabilities that the earlier models gave. For training, those earlier
probabilities are out-of-fold: the labelled rows are dealt into folds, and a row's value comes
from a model that has not seen its fold. The final models use all rows.

Fitting is done on a bounded sample of the labelled documents (of each toxic label the
``SAMPLE`` ones with the smallest hash of their id); scoring runs over every whole text in Spark.
The labels given hold one toxicity category, so quality comes first in the chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm import buffers, exchange

U = np.uint64
SAMPLE = 4000
LEAST_DOCS = 4
LEAST_Z = 4.5
FOLDS = 4
BITS = 18
STARTS = (4, 5)
CATEGORIES = ("poor", "toxic")
THRESHOLD = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of every text as (slot, row): its words and their first characters.

    A-Z is lowered; words are runs of letters, digits and non-ASCII bytes.
    """
    low = buffers.lower_table()[data]
    keep = buffers.byte_table(lambda b: b > 127 or 48 <= b <= 57 or 97 <= b <= 122)
    starts, ends, row = buffers.spans(low, offsets, keep)
    prefix = buffers.prefix_hash(low)
    slots, rows = [buffers.span_hash(prefix, starts, ends)], [row]
    for n in STARTS:
        long = ends - starts > n
        slots.append(buffers.mix(buffers.span_hash(prefix, starts[long], starts[long] + n) + U(n)))
        rows.append(row[long])
    key = (np.concatenate(rows).astype(U) << U(BITS)) | (np.concatenate(slots) >> U(64 - BITS))
    key = np.unique(key)
    return (key & U((1 << BITS) - 1)).astype(np.int64), (key >> U(BITS)).astype(np.int64)


def telling(slots: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Features whose share among the category's texts differs from the others' by ``LEAST_Z`` standard errors."""
    n, yes = len(labels), labels.sum()
    count = np.bincount(slots, minlength=1 << BITS)
    inside = np.bincount(slots, labels[rows], 1 << BITS)
    share = count / max(1, n)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(1, yes) + 1 / max(1, n - yes)))
    z = (inside / max(1, yes) - (count - inside) / max(1, n - yes)) / error
    return (count >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)


class Model:
    """Logistic regression over sparse binary features and a few dense ones."""

    def __init__(self, slots, rows, dense, labels, rounds: int = 80, decay: float = 1e-3) -> None:
        n = len(labels)
        self.sparse, self.dense, self.bias = np.zeros(1 << BITS), np.zeros(dense.shape[1]), 0.0
        seen = telling(slots, rows, labels)
        slots, rows = slots[seen[slots]], rows[seen[slots]]
        weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
        square, square_dense, square_bias = np.full(1 << BITS, 1e-12), np.full(dense.shape[1], 1e-12), 1e-12
        for _ in range(rounds):
            z = self.score(slots, rows, dense, n)
            g = (1 / (1 + np.exp(-z)) - labels) * weight
            gs = np.bincount(slots, g[rows], 1 << BITS) + decay / n * self.sparse
            gd, gb = dense.T @ g, g.sum()
            square += gs ** 2
            square_dense += gd ** 2
            square_bias += gb ** 2
            self.sparse -= 0.3 * gs / np.sqrt(square)
            self.dense -= 0.1 * gd / np.sqrt(square_dense)
            self.bias -= 0.3 * gb / np.sqrt(square_bias)

    def score(self, slots, rows, dense, n: int) -> np.ndarray:
        z = np.bincount(rows, self.sparse[slots], n) + self.bias
        return np.clip(z + dense @ self.dense, -30, 30) if dense.shape[1] else np.clip(z, -30, 30)

    def probability(self, slots, rows, dense, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(slots, rows, dense, n)))


class Chain:
    """One model per category in order; later ones also read the earlier ones' probabilities."""

    def __init__(self, slots: np.ndarray, rows: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> None:
        n, names = labels.shape
        self.models = []
        earlier = np.zeros((n, 0))
        fold = np.arange(n) % folds
        for c in range(names):
            self.models.append(Model(slots, rows, earlier, labels[:, c]))
            if c + 1 < names:
                out = np.zeros(n)
                for f in range(folds):
                    inside, held = fold[rows] != f, fold == f
                    place = np.cumsum(~held) - 1
                    model = Model(slots[inside], place[rows[inside]], earlier[~held], labels[~held, c])
                    place = np.cumsum(held) - 1
                    out[held] = model.probability(slots[~inside], place[rows[~inside]], earlier[held], int(held.sum()))
                earlier = np.column_stack([earlier, out])

    def probabilities(self, slots: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        earlier = np.zeros((n, 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.probability(slots, rows, earlier, n)])
        return earlier


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """The chain for the categories poor (quality 0) and toxic; None without documents of both toxic labels.

    Labels without a document take no part. Of an id labelled both ways the worse label
    counts, of one with several texts the smallest.
    """
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                            F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    here = exchange.documents(docs)
    marked = marked.join(here.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = (marked.where("toxic = 0").orderBy(*order).limit(sample)
              .unionByName(marked.where("toxic = 1").orderBy(*order).limit(sample)))

    def run(batches):
        for batch in buffers.blocks(batches):
            slots, rows = features(*buffers.flat(batch.column("text")))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            held = [slots[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("toxic"),
                                              pa.array(held, pa.binary())], names=["doc_id", "quality", "toxic", "slots"])
    found = (here.join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
             .groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
             .mapInArrow(run, "doc_id long, quality int, toxic int, slots binary").toArrow().sort_by("doc_id"))
    target = np.column_stack([1 - found.column("quality").to_numpy(), found.column("toxic").to_numpy()]).astype(float)
    if found.num_rows == 0 or target[:, 1].min() == target[:, 1].max():
        return None
    slots = [np.frombuffer(x, np.int32) for x in found.column("slots").to_pylist()]
    rows = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    return Chain(np.concatenate(slots).astype(np.int64), rows, target)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, poor and toxic (probabilities) and rejected (toxic >= threshold) of every document.

    A text is rejected only if it holds a feature that speaks for toxicity: never a null or
    empty text, which gets the models' base rates, and nothing when the labels do not hold
    both values. Rows without an id are left out.
    """
    return judged(exchange.documents(docs), labels, sample, threshold).select("doc_id", "poor", "toxic", "rejected")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns and poor, toxic and rejected after them."""
    chain = fitted(docs, labels, sample)  # travels with the function: two arrays of 2**18 weights

    def run(batches):
        for batch in buffers.blocks(batches):
            n = batch.num_rows
            slots, rows = features(*buffers.flat(batch.column("text")))
            p = chain.probabilities(slots, rows, n) if chain else np.zeros((n, 2))
            some = np.bincount(rows, chain.models[-1].sparse[slots] > 0, n) > 0 if chain else np.zeros(n, bool)
            arrays = [*batch.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p[:, 1] >= threshold) & some)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "poor", "toxic", "rejected"])
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
    added = [StructField("poor", DoubleType()), StructField("toxic", DoubleType()), StructField("rejected", BooleanType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(names)])
    return judged(plain, labels, sample, threshold).where("not rejected").select(*plain.columns).toDF(*names)
