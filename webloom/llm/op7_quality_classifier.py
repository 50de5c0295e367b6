"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes weighted counts of hashed marks: the shapes of its words and coarse measures of case, marks
and repetition. A truncated singular value decomposition of a bounded labelled sample gives the latent
axes; the labelled vectors are broadcast, and every document's cosine with all of them is computed
exactly, block by block. The nearest ones vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import add_columns, kept_by_worker, read_table

#: Labelled documents that become neighbours, the lowest by hash: a documented bound on what is broadcast.
SAMPLE = 4_000
DIMENSIONS = 1 << 11
AXES = 48
NEIGHBOURS = 25
#: Words whose shapes one Python worker keeps; a memory bound, it has no effect on results.
CACHE = 300_000


class Kinds(dict):
    """Code point -> a, A, 0 or itself; filled as letters are met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        return kind


KINDS = Kinds()
RUN = re.compile(r"(.)\1\1+", re.S)


def shape(word: str) -> str:
    """Case, digits and marks of a word, runs shortened: ``Ab.``, ``AA!!``, ``a***``."""
    return RUN.sub(r"\1\1", word.translate(KINDS))


class Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        # the lowest bit tells whether the word ends a clause
        self[word] = place = zlib.crc32(shape(word.decode()).encode()) & ~1 | (word[-1] in b".,!?")
        return place


def level(value: float, steps: int) -> int:
    return int(value * steps + 0.5)


class Features:
    """Text -> sparse counts over ``DIMENSIONS`` hashed marks."""

    def __init__(self):
        self.shapes = Shapes()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().split()
        tops = Counter(words)
        shapes = np.fromiter(map(self.shapes.__getitem__, tops), np.uint32, len(tops))
        times = np.fromiter(tops.values(), np.int64, len(tops))
        counts = np.log1p(np.bincount(shapes % np.uint32(DIMENSIONS), times, DIMENSIONS)) * (10.0 / np.log(10 + len(words)))
        lines = [x for x in text.split("\n") if x.strip()]
        n, chars = max(1, len(words)), max(1, len(text))
        same = np.fromiter(map(hash, words), np.int64, len(words))
        twice = np.count_nonzero(same[1:] == same[:-1])
        raw = np.frombuffer(text.encode(), np.uint8)
        low = raw | 32
        letters = int(np.count_nonzero((low >= 97) & (low <= 122)) + np.count_nonzero(raw >= 0xC0))
        capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
        measures = {
            "distinct": level(len(tops) / n, 10), "twice": level(twice / n, 10), "lines": level(len(set(lines)) / max(1, len(lines)), 8),
            "letters": level(letters / chars, 12), "capitals": level(capitals / max(1, letters), 8), "size": int(np.log2(n)),
            "length": level(min(12.0, chars / n), 1), "top": level(max(tops.values(), default=0) / n, 8), "ends": level(float(times[(shapes & 1) == 1].sum()) / n, 10),
        }
        for name, value in measures.items():
            for near, weight in ((value - 1, 2.0), (value, 4.0), (value + 1, 2.0)):
                counts[zlib.crc32(f"{name} {near}".encode()) % DIMENSIONS] += weight
        at = np.flatnonzero(counts)
        return at.astype(np.int32), counts[at].astype(np.float32)


def sparse(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType()))]

    def work(texts: list[str]) -> list[pa.Array]:
        features = kept_by_worker(("op7",), Features)
        found = [features.of(t) for t in texts]
        return [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]

    return add_columns(df, text, fields, work, keep)


@dataclass
class Model:
    """What is broadcast: idf and axes (DIMENSIONS x AXES), unit vectors of at most SAMPLE labelled texts, their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        dense = np.zeros((len(found), DIMENSIONS), np.float32)
        for i, (at, weight) in enumerate(found):
            dense[i, at] = weight
        dense *= self.idf
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
        return unit(dense @ self.axes)

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        """Share of label 1 in the votes of the ``k`` nearest, ties at the k-th place included; weights are similarities."""
        out = np.empty(len(found))
        k = min(k, len(self.labels))
        for start in range(0, len(found), block):
            cosine = self.latent(found[start : start + block]) @ self.vectors.T
            least = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            weight = np.square(np.square(np.maximum(cosine, 1e-3)))
            votes = np.where(cosine >= least[:, None], weight, 0.0)
            out[start : start + block] = votes @ self.labels / votes.sum(1)
        return np.clip(out, 0.0, 1.0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", label: str = "quality") -> Model | None:
    """Model from at most ``sample`` labelled documents; None where there are none.

    The driver gets sparse counts, never texts: at most ``sample`` rows of DIMENSIONS numbers. Rows without a
    label or doc_id don't count; a document labelled twice counts once, by its highest label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")
    found = sparse(rows, text, ["doc_id", "label"]).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    if not len(found):
        return None
    dense = np.zeros((len(found), DIMENSIONS), np.float32)
    for i, (at, weight) in enumerate(zip(found["at"], found["weight"], strict=True)):
        dense[i, at] = weight
    idf = (np.log((1 + len(dense)) / (1 + (dense > 0).sum(0))) + 1).astype(np.float32)
    dense = unit(dense * idf)
    # eigenvectors of the small Gram matrix are the right singular vectors
    _, vectors = np.linalg.eigh((dense.T @ dense).astype(np.float64))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :AXES]).astype(np.float32)
    return Model(idf, axes, unit(dense @ axes), (found["label"].to_numpy() > 0).astype(np.float32))


def classify(df: DataFrame, model: Model | None, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: 0 to 1, higher where label 1 is likelier, for the whole text.

    A null text is an empty one and is scored like it, by its few marks. Without a model every score is 0.5. Repeated rows score alike; a
    column called ``out`` is replaced; no rows give no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> list[pa.Array]:
        if shared.value is None:
            return [pa.array([0.5] * len(texts), pa.float64())]
        features = kept_by_worker(("op7",), Features)
        scores = []
        for start in range(0, len(texts), 256):
            scores.append(shared.value.scores([features.of(t) for t in texts[start : start + 256]]))
        return [pa.array(np.concatenate(scores) if scores else [], pa.float64())]

    return add_columns(df, text, [T.StructField(out, T.DoubleType())], work, keep)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out documents are never read by the model."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = classify(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
