"""Quality by the votes of the nearest labelled texts in a latent space.

Terms are hashed triples of characters and a few counts of repeated words. A bounded
sample of labelled texts gives the weights, the latent axes (a truncated singular
value decomposition) and the neighbours; the three arrays are of fixed size and go to
every executor. Each text is then compared with all labelled vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed terms, latent axes.
TERMS, AXES = 4096, 64
#: The last terms count repetition: a word like the one before, words and lines seen before.
_SHAPES = 3
#: Labelled texts of each class that are learnt from, those with the lowest hash of their id.
PER_CLASS = 2000
NEIGHBOURS = 15
#: Power of a similarity that weighs a vote, and the weight of the share of good labels at large.
_SHARPNESS, _PRIOR_WEIGHT = 8, 1e-6
_BLOCK_TEXTS, _BLOCK_CHARS = 256, 1 << 20


def term_counts(texts: Sequence[str | None]) -> np.ndarray:
    """Texts x ``TERMS`` counts, from the whole texts; zeros for a null or empty text."""
    n, hashed = len(texts), TERMS - _SHAPES
    out = np.zeros((n, TERMS), dtype=np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), _BLOCK_CHARS):  # two characters of overlap: no triple is lost or doubled
            points = np.frombuffer(
                text[at:at + _BLOCK_CHARS + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            if len(points) > 2:
                mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
                mixed ^= mixed >> np.uint64(15)
                out[row, :hashed] += np.bincount((mixed % np.uint64(hashed)).astype(np.int64), minlength=hashed)
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        out[row, hashed] = 9 * sum(map(eq, words, words[1:]))
        out[row, hashed + 1] = 9 * (len(words) - len(set(words)))
        out[row, hashed + 2] = 9 * (len(lines) - len(set(lines)))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the terms
    axes: np.ndarray  # TERMS x AXES
    vectors: np.ndarray  # labelled texts x AXES, of length one
    labels: np.ndarray
    prior: float

    def latent(self, texts: Sequence[str | None]) -> np.ndarray:
        return _unit(_unit(np.sqrt(term_counts(texts)) * self.weights) @ self.axes)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Share of the label 1 among the nearest labelled texts, weighed by cosine; the prior without any."""
        out = np.empty(len(texts))
        for at in range(0, len(texts), _BLOCK_TEXTS):
            close = self.latent(texts[at:at + _BLOCK_TEXTS]) @ self.vectors.T
            k = min(NEIGHBOURS, close.shape[1])
            near = np.argpartition(-close, k - 1, axis=1)[:, :k] if k else np.zeros((len(close), 0), dtype=int)
            votes = np.maximum(np.take_along_axis(close, near, axis=1), 0).astype(np.float64) ** _SHARPNESS
            good = (votes * self.labels[near]).sum(axis=1) + _PRIOR_WEIGHT * self.prior
            out[at:at + _BLOCK_TEXTS] = good / (votes.sum(axis=1) + _PRIOR_WEIGHT)
        return np.clip(out, 0, 1)


def _axes(rows: np.ndarray, k: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], k + 16)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :k].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled texts of each class.

    An id with several labels counts by their mean, from 0.5 as 1; null ids and labels
    teach nothing. Of repeated rows of a document all but one are left out. Without
    any label the scores are 0.5.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    prior = told.agg(F.avg("__label")).first()[0]
    chosen = None
    for label in (0, 1):
        few = told.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        chosen = few if chosen is None else chosen.unionByName(few)
    picked = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(
        F.broadcast(chosen), F.col("__doc") == F.col("__id"))  # at most 2 * per_class rows

    @F.pandas_udf("array<int>")
    def sparse(texts: pd.Series) -> pd.Series:
        def pairs(text: str | None) -> list[int]:
            counts = term_counts([text])[0].astype(np.int64)
            at = np.flatnonzero(counts)
            return np.stack([at, counts[at]], axis=1).ravel().tolist()
        return texts.map(pairs)

    rows = picked.select("__id", "__label", sparse("__text").alias("terms")).dropDuplicates(["__id"]).orderBy("__id").collect()
    if not rows:
        empty = np.zeros((0, AXES), dtype=np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, AXES), np.float32), empty, np.zeros(0), 0.5)
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for k, row in enumerate(rows):
        counts[k, row["terms"][::2]] = row["terms"][1::2]
    weights = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = _unit(np.sqrt(counts) * weights)
    axes = _axes(weighted, AXES)
    return Model(weights, axes, _unit(weighted @ axes), np.array([r["__label"] for r in rows], dtype=np.float64), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have no neighbours: their score is the share of good labels.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: terms, axes, 2 * per_class vectors

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(spread.value.scores(texts.tolist()), dtype="float64")

    return docs.withColumn("score", scored(F.col(text_col).cast("string"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
