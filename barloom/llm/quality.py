"""Compression classifier: which of two zstandard dictionaries packs a text better.

One dictionary holds pieces of good labelled texts, the other pieces of bad ones. A text is cut into
blocks; each block is compressed alone with either dictionary and with none. The normalised size
differences are turned into a probability by logistic regression on labelled rows.

The dictionaries and the regression are fitted on a bounded hash sample of the labelled rows
(``dictionary_docs`` and ``fit_docs`` expected rows of each label, ``piece_bytes`` of a row for a
dictionary); scoring reads whole texts. Nothing but the text enters a score.

Defined cases: null and empty texts get the score of the fitted prior; without labels of both kinds
every score is 0.5; labels that contradict each other are both used; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .words import hash_share, text_bytes

BLOCK = 1024
PIECE = 200
LEVEL = 3


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor,
             plain: zstandard.ZstdCompressor) -> list[float]:
    """Sizes with either dictionary and with none, relative to the text and to each other."""
    n = len(text)
    if not n:
        return [0.0] * 4
    sizes = [0, 0, 0]
    for at in range(0, n, BLOCK):
        block = text[at:at + BLOCK]
        for k, packer in enumerate((good, bad, plain)):
            sizes[k] += len(packer.compress(block))
    g, b, p = (max(s - 14 * (1 + n // BLOCK), 1) for s in sizes)  # without the frames' own bytes
    return [(b - g) / max(b, g), (b - g) / n, g / n, p / n]


def packers(good: bytes, bad: bytes) -> tuple:
    def packer(content: bytes) -> zstandard.ZstdCompressor:
        params = {"level": LEVEL, "write_content_size": False}
        if len(content) < 8:
            return zstandard.ZstdCompressor(**params)
        d = zstandard.ZstdCompressionDict(content)  # recognises trained dictionaries, else raw content
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, **params)
    return packer(good), packer(bad), packer(b"")


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few texts, the texts themselves."""
    pieces = [t[at:at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size]


def _expanded(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped so that nothing is extrapolated, with squares and products."""
    x = np.clip((x - centre) / scale, -4, 4)
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple:
    """Centre, scale and weights of a ridge logistic regression, both labels weighing the same."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = _expanded(x, centre, scale)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(z.shape[1])
    penalty = (1 + ridge * len(y)) * np.eye(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + penalty,
                               z.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta


def logistic(x: np.ndarray, model: tuple) -> np.ndarray:
    centre, scale, beta = model
    return 1 / (1 + np.exp(-np.clip(_expanded(x, centre, scale) @ beta, -35, 35)))


def _measure(good: bytes, bad: bytes):
    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        tools = packers(good, bad)
        return pa.array([features(t.as_py(), *tools) for t in texts], type=pa.list_(pa.float64()))
    return measured


def train(docs: DataFrame, labels: DataFrame, *, use: Column | None = None, doc_id: str = "doc_id",
          text: str = "text", label: str = "quality", dictionary_docs: int = 300, dictionary_bytes: int = 16_000,
          piece_bytes: int = 1000, fit_docs: int = 4000) -> dict:
    """Dictionaries and regression. ``use`` (over the labels) names the rows that may be learned from.

    The regression is fitted on other rows than the dictionaries: at most half of a label's rows go
    into its dictionary.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(use) if use is not None else labels
    known = known.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    counts = {y: n for y, n in known.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return {}

    def picked(rows: int, salt: str, most: float) -> Column:
        hit = F.lit(False)
        for y, n in counts.items():
            key = F.concat(F.lit(salt), F.col("id").cast("string"))
            hit = hit | ((F.col("y") == y) & hash_share(key, min(most, rows / n)))
        return hit

    def with_text(ids: DataFrame) -> DataFrame:
        texts = docs.select(F.col(doc_id).alias("id"), text_bytes(text).alias("text"))
        return texts.join(F.broadcast(ids), "id")  # as many ids as the sample sizes say

    in_dictionary = picked(dictionary_docs, "dictionary ", 0.5)
    # A piece starts at a hashed place, so that pieces are not all beginnings.
    room = F.greatest(F.length("text") - piece_bytes, F.lit(0)) + 1
    piece = F.substring("text", F.pmod(F.xxhash64("id"), room).cast("int") + 1, F.lit(piece_bytes))
    pieces: dict[int, list] = {0: [], 1: []}
    for y, i, p in with_text(known.filter(in_dictionary)).select("y", F.xxhash64("id"), piece).collect():
        pieces[y].append((i, bytes(p)))
    good, bad = (dictionary([p for _, p in sorted(pieces[y])], dictionary_bytes) for y in (1, 0))
    rows = with_text(known.filter(~in_dictionary & picked(fit_docs, "fit ", 1.0))) \
        .select("y", _measure(good, bad)("text").alias("x")).collect()
    y = np.array([r[0] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return {}
    return {"good": good, "bad": bad, "fit": fit_logistic(np.array([r[1] for r in rows]), y)}


def score(docs: DataFrame, model: dict, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that a text carries the good label."""
    if not model:
        return docs.withColumn(into, F.lit(0.5))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = shared.value
        tools = packers(m["good"], m["bad"])
        x = np.array([features(t.as_py(), *tools) for t in texts]).reshape(-1, 4)
        return pa.array(logistic(x, m["fit"]), type=pa.float64())

    return docs.withColumn(into, scored(text_bytes(text)))
