"""Quality scores by compression: zstandard dictionaries of good and of bad text, and the size difference they make.

Every text is cut into blocks, and each block is compressed three ways: with the dictionary of good texts, with that of bad texts and
with none, so that the dictionaries matter from a long text's first byte to its last. The sizes, normalised, go through a logistic
curve fitted on labelled texts that the dictionaries were not made of.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold_of, split_batches, with_fields

#: The model is fitted on at most this many labelled texts of each class, none longer than this many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 800, 16_000
DICTIONARY_BYTES, BLOCK_CHARS, LEVEL = 48_000, 1024, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    centre: list[float]
    spread: list[float]

    def __getstate__(self):
        return (self.good, self.bad, self.weights, self.centre, self.spread)

    def __setstate__(self, state):
        self.good, self.bad, self.weights, self.centre, self.spread = state
        self._tools = None

    _tools = None

    def tools(self):
        if self._tools is None:
            kinds = [zstandard.ZstdCompressionDict(x) if x else None for x in (self.good, self.bad)]
            for k in kinds:
                if k is not None:
                    k.precompute_compress(level=LEVEL)
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._tools = [zstandard.ZstdCompressor(dict_data=k, **options) if k is not None else zstandard.ZstdCompressor(**options) for k in (*kinds, None)]
        return self._tools

    def sizes(self, text: str | None) -> tuple[int, int, int, int]:
        """Bytes of a text with the good dictionary, with the bad one, with none, and raw. A null text counts as empty."""
        text = text or ""
        tools, totals, raw = self.tools(), [0, 0, 0], 0
        for a in range(0, len(text), BLOCK_CHARS):
            block = text[a : a + BLOCK_CHARS].encode("utf-8")
            raw += len(block)
            for k, tool in enumerate(tools):
                totals[k] += len(tool.compress(block))
        return *totals, raw

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (features([self.sizes(t) for t in texts]) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(curve(x) @ self.weights, -30, 30)))


def features(sizes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Normalised size difference, share of its size that a text keeps when compressed, what the better dictionary saves, and log length."""
    good, bad, plain, raw = np.array(sizes, dtype=float).reshape(-1, 4).T
    return np.stack([(bad - good) / np.maximum(1, bad + good), plain / np.maximum(1, raw), 1 - np.minimum(good, bad) / np.maximum(1, plain), np.log1p(raw)], axis=1)


def curve(x: np.ndarray) -> np.ndarray:
    """Constant, linear and product terms."""
    products = [x[:, a] * x[:, b] for a in range(x.shape[1]) for b in range(a, x.shape[1])]
    return np.stack([np.ones(len(x)), *x.T, *products], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for weighted logistic regression with a ridge on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(good: list[str], bad: list[str], prior: float) -> Model:
    """A model of labelled texts: every other one of each class for the dictionaries, the rest for the curve. ``prior``: share of good texts.

    With no text of a class the score is the prior for every text.
    """
    if len(good) < 4 or len(bad) < 4:
        p = min(max(prior, 0.01), 0.99)
        return Model(b"", b"", [float(np.log(p / (1 - p)))] + [0.0] * 14, [0.0] * 4, [1.0] * 4)

    def dictionary(texts: list[str]) -> bytes:
        samples = [t.encode("utf-8") for t in texts]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the texts themselves
            return b"".join(samples)[-DICTIONARY_BYTES:]

    model = Model(dictionary(good[::2]), dictionary(bad[::2]), [], [], [])
    x = features([model.sizes(t) for t in [*good[1::2], *bad[1::2]]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))  # the sample has as many of each; texts do not
    model.centre, model.spread = x.mean(0).tolist(), np.maximum(x.std(0), 1e-9).tolist()
    model.weights = fit_logistic(curve((x - model.centre) / model.spread), y, weight).tolist()
    return model


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold (crc32 of the id modulo 3 is 1).

    Null labels and ids, and ids labelled both ways, are left out. The sample takes the ids of lowest hash, ``rows`` of each class, so it does not depend on
    partitioning; its texts of up to ``chars`` characters (at most 2 * rows * chars characters) come to the driver.
    """
    spark = documents.sparkSession
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold_of(key, 3) != 1)).groupBy(key).agg(F.min(label).alias("_low"), F.max(label).alias("_high")).filter("_low = _high")
    totals = {r[0]: r[1] for r in one.groupBy("_low").count().collect()}
    if not totals:
        return fit_texts([], [], 0.5)
    chosen = [(r[0], v) for v in (0, 1) for r in one.filter(F.col("_low") == v).orderBy(F.xxhash64(key), key).select(key).limit(rows).collect()]
    ids = spark.createDataFrame(chosen, f"`{key}` {labels.schema[key].dataType.simpleString()}, _label int")
    kept = documents.select(key, text).filter(F.length(text).between(1, chars)).join(F.broadcast(ids), key)
    texts = sorted({(r[0], r[1], r[2]) for r in kept.select(F.xxhash64(key), "_label", text).collect()})
    total = sum(totals.values())
    return fit_texts([t for _, v, t in texts if v == 1], [t for _, v, t in texts if v == 0], totals.get(1, 0) / total)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(key, score, predicted) and the columns to ``carry``, which must have other names.

    A null text counts as empty; texts are read whole, block by block. Keys may be null or repeat; equal texts have equal scores. An empty
    table gives an empty one.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in split_batches([b], text)):
            p = held.value.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(batch.column(c) for c in carry)], names=[key, "score", "predicted", *carry])

    schema = with_fields([df.schema[key], *StructType.fromDDL("score double, predicted int"), *(df.schema[c] for c in carry)])
    return df.select(*dict.fromkeys([key, text, *carry])).mapInArrow(run, schema)
