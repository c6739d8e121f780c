"""Token totals by source, language and tokenizer version, kept up to date by signed changes in idempotent batches.

Totals are additive, so a batch needs its own changes and the small table of totals, never the documents counted before. A commit writes a
new version of the totals under a new name and then renames one marker into place; a batch whose marker exists is
skipped, so repeating a batch, or a job that was lost half-way, changes nothing. Counting is apart from the rollup: by a public tokenizer
(``count_tokens``) or by a pattern that SQL knows too (``token_count``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import encoder
from .common import split_batches, with_fields

GROUP = ["source", "lang", "tokenizer"]
#: Tokenizer versions that SQL can count: words; and words with each ASCII punctuation mark apart.
COUNTERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}


def token_count(text: str, tokenizer: str) -> F.Column:
    """Tokens of a text column; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(COUNTERS[tokenizer])), F.lit(0)).cast("long")


def count_tokens(df: DataFrame, paths: dict[str, str], carry: list[str], text: str = "text") -> DataFrame:
    """(``carry``, a column for each of ``paths``): how many ids each tokenizer file gives a whole text, special tokens not added.

    All files count beside the text, so that no text is moved. A null or empty text has 0. Rows may repeat and hold nulls; other columns are
    dropped; a column of ``paths`` must not be carried. An empty table gives an empty one.
    """
    if set(paths) & set(carry):
        raise ValueError(f"{sorted(set(paths) & set(carry))} are carried already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [encoder(p) for p in paths.values()]
        for batch in (s for b in batches for s in split_batches([b], text)):
            texts = batch.column(text).to_pylist()
            counts = [pa.array([len(x) // 4 for x in t.encode_many(texts)], pa.int64()) for t in tools]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *counts], names=[*carry, *paths])

    return df.select(*dict.fromkeys([*carry, text])).mapInArrow(run, with_fields([df.schema[c] for c in carry], ", ".join(f"`{n}` long" for n in paths)))


def changes(new: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """Signed totals of a batch. ``new``: (source, lang, tokenizer, n_tokens) of documents that come or are counted anew; ``old``: the
    same of what they replace, or of deleted documents. A null count is 0; null groups are groups; repeated rows each count."""
    sides = [d.select(*GROUP, F.lit(s).cast("long").alias("n_docs"), (s * F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))).alias("n_tokens")) for d, s in ((new, 1), (old, -1)) if d is not None]
    if not sides:
        raise ValueError("a batch needs new or old rows")
    return _summed(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]))


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def commits(self) -> list[dict]:
        """Committed batches in order: version, batch, totals (the name of their folder)."""
        found = sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(f"{self.folder}/commits")) if not s.getPath().getName().startswith("."))
        out = []
        for path in found:
            stream = self._fs.open(self._path(path))
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return out

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of groups that are not all zero; empty before the first commit."""
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        done = self.commits()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{done[-1]['totals']}") if done else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch's signed totals, once. False: the batch was committed before. Of two writers of one version, the second raises."""
        done = self.commits()
        if any(c["batch"] == batch for c in done):
            return False
        version, name = len(done) + 1, f"totals-{len(done) + 1:08d}-{uuid.uuid4().hex[:8]}"
        total = _summed(self.totals().unionByName(delta.select(*GROUP, "n_docs", "n_tokens"))).filter("n_docs <> 0 or n_tokens <> 0")
        total.write.parquet(f"{self.folder}/{name}")
        draft = f"{self.folder}/commits/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), True)
        stream.write(bytearray(json.dumps({"version": version, "batch": batch, "totals": name}).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(draft).toUri(), self.spark._jsc.hadoopConfiguration()) if "://" in draft else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(draft), self._path(f"{self.folder}/commits/{version:08d}"), self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        if len(done) > 1:  # readers of the version before this one may still be at work, none of older ones
            self._fs.delete(self._path(f"{self.folder}/{done[-2]['totals']}"), True)
        return True
