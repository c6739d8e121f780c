"""Reading, writing and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, fallback: str | None = None) -> DataFrame:
    """A CSV, JSON, ORC or Parquet table with chosen columns; the fallback is read, with a warning, where the path does not exist."""
    if fallback is not None and not path_exists(spark, path):
        import warnings

        warnings.warn(f"{path} is missing; reading {fallback}", stacklevel=2)
        path = fallback
    kind = next((k for k in ("csv", "json", "orc") if f".{k}" in path.rsplit("/", 1)[-1]), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def needed_subset(full: DataFrame, keys: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Rows whose key is among ``keys`` or that pass the predicate; repeated rows stay."""
    mark = keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_needed", F.lit(True))
    return full.join(mark, key, "left").filter(F.col("_needed").isNotNull() | F.coalesce(predicate, F.lit(False))).select(*full.columns)


def collect_runs(spark: SparkSession, folder: str, schema: str, arrays: list[str], keep: Column | None = None) -> DataFrame:
    """One JSON record a run, its parallel arrays as rows."""
    runs = spark.read.schema(schema).json(folder)
    runs = runs if keep is None else runs.filter(keep)
    rest = [c for c in runs.columns if c not in arrays]
    return runs.select(*rest, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))


def write_results(df: DataFrame, path: str, fmt: str = "csv", order: list[str] | None = None, compression: str = "gzip") -> None:
    """A tidy sink; with ``order`` the rows are range-partitioned and sorted by it, so equal tables give equal row orders."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("compression", compression).format(fmt).save(path)


def pending(candidates: DataFrame, ledger: DataFrame, key: str, excluded: DataFrame | None = None) -> DataFrame:
    """Candidates not in the ledger and not excluded."""
    out = candidates.join(ledger.select(key).distinct(), key, "left_anti")
    return out if excluded is None else out.join(excluded.select(key).distinct(), key, "left_anti")


def merge_outcome_logs(logs: list[DataFrame], key: str, status: str, order: str) -> DataFrame:
    """Logs end to end; the first row of each key wins, by the log's place, then ``order``; then error rows go."""
    from pyspark.sql import Window

    ranked = [log.withColumn("_log", F.lit(k)) for k, log in enumerate(logs)]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_log", order))
    return every.withColumn("_n", first).filter("_n = 1").filter(~F.col(status).startswith("error")).drop("_n", "_log")


def extract_values(pages: DataFrame, text: str, anchor: str, cell: str, out: str = "values") -> DataFrame:
    """Numbers in cells (pattern with one group) after the anchor's first place; none where the anchor is absent."""
    at = F.instr(F.col(text), anchor)
    rest = F.when(at > 0, F.substring(F.col(text), at + len(anchor), F.length(text))).otherwise("")
    cells = F.regexp_extract_all(rest, F.lit(cell), F.lit(1))
    numbers = F.filter(F.transform(cells, lambda c: F.trim(c).try_cast("double")), lambda v: v.isNotNull())
    return pages.withColumn(out, numbers)


def fetch_checked(wanted: DataFrame, store: DataFrame, key: str, source: str) -> DataFrame:
    """Vectors of the wanted keys; ``problem`` says 'missing' or 'changed source', and is null where all is well."""
    held = store.withColumnRenamed(source, "_stored")
    problem = F.when(F.col("_stored").isNull(), "missing").when(F.col("_stored") != F.col(source), "changed source")
    return wanted.join(held, key, "left").withColumn("problem", problem).drop("_stored")


def fetch_strict(wanted: DataFrame, store: DataFrame, key: str, source: str, position: str, config: dict, expected: dict, checked: list[str]) -> DataFrame:
    """The wanted rows with the store's columns, in the requested order (``position``); a row that is missing from the store, or whose source is not the one that was
    stored, raises when the result is read, and names the key. A field of ``checked`` in which the store's ``config`` differs from ``expected`` raises at once.

    Null sources differ from others and equal each other; a key that the store has twice raises too, as its vector is not known.
    """
    stale = [k for k in checked if config.get(k) != expected.get(k)]
    if stale:
        raise ValueError(f"the store's configuration differs on {stale}; build it anew")
    held = store.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(*[c for c in store.columns if c != key])).alias("_held"))
    met = wanted.join(held, F.col(key) == F.col("_key"), "left")
    changed = ~F.col(f"_held.{source}").eqNullSafe(F.col(source))
    problem = F.when(F.col("_times").isNull(), "missing from the store").when(F.col("_times") > 1, "twice in the store").when(changed, "stored from another source")
    fail = F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": "), problem)).cast("boolean")
    sound = met.filter(F.when(problem.isNotNull(), fail).otherwise(F.lit(True)))
    return sound.select(*wanted.columns, *[F.col(f"_held.{c}").alias(c) for c in store.columns if c not in (key, source)]).orderBy(position)


def require_none(df: DataFrame, message: str) -> None:
    """Raise if a table of violations has a row."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")
