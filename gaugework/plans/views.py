"""Derived tables that the queries read, in SQL that Spark and DuckDB both run.

A view may name the driver's tables and other views. ``table`` builds one as a DataFrame; ``with_views`` puts the ones that a DuckDB text
names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    # rows to predict: value of an event, grouped by user, stratified by type; the fold depends on the user only
    "ev": """SELECT event_id AS key, user_id AS grp, event_type AS stratum, value AS y_true, CAST(EXTRACT(hour FROM ts) AS DOUBLE) AS x,
        CAST(ascii(substr(md5(concat('f:', CAST(user_id AS STRING))), 2, 1)) % 5 AS INT) AS fold FROM events""",
    # out-of-fold predictions of three methods: mean of the other folds, mean by stratum, and a crude rule on the hour
    "pred": """SELECT 'familiar' AS regime, e.fold, e.key, e.grp, e.stratum, e.y_true, e.x, m.method,
          CASE m.method WHEN 'mean' THEN (t.s - f.s) / (t.n - f.n) WHEN 'by_type' THEN (ts.s - fs.s) / (ts.n - fs.n) ELSE e.x * 4.0 + 1.0 END AS y_pred
        FROM ev e
        JOIN (SELECT fold, sum(y_true) AS s, count(*) AS n FROM ev GROUP BY fold) f ON e.fold = f.fold
        JOIN (SELECT fold, stratum, sum(y_true) AS s, count(*) AS n FROM ev GROUP BY fold, stratum) fs ON e.fold = fs.fold AND e.stratum = fs.stratum
        JOIN (SELECT stratum, sum(y_true) AS s, count(*) AS n FROM ev GROUP BY stratum) ts ON e.stratum = ts.stratum
        CROSS JOIN (SELECT sum(y_true) AS s, count(*) AS n FROM ev) t
        CROSS JOIN (SELECT 'mean' AS method UNION ALL SELECT 'by_type' UNION ALL SELECT 'by_hour') m""",
    "foldmae": "SELECT method, fold, avg(abs(y_true - y_pred)) AS mae, CAST(count(*) AS DOUBLE) AS n_test FROM pred GROUP BY method, fold",
    "wide": """SELECT key, fold, grp, stratum, x, max(y_true) AS y_true, max(CASE WHEN method = 'mean' THEN y_pred END) AS p_mean,
          max(CASE WHEN method = 'by_type' THEN y_pred END) AS p_type, max(CASE WHEN method = 'by_hour' THEN y_pred END) AS p_hour
        FROM pred GROUP BY key, fold, grp, stratum, x""",
    # a campaign of lookups: orders in random order, a hit when the price is in a window
    "campaign": """SELECT o_orderpriority AS strategy, CAST(ascii(substr(md5(CAST(o_orderkey AS STRING)), 3, 1)) % 3 AS INT) AS seed, o_orderkey AS key,
          o_totalprice AS price, o_totalprice BETWEEN 100000 AND 150000 AS hit, abs(o_totalprice - 125000) AS distance, md5(concat('c:', CAST(o_orderkey AS STRING))) AS ord FROM orders""",
    "steps": """SELECT strategy, seed, key, price, hit, ord, CAST(row_number() OVER (PARTITION BY strategy, seed ORDER BY ord, key) AS INT) AS step,
          sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, seed ORDER BY ord, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM campaign""",
    "curves": "SELECT strategy, seed, CAST(step AS INT) AS size, 1.0 - CAST(hits AS DOUBLE) / 400 AS value FROM steps WHERE step IN (25, 50, 75, 100, 150, 200, 300, 400)",
    "items": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS q, l_extendedprice AS price, l_discount AS d, l_tax AS t, l_returnflag AS flag, l_linestatus AS status FROM lineitem",
    "outcomes": "SELECT user_id, event_id, event_type, value FROM events",
    "doc_words": "SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents",
    "parts": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
}


def needs(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", sql))
    return [n for n in [*VIEWS, *RAW] if n in words and re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table or a view."""
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, VIEWS[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over tables and views."""
    used = {n: table(spark, sf_dir, n) for n in needs(sql)}
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN|,)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """A DuckDB text with the views that it names, in order of need."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needs(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
