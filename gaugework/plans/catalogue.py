"""All registered queries of the general operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import projections as P
from ..operators import windows as W
from ..session import shared_folder
from ..sources import tables as S
from ..streaming.ledger import outcome_ledger
from .views import run, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a1_fold_metrics"
PLACES = 6


class Tables:
    """The driver's tables and the views, by name, for one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return run(self.spark, self.sf_dir, text)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as engines add up in different orders."""
    return df.select(*[F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(Tables(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = with_views(sql)


def placed(id_: str) -> Column:
    """A row's place in a sorted table, from its ``monotonically_increasing_id``: ids ascend with the partitions of a sort."""
    return F.row_number().over(Window.orderBy(id_)).alias("place")


def uniform_sql(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


# ---- sources ---------------------------------------------------------------------------------------------------------

add("s1_read_table", lambda t: S.read_table(t.spark, f"{t.sf_dir}/nowhere.parquet", columns=["p_partkey", "p_name", "p_retailprice"], fallback=f"{t.sf_dir}/part.parquet"),
    "SELECT p_partkey, p_name, round(p_retailprice, 6) AS p_retailprice FROM part")
add("s2_needed_subset", lambda t: S.needed_subset(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), t.customer.filter("c_acctbal < 0"), "c_custkey", F.col("o_totalprice") > 400000),
    "SELECT o_custkey AS c_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_totalprice > 400000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")


def run_records(t: Tables) -> DataFrame:
    """Events as JSON records of at most 100 readings a run, read back as rows."""
    readings = F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("x")
    runs = t.events.groupBy(F.floor(F.col("event_id") / 100).alias("run")).agg(readings).select("run", F.col("x.event_id").alias("id"), F.col("x.value").alias("reading"))
    folder = shared_folder(t.spark, "runs")
    runs.write.json(folder)
    return S.collect_runs(t.spark, folder, "run long, id array<long>, reading array<double>", ["id", "reading"], F.col("run") > 0)


def results_read_back(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "results.csv")
    S.write_results(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, order=["o_orderkey"])
    return S.read_table(t.spark, path, "o_orderkey long, o_custkey long, o_totalprice double")


def streamed_ledger(t: Tables) -> DataFrame:
    """Events as a stream, the first of each user kept."""
    columns = ["user_id", "event_id", "event_type", "value"]
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*").select(*columns)
    path = shared_folder(t.spark, "ledger")
    outcome_ledger(stream, path, path + "-checkpoint", "user_id", "event_id").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


add("s3_collect_runs", run_records, "SELECT CAST(event_id // 100 AS BIGINT) AS run, event_id AS id, round(value, 6) AS reading FROM events WHERE event_id // 100 > 0")
add("s4_write_results", results_read_back, "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
add("s6_outcome_ledger", streamed_ledger, "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
add("s5_pending", lambda t: S.pending(t.customer.select("c_custkey", "c_name"), t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", t.customer.filter("c_acctbal < 0")),
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND NOT c_acctbal < 0")
add("s7_merge_outcome_logs", lambda t: S.merge_outcome_logs([t.outcomes.filter("value < 30"), t.outcomes.filter("value >= 30").drop("value")], "user_id", "event_type", "event_id"),
    """WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN value < 30 THEN value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 30 THEN 0 ELSE 1 END, event_id) AS n FROM outcomes)
    SELECT user_id, event_id, event_type, round(value, 6) AS value FROM r WHERE n = 1 AND NOT starts_with(event_type, 'error')""")
add("s8_extract_values", lambda t: S.extract_values(t.pages, "html", "<body", r">\s*([0-9]+)\s*<").select("page_id", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total")),
    r"""WITH v AS (SELECT page_id, CASE WHEN strpos(html, '<body') > 0 THEN list_transform(regexp_extract_all(substr(html, strpos(html, '<body') + 5), '>\s*([0-9]+)\s*<', 1), lambda c: CAST(c AS DOUBLE)) ELSE [] END AS v FROM pages)
    SELECT page_id, len(v) AS n, round(coalesce(list_sum(v), 0), 6) AS total FROM v""")
add("s9_fetch_checked", lambda t: S.fetch_checked(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.lit("BUILDING").alias("c_mktsegment")), t.customer.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", "c_mktsegment").select("o_orderkey", "c_acctbal", "problem"),
    """SELECT o_orderkey, round(c_acctbal, 6) AS c_acctbal, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_mktsegment <> 'BUILDING' THEN 'changed source' END AS problem
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
add("s9_fetch_strict", lambda t: S.fetch_strict(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey"), t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", "c_mktsegment", "o_orderkey", {"layer": 3}, {"layer": 3}, ["layer"]).select("o_orderkey", "c_mktsegment", "c_acctbal"),
    "SELECT o_orderkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")

# ---- projections -----------------------------------------------------------------------------------------------------

add("p1_symbol_counts", lambda t: P.symbol_counts(t.doc_words, "text", {"n_e": "e", "n_open": "(", "n_th": "th"}).select("doc_id", "n_e", "n_open", "n_th"),
    "SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS INT) AS n_e, CAST(length(text) - length(replace(text, '(', '')) AS INT) AS n_open, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INT) AS n_th FROM doc_words")
add("p2_select_features", lambda t: P.select_features(t.part, ["p_partkey", "p_brand", "p_size", "p_type"], ["p_type"]), "SELECT p_partkey, p_brand, p_size FROM part")
add("p3_hard_region", lambda t: P.hard_region(t.items, {"q": 45, "d": 0.09}).select("l_orderkey", "l_linenumber", "hard"),
    "SELECT l_orderkey, l_linenumber, coalesce(q >= 45, false) OR coalesce(d >= 0.09, false) AS hard FROM items")
add("p4_log1p_guarded", lambda t: P.log1p_guarded(t.parts.select("p_partkey", "p_size", "p_retailprice"), ["p_retailprice"]), "SELECT p_partkey, p_size, round(ln(1 + p_retailprice), 6) AS log_p_retailprice FROM parts")
add("p5_name_filter", lambda t: P.name_filter(t.parts.select("p_name", "p_partkey"), "p_name", t.parts.filter("p_size = 1"), 40, " ", 3),
    "SELECT p_name, p_partkey FROM parts WHERE length(p_name) <= 40 AND length(p_name) - length(replace(p_name, ' ', '')) <= 3 AND NOT starts_with(p_name, 'CID ') AND NOT regexp_matches(p_name, '[,()\\[\\]]') AND p_name NOT IN (SELECT p_name FROM parts WHERE p_size = 1)")
add("p6_targeted_candidates", lambda t: P.hard_region(P.name_filter(t.parts, "p_name", t.parts.filter("p_size = 1"), 40, " ", 3), {"p_size": 40, "p_retailprice": 990}).filter("hard").select("p_partkey"),
    "SELECT p_partkey FROM parts WHERE (p_size >= 40 OR p_retailprice >= 990) AND length(p_name) <= 40 AND length(p_name) - length(replace(p_name, ' ', '')) <= 3 AND p_name NOT IN (SELECT p_name FROM parts WHERE p_size = 1)")


def kind_rules():
    return [("shout", F.col("text").rlike("!!")), ("symbols", F.col("text").rlike("[#$%]")), ("table", F.col("text").contains("|"))]


add("p7_classify_ordered", lambda t: P.classify_ordered(t.doc_words, kind_rules(), "prose").select("doc_id", "category"),
    "SELECT doc_id, CASE WHEN text LIKE '%!!%' THEN 'shout' WHEN regexp_matches(text, '[#$%]') THEN 'symbols' WHEN text LIKE '%|%' THEN 'table' ELSE 'prose' END AS category FROM doc_words")
add("p8_merge_rare", lambda t: P.merge_rare(t.doc_words.select("doc_id", "source"), "source", 40),
    "SELECT doc_id, CASE WHEN n >= 40 THEN source ELSE 'other' END AS source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM doc_words)")
add("p9_stratification_labels", lambda t: P.stratification_labels(t.doc_words.select("doc_id", "source"), "source", 40),
    "WITH c AS (SELECT source, count(*) AS n FROM doc_words GROUP BY 1) SELECT doc_id, d.source, CASE WHEN n >= 40 THEN d.source ELSE (SELECT source FROM c ORDER BY n DESC, source LIMIT 1) END AS stratum_label FROM doc_words d JOIN c ON d.source = c.source")
add("p10_assign_bins", lambda t: P.assign_bins(t.parts, "p_size", [("small", 0, 10), ("middle", 11, 30), ("large", 31, 99)]).select("p_partkey", "bin"),
    "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS bin FROM parts")
add("p11_cut", lambda t: P.cut(t.items, "q", [0, 10, 25, 40], ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "bin"),
    "SELECT l_orderkey, l_linenumber, CASE WHEN q > 0 AND q <= 10 THEN 'a' WHEN q > 10 AND q <= 25 THEN 'b' WHEN q > 25 AND q <= 40 THEN 'c' END AS bin FROM items")
add("p12_quantile_bins", lambda t: P.quantile_bins(t.orders, "o_totalprice", 5, ranges=True).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")),
    "WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders) SELECT printf('Q%d: %.2f–%.2f', k, min(p), max(p)) AS bin, count(*) AS n, round(min(p), 6) AS low FROM (SELECT len(list_filter(e, lambda x: x < o_totalprice)) + 1 AS k, CAST(o_totalprice AS DOUBLE) AS p FROM orders, e) GROUP BY k")
add("p13_one_hot", lambda t: P.one_hot(t.items.select("l_orderkey", "flag"), "flag", ["A", "N", "R"]).groupBy("l_orderkey").agg(F.sum("flag_A").alias("a"), F.sum("flag_N").alias("n"), F.sum("flag_R").alias("r")),
    "SELECT l_orderkey, CAST(count(*) FILTER (flag = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (flag = 'N') AS DOUBLE) AS n, CAST(count(*) FILTER (flag = 'R') AS DOUBLE) AS r FROM items GROUP BY 1")
add("p14_group_ids", lambda t: P.group_ids(t.outcomes.select("user_id", "event_id"), "user_id", "event_id"),
    "WITH f AS (SELECT user_id, min(event_id) AS f FROM outcomes GROUP BY 1) SELECT o.user_id, event_id, g AS group_id FROM outcomes o JOIN (SELECT user_id, row_number() OVER (ORDER BY f, user_id) - 1 AS g FROM f) x ON o.user_id = x.user_id")
add("p15_constant_columns", lambda t: P.constant_columns(t.items.withColumn("one", F.lit(1.0)), ["q", "one", "d"]), "SELECT * FROM (VALUES ('q', false), ('one', true), ('d', (SELECT min(d) = max(d) FROM items))) v(\"column\", constant)")
add("p16_drop_correlated", lambda t: P.drop_correlated(t.items.withColumn("q2", F.col("q") * 2 + F.col("d")), ["q", "q2", "price", "d"]).select("l_orderkey", "q", "price", "d"), "SELECT l_orderkey, q, round(price, 6) AS price, round(d, 6) AS d FROM items")
add("p17_standardise", lambda t: P.standardise(t.items.filter("status = 'O'"), t.items, ["q", "price"]).groupBy("status", "flag").agg(F.avg("q").alias("q"), F.avg("price").alias("price"), F.stddev_pop("q").alias("sq")),
    "WITH m AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM items WHERE status = 'O') SELECT status, flag, round(avg((q - mq) / m.sq), 6) AS q, round(avg((price - mp) / m.sp), 6) AS price, round(stddev_pop((q - mq) / m.sq), 6) AS sq FROM items, m GROUP BY ALL")
add("p18_block_scale", lambda t: P.block_scale(t.items, t.items.withColumn("one", F.lit(1.0)), [["q", "price"], ["d"]]).groupBy("flag").agg(F.sum(F.col("q") * F.col("q")).alias("q2"), F.sum(F.col("d") * F.col("d")).alias("d2")),
    "WITH m AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(d) AS md, stddev_pop(d) AS sd FROM items) SELECT flag, round(sum(pow((q - mq) / sq / sqrt(2), 2)), 6) AS q2, round(sum(pow((d - md) / sd, 2)), 6) AS d2 FROM items, m GROUP BY ALL")
add("p19_scale_target", lambda t: P.scale_target(t.orders, P.scale_target(t.orders, t.orders, "o_totalprice"), "o_totalprice", True).groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("price")), "SELECT o_orderstatus, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1")
add("p20_profile", lambda t: P.profile(t.items, ["q", "price"]),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(count(*) - count({c}) AS BIGINT) AS nulls, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(CAST(min({c}) AS DOUBLE), 6) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS high FROM items" for c in ("q", "price")))
add("p21_correlation_matrix", lambda t: P.correlation_matrix(t.items, ["q", "price", "d"]), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM items" for a in ("q", "price", "d") for b in ("q", "price", "d")))
add("p22_histogram", lambda t: P.histogram(t.orders, "o_totalprice", 0.0, 25000.0), "SELECT CAST(floor(o_totalprice / 25000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
add("p22_box_stats", lambda t: P.box_stats(t.orders, "o_orderpriority", "o_totalprice"), "SELECT o_orderpriority, round(min(o_totalprice), 6) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(max(o_totalprice), 6) AS high FROM orders GROUP BY 1")
add("p23_attribute_flags", lambda t: P.attribute_flags(P.symbol_counts(t.doc_words, "text", {"c": ",", "b": "|"}), ["c", "b"], "c", 2, "b", 8).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("n_attributes").alias("total")),
    "WITH x AS (SELECT length(text) - length(replace(text, ',', '')) AS c, length(text) - length(replace(text, '|', '')) AS b FROM doc_words) SELECT c >= 2 AND b <= 8 AS flag, count(*) AS n, CAST(sum(c + b) AS BIGINT) AS total FROM x GROUP BY 1")
add("p24_additive_estimate", lambda t: P.additive_estimate(t.sql("SELECT l_orderkey AS k, flag AS unit, count(*) AS n FROM items GROUP BY l_orderkey, flag"), t.sql("SELECT 'A' AS unit, 1.25D AS weight UNION ALL SELECT 'N', 0.5D"), "k", "unit", 10.0),
    "SELECT l_orderkey AS k, CASE WHEN count(*) FILTER (flag = 'R') = 0 THEN round(10.0::DOUBLE + sum(CASE flag WHEN 'A' THEN 1.25 ELSE 0.5 END), 4) END AS estimate FROM items GROUP BY 1")
add("p25_normalise_key", lambda t: P.normalise_key(t.parts.select("p_partkey", "p_type"), "p_type", [("[^a-z ]", ""), (" +", "-")], "k"), "SELECT p_partkey, p_type, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z ]', '', 'g'), ' +', '-', 'g')) AS k FROM parts")
add("p26_twin_key", lambda t: P.twin_key(t.parts.select("p_partkey", "p_brand"), "p_brand", ("1", "2"), "twin"), "SELECT p_partkey, p_brand, translate(p_brand, '12', '21') AS twin FROM parts")
add("p27_parse_list", lambda t: P.parse_list(t.sql("SELECT user_id, concat(CAST(user_id AS STRING), ';', CAST(event_id AS STRING), ';x') AS v FROM events"), "v", ";", "l").groupBy("user_id").agg(F.sum(F.col("l")[1]).alias("s"), F.count(F.col("l")[2]).alias("n")), "SELECT user_id, round(CAST(sum(event_id) AS DOUBLE), 6) AS s, CAST(0 AS BIGINT) AS n FROM events GROUP BY 1")
add("p28_pattern_share", lambda t: P.pattern_share(t.pages, "html", "<a href", []), "SELECT round(avg(CASE WHEN html LIKE '%<a href%' THEN 1.0 ELSE 0.0 END), 6) AS share FROM pages")
add("p29_masked_mean_pool", lambda t: P.masked_mean_pool(t.embeddings.withColumn("mask", F.col("vec_id") % 3 != 0), ["label"], "embedding", "mask").select("label", F.posexplode("pooled").alias("place", "mean")),
    "SELECT label, CAST(i AS INT) AS place, round(sum(CASE WHEN vec_id % 3 <> 0 THEN x ELSE 0 END) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 6) AS mean FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i")
add("p30_count_fingerprint", lambda t: P.count_fingerprint(t.benchmark, "item_id", "text", 1, 64, 5), "SELECT item_id, (('0x' || substr(md5('5:' || w), 1, 8))::BIGINT % 64) AS bin, count(*) AS count FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) GROUP BY ALL")

# ---- joins -----------------------------------------------------------------------------------------------------------

add("j1_merge", lambda t: J.merge(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price")),
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 6) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("j2_join_many_to_one", lambda t: J.join_many_to_one(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")), "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
add("j3_left_keep_order", lambda t: J.join_keeping_order(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], "s_suppkey").select("s_suppkey", "n_name").withColumn("place", F.monotonically_increasing_id()).select("s_suppkey", "n_name", placed("place")), "SELECT s_suppkey, n_name, CAST(row_number() OVER (ORDER BY s_suppkey) AS INT) AS place FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
add("j4_semi_anti", lambda t: J.semi(t.doc_words, t.labels, "doc_id").select("doc_id", F.lit("labelled").alias("kind")).unionByName(J.anti(t.doc_words, t.labels, "doc_id").select("doc_id", F.lit("plain").alias("kind"))), "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'plain' END AS kind FROM doc_words")
add("j5_lookup", lambda t: J.lookup(t.doc_words, "lang", {"en": "English", "de": "German"}, "name").select("doc_id", "name"), "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END AS name FROM doc_words")
add("j6_winner_join", lambda t: J.winner_join(t.pred.select("fold", "method", "key", "y_pred"), A.winner(t.foldmae, ["fold"], "mae", "method"), ["fold", "method"]).groupBy("fold", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred").alias("s")),
    "WITH b AS (SELECT fold, method FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mae, method) AS r FROM foldmae) WHERE r = 1) SELECT fold, method, count(*) AS n, round(sum(y_pred), 6) AS s FROM pred JOIN b USING (fold, method) GROUP BY ALL")
add("j7_paired", lambda t: J.paired(t.pred, ["key"], "method", "mean", "by_type", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y_pred_a") - F.col("y_pred_b")).alias("gap")), "SELECT count(*) AS n, round(avg(p_mean - p_type), 6) AS gap FROM wide")
add("j8_twin_join", lambda t: J.twin_join(t.sql("SELECT n_regionkey AS g, n_nationkey AS k, 49 - n_nationkey AS w, n_name AS v FROM nation"), "g", "k", "w", "v").select("g", "k", "w", "v", "twin_v"), "SELECT a.n_regionkey AS g, a.n_nationkey AS k, 49 - a.n_nationkey AS w, a.n_name AS v, b.n_name AS twin_v FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = 49 - a.n_nationkey")
add("j9_band_expansion", lambda t: J.band_expansion(t.parts.select("p_partkey", (F.col("p_size") - 5).alias("entry")), "entry", [10, 20, 40]).groupBy("size").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(size AS INT) AS size, count(*) AS n FROM parts, (VALUES (10), (20), (40)) v(size) WHERE p_size - 5 BETWEEN 0 AND size GROUP BY 1")
TOKENS = "SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM doc_words WHERE lang = 'en'"
add("j10_fold_residuals", lambda t: J.fold_residual_range(t.sql("SELECT c_custkey, CAST(c_nationkey % 5 AS INT) AS fold, c_acctbal AS y_pred FROM customer"), t.sql("SELECT CAST(s_nationkey % 5 AS INT) AS fold, s_acctbal AS residual FROM supplier"), ["fold"], ["c_custkey"]),
    "SELECT c_custkey, round(min(c_acctbal - s_acctbal), 6) AS low, round(max(c_acctbal + s_acctbal), 6) AS high FROM customer JOIN supplier ON c_nationkey % 5 = s_nationkey % 5 GROUP BY 1")
for name, kind in (("j11_count_tanimoto", True), ("j12_set_tanimoto", False)):
    n = "count(*)" if kind else "1"
    add(name, lambda t, kind=kind: J.nearest_tokens(t.benchmark.select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("token"), F.lit(1).alias("c")), t.benchmark.select(F.col("item_id").alias("other"), F.explode(F.split(F.lower(F.reverse("text")), " ")).alias("token"), F.lit(1).alias("c")), "item_id", "other", "token", "c" if kind else None),
        f"""WITH a AS (SELECT item_id, w, {n} AS c FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) GROUP BY ALL), b AS (SELECT item_id AS other, w, {n} AS c FROM (SELECT item_id, unnest(string_split(lower(reverse(text)), ' ')) AS w FROM benchmark) GROUP BY ALL),
        ta AS (SELECT item_id, sum(c) AS s FROM a GROUP BY 1), tb AS (SELECT other, sum(c) AS s FROM b GROUP BY 1), m AS (SELECT item_id, other, sum(least(a.c, b.c)) AS common FROM a JOIN b USING (w) GROUP BY ALL)
        SELECT item_id, round(coalesce(max(common / (ta.s + tb.s - common)), 0), 6) AS similarity FROM ta LEFT JOIN m USING (item_id) LEFT JOIN tb USING (other) GROUP BY 1""")
add("j13_nearest_euclidean", lambda t: J.nearest_euclidean(t.embeddings, t.embeddings.filter("label = 0").select(F.col("embedding").alias("ref")), "vec_id", "embedding", "ref"),
    "SELECT a.vec_id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b WHERE b.label = 0 GROUP BY 1")
LABEL_0 = "label = 0"
add("j13_min_max_euclidean", lambda t: J.nearest_euclidean(J.min_max_scaled(t.embeddings.select("vec_id", "embedding"), t.embeddings, "embedding"), J.min_max_scaled(t.embeddings.filter(LABEL_0).select(F.col("embedding").alias("ref")), t.embeddings.select(F.col("embedding").alias("ref")), "ref"), "vec_id", "embedding", "ref"),
    """WITH p AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT i, min(x) AS l, max(x) AS h FROM p GROUP BY 1), s AS (SELECT vec_id, any_value(label) AS label, list(coalesce((x - l) / nullif(h - l, 0), 0) ORDER BY i) AS e FROM p JOIN b USING (i) GROUP BY 1)
    SELECT a.vec_id, round(min(list_distance(a.e, b.e)), 6) AS distance FROM s a, s b WHERE b.label = 0 GROUP BY 1""")
NOISY = "SELECT vec_id, transform(embedding, (x, i) -> CAST(x AS DOUBLE) + 0.05D * ((vec_id * 31 + i * 17) % 13 - 6)) AS embedding FROM {v} WHERE vec_id % 50 = 0"  # a search: the rows whose id is divisible by 50 against all
add("j14_retrieval", lambda t: J.retrieval(t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), t.spark.sql(NOISY, v=t.embeddings), "vec_id", "embedding"),
    """WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), v AS (SELECT vec_id, list_transform(e, lambda x, i: x + 0.05 * ((vec_id * 31 + (i - 1) * 17) % 13 - 6)) AS w FROM c WHERE vec_id % 50 = 0),
    n AS (SELECT v.vec_id, arg_min(c.vec_id, (round(1 - list_cosine_similarity(w, e), 9), c.vec_id)) AS nearest FROM v, c GROUP BY 1), o AS (SELECT a.vec_id, min(1 - list_cosine_similarity(a.e, b.e)) AS far FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY 1)
    SELECT count(*) AS n, round(avg(CASE WHEN nearest = vec_id THEN 1.0 ELSE 0 END), 6) AS retrieval_share, round(median((1 - list_cosine_similarity(w, e)) / greatest(far, 1e-12)), 6) AS median_distance_ratio FROM v JOIN c USING (vec_id) JOIN n USING (vec_id) JOIN o USING (vec_id)""")
add("j14_nearest_cosine", lambda t: J.nearest_cosine(t.embeddings, t.embeddings.filter("label = 1").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("rv")), "vec_id", "embedding", "ref", "rv"),
    "SELECT a.vec_id, arg_min(b.vec_id, (round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id)) AS nearest, round(min(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b WHERE b.label = 1 GROUP BY 1")
add("j15_row_cosine", lambda t: J.row_cosine(t.embeddings.withColumn("r", F.reverse("embedding")), "embedding", "r").select("vec_id", "distance"), "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS distance FROM embeddings")

from . import catalogue_metrics, catalogue_models, catalogue_splits  # noqa: E402, F401  they add their queries here
