"""Queries of metrics, windows, sets of rows, inference, intervals and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import audit as L
from ..operators import conformal as C
from ..operators import inference as I
from ..operators import projections as P
from ..operators import splits as K
from ..operators import windows as W
from .catalogue import add, placed, uniform_sql

ERR = "abs(y_true - y_pred)"

# ---- aggregates ------------------------------------------------------------------------------------------------------

add("a1_fold_metrics", lambda t: A.fold_metrics(t.pred, ["method", "fold"], F.col("x") >= 12),
    """SELECT method, fold, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) AS rmse,
    round(1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(avg(CASE WHEN x >= 12 THEN pow(y_true - y_pred, 2) END)), 6) AS rmse_masked FROM pred GROUP BY ALL""")
add("a2_error_table", lambda t: A.error_table(t.pred, ["method", "stratum"]), "SELECT method, stratum, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) AS rmse FROM pred GROUP BY ALL")
add("a3_nested_mean", lambda t: A.nested_mean(t.pred.withColumn("e", F.abs(F.col("y_true") - F.col("y_pred"))), [["method", "fold", "stratum"], ["method", "fold"], ["method"]], "e"),
    "SELECT method, round(avg(e), 6) AS e FROM (SELECT method, fold, avg(e) AS e FROM (SELECT method, fold, stratum, avg(abs(y_true - y_pred)) AS e FROM pred GROUP BY ALL) GROUP BY ALL) GROUP BY ALL")
add("a4_summarise", lambda t: A.summarise(t.foldmae, ["method"], "mae"), "SELECT method, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS sd, count(*) AS size FROM foldmae GROUP BY 1")
add("a5_macro_average", lambda t: A.macro_average(t.pred.withColumn("e", F.abs(F.col("y_true") - F.col("y_pred"))), ["method"], "stratum", "e"), "SELECT method, round(avg(e), 6) AS e FROM (SELECT method, stratum, avg(abs(y_true - y_pred)) AS e FROM pred GROUP BY ALL) GROUP BY 1")
add("a6_coverage_table", lambda t: A.coverage_table(t.pred.withColumns({"lower": F.col("y_pred") - 40, "upper": F.col("y_pred") + F.col("x") * 3}), ["method"], "stratum"),
    "SELECT method, coalesce(stratum, 'all') AS stratum, count(*) AS n, round(avg(CASE WHEN y_true BETWEEN y_pred - 40 AND y_pred + x * 3 THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(40 + x * 3), 6) AS width FROM pred GROUP BY GROUPING SETS ((method), (method, stratum))")
add("a7_spread_summary", lambda t: A.spread_summary(t.items, ["l_partkey", "flag"], "price", 20000), "SELECT count(*) AS groups, CAST(sum(CASE WHEN s > 20000 THEN 1 ELSE 0 END) AS BIGINT) AS wide FROM (SELECT max(price) - min(price) AS s FROM items GROUP BY l_partkey, flag HAVING count(*) > 1)")
add("a8_winner", lambda t: A.winner(t.foldmae, ["fold"], "mae", "method").select("fold", "method", "mae"), "SELECT fold, arg_min(method, (mae, method)) AS method, round(min(mae), 6) AS mae FROM foldmae GROUP BY 1")
EVID = """SELECT event_type AS category, concat('v', CAST(CAST(floor(value / 40) AS INT) AS STRING)) AS evidence, value > 80 AS exclude, user_id, event_id FROM events"""
add("a9_merge_evidence", lambda t: A.merge_evidence(t.sql(EVID), "user_id", "event_id"),
    f"""WITH e AS ({EVID}), c AS (SELECT user_id, category AS v, min(event_id) AS f FROM e GROUP BY ALL), d AS (SELECT user_id, evidence AS v, min(event_id) AS f FROM e GROUP BY ALL)
    SELECT user_id, bool_or(exclude) AS exclude, (SELECT string_agg(v, '; ' ORDER BY f) FROM c WHERE c.user_id = e.user_id) AS category, (SELECT string_agg(v, '; ' ORDER BY f) FROM d WHERE d.user_id = e.user_id) AS evidence FROM e GROUP BY user_id""")
add("a10_value_counts", lambda t: A.value_counts(t.doc_words, ["lang", "source"]), "SELECT lang, source, count(*) AS n FROM doc_words GROUP BY ALL")
add("a10_value_count_maps", lambda t: A.value_count_maps(t.items, "flag", "status").select("flag", F.explode("counts").alias("status", "n")), "SELECT flag, status, count(*) AS n FROM items GROUP BY ALL")
add("a11_hit_summary", lambda t: A.hit_summary(t.campaign, "strategy", "ord", "hit", 10),
    "WITH s AS (SELECT strategy, hit, row_number() OVER w AS step, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS h FROM campaign WINDOW w AS (PARTITION BY strategy ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT strategy, count(*) AS lookups, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS rate, min(CASE WHEN h >= 10 THEN step END) AS kth FROM s GROUP BY 1")
add("a12_pivot_wide", lambda t: A.pivot_wide(t.foldmae, ["fold"], "method", ["mean", "by_type", "by_hour"], "mae"), "SELECT fold, round(max(CASE method WHEN 'mean' THEN mae END), 6) AS mean, round(max(CASE method WHEN 'by_type' THEN mae END), 6) AS by_type, round(max(CASE method WHEN 'by_hour' THEN mae END), 6) AS by_hour FROM foldmae GROUP BY 1")
add("a13_paired_change", lambda t: A.paired_change(t.foldmae, ["fold"], "method", "mean", "mae"), "SELECT a.method, round(avg(a.mae - b.mae), 6) AS change, round(stddev_samp(a.mae - b.mae), 6) AS sd, count(*) FILTER (a.mae < b.mae) AS folds_better, count(*) AS folds FROM foldmae a JOIN foldmae b ON a.fold = b.fold AND b.method = 'mean' WHERE a.method <> 'mean' GROUP BY 1")
add("a14_noise_summary", lambda t: A.noise_summary(t.wide, "y_true", "p_mean"), "WITH g AS (SELECT abs(y_true - p_mean) AS g FROM wide) SELECT round(avg(g), 6) AS mean, round(median(g), 6) AS median, round(quantile_cont(g, 0.9), 6) AS q90, round(max(g), 6) AS largest, round(avg(CASE WHEN g <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1 FROM g")
add("a14_scaled_mad", lambda t: A.scaled_mad(t.ev, "grp", "y_true"), "SELECT grp, round(1.4826 * mad(y_true), 6) AS mad FROM ev GROUP BY 1 HAVING count(y_true) >= 3")
add("a15_distance_bands", lambda t: A.distance_bands(t.orders, "o_totalprice", [(0, 50000), (50000, 100000)], (200000, 300000)),
    "SELECT * FROM (SELECT 0.0::DOUBLE AS low, 50000.0::DOUBLE AS high, count(*) FILTER (o_totalprice >= 0 AND o_totalprice < 50000) AS n, round(count(*) FILTER (o_totalprice >= 200000 AND o_totalprice < 300000) / 100000.0::DOUBLE * 50000, 6) AS expected FROM orders UNION ALL SELECT 50000, 100000, count(*) FILTER (o_totalprice >= 50000 AND o_totalprice < 100000), round(count(*) FILTER (o_totalprice >= 200000 AND o_totalprice < 300000) / 100000.0::DOUBLE * 50000, 6) FROM orders)")
add("a16_bias_by_bin", lambda t: A.bias_by_bin(P.cut(t.wide.withColumn("e", F.col("p_hour") - F.col("y_true")), "x", [-1, 5, 11, 17, 23], ["night", "morning", "day", "evening"]), "bin", "e"),
    "SELECT CASE WHEN x <= 5 THEN 'night' WHEN x <= 11 THEN 'morning' WHEN x <= 17 THEN 'day' ELSE 'evening' END AS bin, count(*) AS size, round(median(p_hour - y_true), 6) AS median_bias, round(avg(abs(p_hour - y_true)), 6) AS mae FROM wide GROUP BY 1")
add("a17_tail_report", lambda t: A.tail_report(t.pred.filter("method = 'mean'"), t.ev.filter("x >= 2"), "fold"),
    """WITH q AS (SELECT fold, quantile_cont(y_true, 0.02) AS lo, quantile_cont(y_true, 0.98) AS hi, min(y_true) AS least, max(y_true) AS most FROM ev WHERE x >= 2 GROUP BY 1),
    b AS (SELECT p.fold, CASE WHEN y_true < lo THEN 'low' WHEN y_true > hi THEN 'high' ELSE 'middle' END AS band, abs(y_true - y_pred) AS e, y_true < least OR y_true > most AS beyond FROM pred p JOIN q ON p.fold = q.fold WHERE method = 'mean')
    SELECT fold, band, count(*) AS n, count(*) FILTER (beyond) AS outside, round(avg(e), 6) AS mae, round(sum(e) / sum(sum(e)) OVER (PARTITION BY fold), 6) AS share FROM b GROUP BY fold, band""")
add("a18_same_keys", lambda t: A.same_keys_check(t.pred, "fold", "method", "key"), "WITH s AS (SELECT fold, method, list_sort(list(key)) AS k FROM pred GROUP BY ALL) SELECT fold, count(DISTINCT k) AS versions, count(*) AS methods FROM s GROUP BY 1")
add("a18_fold_partition", lambda t: A.fold_partition_check(K.familiar_tasks(t.ev.withColumn("other", (F.col("fold") + 1) % 6), "key", ["fold", "other"], 5).filter("role = 'test'"), ["repeat"], "key", t.ev),
    """SELECT CAST(r AS INT) AS repeat, count(*) FILTER (hit) AS keys, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (NOT hit) AS missing, CAST(0 AS BIGINT) AS "foreign" FROM (SELECT r, CASE r WHEN 0 THEN fold ELSE (fold + 1) % 6 END < 5 AS hit FROM ev, range(2) x(r)) GROUP BY 1""")
add("a19_params_tally", lambda t: A.params_tally(t.events, "props", ["event_type"]).filter("parameter = 'k'"), "SELECT event_type, 'k' AS parameter, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
add("a20_weights_summary", lambda t: A.weights_summary(t.foldmae, "method", "mae"), "SELECT method, printf('%.3f [%.3f to %.3f]', avg(mae), min(mae), max(mae)) AS summary FROM foldmae GROUP BY 1")
add("a20_mean_of_first", lambda t: A.mean_of_first(t.pred.withColumn("e", F.abs(F.col("y_true") - F.col("y_pred"))), ["method"], ["fold", "method"], "e", "key"), "SELECT method, round(avg(e), 6) AS e FROM (SELECT method, fold, arg_min(abs(y_true - y_pred), key) AS e FROM pred GROUP BY ALL) GROUP BY 1")
add("a21_gap_table", lambda t: A.gap_table(t.foldmae.withColumn("part", F.when(F.col("fold") < 2, "train").otherwise("test")), "method", "part", "mae"), "SELECT method, round(avg(CASE WHEN fold < 2 THEN mae END), 6) AS train, round(avg(CASE WHEN fold >= 2 THEN mae END), 6) AS test, round(avg(CASE WHEN fold >= 2 THEN mae END) - avg(CASE WHEN fold < 2 THEN mae END), 6) AS gap FROM foldmae GROUP BY 1")
add("a22_contribution", lambda t: A.contribution(t.wide.withColumns({"ea": F.col("y_true") - F.col("p_hour"), "eb": F.col("y_true") - F.col("p_mean")}), "grp", "ea", "eb", 20),
    """WITH g AS (SELECT grp, avg(y_true - p_hour) AS a, avg(y_true - p_mean) AS b FROM wide GROUP BY 1), x AS (SELECT *, a * a - b * b AS e, row_number() OVER (ORDER BY a * a - b * b DESC, grp) AS r FROM g)
    SELECT round(sum(e), 6) AS total, round(sum(e) FILTER (r <= 20) / sum(e), 6) AS top_share, round(avg(abs(a)) FILTER (r > 20), 6) AS rest_a, round(avg(abs(b)) FILTER (r > 20), 6) AS rest_b FROM x""")
add("a23_region_ratio", lambda t: A.region_ratio(t.wide.withColumns({"e": F.abs(F.col("y_true") - F.col("p_mean")), "flag": F.col("x") >= 12}), "stratum", "p_hour", "flag", "e", "key"),
    """WITH r AS (SELECT stratum, p_hour, x >= 12 AS flag, abs(y_true - p_mean) AS e, row_number() OVER (PARTITION BY stratum ORDER BY p_hour DESC, key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM wide)
    SELECT stratum, round(avg(p_hour) FILTER (flag) / avg(p_hour) FILTER (NOT flag), 6) AS flagged_ratio, round(avg(e) FILTER (r <= greatest(1, n // 10)) / avg(e), 6) AS top_ratio FROM r GROUP BY 1""")
add("a24_found_share", lambda t: A.found_share(t.steps.filter("step <= 300").select("seed", "key"), t.campaign.filter("hit").select("key", F.col("strategy").alias("grp")), "seed", "grp", "key"),
    """WITH h AS (SELECT strategy AS grp, key FROM campaign WHERE hit), f AS (SELECT s.seed, h.grp, count(*) AS found FROM steps s JOIN h ON s.key = h.key WHERE step <= 300 GROUP BY ALL), n AS (SELECT grp, count(DISTINCT key) AS total FROM h GROUP BY 1)
    SELECT r.seed, n.grp, coalesce(found, 0) AS found, total, round(coalesce(found, 0) / total, 6) AS share FROM (SELECT DISTINCT seed FROM steps WHERE step <= 300) r CROSS JOIN n LEFT JOIN f ON f.seed = r.seed AND f.grp = n.grp""")
add("a24_never_found", lambda t: A.never_found(t.steps.filter("step <= 300"), t.campaign.filter("hit"), "key"), "SELECT key FROM campaign WHERE hit AND key NOT IN (SELECT key FROM steps WHERE step <= 300)")
add("a25_ensemble_mean", lambda t: A.error_table(A.ensemble_mean(t.pred, ["fold", "key", "y_true"]), ["fold"]), "SELECT fold, count(*) AS n, round(avg(abs(y_true - p)), 6) AS mae, round(sqrt(avg(pow(y_true - p, 2))), 6) AS rmse FROM (SELECT fold, key, y_true, avg(y_pred) AS p FROM pred GROUP BY ALL) GROUP BY 1")
add("a26_variant_dispersion", lambda t: A.variant_dispersion(t.pred, "key", "y_pred"), "SELECT key, round(avg(y_pred), 6) AS mean, round(stddev_samp(y_pred), 6) AS sd, round(max(y_pred) - min(y_pred), 6) AS range FROM pred GROUP BY 1")
add("a26_dispersion_summary", lambda t: A.dispersion_summary(A.variant_dispersion(t.pred, "key", "y_pred"), "sd", 12.0),
    "WITH d AS (SELECT stddev_samp(y_pred) AS sd FROM pred GROUP BY key) SELECT count(sd) AS n, round(quantile_cont(sd, 0.25), 6) AS q25, round(median(sd), 6) AS median, round(quantile_cont(sd, 0.75), 6) AS q75, round(avg(CASE WHEN sd > 12 THEN 1.0 ELSE 0 END), 6) AS share_above, round(avg(CASE WHEN sd = 0 THEN 1.0 ELSE 0 END), 6) AS share_zero FROM d WHERE sd IS NOT NULL")
add("a27_category_summary", lambda t: A.category_summary(t.ev, "stratum", "y_true"), "SELECT stratum, count(*) AS n, round(median(y_true), 6) AS median, round(min(y_true), 6) AS low, round(max(y_true), 6) AS high FROM ev GROUP BY 1")
add("a28_matches_saved", lambda t: A.matches_saved(t.wide.select("key", F.col("p_mean").alias("v")), t.wide.filter("fold <> 4").select("key", F.col("p_type").alias("v")), ["key"], "v", 0.5), "SELECT key, round(p_mean, 6) AS new, round(CASE WHEN fold <> 4 THEN p_type END, 6) AS saved FROM wide WHERE fold = 4 OR abs(p_mean - p_type) > 0.5")

# ---- windows and sets ------------------------------------------------------------------------------------------------

add("w1_hit_curve", lambda t: W.hit_curve(t.campaign, ["strategy", "seed"], ["ord", "key"], "hit", 50), "SELECT strategy, seed, CAST(step AS BIGINT) AS step, CAST(hits AS BIGINT) AS hits FROM (SELECT *, max(step) OVER (PARTITION BY strategy, seed) AS n FROM steps) WHERE step % 50 = 0 OR step = n")
add("w2_first_to_reach", lambda t: W.first_to_reach(t.steps, "strategy", "seed", "step", "hits", [5, 50, 200]),
    "WITH s AS (SELECT strategy, seed, g AS target, min(CASE WHEN hits >= g THEN step END) AS at_ FROM steps, (VALUES (5), (50), (200)) v(g) GROUP BY ALL) SELECT strategy, target, round(CASE WHEN count(at_) = count(*) THEN avg(at_) END, 6) AS mean_steps, count(at_) || '/' || count(*) AS reached FROM s GROUP BY ALL")
add("w3_labels_to_match", lambda t: W.labels_to_match(t.curves, "strategy", "size", "value", "1-URGENT"),
    """WITH m AS (SELECT strategy, size, avg(value) AS v FROM curves GROUP BY ALL), r AS (SELECT size AS budget, v AS goal FROM m WHERE strategy = '1-URGENT'),
    s AS (SELECT *, lag(v) OVER w AS pv, lag(size) OVER w AS ps FROM m WINDOW w AS (PARTITION BY strategy ORDER BY size)),
    f AS (SELECT *, row_number() OVER (PARTITION BY strategy, budget ORDER BY size) AS n FROM s JOIN r ON v <= goal)
    SELECT x.strategy, r.budget, round(CASE WHEN f.strategy IS NULL THEN NULL WHEN ps IS NULL THEN size ELSE ps + (pv - goal) / (pv - v) * (size - ps) END, 6) AS needed FROM (SELECT DISTINCT strategy FROM m) x CROSS JOIN r LEFT JOIN (SELECT strategy, budget, size, ps, pv, v FROM f WHERE n = 1) f ON f.strategy = x.strategy AND f.budget = r.budget""")
add("w4_retention_curve", lambda t: W.retention_curve(t.wide.withColumn("e", F.col("y_true") - F.col("p_mean")), ["stratum"], "p_hour", "e", "key", [0.25, 0.5, 1.0]),
    """WITH r AS (SELECT stratum, abs(y_true - p_mean) AS e, row_number() OVER (PARTITION BY stratum ORDER BY p_hour, key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM wide)
    SELECT stratum, f::DOUBLE AS fraction, count(*) AS n, round(avg(e), 6) AS mae FROM r, (VALUES (0.25), (0.5), (1.0)) v(f) WHERE r <= greatest(1, round_even(f * n, 0)) GROUP BY ALL""")
add("w5_step_distance", lambda t: W.step_distance(t.embeddings, ["label"], "vec_id", "embedding"),
    "SELECT label, vec_id, round(1 - list_cosine_similarity(lag(e) OVER w, e), 6) AS from_last, round(1 - list_cosine_similarity(first_value(e) OVER w, e), 6) AS from_first FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
add("w5_step_summary", lambda t: W.step_summary(W.step_distance(t.embeddings, ["label"], "vec_id", "embedding").withColumns({c: F.round(c, 9) for c in ("from_last", "from_first")}), ["label"], "vec_id", 250),
    """WITH s AS (SELECT label, vec_id, round(1 - list_cosine_similarity(lag(e) OVER w, e), 9) AS l, round(1 - list_cosine_similarity(first_value(e) OVER w, e), 9) AS f FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY f) + (count(*) OVER (PARTITION BY label, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY label ORDER BY vec_id) AS ro FROM s)
    SELECT label, count(*) AS n, round(corr(ro, rf), 6) AS rho, round(median(l) FILTER (vec_id <= 250), 6) AS median_upto, round(median(l) FILTER (vec_id > 250), 6) AS median_beyond, round(avg(CASE WHEN l < 1e-9 THEN 1.0 ELSE 0 END) FILTER (vec_id > 250 AND l IS NOT NULL), 6) AS share_unchanged FROM r GROUP BY 1""")
add("w6_top_k_by_abs", lambda t: W.top_k_by_abs(t.wide, F.col("y_true") - F.col("p_type"), 25, "key").select("key", "size"), "SELECT key, round(abs(y_true - p_type), 6) AS size FROM wide ORDER BY abs(y_true - p_type) DESC, key LIMIT 25")
add("w7_order_stat", lambda t: W.order_stat(t.ev, ["grp"], "y_true", F.lit(20)).select("grp", F.when(F.col("stat") < 1e300, F.col("stat")).alias("stat"), "n"), "SELECT grp, round(list_sort(list(y_true))[20], 6) AS stat, count(*) AS n FROM ev GROUP BY 1")
add("w8_rank_in_round", lambda t: W.rank_in_round(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", ["-o_totalprice", "o_orderkey"]).select("o_orderkey", "rank_in_round"), "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank_in_round FROM orders")
add("w9_stage_rates", lambda t: W.stage_rates(P.cut(t.steps.withColumn("distance", F.abs(F.col("price") - 125000)), "step", [0, 50, 150, 400], ["early", "middle", "late"], "stage"), "stage", "hit", "distance"),
    "SELECT CASE WHEN step <= 50 THEN 'early' WHEN step <= 150 THEN 'middle' ELSE 'late' END AS stage, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS rate, round(median(abs(price - 125000)), 6) AS median_distance, count(*) AS n FROM steps WHERE step <= 400 GROUP BY 1")
add("w10_wins", lambda t: W.wins(t.sql("SELECT seed, strategy, CAST(max(hits) AS DOUBLE) AS h FROM steps WHERE step <= 200 GROUP BY seed, strategy"), "seed", "strategy", "h", "1-URGENT"), "WITH f AS (SELECT seed, strategy, max(hits) AS h FROM steps WHERE step <= 200 GROUP BY ALL) SELECT f.strategy, count(*) FILTER (a.h > f.h) AS wins, count(*) AS seeds, round(avg(a.h) / avg(f.h), 6) AS ratio FROM f JOIN f a ON a.seed = f.seed AND a.strategy = '1-URGENT' WHERE f.strategy <> '1-URGENT' GROUP BY 1")
add("w11_best_k_mean", lambda t: W.best_k_mean(t.ev, ["grp"], "y_true", "key"), "SELECT grp, round(avg(y_true), 6) AS best_mean FROM (SELECT grp, y_true, row_number() OVER (PARTITION BY grp ORDER BY y_true, key) AS r FROM ev) WHERE r <= 3 GROUP BY 1")
add("w12_early_stop", lambda t: W.early_stop_point(t.ev, ["grp"], "key", "y_true", 4),
    """WITH r AS (SELECT grp, key, y_true, row_number() OVER w AS r, min(y_true) OVER (PARTITION BY grp ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev WINDOW w AS (PARTITION BY grp ORDER BY key)),
    m AS (SELECT *, b IS NULL OR y_true < b AS better, max(CASE WHEN b IS NULL OR y_true < b THEN r END) OVER (PARTITION BY grp ORDER BY key) AS l FROM r),
    s AS (SELECT grp, coalesce(min(CASE WHEN r - l >= 4 THEN r END), max(r)) AS e FROM m GROUP BY 1) SELECT m.grp, max(CASE WHEN better THEN key END) AS best_epoch, max(key) AS stop_epoch FROM m JOIN s ON m.grp = s.grp AND r <= e GROUP BY 1""")
add("w13_curve_band", lambda t: W.curve_band(t.curves, ["strategy", "size"], "value"), "SELECT strategy, size, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM curves GROUP BY ALL")
add("w14_stable_sort", lambda t: W.stable_sort(t.parts.select("p_partkey", "p_brand", "p_size"), F.desc("p_size"), "p_brand", "p_partkey").withColumn("place", F.monotonically_increasing_id()).select("p_partkey", "p_brand", "p_size", placed("place")), "SELECT p_partkey, p_brand, p_size, CAST(row_number() OVER (ORDER BY p_size DESC, p_brand, p_partkey) AS INT) AS place FROM parts")
add("u1_concat", lambda t: W.concat(t.customer.select(F.col("c_name").alias("name"), "c_acctbal"), t.supplier.select(F.col("s_name").alias("name"), "s_nationkey")), "SELECT c_name AS name, round(c_acctbal, 6) AS c_acctbal, NULL::INT AS s_nationkey FROM customer UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier")
add("u2_difference", lambda t: W.difference(t.doc_words.select("doc_id"), t.labels, "doc_id"), "SELECT doc_id FROM doc_words WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("u3_intersection", lambda t: W.intersection(t.doc_words.select("doc_id"), t.labels, "doc_id"), "SELECT doc_id FROM doc_words WHERE doc_id IN (SELECT doc_id FROM labels)")
add("u4_distinct_first", lambda t: W.distinct_first(t.outcomes, ["user_id", "event_type"], "event_id"), "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM outcomes) WHERE r = 1")
add("u4_mark_repeats", lambda t: W.distinct_first(t.outcomes.select("user_id", "event_id"), ["user_id"], "event_id", True), "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS is_repeat FROM outcomes")

# ---- inference -------------------------------------------------------------------------------------------------------

DIFFS = "SELECT a.method, a.fold, a.mae - b.mae AS d, a.n_test, 5000.0D AS n_train FROM foldmae a JOIN foldmae b ON a.fold = b.fold WHERE b.method = 'mean' AND a.method <> 'mean'"
T_SQL = """e AS (SELECT method, avg(d) AS estimate, sqrt((1.0 / count(d) + max(n_test / 5000.0)) * var_samp(d)) AS se, count(d) - 1 AS df, count(*) FILTER (d < 0) AS folds_better, count(d) AS folds FROM d GROUP BY 1),
    t AS (SELECT *, estimate / se AS t, atan(abs(estimate / se) / sqrt(df)) AS th FROM e), p AS (SELECT *, 1 - sin(th) * (1 + pow(cos(th), 2) / 2) AS p FROM t)"""
D_SQL = DIFFS.replace("5000.0D", "5000.0::DOUBLE")
add("st1_corrected_t", lambda t: I.corrected_t(t.sql(DIFFS), ["method"], "d", "n_train", "n_test"), f"WITH d AS ({D_SQL}), {T_SQL} SELECT method, round(estimate, 6) AS estimate, round(se, 6) AS se, df, round(t, 6) AS t, round(p, 6) AS p FROM p")
POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 ELSE 7 END"


def weights_sql(source: str, unit: str, replicates: int, seed: int) -> str:
    return f"(SELECT r AS replicate, {unit}, {POISSON} AS w FROM (SELECT r, {unit}, {uniform_sql(seed, f'''r || ':' || {unit}''')} AS u FROM (SELECT DISTINCT {unit} FROM {source}), range(1, {replicates + 1}) x(r)))"


UNITS = "SELECT grp, stratum, avg(abs(y_true - p_hour) - abs(y_true - p_mean)) AS d, avg(pow(y_true - p_hour, 2)) AS sa, avg(pow(y_true - p_mean, 2)) AS sb FROM wide GROUP BY grp, stratum"
ONE = "SELECT grp, min(stratum) AS stratum, avg(abs(y_true - p_hour) - abs(y_true - p_mean)) AS d, avg(pow(y_true - p_hour, 2)) AS sa, avg(pow(y_true - p_mean, 2)) AS sb FROM wide GROUP BY grp"
add("st2_stratified_bootstrap", lambda t: I.stratified_bootstrap(t.sql(ONE), "grp", "stratum", "d", 200, 11).select("estimate", "low", "high", "p"),
    f"""WITH o AS ({ONE}), w AS {weights_sql('o', 'grp', 200, 11)}, m AS (SELECT replicate, stratum, sum(w * d) / sum(w) AS m FROM o JOIN w USING (grp) WHERE w > 0 GROUP BY ALL), r AS (SELECT replicate, avg(m) AS m FROM m GROUP BY 1)
    SELECT (SELECT round(avg(m), 6) FROM (SELECT avg(d) AS m FROM o GROUP BY stratum)) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0 END))), 6) AS p FROM r""")
add("st2_per_stratum", lambda t: I.stratified_bootstrap(t.sql(ONE), "grp", "stratum", "d", 20, 11).select(F.explode("per_stratum").alias("stratum", "mean")), f"SELECT stratum, round(avg(d), 6) AS mean FROM ({ONE}) GROUP BY 1")
FAMILIES = f"SELECT CASE WHEN grp % 3 = 0 THEN 'external' ELSE 'holdout' END AS regime, grp, CASE WHEN grp % 3 = 0 THEN CAST(grp % 2 AS STRING) ELSE stratum END AS stratum, d FROM ({ONE})"
add("st9_regime_bootstraps", lambda t: I.stratified_bootstrap(t.sql(FAMILIES), "grp", "stratum", "d", 200, 12, ["regime"]).select("regime", "estimate", "low", "high", "p"),
    f"""WITH o AS ({FAMILIES}), w AS {weights_sql('o', 'grp', 200, 12)}, m AS (SELECT regime, replicate, stratum, sum(w * d) / sum(w) AS m FROM o JOIN w USING (grp) WHERE w > 0 GROUP BY ALL), r AS (SELECT regime, replicate, avg(m) AS m FROM m GROUP BY ALL),
    e AS (SELECT regime, avg(m) AS estimate FROM (SELECT regime, stratum, avg(d) AS m FROM o GROUP BY ALL) GROUP BY 1)
    SELECT regime, round(any_value(estimate), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0 END))), 6) AS p FROM r JOIN e USING (regime) GROUP BY 1""")



def group_bootstrap_sql(source: str, by: str, seed: int, replicates: int) -> str:
    keys = f"{by}, " if by else ""
    return f"""WITH s AS (SELECT {keys}method, grp, sum(e) AS s, count(*) AS n FROM ({source}) GROUP BY ALL), w AS {weights_sql('s', 'grp', replicates, seed)},
    a AS (SELECT {keys}method, sum(s) / sum(n) AS m FROM s GROUP BY ALL), r AS (SELECT replicate, {keys}method, sum(w * s) / sum(w * n) AS m FROM s JOIN w USING (grp) WHERE w > 0 GROUP BY ALL),
    rd AS (SELECT {', '.join(f'r.{k.strip()}' for k in by.split(',')) + ', ' if by else ''}r.method, r.m, r.m - b.m AS d FROM r JOIN r b ON r.replicate = b.replicate AND b.method = 'mean' {''.join(f' AND r.{k.strip()} = b.{k.strip()}' for k in by.split(',')) if by else ''}),
    q AS (SELECT {keys}method, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, quantile_cont(d, 0.025) AS diff_low, quantile_cont(d, 0.975) AS diff_high FROM rd GROUP BY ALL)
    SELECT {', '.join(f'a.{k.strip()}' for k in by.split(',')) + ', ' if by else ''}a.method, round(a.m, 6) AS mae, round(low, 6) AS low, round(high, 6) AS high, round(a.m - b.m, 6) AS diff, round(diff_low, 6) AS diff_low, round(diff_high, 6) AS diff_high
    FROM a JOIN q ON a.method = q.method {''.join(f' AND a.{k.strip()} = q.{k.strip()}' for k in by.split(',')) if by else ''} JOIN a b ON b.method = 'mean' {''.join(f' AND a.{k.strip()} = b.{k.strip()}' for k in by.split(',')) if by else ''}"""


with_error = lambda t: t.pred.withColumn("e", F.abs(F.col("y_true") - F.col("y_pred")))
add("st3_group_bootstrap", lambda t: I.group_bootstrap(with_error(t), [], "method", "grp", "e", "mean", 200, 3), group_bootstrap_sql(f"SELECT method, grp, {ERR} AS e FROM pred", "", 3, 200))
PV = "SELECT event_type AS name, CAST(count(*) % 97 AS DOUBLE) / 1000 AS p, avg(value) - 30 AS estimate, event_type < 'm' AS boot FROM events GROUP BY event_type"
HOLM = "least(1.0, max(s) OVER (ORDER BY {p}, name))"
add("st4_holm", lambda t: I.holm(t.sql(PV), [], "name", "p").select("name", "p", "p_holm"), f"WITH v AS ({PV}), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS s FROM v) SELECT name, round(p, 6) AS p, round({HOLM.format(p='p')}, 6) AS p_holm FROM s")
add("st5_confirmatory_table", lambda t: I.confirmatory_table(t.sql(PV), "name", "p", "estimate", "boot", 1000, 0.05, 0.5).select("name", "p_used", "p_holm", "finding"),
    f"WITH v AS (SELECT *, CASE WHEN boot THEN greatest(p, 0.002) ELSE p END AS p_used FROM ({PV})), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_used, name) + 1) * p_used AS s FROM v), h AS (SELECT *, {HOLM.format(p='p_used')} AS p_holm FROM s) SELECT name, round(p_used, 6) AS p_used, round(p_holm, 6) AS p_holm, p_holm < 0.05 AND abs(estimate) >= 0.5 AS finding FROM h")
add("st6_spearman", lambda t: I.spearman(t.wide, ["stratum"], "x", "y_true"),
    "WITH r AS (SELECT stratum, rank() OVER (PARTITION BY stratum ORDER BY x) + (count(*) OVER (PARTITION BY stratum, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY stratum ORDER BY y_true) + (count(*) OVER (PARTITION BY stratum, y_true) - 1) / 2.0 AS b FROM wide) SELECT stratum, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 10")
add("st7_paired_contrasts", lambda t: I.paired_contrasts(t.sql(DIFFS), ["method"], "d", "n_train", "n_test", 1.0),
    f"WITH d AS ({D_SQL}), {T_SQL} SELECT method, round(estimate, 6) AS estimate, round(se, 6) AS se, df, round(t, 6) AS t, round(p, 6) AS p, folds_better, folds, round(estimate - se * 2.776445, 6) AS low, round(estimate + se * 2.776445, 6) AS high, abs(estimate) >= 1 AS large FROM p")
add("st8_min_detectable", lambda t: I.min_detectable(I.corrected_t(t.sql(DIFFS), ["method"], "d", "n_train", "n_test")).select("method", "min_detectable"), f"WITH d AS ({D_SQL}), {T_SQL} SELECT method, round(se * 2.776445, 6) AS min_detectable FROM p")
REG = "SELECT stratum AS regime, fold, method, avg(abs(y_true - y_pred)) AS mae, CAST(count(*) AS DOUBLE) AS n_test, 2000.0D AS n_train FROM pred GROUP BY stratum, fold, method"
add("st9_paired_regime_tests", lambda t: I.paired_regime_tests(t.sql(REG), "regime", "fold", "method", "by_hour", "mean", "mae", "n_train", "n_test"),
    f"WITH m AS ({REG.replace('2000.0D', '2000.0')}), d AS (SELECT a.regime AS method, a.mae - b.mae AS d, a.n_test * 2.5 AS n_test FROM m a JOIN m b ON a.regime = b.regime AND a.fold = b.fold AND a.method = 'by_hour' AND b.method = 'mean'), {T_SQL} SELECT method AS regime, round(estimate, 6) AS estimate, round(se, 6) AS se, df, round(t, 6) AS t, round(p, 6) AS p FROM p")
add("st10_paired_rmse_bootstrap", lambda t: I.paired_rmse_bootstrap(t.sql(ONE), "grp", "sa", "sb", 200, 13),
    f"WITH o AS ({ONE}), w AS {weights_sql('o', 'grp', 200, 13)}, r AS (SELECT sqrt(sum(w * sa) / sum(w)) - sqrt(sum(w * sb) / sum(w)) AS g FROM o JOIN w USING (grp) WHERE w > 0 GROUP BY replicate) SELECT (SELECT round(sqrt(avg(sa)) - sqrt(avg(sb)), 6) FROM o) AS change, round(quantile_cont(g, 0.025), 6) AS low, round(quantile_cont(g, 0.975), 6) AS high FROM r")
add("st11_sliced_errors", lambda t: I.sliced_errors(with_error(t).withColumn("late", F.col("x") >= 12), ["stratum", "late"], "method", "grp", "e", "mean", 50, 5),
    group_bootstrap_sql(f"SELECT method, grp, {ERR} AS e, 'stratum' AS attribute, stratum AS value FROM pred UNION ALL SELECT method, grp, {ERR}, 'late', CASE WHEN x >= 12 THEN 'true' ELSE 'false' END FROM pred", "attribute, value", 5, 50))

LATE = "CASE WHEN x >= 12 THEN 'true' ELSE 'false' END"
add("st11_sliced_pairs", lambda t: I.sliced_errors(with_error(t).withColumn("late", F.col("x") >= 12), ["stratum", "late"], "method", "grp", "e", "mean", 50, 5, [("stratum", "late")]),
    group_bootstrap_sql(f"SELECT method, grp, {ERR} AS e, 'stratum' AS attribute, stratum AS value FROM pred UNION ALL SELECT method, grp, {ERR}, 'late', {LATE} FROM pred UNION ALL SELECT method, grp, {ERR}, 'stratum x late', stratum || ' x ' || {LATE} FROM pred", "attribute, value", 5, 50))

# ---- intervals -------------------------------------------------------------------------------------------------------

WIDTH = "list_sort(list(abs(y_true - {p})))[CAST(ceil(0.9 * (count(*) + 1) - 1e-9) AS INT)]"
cal = lambda t: t.wide.withColumns({"residual": F.col("y_true") - F.col("p_mean"), "scale": F.col("x") + 1})
add("c1_split_width", lambda t: C.split_width(cal(t), ["stratum"], "residual", 0.1), f"SELECT stratum, round({WIDTH.format(p='p_mean')}, 6) AS width, count(*) AS n FROM wide GROUP BY 1")
NORM = "b AS (SELECT stratum, median(x + 1) AS b FROM wide GROUP BY 1), r AS (SELECT stratum, any_value(b) AS b, list_sort(list(abs(y_true - p_mean) / (x + 1 + b)))[CAST(ceil(0.9 * (count(*) + 1) - 1e-9) AS INT)] AS r FROM wide JOIN b USING (stratum) GROUP BY 1)"
add("c2_normalised_width", lambda t: C.normalised_width(cal(t), cal(t), ["stratum"], "residual", "scale", 0.1).select("key", "width"), f"WITH {NORM} SELECT key, round(r * (x + 1 + b), 6) AS width FROM wide JOIN r USING (stratum)")
CENTRES = "SELECT p_partkey AS key, k.fold, p_retailprice / 50 + k.fold AS y_pred, p_brand AS stratum FROM part CROSS JOIN (SELECT DISTINCT fold FROM ev) k"
RESID = "SELECT CAST(s_nationkey % 5 AS INT) AS fold, s_acctbal / 1000 AS residual, CASE WHEN s_nationkey % 2 = 0 THEN 'Brand#11' ELSE 'Brand#12' END AS stratum FROM supplier"
CVP = "SELECT key, {g} list_sort(list(y_pred - abs(residual))) AS l, list_sort(list(y_pred + abs(residual))) AS h, count(*) AS n FROM c JOIN r ON c.fold = r.fold {j} GROUP BY ALL"
BOUNDS = "CASE WHEN floor(0.1 * (n + 1) + 1e-9) >= 1 THEN l[CAST(floor(0.1 * (n + 1) + 1e-9) AS INT)] ELSE '-inf'::DOUBLE END AS lower, CASE WHEN ceil(0.9 * (n + 1) - 1e-9) <= n THEN h[CAST(ceil(0.9 * (n + 1) - 1e-9) AS INT)] ELSE 'inf'::DOUBLE END AS upper"
add("c3_cv_plus", lambda t: C.cv_plus(t.sql(CENTRES), t.sql(RESID), "fold", ["key"], 0.1), f"WITH c AS ({CENTRES}), r AS ({RESID}), m AS ({CVP.format(g='', j='')}) SELECT key, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (SELECT key, {BOUNDS} FROM m)")
add("c4_mondrian_cv_plus", lambda t: C.mondrian_cv_plus(t.sql(CENTRES), t.sql(RESID), "fold", ["key"], "stratum", 0.1),
    f"""WITH c AS ({CENTRES}), r AS ({RESID}), m AS ({CVP.format(g='', j='')}), o AS ({CVP.format(g='c.stratum,', j='AND c.stratum = r.stratum')}), p AS (SELECT key, {BOUNDS} FROM m), q AS (SELECT key, {BOUNDS} FROM o)
    SELECT p.key, round(CASE WHEN isfinite(q.lower) AND isfinite(q.upper) THEN q.lower ELSE p.lower END, 6) AS lower, round(CASE WHEN isfinite(q.lower) AND isfinite(q.upper) THEN q.upper ELSE p.upper END, 6) AS upper FROM p LEFT JOIN q USING (key)""")
add("c5_coverage", lambda t: C.coverage(t.pred.withColumns({"lower": F.col("y_pred") - 50, "upper": F.col("y_pred") + 50}), ["method"]), "SELECT method, round(avg(CASE WHEN y_true BETWEEN y_pred - 50 AND y_pred + 50 THEN 1.0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM pred GROUP BY 1")
add("c6_member_sd", lambda t: C.member_sd(t.pred, ["key"], "y_pred"), "SELECT key, round(avg(y_pred), 6) AS y_pred, round(stddev_samp(y_pred), 6) AS uncertainty FROM pred GROUP BY 1")
add("c7_interval_table", lambda t: C.interval_table(cal(t), cal(t).withColumn("y_pred", F.col("p_mean")), ["stratum"], "scale", 0.1).select("key", "variant", "lower", "upper"),
    f"WITH {NORM}, s AS (SELECT stratum, {WIDTH.format(p='p_mean')} AS w FROM wide GROUP BY 1) SELECT key, 'plain' AS variant, round(p_mean - w, 6) AS lower, round(p_mean + w, 6) AS upper FROM wide JOIN s USING (stratum) UNION ALL SELECT key, 'normalised', round(p_mean - r * (x + 1 + b), 6), round(p_mean + r * (x + 1 + b), 6) FROM wide JOIN r USING (stratum)")

MEMBERS = "SELECT stratum, key, method, y_true, y_pred FROM pred"
COVER = "list_sort(list({e}))[CAST(ceil(0.9 * (count(*) + 1) - 1e-9) AS INT)]"
add("c7_member_intervals", lambda t: C.member_intervals(t.sql(MEMBERS + " WHERE fold <> 0"), t.sql(MEMBERS + " WHERE fold = 0"), ["stratum"], "key", "method", "mean", 0.1),
    f"""WITH e AS (SELECT stratum, key, fold, max(y_true) AS y, avg(y_pred) AS m, stddev_samp(y_pred) AS s, max(CASE WHEN method = 'mean' THEN y_pred END) AS f FROM pred GROUP BY ALL), c AS (SELECT * FROM e WHERE fold <> 0), b AS (SELECT stratum, median(s) AS b FROM c GROUP BY 1),
    w AS (SELECT stratum, any_value(b) AS b, {COVER.format(e="abs(y - m)")} AS w, {COVER.format(e="abs(y - m) / (s + b)")} AS r, {COVER.format(e="abs(y - f)")} AS v FROM c JOIN b USING (stratum) GROUP BY 1)
    SELECT stratum, key, method, variant, round(y_pred, 6) AS y_pred, round(u, 6) AS uncertainty, round(y_pred - h, 6) AS lower, round(y_pred + h, 6) AS upper FROM (
      SELECT stratum, key, 'ensemble' AS method, 'plain' AS variant, m AS y_pred, s AS u, w AS h FROM e JOIN w USING (stratum) WHERE fold = 0 UNION ALL SELECT stratum, key, 'ensemble', 'normalised', m, s, r * (s + b) FROM e JOIN w USING (stratum) WHERE fold = 0
      UNION ALL SELECT stratum, key, 'first', 'plain', f, NULL, v FROM e JOIN w USING (stratum) WHERE fold = 0)""")

# ---- audit -----------------------------------------------------------------------------------------------------------

add("l1_formula_labels", lambda t: L.formula_labels(t.parts, "p_retailprice", F.when(F.col("p_size") > 5, F.lit(900.0) + (F.col("p_partkey") % 1000) / 10)).select("p_partkey", "is_formula"), "SELECT p_partkey, p_size > 5 AND abs(p_retailprice - (900 + (p_partkey % 1000) / 10)) <= 0.005 AS is_formula FROM parts")
add("l2_consistent_disagreement", lambda t: L.consistent_disagreement(t.pred, "key", 60.0), "SELECT key, round(avg(y_true - y_pred), 6) AS mean_residual, round(min(abs(y_true - y_pred)), 6) AS smallest_miss, count(*) AS n FROM pred GROUP BY 1 HAVING min(abs(y_true - y_pred)) > 60 AND (min(y_true - y_pred) > 0 OR max(y_true - y_pred) < 0)")
add("l3_below_reference", lambda t: L.below_reference(t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal"), t.sql("SELECT n_nationkey AS k, n_nationkey * 100.0D AS ref FROM nation WHERE n_nationkey < 20"), "k", "c_acctbal", "ref", 1500.0), "SELECT c_custkey, c_nationkey AS k, round(c_acctbal, 6) AS c_acctbal, CAST(c_nationkey * 100 AS DOUBLE) AS ref FROM customer WHERE c_nationkey < 20 AND c_acctbal < c_nationkey * 100 - 1500")
GROUPS = "SELECT concat(p_brand, ':', CAST(p_size AS STRING)) AS g, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey - 1 END AS twin, p_retailprice AS y FROM part"
add("l4_group_conflicts", lambda t: L.group_conflicts(t.sql(GROUPS), "g", "k", "twin", "y", 20.0).select("k", "others_median", "others_spread", "twin_label", "exclude"),
    f"""WITH g AS ({GROUPS}), s AS (SELECT g FROM g GROUP BY g HAVING max(y) - min(y) > 20), a AS (SELECT g.* FROM g JOIN s USING (g)),
    o AS (SELECT a.g, a.k, a.twin, a.y, count(b.k) + 1 AS n, median(b.y) AS m, max(b.y) - min(b.y) AS sp FROM a LEFT JOIN a b ON a.g = b.g AND a.k <> b.k GROUP BY ALL)
    SELECT o.k, round(m, 6) AS others_median, round(sp, 6) AS others_spread, round(t.y, 6) AS twin_label, coalesce(n >= 3 AND abs(o.y - m) > 20 AND sp <= 20 AND coalesce(abs(o.y - t.y) > 20, true), false) AS exclude FROM o LEFT JOIN a t ON t.g = o.g AND t.k = o.twin""")
LOOK = "SELECT n_nationkey AS c_nationkey, CASE WHEN n_regionkey = 0 THEN 'none' ELSE CAST(n_nationkey * 300 AS STRING) END AS v FROM nation"
add("l5_external_check", lambda t: L.external_check(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), t.sql(LOOK), "c_nationkey", "c_acctbal", "v", 2000.0).select("c_custkey", "verdict", "exclude"),
    f"WITH l AS ({LOOK}), x AS (SELECT c_custkey, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 'unverified' WHEN abs(c_acctbal - try_cast(v AS DOUBLE)) > 2000 THEN 'contradicted' ELSE 'agrees' END AS verdict FROM customer LEFT JOIN l USING (c_nationkey)) SELECT c_custkey, verdict, verdict = 'contradicted' AS exclude FROM x")
CHECKS = ["SELECT user_id AS k, event_id AS o, 'large' AS category, event_type AS evidence, value > 150 AS exclude FROM events WHERE value > 100", "SELECT user_id AS k, event_id AS o, 'small' AS category, event_type AS evidence, false AS exclude FROM events WHERE value < 1"]


def audit_table(t):
    named = [t.sql(c).select("k", F.col("o").alias("order"), "category", "evidence", "exclude") for c in CHECKS]
    late = t.sql("SELECT user_id AS k, event_id AS o, 'odd' AS category, event_type AS evidence, true AS exclude FROM events WHERE value BETWEEN 2 AND 2.2").select("k", F.col("o").alias("order"), "category", "evidence", "exclude")
    return L.build_audit(named, "k", lambda gone: late.join(gone, "k", "left_anti"))


AUDIT = f"""e AS ({CHECKS[0]} UNION ALL {CHECKS[1]}), x AS (SELECT DISTINCT k FROM e WHERE exclude), a AS (SELECT * FROM e UNION ALL SELECT user_id, event_id, 'odd', event_type, true FROM events WHERE value BETWEEN 2 AND 2.2 AND user_id NOT IN (SELECT k FROM x))"""
JOINED = "(SELECT string_agg(v, '; ' ORDER BY f, v) FROM (SELECT {c} AS v, min(o) AS f FROM a b WHERE b.k = a.k GROUP BY 1))"
add("l6_build_audit", audit_table, f"WITH {AUDIT} SELECT k, bool_or(exclude) AS exclude, {JOINED.format(c='category')} AS category, {JOINED.format(c='evidence')} AS evidence FROM a GROUP BY k")
NOTES = "SELECT user_id AS k, concat('seen ', event_type) AS note FROM events WHERE value > 100 AND event_id % 2 = 0"


def noted_audit(t):
    named = [t.sql(c).select("k", F.col("o").alias("order"), "category", "evidence", "exclude") for c in CHECKS]
    return L.build_audit(named, "k", notes=t.sql(NOTES))


add("l6_audit_notes", noted_audit,
    f"""WITH a AS ({CHECKS[0]} UNION ALL {CHECKS[1]}), n AS (SELECT k, string_agg(DISTINCT note, '; ' ORDER BY note) AS note FROM ({NOTES}) GROUP BY 1)
    SELECT k, exclude, category, concat_ws('; ', evidence, note) AS evidence FROM (SELECT k, bool_or(exclude) AS exclude, {JOINED.format(c='category')} AS category, {JOINED.format(c='evidence')} AS evidence FROM a GROUP BY k) LEFT JOIN n USING (k)""")
add("l7_fixed_exclusions", lambda t: L.apply_audit(t.customer.select("c_custkey", "c_acctbal"), t.sql("SELECT o_custkey AS c_custkey, max(o_totalprice) > 450000 AS exclude FROM orders GROUP BY o_custkey"), "c_custkey", fixed=[1, 2, 3]),
    "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_custkey NOT IN (1, 2, 3) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
add("l8_external_columns", lambda t: L.external_set(t.sql("SELECT p_name AS k, p_partkey AS o, p_size, p_brand FROM part"), t.sql("SELECT p_name AS k FROM part WHERE p_size = 3"), "k", "o", [], F.when(F.col("p_size") > 25, "large").otherwise("small"), "p_size").select("o", "exclude_reason", "subgroup", "single_measurement"),
    """SELECT p_partkey AS o, CASE WHEN known THEN 'in training' WHEN r > 1 THEN 'duplicate' ELSE '' END AS exclude_reason, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS subgroup, p_size = 1 AS single_measurement
    FROM (SELECT *, p_name IN (SELECT p_name FROM part WHERE p_size = 3) AS known, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
add("l7_apply_audit", lambda t: L.apply_audit(t.outcomes, audit_table(t).withColumnRenamed("k", "user_id"), "user_id").select("user_id", "event_id"), f"WITH {AUDIT} SELECT user_id, event_id FROM outcomes WHERE user_id NOT IN (SELECT k FROM a WHERE exclude)")
add("l8_external_set", lambda t: L.external_set(t.sql("SELECT p_name AS k, p_partkey AS o, p_size FROM part"), t.sql("SELECT p_name AS k FROM part WHERE p_size = 3"), "k", "o", [("large", F.col("p_size") > 40), ("odd", F.col("p_size") % 2 == 1)]).select("o", "exclude", "exclude_reason"),
    """WITH x AS (SELECT p_partkey AS o, p_size, p_name IN (SELECT p_name FROM part WHERE p_size = 3) AS known, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part), y AS (SELECT o, array_to_string(list_filter([CASE WHEN known THEN 'in training' END, CASE WHEN NOT known AND r > 1 THEN 'duplicate' END, CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_size % 2 = 1 THEN 'odd' END], lambda v: v IS NOT NULL), '; ') AS s FROM x)
    SELECT o, s <> '' AS exclude, s AS exclude_reason FROM y""")
add("l9_upper_middle", lambda t: L.aggregate_measurements(t.ev, "grp", "y_true"), "SELECT grp, round(list_sort(list(y_true))[count(*) // 2 + 1], 6) AS label, count(*) AS n FROM ev GROUP BY 1")
add("l9_interpolated", lambda t: L.aggregate_measurements(t.ev, "grp", "y_true", "interpolated"), "SELECT grp, round(median(y_true), 6) AS label, count(y_true) AS n FROM ev GROUP BY 1")
