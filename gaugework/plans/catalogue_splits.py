"""Queries of splits, samples and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as Q
from ..operators import splits as K
from .catalogue import add, uniform_sql
from .catalogue_metrics import POISSON

ROW = "row_number() OVER (PARTITION BY {p} ORDER BY md5('{s}:' || {k}))"

add("k1_random_split", lambda t: K.random_split(t.ev.select("key"), "key", [("train", 0.6), ("stop", 0.2), ("test", 0.2)], 4), f"SELECT key, CASE WHEN {uniform_sql(4, 'key')} < 0.6 THEN 'train' WHEN {uniform_sql(4, 'key')} < 0.8 THEN 'stop' ELSE 'test' END AS part FROM ev")
add("k2_stratified_kfold", lambda t: K.stratified_kfold(t.ev.select("key", "stratum"), "key", "stratum", 5, 3, 9), f"SELECT key, stratum, CAST(r AS INT) AS repeat, CAST(({ROW.format(p='r, stratum', s=9, k=chr(114) + ' || ' + chr(39) + ':' + chr(39) + ' || key')} - 1) % 5 AS INT) AS fold FROM ev, range(3) x(r)")
GROUPS = """s AS (SELECT grp, stratum, count(*) AS n FROM ev GROUP BY ALL), o AS (SELECT grp, sum(n) AS size, arg_min(stratum, (-n, stratum)) AS st FROM s GROUP BY 1)"""
FOLDS = f"""{GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY size DESC, md5('2:' || grp)) - 1 AS r FROM o), f AS (SELECT grp, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold FROM r)"""
add("k3_stratified_group_kfold", lambda t: K.stratified_group_kfold(t.ev.drop("fold"), "stratum", "grp", 5, 2).select("key", "fold"), f"WITH {FOLDS} SELECT key, f.fold FROM ev JOIN f USING (grp)")
add("k3_repeated_group_kfold", lambda t: K.stratified_group_kfold(t.ev.drop("fold"), "stratum", "grp", 5, 2, repeats=3).select("key", "repeat", "fold"),
    f"""WITH {GROUPS}, r AS (SELECT *, CAST(d AS INT) AS repeat, row_number() OVER (PARTITION BY d, st ORDER BY size DESC, md5((2 + d) || ':' || grp)) - 1 AS r FROM o, range(3) x(d))
    SELECT key, repeat, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold FROM ev JOIN r USING (grp)""")
add("k4_leave_group_out", lambda t: K.leave_group_out(t.ev.select("key", "stratum"), "stratum", ["click", "view"]).select("key", "task", "role"), "SELECT key, v AS task, CASE WHEN stratum = v THEN 'test' ELSE 'train' END AS role FROM ev, (VALUES ('click'), ('view')) x(v)")
QUOTA = """q AS (SELECT {s} AS st, n * {n}::DOUBLE / sum(n) OVER () AS share FROM c), q2 AS (SELECT st, floor(share) AS f, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, st) AS o FROM q), quota AS (SELECT st, CAST(f + CASE WHEN o <= {n} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q2)"""
add("k5_quotas", lambda t: K.proportional_quotas(t.ev.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "stratum", "n", 1000), "WITH c AS (SELECT stratum, count(*) AS n FROM ev GROUP BY 1), " + QUOTA.format(s="stratum", n=1000) + " SELECT st AS stratum, quota FROM quota")


def nested_sql(sizes: list[int], seed: int) -> str:
    parts = []
    for n in sizes:
        parts.append(f"(WITH {QUOTA.format(s='stratum', n=n)} SELECT {n} AS size, st, quota FROM quota)")
    return f"""WITH c AS (SELECT stratum, count(*) AS n FROM ev GROUP BY 1), qs AS ({' UNION ALL '.join(f'SELECT * FROM {p}' for p in parts)}),
    g AS (SELECT stratum, grp, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT stratum, grp, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY md5('{seed}:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
    e AS (SELECT grp, CAST(min(size) AS INT) AS entry FROM b JOIN qs ON st = stratum AND b < quota GROUP BY 1)"""


add("k6_nested_subsets", lambda t: K.nested_subsets(t.ev, "key", "stratum", "grp", [100, 500, 2000], 6), nested_sql([100, 500, 2000], 6) + " SELECT key, entry FROM ev LEFT JOIN e USING (grp)")
add("k7_learning_curve_tasks", lambda t: K.learning_curve_tasks(K.nested_subsets(t.ev, "key", "stratum", "grp", [100, 500], 6).filter("entry is not null"), "entry", [100, 500]).select("key", "size"), nested_sql([100, 500], 6) + " SELECT key, CAST(s AS INT) AS size FROM ev JOIN e USING (grp), (VALUES (100), (500)) v(s) WHERE entry <= s")
CURVE = """c AS (SELECT test_fold, draw, stratum, count(*) AS n FROM tr GROUP BY ALL), g AS (SELECT test_fold, draw, stratum, grp, count(*) AS n FROM tr GROUP BY ALL),
    q AS (SELECT *, n * size::DOUBLE / sum(n) OVER w AS share FROM c, (VALUES (100), (500), (2000)) v(size) WINDOW w AS (PARTITION BY test_fold, draw, size)),
    q2 AS (SELECT *, row_number() OVER (PARTITION BY test_fold, draw, size ORDER BY round(share - floor(share), 9) DESC, stratum) AS o, size - sum(floor(share)) OVER (PARTITION BY test_fold, draw, size) AS short FROM q),
    quota AS (SELECT test_fold, draw, stratum, size, floor(share) + CASE WHEN o <= short THEN 1 ELSE 0 END AS quota FROM q2),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY test_fold, draw, stratum ORDER BY md5('6:' || test_fold || ':' || draw || ':' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
    e AS (SELECT test_fold, draw, grp, min(size) AS entry FROM b JOIN quota USING (test_fold, draw, stratum) WHERE before < quota GROUP BY ALL)"""
add("k7_fold_curve_tasks", lambda t: K.fold_curve_tasks(t.ev, "key", "fold", 5, "stratum", "grp", [100, 500, 2000], 2, 6),
    f"""WITH tr AS (SELECT key, grp, stratum, CAST(f AS INT) AS test_fold, CAST(d AS INT) AS draw FROM ev, range(5) x(f), range(2) y(d) WHERE fold <> f), {CURVE}
    SELECT test_fold, draw, s AS size, key, 'train' AS role FROM tr JOIN e USING (test_fold, draw, grp), (VALUES (100), (500), (2000)) v(s) WHERE entry <= s
    UNION ALL SELECT fold, CAST(d AS INT), s, key, 'test' FROM ev, range(2) y(d), (VALUES (100), (500), (2000)) v(s)""")
TAKEN = """SELECT b.*, b.before < quota AS taken FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY st ORDER BY md5('{seed}:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {t}) b
    JOIN (SELECT st, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, st) <= total - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT st, total, n * total / sum(n) OVER () AS share FROM (SELECT st, sum(size) AS n, (SELECT {total} FROM {t}) AS total FROM {t} GROUP BY 1))) USING (st)"""
add("k8_fit_stop_calibrate", lambda t: K.fit_stop_calibrate(t.ev, "stratum", "grp", 0.15, 8).select("key", "part"),
    f"""WITH {GROUPS}, a AS ({TAKEN.format(seed=8, t="o", total="round_even(sum(size) * 0.15, 0)")}), h AS (SELECT grp, size, st FROM a WHERE taken), z AS ({TAKEN.format(seed=9, t="h", total="floor(sum(size) / 2)")})
    SELECT key, CASE WHEN taken THEN 'stop' WHEN taken IS NULL THEN 'fit' ELSE 'calibrate' END AS part FROM ev LEFT JOIN z USING (grp)""")
add("k9_stratified_sample", lambda t: K.stratified_sample(t.ev.select("key", "stratum"), "key", "stratum", 500, 7), "WITH c AS (SELECT stratum, count(*) AS n FROM ev GROUP BY 1), " + QUOTA.format(s="stratum", n=500) + f", r AS (SELECT key, stratum, {ROW.format(p='stratum', s=7, k='key')} AS r FROM ev) SELECT key, stratum FROM r JOIN quota ON st = stratum WHERE r <= quota")


def tasks(t):
    named = K.leave_group_out(t.ev.select("key", "stratum", "grp"), "stratum", ["click"]).withColumn("regime", F.lit("holdout"))
    return named.unionByName(t.ev.select("key", "stratum", "grp", F.lit("r0").alias("task"), F.when(F.col("fold") == 0, "test").otherwise("train").alias("role"), F.lit("familiar").alias("regime")))


add("k10_inner_folds", lambda t: K.inner_folds(tasks(t), "task", "regime", "stratum", "grp", 3, 1).select("key", "task", "inner_fold"),
    f"""WITH tr AS (SELECT key, grp, stratum FROM ev WHERE fold <> 0), {GROUPS.replace("FROM ev", "FROM tr")}, r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY size DESC, md5('1:' || grp)) - 1 AS r FROM o)
    SELECT key, 'r0' AS task, CAST(CASE WHEN (r // 3) % 2 = 0 THEN r % 3 ELSE 2 - r % 3 END AS VARCHAR) AS inner_fold FROM tr JOIN r USING (grp)
    UNION ALL SELECT key, 'click', stratum FROM ev WHERE stratum <> 'click'""")
add("k11_external_task", lambda t: K.external_task(t.ev.filter("fold = 1").select("key"), t.ev.filter("fold = 2").select("key")), "SELECT key, CASE fold WHEN 1 THEN 'train' ELSE 'test' END AS role FROM ev WHERE fold IN (1, 2)")
add("k12_familiar_tasks", lambda t: K.familiar_tasks(t.ev.withColumn("other", (F.col("fold") + 1) % 5), "key", ["fold", "other"], 5),
    "SELECT key, CAST(r AS INT) AS repeat, CAST(k AS INT) AS fold, CASE WHEN (ev.fold + r) % 5 = k THEN 'test' ELSE 'train' END AS role FROM ev, range(2) a(r), range(5) b(k)")
add("k13_half_splits", lambda t: K.half_splits(t.ev.select("key"), "key", [1, 2]), "SELECT key, CAST(s AS INT) AS seed, CAST(h AS INT) AS half, CASE WHEN (md5(s || ':' || key) < '8') = (h = 0) THEN 'add' ELSE 'test' END AS role FROM ev, (VALUES (1), (2)) a(s), (VALUES (0), (1)) b(h)")
add("k14_bootstrap_weights", lambda t: K.bootstrap_weights(t.ev.select("grp").distinct(), "grp", 20, 3), f"SELECT grp, CAST(r AS INT) AS replicate, CAST(w AS BIGINT) AS weight FROM (SELECT grp, r, {POISSON} AS w FROM (SELECT grp, r, {uniform_sql(3, chr(114) + ' || ' + chr(39) + ':' + chr(39) + ' || grp')} AS u FROM (SELECT DISTINCT grp FROM ev), range(1, 21) x(r))) WHERE w > 0")
add("k15_stratified_split", lambda t: K.stratified_split(t.ev.select("key", "stratum"), "key", "stratum", 0.2, 5), f"SELECT key, stratum, CASE WHEN {ROW.format(p='stratum', s=5, k='key')} <= floor(count(*) OVER (PARTITION BY stratum) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM ev")

# ---- selection -------------------------------------------------------------------------------------------------------

SCORES = "SELECT o_orderkey AS key, o_totalprice / 1000 AS mean, CAST(o_custkey % 50 AS DOUBLE) + 1 AS spread, CAST(o_orderkey % 7 AS DOUBLE) / 7 AS p, o_orderstatus = 'F' AS flag FROM orders"
add("q1_top_uncertain", lambda t: Q.top_uncertain(t.sql(SCORES), "spread", "key", 40).select("key", "spread"), f"SELECT key, round(spread, 6) AS spread FROM ({SCORES}) ORDER BY spread DESC, key LIMIT 40")
add("q2_top_useful", lambda t: Q.top_useful(t.sql(SCORES), "spread", "p", "key", 40).select("key", "usefulness"), f"SELECT key, round(spread * p, 6) AS usefulness FROM ({SCORES}) ORDER BY spread * p DESC, key LIMIT 40")
add("q3_random_batch", lambda t: Q.random_batch(t.sql(SCORES), "key", 40, 3).select("key"), f"SELECT key FROM ({SCORES}) ORDER BY md5('3:' || key) LIMIT 40")
add("q4_region_first_batch", lambda t: Q.region_first_batch(t.sql(SCORES), "key", "flag", 40, 3).select("key"), f"SELECT key FROM ({SCORES}) ORDER BY flag DESC, md5('3:' || key) LIMIT 40")
add("q5_closest_to_target", lambda t: Q.closest_to_target(t.sql(SCORES), "mean", 125.0, "key", 40).select("key", "mean"), f"SELECT key, round(mean, 6) AS mean FROM ({SCORES}) ORDER BY abs(mean - 125.0), key LIMIT 40")
CDF = "(CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END)"


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2))))"
    tail = f"(0.5 * ((((((1.061405429 * {t}) - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}) * exp(-pow({z} / sqrt(2), 2)))"
    return CDF.format(z=z, t=tail)


add("q6_prob_in_window", lambda t: t.sql(SCORES).select("key", Q.prob_in_window(F.col("mean"), F.col("spread"), 100.0, 150.0).alias("p")), f"SELECT key, round({cdf_sql('((150.0 - mean) / spread)')} - {cdf_sql('((100.0 - mean) / spread)')}, 6) AS p FROM ({SCORES})")
FIT, CANDIDATES = "SELECT key, x / 24 AS a, fold / 5.0D AS b, y_true FROM ev WHERE fold > 2", "SELECT key, x / 24 AS a, fold / 5.0D AS b FROM ev WHERE fold <= 2"
add("q7_diverse_uncertain_batch", lambda t: Q.diverse_batch(t.sql(FIT), t.sql(CANDIDATES), "key", ["a", "b"], "y_true", 4))
add("q8_diverse_in_window_batch", lambda t: Q.diverse_batch(t.sql(FIT), t.sql(CANDIDATES), "key", ["a", "b"], "y_true", 4, 100.0, (20.0, 40.0)))
REPORT = "SELECT stratum, key, abs(y_true - p_mean) AS e, p_hour AS own, x AS other, abs(x - 12) AS distance, x >= 12 AS flag FROM wide"
RHO = "(SELECT stratum, corr(a, b) AS rho FROM (SELECT stratum, rank() OVER (PARTITION BY stratum ORDER BY {c}) + (count(*) OVER (PARTITION BY stratum, {c}) - 1) / 2.0 AS a, rank() OVER (PARTITION BY stratum ORDER BY e) + (count(*) OVER (PARTITION BY stratum, e) - 1) / 2.0 AS b FROM w) GROUP BY 1)"
add("q9_uncertainty_report", lambda t: Q.uncertainty_report(t.sql(REPORT), "stratum", "own", "other", "distance", "e", "flag", "key"),
    f"""WITH w AS ({REPORT}), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY own DESC, key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM w)
    SELECT r.stratum, round(avg(own) FILTER (flag) / avg(own) FILTER (NOT flag), 6) AS flagged_ratio, round(avg(e) FILTER (r <= greatest(1, n // 10)) / avg(e), 6) AS top_ratio, round(any_value(a.rho), 6) AS rho_own, round(any_value(b.rho), 6) AS rho_other, round(any_value(c.rho), 6) AS rho_distance
    FROM r JOIN {RHO.format(c='own')} a ON a.stratum = r.stratum JOIN {RHO.format(c='other')} b ON b.stratum = r.stratum JOIN {RHO.format(c='distance')} c ON c.stratum = r.stratum GROUP BY 1""")
add("q10_next_round", lambda t: Q.next_round(t.sql(SCORES).select("key", "spread"), t.campaign.filter("hit"), "key", "spread", 50, 3, t.campaign.filter("distance < 60000").select("key")).select("key", "round", "rank_in_round", "source"),
    f"WITH p AS (SELECT key, spread FROM ({SCORES}) WHERE key NOT IN (SELECT key FROM campaign WHERE hit) ORDER BY spread DESC, key LIMIT 50) SELECT key, CAST(3 AS INT) AS round, CAST(row_number() OVER (ORDER BY spread DESC, key) AS INT) AS rank_in_round, CASE WHEN key IN (SELECT key FROM campaign WHERE distance < 60000) THEN 'cache' ELSE 'new' END AS source FROM p")
add("q11_campaign_account", lambda t: Q.campaign_account(t.campaign.select("strategy", "seed", "key", "price", "ord"), ["strategy", "seed"], ["ord", "key"], "price", 100000.0, 150000.0).select("key", "in_spec", "hits"), "SELECT key, hit AS in_spec, CAST(hits AS BIGINT) AS hits FROM steps")
