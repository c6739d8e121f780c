"""Queries of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import conformal as C
from ..operators import extend as X
from ..operators import models as M
from ..operators import splits as K
from .catalogue import add, uniform_sql
from .catalogue_metrics import BOUNDS, CVP, POISSON, weights_sql
from .catalogue_splits import CURVE

SUMS = "count(*) AS n, sum(x) AS sx, sum(y_true) AS sy, sum(x * x) AS sxx, sum(x * y_true) AS sxy"
LESS = ", ".join(f"t.{c} - f.{c} AS {c}" for c in ("n", "sx", "sy", "sxx", "sxy"))
LINE = "CASE WHEN sxx / n - pow(sx / n, 2) > 1e-12 THEN (sxy / n - sx / n * sy / n) / ((sxx / n - pow(sx / n, 2)) * (1 + {a} / n)) ELSE 0 END"


def cv_line_sql(alpha: float = 0.0, source: str = "ev") -> str:
    return f"""f AS (SELECT fold, {SUMS} FROM {source} GROUP BY 1), t AS (SELECT {SUMS} FROM {source}), l AS (SELECT fold, {LESS} FROM f, t),
    m AS (SELECT fold, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=alpha)} AS b FROM l)), oof AS (SELECT key, grp, stratum, {source}.fold, y_true, x, a + b * x AS y_pred FROM {source} JOIN m USING (fold))"""


add("m1_ridge_one_feature", lambda t: M.cross_validated_line(t.ev, [], "fold", "x", "y_true", 10.0).select("key", "y_pred"), f"WITH {cv_line_sql(10.0)} SELECT key, round(y_pred, 6) AS y_pred FROM oof")
add("m1_ridge_cv", lambda t: M.ridge_cv(t.ev.withColumn("x2", F.col("x") * F.col("x")), ["x", "x2"], "y_true", "fold", [0.1, 10.0, 1000.0])[0].select("key", "y_pred"))
add("m1_ridge_refit", lambda t: M.ridge_refit(t.ev.filter("fold <> 0"), t.ev.filter("fold = 0"), ["x"], "y_true", "fold", [10.0]).select("key", "y_pred"),
    f"WITH m AS (SELECT b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=10.0)} AS b FROM (SELECT {SUMS} FROM ev WHERE fold <> 0))) SELECT key, round(a + b * x, 6) AS y_pred FROM ev, m WHERE fold = 0")
SMALL = "SELECT key, fold, x, CAST(grp % 11 AS DOUBLE) AS g, y_true FROM ev"
add("m2_boosted_trees", lambda t: M.tree_predict(t.sql(SMALL).filter("fold <> 0"), t.sql(SMALL).filter("fold = 0"), ["x", "g"], "y_true", "boosted", maxIter=4, maxDepth=3)[0].agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")))
add("m3_random_forest", lambda t: M.tree_predict(t.sql(SMALL).filter("fold <> 0"), t.sql(SMALL).filter("fold = 0"), ["x", "g"], "y_true", "forest", numTrees=5, maxDepth=3)[0].agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")))
TREES = [{"maxDepth": 2, "numTrees": 2}, {"maxDepth": 4, "numTrees": 2}, {"maxDepth": 3, "numTrees": 5}]
add("m4_nested_cv", lambda t: M.nested_cv(t.sql(SMALL), ["x", "g"], "y_true", "fold", TREES, "forest").withColumnRenamed("fold", "outer_fold").groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")))
add("m5_average_ensemble", lambda t: A.ensemble_mean(t.pred, ["key"]), "SELECT key, round(avg(y_pred), 6) AS y_pred FROM pred GROUP BY 1")
add("m6_segment_models", lambda t: M.segment_models(t.ev, "stratum", "fold", "x", "y_true", 1500).select("key", "y_pred"),
    f"WITH f AS (SELECT stratum, fold, {SUMS} FROM ev GROUP BY ALL), t AS (SELECT stratum, {SUMS} FROM ev GROUP BY 1), l AS (SELECT f.stratum, fold, {LESS} FROM f JOIN t USING (stratum)), m AS (SELECT stratum, fold, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM l WHERE n >= 1500)) SELECT key, round(a + b * x, 6) AS y_pred FROM ev JOIN m USING (stratum, fold)")
add("m7_out_of_fold", lambda t: M.out_of_fold(t.ev, t.ev.drop("fold"), "fold", "x", "y_true")[0].select("key", "residual"), f"WITH {cv_line_sql()} SELECT key, round(y_true - y_pred, 6) AS residual FROM oof")
TASK = f"tr AS (SELECT * FROM ev WHERE fold <> 0), {cv_line_sql(source='tr')}, c AS (SELECT e.key, e.stratum, m.fold, m.a + m.b * e.x AS y_pred FROM ev e, m WHERE e.fold = 0), r AS (SELECT fold, stratum, y_true - y_pred AS residual FROM oof)"


def task_out_of_fold(t):
    """Out-of-fold residuals of folds 1 to 4, and every row of fold 0 predicted by each of their leave-fold-out models."""
    return M.out_of_fold(t.ev.filter("fold <> 0"), t.ev.filter("fold = 0").drop("fold"), "fold", "x", "y_true")


def task_intervals(t, make, *more):
    residuals, centres = task_out_of_fold(t)
    return make(centres, residuals, "fold", ["key"], *more)


def residuals_and_predictions(t):
    kind = lambda df, name, value: df.select(F.lit(name).alias("kind"), "key", "fold", F.col(value).alias("value"))
    residuals, centres = task_out_of_fold(t)
    return kind(residuals, "residual", "residual").unionByName(kind(centres, "prediction", "y_pred"))


add("m7_residuals_and_predictions", residuals_and_predictions, f"WITH {TASK} SELECT 'residual' AS kind, key, fold, round(y_true - y_pred, 6) AS value FROM oof UNION ALL SELECT 'prediction', key, fold, round(y_pred, 6) FROM c")
add("c3_cv_plus_whole", lambda t: task_intervals(t, C.cv_plus, 0.1), f"WITH {TASK}, v AS ({CVP.format(g='', j='')}) SELECT key, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (SELECT key, {BOUNDS} FROM v)")
add("c4_mondrian_cv_plus_whole", lambda t: task_intervals(t, C.mondrian_cv_plus, "stratum", 0.1),
    f"""WITH {TASK}, v AS ({CVP.format(g='', j='')}), o AS ({CVP.format(g='c.stratum,', j='AND c.stratum = r.stratum')}), p AS (SELECT key, {BOUNDS} FROM v), q AS (SELECT key, {BOUNDS} FROM o)
    SELECT p.key, round(CASE WHEN isfinite(q.lower) AND isfinite(q.upper) THEN q.lower ELSE p.lower END, 6) AS lower, round(CASE WHEN isfinite(q.lower) AND isfinite(q.upper) THEN q.upper ELSE p.upper END, 6) AS upper FROM p LEFT JOIN q USING (key)""")
SEL = "SELECT stratum AS task, fold AS layer, method AS alpha, avg(abs(y_true - y_pred)) AS inner_mae FROM pred GROUP BY stratum, fold, method"
add("m8_pick_layer", lambda t: M.pick_layer(t.sql(SEL), ["task"], "layer", "alpha", "inner_mae"), f"SELECT task, layer, alpha, round(inner_mae, 6) AS inner_mae FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY inner_mae, layer, alpha) AS r FROM ({SEL})) WHERE r = 1")
add("m9_best_pipeline", lambda t: A.winner(t.sql(SEL), ["task", "layer"], "inner_mae", "alpha").groupBy("alpha").agg(F.count(F.lit(1)).alias("wins")), f"SELECT alpha, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY task, layer ORDER BY inner_mae, alpha) AS r FROM ({SEL})) WHERE r = 1 GROUP BY 1")
add("m9_best_recipe", lambda t: A.best_recipe(A.fold_metrics(t.pred, ["stratum", "method", "fold"]), ["stratum", "method"], "mae", "rmse"),
    """WITH f AS (SELECT stratum, method, fold, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM pred GROUP BY ALL), m AS (SELECT stratum, method, avg(mae) AS mae, avg(rmse) AS rmse FROM f GROUP BY ALL)
    SELECT (SELECT stratum FROM m ORDER BY mae, stratum, method LIMIT 1) AS stratum, (SELECT method FROM m ORDER BY mae, stratum, method LIMIT 1) AS method, (SELECT round(min(mae), 6) FROM m) AS mae,
    (SELECT stratum FROM m ORDER BY rmse, stratum, method LIMIT 1) AS also_stratum, (SELECT method FROM m ORDER BY rmse, stratum, method LIMIT 1) AS also_method""")
CAND = "SELECT CAST(l_orderkey AS STRING) AS task, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey AS rank, CASE WHEN l_quantity < 10 THEN CAST('NaN' AS DOUBLE) WHEN l_quantity < 15 THEN NULL ELSE l_quantity END AS score FROM lineitem"
add("m10_refit_fallback", lambda t: M.refit_fallback(t.sql(CAND), ["task"], "rank", "score").select("task", "rank", "score", "fallbacks"),
    f"WITH c AS (SELECT *, score IS NOT NULL AND isfinite(score) AS ok FROM ({CAND})), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY task ORDER BY rank ROWS UNBOUNDED PRECEDING) AS bad FROM c), u AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY rank) AS n FROM r WHERE ok) SELECT task, rank, round(score, 6) AS score, CAST(bad AS BIGINT) AS fallbacks FROM u WHERE n = 1")
add("m11_reference_predictors", lambda t: M.train_mean_predictor(t.ev, ["stratum"], "fold", "y_true").select("key", "y_pred"), "SELECT key, round(y_pred, 6) AS y_pred FROM pred WHERE method = 'by_type'")
add("m12_split_sensitivity", lambda t: A.summarise(M.cross_validated_line(K.stratified_kfold(t.ev.drop("fold"), "key", "stratum", 3, 4, 21), ["repeat"], "fold", "x", "y_true").groupBy("repeat").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")), [], "mae"),
    f"""WITH k AS (SELECT ev.key, x, y_true, r, (row_number() OVER (PARTITION BY r, stratum ORDER BY md5('21:' || r || ':' || key)) - 1) % 3 AS f3 FROM ev, range(4) y(r)), f AS (SELECT r, f3, {SUMS} FROM k GROUP BY ALL), t AS (SELECT r, {SUMS} FROM k GROUP BY 1), l AS (SELECT f.r, f3, {LESS} FROM f JOIN t USING (r)),
    m AS (SELECT r, f3, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM l)), e AS (SELECT r, avg(abs(y_true - a - b * x)) AS mae FROM k JOIN m USING (r, f3) GROUP BY 1) SELECT round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS sd, count(*) AS size FROM e""")
SHARES = [1, 10, 30, 100]


def nested_curve(t):
    """Nested subsets of hundredths of the training rows, all of them included, on one test fold."""
    train = t.ev.filter("fold <> 0")
    n = train.count()
    sizes = [-(-n * s // 100) for s in SHARES]
    entries = K.nested_subsets(train, "key", "stratum", "grp", sizes, 6).filter("entry is not null")
    tasks = K.learning_curve_tasks(train.join(entries, "key"), "entry", sizes)
    rows = tasks.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    return M.learning_curve(tasks, t.ev.filter("fold = 0").select("x", "y_true"), "size", "x", "y_true").join(rows, "size")


NESTED = (
    f"""WITH tr AS (SELECT * FROM ev WHERE fold <> 0), z AS (SELECT CAST(ceil(count(*) * s / 100) AS INT) AS size FROM tr, (VALUES {", ".join(f"({s})" for s in SHARES)}) v(s) GROUP BY s), c AS (SELECT stratum, count(*) AS n FROM tr GROUP BY 1),
    q AS (SELECT size, stratum AS st, n * size::DOUBLE / sum(n) OVER (PARTITION BY size) AS share FROM c, z), q2 AS (SELECT size, st, floor(share) AS f, row_number() OVER (PARTITION BY size ORDER BY round(share - floor(share), 9) DESC, st) AS o FROM q), qs AS (SELECT size, st, f + CASE WHEN o <= size - sum(f) OVER (PARTITION BY size) THEN 1 ELSE 0 END AS quota FROM q2),
    g AS (SELECT stratum, grp, count(*) AS n FROM tr GROUP BY ALL), b AS (SELECT stratum, grp, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY md5('6:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), e AS (SELECT grp, min(size) AS entry FROM b JOIN qs ON st = stratum AND b < quota GROUP BY 1),
    k AS (SELECT x, y_true, size FROM tr JOIN e USING (grp) JOIN z ON entry <= size), m AS (SELECT size, n, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM (SELECT size, {SUMS} FROM k GROUP BY 1))) SELECT size, round(avg(abs(y_true - a - b * x)), 6) AS mae, any_value(n) AS n FROM ev, m WHERE fold = 0 GROUP BY 1""")
add("m13_learning_curve_nested", nested_curve, NESTED)
add("m13_learning_curve", lambda t: nested_curve(t).select("size", "mae"), f"SELECT size, mae FROM ({NESTED})")


def curve_changes(t):
    """A line against the training mean, at each size, over five folds and two draws."""
    tasks = K.fold_curve_tasks(t.ev, "key", "fold", 5, "stratum", "grp", [100, 500, 2000], 2, 6)
    return M.paired_curve(M.fold_curves(tasks, t.ev, "key", ["test_fold", "draw", "size"], "x", "y_true"), "size", ["test_fold", "draw"], "method", "mean", "mae")


add("m13_paired_curve", curve_changes,
    f"""WITH tr AS (SELECT key, grp, stratum, x, y_true, CAST(f AS INT) AS test_fold, CAST(d AS INT) AS draw FROM ev, range(5) x(f), range(2) y(d) WHERE fold <> f), {CURVE},
    k AS (SELECT tr.*, s AS size FROM tr JOIN e USING (test_fold, draw, grp), (VALUES (100), (500), (2000)) v(s) WHERE entry <= s),
    m AS (SELECT test_fold, draw, size, b, sy / n - b * sx / n AS a, sy / n AS mean FROM (SELECT *, {LINE.format(a=0)} AS b FROM (SELECT test_fold, draw, size, {SUMS} FROM k GROUP BY ALL))),
    z AS (SELECT size, test_fold, draw, avg(abs(y_true - a - b * x)) - avg(abs(y_true - mean)) AS d FROM ev JOIN m ON fold = test_fold GROUP BY ALL)
    SELECT size, 'line' AS method, round(avg(d), 6) AS change, round(stddev_samp(d), 6) AS sd, count(*) FILTER (d < 0) AS better, count(*) AS n FROM z GROUP BY 1""")
add("m14_bootstrap_ensemble", lambda t: M.bootstrap_predict(t.ev.filter("fold = 0"), M.bootstrap_lines(t.ev.filter("fold <> 0"), "key", "x", "y_true", 10, 17), "key", "x"),
    f"""WITH w AS (SELECT x, y_true, r, {POISSON} AS w FROM (SELECT x, y_true, r, {uniform_sql(17, "r || ':' || key")} AS u FROM ev, range(1, 11) y(r) WHERE fold <> 0)), s AS (SELECT r, sum(w) AS n, sum(w * x) AS sx, sum(w * y_true) AS sy, sum(w * x * x) AS sxx, sum(w * x * y_true) AS sxy FROM w GROUP BY 1), m AS (SELECT r, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM s))
    SELECT key, round(avg(a + b * x), 6) AS y_pred, round(stddev_pop(a + b * x), 6) AS spread FROM ev, m WHERE fold = 0 GROUP BY 1""")
add("m15_success_probability", lambda t: M.success_probability(t.sql("SELECT o_orderkey, o_totalprice / 100000 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0D ELSE 0.0D END AS label FROM orders"), t.sql("SELECT o_orderkey, o_totalprice / 100000 AS x FROM orders"), ["x"], "label").agg(F.count(F.lit(1)).alias("n"), F.avg("p_success").alias("p")))
WEIGHT = "least(1.0::DOUBLE, greatest(0.0, coalesce(sum((y_true - p_type) * (p_mean - p_type)) / nullif(sum(pow(p_mean - p_type, 2)), 0), 0.5)))"
add("m16_stack_weights", lambda t: M.stack_pair_weight(t.wide, ["stratum"], "y_true", "p_mean", "p_type"), f"SELECT stratum, round({WEIGHT}, 6) AS weight FROM wide GROUP BY 1")
add("m16_simplex_weights", lambda t: t.spark.createDataFrame(sorted(M.stack_weights(t.wide, "y_true", ["p_mean", "p_type", "p_hour"]).items()), "member string, weight double"))
add("m16_absolute_pair", lambda t: M.stack_pair_weight_absolute(t.wide, ["stratum"], "y_true", "p_type", "p_hour"),
    """WITH r AS (SELECT stratum, (y_true - p_hour) / (p_type - p_hour) AS t, abs(p_type - p_hour) AS g FROM wide WHERE p_type <> p_hour), c AS (SELECT stratum, t, sum(g) OVER (PARTITION BY stratum ORDER BY t) AS upto, sum(g) OVER (PARTITION BY stratum) AS total FROM r),
    m AS (SELECT stratum, min(t) AS t FROM c WHERE upto >= total / 2 GROUP BY 1) SELECT stratum, round(least(1.0, greatest(0.0, coalesce(t, 0.5))), 6) AS weight FROM (SELECT DISTINCT stratum FROM wide) LEFT JOIN m USING (stratum)""")


def absolute_weights(t):
    members = ["p_mean", "p_type", "p_hour"]
    weights, error, gap = M.stack_weights_absolute(t.wide, "y_true", members)
    return t.spark.createDataFrame([(m, w, error, gap) for m, w in sorted(weights.items())], "member string, weight double, mae double, gap double")


add("m16_absolute_weights", absolute_weights)
add("m17_stack_predict", lambda t: M.stack_predict(t.wide.filter("fold <> 0"), t.wide.filter("fold = 0"), ["stratum"], "y_true", "p_mean", "p_type").select("key", "y_pred"), f"WITH w AS (SELECT stratum, {WEIGHT} AS w FROM wide WHERE fold <> 0 GROUP BY 1) SELECT key, round(w * p_mean + (1 - w) * p_type, 6) AS y_pred FROM wide JOIN w USING (stratum) WHERE fold = 0")
add("m18_concat_ridge", lambda t: M.concat_ridge(t.ev.withColumns({"x2": F.col("x") * F.col("x"), "g": (F.col("grp") % 7).cast("double")}), [["x", "x2"], ["g"]], "y_true", "fold", [1.0, 100.0]).select("key", "y_pred"))
ADD = "SELECT 'base' AS arm, x, y_true FROM ev WHERE fold IN (1, 2) UNION ALL SELECT 'added', x, y_true FROM ev WHERE fold IN (1, 2, 3)"
add("m13_curve_by_arm", lambda t: M.learning_curve(t.sql(ADD), t.ev.filter("fold = 0").select("x", "y_true"), "arm", "x", "y_true"), f"WITH k AS ({ADD}), m AS (SELECT arm, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM (SELECT arm, {SUMS} FROM k GROUP BY 1))) SELECT arm, round(avg(abs(y_true - a - b * x)), 6) AS mae FROM ev, m WHERE fold = 0 GROUP BY 1")
additions = lambda t: M.compare_additions(t.ev.filter("fold IN (1, 2)"), {"added": t.ev.filter("fold = 3")}, t.ev.filter("fold = 0").select("key", "x", "y_true"), "key", F.col("x") >= 12, "x", "y_true", 200, 19)
ADDITIONS = (
    f"""WITH k AS ({ADD}), m AS (SELECT arm, n, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM (SELECT arm, {SUMS} FROM k GROUP BY 1))), s AS (SELECT key, arm, x >= 12 AS hard, pow(y_true - a - b * x, 2) AS s FROM ev, m WHERE fold = 0),
    o AS (SELECT key, hard, max(CASE WHEN arm = 'added' THEN s END) AS sa, max(CASE WHEN arm = 'base' THEN s END) AS sb FROM s GROUP BY ALL), w AS {weights_sql('o', 'key', 200, 19)},
    r AS (SELECT sqrt(sum(w * sa) / sum(w)) - sqrt(sum(w * sb) / sum(w)) AS g, sqrt(sum(w * sa) FILTER (hard) / sum(w) FILTER (hard)) - sqrt(sum(w * sb) FILTER (hard) / sum(w) FILTER (hard)) AS h FROM o JOIN w USING (key) WHERE w > 0 GROUP BY replicate),
    q AS (SELECT quantile_cont(g, 0.025) AS gl, quantile_cont(g, 0.975) AS gh, quantile_cont(h, 0.025) AS hl, quantile_cont(h, 0.975) AS hh FROM r), e AS (SELECT arm, sqrt(avg(s)) AS rmse, sqrt(avg(s) FILTER (hard)) AS rmse_hard FROM s GROUP BY 1)
    SELECT e.arm, m.n - z.n AS n_added, round(e.rmse, 6) AS rmse, round(e.rmse_hard, 6) AS rmse_hard, CASE WHEN e.arm <> 'base' THEN round(e.rmse - y.rmse, 6) END AS rmse_change, CASE WHEN e.arm <> 'base' THEN round(gl, 6) END AS rmse_low, CASE WHEN e.arm <> 'base' THEN round(gh, 6) END AS rmse_high,
    CASE WHEN e.arm <> 'base' THEN round(e.rmse_hard - y.rmse_hard, 6) END AS rmse_hard_change, CASE WHEN e.arm <> 'base' THEN round(hl, 6) END AS rmse_hard_low, CASE WHEN e.arm <> 'base' THEN round(hh, 6) END AS rmse_hard_high FROM e JOIN m USING (arm), e y, m z, q WHERE y.arm = 'base' AND z.arm = 'base'""")
add("m19_compare_additions", additions, ADDITIONS)
add("m19_additions_bootstrap", additions, ADDITIONS)


def exclusion_effect(t):
    """Out-of-fold lines on all labels and on those under 100, by stratum; rows under 100 are scored by both."""
    predicted = lambda rows: M.cross_validated_line(rows, [], "fold", "x", "y_true").select("key", "stratum", "y_true", "y_pred")
    return M.exclusion_effect(predicted(t.ev), predicted(t.ev.filter("y_true < 100")), ["key"], ["stratum"])


add("m20_exclusion_effect", exclusion_effect,
    f"""WITH a AS (WITH {cv_line_sql()} SELECT key, y_pred FROM oof), low AS (SELECT * FROM ev WHERE y_true < 100), b AS (WITH {cv_line_sql(source="low")} SELECT key, stratum, y_true, y_pred FROM oof)
    SELECT stratum, count(*) AS n, round(avg(abs(y_true - a.y_pred)), 6) AS mae_full, round(avg(abs(y_true - b.y_pred)), 6) AS mae_audited, round(sqrt(avg(pow(y_true - a.y_pred, 2))), 6) AS rmse_full, round(sqrt(avg(pow(y_true - b.y_pred, 2))), 6) AS rmse_audited FROM b JOIN a USING (key) GROUP BY 1""")
add("m13_curve_by_exclusion", lambda t: M.learning_curve(t.sql("SELECT 'full' AS arm, x, y_true FROM ev WHERE fold <> 0 UNION ALL SELECT 'audited', x, y_true FROM ev WHERE fold <> 0 AND y_true < 100"), t.ev.filter("fold = 0").select("x", "y_true"), "arm", "x", "y_true"),
    f"WITH k AS (SELECT 'full' AS arm, x, y_true FROM ev WHERE fold <> 0 UNION ALL SELECT 'audited', x, y_true FROM ev WHERE fold <> 0 AND y_true < 100), m AS (SELECT arm, b, sy / n - b * sx / n AS a FROM (SELECT *, {LINE.format(a=0)} AS b FROM (SELECT arm, {SUMS} FROM k GROUP BY 1))) SELECT arm, round(avg(abs(y_true - a - b * x)), 6) AS mae FROM ev, m WHERE fold = 0 GROUP BY 1")
add("m21_feature_importance", lambda t: M.feature_importance(M.tree_predict(t.sql(SMALL).filter("fold <> 0"), t.sql(SMALL).filter("fold = 0"), ["x", "g"], "y_true", "forest", numTrees=3, maxDepth=3)[1], ["x", "g"], t.spark))
add("m22_log_linear_rule", lambda t: M.log_linear_rule(t.orders, ["o_orderpriority"], "o_custkey", "o_totalprice"), "SELECT o_orderpriority, round(regr_slope(o_totalprice, ln(o_custkey)), 6) AS slope, round(regr_intercept(o_totalprice, ln(o_custkey)), 6) AS intercept FROM orders WHERE o_custkey > 0 GROUP BY 1")


def plugged(t):
    from ..session import ship_package

    ship_package(t.spark)
    X.register_feature("f", lambda a, b: a * 2 + b)
    return X.with_features(t.ev.select("key", "x", "y_true"), {"f": ["x", "y_true"]}).select("key", "f")


add("f1_registered_features", plugged, "SELECT key, round(x * 2 + y_true, 6) AS f FROM ev")
add("f3_evaluate", lambda t: A.error_table(X.evaluate(t.ev, "fold", {"mean": lambda train, test: test.crossJoin(train.agg(F.avg("y_true").alias("y_pred")))}), ["method", "fold"]), "SELECT method, fold, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) AS rmse FROM pred WHERE method = 'mean' GROUP BY ALL")
add("f4_row_expansion", lambda t: t.events.select("user_id", F.explode(F.array(F.struct(F.lit("v").alias("kind"), F.col("value").alias("x")), F.struct(F.lit("id").alias("kind"), F.col("event_id").cast("double").alias("x")))).alias("r")).select("user_id", "r.*").groupBy("user_id", "kind").agg(F.sum("x").alias("s")), "SELECT user_id, kind, round(sum(x), 6) AS s FROM (SELECT user_id, 'v' AS kind, value AS x FROM events UNION ALL SELECT user_id, 'id', event_id::DOUBLE FROM events) GROUP BY ALL")
