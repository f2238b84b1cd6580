"""Registered queries of explanations, neighbours, ensembles, selection and registry (H9, I12, I14, E4, I7, I8, F13, F14,
I15, I16, I18, N6).

H9, I14 and F13 are fed with given linear scores, so that SQL can say what must come out; fits are rows-only checked
and tested against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions import sql as N
from tabvet.functions.core import round_doubles
from tabvet.operators import ensemble as En
from tabvet.operators import explain as X
from tabvet.operators import neighbours as Nb
from tabvet.operators import registry_log as R
from tabvet.operators.features import anova_f
from tabvet.operators.train import linear_attributions, train
from tabvet.plans.q_train import FEATS, KEYS, TARGET, _data
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table

# ---- a given linear score on lineitem: late returns of large, expensive lines ----
COEF = {"l_quantity": 0.8, "l_extendedprice": 0.0004, "l_discount": 60.0, "l_tax": -40.0}
INTERCEPT = -35.0
SCORE_SQL = " + ".join(f"{b!r} * {{{c}}}" for c, b in COEF.items()) + f" + {INTERCEPT!r}"


def _score_sql(**names: str) -> str:
    """The score in SQL, with other columns in place of some features."""
    return SCORE_SQL.format(**{c: names.get(c, c) for c in COEF})


def _shuffle(r: int):
    return (F.col("l_orderkey") * (7919 + 104 * r) + F.col("l_linenumber") * (104729 + 12 * r)) % 100003


def _shuffle_sql(r: int) -> str:
    return f"(l_orderkey * {7919 + 104 * r} + l_linenumber * {104729 + 12 * r}) % 100003"


# ------------------------------------------------------------------ H9
REPEATS = 3
ORDER = [*KEYS, "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]  # the keys repeat
_H9 = [
    f"""b AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS i FROM lineitem)""",
    "base AS (SELECT avg(CASE WHEN y = CASE WHEN " + _score_sql() + " >= 0 THEN 1.0 ELSE 0.0 END THEN 1.0 ELSE 0.0 END) AS baseline FROM b)",
    *[f"s{r} AS (SELECT *, row_number() OVER (ORDER BY {_shuffle_sql(r)}, i) AS j FROM b)" for r in range(REPEATS)],
    "d AS (" + union_all([
        f"SELECT '{c}' AS feature, (SELECT baseline FROM base) AS baseline, (SELECT baseline FROM base) - avg(CASE WHEN b.y = CASE WHEN "
        + SCORE_SQL.format(**{f: f"o.{f}" if f == c else f"b.{f}" for f in COEF}) + f" >= 0 THEN 1.0 ELSE 0.0 END THEN 1.0 ELSE 0.0 END) AS drop FROM b JOIN s{r} o ON b.i = o.j"
        for c in COEF for r in range(REPEATS)]) + ")",
]


def _marked(spark, d):
    return load_table(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))


@query("h9_permutation_importance", with_(_H9, f"""SELECT feature, {r6('any_value(baseline)')} AS baseline, {r6('avg(drop)')} AS importance_mean,
  {r6('stddev_pop(drop)')} AS importance_std FROM d GROUP BY feature"""))
def h9_permutation_importance(spark, d):
    score = X.linear_scorer(COEF, INTERCEPT, 0.0)
    return round_doubles(X.permutation_importance(score, _marked(spark, d), list(COEF), "y", [F.col(c) for c in ORDER], [_shuffle(r) for r in range(REPEATS)]))


@query("h9_model_importance")
def h9_model_importance(spark, d):
    model = train("DecisionTree", _data(spark, d), FEATS, TARGET)
    labels = model.stages[0].labels
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(TARGET)) - 1
    rows = _data(spark, d).withColumn("y", y.cast("double"))
    return round_doubles(X.permutation_importance(X.model_scorer(model, FEATS), rows, FEATS, "y", [F.col(c) for c in ORDER], [_shuffle(r) for r in range(REPEATS)]))


# ------------------------------------------------------------------ I12
@query("i12_given_attributions", "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in COEF) + " FROM lineitem), c AS (" + union_all([
    f"SELECT '{c}' AS feature, avg(abs({b!r} * (l.{c} - m.{c}))) AS v FROM lineitem l, m" for c, b in COEF.items()])
    + f") SELECT feature, {r6('v')} AS mean_abs_contribution, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM c")
def i12_given_attributions(spark, d):
    return round_doubles(linear_attributions(_data(spark, d), list(COEF), COEF, KEYS)[1])


@query("i12_tree_attributions")
def i12_tree_attributions(spark, d):
    df = _data(spark, d)
    model = train("RandomForest", df, FEATS, TARGET)
    return round_doubles(X.global_attributions(X.tree_attributions(model, df, FEATS, KEYS), FEATS))


# ------------------------------------------------------------------ I14
CF_FEATURES, CF_STEPS = ["l_quantity", "l_discount"], [-1.0, -0.5, 0.5, 1.0]
CF_SCALE = {"l_quantity": 14.0, "l_discount": 0.03}
_MOVES = X.lattice(CF_FEATURES, CF_STEPS)
_CF_ROWS = ", ".join(f"({i}, {sum(abs(s) for s in m.values())!r}, {m.get('l_quantity', 0.0) * 14.0!r}, {m.get('l_discount', 0.0) * 0.03!r})" for i, m in enumerate(_MOVES))


@query("i14_counterfactuals", f"""WITH moves(candidate, cost, q, dd) AS (VALUES {_CF_ROWS}),
l AS (SELECT *, row_number() OVER () AS id FROM lineitem),
r AS (SELECT id, l_orderkey, l_linenumber, CASE WHEN {_score_sql()} >= 0 THEN 1.0 ELSE 0.0 END AS original_class, candidate, cost,
   l_quantity + q AS cq, l_discount + dd AS cd, CASE WHEN {_score_sql(l_quantity='(l_quantity + q)', l_discount='(l_discount + dd)')} >= 0 THEN 1.0 ELSE 0.0 END AS p
 FROM l, moves),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p = original_class, CASE WHEN p <> original_class THEN cost ELSE 0 END, candidate) AS rn FROM r)
SELECT l_orderkey, l_linenumber, original_class, p AS achieved_class, p <> original_class AS success, CASE WHEN p <> original_class THEN CAST(cost AS DOUBLE) END AS cost,
  candidate, {r6('cq')} AS cf_l_quantity, {r6('cd')} AS cf_l_discount FROM k WHERE rn = 1""")
def i14_counterfactuals(spark, d):
    score = X.linear_scorer({c: b for c, b in COEF.items()}, INTERCEPT, 0.0)
    df = _data(spark, d)
    # the score also reads columns that are not to change: they are carried as keys
    rows = X.counterfactuals(score, df, CF_FEATURES, [*KEYS, "l_extendedprice", "l_tax"], steps=CF_STEPS, scale=CF_SCALE)
    return round_doubles(rows.drop("l_extendedprice", "l_tax"))


# ------------------------------------------------------------------ E4
KNN_COLS = ["p_size", "p_retailprice", "p_weight"]
_PART_SQL = """pt AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 7919) % 1000 AS DOUBLE) END AS p_weight FROM part)"""


def _gap(c: str) -> str:
    return f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)"


def _knn_sql(c: str) -> str:
    common = " + ".join(f"(a.{x} IS NOT NULL AND b.{x} IS NOT NULL)::INTEGER" for x in KNN_COLS)
    total = " + ".join(_gap(x) for x in KNN_COLS)
    return f"""f_{c} AS (SELECT p_partkey, avg(v) AS v FROM (
   SELECT a.p_partkey, b.{c} AS v, row_number() OVER (PARTITION BY a.p_partkey ORDER BY ({total}) * (3.0::DOUBLE / ({common})), b.p_partkey) AS rn
   FROM pt a JOIN pt b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND ({common}) > 0) WHERE rn <= 5 GROUP BY p_partkey)"""


def _parts(spark, d):
    key = F.col("p_partkey")
    return load_table(spark, d, "part").select(
        "p_partkey", F.when(key % 7 != 0, F.col("p_size").cast("double")).alias("p_size"), F.when(key % 11 != 0, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(key % 5 != 0, (key * 7919 % 1000).cast("double")).alias("p_weight"))


@query("e4_impute_knn", with_([_PART_SQL, *[_knn_sql(c) for c in KNN_COLS]],
       "SELECT p_partkey, " + ", ".join(r6(f"coalesce(pt.{c}, f_{c}.v, (SELECT avg({c}) FROM pt))") + f" AS {c}" for c in KNN_COLS)
       + " FROM pt " + " ".join(f"LEFT JOIN f_{c} USING (p_partkey)" for c in KNN_COLS)))
def e4_impute_knn(spark, d):
    return round_doubles(Nb.impute_knn(_parts(spark, d), KNN_COLS, [F.col("p_partkey")]))


# ------------------------------------------------------------------ I7 / I8
def _returned(spark, d):
    return load_table(spark, d, "lineitem").select(*KEYS, *FEATS, F.when(F.col(TARGET) == "R", "yes").otherwise("no").alias("returned"))


@query("i7_stacking")
def i7_stacking(spark, d):
    _, report = En.stacking(_returned(spark, d), FEATS, "returned", KEYS, ["LogisticRegression", "DecisionTree", "NaiveBayes"], trees=20)
    return round_doubles(report)


@query("i8_region_models")
def i8_region_models(spark, d):
    _, scores = En.region_models(_data(spark, d), FEATS, TARGET, ["LogisticRegression", "DecisionTree", "NaiveBayes"])
    return round_doubles(scores)


# ------------------------------------------------------------------ F13 / F14
_F13 = [
    "y AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)",
    "c AS (" + union_all([f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance, abs({b!r}) * stddev_pop({c}) AS permutation FROM y" for c, b in COEF.items()]) + ")",
    "a AS (" + union_all([f"""SELECT '{c}' AS feature, (sum(n * (m - t) * (m - t)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
  FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS t FROM lineitem)""" for c in COEF]) + ")",
    """v AS (SELECT feature, (importance / (sum(importance) OVER () + 1e-10) + permutation / (sum(permutation) OVER () + 1e-10)
  + (f_score - min(f_score) OVER ()) / (max(f_score) OVER () - min(f_score) OVER () + 1e-10)) / 3 AS vote FROM c JOIN a USING (feature))""",
    "t AS (SELECT quantile_cont(vote, 0.3) AS threshold FROM v)",
]


@query("f13_feature_vote", with_(_F13, f"""SELECT feature, {r6('vote')} AS vote, {r6('threshold')} AS threshold, vote >= threshold AS selected,
  CAST(row_number() OVER (ORDER BY vote DESC, feature) AS INTEGER) AS rank FROM v, t"""))
def f13_feature_vote(spark, d):
    rows = _marked(spark, d)
    one = rows.agg(*[F.struct(F.abs(F.corr(c, "y")).alias("importance"), (F.lit(abs(b)) * F.stddev_pop(c)).alias("permutation")).alias(c) for c, b in COEF.items()])
    given = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), f"{c}.importance", f"{c}.permutation") for c in COEF])).alias("r")).select("r.*")
    return round_doubles(En.feature_vote(given.join(anova_f(rows, list(COEF), "l_returnflag").drop("rank"), "feature")))


@query("f14_rfe")
def f14_rfe(spark, d):
    rows = _marked(spark, d)
    kept = [*FEATS, "l_linenumber", "l_suppkey"]
    return round_doubles(En.rfe(rows.select("l_orderkey", F.col("l_linenumber").alias("line"), *kept, "y"), kept, F.col("y"), ["l_orderkey", "line"], n=3,
                                importance=En.forest_importance(2, trees=20), score=En.forest_score(2, trees=20)))


# ------------------------------------------------------------------ I15 / I16
RUN_FEATS = ["n_rows", "mean_value", "share_error"]
_RUNS = [
    """g AS (SELECT user_id, epoch_us(max(ts)) AS at, count(*)::DOUBLE AS n_rows, avg(value) AS mean_value, avg((event_type = 'error')::INTEGER) AS share_error,
   'm' || (user_id % 5) AS model, max(value) / 1000.0 AS f1_score FROM events GROUP BY user_id)""",
]


def _runs(spark, d):
    ev = load_table(spark, d, "events")
    return ev.groupBy("user_id").agg(
        F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("at"), F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("value").alias("mean_value"),
        F.avg((F.col("event_type") == "error").cast("int")).alias("share_error"), (F.max("value") / 1000.0).alias("f1_score")) \
        .withColumn("model", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")))


@query("i15_recommend_model", with_(_RUNS + [
    "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in RUN_FEATS) + " FROM g)",
    'z AS (SELECT user_id, "at", model, ' + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in RUN_FEATS) + " FROM g, s)",
    "p AS (SELECT a.user_id, b.model, " + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in RUN_FEATS) + """ AS d2, b."at", count(*) OVER (PARTITION BY a.user_id) AS n,
  row_number() OVER (PARTITION BY a.user_id ORDER BY d2, b."at", b.model, b.n_rows, b.mean_value, b.share_error) AS rn FROM z a JOIN z b ON b."at" < a."at")"""],
    f"""SELECT g.user_id, CASE WHEN n >= 3 THEN p.model ELSE 'RandomForest' END AS recommended, {r6("CASE WHEN n >= 3 THEN least(0.5 + n / 20.0, 0.9) ELSE 0.3 END")} AS confidence,
  coalesce(n, 0) AS earlier_runs, {r6("CASE WHEN n >= 3 THEN sqrt(d2) END")} AS distance FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.rn = 1"""))
def i15_recommend_model(spark, d):
    runs = _runs(spark, d)
    return round_doubles(Nb.recommend_model(runs.select("user_id", "at", *RUN_FEATS), runs.select("at", "model", *RUN_FEATS), RUN_FEATS, "user_id", "at"))


@query("i16_experiment_stats", with_(_RUNS + ["p AS (SELECT model, count(*) AS experiments, avg(f1_score) AS mean_score FROM g GROUP BY model)"],
       f"""SELECT model, experiments, {r6('mean_score')} AS mean_score, {r6('experiments * 1.0 / sum(experiments) OVER ()')} AS share,
  row_number() OVER (ORDER BY mean_score DESC, model) = 1 AND mean_score > 0 AS best FROM p"""))
def i16_experiment_stats(spark, d):
    return round_doubles(R.experiment_stats(_runs(spark, d)))


# ------------------------------------------------------------------ I18
_LOG_SQL = """log AS (SELECT 'u' || (user_id % 97) AS model, epoch_us(ts) AS "at", event_id AS seq,
  CASE WHEN event_type IN ('view', 'click') THEN 'register' WHEN event_type = 'purchase' THEN 'promote' ELSE 'rollback' END AS action,
  CASE WHEN event_type <> 'error' THEN 'v' || (event_id % 6) END AS version, value AS f1_score FROM events)"""
#: The stack itself, event by event: a fold over the log of one model.
_FOLD = "WITH RECURSIVE " + _LOG_SQL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY "at", seq) AS i FROM log),
k AS (SELECT *, coalesce(max((action = 'register')::INTEGER) OVER (PARTITION BY model, version ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS known FROM o),
f AS (
  SELECT model, 0::BIGINT AS i, NULL::BIGINT AS "at", NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS version, NULL::DOUBLE AS f1_score,
    []::VARCHAR[] AS stack, NULL::VARCHAR AS latest, FALSE AS applied FROM (SELECT DISTINCT model FROM k)
  UNION ALL
  SELECT k.model, k.i, k."at", k.seq, k.action, k.version, k.f1_score,
    CASE WHEN k.action = 'promote' OR (k.action = 'rollback' AND k.version IS NOT NULL AND k.known) THEN list_append(f.stack, k.version)
         WHEN k.action = 'rollback' AND k.version IS NULL THEN f.stack[1:len(f.stack) - 1] ELSE f.stack END,
    CASE WHEN k.action = 'register' THEN k.version ELSE f.latest END,
    CASE WHEN k.action = 'rollback' AND k.version IS NULL THEN len(f.stack) > 0 WHEN k.action = 'rollback' THEN k.known ELSE TRUE END
  FROM f JOIN k ON k.model = f.model AND k.i = f.i + 1)"""


def _log(spark, d):
    ev, kind = load_table(spark, d, "events"), F.col("event_type")
    return ev.select(
        F.concat(F.lit("u"), (F.col("user_id") % 97).cast("string")).alias("model"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"),
        F.when(kind.isin("view", "click"), "register").when(kind == "purchase", "promote").otherwise("rollback").alias("action"),
        F.when(kind != "error", F.concat(F.lit("v"), (F.col("event_id") % 6).cast("string"))).alias("version"), F.col("value").alias("f1_score"))


@query("i18_registry_states", _FOLD + """
SELECT model, "at", seq, action, version, applied, latest, stack[len(stack)] AS production, len(stack)::BIGINT AS depth FROM f WHERE i > 0""")
def i18_registry_states(spark, d):
    return R.registry_states(_log(spark, d)).select("model", "at", "seq", "action", "version", "applied", "latest", "production", "depth")


@query("i18_registry_compare", _FOLD + f""",
e AS (SELECT model, last(stack[len(stack)] ORDER BY i) AS production, last(latest ORDER BY i) AS latest FROM f GROUP BY model),
p AS (SELECT model, version, max("at") FILTER (WHERE action = 'register') AS created_at, last(f1_score ORDER BY i) FILTER (WHERE action = 'register') AS f1_score,
  count(*) FILTER (WHERE action = 'register') AS registrations, count(*) FILTER (WHERE action <> 'register') AS promotions FROM f WHERE applied AND version IS NOT NULL GROUP BY model, version)
SELECT p.model, p.version, created_at, {r6('f1_score')} AS f1_score, registrations, promotions, p.version IS NOT DISTINCT FROM e.production AS production,
  p.version IS NOT DISTINCT FROM e.latest AS latest FROM p JOIN e ON e.model = p.model WHERE registrations > 0""")
def i18_registry_compare(spark, d):
    return round_doubles(R.registry_compare(_log(spark, d), ["f1_score"]))


# ------------------------------------------------------------------ N6
@query("n6_sql_functions", f"""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
SELECT event_type, {r6('exp(-m / 100)')} AS p_chi2, {r6('CASE WHEN s <> 0 THEN m / s END')} AS ratio,
  regexp_replace(event_type || ' of / ' || n, '[^a-zA-Z0-9._-]+', '_', 'g') AS slug FROM g""")
def n6_sql_functions(spark, d):
    N.register(spark)
    load_table(spark, d, "events").createOrReplaceTempView("n6_events")
    return round_doubles(spark.sql("""SELECT event_type, chi2_sf(avg(value) / 50, 2.0D) AS p_chi2, safe_div(avg(value), stddev_samp(value)) AS ratio,
        slug(event_type || ' of / ' || count(*)) AS slug FROM n6_events GROUP BY event_type"""))


@query("n6_word_chunks", """WITH w AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN [] ELSE string_split_regex(trim(text), '\\s+') END AS words FROM documents),
c AS (SELECT doc_id, words, CAST(ceil(len(words) / 150.0) AS INTEGER) AS total_chunks FROM w WHERE len(words) > 0),
e AS (SELECT doc_id, words, total_chunks, CAST(unnest(generate_series(0, total_chunks - 1)) AS INTEGER) AS chunk FROM c)
SELECT doc_id, chunk, total_chunks, array_to_string(words[chunk * 150 + 1 : chunk * 150 + 200], ' ') AS text FROM e""")
def n6_word_chunks(spark, d):
    N.register(spark)
    load_table(spark, d, "documents").createOrReplaceTempView("n6_documents")
    return spark.sql("SELECT doc_id, c.chunk, c.total_chunks, c.text FROM n6_documents d, LATERAL word_chunks(d.text, 200, 50) c")
