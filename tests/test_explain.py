"""Explanations, neighbours, ensembles, selection and registry against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabvet.functions import sql as N
from tabvet.functions import stats
from tabvet.operators import ensemble as En
from tabvet.operators import explain as X
from tabvet.operators import neighbours as Nb
from tabvet.operators import registry_log as R
from tabvet.operators.longform import row_numbers
from tabvet.operators.train import train


@pytest.fixture(scope="module")
def table(spark):
    """600 rows, 4 features, three classes that two of the features decide."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.4, "hi", np.where(x[:, 0] < -0.7, "lo", "mid"))
    rows = [(i, *map(float, x[i]), str(y[i]), float(2 * x[i, 0] - x[i, 2] + 0.1 * rng.normal())) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y string, z double").repartition(3).cache()


FEATURES = ["a", "b", "c", "d"]


# ------------------------------------------------------------------ row numbers and permutations
def test_row_numbers_are_dense_and_ordered(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None])) for i in range(500)]
    got = row_numbers(spark.createDataFrame(rows, "id long, k int").repartition(7), [F.col("k"), F.col("id")]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.row)] == [i for i, k in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    assert sorted(r.row for r in got) == list(range(500))
    assert row_numbers(spark.createDataFrame([], "id long, k int"), [F.col("k")]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_numbers_shuffle_once_and_store_what_is_kept(spark):
    df = spark.range(300).select("id", (F.col("id") % 5).alias("k"), F.lit("x").alias("v"))
    got = row_numbers(df, [F.col("k"), F.col("id")], "row", ["v"])
    assert got.columns == ["v", "row"] and sorted(r["row"] for r in got.collect()) == list(range(300))
    assert plan_of(got).count("Window") <= 2 and "row_number()" not in plan_of(got)  # the rows are not dealt out by range again


def test_counterfactuals_need_no_sort(table):
    score = X.linear_scorer({"a": 1.0, "b": -0.5}, 0.1, 0.0)
    assert "SortAggregate" not in plan_of(X.counterfactuals(score, table, ["a", "b"], ["id"]))


def test_each_shuffled_column_is_a_permutation(table):
    rows = X.permuted_rows(table, ["a", "b"], ["id"], [F.col("id")], [F.xxhash64("id", F.lit(r)) for r in range(3)]).collect()
    want = sorted((r.a, r.b) for r in table.collect())
    for repeat in range(3):
        part = [r for r in rows if r.repeat == repeat]
        assert sorted((r.other_a, r.other_b) for r in part) == want == sorted((r.a, r.b) for r in part)
        assert sum(r.other_a == r.a for r in part) < 20


def test_permutation_importance_equals_numpy(table):
    score = X.linear_scorer({"a": 2.0, "c": -1.0, "b": 0.0, "d": 0.0})
    shuffles = [F.col("id") * (17 + r) % 601 for r in range(4)]
    got = {r.feature: r for r in X.permutation_importance(score, table, FEATURES, "z", [F.col("id")], shuffles, "r2").collect()}
    rows = sorted(table.collect(), key=lambda r: r.id)
    x, z = np.array([[r.a, r.b, r.c, r.d] for r in rows]), np.array([r.z for r in rows])

    def r2(v):
        return 1 - ((z - (2 * v[:, 0] - v[:, 2])) ** 2).sum() / ((z - z.mean()) ** 2).sum()

    for j, f in enumerate(FEATURES):
        drops = []
        for r in range(4):
            v = x.copy()
            v[:, j] = x[sorted(range(600), key=lambda i: (i * (17 + r) % 601, i)), j]
            drops.append(r2(x) - r2(v))
        assert math.isclose(got[f].importance_mean, np.mean(drops), abs_tol=1e-9) and math.isclose(got[f].importance_std, np.std(drops), abs_tol=1e-9)
        assert math.isclose(got[f].baseline, r2(x), abs_tol=1e-9)
    assert got["b"].importance_mean == 0 and got["a"].importance_mean > got["c"].importance_mean > 0.1


def test_permutation_importance_of_a_model(table):
    model = train("DecisionTree", table, FEATURES, "y")
    y = (F.array_position(F.array(*[F.lit(s) for s in model.stages[0].labels]), F.col("y")) - 1).cast("double")
    got = {r.feature: r.importance_mean for r in X.permutation_importance(X.model_scorer(model, FEATURES), table.withColumn("n", y), FEATURES, "n", [F.col("id")],
                                                                         [F.xxhash64("id", F.lit(r)) for r in range(2)]).collect()}
    assert got["a"] > got["b"] > max(got["c"], got["d"], 0.02)


# ------------------------------------------------------------------ Shapley values
def brute_shapley(leaves, x):
    """All subsets of the features."""
    p = len(x)

    def game(known):
        total = 0.0
        for leaf in leaves:
            value = leaf.value
            for j, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                value *= (low < x[j] <= high) if j in known else share
            total += value
        return total

    out = []
    for i in range(p):
        others = [j for j in range(p) if j != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(p - len(s) - 1) / math.factorial(p) * (game({*s, i}) - game(set(s)))
                       for size in range(p) for s in itertools.combinations(others, size)))
    return out


@pytest.mark.parametrize("name, target", [("RandomForest", "y"), ("DecisionTree", "y"), ("GradientBoosting", "two")])
def test_tree_attributions_equal_all_subsets(table, name, target):
    df = table.withColumn("two", F.when(F.col("a") > 0.2, "p").otherwise("n"))
    model = train(name, df, FEATURES, target)
    rows = X.tree_attributions(model, df, FEATURES, ["id"]).collect()
    assert len(rows) == 600
    leaves = X.tree_leaves(model.stages[-1])
    scored = PipelineModel(stages=model.stages[1:]).transform(df.drop("y") if target != "y" else df)
    vectors = {r.id: r for r in scored.select("id", vector_to_array("features").alias("f"), vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p")).collect()}
    for r in rows:
        assert math.isclose(r.expected + sum(r.contributions), r.score, abs_tol=1e-9)
        truth = vectors[r.id].raw[1] if name == "GradientBoosting" else vectors[r.id].p[1]
        assert math.isclose(r.score, truth, abs_tol=1e-6)
    for r in rows[:4]:
        assert r.contributions == pytest.approx(brute_shapley(leaves, vectors[r.id].f), abs=1e-9)


@pytest.mark.parametrize("kept, numbered", [(1 << 22, True), (30, True), (1 << 22, False)])
def test_shapley_values_are_made_once_for_each_cell(monkeypatch, kept, numbered):
    rng = np.random.default_rng(5)
    leaves = []
    for _ in range(40):
        f = np.sort(rng.choice(3, rng.integers(1, 4), replace=False))
        low = rng.choice([-np.inf, -1.0, 0.0], len(f))
        leaves.append(X.Leaf(rng.normal(), f, low, rng.choice([0.5, 2.0, np.inf], len(f)), rng.uniform(0.1, 0.9, len(f))))
    x = np.concatenate([rng.choice([-1.0, -0.5, 0.0, 0.5, 1.7, 2.0, 3.0, np.nan], (500, 3)), rng.normal(0, 2, (500, 3))])
    plain, made = X.shapley, []
    monkeypatch.setattr(X, "shapley", lambda leaves, x: made.append(len(x)) or plain(leaves, x))
    monkeypatch.setattr(X, "KNOWN_VALUES", kept)
    cells = X.Cells(leaves, 3)
    cells.numbered = numbered
    for at in range(0, 1000, 100):
        assert np.allclose(cells.of(x[at : at + 100]), plain(leaves, x[at : at + 100]), atol=1e-12)
    assert cells.of(x[:0]).shape == (0, 3)
    if kept > 30 and numbered:
        assert sum(made) <= 6**3  # five intervals a feature and NaN


def test_global_attributions_name_the_deciding_feature(table):
    model = train("RandomForest", table, FEATURES, "y")
    rows = X.global_attributions(X.tree_attributions(model, table, FEATURES, ["id"]), FEATURES).collect()
    assert sorted(r.feature for r in rows) == FEATURES and next(r.feature for r in rows if r["rank"] == 1) == "a"


# ------------------------------------------------------------------ counterfactuals
@pytest.mark.parametrize("desired", [None, 1.0])
def test_counterfactuals_equal_enumeration(table, desired):
    coef, scale, steps = {"a": 1.0, "b": 0.5, "c": 0.0, "d": -0.25}, {"a": 1.0, "b": 2.0, "c": 1.0, "d": 1.0}, [-1.0, -0.4, 0.4, 1.0]
    score = X.linear_scorer(coef, 0.1, 0.0)
    got = {r.id: r for r in X.counterfactuals(score, table, FEATURES, ["id"], desired, steps, 2, scale).collect()}
    assert len(got) == 600
    moves = X.lattice(FEATURES, steps)
    for row in table.collect():
        x = row.asDict()

        def cls(v):
            return 1.0 if sum(b * v[c] for c, b in coef.items()) + 0.1 >= 0 else 0.0

        own = cls(x)
        best = None
        for i, m in enumerate(moves):
            c = cls({f: x[f] + m.get(f, 0.0) * scale[f] for f in FEATURES})
            cost = sum(abs(s) for s in m.values())
            if (c == desired if desired is not None else c != own) and (best is None or (cost, i) < best[:2]):
                best = (cost, i, c)
        r = got[row.id]
        assert r.original_class == own and r.success == (best is not None)
        if best:
            assert (r.cost, r.candidate, r.achieved_class) == (pytest.approx(best[0]), best[1], best[2])
            assert r.cf_a == pytest.approx(x["a"] + moves[best[1]].get("a", 0.0) * scale["a"])
        else:
            assert r.cost is None and (r.cf_a, r.cf_d) == (x["a"], x["d"])


# ------------------------------------------------------------------ nearest rows
def brute_knn(rows, k):
    """rows: lists with None; filled rows."""
    p = len(rows[0])
    means = [np.mean([r[j] for r in rows if r[j] is not None]) if any(r[j] is not None for r in rows) else None for j in range(p)]
    out = []
    for r in rows:
        filled = list(r)
        for j in range(p):
            if r[j] is None:
                found = []
                for i, s in enumerate(rows):
                    common = [c for c in range(p) if r[c] is not None and s[c] is not None]
                    if s[j] is not None and common:
                        found.append((sum((r[c] - s[c]) ** 2 for c in common) * (p / len(common)), i, s[j]))
                found = sorted(found)[:k]
                filled[j] = float(np.mean([f[2] for f in found])) if found else means[j]
        out.append(filled)
    return out


@pytest.mark.parametrize("block_rows, crowded", [(1024, False), (32, False), (16, True)])
def test_impute_knn_equals_brute_force(spark, block_rows, crowded):
    rng = random.Random(8)
    rows = []
    for i in range(420):
        r = [7.0, 7.0, 7.0] if crowded and i % 3 == 0 else [rng.gauss(0, 1) * 5, rng.gauss(0, 3), float(rng.randrange(6))]
        rows.append([None if rng.random() < 0.15 else x for x in r])
    rows += [[None, None, None], [1e6, None, 2.0]]
    df = spark.createDataFrame([(i, *r, "keep") for i, r in enumerate(rows)], "id long, p double, q double, r double, other string").repartition(5)
    got = sorted(Nb.impute_knn(df, ["p", "q", "r"], [F.col("id")], 5, block_rows).collect(), key=lambda r: r.id)
    assert got[0].other == "keep" and len(got) == len(rows)
    for r, want in zip(got, brute_knn(rows, 5)):
        assert [r.p, r.q, r.r] == pytest.approx(want, abs=1e-9)


def test_impute_knn_asks_few_blocks_and_equal_questions_once(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, *(rng.random() if i % 3 else None for _ in range(2)), rng.random() if i % 40 else float(i % 2)) for i in range(2000)]
    opened = []
    best = Nb.Index._best
    monkeypatch.setattr(Nb.Index, "_best", lambda self, asked, k: best(self, opened.append(asked.select("query").collect()) or asked, k))
    out = Nb.impute_knn(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"], [F.col("id")], block_rows=16)
    assert out.where("a is null or b is null").isEmpty()
    different = len({r[3] for r in rows if r[1] is None})
    first, second = opened
    assert len(first) == 2 * different                      # rows of equal values ask once for each missing dimension
    assert len(second) <= 4 * len(first)                    # ordered by c, not by all three


def test_impute_knn_of_awkward_columns(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, float("nan")), (3, None, 3.0)], "id long, p double, q double")
    assert [(r.p, r.q) for r in sorted(Nb.impute_knn(df, ["p", "q"], [F.col("id")]).collect())] == [(None, 1.0), (None, 2.0), (None, 3.0)]
    assert Nb.impute_knn(df.limit(0), ["p", "q"], [F.col("id")]).count() == 0


def test_recommend_model_takes_the_nearest_earlier_run(spark):
    runs = spark.createDataFrame([(t, f"m{t % 4}", float(t % 11), float(t % 7)) for t in range(40)], "at long, model string, u double, v double")
    asked = spark.createDataFrame([(i, t, float(i % 5) + 0.3, float(i % 3)) for i, t in enumerate([-1, 0, 2, 3, 17, 40, 1000])], "k long, at long, u double, v double")
    rows = runs.collect()
    mean = {c: np.mean([r[c] for r in rows]) for c in "uv"}
    sd = {c: np.std([r[c] for r in rows]) for c in "uv"}
    for r in Nb.recommend_model(asked, runs, ["u", "v"], "k", "at").collect():
        q = next(a for a in asked.collect() if a.k == r.k)
        earlier = [x for x in rows if x["at"] < q["at"]]
        assert r.earlier_runs == len(earlier)
        if len(earlier) < 3:
            assert (r.recommended, r.confidence, r.distance) == ("RandomForest", 0.3, None)
        else:
            d = [(sum(((q[c] - x[c]) / sd[c]) ** 2 for c in "uv"), x["at"], x.model) for x in earlier]
            assert r.recommended == min(d)[2] and r.distance == pytest.approx(math.sqrt(min(d)[0])) and r.confidence == pytest.approx(min(0.5 + len(earlier) / 20, 0.9))


# ------------------------------------------------------------------ ensembles
def test_out_of_fold_scores_come_from_models_that_did_not_see_the_row(table, monkeypatch):
    seen = []

    def spy(name, df, features, target, n_classes=None, seed=42):
        model = train(name, df, features, target, n_classes, seed)
        seen.append({r.id for r in df.select("id").collect()})
        return model

    monkeypatch.setattr(En, "train", spy)
    from tabvet.operators.train import _clean, fold_column

    d = En.materialize(fold_column(_clean(table, FEATURES, "y"), ["id"], 3))
    oof = En.out_of_fold(d, ["DecisionTree"], FEATURES, "y", ["id"], 3, ["hi", "lo", "mid"])
    rows = oof.collect()
    assert sorted(r.id for r in rows) == list(range(600))
    for fold, ids in enumerate(seen):
        assert ids.isdisjoint(r.id for r in rows if r._fold == fold) and len(ids) + sum(r._fold == fold for r in rows) == 600
    assert all(math.isclose(sum(r._p_DecisionTree), 1.0, abs_tol=1e-9) for r in rows)


def test_stacking_reports_and_predicts(table):
    stack, report = En.stacking(table, FEATURES, "y", ["id"], ["LogisticRegression", "DecisionTree", "NaiveBayes", "LinearSVC"], trees=5)
    rows = {r.model: r for r in report.collect()}
    assert set(rows) == {"LogisticRegression", "DecisionTree", "NaiveBayes", "LinearSVC", "stack"} and len(stack.bases) == 3
    assert rows["stack"].accuracy > 0.85
    said = {r.id: r.predicted for r in stack.predict(table.drop("y"), ["id"]).collect()}
    truth = {r.id: r.y for r in table.collect()}
    assert len(said) == 600 and np.mean([said[i] == truth[i] for i in said]) > 0.85


def test_region_models_route_by_the_fitted_centres(table):
    regions, scores = En.region_models(table, FEATURES, "y", ["LogisticRegression", "DecisionTree"], k=3)
    rows = scores.collect()
    assert sum(r["rows"] for r in rows if r.model == "DecisionTree") == 600 and sum(r.chosen for r in rows) == 3
    assert all(r.accuracy == max(x.accuracy for x in rows if x.region == r.region) for r in rows if r.chosen)
    every = {r.id: r for r in regions.predict(table.drop("y"), ["id"]).collect()}
    few = {r.id: r for r in regions.predict(table.drop("y").where("id < 5"), ["id"]).collect()}
    assert all(every[i] == r for i, r in few.items()) and all(r.model == regions.best[r.region] for r in every.values())
    gone = next(iter(regions.best))
    regions.best = {k: v for k, v in regions.best.items() if k != gone}
    assert {r.model for r in regions.predict(table.drop("y"), ["id"]).collect() if r.region == gone} == {"vote"}


# ------------------------------------------------------------------ selection
def test_rfe_equals_least_squares_by_hand(table):
    got = {r.feature: r for r in En.rfe(table, FEATURES, F.col("z"), ["id"], n=2).collect()}
    rows = table.collect()
    x, z = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r.z for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    left, gone = list(range(4)), []
    while len(left) > 2:
        beta = np.linalg.lstsq(np.column_stack([x[:, left], np.ones(600)]), z, rcond=None)[0][:-1]
        gone.append(left.pop(int(np.argmin(np.abs(beta) * x[:, left].std(axis=0)))))
    assert {f for f, r in got.items() if r.selected} == {FEATURES[j] for j in left} == {"a", "c"}
    assert [got[FEATURES[j]]["rank"] for j in gone] == [3, 2] and [got[FEATURES[j]]["round"] for j in gone] == [1, 2]
    assert all(r["rank"] == 1 and r["round"] is None for r in got.values() if r.selected)
    assert all(r.score_before > 0.95 and r.score_after > 0.95 for r in got.values())


def test_rfe_with_a_forest_is_repeatable(table):
    y = F.when(F.col("y") == "hi", 1.0).otherwise(0.0)
    runs = [sorted(map(str, En.rfe(t, FEATURES, y, ["id"], n=2, importance=En.forest_importance(2, 10), score=En.forest_score(2, 10)).collect())) for t in (table, table)]
    assert runs[0] == runs[1] and sum("selected=True" in r for r in runs[0]) == 2


def test_feature_vote(spark):
    rows = [("a", 0.5, 0.3, 10.0), ("b", 0.3, 0.1, 4.0), ("c", 0.2, None, 1.0), ("d", 0.0, 0.0, float("nan"))]
    got = {r.feature: r for r in En.feature_vote(spark.createDataFrame(rows, "feature string, importance double, permutation double, f_score double")).collect()}
    m = np.array([[0 if x is None or x != x else x for x in r[1:]] for r in rows])
    vote = (m[:, 0] / (m[:, 0].sum() + 1e-10) + m[:, 1] / (m[:, 1].sum() + 1e-10) + (m[:, 2] - m[:, 2].min()) / (np.ptp(m[:, 2]) + 1e-10)) / 3
    assert [got[f].vote for f in "abcd"] == pytest.approx(list(vote)) and got["a"].threshold == pytest.approx(np.percentile(vote, 30))
    assert [got[f].selected for f in "abcd"] == [v >= np.percentile(vote, 30) - 1e-15 for v in vote] and [got[f]["rank"] for f in "abcd"] == [1, 2, 3, 4]


# ------------------------------------------------------------------ registry
def test_registry_states_equal_a_stack(spark):
    rng = random.Random(6)
    rows = [(f"m{rng.randrange(3)}", rng.randrange(60) if rng.random() < 0.98 else None, i, rng.choice(["register", "promote", "promote", "rollback", "rollback", "noise"]),
             rng.choice(["v1", "v2", "v3", None])) for i in range(600)]
    got = {r.seq: r for r in R.registry_states(spark.createDataFrame(rows, "model string, at long, seq long, action string, version string").repartition(4)).collect()}
    for model in ("m0", "m1", "m2"):
        stack, latest, known = [], None, set()
        for _, at, seq, action, version in sorted((r for r in rows if r[0] == model), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            applied = False
            if at is not None and action == "register" and version:
                latest, applied = version, True
                known.add(version)
            elif at is not None and ((action == "promote" and version) or (action == "rollback" and version in known)):
                stack.append(version)
                applied = True
            elif at is not None and action == "rollback" and version is None and stack:
                stack.pop()
                applied = True
            r = got[seq]
            assert (r.applied, r.latest, r.production, r.depth) == (applied, latest, stack[-1] if stack else None, len(stack))


def test_registry_compare(spark):
    log = [("m", 1, 1, "register", "v1", 0.5), ("m", 2, 2, "promote", "v1", None), ("m", 3, 3, "register", "v2", 0.7), ("m", 9, 4, "rollback", None, None),
           ("m", 4, 5, "promote", "v2", None), ("m", 8, 6, "register", "v1", 0.6), ("m", 5, 7, "promote", "v9", None), ("m", 9, 8, "rollback", None, None)]
    df = spark.createDataFrame(log, "model string, at long, seq long, action string, version string, f1 double")
    got = {r.version: r for r in R.registry_compare(df, ["f1"]).collect()}
    assert set(got) == {"v1", "v2"}
    assert (got["v1"].f1, got["v1"].registrations, got["v1"].promotions, got["v1"].production, got["v1"].latest, got["v1"].created_at) == (0.6, 2, 1, True, True, 8)
    assert (got["v2"].f1, got["v2"].production, got["v2"].latest) == (0.7, False, False)


# ------------------------------------------------------------------ SQL functions
def test_sql_functions_equal_the_dataframe_side(spark):
    N.register(spark)
    assert N.register(spark) == [] and N.registered(spark) == {*N.VECTORISED, *N.EXPRESSIONS}
    spark.createDataFrame([(3.2, 2.0, " a  b "), (None, 1.0, None), (0.0, 4.0, "")], "x double, k double, t string").createOrReplaceTempView("sql_functions")
    got = spark.sql("SELECT x, k, t, chi2_sf(x, k) AS p, t_sf_two_sided(x, k) AS q, safe_div(k, x) AS d, normalize_ws(t) AS n, slug(t) AS s FROM sql_functions").collect()
    want = spark.table("sql_functions").select(stats.chi2_sf("x", "k").alias("p"), stats.t_sf_two_sided("x", "k").alias("q")).collect()
    same = lambda a, b: a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    assert all(same(g.p, w.p) and same(g.q, w.q) for g, w in zip(got, want))
    assert [(r.d, r.n, r.s) for r in got] == [(2.0 / 3.2, "a b", "a_b"), (None, None, None), (None, "", "document")]
    chunks = spark.sql("SELECT c.* FROM sql_functions s, LATERAL word_chunks(s.t, 1, 0) c").collect()
    assert sorted((r.chunk, r.total_chunks, r.text) for r in chunks) == [(0, 2, "a"), (1, 2, "b")]
