"""Near-duplicate components and vector search against brute force, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tabvet.llm import common
from tabvet.llm import jaccard_join as J
from tabvet.llm import vector_search as V
from tabvet.llm.common import read
from tabvet.llm.components import star_forest
from tabvet.llm.exact_dedup import exact_dedup
from tabvet.session import ARROW_ROWS, materialize

from .data import documents, nothing


def word_sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = [word_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_components_equal_brute_force(spark):
    """A star of many near copies, a chain, texts at the very threshold, a line that all texts share, short texts."""
    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line, original = fresh(12), fresh(150)
    texts = [" ".join(original)] + [edited(rng, original, 3) for _ in range(70)]
    chain = fresh(120)
    for i in range(12):
        texts.append(" ".join(chain[i * 6 : i * 6 + 60]))
    texts += [" ".join(line + fresh(rng.randrange(0, 40))) for _ in range(60)]
    block = fresh(18)  # 14 shingles; three of four in common and more
    texts += [" ".join(block[: 18 - k]) for k in range(8)] + ["a b c", "A  B c", "a b", "x"]
    extra = [(5000 - i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    docs = documents(spark, extra)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(tuple(r) for r in J.jaccard_components(docs).collect()) == want
    assert J.jaccard_components(nothing(spark)).count() == 0


def test_components_equal_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter(tuple(r) for r in J.jaccard_components(docs).collect()) == want


def test_bound_never_excludes_a_link(spark):
    """needed() is at most what any linked pair of these sizes shares within both prefixes, alone or in groups of other sizes."""

    def shared(n, s):
        return max(1, -(-3 * (n + s) // 7) - max(n, s) + J.prefix_length(max(n, s)))

    sizes = [(n, s) for n in range(1, 80) for s in range(1, 80) if min(n, s) >= 0.75 * max(n, s)]
    rng = random.Random(7)
    rows = [(n, n, s, s, shared(n, s)) for n, s in sizes]
    for _ in range(4000):
        a, b = sorted((rng.randrange(1, 60), rng.randrange(1, 60))), sorted((rng.randrange(1, 60), rng.randrange(1, 60)))
        linked = [shared(n, s) for n in range(a[0], a[1] + 1) for s in range(b[0], b[1] + 1) if min(n, s) >= 0.75 * max(n, s)]
        if linked:
            rows.append((*a, *b, min(linked)))
    df = spark.createDataFrame(rows, "a_lo int, a_hi int, lo int, hi int, most int")
    assert df.where(J.needed(*[F.col(c) for c in ("a_lo", "a_hi", "lo", "hi")]) > F.col("most")).count() == 0


def test_a_hot_group_is_opened_in_parts(spark, monkeypatch):
    """Unlinked variants of one text, which share most shingles, and many documents that meet one group."""
    monkeypatch.setattr(J, "PART", 4096)
    monkeypatch.setattr(J, "GROUP", 8)
    rng = random.Random(11)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts = [edited(rng, base, rng.randrange(1, 12)) for _ in range(160)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in J.jaccard_components(docs).collect()) == brute_components(rows)


def test_star_forest(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(45)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in star_forest(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def brute_search(vectors, every=20, top=20):
    found = set()
    for q, a in vectors.items():
        if q % every == 0:
            order = sorted(((-float(np.dot(a, b)), i) for i, b in vectors.items() if i != q))[:top]
            found |= {(q, rank + 1, i) for rank, (_, i) in enumerate(order)}
    return found


def test_search_small_and_awkward(spark):
    """Below one leaf the search is exhaustive: equal to brute force, ties and equal vectors included."""
    rng = np.random.default_rng(4)
    vectors = {i: [float(x) for x in rng.integers(-3, 4, 6)] for i in range(150)}
    vectors = {i: v for i, v in vectors.items() if any(v)} | {200 + i: [1.0, 2.0, 0.0, 0.0, 0.0, 1.0] for i in range(40)}
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (920, [0.0] * 6), (940, [nan] + [1.0] * 5), (960, [inf] + [1.0] * 5), (980, [None] + [1.0] * 5), (None, [1.0] * 6), (1000, [1.0]), (1020, [])]
    rows = [(i, v, 1, 1) for i, v in vectors.items()] + [(i, v, 1, 1) for i, v in odd] + [(20, vectors[20], 2, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    got = V.search(df).collect()
    scores = {(r.query_id, r["rank"]): r.score for r in got}
    want = brute_search(vectors)
    assert len(got) == len(want) == len(scores)
    for q, rank, i in want:
        assert scores[q, rank] == float(np.dot(vectors[q], vectors[i]))
    assert np.mean([(r.query_id, r["rank"], r.vec_id) in want for r in got]) > 0.99
    assert V.search(df.limit(0)).count() == 0
    assert V.search(spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0


def test_recall_with_several_leaves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    vectors = {i: x[i].tolist() for i in range(len(x))}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in V.search(df).collect()}
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    hits = [(q, int(i)) in got for q in range(0, 3000, 20) for i in np.argsort(-sims[q])[:20]]
    assert np.mean(hits) >= 0.9


def test_recall_with_varied_norms(spark):
    """Large vectors are everybody's neighbours; no node may lose its own edges to them, no query may end open."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 24))[rng.integers(0, 300, 30_000)] + 0.6 * rng.normal(size=(30_000, 24))
    x *= (rng.lognormal(0, 0.5, 30_000) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {(r.query_id, r.vec_id) for r in V.search(df).collect()}
    hits = []
    for q in range(0, len(x), 20):
        sims = x @ x[q]
        sims[q] = -np.inf
        hits += [(q, int(i)) in got for i in np.argpartition(-sims, 20)[:20]]
    assert np.mean(hits) >= 0.98


def test_forward_edges_to_popular_nodes_stay(spark):
    rows = [(i, [0] + [x for x in (i - 1, i + 1) if 0 < x < 3000]) for i in range(1, 3000)] + [(0, [1, 2])]
    graph = spark.createDataFrame(rows, "node long, near array<long>").withColumn("card", F.col("node").cast("string").cast("binary"))
    pairs = {(r.centre, r.member) for r in V.edges(graph, 4).collect()}
    assert all((c, m) in pairs for c, near in rows for m in near)
    met = {r.centre: len(r.members) for r in V.neighbourhoods(graph, 4).collect()}
    assert sum(met.values()) == len(pairs) and max(met.values()) <= 3 + 4


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P
    from tabvet.session import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in P.STAGES]
    good = materialize(stages[0](spark, docs, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == P.COLUMNS and all(i in kept for i, q in labels.items() if q)
    single = materialize(stages[1](spark, good, sf))
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in single.collect()} == set(first.values())
    apart = materialize(stages[2](spark, single, sf))
    comps = brute_components([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id for r in apart.collect()} == {c for _, _, c in comps}
    mix = materialize(stages[3](spark, apart, sf))
    assert mix.columns == P.COLUMNS
    size = {r.doc_id: len(r.text.encode().split()) for r in apart.collect()}
    taken = Counter()
    for r in mix.collect():
        taken[r.doc_id] += len(r.text.encode().split())
    assert all(n <= 3 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())
    out = stages[4](spark, mix, sf)
    assert out.count() == mix.count() and out.where("size(ids) <> n_tokens").count() == 0


def test_pipeline_keeps_one_row_of_each_text(spark):
    """Repeated ids, null ids and repeated rows: every text stays once, with the row of the smallest id."""
    import corpus_pipeline as P

    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcd")
    near = d.split()
    near[30] = "changed"
    rows = [(5, a), (5, b), (3, b), (7, a), (None, c), (None, c), (9, c), (None, d), (None, " ".join(near)), (11, "x y z"), (11, "x  y z"), (None, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    single = P.without_copies(spark, docs, "")
    want = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert single.columns == P.COLUMNS
    assert Counter((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) for r in single.collect()) == Counter(want.items())
    apart = Counter((r.doc_id, r.text) for r in P.without_near_copies(spark, docs, "").collect())
    assert sum(apart.values()) == 7 and apart[5, a] == apart[3, b] == apart[9, c] == apart[None, None] == apart[12, ""] == 1
    assert apart[None, d] + apart[None, " ".join(near)] == 1 and apart[11, "x y z"] + apart[11, "x  y z"] == 1


def test_pipeline_asks_exact_dedup_about_every_row(spark, monkeypatch):
    """The dedup stage runs the operator on all rows; ties of one id go to the normalised text, then to smaller values."""
    import corpus_pipeline as P

    asked = []

    def noted(docs):
        asked.append([r.text for r in docs.select("text").collect()])
        return exact_dedup(docs)

    monkeypatch.setattr(P, "exact_dedup", noted, raising=False)
    rows = [(1, "a  b", "aa", "s", 0), (1, "a b", "zz", "s", 9), (1, "a b", "yy", "s", 8), (1, "a b", None, "s", 9), (None, "a b", "aa", "s", 0),
            (None, "c\nd", "en", "s", 4), (None, "c\td", "en", "s", 5), (None, "c\td", "en", "s", 5), (2, "e", "en", "s", 1), (2, "f", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in P.without_copies(spark, docs, "").collect()]
    assert Counter(out) == Counter([(1, "a b", None, "s", 9), (None, "c\td", "en", "s", 5), (2, "e", "en", "s", 1), (2, "f", "en", "s", 1)])
    assert len(asked) == 1 and Counter(asked[0]) == Counter(r[1] for r in rows)


def test_python_steps_hold_few_texts_and_sets(spark, sf, monkeypatch):
    asked = []

    def noted(df, arrow_rows=None):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            asked.append(arrow_rows)
        return materialize(df, arrow_rows)

    monkeypatch.setattr(J, "materialize", noted)
    J.jaccard_components(read(spark, sf, "documents").limit(60)).count()
    assert asked and all(x and x <= 1_000 for x in asked)


def test_a_report_counts_a_bounded_chunk(spark, monkeypatch):
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "concat('same words in every single text ', id) AS text")
    monkeypatch.setattr(J, "CHUNK", 1)  # each text is a chunk: nothing repeats in it
    assert J.first_pass(docs).where("token is not null").isEmpty()
    monkeypatch.setattr(J, "CHUNK", 1 << 21)
    assert not J.first_pass(docs).where("token is not null").isEmpty()


def test_slices_lose_nothing_and_stay_small(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 10)
    for texts in ([], [None], ["a" * 25], ["abc", None, "d" * 40, "", "ef", "ghi", "j" * 9, "k"]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["i", "t"])
        cut = list(common.slices(iter([batch]), 1))
        assert [r for b in cut for r in b.to_pylist()] == batch.to_pylist()
        sizes = [[len(t or "") for t in b.column(1).to_pylist()] for b in cut]
        assert all(sum(x) - max(x, default=0) <= 10 for x in sizes)


def test_arrow_rows_hold_while_a_table_is_written(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(ARROW_ROWS)
    out = materialize(spark.range(10, numPartitions=1).mapInArrow(run, "n long"), 3)
    assert sorted(r.n for r in out.collect()) == [1, 3, 3, 3] and spark.conf.get(ARROW_ROWS) == before
