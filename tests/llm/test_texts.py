"""Mixing, BPE, token counts and exact dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.llm import bpe as B
from tabvet.llm import exact_dedup as D
from tabvet.llm import mix as M
from tabvet.llm import token_counts as T

from .data import LONG, documents, nothing

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.mark.parametrize("digest", [D.sha256, lambda text: F.length(text) % 3])
def test_exact_dedup_equals_brute_force_also_when_digests_collide(spark, digest):
    docs = documents(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    want = Counter()
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in D.exact_dedup(docs, digest, salts=3).collect())
    assert got == want
    assert D.exact_dedup(nothing(spark)).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above


def test_mix_meets_targets_and_reruns_agree(spark):
    extra = [(1000 + i, "tok " * (i % 90), "en", "hot", 0, 0, None, None, None, None) for i in range(400)]
    docs = documents(spark, extra)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = brute_targets(sizes)
    got = M.mix_sources(docs).collect()
    size = Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r["size"]) for r in got) == size
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    targets, taken = defaultdict(set), Counter()
    for r in got:
        taken[r.source_size] += r.taken
        targets[r.source_size].add(r.target)
    for size in set(sizes.values()):  # sources of equal size are seen together
        same = [want[s] for s in sizes if sizes[s] == size]
        assert all(any(isclose(t, w, rel_tol=1e-9) for w in same) for t in targets[size])
        assert abs(taken[size] - sum(same)) <= max(2 * M.BLOCK * len(same), 0.02 * sum(same))
    assert sorted(map(str, got)) == sorted(map(str, M.mix_sources(docs.repartition(5)).collect()))
    assert M.mix_sources(nothing(spark)).count() == 0


def test_mix_texts_hold_the_taken_words(spark):
    docs = documents(spark)
    taken, texts = Counter(), Counter()
    for r in M.mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    for r in M.mix_texts(docs).collect():
        texts[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert +taken == +texts


def test_slots_are_a_permutation(spark):
    rows = spark.range(1000).select("id", F.lit(1000).cast("long").alias("n"), F.lit(3).alias("k"))
    got = [r.id for r in M.permuted(rows, "id", "n", "k").orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(got) == list(range(1000)) and got != list(range(1000))


HARD = [
    "Hello  World <|endoftext|> don't x's !'s a!'s 5's ''s", "<|startoftext|><|endoftext|>", "naïve ąć İstanbul ſharp ŉ ΣΑΣ ς", "e\u0301 \u0301x ﬁ ½²",
    "日本語 テスト 123,456.78 -- __x__ #tag @you", "\x1c\x1d a\x1cb \x85 \xa0\u2003 \u200b", "", " \t\n", "it'll they're I'VE 'S",
]


def test_bpe_equals_the_library(spark):
    lib = B.encoder(B.tokenizer_path()).library
    rows = [(i, t) for i, t in enumerate(HARD)]
    extra = [(100 + i, t, None, None, None, None, None, None, None, None) for i, t in rows]
    docs = documents(spark, extra)
    want, counts = Counter(), Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want[r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        counts[r.doc_id, len((r.text or "").encode()), len(ids), len(ids) > 2048] += 1
    assert Counter(tuple(r) for r in B.bpe(docs).collect()) == want
    assert Counter(tuple(r) for r in T.token_counts(docs).collect()) == counts
    kept = {r.doc_id: r for r in B.bpe(docs, keep_ids=True).collect()}
    assert kept[100].ids == lib.encode(HARD[0], add_special_tokens=False).ids
    assert B.bpe(nothing(spark)).count() == 0 and T.token_counts(nothing(spark)).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    enc = B.Encoder(B.tokenizer_path())
    monkeypatch.setattr(B, "CACHED", 10)
    for text in [LONG[:5000], *HARD, LONG[5000:9000]]:
        ids, decoded = enc.encode(text)
        want = enc.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == enc.library.decode(want, skip_special_tokens=False)


def test_cuts_are_certain():
    enc = B.encoder(B.tokenizer_path())
    assert not enc.joined[[9, 10, 11, 12, 13, 32]].any()
    assert enc.cut("abc,def") == ["abc", ",", "def"]
    assert "".join(enc.cut("don't")) == "don't" and "'t" in enc.cut("don't")


def test_mix_draws_are_multinomial_and_meet_the_targets(spark):
    """Shards keep their size, totals meet the slots wanted, raw counts vary as multinomial draws do, no slot comes twice."""
    rows = [(k, "w " * 400, "abc"[k % 3]) for k in range(90)]
    sources = M.materialize(M.targets(M.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")), block=4))
    raw, final = M.multinomial(sources, 100).collect(), M.shard_counts(sources, 100).collect()
    share = {r.source_no: (r.hi - r.lo) * r.all_slots for r in sources.collect()}

    def total(rows, by):
        out = {}
        for r in rows:
            out[r[by]] = out.get(r[by], 0) + r.draws
        return out

    assert total(raw, "shard") == total(final, "shard") == {k: 100 for k in range(90)}
    assert all(abs(n - share[s]) <= 1 for s, n in total(final, "source_no").items())
    counts = [r.draws for r in raw if r.source_no == 3]
    mean = sum(counts) / 90
    assert 12 < sum((c - mean) ** 2 for c in counts) / 89 < 40 and abs(mean - 50) < 2.5  # binomial variance 25
    slots = M.drawn_slots(sources, 100)
    assert slots.count() == 9000 == slots.select("source_no", "slot").distinct().count()


def test_mix_texts_agree_however_rows_are_partitioned(spark):
    rows = [(None, " ".join(f"w{k}x{i}" for i in range(40)), "en", "s") for k in range(8)] + [(1, "a b", "en", "s")] * 3 + [(2, "z " * 60, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    first, *others = [sorted(map(str, M.mix_texts(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert first and all(x == first for x in others)
