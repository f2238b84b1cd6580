"""Merkle manifest against a manifest built by hand."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabvet.llm import merkle as M

from .data import documents, nothing


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, k):
    """Proof of node k and the digest of all nodes."""
    proof = []
    while len(nodes) > 1:
        low = k // 8 * 8
        proof += [n for i, n in enumerate(nodes[low : low + 8], low) if i != k]
        nodes = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        k //= 8
    return proof, nodes[0]


def fold(nodes, k, changed):
    """The root that follows from a changed digest of node k and its siblings."""
    while len(nodes) > 1:
        low = k // 8 * 8
        run = [changed if i == k else n for i, n in enumerate(nodes[low : low + 8], low)]
        changed = H("".join(run))
        nodes = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        k //= 8
    return changed


def want(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    langs = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {}
    for s in langs:
        groups[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        leaves[s] = [leaf(r, r.text) for r in groups[s]]
    subroots = [climb(leaves[s], 0)[1] for s in langs]
    for g, s in enumerate(langs):
        for k, r in enumerate(groups[s]):
            below, subroot = climb(leaves[s], k)
            above, root = climb(subroots, g)
            text, tampered = r.text, zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 0
            if tampered and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = fold(subroots, g, fold(leaves[s], k, leaf(r, text)))
            yield r.doc_id, leaves[s][k], subroot, root, H("".join(below + above)), folded, folded == root


def more(count, lang="en"):
    return [(2000 + i, f"Text number {i} É", lang, "s", i, None, None, None, None, None) for i in range(count)]


@pytest.mark.parametrize("share", [512, 4])
@pytest.mark.parametrize("langs, count", [(0, 0), (0, 700), (11, 9), (1, 65)])
def test_query_equals_a_manifest_by_hand(spark, tmp_path, monkeypatch, langs, count, share):
    monkeypatch.setattr(M, "SHARE", share)
    extra = more(count) + [row for k in range(langs) for row in more(1 + k % 10, f"l{k}")]
    docs = documents(spark, extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in M.op12(spark, str(tmp_path)).collect())
    assert got == Counter(want(docs.collect()))
    if count == 700:
        assert {True, False} == {k[-1] for k in got}


def test_lone_rows_and_empty_tables(spark):
    one = documents(spark).where("doc_id = 7")
    own = M.leaf([F.col(c) for c in M.COLUMNS])
    r = M.verified(one, own).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == "" and r.verified
    assert M.verified(nothing(spark), own).count() == 0


def test_numbers_do_not_depend_on_the_partitions(spark):
    docs = documents(spark, more(300))
    runs = [sorted(map(str, M.verified(docs.repartition(n), M.leaf([F.col(c) for c in M.COLUMNS])).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
