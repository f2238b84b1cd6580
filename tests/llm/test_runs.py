"""Periodic run detection against brute force."""

import hashlib
import random
import time
import zlib

import pytest

from tabvet.llm import runs as R

from .data import documents, nothing
from .test_texts import words as split


def brute_runs(words):
    """Every maximal stretch of each period, kept if no smaller period holds it."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(12, 2 * q) and not any(all(words[x] == words[x - r] for x in range(start + r, j)) for r in range(1, q)):
                found.append((start, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(seed):
    rng = random.Random(seed)
    for _ in range(700):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6])
        words = []
        while len(words) < n:
            if rng.random() < 0.5 and len(words) > 2:
                period = rng.randint(1, min(len(words), 20))
                for _ in range(rng.randint(1, 30)):
                    words.append(words[-period])
            else:
                words.append(rng.randrange(kinds))
        yield words


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    for words in texts(seed):
        want = brute_runs(words)
        assert R.runs_of(words) == want
        gone = {i for start, length, q in want for i in range(start + q, start + length)}
        assert R.collapsed(words, want) == [w for i, w in enumerate(words) if i not in gone]


def test_limits_of_a_run():
    assert R.runs_of("a" * 11) == [] and R.runs_of("a" * 12) == [(0, 12, 1)]
    assert R.runs_of("abcdefg" * 2) == [(0, 14, 7)] and R.runs_of("abcdefg" + "abcdef") == []
    assert R.runs_of("x" + "ab" * 6 + "y") == [(1, 12, 2)]
    assert R.runs_of(("a" * 12 + "b") * 2) == [(0, 12, 1), (0, 26, 13), (13, 12, 1)]


def test_long_repetitions_stay_cheap():
    began = time.time()
    assert R.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert R.runs_of(list(range(40)) * 2_500) == [(0, 100_000, 40)]
    assert len(R.runs_of((["a"] * 50 + ["b"]) * 1_000)) == 1_001
    assert time.time() - began < 20


def want(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{x},{p}\n" for s, x, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), start, length, q, length and 1000 * length // q, *digest)


def test_query_equals_brute_force(spark, tmp_path):
    changed = next(i for i in range(50, 5000) if zlib.crc32(str(i).encode()) % 10 == 0)
    base = " ".join(f"v{i % 23}" for i in range(90))
    extra = [
        (changed, "one two three four five six seven eight nine ten " * 4, "en", "a", 0, 0, None, None, None, None),
        (1001, base, "en", None, None, None, None, None, None, None), (1001, base, "en", None, None, None, None, None, None, None),
        (1002, "no\x85run\xa0here " * 13, "en", "a", 0, 0, None, None, None, None), (1003, "ha " * 500, None, None, 0, 0, None, None, None, None),
    ]
    docs = documents(spark, extra).where("length(text) < 30000 or text is null")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in R.op11(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((want(r.doc_id, r.text) for r in docs.collect()), key=str)


def test_awkward_tables(spark):
    assert R.text_runs(nothing(spark)).count() == 0
    assert R.text_runs(documents(spark)).count() == documents(spark).count()
