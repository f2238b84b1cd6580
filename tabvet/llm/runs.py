"""Periodic run detection: stretches of words that repeat with a fixed period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(12, 2 * q) that no neighbouring word extends with the same period.

Method: an online sparse diagonal DP over the words of one text. Cell (i, lag) holds the number of words up to word i
that equal the word `lag` before them; only lags with a match are held. Each word's earlier occurrences raise the match
length of their lag, and a diagonal that the word does not continue ends there: if it is long enough its run is emitted
at once. Three facts keep the diagonals few, and none of them loses a run:

* a run's diagonal has at least max(12 - q, q) >= 6 matches, so a lag becomes active when the last `SEED` words occurred
  before, not when one word did (a match length is kept as the word where it began);
* a lag that cannot reach its length before the text ends is not opened;
* inside an active run of period q, lags of 2 * q and more whose earlier occurrence lies in the same run are not opened.
  They would be emitted only if the run were theirs, which needs q to divide the lag, so that q is the smaller period; a
  lag whose stretch leaves the run is opened at the first occurrence outside, and reaches back over the words before.

A diagonal is dropped when another that ends with it has the same first word and a period that divides its own.

Documents are rows of Spark partitions and are cut by nothing else; a task holds one batch of rows and the words of
one text. Defined results: null and empty texts have no words, no runs and four nulls; a null doc_id counts as the empty
id in crc32; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import WORDS, read, text_or_empty

WORD = re.compile(WORDS)
SHORTEST = 12
SEED = 6

Run = tuple[int, int, int]


def runs_of(words: Sequence) -> list[Run]:
    """All runs of a sequence of words as (start, length, period), by start, then period."""
    total = len(words)
    contexts = list(zip(*(words[k:] for k in range(SEED))))
    if len(set(contexts)) == len(contexts):
        return []  # no diagonal ever holds `SEED` matches
    runs: list[Run] = []
    seen: dict[tuple, list[int]] = {}
    active: dict[int, int] = {}  # lag -> first word of its match, so the match length is i - first + 1
    for i, context in enumerate(contexts, SEED - 1):
        if active:
            word = words[i]
            ended = [lag for lag in active if words[i - lag] != word]
            if ended:
                runs += emitted(active, ended, i)
                for lag in ended:
                    del active[lag]
        earlier = seen.setdefault(context, [])
        if earlier:
            for p in places(earlier, active, i, total):
                lag = i - p
                if lag not in active:
                    j = i + 1 - SEED
                    while j > lag and words[j - 1] == words[j - 1 - lag]:
                        j -= 1
                    active[lag] = j
        earlier.append(i)
    runs += emitted(active, list(active), total)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def places(earlier: list[int], active: dict[int, int], i: int, total: int) -> list[int]:
    """The earlier occurrences of the context of word i whose lags may still be emitted."""
    low = bisect_left(earlier, 2 * i - total - SEED + 1)  # lag <= words left + seed
    found: list[int] = []
    # the active runs whose words up to i hold two periods, the longest period first
    for lag, j in sorted(((lag, j) for lag, j in active.items() if i - j + 1 >= lag), reverse=True):
        first, last = bisect_left(earlier, j - lag + SEED - 1), bisect_right(earlier, i - 2 * lag)
        if low < last:
            found += earlier[low:first]
            low = max(low, last)
    return found + earlier[low:]


def emitted(active: dict[int, int], lags: list[int], end: int) -> list[Run]:
    """Runs of the lags whose match ended before word `end`."""
    runs: list[Run] = []
    for lag in sorted(lags):
        start = active[lag] - lag
        length = end - start
        if length >= max(SHORTEST, 2 * lag) and not any(s == start and lag % q == 0 for s, _, q in runs):
            runs.append((start, length, lag))
    return runs


def collapsed(words: Sequence[str], runs: Sequence[Run]) -> list[str]:
    """The words that no run holds after its first period."""
    kept, until = [], 0
    spans = sorted((start + period, start + length) for start, length, period in runs)
    for low, high in spans:
        if low > until:
            kept += words[until:low]
        until = max(until, high)
    return kept + list(words[until:])


def repeated(words: list[str], doc_id: int | None) -> list[str]:
    """The contract's change: in one document of ten, the words from a on repeat with a period drawn from crc32."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def text_runs(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period) and collapsed text of docs(doc_id, text).

    change(words, doc_id), if given, makes the words that are searched from those of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = WORD.findall(text.as_py())
                words = change(words, doc_id) if change else words
                runs.append(found := runs_of(words))
                texts.append(" ".join(collapsed(words, found)))
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            columns = [batch.column(0), pa.array(rows, RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_runs(read(spark, sf_dir, "documents"), repeated)
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal six-word contexts stand for the diagonals; islands of such pairs at one lag are their matches.
OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents),
s AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM s),
words AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
seeds AS (
  SELECT doc_id, i, md5(concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o)) AS seed
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(word, 5) OVER o IS NOT NULL),
cells AS (SELECT b.doc_id, b.i - a.i AS lag, b.i FROM seeds a JOIN seeds b ON a.doc_id = b.doc_id AND a.seed = b.seed AND a.i < b.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM cells),
diagonals AS (
  SELECT doc_id, lag, min(i) - lag AS start, max(i) + 6 - min(i) + lag AS length FROM islands GROUP BY doc_id, lag, island),
long_ones AS (SELECT * FROM diagonals WHERE length >= greatest(12, 2 * lag)),
runs AS (
  SELECT doc_id, start, length, min(lag) AS period FROM long_ones GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id),
per_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
         first(period ORDER BY length DESC, start, period) AS period
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per_doc r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
