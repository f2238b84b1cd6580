"""Token counts through a two-tier lookup on the map side.

Tier one: the lengths of the corpus's most frequent pre-tokens (ASCII white-space fragments), broadcast as one hash
table of at most `FREQUENT` entries of at most `LONGEST` characters each. It is learnt from about `SAMPLE` documents (the
smallest hashes of the id): every task counts its own fragments and reports its `PER_TASK` most frequent ones, the reports
are summed, and the driver encodes the winners. Only these bounded reports move; the pre-tokens themselves are never
shuffled. The table only saves time: a fragment that it lacks is counted all the same, with the same result.
Tier two: the misses of many texts together are encoded by forced-boundary pieces (see `bpe`) and kept in a worker's
cache, which is emptied at `CACHED` entries; longer fragments are encoded but not kept.

Defined results: null text counts as empty: no bytes, no tokens, not over the limit. Special strings in a text count as
the library counts them. Texts are counted whole whatever their length; repeated rows alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.bpe import CACHED, Encoder, encoder, tokenizer_path
from tabvet.llm.common import read, text_or_empty

FREQUENT = 65_536
PER_TASK = 8_192
COUNTED = 400_000
SAMPLE = 20_000
LONGEST = 64
TOGETHER = 1 << 21  # characters of the texts whose misses are encoded together


def frequent_fragments(docs: DataFrame, limit: int = FREQUENT) -> list[str]:
    """At most `limit` fragments, the most frequent of a sample of the corpus by the tasks' reports."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(Encoder.split(text.as_py()))
                if len(seen) > COUNTED:
                    seen = Counter({k: v for k, v in seen.items() if v > 2})
                    if len(seen) > COUNTED // 2:
                        seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = [(k, v) for k, v in seen.most_common(PER_TASK) if len(k) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["fragment", "n"])

    share = SAMPLE / max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))
    reports = chosen.select(text_or_empty().alias("text")).mapInArrow(report, "fragment string, n long")
    best = reports.groupBy("fragment").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "fragment").limit(limit)
    return [r.fragment for r in best.select("fragment").collect()]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    path = path or tokenizer_path()
    enc = encoder(path)
    common = frequent_fragments(docs)
    lengths = dict(zip(common, enc.lengths(common)))
    table = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, frequent = encoder(path), table.value
        known = _lengths(path, frequent)
        for batch in batches:
            counts: list[int] = []
            waiting: list[tuple[int, list[str]]] = []  # texts whose misses are not counted yet
            held = 0

            def settle() -> None:
                missing = {f for _, misses in waiting for f in misses}
                if len(known) + len(missing) > len(frequent) + CACHED:
                    known.clear()
                    known.update(frequent)
                found = dict(zip(missing, enc.lengths(list(missing))))
                for at, misses in waiting:
                    counts[at] += sum(map(found.__getitem__, misses))
                known.update((f, n) for f, n in found.items() if len(f) <= LONGEST)
                waiting.clear()

            for text in batch.column(2):
                text = text.as_py()
                fragments = enc.split(text)
                lengths = list(map(known.get, fragments))
                if None in lengths:
                    waiting.append((len(counts), [f for f, n in zip(fragments, lengths) if n is None]))
                    held += len(text)
                counts.append(sum(filter(None, lengths)))
                if held > TOGETHER:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


_LENGTHS: dict[str, dict[str, int]] = {}


def _lengths(path: str, frequent: dict[str, int]) -> dict[str, int]:
    """The worker's lookup: the frequent lengths, and what the worker has encoded itself."""
    known = _LENGTHS.setdefault(path, {})
    if not known:
        known.update(frequent)
    return known


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
