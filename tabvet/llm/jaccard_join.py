"""N-gram Jaccard self-join through a token-group matrix (exact at the given threshold).

A document's set holds the hashes of its distinct `WIDTH`-word shingles. Documents with equal sets are one class; all
work is on classes. Two sets link when 100 * intersection >= 75 * union.

1. Order. Shingles that many documents share come last in one global order: every task reports the shingles that repeat
   within its chunks, the `HEAVY` most reported are broadcast (fixed size). Any common order gives the same links, the
   list only keeps popular shingles out of the way. A linked pair shares a shingle among the first n - ceil(0.75 n) + 1
   of each side, so only these prefixes are dealt out by shingle; shingles of a single class go at once.
2. Groups. Each shingle names the document that its holders resemble most (largest mean popularity of its prefix);
   documents are compared with the few hubs they are sent to, and stars of verified links form the first components:
   copies of one text meet their hub, not each other. Groups of about `GROUP` similar documents are parts of one star,
   or documents that name the same hub without being linked to it.
3. Token-group matrix. The union of the prefixes of a group is a row of the matrix, stored as (shingle, group). Rows of
   the matrix meet over shared shingles, group against group: the number of shingles that two unions share bounds the
   overlap of every query of the one with every member of the other (see `needed`). Queries meet only the groups that
   their own group passes.
4. Only groups that pass are opened: the bound is taken again for each query over the group's full union, and then the query
   is compared with all members in one pass over the group's shingles. The links join the components. A group's sets
   travel once for each `PART` bytes of queries, not once a query.

Sets are recomputed from the texts for those documents only that some comparison needs. A Bloom filter of fixed size
picks them on the map side, so texts are never shuffled; a filter that is too full only lets more sets through.

Defined results: null text and text without words have an empty set, no links, and are their own component; fewer than
`WIDTH` words make one shingle; a component's id is its smallest doc_id, null ids aside (a component of null ids only
has a null id); repeated rows and copies share class and component; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from xxhash import xxh3_64_intdigest

from tabvet.llm.common import TEXT_ROWS, read, slices, text_or_empty
from tabvet.llm.components import star_forest
from tabvet.session import materialize, release

WIDTH = 5
PERCENT = 75
HEAVY = 1 << 17
CHUNK = 1 << 21  # shingles that a task counts at once for its report
REPORT = 1 << 16
GROUP = 64
FILTER_BITS = 1 << 24
PART = 1 << 20  # bytes of the queries' sets that meet one copy of a group's sets
OPEN_ROWS = 32  # of rows with the sets of a group and of `PART` bytes of queries, so many are an Arrow batch


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a whole text; A-Z are lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    acc = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        acc = (acc ^ h[j : j + len(acc)]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc = acc * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((acc ^ (acc >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def class_of(found: np.ndarray) -> tuple[bytes, int]:
    """128-bit digest of a set, and its first 63 bits as the class's number."""
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little") >> 1


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def prefix(found: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by hash, then the heavy ones by rank."""
    key = found.astype(np.uint64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
        is_heavy = heavy[at] == found
        key[is_heavy] = np.uint64(1 << 63) + rank[at[is_heavy]].astype(np.uint64)
    p = prefix_length(len(found))
    return found[np.argpartition(key, p - 1)[:p]]


def needed(a_lo: Column, a_hi: Column, lo: Column, hi: Column) -> Column:
    """Least number of shingles in both unions that a link between members of two groups asks for, by their sizes' ranges.

    With sizes n and s a link needs 3/7 (n + s) common shingles, and at most the larger set's size less its prefix can
    lie beyond both prefixes. That rises with the smaller set and falls with the larger one, so the smallest feasible
    small set with the largest that may link to it gives the bound, for either group as the one with the smaller sets."""
    ratio = F.lit(PERCENT / 100)

    def least(small: Column, top: Column) -> Column:
        return F.floor(F.lit(3.0 / 7.0) * small - (ratio - F.lit(3.0 / 7.0)) * F.least(top, small / ratio) + F.lit(1e-6))

    return F.greatest(F.lit(1), F.least(least(F.greatest(a_lo, lo * ratio), hi), least(F.greatest(lo, a_lo * ratio), a_hi)))


def first_pass(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, class, digest, n) and, with `token` set, the tasks' reports (token, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "class", "digest", "token", "n"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        seen: set[bytes] = set()
        chunk: list[np.ndarray] = []
        held = 0

        def report() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(chunk), return_counts=True) if chunk else (np.zeros(0, np.int64),) * 2
            chunk.clear()
            tokens, n = tokens[n > 1], n[n > 1]
            if len(n) > REPORT:
                top = np.argpartition(-n, REPORT)[:REPORT]
                tokens, n = tokens[top], n[top]
            none = [pa.nulls(len(n), k) for k in kinds[:3]]
            return pa.RecordBatch.from_arrays([*none, pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names)

        for batch in slices(batches, 1):
            classes, digests, sizes = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                digest, number = class_of(found)
                classes.append(number)
                digests.append(digest)
                sizes.append(len(found))
                if digest not in seen and len(found):
                    seen.add(digest)
                    chunk.append(found)
                    held += len(found)
                    if held > CHUNK:
                        yield report()
                        held = 0
            if len(seen) > 1 << 18:
                seen.clear()
            columns = [batch.column(0), pa.array(classes, kinds[1]), pa.array(digests, kinds[2]), pa.nulls(len(sizes), kinds[3]), pa.array(sizes, kinds[4])]
            yield pa.RecordBatch.from_arrays(columns, names)
        yield report()

    return docs.mapInArrow(run, "doc_id long, class long, digest binary, token long, n long")


def heavy_shingles(reports: DataFrame, limit: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their rank in the common order): at most `limit`, the rarer first in rank."""
    best = reports.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    tokens, n = best.column("token").to_numpy(), best.column("n").to_numpy()
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((tokens, n))] = np.arange(len(n))
    by_token = np.argsort(tokens)
    return tokens[by_token].astype(np.int64), rank[by_token]


def prefix_rows(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, class, n: the prefix of every class, at least once."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1):
            tokens, classes, sizes = [np.zeros(0, np.int64)], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                number = class_of(found)[1]
                if len(found) and number not in seen:
                    seen.add(number)
                    tokens.append(prefix(found, *shared.value))
                    classes.append(number)
                    sizes.append(len(found))
            if len(seen) > 1 << 18:
                seen.clear()
            each = [len(t) for t in tokens[1:]]
            columns = [np.concatenate(tokens), np.repeat(np.array(classes, np.int64), each), np.repeat(np.array(sizes, np.int32), each)]
            whole = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["token", "class", "n"])
            for i in range(0, whole.num_rows, 100_000):
                yield whole.slice(i, 100_000)

    return docs.mapInArrow(run, "token long, class long, n int")


def sets_of(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, n, tokens (the sorted set as 64-bit integers) of the classes in wanted(class)."""
    ids = members.join(wanted.select("class").distinct(), "class").groupBy("class").agg(F.min(F.xxhash64("doc_id")).alias("h"))
    slot = F.pmod("h", F.lit(FILTER_BITS))
    words = ids.select((slot / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(h, 32) as int))").alias("bit"))
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h = batch.column(2).to_numpy()
            there = np.flatnonzero(shared.value[h // 32] >> (h % 32).astype(np.uint32) & np.uint32(1))
            sets = [s for s in (shingles(batch.column(1)[int(i)].as_py()) for i in there) if len(s)]
            classes = pa.array([class_of(s)[1] for s in sets], pa.int64())
            columns = [classes, pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "n", "tokens"])

    hashed = docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    found = hashed.mapInArrow(run, "class long, n int, tokens binary")
    return found.join(wanted.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])


def opened(rows: DataFrame) -> DataFrame:
    """(u, v) linked, from rows(queries, members: arrays of struct(class, tokens)): bound by the union, then open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for queries, members in zip(batch.column(0), batch.column(1)):
                found = members.as_py()
                parts = [np.frombuffer(m["tokens"], np.int64) for m in found]
                matrix = np.concatenate(parts)
                owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                sizes = np.array([len(p) for p in parts])
                for q in queries.as_py():
                    query = np.frombuffer(q["tokens"], np.int64)
                    at = np.minimum(np.searchsorted(query, matrix), len(query) - 1)
                    hits = query[at] == matrix
                    if 100 * np.count_nonzero(np.bincount(at[hits], minlength=1)) < PERCENT * len(query):
                        continue  # the union holds too few of the query's shingles
                    common = np.bincount(owner[hits], minlength=len(parts))
                    for i in np.flatnonzero(100 * common >= PERCENT * (len(query) + sizes - common)):
                        if found[i]["class"] != q["class"]:
                            us.append(q["class"])
                            vs.append(found[i]["class"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def hub_pairs(rows: DataFrame) -> DataFrame:
    """q, s, votes: each class with the hubs that many of its prefix shingles name."""
    prefix_size = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1")
    popular = rows.groupBy("class").agg((F.sum("df") / F.first(prefix_size)).alias("score"), F.count(F.lit(1)).alias("mine"))
    scored = rows.join(popular, "class")
    hubs = scored.groupBy("token").agg(F.max(F.struct("score", "class", "n")).alias("hub"))
    sent = scored.where((F.col("mine") >= 0.4 * prefix_size)).join(hubs, "token").where("class <> hub.class")
    sent = sent.groupBy("class", F.col("hub.class").alias("s"), "n", F.col("hub.n").alias("hub_n"), "mine").agg(F.count(F.lit(1)).alias("votes"))
    near = sent.where(f"votes >= 0.25 * mine and 100 * least(n, hub_n) >= {PERCENT} * greatest(n, hub_n)")
    return near.select(F.col("class").alias("q"), "s", "votes")


def with_sets(pairs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """queries, members: the sets of pairs(q, s), those of a group's queries together with the group's members(s, members).

    A group that many queries meet is dealt out in parts of about `PART` bytes of queries."""
    mine = sets.select(F.col("class").alias("q"), "n", "tokens")
    sized = materialize(pairs.join(mine.select("q", "n"), "q"))
    parts = sized.groupBy("s").agg(F.ceil(8 * F.sum("n") / PART).cast("int").alias("parts"))
    dealt = sized.join(parts, "s").select("q", "s", F.pmod(F.xxhash64("q"), F.col("parts")).alias("part"))
    asked = dealt.join(mine.select("q", "tokens"), "q").groupBy("s", "part").agg(F.collect_list(F.struct(F.col("q").alias("class"), "tokens")).alias("queries"))
    return asked.join(members, "s").select("queries", "members")


def similar_groups(classes: DataFrame, stars: DataFrame, pairs: DataFrame) -> DataFrame:
    """class, n, s, star for classes(class, root, n): groups of about `GROUP` similar documents.

    Members of a star share groups with members of the same star, whose root is the group's `star`. The others go with
    those that name the same first hub, without being linked to it, or stay alone; their `star` is null."""
    inside = stars.select(F.col("node").alias("class")).union(stars.select("root")).distinct().withColumn("starred", F.lit(True))
    hubs = pairs.groupBy(F.col("q").alias("class")).agg(F.max_by("s", F.struct("votes", "s")).alias("hub"))
    keyed = classes.join(inside, "class", "left").join(hubs, "class", "left").withColumn("star", F.when(F.col("starred"), F.col("root")))
    keyed = keyed.withColumn("key", F.xxhash64(F.col("star").isNotNull(), F.coalesce("star", "hub", "class")))
    chunks = keyed.groupBy("key").agg(F.expr(f"(count(1) + {GROUP - 1}) div {GROUP}").alias("chunks"))
    chunk = F.pmod(F.xxhash64("class"), F.col("chunks"))
    return keyed.join(chunks, "key").select("class", "n", F.xxhash64("key", chunk).alias("s"), "star")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    first = materialize(first_pass(texts), TEXT_ROWS)
    members = first.where("token is null").select("doc_id", "class", "digest", "n")
    clash = members.groupBy("class").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    if not clash.isEmpty():
        raise ValueError("two sets share a 63-bit class number; change the digest")
    heavy = heavy_shingles(first.where("token is not null").select("token", "n"))

    every = Window.partitionBy("token")
    rows = prefix_rows(texts, heavy).withColumn("a", F.min("class").over(every)).withColumn("b", F.max("class").over(every))
    rows = rows.where("a < b").groupBy("token", "class").agg(F.first("n").alias("n"))
    rows = materialize(rows.withColumn("df", F.count(F.lit(1)).over(every)), TEXT_ROWS)

    # groups of similar documents: stars of verified links around hubs
    pairs = materialize(hub_pairs(rows))
    sets = materialize(sets_of(texts, members, pairs.select(F.col("q").alias("class")).union(pairs.select("s"))), TEXT_ROWS)
    alone = sets.select(F.col("class").alias("s"), F.array(F.struct("class", "tokens")).alias("members"))
    links = materialize(opened(with_sets(pairs, sets, alone)), OPEN_ROWS)
    release(sets)
    stars = star_forest(links)

    # token-group matrix over groups of similar documents
    named = rows.join(stars.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = named.withColumn("a", F.min("root").over(every)).withColumn("b", F.max("root").over(every)).where("a < b").drop("a", "b", "df")
    grouped = materialize(similar_groups(named.select("class", "root", "n").distinct(), stars, pairs))
    ranges = grouped.groupBy("s").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    named = materialize(named.join(grouped.select("class", "s", "star"), "class"))
    release(rows)
    matrix = materialize(named.groupBy("token", "s", "star").agg(F.count(F.lit(1)).alias("holders")).join(ranges, "s"))
    release(named)
    others = matrix.select("token", F.col("s").alias("a"), F.col("star").alias("a_star"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    meets = f"(a > s or a = s and holders > 1) and not coalesce(star = a_star, false) and 100 * hi >= {PERCENT} * a_lo and 100 * a_hi >= {PERCENT} * lo"
    near = others.join(matrix, "token").where(meets).groupBy("a", "s", "a_lo", "a_hi", "lo", "hi").agg(F.count(F.lit(1)).alias("common"))
    near = near.where(F.col("common") >= needed(F.col("a_lo"), F.col("a_hi"), F.col("lo"), F.col("hi"))).select("a", "s", "lo", "hi")
    sized = grouped.select(F.col("class").alias("q"), "n", F.col("s").alias("a"))
    met = materialize(near.join(sized, "a").where(f"100 * hi >= {PERCENT} * n and 100 * n >= {PERCENT} * lo").select("q", "s"))
    release(matrix)

    open_groups = grouped.join(met.select("s").distinct(), "s", "left_semi").select("s", "class")
    sets = materialize(sets_of(texts, members, met.select(F.col("q").alias("class")).union(open_groups.select("class"))), TEXT_ROWS)
    inside = open_groups.join(sets.select("class", "tokens"), "class").groupBy("s").agg(F.collect_list(F.struct("class", "tokens")).alias("members"))
    found = materialize(opened(with_sets(met, sets, inside)), OPEN_ROWS)
    release(sets)
    roots = star_forest(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))

    # names: the smallest doc_id of each component
    classes = members.groupBy("class").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "class"), "class", "left")
    classes = materialize(classes.withColumn("root", F.coalesce("root", "class")))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named_classes = classes.join(ids, "root").select("class", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(named_classes, "class").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
