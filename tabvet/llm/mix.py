"""Mixing sources to target weights: fixed-length blocks drawn through index permutations (DataFrame functions only).

1. Targets. Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share 100 % of all words; a target stops
   at `max_epochs` times its source's words and the excess goes to the others by weight. That is water filling: with
   sources sorted by cap / weight, the level is the largest of (rest of the words) / (rest of the weights).
2. Blocks. A source's documents form one stream of words, cut into blocks of `block` words. Positions come from lanes
   (hash of id, size and text) of about `LANE_ROWS` rows, so no window holds a whole source: totals per lane are summed first.
3. Draws. Each output shard of `shard` slots draws its source counts: a multinomial draw, one hashed uniform a slot, counted
   per shard and source. Such totals miss a target by 1 / sqrt(blocks), 7 % for 200 blocks; so a last step brings them to
   the targets: sources drawn too often give slots back, evenly over the shards, and those drawn too rarely get them.
4. Slots. Slot j of a source reads block permutation(j mod blocks): a swap-or-not permutation keyed by the source, so
   every block is read floor or ceil of the mean number of times and never more than `max_epochs` times.
5. Slots and blocks meet by (source, block index); the words of a block belong to the documents it spans.

Everything is a hash of ids, texts and positions, so reruns agree, however the rows are partitioned. Nulls: a null source is a source of its own, null text has
no words. Documents without words take part with nothing taken. Repeated rows are separate documents of the stream.
An empty table gives no rows. Names of other columns do not matter; `mix_texts` keeps only the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabvet.llm.common import WORDS, read, text_or_empty
from tabvet.session import materialize

BLOCK = 64
SHARD = 65536
LANE_ROWS = 4096
MAX_EPOCHS = 3
ROUNDS = 12
CELLS = 1024
SPAN = 1024


def uniform(*cols) -> Column:
    """Pseudorandom number in [0, 1) of the given values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and digest, which tells rows of one doc_id and size apart."""
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long").alias("size"), digest(docs))


def digest(docs: DataFrame) -> Column:
    return F.xxhash64(*[c for c in ("text", "lang") if c in docs.columns]).alias("digest")


def targets(sizes: DataFrame, block: int = BLOCK, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_no, weight, source_size, target, blocks, and its share [lo, hi) of all slots.

    The windows run over one row per source."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.orderBy("ratio", "source_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.pmod(F.col("source_no") - 1, F.lit(3)) + 1)
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(here),
        )
        .withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("run", F.sum("slots").over(upto))
        .withColumn("all_slots", F.max("run").over(every))
        .withColumn("hi", F.when(F.col("all_slots") > 0, F.col("run") / F.col("all_slots")).otherwise(0.0))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0.0)))
        .withColumn("all_slots", F.round("all_slots").cast("long"))
        .select("source", "source_no", "weight", "source_size", "docs", "target", "blocks", "lo", "hi", "all_slots")
    )


def by_share(slots: DataFrame, at: str, shares: DataFrame) -> DataFrame:
    """`slots` with the source_no of the interval [lo, hi) of `shares` in which column `at` lies.

    Intervals and slots meet by cells of the unit interval: at most `CELLS` rows more than there are sources."""
    last = F.greatest(F.ceil(F.col("hi") * CELLS) - 1, F.floor(F.col("lo") * CELLS)).cast("long")
    cells = shares.where("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("long"), last)).alias("cell"))
    met = slots.withColumn("cell", F.floor(F.col(at) * CELLS).cast("long")).join(cells, "cell")
    return met.where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("cell", "lo", "hi")


def running(df: DataFrame, of: str, name: str, key: str | None = None) -> DataFrame:
    """`df` with `name`, the sum of column `of` over the rows of lower (shard, source_no), of the same `key` if given.

    Totals of `SPAN` shards come first, so that no window holds all shards."""
    keys, order = ([key] if key else []), ["shard", "source_no"]
    spans = df.withColumn("span", F.expr(f"shard div {SPAN}"))
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy(*keys, "span").agg(F.sum(of).alias("sum_")).withColumn("start_", F.coalesce(F.sum("sum_").over(before), F.lit(0))).drop("sum_")
    inside = Window.partitionBy(*keys, "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn(name, F.coalesce(F.sum(of).over(inside), F.lit(0))).join(starts, [*keys, "span"])
    return rows.withColumn(name, F.col(name) + F.col("start_")).drop("start_", "span")


def slot_total(sources: DataFrame) -> int:
    return sources.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0]


def multinomial(sources: DataFrame, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """shard, source_no, draws: every slot of a shard draws its source by one hashed uniform, and the draws are counted."""
    spark, total = sources.sparkSession, slot_total(sources)
    slots = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // shard)))
    slots = slots.select(F.expr(f"id div {shard}").alias("shard"), uniform(F.lit(seed), F.col("id")).alias("u"))
    return by_share(slots, "u", sources).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("draws"))


def shard_counts(sources: DataFrame, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """shard, source_no, blocks, draws: the multinomial counts of every output shard, their totals brought to the targets.

    A source drawn too often gives slots back, spread evenly over the shards; the slots given back are numbered, sent
    through a permutation, and cut among the sources drawn too rarely. A shard's size stays as it is."""
    drawn = materialize(multinomial(sources, shard, seed))
    upto, up_to = Window.orderBy("source_no"), F.round(F.col("hi") * F.col("all_slots"))
    wanted = sources.withColumn("want", (up_to - F.coalesce(F.lag(up_to).over(upto), F.lit(0))).cast("long"))
    totals = wanted.join(drawn.groupBy("source_no").agg(F.sum("draws").alias("total")), "source_no", "left").select(
        "source_no", "blocks", "want", F.coalesce("total", F.lit(0)).alias("total")
    )
    totals = totals.withColumn("keeps", F.least("want", "total"))
    below = running(drawn.join(F.broadcast(totals), "source_no"), "draws", "below", "source_no")

    def kept(at: Column) -> Column:  # whole numbers, which double precision would lose beyond 2^53
        return F.floor(at.cast("decimal(19,0)") * F.col("keeps").cast("decimal(19,0)") / F.col("total")).cast("long")

    counts = materialize(below.withColumn("keep", kept(F.col("below") + F.col("draws")) - kept(F.col("below"))).withColumn("back", F.col("draws") - F.col("keep")))
    run = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    short = totals.withColumn("more", F.col("want") - F.col("keeps")).withColumn("end", F.sum("more").over(run))
    size = short.agg(F.coalesce(F.max("end"), F.lit(0)).alias("size"))
    freed = running(counts.where("back > 0").select("shard", "source_no", "back"), "back", "first")
    freed = freed.select("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("back") - 1)).alias("slot"))
    freed = freed.crossJoin(F.broadcast(size)).withColumn("name", F.lit("freed"))
    # stored for the reason given in `mixed`
    freed = materialize(permuted(freed, "slot", "size", "name", seed, rounds=4).select("shard", "slot", "size"))
    shares = short.crossJoin(size).where("more > 0").select("source_no", ((F.col("end") - F.col("more")) / F.col("size")).alias("lo"), (F.col("end") / F.col("size")).alias("hi"))
    moved = by_share(freed.withColumn("at", (F.col("slot") + 0.5) / F.col("size")), "at", shares).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("draws"))
    both = counts.select("shard", "source_no", F.col("keep").alias("draws")).unionByName(moved.select("shard", "source_no", "draws"))
    final = both.groupBy("shard", "source_no").agg(F.sum("draws").alias("draws")).where("draws > 0")
    return materialize(final.join(F.broadcast(sources.select("source_no", "blocks")), "source_no").select("shard", "source_no", "blocks", "draws"))


def permuted(df: DataFrame, index: str, size: str, key: str, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Replace column `index` by its image under the swap-or-not permutation of 0 .. `size` - 1 named by `key`."""
    # coalesce makes the columns non-nullable: a null filter pushed through all rounds would grow threefold in each
    for r in range(rounds):
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(key)), F.col(size)) - F.col(index), F.col(size))
        df = df.withColumn("mirror_", F.coalesce(mirror, F.lit(0)))
        swap = uniform(F.lit(seed), F.lit(r), F.col(key), F.greatest(index, "mirror_")) < 0.5
        df = df.withColumn(index, F.coalesce(F.when(swap, F.col("mirror_")).otherwise(F.col(index)), F.lit(0)))
    return df.drop("mirror_")


def drawn_slots(sources: DataFrame, shard: int = SHARD, max_epochs: int = MAX_EPOCHS, seed: int = 1) -> DataFrame:
    """shard, source_no, slot, block: the block that every slot of the output reads."""
    counts = running(shard_counts(sources, shard, seed), "draws", "start", "source_no")
    parts = max(sources.sparkSession.sparkContext.defaultParallelism, -(-slot_total(sources) // shard))
    # a fixed number of partitions: tiny rows that grow into many slots would be put together into one task
    counts = counts.repartition(parts, "shard", "source_no")
    slots = counts.withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("draws") - 1)))
    slots = slots.where(F.col("slot") < F.col("blocks") * max_epochs).withColumn("block", F.coalesce(F.pmod("slot", "blocks"), F.lit(0)))
    return permuted(slots, "block", "blocks", "source_no", seed).select("shard", "source_no", "slot", "block")


def placed(sizes: DataFrame, sources: DataFrame, totals: DataFrame) -> DataFrame:
    """`sizes` with source_no, source_size, target and pos, the position of the row's first word in its source."""
    known = sources.select(F.col("source").alias("source_"), "source_no", "source_size", "target", "docs")

    def laned(df: DataFrame) -> DataFrame:
        lanes = F.expr(f"(docs + {LANE_ROWS - 1}) div {LANE_ROWS}")
        return df.join(known, df["source"].eqNullSafe(known["source_"])).withColumn("lane", F.pmod(F.xxhash64("doc_id", "size", "digest"), lanes)).drop("source_", "docs")

    run = Window.partitionBy("source_no").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = laned(totals).groupBy("source_no", "lane").agg(F.sum("size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0))).drop("words")
    inside = Window.partitionBy("source_no", "lane").orderBy("doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = laned(sizes).withColumn("pos", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(lanes, ["source_no", "lane"]).withColumn("pos", F.col("pos") + F.col("start")).drop("start", "lane")


def segments(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """source_no, block, pos, at, words: the part of each document that lies in each block."""
    blocks = F.sequence(F.expr(f"pos div {block}"), F.expr(f"(pos + size - 1) div {block}"))
    start, stop = F.greatest(F.col("block") * block, F.col("pos")), F.least((F.col("block") + 1) * block, F.col("pos") + F.col("size"))
    cut = rows.where("size > 0").select("source_no", "pos", "size", F.explode(blocks).alias("block"))
    return cut.select("source_no", "block", "pos", (start - F.col("pos")).alias("at"), (stop - start).alias("words"))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, max_epochs: int = MAX_EPOCHS, seed: int = 1):
    """(sizes, sources, rows, drawn): rows are the placed documents, drawn has the segments of every document with `times`, how often the mix reads them."""
    sizes = materialize(sized(docs))
    sources = materialize(targets(sizes, block, max_epochs))
    # stored, as the optimizer's constraints would grow with every round of the permutation in each plan above it
    reads = materialize(drawn_slots(sources, shard, max_epochs, seed).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times")))
    rows = materialize(placed(sizes, sources, sizes))
    return sizes, sources, rows, segments(rows, block).join(reads, ["source_no", "block"])


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    _, _, rows, drawn = mixed(docs, **options)
    taken = drawn.groupBy("source_no", "pos").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.select(F.col("source_no").alias("no_"), F.col("pos").alias("pos_"), "taken")
    return rows.join(taken, (F.col("source_no") == F.col("no_")) & (F.col("pos") == F.col("pos_")) & (F.col("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each document a row with the words read at least once, one with those read at least
    twice, and so on, words joined by one space. A document of which nothing is read has no row."""
    sizes, sources, _, drawn = mixed(docs, **options)
    parts = drawn.groupBy("source_no", "pos").agg(F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("parts"), F.max("times").alias("most"))
    parts = parts.select(F.col("source_no").alias("no_"), F.col("pos").alias("pos_"), "parts", "most")
    whole = docs.select("doc_id", "text", "lang", "source", F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long").alias("size"), digest(docs))
    rows = placed(whole, sources, sizes).where("size > 0").join(parts, (F.col("source_no") == F.col("no_")) & (F.col("pos") == F.col("pos_")))
    text = F.expr(
        "array_join(flatten(transform(filter(parts, p -> p.times >= time), p -> slice(words, cast(p.at + 1 as int), cast(p.words as int)))), ' ')"
    )
    return (
        rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
        .select("doc_id", text.alias("text"), "lang", "source")
        .withColumn("n_chars", F.length("text").cast("long"))
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
