"""Merkle manifest of a dataset: a root over all rows, a proof for each row, and the check of a row against the root.

A row's leaf is the digest of its columns, each as byte count, colon, value (`-` for null). Per group (lang) the leaves
ascend by id; every `FANOUT` consecutive nodes become the digest of their digests' hex text, until one node, the
group's subroot, remains. The subroots, ordered by group, give the root in the same way.

Method: the built levels are stored as parent-linked node rows, each with its children's digests and the link to its
own parent. A recursive query of Spark SQL then ascends from every leaf: a step joins the rows with their parents by
the link, appends the siblings of that step and folds the digest of the row's present contents. What the last step folds is
compared with the root. From the second step on, the leaves of one run climb the same way, so the first leaf of a run tells
the siblings of these steps for all of it, and the run's own digests, of which each leaf leaves out its own.

Nothing depends on one group's size: leaves are numbered by a range sort over (group, id, leaf) whose partitions are
counted and offset, so a group or an id that holds a third of all rows lies over many tasks, and levels are aggregates
over FANOUT rows a key. Nodes near the root are the parent of many climbing rows at once: they are stored in copies,
one for each `SHARE` leaves below (`COPIES` at most), and a leaf's number says which copy it meets. The driver sees the
number of groups and the size of the largest, nothing else.

Defined results: null ids come first within their group and count as the empty id when the query chooses rows to tamper
with; rows of one id are ordered by leaf, repeated rows are equal leaves side by side, whose proofs differ by their
place and are given to them in any order; a null group is the first; a lone leaf is its subroot, a lone subroot
the root, with the digest of no text for a proof without siblings; an empty table gives no rows; empty and long texts
are values like others; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabvet.llm.common import fold, read
from tabvet.session import materialize

FANOUT = 8
TOP = -1  # the tree of the subroots
SHARE, COPIES = 512, 1024
FOLDS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row's values, each with its length in bytes so that no two rows read alike."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def numbered(rows: DataFrame, group: str, order: list[Column], number: str) -> DataFrame:
    """rows with `number`, counting from 0 in the order given within each group.

    The rows are sorted by range over all columns of the order; each range counts its rows of a group, and the sum of
    the ranges before is added to the number within the range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = materialize(ties.repartitionByRange(parts, F.col(group), *order, F.col("tie")).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", group).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part", group).orderBy(*order, "tie")
    offset = counts.select(F.col("part").alias("at"), F.col(group).alias("of"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("place", F.row_number().over(within) - 1)
    joined = placed.join(offset, (F.col("part") == F.col("at")) & F.col(group).eqNullSafe(F.col("of")))
    return joined.withColumn(number, F.col("place") + F.col("offset")).drop("tie", "part", "at", "of", "offset", "place")


def built(nodes: DataFrame) -> list[DataFrame]:
    """Levels above nodes(tree, level, idx, hash, n): the same columns and kids, the digests of the children.

    n is the number of nodes of the tree at that level; trees with one node are finished. Each level is stored."""
    levels, tallest = [], nodes.agg(F.max("n")).first()[0] or 0
    while tallest > 1:
        kids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x.hash), "")
        parent = [F.col("tree"), (F.col("level") + 1).alias("level"), F.floor(F.col("idx") / FANOUT).alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n")]
        grouped = nodes.where("n > 1").groupBy(*parent).agg(kids.alias("kids"))
        nodes = materialize(grouped.select("tree", "level", "idx", digest(F.col("kids")).alias("hash"), "n", "kids"))
        levels.append(nodes)
        tallest = -(-tallest // FANOUT)
    return levels


def copies(level: Column, tree: Column) -> Column:
    """Copies of the nodes of a level: for each SHARE leaves below, which are `leaves` at most, `everything` in the top tree."""
    below = F.when(tree == TOP, F.col("everything")).otherwise(F.least(F.pow(F.lit(float(FANOUT)), level), F.col("leaves")))
    return F.least(F.greatest(F.ceil(below / SHARE), F.lit(1)), F.lit(COPIES)).cast("int")


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with the link to their parent (up_tree, up_level, up_idx, null for the root, up_copies), and place, their number there.

    A subroot's number in the tree of the subroots is its own tree's; seats is the number of subroots."""
    inner, seated = F.col("n") > 1, (F.col("tree") != TOP) & (F.col("seats") > 1)
    out = nodes.select(
        "*",
        F.when(inner, F.col("tree")).when(seated, F.lit(TOP)).cast("long").alias("up_tree"),
        F.when(inner, F.col("level") + 1).when(seated, F.lit(1)).cast("long").alias("up_level"),
        F.when(inner, F.floor(F.col("idx") / FANOUT)).when(seated, F.floor(F.col("tree") / FANOUT)).cast("long").alias("up_idx"),
        F.when(inner, F.col("idx") % FANOUT).when(seated, F.col("tree") % FANOUT).cast("int").alias("place"),
    )
    return out.withColumn("up_copies", copies(F.col("up_level"), F.col("up_tree")))


def manifest(leaves: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes): the given rows(group, order, leaf, ...) with tree, idx and links, and the linked node rows above.

    Both are written tables."""
    rows = leaves.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    groups = rows.withColumn("all", F.lit(0)).withColumnRenamed(group, "named")
    groups = numbered(groups, "all", [F.col("named").asc_nulls_first()], "tree")
    groups = materialize(groups.select("named", "n", "tree"))
    seats = groups.count()
    placed = numbered(leaves, group, [F.col(order).asc_nulls_first(), F.col("leaf")], "idx")
    placed = placed.join(groups, F.col(group).eqNullSafe(F.col("named"))).drop("named")
    everything = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = placed.withColumns({"level": F.lit(0).cast("long"), "seats": F.lit(seats), "leaves": F.col("n"), "everything": F.lit(everything)})
    stored = materialize(linked(placed))
    below = built(stored.select("tree", "level", "idx", F.col("leaf").alias("hash"), "n"))
    subroots = stored.where("n = 1").select("tree", F.col("leaf").alias("hash"))
    for level in below:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "hash"))
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"), F.col("tree").alias("idx"), "hash", F.lit(seats).cast("long").alias("n"))
    above = built(materialize(top)) if seats > 1 else []
    nodes = stored.select("tree", "level", "idx", F.col("leaf").alias("hash"), "n", F.lit("").alias("kids")).limit(0)
    for level in [*below, *above]:
        nodes = nodes.unionByName(level)
    nodes = nodes.join(groups.select(F.col("tree").alias("of"), F.col("n").alias("leaves")), F.col("tree") == F.col("of"), "left").drop("of")
    nodes = linked(nodes.withColumns({"seats": F.lit(seats), "everything": F.lit(everything)}))
    return stored, materialize(nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), copies(F.col("level"), F.col("tree")) - 1))))


#: One step: folded is the parent's digest with this row's own in its place. First leaves also tell what they pass: the run's
#: digests at the first step within their tree, at others the parent's other children, left to right.
CLIMB = """
WITH RECURSIVE climb(leaf_tree, leaf_idx, step, up_tree, up_level, up_idx, up_copies, place, folded, told, subroot, root) AS (
  SELECT tree, idx, 0, up_tree, up_level, up_idx, up_copies, place, unhex(present), CAST(NULL AS BINARY),
         IF(idx % {fanout} = 0 AND n = 1, unhex(leaf), NULL), IF(idx % {fanout} = 0 AND up_tree IS NULL, unhex(leaf), NULL)
  FROM {leaves}
  UNION ALL
  SELECT leaf_tree, leaf_idx, step + 1, p.up_tree, p.up_level, p.up_idx, p.up_copies, p.place,
         unhex(sha2(CAST(concat(left(kids, 64 * c.place), lower(hex(folded)), substr(kids, 64 * c.place + 65)) AS BINARY), 256)),
         IF(leaf_idx % {fanout} = 0, unhex(IF(step = 0 AND p.tree = leaf_tree, kids, concat(left(kids, 64 * c.place), substr(kids, 64 * c.place + 65)))), NULL),
         IF(leaf_idx % {fanout} = 0 AND p.n = 1 AND p.tree <> {top}, unhex(p.hash), NULL), IF(leaf_idx % {fanout} = 0 AND p.up_tree IS NULL, unhex(p.hash), NULL)
  FROM climb c JOIN {nodes} p
    ON c.up_tree = p.tree AND c.up_level = p.level AND c.up_idx = p.idx AND c.leaf_idx % c.up_copies = p.copy
)
SELECT * FROM climb
"""


def climbed(leaves: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaf_tree, leaf_idx, folded) of every leaf's last step, and (of, run, told, subroot, root) of every run of leaves.

    leaves hold present, the leaf of the contents to check, besides the one in the manifest. Spark stops a recursive
    query after a fixed number of rows unless told otherwise; here the number of steps is the depth of the tree."""
    spark = leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    query = CLIMB.format(leaves="{leaves}", nodes="{nodes}", top=TOP, fanout=FANOUT)
    steps = materialize(spark.sql(query, leaves=leaves, nodes=nodes).where(f"up_tree IS NULL OR leaf_idx % {FANOUT} = 0"))
    last = steps.where("up_tree IS NULL").select("leaf_tree", "leaf_idx", F.lower(F.hex("folded")).alias("folded"))
    told = F.transform(F.sort_array(F.collect_list(F.when(F.col("told").isNotNull(), F.struct("step", "told")))), lambda s: s.told)
    runs = steps.where(f"leaf_idx % {FANOUT} = 0").groupBy(F.col("leaf_tree").alias("of"), F.floor(F.col("leaf_idx") / FANOUT).cast("long").alias("run"))
    return last, runs.agg(told.alias("told"), F.lower(F.hex(F.max("subroot"))).alias("subroot"), F.lower(F.hex(F.max("root"))).alias("root"))


def verified(rows: DataFrame, present: Column, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """A manifest of rows, and each row's present leaf (a Column over rows) checked against it by its proof.

    Returns order, group, leaf, subroot, root, proof, folded_root and verified for every row."""
    leaves = rows.select(F.col(order), F.col(group), leaf([F.col(c) for c in columns]).alias("leaf"), present.alias("present"))
    placed, nodes = manifest(leaves, group, order)
    last, runs = climbed(placed, nodes)
    found = placed.join(last, (F.col("tree") == F.col("leaf_tree")) & (F.col("idx") == F.col("leaf_idx")))
    found = found.join(runs, (F.col("tree") == F.col("of")) & (F.floor(F.col("idx") / FANOUT) == F.col("run")))
    text = F.transform("told", lambda t: F.lower(F.hex(t)))
    own, place = F.element_at(text, 1), (F.col("idx") % FANOUT).cast("int")
    others = F.concat(F.substring(own, F.lit(1), 64 * place), F.substring(own, 64 * place + 65, F.length(own)))
    proof = F.when(F.col("n") > 1, F.concat(others, F.array_join(F.slice(text, 2, F.size(text)), ""))).otherwise(F.array_join(text, ""))
    folded = F.col("folded")
    return found.select(order, group, "leaf", "subroot", "root", proof.alias("proof"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    text = F.when(fold("doc_id", FOLDS) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    tampered = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    found = verified(docs, tampered)
    return found.select("doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


#: crc32 of the decimal id by its definition; the levels rise while a tree has several nodes.
OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, n_chars, text, doc_id::VARCHAR AS id,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 3 = 0 AS tampered
  FROM documents),
h AS (
  SELECT *, concat(coalesce(strlen(id) || ':' || id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now
  FROM d),
leaves AS (
  SELECT doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS present,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n
  FROM h),
low AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 8, n),
seats AS (SELECT tree AS idx, hash, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT -1 AS tree, 0 AS level, idx, n, hash FROM seats
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY tree, level, idx // 8, n),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
runs AS (
  SELECT tree, level, idx // 8 AS run, list(hash ORDER BY idx) AS hashes FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
climb AS (
  SELECT doc_id, tree, 0 AS level, idx, n, present AS folded, '' AS proof, tree AS leaf_tree FROM leaves
  UNION ALL
  SELECT doc_id,
         CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
         CASE WHEN c.n > 1 THEN c.idx // 8 ELSE c.tree END, CASE WHEN c.n > 1 THEN (c.n + 7) // 8 ELSE (SELECT any_value(n) FROM seats) END,
         CASE WHEN c.n > 1 THEN sha256(array_to_string(list_transform(hashes, lambda x, i: CASE WHEN i = c.idx % 8 + 1 THEN folded ELSE x END), '')) ELSE folded END,
         CASE WHEN c.n > 1 THEN proof || array_to_string(list_filter(hashes, lambda x, i: i <> c.idx % 8 + 1), '') ELSE proof END, leaf_tree
  FROM climb c LEFT JOIN runs r ON c.n > 1 AND r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 8
  WHERE c.n > 1 OR c.tree >= 0)
SELECT doc_id, leaf, s.hash AS subroot, t.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.hash AS verified
FROM climb c JOIN leaves USING (doc_id) JOIN seats s ON s.idx = c.leaf_tree, (SELECT hash FROM high WHERE n = 1) t
WHERE c.tree = -1 AND c.n = 1
"""
