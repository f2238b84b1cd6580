"""Exact nearest rows over whole tables, without a cross join: kNN imputation (E4), recommendation from earlier runs.

Distance between two rows is Euclidean over the dimensions that both have, scaled up for the missing ones:
sqrt(p / common * sum of squared differences), undefined without a common dimension.

Donors are sorted along a Z-order curve (after their pattern of missing dimensions) and cut into blocks of equal numbers of
rows, so equal or crowded rows fill as many blocks as they need and no block is hot. A block is summed up by its box: the
extremes of each dimension, how many of its rows have it, and its times. The boxes are at most `BOXES` rows, whatever the
size of the table (blocks grow instead), and are broadcast. A search

1. bounds each query's k-th distance from above by the boxes alone, opens the block with the lowest bound, and keeps the k
   best rows found there;
2. opens all other blocks whose box may hold a row at least as near as the k-th found, and merges.

Rows that know the same dimensions ask an order of the donors by these dimensions alone (a group), so a query's neighbours
lie in a few blocks also where it knows one dimension of many; equal questions are asked once.

Blocks are opened by a cogroup of block and queries; a block that many queries open is dealt in pieces of `PIECE` queries.
No candidate is dropped: the bounds are exact, so ties at the k-th place reach the final merge and go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.core import nan_to_null
from tabvet.operators.longform import row_numbers
from tabvet.operators.train import spread
from tabvet.session import materialize

BLOCK_ROWS, BOXES, PIECE = 1024, 65_536, 4096
SLACK = 1e-9  # relative: bounds and distances are rounded differently
QUESTIONS = 1000  # by file
GROUPS = 16  # sets of known dimensions that have an order of their own; rarer ones share the order by all dimensions

QUERY = "query long, need int, before double, v array<double>"
FOUND = "query long, d2 double, donor long, value double"


def vector(dims: list[str]) -> Column:
    return F.array(*[nan_to_null(F.col(c)) for c in dims])


def pattern(dims: int) -> Column:
    """The missing dimensions of v as bits."""
    return sum((F.when(F.col("v")[j].isNull(), F.lit(1 << min(j, 60))).otherwise(F.lit(0)) for j in range(dims)), F.lit(0).cast("long"))


def bucket_bits(dims: int) -> int:
    return max(1, min(8, 60 // dims))


def bucketed(donors: DataFrame, dims: int) -> DataFrame:
    """donors with _b0, _b1, ...: for each dimension the number of its bucket, of which each holds about equally many rows."""
    bits = bucket_bits(dims)
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    edges = donors.agg(*[F.percentile_approx(F.col("v")[j], cuts, 2000).alias(f"e{j}") for j in range(dims)]).first()
    known = [np.array(sorted({float(e) for e in edges[j] or []})) for j in range(dims)]
    added = pa.schema([(f"_b{j}", pa.int64()) for j in range(dims)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            found = [pa.array(np.where(np.isnan(v[:, j]), 0, np.searchsorted(known[j], v[:, j])).astype(np.int64)) for j in range(dims)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *added.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in donors.schema.fields)
    return donors.mapInArrow(run, f"{kinds}, " + ", ".join(f"_b{j} long" for j in range(dims)))


def z_order(dims: int, groups: dict[int, list[int]]) -> list[Column]:
    """Group, pattern of missing dimensions, Z-order number of the buckets of the group's dimensions, and within a bucket the
    values themselves."""
    bits = bucket_bits(dims)
    code, values = F.lit(0).cast("long"), [F.lit(None).cast("double") for _ in range(max((len(g) for g in groups.values() if len(g) < dims), default=0))]
    for number, own in groups.items():
        mine, at = F.lit(0).cast("long"), F.col("group") == number
        for i, j in enumerate(own):
            for b in range(bits):
                mine = mine.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"_b{j}"), b).bitwiseAND(F.lit(1).cast("long")), b * len(own) + i))
        code = F.when(at, mine).otherwise(code)
        if len(own) < dims:
            values = [F.when(at, F.col("v")[own[i]]).otherwise(x) if i < len(own) else x for i, x in enumerate(values)]
    return [F.col("group"), pattern(dims), code, *values]


@dataclass
class Boxes:
    """Boxes of all blocks as arrays: block numbers, extremes and counts by dimension, rows and times."""
    block: np.ndarray
    low: np.ndarray
    high: np.ndarray
    have: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def bounds(self, v: np.ndarray, need: int, before: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance from v to the nearest and to the farthest place of each box; infinite where no row, or
        not every row, is certain to count."""
        p = len(v)
        own = ~np.isnan(v)
        x = np.where(own, v, 0.0)
        off_low, off_high = self.low - x, x - self.high
        near = np.maximum(np.maximum(off_low, off_high), 0.0)
        far = np.maximum(np.abs(off_low), np.abs(off_high))
        some, every = own & (self.have > 0), own & (self.have == self.rows[:, None])
        uniform = (some == every).all(axis=1)
        count = some.sum(axis=1)
        squares = np.where(some, near * near, np.inf)
        # where rows of a block lack different dimensions, a row's distance is an average over some of them: at least the smallest
        least = p * np.where(uniform, np.where(some, near * near, 0.0).sum(axis=1) / np.maximum(count, 1), squares.min(axis=1, initial=np.inf))
        most = p * np.where(some, far * far, 0.0).sum(axis=1) / np.maximum(count, 1)
        possible, certain = count > 0, uniform & (count > 0)
        if need >= 0:
            possible &= self.have[:, need] > 0
            certain &= self.have[:, need] == self.rows
        possible &= self.first < before
        certain &= self.last < before
        return np.where(possible, least, np.inf), np.where(certain, most, np.inf)


class Index:
    """Donors (donor, at, v: id, time, values) cut into blocks, with their boxes.

    groups names the dimensions by which the donors of a group are ordered; donors then hold `groups`, the numbers of those
    that they are in, and a query is answered from its own group."""

    def __init__(self, donors: DataFrame, dims: int, block_rows: int = BLOCK_ROWS, groups: dict[int, list[int]] | None = None):
        self.dims, groups = dims, groups or {0: list(range(dims))}
        donors = donors if "groups" in donors.columns else donors.withColumn("groups", F.array(F.lit(0)))
        donors = materialize(donors.where(F.exists("v", lambda x: x.isNotNull())))
        dealt = materialize(bucketed(donors, dims).withColumn("group", F.explode("groups")).drop("groups"))
        size = max(block_rows, -(-dealt.count() // BOXES))
        order = {f"_z{i}": c for i, c in enumerate(z_order(dims, groups))}
        ordered = dealt.select("donor", "at", "v", "group", *[c.alias(name) for name, c in order.items()])
        numbered = row_numbers(ordered, [*map(F.col, order), F.col("donor")], "_row").drop(*order)
        block = (F.floor(F.col("_row") / size) * len(groups) + F.col("group")).cast("long")  # no block holds two groups
        self.rows = materialize(numbered.withColumn("block", block).drop("_row"))
        per_dim = [f(F.col("v")[j]).alias(f"{name}{j}") for j in range(dims) for name, f in (("low", F.min), ("high", F.max), ("have", F.count))]
        table = self.rows.groupBy("block", "group").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"), F.max("at").alias("last"), *per_dim)
        every = table.orderBy("block").toPandas()  # at most BOXES rows, and one more a group
        self.boxes = {number: self._boxes(every[every["group"] == number]) for number in groups}

    def _boxes(self, t: pd.DataFrame) -> Boxes:
        def matrix(name: str) -> np.ndarray:
            return np.stack([t[f"{name}{j}"].to_numpy(float) for j in range(self.dims)], axis=1) if len(t) else np.zeros((0, self.dims))

        return Boxes(t["block"].to_numpy(), np.nan_to_num(matrix("low")), np.nan_to_num(matrix("high")), matrix("have"),
                     t["rows"].to_numpy(float), t["first"].to_numpy(float), t["last"].to_numpy(float))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """query, found: the k nearest admissible donors as (d2, donor, value), nearest first, ties to the smaller id.

        queries hold query (unique), need (a dimension that donors must have and whose value is returned, or -1), before (only
        donors of an earlier time count), v and, if the donors are in groups, group. Queries without any admissible donor are left out."""
        queries = queries if "group" in queries.columns else queries.withColumn("group", F.lit(0))
        shared = queries.sparkSession.sparkContext.broadcast(self.boxes)
        queries = spread(materialize(queries), QUESTIONS)  # a question costs time, not bytes
        first = materialize(self._best(self._opened(queries, self._choose(shared, k)), k))
        limits = first.select("query", F.when(F.size("found") >= k, F.element_at("found", -1)["d2"]).alias("limit"), F.col("home"))
        rest = queries.join(limits, "query", "left")
        second = self._best(self._opened(rest, self._others(shared, k)), k).select("query", "found")
        both = first.select("query", "found").unionByName(second)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
        return both.groupBy("query").agg(merged.alias("found"))

    @staticmethod
    def _choose(shared, k: int):
        def blocks(group, v, need, before, limit, home) -> tuple[list[int], int]:
            boxes = shared.value[group]
            least, _ = boxes.bounds(v, need, before)
            if not len(least) or not np.isfinite(least.min()):
                return [], -1
            at = int(boxes.block[least.argmin()])
            return [at], at

        return blocks

    @staticmethod
    def _others(shared, k: int):
        def blocks(group, v, need, before, limit, home) -> tuple[list[int], int]:
            boxes = shared.value[group]
            least, most = boxes.bounds(v, need, before)
            order = np.argsort(most)
            enough = np.searchsorted(np.cumsum(boxes.rows[order]), k)
            within = most[order[enough]] if enough < len(order) else np.inf
            within = min(within, limit) if limit is not None else within
            opened = np.flatnonzero(np.isfinite(least) & (least <= within * (1 + SLACK)))
            return [int(b) for b in boxes.block[opened] if b != home], -1

        return blocks

    def _opened(self, queries: DataFrame, choose) -> DataFrame:
        """query, need, before, v, block, home: a row for each block that `choose` opens for a query."""
        extra = [c for c in ("limit", "home") if c in queries.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = {c: [] for c in ("query", "need", "before", "v", "block", "home")}
                rows = batch.to_pydict()
                for i in range(batch.num_rows):
                    v = np.array([np.nan if x is None else x for x in rows["v"][i]], float)
                    limit = rows["limit"][i] if "limit" in rows else None
                    found, home = choose(rows["group"][i], v, rows["need"][i], rows["before"][i], limit, rows["home"][i] if "home" in rows else None)
                    for b in found:
                        for c in ("query", "need", "before", "v"):
                            out[c].append(rows[c][i])
                        out["block"].append(b)
                        out["home"].append(home)
                schema = pa.schema([("query", pa.int64()), ("need", pa.int32()), ("before", pa.float64()), ("v", pa.list_(pa.float64())), ("block", pa.int64()), ("home", pa.int64())])
                yield pa.RecordBatch.from_pydict(out, schema)

        chosen = queries.select("query", "need", "before", "v", "group", *extra)
        return chosen.mapInArrow(run, f"{QUERY}, block long, home long")

    def _best(self, opened: DataFrame, k: int) -> DataFrame:
        """query, found (the k best of the opened blocks) and home."""
        opened = materialize(opened)
        pieces = opened.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
        asked = opened.join(F.broadcast(pieces), "block").withColumn("piece", F.pmod(F.xxhash64("query"), F.col("pieces")).cast("int"))
        given = self.rows.join(F.broadcast(pieces), "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

        def scan(keys: tuple, queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
            return opened_block(queries, donors, k)

        found = asked.groupBy("block", "piece").cogroup(given.select("block", "piece", "donor", "at", "v").groupBy("block", "piece")).applyInPandas(scan, f"{FOUND}, home long")
        best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "donor", "value"))), 1, k)
        return found.groupBy("query").agg(best.alias("found"), F.max("home").alias("home"))


def opened_block(queries: pd.DataFrame, donors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest admissible donors of each query within one block, in slices of queries."""
    names = ["query", "d2", "donor", "value", "home"]
    if not len(queries) or not len(donors):
        return pd.DataFrame({c: pd.Series(dtype=float if c in ("d2", "value") else "int64") for c in names})
    donors = donors.sort_values("donor", kind="stable")
    d = np.array([[np.nan if x is None else x for x in v] for v in donors["v"]], float)
    q = np.array([[np.nan if x is None else x for x in v] for v in queries["v"]], float)
    at, ids = donors["at"].to_numpy(float), donors["donor"].to_numpy()
    need, before = queries["need"].to_numpy(), queries["before"].to_numpy(float)
    number, home = queries["query"].to_numpy(), queries["home"].to_numpy()
    parts = []
    for low in range(0, len(q), 512):
        part = slice(low, low + 512)
        total, common = np.zeros((len(q[part]), len(d))), np.zeros((len(q[part]), len(d)))
        for j in range(d.shape[1]):
            gap = q[part, j][:, None] - d[None, :, j]
            known = ~np.isnan(gap)
            gap[~known] = 0.0
            total += gap * gap
            common += known
        with np.errstate(divide="ignore", invalid="ignore"):
            d2 = total * (d.shape[1] / common)
        open_to = (common > 0) & (at[None, :] < before[part][:, None])
        asks = need[part] >= 0
        values = d[:, np.maximum(need[part], 0)].T  # queries x donors
        open_to &= ~asks[:, None] | ~np.isnan(values)
        d2[~open_to] = np.inf
        last = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(d) else np.full(len(d2), np.inf)
        at_row, chosen = np.nonzero((d2 <= last[:, None]) & np.isfinite(d2))
        best = np.lexsort((chosen, d2[at_row, chosen], at_row))  # donors ascend, so ties keep the smaller id
        at_row, chosen = at_row[best], chosen[best]
        keep = np.arange(len(at_row)) - np.searchsorted(at_row, at_row) < k
        at_row, chosen = at_row[keep], chosen[keep]
        value = np.where(asks[at_row], values[at_row, chosen], np.nan)
        parts.append(pd.DataFrame({"query": number[part][at_row], "d2": d2[at_row, chosen], "donor": ids[chosen], "value": value, "home": home[part][at_row]}))
    return pd.concat(parts)


# ------------------------------------------------------------------ E4
def impute_knn(df: DataFrame, cols: list[str], order: list[Column], k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each missing value of `cols` becomes the mean of the k nearest rows that have it (all, if fewer).

    Distance is over all of `cols`, unscaled, ties go to the row that comes first in `order`; a value without any donor
    in reach becomes the column's mean (NULL if the column has no value). NaN counts as missing; other columns stay.
    Every row is a donor and none is sampled."""
    rows = materialize(row_numbers(df, order, "_row"))
    p = len(cols)
    vectors = rows.select(F.col("_row").alias("donor"), F.lit(0.0).alias("at"), vector(cols).alias("v")).withColumn("lacks", pattern(p))
    everything = (1 << p) - 1
    asked = vectors.where((F.col("lacks") > 0) & (F.col("lacks") < everything)).groupBy("lacks").count()
    known = [r["lacks"] for r in asked.orderBy(F.desc("count"), "lacks").limit(GROUPS).collect()] if p <= 60 else []
    groups = {0: list(range(p))} | {i + 1: [j for j in range(p) if not lacks >> j & 1] for i, lacks in enumerate(known)}
    # a group's donors share a dimension with its queries and have one that these lack; rarer patterns ask all donors
    serves = [F.when((F.col("lacks").bitwiseOR(F.lit(lacks)) != everything) & (F.col("lacks").bitwiseAND(F.lit(lacks)) != lacks), F.lit(i + 1)) for i, lacks in enumerate(known)]
    rest = vectors.where((F.col("lacks") > 0) & ~F.col("lacks").isin(known or [-1]))
    all_donors = [F.lit(0)] if not rest.isEmpty() else []
    serving = F.array_compact(F.array(*all_donors, *serves).cast("array<int>"))
    index = Index(vectors.select("donor", "at", "v", serving.alias("groups")), p, block_rows, groups)
    missing = F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.get("v", j).isNull())
    group = F.lit(0)
    for i, lacks in enumerate(known):
        group = F.when(F.col("lacks") == lacks, F.lit(i + 1)).otherwise(group)
    slots = vectors.where(F.col("lacks") > 0).select(F.col("donor"), F.explode(missing).alias("need"), "lacks", "v", group.alias("group"))
    # equal values ask the same: one of them does, and all read its answer
    same = ["need", "lacks", *[F.coalesce(F.get("v", F.lit(j)), F.lit(0.0)).alias(f"_v{j}") for j in range(p)]]
    names = ["need", "lacks", *[f"_v{j}" for j in range(p)]]
    slots = materialize(slots.select((F.col("donor") * p + F.col("need")).alias("slot"), *same, "v", "group"))
    questions = slots.groupBy(*names).agg(F.min("slot").alias("query"), F.any_value("v").alias("v"), F.any_value("group").alias("group"))
    questions = materialize(questions)
    answers = index.nearest(questions.select("query", "need", F.lit(1.0).alias("before"), "v", "group"), k)
    asking = slots.join(questions.select(*names, "query"), names).select("slot", "query")
    filled = asking.join(answers, "query").select(F.col("slot").alias("query"), "found")
    mean = F.aggregate("found", F.lit(0.0), lambda s, x: s + x.value) / F.size("found")
    row = F.floor(F.col("query") / len(cols)).cast("long")
    values = filled.select(row.alias("_row"), (F.col("query") % len(cols)).alias("_dim"), mean.alias("_mean"))
    wide = values.groupBy("_row").agg(*[F.max(F.when(F.col("_dim") == j, F.col("_mean"))).alias(f"_f{j}") for j in range(len(cols))])
    means = rows.agg(*[F.avg(nan_to_null(F.col(c))).alias(f"_m{j}") for j, c in enumerate(cols)])
    joined = rows.join(wide, "_row", "left").crossJoin(F.broadcast(means))  # one row of means
    place = {c: j for j, c in enumerate(cols)}
    return joined.select(*[F.coalesce(nan_to_null(F.col(c)), F.col(f"_f{place[c]}"), F.col(f"_m{place[c]}")).alias(c) if c in place else F.col(c)
                           for c in df.columns])


# ------------------------------------------------------------------ I15
def recommend_model(datasets: DataFrame, runs: DataFrame, features: list[str], key: str, at: str, model: str = "model",
                    fallback: str = "RandomForest", least: int = 3) -> DataFrame:
    """The model of the nearest earlier run, for each dataset.

    datasets(key, at, features...) are described as they were at time `at`; only runs(at, model, features...) before that
    time count. Distance is over the features standardised by the runs' mean and deviation (a constant feature counts
    as it is), missing features as in `Index`; ties go to the run that comes first by (at, model). With fewer than
    `least` earlier runs the answer is `fallback` at confidence 0.3, else confidence is min(0.5 + runs / 20, 0.9).
    Returns key, recommended, confidence, earlier_runs and distance (NULL for the fallback)."""
    from tabvet.operators.longform import running_totals

    runs = row_numbers(runs, [F.col(at), F.col(model), *[F.col(c) for c in features]], "_run")
    stats = runs.agg(*[F.avg(nan_to_null(F.col(c))).alias(f"m{j}") for j, c in enumerate(features)],
                     *[F.stddev_pop(nan_to_null(F.col(c))).alias(f"s{j}") for j, c in enumerate(features)]).first()
    scaled = F.array(*[(nan_to_null(F.col(c)) - F.lit(stats[f"m{j}"])) / F.lit(stats[f"s{j}"] or 1.0) for j, c in enumerate(features)])
    time = F.col(at).cast("double")
    asked = materialize(row_numbers(datasets.select(key, time.alias("before"), scaled.alias("v")), [F.col("before"), F.col(key)], "query"))
    # runs before each time: running counts over the times of both tables
    times = runs.select(time.alias("t"), F.lit(1).alias("n")).unionByName(asked.select(F.col("before").alias("t"), F.lit(0).alias("n")))
    counted = running_totals(times.groupBy(F.lit("all").alias("k"), "t").agg(F.sum("n").alias("n")), ["k"], "t", ["n"])
    earlier = counted.select(F.col("t").alias("before"), (F.col("cum_n") - F.col("n")).alias("earlier_runs"))
    index = Index(runs.select(F.col("_run").alias("donor"), time.alias("at"), scaled.alias("v")), len(features))
    found = index.nearest(asked.select("query", F.lit(-1).alias("need"), "before", "v"), 1)
    nearest = found.select("query", F.col("found")[0]["donor"].alias("_run"), F.sqrt(F.col("found")[0]["d2"]).alias("distance"))
    named = nearest.join(runs.select("_run", F.col(model).alias("_model")), "_run")
    out = asked.join(earlier, "before", "left").join(named, "query", "left")
    known = (F.col("earlier_runs") >= least) & F.col("_model").isNotNull()
    return out.select(key, F.when(known, F.col("_model")).otherwise(fallback).alias("recommended"),
                      F.when(known, F.least(0.5 + F.col("earlier_runs") / 20.0, F.lit(0.9))).otherwise(0.3).alias("confidence"),
                      F.coalesce(F.col("earlier_runs"), F.lit(0)).alias("earlier_runs"), F.when(known, F.col("distance")).alias("distance"))
