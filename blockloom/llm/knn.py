"""Exact top-k search by inner product: a Voronoi kNN join.

Components become floor(64 * x), scores are integer inner products.  Equal vectors are one class that carries its
first 2k rows by id, of one id k at most; whichever single id a query leaves out, k remain, so a vector that a third of
all rows share costs no more than any other.  Query classes are grouped by the nearest of a few pivots (data vectors of different
ids, chosen by a hash), and large groups are cut into shells by distance from their pivot.  A query's scores with the pivots give
a floor that its k-th best score cannot fall below, whatever its id; a shell's summary is its pivot p, the largest distance R of its
queries from p and the least floor.  By q.x <= p.x + R |x| a data vector is sent only to the shells whose floor that bound
reaches.  Shells and their data are solved in blocks of bounded size by matrix products, and blocks' best lists are merged.

Answers are found once for each class of equal query vectors and handed to its askers at the end; classes with many askers are
salted.  Classes are joined by their vectors or by numbers that are stored with them, never by hashes.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows with null ids; of vectors of different lengths the shorter counts as padded with zeros;
components are 64-bit after scaling (larger ones are held at the limit), and scores likewise; ties
go to the smaller id; rows that repeat an id are rows of their own, a query leaves out all rows
with its own id, and an id that asks with several vectors gets the best rows of all of them; fewer than k candidates give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from blockloom.llm.shared import cut, map_arrow, partitions

K = 20
SCALE = 64.0
#: Data vectors that give floors for the scores, about so many query classes in a shell, and shells of a group at most.
PIVOTS = 512
QUERY_BLOCK = 1024
SHELLS = 64
#: Askers of a class that meet in one task: at least so many, and so many that only HOT_CLASSES classes can have more.
ASKERS = 256
HOT_CLASSES = 20_000
#: Query rows whose scores are held at once.
HELD_QUERIES = 256
#: Data rows in a block: at least and at most.
LEAST_BLOCK, MOST_BLOCK = 512, 32_768
LIMIT = (1 << 63) - 1


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Integer vectors of an Arrow list column or a list, padded with zeros, as an exact matrix."""
    rows = vectors.to_pylist() if hasattr(vectors, "to_pylist") else vectors
    wide = max([len(r) for r in rows], default=0) if width is None else width
    if isinstance(vectors, pa.ListArray | pa.LargeListArray) and len(rows) and all(len(r) == wide for r in rows):
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), wide)
    out = np.zeros((len(rows), wide), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly; held at the limits of 64 bits."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * wide < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(-LIMIT, min(LIMIT, int(x))) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def group_queries(batches, pivots: np.ndarray, k: int, centres: int) -> Iterator[pa.RecordBatch]:
    """The nearest of the first ``centres`` pivots of each query class, its distance, and its floor: the (k + 1)-th best score with a pivot.

    The pivots have different ids, so at most one of the k + 1 is left out.
    """
    square = (pivots[:centres].astype(float) ** 2).sum(axis=1)
    for batch in batches:
        v = matrix(batch.column("v"))
        scores = products(v, pivots)
        floor = np.sort(scores, axis=1)[:, -(k + 1)] if len(pivots) > k else np.full(len(v), -LIMIT)
        near = (square[None, :] - 2.0 * scores[:, :centres]).argmin(axis=1)
        wide = max(v.shape[1], pivots.shape[1])
        pad = lambda m: np.pad(m.astype(float), ((0, 0), (0, wide - m.shape[1])))
        far = np.linalg.norm(pad(v) - pad(pivots)[near], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(near.astype(np.int32)), pa.array(far), pa.array(floor), batch.column("v")], ["q", "grp", "far", "floor", "v"])


def needed_shells(batches, pivots: np.ndarray, groups: np.ndarray, radius: np.ndarray, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The shells (places in ``groups``) that each data class may be needed in."""
    used, back = np.unique(groups, return_inverse=True)
    for batch in batches:
        for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
            v = matrix(part.column("v"))
            bound = products(v, pivots[used]).astype(float)[:, back] + np.linalg.norm(v.astype(float), axis=1)[:, None] * radius[None, :]
            wanted = bound * (1 + 1e-9) + 1e-6 + np.abs(bound) * 1e-9 >= floors[None, :]
            ends = np.concatenate([[0], np.cumsum(wanted.sum(axis=1))])
            flat = np.nonzero(wanted)[1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("v"), part.column("ids"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["v", "ids", "shells"])


def at_most(ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their id."""
    order = np.argsort(ids, kind="stable")
    _, first, size = np.unique(ids[order], return_index=True, return_counts=True)
    out = np.zeros(len(ids), bool)
    out[order] = np.arange(len(ids)) - np.repeat(first, size) < k
    return out


def best_rows(queries: pa.Table, data: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its best 2k rows in a block of data classes, of one id k at most."""
    q, x = matrix(queries.column("v").combine_chunks()), matrix(data.column("v").combine_chunks())
    ids = data.column("ids").combine_chunks()
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    keep = 2 * k

    def ranked(scores: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([flat[at[c] : at[c + 1]] for c in some])
        got = np.repeat(scores[some], (at[1:] - at[:-1])[some])
        order = np.lexsort((own, -got))
        own, got = own[order], got[order]
        if len(np.unique(own)) < len(own):
            first = at_most(own, k)
            own, got = own[first], got[first]
        return own[:keep], got[:keep]

    for start in range(0, len(q), HELD_QUERIES):
        for scores in products(q[start : start + HELD_QUERIES], x):
            every = np.arange(len(scores))
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - keep)[-keep]) if len(scores) > keep else every
            own, got = ranked(scores, some)
            yield ranked(scores, every) if len(own) < keep and len(some) < len(every) else (own, got)


def solve(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not len(queries) or not len(data):
        return schema.empty_table()
    found = list(best_rows(queries, data, k))
    names = np.repeat(queries.column("q").to_numpy(), [len(i) for i, _ in found])
    return pa.table([pa.array(names), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], schema=schema)


def first_rows(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first 2k rows of each key, of one id k at most (``order`` ends with the id)."""
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key, "vec_id").orderBy(*order))).where(F.col("__nth") <= k)
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__place") <= 2 * k).drop("__nth", "__place")


def data_classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids) of the classes of equal vectors."""
    few = rows.withColumn("__id", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("__id") <= 2 * k).drop("__id")
    return first_rows(few, "v", [F.col("vec_id")], k).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def shells_of(near: DataFrame) -> tuple[DataFrame, list]:
    """The query classes with the shell that each is in, and the shells' summaries (shell, grp, far, floor), a row of the driver's for each."""
    groups = near.groupBy("grp").agg(F.count("*").alias("n"), F.percentile_approx("far", [k / SHELLS for k in range(1, SHELLS)], 1000).alias("cuts")).collect()
    bounds = []
    for r in groups:
        parts = min(SHELLS, -(-r["n"] // QUERY_BLOCK))
        bounds.append((r["grp"], sorted({r["cuts"][k * SHELLS // parts - 1] for k in range(1, parts)})))
    cuts = F.create_map(*[x for grp, at in bounds for x in (F.lit(grp), F.array(*map(F.lit, at)).cast("array<double>"))])
    shell = F.struct("grp", F.size(F.filter(F.element_at(cuts, F.col("grp")), lambda c: c < F.col("far"))).alias("nth"))
    near = near.withColumn("at", shell)
    summary = near.groupBy("at").agg(F.max("far").alias("far"), F.min("floor").alias("floor")).orderBy("at").collect()
    number = F.create_map(*[x for k, r in enumerate(summary) for x in (F.lit(r["at"]["grp"] * SHELLS + r["at"]["nth"]), F.lit(k))])
    near = near.withColumn("shell", F.element_at(number, F.col("at.grp") * SHELLS + F.col("at.nth")))
    return near.select("shell", "q", "v"), [(r["at"]["grp"], r["far"], float(r["floor"])) for r in summary]


def handed_out(asked: DataFrame, classes: DataFrame, answers: DataFrame, n_asked: int) -> DataFrame:
    """(query_id, best) for each asker and each of its vectors; classes with many askers are salted."""
    salted = max(ASKERS, n_asked // HOT_CLASSES)
    counted = classes.select("q", "v", F.ceil(F.col("askers") / salted).cast("int").alias("salts"))
    hot = counted.where("salts > 1").select(F.col("v").alias("hot_v"), "salts")  # HOT_CLASSES at most
    lists = answers.join(counted, "q").select("v", "best", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asks = asked.join(F.broadcast(hot), asked["v"] == F.col("hot_v"), "left")
    asks = asks.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    return asks.join(lists, ["v", "salt"]).select("query_id", "best")


def top_k(vectors: DataFrame, k: int = K, query_mod: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``query_mod``, against all rows but those with the query's id."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_col, vec_col, scale))
    classes = cut(data_classes(rows, k))
    asked = rows.where(F.col("vec_id") % query_mod == 0).distinct()
    asked_classes = cut(asked.groupBy("v").agg(F.count("*").alias("askers")).withColumn("q", F.monotonically_increasing_id()))
    n_classes, (n_queries, n_asked) = classes.count(), asked_classes.agg(F.count("*"), F.coalesce(F.sum("askers"), F.lit(0))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n_classes or not n_queries:
        return spark.createDataFrame([], empty)

    sample = classes.select("v", F.get("ids", F.lit(0)).alias("id")).orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    pivots = matrix([r["v"] for r in {r["id"]: r for r in reversed(sample)}.values()][::-1])
    centres = max(1, min(len(pivots), math.isqrt(n_queries // 64 + 1)))
    near = cut(map_arrow(asked_classes.select("q", "v"), lambda b: group_queries(b, pivots, k, centres), "q long, grp int, far double, floor long, v array<long>"))
    near, shells = shells_of(near)
    groups, radius, floors = (np.array(x) for x in zip(*shells, strict=True))

    sent = map_arrow(classes, lambda b: needed_shells(b, pivots, groups, radius, floors), "v array<long>, ids array<long>, shells array<int>")
    size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-n_classes // (2 * partitions(spark)))))
    blocks = -(-n_classes // size)
    data = sent.withColumn("block", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shell", F.explode("shells")).select("shell", "block", "v", "ids")
    ask = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shell", "block", "q", "v")
    found = ask.groupBy("shell", "block").cogroup(data.groupBy("shell", "block")).applyInArrow(lambda a, b: solve(a, b, k), "q long, vec_id long, score long")

    best = first_rows(found, "q", [F.col("score").desc(), F.col("vec_id")], k)
    row = F.struct((-F.col("score")).alias("cost"), "vec_id")
    answers = cut(best.groupBy("q").agg(F.sort_array(F.collect_list(row)).alias("best")))
    own = handed_out(asked, asked_classes, answers, n_asked).select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    lists = own.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.cost")).alias("score"))
