"""Near-duplicate detection with circulant MinHash.

Two permutations make all signature coordinates: the first scatters the shingles over a ring, the
second, shifted circularly by k places, gives coordinate k.  A shingle's values for all coordinates
are therefore neighbours in one table, and a signature is a minimum over contiguous rows.
Coordinates form bands; documents that agree on a band meet in a bucket; every pair that is
reported as a link was confirmed on the full shingle sets.

What keeps it linear with large groups:

* Documents with equal shingle sets collapse to one *class* first (an aggregate).
* In each bucket only the member that shares most buckets is compared with the others (a star, not
  all pairs).  Connected components follow from the confirmed links.
* Buckets that still hold several components go through further rounds, in which the members
  outside a bucket's largest component are compared with all members of other components.  The
  rounds end when no bucket holds two members of different components that were not compared, so
  no link between two members of a bucket is lost and no bucket is capped.  New links join the components
  found so far, as nodes of a smaller graph.
* Where that is too many comparisons and a round of some of them joins little (different texts with much boilerplate in
  common, not many copies of one), the members of open buckets are dealt anew, once, by an exact prefix filter, if that has fewer pairs: of a set of n shingles, ordered by how many members have
  them, the n - t n + 1 rarest are the keys.  Sets that are similar enough share one of them, so no link is
  lost, and what many members have in common is the key of few.

Pairs carry a parity sketch of their sets (PARITY_BITS bits; a shingle flips one).  Two sketches
differ in at most as many bits as the sets have different shingles, so a pair whose sketches differ
in more than a link allows is dropped inside the join, before its sets are fetched, without loss.

``bands_for`` chooses the number of bands so that a pair at the threshold is missed with a chance
under one in a million.

Defined results: null texts and texts without words have empty sets, are linked with nothing and
are kept; texts with fewer words than a shingle have one shingle, the whole sequence; rows with
null ids take part, ``component_id`` is the smallest non-null id of the component (null if it has
none) and ``kept`` is false where either is null; repeated rows are linked with each other;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blockloom.llm.shared import cut, map_arrow
from blockloom.llm.textscan import grams, is_not_space, lower_ascii, mixed, scan, slices

RING = 1 << 20
MISS = 1e-6
PARITY_BITS = 1024
#: Up to so many classes, their row ids are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A shingle of more members than this may count as frequent.
FREQUENT = 8
#: Comparisons in a further round, as a multiple of the rows in shared buckets; more wait for the next round.
ROUND_FACTOR = 100


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows) for a similarity of ``percent`` / 100."""
    t = min(percent, 99) / 100
    rows = max(2, round(math.log(0.32) / math.log(t)))
    return math.ceil(math.log(MISS) / math.log1p(-(t**rows))), rows


@functools.cache
def tables(coordinates: int, ring: int = RING) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second's circular shifts: row p holds what the shifts have at place p."""
    first = np.random.default_rng(20011).permutation(ring).astype(np.int32)
    second = np.random.default_rng(20021).permutation(ring).astype(np.uint32)
    shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)
    return first, shifts


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    first, shifts = tables(coordinates)
    at = first[(shingles % np.uint64(RING)).astype(np.int64)]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(at), 2048):
        np.minimum(out, shifts[at[k : k + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature (signatures are rows of ``sig``)."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(sig), 0)
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


def shingle_sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows, and the sorted distinct shingle hashes of each row's text."""
    table, lower = is_not_space(), lower_ascii()
    for rows, data, offsets in slices(batches):
        words = scan(data, offsets, table, lower)
        h, first, sets = grams(words.hashes, k), words.first.tolist(), []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                sets.append(np.unique(h[a : b - k + 1]))
            else:
                sets.append(grams(words.hashes[a:b], b - a) if b > a else h[:0])
        yield rows, sets


def identity(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    if not len(s):
        return None
    return s.sum(dtype=np.uint64).tobytes() + mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes()


def parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(batches: Iterable[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for part, sets in shingle_sets(batches, k):
        full = [s for s in sets if len(s)]
        keys = band_keys(np.stack([signature(s, bands * rows) for s in full]), bands, rows) if full else np.zeros((0, bands), np.int64)
        ends = np.concatenate([[0], np.cumsum([bands * (len(s) > 0) for s in sets])])
        words = PARITY_BITS // 64
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * words, pa.int32()), pa.array(np.concatenate([parity(s) for s in sets])))
        columns = [part.column("row"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([identity(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())), bits]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "cls", "keys", "bits"])


def full_sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for _, sets in shingle_sets(batches, k):
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["cls", "shingles"])


def row_key(id_col: str, text_col: str):
    """Together with the id it stands for a row's id and text, in both readings of the documents."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) for every node of the links (a, b): the smallest node that it is connected with.

    Rounds of taking the smallest label of a neighbour and then that label's own label; each
    round ends in a checkpoint.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("near")).select("cls", F.least("cls", "near").alias("comp"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        low = cut(labels.join(near, "cls").select("cls", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")))
        jump = low.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        labels = cut(low.join(jump, "comp", "left").select("cls", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "was"))
        if not labels.where(F.col("comp") != F.col("was")).limit(1).count():
            return labels.select("cls", "comp")
        labels = labels.select("cls", "comp")


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``comp`` (cls, comp) after further links (a, b): a search among the components' names."""
    own = comp.select("cls", F.col("comp").alias("was"))
    name = lambda df, c: df.join(own, df[c] == own["cls"], "left").withColumn(c, F.coalesce("was", c)).drop("cls", "was")
    edges = name(name(links.select("a", "b"), "a"), "b").where("a != b").distinct()
    top = cut(components(edges))
    new = links.select(F.col("a").alias("cls")).union(links.select("b")).distinct().join(own, "cls", "left_anti")
    every = own.union(new.select("cls", F.col("cls").alias("was")))
    return cut(every.join(top.select(F.col("cls").alias("was"), "comp"), "was", "left").select("cls", F.coalesce("comp", "was").alias("comp")))


def prefix_keys(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, cls) of the rarest shingles of each class, as many as a link with any other must share one of; keys of one class are left out.

    Only shingles of more than a number of members count as frequent; it is doubled until few enough are left to be broadcast.
    """
    spread = cut(sets.join(members, "cls", "left_semi").select("cls", F.explode("shingles").alias("key")))
    counts = cut(spread.groupBy("key").agg(F.count("*").alias("members")))
    least = FREQUENT
    while counts.where(F.col("members") > least).count() > BROADCAST_ROWS:
        least *= 2
    frequent = counts.where(F.col("members") > least)
    ranked = spread.join(F.broadcast(frequent), "key", "left").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("members", F.lit(0)).alias("members"), "key"))).alias("keys"))
    size = F.size("keys")
    keep = size - F.ceil(size * F.lit(percent) / 100).cast("int") + 1
    keys = ranked.select("cls", F.explode(F.slice("keys", F.lit(1), keep)).alias("x")).select(F.col("x.key").alias("key"), "cls")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(shared, "key", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int | None = None, rows: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row (a hash of id and text), stays.

    ``stays`` holds for one (doc_id, row) of each group: that of the smallest id and hash, null ids last; and for all rows with empty sets.

    Links are pairs with ``100 * shared >= percent * union`` distinct k-word shingles.
    """
    spark = docs.sparkSession
    if bands is None or rows is None:
        bands, rows = bands_for(percent)
    plain = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = cut(map_arrow(plain, lambda batches: sketch(batches, k, bands, rows), "row long, doc_id long, n long, cls binary, keys array<long>, bits array<long>"))
    classes = cut(sketches.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("lowest"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")).alias("chosen"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    links = find_links(spark, plain, classes, k, percent)

    members = sketches.where("cls is not null").select("row", "doc_id", "n", "cls")
    if links is None:
        lowest = classes.select("cls", F.col("lowest").alias("component_id"), "chosen")
    else:
        named = classes.join(links, "cls", "left").select("cls", "lowest", "chosen", F.coalesce("comp", "cls").alias("comp"))
        named = cut(named)
        least = cut(named.groupBy("comp").agg(F.min("lowest").alias("component_id"), F.min("chosen").alias("chosen")))
        lowest = cut(named.select("cls", "comp").join(least, "comp").select("cls", "component_id", "chosen"))
    stays = F.col("doc_id").eqNullSafe(F.col("chosen.id")) & (F.col("row") == F.col("chosen.row"))
    linked = members.join(lowest, "cls").select("row", "doc_id", "n", "component_id", stays.alias("stays"))
    alone = sketches.where("cls is null").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "row", "stays")


def find_links(spark, plain: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(cls, comp) of all classes that are linked with another; None if there are none."""
    spread = classes.select("cls", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    hits = cut(spread.join(shared, "key"))
    n_hits = hits.count()
    if not n_hits:
        return None
    weight = cut(hits.groupBy("cls").agg(F.sum("members").alias("weight")))
    ranked = hits.join(weight, "cls")
    centre = cut(ranked.groupBy("key").agg(F.max(F.struct("weight", F.col("cls").alias("c"), F.col("n").alias("cn"))).alias("top")).select("key", "top.c", "top.cn"))
    width = PARITY_BITS // 64
    bits = classes.select("cls", *(F.get("bits", F.lit(j)).alias(f"b{j}") for j in range(width)))
    hits = cut(hits.select("key", "cls", "n").join(bits, "cls"))
    bits = [f"b{j}" for j in range(width)]

    def alike(n: str, m: str, other: str):
        """What every link fulfils: of sizes n and m, with columns b0, ... and the other's, which start with ``other``."""
        flips = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"{other}{b}"))) for b in bits])
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (flips * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent))

    centre = cut(centre.join(hits.select("key", F.col("cls").alias("c"), *(F.col(b).alias(f"c{b}") for b in bits)), ["key", "c"]))
    pairs = hits.join(centre, "key").where((F.col("cls") != F.col("c")) & alike("n", "cn", "c"))
    pairs = cut(pairs.select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct())

    wanted = cut(hits.select("cls").distinct().join(classes.select("cls", "row"), "cls"))
    rows_wanted = wanted.select("row")
    rows_wanted = F.broadcast(rows_wanted) if wanted.count() <= BROADCAST_ROWS else rows_wanted
    texts = plain.join(rows_wanted, "row", "left_semi").select("text")
    sets = map_arrow(texts, lambda batches: full_sets(batches, k), "cls binary, shingles array<long>")
    sets = cut(sets.where("cls is not null").dropDuplicates(["cls"]))

    comp = components(cut(confirmed(pairs, sets, percent)))
    done = hits.limit(0).select("key", "cls")
    turn, dealt, before = 0, False, None
    while True:
        placed = cut(hits.join(comp, "cls", "left").select("key", "cls", "n", F.coalesce("comp", "cls").alias("comp"), *bits))
        left = placed.join(done, ["key", "cls"], "left_anti") if turn else placed
        counts = left.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("open"), F.count("*").alias("comps")).where("comps > 1")
        open_buckets = cut(counts.select("key", F.col("main.comp").alias("main"), "open", (F.col("open") - F.col("main.size")).alias("outside")))
        work = open_buckets.agg(F.sum(F.col("outside") * F.col("open"))).first()[0]
        if not work:
            return comp
        if not dealt and work > ROUND_FACTOR * n_hits and before is not None and 2 * work > before:
            # the last round joined little: these are different texts with much in common
            members = placed.join(open_buckets.select("key"), "key", "left_semi").select("cls").distinct()
            keys = cut(prefix_keys(cut(members), sets, percent))
            dealt = True
            if (keys.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0) < work:
                hits = cut(keys.join(hits.drop("key").dropDuplicates(["cls"]), "cls").select("key", "cls", "n", *bits))
                n_hits = max(n_hits, hits.count())
                continue
        before = work
        # a bucket whose members are all connected stays so
        hits = cut(hits.join(open_buckets.select("key"), "key", "left_semi"))
        placed = placed.join(open_buckets.select("key"), "key", "left_semi")
        turn += 1
        share = min(1.0, ROUND_FACTOR * n_hits / work)
        asking = left.join(open_buckets.select("key", "main"), "key").where(F.col("comp") != F.col("main"))
        asking = cut(asking.where(F.pmod(F.xxhash64("cls", "key", F.lit(turn)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("key", F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"), *(F.col(b).alias(f"p{b}") for b in bits)))
        more = placed.join(asking, "key").where((F.col("comp") != F.col("pc")) & alike("n", "pn", "p"))
        more = more.select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        more = cut(more)
        links = cut(confirmed(more, sets, percent))
        if links.limit(1).count():
            comp = joined(comp, links)
        pairs = cut(pairs.union(more))
        done = cut(done.union(asking.select("key", F.col("p").alias("cls"))))
