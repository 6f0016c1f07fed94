"""Join documents on the Jaccard similarity of their word 5-grams, with adaptive multi-match prefixes.

Order all shingles in one way. If two sets of a and b shingles have similarity t or more, their first
``|x| - ceil(t |x|) + l`` shingles have at least l in common. A longer prefix (a larger l) reads longer posting lists but
leaves fewer candidates. Two such filters follow each other:

1. By hash order, with l a twentieth of the set. This looks at a quarter of all shingles and finds the documents that
   have l shingles in common with others at all. Documents with the same set are one node from here on.
2. Those left are ordered by document frequency, rare first. Each picks the l for which the estimated cost is least: the
   length of the posting lists of its prefix, plus the verification of at most (sum of those lengths) / l candidates,
   since each must use up l entries. For a pair, its two sizes tell how much it must share and so how far its prefixes reach:
   least far for sets of about the same size. It is verified if it has the smaller l of the two in common there.

Only components are asked for, so a group of near copies need not be compared all with all. Each node is first verified
against the most central node among those that share a prefix shingle (the one with the smallest part of shingles of its
own). After that, only pairs that are still in different components are candidates: in each posting list the largest
component is not paired with itself. No candidate between different components is left out, so components are exact.

Sets are compared by 64-bit hashes of shingles, nodes by a 64-bit hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import release, written
from .graph import components

SHINGLE = 5
#: Similarity of 0.8 as a ratio of whole numbers.
OVER, UNDER = 4, 5
#: In the first filter l is 1 + set size / FIRST_PART.
FIRST_PART = 20
#: Keys of the documents whose whole sets are wanted are broadcast up to this many (8 bytes each), beyond it joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Cost of verifying one candidate shingle by shingle, in entries of posting lists for each shingle of the set.
VERIFY_COST = 0.01


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n must share with any similar set."""
    return -(-n * OVER // UNDER)


def least_overlap_of_smaller(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n must share with any similar set that is not smaller."""
    return -(-2 * n * OVER // (OVER + UNDER))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of runs of rows."""
    for lo, hi, data, at in K.pieces(texts):
        data = K.lowered(data)
        starts, ends, row = K.spans(data, at, K.separators("spaces"))
        word = K.span_hashes(data, starts, ends)
        count = np.bincount(row, minlength=hi - lo)
        hashes, begin = K.runs(word, row, SHINGLE)
        hashes = hashes.view(np.int64)
        cut = np.searchsorted(row[begin], np.arange(hi - lo + 1))
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        sets = []
        for i in range(hi - lo):
            if 0 < count[i] < SHINGLE:
                sets.append(K.runs(word[first[i] : first[i + 1]], row[first[i] : first[i + 1]], int(count[i]))[0].view(np.int64))
            else:
                sets.append(np.unique(hashes[cut[i] : cut[i + 1]]))
        yield lo, sets


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set, the same for every order of its elements."""
    total = np.array([int(K.mix(s.view(K.U)).sum(dtype=K.U))], K.U)
    return int(K.mix(total + K.U(len(s))).view(np.int64)[0])


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(sets) + 1, np.int32)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def sketches(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, key, n, node, shingles) of every row: all shingles, or the first by hash that the first filter needs.

    ``key`` is passed on from ``docs``. Rows without words have n = 0, no node and no shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(2)):
                n = np.array([len(s) for s in sets])
                node = pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())
                if not whole:
                    sets = [s[: len(s) - least_overlap(len(s)) + 1 + len(s) // FIRST_PART] for s in sets]
                ids = [batch.column(i).slice(lo, len(sets)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), node, _lists(sets)], names=["doc_id", "key", "n", "node", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "key", "text").mapInArrow(run, "doc_id bigint, key bigint, n bigint, node bigint, shingles array<bigint>")


def promising(low: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` that pass the first filter. ``low``: (node, shingles) of all documents."""
    entries = low.select("node", F.explode("shingles").alias("shingle"))
    shared = entries.groupBy("shingle").agg(F.min("node").alias("one"), F.max("node").alias("other")).where("one <> other").select("shingle")
    hits = entries.join(shared, "shingle").groupBy("node").agg(F.count("*").alias("hits"))
    # Every copy of a node has brought the same shingles. A partner may be smaller and so have a smaller l.
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * OVER / UNDER) / FIRST_PART)
    return nodes.join(hits, "node").where(F.col("hits") >= least * F.col("copies")).select(*nodes.columns)


def whole_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, n, shingles) of one document of each chosen node."""
    size, repeated = chosen.agg(F.count("*"), F.max("same")).first()
    keys = chosen.select(F.col("key").alias("__key"))
    texts = docs.join(F.broadcast(keys) if size <= BROADCAST_ROWS else keys, F.col("key") == F.col("__key"), "left_semi")
    sets = sketches(texts, whole=True).select("node", "n", "shingles")
    # Only rows that are equal in id and text can still be of one node.
    return sets.dropDuplicates(["node"]) if (repeated or 0) > 1 else sets


def shared_shingles(full: DataFrame) -> DataFrame:
    """(node, n, own, shared) of the nodes with so few shingles of their own that they may have partners.

    ``shared`` are the shingles that other nodes have too, with their document frequencies, rarest first.
    """
    entries = full.select("node", F.explode("shingles").alias("shingle"))
    frequent = entries.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(frequent, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    shared = shared.join(full.select("node", "n"), "node").select("node", "n", (F.col("n") - F.size("shared")).alias("own"), "shared")
    return shared.where(F.col("n") - F.ceil(F.col("n") * OVER / UNDER) >= F.col("own"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, own, shared: list of (df, shingle), sorted) to (…, l, prefix) with the cheapest l; none: empty."""
    for batch in batches:
        n, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        shared = batch.column(3)
        at, flat = shared.offsets.to_numpy(), shared.values
        df = flat.field("df").to_numpy(zero_copy_only=False)
        shingle = flat.field("shingle").to_numpy(zero_copy_only=False)
        matches, prefixes = np.zeros(batch.num_rows, np.int64), []
        for i in range(batch.num_rows):
            a, b = at[i], at[i + 1]
            first = n[i] - least_overlap(n[i]) + 1 - own[i]  # shared shingles in the prefix for l = 1
            if first <= 0:  # even the shortest prefix holds nothing that others have
                prefixes.append(shingle[a:a])
                continue
            # Estimated for partners of the same size, which need a shorter prefix.
            length = np.concatenate([[0], np.cumsum(df[a:b] - 1)])
            k = np.arange(first, b - a + 1)
            level = k - first + 1
            same = np.clip(n[i] - least_overlap_of_smaller(n[i]) + level - own[i], 0, b - a)
            cost = length[same] * (1 + VERIFY_COST * n[i] / level)
            best = int(np.argmin(cost))
            matches[i] = level[best]
            prefixes.append(shingle[a : a + k[best]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(matches), _lists(prefixes)], names=["node", "n", "own", "l", "prefix"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. ``sets``: (node, n, shared), the shingles of a node that others have."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(both * (OVER + UNDER) >= (F.col("n_a") + F.col("n_b")) * OVER)
        .select("a", "b")
    )


def _close(a: str, b: str) -> str:
    """Set sizes that allow the similarity."""
    return f"{a} * {UNDER} >= {b} * {OVER} AND {b} * {UNDER} >= {a} * {OVER}"


def candidates(placed: DataFrame) -> DataFrame:
    """Pairs (a, b), a the smaller set, that are in different components and share enough prefix shingles.

    ``placed``: postings (shingle, at, short, node, n, l) with ``root``, and ``home``, the largest component of the
    shingle's list. Similar sets of a and b shingles share o or more, so the first a - o + l and b - o + l of them have l
    in common, for the smaller l of the two; entries beyond those places say nothing about this pair.
    """
    columns = ("node", "n", "l", "at", "root")
    few = placed.where("short").select("shingle", "home", *(F.col(c).alias(f"{c}_a") for c in columns))
    many = placed.select("shingle", *(F.col(c).alias(f"{c}_b") for c in columns), (F.col("root") != F.col("home")).alias("stranger"))
    reach = f"least(l_a, l_b) - ceil((n_a + n_b) * {OVER} / {OVER + UNDER})"
    fits = (
        f"root_a <> root_b AND (n_a < n_b OR n_a = n_b AND node_a < node_b) AND {_close('n_a', 'n_b')}"
        f" AND at_a < n_a + {reach} AND at_b < n_b + {reach}"
    )
    # The component that is at home in a list is not paired with itself.
    met = few.where("root_a <> home").join(many, "shingle").where(fits).select("node_a", "node_b", "l_a", "l_b")
    met = met.unionAll(few.where("root_a = home").join(many.where("stranger"), "shingle").where(fits).select(*met.columns))
    shared = met.groupBy("node_a", "node_b").agg(F.count("*").alias("hits"), F.first(F.least("l_a", "l_b")).alias("l"))
    return shared.where("hits >= l").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def node_components(docs: DataFrame, nodes: DataFrame, low: DataFrame) -> DataFrame:
    """(node, root) of the nodes that link with another node."""
    spark = docs.sparkSession
    chosen = written(promising(low, nodes), "jaccard-promising")
    release(spark)
    full = written(whole_sets(docs, chosen), "jaccard-sets")
    release(spark)
    shared = written(shared_shingles(full), "jaccard-shared")
    release(spark)
    sets = shared.select("node", "n", F.col("shared.shingle").alias("shared"))
    prefixes = shared.mapInArrow(_prefixes, "node bigint, n bigint, own bigint, l bigint, prefix array<bigint>")
    postings = prefixes.select("node", "n", "own", "l", F.posexplode("prefix").alias("at", "shingle"))
    # As the smaller of two sets, a node needs only its first shingles: the larger one has to have more of them.
    postings = postings.withColumn("at", F.col("own") + F.col("at"))
    short = F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * OVER) / (OVER + UNDER)) + F.col("l")
    postings = written(postings.select("node", "n", "own", "l", "at", "shingle", short.alias("short")), "jaccard-postings")

    central = postings.groupBy("shingle").agg(F.min(F.struct(F.col("own") / F.col("n"), F.col("node").alias("b"), F.col("n").alias("n_b"))).alias("c"))
    stars = (
        postings.join(central.select("shingle", "c.b", "c.n_b"), "shingle")
        .where(f"node <> b AND {_close('n', 'n_b')}")
        .groupBy("node", "b")
        .agg(F.count("*").alias("hits"))
        .groupBy("node")
        .agg(F.max_by("b", F.struct("hits", "b")).alias("b"))
        .select(F.col("node").alias("a"), "b")
    )
    links = written(verified(stars, sets), "jaccard-stars")
    roots = written(components(links, "jaccard-stars"), "jaccard-roots")

    placed = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = placed.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    homes = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("home"), F.count("*").alias("roots")).where("roots > 1")
    placed = written(placed.join(homes.select("shingle", "home"), "shingle"), "jaccard-open")
    rest = candidates(placed)
    more = written(verified(rest, sets), "jaccard-rest")
    if more.isEmpty():
        return roots
    return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "jaccard-all"), "jaccard-roots")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles and component_id of every row of ``docs``; ``key`` is a hash of a row's id and text.

    component_id is the smallest doc_id that links reach, itself included; null ids are never the smallest, and a
    component of null ids alone has a null one. Rows without words (null, empty, white space) have no shingles and link
    with nothing. A text of fewer than five words is one shingle. Rows that repeat have equal sets and so link, as do
    rows that share an id only through their texts.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    rows = written(sketches(docs, whole=False), "jaccard-sketches")
    members = rows.select("doc_id", "key", "n", "node")
    by_key = members.where("n > 0").groupBy("node", "key").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("same"))
    nodes = by_key.groupBy("node").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.sum("same").alias("copies"), F.min_by(F.struct("key", "same"), "key").alias("one")
    )
    nodes = written(nodes.select("node", "n", "doc_id", "copies", "one.key", "one.same"), "jaccard-nodes")
    roots = node_components(docs, nodes, rows.where("n > 0").select("node", "shingles"))
    placed = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = placed.join(least, "root").select("node", "component_id")
    return members.join(by_node, "node", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that of the smallest doc_id, of those the smallest key.

    Rows without words all stay. Of a component of null ids alone one row for each set stays.
    """
    spark = docs.sparkSession
    found = written(similar_documents(docs), "jaccard-found")
    release(spark)
    worded = found.where("n_shingles > 0")
    # A null component_id stands for components without any id; they are told apart by the row's key.
    group = F.when(F.col("component_id").isNotNull(), F.struct("component_id", F.lit(0).cast("bigint").alias("k"))).otherwise(F.struct("component_id", F.col("key").alias("k")))
    best = worded.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m"))
    kept = best.select(F.col("m.key").alias("__kept"), F.lit(True).alias("__once"))
    wordless = found.where("n_shingles = 0").select(F.col("key").alias("__kept"), F.lit(False).alias("__once")).distinct()
    keep = written(kept.unionAll(wordless), "jaccard-kept")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    repeated = worded.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.join(keep, F.col("key") == F.col("__kept"), "left_semi").isEmpty():
        return keyed.join(keep, F.col("__key") == F.col("__kept"), "left_semi").drop("__key")
    # Some row that stays is there several times, equal in id and text.
    out = keyed.join(keep, F.col("__key") == F.col("__kept"))
    return out.where("NOT __once").unionAll(out.where("__once").dropDuplicates(["__key"])).drop("__key", "__kept", "__once")
