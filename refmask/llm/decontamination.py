"""Find benchmark items in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window is a stretch of a document with as many words as some item. Its set is that of its distinct 5-word shingles
(A-Z in lower case), its fingerprint the 64-bit SimHash of that set, each shingle weighted by its length in characters.
Fingerprints are cut into BLOCKS blocks. If two differ in at most RADIUS bits, then in some block they differ in at most
FLIPS, so items are entered under every value within FLIPS bits of each of their blocks, and a window need only look its
own block values up: no pair within the radius is lost. Pairs within the radius are then compared exactly, by the weight
of the shared shingles over the weight of all.

Which windows: a window that shares no shingle with any item is similar to none. So only windows that line up with an
item shingle found in the document are fingerprinted; which item a window belongs to is left to the search. Everything
is DataFrame operations. A shingle is a BIGINT with its weight in the low bits, which makes sums over sets cheap.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

SHINGLE = 5
SIMILARITY = 0.8
#: Block widths of the fingerprint; RADIUS is what they guarantee with FLIPS bits of difference allowed in each. Two sets
#: at SIMILARITY differ in 10 bits on average and in more than RADIUS = 20 about once in 1000.
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
FLIPS = 2
RADIUS = len(WIDTHS) * (FLIPS + 1) - 1
#: Item shingles, and keys of documents, are broadcast to the scan of the documents up to this many, and beyond it joined by
#: shuffling.
BROADCAST_ROWS = 1_000_000
#: A shingle weighs as much as it has characters, up to 65,535 of them.
WEIGHT_BITS = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = f"filter(split(translate(text, '{UPPER}', '{UPPER.lower()}'), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"


def shingles(words: str) -> str:
    """SQL for the array of shingles of an array of words; fewer than five words are one shingle, none give none."""
    weight = f"least({(1 << WEIGHT_BITS) - 1}, %s)"

    def coded(hashed: str, length: str) -> str:
        return f"shiftleft({hashed}, {WEIGHT_BITS}) | {weight % length}"

    five = [f"{words}[i + {j}]" for j in range(SHINGLE)]
    many = f"transform(sequence(0, size({words}) - {SHINGLE}), i -> {coded(f'xxhash64({", ".join(five)})', ' + '.join(f'length({w})' for w in five))})"
    one = f"array({coded(f'xxhash64({words})', f"length(array_join({words}, ''))")})"
    return f"CASE WHEN size({words}) >= {SHINGLE} THEN {many} WHEN size({words}) > 0 THEN {one} ELSE array() END"


def grams(words: str, k: int) -> str:
    """SQL for all runs of k words as shingles, in order: what an item of k words (five: or more) can have in a text."""
    if k == SHINGLE:
        return f"CASE WHEN size({words}) >= {SHINGLE} THEN {shingles(words)} ELSE array() END"
    run = f"slice({words}, i + 1, {k})"
    code = f"shiftleft(xxhash64({run}), {WEIGHT_BITS}) | least({(1 << WEIGHT_BITS) - 1}, length(array_join({run}, '')))"
    return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> {code}) ELSE array() END"


def weight_of(codes: str) -> str:
    return f"aggregate({codes}, 0L, (a, c) -> a + (c & {(1 << WEIGHT_BITS) - 1}))"


def fingerprint(codes: str) -> str:
    """SQL for the SimHash of an array of distinct shingles: bit b is set if the shingles whose hash has it outweigh the rest."""
    vote = f"(c & {(1 << WEIGHT_BITS) - 1}) * (2 * (shiftright(xxhash64(c), b) & 1) - 1)"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if(aggregate({codes}, 0L, (a, c) -> a + {vote}) > 0, 1L, 0L), b))"


def _blocks(f: str) -> list[str]:
    shifts = [sum(WIDTHS[:k]) for k in range(len(WIDTHS))]
    return [f"shiftright({f}, {s}) & {(1 << w) - 1}" for s, w in zip(shifts, WIDTHS, strict=True)]


def _masks(width: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(width), n)]


def item_sets(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, codes (in order), distinct codes, weight and fingerprint of every item with a word."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.expr(WORDS).alias("w")).where("size(w) > 0")
    items = items.select("item_id", F.size("w").alias("n_words"), F.expr(shingles("w")).alias("codes"))
    items = items.withColumn("set", F.array_distinct("codes")).withColumn("weight", F.expr(weight_of("set")))
    return items.withColumn("f", F.expr(fingerprint("set")))


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, doc_id, start, n, set, weight, f): the windows to search for; ``docs`` has key, doc_id and text.

    The first scan finds the places that line up with an item. Their documents, which are few, are then picked by a scan that
    knows their keys, so that texts without such a place are not moved.
    """
    wanted = items.select("n_words", F.posexplode("codes").alias("at", "code")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # Items of fewer than five words are looked for as runs of as many words; without such items this adds nothing.
    sizes = [r[0] for r in items.select(F.least("n_words", F.lit(SHINGLE))).distinct().collect()]  # five values at most
    worded = docs.select("key", F.expr(WORDS).alias("w"))
    parts = [worded.select("key", F.posexplode(F.expr(grams("w", k))).alias("pos", "code")) for k in sorted(sizes) or [SHINGLE]]
    seeds = reduce(DataFrame.unionAll, parts).join(wanted, "code").select("key", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start"), "n_words").distinct()
    seeds = written(seeds.groupBy("key").agg(F.collect_set(F.struct("start", "n_words")).alias("places")), "benchmark-places")
    picked, keys = docs.select("key", "doc_id", "text"), seeds.select("key")
    if keys.count() <= BROADCAST_ROWS:
        picked = picked.join(F.broadcast(keys), "key", "left_semi")
    cut = picked.join(seeds, "key").select("key", "doc_id", F.explode("places").alias("p"), F.expr(WORDS).alias("w"))
    cut = cut.select("key", "doc_id", F.col("p.start").alias("start"), F.expr("slice(w, p.start + 1, p.n_words)").alias("w"))
    cut = cut.select("key", "doc_id", "start", F.size("w").alias("n"), F.expr(f"array_distinct({shingles('w')})").alias("set"))
    return cut.withColumn("weight", F.expr(weight_of("set"))).withColumn("f", F.expr(fingerprint("set")))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each (document, item) with a similar window: key, doc_id, item_id, and of the most similar window (the
    first of those) ``start`` and ``n_words`` in words, ``similarity`` and ``distance`` (bits).

    ``key`` is a 128-bit hash of a row's id and text, so rows equal in both are one document. Null and empty texts and items hold
    nothing. Rows with a null item id are items too. Items that share an id count as one item, best match first. A pair
    whose fingerprints are more than RADIUS bits apart is not found even if its similarity reaches the threshold; at a
    similarity of 0.8 that is about one pair in 1000, and none among exact copies.
    """
    items = written(item_sets(benchmark), "benchmark-items")
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = written(windows(keyed, items), "benchmark-windows")

    entries = items.select(
        F.monotonically_increasing_id().alias("entry"), "item_id", F.col("f").alias("item_f"), F.col("set").alias("item_set"), F.col("weight").alias("item_weight")
    )
    entries = written(entries, "benchmark-entries")
    keys = [f"transform(array({', '.join(map(str, _masks(w)))}), m -> struct({k} as block, ({b}) ^ m as value))" for k, (w, b) in enumerate(zip(WIDTHS, _blocks("item_f"), strict=True))]
    index = entries.select("entry", "item_f", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("b")).select("entry", "item_f", "b.block", "b.value")
    probes = found.select("f", F.explode(F.expr(f"array({', '.join(f'struct({k} as block, {b} as value)' for k, b in enumerate(_blocks('f')))})")).alias("b")).distinct()
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("item_f")))
    near = (
        probes.select("f", "b.block", "b.value")
        .join(index, ["block", "value"])
        .where(distance <= RADIUS)
        .select("f", "entry", distance.alias("distance"))
        .distinct()
    )
    pairs = found.join(near, "f").join(entries.drop("item_f"), "entry")
    shared = F.expr(weight_of("array_intersect(set, item_set)"))
    pairs = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.col("weight") + F.col("item_weight") - F.col("shared")))
    best = F.min_by(F.struct("start", F.col("n").alias("n_words"), "similarity", "distance"), F.struct(-F.col("similarity"), "start", "n", "distance"))
    matched = pairs.where(F.col("similarity") >= similarity).groupBy("key", "doc_id", "item_id").agg(best.alias("b"))
    return matched.select("key", "doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept, whatever their names; only ``__key`` is reserved."""
    bad = written(contaminated(docs, benchmark, similarity).select(F.col("key").alias("__key")).distinct(), "benchmark-found")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.withColumn("__key", row_key()).join(bad, "__key", "left_anti").drop("__key")
