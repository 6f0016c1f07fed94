"""Mix sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words: sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, …, together
they get the words of all documents, and none gets more than ``max_repeats`` times its own words; what is above goes to
the others by weight. A source takes floor(target / words) whole copies of every document, which is certain. The rest is
a sample: a document's rank is the odds of a random number, fixed by the row's content, over the odds of its inclusion,
and documents are taken in that order until the words are reached. Long documents have smaller inclusion odds, so that
none of them decides alone whether a source meets its target.

A source's documents are never brought together. Ranks are cut into buckets of about BUCKET_ROWS rows; word sums by
bucket say which buckets are taken whole, and only the one bucket in which the target is reached is put in order. Gaps
that a document too long for them leaves there are filled with later documents of that bucket, FILLS times; in the end
one more is taken if the sum comes nearer to the target with it than without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 2000
FILLS = 4
#: Sources up to which their table is broadcast; beyond it Spark chooses the join.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
RANDOM = "conv(substr(md5(concat('mix|', coalesce(cast(doc_id as string), ''), '|', coalesce(md5(text), ''))), 1, 13), 16, 10)"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one a source.

    Sources are filled by the size they can take for their weight; those before a row are full if the level that the
    words left over give the others is above what they can take. There is one row a source, so one task can order them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    ordered = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place))
    limit = F.col("source_size") * max_repeats
    by_room = Window.orderBy((limit / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ordered.select(
        "*",
        limit.alias("room"),
        (
            (F.sum("source_size").over(everywhere) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
            / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    fits = F.when(F.col("level") <= F.col("room") / F.col("weight"), F.col("level"))
    # The level rises from row to row while rows are full, so the first that fits is the highest of those that fit.
    return levels.withColumn("level", F.coalesce(F.max(fits).over(everywhere), F.lit(0.0))).select(
        "source", "source_size", "source_rows", F.least(F.col("weight") * F.col("level"), F.col("room").cast("double")).alias("target")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies * size) for every row of ``docs``.

    A null or empty text has size 0. A null source is one source, a null id an id like any other. Rows that repeat are
    drawn one by one; which of two equal rows is taken cannot be told from the result. A source without words takes
    nothing. No table of sources or documents: no rows.
    """
    sized = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            ((F.expr(RANDOM).cast("double") + 0.5) / float(1 << 52)).alias("u"),
        ),
        "mix-sizes",
    )
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "mix-sources")
    # A table with one row a source, joined to all documents: broadcast it, so that no source's rows move to one task.
    small = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda df: df
    targets = source_targets(sources, weights, max_repeats).withColumns(
        {
            "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
            "buckets": F.ceil(F.col("source_rows") / BUCKET_ROWS),
        }
    )
    targets = targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # A source without words has no share; its inclusion odds are the least.
    share, mean = F.try_divide("need", "source_size"), F.col("source_size") / F.col("source_rows")
    inclusion = F.least(F.lit(0.999), F.greatest(F.lit(1e-6), F.try_divide(share * 2 * mean, mean + F.col("size"))))
    targets = targets.withColumnRenamed("source", "s")
    ranked = (
        sized.join(small(targets), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("pi", inclusion)
        .withColumn("rank", F.col("u") / (1 - F.col("u")) / (F.col("pi") / (1 - F.col("pi"))))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "need", "rank", "bucket", "u")
    )
    ranked = written(ranked, "mix-ranks")

    along = Window.partitionBy("source").orderBy("bucket")
    filled = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    filled = filled.withColumn("upto", F.sum("words").over(along)).withColumn("over", F.col("upto") > F.col("need"))
    edge = filled.where("over").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("need") - F.col("upto") + F.col("words")).alias("gap")), "bucket").alias("e"))
    edge = edge.select(F.col("source").alias("s"), F.col("e.bucket").alias("edge"), F.col("e.gap").alias("gap"))
    # A source whose sampled words are never exceeded (need = 0 and no words) has no edge: everything is before it.
    placed = ranked.join(small(edge), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    outside = placed.where("edge is null or bucket <> edge").select("*", F.expr("coalesce(bucket < edge, true)").alias("extra"))
    inside = placed.where("bucket = edge").withColumn("extra", F.lit(False))
    order = Window.partitionBy("source").orderBy("rank", "size", "doc_id", "u")
    for _ in range(FILLS):
        fits = ~F.col("extra") & (F.col("size") <= F.col("gap"))
        inside = inside.withColumn("fits", fits).withColumn("run", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        inside = inside.withColumn("new", F.col("fits") & (F.col("run") <= F.col("gap")))
        inside = inside.withColumn("gap", F.col("gap") - F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(Window.partitionBy("source")))
        inside = inside.withColumn("extra", F.col("extra") | F.col("new")).drop("fits", "run", "new")
    # What is still missing may be less than any document left; the nearest one is taken if that brings the sum nearer.
    off = F.abs(F.col("size") - F.col("gap"))
    nearer = ~F.col("extra") & (off < F.col("gap"))
    nearest = Window.partitionBy("source").orderBy(F.when(nearer, off).asc_nulls_last(), "rank", "size", "doc_id", "u")
    inside = inside.withColumn("extra", F.col("extra") | (nearer & (F.row_number().over(nearest) == 1)))
    return outside.unionByName(inside).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("extra").cast("bigint")).alias("copies"),
        (F.col("size") * (F.col("whole") + F.col("extra").cast("bigint"))).alias("taken"),
    )
