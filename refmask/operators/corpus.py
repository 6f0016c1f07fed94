"""One dictionary for a whole corpus: a table has the same placeholder in every script, and keeps it in later runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refmask.functions import lexicon as lx
from refmask.functions.redact import ENTRIES_TYPE
from refmask.functions.restore import restore
from refmask.functions.sqltext import keep_if, let, pattern, struct, transform
from refmask.operators.intermediate import computed_once
from refmask.operators.mapping import mapping_table, pack_mapping
from refmask.operators.ranking import running_total
from refmask.operators.restoration import with_entries
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS

# Up to so many names are looked up in the script's row; more are joined. The rows are the same.
ROW_NAMES = 10_000
# Names are dealt out by the first digits of a hash; each share is numbered on its own.
_SHARE_DIGITS = 2
DICTIONARY = ("kind", "canon", "original", "n", "placeholder")


def taken_numbers(scripts: DataFrame) -> DataFrame:
    """``kind, n``: numbers of placeholders that the scripts hold as they come, each once.

    These mean something else there, so the corpus must not give them out. Digits that no placeholder has (leading
    zeros, more than a BIGINT holds) are left out.
    """
    kinds = (("table", lx.TABLE_PLACEHOLDER, lx.TABLE_NUMBERS), ("column", lx.COLUMN_PLACEHOLDER, lx.COLUMN_NUMBERS))
    found = [
        f"CASE WHEN contains(text, '{prefix}') THEN transform(array_distinct(regexp_extract_all(text, {pattern(numbers)}, 1)), "
        f"d -> named_struct('kind', '{kind}', 'digits', d)) ELSE array() END"
        for kind, prefix, numbers in kinds
    ]
    digits = explode_rows(scripts, (), f"concat({', '.join(found)})").select("row.kind", "row.digits").distinct()
    numbers = digits.withColumn("n", F.expr("try_cast(digits AS BIGINT)"))
    return numbers.filter("n > 0 AND CAST(n AS STRING) = digits").select("kind", "n")


def _ranked(mapping: DataFrame, keys) -> DataFrame:
    """``kind, canon, original, k``: distinct names, numbered from 1 a kind without holes.

    ``original`` is the spelling of the first script. Numbers follow (hash share, canon), so no task
    orders all names: shares are numbered apart and shifted by the sizes of those before, one row each.
    """
    first = mapping.groupBy("kind", "canon").agg(
        F.min_by("original", F.struct(*keys, "n")).alias("original")
    )
    names = computed_once(first.withColumn("share", F.substring(F.md5("canon"), 1, _SHARE_DIGITS)), "corpus-names")
    sizes = names.groupBy("kind", "share").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("kind").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("kind", "share", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("kind", "share").orderBy("canon"))
    ranked = names.withColumn("within", within).join(starts, ["kind", "share"])
    return ranked.select("kind", "canon", "original", (F.col("start") + F.col("within")).alias("k"))


def around_taken(ranked: DataFrame, taken: DataFrame) -> DataFrame:
    """``ranked`` (kind, k, …) with ``n``, the k-th number of its kind that is not among ``taken`` (kind, n; each once).

    The j-th taken number t has t - j free ones below it, so it shifts every rank above t - j by one. The number of
    taken ones at or below a rank's number is thus a running total over ranks. Both orders, that of the taken
    numbers and that of the ranks, are dealt out by ranges.
    """
    taken = computed_once(taken.select("kind", "n"), "corpus-taken")
    # A taken number beyond all that can be given out shifts nothing.
    names = ranked.groupBy("kind").agg(F.max("k").alias("names"))
    most = taken.groupBy("kind").agg(F.count("*").alias("holes")).join(names, "kind")
    near = taken.join(F.broadcast(most), "kind").filter("n <= names + holes")
    ordered = running_total(near.select("kind", "n", F.lit(1).cast("bigint").alias("one")), "kind", "n", "one", "j")
    shifts = ordered.groupBy("kind", F.expr("n - j + 1").alias("at")).agg(F.count("*").alias("by"))
    columns = [c for c in ranked.columns if c != "kind"]
    row = F.struct(*columns)
    together = ranked.select("kind", F.col("k").alias("at"), F.lit(0).cast("bigint").alias("by"), row.alias("row")).unionByName(
        shifts.select("kind", "at", "by"), allowMissingColumns=True
    )
    placed = running_total(computed_once(together, "corpus-ranks"), "kind", "at", "by", "shift").filter("row IS NOT NULL")
    return placed.select("kind", "row.*", (F.col("at") + F.col("shift")).alias("n"))


def corpus_dictionary(mapping: DataFrame, keys=KEYS, taken: DataFrame | None = None) -> DataFrame:
    """``kind, canon, original, n, placeholder``: one row per name of the corpus, numbered per kind.

    Numbers start from 1 and leave out those in ``taken`` (``taken_numbers`` of the original scripts).
    """
    ranked = _ranked(mapping, keys)
    numbered = ranked.withColumn("n", F.col("k")) if taken is None else around_taken(ranked, taken)
    return _with_placeholder(numbered)


def grow_dictionary(dictionary: DataFrame, mapping: DataFrame, keys=KEYS, taken: DataFrame | None = None) -> DataFrame:
    """The rows to add to ``dictionary`` for the names of ``mapping`` that it lacks; none of its own rows changes.

    New names are numbered above the greatest number given out so far, around those in ``taken``. Store them beside
    the old ones (say, a folder a version): the dictionary of a version is the union of all up to it. A placeholder of
    the dictionary that later scripts bring along themselves is told by ``dictionary_clashes``.
    """
    known = dictionary.select("kind", "canon")
    ranked = _ranked(mapping.join(known, ["kind", "canon"], "left_anti"), keys)
    # Two kinds, so two rows.
    greatest = F.broadcast(dictionary.groupBy("kind").agg(F.max("n").alias("greatest")))
    if taken is None:
        numbered = ranked.withColumn("n", F.col("k"))
    else:
        above = taken.join(greatest, "kind", "left").select("kind", F.expr("n - coalesce(greatest, 0)").alias("n"))
        numbered = around_taken(ranked, above.filter("n > 0"))
    shifted = numbered.join(greatest, "kind", "left").withColumn("n", F.expr("n + coalesce(greatest, 0)"))
    return _with_placeholder(shifted)


def dictionary_clashes(dictionary: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of ``dictionary`` whose placeholder stands in scripts as they come."""
    return dictionary.join(taken.select("kind", "n"), ["kind", "n"], "left_semi").select(*DICTIONARY)


def _with_placeholder(numbered: DataFrame) -> DataFrame:
    prefix = F.when(F.col("kind") == "column", lx.COLUMN_PLACEHOLDER).otherwise(lx.TABLE_PLACEHOLDER)
    return numbered.select("kind", "canon", "original", "n", F.concat(prefix, F.col("n").cast("string")).alias("placeholder"))


def redact_with_dictionary(redacted: DataFrame, mapping: DataFrame, dictionary: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, text``: redacted scripts with the placeholders of the corpus instead of their own.

    The join is on distinct (script, name) pairs; a name that most scripts use is a skewed key of an
    ordinary join, which adaptive execution splits. Placeholders that a script brought along stay.
    """
    renamed = mapping.select(*keys, "kind", "canon", "n", "placeholder").join(
        dictionary.select("kind", "canon", F.col("placeholder").alias("original")), ["kind", "canon"]
    )
    packed = pack_mapping(renamed, keys)
    texts = with_entries(redacted.select(*keys, "text"), packed, keys)
    return texts.select(*keys, F.expr(restore("text", "entries")).alias("text"))


def redact_annotated_with_dictionary(annotated: DataFrame, dictionary: DataFrame, keys=KEYS) -> DataFrame:
    """``redact_with_dictionary`` for scripts that carry their own ``entries``: the same rows.

    Few names are looked up in the row, so that neither texts nor names move; only keys are shuffled, to find those that
    several scripts have. These take a mapping of all of them, and scripts without a key keep their own placeholders, as
    in the join.
    """
    dictionary = computed_once(dictionary, "corpus-dictionary")
    count = dictionary.count()
    if count > ROW_NAMES:
        return redact_with_dictionary(annotated, mapping_table(annotated, keys), dictionary, keys)
    own = annotated.select(*keys, "text", "entries").withColumn("_names", _by_hash(dictionary, count))
    renamed = own.select(*keys, "text", F.expr(f"CAST({_renamed(count)} AS {ENTRIES_TYPE})").alias("entries"))
    repeated = computed_once(annotated.groupBy(*keys).agg(F.count("*").alias("_scripts")).filter("_scripts > 1").drop("_scripts"), "corpus-repeated-keys")
    if not repeated.isEmpty():
        once = renamed.join(repeated, list(keys), "left_anti")
        several = renamed.join(repeated, list(keys), "left_semi")
        renamed = once.unionByName(with_entries(several.drop("entries"), pack_mapping(mapping_table(several, keys), keys), keys))
    has_key = " AND ".join(f"`{key}` IS NOT NULL" for key in keys)
    return renamed.select(*keys, F.expr(f"CASE WHEN {has_key} THEN {restore('text', 'entries')} ELSE text END").alias("text"))


def _by_hash(dictionary: DataFrame, count: int) -> Column:
    """The dictionary as one array, the same for every row: at each place the names whose hash falls there."""
    name = F.struct("kind", "canon", "placeholder")
    used = dictionary.groupBy(F.expr(_place("kind", "canon", count)).alias("at")).agg(F.collect_list(name).alias("names"))
    places = dictionary.sparkSession.range(max(count, 1)).select(F.col("id").cast("int").alias("at"))
    return places.join(used, "at", "left").agg(F.expr("transform(sort_array(collect_list(struct(at, names))), x -> x.names)")).scalar()


def _place(kind: str, canon: str, count: int) -> str:
    return f"int(pmod(xxhash64({kind}, {canon}), {max(count, 1)}L))"


def _renamed(count: int) -> str:
    """SQL for ``entries`` with the dictionary's placeholders as originals, without the names that it lacks."""

    def of(names: str) -> str:
        def name(e: str) -> str:
            same = keep_if(f"get({names}, {_place(f'{e}.kind', f'{e}.canon', count)})", lambda x: f"{x}.kind = {e}.kind AND {x}.canon = {e}.canon")
            return struct(n=f"{e}.n", placeholder=f"{e}.placeholder", kind=f"{e}.kind", original=f"get({same}, 0).placeholder", canon=f"{e}.canon")

        return keep_if(let("entries", lambda entries: transform(entries, name)), lambda e: f"{e}.original IS NOT NULL")

    return let("_names", of)
