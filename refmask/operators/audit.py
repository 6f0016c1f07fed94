"""Views of a whole corpus: which tables are used, which misspellings occur, what is missing or left behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmask.functions import lexicon as lx
from refmask.functions import text as tx
from refmask.functions.arrays import lookup
from refmask.functions.marking import with_marks
from refmask.functions.sqltext import keep_if, let, pattern, struct, transform, when
from refmask.operators.intermediate import computed_once
from refmask.operators.references import table_references
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS


def table_usage(scripts: DataFrame, keys=KEYS) -> DataFrame:
    """``canon, scripts, refs``: how many scripts name a table, and how often, for accepted references.

    References are counted by script first, so a table that all scripts use costs one row a script.
    """
    accepted = table_references(scripts, keys).filter("accepted")
    by_script = accepted.groupBy("canon", *keys).agg(F.count("*").alias("refs"))
    return by_script.groupBy("canon").agg(F.count("*").alias("scripts"), F.sum("refs").alias("refs"))


def typo_rollup(findings: DataFrame, keys=KEYS) -> DataFrame:
    """``rule, fix, scripts, findings`` over all findings of a corpus."""
    by_script = findings.groupBy("rule", "fix", *keys).agg(F.count("*").alias("findings"))
    return by_script.groupBy("rule", "fix").agg(
        F.count("*").alias("scripts"), F.sum("findings").alias("findings")
    )


# Bits of the filter for first parts: so many for each distinct one, in words of 64.
_BITS_EACH = 16
_MOST_WORDS = 1 << 20
# Names are broadcast to the scan up to this many; beyond it they are joined by shuffling, in so many copies.
BROADCAST_NAMES = 200_000
SALTS = 16


def _fronts(text: str, near: Callable[[str], str]) -> str:
    """SQL for all fronts of the dotted paths of a text as canonical names: of a.b.c also a.b and a.

    Only paths are taken whose first part is ``near``. All paths of a text are made canonical at once, joined by a mark; their
    quotes are closed. Paths that may have double-quoted parts are looked for only where there are such quotes, and of those
    the fronts without such a part are those of another path.
    """

    def of(found: str, quoted: bool) -> str:
        def cut(parts: str) -> str:
            fronts = transform(f"sequence(1, size({parts}))", lambda k: f"slice({parts}, 1, {k})")
            if quoted:
                fronts = keep_if(fronts, lambda f: f"exists({f}, y -> left(y, 1) = '\"')")
            return transform(fronts, lambda f: f"array_join({f}, '.')")

        def all_fronts(path: str) -> str:
            parts = let(f"regexp_extract_all({path}, {pattern(lx.AUDIT_QUOTED_PART)}, 0)", cut)
            return parts if quoted else when(f"contains({path}, '.')", parts, f"array({path})")

        canon = with_marks(text, lambda mark, _: let(f"concat_ws({mark}, {found})", lambda joined: f"split({tx.canonical_ref(joined)}, {mark})"))
        paths = keep_if(canon, lambda p: f"{p} <> '' AND {near(_first_of(p))}")
        return f"flatten({transform(paths, all_fronts)})"

    def with_quotes(regex: str) -> str:
        return of(keep_if(f"regexp_extract_all({text}, {pattern(regex)}, 1)", lambda q: f"contains({q}, '\"')"), True)

    plain = of(f"regexp_extract_all({text}, {pattern(lx.AUDIT_PATH)}, 0)", False)
    wide = when(f"{text} RLIKE {pattern(lx.AUDIT_WIDE_GAP)}", with_quotes(lx.AUDIT_QUOTED_WIDE), with_quotes(lx.AUDIT_QUOTED))
    return when(f"contains({text}, '\"')", f"concat({plain}, {wide})", plain)


def _first_of(path: str) -> str:
    """SQL for the first part of a canonical path."""
    quoted = f"regexp_extract({path}, {pattern(lx.AUDIT_QUOTED_PART)}, 0)"
    return when(f"left({path}, 1) IN ('[', '`', '\"')", quoted, f"substring_index({path}, '.', 1)")


def _first_part(name: str) -> str:
    """SQL for the first part of a name, in lower case."""
    quoted = f"lower(regexp_extract({name}, {pattern(lx.AUDIT_QUOTED_PART)}, 0))"
    return when(f"left({name}, 1) IN ('[', '`', '\"')", quoted, f"lower(regexp_extract({name}, {pattern(lx.AUDIT_BARE)}, 0))")


def leak_audit(annotated: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, kind, canon, times``: originals of a script that its redacted text still names.

    Every dotted path of the text, and every front of one, is looked up among the script's own originals, also in
    comments, strings and places that the redaction rules leave alone. ``annotated`` has the script's ``entries`` in the
    row, so nothing is joined; only what is found is counted by an aggregate.
    """

    def hits(row: str, fronts: str, kind: str) -> str:
        names = f"filter({row}.entries, e -> e.kind = '{kind}').canon"
        found = let(names, lambda n: f"array_compact({lookup(fronts, n, n)})")
        return transform(found, lambda c: struct(kind=f"'{kind}'", canon=c))

    def named(row: str, firsts: str) -> str:
        near = let(f"{row}.text", lambda text: _fronts(text, lambda first: f"array_contains({firsts}, {first})"))
        found = lambda fronts: f"concat({hits(row, fronts, 'table')}, {hits(row, fronts, 'column')})"
        return let(near, lambda fronts: when(f"size({fronts}) > 0", found(fronts)))

    def of(row: str) -> str:
        firsts = f"array_distinct({transform(f'{row}.entries', lambda e: _first_of(f'{e}.canon'))})"
        return when(f"size({row}.entries) > 0", let(firsts, lambda f: named(row, f)))

    # The row's text and entries may be a whole redaction: they are bound once, before any lambda refers to them.
    rows = explode_rows(annotated, keys, let(struct(text="text", entries="entries"), of))
    return rows.groupBy(*keys, F.col("row.kind").alias("kind"), F.col("row.canon").alias("canon")).agg(F.count("*").alias("times"))


def leak_audit_corpus(redacted: DataFrame, mapping: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, kind, canon, times``: originals of any script of the corpus that a redacted text names.

    A name is first reduced to its first part. Whether a path's first part may be one of those is seen from a bit filter
    of a few bits a distinct first part, in the row, before anything is exploded. Names are joined by broadcast if there
    are few (their number is counted), and otherwise by shuffling, each in SALTS copies, so that a name that
    very many scripts hold is dealt out to as many tasks.
    """
    names = computed_once(mapping.select("kind", "canon").distinct(), "audit-names")
    bits, words = _first_part_bits(names)

    def may_be(first: str) -> str:
        spot = f"pmod(xxhash64({first}), {64 * words}L)"
        return let(spot, lambda s: f"getbit(get(bits, int(shiftright({s}, 6))), int({s} & 63)) = 1")

    texts = redacted.select(*keys, "text").withColumn("bits", bits)
    fronts = explode_rows(texts, keys, let("text", lambda text: _fronts(text, may_be)))
    counted = fronts.groupBy(*keys, F.col("row").alias("canon")).agg(F.count("*").alias("times"))
    if names.count() <= BROADCAST_NAMES:
        return counted.join(F.broadcast(names), "canon").select(*keys, "kind", "canon", "times")
    salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = counted.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["canon", "_salt"]).select(*keys, "kind", "canon", "times")


def _first_part_bits(names: DataFrame) -> tuple[Column, int]:
    """The filter as one array of BIGINT, the same for every row, and its length, a power of two."""
    firsts = names.select(F.expr(_first_part("canon")).alias("first")).distinct()
    words = 1
    while words * 64 < firsts.count() * _BITS_EACH and words < _MOST_WORDS:
        words *= 2
    spots = firsts.selectExpr(f"pmod(xxhash64(first), {64 * words}L) AS spot")
    used = spots.groupBy(F.expr("int(shiftright(spot, 6))").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits"))
    every = names.sparkSession.range(words).select(F.col("id").cast("int").alias("at"))
    filled = every.join(used, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return filled.agg(F.expr("transform(sort_array(collect_list(struct(at, bits))), x -> x.bits)")).scalar(), words


def restore_coverage(edited: DataFrame, packed: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, expected, found, missing, unknown`` placeholders of every script with a mapping or an edit.

    Each placeholder counts once a script, over all its edits, spelled as restoring looks for it. ``found``
    are those of the mapping that occur, ``unknown`` those that occur and have no original.
    """
    texts = edited.select(*keys, "text")
    tokens = explode_rows(texts, keys, f"array_distinct(regexp_extract_all(text, {pattern(lx.PLACEHOLDER)}, 0))")
    used = tokens.withColumnRenamed("row", "placeholder").distinct()
    mapped = explode_rows(packed, keys, "entries.placeholder").withColumnRenamed("row", "placeholder").distinct()
    both = mapped.withColumn("mapped", F.lit(1)).join(
        used.withColumn("used", F.lit(1)), [*keys, "placeholder"], "full"
    )
    counts = both.groupBy(*keys).agg(
        F.count("mapped").alias("expected"),
        F.count_if(F.expr("mapped = 1 AND used = 1")).alias("found"),
        F.count_if(F.expr("mapped = 1 AND used IS NULL")).alias("missing"),
        F.count_if(F.expr("mapped IS NULL")).alias("unknown"),
    )
    scripts = texts.select(*keys).unionByName(packed.select(*keys)).distinct()
    numbers = ("expected", "found", "missing", "unknown")
    return scripts.join(counts, list(keys), "left").na.fill(0, list(numbers)).select(*keys, *numbers)
