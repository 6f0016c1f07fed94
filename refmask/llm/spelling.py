"""Spelling variants: words one edit apart, found by walking a trie that is a distributed table of edges, level by level.

A trie's nodes are prefixes, its edges a table of (node, label, child). A state (word, place, node, edits) says that the
word up to that place, with so many edits, spells the node. Each level joins the states with that level's edges: states
without an edit with all edges of their node, trying one replaced, inserted or deleted character within the label; states
with the edit spent with the one edge that spells the word's next characters. A state at a whole word's node, with the
edit spent and nothing of its own word left, is a neighbour.

An edge's row holds its child, from which its node and label follow, and what comes next below the child, AHEAD characters
far. So most states that would come to nothing are not made, and a word's end is seen AHEAD characters early.

There are two tries, of the words and of the words reversed. An edit in a word's second half leaves its first half as it
is, one in the first half leaves the other one. So a word enters each trie at the node of its first half, where few edges
lead on, rather than at the root, which all words share. Labels have one character up to depth NARROW and then grow
with the depth, so the number of levels grows with the logarithm of the longest word.

The states of a level are a written table; nothing is collected but the length of the longest word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form must be so many times as frequent.
RATIO = 10
#: Up to this depth a level is one character wide, beyond it a quarter of the depth.
NARROW = 8
AHEAD = 3
# What a word is preceded by in the trie of words, and in that of words reversed; what follows its end.
ONWARD, BACK, END = "0", "1", "$"


def boundaries(least: int, longest: int) -> list[int]:
    """Depths of the trie's levels, from half of the least word length to past the longest word."""
    depths = [least // 2]
    while depths[-1] <= longest:
        depths.append(depths[-1] + (1 if depths[-1] < NARROW else depths[-1] // 4))
    return depths


def word_counts(docs: DataFrame, every: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that occur ``least_count`` times or more in all texts.

    A word is a maximal run of letters, A-Z in lower case. With ``every``, a run loses one code point if the crc32 of
    ``<doc_id>:<run>`` is divisible by it: planted misspellings. Null texts have none; runs of a null doc_id stay whole.
    """
    runs = docs.select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, '{LETTERS}{{{least_length},}}', 0)")).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, UPPER.lower()))
    if every:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
        runs = runs.withColumn("h", h)
        at = "cast(h % length(run) as int)"
        runs = runs.withColumn("run", F.expr(f"CASE WHEN h % {every} = 0 THEN concat(substr(run, 1, {at}), substr(run, {at} + 2)) ELSE run END"))
    counts = runs.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _next(word: str, place: str) -> str:
    """SQL for what follows a place in a word, AHEAD characters far, its end included."""
    return f"substr(concat(substr({word}, {place} + 1), '{END}'), 1, {AHEAD})"


def edge_table(words: DataFrame, depth: int, width: int) -> DataFrame:
    """(child, ahead) of the edges that leave the depth; ``words`` (w) begin with the mark of their trie. A node's edges are
    those whose child begins with it. ``ahead`` has what comes next below the child, a few hundred kinds at most."""
    longer = words.where(F.length("w") > depth).selectExpr(f"substr(w, 1, {depth + width}) AS child", f"{_next('w', str(depth + width))} AS next")
    return longer.groupBy("child").agg(F.collect_set("next").alias("ahead"))


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, near) of all pairs of ``words`` (word; each once, none shorter than ``least_length``) that differ by one
    inserted, deleted or replaced code point; each pair in both orders, some of them more than once."""
    both = words.select(F.concat(F.lit(ONWARD), "word").alias("w")).unionAll(words.select(F.concat(F.lit(BACK), F.reverse("word"))))
    both = written(both, "spelling-words")
    longest = both.agg(F.max(F.length("w"))).first()[0] or 0
    # Depths count the mark.
    depths = [d + 1 for d in boundaries(least_length, longest)]
    spent, found = None, None
    for depth, after in zip(depths, depths[1:], strict=False):
        width = after - depth
        edges = edge_table(both, depth, width)
        # Words whose first half reaches this depth: before it there is no edit to be found in this trie.
        here = both.where((F.length("w") >= depth) & (_entry(depths) <= depth))
        met = here.join(edges, F.substring("w", 1, depth) == F.substring("child", 1, depth))
        tried = met.select("w", "child", "ahead", F.explode(F.expr("transform(array(-1, 0, 1), s -> length(child) + s)")).alias("place"))
        one_edit = f"levenshtein(substr(child, {depth + 1}), substr(w, {depth + 1}, place - {depth}), 1) = 1"
        states = tried.where(f"place <= length(w) AND {one_edit}")
        if spent is not None:
            ahead = spent.select("w", "place", F.expr(f"concat(child, substr(w, place + 1, {width}))").alias("child"), F.length("child").alias("was"))
            moved = ahead.join(edges, "child").select("w", "child", "ahead", (F.col("place") + F.length("child") - F.col("was")).alias("place"))
            states = states.unionByName(moved)
        states = states.where(f"array_contains(ahead, {_next('w', 'place')})").select("w", "place", "child")
        states = written(states, f"spelling-{depth}")
        # Few characters are left, and they have been seen to lead to a word.
        ready = states.where(f"length(w) - place < {AHEAD}").selectExpr("w", "concat(child, substr(w, place + 1)) AS near")
        found = ready if found is None else found.unionAll(ready)
        spent = states.where(f"length(w) - place >= {AHEAD}")
    if found is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    onward = F.substring("w", 1, 1) == ONWARD
    plain = [F.when(onward, F.expr(f"substr({c}, 2)")).otherwise(F.reverse(F.expr(f"substr({c}, 2)"))).alias(n) for c, n in (("w", "word"), ("near", "near"))]
    return found.select(*plain)


def _entry(depths: list[int]) -> Column:
    """The greatest depth that holds at most half of a word, and the mark."""
    half = F.floor((F.length("w") - 1) / 2) + 1
    out = F.lit(depths[0])
    for d in depths[1:]:
        out = F.when(half >= d, F.lit(d)).otherwise(out)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last. A form is ten times as frequent as its word, so
    chains are short and end; each round doubles how far they are followed."""
    state = written(forms.select("word", F.col("form").alias("root")), "spelling-roots-0")
    k = 0
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if state.join(step, "root", "left_semi").isEmpty():
            return state
        k += 1
        state = written(state.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"spelling-roots-{k}")


def spelling_variants(counts: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, form, root, n, n_near and form_n for every row of ``counts`` (word, n).

    ``form`` is the most frequent near word (ties: first by code point) if it is ``ratio`` times as frequent as the word or
    more, else null; ``root`` is where forms lead to, the word itself without a form; ``n_near`` counts near words. Rows
    with a null word, or one shorter than ``least_length``, are left out; a word listed twice counts with its sum. An empty
    table gives an empty one.
    """
    counts = counts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "spelling-counts")
    near = neighbours(counts.select("word"), least_length)
    ranked = near.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), F.struct(-F.col("near_n"), F.col("near")))
    # A word has a bounded number of near words: dealt out by word, each is made to count once and ranked in one place.
    once = ranked.repartition("word").dropDuplicates(["word", "near"])
    by_word = once.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = counts.join(by_word, "word", "left").withColumn("fits", F.col("best.form_n") >= ratio * F.col("n"))
    table = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("fits"), F.col("best.form")).alias("form"), F.when(F.col("fits"), F.col("best.form_n")).alias("form_n")
    )
    table = written(table, "spelling-forms")
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
