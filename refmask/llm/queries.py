"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    test = held_out("doc_id", 3, 1)
    return identify(docs, fit(docs.where(~test & F.col("doc_id").isNotNull())), test.alias("held_out"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, score_texts

    docs, test = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels"), ~test), "doc_id", test.alias("held_out"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0)).drop("margin")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_texts

    docs, test = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels"), ~test), "doc_id", test.alias("held_out"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each removed place, in characters of the original text."""
    from .line_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("key")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, filter_urls, labelled_table

    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
    return filter_urls(table(spark, sf_dir, "pages"), rules, labelled_table(spark))


def _mix_oracle() -> str:
    from .source_mixing import BUCKET_ROWS, FILLS

    fills, last = "", "f0"
    for i in range(FILLS):
        fills += f"""
, c{i} AS (SELECT *, NOT extra AND size <= gap AS fits,
    SUM(CASE WHEN NOT extra AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, size, doc_id NULLS FIRST, u ROWS UNBOUNDED PRECEDING) AS run FROM {last})
, n{i} AS (SELECT * EXCLUDE (fits, run), fits AND run <= gap AS new FROM c{i})
, f{i + 1} AS (SELECT * EXCLUDE (gap, extra, new), gap - SUM(CASE WHEN new THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap, extra OR new AS extra FROM n{i})"""
        last = f"f{i + 1}"
    return f"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix|' || COALESCE(doc_id::VARCHAR, '') || '|' || COALESCE(md5(text), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents)
, per AS (SELECT source, SUM(size)::BIGINT AS source_size, COUNT(*) AS source_rows FROM sized GROUP BY source)
, w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS room FROM per)
, l AS (SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(room) OVER before, 0))::DOUBLE / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, h AS (SELECT COALESCE(MAX(level) FILTER (level <= room / weight), 0.0) AS top FROM l)
, t AS (SELECT source, source_size, source_rows, LEAST(weight * top, room::DOUBLE) AS target, CEIL(source_rows / {BUCKET_ROWS}.0) AS buckets FROM l, h)
, t2 AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)
, t3 AS (SELECT *, target - whole * source_size AS need FROM t2)
, p AS (SELECT s.doc_id, s.source, s.size, s.u, t3.source_size, t3.target, t3.whole, t3.need, t3.buckets,
    LEAST(0.999::DOUBLE, GREATEST(1e-6::DOUBLE, need / NULLIF(source_size, 0) * 2 * (source_size / source_rows) / NULLIF((source_size / source_rows) + size, 0))) AS pi
  FROM sized s JOIN t3 ON s.source IS NOT DISTINCT FROM t3.source)
, r AS (SELECT *, u / (1 - u) / (pi / (1 - pi)) AS rank FROM p)
, b AS (SELECT *, FLOOR(rank / (1 + rank) * buckets)::BIGINT AS bucket FROM r)
, g AS (SELECT source, bucket, SUM(size) AS words, MAX(need) AS need FROM b GROUP BY source, bucket)
, o AS (SELECT *, SUM(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM g)
, e AS (SELECT source, MIN(bucket) AS edge, ARG_MIN(need - upto + words, bucket) AS gap FROM o WHERE upto > need GROUP BY source)
, pl AS (SELECT b.*, e.edge, e.gap FROM b LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source)
, f0 AS (SELECT *, false AS extra FROM pl WHERE bucket = edge){fills}
, z AS (SELECT *, NOT extra AND ABS(size - gap) < gap AS nearer FROM {last})
, done AS (SELECT doc_id, size, source_size, target, whole, extra OR (nearer AND row_number() OVER (PARTITION BY source ORDER BY CASE WHEN nearer THEN ABS(size - gap) END NULLS LAST, rank, size, doc_id NULLS FIRST, u) = 1) AS extra FROM z
  UNION ALL SELECT doc_id, size, source_size, target, whole, COALESCE(bucket < edge, true) FROM pl WHERE edge IS NULL OR bucket <> edge)
SELECT doc_id, size, source_size, target, (size * (whole + extra::BIGINT))::BIGINT AS taken FROM done"""


ORACLES["op3_source_mixing"] = _mix_oracle()


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def _repeats_oracle() -> str:
    from .line_dedup import BORDER_BITS, MIN_WORDS

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(text) AS chars, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') AS pieces,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL)
, p AS (SELECT r, chars, unnest(range(1, len(w) + 1)) AS i, unnest(pieces) AS piece, unnest(w) AS word, len(w) AS n FROM d)
, q AS (SELECT r, i, n, i = 1 OR contains(piece, chr(10)) AS by_line, chars,
    i = 1 OR ('0x' || substr(md5(word), 1, 1))::INT // {1 << (4 - BORDER_BITS)} = lag(('0x' || substr(md5(word), 1, 1))::INT // {1 << (4 - BORDER_BITS)}) OVER o AS by_words,
    SUM(length(piece)) OVER o - length(word) AS start FROM p WINDOW o AS (PARTITION BY r ORDER BY i))
, u AS (SELECT r, 'line' AS cut, i FROM q WHERE by_line UNION ALL SELECT r, 'words', i FROM q WHERE by_words)
, b AS (SELECT * FROM u UNION ALL SELECT r, cut, len(w) + 1 FROM d, (VALUES ('line'), ('words')) x(cut) WHERE len(w) > 0)
, s AS (SELECT DISTINCT u.r, u.i, b.i AS j FROM u ASOF JOIN b ON u.r = b.r AND u.cut = b.cut AND u.i + {MIN_WORDS} <= b.i)
, t AS (SELECT s.r, doc_id, i, j, md5(array_to_string(w[i:j - 1], ' ')) AS digest FROM s JOIN d USING (r))
, k AS (SELECT r, i, j FROM t QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS FIRST, i) > 1)
, g AS (SELECT *, COALESCE(i > MAX(j) OVER (PARTITION BY r ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM k)
, h AS (SELECT r, MIN(i) AS i, MAX(j) AS j FROM (SELECT *, SUM(new::INT) OVER (PARTITION BY r ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS part FROM g) GROUP BY r, part)
SELECT doc_id, a.start::BIGINT AS start, (COALESCE(z.start, d.chars) - a.start)::BIGINT AS length
FROM h JOIN d USING (r) JOIN q a ON a.r = h.r AND a.i = h.i LEFT JOIN q z ON z.r = h.r AND z.i = h.j"""


ORACLES["op9_line_dedup"] = _repeats_oracle()


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).drop("key")


ORACLES["op4_ngram_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
, s AS (SELECT DISTINCT r, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT r, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM w))
, n AS (SELECT r, COUNT(*) AS n FROM s GROUP BY r)
, p AS (SELECT a.r AS a, b.r AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r)
, l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c))
, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
, reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
, m AS (SELECT reach.a AS r, MIN(d.doc_id) AS m FROM reach JOIN w d ON d.r = reach.b GROUP BY reach.a)
SELECT w.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE m.m END AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits, whose places and texts follow from the document itself."""
    from .token_counts import apply_edits, token_trees

    def number(k: int, what: str, below: str) -> str:
        return f"pmod(xxhash64(doc_id, {k}, '{what}'), {below})"

    edits = ", ".join(
        f"named_struct('start', {number(k, 'start', 'length(text) + 1')}, 'length', {number(k, 'length', '40L')},"
        f" 'insert', substr(text, cast({number(k, 'from', 'length(text) + 1')} as int), cast({number(k, 'insert', '60')} as int)))"
        for k in range(3)
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(f"array({edits})").alias("edits"))
    trees = token_trees(docs, "doc_id", "edits").withColumnRenamed("n_tokens", "n_tokens_before")
    edited = apply_edits(trees, "doc_id", "n_tokens_before")
    return edited.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), F.length("text").cast("bigint").alias("n_chars_after"), "encoded")


def _rules_oracle() -> str:
    from .quality_rules import DELTA, RISK, RULES, STEPS

    share = RISK / len(RULES)
    steps = ", ".join(f"CASE WHEN {b} > 0 THEN LEAST({STEPS}, {a} * {STEPS} // {b}) ELSE 0 END AS step_{r}" for r, (a, b) in ((r, x.split(" / ")) for r, x in RULES.items()))
    long = " UNION ALL ".join(f"SELECT r, stratum, '{r}' AS rule, step_{r} AS step FROM st" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(lang, '') AS stratum, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
, l AS (SELECT r, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT u) AS n_dup_lines FROM (SELECT r, unnest(str_split(text, chr(10))) AS u FROM d)
  WHERE regexp_matches(u, '[^\\x20\\x09-\\x0D]') GROUP BY r)
, g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
, t AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1)
, p AS (SELECT r, COUNT(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM t) GROUP BY r)
, s AS (SELECT d.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_capitals,
    COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_dup_lines, 0)::BIGINT AS n_dup_lines, COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (r) LEFT JOIN p USING (r))
, st AS (SELECT *, {steps} FROM s)
, lg AS ({long})
, good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING MIN(quality) = 1)
, c AS (SELECT stratum, rule, step, COUNT(*) AS n FROM lg WHERE r IN (SELECT r FROM s JOIN good USING (doc_id)) GROUP BY ALL)
, k AS (SELECT stratum, rule, cut, SUM(n) AS n, COALESCE(SUM(n) FILTER (step > cut), 0) AS k FROM c, range({STEPS}) x(cut) GROUP BY ALL)
, b AS (SELECT stratum, rule, cut, n, k, unnest(range(0, k::BIGINT + 1)) AS i FROM k WHERE k < n)
, f AS (SELECT stratum, rule, cut, SUM(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))) AS p FROM b GROUP BY ALL)
, cuts AS (SELECT stratum, rule, MIN(cut) AS cut FROM f WHERE p <= {DELTA} / (SELECT COUNT(*) FROM (SELECT DISTINCT stratum, rule FROM c)) GROUP BY ALL)
, bad AS (SELECT DISTINCT r FROM lg JOIN cuts USING (stratum, rule) WHERE step > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)"""


ORACLES["op1_quality_rules"] = _rules_oracle()


def _crc32_sql(points: str) -> str:
    """DuckDB text for the unsigned CRC-32 of the UTF-8 form of a list of code points below 2048."""
    utf8 = f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END))"
    byte = "list_reduce(list_concat([xor(c, b)], range(8)::BIGINT[]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_concat([4294967295], {utf8}::BIGINT[]), lambda c, b: {byte}), 4294967295)"


def _points_sql(text: str) -> str:
    return f"list_transform(str_split({text}, ''), lambda c: unicode(c)::BIGINT)"


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; in one document of ten the words from some place on are first made to repeat."""
    from .periodic_runs import periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("crc32(cast(doc_id as string))").alias("h"))
    # Only texts that are changed are cut into words here.
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"
    docs = docs.withColumn("w", F.expr(f"CASE WHEN h % 10 = 0 THEN {words} END"))
    docs = docs.withColumn("a", F.expr("(h DIV 10) % size(w)")).withColumn("p", F.expr("1 + (size(w) - a) DIV (3 + (h DIV 10) % 8)"))
    repeated = "array_join(transform(w, (x, i) -> IF(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')"
    docs = docs.withColumn("text", F.expr(f"CASE WHEN size(w) > 0 THEN {repeated} ELSE text END"))
    out = periodic_runs(docs, "doc_id")
    # Runs come by start and period, so of equal ratios the first stays.
    most = F.expr("aggregate(slice(runs, 2, size(runs)), runs[0], (m, r) -> IF(r.length * m.period > m.length * r.period, r, m))")
    out = out.withColumn("m", F.when(F.size("runs") > 0, most))
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "m.start",
        "m.length",
        "m.period",
        F.expr("1000 * m.length DIV m.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLES["op12_periodic_runs"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_crc32_sql(_points_sql("doc_id::VARCHAR"))} AS h FROM documents)
, e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d)
, f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e)
, x AS (SELECT r, doc_id, n, unnest(range(n)) AS i, unnest(w) AS own, w, a, p FROM f)
, v AS MATERIALIZED (SELECT r, n, i, CASE WHEN a IS NULL OR i < a THEN own ELSE w[a + (i - a) % p + 1] END AS word FROM x)
, m AS (SELECT b.r, b.i - a.i AS q, a.i FROM v a JOIN v b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n)
, g AS (SELECT r, q, MIN(i) AS start, COUNT(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM m) GROUP BY r, q, part HAVING COUNT(*) + q >= GREATEST(6, 4 * q))
, t AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g s WHERE s.r = g.r AND s.q < g.q AND s.start <= g.start AND s.start + s.length >= g.start + g.length))
, c AS (SELECT r, COUNT(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM t GROUP BY r)
, top AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, start, q) = 1)
, gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM t)
, k AS (SELECT v.r, string_agg(word, ' ' ORDER BY v.i) AS text FROM v ANTI JOIN gone ON gone.r = v.r AND gone.i = v.i GROUP BY v.r)
SELECT doc_id, COALESCE(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.length // top.q)::BIGINT AS exponent_milli,
  sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN top USING (r) LEFT JOIN k USING (r)"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their spelling variants; one run of letters in 31 has lost a letter."""
    from .spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), every=31))


ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS run FROM documents)
, u AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, COUNT(*) AS n FROM t GROUP BY ALL)
, h AS (SELECT *, {_crc32_sql(_points_sql("doc_id::VARCHAR || ':' || run"))} AS h FROM u)
, c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
, v AS MATERIALIZED (SELECT word, SUM(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING SUM(n) >= 2)
, x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v))
, p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word)
, f AS (SELECT word, COUNT(*) AS n_near, MAX(near_n) AS form_n, MIN(near) FILTER (near_n = most) AS form FROM (SELECT *, MAX(near_n) OVER (PARTITION BY word) AS most FROM p) GROUP BY word)
, w AS MATERIALIZED (SELECT v.word, v.n, COALESCE(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word))
, s AS (SELECT word, word AS at, form AS next FROM w UNION ALL SELECT s.word, w.word, w.form FROM s JOIN w ON s.next = w.word)
SELECT w.word, form, s.at AS root, n, n_near, form_n FROM w JOIN s ON s.word = w.word AND s.next IS NULL"""


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of what the fixed patterns find in every text, and all spans."""
    from .personal_data import KINDS, find_personal_data, fit

    found = find_personal_data(table(spark, sf_dir, "documents"), fit(), "doc_id")
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
