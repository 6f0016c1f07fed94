"""Benchmark passages and repeated lines against plain versions."""

import random
import re
from hashlib import md5

import pyarrow as pa
from pyspark.sql import functions as F

from refmask.llm import decontamination as D
from refmask.llm import line_dedup
from refmask.llm.decontamination import contaminated, decontaminate
from refmask.llm.line_dedup import dedup_lines


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def weights(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    return {g: min(65535, len(b"".join(g).decode())) for g in grams}


def brute(rows, items, least=0.8):
    """(doc, item) to the best similarity of a window of the item's size, where that is ``least`` or more."""
    found = {}
    for d, text in rows:
        words = low(text)
        for i, item in items:
            want = weights(low(item))
            n = len(low(item))
            for s in range(max(1, len(words) - n + 1)) if n else []:
                have = weights(words[s : s + n])
                both = sum(have[g] for g in have if g in want)
                if both and both >= least * (sum(have.values()) + sum(want.values()) - both):
                    found[d, i] = max(found.get((d, i), 0), both / (sum(have.values()) + sum(want.values()) - both))
    return found


def test_close_fingerprints_meet_in_a_block():
    random.seed(1)
    for _ in range(3000):
        bits = random.sample(range(64), D.RADIUS)
        shift = 0
        apart = []
        for width in D.WIDTHS:
            apart.append(sum(shift <= b < shift + width for b in bits))
            shift += width
        assert shift == 64 and min(apart) <= D.FLIPS
    assert len(D._masks(13)) == 1 + 13 + 78 and all(bin(m).count("1") <= D.FLIPS for m in D._masks(12))


def test_blocks_cover_negative_fingerprints(spark):
    blocks = ", ".join(D._blocks("f"))
    for f in (-1, 1 << 62, -(1 << 63), 123456789):
        parts = spark.sql(f"SELECT array({blocks}) AS b FROM (SELECT {f}L AS f)").first().b
        shift, back = 0, 0
        for part, width in zip(parts, D.WIDTHS, strict=True):
            back |= part << shift
            shift += width
        assert back == f % (1 << 64)


def test_fingerprint_is_the_weighted_majority(spark):
    rows = spark.sql(f"SELECT c, {D.fingerprint('c')} AS f, transform(c, x -> xxhash64(x)) AS h FROM VALUES (array(5L)), (array(65537L, 131074L, 262148L)), (array()) AS t(c)").collect()
    for r in rows:
        want = 0
        for b in range(64):
            if sum((c & 65535) * (1 if (h >> b) & 1 else -1) for c, h in zip(r.c, r.h, strict=True)) > 0:
                want |= 1 << b
        assert r.f % (1 << 64) == want


def test_passages_are_found_and_clean_documents_left(spark, documents):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(900)]
    words = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(random.choice([3, 5, 20, 35, 60])))) for i in range(25)]
    rows = []
    for d in range(160):
        text = words(random.randrange(80))
        if d % 3 == 0:
            passage = random.choice(items)[1].upper().split()
            for _ in range(random.choice([0, 0, 1])):
                passage[random.choice([0, -1, random.randrange(len(passage))])] = "changed"
            at = random.randrange(len(text) + 1)
            text[at:at] = passage
        rows.append((d, random.choice([" ", "\n", "  "]).join(text)))
    rows += [(500, None), (501, ""), (502, items[4][1]), (502, items[4][1]), (None, items[5][1] + " x")]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "an item without an id that is long enough")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(documents(*rows), bench).collect()}
    want = brute(rows, items)
    # Clear cases are all found; at the threshold the fingerprints may be too far apart.
    assert {k for k, s in want.items() if s >= 0.9} <= set(got) <= set(want)
    assert len(got) >= 0.9 * len(want) > 30
    # Windows are those that line up with a shared shingle; one a word aside may be slightly better.
    assert all(want[k] - 0.05 < got[k] <= want[k] + 1e-9 for k in got)
    docs = documents(*rows).withColumn("weight", F.lit(1))
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in rows if not any(k[0] == d for k in got))
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_nearly_all_pairs_at_the_threshold_are_found(spark, documents):
    random.seed(8)
    items, rows = [], []
    for i in range(1000):
        item = [f"w{random.randrange(5000)}" for _ in range(random.randrange(34, 60))]
        items.append((i, " ".join(item)))
        passage = [*item]
        # A run of changed words at one end: as many as leave a similarity of 0.8 to 0.84.
        for k in range(1, len(item)):
            passage[-k] = f"changed{k}"
            have, want = weights(low(" ".join(passage))), weights(low(" ".join(item)))
            both = sum(have[g] for g in have if g in want)
            if both < 0.84 * (sum(have.values()) + sum(want.values()) - both):
                break
        rows.append((i, " ".join(passage)))
    want = {(d, i) for d, i in ((k, k) for k in range(len(items))) if brute([rows[d]], [items[i]])}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(documents(*rows), bench).collect()}
    print(f"{len(want)} pairs at 0.8 to 0.84, {len(want - got)} lost")
    assert len(want) > 300 and got <= want and len(want - got) <= len(want) // 200


def test_items_are_joined_the_same_without_a_broadcast(documents, spark, monkeypatch):
    rows = [(i, f"start {i} one two three four five six seven eight end") for i in range(20)]
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    first = sorted(map(tuple, contaminated(documents(*rows), bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert first == sorted(map(tuple, contaminated(documents(*rows), bench).collect())) and len(first) == 20


def brute_spans(rows, min_words):
    """Per row the (start, length) to remove: every stretch is looked for among those that rank before it."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {i: [] for i in order}
    for i in order:
        text = rows[i][1] or ""
        found = list(re.finditer(r"[^ \t-\r]+", text))
        words = [normal(m.group()) for m in found]
        places = [m.start() for m in found] + [len(text)]
        bits = [md5(w.encode()).digest()[0] >> 6 for w in words]
        by_line = [k for k in range(len(words)) if not k or "\n" in text[found[k - 1].end() : found[k].start()]]
        by_words = [k for k in range(len(words)) if not k or bits[k - 1] == bits[k]]
        gone = set()
        units = {(a, next(b for b in [*cut, len(words)] if b >= a + min_words)) for cut in (by_line, by_words) for a in cut if len(words) >= a + min_words}
        for a, b in sorted(units):
            unit = tuple(words[a:b])
            if unit in seen:
                gone |= set(range(a, b))
            seen.add(unit)
        for k in sorted(gone):
            if out[i] and out[i][-1][0] + out[i][-1][1] == places[k]:
                out[i][-1] = (out[i][-1][0], places[k + 1] - out[i][-1][0])
            else:
                out[i].append((places[k], places[k + 1] - places[k]))
    return out


def without(text, spans):
    for a, n in reversed(spans):
        text = text[:a] + text[a + n :]
    return text


def normal(word):
    return b" ".join(low(word)).decode()


def test_spans_equal_a_plain_version(documents):
    random.seed(13)
    pool = ["a b", "A  b", "c", "d e f", "", " ", "g h i j k l m", "n \xa0o p q", "𝒳 y", "a b c d e f g h"]
    rows = [(i, "\n".join(random.choice(pool) + random.choice(["", " \t", f" {i}"]) for _ in range(random.randrange(12)))) for i in range(150)]
    rows += [(300, None), (301, ""), (302, "x " * 30_000), (303, "\n".join(["the same short line"] * 58)), (None, "a b\nc\nd e f")]
    want = brute_spans(rows, 6)
    docs = documents(*rows).withColumn("key", F.lit("k")).withColumn("start", F.lit(1)).withColumn("spans", F.lit(2))
    out = dedup_lines(docs.repartition(5), 6)
    assert out.columns == [*docs.columns, "removed"]
    got = {r.doc_id: r for r in out.collect()}
    for i, (d, text) in enumerate(rows):
        assert [tuple(x) for x in got[d].removed or []] == want[i]
        assert got[d].text == (None if text is None else without(text, want[i])) and (got[d].removed is None) == (not want[i])
        assert (got[d].key, got[d].start, got[d].spans) == ("k", 1, 2)
    assert sum(map(bool, want.values())) > 50 and len(got[302].text) < 20 and len(got[303].text) < 60
    # Of every word one occurrence stays.
    kept = {w for r in got.values() for w in low(r.text)}
    assert kept == {w for _, text in rows for w in low(text)}


def test_passages_go_however_they_are_wrapped(documents):
    random.seed(14)
    words = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    caught, rows = 0, []
    for i in range(60):
        passage = words(random.randrange(52, 90))
        wrapped = "".join(w + random.choice([" ", " ", "  ", "\n", " \n"]) for w in passage)
        rows += [(2 * i, " ".join([*words(30), *passage, *words(30)])), (2 * i + 1, " ".join(words(30)) + " " + wrapped.upper() + " ".join(words(30)))]
    got = {r.doc_id: r for r in dedup_lines(documents(*rows)).collect()}
    for i in range(60):
        assert got[2 * i].removed is None
        left = len(got[2 * i + 1].text.split()) - 60
        caught += left * 2 <= len(rows[2 * i + 1][1].split()) - 60
    assert caught >= 58


def test_repeated_rows_and_empty_tables(documents):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents((1, text), (1, text), (2, text), (2, text + " more"), (None, None), (None, None))
    got = sorted((str(r.doc_id), r.text) for r in dedup_lines(docs.withColumn("removed", F.lit("x"))).collect())
    # Rows equal in id and text are one document: its words stay in each of them, or go from each.
    assert [r for r in got if r[0] != "2"] == [("1", text), ("1", text), ("None", None), ("None", None)]
    assert got[2][1] == "" and len(got[3][1].split()) <= 15
    assert dedup_lines(docs.limit(0)).count() == 0


def test_batches_without_a_stretch():
    """A task whose texts have no words, or that has no rows, gives no units."""
    for texts in ([], ["", " \n "], [None]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "key", "text"])
        assert sum(units.num_rows for units in line_dedup._units(30)([batch])) == 0


def test_places_are_joined_the_same_without_a_broadcast(documents, monkeypatch):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(*((i, f"{i} " * i + text) for i in range(20)), (None, text))
    first = sorted(map(str, dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_SPANS", 0)
    assert first == sorted(map(str, dedup_lines(docs).collect()))


def test_long_texts_and_clashing_names(spark, documents):
    item = " ".join(f"i{k}" for k in range(40))
    long = " ".join(f"w{k}" for k in range(60_000))
    giant = "g" * 3000 + " " + " ".join(["h" * 2000] * 3) + " a b c d e f"
    docs = documents((1, long + " " + item), (2, long), (3, None), (4, ""), (4, ""), (5, giant), (6, giant.replace(" a b", " a x")), (None, item))
    docs = docs.withColumn("key", F.lit(1)).withColumn("w", F.lit(2)).withColumn("places", F.lit(3)).withColumn("start", F.lit(4))
    bench = spark.createDataFrame([(1, item), (2, giant)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    # A change of two short words in a shingle of thousands of characters weighs little.
    assert {(1, 1), (5, 2), (None, 1)} <= got <= {(1, 1), (5, 2), (6, 2), (None, 1)}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and {2, 3, 4} <= {r.doc_id for r in left.collect()} <= {2, 3, 4, 6} and left.where("doc_id = 4").count() == 2


def test_texts_without_a_place_are_not_moved(spark, documents, tmp_path):
    documents(*((i, f"text {i} has words of its own here") for i in range(50))).write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    left = decontaminate(spark.read.parquet(f"{tmp_path}/d"), bench)
    assert left.count() == 50
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
