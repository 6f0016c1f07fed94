import random
from collections import Counter

from refmask.llm.quality_rules import STEPS, at_most, choose_cutoffs, quality_rules, text_stats


def brute(text):
    text = text or ""
    spaces = " \t\n\r\v\f"
    for s in spaces[1:]:
        plain = text.replace(s, " ") if s == "\t" else plain.replace(s, " ")
    words = [w for w in plain.split(" ") if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(spaces):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_a_plain_version(documents):
    random.seed(3)
    bits = ["a", "b", "#x", "é|", " z", " ", "  ", "\n", "\n\n", "\t", "a b c ", "\r", "ÀB"]
    texts = [None, "", "   ", "\n \n", "word", "a a a a", "x\nx\n\nx ", "a b c\na b c", " ", "𝒳 y"]
    texts += ["".join(random.choice(bits) for _ in range(random.randrange(60))) for _ in range(300)]
    texts += ["long " * 30_000]
    got = {r.doc_id: tuple(r)[1:6] for r in text_stats(documents(*enumerate(texts))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact():
    assert abs(at_most(1, 4, 0.5) - 5 / 16) < 1e-12
    assert at_most(3, 3, 0.01) == 1.0
    assert at_most(0, 0, 0.5) == 1.0


def test_cutoffs_keep_the_risk_and_stop_at_the_first_failure():
    clean = [1000] + [0] * STEPS
    assert choose_cutoffs({("en", "r"): clean}) == {("en", "r"): 0}
    spread = [0] * (STEPS + 1)
    spread[2], spread[50] = 900, 100
    cutoff = choose_cutoffs({("en", "r"): spread})[("en", "r")]
    assert cutoff == 50  # one step less would reject a tenth of the good documents
    assert choose_cutoffs({("en", "r"): [20] + [0] * STEPS}) == {}  # too few labels to be sure
    # More tests need more evidence.
    few = [70] + [0] * STEPS
    assert choose_cutoffs({("en", "r"): few}) and not choose_cutoffs({(str(i), "r"): few for i in range(9)})


def test_verdicts_by_stratum(documents, labels, spark):
    good = "plain words go on and on here " * 1
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{good}{body} x{i}", "en") for i in range(700)]
    rows += [(1000, f"{body} ### ### ### ### ### ### ### ### ### ### ### ### ### ###", "en"), (1001, "short", "en"), (1002, None, "en"), (1003, f"{body} ####", None)]
    rows += [(1004, body, "en"), (1004, body, "en")]
    docs = documents(*rows).withColumnRenamed("n_chars", "n_words")
    out = quality_rules(docs, labels(*((i, 1, 0) for i in range(700)), (None, 1, 0), (5, None, 0)))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i].kept for i in range(700)) and got[1003].kept and got[1004].kept
    assert not got[1000].kept and not got[1000].base_failed and got[1000].failed_rules == ["symbols", "repeated_phrases"]
    assert got[1001].base_failed and got[1002].base_failed and not got[1002].kept
    assert quality_rules(docs, labels()).where("kept").count() == 704
    assert quality_rules(docs.limit(0), labels()).count() == 0
