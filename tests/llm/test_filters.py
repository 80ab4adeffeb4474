import re
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraloom.llm import decision_list, language_id, toxicity


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, odd_docs):
    draw = random.Random(2)
    rows = [(i, "".join(draw.choice(["a", "b", "c ", " ", "\n", "\t", "#", "é", "d e ", "\x1f", "a b c "]) for _ in range(draw.randrange(120)))) for i in range(400)]
    rows += [(1000, "a b c d " * 200), (1001, "one two three " * 2), (1002, None), (1003, "x\ny\nx\n\n\nx")]
    got = decision_list.counted(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "_counts.*").collect()
    texts = dict(rows)
    for r in got:
        assert tuple(r)[1:] == counts(texts[r.doc_id]), texts[r.doc_id]


def labelled(spark):
    draw = random.Random(8)
    docs, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 90))]
        docs.append((i, " ".join(w + "***" if bad else w for w in words), "en", "s"))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learned_list_rejects_the_bad_and_keeps_the_clean(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.kept for r in decision_list.quality(docs, labels).collect()}
    assert got == {i: i % 5 != 0 for i in range(1500)}
    assert {r.doc_id for r in decision_list.accepted(docs, labels).collect()} == {i for i in range(1500) if i % 5}


def test_a_defect_of_one_percent_is_learned_after_a_rule_that_fails(spark):
    draw = random.Random(12)
    rows = []
    for i in range(6000):
        bad = i % 100 == 0
        noise = draw.random() < 0.02  # bad without a mark in the counts
        n = draw.randrange(60, 400)
        rows.append((i, int(bad or noise), n, n * (40 if bad else draw.randrange(3, 9)), draw.randrange(5), draw.randrange(3), draw.randrange(20)))
    df = spark.createDataFrame(rows, "doc_id bigint, bad int, " + ", ".join(f"{c} bigint" for c in decision_list.COUNTS))
    rules = decision_list.learn(df)
    caught = {r.doc_id for r in df.where(~decision_list.verdict(rules)).collect()}
    assert {i for i in range(0, 6000, 100)} <= caught and len(caught) < 75


def test_verdicts_follow_the_rules_in_order(spark):
    docs, labels = labelled(spark)
    rules = decision_list.learn(decision_list.labelled_counts(decision_list.quality(docs, labels), labels))
    value = lambda c, r: {"n_words": r.n_words, "chars_per_word": r.word_chars / max(r.n_words, 1), "symbols_per_char": r.n_symbols / max(r.word_chars, 1),
                          "dup_lines": r.n_dup_lines, "repeat_share": r.n_repeat_words / max(r.n_words, 1)}[c.feature]
    rows = decision_list.quality(docs, labels).collect()
    assert rules and {r.kept for r in rows} == {True, False}
    for r in rows:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        met = any(all((value(c, r) > c.threshold) == c.above for c in rule) for rule in rules)
        assert (r.base_failed, r.kept) == (base, not base and not met)


def test_quality_edges(spark, odd_docs, odd_labels):
    rows = decision_list.quality(odd_docs, odd_labels).collect()
    assert len(rows) == odd_docs.count() and all(r.kept is not None and r.base_failed is not None for r in rows)
    kept = decision_list.accepted(odd_docs, odd_labels)
    assert kept.columns == odd_docs.columns
    assert decision_list.quality(odd_docs.where("false"), odd_labels.where("false")).count() == 0
    assert decision_list.learn(decision_list.labelled_counts(decision_list.quality(odd_docs, odd_labels), odd_labels.where("false"))) == []


def test_toxicity_learns_words_stems_and_foldings(spark):
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        words = [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('lmnr')}{draw.choice('aeiou')}" for _ in range(60)]
        if i % 3 == 0:
            words[draw.randrange(60)] = draw.choice(["skunkel", "Skуnkel", "5kunkel", "grolma", "grolmet", "grolmit", "grolmus"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(5000, "a grolmest thing " + "clean words " * 50), (5001, None), (5002, ""), (None, "grolma")]
    df, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, marks).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(900))
    assert got[5000].predicted == 1 and got[5001].predicted == 0 and got[5002].score == got[5001].score and got[None].held_out is False
    assert toxicity.clean(df, marks).count() == 602


def test_toxicity_scores_do_not_depend_on_the_sample_cap(spark):
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(4000):
        toxic = i % 10 == 0
        words = [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('lmnr')}{draw.choice('aeiou')}" for _ in range(60)]
        if draw.random() < (0.8 if toxic else 0.02):
            words[draw.randrange(60)] = "skunkel"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    df, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    line = {}
    for cap in (200, 8000):  # about 270 toxic and 2400 clean rows are not held out
        fitted = toxicity.fit(df, marks, sample=cap)
        assert set(fitted.weights) == {" skunkel "}
        line[cap] = [fitted.intercept, fitted.intercept + fitted.slope * fitted.weights[" skunkel "]]
    assert all(abs(a - b) < 0.9 for a, b in zip(line[200], line[8000])), line  # log odds; the two draw rates differ by a factor of about 9


def test_exception_phrases_and_folding():
    found = toxicity.automaton(toxicity.Lexicon({" trash ": 5.0}))
    assert toxicity.density("put it in the Trash can", found) == 0 and toxicity.density("you tr4$h!", found) > 0 and toxicity.density(None, found) == 0


def test_toxicity_and_language_edges(spark, odd_docs, odd_labels):
    for rows in (toxicity.toxicity(odd_docs, odd_labels).collect(), toxicity.toxicity(odd_docs, odd_labels.where("false")).collect()):
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.clean(odd_docs, odd_labels).columns == odd_docs.columns
    rows = language_id.identify(odd_docs).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert {r.lang_pred for r in language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd_docs.where("false")).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_language_accuracy_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()


def test_sixty_languages_and_a_hot_doc_id_stay_within_the_sample(spark):
    draw = random.Random(7)
    known = sorted(language_id.FAMILIES)[:50] + [f"q{c}" for c in "abcdefghij"]
    letters = {lang: [chr(97 + (i * 7 + k * k) % 26) + chr(0x430 + (i + 3 * k) % 32) for k in range(5)] for i, lang in enumerate(known)}
    rows = [(i, " ".join("".join(draw.choice(letters[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate(known * 12)]
    hot = rows[1]
    df = spark.createDataFrame(rows + [hot] * 500, "doc_id bigint, text string, lang string")
    model = language_id.fit(df, total=240)
    assert sum(map(len, model.members.values())) == 60 and len(model.pairs) == sum(len(m) * (len(m) - 1) // 2 for m in model.members.values())
    got = language_id.identify(df).collect()
    assert len(got) == len(rows) + 500
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.9
