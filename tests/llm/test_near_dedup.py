import random
import re

import pytest
from pyspark.sql import functions as F

from terraloom.llm import near_dedup
from terraloom.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i: (len(s), label[i], label[i] == i) for i, s in sets}


def answer(df, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, **settings).collect()}


def edited(words, n, draw):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"x{draw.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("rounds, crowd", [(0, 64), (0, 4), (1, 4)])
def test_groups_of_edited_copies_match_brute_force(spark, monkeypatch, rounds, crowd):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "RARE", 3)
    draw, rows = random.Random(4), []
    for group in range(6):
        words = [f"w{draw.randrange(400)}" for _ in range(120)]
        rows += [(len(rows) + k, edited(words, draw.randrange(0, 7), draw)) for k in range(40)]
    draw.shuffle(rows)
    assert answer(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=rounds) == brute(rows)


def test_edges_of_the_definition(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three four five"), (7, "One two three four five"), (8, "É a b c d"),
            (9, "é a b c d"), (10, "w " * 30_000), (11, "w w w w w"), (12, "two one")]
    assert answer(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", "p"), (5, "a b c d e f", "p"), (3, "a b c d e f", "q"), (None, "a b c d e f", "r"), (None, "a b c d e f", "r"), (9, None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node string").withColumns({"_id": F.lit(1), "label": F.lit("x")})
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (None, None, True), (9, 9, True)], key=str)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, None, None, 9], key=str)
    assert near_dedup.keep_one(df.where("doc_id > 99")).count() == 0


def test_each_text_of_a_repeated_doc_id_is_judged_by_itself(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "k l m n o x y z"
    rows = [(1, a), (1, b), (1, b), (2, c), (3, b), (0, a), (4, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()))
    assert got == sorted([(1, 0, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (0, 0, True), (4, 4, True), (4, 4, True), (4, 4, True)])
    assert sorted((r.doc_id, r.text or "") for r in near_dedup.keep_one(df).collect()) == [(0, a), (1, b), (2, c), (4, ""), (4, "")]


def test_posterior_bound_keeps_similar_pairs():
    assert near_dedup.fewest_matches(128, 75, 1e-7) < 96 and near_dedup.fewest_matches(128, 75, 1e-7) > 60
    assert near_dedup.fewest_matches(16, 75, 1e-7) >= 1


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path + hub, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
