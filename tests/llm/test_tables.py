import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terraloom.llm import fingerprints, licenses, mixing, warc
from terraloom.llm.tables import running_totals
from terraloom.sources.files import scratch


def test_running_totals_over_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id", (F.col("id") % 5).alias("v"))
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want[r.id] = want.get(("sum", r.k), 0)
        want["sum", r.k] = want[r.id] + r.v
    assert {r.id: r.t for r in running_totals(df, ["k"], ["id"], "v", "t").collect()} == {k: v for k, v in want.items() if not isinstance(k, tuple)}


def fill(budget, nodes):
    """Budgets of (name, weight, capacity) by raising all shares together until full ones drop out."""
    out, left, rest = {}, list(nodes), budget
    while True:
        total = sum(w for _, w, _ in left)
        full = [x for x in left if x[2] * total <= x[1] * rest]
        if not full:
            return {**out, **{n: rest * w / total for n, w, _ in left}}
        first = min(full, key=lambda x: (x[2] / x[1], x[0]))
        out[first[0]] = first[2]
        rest -= first[2]
        left.remove(first)
        if not left:
            return out


def test_shares_fill_siblings_first(spark):
    draw = random.Random(6)
    for _ in range(5):
        nodes = [(f"n{i}", draw.randrange(1, 9), draw.randrange(0, 400)) for i in range(7)]
        budget = draw.randrange(0, 1500)
        df = spark.createDataFrame(nodes, "name string, weight bigint, capacity bigint").withColumns({"p": F.lit(1), "budget": F.lit(budget).cast("bigint")})
        got = {r["name"]: r.granted for r in mixing.share_out(df, ["p"], "name").collect()}
        want = fill(budget, nodes)
        assert all(abs(got[k] - want[k]) < 1 for k in want) and sum(got.values()) == min(budget, sum(c for *_, c in nodes))


def test_mixture_edges(spark, odd_docs):
    rows = mixing.mixture(odd_docs).collect()
    total = sum(r.taken for r in rows)
    assert total == sum(len((r.text or "").split()) for r in odd_docs.collect())
    assert all(0 <= r.taken <= r.n_tokens for r in rows)
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() >= 1
    assert mixing.mixture(odd_docs.where("false")).count() == 0


def test_mixture_takes_the_seeded_prefix(spark):
    docs = [(i, "w " * (1 + i % 4), "en", f"src{i % 4}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    for r in mixing.mixture(df, budget=150).groupBy("domain", "lang", "source").agg(F.sum("taken").alias("t")).collect():
        assert r.t > 0
    assert mixing.mixture(df, budget=150).agg(F.sum("taken")).first()[0] == 150


def digests_of(text):
    lines = [x.split() for x in (text or "").replace("\x0b", " ").split("\n")]
    return {tuple(w[i:i + fingerprints.PIECE]) for w in lines for i in range(0, len(w), fingerprints.PIECE)}


def test_fingerprints_match_brute_force(spark):
    draw = random.Random(9)
    rows = [(i * 3, " ".join(f"w{draw.randrange(30)}" + ("\n" if draw.random() < .1 else "") for _ in range(draw.choice([0, 1, 5, 40, 300, 3000])))) for i in range(60)]
    rows += [(500, None), (501, "é😀x"), (502, rows[3][1])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    ids, texts = sorted((i for i, _ in rows), reverse=True), {i: t or "" for i, t in rows}
    for i, follow in zip(ids, ids[1:] + ids[:1]):
        text, n = texts[i], len(texts[i])
        edited = text[:n - n // 3] + texts[follow][:n // 3]
        like = lambda a, b: 1 - len(digests_of(a) ^ digests_of(b)) / max(1, len(digests_of(a)) + len(digests_of(b)))
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == pytest.approx(like(text, edited)) and got[i].near_next == pytest.approx(like(text, texts[follow]))
    assert got[502].fingerprint == got[rows[3][0]].fingerprint


def test_fingerprint_edges(spark, odd_docs):
    rows = fingerprints.fingerprints(odd_docs).collect()
    assert len(rows) == 10 and all(r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = fingerprints.fingerprints(odd_docs.where("doc_id = 7")).collect()[0]
    assert one.near_next == 1.0
    assert fingerprints.fingerprints(odd_docs.where("false")).count() == 0


def test_archives_round_trip(spark):
    big, body = "z" * 200, "é" * 60
    rows = [(5, "u5", big), (3, "u\r\n3", big), (9, None, big), (4, "u4", "short"), (6, "u6", "short"), (7, "u7", None), (None, "n", big), (8, "u8", body), (8, "u8", body), (2, "u2", body),
            (11, "u11", "\x00\r\n\r\n" * 30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    folder = scratch(spark, "warc-test")
    warc.write_archives(df, folder)
    got = warc.read_archives(spark, folder, payloads=True).collect()
    want = {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 4: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None), 8: ("revisit", 2),
            2: ("response", None), 11: ("response", None)}
    assert len(got) == len(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r.record_type, r.refers_to) == want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(texts[r.page_id]), hashlib.sha256(texts[r.page_id]).hexdigest())
        assert r.html is None if r.record_type == "revisit" else r.html.encode() == texts[r.page_id]
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_large_records_and_damage():
    large = warc.record("1", "u", bytes(17 << 20), None)
    assert large[-1] != 0
    data = large + b"\x00" + warc.record("2", "v", b"abc", None)
    assert [warc.parsed(*x)[0] for x in warc.records(data)] == ["1", "2"]
    with pytest.raises(warc.ArchiveError):
        list(warc.records(data[:-5]))
    broken = bytearray(warc.record("2", "v", b"abc" * 100, None))
    broken[30] ^= 1
    with pytest.raises(warc.ArchiveError):
        list(warc.records(bytes(broken)))


def test_licences_by_canonical_text(spark, odd_docs):
    mit = "Copyright (c) 2020 Some One\n\n" + licenses.MIT.upper().replace(",", " ,")
    rows = [(1, mit), (2, licenses.MIT + " extra"), (3, "Some text.\nreleased under the MIT Licence\nend"), (4, None)]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, ""), 3: (None, "MIT"), 4: (None, "")}
    assert licenses.scan(odd_docs).count() == 10 and licenses.scan(odd_docs.where("false")).count() == 0


def test_of_equal_rows_exactly_the_taken_number_comes_out(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "en", "s2", 5)] * 100 + [(2, "a b", "en", "s2", 5), (None, "c d e", "en", "s2", 5), (None, "c d e", "en", "s2", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    for budget in (10, 995, 1008, 1700):
        taken = {}
        for r in mixing.mixture(df, budget=budget).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
        got = {}
        for r in mixing.mixed_documents(df, budget=budget).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert got == taken


def test_whole_licences_and_notices_of_several_lines(spark):
    wrapped = "code\n\n# Copyright 2021 Someone\n" + licenses.APACHE_NOTICE.replace("\n", "\n\n").upper() + "\nmore code"
    rows = [(1, "Copyright (c) 2001, Some One\n" + licenses.BSD3), (2, licenses.ZLIB.lower()), (3, wrapped), (4, licenses.UNLICENSE), (5, licenses.ZERO_BSD),
            (6, licenses.APACHE_NOTICE.split("\n")[0]), (7, "x\n" + licenses.BSD2 + "\ny"), (8, "A licence of our own.\nSecond line."), (9, None), (10, "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, license string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "BSD-3-Clause", 2: "Zlib", 3: None, 4: "Unlicense", 5: "0BSD", 6: None, 7: None, 8: None, 9: None, 10: None}
    assert {k: v[1] for k, v in got.items() if k in (3, 6, 7, 8)} == {3: "Apache-2.0", 6: "", 7: "BSD-2-Clause", 8: ""}
    own = spark.createDataFrame([("Own-1.0", "a LICENSE of our own; second line"), (None, "x"), ("Y", None)], "license string, text string")
    assert {r.doc_id: r.license for r in licenses.scan(df, own).collect() if r.license} == {8: "Own-1.0"}
