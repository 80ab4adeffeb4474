"""Benchmark decontamination against a word-by-word version."""

import hashlib
import random
import re

from terraloom.llm import decontamination
from terraloom.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, bench, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item_id, passage in bench:
            v = words(passage)
            n = min(size, len(v))
            if not n or item_id is None:
                continue
            windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    items.add(str(item_id))
        named = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(items), named, bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, bench, **settings):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, window string, place int")
    b = spark.createDataFrame([(*r, "y") for r in bench], "item_id bigint, text string, shingle string")
    return sorted((tuple(r) for r in contamination(d, b, **settings).collect()), key=str)


def test_random_texts_agree_with_brute_force(spark):
    draw = random.Random(5)
    bench = [(i, " ".join(draw.choice("abcd") for _ in range(draw.choice([1, 2, 3, 4, 9, 10, 11, 14])))) for i in range(25)]
    bench += [(99, bench[0][1]), (100, None), (101, "?!"), (None, "a b"), (102, "Ünder Ärger"), (103, "one")]
    docs = [(i, " ".join(draw.choice("abcd") for _ in range(draw.choice([0, 1, 2, 5, 12, 40, 200])))) for i in range(60)]
    docs += [(1, "again other text a"), (None, "A, b! C-d"), (7, None), (8, ""), (9, "ünder Ärger ÄRGER one"), (9, "ünder Ärger ÄRGER one")]
    assert found(spark, docs, bench) == expected(docs, bench)


def test_long_items_only_hit_by_whole_windows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"x {passage} y"), (2, " ".join(f"w{i}" for i in range(9))), (3, " ".join(f"w{i}" for i in range(12, 22))),
            (4, " ".join(f"w{i}" for i in reversed(range(30)))), (5, "q " * 30_000 + passage)]
    bench = [(10, passage), (9, " ".join(f"w{i}" for i in range(5, 20)))]
    assert found(spark, docs, bench) == expected(docs, bench)
    assert [r[2] for r in found(spark, docs, bench)] == [30, 0, 10, 0, 30]


def test_many_windows_with_one_rarest_shingle_are_all_tried(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LISTED", 2)
    draw = random.Random(3)
    bench = [(i, " ".join([*(draw.choice("abc") for _ in range(4)), "rare", "r2", *(draw.choice("abc") for _ in range(4))])) for i in range(40)]
    docs = [(i, f"{bench[i][1]} {bench[-i - 1][1]}") for i in range(20)] + [(50, "a b c " * 200)]
    assert found(spark, docs, bench) == expected(docs, bench)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b"), (2, None)], []) == expected([(1, "a b"), (2, None)], [])
    assert found(spark, [(1, "a b")], [(1, None)]) == expected([(1, "a b")], [])
