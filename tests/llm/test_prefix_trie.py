"""Prefix trie of conversations against a version that builds the trie in memory."""

import random
from collections import defaultdict
from hashlib import md5, sha256
from zlib import crc32

import pytest

from terraloom.llm.prefix_trie import Skeleton, trie

BLANKS = " \t\n\x0b\x0c\r"


def n_words(text):
    for c in BLANKS[1:]:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def expected(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            turns[conv_id].append((turn is not None, turn or 0, md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    lists = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in lists.items():
        h = crc32(str(c).encode()) % 4
        path = lists.get(int(c / 20) * 20, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (n_words(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                    sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=str)


def found(spark, rows, shards=None):
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, path binary, shard int")
    return sorted((tuple(r) for r in trie(df, shards).collect()), key=str)


@pytest.fixture(scope="module")
def mixed_rows():
    draw = random.Random(9)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a b", "a", "", "c\td e", "f  g"])) for c in range(400) for t in range(draw.randrange(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(4)]  # a hot path
    rows += [(20_003, 0, "user", "only"), (20_003, 0, "user", "tie"), (20_004, None, None, None), (20_004, 3, "x", "y"), (-7, 1, "user", "below zero"),
             (None, 0, "user", "nobody"), (5, 0, "user", "again"), (5, 0, "user", "again"), (30_001, 0, "user", "long " * 30_000)]
    return rows


@pytest.mark.parametrize("shards", [None, 1, 5, 40])
def test_any_number_of_shards_agrees_with_brute_force(spark, mixed_rows, shards):
    assert found(spark, mixed_rows, shards) == expected(mixed_rows)


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(i for i in range(21, 40) if crc32(str(i).encode()) % 4 == 2)
    rows = [(c, 0, "user", "cut"), (c + 100, 0, "user", "x"), (c + 100, 1, "user", "y")]
    assert found(spark, rows) == expected(rows)


def test_ends_of_a_hot_node_are_hashed_in_order_over_shards(spark):
    rows = [(c, 0, "user", "hello there") for c in range(0, 9000 * 20, 20)] + [(c, 0, "user", "other") for c in range(1, 400)]
    assert found(spark, rows, 6) == expected(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(0, t, "user", "w") for t in range(3000)] + [(c, t, "user", "w") for c in (20, 40) for t in range(2990)]
    assert found(spark, rows, 3) == expected(rows)
    assert found(spark, []) == []


def test_skeleton_numbers_subtrees_in_preorder():
    from terraloom.llm.prefix_trie import STEP, pack

    path = lambda *keys: b"".join(pack(STEP, k.encode().ljust(16), 1) for k in keys)
    s = Skeleton([(path("a"), 1), (path("a", "b"), 2), (path("a", "c", "d"), 3), (path("e"), 4)])
    places = {k.rstrip(b" \0").decode(): v[:2] for k, v in s.nodes.items()}
    assert places == {"": (0, 5), "a": (1, 4), "b": (2, 2), "c": (3, 4), "d": (4, 4), "e": (5, 5)}
