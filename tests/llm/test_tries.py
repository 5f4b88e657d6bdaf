"""The prefix trie against a plain trie: forks, long conversations, NULLs, repeated turns, empty tables."""

import hashlib
import random
import zlib

import pytest

from terrapanel.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, conv int, place string, id int, block int, depth int"


def plain_trie(rows):
    own = {}
    for conv, _, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    nodes, names = {}, {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 9
        path = [0]
        for said in own.get(conv - int(abs(conv) % 5 * (1 if conv > 0 else -1)), [])[:head] + turns[head:]:
            path.append(names.setdefault((path[-1], said), len(names) + 1))
            nodes.setdefault(path[-1], {"members": [], "ends": [], "kids": set(), "parent": path[-2], "depth": len(path) - 1, "bytes": len(said[1].encode())})
            nodes.get(path[-2], nodes.setdefault(0, {"members": [], "ends": [], "kids": set(), "parent": None, "depth": 0, "bytes": 0}))["kids"].add(path[-1])
        nodes.setdefault(0, {"members": [], "ends": [], "kids": set(), "parent": None, "depth": 0, "bytes": 0})
        for name in path:
            nodes[name]["members"].append(conv)
        nodes[path[-1]]["ends"].append(conv)
    for node in sorted(nodes.values(), key=lambda n: -n["depth"]):
        kids = [nodes[k] for k in node["kids"]]
        node["leaves"] = sum(k["leaves"] for k in kids) if kids else 1
        node["saved"] = (len(node["members"]) - 1) * node["bytes"] + sum(k["saved"] for k in kids)
    return sorted(
        (min(n["members"]), n["depth"], -1 if n["parent"] is None else min(nodes[n["parent"]]["members"]), len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
        for n in nodes.values()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], SCHEMA)


def found(spark, rows):
    got = tries.report(table(spark, rows))
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got.collect())


@pytest.mark.parametrize("run, chunk", [(1024, 1 << 16), (2, 8)])
def test_against_a_plain_trie(spark, monkeypatch, run, chunk):
    """Random forks, a conversation of 300 turns that others share, ids on both sides of zero."""
    monkeypatch.setattr(tries, "RUN", run)
    monkeypatch.setattr(tries, "CHUNK", chunk)
    dice = random.Random(run)
    rows = [(c, t, dice.choice(["user", "assistant"]), dice.choice("abc") * dice.randint(0, 2)) for c in range(-12, 80) for t in range(dice.randint(1, 14))]
    for c in (100, 101, 102, 204, 309):
        rows += [(c, t, "user", f"é{t if c != 309 or t < 250 else -t}") for t in range(300 - c % 7)]
    dice.shuffle(rows)
    assert found(spark, rows) == plain_trie(rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rows = [(7, t, "user", str(t % 5)) for t in range(3000)] + [(c, t, "user", "0") for c in range(20, 620) for t in range(10)]
    assert found(spark, rows) == plain_trie(rows)


def test_odd_rows(spark):
    long_text = "x" * 200_000
    rows = [(None, 1, "user", "a"), (1, None, None, None), (1, 2, "user", long_text), (2, None, "", ""), (2, 2, "user", long_text), (3, 1, "a", "b"), (3, 2, "a", "b"), (3, 3, "a", "b"), (4, 1, "ab", ""), (6, 1, "a", "b")]
    assert found(spark, rows) == plain_trie(rows)
    # Equal turn numbers: one defined order, whatever the order of the rows.
    tied = [(5, 1, "user", str(i)) for i in range(12)]
    assert found(spark, tied) == found(spark, tied[::-1])


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "a")]) == []
