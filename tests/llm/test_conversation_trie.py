"""The trie against one built in a dictionary, with small bands and blocks so that all rounds occur."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from askgrid.llm import conversation_trie as trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string, key string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)

    totals = {}
    for prefix in sorted(members, key=len, reverse=True):
        kids = children[prefix]
        saved = (len(members[prefix]) - 1) * len(WORD.findall(prefix[-1][1])) if prefix else 0
        totals[prefix] = (sum(totals[k][0] for k in kids) or 1, saved + sum(totals[k][1] for k in kids))
    out = []
    for prefix, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(prefix))
        out.append((convs[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(convs), len(children[prefix]),
                    *totals[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def rows():
    rng = np.random.default_rng(8)
    say = ["yes", "no", "go on", "what is  it", ""]
    out = []
    for c in range(130):
        for turn in range(int(rng.integers(1, 7))):
            out.append((c, turn, ["user", "assistant"][turn % 2], say[int(rng.integers(0, 5))]))
    out += [(c, t, "user", f"line {t} of many") for c in (200, 213, 215, 333) for t in range(90)]  # one deep trunk
    out += [(215, t, "user", "a branch") for t in range(90, 97)] + [(213, 95, "user", "another")]
    out += [(c, 0, "user", "the same") for c in range(400, 460)]  # many that end at one node
    out += [(-7, 0, "user", "below zero"), (-21, 1, "user", "below zero"), (-20, 3, "x", "minus twenty")]
    out += [(500, None, "user", "no turn"), (500, 2, None, None), (500, 2, "a", "tie"), (500, 2, "a", "tie"), (500, None, "a", "b")]
    out += [(None, 0, "user", "no conversation"), (501, 0, "", ""), (502, 5, "user", "long " * 100_000), (503, 5, "us", "er long")]
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, 1, "p", "k") for r in rows()], SCHEMA).repartition(3).cache()


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("height,block", [(2, 7), (8, 16), (trie.HEIGHT, trie.BLOCK)])
def test_trie_equals_dictionary(conversations, height, block):
    want = brute(rows())
    assert max(r[1] for r in want) > 90
    assert found(trie.conversation_trie(conversations, height, block)) == want


def test_members_of_one_node_over_many_partitions(spark, monkeypatch):
    ends = [(1, 0, c) for c in range(3, 900, 2)] + [(5, 2, 7), (1, 1, 1)]
    monkeypatch.setattr(trie, "CHUNK", 10)
    monkeypatch.setattr(trie, "PART_ROWS", 20)
    got = trie.ends_digests(spark.createDataFrame(ends, "conv_id long, depth long, member long").repartition(5)).collect()
    want = defaultdict(list)
    for c, d, m in sorted(ends):
        want[c, d].append(str(m))
    assert {(r.conv_id, r.depth): r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
    assert len(got) == len(want)


def test_turnless_none_and_wrong_type(spark, conversations):
    assert trie.conversation_trie(conversations.limit(0)).count() == 0
    c = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    lone = spark.createDataFrame([(c, 0, "user", "x")], "conv_id int, turn long, role string, text string")
    assert found(trie.conversation_trie(lone)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    with pytest.raises(TypeError):
        trie.conversation_trie(lone.withColumn("conv_id", F.col("conv_id").cast("string")))
