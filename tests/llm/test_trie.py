"""The conversation prefix trie against a brute-force trie of Python tuples."""

import hashlib
import random
import zlib

import pytest

from cinemetric.llm.conversationtrie import MessageQueue, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, shard int, depth string, saved int"


def rebuilt(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(x)] for c, x in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    totals = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        below = [totals[x] for x in children.get(k, [])]
        totals[k] = (sum(x[0] for x in below) if below else 1, own + sum(x[1] for x in below))
    out = {}
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if convs[c] == k))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), *totals[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    got = prefix_trie(df, **options).collect()
    have = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(have) == len(got)
    assert have == brute(rows)


@pytest.fixture(scope="module")
def rows():
    """Hundreds that share heads, a conversation that holds a third of all rows,
    one first turn in very many conversations, nulls, repeated and blank rows."""
    rng = random.Random(1)
    out = [(7, t, "user", "long %d" % (t % 5)) for t in range(900)]
    for c in [*range(0, 130), *range(200, 260), -5, -100, -103, 10**15, 10**15 + 3]:
        n = rng.randint(1, 7)
        out += [(c, t, rng.choice(["user", None]), rng.choice(["hello", "same", "", None, "é😀 x"]) if t else "hot") for t in range(n) if c != 7]
    out += [(40, None, "user", "before all"), (40, 0, "user", "tie a"), (40, 0, "user", "tie a"), (None, 1, "user", "nobody"), (None, None, None, None),
            (300, 1, "user", "x" * 20000), (301, 1, "user", "x" * 20000)]
    return out


def test_whole_trie(spark, rows):
    check(spark, rows)


def test_many_shards_and_spilled_queues(spark, rows):
    check(spark, rows, shards=13, queue=3)


def test_turnless_conversations_end_at_the_root(spark):
    some = [(c, 0, "u", "only") for c in range(101, 140)]     # no conversation 100: shared heads are absent
    assert any(not x for x in rebuilt(some).values())
    check(spark, some, shards=5)


def test_chain_over_shards(spark):
    check(spark, [(3, t, "u", str(t)) for t in range(150)] + [(c, t, "u", str(t)) for c in range(100, 140) for t in range(c - 95)], shards=16, queue=2)


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "", 1)], SCHEMA)).count() == 0


def test_queue_merges_spilled_runs():
    q = MessageQueue(limit=2)
    for key in [(5, 1), (5, 2), (4, 9), (5, 1), (4, 9), (3, 1), (5, 2)]:
        q.add(key, 1, 2, 3)
    assert q.heads and [q.take(k) for k in [(5, 2), (5, 1), (4, 9), (4, 8), (3, 1)]] == [[2, 4, 6], [2, 4, 6], [2, 4, 6], [0, 0, 0], [1, 2, 3]]
