"""The prefix trie against a dictionary of prefixes, and the slot tables of its shards."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import prefix_trie
from loglattice.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, digest string"


def by_hand(rows, rebuild=True):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role.encode(), mark, (role, text)))
    own = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(np.fmod(c, 5))
        whole[c] = own.get(base, [])[:h] + own[c][h:] if rebuild else own[c]
    members = {}
    for c, ts in sorted(whole.items()):
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in ids if len(whole[c]) == len(node))
        out.append((
            ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(children.get(node, [])),
            sum(n not in children for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(60), 101, 103, 250, -3, -7]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t if t else None, ["user", "bot", None][int(rng.integers(0, 3))], ["hi", "naïve 中", "", None, "ok"][int(rng.integers(0, 5))], "x", "y"))
    rows += [(7, 2, "user", "tie", "x", "y"), (7, 2, "user", "a tie", "x", "y"), (7, 2, "user", "tie", "x", "y")]
    rows += [(None, 1, "user", "lost", "x", "y"), (8, 9, "user", "long " * 20000, "x", "y")]
    rows += [(300 + i, 0, "user", "the same", "x", "y") for i in range(40)]
    rows += [(400, i, "user", f"turn {i}", "x", "y") for i in range(300)]  # a third of all rows
    rows += [(410, i, "user", f"turn {i}", "x", "y") for i in range(150)]  # and one that shares its start
    return rows


def trie(frame, **options):
    turns = prefix_trie.turns_of(frame)
    base, taken = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9
    return prefix_trie.prefix_nodes(*prefix_trie.borrowed_starts(turns, base, taken, most=8), **options)


@pytest.mark.parametrize("shard", [50, 400_000])
def test_nodes_of_odd_conversations(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)
    assert rows(trie(frame, shard=shard)) == by_hand(odd_rows())


def test_a_plain_trie_and_no_rows(spark, rows):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    turns = prefix_trie.turns_of(frame)
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    assert rows(prefix_trie.prefix_nodes(turns, convs)) == by_hand(odd_rows(), rebuild=False)
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows(trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], SCHEMA))) == []


def test_shared_conversations(spark, sf_dir, rows):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(op11_prefix_trie(spark, sf_dir)) == by_hand(table)


def test_slots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 5000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        a[: n // 2] = 7  # half of the keys differ in one word only
        again = rng.permutation(np.repeat(np.arange(n), 3))
        slots = prefix_trie.Slots(a[again], b[again])
        assert slots.n == n
        assert sorted(slots.find(a, b).tolist()) == list(range(n))
        assert (slots.find(a ^ np.uint64(1), b) == -1).all()


def test_two_prefixes_with_one_digest_are_told_apart(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "", ""), (2, 0, "user", "b", "", "")], SCHEMA)
    turns = prefix_trie.turns_of(frame)
    one = turns.withColumn("pos", F.when(F.col("conv_id") == 1, 1).otherwise(1).cast("long"))
    convs = one.select("conv_id", F.lit(1).cast("long").alias("n_turns"))
    same = prefix_trie.F.xxhash64
    try:
        prefix_trie.F.xxhash64 = lambda *a: F.lit(5).cast("long")
        with pytest.raises(Exception, match="share a digest"):
            prefix_trie.prefix_nodes(one, convs).count()
    finally:
        prefix_trie.F.xxhash64 = same
