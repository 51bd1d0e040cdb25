"""The trie of all conversation prefixes: members, children, leaves and saved tokens of every node.

A prefix is named by a 128-bit digest, the exclusive or of its turns' hashes at their positions, so digests
are running aggregates that split anywhere. Rows (conversation, depth) are dealt to shards, ranges of
(conversation, depth) of bounded size. In a shard the distinct digests get slots by a minimal perfect hash;
whatever is looked up is compared with the digest kept in the slot. Counts are scattered into flat arrays by
slot, so a node of a shard is one row before anything is shuffled.

Sums over subtrees: a node's weight is given to its smallest member's row alone. A shard adds its weights
up through the array of parents' slots, deepest first, and a node's sum is that of its shards. Where a
conversation goes on in a later shard, that shard's total for it is carried back to its last row here.
Only a conversation's last row of a shard and its totals per shard are needed for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.prefix import running
from loglattice.llm.common import written

#: Rows (conversation, depth) a shard has, about.
SHARD = 400_000
#: Ids joined to one string at a time.
JOINED = 50_000


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of two 64-bit words, other ones for every level."""
    x = b + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for word in (a, np.uint64(0)):
        x = x ^ word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


class Slots:
    """A minimal perfect hash: n distinct keys of two 64-bit words have the slots 0 to n-1.

    On each level the keys left are hashed into a bit array half as large again; those alone in their place stay, the
    others go on to the next level. A slot is the number of set bits before the key's. The keys lie in slot order,
    so that a key which is none of the n is told from one that is.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[first], b[first]
        self.n, self.levels = len(a), []
        slots, left, used = np.zeros(self.n, dtype=np.int64), np.arange(self.n), 0
        while len(left):
            size = len(left) * 3 // 2 + 1
            at = (_mixed(a[left], b[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            ranks = used - 1 + np.cumsum(alone)
            self.levels.append((size, alone, ranks))
            stays = alone[at]
            slots[left[stays]] = ranks[at[stays]]
            used, left = used + int(alone.sum()), left[~stays]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that have none."""
        found, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for level, (size, alone, ranks) in enumerate(self.levels):
            at = (_mixed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
            here = alone[at]
            found[left[here]] = ranks[at[here]]
            left = left[~here]
        known = found >= 0
        known[known] = (self.a[found[known]] == a[known]) & (self.b[found[known]] == b[known])
        return np.where(known, found, -1)


def _words(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64, copy=False).view(np.uint64) for n in names]


def _counted(table: pa.Table) -> pa.Table:
    """A row per node of a shard: members, the smallest, and what tells nodes with one digest apart."""
    a, b = _words(table, "k1", "k2")
    slots = Slots(a, b)
    at = slots.find(a, b)
    n_convs = np.bincount(at, minlength=slots.n)
    conv = table.column("conv_id").to_numpy()
    least = np.full(slots.n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, conv)
    columns = {"k1": slots.a.view(np.int64), "k2": slots.b.view(np.int64), "n_convs": n_convs.astype(np.int64), "least": least}
    digests = b"".join(table.column("digest").to_pylist())
    words = np.frombuffer(digests, dtype="<i8").reshape(-1, 4)
    told = {f"w{i}": words[:, i] for i in range(4)}
    told |= {c: table.column(c).to_numpy() for c in ("depth", "n_bytes", "p1", "p2")}
    for name, values in told.items():
        kept = np.empty(slots.n, dtype=np.int64)
        kept[at] = values
        if (kept[at] != values).any():
            raise RuntimeError("two prefixes share a digest")
        columns[name] = kept
    return pa.table(columns)


def _added_up(table: pa.Table) -> pa.Table:
    """Nodes of a shard with the weights of their subtrees that lie in this shard.

    The conversation that began in an earlier shard is added up on its own: what it weighs here is carried back to
    that shard, so it must not reach ancestors through other conversations of this one.
    """
    conv, depth = (table.column(c).to_numpy() for c in ("conv_id", "depth"))
    begun_here = np.isin(conv, conv[depth == 0])
    return pa.concat_tables(_sums(t) for t in (table.filter(pa.array(begun_here)), table.filter(pa.array(~begun_here))) if len(t))


def _sums(table: pa.Table) -> pa.Table:
    a, b, pa_, pb = _words(table, "k1", "k2", "p1", "p2")
    slots = Slots(a, b)
    at = slots.find(a, b)
    depth, parent = np.zeros(slots.n, dtype=np.int64), np.full(slots.n, -1, dtype=np.int64)
    depth[at] = table.column("depth").to_numpy()
    parent[at] = slots.find(pa_, pb)
    parent[depth == 0] = -1
    sums = {}
    for name in ("leaves", "tokens"):
        sums[name] = np.zeros(slots.n, dtype=np.int64)
        np.add.at(sums[name], at, table.column(name).to_numpy())
    order = np.argsort(depth, kind="stable")[::-1]
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, ends):  # of one depth each, deepest first
        level = level[parent[level] >= 0]
        for values in sums.values():
            np.add.at(values, parent[level], values[level])
    return pa.table({"k1": slots.a.view(np.int64), "k2": slots.b.view(np.int64), **sums})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node as one row: the ids in decimal, joined by commas."""
    names = ["k1", "k2", "first", "ids"]
    rows: list[tuple] = []
    key, ids = None, []
    for batch in batches:
        for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (key != (k1, k2) or len(ids) == JOINED):
                rows.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = (k1, k2)
            ids.append(conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
            rows = []
    if ids:
        rows.append((*key, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined ids, piece after piece, so that no node's ids are ever in memory together."""
    names = ["k1", "k2", "ends_sha256"]
    rows: list[tuple] = []
    key, state = None, None
    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(i) for i in (0, 1, 3))):
            now = (k1.as_py(), k2.as_py())
            if now == key:
                state.update(b",")
            else:
                if key:
                    rows.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.as_py().encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
            rows = []
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=names)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes): the turns of every conversation in order, from 1, as a written table.

    In order of `turn`, NULL first; turns with one number go by role, then by the digest. A NULL role or text is
    empty, repeated rows are turns of their own, and rows without a conv_id are left out. `digest` is the SHA-256 of
    (role, text), `n_bytes` the text's size in UTF-8.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    told_apart = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(told_apart, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    return written(running(turns, ["conv_id"], order, {"pos": ("sum", F.lit(1))}).drop("turn", "role"), "turns")


def borrowed_starts(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another: (turns, conversations).

    `base` and `taken` are expressions of conv_id: the other conversation, and how many of its first turns
    stand in the place of as many own ones (all it has, if fewer; `most` at most). The second frame has every conv_id with its number of turns,
    `n_turns`, which may be 0.
    """
    sizes = written(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "conversations")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", base.alias("base"), taken.cast("long").alias("taken")).join(bases, "base", "left")
    starts = F.least("taken", F.coalesce("n_base", F.lit(0))).cast("long")
    convs = convs.select("conv_id", "base", "taken", starts.alias("starts"), (starts + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("n_turns"))
    convs = written(convs, "conversations-rebuilt")
    own = turns.join(convs, "conv_id").where("pos > taken").select(
        "conv_id", (F.col("pos") - F.col("taken") + F.col("starts")).alias("pos"), "digest", "n_bytes"
    )
    first = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    first = first.join(convs, "base").where("pos <= starts").select("conv_id", "pos", "digest", "n_bytes")
    return own.union(first), convs.select("conv_id", "n_turns")


def prefix_nodes(turns: DataFrame, convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per node of the trie of `turns` (conv_id, pos, digest, n_bytes) of `convs` (conv_id, n_turns).

    conv_id is the smallest member's, parent_conv_id the parent's (NULL at the root), depth the number of turns;
    n_convs members, n_children children, n_leaves childless nodes of the subtree, the node itself included;
    saved_tokens sums (n_convs - 1) * bytes of the last text over the subtree; ends_sha256 is of the ascending, comma-joined
    ids of the members that end here. Turns count from 1 without gaps. A conversation without turns ends at the root. No conversations, no nodes.
    """
    spark = turns.sparkSession
    none = F.lit(bytes(32))
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "digest", "n_bytes").union(
        convs.select("conv_id", F.lit(0).cast("long"), none, F.lit(0).cast("long"))
    )
    rows = written(
        rows.select("*", *[F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(i), "digest", "depth")).alias(f"x{i}") for i in (1, 2)]),
        "prefixes",
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard))
    keys = {f"k{i}": ("xor", F.col(f"x{i}")) for i in (1, 2)}
    rows = running(rows, ["conv_id"], ["depth"], keys, parts=parts, part="part")
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    rows = written(rows.select("part", "conv_id", "depth", "k1", "k2", *parents, "digest", "n_bytes"), "prefix-digests")

    same = ["w0", "w1", "w2", "w3", "depth", "n_bytes", "p1", "p2"]
    counts = rows.groupBy("part").applyInArrow(_counted, ", ".join(f"{c} long" for c in ["k1", "k2", "n_convs", "least", *same]))
    nodes = counts.groupBy("k1", "k2").agg(
        F.sum("n_convs").alias("n_convs"),
        F.min("least").alias("conv_id"),
        *[F.min(c).alias(c) for c in same[4:]],
        *[F.max(c).alias(f"{c}_max") for c in same[4:]],
        *[F.min(c).alias(c) for c in same[:4]],
        *[F.max(c).alias(f"{c}_max") for c in same[:4]],
    )
    agree = F.lit(True)
    for c in same:
        agree &= F.col(c) == F.col(f"{c}_max")
    nodes = written(nodes.select("k1", "k2", "p1", "p2", "n_convs", "conv_id", "depth", "n_bytes", agree.alias("agree")), "nodes")
    if nodes.where("NOT agree").limit(1).count():
        raise RuntimeError("two prefixes share a digest")

    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = written(nodes, "nodes-children")

    # A node's weights lie at its smallest member's row, which is the only one with that conv_id and depth.
    weights = nodes.select(
        "conv_id",
        "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("tokens"),
    )
    weighed = rows.select("part", "conv_id", "depth", "k1", "k2", "p1", "p2").join(weights, ["conv_id", "depth"], "left")
    weighed = written(weighed.fillna(0, ["leaves", "tokens"]), "weights")
    later = Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    carried = weighed.groupBy("conv_id", "part").agg(
        F.max_by(F.struct("depth", "k1", "k2", "p1", "p2"), "depth").alias("last"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")
    )
    carried = carried.select("part", "conv_id", "last.*", F.sum("leaves").over(later).alias("leaves"), F.sum("tokens").over(later).alias("tokens"))
    columns = ["part", "conv_id", "depth", "k1", "k2", "p1", "p2", "leaves", "tokens"]
    all_weights = weighed.select(columns).union(carried.where("leaves > 0 OR tokens > 0").select(columns))
    sums = all_weights.groupBy("part").applyInArrow(_added_up, "k1 long, k2 long, leaves long, tokens long")
    sums = sums.groupBy("k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))

    last = rows.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"], "left_semi").select("k1", "k2", "conv_id")
    joined = last.repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    joined = joined.mapInArrow(_joined, "k1 long, k2 long, first long, ids string")
    ends = joined.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")

    whole = nodes.join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left")
    whole = written(whole, "nodes-whole")
    # A node with very many children is a hot key here alone; both sides are tables, so the planner can split it.
    parent = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    above = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return whole.join(parent, ["p1", "p2"], "left").select(
        "conv_id",
        "depth",
        above.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
