"""Texts whose sets of word five-grams overlap: candidates by MinHash, pruned by their posterior, verified exactly.

Texts with equal sets are one class from the start. A class's MinHash values give bands; classes that
share a band are candidates. For a candidate pair the values are compared a few at a time: with a uniform prior on
the similarity, m equal values of n leave a Beta(m + 1, n - m + 1) posterior, and a pair is dropped once
the chance that its similarity reaches the threshold is below the tolerance. What is left is compared set by set.

Pairs never become rows. Classes are dealt to few blocks of bounded bytes, those next to each other that share
a band's smallest class, and groups of such classes that share a band with each other; blocks with a common band meet
in one task, which compares all their candidate pairs and returns counts and star edges of the links it verified.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import components, written

WORDS = 5
BANDS, ROWS = 32, 5
#: Values compared between two looks at the posterior.
STEP = 16
#: Classes compared with each other at a time.
BLOCK = 512
#: A group goes into so many blocks, if it has more than one of `BLOCK` classes, and into more only where the sets and
#: values of a block would take more bytes: a class is moved once per block of its group.
SPLIT = 4
BLOCK_BYTES = 16 << 20
#: How often groups that share a band are drawn together; few, as what they form should not be whole chains of unlike texts.
ROUNDS = 2
SEED = 0x5EED


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


_SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; a shorter text is one run, one without words has none."""
    words = _SPLIT(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    import xxhash

    hashes: dict[str, int] = {}
    one = xxhash.xxh3_64_intdigest
    codes = np.array([hashes.get(w) or hashes.setdefault(w, one(w)) for w in words], dtype=np.uint64)
    n = max(len(codes) - size + 1, 1)
    run = np.full(n, SEED + min(len(codes), size), dtype=np.uint64)
    for k in range(min(size, len(codes))):
        run = _mixed(run ^ codes[k : k + n])
    return np.unique(run)


def _multipliers(count: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signature(values: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """`count` MinHash values (upper 32 bits) of a set; all sets use the same hash functions."""
    out = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    factors = _multipliers(count)
    for begin in range(0, len(values), 1024):
        some = values[begin : begin + 1024, None] * factors[None, :]
        np.minimum(out, (some >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit number per band; bands of different places differ."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(SEED)
    for k in range(ROWS):
        out = _mixed(out ^ rows[:, k])
    return out


def least_matches(threshold: float, tolerance: float, count: int = BANDS * ROWS, step: int = STEP) -> dict[int, int]:
    """After n compared values, the fewest equal ones with which a pair stays.

    P(s >= t) under Beta(m + 1, n - m + 1) is a binomial tail: P(at most m of n + 1 hits at rate t).
    """
    out = {}
    for n in range(step, count + 1, step):
        total, m = 0.0, -1
        for k in range(n + 1):
            total += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if total >= tolerance:
                m = k
                break
        out[n] = m
    return out


def _survivors(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of candidate pairs that no look at the posterior drops. A candidate shares a band."""
    shared = np.zeros((len(left), len(right)), dtype=bool)
    for k in range(BANDS):
        some = slice(k * ROWS, (k + 1) * ROWS)
        a, b = (np.ascontiguousarray(s[:, some]).view(f"V{4 * ROWS}").ravel() for s in (left, right))
        _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        shared |= codes[: len(a), None] == codes[None, len(a) :]
    x, y = np.nonzero(shared)
    equal, at = np.zeros(len(x), dtype=np.int64), 0
    for n, few in least.items():
        equal += (left[x, at:n] == right[y, at:n]).sum(axis=1)
        stays = equal >= few
        x, y, equal, at = x[stays], y[stays], equal[stays], n
    return x, y


def _compared(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def links(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", kind="stable").reset_index(drop=True)
        ids, size, block = rows["class"].to_numpy(), rows["size"].to_numpy(), rows["block"].to_numpy()
        sets = [np.frombuffer(s, dtype="<u8") for s in rows["grams"]]
        marks = np.array([np.frombuffer(m, dtype="<u4") for m in rows["marks"]])
        i, j = np.flatnonzero(block == keys[0]), np.flatnonzero(block == keys[1])
        n_links, root = np.zeros(len(ids), dtype=np.int64), list(range(len(ids)))

        def top(at: int) -> int:
            while root[at] != at:
                root[at] = at = root[root[at]]
            return at

        for p in range(0, len(i), BLOCK):
            for q in range(p if keys[0] == keys[1] else 0, len(j), BLOCK):
                some, others = i[p : p + BLOCK], j[q : q + BLOCK]
                x, y = _survivors(marks[some], marks[others], least)
                x, y = some[x], others[y]
                if keys[0] == keys[1]:
                    x, y = x[x < y], y[x < y]
                near = np.zeros(len(x), dtype=bool)
                for k, (a, b) in enumerate(zip(x, y)):
                    n, m = len(sets[a]), len(sets[b])
                    if min(n, m) >= threshold * max(n, m):
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        near[k] = both >= threshold * (n + m - both)
                x, y = x[near], y[near]
                np.add.at(n_links, x, size[y])
                np.add.at(n_links, y, size[x])
                least_of = np.arange(len(ids))
                while len(x):
                    low, before = np.minimum(least_of[x], least_of[y]), least_of.copy()
                    np.minimum.at(least_of, x, low)
                    np.minimum.at(least_of, y, low)
                    if (least_of == before).all():
                        break
                moved = np.flatnonzero(least_of != np.arange(len(ids)))
                for a, b in zip(moved.tolist(), least_of[moved].tolist()):
                    a, b = top(a), top(b)
                    root[max(a, b)] = min(a, b)
        root = np.array([top(at) for at in root])
        on = np.flatnonzero(n_links)
        return pd.DataFrame({"class": ids[on], "n": n_links[on], "root": ids[root[on]]})

    return links


def _drawn_together(bands: DataFrame) -> DataFrame:
    """(near, group) of the groups in `bands` (near, band) that share a band with others.

    In each round a group and all it holds go over to the smallest of the groups it shares a band with.
    """
    hubs = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = written(bands.join(hubs, "band", "left_semi").select("near", F.col("near").alias("group"), "band"), "groups-in-bands")
    for _ in range(ROUNDS):
        tops = at.groupBy("band").agg(F.min("group").alias("top"))
        moves = at.join(tops, "band").groupBy("group").agg(F.min("top").alias("top"))
        at = written(at.join(moves, "group").select("near", F.col("top").alias("group"), "band"), "groups-in-bands")
    return at.select("near", "group").distinct()


def jaccard_links(
    docs: DataFrame,
    threshold: float = 0.8,
    tolerance: float = 1e-9,
    text: str = "text",
    key: str = "doc_id",
    uid: str | None = None,
) -> DataFrame:
    """(uid, key, class_id, n_links, kept) of every row of `docs`.

    Two texts are linked if their sets of five-word runs have a Jaccard similarity of at least `threshold`;
    a text of fewer words is one run, and one without words (missing, empty) is linked to nothing. `class_id` is
    the smallest key that links reach; `n_links` counts the rows linked directly, copies included. One row
    per class is `kept`: that with the smallest key, of those with equal keys one. A row with a NULL key
    has no links and is kept. `uid` names a column that tells rows apart; without it rows are numbered. Other
    columns are not used. No rows give no rows.

    A pair at the threshold shares a band but for 3 in a million, more often the more alike it is.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                classes, keys, n_runs = [], [], []
                for t in some.column("text"):
                    found = shingles(t.as_py())
                    # 128 bits name a set: its sum and its exclusive-or, each mixed.
                    total = _mixed(np.add.reduce(found, dtype=np.uint64).reshape(1) + np.uint64(len(found)))
                    folded = _mixed(np.bitwise_xor.reduce(_mixed(found)).reshape(1)) if len(found) else total
                    classes.append(np.concatenate([total, folded]).astype("<u8").tobytes() if len(found) else None)
                    keys.append(bands(signature(found)).view(np.int64) if len(found) else None)
                    n_runs.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [some.column("uid"), some.column("key"), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(n_runs, pa.int64())],
                    names=["uid", "key", "set", "bands", "runs"],
                )

    given = uid is not None
    numbered = docs.select(
        (F.col(uid) if given else F.monotonically_increasing_id()).alias("uid"),
        F.col(key).alias("key"),
        F.col(text).cast("string").alias("text"),
    )
    if not given:
        numbered = written(numbered, "numbered-texts")
    key_type = numbered.schema["key"].dataType.simpleString()
    rows = written(numbered.mapInArrow(digest, f"uid long, key {key_type}, `set` binary, bands array<long>, runs long"), "text-sets")
    # One class per set, named by its smallest (key, uid): combined before it is shuffled. The bands go along, once;
    # fetching them by a join would move them for each use, as soon as the classes are too many to broadcast.
    usable = rows.where("`set` IS NOT NULL AND key IS NOT NULL")
    classes = written(
        usable.groupBy("set").agg(F.min(F.struct("key", "uid", "bands", "runs")).alias("first"), F.count(F.lit(1)).alias("size")).select(
            "set", F.col("first.uid").alias("class"), F.col("first.key").alias("class_key"), "size", "first.bands", "first.runs"
        ),
        "text-classes",
    )
    banded = classes.select("class", "size", "runs", F.explode("bands").alias("band"))
    # Written before the join, which then can split the rows of a hot band.
    counted = banded.groupBy("band").agg(F.min("class").alias("root"), F.count(F.lit(1)).alias("n"))
    shared = written(counted.where("n > 1").select("band", "root"), "shared-bands")
    # Shared bands grow with the corpus: the join is planned as one that holds at any size.
    stars = banded.join(shared.hint("merge"), "band")
    # A class goes with the smallest class of any of its bands: a hot band's is among the smallest, so most of its
    # members come together. Its shared bands stay with it, in one row: at most `BANDS`, however large a group is, and
    # no join has to find them again; nor its size, which would join once per meeting of blocks.
    near = stars.groupBy("class").agg(
        F.min("root").alias("near"), F.collect_list("band").alias("bands"), F.first("runs").alias("runs"), F.first("size").alias("size")
    )
    near = written(near, "band-stars")
    # The rest of a hot band's members have a smaller class in some other band. Left apart, near copies would be many
    # groups that all meet each other, more of them the more near copies there are.
    together = _drawn_together(near.select("near", F.explode("bands").alias("band")).distinct())
    weights = near.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("runs") * 8 + 4 * BANDS * ROWS).alias("n_bytes"))
    weights = weights.join(together, "near", "left").select("near", F.coalesce("group", "near").alias("group"), "n", "n_bytes")
    weights = written(weights, "band-groups")
    enough = F.least(F.lit(SPLIT), F.ceil(F.sum("n") / BLOCK))
    blocks = weights.groupBy("group").agg(F.greatest(enough, F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).alias("blocks"))
    sizes = written(weights.join(blocks, "group").select("near", "group", "blocks"), "band-sizes")
    # A group is split by hash into its blocks.
    place = F.pmod(F.xxhash64("class"), F.col("blocks"))
    placed = near.join(sizes, "near").select("class", "size", F.xxhash64("group", place).alias("block"), "bands")
    placed = written(placed, "band-blocks")
    # Without the bands this is small: texts that meet it need not move as long as it can be sent to them.
    members = written(placed.select("class", "size", "block"), "band-members")
    # Blocks meet where a band has rows in both; a band's blocks are far fewer than its rows.
    in_band = placed.select("block", F.explode("bands").alias("band")).groupBy("band", "block").agg(F.count(F.lit(1)).alias("n"))
    in_band = written(in_band, "blocks-in-bands")
    alone = in_band.where("n > 1").select(F.col("block").alias("left"), F.col("block").alias("right"))
    lists = in_band.groupBy("band").agg(F.sort_array(F.collect_list("block")).alias("list")).where(F.size("list") > 1)
    met = lists.select(F.explode("list").alias("left"), "list").select(
        "left", F.explode(F.filter("list", lambda x: x > F.col("left"))).alias("right")
    )
    pairs = written(alone.union(met).distinct(), "block-pairs")

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                sets = [shingles(t.as_py()) for t in some.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("uid"),
                        pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                        pa.array([signature(s).astype("<u4").tobytes() for s in sets], pa.binary()),
                    ],
                    names=["class", "grams", "marks"],
                )

    wanted = numbered.select("uid", "text").join(members.select(F.col("class").alias("uid")), "uid", "left_semi")
    ready = written(wanted.mapInArrow(prepared, "class long, grams binary, marks binary"), "candidate-sets")
    sides = pairs.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    work = (
        sides.join(members, "block")
        .join(ready, "class")
        .select("left", "right", "class", "size", "block", "grams", "marks")
    )
    found = work.groupBy("left", "right").applyInPandas(_compared(threshold, tolerance), "class long, n long, root long")
    found = written(found, "text-links")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "text-links")
    named = (
        classes.join(linked.select(F.col("id").alias("class"), "component"), "class", "left")
        .join(counts, "class", "left")
        .select("set", "class", "class_key", "size", F.coalesce("component", "class").alias("group"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    least = named.groupBy("group").agg(F.min(F.struct("class_key", "class")).alias("least"))
    named = written(named.join(least, "group"), "text-groups")
    whole = usable.join(named, "set").select(
        "uid",
        F.col("key"),
        F.col("least.class_key").alias("class_id"),
        (F.col("n") + F.col("size") - 1).cast("long").alias("n_links"),
        (F.col("uid") == F.col("least.class")).alias("kept"),
    )
    rest = rows.where("`set` IS NULL OR key IS NULL").select(
        "uid", "key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")
    )
    return whole.union(rest).withColumnRenamed("key", key)
