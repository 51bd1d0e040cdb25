"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources they belong to. A pattern offers its size
several times, each further copy dearer than the one before; every source asks for its target. The
cheapest flow decides how much of each pattern goes to which source. Within a pattern, every document
is taken the same whole number of times, and a seeded choice of documents once more; the last one chosen is
taken in part, so that a source's words meet its target.

The flow sees one row per pattern and source, never documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import n_words, text_or_empty, written

#: Weights of the sources in order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
#: Children per level when the seeded order is cut at a size.
FANOUT = 4096
LEVELS = 2


def targets(sizes: dict, weights: dict, repeats: int = 3) -> dict:
    """Shares of all sizes by weight; a source stops at `repeats` times its size, the excess is reshared."""
    total, out = float(sum(sizes.values())), {}
    open_ = [s for s in sizes]
    while open_:
        scale = total / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * scale > repeats * sizes[s]]
        if not full:
            out |= {s: weights[s] * scale for s in open_}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            total -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def whole_numbers(values: dict) -> dict:
    """Rounded so that the sum is kept: largest remainders go up."""
    low = {k: int(v) for k, v in values.items()}
    missing = round(sum(values.values())) - sum(low.values())
    for k in sorted(values, key=lambda k: low[k] - values[k])[: max(missing, 0)]:
        low[k] += 1
    return low


def min_cost_flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Per pattern, how much goes to each of its sources: as much as can, at the least cost.

    Copy k of a pattern holds its size and costs k per word, which is convex, so arcs fill in order.
    Shortest augmenting paths with potentials; each path fills an arc, so their number is bounded by arcs.
    """
    n, m = len(sizes), len(quotas)
    start, end = n + m, n + m + 1
    to, room, cost, arcs = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, most: int, price: int) -> int:
        for x, y, r, p in ((a, b, most, price), (b, a, 0, -price)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(p)
        return len(to) - 2

    for p, size in enumerate(sizes):
        for copy in range(repeats):
            arc(start, p, size, copy)
    links = [[(s, arc(p, n + s, repeats * sizes[p], 0)) for s in members[p]] for p in range(n)]
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0)
    potential = [0] * (n + m + 2)
    while True:
        far, by, queue = {start: 0}, {}, [(0, start)]
        settled = set()
        while queue:
            d, a = heapq.heappop(queue)
            if a in settled:
                continue
            settled.add(a)
            for e in arcs[a]:
                if room[e] > 0:
                    b, reach = to[e], d + cost[e] + potential[a] - potential[to[e]]
                    if reach < far.get(b, reach + 1):
                        far[b], by[b] = reach, e
                        heapq.heappush(queue, (reach, b))
        if end not in far:
            break
        for a in range(n + m + 2):
            potential[a] += far.get(a, far[end]) if a in far and far[a] <= far[end] else far[end]
        path, a = [], end
        while a != start:
            path.append(by[a])
            a = to[by[a] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return [{s: room[e ^ 1] for s, e in row if room[e ^ 1]} for row in links]


def _cut(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds `extra`: the words taken once more of documents in seeded order, until `rest` of their pattern.

    The order is that of a 64-bit seeded hash `u`. Sizes are summed by leading digits of it, FANOUT per
    level, and only the digit in which the sum is reached is looked into further; so no pattern is sorted whole.
    """
    left, done = sized.join(wanted.select("pattern", "rest"), "pattern"), None
    for level in range(LEVELS):
        shift = 64 - 12 * (level + 1)
        left = written(left.withColumn("digit", F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(FANOUT - 1))), f"mix-level{level}")
        sums = left.groupBy("pattern", "digit").agg(F.sum("size").alias("in_digit"))
        w = Window.partitionBy("pattern").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("in_digit").over(w), F.lit(0)))
        left = left.join(sums, ["pattern", "digit"]).withColumn("room", F.col("rest") - F.col("before"))
        settled = left.where("room <= 0 OR room >= in_digit").select(
            "uid", "pattern", "size", F.when(F.col("room") > 0, F.col("size")).otherwise(0).alias("extra")
        )
        done = settled if done is None else done.unionByName(settled)
        left = left.where("room > 0 AND room < in_digit").select("uid", "pattern", "size", "u", F.col("room").alias("rest"))
    w = Window.partitionBy("pattern").orderBy("u", "uid").rowsBetween(Window.unboundedPreceding, -1)
    last = left.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).select(
        "uid", "pattern", "size", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))).cast("long").alias("extra")
    )
    return done.unionByName(last)


def mix(
    docs: DataFrame,
    sources: Column,
    weight_of: Callable[[list], dict],
    repeats: int = 3,
    seed: int = 7,
    text: str = "text",
    key: str = "doc_id",
    uid: str | None = None,
    whole_copies: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """What is taken of every row, and what every source gets.

    Rows: uid, key, sources, size, taken; `taken` counts words, repeats included, and is at most `repeats`
    times the size. Sources: source, source_size, target.

    `sources` is the array of a document's sources; a NULL in it is a source of its own. `weight_of`
    gives each source its weight, from all of them in code point order, NULL last. Missing and empty texts
    have size 0 and nothing is taken of them. Reruns agree: the choice depends on seed, key and text, and only
    rows equal in both are told apart by place. `uid` names a column that tells rows apart; without it
    rows are numbered. Other columns are not used. No rows give no rows.

    With `whole_copies` the document taken in part is taken whole or not at all, whichever leaves its pattern
    nearer what it should give, whole if both are as near; `taken` then is a multiple of the size.
    """
    whole = text_or_empty(text)
    sized = written(
        docs.select(
            (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"),
            F.col(key),
            F.array_sort(F.array_distinct(sources)).alias("sources"),
            n_words(whole).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key).cast("string"), whole).alias("u"),
        ).withColumn("pattern", F.to_json("sources")),
        "mix-sizes",
    )
    rows = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("size")).collect()

    def last_null(x: str | None) -> tuple[bool, str]:
        return x is None, x or ""

    rows.sort(key=lambda r: [last_null(s) for s in r["sources"]])
    names = sorted({s for r in rows for s in r["sources"]}, key=last_null)
    at = {s: k for k, s in enumerate(names)}
    sizes = {s: sum(r["size"] for r in rows if s in r["sources"]) for s in names}
    aims = targets(sizes, weight_of(names), repeats) if sum(sizes.values()) else dict.fromkeys(names, 0.0)
    quotas = whole_numbers(aims)
    flow = min_cost_flow(
        [r["size"] for r in rows],
        [[at[s] for s in r["sources"]] for r in rows],
        [quotas[s] for s in names],
        repeats,
    )
    spark = docs.sparkSession
    amounts = [(r["pattern"], *divmod(sum(f.values()), max(r["size"], 1))) for r, f in zip(rows, flow)]
    plan = spark.createDataFrame(amounts, "pattern string, copies long, rest long")
    extra = _cut(sized.select("uid", "pattern", "size", "u"), plan)
    if whole_copies:
        extra = extra.withColumn("extra", F.when(F.col("extra") * 2 >= F.col("size"), F.col("size")).otherwise(0))
    taken = (
        sized.drop("u")
        .join(extra.select("uid", "extra"), "uid")
        .join(plan.select("pattern", "copies"), "pattern")
        .select("uid", key, "sources", "size", (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"))
    )
    about = spark.createDataFrame(
        [(s, sizes[s], aims[s]) for s in names], "source string, source_size long, target double"
    )
    return taken, about


def cycled(names: list) -> dict:
    """5, 2, 1, 5, 2, ... in the order of the sources."""
    return {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(names)}
