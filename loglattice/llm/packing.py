"""Packing token pieces into sequences of a fixed length by non-negative least squares.

Documents are cut into full windows and one rest. Rests are counted by length class; every combination
of up to `DEPTH` classes that fills a window is a pattern, and non-negative least squares finds how often
each is needed so that the classes' counts come out. The repeats are rounded down; rests get slots in
their class's patterns by their number within the class. What rounding leaves over is laid end to end
and cut at window borders.

The driver sees counts by class only, whose number does not depend on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loglattice.llm.common import work_dir, written
from loglattice.llm.tokens import id_type, token_table

DEPTH = 3
CLASSES = 128


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Combinations of 1 to `depth` classes, larger first, whose upper ends fill a window exactly.

    Class c holds lengths up to c + 1 units of a window of `classes` units. One class alone is a pattern
    too, filled or not, so every histogram has a solution.
    """
    out = [(c,) for c in range(classes)]

    def grow(prefix: tuple[int, ...], room: int) -> None:
        if room == 0 and len(prefix) > 1:
            out.append(prefix)
        if room and len(prefix) < depth:
            for c in range(min(prefix[-1], room - 1), -1, -1):
                grow((*prefix, c), room - c - 1)

    for c in range(classes - 1, -1, -1):
        grow((c,), classes - c - 1)
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with small |a x - b|: Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(float(np.abs(b).max(initial=0)), 1.0) * a.shape[0]
    barred = np.zeros(n, dtype=bool)
    for _ in range(rounds):
        best = int(np.where(passive | barred, -np.inf, gradient).argmax())
        if passive[best] or barred[best] or gradient[best] <= tolerance:
            break
        passive[best] = True
        moved = False
        while passive.any():
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                moved = True
                break
            # Go as far as all stay non-negative, and let go of what stops there.
            low = np.flatnonzero(s <= 0)
            ratio = x[on][low] / np.maximum(x[on][low] - s[low], 1e-300)
            step = ratio.min()
            moved |= step > 0
            x[on] += step * (s - x[on])
            stopped = on[low[ratio <= step * (1 + 1e-12)]]
            x[stopped] = 0
            passive[stopped] = False
        # A column that had to leave at once would be chosen again: not before another one has moved.
        barred[:] = barred & (not moved)
        barred[best] |= not passive[best]
        gradient = a.T @ (b - a @ x)
    return x


def plan(counts: np.ndarray, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats), such that no class is asked for more rests than it has."""
    combos = patterns(classes)
    a = np.zeros((classes, len(combos)))
    for k, combo in enumerate(combos):
        for c in combo:
            a[c, k] += 1
    # A pattern that leaves room costs what it leaves, so full windows are preferred: an extra equation.
    waste = np.array([classes - sum(c + 1 for c in combo) for combo in combos], dtype=float) / classes
    x = non_negative_least_squares(np.vstack([a, waste]), np.concatenate([counts.astype(float), [0.0]]))
    times = np.floor(x + 1e-6).astype(np.int64)
    left = counts.astype(np.int64) - (a @ times).astype(np.int64)
    # Least squares may ask for a few too many: take them back, wasteful patterns first.
    for k in np.argsort(-waste, kind="stable"):
        while times[k] and any(left[c] < 0 for c in combos[k]):
            back = min(int(times[k]), max(-int(left[c]) for c in combos[k]))
            times[k] -= back
            for c in combos[k]:
                left[c] += back
    # And wherever a whole pattern still fits into what is left, repeat it: fullest first.
    for k in np.argsort(waste, kind="stable"):
        if waste[k] > 1e-9:
            break
        need = np.bincount(combos[k], minlength=classes)
        more = int((left[need > 0] // need[need > 0]).min())
        if more > 0:
            times[k] += more
            left -= more * need
    return [(combos[k], int(times[k])) for k in np.flatnonzero(times) if waste[k] <= 1e-9]


def numbered(rows: DataFrame, group: str, order: list[str], amount: str) -> DataFrame:
    """Adds k = 0, 1, ... within `group` in `order`, and before: the sum of `amount` over the rows before.

    A hot group is not gathered: rows are ranged by (group, order), numbered inside their partition,
    and shifted by the totals of the partitions before, which are one row per partition and group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    names = ranged.columns
    at, size = names.index(group), names.index(amount)
    schema = StructType([*ranged.schema.fields, *(StructField(x, LongType()) for x in ("part", "k", "before"))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n, total = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at).to_numpy(zero_copy_only=False)
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(groups))))
            sums = np.cumsum(sizes) - sizes
            k, before = np.arange(len(groups)) - first[run], sums - sums[first][run]
            if groups[0] == last:
                k[run == 0] += n
                before[run == 0] += total
            last, n, total = groups[-1], int(k[-1]) + 1, int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(groups), part)), pa.array(k), pa.array(before)],
                names=[*names, "part", "k", "before"],
            )

    inside = written(ranged.mapInArrow(number, schema), "numbered")
    totals = inside.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    w = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        group,
        "part",
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("total").over(w), F.lit(0)).alias("sum_before"),
    )
    return inside.join(shift, [group, "part"]).select(
        *names, (F.col("k") + F.col("n_before")).alias("k"), (F.col("before") + F.col("sum_before")).alias("before")
    )


def _crcs(tokens: DataFrame, kind: str, window: int, key_type: str) -> DataFrame:
    """(uid, key, doc_tokens, crcs): the checksum of every window of a document, the rest's last."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, crcs = [], []
            for ids in batch.column("ids"):
                wide = np.frombuffer(ids.as_buffer(), dtype=kind).astype("<u4").tobytes()
                counts.append(len(wide) // 4)
                crcs.append([zlib.crc32(wide[i : i + 4 * window]) for i in range(0, len(wide), 4 * window)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["uid", "key", "doc_tokens", "crcs"],
            )

    return tokens.select("uid", "key", "ids").mapInArrow(
        sums, f"uid long, key {key_type}, doc_tokens long, crcs array<long>"
    )


def _slice_crc(kind: str):
    @F.pandas_udf("long")
    def crc(ids: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series(
            [zlib.crc32(np.frombuffer(x, dtype=kind)[s : s + n].astype("<u4").tobytes()) for x, s, n in zip(ids, start, length)],
            dtype="int64",
        )

    return crc


def pack_tokens(
    docs: DataFrame, path: str, end_id: int, window: int = 2048, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Pieces, and the token table they refer to by `uid`.

    One row per piece: uid, key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each
    document's ids, `end_id` last, lie in its pieces once each; `start` counts the ids before the piece in
    its document. Pieces of a sequence follow each other without gaps from offset 0, and a sequence
    holds at most `window` ids. Missing and empty texts have one id. Repeated rows and NULL keys are
    documents of their own. Other columns are not used. No rows give no pieces.
    """
    kind = id_type(path)
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), docs[text].alias("text"))
    encoded = token_table(source, path, end_id)
    table = work_dir(docs.sparkSession, "token-ids")
    encoded.write.option("compression", "zstd").parquet(table)
    tokens = docs.sparkSession.read.schema(encoded.schema).parquet(table)
    key_type = source.schema["key"].dataType.simpleString()
    cuts = written(_crcs(tokens, kind, window, key_type), "token-windows").withColumn(
        "rest", F.col("doc_tokens") % window
    )
    unit = window // CLASSES
    rests = cuts.where("rest > 0").select(
        "uid",
        "key",
        "doc_tokens",
        "rest",
        F.element_at("crcs", -1).alias("ids_crc32"),
        F.floor((F.col("rest") - 1) / unit).cast("int").alias("class"),
    )
    by_class = written(numbered(rests, "class", ["rest", "uid"], "rest"), "rests")
    counts = np.zeros(CLASSES, dtype=np.int64)
    for row in by_class.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["class"]] = row["n"]
    slots, used, sequences = [], np.zeros(CLASSES, dtype=np.int64), 0
    for combo, times in plan(counts):
        for slot, c in enumerate(combo):
            slots.append((int(c), int(used[c]), int(used[c] + times), sequences, slot))
            used[c] += times
        sequences += times
    # One row per slot of a pattern: bounded by the number of patterns, whatever the corpus.
    lookup = docs.sparkSession.createDataFrame(slots, "slot_class int, lo long, hi long, first long, slot int")
    placed = by_class.join(
        F.broadcast(lookup),
        (F.col("class") == F.col("slot_class")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")),
        "left",
    )
    common = ["uid", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        placed.where("slot IS NOT NULL")
        .withColumn("sequence_id", F.col("first") + F.col("k") - F.col("lo"))
        .withColumn("offset", F.coalesce(F.sum("rest").over(inside), F.lit(0)))
        .withColumn("start", F.col("doc_tokens") - F.col("rest"))
        .withColumn("length", F.col("rest"))
        .select(common)
    )
    # The leftovers, end to end, cut where a window is full.
    loose = placed.where("slot IS NULL").select("uid", "key", "doc_tokens", "rest", "ids_crc32", F.lit(0).alias("all"))
    laid = written(numbered(loose, "all", ["uid"], "rest"), "leftovers")
    room = window - F.col("before") % window
    ends = laid.agg(F.max(F.col("before") + F.col("rest"))).first()[0] or 0
    doc_start = F.col("doc_tokens") - F.col("rest")
    whole = laid.where(F.col("rest") <= room).select(
        "uid",
        "key",
        doc_start.alias("start"),
        F.col("rest").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(sequences) + F.floor(F.col("before") / window)).alias("sequence_id"),
        (F.col("before") % window).alias("offset"),
    )
    parts = F.array(
        F.struct(doc_start.alias("start"), room.alias("length"), F.lit(0).alias("next"), (F.col("before") % window).alias("offset")),
        F.struct((doc_start + room).alias("start"), (F.col("rest") - room).alias("length"), F.lit(1).alias("next"), F.lit(0).cast("long").alias("offset")),
    )
    cut = (
        laid.where(F.col("rest") > room)
        .withColumn("part", F.explode(parts))
        .join(tokens.select("uid", "ids"), "uid")
        .select(
            "uid",
            "key",
            "part.start",
            "part.length",
            _slice_crc(kind)("ids", F.col("part.start"), F.col("part.length")).alias("ids_crc32"),
            "doc_tokens",
            (F.lit(sequences) + F.floor(F.col("before") / window) + F.col("part.next")).alias("sequence_id"),
            F.col("part.offset").alias("offset"),
        )
    )
    sequences += -(-ends // window)
    # Whole windows fill a sequence each; documents with any are numbered by how many came before.
    large = cuts.where(F.col("doc_tokens") >= window).select(
        "uid", "key", "doc_tokens", "crcs", F.floor(F.col("doc_tokens") / window).alias("whole"), F.lit(0).alias("all")
    )
    full = (
        numbered(large, "all", ["uid"], "whole")
        .select("*", F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("w", "ids_crc32"))
        .select(
            "uid",
            "key",
            (F.col("w") * F.lit(window).cast("long")).alias("start"),
            F.lit(window).cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.lit(sequences) + F.col("before") + F.col("w")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    pieces = filled.unionByName(whole).unionByName(cut).unionByName(full)
    return pieces.withColumnRenamed("key", key), tokens


def sequences_of(pieces: DataFrame, tokens: DataFrame, path: str) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, pieces in order, not padded."""
    kind = id_type(path)

    @F.pandas_udf("array<long>")
    def part(ids: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=kind)[s : s + n].astype(np.int64) for x, s, n in zip(ids, start, length)])

    return (
        pieces.join(tokens.select("uid", "ids"), "uid")
        .select("sequence_id", "offset", part("ids", "start", "length").alias("ids"))
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
