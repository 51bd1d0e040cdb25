"""Repeated passages by names of strings at sampled places, in place of prefix doubling (see the README).

A byte is removed if some string of `threshold` bytes that covers it also starts elsewhere. Every such
string (a window) owns one anchor: the place of the smallest hash among its first `SPAN` places. Equal
windows own anchors at equal distances, so only anchors are sorted, not all places.

Round by round Spark groups anchors by a rank pair: the name of a prefix and the name of what follows it at the
round's offset. A name stands for a string (a 64-bit hash, as in Karp, Miller and Rosenberg's naming),
so it needs no join with the ranks of other places. Per round, a group of anchors whose windows lie at the same distances
  - is alone in its pair: none of its windows repeats, it is done;
  - is not alone in the string that spans all its windows: every window repeats, it is done, and one of
    its kind stays as a partner for others;
  - else its distances are split and it stays for the next round, whose pairs reach further,
until the pair spans the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import bucketed, written
from loglattice.llm.tokens import by_size

SPAN = 128
#: How many window distances a group holds, round by round.
WIDTHS = (SPAN, 16, 1)
#: Fixed odd multipliers of the hashes.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
GRAM = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(29)
    return x


class Names:
    """Names of all strings of at least `GRAM` bytes in a buffer, from one running sum."""

    def __init__(self, raw: np.ndarray):
        n = len(raw) - GRAM + 1
        grams = np.ndarray(n, dtype="<u8", buffer=raw, strides=(1,)).astype(np.uint64)
        self.grams = _mixed(grams)
        powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.grams * powers)])
        self.back = np.cumprod(np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The name of bytes begin to end; equal strings have equal names wherever they lie."""
        return _mixed((self.sums[end - GRAM + 1] - self.sums[begin]) * self.back[begin] ^ (end - begin).astype(np.uint64))


def _smallest(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each place, where the smallest hash of it and the following `span - 1` places is, leftmost if equal."""
    low = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done < span:
        step = min(done, span - done)
        low = np.concatenate([np.minimum(low[:-step], low[step:]), low[-step:]])
        done += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _bytes(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first row, last row, bytes of all, offsets); a longer text is a run of its own.

    About a hundred bytes of working memory are needed per byte of a run.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for begin, end in by_size(sizes, most):
        run = [t.encode() if isinstance(t, str) else t or b"" for t in column.slice(begin, end - begin).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in run])])
        yield begin, end, np.frombuffer(b"".join(run) + b"\0" * 16, dtype=np.uint8), offsets


def _anchors(names: Names, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, nearest, farthest): the distances from window starts to their anchor, a run per row."""
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(doc))
    valid = places + threshold <= offsets[doc + 1] if len(doc) else np.zeros(0, dtype=bool)
    at = places[valid]
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 4
    owner = _smallest(names.grams, SPAN)[at]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1) | (np.diff(doc[at], prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    return doc[at[first]], owner[first], owner[first] - at[last], owner[first] - at[first]


def _rows(names: Names, rows: tuple[np.ndarray, ...], width: int, threshold: int) -> dict[str, np.ndarray]:
    """Splits runs of distances at multiples of `width` and names what each part is grouped by."""
    doc, anchor, near, far = rows
    parts = far // width - near // width + 1
    which = np.repeat(np.arange(len(doc)), parts)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts) + (near // width)[which]
    near, far = np.maximum(near[which], cell * width), np.minimum(far[which], cell * width + width - 1)
    anchor, doc = anchor[which], doc[which]
    # What all windows of the cell share, as a pair of halves.
    begin, end = anchor - cell * width, anchor + threshold - (cell + 1) * width + 1
    middle = begin + (end - begin) // 2
    whole = names.of(anchor - far, anchor + threshold - near)
    rank, following = names.of(begin, middle), names.of(middle, end) ^ _mixed(cell.astype(np.uint64) + np.uint64(1))
    if width > 1:
        # The pair itself only sorts out what is alone, so one number for both will do before the last round.
        rank, following = _mixed(rank ^ _mixed(following)), np.zeros_like(following)
    return {
        "row": doc,
        "anchor": anchor,
        "near": near,
        "far": far,
        "rank": rank,
        "next": following,
        "whole": whole ^ _mixed((near * 1024 + far).astype(np.uint64)),
    }


_NAMES = ["uid", "anchor", "near", "far", "rank", "next", "whole"]
_SCHEMA = "uid long, anchor int, near int, far int, rank long, next long, whole long"


def _batch(values: dict[str, np.ndarray], uids: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """`start`: per text, where its first byte lies in the buffer."""
    at = values["anchor"] - start[values["row"]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(uids[values["row"]]),
            *(pa.array(x.astype(np.int32)) for x in (at, values["near"], values["far"])),
            *(pa.array(values[k].view(np.int64)) for k in ("rank", "next", "whole")),
        ],
        names=_NAMES,
    )


def _judged(groups: DataFrame, name: str) -> DataFrame:
    """The groups that are not alone in their rank pair, with `done`: all their windows repeat.

    `open`: some group of the pair is not done. Groups are counted by pair first; what they span is
    compared only for those that are not alone.
    """
    pair = ["rank", "next"]
    # What groups are joined with is written first: a join on a plain table can split the rows of a hot
    # pair, one in the stage of its aggregate cannot.
    counts = groups.groupBy(pair).agg(F.count(F.lit(1)).alias("n"))
    shared = written(counts.where("n > 1").select(pair), f"{name}-shared")
    left = written(groups.join(shared, pair), f"{name}-pairs")
    kinds = written(left.groupBy(*pair, "whole").agg(F.count(F.lit(1)).alias("same")), f"{name}-kinds")
    open_pairs = kinds.groupBy(pair).agg(F.max(F.col("same") == 1).alias("open"))
    verdicts = kinds.join(open_pairs, pair).select(*pair, "whole", (F.col("same") > 1).alias("done"), "open")
    verdicts = written(verdicts, f"{name}-verdicts")
    return written(left.join(verdicts, [*pair, "whole"]), f"{name}-judged")


def _still_open(judged: DataFrame) -> DataFrame:
    """What goes on: groups not done, and of those done in the same pair one of each kind, as their partner."""
    place = ["uid", "anchor", "near", "far"]
    partners = (
        judged.where("done AND open")
        .groupBy("rank", "next", "whole")
        .agg(F.min(F.struct(*place)).alias("p"))
        .select("p.*")
    )
    return judged.where("NOT done").select(place).union(partners)


def repeated_spans(texts: DataFrame, threshold: int = 200) -> DataFrame:
    """(uid, spans): per document with any, the byte ranges [begin, end) that repeated windows cover, merged.

    `texts` has a unique `uid` and `text`, best bucketed by uid. A document's ranges are at most as many as its
    anchors and windows, so gathering them is bounded by the document itself.
    """
    if threshold < SPAN + GRAM:
        raise ValueError(f"threshold must be at least {SPAN + GRAM} bytes")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for begin, end, raw, offsets in _bytes(batch.column("text")):
                names = Names(raw)
                rows = _rows(names, _anchors(names, offsets, threshold), WIDTHS[0], threshold)
                yield _batch(rows, uids[begin:end], offsets)

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, rows, text in zip(batch.column("uid"), batch.column("rows"), batch.column("text")):
                raw = text.as_py().encode()
                places = [(r["anchor"], r["near"], r["far"]) for r in rows.as_py()]
                columns = [pa.array([r[k] for r in places], pa.int32()) for k in range(3)]
                cuts = pa.array([raw[a - far : a - near + threshold] for a, near, far in places], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * len(places)), *columns, cuts], names=["uid", "anchor", "near", "far", "cut"])

    def again(width: int):
        """Splits the groups of an excerpt; `rows` are the parts of it that are still open."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uids = batch.column("uid").to_numpy(zero_copy_only=False)
                places, far = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("anchor", "far"))
                lists = batch.column("rows")
                for begin, end, raw, offsets in _bytes(batch.column("cut")):
                    some = lists.slice(begin, end - begin)
                    which = np.repeat(np.arange(end - begin), np.asarray(some.value_lengths()))
                    near_, far_ = (some.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                    anchors = offsets[:-1] + far[begin:end]
                    values = _rows(Names(raw), (which, anchors[which], near_, far_), width, threshold)
                    yield _batch(values, uids[begin:end], anchors - places[begin:end])

        return split

    covered, cuts = None, None
    groups = texts.select("uid", "text").mapInArrow(first, _SCHEMA)
    for k, width in enumerate(WIDTHS):
        judged = _judged(groups, f"round{k}")
        done = judged.where("done") if width > 1 else judged
        found = done.select("uid", (F.col("anchor") - F.col("far")).alias("begin"), (F.col("anchor") - F.col("near") + threshold).alias("end"))
        covered = found if covered is None else covered.union(found)
        if width == 1:
            break
        open_rows = _still_open(judged)
        if cuts is None:
            listed = open_rows.groupBy("uid").agg(F.collect_list(F.struct("anchor", "near", "far")).alias("rows"))
            cuts = written(
                listed.join(texts.select("uid", "text"), "uid").select("uid", "rows", "text").mapInArrow(
                    excerpts, "uid long, anchor int, near int, far int, cut binary"
                ),
                "excerpts",
            )
            parts = cuts.withColumn("rows", F.array(F.struct("near", "far")))
        else:
            # Anchors of one text lie apart, but one anchor may have several groups where a text repeats itself.
            part = open_rows.select("uid", "anchor", F.col("near").alias("n"), F.col("far").alias("f"))
            inside = cuts.join(part, ["uid", "anchor"]).where("n >= near AND f <= far")
            parts = inside.groupBy("uid", "anchor", "near", "far").agg(
                F.first("cut").alias("cut"), F.collect_list(F.struct(F.col("n").alias("near"), F.col("f").alias("far"))).alias("rows")
            )
        groups = written(parts.select("uid", "anchor", "far", "rows", "cut").mapInArrow(again(WIDTHS[k + 1]), _SCHEMA), f"round{k + 1}")

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def merged(spans: pd.Series) -> pd.Series:
        out = []
        for rows in spans:
            ranges = np.array([(r["begin"], r["end"]) for r in rows], dtype=np.int64)
            ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
            reach = np.maximum.accumulate(ranges[:, 1])
            first = np.flatnonzero(np.append(True, ranges[1:, 0] > reach[:-1]))
            out.append([{"begin": int(ranges[i, 0]), "end": int(reach[j])} for i, j in zip(first, np.append(first[1:], len(ranges)) - 1)])
        return pd.Series(out)

    return covered.groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).select("uid", merged("spans").alias("spans"))


def dedup_passages(docs: DataFrame, threshold: int = 200, text: str = "text", kept: str = "kept_text") -> DataFrame:
    """Every document with `kept` (its bytes outside repeated windows), n_bytes, n_removed, n_spans and kept_sha256.

    Missing and empty texts have no bytes. Repeated rows are documents of their own, so their long
    texts are removed from both. Cutting may split a character: `kept` is binary. Other columns stay,
    those of the added names are replaced. No rows give no rows.
    """
    added = [kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "uid"]
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])
    numbered = bucketed(rows.withColumn("uid", F.monotonically_increasing_id()), "uid", "numbered-texts")
    spans = written(repeated_spans(numbered.select("uid", F.col(text).cast("string").alias("text")), threshold).withColumnRenamed("spans", "__spans"), "spans")

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(texts, spans):
            raw, at, parts = t.encode(), 0, []
            for r in rows if rows is not None else ():
                parts.append(raw[at : r["begin"]])
                at = r["end"]
            out.append(b"".join([*parts, raw[at:]]))
        return pd.Series(out)

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.lit(0).cast("long")
    return (
        numbered.join(spans, "uid", "left")
        .withColumn(kept, cut(whole, "__spans"))
        .select(
            *[f"`{c}`" for c in numbered.columns if c != "uid"],
            kept,
            F.octet_length(whole).cast("long").alias("n_bytes"),
            F.coalesce(F.aggregate("__spans", none, lambda n, s: n + s["end"] - s["begin"]), none).alias("n_removed"),
            F.when(F.col("__spans").isNull(), none).otherwise(F.size("__spans").cast("long")).alias("n_spans"),
            F.sha2(kept, 256).alias("kept_sha256"),
        )
    )


def readable(column: str) -> Column:
    """Bytes as text, without the remains of characters that a cut went through."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x.decode("utf-8", "ignore") for x in raw])

    return decoded(column)
