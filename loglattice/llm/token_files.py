"""Token ids in Huffman-coded files, written and read by Spark tasks.

Ids are counted over the whole corpus; the counts give a canonical code whose lengths are limited
(package-merge), so a table of 2^limit entries decodes any code word in one look-up. A file holds a run
of documents in ascending key order:

    8 bytes magic | 8 bytes header size | header (JSON) | arrays named there | bit stream, big-endian

Arrays are: code lengths by id, document keys, ids per document, and the bit offset of every block. A
block is `BLOCK` ids, whatever documents they belong to, and can be decoded on its own; the reader
decodes all blocks of a file side by side, one id of each per step.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import work_dir, written
from loglattice.llm.tokens import id_type, token_table

MAGIC = b"LLHUFF01"
BLOCK = 512
#: Ids coded or decoded at a time, which bounds memory whatever the file's size; a multiple of BLOCK.
CHUNK = 1 << 20
LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits; 0 for ids that do not occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # Per level, whether each place of the merged list is a leaf; packages are pairs of the level below.
    leaf_of: list[np.ndarray] = []
    merged = weights
    leaf_of.append(np.ones(n, dtype=bool))
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        leaf_of.append(by < n)
    take, depth = 2 * (n - 1), np.zeros(n + 1, dtype=np.int64)
    for leaf in reversed(leaf_of):
        leaves = int(leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(depth)[:n]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: shorter first, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    if len(order):
        width = lengths[order].astype(np.int64)
        top = int(width[-1])
        step = np.left_shift(np.uint64(1), (top - width).astype(np.uint64))
        starts = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.uint64)
        codes[order] = np.right_shift(starts, (top - width).astype(np.uint64))
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of `ids`, and the bit offset of every block. Every `CHUNK` ids start a new 64-bit word."""
    streams, offsets, bits = [], [], 0
    for begin in range(0, len(ids), CHUNK):
        words, at = _pack_chunk(ids[begin : begin + CHUNK], codes, lengths)
        offsets.append(at[::BLOCK] + bits)
        streams.append(words.astype(">u8").tobytes())
        bits += 64 * len(words)
    return b"".join(streams), np.concatenate([*offsets, np.zeros(0, np.int64)]).astype("<u8")


def _pack_chunk(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    at = ends - width
    words = np.zeros(int(ends[-1]) // 64 + 1, dtype=np.uint64)
    code, word, room = codes[ids], at >> 6, 64 - (at & 63) - width
    fits = np.left_shift(code, np.maximum(room, 0).astype(np.uint64))
    value = np.where(room >= 0, fits, np.right_shift(code, np.maximum(-room, 0).astype(np.uint64)))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(value, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= np.left_shift(code[over], (64 + room[over]).astype(np.uint64))
    return words, at


def unpack(stream: bytes, offsets: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The first `n` ids; every step decodes one id of each of many blocks."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    limit = max(int(lengths.max()), 1)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(np.int64(1), limit - lengths[used].astype(np.int64))
    symbol, size = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.uint8)
    begin = int(codes[used[0]]) << (limit - int(lengths[used[0]]))
    symbol[begin : begin + int(spans.sum())] = np.repeat(used, spans)
    size[begin : begin + int(spans.sum())] = np.repeat(lengths[used], spans)
    raw = np.frombuffer(stream + b"\0" * 16, dtype=np.uint8)
    windows = np.ndarray(len(raw) - 7, dtype=">u8", buffer=raw, strides=(1,))
    last = len(stream) * 8
    out = np.zeros((len(offsets), BLOCK), dtype=np.uint32)
    lanes = CHUNK // BLOCK
    for some in range(0, len(offsets), lanes):
        at = offsets[some : some + lanes].astype(np.int64)
        for k in range(min(BLOCK, n)):
            bits = np.left_shift(windows[at >> 3].astype(np.uint64), (at & 7).astype(np.uint64))
            entry = np.right_shift(bits, np.uint64(64 - limit))
            out[some : some + lanes, k] = symbol[entry]
            at = np.minimum(at + size[entry], last)
    return out.reshape(-1)[:n]


def _files(path: str):
    """The file system of a shared folder and the path in it; pyarrow reaches what Spark reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, keys: list, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
    stream, offsets = pack(ids, canonical(lengths), lengths)
    parts = {"lengths": zlib.compress(lengths.tobytes()), "counts": counts.astype("<u8").tobytes(), "offsets": offsets.tobytes()}
    header = json.dumps({"keys": keys, "ids": int(len(ids)), "block": BLOCK, "arrays": {k: len(v) for k, v in parts.items()}, "bytes": len(stream)}).encode()
    system, place = _files(path)
    with system.open_output_stream(place) as out:
        for piece in (MAGIC, len(header).to_bytes(8, "little"), header, *parts.values(), stream):
            out.write(piece)


def read_file(path: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Document keys, ids per document, and all ids of a file."""
    system, place = _files(path)
    with system.open_input_file(place) as file:
        if file.read(8) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        header = json.loads(file.read(int.from_bytes(file.read(8), "little")))
        parts = {k: file.read(n) for k, n in header["arrays"].items()}
        stream = file.read(header["bytes"])
    lengths = np.frombuffer(zlib.decompress(parts["lengths"]), dtype=np.uint8)
    counts = np.frombuffer(parts["counts"], dtype="<u8").astype(np.int64)
    offsets = np.frombuffer(parts["offsets"], dtype="<u8")
    return header["keys"], counts, unpack(stream, offsets, header["ids"], lengths)


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all of `tokens`: a row per id and task is shuffled, a row per id collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1, dtype=np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind))
            if len(found) > len(seen):
                seen = np.pad(seen, (0, len(found) - len(seen)))
            seen[: len(found)] += found
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_tokens(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes every document's ids to files in the shared folder; returns the manifest (file, first, docs, ids, place).

    Documents are range-partitioned by `key` and sorted, NULL keys first and repeated keys by text, so
    files in order of `place` hold all documents in ascending order. Missing texts are empty ones; their
    only id is `end_id`. A task may run twice: its file has a name of its own, and only files named by the
    manifest count.
    """
    spark = docs.sparkSession
    kind = id_type(path)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = source.repartitionByRange(parts, F.col("key").asc_nulls_first()).sortWithinPartitions(
        F.col("key").asc_nulls_first(), "text"
    )
    encoded = token_table(ordered.withColumn("part", F.spark_partition_id().cast("long")), path, end_id)
    table = work_dir(spark, "token-ids")
    encoded.write.option("compression", "zstd").parquet(table)
    tokens = spark.read.schema(encoded.schema).parquet(table)
    lengths = code_lengths(id_counts(tokens, kind))
    folder = work_dir(spark, "token-files")
    if "://" not in folder:
        folder = f"file://{folder}"
    system, place = _files(folder)
    system.create_dir(place, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_pylist()
            for begin in [0, *[i for i in range(1, len(part)) if part[i] != part[i - 1]]]:
                size = next((i for i in range(begin, len(part)) if part[i] != part[begin]), len(part)) - begin
                some = batch.slice(begin, size)
                rows = [np.frombuffer(x.as_buffer(), dtype=kind) for x in some.column("ids")]
                ids, counts = np.concatenate(rows), np.array([len(x) for x in rows])
                file = f"{folder}/{uuid.uuid4().hex}.tok"
                keys = some.column("key").to_pylist()
                write_file(file, keys, counts, ids, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (file, part[begin], len(keys), len(ids))] + [pa.array([keys[0]], type=some.column("key").type), pa.array([keys[-1]], type=some.column("key").type)],
                    names=["file", "part", "docs", "ids", "first", "last"],
                )

    key_type = source.schema["key"].dataType.simpleString()
    files = written(
        tokens.select("key", "part", "ids").mapInArrow(
            put, f"file string, part long, docs long, ids long, first {key_type}, last {key_type}"
        ),
        "token-manifest",
    )
    # One row per file. Files that share a key follow each other in any order, which is then theirs for good.
    order = Window.orderBy("part", F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "file")
    return files.withColumn("place", F.row_number().over(order)).withColumn("start", F.sum("ids").over(order) - F.col("ids"))


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document in the files; `start` counts the ids of all documents before it."""
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key_type = manifest.schema["first"].dataType.simpleString()

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                keys, counts, ids = read_file(file)
                ends = np.cumsum(counts)
                for at in range(0, len(keys), 4096):
                    some = slice(at, at + 4096)
                    begin = int(ends[at] - counts[at])
                    flat = ids[begin : int(ends[some][-1])].astype("<u4").tobytes()
                    offsets = (np.concatenate([[begin], ends[some]]) - begin) * 4
                    column = pa.Array.from_buffers(pa.binary(), len(keys[some]), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[some], type=key_arrow), pa.array(start + ends[some] - counts[some]), pa.array(counts[some]), column],
                        names=[key, "start", "n_tokens", "ids"],
                    )

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(manifest.schema["first"].dataType)
    return manifest.select("file", "start").repartition(parts, "file").mapInArrow(get, f"`{key}` {key_type}, start long, n_tokens long, ids binary")


def token_digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of `read_tokens`; its ids are little-endian 32-bit numbers, as CRC32 wants them."""
    return tokens.select(key, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
