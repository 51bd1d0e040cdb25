"""Token files and packing against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglattice.llm import packing, token_files
from loglattice.llm.tokens import Encoder, by_size

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    random.seed(2)
    parts = [*"ab1'.,! \n\t\r\x0b\x1c  é×÷ÀΣςé中あ👍<|>s_", "<|endoftext|>", "don't", " I'll", "''s", "  ", " Word", "Überß"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(4000)] + ["", " "]
    encoder, library = Encoder(path, most=500), Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for begin, end in by_size(np.array([len(t) for t in texts]), 20_000):
        ids, counts = encoder.encode(texts[begin:end])
        assert counts.tolist() == [len(w) for w in want[begin:end]]
        assert ids.tolist() == [i for w in want[begin:end] for i in w]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_texts_are_cut_in_arrow_arrays(path):
    """Texts lie next to each other in one buffer: no piece reaches over a text's end, whatever stands at it."""
    random.seed(3)
    ends = ["", " ", "  ", "a", "9", "!", "é", "×", "÷", "ÿ", "'", "\n", "中", " a", "a ", " é", "é ", "\0", " <|endoftext|>"]
    texts = [random.choice(ends) + random.choice(["", "x", "x y", "Ã9Ã", "a1"]) + random.choice(ends) for _ in range(3000)]
    column = pa.array(["before ", *texts, " after"]).slice(1, len(texts))
    ids, counts = Encoder(path).encode(column)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000))
def test_huffman_round_trip(values):
    ids = np.array(values, dtype=np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=41), limit=7)
    assert lengths.max(initial=0) <= 7
    assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    stream, offsets = token_files.pack(ids, token_files.canonical(lengths), lengths)
    assert token_files.unpack(stream, offsets, len(ids), lengths).tolist() == values


def test_code_lengths_are_optimal():
    """Against plain Huffman costs where the limit does not bind, and the best of all for a tight one."""
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0, 21])
    heap, cost = sorted(int(c) for c in counts if c), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((token_files.code_lengths(counts, 20) * counts).sum()) == cost
    assert token_files.code_lengths(np.ones(8, dtype=int), 3).tolist() == [3] * 8
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, dtype=int), 3)


def test_blocks_and_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 1024)
    ids = np.random.default_rng(3).integers(0, 900, 5000)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=900))
    stream, offsets = token_files.pack(ids, token_files.canonical(lengths), lengths)
    assert token_files.unpack(stream, offsets, len(ids), lengths).tolist() == ids.tolist()
    # A block is decoded on its own from its offset.
    assert token_files.unpack(stream, offsets[3:4], 512, lengths).tolist() == ids[1536:2048].tolist()


def test_files_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumn("ids", F.lit("clash")).withColumn("part", F.lit("clash"))
    got = token_files.token_digests(token_files.read_tokens(token_files.write_tokens(docs, BYTES, 0))).toPandas()
    library, at = Tokenizer.from_file(BYTES), 0
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    found = [(None if np.isnan(k) else int(k), *map(int, rest)) for k, *rest in got.itertuples(index=False)]
    assert sorted(found, key=lambda r: r[1]) == want
    assert token_files.read_tokens(token_files.write_tokens(no_docs, BYTES, 0)).count() == 0


def check_packing(pieces, rows, library, window=2048):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["uid"], []).append(p)
    texts = sorted((key, *library.encode(text or "", add_special_tokens=False).ids, 1) if key is not None else (-1, *library.encode(text or "", add_special_tokens=False).ids, 1) for key, text in rows)
    seen = []
    candidates = {}
    for t in texts:
        candidates.setdefault((t[0], len(t) - 1), []).append(t)
    for parts in by_doc.values():
        parts.sort(key=lambda p: p["start"])
        key = -1 if parts[0]["doc_id"] is None else parts[0]["doc_id"]
        assert [p["start"] for p in parts] == np.concatenate([[0], np.cumsum([p["length"] for p in parts])[:-1]]).tolist()
        total = sum(p["length"] for p in parts)
        assert all(p["doc_tokens"] == total for p in parts)
        ids = next(t[1:] for t in candidates[key, total] if all(crc(t[1:][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for p in parts))
        seen.append((key, *ids))
    assert sorted(seen) == texts
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding, sum(p["length"] for p in pieces)


def test_packing_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumn("uid", F.lit("clash")).withColumn("rest", F.lit("clash"))
    pieces, tokens = packing.pack_tokens(docs, WORDS, 1)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = pieces.collect()
    check_packing(got, rows, Tokenizer.from_file(WORDS))
    whole = packing.sequences_of(pieces, tokens, WORDS).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(p["length"] for p in got)
    assert packing.pack_tokens(no_docs, WORDS, 1)[0].count() == 0


def test_packing_pads_little(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces, _ = packing.pack_tokens(docs, WORDS, 1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    padding, total = check_packing(pieces.collect(), rows, Tokenizer.from_file(WORDS))
    assert padding < 0.03 * total


def test_least_squares():
    rng = np.random.default_rng(4)
    a = rng.random((12, 30))
    x = packing.non_negative_least_squares(a, a @ np.maximum(rng.standard_normal(30), 0))
    gradient = a.T @ (a @ x - a @ np.zeros(30))
    assert (x >= 0).all() and np.isfinite(gradient).all()
    counts = rng.integers(0, 500, packing.CLASSES)
    used = np.zeros(packing.CLASSES, dtype=int)
    for combo, times in packing.plan(counts):
        assert times > 0 and sum(c + 1 for c in combo) == packing.CLASSES
        for c in combo:
            used[c] += times
    assert (used <= counts).all()
    assert packing.plan(np.zeros(packing.CLASSES, dtype=int)) == []
