"""Whole texts to token ids by the tokenizers library, fast on repeated words.

A byte-pair tokenizer treats every piece its splitter yields on its own. Texts are cut only where the
splitters of such tokenizers always cut too, a batch of bytes at a time; every distinct piece is looked up once a batch
and encoded once, and a text's ids are those of its pieces in a row. A text holding a special token's string is encoded whole. A Python worker
keeps its encoder, and the pieces it knows, from task to task of one run; the next run starts with none.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

#: Sure cuts lie between two of these: a letter run, a digit run and a run of signs, each with at most
#: one space before it. Apostrophes, other white space and all other characters stick to both sides.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"
#: What a byte of UTF-8 is part of: 1 a letter, 2 a sign, 3 a digit, 0 all else; letters of two bytes are marked by `cuts`.
KIND = np.array([1 if re.match("[A-Za-z]", chr(i)) else 2 if re.match(f"[{SIGNS}]", chr(i)) else 3 if 0x30 <= i <= 0x39 else 0 for i in range(256)], dtype=np.uint8)


def cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mark at each byte where a piece begins; `ends` are a zero and the ends of the texts that `raw` holds."""
    kind = KIND[raw]
    two = np.flatnonzero(raw == 0xC3)
    two = two[(raw[two + 1] != 0x97) & (raw[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = 1
    run = kind > 0
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = run[1:] & run[:-1] & (kind[1:] != kind[:-1])
    cut[1:-1] |= (raw[1:-1] == 0x20) & run[:-2] & run[2:]
    # A text's last space has no run behind it, and a text begins a piece.
    some = np.flatnonzero(np.diff(ends))
    last = ends[some + 1] - 1
    cut[last[raw[last] == 0x20]] = False
    cut[ends[some]] = True
    return cut


class Numbers(dict):
    """Numbers keys as they come; `new` lists those not yet learnt."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = number = len(self)
        return number


class Encoder:
    """Ids of batches of texts; remembers those of about `most` distinct pieces, some 180 bytes each."""

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.single = re.compile(rf" ?(?:[{LETTERS}]+|[{SIGNS}]+)").fullmatch
        self.prepare = self._prepare()
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.flat = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _prepare(self):
        """What the normalizer and the splitter make of a single run: the string the model gets.

        Going to the model directly saves most of the time of a short piece. Both steps are recorded
        by example: a kept or dropped space, kept or lowered case, and the characters bytes become.
        """
        def made(piece: str) -> str | None:
            normal = self.tokenizer.normalizer
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(piece) if normal else piece)
            return parts[0][0] if len(parts) == 1 else None

        letters = "".join(chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7)) + "ABXYZabxyz"
        examples = [f"{space}{x}" for space in ("", " ") for x in (*letters, "aB", "éÀz", "".join(letters[:20]), "!?", ";", "_#")]
        if self.tokenizer.pre_tokenizer is None:
            return None
        for lower in (False, True):
            for keep in (False, True):
                table = {b: made(chr(b)) for b in range(0x21, 0x7F) if not lower or not 0x41 <= b <= 0x5A}
                for code in range(0xC0, 0x100):
                    for b, c in zip(chr(code).encode(), made(chr(code)) or ""):
                        if not lower or code >= 0xE0:
                            table.setdefault(b, c)
                table[0x20] = (made(" a") or "  ")[0] if keep else ""

                def direct(piece: str, lower: bool = lower, table: dict = table) -> str:
                    return (piece.lower() if lower else piece).encode().decode("latin-1").translate(table)

                if all(direct(x) == made(x) for x in examples):
                    return direct
        return None

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        direct = [p if self.prepare and self.single(p) else None for p in pieces]
        rest = iter(
            self.tokenizer.encode_batch_fast([p for p, d in zip(pieces, direct) if d is None], add_special_tokens=False)
        )
        model = self.tokenizer.model.tokenize
        return [next(rest).ids if d is None else [t.id for t in model(self.prepare(d))] for d in direct]

    def learn(self) -> None:
        found = self.ids_of(self.numbers.new)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        new = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum()))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, new])
        self.numbers.new = []

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.numbers) > self.most:
            self.clear()
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return self.flat[:0], np.zeros(0, dtype=np.int64)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        cut = cuts(raw, ends)
        for special in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)):
                cut[ends[i] + 1 : ends[i + 1]] = False
        begins = np.flatnonzero(cut)
        places = np.append(begins, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(raw)).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        codes = np.fromiter(map(self.numbers.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        codes = codes[pieces.indices.to_numpy()]
        if self.numbers.new:
            self.learn()
        starts, lengths = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(starts - (after - lengths), lengths) + np.arange(total)]
        up_to = np.concatenate([[0], after])[np.searchsorted(begins, ends)]
        return ids, np.diff(up_to)


@lru_cache(maxsize=1)
def encoder_of(path: str, run: str) -> Encoder:
    """The worker's encoder: tasks of one `run` that follow each other in a process share what it has learnt."""
    return Encoder(path)


def by_size(sizes: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of about `most` in sum, in order; a larger value is a run of its own."""
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def id_type(path: str) -> str:
    """The smallest little-endian type that holds the tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, path: str, end_id: int, text: str = "text") -> DataFrame:
    """`docs` with `text` replaced by `ids` (binary, `id_type`), which end with `end_id`.

    A missing text is an empty one: its only id is the end. Rows, order and other columns stay; the
    tokenizer's file must be readable on the executors.
    """
    kind, run = id_type(path), uuid.uuid4().hex
    others = [c for c in docs.columns if c not in (text, "ids")]
    source = docs.select(*[f"`{c}`" for c in others], docs[text].cast("string").alias("ids"))
    schema = StructType([*source.drop("ids").schema.fields, StructField("ids", BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, run)
        for batch in batches:
            texts = batch.column(len(others))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for begin, end in by_size(sizes):
                ids, counts = encoder.encode(pc.fill_null(texts.slice(begin, end - begin), ""))
                stream = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
                offsets = np.concatenate([[0], np.cumsum(counts + 1) * stream.itemsize]).astype(np.int32)
                column = pa.Array.from_buffers(
                    pa.binary(), end - begin, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(stream.tobytes())]
                )
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], column], names=[*others, "ids"])

    return source.mapInArrow(encode, schema)
