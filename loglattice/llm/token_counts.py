"""Token counts of whole texts by heap-driven byte-pair merging, without ids.

A piece of text starts as its characters in a linked list. Every mergeable neighbour pair waits in a heap by
(rank, place); the lowest is popped, its pair joined and the pairs it forms with its neighbours pushed, until
nothing is left. A piece has as many tokens as it had symbols, less the merges. Ids never appear: a symbol is
its string, and a merged one the two strings in a row.

Every task merges a distinct piece once, so the cost of a text is that of looking its words up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Longer words are counted each time they occur, so that what a task remembers stays bounded.
LONG = 200


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int], made: list[str]) -> int:
    """How many symbols are left once no neighbours can be merged; of equal ranks the leftmost goes first.

    `ranks` has the rank of every mergeable pair, `made` what the pair of a rank becomes. A heap entry is
    rank * n + place, so whole numbers order it.
    """
    n = left = len(symbols)
    rank_of = ranks.get
    heap = [rank * n + i for i, rank in enumerate(map(rank_of, zip(symbols, symbols[1:]))) if rank is not None]
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i = divmod(heappop(heap), n)
        j = after[i]
        # What waits may be out of date: a side has gone, or grown since.
        if j == n or not symbols[i]:
            continue
        pair = symbols[i], symbols[j]
        whole = made[rank]
        if pair[0] + pair[1] != whole or pair not in ranks:
            continue
        symbols[i], symbols[j] = whole, ""
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of((whole, symbols[k]))
            if rank is not None:
                heappush(heap, rank * n + i)
        h = before[i]
        if h >= 0:
            rank = rank_of((symbols[h], whole))
            if rank is not None:
                heappush(heap, rank * n + h)
    return left


class Counter(dict):
    """Tokens by word (UTF-8 bytes without blanks); works out what it has not seen, remembers about `most` words.

    Made for byte-pair tokenizer files whose splitter drops white space, so that a text has the tokens of its
    words. The file's own normalizer and splitter make the pieces; words of printable ASCII and Latin-1 letters
    go by the splitter's pattern, read from the file, where that gives the same on the words it is tried on.
    """

    LETTERS = "ß-öø-ÿ"
    TRIED = ["Straße", "ÀÉÎÕÜ", "l'été,", "ñ1ö-ÿ", "word", "Don't", "he'll,", "'s", "x1y22", "(a-b)", "''ve", "U.S.", "--", "3,000.5%", "it'Re", "a_b", "<|x|>", "`~!@#$^&*+=[]{};:/?"]

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.library = file["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-pair model")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.made = [a + b for a, b in pairs]
        self.known, self.end, self.most = model["vocab"].keys(), model.get("end_of_word_suffix") or "", most
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        if self.pieces("a b\n c") != [*self.pieces("a"), *self.pieces("b"), *self.pieces("c")]:
            raise ValueError(f"the splitter of {path} keeps white space")
        self.lengths: dict[str, int] = {}
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.fast = self._fast(file)

    def _fast(self, file: dict):
        """Pieces of a plain word in lower case by the splitter's pattern, or None if the file has another kind."""
        parts = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or kinds != ["NFC", "Replace", "Lowercase"]:
            return None
        pattern = parts[0]["pattern"]["Regex"].replace(r"\p{L}", "a-z" + self.LETTERS).replace(r"\p{N}", "0-9")
        found = re.compile(pattern).findall
        letters = re.findall(f"[{self.LETTERS}]", "".join(map(chr, range(256))))
        bytes_of = str.maketrans({c: self.pieces(c)[0] for c in letters})

        def fast(word: str) -> list[str]:
            pieces = found(word)
            return pieces if word.isascii() else [p.translate(bytes_of) for p in pieces]

        return fast if all(fast(x.lower()) == self.pieces(x) for x in self.TRIED) else None

    def pieces(self, text: str) -> list[str]:
        normal = self.library.normalizer
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)]

    def length(self, piece: str) -> int:
        n = self.lengths.get(piece)
        if n is None:
            symbols = [s for s in [*piece[:-1], piece[-1] + self.end] if s in self.known]
            n = merged_length(symbols, self.ranks, self.made)
            if len(piece) <= LONG:
                self.lengths[piece] = n
        return n

    def __missing__(self, word: bytes) -> int:
        text, n = word.decode(), 0
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:  # a special token's string is one token, wherever it stands
                n += 1
            elif part:
                pieces = self.fast(part.lower()) if self.fast and self.plain(part) else self.pieces(part)
                for piece in pieces:
                    n += self.length(piece)
        if len(word) <= LONG:
            self[word] = n
        return n

    def count(self, text: bytes, at_once: int = 1 << 22) -> int:
        """Tokens of a whole text; of a long one about `at_once` bytes are split at a time, at a blank."""
        if len(self) > self.most or len(self.lengths) > self.most:
            self.clear()
            self.lengths.clear()
        if len(text) <= at_once:
            return sum(map(self.__getitem__, text.split()))
        n, begin, blank = 0, 0, re.compile(rb"[\x20\x09-\x0D]")
        while begin < len(text):
            found = blank.search(text, begin + at_once)
            end = found.start() if found else len(text)
            n += sum(map(self.__getitem__, text[begin:end].split()))
            begin = end
        return n


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of `docs`, by the tokenizer file at `path`.

    Counts are the library's without begin, end or padding; a special token's string in a text counts as that
    token. A NULL text is an empty one: no bytes, no tokens. Repeated rows and NULL keys have a row each; other
    columns are left out, so none can clash. No rows give no rows. Nothing is shuffled. A task remembers the
    counts of a bounded number of words; a single piece without any border needs some 300 times its own size.
    """
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("raw"))
    schema = StructType([rows.schema["key"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            texts = batch.column(1)
            # One text at a time leaves Arrow's memory, so a batch is never held twice.
            sizes, counts = [], []
            for raw in texts:
                raw = raw.as_py()
                sizes.append(len(raw))
                counts.append(counter.count(raw))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, schema)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
