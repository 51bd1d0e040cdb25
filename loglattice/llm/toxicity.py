"""Toxicity of text whose words may be disguised, as a noisy channel.

What a writer meant is restored first: signs that stand for letters, letters spaced out, letters repeated. Every
disguised token is a lattice of letters, and the Viterbi path under a character model of the whole corpus
and a channel model of the disguises is its restored word. Then the words of a text, restored ones
included, are scored by what labelled texts say about them and their beginnings.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.labelled import fold, labelled_sample, logistic, probability

#: Labelled rows the lexicon and its curve are fitted on at most.
SAMPLE_ROWS = 20_000
#: Letters of the character model: 0 is a word's border, 1 to 26 are a to z, accents taken off.
ORDER, BASE = 4, 27
#: What a sign may stand for (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
#: Costs of the channel, as negative log probabilities: a sign for a letter, a sign that means nothing,
#: and a repeated letter written again.
SIGN, NOISE, AGAIN = 1.0, 7.0, 0.3
#: Cost of a letter that is none of the character model's.
OTHER = math.log(BASE)


def _ranges() -> str:
    """All letters and the marks on them, for a character class; beyond the basic plane whole blocks of scripts."""
    on = [unicodedata.category(chr(i))[0] in "LM" and not 0xFE00 <= i <= 0xFE0F for i in range(0x10000)] + [False]
    edges = [i for i in range(0x10001) if on[i] != (i > 0 and on[i - 1])]
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2], edges[1::2])) + "\U00010000-\U0001bfff\U0001e000-\U0001e9ff\U00020000-\U0003ffff"


LETTER = _ranges()
#: Scripts that set no blanks between words (Thai to Khmer, kana, Han); any one to four letters of them are a word.
UNCUT = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
EDGE = "".join(c for c in STANDS_FOR if not c.isdigit())
INNER = "".join(re.escape(c) for c in STANDS_FOR)
MARKS = "".join(re.escape(c) for c in EDGE)
WORD = re.compile(rf"[{LETTER}]+")
#: Letters and signs without a gap. One with a sign is disguised if it is more than a number.
CHUNK = re.compile(rf"[{LETTER}{INNER}]+")
SIGN_IN = re.compile(rf"[{INNER}]")
NO_NUMBER = re.compile(r"[^0-9]")
#: Signs that are punctuation as well, so that words may meet at them.
MEETING = re.compile(r"[!|*(+]+")
#: A letter or digit alone among what is no letter, with or without signs around it; and three such or more in a row.
ALONE = rf"(?=[0-9{LETTER}{INNER}])[{MARKS}]*+[013-9{LETTER}]?+[{MARKS}]*+(?![0-9{LETTER}{INNER}])"
SPACED = re.compile(rf"(?<![0-9{LETTER}{INNER}]){ALONE}(?:[^0-9{LETTER}{INNER}]++{ALONE}){{2,}}")
GAP = re.compile(rf"[^0-9{LETTER}{INNER}]+")
#: Letters a word in a spaced run may have: lengths that are told from their beginnings, and any other.
PARTS = (4, 5, 6, 24)
REPEATED = re.compile(r"(.)\1")
#: A chunk without any of these is one word and no other.
ODD = re.compile(rf"[{INNER}]|(.)\1|{UNCUT.pattern}")
#: A character repeated more often says no more than three of it do, as each but the first may be written again.
LONG = re.compile(r"(.)\1{3,}")


@lru_cache(maxsize=None)
def code(c: str) -> int:
    """Number of a Latin letter, accents and strokes taken off; 0 for all else."""
    base = unicodedata.normalize("NFKD", c.lower())[0]
    if not "a" <= base <= "z":
        named = re.match(r"LATIN SMALL LETTER (?:SHARP )?([A-Z])(?: WITH .*)?$", unicodedata.name(base, ""))
        base = named.group(1).lower() if named else ""
    return ord(base) - 96 if base else 0


def _letters() -> np.ndarray:
    """Code of each Latin-1 character."""
    return np.array([code(chr(i)) for i in range(256)], dtype=np.int64)


def _latin(error: UnicodeEncodeError) -> tuple[str, int]:
    """Letters beyond Latin-1 by the letter they are made from."""
    return "".join(chr(96 + k) if (k := code(c)) else "?" for c in error.object[error.start : error.end]), error.end


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each run of `ORDER` characters occurs in all texts: a row per run is collected, bounded by the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = _letters(), np.zeros(BASE**ORDER, dtype=np.int64)
        codecs.register_error("toxicity-latin", _latin)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                raw = [b"   " + (t.as_py() or "").encode("latin-1", "toxicity-latin") + b" " for t in batch.column(0).slice(begin, 500)]
                at = codes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
                runs = ((at[:-3] * BASE + at[1:-2]) * BASE + at[2:-1]) * BASE + at[3:]
                # A run that ends in the border before a text lies in two texts.
                starts = np.cumsum([len(x) for x in raw])[:-1]
                inside = np.ones(len(runs), dtype=bool)
                inside[(starts[:, None] - [1, 2, 3]).ravel()] = False
                seen += np.bincount(runs[inside], minlength=len(seen))
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(seen[on])], names=["run", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BASE**ORDER, dtype=np.float64)
    counts[rows["run"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return counts


def costs(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log P(letter | three before), each order smoothed by the next lower one."""
    table = counts.reshape((BASE,) * ORDER)
    chance = np.full(BASE, 1 / BASE)
    for k in range(ORDER - 1, -1, -1):
        seen = table.sum(axis=tuple(range(k))) if k else table
        total = seen.sum(axis=-1, keepdims=True)
        chance = (seen + weight * chance) / (total + weight)
    return (-np.log(chance)).reshape(-1, BASE).astype(np.float32)


def readings(chunk: str) -> set[str]:
    """The chunk as it stands, without the punctuation at either end or both, and cut where words may meet; what has a sign of these."""
    left, right = chunk.lstrip(EDGE), chunk.rstrip(EDGE)
    return {t for t in (chunk, left, right, left.rstrip(EDGE), *MEETING.split(chunk)) if len(t) > 1 and SIGN_IN.search(t) and NO_NUMBER.search(t)}


def joined(run: str) -> set[str]:
    """Letters of a spaced run, its gaps left out; where a sign lies between all letters, it is a gap too."""
    whole = GAP.sub("", run)
    found = {whole}
    for c in set(whole).intersection(EDGE):
        parts = [p for p in whole.split(c) if p]
        if len(parts) > 2 and all(len(p) == 1 for p in parts):
            found.add("".join(parts))
    return {t for t in found if NO_NUMBER.search(t)}


class Restorer:
    """Restored words of disguised tokens; remembers those it has seen."""

    def __init__(self, table: np.ndarray, most: int = 200_000):
        # A list of numbers: the lattice looks up one at a time.
        self.table = table.ravel().tolist()
        self.known: dict[str, str] = {}
        self.most = most

    def word(self, token: str, spaced: bool = False) -> str:
        """The restored word; of a `spaced` token words, with a blank between them."""
        token = LONG.sub(r"\1\1\1", token)
        key = " " + token if spaced else token
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = self._decode(token, spaced)
        return self.known[key]

    def _decode(self, token: str, spaced: bool) -> str:
        # States are the three letters before; a path carries its cost, and its letters as a chain from the last one.
        table, cap = self.table, BASE ** (ORDER - 1)
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        before = ""
        for c in token:
            if spaced:
                # A word may end before any letter.
                for state, (cost, said) in list(paths.items()):
                    if state % BASE:
                        after, total = state * BASE % cap, cost + table[state * BASE]
                        if after not in paths or total < paths[after][0]:
                            paths[after] = (total, (said, " "))
            options = [(x, SIGN, code(x)) for x in STANDS_FOR[c]] if c in STANDS_FOR else [(c, 0.0, code(c))]
            skip = AGAIN if c == before else NOISE if c in STANDS_FOR else None
            found: dict[int, tuple[float, tuple]] = {}
            for state, (cost, said) in paths.items():
                row = state * BASE
                for x, p, k in options:
                    after, total = (row + k) % cap, cost + (p + (table[row + k] if k else OTHER))
                    if after not in found or total < found[after][0]:
                        found[after] = (total, (said, x))
                if skip is not None and (state not in found or cost + skip < found[state][0]):
                    found[state] = (cost + skip, said)
            paths, before = found, c
        if not paths:
            return ""
        best = min((cost + table[state * BASE], state) for state, (cost, _) in paths.items())[1]
        chain, letters = paths[best][1], []
        while chain:
            chain, x = chain
            letters.append(x)
        return "".join(reversed(letters))

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the whole text, and what its disguised tokens restore to."""
        chunks, runs = parts(text)
        return set().union(*map(self.words_of, chunks), *map(self.words_of_run, runs))

    def words_of(self, chunk: str) -> set[str]:
        """The words of a chunk, as it stands and restored; they depend on nothing around it."""
        if not ODD.search(chunk):
            return {chunk}
        if not SIGN_IN.search(chunk):
            return self._restored({chunk}, set(), set())
        return self._restored(set(WORD.findall(chunk)), readings(chunk), joined(chunk) - {chunk})

    def words_of_run(self, run: str) -> set[str]:
        return self._restored(set(), set(), joined(run))

    def _restored(self, out: set[str], tokens: set[str], spaced: set[str]) -> set[str]:
        tokens.update(w for w in out if REPEATED.search(w))
        out.update(self.word(t) for t in tokens)
        for t in spaced:
            one, several = self.word(t), self.word(t, spaced=True)
            out.update([one, *several.split()])
            # Borders the character model does not see: a word may begin at any letter of the run.
            for run in {one, several.replace(" ", "")}:
                out.update(run[i : i + n] for i in range(len(run) - 3) for n in PARTS)
        runs = {run for w in out for run in UNCUT.findall(w)}
        out.update(run[i : i + n] for run in runs for i in range(len(run)) for n in (1, 2, 3, 4))
        out.discard("")
        return out


def parts(text: str | None) -> tuple[set[str], set[str]]:
    """The distinct chunks and spaced runs of the whole text."""
    low = unicodedata.normalize("NFC", (text or "").lower())
    return set(CHUNK.findall(low)), {m.group() for m in SPACED.finditer(low)}


def features(word: str) -> list[str]:
    """The word as a whole, and its beginnings of four to six letters."""
    return [f"{word}$"] + [word[:n] for n in (4, 5, 6) if len(word) > n]


def lexicon(sample: DataFrame, table: np.ndarray, least: int = 5) -> dict[str, float]:
    """Log odds of the features that at least `least` toxic texts hold and most holders of which are toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(table), (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                seen[y].update({f for w in restorer.words(t.as_py()) for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)], names=["feature", "clean", "toxic"]
        )

    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = (
        sample.select("text", "y")
        .mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= least) & (F.col("toxic") > F.col("clean")))
        .collect()
    )
    a, b = size.get(1, 0) + 1, size.get(0, 0) + 1
    return {r["feature"]: math.log((r["toxic"] + 0.5) / a) - math.log((r["clean"] + 0.5) / b) for r in rows}


class Known(dict):
    """What `make` gives for a key, kept; it starts anew after `most` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> dict[str, float]:
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Scorer:
    """Numbers of a text: its strongest feature, and how many words have one.

    Weighted words are remembered per chunk and spaced run, as these repeat from text to text and mostly have none.
    """

    def __init__(self, table: np.ndarray, weights: dict[str, float]):
        self.restorer, self.weights, self.none = Restorer(table), weights, {}
        self.chunks = Known(lambda chunk: self.weighted(self.restorer.words_of(chunk)), 500_000)
        self.runs = Known(lambda run: self.weighted(self.restorer.words_of_run(run)), 20_000)

    def weight(self, word: str) -> float:
        return max([self.weights.get(f, 0.0) for f in features(word)])

    def weighted(self, words: set[str]) -> dict[str, float]:
        return {w: x for w in words if (x := self.weight(w))} or self.none

    def numbers(self, text: str | None) -> tuple[float, float]:
        chunks, runs = parts(text)
        found: dict[str, float] = {}
        for some in (*filter(None, map(self.chunks.__getitem__, chunks)), *filter(None, map(self.runs.__getitem__, runs))):
            found.update(some)
        return max(found.values(), default=0.0), math.log1p(len(found))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", cut: float = 0.5
) -> DataFrame:
    """`docs` with held_out, score (0 to 1, higher is likelier toxic) and predicted (score >= cut).

    Only the text is scored; the character model counts all texts. Missing and empty texts have no words and
    get the curve's value there. Repeated rows score alike. Other columns stay; those of the added names are
    replaced. No labelled rows give 0.5 to all; no rows give no rows.
    """
    table = costs(character_counts(docs, text))
    sample = labelled_sample(docs, labels, label, SAMPLE_ROWS, key, text)
    weights = lexicon(sample.where("fold <> 4"), table)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table, weights)
        for batch in batches:
            x = [scorer.numbers(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(c, pa.float64()) for c in (list(zip(*x)) or [[], []]))], names=["y", "a", "b"])

    rest = sample.where("fold = 4").select("y", "text").mapInArrow(numbers, "y int, a double, b double").toPandas()
    curve = logistic(rest[["a", "b"]].to_numpy(), rest["y"].to_numpy())
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(table, weights)
        for texts in batches:
            x = np.array([scorer.numbers(t) for t in texts], dtype=np.float64).reshape(-1, 2)
            yield pd.Series(probability(x, curve), dtype="float64")

    return (
        docs.select(*[f"`{c}`" for c in kept], (fold(key) == 0).alias("held_out"))
        .withColumn("score", score(F.col(text).cast("string")))
        .withColumn("predicted", (F.col("score") >= cut).cast("int"))
    )
