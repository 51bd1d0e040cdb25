"""Quality by compression: what a dictionary of good text packs better than one of bad text is good.

Two zstandard dictionaries are trained on labelled text. A whole text is compressed with either, piece by piece so that
the dictionary counts all along; the difference of the sizes, per byte, is calibrated to a
probability by a logistic curve on labelled rows that trained no dictionary. The curve also takes the
smaller of the two sizes per byte, as a difference means less where text repeats itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.labelled import fold, labelled_sample, logistic, probability

#: Bytes compressed at a time.
PIECE = 2048
#: Labelled rows used at most, and training pieces per class; the bounds of the fit.
SAMPLE_ROWS = 20_000
TRAIN_PIECES = 4_000
DICTIONARY_BYTES = 65_536
LEVEL = 3


class Compressors:
    """Compressed-size differences under a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.pair = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            for d in (good, bad)
        ]

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """Of the whole text, per byte: size under bad less size under good, the smaller size, and its logarithm."""
        raw = (text or "").encode()
        if not raw:
            return 0.0, 1.0, 0.0
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        least = min(good, bad) / len(raw)
        return (bad - good) / len(raw), least, math.log(least)


def trained(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces; too few to train one are a dictionary as they stand."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b" " * 8


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> tuple[bytes, bytes, np.ndarray]:
    """The good and the bad dictionary and the curve, from a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, label, SAMPLE_ROWS, key, text)
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")))
    pieces = (
        sample.where("fold <> 4")
        .select("y", "text", piece.alias("k"))
        .select("y", F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    )
    totals = {r["y"]: r["n"] for r in pieces.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for y, n in totals.items():
        share = F.when(F.col("y") == y, int((1 << 20) * min(1.0, TRAIN_PIECES / n))).otherwise(share)
    # Pieces are drawn by hash, so the draw does not depend on the order of rows; equal pieces count once.
    drawn = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) < share).distinct().orderBy("y", "piece").toPandas()
    good, bad = (trained([p.encode() for p in drawn["piece"][drawn["y"] == y]]) for y in (1, 0))
    rest = sample.where("fold = 4").select("y", _measured(good, bad)("text").alias("x")).toPandas()
    return good, bad, logistic(_matrix(rest["x"]), rest["y"].to_numpy())


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.to_list(), dtype=np.float64).reshape(-1, 3)


def _measured(good: bytes, bad: bytes):
    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = Compressors(good, bad)
        for texts in batches:
            yield pd.Series([compressors.measures(t) for t in texts])

    return measured


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", cut: float = 0.3
) -> DataFrame:
    """`docs` with held_out, score (0 to 1, higher is likelier good) and predicted (score >= cut).

    Only the text is scored. Missing and empty texts have no difference and get the curve's value there.
    Repeated rows score alike. Other columns stay; those of the added names are replaced. No labelled rows
    give 0.5 to all; no rows give no rows.
    """
    good, bad, curve = fit(docs, labels, label, key, text)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = Compressors(good, bad)
        for texts in batches:
            x = _matrix(pd.Series([compressors.measures(t) for t in texts]))
            yield pd.Series(probability(x, curve), dtype="float64")

    return (
        docs.select(*[f"`{c}`" for c in kept], (fold(key) == 0).alias("held_out"))
        .withColumn("score", score(F.col(text).cast("string")))
        .withColumn("predicted", (F.col("score") >= cut).cast("int"))
    )
