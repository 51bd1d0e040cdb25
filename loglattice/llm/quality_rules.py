"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules are cheap or dear and reject few or many. `order_rules` measures both on a sample and puts the
rule with the most rejections per cost first; `cascade` then evaluates a rule only on rows that every
earlier one let pass. The order changes the time, never the verdict: a row is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import BLANK_BYTES, text_or_empty, written

#: Bits of a sort key that hold a window's place in its text; longer texts are sorted by whole windows.
PLACE_BITS = 24


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on the frame's columns; NULL counts as not rejected."""

    name: str
    rejects: Column


def word_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    A missing text measures as an empty one: all zero. Existing columns of these names are replaced.
    Windows of three words are sorted by hash inside the row, so a long text costs n log n and nothing
    is shuffled; equal hashes are checked word by word.
    """
    whole = text_or_empty(text)
    t, words, grams, marks = (f"__{x}" for x in ("text", "words", "grams", "marks"))
    step = docs.withColumn(t, whole)
    blanked = whole
    for blank in BLANK_BYTES[1:]:
        blanked = F.replace(blanked, F.lit(blank), F.lit(" "))
    step = step.withColumn(words, F.filter(F.split(blanked, " "), lambda w: w != ""))
    last = F.size(words) - 3

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))

    # The upper bits of a window's hash with its place below them sort as plain numbers.
    packed = F.slice(
        F.transform(words, lambda w, i: window(w, i).bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))),
        F.lit(1),
        F.greatest(last + 1, F.lit(0)),
    )
    step = step.withColumn(grams, F.sort_array(packed))

    def upper(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    step = step.withColumn(
        marks,
        F.filter(
            grams,
            lambda g, k: (upper(g) == upper(F.get(grams, k - 1))) | (upper(g) == upper(F.get(grams, k + 1))),
        ),
    )

    def differ(i: Column, j: Column) -> Column:
        return (
            (F.get(words, i) != F.get(words, j))
            | (F.get(words, i + 1) != F.get(words, j + 1))
            | (F.get(words, i + 2) != F.get(words, j + 2))
        )

    # Upper bits alone can be equal by chance; such a text is sorted by whole windows instead.
    chance = F.exists(
        F.transform(
            marks,
            lambda g, k: (upper(g) == upper(F.get(marks, k + 1))) & differ(place(g), place(F.get(marks, k + 1))),
        ),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    step = step.withColumn("__chance", chance | (F.size(words) >= 1 << PLACE_BITS))
    exact = F.sort_array(
        F.slice(
            F.transform(
                words,
                lambda w, i: F.struct(
                    w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")
                ),
            ),
            F.lit(1),
            F.greatest(last + 1, F.lit(0)),
        )
    )
    step = step.withColumn("__exact", F.when(F.col("__chance"), exact))

    def same(g: Column, h: Column) -> Column:
        return F.coalesce((g["a"] == h["a"]) & (g["b"] == h["b"]) & (g["c"] == h["c"]), F.lit(False))

    step = step.withColumn(
        "__places",
        F.sort_array(
            F.when(
                F.col("__chance"),
                F.transform(
                    F.filter(
                        "__exact",
                        lambda g, k: same(g, F.get("__exact", k - 1)) | same(g, F.get("__exact", k + 1)),
                    ),
                    lambda g: g["i"],
                ),
            ).otherwise(F.transform(marks, place))
        ),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK_BYTES)) != "")
    step = step.withColumn("__lines", lines)
    covered = F.aggregate(
        F.transform("__places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__places", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", "")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": covered,
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in measures]
    return step.select(*kept, *[v.cast("long").alias(f"{prefix}{k}") for k, v in measures.items()])


def base_failed() -> Column:
    """The fixed base rules: under 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """The rules beyond the base ones; each asks for a clear excess, so plain prose passes."""
    t = text_or_empty(text)
    n = F.col("n_words")
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    marks = F.length(F.regexp_replace(t, "[^!]+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("exclamations", 10 * marks > 3 * n),
        Rule("capitals", 10 * capitals > 5 * F.col("word_chars")),
        Rule("open_lines", (F.col("n_lines") >= 10) & (10 * F.regexp_count(t, F.lit(r"(?:\.\.\.|…)[\x20\x09-\x0D]*(?:\n|\z)")) > 3 * F.col("n_lines"))),
    ]


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per cost, both measured on a written sample.

    Each rule is timed alone over it, against a pass that evaluates no rule. An empty sample leaves
    the order as it is.
    """
    n = sample.count()
    if not n:
        return list(rules)

    def cost(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.sum(F.when(condition, 1).otherwise(0))).first()[0]
        return time.perf_counter() - began, hits

    cost(F.lit(False))
    idle = cost(F.lit(False))[0]
    gain = {}
    for k, rule in enumerate(rules):
        took, hits = cost(rule.rejects)
        gain[k] = (hits + 0.5) / max(took - idle, 1e-4)
    return [rules[k] for k in sorted(gain, key=lambda k: (-gain[k], k))]


def cascade(df: DataFrame, rules: list[Rule], kept: str = "kept") -> DataFrame:
    """Adds `kept`: no rule rejects. CASE evaluates the rules in order and stops at the first hit."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(False)).otherwise(verdict)
    return df.withColumn(kept, verdict)


def quality_rules(
    docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, fraction: float = 0.01, seed: int = 7
) -> DataFrame:
    """`docs` with its measures, base_failed and kept.

    Missing and empty texts have zero words, fail the base and are not kept. Repeated rows are judged
    alike. Columns named as a measure or verdict are replaced; all others stay. No rows give no rows.
    """
    docs = docs.drop("base_failed", "kept")
    rules = default_rules(text) if rules is None else rules
    measured = word_measures(docs, text).withColumn("base_failed", base_failed())
    # Written before it is filtered: a filter pushed below the measures would work them out again inside.
    sample = written(word_measures(docs.sample(fraction=fraction, seed=seed), text), "rule-sample")
    ordered = order_rules(sample.where(~base_failed()), rules)
    return cascade(measured, [Rule("base", F.col("base_failed")), *ordered])
