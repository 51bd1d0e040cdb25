"""Thousands of patterns over lines of text, by an index of what each pattern cannot do without.

Nearly every pattern holds a run of plain characters that any match must contain. Three of them in a row are its
key; a line's own runs of three are joined with the keys, and only the pairs that meet are tried with the
whole pattern. The plan is the same for ten patterns and for ten thousand. Patterns without such a run are tried on every line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import exploded
from ..functions.text import ANY_CASE
from .documents import read_patterns, scanned_lines

GRAM = 3
#: Escapes that stand for no certain character and take no argument.
CLASSES = set("bBdDsSwWAzZ")
#: The only characters outside ASCII that match an ASCII letter where case is ignored, and those letters.
FOLDED, ASCII_LETTERS = "İıſK", "iisk"


def required_runs(pattern: str) -> list[str]:
    """Runs of plain ASCII characters, in lower case, that every match of a pattern contains.

    Only what lies outside groups, classes and alternatives counts, without what may be left out. Of a
    pattern with anything unusual in it none is given, so that it is tried in full.
    """
    runs, run, i, n = [], "", 0, len(pattern)

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < n:
        c = pattern[i]
        if c == "|":
            return []
        if c == "\\":
            c = pattern[i + 1 : i + 2]
            i += 2
            if c in CLASSES:
                end()
                continue
            if not c or c.isalnum() or not c.isascii():
                return []
        elif c in "([":
            i = _closing(pattern, i)
            if i < 0:
                return []
            end()
            continue
        elif c in "?*{":
            # What stands before it may be left out.
            run = run[:-1]
            end()
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if not i:
                return []
            continue
        else:
            i += 1
            if c in ".^$+" or not c.isascii() or not c.isprintable():
                end()
                continue
        run += c.lower()
    end()
    return [r for r in runs if len(r) >= GRAM]


def _closing(pattern: str, at: int) -> int:
    """The place after a group or class, or -1 for one with flags, conditions or no end."""
    if pattern.startswith("(?", at) and not pattern.startswith("(?:", at):
        return -1
    opened: list[str] = []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] in ("Q", "E"):
                return -1
            at += 1
        elif c == "[":
            opened.append(c)
            if pattern[at + 1 : at + 2] in ("]", "^"):
                return -1
        elif opened and opened[-1] == "[":
            if c == "]":
                opened.pop()
        elif c == "(":
            if pattern.startswith("(?", at) and not pattern.startswith("(?:", at):
                return -1
            opened.append(c)
        elif c == ")":
            opened.pop()
        at += 1
        if not opened:
            return at
    return -1


def pattern_keys(patterns: Sequence[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """((key, pattern) of patterns that have one, the other patterns).

    Of all three-character runs a pattern must contain, the one fewest other patterns share is its key.
    """
    grams = [{r[i : i + GRAM] for r in required_runs(p) for i in range(len(r) - GRAM + 1)} for p in patterns]
    shared = Counter(g for of_pattern in grams for g in of_pattern)
    keyed = [(min(g, key=lambda x: (shared[x], x)), p) for p, g in zip(patterns, grams) if g]
    return keyed, [p for p, g in zip(patterns, grams) if not g]


def line_grams(line: Column) -> Column:
    """The distinct runs of three ASCII characters of a line, case apart."""
    folded = F.lower(F.translate(line, FOLDED, ASCII_LETTERS))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"(?=([ -~]{{{GRAM}}}))"), F.lit(1)))


def pattern_hits(lines: DataFrame, patterns: Iterable[str], line: str = "line") -> DataFrame:
    """Every (line, pattern) hit, ignoring case: the columns of `lines` and `pattern`.

    Keys are joined as a table. While it is small every task holds it, and no line is moved.
    """
    patterns = list(patterns)
    keyed, others = pattern_keys(patterns)
    columns = list(lines.columns)
    found = lines.where(F.lit(False)).withColumn("pattern", F.lit("").cast("string"))
    if keyed:
        keys = lines.sparkSession.createDataFrame(keyed, "_gram string, pattern string")
        marked = exploded(lines.withColumn("_grams", line_grams(F.col(line))), columns, "_grams", "_", "_gram").drop("_")
        met = marked.join(keys, "_gram").where(F.regexp_like(line, F.concat(F.lit(ANY_CASE), "pattern")))
        found = met.select(*columns, "pattern")
    if others:
        tried = F.filter(F.array(*[F.lit(p) for p in others]), lambda p: F.regexp_like(line, F.concat(F.lit(ANY_CASE), p)))
        rest = exploded(lines.withColumn("_hits", tried), columns, "_hits", "_", "pattern").drop("_")
        found = found.unionByName(rest) if keyed else rest
    return found


def denylist_scan_indexed(files: DataFrame, patterns: Iterable[str], **which) -> DataFrame:
    """As `documents.denylist_scan`, for any number of patterns."""
    return pattern_hits(scanned_lines(files, **which), read_patterns(patterns))
