"""Text expressions, all inside the JVM.

Patterns come from rules written for Unicode-aware engines. Java's `\\w`, `\\d`,
`\\s` and `\\b` are ASCII by default, so every pattern gets `(?U)`; `(?d)` makes
`\\n` the only line end.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import SPACES

EXACT = "(?U)"
ANY_CASE = "(?iU)"


def literal_replacement(text: str) -> str:
    """Escape `\\` and `$`, which Java gives a meaning in replacements."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_all(text: Column, pattern: str, replacement: str, flags: str = EXACT) -> Column:
    return F.regexp_replace(text, flags + pattern, literal_replacement(replacement))


def apply_rules(
    text: Column, rules: Iterable[tuple[str, str]], flags: str = ANY_CASE
) -> Column:
    """Apply (pattern, replacement) rules one after the other."""
    for pattern, replacement in rules:
        text = replace_all(text, pattern, replacement, flags)
    return text


def any_of(patterns: Sequence[str], starts: str = "", flags: str = ANY_CASE) -> str:
    """One pattern that matches where any of the given ones does.

    `starts` names the characters a match can begin with (lower case will do
    where case is ignored), and a word border that all patterns begin with is
    tested once. Both let the engine skip most positions instead of trying
    every alternative there.
    """
    border = r"\b" if all(p.startswith(r"\b") for p in patterns) else ""
    ahead = f"(?=[{starts}])" if starts else ""
    choices = "|".join(f"(?:{p.removeprefix(border)})" for p in patterns)
    return f"{flags}{border}{ahead}(?:{choices})"


def word_initials(patterns: Sequence[str]) -> str:
    """The initials of patterns that begin with a plain letter after `\\b`; empty
    if one does not."""
    heads = [p.removeprefix(r"\b")[:1] for p in patterns]
    return "".join(sorted({h.lower() for h in heads})) if all(map(str.isalpha, heads)) else ""


def matches(text: Column, pattern: str, flags: str = EXACT) -> Column:
    return F.regexp_like(text, F.lit(flags + pattern))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text holds any of the (lower-case) words."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return found


def strip(text: Column) -> Column:
    """Cut white space, Unicode included, from both ends."""
    return F.btrim(text, F.lit(SPACES))


def truncated(text: Column, limit: int, tail: str = "...") -> Column:
    """The text, or its first characters and a tail that fit in `limit`."""
    cut = F.concat(F.substring(text, 1, limit - len(tail)), F.lit(tail))
    return F.when(F.length(text) > limit, cut).otherwise(text)
