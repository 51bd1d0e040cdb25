"""Preparing documents: chunks, tags, anonymising and deny lists.

All row-wise: no document ever leaves its row, so nothing here shuffles. Rules cost milliseconds a document:
where documents come in few files, `dealt` spreads them over all cores first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.arrays import exploded
from ..functions.text import (
    ANY_CASE, EXACT, any_of, apply_rules, matches, replace_all, strip, word_initials,
)

Rules = Iterable[tuple[str, str]]


def dealt(docs: DataFrame) -> DataFrame:
    """Rows dealt round robin into the shuffle partitions, whatever files they came in.

    For text rules over few files; a corpus in as many files as there are cores does without.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def line_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole lines as spans of the text.

    A chunk is always one span: it grows line by line, and the next one starts
    `overlap` characters before the end of the last. So only two offsets move
    and the text is sliced once per chunk.
    """
    body = text + "\n"
    spans, start, end = [], 0, 0
    for line_end in accumulate(len(line) + 1 for line in text.split("\n")):
        if start < end and line_end - start > size:
            spans.append((start, end))
            start = max(start, end - overlap)
        end = line_end
    chunks = [body[a:b].strip() for a, b in spans]
    rest = body[start:end].strip()
    return chunks + [rest] if rest else chunks


def chunk_lines(
    docs: DataFrame, size: int = 500, overlap: int = 50, text: str = "text"
) -> DataFrame:
    """Overlapping chunks of whole lines; a line is never cut."""

    @F.pandas_udf("array<string>")
    def split_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else line_chunks(t, size, overlap))

    keep = [c for c in docs.columns if c != text]
    split = docs.withColumn("_chunks", split_texts(text))
    return exploded(split, keep, "_chunks", "chunk_index", "text")


def chunk_words(
    docs: DataFrame, size: int = 500, overlap: int = 50, text: str = "text"
) -> DataFrame:
    """Overlapping chunks of about `size` tokens, at 0.75 words a token."""
    length, shared = int(size * 0.75), int(overlap * 0.75)
    stride = length - shared
    spaced = F.regexp_replace(strip(F.col(text)), f"{fv.SPACE_CLASS}+", " ")
    # One pass cuts the text into runs of `stride` words; a chunk is its run and
    # the first `shared` words of what follows. Arrays of words would be copied
    # whole for every slice.
    runs = F.col("_runs")
    following = math.ceil(shared / stride)
    chunks = F.transform(
        runs,
        lambda run, i: F.btrim(
            F.concat(
                run,
                F.regexp_extract(
                    F.array_join(F.slice(runs, i + 2, F.lit(following)), ""),
                    _first_words(shared), 0,
                ),
            )
        ),
    )
    keep = [c for c in docs.columns if c != text]
    chunked = docs.withColumn(
        "_runs", F.regexp_extract_all(spaced, F.lit(_first_words(stride)), F.lit(0))
    ).select(*keep, chunks.alias("_chunks"))
    total = F.size("_chunks").alias("total_chunks")
    return exploded(chunked, [*keep, total], "_chunks", "chunk_index", "text")


def _first_words(n: int) -> str:
    """Up to n words of a text whose words are one space apart."""
    return rf"(?:[^ ]++ ?+){{{min(n, 1)},{n}}}+"


def tag_documents(
    files: DataFrame,
    role_tags: Sequence[str] = tuple(fv.ROLE_TAGS),
    restricted: str = "restricted",
    path: str = "path",
    filename: str = "filename",
) -> DataFrame:
    """Type, access level and role tag of knowledge files.

    Files below `transcripts/` and `architecture/` are public. The master
    career file and the résumés are restricted; a résumé's role is the first
    tag its file name holds.
    """
    name, where = F.lower(F.col(filename)), F.col(path)
    in_transcripts = F.contains(where, F.lit("transcripts/"))
    in_architecture = F.contains(where, F.lit("architecture/"))
    is_master = F.col(filename) == "master-career-file.md"
    kind = (
        F.when(in_transcripts, "transcript")
        .when(in_architecture, "architecture")
        .when(is_master, "career")
        .otherwise("resume")
    )
    role = F.lit("general")
    for tag in reversed(list(role_tags)):
        role = F.when(F.contains(name, F.lit(tag)), tag).otherwise(role)
    return (
        files.withColumn("type", kind)
        .withColumn(
            "access_level",
            F.when(F.col("type").isin("transcript", "architecture"), "public").otherwise(restricted),
        )
        .withColumn("role_tag", F.when(F.col("type") == "resume", role).otherwise("general"))
    )


def _names(interviewers: Iterable[str]) -> list[str]:
    return [rf"\b{name}\b" for name in interviewers]


def anonymized(
    text: Column,
    person_rules: Rules = (),
    organisation_rules: Rules = tuple(fv.ORGANISATION_RULES),
    interviewers: Iterable[str] = (),
) -> Column:
    """Replace personal data, organisations and interviewers; drop transcript
    credits; tidy blank lines.

    Hits are few, so rules are tried only where a cheaper test finds what one of them needs: codes where there is a digit,
    an at sign or a link, clearances, organisations and interviewers where one combined pattern finds any of them,
    credits and blank lines where their words or line ends are. A step that is left out would have changed nothing.
    """
    text = _where(matches(text, fv.CODE_MARK), text, lambda t: apply_rules(t, fv.DOCUMENT_CODE_RULES))
    people, person_rules = list(interviewers), list(person_rules)
    asked_by = [(p, fv.INTERVIEWER_LABEL) for p in _names(people)]
    plain = all(re.fullmatch(r"[\w .'-]+", name) for name in people)
    named = [*organisation_rules, *(asked_by if plain else [])]
    if person_rules:
        text = apply_rules(text, [*fv.DOCUMENT_CLEARANCE_RULES, *person_rules])
    else:
        named = [*fv.DOCUMENT_CLEARANCE_RULES, *named]
    if named:
        patterns = [p for p, _ in named]
        found = matches(text, any_of(patterns, word_initials(patterns)), "")
        text = _where(found, text, lambda t: apply_rules(t, named))
    if not plain:  # names given as patterns can begin in ways the combined one does not know
        text = apply_rules(text, asked_by)
    credited = matches(text, fv.CREDIT_MARK, ANY_CASE) | F.contains(text, F.lit(fv.CREDIT_WORDS))
    return strip(_where(credited | F.contains(text, F.lit("\n\n\n")), text, _without_credits))


def _where(found: Column, text: Column, change: Callable[[Column], Column]) -> Column:
    return F.when(found, change(text)).otherwise(text)


def _without_credits(text: Column) -> Column:
    text = replace_all(text, fv.CREDIT_LINE_ANY_CASE, "", "(?dimU)")
    text = replace_all(text, fv.CREDIT_LINE_AS_WRITTEN, "", "(?dmU)")
    return replace_all(text, r"\n{3,}", "\n\n")


def anonymize_documents(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    return docs.withColumn(text, anonymized(F.col(text), **rules))


def anonymized_filename(
    name: Column,
    organisation_rules: Rules = tuple(fv.ORGANISATION_RULES),
    interviewers: Iterable[str] = (),
) -> Column:
    """A file stem without organisations, people and transcript marks.

    Words in file names are joined by `_`, so the rules are used without their
    word borders and optional marks.
    """
    removed = [p.replace(r"\b", "").replace("?", "") for p, _ in organisation_rules]
    removed += [p.replace(r"\b", "") for p in _names(interviewers)]
    name = apply_rules(name, [(p, "") for p in [*removed, fv.FILENAME_SUFFIX]])
    name = replace_all(name, fv.FILENAME_COPY_NUMBER, "")
    name = replace_all(name, r"[_\s]+", "_")
    name = F.btrim(name, F.lit("_"))
    return F.when(name == "", fv.EMPTY_FILENAME).otherwise(name)


def anonymize_filenames(files: DataFrame, stem: str = "stem", **rules) -> DataFrame:
    return files.withColumn("clean_name", anonymized_filename(F.col(stem), **rules))


def redact_pii(texts: DataFrame, text: str = "text", person_rules: Rules = ()) -> DataFrame:
    """Tags in place of personal data. Person rules ignore case, the rest do not."""
    redacted = apply_rules(F.col(text), person_rules, ANY_CASE)
    return texts.withColumn(text, apply_rules(redacted, fv.ANSWER_PII_RULES, EXACT))


def pii_kinds(text: Column) -> Column:
    """The kinds of personal data found, in the order of the rules."""
    return F.array_compact(
        F.array(*[F.when(matches(text, p), kind) for p, kind in fv.PII_KINDS])
    )


def detect_pii(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("pii_kinds", pii_kinds(F.col(text)))


def withhold_pii(texts: DataFrame, text: str = "text") -> DataFrame:
    """The text, or a fixed message if it holds personal data."""
    hit = matches(F.col(text), any_of([p for p, _ in fv.PII_KINDS], flags=EXACT), "")
    return texts.withColumn(text, F.when(hit, fv.WITHHELD_MESSAGE).otherwise(F.col(text)))


def read_patterns(lines: Iterable[str]) -> list[str]:
    """Deny patterns of a pattern file: no blank lines, no comments."""
    stripped = (line.rstrip("\n") for line in lines)
    return [line for line in stripped if line and not line.startswith("#")]


def scanned_lines(
    files: DataFrame,
    include: Sequence[str] = (".py", ".txt", ".md", ".json", ".yaml", ".yml"),
    exclude_dirs: Sequence[str] = ("__pycache__", "resume_corpus", "tests"),
    exclude_files: Sequence[str] = ("scrub.py", "security.py"),
) -> DataFrame:
    """(path, line_no, line) of the files a scan looks at."""
    steps = F.split("path", "/")
    name = F.element_at(steps, -1)
    wanted = F.lit(False)
    for extension in include:
        wanted = wanted | F.endswith(name, F.lit(extension))
    folders = F.slice(steps, F.lit(1), F.size(steps) - 1)
    excluded = name.isin(list(exclude_files)) | F.arrays_overlap(
        folders, F.array(*[F.lit(d) for d in exclude_dirs])
    )
    scanned = files.where(wanted & ~excluded).withColumn("_lines", F.split("text", "\n"))
    return exploded(scanned, ["path"], "_lines", "line_no", "line").withColumn(
        "line_no", F.col("line_no") + 1
    )


def denylist_scan(files: DataFrame, patterns: Iterable[str], **which: Sequence[str]) -> DataFrame:
    """Every (file, line, pattern) hit, ignoring case; `which` as in `scanned_lines`.

    The patterns are part of the expression, so each line is tried against all
    of them where it lies. That is for tens of patterns; see
    `pattern_index.denylist_scan_indexed` for thousands.
    """
    patterns = read_patterns(patterns)
    lines = scanned_lines(files, **which)
    if not patterns:
        return lines.where(F.lit(False)).withColumn("pattern", F.lit(""))
    hits = F.array_compact(
        F.array(*[F.when(matches(F.col("line"), p, ANY_CASE), p) for p in patterns])
    )
    suspects = lines.where(matches(F.col("line"), any_of(patterns), "")).withColumn("_hits", hits)
    return exploded(suspects, ["path", "line_no", "line"], "_hits", "_", "pattern").drop("_")


def denylist_verdict(hits: DataFrame) -> DataFrame:
    """Number of hits and whether the scan passes."""
    n = F.count(F.lit(1))
    return hits.agg(n.alias("hits"), (n == 0).alias("passed"))


def corpus_scrub_report(files: DataFrame, preview: int = 500, **rules) -> DataFrame:
    """Cleaned name and text of each raw file, its size and a preview."""
    text_rules = dict(rules)
    name_rules = {k: v for k, v in rules.items() if k != "person_rules"}
    return (
        files.withColumn("text", anonymized(F.col("text"), **text_rules))
        .withColumn(
            "output_name",
            F.concat(anonymized_filename(F.col("stem"), **name_rules), F.lit(".md")),
        )
        .withColumn("n_chars", F.length("text"))
        .withColumn("preview", F.substring("text", 1, preview))
    )
