"""Searching and rendering nested profile documents. All row-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def _start_year(dates: Column) -> Column:
    """The last word before the first en dash, as a year."""
    head = F.trim(F.get(F.split(dates, "–"), F.lit(0)))
    return F.try_element_at(F.split(head, r"\s+"), F.lit(-1)).try_cast("int")


def experience_search(
    profiles: DataFrame, company: str | None = None, after: int | None = None
) -> DataFrame:
    """Jobs by company substring (any case) and earliest start year. An empty
    or zero argument does not filter."""
    jobs = profiles.select("profile_id", F.posexplode("experience").alias("position", "job"))
    if company:
        jobs = jobs.where(
            F.contains(F.lower("job.company"), F.lit(company.lower()))
        )
    if after:
        jobs = jobs.where(_start_year(F.col("job.dates")) >= after)
    return jobs.select("profile_id", "position", "job.*")


def skills_search(
    profiles: DataFrame, category: str | None = None, keyword: str | None = None
) -> DataFrame:
    """One category, or the skills holding a keyword, or all of them. Profiles
    without a match are left out."""
    skills = F.col("skills")
    if category:
        skills = F.map_filter(skills, lambda name, _: name == category)
    elif keyword:
        skills = F.map_filter(
            F.transform_values(
                skills,
                lambda _, items: F.filter(
                    items, lambda s: F.contains(F.lower(s), F.lit(keyword.lower()))
                ),
            ),
            lambda _, items: F.size(items) > 0,
        )
    found = profiles.select("profile_id", skills.alias("skills"))
    return found.where(F.size("skills") > 0) if category or keyword else found


def profile_sections(profiles: DataFrame, section: str = "all") -> DataFrame:
    """The education or certification rows, or the whole served document."""
    if section == "education":
        return profiles.select(
            "profile_id", F.posexplode("education").alias("position", "item")
        ).select("profile_id", "position", "item.*")
    wrapped = F.transform("certifications", lambda c: F.struct(c.alias("name")))
    if section == "certifications":
        return profiles.select(
            "profile_id", F.posexplode(wrapped).alias("position", "item")
        ).select("profile_id", "position", "item.*")
    return profiles.drop("portfolio_projects").withColumn("certifications", wrapped)


def action_validation(actions: DataFrame) -> DataFrame:
    """Status, message and confirmation of recruiter actions; an action that
    lacks a field gets the name of the first one instead, one that is neither a
    contact nor a shortlist request the field `action`."""

    def first_missing(fields) -> Column:
        return F.coalesce(*[F.when(F.col(f).isNull(), f) for f in fields])

    is_contact = F.col("action") == "contact"
    known = F.coalesce(F.col("action").isin("contact", "shortlist"), F.lit(False))
    missing = (
        F.when(~known, F.lit("action"))
        .when(is_contact, first_missing(fv.CONTACT_FIELDS))
        .otherwise(first_missing(fv.SHORTLIST_FIELDS))
    )
    accepted = F.col("missing_field").isNull()
    digest = F.md5(F.col("action_id").cast("string"))
    return (
        actions.withColumn("missing_field", missing)
        .select(
            "action_id",
            "action",
            "missing_field",
            F.when(accepted, F.when(is_contact, "received").otherwise("shortlisted"))
            .alias("status"),
            F.when(
                accepted, F.when(is_contact, fv.CONTACT_MESSAGE).otherwise(fv.SHORTLIST_MESSAGE)
            ).alias("message"),
            F.when(accepted & is_contact, F.concat(F.lit("conf_"), F.substring(digest, 1, 8)))
            .alias("confirmation_id"),
        )
    )


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")


def _label(key: Column) -> Column:
    """Title case: a letter after anything but a letter is upper case, others lower."""
    low = F.lower(F.replace(key, F.lit("_"), F.lit(" ")))
    parts = F.regexp_extract_all(low, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10**6))), ""
    )


def render_profile_text(profiles: DataFrame) -> DataFrame:
    """Each profile as one markdown text: summary, skills, jobs, first
    education, certifications, portfolio."""
    skills = F.concat(
        F.lit("# Skills\n"),
        F.array_join(
            F.transform(
                F.map_entries("skills"),
                lambda e: F.concat(
                    F.lit("\n## "), _label(e["key"]), F.lit("\n"), _bullets(e["value"])
                ),
            ),
            "",
        ),
    )
    job_texts = F.transform(
        "experience",
        lambda j: F.concat(
            F.lit("# "), j["company"], F.lit(" — "), j["title"], F.lit(" ("), j["dates"],
            F.lit(")\n"),
            F.array_join(
                F.transform(
                    j["projects"],
                    lambda p: F.concat(
                        F.lit("\n## "), p["name"], F.lit(": "), p["subtitle"], F.lit("\n"),
                        _bullets(p["bullets"]),
                    ),
                ),
                "",
            ),
        ),
    )
    first = F.get("education", F.lit(0))
    education = F.concat(
        F.lit("# Education\n"), first["degree"], F.lit(" in "), first["major"], F.lit(", "),
        first["school"],
    )
    certifications = F.concat(F.lit("# Certifications\n"), _bullets(F.col("certifications")))
    portfolio = F.concat(
        F.lit("# Portfolio Projects\n"),
        F.array_join(
            F.transform(
                "portfolio_projects",
                lambda p: F.concat(
                    F.lit("\n## "), p["name"], F.lit("\n"), p["description"], F.lit("\n")
                ),
            ),
            "",
        ),
    )
    sections = F.concat(
        F.array(F.concat(F.lit("# Professional Summary\n"), F.col("summary")), skills),
        job_texts,
        F.array(education, certifications, portfolio),
    )
    return profiles.select("profile_id", F.array_join(sections, "\n\n").alias("text"))


def render_patterns_text(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each list of question patterns as one text."""
    parts = F.transform(
        "items",
        lambda x: F.concat(
            F.lit("INTERVIEW PATTERN — "), x["question"],
            F.lit("\nTags: "), F.array_join(F.coalesce(x["tags"], F.array()), ", "),
            F.lit("\nResponse pattern: "), x["response_pattern"], F.lit("\n"),
        ),
    )
    return docs.select(id_column, F.array_join(parts, fv.ITEM_SEPARATOR).alias("text"))


def render_decisions_text(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each list of decisions as one text; a missing phase reads `n/a`."""
    parts = F.transform(
        "items",
        lambda x: F.concat(
            F.lit("ARCHITECTURE DECISION — "), x["decision"],
            F.lit("\nPhase: "), F.coalesce(x["phase"].cast("string"), F.lit("n/a")),
            F.lit("\n"), x["content"], F.lit("\n"),
        ),
    )
    return docs.select(id_column, F.array_join(parts, fv.ITEM_SEPARATOR).alias("text"))
