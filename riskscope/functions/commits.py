"""Expressions over commit subjects and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Subjects that mark a bug fix.
BUGFIX_PATTERNS = [
    r"^\s*\[?(?:fix|bugfix|hotfix|patch|correctif)",
    r"^\s*fixes?\s*[:#]",
    r"^\s*corrige",
    r"\[fix\]",
    r"#\d+\s+fix",
    r"\bbug\s*fix",
]

NO_COMMIT = -1.0


def is_bugfix(subject: Column) -> Column:
    return subject.rlike("(?iU)" + "|".join(BUGFIX_PATTERNS))


def days_between(now: Column, then: Column) -> Column:
    """Days from one unix second to another, one decimal."""
    return F.round((now - then) / F.lit(86400.0), 1)


def safe_name(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "")


def safe_path_part(text: Column) -> Column:
    """Letters, digits, underscore and hyphen; `Unnamed` when nothing is left."""
    kept = F.regexp_replace(text, "[^a-zA-Z0-9_-]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("Unnamed"))
