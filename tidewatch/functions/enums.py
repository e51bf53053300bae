"""Enumerations as string columns, with their ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders of the enumerations, weakest first.
SEVERITIES = ("NOT_FLAGGED", "INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
AREAS = ("SOURCE_CODE", "CAPABILITIES", "INSTALLATION", "DEPENDENCIES", "NETWORK", "PROMPT_INJECTION", "PROVENANCE", "REPOSITORY_TRUST", "MAINTENANCE", "POPULARITY_INTEGRITY")
ENDPOINT_CLASSES = ("SUSPICIOUS", "UNEXPLAINED", "EXPECTED", "INFRASTRUCTURE")
STATUSES = ("VERIFIED", "UNAVAILABLE", "NOT_APPLICABLE", "NOT_CHECKED")


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place of an enumeration's value, from 0; null for others."""
    return F.when(value.isin(*order), F.array_position(F.array(*map(F.lit, order)), value).cast("int") - 1)


def named(number: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, order)), number)


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def confidence_rank(value: Column) -> Column:
    return rank(value, CONFIDENCES)


def severity_of(number: Column) -> Column:
    return named(number, SEVERITIES)


def demoted_rank(severity: Column, confidence: Column) -> Column:
    """A finding of low confidence counts one notch lower toward the headline."""
    return F.greatest(F.lit(0), severity_rank(severity) - (confidence == "LOW").cast("int"))


def one_notch_down(severity: Column) -> Column:
    return severity_of(F.greatest(F.lit(0), severity_rank(severity) - 1))


def exit_code(severity: Column) -> Column:
    """3 critical, 2 high, 1 medium or low, else 0; 4 is for targets that could not be read (see coverage)."""
    return F.when(severity == "CRITICAL", 3).when(severity == "HIGH", 2).when(severity.isin("MEDIUM", "LOW"), 1).otherwise(0)


def recommendation(severity: Column) -> Column:
    return (
        F.when(severity == "CRITICAL", "DO NOT INSTALL")
        .when(severity == "HIGH", "DO NOT INSTALL WITHOUT MANUAL REVIEW")
        .when(severity == "MEDIUM", "REVIEW BEFORE INSTALLING")
        .when(severity == "LOW", "PROCEED WITH ORDINARY CARE")
        .otherwise("NOT FLAGGED by these checks, which is not the same as safe")
    )


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity.isin("MEDIUM", "LOW"), "warning").when(severity == "INFO", "note").otherwise("none")


def security_severity(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", "9.5").when(severity == "HIGH", "8.0").when(severity == "MEDIUM", "5.5").when(severity == "LOW", "3.0")


def precision(confidence: Column) -> Column:
    return F.lower(confidence)
