"""The five label normalisers. They differ in what they accept and in what unknown labels become."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions.text import col, strip


def _upper(label: Column | str) -> Column:
    return F.upper(strip(label))


def dataset_label(label: Column | str) -> Column:
    """Raw dataset labels; unknown ones pass with underscores for spaces."""
    up = _upper(label)
    return (
        F.when(up.isin("SUPPORTS", "SUPPORT"), C.SUPPORTED)
        .when(up.isin("REFUTES", "CONTRADICT", "CONTRADICTS"), C.REFUTED)
        .when(up.isin("NOT ENOUGH INFO", "NOT_ENOUGH_INFO", "NEI", "UNKNOWN"), C.NEI_DISK)
        .otherwise(F.replace(up, F.lit(" "), F.lit("_")))
    )


def artifact_label(label: Column | str) -> Column:
    """Labels of training artefacts; unknown and null ones are NOT_ENOUGH_INFO."""
    up = F.translate(_upper(label), "- ", "__")
    return F.when(up.isin("SUPPORTED", "SUPPORTS"), C.SUPPORTED).when(up.isin("REFUTED", "REFUTES", "CONTRADICT", "CONTRADICTS"), C.REFUTED).otherwise(C.NEI_DISK)


def model_label(label: Column | str) -> Column:
    """Labels a model gives: upper-cased, underscores as spaces; an unknown one raises."""
    up = F.replace(_upper(label), F.lit("_"), F.lit(" "))
    return F.when(up.isin(*C.LABELS), up).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(col(label).cast("string"), F.lit("null")))))


def _two(label: Column | str, default: str) -> Column:
    up = F.replace(_upper(label), F.lit("_"), F.lit(" "))
    return F.when(up.isin("SUPPORTED", "SUPPORTS", "SUPPORT"), C.SUPPORTED).when(up.isin("REFUTED", "REFUTES", "CONTRADICT", "CONTRADICTS"), C.REFUTED).otherwise(default)


def verifier_data_label(label: Column | str) -> Column:
    return _two(label, C.NEI_DISK)


def evaluation_label(label: Column | str) -> Column:
    return _two(label, C.NEI)


def pair_label(verdict: Column | str) -> Column:
    """Verdict to the label of a per-passage pair."""
    return F.when(col(verdict) == C.SUPPORTED, "SUPPORTS").when(col(verdict) == C.REFUTED, "REFUTES").otherwise("NEI")


def display_verdict(verdict: Column | str) -> Column:
    return F.when(col(verdict).isin(C.SUPPORTED, C.REFUTED), col(verdict)).otherwise("Inconclusive")


def confidence_bucket(confidence: Column | str) -> Column:
    c = col(confidence)
    return F.when(c >= 0.7, "High").when(c >= 0.55, "Borderline").otherwise("Review")


def grounding_bucket(top_score: Column | str) -> Column:
    s = col(top_score)
    return F.when(s.isNull(), None).when(s >= 3, "Strong").when(s >= 1.5, "Moderate").otherwise("Weak")
