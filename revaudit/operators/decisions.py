"""The lifecycle decision table, its validation, and normalised predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# Labels and the decision table.
LABELS = ("KEEP", "RETIRE", "RETRACT", "UNSURE")
DECIDABLE = ("KEEP", "RETIRE", "RETRACT")
VALID_VALUES = {
    "original_validity": ("SUPPORTED", "REFUTED", "INDETERMINATE"),
    "target_state_t1": ("PRESENT", "RESOLVED", "INDETERMINATE", "NOT_APPLICABLE"),
    "lifecycle_label": LABELS,
    "instructional_priority": ("HIGH", "LOW", "UNKNOWN"),
    "leakage_label": ("ABSENT", "PRESENT", "NOT_EVALUATED"),
}


def expected_lifecycle(original: str | Column, target: str | Column) -> Column:
    o, t = col(original), col(target)
    return F.when(o == "REFUTED", "RETRACT").when((o == "SUPPORTED") & (t == "PRESENT"), "KEEP").when((o == "SUPPORTED") & (t == "RESOLVED"), "RETIRE").otherwise("UNSURE")


def violations(original: Column, target: Column, label: Column, abstain: Column) -> Column:
    """Which rules a decision breaks, in order."""
    expected = expected_lifecycle(original, target)
    rules = (
        (original == "REFUTED") & (target != "NOT_APPLICABLE"), F.lit("REFUTED original claim requires target_state_t1=NOT_APPLICABLE"),
        (original == "SUPPORTED") & (target == "NOT_APPLICABLE"), F.lit("SUPPORTED original claim cannot use target_state_t1=NOT_APPLICABLE"),
        (original == "INDETERMINATE") & (target != "INDETERMINATE"), F.lit("INDETERMINATE original claim requires target_state_t1=INDETERMINATE"),
        abstain & (label != "UNSURE"), F.lit("abstain=true requires lifecycle_label=UNSURE"),
        ~abstain & (label != expected), F.concat(F.lit("Lifecycle output inconsistent with decision table; expected "), expected, F.lit(", got "), label),
    )
    return F.array_compact(F.array(*(F.when(rules[k], rules[k + 1]) for k in range(0, len(rules), 2))))


def validate(df: DataFrame) -> DataFrame:
    """Decisions after the table: a broken rule or an abstention makes them UNSURE; the model's own label is kept."""
    o, t, label, abstain = (F.col(c) for c in ("original_validity", "target_state_t1", "lifecycle_label", "abstain"))
    out = df.withColumn("_v", violations(o, t, label, abstain))
    bad = F.size("_v") > 0
    reason = F.when(bad, F.array_join("_v", "; ")).otherwise(F.col("abstention_reason")) if "abstention_reason" in df.columns else F.when(bad, F.array_join("_v", "; "))
    return out.select(
        *(c for c in df.columns if c not in ("lifecycle_label", "abstain", "abstention_reason")),
        label.alias("model_lifecycle_label"), expected_lifecycle(o, t).alias("rule_expected_lifecycle"), bad.alias("decision_rule_violation"),
        F.when(bad | abstain, "UNSURE").otherwise(label).alias("lifecycle_label"), (bad | abstain).alias("abstain"), reason.alias("abstention_reason"),
        F.when(bad, "RULE_VIOLATION_ABSTAINED").when(abstain, "ABSTAINED").otherwise("PASS").alias("decision_validation"),
    )


def deterministic_abstention(df: DataFrame, item: str, ids: str, issues: str) -> DataFrame:
    """The fixed decision of items whose evidence failed validation."""
    lit = lambda v, n: F.lit(v).alias(n)
    return df.select(
        F.col(item).alias("item_id"), lit("INDETERMINATE", "original_validity"), lit("INDETERMINATE", "target_state_t1"), lit("UNSURE", "lifecycle_label"),
        lit("UNKNOWN", "instructional_priority"), lit("NOT_EVALUATED", "leakage_label"), F.array_sort(ids).alias("evidence_ids"),
        lit("Deterministic evidence validation failed; no GLM decision was requested.", "short_reason"), lit(True, "abstain"), F.array_join(issues, "; ").alias("abstention_reason"),
        F.lit(None).cast("string").alias("model_lifecycle_label"), lit("UNSURE", "rule_expected_lifecycle"), lit(False, "decision_rule_violation"),
        lit("DETERMINISTIC_PACKET_ABSTENTION", "decision_validation"), F.col(issues).alias("packet_validation_issues"),
    )


def normalise(df: DataFrame, condition: str) -> DataFrame:
    """Predictions of any condition alike: ``abstain`` false where there is none, the model's own label where there is
    one, and the action that follows, UNSURE for an abstention."""
    has = df.columns
    abstain = F.coalesce(F.col("abstain"), F.lit(False)) if "abstain" in has else F.lit(False)
    own = F.coalesce(F.col("model_lifecycle_label"), F.col("lifecycle_label")) if "model_lifecycle_label" in has else F.col("lifecycle_label")
    return df.select("item_id", F.lit(condition).alias("condition"), own.alias("predicted_label"), abstain.alias("abstain"), F.when(abstain, "UNSURE").otherwise(F.col("lifecycle_label")).alias("final_action"))
