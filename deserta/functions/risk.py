"""Risk classification expressions (R1-R7). Pure Column expressions, fused into one projection by codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk labels, C-section flags and band thresholds that the outputs must equal.
HIGH, MEDIUM, LOW, UNKNOWN = "High Risk", "Medium Risk", "Low Risk", "Unknown"
CSECTION_FLAGS = ("Unknown", "Potentially Limited Access", "Monitor Access", "Expected Range", "Elevated Utilization")
# (high, medium, direction) per category; "up" = higher value is worse, "down" = lower value is worse.
THRESHOLDS = {
    "diabetes": (15.0, 10.0, "up"),
    "hypertension": (20.0, 15.0, "up"),
    "nutrition": (25.0, 20.0, "up"),
    "cancer": (30.0, 50.0, "down"),
}
# Raw survey column names used by the risk rules.
INSTITUTIONAL = "institutional_birth_5y_pct"
SKILLED = "births_attended_by_skilled_hp_5y_10_pct"
CSECTION = "births_delivered_by_csection_5y_pct"
BLOOD_SUGAR = "w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct"
HIGH_BP = "w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct"
UNDERWEIGHT = "women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct"
CERVICAL = "women_age_30_49_years_ever_undergone_a_cervical_screen_pct"
BREAST = "women_age_30_49_years_ever_undergone_a_breast_exam_pct"
ORAL = "women_age_30_49_years_ever_undergone_an_oral_cancer_exam_pct"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def maternal_access_score(institutional=INSTITUTIONAL, skilled=SKILLED) -> Column:
    """Mean of institutional and skilled-attendance births when both are known."""
    i, s = _c(institutional), _c(skilled)
    return F.when(i.isNotNull() & s.isNotNull(), (i + s) / 2.0)


def skilled_attendance_gap(institutional=INSTITUTIONAL, skilled=SKILLED) -> Column:
    """R2: institutional minus skilled attendance when both are known."""
    i, s = _c(institutional), _c(skilled)
    return F.when(i.isNotNull() & s.isNotNull(), i - s)


def csection_access_flag(csection=CSECTION) -> Column:
    """C-section utilisation band (higher is not better, so it is a flag, not a score)."""
    c = _c(csection)
    return (
        F.when(c.isNull(), F.lit(CSECTION_FLAGS[0]))
        .when(c < 10, F.lit(CSECTION_FLAGS[1]))
        .when(c < 15, F.lit(CSECTION_FLAGS[2]))
        .when(c <= 20, F.lit(CSECTION_FLAGS[3]))
        .otherwise(F.lit(CSECTION_FLAGS[4]))
    )


def maternal_risk(institutional=INSTITUTIONAL, skilled=SKILLED, csection=CSECTION) -> Column:
    """Unknown without a score; otherwise High / Medium / Low.

    SQL three-valued logic is intended: a NULL C-section disjunct never fires but does not block the others.
    """
    score = maternal_access_score(institutional, skilled)
    gap = skilled_attendance_gap(institutional, skilled)
    c = _c(csection)
    return (
        F.when(score.isNull(), F.lit(UNKNOWN))
        .when((score < 70) | (gap > 15) | (c < 10), F.lit(HIGH))
        .when((score < 85) | (gap > 5) | (c < 15), F.lit(MEDIUM))
        .otherwise(F.lit(LOW))
    )


def cancer_screening_score(cervical=CERVICAL, breast=BREAST, oral=ORAL) -> Column:
    """Mean of the three screening rates when all are known."""
    a, b, c = _c(cervical), _c(breast), _c(oral)
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), (a + b + c) / 3.0)


def threshold_risk(col, high: float, medium: float, direction: str = "up") -> Column:
    """Generic banding. ``up``: > high is High, > medium is Medium; ``down``: < high is High, < medium Medium."""
    v = _c(col)
    if direction == "up":
        hi, med = v > high, v > medium
    elif direction == "down":
        hi, med = v < high, v < medium
    else:
        raise ValueError(direction)
    return (
        F.when(v.isNull(), F.lit(UNKNOWN)).when(hi, F.lit(HIGH)).when(med, F.lit(MEDIUM)).otherwise(F.lit(LOW))
    )


def category_risk(category: str, col) -> Column:
    hi, med, direction = THRESHOLDS[category]
    return threshold_risk(col, hi, med, direction)


def overall_risk(*risks: Column) -> Column:
    """Worst of the category labels, High > Medium > Unknown > Low."""
    arr = F.array(*risks)
    return (
        F.when(F.array_contains(arr, HIGH), F.lit(HIGH))
        .when(F.array_contains(arr, MEDIUM), F.lit(MEDIUM))
        .when(F.array_contains(arr, UNKNOWN), F.lit(UNKNOWN))
        .otherwise(F.lit(LOW))
    )


def severity_rank(col) -> Column:
    """Sort key for reports: High 1, Medium 2, Unknown 3, Low 4, anything else 5."""
    c = _c(col)
    return (
        F.when(c == HIGH, 1).when(c == MEDIUM, 2).when(c == UNKNOWN, 3).when(c == LOW, 4).otherwise(5)
    )
