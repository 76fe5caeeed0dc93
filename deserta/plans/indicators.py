"""Survey -> cleaned indicators -> care-desert risk table.

The whole chain is narrow: one scan and one fused projection stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deserta.functions import risk as R
from deserta.functions.cleaning import clean_survey_number
from deserta.operators.quality import conform_schema

# The survey columns kept by the cleaning step, in output order; the text-coded ones (estimates in
# parentheses, '*' suppressed) are in CLEANED_TEXT_COLUMNS and go through clean_survey_number.
SURVEY_COLUMNS = (
    "district_name", "state_ut", "households_surveyed", "women_15_49_interviewed",
    "institutional_birth_5y_pct", "births_delivered_by_csection_5y_pct",
    "mothers_who_had_at_least_4_anc_visits_lb5y_pct", "births_attended_by_skilled_hp_5y_10_pct",
    "w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct",
    "w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct",
    "women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct",
    "women_age_30_49_years_ever_undergone_a_cervical_screen_pct",
    "women_age_30_49_years_ever_undergone_a_breast_exam_pct",
    "women_age_30_49_years_ever_undergone_an_oral_cancer_exam_pct",
    "hh_member_covered_health_insurance_pct", "institutional_birth_in_public_facility_5y_pct",
    "births_in_a_public_fac_that_were_delivered_by_csection_5y_pct",
    "births_in_a_private_fac_that_were_delivered_by_csection_5y_pct",
    "average_out_of_pocket_expenditure_per_delivery_in_a_public_fac",
    "health_worker_ever_talked_to_female_non_users_about_family_pct",
    "children_with_diarrhoea_2wk_taken_to_a_health_facility_or_h_pct",
    "children_with_fever_or_symptoms_of_ari_2wk_taken_to_a_healt_pct",
    "child_12_23m_fully_vaccinated_based_on_information_from_eit_pct",
    "child_12_23m_who_received_most_of_their_vaccinations_in_a_p_pct",
    "mothers_who_consumed_ifa_for_100_days_or_more_when_they_wer_pct",
    "mothers_who_consumed_ifa_for_180_days_or_more_when_they_wer_pct",
    "registered_pregnancies_for_which_the_mother_received_a_mcp_pct",
    "mothers_who_had_an_anc_visit_in_the_first_trimester_lb5y_pct",
    "mothers_who_received_pnc_from_a_doctor_nurse_lhv_anm_midwif_pct",
    "children_who_received_pnc_from_a_doctor_nurse_lhv_anm_midwi_pct",
    "child_u5_who_are_stunted_height_for_age_18_pct", "child_u5_who_are_wasted_weight_for_height_18_pct",
    "non_pregnant_w15_49_who_are_anaemic_lt_12_0_g_dl_22_pct", "all_w15_49_who_are_anaemic_pct",
    "hh_electricity_pct", "hh_improved_water_pct", "hh_use_improved_sanitation_pct",
    "women_age_15_49_who_are_literate_pct", "population_below_age_15_years_pct",
    "women_age_15_49_years_who_are_overweight_obese_bmi_gte_25_0_pct",
    "w15_plus_who_use_any_kind_of_tobacco_pct", "w15_plus_who_consume_alcohol_pct",
)
CLEANED_TEXT_COLUMNS = frozenset({
    "mothers_who_had_at_least_4_anc_visits_lb5y_pct",
    "births_in_a_public_fac_that_were_delivered_by_csection_5y_pct",
    "births_in_a_private_fac_that_were_delivered_by_csection_5y_pct",
    "average_out_of_pocket_expenditure_per_delivery_in_a_public_fac",
    "children_with_diarrhoea_2wk_taken_to_a_health_facility_or_h_pct",
    "children_with_fever_or_symptoms_of_ari_2wk_taken_to_a_healt_pct",
    "child_12_23m_fully_vaccinated_based_on_information_from_eit_pct",
    "child_12_23m_who_received_most_of_their_vaccinations_in_a_p_pct",
    "mothers_who_consumed_ifa_for_100_days_or_more_when_they_wer_pct",
    "mothers_who_consumed_ifa_for_180_days_or_more_when_they_wer_pct",
    "registered_pregnancies_for_which_the_mother_received_a_mcp_pct",
    "mothers_who_had_an_anc_visit_in_the_first_trimester_lb5y_pct",
    "mothers_who_received_pnc_from_a_doctor_nurse_lhv_anm_midwif_pct",
    "children_who_received_pnc_from_a_doctor_nurse_lhv_anm_midwi_pct",
    "child_u5_who_are_stunted_height_for_age_18_pct",
    "child_u5_who_are_wasted_weight_for_height_18_pct",
})

# Fixed value: declared schema of the indicator table (the key is audited by key_violations).
INDICATORS_DDL = """
district_name STRING NOT NULL, state_ut STRING NOT NULL,
households_surveyed DOUBLE, women_15_49_interviewed DOUBLE,
maternal_neonatal_institutional_birth_pct DOUBLE, maternal_neonatal_csection_pct DOUBLE,
maternal_neonatal_anc_visits_pct DOUBLE, maternal_neonatal_skilled_birth_pct DOUBLE,
maternal_neonatal_access_score DOUBLE, maternal_neonatal_skilled_attendance_gap DOUBLE,
maternal_neonatal_csection_access_flag STRING, maternal_neonatal_risk STRING,
diabetes_care_high_blood_sugar_pct DOUBLE, diabetes_care_risk STRING,
hypertension_care_high_bp_pct DOUBLE, hypertension_care_risk STRING,
nutrition_services_underweight_pct DOUBLE, nutrition_services_risk STRING,
cancer_screening_cervical_pct DOUBLE, cancer_screening_breast_pct DOUBLE, cancer_screening_oral_pct DOUBLE,
cancer_screening_score DOUBLE, cancer_screening_risk STRING,
overall_care_desert_risk STRING
"""
INDICATOR_COLUMNS = tuple(
    part.strip().split()[0] for part in INDICATORS_DDL.replace("\n", " ").split(",") if part.strip()
)
RISK_FIELDS = ("maternal_neonatal_risk", "diabetes_care_risk", "hypertension_care_risk",
               "nutrition_services_risk", "cancer_screening_risk", "overall_care_desert_risk")


def nfhs_cleaned(raw: DataFrame, allow_missing: bool = False) -> DataFrame:
    """D1 + D2: select the survey columns and decode the text-coded ones. A missing column raises, unless
    ``allow_missing`` is set for sources that carry only part of the survey."""
    present = set(raw.columns)
    missing = [c for c in SURVEY_COLUMNS if c not in present]
    if missing and not allow_missing:
        raise ValueError(f"survey columns are missing: {', '.join(missing)}")
    return raw.select(*[
        clean_survey_number(c).alias(c) if c in CLEANED_TEXT_COLUMNS else F.col(c)
        for c in SURVEY_COLUMNS if c in present
    ])


def care_desert_indicators(cleaned: DataFrame) -> DataFrame:
    """R1-R7 + D3 + V2: the gold indicator table with per-category and overall risk."""
    maternal = R.maternal_risk()
    diabetes = R.category_risk("diabetes", R.BLOOD_SUGAR)
    hypertension = R.category_risk("hypertension", R.HIGH_BP)
    nutrition = R.category_risk("nutrition", R.UNDERWEIGHT)
    cancer_score = R.cancer_screening_score()
    cancer = R.category_risk("cancer", cancer_score)
    out = cleaned.select(
        "district_name", "state_ut", "households_surveyed", "women_15_49_interviewed",
        F.col(R.INSTITUTIONAL).alias("maternal_neonatal_institutional_birth_pct"),
        F.col(R.CSECTION).alias("maternal_neonatal_csection_pct"),
        F.col("mothers_who_had_at_least_4_anc_visits_lb5y_pct").alias("maternal_neonatal_anc_visits_pct"),
        F.col(R.SKILLED).alias("maternal_neonatal_skilled_birth_pct"),
        R.maternal_access_score().alias("maternal_neonatal_access_score"),
        R.skilled_attendance_gap().alias("maternal_neonatal_skilled_attendance_gap"),
        R.csection_access_flag().alias("maternal_neonatal_csection_access_flag"),
        maternal.alias("maternal_neonatal_risk"),
        F.col(R.BLOOD_SUGAR).alias("diabetes_care_high_blood_sugar_pct"),
        diabetes.alias("diabetes_care_risk"),
        F.col(R.HIGH_BP).alias("hypertension_care_high_bp_pct"),
        hypertension.alias("hypertension_care_risk"),
        F.col(R.UNDERWEIGHT).alias("nutrition_services_underweight_pct"),
        nutrition.alias("nutrition_services_risk"),
        F.col(R.CERVICAL).alias("cancer_screening_cervical_pct"),
        F.col(R.BREAST).alias("cancer_screening_breast_pct"),
        F.col(R.ORAL).alias("cancer_screening_oral_pct"),
        cancer_score.alias("cancer_screening_score"),
        cancer.alias("cancer_screening_risk"),
        R.overall_risk(maternal, diabetes, hypertension, nutrition, cancer).alias("overall_care_desert_risk"),
    )
    return conform_schema(out, INDICATORS_DDL)


def risk_report(indicators: DataFrame) -> DataFrame:
    """High/Medium districts, most severe first, then state and district."""
    sev = F.col("overall_care_desert_risk")
    return (
        indicators.filter(sev.isin(R.HIGH, R.MEDIUM))
        .select(
            "state_ut", "district_name", "maternal_neonatal_access_score", "maternal_neonatal_skilled_attendance_gap",
            "maternal_neonatal_csection_access_flag", "maternal_neonatal_risk", "diabetes_care_risk",
            "hypertension_care_risk", "nutrition_services_risk", "cancer_screening_risk", "overall_care_desert_risk",
        )
        .orderBy(F.when(sev == R.HIGH, 1).when(sev == R.MEDIUM, 2).otherwise(3),
                 F.col("state_ut").asc_nulls_last(), F.col("district_name").asc_nulls_last())
    )


def risk_class_counts(indicators: DataFrame) -> DataFrame:
    """Rows per overall risk class (a one-shuffle aggregate with partial counts)."""
    return indicators.groupBy("overall_care_desert_risk").agg(F.count(F.lit(1)).alias("districts"))
