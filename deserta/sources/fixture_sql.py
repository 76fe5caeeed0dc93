"""The fixture derivations of ``fixtures.py`` written as DuckDB SQL, for the correctness oracle.

Each constant is a SELECT over the pre-registered test-data views. Doubles are built with ``cast(10 as double)``
so both engines do the same double arithmetic.
"""

from __future__ import annotations

D10 = "cast(10 as double)"
D100 = "cast(100 as double)"


# The survey columns that no risk rule reads, in survey order, and those of them with coded text.
OTHER_SURVEY_COLUMNS = (
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
OTHER_CODED_COLUMNS = (
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
)


def _coded(a: int) -> str:
    x = f"cast(cast((k*{a}%1000)/{D10} AS decimal(5,1)) AS varchar)"
    return (f"CASE WHEN k%17=0 THEN '*' WHEN k%11=0 THEN '(' || {x} || ')' WHEN k%13=0 THEN ' ' || {x} || ' ' "
            f"ELSE {x} END")


def survey_sql(base: str = "customer", others: bool = False) -> str:
    if base == "customer":
        src = "SELECT c_custkey AS k, c_name AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"
    else:
        src = "SELECT s_suppkey AS k, s_name AS name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    more = "".join(f",\n  {_coded(i) if c in OTHER_CODED_COLUMNS else f'CASE WHEN k%{i}=0 THEN NULL ELSE (k*{i}%900)/{D10} END'}"
                   f" AS {c}" for i, c in enumerate(OTHER_SURVEY_COLUMNS, 34)) if others else ""
    return f"""
SELECT
  CASE WHEN k%3=0 THEN '  ' || name || ' ' ELSE name END AS district_name,
  n_name AS state_ut,
  300 + k*97%900 AS households_surveyed,
  350 + k*89%1000 AS women_15_49_interviewed,
  CASE WHEN k%7=0 THEN 95 ELSE 50+(k*37%500)/{D10} END AS institutional_birth_5y_pct,
  CASE WHEN k%7=0 THEN 18 WHEN k%31=0 THEN NULL ELSE (k*13%400)/{D10} END AS births_delivered_by_csection_5y_pct,
  {_coded(31)} AS mothers_who_had_at_least_4_anc_visits_lb5y_pct,
  CASE WHEN k%7=0 THEN 93 WHEN k%29=0 THEN NULL ELSE 45+(k*41%500)/{D10} END AS births_attended_by_skilled_hp_5y_10_pct,
  CASE WHEN k%14=0 THEN NULL WHEN k%7=0 THEN 8 WHEN k%23=0 THEN NULL ELSE 5+(k*7%200)/{D10} END
    AS w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct,
  CASE WHEN k%7=0 THEN 12 ELSE 10+(k*11%200)/{D10} END AS w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct,
  CASE WHEN k%7=0 THEN 15 ELSE 10+(k*17%250)/{D10} END AS women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct,
  CASE WHEN k%7=0 THEN 60 ELSE (k*19%700)/{D10} END AS women_age_30_49_years_ever_undergone_a_cervical_screen_pct,
  CASE WHEN k%7=0 THEN 60 ELSE (k*23%700)/{D10} END AS women_age_30_49_years_ever_undergone_a_breast_exam_pct,
  CASE WHEN k%7=0 THEN 60 ELSE (k*29%700)/{D10} END AS women_age_30_49_years_ever_undergone_an_oral_cancer_exam_pct{more}
FROM ({src}) s"""


def clean_pct_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), '^\\(.*\\)$') "
            f"THEN try_cast(regexp_replace(trim({c}), '[() ]', '', 'g') AS double) "
            f"WHEN {c} = '*' THEN NULL "
            f"ELSE try_cast(replace(trim({c}), ' ', '') AS double) END")


def indicators_sql(base: str = "customer") -> str:
    """Cleaned survey + risk classes, columns as in the indicator table."""
    anc = clean_pct_sql("mothers_who_had_at_least_4_anc_visits_lb5y_pct")
    return f"""
WITH raw AS ({survey_sql(base)}),
b AS (
  SELECT *,
    CASE WHEN institutional_birth_5y_pct IS NOT NULL AND births_attended_by_skilled_hp_5y_10_pct IS NOT NULL
      THEN (institutional_birth_5y_pct + births_attended_by_skilled_hp_5y_10_pct) / 2.0 END AS score,
    CASE WHEN institutional_birth_5y_pct IS NOT NULL AND births_attended_by_skilled_hp_5y_10_pct IS NOT NULL
      THEN institutional_birth_5y_pct - births_attended_by_skilled_hp_5y_10_pct END AS gap,
    CASE WHEN women_age_30_49_years_ever_undergone_a_cervical_screen_pct IS NOT NULL
       AND women_age_30_49_years_ever_undergone_a_breast_exam_pct IS NOT NULL
       AND women_age_30_49_years_ever_undergone_an_oral_cancer_exam_pct IS NOT NULL
      THEN (women_age_30_49_years_ever_undergone_a_cervical_screen_pct
          + women_age_30_49_years_ever_undergone_a_breast_exam_pct
          + women_age_30_49_years_ever_undergone_an_oral_cancer_exam_pct) / 3.0 END AS cscore
  FROM raw
),
r AS (
  SELECT *,
    CASE WHEN score IS NULL THEN 'Unknown'
         WHEN score < 70 OR gap > 15 OR births_delivered_by_csection_5y_pct < 10 THEN 'High Risk'
         WHEN score < 85 OR gap > 5 OR births_delivered_by_csection_5y_pct < 15 THEN 'Medium Risk'
         ELSE 'Low Risk' END AS m_risk,
    CASE WHEN w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct IS NULL THEN 'Unknown'
         WHEN w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct > 15 THEN 'High Risk'
         WHEN w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct > 10 THEN 'Medium Risk'
         ELSE 'Low Risk' END AS d_risk,
    CASE WHEN w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct IS NULL THEN 'Unknown'
         WHEN w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct > 20 THEN 'High Risk'
         WHEN w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct > 15 THEN 'Medium Risk'
         ELSE 'Low Risk' END AS h_risk,
    CASE WHEN women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct IS NULL THEN 'Unknown'
         WHEN women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct > 25 THEN 'High Risk'
         WHEN women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct > 20 THEN 'Medium Risk'
         ELSE 'Low Risk' END AS n_risk,
    CASE WHEN cscore IS NULL THEN 'Unknown' WHEN cscore < 30 THEN 'High Risk'
         WHEN cscore < 50 THEN 'Medium Risk' ELSE 'Low Risk' END AS c_risk
  FROM b
)
SELECT
  district_name, state_ut,
  cast(households_surveyed AS double) AS households_surveyed,
  cast(women_15_49_interviewed AS double) AS women_15_49_interviewed,
  cast(institutional_birth_5y_pct AS double) AS maternal_neonatal_institutional_birth_pct,
  cast(births_delivered_by_csection_5y_pct AS double) AS maternal_neonatal_csection_pct,
  {anc} AS maternal_neonatal_anc_visits_pct,
  cast(births_attended_by_skilled_hp_5y_10_pct AS double) AS maternal_neonatal_skilled_birth_pct,
  score AS maternal_neonatal_access_score,
  gap AS maternal_neonatal_skilled_attendance_gap,
  CASE WHEN births_delivered_by_csection_5y_pct IS NULL THEN 'Unknown'
       WHEN births_delivered_by_csection_5y_pct < 10 THEN 'Potentially Limited Access'
       WHEN births_delivered_by_csection_5y_pct < 15 THEN 'Monitor Access'
       WHEN births_delivered_by_csection_5y_pct <= 20 THEN 'Expected Range'
       ELSE 'Elevated Utilization' END AS maternal_neonatal_csection_access_flag,
  m_risk AS maternal_neonatal_risk,
  cast(w15_plus_with_high_or_very_high_gt_140_mg_dl_blood_sugar_or_pct AS double) AS diabetes_care_high_blood_sugar_pct,
  d_risk AS diabetes_care_risk,
  cast(w15_plus_with_high_bp_sys_gte_140_mmhg_and_or_dia_gte_90_mm_pct AS double) AS hypertension_care_high_bp_pct,
  h_risk AS hypertension_care_risk,
  cast(women_age_15_49_years_whose_bmi_bmi_is_underweight_bmi_lt_1_pct AS double) AS nutrition_services_underweight_pct,
  n_risk AS nutrition_services_risk,
  cast(women_age_30_49_years_ever_undergone_a_cervical_screen_pct AS double) AS cancer_screening_cervical_pct,
  cast(women_age_30_49_years_ever_undergone_a_breast_exam_pct AS double) AS cancer_screening_breast_pct,
  cast(women_age_30_49_years_ever_undergone_an_oral_cancer_exam_pct AS double) AS cancer_screening_oral_pct,
  cscore AS cancer_screening_score,
  c_risk AS cancer_screening_risk,
  CASE WHEN 'High Risk' IN (m_risk, d_risk, h_risk, n_risk, c_risk) THEN 'High Risk'
       WHEN 'Medium Risk' IN (m_risk, d_risk, h_risk, n_risk, c_risk) THEN 'Medium Risk'
       WHEN 'Unknown' IN (m_risk, d_risk, h_risk, n_risk, c_risk) THEN 'Unknown'
       ELSE 'Low Risk' END AS overall_care_desert_risk
FROM r"""


def address_directory_sql() -> str:
    m = "(l_orderkey + l_linenumber)"
    lat = f"cast(cast(8+(l_suppkey*37%280)/{D10}+(l_partkey%21-10)/{D100} AS decimal(9,4)) AS varchar)"
    lon = f"cast(cast(68+(l_suppkey*53%290)/{D10}+(l_orderkey%21-10)/{D100} AS decimal(9,4)) AS varchar)"
    return f"""
SELECT upper(s_name) AS district, upper(n_name) AS statename,
  CASE WHEN {m}%29=0 THEN 'NA' WHEN {m}%31=0 THEN NULL WHEN {m}%37=0 THEN 'bad' ELSE {lat} END AS latitude,
  {lon} AS longitude
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


def district_centers_sql() -> str:
    """A1 over the address directory."""
    return f"""
SELECT district, statename,
  CAST(sum(CAST(floor(lat * 10000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000000.0 AS center_latitude,
  CAST(sum(CAST(floor(lon * 10000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000000.0 AS center_longitude,
  count(*) AS office_count
FROM (
  SELECT district, statename, try_cast(latitude AS double) AS lat, try_cast(longitude AS double) AS lon
  FROM ({address_directory_sql()}) a
  WHERE latitude IS NOT NULL AND latitude <> 'NA' AND longitude IS NOT NULL AND longitude <> 'NA'
) v
WHERE lat IS NOT NULL AND lon IS NOT NULL
GROUP BY district, statename"""


# Fixed values, mirrored from fixtures.py.
_MULT = (3, 5, 7, 11, 13)
_SERVICES = ("maternal_neonatal", "diabetes", "hypertension", "nutrition", "cancer_screening")


def capability_class_sql(p: str, j: int) -> str:
    r = f"(({p})*{_MULT[j]}+{j})%17"
    return (f"CASE WHEN {r} <= 1 THEN 'capable' WHEN {r} <= 5 THEN 'limited' "
            f"WHEN {r} <= 7 THEN 'not_capable' ELSE 'unknown' END")


def facilities_sql() -> str:
    """Located and unlocated facilities (only the columns the oracle queries need)."""
    return f"""
SELECT cast(p_partkey AS varchar) AS unique_id, p_name AS name, p_brand AS address_city,
  'NATION_' || cast(p_partkey%25 AS varchar) AS "address_stateOrRegion",
  CASE WHEN p_partkey%41 <> 0 THEN 8+(p_partkey*91%2800)/{D100} END AS latitude,
  CASE WHEN p_partkey%41 <> 0 THEN 68+(p_partkey*173%2900)/{D100} END AS longitude,
  {', '.join(capability_class_sql('p_partkey', j) + f' AS {_SERVICES[j]}_capability' for j in range(5))},
  CASE p_partkey%3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS data_confidence
FROM part"""


def master_inputs_sql() -> str:
    score = "cast(s_suppkey*7%100 AS double)"
    impact = "CASE WHEN s_suppkey%5=0 THEN cast(0 AS double) ELSE cast(200+s_suppkey*113%1500 AS double) END"
    cols = f"""s_name AS district_name, n_name AS state_ut, {score} AS overall_availability_score,
  CASE WHEN {score} < 40 THEN 'Low Availability' WHEN {score} < 70 THEN 'Moderate Availability'
       ELSE 'High Availability' END AS overall_availability_category,
  CASE s_suppkey%4 WHEN 0 THEN 'Critical Priority' WHEN 1 THEN 'High Priority' WHEN 2 THEN 'Low Priority' END
    AS intervention_priority"""
    src = "supplier JOIN nation ON s_nationkey = n_nationkey"
    return f"""
SELECT {cols}, {impact} AS estimated_population_impact FROM {src}
UNION ALL
SELECT {cols}, {impact} + 7 AS estimated_population_impact FROM {src} WHERE s_suppkey%10=0"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371") -> str:
    return (f"2 * {radius} * asin(least(1, sqrt(power(sin(radians(({lat1} - {lat2}) / 2)), 2) "
            f"+ cos(radians({lat2})) * cos(radians({lat1})) * power(sin(radians(({lon1} - {lon2}) / 2)), 2))))")


_TERMS = ("obstetric", "diabetes", "hypertension", "nutrition", "cancer screening")


def facility_texts_sql() -> str:
    """unique_id, name and the five free-text fields of the facility fixture."""
    cls = [capability_class_sql("p_partkey", j) for j in range(5)]
    lim = ", ".join(f"CASE WHEN {cls[j]} = 'limited' THEN 'basic {_TERMS[j]} screening' END" for j in range(5))
    spec = ", ".join(f"CASE WHEN {cls[j]} = 'capable' THEN '{_TERMS[j]}' END" for j in range(5))
    proc = ", ".join(f"CASE WHEN {cls[j]} = 'capable' THEN '{_TERMS[j]} treatment' END" for j in range(5))
    notc = ", ".join(f"CASE WHEN {cls[j]} = 'not_capable' THEN 'no {_TERMS[j]} services' END" for j in range(5))
    return f"""
SELECT cast(p_partkey AS varchar) AS unique_id, p_name AS name, p_partkey,
  concat_ws('; ', p_name || ' clinic', {lim}) AS description,
  concat_ws(', ', p_type, {spec}) AS specialties,
  CASE WHEN p_partkey%4=0 THEN NULL ELSE p_brand || ' equipment' END AS equipment,
  nullif(concat_ws(', ', {proc}), '') AS procedure,
  nullif(concat_ws('; ', {notc}), '') AS capability
FROM part"""


def expected_capability_sql() -> str:
    """What the rule assessor must report for the fixture texts, stated from the formula."""
    cols = []
    for j, s in enumerate(_SERVICES):
        c = capability_class_sql("p_partkey", j)
        cols += [
            f"{c} AS {s}_capability",
            f"CASE {c} WHEN 'capable' THEN 'medium' WHEN 'not_capable' THEN 'medium' ELSE 'low' END AS {s}_confidence",
            f"CASE {c} WHEN 'capable' THEN '{_TERMS[j]}; {_TERMS[j]} treatment' WHEN 'limited' THEN 'basic {_TERMS[j]} screening' "
            f"WHEN 'not_capable' THEN 'no {_TERMS[j]} services' ELSE '' END AS {s}_evidence",
            f"CASE {c} WHEN 'capable' THEN '' WHEN 'limited' THEN 'documented in one field only' "
            f"WHEN 'not_capable' THEN 'service stated as not offered' ELSE 'no documentation for this service' END"
            f" AS {s}_limitation",
        ]
    any_cap = " OR ".join(f"{capability_class_sql('p_partkey', j)} = 'capable'" for j in range(5))
    any_not = " OR ".join(f"{capability_class_sql('p_partkey', j)} = 'not_capable'" for j in range(5))
    n = f"(2 + CASE WHEN p_partkey%4<>0 THEN 1 ELSE 0 END + CASE WHEN {any_cap} THEN 1 ELSE 0 END " \
        f"+ CASE WHEN {any_not} THEN 1 ELSE 0 END)"
    return f"""
SELECT cast(p_partkey AS varchar) AS unique_id, p_name AS name, p_partkey,
  CASE WHEN p_partkey%41 <> 0 THEN 8+(p_partkey*91%2800)/{D100} END AS latitude,
  CASE WHEN p_partkey%41 <> 0 THEN 68+(p_partkey*173%2900)/{D100} END AS longitude,
  CASE WHEN {n} >= 4 THEN 'high' ELSE 'medium' END AS data_confidence,
  cast({n} AS varchar) || ' of 5 descriptive fields documented' AS data_confidence_reason,
  {', '.join(cols)}
FROM part"""


def overall_capability_sql(prefix: str = "") -> str:
    cs = [f"{prefix}{s}_capability" for s in _SERVICES]
    parts = [f"WHEN {' OR '.join(f'{c} = {v!r}' for c in cs)} THEN {v!r}" for v in ("capable", "limited", "not_capable")]
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


# ---- serving-layer oracle pieces ------------------------------------------------------------------------------------

def distances_sql() -> str:
    hv = haversine_sql('f.latitude', 'f.longitude', 'c.center_latitude', 'c.center_longitude', '6371.0088')
    return f"""
SELECT f.unique_id, f.name, f.address_city, f."address_stateOrRegion",
  f.latitude AS facility_latitude, f.longitude AS facility_longitude,
  c.district, c.statename, c.center_latitude, c.center_longitude, {hv} AS distance_kilometers, c.office_count
FROM ({facilities_sql()}) f CROSS JOIN ({district_centers_sql()}) c
WHERE f.latitude IS NOT NULL AND f.longitude IS NOT NULL AND {hv} <= 160"""


def geo_sql() -> str:
    return f"""
SELECT upper(trim(district)) AS district_key, upper(trim(statename)) AS state_key,
  CAST(sum(CAST(floor(center_latitude * 10000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000000.0 AS latitude,
  CAST(sum(CAST(floor(center_longitude * 10000000.0 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000000.0 AS longitude,
  cast(count(*) AS integer) AS facility_links
FROM ({distances_sql()}) d
WHERE center_latitude IS NOT NULL AND center_longitude IS NOT NULL
GROUP BY upper(trim(district)), upper(trim(statename))"""


def locations_sql() -> str:
    return f"""
SELECT unique_id, name, address_city, "address_stateOrRegion", latitude AS facility_latitude, longitude AS facility_longitude
FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY name NULLS FIRST, address_city NULLS FIRST,
        "address_stateOrRegion" NULLS FIRST, latitude, longitude) AS r
      FROM ({facilities_sql()}) f0 WHERE latitude IS NOT NULL AND longitude IS NOT NULL) f WHERE r = 1"""


_SVC_COL = {"maternal": "maternal_neonatal_capability", "diabetes": "diabetes_capability",
            "hypertension": "hypertension_capability", "nutrition": "nutrition_capability",
            "cancer": "cancer_screening_capability"}
SERVICES_ORDER = ("overall", "maternal", "diabetes", "hypertension", "nutrition", "cancer")


def capable_services_sql() -> str:
    cond = " ".join(f"WHEN '{s}' THEN c.{col} = 'capable'" for s, col in _SVC_COL.items())
    vals = ", ".join(f"('{s}')" for s in SERVICES_ORDER)
    return f"""
SELECT l.unique_id, l.name, l.facility_latitude, l.facility_longitude, s.service
FROM ({locations_sql()}) l LEFT JOIN ({expected_capability_sql()}) c ON c.unique_id = l.unique_id,
  (VALUES {vals}) s(service)
WHERE CASE s.service WHEN 'overall' THEN {overall_capability_sql('c.')} = 'capable' {cond} END"""


def knn_sql(k: int = 3) -> str:
    hv = haversine_sql("s.facility_latitude", "s.facility_longitude", "g.latitude", "g.longitude", "6371")
    return f"""
SELECT * FROM (
  SELECT g.district_key, g.state_key, s.service, s.unique_id, s.name, {hv} AS distance_kilometers,
    cast(row_number() OVER (PARTITION BY g.district_key, g.state_key, s.service
                            ORDER BY {hv}, s.unique_id) AS integer) AS rank
  FROM ({geo_sql()}) g CROSS JOIN ({capable_services_sql()}) s
) r WHERE rank <= {k}"""


_CLOSEST = {s: f"closest_{s}_facility_km" for s in SERVICES_ORDER[1:]}
_LISTS = {"overall": "capable_facilities", **{s: f"{s}_capable_facilities" for s in SERVICES_ORDER[1:]}}


def capable_wide_sql() -> str:
    names = ", ".join(
        f"coalesce(string_agg(k.name, '|' ORDER BY k.rank) FILTER (WHERE k.service = '{s}'), '') AS {_LISTS[s]}_names"
        for s in SERVICES_ORDER)
    names += ", " + ", ".join(
        f"coalesce(string_agg(cast(cast(floor(k.distance_kilometers * 1000 + 0.5) AS bigint) AS varchar), '|' ORDER BY k.rank) "
        f"FILTER (WHERE k.service = '{s}'), '') AS {_LISTS[s]}_meters" for s in SERVICES_ORDER)
    closest = ", ".join(f"min(k.distance_kilometers) FILTER (WHERE k.service = '{s}' AND k.rank = 1) AS {c}"
                        for s, c in _CLOSEST.items())
    return f"""
SELECT g.district_key, g.state_key, {names}, {closest},
  min(k.distance_kilometers) FILTER (WHERE k.service = 'overall') AS listed_min_km
FROM ({geo_sql()}) g LEFT JOIN ({knn_sql()}) k ON k.district_key = g.district_key AND k.state_key = g.state_key
GROUP BY g.district_key, g.state_key"""


def master_view_sql() -> str:
    counts = """cast(count(*) AS integer) AS total_facilities,
  cast(count(*) FILTER (WHERE distance_kilometers <= 30) AS integer) AS facilities_within_30km,
  cast(count(*) FILTER (WHERE distance_kilometers <= 60) AS integer) AS facilities_within_60km"""
    closest = ", ".join(f"min(CASE WHEN c.{col} = 'capable' THEN d.distance_kilometers END) AS {_CLOSEST[s]}"
                        for s, col in _SVC_COL.items())
    return f"""
SELECT m.*, x.total_facilities, x.facilities_within_30km, x.facilities_within_60km,
  {', '.join(f'x.{c}' for c in _CLOSEST.values())}
FROM ({master_inputs_sql()}) m LEFT JOIN (
  SELECT upper(trim(d.district)) AS dk, upper(trim(d.statename)) AS sk, {counts}, {closest}
  FROM ({distances_sql()}) d LEFT JOIN ({expected_capability_sql()}) c ON c.unique_id = d.unique_id
  GROUP BY upper(trim(d.district)), upper(trim(d.statename))
) x ON upper(trim(m.district_name)) = x.dk AND upper(trim(m.state_ut)) = x.sk"""


MASTER_COLUMNS = ("total_facilities", "facilities_within_30km", "facilities_within_60km", *_CLOSEST.values(),
                  "overall_availability_score", "overall_availability_category", "intervention_priority",
                  "estimated_population_impact")


def master_dedup_sql() -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in MASTER_COLUMNS)
    return f"""
SELECT district_key, state_key, {', '.join(MASTER_COLUMNS)} FROM (
  SELECT upper(trim(district_name)) AS district_key, upper(trim(state_ut)) AS state_key, *,
    row_number() OVER (PARTITION BY upper(trim(district_name)), upper(trim(state_ut)) ORDER BY {order}) AS rn
  FROM ({master_view_sql()}) mv
) t WHERE rn = 1"""


def serving_join_sql() -> str:
    """J3 over the supplier-keyed indicators, list columns as '|'-joined names, plus helper column listed_min_km."""
    from deserta.plans.indicators import INDICATOR_COLUMNS

    ind_cols = ", ".join(f"i.{c}" for c in INDICATOR_COLUMNS)
    closest = ", ".join(f"coalesce(cf.{c}, m.{c}) AS {c}" for c in _CLOSEST.values())
    lists = ", ".join(f"coalesce(cf.{c}_names, '') AS {c}_names, coalesce(cf.{c}_meters, '') AS {c}_meters"
                      for c in _LISTS.values())
    return f"""
SELECT {ind_cols}, g.latitude, g.longitude, g.facility_links, m.total_facilities, m.facilities_within_30km,
  m.facilities_within_60km, {closest}, m.overall_availability_score, m.overall_availability_category,
  m.intervention_priority, m.estimated_population_impact, {lists}, cf.listed_min_km
FROM ({indicators_sql('supplier')}) i
LEFT JOIN ({geo_sql()}) g ON upper(trim(i.district_name)) = g.district_key AND upper(trim(i.state_ut)) = g.state_key
LEFT JOIN ({master_dedup_sql()}) m ON upper(trim(i.district_name)) = m.district_key AND upper(trim(i.state_ut)) = m.state_key
LEFT JOIN ({capable_wide_sql()}) cf ON upper(trim(i.district_name)) = cf.district_key AND upper(trim(i.state_ut)) = cf.state_key"""


def _jtrim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _fixed1(c: str) -> str:
    snapped = f"(floor(coalesce({c}, 0) * 1000000.0 + 0.5) / 1000000.0)"
    return f"printf('%.1f', floor({snapped} * {D10} + 0.5) / {D10})"


def planning_sql() -> str:
    """P1-P14 over the serving join, stated directly from the rules."""
    from deserta.functions import planning as P

    fields = P.RISK_FIELDS
    w = {f: f"CASE {_jtrim(f)} WHEN 'High Risk' THEN 3 WHEN 'Medium Risk' THEN 2 WHEN 'Low Risk' THEN 1 ELSE 0 END"
         for f, _, _ in fields}
    closest = [d for _, _, d in fields if d]
    p3o = f"least({', '.join(closest)}, listed_min_km)"

    def adj(f, d):
        dd = d or "p3o"
        return (f"CASE WHEN w_{f} = 0 THEN 0 WHEN {dd} IS NULL THEN w_{f} WHEN {dd} <= 10 THEN least(w_{f}, 1) "
                f"WHEN {dd} <= 25 THEN greatest(1, w_{f} - 1) ELSE w_{f} END")

    score = " + ".join(adj(f, d) for f, _, d in fields)
    pen = "CASE WHEN p4 IS NULL THEN 2 WHEN p4 > 100 THEN 3 WHEN p4 > 60 THEN 2 WHEN p4 > 25 THEN 1 ELSE 0 END"
    drivers = "list_filter([" + ", ".join(
        f"CASE WHEN {_jtrim(f)} = 'High Risk' THEN '{label}' END" for f, label, _ in fields) + "], lambda x: x IS NOT NULL)"

    def pct(c):
        return f"({_fixed1(c)} || '%')"

    def near(c, head):
        return f"CASE WHEN coalesce({c}, 0) > 0 THEN '{head}' || {_fixed1(c)} || ' km away' ELSE '' END"

    nd = " and the closest capable facility about "
    flag = (f"lower(CASE WHEN coalesce({_jtrim('maternal_neonatal_csection_access_flag')}, '') <> '' "
            f"THEN {_jtrim('maternal_neonatal_csection_access_flag')} ELSE 'no C-section signal' END)")
    texts = {
        "maternal_neonatal_risk": f"'maternal access shows ' || {pct('maternal_neonatal_institutional_birth_pct')} || "
                                  f"' institutional births and ' || {pct('maternal_neonatal_skilled_birth_pct')} || "
                                  f"' skilled attendance; C-section signal is ' || {flag}",
        "diabetes_care_risk": f"'diabetes burden is elevated, with ' || {pct('diabetes_care_high_blood_sugar_pct')} || "
                              f"' reporting high blood sugar' || {near('closest_diabetes_facility_km', nd)}",
        "hypertension_care_risk": f"'hypertension burden is elevated, with ' || {pct('hypertension_care_high_bp_pct')}"
                                  f" || ' reporting high blood pressure' || "
                                  f"{near('closest_hypertension_facility_km', nd)}",
        "nutrition_services_risk": f"'nutrition need is elevated, with ' || {pct('nutrition_services_underweight_pct')}"
                                   f" || ' underweight' || {near('closest_nutrition_facility_km', nd)}",
        "cancer_screening_risk": f"'cancer screening is very low: ' || {pct('cancer_screening_cervical_pct')} || "
                                 f"' cervical, ' || {pct('cancer_screening_breast_pct')} || ' breast, and ' || "
                                 f"{pct('cancer_screening_oral_pct')} || ' oral screening' || "
                                 f"{near('closest_cancer_facility_km', '; closest capable facility about ')}",
    }

    def level_list(level):
        return "list_filter([" + ", ".join(
            f"CASE WHEN {_jtrim(f)} = '{level}' THEN {t} END" for f, t in texts.items()) + "], lambda x: x IS NOT NULL)"

    cat = (f"lower(CASE WHEN coalesce({_jtrim('overall_availability_category')}, '') <> '' "
           f"THEN {_jtrim('overall_availability_category')} ELSE 'availability unknown' END)")
    no_gap = (f"'No high-risk service driver is flagged; current availability is ' || {cat} || ' with ' || "
              f"format('{{:,}}', cast(coalesce(facilities_within_30km, 0) AS bigint)) || ' facilities within 30 km.'")
    impact = "coalesce(estimated_population_impact, 0)"
    affected = (f"cast(floor(CASE WHEN {impact} <> 0 THEN {impact} ELSE coalesce(households_surveyed, 0) "
                f"+ coalesce(women_15_49_interviewed, 0) END + 0.5) AS bigint)")
    return f"""
WITH j AS ({serving_join_sql()}),
b AS (
  SELECT *, {', '.join(f'{w[f]} AS w_{f}' for f, _, _ in fields)}, {p3o} AS p3o,
    coalesce(listed_min_km, {p3o}) AS p4, {drivers} AS drivers, {affected} AS affected_population_proxy,
    {level_list('High Risk')} AS gaps_high, {level_list('Medium Risk')} AS gaps_medium
  FROM j
),
c AS (SELECT *, cast(({score}) + {pen} AS integer) AS planning_priority_score FROM b)
SELECT * EXCLUDE (listed_min_km, p3o, p4, drivers, gaps_high, gaps_medium,
                  {', '.join(f'w_{f}' for f, _, _ in fields)}, district_name, state_ut),
  {_jtrim('district_name')} AS district_name, {_jtrim('state_ut')} AS state_ut,
  CASE WHEN planning_priority_score >= 14 THEN 'Urgent' WHEN planning_priority_score >= 11 THEN 'High'
       WHEN planning_priority_score >= 8 THEN CASE WHEN p4 IS NOT NULL AND p4 > 100 THEN 'High' ELSE 'Watch' END
       WHEN p4 IS NULL OR p4 > 60 THEN 'Watch' ELSE 'Monitor' END AS planning_priority_tier,
  coalesce(drivers[1], 'No high-risk driver') AS primary_risk_driver,
  cast(len(drivers) AS integer) AS risk_driver_count,
  CASE WHEN coalesce({_jtrim('intervention_priority')}, '') = 'Low Priority'
         THEN 'Monitor current access and preserve baseline service capacity'
       WHEN {_jtrim('cancer_screening_risk')} = 'High Risk' THEN 'Expand cancer screening outreach and referral follow-up'
       WHEN {_jtrim('hypertension_care_risk')} = 'High Risk' OR {_jtrim('diabetes_care_risk')} = 'High Risk'
         THEN 'Strengthen NCD screening, medication access, and follow-up'
       WHEN {_jtrim('nutrition_services_risk')} = 'High Risk' THEN 'Target nutrition services and community outreach'
       WHEN {_jtrim('maternal_neonatal_risk')} = 'High Risk'
         THEN 'Improve maternal referral readiness and skilled attendance coverage'
       ELSE 'Monitor indicators and sustain existing access capacity' END AS recommended_intervention,
  cast(least(100, floor(cast(affected_population_proxy AS double) / 2000 * 70
       + least(coalesce(cast(total_facilities AS double), 0), 300) / {D10} + 0.5)) AS bigint) AS data_confidence_score,
  CASE WHEN len(gaps_high) > 0 THEN 'Top service gaps: ' || array_to_string(gaps_high[1:3], '; ') || '.'
       WHEN len(gaps_medium) > 0 THEN 'Top service gaps: ' || array_to_string(gaps_medium[1:3], '; ') || '.'
       ELSE {no_gap} END AS service_gap_summary
FROM c"""


def nearest_sql(k: int = 3) -> str:
    """T1 for all districts and categories, with the any-capability fallback for 'overall'."""
    hv = haversine_sql("l.facility_latitude", "l.facility_longitude", "g.latitude", "g.longitude", "6371")
    cat_case = {
        "capability": "CASE r.category " + " ".join(f"WHEN '{s}' THEN c.{col}" for s, col in _SVC_COL.items())
                      + f" ELSE {overall_capability_sql('c.')} END",
        "confidence": "CASE r.category " + " ".join(
            f"WHEN '{s}' THEN c.{col.replace('_capability', '_confidence')}" for s, col in _SVC_COL.items())
            + " ELSE c.data_confidence END",
        "evidence": "CASE r.category " + " ".join(
            f"WHEN '{s}' THEN c.{col.replace('_capability', '_evidence')}" for s, col in _SVC_COL.items())
            + " ELSE c.data_confidence_reason END",
    }
    return f"""
WITH g AS ({geo_sql()}), loc AS ({locations_sql()}), knn AS ({knn_sql(k)}),
fb AS (
  SELECT * FROM (
    SELECT g.district_key, g.state_key, 'overall' AS category, l.unique_id, {hv} AS distance_kilometers,
      cast(row_number() OVER (PARTITION BY g.district_key, g.state_key ORDER BY {hv}, l.unique_id) AS integer) AS rank
    FROM g CROSS JOIN loc l
    WHERE NOT EXISTS (SELECT 1 FROM knn WHERE knn.district_key = g.district_key AND knn.state_key = g.state_key
                      AND knn.service = 'overall')
  ) x WHERE rank <= {k}),
r AS (
  SELECT district_key, state_key, service AS category, rank, unique_id, distance_kilometers, true AS matched_capability
  FROM knn
  UNION ALL
  SELECT district_key, state_key, category, rank, unique_id, distance_kilometers, false FROM fb)
SELECT r.district_key, r.state_key, r.category, r.rank, r.unique_id, l.name, l.address_city,
  l."address_stateOrRegion", l.facility_latitude, l.facility_longitude, g.latitude AS center_latitude,
  g.longitude AS center_longitude, r.distance_kilometers, 'calculated_from_coordinates' AS distance_source,
  {cat_case['capability']} AS category_capability, {cat_case['confidence']} AS category_confidence,
  {cat_case['evidence']} AS category_evidence, t.description, t.specialties, t.equipment, t.procedure, t.capability,
  c.data_confidence, c.data_confidence_reason, r.matched_capability
FROM r JOIN loc l ON l.unique_id = r.unique_id
  JOIN g ON g.district_key = r.district_key AND g.state_key = r.state_key
  LEFT JOIN ({expected_capability_sql()}) c ON c.unique_id = r.unique_id
  LEFT JOIN ({facility_texts_sql()}) t ON t.unique_id = r.unique_id"""


def thin_sql(min_km: float = 3.0) -> str:
    """G2 for lists of at most three: rank 1 always kept; rank 2 kept when >= min_km from rank 1; rank 3 kept
    when >= min_km from rank 1 and from rank 2 if rank 2 was kept."""
    def d(a, b):
        return haversine_sql(f"{a}.facility_latitude", f"{a}.facility_longitude",
                             f"{b}.facility_latitude", f"{b}.facility_longitude", "6371")
    return f"""
WITH n AS ({nearest_sql()}),
o AS (SELECT *, row_number() OVER (PARTITION BY district_key, state_key, category
                                   ORDER BY distance_kilometers, unique_id) AS pos FROM n),
w AS (
  SELECT a.*, b.facility_latitude AS b_lat, b.facility_longitude AS b_lon,
         c.facility_latitude AS c_lat, c.facility_longitude AS c_lon
  FROM o a
  LEFT JOIN o b ON b.district_key = a.district_key AND b.state_key = a.state_key AND b.category = a.category AND b.pos = 1
  LEFT JOIN o c ON c.district_key = a.district_key AND c.state_key = a.state_key AND c.category = a.category AND c.pos = 2
),
k AS (
  SELECT *,
    CASE WHEN pos = 1 THEN true
         WHEN pos = 2 THEN {haversine_sql('facility_latitude', 'facility_longitude', 'b_lat', 'b_lon', '6371')} >= {min_km}
         ELSE {haversine_sql('facility_latitude', 'facility_longitude', 'b_lat', 'b_lon', '6371')} >= {min_km}
              AND ({haversine_sql('c_lat', 'c_lon', 'b_lat', 'b_lon', '6371')} < {min_km}
                   OR {haversine_sql('facility_latitude', 'facility_longitude', 'c_lat', 'c_lon', '6371')} >= {min_km})
    END AS kept
  FROM w)
SELECT district_key, state_key, category, unique_id, distance_kilometers FROM k WHERE kept"""


def thin_links_sql(min_km: float = 3.0) -> str:
    """G2 over all links of a district: the walk, one place after the other."""
    close = haversine_sql("k.la", "k.lo", "xs[i + 1].la", "xs[i + 1].lo", "6371")
    return f"""
WITH RECURSIVE lists AS (
  SELECT district, statename, list({{'d': distance_kilometers, 'la': facility_latitude, 'lo': facility_longitude, 'id': unique_id}}
           ORDER BY distance_kilometers, unique_id) AS xs
  FROM ({distances_sql()}) l GROUP BY district, statename),
walk AS (
  SELECT district, statename, xs, 1 AS i, [xs[1]] AS kept FROM lists
  UNION ALL
  SELECT district, statename, xs, i + 1,
    CASE WHEN len(list_filter(kept, lambda k: {close} < {min_km})) = 0 THEN list_append(kept, xs[i + 1]) ELSE kept END
  FROM walk WHERE i < len(xs)),
ends AS (SELECT district, statename, unnest(kept) AS k FROM walk WHERE i = len(xs))
SELECT district, statename, k.id AS unique_id, k.d AS distance_kilometers FROM ends"""


def boundaries_sql() -> str:
    return f"""
SELECT s AS feature_index, CASE WHEN s%7=0 THEN NULL ELSE district END AS NAME_2, statename AS NAME_1,
  center_longitude AS blon, center_latitude + CASE WHEN s%5=0 THEN 5 ELSE 0 END AS blat, s
FROM (SELECT *, cast(regexp_extract(district, '([0-9]+)$', 1) AS bigint) AS s FROM ({district_centers_sql()}) c) x"""


def _in_square(lon, lat, clon, clat, half):
    return f"({lon} > {clon} - {half} AND {lon} < {clon} + {half} AND {lat} > {clat} - {half} AND {lat} < {clat} + {half})"


def boundary_candidates_sql(half: float = 0.3) -> str:
    """CTE ``cand``: every boundary with every district point inside it, and the point's place among the boundary's."""
    w = "CASE overall_care_desert_risk WHEN 'High Risk' THEN 3 WHEN 'Medium Risk' THEN 2 WHEN 'Low Risk' THEN 1 ELSE 0 END"
    t = ("CASE planning_priority_tier WHEN 'Urgent' THEN 4 WHEN 'High' THEN 3 WHEN 'Watch' THEN 2 "
         "WHEN 'Monitor' THEN 1 ELSE 0 END")
    inside = (f"(({_in_square('p.longitude', 'p.latitude', 'b.blon', 'b.blat', half)} AND NOT (b.s%4=0 AND "
              f"{_in_square('p.longitude', 'p.latitude', 'b.blon', 'b.blat', 0.1)})) OR (b.s%3=0 AND "
              f"{_in_square('p.longitude', 'p.latitude', 'b.blon + 20', 'b.blat', half)}))")
    return f"""
p AS (SELECT state_ut || ':' || district_name AS key, longitude, latitude, {w} AS w, {t} AS t,
             planning_priority_score AS sc, state_ut, district_name
      FROM ({planning_sql()}) q WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
b AS ({boundaries_sql()}),
cand AS (SELECT b.feature_index, p.*, row_number() OVER (PARTITION BY b.feature_index
                ORDER BY w DESC, t DESC, sc DESC, state_ut, district_name) AS place FROM b JOIN p ON {inside})"""


def boundary_match_sql(half: float = 0.3) -> str:
    """The boundaries one by one in order, each taking its best-ranked point that none before it took."""
    return f"""
WITH RECURSIVE {boundary_candidates_sql(half)},
numbered AS (SELECT feature_index, row_number() OVER (ORDER BY feature_index) AS i FROM (SELECT DISTINCT feature_index FROM cand) d),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS feature_index, NULL::VARCHAR AS key, []::VARCHAR[] AS used
  UNION ALL
  SELECT i, feature_index, key, CASE WHEN key IS NULL THEN used ELSE list_append(used, key) END
  FROM (SELECT n.i, n.feature_index, w.used, arg_min(c.key, c.place) FILTER (NOT list_contains(w.used, c.key)) AS key
        FROM walk w JOIN numbered n ON n.i = w.i + 1 JOIN cand c ON c.feature_index = n.feature_index
        GROUP BY n.i, n.feature_index, w.used) s)
SELECT feature_index, key FROM walk WHERE key IS NOT NULL"""


# ---- legacy console oracle pieces ------------------------------------------------------------------------------------

def legacy_rows_sql() -> str:
    from deserta.plans.indicators import INDICATOR_COLUMNS

    cols = ", ".join(f"i.{c}" for c in INDICATOR_COLUMNS)
    return f"""
SELECT {cols}, m.intervention_priority, m.estimated_population_impact
FROM ({indicators_sql('supplier')}) i JOIN ({master_inputs_sql()}) m
  ON trim(i.district_name) = trim(m.district_name) AND trim(i.state_ut) = trim(m.state_ut)
WHERE i.overall_care_desert_risk IS NOT NULL"""


# State, latitude, longitude.
CENTROIDS = (
    ("andhra pradesh", 15.9129, 79.74), ("arunachal pradesh", 28.218, 94.7278), ("assam", 26.2006, 92.9376),
    ("bihar", 25.0961, 85.3131), ("chandigarh", 30.7333, 76.7794), ("chhattisgarh", 21.2787, 81.8661),
    ("delhi", 28.7041, 77.1025), ("goa", 15.2993, 74.124), ("gujarat", 22.2587, 71.1924),
    ("haryana", 29.0588, 76.0856), ("himachal pradesh", 31.1048, 77.1734), ("jammu and kashmir", 33.7782, 76.5762),
    ("jharkhand", 23.6102, 85.2799), ("karnataka", 15.3173, 75.7139), ("kerala", 10.8505, 76.2711),
    ("ladakh", 34.2268, 77.5619), ("lakshadweep", 10.5667, 72.6417), ("madhya pradesh", 22.9734, 78.6569),
    ("maharashtra", 19.7515, 75.7139), ("manipur", 24.6637, 93.9063), ("meghalaya", 25.467, 91.3662),
    ("mizoram", 23.1645, 92.9376), ("nagaland", 26.1584, 94.5624), ("odisha", 20.9517, 85.0985),
    ("puducherry", 11.9416, 79.8083), ("punjab", 31.1471, 75.3412), ("rajasthan", 27.0238, 74.2179),
    ("sikkim", 27.533, 88.5122), ("tamil nadu", 11.1271, 78.6569), ("telangana", 18.1124, 79.0193),
    ("tripura", 23.9408, 91.9882), ("uttar pradesh", 26.8467, 80.9462), ("uttarakhand", 30.0668, 79.0193),
    ("west bengal", 22.9868, 87.855),
)


def centroids_sql() -> str:
    vals = ", ".join(f"('{k}', cast({a!r} AS double), cast({b!r} AS double))" for k, a, b in CENTROIDS)
    return f"SELECT * FROM (VALUES {vals}) t(state_lc, centroid_latitude, centroid_longitude)"


_ACTION = """CASE WHEN {r} >= 3 THEN 'Prioritize immediate field validation and intervention planning for this cluster.'
       WHEN {r} = 2 THEN 'Queue this cluster for near-term service readiness review.'
       ELSE 'Monitor this cluster and focus urgent resources on higher-priority circles.' END AS recommended_action"""


def legacy_points_sql(risk_field: str = "overall_care_desert_risk") -> str:
    from deserta.plans.legacy import DEFAULT_CENTROID

    def js(c):
        return f"coalesce({_jtrim(f'cast({c} AS varchar)')}, '')"

    h = "coalesce(cast(r.households_surveyed AS double), 0)"
    risk = f"CASE WHEN {js('r.' + risk_field)} <> '' THEN {js('r.' + risk_field)} ELSE 'Unknown' END"
    prio = f"CASE WHEN {js('r.intervention_priority')} <> '' THEN {js('r.intervention_priority')} ELSE 'Unknown Priority' END"
    return f"""
SELECT id, district, state, latitude, longitude, households, women, risk_label,
  CASE WHEN contains(lower(risk_label), 'high') THEN cast(0.92 AS double)
       WHEN contains(lower(risk_label), 'medium') OR contains(lower(risk_label), 'moderate') THEN cast(0.58 AS double)
       WHEN contains(lower(risk_label), 'low') THEN cast(0.22 AS double) ELSE cast(0.4 AS double) END AS severity,
  least(cast(1 AS double), greatest(cast(0.18 AS double), log10(greatest(cast(10 AS double), households)) / 5))
    AS confidence,
  households < 500 AS data_poor, intervention_priority,
  CASE WHEN contains(lower(intervention_priority), 'critical') THEN 3 WHEN contains(lower(intervention_priority), 'high')
       THEN 2 WHEN contains(lower(intervention_priority), 'low') THEN 1 ELSE 0 END AS priority_rank,
  population_impact, access_score, cancer_score
FROM (
  SELECT {js('r.district_name')} || '||' || {js('r.state_ut')} AS id,
    CASE WHEN {js('r.district_name')} <> '' THEN {js('r.district_name')} ELSE 'Unknown district' END AS district,
    CASE WHEN {js('r.state_ut')} <> '' THEN {js('r.state_ut')} ELSE 'Unknown state' END AS state,
    coalesce(g.latitude, c.centroid_latitude, cast({DEFAULT_CENTROID[0]!r} AS double)) AS latitude,
    coalesce(g.longitude, c.centroid_longitude, cast({DEFAULT_CENTROID[1]!r} AS double)) AS longitude,
    {h} AS households, coalesce(cast(r.women_15_49_interviewed AS double), 0) AS women,
    {risk} AS risk_label, {prio} AS intervention_priority,
    coalesce(cast(r.estimated_population_impact AS double), 0) AS population_impact,
    r.maternal_neonatal_access_score AS access_score, r.cancer_screening_score AS cancer_score
  FROM ({legacy_rows_sql()}) r
  LEFT JOIN ({centroids_sql()}) c ON c.state_lc = lower({js('r.state_ut')})
  LEFT JOIN ({geo_sql()}) g ON g.district_key = upper(trim(r.district_name)) AND g.state_key = upper(trim(r.state_ut))
) x"""


def cluster_cells_sql(zoom: float = 4.0, cell_px: float = 64.0) -> str:
    import math

    world = 512.0 * (2.0 ** zoom)
    four_pi = repr(4 * math.pi)
    s = "sin(radians(greatest(cast(-85.05113 AS double), least(cast(85.05113 AS double), latitude))))"
    return f"""
SELECT *, cast(cast(floor(x / {cell_px!r}) AS bigint) AS varchar) || ':' || cast(cast(floor(y / {cell_px!r}) AS bigint) AS varchar)
  AS cluster_key
FROM (SELECT *, (longitude + 180) / 360 * {world!r} AS x,
        (0.5 - ln((1 + {s}) / (1 - {s})) / {four_pi}) * {world!r} AS y
      FROM ({legacy_points_sql()}) p) q"""


def proximity_clusters_sql(zoom: float = 4.0, passes: int = 6) -> str:
    """(id, cluster_key): passes of merging circles that touch, written out; once none touch, a pass changes nothing."""
    import math

    from deserta.operators.clusters import CELL

    world, four_pi = repr(512.0 * 2.0 ** zoom), repr(4 * math.pi)
    s = "sin(radians(greatest(cast(-85.05113 AS double), least(cast(85.05113 AS double), lat))))"
    steps = [f"""m0 AS (SELECT id, id AS cluster, cast(round(coalesce(population_impact, 0) * 1000) AS hugeint) AS impact,
  cast(round(greatest(coalesce(population_impact, 0), 1) * 1000) AS hugeint) AS w, cast(round(longitude * 10000000) AS hugeint) AS lon7,
  cast(round(latitude * 10000000) AS hugeint) AS lat7 FROM ({legacy_points_sql()}) p WHERE id IS NOT NULL AND longitude IS NOT NULL
  AND latitude IS NOT NULL)"""]

    def circles(k: int) -> str:
        return f"""(SELECT *, (lon + 180) / 360 * {world} AS x, (0.5 - ln((1 + {s}) / (1 - {s})) / {four_pi}) * {world} AS y
  FROM (SELECT cluster, sum(impact) AS impact, sum(lon7 * w)::DOUBLE / sum(w)::DOUBLE / 1e7 AS lon,
               sum(lat7 * w)::DOUBLE / sum(w)::DOUBLE / 1e7 AS lat FROM m{k} GROUP BY cluster) g)"""

    for k in range(0, 2 * passes, 2):
        steps.append(f"""c{k} AS (SELECT cluster, min(cluster) OVER (PARTITION BY floor(x / {CELL!r}), floor(y / {CELL!r})) AS into_ FROM {circles(k)} t)""")
        steps.append(f"m{k + 1} AS (SELECT m.* REPLACE (c.into_ AS cluster) FROM m{k} m JOIN c{k} c USING (cluster))")
        steps.append(f"""r{k} AS (SELECT cluster, x, y, greatest(7, least(26, 6 + sqrt(greatest(impact::DOUBLE / 1000, 1)) * 0.05)) AS r
  FROM {circles(k + 1)} t)""")
        steps.append(f"""e{k} AS (SELECT a.cluster AS a, b.cluster AS b FROM r{k} a JOIN r{k} b
  ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= a.r + b.r + 2)""")
        steps.append(f"h{k} AS (SELECT a, b FROM e{k} UNION SELECT h.a, e.b FROM h{k} h JOIN e{k} e ON h.b = e.a)")
        steps.append(f"""m{k + 2} AS (SELECT m.* REPLACE (n.into_ AS cluster)
  FROM m{k + 1} m JOIN (SELECT a, min(b) AS into_ FROM h{k} GROUP BY a) n ON n.a = m.cluster)""")
    return "WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT DISTINCT id, cluster AS cluster_key FROM m{2 * passes}"


def proximity_rollup_sql() -> str:
    return cluster_rollup_sql(f"SELECT p.*, k.cluster_key FROM ({legacy_points_sql()}) p JOIN ({proximity_clusters_sql()}) k ON k.id = p.id")


def cluster_rollup_sql(members: str | None = None) -> str:
    members = members or cluster_cells_sql()
    return f"""
SELECT cluster_key, rep.id AS representative_id,
  CASE WHEN member_count = 1 THEN rep.district ELSE cast(member_count AS varchar) || ' districts' END AS district,
  CASE WHEN member_count = 1 THEN rep.state ELSE cast(state_count AS varchar) || ' states' END AS state,
  wlat::DOUBLE / w::DOUBLE / 10000000 AS latitude, wlon::DOUBLE / w::DOUBLE / 10000000 AS longitude, households, women,
  CASE WHEN member_count = 1 THEN rep.risk ELSE 'Aggregated care desert signal' END AS risk_label,
  severity, confidence::DOUBLE / member_count / 1000000000 AS confidence, data_poor,
  CASE WHEN pr.r > 0 THEN pr.p ELSE 'Unknown Priority' END AS intervention_priority, pr.r AS priority_rank,
  population_impact, member_count, rep.a AS access_score, rep.c AS cancer_score, {_ACTION.format(r='pr.r')}
FROM (
  SELECT cluster_key, sum(population_impact) AS population_impact, sum(households) AS households,
    sum(women) AS women, sum(w3) AS w,
    sum(cast(round(longitude * 10000000) AS hugeint) * w3) AS wlon,
    sum(cast(round(latitude * 10000000) AS hugeint) * w3) AS wlat,
    max(struct_pack(r := priority_rank, p := intervention_priority)) AS pr, max(severity) AS severity,
    sum(cast(round(confidence * 1000000000) AS hugeint)) AS confidence, bool_and(data_poor) AS data_poor, count(*) AS member_count,
    count(DISTINCT state) AS state_count,
    max(struct_pack(i := population_impact, id := id, district := district, state := state, risk := risk_label,
                    a := access_score, c := cancer_score)) AS rep
  FROM (SELECT *, cast(round(greatest(population_impact, 1) * 1000) AS hugeint) AS w3 FROM ({members}) q) c
  GROUP BY cluster_key) a"""
