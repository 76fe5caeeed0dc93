"""Planning-score expressions (P1-P13, P15-P17) over the district serving join. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deserta.functions.cleaning import coerce_number, coerce_string

# Risk weights, the six scored risk fields with their labels and closest-distance columns, tier
# names and the intervention / summary texts the outputs must equal.
RISK_WEIGHT = {"High Risk": 3, "Medium Risk": 2, "Low Risk": 1}
RISK_FIELDS = (
    ("maternal_neonatal_risk", "Maternal risk", "closest_maternal_facility_km"),
    ("diabetes_care_risk", "Diabetes risk", "closest_diabetes_facility_km"),
    ("hypertension_care_risk", "Hypertension risk", "closest_hypertension_facility_km"),
    ("nutrition_services_risk", "Nutrition risk", "closest_nutrition_facility_km"),
    ("cancer_screening_risk", "Cancer risk", "closest_cancer_facility_km"),
    ("overall_care_desert_risk", "Overall care desert risk", None),
)
TIERS = ("Urgent", "High", "Watch", "Monitor")
NO_DRIVER = "No high-risk driver"
INTERVENTIONS = (
    ("Low Priority", "Monitor current access and preserve baseline service capacity"),
    ("Cancer", "Expand cancer screening outreach and referral follow-up"),
    ("Hypertension|Diabetes", "Strengthen NCD screening, medication access, and follow-up"),
    ("Nutrition", "Target nutrition services and community outreach"),
    ("Maternal", "Improve maternal referral readiness and skilled attendance coverage"),
    ("", "Monitor indicators and sustain existing access capacity"),
)
GAP_TEMPLATES = {
    "maternal_neonatal_risk": "maternal access shows {inst} institutional births and {skilled} skilled attendance; "
                              "C-section signal is {flag}",
    "diabetes_care_risk": "diabetes burden is elevated, with {sugar} reporting high blood sugar{near}",
    "hypertension_care_risk": "hypertension burden is elevated, with {bp} reporting high blood pressure{near}",
    "nutrition_services_risk": "nutrition need is elevated, with {under} underweight{near}",
    "cancer_screening_risk": "cancer screening is very low: {cerv} cervical, {breast} breast, and {oral} oral "
                             "screening{near_cancer}",
}
NEAR_TEXT = " and the closest capable facility about {km} away"
NEAR_CANCER_TEXT = "; closest capable facility about {km} away"
GAP_PREFIX, GAP_SUFFIX = "Top service gaps: ", "."
NO_GAP_TEXT = "No high-risk service driver is flagged; current availability is {category} with {n} facilities within 30 km."
NO_FLAG_TEXT, NO_CATEGORY_TEXT = "no C-section signal", "availability unknown"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_round(x: Column) -> Column:
    """Round half up, like a script ``Math.round``: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def risk_weight(col) -> Column:
    """P1."""
    v = coerce_string(col)
    out = F.lit(0)
    for label, w in RISK_WEIGHT.items():
        out = F.when(v == label, F.lit(w)).otherwise(out)
    return out


def listed_nearest_km(list_col="capable_facilities") -> Column:
    """Smallest finite distance in the listed capable facilities; NULL when none."""
    ds = F.transform(_c(list_col), lambda x: coerce_number(x["distance_kilometers"], None))
    return F.array_min(F.filter(ds, lambda d: d.isNotNull()))


def closest_km(field: str) -> Column:
    """The field's own closest-capable distance; for the overall field the smallest of all five and P2."""
    for name, _, dist in RISK_FIELDS:
        if name == field and dist is not None:
            return coerce_number(dist, None)
    return F.least(*[coerce_number(d, None) for _, _, d in RISK_FIELDS if d], listed_nearest_km())


def planning_distance() -> Column:
    """P4."""
    return F.coalesce(listed_nearest_km(), closest_km("overall_care_desert_risk"))


def access_adjusted_weight(field: str, base: Column | None = None, d: Column | None = None) -> Column:
    """P5: a near capable facility lowers the weight of a risk. ``base``/``d`` may be precomputed columns."""
    base = risk_weight(field) if base is None else base
    d = closest_km(field) if d is None else d
    return (F.when(base == 0, F.lit(0)).when(d.isNull(), base).when(d <= 10, F.least(base, F.lit(1)))
            .when(d <= 25, F.greatest(F.lit(1), base - 1)).otherwise(base))


def distance_penalty(d: Column | None = None) -> Column:
    """P6."""
    d = planning_distance() if d is None else d
    return (F.when(d.isNull(), F.lit(2)).when(d > 100, F.lit(3)).when(d > 60, F.lit(2)).when(d > 25, F.lit(1))
            .otherwise(F.lit(0)))


def planning_priority_score() -> Column:
    """Sum of P5 over the six risk fields plus P6 (0..21)."""
    return sum((access_adjusted_weight(f) for f, _, _ in RISK_FIELDS), F.lit(0)) + distance_penalty()


def planning_priority_tier(score_col="planning_priority_score", d: Column | None = None) -> Column:
    """P8."""
    s, d = _c(score_col), (planning_distance() if d is None else d)
    return (F.when(s >= 14, F.lit("Urgent")).when(s >= 11, F.lit("High"))
            .when(s >= 8, F.when(d.isNotNull() & (d > 100), F.lit("High")).otherwise(F.lit("Watch")))
            .when(d.isNull() | (d > 60), F.lit("Watch")).otherwise(F.lit("Monitor")))


def risk_drivers() -> Column:
    """Labels of the fields at 'High Risk', in field order (overall included)."""
    return F.filter(F.array(*[F.when(coerce_string(f) == "High Risk", F.lit(label)) for f, label, _ in RISK_FIELDS]),
                    lambda x: x.isNotNull())


def recommended_intervention(drivers_col="_drivers") -> Column:
    """P10: first matching rule over the source priority and the driver labels."""
    drivers = _c(drivers_col)
    out = F.lit(INTERVENTIONS[-1][1])
    for pattern, text in reversed(INTERVENTIONS[1:-1]):
        words = pattern.split("|")
        hit = F.exists(drivers, _contains_any(words))
        out = F.when(hit, F.lit(text)).otherwise(out)
    return F.when(coerce_string("intervention_priority") == INTERVENTIONS[0][0], F.lit(INTERVENTIONS[0][1])) \
        .otherwise(out)


def _contains_any(words: list[str]):
    def test(x: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | x.contains(w)
        return out
    return test


def affected_population_proxy() -> Column:
    """Impact, or households + women when the impact is 0 or missing; rounded half up."""
    impact = coerce_number("estimated_population_impact")
    fallback = coerce_number("households_surveyed") + coerce_number("women_15_49_interviewed")
    return js_round(F.when(impact != 0, impact).otherwise(fallback))


def data_confidence_score(pop_col="affected_population_proxy") -> Column:
    """min(100, round(pop / 2000 * 70 + min(facilities, 300) / 10))."""
    fc = coerce_number("total_facilities")
    return F.least(F.lit(100).cast("long"),
                   js_round(_c(pop_col) / 2000.0 * 70.0 + F.least(fc, F.lit(300.0)) / 10.0))


def one_decimal_text(x: Column) -> Column:
    """One-decimal text of a double, half-up. The value is first snapped to 6 decimals so that last-bit noise
    (e.g. from an order-dependent average) cannot flip the displayed digit."""
    snapped = F.floor(x * 1000000.0 + 0.5) / 1000000.0
    return F.format_string("%.1f", F.floor(snapped * 10.0 + 0.5) / 10.0)


def _fixed1(col) -> Column:
    """One-decimal text of a number (missing -> 0.0), see ``one_decimal_text``."""
    if isinstance(col, str):
        from deserta.functions.cleaning import coerce_number_sql
        v = coerce_number_sql(col)
        return F.expr(f"format_string('%.1f', floor(floor({v} * 1000000D + 0.5D) / 1000000D * 10D + 0.5D) / 10D)")
    return one_decimal_text(coerce_number(col))


def _pct(col) -> Column:
    return F.concat(_fixed1(col), F.lit("%"))


def _near(col, template: str) -> Column:
    v = coerce_number(col)
    head, tail = template.split("{km}")
    return F.when(v > 0, F.concat(F.lit(head), _fixed1(col), F.lit(" km"), F.lit(tail))).otherwise(F.lit(""))


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """Build a Column from a ``{name}`` template with Column parts."""
    out, rest = [], template
    while "{" in rest:
        pre, after = rest.split("{", 1)
        name, rest = after.split("}", 1)
        out += [F.lit(pre), parts[name]]
    out.append(F.lit(rest))
    return F.concat(*out)


_GAP_PARTS = {
    "inst": lambda: _pct("maternal_neonatal_institutional_birth_pct"),
    "skilled": lambda: _pct("maternal_neonatal_skilled_birth_pct"),
    "flag": lambda: F.lower(F.when(coerce_string("maternal_neonatal_csection_access_flag") != "",
                                   coerce_string("maternal_neonatal_csection_access_flag"))
                            .otherwise(F.lit(NO_FLAG_TEXT))),
    "sugar": lambda: _pct("diabetes_care_high_blood_sugar_pct"),
    "bp": lambda: _pct("hypertension_care_high_bp_pct"),
    "under": lambda: _pct("nutrition_services_underweight_pct"),
    "cerv": lambda: _pct("cancer_screening_cervical_pct"),
    "breast": lambda: _pct("cancer_screening_breast_pct"),
    "oral": lambda: _pct("cancer_screening_oral_pct"),
}


def gap_text(field: str) -> Column:
    """The gap sentence of one service field (placeholders are built only when the template uses them)."""
    dist = dict((f, d) for f, _, d in RISK_FIELDS)[field]
    template = GAP_TEMPLATES[field]
    parts = {}
    for name, build in _GAP_PARTS.items():
        if "{" + name + "}" in template:
            parts[name] = build()
    if "{near}" in template:
        parts["near"] = _near(dist, NEAR_TEXT)
    if "{near_cancer}" in template:
        parts["near_cancer"] = _near(dist, NEAR_CANCER_TEXT)
    return _fill(template, parts)


GAP_FIELDS = tuple(f for f, _, d in RISK_FIELDS if d)


def service_gap_summary(gap_cols: dict[str, str] | None = None) -> Column:
    """Up to three gap sentences for High services (else Medium), or an availability sentence.
    ``gap_cols``: field -> name of a column already holding ``gap_text(field)`` (computed once per row)."""
    texts_by_field = {f: (F.col(gap_cols[f]) if gap_cols else gap_text(f)) for f in GAP_FIELDS}
    levels = {f: coerce_string(f) for f in GAP_FIELDS}

    def texts(level: str) -> Column:
        return F.filter(F.array(*[F.when(levels[f] == level, texts_by_field[f]) for f in GAP_FIELDS]),
                        lambda x: x.isNotNull())

    high = texts("High Risk")
    chosen = F.when(F.size(high) > 0, high).otherwise(texts("Medium Risk"))
    category = F.lower(F.when(coerce_string("overall_availability_category") != "",
                              coerce_string("overall_availability_category")).otherwise(F.lit(NO_CATEGORY_TEXT)))
    n30 = F.format_number(coerce_number("facilities_within_30km"), 0)
    fallback = _fill(NO_GAP_TEXT, {"category": category, "n": n30})
    return F.when(F.size(chosen) > 0,
                  F.concat(F.lit(GAP_PREFIX), F.array_join(F.slice(chosen, 1, 3), "; "), F.lit(GAP_SUFFIX))) \
        .otherwise(fallback)


# ---- P15-P17 (console and legacy) -----------------------------------------------------------------------------------

def clean_facility_list(list_col, k: int = 3) -> Column:
    """Entries with a non-empty trimmed name and a finite distance, first k."""
    ok = F.filter(_c(list_col), lambda x: (coerce_string(x["name"]) != "")
                  & coerce_number(x["distance_kilometers"], None).isNotNull())
    return F.slice(ok, 1, k)

