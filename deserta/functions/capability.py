"""Capability expressions: assessment prompt (C1), rule-assessor pieces (C2), best-of-five (C4)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from deserta.functions.cleaning import null_default

# The five service categories (JSON key, flat column prefix), the allowed enum values, and the
# capability order used by best-of-five.
CATEGORIES = (
    ("maternal_neonatal_care", "maternal_neonatal"),
    ("diabetes_care", "diabetes"),
    ("hypertension_care", "hypertension"),
    ("nutrition_services", "nutrition"),
    ("cancer_screening", "cancer_screening"),
)
CAPABILITY_VALUES = ("capable", "limited", "not_capable", "unknown")
CONFIDENCE_VALUES = ("high", "medium", "low")
TEXT_FIELDS = ("description", "specialties", "equipment", "procedure", "capability")

# Word beginnings that document each category in a facility's free text (lower case).
CATEGORY_TERMS = {
    "maternal_neonatal_care": ("antenatal", "prenatal", "postnatal", "obstetric", "maternity", "delivery", "deliveries",
                               "caesarean", "cesarean", "c-section", "neonat", "newborn", "midwi", "labour room", "labor room",
                               "gynaecolog", "gynecolog"),
    "diabetes_care": ("diabet", "prediabet", "glucose", "blood sugar", "sugar test", "insulin", "hba1c", "endocrinolog",
                      "metformin"),
    "hypertension_care": ("hypertensi", "blood pressure", "antihypertensive", "bp check", "bp monitor", "bp measure"),
    "nutrition_services": ("nutrition", "malnutrition", "malnourish", "undernutrition", "anemi", "anaemi", "bmi",
                           "growth monitoring", "growth chart", "supplement", "dietit", "dietic", "diet"),
    "cancer_screening": ("cancer", "cervical", "pap smear", "pap test", "mammogra", "breast exam", "breast screening",
                         "oncolog", "biops", "patholog", "histopatholog", "colposcop", "tumor", "tumour"),
}


def prompt_text() -> str:
    """The instructions of the assessment prompt, made from the schema that the answer is audited against and from the
    categories' terms, with the counting rule that the clause reader follows."""
    values, levels = " | ".join(CAPABILITY_VALUES), " | ".join(CONFIDENCE_VALUES)
    lines = [
        "Return one JSON document about the health facility whose fields are listed last. Nothing but these fields counts.",
        f"Keys: data_confidence ({levels}), data_confidence_reason (text), {', '.join(k for k, _ in CATEGORIES)}.",
        f"Each of the last {len(CATEGORIES)} is an object of capability ({values}), confidence ({levels}), evidence (list of "
        "texts, each copied letter by letter from one field) and limitation (text, may be empty).",
        "Read every field clause by clause. A clause that is negated speaks against a category, one about plans is skipped, one "
        "about basic or referred care counts as weak, any other as strong.",
        "Strong clauses in two fields and none against: capable. Any other clause for it: limited. Clauses against it only: "
        "not_capable. No clause: unknown.",
        "data_confidence follows the number of fields with text: 4 or 5 high, 2 or 3 medium, else low.",
    ]
    lines += [f"{key}: {', '.join(CATEGORY_TERMS[key])}." for key, _ in CATEGORIES]
    return "\n".join(lines) + "\n"


PROMPT_FIELDS = (("name", "unknown"), *((f, "none") for f in TEXT_FIELDS))


def assessment_prompt() -> Column:
    """Instructions followed by the facility fields, NULLs shown as 'unknown' / 'none' (D8)."""
    parts = [F.lit(prompt_text())]
    for col, default in PROMPT_FIELDS:
        parts += [F.lit(f"\n{col}: "), null_default(col, default)]
    return F.concat(*parts)


# ---- clause reader ---------------------------------------------------------------------------------------------------
#
# A field is cut at negations, at the ends of sentences and at words of contrast. What a negation covers is taken out and
# kept as clauses against; the rest is split into clauses, each of which is a piece of the field as it stands there.

_CONTRAST = r"(?:but|however|although|though|except|whereas|yet|while)"
_VERB = r"(?:offer(?:s|ed|ing)?|provid(?:e|es|ed|ing)|perform(?:s|ed|ing)?|ha(?:s|ve|d)|runs?|treat(?:s|ed|ing)?|do(?:es|ne)?|conduct(?:s|ed)?)"
_STOP = rf"(?:[.](?=\s|$)|[;!?\n]|\b{_CONTRAST}\b|\b{_VERB}\b)"
_OUT = (r"(?:(?:not|n't)\s+(?:currently\s+|yet\s+|always\s+|be\s+)?(?:available|possible|functional|in use|done|given|\w+ed)|"
        r"cannot\s+be\s+\w+|unavailable|discontinued|suspended|out of (?:stock|service|order)|non-?functional|closed)\b")
#: "a, b and c are not available" covers the whole list, "a is not available" only what stands after the last comma.
_AFTER_LIST = rf"(?i)(?:(?!{_STOP}).)*?\b(?:are|were|remain)\s+(?:currently\s+)?{_OUT}"
_AFTER_ONE = rf"(?i)(?:(?!{_STOP}|,).)*?\b(?:(?:is|was|has been|remains|currently)\s+)*{_OUT}"
#: A leading negation covers what follows, over commas, up to the sentence's end, a contrast or a new verb.
_BEFORE = (r"(?i)\b(?:no longer|no|not(?!\s+only\b)|without|lacks?|lacking|never|cannot|can't|don't|doesn't|unable to|absence of|"
           rf"neither|nor)\b(?:\s+(?:currently|yet|been|able to))*(?:\s+{_VERB}\b)?(?:(?!{_STOP}).)*")
_SPLIT = rf"(?i)\s*(?:[.](?=\s|$)|[;!?\n,]|\b{_CONTRAST}\b)\s*"
_PLANS = r"(?i)\b(?:plan(?:s|ned|ning)?|proposed|upcoming|under construction|expected|intends?|will|to be (?:opened|started|added)|awaiting)\b"
_WEAK = r"basic|referrals?|refers?|refer|referred|stabili[sz]\w*|first aid|awareness|camps?|outreach|visiting|occasional\w*|advice"
#: Screening and counselling are weak evidence of treatment, and the service itself for the last two categories.
_WEAK_MORE = {"maternal_neonatal_care": "|screening|counsel\\w*", "diabetes_care": "|screening|counsel\\w*",
              "hypertension_care": "|screening|counsel\\w*", "nutrition_services": "", "cancer_screening": ""}


def _pattern(terms) -> str:
    for t in terms:  # plain words: no regex metacharacters, no quotes
        assert re.fullmatch(r"[a-z0-9 -]+", t), t
    return rf"(?i)\b(?:{'|'.join(terms)})"


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", "’") + "'" if "'" not in pattern else 'r"' + pattern + '"'


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once however often the body uses it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _field_sql(field: str) -> str:
    """(p, n) of a field: its clauses about some category, and what is negated about some."""
    known = _lit(_pattern([t for terms in CATEGORY_TERMS.values() for t in terms]))
    clauses = (f"filter(transform(split(regexp_replace(v, {_lit(_BEFORE)}, ';'), {_lit(_SPLIT)}), c -> trim(c)), "
               f"c -> c rlike {known} AND NOT c rlike {_lit(_PLANS)})")
    none = "cast(array() AS array<string>)"
    out = _lit(rf"(?i){_OUT}")  # few texts have a negation that follows; only these are searched for what it covers
    after = f"concat(regexp_extract_all(t, {_lit(_AFTER_LIST)}, 0), regexp_extract_all(u, {_lit(_AFTER_ONE)}, 0))"
    against = (f"filter(transform(concat(CASE WHEN o THEN {after} ELSE {none} END, regexp_extract_all(v, {_lit(_BEFORE)}, 0)), "
               f"c -> trim(c)), c -> c rlike {known})")
    cut = _let(f"t rlike {out}", "o",
               _let(f"CASE WHEN o THEN regexp_replace(t, {_lit(_AFTER_LIST)}, ';') ELSE t END", "u",
                    _let(f"CASE WHEN o THEN regexp_replace(u, {_lit(_AFTER_ONE)}, ';') ELSE u END", "v",
                         f"named_struct('p', {clauses}, 'n', {against})")))
    return _let(f"`{field}`", "t", f"CASE WHEN t rlike {known} THEN {cut} ELSE named_struct('p', {none}, 'n', {none}) END")


def fields_sql() -> str:
    """What the fields say: an array of (p, n), one per field."""
    return f"array({', '.join(_field_sql(f) for f in TEXT_FIELDS)})"


def support_sql(category: str, fields: str = "fs") -> str:
    """Of the fields' clauses: those for the category and against it, and the numbers of fields with one for it and with a
    strong one, as named_struct(e, x, f, s)."""
    term = _lit(_pattern(CATEGORY_TERMS[category]))
    weak = _lit(rf"(?i)\b(?:{_WEAK}{_WEAK_MORE[category]})\b")
    return (f"named_struct('e', flatten(transform({fields}, y -> filter(y.p, c -> c rlike {term}))), "
            f"'x', flatten(transform({fields}, y -> filter(y.n, c -> c rlike {term}))), "
            f"'f', size(filter({fields}, y -> exists(y.p, c -> c rlike {term}))), "
            f"'s', size(filter({fields}, y -> exists(y.p, c -> c rlike {term} AND NOT c rlike {weak}))))")


def rule_assessment_sql(category: str) -> str:
    """C2 (rule form) for one category: named_struct(capability, confidence, evidence, limitation).

    Strong clauses in two fields or more and none against -> capable; any other clause for it -> limited; clauses against
    it only -> not_capable; else unknown. The evidence is the clauses themselves.
    """
    against = "size(q.x) > 0"
    capability = (f"CASE WHEN q.s >= 2 AND NOT {against} THEN 'capable' WHEN q.f > 0 THEN 'limited' "
                  f"WHEN {against} THEN 'not_capable' ELSE 'unknown' END")
    confidence = (f"CASE WHEN q.f > 0 AND {against} THEN 'low' WHEN q.s >= 3 THEN 'high' WHEN q.s = 2 OR q.f >= 2 THEN "
                  f"'medium' WHEN q.f = 1 THEN 'low' WHEN {against} THEN 'medium' ELSE 'low' END")
    limitation = (f"CASE WHEN q.f > 0 AND {against} THEN 'fields disagree' WHEN q.s >= 2 THEN '' "
                  f"WHEN q.f > 1 THEN 'basic or referred care only' WHEN q.f = 1 THEN 'documented in one field only' "
                  f"WHEN {against} THEN 'service stated as not offered' ELSE 'no documentation for this service' END")
    return _let(support_sql(category), "q", f"named_struct('capability', {capability}, 'confidence', {confidence}, 'evidence', "
                f"array_distinct(CASE WHEN q.f > 0 THEN q.e ELSE q.x END), 'limitation', {limitation})")


def rule_data_confidence_sql() -> tuple[str, str]:
    n = "(" + " + ".join(f"CASE WHEN trim(coalesce(`{f}`, '')) != '' THEN 1 ELSE 0 END" for f in TEXT_FIELDS) + ")"
    level = f"CASE WHEN {n} >= 4 THEN 'high' WHEN {n} >= 2 THEN 'medium' ELSE 'low' END"
    reason = f"concat(cast({n} AS string), ' of 5 descriptive fields documented')"
    return level, reason


def rule_assessment_json_sql() -> str:
    """The whole assessment document as JSON text (C2 rule form)."""
    level, reason = rule_data_confidence_sql()
    cats = ", ".join(f"'{key}', {rule_assessment_sql(key)}" for key, _ in CATEGORIES)
    return _let(fields_sql(), "fs", f"to_json(named_struct('data_confidence', {level}, 'data_confidence_reason', {reason}, {cats}))")


def overall_capability(*cols) -> Column:
    """C4: best of the five category capabilities, capable > limited > not_capable > unknown."""
    cs = [F.col(c) if isinstance(c, str) else c for c in (cols or [f"{p}_capability" for _, p in CATEGORIES])]

    def any_is(v):
        out = F.lit(False)
        for c in cs:
            out = out | F.coalesce(c == v, F.lit(False))
        return out

    return (F.when(any_is("capable"), F.lit("capable")).when(any_is("limited"), F.lit("limited"))
            .when(any_is("not_capable"), F.lit("not_capable")).otherwise(F.lit("unknown")))
