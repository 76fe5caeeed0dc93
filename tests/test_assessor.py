"""The clause reader on texts labelled by hand, resumable assessment and the quarantine."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from deserta.functions import capability as C
from deserta.operators import assess as A
from deserta.sources import fixtures as FX

M, D, H, N, X = (k for k, _ in C.CATEGORIES)
# One field's text, the categories that it speaks for and those that it speaks against, as a reader understands it.
LABELLED = [
    ("We run a 24 hour labour room with two midwives and a neonatologist on call.", {M}, set()),
    ("No caesarean facility; mothers are sent to the district hospital.", set(), {M}),
    ("Sugar testing and insulin are available every day.", {D}, set()),
    ("Insulin, HbA1c and mammography are not available.", set(), {D, X}),
    ("General surgery and orthopaedics. The blood pressure of all patients is checked at entry.", {H}, set()),
    ("The hospital does not offer cancer treatment, but diabetic patients are followed up monthly.", {D}, {X}),
    ("Children are weighed and anaemia is treated with iron tablets.", {N}, set()),
    ("Dental clinic.", set(), set()),
    ("Mammography unit planned for next year.", set(), set()),
    ("Pap smears are done on Tuesdays, biopsies on Fridays.", {X}, set()),
    ("Without a dietitian since 2021, the ward gives no nutrition counselling.", set(), {N}),
    ("Antenatal clinic, immunisation, family planning", {M}, set()),
    ("Our glucometer is out of order and glucose is not measured.", set(), {D}),
    ("Not only deliveries but also newborn care.", {M}, set()),
    ("Hypertension clinic closed.", set(), {H}),
    ("Eye hospital with cataract theatre and a BP apparatus", {H}, set()),
    ("Oncology department with chemotherapy; no radiotherapy.", {X}, set()),
    ("Maternity ward, neonatal intensive care unit, blood bank", {M}, set()),
    ("The centre lacks ultrasound, X-ray and any laboratory for glucose.", set(), {D}),
    ("Hypertensive and diabetic patients receive free medicines.", {D, H}, set()),
    ("Severely malnourished children are admitted to the rehabilitation centre.", {N}, set()),
    ("The submitted records cover physiotherapy only.", set(), set()),
    ("Normal deliveries are conducted; caesarean sections are not performed.", {M}, {M}),
    ("Obstetric emergencies cannot be handled here.", set(), {M}),
    ("Breast lumps are examined and samples go to the pathology laboratory.", {X}, set()),
    ("A physician treats high blood pressure and heart failure.", {H}, set()),
    ("Weight, height and BMI of pupils are recorded each term.", {N}, set()),
    ("No longer provides maternity services, however diabetes care continues.", {D}, {M}),
    ("Screening for mouth cancer among tobacco users", {X}, set()),
    ("Never had a gynaecologist; women deliver at home.", set(), {M}),
    ("We are awaiting a licence for our insulin store.", set(), set()),
    ("Ayurvedic massage, yoga, steam bath", set(), set()),
    ("Foot care and retina checks for people with high sugar levels", {D}, set()),
    ("Expectant mothers get four check-ups and a safe birth.", {M}, set()),
    ("Neither hypertension nor diabetes is managed at this outpost.", set(), {D, H}),
    ("Vitamin A and iron supplements, deworming, growth charts", {N}, set()),
    ("Trauma care, ventilators, CT scan; antihypertensives stocked", {H}, set()),
    ("Tumour board meets weekly, histopathology is done in house.", {X}, set()),
    ("Smear tests are unavailable, colposcopy is offered.", {X}, {X}),
    ("Staff were trained in newborn resuscitation, the unit has two warmers.", {M}, set()),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(str(i), t) for i, (t, _, _) in enumerate(LABELLED)]
    df = spark.createDataFrame(rows, "unique_id string, description string")
    for c in ("name", *C.TEXT_FIELDS[1:]):
        df = df.withColumn(c, F.lit(None).cast("string"))
    every = ", ".join(f"'{k}', {C.support_sql(k)}" for k in C.CATEGORY_TERMS)
    out = df.selectExpr("unique_id", C._let(C.fields_sql(), "fs", f"named_struct({every})") + " AS s")
    return {int(r["unique_id"]): {f"_{side}_{k}": r["s"][k][side] for k in C.CATEGORY_TERMS for side in "ex"} for r in out.collect()}


def counts(read, side, at):
    told = [(i, k) for i in read for k in C.CATEGORY_TERMS if read[i][f"{side}_{k}"]]
    meant = [(i, k) for i, label in enumerate(LABELLED) for k in label[at]]
    right = set(told) & set(meant)
    return len(right) / len(told), len(right) / len(meant), sorted(set(told) ^ set(meant))


def test_clauses_for_a_category(read):
    precision, recall, wrong = counts(read, "_e", 1)
    print("for:", precision, recall, [(LABELLED[i][0], k) for i, k in wrong])
    assert precision >= 0.9 and recall >= 0.8


def test_clauses_against_a_category(read):
    precision, recall, wrong = counts(read, "_x", 2)
    print("against:", precision, recall, [(LABELLED[i][0], k) for i, k in wrong])
    assert precision >= 0.9 and recall >= 0.8


def test_evidence_stands_in_the_field_letter_by_letter(read):
    quotes = [(LABELLED[i][0], q) for i in read for k in C.CATEGORY_TERMS for s in ("_e", "_x") for q in read[i][f"{s}_{k}"]]
    assert len(quotes) > 35 and all(q and q in t for t, q in quotes)


def facility(spark, rows):
    return spark.createDataFrame(rows, "unique_id string, name string, description string, specialties string, equipment string, "
                                       "`procedure` string, capability string")


def test_verdicts_weigh_fields_and_contradictions(spark):
    rows = [("two", "a", "Diabetes clinic", "insulin therapy", None, None, None), ("weak", "b", "refers diabetic patients", None, None, None, None),
            ("weak2", "c", "basic glucose tests", "diabetes counselling", None, None, None),
            ("against", "d", None, None, None, None, "no diabetes care"), ("both", "e", "Diabetes clinic", "insulin therapy", None, None, "no insulin"),
            ("none", None, "", None, None, None, None)]
    got = {r["unique_id"]: json.loads(r["assessment"])[D] for r in A.assess_facilities(facility(spark, rows)).collect()}
    assert {k: (v["capability"], v["confidence"], v["limitation"]) for k, v in got.items()} == {
        "two": ("capable", "medium", ""), "weak": ("limited", "low", "documented in one field only"),
        "weak2": ("limited", "medium", "basic or referred care only"), "against": ("not_capable", "medium", "service stated as not offered"),
        "both": ("limited", "low", "fields disagree"), "none": ("unknown", "low", "no documentation for this service")}
    assert got["two"]["evidence"] == ["Diabetes clinic", "insulin therapy"] and got["against"]["evidence"] == ["no diabetes care"]


def test_assessments_resume(spark, tmp_path):
    """Every distinct prompt is answered once over two runs, though the first loses some and one batch fails at first."""
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir(), broken.touch()

    def assessor(prompts: pd.Series) -> pd.Series:
        if broken.exists() and prompts.str.contains("beta").any():
            raise ConnectionError("model is away")
        for p in prompts:
            with open(calls / str(os.getpid()), "a") as f:
                f.write(p.rsplit("name: ")[-1].split("\n")[0] + "\n")
        return prompts.map(lambda p: None if "mute" in p else json.dumps({"data_confidence": "low"}))

    names = [f"alpha{i}" for i in range(20)] + ["beta", "mute"]
    rows = [(f"{n}-{j}", n, None, None, None, None, None) for n in names for j in range(3)]
    results = str(tmp_path / "results")

    def run():
        return {r["unique_id"]: (r["assessment"], r["assessment_failure"])
                for r in A.assess_resumable(facility(spark, rows), assessor, results, retries=1, chunks=3).collect()}

    first = run()
    assert len(first) == len(rows) and first["beta-0"] == (None, "ConnectionError: model is away") and first["mute-2"] == (None, "no answer")
    assert all(first[f"alpha{i}-{j}"][0] for i in range(20) for j in range(3))
    broken.unlink()
    second = run()
    assert second["beta-1"][0] and second["alpha3-0"] == first["alpha3-0"]
    asked = [line for f in calls.iterdir() for line in f.read_text().split()]
    assert sorted(x for x in asked if x != "mute") == sorted(names[:21])


def test_quarantine_splits_in_one_pass(spark, tmp_path):
    assessed = FX.corrupt_assessments(A.assess_facilities(FX.facilities(spark, SF001)))
    good, bad, counts = A.quarantined(assessed, str(tmp_path / "gate"))
    listed = A.assessment_violations(assessed)
    assert counts == {"rows": assessed.count(), "rejected": bad.count(), "violations": listed.count()} and counts["rejected"] > 0
    assert good.columns == assessed.columns and good.count() + bad.count() == counts["rows"]
    assert A.assessment_violations(good).count() == 0
    assert A.assessment_violations(bad).exceptAll(listed).count() == 0
    none = A.quarantined(assessed.limit(0), str(tmp_path / "none"))
    assert none[0].count() == none[1].count() == 0 and none[2]["rows"] == 0
