"""Facility assessment operators."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from deserta.functions import capability as C

_CATEGORY_STRUCT = StructType([
    StructField("capability", StringType()), StructField("confidence", StringType()),
    StructField("evidence", ArrayType(StringType())), StructField("limitation", StringType()),
])
ASSESSMENT_SCHEMA = StructType(
    [StructField("data_confidence", StringType()), StructField("data_confidence_reason", StringType())]
    + [StructField(key, _CATEGORY_STRUCT) for key, _ in C.CATEGORIES]
)
FACILITY_COLUMNS = ("unique_id", "name", "address_city", "address_stateOrRegion", "latitude", "longitude",
                    "description", "specialties", "equipment", "procedure", "capability")


def assess_facilities(facilities: DataFrame, assessor: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Add ``assessment_prompt`` (C1) and ``assessment`` (a JSON document per facility).

    Default assessor: the clause reader of ``functions.capability`` as Column expressions (JVM-side). A custom ``assessor`` maps a pandas Series of prompts to a Series of JSON strings; it runs through
    ``mapInPandas`` on Arrow batches, partitioned like the input; ``assess_resumable`` keeps its answers.
    """
    with_prompt = facilities.withColumn("assessment_prompt", C.assessment_prompt())
    if assessor is None:  # long work on short rows: by number, as a compressed file of many facilities is one split
        tasks = int(facilities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        with_prompt = facilities.repartition(tasks).withColumn("assessment_prompt", C.assessment_prompt())
        return with_prompt.selectExpr("*", f"{C.rule_assessment_json_sql()} AS assessment")

    out_schema = StructType(with_prompt.schema.fields + [StructField("assessment", StringType())])

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["assessment"] = assessor(pdf["assessment_prompt"]).astype(object).values
            yield pdf

    return with_prompt.mapInPandas(run, out_schema)


RESULT_DDL = "digest string, assessment string, failure string"


def assess_resumable(facilities: DataFrame, assessor: Callable[[pd.Series], pd.Series], results: str,
                     retries: int = 2, chunks: int = 16) -> DataFrame:
    """C2 with a slow or costly assessor: ``facilities`` with ``assessment_prompt``, ``assessment`` and ``assessment_failure``.

    Prompts are named by their SHA-256 and asked once, however many facilities share one. Answers are appended to the table at
    ``results`` (a folder that all executors share), chunk by chunk of the digests, each by one job that commits whole; a
    rerun, after a lost job or with more facilities, leaves out the digests that are answered there and asks for the rest.

    A batch that raises, or gives the wrong number of answers, is asked again up to ``retries`` times and then prompt by
    prompt, so that one bad prompt does not take its batch along. A prompt that still fails has a failure text and no
    answer; it is asked again by the next run. A missing answer (null) counts as a failure.
    """
    spark = facilities.sparkSession
    asked = facilities.withColumn("assessment_prompt", C.assessment_prompt()).withColumn("_digest", F.sha2("assessment_prompt", 256))
    spark.createDataFrame([], RESULT_DDL).write.mode("append").parquet(results)

    def answered() -> DataFrame:
        """The best result of every digest: an answer before a failure."""
        rows = spark.read.schema(RESULT_DDL).parquet(results)
        best = F.min(F.struct(F.col("assessment").isNull().alias("no"), "assessment", "failure")).alias("r")
        return rows.groupBy("digest").agg(best).select("digest", "r.assessment", "r.failure")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"digest": pdf["_digest"], **_answers(assessor, pdf["assessment_prompt"], retries)})

    for chunk in range(chunks):
        done = answered().where("assessment IS NOT NULL").select(F.col("digest").alias("_digest"))
        todo = (asked.select("_digest", "assessment_prompt").where(F.pmod(F.xxhash64("_digest"), F.lit(chunks)) == chunk)
                .dropDuplicates(["_digest"]).join(done, "_digest", "left_anti"))
        todo.mapInPandas(run, RESULT_DDL).write.mode("append").parquet(results)
    out = answered().withColumnsRenamed({"digest": "_digest", "failure": "assessment_failure"})
    return asked.join(out, "_digest", "left").drop("_digest")


def _answers(assessor, prompts: pd.Series, retries: int) -> dict[str, list]:
    failure = None
    for _ in range(retries + 1):
        try:
            said = [None if a is None or a != a else str(a) for a in assessor(prompts)]
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
            return {"assessment": said, "failure": [None if a is not None else "no answer" for a in said]}
        except Exception as e:  # whatever a remote model raises
            failure = f"{type(e).__name__}: {e}"
    if len(prompts) == 1:
        return {"assessment": [None], "failure": [failure]}
    each = [_answers(assessor, prompts.iloc[i:i + 1], 0) for i in range(len(prompts))]
    return {c: [x for one in each for x in one[c]] for c in ("assessment", "failure")}


def parse_assessment(assessed: DataFrame) -> DataFrame:
    """JSON document -> the facility columns plus 22 flat capability columns (evidence joined by '; ')."""
    doc = F.from_json(F.col("assessment"), ASSESSMENT_SCHEMA)
    parsed = assessed.withColumn("_a", doc)
    cols = [F.col(c) for c in FACILITY_COLUMNS if c in assessed.columns]
    cols += [F.col("_a.data_confidence").alias("data_confidence"),
             F.col("_a.data_confidence_reason").alias("data_confidence_reason")]
    for key, prefix in C.CATEGORIES:
        cols += [
            F.col(f"_a.{key}.capability").alias(f"{prefix}_capability"),
            F.col(f"_a.{key}.confidence").alias(f"{prefix}_confidence"),
            F.array_join(F.col(f"_a.{key}.evidence"), "; ").alias(f"{prefix}_evidence"),
            F.col(f"_a.{key}.limitation").alias(f"{prefix}_limitation"),
        ]
    return parsed.select(*cols)


def category_view(capability: DataFrame) -> DataFrame:
    """Long form (unique_id, category, category_capability, category_confidence, category_evidence) for
    'overall' and the five services; overall uses best-of-five with the data-confidence fields."""
    short = {"maternal_neonatal": "maternal", "diabetes": "diabetes", "hypertension": "hypertension",
             "nutrition": "nutrition", "cancer_screening": "cancer"}
    rows = [F.struct(F.lit("overall").alias("category"), C.overall_capability().alias("category_capability"),
                     F.col("data_confidence").alias("category_confidence"),
                     F.col("data_confidence_reason").alias("category_evidence"))]
    for _, prefix in C.CATEGORIES:
        rows.append(F.struct(F.lit(short[prefix]).alias("category"),
                             F.col(f"{prefix}_capability").alias("category_capability"),
                             F.col(f"{prefix}_confidence").alias("category_confidence"),
                             F.col(f"{prefix}_evidence").alias("category_evidence")))
    return capability.select("unique_id", F.explode(F.array(*rows)).alias("_v")).select("unique_id", "_v.*")


def assessment_violations(assessed: DataFrame, id_col: str = "unique_id") -> DataFrame:
    """V3: closed-schema audit of the assessment JSON -> one row per (id, violation)."""
    parsed, violations = _audit(assessed)
    return parsed.select(id_col, F.explode(violations).alias("violation"))


def quarantined(assessed: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """V3 as a gate: (good rows, rejected rows with their ``violations``, counts), of one pass over ``assessed``.

    One job writes all rows below ``path``, good and rejected ones to folders of their own, and counts them as they pass
    (``rows``, ``rejected``, ``violations``); the parts read back what was written. Nothing is lost: good + rejected = rows.
    """
    audit = Observation("audit")
    size = F.size("violations")
    (with_violations(assessed).withColumn("rejected", size > 0)
     .observe(audit, F.count(F.lit(1)).alias("rows"), F.count_if(size > 0).alias("rejected"),
              F.coalesce(F.sum(size), F.lit(0)).alias("violations"))
     .write.mode("overwrite").partitionBy("rejected").parquet(path))
    schema = with_violations(assessed).withColumn("rejected", F.lit(True)).schema
    back = assessed.sparkSession.read.schema(schema).parquet(path)
    return (back.where("NOT rejected").drop("rejected", "violations"), back.where("rejected").drop("rejected"), dict(audit.get))


def with_violations(assessed: DataFrame) -> DataFrame:
    """``assessed`` with ``violations``, the list of what its assessment breaks of the closed schema."""
    parsed, violations = _audit(assessed)
    return parsed.withColumn("violations", violations).drop("_v", "_top")


def _audit(assessed: DataFrame) -> tuple[DataFrame, Column]:
    """``assessed`` with its documents parsed, and the list of violations over it.

    Violations: malformed_json, missing:<path>, extra_key:<path>, bad_type:<path> (null or not the declared type),
    bad_enum:<path>, bad_evidence:<key> (not a list of texts). Each document is parsed once, into a variant whose parts
    are then typed and compared. Pure expressions over each document; rows are independent, so it scales with the table.
    """
    a, v = F.col("assessment"), F.col("_v")
    allowed_top = ["data_confidence", "data_confidence_reason"] + [k for k, _ in C.CATEGORIES]
    allowed_sub = ["capability", "confidence", "evidence", "limitation"]
    empty = F.array().cast("array<string>")
    found = []  # each entry: array<string> of violation labels (possibly empty)

    def flag(cond, label):
        found.append(F.when(cond, F.array(F.lit(label))).otherwise(empty))

    def extras(cond, keys, allowed, prefix):
        listed = F.array_except(keys, F.array(*[F.lit(x) for x in allowed]))
        found.append(F.when(cond, F.transform(listed, lambda x: F.concat(F.lit(prefix), x))).otherwise(empty))

    def kind(path):
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))

    def text_field(cond, path, values=None):
        text = kind(f"$.{path}") == "STRING"
        flag(cond & ~text, f"bad_type:{path}")
        if values:
            flag(cond & text & ~F.try_variant_get(v, f"$.{path}", "string").isin(*values), f"bad_enum:{path}")

    top_keys = F.map_keys(F.col("_top"))
    flag(F.col("_top").isNull(), "malformed_json")
    valid = F.col("_top").isNotNull()
    for k in allowed_top:
        flag(valid & ~F.array_contains(top_keys, k), f"missing:{k}")
    extras(valid, top_keys, allowed_top, "extra_key:")
    text_field(valid & F.array_contains(top_keys, "data_confidence"), "data_confidence", C.CONFIDENCE_VALUES)
    text_field(valid & F.array_contains(top_keys, "data_confidence_reason"), "data_confidence_reason")
    for k, _ in C.CATEGORIES:
        present = valid & F.array_contains(top_keys, k)
        is_object = kind(f"$.{k}").startswith("OBJECT")
        flag(present & ~is_object, f"bad_type:{k}")
        obj = present & is_object
        sub_keys = F.map_keys(F.try_variant_get(v, f"$.{k}", "map<string,variant>"))
        has = {s: obj & F.array_contains(sub_keys, s) for s in allowed_sub}
        for s in allowed_sub:
            flag(obj & ~F.array_contains(sub_keys, s), f"missing:{k}.{s}")
        extras(obj, sub_keys, allowed_sub, f"extra_key:{k}.")
        text_field(has["capability"], f"{k}.capability", C.CAPABILITY_VALUES)
        text_field(has["confidence"], f"{k}.confidence", C.CONFIDENCE_VALUES)
        text_field(has["limitation"], f"{k}.limitation")
        items = F.try_variant_get(v, f"$.{k}.evidence", "array<variant>")
        texts = F.coalesce(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == "STRING"),
                           F.lit(False))
        flag(has["evidence"] & ~(kind(f"$.{k}.evidence").startswith("ARRAY") & texts), f"bad_evidence:{k}")
    parsed = assessed.withColumn("_v", F.try_parse_json(a))
    is_map = F.schema_of_variant(v).startswith("OBJECT")
    parsed = parsed.withColumn("_top", F.when(is_map, F.try_variant_get(v, "$", "map<string,variant>")))
    return parsed, F.flatten(F.array(*found))
