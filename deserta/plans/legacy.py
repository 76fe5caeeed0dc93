"""Older console.

The greedy pairwise merging of on-screen circles is sequential and order-dependent; it is re-aimed as a pixel-grid
cluster key (G4) feeding a grouped, partially aggregated rollup (A12). Placeholder jitter is not built: a district
takes its geocoded center when one is given, else its state centroid (J9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deserta.functions.cleaning import coerce_number, coerce_string
from deserta.functions.geo import mercator_pixels
from deserta.operators.clusters import proximity_clusters
from deserta.plans.indicators import INDICATOR_COLUMNS

# State centroids (lower-case state -> latitude, longitude) and the fallback centroid.
STATE_CENTROIDS = {
    "andhra pradesh": (15.9129, 79.74), "arunachal pradesh": (28.218, 94.7278), "assam": (26.2006, 92.9376),
    "bihar": (25.0961, 85.3131), "chandigarh": (30.7333, 76.7794), "chhattisgarh": (21.2787, 81.8661),
    "delhi": (28.7041, 77.1025), "goa": (15.2993, 74.124), "gujarat": (22.2587, 71.1924),
    "haryana": (29.0588, 76.0856), "himachal pradesh": (31.1048, 77.1734), "jammu and kashmir": (33.7782, 76.5762),
    "jharkhand": (23.6102, 85.2799), "karnataka": (15.3173, 75.7139), "kerala": (10.8505, 76.2711),
    "ladakh": (34.2268, 77.5619), "lakshadweep": (10.5667, 72.6417), "madhya pradesh": (22.9734, 78.6569),
    "maharashtra": (19.7515, 75.7139), "manipur": (24.6637, 93.9063), "meghalaya": (25.467, 91.3662),
    "mizoram": (23.1645, 92.9376), "nagaland": (26.1584, 94.5624), "odisha": (20.9517, 85.0985),
    "puducherry": (11.9416, 79.8083), "punjab": (31.1471, 75.3412), "rajasthan": (27.0238, 74.2179),
    "sikkim": (27.533, 88.5122), "tamil nadu": (11.1271, 78.6569), "telangana": (18.1124, 79.0193),
    "tripura": (23.9408, 91.9882), "uttar pradesh": (26.8467, 80.9462), "uttarakhand": (30.0668, 79.0193),
    "west bengal": (22.9868, 87.855),
}
DEFAULT_CENTROID = (22.9734, 78.6569)
# Per category the risk field and the score fields with their labels.
LEGACY_CATEGORIES = {
    "overall": ("overall_care_desert_risk", (("maternal_neonatal_access_score", "Maternal access score"),
                                             ("cancer_screening_score", "Cancer score"))),
    "maternal": ("maternal_neonatal_risk", (
        ("maternal_neonatal_institutional_birth_pct", "Institutional birth"),
        ("maternal_neonatal_csection_pct", "C-section"), ("maternal_neonatal_anc_visits_pct", "ANC visits"),
        ("maternal_neonatal_skilled_birth_pct", "Skilled birth"),
        ("maternal_neonatal_access_score", "Maternal access score"),
        ("maternal_neonatal_skilled_attendance_gap", "Skilled attendance gap"))),
    "diabetes": ("diabetes_care_risk", (("diabetes_care_high_blood_sugar_pct", "High blood sugar"),)),
    "hypertension": ("hypertension_care_risk", (("hypertension_care_high_bp_pct", "High BP"),)),
    "nutrition": ("nutrition_services_risk", (("nutrition_services_underweight_pct", "Underweight"),)),
    "cancer": ("cancer_screening_risk", (("cancer_screening_cervical_pct", "Cervical screen"),
                                         ("cancer_screening_breast_pct", "Breast screen"),
                                         ("cancer_screening_oral_pct", "Oral screen"))),
}
DATA_POOR_HOUSEHOLDS = 500
UNKNOWN_PRIORITY = "Unknown Priority"


def priority_join_v1(indicators: DataFrame, master: DataFrame) -> DataFrame:
    """INNER join on trimmed (case-sensitive) keys, overall risk present."""
    i = indicators.withColumn("_d", F.trim("district_name")).withColumn("_s", F.trim("state_ut"))
    m = master.select(F.trim("district_name").alias("_d"), F.trim("state_ut").alias("_s"),
                      "intervention_priority", "estimated_population_impact")
    return (i.filter(F.col("overall_care_desert_risk").isNotNull()).join(m, ["_d", "_s"])
            .select(*INDICATOR_COLUMNS, "intervention_priority", "estimated_population_impact"))


def state_centroids(spark) -> DataFrame:
    """The fixed 34-row centroid table (size bounded by the constant, safe to broadcast)."""
    return spark.createDataFrame([(k, v[0], v[1]) for k, v in STATE_CENTROIDS.items()],
                                 "state_lc string, centroid_latitude double, centroid_longitude double")


def state_centroid_lookup(df: DataFrame, state_col: str = "state_ut") -> DataFrame:
    """Lower-cased trimmed state -> centroid, else the fallback centroid."""
    c = F.broadcast(state_centroids(df.sparkSession))
    j = df.withColumn("state_lc", F.lower(coerce_string(state_col))).join(c, "state_lc", "left").drop("state_lc")
    return (j.withColumn("centroid_latitude", F.coalesce("centroid_latitude", F.lit(DEFAULT_CENTROID[0])))
            .withColumn("centroid_longitude", F.coalesce("centroid_longitude", F.lit(DEFAULT_CENTROID[1]))))


def severity(label: Column) -> Column:
    v = F.lower(label)
    return (F.when(v.contains("high"), F.lit(0.92)).when(v.contains("medium") | v.contains("moderate"), F.lit(0.58))
            .when(v.contains("low"), F.lit(0.22)).otherwise(F.lit(0.4)))


def priority_rank(label: Column) -> Column:
    v = F.lower(label)
    return (F.when(v.contains("critical"), F.lit(3)).when(v.contains("high"), F.lit(2))
            .when(v.contains("low"), F.lit(1)).otherwise(F.lit(0)))


def recommended_action(rank: Column) -> Column:
    """The action text of a priority rank."""
    # The three texts.
    return (F.when(rank >= 3, F.lit("Prioritize immediate field validation and intervention planning for this cluster."))
            .when(rank == 2, F.lit("Queue this cluster for near-term service readiness review."))
            .otherwise(F.lit("Monitor this cluster and focus urgent resources on higher-priority circles.")))


def score_list(category: str) -> Column:
    """The category's score fields as an array of (label, value); NULL stays NULL."""
    _, fields = LEGACY_CATEGORIES.get(category, LEGACY_CATEGORIES["overall"])
    return F.array(*[F.struct(F.lit(label).alias("label"), F.col(f).cast("double").alias("value"))
                     for f, label in fields])


def legacy_points(rows: DataFrame, category: str = "overall", geo: DataFrame | None = None) -> DataFrame:
    """P17 + F3 flag: one point per row with severity, confidence, data-poor flag, priority and impact.
    Coordinates: the district's geocoded center from ``geo`` (keys district_key/state_key) when given, else J9."""
    risk_field, _ = LEGACY_CATEGORIES.get(category, LEGACY_CATEGORIES["overall"])
    r = state_centroid_lookup(rows)
    if geo is not None:
        r = (r.withColumn("district_key", F.upper(F.trim("district_name")))
             .withColumn("state_key", F.upper(F.trim("state_ut")))
             .join(geo.select("district_key", "state_key", F.col("latitude").alias("_glat"),
                              F.col("longitude").alias("_glon")), ["district_key", "state_key"], "left"))
        lat, lon = F.coalesce("_glat", "centroid_latitude"), F.coalesce("_glon", "centroid_longitude")
    else:
        lat, lon = F.col("centroid_latitude"), F.col("centroid_longitude")
    district = F.when(coerce_string("district_name") != "", coerce_string("district_name")).otherwise("Unknown district")
    state = F.when(coerce_string("state_ut") != "", coerce_string("state_ut")).otherwise("Unknown state")
    risk = F.when(coerce_string(risk_field) != "", coerce_string(risk_field)).otherwise("Unknown")
    prio = F.when(coerce_string("intervention_priority") != "", coerce_string("intervention_priority")) \
        .otherwise(UNKNOWN_PRIORITY)
    households = coerce_number("households_surveyed")
    return r.select(
        F.concat(coerce_string("district_name"), F.lit("||"), coerce_string("state_ut")).alias("id"),
        district.alias("district"), state.alias("state"), lat.alias("latitude"), lon.alias("longitude"),
        households.alias("households"), coerce_number("women_15_49_interviewed").alias("women"),
        risk.alias("risk_label"), severity(risk).alias("severity"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.18), F.log10(F.greatest(F.lit(10.0), households)) / 5.0))
        .alias("confidence"),
        (households < DATA_POOR_HOUSEHOLDS).alias("data_poor"),
        prio.alias("intervention_priority"), priority_rank(prio).alias("priority_rank"),
        coerce_number("estimated_population_impact").alias("population_impact"),
        recommended_action(priority_rank(prio)).alias("recommended_action"), score_list(category).alias("scores"),
    )


def legacy_scores(rows: DataFrame, category: str = "overall") -> DataFrame:
    """P17 scores: the category's score fields in long form (id, label, value); NULL stays NULL."""
    return rows.select(F.concat(coerce_string("district_name"), F.lit("||"), coerce_string("state_ut")).alias("id"),
                       F.posexplode(score_list(category)).alias("position", "s")).select("id", "position", "s.label", "s.value")


def not_data_poor(points: DataFrame) -> DataFrame:
    """F3."""
    return points.filter(~F.col("data_poor"))


def cluster_cells(points: DataFrame, zoom: float = 4.0, cell_px: float = 64.0) -> DataFrame:
    """G3 + G4: Web-Mercator pixels at ``zoom`` and the pixel-grid cell used as the cluster key."""
    x, y = mercator_pixels("longitude", "latitude", zoom)
    return (points.withColumn("x", x).withColumn("y", y)
            .withColumn("cluster_key", F.concat_ws(":", F.floor(F.col("x") / cell_px).cast("string"),
                                                   F.floor(F.col("y") / cell_px).cast("string"))))


def proximity_cluster_points(points: DataFrame, zoom: float = 4.0) -> DataFrame:
    """G4 across cell edges: the points with the key of the cluster of touching circles that each belongs to."""
    return points.join(proximity_clusters(points, zoom), "id")


def weighted_cluster_rollup(points: DataFrame, key: str = "cluster_key") -> DataFrame:
    """Per cluster — sums, impact-weighted centroid (weight max(impact, 1)), strongest priority, max
    severity, mean confidence, all-data-poor, member and state counts, action text, and the largest-impact member as
    the representative, with its scores. Coordinates (1e-7 degree), weights (1e-3) and confidences (1e-9) are summed as
    integers, so the result does not depend on the order of the rows. One grouped aggregation; every aggregate is partial-able, so a hot cluster stays cheap."""
    def whole(c: Column, scale: float, digits: int) -> Column:
        return F.round(c * scale).cast(f"decimal({digits},0)")

    w = whole(F.greatest(F.col("population_impact"), F.lit(1.0)), 1e3, 18)
    agg = points.groupBy(key).agg(
        F.sum("population_impact").alias("population_impact"), F.sum("households").alias("households"),
        F.sum("women").alias("women"), F.sum(w).alias("_w"),
        F.sum(whole(F.col("longitude"), 1e7, 10) * w).alias("_wlon"),
        F.sum(whole(F.col("latitude"), 1e7, 10) * w).alias("_wlat"),
        F.max(F.struct("priority_rank", "intervention_priority")).alias("_p"),
        F.max("severity").alias("severity"), F.sum(whole(F.col("confidence"), 1e9, 10)).alias("_confidence"),
        F.bool_and("data_poor").alias("data_poor"), F.count(F.lit(1)).alias("member_count"),
        F.count_distinct("state").alias("state_count"),
        F.max(F.struct("population_impact", F.col("id").alias("_id"), "district", "state", "risk_label", "scores"))
        .alias("_rep"),
    )
    n = F.col("member_count")
    strongest = F.when(F.col("_p.priority_rank") > 0, F.col("_p.intervention_priority")).otherwise(UNKNOWN_PRIORITY)
    return agg.select(
        key, F.col("_rep._id").alias("representative_id"),
        F.when(n == 1, F.col("_rep.district")).otherwise(F.concat(n.cast("string"), F.lit(" districts")))
        .alias("district"),
        F.when(n == 1, F.col("_rep.state")).otherwise(F.concat(F.col("state_count").cast("string"), F.lit(" states")))
        .alias("state"),
        *[(F.col(c).cast("double") / F.col("_w").cast("double") / 1e7).alias(name)
          for c, name in (("_wlat", "latitude"), ("_wlon", "longitude"))],
        "households", "women",
        F.when(n == 1, F.col("_rep.risk_label")).otherwise(F.lit("Aggregated care desert signal")).alias("risk_label"),
        "severity", (F.col("_confidence").cast("double") / n / 1e9).alias("confidence"), "data_poor", strongest.alias("intervention_priority"),
        F.col("_p.priority_rank").alias("priority_rank"), "population_impact", "member_count",
        recommended_action(F.col("_p.priority_rank")).alias("recommended_action"), F.col("_rep.scores").alias("scores"),
    )


def priority_band_counts(clusters: DataFrame) -> DataFrame:
    """Clusters by priority band (rank >= 3 / 2 / 1 / other) in one pass."""
    r = F.col("priority_rank")
    return clusters.agg(F.count_if(r >= 3).alias("high"), F.count_if(r == 2).alias("moderate"),
                        F.count_if(r == 1).alias("adequate"), F.count_if(r <= 0).alias("data_poor"))


def category_high_counts(rows: DataFrame) -> DataFrame:
    """A10: per category, rows whose label maps to severity >= 0.75; one pass, then unpivoted."""
    cols = [F.count_if(severity(coerce_string(f)) >= 0.75).alias(c) for c, (f, _) in LEGACY_CATEGORIES.items()]
    wide = rows.agg(*cols)
    return wide.unpivot([], list(LEGACY_CATEGORIES), "category", "high_count")


def ranked_clusters(clusters: DataFrame, n: int = 12) -> DataFrame:
    """Clusters that are not data-poor, by priority rank then impact (both descending), first n."""
    return (not_data_poor(clusters)
            .orderBy(F.col("priority_rank").desc(), F.col("population_impact").desc(), F.col("cluster_key"))
            .limit(n))
