"""Console views over the planning table.

What the reference computes in the browser over the served rows becomes DataFrame work here: filters, a top-n
(TakeOrderedAndProject), one-pass aggregates, and per-district operations over the bounded (k <= 3) nearest lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deserta.functions import planning as P
from deserta.functions.cleaning import coerce_string, list_preview, short_label, snake_label
from deserta.functions.geo import SERVING_RADIUS_KM, haversine_km
from deserta.operators.thinning import thin_links, thin_within
from deserta.plans.serving import FACILITY_LIST_COLUMNS, KEYS
from deserta.sources.tables import shuffled

# Risk category ids -> scored field, the tier ranks, the map labels of the facility lists and the
# 3 km overlap threshold of the facility thinning.
CATEGORY_FIELDS = {"overall": "overall_care_desert_risk", "maternal": "maternal_neonatal_risk",
                   "diabetes": "diabetes_care_risk", "hypertension": "hypertension_care_risk",
                   "nutrition": "nutrition_services_risk", "cancer": "cancer_screening_risk"}
TIER_RANK = {"Urgent": 4, "High": 3, "Watch": 2, "Monitor": 1}
LIST_LABELS = {"overall": "Nearest capable facilities", "maternal": "Nearest maternal capable facilities",
               "diabetes": "Nearest diabetes capable facilities",
               "hypertension": "Nearest hypertension capable facilities",
               "nutrition": "Nearest nutrition capable facilities",
               "cancer": "Nearest cancer screening capable facilities"}
OVERLAP_KM = 3.0


def tier_rank(col="planning_priority_tier") -> Column:
    c = F.col(col)
    out = F.lit(0)
    for t, r in TIER_RANK.items():
        out = F.when(c == t, F.lit(r)).otherwise(out)
    return out


def scope_filter(planning: DataFrame, state: str | None = None, search: str = "", tier: str | None = None) -> DataFrame:
    """exact trimmed state, case-insensitive district substring, tier."""
    out = planning
    if state is not None:
        out = out.filter(F.trim(F.col("state_ut")) == state)
    if search.strip():
        out = out.filter(F.lower(F.col("district_name")).contains(search.strip().lower()))
    if tier is not None:
        out = out.filter(F.col("planning_priority_tier") == tier)
    return out


def top_interventions(planning: DataFrame, category: str = "overall", n: int = 10, **scope) -> DataFrame:
    """Category risk weight, tier rank and score (all descending); ties in (state, district) order."""
    field = CATEGORY_FIELDS.get(category, CATEGORY_FIELDS["overall"])
    return (scope_filter(planning, **scope)
            .orderBy(P.risk_weight(field).desc(), tier_rank().desc(), F.col("planning_priority_score").desc(),
                     F.col("state_ut").asc_nulls_last(), F.col("district_name").asc_nulls_last())
            .limit(n))


def kpi_summary(planning: DataFrame) -> DataFrame:
    """One pass — Urgent count, Urgent+High count, summed affected population."""
    t = F.col("planning_priority_tier")
    return planning.agg(F.count_if(t == "Urgent").alias("urgent_count"),
                        F.count_if(t.isin("Urgent", "High")).alias("high_or_urgent_count"),
                        F.coalesce(F.sum("affected_population_proxy"), F.lit(0).cast("long")).alias("affected_proxy"))


def distinct_states(planning: DataFrame) -> DataFrame:
    """Trimmed distinct states, sorted."""
    return planning.select(F.trim(F.col("state_ut")).alias("state")).distinct().orderBy("state")


def facilities_for(category: str) -> str:
    return FACILITY_LIST_COLUMNS.get(category, FACILITY_LIST_COLUMNS["overall"])


def map_properties(planning: DataFrame, category: str = "overall") -> DataFrame:
    """P15 (+P16): the properties each district carries on the map for the chosen risk category."""
    field = CATEGORY_FIELDS.get(category, CATEGORY_FIELDS["overall"])
    tier = F.col("planning_priority_tier")
    cleaned = P.clean_facility_list(facilities_for(category))
    return planning.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.concat_ws(":", F.col("state_ut"), F.col("district_name")).alias("key"),
        coerce_string("district_name").alias("district"),
        coerce_string("state_ut").alias("state"),
        F.coalesce(F.col("intervention_priority"), tier).alias("intervention_priority_label"),
        F.when(tier.isin("Urgent", "High", "Watch"), tier).otherwise(F.lit("Low")).alias("intervention_level"),
        tier.alias("planning_tier"),
        F.coalesce(F.col("estimated_population_impact"), F.col("affected_population_proxy").cast("double"))
        .alias("population"),
        F.col("planning_priority_score").alias("priority_score"),
        P.risk_weight(field).alias("risk_weight"),
        F.col("primary_risk_driver"),
        F.to_json(F.transform(cleaned, lambda x: F.struct(coerce_string(x["name"]).alias("name"),
                                                          x["distance_kilometers"].alias("distance_kilometers"))))
        .alias("capable_facilities_json"),
        cleaned.alias("capable_facilities_list"),
        F.lit(LIST_LABELS.get(category, LIST_LABELS["overall"])).alias("capable_facilities_label"),
        F.lit(True).alias("is_reported"),
        F.col("longitude"), F.col("latitude"),
    )


def district_point_features(props: DataFrame) -> DataFrame:
    """One GeoJSON Point Feature (JSON text) per mapped district."""
    keep = [c for c in props.columns if c not in ("longitude", "latitude", "capable_facilities_list")]
    return props.select("key", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(*keep).alias("properties"))).alias("feature"))


def thin_nearest(nearest: DataFrame, min_km: float = OVERLAP_KM) -> DataFrame:
    """Per (district, category), walk the nearest facilities by distance and drop any within ``min_km`` of
    one already kept. The lists hold at most k rows, so the walk is an ``aggregate`` over a bounded array."""
    group = KEYS + ["category"]
    fields = [c for c in nearest.columns if c not in group]
    arr = F.sort_array(F.collect_list(F.struct("distance_kilometers", "unique_id", *[c for c in fields if c not in (
        "distance_kilometers", "unique_id")])))
    empty = F.filter(F.col("_all"), lambda x: F.lit(False))

    def step(acc, x):
        close = F.exists(acc, lambda a: haversine_km(a["facility_latitude"], a["facility_longitude"],
                                                     x["facility_latitude"], x["facility_longitude"],
                                                     SERVING_RADIUS_KM) < min_km)
        return F.when(close, acc).otherwise(F.concat(acc, F.array(x)))

    return (nearest.groupBy(*group).agg(arr.alias("_all"))
            .select(*group, F.explode(F.aggregate("_all", empty, step)).alias("_f"))
            .select(*group, "_f.*"))


def thin_all_links(links: DataFrame, min_km: float = OVERLAP_KM) -> DataFrame:
    """G2 for the whole distance table: per district, all linked facilities by distance without those that overlap a kept one."""
    return thin_links(links, ["district", "statename"], ["distance_kilometers", "unique_id"], "facility_latitude",
                      "facility_longitude", min_km)


def thin_all_facilities(facilities: DataFrame, centers: DataFrame, min_km: float = OVERLAP_KM) -> DataFrame:
    """``thin_all_links`` of the distance table of ``facilities`` and ``centers`` (a row per district). The links grow with
    facilities times districts and are not written; each is made where it is compared."""
    from deserta.functions.geo import ETL_RADIUS_KM
    from deserta.plans.distances import DISTANCE_CAP_KM, DISTANCE_COLUMNS, facility_points

    return thin_within(facility_points(facilities), ["unique_id"], "facility_latitude", "facility_longitude", centers, "center_latitude",
                       "center_longitude", DISTANCE_CAP_KM, min_km, ETL_RADIUS_KM).select(*DISTANCE_COLUMNS)


def facility_features(thinned: DataFrame) -> DataFrame:
    """Per shown facility a LineString (center -> facility), a Point with popup properties and a label Point
    at the midpoint, as GeoJSON Feature text."""
    dist_label = F.concat(P.one_decimal_text(F.col("distance_kilometers")), F.lit(" km"))
    line = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("LineString").alias("type"),
                             F.array(F.array("center_longitude", "center_latitude"),
                                     F.array("facility_longitude", "facility_latitude")).alias("coordinates"))
                    .alias("geometry"),
                    F.struct(F.col("unique_id").alias("id"), F.col("name"), dist_label.alias("distanceLabel"))
                    .alias("properties"))
    point = F.struct(F.lit("Feature").alias("type"),
                     F.struct(F.lit("Point").alias("type"),
                              F.array("facility_longitude", "facility_latitude").alias("coordinates")).alias("geometry"),
                     F.struct(F.col("unique_id").alias("id"), F.col("name"), short_label("name").alias("labelName"),
                              dist_label.alias("distanceLabel"),
                              snake_label("category_capability").alias("capability"),
                              snake_label(F.coalesce("category_confidence", "data_confidence")).alias("confidence"),
                              list_preview(F.coalesce("category_evidence", "data_confidence_reason"), 2)
                              .alias("evidence"),
                              F.coalesce("address_city", F.lit("")).alias("city"),
                              F.coalesce("address_stateOrRegion", F.lit("")).alias("state"),
                              F.coalesce("description", F.lit("")).alias("description"),
                              list_preview("specialties").alias("specialties"),
                              list_preview("equipment").alias("equipment"),
                              list_preview("procedure", 2).alias("procedure")).alias("properties"))
    label = F.struct(F.lit("Feature").alias("type"),
                     F.struct(F.lit("Point").alias("type"),
                              F.array(((F.col("center_longitude") + F.col("facility_longitude")) / 2),
                                      ((F.col("center_latitude") + F.col("facility_latitude")) / 2))
                              .alias("coordinates")).alias("geometry"),
                     F.struct(F.col("unique_id").alias("id"), F.col("name"), dist_label.alias("distanceLabel"))
                     .alias("properties"))
    return thinned.select(*KEYS, "category", "unique_id",
                          F.to_json(line).alias("line_feature"), F.to_json(point).alias("point_feature"),
                          F.to_json(label).alias("label_feature"))


def map_bounds(thinned: DataFrame, geo: DataFrame) -> DataFrame:
    """Per (district, category), the box around the district point and its shown facilities."""
    pts = thinned.select(*KEYS, "category", F.col("facility_longitude").alias("lon"),
                         F.col("facility_latitude").alias("lat"))
    centers = thinned.select(*KEYS, "category").distinct().join(
        shuffled(geo.select(*KEYS, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))), KEYS)
    return (pts.unionByName(centers).groupBy(*KEYS, "category")
            .agg(F.min("lon").alias("min_longitude"), F.min("lat").alias("min_latitude"),
                 F.max("lon").alias("max_longitude"), F.max("lat").alias("max_latitude")))


def map_rank_key(category: str = "overall") -> Column:
    """Sort key of the map rows (the T2 order): smaller sorts first."""
    field = CATEGORY_FIELDS.get(category, CATEGORY_FIELDS["overall"])
    return F.struct((-P.risk_weight(field)).alias("w"), (-tier_rank()).alias("t"),
                    (-F.col("planning_priority_score")).alias("s"), F.col("state_ut"), F.col("district_name"))


def boundary_matches(boundaries: DataFrame, planning: DataFrame, category: str = "overall",
                     cell_deg: float = 1.0) -> DataFrame:
    """J7 over the map rows: (feature_index, key) per boundary that gets a district."""
    from deserta.operators.polygon import point_in_polygon_join

    pts = planning.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()) \
        .withColumn("key", F.concat_ws(":", F.col("state_ut"), F.col("district_name")))
    return point_in_polygon_join(boundaries, pts, "key", map_rank_key(category), cell_deg)


def boundary_properties(boundaries: DataFrame, planning: DataFrame, category: str = "overall",
                        cell_deg: float = 1.0) -> DataFrame:
    """Every boundary with its district's map properties, or the 'Unreported' defaults when none matched."""
    props = map_properties(planning, category).drop("longitude", "latitude", "capable_facilities_list")
    matched = boundary_matches(boundaries, planning, category, cell_deg).join(shuffled(props), "key")
    b = boundaries.select("feature_index", "NAME_1", "NAME_2")
    j = b.join(shuffled(matched), "feature_index", "left")
    reported = F.col("key").isNotNull()

    def pick(col: str, default) -> Column:
        return F.when(reported, F.col(col)).otherwise(default)

    district = F.coalesce(F.col("NAME_2"), F.lit("Unreported district"))
    state = F.coalesce(F.col("NAME_1"), F.lit("Unreported state"))
    return j.select(
        "feature_index",
        pick("key", F.lit("")).alias("key"),
        pick("district", district).alias("district"),
        pick("state", state).alias("state"),
        pick("intervention_priority_label", F.lit("Unreported")).alias("intervention_priority_label"),
        pick("intervention_level", F.lit("Unreported")).alias("intervention_level"),
        pick("planning_tier", F.lit("Monitor")).alias("planning_tier"),
        pick("population", F.lit(0.0)).alias("population"),
        pick("priority_score", F.lit(0)).alias("priority_score"),
        pick("risk_weight", F.lit(0)).alias("risk_weight"),
        pick("primary_risk_driver", F.lit("No district indicator record")).alias("primary_risk_driver"),
        pick("capable_facilities_json", F.lit("[]")).alias("capable_facilities_json"),
        pick("capable_facilities_label", F.lit(LIST_LABELS["overall"])).alias("capable_facilities_label"),
        reported.alias("is_reported"),
        F.coalesce(F.col("NAME_2"), pick("district", F.lit("Unreported district"))).alias("boundary_district"),
        F.coalesce(F.col("NAME_1"), pick("state", F.lit("Unreported state"))).alias("boundary_state"),
    )


def boundary_features(boundaries: DataFrame, planning: DataFrame, category: str = "overall",
                      cell_deg: float = 1.0) -> DataFrame:
    """J8 as GeoJSON: (feature_index, id, feature) of every boundary, with its geometry and the properties above. The id is
    the district's key, or names and index of an unreported boundary."""
    return boundary_features_with_schema(boundaries, planning, category, cell_deg)[0]


def boundary_features_with_schema(boundaries: DataFrame, planning: DataFrame, category: str = "overall",
                                  cell_deg: float = 1.0) -> tuple[DataFrame, StructType]:
    """``boundary_features`` and the schema of the Features' properties, from one matching of the boundaries."""
    props = boundary_properties(boundaries, planning, category, cell_deg)
    j = props.join(shuffled(boundaries.select("feature_index", "geometry")), "feature_index")
    unreported = F.concat_ws(":", F.lit("unreported"), "boundary_state", "boundary_district", "feature_index")
    named = j.withColumn("id", F.when(F.col("is_reported"), F.col("key")).otherwise(unreported))
    return named.select("feature_index", "id", F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("id"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates")).alias("geometry"),
        F.struct(*[c for c in props.columns if c != "feature_index"]).alias("properties"))).alias("feature")), \
        props.drop("feature_index").schema


def district_center_features(planning: DataFrame) -> DataFrame:
    """The Point Feature of each selectable district, where both coordinates are known and not zero."""
    at = planning.where("longitude <> 0 AND latitude <> 0 AND NOT isnan(longitude) AND NOT isnan(latitude)")
    key = F.concat_ws(":", F.col("state_ut"), F.col("district_name"))
    return at.select(key.alias("key"), F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(key.alias("key"), F.trim("district_name").alias("district")).alias("properties"))).alias("feature"))
