"""Serving tables and the district join.

Every table here is keyed by district or facility. The only large inputs are the facility/district link table and
the facility directory; they are aggregated (partial aggregation before each shuffle) or joined by the grid
operators. District-keyed sides are small and bounded by geography; AQE broadcasts them once their measured size
is under the broadcast threshold and keeps a shuffle join otherwise.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deserta.functions.capability import CATEGORIES, overall_capability
from deserta.functions.cleaning import normalize_key
from deserta.functions.geo import SERVING_RADIUS_KM
from deserta.operators.knn import knn_join, ordered_topk
from deserta.sources.tables import shuffled

# Service names of the serving layer, their capability columns and closest-distance columns.
SERVICES = ("overall", "maternal", "diabetes", "hypertension", "nutrition", "cancer")
SERVICE_CAPABILITY = {"maternal": "maternal_neonatal_capability", "diabetes": "diabetes_capability",
                      "hypertension": "hypertension_capability", "nutrition": "nutrition_capability",
                      "cancer": "cancer_screening_capability"}
CLOSEST_COLUMNS = {s: f"closest_{s}_facility_km" for s in SERVICES[1:]}
FACILITY_LIST_COLUMNS = {"overall": "capable_facilities", **{s: f"{s}_capable_facilities" for s in SERVICES[1:]}}
KEYS = ["district_key", "state_key"]


def with_keys(df: DataFrame, district: str, state: str, mode: str = "upper") -> DataFrame:
    return df.withColumn("district_key", normalize_key(district, mode)).withColumn("state_key",
                                                                                normalize_key(state, mode))


def district_geo(distances: DataFrame, mode: str = "upper") -> DataFrame:
    """A2: per normalised (district, state) key, the mean center over link rows (summed as integers at 1e-7
    degree, so order-independent) and the link count. ``distances``: the link rows, or their sums (``link_sums``)."""
    from deserta.plans.distances import exact_mean, exact_mean_parts

    links = F.col("facility_links") if "facility_links" in distances.columns else F.lit(1).cast("long")
    return (
        with_keys(distances.filter(F.col("center_latitude").isNotNull() & F.col("center_longitude").isNotNull()),
                  "district", "statename", mode)
        .groupBy(*KEYS)
        .agg(F.sum(exact_mean_parts(F.col("center_latitude")) * links).alias("_slat"),
             F.sum(exact_mean_parts(F.col("center_longitude")) * links).alias("_slon"),
             F.sum(links).alias("_n"))
        .select(*KEYS, exact_mean("_slat", "_n").alias("latitude"), exact_mean("_slon", "_n").alias("longitude"),
                F.col("_n").cast("int").alias("facility_links"))
    )


def district_center_of(distances: DataFrame, district: str, state: str, mode: str = "upper") -> DataFrame:
    """A3: the center of one district over its link rows, by the same key normalisation — always one row
    (NULL center when nothing matches), like a global average after a filter. The batch form is A2."""
    from deserta.plans.distances import exact_mean, exact_mean_parts

    keyed = with_keys(distances.filter(F.col("center_latitude").isNotNull()
                                       & F.col("center_longitude").isNotNull()), "district", "statename", mode)
    hit = keyed.filter((F.col("district_key") == normalize_key(F.lit(district), mode))
                       & (F.col("state_key") == normalize_key(F.lit(state), mode)))
    agg = hit.agg(F.sum(exact_mean_parts(F.col("center_latitude"))).alias("_slat"),
                  F.sum(exact_mean_parts(F.col("center_longitude"))).alias("_slon"),
                  F.count(F.lit(1)).alias("_n"))
    return agg.select(F.when(F.col("_n") > 0, exact_mean("_slat", "_n")).alias("center_latitude"),
                      F.when(F.col("_n") > 0, exact_mean("_slon", "_n")).alias("center_longitude"))


def district_centers_of(distances: DataFrame, asked: DataFrame, mode: str = "upper") -> DataFrame:
    """A3 for a table ``asked`` (district, state) in any spelling: each of its rows with the center of its district over the
    link rows, NULL when nothing matches. One aggregation of the links and one join on the normalised keys."""
    geo = district_geo(distances, mode).select("district_key", "state_key", F.col("latitude").alias("center_latitude"),
                                               F.col("longitude").alias("center_longitude"))
    return with_keys(asked, "district", "state", mode).join(geo, ["district_key", "state_key"], "left").select(
        "district", "state", "center_latitude", "center_longitude")


def facility_locations(facilities: DataFrame) -> DataFrame:
    """One row per facility of the directory with coordinates, however far it is from every district. Of several
    rows of one id the smallest is kept whole (min() over a struct, partially aggregated before the shuffle)."""
    from deserta.plans.distances import facility_points

    points = facility_points(facilities)
    row = F.struct(*[c for c in points.columns if c != "unique_id"])
    return points.groupBy("unique_id").agg(F.min(row).alias("_r")).select("unique_id", "_r.*")


def attach_capability(facilities: DataFrame, capability: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """LEFT equi-join of the capability columns on ``unique_id``."""
    cols = columns or [f"{p}_capability" for _, p in CATEGORIES]
    return facilities.join(shuffled(capability.select("unique_id", *[c for c in cols if c != "unique_id"])), "unique_id", "left")


def capable_services(located: DataFrame) -> DataFrame:
    """one row per (facility, service) the facility is capable of; 'overall' when any service is capable."""
    flags = [F.when(overall_capability() == "capable", F.lit("overall"))]
    flags += [F.when(F.col(c) == "capable", F.lit(s)) for s, c in SERVICE_CAPABILITY.items()]
    return located.withColumn("service", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())))


def knn_capable_long(geo: DataFrame, located_capability: DataFrame, k: int = 3) -> DataFrame:
    """J6 (long form): k nearest capable facilities per (district, service), ranked 1..k."""
    pts = capable_services(located_capability).select("unique_id", "name", "facility_latitude",
                                                      "facility_longitude", "service")
    centers = geo.select(*KEYS, "latitude", "longitude").withColumn(
        "service", F.explode(F.array(*[F.lit(s) for s in SERVICES])))
    return knn_join(centers, KEYS, "latitude", "longitude", pts, "facility_latitude", "facility_longitude", k=k,
                    group_col="service", earth_radius_km=SERVING_RADIUS_KM)


def capable_facilities(geo: DataFrame, knn_long: DataFrame) -> DataFrame:
    """J6 + A5: per district, six ordered arrays of struct(name, distance_kilometers) (empty when none) and the
    five closest-capable distances taken from the first element."""
    arrays = ordered_topk(knn_long, KEYS + ["service"], ["name", "distance_kilometers"])
    wide = arrays.groupBy(*KEYS).pivot("service", list(SERVICES)).agg(F.first("facilities"))
    empty = F.array().cast("array<struct<name:string,distance_kilometers:double>>")
    out = geo.select(*KEYS).join(shuffled(wide), KEYS, "left")
    cols = [F.col(c) for c in KEYS]
    cols += [F.coalesce(F.col(s), empty).alias(FACILITY_LIST_COLUMNS[s]) for s in SERVICES]
    cols += [F.try_element_at(F.col(s), F.lit(1))["distance_kilometers"].alias(CLOSEST_COLUMNS[s])
             for s in SERVICES[1:]]
    return out.select(*cols)


def rated_links(facilities: DataFrame, centers: DataFrame, capability: DataFrame) -> DataFrame:
    """J2 before J1: the link table with the capability columns, which the facilities bring along. The links outnumber the facilities
    by the districts within reach; joined here, neither they nor the capability table are shuffled or written for it."""
    from deserta.plans.distances import facility_district_distances

    columns = list(SERVICE_CAPABILITY.values())
    return facility_district_distances(attach_capability(facilities, capability, columns), centers, carry=columns)


def link_sums(facilities: DataFrame, centers: DataFrame, capability: DataFrame | None = None) -> DataFrame:
    """What ``district_geo`` and ``master_view`` need of the link table (J1), per row of ``centers`` with a link: its coordinates and
    ``facility_links``; with ``capability`` (J2) also the facilities by distance and the closest capable one per service. The
    links grow with facilities times districts and are not made: they are summed up over grid cells, and the closest
    facilities are searched for. A facility counts as often as it has rows, and rows in ``capability``. Eager."""
    from deserta.functions.geo import ETL_RADIUS_KM
    from deserta.operators.range_count import within_distance_sums
    from deserta.plans.distances import DISTANCE_CAP_KM, facility_points
    from deserta.sources.tables import checkpoint_table

    at = ["center_latitude", "center_longitude"]
    ctr = checkpoint_table(centers.select("district", "statename", *at).withColumn("_center", F.monotonically_increasing_id()), "link_centers")
    counted = facilities.withColumn("links", F.lit(1).cast("long"))
    weights, radii = ["links"], {"160": DISTANCE_CAP_KM}
    if capability is not None:
        rows = capability.groupBy("unique_id").agg(F.count(F.lit(1)).alias("rated"))
        counted = counted.join(shuffled(rows), "unique_id", "left").withColumn("rated", F.coalesce("rated", "links"))
        weights, radii = ["links", "rated"], {"160": DISTANCE_CAP_KM, "60": 60.0, "30": 30.0}
    where = ["facility_latitude", "facility_longitude"]
    def summed() -> DataFrame:
        sums = within_distance_sums(facility_points(counted, weights), *where, weights, ctr, "_center", *at, radii, ETL_RADIUS_KM)
        return checkpoint_table(ctr.join(shuffled(sums), "_center").withColumnRenamed("links_160", "facility_links"), "link_counts")

    if capability is None:
        return summed().drop("_center")
    rated = facility_points(attach_capability(facilities, capability, list(SERVICE_CAPABILITY.values())), list(SERVICE_CAPABILITY.values()))
    able = F.array(*[F.when(F.col(c) == "capable", F.lit(s)) for s, c in SERVICE_CAPABILITY.items()])
    able = rated.select("unique_id", *where, F.explode(F.array_compact(able)).alias("service"))
    asked = ctr.select("_center", *at, F.explode(F.array(*[F.lit(s) for s in SERVICE_CAPABILITY])).alias("service"))
    with ThreadPoolExecutor(max_workers=2) as pool:  # two chains of small jobs
        counts, nearest = pool.submit(summed), pool.submit(
            knn_join, asked, ["_center"], *at, able, *where, k=1, group_col="service", earth_radius_km=ETL_RADIUS_KM)
        out, closest = counts.result(), nearest.result()
    per_service = [F.min(F.when(F.col("service") == s, F.col("distance_kilometers"))).alias(c) for s, c in CLOSEST_COLUMNS.items()]
    wide = closest.where(F.col("distance_kilometers") <= DISTANCE_CAP_KM).groupBy("_center").agg(*per_service)
    return out.join(shuffled(wide), "_center", "left").select(
        "district", "statename", *at, "facility_links", F.col("rated_160").alias("total_facilities"),
        F.col("rated_30").alias("facilities_within_30km"), F.col("rated_60").alias("facilities_within_60km"), *CLOSEST_COLUMNS.values())


def master_view(master_inputs: DataFrame, distances: DataFrame, capability: DataFrame,
                mode: str = "upper") -> DataFrame:
    """H1-H3: master inputs + per-district facility counts (total, <=30 km, <=60 km) and closest capable
    distance per service over the capped link table; one aggregation, one shuffle. Links that carry the capability columns
    (``rated_links``) need no join with ``capability``; their sums (``link_sums``) are summed up further."""
    inputs = with_keys(master_inputs, "district_name", "state_ut", mode)
    if "total_facilities" in distances.columns:
        metrics = with_keys(distances, "district", "statename", mode).groupBy(*KEYS).agg(
            *[F.sum(c).cast("int").alias(c) for c in MASTER_COLUMNS[:3]], *[F.min(c).alias(c) for c in CLOSEST_COLUMNS.values()])
        return inputs.join(shuffled(metrics), KEYS, "left").drop(*KEYS)
    d = F.col("distance_kilometers")
    rated = set(SERVICE_CAPABILITY.values()) <= set(distances.columns)
    linked = with_keys(distances if rated else attach_capability(distances, capability), "district", "statename", mode)
    metrics = linked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("int").alias("total_facilities"),
        F.count_if(d <= 30).cast("int").alias("facilities_within_30km"),
        F.count_if(d <= 60).cast("int").alias("facilities_within_60km"),
        *[F.min(F.when(F.col(c) == "capable", d)).alias(CLOSEST_COLUMNS[s]) for s, c in SERVICE_CAPABILITY.items()],
    )
    return inputs.join(metrics, KEYS, "left").drop(*KEYS)


MASTER_COLUMNS = ("total_facilities", "facilities_within_30km", "facilities_within_60km",
                  *CLOSEST_COLUMNS.values(), "overall_availability_score", "overall_availability_category",
                  "intervention_priority", "estimated_population_impact")


def one_row_per_district(master: DataFrame, mode: str = "upper") -> DataFrame:
    """One master row per normalised key. Tie-break: the smallest row over the remaining columns in declared
    order (NULLs first) — a min() over a struct, partially aggregated, so a duplicated hot key stays cheap."""
    keyed = with_keys(master, "district_name", "state_ut", mode)
    return (keyed.groupBy(*KEYS).agg(F.min(F.struct(*[F.col(c) for c in MASTER_COLUMNS])).alias("_m"))
            .select(*KEYS, *[F.col(f"_m.{c}").alias(c) for c in MASTER_COLUMNS]))


def district_serving_join(indicators: DataFrame, geo: DataFrame, master: DataFrame, capable: DataFrame,
                          mode: str = "upper") -> DataFrame:
    """Indicators LEFT geo LEFT master LEFT capable lists on the normalised keys."""
    from deserta.plans.indicators import INDICATOR_COLUMNS

    ind = with_keys(indicators, "district_name", "state_ut", mode)
    j = (ind.join(shuffled(geo), KEYS, "left").join(shuffled(one_row_per_district(master, mode)), KEYS, "left")
         .join(shuffled(capable.withColumnsRenamed({c: f"cf_{c}" for c in CLOSEST_COLUMNS.values()})), KEYS, "left"))
    empty = F.array().cast("array<struct<name:string,distance_kilometers:double>>")
    cols = [F.col(c) for c in INDICATOR_COLUMNS]
    cols += [F.col("latitude"), F.col("longitude"), F.col("facility_links"), F.col("total_facilities"),
             F.col("facilities_within_30km"), F.col("facilities_within_60km")]
    cols += [F.coalesce(F.col(f"cf_{c}"), F.col(c)).alias(c) for c in CLOSEST_COLUMNS.values()]
    cols += [F.col("overall_availability_score").cast("double").alias("overall_availability_score"),
             F.col("overall_availability_category"), F.col("intervention_priority"),
             F.col("estimated_population_impact")]
    cols += [F.coalesce(F.col(c), empty).alias(c) for c in FACILITY_LIST_COLUMNS.values()]
    return j.select(*cols)


_PAGE_ORDER = ("state_ut", "district_name")


def planning_page(served: DataFrame, size: int = 500, after: tuple[str, str] | None = None) -> DataFrame:
    """T4: the next ``size`` districts by (state, district) after the key ``after`` (None: the first page). Keyset
    paging: every page is a filter and a top-n, and all districts are reachable."""
    if after is not None:
        state, district = map(F.lit, after)
        served = served.where((F.col("state_ut") > state) | (F.col("state_ut").eqNullSafe(state)
                                                             & (F.col("district_name") > district)))
    return served.orderBy(*[F.col(c).asc_nulls_last() for c in _PAGE_ORDER]).limit(size)


def paged(served: DataFrame, size: int = 500) -> DataFrame:
    """T4 for all pages at once: every district with its page number, numbered by ranges of the order."""
    from deserta.operators.numbering import numbered

    at = numbered(served, [F.col(c).asc_nulls_last() for c in _PAGE_ORDER], "_at")
    return at.withColumn("page", (F.floor((F.col("_at") - 1) / size) + 1).cast("int")).drop("_at")


# ---- T1 -----------------------------------------------------------------------------------------------------------

CATEGORY_DETAIL = {
    "overall": (None, "data_confidence", "data_confidence_reason"),
    "maternal": ("maternal_neonatal_capability", "maternal_neonatal_confidence", "maternal_neonatal_evidence"),
    "diabetes": ("diabetes_capability", "diabetes_confidence", "diabetes_evidence"),
    "hypertension": ("hypertension_capability", "hypertension_confidence", "hypertension_evidence"),
    "nutrition": ("nutrition_capability", "nutrition_confidence", "nutrition_evidence"),
    "cancer": ("cancer_screening_capability", "cancer_screening_confidence", "cancer_screening_evidence"),
}
DETAIL_COLUMNS = ("description", "specialties", "equipment", "procedure", "capability", "data_confidence",
                  "data_confidence_reason")


def nearest_facilities(geo: DataFrame, locations: DataFrame, capability: DataFrame, knn_long: DataFrame,
                       k: int = 3) -> DataFrame:
    """T1 for every district and category at once: the k nearest capable facilities with detail columns.

    For category 'overall' with no capable facility at all, the k nearest facilities of any capability are
    returned instead and ``matched_capability`` is false.
    """
    matched = knn_long.withColumnRenamed("service", "category").withColumn("matched_capability", F.lit(True))
    no_overall = (geo.select(*KEYS, "latitude", "longitude")
                  .join(shuffled(matched.filter(F.col("category") == "overall").select(*KEYS).distinct()), KEYS, "left_anti"))
    fallback = (knn_join(no_overall, KEYS, "latitude", "longitude",
                         locations.select("unique_id", "name", "facility_latitude", "facility_longitude"),
                         "facility_latitude", "facility_longitude", k=k)
                .withColumn("category", F.lit("overall")).withColumn("matched_capability", F.lit(False)))
    ranked = matched.select(*KEYS, "category", "rank", "unique_id", "distance_kilometers", "matched_capability") \
        .unionByName(fallback.select(*KEYS, "category", "rank", "unique_id", "distance_kilometers",
                                     "matched_capability"))
    cap_cols = [c for c in capability.columns if c not in ("name", "latitude", "longitude", "address_city",
                                                             "address_stateOrRegion")]
    centers = geo.select(*KEYS, F.col("latitude").alias("center_latitude"), F.col("longitude").alias("center_longitude"))
    detail = (ranked.join(shuffled(centers), KEYS, "left").join(shuffled(locations), "unique_id", "left")
              .join(shuffled(capability.select(*cap_cols)), "unique_id", "left"))
    cat = F.col("category")
    cap_expr = overall_capability()
    conf_expr = F.col("data_confidence")
    ev_expr = F.col("data_confidence_reason")
    for name, (c_cap, c_conf, c_ev) in CATEGORY_DETAIL.items():
        if c_cap is None:
            continue
        cap_expr = F.when(cat == name, F.col(c_cap)).otherwise(cap_expr)
        conf_expr = F.when(cat == name, F.col(c_conf)).otherwise(conf_expr)
        ev_expr = F.when(cat == name, F.col(c_ev)).otherwise(ev_expr)
    return detail.select(
        *KEYS, "category", "rank", "unique_id", "name", "address_city", "address_stateOrRegion",
        "facility_latitude", "facility_longitude", "center_latitude", "center_longitude", "distance_kilometers",
        F.lit("calculated_from_coordinates").alias("distance_source"),
        cap_expr.alias("category_capability"), conf_expr.alias("category_confidence"),
        ev_expr.alias("category_evidence"), *DETAIL_COLUMNS, "matched_capability",
    )
