"""Zone geometry and the zone-pair dimension lookup.

Polygon centroids are computed from a vertices table ``(id, part, seq, x, y)``
with closed rings. Consecutive vertices are paired by an equi-join on
``seq + 1`` rather than a window, so one very large ring is spread over many
tasks; the per-ring sums are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import KM_PER_FOOT, UNKNOWN_BOROUGH
from tidemark.plans.ordering import bounded_broadcast

DEGENERATE_AREA = 1e-9


def ring_centroids(vertices: DataFrame) -> DataFrame:
    """Shoelace centroid and absolute area of every ring ``(id, part)``.

    A degenerate ring (``|A| < 1e-9``) falls back to the plain mean of its
    points (the repeated closing point included) with area 0.
    """
    v0 = vertices.select("id", "part", "seq", "x", "y")
    v1 = vertices.select("id", "part", (F.col("seq") - 1).alias("seq"),
                         F.col("x").alias("x1"), F.col("y").alias("y1"))
    edges = v0.join(v1, ["id", "part", "seq"], "left")
    cross = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    sums = edges.groupBy("id", "part").agg(
        F.count(F.lit(1)).alias("n_points"),
        (F.sum(cross) * 0.5).alias("a"),
        F.sum((F.col("x") + F.col("x1")) * cross).alias("sx"),
        F.sum((F.col("y") + F.col("y1")) * cross).alias("sy"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"))
    a = F.coalesce(F.col("a"), F.lit(0.0))
    degenerate = F.abs(a) < DEGENERATE_AREA
    return sums.select(
        "id", "part", "n_points",
        F.when(degenerate, F.col("mx")).otherwise(F.col("sx") / (6 * a)).alias("cx"),
        F.when(degenerate, F.col("my")).otherwise(F.col("sy") / (6 * a)).alias("cy"),
        F.when(degenerate, F.lit(0.0)).otherwise(F.abs(a)).alias("area"))


def polygon_centroids(vertices: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Area-weighted centroid of each (multi)polygon.

    Rings with fewer than 3 points are skipped; if the total area is 0 the
    centroid is the mean of all points of the shape. Areas are absolute, so
    holes add weight.
    """
    rings = ring_centroids(vertices) if rings is None else rings
    used = rings.where(F.col("n_points") >= 3)
    weighted = used.groupBy("id").agg(
        F.sum(F.col("cx") * F.col("area")).alias("sx"),
        F.sum(F.col("cy") * F.col("area")).alias("sy"),
        F.sum("area").alias("total_area"))
    means = vertices.groupBy("id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    j = means.join(weighted, "id", "left")
    flat = F.coalesce(F.col("total_area"), F.lit(0.0)) == 0
    return j.select(
        "id",
        F.when(flat, F.col("mx")).otherwise(F.col("sx") / F.col("total_area")).alias("x"),
        F.when(flat, F.col("my")).otherwise(F.col("sy") / F.col("total_area")).alias("y"))


def zone_table(centroids: DataFrame, attrs: DataFrame) -> DataFrame:
    """Zone dimension from centroids (feet) and ``(id, borough, zone)``.

    Coordinates to km rounded to 4, airport flag from the zone name, commas in
    names replaced by spaces, sorted by id.
    """
    j = attrs.join(centroids, "id")
    zone = F.trim(F.col("zone"))
    return (j.select(
        F.col("id").alias("location_id"),
        F.trim(F.col("borough")).alias("borough"),
        F.replace(zone, F.lit(","), F.lit(" ")).alias("zone"),
        F.round(F.col("x") * KM_PER_FOOT, 4).alias("x_km"),
        F.round(F.col("y") * KM_PER_FOOT, 4).alias("y_km"),
        F.lower(zone).contains("airport").cast("int").alias("is_airport"))
        .orderBy("location_id"))


def _zone_side(zones: DataFrame, side: str) -> DataFrame:
    return zones.select(
        F.col("location_id").cast("string").alias(f"_{side}_id"),
        F.col("x_km").alias(f"_{side}_x"), F.col("y_km").alias(f"_{side}_y"),
        F.col("borough").alias(f"_{side}_b"), F.col("is_airport").alias(f"_{side}_air"))


def with_zone_pair(df: DataFrame, zones: DataFrame, pu: str = "pu_zone", do: str = "do_zone",
                   max_zone_bytes: int = 64 << 20) -> DataFrame:
    """C4: geographic features of a (pickup, dropoff) zone pair.

    Two left lookups into the zone dimension, broadcast after a size check.
    Distance, bearing sin/cos rounded to 4; a missing zone on either side gives
    0 for all three. Missing boroughs are ``Unknown``; ``same_borough`` is 1
    only for equal, known boroughs; airport flags default to 0.
    """
    zp = bounded_broadcast(_zone_side(zones, "pu"), max_zone_bytes)
    zd = bounded_broadcast(_zone_side(zones, "do"), max_zone_bytes)
    j = (df.join(zp, F.col(pu).cast("string") == F.col("_pu_id"), "left")
           .join(zd, F.col(do).cast("string") == F.col("_do_id"), "left"))
    both = F.col("_pu_x").isNotNull() & F.col("_do_x").isNotNull()
    dx = F.col("_do_x") - F.col("_pu_x")
    dy = F.col("_do_y") - F.col("_pu_y")
    bearing = F.atan2(dy, dx)
    pu_b = F.coalesce(F.col("_pu_b"), F.lit(UNKNOWN_BOROUGH))
    do_b = F.coalesce(F.col("_do_b"), F.lit(UNKNOWN_BOROUGH))
    out = j.select(
        *[F.col(c) for c in df.columns],
        F.when(both, F.round(F.hypot(dx, dy), 4)).otherwise(F.lit(0.0)).alias("gc_distance_km"),
        F.when(both, F.round(F.sin(bearing), 4)).otherwise(F.lit(0.0)).alias("bearing_sin"),
        F.when(both, F.round(F.cos(bearing), 4)).otherwise(F.lit(0.0)).alias("bearing_cos"),
        F.when((pu_b == do_b) & (pu_b != F.lit(UNKNOWN_BOROUGH)), F.lit(1.0)).otherwise(F.lit(0.0)).alias("same_borough"),
        F.coalesce(F.col("_pu_air"), F.lit(0)).cast("double").alias("pu_airport"),
        F.coalesce(F.col("_do_air"), F.lit(0)).cast("double").alias("do_airport"),
        pu_b.alias("pu_borough"),
        do_b.alias("do_borough"),
    )
    return out


def zone_catalog(zones: DataFrame) -> DataFrame:
    """``(id, zone, borough)`` sorted by borough then zone."""
    return zones.select(F.col("location_id").alias("id"), "zone", "borough").orderBy("borough", "zone")


def zone_distance(zones: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Centroid distance for given zone pairs (pairs whose zones both exist)."""
    za = bounded_broadcast(_zone_side(zones, "a"))
    zb = bounded_broadcast(_zone_side(zones, "b"))
    j = (pairs.join(za, F.col(a).cast("string") == F.col("_a_id"))
              .join(zb, F.col(b).cast("string") == F.col("_b_id")))
    return j.select(a, b, F.hypot(F.col("_b_x") - F.col("_a_x"), F.col("_b_y") - F.col("_a_y")).alias("distance_km"))


# Request defaults when a field is not given (hour, day of week, month,
# passengers, rate code).
REQUEST_DEFAULTS = {"pickup_hour": 18, "pickup_dayofweek": 2, "pickup_month": 2,
                    "passenger_count": 1, "ratecode": "1"}


def trip_requests_to_features(requests: DataFrame, zones: DataFrame, rush_hours=None) -> DataFrame:
    """Scoring features from short trip requests.

    Missing fields take the request defaults; weekend and rush-hour flags are
    derived; zone-pair features come from C4. No route distance is supplied.
    """
    from tidemark.functions.columns import RUSH_HOURS

    rush = list(rush_hours or RUSH_HOURS)
    cols = {}
    for name, default in REQUEST_DEFAULTS.items():
        c = F.col(name) if name in requests.columns else F.lit(None)
        if name == "ratecode":
            cols[name] = F.coalesce(c.cast("string"), F.lit(default))
        else:
            cols[name] = F.coalesce(c.cast("int"), F.lit(default))
    base = requests.select(
        *[F.col(c) for c in requests.columns if c not in REQUEST_DEFAULTS],
        *[v.alias(k) for k, v in cols.items()])
    base = (base.withColumn("is_weekend", (F.col("pickup_dayofweek") >= 5).cast("int"))
                .withColumn("is_rush_hour", F.col("pickup_hour").isin(*rush).cast("int")))
    return with_zone_pair(base, zones)
