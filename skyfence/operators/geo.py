"""Distances, positions, tracks and heatmaps from signal levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfence.operators.timeline import US, slot_of

# Path loss exponent and level at one metre per environment.
ENVIRONMENTS = {
    "free_space": (2.0, -40.0), "indoor_los": (2.2, -42.0), "indoor_nlos": (3.0, -45.0),
    "indoor_obstructed": (4.0, -50.0), "outdoor_urban": (2.7, -41.0), "outdoor_suburban": (2.4, -40.0),
}
EARTH_M = 6378137.0


def _preset(env: str) -> tuple[float, float]:
    return ENVIRONMENTS.get(env, ENVIRONMENTS["indoor_los"])


def distance_m(rssi: Column, mhz: Column, env: str = "indoor_los") -> Column:
    n, level = _preset(env)
    shift = F.when(mhz > 5000, -3.0).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.pow(F.lit(10.0), (F.lit(level) + shift - rssi) / F.lit(10 * n)), F.lit(1000.0)))


def rssi_at(distance: Column, mhz: Column, env: str = "indoor_los") -> Column:
    n, level = _preset(env)
    shift = F.when(mhz > 5000, -3.0).otherwise(0.0)
    return F.lit(level) + shift - F.lit(10 * n) * F.log10(F.when(distance <= 0, 0.1).otherwise(distance))


def with_distance(df: DataFrame, env: str = "indoor_los") -> DataFrame:
    return df.withColumn("distance_m", distance_m(F.col("rssi_dbm"), F.col("frequency_mhz"), env))


def latest_readings(
    frames: DataFrame, sensors: DataFrame, now_us: int | None = None, window_s: float = 30.0, offsets: DataFrame | None = None
) -> DataFrame:
    """Latest level per (address, sensor) of the window before now, for sensors with known places.

    ``sensors``: sensor_id, x, y. ``offsets``: sensor_id, offset_us to subtract from its clock.
    Without ``now_us`` each address is judged at its own last frame.
    """
    # The latest reading is a mergeable aggregate: no ordering of a busy address in one task.
    rows = frames.filter(F.col("bssid").isNotNull() & F.col("rssi_dbm").isNotNull())
    if offsets is not None:
        rows = rows.join(offsets.select("sensor_id", "offset_us"), "sensor_id", "left").withColumn(
            "t_us", F.col("t_us") - F.coalesce("offset_us", F.lit(0))
        )
    if now_us is not None:
        rows = rows.filter(F.col("t_us") >= now_us - int(window_s * US))
    order = F.struct("t_us", "event_id")
    last = rows.groupBy("bssid", "sensor_id").agg(
        F.max_by(F.struct(F.col("rssi_dbm").cast("double").alias("rssi_dbm"), F.coalesce(F.col("frequency_mhz"), F.lit(2412)).alias("frequency_mhz"), "t_us"), order).alias("r")
    ).select("bssid", "sensor_id", "r.*")
    last = last.join(sensors.select("sensor_id", "x", "y"), "sensor_id")
    if now_us is None:
        end = last.groupBy("bssid").agg(F.max("t_us").alias("_end"))
        last = last.join(end, "bssid").filter(F.col("t_us") >= F.col("_end") - int(window_s * US)).drop("_end")
    return last


def clock_drift(readings: DataFrame) -> DataFrame:
    """Spread of a sensor's reported-minus-received clock (columns sensor_id, offset_us)."""
    ms = F.col("offset_us") / 1000.0
    return readings.groupBy("sensor_id").agg(F.count("*").alias("samples"), F.avg(ms).alias("mean_ms"), F.max(F.abs(ms)).alias("max_abs_ms"))


def trilaterate(readings: DataFrame, env: str = "indoor_los", min_sensors: int = 3) -> DataFrame:
    """Least-squares position per address, as sums only.

    Circles are made linear against the first sensor; the 2x2 normal equations come from sums of
    products, the residual from a second pass over the (few) readings of the address.
    """
    d = with_distance(readings, env)
    first = d.groupBy("bssid").agg(F.min(F.struct("sensor_id", "x", "y", "distance_m")).alias("o"), F.count("*").alias("n")).filter(F.col("n") >= min_sensors)
    rows = d.join(first, "bssid")
    c, o = F.col, lambda f: F.col(f"o.{f}")
    a, b = 2 * (c("x") - o("x")), 2 * (c("y") - o("y"))
    r = (o("distance_m") * o("distance_m") - c("distance_m") * c("distance_m")) - (o("x") * o("x") + o("y") * o("y")) + (c("x") * c("x") + c("y") * c("y"))
    sums = rows.groupBy("bssid").agg(
        F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * r).alias("ar"), F.sum(b * r).alias("br"), F.first("n").alias("n"),
    )
    det = c("aa") * c("bb") - c("ab") * c("ab")
    spot = sums.filter(F.abs(det) > 1e-9).select(
        "bssid", "n", ((c("bb") * c("ar") - c("ab") * c("br")) / det).alias("px"), ((c("aa") * c("br") - c("ab") * c("ar")) / det).alias("py")
    )
    gap = F.sqrt(F.pow(c("px") - c("x"), 2) + F.pow(c("py") - c("y"), 2)) - c("distance_m")
    err = d.join(spot, "bssid").groupBy("bssid").agg(
        F.first("px").alias("x_m"), F.first("py").alias("y_m"), F.sqrt(F.avg(gap * gap)).alias("error_radius_m"), F.first("n").alias("sensors")
    )
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - c("error_radius_m") / 10.0)) * F.least(F.lit(1.0), c("sensors") / 5.0)
    return err.withColumn("confidence", sure)


def strongest_sensor(readings: DataFrame) -> DataFrame:
    """Place of the loudest sensor with confidence and radius from its level."""
    top = readings.groupBy("bssid").agg(
        F.max(F.struct("rssi_dbm", "sensor_id", "x", "y")).alias("s"), F.count("*").alias("sensors"),
        F.array_sort(F.collect_set("sensor_id")).alias("source_sensor_ids"),
    )
    r = (F.greatest(F.lit(-90.0), F.least(F.lit(-30.0), F.col("s.rssi_dbm"))) + 90.0) / 60.0
    return top.select(
        "bssid", F.col("s.x").cast("double").alias("x_m"), F.col("s.y").cast("double").alias("y_m"),
        (0.2 + r * 0.45).alias("confidence"), (8.0 + (1.0 - r) * 20.0).alias("error_radius_m"), "sensors", "source_sensor_ids",
    )


def positions(readings: DataFrame, origin: tuple[float, float] | None = None, env: str = "indoor_los", digits: int | None = 3) -> DataFrame:
    """Trilateration where it works, else the loudest sensor; local metres (rounded to ``digits``, None: as they are) and coordinates around the origin."""
    near = strongest_sensor(readings)
    best = trilaterate(readings, env).select("bssid", *[F.col(c).alias(f"_{c}") for c in ("x_m", "y_m", "confidence", "error_radius_m")])
    both = near.join(best, "bssid", "left")
    pick = lambda c, to: F.coalesce(f"_{c}", c) if to is None else F.round(F.coalesce(f"_{c}", c), to)
    out = both.select(
        "bssid", F.when(F.col("_x_m").isNotNull(), "trilateration").otherwise("strongest_rssi").alias("method"),
        F.coalesce("_x_m", "x_m").alias("_x"), F.coalesce("_y_m", "y_m").alias("_y"),
        pick("x_m", digits).alias("x_m"), pick("y_m", digits).alias("y_m"), pick("confidence", 4).alias("confidence"),
        pick("error_radius_m", 3).alias("error_radius_m"), "sensors", "source_sensor_ids",
    )
    if origin is None:
        return out.drop("_x", "_y").withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    lat0, lon0 = (F.lit(float(v)) for v in origin)
    across = F.cos(F.radians(lat0))
    return out.withColumns({
        "lat": F.round(lat0 + F.degrees(F.col("_y") / EARTH_M), 8),
        "lon": F.when(F.abs(across) >= 1e-12, F.round(lon0 + F.degrees(F.col("_x") / (F.lit(EARTH_M) * across)), 8)),
    }).drop("_x", "_y")


def position_track(frames: DataFrame, sensors: DataFrame, step_s: float = 60.0, env: str = "indoor_los") -> DataFrame:
    """One estimate per address and time step, the input of ``tracks.smooth_tracks``."""
    stepped = frames.withColumn("_step", slot_of("t_us", int(step_s * US)))
    keyed = stepped.withColumn("bssid", F.concat_ws("#", "bssid", F.col("_step").cast("string")))
    spots = positions(latest_readings(keyed, sensors, window_s=step_s), env=env, digits=None)
    key = F.split("bssid", "#")
    return spots.select(key[0].alias("bssid"), ((key[1].cast("bigint") + 1) * F.lit(int(step_s * US))).alias("t_us"), "x_m", "y_m", "method")


def heatmap(readings: DataFrame, width_m: float = 50.0, height_m: float = 50.0, res: float = 0.5) -> DataFrame:
    """Mean level per grid cell of (x, y, rssi_dbm); points outside the map belong to no cell (``off_map`` counts them)."""
    gx, gy = F.floor(F.col("x") / res).cast("int"), F.floor(F.col("y") / res).cast("int")
    inside = gx.between(0, int(width_m / res) - 1) & gy.between(0, int(height_m / res) - 1)
    return readings.filter(inside).groupBy(gx.alias("cell_x"), gy.alias("cell_y")).agg(F.avg("rssi_dbm").alias("rssi_dbm"), F.count("*").alias("samples"))


def off_map(readings: DataFrame, width_m: float = 50.0, height_m: float = 50.0, res: float = 0.5) -> DataFrame:
    """How many points of (x, y) no cell of the heatmap takes, and how many there are."""
    gx, gy = F.floor(F.col("x") / res), F.floor(F.col("y") / res)
    inside = gx.between(0, int(width_m / res) - 1) & gy.between(0, int(height_m / res) - 1)
    return readings.agg(F.count_if(~F.coalesce(inside, F.lit(False))).alias("off_map"), F.count("*").alias("points"))


def fill_heatmap(cells: DataFrame, width_m: float = 50.0, height_m: float = 50.0, res: float = 0.5) -> DataFrame:
    """Every grid cell with the level of its nearest measured cell.

    Two equality passes, first along columns then along rows, so no cell meets all others: the
    nearest measured cell of a grid column at height y is one of at most two per column.
    """
    w, h = int(width_m / res), int(height_m / res)
    col = cells.groupBy("cell_x").agg(F.sort_array(F.collect_list(F.struct("cell_y", "rssi_dbm"))).alias("m"))  # at most h entries
    gap = lambda m, y: F.abs(m["cell_y"] - y)
    best_y = F.array_min(F.transform("m", lambda m: F.struct(gap(m, F.col("gy")).alias("d"), m["cell_y"].alias("y"), m["rssi_dbm"].alias("v"))))
    near = col.select("cell_x", "m", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("gy")).select("gy", "cell_x", best_y.alias("b"))
    line = near.groupBy("gy").agg(F.collect_list(F.struct(F.col("cell_x").alias("x"), F.col("b.d").alias("d"), F.col("b.y").alias("y"), F.col("b.v").alias("v"))).alias("m"))  # at most w entries
    sq = lambda m: (m["x"] - F.col("gx")) * (m["x"] - F.col("gx")) + m["d"] * m["d"]
    best = F.array_min(F.transform("m", lambda m: F.struct(sq(m).alias("d2"), m["y"].alias("y"), m["x"].alias("x"), m["v"].alias("v"))))
    return line.select("gy", "m", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("gx")).select(
        F.col("gx").alias("cell_x"), F.col("gy").alias("cell_y"), best["v"].alias("rssi_dbm"), best["d2"].alias("distance2")
    )
