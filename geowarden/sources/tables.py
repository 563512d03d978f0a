"""Readings and objects derived from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geowarden.sources.geojson import with_boxes

#: Corners of an object around its centre: latitude, longitude; readings lie on a grid of 0.0001, and none on a border.
CORNERS = ((-0.00613, -0.00817), (-0.00419, 0.00723), (0.00731, 0.00511), (0.00529, -0.00637))


def telemetry(spark: SparkSession, sf_dir: str, layers: bool = False, spread: bool = False, coarse: bool = False) -> DataFrame:
    """One reading per event.  ``layers`` puts devices in five layers; ``spread`` moves readings over two years; ``coarse`` puts them on a hundred places and whole minutes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("brand"), F.col("c_name").alias("owner"))
    u, i = F.col("user_id"), F.col("event_id")
    ts = F.date_trunc("minute" if coarse else "second", F.col("ts").cast("timestamp"))
    grid = lambda n: F.floor(n % 1000 / 100) * 100 if coarse else n % 1000
    if spread:
        ts = ts + F.make_dt_interval(days=(i % 730).cast("int"))
    rows = e.select(
        "event_id", "user_id", ts.alias("ts"),
        (F.lit(42.90) + grid(u * 7919 + i * 13).cast("double") / F.lit(10000.0)).alias("lat"),
        (F.lit(-72.30) + grid(u * 104729 + i * 29).cast("double") / F.lit(10000.0)).alias("lon"),
        F.col("value").alias("speed"), ((i % 60) - 10).cast("double").alias("temperature"), (i % 101).cast("double").alias("battery"),
        (i % 97).cast("double").alias("humidity"), (i * 7 % 1001).cast("double").alias("luminosity"), ((i % 80).cast("double") + 950.5).alias("pressure"), (i % 53).cast("double").alias("fuel_level"),
        F.concat(F.lit("35-"), (u % 10).cast("string")).alias("imei"),
        F.get_json_object("props", "$.k").cast("int").alias("status"), F.col("event_type").alias("model"),
        (F.concat(F.lit("L"), (u % 5).cast("string")) if layers else F.lit("")).alias("layer_id"),
    )
    return rows.join(c, "user_id", "left").withColumn("device_id", F.concat(F.lit("d"), F.col("user_id").cast("string"))).drop("user_id")


def objects(spark: SparkSession, sf_dir: str, layers: bool = False) -> DataFrame:
    """One convex polygon per nation, on the square of the readings."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey").cast("long")
    y, x = F.lit(42.91) + (k % 5).cast("double") * 0.02, F.lit(-72.29) + F.floor(k / 5).cast("double") * 0.02
    at = [(y + a, x + b) for a, b in CORNERS]
    edges = F.array(*[F.struct(p[0].alias("y1"), p[1].alias("x1"), q[0].alias("y2"), q[1].alias("x2")) for p, q in zip(at, [*at[1:], at[0]], strict=True)])
    layer = F.concat(F.lit("L"), F.col("n_regionkey").cast("string")) if layers else F.lit("")
    shape = F.array(F.struct(F.lit(True).alias("fill"), edges.alias("edges")))
    return with_boxes(n.select(F.concat(F.lit("n"), k.cast("string")).alias("object_id"), layer.alias("layer_id"), F.lit("polygon").alias("kind"), shape.alias("parts")))


def telemetry_sql(layers: bool = False, spread: bool = False, coarse: bool = False) -> str:
    """The same readings in DuckDB: body of a CTE."""
    grid = (lambda n: f"({n}) % 1000 // 100 * 100") if coarse else (lambda n: f"({n}) % 1000")
    ts = f"date_trunc('{'minute' if coarse else 'second'}', e.ts)" + (" + to_days(CAST(e.event_id % 730 AS INTEGER))" if spread else "")
    layer = "'L' || (e.user_id % 5)" if layers else "''"
    return f"""SELECT e.event_id, 'd' || e.user_id AS device_id, {layer} AS layer_id, {ts} AS ts, CAST(epoch({ts}) AS BIGINT) AS t,
      CAST(42.90 AS DOUBLE) + CAST({grid("e.user_id * 7919 + e.event_id * 13")} AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
      CAST(-72.30 AS DOUBLE) + CAST({grid("e.user_id * 104729 + e.event_id * 29")} AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon,
      e.value AS speed, CAST(e.event_id % 60 - 10 AS DOUBLE) AS temperature, CAST(e.event_id % 101 AS DOUBLE) AS battery,
      CAST(e.event_id % 97 AS DOUBLE) AS humidity, CAST(e.event_id * 7 % 1001 AS DOUBLE) AS luminosity, CAST(e.event_id % 80 AS DOUBLE) + 950.5 AS pressure, CAST(e.event_id % 53 AS DOUBLE) AS fuel_level, '35-' || (e.user_id % 10) AS imei,
      CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS status, e.event_type AS model, c.c_mktsegment AS brand, c.c_name AS owner
      FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"""


def corners_sql(layers: bool = False) -> str:
    """Corners 0..4 (the last is the first again) of every object: ``object_id, layer_id, i, y, x``."""
    layer = "'L' || n_regionkey" if layers else "''"
    values = ", ".join(f"({i}, CAST({CORNERS[i % 4][0]} AS DOUBLE), CAST({CORNERS[i % 4][1]} AS DOUBLE))" for i in range(5))
    return f"""SELECT 'n' || n_nationkey AS object_id, {layer} AS layer_id, i,
      CAST(42.91 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.02 AS DOUBLE) + dy AS y,
      CAST(-72.29 AS DOUBLE) + CAST(n_nationkey // 5 AS DOUBLE) * CAST(0.02 AS DOUBLE) + dx AS x
      FROM nation CROSS JOIN (VALUES {values}) AS c(i, dy, dx)"""
