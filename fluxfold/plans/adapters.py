"""Light-curve shaped tables derived from the star-schema test tables.

``SQL`` holds the same definitions as DuckDB common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxfold.operators.mapping import map_stellar, map_tces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(ts) -> F.Column:
    # Wall-clock micros, whatever the session time zone is.
    micros = F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))
    return micros / F.lit(8.64e10)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation: a user is a target, an event is an observation."""
    time = _days(F.col("ts")) - F.lit(19723)
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", "value", "props", time.alias("time"))
        .select(
            F.col("user_id").alias("target_id"),
            (F.floor(F.col("time") / F.lit(10.0)) + 1).cast("int").alias("quarter"),
            F.col("event_id").alias("seq"),
            "time",
            F.col("value").alias("flux"),
            (F.col("value") / F.lit(100.0)).alias("centroid_x"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / F.lit(10.0)).alias(
                "centroid_y"
            ),
        )
    )


def heavy_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger series table: a supplier is a target, a line item is an observation."""
    time = _days(F.col("l_shipdate")) + F.col("l_linenumber") / F.lit(10.0) - F.lit(9000)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("target_id"),
        F.lit(1).alias("quarter"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        time.alias("time"),
        F.col("l_extendedprice").alias("flux"),
        (F.col("l_quantity") / F.lit(10.0)).alias("centroid_x"),
        (F.col("l_tax") * F.lit(10.0)).alias("centroid_y"),
    )


FILE_ROWS = 50_000


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as array rows, one per target, quarter and file.

    A file covers ``FILE_ROWS`` consecutive observation numbers, so no array is longer.
    """
    point = F.struct("time", "seq", "flux", "centroid_x", "centroid_y")
    file = F.floor(F.col("seq") / FILE_ROWS).alias("file")
    return (
        observations(spark, sf_dir)
        .groupBy("target_id", "quarter", file)
        .agg(F.array_sort(F.collect_list(point)).alias("p"))
        .select(
            F.col("target_id").alias("KEPLERID"),
            F.col("quarter").alias("QUARTER"),
            F.col("p.time").alias("TIME"),
            F.col("p.flux").alias("PDCSAP_FLUX"),
            F.col("p.centroid_x").alias("MOM_CENTR1"),
            F.col("p.centroid_y").alias("MOM_CENTR2"),
        )
    )


def raw_tces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events per target in the layout of the raw event table."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u, k = F.col("user_id"), F.col("k")
    period = F.lit(2.0) + (u % 7) * F.lit(0.5) + (k - 1) * F.lit(1.25)
    names = F.array(
        *map(F.lit, ("PC", "NTP", "AFP", "UNKNOWN", "PLANET_CANDIDATE", "junk"))
    )
    rows = users.select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return rows.withColumn("p", period).select(
        u.alias("kepid"),
        k.cast("long").alias("tce_plnt_num"),
        ((u % 11) + k * F.lit(0.5)).alias("tce_cap_stat"),
        F.when(u % 13 != 0, (u % 13) * F.lit(0.25)).alias("tce_hap_stat"),
        ((u % 17) / F.lit(100.0)).alias("boot_fap"),
        (u % 4).cast("double").alias("tce_rb_tcount0"),
        ((u % 9) + F.lit(1.0)).alias("tce_prad"),
        (F.col("p") * F.lit(1.001)).alias("tcet_period"),
        ((u % 23) * F.lit(100.0)).alias("tce_depth"),
        (F.lit(0.25) + (u % 5) * F.lit(0.1) + (k - 1) * F.lit(0.4)).alias("tce_time0bk"),
        (F.col("p") * F.lit(1.92)).alias("tce_duration"),
        F.col("p").alias("tce_period"),
        F.when(u % 3 == 0, F.concat(F.lit("T-"), u.cast("string"), F.lit("-"), k.cast("string")))
        .alias("kepler_name"),
        F.get(names, ((u + k) % 6).cast("int")).alias("label"),
        (F.col("p") * F.lit(0.4)).alias("tce_maxmesd"),
        ((u % 5) * k).cast("double").alias("wst_depth"),
    )


def tces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_tces(raw_tces(spark, sf_dir))


def raw_stellar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stars, in the layout of the raw star table."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("kepid"),
        (F.lit(4000.0) + n * F.lit(100.0)).alias("teff"),
        (F.col("c_acctbal") / (n + F.lit(1.0))).alias("dens"),
        ((c % 50) / F.lit(10.0)).alias("logg"),
        F.when(c % 10 != 0, (c % 7) / F.lit(10.0)).alias("feh"),
        F.col("c_acctbal").alias("radius"),
        n.cast("double").alias("mass"),
    )


def stellar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_stellar(raw_stellar(spark, sf_dir))


_OBS = """
obs AS (
  SELECT user_id AS target_id,
         CAST(floor(t / 10.0::DOUBLE) AS BIGINT) + 1 AS quarter,
         event_id AS seq, t AS "time", value AS flux,
         value / 100.0::DOUBLE AS centroid_x,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10.0::DOUBLE AS centroid_y
  FROM (SELECT *, epoch_us(ts) / 8.64e10::DOUBLE - 19723 AS t FROM events)
)"""

_HEAVY = """
heavy AS (
  SELECT l_suppkey AS target_id, 1::BIGINT AS quarter,
         l_orderkey * 10 + l_linenumber AS seq,
         epoch_us(l_shipdate) / 8.64e10::DOUBLE + l_linenumber / 10.0::DOUBLE - 9000 AS "time",
         l_extendedprice AS flux,
         l_quantity / 10.0::DOUBLE AS centroid_x, l_tax * 10.0::DOUBLE AS centroid_y
  FROM lineitem
)"""

_RAW_TCE = """
raw_tce AS (
  SELECT u AS kepid, k AS tce_plnt_num,
         (u % 11) + k * 0.5::DOUBLE AS tce_cap_stat,
         CASE WHEN u % 13 <> 0 THEN (u % 13) * 0.25::DOUBLE END AS tce_hap_stat,
         (u % 17) / 100.0::DOUBLE AS boot_fap,
         CAST(u % 4 AS DOUBLE) AS tce_rb_tcount0,
         (u % 9) + 1.0::DOUBLE AS tce_prad,
         p * 1.001::DOUBLE AS tcet_period,
         (u % 23) * 100.0::DOUBLE AS tce_depth,
         0.25::DOUBLE + (u % 5) * 0.1::DOUBLE + (k - 1) * 0.4::DOUBLE AS tce_time0bk,
         p * 1.92::DOUBLE AS tce_duration,
         p AS tce_period,
         CASE WHEN u % 3 = 0 THEN 'T-' || u || '-' || k END AS kepler_name,
         CASE (u + k) % 6 WHEN 0 THEN 'PC' WHEN 1 THEN 'NTP' WHEN 2 THEN 'AFP'
              WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN 'PLANET_CANDIDATE' ELSE 'junk' END AS label,
         p * 0.4::DOUBLE AS tce_maxmesd,
         CAST((u % 5) * k AS DOUBLE) AS wst_depth
  FROM (SELECT user_id AS u, k,
               2.0::DOUBLE + (user_id % 7) * 0.5::DOUBLE + (k - 1) * 1.25::DOUBLE AS p
        FROM (SELECT DISTINCT user_id FROM events), (VALUES (1::BIGINT), (2::BIGINT)) v(k))
)"""

_TCES = """
tces AS (
  SELECT tce_plnt_num AS tce_id, kepid AS target_id, kepler_name AS name,
         CASE WHEN label IN ('PC', 'PLANET_CANDIDATE') THEN 'PC'
              WHEN label IN ('NTP', 'NON_TRANSITING_PHENOMENA') THEN 'NTP'
              WHEN label IN ('AFP', 'ASTROPHYSICAL_FALSE_POSITIVE') THEN 'AFP'
              WHEN label IN ('FP', 'FALSE_POSITIVE') THEN 'FP'
              ELSE 'UNKNOWN' END AS label,
         tce_time0bk AS epoch, tce_duration / 24.0::DOUBLE AS duration, tce_period AS period,
         tce_maxmesd AS secondary_phase,
         tce_cap_stat AS opt_ghost_core_aperture_corr,
         tce_hap_stat AS opt_ghost_halo_aperture_corr,
         boot_fap AS bootstrap_false_alarm_proba, tcet_period AS fitted_period,
         tce_prad AS radius, tce_rb_tcount0 AS rolling_band_fgt, tce_depth AS transit_depth,
         wst_depth AS secondary_transit_depth
  FROM raw_tce
)"""

_RAW_STELLAR = """
raw_stellar AS (
  SELECT c_custkey AS kepid, 4000.0::DOUBLE + c_nationkey * 100.0::DOUBLE AS teff,
         c_acctbal / (c_nationkey + 1.0::DOUBLE) AS dens,
         (c_custkey % 50) / 10.0::DOUBLE AS logg,
         CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey % 7) / 10.0::DOUBLE END AS feh,
         c_acctbal AS radius, CAST(c_nationkey AS DOUBLE) AS mass
  FROM customer
)"""

_STELLAR = """
stellar AS (
  SELECT kepid AS id, teff AS effective_temperature, radius, mass, dens AS density,
         logg AS surface_gravity, feh AS metallicity
  FROM raw_stellar
)"""

SQL = {
    "obs": [_OBS],
    "heavy": [_HEAVY],
    "raw_tce": [_RAW_TCE],
    "tces": [_RAW_TCE, _TCES],
    "raw_stellar": [_RAW_STELLAR],
    "stellar": [_RAW_STELLAR, _STELLAR],
}


def with_tables(names: str, body: str) -> str:
    """Prefix ``body`` with the definitions of the named tables."""
    parts: list[str] = []
    for name in names.split():
        parts += [p for p in SQL[name] if p not in parts]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH" + ",".join(parts) + ",\n" + body[5:]
    return "WITH" + ",".join(parts) + "\n" + body
