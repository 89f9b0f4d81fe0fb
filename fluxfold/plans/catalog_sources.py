"""Sources, sinks and ingestion."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.operators.mapping import explode_series, map_series, rename
from fluxfold.operators.splitting import ranked_split
from fluxfold.operators.views import EVENT_KEY, LOCAL_VIEW, folded_view, view_arrays
from fluxfold.plans import adapters as A
from fluxfold.plans.registry import cols, query, tidy
from fluxfold.plans.sqltext import LOCAL_VIEW_SQL, RANKED_SPLIT_SQL, SEGMENTS_SQL
from fluxfold.schemas import ARCHIVE_URL, LONG_CADENCE_PREFIXES
from fluxfold.session import fresh_path
from fluxfold.sources import tables as S
from fluxfold.sources.convert import compacted, convert_files
from fluxfold.sources.convert import scan_file_by_id as scan_one_id
from fluxfold.sources.fits import encode_file
from fluxfold.sources.sinks import TrainingRecords, write_feature_splits
from fluxfold.streaming.ingest import ingest_available, stream_gap_segments


@query(
    "scan_objects",
    "SELECT c_custkey AS id, round(c_acctbal, 6) AS radius, "
    "CAST(c_nationkey AS BIGINT) AS mass FROM customer",
)
def scan_objects(spark, sf):
    schema = T.StructType.fromDDL("c_custkey long, c_nationkey int, c_acctbal double")
    names = {"c_custkey": "id", "c_acctbal": "radius", "c_nationkey": "mass"}
    return tidy(
        S.scan_objects(spark, f"{sf}/customer.parquet", schema, lambda df: rename(df, names))
    )


@query(
    "scan_parquet_table",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity, 6) AS "
    "l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
)
def scan_parquet_table(spark, sf):
    return tidy(
        S.scan_parquet_table(
            spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"],
            "l_quantity > 45 AND l_returnflag = 'R'",
        )
    )


@query(
    "scan_by_id",
    f"SELECT {cols('target_id quarter seq ~time ~flux')} FROM obs WHERE target_id = 8",
    "obs",
)
def scan_by_id(spark, sf):
    path = fresh_path(spark, "by_id")
    S.write_by_id(A.observations(spark, sf), path, "target_id", 16)
    columns = ["target_id", "quarter", "seq", "time", "flux"]
    return tidy(S.scan_by_id(spark, path, "target_id", 8, columns, 16))


@query(
    "csv_convert",
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus FROM orders",
)
def csv_convert(spark, sf):
    source = fresh_path(spark, "orders_csv")
    orders = A.table(spark, sf, "orders").drop("o_orderdate")
    orders.write.option("header", True).csv(source)
    out = fresh_path(spark, "orders.parquet")
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    return tidy(S.csv_convert(spark, source, out, orders.schema, columns))


def _file_writer(folder: str):
    """Write every row as one light-curve file below ``folder``; hands on its name."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = ["TIME", "PDCSAP_FLUX", "MOM_CENTR1", "MOM_CENTR2"]
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            names = []
            for row in batch.to_dict("records"):
                meta = {"KEPLERID": int(row["KEPLERID"]), "QUARTER": int(row["QUARTER"])}
                first = "none" if not len(row["TIME"]) else f"{row['TIME'][0]:.6f}"
                name = f"kplr{meta['KEPLERID']:09d}-{meta['QUARTER']}-{first}_llc.fits.gz"
                # Whole blocks of blanks and zeros: a small file takes a third of the disk.
                data = gzip.compress(encode_file("LIGHTCURVE", {c: row[c] for c in arrays}, meta), 1, mtime=0)
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(data)
                names.append(name)
            yield pd.DataFrame({"name": names})

    return write


def _uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def _light_curve_files(spark, sf) -> str:
    """The observations as real files, one per target and quarter, in the shared folder."""
    folder = fresh_path(spark, "light_curves")
    # Small rows, much work per row: spread before the Python step.
    series = A.raw_series(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    series.mapInPandas(_file_writer(_uri(folder)), "name string").agg(F.count("*")).first()
    return folder


@query(
    "ingest_light_curve_files",
    f"SELECT {cols('target_id quarter ~time ~flux ~centroid_x ~centroid_y')} FROM obs WHERE target_id > 0",
    "obs",
)
def ingest_light_curve_files(spark, sf):
    """Real files, converted by target: the even targets in a first run, the others in a second.

    A number of zeros only is no target id.
    """
    source, out = _light_curve_files(spark, sf), fresh_path(spark, "converted")
    progress = fresh_path(spark, "progress")
    for glob in ("kplr????????[02468]-*.fits.gz", "*.fits.gz"):
        convert_files(spark, source, out, progress, glob=glob, listed=False)
    series = compacted(spark, out)
    return tidy(explode_series(map_series(series.drop("target"))).drop("seq"))


@query(
    "scan_file_by_id",
    "SELECT o_orderpriority AS id, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders "
    "WHERE o_orderpriority = '2-HIGH'",
)
def scan_file_by_id(spark, sf):
    """A table written with a folder per id, read back for one of them by its path."""
    orders = A.table(spark, sf, "orders")
    out = fresh_path(spark, "orders_by_id")
    orders.write.partitionBy("o_orderpriority").parquet(out)
    schema = T.StructType([f for f in orders.schema if f.name in ("o_orderkey", "o_totalprice")])
    rows = scan_one_id(spark, f"{out}/*", "2-HIGH", schema, pattern=r"(?<=o_orderpriority=)[^/]+")
    return tidy(rows.select(F.lit("2-HIGH").alias("id"), *schema.names))


@query(
    "file_target_id",
    """
    SELECT CAST(target_id AS VARCHAR) AS target, CAST(count(DISTINCT quarter) AS BIGINT) AS n_files
    FROM obs WHERE target_id > 0 AND quarter % 4 <> 0 GROUP BY 1
    """,
    "obs",
)
def file_target_id(spark, sf):
    name = F.when(F.col("quarter") % 4 == 0, F.lit("/raw/other-")).otherwise(F.lit("/raw/kplr"))
    path = F.concat(name, F.lpad(F.col("target_id").cast("string"), 9, "0"), F.lit("-"),
                    F.col("quarter").cast("string"), F.lit("_llc.fits"))
    pairs = A.observations(spark, sf).select("target_id", "quarter").distinct()
    files = pairs.select(path.alias("path"))
    return S.files_per_target(S.file_target_ids(files))


@query(
    "incremental_ingest",
    "SELECT DISTINCT user_id AS target_id FROM events WHERE user_id % 2 <> 0",
)
def incremental_ingest(spark, sf):
    ids = A.table(spark, sf, "events").select(F.col("user_id").alias("target_id")).distinct()
    return S.not_processed(ids, ids.where(F.col("target_id") % 2 == 0), "target_id")


@query(
    "incremental_ingest_stream",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total "
    "FROM events GROUP BY 1",
)
def incremental_ingest_stream(spark, sf):
    out, log = fresh_path(spark, "ingested"), fresh_path(spark, "progress")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    for _ in range(2):  # The second run finds nothing new and adds nothing.
        ingest_available(spark, f"{sf}/events*.parquet", out, log, schema, "parquet")
    rows = spark.read.schema(schema).parquet(out)
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "gap_segments_stream",
    f"""
    WITH {SEGMENTS_SQL}
    SELECT target_id, quarter, round(min("time"), 6) AS start, round(max("time"), 6) AS "end",
           CAST(count(*) AS BIGINT) AS n_points
    FROM segments GROUP BY target_id, quarter, segment_id
    """,
    "obs",
)
def gap_segments_stream(spark, sf):
    """All observations in two deliveries, unordered in time; then one that closes what is open."""
    source, out, log = (fresh_path(spark, n) for n in ("series", "segments", "progress"))
    obs = A.observations(spark, sf).select("target_id", "quarter", "seq", "time")
    delivery = F.pmod(F.xxhash64("seq"), F.lit(2))
    last = obs.agg(F.max("time")).first()[0] or 0.0
    end = spark.createDataFrame([(-1, -1, -1, last + 5_000.0)], obs.schema)
    for rows in (obs.where(delivery == 0), obs.where(delivery == 1), end):
        rows.write.mode("append").parquet(source)
        stream_gap_segments(spark, source, out, log, obs.schema, 0.75, "3000 days")
    found = spark.read.parquet(out)
    return tidy(found.select("target_id", "quarter", "start", "end", "n_points"))


_ID = "CASE WHEN length(u) < 9 THEN lpad(u, 9, '0') ELSE u END"
_PREFIXES = ", ".join(f"('{p}')" for p in LONG_CADENCE_PREFIXES)


@query(
    "download_manifest",
    f"""
    SELECT '{ARCHIVE_URL}/' || substr(id, 1, 4) || '/' || id || '//kplr' || id || '-' || p
           || '_llc.fits' AS url
    FROM (SELECT {_ID} AS id FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events
                                   WHERE user_id % 2 <> 0)),
         (VALUES {_PREFIXES}) v(p)
    """,
)
def download_manifest(spark, sf):
    ids = A.table(spark, sf, "events").select(F.col("user_id").alias("target_id"))
    done = S.download_manifest(
        ids.where(F.col("target_id") % 2 == 0), spark.createDataFrame([], "url string")
    )
    return S.download_manifest(ids, done)


@query(
    "write_feature_splits",
    f"""
    WITH {RANKED_SPLIT_SQL}
    SELECT split, CAST(count(*) AS BIGINT) AS n, round(sum(duration), 4) AS total
    FROM tces JOIN splits USING (target_id) GROUP BY split
    """,
    "tces",
)
def write_feature_splits_query(spark, sf):
    tces = A.tces(spark, sf)
    targets = tces.select("target_id").distinct()
    out = fresh_path(spark, "features")
    write_feature_splits(tces.join(ranked_split(targets, 0.2, 0.3), "target_id"), out)
    back = spark.read.parquet(out)
    return back.groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total")
    )


@query(
    "export_tfrecord_shards",
    f"""
    WITH {LOCAL_VIEW_SQL}
    SELECT v.target_id, v.tce_id, t.name, round(CAST(CAST(t.period AS FLOAT) AS DOUBLE), 6)
           AS period, bin, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value
    FROM local_view v JOIN tces t ON t.target_id = v.target_id AND t.tce_id = v.tce_id
    """,
    "obs tces",
)
def export_tfrecord_shards(spark, sf):
    spark.dataSource.register(TrainingRecords)
    tces = A.tces(spark, sf)
    views = folded_view(A.observations(spark, sf), tces, LOCAL_VIEW, {"view": "flux"})
    rows = view_arrays(views, EVENT_KEY, ["view"]).join(
        tces.select(*EVENT_KEY, "name", "period"), EVENT_KEY
    )
    out = fresh_path(spark, "records")
    rows.write.format("tfrecord").mode("overwrite").save(out)
    back = spark.read.format("tfrecord").schema(rows.schema).load(out)
    return tidy(
        back.select(*EVENT_KEY, "name", "period", F.posexplode("view").alias("bin", "value"))
    )


@query(
    "verify_output",
    "SELECT o_orderstatus, count(*) AS n_rows, count(*) AS n_full, TRUE AS placed FROM orders GROUP BY ALL",
)
def verify_output(spark, sf):
    """All files of a table written by status: the files of a status hold its rows."""
    orders = A.table(spark, sf, "orders")
    out = fresh_path(spark, "orders")
    orders.write.partitionBy("o_orderstatus").parquet(out)
    schema = T.StructType([f for f in orders.schema if f.name != "o_orderstatus"])
    files = S.verify_output(spark, f"{out}/*", schema)
    status = F.regexp_extract("file", "o_orderstatus=([^/]*)/", 1)
    return files.groupBy(status.alias("o_orderstatus")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_full").alias("n_full"), F.bool_and(F.col("n_rows") > 0).alias("placed")
    )
