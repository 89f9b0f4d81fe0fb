"""Lookups, catalogue joins, label statistics, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxfold.operators import labeling as L
from fluxfold.operators import lookups as K
from fluxfold.operators.mapping import rename
from fluxfold.operators.masking import join_series_events
from fluxfold.operators.normalize import normalize_scalars
from fluxfold.operators.skew import find_hot_keys
from fluxfold.operators.splitting import ranked_split, split_membership
from fluxfold.plans import adapters as A
from fluxfold.plans.registry import cols, fold, query, tidy
from fluxfold.plans.sqltext import RANKED_SPLIT_SQL
from fluxfold.sources.tables import set_difference

_SHORT = ["target_id", "tce_id", "name", "label", "period"]
_SHORT_SQL = cols("target_id tce_id name label ~period")


@query(
    "series_for_target",
    f"SELECT {cols('target_id quarter seq ~time ~flux')} FROM obs "
    "WHERE target_id = 8 AND quarter IN (1, 3)",
    "obs",
)
def series_for_target(spark, sf):
    rows = K.series_for_target(A.observations(spark, sf), 8, (1, 3))
    return tidy(rows.select("target_id", "quarter", "seq", "time", "flux"))


@query(
    "missing_periods",
    """
    SELECT u.target_id, q.quarter
    FROM (SELECT DISTINCT target_id FROM obs) u, (SELECT unnest(range(1, 6)) AS quarter) q
    WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.target_id = u.target_id
                      AND o.quarter = q.quarter)
    """,
    "obs",
)
def missing_periods(spark, sf):
    obs = A.observations(spark, sf)
    asked = obs.select("target_id").distinct().select(
        "target_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("quarter")
    )
    return tidy(K.missing_periods(obs, asked))


@query(
    "stellar_for_target",
    f"SELECT {cols('id ~effective_temperature ~radius ~mass ~density ~surface_gravity')} "
    "FROM stellar WHERE id = 42",
    "stellar",
)
def stellar_for_target(spark, sf):
    return tidy(K.stellar_for_target(A.stellar(spark, sf), 42).drop("metallicity"))


@query(
    "tce_by_id",
    f"SELECT {_SHORT_SQL} FROM tces WHERE target_id = 9 AND tce_id = 2",
    "tces",
)
def tce_by_id(spark, sf):
    return tidy(K.tce_by_id(A.tces(spark, sf), 9, 2).select(*_SHORT))


@query("tce_by_name", f"SELECT {_SHORT_SQL} FROM tces WHERE name = 'T-9-1'", "tces")
def tce_by_name(spark, sf):
    return tidy(K.tce_by_name(A.tces(spark, sf), " T-9-1 ").select(*_SHORT))


@query(
    "column_mapping",
    """
    SELECT kepid AS target_id, tce_plnt_num AS tce_id, kepler_name AS name,
           round(tce_period, 6) AS period
    FROM raw_tce WHERE kepler_name IS NOT NULL
    """,
    "raw_tce",
)
def column_mapping(spark, sf):
    names = {"kepid": "target_id", "tce_plnt_num": "tce_id", "kepler_name": "name",
             "tce_period": "period"}
    return tidy(rename(A.raw_tces(spark, sf), names).where(F.col("name").isNotNull()))


@query("tces_for_target", f"SELECT {_SHORT_SQL} FROM tces WHERE target_id = 9", "tces")
def tces_for_target(spark, sf):
    return tidy(K.tces_for_target(A.tces(spark, sf), 9).select(*_SHORT))


@query(
    "all_events",
    f"SELECT {cols('target_id tce_id ~epoch ~duration ~period ~secondary_phase')} FROM tces",
    "tces",
)
def all_events(spark, sf):
    return tidy(K.all_events(A.tces(spark, sf)).select("target_id", "tce_id", "event.*"))


_TEXTS = """
    texts AS (
      SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR)
                           ELSE 'T-' || user_id || '-2' END AS text FROM events
    )"""


@query(
    "search_target_or_tce",
    f"""
    WITH {_TEXTS}
    SELECT text, TRY_CAST(text AS BIGINT) AS target_id FROM texts
    WHERE regexp_full_match(text, '[0-9]+')
    UNION ALL
    SELECT x.text, t.target_id FROM texts x JOIN tces t ON t.name = x.text
    """,
    "tces",
)
def search_target_or_tce(spark, sf):
    user = F.col("user_id")
    text = F.when(user % 2 == 0, user.cast("string")).otherwise(F.concat(F.lit("T-"), user,
                                                                         F.lit("-2")))
    texts = A.table(spark, sf, "events").select(text.alias("text")).distinct()
    return K.search_targets(texts, A.tces(spark, sf))


_MARK = """
    marks AS (
      SELECT o.target_id, o.quarter, o.seq, o."time", o.flux, coalesce((
        SELECT arg_max(coalesce(nullif(t.name, ''), CAST(t.tce_id AS VARCHAR)), t.tce_id)
        FROM tces t WHERE t.target_id = o.target_id AND abs({fold}) <= t.duration
      ), 'no detected') AS transit
      FROM obs o
    )"""


MARKS_SQL = _MARK.format(fold=fold('o."time"', "t.epoch", "t.period"))


@query(
    "target_bundle",
    f"""
    WITH {MARKS_SQL}
    SELECT m.target_id, m.quarter, m.seq, round(m.flux, 6) AS flux, m.transit,
           CAST(2 AS BIGINT) AS n_tces, round(s.effective_temperature, 6) AS effective_temperature,
           round(s.radius, 6) AS radius
    FROM marks m LEFT JOIN stellar s ON s.id = m.target_id
    """,
    "obs tces stellar",
)
def target_bundle(spark, sf):
    obs = A.observations(spark, sf)
    hot = find_hot_keys(obs, ["target_id"], "time")
    rows = K.target_bundle(obs, A.tces(spark, sf), A.stellar(spark, sf), hot)
    return tidy(rows.select("target_id", "quarter", "seq", "flux", "transit", "n_tces",
                            "effective_temperature", "radius"))


def _catalogues(spark, sf):
    tce = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("kepid"),
        F.col("l_linenumber").cast("long").alias("tce_plnt_num"),
        F.col("l_extendedprice").alias("tce_depth"),
    )
    urgency = F.substring("o_orderpriority", 1, 1)
    koi = (
        A.table(spark, sf, "orders")
        .where(F.col("o_orderstatus") != "O")
        .select(
            F.col("o_orderkey").alias("kepid"),
            F.concat(F.lit("K"), F.col("o_custkey")).alias("kepoi_name"),
            F.when(urgency == "1", "CONFIRMED").when(urgency == "2", "FALSE POSITIVE")
            .otherwise("CANDIDATE").alias("koi_disposition"),
            (F.col("o_orderkey") % 7 + 1).alias("koi_tce_plnt_num"),
        )
    )
    nation = F.col("c_nationkey") % 3
    positives = (
        A.table(spark, sf, "customer")
        .where(F.col("c_mktsegment") == "BUILDING")
        .select(
            F.concat(F.lit("K"), F.col("c_custkey")).alias("kepoi_name"),
            F.when(nation == 0, "CERTIFIED FP").when(nation == 1, "CERTIFIED FA")
            .otherwise("POSSIBLE PLANET").alias("fpwg_disp_status"),
        )
    )
    return tce, koi, positives


@query(
    "merge_and_label_tces",
    """
    WITH tce AS (SELECT l_orderkey AS kepid, CAST(l_linenumber AS BIGINT) AS tce_plnt_num,
                        l_extendedprice AS tce_depth FROM lineitem),
    koi AS (
      SELECT o_orderkey AS kepid, 'K' || o_custkey AS kepoi_name,
             CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CONFIRMED'
                  WHEN '2' THEN 'FALSE POSITIVE' ELSE 'CANDIDATE' END AS koi_disposition,
             o_orderkey % 7 + 1 AS koi_tce_plnt_num
      FROM orders WHERE o_orderstatus <> 'O'
    ),
    cfp AS (
      SELECT 'K' || c_custkey AS kepoi_name,
             CASE c_nationkey % 3 WHEN 0 THEN 'CERTIFIED FP' WHEN 1 THEN 'CERTIFIED FA'
                  ELSE 'POSSIBLE PLANET' END AS fpwg_disp_status
      FROM customer WHERE c_mktsegment = 'BUILDING'
    )
    SELECT tce.kepid, tce.tce_plnt_num, round(tce.tce_depth, 6) AS tce_depth, koi.kepoi_name,
           koi.koi_disposition, koi.koi_tce_plnt_num, koi.kepid AS kepid_koi,
           CASE WHEN koi.koi_disposition = 'CONFIRMED' THEN 'PC'
                WHEN cfp.fpwg_disp_status = 'CERTIFIED FP' THEN 'AFP'
                WHEN cfp.fpwg_disp_status = 'CERTIFIED FA' OR koi.kepid IS NULL THEN 'NTP'
                ELSE 'UNKNOWN' END AS label
    FROM tce LEFT JOIN koi ON tce.kepid = koi.kepid AND tce.tce_plnt_num = koi.koi_tce_plnt_num
    LEFT JOIN cfp ON koi.kepoi_name = cfp.kepoi_name
    """,
)
def merge_and_label_tces(spark, sf):
    tce, koi, positives = _catalogues(spark, sf)
    hot = find_hot_keys(tce, ["kepid"], "tce_plnt_num")
    return tidy(L.merge_and_label(tce, koi, positives, hot))


@query(
    "join_series_events",
    """
    SELECT o.target_id, t.tce_id, CAST(count(*) AS BIGINT) AS n, round(sum(o.flux), 4) AS total
    FROM obs o JOIN tces t ON t.target_id = o.target_id GROUP BY ALL
    """,
    "obs tces",
)
def join_series_events_query(spark, sf):
    obs = A.observations(spark, sf)
    hot = find_hot_keys(obs, ["target_id"], "time")
    rows = join_series_events(obs, A.tces(spark, sf), hot)
    return rows.groupBy("target_id", "tce_id").agg(
        F.count("*").alias("n"), F.round(F.sum("flux"), 4).alias("total")
    )


@query(
    "split_membership",
    f"""
    WITH {RANKED_SPLIT_SQL}
    SELECT target_id, quarter, seq, round(flux, 6) AS flux FROM obs
    WHERE target_id IN (SELECT target_id FROM splits WHERE split = 'validation')
    """,
    "obs tces",
)
def split_membership_query(spark, sf):
    obs = A.observations(spark, sf)
    splits = ranked_split(A.tces(spark, sf).select("target_id").distinct(), 0.2, 0.3)
    rows = split_membership(obs, splits, "validation")
    return tidy(rows.select("target_id", "quarter", "seq", "flux"))


@query(
    "set_difference",
    "SELECT user_id AS target_id FROM events EXCEPT SELECT c_custkey FROM customer "
    "WHERE c_acctbal > 0",
)
def set_difference_query(spark, sf):
    users = A.table(spark, sf, "events").select(F.col("user_id").alias("target_id"))
    done = A.table(spark, sf, "customer").where(F.col("c_acctbal") > 0)
    return set_difference(users, done.select(F.col("c_custkey").alias("target_id")))


@query("tce_count", "SELECT count(*) AS n FROM tces", "tces")
def tce_count(spark, sf):
    return K.tce_count(A.tces(spark, sf))


@query("unique_target_ids", "SELECT DISTINCT target_id FROM tces", "tces")
def unique_target_ids(spark, sf):
    return K.unique_target_ids(A.tces(spark, sf))


_DISTRIBUTION = """
    counts AS (
      SELECT CAST(count(*) FILTER (label = 'PC') AS BIGINT) AS pc,
             CAST(count(*) FILTER (label = 'NTP') AS BIGINT) AS ntp,
             CAST(count(*) FILTER (label = 'AFP') AS BIGINT) AS afp,
             CAST(count(*) FILTER (label = 'UNKNOWN') AS BIGINT) AS un,
             CAST(count(*) FILTER (label = 'FP') AS BIGINT) AS fp0
      FROM tces
    ),
    dist AS (SELECT *, CASE WHEN fp0 > 0 THEN fp0 ELSE ntp + afp END AS fp FROM counts)"""


@query(
    "labels_distribution",
    f"""
    WITH {_DISTRIBUTION}
    SELECT 'PC' AS label, pc AS n FROM dist UNION ALL SELECT 'NTP', ntp FROM dist
    UNION ALL SELECT 'AFP', afp FROM dist UNION ALL SELECT 'UNKNOWN', un FROM dist
    UNION ALL SELECT 'FP', fp FROM dist
    """,
    "tces",
)
def labels_distribution(spark, sf):
    return tidy(L.labels_distribution(A.tces(spark, sf)))


@query(
    "label_hierarchy",
    f"""
    WITH {_DISTRIBUTION}
    SELECT 'UNKNOWN' AS label, '' AS parent, un AS n FROM dist
    UNION ALL SELECT 'KNOWN', '', pc + ntp + afp FROM dist
    UNION ALL SELECT 'PC', 'KNOWN', pc FROM dist UNION ALL SELECT 'FP', 'KNOWN', fp FROM dist
    UNION ALL SELECT 'AFP', 'FP', afp FROM dist UNION ALL SELECT 'NTP', 'FP', ntp FROM dist
    """,
    "tces",
)
def label_hierarchy(spark, sf):
    return tidy(L.label_hierarchy(L.labels_distribution(A.tces(spark, sf))))


def _logs(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, log10({c}) AS x FROM tces WHERE {c} > 0" for c in columns.split()
    )


@query(
    "log_histogram",
    f"""
    SELECT field, CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n
    FROM ({_logs("period duration")}) GROUP BY ALL
    """,
    "tces",
)
def log_histogram(spark, sf):
    return tidy(L.log_histogram(A.tces(spark, sf), ["period", "duration"], 0.1))


@query(
    "box_summary",
    f"""
    SELECT field, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1,
           round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3,
           round(max(x), 6) AS max
    FROM ({_logs("period duration")}) GROUP BY ALL
    """,
    "tces",
)
def box_summary(spark, sf):
    return tidy(L.box_summary(A.tces(spark, sf), ["period", "duration"]))


@query(
    "events_by_target",
    """
    SELECT target_id, CAST(count(*) AS BIGINT) AS n,
           string_agg(CAST(tce_id AS VARCHAR), ',' ORDER BY tce_id) AS ids,
           round(sum(period), 6) AS periods
    FROM tces GROUP BY target_id
    """,
    "tces",
)
def events_by_target(spark, sf):
    grouped = L.events_by_target(A.tces(spark, sf))
    events = F.col("events")
    periods = F.aggregate(events.getField("period"), F.lit(0.0), lambda a, x: a + x)
    return tidy(
        grouped.select(
            "target_id", "n", F.array_join(events.getField("tce_id").cast("array<string>"), ",")
            .alias("ids"), periods.alias("periods"),
        )
    )


_SCALARS = ["epoch", "duration", "period", "secondary_phase", "opt_ghost_halo_aperture_corr",
            "transit_depth", "rolling_band_fgt"]


def _scalars_sql() -> str:
    stats = ", ".join(
        f"median({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _SCALARS
    )
    normal = ", ".join(f"({c} - m_{c}) / nullif(s_{c}, 0) AS {c}" for c in _SCALARS)
    spread = ", ".join(f"1.5 * stddev_samp({c}) AS c_{c}" for c in _SCALARS)
    clipped = ", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, -c_{c}), c_{c}) END, 6) AS {c}"
        for c in _SCALARS
    )
    return f"""
    WITH {RANKED_SPLIT_SQL},
    stats AS (SELECT {stats} FROM tces WHERE target_id IN (
                SELECT target_id FROM splits WHERE split = 'train')),
    normal AS (SELECT target_id, tce_id, label, {normal} FROM tces, stats),
    spread AS (SELECT {spread} FROM normal)
    SELECT target_id, tce_id, label, {clipped} FROM normal, spread
    """


@query("normalize_scalars", _scalars_sql(), "tces")
def normalize_scalars_query(spark, sf):
    tces = A.tces(spark, sf).select("target_id", "tce_id", "label", *_SCALARS)
    splits = ranked_split(tces.select("target_id").distinct(), 0.2, 0.3)
    train = splits.where(F.col("split") == "train")
    excluded = ["label", "tce_id", "target_id"]
    return tidy(normalize_scalars(tces, train, "target_id", excluded, 1.5))


@query(
    "order_by_period",
    f"SELECT {cols('target_id quarter seq ~time')} FROM obs",
    "obs",
)
def order_by_period(spark, sf):
    rows = K.order_by_period(A.observations(spark, sf))
    return tidy(rows.select("target_id", "quarter", "seq", "time"))


@query(
    "group_split", f"WITH {RANKED_SPLIT_SQL} SELECT target_id, split FROM splits", "tces"
)
def group_split(spark, sf):
    targets = A.tces(spark, sf).select("target_id").distinct()
    return ranked_split(targets, 0.2, 0.3)
