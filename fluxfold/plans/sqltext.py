"""Reference SQL shared by several queries, written as plain brute force."""

from __future__ import annotations

from fluxfold.plans.registry import fold

_FOLD = fold('o."time"', "t.epoch", "t.period")


def view_sql(
    name: str, num_bins: int, low: str, high: str, width: str, *,
    value: str = "flux", rows: str | None = None, key: str = "", aggregate: str = "median",
    default: str | None = None, events: str = "tces",
) -> str:
    """Table ``name``(target_id, tce_id, [key,] bin, value) of a folded and binned view.

    ``rows`` names a table of folded rows (target_id, tce_id, [key,] x, v) for views that do not
    use the whole series.
    """
    folded = rows or f"{name}_rows"
    extra = f", {key}" if key else ""
    define = (
        ""
        if rows
        else f"""
    {folded} AS (
      SELECT o.target_id, t.tce_id, {_FOLD} AS x, o.{value} AS v
      FROM obs o JOIN {events} t ON t.target_id = o.target_id
    ),"""
    )
    fill = default or "d.fill"
    return f"""{define}
    {name}_frame AS (
      SELECT target_id, tce_id, {low} AS lo, {high} AS hi, {width} AS w,
             (({high}) - ({low}) - ({width})) / {num_bins - 1}.0::DOUBLE AS s
      FROM {events}
    ),
    {name}_fill AS (
      SELECT target_id, tce_id{extra}, median(v) AS fill FROM {folded} GROUP BY ALL
    ),
    {name}_grid AS (
      SELECT d.*, e.lo, e.hi, e.w, e.s, i.bin
      FROM {name}_fill d JOIN {name}_frame e USING (target_id, tce_id),
           (SELECT unnest(range({num_bins})) AS bin) i
    ),
    {name}_bins AS (
      SELECT target_id, tce_id{extra}, bin, {aggregate}(v) AS value
      FROM (
        SELECT f.*, e.lo, e.w, e.s, unnest(range(
                 greatest(0, CAST(floor((f.x - e.lo - e.w) / e.s) AS BIGINT) - 1),
                 least({num_bins}, CAST(floor((f.x - e.lo) / e.s) AS BIGINT) + 2))) AS bin
        FROM {folded} f JOIN {name}_frame e USING (target_id, tce_id)
        WHERE f.x >= e.lo AND f.x < e.hi
      )
      WHERE x >= lo + bin * s AND x < lo + w + bin * s
      GROUP BY ALL
    ),
    {name} AS (
      SELECT d.target_id, d.tce_id{extra and ', d.' + key}, d.bin,
             CASE WHEN b.bin IS NULL THEN {fill} ELSE b.value END AS value
      FROM {name}_grid d LEFT JOIN {name}_bins b
        ON b.target_id = d.target_id AND b.tce_id = d.tce_id AND b.bin = d.bin
           {'AND b.' + key + ' = d.' + key if key else ''}
    )"""


LOCAL_LOW = "greatest(-(period / 2.0::DOUBLE), -(duration * 2.5::DOUBLE))"
LOCAL_HIGH = "least(period / 2.0::DOUBLE, duration * 2.5::DOUBLE)"
LOCAL_WIDTH = "duration * 0.16::DOUBLE"
GLOBAL_LOW = "-(period / 2.0::DOUBLE)"
GLOBAL_HIGH = "period / 2.0::DOUBLE"
GLOBAL_WIDTH = "greatest(period / 301.0::DOUBLE, duration * 0.16::DOUBLE)"

LOCAL = (31, LOCAL_LOW, LOCAL_HIGH, LOCAL_WIDTH)
GLOBAL = (301, GLOBAL_LOW, GLOBAL_HIGH, GLOBAL_WIDTH)

LOCAL_VIEW_SQL = view_sql("local_view", *LOCAL)
GLOBAL_VIEW_SQL = view_sql("global_view", *GLOBAL)

RANKED_SPLIT_SQL = """
    ranks AS (
      SELECT target_id, row_number() OVER (ORDER BY target_id) AS c, count(*) OVER () AS n
      FROM (SELECT DISTINCT target_id FROM tces)
    ),
    edges AS (
      SELECT min(CASE WHEN c >= 0.2::DOUBLE * n THEN c END) AS a,
             min(CASE WHEN c >= 0.5::DOUBLE * n THEN c END) AS b
      FROM ranks
    ),
    splits AS (
      SELECT target_id, CASE WHEN c < a THEN 'test' WHEN c < b THEN 'validation'
                             ELSE 'train' END AS split
      FROM ranks, edges
    )"""

SEGMENTS_SQL = """
    stepped AS (
      SELECT *, "time" - lag("time") OVER (PARTITION BY target_id, quarter
                                           ORDER BY "time", seq) AS dt
      FROM obs
    ),
    segments AS (
      SELECT target_id, quarter, seq, "time", flux, centroid_x, centroid_y,
             CAST(sum(CASE WHEN dt > 0.75 THEN 1 ELSE 0 END) OVER (
               PARTITION BY target_id, quarter ORDER BY "time", seq) AS BIGINT) AS segment_id
      FROM stepped
    )"""

_ADJUSTED = "least(t.duration * 3.0::DOUBLE, abs(t.secondary_phase), t.period) * 0.5::DOUBLE"
COVERED = f"""EXISTS (SELECT 1 FROM tces t WHERE t.target_id = o.target_id
                         AND abs({_FOLD}) <= {_ADJUSTED})"""
