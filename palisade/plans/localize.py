"""Queries of localized events: values that stand out in a clip's events, by the branch they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.operators import localize as L
from palisade.plans.standins import BRANCH_SQL, FRAME_SQL, ORDER, SIGNAL_SQL, BRANCH_OF, branch_results, clips, signals

_EVENTS = "WITH " + SIGNAL_SQL + "," + BRANCH_SQL + """, cl AS (SELECT *, CASE WHEN fps > 0 THEN frame_count / fps END AS duration_seconds FROM clips),
kinds(metric, kind, k) AS (VALUES ('cut_indices', 'scene-cut', 0), ('abrupt_transition_indices', 'temporal-transition', 1), ('observation_indices', 'face-region-observation', 2),
  ('keyframe_indices', 'keyframe', 3), ('instability_indices', 'wavelet-instability', 4), ('interpolation_event_indices', 'interpolation-residual', 5),
  ('duplicate_residual_indices', 'duplicate-residual', 6)),
ev AS (
  SELECT s.clip_id, dim.branch, kinds.metric, kind, pos AS frame_index, round(pos / fps, 6) AS ts
  FROM sig s JOIN dim ON dim.event_type = s.event_type AND dim.half = hour(s.ts) % 2 JOIN kinds ON kinds.k = branch_order % 7 JOIN cl USING (clip_id)
  WHERE value > 25
)
"""


def metrics(spark, sf_dir):
    dim = spark.createDataFrame([(t, h, b, list(L.KINDS)[ORDER.index(b) % 7]) for (t, h), b in BRANCH_OF.items()], "event_type string, half int, branch string, metric string")
    rows = signals(spark, sf_dir).where("value > 25").withColumn("half", F.hour("ts") % 2).join(F.broadcast(dim), ["event_type", "half"])
    return rows.groupBy("clip_id", "branch", "metric").agg(F.collect_list(F.col("pos").cast("long")).alias("indices"))


def timed_clips(spark, sf_dir):
    return clips(spark, sf_dir).withColumn("duration_seconds", F.col("frame_count") / F.col("fps"))


def event_rows(spark, sf_dir):
    return L.events(metrics(spark, sf_dir), timed_clips(spark, sf_dir))


@query(_EVENTS + "SELECT clip_id, branch, kind, frame_index, ts FROM ev")
def localized_events(spark, sf_dir):
    return event_rows(spark, sf_dir).drop("metric")


_CLUSTERS = _EVENTS + """, e2 AS (SELECT *, lag(frame_index) OVER w AS before FROM ev WHERE kind <> 'keyframe' WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index, branch, metric)),
e3 AS (SELECT *, sum(CASE WHEN before IS NULL OR frame_index - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_index, branch, metric) AS c FROM e2),
cs AS (SELECT clip_id, c, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(DISTINCT branch) AS branch_count, count(*) AS event_count,
              string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches FROM e3 GROUP BY clip_id, c)
"""


@query(_CLUSTERS + "SELECT clip_id, start_frame, end_frame, branch_count, event_count, branches FROM cs WHERE branch_count >= 2")
def event_clusters(spark, sf_dir):
    found = L.clusters(event_rows(spark, sf_dir)).where("branch_count >= 2").drop("cluster")
    return found.withColumn("branches", F.array_join("branches", ","))


@query(_CLUSTERS + """, p AS (
  SELECT clip_id, CAST(sum(event_count) AS BIGINT) AS n, count(*) AS c, count(*) FILTER (WHERE branch_count >= 2) AS k, coalesce(max(branch_count) FILTER (WHERE branch_count >= 2), 0) AS b FROM cs GROUP BY clip_id
)
SELECT cl.clip_id, CASE WHEN n IS NULL THEN 'no-localized-events' WHEN k > 0 THEN 'cross-branch-supported' ELSE 'events-not-coincident' END AS status,
       coalesce(n, 0) AS event_count, coalesce(k, 0) AS coincident_event_count, coalesce(b, 0) AS supporting_branch_count,
       CASE WHEN n IS NOT NULL THEN round(least(1.0, b / 3.0::DOUBLE) * least(1.0, k / c::DOUBLE), 6) END AS score,
       coalesce(round(least(1.0, b / 3.0::DOUBLE * least(1.0, n / 8.0::DOUBLE)), 6), 0) AS confidence
FROM cl LEFT JOIN p USING (clip_id)
""")
def alignment_score(spark, sf_dir):
    return L.alignment(event_rows(spark, sf_dir), timed_clips(spark, sf_dir))


_BINS = _EVENTS + """, b0 AS (
  SELECT ev.*, CASE WHEN duration_seconds > 0 THEN greatest(1.0, duration_seconds / 12) ELSE 1.0 END AS w FROM ev JOIN cl USING (clip_id)
), b1 AS (SELECT *, CASE WHEN ts IS NULL THEN frame_index ELSE CAST(floor(ts / w) AS BIGINT) END AS bucket FROM b0),
bins AS (SELECT clip_id, bucket, count(DISTINCT branch) AS branch_count, any_value(w) AS w, bool_and(ts IS NULL) AS untimed FROM b1 GROUP BY clip_id, bucket HAVING count(DISTINCT branch) >= 2)
"""


@query(_BINS + """
SELECT clip_id, bucket, branch_count, CASE WHEN NOT untimed THEN round(bucket * w, 6) END AS start_seconds, CASE WHEN NOT untimed THEN round((bucket + 1) * w, 6) END AS end_seconds FROM bins
""")
def event_bins(spark, sf_dir):
    return L.bins(event_rows(spark, sf_dir), timed_clips(spark, sf_dir))


@query(_BINS + """, t AS (SELECT clip_id, count(DISTINCT branch) AS n FROM ev GROUP BY clip_id), m AS (SELECT clip_id, count(*) AS k, max(branch_count) AS b FROM bins GROUP BY clip_id)
SELECT cl.clip_id, coalesce(k, 0) AS consensus_event_count, coalesce(b, 0) AS supporting_branch_count, coalesce(n, 0) AS event_branch_count, coalesce(round(b / n::DOUBLE, 6), 0) AS support_fraction
FROM cl LEFT JOIN t USING (clip_id) LEFT JOIN m USING (clip_id)
""")
def localization_support(spark, sf_dir):
    return L.support(event_rows(spark, sf_dir), timed_clips(spark, sf_dir))


@query(_EVENTS + """
SELECT br.clip_id, branch, 0.0::DOUBLE AS start_seconds, round(duration_seconds, 6) AS end_seconds, score, least(48, frame_count) AS sample_count FROM br JOIN cl USING (clip_id)
""")
def clip_segments(spark, sf_dir):
    samples = clips(spark, sf_dir).select("clip_id", F.least(F.lit(48).cast("long"), F.col("frame_count")).alias("sample_count"))
    return L.segments(branch_results(spark, sf_dir), timed_clips(spark, sf_dir), samples)


@query(_CLUSTERS + """
SELECT ev.clip_id, ev.branch, ev.frame_index, ev.ts, coalesce(br.score, f.s) AS confidence
FROM ev LEFT JOIN br ON br.clip_id = ev.clip_id AND br.branch = ev.branch AND br.status = 'ok'
LEFT JOIN (SELECT clip_id, round(max(score), 6) AS s FROM br GROUP BY clip_id) f ON f.clip_id = ev.clip_id
""")
def timeline(spark, sf_dir):
    """Events with the score of their branch, else the clip's highest."""
    scores = branch_results(spark, sf_dir)
    own = scores.where("status = 'ok'").select("clip_id", "branch", F.col("score").alias("own"))
    best = scores.groupBy("clip_id").agg(F.round(F.max("score"), 6).alias("best"))
    rows = event_rows(spark, sf_dir).join(own, ["clip_id", "branch"], "left").join(best, "clip_id", "left")
    return rows.select("clip_id", "branch", "frame_index", "ts", F.coalesce("own", "best").alias("confidence"))


_OWN = "WITH " + FRAME_SQL.replace("label AS clip_id", "label * 100000 + vec_id // 64 AS clip_id").replace("PARTITION BY label", "PARTITION BY label, vec_id // 64") + """, hs AS (SELECT clip_id, pos, frame_index, tile, v / sum(v) OVER (PARTITION BY frame_index) AS h FROM tiles),
hd AS (SELECT b.clip_id, b.frame_index, sqrt(greatest(0.0, 1 - sum(sqrt(a.h * b.h)))) AS x FROM hs a JOIN hs b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1 AND a.tile = b.tile GROUP BY ALL),
q AS (
  SELECT clip_id, pos, frame_index, (tile // 8) // 2 * 4 + (tile % 8) // 2 AS k,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 0) AS a, sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 1) AS b,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 0) AS c, sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 1) AS d
  FROM tiles GROUP BY ALL
), e AS (SELECT clip_id, pos, frame_index, avg(abs(a + b + c + d)) / 2 AS ll, avg(abs(a + b - c - d)) / 2 AS lh, avg(abs(a - b + c - d)) / 2 AS hl, avg(abs(a - b - c + d)) / 2 AS hh FROM q GROUP BY ALL),
n AS (SELECT clip_id, pos, frame_index, ll / (ll + 1e-6) AS x1, lh / (ll + 1e-6) AS x2, hl / (ll + 1e-6) AS x3, hh / (ll + 1e-6) AS x4 FROM e),
wd AS (SELECT b.clip_id, b.frame_index, (abs(a.x1 - b.x1) + abs(a.x2 - b.x2) + abs(a.x3 - b.x3) + abs(a.x4 - b.x4)) / 4 AS x FROM n a JOIN n b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1),
sg AS (SELECT clip_id, pos, frame_index, list_transform(tiles, lambda x: x / 32) AS s FROM frames),
ch AS (SELECT b.clip_id, b.frame_index, list_avg(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2]))) AS x FROM sg a JOIN sg b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1),
sd AS (
  SELECT b.clip_id, b.frame_index, list_avg(list_transform(list_zip(a.s, c.s), lambda z: abs(z[1] - z[2]))) + 0.05 AS motion,
         list_avg(list_transform(list_zip(a.s, b.s, c.s), lambda z: abs(z[2] - (z[1] + z[3]) / 2))) / (list_avg(list_transform(list_zip(a.s, c.s), lambda z: abs(z[1] - z[2]))) + 0.05) AS x
  FROM sg a JOIN sg b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1 JOIN sg c ON c.clip_id = b.clip_id AND c.pos = b.pos + 1
), al AS (SELECT 'h' AS k, clip_id, frame_index, x, 0 AS motion FROM hd UNION ALL SELECT 'w', *, 0 FROM wd UNION ALL SELECT 's', clip_id, frame_index, x, motion FROM sd),
am AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY k, clip_id) AS m FROM al), ad AS (SELECT *, quantile_cont(abs(x - m), 0.5) OVER (PARTITION BY k, clip_id) AS d FROM am),
ow AS (
  SELECT clip_id, 'scene' AS branch, 'cut_indices' AS metric, frame_index FROM ad WHERE k = 'h' AND (x >= 0.35 OR (x - m) / (1.4826 * d + 1e-9) >= 6)
  UNION ALL SELECT clip_id, 'wavelet', 'instability_indices', frame_index FROM ad WHERE k = 'w' AND x > m + 4 * (d + 1e-6) AND x > greatest(0.02, m * 2.5)
  UNION ALL SELECT clip_id, 'resampling', 'interpolation_event_indices', frame_index FROM ad WHERE k = 's' AND x < m - greatest(2 * (d + 1e-6), 0.12) AND motion > 1
  UNION ALL SELECT clip_id, 'resampling', 'duplicate_residual_indices', frame_index FROM ch WHERE x <= 0.65
)
"""


def own_events(spark, sf_dir):
    """Index lists of branches' own events, of clips of 64 ids at most."""
    from pyspark.sql import Window

    from palisade.functions import tiles as T
    from palisade.operators import events as V
    from palisade.operators import sequence as S
    from palisade.plans.standins import frames

    clip = (F.col("clip_id") * 100000 + F.floor(F.col("frame_index") / 64)).alias("clip_id")
    by = Window.partitionBy("clip_id").orderBy("frame_index")
    rows = frames(spark, sf_dir).select(clip, "frame_index", "tiles").withColumn("pos", F.row_number().over(by) - 1)
    rows = rows.withColumn("total", F.aggregate("tiles", F.lit(0.0), lambda s, v: s + v)).withColumn("h", F.transform("tiles", lambda v: v / F.col("total")))
    scenes = S.pairs(rows, ["clip_id"], "pos", "h").where(F.col("previous").isNotNull()).select("clip_id", "frame_index", T.histogram_distance(F.col("previous"), F.col("h")).alias("distance"))
    signed = rows.select("clip_id", "pos", "frame_index", F.transform("tiles", lambda x: x / 32).alias("signature"))
    return V.index_lists(V.scene_cuts(scenes), V.wavelet_bursts(rows, 8), V.resampling_events(signed))


@query(_OWN + "SELECT clip_id, branch, metric, string_agg(CAST(frame_index AS VARCHAR), ',' ORDER BY frame_index) AS indices FROM ow GROUP BY clip_id, branch, metric")
def branch_index_lists(spark, sf_dir):
    """The frames at which branches see something, as reports list them."""
    return own_events(spark, sf_dir).withColumn("indices", F.array_join("indices", ","))


@query(_OWN + """, e2 AS (SELECT *, lag(frame_index) OVER w AS before FROM ow WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index, branch, metric)),
e3 AS (SELECT *, sum(CASE WHEN before IS NULL OR frame_index - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_index, branch, metric) AS c FROM e2)
SELECT clip_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(DISTINCT branch) AS branch_count, count(*) AS event_count, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches
FROM e3 GROUP BY clip_id, c
""")
def branch_event_clusters(spark, sf_dir):
    """Runs of near events of the branches themselves."""
    lists = own_events(spark, sf_dir)
    clips_ = lists.select("clip_id", F.lit(24.0).alias("fps")).distinct()
    return L.clusters(L.events(lists, clips_)).drop("cluster").withColumn("branches", F.array_join("branches", ","))
