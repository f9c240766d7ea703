"""Queries of sources, on pages and documents as files and on JSON columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.functions import robust as R
from palisade.session import table
from palisade.sources import adapters, files


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents")
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(r"SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS container FROM pages")
def container_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.suffix(F.col("url")).alias("container"))


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page,
       regexp_matches(url, '^https?://([a-z0-9-]+[.])*example[.](com|org)([/?#]|$)') AS accepted
FROM pages
""")
def url_host(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).alias("host"),
        F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"),
        url.rlike(r"^https?://([a-z0-9-]+[.])*example[.](com|org)([/?#]|$)").alias("accepted"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events")
def props_json(spark, sf_dir):
    parsed = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].try_cast("double").alias("missing"))


@query("""
WITH q AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars * 8.0::DOUBLE / ((1 + doc_id % 50) * 6400) END AS b FROM documents)
SELECT doc_id, b AS bits_per_pixel, CASE WHEN b IS NULL THEN 'unknown' WHEN b < 0.035 THEN 'low' WHEN b < 0.12 THEN 'moderate' ELSE 'high' END AS tier,
       b IS NULL OR b < 0.12 AS confounder
FROM q
""")
def quality_tier(spark, sf_dir):
    frames = F.when(F.col("doc_id") % 9 != 0, 1 + F.col("doc_id") % 50)
    each, tier, confounder = files.quality(F.col("n_chars") * 8.0, frames, F.lit(6400))
    return table(spark, sf_dir, "documents").select("doc_id", each.alias("bits_per_pixel"), tier.alias("tier"), confounder.alias("confounder"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 AND o_orderkey % 5 > 0 THEN (o_orderkey % 5) / (o_custkey % 7)::DOUBLE END AS duration_seconds,
       chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || chr(CAST(65 + o_custkey % 26 AS INTEGER)) || 'V1' AS fourcc
FROM orders
""")
def container_metadata(spark, sf_dir):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    code = (65 + order % 26) + (65 + customer % 26) * 256 + ord("V") * 65536 + ord("1") * 16777216
    return table(spark, sf_dir, "orders").select("o_orderkey", files.duration(order % 5, (customer % 7).cast("double")).alias("duration_seconds"), files.fourcc(code).alias("fourcc"))


@query("""
WITH e AS (SELECT user_id, event_type = 'signup' AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events),
n AS (SELECT user_id FROM e GROUP BY user_id HAVING count(*) >= 8),
k AS (SELECT user_id, CAST(i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS DOUBLE) AS g FROM e JOIN n USING (user_id) WHERE key)
SELECT user_id, count(g) AS intervals, quantile_cont(g, 0.5) AS median_gop FROM k WHERE g IS NOT NULL GROUP BY user_id
""")
def frame_probe_json(spark, sf_dir):
    """Probe rows through JSON and back: key frame intervals."""
    row = F.struct(F.col("ts"), F.col("event_id"), F.when(F.col("event_type") == "signup", "1").otherwise("0").alias("key_frame"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("t"))
    listed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    frames = F.transform("rows", lambda r: F.struct(r["key_frame"].alias("key_frame"), r["t"].alias("best_effort_timestamp_time"), F.lit("I").alias("pict_type")))
    probed = listed.select("user_id", files.frame_probe(F.to_json(F.struct(frames.alias("frames")))).alias("frames")).where("frames IS NOT NULL")
    keys = F.transform(F.filter("frames", lambda f: f["key"]), lambda f: f["i"])
    gaps = probed.withColumn("keys", keys).select("user_id", F.transform("keys", lambda v, i: F.when(i > 0, v - F.get("keys", i - 1)).cast("double")).alias("gaps"))
    flat = gaps.select("user_id", F.explode("gaps").alias("g")).where("g IS NOT NULL")
    return flat.groupBy("user_id").agg(F.count("*").alias("intervals"), R.median("g").alias("median_gop"))


@query()
def adapter_availability(spark, sf_dir):
    return adapters.availability(spark)


@query("""
WITH f AS (SELECT i, CASE WHEN i < 12 THEN 40 ELSE 120 END AS ground, i * 6 % 32 AS box FROM range(24) t(i)),
p AS (SELECT i, k, CAST(CASE WHEN k % 48 >= box AND k % 48 < box + 16 AND k // 48 >= 10 AND k // 48 < 22 THEN 255 ELSE ground END AS DOUBLE) AS v FROM f, range(48 * 32) r(k)),
d AS (SELECT i, abs(v - lag(v) OVER (PARTITION BY k ORDER BY i)) AS change FROM p)
SELECT i AS frame_index, avg(change) AS change FROM d WHERE i > 0 GROUP BY i
""")
def synthetic_clip_motion(spark, sf_dir):
    """Mean change between frames of the generated clip."""
    from palisade.operators import sequence as S

    clip = files.synthetic_clip(spark, width=48, height=32).withColumn("clip", F.lit(1))
    both = S.pairs(clip, ["clip"], "frame_index", "pixels").where(F.col("previous").isNotNull())
    return both.select("frame_index", S.l1(F.col("previous"), F.col("pixels")).alias("change"))


@query("""
WITH j AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no json' WHEN event_id % 5 = 0 THEN '{"streams": []}'
    ELSE '{"streams": [{"codec_name": "' || event_type || '", "pix_fmt": "yuv420p", "bit_rate": "' || CAST(CAST(user_id * 1000 AS BIGINT) AS VARCHAR) || '"}, {"codec_name": "aac"}]}' END AS j
  FROM events
), v AS (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM j)
SELECT event_id, json_extract_string(j, '$.streams[0].codec_name') AS codec_name, json_extract_string(j, '$.streams[0].pix_fmt') AS pix_fmt,
       json_extract_string(j, '$.streams[0].bit_rate') AS bit_rate, json_extract_string(j, '$.streams[0].color_range') AS color_range FROM v
""")
def stream_probe_json(spark, sf_dir):
    """The first stream of a probe's answer; some answers have none or are no JSON."""
    one = F.concat(F.lit('{"streams": [{"codec_name": "'), "event_type", F.lit('", "pix_fmt": "yuv420p", "bit_rate": "'), (F.col("user_id") * 1000).cast("string"), F.lit('"}, {"codec_name": "aac"}]}'))
    json = F.when(F.col("event_id") % 7 == 0, "no json").when(F.col("event_id") % 5 == 0, '{"streams": []}').otherwise(one)
    return table(spark, sf_dir, "events").select("event_id", files.stream_probe(json).alias("s")).select("event_id", "s.*")
