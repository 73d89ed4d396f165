"""Scans, token windows, video plans, cache, errors, profiles, event windows."""

from __future__ import annotations


from pyspark.sql import functions as F

from weftline.catalog import query, table
from weftline.catalog.samples import ids
from weftline.operators import observe, order, windows
from weftline.sources import formats

_KINDS = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{kind}'" for kind, exts in formats.KINDS.items())


@query("ext_detect", f"SELECT page_id, CASE {_KINDS} ELSE 'unknown' END AS format FROM (SELECT page_id, regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([^./]+)$', 1) AS ext FROM pages)")
def ext_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", formats.by_extension(F.regexp_replace("url", "[?#].*$", "")).alias("format"))


@query("source_detect", "SELECT page_id, CASE WHEN starts_with(lower(u), 'http://') OR starts_with(lower(u), 'https://') THEN 'http' WHEN starts_with(u, 's3://') THEN 's3' WHEN starts_with(u, 'gs://') THEN 'gcs' ELSE 'local' END AS kind FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 's3') WHEN 2 THEN 'gs://b/' || page_id ELSE 'file:///x/' || page_id END AS u FROM pages)")
def source_detect(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, F.replace("url", F.lit("http"), F.lit("s3"))).when(k == 2, F.concat(F.lit("gs://b/"), "page_id")).otherwise(F.concat(F.lit("file:///x/"), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", formats.by_scheme(url).alias("kind"))


_HEADS = {"FFD8FFE000104A4649460001": 0, "89504E470D0A1A0A0000000D": 1, "524946460000000057454250": 2, "424D00000000000000000000": 3, "47494638": 4}


@query("magic_sniff", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'bmp' ELSE 'unknown' END AS format FROM events")
def magic_sniff(spark, sf_dir):
    head = F.coalesce(*(F.when(F.col("event_id") % 5 == k, F.unhex(F.lit(h))) for h, k in _HEADS.items()))
    return table(spark, sf_dir, "events").select("event_id", formats.by_magic(head).alias("format"))


@query("csv_like_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 500 OFFSET 100")
def csv_like_range(spark, sf_dir):
    """skip_rows and max_rows over a declared order, for three columns."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").offset(100).limit(500).drop("l_extendedprice")


@query("parquet_projection", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def parquet_projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_extendedprice")


@query("concat_groups", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def concat_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return rows.filter("s_suppkey % 2 = 0").unionByName(rows.filter("s_suppkey % 2 = 1"))


_INDEX = f"SELECT *, CASE WHEN sample_id % 9 = 0 THEN 0 ELSE p_size * 16 END AS w, CASE WHEN sample_id % 11 = 0 THEN 0 ELSE p_size * 8 END AS h, CASE sample_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'raw' END AS format FROM ({ids('part', 'p_partkey', 'p_partkey, p_size')})"


def _index(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    i = F.col("sample_id")
    return rows.withColumns({"w": F.when(i % 9 == 0, 0).otherwise(F.col("p_size") * 16), "h": F.when(i % 11 == 0, 0).otherwise(F.col("p_size") * 8), "format": F.when(i % 3 == 0, "jpeg").when(i % 3 == 1, "png").otherwise("raw")})


@query("index_filter_dims", f"SELECT sample_id, w, h FROM ({_INDEX}) WHERE w > 0 AND h > 0 AND w >= 160 AND h >= 80 AND w <= 640")
def index_filter_dims(spark, sf_dir):
    return formats.within(_index(spark, sf_dir), min_w=160, min_h=80, max_w=640).select("sample_id", "w", "h")


@query("index_filter_format", f"SELECT sample_id FROM ({_INDEX}) WHERE format = 'png'")
def index_filter_format(spark, sf_dir):
    return _index(spark, sf_dir).filter(F.col("format") == "png").select("sample_id")


@query("read_files", "SELECT a.doc_id AS pos, coalesce(length(d.text), 0) AS size, d.text IS NOT NULL AS found FROM documents a LEFT JOIN documents d ON d.doc_id = a.doc_id * 3")
def read_files(spark, sf_dir):
    """A list of keys to contents; a missing one is empty, not an error."""
    documents = table(spark, sf_dir, "documents")
    asked = documents.select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 3).alias("doc_id"))
    return asked.join(documents.select("doc_id", "text"), "doc_id", "left").select("pos", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), F.col("text").isNotNull().alias("found"))


_TOKENS = f"SELECT sample_id AS pos, CAST(n_chars * 31 % 50000 AS BIGINT) AS token FROM ({ids('documents', 'doc_id', 'doc_id, n_chars')})"


def _tokens(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "pos")
    return rows.select("pos", (F.col("n_chars") * 31 % 50000).alias("token"))


def _windows_sql(start: str) -> str:
    return f"""WITH t AS ({_TOKENS}), n AS (SELECT count(*) - 17 AS m FROM t), p AS (SELECT range AS window_id, {start} AS start FROM range((SELECT greatest(1, m // 64) * 4 FROM n)), n)
SELECT window_id, start, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY pos) FILTER (pos < start + 16) AS x, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY pos) FILTER (pos > start) AS y
FROM p JOIN t ON pos BETWEEN start AND start + 16 GROUP BY 1, 2"""


def _token_windows(spark, sf_dir, seed=None):
    tokens = _tokens(spark, sf_dir)
    plan = windows.starts(spark, tokens.count(), 16, 4, seed=seed)
    w = windows.windows(tokens, plan, 16)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return w.select(F.col("window").alias("window_id"), "start", joined("x"), joined("y"))


@query("token_windows_seq", _windows_sql("range * 16 % m"))
def token_windows_seq(spark, sf_dir):
    return _token_windows(spark, sf_dir)


@query("token_windows_rand", _windows_sql("CAST('0x' || substr(md5('21:0:' || range || ':start'), 1, 13) AS BIGINT) % m"))
def token_windows_rand(spark, sf_dir):
    return _token_windows(spark, sf_dir, 21)


@query("causal_shift", f"SELECT pos, x, y FROM (SELECT pos, token AS x, lead(token) OVER (ORDER BY pos) AS y FROM ({_TOKENS})) WHERE y IS NOT NULL")
def causal_shift(spark, sf_dir):
    return windows.shifted(_tokens(spark, sf_dir), 128)


@query("array_batches", f"SELECT sample_id // 64 AS batch_id, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first_sum, string_agg(CAST(label AS VARCHAR), ',' ORDER BY sample_id) AS labels FROM ({ids('embeddings', 'vec_id', 'vec_id, embedding, label')}) GROUP BY 1")
def array_batches(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "embeddings"), "vec_id").withColumn("batch_id", F.floor(F.col("sample_id") / 64).cast("long"))
    first, joined = F.round(F.sum(F.col("embedding")[0].cast("double")), 4), F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "label"))), lambda r: r["label"].cast("string"))
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), first.alias("first_sum"), F.array_join(joined, ",").alias("labels"))


@query("raw_view_check", "SELECT count(DISTINCT len(embedding)) AS sizes, count(*) AS rows, count(DISTINCT len(embedding)) = 1 AS uniform FROM embeddings")
def raw_view_check(spark, sf_dir):
    """What a fixed-width view needs: one size for all."""
    sizes = F.countDistinct(F.size("embedding"))
    return table(spark, sf_dir, "embeddings").agg(sizes.alias("sizes"), F.count("*").alias("rows"), (sizes == 1).alias("uniform"))


_VIDEOS = "SELECT o_custkey AS video, count(*) AS n_frames FROM orders GROUP BY 1"
_PLAN = f"SELECT video, n_frames, greatest(0, n_frames - 4 + 1) AS n_windows, CAST(sum(greatest(0, n_frames - 4 + 1)) OVER (ORDER BY video) AS BIGINT) AS high FROM ({_VIDEOS})"


def _videos(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("video")).agg(F.count("*").alias("n_frames"))


@query("video_plan", f"SELECT video, n_windows, high - n_windows AS low, high FROM ({_PLAN})")
def video_plan(spark, sf_dir):
    return windows.video_plan(_videos(spark, sf_dir), 4).select("video", "n_windows", "low", "high")


_DRAWS = f"SELECT range AS draw, CAST('0x' || substr(md5('4:0:' || range || ':clip'), 1, 13) AS BIGINT) % (SELECT max(high) FROM plan) AS g FROM range(200)"
_CLIPS = f"WITH plan AS ({_PLAN}), d AS ({_DRAWS}), c AS (SELECT draw, video, n_frames, g - (high - n_windows) AS start FROM d JOIN plan ON g >= high - n_windows AND g < high)"


def _clips(spark, sf_dir):
    plan = windows.video_plan(_videos(spark, sf_dir), 4)
    total = plan.agg(F.max("high")).first()[0]
    draws = spark.range(200).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("4:0:"), "id", F.lit(":clip"))), 1, 13), 16, 10).cast("long"), F.lit(total)).alias("g"))
    return windows.located(plan, draws, 64).select("draw", "video", "n_frames", "start")


@query("clip_windows", f"{_CLIPS} SELECT draw, video, start FROM c")
def clip_windows(spark, sf_dir):
    return _clips(spark, sf_dir).select("draw", "video", "start")


@query("clip_frames", f"{_CLIPS} SELECT draw, CAST(k AS BIGINT) AS k, video, least(start + k * 2, n_frames - 1) AS frame FROM c, (SELECT range AS k FROM range(4))")
def clip_frames(spark, sf_dir):
    return windows.clip_frames(_clips(spark, sf_dir), 4, 2).select("draw", F.col("k").cast("long").alias("k"), "video", "frame")


@query("clip_aug", f"{_CLIPS}, a AS (SELECT draw, video, start, CAST('0x' || substr(md5('4:0:' || draw || ':x'), 1, 13) AS BIGINT) % 33 AS x, CAST('0x' || substr(md5('4:0:' || draw || ':flip'), 1, 13) AS BIGINT) % 2 = 1 AS flip FROM c) SELECT draw, range AS k, x, flip FROM a, range(4)")
def clip_aug(spark, sf_dir):
    """One crop and one flip for all frames of a clip: drawn at the clip, joined to its frames."""
    from weftline.functions import rng

    clips = _clips(spark, sf_dir).withColumns({"x": rng.below(33, 4, 0, F.col("draw"), "x"), "flip": rng.below(2, 4, 0, F.col("draw"), "flip") == 1})
    return windows.clip_frames(clips, 4, 1).select("draw", F.col("k").cast("long").alias("k"), "x", "flip")


@query("sequential_clips", f"SELECT video, range AS clip, range * 3 AS start FROM ({_VIDEOS}), range(100000) WHERE range < n_frames // 3")
def sequential_clips(spark, sf_dir):
    return windows.sequential_clips(_videos(spark, sf_dir), 3).select("video", F.col("clip").cast("long").alias("clip"), "start")


@query("cache_dedup", "SELECT md5(text) AS content, min(doc_id) AS doc_id, count(*) AS hits FROM documents GROUP BY 1")
def cache_dedup(spark, sf_dir):
    return observe.by_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("cache_stats", "SELECT count(*) AS lookups, count(DISTINCT text) AS misses, count(*) - count(DISTINCT text) AS hits, round((count(*) - count(DISTINCT text)) / count(*), 6) AS hit_rate FROM documents")
def cache_stats(spark, sf_dir):
    return observe.cache_stats(table(spark, sf_dir, "documents"), "text")


_ERRORS = "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' END AS error_type, CASE WHEN n_chars < 200 THEN 'WARNING' WHEN n_chars > 8000 THEN 'ERROR' END AS severity FROM documents"


def _checked(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 200, "too_short").when(n > 8000, "too_long").alias("error_type"), F.when(n < 200, "WARNING").when(n > 8000, "ERROR").alias("severity"))


@query("error_summary", f"SELECT severity, error_type, count(*) AS n FROM ({_ERRORS}) WHERE error_type IS NOT NULL GROUP BY 1, 2")
def error_summary(spark, sf_dir):
    return observe.error_summary(_checked(spark, sf_dir))


@query("error_threshold", f"SELECT count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) AS counted, count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) > 20 AS exceeded FROM ({_ERRORS})")
def error_threshold(spark, sf_dir):
    return observe.error_threshold(_checked(spark, sf_dir), 20)


@query("error_policy", f"SELECT doc_id, CASE WHEN error_type IS NULL THEN doc_id % 100 ELSE 0 END AS value, error_type IS NULL AS is_ok FROM ({_ERRORS})")
def error_policy(spark, sf_dir):
    return observe.on_error(_checked(spark, sf_dir).withColumn("value", F.col("doc_id") % 100), F.col("error_type").isNull(), "zero", ["value"]).select("doc_id", "value", "is_ok")


@query("profile_stats", "SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def profile_stats(spark, sf_dir):
    return observe.profile(table(spark, sf_dir, "events"), "event_type", "value")


@query("ev_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ev_tumbling(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("ev_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1")
def ev_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@query("ev_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def ev_session(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "last", "n")


@query("ev_dedup", "SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2")
def ev_dedup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("feature_list")
def feature_list(spark, sf_dir):
    """The registered queries: the capability report."""
    from weftline.catalog import QUERIES, SQL

    return spark.createDataFrame([(n, n in SQL, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(QUERIES.items())], "name string, has_sql boolean, about string")


