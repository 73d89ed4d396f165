"""Identity, order, sharding, batching, gathering, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query, table
from weftline.functions import rng
from weftline.operators import batch, gather, labels, order, shard
from weftline.plans.epoch import EpochPlan


def ids(table_: str, key: str, cols: str = "*") -> str:
    return f"SELECT {cols}, row_number() OVER (ORDER BY {key}) - 1 AS sample_id FROM {table_}"


def md5key(seed: int, epoch: int, sample: str = "sample_id", draw: str = "") -> str:
    return f"md5('{seed}:{epoch}:' || {sample}" + (f" || ':{draw}')" if draw else ")")


def udraw(seed: int, epoch: int, sample: str = "sample_id", draw: str = "") -> str:
    return f"(CAST('0x' || substr({md5key(seed, epoch, sample, draw)}, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def shuffled_sql(table_: str, key: str, seed: int, epoch: int, cols: str = "*") -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {md5key(seed, epoch)}, sample_id) - 1 AS pos FROM ({ids(table_, key, cols)})"


@query("epoch_plan", f"""
WITH s AS ({shuffled_sql('documents', 'doc_id', 42, 3, 'doc_id')}), n AS (SELECT count(*) // 4 AS k FROM documents),
b AS (SELECT sample_id, doc_id, pos - k AS p, k FROM s, n WHERE pos >= k AND pos < 2 * k)
SELECT p // 16 AS batch_id, p % 16 AS row_in_batch, sample_id, doc_id, coalesce(quality, -1) AS quality
FROM b LEFT JOIN labels USING (doc_id) WHERE p < k // 16 * 16 AND p // 16 >= 2""")
def epoch_plan(spark, sf_dir):
    docs = order.with_sample_id(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    plan = EpochPlan(batch_size=16, seed=42, epoch=3, rank=1, world=4, drop_last=True, served=2)
    rows = plan.apply(docs, docs.count())
    return gather.labelled(rows, table(spark, sf_dir, "labels"), "doc_id", "quality", -1).select("batch_id", "row_in_batch", "sample_id", "doc_id", "quality")


@query("seq_batches", f"SELECT vec_id, sample_id // 32 AS batch_id, sample_id % 32 AS row_in_batch FROM ({ids('embeddings', 'vec_id', 'vec_id')})")
def seq_batches(spark, sf_dir):
    return batch.fixed(order.with_sample_id(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id"), 32, "sample_id").select("vec_id", "batch_id", "row_in_batch")


@query("drop_last_batches", f"SELECT vec_id, sample_id // 48 AS batch_id FROM ({ids('embeddings', 'vec_id', 'vec_id')}) WHERE sample_id < (SELECT count(*) // 48 * 48 FROM embeddings)")
def drop_last_batches(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    return batch.fixed(batch.drop_last(rows, rows.count(), 48, "sample_id"), 48, "sample_id").select("vec_id", "batch_id")


@query("batch_meta", f"""SELECT sample_id // 32 AS batch_id, count(*) AS batch_size, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) AS indices,
CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_doc FROM ({ids('documents', 'doc_id', 'doc_id, n_chars')}) GROUP BY 1""")
def batch_meta(spark, sf_dir):
    rows = batch.fixed(order.with_sample_id(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), 32, "sample_id")
    return batch.metadata(rows, chars=F.sum("n_chars"), first_doc=F.min("doc_id"))


@query("global_shuffle", f"SELECT event_id, pos FROM ({shuffled_sql('events', 'event_id', 7, 1, 'event_id')})")
def global_shuffle(spark, sf_dir):
    return order.shuffled(order.with_sample_id(table(spark, sf_dir, "events").select("event_id"), "event_id"), 7, 1).select("event_id", "pos")


@query("local_shuffle", f"""WITH s AS (SELECT o_orderkey, sample_id, sample_id // 512 AS part FROM ({ids('orders', 'o_orderkey', 'o_orderkey')}))
SELECT o_orderkey, part, row_number() OVER (PARTITION BY part ORDER BY md5(CAST(11 + 1000 * part AS VARCHAR) || ':' || sample_id), sample_id) - 1 AS pos FROM s""")
def local_shuffle(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("part", F.floor(F.col("sample_id") / 512).cast("long"))
    return order.locally_shuffled(rows, "part", 9, 2).select("o_orderkey", "part", "pos")


@query("epoch_diff", f"""WITH a AS ({shuffled_sql('embeddings', 'vec_id', 5, 0, 'vec_id')}), b AS ({shuffled_sql('embeddings', 'vec_id', 5, 1, 'vec_id')})
SELECT vec_id, a.pos AS pos_0, b.pos AS pos_1, a.pos <> b.pos AS moved FROM a JOIN b USING (vec_id)""")
def epoch_diff(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    a, b = (order.shuffled(rows, 5, e).select("vec_id", F.col("pos").alias(f"pos_{e}")) for e in (0, 1))
    return a.join(b, "vec_id").withColumn("moved", F.col("pos_0") != F.col("pos_1"))


@query("draws_with_replacement", f"SELECT range AS draw, CAST('0x' || substr({md5key(3, 0, 'range', 'start')}, 1, 13) AS BIGINT) % (SELECT count(*) FROM orders) AS start FROM range(1000)")
def draws_with_replacement(spark, sf_dir):
    return order.with_replacement(spark, 1000, table(spark, sf_dir, "orders").count(), 3, 0)


@query("shard_contiguous", f"""WITH s AS ({ids('orders', 'o_orderkey', 'o_orderkey')}), n AS (SELECT count(*) // 7 AS b, count(*) % 7 AS e FROM orders)
SELECT o_orderkey, CASE WHEN sample_id < e * (b + 1) THEN sample_id // (b + 1) ELSE e + (sample_id - e * (b + 1)) // b END AS rank FROM s, n""")
def shard_contiguous(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select("o_orderkey", shard.rank_of("contiguous", F.col("sample_id"), rows.count(), 7).alias("rank"))


@query("shard_interleaved", f"SELECT doc_id, sample_id % 5 AS rank FROM ({ids('documents', 'doc_id', 'doc_id')})")
def shard_interleaved(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", shard.rank_of("Interleaved", F.col("sample_id"), 0, 5).alias("rank"))


_M = "18446744073709551616::UHUGEINT"
SPLITMIX = f"""a AS (SELECT *, xor(CAST({shard.HASH_SEED} AS UBIGINT), CAST(sample_id AS UBIGINT)) AS x0 FROM s), b AS (SELECT *, xor(x0, x0 >> 30) AS x1 FROM a),
c AS (SELECT *, CAST(x1::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % {_M} AS UBIGINT) AS x2 FROM b), d AS (SELECT *, xor(x2, x2 >> 27) AS x3 FROM c),
e AS (SELECT *, CAST(x3::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT % {_M} AS UBIGINT) AS x4 FROM d), h AS (SELECT *, xor(x4, x4 >> 31) AS x FROM e)"""


@query("shard_hash", f"WITH s AS ({ids('documents', 'doc_id', 'doc_id')}), {SPLITMIX} SELECT doc_id, CAST(x % 8 AS BIGINT) AS rank FROM h")
def shard_hash(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", shard.rank_of("hash", F.col("sample_id"), 0, 8).alias("rank"))


def _sampler_sql(drop: bool) -> str:
    total = "n // 7 * 7" if drop else "(n + 6) // 7 * 7"
    return f"""WITH s AS ({shuffled_sql('orders', 'o_orderkey', 1, 2, 'o_orderkey')}), t AS (SELECT count(*) AS n FROM orders)
SELECT slot, o_orderkey, slot % 7 AS rank FROM (SELECT range AS slot FROM range((SELECT {total} FROM t))), t JOIN s ON s.pos = slot % n"""


@query("sampler_pad", _sampler_sql(False))
def sampler_pad(spark, sf_dir, drop=False):
    rows = order.shuffled(order.with_sample_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 1, 2)
    return shard.sampler(rows, rows.count(), 7, drop).select("slot", "o_orderkey", "rank")


@query("sampler_drop", _sampler_sql(True))
def sampler_drop(spark, sf_dir):
    return sampler_pad(spark, sf_dir, True)


@query("equal_blocks", f"WITH s AS ({shuffled_sql('orders', 'o_orderkey', 1, 2, 'o_orderkey')}), n AS (SELECT count(*) // 8 AS k FROM orders) SELECT o_orderkey, pos // k AS rank FROM s, n WHERE pos < 8 * k")
def equal_blocks(spark, sf_dir):
    rows = order.shuffled(order.with_sample_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 1, 2)
    return shard.equal_blocks(rows, rows.count(), 8).select("o_orderkey", "rank")


@query("ceil_blocks", f"WITH s AS ({ids('orders', 'o_orderkey', 'o_orderkey')}), n AS (SELECT (count(*) + 11) // 12 AS k FROM orders) SELECT o_orderkey, sample_id // k AS part, sample_id // k // 3 AS rank FROM s, n")
def ceil_blocks(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return shard.ceil_blocks(rows, rows.count(), 4, 3, "sample_id").select("o_orderkey", "part", "rank")


@query("shard_report", f"""WITH s AS ({ids('orders', 'o_orderkey', 'o_orderkey')}), t AS (SELECT count(*) AS n, count(*) // 7 AS b, count(*) % 7 AS r FROM orders), {SPLITMIX},
k AS (SELECT 'contiguous' AS strategy, sample_id, CASE WHEN sample_id < r * (b + 1) THEN sample_id // (b + 1) ELSE r + (sample_id - r * (b + 1)) // b END AS rank FROM s, t
UNION ALL SELECT 'interleaved', sample_id, sample_id % 7 FROM s UNION ALL SELECT 'hash', sample_id, CAST(x % 7 AS BIGINT) FROM h),
g AS (SELECT strategy, rank, count(*) AS n FROM k GROUP BY 1, 2)
SELECT strategy, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(max(n) / min(n), 6) AS imbalance, sum(n) = (SELECT n FROM t) AS covered FROM g GROUP BY 1""")
def shard_report(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return shard.report(rows, rows.count(), 7)


@query("resume_tail", f"SELECT vec_id, pos // 32 AS batch_id, pos % 32 AS row_in_batch FROM ({shuffled_sql('embeddings', 'vec_id', 13, 4, 'vec_id')}) WHERE pos // 32 >= 6")
def resume_tail(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    return EpochPlan(batch_size=32, seed=13, epoch=4, served=6).apply(rows, rows.count()).select("vec_id", "batch_id", "row_in_batch")


_DIMS = "p_size AS w, CAST(p_partkey % 7 * 16 AS BIGINT) AS h"


def _dims(spark, sf_dir):
    return order.with_sample_id(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 7 * 16).alias("h")), "p_partkey")


@query("smart_buckets", f"""WITH s AS ({ids('part', 'p_partkey', 'p_partkey, ' + _DIMS)}), b AS (SELECT *, CAST(w // 8 * 8 AS BIGINT) AS bucket_w, CAST(h // 32 * 32 AS BIGINT) AS bucket_h FROM s)
SELECT p_partkey, bucket_w, bucket_h, p // 16 AS batch_in_bucket, p % 16 AS row_in_batch FROM (SELECT *, row_number() OVER (PARTITION BY bucket_w, bucket_h ORDER BY sample_id) - 1 AS p FROM b)""")
def smart_buckets(spark, sf_dir):
    rows = _dims(spark, sf_dir)
    return batch.size_batches(rows.select("*", *batch.bucket(F.col("w"), F.col("h"), 8, 32)), 16, "sample_id").select("p_partkey", "bucket_w", "bucket_h", "batch_in_bucket", "row_in_batch")


@query("bucket_stats", f"""WITH g AS (SELECT w // 8, h // 32, count(*) AS n FROM (SELECT {_DIMS} FROM part) GROUP BY 1, 2)
SELECT count(*) AS buckets, CAST(sum(n) AS BIGINT) AS samples, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, CAST(sum((n + 15) // 16) AS BIGINT) AS batches FROM g""")
def bucket_stats(spark, sf_dir):
    return batch.bucket_stats(_dims(spark, sf_dir).select("*", *batch.bucket(F.col("w"), F.col("h"), 8, 32)), 16)


@query("size_variation", f"SELECT count(DISTINCT (w, h)) AS sizes, count(DISTINCT (w, h)) > 1 AS varies FROM (SELECT {_DIMS} FROM part ORDER BY p_partkey LIMIT 100)")
def size_variation(spark, sf_dir):
    return batch.varies(_dims(spark, sf_dir), 100, "sample_id", "w", "h")


@query("first_sample_dims", f"SELECT sample_id // 64 AS batch_id, arg_min(w, sample_id) AS target_w, arg_min(h, sample_id) AS target_h FROM ({ids('part', 'p_partkey', _DIMS)}) GROUP BY 1")
def first_sample_dims(spark, sf_dir):
    return batch.fixed(_dims(spark, sf_dir), 64, "sample_id").groupBy("batch_id").agg(F.min_by("w", "sample_id").alias("target_w"), F.min_by("h", "sample_id").alias("target_h"))


@query("progressive_sizes", "SELECT range AS epoch, CASE WHEN range < 10 THEN CAST(floor(128.0::DOUBLE + range * 96 / 9.0::DOUBLE) AS BIGINT) ELSE 224 END AS size FROM range(15)")
def progressive_sizes(spark, sf_dir):
    return batch.progressive(spark, 128, 224, 10, 15)


_INDICES = "SELECT range AS pos, CAST(range * 37 % 613 AS BIGINT) AS sample_id FROM range(300)"


def _indices(spark):
    return spark.range(300).select(F.col("id").alias("pos"), F.pmod(F.col("id") * 37, F.lit(613)).alias("sample_id"))


@query("gather_rows", f"WITH i AS ({_INDICES}), s AS ({ids('embeddings', 'vec_id', 'vec_id, label')}) SELECT pos, sample_id, vec_id, label FROM i JOIN s USING (sample_id)")
def gather_rows(spark, sf_dir):
    rows = order.with_sample_id(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return gather.gather(rows, _indices(spark)).select("pos", "sample_id", "vec_id", "label")


@query("gather_range_check", f"WITH i AS ({_INDICES}), s AS ({ids('embeddings', 'vec_id', 'vec_id')}) SELECT pos, sample_id FROM i ANTI JOIN s USING (sample_id)")
def gather_range_check(spark, sf_dir):
    return gather.unknown(order.with_sample_id(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id"), _indices(spark)).select("pos", "sample_id")


@query("label_align", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def label_align(spark, sf_dir):
    return gather.labelled(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality", -1)


def _members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("name"), F.col("text").alias("content"), (F.col("doc_id") * 2).alias("ordinal"))
    meta = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id"), F.lit(".json")).alias("name"), F.concat(F.lit('{"label": '), "quality", F.lit("}")).alias("content"), (F.col("doc_id") * 2 + 1).alias("ordinal"))
    return docs.unionByName(meta)


@query("sidecar_group", """WITH m AS (SELECT doc_id || '.txt' AS name, text AS content FROM documents UNION ALL SELECT doc_id || '.json', '{"label": ' || quality || '}' FROM labels),
p AS (SELECT regexp_extract(name, '^(.+?)\\.([^.]+)$', 1) AS key, regexp_extract(name, '^(.+?)\\.([^.]+)$', 2) AS ext, content FROM m)
SELECT key, max(content) FILTER (ext = 'txt') AS text, coalesce(CAST(json_extract_string(max(content) FILTER (ext = 'json'), '$.label') AS BIGINT), 0) AS label, count(*) AS parts FROM p GROUP BY key""")
def sidecar_group(spark, sf_dir):
    grouped = gather.sidecars(_members(spark, sf_dir))
    return gather.decoded(grouped).join(grouped.select("key", F.size("parts").cast("long").alias("parts")), "key").select("key", "text", labels.json_field(F.col("json"), "label").alias("label"), "parts")


@query("collate_batches", "SELECT conv_id, array_to_string(list(role ORDER BY turn, text), '|') AS roles, CAST(list_sum(list(length(text) ORDER BY turn, text)) AS BIGINT) AS chars, count(*) AS turns FROM conversations GROUP BY 1")
def collate_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.struct("turn", "text"))
    lists = batch.collated(rows, ["conv_id"], "at", ["role", "text"])
    return lists.select("conv_id", F.array_join("role", "|").alias("roles"), F.aggregate("text", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.size("text").cast("long").alias("turns"))


def _folder_sql(by: str) -> str:
    return f"""WITH s AS (SELECT doc_id, split_part(source || '/' || doc_id || '.txt', '/', 1) AS class FROM documents), c AS (SELECT class, min(doc_id) AS first FROM s GROUP BY 1),
n AS (SELECT class, row_number() OVER (ORDER BY {by}) - 1 AS label FROM c) SELECT doc_id, class, label FROM s JOIN n USING (class)"""


def _named(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("\\"), "doc_id", F.lit(".txt")).alias("name"))


@query("label_folder_first_seen", _folder_sql("first"))
def label_folder_first_seen(spark, sf_dir):
    return labels.folder_labels(_named(spark, sf_dir), "name", "doc_id").select("doc_id", "class", "label")


@query("label_folder_sorted", _folder_sql("class"))
def label_folder_sorted(spark, sf_dir):
    return labels.folder_labels(_named(spark, sf_dir), "name", "doc_id", first_seen=False).select("doc_id", "class", "label")


@query("label_pattern", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0*([1-9][0-9]*)') THEN CAST(regexp_extract(c_name, '#0*([1-9][0-9]*)', 1) AS BIGINT) ELSE 0 END AS label FROM customer")
def label_pattern(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", labels.pattern(F.col("c_name"), "#0*([1-9][0-9]*)").alias("label"))


@query("label_json", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS label FROM events")
def label_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", labels.json_field(F.col("props"), "k").alias("label"))


@query("label_metadata", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 10 END AS label FROM events")
def label_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("label"), F.col("event_id") % 10)).otherwise(F.create_map(F.lit("other"), F.col("event_id"))).alias("meta"))
    return rows.select("event_id", labels.metadata(F.col("meta"), "label", -1).cast("long").alias("label"))


@query("json_label_first", "SELECT user_id, arg_min(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), event_id) AS label FROM events GROUP BY 1")
def json_label_first(spark, sf_dir):
    """The first value per name is the one that counts."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", labels.json_field(F.col("props"), "k").alias("v")).groupBy("user_id").agg(F.min_by("v", "event_id").alias("label"))


@query("hflip_draws", f"SELECT vec_id, {udraw(5, 1, 'vec_id', 'flip')} < 0.5 AS flip FROM embeddings")
def hflip_draws(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rng.bernoulli(0.5, 5, 1, F.col("vec_id"), "flip").alias("flip"))


@query("jitter_params", "SELECT vec_id, " + ", ".join(f"round(greatest(0.0, 1 - {x}) + {udraw(5, 1, 'vec_id', d)} * (1 + {x} - greatest(0.0, 1 - {x})), 9) AS {d}" for d, x in (("brightness", 0.4), ("contrast", 0.4), ("saturation", 1.2))) + f", round((2 * {udraw(5, 1, 'vec_id', 'hue')} - 1) * 36, 9) AS hue FROM embeddings")
def jitter_params(spark, sf_dir):
    u = lambda d: rng.uniform(5, 1, F.col("vec_id"), d)
    factors = [F.round(max(0.0, 1 - x) + u(d) * (1 + x - max(0.0, 1 - x)), 9).alias(d) for d, x in (("brightness", 0.4), ("contrast", 0.4), ("saturation", 1.2))]
    return table(spark, sf_dir, "embeddings").select("vec_id", *factors, F.round((2 * u("hue") - 1) * 36, 9).alias("hue"))
