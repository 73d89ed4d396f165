"""Invariants, edge cases, and kernels against plain NumPy."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import catalog, shared
from weftline.functions import augment, bits, image, rng
from weftline.operators import batch, gather, order, relational, shard, transforms, windows
from weftline.plans.epoch import EpochPlan
from weftline.sources import archive, codecs, formats, image_files, records, store

few = settings(max_examples=6, deadline=None)


def samples(spark, n):
    return spark.range(n).withColumnRenamed("id", "sample_id")


@few
@given(n=st.integers(0, 120), world=st.integers(1, 9), epoch=st.integers(0, 3))
def test_ranks_are_disjoint_and_cover(spark, n, world, epoch):
    for kind in ("ceil_blocks", "contiguous", "interleaved", "hash"):
        seen = [r[0] for rank in range(min(world, 3)) for r in EpochPlan(4, 1, epoch, rank=rank, world=world, shard=kind).ids(samples(spark, n), n).select("sample_id").collect()]
        assert len(seen) == len(set(seen)) and (world > 3 or sorted(seen) == list(range(n)))


def test_order_is_a_permutation_and_depends_on_the_epoch(spark):
    a, b = ([r["sample_id"] for r in order.shuffled(samples(spark, 300), 1, e).orderBy("pos").collect()] for e in (0, 1))
    assert sorted(a) == list(range(300)) and a != b
    assert a == [r["sample_id"] for r in order.shuffled(samples(spark, 300).repartition(7), 1, 0).orderBy("pos").collect()]


def test_two_level_rank_equals_one_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000003).alias("k"))
    got = {r["k"]: r["sample_id"] for r in order.with_sample_id(df, "k").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got)


def test_splitmix_equals_the_definition(spark):
    def mixed(x):
        m = (1 << 64) - 1
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    rows = spark.range(500).select("id", bits.unsigned_mod(bits.splitmix(F.col("id").bitwiseXOR(F.lit(shard.HASH_SEED))), 8).alias("r")).collect()
    assert all(r["r"] == mixed(shard.HASH_SEED ^ r["id"]) % 8 for r in rows)


def test_uniform_equals_hashlib(spark):
    u = augment.draws(3, 1, 17)
    row = spark.range(17, 18).select(rng.uniform(3, 1, F.col("id"), "x").alias("u")).first()
    assert row["u"] == u("x") == int(hashlib.md5(b"3:1:17:x").hexdigest()[:13], 16) / 16**13


def test_plan_resume_and_drop_last(spark):
    whole = EpochPlan(8, 5, 2, drop_last=True).ids(samples(spark, 61), 61).collect()
    rest = EpochPlan(8, 5, 2, drop_last=True, served=3).ids(samples(spark, 61), 61).collect()
    assert len(whole) == 56 and sorted(r for r in whole if r["batch_id"] >= 3) == sorted(rest)
    with pytest.raises(ValueError):
        EpochPlan(0)


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        shard.rank_of("nope", F.lit(1), 1, 1)
    with pytest.raises(ValueError):
        transforms.chain(("Nope",))
    with pytest.raises(ValueError):
        formats.kind_of("x.nope")


def test_windows_match_positions(spark):
    tokens = spark.range(66).select(F.col("id").alias("pos"), F.col("id").alias("token"))
    plan = windows.starts(spark, 66, 8, 2)
    for r in windows.windows(tokens, plan, 8).collect():
        assert r["x"] == list(range(r["start"], r["start"] + 8)) and r["y"] == [v + 1 for v in r["x"]]
    with pytest.raises(ValueError):
        windows.starts(spark, 8, 8, 2)


def test_gather_keeps_repeats_and_reports_unknown(spark):
    idx = spark.createDataFrame([(0, 3), (1, 3), (2, 99)], "pos long, sample_id long")
    assert gather.gather(samples(spark, 5), idx).count() == 2
    assert [r["sample_id"] for r in gather.unknown(samples(spark, 5), idx).collect()] == [99]


def test_size_batches_lose_nothing(spark):
    df = samples(spark, 200).select("*", *batch.bucket(F.col("sample_id") % 5 * 32, F.lit(7)))
    got = batch.size_batches(df, 16, "sample_id").groupBy("bucket_w", "batch_in_bucket").count().collect()
    assert sum(r["count"] for r in got) == 200 and max(r["count"] for r in got) == 16


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "i long, k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("c", 1, 10)], "k string, t long, v long")
    assert {r["i"]: r["v"] for r in relational.asof(left, right, ["k"], "t", "v").collect()} == {1: 50, 2: None, 3: None}


RANDOM = np.random.default_rng(0).integers(0, 256, (9, 12, 3), np.uint8)


def test_resize_kernels():
    assert (image.resize(RANDOM, 12, 9) == RANDOM).all()
    assert (image.resize(RANDOM[:8], 6, 4) == RANDOM[:8].reshape(4, 2, 6, 2, 3).mean((1, 3)).astype(int)).all()
    flat = np.full((9, 12, 3), 77, np.uint8)
    for mode in ("nearest", "bilinear", "bicubic", "lanczos", "antialias"):
        assert (image.resize(flat, 5, 20, mode) == 77).all(), mode


def test_value_kernels():
    assert (image.invert(image.invert(RANDOM)) == RANDOM).all()
    assert (image.posterize(RANDOM, 8) == RANDOM).all()
    assert np.abs(image.hsv_to_rgb(image.rgb_to_hsv(RANDOM)).astype(int) - RANDOM).max() <= 1
    assert (image.rotate(RANDOM[:9, :9], 0) == RANDOM[:9, :9]).all()
    assert (image.autocontrast(np.full((2, 2, 3), 5, np.uint8)) == 0).all()
    assert (image.blur(np.full((5, 5, 3), 9, np.uint8), 3) == 9).all()
    with pytest.raises(ValueError):
        image.gaussian_kernel(4)
    with pytest.raises(ValueError):
        image.normalize(RANDOM, (0, 0, 0), (1, 0, 1))


def test_policies_run_and_repeat():
    for make in (augment.auto_augment, augment.rand_augment, augment.trivial_augment):
        for i in range(20):
            a, b = (make(RANDOM, augment.draws(1, 0, i)) for _ in range(2))
            assert a.shape == RANDOM.shape and (a == b).all()
    assert [len(augment.policy(n)) for n in ("imagenet", "cifar10", "svhn")] == [20, 20, 15]


def test_codecs():
    assert (codecs.decode(codecs.encode_bmp(RANDOM)) == RANDOM).all()
    assert (codecs.decode(codecs.encode_png(RANDOM)) == RANDOM).all()
    assert codecs.size_of(codecs.encode_bmp(RANDOM)) == codecs.size_of(codecs.encode_png(RANDOM)) == (12, 9)
    assert codecs.size_of(b"") is None
    with pytest.raises(ValueError):
        codecs.decode(b"garbage")


def test_record_files(spark, tmp_path):
    rows = [(bytes([i]) * (i + 1) * 40, "raw_u8" if i % 2 else "png", i, 0, None if i % 3 else '{"i": 1}') for i in range(9)]
    df = spark.createDataFrame(rows, "content binary, format string, width int, height int, metadata string").coalesce(1)
    assert records.write_records(df, str(tmp_path), compress=True).first()["samples"] == 9
    back = records.register(spark).read.format("records").option("path", str(tmp_path)).option("payload", "true").option("verify", "true").option("metadata", "true").load()
    got = back.orderBy("sample_id").collect()
    assert [r["content"] for r in got] == [r[0] for r in rows] and [r["metadata_type"] for r in got] == [None if i % 3 else "json" for i in range(9)]
    assert got[0]["width"] is None and back.filter("format = 'png'").count() == 5
    with pytest.raises(ValueError):
        records.raw_view(back)
    assert records.crc16(b"123456789") == 0x4B37


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(f"d/{i}.{'json' if i % 2 else 'txt'}", f"v{i}".encode()) for i in range(10)] + [("x" * 100 + ".txt", b"")], "name string, content binary").coalesce(2)
    archive.write_archives(df, str(tmp_path)).collect()
    back = archive.register(spark).read.format("archive").option("path", str(tmp_path)).load()
    assert back.count() == 11 and back.filter("ext = 'json'").count() == 5
    assert {r["name"]: bytes(r["content"]) for r in back.collect()}["d/3.json"] == b"v3"
    shard_file = sorted(tmp_path.glob("*.tar"))[0]
    cut = tmp_path / "cut.tar"
    cut.write_bytes(shard_file.read_bytes()[:700])
    assert spark.read.format("archive").option("path", str(cut)).load().count() <= 1
    assert store.read_range(str(cut), 690, 100) == shard_file.read_bytes()[690:700]


def test_chain_is_one_pass(spark, sf_dir):
    rows = transforms.rows_from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(20), "vec_id", "embedding")
    both = (transforms.chain(("Resize", 4, 4)) | transforms.chain(("Invert",))).apply(rows)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # the images, and the chain
    assert {(r["h"], r["w"]) for r in both.collect()} == {(4, 4)}


@pytest.mark.parametrize("name, least", [("folder_archive", 3), ("archive_roundtrip", 4)])
def test_shards_grow_with_the_sources(spark, sf_dir, monkeypatch, name, least):
    """As many archives as the files of the sources ask for, and the same rows; a small source keeps the least number."""
    catalog.load()
    written, write = [], archive.write_archives
    monkeypatch.setattr(archive, "write_archives", lambda df, folder: written.append(df.rdd.getNumPartitions()) or write(df, folder))
    want = sorted(catalog.QUERIES[name](spark, sf_dir).collect())
    monkeypatch.setattr(shared, "SHARD_BYTES", 20000)
    assert sorted(catalog.QUERIES[name](spark, sf_dir).collect()) == want
    size = shared.source_bytes(catalog.table(spark, sf_dir, "documents").select("doc_id"))
    assert size >= os.path.getsize(f"{sf_dir}/documents.parquet") and written[0] == least and written[1] >= size // 20000 > least


def test_shards_are_ranges_of_the_key(spark, monkeypatch):
    monkeypatch.setattr(shared, "SHARD_BYTES", 20000)
    parts = shared.sharded(spark.range(0, 20000, 1, 4), "id", 3).rdd.glom().map(lambda p: [r["id"] for r in p]).collect()
    assert len(parts) == 8 and [n for p in parts for n in p] == list(range(20000)) and max(map(len, parts)) < 20000 / 3


def test_small_image_files_share_tasks(spark, tmp_path):
    """Spark takes 32 small files a task; all of them are read, in few tasks. Files of some size stay as Spark deals them."""
    for k in range(400):
        (tmp_path / f"{k}.png").write_bytes(codecs.encode_png(RANDOM))
    got = image_files.scan(spark, str(tmp_path))
    parts = spark.read.format("image").load(str(tmp_path)).rdd.getNumPartitions()
    assert got.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism < parts
    assert got.select("h", "w", "data").distinct().count() == 1 and got.select("path").distinct().count() == 400


def test_large_image_files_stay_apart(spark, tmp_path, monkeypatch):
    for k in range(400):
        (tmp_path / f"{k}.png").write_bytes(codecs.encode_png(RANDOM))
    files = spark.read.format("image").load(str(tmp_path))
    monkeypatch.setattr(image_files, "TASK_BYTES", sum(f.stat().st_size for f in tmp_path.iterdir()) // 400)
    assert image_files.packed(files).rdd.getNumPartitions() == files.rdd.getNumPartitions()
