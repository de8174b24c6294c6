import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import linking
from lumenframe.plans.locs import LOCS_SQL
from lumenframe.sources import tables, tiff
from lumenframe.streaming import link as streaming


def fitted(spark, n, first=0):
    rows = [(first + i, float(i), float(i), 1.0, 2.0, 1.0, 0.5, 0.5, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "frame int, xc double, yc double, A_B double, A_G double, A_R double, bg_B double, bg_G double, bg_R double")


def test_store_append_and_read(spark, tmp_path):
    path = f"{tmp_path}/Pos3_locs"
    tables.write_locs(fitted(spark, 5), path, append=True)
    tables.write_locs(fitted(spark, 5).withColumn("frame", F.col("frame").cast("double")), path, append=True, follow=True)
    got = tables.in_frame_order(tables.read_locs(spark, path)).collect()
    assert [r.frame for r in got] == list(range(10)) and got[0].photons == 4.0 and got[0].A_G == 0.5
    assert tables.read_locs(spark, path, first_frame=7).count() == 3
    tables.write_locs(fitted(spark, 2), path)
    assert tables.read_locs(spark, path).count() == 2
    with pytest.raises(Exception, match="would lose decimals"):
        tables.conform(fitted(spark, 2).withColumn("frame", F.lit(0.5)), fitted(spark, 1).schema).collect()
    tables.write_csv(fitted(spark, 3), f"{tmp_path}/csv")
    assert tables.read_csv(spark, f"{tmp_path}/csv", fitted(spark, 1).schema).count() == 3
    assert tables.find_files(spark, str(tmp_path), "part-", ".parquet").count() > 0


def test_metadata(spark, tmp_path):
    meta = {"Summary": {"x": 1}, "FrameKey-0-0-0": {"ROI": "10-20-300-400", "Exposure-ms": 50.0, "z": {"a": 1}}, "FrameKey-1-0-0": {"ROI": "0-0-1-1"}}
    (tmp_path / "Pos1_metadata.txt").write_text(json.dumps(meta, indent=1))
    r = tables.metadata_of(spark, str(tmp_path)).first()
    assert (r.x, r.y, r.width, r.height, r.exposure_ms, r.n_frames, r.fov_name) == (10, 20, 300, 400, 50.0, 2, "Pos1_metadata")
    info = spark.createDataFrame([([{"Width": "1", "Frames": "5"}, {"Width": "2"}],)], "info array<map<string,string>>")
    assert tuple(tables.required(info, "Width", "Frames").first()[1:]) == ("2", "5")
    with pytest.raises(Exception, match="metadata lacks Height"):
        tables.required(info, "Height").collect()


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_tiff_round_trip(spark, tmp_path, bits):
    rng = np.random.default_rng(0)
    stack = [rng.integers(0, 200, (6, 7)).astype(float) for _ in range(5)]
    tiff.write_stack(f"{tmp_path}/a.tif", stack, bits)
    got = tiff.read_tiff(spark, str(tmp_path), frames_per_task=2).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(5)) and all(np.array_equal(np.reshape(r.pixels, (6, 7)), s) for r, s in zip(got, stack))
    assert [r.frame for r in tiff.read_tiff(spark, f"{tmp_path}/a.tif", [1, 3]).collect()] == [1, 3]
    assert tiff.frame_counts(spark, str(tmp_path)).first().n_frames == 5
    hyper = tiff.read_hyperstack(spark, str(tmp_path), 1, 2).orderBy("frame").collect()
    assert [(r.t, r.c) for r in hyper] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    out = tiff.write_tiff(tiff.read_tiff(spark, str(tmp_path)), f"{tmp_path}/out", bits).first()
    assert out.n_frames == 5 and tiff.count_pages(out.path) == 5


def test_damaged_frames_are_skipped(spark, tmp_path):
    tiff.write_stack(f"{tmp_path}/a.tif", [np.ones((4, 4))] * 3)
    data = (tmp_path / "a.tif").read_bytes()
    (tmp_path / "a.tif").write_bytes(data[:-20])
    assert tiff.read_tiff(spark, str(tmp_path)).count() == 2


def test_streamed_links_equal_the_batch(spark, tmp_path):
    events = spark.range(600).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    rows = spark.sql(LOCS_SQL, events=events).where("fov_index = 0")
    batch = {(r.loc_id): r.track_id for r in linking.optimal_links(rows, 0.5, 1, tolerance=0.5).collect()}
    for i, (a, b) in enumerate(((0, 40), (40, 80), (80, 121))):
        rows.where(F.col("frame").between(a, b - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streaming.stream_links(stream, 0.5, 1, tolerance=0.5)
    q = out.writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
        got = {r.loc_id: r.track_id for r in spark.table("links").collect()}
    finally:
        q.stop()
    assert len(got) >= 0.95 * len(batch)
    pairs = {(batch[i], t) for i, t in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).alias("user_id"), F.timestamp_seconds(F.col("id") * 300).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming.tumbling(stream).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {r.start: r.n for r in spark.table("hours").collect()}
    finally:
        q.stop()
    assert got == {r.start: r.n for r in streaming.tumbling(rows).collect()}
    assert streaming.sliding(rows).agg(F.sum("n")).first()[0] == 800
    assert streaming.sessions(rows, "1 hour").agg(F.sum("n")).first()[0] == 200
