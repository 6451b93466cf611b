from pointmill.streaming import voxels


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, i * 0.3, 0.1 * (i % 5), -0.2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    df.where("id < 25").write.parquet(src)
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r["cx"], r["cy"], r["cz"]] = (r["n"], round(r["x"], 9))

    stream = spark.readStream.schema(df.schema).parquet(src)
    q = voxels.watch(voxels.voxel_updates(stream, 1.0), keep, str(tmp_path / "check"))
    try:
        q.processAllAvailable()
        df.where("id >= 25").write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == {(r["cx"], r["cy"], r["cz"]): (r["n"], round(r["x"], 9)) for r in voxels.voxel_updates(df, 1.0).collect()}
