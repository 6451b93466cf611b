"""Readers and writers."""

import struct

import pytest
from pyspark.sql import functions as F

from pointmill.plans import pipelines
from pointmill.sources import clouds, ply


def rows(df):
    return sorted((r["id"], r["x"], r["y"], r["z"]) for r in df.collect())


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3\n4 5\n6\n")
    assert rows(clouds.load_cloud(spark, str(tmp_path / "a.txt"))) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    (tmp_path / "b.txt").write_text("1 2 3\n4 5\n")
    with pytest.raises(ValueError):
        clouds.load_cloud(spark, str(tmp_path / "b.txt"))
    (tmp_path / "c.obj").write_text("# c\nv 1 2 3\nvn 0 0 1\nv 4 5 6\nf 1 2 1\n")
    assert rows(clouds.load_cloud(spark, str(tmp_path / "c.obj"))) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    (tmp_path / "d.off").write_text("OFF\n2 0 0\n1 2 0.5\n4 5 6\n")
    assert rows(clouds.load_cloud(spark, str(tmp_path / "d.off"))) == [(0, 1.0, 2.0, 0.5), (1, 4.0, 5.0, 6.0)]
    with pytest.raises(ValueError):
        clouds.load_cloud(spark, str(tmp_path / "e.skel"))


def test_ply(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.format("ascii").encode() + b"1 2 0.5 7\n4 5 6 8\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + struct.pack("<fffBfffB", 1, 2, 0.5, 7, 4, 5, 6, 8))
    for name in ("a.ply", "b.ply"):
        assert rows(clouds.load_cloud(spark, str(tmp_path / name))) == [(0, 1.0, 2.0, 0.5), (1, 4.0, 5.0, 6.0)]


def test_ply_in_parts(spark, tmp_path):
    """Ranges of a binary file, several files, big-endian doubles, numbers cut between reads of an ascii file, and what must raise."""
    head = "ply\nformat {} 1.0\nelement vertex {}\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    folder = tmp_path / "many"
    folder.mkdir()
    body = b"".join(struct.pack(">dddB", i, i + 0.25, -i, 1) for i in range(1000))
    (folder / "a.ply").write_bytes(head.format("binary_big_endian", 1000).encode() + body + b"\x01\x00\x00\x00\x00")
    (folder / "b.ply").write_text(head.format("ascii", 70_000) + "".join(f"{i} {i + 0.5}\n{-i} 3 " for i in range(70_000)) + "\n1 0")
    (folder / "c.ply").write_text(head.format("ascii", 0))
    ply.register(spark)
    df = spark.read.format("ply").option("part_bytes", 2500).load(str(folder))
    assert df.rdd.getNumPartitions() == 11
    got = rows(df)
    assert got == [(i, float(i), i + 0.25, float(-i)) for i in range(1000)] + [(1000 + i, float(i), i + 0.5, float(-i)) for i in range(70_000)]
    assert len(rows(spark.read.format("ply").load(f"file://{folder}/a*.ply"))) == 1000 and rows(clouds.load_cloud(spark, str(folder / "c.ply"))) == []
    (folder / "a.ply").write_bytes(head.format("binary_big_endian", 1000).encode() + body[:-30])
    (tmp_path / "list.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n1 1")
    for bad in (folder / "a.ply", tmp_path / "list.ply", tmp_path / "none.ply"):
        with pytest.raises(Exception, match="ends before|lists are not|none.ply"):
            clouds.load_cloud(spark, str(bad)).collect()


def test_ply_written(spark, tmp_path):
    ply.register(spark)
    points = spark.range(0, 1000, 1, 3).selectExpr("cast(id as double) as x", "id / 4 as y", "-1.0D as z")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        points.write.format("ply").option("file_rows", 100).mode(mode).save(str(tmp_path / "out"))
        back = rows(spark.read.format("ply").load(str(tmp_path / "out")))
        assert [r[0] for r in back] == list(range(1000 * times)) and sorted(r[1:] for r in back) == sorted([(float(i), i / 4, -1.0) for i in range(1000)] * times)
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    points.limit(0).write.format("ply").mode("append").save(str(tmp_path / "empty"))
    assert (tmp_path / "empty").is_dir()


def test_skeleton_formats(spark, tmp_path):
    (tmp_path / "a.skelz").write_text("head\n0 0 0 0\n1 3 4 0\nend\n1\n2\n3\n4\n5\n0 1\n")
    nodes, edges = clouds.load_skeleton(spark, str(tmp_path / "a.skelz"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [(0, 1, 5.0)]
    (tmp_path / "b.cg").write_text("# D:3 NV:2 NE:1\nv 0 0 0\nv 3 4 0\ne 1 2\n")
    nodes, edges = clouds.load_skeleton(spark, str(tmp_path / "b.cg"))
    assert sorted(r["node_id"] for r in nodes.collect()) == [1, 2] and [tuple(r) for r in edges.collect()] == [(1, 2, 5.0)]


def test_fingerprint_and_config(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3\n")
    import hashlib

    assert clouds.fingerprint(spark, str(tmp_path / "a.txt")).first()["md5"] == hashlib.md5(b"1 2 3\n").hexdigest()[:7]
    (tmp_path / "c.json").write_text('{ // note\n"rootRadius": 0.18 }')
    assert clouds.read_config(spark, str(tmp_path / "c.json")).first()["rootRadius"] == 0.18


def test_results_and_parameters_are_kept(spark, tmp_path):
    """A chain runs once for the same contents and parameters; parameters come back as they were, former ones stay."""
    ran = []

    def points_of(points, params):
        ran.append(params.sample_num)
        return points.where(F.col("x") < params.sample_num)

    (tmp_path / "a.txt").write_text("1 2 3\n400 5 6\n")
    (tmp_path / "b.txt").write_text("1 2 3\n400 5 6\n")
    keep = str(tmp_path / "kept")
    small, large = pipelines.KnnContractionParams(sample_num=60), pipelines.KnnContractionParams(sample_num=600)
    for name, params, n in (("a", small, 1), ("a", small, 1), ("b", small, 1), ("a", large, 2), ("b", large, 2)):
        assert pipelines.from_file(spark, str(tmp_path / f"{name}.txt"), keep, params, chain=points_of).count() == n
    assert ran == [60, 600]
    (tmp_path / "b.txt").write_text("1 2 3\n")
    assert pipelines.from_file(spark, str(tmp_path / "b.txt"), keep, large, chain=points_of).count() == 1 and len(ran) == 3
    assert pipelines.clear_cache(spark, keep) and not pipelines.clear_cache(spark, keep)
    pipelines.from_file(spark, str(tmp_path / "a.txt"), keep, small, chain=points_of)
    assert len(ran) == 4
    at = str(tmp_path / "params.json")
    pipelines.save_params(spark, at, small)
    pipelines.save_params(spark, at, large)
    assert pipelines.load_params(spark, at) == large
    kept = [f for f in tmp_path.iterdir() if f.name.endswith(".bak")]
    assert len(kept) == 1 and pipelines.load_params(spark, str(kept[0])) == small
