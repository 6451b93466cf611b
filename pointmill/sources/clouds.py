"""Point clouds from files, skeletons from and to files.

Text formats are read with ``spark.read.text``, so any file system that Spark knows will do. Rows of one file keep their order by
the place of their block and line: ids are handed out by partition sizes and rows within, without bringing the rows together.
PLY files are a data source of their own (``ply``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import ranked
from . import ply
from .ply import CLOUD

_PLACE = ["__file", "__block"]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line, with the file and block it stands in."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def numbered(rows: DataFrame, name: str = "id") -> DataFrame:
    """Rows made from ``text_lines``, which keep its columns of place, with numbers 0, 1, ... in the order of files, blocks and lines.
    Only the sizes of blocks come together, not the rows."""
    tagged = rows.select("*", F.monotonically_increasing_id().alias("__i"))
    blocks = sorted(tuple(r) for r in tagged.groupBy(*_PLACE).agg(F.min("__i").alias("i"), F.count("*").alias("n")).collect())
    begins, at = [], 0
    for file, block, i, n in blocks:
        begins.append((file, block, at - i))
        at += n
    start = rows.sparkSession.createDataFrame(begins, "__file string, __block long, __shift long")
    return tagged.join(start, _PLACE).select((F.col("__i") + F.col("__shift")).alias(name), *[c for c in rows.columns if c not in _PLACE])


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers, three for each point, wherever lines break. A number left over at the end is an error."""
    lines = text_lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("t"), *_PLACE).where("t[0] <> ''")
    sizes = lines.agg(F.min(F.size("t")).alias("a"), F.max(F.size("t")).alias("b")).first()
    if sizes["a"] is None:
        return spark.createDataFrame([], CLOUD)
    if sizes["a"] == sizes["b"] == 3:
        return numbered(lines.select(*[F.col("t")[i].cast("double").alias(a) for i, a in enumerate("xyz")], *_PLACE))
    tokens = numbered(lines.select(F.explode("t").alias("v"), *_PLACE), "n").select("n", F.col("v").cast("double").alias("v"))
    if tokens.count() % 3:
        raise ValueError("the last point is incomplete")
    return tokens.groupBy(F.floor(F.col("n") / 3).cast("long").alias("id")).agg(*[F.max(F.when(F.col("n") % 3 == i, F.col("v"))).alias(a) for i, a in enumerate("xyz")])


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of an OBJ file."""
    t = F.split(F.trim("value"), r"\s+")
    return numbered(text_lines(spark, path).where(F.col("value").rlike(r"^\s*v\s")).select(*[t[i + 1].cast("double").alias(a) for i, a in enumerate("xyz")], *_PLACE))


def read_off(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of an OFF file, as single precision."""
    rows = numbered(text_lines(spark, path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v"), *_PLACE).where("v <> ''"), "n")
    head = rows.where("n < 2").orderBy("n").collect()
    first = head[0]["v"].removeprefix("OFF").split()
    begin, counts = (1, first) if first else (2, head[1]["v"].split())
    t = F.split("v", r"\s+")
    return rows.where((F.col("n") >= begin) & (F.col("n") < begin + int(counts[0]))).select((F.col("n") - begin).alias("id"), *[t[i].cast("float").cast("double").alias(a) for i, a in enumerate("xyz")])


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of PLY files, as single precision; binary files are read in parts."""
    ply.register(spark)
    return spark.read.format("ply").load(path)


def fingerprint(spark: SparkSession, path: str, *, digits: int = 7) -> DataFrame:
    """``path, md5``: the first digits of each file's MD5."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.md5("content"), 1, digits).alias("md5"))


def load_cloud(spark: SparkSession, path: str) -> DataFrame:
    """A cloud by its suffix: txt, xyz, off, ply, obj or parquet."""
    readers = {"txt": read_xyz, "xyz": read_xyz, "off": read_off, "ply": read_ply, "obj": read_obj, "parquet": lambda s, p: s.read.parquet(p)}
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in readers:
        raise ValueError(f"unsupported cloud format: {path}")
    return readers[suffix](spark, path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(text_lines(spark, path).select(F.trim("value").alias("v"), *_PLACE), "n").withColumn("t", F.split("v", r"\s+"))


def _weighted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = nodes.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    w = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return j.select("src", "dst", F.when(w.isNull(), F.raise_error(F.lit("an edge names an unknown node"))).otherwise(w).alias("weight"))


def read_skelz(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node_id, x, y, z`` and edges ``src, dst, weight``: a header, rows ``id x y z`` up to a row with fewer parts, five lines
    that are passed over, rows ``a b``."""
    rows = _lines(spark, path)
    end = rows.where("n > 0 and size(t) < 4").agg(F.min("n")).first()[0]
    nodes = rows.where((F.col("n") > 0) & (F.col("n") < end)).select(F.col("t")[0].try_cast("int").alias("node_id"), *[F.col("t")[i + 1].try_cast("double").alias(a) for i, a in enumerate("xyz")])
    edges = rows.where((F.col("n") > end + 5) & (F.size("t") >= 2)).select(F.col("t")[0].try_cast("int").alias("src"), F.col("t")[1].try_cast("int").alias("dst"))
    return nodes, _weighted(nodes, edges)


def read_cg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file whose first line holds ``NV:n`` and ``NE:m``; rows ``v x y z`` are numbered from 1, then rows ``e a b``."""
    rows = _lines(spark, path)
    head = rows.where("n = 0").first()["v"]
    nv, ne = (int(next(w for w in head.replace(":", ": ").split(key)[1].split() if w.strip(":").isdigit())) for key in ("NV", "NE"))
    nodes = rows.where((F.col("n") >= 1) & (F.col("n") <= nv)).select(F.col("n").cast("int").alias("node_id"), *[F.col("t")[i + 1].try_cast("double").alias(a) for i, a in enumerate("xyz")])
    edges = rows.where((F.col("n") > nv) & (F.col("n") <= nv + ne)).select(F.col("t")[1].try_cast("int").alias("src"), F.col("t")[2].try_cast("int").alias("dst"))
    return nodes, _weighted(nodes, edges)


def load_skeleton(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    readers = {"skelz": read_skelz, "cg": read_cg}
    suffix = path.rpartition(".")[2].lower()
    if suffix not in readers:
        raise ValueError(f"unsupported skeleton format: {path}")
    return readers[suffix](spark, path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that may hold comments."""
    return spark.read.option("allowComments", True).option("multiLine", True).json(path)


def _fixed(*cols: Column) -> Column:
    return F.format_string(" ".join(["%.4f"] * len(cols)), *cols)


def points_text(points: DataFrame) -> DataFrame:
    """``line, value``: one line for each point, four digits."""
    return points.select(F.col("id").alias("line"), _fixed(F.col("x"), F.col("y"), F.col("z")).alias("value"))


def skeleton_obj(nodes: DataFrame, edges: DataFrame, comment: str = "skeleton") -> DataFrame:
    """``line, value``: an OBJ document with nodes renumbered from 1 in the order of their ids and every undirected edge in both directions."""
    no = ranked(nodes.withColumn("__v", F.col("node_id").cast("double")), "__v", "node_id").drop("__v").withColumnRenamed("rank", "no")
    a, b = no.select(F.col("node_id").alias("src"), F.col("no").alias("i")), no.select(F.col("node_id").alias("dst"), F.col("no").alias("j"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().join(a, "src").join(b, "dst")
    head = nodes.sparkSession.range(1).select(F.struct(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("line"), F.lit(f"# {comment}").alias("value"))
    v = no.select(F.struct(F.lit(1), F.col("no"), F.lit(0).cast("long")).alias("line"), F.concat(F.lit("v "), _fixed(F.col("x"), F.col("y"), F.col("z"))).alias("value"))
    l = both.select(F.struct(F.lit(2), F.col("i"), F.col("j")).alias("line"), F.format_string("l %d %d", "i", "j").alias("value"))
    return head.union(v).union(l)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in their order; part files follow each other."""
    lines.orderBy("line").select("value").write.mode("overwrite").text(path)
