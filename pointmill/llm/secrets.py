"""Secret scans over an incremental ledger of blobs.

A *path* (a row of the documents table, any number of historical versions of a file) holds a *blob*, the text, addressed by its
SHA-256. The ledger is a folder of Parquet files with one row per blob and rule version that has been scanned, with its findings;
a scan reads only the blobs and rule versions that the ledger does not hold, appends them, and joins the findings back to every
path that holds the blob. Everything runs as DataFrame expressions.

A rule is a regular expression with an optional length test of one of its groups. Matches are leftmost and do not overlap within
a rule; a match that fails the length test is dropped, but what it covers is used up. Spans count code points, end exclusive.

Defined cases: a null text is the empty blob; an empty blob has no findings; a version of rules is a digest of the rules, so other rules scan anew; repeated rows and copies share one blob, which is
scanned once; a null id is a path like any other; an empty table gives an empty result and leaves the ledger as it was; other
columns are not read. A text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_if_null, fresh, materialize, scratch_path


@dataclass(frozen=True)
class Rule:
    """``hints``: lower-case texts of which any match holds one, or none if the rule has no such text; they only save work."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    hints: tuple[str, ...] = ()


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", r"[0-9a-f]{16,}+", 0, 16),
)
#: Formats of credentials that say themselves what they are.
FORMAT_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hints=("eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", hints=("xox",)),
)
RULES = BASE_RULES + FORMAT_RULES
CHUNK = 256
FEW = 2_000_000  # 64-bit hashes that are broadcast, some 32 MB

SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def _spans(text: Column, low: Column, rule: Rule, number: int) -> Column:
    """The spans of a rule in a text: the lengths of the parts between matches and of the matches, summed up.

    ``hints`` keep the regular expression from texts that cannot match.
    """
    parts = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pairs = F.zip_with(
        F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("part"), found.alias("hit")),
        tested,
        lambda p, t: F.struct(F.length(p["part"]).cast("long").alias("gap"), F.length(p["hit"]).cast("long").alias("size"), (F.length(t) >= rule.min_length).alias("ok")),
    )
    none = F.from_json(F.lit("[]"), SPAN)

    def walk(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(
                x["ok"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(number).alias("kind_no"), (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))),
            ).otherwise(acc["spans"]).alias("spans"),
        )

    # A list grows by copying, so matches are walked in chunks, each from the end of the one before.
    def chunked(found: Column) -> Column:
        size = lambda x: x["gap"] + x["size"]
        before = lambda c: F.aggregate(F.slice(found, F.lit(1), c), F.lit(0).cast("long"), lambda acc, x: acc + size(x))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(CHUNK)), lambda c: walk(F.slice(found, c + 1, CHUNK), before(c))))

    walked = F.transform(F.array(pairs), chunked)[0]
    if not rule.hints:
        return F.when(text.rlike(rule.pattern), walked).otherwise(none)
    hinted = F.lit(False)
    for hint in rule.hints:
        hinted = hinted | F.contains(low, F.lit(hint))
    return F.when(hinted, walked).otherwise(none)


def scan_text(text: Column, low: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans in a text, by start, then by the order of the rules. ``low`` is the text in lower case."""
    return F.array_sort(F.concat(*[_spans(text, low, r, i) for i, r in enumerate(rules)]))


def version_of(rules: tuple[Rule, ...]) -> str:
    """The version of a set of rules: a digest of what they are and their order."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.min_length) for r in rules]).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing has been written there."""
    schema = f"blob string, rule_version string, spans {SPAN}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _unseen(docs: DataFrame, ledger_path: str, rule_version: str, id_col: str, text_col: str) -> DataFrame | None:
    """``blob, text`` of the blobs that the ledger does not hold for this rule version, or None if it holds them all.

    For each unseen blob one row is chosen by a hash aggregate over digests alone, which combines copies before the shuffle: the least 64-bit hash of path and
    blob. Where the ledger holds most blobs, the chosen hashes, at most ``FEW`` and checked, are broadcast, so that no text but the unseen ones leaves its task.
    Else most texts have to be scanned anyway and are dealt out by that hash, repeated rows combined first. Either way copies do not meet in one task.
    """
    spark = docs.sparkSession
    text = empty_if_null(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("path"), blob_id(text).alias("blob"), text.alias("text"))
    rows = rows.select(F.xxhash64("path", "blob").alias("key"), "blob", "text")
    known = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).select("blob")
    chosen = materialize(rows.groupBy("blob").agg(F.min("key").alias("key")).join(known, "blob", "left_anti"), "chosen")
    many = chosen.count()
    if not many:
        return None
    if many <= FEW and 10 * many <= known.count():
        rows = rows.join(F.broadcast(chosen.select("key")), "key", "left_semi")
        return rows.groupBy("key", "blob").agg(F.first("text").alias("text")).drop("key")
    rows = rows.groupBy("key", "blob").agg(F.first("text").alias("text"))
    return rows.join(chosen.hint("shuffle_hash"), ["key", "blob"], "left_semi").drop("key")


def scan_unseen(docs: DataFrame, ledger_path: str, *, rules: tuple[Rule, ...] = RULES, rule_version: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scan the blobs of ``docs`` that the ledger does not hold for this rule version and append them to the ledger."""
    rule_version = rule_version or version_of(rules)
    unseen = _unseen(docs, ledger_path, rule_version, id_col, text_col)
    if unseen is not None:
        spans = scan_text(F.col("text"), F.lower("text"), rules)
        unseen.select("blob", F.lit(rule_version).alias("rule_version"), spans.alias("spans")).write.mode("append").parquet(ledger_path)


def findings(docs: DataFrame, ledger_path: str | None = None, *, rules: tuple[Rule, ...] = RULES, rule_version: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what is unseen, then one row per row of ``docs``: ``doc_id, blob, spans``. Without ``ledger_path`` a new ledger is begun in the shared folder."""
    rule_version, ledger_path = rule_version or version_of(rules), ledger_path or scratch_path(docs.sparkSession, "secret-ledger")
    scan_unseen(docs, ledger_path, rules=rules, rule_version=rule_version, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col).alias("doc_id"), blob_id(empty_if_null(text_col)).alias("blob")).join(_held(docs.sparkSession, ledger_path, rule_version), "blob", "left").select("doc_id", "blob", F.coalesce("spans", _no_spans()).alias("spans"))


def _held(spark: SparkSession, ledger_path: str, rule_version: str) -> DataFrame:
    """Blobs with findings, each once: a path that is listed twice may have put its blob into the ledger twice."""
    found = read_ledger(spark, ledger_path).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    # Written first, so that the join to all paths can split a blob that very many of them hold.
    return materialize(found, "findings")


def _no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, ledger_path: str | None = None, *, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, rule_version: str | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``, overlapping spans by one; the same columns. ``length_col`` then holds the new length."""
    spark = docs.sparkSession
    rule_version, ledger_path = rule_version or version_of(rules), ledger_path or scratch_path(spark, "secret-ledger")
    blob, spans = fresh(docs, "blob"), fresh(docs, "spans")
    scan_unseen(docs, ledger_path, rules=rules, rule_version=rule_version, id_col=id_col, text_col=text_col)
    held = _held(spark, ledger_path, rule_version).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        spans,
        begin,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    found = docs.withColumn(blob, blob_id(empty_if_null(text_col))).join(held, blob, "left")
    out = found.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(cut))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(spans).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*docs.columns)
