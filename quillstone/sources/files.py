"""JSON-lines stages, alias rows, text and binary scans, content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import heading_or_title

# The names a field goes by, in order of preference.
ALIASES = {
    "doc_id": ("doc_id", "id", "slug"), "title": ("title", "name", "heading", "topic"), "text": ("text", "content", "page_content", "desc", "body", "rule_text"), "source": ("source", "source_file"),
}


def alias_rows(lines: DataFrame) -> DataFrame:
    """Canonical rows of JSON lines (value): each field from its first alias; a line that is no JSON, or lacks text or source, fails the job."""
    names = [n for ns in ALIASES.values() for n in ns]
    schema = ", ".join(f"`{n}` string" for n in names) + ", form long"
    row = lines.select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    first = {k: F.coalesce(*[F.nullif(F.trim(F.col("r")[n]), F.lit("")) for n in ns]) for k, ns in ALIASES.items()}
    need = lambda k: F.when(first[k].isNull(), F.raise_error(F.concat(F.lit(f"no {k} in "), F.substring("value", 1, 200)))).otherwise(first[k])
    return row.select(first["doc_id"].alias("doc_id"), heading_or_title(first["title"], first["doc_id"]).alias("title"), need("text").alias("text"), need("source").alias("source"), F.col("r.form").alias("form"))


def write_stage(df: DataFrame, root: str, stage: str) -> None:
    """Append a run's records to a stage; the commit protocol makes it all or nothing."""
    df.write.mode("append").json(f"{root}/staged/{stage}")


def read_stage(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """Records of a stage; a stage that nothing was written to is empty. Broken lines fail the job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/staged/{stage}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/staged/{stage}")


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of .txt and .md files below a folder, whole; bytes that are no UTF-8 become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,markdown}").load(root)
    return rows.select("path", F.col("content").cast("string").alias("text"))


def blobs(rows: DataFrame, column: str) -> DataFrame:
    """Content-addressed store: one row a distinct blob, keyed by its hash."""
    data = F.col(column).cast("binary")
    return rows.select(F.concat(F.lit("sha256:"), F.sha2(data, 256)).alias("key"), data.alias("content")).groupBy("key").agg(F.first("content").alias("content"))


def file_kind(content: str = "content", path: str = "path") -> F.Column:
    """pdf by its first bytes, else by suffix."""
    head = F.substring(F.col(content), 1, 5)
    return F.when(head == F.lit(b"%PDF-"), "pdf").otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
