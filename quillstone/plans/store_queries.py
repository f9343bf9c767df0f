"""Queries over mixed files, nested masks and the session store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..operators.masking import Mask, masked
from ..shared import shared_dir
from ..sources.mixed import MixedFiles
from ..sources.versioned import SessionStore


def write_files(rows: DataFrame, root: str) -> None:
    """Write (name, content binary) as a file each below ``root``; a task that runs again writes the same files anew."""
    uri = root if "://" in root else root.replace("file:", "file://", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                fs.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query("""SELECT 'html' AS kind, page_id AS id, strlen(coalesce(html, '')) AS n_bytes, NULL AS text_sha256 FROM pages
UNION ALL SELECT CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'json' ELSE 'jsonl' END, doc_id, CASE doc_id % 3 WHEN 0 THEN strlen(coalesce(text, '')) END, sha256(CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') ELSE trim(coalesce(text, ''), E' \\t\\n\\r\\x0b\\x0c') END) FROM documents""")
def mixed_files_read(t: Tables) -> DataFrame:
    """Pages as HTML files, documents as text files, JSON files and JSON lines, read back as one folder."""
    root = f"{shared_dir(t.spark)}/mixed-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    kind = F.coalesce(F.col("doc_id") % 3, F.lit(2))
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("title"), text.alias("text")))
    # an id may be there twice, so a file goes by its row too; a task that runs again numbers its rows as before
    name = lambda kind, id_, suffix: F.concat(F.lit(f"{kind}/"), F.coalesce(F.col(id_).cast("string"), F.lit("null")), F.lit("_"), F.monotonically_increasing_id(), F.lit(f".{suffix}")).alias("name")
    files = t.pages.select(name("html", "page_id", "html"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    files = files.unionByName(t.documents.filter(kind == 0).select(name("text", "doc_id", "md"), text.cast("binary").alias("content")))
    files = files.unionByName(t.documents.filter(kind == 1).select(name("json", "doc_id", "json"), record.cast("binary").alias("content")))
    write_files(files, root)
    t.documents.filter(~kind.isin(0, 1)).select(record).write.text(f"{root}/lines")
    t.spark.dataSource.register(MixedFiles)
    read = t.spark.read.format("mixed_files").option("path", root).option("bytes", str(1 << 20)).load()
    read = read.filter(~(F.col("path").rlike("/lines/[^/]+$") & (F.col("n_bytes") == 0)))  # Spark writes a part file for its first task even where that has no rows
    sound = F.when(F.col("error").isNull(), F.col("kind")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")))
    html = F.col("kind") == "html"
    id_ = F.when(html | (F.col("kind") == "text"), F.regexp_extract("path", r"(-?\d+|null)_\d+\.\w+$", 1).try_cast("long")).otherwise(F.expr("try_cast(title AS long)"))
    size = F.when(html | (F.col("kind") == "text"), F.col("n_bytes"))
    return read.select(sound.alias("kind"), id_.alias("id"), size.alias("n_bytes"), F.when(~html, F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"))


@query("""SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 OR role = CASE conv_id % 2 WHEN 0 THEN 'user' ELSE 'assistant' END THEN text ELSE 'hidden' END AS text,
 CASE WHEN conv_id % 5 = 0 THEN 'length ' || length(text) END AS note FROM conversations""")
def nested_view(t: Tables) -> DataFrame:
    """Conversations as nested rows, seen by one of their speakers or, some, by the one who leads them."""
    nested = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # a conversation
    noted = F.transform("turns", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), F.create_map(F.lit("all"), F.concat(F.lit("length "), F.char_length(x["text"]).cast("string"))).alias("notes")))
    nested = nested.select("conv_id", noted.alias("turns"))
    k = F.col("conv_id")
    masks = [Mask("turns[].text", ("leader",), "role", "hidden"), Mask("turns[].notes{}", ("leader",))]
    seen = masked(nested, masks, F.when(k % 5 == 0, "leader").otherwise("speaker"), F.when(k % 2 == 0, "user").otherwise("assistant"))
    return seen.select("conv_id", F.inline("turns")).select("conv_id", "turn", "role", "text", F.col("notes")["all"].alias("note"))


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT k AS session_id, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 2 = 0 THEN 3 ELSE 2 END AS revision, n || CASE WHEN k % 3 = 0 THEN '' WHEN k % 2 = 0 THEN '++' ELSE '+' END AS payload FROM a""")
def session_store(t: Tables) -> DataFrame:
    """Sessions after three saves through the store: all new ones, then attempts of which some expect what is stored no more."""
    store, k = SessionStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}"), F.col("c_custkey")
    attempt = lambda expected, more: t.customer.select(k.alias("session_id"), expected.cast("long").alias("expected"), F.concat("c_name", F.lit(more)).alias("payload"))
    store.save(attempt(F.lit(0), ""))
    store.save(attempt(F.when(k % 3 == 0, 7).otherwise(1), "+"))
    store.save(attempt(F.when(k % 2 == 0, 2).otherwise(1), "++").filter(k % 3 != 0))
    return store.sessions().select("session_id", "revision", "payload")
