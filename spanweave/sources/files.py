"""Readers and writers: text trees, JSON lines, page tables, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.text import html_text, title

TEXT_SUFFIXES = ("txt", "md", "rst", "html", "htm", "json", "csv", "xml", "tex", "py", "java", "rs", "go", "c", "h")
DOCUMENT = "external_id string, title string, body string, tags array<string>, metadata map<string,string>"


def read_tree(spark: SparkSession, root: str, suffixes=TEXT_SUFFIXES, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, text, nbytes, sha256) of the UTF-8 text files below a folder; larger, binary and invalid ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= max_bytes)
    named = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    text = F.decode("content", "UTF-8") if not hasattr(F, "try_validate_utf8") else F.try_validate_utf8(F.col("content").cast("string"))
    return named.select("path", text.alias("text"), F.col("length").alias("nbytes"), F.sha2("content", 256).alias("sha256")).filter("text IS NOT NULL AND instr(text, char(0)) = 0")


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT, strict: bool = True) -> DataFrame:
    """Documents from JSON lines; a malformed line fails the read, or is dropped when not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of an HTML page table."""
    t = html_text("html")
    return pages.select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), t.alias("text"))


def as_documents(rows: DataFrame) -> DataFrame:
    """Adds a title taken from each text's first line."""
    return rows.withColumn("title", F.coalesce(title("text"), F.lit("")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): ok, missing, changed or unlisted for the files of a manifest (path, sha256)."""
    m = manifest.select("path", F.col("sha256").alias("want"))
    j = files.select("path", F.col("sha256").alias("have")).join(m, "path", "full_outer")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") == F.col("want"), "ok").otherwise("changed")
    return j.select("path", state.alias("state"))
