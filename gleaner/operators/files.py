"""Files and folders by their metadata (path and size): kinds, what is skipped, collections, candidates of a workspace, raw parts.

Defined cases: null paths are left out; a path without an ending is text; sizes that are null count 0; of equal names the
smaller path comes first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import STRUCTURED, TYPES

#: Folders and files that are no content, endings that are read, sizes from which reading pays, files of a collection.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".pytest_cache", ".ruff_cache", "memory", "sessions", "bootstrap", "skills")
SKIPPED_FILES = ("AGENTS.md", "BOOTSTRAP.md", "HEARTBEAT.md", "IDENTITY.md", "SOUL.md", "TOOLS.md", "USER.md")
READ = ("csv", "tsv", "xlsx", "json", "yaml", "yml", "xml", "pdf", "txt", "md", "markdown", "rst", "log", "py", "sh", "toml", "ini", "cfg", "conf", "html", "htm")
LARGE_STRUCTURED, LARGE, LARGE_FILES = 1_024, 4_096, 3
CANDIDATES, RAW_CHARS, RAW_LINES = 24, 50_000, 200


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ending_of(path: Column) -> Column:
    name = name_of(path)
    return F.lower(F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1)).otherwise(""))


def detected(files: DataFrame, large_bytes: int | None = None) -> DataFrame:
    """files (path, size) with type, ending, structured, supported and large."""
    ending = ending_of(F.col("path"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), ending), ending)
    structured = kind.isin(*STRUCTURED)
    readme = F.lower(name_of(F.col("path"))).startswith("readme")
    least = F.lit(large_bytes) if large_bytes is not None else F.when(structured, LARGE_STRUCTURED).otherwise(LARGE)
    size = F.coalesce("size", F.lit(0))
    return files.where("path is not null").withColumns({"type": kind, "ending": ending, "structured": structured, "supported": ending.isin(*READ) | readme, "large": size >= least})


def content(files: DataFrame, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """Files below root that are content: no skipped folder above them, no skipped name, an ending that is read or a readme."""
    base = root.rstrip("/") + "/"
    below = F.substring("path", len(base) + 1, 1 << 30)
    folders = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    name = name_of(F.col("path"))
    fine = ending_of(F.col("path")).isin(*READ, "eml") | F.lower(name).startswith("readme")
    return files.where(F.col("path").startswith(base) & fine & ~name.isin(*SKIPPED_FILES) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skipped])))


def folders(files: DataFrame, root: str) -> DataFrame:
    """folder, n_files, n_bytes, large of each folder directly below root, of its content."""
    base = root.rstrip("/") + "/"
    at = F.regexp_extract(F.substring("path", len(base) + 1, 1 << 30), "^([^/]+)/", 1)
    out = content(files, root).withColumn("folder", at).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
    return out.withColumn("large", (F.col("n_files") >= LARGE_FILES) | (F.col("n_bytes") >= LARGE))


def candidates(files: DataFrame, root: str, most: int = CANDIDATES) -> DataFrame:
    """place, name, is_folder: what lies directly in a workspace, by lowered name, hidden names and caches left out."""
    base = root.rstrip("/") + "/"
    below = F.substring("path", len(base) + 1, 1 << 30)
    name = F.regexp_extract(below, "^[^/]+", 0)
    own = files.where(F.col("path").startswith(base)).groupBy(name.alias("name")).agg(F.max(below.contains("/")).alias("is_folder"))
    own = own.where(~F.col("name").startswith(".") & ~F.col("name").isin("node_modules", "__pycache__") & (F.col("name") != "")).orderBy(F.lower("name"), "name").limit(most)
    return own.select(F.row_number().over(W.orderBy(F.lower("name"), "name")).alias("place"), "name", "is_folder")  # `most` rows


def raw_range(text: Column, start: int = 0, end: int = RAW_CHARS) -> Column:
    return F.substring(text, max(0, start) + 1, max(0, end - max(0, start)))


def raw_lines(docs: DataFrame, selector: str, id_col: str = "doc_id", text_col: str = "text", most: int = RAW_LINES) -> DataFrame:
    """id, line (from 1), text of the first `most` lines of a text that hold the selector in either case."""
    hits = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: F.lower(x["text"]).contains(selector.lower()))
    return docs.select(id_col, F.explode(F.slice(hits, 1, most)).alias("h")).select(id_col, "h.line", "h.text")
