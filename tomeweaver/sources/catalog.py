"""Book files and the catalogue of them: listing, reading, the CSV, merging and synchronising."""

from __future__ import annotations

import csv
import io
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import language, metadata
from ..functions.metadata import filename_label
from ..functions.text import word_count
from .corpus import READY

COLUMNS = ["storage_key", "title", "author", "language", "source_url"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
MAX_BYTES, MAX_BOOKS, MIN_WORDS = 25_000_000, 10_000, 10_000


def storage_keys(root: str) -> list[str]:
    """Regular .txt files under a local root, as sorted keys; links are left out, and a missing root is empty."""
    found = []
    for d, subdirs, names in os.walk(root):
        subdirs[:] = [s for s in subdirs if not os.path.islink(os.path.join(d, s))]
        found += [Path(d, n).relative_to(root).as_posix() for n in names if n.endswith(".txt") and os.path.isfile(p := os.path.join(d, n)) and not os.path.islink(p)]
    return sorted(found)


def resolve(root: str, key: str | None) -> Path:
    """The file of a key, refused if the key leaves the root."""
    if not key or not key.strip() or key.startswith("/") or not key.endswith(".txt") or {".", ".."} & set(key.split("/")):
        raise ValueError(f"Invalid storage key: {key}")
    path = Path(root, key).resolve()
    if not path.is_relative_to(Path(root).resolve()) or not path.is_file():
        raise ValueError(f"Invalid storage key: {key}")
    return path


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """storage_key, content, content_bytes, content_sha256, text, valid (UTF-8 and not too long) of the files under a root that Spark reads."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(root)
    ok = (F.col("length") <= max_bytes) & F.is_valid_utf8(F.col("content").cast("string"))
    return f.select(key_of("path", root).alias("storage_key"), "content", F.col("length").alias("content_bytes"), F.sha2("content", 256).alias("content_sha256"), F.when(ok, F.col("content").cast("string")).alias("text"), ok.alias("valid"))


def key_of(path: str, root: str) -> Column:
    """A file's key: its path under the root."""
    return F.regexp_replace(path, "^.*?\\Q" + root.rstrip("/").split(":")[-1].lstrip("/") + "\\E/+", "")


def parse_csv(text: str) -> list[dict[str, str | None]]:
    """Entries of a catalogue, strictly: the exact header, five fields a line, sound quotes, a key and a title, no key twice."""
    # other characters that Python takes for a line's end may stand in a title
    lines = re.split("\r\n|\r|\n", text.removeprefix("\ufeff"))
    if not lines or lines[0].strip() != ",".join(COLUMNS):
        raise ValueError("The catalogue's header is not " + ",".join(COLUMNS))
    out, seen = [], set()
    for n, line in enumerate(lines[1:], 2):
        if not line.strip():
            continue
        try:
            fields = next(csv.reader(io.StringIO(line), strict=True))
        except csv.Error as e:
            raise ValueError(f"Line {n}: {e}") from e
        plain = _outside_quotes(line)
        if '"' in plain or len(fields) != len(COLUMNS):
            raise ValueError(f"Line {n}: malformed")
        entry = {k: v.strip() or None for k, v in zip(COLUMNS, fields, strict=True)}
        if not entry["storage_key"] or not entry["title"] or entry["storage_key"] in seen:
            raise ValueError(f"Line {n}: key or title missing, or key repeated")
        seen.add(entry["storage_key"])
        out.append(entry)
    return out


def _outside_quotes(line: str) -> str:
    """The line's unquoted fields; a quote among them is stray."""
    return re.sub(r'(?:^|(?<=,))"(?:[^"]|"")*"(?=,|$)', "", line)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as a table; empty if there is no file."""
    entries = parse_csv(Path(path).read_text("utf-8")) if os.path.exists(path) else []
    return spark.createDataFrame([tuple(e[c] for c in COLUMNS) for e in entries], SCHEMA)


def render_csv(entries: list[dict[str, str | None]]) -> str:
    def cell(v: str | None) -> str:
        v = (v or "").replace("\r", " ").replace("\n", " ")
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"') or v != v.strip() else v

    return "\n".join([",".join(COLUMNS), *(",".join(cell(e[c]) for c in COLUMNS) for e in entries)]) + "\n"


def write_csv_if_changed(path: str, entries: list[dict[str, str | None]]) -> bool:
    """Writes through a temporary file beside it; False if the file already says so."""
    text = render_csv(entries).encode()
    p = Path(path)
    if p.exists() and p.read_bytes() == text:
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(".part")
    part.write_bytes(text)
    os.replace(part, p)
    return True


def repeated_keys(entries: DataFrame) -> DataFrame:
    return entries.groupBy("storage_key").agg(F.count("*").alias("times")).where("times > 1")


def merged(inferred: DataFrame, previous: DataFrame, limit: int = MAX_BOOKS) -> DataFrame:
    """The new catalogue: what the old one says stays, its blanks are filled, and a title that only names the file gives way."""
    if limit:
        n = inferred.limit(limit + 1).count()
        if n == 0 or n > limit:
            raise ValueError("No books, or too many")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    old = previous.select(*(F.col(c).alias(f"old_{c}") for c in COLUMNS))
    j = inferred.join(old, F.col("storage_key") == F.col("old_storage_key"), "left")
    stated = F.when(blank(F.col("old_title")) != filename_label(F.col("storage_key")), blank(F.col("old_title")))
    return j.select("storage_key", F.coalesce(stated, "title", filename_label(F.col("storage_key"))).alias("title"), *(F.coalesce(blank(F.col(f"old_{c}")), F.col(c)).alias(c) for c in COLUMNS[2:]))


def inferred(files: DataFrame) -> DataFrame:
    """files(storage_key, content) as entries: what each opening says; the language by its name, or else by its words."""
    d = metadata.extract(files.select("storage_key", "content"))
    named = language.with_code(d.select("storage_key", "title", "author", "language_name", "source_url"), "language_name", language.language_codes(files.sparkSession))
    detected = language.detect(d, "storage_key", "opening")
    title = F.coalesce("title", filename_label(F.col("storage_key")))
    return named.join(detected, "storage_key").select("storage_key", title.alias("title"), "author", F.coalesce("language_code", "detected").alias("language"), "source_url")


def generate(spark: SparkSession, root: str, path: str) -> dict[str, int | bool]:
    """Writes the catalogue of the files under a root that Spark reads: a new one, or the old one with its blanks filled and keys of lost files gone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(root)
    entries = merged(inferred(files.select(key_of("path", root).alias("storage_key"), "content")), read_csv(spark, path))
    rows = [r.asDict() for r in entries.orderBy("storage_key").collect()]  # MAX_BOOKS at most, checked by ``merged``
    return {"books": len(rows), "changed": write_csv_if_changed(path, rows)}


def book_rows(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with their files' text, hash, bytes and words; a file that is missing or unreadable, or too short, is an error in ``checked``."""
    f = files.select("storage_key", "content_sha256", "content_bytes", "text", "valid")
    return entries.join(f, "storage_key", "left").withColumn("word_count", word_count(F.col("text"))).withColumn("status", F.lit(READY))


def checked(rows: DataFrame, minimum: int = MIN_WORDS) -> DataFrame:
    """rows as they are, refused if there are none or too many, or if one of them has no sound file of enough words."""
    n = rows.count()
    if n == 0 or n > MAX_BOOKS:
        raise ValueError(f"The catalogue has {n} books; it must have from 1 to {MAX_BOOKS}")
    bad = rows.where(~F.coalesce("valid", F.lit(False)) | (F.col("word_count") < minimum)).orderBy("storage_key").first()
    if bad is not None:
        raise ValueError(f"Book {bad.storage_key} " + (f"has {bad.word_count} words, the least is {minimum}" if bad.valid else "has no readable file"))
    return rows


def migrated(books: DataFrame, path: str = "local_path") -> DataFrame:
    """Books of an older catalogue: the path's last part becomes the key, and only READY books stay."""
    return books.where(F.col("status") == READY).withColumn("storage_key", basename(F.col(path))).drop(path)


FOLLOWED = ["title", "author", "language", "source_url"]
#: Compared too where both tables have them.
COUNTED = ["word_count", "content_bytes"]


def sync_diff(books: DataFrame, catalog: DataFrame, prune: bool = False) -> DataFrame:
    """What a synchronisation does with each key: insert, update, unchanged, delete or keep (left over); dirty if its postings go.

    books and catalog: storage_key, title, author, language, source_url, content_sha256.
    """
    followed = FOLLOWED + [c for c in COUNTED if c in books.columns and c in catalog.columns]
    b = books.select(F.col("storage_key").alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in (*followed, "content_sha256")))
    j = catalog.join(b, F.col("storage_key") == F.col("b_key"), "full_outer")
    text_same = F.col("content_sha256").eqNullSafe(F.col("b_content_sha256"))
    same = text_same
    for c in followed:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    action = F.when(F.col("b_key").isNull(), "insert").when(F.col("storage_key").isNull(), "delete" if prune else "keep").when(same, "unchanged").otherwise("update")
    dirty = (action == "delete") | ((action == "update") & ~text_same)
    return j.select(F.coalesce("storage_key", "b_key").alias("storage_key"), action.alias("action"), dirty.alias("dirty"))


def sync_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count("*").alias("books"), F.count_if("dirty").alias("dirty"))


def synced(books: DataFrame, catalog: DataFrame, diff: DataFrame) -> DataFrame:
    """The books after a synchronisation: kept ones as they are, changed ones under their old id, new ones with ids behind the largest.

    books and catalog hold full rows, catalog without ids; new ids go by key, over MAX_BOOKS rows at most.
    """
    kept = books.join(diff.where(F.col("action").isin("unchanged", "keep")).select("storage_key"), "storage_key", "left_semi")
    ids = books.select("storage_key", "id")
    top = books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_"))  # one row
    changed = catalog.join(diff.where(F.col("action") == "update").select("storage_key"), "storage_key", "left_semi").join(ids, "storage_key")
    new = catalog.join(diff.where(F.col("action") == "insert").select("storage_key"), "storage_key", "left_semi")
    new = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("top_") + F.row_number().over(W.orderBy("storage_key"))).drop("top_")
    return kept.unionByName(changed.select(kept.columns)).unionByName(new.select(kept.columns))


def too_short(rows: DataFrame, minimum: int = MIN_WORDS) -> DataFrame:
    """Rows(…, text) below the least number of words, with word_count."""
    return rows.withColumn("word_count", word_count(F.col("text"))).where(F.col("word_count") < minimum)


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*[/\\\\]", "")


def take_long_texts(texts: DataFrame, n: int = 1664, minimum: int = MIN_WORDS) -> DataFrame:
    """Up to n texts of enough words, for a sample corpus (a limit by purpose)."""
    return texts.where(word_count(F.col("text")) >= minimum).limit(n)
