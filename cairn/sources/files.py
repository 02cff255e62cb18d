"""Text files of a collection's directory as document rows: scan, masks, decoding, frontmatter, title and indexed text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import content_hash
from cairn.operators.filters import glob_regex
from cairn.plans.arrow import by_slice, sliced
from cairn.plans.lineage import cut
from cairn.plans.spread import spread
from cairn.schemas import DEFAULT_PATTERN

# Directories that are never part of a collection.
SKIPPED = ["node_modules", "vendor", "dist", "build", "target", ".cache"]


def split_masks(pattern: str) -> list[str]:
    """Masks between top-level commas; commas inside braces belong to a mask."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(pattern[at:i])
            at = i + 1
    return [p.strip() for p in (*parts, pattern[at:]) if p.strip()]


def include_regexes(pattern: str | None) -> list[str]:
    """Regular expressions of an include mask; ValueError for a bad glob."""
    return [glob_regex(p) for p in split_masks(pattern or DEFAULT_PATTERN)]


def ignore_regexes(patterns: list[str] | None) -> list[str]:
    """Regular expressions of ignore globs; bad ones are left out."""
    out = []
    for p in patterns or []:
        try:
            out.append(glob_regex(p))
        except ValueError:
            continue
    return out


def _any(path: Column, regexes: list[str]) -> Column:
    hit = F.lit(False)
    for r in regexes:
        hit = hit | F.regexp_like(path, F.lit(r))
    return hit


def is_excluded(path: Column, ignore: list[str] | None = None, allow_hidden: bool = False) -> Column:
    """Whether a relative path is left out: a skipped directory, an ignore glob, or, unless allowed, a part that begins with a dot."""
    parts = F.split(path, "/")
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED]))
    hidden = F.lit(False) if allow_hidden else F.exists(parts, lambda p: p.startswith("."))
    return skipped | hidden | _any(path, ignore_regexes(ignore))


def _open(root: str):
    """File system and plain path of ``root``, a path or URI."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/*", "file:///", root)))
    return fs.LocalFileSystem(), root


def listing(spark: SparkSession, root: str, allow_hidden: bool = False) -> DataFrame:
    """path (relative), length and modificationTime of the files below ``root``, level by level and each directory in a task.

    No file is opened. Directories that are never part of a collection, and hidden ones unless allowed, aren't entered. A directory
    that can't be read has no files.
    """
    from pyarrow import fs

    schema = "path string, is_dir boolean, length bigint, modificationTime timestamp"

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            rows = []
            for at in batch.column(0).to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/") or "/"))
                except OSError:
                    continue
                for f in found:
                    if f.type in (fs.FileType.File, fs.FileType.Directory):
                        rows.append((f"{at}/{f.base_name}".lstrip("/"), f.type == fs.FileType.Directory, f.size, f.mtime_ns))
            cols = list(zip(*rows)) or [(), (), (), ()]
            when = pa.array(cols[3], pa.int64()).cast(pa.timestamp("ns")).cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), when], names=["path", "is_dir", "length", "modificationTime"])

    level, files = spark.createDataFrame([("",)], "path string"), []
    while True:
        met = cut(level.mapInArrow(children, schema))
        files.append(met.where(~F.col("is_dir")).drop("is_dir"))
        below = met.where(F.col("is_dir") & ~is_excluded(F.col("path"), None, allow_hidden)).select("path")
        n = below.count()
        if not n:
            return reduce(DataFrame.unionByName, files)
        level = below.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def scan(spark: SparkSession, root: str, pattern: str | None = None, ignore: list[str] | None = None, allow_hidden: bool = False) -> DataFrame:
    """path (relative), length, modificationTime, content (bytes) and error of the files below ``root`` that the mask includes and no rule
    excludes. Only these are read. A file that can't be read has no content and an error: not_found, permission or io."""
    root = root.rstrip("/") or "/"
    if not _exists(root):
        raise FileNotFoundError(root)
    found = listing(spark, root, allow_hidden)
    kept = found.where(_any(F.col("path"), include_regexes(pattern)) & ~is_excluded(F.col("path"), ignore, allow_hidden))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for piece in sliced(batches, 16):
            contents, errors = [], []
            for path in piece.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}", compression=None) as f:
                        contents.append(f.read())
                    errors.append(None)
                except (FileNotFoundError, NotADirectoryError):
                    contents.append(None)
                    errors.append("not_found")
                except OSError as e:
                    contents.append(None)
                    errors.append("permission" if isinstance(e, PermissionError) or getattr(e, "errno", None) in (1, 13) else "io")
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=[*piece.schema.names, "content", "error"])

    return spread(kept).mapInArrow(read, "path string, length bigint, modificationTime timestamp, content binary, error string")


def _exists(root: str) -> bool:
    from pyarrow import fs

    system, base = _open(root)
    return system.get_file_info(base).type != fs.FileType.NotFound


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with raw (text) and skip_reason: the error of reading, not_found where there are no bytes, not_utf8 where they are no text."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    reason = F.coalesce(error, F.when(F.col("content").isNull(), "not_found").when(text.isNull(), "not_utf8"))
    return files.withColumn("skip_reason", reason).withColumn("raw", text).drop("content", "error")


def skip_counts(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def split_frontmatter(raw: str) -> tuple[list[str] | None, str]:
    """Lines between a first line ``---`` and the next such line, and the text after them; None and the text without both."""
    first, _, rest = raw.partition("\n")
    if first.removesuffix("\r") != "---" or not _:
        return None, raw
    lines, at = [], 0
    while at <= len(rest):
        end = rest.find("\n", at)
        line = rest[at : end if end >= 0 else len(rest)]
        if line.rstrip("\r") == "---":
            return lines, rest[end + 1 :] if end >= 0 else ""
        if end < 0:
            return None, raw
        lines.append(line.rstrip("\r"))
        at = end + 1
    return None, raw


def _bare(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def read_frontmatter(lines: list[str]) -> tuple[str | None, list[str]]:
    """Title and the items of tags and aliases: a single value, ``[a, b]``, or ``- item`` lines below the key."""
    title, terms, listing = None, [], False
    for line in lines:
        if not line.strip():
            continue
        if line[0] in " -":
            item = line.strip()
            if listing and item.startswith("-") and (value := _bare(item[1:].strip())):
                terms.append(value)
            continue
        key, colon, value = line.partition(":")
        key, value = key.strip(), value.strip()
        listing = bool(colon) and not value and key in ("tags", "aliases")
        if not colon or not value:
            continue
        if key == "title" and title is None:
            title = _bare(value) or None
        elif key in ("tags", "aliases"):
            items = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") else [value]
            terms += [v for v in (_bare(i.strip()) for i in items) if v]
    return title, terms


_HEADING = re.compile(r"^[ \t]*#+[ \t]*([^#\s].*?)\s*$", re.M)


def prepare_text(raw: str, path: str) -> tuple[str, str]:
    """Title and indexed text of a file: the title from frontmatter, the first heading with text, or the file's name.

    The indexed text is the body without frontmatter, then the tags and aliases on a line.
    """
    front, body = split_frontmatter(raw)
    title, terms = read_frontmatter(front) if front is not None else (None, [])
    if title is None:
        heading = _HEADING.search(body)
        title = heading[1] if heading else path.rsplit("/", 1)[-1].rsplit(".", 1)[0] or path.rsplit("/", 1)[-1]
    return title, body + ("\n" + " ".join(terms) if terms else "")


def prepare(files: DataFrame) -> DataFrame:
    """path, title, text (indexed), raw, hash (of text) and skip_reason of :func:`decoded` files; skipped ones have nulls."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [prepare_text(raw, path) if raw is not None else (None, None) for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["path", "raw", "skip_reason", "title", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_slice(one)(batches)

    made = files.select("path", "raw", "skip_reason").mapInArrow(run, "path string, raw string, skip_reason string, title string, text string")
    return made.withColumn("hash", content_hash(F.col("text")))


def read_collection(spark: SparkSession, name: str, root: str, pattern: str | None = None, ignore: list[str] | None = None, allow_hidden: bool = False) -> DataFrame:
    """:func:`prepare` of a collection's files, with its name as ``collection``."""
    return prepare(decoded(scan(spark, root, pattern, ignore, allow_hidden))).withColumn("collection", F.lit(name))


def total_size(spark: SparkSession, root: str) -> DataFrame:
    """One row: the number of files below ``root`` and their bytes. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("length")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
