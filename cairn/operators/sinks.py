"""Search results as JSON, CSV, Markdown, XML, paths or short text: one text column, ready for a writer.

``results`` has query_id, position, score, docid, file, filepath, title, collection, path, body, best_chunk, best_chunk_pos, and may
have context and query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.chunking import snippets
from cairn.functions.scalars import csv_field, xml_escape

CSV_HEADER = "docid,score,file,title,context,line,snippet"
DOCUMENT_FORMATS = ("cli", "json", "files")


def _ready(results: DataFrame, most: int) -> DataFrame:
    for c in ("context", "query"):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast("string"))
    return snippets(results, most)


def json_rows(results: DataFrame, full: bool = False) -> DataFrame:
    """query_id, position, json: one object a result; context only where there is one."""
    text = F.col("body").alias("body") if full else F.col("snippet").alias("snippet")
    obj = F.struct(F.concat(F.lit("#"), F.col("docid")).alias("docid"), F.round("score", 2).alias("score"), "file", "line", "title", "context", text)
    return _ready(results, 300).select("query_id", "position", F.to_json(obj, {"ignoreNullFields": "true"}).alias("json"))


def json_documents(results: DataFrame, full: bool = False) -> DataFrame:
    """query_id and json: the array of a query's results by position. Results of one query are at most its limit."""
    each = json_rows(results, full).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "json"))).alias("_a"))
    return each.select("query_id", F.concat(F.lit("["), F.array_join(F.transform("_a", lambda x: x.json), ","), F.lit("]")).alias("json"))


def csv_rows(results: DataFrame, full: bool = False) -> DataFrame:
    """query_id, position, csv: a line without its end; the header is :data:`CSV_HEADER`."""
    text = F.col("body") if full else F.col("snippet")
    fields = [F.concat(F.lit("#"), F.col("docid")), F.format_string("%.4f", F.col("score")), csv_field(F.col("file")), csv_field(F.coalesce("title", F.lit(""))), csv_field(F.coalesce("context", F.lit(""))), F.col("line").cast("string"), csv_field(text)]
    return _ready(results, 500).select("query_id", "position", F.concat_ws(",", *fields).alias("csv"))


def markdown_rows(results: DataFrame, full: bool = False) -> DataFrame:
    heading = F.when(F.coalesce("title", F.lit("")) == "", F.col("file")).otherwise(F.col("title"))
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit("**context:** "), F.col("context"), F.lit("\n"))).otherwise("")
    text = F.trim(F.col("body")) if full else F.rtrim(F.col("snippet"))
    block = F.concat(F.lit("---\n# "), heading, F.lit("\n**file:** `"), F.col("file"), F.lit("`\n**docid:** `#"), F.col("docid"), F.lit("`\n"), context, F.lit("\n"), text, F.lit("\n"))
    return _ready(results, 500).select("query_id", "position", block.alias("markdown"))


def xml_rows(results: DataFrame, full: bool = False) -> DataFrame:
    attribute = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f' {name}="'), xml_escape(c), F.lit('"'))).otherwise("")
    text = F.col("body") if full else F.col("snippet")
    block = F.concat(F.lit('<file docid="#'), xml_escape(F.col("docid")), F.lit('" name="'), xml_escape(F.col("file")), F.lit('"'), attribute("title", F.col("title")), attribute("context", F.col("context")), F.lit(">\n"), xml_escape(text), F.lit("\n</file>\n"))
    return _ready(results, 500).select("query_id", "position", block.alias("xml"))


def file_rows(results: DataFrame, collections: DataFrame) -> DataFrame:
    """query_id, position, file: the absolute path of each result; results of unknown collections are left out."""
    roots = collections.select(F.col("name").alias("collection"), F.regexp_replace("path", "/+$", "").alias("_root"))
    return results.join(roots, "collection").select("query_id", "position", F.concat("_root", F.lit("/"), "path").alias("file"))


def tool_text(results: DataFrame) -> DataFrame:
    """query_id, position, text: number, title, content id, address, score and the first four lines of the chunk."""
    lines = F.array_join(F.slice(F.split(F.trim("best_chunk"), "\n"), 1, 4), "\n")
    text = F.format_string("[%d] %s #%s\n%s\nscore %.3f\n%s", F.col("position"), F.coalesce("title", F.lit("")), F.col("docid"), F.col("file"), F.col("score"), lines)
    return results.select("query_id", "position", text.alias("text"))


def has_match(text: Column, terms: Column) -> Column:
    """Whether a term occurs in the text: only then a line number is shown."""
    return F.exists(terms, lambda t: F.contains(F.lower(text), t))


def write_results(results: DataFrame, path: str, kind: str, full: bool = False) -> None:
    """Write results as text files of ``kind``: json, csv, markdown or xml. An empty result writes no lines."""
    make = {"json": json_rows, "csv": csv_rows, "markdown": markdown_rows, "xml": xml_rows}[kind]
    make(results, full).orderBy("query_id", "position").select(kind).write.text(path)


def document_rows(documents: DataFrame, kind: str) -> DataFrame:
    """Whole documents (file, title, body, absolute) as text: cli, json or files. ValueError for other kinds."""
    if kind not in DOCUMENT_FORMATS:
        raise ValueError(f"documents come as {', '.join(DOCUMENT_FORMATS)}, not as {kind}")
    text = {"cli": F.concat(F.col("file"), F.lit("\n"), F.col("body")), "json": F.to_json(F.struct("file", "title", "body")), "files": F.col("absolute")}[kind]
    return documents.select(text.alias("text"))
