"""Choosing documents: scope, content ids, needles, globs, path prefixes, and lookups. ``documents`` has doc_id, collection,
path, hash and active; a null ``active`` means true. Lists of names or patterns come from a caller's request and are small."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import filepath
from cairn.schemas import URI_SCHEME


def is_active() -> Column:
    return F.coalesce(F.col("active"), F.lit(True))


def active(documents: DataFrame) -> DataFrame:
    return documents.where(is_active())


def in_collections(documents: DataFrame, names: list[str] | None) -> DataFrame:
    """Documents of the named collections; no or an empty list means all."""
    return documents.where(F.col("collection").isin(names)) if names else documents


def default_scope(documents: DataFrame, collections: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Documents in scope: the named collections, else those included by default.

    A null include flag counts as included. Without any collection in the catalog nothing is filtered; a catalog in which none is
    included leaves nothing. Stays one plan: the catalog is a side of a join, not a question to the driver.
    """
    if names:
        return in_collections(documents, names)
    state = collections.agg(F.count(F.lit(1)).alias("_all"))
    included = collections.where(F.coalesce(F.col("include_by_default"), F.lit(True))).select(F.col("name").alias("collection")).distinct()
    marked = documents.join(included.withColumn("_in", F.lit(True)), "collection", "left").crossJoin(F.broadcast(state))  # one row
    return marked.where(F.col("_in") | (F.col("_all") == 0)).select(*documents.columns)


def by_docid(documents: DataFrame, prefixes: list[str]) -> DataFrame:
    """For each prefix of a content hash the first active document by (collection, path), with the prefix as ``docid``.

    A leading ``#`` is dropped; letters match literally, in their case; any length goes. Prefixes without a document give no row.
    """
    asked = [p.lstrip("#") for p in prefixes]
    if not asked:
        return documents.limit(0).withColumn("docid", F.lit(None).cast("string"))
    matched = F.filter(F.array(*[F.lit(p) for p in asked]), lambda p: F.startswith(F.col("hash"), p))
    found = active(documents).withColumn("_p", F.array_distinct(matched)).withColumn("docid", F.explode("_p")).drop("_p")
    order = Window.partitionBy("docid").orderBy("collection", "path")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def by_needles(documents: DataFrame, needles: list[str], names: list[str] | None = None) -> DataFrame:
    """Active documents whose path or collection/path is a needle or ends with ``/`` and a needle; case and wildcards are literal."""
    if not needles:
        return documents.limit(0)
    full = filepath(F.col("collection"), F.col("path"))
    tails = [F.concat(F.lit("/"), c).endswith("/" + n) for n in needles for c in (F.col("path"), full)]
    return in_collections(active(documents), names).where(reduce(lambda a, b: a | b, tails))


def glob_regex(pattern: str, star_crosses: bool = True) -> str:
    """A regular expression for a glob: ``*``, ``**``, ``?``, ``[..]``, ``[!..]`` and ``{a,b}``. Unfinished ones are errors.

    ``star_crosses`` lets a single star cross a slash. ``**/`` also stands for no directory.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] in "/{,"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            double = pattern.startswith("**", i)
            out.append(".*" if double or star_crosses else "[^/]*")
            i += 1 + double
            continue
        if c == "?":
            out.append("." if star_crosses else "[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unfinished set in glob: {pattern}")
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}":
            if not depth:
                raise ValueError(f"unopened brace in glob: {pattern}")
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unfinished brace in glob: {pattern}")
    return "(?s)^" + "".join(out) + "$"


def by_glob(documents: DataFrame, pattern: str, names: list[str] | None = None) -> DataFrame:
    """Active documents whose collection/path matches as a whole; a star crosses slashes."""
    full = filepath(F.col("collection"), F.col("path"))
    return in_collections(active(documents), names).where(F.regexp_like(full, F.lit(glob_regex(pattern))))


def multi_get(documents: DataFrame, request: str, names: list[str] | None = None) -> DataFrame:
    """Documents of a comma-separated request: ``#hex`` is a content id, a part with a star a glob, any other a needle.

    A leading URI scheme is dropped. Each document comes once, by (collection, path).
    """
    parts = [p.strip().removeprefix(URI_SCHEME) for p in request.split(",") if p.strip()]
    ids, globs = [p for p in parts if p.startswith("#")], [p for p in parts if "*" in p and not p.startswith("#")]
    rest = [p for p in parts if p not in ids and p not in globs]
    found = by_needles(documents, rest, names)
    found = found.unionByName(in_collections(by_docid(documents, ids), names).drop("docid"))
    for g in globs:
        found = found.unionByName(by_glob(documents, g, names))
    return found.dropDuplicates(["doc_id"]).orderBy("collection", "path")


def list_paths(documents: DataFrame, spec: str | None = None) -> DataFrame:
    """Active documents below ``collection`` or ``collection/prefix``, by (collection, path); all without a spec."""
    if not spec:
        return active(documents).orderBy("collection", "path")
    collection, _, prefix = spec.removeprefix(URI_SCHEME).partition("/")
    return active(documents).where((F.col("collection") == collection) & F.col("path").startswith(prefix)).orderBy("collection", "path")


def parse_spec(spec: str) -> dict[str, str | int | None]:
    """docid, or collection and path, and a line range ``:from[:count]`` at the end of a path. ValueError if it is neither."""
    text = spec.removeprefix(URI_SCHEME)
    if text.startswith("#"):
        return {"docid": text[1:], "collection": None, "path": None, "from": None, "count": None}
    m = re.fullmatch(r"(.*?)(?::(\d+)(?::(\d+))?)?", text, re.S)
    collection, slash, path = m[1].partition("/")
    if not slash or not collection or not path:
        raise ValueError(f"neither a content id nor collection/path: {spec}")
    return {"docid": None, "collection": collection, "path": path, "from": int(m[2]) if m[2] else None, "count": int(m[3]) if m[3] else None}


def at_filepath(documents: DataFrame, collection: str, path: str) -> DataFrame:
    """The document at collection/path, active or not."""
    return documents.where((F.col("collection") == collection) & (F.col("path") == path))


def at_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the ids in column doc_id, active or not."""
    return documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def content_at(content: DataFrame, hashes: DataFrame) -> DataFrame:
    return content.join(hashes.select("hash").distinct(), "hash", "left_semi")


def with_body(documents: DataFrame, content: DataFrame) -> DataFrame:
    """Documents with ``body``, their raw text; empty where content lacks it."""
    bodies = content.select(F.col("hash").alias("_h"), F.col("doc").alias("_doc"))
    return documents.join(bodies, F.col("hash") == F.col("_h"), "left").withColumn("body", F.coalesce("_doc", F.lit(""))).drop("_h", "_doc")


def numbered_lines(body: Column, first: Column | int = 1, count: Column | int | None = None) -> Column:
    """Lines of ``body`` from line ``first`` (at least 1), at most ``count`` of them, each with its number; null for null."""
    lines = F.split(F.regexp_replace(body, r"\n\z", ""), "\r?\n")
    first = F.greatest(F.lit(first) if isinstance(first, int) else first, F.lit(1))
    left = F.greatest(F.size(lines) - first + 1, F.lit(0))
    n = left if count is None else F.least(left, F.lit(count) if isinstance(count, int) else count)
    return F.array_join(F.transform(F.slice(lines, first, n), lambda line, i: F.format_string("%4d: %s", i + first, line)), "\n")


def capped(df: DataFrame, most: int | None, order: list[str]) -> DataFrame:
    """The first ``most`` rows by ``order`` (all without a number), each with ``total``, the number of rows before the cap."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    kept = df.orderBy(*order)
    return (kept if most is None else kept.limit(most)).crossJoin(F.broadcast(total))  # one row
