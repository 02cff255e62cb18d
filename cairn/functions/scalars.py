"""Scalar functions as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.schemas import CHUNK_BYTES, OVERLAP_BYTES, URI_SCHEME


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text, 256)


def docid(hash_: Column) -> Column:
    """The first six hex digits of a content hash."""
    return F.substring(hash_, 1, 6)


def embed_fingerprint(model: str | Column, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Column:
    """Six hex digits that change with the embedding model or the chunker's sizes."""
    name = F.lit(model) if isinstance(model, str) else model
    return docid(F.sha2(F.concat(F.lit("model:"), name, F.lit(f"\nchunk_size_chars:{chunk}\nchunk_overlap_chars:{overlap}")), 256))


def filepath(collection: Column, path: Column) -> Column:
    return F.concat(collection, F.lit("/"), path)


def file_uri(filepath_: Column) -> Column:
    return F.concat(F.lit(URI_SCHEME), filepath_)


def collection_of(filepath_: Column) -> Column:
    """Before the first slash; the whole where there is none."""
    return F.substring_index(filepath_, "/", 1)


def path_of(filepath_: Column) -> Column:
    """After the first slash; empty where there is none."""
    return F.regexp_replace(filepath_, r"^[^/]*/?", "")


def like_literal(text: Column) -> Column:
    """``text`` with backslash, per cent and underscore escaped for LIKE."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def rfc3339(ts: Column) -> Column:
    """UTC text of a timestamp with second precision (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of ``YYYY-MM-DDTHH:MM:SSZ``; null for any other notation."""
    shaped = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"))
    return F.when(shaped, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def time_ago(text: Column, now: Column) -> Column:
    """Age of an RFC-3339 time at ``now``: just now, minutes, hours, days below seven, else its date; unreadable text as it is."""
    at = parse_rfc3339(text)
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    part = lambda unit, name: F.concat(F.floor(age / unit).cast("string"), F.lit(f"{name} ago"))
    return F.when(at.isNull(), text).when(age < 60, F.lit("just now")).when(age < 3600, part(60, "m")).when(age < 86400, part(3600, "h")).when(age < 7 * 86400, part(86400, "d")).otherwise(F.substring(text, 1, 10))


def duration(seconds: Column) -> Column:
    """``12s``, ``3m 4s`` or ``5h 6m``."""
    s = F.round(seconds).cast("bigint")
    text = lambda big, small, a, b: F.concat(F.floor(s / big).cast("string"), F.lit(a + " "), F.floor((s % big) / small).cast("string"), F.lit(b))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, text(60, 1, "m", "s")).otherwise(text(3600, 60, "h", "m"))


def byte_size(n: Column) -> Column:
    """``17 B``, ``1.5 KB``, ``2.0 MB``, ``3.1 GB``."""
    scaled = lambda unit, name: F.format_string("%.1f " + name, n / F.lit(float(unit)))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KB")).when(n < 1 << 30, scaled(1 << 20, "MB")).otherwise(scaled(1 << 30, "GB"))


def score_percent(score: Column) -> Column:
    """Whole per cent, right-aligned to three places."""
    whole = F.round(score * 100).cast("bigint").cast("string")
    return F.concat(F.lpad(whole, F.greatest(F.length(whole), F.lit(3)), F.lit(" ")), F.lit("%"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score.isNotNull(), "low")


def progress_bar(percent: Column, width: int) -> Column:
    full = F.greatest(F.least(F.round(percent / 100 * width).cast("int"), F.lit(width)), F.lit(0))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of ``text`` of at most ``most`` UTF-8 bytes that ends at a character."""
    raw = F.encode(text, "UTF-8")
    cont = lambda k: F.substring(raw, most + 1 - k, 1).between(F.lit(bytearray(b"\x80")), F.lit(bytearray(b"\xbf")))
    end = F.when(~cont(0), most).when(~cont(1), most - 1).when(~cont(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def preview(text: Column, most: int = 60) -> Column:
    """Texts above ``most`` bytes are cut to three bytes less and get an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(cut_bytes(text, most - 3), F.lit("..."))).otherwise(text)


def csv_field(text: Column) -> Column:
    special = F.regexp_like(text, F.lit('[,"\n]'))
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_escape(text: Column) -> Column:
    # The five characters and their entities; the ampersand goes first.
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def highlight(text: Column, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Occurrences of each term of at least three characters wrapped, whatever their case, one term after the other."""
    out = text
    for term in terms:
        if len(term) >= 3:
            out = F.regexp_replace(out, F.lit("(?iu)(\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E)"), F.lit(_literal(before) + "$1" + _literal(after)))
    return out


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def query_terms(query: Column, least_bytes: int = 3) -> Column:
    """Lower-cased parts between white space of at least ``least_bytes`` bytes."""
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: F.octet_length(t) >= least_bytes)


def overlap(text: Column, terms: Column) -> Column:
    """How many of ``terms`` occur in the lower-cased text as substrings; a term counts as often as it is listed."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def ancestors(path: Column) -> Column:
    """Directories above ``path``, nearest first; empty for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def path_hit(filepath_: Column, expected: Column) -> Column:
    """Whether the path, lower-cased, holds ``expected``."""
    return F.contains(F.lower(filepath_), expected)
