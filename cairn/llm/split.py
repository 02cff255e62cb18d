"""Cutting oversized texts at natural boundaries with overlap, by regular expressions and array functions.

The text's UTF-8 bytes are read as Latin-1, so that a character of the pattern is a byte and counts are byte offsets. Pieces
overlap, matches can't; so the matches are the stretches between consecutive cuts. A piece that follows a cut at ``e`` starts
at ``e - overlap``, moved back to a character boundary by 0 to 3 bytes; a lookbehind at that distance tells how far, and thus
which bounds the stretch has. Within the bounds alternatives stand in order of boundary strength; a greedy quantifier takes
the largest offset, and the last alternative takes any character boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.spread import spread

LIMIT, OVERLAP = 3600, 540
_CONT = r"[\x80-\xBF]"
#: A closed block between two lines starting with three backticks, or a line.
_BLOCK_OR_LINE = r"(?s)(?<![^\n])```[^\n]*\n(?:.*?\n)??```[^\n]*\n?|[^\n]*\n|[^\n]+\z"


def _stretch(least: int, most: int) -> str:
    """Alternatives consuming ``least`` to ``most`` bytes; a rest of up to ``most`` bytes is taken whole."""
    some = f".{{{least},{most}}}"
    return rf"(?:.{{1,{most}}}\z|{some}(?<=\n)(?=#{{1,6}} )|{some}(?<=\n\n)|{some}(?<=\n)|{some}(?<= )|{some}(?!{_CONT}))"


def _pattern(limit: int, overlap: int) -> str:
    first = r"\A" + _stretch(limit // 2 + 1, limit)
    # bytes back from the cut at which the next piece would start; shift = continuation bytes there
    later = []
    for shift in (3, 2, 1, 0):
        behind = "".join(rf"(?<={_CONT}.{{{overlap - 1 + k}}})" for k in range(shift))
        later.append(rf"{behind}{_stretch(limit // 2 + 1 - overlap - shift, limit - overlap - shift)}")
    return r"(?s)" + first + r"|(?<=.)(?:" + "|".join(later) + ")"


def _latin(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def split_pieces(df: DataFrame, text: str = "doc", limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False) -> DataFrame:
    """Pieces of ``text``: the other columns of ``df`` with seq (from 0), pos (byte offset), size (bytes), piece, total_chunks.

    A text of at most ``limit`` bytes is one piece at 0 (left out with ``only_long``). Else a piece from s ends at the largest
    offset in (s + limit/2, s + limit] where a heading line starts outside closed code fences, else after two line feeds, a
    line feed, a space, else at a character boundary; the next starts ``overlap`` bytes before, moved back to a boundary.

    * null and empty texts give no rows; repeated rows each give their pieces; an empty table gives none;
    * very long texts are cut whole; columns of ``df`` with a new name are replaced.

    limit/2 must exceed overlap + 3, so that every piece moves on.
    """
    if limit // 2 + 1 - overlap - 3 < 1 or overlap < 1:
        raise ValueError("limit/2 must exceed overlap + 3 and overlap must be positive")
    size = F.octet_length(text)
    source = spread(df.where(size > (limit if only_long else 0))).drop("seq", "pos", "size", "piece", "total_chunks")
    raw = _latin(F.col(text))
    # headings inside closed fences are masked by a character of the same width
    masked = F.when(
        F.contains(raw, F.lit("```")),
        F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_BLOCK_OR_LINE), F.lit(0)), lambda t: F.when(t.startswith("```"), F.replace(t, F.lit("\n#"), F.lit("\n?"))).otherwise(t)), ""),
    ).otherwise(raw)
    cuts = F.when(size > limit, F.regexp_extract_all(masked, F.lit(_pattern(limit, overlap)), F.lit(0)))
    ends = F.when(
        size > limit, F.aggregate(F.col("_cuts"), F.array().cast("array<int>"), lambda acc, m: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(m)))),
    ).otherwise(F.array(size))
    bytes_ = F.encode(F.col(text), "UTF-8")

    def back(e: Column) -> Column:
        """The start after a cut at ``e``: the nearest offset not after e - overlap where a character begins."""
        at = e - overlap
        cont = lambda k: F.substring(F.col("_bytes"), at - k + 1, F.lit(1)).between(F.lit(bytearray(b"\x80")), F.lit(bytearray(b"\xbf")))
        return F.when(~cont(0), at).when(~cont(1), at - 1).when(~cont(2), at - 2).otherwise(at - 3)

    starts = lambda: F.concat(F.array(F.lit(0)), F.transform(F.slice("_ends", 1, F.size("_ends") - 1), back))
    laid = source.withColumn("_cuts", cuts).withColumn("_ends", ends).drop("_cuts").withColumn("_bytes", bytes_)
    spans = laid.withColumn("_spans", F.arrays_zip(starts().alias("s"), F.col("_ends").alias("e"))).withColumn("total_chunks", F.size("_ends").cast("bigint"))
    rows = spans.select("*", F.posexplode_outer("_spans").alias("_seq", "_span"))
    return rows.select(
        *[c for c in source.columns if c != text], F.col("_seq").cast("bigint").alias("seq"), F.col("_span.s").cast("bigint").alias("pos"),
        (F.col("_span.e") - F.col("_span.s")).cast("bigint").alias("size"),
        F.decode(F.substring(F.col("_bytes"), F.col("_span.s") + 1, F.col("_span.e") - F.col("_span.s")), "UTF-8").alias("piece"), "total_chunks",
    )
