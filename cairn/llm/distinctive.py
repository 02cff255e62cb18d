"""How characteristic a term is of its record: adjusted residuals of correspondence analysis.

Under independence a term with C occurrences among all T is expected len * C / T times in a record of len words. The residual is
the observed minus the expected count over the square root of the expected count, divided by the square root of
(1 - len/T) * (1 - C/T), which adjusts for the margins. Common terms come out near 0, rare ones that recur in a record high.

Terms found in many records are met by a broadcast: those in at least pairs / MAX_COMMON records, where pairs is the number of
(record, term) pairs, are at most MAX_COMMON terms. All other terms are met by a shuffled join, in which no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import raw_words
from cairn.plans.lineage import cut
from cairn.plans.skew import salted_join

MAX_COMMON = 20_000


def term_counts(records: DataFrame, key: str, texts: list[str], within: list[str] | None = None) -> DataFrame:
    """key, term, n and len: occurrences of the lower-cased term in the record's texts, and the record's number of words.

    ``within`` names columns by which equal keys lie together already, so that counting needs no exchange.
    """
    words = records.select(*(within or []), key, raw_words(F.concat_ws("\n", *texts)).alias("_w"))
    each = words.select(*(within or []), key, F.size("_w").cast("bigint").alias("len"), F.explode("_w").alias("_t"))
    groups = [*(within or []), key, "len", F.lower("_t").alias("term")]
    return each.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).select(key, "term", "n", "len")


def term_scores(records: DataFrame, key: str, texts: list[str], n_records: int | None = None, unique: bool = False, within: list[str] | None = None, max_common: int = MAX_COMMON) -> DataFrame:
    """Every (record, term): key, term, n, len, d (records holding the term), c (its occurrences in all), n_records, expected,
    residual (adjusted).

    * a null text adds no words; a record without words has no rows but counts among the records;
    * of repeated keys one row counts, the one with the smallest texts (``unique`` promises there are none and saves a step);
    * the residual is null where an expectation is without meaning: one record or one term in all;
    * an empty table gives no rows; columns of ``records`` other than those named are ignored.
    """
    if not unique:
        records = records.groupBy(key).agg(F.min(F.struct(*texts)).alias("_one")).select(key, *[F.col(f"_one.{c}").alias(c) for c in texts])
    n_all = n_records if n_records is not None else records.count()
    counts = cut(term_counts(records, key, texts, within))
    terms = cut(counts.groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("c")))
    pairs, total = terms.agg(F.sum("d"), F.sum("c")).first()
    bound = (pairs or 0) / max_common
    common = F.broadcast(terms.where(F.col("d") >= F.lit(bound)))  # at most max_common terms
    rest = counts.join(common.select("term"), "term", "left_anti")
    met = counts.join(common, "term").unionByName(rest.join(terms.where(F.col("d") < F.lit(bound)), "term"))
    share = lambda c: F.lit(1.0) - F.col(c) / F.lit(float(total or 1))
    expected = F.col("len") * F.col("c") / F.lit(float(total or 1))
    margins = share("len") * share("c")
    residual = F.when(margins > 0, (F.col("n") - expected) / F.sqrt(expected) / F.sqrt(margins))
    return met.select(key, "term", "n", "len", "d", "c", F.lit(n_all).cast("bigint").alias("n_records"), expected.alias("expected"), residual.alias("residual"))


def dominant_terms(scores: DataFrame, key: str, by: Column, factor: float) -> DataFrame:
    """key, term: the term of a record whose ``by`` is above 0 and at least ``factor`` times that of each of its other terms.

    Records of one term have none. The residual has no say: a term without one counts like any other. Two terms a record are kept
    before the exchange.
    """
    order = Window.partitionBy(key).orderBy(F.desc("_by"), "term")
    two = scores.select(key, "term", by.alias("_by")).withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    best = two.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col("term"))).alias("term"), F.max(F.when(F.col("_r") == 1, F.col("_by"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("_by"))).alias("_b"))
    return best.where((F.col("_a") > 0) & (F.col("_a") >= F.lit(factor) * F.col("_b"))).select(key, "term")


def document_scores(documents: DataFrame, content: DataFrame) -> DataFrame:
    """:func:`term_scores` of the documents with a title and a row in content, over title and raw text together.

    A hash that many documents share is dealt to several tasks. Hashes are unique in ``content`` and doc_ids in ``documents``.
    """
    titled = documents.where(F.col("title").isNotNull()).select("doc_id", "title", "hash")
    raw = content.select("hash", "doc")
    n = titled.join(raw.select("hash"), "hash", "left_semi").count()
    return term_scores(salted_join(titled, raw, "hash", "doc_id"), "doc_id", ["title", "doc"], n_records=n, unique=True, within=["hash", "_salt"])


def rarity_weighted() -> Column:
    """n * ln(N/d)."""
    return F.col("n") * F.log(F.col("n_records") / F.col("d"))
