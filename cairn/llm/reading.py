"""Reading level by the share of unfamiliar words and the length of sentences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.spread import spread

LETTERS = r"\p{L}+"
#: A maximal run of end marks before white space or the end of the text.
SENTENCE_END = r"(?<![.!?])[.!?]++(?=[ \t\r\n]|\z)"
#: Most words on the list of familiar words, which bounds what goes to the driver and into the plan, and the least share of
#: the documents that must hold a familiar word.
FAMILIAR, FAMILIAR_SHARE = 3000, 0.01
# Weights of the published familiar-word formula (per cent of unfamiliar words, words a sentence, and the
# addition for texts with more than five per cent of unfamiliar words).
W_UNFAMILIAR, W_LENGTH, ADDED, ADDED_ABOVE = 0.1579, 0.0496, 3.6365, 5.0


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))


def familiar_words(df: DataFrame, text: str = "text", size: int = FAMILIAR, share: float = FAMILIAR_SHARE) -> list[str]:
    """The ``size`` words that most documents hold, if at least ``share`` of them do; ties go to the smaller word.

    The counts are over all documents.
    """
    least = share * df.count()
    each = spread(df.select(text)).select(F.explode(F.array_distinct(_words(F.lower(text)))).alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    top = counts.orderBy(F.desc("docs"), "word").limit(size)
    return [r[0] for r in top.collect()]


def reading_level(df: DataFrame, text: str = "text", familiar: list[str] | None = None) -> DataFrame:
    """``df`` without ``text``, with n_words, n_letters, n_sentences, words_per_sentence, letters_per_word, unfamiliar and score.

    Words are maximal runs of letters; at least one sentence is assumed; ``unfamiliar`` is the share of words outside the list
    (by default the list of ``df`` itself); ``score`` grows with difficulty.

    * null, empty and wordless texts have zero words and null score, words_per_sentence, letters_per_word and unfamiliar;
    * repeated rows each give their row, an empty table none; columns of ``df`` with one of the new names are replaced.
    """
    known = familiar if familiar is not None else familiar_words(df, text)
    words = spread(df).withColumn("_words", F.coalesce(_words(F.col(text)), F.array().cast("array<string>")))
    n = F.size("_words").cast("bigint")
    hits = F.size(F.filter("_words", lambda w: F.lower(w).isin(known))) if known else F.lit(0)
    counted = words.withColumns({
        "n_words": n,
        "n_letters": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_sentences": F.greatest(F.coalesce(F.regexp_count(F.col(text), F.lit(SENTENCE_END)), F.lit(0)), F.lit(1)).cast("bigint"),
        "_familiar": hits.cast("bigint"),
    }).drop("_words", text)
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words"))
    rated = counted.withColumns({
        "words_per_sentence": F.when(F.col("n_words") > 0, F.col("n_words") / F.col("n_sentences")),
        "letters_per_word": per_word(F.col("n_letters")),
        "unfamiliar": per_word(F.col("n_words") - F.col("_familiar")),
    }).drop("_familiar")
    percent = F.col("unfamiliar") * 100
    score = percent * W_UNFAMILIAR + F.col("words_per_sentence") * W_LENGTH + F.when(percent > ADDED_ABOVE, F.lit(ADDED)).otherwise(F.lit(0.0))
    return rated.withColumn("score", score)


def demanding(levels: DataFrame, words: int = 60, per_sentence: int = 20, letters: int = 6) -> DataFrame:
    """Rows of :func:`reading_level` that are demanding: chosen by score, then held against the three bounds in whole numbers.

    A text of ``per_sentence`` words a sentence has at least that part of the score, so the choice by score loses none.
    """
    least = F.lit(W_LENGTH * per_sentence * (1 - 1e-9))
    exact = (F.col("n_words") >= words) & (F.col("n_words") >= per_sentence * F.col("n_sentences")) & (F.col("n_letters") >= letters * F.col("n_words"))
    return levels.where((F.col("score") >= least) & exact)


def calibrated(levels: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "reading_level") -> DataFrame:
    """``levels`` with ``level`` from 1 to 5: a least-squares fit of the labels on the parts of the score, rounded, within 1..5.

    The parts are the share of unfamiliar words and the logarithms of words a sentence and letters a word. Labels are averaged a
    key first; null labels don't count. All labelled rows enter as sums of products, of which 14 numbers reach the driver.
    Without usable labels the level is null, as it is for a row with null score; parts that don't vary count nothing.
    """
    parts = [F.lit(1.0), F.col("unfamiliar"), F.log("words_per_sentence"), F.log("letters_per_word")]
    mean = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("_y"))
    seen = levels.where(F.col("score").isNotNull()).join(mean, key).select(*[p.alias(f"_f{i}") for i, p in enumerate(parts)], F.col("_y").alias("_f4"))
    pairs = [(i, j) for i in range(4) for j in range(i, 5)]
    sums = seen.agg(*[F.sum(F.col(f"_f{i}") * F.col(f"_f{j}")).alias(f"s{i}{j}") for i, j in pairs]).first()
    if sums["s00"] is None:
        return levels.withColumn("level", F.lit(None).cast("int"))
    m, y = np.zeros((4, 4)), np.array([sums[f"s{i}4"] for i in range(4)])
    for i, j in pairs:
        if j < 4:
            m[i, j] = m[j, i] = sums[f"s{i}{j}"]
    weights = np.linalg.lstsq(m, y, rcond=1e-10)[0]
    fitted = sum((p * float(w) for p, w in zip(parts[1:], weights[1:])), F.lit(float(weights[0])))
    level = F.when(F.col("score").isNotNull(), F.least(F.greatest(F.round(fitted), F.lit(1.0)), F.lit(5.0)).cast("int"))
    return levels.withColumn("level", level)
