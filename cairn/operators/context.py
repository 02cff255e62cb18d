"""Contexts: descriptions of directories that their documents inherit. Settings keep them under ``context:<place>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import ancestors
from cairn.schemas import URI_SCHEME

PREFIX = "context:"


def context_key(place: str, collections: set[str] | None = None) -> str:
    """The settings key of ``/``, of a URI below a collection, or of a bare collection name that is known. ValueError otherwise."""
    if place == "/":
        return PREFIX + "/"
    if place.startswith(URI_SCHEME):
        return PREFIX + place.rstrip("/") + "/"
    if collections is not None and place in collections:
        return f"{PREFIX}{URI_SCHEME}{place}/"
    raise ValueError(f"neither /, a URI nor a collection: {place}")


def place_keys(collection: Column, path: Column) -> Column:
    """Settings keys that may describe a document, nearest first: its directories, its collection, everything."""
    root = F.concat(F.lit(PREFIX + URI_SCHEME), collection, F.lit("/"))
    return F.concat(F.transform(ancestors(path), lambda d: F.concat(root, d, F.lit("/"))), F.array(root, F.lit(PREFIX + "/")))


def with_context(results: DataFrame, config: DataFrame, by: list[str], most_broadcast: int = 100_000) -> DataFrame:
    """``results`` (collection, path, ...) with ``context``: the nearest described place that has a value, else null.

    ``by`` names the columns that tell the rows of ``results`` apart. Only places that occur in the settings are looked up;
    settings of up to ``most_broadcast`` rows are broadcast, others joined by key.
    """
    known = config.where(F.startswith(F.col("key"), F.lit(PREFIX)) & F.col("value").isNotNull()).groupBy("key").agg(F.max("value").alias("_value"))
    if known.limit(most_broadcast + 1).count() <= most_broadcast:
        known = F.broadcast(known)
    places = results.select(*by, F.posexplode(place_keys(F.col("collection"), F.col("path"))).alias("_near", "key")).join(known, "key")
    nearest = places.groupBy(*by).agg(F.min_by("_value", "_near").alias("context"))
    return results.join(nearest, by, "left")


def lacking_context(collections: DataFrame, config: DataFrame) -> DataFrame:
    """Names of collections without a context at their root."""
    keys = config.where(F.col("value").isNotNull()).select("key")
    return collections.select("name", F.concat(F.lit(PREFIX + URI_SCHEME), F.col("name"), F.lit("/")).alias("key")).join(keys, "key", "left_anti").select("name")
