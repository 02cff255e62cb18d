"""Inference backends: embedding, reranking and generating, as operations on DataFrames.

A backend declares what it can do; searches leave out what it can't. Models run in Arrow batches on the executors and are loaded
once a worker. None is shipped: :class:`StubBackend` is deterministic and for tests, :class:`NoBackend` can do nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.schemas import EMBED_DIM


class Backend(Protocol):
    embed_model: str
    dim: int
    can_embed: bool
    can_rerank: bool
    can_generate: bool

    def embed_queries(self, df: DataFrame, text: str, out: str) -> DataFrame: ...

    def embed_passages(self, df: DataFrame, text: str, out: str) -> DataFrame: ...

    def rerank(self, df: DataFrame, query: str, passage: str, out: str) -> DataFrame: ...

    def generate(self, df: DataFrame, prompt: str, out: str) -> DataFrame: ...


class Unsupported(RuntimeError):
    """The backend lacks the capability."""


class NoBackend:
    embed_model, dim = "none", EMBED_DIM
    can_embed = can_rerank = can_generate = False

    def _no(self, *_):
        raise Unsupported("no inference backend is configured")

    embed_queries = embed_passages = rerank = generate = _no


class StubBackend:
    """One-hot vectors at the sum of the first word's bytes, rerank scores of zero, empty generations: SQL alone."""

    can_embed = can_rerank = can_generate = True

    def __init__(self, dim: int = EMBED_DIM):
        self.embed_model, self.dim = f"stub-{dim}", dim

    def embed_queries(self, df: DataFrame, text: str, out: str) -> DataFrame:
        raw = F.encode(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"^\s*(\S*)", 1), "UTF-8")
        n = F.octet_length(raw)
        bytes_ = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
        at = F.aggregate(bytes_, F.lit(0), lambda s, b: s + b) % self.dim
        return df.withColumn("_at", at).withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.when(i == F.col("_at"), F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))).drop("_at")

    embed_passages = embed_queries

    def rerank(self, df: DataFrame, query: str, passage: str, out: str) -> DataFrame:
        return df.withColumn(out, F.lit(0.0))

    def generate(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        return df.withColumn(out, F.lit(""))


class ModelBackend:
    """A backend around a model of the caller's: ``load`` gives an object with embed(texts), rerank(pairs), generate(prompts).

    ``load`` is called once in each worker process. Texts get the prompts before they are embedded. Null texts count as empty.
    """

    def __init__(self, embed_model: str, dim: int, load: Callable, can_embed=True, can_rerank=False, can_generate=False, query_prompt: str = "", passage_prompt: str = ""):
        self.embed_model, self.dim, self.load = embed_model, dim, load
        self.can_embed, self.can_rerank, self.can_generate = can_embed, can_rerank, can_generate
        self.query_prompt, self.passage_prompt = query_prompt, passage_prompt

    def _run(self, df: DataFrame, inputs: list[str], out: str, kind: T.DataType, f: Callable) -> DataFrame:
        load, names = self.load, [c for c in df.columns if c != out]
        schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, kind)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                made = f(model, *[[x or "" for x in batch.column(c).to_pylist()] for c in inputs]) if batch.num_rows else []
                arrow = pa.list_(pa.float32()) if isinstance(kind, T.ArrayType) else pa.float64() if isinstance(kind, T.DoubleType) else pa.string()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, arrow)], names=schema.names)

        return df.select(*names).mapInArrow(run, schema)

    def _embed(self, df: DataFrame, text: str, out: str, prompt: str) -> DataFrame:
        if not self.can_embed:
            raise Unsupported("embed")

        def f(model, texts):
            x = np.asarray(model.embed([prompt + t for t in texts]), dtype=np.float64)
            return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32).tolist()

        return self._run(df, [text], out, T.ArrayType(T.FloatType()), f)

    def embed_queries(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return self._embed(df, text, out, self.query_prompt)

    def embed_passages(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return self._embed(df, text, out, self.passage_prompt)

    def rerank(self, df: DataFrame, query: str, passage: str, out: str) -> DataFrame:
        if not self.can_rerank:
            raise Unsupported("rerank")
        return self._run(df, [query, passage], out, T.DoubleType(), lambda model, q, p: [float(x) for x in model.rerank(list(zip(q, p)))])

    def generate(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        if not self.can_generate:
            raise Unsupported("generate")
        return self._run(df, [prompt], out, T.StringType(), lambda model, prompts: list(model.generate(prompts)))
