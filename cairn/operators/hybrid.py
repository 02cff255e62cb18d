"""Hybrid search: keyword and vector lists of a batch of queries, fused, cut, given their best chunk, reranked and blended.

Parsing is done on the driver, as queries are a request; what follows is one plan for the whole batch. Whether a query's keyword
hits are so strong that expansion is needless is a join in that plan, not a question to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.chunking import best_chunks, chunks
from cairn.functions.query_language import expansion_prompt, parse_expansion, parse_query
from cairn.functions.scalars import collection_of, docid, file_uri, filepath, path_of, query_terms
from cairn.operators.catalog import with_dense_ids
from cairn.operators.filters import active
from cairn.operators.fulltext import StoredIndex, search, strong_signal
from cairn.operators.fusion import blend, fuse
from cairn.operators.vectors import vsearch
from cairn.plans.lineage import cut
from cairn.schemas import WEIGHT_ORIGINAL, WEIGHT_OTHER, pool_size

#: Searches of a batch that may be broadcast.
MAX_SEARCHES = 200_000
_SUB = "query_id bigint, sub_id bigint, list_id int, qtype string, weight double, text string"


def plan_searches(spark: SparkSession, queries: list[tuple[int, str]], intents: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Searches (query_id, sub_id, list_id, qtype, weight, text) and queries (query_id, query, intent, expand) of a batch.

    A document's first search weighs as the original query, others less; a text to expand is searched by keywords and vectors,
    both as originals. ``sub_id`` is unique in the batch.
    """
    subs, heads = [], []
    for qid, raw in queries:
        parsed = parse_query(raw)
        intent = parsed.intent or (intents or {}).get(qid)
        heads.append((qid, raw, intent, parsed.expand_text))
        found = parsed.subqueries or ([("lex", parsed.expand_text), ("vec", parsed.expand_text)] if parsed.expand_text else [])
        for i, (kind, text) in enumerate(found):
            original = i == 0 or not parsed.subqueries
            subs.append((qid, len(subs), i, kind, WEIGHT_ORIGINAL if original else WEIGHT_OTHER, text))
    return spark.createDataFrame(subs, _SUB), spark.createDataFrame(heads, "query_id bigint, query string, intent string, expand string")


def _expansions(asked: DataFrame, backend) -> DataFrame:
    """query_id, qtype and text of what the backend makes of each query to expand."""

    def prompts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [expansion_prompt(text, intent) for text, intent in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["query_id", "prompt"])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, kind, text) for q, answer in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for kind, text in parse_expansion(answer)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["query_id", "qtype", "text"])

    asking = asked.select("query_id", "expand", "intent").mapInArrow(prompts, "query_id bigint, prompt string")
    return cut(backend.generate(asking, "prompt", "answer").select("query_id", "answer")).mapInArrow(parsed, "query_id bigint, qtype string, text string")


def ranked_lists(searches: DataFrame, documents: DataFrame, vectors: DataFrame, backend, pool: int, scope: DataFrame | None, index: StoredIndex | None = None) -> DataFrame:
    """A list (query_id, list_id, list_source, query_type, weight, filepath, backend_score) from each search."""
    allowed = active(documents) if scope is None else active(documents).join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    meta = searches.select("sub_id", "query_id", "list_id", "qtype", "weight")
    lex = search(documents, searches.where("qtype = 'lex'").select("sub_id", "text"), pool, scope, "sub_id", "text", index=index)
    found = lex.select("sub_id", "filepath", F.col("score").alias("backend_score"))
    if backend.can_embed:
        as_query = backend.embed_queries(searches.where("qtype = 'vec'"), "text", "embedding").select("sub_id", "embedding")
        as_passage = backend.embed_passages(searches.where("qtype = 'hyde'"), "text", "embedding").select("sub_id", "embedding")
        hits = vsearch(vectors, allowed, as_query.unionByName(as_passage), pool, "sub_id", backend.dim)
        found = found.unionByName(hits.select("sub_id", "filepath", F.col("score").alias("backend_score")))
    kind = F.when(F.col("weight") == WEIGHT_ORIGINAL, F.lit("original")).otherwise(F.col("qtype"))
    source = F.when(F.col("qtype") == "lex", "fts").otherwise(F.col("qtype"))
    return found.join(F.broadcast(meta) if meta.limit(MAX_SEARCHES + 1).count() <= MAX_SEARCHES else meta, "sub_id").select("query_id", "list_id", source.alias("list_source"), kind.alias("query_type"), "weight", "filepath", "backend_score")


def hybrid_search(
    queries: list[tuple[int, str]], documents: DataFrame, content: DataFrame, vectors: DataFrame, backend, limit: int = 10, scope: DataFrame | None = None,
    intents: dict[int, str] | None = None, rerank: bool = True, expand: bool = True, expansions: DataFrame | None = None, rerank_scores: DataFrame | None = None, index: StoredIndex | None = None,
) -> DataFrame:
    """Search results of a batch: query_id, position, score, docid, file, filepath, title, collection, path, body, best_chunk,
    best_chunk_pos.

    ``expansions`` (query_id, qtype, text) and ``rerank_scores`` (query_id, filepath, rerank_score) stand in for the backend's own;
    a backend that can't rerank or generate is not asked to. Queries without any hit give no rows.
    """
    spark = documents.sparkSession
    pool = pool_size(limit)
    searches, heads = plan_searches(spark, queries, intents)
    lists = ranked_lists(searches, documents, vectors, backend, pool, scope, index)
    if expand and (expansions is not None or backend.can_generate):
        asked = heads.where(F.col("expand").isNotNull() & (F.col("expand") != ""))
        if expansions is None:
            expansions = _expansions(asked, backend)
        probe = search(documents, asked.select("query_id", F.col("expand").alias("query")), 2, scope, index=index)
        weak = asked.select("query_id").join(strong_signal(probe).where("strong"), "query_id", "left_anti")
        more = with_dense_ids(cut(expansions.join(weak, "query_id", "left_semi").select("query_id", "qtype", "text")), ["query_id", "qtype", "text"], "i")
        rows = more.select("query_id", (F.lit(1_000_000) + F.col("i")).alias("sub_id"), (F.lit(100) + F.col("i")).cast("int").alias("list_id"), "qtype", F.lit(WEIGHT_OTHER).alias("weight"), "text")
        lists = lists.unionByName(ranked_lists(cut(rows), documents, vectors, backend, pool, scope, index))
    fused = cut(fuse(lists, pool))
    about = active(documents).select("doc_id", filepath(F.col("collection"), F.col("path")).alias("filepath"), "title", "hash")
    # texts are fetched for the candidates only: at most 100 a query
    candidates = fused.join(about, "filepath").join(heads, "query_id")
    texts = candidates.join(content.select("hash", F.col("doc").alias("body")), "hash", "left").withColumn("body", F.coalesce("body", F.lit("")))
    wanted = F.concat_ws(" ", "intent", "query")
    pieces = chunks(texts.select("query_id", "filepath", query_terms(wanted).alias("terms"), "body"), "body")
    best = best_chunks(pieces, ["query_id", "filepath"]).select("query_id", "filepath", F.col("chunk").alias("best_chunk"), F.col("pos").alias("best_chunk_pos"))
    whole = cut(texts.join(best, ["query_id", "filepath"]))
    scores = rerank_scores
    if rerank and scores is None and backend.can_rerank:
        scores = backend.rerank(whole.withColumn("_q", F.concat_ws("\n", "intent", "query")), "_q", "best_chunk", "rerank_score").select("query_id", "filepath", "rerank_score")
    if rerank and scores is not None:
        final = blend(fused, scores, limit)
    else:
        final = fused.where(F.col("position") <= limit)
    extra = whole.select("query_id", "filepath", "title", "hash", "body", "best_chunk", "best_chunk_pos")
    return final.join(extra, ["query_id", "filepath"]).select(
        "query_id", "position", "score", docid(F.col("hash")).alias("docid"), file_uri(F.col("filepath")).alias("file"), "filepath", "title",
        collection_of(F.col("filepath")).alias("collection"), path_of(F.col("filepath")).alias("path"), "body", "best_chunk", "best_chunk_pos",
    )
