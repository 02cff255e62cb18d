"""Schemas of the stored tables and the constants that define results."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType())}


def _struct(ddl: str) -> T.StructType:
    """A schema from ``name type`` pairs; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


CONTENT = _struct("hash string, doc string, created_at string")
DOCUMENTS = _struct("doc_id bigint, collection string, path string, title string, hash string, text string, created_at string, modified_at string, active boolean")
CONTENT_VECTORS = _struct("hash string, seq bigint, pos bigint, model string, embed_fingerprint string, total_chunks bigint, embedded_at string, vid bigint, embedding array<float>")
COLLECTIONS = _struct("name string, path string, pattern string, ignore array<string>, include_by_default boolean, update_command string, allow_hidden boolean")
CONFIG = _struct("key string, value string")
TABLES = {"content": CONTENT, "documents": DOCUMENTS, "content_vectors": CONTENT_VECTORS, "collections": COLLECTIONS, "config": CONFIG}

#: What tells a table's rows apart, and so what a change replaces.
KEYS = {"content": ["hash"], "documents": ["doc_id"], "content_vectors": ["hash", "seq"], "collections": ["name"], "config": ["key"]}
#: A stored index: postings, and the length of every field of every document under no term.
POSTINGS = _struct("bucket int, term string, field string, doc_id bigint, version bigint, len bigint, tf bigint, positions array<int>")

RANKED = _struct("query_id bigint, list_id int, list_source string, query_type string, weight double, filepath string, backend_score double")
QUERIES = _struct("query_id bigint, query string")

# Fixed values that define results.
CHUNK_BYTES, OVERLAP_BYTES, BREAK_WINDOW = 3600, 540, 800
FIELD_BOOST = {"filepath": 1.5, "title": 4.0, "body": 1.0}
BM25_K1, BM25_B = 1.2, 0.75
MAX_TOKEN_BYTES = 40
RRF_K = 60
RRF_BONUS_FIRST, RRF_BONUS_NEXT = 0.05, 0.02
WEIGHT_ORIGINAL, WEIGHT_OTHER = 2.0, 1.0
POOL_LEAST, POOL_MOST = 20, 100
STRONG_SCORE, STRONG_GAP = 0.85, 0.15
BLEND_RERANK = 0.75
SIMILAR_CHUNKS = 8
EMBED_DIM = 768
DEFAULT_PATTERN = "**/*.md"
URI_SCHEME = "doc://"


def pool_size(limit: int) -> int:
    """Candidates kept before reranking."""
    return max(POOL_LEAST, min(2 * limit, POOL_MOST))
