import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.functions.chunking import break_points, chunk_spans, chunks, first_chunk, snippet_of, snippets
from cairn.functions.query_language import Clause, lex_clauses, parse_expansion, parse_query
from cairn.functions.text import is_blank, tokens


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", datetime.datetime: "timestamp", list: "array<string>"}
    ddl = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(column.alias("r")).first().r


@pytest.mark.parametrize("text, want", [("don't", ["don", "t"]), ("core.db-x_y", ["core", "db", "x", "y"]), ("2026.4.10 Ä", ["2026", "4", "10", "ä"]), ("", []), (None, []), ("x" * 40 + " y", ["y"]), ("İz", ["iz"])])
def test_tokens(spark, text, want):
    assert one(spark, tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [(None, True), ("", True), (" \t\r\n 　\x1c", True), ("​", False), (" x ", False)])
def test_blank(spark, text, want):
    assert one(spark, is_blank(F.col("t")), t=text) is want


def test_ids(spark):
    assert len(one(spark, S.docid(S.content_hash(F.col("t"))), t="text")) == 6
    assert len(one(spark, S.embed_fingerprint("m"))) == 6
    assert one(spark, S.embed_fingerprint("m")) != one(spark, S.embed_fingerprint("n"))


@pytest.mark.parametrize("path, want", [("a/b/c.md", ["a/b", "a"]), ("c.md", []), ("", []), (None, None)])
def test_ancestors(spark, path, want):
    got = one(spark, S.ancestors(F.col("p")), p=path)
    assert got == want or (want is None and got in (None, []))


def test_paths(spark):
    assert one(spark, S.collection_of(F.col("p")), p="a/b/c") == "a"
    assert one(spark, S.path_of(F.col("p")), p="a/b/c") == "b/c"
    assert one(spark, S.path_of(F.col("p")), p="a") == ""
    assert one(spark, S.like_literal(F.col("p")), p="a_b%c\\d") == "a\\_b\\%c\\\\d"


@pytest.mark.parametrize("seconds, want", [(5, "just now"), (-5, "just now"), (61, "1m ago"), (7200, "2h ago"), (3 * 86400, "3d ago"), (8 * 86400, "2025-05-24")])
def test_time_ago(spark, seconds, want):
    now = datetime.datetime(2025, 6, 1, tzinfo=datetime.timezone.utc)
    text = (now - datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert one(spark, S.time_ago(F.col("t"), F.lit(now)), t=text) == want
    assert one(spark, S.time_ago(F.col("t"), F.lit(now)), t="yesterday") == "yesterday"


def test_texts_of_numbers(spark):
    assert [one(spark, S.duration(F.col("x")), x=v) for v in (5.4, 65.0, 3700.0)] == ["5s", "1m 5s", "1h 1m"]
    assert [one(spark, S.byte_size(F.col("x")), x=v) for v in (17, 1536, 2 << 20)] == ["17 B", "1.5 KB", "2.0 MB"]
    assert [one(spark, S.score_percent(F.col("x")), x=v) for v in (0.07, 0.42, 1.0)] == ["  7%", " 42%", "100%"]
    assert [one(spark, S.score_band(F.col("x")), x=v) for v in (0.7, 0.4, 0.1)] == ["high", "medium", "low"]
    assert one(spark, S.progress_bar(F.col("x"), 4), x=50.0) == "██░░"
    at = datetime.datetime(2024, 6, 29, 12, 34, 56, tzinfo=datetime.timezone.utc)
    assert one(spark, S.rfc3339(F.col("t")), t=at) == "2024-06-29T12:34:56Z"


def test_escapes(spark):
    assert one(spark, S.csv_field(F.col("t")), t='a "b", c') == '"a ""b"", c"'
    assert one(spark, S.csv_field(F.col("t")), t="plain") == "plain"
    assert one(spark, S.xml_escape(F.col("t")), t="<a b=\"c\">&'</a>") == "&lt;a b=&quot;c&quot;&gt;&amp;&apos;&lt;/a&gt;"
    assert one(spark, S.highlight(F.col("t"), ["rate", "of"], "[", "]"), t="Rate of RATES $1") == "[Rate] of [RATE]S $1"
    assert one(spark, S.preview(F.col("t")), t="é" * 40) == "é" * 28 + "..."
    assert one(spark, S.preview(F.col("t")), t="x" * 60) == "x" * 60


# ---------------------------------------------------------------- chunks


def test_chunk_cases():
    assert chunk_spans("hello world") == [(0, 11)]
    assert chunk_spans("") == [(0, 0)]
    assert chunk_spans("a" * 3601) == [(0, 3601), (3061, 3601)]
    assert chunk_spans("a" * 9000) == [(0, 4000), (3460, 7460), (6920, 9000)]
    assert chunk_spans("a" * 3300 + "\n" + "b" * 5699)[0] == (0, 3600)
    assert chunk_spans("a" * 3300 + "\n" + "b" * 399 + "\n## x" + "c" * 5000)[0] == (0, 3700)
    assert first_chunk("x" * 5000) == "x" * 4000


def test_headings_and_fences():
    text = "# Section A\n" + "word " * 700 + "\n# Section B\n" + "word " * 700
    assert len(chunk_spans(text)) >= 2
    fenced = "a\n```\n# not a heading\n```\n# heading\n"
    offsets, scores = break_points(fenced)
    best = {o: s for o, s in zip(offsets, scores)}
    assert best[fenced.index("\n# heading")] == 100 and fenced.index("\n# not") not in best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "é", "日本", "\n", "\n\n", "\n# H\n", "\n```\n", "\n- x", "😀"]), max_size=3000))
def test_chunks_cover_the_text(parts):
    text = "".join(parts)
    raw = text.encode()
    spans = chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(raw)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert a < c <= b and b - c - 540 in range(4)  # the overlap, but for a character's bytes
    for a, b in spans:
        raw[a:b].decode()


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a", "x" * 9000, 1), ("b", None, 2), ("c", "", 3), ("a", "x" * 9000, 1)], "hash string, doc string, seq int")
    rows = sorted((r.hash, r.seq, r.pos, r.total_chunks) for r in chunks(df).collect())
    assert rows == [("a", 0, 0, 3)] * 2 + [("a", 1, 3460, 3)] * 2 + [("a", 2, 6920, 3)] * 2 + [("c", 0, 0, 1)]
    assert chunks(df.limit(0)).count() == 0


def test_snippets(spark):
    line, text = snippet_of("one\ntwo\nbudget three\nfour\nfive", "Budget")
    assert line == 3 and text == "@@ -2,4 @@ (1 before, 0 after)\ntwo\nbudget three\nfour\nfive"
    assert snippet_of("é" * 200, "x", most=100)[1].endswith("...")
    assert snippet_of("", "x")[0] == 1
    body = "\n".join(f"line {i}" for i in range(1000))
    assert snippet_of(body, "nothing", chunk_pos=4000)[0] > 300
    df = spark.createDataFrame([(None, None, None, None, 7), ("a b", "b", 0, "a b", 8)], "body string, query string, best_chunk_pos bigint, best_chunk string, line int")
    assert [r.line for r in snippets(df).collect()] == [1, 1]


# ---------------------------------------------------------------- query language


def test_parse_query():
    assert parse_query("how does auth work").expand_text == "how does auth work"
    assert parse_query("expand: error handling").expand_text == "error handling"
    assert parse_query("a\n\n  b ").expand_text == "a b"
    assert parse_query("").expand_text == "" and parse_query(None).expand_text == ""
    p = parse_query("lex: auth token\nvec: how does it work\nexpand: no\nintent: one\nintent: two\nplain")
    assert p.subqueries == [("lex", "auth token"), ("vec", "how does it work")] and p.intent == "one" and p.expand_text is None
    assert parse_query('lex: auth -oauth "machine learning"').subqueries == [("lex", 'auth -oauth "machine learning"')]
    assert parse_query("Lex: x").expand_text == "Lex: x"
    with pytest.raises(ValueError):
        parse_query("intent: only")


def test_clauses():
    assert lex_clauses('auth -oauth "machine learning" -"a b" 2026.4.10 error: x-y') == [
        Clause(("auth",)), Clause(("oauth",), True), Clause(("machine", "learning")), Clause(("a", "b"), True), Clause(("2026", "4", "10")), Clause(("error",)), Clause(("x", "y")),
    ]
    assert lex_clauses(None) == [] and lex_clauses('"" - !?') == [] and lex_clauses('open "quote') == [Clause(("open",)), Clause(("quote",))]


def test_parse_expansion():
    assert parse_expansion("lex: a b\nnoise\nvec: \n hyde: text") == [("lex", "a b"), ("hyde", "text")]
    assert parse_expansion(None) == []
