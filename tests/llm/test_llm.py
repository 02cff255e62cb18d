"""Training-data operators on small fixtures: against brute force, libraries, and on hard rows (nulls, empty and very long texts,
ties, repeated rows, empty tables, clashing columns)."""

import collections
import math
import re

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import queries as llm
from cairn.llm import bpe, distinctive, leaks, leximin, markup, neardup, reading, split, vptree
from tests.conftest import DATA

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


# ---------------------------------------------------------------- 8: BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(llm.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(*bpe.load_merges(llm.TOKENIZER))


def encode(encoder, text):
    words = regex.findall(bpe.SPLIT, text)
    ids = encoder.learn(set(words))
    return [i for w in words for i in ids[w]]


HARD = ["", " ", "a", "<|endoftext|> x", "don't WE'LL it's  two   spaces\n\n tabs\t\t ", "naïve café 東京都 한국어 हिन्दी 😀👨‍👩‍👧 \u00a0\u3000\x1c\x85", "a" * 5000, " " * 300 + "x", "=" * 200, "ab" * 900 + "12345678901234567890", "\ufeff\u200b'S'LL've"]


def test_encoding_is_the_librarys(encoder, library):
    for text in HARD:
        assert encode(encoder, text) == library(text), text[:40]


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiou stnr  THE'lld.,0123\n")), max_size=80))
def test_any_text_is_encoded_like_the_library(encoder, library, text):
    assert encode(encoder, text) == library(text)


def test_encoding_rows(spark, library, monkeypatch):
    rows = [(1, t, "e") for t in HARD] + [(2, None, None), (1, HARD[4], "e")]
    df = spark.createDataFrame(rows, "ids int, text string, lang string")
    got = bpe.encode_corpus(df, llm.TOKENIZER, keep=["lang", "ids"]).collect()
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(library(t or "")) for _, t, _ in rows)
    assert bpe.encode_corpus(df.limit(0), llm.TOKENIZER).count() == 0
    small = bpe.TrieEncoder(*bpe.load_merges(llm.TOKENIZER))
    monkeypatch.setattr(bpe, "MAX_NODES", 30)
    for text in HARD:
        assert encode(small, text) == library(text)


# ---------------------------------------------------------------- 7: splitting


def split_brute(doc, limit=3600, overlap=540):
    b = doc.encode()
    n, lines, at, offsets = len(b), doc.encode().split(b"\n"), 0, []
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    fences = [i for i, x in enumerate(lines) if x.startswith(b"```")]
    inside = {i for a, c in zip(fences[::2], fences[1::2]) for i in range(a + 1, c)}
    heads = [offsets[i] for i, x in enumerate(lines) if i not in inside and re.match(rb"#{1,6} ", x)]
    out, s = [], 0
    while n - s > limit:
        lo, hi = s + limit // 2, s + limit
        e = max((h for h in heads if lo < h <= hi), default=0)
        for sep in (b"\n\n", b"\n", b" "):
            if not e:
                e = next((x for x in range(hi, lo, -1) if b[:x].endswith(sep)), 0)
        if not e:
            e = next(x for x in range(hi, lo, -1) if b[x] & 0xC0 != 0x80)
        out.append((s, e))
        s = e - overlap
        while b[s] & 0xC0 == 0x80:
            s -= 1
    return [*out, (s, n)]


def spans(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.k].append((r.seq, r.pos, r.pos + r.size, r.piece, r.total_chunks))
    return {k: sorted(v) for k, v in got.items()}


def test_split_cases(spark):
    rng = np.random.default_rng(5)
    parts = ["word ", "é", "日本語", "\n", "\n\n", "\n# H\n", "\n```\n", "# x\n", "😀" * 30, "a" * 200, "\x85", "\r\n", "###### deep ", "\n####### seven "]
    texts = ["".join(rng.choice(parts, size=n)) for n in rng.integers(200, 4000, size=40)]
    texts += ["a" * 3600, "a" * 3601, "日" * 3000, "😀" * 2000, "x" + "é" * 9000, "\n" * 8000, " " * 8000, "```\n" + "# a\n" * 3000, "```\n# a\n" * 1500 + "```", "# a\n" * 3000, "\n".join(["```", "# in"] + ["text " * 300] * 5 + ["```", "# out"] + ["text " * 300] * 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, doc string")
    got = spans(split.split_pieces(df))
    for k, text in enumerate(texts):
        assert [(a, b) for _, a, b, _, _ in got.get(k, [])] == (split_brute(text) if text else []), k
        for i, (seq, a, b, piece, n) in enumerate(got.get(k, [])):
            assert seq == i and n == len(got[k]) and piece == text.encode()[a:b].decode()


def test_split_hard_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "short", 7), (4, "x" * 4000, 8), (4, "x" * 4000, 8)], "k int, doc string, seq int")
    got = spans(split.split_pieces(df))
    assert set(got) == {3, 4} and len(got[4]) == 4 and got[3][0][:3] == (0, 0, 5)
    assert set(spans(split.split_pieces(df, only_long=True))) == {4} and split.split_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_pieces(df, limit=100, overlap=50)
    text = "".join(f"paragraph {i} é\n\n" for i in range(200))
    small = spans(split.split_pieces(spark.createDataFrame([(1, text)], "k int, doc string"), limit=300, overlap=40))[1]
    assert [(a, b) for _, a, b, _, _ in small] == split_brute(text, 300, 40)


# ---------------------------------------------------------------- 10: reading level


def test_reading_level(spark):
    hard = "Considerable institutional responsibility necessitates extraordinary administrative coordination throughout organisational infrastructure departments everywhere today " * 5
    texts = ["The cat sat. The cat ran! Is it? Yes...", hard, None, "", "123 !!! ...", "no end", "." * 20000 + "x", "Ünïcode naïve"]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)] + [(0, texts[0], 1.5)], "doc_id bigint, text string, n_words double")
    rows = {r.doc_id: r for r in reading.reading_level(df, familiar=["the", "cat", "sat", "is", "it", "yes", "ran"]).collect()}
    assert (rows[0].n_words, rows[0].n_sentences, rows[0].unfamiliar, rows[0].n_letters) == (9, 4, 0.0, 25)
    assert rows[2].n_words == rows[3].n_words == rows[4].n_words == 0 and rows[2].score is None and rows[4].letters_per_word is None
    assert rows[5].n_sentences == 1 and rows[6].n_words == 1 and rows[7].n_words == 2 and rows[1].score > rows[0].score
    assert [r.doc_id for r in reading.demanding(reading.reading_level(df)).collect()] == [1]
    assert reading.reading_level(df.limit(0)).count() == 0 and reading.familiar_words(df.limit(0)) == []
    assert reading.familiar_words(df, share=0.2)[:2] == ["cat", "is"] and reading.familiar_words(df, size=1, share=0) == ["cat"]


def test_calibrated_levels(spark):
    rows = [(i, float(i), 0.1, math.exp(i), 4.0) for i in range(1, 7)] + [(9, None, None, None, None)]
    levels = spark.createDataFrame(rows, "doc_id bigint, score double, unfamiliar double, words_per_sentence double, letters_per_word double")
    labels = spark.createDataFrame([(i, min(i, 5)) for i in range(1, 6)] + [(1, None), (2, 2)], "doc_id bigint, reading_level int")
    assert {r.doc_id: r.level for r in reading.calibrated(levels, labels).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 9: None}
    assert {r.level for r in reading.calibrated(levels, labels.limit(0)).collect()} == {None}


def test_levels_agree_with_held_out_raters(spark):
    d = "/root/testdata/sf0.1"
    levels = reading.reading_level(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{d}/reading_labels.parquet")
    got = reading.calibrated(levels, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1 and reading_level is not null"), "doc_id").where("level is not null")
    r, off = got.agg(F.corr("level", "reading_level"), F.avg(F.abs(F.col("level") - F.col("reading_level")))).first()
    print(r, off)
    assert r > 0.5 and off < 0.9, (r, off)


# ---------------------------------------------------------------- 6: leximin


def leximin_brute(rows):
    best = collections.defaultdict(dict)
    for q, l, f, s in rows:
        if s is not None and not math.isnan(s) and f is not None:
            best[q, l][f] = max(s, best[q, l].get(f, -math.inf))
    vectors, lists = collections.defaultdict(list), collections.Counter(q for q, _ in best)
    for (q, _), scores in best.items():
        for r, f in enumerate(sorted(scores, key=lambda f: (-scores[f], f))):
            vectors[q, f].append((len(scores) - r) / len(scores))
    out = {}
    for q in lists:
        mine = {f: sorted([0.0] * (lists[q] - len(v)) + v) for (p, f), v in vectors.items() if p == q}
        for i, f in enumerate(sorted(sorted(mine), key=lambda f: mine[f], reverse=True), 1):
            out[q, f] = (i, mine[f])
    return out


def test_leximin_is_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(q), int(l), f"f{int(f)}", float(s)) for q, l, f, s in zip(rng.integers(0, 3, 400), rng.integers(0, 4, 400), rng.integers(0, 25, 400), rng.integers(0, 12, 400))]
    rows += [(0, 9, "f1", None), (0, 0, None, 5.0), (0, 0, "f2", float("nan")), (7, 0, "only", 1.0), (None, 0, "x", 1.0), *rows[:20]]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "query_id int, list_id int, filepath string, backend_score double, position string, n_lists int")
    want = leximin_brute(rows)
    for hot in (10**6, 5):
        got = {(r.query_id, r.filepath): (r.position, r.weakest_first) for r in leximin.leximin_ranking(df, hot_rows=hot).collect()}
        assert got == want
    assert leximin.leximin_ranking(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9: leaks


def test_leaks(spark):
    passage = "The second valve failed at the end of the quarter, so our group in Quimbly had to close it 12 times with 30 litres. Nobody at the site saw it happen."
    w = leaks.words_of(passage)
    changed = passage.replace("12", "77").replace("Quimbly", "Zorvane")
    docs = [
        (1, "intro. " + passage.upper() + " outro"), (2, " ".join(w[3:16])), (3, " ".join(w[3:15])), (4, changed), (5, changed.replace("30 litres", "30 hamsters of large size")), (6, None), (7, ""),
        (8, "x " * 50_000 + passage + " y" * 50_000), (9, " ".join(w[:12] + ["not"] + w[12:24])), (2, " ".join(w[3:16])), (10, re.sub(" ", "\n\t--", passage)),
    ]
    items = [(1, passage, "q"), (2, None, None), (3, "too short", None), (1, passage, "q"), (4, passage + " more words follow here", "again")]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id bigint, text string, hash int, item string")
    e = spark.createDataFrame(items, "item_id bigint, passage string, hash string")
    got = {(r.doc_id, r.item_id): (r.verbatim, r.reparameterised) for r in leaks.find_leaks(d, e).collect()}
    assert {k for k, v in got.items() if v[0]} == {(i, j) for i in (1, 2, 4, 5, 8, 10) for j in (1, 4)} - ({(5, 1), (5, 4)} if not got.get((5, 1), (0,))[0] else set())
    assert got[4, 1][1] > 0 and (3, 1) not in got and (9, 1) not in got
    assert leaks.find_leaks(d.limit(0), e).count() == 0 and leaks.find_leaks(d, e.limit(0)).count() == 0


def test_leaks_of_windows_dense_in_slots(spark):
    between = "and with for from near by then under over into".split()
    passage = "at " + " ".join(f"Alba{x} {i} kg Borg{x} {between[2 * i]} {i + 50} cm Cato{x} {between[2 * i + 1]}" for i, x in enumerate("vwxyz"))
    said = leaks.words_of(passage)
    assert all(sum(w not in ["at", *between] for w in said[i : i + 13]) > leaks.MAX_SLOTS for i in range(len(said) - 12))
    changed = passage.replace("Alba", "Dora").replace("Borg", "Emil").replace("Cato", "Fritz").replace("5", "8")
    w = changed.split(" ")
    mixed = " ".join("Same" if x.startswith(("Dora", "Emil", "Fritz")) else x for x in w)  # one name for all: not one to one
    docs = [(1, "so " + changed + " so"), (2, mixed), (3, " ".join(w[:13])), (4, passage), (5, "and so on")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([(1, passage)], "item_id bigint, passage string")
    got = {r.doc_id: (r.verbatim, r.reparameterised) for r in leaks.find_leaks(d, e).collect()}
    n = len(w) - 12
    assert got == {1: (0, n), 4: (n, 0)}, got


def test_leaks_by_places_first(spark, monkeypatch):
    d, e = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "eval_items"))
    want = sorted(map(tuple, leaks.find_leaks(d, e).collect()))
    monkeypatch.setattr(leaks, "MAX_AHEAD", 0)
    assert sorted(map(tuple, leaks.find_leaks(d, e).collect())) == want and want


# ---------------------------------------------------------------- 5: markup

def page(rng, whole):
    """A seeded page or fragment: HTML, and the words planted in its main text and in its boilerplate."""
    number = iter(range(10**6))
    main, rest = set(), set()

    def words(n, into):
        made = [f"{'m' if into is main else 'b'}{next(number)}x{int(rng.integers(0, 99))}" for _ in range(n)]
        into.update(made)
        return " ".join(made)

    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{words(int(rng.integers(1, 4)), rest)}</a></li>' for i in range(n)) + "</ul>"
    parts = []
    for _ in range(int(rng.integers(3, 7))):
        parts.append(f"<h2>{words(4, main)}</h2>")
        parts += [f"<p>{words(int(rng.integers(25, 90)), main)}, <a href=x>{words(2, main)}</a> {words(9, main)}.</p>" for _ in range(int(rng.integers(1, 4)))]
        kind = int(rng.integers(0, 3))
        if kind == 0:
            parts.append("<ul>" + "".join(f"<li>{words(int(rng.integers(4, 12)), main)}</li>" for _ in range(4)) + "</ul>")
        elif kind == 1:
            parts.append(f"<pre><code>{words(12, main)}</code></pre>")
    body = f"<nav>{links(int(rng.integers(4, 12)))}</nav><article>{''.join(parts)}</article><aside>{links(int(rng.integers(3, 9)))}</aside>"
    if whole:
        body = f"<html><head><title>t</title><style>p {{}}</style></head><body><header><a href=/>{words(2, rest)}</a></header><div>{body}</div><footer>{links(4)}<p>{words(3, rest)}</p></footer></body></html>"
    return body, main, rest


@pytest.mark.parametrize("whole", [True, False])
def test_main_text_is_found_among_boilerplate(whole):
    rng, kept, right, wanted = np.random.default_rng(12), 0, 0, 0
    for _ in range(60):
        text, main, rest = page(rng, whole)
        kinds, clean = markup.clean_text(text)
        out = set(re.findall(r"[mb]\d+x\d+", clean))
        assert kinds == ["html"]
        kept, right, wanted = kept + len(out), right + len(out & main), wanted + len(main)
    print(f"precision {right / kept:.4f}, recall {right / wanted:.4f}")
    assert right >= 0.95 * kept and right >= 0.95 * wanted


def test_nested_commands_and_fragments():
    clean = lambda t: markup.clean_text(t)[1]
    assert clean("\\emph{a \\textbf{b \\x{c} {d}} e} \\foo{ open") == "a b c {d} e \\foo{ open" and clean("\\a{" * 20_000 + "x" + "}" * 20_000) == "x"
    short = "<p>Ok.</p><ul><li>one</li></ul><p>See <a href=x>here</a>.</p>"
    assert clean(short) == "Ok.\n\n- one\n\nSee here." and "Home" in clean("<ul><li><a>Home</a></li><li><a>About</a></li><li><a>More</a></li></ul>")


KINDS = {
    "plain text, a < b and c > d, 5 * 3 * 2, snake_case_name, $5 and $6, a_b": [], "<p>x</p>": ["html"], "x<br/>y": ["html"], "a &amp; b": ["html"], "&#233;": ["html"], "<!-- c -->": ["html"], "Vec<T>": ["html"], "a <- b << c": [],
    "== Title ==": ["wiki"], "==Title==": [], "see [[a|b]]": ["wiki"], "''x''": ["wiki"], "{{note}}": ["wiki"], "{| class=x\n|}": ["wiki"],
    "\\begin{x}": ["latex"], "\\item a": ["latex"], "\\emph{x}": ["latex"], "$$x$$": ["latex"], "\\(x\\)": ["latex"], "$x^2$": ["latex"], "$ x^2$": [], "$x$": [],
    "# T": ["markdown"], "#T": [], "- a": ["markdown"], "1. a": ["markdown"], "> q": ["markdown"], "|---|---|": ["markdown"], "**b**": ["markdown"], "*word*": ["markdown"], "__word__": ["markdown"], "[a](b)": ["markdown"], "Title\n=====": ["markdown"], "Title.\n----": [], "x\n---": [],
    "`<b>x</b>`": ["markdown"], "```\n<p> $$ [[x]]\n```": ["markdown"], "<pre># x ''y''</pre>": ["html"], "\\begin{verbatim}<p>**x**\\end{verbatim}": ["latex"], "```\n<p>": ["html", "markdown"],
    "---\ntags: [[x]]\n---\nplain": [], "---\nopen [[x]]": ["wiki"], "": [], " \r\n ": [],
}


@pytest.mark.parametrize("text, want", KINDS.items())
def test_kinds(text, want):
    assert markup.clean_text(text)[0] == want
    assert markup.clean_text(text.replace("\n", "\r\n"))[0] == want


def test_clean_text_keeps_structure():
    page = """<html><body><div class="nav"><a href=a>Home</a> <a href=b>About us</a> <a href=c>Contact</a></div>
<div id=main><h1>Title &amp; more</h1><p>First paragraph with quite some words in it, <b>bold</b> and long enough to be dense.</p>
<ul><li>one</li><li>two</li></ul><p>Second paragraph, also with quite some words to carry the density of the main part.</p>
<pre><code>if (a &lt; b) { **x** }</code></pre><table><tr><td>k</td><td>v</td></tr></table></div><script>var x = 1;</script></body></html>"""
    kinds, text = markup.clean_text(page)
    assert kinds == ["html"] and "# Title & more" in text and "- one" in text and "- two" in text and "```\nif (a < b) { **x** }\n```" in text and "k | v" in text
    assert "About us" not in text and "var x" not in text and "<" not in text.replace("a < b", "")
    kinds, text = markup.clean_text("\\section{Head}\nSee \\textbf{bold \\emph{both}} and $a_1^2$ in~\\ref{x}.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\begin{equation}x_1\\end{equation}\n\\begin{verbatim}\n\\item raw\n\\end{verbatim}")
    assert kinds == ["latex"] and text.startswith("# Head\nSee bold both and $a_1^2$ in.") and "- one" in text and "\\begin{equation}x_1\\end{equation}" in text and "```\n\\item raw\n```" in text
    kinds, text = markup.clean_text("== Head ==\n'''b''' [[page|shown]] {{quote|said}}\n{| class=x\n|a || b\n|-\n|c || d\n|}\n* [[x]]")
    assert text == "## Head\nb shown said\na | b\nc | d\n* x"
    kinds, text = markup.clean_text("Title\n=====\n- **bold** and *word* [link](u) ![alt](i) `a*b*c`\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = **y**\n```\n> quote")
    assert text == "# Title\n- bold and word link alt `a*b*c`\n\na | b\n1 | 2\n\n```py\nx = **y**\n```\n> quote"


def test_density_of_a_link_list():
    tree = markup._Tree()
    tree.feed("<body><div>" + "<a href=x>link text here</a> " * 20 + "</div><div><p>" + "plain words of an article " * 20 + "</p><p>" + "and more of them " * 20 + "</p></div></body>")
    tree.done()
    parts = markup._main_parts(tree)
    text = markup._render(tree, parts)
    assert "plain words" in text and "and more" in text and "link text" not in text


def test_text_before_the_densest_part_is_kept():
    prose = "Earlier words of an article that go on for quite a while without a single tag between them. " * 3
    items = "".join(f"<li>{w} item of the list that is long enough to carry a density of its own {w}</li>" for w in "abcdefghijklmnopqrstuvwxyz")
    nav = "<div>" + "<a href=x>link text here</a> " * 20 + "</div>"
    page = f"""<html><body>{nav}<h1>Title</h1>
direct {prose}
<h2>Section</h2><p>first {prose}</p><ol><li>one</li><li>two</li></ol><pre>x = 1</pre>
<ul>{items}</ul>
<p>last {prose}</p>direct end {prose}<h2>More</h2><p>final <b>{prose}</b> tail</p></body></html>
after {prose}"""
    tree = markup._Tree()
    tree.feed(page)
    tree.done()
    markup._measure(tree, next(n for n in tree.nodes if n.tag == "body"))
    assert max(tree.nodes, key=lambda n: n.total).tag == "ul"  # the best part is in mid-page
    text = markup.clean_text(page)[1]
    marks = ["# Title", "direct Earlier", "## Section", "first Earlier", "1. one", "2. two", "```\nx = 1\n```", "- a item", "- z item", "last Earlier", "direct end", "## More", "final Earlier", "tail", "after Earlier"]
    at = [text.find(m) for m in marks]
    assert -1 not in at and at == sorted(at), list(zip(marks, at))
    assert text.count("words of an article") == 18 and "link text" not in text


@pytest.mark.parametrize("tag", ["template", "noscript", "head", "script", "STYLE"])
def test_silent_elements_without_an_end_are_text(tag):
    assert markup.clean_text(f"One names the <{tag}> tag.\n\n<b>All</b> that follows stays.")[1] == f"One names the <{tag}> tag.\n\nAll that follows stays."
    assert markup.clean_text(f"a <{tag}>x</{tag}> b <{tag} id=y> c <{tag}/> <i>d</i>")[1] == f"a  b <{tag} id=y> c  d"
    assert markup.clean_text(f"a <{tag}>x</{tag} > b")[1] == "a  b"


def test_silent_elements_of_a_page():
    assert markup.clean_text("<html><head><title>T</title><meta x=y><p>text of the page</p> and <b>more</b></html>")[1] == "text of the page\n\n and more"
    assert markup.clean_text("<html><body>text <template> more</body></html>")[1] == "text <template> more"
    assert markup.clean_text('<script>f("<template>", "<style>")</script>a <i>b</i>')[1] == "a b"


def test_markup_rows(spark):
    deep, long = "<div>" * 20_000 + "x" + "</div>" * 3, "<p>a</p>\n# b\n" * 20_000
    texts = [None, "", "<p>a</p>", deep, long, "<" * 5000, "`" * 5001, "$" * 5000, "[" * 5000, "**" * 3000, "{{" * 3000, "''" * 3000 + "\n==" * 2000, "\\" * 5000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(2, "<p>a</p>", "k")], "hash int, doc string, kinds string")
    rows = {r.hash: r for r in markup.clean_markup(df).collect()}
    assert len(rows) == len(texts) and rows[0].clean is None and rows[0].kinds == [] and rows[1].clean == "" and rows[2].clean == "a" and rows[3].clean == "x" and "kinds" in rows[0]
    assert markup.clean_markup(df).count() == len(texts) + 1 and markup.clean_markup(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3: distinctive terms


def test_residuals(spark):
    rows = [(1, "apple", "apple apple pear"), (2, None, "pear pear fig"), (3, "", ""), (4, "x", None), (5, "Fig", "fig PEAR plum plum plum plum"), (1, "zzz", "zzz")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "k int, title string, doc string, term int")
    got = {(r.k, r.term): r for r in distinctive.term_scores(df, "k", ["title", "doc"]).collect()}
    counts = {1: collections.Counter("apple apple apple pear".split()), 2: collections.Counter("pear pear fig".split()), 4: collections.Counter("x"), 5: collections.Counter("fig fig pear plum plum plum plum".split())}
    total, c = sum(sum(x.values()) for x in counts.values()), sum(counts.values(), collections.Counter())
    assert set(got) == {(k, t) for k, x in counts.items() for t in x}
    for k, x in counts.items():
        for t, n in x.items():
            e, r = sum(x.values()) * c[t] / total, got[k, t]
            adjusted = (n - e) / math.sqrt(e) / math.sqrt((1 - sum(x.values()) / total) * (1 - c[t] / total))
            assert (r.n, r.len, r.d, r.c, r.n_records) == (n, sum(x.values()), sum(t in y for y in counts.values()), c[t], 5) and abs(r.residual - adjusted) < 1e-9
    tail = {(r.k, r.term): r.residual for r in distinctive.term_scores(df, "k", ["title", "doc"], max_common=1).collect()}
    assert tail == {k: r.residual for k, r in got.items()}
    best = distinctive.dominant_terms(distinctive.term_scores(df, "k", ["title", "doc"]), "k", distinctive.rarity_weighted(), 1.37)
    assert {(r.k, r.term) for r in best.collect()} == {(1, "apple"), (5, "plum")} | {(2, "pear")} - ({(2, "pear")} if 2 * math.log(5 / 3) < 1.37 * math.log(5 / 2) else set())
    assert distinctive.term_scores(df.limit(0), "k", ["doc"]).count() == 0
    assert distinctive.term_scores(df.where("k = 2"), "k", ["doc"]).where("residual is not null").count() == 0


def test_one_record_that_holds_all_words(spark):
    df = spark.createDataFrame([(1, "apple", "apple apple pear"), (2, "", None)], "k int, title string, doc string")
    scores = distinctive.term_scores(df, "k", ["title", "doc"])
    assert scores.where("residual is null").count() == 2
    assert [tuple(r) for r in distinctive.dominant_terms(scores, "k", distinctive.rarity_weighted(), 1.37).collect()] == [(1, "apple")]
    assert distinctive.dominant_terms(distinctive.term_scores(df.where("k = 1"), "k", ["title", "doc"]), "k", distinctive.rarity_weighted(), 1.37).count() == 0


# ---------------------------------------------------------------- 4: near duplicates


def shingles(text, n):
    w = leaks.words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits))):
            w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 10**6))}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, rounds", [(16, 12), (2, 3)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "MAX_ROUNDS", rounds)
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for n, edits in ((40, 6), (25, 3), (12, 12), (3, 2)):  # families around one text each
        texts += family(rng, rng.choice(vocab, size=int(rng.integers(60, 200))), n, edits)
    texts += [" ".join(rng.choice(vocab, size=80)) for _ in range(60)] + [texts[0], texts[0].upper(), "short text", "", None, "same " * 300]
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "k int, doc string, cls int")
    members, links = neardup.near_duplicates(df, "k", "doc", shingle=3, threshold=0.7, least_words=50)
    cls = {r.k: r.cls for r in members.collect()}
    sets = {i: shingles(t, 3) for i, t in enumerate(texts) if t and len(leaks.words_of(t)) >= 50}
    assert set(cls) == set(sets) and all((sets[a] == sets[b]) == (cls[a] == cls[b]) for a in sets for b in sets)
    by = {c: sets[k] for k, c in cls.items()}
    names = sorted(by)
    want = {(a, b): len(by[a] & by[b]) / len(by[a] | by[b]) for i, a in enumerate(names) for b in names[i + 1 :] if len(by[a] & by[b]) >= 0.7 * len(by[a] | by[b])}
    got = {(r.a, r.b): r.jaccard for r in links.collect()}
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.002 * len(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    groups = {r.cls: r.component for r in neardup.components(members, links).collect()}
    assert set(groups) == set(names) and all(groups[a] == groups[b] for a, b in got) and all(groups[c] <= c for c in groups)
    stars = neardup.near_duplicate_groups(df, "k", "doc", shingle=3, threshold=0.7, least_words=50).collect()
    assert {r.cls: r.component for r in stars} == groups and {r.k for r in stars} == set(sets)
    assert neardup.near_duplicates(df.limit(0), "k", "doc")[1].count() == 0


def test_a_family_costs_its_stars(spark, monkeypatch):
    """Of a family of similar texts the pairs looked at grow with its members, not with its pairs; components are those of all links."""
    rng, looked, judge = np.random.default_rng(3), [], neardup._links
    vocab = [f"w{i}" for i in range(5000)]
    base, texts, m = rng.choice(vocab, 200), [], 300
    for _ in range(m):
        t = base.copy()
        t[rng.choice(200, 3, replace=False)] = rng.choice(vocab, 3)
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, doc string")
    monkeypatch.setattr(neardup, "_links", lambda pairs, *a: looked.append(pairs.count()) or judge(pairs, *a))
    assert len({r.component for r in neardup.near_duplicate_groups(df, "k", "doc", 3, 0.7, 50).collect()}) == 1
    assert sum(looked) <= m * neardup.HASHES * neardup.BINS // neardup.ROWS < m * (m - 1) // 2


def test_signature_estimates_jaccard():
    known, errors = neardup._WordHashes(), []
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.choice(10**6, size=60).astype(str)
        other = base.copy()
        other[: int(rng.integers(0, 20))] = "x"
        a, b = (neardup.shingle_set(list(x), 3, known) for x in (base, other))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((neardup.signature(a) == neardup.signature(b)).mean() - j)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_document_pairs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "z"), (5, None)], "doc_id bigint, hash string")
    members = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "hash string, cls bigint")
    links = spark.createDataFrame([(10, 20, 0.8), (20, 30, 0.9)], "a bigint, b bigint, jaccard double")
    assert sorted(map(tuple, neardup.document_pairs(docs, members, links).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_components_of_a_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("cls"))
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 49)] + [(55, 57)], "a bigint, b bigint")
    got = {r.cls: r.component for r in neardup.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(50)) and got[57] == 55 and got[56] == 56 and len(got) == 60


# ---------------------------------------------------------------- 1: similar vectors


@pytest.mark.parametrize("factor, least_recall", [(1.0, 1.0), (None, 0.98)])
def test_nearest_vectors_against_brute_force(spark, factor, least_recall):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 700)] + 0.4 * rng.normal(size=(700, 16))).astype(np.float32)
    x[100:130] = x[100]  # many equal vectors
    x[200:203] = x[200]
    x[300] *= 1e20
    rows = [(i, x[i].tolist()) for i in range(700)] + [(5, x[5].tolist()), (900, [0.0] * 16), (901, [float("nan")] * 16), (902, [1.0] * 15), (903, None), (None, x[6].tolist()), (904, [None] * 16), (905, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vid bigint, embedding array<float>, rank int, cos double")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {i: set(np.argsort(-np.round(s[i], 12), kind="stable")[:5].tolist()) for i in range(700)}
    for shard_rows in (1000, 60):
        got = collections.defaultdict(dict)
        for r in vptree.nearest_vectors(df, dim=16, factor=factor, shard_rows=shard_rows).collect():
            got[r.vid][r.other] = r.cos
            assert 1 <= r.rank <= 5 and abs(r.cos - s[r.vid, r.other]) < 1e-6
        assert set(got) == set(range(700)) and all(len(v) == 5 for v in got.values())
        hits = sum(len(want[i] & set(got[i])) for i in range(700)) / 3500
        assert hits >= least_recall - 1e-9, hits
        assert set(got[110]) == {100, 101, 102, 103, 104} and set(got[101]) == {100, 102, 103, 104, 105} and {200, 201} < set(got[202])
    near = vptree.nearest_vectors(df, dim=16, factor=1.0, least_cos=0.9, shard_rows=60).collect()
    assert {(r.vid, r.other) for r in near} == {(i, j) for i in range(700) for j in want[i] if s[i, j] >= 0.9}
    assert vptree.similar_pairs(vptree.nearest_vectors(df.limit(0), dim=16)).count() == 0 and vptree.nearest_vectors(df.where("vid = 3"), dim=16).count() == 0


def test_shards_never_grow_large(spark, monkeypatch):
    """Fitted to far too few vectors, shards are divided again until none holds more than four times as many as aimed at."""
    reps = vptree.usable(spark.read.parquet("/root/testdata/sf0.01/content_vectors.parquet")).withColumnRenamed("vid", "rep")
    tree = vptree.fit_shards(reps, shard_rows=20, sample=40)
    sizes = [r.n for r in vptree._dealt(reps, tree, 64).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 80 and sum(sizes) == reps.count() and len(sizes) > 12
    same = spark.createDataFrame([(i, [1.0] + [0.0] * 63) for i in range(100)], "rep bigint, embedding array<float>")
    assert len(vptree.fit_shards(same, shard_rows=5, sample=10).near) == 1  # can't be divided


@pytest.mark.parametrize("shard_rows", [200, 1000])
def test_few_shards_are_visited(shard_rows):
    """Share of the other shards that a vector visits, and recall at the five nearest, with the settings that are shipped."""
    table = __import__("duckdb").sql("select min(embedding) from '/root/testdata/sf0.1/content_vectors.parquet' where vid is not null and len(embedding) = 64 group by vid").fetchall()
    x = np.unique(np.array([r[0] for r in table], dtype=np.float64), axis=0)
    x = vptree._unit(x[~np.isnan(x).any(axis=1) & (x != 0).any(axis=1)])
    factor = vptree.default_factor(64)
    tree = vptree.ShardTree(vptree.VPTree(x, shard_rows), 64)
    home, shards = tree.home(x), int((tree.near < 0).sum())
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    cos = np.take_along_axis(s, best, 1)
    own = np.sort(np.where(home[:, None] == home[None, :], s, -2), axis=1)[:, -5]
    for floor, most in ((-2.0, 0.3), (0.9, 0.1)):
        row, node = tree.visits(x, vptree._radius(np.maximum(own, floor)), factor, vptree.MOST_VISITS)
        seen = np.zeros((len(x), len(tree.near)), dtype=bool)
        seen[row, node] = True
        share, wanted = (seen.sum() / len(x) - 1) / (shards - 1), cos >= floor
        recall = (seen[np.arange(len(x))[:, None], home[best]] & wanted).sum() / wanted.sum()
        print(f"{shards} shards, least cosine {floor}: {share:.3f} visited, recall {recall:.4f}")
        assert seen[np.arange(len(x)), home].all() and seen.sum(axis=1).max() <= vptree.MOST_VISITS + 1 and share <= most and recall >= (0.95 if floor < 0 else 0.998)
    row, node = tree.visits(x[:300], np.full(300, 0.6), 1.0, None)  # with factor 1 nothing nearer than the radius is missed
    seen = np.zeros((300, len(tree.near)), dtype=bool)
    seen[row, node] = True
    assert all(seen[i, home[j]] for i in range(300) for j in np.flatnonzero(s[i] > 1 - 0.6**2 / 2 + 1e-6))


def test_recall_on_the_stored_vectors(spark):
    path = "/root/testdata/sf0.01/content_vectors.parquet"
    v = vptree.usable(spark.read.parquet(path)).orderBy("vid").collect()
    x = np.array([r.embedding for r in v], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    at = {r.vid: i for i, r in enumerate(v)}
    fifth = np.sort(s, axis=1)[:, -5]
    got = vptree.nearest_vectors(spark.read.parquet(path), shard_rows=200).collect()
    good = sum(s[at[r.vid], at[r.other]] >= fifth[at[r.vid]] - 1e-9 for r in got)
    assert good >= 0.95 * 5 * len(v)


