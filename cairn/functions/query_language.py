"""The query language: typed lines (lex, vec, hyde, intent) or one text to expand; and the grammar of keyword queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TYPES = ("lex", "vec", "hyde")
_WORD = re.compile(r"[^\W_]+")
#: A quoted phrase or a run without white space, either of them negated by a minus sign before it.
_CLAUSE = re.compile(r'(?<!\S)(-?)"([^"]*)"|(?<!\S)(-?)([^\s"]+)|"([^"]*)"|([^\s"]+)')


@dataclass
class ParsedQuery:
    intent: str | None = None
    subqueries: list[tuple[str, str]] = field(default_factory=list)
    expand_text: str | None = None


def parse_query(raw: str | None) -> ParsedQuery:
    """Parse a query text.

    With a typed line the query is a document: typed lines in order, the first intent, all else dropped. Otherwise all lines,
    joined by a space, are one text to expand; a prefix ``expand:`` is dropped from a single line. Blank lines count nowhere.
    An intent without any other typed line is an error, since there is nothing to search for.
    """
    lines = [x.strip() for x in (raw or "").split("\n") if x.strip()]
    typed = [(kind, line[len(kind) + 1 :].strip()) for line in lines for kind in (*TYPES, "intent") if line.startswith(kind + ":")]
    if not typed:
        if len(lines) == 1 and lines[0].startswith("expand:"):
            return ParsedQuery(expand_text=lines[0][len("expand:") :].strip())
        return ParsedQuery(expand_text=" ".join(lines))
    intents = [text for kind, text in typed if kind == "intent"]
    found = [(kind, text) for kind, text in typed if kind != "intent"]
    if not found:
        raise ValueError("an intent needs a lex, vec or hyde line beside it")
    return ParsedQuery(intent=intents[0] if intents else None, subqueries=found)


@dataclass(frozen=True)
class Clause:
    """Terms that must stand side by side in one field; a single term stands alone."""

    terms: tuple[str, ...]
    negated: bool = False


def lex_clauses(text: str | None) -> list[Clause]:
    """Clauses of a keyword query: ``word``, ``"some phrase"``, ``-word``, ``-"some phrase"``.

    A word that holds several terms (a version number, a hyphenated word) is a phrase. Other punctuation separates. Repeated
    words are repeated clauses. Nothing is an error; text without terms has no clauses.
    """
    out = []
    for m in _CLAUSE.finditer(text or ""):
        minus = m[1] or m[3] or ""
        words = next(x for x in (m[2], m[4], m[5], m[6]) if x is not None)
        terms = tuple(t for t in _WORD.findall(words.replace("İ", "i").lower()) if len(t.encode()) < 40)
        if terms:
            out.append(Clause(terms, minus == "-"))
    return out


def expansion_prompt(query: str, intent: str | None = None) -> str:
    """A request to a generating backend for further searches, in the form that :func:`parse_expansion` reads."""
    about = f" The aim is: {intent}." if intent else ""
    return f"Write searches for documents that answer the question below.{about}\nGive one line each: 'lex: <keywords>', 'vec: <a sentence>', 'hyde: <a passage that answers it>'.\nQuestion: {query}\n"


def parse_expansion(text: str | None) -> list[tuple[str, str]]:
    """Typed lines of a backend's answer; others and empty ones are left out."""
    lines = [x.strip() for x in (text or "").split("\n")]
    return [(kind, line[len(kind) + 1 :].strip()) for line in lines for kind in TYPES if line.startswith(kind + ":") and line[len(kind) + 1 :].strip()]
