"""Encoding a corpus with a byte-level BPE vocabulary.

Distinct words go into a trie of bytes whose every node keeps the last token of the encoding of its prefix. That token follows
from the nodes above: among the vocabulary entries that are suffixes of the prefix, exactly one may stand after the last token
of the prefix before it. So the encoding of a prefix shared by many words is found once, and a word's ids are read by walking
back from its node. Words are taken in sorted order, which is the depth-first order of the trie.

The trie lives in the Python worker; documents aren't shuffled. It is emptied when it has ``MAX_NODES`` nodes, which bounds
memory and changes no result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.plans.arrow import by_slice
from cairn.plans.spread import spread

#: The public split pattern of byte_bpe_50k.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MAX_NODES = 400_000
#: Words kept with their ids for reuse are at most so many bytes long, so that the memory of MAX_NODES entries is bounded.
KEPT_BYTES = 64


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable ones stand for themselves, the others for 256, 257, ..."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]]]:
    """Token bytes to id, and merges (left id, right id, merged id) in order of rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        left, right = (bytes(letters[c] for c in x) for x in (a, b))
        merges.append((ids[left], ids[right], ids[left + right]))
    made = {c for _, _, c in merges}
    # a token that no merge makes and that isn't a byte can't come out of BPE: special tokens are plain text here
    return {t: i for t, i in ids.items() if len(t) == 1 or i in made}, merges


class TrieEncoder:
    """Ids of words by one vocabulary. Not thread-safe; one per worker."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.ids = ids
        # lengths of the tokens that may end a prefix, by its last three bytes, longest first
        ending: dict[bytes, set[int]] = {}
        for t in ids:
            if len(t) >= 3:
                ending.setdefault(t[-3:], {1, 2}).add(len(t))
        self.ending = {end: sorted(lengths, reverse=True) for end, lengths in ending.items()}
        self.rank = {t: -1 for t in ids.values()} | {c: r for r, (_, _, c) in enumerate(merges)}
        self.parts = {c: (a, b) for a, b, c in merges}
        self.joined = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}
        self.last, self.before = [-1], [0]
        self.words: dict[str, array] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE can leave ``a`` and ``b`` side by side: no merge across their border comes due before both are whole.

        Goes back in time: whichever of the two was made later is undone, and at each point the pair that then touched the
        border must not have a merge earlier than the step undone last.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, until = a, b, len(self.joined) + 1
        rank, parts, joined = self.rank, self.parts, self.joined
        result = True
        # Of equal ranks the left one is merged first, so a border pair of the same rank as a step at its right is too late
        # only if that step lies on the left: `until` is the first rank that is no obstacle.
        while True:
            r = joined.get((x, y))
            if r is not None and r < until:
                result = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                until, x = rx, parts[x][1]
            else:
                until, y = ry + 1, parts[y][0]
        self.fits[(a, b)] = result
        return result

    def _grow(self, word: bytes, path: list[int], shared: int) -> None:
        """Make ``path[i]`` the node of ``word[:i]``; the first ``shared`` bytes are there already."""
        children, last, before, ids, ending = self.children, self.last, self.before, self.ids, self.ending
        del path[shared + 1 :]
        node = path[-1]
        for i in range(shared, len(word)):
            key = node << 8 | word[i]
            child = children.get(key)
            if child is None:
                end = i + 1
                for length in ending.get(word[max(0, end - 3) : end], (2, 1)):
                    begin = end - length
                    token = ids.get(word[begin:end]) if begin >= 0 else None
                    if token is not None and (begin == 0 or self.may_follow(last[path[begin]], token)):
                        break
                child = children[key] = len(last)
                last.append(token)
                before.append(path[begin])
            path.append(child)
            node = child

    def learn(self, words: set[str]) -> dict[str, array]:
        """Ids of each word; all are valid until the next call."""
        if len(self.last) > MAX_NODES:
            self.reset()
        found = {w: self.words[w] for w in words if w in self.words}
        path, prior = [0], b""
        for text, word in sorted(((w.encode(), w) for w in words if w not in found)):
            if len(self.last) > MAX_NODES:  # nodes of this path stay usable only until a reset
                self.reset()
                path, prior = [0], b""
            shared, most = 0, min(len(text), len(prior))
            while shared < most and text[shared] == prior[shared]:
                shared += 1
            self._grow(text, path, shared)
            prior, node, out = text, path[-1], array("i")
            while node:
                out.append(self.last[node])
                node = self.before[node]
            out.reverse()
            found[word] = out
            if len(text) <= KEPT_BYTES:
                self.words[word] = out
        return found


def encode_corpus(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (all but ``text`` by default) and ``out``, the ids of ``text`` without special tokens.

    * null and empty text give an empty list; text that looks like a special token is plain text;
    * very long texts and words are encoded whole; repeated rows each give their row; an empty table gives none;
    * extra columns pass through; a column that already bears the name ``out`` is replaced.

    ``tokenizer`` is the path of the vocabulary file, which is read on the driver only. It has a fixed size and is broadcast.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in (text, out)]
    shipped = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = TrieEncoder(*shipped.value), regex.compile(SPLIT)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [split.findall(t) if t else [] for t in batch.column(len(kept)).to_pylist()]
            ids = encoder.learn(set(chain.from_iterable(parts)))
            flat, ends = array("i"), [0]
            for words in parts:
                flat.extend(chain.from_iterable(map(ids.__getitem__, words)))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), lists], names=[*kept, out])

        yield from by_slice(one)(batches)

    return spread(df.select(*kept, text)).mapInArrow(run, schema)
