"""Evaluation passages inside a training corpus, also with other numbers, names and units.

Words become a template: numbers, units and names turn into typed placeholders, other words stay. The type follows from the
lower-cased word alone, so equal words have equal templates: a word with a digit is a number; a word of the list of units is a
unit; a word stays that the passages write in lower case somewhere, or with a capital only where a sentence begins; any other word
is a name. Windows of the template are hashed; corpus windows meet the passages' windows in an equi join on the hash. Slots decide
what a meeting means: all words equal is a verbatim window; slots replaced one to one is a re-parameterised one. A window of very
many slots needs the words around it as well.

What every task must know of the passages, which words stay and which hashes occur, is sent in two bit sets of fixed size, whatever
the number of items. A word that is taken for one that stays by chance of its bits (about one in 1e4 at half a million words) is
taken so everywhere; a window that passes by chance meets nothing in the join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.arrow import sliced
from cairn.plans.lineage import cut
from cairn.plans.skew import salted_join
from cairn.plans.spread import spread

WINDOW = 13
#: Words taken for units.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms tonne tonnes ton tons lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent pct degree degrees celsius fahrenheit volt volts watt watts byte bytes kb mb gb tb euro euros dollar dollars cent cents unit units row rows page pages"
).split()
#: Bits of the sets of words and of windows (2 and 32 MB), and bits set by each member.
WORD_BITS, WINDOW_BITS, MARKS = 1 << 24, 1 << 28, 3
#: Up to so many passage windows few others pass, and words go along with what passes; beyond, only places are exchanged and words are
#: fetched for those that met.
MAX_AHEAD = 20_000_000
#: A re-parameterised window may have at most so many slots: others say too little alone, and are held against the windows that
#: adjoin them, up to REACH words to each side.
MAX_SLOTS, REACH = 6, 2 * WINDOW

_WORD = re.compile(r"[^\W_]+")
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SLOTS = np.array([_NUMBER, _UNIT, _NAME])
_BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a mark that would split the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class BitSet:
    """A set of 64-bit hashes in a fixed number of bits; members are always found, others rarely."""

    CHUNK = 1 << 16  # bytes

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits = bits
        self.packed = np.zeros(bits // 8, dtype=np.uint8)
        for at, blob in chunks.items():
            part = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
            self.packed[at * self.CHUNK : at * self.CHUNK + len(part)] = part

    def __getstate__(self) -> tuple[int, bytes]:
        return self.bits, zlib.compress(self.packed.tobytes(), 1)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.bits = state[0]
        self.packed = np.frombuffer(zlib.decompress(state[1]), dtype=np.uint8)

    @staticmethod
    def places(h: np.ndarray, bits: int, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)

    def among(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of what passes."""
        at = np.arange(len(h))
        for i in range(MARKS):
            p = self.places(h[at], self.bits, i)
            at = at[(self.packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
        return at

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> BitSet:
        """The set of the column h. Each piece is made in a task of its own; the driver puts the pieces, compressed, side by side."""

        def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                p = np.concatenate([cls.places(h, bits, i) for i in range(MARKS)])
                yield pa.RecordBatch.from_arrays([pa.array((p // (8 * cls.CHUNK)).astype(np.int32)), pa.array((p % (8 * cls.CHUNK)).astype(np.int32))], names=["chunk", "bit"])

        def pack(table: pa.Table) -> pa.Table:
            marks = np.zeros(8 * cls.CHUNK, dtype=bool)
            marks[table.column("bit").to_numpy()] = True
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([zlib.compress(np.packbits(marks, bitorder="little").tobytes())], pa.binary())})

        places = hashes.select("h").mapInArrow(spread_out, "chunk int, bit int").distinct()
        return cls(bits, {r.chunk: bytes(r.bits) for r in places.groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect()})  # at most bits / 8 bytes


class Codes(dict):
    """Code of each word in a template; unknown words are looked at once."""

    def __init__(self, own: BitSet):
        super().__init__(dict.fromkeys(UNITS, _UNIT))
        self.own, self.known = own, len(self)

    def __missing__(self, word: str) -> np.uint64:
        if any(c.isnumeric() for c in word):
            code = _NUMBER
        else:
            h = np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64)
            code = h[0] if len(self.own.among(h)) else _NAME
        if len(self) < self.known + 200_000 and len(word) <= 40:  # bounds memory only
            self[word] = code
        return code


def _windows(lists: list[list[str]], codes: Codes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all full windows: row, begin in the row, hash; and the codes of all words in one array."""
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.fromiter((codes[w] for x in lists for w in x), dtype=np.uint64, count=int(lengths.sum()))
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    row = np.repeat(np.arange(len(lists)), np.maximum(lengths - size + 1, 0))
    if not len(row):
        return row, row, np.empty(0, np.uint64), flat
    begins = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(lengths - size + 1, 0))))[:-1], np.maximum(lengths - size + 1, 0))
    total = len(flat) - size + 1
    h = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        h *= _BASE
        h += flat[j : j + total]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return row, begins, h[starts[row] + begins], flat


def _tagged(words: list[str], codes: Codes) -> str:
    """The words joined by spaces, each after a sign for its kind in a template."""
    sign = {_NUMBER: "#", _UNIT: "@", _NAME: "~"}
    return " ".join(sign.get(codes[w], "=") + w for w in words)


def _agree(held: str | None, at: int, asked: str | None, begin: int, size: int) -> bool:
    """Whether the window lies in a stretch of adjoining windows with equal templates, slots replaced one to one over all of it, and
    as many words outside slots as a window with MAX_SLOTS slots has.

    ``held`` and ``asked`` are tagged words around the window, which begins at word ``at`` and ``begin`` of them.
    """
    if held is None or asked is None:
        return False
    a, b = held.split(" "), asked.split(" ")
    same = lambda j: 0 <= at + j < len(a) and 0 <= begin + j < len(b) and (a[at + j] == b[begin + j] if b[begin + j][0] == "=" else a[at + j][0] == b[begin + j][0])

    def add(j: int, there: dict[str, str], back: dict[str, str]) -> bool:
        x, y = a[at + j], b[begin + j]
        return y[0] == "=" or there.setdefault(x, y) == y and back.setdefault(y, x) == x

    there, back = {}, {}
    if not all(same(j) and add(j, there, back) for j in range(size)):
        return False
    first = 0
    while True:  # from each beginning as far to the right as slots stay consistent
        t, u, end = dict(there), dict(back), size
        while same(end) and add(end, t, u):
            end += 1
        if sum(b[begin + j][0] == "=" for j in range(first, end)) >= size - MAX_SLOTS:
            return True
        first -= 1
        if not (same(first) and add(first, there, back)):
            return False


def _judge(size: int) -> Callable:
    @F.pandas_udf("boolean")
    def judge(held: pd.Series, at: pd.Series, asked: pd.Series, begin: pd.Series) -> pd.Series:
        return pd.Series([_agree(h, int(i), a, int(j), size) if h is not None and a is not None else False for h, i, a, j in zip(held, at, asked, begin)], dtype=bool)

    return judge


_SCHEMA = "hash bigint, words string, slots array<boolean>"


def own_words(items: DataFrame, passage: str) -> DataFrame:
    """h: hashes of the words that stay in a template: those that the passages write in lower case somewhere, or capitalised nowhere but
    at the beginning of a text or after an end mark and white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = {}
            for text in batch.column(0).to_pylist():
                for m in _WORD.finditer(text or ""):
                    w = m.group()
                    low = w.lower()
                    opens = w != low and re.search(r"(?:\A|[.!?][\"')\]]*\s)[^\w]*\Z", text[max(0, m.start() - 8) : m.start()]) is not None
                    was = said.get(low, (False, False))
                    said[low] = (was[0] or w == low, was[1] or (w != low and not opens))
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in said], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([a for a, _ in said.values()], pa.bool_()), pa.array([b for _, b in said.values()], pa.bool_())], names=["h", "lower", "inside"])

    each = items.select(passage).mapInArrow(run, "h bigint, lower boolean, inside boolean")
    return each.groupBy("h").agg(F.bool_or("lower").alias("lower"), F.bool_or("inside").alias("inside")).where("lower or not inside").select("h")


def template_windows(df: DataFrame, key: str, text: str, own: BitSet, size: int = WINDOW, only: BitSet | None = None, slots: bool = False, places: bool = False, at: str | None = None) -> DataFrame:
    """Windows of ``text``: key, hash of the template, the words joined by spaces and, with ``slots``, which of them are slots.

    Windows of more than MAX_SLOTS slots also have ``around``, the tagged words from up to REACH words before to REACH after, and
    ``at``, their place in it; others have null and 0. With ``places`` there are key, hash and begin (number of the first word) alone.

    ``own`` are the words that stay in a template; ``only`` keeps windows whose hash is among these, ``at`` names a column with an array
    of the begins to keep. Null, empty and shorter texts give no rows.
    """
    shipped = df.sparkSession.sparkContext.broadcast((own, only))
    if places:
        fields = [T.StructField("hash", T.LongType()), T.StructField("begin", T.IntegerType())]
    else:
        fields = [T.StructField("hash", T.LongType()), T.StructField("words", T.StringType()), T.StructField("around", T.StringType()), T.StructField("at", T.IntegerType())]
        fields += ([T.StructField("slots", T.ArrayType(T.BooleanType()))] if slots else [])
    schema = T.StructType([df.schema[key], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_, keep = shipped.value
        codes = Codes(own_)
        for batch in sliced(batches):
            lists = [words_of(t) for t in batch.column(1).to_pylist()]
            row, begin, h, flat = _windows(lists, codes, size)
            if keep is not None:
                some = keep.among(h)
                row, begin, h = row[some], begin[some], h[some]
            if at is not None:
                wanted = [set(x or ()) for x in batch.column(2).to_pylist()]
                some = np.array([i for i, (r, b) in enumerate(zip(row.tolist(), begin.tolist())) if b in wanted[r]], dtype=np.int64)
                row, begin, h = row[some], begin[some], h[some]
            columns = [batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))]
            if places:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(begin.astype(np.int32))], names=schema.names)
                continue
            said = [" ".join(lists[r][b : b + size]) for r, b in zip(row.tolist(), begin.tolist())]
            before = np.concatenate(([0], np.cumsum(np.isin(flat, _SLOTS))))
            first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))[row].astype(np.int64) + begin
            many = (before[first + size] - before[first] > MAX_SLOTS).tolist()
            where = [min(b, REACH) if m else 0 for b, m in zip(begin.tolist(), many)]
            around = [_tagged(lists[r][b - p : b + size + REACH], codes) if m else None for r, b, p, m in zip(row.tolist(), begin.tolist(), where, many)]
            columns += [pa.array(said, pa.string()), pa.array(around, pa.string()), pa.array(where, pa.int32())]
            if slots:
                placeholders = [[bool(codes[w] in (_NUMBER, _UNIT, _NAME)) for w in lists[r][b : b + size]] for r, b in zip(row.tolist(), begin.tolist())]
                columns.append(pa.array(placeholders, pa.list_(pa.bool_())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(df.select(key, text, *([at] if at else []))).mapInArrow(run, schema)


def _held(documents: DataFrame, key: str, text: str, own: BitSet, size: int, asked: DataFrame, only: BitSet, ahead: bool) -> DataFrame:
    """The documents' windows that may meet one of ``asked``, with their words."""
    if ahead:
        return template_windows(documents, key, text, own, size, only)
    # places first: what meets nothing is never exchanged with its words
    places = template_windows(documents, key, text, own, size, only, places=True)
    met = cut(places.join(asked.select(F.col("h").alias("hash")).distinct(), "hash", "left_semi"))
    begins = met.groupBy(key).agg(F.collect_set("begin").alias("_begins"))  # at most the windows of the text beside it
    return template_windows(documents.select(key, text).join(begins, key), key, text, own, size, at="_begins")


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", size: int = WINDOW) -> DataFrame:
    """Documents that hold windows of ``size`` words of a passage: key, item, verbatim and reparameterised (numbers of windows).

    A verbatim window has equal words; a re-parameterised one has equal words outside the slots and slots whose values replace each
    other one to one. One of more than ``MAX_SLOTS`` slots counts if that holds for a stretch of adjoining windows around it, within
    ``REACH`` words, which has at least ``size - MAX_SLOTS`` words outside slots. The number of windows counts each place in the
    document and passage.

    * null and empty texts or passages, and those of fewer than ``size`` words, leak nothing;
    * repeated rows of a key or item add up; empty tables give no rows; columns of equal names don't clash, since only the four
      named ones are read (``key`` and ``item`` must differ in name);
    * every document is read whole; nothing that grows with the passages is sent to every task.
    """
    own = BitSet.of(own_words(items, passage), WORD_BITS)
    asked = cut(template_windows(items, item, passage, own, size, slots=True).withColumnsRenamed({"words": "asked", "hash": "h", "around": "_asked", "at": "_begin"}))
    n = asked.count()
    held = _held(documents, key, text, own, size, asked, BitSet.of(asked.select("h").distinct(), WINDOW_BITS), n <= MAX_AHEAD)
    # little passes the set, so the join exchanges little on either side
    met = salted_join(cut(held.withColumnsRenamed({"around": "_held", "at": "_at"})), asked.withColumnRenamed("h", "hash"), "hash", key)
    pairs = F.filter(F.arrays_zip(F.split("words", " ").alias("a"), F.split("asked", " ").alias("b"), F.col("slots").alias("s")), lambda x: x.s | (x.a != x.b))
    named = lambda f: F.array_distinct(F.transform("_slots", f))
    one_to_one = (F.size(named(lambda x: x.a)) == F.size(named(lambda x: F.struct(x.a, x.b)))) & (F.size(named(lambda x: x.b)) == F.size(named(lambda x: F.struct(x.a, x.b))))
    few = F.size(F.filter("slots", lambda s: s)) <= MAX_SLOTS
    other = ~F.exists("_slots", lambda x: ~x.s) & one_to_one & (few | F.col("_agree"))
    equal = F.col("words") == F.col("asked")
    agree = _judge(size)(F.when(~equal, F.col("_held")), "_at", F.when(~equal, F.col("_asked")), "_begin")
    judged = met.withColumn("_slots", F.when(~equal, pairs)).withColumn("_agree", agree).select(key, item, equal.alias("_v"), F.coalesce(~equal & other, F.lit(False)).alias("_r"))
    return judged.where("_v or _r").groupBy(key, item).agg(F.count_if("_v").alias("verbatim"), F.count_if("_r").alias("reparameterised"))
