"""Held-out texts inside a corpus: SimHash of windows, multi-index Hamming search, exact weighted shingles, then the passage."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.session import SharedTable

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_DIGIT_MARK = re.compile(r"(?<=\d)[.,:  ](?=\d)")
_SPACELESS = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")

#: Fingerprints are 64 bits in BLOCKS blocks: two that differ in at most RADIUS < BLOCKS bits agree on some block.
RADIUS, BLOCKS = 3, 4
#: The same where item windows are a table: fewer, wider blocks, as millions of windows would crowd narrow ones.
TABLE_RADIUS, TABLE_BLOCKS = 1, 2
#: Up to so many bytes of item text the index is broadcast (at most INDEX_BYTES a byte of text), beyond it is a table.
BROADCAST_TEXT, INDEX_BYTES = 8 << 20, 40
#: The weight of a shingle is at most this, so that no one of a window's two can carry its similarity alone.
MOST_WEIGHT = 4.0
#: Bits by which documents' windows are sifted before they are searched or shuffled.
SIFT_BITS, TABLE_SIFT_BITS = 20, 27
#: Texts searched at once, in characters; a longer one is searched alone.
BATCH_CHARS = 4 << 20


@dataclass(frozen=True)
class Units:
    """What a passage is counted in: words, or characters where words aren't spaced.

    Windows of ``window`` units are taken every ``stride`` ones, and their middle unit may differ. Runs of agreeing units
    in a passage are of two or more, but for the first. So where a unit is replaced after such a run, two units on each
    side agree, and where none is for five units, all do: a passage with any number of single units replaced has at
    least ``fewest`` agreeing windows of five units on its diagonal.
    """

    passage: int
    window: int
    stride: int
    shared: int
    fewest: int


WORDS, CHARACTERS = Units(25, 5, 1, 14, 4), Units(40, 5, 1, 20, 7)
KINDS = (WORDS, CHARACTERS)


def normalise(text: str) -> str:
    """Case, width, mark-up, entities and invisible characters taken away."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub("", text)
    if text.isascii():
        return text.lower()
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text).casefold())


def words(text: str) -> Iterable[str]:
    """Runs of letters and digits; marks within a number are no breaks."""
    plain = _DIGIT_MARK.sub("", normalise(text))
    return _WORD.findall(plain) if len(plain) < BATCH_CHARS else (m[0] for m in _WORD.finditer(plain))


def characters(text: str) -> Iterable[str]:
    return filter(str.isalnum, normalise(text))


UNITS_OF = (words, characters)


class Hashes(dict[str, int]):
    """64-bit hashes of units; those of units seen before are kept."""

    def __missing__(self, unit: str) -> int:
        h = self[unit] = xxhash.xxh64_intdigest(unit)
        return h

    def of(self, units: Iterable[str]) -> np.ndarray:
        """Hashes of a text's units, taken one by one: a long text is never a list of its words."""
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, units), dtype=np.uint64)


def pairs_of(h: np.ndarray, apart: int = 1) -> np.ndarray:
    """Hashes of units ``apart`` from each other, in order."""
    a, b = h[:-apart], h[apart:]
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (a >> np.uint64(29)))


def shingles_at(window: int) -> np.ndarray:
    """Places in a window of the neighbouring pairs that don't touch its middle unit."""
    return np.array([k for k in range(window - 1) if k not in (window // 2 - 1, window // 2)])


def simhash(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of the windows of ``window`` units at ``starts``, from their units and pairs without the middle unit."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros((len(starts), 64), dtype=np.int16)
    middle = window // 2
    both = pairs_of(h)
    parts = [h[starts + k] for k in range(window) if k != middle] + [both[starts + k] for k in shingles_at(window)]
    parts.append(pairs_of(h, 2)[starts + middle - 1])
    for x in parts:
        total += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(total * 2 > len(parts), axis=1).view(np.uint64).ravel()


def grams_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` units."""
    total = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n if len(total) else 0):
        total = (total ^ h[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total


def windows_of(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """One hash of both shingles of each window: windows that differ in it differ in a shingle."""
    both = pairs_of(h)
    a, b = (both[starts + k] for k in shingles_at(window))
    return (a * np.uint64(0xD6E8FEB86659FD93)) ^ (b + (a >> np.uint64(31)))


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of ``size`` places lie in a run of ``n`` from one of ``starts``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + n, size), -1)
    return np.cumsum(change[:-1]) > 0


def own_starts(own: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold nothing but own wording."""
    if len(own) < window:
        return np.zeros(0, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(own)])
    return np.flatnonzero(total[window:] - total[:-window] == window)


def is_passage(h: np.ndarray, item: np.ndarray, own: np.ndarray, shift: int, passage: int) -> bool:
    """Whether document and item, laid over each other with ``shift``, agree for a passage of the item's own wording.

    Single replaced units are bridged where at least two units agree on their other side.
    """
    a, b = max(0, shift), min(len(h), len(item) + shift)
    if b - a < passage:
        return False
    same = (h[a:b] == item[a - shift : b - shift]).astype(np.uint8)
    same[~own[a - shift : b - shift]] = 2
    return any(m.end() - m.start() >= passage for m in re.finditer(rb"\x01+(?:\x00\x01{2,})*", same.tobytes()))


@dataclass
class Index:
    """Windows of all items of one kind of units, found by Hamming blocks."""

    units: Units
    items: list[int] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)

    def build(self) -> Index:
        """Marks what several items share, then fingerprints every window with wording of its own."""
        n, u = self.units.shared, self.units
        size = np.array([len(h) for h in self.hashes], dtype=np.int64)
        first = np.cumsum(size) - size
        flat = np.concatenate(self.hashes) if self.hashes else np.zeros(0, dtype=np.uint64)
        self.first, self.size, self.flat = first, size, flat
        of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        gram = grams_of(flat, n)
        at = np.flatnonzero(of[: len(gram)] == of[len(of) - len(gram) :])
        order = at[np.argsort(gram[at], kind="stable")]
        new = np.ones(len(order), dtype=bool)
        new[1:] = gram[order][1:] != gram[order][:-1]
        group = np.cumsum(new) - 1
        least, most = np.full(int(new.sum()), len(size)), np.full(int(new.sum()), -1)
        np.minimum.at(least, group, of[order])
        np.maximum.at(most, group, of[order])
        self.own = ~covered(len(flat), order[(least != most)[group]], n)
        place = own_starts(self.own, u.window)
        place = place[of[place] == of[place + u.window - 1]]
        self.place, self.item = place, of[place]
        self.start = place - first[self.item]
        self.prints = np.concatenate([simhash(flat, place[k : k + 65536], u.window) for k in range(0, len(place), 65536)] or [np.zeros(0, dtype=np.uint64)])
        # weight of a two-unit shingle: the rarer among items, the more it says
        self.pairs = pairs_of(flat)
        inside = np.flatnonzero(of[:-1] == of[1:])
        order = inside[np.lexsort((of[inside], self.pairs[inside]))]
        once = np.ones(len(order), dtype=bool)
        once[1:] = (self.pairs[order][1:] != self.pairs[order][:-1]) | (of[order][1:] != of[order][:-1])
        self.keys, n_items = np.unique(self.pairs[order[once]], return_counts=True)
        self.weight = np.minimum(MOST_WEIGHT, 1.0 + np.log(max(1, len(self.items)) / n_items))
        self.known = np.zeros(1 << SIFT_BITS, dtype=bool)
        if len(place):
            self.known[windows_of(flat, place, u.window) >> np.uint64(64 - SIFT_BITS)] = True
        self.blocks = []
        for b in range(BLOCKS):
            part = (self.prints >> np.uint64(16 * b)).astype(np.uint16)
            order = np.argsort(part, kind="stable").astype(np.int32)
            self.blocks.append((order, np.searchsorted(part[order], np.arange(65537)).astype(np.int32)))
        del self.hashes
        return self

    def able(self, h: np.ndarray) -> np.ndarray:
        """Starts of the windows that may have both shingles of an item's window (by bits of their hash).

        A window with one shingle of an item's and another one beside it has at most MOST_WEIGHT / (MOST_WEIGHT + 2) of
        its weight in common, less than the similarity asked for, so all others would be turned down later.
        """
        if len(h) < self.units.window:
            return np.zeros(0, dtype=int)
        starts = np.arange(len(h) - self.units.window + 1)
        return np.flatnonzero(self.known[windows_of(h, starts, self.units.window) >> np.uint64(64 - SIFT_BITS)])

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, item window) of all pairs within RADIUS bits; pairs may repeat."""
        at, of = [], []
        for b, (order, bounds) in enumerate(self.blocks):
            part = (prints >> np.uint64(16 * b)).astype(np.uint16).astype(np.int64)
            low, n = bounds[part], bounds[part + 1] - bounds[part]
            some = np.flatnonzero(n)
            n, low = n[some], low[some]
            q = np.repeat(some, n)
            step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            w = order[np.repeat(low, n) + step] if len(q) else np.zeros(0, dtype=int)
            close = np.bitwise_count(prints[q] ^ self.prints[w]) <= RADIUS
            at.append(q[close])
            of.append(w[close])
        return np.concatenate(at), np.concatenate(of)

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(shingles.shape)
        k = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        return np.where(self.keys[k] == shingles, self.weight[k], 1.0)

    def similar(self, h: np.ndarray, starts: np.ndarray, windows: np.ndarray, least: float) -> np.ndarray:
        """Which (document window, item window) pairs have a weighted shingle similarity of at least ``least``."""
        if not len(starts):
            return np.zeros(0, dtype=bool)
        span = shingles_at(self.units.window)
        ours = pairs_of(h)[starts[:, None] + span]
        theirs = self.pairs[self.place[windows][:, None] + span]
        equal = (ours[:, :, None] == theirs[:, None, :]).any(axis=2)
        back = (theirs[:, :, None] == ours[:, None, :]).any(axis=2)
        a, b = self.weigh(ours), self.weigh(theirs)
        common = (np.where(equal, a, 0).sum(axis=1) + np.where(back, b, 0).sum(axis=1)) / 2
        return common >= least * (a.sum(axis=1) + b.sum(axis=1) - common)

    def passage(self, h: np.ndarray, k: int, shift: int) -> bool:
        low, high = self.first[k], self.first[k] + self.size[k]
        return is_passage(h, self.flat[low:high], self.own[low:high], shift, self.units.passage)


def kind_of(text: str, lang: str | None, spaceless: tuple[str, ...] = ("zh", "ja")) -> int:
    """1 for an item counted in characters, 0 for one in words: by its language, or by its script without one."""
    return int(lang in spaceless if lang else bool(_SPACELESS.search(text)))


def build_indexes(items: Iterable[tuple[int, str, str]]) -> list[Index]:
    """One index for words and one for characters, from (item_id, text, lang)."""
    hashes = Hashes()
    found = [Index(WORDS), Index(CHARACTERS)]
    for ident, text, lang in items:
        if text:
            kind = kind_of(text, lang)
            found[kind].items.append(ident)
            found[kind].hashes.append(hashes.of(UNITS_OF[kind](text)))
    return [i.build() for i in found]


def document_units(texts: list[str | None], kind: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' units in a row, and how many each text has; a text without such a script has no characters."""
    parts = [hashes.of(UNITS_OF[kind](t)) if t and not (kind and not _SPACELESS.search(t)) else np.zeros(0, dtype=np.uint64) for t in texts]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.array([len(p) for p in parts], dtype=np.int64)


def leaked(texts: list[str | None], indexes: list[Index], hashes: Hashes, least: float = 0.8) -> list[list[int]]:
    """For each text the items of which it holds a passage."""
    found: list[set[int]] = [set() for _ in texts]
    for kind, index in enumerate(indexes):
        if not len(index.prints):
            continue
        u = index.units
        h, n = document_units(texts, kind, hashes)
        first = np.cumsum(n) - n
        # a window every stride units, as far as a text is long enough for a passage and an item may have its shingles
        doc_of = np.repeat(np.arange(len(texts)), n)
        starts = index.able(h)
        doc = doc_of[starts]
        at_doc = starts - first[doc]
        inside = (n[doc] >= u.passage) & (at_doc + u.window <= n[doc]) & (at_doc % u.stride == 0)
        starts, doc = starts[inside], doc[inside]
        at, window = index.near(simhash(h, starts, u.window))
        ok = index.similar(h, starts[at], window, least)
        at, window = np.divmod(np.unique(at[ok] * len(index.prints) + window[ok]), len(index.prints))
        if not len(at):
            continue
        # diagonals with at least as many windows as a passage has
        longest = int(index.size.max())
        span = int(n.max()) + longest + 1
        shift = starts[at] - first[doc[at]] - index.start[window] + longest
        diagonals, count = np.unique((doc[at] * len(index.items) + index.item[window]) * span + shift, return_counts=True)
        pair, shift = np.divmod(diagonals[count >= u.fewest], span)
        for d, k, s in zip(*(x.tolist() for x in (*np.divmod(pair, len(index.items)), shift - longest))):
            if index.items[k] not in found[d] and index.passage(h[first[d] : first[d] + n[d]], k, s):
                found[d].add(index.items[k])
    return [sorted(f) for f in found]


def batches_of(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most 1000 rows and about BATCH_CHARS of text."""
    size = np.array([0 if x is None else x for x in pc.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
    low, total = 0, 0
    for k, n in enumerate(size):
        if k > low and (k - low >= 1000 or total + n > BATCH_CHARS):
            yield batch.slice(low, k - low)
            low, total = k, 0
        total += int(n)
    if len(size) > low:
        yield batch.slice(low)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _by_broadcast(documents: DataFrame, items: DataFrame) -> DataFrame:
    """find_leaks with the items' index in every task: the corpus is read once and neither shuffled nor collected."""
    held = documents.sparkSession.sparkContext.broadcast(build_indexes(tuple(r) for r in items.orderBy("item_id").collect()))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part in batches_of(batch, 1):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                pairs = [(i, d) for d, found in zip(ids, leaked(texts, held.value, hashes)) for i in found]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)

    return documents.mapInArrow(search, "item_id bigint, doc_id bigint")


def _by_table(documents: DataFrame, items: DataFrame) -> DataFrame:
    """find_leaks for items of any size: their windows are a table, joined with the documents' on Hamming blocks.

    Only a bitmap of TABLE_SIFT_BITS bits goes through the driver, however many items there are. The same pairs come
    out: a window's two shingles must both be equal, so the fingerprints of all pairs that count are equal too.
    """
    spark = documents.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for ident, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    kind = kind_of(text, lang)
                    g = grams_of(hashes.of(UNITS_OF[kind](text)), KINDS[kind].shared)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), ident)), pa.array(np.full(len(g), kind, dtype=np.int32)), _signed(g), pa.array(np.arange(len(g), dtype=np.int32))], names=["item_id", "kind", "gram", "at"])

    found = SharedTable(items.mapInArrow(grams, "item_id bigint, kind int, gram bigint, at int"), "grams").read()
    several = found.groupBy("kind", "gram").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a <> b").select("kind", "gram")
    shared = found.join(several, ["kind", "gram"]).groupBy("item_id").agg(F.collect_list("at").alias("shared"))  # one item's places
    held = SharedTable(items.join(shared, "item_id", "left"), "items").read()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for ident, text, lang, at in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                kind = kind_of(text, lang)
                h, u = hashes.of(UNITS_OF[kind](text)), KINDS[kind]
                starts = own_starts(~covered(len(h), np.array(at or [], dtype=np.int64), u.shared), u.window)
                if len(starts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), ident)), pa.array(np.full(len(starts), kind, dtype=np.int32)), pa.array(starts.astype(np.int32)), _signed(simhash(h, starts, u.window)), _signed(windows_of(h, starts, u.window))], names=["item_id", "kind", "start", "print", "both"])

    ours = SharedTable(held.mapInArrow(windows, "item_id bigint, kind int, start int, print bigint, both bigint"), "windows").read()
    # buckets of 32768 bits are numbered from 1 and begin with the value 1
    value = f"shiftrightunsigned(both, {64 - TABLE_SIFT_BITS}) + 1"
    bits = ours.groupBy(F.expr(f"bitmap_bucket_number({value})").alias("n")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({value}))").alias("bits"))
    sieve = np.zeros(1 << (TABLE_SIFT_BITS - 3), dtype=np.uint8)
    for r in bits.collect():
        sieve[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shown = spark.sparkContext.broadcast(sieve)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part in batches_of(batch, 1):
                texts = part.column(1).to_pylist()
                for kind, u in enumerate(KINDS):
                    h, n = document_units(texts, kind, hashes)
                    if len(h) < u.window:
                        continue
                    of, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                    starts = np.arange(len(h) - u.window + 1)
                    both = windows_of(h, starts, u.window)
                    at = (both >> np.uint64(64 - TABLE_SIFT_BITS)).astype(np.int64)
                    ok = (shown.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (of[starts] == of[starts + u.window - 1]) & (n[of[starts]] >= u.passage)
                    starts = starts[ok]
                    if len(starts):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[starts])), pa.array(np.full(len(starts), kind, dtype=np.int32)), pa.array((starts - first[of[starts]]).astype(np.int64)), _signed(simhash(h, starts, u.window)), _signed(both[ok])], names=["doc_id", "kind", "at", "print", "both"])

    theirs = documents.mapInArrow(search, "doc_id bigint, kind int, at bigint, print bigint, both bigint")
    width = 64 // TABLE_BLOCKS
    block = lambda c, b: F.shiftrightunsigned(c, width * b).bitwiseAND(F.lit((1 << width) - 1))
    cut = lambda df: df.select("*", F.posexplode(F.array(*(block("print", b) for b in range(TABLE_BLOCKS)))).alias("block", "value"))
    met = cut(theirs).join(cut(ours).withColumnsRenamed({"print": "of_print", "both": "of_both"}), ["kind", "block", "value"])
    differ = F.col("print").bitwiseXOR(F.col("of_print"))
    # a pair that agrees on several blocks counts at the first of them
    earlier = [(F.col("block") <= b) | (block(differ, b) != 0) for b in range(TABLE_BLOCKS - 1)]
    met = met.where((F.bit_count(differ) <= TABLE_RADIUS) & (F.col("both") == F.col("of_both")))
    for c in earlier:
        met = met.where(c)
    least = F.when(F.col("kind") == 1, CHARACTERS.fewest).otherwise(WORDS.fewest)
    lines = met.groupBy("kind", "doc_id", "item_id", (F.col("at") - F.col("start")).alias("shift")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    lines = SharedTable(lines.groupBy("kind", "doc_id", "item_id").agg(F.collect_set("shift").alias("shifts")), "lines").read()
    docs = documents.select(F.col("doc_id").alias("_d"), F.col("text").alias("doc_text"))
    laid = lines.join(docs, F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d").join(held, "item_id").select("item_id", "doc_id", "kind", "shifts", "doc_text", "text", "shared")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for item, doc, kind, shifts, doc_text, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                h, item_h = hashes.of(UNITS_OF[kind](doc_text)), hashes.of(UNITS_OF[kind](text))
                own = ~covered(len(item_h), np.array(at or [], dtype=np.int64), KINDS[kind].shared)
                if any(is_passage(h, item_h, own, s, KINDS[kind].passage) for s in shifts):
                    out.append((item, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["item_id", "doc_id"])

    return laid.mapInArrow(judge, "item_id bigint, doc_id bigint")


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang", broadcast_text: int = BROADCAST_TEXT) -> DataFrame:
    """(item_id, doc_id): documents that hold a passage of an item's own text: 25 words in a row, or 40 characters in zh and ja.

    Case, punctuation, mark-up, spacing, invisible characters, width and single replaced units don't break a passage.
    Wording of 14 words (20 characters) or more that a second item has too belongs to none. Every window of every
    document is searched by a fingerprint that leaves its middle unit out; all item windows within RADIUS bits are found
    for sure, pass by exact weighted shingle similarity of 0.8, and where a diagonal has as many of them as the least
    that a passage holds, however many single units are replaced in it (Units), the passage rule is applied to whole
    texts along it. Null and short texts hold nothing; a null doc_id comes out as null. Item ids must not be null or
    repeated. Items of up to ``broadcast_text`` bytes are an index in every task; more of them, however many, are a table
    that is joined with the documents' windows, with the same result.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    held = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = held.selectExpr("coalesce(sum(octet_length(text)), 0) as n").first()["n"]
    return _by_broadcast(docs, held) if size <= broadcast_text else _by_table(docs, held)
