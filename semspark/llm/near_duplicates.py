"""Near-duplicate texts by multiset likeness, with pigeonring filtering before the full check.

A text is the multiset of its words, written as a set of numbered copies (the second ``and`` is another item than the
first), so likeness is Jaccard likeness of sets and two texts of sizes a and b are ``t`` alike just when they differ in
at most (a + b)(1 - t)/(1 + t) items, their difference budget.

1. Items are counted over the whole collection in a table of ``SLOTS`` hash slots (a fixed size, whatever the
   collection). The counts only fix one common order of segments, rarest first; any order gives the same result.
2. Items fall into more segments (boxes, in a ring) than the budget has items, by hash; texts of one band of sizes have
   the same ring. The differences of the boxes add up to that of the texts. Each text chooses its rarest boxes, one more
   than its budget. Take, of a pair, the budget + 1 boxes that come first in the order of either text: each may differ in
   none of its items or the pair would be out of reach, and the pigeonring principle says that from one of them, equal in
   both texts, each chain of 1, 2, 3 ... consecutive boxes differs in fewer items than it has such boxes. Both texts
   have chosen that first box, and all such boxes are chosen by one of them.
3. So the join is keyed on a chosen box and its content, and each pair that meets is tested along the chain that begins
   there: the differences (at least as many as parity bits of the boxes differ) must stay below the number of chosen
   boxes at every length up to ``WINDOW`` boxes, or the whole ring where that is shorter.
4. The pairs left, each once, get the full check on all items.

Exact copies (equal multisets) form one class and are compared once. A box that very many texts may share is cut
into parts. No cap on partners or candidates is set; any likeness above 0 loses no pair.

Defined results: null, empty and wordless texts are alike to nothing; rows sent twice count once; keys without text
give no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

SLOTS = 1 << 20
WINDOW = 16  # boxes of a chain, 4 parity bits each
EMPTY = 1 << 40  # more than any count
PARTS = 256  # into which a hot segment is cut at most
CELLS = 1 << 21  # boxes that a task lays out at once
ITEM = 6  # bytes kept of an item's hash: two items of a pair of texts are confused once in some 10^10 pairs
WORD = re.compile(r"\w+")
CLASS = "class_hi long, class_lo long, size int, items binary"
SIGNED = ["sig", "class_lo", "meta", "ring"]


def _items(text: str, known: dict[str, list[bytes]]) -> bytes:
    """Hashes of the numbered words of a text, in order of the words; equal multisets give equal bytes."""
    out = []
    counts = Counter(WORD.findall(text.lower()))
    for word in sorted(counts):
        n, own = counts[word], known.setdefault(word, [])
        while len(own) < n:
            own.append(xxhash.xxh64_digest(f"{word}#{len(own)}" if own else word)[:ITEM])
        out.extend(own[:n])
    return b"".join(out)


def _hashes(items: list[bytes]) -> np.ndarray:
    """The hashes in some packed texts, one after another."""
    raw = np.frombuffer(b"".join(items), np.uint8).reshape(-1, ITEM)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :ITEM] = raw
    return wide.view(np.uint64).ravel()


def word_multisets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_hi, class_lo, size, items): the multiset of each text; equal multisets have an equal class.

    items is null where the same task has met the class before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[bytes]] = {}
        seen: set[bytes] = set()
        for batch in batches:
            keys, digests, size, items = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _items(t, known)
                if own:
                    d = xxhash.xxh3_128_digest(own)
                    keys.append(k)
                    digests.append(d)
                    size.append(len(own) // ITEM)
                    items.append(None if d in seen else own)
                    seen.add(d)
            if len(known) > 1_000_000:
                known.clear()
            ids = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(size, pa.int32()), pa.array(items, pa.binary())], ["key", "class_hi", "class_lo", "size", "items"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, f"key string, {CLASS}")


def slot_counts(classes: DataFrame) -> np.ndarray:
    """Counts of items per hash slot over all classes: SLOTS numbers, however large the collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount((_hashes(batch.column(0).to_pylist()) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    rows = classes.select("items").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _boxes(flat: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and box (n x m): a hash of what is in the box, the least count of its items, 4 parity bits of them.

    The box of an item is a matter of the item alone. An empty box costs more than any other.
    """
    cell = owner * m + ((flat >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    mixed = (flat ^ (flat >> np.uint64(23))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order], return_index=True)
    content, cost, ring = np.zeros(n * m, np.uint64), np.full(n * m, EMPTY), np.zeros(n * m, np.uint64)
    if len(cells):
        content[cells] = np.add.reduceat(mixed[order], starts)
        cost[cells] = np.minimum.reduceat(count[order], starts)
        ring[cells] = np.bitwise_xor.reduceat(np.uint64(1) << (mixed[order] >> np.uint64(62)), starts)
    return content.reshape(n, m), cost.reshape(n, m), ring.reshape(n, m)


def _window(values: np.ndarray, at: np.ndarray, box: np.ndarray, bits: int) -> np.ndarray:
    """Values of the WINDOW boxes of a ring from ``box`` on as a long, ``bits`` each; no box twice."""
    m = values.shape[1]
    out = np.zeros(len(at), np.uint64)
    for k in range(min(WINDOW, m)):
        out |= values[at, (box + k) % m] << np.uint64(bits * k)
    return out.view(np.int64)


class Segments:
    """How texts are cut into segments: bands of sizes with a number of boxes each, and difference budgets."""

    def __init__(self, likeness: float, per_share: float):
        if not 0 < likeness <= 1:
            raise ValueError("likeness must be above 0 and at most 1")
        self.likeness, self.part, self.per_share = likeness, (1 - likeness) / (1 + likeness), per_share

    def budget(self, both: np.ndarray) -> np.ndarray:
        """Items in which two texts of together ``both`` items may differ."""
        return np.floor(both * self.part + 1e-9).astype(np.int64)

    def band(self, size: np.ndarray) -> np.ndarray:
        """Band g holds the sizes from 2 * 4**(g - 1) up to, but not with, 2 * 4**g."""
        return np.floor(np.log2(2 * size + 0.5) / 2).astype(np.int64)

    def largest(self, band: int) -> int:
        return 2 * 4**band - 1

    def longest(self, size: np.ndarray) -> np.ndarray:
        return np.floor(size / self.likeness + 1e-9).astype(np.int64)

    def boxes(self, band: int) -> int:
        return int(np.ceil(self.per_share * (self.budget(np.array([2 * self.largest(band)]))[0] + 1)))


def signatures(classes: DataFrame, cut: Segments, counts: np.ndarray, texts: int, hot: int) -> DataFrame:
    """A row (SIGNED) per chosen segment of a class and band.

    meta: size, roles (1: as the shorter text of a pair, 2: as the longer), then a bit per box of the window: chosen.
    A segment that more than ``hot`` of the ``texts`` texts may share is cut into parts: as a shorter text a class goes to one of
    them, as a longer one to all.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers

    def rows(flat: np.ndarray, size: np.ndarray, lo: np.ndarray, band: int, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, m = len(size), cut.boxes(band)
        owner = np.repeat(np.arange(n), size)
        content, cost, ring = _boxes(flat, owner, shared.value[(flat & np.uint64(SLOTS - 1)).astype(np.int64)], n, m)
        key = (content ^ (np.arange(m, dtype=np.uint64) + np.uint64(band << 40))[None, :]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        order = np.lexsort((key.ravel(), cost.ravel(), np.repeat(np.arange(n), m)))
        rank = np.empty(n * m, np.int64)
        rank[order] = np.tile(np.arange(m), n)
        rank = rank.reshape(n, m)
        short = rank <= cut.budget(size + np.minimum(cut.longest(size), cut.largest(band)))[:, None]
        long = (rank <= cut.budget(2 * size)[:, None]) & own[:, None]
        at, box = np.nonzero((short | long) & (cost > 1))  # an item alone in its slot is in no other text
        chosen = (short | long).astype(np.uint64)
        near, meta = _window(ring, at, box, 4), (size[at] << 18) | _window(chosen, at, box, 1)
        roles = short[at, box].astype(np.int64) + 2 * long[at, box]
        k = key[at, box]
        parts = np.minimum(-(-np.minimum(cost[at, box], texts) // hot), PARTS)
        one = np.arange(len(at))
        split = parts > 1
        own_part = (lo[at].view(np.uint64) >> np.uint64(7)) % parts.astype(np.uint64)
        many = np.repeat(one[split], parts[split])
        nth = (np.arange(len(many)) - np.repeat(np.cumsum(parts[split]) - parts[split], parts[split])).astype(np.uint64)
        sets = [(one, np.where(split, own_part, np.uint64(0)), np.where(split, roles & 1, roles)), (many, nth, roles[many] & 2)]
        for i, part, role in sets:
            i, part, role = i[role > 0], part[role > 0], role[role > 0]
            sig = ((k[i] + part * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(12)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, lo[at[i]], meta[i] | (role << 16), near[i])], SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, items = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            if not len(size):
                continue
            first, last = cut.band(size), cut.band(cut.longest(size))
            for band in range(int(first.min()), int(last.max()) + 1):
                inside = np.flatnonzero((first <= band) & (last >= band))
                step = max(1, CELLS // cut.boxes(band))
                for i in range(0, len(inside), step):
                    part = inside[i : i + step]
                    yield from rows(_hashes(items.take(pa.array(part)).to_pylist()), size[part], lo[part], band, first[part] == band)

    return classes.select("class_lo", "size", "items").mapInArrow(run, "sig long, class_lo long, meta long, ring long")


def chain_kept(a: str, b: str, length: int = WINDOW) -> Column:
    """Whether, from the shared segment on, each chain of 2, 3, ... ``length`` consecutive segments keeps its share.

    The share of a chain is the number of its segments that either text chose, less one; at least as many items as their
    parities tell apart differ. A pair that breaks a short chain is not tested on longer ones.
    """
    differ, chosen, kept = F.col(f"{a}.ring").bitwiseXOR(F.col(f"{b}.ring")), F.col(f"{a}.meta").bitwiseOR(F.col(f"{b}.meta")), F.lit(True)
    for n in range(2, length + 1):
        bits = (1 << 4 * n) - 1
        d = F.bit_count(differ.bitwiseAND(F.lit(bits if n < 16 else -1)))
        kept = kept & (d < F.bit_count(chosen.bitwiseAND(F.lit((1 << n) - 1))))
    return kept


def _roles(a: str, b: str) -> Column:
    """a may be the shorter text and b the longer; written as one test of both, as both sides read the same rows."""
    ready = F.shiftrightunsigned(F.col(f"{a}.meta"), 16).bitwiseAND(F.shiftrightunsigned(F.col(f"{b}.meta"), 17)).bitwiseAND(F.lit(1)) == 1
    x, y = F.shiftrightunsigned(F.col(f"{a}.meta"), 18), F.shiftrightunsigned(F.col(f"{b}.meta"), 18)
    return ready & ((x < y) | ((x == y) & (F.col(f"{a}.class_lo") < F.col(f"{b}.class_lo"))))


def met(signed: DataFrame, likeness: float, length: int = WINDOW) -> DataFrame:
    """(a, b): class_lo of pairs that share a segment and keep the chains of up to ``length`` segments from there on."""
    a, b = signed.alias("a"), signed.alias("b")
    x, y = F.shiftrightunsigned(F.col("a.meta"), 18), F.shiftrightunsigned(F.col("b.meta"), 18)
    on = (F.col("a.sig") == F.col("b.sig")) & _roles("a", "b") & (x >= y * F.lit(likeness) - 1e-9)
    return a.join(b, on & chain_kept("a", "b", length) if length else on).select(F.col("a.class_lo").alias("a"), F.col("b.class_lo").alias("b"))


def verified(pairs: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo) of the pairs whose likeness, on all items, is at least ``likeness``."""
    side = lambda s: classes.select(F.col("class_lo").alias(s), F.col("class_hi").alias(f"{s}_hi"), F.col("items").alias(f"{s}_items"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                both = np.sort(_hashes([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= likeness * (len(both) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], ["a_hi", "a_lo", "b_hi", "b_lo"]).filter(pa.array(keep, pa.bool_()))

    rows = both.select("a_hi", F.col("a").alias("a_lo"), "b_hi", F.col("b").alias("b_lo"), "a_items", "b_items")
    return rows.mapInArrow(run, "a_hi long, a_lo long, b_hi long, b_lo long")


class NearDuplicates:
    """Classes of equal multisets, and the pairs of classes that are at least ``likeness`` alike.

    per_share: boxes per item of the budget (above 1); hot: how many texts may share a box before it is cut into parts.
    Both move work and do not change the result.
    """

    def __init__(self, df: DataFrame, key: str, text: str, likeness: float = 0.8, per_share: float = 1.5, hot: int = 20_000):
        self.parts = parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.likeness, self.cut, self.hot = likeness, Segments(likeness, per_share), hot
        rows = word_multisets(df, key, text).persist(StorageLevel.MEMORY_AND_DISK)
        self.keys = materialise(rows.select("key", "class_hi", "class_lo").distinct(), "members")
        classes = rows.filter("items IS NOT NULL").drop("key").repartition(parts, "class_lo").dropDuplicates(["class_lo", "class_hi"])
        self.classes = materialise(classes, "classes")
        self.texts = self.classes.count()
        rows.unpersist()

    def signed(self) -> DataFrame:
        return signatures(self.classes, self.cut, slot_counts(self.classes), self.texts, self.hot)

    @cached_property
    def class_pairs(self) -> DataFrame:
        """(a_hi, a_lo, b_hi, b_lo), each pair once."""
        pairs = materialise(met(self.signed(), self.likeness).distinct(), "candidates")  # both sides of the join read one exchange
        return materialise(verified(pairs, self.classes, self.likeness), "class_pairs")

    def funnel(self) -> list[tuple[str, int]]:
        """Pairs that share a segment, those left after chains of each length, distinct ones and those that are alike."""
        signed = materialise(self.signed(), "signed")
        out = [("shared segment", met(signed, self.likeness, 0).count())]
        out += [(f"chains of {n}", met(signed, self.likeness, n).count()) for n in range(2, WINDOW + 1)]
        return [*out, ("distinct", met(signed, self.likeness).distinct().count()), ("alike", self.class_pairs.count())]

    def members(self) -> DataFrame:
        """(key, class_key, copies, links): the least key of the class, its number of keys, and keys alike to the key.

        A key with several texts has a row for each class.
        """
        own = self.keys.groupBy("class_hi", "class_lo").agg(F.min("key").alias("class_key"), F.count("*").alias("copies"))
        pairs = self.class_pairs
        both = pairs.unionByName(pairs.select(F.col("b_hi").alias("a_hi"), F.col("b_lo").alias("a_lo"), F.col("a_hi").alias("b_hi"), F.col("a_lo").alias("b_lo")))
        there = both.join(own.select(F.col("class_hi").alias("b_hi"), F.col("class_lo").alias("b_lo"), "copies"), ["b_hi", "b_lo"])
        links = there.groupBy(F.col("a_hi").alias("class_hi"), F.col("a_lo").alias("class_lo")).agg(F.sum("copies").alias("linked"))
        classes = own.join(links, ["class_hi", "class_lo"], "left")
        return self.keys.join(classes, ["class_hi", "class_lo"]).select("key", "class_key", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))

    def class_links(self) -> DataFrame:
        """(class_a, class_b): the pairs of classes by their least keys, class_a < class_b."""
        own = self.keys.groupBy("class_hi", "class_lo").agg(F.min("key").alias("class_key"))
        a, b = (own.select(F.col("class_hi").alias(f"{s}_hi"), F.col("class_lo").alias(f"{s}_lo"), F.col("class_key").alias(s)) for s in "ab")
        both = self.class_pairs.join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"])
        return both.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))

    def key_pairs(self, wide: int = 2000) -> DataFrame:
        """(key_a, key_b), key_a < key_b: all pairs of keys with texts alike, copies included.

        A class of more than ``wide`` keys is cut into parts of its left side, each of which meets all of its right side.
        """
        keys = self.keys
        copied = keys.groupBy("class_hi", "class_lo").agg(F.count("*").alias("n")).filter("n > 1")
        parts = copied.filter(F.col("n") > wide).select(F.col("class_hi").alias("b_hi"), F.col("class_lo").alias("b_lo"), F.least(F.ceil(F.col("n") / wide), F.lit(PARTS)).cast("int").alias("parts"))
        pairs = self.class_pairs.unionByName(copied.select(*[F.col(f"class_{p}").alias(f"{s}_{p}") for s in "ab" for p in ("hi", "lo")]))
        a, b = (keys.select(F.col("key").alias(f"key_{s}"), F.col("class_hi").alias(f"{s}_hi"), F.col("class_lo").alias(f"{s}_lo")) for s in "ab")
        part = F.pmod(F.xxhash64("key_a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
        left = pairs.join(parts, ["b_hi", "b_lo"], "left").join(a, ["a_hi", "a_lo"]).select("key_a", "b_hi", "b_lo", part)
        right = b.join(parts, ["b_hi", "b_lo"], "left").select("key_b", "b_hi", "b_lo", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        both = left.join(right, ["b_hi", "b_lo", "part"]).filter("key_a <> key_b")
        return both.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
