"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is the set of hashes of its word n-grams. Two sets with Jaccard similarity of at least
``num / den`` differ in at most ``k`` elements, where k follows from the band of their sizes. Per band the
feature domain is hashed into n1 first-level partitions of n2 second-level partitions each; two sets that
differ in at most k elements differ in at most k2 in one of the n1, and then agree on some subset of n2 - k2
of its second-level partitions. Each set therefore has one signature for every first-level partition and
subset, and sets that are similar enough share one of them; nothing is lost.

Signatures over no element agree by chance. A set of a given size differs from any partner in at most k(size)
elements, so at least ``n1 - k(size) // (k2 + 1)`` first-level partitions are good for every pair it is in. If fewer
of its partitions than that have an empty signature, some good partition has none, and the set (whatever
its partner does) is found by its other signatures alone: it emits no empty ones.

From shared signatures to components, without a row for every pair of a bucket:
 1. equal sets are one class, and only its least document goes on, with ids that have other sets too;
 2. in each bucket every member is tried against its neighbour, first by a parity bitmap whose
    distance never exceeds the true one, then on the whole texts;
 3. in buckets whose members are still in several components, all pairs across components are compared
    by bitmap within the task (in blocks of bounded size). First each bucket gives only a spanning forest of the
    pairs that its bitmaps allow, fewer than it has members; they are verified on the whole texts and components
    follow. Then, in what is still split, every allowed pair that is left is verified.
After 3 every pair that shares a signature has been verified, ruled out, or lies inside one component. What the
last step verifies are pairs close to the threshold: the bitmaps (two to four bits an element) rule out the others.

Defined cases: a null text counts as empty; a document with fewer than n words is one shingle, one
without words has the empty set and no links; a document is its doc_id (an integer of any width): repeated rows are
the same document, and rows of one id with different texts share their links; rows with a null doc_id are counted
but linked with nothing (null ``component_id``); extra columns are ignored, whatever their names; an empty table
gives no rows. Shingles, and classes of equal sets, are identified by 64- and 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import chunks, unused_name, written
from .components import components

#: Ids up to which a list of documents is broadcast (about 32 bytes each on an executor).
BROADCAST_IDS = 2_000_000
#: Bits of the smallest parity bitmap; a set's own has at least two bits per element.
BITMAP = 512
#: Members of a bucket that one task compares with each other at once.
BLOCK = 2048
#: Bytes up to which a whole bitmap travels with a set's signatures; larger ones are folded once.
SKETCH = 256
#: First-level partitions beyond those that the largest distance in a band needs.
SPARE = 0.05
#: Signatures that a task holds before it hands them on.
HELD = 400_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are shingled at once.
CHUNK = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _seed(i: int) -> np.uint64:
    return np.uint64(i * int(_MUL) & 0xFFFFFFFFFFFFFFFF)


class Shingler:
    """Sorted distinct hashes of the word n-grams of whole texts; each distinct word is hashed once a chunk."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets(pa.array([text], pa.string()))[0]

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        return [h for a, b in chunks(texts, CHUNK) for h in self._sets(texts.slice(a, b - a))]

    def _sets(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words = lists.flatten()
        filled = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(filled).dictionary_encode()
        counts = np.bincount(of[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
        known = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        h = hashes[coded.indices.to_numpy(zero_copy_only=False)]
        grams = self._grams(h, self.n)
        ends = np.cumsum(counts)
        out = []
        for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            n = min(self.n, end - begin)
            out.append(np.unique(grams[begin : end - n + 1] if n == self.n else self._grams(h[begin:end], n)))
        return out

    @staticmethod
    def _grams(h: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each position on."""
        if not n or len(h) < n:
            return np.empty(0, np.uint64)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _MUL + h[i : len(h) - n + 1 + i])
        return out


class Scheme:
    """Bands of sizes and the PartEnum parameters of each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.n2, self.k2 = 2, 1
        self.power = 3 if 100 * num >= 85 * den else 2
        self.subsets = list(combinations(range(self.n2), self.n2 - self.k2))
        self.bands = [(1, 1)]

    def _grown(self, size: int) -> int:
        return size * self.den // self.num

    def band(self, size: int) -> int:
        while self.bands[-1][1] < size:
            low = high = self.bands[-1][1] + 1
            for _ in range(self.power):
                high = self._grown(high)
            self.bands.append((low, high))
        lo, hi = 0, len(self.bands) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.bands[mid][1] < size else (lo, mid)
        return lo

    @lru_cache(maxsize=None)  # noqa: B019
    def parts(self, band: int) -> tuple[int, int]:
        """k and the number of first-level partitions, for pairs whose smaller set is in ``band``."""
        k = self.bands[band][1] * (self.den - self.num) // self.num
        least = -(-(k + 1) // (self.k2 + 1))
        return k, least + (-(-int(1000 * SPARE) * least // 1000) if k else 0)

    def apart(self, size: int, band: int) -> int:
        """Elements in which a set of this size differs at most from a partner it is compared with in ``band``."""
        high, num, den = self.bands[band][1], self.num, self.den
        return size * (den - num) // num if size <= high else (size + high) * (den - num) // (den + num)

    def instances(self, size: int) -> list[int]:
        """The bands in whose name a set of this size has signatures."""
        own = self.band(size)
        below = own - 1
        return [own, below] if below >= 0 and self._grown(self.bands[below][1]) >= size else [own]

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """The signatures that a set emits."""
        out = [np.empty(0, np.uint64)]
        for band in self.instances(len(h)):
            k, n1 = self.parts(band)
            if not k:
                continue  # only equal sets could be linked, and these are one class
            x = _mix(h + _seed(band))
            cell = ((x >> np.uint64(20)) % np.uint64(n1 * self.n2)).astype(np.int64)
            acc, full = np.zeros(n1 * self.n2, np.uint64), np.zeros(n1 * self.n2, bool)
            np.add.at(acc, cell, _mix(x ^ _MUL))
            full[cell] = True
            acc, full = acc.reshape(n1, self.n2), full.reshape(n1, self.n2)
            at = np.arange(n1, dtype=np.uint64) * _MUL
            each, strong = [], []
            for j, subset in enumerate(self.subsets):
                sig = _mix(at + _seed(64 * band + j))
                for second in subset:
                    sig = _mix(sig * _MUL + acc[:, second])
                each.append(sig)
                strong.append(full[:, list(subset)].any(axis=1))
            strong, each = np.array(strong), np.concatenate(each)
            empty = int((~strong.all(axis=0)).sum())  # first-level partitions with an empty signature
            good = n1 - min(k, self.apart(len(h), band)) // (self.k2 + 1)
            out.append(each[strong.ravel()] if empty < good else each)
        return np.concatenate(out)


def parity(h: np.ndarray) -> bytes:
    """Bitmap of a power of two of bits; a bit is set if an odd number of elements hash to it."""
    size = max(BITMAP, 1 << (2 * len(h)).bit_length())
    odd = np.bincount((_mix(h) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (along the last axis) as they would be with fewer bits: halves are added modulo two."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _sketch(bits: bytes) -> bytes:
    """The bitmap that travels with a set's signatures: the whole one, or of one to two bits per element."""
    return bits if len(bits) <= SKETCH else _folded(np.frombuffer(bits, np.uint64), len(bits) // 16).tobytes()


META = "doc_id bigint, n_shingles bigint, fp binary, bits binary, sigs array<bigint>"


def _meta(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts -> sets: size, digest, parity bitmap and signatures, each text shingled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, scheme = Shingler(n), Scheme(num, den)

        def out(rows: list[tuple[int | None, int, bytes, bytes, np.ndarray]]) -> pa.RecordBatch:
            docs, sizes, fps, maps, sigs = zip(*rows, strict=True)
            ends = np.cumsum([0, *map(len, sigs)], dtype=np.int32)
            arrays = [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(maps, pa.binary())]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs).view(np.int64))))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "fp", "bits", "sigs"])

        for batch in batches:
            rows, held = [], 0
            texts, docs = batch.column("text"), batch.column("doc_id").to_pylist()
            each = (h for a, b in chunks(texts, CHUNK) for h in shingles.sets(texts.slice(a, b - a)))
            for doc, h in zip(docs, each, strict=True):
                rows.append((doc, len(h), xxhash.xxh3_128_digest(h.tobytes()), parity(h), scheme.signatures(h) if len(h) else h))
                held += len(rows[-1][-1])
                if held > HELD:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, doc_id) -> members of buckets that hold several documents, each with the member
    before it. One row of state, whatever the size of a bucket."""
    held = np.empty(0, np.int64), np.empty(0, np.int64)
    before: tuple[int, int] | None = None

    def step(sig: np.ndarray, doc: np.ndarray, last: bool) -> pa.RecordBatch | None:
        nonlocal before, held
        n = len(sig) if last else len(sig) - 1
        held = sig[n:], doc[n:]
        if n <= 0:
            return None
        first = np.ones(n, bool)
        first[1:] = sig[1:n] != sig[: n - 1]
        previous = np.empty(n, np.int64)
        previous[1:] = doc[: n - 1]
        if before is not None and before[0] == sig[0]:
            first[0], previous[0] = False, before[1]
        goes_on = np.zeros(n, bool)
        goes_on[: len(sig) - 1] = sig[: min(n, len(sig) - 1)] == sig[1 : min(n, len(sig) - 1) + 1]
        before = int(sig[n - 1]), int(doc[n - 1])
        keep = np.where(first, goes_on, previous != doc[:n])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(sig[:n][keep]),
                pa.array(doc[:n][keep]),
                pa.array(np.where(first, 0, previous)[keep], mask=first[keep]),
            ],
            names=["sig", "doc_id", "before"],
        )

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "doc_id")]
        out = step(*(np.concatenate([h, x]) for h, x in zip(held, now, strict=True)), False)
        if out is not None and out.num_rows:
            yield out
    out = step(*held, True)
    if out is not None and out.num_rows:
        yield out


def _allowed(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs with their bitmaps -> the pairs whose bitmaps are close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            for na, nb, bits_a, bits_b in zip(*columns, strict=True):
                a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
                words = min(len(a), len(b))
                apart = int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())
                keep.append((den + num) * apart <= (den - num) * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def _joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) join two components, if all before them do."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _across(num: int, den: int, forest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by bucket block -> ``a, b`` of different components that size and bitmap allow.

    With ``forest`` only as many pairs of each block as would join its components, and ``sig`` alone for the
    buckets in which pairs are left."""

    def pairs(block: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the allowed pairs; all members of a block stand together."""
        size, label, bits = rows["n_shingles"], rows["label"], rows["sketch"]
        words = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w in np.unique(words):  # pairs whose shorter bitmap has w words
            at = np.flatnonzero(words >= w)
            maps = np.empty((len(at), w), np.uint64)
            for v in np.unique(words[at]):
                of = np.flatnonzero(words[at] == v)
                maps[of] = _folded(np.frombuffer(b"".join(bits[at[of]]), np.uint64).reshape(-1, v), w)
            s, lab, short, own = size[at], label[at], words[at] == w, block[at]
            end = np.searchsorted(own, own, side="right")
            i, step = np.arange(len(at)), 1
            while len(i := i[i + step < end[i]]):  # each with the member ``step`` places on
                j = i + step
                ok = (short[i] | short[j]) & (lab[i] != lab[j]) & (den * np.minimum(s[i], s[j]) >= num * np.maximum(s[i], s[j]))
                p, q = i[ok], j[ok]
                apart = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64)
                near = (den + num) * apart <= (den - num) * (s[p] + s[q])
                left.append(at[p[near]])
                right.append(at[q[near]])
                step += 1
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "i", "j", "doc_id", "label", "n_shingles", "sketch"]
        held: dict[str, np.ndarray] | None = None

        def out(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            new = np.ones(len(rows["sig"]), bool)
            new[1:] = (rows["sig"][1:] != rows["sig"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])
            block = np.cumsum(new)
            a, b = pairs(block, rows)
            sigs = np.empty(0, np.int64)
            if forest and len(a):
                _, ids = np.unique(np.stack([block, rows["label"]]), axis=1, return_inverse=True)
                ids = ids.ravel()
                chosen = _joining(ids[a], ids[b])
                sigs = np.unique(rows["sig"][a[~chosen]])
                a, b = a[chosen], b[chosen]
            a, b = rows["doc_id"][a], rows["doc_id"][b]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            columns = [np.concatenate([both[0], np.zeros_like(sigs)]), np.concatenate([both[1], np.zeros_like(sigs)])]
            columns.append(np.concatenate([np.zeros_like(both[0]), sigs]))
            is_sig = np.arange(len(columns[0])) >= len(both[0])
            masks = (is_sig, is_sig, ~is_sig)
            return pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, masks, strict=True)], names=["a", "b", "sig"])

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
            n = len(rows["sig"])
            if not n:
                continue
            last = (rows["sig"] == rows["sig"][-1]) & (rows["i"] == rows["i"][-1]) & (rows["j"] == rows["j"][-1])
            cut = n - int(last.sum())
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield out({c: v[:cut] for c, v in rows.items()})
        if held is not None:
            yield out(held)

    return run


def _compared(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            keep, left, right = [], batch.column("text_a"), batch.column("text_b")
            for at, upto in chunks(left, CHUNK):
                both = zip(shingles.sets(left.slice(at, upto - at)), shingles.sets(right.slice(at, upto - at)), strict=True)
                for a, b in both:
                    same = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(same > 0 and den * same >= num * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if a count shows that it is small enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


class Join:
    """One run of the join: the documents, their classes, and the links between classes."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> None:
        self.n, self.num, self.den = n, num, den
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spark = docs.sparkSession
        self.meta = written(self.docs.mapInArrow(_meta(n, num, den), META), "shingles")
        filled = self.meta.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = filled.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("most"))
        classes = written(classes.where("most > class_id").select("fp", "class_id"), "classes")
        copies = filled.select("doc_id", "fp").join(_few(classes), "fp").where("doc_id <> class_id")
        #: ``doc_id, class_id`` of the documents whose set equals that of a smaller id.
        self.copies = written(copies.select("doc_id", "class_id").distinct(), "copies")
        ids = self.copies.select("doc_id").distinct()
        texts = filled.join(_few(ids), "doc_id", "left_semi").groupBy("doc_id").agg((F.min("fp") == F.max("fp")).alias("one"))
        #: The ids all of whose texts their class stands for; an id with other texts too needs links of its own.
        self.spared = written(texts.where("one").select("doc_id"), "spared")

    def _filtered(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        """The pairs that sizes and bitmaps allow."""
        left = info.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a"))
        right = info.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b"))
        fits = self.den * F.least("na", "nb") >= self.num * F.greatest("na", "nb")
        both = pairs.join(left, "a").join(right, "b").where(fits)
        both = both.select("a", "b", "na", "nb", "bits_a", "bits_b")
        return both.mapInArrow(_allowed(self.num, self.den), "a bigint, b bigint").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough, on their whole texts."""
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        texts = written(self.docs.join(_few(wanted), "doc_id", "left_semi").distinct(), "texts")
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return written(both.select("a", "b", "text_a", "text_b").mapInArrow(_compared(self.n, self.num, self.den), "a bigint, b bigint"), "links").distinct()

    def _open(self, members: DataFrame, roots: DataFrame, info: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components, once per pair of blocks that theirs is in,
        with all that a comparison needs."""
        labelled = members.select("sig", "doc_id").join(roots.toDF("doc_id", "root"), "doc_id", "left")
        labelled = written(labelled.select("sig", "doc_id", F.coalesce("root", "doc_id").alias("label")), "labelled")
        split = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
        split = written(split.where("lo < hi").select("sig", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "split")
        rows = labelled.join(split, "sig")
        # A hot bucket is dealt over blocks by a hash, so that no task sorts or numbers a whole one.
        own, zero = F.pmod(F.xxhash64("doc_id"), F.col("blocks")), F.lit(0).cast("long")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        rows = rows.select("sig", "doc_id", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.join(info.select("doc_id", "n_shingles", "sketch"), "doc_id")
        rows = rows.repartition(n, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", F.xxhash64("sig", "doc_id"), "doc_id")
        return rows.select("sig", "i", "j", "doc_id", "label", "n_shingles", "sketch")

    def links(self) -> DataFrame:
        """``a, b``: verified links, enough to connect all that any link connects."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        first = self.meta.where("doc_id IS NOT NULL").join(_few(self.spared), "doc_id", "left_anti")
        rows = first.select(F.explode("sigs").alias("sig"), "doc_id")
        rows = rows.repartition(n, "sig").sortWithinPartitions("sig", "doc_id")
        members = written(rows.mapInArrow(_buckets, "sig bigint, doc_id bigint, before bigint"), "members")
        known = written(members.select("doc_id").distinct(), "member-ids")
        info = self.meta.select("doc_id", "n_shingles", "bits").join(_few(known), "doc_id", "left_semi").distinct()
        info = written(info.mapInArrow(_sketched, "doc_id bigint, n_shingles bigint, bits binary, sketch binary"), "member-info")

        a, b = F.least("doc_id", "before").alias("a"), F.greatest("doc_id", "before").alias("b")
        tried = self._filtered(members.where("before IS NOT NULL").select(a, b).distinct(), info)
        tried = written(tried, "tried")
        links = self._verified(tried)
        for forest in (True, False):
            rows = self._open(members, components(links), info)
            found = written(rows.mapInArrow(_across(self.num, self.den, forest), "a bigint, b bigint, sig bigint"), "across")
            more = found.where("a IS NOT NULL").select("a", "b").distinct()
            more = written(more.join(tried, ["a", "b"], "left_anti"), "across-new")
            links, tried = links.union(self._verified(more)), tried.union(more)
            # What the bitmaps rule out once stays so: only buckets with pairs left are opened again.
            members = members.join(_few(found.where("sig IS NOT NULL").select("sig").distinct()), "sig", "left_semi")
        return links


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = pa.array([_sketch(b) for b in batch.column("bits").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, sketches], names=[*batch.schema.names, "sketch"])


def joined(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, class_id, component_id``.

    Documents link when ``den * intersection >= num * union`` of their n-gram sets. ``class_id`` is the least
    id with the same set, ``component_id`` the least id reachable by links."""
    join = Join(docs, n, num, den)
    roots = components(join.links()).toDF("class_id", "root")
    copies = join.copies.join(roots, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("root", "class_id").alias("component_id")
    )
    inner = roots.select(F.col("class_id").alias("doc_id"), F.col("class_id"), F.col("root").alias("component_id"))
    known = copies.union(inner)
    # An id with several texts has several rows here; the least component is all of theirs.
    known = written(known.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id")), "known")
    rows = join.meta.select("doc_id", "n_shingles").join(_few(known), "doc_id", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id."""
    found = joined(docs, n, num, den)
    drop = unused_name(docs, "drop")
    dropped = written(found.where("component_id < doc_id").select(F.col("doc_id").alias(drop)).distinct(), "near-dropped")
    return docs.join(_few(dropped), F.col("doc_id") == F.col(drop), "left_anti")
