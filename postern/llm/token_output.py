"""Token-id output: one wavelet-matrix file per shard, in ascending order of ``doc_id``.

Documents are range-partitioned and sorted by id; each task encodes its documents, appends the end id
to each, and writes shards of about ``SHARD`` ids to the shared folder. Files are named by partition and
shard and put in place by an atomic rename, so a task that runs again, or twice at once, leaves the same
files. The manifest of shards is a written table; starts come from it, never from the driver.

Encoding goes through the tokenizers library: where the tokenizer's own configuration says that it drops white
space and splits by the known rule, once per distinct piece of text that a worker has in memory, with ids gathered
by position; otherwise by whole texts.

Defined cases: a null text is empty and has the end id only; null ids come first; repeated ids are
documents of their own; extra columns are ignored; an empty table writes no files and returns no rows;
a text of any length is encoded whole and stays in one shard. Ids of documents are integers of any width.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wavelet
from ._rank import BROADCAST_ROWS
from ._store import chunks, fresh_dir, posix, written

SHARD = 8_000_000
END = 1
#: Distinct parts of text whose ids a worker remembers before it starts afresh (about 150 bytes each with their pieces).
REMEMBERED = 1_200_000
#: Bytes of text that are encoded at once.
CHUNK = 12 << 20

# The configuration under which a text's ids are those of its space-separated parts, and those of a
# plain part are the model's for the pieces below. Any other tokenizer encodes whole texts.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# On parts of these characters the normaliser only lower-cases and the splitting rule is this expression (with a
# line break between parts); other parts go through the whole tokenizer.
_PLAIN = r"^[!-;=-~À-ÖØ-öø-þ]+$"
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-þ]+|[0-9]|[^a-z0-9ß-öø-þ\n]+")


def _by_parts(config: dict) -> bool:
    model, added = config["model"], config["added_tokens"]
    own = all("<" in t["content"] and not any(map(str.isspace, t["content"])) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    settings = [config.get(k) for k in ("truncation", "padding", "post_processor")] == [None] * 3
    same = config["normalizer"] == NORMALIZER and config["pre_tokenizer"] == PRE_TOKENIZER
    return own and plain and settings and same and model["type"] == "BPE"


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start[i] : start[i] + size[i]]`` for every i, one after another."""
    shift = start - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Memory:
    """Numbered sequences of ids in one growing array."""

    def __init__(self) -> None:
        self.flat, self.start, self.size = np.empty(1 << 16, np.uint16), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(ids)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : used] = ids
        self.size[self.n : n] = sizes
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return _gathered(self.flat, self.start[numbers], size), size


def _sizes(each: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, each), np.int64, len(each))


def _flat(each: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(each), np.uint16)


class Encoder:
    """Ids of whole texts, each followed by an end id, as 16-bit integers and counts per text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            self.by_parts = _by_parts(json.load(f))
        self._forget()
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}

    def _forget(self) -> None:
        self.parts = pa.array([], pa.string())
        self.part_ids = Memory()
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_ids = Memory()
        self.piece_ids.add(np.empty(0, np.uint16), np.zeros(1, np.int64))

    def _piece(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def _of_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new plain parts one after another, and their number per part."""
        known, pieces = self.pieces, _PIECES.findall("".join(p + "\n" for p in parts).lower())
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        each = list(map(self._piece, new))
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.piece_ids.add(_flat(each), _sizes(each))
        numbers = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        ids, size = self.piece_ids.get(numbers)
        return ids, np.diff(np.cumsum(size)[numbers == 0], prepend=0)  # the line break after each part

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Numbers of distinct parts, after the new ones have been encoded."""
        at = pc.index_in(parts, value_set=self.parts)
        numbers = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if at.null_count:
            new = parts.filter(at.is_null())
            plain = pc.match_substring_regex(new, _PLAIN)
            simple, other = new.filter(plain), new.filter(pc.invert(plain))
            self.part_ids.add(*self._of_plain(simple.to_pylist()))
            each = [self.whole.encode(p, add_special_tokens=False).ids for p in other.to_pylist()]
            self.part_ids.add(_flat(each), _sizes(each))
            plain, own = plain.to_numpy(zero_copy_only=False), np.empty(len(new), np.int64)
            own[plain] = len(self.parts) + np.arange(len(simple))
            own[~plain] = len(self.parts) + len(simple) + np.arange(len(other))
            numbers[at.is_null().to_numpy(zero_copy_only=False)] = own
            self.parts = pa.concat_arrays([self.parts, simple, other])
        return numbers

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and their number per text."""
        if not self.by_parts:
            each = [[*x.ids, end] for x in self.whole.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return _flat(each), _sizes(each)
        if len(self.parts) > REMEMBERED:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words = lists.flatten()
        filled = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(filled).dictionary_encode()
        numbers = self._numbers(coded.dictionary)
        ids, sizes = self.part_ids.get(numbers[coded.indices.to_numpy(zero_copy_only=False)])
        counts = np.bincount(of[filled.to_numpy(zero_copy_only=False)], weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.insert(ids, np.cumsum(counts), end), counts + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _put(folder: str, name: str, raw: bytes) -> None:
    local = posix(folder)
    if local:
        os.makedirs(local, exist_ok=True)
        draft = f"{local}/.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, f"{local}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(raw)
    store.move(draft, f"{root}/{name}")


def _writer(path: str, folder: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        shard, size, docs, parts, counts = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids, lengths = np.concatenate(parts), np.concatenate(counts)
            _put(folder, f"{part:08d}-{shard:08d}.wm", wavelet.to_bytes(ids, lengths, docs, part, shard))
            row = [[part], [shard], [len(docs)], [len(ids)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in row], names=["part", "shard", "n_docs", "n_tokens"]
            )

        for batch in batches:
            for at, upto in chunks(batch.column("text"), CHUNK):
                ids, n = enc.encode(batch.column("text").slice(at, upto - at), end)
                docs += batch.column("doc_id").slice(at, upto - at).to_pylist()
                parts.append(ids), counts.append(n)
                size += len(ids)
                if size >= SHARD:
                    yield close()
                    shard, size, docs, parts, counts = shard + 1, 0, [], [], []
        if docs:
            yield close()

    return write


def write_shards(docs: DataFrame, tokenizer: str, end: int = END) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and the manifest ``part, shard, n_docs, n_tokens``."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "shards")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(_writer(tokenizer, folder, end), "part bigint, shard bigint, n_docs bigint, n_tokens bigint")
    return folder, written(made, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content"):
            matrix, docs, lengths, part, shard = wavelet.from_bytes(raw.as_buffer().to_pybytes())
            ids = matrix.ids().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part), pa.int64()),
                    pa.array(np.full(n, shard), pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select(
        F.col("part").alias("p"), F.col("shard").alias("s"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    shards = manifest.limit(BROADCAST_ROWS + 1).count()
    schema = "part bigint, shard bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("content")
    rows = files.mapInArrow(_read, schema)
    if shards <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    joined = rows.join(bases, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
