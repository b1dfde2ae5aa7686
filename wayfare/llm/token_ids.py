"""Token ids in binary shards with a minimal perfect hash index.

A shard is one file: a header, the ids of its documents back to back, the first id's position of each
document, the document keys, and the index. The index maps a key to its record in constant time: a hash
with levels of bit arrays (Limasset et al., "Fast and scalable minimal perfect hashing for massive key
sets", 2017) gives each of n keys one of n slots; the slot holds a 32-bit fingerprint of the key, which
turns away most keys that the shard lacks, and the record's number. Ids are unsigned 16-bit integers where
the vocabulary allows it, else 32-bit.

Documents are dealt to ranges of ascending keys, one task each, and a range to files of a bounded size; so the files
in order hold all ids in order of the keys. A file says how many ids of its range come before it, so where a file's
ids begin among all ids needs one small row for each range, and the number of ranges is bounded. A key with more
rows than a range holds gets further ranges, and so have the rows without a key. Files are written whole under
their final name's temporary sibling and then renamed, so a task that is run again writes the same file again.

Null texts count as empty and have the end id alone. Rows with a repeated key are records of their own; their order
among themselves is by range, then by ids; the index leads to the first in the file. Rows without a key come first
and are not indexed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayfare.llm.words import mixed, slices, spread, texts_of, words_of
from wayfare.plans.shared import cut, scratch_path

MAGIC = b"WFIDS\x02\0\0"
#: magic, bytes of an id, records, keyed records, ids, ids of the range before, and where the five parts after the ids begin.
HEADER = struct.Struct("<8sQQQQQ5Q")
#: Rows of a range, about, the most ranges there are (beyond that they get longer), and bytes of ids in one file.
SHARD_ROWS, MAX_RANGES, FILE_BYTES = 4096, 16_384, 16 << 20
_FILES = 1 << 20
#: Stores that pyarrow knows by another scheme.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
MAX_MEMO = 600_000


# --- index ---------------------------------------------------------------------------------------------


def _level_hash(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 3)) & 0xFFFFFFFFFFFFFFFF)
    return (mixed(keys ^ salt) % np.uint64(bits)).astype(np.int64)


def _print_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys + np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys. Keys that collide on a level go to the next one."""

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:  # set bits before each 64-bit word
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.concatenate(([0], np.cumsum(ones)[:-1])))
            total += int(ones.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            n_words = max(1, -(-cls.GAMMA * len(left) // 64))
            at = _level_hash(left, len(levels), n_words * 64)
            alone = np.bincount(at, minlength=n_words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys that were not there."""
        left = np.asarray(keys, dtype=np.int64).view(np.uint64)
        out = np.full(len(left), -1, dtype=np.int64)
        todo = np.arange(len(left))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _level_hash(left[todo], level, len(bits) * 64)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            there = (bits[word] >> shift) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[todo[there]] = ranks[word[there]] + np.bitwise_count(below[there])
            todo = todo[~there]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) for x in self.levels) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<Q", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 8), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels)


# --- files ---------------------------------------------------------------------------------------------


def pack_shard(keys: np.ndarray, no_key: np.ndarray, ends: np.ndarray, payload: bytes, width: int, before: int = 0) -> bytes:
    """A shard's bytes. ``ends[i]`` ids belong to the records up to i; records without a key come first.

    ``before``: ids of the shard's range in the files before it.
    """
    keyed = np.flatnonzero(~no_key)
    first = keyed[np.concatenate(([True], keys[keyed][1:] != keys[keyed][:-1]))] if len(keyed) else keyed
    index = PerfectHash.build(keys[first])
    slots = index.slots(keys[first])
    prints, records = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u8")
    prints[slots], records[slots] = _print_of(keys[first].astype(np.int64).view(np.uint64)), first
    starts = np.concatenate(([0], ends)).astype("<u8")
    parts = [starts.tobytes(), keys.astype("<i8").tobytes(), prints.tobytes(), records.tobytes(), index.to_bytes()]
    at = HEADER.size + len(payload) + np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    return HEADER.pack(MAGIC, width, len(keys), len(keyed), int(ends[-1]) if len(ends) else 0, before, *map(int, at)) + payload + b"".join(parts)


class Shard:
    """A shard opened from its bytes."""

    def __init__(self, data: bytes):
        magic, width, n, keyed, self.n_ids, self.before, starts, keys, prints, records, index = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, HEADER.size)
        self.starts = np.frombuffer(data, "<u8", n + 1, starts).astype(np.int64)
        self.keys = np.frombuffer(data, "<i8", n, keys)
        self.no_key = n - keyed
        self.index = PerfectHash.from_bytes(data[index:])
        self.prints = np.frombuffer(data, "<u4", self.index.size, prints)
        self.records = np.frombuffer(data, "<u8", self.index.size, records).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 if the shard lacks it; constant time for each key."""
        keys = np.asarray(keys, dtype=np.int64)
        slots = self.index.slots(keys)
        out = np.where(slots >= 0, self.records[np.maximum(slots, 0)] if self.index.size else -1, -1)
        seen = slots >= 0
        seen[seen] = self.prints[slots[seen]] == _print_of(keys[seen].view(np.uint64))
        seen[seen] = self.keys[out[seen]] == keys[seen]  # the fingerprint turns most strangers away, the key the rest
        return np.where(seen, out, -1)

    def record(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]


def write_file(path: str, data: bytes) -> None:
    """Write by rename, in any store that pyarrow knows by its scheme."""
    scheme, colon, rest = path.partition(":")
    fs, at = pa.fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)
    part = f"{at}.{zlib.crc32(data):08x}.part"
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


# --- encoding ------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts by distinct word.

    The vocabulary's splitter drops white space and never joins across it, lower-cases first, and parts letters
    from punctuation. So a text's ids are those of its words; the punctuation that a word ends with is a piece of
    its own; and words of letters alone, which are one piece each, can be encoded many to a call and parted again at
    the tokens that end a piece.
    """

    #: Neither letters, numbers nor white space, by the splitter too.
    PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(vocabulary)
        size = self.tool.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.ends = np.fromiter(((self.tool.id_to_token(i) or "").endswith("</w>") for i in range(size)), dtype=bool, count=size)
        self.memo: dict[bytes, bytes] = {}

    def _singly(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            for word, coded in zip(some, self.tool.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.memo[word] = np.array(coded.ids, dtype=self.dtype).tobytes()

    def _together(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.tool.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some) or stop[-1] != len(ids):
                self._singly(some)
                continue
            data, stop = ids.tobytes(), (stop * self.width).tolist()
            self.memo.update(zip(some, (data[a:b] for a, b in zip([0, *stop], stop)), strict=True))

    def learn(self, words: set[bytes]) -> None:
        memo, bases = self.memo, {}
        for word in words:
            if word.isalpha():
                continue
            base = word.rstrip(self.PUNCTUATION)
            # Lower case may end in a mark where the letter does not, and a mark goes on with what follows.
            if base and len(base) < len(word) and b"<|" not in word and (base[-1:].isalnum() or not base.isascii() and base.decode().lower()[-1].isalpha()):
                bases[word] = base
        need = words.difference(bases).union(bases.values(), {w[len(b) :] for w, b in bases.items()}).difference(memo)
        plain = [w for w in need if w.isalpha() or not w.isascii() and w.decode().isalpha()]
        self._together(plain)
        self._singly(list(need.difference(plain)))
        for word, base in bases.items():
            memo[word] = memo[base] + memo[word[len(base) :]]

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last one's end."""
        if len(self.memo) > MAX_MEMO:
            self.memo.clear()
        # Special tokens are seen before case is.
        words = words_of(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.learn(set(distinct).difference(self.memo))
        parts = list(map(self.memo.__getitem__, distinct))
        ends = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // self.width, out=ends[1:])
        return spread(ends, np.frombuffer(b"".join(parts), self.dtype), words.codes, words.offsets)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        ids, offsets = self.ids_of(pa.array(texts, pa.binary()).cast(pa.string()))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()


@dataclass
class Ranges:
    """Ranges of ascending keys, after ``nameless`` ranges for rows without a key.

    Range i has the keys over ``bounds[i - 1]`` up to ``bounds[i]``. A bound that is there more than once is a key with
    several ranges, to which its rows are dealt in turn.
    """

    bounds: np.ndarray
    nameless: int

    @property
    def size(self) -> int:
        return self.nameless + len(self.bounds) + 1

    def of(self, keys: pa.Array, place: np.ndarray) -> np.ndarray:
        """The range of each row; ``place`` numbers the rows of a task."""
        none = keys.is_null().to_numpy(zero_copy_only=False)
        values = keys.fill_null(0).to_numpy()
        low = np.searchsorted(self.bounds, values, "left")
        wide = np.maximum(np.searchsorted(self.bounds, values, "right") - low, 1)
        turn = mixed(place.astype(np.uint64))
        return np.where(none, (turn % np.uint64(max(1, self.nameless))).astype(np.int64), self.nameless + low + (turn % wide.astype(np.uint64)).astype(np.int64))


def _encode_batches(vocabulary: str, end_id: int, ranges: Ranges):
    """Arrow function over (doc_id, text): each row's range by its key, and its ids."""
    tool: list[WordEncoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in slices(batches, size=4 << 20):
            tool or tool.append(WordEncoder(vocabulary))
            found, offsets = tool[0].ids_of(texts_of(batch))
            ends = offsets + np.arange(len(offsets))
            ids = np.empty(ends[-1], dtype=tool[0].dtype)
            last = np.zeros(len(ids), dtype=bool)
            last[ends[1:] - 1] = True
            ids[last], ids[~last] = end_id, found
            binary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((ends * tool[0].width).astype(np.int32)), pa.py_buffer(ids)])
            keys = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(keys, place + np.arange(len(keys))).astype(np.int32)), keys, binary], names=["range", "doc_id", "ids"])
            place += len(keys)

    return run


def _write_shards(folder: str, width: int):
    """Arrow function over a range's rows sorted by (doc_id, ids): writes its files, gives (shard, range, n_ids, n_rows) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int, int]] = []
        at, rows, held, before = None, [], 0, 0

        def close() -> None:
            keys = np.array([0 if k is None else k for k, _ in rows], dtype=np.int64)
            ends = np.cumsum([len(x) // width for _, x in rows])
            shard = at * _FILES + sum(r == at for _, r, _, _ in done)
            write_file(f"{folder}/shard-{shard:016d}.ids", pack_shard(keys, np.array([k is None for k, _ in rows]), ends, b"".join(x for _, x in rows), width, before))
            done.append((shard, at, int(ends[-1]), len(rows)))

        for batch in batches:
            for range_, key, ids in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if range_ != at or held > FILE_BYTES:
                    if rows:
                        close()
                    before = before + done[-1][2] if range_ == at else 0
                    at, rows, held = range_, [], 0
                rows.append((key, ids))
                held += len(ids)
        if rows:
            close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["shard", "range", "n_ids", "n_rows"]).astype("int64"), preserve_index=False)

    return run


def _ranges(docs: DataFrame, rows: int) -> Ranges:
    """Ranges of about ``rows`` rows, at most ``MAX_RANGES`` and as many again without a key; from the key column alone."""
    n, nameless = docs.select(F.count("doc_id"), F.count_if(F.isnull("doc_id"))).first()
    rows = max(rows, -(-n // MAX_RANGES), -(-nameless // MAX_RANGES))
    parts = max(1, -(-n // rows))
    cuts = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], min(0.001, 0.2 / parts)) if parts > 1 else []
    return Ranges(np.sort(np.array(cuts, dtype=np.float64).astype(np.int64)), -(-nameless // rows))


def write_token_ids(docs: DataFrame, vocabulary: str, folder: str, end_id: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files below ``folder``; (shard, range, n_ids, n_rows) of each.

    Texts are encoded where they are read; what is shuffled, once, is their ids. Each range is a task, by its number.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = _ranges(keyed, shard_rows)
    coded = keyed.mapInArrow(_encode_batches(vocabulary, end_id, ranges), "range int, doc_id long, ids binary")
    dealt = coded.repartitionById(ranges.size, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    width = WordEncoder(vocabulary).width
    return cut(dealt.mapInArrow(_write_shards(folder, width), "shard long, range long, n_ids long, n_rows long"))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            shard = Shard(content.as_buffer())
            found = shard.find(shard.keys[shard.no_key :])
            # A key's first record comes from the index; its repeats follow it, and keyless records are first.
            record = np.arange(len(shard.keys))
            run = np.concatenate(([0], np.cumsum(np.diff(found) != 0))) if len(found) else found
            begin = np.concatenate(([0], np.flatnonzero(np.diff(found) != 0) + 1)) if len(found) else found
            record[shard.no_key :] = found + np.arange(len(found)) - begin[run] if len(found) else found
            crc = [zlib.crc32(shard.record(i).astype("<u4").tobytes()) for i in record]
            keys = pa.array(shard.keys, mask=np.arange(len(shard.keys)) < shard.no_key)
            range_ = int(name.rpartition("shard-")[2].partition(".")[0]) // _FILES
            yield pa.RecordBatch.from_arrays(
                [pa.array([range_] * len(crc), pa.int64()), keys, pa.array(shard.before + shard.starts[record]), pa.array(shard.starts[record + 1] - shard.starts[record]), pa.array(crc, pa.int64())],
                names=["range", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_ids(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record, looked up through each shard's index.

    ``shards`` is what :func:`write_token_ids` gave. The sums of its ranges, of which there are a bounded number, are
    added up in order on the driver; the files are read by Spark, whatever store they are in.
    """
    sizes = shards.groupBy("range").agg(F.sum("n_ids").alias("n_ids")).orderBy("range").toPandas()
    if not len(sizes):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    sizes["base"] = sizes["n_ids"].cumsum() - sizes["n_ids"]
    base = spark.createDataFrame(sizes[["range", "base"]])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").load(folder).select("path", "content")
    rows = files.mapInArrow(_read_shards, "range long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "range").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_id_round_trip(docs: DataFrame, vocabulary: str, end_id: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the ids of ``docs`` to fresh shard files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    return read_token_ids(spark, folder, write_token_ids(docs, vocabulary, folder, end_id, shard_rows))
