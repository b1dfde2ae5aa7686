"""Near copies beyond the reach of SimHash.

At a radius of three bits SimHash finds close copies only. This module starts from the SimHash components and joins
to them the pairs that min-hash bands propose and that their whole texts confirm.

One pass gives each row a key of its text, its SimHash and 64 min-hashes. Equal texts are one node, so copies cost one
row in the joins below. A band is four min-hashes; 16 bands miss a pair of similarity 0.8 once in five thousand.
The members of a band's bucket that are in different components meet: first by min-hash, then those that are likely
by their whole texts. No pair that shares a band and is likely is left out, whatever the size of its bucket:

* A bucket is dealt out in blocks, of a bounded number of texts and of bytes, and the members of a block meet.
* What that joins becomes one component. Buckets of several blocks that still hold more than one component are dealt
  again: the blocks of their largest component meet the blocks of all other members, and these meet each other. Members
  of one component need not meet, so a large group costs its members times those outside its main component.

Links are between components and so few. A row without an id links others like any row; rows of one id are one
document: their texts join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wayfare.llm.simhash import RADIUS, SEED, SPLIT_OVER, fingerprints, simhash_components
from wayfare.llm.words import hashes_of, mixed, slices, texts_of, words_of
from wayfare.plans.components import connected_components
from wayfare.plans.shared import cut, n_files

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Estimated similarity from which a pair is compared in full.
LIKELY = 0.5
#: Texts and their bytes in a block, about; two blocks at most are held at once.
BLOCK, BLOCK_BYTES = 512, 8 << 20
_ODD = (mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's word shingles and their offsets; a shorter text is one shingle, none has none."""
    words = words_of(texts, lower=True)
    counts = words.counts
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    ends = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(words.offsets[:-1] - ends[:-1], n) + np.arange(ends[-1])
    stop = np.repeat(words.offsets[1:], n)
    mark = hashes_of(words.dictionary)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    key = np.zeros(len(first), dtype=np.uint64)
    for j in range(size):
        at = first + j
        key = key * np.uint64(0xD6E8FEB86659FD93) + np.where(at < stop, mark[np.minimum(at, max(len(mark) - 1, 0))] if len(mark) else np.uint64(0), np.uint64(j))
    return mixed(key), ends


def min_hashes(key: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) min-hashes; texts without shingles have ones of their own row of zeros."""
    out = np.zeros((len(ends) - 1, len(_ODD)), dtype=np.uint64)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        for k, odd in enumerate(_ODD):
            out[some, k] = np.minimum.reduceat(key * odd, ends[some])
    return out


SKETCH = "doc_id long, node long, key binary, size long, fp long, bands array<long>, sig binary"


def _keys(texts: pa.Array) -> list[bytes]:
    import hashlib

    return [hashlib.blake2b(x, digest_size=16).digest() for x in texts.cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = texts_of(batch)
        low = min_hashes(*shingles(texts))
        bands = np.zeros((len(low), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            for r in range(ROWS):
                bands[:, b] = mixed(bands[:, b] ^ low[:, b * ROWS + r]) + np.uint64(b + 1)
        sig = mixed(low).astype("<u2")
        size, keys, ids = pc.binary_length(texts).cast(pa.int64()), _keys(texts), batch.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [ids, _nodes(ids, keys), pa.array(keys, pa.binary()), size, pa.array(fingerprints(texts, 3, SEED).view(np.int64)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sig], pa.binary())],
            names=["doc_id", "node", "key", "size", "fp", "bands", "sig"],
        )


def _nodes(ids: pa.Array, keys: list[bytes]) -> pa.Array:
    """The id of each row, or a negative number made of its key."""
    return pa.array([int.from_bytes(key[:8], "big") | -(1 << 63) if i is None else i for i, key in zip(ids.to_pylist(), keys, strict=True)], pa.int64())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text): rows that a batch repeats come once."""
    for batch in slices(batches):
        texts = texts_of(batch)
        keys = _keys(texts)
        nodes = _nodes(batch.column("doc_id"), keys)
        first = {at: i for i, at in reversed(list(enumerate(zip(nodes.to_pylist(), keys, strict=True))))}
        rows = pa.array(list(first.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([nodes.take(rows), pa.array(keys, pa.binary()).take(rows), texts.take(rows)], names=["doc", "key", "text"])


def _whole_cells(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells, of about ``size`` bytes or one cell, and the cells' offsets; input is sorted by cell."""
    held, have = [], 0
    for batch in slices(batches, column, size):
        held.append(batch)
        have += batch.nbytes
        if have < size:
            continue
        table = pa.Table.from_batches(held)
        cell = table.column("cell").to_numpy()
        last = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on in the next batch
        if last:
            yield table.slice(0, last), _offsets(cell[:last])
        held = table.slice(last).combine_chunks().to_batches()
        have = sum(x.nbytes for x in held)
    if held:
        table = pa.Table.from_batches(held)
        yield table, _offsets(table.column("cell").to_numpy())


def _offsets(sorted_: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a likely partner in it, in another component, with no shared band before."""
    for table, ends in _whole_cells(batches, "sig", 1 << 20):
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        head, part, band = (table.column(c).to_numpy() for c in ("head", "part", "band"))
        inner = table.column("inner").to_numpy()
        keep = np.zeros(len(sig), dtype=bool)
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            some = slice(begin, end)
            if (head[some] == head[begin]).all():
                continue
            apart = head[some, None] != head[None, some]
            if not inner[begin]:
                apart &= part[some, None] != part[None, some]
            x, y = np.nonzero(np.triu(apart))
            for at in range(0, len(x), 1 << 15):
                i, j = x[at : at + (1 << 15)] + begin, y[at : at + (1 << 15)] + begin
                same = sig[i] == sig[j]
                good = same.mean(axis=1) >= LIKELY
                good[good] = same[good].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[begin]
                keep[i[good]] = keep[j[good]] = True
        yield from table.select(["cell", "doc", "key", "head"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _links(head: np.ndarray, key: np.ndarray, ends: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a cell's texts of at least ``similarity`` that join its components; pairs within one are skipped."""
    sets = [np.unique(key[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    size = np.array([len(x) for x in sets])
    ends = np.concatenate(([0], np.cumsum(size)))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, out = head.copy(), []
    mine = np.zeros(len(values), dtype=bool)
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(others):
            continue
        own = codes[ends[i] : ends[i + 1]]
        mine[own] = True
        if 2 * size[others].sum() < ends[-1]:
            same = np.array([np.count_nonzero(mine[codes[ends[j] : ends[j + 1]]]) for j in others.tolist()])
        else:
            total = np.concatenate(([0], np.cumsum(mine[codes])))
            same = (total[ends[1:]] - total[ends[:-1]])[others]
        mine[own] = False
        for j in others[same >= similarity * (size[i] + size[others] - same)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in _whole_cells(batches, "text", 4 << 20):
            head = table.column("head").to_numpy()
            key, ends = shingles(texts_of(table.combine_chunks().to_batches()[0]))
            pairs = [(begin + i, begin + j) for begin, end in zip(cells[:-1].tolist(), cells[1:].tolist(), strict=True) for i, j in _links(head[begin:end], key, ends[begin : end + 1], similarity)]
            a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(head[a]), pa.array(head[b])], names=["a", "b"])

    return run


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, split_over: int = SPLIT_OVER, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of each id of ``docs`` (doc_id, text); the id of a component is its smallest.

    Equal texts, texts within ``radius`` bits of SimHash, and confirmed pairs are joined. Null texts count as
    empty; texts without words are all equal here. Rows of one id are one document: its texts join. Rows without
    an id have no row in the result, but link others.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(texts.mapInArrow(_sketch, SKETCH))
    grouped = sketch.groupBy("key").agg(F.min("doc_id").alias("id"), F.min("node").alias("node"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    rows = sketch.count()
    nodes = cut(grouped.withColumn("doc", F.coalesce("id", "node")), rows)
    classes = simhash_components(nodes.select(F.col("doc").alias("doc_id"), "fp"), radius, split_over, rows)
    heads = cut(nodes.select("doc", "id", "key", "fp").join(classes, "fp").select("doc", "id", "key", F.col("component_id").alias("head")), rows)
    links = _met(texts, _blocks(nodes, heads, block), similarity, rows).union(_one_id(sketch, heads))
    heads = cut(_after(heads, links, rows), rows)
    crowded = cut(_crowded(nodes, heads, block), rows)
    if not crowded.isEmpty():
        heads = _after(heads, _met(texts, _pairs_of_blocks(nodes, heads, crowded), similarity, rows), rows)
    least = heads.groupBy("head").agg(F.min("id").alias("component_id"))
    named = heads.join(least, "head").select("key", "component_id")
    return sketch.where("doc_id is not null").select("doc_id", "key").join(named, "key").select("doc_id", "component_id").distinct()


def _after(heads: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``heads`` with the components that ``links`` (a, b) joins as one."""
    joined = connected_components(links, rows=rows)
    return heads.join(joined, F.col("head") == F.col("node"), "left").select("doc", "id", "key", F.coalesce("component", "head").alias("head"))


def _one_id(sketch: DataFrame, heads: DataFrame) -> DataFrame:
    """Links between the components of an id's different texts."""
    several = sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    found = sketch.select("doc_id", "key").join(several, "doc_id", "left_semi").join(heads.select("key", "head"), "key").groupBy("doc_id", "head").agg(F.count("*").alias("n"))
    return found.join(found.groupBy("doc_id").agg(F.min("head").alias("b")), "doc_id").where("head <> b").select(F.col("head").alias("a"), "b")


def _met(texts: DataFrame, cells: DataFrame, similarity: float, rows: int) -> DataFrame:
    """(a, b): components that a pair of texts of a cell joins. Texts that nobody may be like are not shuffled to it."""
    likely = cells.mapInArrow(_likely, "cell long, doc long, key binary, head long")
    met = cut(likely.repartition(n_files(texts.sparkSession, rows)))  # dealt anew: the search keeps all its tasks
    wanted = met.select("doc", "key").distinct()
    whole = texts.mapInArrow(_keyed, "doc long, key binary, text string").join(wanted, ["doc", "key"], "left_semi").groupBy("doc", "key").agg(F.min("text").alias("text"))
    pairs = met.join(whole, ["doc", "key"]).repartition("cell").sortWithinPartitions("cell", "doc")
    return pairs.select("cell", "head", "text").mapInArrow(_confirm(similarity), "a long, b long")


def _buckets(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    return nodes.select("doc", "size", "bands").join(heads.select("doc", "head"), "doc").select("doc", "head", "size", F.posexplode("bands").alias("band", "value"))


def _parts(n: str, size: str, block: int):
    """Blocks that hold about ``block`` texts and ``BLOCK_BYTES`` bytes at most."""
    return F.ceil(F.greatest(F.col(n) / block, F.col(size) / BLOCK_BYTES)).cast("long")


def _dealt(parted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of (value, band, doc, head, part, others) to cells of (value, part, other), sorted by cell."""
    spread = parted.withColumn("other", F.explode("others"))
    cell = F.xxhash64("value", F.least("part", "other"), F.greatest("part", "other")).alias("cell")
    rows = spread.select(cell, (F.col("part") == F.col("other")).alias("inner"), "band", "part", "doc", "head")
    return rows.join(nodes.select("doc", "key", "sig"), "doc").select("cell", "inner", "band", "part", "doc", "key", "head", "sig").repartition("cell").sortWithinPartitions("cell", "doc")


def _blocks(nodes: DataFrame, heads: DataFrame, block: int) -> DataFrame:
    """Cells of single blocks: those of buckets in more than one component. Blocks differ by band."""
    buckets = _buckets(nodes, heads)
    open_ = buckets.groupBy("value").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("head").alias("low"), F.max("head").alias("high")).where("low <> high").select("value", _parts("n", "bytes", block).alias("blocks"))
    part = F.pmod(F.xxhash64("doc", "band"), "blocks")
    return _dealt(buckets.join(open_, "value").withColumn("part", part).withColumn("others", F.array("part")), nodes)


def _crowded(nodes: DataFrame, heads: DataFrame, block: int) -> DataFrame:
    """(value, main, mains, others): buckets of several blocks and components; the largest component, its blocks and those of the rest."""
    sizes = _buckets(nodes, heads).groupBy("value", "head").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    whole = sizes.groupBy("value").agg(F.sum("n").alias("all_n"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "head", "bytes")).alias("main"), F.count("*").alias("heads"))
    rest = whole.where((F.col("heads") > 1) & (_parts("all_n", "all_bytes", block) > 1)).select("value", F.col("main.head").alias("main"), F.col("main.n").alias("n"), F.col("main.bytes").alias("bytes"), (F.col("all_n") - F.col("main.n")).alias("rest_n"), (F.col("all_bytes") - F.col("main.bytes")).alias("rest_bytes"))
    return rest.select("value", "main", F.greatest(_parts("n", "bytes", block), F.lit(1)).alias("mains"), F.greatest(_parts("rest_n", "rest_bytes", block), F.lit(1)).alias("rests"))


def _pairs_of_blocks(nodes: DataFrame, heads: DataFrame, crowded: DataFrame) -> DataFrame:
    """Cells of two blocks, of which one at least is outside the bucket's largest component.

    Blocks of that component have the numbers below ``mains``, the others those from there on.
    """
    rows = _buckets(nodes, heads).join(crowded, "value")
    inside = F.col("head") == F.col("main")
    hashed = F.xxhash64("doc")
    part = F.when(inside, F.pmod(hashed, "mains")).otherwise(F.col("mains") + F.pmod(hashed, "rests"))
    others = F.sequence(F.when(inside, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rests") - 1)
    return _dealt(rows.withColumn("part", part).withColumn("others", others), nodes)


def one_of_each_group(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id. Rows without an id stay; rows of one id stay or go together."""
    dropped = near_copies(docs, similarity).where("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
