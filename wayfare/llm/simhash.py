"""SimHash near-duplicates through BK-trees.

Fingerprints are computed in one pass over the texts and made distinct. Two fingerprints that differ in at
most three bits agree on one of their four 16-bit blocks, so each block value names a shard, and each
fingerprint goes to four of them: no pair is lost. In each shard a BK-tree is grown (children keyed by their
integer Hamming distance to the parent) and every fingerprint of the shard is searched for in it, following
only edges whose distance differs from the query's by at most the radius. Links become components: first
inside a shard, then across shards by joins.

Copies share one fingerprint and so one node; a group of thousands of copies costs no more than one text.
Subtrees that already belong to the query's component are not searched again, which keeps a large group of
near copies from costing the square of its size; no connection is lost by that. A shard of more than
``split_over`` fingerprints is dealt out again by four blocks of the other 48 bits, which is exact too.

Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Nodes are
fingerprints, so rows with a null id are returned and link others like any row; the component is the smallest
id that is not null, null if there is none. Repeated ids are rows of their own: two texts are not linked
by having one id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wayfare.llm.words import slices, texts_of, words_of
from wayfare.plans.components import connected_components
from wayfare.plans.shared import cut

RADIUS = 3
SHINGLE = 3
SEED = 42
SPLIT_OVER = 200_000
_SPAN = 1 << 17


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = words_of(texts, lower=True)
    sizes = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = words.counts
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    ends = np.zeros(len(n_shingles) + 1, dtype=np.int64)
    np.cumsum(n_shingles, out=ends[1:])
    joined = b" ".join(pc.cast(words.dictionary.take(pa.array(words.codes)), pa.binary()).to_pylist())
    stop = np.cumsum(sizes[words.codes] + 1) - 1
    start = stop - sizes[words.codes]
    first = np.repeat(words.offsets[:-1] - ends[:-1], n_shingles) + np.arange(ends[-1])
    last = np.minimum(first + shingle, np.repeat(words.offsets[1:], n_shingles)) - 1
    one = xxhash.xxh64_intdigest
    sums = np.zeros((len(texts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    for at in range(0, int(ends[-1]), _SPAN):
        to = min(at + _SPAN, int(ends[-1]))
        h = np.fromiter((one(joined[a:b], seed) for a, b in zip(start[first[at:to]].tolist(), stop[last[at:to]].tolist(), strict=True)), dtype="<u8", count=to - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[at:to]
        heads = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        sums[mine[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    packed = np.packbits(2 * sums > n_shingles[:, None], axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1)


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fingerprints(texts_of(batch), shingle, seed).view(np.int64))], names=["doc_id", "fp"])

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree for each shard of an array of (shard, fingerprint), all grown and searched together.

    ``shard`` must be sorted. Node i of the forest is element i; the first of each shard is its root. Elements
    go down level by level: at a node, those at one distance share an edge, and the first of them becomes the
    child that the others go on to, which is the tree that inserting them one by one gives.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.root = np.maximum.accumulate(np.where(np.concatenate(([True], shard[1:] != shard[:-1])), np.arange(n), 0)) if n else np.zeros(0, np.int64)
        self.parent = np.full(n, -1, dtype=np.int64)
        self.edge = np.zeros(n, dtype=np.int64)
        self.levels: list[np.ndarray] = [np.flatnonzero(self.root == np.arange(n))]
        going = np.flatnonzero(self.root != np.arange(n))
        at = self.root[going]
        while len(going):
            d = _distance(fp[going], fp[at])
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            child = going[order][head]
            self.parent[child], self.edge[child] = at[order][head], d[order][head]
            self.levels.append(child)
            nearest = np.empty(len(going), dtype=np.int64)
            nearest[order] = child[np.cumsum(head) - 1]
            stay = nearest != going
            going, at = going[stay], nearest[stay]
        kids = np.flatnonzero(self.parent >= 0)
        keys = self.parent[kids] * 65 + self.edge[kids]
        order = np.argsort(keys, kind="stable")
        self.kids, self.keys = kids[order], keys[order]

    def settled(self, label: np.ndarray) -> np.ndarray:
        """The component of each subtree that lies in one component, else -1."""
        low, high = label.copy(), label.copy()
        for level in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return np.where(low == high, low, -1)

    def components(self, radius: int, block: int = 8192, wide: int = 1 << 20) -> np.ndarray:
        """For each element the first element of its component inside its shard."""
        n = len(self.fp)
        near = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        label = _hook(np.arange(n), near, self.parent[near])
        for begin in range(0, n, block):
            settled = self.settled(label)
            query = np.arange(begin, min(begin + block, n))
            todo = [(query, self.root[query])]
            while todo:
                query, node = todo.pop()
                if len(query) > wide:
                    half = len(query) // 2
                    todo += [(query[half:], node[half:]), (query[:half], node[:half])]
                    continue
                open_ = settled[node] != label[query]
                query, node = query[open_], node[open_]
                if not len(query):
                    continue
                d = _distance(self.fp[query], self.fp[node])
                hit = (d <= radius) & (label[query] != label[node])
                if hit.any():
                    label = _hook(label, query[hit], node[hit])
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                size = high - low
                if size.any():
                    to = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    todo.append((np.repeat(query, size), self.kids[to]))
        return label


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of a[i] and b[i]; labels stay the smallest element and are their own label."""
    label = label.copy()
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            after = label[label]
            if np.array_equal(after, label):
                break
            label = after
    return label


def _shard_links(radius: int, gather: int = 150_000):
    """Arrow function over rows sorted by shard (shard, fp): (a, b) joins fingerprints of one component of a shard."""

    def solve(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        head = Forest(shard, fp).components(radius)
        far = np.flatnonzero(head != np.arange(len(head)))
        return pa.RecordBatch.from_arrays([pa.array(fp[far].view(np.int64)), pa.array(fp[head[far]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append((batch.column("shard").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            held += batch.num_rows
            if held < gather:
                continue
            shard, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
            last = int(np.searchsorted(shard, shard[-1], "left"))  # the last shard may go on in the next batch
            if last:
                yield solve(shard[:last], fp[:last])
            kept, held = [(shard[last:], fp[last:])], len(shard) - last
        if kept:
            yield solve(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def simhash_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer. One pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(shingle, seed), "doc_id long, fp long")


def _shards(prints: DataFrame, split_over: int) -> DataFrame:
    block = lambda i: F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF).alias("v"))
    first = prints.select("fp", F.explode(F.array(*map(block, range(4)))).alias("s")).select("fp", "s.i", "s.v")
    # A hot shard agrees on 16 bits; at most four times the fingerprints over the bound are so: few rows to broadcast.
    hot = first.groupBy("i", "v").count().where(F.col("count") > split_over).select("i", "v", F.lit(True).alias("hot"))
    marked = first.join(F.broadcast(hot), ["i", "v"], "left")
    # The other 48 bits, moved together, in four blocks of 12.
    other = F.expr("CASE i WHEN 0 THEN shiftrightunsigned(fp, 16) WHEN 1 THEN (fp & 65535) | shiftleft(shiftrightunsigned(fp, 32), 16) WHEN 2 THEN (fp & 4294967295) | shiftleft(shiftrightunsigned(fp, 48), 32) ELSE fp & 281474976710655 END")
    part = lambda j: F.struct(F.lit(j + 1).alias("j"), F.shiftrightunsigned(F.col("rest"), 12 * j).bitwiseAND(0xFFF).alias("w"))
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("w")))
    spread = marked.withColumn("rest", other).select("fp", "i", "v", F.explode(F.when(F.col("hot"), F.array(*map(part, range(4)))).otherwise(whole)).alias("s"))
    return spread.select(((F.col("i") * 65536 + F.col("v")) * 5 * 4096 + F.col("s.j") * 4096 + F.col("s.w")).cast("long").alias("shard"), "fp")


def simhash_links(prints: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """(a, b): each fingerprint of a shard's component with its first. ``prints``: (fp), each once."""
    if radius > 3:
        raise ValueError("four blocks find pairs of at most three differing bits")
    sharded = _shards(prints, split_over).repartition("shard").sortWithinPartitions("shard", "fp")
    return sharded.mapInArrow(_shard_links(radius), "a long, b long")


def simhash_components(prints: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER, rows: int | None = None) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of ``prints`` (doc_id, fp), of which there may be about ``rows``."""
    everyone = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), rows)
    heads = connected_components(simhash_links(everyone.select("fp"), radius, split_over), rows=rows)
    named = everyone.join(heads, everyone["fp"] == heads["node"], "left").select("fp", "doc", F.coalesce("component", "fp").alias("head"))
    least = named.groupBy("head").agg(F.min("doc").alias("component_id"))
    return named.join(least, "head").select("fp", "component_id")


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, split_over: int = SPLIT_OVER) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text); see the module's text.

    The fingerprints are written once to the shared folder; the texts are never shuffled.
    """
    prints = cut(simhash_fingerprints(docs, shingle, seed))
    classes = simhash_components(prints, radius, split_over)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id. Rows without an id stay; rows of one id stay or go together."""
    found = simhash_duplicates(docs, radius, shingle, seed)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
