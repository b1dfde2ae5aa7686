"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and stripped of edge punctuation; what is empty then is no word. One pass over the
corpus counts the words that benchmark items use. A seed is, at each place of an item, the shortest n-gram
whose expected share under those counts is rare; common words thus give longer seeds, and a passage that
itself fills the corpus does not lose its seeds. A second pass joins the seeds to all texts (the items are
broadcast, in blocks of a checked size) and aligns each item with the stretch of words around its seeds.
Local alignment bears replaced, dropped and inserted words, so edited and paraphrased copies are found.

A pair of text and item is reported if its alignment reaches ``SIMILARITY`` of the item's best score and
``LEAST_SCORE``, or the item's best score where the item is shorter than that, or ``LONG_SCORE`` outright.

No text or item is cut. Null texts and items, and those without words, match nothing. Rows with a repeated id
are judged one by one and may give equal rows. An empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wayfare.llm.words import mixed, owners, slices, texts_of, words_of

#: Alignment scores of an equal word, a different word and a skipped word.
EQUAL, DIFFERENT, SKIPPED = 2, -1, -1
SIMILARITY, LEAST_SCORE, LONG_SCORE = 0.35, 8, 40
#: Expected share of positions at which an n-gram is rare, and the longest n-gram tried for it.
RARE, MAX_N = 1e-8, 8
#: Bytes of item text broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡•·"

SCHEMA = "doc_id long, item_id long, score int, similarity double, first_word int"


def clean_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes, offsets and dictionary of the stripped lower-case words."""
    words = words_of(texts)
    clean = pc.utf8_lower(pc.utf8_trim(words.dictionary, PUNCTUATION)).dictionary_encode()
    codes = clean.indices.to_numpy().astype(np.int64)[words.codes] if len(words.codes) else words.codes
    empty = pc.equal(clean.dictionary, "").to_numpy(zero_copy_only=False)
    real = ~empty[codes] if len(codes) else np.zeros(0, bool)
    kept = np.concatenate(([0], np.cumsum(real)))
    return codes[real], kept[words.offsets], clean.dictionary


@dataclass
class Items:
    """Benchmark items as word numbers; ``words`` is sorted."""

    ids: np.ndarray
    words: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        codes, offsets, dictionary = clean_words(pa.array(texts, pa.string()))
        return cls(np.array(ids, dtype=np.int64), dictionary, codes, offsets)

    def lookup(self, dictionary: pa.Array) -> np.ndarray:
        """The number of each word, -1 for words no item has."""
        return pc.fill_null(pc.index_in(dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n-gram at each position."""
    key = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j].astype(np.uint64) + np.uint64(1))
    return key


@dataclass
class Seeds:
    """For each length, sorted n-gram keys with the item and the place in it."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: Items, share: np.ndarray, rare: float = RARE, max_n: int = MAX_N) -> Seeds:
        """``share``: how much of the corpus each word is."""
        log, limit = np.log(np.maximum(share, 1e-12)), np.log(rare)
        found: dict[int, list[tuple[int, int, int]]] = {}
        keys = {n: _keys(items.codes, n) for n in range(1, max_n + 1)}
        for item in range(len(items.ids)):
            a, b = items.offsets[item], items.offsets[item + 1]
            before = -1
            for at in range(a, b):
                total, n = 0.0, 0
                while at + n < b and n < max_n and (total > limit or n < 2):
                    total += log[items.codes[at + n]]
                    n += 1
                if n and (total <= limit or n == max_n or at == a or before < 0):
                    found.setdefault(n, []).append((int(keys[n][at]), item, at - a))
                    before = at
        out = {}
        for n, rows in found.items():
            key = np.array([k for k, _, _ in rows], dtype=np.uint64)
            item, place = np.array([r[1:] for r in rows], dtype=np.int64).T
            order = np.argsort(key, kind="stable")
            out[n] = (key[order], item[order], place[order])
        return cls(out)

    def hits(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shift): the item's first word would be at position ``shift`` of all codes."""
        owner, known = owners(offsets), np.concatenate(([0], np.cumsum(codes >= 0)))
        parts = []
        for n, (key, item, place) in self.by_length.items():
            if len(codes) < n:
                continue
            at = np.flatnonzero((known[n:] - known[:-n] == n) & (owner[: len(codes) - n + 1] == owner[n - 1 :]))
            mine = _keys_at(codes, at, n)
            low, high = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            size = high - low
            to = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            pos = np.repeat(at, size)
            parts.append((owner[pos], item[to], pos - place[to]))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _keys_at(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    key = np.full(len(at), n, dtype=np.uint64)
    for j in range(n):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[at + j].astype(np.uint64) + np.uint64(1))
    return key


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of ``a`` with that of ``b``, and the column of b where it ends.

    Rows are padded with -1 in ``a`` and -2 in ``b``, which equal nothing.
    """
    rows, width = b.shape
    drop = np.arange(width, dtype=np.int32) * -SKIPPED
    last = np.zeros((rows, width + 1), dtype=np.int32)
    best, where = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64)
    for i in range(a.shape[1]):
        step = np.where(a[:, i : i + 1] == b, EQUAL, DIFFERENT).astype(np.int32)
        now = np.maximum(np.maximum(last[:, :-1] + step, last[:, 1:] + SKIPPED), 0)
        now = np.maximum.accumulate(now + drop, axis=1) - drop  # a run of skipped words of b
        peak = now.argmax(axis=1)
        top = now[np.arange(rows), peak]
        better = top > best
        best[better], where[better] = top[better], peak[better]
        last[:, 1:] = now
    return best, where


def align(items: Items, codes: np.ndarray, offsets: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], batch: int = 256):
    """(text, item, score, position) of the best alignment of each text and item with a seed in common."""
    text, item, shift = hits
    if not len(text):
        return (np.zeros(0, np.int64),) * 4
    size = np.diff(items.offsets)
    pad = np.maximum(8, size // 2)
    order = np.lexsort((shift, item, text))
    text, item, shift = text[order], item[order], shift[order]
    pair = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
    # Seeds of a pair on nearby diagonals share a window: diagonals are cut at multiples of the pad from the pair's first.
    first = shift[np.maximum.accumulate(np.where(pair, np.arange(len(pair)), 0))]
    cell = (shift - first) // pad[item]
    head = pair | np.concatenate(([True], cell[1:] != cell[:-1]))
    text, item, shift = text[head], item[head], shift[head]
    begin = np.maximum(shift - pad[item], offsets[text])
    end = np.minimum(shift + size[item] + 2 * pad[item], offsets[text + 1])
    score, where = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    by_size = np.argsort(size[item], kind="stable")
    for at in range(0, len(by_size), batch):
        some = by_size[at : at + batch]
        wide, long = int((end - begin)[some].max()), int(size[item[some]].max())
        column = np.arange(wide)
        inside = column < (end - begin)[some, None]
        b = np.where(inside, codes[np.minimum(begin[some, None] + column, len(codes) - 1)], -2)
        b = np.where(b < 0, -2, b)
        row = np.arange(long)
        a = np.where(row < size[item[some], None], items.codes[np.minimum(items.offsets[item[some], None] + row, len(items.codes) - 1)], -1)
        score[some], where[some] = smith_waterman(a, b)
    order = np.lexsort((begin, -score, item, text))
    text, item, score, where = text[order], item[order], score[order], (begin + where)[order]
    best = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
    return text[best], item[best], score[best], where[best]


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(items.words), np.int64), 0
        for batch in slices(batches):
            codes, _, dictionary = clean_words(texts_of(batch))
            numbers = items.lookup(dictionary)
            each = np.bincount(codes, minlength=len(dictionary))
            np.add.at(total, numbers[numbers >= 0], each[numbers >= 0])
            seen += len(codes)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], seen))], names=["word", "n"])

    return run


def _aligned(batch: pa.RecordBatch, items: Items, seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score, first word) of the pairs of a batch's texts and items that reach the bounds."""
    codes, offsets, dictionary = clean_words(texts_of(batch))
    numbers = items.lookup(dictionary)[codes] if len(codes) else codes
    text, item, score, where = align(items, numbers, offsets, seeds.hits(numbers, offsets))
    best = EQUAL * np.diff(items.offsets)[item]
    need = np.maximum(SIMILARITY * best, np.minimum(best, LEAST_SCORE))
    good = np.flatnonzero((score >= need) | (score >= LONG_SCORE))
    text, item, score, where = text[good], item[good], score[good], where[good]
    return text, item, score, where - offsets[text]


def _search(items: Items, seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = EQUAL * np.diff(items.offsets)
        for batch in slices(batches):
            text, item, score, first = _aligned(batch, items, seeds)
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()).take(pa.array(text)), pa.array(items.ids[item]), pa.array(score.astype(np.int32)), pa.array(score / best[item]), pa.array(first.astype(np.int32))],
                    names=["doc_id", "item_id", "score", "similarity", "first_word"],
                )

    return run


def _clean(items: Items, seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[_aligned(batch, items, seeds)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[Items, Seeds]]:
    """The benchmark in blocks of a checked size, each with its seeds under the corpus's word counts."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items.of([r.item_id for r in rows], [r.text for r in rows])
        if not len(items.codes):
            continue
        counts = {r.word: r.n for r in docs.select("text").mapInArrow(_count(items), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        share = np.array([counts.get(w, 0) for w in range(len(items.words))]) / max(1, counts.get(-1, 0))
        yield items, Seeds.of(items, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, similarity, first_word) of each pair of text and benchmark item that aligns.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). No shuffle but that of word counts of the items'
    vocabulary. The size of the benchmark is checked first: up to ``block_bytes`` it is broadcast at once, beyond
    that in as many blocks as keep to the bound, each in a pass of its own. ``first_word`` is where the best
    alignment ends, counted in words of the text.
    """
    texts, out = docs.select("doc_id", "text"), None
    for items, seeds in _blocks(docs, benchmark, block_bytes):
        found = texts.mapInArrow(_search(items, seeds), SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that align with a benchmark item; every row is judged by its own text.

    Rows are judged where they are read and nothing but word counts is shuffled; blocks of a large benchmark follow one another in one pass.
    """
    left = docs
    for items, seeds in _blocks(docs, benchmark, block_bytes):
        left = left.mapInArrow(_clean(items, seeds), docs.schema)
    return left
