"""Language-model scoring with a causal self-attention network over subword ids.

Texts become words (A-Z lower-cased), words become subwords of a public vocabulary. A one-layer causal
self-attention network, trained here in numpy, reads windows of subwords and predicts the class of the next
one; what a subword or a whole word is of its class comes from counts over all training texts. Windows overlap:
each is ``WINDOW`` long, begins ``STRIDE`` after the last, and scores the positions that no window before it has
scored, so every token is scored once, and all but a text's first have at least ``WINDOW - STRIDE`` of context.

    p(word) = known * p(class of its first subword | a word begins) * count(word) / count(words of that class)
              + (1 - known) * p(class of its first subword | a word begins) * p(subword | class)
                            * product over its other subwords of p(class) * p(subword | class) * p(a word begins next)

``known`` is one less the Good-Turing share of unseen words. Each of the two sums to one over words, and a text
ends with an end token, so scores are log10 probabilities of texts.

Counts cover all training texts: each chunk of texts counts its distinct words, the counts are summed by word and
joined back to the chunks, by a 64-bit hash of the word. The network learns from all training texts too: their tokens
are cut into windows that meet but do not overlap. Classes come from the neighbours of subwords in all of these, summed
on the executors; weights begin with some windows of a few chunks, on the driver; then in ``TURNS`` turns the executors
train over all windows, each text's in one of the turns, and the driver gets the mean of their weights. Sums are of whole
numbers, so they do not depend on the order in which tasks end.

Null and empty texts have the end token alone. Rows with a null id are training texts (they leave no
remainder); rows with equal ids are scored one by one. Without training texts every count is zero and the
network is not trained; the scores are then those of its even output. A word whose class has no training word has
its spelling alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wayfare.llm.words import Words, hashes_of, mixed, owners, segment_sums, slices, texts_of, words_of
from wayfare.plans.shared import scratch_path

WINDOW, STRIDE = 32, 24
WIDTH, INNER = 16, 32
#: Classes of subwords that begin a word (the end token's is the last of them) and of those that go on in one.
STARTS, INSIDES = 36, 28
CLASSES = STARTS + INSIDES
#: Common subwords that others are told apart by.
MARKS = 128
#: Windows that each chunk offers for the first weights.
FIRST_WINDOWS = 1024
CHUNK_BYTES = 8 << 20
#: Bits of a chunk's number within its task.
CHUNK_BITS = 12
#: Words of chunks that one task sums up, about.
SUM_WORDS = 1 << 20
#: First weights: chunks they are fitted on, epochs and rate. Then turns that share all windows, their rate and batch.
FIRST_CHUNKS, EPOCHS, RATE = 16, 5, 0.02
TURNS, TURN_RATE, TURN_BATCH = 2, 0.004, 128
#: Chunks that one task learns from, about: what it gives is as large for one chunk as for many.
TASK_CHUNKS = 16
#: Subwords whose weights are one row in the sums of a turn, and parts of a weight's unit in whole numbers.
ROWS, UNIT = 512, 1 << 20
#: Added to each subword's count within its class.
SMOOTH = 0.05

CHUNK_SCHEMA = """chunk long, ids binary, null_id binary, held_out binary, offsets binary, codes binary, piece_ends binary, pieces binary,
hashes binary, counts binary, n_words long, piece_ids array<int>, piece_counts array<long>, first_counts array<long>, n_train long, sample binary"""
COUNTS_SCHEMA = "chunk long, at binary, c binary, n long, v long, once long"
#: The columns that a chunk's texts are built from.
CHUNK_TEXTS = ["held_out", "offsets", "codes", "piece_ends", "pieces"]


@dataclass
class Vocabulary:
    """Subwords of single words; two more ids stand for the beginning and the end of a text."""

    model_file: str

    def __post_init__(self) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=self.model_file)
        self.size = self.model.get_piece_size() + 2
        self.begin, self.end = self.size - 2, self.size - 1
        self.starts = np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(self.size - 2)] + [True, True])

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(words, num_threads=1) if words else []
        ends = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)), out=ends[1:])
        return ends, np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=ends[-1])


def windows_of(offsets: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(text, first input) of each window, for texts of ``diff(offsets)`` inputs each (at least one)."""
    size = np.diff(offsets)
    n = np.where(size <= WINDOW, 1, 1 + -(-(size - WINDOW) // stride))
    text = np.repeat(np.arange(len(size)), n)
    return text, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride


# --- network -------------------------------------------------------------------------------------------


def _wider(x: np.ndarray) -> np.ndarray:
    """With a last column of zeros."""
    out = np.zeros((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    return out


def _times(rows: np.ndarray, by: np.ndarray, block: int = 64) -> np.ndarray:
    """``rows @ by`` of many short rows, in blocks so small that the library multiplies them where they lie."""
    by = np.ascontiguousarray(by)
    return (rows.reshape(-1, block, rows.shape[1]) @ by).reshape(len(rows), -1) if not len(rows) % block else rows @ by


def _crossed(a: np.ndarray, b: np.ndarray, block: int = 64) -> np.ndarray:
    """``a.T @ b`` of many short rows, in such blocks."""
    if len(a) % block:
        return a.T @ b
    return (a.reshape(-1, block, a.shape[1]).transpose(0, 2, 1) @ b.reshape(-1, block, b.shape[1])).sum(axis=0)


def _turned(x: np.ndarray) -> np.ndarray:
    """The matrices of ``x`` with rows and columns changed."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


class Attention:
    """Embeddings, one causal attention head, a feed-forward step, and a softmax over classes."""

    def __init__(self, vocabulary: int, classes: np.ndarray, seed: int = 5):
        r, f = np.random.default_rng(seed), np.float32
        n = CLASSES
        self.classes = classes.astype(np.int64)
        scale = 1 / np.sqrt(WIDTH)
        self.p = {
            "class_in": r.normal(0, 0.3, (n, WIDTH)).astype(f),
            "token_in": np.zeros((vocabulary, WIDTH), f),
            "place": r.normal(0, 0.1, (WINDOW, WIDTH)).astype(f),
            "qkv": r.normal(0, scale, (WIDTH, 3 * WIDTH)).astype(f),
            "up": r.normal(0, scale, (WIDTH, INNER)).astype(f),
            "up_b": np.zeros(INNER, f),
            "down": r.normal(0, 0.1, (INNER, WIDTH)).astype(f),
            "out": np.zeros((WIDTH, n), f),
            "out_b": np.zeros(n, f),
        }
        self.mask = np.tril(np.ones((WINDOW, WINDOW), f))
        self.scales = np.repeat(np.array([1, scale, 1], f), WIDTH)
        self.by_class = np.argsort(self.classes, kind="stable")
        self.ranks = np.argsort(self.by_class, kind="stable").astype(np.uint16 if vocabulary <= 1 << 16 else np.int64)
        self.sums = np.stack((np.ones(n, f), (np.arange(n) < STARTS).astype(f)), axis=1)

    def embedded(self, some=slice(None)) -> np.ndarray:
        """Vectors of subwords. A vector has a last 1, for the biases, so that no step has to add it to all positions."""
        out = np.ones((len(self.classes[some]), WIDTH + 1), np.float32)
        np.add(np.take(self.p["class_in"], self.classes[some], axis=0), self.p["token_in"][some], out=out[:, :WIDTH])
        return out

    def forward(self, x: np.ndarray, skip: int = 0):
        """``skip``: the first positions of a window that others attend to, but of which no output is wanted."""
        p, n = self.p, len(x)
        x = x + _wider(p["place"])
        flat = x.reshape(-1, WIDTH + 1)
        # The keys' weights bear the attention's scale; a last 1 in each value sums the shares.
        mix = np.zeros((WIDTH + 1, 3 * WIDTH + 1), np.float32)
        np.multiply(p["qkv"], self.scales, out=mix[:WIDTH, : 3 * WIDTH])
        mix[WIDTH, 3 * WIDTH] = 1
        qkv = _times(flat, mix).reshape(n, WINDOW, 3 * WIDTH + 1)
        q, k, v = qkv[:, skip:, :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        e, mean = self.attended(q, k, v, self.mask[skip:])
        if not 1e-30 < mean[..., WIDTH].min(initial=1) <= mean[..., WIDTH].max(initial=1) < 1e30:
            e, mean = self.attended(q, k, v, self.mask[skip:], 40)
        share = 1 / mean[..., WIDTH:]
        mean *= share
        # The vector's last 1 and the mean's make a 2.
        h = (x[:, skip:] + mean).reshape(-1, WIDTH + 1)
        inner = _times(h, np.vstack((p["up"], p["up_b"] / 2)))
        np.maximum(inner, np.zeros_like(inner), out=inner)  # an array, which is taken faster than a single 0
        top = _times(inner, _wider(p["down"]))
        top += h
        return top, (flat, mix, q, k, v, e, share, mean, h, inner)

    def attended(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Powers of e of the attention's logits, which are clipped to ``most``, and the sums of the values by them."""
        e = q @ _turned(k)
        if most < np.inf:
            np.clip(e, -most, most, out=e)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(e, out=e)
            e *= mask
            return e, e @ v

    def class_scores(self, ids: np.ndarray, target: np.ndarray, table: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the probability of each target's class and of a word's beginning; (windows, WINDOW - skip)."""
        target = target[:, skip:]
        top, _ = self.forward(np.take(table, ids, axis=0), skip)
        logits = _times(top, np.vstack((self.p["out"], self.p["out_b"] / 2)))
        goal = np.arange(0, logits.size, CLASSES) + self.classes[target.reshape(-1)]
        with np.errstate(over="ignore"):
            at, both = np.take(logits, goal), np.exp(logits, out=logits) @ self.sums
        if not 0 < both.min(initial=1) <= both.max(initial=1) < np.inf:
            logits = np.clip(_times(top, np.vstack((self.p["out"], self.p["out_b"] / 2))), -40, 40)
            at, both = np.take(logits, goal), np.exp(logits) @ self.sums
        both = np.log(both)
        return (at - both[:, 0]).reshape(target.shape), (both[:, 1] - both[:, 0]).reshape(target.shape)

    def gradients(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, wants_loss: bool = True) -> tuple[dict[str, np.ndarray], float]:
        """Gradients and the loss, if it is wanted; that of ``token_in`` has the rows of the subwords in ``used`` alone."""
        p, grad, n = self.p, {}, len(ids)
        # The runs of equal subwords, in the order of classes.
        ranks = self.ranks[ids.reshape(-1)]
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        first = np.concatenate(([True], ranks[1:] != ranks[:-1]))
        run = np.flatnonzero(first)
        self.used = self.by_class[ranks[run]]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(first) - 1
        x = np.take(self.embedded(self.used), place, axis=0).reshape(n, WINDOW, WIDTH + 1)
        top, (flat, mix, q, k, v, e, total, mean, h, inner) = self.forward(x)
        out = np.vstack((p["out"], p["out_b"] / 2))
        with np.errstate(over="ignore"):
            share = _times(top, out)
            whole = np.exp(share, out=share) @ self.sums[:, :1]
        if not 1e-30 < whole.min() <= whole.max() < 1e30:
            share = np.exp(np.clip(_times(top, out), -40, 40))
            whole = share @ self.sums[:, :1]
        part = (weight / weight.sum()).reshape(-1)
        goal = np.arange(0, share.size, CLASSES) + self.classes[target.reshape(-1)]
        loss = -float((np.log(np.take(share, goal) / whole[:, 0] + 1e-9) * part).sum()) if wants_loss else np.nan
        share *= part[:, None] / whole
        share.reshape(-1)[goal] -= part
        both = _crossed(top, share)
        grad["out"], grad["out_b"] = both[:WIDTH], both[WIDTH] / 2
        dh = _times(share, _wider(p["out"].T))
        dinner = _times(dh, _wider(p["down"]).T)
        dinner *= inner > 0
        both = _crossed(h, dinner)
        grad["down"], grad["up"], grad["up_b"] = _crossed(inner, dh)[:, :WIDTH], both[:WIDTH], both[WIDTH] / 2
        dh += _times(dinner, _wider(p["up"].T))
        # Of a position's mean; the last column takes the shares' own mean off, as the values' last is 1.
        dmean = dh.reshape(mean.shape) * total
        dmean[..., WIDTH] = (dmean * mean) @ np.full(WIDTH + 1, -1, np.float32)
        de = dmean @ _turned(v)
        de *= e
        dmix = np.empty((n, WINDOW, 3 * WIDTH), np.float32)
        np.matmul(de, k, out=dmix[..., :WIDTH])
        np.matmul(de.transpose(0, 2, 1), q, out=dmix[..., WIDTH : 2 * WIDTH])
        np.matmul(e.transpose(0, 2, 1), dmean[..., :WIDTH], out=dmix[..., 2 * WIDTH :])
        dmix = dmix.reshape(-1, 3 * WIDTH)
        grad["qkv"] = _crossed(flat, dmix)[:WIDTH] * self.scales
        dx = _times(dmix, mix[:WIDTH, : 3 * WIDTH].T)
        dx += dh[:, :WIDTH]
        grad["place"] = dx.reshape(n, WINDOW * WIDTH).sum(axis=0).reshape(WINDOW, WIDTH)
        # Sums of the runs: sums up to each row within blocks of rows, and sums of the blocks before.
        inside = self.mask @ np.take(dx, order, axis=0).reshape(n, WINDOW, WIDTH)
        before = np.zeros((n + 1, WIDTH))
        np.cumsum(inside[:, -1], axis=0, out=before[1:])
        until = np.append(run[1:], len(order)) - 1
        total = np.take(inside.reshape(-1, WIDTH), until, axis=0) + np.take(before, until // WINDOW, axis=0)
        grad["token_in"] = np.diff(total, axis=0, prepend=0).astype(np.float32)
        ends = np.searchsorted(self.classes[self.used], np.arange(CLASSES + 1))
        grad["class_in"] = np.diff(np.concatenate((before[:1], total))[ends], axis=0).astype(np.float32)
        return grad, loss

    def begin(self) -> None:
        """Forget the steps before."""
        self.first, self.second, self.steps = (), (), 0

    def step(self, windows: np.ndarray, real: np.ndarray, rate: float, wants_loss: bool = True) -> float:
        grad, loss = self.gradients(windows[:, :-1], windows[:, 1:], real.astype(np.float32), wants_loss)
        if not self.steps:
            rest = sum(v.size for k, v in self.p.items() if k != "token_in")
            self.first, self.second = ((np.zeros_like(self.p["token_in"]), np.zeros(rest, np.float32)) for _ in range(2))
        self.steps += 1
        # Other subwords' rows stay as they are. The other weights are one row of numbers.
        names = [k for k in self.p if k != "token_in"]
        moved = []
        for part, g in enumerate((grad["token_in"], np.concatenate([grad[k].reshape(-1) for k in names]))):
            at = slice(None) if part else self.used
            first, second = (x[part] if part else np.take(x[part], at, axis=0) for x in (self.first, self.second))
            first += np.float32(0.1) * (g - first)
            second += np.float32(0.02) * (g * g - second)
            self.first[part][at], self.second[part][at] = first, second
            below = np.sqrt(second * np.float32(1 / (1 - 0.98**self.steps)))
            below += np.float32(1e-8)
            moved.append(np.float32(rate / (1 - 0.9**self.steps)) * first / below)
        self.p["token_in"][self.used] -= moved[0]
        begin = 0
        for k in names:
            self.p[k] -= moved[1][begin : begin + self.p[k].size].reshape(self.p[k].shape)
            begin += self.p[k].size
        return loss

    def fit(self, sample: np.ndarray, real: np.ndarray, epochs: int = EPOCHS, batch: int = 64) -> list[float]:
        """``sample``: (windows, WINDOW + 1) ids; ``real``: which targets exist."""
        r, losses = np.random.default_rng(3), []
        steps = max(1, epochs * -(-len(sample) // batch))
        self.begin()
        for _ in range(epochs):
            order = r.permutation(len(sample))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                losses.append(self.step(sample[some], real[some], RATE * (1 - 0.9 * (self.steps + 1) / steps)))
        return losses


def sample_of(data: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a chunk's sample, (windows, WINDOW + 1), and which targets exist."""
    sample = np.frombuffer(data, "<u2").reshape(-1, WINDOW + 1).astype(np.int64)
    real = (sample != 0xFFFF)[:, 1:]
    return np.where(sample == 0xFFFF, end, sample), real


def neighbours(sample: np.ndarray, real: np.ndarray, marks: np.ndarray, out: np.ndarray, block: int = 8192) -> None:
    """Add to ``out`` (part, subword, mark) what stands near. ``marks``: for each subword its number among the common ones, or -1.

    Parts: the mark stands right before the subword, right after it, or anywhere in its window, which tells languages apart.
    """
    common = np.flatnonzero(marks >= 0)
    common = common[np.argsort(marks[common])]
    for at in range(0, len(sample), block):
        windows, there = sample[at : at + block], real[at : at + block]
        left, right = windows[:, :-1][there], windows[:, 1:][there]
        before, mark = marks[left], marks[right]
        for part, (a, b) in enumerate(((right, before), (left, mark))):
            good = b >= 0
            np.add.at(out[part].reshape(-1), a[good] * MARKS + b[good], out.dtype.type(1))
        # Each of a window's subwords meets each of its marks. Those that are marks themselves: a product of how often
        # each is in a window and which are; the counts are far below 2 ** 24.
        row = np.repeat(np.arange(len(windows)), np.count_nonzero(there, axis=1))
        often = np.bincount(row[good] * MARKS + mark[good], minlength=len(windows) * MARKS).reshape(-1, MARKS)
        has = often > 0
        out[2, common] += (often.astype(np.float32).T @ has.astype(np.float32)).astype(out.dtype)[: len(common)]
        # The others: sums over runs of equal subwords, eight counts of a byte to a number. Runs are cut at 255, and
        # differences of the running sums are right even where these wrap.
        row, right = row[~good], right[~good]
        order = np.argsort(right.astype(np.uint16 if len(marks) <= 1 << 16 else np.int64), kind="stable")
        owner, subword = row[order], right[order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), subword[1:] != subword[:-1])))
        run = np.flatnonzero((np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))) % 255 == 0)
        total = np.zeros((len(order) + 1, MARKS // 8), np.uint64)
        np.cumsum(np.take(has.view(np.uint64), owner, axis=0), axis=0, out=total[1:])
        counts = np.diff(total[np.append(run, len(order))], axis=0).view(np.uint8).reshape(-1, MARKS)
        # A subword's first run is its only one but for the commonest, and a sum of distinct rows is many times cheaper.
        subword = subword[run]
        first = np.concatenate((np.ones(min(1, len(run)), bool), subword[1:] != subword[:-1]))
        out[2][subword[first]] += counts[first]
        np.add.at(out[2], subword[~first], counts[~first])


def subword_classes(count: np.ndarray, near: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """A class for each subword: 0 to STARTS - 1 for those that begin a word, the last of these for the end token.

    ``count``: of each subword in the training texts; ``near``: the sums of :func:`neighbours`.
    """
    out = np.where(starts, _clusters(count, near, starts, end, STARTS - 1), STARTS + _clusters(count, near, ~starts, end, INSIDES))
    out[end] = STARTS - 1
    return out


def _clusters(count: np.ndarray, near: np.ndarray, mine: np.ndarray, end: int, n: int, rounds: int = 12) -> np.ndarray:
    """Clusters 0 to n - 1 of the subwords in ``mine``, by what stands near them (k-means).

    The commonest subwords have clusters of their own; those without neighbours share the last one.
    """
    vocabulary = len(mine)
    met = near.any(axis=(0, 2))
    out = np.full(vocabulary, n - 1, dtype=np.int64)
    ranked = [t for t in np.argsort(-count, kind="stable") if count[t] > 1 and t != end and mine[t] and met[t]]
    alone, others = ranked[: n // 4], np.array(ranked[n // 4 :], dtype=np.int64)
    out[alone] = np.arange(len(alone))
    free = n - 1 - len(alone)
    if len(others) <= free:
        out[others] = len(alone) + np.arange(len(others))
        return out
    feature = np.empty((len(others), 3, MARKS), np.float32)
    for part in range(3):
        feature[:, part] = near[part, others]
    feature /= np.maximum(feature.sum(axis=2, keepdims=True), 1)
    np.sqrt(feature, out=feature)
    feature[:, 2] *= 2
    feature = feature.reshape(len(others), -1)
    weight = np.sqrt(count[others]).astype(np.float32)
    center = feature[:free].copy()
    for _ in range(rounds):
        own = np.argmax(feature @ center.T * 2 - (center**2).sum(axis=1), axis=1)
        for c in range(free):
            close = own == c
            if close.any():
                center[c] = np.average(feature[close], axis=0, weights=weight[close])
    out[others] = len(alone) + own
    return out


# --- chunks --------------------------------------------------------------------------------------------


def _inputs(words: Words, piece_ends: np.ndarray, pieces: np.ndarray, vocabulary: Vocabulary | _Ends) -> tuple[np.ndarray, np.ndarray]:
    """Each text as begin, subwords, end; and the offsets of the texts."""
    kind = np.int32 if len(pieces) < 1 << 30 else np.int64
    sizes, begins, parts, step = np.diff(piece_ends).astype(kind), piece_ends[:-1].astype(kind), [pieces[:0]], 1 << 15
    for at in range(0, len(words.codes), step):  # in blocks that caches hold
        some = words.codes[at : at + step]
        size = np.take(sizes, some)
        ends = np.cumsum(size)
        place = np.repeat(np.take(begins, some) - (ends - size).astype(kind), size)
        place += np.arange(len(place), dtype=kind)
        parts.append(np.take(pieces, place))
    n = len(words.offsets) - 1
    offsets = np.append(0, np.cumsum(np.take(sizes, words.codes), dtype=np.int64))[words.offsets] + 2 * np.arange(n + 1)
    out = np.empty(offsets[-1], dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[offsets[:-1]] = False
    inside[offsets[1:] - 1] = False
    out[inside] = np.concatenate(parts)
    out[offsets[:-1]], out[offsets[1:] - 1] = vocabulary.begin, vocabulary.end
    return out, offsets


def _cut_windows(tokens: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW + 1) ids, and which of the last WINDOW are targets inside the text."""
    at = offsets[text] + start
    index = at[:, None] + np.arange(WINDOW + 1)
    stop = offsets[text + 1][:, None]
    return tokens[np.minimum(index, stop - 1)], index[:, 1:] < stop


def _planes(codes: np.ndarray) -> bytes:
    """Codes by byte: all low bytes, then the next, as many as the largest needs. High bytes are mostly 0 and compress well."""
    n = max(1, -(-int(codes.max(initial=0)).bit_length() // 8))
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i, plane in enumerate(np.frombuffer(data, np.uint8).reshape(-1, n)):
        out |= plane.astype(np.int64) << (8 * i)
    return out


@dataclass
class _Ends:
    begin: int
    end: int


def _chunk_words(row: dict) -> tuple[Words, np.ndarray, np.ndarray]:
    """A chunk's words, their dictionary empty, and the subwords of each distinct one."""
    piece_ends, pieces = np.frombuffer(row["piece_ends"], "<u4").astype(np.int64), np.frombuffer(row["pieces"], "<u2").astype(np.int64)
    offsets = np.frombuffer(row["offsets"], "<i8")
    return Words(_from_planes(row["codes"], int(offsets[-1])), offsets, pa.nulls(len(piece_ends) - 1)), piece_ends, pieces


def _make_chunks(model_file: str):
    tool: list[Vocabulary] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << CHUNK_BITS
        for batch in slices(batches, size=CHUNK_BYTES):
            tool or tool.append(Vocabulary(model_file))
            vocabulary = tool[0]
            words = words_of(texts_of(batch), lower=True)
            piece_ends, pieces = vocabulary.pieces(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            hashes = hashes_of(words.dictionary)
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            train = ~held_out
            counts = np.bincount(words.codes[np.repeat(train, words.counts)], minlength=len(words.dictionary))
            each = np.bincount(pieces, weights=np.repeat(counts, np.diff(piece_ends)), minlength=vocabulary.size).astype(np.int64)
            first = np.bincount(pieces[piece_ends[:-1]], weights=counts, minlength=vocabulary.size).astype(np.int64) if len(pieces) else np.zeros(vocabulary.size, np.int64)
            used = np.flatnonzero(each + first)
            sizes = words.per_text(np.diff(piece_ends)) + 1
            text, start = windows_of(np.append(0, np.cumsum(sizes)), WINDOW)
            own = np.flatnonzero(train[text])
            # By what the text is and where the window begins, not by where the text stands.
            name = mixed(words.per_text(hashes.view(np.int64)).view(np.uint64))
            chosen = np.argsort(mixed(name[text[own]] + start[own].astype(np.uint64)), kind="stable")
            own = own[chosen[:FIRST_WINDOWS]]
            some, place = np.unique(text[own], return_inverse=True)
            few = Words(words.codes[np.isin(owners(words.offsets), some)], np.append(0, np.cumsum(words.counts[some])), words.dictionary)
            ids, real = _cut_windows(*_inputs(few, piece_ends, pieces, vocabulary), place, start[own])
            sample = np.where(np.concatenate((np.ones((len(own), 1), bool), real), axis=1), ids, 0xFFFF).astype("<u2")
            keys = batch.column("doc_id").cast(pa.int64())
            cells = [
                number, keys.fill_null(0).to_numpy().astype("<i8").tobytes(), keys.is_null().to_numpy(zero_copy_only=False).tobytes(), held_out.tobytes(), words.offsets.astype("<i8").tobytes(),
                _planes(words.codes), piece_ends.astype("<u4").tobytes(), pieces.astype("<u2").tobytes(), hashes.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), len(hashes), used.astype(np.int32), each[used], first[used], int(train.sum()), sample.tobytes(),
            ]
            kinds = [pa.int64(), *[pa.binary()] * 9, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in CHUNK_SCHEMA.replace("\n", " ").split(",")]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)
            number += 1

    return run


@dataclass
class Scorer:
    """All that scoring needs beside the chunk and its words' counts; its size depends on the vocabulary alone."""

    network: Attention
    model_file: str
    log_in_class: np.ndarray
    log_class_words: np.ndarray
    n: int
    v: int
    n_end: int
    known: float

    def texts(self, words: Words, piece_ends: np.ndarray, pieces: np.ndarray, count: np.ndarray, begin: int, end: int, block: int = 128):
        """(n_tokens, n_known, base, score) of each text; ``count``: of each distinct word in training texts."""
        n_texts = len(words.offsets) - 1
        log = np.log10((count + 1) / (self.n + self.v + 1))
        base = words.per_text(log) + np.log10((self.n_end + 1) / (self.n + self.v + 1))
        known = words.per_text((count > 0).astype(np.int64)) + (self.n_end > 0)
        tokens, offsets = _inputs(words, piece_ends, pieces, _Ends(begin, end))
        text, start = windows_of(offsets - np.arange(n_texts + 1))
        table = self.network.embedded()
        place, begins = np.zeros(len(tokens), np.float32), np.zeros(len(tokens), np.float32)
        # What a window before has scored is context alone in the next one.
        for group, skip in ((np.flatnonzero(start == 0), 0), (np.flatnonzero(start), WINDOW - STRIDE)):
            for at in range(0, len(group), block):
                some = group[at : at + block]
                ids, real = _cut_windows(tokens, offsets, text[some], start[some])
                scores, opened = self.network.class_scores(ids[:, :-1], ids[:, 1:], table, skip)
                fresh = real[:, skip:]
                index = (offsets[text[some]] + start[some] + 1)[:, None] + np.arange(skip, WINDOW)
                place[index[fresh]], begins[index[fresh]] = scores[fresh], opened[fresh]
        # Back to words: a text's tokens are begin, the subwords of its words, end.
        size = np.diff(piece_ends)[words.codes]
        owner = np.repeat(np.arange(n_texts), words.counts)
        first = np.cumsum(size) - size + 2 * owner + 1
        stop = offsets[1:] - 1
        place[first] -= begins[first]  # given that a word, or the end, comes
        place[stop] -= begins[stop]
        piece = place + self.log_in_class[tokens]
        piece[offsets[:-1]] = 0
        total = np.concatenate(([0.0], np.cumsum(piece, dtype=np.float64)))
        spelled = total[first + size] - total[first] + begins[np.minimum(first + size, len(tokens) - 1)]
        seen = count[words.codes] > 0
        whole = np.full(len(first), -np.inf)
        whole[seen] = np.log(count[words.codes[seen]]) - self.log_class_words[self.network.classes[tokens[first[seen]]]] + place[first[seen]]
        both = np.logaddexp(np.log(self.known) + whole, np.log1p(-self.known) + spelled)
        score = (segment_sums(both, words.offsets) + piece[stop]) / np.log(10)
        return words.counts + 1, known, base, score


def samples_in(batch: pa.RecordBatch, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for data in batch.column("sample").to_pylist():
        yield sample_of(data, end)


def windows_in(batch: pa.RecordBatch, end: int, turn: int = 0, turns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All training windows of each chunk, in parts and in a mixed order: each target is in one. Each text is in one of ``turns``, and these are those of ``turn``."""
    for row in batch.select(CHUNK_TEXTS).to_pylist():
        words, piece_ends, pieces = _chunk_words(row)
        r = np.random.default_rng(len(words.codes))
        mine = np.flatnonzero(~np.frombuffer(row["held_out"], bool))
        mine = np.sort(r.permutation(mine)[(turn + r.integers(turns)) % turns :: turns])
        chosen = np.zeros(len(words.offsets) - 1, bool)
        chosen[mine] = True
        some = Words(words.codes[np.repeat(chosen, words.counts)], np.append(0, np.cumsum(words.counts[mine])), words.dictionary)
        tokens, offsets = _inputs(some, piece_ends, pieces, _Ends(end - 1, end))
        text, start = windows_of(offsets - np.arange(len(offsets)), WINDOW)
        order = r.permutation(len(text))
        for at in range(0, len(order), 8192):
            some = order[at : at + 8192]
            yield _cut_windows(tokens, offsets, text[some], start[some])


def _count_neighbours(marks: np.ndarray, end: int):
    """Arrow function over chunks: (block, near), a task's sums for each block of subwords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(marks), MARKS), np.uint32)
        for batch in batches:
            for sample, real in windows_in(batch, end):
                neighbours(sample, real, marks, total)
        for block, at in enumerate(range(0, len(marks), ROWS)):
            some = np.ascontiguousarray(total[:, at : at + ROWS])
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(some.astype("<u8"))], pa.binary())], names=["block", "near"])

    return run


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


def _sum_neighbours(size: int):
    """Arrow function: (block, near), the sums of whole blocks, held one array for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, near in zip(batch.column("block").to_pylist(), batch.column("near").to_pylist(), strict=True):
                values = _unpacked(near, 3 * min(ROWS, size - block * ROWS) * MARKS)
                total[block] = total[block] + values if block in total else values
        for block, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(values)], pa.binary())], names=["block", "near"])

    return run


def near_counts(chunks: DataFrame, marks: np.ndarray, end: int) -> np.ndarray:
    """The sums of :func:`neighbours` over all training windows; their size depends on the vocabulary alone."""
    summed = chunks.mapInArrow(_count_neighbours(marks, end), "block int, near binary").repartition("block").mapInArrow(_sum_neighbours(len(marks)), "block int, near binary")
    out = np.zeros((3, len(marks), MARKS), np.float32)
    for r in summed.collect():
        some = out[:, r.block * ROWS : (r.block + 1) * ROWS]
        some[:] = _unpacked(r.near, some.size).reshape(some.shape)
    return out


def _train_on(network: Attention, end: int, rate: float, read):
    """Arrow function: a task's training from ``network`` on the windows that ``read`` finds in its rows.

    Gives (block, weight, rows, change): the windows it saw, and how many ``1 / UNIT`` the weights of some subwords
    have changed; block -1 has all other weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {k: v.copy() for k, v in network.p.items()}
        network.begin()
        weight = 0
        for batch in batches:
            for sample, real in read(batch, end):
                for at in range(0, len(sample), TURN_BATCH):
                    network.step(sample[at : at + TURN_BATCH], real[at : at + TURN_BATCH], rate, wants_loss=False)
                weight += len(sample)
        if not weight:
            return
        change = {k: np.round((v.astype(np.float64) - before[k]) * UNIT).astype("<i4") for k, v in network.p.items()}
        network.p = before
        used = np.flatnonzero(change["token_in"].any(axis=1))
        rows = [(-1, b"", np.concatenate([change[k].reshape(-1) for k in sorted(change) if k != "token_in"]).tobytes())]
        rows += [(block, some.astype("<i4").tobytes(), change["token_in"][some].tobytes()) for block in np.unique(used // ROWS).tolist() for some in [used[used // ROWS == block]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([weight] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["block", "weight", "rows", "change"])

    return run


def _sum_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, weight, change): sums of whole blocks, held one array for each block."""
    total: dict[int, list] = {}
    for batch in batches:
        for block, weight, rows, change in zip(*(batch.column(c).to_pylist() for c in ("block", "weight", "rows", "change")), strict=True):
            values = np.frombuffer(change, "<i4").astype(np.int64) * weight
            held = total.setdefault(block, [0, np.zeros(len(values) if block < 0 else ROWS * WIDTH, np.int64)])
            held[0] += weight
            if block < 0:
                held[1] += values
            else:
                held[1].reshape(ROWS, WIDTH)[np.frombuffer(rows, "<i4") - block * ROWS] += values.reshape(-1, WIDTH)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["block", "weight", "change"])


def train_on_all(network: Attention, samples: DataFrame, end: int, rate: float, read=samples_in) -> None:
    """One turn: tasks train from ``network`` on their own windows, and it moves by the mean of their changes, weighted by windows."""
    changes = samples.mapInArrow(_train_on(network, end, rate, read), "block int, weight long, rows binary, change binary")
    summed = changes.repartition("block").mapInArrow(_sum_changes, "block int, weight long, change binary").collect()
    weight = max((r.weight for r in summed if r.block < 0), default=0)
    for r in summed:
        mean = np.frombuffer(r.change, "<i8") / (weight * UNIT)
        if r.block >= 0:
            at = slice(r.block * ROWS, (r.block + 1) * ROWS)
            network.p["token_in"][at] += mean.reshape(ROWS, WIDTH)[: len(network.p["token_in"][at])].astype(np.float32)
            continue
        begin = 0
        for k in sorted(network.p):
            if k != "token_in":
                part = network.p[k]
                part += mean[begin : begin + part.size].reshape(part.shape).astype(np.float32)
                begin += part.size


def build_scorer(chunks: DataFrame, stats: tuple[int, int, int], model_file: str) -> Scorer:
    """Gather the subword counts (one row for each subword) and the neighbours' (bounded by subwords and marks), and train."""
    vocabulary = Vocabulary(model_file)
    end = vocabulary.end
    n_words, n_distinct, n_once = stats
    n_train, n_chunks = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    zipped = chunks.select(F.explode(F.arrays_zip("piece_ids", "piece_counts", "first_counts")).alias("x")).select("x.*")
    sums = zipped.groupBy("piece_ids").agg(F.sum("piece_counts").alias("n"), F.sum("first_counts").alias("first")).toPandas()
    each, first = np.zeros(vocabulary.size), np.zeros(vocabulary.size)
    each[sums["piece_ids"]], first[sums["piece_ids"]] = sums["n"], sums["first"]
    each[end] = n_train
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    texts = chunks.where("n_train > 0").select(*CHUNK_TEXTS).coalesce(cores * -(-max(1, n_chunks) // (cores * TASK_CHUNKS)))
    marks, common = np.full(vocabulary.size, -1), each.copy()
    common[vocabulary.begin] = n_train
    marks[np.argsort(-common, kind="stable")[:MARKS]] = np.arange(min(MARKS, vocabulary.size))
    classes = subword_classes(each, near_counts(texts, marks, end), vocabulary.starts, end)
    network = Attention(vocabulary.size, classes)
    rows = chunks.where("n_train > 0").orderBy(F.xxhash64("sample"), "chunk").limit(FIRST_CHUNKS).select("sample").collect()
    if rows:
        some = [sample_of(r.sample, end) for r in rows]
        network.fit(np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some]))
        for turn in range(TURNS):
            network.begin()
            train_on_all(network, texts, end, TURN_RATE / (turn + 1), partial(windows_in, turn=turn, turns=TURNS))
    in_class = np.bincount(classes, weights=each + SMOOTH, minlength=CLASSES)
    log_in_class = np.log(each + SMOOTH) - np.log(in_class[classes])
    log_in_class[end] = 0.0
    with np.errstate(divide="ignore"):
        log_class_words = np.log(np.bincount(classes, weights=first, minlength=CLASSES))
    known = 1 - min(0.5, max(0.005, n_once / max(1, n_words)))
    network.begin()
    return Scorer(network, model_file, log_in_class, log_class_words, n_words + n_train, n_distinct + (n_train > 0), n_train, known)


def _rows_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: those from one end to the next."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _deal_words(parts: int):
    """Arrow function over chunks: (part, chunk, hashes, counts, at), a chunk's words of each range of hashes; ``at``: their numbers in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "counts")), strict=True):
                hashes, counts = np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<u4")
                part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
                at = np.argsort(part, kind="stable")
                size = np.bincount(part, minlength=1)
                some = np.flatnonzero(size)
                ends = np.concatenate(([0], np.cumsum(size[some])))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk, np.int64)), _rows_of(hashes[at], ends), _rows_of(counts[at], ends), _rows_of(at.astype("<u4"), ends)], names=["part", "chunk", "hashes", "counts", "at"])

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, at, c, n, v, once): counts of the chunks' words in all training texts; n, v and once, of the first row alone: all, distinct and single words."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    parts = {c: rows.column(c).to_pylist() for c in ("hashes", "counts")}
    hashes, counts = (np.frombuffer(b"".join(parts.pop(c)), kind) for c, kind in (("hashes", "<u8"), ("counts", "<u4")))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    total = np.add.reduceat(counts[order].astype(np.int64), begin)
    of_word = np.empty(len(order), np.int64)
    of_word[order] = np.repeat(total, np.diff(np.append(begin, len(order))))
    end, first = 0, (int(total.sum()), int(np.count_nonzero(total)), int(np.count_nonzero(total == 1)))
    for batch in batches:
        size = pc.binary_length(batch.column("at")).to_numpy() // 4
        ends = end + np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        stats = [pa.array([x] + [0] * (len(size) - 1), pa.int64()) for x in first]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("at"), _rows_of(of_word[end : ends[-1]].astype("<u8"), ends - end), *stats], names=["chunk", "at", "c", "n", "v", "once"])
        end, first = int(ends[-1]), (0, 0, 0)


def _score_chunk(scorer: Scorer):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            ids, held_out = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["held_out"], bool)
            words, piece_ends, pieces = _chunk_words(row)
            count = np.zeros(len(piece_ends) - 1, dtype=np.int64)
            for at, c in zip(right["at"].to_pylist(), right["c"].to_pylist(), strict=True):
                count[np.frombuffer(at, "<u4")] = np.frombuffer(c, "<u8")
            size = len(scorer.log_in_class)
            n_tokens, known, base, score = scorer.texts(words, piece_ends, pieces, count, size - 2, size - 1)
            parts.append(
                pa.table({
                    "doc_id": pa.array(ids, mask=np.frombuffer(row["null_id"], bool)), "held_out": pa.array(held_out), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(ids), scorer.n, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
                })
            )
        return pa.concat_tables(parts) if parts else _EMPTY

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


def learn(docs: DataFrame, model_file: str, held_out) -> tuple[str, DataFrame, Scorer]:
    """Write the chunks and the word totals, and train: the chunks' path, the totals of their words and the scorer."""
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    path = scratch_path(spark, "lm-chunks")
    marked.mapInArrow(_make_chunks(model_file), CHUNK_SCHEMA).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    # Each task sums the words of one range of hashes. A word is there once for each chunk at most, so ranges have much the same size.
    parts = max(1, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // SUM_WORDS))
    dealt = chunks.select("chunk", "hashes", "counts").mapInArrow(_deal_words(parts), "part int, chunk long, hashes binary, counts binary, at binary").repartitionById(parts, F.col("part"))
    counts_path = scratch_path(spark, "lm-counts")
    dealt.mapInArrow(_sum_words, COUNTS_SCHEMA).write.option("compression", "zstd").parquet(counts_path)
    counted = spark.read.schema(COUNTS_SCHEMA).parquet(counts_path)
    stats = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once"))).first()
    return path, counted, build_scorer(chunks, tuple(stats), model_file)


def score_texts(docs: DataFrame, model_file: str, held_out) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text); ``held_out`` is the condition of texts not learned from.

    Texts are read once; what is shuffled is a chunk's distinct words' hashes and counts, and the chunks' word
    codes. The chunks are written to the shared folder first.
    """
    path, counted, scorer = learn(docs, model_file, held_out)
    bodies = docs.sparkSession.read.schema(CHUNK_SCHEMA).parquet(path).select("chunk", "ids", "null_id", "held_out", "offsets", "codes", "piece_ends", "pieces")
    return bodies.groupBy("chunk").cogroup(counted.select("chunk", "at", "c").groupBy("chunk")).applyInArrow(_score_chunk(scorer), RESULT)
