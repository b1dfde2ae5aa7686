"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. The merges of a rank file define one token sequence for each byte string, and a sequence is that
one exactly when each neighbouring pair is stable: merging the pair's joined bytes gives the pair back. So
the last token of each prefix follows from the last tokens of shorter prefixes. The transducer reads a byte
at a time and gives the last token of the prefix that ends there; its state is what still matters: for each
position from which a token may still start, the bytes read since and the last token before it. The tokens
are those met on the way back from the end, each ending where the next one starts. In a long piece the ways
back from all open positions are compared now and then, and the tokens that they share are emitted. States
and transitions are made when first met and then only looked up.

Decoding feeds token bytes through a finite-state machine for UTF-8 that holds an incomplete character back
until its last byte comes.

Null texts count as empty; empty texts have no tokens and the digest of no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.words import slices, texts_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"
#: Bounds of a worker's tables; beyond them a table is begun anew, which changes speed alone.
MAX_STATES, MAX_MEMO = 200_000, 500_000
#: Longer pieces seldom come again and are not kept.
MEMO_CHARS = 16
#: Bytes of text whose ids are held at once.
SLICE_BYTES = 2 << 20
#: Bytes of a piece that are read before the tokens sure by then are emitted.
HELD_BYTES = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[int], int]:
    """Plain merging by lowest rank, leftmost first: the ids, and where the last merge joined its halves.

    This defines the encoding; the transducer calls it on single tokens only.
    """
    parts, seam = [piece[i : i + 1] for i in range(len(piece))], 0
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        seam = sum(map(len, parts[: best + 1]))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts], seam


class Transducer:
    """Bytes in, token ids out; :meth:`encode` for one piece, :meth:`feed`, :meth:`settle` and :meth:`finish` for a stream.

    One stream at a time: :meth:`feed` may begin the tables anew, after which older state numbers mean nothing.

    A state has one number, trie node << 24 | token + 1, for each position where a token may have begun: the node
    its bytes lead to in the trie of all tokens, and the token that ends before it, -1 at the start. The last
    number is the end of what was read, at the trie's root.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of, default=-1) + 1)]
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.grows: list[bool] = [False]
        self.depth: list[int] = [0]
        for data, token in ranks.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.grows[node] = True
                node = after
            self.token_at[node] = token
        self.pairs: dict[int, bool] = {}
        self.seams: dict[int, int] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.last: list[int] = []  # the token at the end of what was read
        self.moves: dict[int, int] = {}  # state << 8 | byte: the next state
        self.start = self._intern((0,))

    def _intern(self, config: tuple) -> int:
        at = self.index.get(config)
        if at is None:
            at = self.index[config] = len(self.configs)
            self.configs.append(config)
            self.last.append(config[-1] - 1)
        return at

    def _seam(self, token: int) -> int:
        """Where a token's last merge joined its halves; -1 if merging its bytes does not give it."""
        at = self.seams.get(token)
        if at is None:
            data = self.bytes_of[token]
            ids, at = merge(data, self.ranks)
            at = self.seams[token] = at if ids == [token] else -1
        return at

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The pieces at one end of a token as its merges form them, from the single byte to the whole."""
        known = self.edges.get((token, right))
        if known is None:
            known, data = [], self.bytes_of[token]
            while True:
                rank = self.ranks[data]
                known.append((data, rank))
                if len(data) == 1:
                    break
                seam = self._seam(rank)
                data = data[seam:] if right else data[:seam]
            known.reverse()
            self.edges[token, right] = known
        return known

    def _stable(self, a: int, b: int) -> bool:
        """Whether b can follow a; a is -1 at the start, where b must be reachable by merges.

        Both tokens' merges are replayed by rank. The pair is unstable if the pieces that meet between them
        could merge before either goes on; of equal ranks the left one is first.
        """
        pair = (a + 1) << 24 | b
        known = self.pairs.get(pair)
        if known is None:
            known = self._seam(b) >= 0
            if known and a >= 0:
                left, right = self._edge(a, True), self._edge(b, False)
                i = j = 0
                while True:
                    next_left = left[i + 1][1] if i + 1 < len(left) else 1 << 60
                    next_right = right[j + 1][1] if j + 1 < len(right) else 1 << 60
                    across = self.ranks.get(left[i][0] + right[j][0], 1 << 60)
                    if across < next_left and across <= next_right and across < 1 << 60:
                        known = False
                        break
                    if next_left == next_right == 1 << 60:
                        break
                    if next_left <= next_right:
                        i += 1
                    else:
                        j += 1
            self.pairs[pair] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        child, stable, end, ahead = self.child.get, self.pairs.get, -1, []
        for entry in self.configs[state]:
            after = child(entry >> 24 << 8 | byte)
            if after is None:
                continue
            token = self.token_at[after]
            if token >= 0:
                known = stable((entry & 0xFFFFFF) << 24 | token)
                if self._stable((entry & 0xFFFFFF) - 1, token) if known is None else known:
                    if end >= 0:
                        raise ValueError("the ranks are not those of a byte-pair merge list")
                    end = token
            if self.grows[after]:
                ahead.append(after << 24 | entry & 0xFFFFFF)
        if end < 0:
            raise ValueError("the ranks are not those of a byte-pair merge list")
        ahead.append(end + 1)
        after = self.moves[state << 8 | byte] = self._intern(tuple(ahead))
        return after

    def feed(self, state: int, data: bytes, held: list[int]) -> int:
        """Read ``data``; ``held`` gets, for each byte, the last token of what ends there."""
        get, last, hold = self.moves.get, self.last, held.append
        for byte in data:
            after = get(state << 8 | byte)
            if after is None:
                if len(self.configs) > MAX_STATES:  # within a piece too, so that its length does not count
                    config = self.configs[state]
                    self.clear()
                    get, last, state = self.moves.get, self.last, self._intern(config)
                after = self._move(state, byte)
            state = after
            hold(last[state])
        return state

    def settle(self, state: int, held: list[int], out: list[int]) -> None:
        """Emit the tokens that do not depend on what comes, and take their bytes from ``held``."""
        shared: set[int] | None = None
        for entry in self.configs[state]:
            at, ends = len(held) - self.depth[entry >> 24], set()
            while at:
                ends.add(at)
                at -= self.size[held[at - 1]]
            shared = ends if shared is None else shared & ends
        if shared:
            sure = max(shared)
            self.finish(held[:sure], out)
            del held[:sure]

    def finish(self, held: list[int], out: list[int]) -> None:
        at, size, first = len(held), self.size, len(out)
        while at:
            token = held[at - 1]
            out.append(token)
            at -= size[token]
        out[first:] = out[: first - 1 if first else None : -1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token, as in the public library
            return [whole]
        out: list[int] = []
        held: list[int] = []
        state = self.feed(self.start, piece[:HELD_BYTES], held)
        if len(piece) > HELD_BYTES:
            for at in range(HELD_BYTES, len(piece), HELD_BYTES):
                self.settle(state, held, out)
                state = self.feed(state, piece[at : at + HELD_BYTES], held)
        self.finish(held, out)
        return out


#: First byte: (bytes that follow, least and most of the first of them), by the UTF-8 standard.
_FOLLOW = {
    **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)},
    0xE0: (2, 0xA0, 0xBF),
    **{b: (2, 0x80, 0xBF) for b in (*range(0xE1, 0xED), 0xEE, 0xEF)},
    0xED: (2, 0x80, 0x9F),
    0xF0: (3, 0x90, 0xBF),
    **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)},
    0xF4: (3, 0x80, 0x8F),
}


class Utf8Stream:
    """Decodes token by token: gives whole characters at once, holds an unfinished one back.

    A byte that cannot go on closes what was held as U+FFFD, as Python's incremental decoder with
    ``errors="replace"`` does; ``valid`` tells whether that ever happened.
    """

    def __init__(self) -> None:
        self.held = b""
        self.need, self.low, self.high = 0, 0x80, 0xBF
        self.valid = True

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                out.append(self._broken())
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in _FOLLOW:
                self.need, self.low, self.high = _FOLLOW[byte]
                self.held = bytes((byte,))
            else:
                out.append(self._broken())
        return "".join(out)

    def _broken(self) -> str:
        self.held, self.need, self.low, self.high, self.valid = b"", 0, 0x80, 0xBF, False
        return "�"

    def finish(self) -> str:
        return self._broken() if self.need else ""


class Codec:
    """Encoder and decoder of whole texts under a rank file and a splitting pattern."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex

        self.ranks = read_ranks(ranks_file)
        self.machine = Transducer(self.ranks)
        # Python's \s also takes the separators \x1c-\x1f; the public library's does not.
        space = r"\t-\r \x85\xa0  -     　"
        own = pattern.replace(r"[^\s", f"[^{space}").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
        self.split = regex.compile(own).findall
        self.token_bytes = [self.machine.bytes_of.get(i, b"") for i in range(max(self.machine.bytes_of, default=-1) + 1)]
        self.clean = np.fromiter((self._whole(b) for b in self.token_bytes), dtype=bool, count=len(self.token_bytes))
        self.memo = _Memo(self)

    @staticmethod
    def _whole(data: bytes) -> bool:
        try:
            return bool(data.decode() or True)
        except UnicodeDecodeError:
            return False

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = b"".join(map(self.memo.__getitem__, self.split(text)))
        if len(self.memo) > MAX_MEMO:
            self.memo.clear()
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes of ids, and whether they are well-formed UTF-8 by the streaming machine.

        Tokens of whole characters leave the machine where it was, so it steps over the runs of others only.
        """
        pieces = list(map(self.token_bytes.__getitem__, ids.tolist()))
        odd = np.flatnonzero(~self.clean[ids]) if len(ids) else ids
        valid, at = True, 0
        while valid and at < len(odd):
            machine, token = Utf8Stream(), int(odd[at])
            while token < len(pieces):
                machine.feed(pieces[token])
                token += 1
                if not machine.need:
                    break
            machine.finish()
            valid = machine.valid
            at = int(np.searchsorted(odd, token))
        return b"".join(pieces), valid


class _Memo(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = struct.pack(f"<{len(found := self.codec.machine.encode(piece.encode()))}I", *found)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


def stream_decode(codec: Codec, ids: Iterable[int]) -> Iterator[str]:
    """Text of ids as it becomes certain, one string for each token that completes a character."""
    machine = Utf8Stream()
    for i in ids:
        if text := machine.feed(codec.token_bytes[i]):
            yield text
    if text := machine.finish():
        yield text


def _digest(ranks_file: str, pattern: str, with_ids: bool):
    tool: list[Codec] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            tool or tool.append(Codec(ranks_file, pattern))
            codec, rows = tool[0], ([], [], [], [], [])
            for text in texts_of(batch).to_pylist():
                coded = codec.encode(text)
                ids = np.frombuffer(coded, dtype="<u4")
                data, valid = codec.decode(ids)
                for column, x in zip(rows, (len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(data).hexdigest(), valid, ids.view("<i4") if with_ids else None), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64())} | {n: pa.array(x, t) for n, x, t in zip(("n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8", "ids"), rows, kinds, strict=True)}
            if not with_ids:
                del columns["ids"]
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _tokens(ranks_file: str, pattern: str):
    tool: list[Codec] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            tool or tool.append(Codec(ranks_file, pattern))
            ids = [np.frombuffer(tool[0].encode(x), dtype="<u4").astype(np.int32) for x in texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def bpe_encode(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs`` (doc_id, text). One pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_tokens(ranks_file, pattern), "doc_id long, ids array<int>")


def bpe_round_trip(docs: DataFrame, ranks_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, one row for each row of ``docs``, and the ids if asked. One pass, no shuffle."""
    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_digest(ranks_file, pattern, with_ids), schema)
