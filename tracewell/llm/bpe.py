"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into halves down to leaves of a few thousand code points. A leaf is split into pieces by the
tokenizer's pattern, each piece encoded by itself. Two neighbours are joined by re-encoding a window around the cut:
on the left from the last piece whose match cannot have seen the cut, on the right over a growing number of pieces,
until a piece of the window ends where a piece of the right neighbour begins. The pattern only looks forward, so all
pieces from there on, and hence their tokens, are those of the whole text.

A long piece is encoded in the same way over its bytes: halves, joined by re-merging a growing window of tokens. The
tokens outside are proven stable when the pairs at both of the window's edges are stable: a sequence of tokens is the
encoding of its bytes if and only if each pair of neighbours is the encoding of its own bytes.

Decoding concatenates the tokens' bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks

#: Code points of a text's leaf, bytes of a piece's leaf, tokens of a leaf when decoding.
TEXT_LEAF, PIECE_LEAF, TOKEN_LEAF = 8192, 64, 4096
#: No alternative of the pattern looks further than this beyond the end of its match, or needs more to match.
LOOK = 3
#: Pieces that a worker remembers (about 350 bytes each), and the longest of them.
CACHE, CACHE_BYTES = 120_000, 48

Node = tuple[list[str], list[tuple[tuple[int, ...], str]]]


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes = {v: k for k, v in ranks.items()}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.pair = lru_cache(1 << 16)(self._pair)

    # over the bytes of a piece

    def merge(self, b: bytes) -> list[int]:
        """Tokens of a few bytes: again and again the pair of least rank, leftmost first."""
        ranks, parts = self.ranks, [b[i : i + 1] for i in range(len(b))]
        near = [ranks.get(b[i : i + 2]) for i in range(len(b) - 1)]
        while True:
            least = at = None
            for i, r in enumerate(near):
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if at is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at < len(near):
                near[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                near[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def merge_many(self, b: bytes) -> list[int]:
        """As merge(), for many bytes: candidate pairs wait in a heap by rank and place."""
        ranks, n = self.ranks, len(b)
        parts: list[bytes | None] = [b[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            if (own := parts[i]) is None or (j := after[i]) >= n or len(own) + len(parts[j]) != size:
                continue  # one of the pair has been merged since
            parts[i], parts[j] = own + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := ranks.get(pair := parts[x] + parts[y])) is not None:
                    heappush(heap, (r, x, len(pair)))
        return [ranks[p] for p in parts if p is not None]

    def _pair(self, a: int, b: int) -> bool:
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = b"".join(self.bytes[t] for t in chain(left[i:], right[:j]))
            mid = self.merge(window) if len(window) <= PIECE_LEAF else self.merge_many(window)
            if (not i or self.pair(left[i - 1], mid[0])) and (j == len(right) or self.pair(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            size *= 2

    def tree(self, b: bytes) -> list[int]:
        if len(b) <= PIECE_LEAF:
            return self.merge(b)
        half = len(b) // 2
        return self.join_tokens(self.tree(b[:half]), self.tree(b[half:]))

    def piece(self, p: str) -> tuple[tuple[int, ...], str]:
        b = p.encode()
        own = self.ranks.get(b)
        ids = (own,) if own is not None else tuple(self.tree(b))
        found = ids, ",".join(map(str, ids))
        if len(b) <= CACHE_BYTES and len(self.known) < CACHE:
            self.known[p] = found
        return found

    # over the pieces of a text

    def encode_pieces(self, pieces: list[str]) -> list[tuple[tuple[int, ...], str]]:
        known, piece = self.known.get, self.piece
        return [known(p) or piece(p) for p in pieces]

    def leaf(self, text: str) -> Node:
        pieces = self.split(text)
        return pieces, self.encode_pieces(pieces)

    def join(self, left: Node, right: Node) -> Node:
        """The node of two neighbours' text."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        keep, tail = len(left[0]), 0
        while keep and tail < LOOK:
            keep -= 1
            tail += len(left[0][keep])
        before = "".join(left[0][keep:])
        count, pieces = 4, right[0]
        while True:
            whole = count >= len(pieces)
            window = before + "".join(pieces[:count])
            split = self.split(window)
            starts, at = {}, len(before)
            for j, p in enumerate(pieces[:count]):
                starts[at] = j
                at += len(p)
            end, last = 0, len(window) if whole else len(window) - LOOK
            for k, p in enumerate(split):
                end += len(p)
                if end > last:
                    break
                if end in starts:
                    mid, j = split[: k + 1], starts[end]
                    return left[0][:keep] + mid + pieces[j:], left[1][:keep] + self.encode_pieces(mid) + right[1][j:]
            if whole:
                return left[0][:keep] + split, left[1][:keep] + self.encode_pieces(split)
            count *= 2

    def node(self, text: str) -> Node:
        if len(text) <= TEXT_LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.node(text[:half]), self.node(text[half:]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.node(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TOKEN_LEAF:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], Bpe] = {}


def _coder(name: str, pattern: str) -> Bpe:
    """A worker's coder; the file was sent to each executor by the driver."""
    if (name, pattern) not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name, pattern] = Bpe(load_ranks(f.read()), pattern)
    return _LOADED[name, pattern]


#: What bpe_encode() can return of each text besides doc_id and n_tokens.
OUTPUTS = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, and of OUTPUTS what is asked for: the token ids, their
    decoded bytes, the SHA-256 of the decimal ids joined by commas and that of the decoded bytes (lower-case hex).

    ranks_path: a file on the driver with a base64 token and its rank on each line; pattern: what splits a text into
    pieces. A null or empty text has no tokens and no bytes. Special tokens are ordinary text. Rows are independent:
    repeated rows give repeated results, and an empty table none. Other columns are ignored.
    """
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(name, pattern)
        for batch in chunks(batches, 512):
            count: list[int] = []
            out: dict[str, list] = {k: [] for k in outputs}
            for t in batch.column(1):
                parts = bpe.node(t.as_py() or "")[1]
                ids = list(chain.from_iterable([p[0] for p in parts]))
                count.append(len(ids))
                back = bpe.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
                for k, values in out.items():
                    if k == "ids_sha256":
                        values.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                    else:
                        values.append(ids if k == "ids" else back if k == "decoded" else hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), *[pa.array(v, OUTPUTS[k][1]) for k, v in out.items()]], ["doc_id", "n_tokens", *out])

    schema = ", ".join(["doc_id long, n_tokens long", *[f"{k} {OUTPUTS[k][0]}" for k in outputs]])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
