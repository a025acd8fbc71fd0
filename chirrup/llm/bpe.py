"""Byte-level BPE: texts to token ids and back."""

from __future__ import annotations

import base64
import struct
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.llm.common import byte_sizes, kept_by_worker, map_batches, slices

OUT_BYTES = 4 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ranks, without gaps."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Merges one pre-token at a time through a queue of merge ranks.

    Positions wait in one bucket per rank.  A bitmap marks the buckets that
    hold something, in words of 256 bits, and a bitmap above it the words that
    are not zero; so the lowest rank is two find-first-set steps away, however
    long the pre-token is.  A bucket gives its leftmost position first.  The
    parts form a linked list; an entry whose pair has changed since it was
    queued is stale and skipped.
    """

    def __init__(self, tokens: list[bytes]):
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.buckets: list[list[int]] = [[] for _ in tokens]
        self.words = [0] * (len(tokens) // 256 + 1)
        self.bits = [1 << i for i in range(max(256, len(self.words)))]

    def ids(self, piece: bytes) -> list[int]:
        ranks, buckets, words, bits = self.ranks, self.buckets, self.words, self.bits
        known = ranks.get(piece)
        if known is not None or not piece:
            return [known] if piece else []
        rank_of = ranks.get
        top, n = 0, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of the part at each place joined with its successor.
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    words[rank >> 8] |= bits[rank & 255]
                    top |= bits[rank >> 8]
                bucket.append(i)  # from left to right: a heap already
        while top:
            word = (top & -top).bit_length() - 1
            marks = words[word]
            rank = (word << 8) + (marks & -marks).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                words[word] = marks = marks & (marks - 1)
                if not marks:
                    top &= top - 1
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            left = before[i]
            if end < n:
                before[end] = i
                pair[i] = rank = rank_of(piece[i : after[end]], -1)
                if rank >= 0:
                    bucket = buckets[rank]
                    if not bucket:
                        words[rank >> 8] |= bits[rank & 255]
                        top |= bits[rank >> 8]
                    heappush(bucket, i)
            else:
                pair[i] = -1
            if left >= 0:
                pair[left] = rank = rank_of(piece[left:end], -1)
                if rank >= 0:
                    bucket = buckets[rank]
                    if not bucket:
                        words[rank >> 8] |= bits[rank & 255]
                        top |= bits[rank >> 8]
                    heappush(bucket, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


class Memo(dict):
    """Packed ids of the pre-tokens met lately; two generations bound its size."""

    LIMIT, LONGEST = 160_000, 64

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.encoder, self.older = Encoder(tokens), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.encoder.ids(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def encode(df: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """(id, n_tokens, ids) of each row's whole text; ids is binary, little-endian unsigned 32-bit integers.

    With `decoded`, a column of that name holds the bytes that the ids decode to:
    the round trip in one pass.

    Every match of `pattern` is encoded separately, without special tokens; the
    characters between matches, if the pattern leaves any, are dropped, as the
    public tokenizer library does.  A null or empty text has no tokens.  Rows
    are independent: there is no shuffle, repeated rows stay, and other columns
    are not read.  The rank file is read on the driver and broadcast (under
    1 MB).
    """
    spark = df.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key = ("bpe", ranks_path)

    def make():
        import regex

        memo = kept_by_worker(key, lambda: Memo(tokens.value))
        find, unpack = regex.compile(pattern).findall, _unpacker(tokens.value)

        def step(batch):
            keys, texts = batch.columns
            sizes = byte_sizes(texts)
            for i, j in slices(sizes, OUT_BYTES):
                packed = [b"".join(map(memo.__getitem__, find(x))) if x else b"" for x in texts[i:j].to_pylist()]
                back = [[unpack(p) for p in packed]] if decoded else []
                yield keys[i:j], [len(p) // 4 for p in packed], packed, *back

        return step

    ddl = f"`{id}` {df.schema[id].dataType.simpleString()}, n_tokens bigint, ids binary"
    return map_batches(df.select(id, text), make, ddl + f", `{decoded}` binary" * bool(decoded))


def _unpacker(tokens: list[bytes]):
    from array import array

    vocabulary = tokens.__getitem__
    return lambda packed: b"".join(map(vocabulary, array("I", packed or b"")))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), out: str = "decoded") -> DataFrame:
    """The columns `keep` and the bytes that each row's ids stand for; null ids give empty bytes.

    Bytes, not text: ids may end within a character.  An id that the rank file
    lacks stops the job.
    """
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        unpack = _unpacker(tokens.value)

        def step(batch):
            held, packed = batch.columns[:-1], batch.columns[-1]
            sizes = byte_sizes(packed)
            for i, j in slices(sizes, OUT_BYTES):
                texts = [unpack(p) for p in packed[i:j].to_pylist()]
                yield *[c[i:j] for c in held], texts

        return step

    return map_batches(df.select(*keep, F.col(ids).alias("_ids")), make, f"{ddl}, `{out}` binary")
