"""Byte-level BPE encoding and decoding from a table of ranks.

The next merge is found in a rank queue: one bucket per merge rank holds the positions of linked
list nodes whose pair has that rank, and a bitmap of two levels over the ranks gives the lowest
non-empty bucket by find-first-set. Entries whose pair has changed meanwhile are skipped when they
are met. A pre-token of n bytes takes O(n log n) steps whatever its length, where scanning for the
lowest pair takes O(n^2). The new pre-tokens of a batch share one queue, so opening and popping
buckets costs little per pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpanel.llm.common import text_chunks
from flowpanel.llm.pretokens import KEPT_CHARS, PieceTable

# Ranks per bitmap word, as a power of two.
WORD_BITS = 8
MASK = (1 << WORD_BITS) - 1
# White space as the Unicode property has it; `\s` differs between libraries for control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
# Pre-tokens kept per worker; the results do not depend on it.
KEPT_PRETOKENS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def compiled(pattern: str):
    """The pattern with `\\s` and `\\S` written out as the Unicode white space property."""
    text = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(text)


class RankQueue:
    """Positions by merge rank; the lowest non-empty bucket comes first.

    `words[w]` has a bit for each non-empty bucket of the ranks w * 256 to w * 256 + 255, `top` a bit
    for each word that is not zero.
    """

    __slots__ = ("buckets", "words", "top")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def open(self, rank: int) -> list[int]:
        """A new bucket for `rank`, which has none."""
        word = rank >> WORD_BITS
        if word in self.words:
            self.words[word] |= 1 << (rank & MASK)
        else:
            self.words[word] = 1 << (rank & MASK)
            self.top |= 1 << word
        bucket = self.buckets[rank] = []
        return bucket

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket, which leaves the queue; rank -1 when nothing is left."""
        top = self.top
        if not top:
            return -1, []
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        if bits == low:
            del self.words[word]
            self.top = top & (top - 1)
        else:
            self.words[word] = bits ^ low
        rank = (word << WORD_BITS) + low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = compiled(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.kept: dict[str, bytes] = {}
        self.table = PieceTable(self._encode_pieces)

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token.

        All pre-tokens lie in one linked list and share one queue. They do not touch each other, so
        taking the lowest rank of all is taking the lowest rank of each. Within a bucket positions
        go from left to right; when a merge brings up a lower rank, or the same one again, the rest
        of the bucket goes back into the queue.
        """
        ranks = self.ranks
        get = ranks.get
        text = b"".join(tokens)
        n = len(text)
        last = bytearray(n + 1)  # 1 where a pre-token ends
        at = 0
        starts = []
        for t in tokens:
            starts.append(at)
            at += len(t)
            last[at] = 1
        after = list(range(1, n + 1))  # node i covers text[i:after[i]]
        before = list(range(-1, n))
        pair = [-1] * n  # rank of node i joined with the next one
        queue = RankQueue()
        buckets, fresh = queue.buckets, queue.open
        for i in range(n - 1):
            if not last[i + 1]:
                r = get(text[i : i + 2])
                if r is not None:
                    pair[i] = r
                    (buckets.get(r) or fresh(r)).append(i)
        for s in starts:
            if s < n:
                before[s] = -1
        while True:
            rank, bucket = queue.pop()
            if rank < 0:
                break
            bucket.sort()
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                low = n_ranks = rank + 1
                j = after[i]
                end = after[i] = after[j]
                pair[j] = -1
                if last[end]:
                    pair[i] = -1
                else:
                    before[end] = i
                    r = get(text[i : after[end]])
                    if r is None:
                        pair[i] = -1
                    else:
                        pair[i] = low = r
                        (buckets.get(r) or fresh(r)).append(i)
                h = before[i]
                if h >= 0:
                    r = get(text[h:end])
                    if r is None:
                        pair[h] = -1
                    elif r != pair[h]:
                        pair[h] = r
                        (buckets.get(r) or fresh(r)).append(h)
                        low = min(low, r)
                if low < n_ranks:
                    rest = bucket[k + 1 :]
                    if rest:
                        (buckets.get(rank) or fresh(rank)).extend(rest)
                    break
        out = []
        for s, t in zip(starts, tokens, strict=True):
            ids, e = [], s + len(t)
            while s < e:
                ids.append(ranks[text[s : after[s]]])
                s = after[s]
            out.append(ids)
        return out

    def _encode_pieces(self, texts: list[str]) -> list[bytes]:
        find, kept, ranks = self.pattern.findall, self.kept, self.ranks
        cuts = [find(t) for t in texts]
        if len(kept) > KEPT_PRETOKENS:
            kept.clear()
        known: dict[str, bytes] = {}
        missing = []
        for t in {t for c in cuts for t in c}:
            b = kept.get(t)
            if b is None:
                raw = t.encode()
                whole = ranks.get(raw)
                if whole is None:
                    missing.append((t, raw))
                    continue
                b = whole.to_bytes(4, "little")
            known[t] = b
        for (t, _), ids in zip(missing, self.merge([raw for _, raw in missing]), strict=True):
            b = known[t] = np.array(ids, dtype="<u4").tobytes()
            if len(t) <= KEPT_CHARS:
                kept[t] = b
        return [known[c[0]] if len(c) == 1 else b"".join([known[t] for t in c]) for c in cuts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self.table.ids(texts)

    def decode(self, ids: bytes) -> bytes:
        known = self.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder per worker process and vocabulary file."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_rows(texts: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                digests: bool = False) -> DataFrame:
    """One row per row of `texts`: its ids and the text decoded from them, or their digests.

    Null texts are empty (no ids); ids may repeat or be null; other columns are ignored. Texts may
    be of any length. Every worker needs the vocabulary file at `path`.
    """
    columns = (
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens bigint, ids binary, decoded binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for keys, own in text_chunks(batches, "k", "t"):
            ids = bpe.encode([t.decode() for t in own])
            back = [bpe.decode(x) for x in ids]
            if digests:
                ids_out = [hashlib.sha256(x).hexdigest() for x in ids]
                back_out = [hashlib.sha256(x).hexdigest() for x in back]
                kind = pa.string()
            else:
                ids_out, back_out, kind = ids, back, pa.binary()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids_out, kind), pa.array(back_out, kind)],
                names=[id_col, *[c.split()[0] for c in columns.split(", ")]],
            )

    rows = texts.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` bigint, {columns}")
