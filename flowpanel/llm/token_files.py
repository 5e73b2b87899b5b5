"""Token ids as flat binary files with 64-bit document offsets.

Format: each part has `<name>.bin`, the ids of its documents one after another as little-endian
unsigned integers (16 bits when the vocabulary and the end id fit, else 32), and `<name>.idx`, three
64-bit words per document: its id, the offset of its first token in the part, its number of tokens.
Parts hold ascending ranges of document ids; the table of parts names each file with its first
token in the whole corpus, a prefix sum over the parts. A file is named in that table only by the
task attempt that Spark accepted, so repeated or lost attempts leave no trace in the result.

Texts are encoded where they are read; what is dealt by ranges and sorted are the ids in their file
format, about a quarter of the text. The bounds of the ranges are quantiles of the document ids, read
from that column alone.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowpanel.llm.common import cut, local_path, shuffle_partitions, text_chunks
from flowpanel.llm.pretokens import KEPT_CHARS, PieceTable, pieces, word_pieces
from flowpanel.session import new_path

PARTS = "part int, name string, width int, n_docs bigint, n_tokens bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

# Fixed value: the pattern of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces kept by a worker, and half as many matches; the results do not depend on it.
TABLE_PIECES = 1_000_000
LEAST = -(1 << 63)  # stands for a null id in the index
_TABLES: dict[tuple[str, int], PieceTable] = {}


def _width(size: int, end_id: int | None) -> int:
    return 2 if max(size - 1, end_id or 0) < 1 << 16 else 4


def _byte_level(tokenizer) -> bool:
    """The tokenizer cuts by exactly the byte-level pattern and changes nothing before."""
    settings = json.loads(tokenizer.to_str())
    pre = settings["pre_tokenizer"] or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not settings["normalizer"]


def _cutter(tokenizer) -> Callable[[str], list[str]]:
    """How a text is cut into pieces that the tokenizer treats on their own.

    Strings of added tokens stand alone, what is between them is cut at white space. Added tokens that
    take white space with them, or look at what stands beside them, leave the text whole.
    """
    plain = word_pieces if _byte_level(tokenizer) else pieces
    added = tokenizer.get_added_tokens_decoder().values()
    if any(a.lstrip or a.rstrip or a.single_word for a in added):
        return lambda text: [text]
    marks = sorted((a.content for a in added if a.content), key=len, reverse=True)
    if not marks:
        return plain
    mark = re.compile("(" + "|".join(map(re.escape, marks)) + ")")

    def cut_text(text: str) -> list[str]:
        if not any(m in text for m in marks):
            return plain(text)
        out: list[str] = []
        for i, x in enumerate(mark.split(text)):
            out += [x] if i % 2 else plain(x) if x else []
        return out

    return cut_text


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it can be printed, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


def _encoder(tokenizer, code: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of pieces by the library.

    With the byte-level pattern a piece is cut into its matches and only those that no piece had
    before go to the library's model; other tokenizers encode the pieces as texts.
    """
    def as_bytes(ids: list[int]) -> bytes:
        a = array.array(code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    if not _byte_level(tokenizer):
        return lambda texts: [as_bytes(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    letters, model = _byte_letters(), tokenizer.model
    added = {a.content: i for i, a in tokenizer.get_added_tokens_decoder().items()}
    known: dict[str, bytes] = {}

    def of_match(m: str) -> bytes:
        found = known.get(m)
        if found is None:
            found = as_bytes([t.id for t in model.tokenize(m.encode().decode("latin-1").translate(letters))])
            if len(m) <= KEPT_CHARS:
                known[m] = found
        return found

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > TABLE_PIECES // 2:
            known.clear()
        out = []
        for t in texts:
            if t in added:
                out.append(as_bytes([added[t]]))
                continue
            own = _matches(t)
            out.append(of_match(own[0]) if len(own) == 1 else b"".join(map(of_match, own)))
        return out

    return encode


_BYTE_LEVEL = regex.compile(BYTE_LEVEL)


def _matches(piece: str) -> list[str]:
    """The matches of the byte-level pattern in a piece; a word, or one before marks, is told without it."""
    word = piece.rstrip(".,;:!?")
    if (word[1:] if word[:1] == " " else word).isalpha():
        return [word] if len(word) == len(piece) else [word, piece[len(word) :]]
    return _BYTE_LEVEL.findall(piece)


def _table(path: str, width: int) -> PieceTable:
    """The pieces' table of a tokenizer file, one per worker process and bytes of an id."""
    if (path, width) not in _TABLES:
        tokenizer = _load(path)
        _TABLES[path, width] = PieceTable(_encoder(tokenizer, "H" if width == 2 else "I"), _cutter(tokenizer), TABLE_PIECES)
    return _TABLES[path, width]


def _bounds(ids: DataFrame, n: int) -> np.ndarray:
    """At most n - 1 ascending ids that cut the documents into ranges of about the same number; null is the least."""
    filled = ids.select(F.coalesce("k", F.lit(LEAST)).alias("k"))
    found = filled.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    return np.array([min(int(x), np.iinfo(np.int64).max) for x in found], dtype=np.int64)


def _placed(keys: np.ndarray, sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each document by id; ids that are a bound more than once spread over the ranges between by checksum."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    spread = np.maximum(high - low, 1)
    return low + (sums * spread >> 32)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    path = local_path(folder)
    if path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode texts, write them in ascending id order, return the table of parts with their bases.

    `tokenizer` is a file of the tokenizers library with a byte-level pre-tokenizer without prefix
    space; strings of its added tokens in a text become these tokens, as in a plain call. `folder`
    must be reachable by all executors. Null texts are empty documents (only the end id, if one is
    given), null ids come first, repeated ids stand in the order of (crc32, bytes) of their ids as in
    the file, other columns are ignored. An empty table gives no parts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    n = parts or shuffle_partitions(spark)
    bounds = _bounds(rows.select("k"), n)  # one number per part
    width = _width(_load(tokenizer).get_vocab_size(with_added_tokens=True), end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer, width)
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        for keys, own in text_chunks(batches, "k", "t"):
            found = [ids + end for ids in table.ids([t.decode() for t in own])]
            sums = np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found))
            place = _placed(np.array([LEAST if k is None else k for k in keys], dtype=np.int64), sums, bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), pa.array(keys, pa.int64()), pa.array(sums), pa.array(found, pa.binary())], names=["part", "k", "sum", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, where = _open(folder)
        fs.create_dir(where, recursive=True)
        offset, index = 0, []
        with fs.open_output_stream(f"{where}/{name}.bin") as out:
            for b in batches:
                for key, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    own = ids.as_buffer()
                    out.write(own)
                    n_tokens = own.size // width
                    index.append((LEAST if key is None else key, offset, n_tokens))
                    offset += n_tokens
        with fs.open_output_stream(f"{where}/{name}.idx") as out:
            out.write(np.array(index, dtype="<i8").tobytes())
        if index:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "name": [name], "width": [width], "n_docs": [len(index)], "n_tokens": [offset]},
                schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    encoded = rows.mapInArrow(encode, "part int, k bigint, sum bigint, ids binary")
    dealt = encoded.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("k").asc_nulls_first(), "sum", "ids")
    written = cut(dealt.select("k", "ids").mapInArrow(write, PARTS), "token-parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per part
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("bigint"))


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: id, first token in the corpus, tokens, crc32 of its ids.

    Local files are memory-mapped. The crc32 is that of the ids as little-endian 32-bit integers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _open(folder)
        for batch in batches:
            for p in batch.to_pylist():
                with _mapped(fs, f"{where}/{p['name']}.idx") as f:
                    index = np.frombuffer(f.read_buffer(), dtype="<i8").reshape(-1, 3)
                with _mapped(fs, f"{where}/{p['name']}.bin") as f:
                    ids = np.frombuffer(f.read_buffer(), dtype=f"<u{p['width']}")
                    for i in range(0, len(index), 1000):
                        own = index[i : i + 1000]
                        sums = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for _, a, n in own.tolist()]
                        empty = own[:, 0] == LEAST
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[:, 0], pa.int64(), mask=empty), pa.array(own[:, 1] + p["base"]),
                             pa.array(own[:, 2]), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    n = shuffle_partitions(parts.sparkSession)
    return parts.repartition(n, "part").mapInArrow(run, READ)


def _mapped(fs: pafs.FileSystem, path: str):
    if isinstance(fs, pafs.LocalFileSystem) and os.path.getsize(path):
        return pa.memory_map(path)
    return fs.open_input_file(path)


def token_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
