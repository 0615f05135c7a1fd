"""Operator 5, token-ID output: flat unsigned integer files with 64-bit document offsets.

A part is three files: PART.ids, the token ids of its documents one behind the other as little-endian
unsigned integers (16 bits if the vocabulary fits, else 32), and PART.off, a little-endian signed
64-bit count for each document: the ids before its end in this part; PART.key has the keys. Parts
are in ascending key order; a part's base, the ids in all parts before it, is a prefix sum over the table of parts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import buckets, partitions, shared_path, write
from .text import ragged, text_slices

PARTS = "part int, path string, width int, n_docs long, n_ids long"
#: Pieces that a worker remembers, and bytes of texts that it encodes at once.
MEMORY, GROUP = 1_000_000, 4 << 20
#: Stands for a null key in a file of keys.
NO_KEY = -(2**63)


class Encoder(dict):
    """Ids of a piece of text without ASCII white space, as bytes; remembers MEMORY pieces.

    The tokenizer drops white space and no token spans it, and neither normal form nor lower case
    reaches over ASCII white space, so a text's ids are those of its pieces in turn. Texts are split,
    and their pieces made a dictionary, in Arrow; only the dictionary is looked at one by one.
    """

    def __init__(self, path: str, width: int) -> None:
        super().__init__()
        self.tok, self.code, self.type = Tokenizer.from_file(path), {2: "H", 4: "I"}[width], f"<u{width}"

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these different pieces, one behind the other, and how many each has; those not yet known are encoded in one call."""
        if len(self) > MEMORY:
            self.clear()
        new = [p for p in pieces if p not in self]
        for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            self[p] = array(self.code, e.ids).tobytes()
        found = [self[p] for p in pieces]
        for p in new:
            if len(p) >= 200:
                del self[p]
        return np.frombuffer(b"".join(found), self.type), np.array([len(x) for x in found], np.int64) // np.dtype(self.type).itemsize

    def ids(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each one's followed by end, and how many each text has; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = split.flatten().dictionary_encode()
        which, first = pieces.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        own, n = self.of_pieces(pieces.dictionary.to_pylist())
        begin, n_each = (np.cumsum(n) - n)[which], n[which]
        upto = np.append(0, np.cumsum(n_each))[first]  # ids of the texts before each
        counts = np.diff(upto) + len(end)
        out = np.zeros(int(counts.sum()), self.type)
        inside = np.ones(len(out), bool)
        for i, e in enumerate(end):
            at = np.cumsum(counts) - len(end) + i
            out[at], inside[at] = e, False
        out[inside] = own[ragged(begin, n_each)]
        return out, counts


@lru_cache(2)
def encoder(path: str, width: int) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Encoder(path, width)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, key: str = "doc_id", text: str = "text", n_parts: int | None = None) -> DataFrame:
    """Writes the files under path, a folder that all executors reach, and returns the table of parts, saved as path/parts.

    A null text is empty and gives the end id alone. Null keys come first; rows that repeat a key are
    in an order of no meaning. An empty table gives no parts. A task that is run again writes files of
    a new name; the table names those of the attempt that Spark kept.
    """
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if max(size, (end_id or 0) + 1) <= 65536 else 4
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(n_parts or buckets(docs), "k").sortWithinPartitions("k")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer, width), [] if end_id is None else [end_id]
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, keys, total = f"{part:06d}-{uuid.uuid4().hex}", 0, 0
        ids = offs = names = None
        for b in batches:
            if not b.num_rows:
                continue
            if ids is None:
                ids, offs, names = (fs.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "off", "key"))
            for i, j, _, _ in text_slices(b.column(1), GROUP):
                found, counts = enc.ids(b.column(1)[i:j], end)
                ids.write(found.tobytes())
                offs.write((total + np.cumsum(counts)).astype("<i8").tobytes())
                total += len(found)
            names.write(b.column(0).fill_null(NO_KEY).to_numpy().astype("<i8").tobytes())
            keys += b.num_rows
        if ids is not None:
            for f in (ids, offs, names):
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, name, width, keys, total), schema)], schema=schema)

    write(rows.mapInArrow(run, PARTS), f"{path}/parts")
    return spark.read.schema(PARTS).parquet(f"{path}/parts")


def mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's integers: memory-mapped where the file system is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as m:
            return np.frombuffer(m.read_buffer(), kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_tokens(parts: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), and the ids if asked for, read from the files."""
    bases = parts.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))  # a row for each part
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                at = f"{root}/{row['path']}"
                ids, ends, keys = mapped(fs, f"{at}.ids", f"<u{row['width']}"), mapped(fs, f"{at}.off", "<i8"), mapped(fs, f"{at}.key", "<i8")
                begins = np.append(0, ends[:-1])
                for lo in range(0, len(ends), 4096):
                    hi = min(lo + 4096, len(ends))
                    own = [ids[i:j].astype("<u4") for i, j in zip(begins[lo:hi], ends[lo:hi])]
                    columns = [pa.array([None if k == NO_KEY else int(k) for k in keys[lo:hi]], pa.int64()), pa.array(begins[lo:hi] + row["base"], pa.int64()), pa.array(ends[lo:hi] - begins[lo:hi], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype("i8") for x in own], pa.list_(pa.int64()))] * with_ids, schema=schema)

    n = max(1, min(partitions(parts.sparkSession), 10_000))
    return bases.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Writes all documents to new files in the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "token-files")
    path = path if "://" in path else f"file://{path}"
    return read_tokens(write_tokens(docs, path, tokenizer, end_id), path)
