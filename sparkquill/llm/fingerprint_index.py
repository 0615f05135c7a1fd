"""Operator 6, substring dedup: a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Its fingerprint is the smallest hash of the GRAM-word runs
inside it, so equal windows have equal fingerprints and neighbours mostly share one. The index is a
set of immutable runs, each sorted by fingerprint within buckets; a run has one entry for each
fingerprint: a document that has it and whether others have it too. A new batch is merge-joined with
all runs bucket by bucket, which names the documents whose windows must be compared, and becomes a run
of level 0 itself. FAN runs of a level are compacted to one of the next, so that an entry is written
again only once a level, not once a batch. Verification then compares those documents' windows by 128-bit
digests (96 bits beside the bucket) of their words. Nothing is dropped: a fingerprint that two documents share is always verified.

Hot fingerprints: within a map batch one that many documents have is sent on once; the documents are
named there and then.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PACKED, PACKED_ARROW, buckets, delta, pack, packed_batches, partitions, remove, scatter, shared_path, subfolders, unpack, write
from .text import U, grams, ragged, sliding_min, span_hashes, text_slices, word_spans

WINDOW, GRAM = 13, 5
#: Bytes of texts that are hashed at once.
SLICE = 1_000_000
#: Runs of a level that are compacted to one of the next.
FAN = 2
#: Kinds of packed rows: an index entry; a document and a fingerprint it shares; an entry of a new batch.
ENTRY, SHARED, NEW = 0, 1, 2


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, tkey (a hash of the text, so that rows which repeat an id are told apart) and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(t).alias("tkey"), t.alias("text"))


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple:
    """Word hashes, and for each window inside one row: its first word, its row; and each row's first word."""
    starts, ends, rows = word_spans(data, offsets)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    n = np.diff(first)
    at = ragged(first[:-1], np.maximum(n - window + 1, 0))
    return starts, ends, rows, first, at


def fingerprints(words: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Of the windows that start at the words at."""
    return sliding_min(grams(words, gram), window - gram + 1)[at] if len(at) else np.zeros(0, U)


def reduced(fp: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a fingerprint. Buckets grow with the input; what collides is told apart when verified."""
    return (fp % U(n_buckets)) << U(32) | (fp // U(n_buckets)) & U(0xFFFFFFFF)


def map_entries(n_buckets: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                ids = b.column(0)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                fps, docs = [], []
                for i, j, data, offsets in text_slices(b.column(2), SLICE):
                    starts, ends, row, _, at = windows_of(data, offsets, window)
                    fp, doc = reduced(fingerprints(span_hashes(data, starts, ends, 1), at, window, gram), n_buckets), row[at] + i
                    keep = known[doc]
                    keep[1:] &= (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                    fps.append(fp[keep])
                    docs.append(doc[keep])
                fp, doc = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((fps, U), (docs, np.int64)))
                order = np.lexsort((ids[doc], fp))
                fp, doc = fp[order], doc[order]
                again = np.zeros(len(fp), bool)
                again[1:] = (fp[1:] == fp[:-1]) & (doc[1:] == doc[:-1])
                fp, doc = fp[~again], doc[~again]
                head = np.ones(len(fp), bool)
                head[1:] = fp[1:] != fp[:-1]
                many = np.diff(np.append(np.flatnonzero(head), len(fp))) > 1
                bucket = (fp >> U(32)).astype(np.int32)
                yield from scatter(bucket[head], NEW, fp[head].astype(np.uint32), ids[doc[head]], many)
                both = np.repeat(many, np.diff(np.append(np.flatnonzero(head), len(fp))))
                yield from scatter(bucket[both], SHARED, fp[both], ids[doc[both]])

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def merge_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of runs (ENTRY) and of a batch (NEW) to the batch's own run, a row for each bucket, and the shared pairs."""

    def rows() -> Iterator[tuple]:
        held: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for b in batches:
            for bucket, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if kind == SHARED:
                    yield bucket, SHARED, data
                else:
                    held[bucket].append((kind, data))
        for bucket, pieces in held.items():
            fp, doc, many = (np.concatenate(x) for x in zip(*(unpack(p, "u4", "i8", "?") for _, p in pieces)))
            new = np.repeat([k == NEW for k, _ in pieces], [int(np.frombuffer(p, np.int64, 1)[0]) for _, p in pieces])
            order = np.argsort(fp, kind="stable")  # the pieces are sorted runs, which a stable sort merges
            fp, doc, many, new = fp[order], doc[order], many[order], new[order]
            heads = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
            n = np.diff(np.append(heads, len(fp)))
            here = np.add.reduceat(new.astype(np.int64), heads)
            # older documents are named when the second document of a fingerprint comes, and not again
            told = np.add.reduceat((many & ~new).astype(np.int64), heads) > 0
            several = (n > 1) | (np.add.reduceat((many & new).astype(np.int64), heads) > 0)
            shared = np.where(new, np.repeat(several, n) & ~many, np.repeat((here > 0) & ~told, n))
            if shared.any():
                yield bucket, SHARED, pack(fp[shared].astype(U) | U(bucket) << U(32), doc[shared])
            own = np.flatnonzero(new)
            own = own[np.append(True, fp[own][1:] != fp[own][:-1])] if len(own) else own
            if len(own):
                yield bucket, ENTRY, pack(fp[own], doc[own], several[here > 0])

    yield from packed_batches(rows(), PACKED_ARROW)


def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of some runs to a row of the run that replaces them for each bucket."""

    def rows() -> Iterator[tuple]:
        held: dict[int, list[bytes]] = defaultdict(list)
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                held[bucket].append(data)
        for bucket, pieces in held.items():
            fp, doc, many = (np.concatenate(x) for x in zip(*(unpack(p, "u4", "i8", "?") for p in pieces)))
            order = np.argsort(fp, kind="stable")
            fp, doc, many = fp[order], doc[order], many[order]
            heads = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
            yield bucket, ENTRY, pack(fp[heads], doc[heads], (np.diff(np.append(heads, len(fp))) > 1) | (np.add.reduceat(many.astype(np.int64), heads) > 0))

    yield from packed_batches(rows(), PACKED_ARROW)


class FingerprintIndex:
    """The index under one shared folder, which a later session can open again by its path.

    add() takes batches in turn. A run's folder is named by its level and number and never changes; a
    compaction that is cut off leaves both the old runs and the new one, which is no harm: an entry that
    is there twice is verified once more.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, n_buckets: int | None = None, window: int = WINDOW, gram: int = GRAM) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "fingerprints")
        made = [x for x in subfolders(spark, self.path) if x.startswith("runs-")]  # its settings are the name of the folder of its runs
        if made:
            n_buckets, window, gram = (int(x) for x in made[0].split("-")[1:])
        self.n_buckets, self.window, self.gram = n_buckets or partitions(spark), window, gram
        self.root = f"{self.path}/runs-{self.n_buckets}-{window}-{gram}"

    def runs(self) -> list[tuple[int, int]]:
        """Level and number of each run, in the order of numbers."""
        found = [x for x in subfolders(self.spark, self.root) if f"kind={ENTRY}" in subfolders(self.spark, f"{self.root}/{x}")]
        return sorted((tuple(map(int, x.split("-")[1:])) for x in found), key=lambda x: x[1])

    def read(self, level: int, number: int, kind: int) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(f"{self.root}/run-{level}-{number}").where(f"kind = {kind}").select("bucket", "kind", "data")

    def entries(self, runs: list[tuple[int, int]]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.read(*r, ENTRY) for r in runs))

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-joins a batch (keyed() rows) with all runs, writes it as a run, and compacts levels that are full.

        Returns the packed shared pairs that the batch brought, those of older documents too.
        """
        runs = self.runs()
        new = batch.mapInArrow(map_entries(self.n_buckets, self.window, self.gram), PACKED)
        if runs:
            new = new.unionByName(self.entries(runs))
        number = 1 + max((int(x.split("-")[2]) for x in subfolders(self.spark, self.root)), default=-1)
        write(new.repartition(self.n_buckets, "bucket").mapInArrow(merge_join, PACKED), f"{self.root}/run-0-{number}", partitionBy="kind")
        self.compact_levels()
        return self.read(0, number, SHARED)

    def compact_levels(self) -> None:
        while True:
            runs = self.runs()
            full = [level for level in {x[0] for x in runs} if sum(x[0] == level for x in runs) >= FAN]
            if not full:
                return
            level = min(full)
            old = [x for x in runs if x[0] == level]
            merged = self.entries(old).repartition(self.n_buckets, "bucket").mapInArrow(compact, PACKED)
            number = 1 + max(int(x.split("-")[2]) for x in subfolders(self.spark, self.root))
            write(merged, f"{self.root}/run-{level + 1}-{number}", partitionBy="kind")
            for x in old:  # their shared pairs stay with the caller of add()
                remove(self.spark, f"{self.root}/run-{x[0]}-{x[1]}/kind={ENTRY}")


LISTS = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])


def regrouped(*types: str):
    """Packed arrays, a document's id first, dealt by it, to one row (doc_id, the other arrays packed) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(x, *types) for b in batches for x in b.column(2).to_pylist()]
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        doc = columns[0]
        yield from packed_batches(((int(doc[lo]), pack(*(c[lo:hi] for c in columns[1:]))) for lo, hi in runs_of(doc[1:] != doc[:-1], len(doc))), LISTS)

    return run


def by_id(n_buckets: int):
    """Packed shared pairs dealt by fingerprint to such dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                held = [unpack(x, "u8", "i8") for x in b.column(2).to_pylist()]
                if held:
                    fp, doc = (np.concatenate(x) for x in zip(*held))
                    yield from scatter((doc % n_buckets).astype(np.int32), SHARED, doc, fp)

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def runs_of(changes: np.ndarray, n: int) -> list[tuple[int, int]]:
    cuts = np.concatenate(([0], np.flatnonzero(changes) + 1, [n])) if n else np.zeros(1, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def map_windows(n_buckets: int, window: int, gram: int):
    """(doc_id, tkey, text, fingerprints) to packed windows: a 96-bit digest beside the bucket, document, place; and places known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                ids, tkeys, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
                found = []
                for i, j, data, offsets in text_slices(b.column(2), SLICE):
                    starts, ends, row, first, at = windows_of(data, offsets, window)
                    w1 = span_hashes(data, starts, ends, 1)
                    fp, doc = reduced(fingerprints(w1, at, window, gram), n_buckets), row[at]
                    held = np.searchsorted(doc, np.arange(j - i + 1))
                    hit = np.zeros(len(fp), bool)
                    for d in range(j - i):
                        have = unpack(lists[i + d], "u8")[0]
                        hit[held[d] : held[d + 1]] = np.isin(fp[held[d] : held[d + 1]], have)
                    at, doc, fp = at[hit], doc[hit], fp[hit]
                    if len(at):
                        h2 = grams(span_hashes(data, starts, ends, 2), window)[at]
                        found.append((grams(w1, window)[at], h2.astype(np.uint32), doc + i, (at - first[doc]).astype(np.int32), (fp >> U(32)).astype(np.int32)))
                if not found:
                    continue
                h1, h2, doc, place, by_fp = (np.concatenate(x) for x in zip(*found))
                own = ids[doc]
                order = np.lexsort((own, h2, h1))
                x, y, o = h1[order], h2[order], own[order]
                heads = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                least = np.zeros(len(o), np.int64)
                least[order] = np.repeat(o[heads], np.diff(np.append(heads, len(o))))
                known = least < own
                yield from scatter((own[known] % n_buckets).astype(np.int32), SHARED, own[known], tkeys[doc[known]], place[known])
                asked = np.flatnonzero(~known)
                bucket = by_fp[asked]  # neighbours that share a fingerprint stay together, so that what they have in common packs well
                order = np.argsort(bucket, kind="stable")
                asked, bucket = asked[order], bucket[order]
                for lo, hi in runs_of(bucket[1:] != bucket[:-1], len(bucket)):
                    k = asked[lo:hi]
                    yield int(bucket[lo]), ENTRY, pack(h1[k], h2[k], delta(own[k]), delta(tkeys[doc[k]]), delta(place[k]))

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def removed_windows(n_buckets: int):
    """Packed windows of one partition to the places (doc_id, tkey, place) of those that a smaller document has, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, known = [], []
            for b in batches:
                for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if kind == SHARED:
                        known.append(unpack(data, "i8", "i8", "i4"))
                    else:
                        held.append(unpack(data, "u8", "u4", "i8", "i8", "i4"))
            if held:
                h1, h2 = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                own, tkey, place = (np.concatenate([np.cumsum(x[i], dtype=x[i].dtype) for x in held]) for i in (2, 3, 4))
                held.clear()
                order = np.lexsort((own, h2, h1))
                h1, h2 = h1[order], h2[order]
                heads = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
                o = own[order]
                later = order[o > np.repeat(o[heads], np.diff(np.append(heads, len(o))))]
                known.append([own[later], tkey[later], place[later]])
            if known:
                own, tkey, place = (np.concatenate(x) for x in zip(*known))
                order = np.lexsort((place, own))
                own, tkey, place = own[order], tkey[order], place[order]
                yield from scatter((own % n_buckets).astype(np.int32), SHARED, own, tkey, place)

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def cut_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tkeys, lists = b.column(1).to_pylist(), b.column(3).to_pylist()
            for i, j, data, offsets in text_slices(b.column(2), SLICE):
                starts, ends, row, first, _ = windows_of(data, offsets, window)
                gone = np.zeros(len(starts) + 1, np.int32)
                for d in range(j - i):
                    if lists[i + d]:
                        own, place = unpack(lists[i + d], "i8", "i4")
                        p = np.unique(place[own == tkeys[i + d]]) + first[d]
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + window, -1)
                stays = np.cumsum(gone)[:-1] == 0
                buffer = data.tobytes()
                kept = []
                for d in range(j - i):
                    s = np.flatnonzero(stays[first[d] : first[d + 1]]) + first[d]
                    kept.append(b" ".join([buffer[x:y] for x, y in zip(starts[s].tolist(), ends[s].tolist())]))
                n = np.diff(first)
                left = np.array([int(stays[first[d] : first[d + 1]].sum()) for d in range(j - i)])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(n - left, pa.int64())], schema=pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))

    return run


def dedup_windows(docs: DataFrame, n_batches: int = 3, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words, n_removed for every row.

    Removed is each word in a window whose words also start, as a window, in a row with a smaller key;
    windows are judged on the input. Rows are indexed in n_batches ranges of the key, as batches would
    come in. A null text has no words; a row with a null key is compared with nothing and stays whole.
    Rows that repeat a key never remove each other's words; of rows equal in key and text each is
    treated alike. Texts shorter than a window stay whole. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = keyed(docs, key, text)
    low, high = docs.agg(F.min(key), F.max(key)).first()
    n = buckets(docs)
    index = FingerprintIndex(spark, n_buckets=n, window=window, gram=gram)
    pairs = None
    if low is not None:
        cuts = [low + (high - low + 1) * i // n_batches for i in range(1, n_batches)]
        for i in range(n_batches):
            part = rows
            part = part.where(F.col("doc_id") >= cuts[i - 1]) if i else part
            part = part.where(F.col("doc_id") < cuts[i]) if i < n_batches - 1 else part
            new = index.add(part)
            pairs = new if pairs is None else pairs.unionByName(new)
    held = rows.repartition(n, "doc_id")
    if pairs is None:
        found = spark.createDataFrame([], "doc_id long, data binary")
    else:
        shared = pairs.mapInArrow(by_id(n), PACKED).repartition(n, "bucket").mapInArrow(regrouped("i8", "u8"), "doc_id long, data binary").hint("shuffle_hash")
        asked = held.join(shared, "doc_id").select("doc_id", "tkey", "text", "data")
        packed = asked.mapInArrow(map_windows(n, window, gram), PACKED).repartition(n, "bucket")
        found = packed.mapInArrow(removed_windows(n), PACKED).repartition(n, "bucket").mapInArrow(regrouped("i8", "i8", "i4"), "doc_id long, data binary").hint("shuffle_hash")
    joined = held.join(found, "doc_id", "left").select("doc_id", "tkey", "text", "data")
    return joined.mapInArrow(cut_words(window), "doc_id long, kept string, n_words long, n_removed long")
