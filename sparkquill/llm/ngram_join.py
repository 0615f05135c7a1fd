"""Operator 10, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one node.
Each node is listed under its prefix: so many of its shingles, rarest first by a count sketch of all
shingles, that two sets similar enough have LEAST in common. The nodes listed under a shingle, ordered
by size, are a tile; large tiles are cut into blocks, and pairs of blocks whose sizes can match are
compared in tasks of their own. Rows of tiles that have a partner by size and place are sent signatures;
those that still have one, since the bits that differ bound the overlap from above, are sent the sorted
arrays, and the pairs left are intersected exactly where the tile is, so that no table of pairs is made.
A pair that is in small tiles only must be in LEAST of them, and is a tile of two rows.

Copies with edits would make all pairs of a group. So first each node is compared with the first node
of its band of sizes only, where they share a third of the prefix; the links found give components, and
then only pairs from different components are looked at, all of them. Links found in a tile join
components there at once, so that a linked group costs its rows, not its pairs.

So not all links inside a component are met on the way. To count them, where some may be missing, the component's
sets are packed into blocks, and each pair of blocks is one group that intersects all sets of the one with all of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import PACKED, PACKED_ARROW, Scratch, buckets, pack, packed_batches, partitions, scatter, stage, unpack
from .text import U, grams, mix, ragged, span_hashes, text_slices, word_spans

#: Counters of one byte, which stop at 255, of the sketch of shingle counts: 16 MB, whatever the input.
SKETCH, SLICES = 1 << 24, 64
#: Nodes of a tile that are compared in one task.
BLOCK = 2048
#: Shingles of their prefixes that two similar sets share (or all they must share, if fewer).
LEAST = 3
#: A tile with more pairs by size and place than this for each of its rows is large.
DENSE = 4
#: Pairs of one node that one task intersects.
GROUP = 256
#: Shingles of a tile's block, so that the arrays of two blocks fit a task.
BLOCK_SHINGLES = 1 << 21
#: Nodes of a component, and about how many shingles of theirs, in a block whose links are counted with another block's.
LINK_NODES, LINK_SHINGLES = 1024, 1 << 20
#: Shingles that are columns of one matrix there.
LINK_COLUMNS = 1024
#: Bits of a signature: the power of two at or above four times the set's size, between these.
BITS = (64, 16384)
LISTED, SIGNED = 0, 1

_LOWER = np.arange(256).astype(np.uint8)
_LOWER[65:91] += 32


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and the offsets of the rows in them."""
    low = _LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    words = span_hashes(low, starts, ends, 11)
    n_rows = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    n = np.diff(first)
    at = ragged(first[:-1], np.maximum(n - k + 1, 0))
    found, owner = [grams(words, k)[at] if len(at) else np.zeros(0, U)], [rows[at]]
    for short in range(1, k):  # the whole sequence is the one shingle
        d = np.flatnonzero(n == short)
        if len(d):
            found.append(mix(grams(words, short)[first[d]] + U(short)))
            owner.append(d)
    h, r = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(n_rows + 1))


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A node's id: a hash of its set, which does not depend on order."""
    total = np.append(U(0), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U) * U(0x14057B7EF767814F)).view(np.int64)


CLASSES = "doc_id long, tkey long, node long, n long, slice int, data binary"
CLASSES_ARROW = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("data", pa.binary())])


def map_classes(k: int):
    """Rows with a node for each document, and at a task's end its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint8)
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(2)):
                h, at = sets(data, offsets, k)
                place, times = np.unique((h % U(SKETCH)).astype(np.int64), return_counts=True)
                sketch[place] = np.minimum(sketch[place] + times, 255)
                none = pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(digests(h, at)), pa.array(np.diff(at)), *none], schema=CLASSES_ARROW)
        if sketch.any():
            parts = np.split(sketch, SLICES)
            none = [pa.nulls(SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=CLASSES_ARROW)

    return run


def add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[s] = np.minimum(sums.get(s, 0) + np.frombuffer(data, np.uint8).astype(np.int32), 255)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.uint8).tobytes() for v in sums.values()], pa.binary())], names=["slice", "data"])


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles under which a set of size n is listed: of any wanted ones that many must be among them as least_shared() says."""
    wanted = (num * n + den - 1) // den
    return n - wanted + np.minimum(LEAST, wanted)


def least_shared(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.minimum(LEAST, (num * n + den - 1) // den)


def signature(h: np.ndarray) -> bytes:
    bits = min(max(BITS[0], 1 << int(4 * len(h) - 1).bit_length() if len(h) else 0), BITS[1])
    out = np.zeros(bits, np.uint8)
    out[(mix(h) % U(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def map_listed(k: int, num: int, den: int, n_buckets: int, sketch):
    """Documents to packed lists (shingle, node, size, place) by bucket of the shingle, and a signature for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value

        def rows() -> Iterator[tuple]:
            for b in batches:
                seen: set[int] = set()
                lists = []
                for _, _, data, offsets in text_slices(b.column(0)):
                    h, at = sets(data, offsets, k)
                    nodes, n = digests(h, at), np.diff(at)
                    fresh = np.zeros(len(n), bool)
                    for d, node in enumerate(nodes.tolist()):
                        if n[d] and node not in seen:
                            seen.add(node)
                            fresh[d] = True
                    row = np.repeat(np.arange(len(n)), n)
                    order = np.lexsort((h, counts[(h % U(SKETCH)).astype(np.int64)], row))
                    place = np.arange(len(h)) - at[:-1][row]
                    prefix = prefix_size(n, num, den)
                    take = (place < prefix[row]) & fresh[row]
                    token, row, place = h[order][take], row[take], place[take]
                    lists.append((token, nodes[row], n[row].astype(np.int32), place.astype(np.int32)))
                    for d in np.flatnonzero(fresh).tolist():
                        yield int(nodes[d] % n_buckets), SIGNED, int(nodes[d]).to_bytes(8, "big", signed=True) + signature(h[at[d] : at[d + 1]])
                if lists:
                    token, node, n, place = (np.concatenate(x) for x in zip(*lists))
                    yield from scatter((mix(token) % U(n_buckets)).astype(np.int32), LISTED, token, node, n, place)

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


TILES = "kind int, a long, b long, c int, d int, side int"
TILES_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("d", pa.int32()), ("side", pa.int32())])
STAR, ROW = 0, 1


def make_tiles(num: int, den: int):
    """Packed lists of one partition to tiles of two nodes or more: their rows by block pair, and their stars."""

    def emit(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 200_000):
            part = [c[i : i + 200_000] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *(pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(part, list(TILES_ARROW)[1:]))], schema=TILES_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(x, "u8", "i8", "i4", "i4") for b in batches for x in b.column(2).to_pylist()]
        if not held:
            return
        token, node, n, place = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((node, n, token))
        token, node, n, place = token[order], node[order], n[order], place[order]
        keep = np.ones(len(token), bool)  # a copy in another batch lists the same node again
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, place = token[keep], node[keep], n[keep], place[keep]
        heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(heads, len(token)))
        several = np.repeat(size > 1, size)
        token, node, n, place = token[several], node[several], n[several], place[several]
        size = size[size > 1]
        if not len(size):
            return
        tile, begin = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
        least = (num * n.astype(np.int64) + den - 1) // den
        leader = np.searchsorted((tile << 32) + n, (tile << 32) + least)
        star = leader != np.arange(len(leader))
        x, y = node[star], node[leader[star]]
        prefix = prefix_size(n.astype(np.int64), num, den)[star]
        order = np.lexsort((y, x))
        x, y, prefix = x[order], y[order], prefix[order]
        cut = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, int)
        yield from emit(STAR, x[cut], y[cut], np.diff(np.append(cut, len(x))), prefix[cut], np.zeros(len(cut)))
        weight = np.cumsum(n, dtype=np.int64)
        weight -= (weight - n)[begin]  # of the tile's rows up to this one
        block = np.maximum((np.arange(len(tile)) - begin) // BLOCK, weight // BLOCK_SHINGLES)
        whole = block[begin + np.repeat(size, size) - 1] == 0
        small = whole
        key = mix(token).view(np.int64)
        yield from emit(ROW, key[small], node[small], n[small], place[small], np.zeros(int(small.sum())))
        for t in np.unique(tile[~whole]).tolist():
            lo = int(begin[np.searchsorted(tile, t)])
            rows = np.arange(lo, lo + size[t])
            blocks = np.unique(block[rows]).tolist()
            for q, i in enumerate(blocks):
                left = rows[block[rows] == i]
                for j in blocks[q:]:
                    right = rows[block[rows] == j]
                    if n[left[-1]] < least[right[0]]:
                        break
                    pair = np.full(1, key[lo]).view(U) + U(i * 1_000_003 + j + 1)
                    both = rows[(block[rows] == i) | (block[rows] == j)]
                    side = np.where(i == j, 0, np.where(block[both] == i, 1, 2))
                    yield from emit(ROW, np.full(len(both), mix(pair).view(np.int64)[0]), node[both], n[both], place[both], side)

    return run


PAIRS = "a long, b long"
PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fold(data: np.ndarray, at: np.ndarray, width: np.ndarray, to: int) -> np.ndarray:
    """Signatures at these offsets as rows of to bytes; wider ones are folded."""
    out = np.zeros((len(at), to), np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        got = data[at[own][:, None] + np.arange(w)]
        out[own] = np.bitwise_or.reduce(got.reshape(len(own), w // to, to), axis=1)
    return out


def partners(num: int, den: int, key: np.ndarray, n: np.ndarray, place: np.ndarray, side: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x and y of one tile, of different components, whose sizes and places allow the overlap wanted; rows come by key and size."""
    active, step = np.arange(len(key) - 1), 0
    while len(active):
        step += 1
        active = active[active + step < len(key)]
        y = active + step
        active = active[(key[active] == key[y]) & (n[active] * den >= num * n[y])]
        y = active + step
        wanted = (num * (n[active] + n[y]) + num + den - 1) // (num + den)
        may = (comp[active] != comp[y]) & ((side[active] == 0) | (side[active] != side[y]))
        may &= np.minimum(n[active] - place[active], n[y] - place[y]) + LEAST - 1 >= wanted  # the last of LEAST that they share
        if may.any():
            yield active[may], y[may], wanted[may]


SIEVED = "kind int, a long, b long, c int, d int, side int, comp long"
SIEVED_ARROW = pa.schema([*TILES_ARROW, ("comp", pa.int64())])
TWO = 2


def sieve(num: int, den: int):
    """Rows of tiles with components to those rows of large tiles that have a partner (ROW), and the pairs of small tiles (TWO).

    A pair's columns: both nodes, both sizes, and in comp how many tiles the two must share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, node, n, place, side, comp = (table.column(c).to_numpy() for c in ("a", "b", "c", "d", "side", "comp"))
        order = np.lexsort((node, n, key))
        key, node, n, place, side, comp = key[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64), side[order], comp[order]
        tile = np.cumsum(np.append(False, key[1:] != key[:-1]))
        met = np.zeros(tile[-1] + 1, np.int64)
        for x, _, _ in partners(num, den, key, n, place, side, comp):
            met += np.bincount(tile[x], minlength=len(met))
        large = (met > DENSE * np.bincount(tile))[tile]
        stays = np.zeros(len(key), bool)
        for x, y, _ in partners(num, den, key, n, place, side, comp):
            big = large[x]
            stays[x[big]] = stays[y[big]] = True
            x, y = x[~big], y[~big]
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield from emitted(TWO, node[x], node[y], n[x], n[y], side[x], np.minimum(least_shared(n[x], num, den), least_shared(n[y], num, den)))
        yield from emitted(ROW, *(v[stays] for v in (key, node, n, place, side, comp)))

    return run


def emitted(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 200_000):
        part = [c[i : i + 200_000] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *(pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(part, list(SIEVED_ARROW)[1:]))], schema=SIEVED_ARROW)


def signed_pairs(p: np.ndarray, q: np.ndarray, wanted: np.ndarray, n: np.ndarray, data: np.ndarray, start: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs of rows p, q those whose signatures allow the overlap wanted: bits that differ bound it from above."""
    for lo in range(0, len(p), 100_000):
        x, y, w = p[lo : lo + 100_000], q[lo : lo + 100_000], wanted[lo : lo + 100_000]
        to = np.minimum(width[x], width[y])
        for t in np.unique(to).tolist():
            own = np.flatnonzero(to == t)
            i, j = x[own], y[own]
            differ = np.bitwise_count(fold(data, start[i], width[i], t) ^ fold(data, start[j], width[j], t)).sum(axis=1, dtype=np.int64)
            good = (n[i] + n[j] - differ) // 2 >= w[own]
            yield i[good], j[good]


def screen_tiles(num: int, den: int):
    """Rows of tiles with signatures and components to those rows that have a partner by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, node, n, place, side, comp = (table.column(c).to_numpy() for c in ("a", "b", "c", "d", "side", "comp"))
        sig = pa.concat_arrays(table.column("sig").chunks)
        _, offsets, data = sig.buffers()
        offsets = np.frombuffer(offsets, np.int32)[sig.offset : sig.offset + len(sig) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        order = np.lexsort((node, n, key))
        key, node, n, place, side, comp = key[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64), side[order], comp[order]
        start, width = offsets[:-1][order], np.diff(offsets)[order]
        stays = np.zeros(len(key), bool)
        for x, y, wanted in partners(num, den, key, n, place, side, comp):
            new = ~(stays[x] & stays[y])
            for i, j in signed_pairs(x[new], y[new], wanted[new], n, data, start, width):
                stays[i] = stays[j] = True
        yield from emitted(ROW, *(v[stays] for v in (key, node, n, place, side, comp)))

    return run


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, whatever batches they lie in."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        if held and len(k) and k[0] != held[-1].column(b.schema.get_field_index(key))[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def intersect_tiles(num: int, den: int):
    """Rows of tiles with arrays, in the order of tiles, to links that join components: pairs whose signatures allow it are intersected exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "a"):
            key, node, n, place, side, comp = (table.column(c).to_numpy() for c in ("a", "b", "c", "d", "side", "comp"))
            order = np.lexsort((node, n))
            key, node, n, place, side, comp = key[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64), side[order], comp[order].copy()
            arrays = [np.frombuffer(x, U) for x in table.column("data").take(pa.array(order)).to_pylist()]
            signs = [signature(h) for h in arrays]
            width = np.array([len(x) for x in signs])
            start, data = np.cumsum(width) - width, np.frombuffer(b"".join(signs), np.uint8)
            found = []
            for x, y, wanted in partners(num, den, key, n, place, side, comp):  # which sees the components joined here
                for i, j in signed_pairs(x, y, wanted, n, data, start, width):
                    for p, q in zip(i.tolist(), j.tolist()):
                        if comp[p] == comp[q]:
                            continue
                        own, other = arrays[p], arrays[q]
                        same = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                        if den * same >= num * (len(own) + len(other) - same):
                            found.append((node[p], node[q]))
                            comp[comp == comp[q]] = comp[p]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIRS_ARROW)

    return run


def map_arrays(k: int, bits):
    """Sorted arrays of the nodes that the filter lets through (a few more than are asked for)."""
    schema = pa.schema([("node", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)

        def rows() -> Iterator[tuple]:
            seen: set[int] = set()  # nodes of this partition
            for b in batches:
                for _, _, data, offsets in text_slices(b.column(0)):
                    h, at = sets(data, offsets, k)
                    nodes = digests(h, at)
                    for d in np.flatnonzero(wanted[nodes.view(U) % U(len(wanted))]).tolist():
                        if int(nodes[d]) not in seen:
                            seen.add(int(nodes[d]))
                            yield int(nodes[d]), h[at[d] : at[d + 1]].tobytes()

        yield from packed_batches(rows(), schema)

    return run


FILTER = 1 << 23


def node_filter(nodes: DataFrame) -> bytes:
    """A bitmap of the nodes' ids modulo FILTER: 1 MB, whatever their number. It only spares work."""
    place = F.col("node").bitwiseAND(F.lit(FILTER - 1))
    found = nodes.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = bytearray(FILTER // 8)
    for r in found:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def intersect(num: int, den: int):
    """Groups (a, part) with a's array and others' to the links among them; rows come in the order of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for b in batches:
            out_a, out_b = [], []
            for a, part, node, data in zip(*(b.column(c).to_pylist() for c in ("a", "part", "node", "data"))):
                h = np.frombuffer(data, U)
                if (a, part) != group:
                    group, own = (a, part), h if node == a else None
                elif own is not None and node != a:
                    if min(len(own), len(h)) * den < num * max(len(own), len(h)):
                        continue
                    place = np.minimum(np.searchsorted(own, h), len(own) - 1)
                    same = int((own[place] == h).sum())
                    if den * same >= num * (len(own) + len(h) - same):
                        out_a.append(a)
                        out_b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=PAIRS_ARROW)

    return run


def arrays_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, data (its sorted array): one row for each of nodes, and a few others. docs: one column, the text."""
    bits = docs.sparkSession.sparkContext.broadcast(node_filter(nodes))
    return docs.mapInArrow(map_arrays(k, bits), "node long, data binary").dropDuplicates(["node"])


def star_links(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b: nodes), a few for each b, whose sets are similar enough. docs: one column, the text."""
    spark = docs.sparkSession
    arrays = arrays_of(docs, pairs.selectExpr("a node").unionByName(pairs.selectExpr("b node")), k)
    # a node of many pairs has them dealt over parts, and its own array sent to each
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    others = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    firsts = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    asked = others.unionByName(firsts)
    rows = asked.join(arrays, "node").repartition(partitions(spark), "a", "part")
    rows = rows.withColumn("other", F.col("node") != F.col("a")).sortWithinPartitions("a", "part", "other", "node")
    return rows.select("a", "part", "node", "data").mapInArrow(intersect(num, den), PAIRS).distinct()


BLOCKS = "component long, own int, parts int, data binary"
BLOCKS_ARROW = pa.schema([("component", pa.int64()), ("own", pa.int32()), ("parts", pa.int32()), ("data", pa.binary())])


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in the order of (component, own) to one row a block: its shingles, and which of them each set has."""
    for table in by_group(batches, "block"):
        parts = [np.frombuffer(d, U) for d in table.column("data").to_pylist()]
        shingles, which = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.array([len(h) for h in parts])
        data = pack(table.column("node").to_numpy(), n) + pack(shingles) + pack(which.astype(np.uint32))
        yield pa.RecordBatch.from_arrays([*(pa.array([table.column(c)[0].as_py()], BLOCKS_ARROW.field(c).type) for c in ("component", "own", "parts")), pa.array([data], pa.binary())], schema=BLOCKS_ARROW)


def unpack_block(data: bytes) -> tuple[np.ndarray, ...]:
    """Nodes, sizes, shingles and the shingles' numbers of all sets of a block."""
    node, n = unpack(data, "i8", "i8")
    at = 8 + 16 * len(node)
    (shingles,) = unpack(data[at:], "u8")
    at += 8 + 8 * len(shingles)
    (which,) = unpack(data[at:], "u4")
    return node, n, shingles, which


def count_links(num: int, den: int):
    """Groups (component, i, j) with blocks i and j to the links of each node in them; rows come in the order of groups."""
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64())])

    def counted(held: list[bytes]) -> pa.RecordBatch:
        blocks = [unpack_block(x) for x in held]
        _, number = np.unique(np.concatenate([b[2] for b in blocks]), return_inverse=True)
        node, n = (np.concatenate([b[c] for b in blocks]) for c in (0, 1))
        base = np.cumsum([0, *(len(b[2]) for b in blocks)])
        column = number[np.concatenate([b[3].astype(np.int64) + base[i] for i, b in enumerate(blocks)])]
        row = np.repeat(np.arange(len(n)), n)
        times = np.bincount(column)
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # shingles of one set alone are in no intersection
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        half = len(blocks[0][0])
        left, right = np.arange(half), np.arange(len(n) - len(blocks[-1][0]), len(n))
        same = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2 ** 24 are exact
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + LINK_COLUMNS])
            has = np.zeros((len(n), min(LINK_COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
            has[row[a:b], column[a:b] - lo] = 1
            same += has[left] @ has[right].T
        same = same.astype(np.int64)
        linked = den * same >= num * (n[left][:, None] + n[right][None, :] - same)
        linked &= node[left][:, None] != node[right][None, :]
        links = np.zeros(len(n), np.int64)
        links[left] = linked.sum(axis=1)
        if len(blocks) > 1:
            links[right] = linked.sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "pair"):
            yield counted(table.column("data").to_pylist())

    return run


def all_links(docs: DataFrame, found: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, n_links for the nodes of components not all of whose pairs are links that are known. found: node, n, component, n_links (known); docs: one column, the text."""
    n = buckets(docs)
    sizes = found.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_links").alias("known"), F.sum("n").alias("shingles")).where("known < m * (m - 1)")
    sizes = sizes.selectExpr("component", f"cast(ceil(greatest(m / {LINK_NODES}, shingles / {LINK_SHINGLES})) as int) parts")
    dealt = stage(found.join(sizes, "component").select("component", "node", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("own")), "dealt")
    rows = dealt.join(arrays_of(docs, dealt, k), "node").withColumn("block", F.xxhash64("component", "own"))
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "node")
    blocks = rows.mapInArrow(pack_blocks, BLOCKS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "own", "data")
    pairs = blocks.repartition(n, "pair").sortWithinPartitions("pair", "own")
    return pairs.mapInArrow(count_links(num, den), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def linked_sets(docs: DataFrame, key: Column, text: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, tkey (hash of the text), node and n of each row; and links (a, b: nodes) that give the components of all links."""
    spark = docs.sparkSession
    n, scratch = buckets(docs), Scratch(spark)
    texts = docs.select(key.cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey"), text)
    passed = stage(texts.mapInArrow(map_classes(k), CLASSES), "classes")
    classes = passed.where("slice is null").select("doc_id", "tkey", "node", "n")
    parts = passed.where("slice is not null").select("slice", "data").repartition(min(n, SLICES), "slice").mapInArrow(add_sketches, "slice int, data binary").collect()
    counts = np.zeros(SKETCH, np.uint8)
    for r in parts:
        counts[r["slice"] * SKETCH // SLICES :][: SKETCH // SLICES] = np.frombuffer(r["data"], np.uint8)
    sketch = spark.sparkContext.broadcast(counts)
    only_text = docs.where(key.isNotNull()).select(text)
    listed = scratch.stage(only_text.mapInArrow(map_listed(k, num, den, n, sketch), PACKED), "listed")
    tiles = scratch.stage(listed.where(f"kind = {LISTED}").repartition(n, "bucket").mapInArrow(make_tiles(num, den), TILES), "tiles")
    signed = listed.where(f"kind = {SIGNED}").select(F.expr("cast(conv(hex(substring(data, 1, 8)), 16, -10) as long)").alias("b"), F.expr("substring(data, 9)").alias("sig"))
    stars = tiles.where(f"kind = {STAR}").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("d").alias("d")).where("3 * c >= d")
    stars = scratch.stage(stars.selectExpr("b a", "a b"), "stars")
    first = scratch.stage(star_links(only_text, stars, k, num, den), "first-links")
    known = connected(first.selectExpr("a u", "b v")).selectExpr("id b", "component comp")
    listings = tiles.where(f"kind = {ROW}").join(known, "b", "left").select("a", "b", "c", "d", "side", F.coalesce("comp", "b").alias("comp"))
    sieved = scratch.stage(listings.repartition(n, "a").mapInArrow(sieve(num, den), SIEVED), "sieved")
    scratch.drop("tiles", "stars")
    pairs = sieved.where(f"kind = {TWO}").groupBy("a", "b").agg(F.max("c").alias("c"), F.max("d").alias("d"), F.max("comp").alias("least"), F.count("*").alias("shared")).where("shared >= least")
    two = pairs.selectExpr("inline(array(struct(xxhash64(a, b) as a, a as b, c, 0 as d, 0 as side, a as comp), struct(xxhash64(a, b) as a, b, d as c, 0 as d, 0 as side, b as comp)))")
    rows = sieved.where(f"kind = {ROW}").select("a", "b", "c", "d", "side", "comp").unionByName(two)
    rows = rows.join(signed.dropDuplicates(["b"]), "b").select("a", "b", "c", "d", "side", "comp", "sig").repartition(n, "a")
    screened = scratch.stage(rows.mapInArrow(screen_tiles(num, den), SIEVED).drop("kind"), "screened")
    scratch.drop("sieved", "listed")
    arrays = arrays_of(only_text, screened.selectExpr("b node"), k).withColumnRenamed("node", "b")
    rows = screened.join(arrays, "b").select("a", "b", "c", "d", "side", "comp", "data").repartition(n, "a").sortWithinPartitions("a")
    more = rows.mapInArrow(intersect_tiles(num, den), PAIRS)
    linked = stage(first.unionByName(more).distinct(), "all-links")
    scratch.drop("screened", "first-links")
    return classes, linked


def similar_groups(docs: DataFrame, key: Column, text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id (the key), tkey (a hash of the text) and group of each row: rows of one group are joined by links between their sets.

    Rows are told apart by key and text, so that two texts of one key are in one group only if they link.
    A row without words is a group with those of its own key and text alone. Null keys are left out.
    """
    classes, linked = linked_sets(docs, key, text, k, num, den)
    joined = connected(linked.selectExpr("a u", "b v")).selectExpr("id node", "component")
    rows = classes.where("doc_id is not null").join(joined, "node", "left")
    return rows.select("doc_id", "tkey", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.xxhash64("doc_id", "tkey")).alias("group"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, links: bool = True) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable over links) and, if links, n_links for each row.

    n_links counts the other sets that a row's set links with, each of them, in whatever component.

    Two rows link when den * intersection >= num * union of their sets of k-word shingles. Null and
    wordless texts have an empty set, link with nothing and are their own component, as are rows with a
    null key (their component is null). Rows that repeat a key or text are rows of their own; those
    that share a key are one document for links. An empty table gives an empty table. Tables that the
    result reads (classes, links) stay in the shared folder, the others are deleted on the way.
    """
    classes, linked = linked_sets(docs, F.col(key), text, k, num, den)
    only_text = docs.where(F.col(key).isNotNull()).select(text)
    nodes = classes.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    reps = nodes.select("node", "rep")
    by_rep = linked.join(reps.withColumnRenamed("node", "a"), "a").withColumnRenamed("rep", "u").join(reps.withColumnRenamed("node", "b"), "b").select("u", F.col("rep").alias("v"))
    joined = connected(by_rep).selectExpr("id rep", "component")
    found = nodes.join(joined, "rep", "left").select("node", "n", F.coalesce("component", "rep").alias("component"))
    if links:
        degree = linked.selectExpr("inline(array(struct(a as node), struct(b as node)))").groupBy("node").agg(F.count("*").alias("n_links"))
        found = stage(found.join(degree, "node", "left").select("node", "n", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")), "found")
        counted = all_links(only_text, found, k, num, den).withColumnRenamed("n_links", "counted")
        found = found.join(counted, "node", "left").withColumn("n_links", F.coalesce("counted", "n_links"))
    return classes.join(found.drop("n"), "node", "left").select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        *([F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")] if links else []),
    )
