"""Operator 8, suffix-array dedup: two-stage suffix sorting of the places that can repeat.

Removed is each byte in a string of LENGTH bytes that also starts elsewhere. The decision is a suffix
array's: of the suffixes of one group, sorted in two stages, neighbours with LENGTH bytes in common
repeat. A suffix array of all texts is too much for one task, so it is cut into groups that can hold
equal strings, and only what a group needs is sent to it:

1. The anchor of a string of LENGTH bytes is the leftmost GRAM-byte run with the smallest hash in it.
   Each start of a string has one anchor; the strings of an anchor are one stretch of bytes, its
   context. Equal strings have equal anchors, so anchors are dealt by hash, and those that occur once
   are done. Contexts that look equal (digests) are a class: the bytes of two of them are a group to
   sort, the others wait there for what the sort finds and take it over.
2. Anchors with several different contexts are looked at in PARTS parts, each with the strings that
   start in one stretch before the anchor. All strings of a part share a core, by which parts are dealt;
   a part whose core is nowhere else is done. The parts with one core are a group to sort, two of a
   class again standing for the others.
3. Groups are sorted as suffixes. First only suffixes smaller than their successors are sorted, then
   the rest are induced from them by a scan of the buckets of first bytes. Then the common prefixes of
   neighbours are computed.

So digests only say what is sent where; nothing is removed that the sort has not found. Hot keys: of a
class two are sent, however many there are; a core with more parts than BLOCK is dealt as pairs of blocks.
What goes from and to documents is packed by their buckets, so that rows do not grow with the matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprint_index import keyed, runs_of
from .shared import PACKED, PACKED_ARROW, buckets, delta, pack, packed_batches, scatter, stage, unpack
from .text import U, byte_values, mix, powers, ragged, sliding_min, text_slices

LENGTH, GRAM, PARTS = 200, 32, 6
#: Parts with one core that are sorted together; more are dealt as pairs of blocks.
BLOCK = 4096
#: Bytes that are sorted at once, if no core has more.
CHUNK = 900_000
#: Bytes of texts that are hashed at once.
SLICE = 1_000_000
#: Kinds of packed rows: anchors or parts to look up; bytes to send to a group; waiting for what a group finds; removed.
ASK, SHIP, MEMBER, COVER = range(4)
#: For each kind, what is packed for a document beside its key: (place, first and last start, known), (first start, last start, group, class, known), (start, group, class), (start, end).
COLUMNS = {ASK: ("i4", "i4", "i4", "?"), SHIP: ("i4", "i4", "u8", "u8", "u4", "?"), MEMBER: ("i4", "u8", "u8", "u4"), COVER: ("i4", "i4")}
FOUND = "doc_id long, tkey long, asked binary, shipped binary, waiting binary, covered binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), *((x, pa.binary()) for x in ("asked", "shipped", "waiting", "covered"))])


@lru_cache(4)
def tables(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and the powers of an odd base and of its inverse, up to n."""
    p = powers(n, seed)
    inverse = np.full(n, pow(int(p[1]), -1, 1 << 64), U)
    inverse[0] = 1
    return byte_values(seed), p, np.cumprod(inverse, dtype=U)


class Hasher:
    """Hashes of any span of some bytes by prefix sums."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        n = 1 << max(20, int(len(data) + 1).bit_length())
        values, p, self.inverse = tables(n, seed)
        self.sums = np.append(U(0), np.cumsum(values[data] * p[: len(data)], dtype=U))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    h, have = byte_values(21)[data], 1
    while have < GRAM:
        h = mix(h[: len(h) - have] * U(0xA24BAED4963EE407) + h[have:]) if have == GRAM // 2 else h[: len(h) - have] * U(0x9FB21C651E98DF25 + 2 * have) + h[have:]
        have *= 2
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of LENGTH bytes inside one row, and first and last start of each one's strings."""
    width = LENGTH - GRAM + 1
    n = np.diff(offsets)
    own = n >= LENGTH
    starts = ragged(offsets[:-1][own], n[own] - LENGTH + 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    least = sliding_min(h, width)  # of the string that starts here
    valid = np.zeros(len(least), bool)
    valid[starts] = True
    # a place is an anchor if a string around it has its hash as the least: the greatest of their least ones
    flipped = ~np.where(valid, least, U(0))
    padded = np.concatenate((np.full(width - 1, ~U(0)), flipped, np.full(width - 1, ~U(0))))
    at = np.flatnonzero(~sliding_min(padded, width)[: len(h)] == h)
    order = np.argsort(h[at], kind="stable")
    by_hash, place = h[at][order], at[order]
    number = np.cumsum(np.append(False, by_hash[1:] != by_hash[:-1]))
    sorted_ = (number << 40) + place

    def leftmost(i: np.ndarray) -> np.ndarray:
        return place[np.searchsorted(sorted_, (number[np.searchsorted(by_hash, least[i])] << 40) + i)]

    heads = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1] + 1) | (least[starts[1:]] != least[starts[:-1]])))
    first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    p = leftmost(first)
    several = leftmost(last) != p  # equal hashes in one stretch
    if several.any():
        i = ragged(first[several], (last - first + 1)[several])
        q = leftmost(i)
        heads = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)))
        p = np.concatenate((p[~several], q[heads]))
        first, last = np.concatenate((first[~several], i[heads])), np.concatenate((last[~several], i[np.append(heads[1:], len(i)) - 1]))
    return p, h[p], first, last


class Dealt:
    """Arrays for documents, by kind, packed by the documents' buckets."""

    def __init__(self, n_buckets: int) -> None:
        self.n_buckets, self.held = n_buckets, defaultdict(list)

    def put(self, kind: int, own: np.ndarray, tkey: np.ndarray, *columns: np.ndarray) -> None:
        if len(own):
            self.held[kind].append((own, tkey, *(c.astype(t) for c, t in zip(columns, COLUMNS[kind]))))

    def rows(self) -> Iterator[tuple]:
        for kind, held in self.held.items():
            columns = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            bucket = (mix(columns[0].view(U) ^ mix(columns[1].view(U))) % U(self.n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], [c[order] for c in columns]
            for lo, hi in runs_of(bucket[1:] != bucket[:-1], len(bucket)):
                yield int(bucket[lo]), kind, pack(delta(columns[0][lo:hi]), *(c[lo:hi] for c in columns[1:]))


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt rows of one partition to one row for each document."""

    def rows() -> Iterator[tuple]:
        held = defaultdict(list)
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own, *columns = unpack(data, "i8", "i8", *COLUMNS[kind])
                held[kind].append((np.cumsum(own), *columns))
        found: dict[tuple[int, int], list[bytes]] = defaultdict(lambda: [b""] * len(COLUMNS))
        for kind, parts in held.items():
            own, tkey, *columns = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((tkey, own))
            own, tkey, columns = own[order], tkey[order], [c[order] for c in columns]
            for lo, hi in runs_of((own[1:] != own[:-1]) | (tkey[1:] != tkey[:-1]), len(own)):
                found[int(own[lo]), int(tkey[lo])][kind] = pack(*(c[lo:hi] for c in columns))
        for key, columns in found.items():
            yield *key, *columns

    yield from packed_batches(rows(), FOUND_ARROW)


def of_rows(b: pa.RecordBatch, name: str, kind: int, lo: int, hi: int) -> list[np.ndarray]:
    """Of the batch's rows lo to hi - 1: the row of each entry of this kind, and its columns."""
    found = [unpack(x, *COLUMNS[kind]) if x else None for x in b.column(b.schema.get_field_index(name))[lo:hi].to_pylist()]
    row = np.repeat(np.arange(hi - lo), [len(x[0]) if x else 0 for x in found])
    return [row, *(np.concatenate([np.zeros(0, t), *(x[i] for x in found if x)]).astype(t) for i, t in enumerate(COLUMNS[kind]))]


def map_anchors(n_buckets: int):
    """(doc_id, tkey, text) to packed anchors by hash. Of a context that a batch has more than twice, the others are told to wait at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                ids, tkeys = b.column(0).to_numpy(), b.column(1).to_numpy()
                got = []
                for i, _, data, offsets in text_slices(b.column(2), SLICE):
                    at, h, first, last = anchors(data, offsets)
                    row = np.searchsorted(offsets, at, "right") - 1
                    shape = (at - first).astype(U) * U(1 << 20)
                    c1, c2 = (mix(Hasher(data, x)(first, last + LENGTH) + shape) for x in (31, 32))
                    got.append((h, c1, c2.astype(np.uint32), row + i, at - offsets[row], first - offsets[row], last - offsets[row]))
                if not got or not sum(len(x[0]) for x in got):
                    continue
                h, c1, c2, row, place, first, last = (np.concatenate(x) for x in zip(*got))
                own, tkey = ids[row], tkeys[row]
                order, _, group, head = grouped(h, c1, c2)
                later = nth(head)[np.argsort(order)] > 1
                out = Dealt(n_buckets)
                out.put(MEMBER, *(x[later] for x in (own, tkey, first, c1, c1, c2)))
                yield from out.rows()
                k = np.flatnonzero(~later)
                bucket = (h[k] % U(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, k = bucket[order], k[order]
                for lo, hi in runs_of(bucket[1:] != bucket[:-1], len(bucket)):
                    e = k[lo:hi]
                    yield int(bucket[lo]), ASK, pack(h[e], c1[e], c2[e], delta(own[e]), delta(tkey[e]), place[e].astype(np.int32), (place[e] - first[e]).astype(np.uint8), (last[e] - first[e]).astype(np.uint8))

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def nth(head: np.ndarray) -> np.ndarray:
    """Number of each entry in its group, from 0; head: where groups begin."""
    at = np.arange(len(head))
    return at - np.maximum.accumulate(np.where(head, at, 0))


def grouped(key: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple:
    """An order by key and digest, and in this order: group of the key, of the digest, and heads of both."""
    order = np.lexsort((c2, c1, key))
    k, a, b = key[order], c1[order], c2[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return order, np.cumsum(new_key) - 1, np.cumsum(new) - 1, new


def match_contexts(n_buckets: int):
    """Anchors of one partition to what their documents are asked for: bytes of two contexts of a class, and parts of those that share an anchor only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = []
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if row[1] == ASK:
                        held.append(unpack(row[2], "u8", "u8", "u4", "i8", "i8", "i4", "u1", "u1"))
                    else:
                        yield row
            if not held:
                return
            h, c1, c2, place, back, span = (np.concatenate([x[c] for x in held]) for c in (0, 1, 2, 5, 6, 7))
            own, tkey = (np.concatenate([np.cumsum(x[c]) for x in held]) for c in (3, 4))
            held.clear()
            first = place - back
            last = first + span
            order, key, group, head = grouped(h, c1, c2)
            number, several = nth(head), (np.bincount(group) > 1)[group]
            out = Dealt(n_buckets)
            k = order[several & (number < 2)]
            out.put(SHIP, *(x[k] for x in (own, tkey, first, last, c1, c1, c2)), np.zeros(len(k), bool))
            k = order[several & (number > 1)]
            out.put(MEMBER, *(x[k] for x in (own, tkey, first, c1, c1, c2)))
            keep = head & (np.bincount(key[head]) > 1)[key]
            k = order[keep]
            out.put(ASK, *(x[k] for x in (own, tkey, place, first, last)), several[keep])
            yield from out.rows()

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def spans(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
    """Of anchors and the first and last start of their strings, the parts: (anchor, part, first start, last start, core's start, core's end)."""
    step = -(-(LENGTH - GRAM + 1) // PARTS)
    a = np.repeat(np.arange(len(at)), PARTS)
    j = np.tile(np.arange(PARTS), len(at))
    p = at[a]
    far, near = np.minimum(step * (j + 1) - 1, LENGTH - GRAM), step * j  # how far before the anchor strings start
    lo, hi = np.maximum(p - far, first[a]), np.minimum(p - near, last[a])
    ok = lo <= hi
    return tuple(x[ok] for x in (a, j, lo, hi, p - near, p - far + LENGTH))


def map_parts(n_buckets: int):
    """(doc_id, tkey, text, asked) to packed parts of the anchors asked for, by core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                ids, tkeys = b.column(0).to_numpy(), b.column(1).to_numpy()
                made = []
                for i, j, data, offsets in text_slices(b.column(2), SLICE):
                    row, at, first, last, known = of_rows(b, "asked", ASK, i, j)
                    if not len(row):
                        continue
                    a, part, lo, hi, core_lo, core_hi = spans(at, first, last)
                    base = offsets[row[a]]
                    core = mix(Hasher(data, 33)(base + core_lo, base + core_hi) + part.astype(U))
                    shape = (hi - lo).astype(U) * U(1 << 20) + (core_lo - lo).astype(U)
                    c1, c2 = (mix(Hasher(data, x)(base + lo, base + hi + LENGTH) + shape) for x in (31, 32))
                    made.append((core, c1, c2.astype(np.uint32), known[a], row[a] + i, lo, hi))
                if not made:
                    continue
                core, c1, c2, known, row, lo, hi = (np.concatenate(x) for x in zip(*made))
                bucket = (core % U(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                for x, y in runs_of(bucket[1:] != bucket[:-1], len(bucket)):
                    k = order[x:y]
                    yield int(bucket[x]), ASK, pack(core[k], c1[k], c2[k], known[k], delta(ids[row[k]]), delta(tkeys[row[k]]), lo[k].astype(np.int32), (hi - lo)[k].astype(np.uint8))

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def match_parts(n_buckets: int):
    """Parts of one partition to the bytes asked for: all that differ of a core that several have, two of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = [unpack(x, "u8", "u8", "u4", "?", "i8", "i8", "i4", "u1") for b in batches for x in b.column(2).to_pylist()]
            if not held:
                return
            core, c1, c2, known, lo, span = (np.concatenate([x[c] for x in held]) for c in (0, 1, 2, 3, 6, 7))
            own, tkey = (np.concatenate([np.cumsum(x[c]) for x in held]) for c in (4, 5))
            held.clear()
            hi = lo + span
            order, key, group, head = grouped(core, c1, c2)
            number, sure = nth(head), known[order]
            # classes in which a part is not known to repeat, and cores with different parts
            open_ = ((np.bincount(group) > 1) & (np.bincount(group, ~sure) > 0))[group]
            differ = (np.bincount(key[head]) > 1)[key]
            ship, wait = (differ & head) | (open_ & (number < 2)), open_ & (number > 1) & ~sure
            out = Dealt(n_buckets)
            blocks = -(-np.bincount(key, ship) // (BLOCK // 2)).astype(np.int64)
            blocks = np.where(np.bincount(key, ship) > BLOCK, blocks, 1)[key]
            mine = group % blocks
            to = core[order]
            to = np.where(blocks > 1, mix(to + (mine * 1_000_003 + mine + 1).astype(U)), to)
            for kind, these in ((SHIP, ship), (MEMBER, wait)):
                k = order[these]
                out.put(kind, own[k], tkey[k], lo[k], *([hi[k]] if kind == SHIP else []), to[these], c1[k], c2[k], *([sure[these]] if kind == SHIP else []))
            for k in np.unique(key[blocks > 1]).tolist():  # different blocks of a core
                these = np.flatnonzero((key == k) & ship & head)
                e = order[these]
                for other in range(int(blocks[these[0]])):
                    x = mine[these] != other
                    low, high = np.minimum(mine[these], other)[x], np.maximum(mine[these], other)[x]
                    pair = mix(core[e[x]] + (low * 1_000_003 + high + 1).astype(U))
                    out.put(SHIP, own[e[x]], tkey[e[x]], lo[e[x]], hi[e[x]], pair, c1[e[x]], c2[e[x]], sure[these][x])
            yield from out.rows()

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


#: Before a string's bytes: group, class (two numbers), doc_id, tkey, start, length, known.
HEAD = 8


def map_strings(n_buckets: int):
    """(doc_id, tkey, text, shipped, waiting) to the bytes asked for, and what waits for them, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                ids, tkeys = b.column(0).to_numpy(), b.column(1).to_numpy()
                row, lo, key, c1, c2 = of_rows(b, "waiting", MEMBER, 0, b.num_rows)
                if len(row):
                    yield from scatter((key % U(n_buckets)).astype(np.int32), MEMBER, ids[row], tkeys[row], lo, key, c1, c2)
                waiting: dict[int, list[bytes]] = defaultdict(list)
                for i, j, data, offsets in text_slices(b.column(2), SLICE):
                    row, lo, hi, key, c1, c2, sure = of_rows(b, "shipped", SHIP, i, j)
                    if not len(row):
                        continue
                    buffer, n, base = data.tobytes(), hi - lo + LENGTH, offsets[row] + lo
                    heads = np.stack([x.astype(np.int64) if x.dtype != U else x.view(np.int64) for x in (key, c1, c2, ids[row + i], tkeys[row + i], lo, n, sure)], axis=1).tobytes()
                    for q, (k, p, m) in enumerate(zip((key % U(n_buckets)).tolist(), base.tolist(), n.tolist())):
                        waiting[k].append(heads[8 * HEAD * q : 8 * HEAD * (q + 1)] + buffer[p : p + m])
                for k, entries in waiting.items():
                    yield k, SHIP, b"".join(entries)

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


def suffix_array(data: np.ndarray, group: np.ndarray, depth: int, last: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places ordered by group, then by at least depth bytes from there. data: 0 ends a string; group: by place.

    Only the places of each string up to last are needed; those up to the next smaller suffix, from
    which they are induced, come with them.

    Two-stage sorting: suffixes smaller than their successors are sorted directly, by words of eight
    bytes after what a whole tie has in common; the rest follow from a scan of the buckets by first byte.
    """
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    change = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(change[::-1])[::-1]] > 0  # smaller than its successor
    small[data == 0] = True
    ends = np.flatnonzero(small)
    ends = ends[np.searchsorted(ends, last)]
    need = np.zeros(n + 1, np.int8)
    need[begins] = 1
    np.add.at(need, ends + 1, -1)
    need = np.cumsum(need[:n], dtype=np.int8) > 0
    padded = np.append(data, np.zeros(depth + 16, np.uint8))
    hasher = Hasher(padded, 35)

    def word(at: np.ndarray) -> np.ndarray:
        return padded[at[:, None] + np.arange(8)].view(">u8").ravel().astype(U)

    def same(tie: np.ndarray, at: np.ndarray, done: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Of each tie, whether the next width bytes are equal."""
        h = hasher(at + done, np.minimum(at + done + width, len(padded)))
        heads = np.flatnonzero(np.append(True, tie[1:] != tie[:-1]))
        return np.minimum.reduceat(h, heads) == np.maximum.reduceat(h, heads)

    at = np.flatnonzero(small & need)
    at = at[np.lexsort((word(at), group[at]))]
    w = word(at)
    new = np.append(True, (w[1:] != w[:-1]) | (group[at][1:] != group[at][:-1])) if len(at) else np.zeros(0, bool)
    done = np.full(len(at), 8)
    while True:
        tie = np.cumsum(new) - 1
        size = np.bincount(tie, minlength=1) if len(tie) else np.zeros(1, int)
        live = np.flatnonzero((size[tie] > 1) & (done < depth)) if len(tie) else tie
        if not len(live):
            break
        p, t, d = at[live], tie[live], done[live]
        t = np.cumsum(np.append(False, t[1:] != t[:-1]))
        for width in (depth, 64, 32, 16):
            d = np.where(same(t, p, d, np.minimum(width, depth - d))[t], np.minimum(d + width, depth), d)
        w = word(p + d)
        order = np.lexsort((w, t))
        p, w, d, t = p[order], w[order], d[order], t[order]
        split = np.append(True, (t[1:] != t[:-1]) | ((w[1:] != w[:-1]) & (d[1:] < depth)))
        at[live], done[live] = p, np.minimum(d + 8, depth)
        new[live] |= split
    # scan: a bucket's larger suffixes by the rank of their successors, then its smaller ones
    rank = np.zeros(n, np.int64)
    by_byte = np.flatnonzero(need & ~small)
    by_byte = by_byte[np.argsort(data[by_byte], kind="stable")]
    bounds = np.searchsorted(data[by_byte], np.arange(257))
    small_by_byte = at[np.argsort(data[at], kind="stable")]
    small_bounds = np.searchsorted(data[small_by_byte], np.arange(257))
    next_ = np.minimum(np.arange(n) + 1, n - 1)
    run = next_of_run(data)
    count = 0
    for c in range(256):
        big = by_byte[bounds[c] : bounds[c + 1]]
        if len(big):
            turns = run[big]
            order = np.argsort(turns, kind="stable")
            big, turns = big[order], turns[order]
            for lo, hi in runs_of(turns[1:] != turns[:-1], len(turns)):
                b = big[lo:hi]
                b = b[np.argsort(rank[next_[b]], kind="stable")]
                rank[b] = count + np.arange(len(b))
                count += len(b)
        s = small_by_byte[small_bounds[c] : small_bounds[c + 1]]
        rank[s] = count + np.arange(len(s))
        count += len(s)
    out = np.flatnonzero(need)
    return out[np.lexsort((rank[out], group[out]))]


def next_of_run(data: np.ndarray) -> np.ndarray:
    """How many equal bytes follow from each place, itself included."""
    n = len(data)
    ends = np.full(n, n - 1)
    ends[:-1] = np.where(data[1:] != data[:-1], np.arange(n - 1), n - 1)
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n) + 1


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Of each place but the first, how many bytes it has in common with the one before it, depth at most."""
    one, two = sa[:-1], sa[1:]
    out = np.full(len(two), depth)
    for seed in (36, 37):
        hasher = Hasher(data, seed)
        out[hasher(one, one + depth) != hasher(two, two + depth)] = 0
    left = np.flatnonzero(out == 0)
    one, two, have = one[left], two[left], np.zeros(len(left), np.int64)
    width = 1 << (depth - 1).bit_length() - 1
    while width:
        fits = have + width < depth
        have += np.where(fits & (hasher(one + have, one + have + width * fits) == hasher(two + have, two + have + width * fits)), width, 0)
        width //= 2
    out[left] = have
    return out


def repeated(data: np.ndarray, sizes: np.ndarray, key: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it), in order, of places whose depth bytes also start in another place of a string of the same key.

    data: the strings one behind the other; no two of them share a place of a text.
    """
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    text = np.zeros(len(data) + len(sizes), np.uint8)
    begins = ends - sizes + np.arange(len(sizes))
    inside = np.ones(len(text), bool)
    inside[begins + sizes] = False
    text[inside] = data + 1  # no byte of UTF-8 is 255
    sa = suffix_array(text, key[owner], depth, begins + sizes - depth, begins)
    sa = sa[sa <= (begins + sizes - depth)[owner[sa]]]
    if not len(sa):
        return sa, sa
    group = key[owner[sa]]
    same = (group[1:] == group[:-1]) & (common_prefixes(text, sa, depth) >= depth)
    found = np.sort(sa[np.append(False, same) | np.append(same, False)])
    return owner[found], found - begins[owner[found]]


def sort_suffixes(n_buckets: int):
    """Strings of one partition, by group, to the spans that repeat, in their documents and in those that wait for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            heads, strings, members = [], [], []
            for b in batches:
                for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if kind == MEMBER:
                        members.append(unpack(data, "i8", "i8", *COLUMNS[MEMBER]))
                        continue
                    at = 0
                    while at < len(data):
                        h = np.frombuffer(data, np.int64, HEAD, at)
                        at += 8 * HEAD
                        heads.append(h)
                        strings.append(data[at : at + int(h[6])])
                        at += int(h[6])
            if not heads:
                return
            heads = np.stack(heads)
            order = np.argsort(heads[:, 0], kind="stable")
            heads = heads[order]
            key, c1, c2, own, tkey, start, n, sure = heads.T
            sizes = np.cumsum(n)
            cuts = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            found, lo = [], 0
            while lo < len(order):  # whole keys, about CHUNK bytes of them
                before = sizes[lo - 1] if lo else 0
                next_ = int(np.searchsorted(cuts, lo, "right"))
                hi = int(cuts[max(next_, int(np.searchsorted(sizes[cuts - 1], before + CHUNK, "right")) - 1)])
                joined = np.frombuffer(b"".join([strings[k] for k in order[lo:hi].tolist()]), np.uint8)
                which, place = repeated(joined, n[lo:hi], key[lo:hi])
                if len(which):  # runs of places are spans
                    new = np.append(True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1))
                    found.append((which[new] + lo, place[new], place[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)] + LENGTH))
                lo = hi
            if not found:
                return
            which, first, end = (np.concatenate(x) for x in zip(*found))
            out = Dealt(n_buckets)
            open_ = sure[which] == 0
            w = which[open_]
            out.put(COVER, own[w], tkey[w], start[w] + first[open_], start[w] + end[open_])
            if members:
                m_own, m_tkey, m_start, m_key, m1, m2 = (np.concatenate(x) for x in zip(*members))
                name = lambda k, x, y: mix(k.view(U) ^ mix(x.view(U) + y.astype(U)))
                names = name(key.copy(), c1.copy(), c2)
                by_name = np.argsort(names, kind="stable")
                asked = name(m_key, m1, m2)
                q = np.searchsorted(names[by_name], asked)
                q = by_name[np.minimum(q, len(by_name) - 1)]  # the class's first string
                hit = names[q] == asked
                q, m_own, m_tkey, m_start = q[hit], m_own[hit], m_tkey[hit], m_start[hit]
                a, b = np.searchsorted(which, q), np.searchsorted(which, q, "right")
                e, m = ragged(a, b - a), np.repeat(np.arange(len(q)), b - a)
                out.put(COVER, m_own[m], m_tkey[m], m_start[m] + first[e], m_start[m] + end[e])
            yield from out.rows()

        yield from packed_batches(rows(), PACKED_ARROW)

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, found = b.column(1), b.column(2).to_pylist()
        kept, sizes, gone, starts, ends = [], [], [], [], []
        for d in range(b.num_rows):
            text = texts[d].as_buffer().to_pybytes()
            s, e = (x.astype(np.int64) for x in unpack(found[d], *COLUMNS[COVER])) if found[d] else (np.zeros(0, np.int64),) * 2
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order]) if len(s) else e
            new = np.append(True, s[1:] > e[:-1]) if len(s) else np.zeros(0, bool)
            s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)] if len(s) else e
            kept.append(b"".join([text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)])]))
            sizes.append(len(text))
            gone.append(int((e - s).sum()))
            starts.append(s)
            ends.append(e)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], schema=OUT)


def dedup_suffixes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept (bytes left, which need not be UTF-8), n_bytes, n_removed, starts and ends of the removed spans.

    Texts are judged on the input, whole, as UTF-8 bytes; overlapping and touching spans are one. A null
    text is empty, texts under LENGTH bytes stay whole. Rows that repeat a key, or a whole text, are rows
    of their own: their strings also start elsewhere. A row with a null key is compared with the others as
    well, under the key -2^63, and returned with a null key. An empty table gives an empty table.
    """
    n = buckets(docs)
    rows = keyed(docs, key, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    held = rows.repartition(n, "doc_id", "tkey")

    def gather(packed: DataFrame) -> DataFrame:
        return packed.repartition(n, "bucket").mapInArrow(by_document, FOUND).hint("shuffle_hash")

    def deal(of: DataFrame, step) -> DataFrame:
        return of.mapInArrow(step(n), PACKED)

    first = stage(deal(deal(rows, map_anchors).repartition(n, "bucket"), match_contexts), "contexts")
    asked = held.join(gather(first.where(f"kind = {ASK}")), ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "asked")
    second = deal(deal(asked, map_parts).repartition(n, "bucket"), match_parts)
    asked = held.join(gather(first.where(f"kind <> {ASK}").unionByName(second)), ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "shipped", "waiting")
    third = deal(deal(asked, map_strings).repartition(n, "bucket"), sort_suffixes)
    joined = held.join(gather(third), ["doc_id", "tkey"], "left").select("doc_id", "text", "covered")
    out = joined.mapInArrow(cut_spans, "doc_id long, kept binary, n_bytes long, n_removed long, starts array<bigint>, ends array<bigint>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
