"""Operator 11, source divergence audit: K-squared quadtrees over the group-term count matrix.

Each language has a matrix of counts, a row for each source and a column for each kept term. Columns
are dealt into blocks of bounded size. In a block the matrix is a K-squared tree: quadrants are cut in
four until they are leaves, and one without a count is cut no further. To compare sources, pairs of
quadrants go down the tree together. Where both are zero, the difference of the two rows' shares is
the same in every column and is priced by the quadrant's width, for all rows at once; the cells of
leaves are looked at only if one of the two has a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .text import text_slices

#: A share is a count with SMOOTHING added, in parts of UNIT.
UNIT, SMOOTHING = 1_000_000_000, 5
#: Bytes of terms: ASCII letters, which are lowered, and whatever is not ASCII.
IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Rows that a task holds before it gives them out.
HELD = 500_000
#: Cells of a leaf, and how often a tile is cut in four on the way to its leaves.
LEAF_ROWS, LEAF_COLS, DEPTH = 4, 16, 6
TILE_ROWS, TILE_COLS = LEAF_ROWS << DEPTH, LEAF_COLS << DEPTH
#: Cells of a block at most, as planned; a block has fewer columns the more sources a language has.
BLOCK_CELLS = 1 << 22
#: Leaves that are compared at once.
AT_ONCE = 4096
COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, a int, b int, value long"


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, last row + 1, each term's row, its number, all terms by number) for runs of texts."""
    for lo, hi, data, offsets in text_slices(column):
        inside = IN_TERM[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        cuts = offsets[1:-1][offsets[1:-1] < len(data)]
        start[cuts] = inside[cuts]
        starts = np.flatnonzero(start)
        ends = np.append(0, np.cumsum(inside))  # places in the bytes of terms alone
        bounds = np.append(ends[starts], ends[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]]))])
        coded = words.dictionary_encode()
        yield lo, hi, np.searchsorted(offsets, starts, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to COUNTS: occurrences and documents of each term in each group, and a row with a null term for each group."""
    held: list[pa.Table] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            held.clear()
            yield from t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=100_000)

    for batch in batches:
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        wide = max(len(source.dictionary), 1)
        group, of_row = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
        names = [lang.dictionary.take(pa.array(group // wide)), source.dictionary.take(pa.array(group % wide))]
        none = pa.array(np.zeros(len(group), np.int64))
        held.append(pa.table([*names, pa.nulls(len(group), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"]))
        for lo, hi, row, code, terms in terms_of(batch.column(2)):
            if len(code):
                in_row, n = np.unique(row * len(terms) + code, return_counts=True)  # each term of each document
                key = of_row[lo:hi][in_row // len(terms)] * len(terms) + in_row % len(terms)
                key, at, docs = np.unique(key, return_inverse=True, return_counts=True)
                total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
                g = pa.array(key // len(terms))
                held.append(pa.table([names[0].take(g), names[1].take(g), terms.take(pa.array(key % len(terms))), pa.array(total), pa.array(docs)], names=["lang", "source", "term", "n", "docs"]))
            if sum(t.num_rows for t in held) > HELD:
                yield from out()
    yield from out()


class K2Tree:
    """A matrix of counts, of which only nonzero quadrants are kept: level 0 are leaves, level DEPTH tiles.

    row, col: the cells that have a count; value: their shares; base: the share of each row where it has none.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, base: np.ndarray, n_cols: int) -> None:
        self.base, self.n_rows, self.n_cols = base, len(base), n_cols
        self.tile_rows, self.tile_cols = -(-self.n_rows // TILE_ROWS), max(-(-n_cols // TILE_COLS), 1)
        r, c = row // LEAF_ROWS, col // LEAF_COLS
        self.levels = [np.unique((r >> k) << 32 | (c >> k)) for k in range(DEPTH + 1)]
        padded = np.zeros(self.tile_rows * TILE_ROWS, np.int64)
        padded[: self.n_rows] = base
        bands = padded.reshape(-1, LEAF_ROWS)
        self.zero = len(self.levels[0])  # a zero leaf of band i is leaf zero + i
        self.leaves = np.repeat(bands[np.append(self.levels[0] >> 32, np.arange(len(bands)))][:, :, None], LEAF_COLS, axis=2)
        self.leaves[self.find(0, r, c), row % LEAF_ROWS, col % LEAF_COLS] = value

    def find(self, level: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Number of each quadrant among those of a level that are not zero, or -1."""
        have, key = self.levels[level], r << 32 | c
        if not len(have):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(have, key), len(have) - 1)
        return np.where(have[at] == key, at, -1)

    def tile_sums(self, i: int, j: int) -> np.ndarray:
        """Sums of the differences of each row of row tile i from each row of row tile j, over all columns."""
        n = 1 << DEPTH
        widths = np.zeros((n, n), np.int64)  # columns, by pairs of bands, in which both are zero quadrants
        sums = np.zeros((n, LEAF_ROWS, n, LEAF_ROWS), np.int64)
        c = np.arange(self.tile_cols)
        a, b = np.full(len(c), i), np.full(len(c), j)
        for level in range(DEPTH, -1, -1):
            x, y = self.find(level, a, c), self.find(level, b, c)
            zero = (x < 0) & (y < 0)
            size = n >> level  # bands of this level in a tile
            priced = np.zeros((size, size), np.int64)
            np.add.at(priced, (a[zero] - i * size, b[zero] - j * size), LEAF_COLS << level)
            widths += np.repeat(np.repeat(priced, 1 << level, 0), 1 << level, 1)
            a, b, c, x, y = (v[~zero] for v in (a, b, c, x, y))
            if level:
                bit = np.arange(8)
                a, b, c = ((2 * v[:, None] + (bit >> k & 1)).ravel() for k, v in enumerate((a, b, c)))
                if i == j:  # of the pairs of a tile with itself those below the diagonal are the others turned
                    a, b, c = (v[a <= b] for v in (a, b, c))
        x, y = np.where(x < 0, self.zero + a, x), np.where(y < 0, self.zero + b, y)
        for at in range(0, len(a), AT_ONCE):
            s = slice(at, at + AT_ONCE)
            apart = np.abs(self.leaves[x[s]][:, :, None, :] - self.leaves[y[s]][:, None, :, :]).sum(-1)
            np.add.at(sums, (a[s] - i * n, slice(None), b[s] - j * n, slice(None)), apart)
        wide = np.repeat(np.repeat(widths, LEAF_ROWS, 0), LEAF_ROWS, 1) - (self.tile_cols * TILE_COLS - self.n_cols)  # no columns stand behind the last
        base = np.zeros((2, TILE_ROWS), np.int64)
        for half, t in zip(base, (i, j)):
            own = self.base[t * TILE_ROWS : (t + 1) * TILE_ROWS]
            half[: len(own)] = own
        return sums.reshape(TILE_ROWS, TILE_ROWS) + wide * np.abs(base[0][:, None] - base[1][None, :])


def block_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of one block's rows (lang, block, row, col, share): a row with a null col for each source, with its share where it has no count, and the cells. Given out by pairs of tiles."""
    table = pa.Table.from_batches(list(batches))
    row, share = table["row"].to_numpy().astype(np.int64), table["share"].to_numpy()
    cell = pc.is_valid(table["col"]).to_numpy()
    col = pc.fill_null(table["col"], 0).to_numpy()[cell].astype(np.int64)
    base = np.zeros(int((~cell).sum()), np.int64)
    base[row[~cell]] = share[~cell]
    tree = K2Tree(row[cell], col, share[cell], base, int(col.max()) + 1 if len(col) else 0)
    for i in range(tree.tile_rows):
        for j in range(i, tree.tile_rows):
            sums = tree.tile_sums(i, j)
            a, b = np.nonzero(np.ones_like(sums, bool) if i < j else np.triu(np.ones_like(sums, bool), 1))
            real = (i * TILE_ROWS + a < len(base)) & (j * TILE_ROWS + b < len(base))
            a, b = a[real], b[real]
            yield pa.record_batch([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(i * TILE_ROWS + a, pa.int32()), pa.array(j * TILE_ROWS + b, pa.int32()), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])


def share(count: str, total: str, terms: str) -> Column:
    """1 and the whole part of UNIT times a smoothed count over its smoothed total; exact for all longs."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + {SMOOTHING} as decimal(20,0))) div cast({total} + {SMOOTHING} * {terms} as decimal(20,0))")


def matrix(docs: DataFrame, scratch: Scratch, least_docs: int, lang: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, row, total, terms, in_all, blocks) and the cells of kept terms (lang, source, term, n, in_lang, block, col), both staged."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    counted = docs.select(*(c.alias(n) for c, n in zip(blank, ("lang", "source", "text")))).mapInArrow(count_terms, COUNTS)
    counts = scratch.stage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    found = counts.where("term is not null")
    by_term = found.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = scratch.stage(by_term.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    sources = counts.where("term is null").select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("row"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("in_all")), "lang", "left").na.fill(0)
    columns = F.greatest(F.lit(LEAF_COLS), F.least(F.lit(TILE_COLS), F.expr(f"cast({BLOCK_CELLS} div sources as int)")))
    langs = scratch.stage(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / columns).cast("int"))), "langs")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "term", "in_lang", block.alias("block"))
    col = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("in_lang"), "term")) - 1  # rare terms side by side, where zeros are
    cells = scratch.stage(found.join(placed.withColumn("col", col), ["lang", "term"]).select("lang", "source", "term", "n", "in_lang", "block", "col"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = scratch.stage(sources.join(totals, ["lang", "source"], "left").join(langs.drop("sources"), "lang").na.fill(0), "groups")
    return groups, cells


def pair_divergences(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang), value: the sum over all kept terms of the differences of their shares."""
    own = cells.join(groups.select("lang", "source", "row", "total", "terms"), ["lang", "source"])
    own = own.select("lang", "block", "row", "col", share("n", "total", "terms").alias("share"))
    unseen = F.when(F.col("terms") > 0, share("0L", "total", "greatest(terms, 1)")).otherwise(0)
    rows = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", F.lit(None).cast("int").alias("col"), unseen.alias("share"))
    sums = own.unionByName(rows).groupBy("lang", "block").applyInArrow(block_sums, SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair")).select("lang", "value", "pair.*")
    name = lambda at, as_: groups.select("lang", F.col("row").alias(at), F.col("source").alias(as_))
    return both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def term_excess(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (each term the group has), value: by how much its share in the group exceeds that in the lang."""
    own = cells.join(groups.select("lang", "source", "total", "terms", "in_all"), ["lang", "source"])
    over = share("n", "total", "terms") - share("in_lang", "in_all", "terms")
    return own.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """How sources of a language differ: lang, source, part ('pair' or 'term'), item, value, rank.

    Null texts, languages and sources are ''. Rows that repeat count each. A group without terms is
    compared like any other; in a language without kept terms all sums are 0, and a source that is the
    only one of its language has no pairs. Ties are ranked by item in UTF-8 order. Other columns are not
    read. Counts are added up in each task before they are shuffled; a block of the matrix holds
    about BLOCK_CELLS cells, whatever the number of sources, and a task one block. The staged counts are
    deleted but for groups and cells, which the result reads.
    """
    scratch = Scratch(docs.sparkSession)
    groups, cells = matrix(docs, scratch, least_docs, lang, source, text)
    scratch.drop("counts", "kept", "langs")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pair_divergences(groups, cells), "pair").unionByName(ranked(term_excess(groups, cells), "term").where(F.col("rank") <= top))
