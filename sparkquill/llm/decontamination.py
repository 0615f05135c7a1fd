"""Operator 1, benchmark decontamination by template canonicalisation.

Words become a template: a number, in digits or as a word, is <num>, a unit after a number or a currency sign before it <unit>
(also without a space between them), a run of capitalised words inside a sentence <name>; the rest are
lower-cased and stripped of punctuation. A second form takes capitalised words at the start of a sentence
for names too, and a third has no placeholders, so that word-for-word copies are always found. Windows of
template words are hash-joined with those of the benchmark. Hits of one item at one place of a text, on
one diagonal or on some near each other, are judged together: they must cover enough of the item, and the
slots, what stands behind the placeholders, must map consistently: one value of the item to one value of the text,
and one name of the text back to one name of the item. So an item counts as leaked also where its numbers,
names or units were changed, but not where a template merely looks alike. A template says nothing if it has
few words of its own: an item with fewer than LITERALS words that are no placeholders is found word for word only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, without
from .text import SEPARATOR, U, grams, mix, ragged, span_hashes, text_slices, word_spans

WINDOW = 8
#: Share of an item's template windows that must be found at one place.
COVER = 0.6
#: So many words that are no placeholders must an item have to be looked for as a template, and so many must be in what was found.
LITERALS = 6
#: Diagonals so near each other are one place of the text.
SHIFT = 4
#: Benchmark windows (of each form) that one broadcast block holds; more items make more blocks, each joined with all texts.
BLOCK_WINDOWS = 2_000_000

#: Words that are units after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years w kw mw v kv a ma hz khz mhz ghz j kj cal kcal pa kpa bar k c f % $ € £ ¥ eur usd gbp euro euros dollar dollars cent cents percent degree degrees meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres kb mb gb tb".split()

#: Words that are numbers, in the languages of the corpus, but for those that are common words of another of them (once, seize, elf, cent, mil, mille).
NUMBER_WORDS = """one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze vingt trente quarante cinquante soixante
zwei drei vier sechs sieben acht neun zehn dreizehn vierzehn zwanzig dreissig vierzig hundert tausend""".split()

NUM, UNIT, NAME = (mix(np.array([n], U))[0] for n in (101, 102, 103))
#: Forms of a text: capitalised words at the start of a sentence are literals, or names as others; no placeholders at all.
STRICT, LOOSE, VERBATIM = FORMS = range(3)
LITERAL, SLOT_NUM, SLOT_UNIT, SLOT_NAME = 0, 1, 2, 3
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("item_windows", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_slots", pa.int64()), ("n_changed", pa.int64())])
HIT_DDL = "doc_id long, item_id long, n_windows long, item_windows long, first_word long, last_word long, n_slots long, n_changed long"

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Bytes that numbers are made of.
_PLAIN = _DIGIT.copy()
_PLAIN[[ord(c) for c in ".,-/:"]] = True
#: ASCII bytes that are no letters or digits, without % and $, which are units.
_PUNCT = np.array([32 < b < 128 and not chr(b).isalnum() and chr(b) not in "%$" for b in range(256)])
#: Bytes before a word that starts a sentence or a line, and bytes that end a word before one.
_OPENS = _PUNCT.copy()
_OPENS[10] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;|\"("]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals of UTF-8 in lower case."""
    out = _LOWER[data].astype(np.uint8)
    second = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[second] += 0x20
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    joined = " ".join(words).encode()
    data = np.frombuffer(joined, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(span_hashes(data, starts, ends, 3))


_UNITS, _NUMBERS = word_hashes(UNITS), word_hashes(NUMBER_WORDS)


def parted(data: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words that are a number with a currency sign before it or something behind it, cut into those: starts, ends, word of each, whether it is such a sign."""
    word = np.arange(len(starts))
    digit_at = np.append(0, np.cumsum(_DIGIT[data]))
    plain_at = np.append(0, np.cumsum(_PLAIN[data]))
    c = np.flatnonzero((digit_at[ends] > digit_at[starts]) & (plain_at[ends] - plain_at[starts] < ends - starts))
    s, e, last = starts[c], ends[c], len(data) - 1
    b0, b1, b2 = data[s], data[np.minimum(s + 1, last)], data[np.minimum(s + 2, last)]
    lead = np.where(b0 == 36, 1, np.where((b0 == 0xE2) & (b1 == 0x82) & (b2 == 0xAC), 3, np.where((b0 == 0xC2) & ((b1 == 0xA3) | (b1 == 0xA5)), 2, 0)))
    b = s + lead
    good = (b < e) & _DIGIT[data[np.minimum(b, last)]]
    c, s, e, lead, b = c[good], s[good], e[good], lead[good], b[good]
    if not len(c):
        return starts, ends, word, np.zeros(len(starts), bool)
    other = np.append(np.flatnonzero(~_PLAIN[data]), len(data))
    tail = np.minimum(other[np.searchsorted(other, b)], e)
    number = tail.copy()
    for _ in range(2):  # a hyphen or stop between number and unit
        number -= (number - 1 > b) & ~_DIGIT[data[number - 1]]
    n = np.ones(len(starts), np.int64)
    n[c] = 1 + (lead > 0) + (tail < e)
    word = np.repeat(word, n)
    p = (np.cumsum(n) - n)[c]
    new_s, new_e, sign = starts[word], ends[word], np.zeros(len(word), bool)
    sign[p] = lead > 0
    new_e[p] = np.where(lead > 0, b, number)
    q = p[lead > 0] + 1
    new_s[q], new_e[q] = b[lead > 0], number[lead > 0]
    q = (p + (lead > 0) + 1)[tail < e]
    new_s[q], new_e[q] = tail[tail < e], e[tail < e]
    return new_s, new_e, word, sign


class Words:
    """The words of some rows that have a letter or digit: hash of each one's own text, row, and what it can stand for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = lowered(data)
        starts, ends, rows = word_spans(data, offsets)
        full = ends.copy()
        for _ in range(4):  # punctuation at both ends, as many as four deep
            more = (starts < ends - 1) & _PUNCT[data[np.minimum(starts, len(data) - 1)]] if len(data) else starts < 0
            starts = starts + more
            more = (ends - 1 > starts) & _PUNCT[data[np.maximum(ends - 1, 0)]] if len(data) else more
            ends = ends - more
        keep = ~((ends - starts == 1) & _PUNCT[data[np.minimum(starts, max(len(data) - 1, 0))]]) if len(data) else np.zeros(0, bool)
        starts, ends, rows, full = starts[keep], ends[keep], rows[keep], full[keep]
        self.rows, self.own = rows, np.zeros(0, U)
        if not len(starts):
            return
        starts, ends, word, sign = parted(data, low, starts, ends)
        rows, end_word = rows[word], np.append(word[1:] != word[:-1], True)
        full = np.where(end_word, full[word], ends)
        self.rows, self.own = rows, span_hashes(low, starts, ends, 3)
        digits, plain = np.append(0, np.cumsum(_DIGIT[data])), np.append(0, np.cumsum(_PLAIN[data]))
        same_row = np.append(False, rows[1:] == rows[:-1])
        self.number = ((digits[ends] > digits[starts]) & (plain[ends] - plain[starts] == ends - starts)) | np.isin(self.own, _NUMBERS)
        self.fresh = np.ones(len(starts), bool)  # starts a sentence or a row
        self.fresh[1:] = ~same_row[1:] | _ENDS[data[full[:-1] - 1]] | _OPENS[data[np.maximum(starts[1:] - 1, 0)]]
        capital = ((data[starts] >= 65) & (data[starts] <= 90)) | ((data[starts] == 0xC3) & (low[np.minimum(starts + 1, len(low) - 1)] != data[np.minimum(starts + 1, len(data) - 1)]))
        self.unit = sign | (same_row & np.append(False, self.number[:-1]) & ~self.number & np.isin(self.own, _UNITS))
        self.capital = capital & ~self.number & ~self.unit
        seen = np.append(0, np.cumsum(~SEPARATOR[data]))
        self.joined = same_row & ~self.fresh  # nothing but space between it and the word before
        self.joined[1:] &= seen[starts[1:]] == seen[ends[:-1]]

    def template(self, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each entry of the template: its hash, slot kind, hash of its own text, row, first word. A run of name words is one entry."""
        if form == VERBATIM or not len(self.own):
            return self.own, np.zeros(len(self.own), np.int8), self.own, self.rows, np.arange(len(self.own))
        name = self.capital if form == LOOSE else self.capital & ~self.fresh
        kind = np.where(self.number, SLOT_NUM, np.where(self.unit, SLOT_UNIT, np.where(name, SLOT_NAME, LITERAL))).astype(np.int8)
        hashed = np.where(self.number, NUM, np.where(self.unit, UNIT, np.where(name, NAME, self.own)))
        more = name & np.append(False, name[:-1]) & self.joined
        head = np.flatnonzero(~more)
        place = np.arange(len(more)) - np.repeat(head, np.diff(np.append(head, len(more))))
        own = np.add.reduceat(self.own * (place.astype(U) * U(0x9E3779B97F4A7C15) + U(1)), head, dtype=U)
        return hashed[head], kind[head], own, self.rows[head], head


def item_windows(items: Iterator[tuple[int, str]], literals: int) -> dict:
    """For each form, sorted template windows of the items of one block, with places, and the items' words."""
    found, ids = {f: ([], [], [], {}) for f in FORMS}, []
    for item, (name, text) in enumerate(items):
        ids.append(name)
        data = np.frombuffer((text or "").encode(), np.uint8)
        split = Words(data, np.array([0, len(data)]))
        for form, (hashes, owner, place, words) in found.items():
            h, kind, own, _, _ = split.template(form)
            if not len(h) or (form != VERBATIM and int((kind == LITERAL).sum()) < literals):
                continue
            k = min(WINDOW, len(h))
            words[item] = (kind, own, len(h) - k + 1, k)
            g = grams(h, k) ^ U(k)
            hashes.append(g)
            owner.append(np.full(len(g), item, np.int64))
            place.append(np.arange(len(g)))
    out = {"ids": ids, "forms": {}}
    for form, (hashes, owner, place, words) in found.items():
        if hashes:
            h, o, p = (np.concatenate(x) for x in (hashes, owner, place))
            order = np.argsort(h, kind="stable")
            n = np.zeros(len(ids), np.int64)
            n[list(words)] = [w[2] for w in words.values()]
            out["forms"][form] = {"hash": h[order], "item": o[order], "place": p[order], "words": words, "n": n, "sizes": sorted({w[3] for w in words.values()})}
    return out


def one_to_one(a: np.ndarray, b: np.ndarray, back: bool) -> bool:
    """Whether each value of a stands beside one value of b, and with back each of b beside one of a."""
    pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0))
    return len(np.unique(pairs[0])) == pairs.shape[1] and (not back or len(np.unique(pairs[1])) == pairs.shape[1])


def consistent(kind: np.ndarray, item_words: np.ndarray, words: np.ndarray) -> tuple[bool, int, int]:
    """Whether slots map one value of the item to one of the text, and names back too; number of slots, of changed ones. A name that is also a literal of the item, where a sentence starts, is the same there."""
    slots, name = kind != LITERAL, kind == SLOT_NAME
    tied = name | ((kind == LITERAL) & np.isin(item_words, item_words[name]))
    good = one_to_one(item_words[slots], words[slots], False) and one_to_one(item_words[tied], words[tied], True)
    return good, int(slots.sum()), int((item_words[slots] != words[slots]).sum())


def window_hits(block: dict, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row, item, diagonal and place in the item of each window that an item has too, in this order and once."""
    hits = [np.zeros((4, 0), np.int64)]
    for k in block["sizes"]:
        g = grams(h, k) ^ U(k)
        if not len(g):
            continue
        lo = np.searchsorted(block["hash"], g, "left")
        at = np.flatnonzero((block["hash"][np.minimum(lo, len(block["hash"]) - 1)] == g) & (rows[: len(g)] == rows[k - 1 :]))
        n = np.searchsorted(block["hash"], g[at], "right") - lo[at]
        entry, at = ragged(lo[at], n), np.repeat(at, n)
        hits.append(np.stack([rows[at], block["item"][entry], at - block["place"][entry], block["place"][entry]]))
    return np.unique(np.concatenate(hits, axis=1), axis=1)


def judged(word: tuple, own: np.ndarray, diagonal: np.ndarray, place: np.ndarray, cover: float, literals: int) -> tuple | None:
    """Windows found, first and last entry of the text, slots and changed slots, if this is the item. An entry that windows of several diagonals hold is read on the one with most."""
    item_kind, item_own, n, k = word
    found = len(np.unique(place))
    if found < cover * n:
        return None
    at = np.full(len(item_own), -1)
    values, times = np.unique(diagonal, return_counts=True)
    for d in values[np.argsort(times, kind="stable")].tolist():
        own_places = place[diagonal == d]
        covered = ragged(own_places, np.full(len(own_places), k))
        at[covered] = covered + d
    covered = np.flatnonzero(at >= 0)
    if int((item_kind[covered] == LITERAL).sum()) < literals:
        return None
    good, slots, changed = consistent(item_kind[covered], item_own[covered], own[at[covered]])
    return (found, int(at[covered].min()), int(at[covered].max()), slots, changed) if good else None


def places(block: dict, h: np.ndarray, own: np.ndarray, rows: np.ndarray, cover: float, literals: int) -> Iterator[tuple]:
    """Row, item and what judged() says: for each diagonal alone, and where none will do for diagonals near each other."""
    hits = window_hits(block, h, rows)
    if not hits.shape[1]:
        return
    row, item, diagonal, place = hits
    far = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > SHIFT)
    heads = np.append(0, np.flatnonzero(far) + 1)
    sizes = np.diff(np.append(heads, len(row)))
    for lo, size in np.stack([heads, sizes])[:, sizes >= cover * block["n"][item[heads]]].T.tolist():
        d, p, word = diagonal[lo : lo + size], place[lo : lo + size], block["words"][int(item[lo])]
        cuts = np.flatnonzero(d[1:] != d[:-1]) + 1
        got = [judged(word, own, d[x], p[x], cover, literals) for x in np.split(np.arange(size), cuts)]
        if len(cuts) and not any(got):
            got = [judged(word, own, d, p, cover, literals)]
        yield from ((int(row[lo]), int(item[lo]), *g, word[2]) for g in got if g)


def find(index: dict, cover: float, literals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for b in batches:
            out = []
            for i, j, data, offsets in text_slices(b.column(1)) if block["forms"] else ():
                words = Words(data, offsets)
                first = np.searchsorted(words.rows, np.arange(j - i + 1))
                seen: dict[tuple[int, int], list] = {}  # a place that two forms find is one place
                for form, of in block["forms"].items():
                    h, _, own, rows, head = words.template(form)
                    fresh = []
                    for row, item, n, lo, hi, slots, changed, of_item in places(of, h, own, rows, 1 if form == VERBATIM else cover, literals if form != VERBATIM else 0):
                        lo, hi = int(head[lo]), int(head[hi])
                        if all(hi < x or lo > y for x, y in seen.get((row, item), ())):
                            fresh.append((row, item, lo, hi))
                            out.append((b.column(0)[i + row].as_py(), block["ids"][item], n, of_item, lo - int(first[row]), hi - int(first[row]), slots, changed))
                    for row, item, lo, hi in fresh:
                        seen.setdefault((row, item), []).append((lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(8)], schema=HIT)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", cover: float = COVER, literals: int = LITERALS) -> DataFrame:
    """Every place of a text at which an item stands: HIT_DDL; rows of docs without one are not named.

    Items come to the driver in blocks of BLOCK_WINDOWS template windows at most, and each block is
    broadcast and joined with all texts, which are not shuffled. Null or empty texts and items have no
    windows; items shorter than a window are one window. Rows and items that repeat give a hit
    each. A null key is reported as null. Empty tables
    give no hits.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text)

    def block(items: list) -> DataFrame:
        index = spark.sparkContext.broadcast(item_windows(iter(items), literals))
        return rows.mapInArrow(find(index, cover, literals), HIT_DDL)

    held, size = [], 0
    for r in benchmark.select(F.col(item_key).cast("long"), item_text).where(F.col(item_key).isNotNull()).orderBy(item_key, item_text).toLocalIterator():
        n = len(r[1].split()) if r[1] else 0
        if held and size + n > BLOCK_WINDOWS:
            part, held, size = block(held), [], 0
            out = part if out is None else out.unionByName(part)
        held.append((r[0], r[1]))
        size += n
    last = block(held)
    return last if out is None else out.unionByName(last)


def contaminated(hits: DataFrame) -> DataFrame:
    """doc_id and item_id of each pair, with its places, its share of windows and its slots at the best of them."""
    best = F.struct("n_windows", (-F.col("first_word")).alias("at"), "item_windows", "n_slots", "n_changed")
    out = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_places"), F.max(best).alias("b"))
    return out.select("doc_id", "item_id", "n_places", "b.n_windows", "b.item_windows", "b.n_slots", "b.n_changed")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold an item: rows are known by doc_id and a hash of the text, so that each text is judged for itself.

    Rows with a null doc_id are judged as others are. Texts are shuffled only if more rows hold items than can be broadcast.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    hits = leaks(docs.select(text_hash.alias("doc_id"), "text"), benchmark, **options)
    return without(docs, [text_hash], stage(hits.select(F.col("doc_id").alias("text_hash")).distinct(), "leaked"))
