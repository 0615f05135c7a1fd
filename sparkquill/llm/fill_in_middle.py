"""Operator 13, fill-in-the-middle: a sparse index of exceptions between code points and bytes.

A text is cut at two drawn places and its three pieces are put in another order behind sentinels.
Texts are cut as UTF-8 bytes. Only characters of more than one byte are recorded: where each starts
and how many bytes the text has had in excess by then. A binary search in those converts cuts in
code points to bytes and back; between two of them, in ASCII, the conversion is a subtraction.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_slices, word_spans

#: What stands before the prefix, the suffix and the middle. A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents how many are cut, and of 100 that are cut how many have their suffix first.
RATE, SPM_RATE = 50, 80
FIM = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


class Exceptions:
    """The characters of more than one byte in UTF-8 bytes; nothing is kept for the others."""

    def __init__(self, data: np.ndarray) -> None:
        self.byte = np.flatnonzero(data >= 0xC0)  # first bytes of such characters
        lead = data[self.byte]
        #: Excess bytes of the first i exceptions.
        self.excess = np.append(0, np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)))
        self.char = self.byte - self.excess[:-1]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte places that are no place inside a character."""
        return at - self.excess[np.searchsorted(self.byte, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before code point places."""
        return at + self.excess[np.searchsorted(self.char, at)]


def token_units(data: np.ndarray, offsets: np.ndarray, _: Exceptions) -> tuple[np.ndarray, Callable]:
    """Units are a word with the white space before it, or white space at the end of a text: how many each text has, and where the first k of them end."""
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.append(0, np.cumsum(words))[:-1]
    last = np.append(offsets[:1], ends)[first + words] if len(words) else words
    rest = np.where(words > 0, last, offsets[:-1]) < offsets[1:]

    def ends_at(k: np.ndarray) -> np.ndarray:
        at = np.append(ends, 0)[np.minimum(first + k - 1, len(ends))]
        return np.where(k == 0, offsets[:-1], np.where(k > words, offsets[1:], at))

    return words + rest, ends_at


def char_units(data: np.ndarray, offsets: np.ndarray, index: Exceptions) -> tuple[np.ndarray, Callable]:
    """Units are code points."""
    chars = index.to_chars(offsets)
    return np.diff(chars), lambda k: index.to_bytes(chars[:-1] + k)


UNITS = {"token": token_units, "char": char_units}


def cut_texts(texts: pa.Array, forms: pa.Array, draws: tuple[np.ndarray, np.ndarray], units: str) -> pa.Array:
    """FIM rows of some texts, whose forms and draws are given."""
    n, prefix, middle, output = [], [], [], []
    forms = forms.to_pylist()
    for lo, hi, data, offsets in text_slices(texts):
        index = Exceptions(data)
        counts, ends_at = UNITS[units](data, offsets, index)
        places = [d[lo:hi] % (counts + 1) for d in draws]
        a, b = ends_at(np.minimum(*places)), ends_at(np.maximum(*places))
        chars = [index.to_chars(x) for x in (offsets[:-1], a, b)]
        n.append(counts)
        prefix.append(chars[1] - chars[0])
        middle.append(chars[2] - chars[1])
        raw = data.tobytes()
        p, s, m = (x.encode() for x in SENTINELS)
        for form, x, y, z, end in zip(forms[lo:hi], offsets.tolist(), a.tolist(), b.tolist(), offsets[1:].tolist()):
            pieces = {"plain": (raw[x:end],), "psm": (p, raw[x:y], s, raw[z:end], m, raw[y:z]), "spm": (s, raw[z:end], p, raw[x:y], m, raw[y:z])}
            output.append(b"".join(pieces[form]))
    plain = np.array([f == "plain" for f in forms], bool)
    whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    fields = [pa.array(whole(n)), pa.array(forms, pa.string()), pa.array(whole(prefix), mask=plain), pa.array(whole(middle), mask=plain), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(fields, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def draw(key: Column, seed: int, i: int) -> Column:
    """The i-th group of eight hex digits of a digest of seed and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text", units: str = "token", into: str = "fim") -> DataFrame:
    """docs with a struct column `into`: n units, form, code points of prefix and middle (null if plain), output.

    A text is plain if it is null or empty, holds a sentinel, or was not drawn; its output is the text
    ('' for null). Draws come from seed and key alone, so rows that repeat are cut alike and a row
    without a key is drawn as if its key were empty. All other columns stay, but for one named `into`, which
    is replaced. Texts are whole and nothing is shuffled; a worker holds one Arrow batch of texts
    (spark.sql.execution.arrow.maxRecordsPerBatch), and the index of about two million bytes of them.
    """

    @F.arrow_udf(FIM)
    def cut(texts: pa.Array, forms: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return cut_texts(texts, forms, (h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)), units)

    whole = F.coalesce(F.col(text), F.lit(""))
    h = [draw(F.col(key), seed, i) for i in range(4)]
    held = F.lit(False)
    for s in SENTINELS:
        held = held | F.contains(whole, F.lit(s))
    form = F.when((whole == "") | held | (h[2] % 100 >= RATE), "plain").when(h[3] % 100 < SPM_RATE, "spm").otherwise("psm")
    return docs.withColumn(into, cut(whole, form, h[0], h[1]))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. A sentinel stands in it once, since no piece holds one."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    first = lambda second: F.substr(F.substring_index(head, second, 1), F.lit(len(PREFIX) + 1))
    psm = F.concat(first(SUFFIX), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, first(PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
