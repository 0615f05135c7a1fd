"""Operator 7, token counts: the whole-token shortcut.

Offline, each string of the vocabulary is given to the library: those that come back as one token
are proven whole. Texts are cut into the tokenizer's pre-tokens; one that is proven whole counts 1,
and merging is run for the others only, once for each string that a worker remembers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Pre-tokens of a byte-level BPE tokenizer; fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as Unicode has it. No pre-token goes on over it, so a chunk is counted alone.
WHITE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Strings that a worker remembers.
MEMORY = 1_000_000
#: Texts that are counted at once.
GROUP = 256


@lru_cache(2)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def proven(path: str) -> set[str]:
    """Strings that the library, given them alone, returns as one token that is not special; bounded by the vocabulary."""
    tok = load(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings = [s for s in tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False) if s and "\ufffd" not in s and s not in special]
    return {s for s, e in zip(strings, tok.encode_batch_fast(strings, add_special_tokens=False)) if len(e) == 1 and PATTERN.fullmatch(s)}


class Counter(dict):
    """Tokens of a chunk of text: starts as the proven strings, remembers MEMORY more."""

    def __init__(self, path: str, whole: set[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.tok, self.whole = load(path), whole
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None

    def learn(self, chunks: set[str]) -> list[str]:
        """Counts chunks that are not known: whole pre-tokens as 1, the others merged in one call."""
        if len(self) > len(self.whole) + MEMORY:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        new = [c for c in chunks if c not in self]
        split = [PATTERN.findall(c) for c in new]
        rest = list(set().union(*split).difference(self.whole))
        merged = {p: len(e) for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False))}
        for c, pres in zip(new, split):
            self[c] = sum(merged.get(p, 1) for p in pres)
        return new

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of some texts. A special string in a text is one token, and parts what stands around it."""
        parts = [(self.special.split(t), len(self.special.findall(t))) if self.special and self.special.search(t) else ([t], 0) for t in texts]
        chunks = [([c for s in split for c in CHUNK.findall(s)], n) for split, n in parts]
        new = self.learn(set().union(*(c for c, _ in chunks)))
        out = [n + sum(map(self.__getitem__, c)) for c, n in chunks]
        for c in new:
            if len(c) >= 200:
                del self[c]
        return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and n_tokens of every whole text; nothing is shuffled.

    A null text is empty: 0 bytes, 0 tokens. Rows that repeat are counted each. path is a file of
    the tokenizers library that every worker can read.
    """
    docs = docs.select(key, text)
    whole = docs.sparkSession.sparkContext.broadcast(proven(path))  # at most the vocabulary
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            _counters[path] = Counter(path, whole.value)
        counter = _counters[path]
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([n for lo in range(0, len(texts), GROUP) for n in counter.counts(texts[lo : lo + GROUP])], pa.int64())], schema=schema)

    return docs.mapInArrow(run, f"{key} long, n_bytes long, n_tokens long")
