"""Headings that are cut off lines, held against plain loops over all places where a line can be cut."""

import random
import re

from sparkquill.operators import chunks
from sparkquill.sources.views import MARKED, PLAIN

SPACES = "[ \t\n\x0b\f\r]+"


def brute_cut(text):
    """The first cut of a line that is no heading by itself; (heading, rest) or None."""
    bare = lambda x: x.lower().translate(str.maketrans(MARKED, PLAIN))
    line = re.sub("[ \t\n\r]+", " ", text).strip(" ")
    normative = lambda x: re.search(chunks.NORMATIVE, bare(x), re.A)
    words = line.split(" ")
    short = len(line) <= 80 and len(words) <= 10 and not line.endswith(".") and not ("," in line and len(words) > 6)
    heading = line and (len(line) <= 80 if normative(line) else short and re.search(chunks.HEADING, line, re.A))
    if heading or re.search(chunks.LEADERS, line, re.A) or len(re.findall(chunks.ARTICLES, bare(line), re.A)) >= 2:
        return None
    parts = re.split(f"(?<=[.:;]){SPACES}", line)
    for i in range(1, len(parts)):
        head, rest = " ".join(parts[:i]), " ".join(parts[i:]).lstrip(" .;:")
        if len(head) <= 80 and re.search("[A-Za-zÀ-ÿ]", rest) and normative(head) and not re.search(r"^it\s+[0-9]+(?:\.[0-9]+){0,2}\.?$", bare(head), re.A):
            return head, rest
    return None


def cuts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    return {r.chunk_id: (r.heading, r.rest) for r in chunks.headings(df).where("heading <> ''").select("chunk_id", "heading", "rest").collect()}


def test_cuts_are_those_of_plain_loops(spark):
    rng = random.Random(3)
    pieces = ["Artículo 3.", "IT 3.1.", "Objeto:", "a;", "x.", "1. a.", "Capítulo I.", "12", "...", "b" * 30, "ámbito de aplicación.", "ß", "articulo 4", ";", "3.2 medidas:", "ITC-BT-10", "z" * 79 + ".", "٣"]
    seps = [" ", " ", " ", "  ", "\f", " \f ", "\n"]
    texts = [None, "", " ", "1. " + "a. " * 60, "1. a. " + "b. " * 38 + "c", "anexo " + "a" * 73 + ". b", "anexo " + "a" * 74 + ". b", "anexo x. 1. 2. 3", "anexo x. 1. 2. 3é"]
    for _ in range(1500):
        texts.append(rng.choice(["", "Artículo 3. ", "1. ", "Anexo "]) + "".join(rng.choice(pieces) + rng.choice(seps) for _ in range(rng.randint(1, 9))))
    want = {i: brute_cut(t) for i, t in enumerate(texts) if t is not None}
    want = {i: w for i, w in want.items() if w}
    assert cuts(spark, texts) == want and len(want) > 150


def test_a_line_of_many_sentences(spark):
    """The work grows with the length of a line, not with its square."""
    many = "palabra. " * 30_000
    got = cuts(spark, [many, "Artículo 3. Objeto. " + many, "Artículo 3. " + "1. " * 30_000])
    assert got == {1: ("Artículo 3. Objeto.", many.strip())}
