"""Registered queries against brute force of their contracts, and cases that single out a rule."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkquill.llm import decontamination, fingerprint_index, html_extract, mixing, quality_rules, queries, sharding, suffix_dedup
from sparkquill.llm.shared import partitions

from .test_operators import SMALL, STORY, WORD, brute_components, docs, odd, rows_of, same  # noqa: F401


def write_docs(spark, df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_suffixes(rows):
    seen = collections.Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_op8_is_the_contract(spark):
    want = brute_suffixes([(i, (t or "").encode()) for i, t in rows_of(docs(spark))])
    same([tuple(r) for r in queries.op8_suffix_array(spark, SMALL).collect()], want)


def repeats():
    """Texts with copies, near copies, passages that move, runs of one byte and strings just long enough."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + passage[: 150 + 10 * i] + word() * 20) for i in range(12)]
    rows += [(20, "x" * 900), (21, "y" * 30 + "x" * 199), (22, "x" * 200), (23, "ab" * 300), (24, passage + passage), (25, passage[7:]), (25, passage[9:]), (26, passage[:199]), (27, "z" + passage[:199]), (None, passage[50:])]
    return [*rows, *((40 + i, rows[0][1][:300] + str(i) + rows[0][1][300:]) for i in range(9)), (60, rows[1][1]), (61, rows[1][1])]


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 4])
def test_suffixes_of_hard_cases(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = repeats()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup_suffixes(df).select("doc_id", "n_bytes", "n_removed", F.size("starts"), F.sha2("kept", 256))
    same([tuple(r) for r in got.collect()], brute_suffixes([(i, t.encode()) for i, t in rows]))


def test_nothing_is_removed_that_the_sort_has_not_found(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda n: lambda batches: iter([b for b in batches][:0]))
    df = spark.createDataFrame(repeats(), "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.dedup_suffixes(df).collect()} == {0}


def test_common_prefixes():
    data = np.frombuffer(b"abcabcabd\x00abcabx\x00", np.uint8)
    suffix = lambda p: bytes(data[p : p + 5])
    sa = np.array(sorted(range(11), key=suffix))
    prefix = lambda x, y: next((i for i in range(5) if x[i] != y[i]), 5)
    assert suffix_dedup.common_prefixes(data, sa, 5).tolist() == [prefix(suffix(x), suffix(y)) for x, y in zip(sa, sa[1:])]


def test_op5_and_op7_are_the_contract(spark):
    rows = rows_of(docs(spark))
    tok, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same([tuple(r) for r in queries.op5_token_files(spark, SMALL).collect()], want)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    same([tuple(r) for r in queries.op7_token_counts(spark, SMALL).collect()], [(i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n)])


def test_op3_is_the_contract(spark):
    got = {r.doc_id: r for r in queries.op3_hilbert_sharding(spark, SMALL).collect()}
    rows = rows_of(docs(spark))
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None)
    sizes = collections.Counter(r.shard for r in got.values())
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got.values()) == [(s, k) for s in range(40) for k in range(sizes[s])]


def test_shards_prune_on_strings_with_a_common_beginning(spark):
    rows = [(i, f"https://www.example.org/part-{i * 7 % 40:02d}", i * 13 % 997, "mine", 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, url string, size long, row string, at int")
    out = sharding.hilbert_shards(df, "doc_id", ["url", "size"], 64)
    assert out.columns == [*df.columns, "curve", "shard", "slot"] and out.where("row <> 'mine' or at <> 5").count() == 0
    ends = out.groupBy("shard").agg(F.min("url").alias("u"), F.max("url").alias("v"), F.min("size").alias("a"), F.max("size").alias("b")).collect()
    assert np.mean([r.u <= rows[17][1] <= r.v for r in ends]) < 0.4 and np.mean([r.a <= 500 <= r.b for r in ends]) < 0.4
    assert np.mean([r.u <= rows[17][1] <= r.v and r.a <= 500 <= r.b for r in ends]) < 0.15


def test_mixture_takes_the_rows_that_the_seed_says(spark):
    df = docs(spark)
    got = collections.Counter((r.doc_id, r.epoch) for r in queries.op2_mixing(spark, SMALL).collect())
    rows = df.select("doc_id", *(c.alias(n) for c, n in zip(queries.mix_path(), mixing.PATH)), queries.n_words().alias("n")).collect()
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[r.domain, r.language, r.origin].append((r.doc_id, r.n))
    have = {p: sum(n for _, n in x) for p, x in leaves.items()}
    hashes = {(r.doc_id, r.e): r.h for r in df.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("e")).select("doc_id", "e", F.xxhash64(F.lit(7), F.col("e").cast("int"), "doc_id").alias("h")).collect()}
    want = collections.Counter()
    for p, budget in mixing.budgets(have, queries.mix_weight, int(0.6 * sum(have.values())), 4).items():
        left, epoch = budget, 0
        while left > 0:
            for i, n in sorted(leaves[p], key=lambda x: (hashes[x[0], epoch], x[0])):
                if left <= 0:
                    break
                want[i, epoch] += 1
                left -= n
            epoch += 1
    assert got == want


def test_mixture_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c", "mine"), (1, "a b c", "mine"), (1, "a b c", "mine"), (2, "d e", "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = mixing.mix(df, [F.lit("x"), F.lit("y"), F.lit("z")], queries.n_words(), lambda p: 1.0, 1.0, 1)
    same([tuple(r)[:3] for r in out.collect()], rows)


def test_index_of_three_batches_is_that_of_one(spark, odd):
    for df in (docs(spark), odd):
        want = [tuple(r) for r in fingerprint_index.dedup_windows(df, n_batches=1).collect()]
        same([tuple(r) for r in fingerprint_index.dedup_windows(df, n_batches=5).collect()], want)


def test_index_has_levels_and_is_opened_again(spark):
    df = docs(spark)
    rows = fingerprint_index.keyed(df, "doc_id", "text")
    index = fingerprint_index.FingerprintIndex(spark)
    names = lambda pairs: {(int(f), int(d)) for r in pairs.collect() for f, d in zip(*fingerprint_index.unpack(r.data, "u8", "i8"))}
    told, levels = set(), []
    for i in range(4):
        if i == 2:  # another session
            index = fingerprint_index.FingerprintIndex(spark, index.path, n_buckets=99)
        told |= names(index.add(rows.where(F.pmod("doc_id", F.lit(4)) == i)))
        levels.append([x[0] for x in index.runs()])
    assert levels == [[0], [1], [1, 0], [2]] and index.n_buckets == partitions(spark)
    whole = fingerprint_index.FingerprintIndex(spark)
    assert told == names(whole.add(rows))


def test_verdict_of_the_rules(spark, odd, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality_rules.learn_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels)
    assert rules
    for df in (docs(spark), odd):
        for r in quality_rules.apply_rules(df.drop("n_words"), rules).collect():
            t = r.text or ""
            w = WORD.findall(t)
            chars, lines = sum(map(len, w)), [x for x in t.split("\n") if WORD.search(x)]
            tri, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
            for j in range(len(w) - 2):
                cover |= {j, j + 1, j + 2} if tri[tuple(w[j : j + 3])] > 1 else set()
            row = {
                "n_words": len(w),
                "word_length": 1000 * chars // max(len(w), 1),
                "symbols": 1000 * len(re.findall(r"[#*$%&|<>]", t)) // max(chars, 1),
                "dup_lines": 1000 * (len(lines) - len(set(lines))) // max(len(lines), 1),
                "repeats": 1000 * len(cover) // max(len(w), 1),
                "capitals": 1000 * len(re.findall("[A-Z]", t)) // max(chars, 1),
                "marks": 1000 * len(re.findall("[!?]", t)) // max(chars, 1),
            }
            failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
            rejected = any(all(row[f] <= x if op == "<=" else row[f] > x for f, op, x in rule.conditions) for rule in rules)
            assert (r.base_failed, r.kept) == (failed, not failed and not rejected)


TEXT = "The river rose in the night and took the lower bridge with it, so that nobody could cross to the mill."
PAGES = {
    "boxes in an article": (f"<article><h1>Flood</h1><nav><a href='/a'>Top</a> <a href='/b'>End</a></nav><p>{TEXT}</p><aside><p>Readers also liked the story of the old mill by the river.</p></aside><form><p>Send us your own pictures of the flood tonight</p></form><p>Short.</p><footer><p>Printed by the river press in town.</p></footer></article>", f"Flood\n{TEXT}\nShort."),
    "header in main": (f"<main><header><p>Filed under water on a Monday</p></header><p>{TEXT}</p></main>", TEXT),
    "comments are articles": (f"<article><p>{TEXT}</p></article><article class='comment'><p>I was there and saw it all from the hill, what a night that was.</p></article><div class='comments'><article><p>Thank you for this, it is just as I remember it from then.</p></article></div>", TEXT),
    "no article, last block": (f"<div class='menu'><a href='/'>Home</a></div><div><p>{TEXT} {TEXT}</p><p>The mill stood.</p></div>", f"{TEXT} {TEXT}\nThe mill stood."),
    "no article, one word": (f"<div><p>{TEXT} {TEXT}</p><p>Then it was over for us all.</p><p>Silence.</p></div><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul>", f"{TEXT} {TEXT}\nThen it was over for us all.\nSilence."),
    "inline marks": ("<article class='post has-comments'><p>Tea <b>and</b> caf&eacute;&nbsp;au\n lait<br>now</p><ul><li><a href='/x'>A link to it</a></li><li>x</li></ul></article>", "Tea and café au lait now\nA link to it\nx"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_that_are_built_otherwise(spark, name):
    html, want = PAGES[name]
    df = spark.createDataFrame([(1, f"<html><body>{html}</body></html>")], "page_id long, html string")
    assert html_extract.extract(df).first().text == want


BODY = f"<h1>Flood at the lower bridge</h1><p>{TEXT} {TEXT}</p><p>{TEXT} {TEXT} {TEXT}</p>"
WRAPPED = {
    "sidebar": f'<div class="menu"><a href="/">Home</a></div><div class="content-sidebar">{BODY}</div><div class="sidebar"><p>Most read this week</p></div>',
    "header": f'<nav><a href="/">Home</a></nav><div class="wrap layout-header-fixed">{BODY}</div>',
    "social": f'<section class="social-policy">{BODY}</section><div class="social"><a href="/s">Share</a></div>',
    "share": f'<div class="article share-wrapper">{BODY}</div><div class="comments"><p>I saw it too.</p></div>',
    "named twice": f'<div class="widget"><div class="content-sidebar">{BODY}<div class="ad">Buy a boat now.</div></div></div>',
    "unnamed footer": f'<div><a href="/">Home</a> <a href="/n">News</a></div><div>{BODY}</div><div class="bottom">Copyright by the river press of the old town and of all its writers since the flood</div>',
}


@pytest.mark.parametrize("name", WRAPPED)
def test_a_name_on_what_holds_most_of_a_page_is_no_sign(spark, name):
    df = spark.createDataFrame([(1, f"<html><body>{WRAPPED[name]}</body></html>"), (2, None), (2, "")] * 2, "page_id long, html string")
    assert [r.text for r in html_extract.extract(df).collect()] == [f"Flood at the lower bridge\n{TEXT} {TEXT}\n{TEXT} {TEXT} {TEXT}", "", ""] * 2


def test_a_very_long_page_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, f"<article>{BODY * 3000}</article><footer><p>The press.</p></footer>", "mine", 5)], "page_id long, html string, blocks string, label int")
    row = html_extract.extract(df).first()
    assert row.text == "\n".join(["Flood at the lower bridge", f"{TEXT} {TEXT}", f"{TEXT} {TEXT} {TEXT}"] * 3000) and row.label == 5


def verdict(tree, block):
    while "y" not in tree:
        tree = tree["le"] if block[tree["f"]] <= tree["t"] else tree["gt"]
    return tree["y"]


@pytest.fixture(scope="module")
def page_blocks():
    import pyarrow.parquet as pq

    return [b for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist() for b in html_extract.described(r["html"])]


def test_words_and_links_find_the_articles_without_elements(page_blocks):
    tree, plain = html_extract.train(), [b | dict.fromkeys(html_extract.ELEMENT_FEATURES, 0) for b in page_blocks]
    pairs = [(verdict(tree, p), b["in_article"]) for p, b in zip(plain, page_blocks)]
    assert 2 * sum(x and y for x, y in pairs) / sum(x + y for x, y in pairs) > 0.95
    assert all(verdict(tree, b) == b["in_article"] for b in page_blocks)


@pytest.mark.parametrize("feature", html_extract.TEXT_FEATURES)
def test_each_text_feature_changes_verdicts(page_blocks, feature):
    tree, plain = html_extract.train(), [b | dict.fromkeys(html_extract.ELEMENT_FEATURES, 0) for b in page_blocks]
    assert any(sum(verdict(tree, b) != verdict(tree, b | {feature: v}) for b in plain) > 10 for v in (0, 1))


NUMBER = re.compile(r"^([$€£]?)(\d[\d.,/:-]*)([a-zA-Z%$€£]*)$")


def brute_template(text, form):
    """Words of a text without punctuation around them; numbers, the units on them and runs of capitalised words as slots: strict: inside a sentence, loose: anywhere, verbatim: no slots."""
    out, fresh = [], True
    for raw in text.split():
        w = raw.strip("(),.;:!?\"'")
        m = NUMBER.match(w)
        if m:
            out += [("unit", m[1])] * bool(m[1]) + [("num", m[2])] + [("unit", m[3])] * bool(m[3])
        elif out and out[-1][0] == "num" and w.lower() in decontamination.UNITS:
            out.append(("unit", w.lower()))
        elif w[:1].isupper() and (form == "loose" or not fresh):
            if out and out[-1][0] == "name" and joined and not fresh:
                out[-1] = ("name", f"{out[-1][1]} {w.lower()}")
            else:
                out.append(("name", w.lower()))
        elif w:
            out.append((w.lower(), None))
        fresh, joined = raw[-1:] in tuple(".!?:;"), raw[-1:] == w[-1:]
    return [(x if y is None else y, None) for x, y in out] if form == "verbatim" else out


def brute_leaks(texts, items):
    """Items whose whole template stands somewhere in a text: slots map to one value, names one to one; with fewer than six literals word for word only."""
    found = set()
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            for form in ("strict", "loose", "verbatim"):
                t, q = brute_template(text, form), brute_template(item, form)
                if form != "verbatim" and sum(v is None for _, v in q) < 6:
                    continue
                names = {v for k, v in q if k == "name"}
                for at in range(len(t) - len(q) + 1):
                    here = t[at : at + len(q)]
                    if any(a[0] != b[0] for a, b in zip(q, here)):
                        continue
                    pairs = {(a[1], b[1]) for a, b in zip(q, here) if a[1] is not None}
                    tied = {(a[1] or a[0], b[1] or b[0]) for a, b in zip(q, here) if a[0] == "name" or (a[1] is None and a[0] in names)}
                    if len({a for a, _ in pairs}) == len(pairs) and len({a for a, _ in tied}) == len({b for _, b in tied}) == len(tied):
                        found.add((i, j))
    return found


def test_leaks_are_those_of_a_plain_matcher(spark):
    items = [
        "when the train with twelve cars leaves at 10:30 it carries $400 of mail to Boston and comes back with 15% less",
        "each of the workers lifts 30kg of sand in 5 h so how much do they lift until the evening of the day",
        "the shop of Anna sells bread for 3 euros and milk for 2 euros while the shop of Berta sells both for 4 euros",
        "Anna has 5 apples and then Ben takes 2 of them away, so how many apples does Anna have at the end of the day?",
        "Who wrote Hamlet?",
        "What is 12 times 13?",
        "Is it 5 km?",
        "What is the capital of France?",
        "Ann Lee and Joe rode 20 km on the old road in the rain",
    ]
    changed = [
        items[0].replace("10:30", "7:45").replace("$400", "€85").replace("Boston", "Denver").replace("15%", "9%"),
        items[1].replace("30kg", "12lb").replace("5 h", "8 h"),
        items[2].replace("Anna", "Clara").replace("Berta", "Dora").replace("3 euros", "7 euros"),
        items[2].replace("Berta", "Anna").replace("3 euros", "9 euros"),  # two of the item's names have become one
        items[2].replace("2 euros", "2 pounds"),  # one unit has become two
        "nothing of the kind is in this text of many words that goes on for a while and then ends",
        items[3].replace("does Anna", "does Ben"),
        items[3].replace("Anna", "Clara").replace("5 apples", "7 apples"),
        items[3].replace("Anna", "Ben").replace("then Ben", "then Anna"),
        "Who wrote Emma? they said",
        "what is 7 times 9",
        "is it 9 miles",
        "What is the capital of Germany?",
        "who wrote Hamlet? it was he",
        items[8].replace("Ann Lee", "Sue Ray").replace("20 km", "9 mi"),
    ]
    texts = [f"so we read on. it said that {c} and no more of it." for c in [*items, *changed]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench, cover=1.0).collect()}
    want = brute_leaks(texts, items)
    assert got == want and {(i, j) for i, j in want if i >= len(items)} == {(9, 0), (10, 1), (11, 2), (16, 3), (17, 3), (22, 4), (23, 8)}


def test_clashing_columns_and_odd_rows_of_leaks(spark):
    item = "each of the workers lifts 30kg of sand in 5 h so how much do they lift until the evening of the day"
    rows = [(1, f"We read that {item}", 7, "x"), (1, f"We read that {item}", 7, "x"), (2, None, 8, "y"), (None, item.replace("30kg", "9kg"), 9, "z"), (3, "", 1, "w"), (4, "word " * 60_000 + item, 2, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long, n_windows string")
    bench = spark.createDataFrame([(5, item, "q"), (6, None, "q"), (7, "", "q"), (None, item, "q")], "item_id long, text string, doc_id string")
    same([(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()], [(1, 5), (1, 5), (None, 5), (4, 5)])
    kept = decontamination.clean(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id, r.item_id, r.n_windows) for r in kept.collect()) == [(2, 8, "y"), (3, 1, "w")]


def test_number_words_are_slots(spark):
    items = ["if three workers dig the ditch in five days how long do nine workers need for it", "a box with twelve eggs stood on the table by the door", "a box with nine pears"]
    texts = [f"They ask: {items[0].replace('three', 'seven').replace('five', '6').replace('nine', 'eleven')}", f"They ask: {items[0].replace('workers', 'horses')}", "We saw that a box with ten eggs stood on the table by the door, and once more a box with two pears"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()) == [(0, 0), (2, 1)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    text = [STORY + "Two more words here.", STORY + "Two more words here.", None, "", "short", " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(60)) + ".", STORY + "Another end."]
    rows = [(1, text[0]), (1, text[0]), (1, text[5]), (2, text[1]), (3, None), (4, ""), (5, "short"), (None, text[6]), (None, text[6]), (None, text[5]), (9, text[7]), (10, text[6] + " x" * 50_000)]
    return spark.createDataFrame([(i, t, "en" if n % 3 else None, "src1" if n % 4 else None, len(t or ""), "k", "r", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, __key string, row string, key int")


def test_stages_on_odd_rows(spark, odd_docs):
    import corpus_pipeline

    for df in (odd_docs, odd_docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, df, SMALL)
            assert set(df.columns) <= set(out.columns) and (name == "shard" or out.columns == df.columns)
            assert {(r["__key"], r.row) for r in out.collect()} <= {("k", "r")}
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, SMALL).collect()
    # of the copies and near copies of the story the first; both texts of id 1; wordless and short rows; rows without an id are like others with one
    same([(r.doc_id, (r.text or "")[:12]) for r in kept], [(1, STORY[:12]), (1, "w0 w1 w2 w3 "), (3, ""), (4, ""), (5, "short"), (10, "v0 v1 v2 v3 ")])
    assert corpus_pipeline.decontaminate(spark, odd_docs, SMALL).count() == odd_docs.count()
    mixed = collections.Counter(r.key for r in corpus_pipeline.mix(spark, odd_docs, SMALL).collect())
    assert mixed and max(mixed.values()) <= corpus_pipeline.MIX_EPOCHS


def test_the_whole_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    df = docs(spark)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.apply_rules(df, quality_rules.learn_rules(df, labels)).collect() if r.kept}
    rows = [(i, t) for i, t in rows_of(df) if i in kept]
    first = {c for _, _, c in brute_components(rows, 5, 80, 100)}
    leaked = {r.doc_id for r in decontamination.leaks(df, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    clean = {(i, t) for i, t in rows if i in first - leaked}
    assert set(got) <= clean and len(got) > 0.5 * len(clean) and max(got.values()) <= corpus_pipeline.MIX_EPOCHS
    sizes = collections.Counter(r.shard for r in out.collect())
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(corpus_pipeline.SHARDS)) <= 1


def test_op10_is_the_contract(spark):
    same([(r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_ngram_join(spark, SMALL).collect()], brute_components(rows_of(docs(spark)), 3, 90, 100))
