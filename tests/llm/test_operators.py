"""Operators against brute force on the smallest tables and on rows with nulls, copies and odd texts."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkquill.llm import decontamination, fingerprint_index, html_extract, mixing, ngram_join, quality_rules, queries, sharding, suffix_dedup, token_counts, token_files

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 700} and{i % 31}" for i in range(3000))
STORY = "It was a bright cold day in the spring and the clocks of the old town were striking thirteen while the wind blew dust around the corner of the house by the river and nobody in the street looked up at the tower. " * 2


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (4, LONG), (5, STORY + "One."), (6, STORY + "One."), (7, "Über uns <|endoftext|> x's"), (None, STORY), (8, STORY + " And then it rained for a week, so that the river rose over its banks."), (9, "a b c")]
    return spark.createDataFrame([(i, t, "en" if i else None, "src1" if i != 5 else None, len(t or ""), 0, 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard long, kept string")


def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def brute_windows(rows):
    owner = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12) if i is not None else ():
            g = tuple(w[j : j + 13])
            owner[g] = min(owner.get(g, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12) if i is not None else ():
            if owner[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("name", ["given", "odd", "none"])
def test_windows(spark, odd, name):
    df = {"given": docs(spark), "odd": odd, "none": odd.limit(0)}[name]
    got = fingerprint_index.dedup_windows(df).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], brute_windows(rows_of(df)))


@pytest.mark.parametrize("name", ["given", "odd", "none"])
def test_suffixes(spark, odd, name):
    df = {"given": docs(spark).limit(60), "odd": odd, "none": odd.limit(0)}[name]
    rows = [(i, (t or "").encode()) for i, t in rows_of(df)]
    seen = collections.Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    same([(r.doc_id, r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in suffix_dedup.dedup_suffixes(df).collect()], want)


def brute_components(rows, k, num, den):
    sets, parent = [], {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])))
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [(i, len(s), find(i) if i is not None and s else i) for i, s in sets]


@pytest.mark.parametrize(("name", "k", "num"), [("given", 3, 90), ("given", 5, 80), ("odd", 5, 80), ("none", 3, 90)])
def test_components(spark, odd, name, k, num):
    df = {"given": docs(spark), "odd": odd, "none": odd.limit(0)}[name]
    got = ngram_join.jaccard_components(df, k=k, num=num)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], brute_components(rows_of(df), k, num, 100))


@pytest.mark.parametrize("block", [ngram_join.LINK_NODES, 7])
def test_all_links_of_edited_copies_are_counted(spark, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "LINK_NODES", block)
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(base[: n % 50] + [f"x{n % 7}", f"z{n // 9}"] + base[n % 50 + n % 5 :])) for n in range(90)]
    rows += [(200, rows[0][1]), (None, rows[3][1]), (201, "none like this one at all"), (202, None)]
    sets = [frozenset(zip(w, w[1:], w[2:])) if len(w := WORD.findall(t or "")) > 2 else frozenset() for _, t in rows]
    distinct = {s for s, (i, _) in zip(sets, rows) if s and i is not None}
    want = [(i, sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in distinct) if s and i is not None else 0) for s, (i, _) in zip(sets, rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([(r.doc_id, r.n_links) for r in ngram_join.jaccard_components(df, k=3, num=80).collect()], want)
    assert max(n for _, n in want) > 5


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(base[: n % 7] + [f"x{n}"] + base[n % 7 :] + [f"y{n // 3}"])) for n in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    got = ngram_join.jaccard_components(df, k=1, num=95)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], brute_components(rows, 1, 95, 100))


@pytest.mark.parametrize("name", ["given", "odd", "none"])
def test_token_counts_and_files(spark, odd, name):
    df = {"given": docs(spark), "odd": odd, "none": odd.limit(0)}[name]
    rows = rows_of(df)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    same([tuple(r) for r in token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()], [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows])
    tok, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same([tuple(r) for r in token_files.token_files(df, public_tokenizers.path("word_bpe_49k.json")).collect()], want)


def test_whole_tokens_and_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, tok = token_counts.Counter(path, token_counts.proven(path)), Tokenizer.from_file(path)
    for s in ["", " ", "a<|endoftext|> b \n\n x's'll", "12²Ⅷ \t\n y", "it's I'm　中文123 \xe9", "a\x85\x85b ​q", "x'S\n\n\n  foo   bar  \n", "\x1cfoo\x1d"]:
        assert counter.counts([s])[0] == len(tok.encode(s, add_special_tokens=False).ids)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 3)):
        order = sorted(range(1 << dims * bits), key=sharding.hilbert_table(dims, bits).__getitem__)
        for a, b in zip(order, order[1:]):
            far = [abs((a >> bits * d & (1 << bits) - 1) - (b >> bits * d & (1 << bits) - 1)) for d in range(dims)]
            assert sum(far) == 1


@pytest.mark.parametrize("name", ["given", "odd", "none"])
def test_shards(spark, odd, name):
    df = {"given": docs(spark), "odd": odd, "none": odd.limit(0)}[name]
    got = sharding.hilbert_shards(df, "doc_id", ["source", "lang", "n_chars"], 4).orderBy("shard", "slot").collect()
    assert len(got) == df.count()
    sizes = collections.Counter(r.shard for r in got)
    assert not got or max(sizes.values()) - min(sizes.get(s, 0) for s in range(4)) <= 1
    assert [(r.shard, r.slot) for r in got] == [(s, i) for s in range(4) for i in range(sizes[s])]
    assert [r.curve for r in got] == sorted(r.curve for r in got)


def test_budgets_share_shortage_among_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "x", "4"): 1000}
    got = mixing.budgets(leaves, lambda p: 1.0, 400, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "3"): 100, ("b", "x", "4"): 200}
    assert sum(mixing.budgets(leaves, lambda p: 1.0, 10**6, 2).values()) == 2 * 3010


def test_mixture_takes_budget_prefixes(spark, odd):
    df = docs(spark)
    got = mixing.mix(df, queries.mix_path(), queries.n_words(), queries.mix_weight, 0.6, 4).collect()
    have = {r.doc_id: len(WORD.findall(r.text or "")) for r in df.collect()}
    leaf, longest = collections.Counter(), collections.Counter()
    for r in got:
        leaf[r.domain, r.language, r.origin] += r.n_tokens
        longest[r.domain, r.language, r.origin] = max(longest[r.domain, r.language, r.origin], r.n_tokens)
        assert r.n_tokens == have[r.doc_id]
    sums = collections.Counter()
    for r in df.select("doc_id", *(c.alias(n) for c, n in zip(queries.mix_path(), mixing.PATH))).collect():
        sums[r.domain, r.language, r.origin] += have[r.doc_id]
    want = mixing.budgets(dict(sums), queries.mix_weight, int(0.6 * sum(sums.values())), 4)
    for p, b in want.items():
        assert b <= leaf[p] < b + max(longest[p], 1)
    assert mixing.mix(odd, queries.mix_path(), queries.n_words(), queries.mix_weight, 0.5).count() > 0
    assert mixing.mix(odd.limit(0), queries.mix_path(), queries.n_words(), queries.mix_weight, 0.5).count() == 0


def test_pages(spark):
    page = '<html><body class="has-sidebar"><nav><a href="/">Home</a></nav><div class="ad">Buy lamps &amp; oil now</div><article><h1>Tea &lt;green&gt;</h1><p>Water  should\nnot boil.<p>Wait.</p><ul><li>one</li><li>two</li></ul><script>if (a < b) x("</p>")</script></article><footer>&copy; all of us and many other people of this town</footer>'
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {1: "Tea <green>\nWater should not boil.\nWait.\none\ntwo", 2: "", 3: ""}
    given = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_extract.extract(given).collect():
        inner = r.html[r.html.index("<article>") :].split("</article>")[0]
        assert "©" not in r.text and r.text.split("\n")[0] and len(r.text.split("\n")) >= inner.count("<h1>")


@pytest.mark.parametrize("script", ["<script>for(var i=0;i<n;i++){go(i)}</script>", "<script>if(a<b){x=\"it's\"}</SCRIPT >", "<style>a:before{content:'<b'}</style>", "<script>var s='don\"t <p'; // isn't</script>", "<script src='x'/>"])
def test_text_after_scripts_stays(script):
    page = f"<body><article><p>Before it.</p>{script}<p>After it.</p></article><p>Last.</p>"
    assert [b[0] for b in html_extract.blocks(page)] == ["Before it.", "After it.", "Last."]


def test_statistics_and_rules(spark, odd):
    for df in (docs(spark), odd, odd.limit(0)):
        want = []
        for i, t in rows_of(df):
            w = WORD.findall(t or "")
            tri, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
            for j in range(len(w) - 2):
                if tri[tuple(w[j : j + 3])] > 1:
                    cover |= {j, j + 1, j + 2}
            lines = [x for x in (t or "").split("\n") if WORD.search(x)]
            want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)))
        same([tuple(r) for r in quality_rules.statistics(df).select("doc_id", *quality_rules.BASE).collect()], want)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rules = quality_rules.learn_rules(large, labels.where("doc_id % 2 = 0"))
    held_out = quality_rules.apply_rules(large, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in held_out.groupBy("quality", "kept").count().collect()}
    assert rules and n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n.get((0, False), 1)
    assert quality_rules.learn_rules(odd, labels.limit(0)) == []


def test_leaks(spark, odd):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(decontamination.leaks(docs(spark), bench)).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert got >= {(i, k) for i, t in rows_of(docs(spark)) for k, q in items if q in (t or "")}
    item = "A train leaves Boston at 40 km per hour and Anna drives 120 km in the same direction; after how many hours does the train meet Anna again?"
    changed = item.replace("Boston", "Denver").replace("40", "55").replace("120", "300").replace("Anna", "Maria")
    broken = item.replace("Anna drives", "Maria drives")  # one name became two
    texts = [(1, "Here is one. " + changed + " Good luck."), (2, "Here is one. " + broken + " Good luck."), (3, "A train leaves in the morning and nobody knows when it will come back to the town."), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    found = decontamination.leaks(df, bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 9)] and found[0].n_changed > 0
    assert decontamination.leaks(df.limit(0), bench).count() == 0 and decontamination.leaks(df, bench.limit(0)).count() == 0
    assert decontamination.clean(odd, bench).count() == odd.count()


def leaked(spark, texts, items):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(decontamination.leaks(df, bench)).collect())


def test_items_of_few_literals_are_found_word_for_word(spark):
    items = ["What is 12 times 13 plus 14 minus 15?", "Add 3 apples", "12 13 14 15", "der Hund und die Katze von Anna Schmidt aus Berlin"]
    texts = [f"Here it is. {q} So it was." for q in items]
    assert leaked(spark, texts, items) == [(i, i) for i in range(4)]
    assert leaked(spark, ["We had it. Add 3 apples", "We had it. Add 7 apples", "He wrote 1 2 3 4 down"], items) == [(0, 1)]


def test_reparameterised_items_are_found(spark):
    items = [
        "A shop sells twelve red lamps for $40 each and gives some of it back to you",
        "Anna walks to the shop and buys bread for three days before she goes home",
        "Every day the old boat of Anna sails along the coast at 40km an hour and turns back near Boston when the wind has reached 15% of its force",
    ]
    texts = [
        "Well. " + items[0].replace("$40", "$1,250") + ".",
        "Well. " + items[0].replace("$40", "\u20ac7") + ".",
        "Well. " + items[1].replace("Anna", "Maria") + ".",
        "Well. " + items[1].replace("Anna", "Mary Ann") + ".",
        "Well. " + items[2].replace("Anna", "Mary Ann").replace("40km", "7 mi").replace("15%", "20 percent") + ".",
        "Well. " + items[0].replace("$40", "a") + ".",
        "Well. " + items[2].replace("along the coast", "along the long coast") + ".",
    ]
    assert leaked(spark, texts, items) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (6, 2)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    df = docs(spark)
    kept = corpus_pipeline.quality(spark, df, SMALL)
    assert kept.columns == df.columns
    assert kept.count() < df.count()
    one = corpus_pipeline.near_duplicates(spark, kept, SMALL)
    comps = brute_components(rows_of(kept), 5, 80, 100)
    same([r.doc_id for r in one.collect()], sorted({c for _, _, c in comps}))
    clean = corpus_pipeline.decontaminate(spark, one, SMALL)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not [1 for r in clean.collect() for q in items if q in r.text]
    mixed = corpus_pipeline.mix(spark, clean, SMALL)
    assert mixed.columns == df.columns and mixed.count() > 0
    out = corpus_pipeline.shard(spark, mixed, SMALL)
    assert out.count() == mixed.count()


def test_digests_of_queries(spark):
    got = queries.op6_fingerprint_index(spark, SMALL).collect()
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_windows(rows_of(docs(spark)))]
    same([tuple(r) for r in got], want)
