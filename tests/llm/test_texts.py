"""Operators on texts against brute force, and on nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import bpe, chat_format, common, components, html_extract, lang_id, line_dedup, lm_score, mixing, ngram_join
from wardline.llm.ngram_join import _from_planes, _planes

CLASH = ("h1", "batch", "key", "ids", "_near", "size", "set", "hash")


def docs(spark, texts, **more):
    """doc_id, text and columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] or [], "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    for c, v in more.items():
        df = df.withColumn(c, v)
    return df


def sentence(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))


ODD = [None, "", " \t\n", "one", "A b", "x" * 50_000, "\n\n", "é ß İ 漢字 <|endoftext|> 'Re", "same", "same"]


def test_bpe(spark):
    lib = bpe.codec(bpe.default_path()).library
    r = random.Random(1)
    texts = [*ODD, sentence(r, 4000), "".join(r.choice(" ab\n'sé1<|endoftext|>漢　.") for _ in range(5000))]
    shared = sentence(r, 3000)
    texts += [f"{sentence(r, 20)} {shared} {sentence(r, 30)}" for _ in range(3)]
    got = {x.doc_id: x for x in bpe.op1(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert [x.decoded for x in bpe.encode(docs(spark, ["héllo"])).collect()] == ["héllo"]
    assert bpe.op1(docs(spark, []).limit(0)).count() == 0


def test_bpe_rows_without_ids(spark):
    df = docs(spark, ["alpha beta", "alpha beta", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted((x.doc_id, x.n_tokens) for x in bpe.op1(df.union(df)).collect()) == [(None, 0)] * 2 + [(None, bpe.op1(docs(spark, ["alpha beta"])).first().n_tokens)] * 4


def test_short_texts_are_chunks_too():
    c = bpe.Codec(bpe.default_path())
    calls = []
    plain = c.plain
    c.plain = lambda t: calls.append(t) or plain(t)
    for t in ["a short text"] * 5 + ["", "x"]:
        assert c.encode(t) == c.library.encode(t, add_special_tokens=False).ids
    assert calls == ["a short text", "x"]


def test_joins_are_compared(monkeypatch):
    """With sync points where the pre-tokenizer does not split, both sides of a join disagree, and the text is encoded whole."""
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 12))) for _ in range(2000))
    c = bpe.Codec(bpe.default_path())
    want = c.library.encode(text, add_special_tokens=False).ids
    assert len(bpe.cuts(text.encode())) > 3 and c.encode(text) == want and len(c.cache) > 3
    monkeypatch.setattr(bpe, "SYNC", re.compile("(?<=[a-e])(?=[f-j])"))
    wrong, asked = bpe.Codec(bpe.default_path()), []
    plain = wrong.plain
    wrong.plain = lambda t: asked.append(t) or plain(t)
    assert wrong.encode(text) == want and asked[-1] == text


def test_fast_alphabet():
    c = bpe.codec(bpe.default_path())
    for code in range(0x250):
        s = f"a {chr(code)}b{chr(code)} 1{chr(code)}{chr(code)} .{chr(code)}"
        assert c.fast.encode_ordinary(s) == c.library.encode(s, add_special_tokens=False).ids


def test_chunks_follow_content():
    r = random.Random(2)
    shared = sentence(r, 4000).encode()
    chunks = []
    for head in (b"", b"some other words in front "):
        data, start, own = head + shared, 0, set()
        for end in bpe.cuts(data):
            own.add(data[start:end])
            start = end
        chunks.append(own)
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2 > 3


def brute_lines(texts, n):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = defaultdict(set)
    for i, t in texts:
        for s in (t or "").split("\n"):
            found[key(s)].add(i)
    out = []
    for i, t in texts:
        own = (t or "").split("\n")
        kept = [s for s in own if not (key(s) and len(found[key(s)]) >= n)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    r = random.Random(3)
    lines = [f"  Line {k} " for k in range(12)] + ["", "\t", "İx"]
    texts = [*ODD, *("\n".join(r.choice(lines).swapcase() if r.random() < 0.5 else r.choice(lines) for _ in range(r.randint(1, 40))) for _ in range(120))]
    texts += ["hot line\nhot line"] * 200
    df = docs(spark, texts)
    got = line_dedup.dedup_lines(df, min_docs=10).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(list(enumerate(texts)), 10)
    again = df.union(df.filter("doc_id < 20")).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id")))
    rows = [(x.doc_id, x.text) for x in again.collect()]
    assert sorted(map(tuple, line_dedup.dedup_lines(again, 10).collect()), key=str) == brute_lines(rows, 10)
    assert line_dedup.op2(df.limit(0)).count() == 0
    maps = {x.doc_id: x.words for x in line_dedup.keep_bitmaps(df, 10).collect()}
    want = {i: (n, gone, t) for i, n, gone, t in brute_lines(list(enumerate(texts)), 10)}
    assert set(maps) == {i for i, (_, gone, _) in want.items() if gone} and len([i for i in maps if i >= 130]) == 200
    for i, words in maps.items():
        own = texts[i].split("\n")
        assert "\n".join(s for k, s in enumerate(own) if words.get(k // 64, -1) >> (k % 64) & 1) == want[i][2]


def test_lines_held_over_batches(spark):
    """A run under the limit that goes on over many batches is settled at its end, whichever way."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = ["again\n" * 60 + f"own {i}" for i in range(9)] + ["often\n" * (1 + i % 9) + "again2" for i in range(30)] + ["solo\n" * 200]
        for more in ([], ["again"]):
            got = line_dedup.dedup_lines(docs(spark, texts + more), min_docs=10).collect()
            assert sorted(map(tuple, got), key=str) == brute_lines(list(enumerate(texts + more)), 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def brute_groups(texts):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("frequent", "block"), [(32, 4096), (3, 4)])
def test_ngram_join(spark, frequent, block):
    r = random.Random(4)
    passage = [f"p{k}" for k in range(40)]
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = list(ODD)
    for _ in range(60):  # one group of near copies, linked in part
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randint(3, 90))]) for _ in range(40)]
    texts += [" ".join(base[: r.randint(90, 120)]).upper() for _ in range(10)] + [sentence(r, r.randint(1, 12)) for _ in range(60)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.op5(docs(spark, texts)).collect()} if block > 4 else None
    if got is None:
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(docs(spark, texts), frequent=frequent, block=block).collect()}
    assert got == brute_groups(texts)


def test_ngram_join_splits_hot_sets(spark, monkeypatch):
    """With stars, copies and labels split over salts, and with the join in place of the Bloom filter, the groups are the same."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[: 55 + r.randrange(5)], f"n{k}"]) for k in range(60)] + [" ".join(base)] * 30 + [sentence(r, 8) for _ in range(20)]
    monkeypatch.setattr(common, "SPLIT", 4)
    for most in (ngram_join.BLOOM_MOST, 0):
        monkeypatch.setattr(ngram_join, "BLOOM_MOST", most)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.op5(docs(spark, texts)).collect()}
        assert got == brute_groups(texts)
    monkeypatch.setattr(common, "MOST_HOT", 0)
    left, right = spark.createDataFrame([(k % 3, k) for k in range(40)], "k long, x long"), spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, y string")
    assert sorted(map(tuple, common.split_join(left, right, "k", "x").collect())) == sorted((k % 3, k, "ab"[k % 3]) for k in range(40) if k % 3 < 2)


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD", 50)
    r = random.Random(2)
    links = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(150)] + [(r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(120)] + [(-5, -5), (None, 3), (2, 1), (1, 2)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    df = spark.createDataFrame(links, "a long, b long")
    got = components.components(df).collect()
    assert {x.node: x.label for x in got} == {x: top(x) for x in up} and len(got) == len(up)
    assert components.components(df.limit(0)).count() == 0
    few = components.spanned(df.coalesce(1)).collect()
    assert len(few) <= len(up) and max(Counter(x for row in few for x in row).values()) <= 3


def test_ngram_join_odd_rows(spark):
    df = docs(spark, ["a b c d e f"] * 3).withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(F.lit(7)))
    assert sorted(map(tuple, ngram_join.op5(df).collect()), key=str) == [(7, 2, 7), (7, 2, 7), (None, 2, 7)]
    assert ngram_join.op5(df.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(5)
    made = {"aa": "kato mipu lore", "bb": "zgrth xqwk vvrr"}
    rows = [(i, " ".join(r.choice(made[lang].split()) for _ in range(r.randint(2, 30))), lang) for i in range(300) for lang in [r.choice(["aa", "bb"])]]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(2000, "123 !?", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = {x.doc_id: x for x in lang_id.op6(df).collect()}
    known = [(i, lang) for i, _, lang in rows[:300]]
    held = [i for i, _ in known if got[i].held_out]
    assert 40 < len(held) < 110
    assert sum(got[i].lang_pred == lang for i, lang in known if got[i].held_out) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 2000)] == ["und"] * 4
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in lang_id.op6(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.op6(df.limit(0)).count() == 0


def test_language_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {x.doc_id: x.lang for x in df.select("doc_id", "lang").collect()}
    held = [x for x in lang_id.op6(df).collect() if x.held_out and own[x.doc_id] is not None and x.lang_pred != "und"]
    assert len(held) > 150 and sum(x.lang_pred == own[x.doc_id] for x in held) >= 0.97 * len(held)


def test_training_sample(spark, monkeypatch):
    rows = [(i, "x" * 5000 + f" tail {i}", "aa") for i in range(40)] + [(None, "no id", "bb"), (100, "null lang", None), (101, None, "aa"), (102, "", "aa")]
    rows += [(7, rows[7][1], "aa")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    free = {(t.encode(), lang) for i, t, lang in rows if t and lang and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)}
    got = lang_id.training_sample(df)
    assert set(got) == free and len(got) == len(free)  # whole texts, each once
    monkeypatch.setattr(lang_id, "SAMPLE_CHARS", 12_000)
    few = lang_id.training_sample(df)
    assert sum(len(t) for t, _ in few) <= 12_000 and 2 <= len(few) and set(few) <= free
    monkeypatch.setattr(lang_id, "SAMPLE_ROWS", 1)
    assert lang_id.training_sample(df) == got[:1]
    assert lang_id.training_sample(df.limit(0)) == []


def test_smallest_and_scratch(spark):
    import os

    df = spark.range(20000).select("id", F.xxhash64("id").alias("h"))
    assert [x.id for x in common.smallest(df, "h", 50).collect()] == [x.id for x in df.orderBy("h").limit(50).collect()]
    with common.scratch(spark):
        path = common.saved(df, "gone").inputFiles()[0].removeprefix("file:")
        with common.scratch(spark):
            inner = common.saved(df, "inner").inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path) and not os.path.exists(inner)
    assert not os.path.exists(path)


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    h, x = lang_id.HIDDEN, rng.integers(0, 256, (5, 3)).astype(np.uint8)
    wx, wh = rng.normal(0, 0.5, (256, 3 * h)).astype(np.float32), rng.normal(0, 0.5, (3 * h, h)).astype(np.float32)
    grad = rng.normal(size=(5, h, 3)).astype(np.float32)
    states, kept = lang_id._run(wx, wh, x, True)
    d_wx, d_wh = lang_id._back(wh, x, states, kept, grad)
    loss = lambda: float((lang_id._run(wx, wh, x)[0][1:].astype(np.float64) * grad).sum())
    for w, d, at in ((wh, d_wh, (1, 2)), (wh, d_wh, (2 * h + 1, 3)), (wx, d_wx, (int(x[1, 0]), h))):
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(d[at]), rel=0.05, abs=0.02)


def test_scores(spark):
    import math

    r = random.Random(6)
    texts = [*ODD, *(sentence(r, r.randint(1, 60)).title() for _ in range(80))]
    got = {x.doc_id: (x.n_words, x.score_micros) for x in lm_score.score(docs(spark, texts), batch_bits=3).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    one, two = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:], strict=False))
    total = sum(one.values())
    for i, ws in enumerate(words):
        micros = 0
        for k, w in enumerate(ws):
            pair = two[ws[k - 1], w] if k else 0
            share = one[w] / total if not k else pair / one[ws[k - 1]] if pair >= 2 else 0.4 * one[w] / total
            micros += round(math.log(share) * 1e6)
        assert got[i] == (len(ws), micros)
    assert lm_score.op7(docs(spark, []).limit(0)).count() == 0


def test_scores_of_rows_without_ids_and_large_counts(spark):
    import math

    df = docs(spark, ["a b a b", "a b a b", "c"] * 40).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(5)))
    got = Counter((x.doc_id, x.n_words, x.score_micros) for x in lm_score.score(df, batch_bits=2).collect())
    log = lambda x: round(math.log(x) * 1e6)
    ab, c = log(160 / 360) + 2 * log(160 / 160) + log(80 / 160), log(40 / 360)
    assert got == Counter({(5, 4, ab): 40, (None, 4, ab): 40, (5, 1, c): 20, (None, 1, c): 20})
    # counts beyond 32 bits and beyond what doubles tell apart travel and add up whole
    big = np.array([2**32 + 5, 2**53 + 1], np.int64)
    assert (_from_planes(_planes(big), np.int64) == big).all()


def test_scores_of_words_alike_in_47_bits(spark):
    """The hashes of the two words differ in their last 17 bits only."""
    import math

    texts = ["one w17237794 two", "one w31453840 two", "w6903173 w2109134 one"]
    words = [t.split() for t in texts]
    one, two = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:], strict=False))
    for known in (1, 2):
        got = {x.doc_id: x.score_micros for x in lm_score.score(docs(spark, texts), known=known).collect()}
        for i, ws in enumerate(words):
            shares = [one[ws[0]] / 9] + [two[a, b] / one[a] if two[a, b] >= known else 0.4 * one[b] / 9 for a, b in zip(ws, ws[1:], strict=False)]
            assert got[i] == sum(round(math.log(x) * 1e6) for x in shares)


def brute_repair(roles, costs):
    """Least cost over all legal readings, by search over positions and states."""
    best = {None: 0}
    for role in roles:
        now = {}
        for before, cost in best.items():
            change = lambda to, role=role: 0 if role == to else costs.relabel_unknown if role is None else costs.relabel
            if before:
                now[before] = min(now.get(before, 99), cost + costs.merge + change(before))
            edge = {before: cost}
            for _ in range(4):
                for last, c in list(edge.items()):
                    for to in chat_format.NEXT[last]:
                        now[to] = min(now.get(to, 99), c + change(to))
                edge = {to: c + costs.insert for last, c in edge.items() for to in chat_format.NEXT[last]}
        best = now
    return min(c + costs.insert * {"assistant": 0, "user": 1, "system": 2}[s] for s, c in best.items())


def test_chat(spark):
    r = random.Random(7)
    costs = chat_format.Costs()
    for _ in range(200):
        turns = [(r.choice(["user", "assistant", "system", "Human", "bot", None, "?"]), r.choice(["hi", None, ""])) for _ in range(r.randint(1, 7))]
        cost, out = chat_format.repaired(turns, costs)
        assert cost == brute_repair([chat_format.role_of(x) for x, _ in turns], costs)
        roles = [None, *(x for x, _ in out)]
        assert all(b in chat_format.NEXT[a] for a, b in zip(roles, roles[1:], strict=False)) and roles[-1] == "assistant"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, None, "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    got = sorted(map(tuple, chat_format.op3(df).collect()), key=str)
    assert got[0] == (1, 2, 2, 0, "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n")
    assert len(got) == 5 and got[1][:4] == (2, 1, 2, 4)
    assert chat_format.op3(df.limit(0)).count() == 0


def test_pages(spark):
    field = html_extract.train(html_extract.training_set(html_extract.labelled_pages(400, 3)))
    held = html_extract.training_set(html_extract.labelled_pages(100, 11))
    wrong = sum(a != b for page, labels in held for a, b in zip(labels, field.viterbi(page), strict=True))
    assert wrong <= 0.01 * sum(len(labels) for _, labels in held)
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;four.</p></article><footer>&copy; me</footer></body></html>'
    assert html_extract.main_text(field, page) == "A & B\n\nOne two.\n\nThree four."
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (4, "u", "<p"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = sorted((tuple(x) for x in html_extract.extract(df, field).collect()), key=str)
    assert [g[3] for g in got] == [len(g[2]) for g in got] and [g[2] for g in got if g[0] != 1] == ["", "", ""]
    assert html_extract.extract(df.limit(0), field).count() == 0


def article(page):
    """The tables' pages by their own template: what stands in the article, without the operator's code."""
    import html

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(t for t in (" ".join(x.split()) for x in parts) if t)


def test_main_text_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {x.page_id: article(x.html) for x in df.collect()}
    got = html_extract.op4(df.unionByName(df.filter("page_id < 2").withColumn("page_id", F.lit(None).cast("long")))).collect()
    assert len(got) == len(want) + 2 and all(x.page_id is None or (x.text, x.n_chars) == (want[x.page_id], len(want[x.page_id])) for x in got)


def test_deep_pages():
    """Very many unclosed or nested elements and end tags take time and memory in proportion."""
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.time()
    n = 30_000
    got = html_extract.blocks('<div class="menu">' * n + "x" + "</span></section>" * n + "".join(f"<div><p>a{k}" for k in range(n)))
    assert len(got) == n + 1 and got[0].text == "x" and "hint menu" in got[-1].place.within
    assert time.time() - start < 20 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    closed = html_extract.blocks("<div>" * n + "x" + "</div>" * n + "y")
    assert [(b.text, b.place and b.place.tag) for b in closed] == [("x", "div"), ("y", None)]


def test_elements_without_end_tag():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    rest = "<p>b</p>"
    for tag in ('<svg class="i"/>', "<svg hidden />", "<svg>", "<select>", "<select name='s'>", "<object data=x>", "<template>", "<select-box>", "<select-box></select-box>", "<template-x></template-x>"):
        assert texts("<p>a</p>" + tag + rest) == ["a", "b"], tag
        assert texts("<p>a</p>" + tag + rest + "<svg>no</svg><select>no</select><p>c</p>") == ["a", "b", "c"], tag
    for name in ("svg", "select", "object", "template"):
        assert texts(f"<p>a</p><{name} id=x/>no<{name}>no</{name}>no</{name.upper()}>{rest}") == ["a", "b"]
    for name in ("script", "style", "textarea", "iframe", "noscript"):
        assert texts(f"<p>a</p><{name}/>no{rest}") == ["a"]
        assert texts(f"<p>a</p><{name}>no<svg></{name} >{rest}</svg>") == ["a", "b"]


def test_viterbi_is_best():
    import itertools

    field = html_extract.train(html_extract.training_set(html_extract.labelled_pages(60, 5)))
    for page, _ in html_extract.training_set(html_extract.labelled_pages(8, 6)):
        page = page[:8]
        scores = field.scores(page)

        def total(labels, scores=scores):
            return sum(s[y] for s, y in zip(scores, labels, strict=True)) + field.first[labels[0]] + sum(field.step[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(page)), key=total)
        assert total([int(x) for x in field.viterbi(page)]) == pytest.approx(total(best))


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, sentence(r, r.choice([0, 1, 5, 40, 400])), r.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(3000)] + [(None, None, "z"), (5, "x y", "a"), (5, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("x")).withColumn("bucket", F.lit(0))
    got = mixing.op10(df).withColumn("n", F.lit(1)).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level, free, left = 0.0, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        left -= sum(2 * size[s] for s in over)
        free -= over
    target = {s: weight[s] * level if s in free else 2.0 * size[s] for s in names}
    joined = mixing.mix(df).collect()
    for s in names:
        own = [x for x in joined if x.source == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == size[s]
        assert abs(sum(x.copies * x.size for x in own) - target[s]) <= max(0.01 * target[s], min((x.size for x in own if x.size), default=0))
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    again = mixing.op10(df.repartition(7)).withColumn("n", F.lit(1)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.op10(df.limit(0)).count() == 0
    # rows that nothing tells apart share their copies, one more or less
    same = docs(spark, ["two words"] * 7 + ["one"] * 3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.when(F.col("text") == "one", "b").otherwise("a"))
    counts = Counter((x.source, x.copies) for x in mixing.mix(same).collect())
    assert sum(n for (s, _), n in counts.items() if s == "a") == 7 and len([1 for s, _ in counts if s == "a"]) <= 2


def test_mixing_of_the_tables(spark):
    """Every source of the tables comes within a hundredth of its target, or within its smallest document."""
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = defaultdict(list)
    for x in rows:
        by[x.source].append(x)
    assert len(by) > 3
    for own in by.values():
        assert abs(sum(x.copies * x.size for x in own) - own[0].target) <= max(0.01 * own[0].target, min(x.size for x in own if x.size))
