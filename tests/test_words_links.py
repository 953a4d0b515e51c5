"""Golden cases of words, links and advertising."""

import pytest

from wardline.config import Ads, Links, Settings, Words
from wardline.operators.ads import AdScorer, Templates, compile_template, handles, keywords
from wardline.operators.lexicon import Matchers, active_words, add_words, completions, deletion_variants, lexicon, list_words, remove_words
from wardline.operators.links import LinkFinder, Span, disjoint
from wardline.operators.words import Engine, engine, greedy
from wardline.plans.moderate import moderate, moderate_distinct


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("скачай xray тут", (7, 11, "hrai", 100, "exact-word")),
        ("скачай x.r.a.y тут", (7, 14, "hrai", 100, "exact-word")),
        ("x r a y", (0, 7, "hrai", 95, "spaced-fragments")),
        ("xrayed", None),
        ("импак", None),
        ("1мпак", (0, 5, "impakt", 80, "fuzzy-compact")),
        ("x.r....a.y", None),
        ("", None),
        (None, None),
    ],
)
def test_words(text, expected):
    got = [(m.start, m.end, m.dict_word, m.confidence, m.reason) for m in engine(Words.blocked()).find(text)]
    assert got == ([expected] if expected else [])


def test_safe_words_names_and_levels():
    high = Engine(Matchers(["hell"], ["hello"]))
    assert [m.text for m in high.find("hell hello h.e.l.l")] == ["hell", "h.e.l.l"]
    named = Engine(Matchers(["impact"]), names=frozenset(["impacter"]))
    assert named.find("impacter") == []
    assert [m.reason for m in Engine(Matchers(["dog"]), "low").find("a dog, d.o.g")] == ["exact-token"]
    assert Engine(Matchers(["class"]), "low").find("class") == []  # the dictionary is collapsed, the token is not
    found = high.find("the hell of x")
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False)) and greedy(found) == found


def test_lexicon(spark):
    words = lexicon(spark, bad=["assess", "dogs"], safe=["dogs"], blocked=["xray"])
    assert {r.norm for r in active_words(words, "bad").collect()} == {"ases"}
    more = add_words(words, "bad", ["Cats", "DOGS", "cats"])
    assert [r.word for r in list_words(more, "bad").collect()] == ["assess", "dogs", "cats"]
    assert [r.word for r in list_words(remove_words(more, "bad", ["CATS"]), "bad").collect()] == ["assess", "dogs"]
    assert [r.word for r in completions(more, "at").collect()] == ["cats"]
    forms = deletion_variants(spark.createDataFrame([("abcdef", 0), ("abcdeg", 1)], "norm string, ord int")).collect()
    owners = {r.reduced: r.norm for r in forms}
    assert owners["abcde"] == "abcdef" and owners["bcdeg"] == "abcdeg" and len(owners) == 11
    m = Matchers(["abcdef", "abcdeg"])
    assert m.fuzzy == owners


@pytest.mark.parametrize(
    ("text", "standard", "final"),
    [
        ("заходи на example[dot]c0m", [(7, 25)], [(0, 25)]),
        ("play hypixel net", [(0, 16)], [(0, 16)]),
        ("вот это да net", [], []),
        ("1-2-3-4", [], []),
        ("ip: 1-2-3-4", [(4, 11)], [(4, 11)]),
        ("", [], []),
    ],
)
def test_links(text, standard, final):
    f = LinkFinder()
    assert [(m.start, m.end) for m in f.links(text)] == standard
    assert [(m.start, m.end) for m in f.find(text)] == final


def test_link_lists():
    f = LinkFinder(Links(list_on=True, domains=("https://t.me/x",)))
    assert f.is_allowed("t.me/other") and not f.is_allowed("example.com")
    deny = LinkFinder(Links(list_on=True, list_mode="blacklist", domains=("https://t.me/x",)))
    assert not deny.is_allowed("t.me/other") and deny.is_allowed("example.com")
    assert LinkFinder(Links(regex="(")).links("see example.com")[0].text == "see example.com"  # words before a known last label belong to it
    assert disjoint([Span(0, 3, "abc"), Span(4, 6, "ef"), Span(0, 5, "abcde"), Span(5, 6, "f")]) == [Span(0, 5, "abcde"), Span(5, 6, "f")]


def test_ads():
    assert handles("пиши @my_channel, mail a@b.com") == ["michanel", "bcom"]
    assert keywords("наш тгк тут", ["тгк", "наш тгк", "invite"]) == ["nawtgk"]  # a short key must be the whole message
    assert compile_template("no slot") is None and compile_template("{name} {name} x") is None
    best = Templates(["заходи в тгк {name}"]).best("заходи в тгк examplename")
    assert best and best.kind == "name" and best.similarity == 1.0
    scorer = AdScorer(Ads(), names={"steve"})
    assert scorer.evaluate("@Steve скинь ссылку на скин", False) == []
    hits = AdScorer(Ads()).evaluate("подпишись на telegram @cool_channel discord.gg/abc", True)
    assert hits and hits[0].score >= 70


def test_moderate(spark):
    df = spark.createDataFrame([(1, "скачай xray тут"), (2, "HELLO you"), (3, "fine"), (4, None), (5, "see example.com")], "id long, text string")
    rows = {r.id: r for r in moderate(df, Settings()).collect()}
    assert (rows[1].filtered, rows[1].decided_by, rows[1].blocked) == ("скачай **** тут", "blocked_words", True)
    assert (rows[2].final_text, rows[2].decided_by, rows[2].blocked) == ("hello you", "caps", False)
    assert (rows[3].decided_by, rows[3].blocked, rows[4].final_text) == (None, False, "")
    assert rows[5].links == ["see example.com"] and rows[5].blocked
    again = {r.id: r for r in moderate_distinct(df.union(df.filter("id = 1")), Settings()).collect()}
    assert all(again[k].final_text == rows[k].final_text and again[k].decided_by == rows[k].decided_by for k in rows)
