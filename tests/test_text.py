"""Golden cases of normalization and similarity, for Python and for columns."""

import pytest
from pyspark.sql import functions as F

from wardline.config import Caps, clean_list, dictionary, duration_ms, merged, renamed
from wardline.functions import chars, domains, normalize, similarity, text
from wardline.operators.caps import fix_caps, is_caps

COMPACT = [
    ("xray", "hrai", "hrai"), ("x.r.a.y", "hrai", "hrai"), ("X-R-4-Y", "hrai", "hrai"), ("ｘｒａｙ", "hrai", "hrai"), ("ииимпаааккт", "impakt", "iiimpaaakkt"),
    ("Привет", "pivet", "ppivet"), ("hello", "helo", "hello"), ("телеграм", "telegpam", "telegpam"), ("сервер", "sepvep", "sepvep"), ("айпи", "aipi", "aipi"),
    ("лучший", "lucwi", "lucwii"), ("8", "8", "8"), ("9", "9", "9"), ("", "", ""),
]


def values(spark, rows, *columns):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [tuple(r) for r in df.select(*columns).collect()]


def test_compact(spark):
    assert [(w, chars.compact(w), chars.compact(w, False)) for w, _, _ in COMPACT] == COMPACT
    assert values(spark, [w for w, _, _ in COMPACT], "c0", normalize.compact("c0"), normalize.compact("c0", False)) == COMPACT
    assert all(chars.compact(c) == c for _, c, _ in COMPACT)


@pytest.mark.parametrize(("raw", "domain"), [("https://t.me/somechannel", "t.me"), ("example[dot]c0m", "example.com"), ("ехаmple.com", "example.com"), ("сайт точка ru", "cait.ru"), ("мой-сайт.phun", "moi.cait.fun")])
def test_domains(spark, raw, domain):
    assert domains.for_detection(raw) == domain
    assert values(spark, [raw], normalize.for_detection("c0")) == [(domain,)]


def test_domain_tokens(spark):
    words = ["abc-1", "привет", "на", "ехаmple", "", "a" * 64, "рeаllуwоrld"]
    assert [r[0] for r in values(spark, words, normalize.is_domain_token("c0"))] == [domains.is_domain_token(w) for w in words] == [True, False, True, True, False, False, True]
    assert [r[0] for r in values(spark, words, normalize.latin_domain("c0"))] == [domains.latin_domain(w) for w in words]


def test_obfuscation(spark):
    words = ["1мпак", "импак", "x.r", ".x", "x.", "a*", "*", "ь@", "", "a b"]
    expected = [True, False, True, False, False, True, False, False, False, True]
    assert [chars.has_obfuscation(w) for w in words] == expected
    assert [r[0] for r in values(spark, words, normalize.has_obfuscation("c0"))] == expected


def test_similarity(spark):
    pairs = [("hello", "hallo", 1 / 3), ("promotion", "promo", 0.5), ("abcdef", "abxcdef", 0.635714285), ("a", "a", 1.0), ("", "x", 0.0)]
    assert [chars.ad_similarity(a, b) for a, b, _ in pairs] == pytest.approx([x for *_, x in pairs])
    got = values(spark, [p[:2] for p in pairs], similarity.ad_similarity(F.col("c0"), F.col("c1")))
    assert [g[0] for g in got] == pytest.approx([x for *_, x in pairs])
    assert values(spark, [("hello world", "hello w0rld"), ("abc", "xyz")], similarity.similar_messages(F.col("c0"), F.col("c1"))) == [(True,), (False,)]
    assert values(spark, [("telegram", "tlgm"), ("abc", "acb")], similarity.is_subsequence(F.col("c0"), F.col("c1"))) == [(True,), (False,)]
    assert values(spark, [("aab", "abb")], similarity.char_overlap(F.col("c0"), F.col("c1")))[0][0] == pytest.approx(2 / 3)


def test_caps(spark):
    cases = [("HELLO world", True, "hello world"), ("ЛОЛ", False, "ЛОЛ"), ("HeLLo", False, "HeLLo"), ("I am", False, "I am"), ("A1B2", True, "a1b2"), ("a  BB", True, "a  bb"), ("", False, "")]
    assert values(spark, [c[0] for c in cases], "c0", is_caps("c0", Caps()), fix_caps("c0", Caps())) == cases


def test_floods(spark):
    assert values(spark, ["aaaaaa", "aaaaa", "abababab", "ababab"], similarity.char_flood("c0"), similarity.pattern_flood("c0")) == [(True, False), (False, False), (False, True), (False, False)]


def test_text(spark):
    assert [duration_ms(x) for x in ("1h 30m", "", "junk")] == [5_400_000, 0, 0]
    assert values(spark, ["1h 30m", "", "junk"], text.duration_ms("c0")) == [(5_400_000,), (0,), (0,)]
    assert [r[0] for r in values(spark, ["3661", "86400", "0"], text.format_duration(F.col("c0").cast("long")))] == ["1ч. 1м. 1с.", "1д.", "0с."]
    assert values(spark, [("2.10", "2.9"), ("2.3", "2.3.0"), ("1.9", "2")], text.newer_version("c0", "c1")) == [(True,), (False,), (False,)]
    assert values(spark, ["[title] a;1;2;3"], text.parse_action("c0")) == [(("title", "a;1;2;3"),)]
    assert values(spark, ["x.r.a.y", "привет", "a1", "12"], text.mask_keep_edges("c0"), text.mask_full("c0")) == [("x**y", "*" * 7), ("п****т", "*" * 6), ("**", "**"), ("**", "**")]
    assert values(spark, ['a"b\\\n'], normalize.escaped_json("c0")) == [('a\\"b\\\\\\n',)]
    assert values(spark, ["&aHi &#ff00ffyou<bold>"], normalize.strip_colors("c0")) == [("Hi you",)]
    assert values(spark, ["a;;3"], text.action_args("c0", ";", ("x", "1", "2", "4"))) == [(["a", "1", "3", "4"],)]


def test_settings():
    assert clean_list([" a", "b", "", None, "a"]) == ["a", "b"]
    assert dictionary(["Ab", "x", "ab"]) == ["ab"]
    assert merged({"version": 2, "a": {"b": 1, "c": 2}}, {"version": 1, "a": {"b": 9}}) == ({"version": 2, "a": {"b": 9, "c": 2}}, True)
    assert renamed({"old.a": ["x.old"], "other": 1}, {"old": "new"}, {"x.old": "x.new"}) == {"new.a": ["x.new"], "other": 1}
