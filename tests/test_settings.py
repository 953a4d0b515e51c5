"""Settings from trees, typed actions, colours, list changes, overlaps and metrics."""

import pytest
from pyspark.sql import functions as F

from wardline import fixed
from wardline.config import Ads, Caps, Links, Settings, Spam, Words
from wardline.functions.normalize import translated_colors
from wardline.operators.lexicon import changed
from wardline.operators.spans import without_overlaps
from wardline.sources.sinks import Metrics
from wardline.sources.tables import dictionary_table


def test_settings_of_trees(tmp_path, spark):
    bad = {"filter": {"bad-words": {"level": "LOW", "replacement": "#", "keep-edge-letters": "yes"}}, "bad-words": [" Dogs ", "dogs", "x", None], "safe-words": ["hotdogs"]}
    assert Words.of(bad) == Words(level="low", mask="#", words=("dogs",), safe=("hotdogs",))
    assert Words.of({}, "blocked-words") == Words.blocked(words=())
    caps = Caps.of({"filter": {"caps": {"enabled": True, "min-length": 0, "max-caps-percent": 140, "whitelist": ["OK ", ""], "badwords-priority": {"filter-priority": "CAPS"}}}})
    assert (caps.enabled, caps.min_length, caps.percent, caps.whitelist, caps.filter_bad, caps.notify_bad) == (True, 1, 100, ("OK",), "caps", "badwords")
    assert Caps.of({}).min_length == 5 and not Caps.of({}).enabled and Caps.of({"filter": {"caps": {"min-length": -1}}}).shortest == 1
    ads = Ads.of({"filter": {"adaptive-ad-filter": {"high-precision-mode": False, "history-size": 0, "similar": 3, "high-similarity-percent": 5, "suspicion-ttl": "2m", "phrase-templates": {"enabled": True, "hit-score": 10, "min-message-length": 2}}}})
    assert (ads.min_score, ads.history, ads.similar_percent, ads.similar_percent_high, ads.ttl_ms, ads.template_score, ads.template_min_length, ads.templates_on) == (50, 1, 52, 10, 120_000, 50, 6, True)
    assert Ads.of({}).ttl_ms == 45 * 60_000 and Ads.of({}).keywords == fixed.DEFAULT_KEYWORDS and not Ads.of({}).templates_on
    links = Links.of({"filter": {"links": {"mode": "Replace-And-Notify", "list-filter": {"enabled": True, "domains": ["a.com", "a.com"]}}, "smart-detection": {"tlds": ["COM"], "min-domain-parts": 3}}})
    assert (links.mode, links.list_on, links.domains, links.tlds, links.min_parts) == ("replace-and-notify", True, ("a.com",), ("com",), 3)
    whole = Settings.of({"bad-words": bad, "caps": {"filter": {"caps": {"enabled": True}}}})
    assert whole.bad.words == ("dogs",) and whole.caps.enabled and whole.links == Links.of({}) and whole.spam == Spam.of({})
    path = tmp_path / "bad-words.yml"
    path.write_text("bad-words:\n  - ' Dogs'\n  - DOGS\n  - cats\n  - x\n", encoding="utf-8")
    assert [(r.word, r.ord) for r in dictionary_table(spark, str(path), "bad-words").collect()] == [("dogs", 0), ("cats", 1)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("&aHi &LBold §rx", "§x§5§5§f§f§5§5Hi §lBold §rx"),
        ("&#A1b2C3x", "§x§a§1§b§2§c§3x"),
        ("&x&1&2&3&4&5&6y", "§x§1§2§3§4§5§6y"),
        ("#112233z", "§x§1§1§2§2§3§3z"),
        ("a#112233", "a#112233"),
        ("&a#112233", "§x§5§5§f§f§5§5#112233"),
        ("<red>no &<b>a", "no &a"),
        ("&z & &", "&z & &"),
        ("5 < 6", "5 < 6"),
        ("", ""),
        (None, ""),
    ],
)
def test_colors(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(translated_colors("t").alias("x")).first().x == want


def test_changed_lists(spark):
    entries = spark.createDataFrame([("Alpha", 0), ("beta", 1)], "value string, ord int")
    changes = spark.createDataFrame([(" ALPHA", "add", 1), ("Gamma ", "add", 2), ("gamma", "add", 3), ("beta", "remove", 4), ("Beta", "add", 5), ("delta", "add", 6), ("DELTA", "remove", 7), ("  ", "add", 8), (None, "add", 9)], "value string, kind string, ord int")
    assert [r.value for r in changed(entries, changes).orderBy("ord").collect()] == ["Alpha", "Gamma", "Beta"]
    assert [r.value for r in changed(entries, changes, lower=True).orderBy("ord").collect()] == ["Alpha", "gamma", "beta"]
    assert changed(entries.limit(0), changes.limit(0)).count() == 0


def test_overlaps(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 5, 5), (1, 9, 12), (2, 0, 9), (None, 0, 9), (1, None, 4)], "id long, start long, end long")
    regions = spark.createDataFrame([(1, 4, 6), (1, 6, 8), (1, 11, 20), (1, 12, 13), (1, 2, 2), (None, 0, 9), (2, None, 3)], "id long, start long, end long")
    got = sorted(map(tuple, without_overlaps(spans, regions, "id").collect()), key=str)
    assert got == sorted([(1, 0, 3), (1, 5, 5), (2, 0, 9), (None, 0, 9), (1, None, 4)], key=str)


def test_metrics(spark, tmp_path):
    import time

    metrics = Metrics()
    spark.streams.addListener(metrics)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(50):
            if metrics.rows.get("counted"):
                break
            time.sleep(0.2)
        assert metrics.rows["counted"] == 7 and metrics.batches["counted"] >= 1 and not metrics.failures
    finally:
        spark.streams.removeListener(metrics)
    assert spark.range(1).select(F.lit(1)).count() == 1
