"""The whole plan: precedence of capitals, bypassed filters, and rows whose msg_id, user or time says nothing."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline import queries
from wardline.config import Ads, Caps, Links, Settings, Spam, Words
from wardline.operators import policy, spam
from wardline.operators.suspicion import SuspicionFold, suspicion
from wardline.operators.words import engine
from wardline.plans.moderate import moderate, moderate_brief, moderate_chat, moderate_distinct

START = datetime(2024, 1, 1)
BAD = Words(words=("dogs",))


@pytest.mark.parametrize(
    ("caps", "text", "final", "decided_by", "blocked"),
    [
        (Caps(), "СКАЧАЙ XRAY ТУТ", "скачай **** тут", "blocked_words", True),
        (Caps(filter_blocked="caps"), "СКАЧАЙ XRAY ТУТ", "скачай xray тут", "caps", False),
        (Caps(filter_blocked="blockedwords"), "СКАЧАЙ XRAY ТУТ", "СКАЧАЙ **** ТУТ", "blocked_words", True),
        (Caps(filter_bad="caps"), "LOUD DOGS", "loud dogs", "caps", False),
        (Caps(filter_bad="badwords"), "LOUD DOGS", "LOUD D**S", "bad_words", False),
        (Caps(), "LOUD DOGS", "loud d**s", "bad_words", False),
        (Caps(filter_bad="caps"), "XRAY DOGS", "**** dogs", "blocked_words", True),  # bad words step back, blocked ones do not
        (Caps(filter_blocked="caps"), "XRAY DOGS", "xray d**s", "bad_words", False),  # blocked words step back, bad ones do not
        (Caps(filter_blocked="caps", filter_bad="caps"), "XRAY DOGS", "xray dogs", "caps", False),
        (Caps(filter_blocked="caps"), "quiet xray", "quiet ****", "blocked_words", True),  # no capitals, no precedence
    ],
)
def test_precedence(spark, caps, text, final, decided_by, blocked):
    df = spark.createDataFrame([(text,)], "text string")
    row = moderate(df, Settings(bad=BAD, caps=caps)).first()
    assert (row.final_text, row.decided_by, row.blocked) == (final, decided_by, blocked)


def test_bypass(spark):
    df = spark.createDataFrame(
        [(0, "LOUD xray dogs", None), (1, "LOUD xray dogs", ["blocked_words"]), (2, "LOUD xray dogs", ["caps", "bad_words"]), (3, "see example.com", ["links"]), (4, "see example.com", []), (5, None, ["caps"])],
        "id long, text string, skip array<string>",
    )
    for run in (moderate, moderate_distinct):
        rows = {r.id: (r.final_text, r.decided_by, r.blocked) for r in run(df, Settings(bad=BAD), bypass="skip").collect()}
        assert rows == {
            0: ("loud **** d**s", "blocked_words", True),
            1: ("loud xray d**s", "bad_words", False),
            2: ("LOUD **** dogs", "blocked_words", True),
            3: ("see example.com", None, False),
            4: ("see example.com", "links", True),
            5: ("", None, False),
        }


def test_bypass_sets(spark):
    messages = spark.createDataFrame([(1, 10), (2, 20), (3, None), (1, 10)], "msg_id long, user_id long")
    users = spark.createDataFrame([(10, "caps"), (10, "caps"), (None, "links"), (20, None)], "user_id long, filter string")
    groups, members = spark.createDataFrame([("staff", "links")], "group string, filter string"), spark.createDataFrame([(20, "staff"), (10, "guests")], "user_id long, group string")
    cfg = Settings(spam=Spam(enabled=False))
    got = sorted(((r.msg_id, r.bypassed) for r in policy.bypass_sets(messages, users, groups, members, cfg).collect()), key=str)
    assert got == [(1, ["anti_spam", "caps"]), (1, ["anti_spam", "caps"]), (2, ["anti_spam", "links"]), (3, ["anti_spam"])]
    assert policy.bypass_sets(messages.limit(0), users).count() == 0 and policy.bypass_sets(messages).first().bypassed == []


def test_chat_rows_come_out_once(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [
        (5, at(0), 1, "see example.com now"),
        (5, at(60), 1, "see example.com now"),
        (None, at(120), 1, "see example.com now"),
        (None, at(180), 2, "a quiet message"),
        (7, at(181), 2, "a quick one"),
        (8, None, 2, "no time, see example.com"),
        (9, at(0), None, "no user, see example.com"),
        (10, at(1), None, "no user, see example.com"),
        (11, at(300), 3, None),
    ]
    df = spark.createDataFrame(rows, "msg_id long, ts timestamp_ntz, user_id long, text string")
    out = sorted(((r.msg_id, r.ts, r.level, r.blocked, r.decided_by) for r in moderate_chat(df.withColumn("links", df.text), Settings(spam=Spam(lock_ms=0, dedupe_ms=-1))).collect()), key=str)
    assert out == sorted(
        [
            (5, at(0), 1, True, "links"),
            (5, at(60), 2, True, "links"),
            (None, at(120), 3, True, "links"),
            (None, at(180), 0, False, None),
            (7, at(181), 0, True, "anti_spam"),
            (8, None, None, True, "links"),
            (9, at(0), 1, True, "links"),
            (10, at(1), 1, True, "links"),
            (11, at(300), 0, False, None),
        ],
        key=str,
    )
    assert moderate_chat(df.limit(0)).count() == 0


def test_chat_replaces_links_and_heeds_bypasses(spark):
    rows = [(1, START, 1, "see example.com", []), (2, START + timedelta(seconds=1), 1, "see example.com", ["links"]), (3, START + timedelta(seconds=2), 1, "see example.com", ["anti_spam", "links"])]
    df = spark.createDataFrame(rows, "msg_id long, ts timestamp_ntz, user_id long, text string, skip array<string>")
    cfg = Settings(links=Links(mode="replace-and-notify"), spam=Spam(lock_ms=0, dedupe_ms=-1))
    got = {r.msg_id: (r.final_text, r.level, r.spam_reason, r.blocked) for r in moderate_chat(df, cfg, bypass="skip").collect()}
    assert got == {1: ("[link removed]", 1, None, False), 2: ("see example.com", 1, "similar-message-cooldown", True), 3: ("see example.com", 1, None, False)}
    off = Settings(links=Links(enabled=False), spam=Spam(enabled=False))
    assert [r.blocked for r in moderate_chat(df, off).collect()] == [False] * 3


def test_fan_out_and_preferences(spark, monkeypatch):
    notes = spark.createDataFrame([("n", 1), ("m", None)], "note string, user_id long")
    admins = spark.createDataFrame([(k, k != 4) for k in (1, 2, 3, 4, 5, 5)], "admin_id long, online boolean")
    changes = spark.createDataFrame([(2, False, 1), (2, True, 2), (3, False, 3), (None, False, 4)], "user_id long, enabled boolean, ord int")
    wishes = policy.preferred(spark.createDataFrame([(5, False)], "user_id long, enabled boolean"), changes)
    want = [("m", 1), ("m", 2), ("n", 2)]
    for most in (policy.ADMINS, 2):
        monkeypatch.setattr(policy, "ADMINS", most)
        assert sorted((r.note, r.admin_id) for r in policy.fan_out(notes, admins, preferences=wishes).collect()) == want
    assert policy.fan_out(notes, admins.limit(0)).count() == 0


def masked(text, spans, mask):
    for m in sorted(spans, reverse=True):
        text = text[: m.start] + mask(text[m.start : m.end]) + text[m.end :]
    return text


def edges(t):
    letters = "".join(c for c in t if c.isalpha())
    return letters[0] + "*" * (len(letters) - 2) + letters[-1] if len(letters) > 1 else "*"


def shouts(word):
    letters = "".join(c for c in word if c.isalpha())
    upper = sum(c.isupper() for c in letters)
    return len(letters) > 1 and letters.lower() not in ("лол", "гг", "афк") and upper > 1 and upper * 100 >= 70 * len(letters)


def test_chat_against_a_plain_loop(spark):
    """The tables' chat, row by row in plain Python, against the plan: every text, decision, level and spam result."""
    folder = "/root/testdata/sf0.001"
    hour = 3_600_000
    words = tuple(sorted({w.lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in re.findall(r"[a-z]{9,}", r.text)}))[:60]
    cfg = Settings(bad=Words(words=words, safe=()), blocked=Words.blocked(words=("license", "copyright")), links=Links(ads=Ads(ttl_ms=96 * hour)))
    cfg = Settings(bad=cfg.bad, blocked=cfg.blocked, links=cfg.links, spam=Spam(cooldown_ms=hour, similar_ms=48 * hour, lock_ms=0, state_ttl_ms=96 * hour))
    chat = queries.chat(spark, folder)
    bad, blocked, fold = engine(cfg.bad), engine(cfg.blocked), SuspicionFold(cfg.links)
    want, user, seen = {}, None, {}
    for r in sorted(chat.collect(), key=lambda r: (r.user_id, r.ts, r.msg_id)):
        if r.user_id != user:
            user, record, state = r.user_id, fold.new(), spam.State()
        at = int((r.ts - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
        if r.text not in seen:
            one = blocked.find(r.text)
            t = masked(r.text, one, lambda s: "*" * len(s))
            two = bad.find(t)
            seen[r.text] = bool(one), bool(two), masked(t, two, edges), any(map(shouts, re.split(r"[ \t\n\x0b\f\r]+", r.text)))
        has_blocked, has_bad, text, caps = seen[r.text]
        links, level, _ = fold.step(record, at, {"text": text})
        result = spam.step(cfg.spam, state, at, r.text, at)
        final = re.sub(r"\S+", lambda m: m[0].lower() if shouts(m[0]) else m[0], text) if caps else text
        by = "blocked_words" if has_blocked else "bad_words" if has_bad else "links" if links else "caps" if caps else None
        stops = result is not None and result.reason != "character-flood-first"
        want[r.msg_id] = (final, level, len(links), result and result.reason, "anti_spam" if stops else by, stops or by in ("blocked_words", "links"))
    got = {r.msg_id: (r.final_text, r.level, len(r.links), r.spam_reason, r.decided_by, r.blocked) for r in moderate_chat(chat, cfg).collect()}
    assert got == want and len({v[4] for v in want.values()}) >= 4


def test_texts_are_shuffled_once(spark):
    """Rows meet what was made of their texts by digest alone; the texts, null ones too, are as they were."""
    df = spark.createDataFrame([(1, "see example.com", "a"), (2, None, "b"), (3, "", "c"), (4, "see example.com", "d")], "id long, text string, more string")
    out = moderate_distinct(df)
    assert out.columns[:3] == df.columns and sorted(tuple(r)[:3] for r in out.collect()) == sorted(map(tuple, df.collect()))
    chat = df.select(F.col("id").alias("msg_id"), F.lit(START).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "text")
    for made in (out, suspicion(chat)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        join = next(i for i, line in enumerate(plan.split("\n")) if "Join Inner" in line)
        side = plan.split("\n")[join + 1]
        assert "Project" in side and not re.search(r"[\[ ]text#\d+[,\]]", side) and "RepartitionByExpression" not in plan.split("Join Inner")[1]


def test_documents_of_a_chat_are_shuffled_once(spark):
    """Both sides of the join by digest read the texts through one exchange, and unchanged texts do not travel twice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES["moderated_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"FileScan parquet \[doc_id", plan)) == 1 and "ReusedExchange" in plan


def _brief_against_whole(spark, rows, texts, cfg):
    """What moderate_brief() decides, and what moderate_chat() does on the same messages with their texts."""
    messages = spark.createDataFrame(rows, "msg_id long, ts timestamp_ntz, user_id long, text_id long")
    said = spark.createDataFrame(texts, "text_id long, text string")
    cols = ["msg_id", "user_id", "level", "ad_score", "spam_reason", "spam_remaining_s", "spam_duplicate", "is_caps", "decided_by", "blocked"]
    brief = moderate_brief(messages, said, cfg).select(*cols, "n_links", "n_blocked_words", "n_bad_words")
    whole = moderate_chat(messages.join(said, "text_id"), cfg).select(*cols, F.size("links"), F.size("blocked_words"), F.size("bad_words"))
    return [sorted(map(tuple, df.collect()), key=str) for df in (brief, whole)]


def test_brief_decides_as_with_texts(spark):
    """Long and short texts, near copies, handles, shared text_ids, rows without user, time or text: the same decisions as with the texts."""
    draw = random.Random(3)
    words = ["lorem", "ipsum", "dolor", "dogs", "XRAY", "example.com", "discord", "telegram", "join", "@somehandle", "somehandle", "https://t.me/abc", "amet"]
    texts = [(i, " ".join(draw.choices(words[:3] + words[-1:] + draw.sample(words, 2), k=draw.choice((1, 3, 6, 15, 30))))) for i in range(30)]
    texts += [(30 + i, t[:-1] + draw.choice("xy")) for i, t in texts] + [(60, None), (61, ""), (61, "a second text of one id"), (62, "the same text twice"), (62, "the same text twice")]
    rows = [(i, START + timedelta(seconds=draw.randrange(4000)) if i % 25 else None, draw.choice((1, 1, 2, 3, None)), draw.randrange(64)) for i in range(300)]
    settings = Settings(bad=BAD, links=Links(ads=Ads(ttl_ms=600_000)), spam=Spam(lock_ms=0, cooldown_ms=1000, similar_ms=900_000, state_ttl_ms=1_800_000))
    brief, whole = _brief_against_whole(spark, rows, texts, settings)
    assert brief == whole and {r[4] for r in brief} >= {"similar-message-cooldown", None} and {r[2] for r in brief} >= {0, 1, 5}


def test_texts_do_not_travel_to_users(spark):
    """No exchange by user carries the texts of all messages, which take as much room as is said, not as is written."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES["moderated_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    folds = [line for line in plan if "MapInArrow work(" in line]
    assert folds and all("facts" in line for line in folds if not re.search(r"[ (]text#", line)) and any("facts" in line for line in folds)
    whole = [i for i, line in enumerate(plan) if "MapInArrow work(" in line and re.search(r"[ (]text#", line)]
    assert len(whole) == 1 and any("LeftSemi" in line for line in plan[whole[0] :])
