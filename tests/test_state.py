"""Spam and suspicion: hand-traced sequences, and batch against stream."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardline.config import Caps, Links, Spam
from wardline.functions.chars import ad_similarity
from wardline.operators import policy, retention, spam
from wardline.operators.spam import SpamFold, State, step
from wardline.operators.suspicion import SuspicionFold, suspicion

START = datetime(2024, 1, 1)
SEQUENCE = [
    (0.0, "hello there friends", None),
    (1.0, "totally different text now", ("general-cooldown", 2, False)),
    (3.0, "another unrelated phrase", None),
    (5.0, "hello there friends", ("similar-message-cooldown", 5, False)),
    (5.1, "hello there friends", ("similar-message-cooldown", 5, True)),
    (20.0, "ааааааа", ("character-flood-first", 8, False)),
    (22.0, "ааааааа", ("character-flood", 6, False)),
    (28.0, "ааааааа", ("character-flood-first", 8, False)),
]


def test_spam_sequence():
    state = State()
    assert [r and tuple(r) for r in (step(Spam(), state, int(t * 1000), s, -(10**9)) for t, s, _ in SEQUENCE)] == [r for *_, r in SEQUENCE]
    assert step(Spam(), State(), 1000, "hi", 500) == ("new-player-chat-lock", 300, False)
    assert SpamFold().load(SpamFold().dump(state)) == state


def _chat(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(seconds=t), u, s) for i, (t, u, s) in enumerate(rows)], "msg_id long, ts timestamp_ntz, user_id long, text string")


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(t + 0.001 * (u or 3), u, s) for u in (1, 2) for t, s, _ in SEQUENCE] + [(30.0, 2, "see example.com and @friend"), (31.0, 2, "see example.com again")]
    rows += [(40.0, None, "see example.com now"), (40.1, None, "see example.com now"), (40.1, 1, None), (40.1, 1, "twice"), (40.1, 1, "twice")]
    df = _chat(spark, rows)
    for fold, name in ((SpamFold(), "spam"), (SuspicionFold(Links()), "ads")):
        batch = {r.msg_id: tuple(r) for r in fold.batch(df).collect()}
        df.union(_chat(spark, [(10_000.0, 9, "late")]).withColumn("msg_id", F.lit(99).cast("long"))).repartition(3).write.mode("overwrite").parquet(str(tmp_path / name))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        query = fold.stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {r.msg_id: tuple(r) for r in spark.table(name).collect()}
        assert {k: v for k, v in got.items() if k != 99} == batch
    assert [batch[i][4] for i in (16, 17, 18, 19)] == [1, 2, 1, 1]  # rows without a user stand alone


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, START, None, "")], "msg_id long, ts timestamp_ntz, user_id long, text string")
    assert {(r.msg_id, r.level) for r in SuspicionFold().batch(df).collect()} == {(1, None), (2, 0)}
    assert SuspicionFold().batch(df.filter("ts is not null")).count() == 1
    assert SpamFold().batch(df.limit(0)).count() == 0


def test_violations_and_logs(spark):
    events = spark.createDataFrame([(i, START + timedelta(seconds=i), 1, "caps") for i in range(1, 9)], "event_id long, ts timestamp, user_id long, filter string")
    assert [r.at_count for r in policy.violations(events).filter("fires").orderBy("at_count").collect()] == [1, 3, 5, 7]
    log = spark.createDataFrame([("a", 1, "[2024-01-01 00:00:00] x"), ("a", 2, "no time"), ("b", 3, "[2024-01-05 00:00:00] y")], "filter string, seq int, line string")
    assert {r.seq for r in retention.remove_oldest(log, F.lit("2024-01-05 00:00:01"), 86_400_000).collect()} == {2, 3}
    assert {r.seq for r in retention.truncate(log, 2).collect()} == {3}
    assert {r.seq for r in retention.keep_latest(log, 1).collect()} == {2, 3}


def test_measures_against_plain_ones():
    r = random.Random(1)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(4000):
        s, a, b = ("".join(r.choice(letters) for _ in range(r.randrange(0, n))) for letters, n in (("ab c\n", 30), ("abc", 12), ("abc", 12)))
        cfg = Spam(flood_chars=r.choice([0, 1, 2, 5]), flood_patterns=r.choice([1, 2, 3]))
        flood = re.search(rf"(?s)(.)\1{{{cfg.flood_chars},}}", s) or (cfg.flood_patterns > 1 and re.search(rf"(?s)(.{{2,4}})\1{{{cfg.flood_patterns},}}", s))
        assert spam.is_flood(s, cfg) == bool(flood)
        most = r.choice([0, 1, 2, 4])
        assert spam.distance_up_to(a, b, most) == min(edits(a, b), most + 1)
        least, whole = r.random(), ad_similarity(a * 3, b * 2)
        bounded = ad_similarity(a * 3, b * 2, least)
        assert bounded == whole if whole >= least else bounded < least


def test_texts_are_looked_at_once(spark):
    df = _chat(spark, [(k, k % 3, f"see example.com and @friend{k % 4}") for k in range(24)])
    both = [sorted(map(str, suspicion(df, distinct=d).collect())) for d in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 24


def test_sides_and_punishments(spark):
    cfg = policy.Settings()
    row = spark.range(1).select(*[c.alias(f"{n}_{k}") for k in (True, False) for n, c in policy.sides(F.lit(True), F.lit(True), F.lit(False), cfg, k).items()]).first()
    assert row["caps_True"] is False and row["blocked_words_True"] and row["caps_False"] and row["blocked_words_False"]
    # blocked words, bad words and capitals at once: the setting of blocked words alone says whether capitals act
    for blocked, bad, want in (("both", "badwords", True), ("blockedwords", "caps", False), ("caps", "badwords", True)):
        own = policy.Settings(caps=Caps(filter_blocked=blocked, filter_bad=bad))
        got = spark.range(1).select(*[c.alias(n) for n, c in policy.sides(F.lit(True), F.lit(True), F.lit(True), own, False).items()]).first()
        assert (got.caps, got.blocked_words, got.bad_words) == (want, blocked != "caps", bad != "caps")
    made = spark.range(1).select(policy.punish(F.array(F.lit("[console-command] mute {player}"), F.lit("[title] x"), F.lit("kick {player}")), {"player": F.lit("a%{b}")}).alias("x")).first().x
    assert made == ["mute ab", "kick ab"]
