"""The whole pipeline: blocked words, bad words and links one after another on the masked text, capitals on the original, then a decision."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.config import Settings
from wardline.functions.normalize import text
from wardline.operators import policy
from wardline.operators.brief import BriefFold, answers, facts
from wardline.operators.caps import fix_caps, is_caps
from wardline.operators.fold import along
from wardline.operators.links import SPAN, find_links
from wardline.operators.spam import SpamFold
from wardline.operators.suspicion import SuspicionFold, ads
from wardline.operators.words import MATCH, find_words, found_words, replace_spans, rewrite

#: Columns that moderation adds; those of a table that have these names are replaced.
ADDED = ("blocked_words", "bad_words", "links", "is_caps", "filtered", "final_text", "decided_by", "blocked")


def _words(df: DataFrame, cfg: Settings, names: Iterable[str], bypass: str | None) -> DataFrame:
    """Adds is_caps, blocked_words, bad_words and filtered; disabled filters add no work.

    Where capitals take precedence over a word filter that found something, the message is looked at again without that filter.
    """
    spark, s = df.sparkSession, text("text")
    none = F.array().cast(MATCH)
    out = df.withColumn("is_caps", is_caps("text", cfg.caps) & policy.applies("caps", bypass) if cfg.caps.enabled else F.lit(False))
    look = {name: find_words(spark, own, names) if own.enabled and own.words else None for name, own in (("blocked_words", cfg.blocked), ("bad_words", cfg.bad))}

    def found(name: str, c, on=True):
        return look[name](F.when(policy.applies(name, bypass) & F.lit(True) & on, c)) if look[name] else none

    out = out.withColumn("_blocked", found("blocked_words", s)).withColumn("_bad", found("bad_words", rewrite(s, F.col("_blocked"), cfg.blocked)))
    if cfg.caps.enabled and cfg.caps.filter_bad == "caps":
        out = out.withColumn("_bad_gone", F.col("is_caps") & (F.size("_bad") > 0)).withColumn("_bad", F.when(F.col("_bad_gone"), none).otherwise(F.col("_bad")))
    else:
        out = out.withColumn("_bad_gone", F.lit(False))
    if cfg.caps.enabled and cfg.caps.filter_blocked == "caps":
        gone = F.col("is_caps") & (F.size("_blocked") > 0)
        out = out.withColumn("_gone", gone).withColumn("_again", found("bad_words", s, F.col("_gone") & ~F.col("_bad_gone")))
        out = out.withColumn("_bad", F.when(F.col("_gone"), F.col("_again")).otherwise(F.col("_bad"))).withColumn("_blocked", F.when(F.col("_gone"), none).otherwise(F.col("_blocked")))
    masked = rewrite(rewrite(s, F.col("_blocked"), cfg.blocked), F.col("_bad"), cfg.bad)
    out = out.withColumn("filtered", masked).withColumn("blocked_words", found_words(F.col("_blocked"))).withColumn("bad_words", found_words(F.col("_bad")))
    return out.drop("_blocked", "_bad", "_bad_gone", "_gone", "_again")


def _finished(df: DataFrame, cfg: Settings, bypass: str | None) -> DataFrame:
    """From the spans of links in filtered (_spans) to links, the final text and the decision."""
    out = df
    if cfg.links.mode != policy.BLOCKS:
        out = out.withColumn("filtered", replace_spans(F.col("filtered"), F.col("_spans"), lambda m: F.lit(cfg.links.replacement)))
    out = out.withColumn("links", F.transform("_spans", lambda m: m["text"])).drop("_spans")
    acts = policy.sides(F.col("is_caps"), F.size("blocked_words") > 0, F.size("bad_words") > 0, cfg, False)
    return policy.decide(out.withColumn("final_text", F.when(acts["caps"], fix_caps("filtered", cfg.caps)).otherwise(F.col("filtered"))), cfg, bypass)


def moderate(df: DataFrame, cfg: Settings = Settings(), names: Iterable[str] = (), bypass: str | None = None) -> DataFrame:
    """Stateless moderation of rows with a text: adds blocked_words, bad_words, links, is_caps, filtered, final_text, decided_by and blocked.

    ``bypass`` names a column with the filters that do not look at a row (see policy.bypass_sets). Null texts count as empty.
    """
    out = _words(df.drop(*ADDED), cfg, names, bypass)
    spans = find_links(df.sparkSession, cfg.links, names)(F.when(policy.applies("links", bypass), F.col("filtered"))) if cfg.links.enabled else F.array().cast(SPAN)
    return _finished(out.withColumn("_spans", spans), cfg, bypass)


def _once(df: DataFrame, bypass: str | None, analyze) -> DataFrame:
    """Adds to each row what ``analyze`` makes of its text and bypassed filters, which is worked out once for each and joined by their digest.

    Rows go to the join without their text, which comes back with what was made of it: a text is shuffled once, however often it is said.
    """
    own = F.lit("") if bypass is None else F.array_join(F.array_sort(F.coalesce(bypass, F.array().cast("array<string>"))), ",")
    rows = df.drop(*ADDED)
    keyed = rows.withColumn("_none", F.col("text").isNull()).withColumn("_key", F.coalesce(F.sha2(F.concat(own, F.lit("\x1f"), text("text")), 256), F.lit("")))  # never null: else a filter for it parts the two scans
    some = keyed.select("_key", text("text").alias("text"), *([bypass] if bypass else [])).dropDuplicates(["_key"])
    done = analyze(some).drop(*([bypass] if bypass else []))
    back = [F.when(~F.col("_none"), F.col("text")).alias("text") if c == "text" else c for c in rows.columns]
    return keyed.drop("text").join(done, "_key").select(*back, *(c for c in done.columns if c not in ("_key", "text")))


def moderate_distinct(df: DataFrame, cfg: Settings = Settings(), names: Iterable[str] = (), bypass: str | None = None) -> DataFrame:
    """moderate() where texts repeat: every text is analyzed once and joined back to its rows."""
    return _once(df, bypass, lambda some: moderate(some, cfg, names, bypass))


def moderate_chat(messages: DataFrame, cfg: Settings = Settings(), names: Iterable[str] = (), bypass: str | None = None) -> DataFrame:
    """Moderation of msg_id, ts, user_id, text with each user's spam and advertising record.

    Every different text is analyzed once; then one pass over each user's messages steps both records, so a row comes out once whatever its
    msg_id, null and repeated ones included. Messages without a user stand alone, those without a time have no record. A spam result
    blocks before anything else; content is analyzed all the same and raises suspicion.
    """
    spark, on = messages.sparkSession, cfg.links.enabled

    def analyze(some: DataFrame) -> DataFrame:
        out = _words(some, cfg, names, bypass)
        return out.withColumn("_ads", ads(spark, cfg.links, names)(F.when(policy.applies("links", bypass), F.col("filtered")))) if on else out

    folds = [(SuspicionFold(cfg.links, names, True), {"text": ("filtered", "text"), "ads": "_ads"})] if on else []
    done = _once(messages.drop("level", "ad_score", "spam_reason", "spam_remaining_s", "spam_duplicate"), bypass, analyze)
    if cfg.spam.enabled:
        watched = policy.applies(policy.SPAM, bypass)
        first = F.unix_millis(F.col("first_seen").cast("timestamp")) if "first_seen" in messages.columns else F.lit(None).cast("long")
        done = done.withColumn("_first", first).withColumn("_watched", watched)
        folds.append((SpamFold(cfg.spam), {"text": "text", "first_seen": "_first", "watched": "_watched"}))
    own = F.col("filtered")  # a text that no filter changes does not travel twice
    out = along(done.withColumn("filtered", F.when(own != text("text"), own)), *folds).withColumn("filtered", F.coalesce(own, text("text")))
    if on:
        out = out.withColumn("_spans", F.coalesce("links", F.col("_ads.links"), F.array().cast(SPAN))).drop("links", "_ads")
    else:
        out = out.withColumn("_spans", F.array().cast(SPAN))
    out = _finished(out, cfg, bypass)
    if cfg.spam.enabled:
        stops = policy.spam_blocks(F.col("spam_reason"))
        out = out.withColumn("decided_by", F.when(stops, F.lit(policy.SPAM)).otherwise(F.col("decided_by"))).withColumn("blocked", stops | F.col("blocked"))
    return out.drop("_first", "_watched")


def moderate_brief(messages: DataFrame, texts: DataFrame, cfg: Settings = Settings(), names: Iterable[str] = ()) -> DataFrame:
    """What moderate_chat() decides on msg_id, ts, user_id, text_id, without the texts, which are in text_id, text: numbers of what was found in their place.

    Messages go to their user's task with the facts of their text (see operators.brief); only users for whom an answer is yes are stepped
    with the texts. A message comes out for every text of its text_id, and not at all if there is none.
    """
    spark, on = messages.sparkSession, cfg.links.enabled
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = texts.select(F.col("text_id").cast("long").alias("text_id"), text("text").alias("text")).filter("text_id IS NOT NULL").repartition(n, "text_id")
    keyed = own.withColumn("_h", F.xxhash64("text"))  # two texts of one id are told apart
    same = lambda a, b: a.bitwiseXOR(b) == 0  # noqa: E731  as a key it would have the texts shuffled again
    found = [F.size("blocked_words").alias("n_blocked_words"), F.size("bad_words").alias("n_bad_words")]
    known = _words(keyed, cfg, names, None).withColumn("_f", facts(spark, cfg, names)("text", "filtered"))
    known = known.select("text_id", "_h", "is_caps", *found, F.col("_f.facts").alias("facts"), F.col("_f.n_links").alias("_n_links"))
    rows = messages.select("msg_id", "ts", "user_id", F.col("text_id").cast("long").alias("text_id")).join(known, "text_id")
    stepped = along(rows, (BriefFold(cfg, names), {"facts": "facts", "id": "text_id", "h": "_h"})).withColumn("n_links", F.coalesce("n_links", "_n_links"))

    asked = stepped.select("user_id", F.explode("asks").alias("_q")).select("user_id", "_q.*")
    for side in ("a", "b"):
        with_text = keyed.join(asked.hint("shuffle_hash"), (F.col("text_id") == F.col(side)) & same(F.col("_h"), F.col(f"{side}h")))
        if on:  # links are sought in what the word filters leave
            split = with_text.withColumn("_whole", F.when(F.col("kind") == "spam", F.col("text"))).withColumn("text", F.when(F.col("kind") != "spam", F.col("text")))
            with_text = _words(split, cfg, names, None).withColumn("text", F.coalesce("_whole", "filtered"))
        asked = with_text.select("user_id", *(c for c in asked.columns if c not in ("user_id", side, f"{side}h")), F.col("text").alias(f"_{side}"))
    again = asked.filter(answers("kind", "_a", "_b", "arg")).select("user_id").distinct()

    lone = F.when(F.col("user_id").isNull(), F.xxhash64("msg_id", "ts", "text_id"))  # rows without a user ask nothing and are dealt out
    keys = [F.col("user_id").isNull().alias("_null"), F.coalesce("user_id", lone).alias("_who")]
    again = again.select(F.lit(False).alias("_null"), F.col("user_id").alias("_who"))
    stepped = stepped.select("*", *keys)
    settled = stepped.join(again, ["_null", "_who"], "left_anti")
    open_rows = stepped.select("msg_id", "ts", "user_id", "text_id", "_h", "_null", "_who").join(again, ["_null", "_who"], "left_semi").select("msg_id", "ts", "user_id", "text_id", "_h")
    ids = open_rows.select(F.col("text_id").alias("_id"), F.col("_h").alias("_idh")).hint("shuffle_hash")
    some = keyed.join(ids, (F.col("text_id") == F.col("_id")) & same(F.col("_h"), F.col("_idh")), "left_semi").dropDuplicates(["text_id", "_h"])
    looked = _words(some, cfg, names, None)
    folds, adds = [], ["msg_id", "ts", "user_id", "is_caps", "n_blocked_words", "n_bad_words", "n_links"]
    if on:
        looked = looked.withColumn("_ads", ads(spark, cfg.links, names)(F.col("filtered")))
        folds.append((SuspicionFold(cfg.links, names, True), {"text": ("filtered", "text"), "ads": "_ads"}))
        adds += ["level", "ad_score"]
    if cfg.spam.enabled:
        looked = looked.withColumn("_first", F.lit(None).cast("long"))
        folds.append((SpamFold(cfg.spam), {"text": "text", "first_seen": "_first"}))
        adds += ["spam_reason", "spam_remaining_s", "spam_duplicate"]
    looked = looked.select(F.col("text_id").alias("_id"), F.col("_h").alias("_idh"), "text", F.when(F.col("filtered") != F.col("text"), F.col("filtered")).alias("filtered"), "is_caps", *found, *(["_ads"] if on else []), *(["_first"] if cfg.spam.enabled else []))
    said = open_rows.join(looked, (F.col("text_id") == F.col("_id")) & same(F.col("_h"), F.col("_idh"))).drop("text_id", "_h", "_id", "_idh")
    whole = along(said, *folds)
    whole = whole.withColumn("n_links", F.size(F.coalesce("links", F.col("_ads.links"), F.array().cast(SPAN))) if on else F.lit(0))
    out = settled.select(*adds).unionByName(whole.select(*adds))

    filled = {name: F.array_repeat(F.lit(""), F.col(f"n_{name}")) for name in ("blocked_words", "bad_words", "links")}
    out = policy.decide(out.withColumns(filled), cfg).drop(*filled)
    if cfg.spam.enabled:
        stops = policy.spam_blocks(F.col("spam_reason"))
        out = out.withColumn("decided_by", F.when(stops, F.lit(policy.SPAM)).otherwise(F.col("decided_by"))).withColumn("blocked", stops | F.col("blocked"))
    return out
