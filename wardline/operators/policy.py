"""From detections to decisions: priorities, precedence of capitals, blocking, notices and violations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import Settings
from wardline.functions.normalize import sanitized, text
from wardline.functions.text import fill

#: Filters in order of priority; the first that is active decides.
PRIORITY = ("blocked_words", "bad_words", "links", "caps")
SPAM = "anti_spam"
BLOCKS = "block-and-notify"


def filter_types(cfg: Settings = Settings()) -> list[tuple[str, int, str, bool]]:
    """filter, priority, mode, enabled."""
    own = {"blocked_words": cfg.blocked, "bad_words": cfg.bad, "links": cfg.links, "caps": cfg.caps}
    return [(name, i, own[name].mode, own[name].enabled) for i, name in enumerate(PRIORITY)] + [(SPAM, len(PRIORITY), BLOCKS, cfg.spam.enabled)]


def first_active(active: dict[str, Column]) -> Column:
    """The first active filter by priority, or null."""
    return F.coalesce(*[F.when(active[name], F.lit(name)) for name in PRIORITY if name in active])


def blocked_by(decider: Column, cfg: Settings = Settings()) -> Column:
    """Whether the deciding filter blocks: any mode but block-and-notify rewrites. Later filters are not asked."""
    modes = {name: mode for name, _, mode, _ in filter_types(cfg)}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in modes.items() for x in kv))[decider] == BLOCKS, F.lit(False))


def sides(caps: Column, blocked: Column, bad: Column, cfg: Settings, notices: bool) -> dict[str, Column]:
    """Which of capitals, blocked words and bad words act on a message, for its text or for its notices.

    Where blocked words are active their setting alone says whether capitals act, else that of bad words.
    """
    c = cfg.caps
    by_blocked, by_bad = (c.notify_blocked, c.notify_bad) if notices else (c.filter_blocked, c.filter_bad)
    caps_on = F.when(blocked, F.lit(by_blocked != "blockedwords")).when(bad, F.lit(by_bad != "badwords")).otherwise(True)
    return {"caps": caps & caps_on, "blocked_words": blocked & (~caps | F.lit(by_blocked != "caps")), "bad_words": bad & (~caps | F.lit(by_bad != "caps"))}


def applies(name: str, bypass: str | None) -> Column:
    """Whether a filter looks at a row; ``bypass`` names a column with the filters that do not, null for none."""
    return F.lit(True) if bypass is None else ~F.coalesce(F.array_contains(bypass, name), F.lit(False))


def decide(df: DataFrame, cfg: Settings = Settings(), bypass: str | None = None) -> DataFrame:
    """Adds decided_by and blocked to blocked_words, bad_words, links (arrays) and is_caps.

    The first filter in order of priority that is enabled, not bypassed, has found something, and is not passed over for capitals or words.
    """
    enabled = {name: F.lit(on) & applies(name, bypass) for name, _, _, on in filter_types(cfg)}
    active = {name: (F.size(name) > 0) & enabled[name] for name in PRIORITY[:3]} | {"caps": F.col("is_caps") & enabled["caps"]}
    active |= sides(active["caps"], active["blocked_words"], active["bad_words"], cfg, False)
    return df.withColumn("decided_by", first_active(active)).withColumn("blocked", blocked_by(F.col("decided_by"), cfg))


def bypass_sets(messages: DataFrame, users: DataFrame | None = None, groups: DataFrame | None = None, members: DataFrame | None = None, cfg: Settings = Settings()) -> DataFrame:
    """Adds ``bypassed``, the sorted names of the filters that do not look at a message.

    These are the disabled ones, those that its user is exempt from (users: user_id, filter, from permissions or lists of names), and those
    that one of the user's groups is exempt from (groups: group, filter; members: user_id, group). Messages without a user have the
    disabled ones only; null and repeated rows of the tables add nothing.
    """
    off = F.array(*[F.lit(name) for name, _, _, on in filter_types(cfg) if not on]).cast("array<string>")
    exempt = [] if users is None else [users.select("user_id", "filter")]
    if groups is not None and members is not None:
        exempt.append(members.join(groups, "group").select("user_id", "filter"))
    if not exempt:
        return messages.withColumn("bypassed", F.array_sort(off))
    both = exempt[0] if len(exempt) == 1 else exempt[0].union(exempt[1])
    own = both.filter("user_id IS NOT NULL AND filter IS NOT NULL").groupBy("user_id").agg(F.collect_set("filter").alias("_own"))
    none = F.array().cast("array<string>")
    return messages.join(own, "user_id", "left").withColumn("bypassed", F.array_sort(F.array_union(F.coalesce("_own", none), off))).drop("_own")


def spam_blocks(reason: Column) -> Column:
    """Every spam result blocks but the first flood, which is delivered."""
    return reason.isNotNull() & (reason != "character-flood-first")


def not_exempt(df: DataFrame, exemptions: DataFrame, keys: Iterable[str] = ("user_id", "filter")) -> DataFrame:
    """Rows whose user is not exempt from the filter."""
    return df.join(exemptions.select(*keys).distinct(), list(keys), "left_anti")


def violations(events: DataFrame, stages: DataFrame | Iterable[int] = (1, 3, 5, 7), order: Iterable[str] = ("ts", "event_id"), keep_ms: int | None = None) -> DataFrame:
    """Adds at_count, the running number of a user's violations of a filter, and fires, whether a stage has exactly that number.

    With ``keep_ms`` the count starts anew after a gap longer than that; ``order`` then begins with the time.

    The count runs along the partitions of a user and a filter. A frequent violator's rows are sorted by their window, not collected.
    """
    order, own = list(order), ["filter", "user_id"]
    if keep_ms is None:
        counted = events.withColumn("at_count", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    else:
        line = Window.partitionBy(*own).orderBy(*order)
        gap = F.unix_millis(F.to_timestamp(order[0])) - F.unix_millis(F.to_timestamp(F.lag(order[0]).over(line)))
        spans = events.withColumn("_new", F.coalesce((gap > keep_ms).cast("int"), F.lit(0))).withColumn("_span", F.sum("_new").over(line))
        counted = spans.withColumn("at_count", F.row_number().over(Window.partitionBy(*own, "_span").orderBy(*order))).drop("_new", "_span")
    if isinstance(stages, DataFrame):
        own = stages.select("at_count").distinct().withColumn("fires", F.lit(True))  # as large as the settings say; Spark chooses the join
        return counted.join(own, "at_count", "left").withColumn("fires", F.coalesce("fires", F.lit(False)))
    return counted.withColumn("fires", F.col("at_count").isin(*stages))


def notices(df: DataFrame, cfg: Settings = Settings(), bypass: str | None = None) -> DataFrame:
    """msg_id, user_id, filter, item: a row for every filter that announces a message and each distinct thing it found.

    Where links block, the item is the whole message.
    """
    active = {name: (F.size(name) > 0) & applies(name, bypass) for name in PRIORITY[:3]}
    acts = sides(F.col("is_caps") & applies("caps", bypass), active["blocked_words"], active["bad_words"], cfg, True)
    whole = F.array("text")
    items = {
        "blocked_words": F.array_distinct("blocked_words"),
        "bad_words": F.array_distinct("bad_words"),
        "links": whole if cfg.links.mode == BLOCKS else F.array_distinct("links"),
        "caps": whole,
    }
    acts["links"] = active["links"]
    rows = F.array(*[F.struct(F.lit(n).alias("filter"), F.when(acts[n], items[n]).otherwise(F.array().cast("array<string>")).alias("items")) for n in PRIORITY])
    return df.select("msg_id", "user_id", F.inline(rows)).select("msg_id", "user_id", "filter", F.explode("items").alias("item"))


#: Admins that a notice is copied to by each task; more are dealt out first.
ADMINS = 10_000


def fan_out(notes: DataFrame, admins: DataFrame, self_too: bool = False, preferences: DataFrame | None = None) -> DataFrame:
    """Every notice to every admin (admin_id) but its author: by definition as many rows as notices times admins.

    Only admins who are online count, where the table says so (online), and who have not switched notices off (preferences: user_id,
    enabled; the last word is the table's only row of a user). Notices without an author go to all. Admins are folded into sorted blocks of
    ADMINS ids, so notices meet blocks, not rows.
    """
    few = admins.filter(F.coalesce(F.col("online"), F.lit(False))) if "online" in admins.columns else admins
    few = few.select("admin_id").filter("admin_id IS NOT NULL").distinct()
    if preferences is not None:
        few = few.join(preferences.filter(~F.col("enabled")).select(F.col("user_id").alias("admin_id")), "admin_id", "left_anti")
    n = few.count()
    if n <= ADMINS:
        blocks = few.agg(F.array_sort(F.collect_list("admin_id")).alias("_admins"))
        met = notes.join(F.broadcast(blocks))
    else:
        parts = -(-n // ADMINS)
        blocks = few.groupBy(F.pmod(F.xxhash64("admin_id"), F.lit(parts)).alias("_part")).agg(F.collect_list("admin_id").alias("_admins"))
        met = notes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(blocks, "_part").drop("_part")
    out = met.withColumn("admin_id", F.explode("_admins")).drop("_admins")
    return out if self_too else out.filter(~F.col("admin_id").eqNullSafe(F.col("user_id")))


def preferred(preferences: DataFrame, changes: DataFrame) -> DataFrame:
    """user_id, enabled after changes (user_id, enabled, ord) in order; a user without a row gets notices."""
    last = changes.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.max_by("enabled", "ord").alias("enabled"))
    return preferences.select("user_id", "enabled").join(last.select("user_id"), "user_id", "left_anti").unionByName(last)


def punish(actions: Column, values: dict[str, Column]) -> Column:
    """Console commands of a stage with their sign gone and sanitized values filled in; other actions are passed over."""
    console = F.filter(actions, lambda a: ~a.rlike(r"^\s*\[") | a.rlike(r"(?i)^\s*\[console-command\]"))
    bare = F.transform(console, lambda a: F.trim(F.regexp_replace(a, r"(?i)^\s*\[console-command\]", "")))
    safe = {k: sanitized(v) for k, v in values.items()}
    return F.transform(F.filter(bare, lambda a: a != ""), lambda a: fill(a, safe))


def spam_message(reason: Column) -> Column:
    """The settings path of a spam result's notice."""
    same = reason.isin("character-flood", "character-flood-first")
    return F.when(same, F.lit("character-flood")).otherwise(reason)


def route_command(c: Column | str, commands: Iterable[str]) -> Column:
    """struct(label, rest, filtered): only what follows the label is filtered, and only for listed commands."""
    s = text(c)
    parts = F.split(s, " ", 2)
    label = F.lower(F.regexp_replace(F.get(parts, F.lit(0)), "^/", ""))
    rest = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    on = F.startswith(s, F.lit("/")) & label.isin(*commands) & (F.trim(rest) != "")
    return F.struct(label.alias("label"), rest.alias("rest"), on.alias("filtered"))


def conflicts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """msg_id, expected, actual of messages that were not delivered as decided; a null text is a blocked message."""
    both = expected.select("msg_id", F.col("final_text").alias("expected")).join(actual.select("msg_id", F.col("final_text").alias("actual")), "msg_id")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def reapplied(decided: DataFrame, seen: DataFrame, again_ms: int = 250, keep_ms: int = 3_000) -> DataFrame:
    """msg_id, final_text, blocked, slot of messages that something else changed after their decision, which then holds once more.

    decided: msg_id, at_ms, final_text, blocked; seen: msg_id, at_ms, text as it stands. A decision counts for ``keep_ms``; the same text is
    given once for each ``again_ms`` since the decision (slot). A later decision of the same message replaces an earlier one; null ids meet
    nothing.
    """
    last = decided.groupBy("msg_id").agg(F.max_by(F.struct("at_ms", "final_text", "blocked"), F.struct("at_ms", "final_text")).alias("d")).select("msg_id", "d.*")
    changed = seen.select("msg_id", F.col("at_ms").alias("_seen"), "text").join(last, "msg_id")
    changed = changed.filter((F.col("_seen") >= F.col("at_ms")) & (F.col("_seen") - F.col("at_ms") <= keep_ms) & ~F.col("text").eqNullSafe(F.col("final_text")))
    slot = F.floor((F.col("_seen") - F.col("at_ms")) / again_ms)
    return changed.select("msg_id", "final_text", "blocked", slot.alias("slot")).distinct()


def online(registry: DataFrame, until: Column | None = None) -> DataFrame:
    """user_id, name of who is online: the last of a user's rows (user_id, name, kind, ts) up to ``until`` is a join. Of rows of one time a quit is the last."""
    rows = registry if until is None else registry.filter(F.col("ts") <= until)
    last = rows.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("kind", "name"), F.struct("ts", (F.col("kind") == "quit").alias("q"), "name")).alias("r"))
    return last.filter("r.kind = 'join'").select("user_id", "r.name")
