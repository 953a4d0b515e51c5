"""Masks, durations, versions, templates and action lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import fixed
from wardline.config import UNIT_MS
from wardline.functions.normalize import text


def mask_full(c: Column | str, mask: str = "*") -> Column:
    """A one-character mask as often as the text is long; a longer mask as it is."""
    return F.repeat(F.lit(mask), F.length(text(c))) if len(mask) == 1 else F.lit(mask)


def mask_keep_edges(c: Column | str, mask: str = "*") -> Column:
    """First and last letter around a star for each letter between; under two letters the mask as often as the text is long."""
    letters = F.regexp_replace(text(c), r"[^\p{L}]", "")
    n = F.length(letters)
    kept = F.concat(F.substring(letters, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(letters, -1, 1))
    return F.when(n >= 2, kept).otherwise(F.repeat(F.lit(mask), F.length(text(c))))


def duration_ms(c: Column | str, default: int = 0) -> Column:
    parts = F.regexp_extract_all(F.lower(text(c)), F.lit(r"(\d+[smhdwy])"), 1)
    unit = F.create_map(*(F.lit(x) for kv in UNIT_MS.items() for x in kv))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + F.regexp_replace(p, "[a-z]", "").cast("long") * F.element_at(unit, F.right(p, F.lit(1))))
    return F.when(total == 0, F.lit(default).cast("long")).otherwise(total)


def format_duration(seconds: Column, units: tuple[str, str, str, str] = ("{d}д.", "{h}ч.", "{m}м.", "{s}с."), separator: str = " ", hide_zero: bool = True, zero: str = "0с.") -> Column:
    """Days, hours, minutes and seconds by their patterns; zero parts may be hidden, nothing left gives ``zero``."""
    n = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    values = (F.floor(n / 86400), F.floor(n / 3600) % 24, F.floor(n / 60) % 60, n % 60)
    parts = [F.when(F.lit(not hide_zero) | (v > 0), F.replace(F.lit(p), F.lit("{" + k + "}"), v.cast("string"))) for v, p, k in zip(values, units, "dhms", strict=True)]
    joined = F.concat_ws(separator, *parts)
    return F.when((n == 0) | (joined == ""), F.lit(zero)).otherwise(joined)


def seconds_left(ms: Column) -> Column:
    return F.ceil(ms / 1000).cast("int")


def newer_version(candidate: Column | str, current: Column | str) -> Column:
    """Compares runs of digits as numbers; a missing part is 0."""

    def parts(c: Column | str) -> Column:
        return F.transform(F.regexp_extract_all(text(c), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))

    signs = F.zip_with(parts(candidate), parts(current), lambda a, b: F.signum((F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast("double")))
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)) > 0, F.lit(False))


def fill(template: Column | str, values: dict[str, Column | str]) -> Column:
    """Replaces each {key} of a template."""
    out = template if isinstance(template, Column) else F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), text(value))
    return out


def parse_action(c: Column | str) -> Column:
    """struct(type, content) of ``[type] content``; a line without a type is a message."""
    s = F.trim(text(c))
    kind = F.lower(F.regexp_extract(s, r"(?s)^\[([^\]]+)\]\s*(.*)$", 1))
    return F.struct(F.when(kind == "", F.lit("message")).otherwise(kind).alias("type"), F.when(kind == "", s).otherwise(F.regexp_extract(s, r"(?s)^\[([^\]]+)\]\s*(.*)$", 2)).alias("content"))


def typed_action(action: Column) -> Column:
    """struct(target, known, valid, name, numbers) of a parsed action (type, content): whom it reaches, whether the verb is known and its
    arguments can be read, and these. Texts and commands are names; sounds have volume and pitch, titles their three times in ticks,
    effects their ticks and level from 0, teleports a world and three coordinates, items an amount. What is missing has its default."""
    kind, content = action["type"], F.trim(action["content"])
    parts, fields = F.split(content, r"\s+"), F.split(content, ";", 4)
    word = lambda i: F.get(parts, F.lit(i))
    whole = lambda c: F.when(c.rlike(r"^[+-]?\d{1,10}$"), F.expr("1.0D") * c.try_cast("double"))
    real = lambda c: c.try_cast("double")
    or_else = lambda got, given, default: F.when(given.isNull(), F.lit(float(default))).otherwise(got)
    volume = F.coalesce(real(word(1)), F.lit(1.0))
    pitch = F.when(word(1).isNull() | real(word(1)).isNotNull(), F.coalesce(real(word(2)), F.lit(1.0))).otherwise(1.0)
    numbers = (
        F.when(kind == "sound", F.array(volume, pitch))
        .when(kind.isin("title", "subtitle"), F.array(*[F.coalesce(whole(F.get(fields, F.lit(i))), F.lit(float(d))) for i, d in ((1, 10), (2, 70), (3, 20))]))
        .when(kind == "effect", F.array(or_else(whole(word(1)) * 20, word(1), 600), or_else(whole(word(2)) - 1, word(2), 0)))
        .when(kind == "teleport", F.array(*[real(word(i)) for i in range(3)]))
        .when(kind == "give-item", F.array(whole(word(1))))
        .otherwise(F.array().cast("array<double>"))
    )
    name = F.when(kind.isin("sound", "effect"), word(0)).when(kind.isin("title", "subtitle"), F.trim(F.get(fields, F.lit(0)))).when(kind == "teleport", word(3)).when(kind == "give-item", F.upper(word(0))).otherwise(content)
    target = F.lit(None).cast("string")
    for who, verbs in fixed.ACTIONS.items():
        target = F.when(kind.isin(*verbs), F.lit(who)).otherwise(target)
    valid = F.forall(numbers, lambda x: x.isNotNull()) & name.isNotNull() & ((name != "") | ~kind.isin("sound", "effect", "teleport", "give-item"))
    return F.struct(target.alias("target"), target.isNotNull().alias("known"), (target.isNotNull() & valid).alias("valid"), name.alias("name"), numbers.alias("numbers"))


def release_tag(c: Column | str) -> Column:
    """The tag of a release as its JSON names it, or null."""
    return F.nullif(F.regexp_extract(text(c), r'"tag_name"\s*:\s*"([^"]+)"', 1), F.lit(""))


def update_due(last_ms: Column, now_ms: Column, every_ms: int = 30 * 60_000) -> Column:
    """Whether releases may be looked up again: never before, or ``every_ms`` ago at least."""
    return last_ms.isNull() | (now_ms - last_ms >= every_ms)


def action_args(content: Column | str, separator: str, defaults: tuple[str, ...]) -> Column:
    """Arguments of an action by place, blank or missing ones by default; ``separator`` is a pattern."""
    parts = F.split(text(content), separator)
    return F.array(*[F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")), F.lit(d)) for i, d in enumerate(defaults)])


def webhook_body(content: Column) -> Column:
    """The JSON body of a notice that mentions nobody."""
    return F.to_json(F.struct(content.alias("content"), F.struct(F.array().cast("array<string>").alias("parse")).alias("allowed_mentions")))


def log_line(ts: Column, body: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), body)


def log_time(line: Column | str) -> Column:
    """The time a log line begins with, or null."""
    return F.try_to_timestamp(F.regexp_extract(text(line), r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
