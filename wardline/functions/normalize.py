"""Normalization as Column expressions; nulls count as empty texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import fixed

_FROM = "".join(fixed.FOLD.values())
_TO = "".join(letter * len(group) for letter, group in fixed.FOLD.items())
#: A letter or digit, before or after folding.
LETTER = r"\p{L}\p{Nd}"
#: Characters that fold to a letter though they are none.
LETTER_LIKE = "@!|$×"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility composition, for which Spark has no function; ASCII texts, which it leaves as they are, do not go to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def map_chars(c: Column | str) -> Column:
    """Lower case, look-alikes folded, ignored characters gone; separators stay."""
    return F.translate(F.lower(text(c)), _FROM + fixed.IGNORED, _TO)


def is_letter_or_digit(c: Column | str) -> Column:
    return text(c).rlike(f"^[{LETTER}]$")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)(.)\1+", "$1")


def compact(c: Column | str, collapsed: bool = True, normalized: bool = True) -> Column:
    """Folded letters and digits only; with ``normalized``, after NFKC."""
    c = nfkc(text(c)) if normalized else text(c)
    out = F.regexp_replace(map_chars(c), f"[^{LETTER}]", "")
    return collapse(out) if collapsed else out


def latin(c: Column | str) -> Column:
    """The form in which look-alike words meet; the same as compact()."""
    return compact(c)


def for_similarity(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(nfkc(F.lower(text(c))), r"(?iu)(\p{L})\1+", "$1"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def lexical(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(text(c), r"[^\p{L}]", ""))


def has_obfuscation(c: Column | str) -> Column:
    """A leet character beside a folded letter, or a separator after some letter and right before another."""
    s = F.regexp_replace(text(c), "[" + fixed.IGNORED + "ЪЬ]", "")
    letter = f"[{LETTER}{LETTER_LIKE}]"
    leet = "[" + fixed.LEET.replace("$", r"\$") + "]"
    return s.rlike(f"{letter}{leet}|{leet}{letter}") | s.rlike(f"(?s){letter}.*[^{LETTER}{LETTER_LIKE}]{letter}")


def domain_fold(c: Column) -> Column:
    """Look-alikes of Latin letters in a lower-case domain."""
    one = {k: v for k, v in fixed.DOMAIN_FOLD.items() if len(v) == 1}
    gone = "".join(k for k, v in fixed.DOMAIN_FOLD.items() if not v)
    return F.translate(F.replace(c, F.lit("я"), F.lit("ya")), "".join(one) + gone, "".join(one.values()))


def tld_alias(c: Column) -> Column:
    """The last label by its usual name; a text without a dot is looked up whole."""
    last = F.lower(F.substring_index(c, ".", -1))
    alias = F.element_at(F.create_map(*(F.lit(x) for kv in fixed.TLD_ALIASES.items() for x in kv)), last)
    dots = F.instr(c, ".") > 0
    head = F.regexp_replace(c, r"[^.]*$", "")
    whole = ~dots | ((F.length(head) > 1) & (F.length(last) > 0))
    return F.when(alias.isNotNull() & whole, F.concat(head, alias)).otherwise(c)


def latin_domain(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(text(c)), r"[․·,;\s]", ".")
    s = F.regexp_replace(domain_fold(s), "[^a-z0-9_.-]", "")
    return tld_alias(F.regexp_replace(F.regexp_replace(s, r"\.+", "."), r"^\.+|\.+$", ""))


def is_latin_label(c: Column | str) -> Column:
    return text(c).rlike("^[A-Za-z0-9_-]{1,63}$")


def is_domain_token(c: Column | str) -> Column:
    """A label as it is, or short enough and one label once folded; longer words in Cyrillic alone are words."""
    s = text(c)
    cyrillic = s.rlike(r"\p{IsCyrillic}") & ~s.rlike("[A-Za-z]") & (F.length(s) > 3)
    folded = latin_domain(s)
    fits = (F.length(s) >= 1) & (F.length(s) <= 63)
    return fits & (is_latin_label(s) | (~cyrillic & is_latin_label(folded) & (F.length(folded) <= 24)))


def latin_letters(c: Column | str) -> Column:
    return F.length(F.regexp_replace(F.lower(text(c)), "[^a-z]", ""))


def for_detection(c: Column | str) -> Column:
    """What of a link is compared: host labels in Latin letters, joined by dots."""
    s = F.regexp_replace(text(c), fixed.INVISIBLE, "")
    s = F.regexp_replace(F.regexp_replace(s, fixed.SCHEME, ""), r"(?s)[/?#].*$", "")
    s = F.regexp_replace(F.regexp_replace(s, fixed.OBFUSCATED_DOT.replace("(?i)", "(?iu)"), "."), r"[^\p{L}\p{N}]+", ".")
    return tld_alias(domain_fold(F.lower(F.regexp_replace(F.regexp_replace(s, r"\.{2,}", "."), r"^[-.]+|[-.]+$", ""))))


def strip_colors(c: Column | str) -> Column:
    """Drops colour codes: a sign and a code, hex codes with or without it, and tags."""
    s = F.regexp_replace(text(c), r"(?i)[&§]x(?:[&§][0-9a-f]){6}|[&§]?#[0-9a-f]{6}", "")
    s = F.regexp_replace(s, r"(?i)</?(?:#[0-9a-f]{6}|gradient[^>]*|rainbow[^>]*|bold|italic|underlined|strikethrough|obfuscated|reset|black|dark_[a-z]+|gold|gr[ae]y|blue|green|aqua|red|light_purple|yellow|white)>", "")
    return F.regexp_replace(s, r"(?i)[&§][0-9a-fk-orx]", "")


def translated_colors(c: Column | str) -> Column:
    """Colour codes in the one form that clients read, six signed digits; tags go. ``&#rrggbb``, ``&x&r&r&g&g&b&b`` and ``#rrggbb`` are colours,
    the last unless a hex digit stands before it; so are the codes 0 to f, and styles keep their letter. Private-use characters mark what is done."""
    digit, done, end, gone = "[0-9a-fA-F]", "\ue000", "\ue001", "\ue002"
    s = F.regexp_replace(text(c), f"<[^>]{{0,39}}>", gone)
    s = F.regexp_replace(s, f"[&§]#({digit}{{6}})", f"{done}$1{end}")
    s = F.regexp_replace(s, r"([&§])[xX]" + rf"\1({digit})" * 6, f"{done}$2$3$4$5$6$7{end}")
    s = F.regexp_replace(s, f"(?<![0-9a-fA-F{end}])#({digit}{{6}})", f"{done}$1{end}")
    for i, colour in enumerate(fixed.PALETTE):
        s = F.regexp_replace(s, f"(?i)[&§]{i:x}", done + colour + end)
    s = F.regexp_replace(s, f"[&§]([{fixed.STYLE_CODES}])", "§$1")
    for code in fixed.STYLE_CODES:
        s = F.replace(F.replace(s, F.lit("&" + code.upper()), F.lit("§" + code)), F.lit("§" + code.upper()), F.lit("§" + code))
    parts = F.split(s, done)
    spelt = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.lit("§x"), F.regexp_replace(F.lower(F.substring(p, 1, 6)), "(.)", "§$1"), F.substring(p, 8, 1 << 30)))
    return F.replace(F.concat(F.get(parts, F.lit(0)), F.array_join(spelt, "")), F.lit(gone), F.lit(""))


def sanitized(c: Column | str) -> Column:
    """A value safe inside a command: no control characters, percent signs or braces, 128 characters at most."""
    return F.substring(F.regexp_replace(text(c), r"[\x00-\x1f\x7f%{}]", ""), 1, 128)


def escaped_json(c: Column | str) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    out = F.to_json(F.struct(text(c).alias("s")))
    return F.substring(out, F.lit(7), F.length(out) - 8)


def clean_word(c: Column | str, letters_only: bool = True) -> Column:
    return F.regexp_replace(text(c), r"[^\p{L}]", "") if letters_only else text(c)
