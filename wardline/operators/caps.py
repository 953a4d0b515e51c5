"""Capital letters: detection and repair, in columns alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.config import Caps
from wardline.functions.normalize import clean_word, text


def _shouts(word: Column, cfg: Caps) -> Column:
    clean = clean_word(word, cfg.letters_only)
    upper = F.length(F.regexp_replace(clean, r"[^\p{Lu}]", ""))
    listed = F.lower(clean).isin([w.lower() for w in cfg.whitelist]) if cfg.whitelist else F.lit(False)
    return (F.length(clean) >= max(2, cfg.shortest)) & ~listed & (upper > 1) & (upper * 100 >= F.length(clean) * cfg.percent)


def caps_word(word: Column | str, cfg: Caps = Caps()) -> Column:
    return _shouts(text(word), cfg)


def is_caps(c: Column | str, cfg: Caps = Caps()) -> Column:
    return text(c).rlike(r"\p{Lu}\S*\p{Lu}") & F.exists(F.split(text(c), r"\s+"), lambda w: _shouts(w, cfg))  # two capitals in a word, at least


def fix_caps(c: Column | str, cfg: Caps = Caps()) -> Column:
    """Lower-cases the words that shout; white space stays as it is."""
    parts = F.split(text(c), r"(?<=\s)|(?=\s)")
    return F.array_join(F.transform(parts, lambda p: F.when(_shouts(p, cfg), F.lower(p)).otherwise(p)), "")
