"""Token sets and similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions.normalize import compact, text


def whitespace_tokens(c: Column | str) -> Column:
    return F.filter(F.split(text(c), r"\s+"), lambda t: t != "")


def alnum_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"([\p{L}\p{Nd}]+)"), 1)


def token_set(c: Column | str) -> Column:
    """Distinct words without anything but letters and numbers."""
    words = F.transform(F.split(text(c), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(words, lambda t: t != ""))


def significant_tokens(c: Column | str, normalized: bool = True) -> Column:
    """The whole folded text and its folded words, each of four characters at least. NFKC runs once, before words are cut."""
    from wardline.functions.normalize import nfkc

    s = nfkc(text(c)) if normalized else text(c)
    parts = F.transform(F.split(F.lower(s), r"[^\p{L}\p{N}@]+"), lambda t: compact(F.regexp_replace(t, "^@", ""), True, False))
    return F.array_distinct(F.filter(F.concat(F.array(compact(s, True, False)), parts), lambda t: F.length(t) >= 4))


def handles(c: Column | str, normalized: bool = True) -> Column:
    """Folded @names of 4 to 32 characters, loose ones first."""
    from wardline.functions.normalize import nfkc

    s = nfkc(text(c)) if normalized else text(c)
    loose = F.regexp_extract_all(s, F.lit(fixed.HANDLE_LOOSE), 1)
    strict = F.regexp_extract_all(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(fixed.HANDLE_STRICT), 1)
    folded = F.transform(F.concat(loose, strict), lambda h: compact(h, True, False))
    return F.array_distinct(F.filter(folded, lambda h: (F.length(h) >= 4) & (F.length(h) <= 32)))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(pairs)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def utf8_units(c: Column) -> Column:
    """One character for each byte of a text in UTF-8: distances between these are in bytes, as DuckDB's are."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def levenshtein_up_to(a: Column, b: Column, most: int) -> Column:
    """The distance, or most + 1 for anything above."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def similar_messages(a: Column, b: Column, percent: int = 75) -> Column:
    """For normalized messages: equal, or near in length and in words or letters; stricter if one is shorter than 8."""
    short = (F.length(a) < 8) | (F.length(b) < 8)
    words = jaccard(token_set(a), token_set(b)) >= F.when(short, 0.85).otherwise(percent / 100)
    letters = levenshtein_up_to(a, b, 4) <= F.when(short, 2).otherwise(4)
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= 6) & (words | letters))


def is_subsequence(haystack: Column, needle: Column) -> Column:
    """Walks the haystack once, keeping how much of the needle is found."""
    found = F.aggregate(F.split(haystack, ""), F.lit(0), lambda n, ch: F.when((ch != "") & (F.substring(needle, n + 1, F.lit(1)) == ch), n + 1).otherwise(n))
    return (F.length(needle) == 0) | (found == F.length(needle))


def contains_spaced(haystack: Column, needle: Column) -> Column:
    loose = (F.length(needle) >= 5) & (F.length(haystack) <= 4 * F.length(needle)) & is_subsequence(haystack, needle)
    return (F.length(needle) >= 4) & (F.contains(haystack, needle) | loose)


def ad_similarity(a: Column, b: Column) -> Column:
    """Bigram overlap, raised if one text holds the other or is scattered in it, and by the ratio of lengths."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    j = jaccard(bigrams(a), bigrams(b))
    inside = F.contains(a, b) | F.contains(b, a)
    scattered = is_subsequence(a, b) | is_subsequence(b, a)
    boost = F.when(short < 6, 0.0).when(inside, 0.25).when(scattered, 0.15).otherwise(0.0)
    raised = F.greatest(j, j * 0.7 + boost + (short / long) * 0.1)
    return F.when((short == 0), 0.0).when(a == b, 1.0).otherwise(F.least(F.lit(1.0), raised))


def char_overlap(a: Column, b: Column) -> Column:
    """Dice coefficient of the characters as bags."""
    chars = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    shared = F.aggregate(chars, F.lit(0), lambda n, ch: n + F.least(F.length(a) - F.length(F.replace(a, ch, F.lit(""))), F.length(b) - F.length(F.replace(b, ch, F.lit("")))))
    return F.when(F.length(a) + F.length(b) == 0, 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b)))


def keyword_matches(folded: Column, tokens: Column, key: Column) -> Column:
    """Short keys must be the whole message or a word; longer ones may lie inside, the longest also scattered."""
    short = (folded == key) | F.array_contains(tokens, key)
    inside = F.contains(folded, key) | F.exists(tokens, lambda t: F.contains(t, key))
    scattered = (F.length(key) >= 5) & (F.length(folded) <= 3 * F.length(key)) & is_subsequence(folded, key)
    return F.when((F.length(key) < 2) | (F.length(folded) == 0), False).when(F.length(key) <= 3, short).otherwise(inside | scattered)


def urlish(c: Column | str) -> Column:
    return text(c).rlike(fixed.URLISH)


def char_flood(c: Column | str, most: int = 5) -> Column:
    """A character more than ``most`` times in a row."""
    return text(c).rlike(rf"(?s)(.)\1{{{most},}}")


def pattern_flood(c: Column | str, most: int = 3) -> Column:
    """Two to four characters more than ``most`` times in a row; a limit of one or less is none."""
    return text(c).rlike(rf"(?s)(.{{2,4}})\1{{{most},}}") if most > 1 else F.lit(False)


def length_within(c: Column | str, least: int, most: int) -> Column:
    n = F.length(text(c))
    return (n >= max(least, 0)) & (n <= most if most > 0 else F.lit(True))


def placed_tokens(df: DataFrame, key: str, column: str, alnum: bool = False) -> DataFrame:
    """key, token, start, end of each run without white space, or of each run of letters and digits; places count from 0, the end is past it.

    ``key`` tells rows apart. A row's pieces are summed up in the order they stand in.
    """
    inside = r"\p{L}\p{Nd}" if alnum else r"\S"
    outside = r"[^\p{L}\p{Nd}]" if alnum else r"\s"
    pieces = F.split(text(column), rf"(?<=[{inside}])(?={outside})|(?<={outside})(?=[{inside}])")
    rows = df.select(key, F.posexplode(pieces).alias("_at", "token"))
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).cast("int"))
    return placed.filter(F.col("token").rlike(f"^[{inside}]")).select(key, "token", "start", (F.col("start") + F.length("token")).alias("end"))
