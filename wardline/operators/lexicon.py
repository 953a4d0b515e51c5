"""Dictionaries as DataFrames, and as matchers for tasks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.chars import compact
from wardline.functions.normalize import compact as compact_column

#: Folded words of dictionaries have at least this length; fuzzy forms come from words of at least the second.
SHORTEST, FUZZY_FROM = 3, 6


def lexicon(spark: SparkSession, bad: Iterable[str] = (), safe: Iterable[str] = (), blocked: Iterable[str] = ()) -> DataFrame:
    """kind, word, norm, ord."""
    rows = [(kind, w, compact(w), i) for kind, ws in (("bad", bad), ("safe", safe), ("blocked", blocked)) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "kind string, word string, norm string, ord int")


def active_words(words: DataFrame, kind: str) -> DataFrame:
    """norm, ord of the words that can match: long enough, not safe (for bad words), each once."""
    own = words.filter((F.col("kind") == kind) & (F.length("norm") >= SHORTEST)).groupBy("norm").agg(F.min("ord").alias("ord"))
    return own.join(words.filter((F.col("kind") == "safe") & (F.length("norm") >= 2)), "norm", "left_anti") if kind == "bad" else own


def deletion_variants(words: DataFrame, safe: DataFrame | None = None, least: int = FUZZY_FROM) -> DataFrame:
    """reduced, norm, ord: words less one character; the first word in order that gives a form owns it.

    words: norm, ord. Forms that are words entered before the one that gives them, or safe words, do not count.
    """
    long = words.filter(F.length("norm") >= max(5, least))
    cut = F.explode(F.sequence(F.lit(1), F.length("norm"))).alias("skip")
    forms = long.select("norm", "ord", cut).withColumn("reduced", F.expr("concat(left(norm, skip - 1), substring(norm, skip + 1))"))
    forms = forms.join(words.select(F.col("norm").alias("reduced"), F.col("ord").alias("known")), "reduced", "left").filter("known IS NULL OR known > ord")
    if safe is not None:
        forms = forms.join(safe.select(F.col("norm").alias("reduced")), "reduced", "left_anti")
    first = F.row_number().over(Window.partitionBy("reduced").orderBy("ord", "skip"))
    return forms.withColumn("rn", first).filter("rn = 1").select("reduced", "norm", "ord")


def exact_matches(docs: DataFrame, words: DataFrame, safe: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lowest level: whole tokens equal to a dictionary word; a token is not collapsed, so words with doubled letters never match.

    Tokens are folded where they stand, and meet the dictionary in a broadcast join, or a shuffled one once the dictionary is large.
    Returns the key, token, norm.
    """
    from wardline.functions.normalize import nfkc

    tokens = F.explode(F.regexp_extract_all(nfkc(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), 1)).alias("token")
    found = docs.select(key, tokens).withColumn("norm", compact_column("token", False, False)).filter(F.length("norm") >= SHORTEST)
    out = found.join(words.select("norm").distinct(), "norm")
    out = out if safe is None else out.join(safe.select("norm").distinct(), "norm", "left_anti")
    return out.select(key, "token", "norm")


class Matchers:
    """What the word engine looks up, built once and sent to tasks: automata over words, safe words and fuzzy forms."""

    def __init__(self, words: Iterable[str], safe: Iterable[str] = (), fuzzy: bool = True, least: int = FUZZY_FROM):
        self.safe = {s for s in map(compact, safe) if len(s) >= 2}
        self.words: dict[str, None] = {}
        self.fuzzy: dict[str, str] = {}
        for norm in map(compact, words):
            if len(norm) < SHORTEST or norm in self.safe or norm in self.words:
                continue
            self.words[norm] = None
            if fuzzy and len(norm) >= max(5, least):
                for i in range(len(norm)):
                    form = norm[:i] + norm[i + 1 :]
                    if form not in self.safe and form not in self.words:
                        self.fuzzy.setdefault(form, norm)

    def __getstate__(self):
        return {"safe": self.safe, "words": self.words, "fuzzy": self.fuzzy}

    @staticmethod
    def _automaton(entries: Iterable[tuple[str, str]]):
        import ahocorasick

        found = ahocorasick.Automaton()
        for form, word in entries:
            if form.isascii() and form.isalnum():
                found.add_word(form, (form, word))
        found.make_automaton()
        return found if len(found) else None

    @cached_property
    def exact_automaton(self):
        return self._automaton((w, w) for w in self.words)

    @cached_property
    def fuzzy_automaton(self):
        return self._automaton(self.fuzzy.items())

    @cached_property
    def safe_automaton(self):
        return self._automaton((s, s) for s in self.safe if len(s) >= SHORTEST)


def matches_of(automaton, text: str):
    """(start, end, word) of every entry found in a folded text."""
    if automaton is not None:
        for last, (form, word) in automaton.iter(text):
            yield last + 1 - len(form), last + 1, word


def add_words(words: DataFrame, kind: str, new: Iterable[str]) -> DataFrame:
    """A dictionary with more words; case does not tell words apart."""
    spark = words.sparkSession
    rows = lexicon(spark, **{kind: [w.strip().lower() for w in new if w.strip()]})
    fresh = rows.dropDuplicates(["kind", "word"]).join(words.select("kind", F.lower("word").alias("word")), ["kind", "word"], "left_anti")
    top = words.filter(F.col("kind") == kind).agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("top"))
    return words.unionByName(fresh.crossJoin(F.broadcast(top)).select("kind", "word", "norm", (F.col("ord") + F.col("top")).cast("int").alias("ord")))


def remove_words(words: DataFrame, kind: str, old: Iterable[str]) -> DataFrame:
    gone = [w.strip().lower() for w in old]
    return words.filter(~((F.col("kind") == kind) & F.lower("word").isin(gone)))


def changed(entries: DataFrame, changes: DataFrame, lower: bool = False) -> DataFrame:
    """value, ord of a list after changes (value, kind, ord) in order, kind being ``add`` or ``remove``.

    Case does not tell entries apart; blanks at the ends and blank values do not count, and ``lower`` keeps new values in lower case. An
    entry that is there is not added again; one that is removed and added again goes to the end. Lists of link hosts and keywords keep the
    case, the capitals' list does not.
    """
    bare = F.trim("value")
    asked = changes.select(F.lower(bare).alias("_key"), (F.lower(bare) if lower else bare).alias("value"), "kind", F.col("ord").cast("long").alias("ord")).filter("_key <> ''")
    own = entries.select("value", F.col("ord").cast("long").alias("ord")).withColumn("_key", F.lower(F.trim("value")))
    removed = asked.filter("kind = 'remove'").groupBy("_key").agg(F.max("ord").alias("_gone"))
    stay = own.join(removed, "_key", "left_anti")
    added = asked.filter("kind = 'add'").join(removed, "_key", "left").filter("_gone IS NULL OR ord > _gone").join(stay.select("_key"), "_key", "left_anti")
    fresh = added.groupBy("_key").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    top = own.agg(F.coalesce(F.max("ord") + 1, F.lit(0).cast("long")).alias("_top"))
    later = fresh.crossJoin(F.broadcast(top)).select("value", (F.col("ord") + F.col("_top")).alias("ord"))
    return stay.select("value", "ord").unionByName(later)


def list_words(words: DataFrame, kind: str) -> DataFrame:
    return words.filter(F.col("kind") == kind).orderBy("ord").select("word")


def completions(words: DataFrame, typed: str) -> DataFrame:
    """Entries that begin with or hold what is typed, those that begin with it first."""
    low = typed.lower()
    begins = F.startswith(F.lower("word"), F.lit(low))
    return words.filter(begins | F.contains(F.lower("word"), F.lit(low))).orderBy(F.desc(begins), "word").select("word")
