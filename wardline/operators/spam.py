"""Spam rules over a user's messages in order. One pure step is the rule; batch and stream adapters only carry its state."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sized
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import Spam
from wardline.operators.fold import Fold


class Result(NamedTuple):
    reason: str
    remaining_s: int
    duplicate: bool = False


class Recent(NamedTuple):
    at: int
    form: str


@dataclass
class State:
    """Times in milliseconds. Only accepted messages enter the history; never flooded is None, not 0."""

    history: list[Recent] = field(default_factory=list)
    checked: tuple[str, int, Result | None] | None = None
    flooded: int | None = None


_LETTERS = regex.compile(r"(\p{L})\1+", regex.I)
_WORD_GAPS = regex.compile(r"[^\p{L}\p{N}\s\x1c-\x1f]")


_LATIN_LETTERS = np.array([chr(i).isalpha() for i in range(256)])


def _single_letters(s: str) -> str:
    """Repeats of a letter become one; in Latin-1 and lower case, letters are equal only to themselves."""
    try:
        codes = np.frombuffer(s.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return _LETTERS.sub(r"\1", s)
    again = (codes[1:] == codes[:-1]) & _LATIN_LETTERS[codes[1:]]
    return np.delete(codes, np.flatnonzero(again) + 1).tobytes().decode("latin-1") if again.any() else s


@lru_cache(maxsize=256)
def similarity_form(s: str) -> str:
    s = s.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    return _single_letters(s).strip("".join(map(chr, range(33))))


@lru_cache(maxsize=256)
def words_of(form: str) -> frozenset[str]:
    return frozenset(_WORD_GAPS.sub("", form).split())


def distance_up_to(a: str, b: str, most: int) -> int:
    """Levenshtein distance, of which only the band around the diagonal is worked out; most + 1 for anything above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    over = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new, low, high = {}, max(0, i - most), min(len(b), i + most)
        for j in range(low, high + 1):
            new[j] = i if j == 0 else min(new.get(j - 1, over) + 1, row.get(j, over) + 1, row.get(j - 1, over) + (x != b[j - 1]))
        if min(new.values()) > most:
            return over
        row = new
    return min(row[len(b)], over)


def similar(a: Recent, b: Recent, percent: int) -> bool:
    if a.form == b.form:
        return True
    if abs(len(a.form) - len(b.form)) > 6:
        return False
    short = min(len(a.form), len(b.form)) < 8
    x, y = words_of(a.form), words_of(b.form)
    if x | y and len(x & y) / len(x | y) >= (0.85 if short else percent / 100):
        return True
    most = 2 if short else 4
    return distance_up_to(a.form, b.form, most) <= most


def _longest_run(codes: np.ndarray, gap: int) -> int:
    """The longest row of characters that equal the one ``gap`` places on."""
    n = len(codes) - gap
    if n <= 0:
        return 0
    apart = np.flatnonzero(codes[:-gap] != codes[gap:])
    if not len(apart):
        return n
    inner = int((apart[1:] - apart[:-1]).max()) - 1 if len(apart) > 1 else 0
    return max(int(apart[0]), n - 1 - int(apart[-1]), inner)


@lru_cache(maxsize=256)
def _is_flood(s: str, chars: int, patterns: int) -> bool:
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) > 1 and _longest_run(codes, 1) >= max(1, chars) or (chars < 1 and s != ""):
        return True
    return patterns > 1 and any(len(codes) > n and _longest_run(codes, n) >= n * patterns for n in (2, 3, 4))


def is_flood(s: str, cfg: Spam) -> bool:
    """A character followed by as many of itself as the limit, or two to four characters that do the same."""
    return _is_flood(s, cfg.flood_chars, cfg.flood_patterns)


def _within(s: Sized, least: int, most: int) -> bool:
    return len(s) >= max(0, least) and (most <= 0 or len(s) <= most)


def _left(ms: int) -> int:
    return -(-ms // 1000)


class Seen(NamedTuple):
    """What the rules ask of a text that is elsewhere: its form, whether it floods, and what tells forms apart."""

    form: Any
    flood: bool
    like: Callable[[Recent, Recent, int], bool]


def step(cfg: Spam, state: State, at: int, s: Sized, first_seen: int | None = None, seen: Seen | None = None) -> Result | None:
    """Result for a message (None: accepted), changing the state. first_seen None: the user is new at this moment. With seen, only the length of s counts."""
    now = Recent(at, similarity_form(s) if seen is None else seen.form)
    if state.checked and at - state.checked[1] <= cfg.dedupe_ms and state.checked[0] == now.form:
        old = state.checked[2]
        return old and old._replace(duplicate=True)
    state.history = [r for r in state.history if at - r.at <= cfg.state_ttl_ms]
    result = _locked(cfg, at, first_seen) or _flooded(cfg, state, at, is_flood(s, cfg) if seen is None else seen.flood)
    result = result or _repeated(cfg, state, now, s, similar if seen is None else seen.like) or _hasty(cfg, state, at, s)
    if result is None:
        state.history = [*state.history, now][-cfg.history :]
    state.checked = (now.form, at, result)
    return result


def _locked(cfg: Spam, at: int, first_seen: int | None) -> Result | None:
    left = cfg.lock_ms - (at - (at if first_seen is None else first_seen))
    return Result("new-player-chat-lock", max(1, _left(left))) if cfg.lock_ms > 0 and left > 0 else None


def _flooded(cfg: Spam, state: State, at: int, flood: bool) -> Result | None:
    """The first flood is delivered and starts the clock; floods before it runs out are blocked and leave it."""
    if not flood:
        return None
    if state.flooded is not None and at - state.flooded < cfg.flood_ms:
        return Result("character-flood", max(1, _left(cfg.flood_ms - (at - state.flooded))))
    state.flooded = at
    return Result("character-flood-first", _left(cfg.flood_ms))


def _repeated(cfg: Spam, state: State, now: Recent, s: Sized, like: Callable[[Recent, Recent, int], bool]) -> Result | None:
    if cfg.similar_ms <= 0 or not _within(s, cfg.similar_min, cfg.similar_max):
        return None
    live = (cfg.similar_ms - (now.at - r.at) for r in state.history if cfg.similar_ms > now.at - r.at and like(now, r, cfg.similar_percent))
    left = next(live, None)
    return None if left is None else Result("similar-message-cooldown", _left(left))


def _hasty(cfg: Spam, state: State, at: int, s: Sized) -> Result | None:
    if not state.history or not _within(s, cfg.cooldown_min, cfg.cooldown_max):
        return None
    left = cfg.cooldown_ms - (at - state.history[-1].at)
    return Result("general-cooldown", _left(left)) if left > 0 else None


class SpamFold(Fold):
    """Adds ``spam`` to messages (msg_id, ts, user_id, text and, if there is one, first_seen)."""

    needs = ("text", "first_seen")
    adds = (("spam_reason", "string"), ("spam_remaining_s", "int"), ("spam_duplicate", "boolean"))

    def __init__(self, cfg: Spam = Spam()):
        self.cfg = cfg
        self.ttl_ms = max(cfg.state_ttl_ms, cfg.flood_ms, cfg.similar_ms, cfg.cooldown_ms)

    def new(self) -> State:
        return State()

    def step(self, state: State, at: int, row: dict) -> tuple:
        if row.get("watched") is False:  # bypassed messages leave no trace
            return None, None, None
        first = row.get("first_seen")
        got = step(self.cfg, state, at, row["text"] or "", at - self.cfg.lock_ms if first is None else first)
        return (None, None, None) if got is None else tuple(got)

    def dump(self, state: State) -> str:
        import json

        return json.dumps([[(r.at, r.form) for r in state.history], state.checked, state.flooded])

    def load(self, text: str) -> State:
        import json

        history, checked, flooded = json.loads(text)
        if checked:
            checked = (checked[0], checked[1], checked[2] and Result(*checked[2]))
        return State([Recent(at, form) for at, form in history], checked, flooded)


def spam(messages: DataFrame, cfg: Spam = Spam()) -> DataFrame:
    """Batch form; see Fold.batch."""
    return SpamFold(cfg).batch(messages)


def new_user_lock(messages: DataFrame, lock_ms: int) -> DataFrame:
    """left_ms, for how long a user's first minutes still lock them; first_seen is the first message in the table."""
    first = F.min("ts").over(Window.partitionBy("user_id"))
    ms = lambda c: F.unix_millis(F.to_timestamp(c))
    left = lock_ms - (ms(F.col("ts")) - ms(first))
    return messages.withColumn("locked", left > 0).withColumn("remaining_s", F.when(left > 0, F.greatest(F.lit(1), F.ceil(left / 1000))).otherwise(0).cast("int"))
