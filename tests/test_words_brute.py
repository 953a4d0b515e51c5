"""The word engine against a plain search: every place of every word in every token, without automata, views that are shared, or memory."""

import random
import re
import unicodedata

import pytest

from wardline import fixed
from wardline.config import Words
from wardline.functions.chars import has_obfuscation
from wardline.operators.words import engine
from wardline.sources.tables import table

FOLD = {c: to for to, group in fixed.FOLD.items() for c in group}


def letter(ch):
    low = ch.lower()
    if low in fixed.IGNORED:
        return ""
    if low in FOLD:
        return FOLD[low]
    return low if low and (unicodedata.category(low[0])[0] == "L" or unicodedata.category(low[0]) == "Nd") else None


def form(s):
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    out = ""
    for f in "".join(letter(c) or "" for c in s):
        out += f if not out.endswith(f) else ""
    return out


def pieces(s, gap):
    """Lists of [letter, first place, last place]; repeats are one; a piece ends where more than gap separators stand."""
    out, own, between = [], [], 0
    for i, ch in enumerate(s):
        f = letter(ch)
        if f is None:
            between += 1
        elif f:
            if own and gap is not None and between > gap:
                out.append(own)
                own = []
            between = 0
            if own and own[-1][0] == f:
                own[-1][2] = i
            else:
                own.append([f, i, i])
    return out + [own] if own else out


def places(own, word):
    for a in range(len(own) - len(word) + 1):
        if "".join(x[0] for x in own[a : a + len(word)]) == word:
            yield own[a], own[a + len(word) - 1]


def token_hits(s, words, safe, forms):
    def around(start, end):
        alnum = lambda c: unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"
        while start and alnum(s[start - 1]):
            start -= 1
        while end < len(s) and alnum(s[end]):
            end += 1
        return start, end, form(s[start:end])

    def soft(end):
        while end < len(s) and s[end] in fixed.SOFT_SIGNS:
            end += 1
        return end

    def kind(whole, word):
        if whole in safe:
            return None
        if whole == word or whole in words:
            return "same"
        if len(word) >= 6 and (forms.get(whole) == word or any(word[:i] + word[i + 1 :] == whole for i in range(len(word)))):
            return "form"
        return None if word in whole else "part"

    for own in pieces(s, 3):
        for word in words:
            for a, b in places(own, word):
                start, end = a[1], b[2] + 1
                left, right, whole = around(start, end)
                how = kind(whole, word)
                if how == "same":
                    yield left, right, 100
                elif how == "part":
                    yield start, soft(end), 92
                elif how == "form" and has_obfuscation(s):
                    yield left, right, 80
    if not has_obfuscation(s):
        return
    for own in pieces(s, None):
        text = "".join(x[0] for x in own)
        if len(text) < 5:
            continue
        for short, word in forms.items():
            if word in text:
                continue
            for a, b in places(own, short):
                start, end = a[2], soft(b[2] + 1)
                left, right, whole = around(start, end)
                how = kind(whole, word)
                if how is None or (how == "part" and len(whole) > len(word) + 2):
                    continue
                yield (start, end, 80) if how == "part" else (left, right, 80)


def plain_find(s, words, safe):
    words = list(dict.fromkeys(w for w in map(form, words) if len(w) >= 3 and w not in set(map(form, safe))))
    safe = {w for w in map(form, safe) if len(w) >= 2}
    forms = {}
    for w in words:
        for i in range(len(w) if len(w) >= 6 else 0):
            short = w[:i] + w[i + 1 :]
            # a form is no word that was entered up to then
            if short not in safe and short not in words[: words.index(w) + 1]:
                forms.setdefault(short, w)
    if len(s) < 3:
        return []
    hits, protected, tokens = [], [], [(m.start(), m[0], form(m[0])) for m in re.finditer(r"\S+", s)]
    for at, t, f in tokens:
        if max(len(t), len(f)) >= 3:
            hits += [(at + a, at + b, c) for a, b, c in token_hits(t, words, safe, forms)]
        if len(t) >= 3:
            protected += [(at + a[2], at + b[2] + 1) for own in pieces(t, None) for w in safe if len(w) >= 3 for a, b in places(own, w)]
    run = []
    for token in [*tokens, (0, "", "")]:
        if 1 <= len(token[2]) <= 3:
            run.append(token)
            continue
        for i in range(len(run)):
            for j in range(i + 1, len(run)):
                spelt = "".join(f for _, _, f in run[i : j + 1])
                own = run[i : j + 1]
                if spelt in words and (len(own) >= len(spelt) or not any("".join(c.lower() for c in t if c.isalpha()) in fixed.FUNCTION_WORDS for _, t, _ in own)):
                    hits.append((own[0][0], own[-1][0] + len(own[-1][1]), 95))
        run = []
    out = []
    for a, b, c in sorted((h for h in hits if not any(h[0] < q and p < h[1] for p, q in protected)), key=lambda h: (h[0], -h[2], h[0] - h[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, c))
    return out


WORDS, SAFE = ("impact", "dogs", "хуже", "license", "tabak", "abcdef", "abcdeg", "dog"), ("dogma", "compact")


def obfuscated(r, word):
    swaps = {"a": "@4а", "o": "0о", "e": "3е", "i": "1!", "s": "$5", "c": "с", "t": "7т", "l": "л", "d": "д"}
    out = ""
    for ch in word:
        how = r.random()
        if how < 0.08:
            continue
        out += r.choice(swaps.get(ch, ch)) if how < 0.35 else ch.upper() if how < 0.45 else ch * r.randint(2, 3) if how < 0.55 else ch
        if r.random() < 0.12:
            out += r.choice([".", "-", " ", "..", "​", "ь", "____"])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_search(seed):
    r = random.Random(seed)
    own = engine(Words(words=WORDS, safe=SAFE))
    filler = ["hello", "d", "o", "g", "s", "у", "на", "a1b2", "im", "pact", "dogmatic", "c0mpact", "x", "...", "классный", "И", "ГГ", "abcde", "ﬁn", "DOG's"]
    found = 0
    for _ in range(1500):
        s = " ".join(obfuscated(r, r.choice(WORDS)) if r.random() < 0.4 else r.choice(filler) for _ in range(r.randint(1, 7)))
        got = [(m.start, m.end, m.confidence) for m in own.find(s)]
        assert got == plain_find(s, WORDS, SAFE), s
        found += len(got)
    assert found > 500


def test_tables_against_plain_search(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect() if r.text and len(r.text) < 1500]
    words = tuple(sorted({w for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect() for w in re.findall(r"[a-z]{7}[a-z]*", r.text)}))[:25]
    own = engine(Words(words=words, safe=("that", "there")))
    got = [[(m.start, m.end, m.confidence) for m in own.find(t)] for t in texts]
    assert got == [plain_find(t, words, ("that", "there")) for t in texts] and len(texts) > 50
