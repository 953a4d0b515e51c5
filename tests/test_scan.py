"""Long texts: the array operations against the way word by word, and that they spare it."""

import random

import numpy as np
import pytest

from wardline.config import Ads, Links, Words
from wardline.functions import scan
from wardline.functions.chars import compact
from wardline.operators import ads, links, spam, words
from wardline.operators.links import LinkFinder
from wardline.operators.suspicion import SuspicionFold

PLAIN = "the quick brown fox, jumps over a lazy dog. grüße aus köln; привет как дела que de la casa".split(" ")
ODD = (
    "foo.com|@anna_x|https://a.de/x?y|1.2.3.4|точка|ru|foo , com|c0m|t.me/abcd|discord.gg/xyz|x-com|de_|b a r c o m|x r a y|h.e.l.l.o|he11o|ª|ﬁn|é|İx|ſo|Σας|dot|a dot com|"
    "​|com​|a b|ь|a'na|!!!|-|--|(com)|[ru]|com/|com? x|www.x.ru|лучший тгк @name1|мой тгк Somename|ip foo.ru|http : // foo . net|-com-|com²|ｃｏｍ|сом.ru|foo . phun|\x1c|q.|я.|e.g.|x\ny|de/|x.de-facto|"
    "hi.. com|wonderful|w o n d e r f u l|wond3rful|wonderfl|won.der-ful|won der ful|he llo|t h e"
).split("|")
BAD = Words(words=("wonderful", "hello", "xray", "the", "сука"), safe=("that", "hellos"))


def made(seed: int) -> str:
    rnd = random.Random(seed)
    out = [rnd.choice(PLAIN) for _ in range(rnd.randint(5, 150))]
    for _ in range(rnd.randint(0, rnd.choice((1, 4, 20)))):
        out.insert(rnd.randrange(len(out) + 1), rnd.choice(ODD))
    return "".join(w + rnd.choice((" ", " ", " ", ". ", ", ", "  ", "\n", "")) for w in out)


@pytest.fixture
def long(monkeypatch):
    return lambda n: [monkeypatch.setattr(m, "LONG", n) for m in (scan, words, links, ads)]


def test_long_texts_as_word_by_word(long):
    settings = (Links(), Links(ads=Ads(keywords=("hello", "and the", "casa"))), Links(tlds=("com", "de", "co.uk", "Ru")), Links(smart=False), Links(list_on=True, domains=("foo.com",)))
    ways = [words.engine(BAD).find, words.engine(Words(words=BAD.words, safe=(), level="medium")).find, words.engine(BAD, ("Fox", "hello")).find, scan.form_of]
    ways += [f for cfg in settings for f in (LinkFinder(cfg).find, LinkFinder(cfg, ("anna",)).links, SuspicionFold(cfg).view)]
    found = 0
    for text in map(made, range(300)):
        long(10**9)
        want = [f(text) for f in ways]
        long(1)
        assert [f(text) for f in ways] == want and scan.form_of(text) == compact(text), text
        found += bool(want[0]) + bool(want[4])
    assert found > 100


def test_long_texts_are_not_cut_into_words():
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)) + " wonderful, de"
    engine, finder = words.engine(BAD), LinkFinder()
    assert [m.text for m in engine.find(text)] == ["wonderful"] and len(engine.memo) < 5
    assert finder.find(text) == [] or len(finder.endings) < 5
    assert len(finder.endings) < 5


def test_forms_and_runs_of_long_texts():
    rnd = random.Random(1)
    for _ in range(500):
        s = "".join(rnd.choice("aabßéé1 \nÿ·") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 40)))
        assert spam._single_letters(s) == spam._LETTERS.sub(r"\1", s)
        codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        for gap in (1, 2, 3, 4):
            same = "".join("x" if i + gap < len(s) and s[i] == s[i + gap] else " " for i in range(len(s)))
            assert spam._longest_run(codes, gap) == max(map(len, same.split()), default=0)


def test_a_message_under_a_record_is_folded_once_in_arrays(monkeypatch):
    """With a record, each long message was folded letter by letter again."""
    asked = []
    monkeypatch.setattr("wardline.functions.scan.chars.compact", lambda s, *a: asked.append(s) or compact(s, *a))
    fold, text = SuspicionFold(), " ".join(PLAIN * 10) + " see example.com"
    record = fold.new()
    levels = [fold.step(record, at, {"text": text})[1] for at in (0, 1000, 2000)]
    assert levels == [1, 2, 3] and not [s for s in asked if len(s) >= scan.LONG]
