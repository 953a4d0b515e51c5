"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of their bytes says so, hence copied passages give the same chunks wherever they stand; a short text is
one chunk. Documents are range-partitioned by the smallest hash of their chunks (ties by doc_id, so a large group of copies splits over
tasks), which brings documents that share chunks together; each task encodes a chunk once. A chunk's encoding holds only
between its sync points, places at which the pre-tokenizer splits whatever stands around them. What lies between the last sync
point of one chunk and the first of the next is encoded again, over as many chunks as it takes to find one, and from one sync point further
out on both sides: there it must give the ids that the chunks have; if it does not, the text is encoded whole.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import release_memory, shuffle_partitions

#: Mean bytes of a chunk are 2 ** CHUNK_BITS; the rolling hash covers 16 bytes.
CHUNK_BITS = 11
#: Characters of the chunks that a task keeps for reuse.
CACHE_CHARS = 12_000_000
#: A letter, a space, a letter: the pre-tokenizer always splits before the space. ASCII only, so no Unicode table matters.
SYNC = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: The two libraries' tables of letters, numbers and spaces agree on these; other windows take the first library.
SHARED_ALPHABET = re.compile("[^\x00-ɏ]")

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_OPEN: dict[str, Codec] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 data, each at the start of a character or at the end."""
    n = len(data)
    if n <= 1 << CHUNK_BITS:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step].copy() << np.uint32(step)
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    at = at[(at >= 64) & (at < n)]
    at = at[(raw[at] & 0xC0) != 0x80]
    return [*at.tolist(), n]


def content_key(text: str | None) -> int:
    """The smallest hash of a text's chunks: documents that share most chunks mostly share it."""
    data, start, best = (text or "").encode(), 0, 2**63 - 1
    for end in cuts(data):
        best = min(best, xxhash.xxh64_intdigest(data[start:end]) >> 1)
        start = end
    return best


def sync_points(text: str) -> tuple[int, int, int, int] | None:
    """The first two and the last two; None if there is but one."""
    first = SYNC.search(text)
    second = first and SYNC.search(text, first.start() + 1)
    if second is None:
        return None
    found, end = [], len(text)
    while len(found) < 2:
        size = 64
        while not (some := [m.start() for m in SYNC.finditer(text, max(0, end - size), end)]) and size < end:
            size *= 4
        found += some[::-1][: 2 - len(found)]
        end = found[-1]
    return first.start(), second.start(), found[1], found[0]


class Chunk(NamedTuple):
    """A chunk with sync points: the text before the first, ids between the first and the last, the text after it; and the first and the
    last stretch between two neighbouring sync points, with their ids, for the comparison of joins."""

    head: str
    inner: array.array
    tail: str
    step: tuple[str, list[int]]
    back: tuple[str, list[int]]


class Codec:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_alphabet()
        self.pieces = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        import public_tokenizers

        ranks = {b: i for i, b in self.pieces.items() if i not in set(self.special.values())}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.digits = {i: str(i) for i in self.pieces}
        self.cache: dict[bytes, Chunk | None] = {}
        self.whole: dict[bytes, array.array] = {}
        self.cached = 0

    def plain(self, text: str) -> list[int]:
        if SHARED_ALPHABET.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def chunk(self, data: bytes) -> Chunk | None:
        """None without two sync points."""
        key = xxhash.xxh128_digest(data)
        if key in self.cache:
            return self.cache[key]
        text = data.decode()
        got = None
        if (at := sync_points(text)) is not None:
            first, second, before, last = at
            step, back = text[first:second], text[before:last]
            got = Chunk(text[:first], array.array("I", self.plain(text[first:last])), text[last:], (step, self.plain(step)), (back, self.plain(back)))
        self.remember(len(text))
        self.cache[key] = got
        return got

    def alone(self, text: str, data: bytes) -> array.array:
        """The ids of a text of one chunk."""
        key = xxhash.xxh128_digest(data)
        got = self.whole.get(key)
        if got is None:
            got = array.array("I", self.plain(text))
            self.remember(len(text))
            self.whole[key] = got
        return got

    def remember(self, chars: int) -> None:
        if self.cached > CACHE_CHARS:
            self.forget()
        self.cached += chars

    def forget(self) -> None:
        self.cache.clear()
        self.whole.clear()
        self.cached = 0

    def joined(self, back: tuple[str, list[int]], between: str, step: tuple[str, list[int]]) -> list[int] | None:
        """The ids of a join, if its encoding from one sync point further out agrees with both sides there."""
        ids = self.plain(back[0] + between + step[0])
        own = ids[len(back[1]) : len(ids) - len(step[1])]
        return own if back[1] + own + step[1] == ids else None

    def segment(self, text: str) -> list[int]:
        data = text.encode()
        ends = cuts(data)
        if len(ends) < 2:
            return list(self.alone(text, data))
        ids: list[int] = []
        none: tuple[str, list[int]] = ("", [])
        pending, start, back = [], 0, none
        for end in ends:
            piece = data[start:end]
            start = end
            got = self.chunk(piece)
            if got is None:
                pending.append(piece.decode())
                continue
            pending.append(got.head)
            join = self.joined(back, "".join(pending), got.step)
            if join is None:
                return self.plain(text)
            ids += join
            ids += got.inner
            pending, back = [got.tail], got.back
        join = self.joined(back, "".join(pending), none)
        return self.plain(text) if join is None else ids + join

    def encode(self, text: str) -> list[int]:
        """The ids that the library gives to the whole text, its special tokens' strings included."""
        if not self.split or not self.split.search(text):
            return self.segment(text) if text else []
        ids, start = [], 0
        for m in self.split.finditer(text):
            if m.start() > start:
                ids += self.segment(text[start : m.start()])
            ids.append(self.special[m[0]])
            start = m.end()
        return ids + (self.segment(text[start:]) if start < len(text) else [])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode(errors="replace")


def codec(path: str) -> Codec:
    """One per process and file."""
    if path not in _OPEN:
        _OPEN[path] = Codec(path)
    return _OPEN[path]


def by_content(docs: DataFrame) -> DataFrame:
    """Range-partitions documents by their smallest chunk hash, then by doc_id."""

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        return text.map(content_key, na_action=None).astype("int64")

    keyed = docs.withColumn("_near", key(F.col("text")))
    return keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), "_near", "doc_id").drop("_near")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes whole texts and decodes them again.

    Null and empty texts have no ids. Repeated rows and ties give repeated results, a null doc_id stays null, an empty table gives no rows;
    other columns than doc_id and text are dropped. Returns doc_id, ids (array<int>), decoded.
    """
    return _run(docs, path, ["ids", "decoded"])


_KINDS = {"n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string")}
DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _run(docs: DataFrame, path: str | None, names: list[str]) -> DataFrame:
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        make = {
            "n_tokens": lambda ids, text: len(ids),
            "ids_sha256": lambda ids, text: hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": lambda ids, text: hashlib.sha256(text.encode()).hexdigest(),
            "ids": lambda ids, text: np.array(ids, np.int32),
            "decoded": lambda ids, text: text,
        }
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names}
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                text = bpe.decode(ids)
                for n in names:
                    cols[n].append(make[n](ids, text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[n], _KINDS[n][0]) for n in names)], names=["doc_id", *names])
        bpe.forget()  # a worker outlives its task
        release_memory()

    schema = ", ".join(["doc_id long", *(f"{n} {_KINDS[n][1]}" for n in names)])
    return by_content(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(work, schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digests of op1 and the ids themselves: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array<int>)."""
    return _run(docs, path, [*DIGESTS, "ids"])


def op1(docs: DataFrame, path: str | None = None) -> DataFrame:
    return _run(docs, path, DIGESTS)
