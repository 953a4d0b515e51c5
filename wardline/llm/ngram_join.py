"""Similarity join of documents on sets of word n-grams, by token-combination prefixes.

A token is the hash of an n-gram. Exact counts over all documents split tokens into rare and frequent ones; the global order puts
rare tokens first, frequent ones by count. With threshold t, a set of n tokens shares a token of its first n - ceil(t n) + 1 with every
set similar to it. Where these are all rare, they are indexed one by one. Otherwise the set's rare tokens are indexed one by one and
its frequent ones in combinations of two neighbours, over a longer prefix: two similar sets that share no rare token have at most
floor((2 - 2t) n) - 2 r gaps spoilt by tokens that only one of them has (r: the set's rare tokens), so that among its first
floor((2 - 2t) n) - 2 r + 2 frequent tokens two neighbours of one set are neighbours in the other too. Sets of up to SMALL tokens also
index frequent tokens one by one, since the argument needs seven tokens in both together.

Sets that share an index key are compared in two rounds. First with a few members of the key that stand for it, and the links found give
components; then every pair under one key whose components differ. Both rounds drop pairs whose sketches show that they cannot reach the
threshold; the others are verified on whole sets. Equal sets count once. Keys of very frequent combinations are salted, and their second
round runs over pairs of salts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import release_memory, saved, shuffle_partitions, split_join
from wardline.llm.components import components, spanned

#: Documents from which a token is frequent, at least; most frequent tokens that are broadcast (12 bytes each).
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Sets up to this size index frequent tokens singly too.
SMALL = 8
#: Members of a key that go to one salt, about.
BLOCK = 4096
#: Stand-ins for a key: each key takes one of so many orders of its members.
ORDERS = 8
#: Smallest keys of a set that its rows carry, so that most pairs come out under one key only.
FIRSTS = 8
#: Bits of the sketch that travels with each key of a set; the full one, as long as the set asks for, joins pairs only.
BRIEF = 1024
#: Bits of a Bloom filter for each text hash, of one of its blocks, and of the largest that is broadcast.
BLOOM_EACH, BLOOM_BLOCK, BLOOM_MOST = 12, 1 << 16, 1 << 28
FLUSH = 400_000

_U = np.uint64
_BYTE = np.random.default_rng(23).integers(0, 2**64, 256, dtype=_U)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_POW = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2 ** 64, n of each at least."""
    while len(_POW[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            last = _U(pow(base, len(_POW[i]), 2**64))
            _POW[i] = np.concatenate([_POW[i], _POW[i] * last])
    return _POW[0][:n], _POW[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word; words are runs without ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not len(edge):
        return np.empty(0, _U)
    start, end = edge[::2], edge[1::2]
    ahead, back = _powers(len(raw) + 1)
    sums = _BYTE[raw]
    sums *= ahead[: len(raw)]
    np.cumsum(sums, out=sums)
    return _mix((sums[end - 1] - sums[start - 1]) * back[start] + (end - start).astype(_U))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; of all words, if there are fewer; empty without words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, _U(width))
    for k in range(width):
        h = h * _U(0xD6E8FEB86659FD93) + words[k : k + n]
    h = _mix(h)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def set_id(tokens: np.ndarray) -> int:
    """64 bits for equal sets; 0 for the empty set. Two of N different sets share one with odds of N * N / 2 ** 65."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63 if len(tokens) else 0


def _level(n: np.ndarray) -> np.ndarray:
    """log2 of the bits of the sketch of a set of n tokens: at least 4 n, and one word."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64))


def _sketch(tokens: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of tokens fall on a place. Two sets differ in as many tokens at least as their sketches in bits."""
    size = 1 << int(_level(np.array(len(tokens))))
    return np.packbits((np.bincount((tokens & _U(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def _brief(sketch: bytes) -> bytes:
    """A sketch folded to BRIEF bits at most."""
    words = np.frombuffer(sketch, _U)
    while len(words) * 64 > BRIEF:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.tobytes()


def _planes(a: np.ndarray) -> bytes:
    """Bytes by place: sorted values compress better so."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _from_planes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _part_bits(df: DataFrame) -> int:
    return max(10, (4 * shuffle_partitions(df.sparkSession) - 1).bit_length())


def _rows(kinds: dict, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def frequent_tokens(docs: DataFrame, width: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the tokens' hashes (part and 32 bits) found in at least ``least`` documents, and their counts; sorted.

    All documents count. If there are more than ``most``, the least count doubles until they are few enough.
    """
    bits = _part_bits(docs)
    kinds = {"part": pa.int32(), "blob": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held) >> _U(32 - bits))
            ends = np.searchsorted(keys, np.arange(1, (1 << bits) + 1, dtype=_U) << _U(32))
            low = keys.astype(np.uint32)
            return _rows(kinds, [(p, _planes(low[a:b])) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), width))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held.clear()
        release_memory()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([_from_planes(b, np.uint32) for b in pdf["blob"]]), return_counts=True)
        keep = n >= least
        release_memory()
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "keys": [keys[keep].tobytes()], "counts": [n[keep].astype(np.uint32).tobytes()]})

    got = docs.select("text").mapInArrow(send, "part int, blob binary").groupBy("part").applyInPandas(count, "part int, keys binary, counts binary")
    got = saved(got.withColumn("size", F.length("keys") / 4), "frequent")
    while (got.agg(F.sum("size")).first()[0] or 0) > most:
        least *= 2

        def fewer(batches: Iterator[pd.DataFrame], least: int = least) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, keys, counts in zip(pdf["part"], pdf["keys"], pdf["counts"], strict=True):
                    keep = np.frombuffer(counts, np.uint32) >= least
                    yield pd.DataFrame({"part": [part], "keys": [np.frombuffer(keys, np.uint32)[keep].tobytes()], "counts": [np.frombuffer(counts, np.uint32)[keep].tobytes()], "size": [float(keep.sum())]})

        got = saved(got.mapInPandas(fewer, got.schema), "frequent")
    parts = got.filter("size > 0").select("part", "keys", "counts").collect()  # MOST_FREQUENT tokens at most
    keys = [(_U(r.part) << _U(32)) | np.frombuffer(r.keys, np.uint32).astype(_U) for r in parts]
    keys, counts = np.concatenate([np.empty(0, _U), *keys]), np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r.counts, np.uint32) for r in parts)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def index_keys(tokens: np.ndarray, keys: np.ndarray, counts: np.ndarray, shift: int, percent: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's index keys and the number of salts of each."""
    n = len(tokens)
    first = n - -(-percent * n // 100) + 1
    short = tokens >> _U(shift)
    at = np.minimum(np.searchsorted(keys, short), max(0, len(keys) - 1))
    often = keys[at] == short if len(keys) else np.zeros(n, bool)
    rare = tokens[~often]
    singles = rare[:first]
    if len(rare) >= first:
        return singles, np.ones(len(singles), np.int32)
    heavy, count = tokens[often], counts[at[often]]
    order = np.lexsort((heavy, count))
    heavy, count = heavy[order], count[order]
    if n <= SMALL:
        more = heavy[: first - len(rare)]
        singles, salts = np.concatenate([singles, more]), np.concatenate([np.ones(len(singles), np.int64), -(-count[: len(more)].astype(np.int64) // block)])
    else:
        salts = np.ones(len(singles), np.int64)
    reach = min(len(heavy), (200 - 2 * percent) * n // 100 - 2 * len(rare) + 2)
    if reach >= 2:
        pairs = _mix(heavy[: reach - 1] * _U(0xD6E8FEB86659FD93) + heavy[1:reach])
        singles, salts = np.concatenate([singles, pairs]), np.concatenate([salts, -(-np.minimum(count[: reach - 1], count[1:reach]).astype(np.int64) // block)])
    return singles, salts.astype(np.int32)


def postings(docs: DataFrame, width: int, percent: int, keys: np.ndarray, counts: np.ndarray, block: int) -> DataFrame:
    """key, salts, set, n for every index key that two sets have, or that is salted. Sorted runs of packed keys are shuffled, not rows."""
    bits = _part_bits(docs)
    shift = 32 - bits
    known = docs.sparkSession.sparkContext.broadcast((keys, counts))
    kinds = {"part": pa.int32(), "keys": pa.binary(), "sets": pa.binary(), "sizes": pa.binary(), "salts": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, count = known.value

        def flush() -> pa.RecordBatch:
            key, salts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            lengths = [len(h[0]) for h in held]
            sets, sizes = np.repeat(np.array([h[2] for h in held], np.int64), lengths), np.repeat(np.array([h[3] for h in held], np.uint32), lengths)
            order = np.argsort(key)
            key, salts, sets, sizes = key[order], salts[order], sets[order], sizes[order]
            ends = np.searchsorted(key >> _U(64 - bits), np.arange(1, (1 << bits) + 1, dtype=_U))
            return _rows(kinds, [(p, _planes(key[a:b]), _planes(sets[a:b]), _planes(sizes[a:b]), _planes(salts[a:b])) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a])

        held, size, seen = [], 0, set()
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py(), width)
                if not len(tokens) or (sid := set_id(tokens)) in seen:
                    continue
                seen.add(sid)
                held.append((*index_keys(tokens, heavy, count, shift, percent, block), sid, len(tokens)))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush()
                    held, size, seen = [], 0, set()
        if size:
            yield flush()
        held.clear()
        release_memory()

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        key, sets, n, salts = (np.concatenate([_from_planes(b, k) for b in pdf[c]]) for c, k in (("keys", _U), ("sets", np.int64), ("sizes", np.uint32), ("salts", np.int32)))
        order = np.lexsort((sets, key))
        key, sets, n, salts = key[order], sets[order], n[order], salts[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])
        key, sets, n, salts = key[new], sets[new], n[new], salts[new]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[1:] | same[:-1] | (salts > 1)
        release_memory()
        return pd.DataFrame({"key": key[keep].view(np.int64), "salts": salts[keep], "set": sets[keep], "n": n[keep].astype(np.int32)})

    sent = docs.select("text").mapInArrow(send, "part int, keys binary, sets binary, sizes binary, salts binary")
    return saved(sent.groupBy("part").applyInPandas(shared, "key long, salts int, set long, n int"), "postings")


def _stand_ins(post: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): under each key and salt, the first member in one of a few orders with every other, if their sizes allow a link."""
    order = F.xxhash64(F.pmod("key", F.lit(ORDERS)), "set")
    one = F.min(F.struct(order.alias("order"), F.col("set").alias("a"), F.col("n").alias("na"))).alias("one")
    keyed = post.withColumn("salt", F.pmod(F.xxhash64("set"), F.col("salts")))
    ones = keyed.groupBy("key", "salt").agg(one)
    pairs = keyed.join(ones, ["key", "salt"]).select(F.col("one.a").alias("a"), F.col("one.na").alias("na"), F.col("set").alias("b"), F.col("n").alias("nb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.filter((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs, a table, whose sketches leave room for a link. Sets with many pairs are split over tasks."""
    left, right = (nodes.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):  # sketches of long texts are long
                batch = rows.slice(at, 1024)
                a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
                both = Sketches(batch.column("sa").to_pylist() + batch.column("sb").to_pylist())
                keep = both.room(np.arange(len(a)), np.arange(len(a)) + len(a), np.concatenate([na, nb]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
        release_memory()

    met = split_join(split_join(pairs, left, "a", "b"), right, "b", "a", pairs)
    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(fit, "a long, b long")


class Sketches:
    """Sketches of many sets, those of one size as rows of a matrix; a sketch of twice the size folds to the smaller one's."""

    def __init__(self, blobs: list[bytes]):
        sizes = np.array([len(b) for b in blobs], np.int64)
        self.level = np.round(np.log2(np.maximum(sizes, 1) * 8)).astype(np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {int(k): np.flatnonzero(self.level == k) for k in np.unique(self.level)}
        plain = {k: np.frombuffer(b"".join(blobs[i] for i in at), _U).reshape(len(at), -1) for k, at in own.items()}
        for k in own:
            place = np.full(len(blobs), -1)
            place[own[k]] = np.arange(len(own[k]))
            words = plain[k]
            if k + 1 in own:
                twice = plain[k + 1].shape[1] // 2
                place[own[k + 1]] = len(words) + np.arange(len(own[k + 1]))
                words = np.concatenate([words, plain[k + 1][:, :twice] ^ plain[k + 1][:, twice:]])
            self.rows[k] = place, words

    def room(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs may still reach the threshold: sets with s tokens in all differ in (100 - percent) / (100 + percent) of them at most."""
        differ = np.zeros(len(i), np.int64)
        low = np.minimum(self.level[i], self.level[j])
        for k in np.unique(low):
            place, words = self.rows[int(k)]
            step = max(1, (1 << 22) // words.shape[1])
            at = np.flatnonzero(low == k)
            for part in (at[x : x + step] for x in range(0, len(at), step)):
                a, b = place[i[part]], place[j[part]]
                known = (a >= 0) & (b >= 0)  # sizes further apart than twice cannot link, nor be compared
                differ[part] = np.where(known, np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64), 0)
        return (100 + percent) * differ <= (100 - percent) * (n[i].astype(np.int64) + n[j])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A forest of the pairs that link, on whole sets. Sets are built again for one text each; the other texts are kept from Python."""
    used = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    texts = saved(nodes.join(used, "set", "left_semi").select("hash").distinct(), "texts")
    keep, known = _filter(texts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"set": pa.int64(), "tokens": pa.list_(pa.int64())}
        rows, size, done = [], 0, set()
        for batch in batches:
            hashes = batch.column("hash").to_numpy()
            for i in keep(hashes):
                if hashes[i] in done:  # a task sends a text once, so copies are no hot key
                    continue
                done.add(hashes[i])
                tokens = shingles(batch.column("text")[int(i)].as_py(), width)
                rows.append((set_id(tokens), tokens.view(np.int64)))
                size += len(tokens)
                if size > 200_000:
                    yield _rows(kinds, rows)
                    rows, size = [], 0
        if rows:
            yield _rows(kinds, rows)
        release_memory()

    own = docs.select("text", "hash") if known else docs.select("text", "hash").join(texts, "hash", "left_semi")
    sets = own.mapInArrow(build, "set long, tokens array<long>").join(used, "set", "left_semi").dropDuplicates(["set"])
    left, right = (sets.select(F.col("set").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    joined = split_join(split_join(pairs, left, "a", "b"), right, "b", "a", pairs).withColumn("both", F.size(F.array_intersect("ta", "tb")).cast("long"))
    links = F.col("both") * 100 >= (F.size("ta") + F.size("tb") - F.col("both")) * percent
    return saved(spanned(joined.filter(links)), "links")


def _filter(wanted: DataFrame) -> tuple[Callable[[np.ndarray], np.ndarray], bool]:
    """A function from hashes to the places of those that may be wanted, by a Bloom filter of BLOOM_MOST bits at most; beyond that a function
    that lets all pass, and False."""
    blocks = 1 << max(0, (BLOOM_EACH * wanted.count() // BLOOM_BLOCK).bit_length())
    if blocks * BLOOM_BLOCK > BLOOM_MOST:
        return (lambda hashes: np.arange(len(hashes))), False

    def places(hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        plain = hashes.astype(np.int64).view(_U)
        mixed = _mix(plain)
        return (plain >> _U(48)).astype(np.int64) & (blocks - 1), [(mixed >> _U(16 * k)).astype(np.int64) & (BLOOM_BLOCK - 1) for k in range(3)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches]
        hashes = np.concatenate([np.empty(0, np.int64), *held])
        if not len(hashes):
            return
        block, at = places(hashes)
        order = np.argsort(block, kind="stable")
        names, start = np.unique(block[order], return_index=True)
        for name, rows in zip(names, np.split(order, start[1:]), strict=True):
            bits = np.zeros(BLOOM_BLOCK // 8, np.uint8)
            for x in at:
                np.bitwise_or.at(bits, x[rows] >> 3, (1 << (x[rows] & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])
        release_memory()

    bloom = np.zeros((blocks, BLOOM_BLOCK // 8), np.uint8)
    dealt = wanted.select("hash").repartition(min(blocks, shuffle_partitions(wanted.sparkSession)), F.shiftrightunsigned("hash", 48).bitwiseAND(blocks - 1))
    for r in dealt.mapInArrow(mark, "block long, bits binary").collect():  # a block comes once: BLOOM_MOST bits in all
        bloom[r.block] |= np.frombuffer(r.bits, np.uint8)
    sent = wanted.sparkSession.sparkContext.broadcast(bloom)

    def keep(hashes: np.ndarray) -> np.ndarray:
        block, at = places(hashes)
        return np.flatnonzero(np.logical_and.reduce([sent.value[block, x >> 3] >> (x & 7) & 1 for x in at]))

    return keep, True


def _across(post: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs under one key whose components differ, less those that sizes or sketches rule out."""
    named = post.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    open_ = named.join(mixed, "key")
    few = F.slice(F.array_sort(F.collect_set("key")), 1, FIRSTS)
    firsts = open_.groupBy("set").agg(F.concat(few, F.array_repeat(F.lit(2**63 - 1), FIRSTS - F.size(few))).alias("firsts"))
    open_ = open_.join(nodes.select("set", F.col("brief").alias("sketch")).join(firsts, "set"), "set")
    salt = F.pmod(F.xxhash64("set"), F.col("salts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other")
    dealt = open_.withColumn("salt", salt).select("key", "set", "n", "label", "sketch", "firsts", "salt", "salts", other)
    dealt = dealt.select("key", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), "salt", "set", "n", "label", "sketch", "firsts")

    order = ["key", "low", "high", "n"]
    placed = dealt.repartition(shuffle_partitions(post.sparkSession), "key", "low", "high").sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                cols = [batch.column(c).to_numpy() for c in (*order, "salt", "set", "label")]
                cols.append(batch.column("firsts").flatten().to_numpy().reshape(-1, FIRSTS))
                cols.append(np.array(batch.column("sketch").to_pylist() + [None], object)[:-1])
                held = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            if not held:
                continue
            same = np.logical_and.reduce([c == c[-1] for c in held[:3]])
            end = len(same) if batch is None else int(len(same) - np.argmin(same[::-1]) if not same.all() else 0)
            pairs = _pairs([c[:end] for c in held], percent)
            held = [c[end:] for c in held]
            if len(pairs[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names=["a", "b"])
        release_memory()

    return placed.select(*order, "salt", "set", "label", "firsts", "sketch").mapInArrow(compare, "a long, b long").distinct()


def _pairs(cols: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets within the runs of one key whose labels differ, unless sizes or sketches rule them out or both sets' first keys hold
    a smaller one. Rows are sorted by key and size."""
    key, low, high, n, salt, sets, label, firsts, sketch = cols
    out = [np.empty((0, 2), np.int64)]
    sketches = Sketches(list(sketch))
    left, gap = np.arange(len(key)), 0
    while len(left):
        gap += 1
        left = left[left + gap < len(key)]
        right = left + gap
        on = (key[left] == key[right]) & (low[left] == low[right]) & (high[left] == high[right]) & (n[right] * percent <= n[left].astype(np.int64) * 100)
        left, right = left[on], right[on]  # sizes only grow, so what has ended stays so
        i = np.flatnonzero((label[left] != label[right]) & ((low[left] == high[left]) | (salt[left] != salt[right])))
        i = i[sketches.room(left[i], right[i], n, percent)]
        x, y = firsts[left[i]], firsts[right[i]]
        before = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] < key[left[i]][:, None, None])).any((1, 2))
        i = i[~before]  # these met under a smaller key already
        a, b = sets[left[i]], sets[right[i]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    both = np.unique(np.concatenate(out), axis=0)
    return both[:, 0].copy(), both[:, 1].copy()


def join(docs: DataFrame, width: int = 5, percent: int = 75, frequent: int = FREQUENT, block: int = BLOCK, row: Column | None = None) -> DataFrame:
    """Groups documents by links: two link when their sets' intersection is at least ``percent`` hundredths of their union.

    Sets: distinct runs of ``width`` words (shorter texts: the whole sequence); null, empty and blank texts have none and link with
    nothing. component_id is the smallest doc_id reachable by links; null doc_ids are never the smallest, a group of them has null.
    Equal sets link, so repeated rows share a component. An empty table gives no rows; other columns than doc_id and text are not used.
    Returns doc_id, n_shingles, component_id, group (one value for each component of documents with words, null for the others) and row,
    a long that the caller may give to tell rows apart.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), (F.lit(0) if row is None else row).cast("long").alias("row"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "row": pa.int64(), "hash": pa.int64(), "n": pa.int32(), "set": pa.int64(), "sketch": pa.binary(), "brief": pa.binary()}
        for batch in batches:
            rows = []
            for doc_id, text, code, own in zip(*batch.columns, strict=True):
                tokens = shingles(text.as_py(), width)
                rows.append((doc_id.as_py(), own.as_py(), code.as_py(), len(tokens), set_id(tokens), sketch := _sketch(tokens), _brief(sketch)))
            yield _rows(kinds, rows)
        release_memory()

    members = saved(docs.mapInArrow(describe, "doc_id long, row long, hash long, n int, set long, sketch binary, brief binary"), "members")
    keys, counts = frequent_tokens(docs, width, frequent, MOST_FREQUENT)
    post = postings(docs, width, percent, keys, counts, block)
    met = members.filter("n > 0").join(post.select("set").distinct(), "set", "left_semi")
    nodes = saved(met.groupBy("set").agg(F.min(F.struct("hash", "n", "sketch", "brief")).alias("x")).select("set", "x.*"), "nodes")
    near = saved(_possible(saved(_stand_ins(post, percent), "stars"), nodes, percent), "pairs")
    links = _verified(near, nodes, docs, width, percent)
    labels = components(links)
    rest = _across(post, nodes, labels, percent)
    turned = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = saved(_possible(saved(rest.join(turned, ["a", "b"], "left_anti"), "rest"), nodes, percent), "pairs")
    if not rest.isEmpty():
        links = links.union(_verified(rest, nodes, docs, width, percent))
        labels = components(links)
    groups = members.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    groups = saved(groups, "groups")
    smallest = groups.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = split_join(groups, smallest, "label", "set").select("set", "component_id", F.col("label").alias("group"))
    return _labelled(members, named)


def _labelled(members: DataFrame, named: DataFrame) -> DataFrame:
    """Joins components to documents; empty sets, which may be many, keep out of the join."""
    some = split_join(members.filter("n > 0").select("doc_id", "row", "n", "hash", "set"), named, "set", "doc_id").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "group", "row")
    none = members.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "row")
    return some.unionByName(none)


def op5(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")
