"""The pipeline, stage by stage against brute force on a small table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import brute_groups, brute_lines, sentence
from wardline.llm import bpe, lang_id
from wardline.llm.common import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(9)
    texts = [sentence(r, r.randint(5, 80)) for _ in range(150)] + [None, "", "12 34"]
    texts += [texts[k] + " more" for k in range(20)] + ["notice line\n" + sentence(r, 30) for _ in range(15)] + ["the same text twice over and over"] * 4
    rows = [(i, t, r.choice(["en", "fr"]), r.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1))
    df.write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = saved(stage(spark, docs, table), name)
        after = docs.collect()
        if i < 4:
            assert docs.columns == COLUMNS
        if name == "language":
            assert {x.doc_id for x in before} - {x.doc_id for x in after} == {x.doc_id for x in before if not any(c.isalpha() for c in x.text or "")}
        elif name == "lines":
            want = brute_lines([(x.doc_id, x.text) for x in before], 10)
            assert sorted((x.doc_id, x.text) for x in after) == sorted((w[0], w[3]) for w in want)
            assert all(x.n_chars == len(x.text) for x in after)
        elif name == "near_duplicates":
            own = sorted(before, key=lambda x: x.doc_id)
            groups = brute_groups([x.text for x in own])
            assert {x.doc_id for x in after} == {own[k].doc_id for k, (_, top) in groups.items() if k == top} and len(after) == len({x.doc_id for x in after})
        elif name == "mixture":
            assert {x.doc_id for x in after} <= {x.doc_id for x in before} and len(after) > len(before)
        else:
            lib = bpe.codec(bpe.default_path()).library
            assert len(after) == len(before)
            ids = {x.doc_id: lib.encode(x.text, add_special_tokens=False).ids for x in before}
            assert all(x.ids_sha256 == hashlib.sha256(",".join(map(str, ids[x.doc_id])).encode()).hexdigest() for x in after)


def test_encoded_mix_has_ids(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    lib = bpe.codec(bpe.default_path()).library
    got = {x.doc_id: x for x in corpus_pipeline.encoded(spark, docs, table).collect()}
    for x in docs.collect():
        ids = lib.encode(x.text or "", add_special_tokens=False).ids
        assert got[x.doc_id].ids == ids and got[x.doc_id].n_tokens == len(ids)
        assert got[x.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_tables(spark, tmp_path):
    """Empty tables; null doc_ids, null texts, repeated rows and columns with clashing names."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven"
    rows = [(None, None, None, None, None), (None, text, "en", None, 5), (None, text, "en", None, 5), (1, text + " eight nine ten", "en", "a", 9), (1, "other words entirely here", "en", "a", 9), (2, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, kinds)
    for c in ("row", "group", "_row", "size", "copies", "bucket", "set", "hash", "order"):
        df = df.withColumn(c, F.lit("x"))
    for name, table in (("rows", df), ("none", df.limit(0))):
        path = str(tmp_path / name)
        table.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        got = {}
        for stage, function in corpus_pipeline.STAGES:
            got[stage] = [tuple(x)[:5] for x in saved(function(spark, docs, path), stage).collect()]
        if name == "none":
            assert not any(got.values()) and corpus_pipeline.run(spark, path).count() == 0
            continue
        assert sorted(got["language"], key=str) == sorted(((i, t, "en", s, n) for i, t, _, s, n in rows[1:5]), key=str)
        assert len(got["lines"]) == len(got["encoded"]) == len(rows)
        assert sorted(got["near_duplicates"], key=str) == sorted({r for r in rows if r != rows[3]} | {rows[3]}, key=str)
        assert {r[:2] for r in got["mixture"]} <= {r[:2] for r in rows if r[1]}
        assert corpus_pipeline.run(spark, path).count() > 0


def test_rows_with_one_hash_stay_apart(spark, table, monkeypatch):
    """Were all hashes of rows equal, no document of the mix would be lost or changed."""
    docs = spark.read.parquet(f"{table}/documents.parquet")
    own = {x.doc_id: x.text for x in docs.collect()}
    monkeypatch.setattr(corpus_pipeline, "_row", lambda df: F.lit(7).cast("long"))
    got = corpus_pipeline.mixture(spark, docs.filter("doc_id < 20"), table).select("doc_id", "text").distinct().collect()
    assert {x.doc_id for x in got} == set(range(20)) and all(x.text == own[x.doc_id] for x in got)


def test_language_without_labels(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    lettered = {x.doc_id for x in docs.collect() if any(c.isalpha() for c in x.text or "")}
    got = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), table).collect()
    assert {x.doc_id for x in got} == lettered and {x.lang for x in got} == {"und"}
    held = docs.filter(lang_id.held_out())
    got = corpus_pipeline.language(spark, held, table).collect()
    assert {(x.doc_id, x.lang) for x in got} == {(x.doc_id, x.lang) for x in held.collect() if x.doc_id in lettered} and got
