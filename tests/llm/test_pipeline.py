"""The stages of the corpus pipeline, one after another, against their plain counterparts."""

import brute
import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F

from staylake.llm.common import stored


@pytest.fixture(scope="module")
def odd_docs(spark):
    """The smallest documents, with rows that each stage must drop, and columns named like those of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    text = docs.filter("length(text) > 1500 and lang = 'en'").orderBy("doc_id").first()["text"]
    rows = [(5001, None), (5002, ""), (5003, "12 !! 34"), (5004, text), (5005, text + " coda"), (5006, f"the start of it {item} and the end of it"), (None, "the one without a number")]
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    return both.select("*", F.lit("x").alias("leaks"), F.lit(1).alias("kept"), F.lit(0.5).alias("score"), F.lit("q").alias("lang_pred"))


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, odd_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "exact dedup", "near dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, have = odd_docs, rows_of(odd_docs)

    def apply(name):
        out = stages[name](spark, docs, SF)
        assert name == "packing" or out.columns == odd_docs.columns
        return stored(out)

    docs = apply("language id")
    want = {d: t for d, t in have.items() if any(c.isalpha() for c in t or "")}
    assert rows_of(docs) == want and {5001, 5002, 5003} & set(have) and not {5001, 5002, 5003} & set(want)

    have, docs = want, apply("exact dedup")
    last = {}
    for d, t in have.items():
        if d is not None:
            last[t] = max(d, last.get(t, d))
    want = {d: t for d, t in have.items() if d is None or last[t] == d}
    assert rows_of(docs) == want and 5004 in want and len(want) < len(have)

    have, docs = want, apply("near dedup")
    kept = brute.near([(d, t) for d, t in have.items() if d is not None], 5)
    want = {d: t for d, t in have.items() if d is None or kept[d][2]}
    assert rows_of(docs) == want and 5005 not in want and None in want

    have, docs = want, apply("decontamination")
    clean = rows_of(docs)
    want = {d: t for d, t in have.items() if not any(i in " ".join(t.lower().split()) for i in items)}
    assert set(clean) <= set(want) and len(want) - len(clean) <= 2 and 5006 not in clean and None in clean  # items with edits go too

    placed = apply("packing").collect()
    assert {r["doc_id"] for r in placed} == set(clean)
    filled = {}
    for r in placed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_documents(spark, odd_docs):
    docs = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_nothing_learned_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "more text", None)], "doc_id bigint, text string, lang string")
    assert corpus_pipeline.detect_language(spark, docs, SF).count() == 2


def test_workers_keep_one_model():
    """A worker's models of one stage are gone when the next one runs."""
    from staylake.llm import language_id, near_dedup, packing, words

    sample = {"aa": "ab ba", "bb": "cd dc"}
    model = language_id._model(sample)
    assert language_id._model(sample) is model and len(words._KEPT) == 1
    known = packing.word_ids(packing.default_tokenizer())
    assert packing.word_ids(packing.default_tokenizer()) is known and list(words._KEPT.values()) == [known]
    assert list(near_dedup._describe(2)([])) == [] and not words._KEPT
