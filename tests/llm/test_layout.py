"""Shards, periodic runs and the Merkle manifest against their plain counterparts."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from staylake.llm import merkle, periodic, sharding
from staylake.llm.queries import QUERIES

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.fixture(scope="module")
def whole(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.fixture(scope="module")
def table_of(spark):
    """Rows with further columns whose names the operators use themselves."""

    def make(rows):
        df = spark.createDataFrame(rows, COLUMNS)
        return df.selectExpr("*", *(f"'x' as `{c}`" for c in "shard slot size _keep _h _b _n tree key leaf path rest sub n i l0 up given runs words root".split()))

    return make


def odd_rows(odd):
    """Every odd text, with null and empty sources and languages, repeated rows, repeated ids and null ids."""
    rows = [(d, (None, "", "a", "b")[d % 4], (None, "", "é", "Z", "a")[d % 5], None if d % 3 == 0 else d, t) for d, t in odd]
    return [*rows, rows[5], rows[5], (4, "a", "Z", 1, "other"), (None, "a", "Z", None, None), (None, "a", "Z", 2, "A b"), (-7, "a", None, 3, "Negative Id")]


PLACED = ("doc_id", "source", "size", "text_crc32", "shard", "slot")


def test_interleave(spark, whole, table_of, odd):
    for df, rows in ((QUERIES["op11_sharding"](spark, SF), whole), (sharding.interleave(table_of(odd_rows(odd))), odd_rows(odd))):
        got = [tuple(r) for r in df.select(*PLACED).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute.spread([(r[0], r[1], r[4]) for r in rows], 40, sharding.SEED)))
        assert {(r["law"], r["grown_shard"]) for r in df.select("law", "grown_shard").collect()} == {("rows", None)}


def test_interleave_mixture(spark, table_of):
    """One source with a third of the rows, one with a tenth, the rest with one or two rows each: every shard gets its share."""
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 10 == 1 else f"s{i // 2}", "en", 1, "x" * (i % 7)) for i in range(6000)]
    got = sharding.interleave(table_of(rows), shards=12).collect()
    total, shards = Counter(r["source"] for r in got), Counter(r["shard"] for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 12
    for s in ("hot", "warm"):
        have = Counter(r["shard"] for r in got if r["source"] == s)
        assert all(abs(have[k] - total[s] / 12) < 0.15 * total[s] / 12 for k in range(12))
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert set(slots) == {(k, i) for k in range(12) for i in range(shards[k])}


def test_interleave_few_and_none(spark, table_of, tmp_path):
    assert sharding.interleave(table_of([(1, "a", "b", 1, "t")]).limit(0)).collect() == []
    got = sharding.interleave(table_of([(i, "a", "b", 1, "t") for i in range(5)])).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, 0) for k in (0, 8, 16, 24, 32)]
    placed = sharding.interleave(table_of([(i, f"s{i % 3}", "b", 1, f"text {i}") for i in range(90)]), shards=4, keep=("text",))
    sharding.write_shards(placed, f"{tmp_path}/shards", file_rows=10)
    back = spark.read.parquet(f"{tmp_path}/shards")
    want = sorted((r["shard"], r["slot"], r["text"]) for r in placed.collect())
    assert sorted((r["shard"], r["slot"], r["text"]) for r in back.collect()) == want
    assert back.select("shard", "part").distinct().count() == 12


def periodic_row(doc_id, words):
    found = brute.periodic(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, brute.sha(listed), brute.sha(brute.collapsed(words, found))


def test_periodic_runs(spark, whole, docs_of, odd):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[n] for n in names) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()]
    want = [periodic_row(r[0], brute.moved(r[0], brute.words(r[4]))) for r in whole]
    assert sorted(got) == sorted(want) and sum(w[1] > 0 for w in want) > 10
    short = [(d, t) for d, t in odd if d not in (7, 8)]
    extra = [(30, "a " * 5), (31, "a " * 6), (32, "a b " * 4), (33, "a b " * 4 + "a c" * 9), (34, "x x x x x x y y y y y y"), (35, "a b c a b c " * 30), (35, "a " * 7), (None, "q " * 9)]
    for rows in (short + extra, []):
        got = periodic.find_runs(docs_of(rows) if rows else docs_of(short).limit(0)).collect()
        out = sorted(repr((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in got)
        assert out == sorted(repr((d, len(w), f := brute.periodic(w), brute.collapsed(w, f))) for d, w in ((d, brute.words(t)) for d, t in rows))


def test_periodic_long_text(docs_of):
    """A text of 200,000 words: one word, a long period with one break, and a Fibonacci-like word without fourth powers."""
    a, b = "a", "a b"
    while len(b) < 100_000:
        a, b = b, b + " " + a
    unit = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "z " * 200_000), (2, f"{unit} {unit} {unit} {unit} stop {unit}"), (3, b)]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.find_runs(docs_of(rows)).collect()}
    assert got[1] == [(0, 200_000, 1)] and got[2] == [(0, 80_000, 20_000)] and got[3] == []


def test_periodic_random():
    """Runs of small alphabets, repeated tails and doubled texts, many texts at once."""
    rng = random.Random(11)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.randint(0, 150), rng.choice([1, 2, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a, p = (x := rng.randrange(n)), 1 + (n - x) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w + [99] + w if rng.random() < 0.3 else w)
        text = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        flat = np.array([x for w in docs for x in w], np.int64)
        start, stop, period = periodic.runs(periodic._name(text, flat)[0], text) if len(flat) else ((), (), ())
        at, want = 0, []
        for w in docs:
            want += [(s + at, s + at + n, q) for s, n, q in brute.periodic(w)]
            at += len(w)
        assert sorted(zip(map(int, start), map(int, stop), map(int, period))) == sorted(want)


def test_grammar_is_re_pair():
    """Rules derive the words they stand on at every place, and no pair is left twice before the tree is put on top."""
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 4, 400), np.tile(np.arange(10, 17), 20)])
    g = periodic.Grammar(words, np.zeros(len(words), np.int64))
    derived: dict = {}
    for rule, at, split, end in zip(*map(np.concatenate, (g.rule, g.at, g.split, g.end))):
        assert at < split < end
        assert derived.setdefault(rule, tuple(words[at:end])) == tuple(words[at:end])
    again = Counter(np.concatenate(g.rule).tolist())
    assert max(len(derived[r]) for r, n in again.items() if n > 1) >= 56  # 20 periods of 7: eight of them are a rule used twice


def manifest_rows(df):
    return sorted(map(repr, (tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())))


def test_manifest(spark, whole):
    got = manifest_rows(QUERIES["op13_merkle_manifest"](spark, SF))
    assert got == sorted(map(repr, brute.manifest(whole))) and "False" in str(got) and "True" in str(got)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_heights(spark, table_of, odd, monkeypatch, levels):
    """Trees of one leaf to 700, with nodes kept at every level, every other, every third: the same proofs."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = odd_rows(odd) + [(100 + i, "s", "hot" if i < 700 else f"l{i % 3}" if i < 740 else f"one{i}", i, f"Text {i}") for i in range(800)]
    manifest = merkle.build(table_of(rows), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id")
    found = merkle.proofs(manifest).select(
        "key", "leaf", "subroot", "root", merkle.proof_hash(merkle.F.col("path")).alias("proof"), merkle.verify(merkle.F.col("leaf"), merkle.F.col("path"), merkle.F.col("root")).alias("ok")
    ).collect()
    want = [(*r[:5], True) for r in brute.manifest(rows)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_manifest_kept_and_parts(spark, table_of, tmp_path):
    rows = [(i, "s", "hot" if i < 600 else "b", i, f"Text {i}") for i in range(620)]
    manifest = merkle.build(table_of(rows), ["doc_id", "text"], "lang", "doc_id")
    merkle.write_manifest(manifest, f"{tmp_path}/m")
    back = merkle.read_manifest(spark, f"{tmp_path}/m")
    only = spark.createDataFrame([(5,), (599,), (610,), (10_000,)], "key bigint")
    part = {r["key"]: r for r in merkle.proofs(back, only).collect()}
    assert set(part) == {5, 599, 610}
    everything = {r["key"]: r for r in merkle.proofs(manifest).collect()}
    assert all(everything[k] == part[k] for k in part)
    small = merkle.build(table_of(rows[:3]), ["doc_id"], "lang", "doc_id")
    merkle.write_manifest(small, f"{tmp_path}/small")
    assert merkle.proofs(merkle.read_manifest(spark, f"{tmp_path}/small")).count() == 3
    assert merkle.proofs(merkle.build(table_of(rows).limit(0), ["doc_id"], "lang", "doc_id")).collect() == []
