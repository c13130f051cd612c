"""Every operator against its plain counterpart, on the smallest documents and on odd ones."""

import hashlib
import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from staylake.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_score, near_dedup, packing, pii, substring_dedup
from staylake.llm.queries import QUERIES
from staylake.llm.words import word_hashes


def answer(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def test_license_scan(spark, docs_of, small, odd):
    for df, rows in ((QUERIES["op1_license_scan"](spark, SF), small), (license_scan.license_scan(docs_of(odd)), odd)):
        got = answer(df, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        for d, t in rows:
            want = brute.licenses(t)
            assert got[d][:5] == want, d
            assert set(want[4].split(",")) - {""} <= set(got[d][5].split(",")) and 0 <= got[d][6] <= 1
            assert bool(got[d][5]) == (got[d][6] > 0)


def test_license_rules(docs_of):
    texts = {
        1: "SPDX-License-Identifier: BSD-3-Clause", 2: "Licensed under CC BY-NC-SA 4.0.", 3: "This work is licensed under the GNU General Public License, version 3.",
        4: "He has a driving licence. Mit der Zeit.", 5: "Released under the Mozilla Public License 2.0 license", 6: "dual licensed under mit; licensed under the Apache 2.0 license",
    }
    got = answer(license_scan.license_scan(docs_of(texts.items())), "labels", "n_findings", "findings")
    assert {d: g[0] for d, g in got.items()} == {1: "bsd-3", 2: "cc-by-nc,cc-by-nc-sa", 3: "gpl-3", 4: "", 5: "mpl-2", 6: "apache-2,mit"}
    assert got[2][1] == 1  # the shorter finding lies inside the longer one and is suppressed
    assert len(license_scan.rules()) > 300


def test_substring_dedup(spark, docs_of, small, odd):
    for df, rows in ((QUERIES["op2_substring_dedup"](spark, SF), small), (substring_dedup.substring_dedup(docs_of(odd)), odd)):
        if "kept_sha256" in df.columns:
            got = answer(df, "n_words", "n_removed", "kept_sha256")
        else:
            got = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in answer(df, "n_words", "n_removed", "kept_text").items()}
        assert got == brute.substrings(rows)
    rows = df.select("doc_id", "longest_repeat").collect()
    longest = {r[0]: r[1] for r in rows}
    assert longest[7] == longest[8] and longest[7] >= 13 * 1024 and longest[9] == 52 and longest[13] == 13 and longest[4] == 0


def test_near_dedup(spark, docs_of, small, odd):
    for df, rows in ((QUERIES["op3_near_dedup"](spark, SF), small), (near_dedup.near_dedup(docs_of([*odd, (5, "ONE"), (None, "one")])), odd)):
        got = answer(df, "n_shingles", "component_id", "kept")
        assert got.pop(None, (1, None, True)) == (1, None, True)
        assert got == brute.near(rows)


def test_near_dedup_large_groups(docs_of):
    """Chains, and a group whose members are near the threshold from each other, over several rounds."""
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for d in range(1, 60):  # edits of one source: linked through it, about 0.8 from each other
        w = list(words)
        for i in rng.choice(120, 6, replace=False):
            w[i] = f"e{d}_{i}"
        rows.append((1000 - d, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for d in range(30):
        rows.append((2000 + d, " ".join([*chain[d * 2 :], *(f"z{i}" for i in range(d * 2))])))
    assert answer(near_dedup.near_dedup(docs_of(rows)), "n_shingles", "component_id", "kept") == brute.near(rows)


def test_near_dedup_by_differences(docs_of):
    """Edits of one source that are mostly no links of each other, with links and copies among them, in rows of shingles of two and five words."""
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(200)]
    rows = [(5000, " ".join(words))]
    for d in range(300):
        w = list(words)
        for i in rng.choice(200, 9, replace=False):
            w[i] = f"e{d}_{i}"
        rows.append((d, " ".join(w)))
        if d % 10 == 0:  # a text near this one only, and an exact copy of it
            w[(d * 7) % 200] = f"n{d}"
            rows += [(1000 + d, " ".join(w)), (2000 + d, " ".join(w))]
    rows += [(6000 + d, " ".join(f"u{d}_{i % 150}" for i in range(150 + d))) for d in range(20)]
    for size in (2, 5):
        assert answer(near_dedup.near_dedup(docs_of(rows), size=size), "n_shingles", "component_id", "kept") == brute.near(rows, size)


def test_parity_bounds_difference():
    """Sketches differ in at most as many bits as the sets differ in members, and in nearly as many where that is few."""
    rng = np.random.default_rng(3)
    for own in (0, 1, 5, 40, 3000):
        both, a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (200, own, own))
        x, y = (near_dedup.parity(np.unique(np.concatenate([both, z]))).view(np.uint64) for z in (a, b))
        bits = int(np.bitwise_count(x ^ y).sum())
        assert len(x) == near_dedup.PARITY and bits <= 2 * own and (own > 5 or bits >= 2 * own - 4)


def test_shingle_sizes():
    cut = lambda text, size: set(near_dedup.shingles(text.encode().split(), size).tolist())
    assert cut("", 2) == cut("", 5) == set()
    for size in (2, 5):
        assert len(cut("a b c d e f", size)) == 7 - size and len(cut("a a a a a a", size)) == 1
        assert len({*cut("a", size), *cut("b", size)}) == 2
    assert len(cut("a b c", 5)) == 1 and cut("a b c", 5) != cut("a b d", 5) and not cut("a b c d", 5) & cut("a b c d e", 5)


def test_signature_keys():
    """Signatures that differ in at most REACH values share a key, wherever the differences are."""
    import pyarrow as pa

    from staylake.llm.words import lists

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (300, near_dedup.VALUES)).astype(np.int32)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.VALUES, near_dedup.REACH, replace=False)] ^= 1
    def keys(m):
        (out,) = near_dedup._packed([pa.record_batch([pa.array(range(len(m)), pa.int64()), lists(list(m), np.int32)], ["node", "sig"])])
        return np.array(out["keys"].to_pylist())
    assert (keys(a) == keys(b)).any(axis=1).all()


def test_packing(spark, docs_of, small, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for docs, rows in ((docs_of(small), small), (docs_of(odd), odd)):
        tokens = packing.tokenize(docs)
        placed = packing.pack(tokens.drop("ids"))
        ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
        found, filled = defaultdict(list), defaultdict(list)
        for r in placed.collect():
            found[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
            filled[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["start"]))
        assert {d: sorted(x) for d, x in found.items()} == {d: [(k, a, min(4096, len(x) - a)) for k, a in enumerate(range(0, len(x), 4096))] for d, x in ids.items()}
        for parts in filled.values():
            at = 0
            for offset, length, _, _ in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(filled) <= -(-sum(map(len, ids.values())) // 4096) + 1
        for r in packing.sequences(tokens, placed).collect():  # round trip
            got = np.frombuffer(r["ids"], "<u4").tolist()
            assert got == [i for o, n, d, s in sorted(filled[r["sequence_id"]]) for i in ids[d][s : s + n]]


def test_packing_plan():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 101, 400), np.minimum(100, rng.geometric(1 / 20, 500)), [100] * 3, [51] * 7, []):
        counts = Counter(int(s) for s in sizes)
        plan = packing.plan(counts, 100)
        used = Counter()
        for filling, times in plan:
            assert sum(filling) <= 100
            for s in filling:
                used[s] += times
        assert used == counts
        decreasing: list[int] = []  # best-fit decreasing, piece by piece
        for s in sorted(map(int, sizes), reverse=True):
            fits = [i for i, room in enumerate(decreasing) if room >= s]
            if fits:
                decreasing[min(fits, key=lambda i: decreasing[i])] -= s
            else:
                decreasing.append(100 - s)
        assert sum(t for _, t in plan) <= len(decreasing) + 1
    assert packing.completion(np.array([0, 0, 0, 2, 3, 1, 0, 0, 0, 0, 0]), 10) == [4, 3, 3]  # best fit alone, 5 and 4, would waste 1


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    texts = ["it's, O'Neil's. a.'s THE. é. x̸. ≮ ,. |", "a\x1cb  x́ ́y\n\n\t q", "İ ß 한국 ÀÉ Σς. ΑΣ", "", " ", "12 3,4. don't!!", "ﬁ Å a b"]
    texts += ["a <|endoftext|> b", "x<|endoftext|>y.<|startoftext|>\nlast", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext|>" * 3, "end of<|endoftext|"]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert packing.WordIds(packing.default_tokenizer()).encode(texts) == want
    assert np.frombuffer(want[-5], "<u4").tolist() == [320, 49407, 321]


def test_tokens_by_units():
    """Each different unit of a column is looked up once, whatever marks stand around it, and ids are those of the tokenizer."""
    import pyarrow as pa

    texts = ["x", "aİ| İ. |İ|", "The the, THE. (the) the\nthe", "ÀÉ×é÷ÿ É9é12 é", "\n\n \n", "it's 'a' b", "國.| 1a²", ""] * 3
    known = packing.WordIds(packing.default_tokenizer())
    want = [np.asarray(e.ids, "<u4").tobytes() for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert known.encode(pa.array(texts).slice(1)) == want[1:]
    at, units, places = packing.cut_units(pa.array(["The the, THE.", "", "the it's 7é7"]))
    assert sorted(units) == sorted([b"the", b" ", b",", b".", b"it's", b"7", "é".encode()])
    assert at.tolist() == [0, 7, 7, 14] and len(places) == 14


def test_decontaminate(spark, docs_of, small, odd):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {i: " ".join(t.lower().split()) for i, t in items}
    changed = plain[0].replace("th", "ht", 2)
    rows = [*small, (9001, "before " + changed + " after"), (9002, None), (9003, "x" * 50_000), (9004, plain[1][: len(plain[1]) // 2])]
    bench = spark.createDataFrame([*items, items[0], (None, "x"), (77_777, None), (88_888, "short"), (99_999, "")], "item_id bigint, text string")
    got = {}
    for block in (decontaminate.BLOCK_CHARS, 2000):
        df = decontaminate.decontaminate(docs_of(rows), bench, block_chars=block)
        got[block] = {r["doc_id"]: sorted((x["item_id"], x["distance"]) for x in r["leaks"]) for r in df.select("doc_id", "leaks").collect()}
    assert got[decontaminate.BLOCK_CHARS] == got[2000]
    for d, t in rows:
        exact = {i for i, p in plain.items() if p in " ".join((t or "").lower().split())}
        assert {i for i, k in got[2000][d] if k == 0} == exact
    assert [i for i, _ in got[2000][9001]] == [0] and not got[2000][9002] and not got[2000][9003] and not got[2000][9004]


def edits(p: str, t: str) -> int:
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, z in enumerate(t):
            new.append(min(row[j] + (c != z), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontaminate_edits():
    """Items with random edits are found exactly up to their budget, with their true distance."""
    import random

    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcde fghi") for _ in range(rng.randint(20, 150)))) for i in range(12)]
    index = decontaminate.Index(items, decontaminate.Q, decontaminate.RATE)
    for _ in range(150):
        i, t = rng.choice(items)
        s = list(" ".join(t.lower().split()))
        item, most = "".join(s), decontaminate.budget(len(s))
        for _ in range(rng.randint(0, most + 4)):
            p, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.34:
                s[p] = "q"
            elif kind < 0.67:
                del s[p]
            else:
                s.insert(p, "z")
        text = "kkkk lll mmm " + "".join(s) + " nnn ooo"
        true = edits(item, " ".join(text.lower().split()))
        assert dict(index.leaks(text)).get(i) == (true if true <= most else None)


def test_exact_dedup(spark, docs_of, odd):
    rows = [*odd, (10, BASE_TWICE := "same text"), (40, BASE_TWICE), (None, "one"), (None, "alone")]
    got = exact_dedup.exact_dedup(docs_of(rows)).collect()
    want = defaultdict(list)
    for d, t in rows:
        want[t or ""].append(d)
    expected = sorted(((d, max([x for x in want[t or ""] if x is not None], default=None), len(want[t or ""])) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == expected
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_dedup_prefix(docs_of):
    """Texts of one length that differ only after the prefix, or only in length, stay apart."""
    a = "p" * 300
    rows = [(1, a + "x"), (2, a + "y"), (3, a + "x"), (4, a), (5, "é" * 2), (6, "e" * 4)]
    got = answer(exact_dedup.exact_dedup(docs_of(rows)), "keep_id", "group_size", "kept")
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 1, True)}


def test_line_dedup(docs_of, small, odd):
    for rows in (small, odd):
        got = answer(line_dedup.line_dedup(docs_of(rows)), "n_lines", "n_removed", "kept_text")
        assert {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in got.items()} == brute.lines(rows)


def test_longest_repeat_looks_at_every_place(docs_of):
    """Stretches shared by two texts in other surroundings, each with the level of its length; rows of one doc_id do not mix."""
    sizes = [13, 25, 26, 27, 30, 40, 51, 52, 60, 103, 104]
    text = lambda who, i, n: " ".join([*(f"{who}{i}a{k}" for k in range(20 + i)), *(f"s{i}x{k}" for k in range(n)), *(f"{who}{i}z{k}" for k in range(31))])
    rows = [(2 * i + side, text("lr"[side], i, n)) for i, n in enumerate(sizes * 3) for side in (0, 1)]
    halves = [" ".join(f"{c}{k}" for k in range(13)) for c in "pqrs"]
    rows += [(900, f"{halves[0]} {halves[1]}"), (900, f"{halves[2]} {halves[3]}"), (901, f"{halves[0]} {halves[3]}")]
    got = {(r[0], r[1]) for r in substring_dedup.substring_dedup(docs_of(rows)).select("doc_id", "longest_repeat").collect()}
    want = {(2 * i + side, max(m for m in (13, 26, 52, 104) if m <= n)) for i, n in enumerate(sizes * 3) for side in (0, 1)}
    assert got == want | {(900, 13), (901, 13)}


def test_substring_tables_hold_no_row_per_window(docs_of, monkeypatch):
    """Windows go back to their documents as lists: no written table has more rows than there are texts and levels."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 5, 300 + i % 7))) for i in range(12)]
    sizes, write = [], substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df: sizes.append((t := write(df)).count()) or t)
    got = answer(substring_dedup.substring_dedup(docs_of(rows)), "n_words", "n_removed", "longest_repeat")
    assert max(sizes) <= len(rows)
    assert got[0] == (300, 0, 208) and all(g[2] == 208 for g in got.values()) and got[5][:2] == (305, 304)


def test_word_hashes_of_texts_side_by_side():
    """Words are cut as bytes.split() does, and equal words alone have equal hashes, wherever they stand."""
    texts = ["", " ", "a", " a\tbb  ", "a\x00", "\x1cx\xa0é\x85 日\x0b本\x0cé"] + ["x" * n + " " + "x" * (n + 1) for n in range(1, 140)]
    sizes, h = word_hashes(pa.array(texts))
    words = [w for t in texts for w in t.encode().split()]
    assert sizes.tolist() == [len(t.encode().split()) for t in texts]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    assert [len(x) for x in word_hashes(pa.array([], pa.string()))] == [0, 0]


def test_pii(spark, docs_of, small, odd):
    models = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for df, rows in ((QUERIES["op8_pii"](spark, SF), small), (pii.find_pii(docs_of(odd), models), odd)):
        key = "base_sha256" if "base_sha256" in df.columns else "base"
        got = answer(df, "n_email", "n_ip", "n_card", "n_phone", key, "spans")
        for d, t in rows:
            want = brute.personal(t)
            assert got[d][:4] == want[:4] and got[d][4] == want[4 if key == "base_sha256" else 5], d
            assert set(want[5].split(",")) <= {*got[d][5].split(","), ""}


def test_pii_patterns():
    for t in ("a@b.c_d@e.f", "x@y@z.w", "@a.b", "q%w+e@r-t.y.z. @", "1.2.3.4.5.6.7.8", "1.2.3.4.300.1.2.3", "01.002.000255.4", "+1 2 3 4 5 6 7 8 9)", "0" * 4000 + ".1.2.3", "a" * 30_000 + "@b"):
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(t)) == brute.personal(t)[5]


def test_pii_trees_add_spans(docs_of):
    """Numbers grouped like the known phone numbers, but without a plus, are found; plain numbers are not."""
    rng = np.random.default_rng(7)
    rows = []
    for d in range(400):
        a, b, c = rng.integers(100, 999), rng.integers(100, 999), rng.integers(1000, 9999)
        rows.append((d, f"please call +1 ({a}) {b}-{c} today" if d % 2 else f"we counted {rng.integers(10**7, 10**10)} of {rng.integers(10**8, 10**9)} things"))
    models = pii.fit(docs_of(rows))
    assert models[3][1] < 1
    got = answer(pii.find_pii(docs_of([(1, "you may call 1 (555) 321-7654 now"), (2, "we counted 123456789 of them"), (3, None)]), models), "spans", "n_phone", "redacted")
    assert got == {1: ("phone:13:29", 0, "you may call <phone> now"), 2: ("", 0, "we counted 123456789 of them"), 3: ("", 0, "")}


def test_pii_fit_reads_all(docs_of):
    """Trees and thresholds are those of all candidates: more than 40,000 of them, in more than 2,000 documents."""
    rng = np.random.default_rng(11)
    rows = [(d, " ".join(f"{'call +' if rng.random() < 0.4 else 'item '}{rng.integers(10**8, 10**10)} of" for _ in range(20))) for d in range(2500)]
    examples = Counter()
    for r in pii._examples([docs_of(rows).selectExpr("shiftright(xxhash64(doc_id), 7) & 1 = 1 half", "text").toArrow().combine_chunks().to_batches()[0]]):
        for kind, half, x, n, right in zip(*(r[c].to_pylist() for c in ("kind", "half", "x", "n", "right"))):
            examples[kind, half, x, True] += right
            examples[kind, half, x, False] += n - right
    assert sum(examples.values()) >= 50_000
    models = pii.fit(docs_of(rows))
    (trees, least), part = models[3], {}
    for half in (True, False):
        own = [(x, y) for (kind, h, x, y), n in examples.items() if (kind, h) == (3, half) for _ in range(n)]
        part[half] = np.array([np.frombuffer(x) for x, _ in own]), np.array([y for _, y in own], float)
    want = pii.Boosted(*part[True])
    assert trees.start == want.start and all(np.allclose(a, b) for a, b in zip(trees.edges, want.edges))
    got, expected = (m.predict(part[False][0]) for m in (trees, want))
    assert np.allclose(got, expected, atol=1e-6)
    assert least == pytest.approx(pii.threshold(got, part[False][1]), abs=1e-6)


def test_boosting():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    trees = pii.Boosted(x[:1500], y[:1500])
    p = trees.predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97
    least = pii.threshold(p, y[1500:])
    assert y[1500:][p >= least].mean() >= pii.PRECISION and pii.threshold(np.ones(30), np.zeros(30)) == math.inf


def test_language_id(spark, docs_of, small, odd):
    rows = QUERIES["op9_language_id"](spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(small) and all(r["held_out"] == (brute.crc(r["doc_id"], 3) == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    docs = docs_of([*odd, (31, "1234 !!"), (32, "Ж" * 300)])
    got = answer(language_id.language_id(docs, {"en": "this is the text of one language", "de": "das ist ein satz der anderen"}), "lang_pred", "score")
    for d, t in [*odd, (31, "1234 !!"), (32, "Ж")]:
        assert (got[d][0] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[d][1] <= 1
    nothing = language_id.learned(docs_of(odd).selectExpr("*", "cast(null as string) as lang"))
    assert nothing == {} and {r["lang_pred"] for r in language_id.language_id(docs, {}).collect()} == {"und"}


def test_packing_searches_plans():
    """Plans that no greedy pass finds: the search goes back over sequences."""
    pieces = [40, 39, 37, 36, 35, 33, 31, 25, 24]
    plan = packing.plan(dict.fromkeys(pieces, 1), 100)
    assert sum(t for _, t in plan) == 3 and sorted(s for f, t in plan for s in f * t) == sorted(pieces)
    rng = np.random.default_rng(5)

    def fewest(left):
        """Sequences needed, by trying every place of every piece."""
        best = len(left)

        def put(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(left):
                best = len(rooms)
                return
            for r in set(rooms):
                if r >= left[i]:
                    rest = list(rooms)
                    rest.remove(r)
                    put(i + 1, [*rest, r - left[i]])
            put(i + 1, [*rooms, 30 - left[i]])

        put(0, [])
        return best

    for _ in range(60):
        pieces = sorted(rng.integers(3, 20, 9).tolist(), reverse=True)
        plan = packing.plan({s: pieces.count(s) for s in pieces}, 30)
        assert sum(t for _, t in plan) == fewest(pieces) and sorted((s for f, t in plan for s in f * t), reverse=True) == pieces
        assert all(sum(f) <= 30 for f, _ in plan)


def test_language_sample_of_all_lengths(spark):
    """Labels with long texts only, with short texts only, and many labels all have a sample; a tiny one wins nothing."""
    rng = np.random.default_rng(3)

    def prose(letters, n):
        words = ["".join(rng.choice(list(letters), 4)) for _ in range(40)]
        return lambda: " ".join(rng.choice(words, n))

    long, short = prose("abcdefgh", 3_000), prose("fghijklm", 4)
    rows = [(d, long(), "long") for d in range(9)] + [(d + 100, short(), "short") for d in range(300)] + [(d + 1_000, "ok", f"x{d}") for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language_id.labelled_sample(docs)
    assert len(sample) == 82 and len(sample["long"]) == min(language_id.SAMPLE_CHARS, 9 * language_id.STRETCH + 8) and len(sample["short"]) > 5_000
    model = language_id.Model(sample)
    assert model.predict([long(), *(short() for _ in range(20))])[0] == ["long"] + ["short"] * 20


def test_language_of_many_scripts(monkeypatch):
    """Scripts of many letters keep their letters: languages of the rarest ones are told apart, by tables and by sorted edges."""
    rng = np.random.default_rng(6)
    scripts = {"latin": range(97, 123), "greek": range(0x3B1, 0x3C9), "cyrillic": range(0x430, 0x450), "han a": range(0x4E00, 0x4F00), "han b": range(0x4E80, 0x4F80), "hangul": range(0xAC00, 0xAD00)}

    def prose(letters):
        words = ["".join(map(chr, rng.choice(list(letters), 3))) for _ in range(200)]
        return lambda n: " ".join(rng.choice(words, n))

    write = {lang: prose(letters) for lang, letters in scripts.items()}
    sample = {lang: w(3_000 if lang == "latin" else 800) for lang, w in write.items()}
    texts, want = zip(*((w(30), lang) for lang, w in write.items() for _ in range(5)))
    langs, score = language_id.Model(sample).predict(list(texts))
    assert langs == list(want)
    monkeypatch.setattr(language_id, "DENSE", 0)
    again = language_id.Model(sample).predict(list(texts))
    assert again[0] == langs and (again[1] == score).all()


def test_suffix_automaton():
    """Exactly the substrings of the sample can be read, and phrases are the longest matches."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 3, 60).astype(np.uint8)
    table = language_id.transitions(codes, 3)
    text = bytes(codes)
    for _ in range(400):
        probe = rng.integers(0, 3, rng.integers(1, 9)).astype(np.uint8)
        state = 1
        for c in probe:
            state = table[state, c] if state else 0
        assert bool(state) == (bytes(probe) in text)
    model = language_id.Model({"aa": "abcabdabe abcd", "bb": "zzz yx zyx"})
    for t in ("abcabd", "abcdabxz", "zyxabc" * 90):
        for k, lang in enumerate(model.langs):
            sample, coded, phrases = bytes(model.codes({"aa": "abcabdabe abcd", "bb": "zzz yx zyx"}[lang])), model.codes(t), 0
            for a in range(0, len(coded), language_id.SEGMENT):
                part, i = bytes(coded[a : a + language_id.SEGMENT]), 0
                while i < len(part):
                    n = 1
                    while i + n < len(part) and part[i : i + n + 1] in sample and part[i : i + n] in sample:
                        n += 1
                    i, phrases = i + n, phrases + 1
            assert abs(model.entropies([coded])[0, k] - phrases * model.bits[k] / len(coded)) < 1e-9


def test_lm_score(spark, docs_of, small, odd):
    for df, rows in ((QUERIES["op10_lm_score"](spark, SF), small), (lm_score.lm_score(docs_of([*odd, (23, "one two"), (None, "one")])), [*odd, (23, "one two"), (None, "one")])):
        got = sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
        want = sorted(brute.unigram(rows), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) <= 1e-9 * abs(w[5]) + 1e-9 and g[6] <= 1e-9 for g, w in zip(got, want))


def test_lm_score_rare_words_join(docs_of, small, monkeypatch):
    """Words looked up in memory and words that are joined give the same scores."""
    want = answer(lm_score.lm_score(docs_of(small), steps=0), "n_known", "base_score", "score")
    monkeypatch.setattr(lm_score, "FREQUENT", 50)
    got = answer(lm_score.lm_score(docs_of(small), steps=0), "n_known", "base_score", "score")
    assert all(got[d][0] == want[d][0] and np.allclose(got[d][1:], want[d][1:], rtol=1e-9) for d in want)


def test_lm_gradient_and_sum(docs_of):
    """Steps raise the likelihood of the training texts, and class shares sum to one."""
    rng = np.random.default_rng(8)
    vocabulary = [f"t{i}" for i in range(40)]
    rows = []
    for d in range(200):
        i, w = 0, []
        for _ in range(60):
            i = (i * 3 + 1 + int(rng.random() < 0.2) * int(rng.integers(40))) % 40
            w.append(vocabulary[i])
        rows.append((d, " ".join(w)))
    docs, totals = docs_of(rows), []
    for steps in (0, 2, 4):
        r = lm_score.lm_score(docs, steps=steps).where("not held_out").selectExpr("sum(score)", "sum(base_score)").first()
        totals.append(r[0])
    assert totals[0] < totals[1] < totals[2] and totals[0] > r[1]
    share, weight = np.full(lm_score.CLASSES, 1 / lm_score.CLASSES), rng.normal(size=(sum(lm_score.ROWS), lm_score.CLASSES))
    at = [np.array([1, 2]), np.array([5000, 5001]), np.array([9000, 9001])]
    p = lm_score.Weights(share, weight).odds(at)
    want = share * np.exp(sum(weight[r] for r in at))
    assert np.allclose(p / p.sum(axis=1, keepdims=True), want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_lm_gradient(docs_of, small):
    """The gradient summed by tasks is seen minus expected classes, token by token."""
    rng = np.random.default_rng(11)
    share = rng.dirichlet(np.ones(lm_score.CLASSES))
    model = lm_score.Weights(share, rng.normal(size=(sum(lm_score.ROWS), lm_score.CLASSES)))
    got = lm_score._gradient(docs_of(small[:40]).repartition(3), model)
    want = np.zeros_like(got)
    for _, t in small[:40]:
        cls, rows = lm_score.features(lm_score.hashes(lm_score.tokens(t or "")))
        p = model.odds(rows)
        p = -p / p.sum(axis=1, keepdims=True)
        p[np.arange(len(cls)), cls] += 1
        for r in rows:
            np.add.at(want, r, p)
    assert np.allclose(got, want, atol=1e-3)


def test_lm_known_counts_are_not_counted_again(docs_of, small, monkeypatch):
    """Texts are coded side by side as they are one by one, and a pass with known counts only sums what is expected."""
    cut = [lm_score.tokens(t or "") for _, t in small[:20]] + [lm_score.tokens(""), lm_score.tokens("one"), lm_score.tokens("")]
    size, cls, rows = lm_score.coded(cut, lm_score.ROWS)
    alone = [lm_score.features(lm_score.hashes(ws)) for ws in cut]
    assert size.tolist() == list(map(len, cut)) and (cls == np.concatenate([c for c, _ in alone])).all()
    assert all((r == np.concatenate([rs[i] for _, rs in alone])).all() for i, r in enumerate(rows))
    docs, seen = docs_of(small[:40]).repartition(3), lm_score.count(docs_of(small[:40]))[1]
    given = np.full(lm_score.CLASSES, 1 / lm_score.CLASSES), np.zeros((sum(lm_score.ROWS), lm_score.CLASSES)), lm_score.ROWS
    want = lm_score._gradient(docs, lm_score.Weights(*given))
    monkeypatch.setattr(lm_score, "count", None)
    assert np.allclose(lm_score._gradient(docs, lm_score.Weights(*given, seen)), want, atol=1e-3)
    monkeypatch.setattr(lm_score, "SUMMED", lm_score.TOKENS)  # as with many contexts
    assert np.allclose(lm_score._gradient(docs, lm_score.Weights(*given, seen)), want, atol=1e-3)


def test_lm_updates_cut_no_text(docs_of, small, monkeypatch):
    """Updates read the contexts that the counting pass wrote, one row per text, and give what the texts give."""
    docs = docs_of(small[:40]).repartition(3)
    _, seen, contexts = lm_score.count(docs)
    codes = contexts.select("codes").filter("codes is not null")
    assert codes.count() == 40
    model = lm_score.Weights(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES), np.zeros((sum(lm_score.ROWS), lm_score.CLASSES)), lm_score.ROWS, seen)
    assert np.allclose(lm_score._gradient(codes, model), lm_score._gradient(docs, model), atol=1e-3)
    read, whole = [], lm_score._gradient
    monkeypatch.setattr(lm_score, "_gradient", lambda docs, model: read.append(docs.columns) or whole(docs, model))
    lm_score.lm_score(docs)
    assert read == [["codes"]] * lm_score.STEPS


def test_lm_updates_read_all_texts(docs_of, small, monkeypatch):
    """Each update is over all training texts, and the contexts grow with the text."""
    read, whole = [], lm_score._gradient
    monkeypatch.setattr(lm_score, "_gradient", lambda docs, model: read.append(docs.count()) or whole(docs, model))
    lm_score.lm_score(docs_of(small))
    assert read == [sum(brute.crc(d, 7) != 2 for d, _ in small)] * lm_score.STEPS
    assert lm_score.sized(0) == lm_score.ROWS and [lm_score.sized(n)[0] for n in (10**8, 5 * 10**8, 3 * 10**10)] == [1 << 12, 1 << 13, 1 << 16]
    monkeypatch.setattr(lm_score, "sized", lambda n: tuple(2 * r for r in lm_score.ROWS))
    got = answer(lm_score.lm_score(docs_of(small)), "score")
    assert all(s <= 0 for (s,) in got.values()) and len(got) == len(small)


def test_empty_tables(spark, docs_of):
    docs = docs_of([])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    full = docs_of([(1, "some text here")])
    assert license_scan.license_scan(docs).count() == 0
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert near_dedup.near_dedup(docs).count() == 0
    assert packing.pack(packing.tokenize(docs).drop("ids")).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == 0
    assert decontaminate.decontaminate(full, bench).first()["leaks"] == []
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0
    assert pii.find_pii(docs, pii.fit(docs)).count() == 0
    assert language_id.language_id(docs, {}).count() == 0
    assert lm_score.lm_score(docs).count() == 0


@pytest.mark.parametrize("w", [1, 2, 7])
def test_minimizers(w):
    h = np.random.default_rng(w).integers(0, 50, 200).astype(np.uint64)
    want = np.zeros(200, bool)
    for i in range(200 - w + 1):
        want[i : i + w] |= h[i : i + w] == h[i : i + w].min()
    assert (substring_dedup.minimizers(h, w) == want).all()
