"""Hashed maximum-entropy language model with class-factored softmax, trained by distributed gradient updates."""

from __future__ import annotations

from collections import Counter
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, discard, stored, texts
from .words import hashes, lists, mix, slices

CLASSES = 64  # word classes, a power of two: a word's class is its hash modulo this
ROWS = (1 << 12, 1 << 12, 1 << 13)  # least hashed contexts of the features, powers of two: previous word, the word before it (skip), both
STEPS = 2  # gradient updates, each over all training text
RATE = 2.0  # step length, as a part of the curvature bound
PRIOR = 20.0  # tokens that a context's first estimate is smoothed by
CHUNK = 4096  # cells that travel in one row
FREQUENT = 100_000  # words with at least 1 / FREQUENT of all tokens are looked up in memory: there are at most so many
FLUSH_WORDS = 500_000  # words that a task counts before it hands them on
SCORED_BYTES = 2 << 20  # text whose words are held at once for scoring
TOKENS = 4_096  # tokens scored at once
SUMMED = 16 * TOKENS  # different contexts whose expected counts are summed at once
GATHERED = 1 << 18  # tokens whose equal contexts are brought together first
STEEP = 25.0  # no weight is larger, so that exponentials of three of them stay finite
END = b""  # no word is empty


def sized(n_bytes: int) -> tuple[int, ...]:
    """Contexts of the features for so much training text: distinct words grow about as the square root of it, and so do these."""
    k = 0
    while 16 * (ROWS[0] << k) ** 2 < n_bytes:
        k += 1
    return tuple(n << k for n in ROWS)


def tokens(text: str) -> list[bytes]:
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    found.append(END)
    return found


def features(h: np.ndarray, sizes: tuple[int, ...] = ROWS, starts: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class of each token, and the rows of its three context features, which have ``sizes`` rows. Texts begin at ``starts``: none is 0 alone."""
    before = np.concatenate([np.zeros(2, np.uint64), h])[:-1]
    one, two = before[1:], before[:-1]
    if starts is not None:
        one, two = one.copy(), two.copy()
        one[starts] = two[starts] = 0
        two[starts[starts + 1 < len(h)] + 1] = 0
    parts = ((one, 0), (two, sizes[0]), (mix(two, one), sizes[0] + sizes[1]))
    rows = [((x >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64) + at for (x, at), n in zip(parts, sizes)]
    return (h & np.uint64(CLASSES - 1)).astype(np.int64), rows


def coded(cut: list[list[bytes]], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of tokens of each text, and the ``features`` of all tokens one after another."""
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    h = hashes(list(chain.from_iterable(cut)))
    return size, *features(h, sizes, np.cumsum(size) - size)


def context_codes(rows: list[np.ndarray], sizes: tuple[int, ...]) -> np.ndarray:
    """The three context rows of each token as one number."""
    _, second, third = (n.bit_length() - 1 for n in sizes)
    return (((rows[0] << second) | (rows[1] - sizes[0])) << third) | (rows[2] - sizes[0] - sizes[1])


def _packed(codes: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first, so that the bytes that are all zero compress to nothing."""
    return codes.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(cells: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _matrix_rows(m: np.ndarray) -> pa.RecordBatch:
    flat = m.astype("<f4").ravel()
    used = [i for i in range(len(flat) // CHUNK) if flat[i * CHUNK : (i + 1) * CHUNK].any()]
    return pa.record_batch(
        [pa.array(used, pa.int32()), pa.array([flat[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in used], pa.binary())], ["chunk", "cells"]
    )


def _sum_chunks(rows: DataFrame, sizes: tuple[int, ...]) -> np.ndarray:
    """Sum matrices that tasks made, chunk by chunk, in a stream: a task holds one sum per chunk."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(batch["chunk"].to_pylist(), batch["cells"].to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(cells, "<f4").astype(np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "cells"])

    total = np.zeros(sum(sizes) * CLASSES)
    for r in rows.repartition("chunk").mapInArrow(run, "chunk int, cells binary").toLocalIterator():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["cells"], np.float64)
    return total.reshape(-1, CLASSES)


def count(docs: DataFrame, sizes: tuple[int, ...] = ROWS) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Word counts (word, cls, n) of all texts, how often each class follows each context row, and a written table in which
    each text has its tokens' ``context_codes`` (other rows have null codes)."""
    schema = {"word": pa.binary(), "cls": pa.int32(), "n": pa.int64(), "chunk": pa.int32(), "cells": pa.binary(), "codes": pa.binary()}

    def made(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([columns[c] if c in columns else pa.nulls(size, t) for c, t in schema.items()], list(schema))

    def word_rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        cls = (hashes(words) % np.uint64(CLASSES)).astype(np.int32)
        return made(len(words), word=pa.array(words, pa.binary()), cls=pa.array(cls), n=pa.array(list(counts.values()), pa.int64()))

    def run(batches):
        counts: Counter = Counter()
        seen = np.zeros(sum(sizes) * CLASSES, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SCORED_BYTES):
                cut = [tokens(t) for t in batch["text"].to_pylist()]
                counts.update(chain.from_iterable(cut))
                size, cls, rows = coded(cut, sizes)
                for r in rows:
                    np.add.at(seen, r * CLASSES + cls, 1)
                codes, ends = context_codes(rows, sizes), np.cumsum(size).tolist()
                yield made(len(cut), codes=pa.array([_packed(codes[a:b]) for a, b in zip([0, *ends], ends)], pa.binary()))
                if len(counts) > FLUSH_WORDS:
                    yield word_rows(counts)
                    counts = Counter()
        if counts:
            yield word_rows(counts)
        m = _matrix_rows(seen)
        yield made(m.num_rows, chunk=m["chunk"], cells=m["cells"])

    rows = stored(docs.select("text").mapInArrow(run, "word binary, cls int, n long, chunk int, cells binary, codes binary"))
    words = stored(rows.filter("word is not null").groupBy("word", "cls").agg(F.sum("n").alias("n")))
    return words, _sum_chunks(rows.filter("chunk is not null").select("chunk", "cells"), sizes), rows


class Weights:
    """Class scores: the log share of each class, kept in the rows of the first feature, plus a weight row per context feature."""

    def __init__(self, share: np.ndarray, weight: np.ndarray, sizes: tuple[int, ...] = ROWS, seen: np.ndarray | None = None):
        self.sizes = sizes
        self.seen = seen  # how often each class follows each context in the training texts, where that is known
        self.weight = np.clip(weight, -STEEP, STEEP).astype(np.float32)
        self.weight[: sizes[0]] += np.log(share).astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": None}  # tasks need no counts

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        """Unnormalised class probabilities of tokens."""
        z = self.weight.take(rows[0], axis=0)
        z += self.weight.take(rows[1], axis=0)
        z += self.weight.take(rows[2], axis=0)
        return np.exp(z, out=z)


def _gradient(docs: DataFrame, model: Weights) -> np.ndarray:
    """Seen minus expected classes after each context row, over all texts of ``docs``; those seen are counted unless the model has them.

    ``docs`` are texts, or only what ``count`` wrote of them (``codes``), which spares cutting and hashing them again. Tokens with the same three rows have the same expected classes, so each such group is worked out once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sizes = model.sizes
    known = docs.columns == ["codes"]
    seen = count(docs, sizes)[1] if model.seen is None else model.seen
    _, second, third = (n.bit_length() - 1 for n in sizes)
    firsts = np.cumsum([0, *sizes[:-1]])

    def run(batches):
        total = np.zeros((CLASSES, sum(sizes)))
        block = np.empty((CLASSES, SUMMED))

        def add(codes: list) -> None:
            alike, times = np.unique(np.concatenate(codes), return_counts=True)
            for a in range(0, len(alike), SUMMED):
                code, n = alike[a : a + SUMMED], times[a : a + SUMMED]
                m = len(code)
                rows = [(code >> (second + third)) + firsts[0], (code >> third & (sizes[1] - 1)) + firsts[1], (code & (sizes[2] - 1)) + firsts[2]]
                for b in range(0, m, TOKENS):
                    part = slice(b, b + TOKENS)
                    p = shared.value.odds([r[part] for r in rows])
                    p *= (-n[part] / p.sum(axis=1))[:, None]
                    block[:, b : b + len(p)] = p.T
                at = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))  # codes are sorted, and so is the first feature
                total[:, rows[0][at]] += np.add.reduceat(block[:, :m], at, axis=1)
                for r, first, size in zip(rows[1:], firsts[1:], sizes[1:]):
                    own, at, width = slice(first, first + size), r - first, size
                    if size > SUMMED:  # most contexts are not in this block
                        own, at = np.unique(r, return_inverse=True)
                        width = len(own)
                    for c in range(CLASSES):
                        total[c, own] += np.bincount(at, block[c, :m], width)

        kept, n = [], 0
        for whole in batches:
            for batch in slices(whole, "codes" if known else "text", SCORED_BYTES):
                if known:
                    kept += map(_unpacked, batch["codes"].to_pylist())
                    n = sum(map(len, kept))
                else:
                    kept.append(context_codes(coded([tokens(t) for t in batch["text"].to_pylist()], sizes)[2], sizes))
                    n += len(kept[-1])
                if n >= GATHERED:
                    add(kept)
                    kept, n = [], 0
        if kept:
            add(kept)
        for first in range(0, sum(sizes), ROWS[0]):
            part = _matrix_rows(total[:, first : first + ROWS[0]].T)
            at = pa.array(part["chunk"].to_numpy() + first * CLASSES // CHUNK, pa.int32())
            yield pa.record_batch([at, part["cells"]], ["chunk", "cells"])

    return seen + _sum_chunks(docs.select("codes" if known else "text").mapInArrow(run, "chunk int, cells binary"), sizes)


def train(docs: DataFrame, seen: np.ndarray, share: np.ndarray, steps: int = STEPS, sizes: tuple[int, ...] = ROWS) -> Weights:
    """Weights after ``steps`` updates along the gradient of the likelihood, each over all texts (``docs``: texts or their codes).

    They start from the smoothed log odds of each context over all texts, a third for each of the three features. A step
    is scaled for each context by the curvature bound of its tokens.
    """
    n = seen.sum(axis=1, keepdims=True)
    weight = np.log((seen + PRIOR * share) / (n + PRIOR) / share) / len(ROWS)
    for _ in range(steps if n.any() else 0):
        gradient = _gradient(docs, Weights(share, weight, sizes, seen))
        weight = weight + RATE * gradient / (0.5 * len(ROWS) * n + PRIOR)
    return Weights(share, weight, sizes)


def held_out(id_col: str = "doc_id"):
    return crc_mod(F.col(id_col), 7) == 2


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """Score every text with a model learned from the texts that are not held out.

    Tokens are the words, A-Z lower-cased, then one end. Returns per row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram log10 probability), score (log10 probability under the model).

    The model: P(token) = P(class of the word | contexts) * P(word | class). The class of a word is its hash modulo
    ``CLASSES``; the class is predicted from hashed features (previous word, skip one, both) by a softmax whose weights
    are fitted by gradient updates, each over all training texts: each task sums seen minus expected classes over its
    texts. The contexts grow with the square root of the training text (``sized``). Within a class words have add-one
    shares, with one place for unknown words. Word counts cover all training texts.

    Words with at least 1 / ``FREQUENT`` of all tokens, at most ``FREQUENT`` of them, are looked up in memory; all others
    meet the counts in a join, where no word is hot.

    Null texts count as empty: one end token. Repeated rows count and are scored one by one; a null doc_id counts as not held out.
    Without training texts all probabilities are uniform. An empty table gives an empty result. Other columns are not
    looked at.
    """
    docs = texts(docs, id_col, text_col).withColumn("held_out", held_out())
    training = docs.filter("not held_out")
    sizes = sized(training.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    words, seen, contexts = count(training, sizes)
    by_class = {r["cls"]: (r["n"], r["v"]) for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_class = np.array([by_class.get(k, (0, 0))[0] for k in range(CLASSES)], float)
    v_class = np.array([by_class.get(k, (0, 0))[1] for k in range(CLASSES)], float)
    total, distinct = int(n_class.sum()), int(v_class.sum())
    model = train(contexts.select("codes").filter("codes is not null"), seen, (n_class + 1) / (total + CLASSES), steps, sizes)
    discard(contexts)
    spark = docs.sparkSession
    common = words.filter(F.col("n") * FREQUENT >= total).select("word", "n")
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): float(np.log10(r["n"] + 1)) for r in common.toLocalIterator()})
    shared = spark.sparkContext.broadcast((model, np.log10(n_class + v_class + 1)))

    def run(batches):
        weights, class_log = shared.value
        look_up = frequent.value.get
        for whole in batches:
            for batch in slices(whole, "text", SCORED_BYTES):
                cut = [tokens(t) for t in batch["text"].to_pylist()]
                size, cls, rows = coded(cut, sizes)
                logp = np.empty(len(cls))
                for a in range(0, len(cls), TOKENS):
                    c = cls[a : a + TOKENS]
                    p = weights.odds([r[a : a + TOKENS] for r in rows])
                    logp[a : a + TOKENS] = np.log10(p[np.arange(len(c)), c]) - np.log10(p.sum(axis=1, dtype=np.float64)) - class_log[c]
                score = np.add.reduceat(logp, np.cumsum(size) - size)
                common_log, known, rare, times = [], [], [], []
                for ws in cut:
                    found = np.fromiter(map(look_up, ws, repeat(np.nan)), float, len(ws))
                    miss = np.isnan(found)
                    known.append(int(len(ws) - miss.sum()))
                    common_log.append(float(found[~miss].sum()))
                    others = Counter(compress(ws, miss.tolist()))
                    rare.append(list(others))
                    times.append(np.fromiter(others.values(), np.int32, len(others)))
                yield pa.record_batch(
                    [batch["row"], batch["doc_id"], batch["held_out"], pa.array(size), pa.array(known, pa.int64()), pa.array(common_log, pa.float64()),
                     pa.array(score), pa.array(rare, pa.list_(pa.binary())), lists(times, np.int32)],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "common", "score", "rare", "times"],
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, common double, score double, rare array<binary>, times array<int>"
    scored = stored(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema))
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = pairs.join(words.filter(F.col("n") * FREQUENT < total), "word").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log")
    )
    logs = F.col("common") + F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
