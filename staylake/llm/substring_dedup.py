"""Substring de-duplication by level-wise doubling of repeated windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored, texts
from .words import list_parts, lists, mix, slices, windows, word_hashes

MIN_WORDS = 13


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def _halves(texts: pa.Array, min_words: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side: the words of each, hashes of all words and of the windows of half the length, the smallest of those
    in each window of ``min_words`` words, and which of these windows lie in one text."""
    n, h = word_hashes(texts)
    half = (min_words + 1) // 2
    halves = windows(h, half)
    span = min_words - half + 1
    low = sliding_min(halves, span) if len(halves) >= span else halves[:0]
    ends = np.repeat(np.cumsum(n), n)[: len(low)]
    return n, h, halves, low, np.arange(min_words, min_words + len(low)) <= ends


def _anchors(halves: np.ndarray, low: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which windows of half the length are the smallest in some whole window. Equal windows mark the same places."""
    if not len(low):
        return np.zeros(len(halves), bool)
    w = len(halves) - len(low) + 1
    edge = np.zeros(w - 1, low.dtype)
    back = np.concatenate([edge, np.where(whole, low, np.uint64(0)), edge])
    return ~sliding_min(~back, w) == halves  # the largest of the minima over all windows that hold the place


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Which values are the minimum of some ``w`` consecutive ones."""
    low = sliding_min(h, w) if len(h) >= w else h[:0]
    return _anchors(h, low, np.ones(len(low), bool))


def _parted(flat: np.ndarray, of: np.ndarray, n: int, dtype) -> pa.ListArray:
    """Values as one list for each of ``n`` texts; ``of`` tells whose they are and ascends."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype, copy=False)))


def _first_pass(min_words: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n, _, halves, low, inside = _halves(batch["text"], min_words)
                marks = np.flatnonzero(_anchors(halves, low, inside))
                of = np.repeat(np.arange(len(n)), n)[marks]
                yield pa.record_batch([batch["doc_id"], _parted(halves[marks].view(np.int64), of, len(n), np.int64)], ["doc_id", "anchors"])

    return run


def _second_pass(min_words: int):
    half = (min_words + 1) // 2

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n, h, halves, low, inside = _halves(batch["text"], min_words)
                begins = np.cumsum(n) - n
                # a window survives unless its own anchor, the smallest hash in it, is of this document alone
                for a, b, sole in zip(begins.tolist(), (begins + n - min_words + 1).tolist(), list_parts(batch["sole"])):
                    if b > a and len(sole):
                        inside[a:b] = _others(low[a:b], sole.view(np.uint64))
                at = np.flatnonzero(inside)
                full = windows(halves, min_words, half)[at]
                other = windows(h[::-1], min_words)[::-1][at]  # an independent hash: the words in reverse
                of = np.repeat(np.arange(len(n)), n)[at]
                values = (at - begins[of], np.int32), (full.view(np.int64), np.int64), ((other >> np.uint64(33)).astype(np.int32), np.int32)
                yield pa.record_batch([batch["doc_id"], *(_parted(v, of, len(n), kind) for v, kind in values)], ["doc_id", "at", "h1", "h2"])

    return run


def _others(h: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which values are not among ``gone``."""
    return ~np.isin(h, gone) if len(gone) else np.ones(len(h), bool)


def _pairs(at: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From the places, which ascend, and hashes of windows of ``size`` words those of all windows of twice the length made of two of them."""
    to = np.searchsorted(at, at + size)
    both = to < len(at)
    both[both] = at[to[both]] == at[both] + size
    return at[both], mix(h[both].view(np.uint64), h[to[both]].view(np.uint64)).view(np.int64)


def _stretches(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of words begin and end that windows of ``size`` words at the places ``at`` cover."""
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) > size)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + size


def _covered(min_words: int):
    """The stretches that a text loses, and the windows of twice the length made of its repeated ones."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            repeats = []
            for at, h, sole, lead in zip(*map(list_parts, (batch["at"], batch["h1"], batch["sole"], batch["lead"]))):
                alive = _others(h, sole)
                at, h = at[alive], h[alive]
                repeats.append(len(at) > 0)
                for column, value in zip(out, (*_stretches(at[_others(h, lead)], min_words), *_pairs(at, h, min_words))):
                    column.append(value)
            columns = [lists(c, k) for c, k in zip(out, (np.int32, np.int32, np.int32, np.int64))]
            yield pa.record_batch([batch["doc_id"], pa.array(repeats, pa.bool_()), *columns], ["doc_id", "repeats", "begins", "ends", "at", "h"])

    return run


def _doubled(size: int):
    """Leaves out the windows of ``size`` words of one document alone and makes those of twice the length from the others."""

    def run(batches):
        for batch in batches:
            repeats, places, found = [], [], []
            for at, h, sole in zip(*map(list_parts, (batch["at"], batch["h"], batch["sole"]))):
                alive = _others(h, sole)
                repeats.append(bool(alive.any()))
                at, h = _pairs(at[alive], h[alive], size)
                places.append(at), found.append(h)
            yield pa.record_batch([batch["doc_id"], pa.array(repeats, pa.bool_()), lists(places, np.int32), lists(found, np.int64)], ["doc_id", "repeats", "at", "h"])

    return run


def _removal():
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n_words, n_removed, kept = [], [], []
                for text, begins, ends in zip(batch["text"].to_pylist(), list_parts(batch["begins"]), list_parts(batch["ends"])):
                    words = text.encode().split()
                    n_words.append(len(words))
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, np.minimum(begins, len(words)), 1)
                    np.add.at(gone, np.minimum(ends, len(words)), -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    n_removed.append(int(len(words) - stays.sum()))
                    kept.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s) if n_removed[-1] else b" ".join(words))
                yield pa.record_batch(
                    [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch["longest"]],
                    ["doc_id", "n_words", "n_removed", "kept_text", "longest_repeat"],
                )

    return run


def _owners(rows: DataFrame, *key: str) -> DataFrame:
    """Keys with the smallest doc_id that has them, as ``doc_id``, and whether it alone does (``only``)."""
    ends = rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return ends.select(F.col("first").alias("doc_id"), (F.col("first") == F.col("last")).alias("only"), *key)


def _sole(rows: DataFrame, key: str) -> DataFrame:
    """For each document the keys (``sole``) that no other document has."""
    return _owners(rows, key).filter("only").groupBy("doc_id").agg(F.collect_list(key).alias("sole"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Remove every word covered by a window of ``min_words`` words that also starts in a document with a smaller doc_id.

    Words are maximal runs of characters other than blank and \\t-\\r. Windows are judged on the input.
    Returns per row: doc_id, n_words, n_removed, kept_text (kept words joined by one blank), longest_repeat.

    Level by level: windows of half the length come first, of which only content-chosen anchors are compared (the
    smallest hash of each full window, so equal windows bring equal anchors and nothing is lost). Full windows around
    repeated anchors are hashed next (96 bits); those that repeat decide what is removed. Windows repeated at one
    length are then joined to windows of twice the length, wherever two of them follow each other, until none survive:
    longest_repeat is the longest such level with a copy in another document (0: none). Every place is looked at.

    Each level counts by an aggregate with map-side combine, which ends in one row per window however often it occurs. A
    window of one document alone, and the first document of any other, is known by that row, so these go back to their
    document as lists, by 64 bits of their hash; what is not listed repeats. Windows themselves never return by a join, and no group is gathered.

    Null texts have no words. Texts shorter than the window keep all words. Rows that repeat a doc_id count as one
    document, and each loses the words that any of them loses at the same places; rows with a null doc_id lose none.
    An empty table gives an empty result. Other columns are not looked at.
    """
    docs = texts(docs, id_col, text_col)
    known = docs.filter("doc_id is not null")
    anchors = stored(known.mapInArrow(_first_pass(min_words), "doc_id long, anchors array<long>"))
    sole = stored(_sole(anchors.select("doc_id", F.explode("anchors").alias("h")), "h"))
    discard(anchors)
    hashed = known.join(sole.hint("merge"), "doc_id", "left").mapInArrow(_second_pass(min_words), "doc_id long, at array<int>, h1 array<long>, h2 array<int>")
    hashed = stored(hashed.filter(F.size("at") > 0))
    discard(sole)
    full = hashed.select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("w")).select("doc_id", "w.*")
    h1 = lambda only: F.collect_list(F.when(F.col("only") == only, F.col("h1")))
    owned = stored(_owners(full, "h1", "h2").groupBy("doc_id").agg(h1(True).alias("sole"), h1(False).alias("lead")))
    schema = "doc_id long, repeats boolean, begins array<int>, ends array<int>, at array<int>, h array<long>"
    base = stored(hashed.drop("h2").join(owned.hint("merge"), "doc_id", "left").mapInArrow(_covered(min_words), schema).filter("repeats"))
    discard(hashed, owned)
    marks = stored(base.select("doc_id", "begins", "ends").filter(F.size("begins") > 0))

    alive, longest, level = base, [], min_words
    while not alive.isEmpty():
        longest.append(stored(alive.select("doc_id", F.lit(level).alias("longest"))))
        level *= 2
        pairs = alive.select("doc_id", "at", "h").filter(F.size("at") > 0)
        sole = stored(_sole(pairs.select("doc_id", F.explode("h").alias("h")), "h"))
        doubled = pairs.join(sole.hint("merge"), "doc_id", "left").mapInArrow(_doubled(level), "doc_id long, repeats boolean, at array<int>, h array<long>")
        after = stored(doubled.filter("repeats"))
        discard(alive, sole)
        alive = after
    marks = marks.groupBy("doc_id").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    if longest:
        most = reduce(DataFrame.unionByName, longest).groupBy("doc_id").agg(F.max("longest").cast("bigint").alias("longest"))
        marks = marks.join(most, "doc_id", "full")
    else:
        marks = marks.withColumn("longest", F.lit(0).cast("bigint"))
    none = F.array().cast("array<int>")
    return docs.join(stored(marks), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("begins", none).alias("begins"), F.coalesce("ends", none).alias("ends"), F.coalesce("longest", F.lit(0).cast("bigint")).alias("longest")
    ).mapInArrow(_removal(), "doc_id long, n_words long, n_removed long, kept_text string, longest_repeat long")
