"""Benchmark decontamination: q-gram filtering in diagonal bands, verified by banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import kept, slices

Q = 8  # characters per q-gram
RATE = 0.1  # edits allowed per character of an item
BLOCK_CHARS = 4_000_000  # benchmark text that travels to every worker at once; a larger benchmark goes in blocks
BITS = 22  # of the table that tells q-grams which no item has
FIELDS = "array<struct<item_id:bigint,distance:int>>"

_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> np.ndarray:
    """Characters of the lower-cased text, runs of white space as one blank."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    h, have = chars.astype(np.uint64) * _MUL, 1
    with np.errstate(over="ignore"):
        while have < q:
            step = min(have, q - have)
            h = (h[:-step] if len(h) > step else h[:0]) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * have) + h[step:]
            h ^= h >> np.uint64(32)
            have += step
    return h


def budget(length: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item: its share, as far as the q-gram lemma still asks for one shared q-gram; -1: too short."""
    return -1 if length < q else min(int(length * rate), (length - q) // q)


def distance(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> int:
    """Fewest edits between the item and any stretch of the region, along diagonals low..high (region place - item place).

    More than ``most`` edits are not told apart: the alignment ends when no path has fewer.
    """
    far = len(item) + 1
    d = np.arange(low, high + 1)
    steps = np.arange(len(d))
    row = np.where((d >= 0) & (d <= len(region)), 0, far)
    padded = np.concatenate([region, [0]]).astype(np.int64)
    for i, c in enumerate(item.astype(np.int64)):
        j = d + i  # region characters used before this row, by diagonal
        inside = (j >= 0) & (j < len(region))
        same = inside & (padded[np.clip(j, 0, len(region))] == c)
        fresh = np.where(inside, row + ~same, far)  # along the diagonal
        fresh[:-1] = np.minimum(fresh[:-1], row[1:] + 1)  # the item's character is left out
        fresh[(j + 1 < 0) | (j + 1 > len(region))] = far
        row = np.minimum(np.minimum.accumulate(fresh - steps) + steps, far)  # region characters are left out
        row[(j + 1 < 0) | (j + 1 > len(region))] = far
        if row.min() > most:
            break
    return int(row.min())


class Index:
    """q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        kept = [(i, c, budget(len(c), q, rate)) for i, c in ((i, normal(t)) for i, t in items)]
        kept = [x for x in kept if x[2] >= 0]
        self.ids = [x[0] for x in kept]
        self.chars = [x[1] for x in kept]
        self.edits = np.array([x[2] for x in kept], np.int64)
        self.least = np.array([len(c) - q + 1 - q * e for _, c, e in kept], np.int64)
        hashes = [grams(c, q) for c in self.chars]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.keys * _MUL) >> np.uint64(64 - BITS)] = True
        self.few = int(self.least.min()) if len(kept) else 0

    def leaks(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of every item that the text holds within its budget."""
        if not self.ids:
            return []
        chars = normal(text)
        h = grams(chars, self.q) if len(chars) >= self.q else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.maybe[(h * _MUL) >> np.uint64(64 - BITS)])
        if len(at) < self.few:
            return []
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[k] == h[at]
        at, k = at[real], k[real]
        n = self.times[k]
        total = int(n.sum())
        if total < self.few:
            return []
        posting = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        item = self.owner[posting]
        diagonal = np.repeat(at, n) - self.place[posting]
        width = self.edits[item] + 1
        band = diagonal // width
        shift = int(-(band.min() - 1)) if total else 0
        wide = int(band.max()) + shift + 2
        code = np.concatenate([item * wide + band + shift, item * wide + band - 1 + shift])  # bands overlap by half
        found, shared = np.unique(code, return_counts=True)
        found = found[shared >= self.least[found // wide]]
        if len(found):  # a repeated q-gram of the text counts once for each place in the item
            own = np.isin(code, found)
            place = np.concatenate([self.place[posting]] * 2)[own]
            found, shared = np.unique(np.unique(np.stack([code[own], place]), axis=1)[0], return_counts=True)
            found = found[shared >= self.least[found // wide]]
        best: dict[int, int] = {}
        for c in found.tolist():
            i, b = divmod(c, wide)
            if best.get(i) == 0:
                continue
            e, chars_i = int(self.edits[i]), self.chars[i]
            low = (b - shift) * (e + 1)
            start = max(low - e, 0)
            region = chars[start : low + 2 * (e + 1) + len(chars_i) + e]
            d = distance(chars_i, region, low - e - start, low + 2 * (e + 1) + e - start, e)
            if d <= e and d < best.get(i, e + 1):
                best[i] = d
        merged: dict[int, int] = {}
        for i, d in best.items():
            merged[self.ids[i]] = min(d, merged.get(self.ids[i], d))
        return sorted(merged.items())


def _index(items: list, q: int, rate: float) -> Index:
    """The worker's index of a block; it outlives a task."""
    return kept(("items", hash(tuple(items)), q, rate), lambda: Index(items, q, rate))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, leaks_col: str = "leaks",
) -> DataFrame:
    """Add ``leaks_col``: the benchmark items that a text holds with at most ``rate`` edits per character, each with its distance.

    Texts and items are lower-cased and runs of white space count as one blank. A stretch of text within e edits of an
    item of m characters shares m - q + 1 - q * e of its q-grams with it, on at most e + 1 neighbouring diagonals. Shared
    q-grams are counted in bands of 2 (e + 1) diagonals that overlap by half, so one band has them all; bands with enough
    are verified by an alignment along their diagonals. The budget of short items is cut so that at least one shared
    q-gram is asked for; items of fewer than q characters are never found.

    The benchmark goes to the workers in blocks of at most ``block_chars`` characters (or one item), whatever its size;
    every block meets all texts in place, without a shuffle of documents.

    Null and empty texts have no leaks, null items are left out, repeated items count once. Repeated rows are each
    answered; an empty benchmark leaves all leaks empty; an empty table gives an empty result. All columns are kept; one
    named like the new one is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = chars // max(block_chars // 2, 1) + 1
    rest = docs.drop(leaks_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    names = rest.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    out = rest.withColumn(leaks_col, F.array().cast(FIELDS))

    def search(shared):
        def run(batches):
            index = _index(shared.value, q, rate)
            for whole in batches:
                for batch in slices(whole, text_col):
                    found = []
                    for text, before in zip(batch[text_col].to_pylist(), batch[leaks_col].to_pylist()):
                        here = [{"item_id": i, "distance": d} for i, d in index.leaks(text or "")]
                        found.append([*(before or []), *here])
                    yield pa.record_batch([*[batch[c] for c in names], pa.array(found, kind)], [*names, leaks_col])

        return run

    for k in range(blocks):
        part = sorted((r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect())
        if part:
            out = out.mapInArrow(search(spark.sparkContext.broadcast(part)), f"{fields}, `{leaks_col}` {FIELDS}")
    return out
