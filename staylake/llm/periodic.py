"""Periodic runs of words, found on a grammar: Re-Pair, runs across each rule's boundary, translation to all its places."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .words import slices

LEAST_WORDS = 6
LEAST_POWER = 4  # a run holds its period this many times at least
SLICE = 4 << 20  # bytes of text worked on at once; a longer text is a slice of its own

Source = Callable[[int | None, int], "np.ndarray | None"]


def _name(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of ordered pairs of small numbers, and how often each name occurs."""
    _, name, count = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True, return_counts=True)
    return name, count


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class Grammar:
    """Re-Pair over many texts at once: rules X -> AB, every place where each rule derives words, and a binary tree on top.

    ``words`` are numbers, ``text`` says which text each belongs to (ascending); equal words of different texts must have different
    numbers, so texts share no rule. Re-Pair replaces the most frequent pair again and again until no pair occurs twice.
    A pair that outranks (by count, ties by a hash) every pair it overlaps anywhere can be replaced at once: what comes before it
    in Re-Pair's order does not touch it. All such pairs of all texts are replaced in one round. What is left of each text
    has no repeated pair; it gets a balanced tree of rules that are used once.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.size = len(words)
        self.rule: list[np.ndarray] = []  # per round: rule number of each replaced place,
        self.at: list[np.ndarray] = []  # its first word,
        self.split: list[np.ndarray] = []  # the first word of its right part,
        self.end: list[np.ndarray] = []  # and the word after its last
        self.rules = 0
        sym, text = words.astype(np.int64), text
        fresh = int(sym.max()) + 1 if len(sym) else 0
        at = np.arange(len(sym), dtype=np.int64)
        end = at + 1
        while len(sym) > 1:
            chosen, name, kinds = self._ready(sym, text)
            if not kinds:
                break
            sym, at, end, text = self._replace(sym, at, end, text, chosen, name, kinds, fresh)
            fresh += kinds
        while len(sym) > 1:  # the tree: neighbours two by two, counted from each text's first symbol
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            nth = np.arange(len(sym)) - np.repeat(first, np.diff(np.append(first, len(sym))))
            pairs = np.flatnonzero((nth[:-1] % 2 == 0) & (text[1:] == text[:-1]))
            if not len(pairs):
                break
            sym, at, end, text = self._replace(sym, at, end, text, pairs, np.arange(len(pairs)), len(pairs), fresh)
            fresh += len(pairs)

    @staticmethod
    def _ready(sym: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the pairs to replace now, the name of each place's pair, and the number of names."""
        pair = np.flatnonzero(text[1:] == text[:-1])
        a, b = sym[pair], sym[pair + 1]
        # of 'aaa' only every other pair counts: places from the start of the stretch of equal symbols
        same = a == b
        index = np.arange(len(pair))
        joined = np.zeros(len(pair), bool)
        joined[1:] = same[1:] & same[:-1] & (pair[1:] == pair[:-1] + 1)
        start = np.maximum.accumulate(np.where(joined, 0, index))
        counted = (index - start) % 2 == 0
        key = a << 32 | b
        kinds, name = np.unique(key, return_inverse=True)
        count = np.bincount(name[counted], minlength=len(kinds))
        order = np.lexsort((_scramble(kinds.view(np.uint64)), count))
        rank = np.empty(len(kinds), np.int64)
        rank[order] = np.arange(1, len(kinds) + 1)
        rank[count < 2] = 0
        own = rank[name]
        beaten = own == 0
        beside = pair[1:] == pair[:-1] + 1
        beaten[1:] |= beside & (own[:-1] > own[1:])
        beaten[:-1] |= beside & (own[1:] > own[:-1])
        ready = np.ones(len(kinds), bool)
        ready[name[beaten]] = False
        use = counted & ready[name]
        dense = np.cumsum(ready) - 1
        return pair[use], dense[name[use]], int(ready.sum())

    def _replace(self, sym, at, end, text, places, name, kinds, fresh):
        self.rule.append(name + self.rules)
        self.at.append(at[places])
        self.split.append(at[places + 1])
        self.end.append(end[places + 1])
        self.rules += kinds
        sym, end = sym.copy(), end.copy()
        sym[places], end[places] = fresh + name, end[places + 1]
        stays = np.ones(len(sym), bool)
        stays[places + 1] = False
        return sym[stays], at[stays], end[stays], text[stays]


class Matches:
    """How far two places of the words agree, forwards and backwards, by names of stretches of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.size = len(words)
        self.names = [np.unique(words, return_inverse=True)[1]]
        while 2 << (len(self.names) - 1) <= longest and (half := 1 << (len(self.names) - 1)) * 2 <= self.size:
            last = self.names[-1]
            self.names.append(_name(last[: len(last) - half], last[half:])[0])

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and from ``j`` on (i < j), ``most`` at most."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            while True:
                ok = n + step <= most
                p, q = np.where(ok, i + n, 0), np.where(ok, j + n, 0)
                ok &= name[p] == name[q]
                if not ok.any():
                    break
                n[ok] += step
        return n

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words that end before ``i`` and before ``j``, ``most`` at most."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            while True:
                ok = n + step <= most
                p, q = np.where(ok, i - n - step, 0), np.where(ok, j - n - step, 0)
                ok &= name[p] == name[q]
                if not ok.any():
                    break
                n[ok] += step
        return n


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number, ``n`` times, with first, first + 1, ..."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _crossing(words: np.ndarray, begin: np.ndarray, split: np.ndarray, end: np.ndarray, power: int, least: int) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of runs that lie in [begin, end) of a rule and have words on both sides of ``split``.

    A run of four periods or more has two of them on one side. If that is the right side, the word at the split returns a period later;
    if the left, the word before the split was there a period earlier. Those returns are the candidates, checked by matches.
    """
    size = len(words)
    longest = int((end - begin).max()) if len(begin) else 0
    matches = Matches(words, longest)
    # places of each word in order; a place's neighbours in that list are its returns
    order = np.argsort(words, kind="stable")
    where = np.empty(size, np.int64)
    where[order] = np.arange(size)
    key = words[order].astype(np.int64) * (size + 1) + order
    need = power // 2
    found = []
    for chunk in np.array_split(np.arange(len(begin)), max(1, int((end - begin).sum() // 4_000_000))):
        s, b, e = begin[chunk], split[chunk], end[chunk]
        # right: b + q with need * q words from b on
        reach = (e - b) // need
        stop = np.searchsorted(key, words[b].astype(np.int64) * (size + 1) + b + reach, side="right")
        row, k = _spread(where[b] + 1, np.maximum(stop - where[b] - 1, 0))
        q = order[k] - b[row]
        ahead = matches.forward(b[row], b[row] + q, e[row] - b[row] - q)
        ok = ahead >= (need - 1) * q
        row, q, ahead = row[ok], q[ok], ahead[ok]
        behind = matches.backward(b[row], b[row] + q, b[row] - s[row])
        found.append((chunk[row], b[row] - behind, b[row] + q + ahead, q, behind > 0))
        # left: b - 1 - q with need * q words before b
        last, reach = b - 1, (b - s) // need
        start = np.searchsorted(key, words[last].astype(np.int64) * (size + 1) + last - reach, side="left")
        row, k = _spread(start, np.maximum(where[last] - start, 0))
        q = last[row] - order[k]
        behind = matches.backward(b[row] - q, b[row], b[row] - q - s[row])
        ok = behind >= (need - 1) * q
        row, q, behind = row[ok], q[ok], behind[ok]
        ahead = matches.forward(b[row] - q, b[row], e[row] - b[row])
        found.append((chunk[row], b[row] - q - behind, b[row] + ahead, q, ahead > 0))
    rule, start, stop, period, crosses = (np.concatenate(c) for c in zip(*found))
    good = crosses & (stop - start >= np.maximum(least, power * period))
    return rule[good], start[good], stop[good], period[good]


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> tuple[np.ndarray, ...]:
    """(start, end, period) of every run in texts laid end to end; ``words`` differ between texts, ``text`` is ascending.

    A run is found whole at the one place of the grammar's derivation whose two parts both hold words of it. Other places of the same
    rule may show a part of a longer run; such parts lie inside the run of the same period and are merged into it. Where
    several periods fit a stretch the smallest is its period.

    A pair inside a run occurs three times in its text (its length is four periods or more), so texts fall apart at rarer pairs
    and only stretches of ``least`` words or more between them get rules. That loses nothing.
    """
    none = np.zeros(0, np.int64)
    if len(words) < least:
        return none, none, none
    name, count = _name(words[:-1], words[1:])
    inner = (text[1:] == text[:-1]) & (count[name] >= power - 1)
    edge = np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # words of the stretch: [first, last)
    long = last - first >= least
    first, last = first[long], last[long]
    if not len(first):
        return none, none, none
    stretch, at = _spread(first, last - first)
    # names differ between stretches of a text as they do between texts: a rule's places are compared within a stretch only
    part, _ = _name(text[at], words[at])
    grammar = Grammar(part, stretch)
    rule, place, split, end = (np.concatenate(c) if c else none for c in (grammar.rule, grammar.at, grammar.split, grammar.end))
    sample = np.full(grammar.rules, -1, np.int64)
    sample[rule[::-1]] = np.arange(len(rule))[::-1]  # the first place of each rule
    wide = sample[end[sample] - place[sample] >= least]
    of, start, stop, period = _crossing(part, place[wide], split[wide], end[wide], power, least)
    if not len(of):
        return none, none, none
    # to all places of each rule
    start, stop, of = start - place[wide][of], stop - place[wide][of], rule[wide][of]
    by_rule = np.argsort(rule, kind="stable")
    begins = np.searchsorted(rule[by_rule], np.arange(grammar.rules + 1))
    row, k = _spread(begins[of], begins[of + 1] - begins[of])
    base = place[by_rule[k]]
    start, stop, period = start[row] + base, stop[row] + base, period[row]
    # the smallest period of a stretch, then only stretches that no other of the same period holds
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    far = np.maximum.accumulate(stop + period * (len(part) + 1))
    whole = np.concatenate([[True], stop[1:] + period[1:] * (len(part) + 1) > far[:-1]])
    start, stop, period = start[whole], stop[whole], period[whole]
    # back to places in the texts
    start, length = at[start], stop - start
    order = np.lexsort((period, start))
    return start[order], start[order] + length[order], period[order]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten (by crc32 of its id): which original word stands at each place once its tail repeats itself."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def _detect(source: Source | None, least: int, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids = batch["doc_id"].to_pylist()
                cut = []
                for doc_id, text in zip(ids, batch["text"].to_pylist()):
                    words = text.encode().split()
                    moved = source(doc_id, len(words)) if source else None
                    cut.append(words if moved is None else [words[i] for i in moved.tolist()])
                sizes = np.fromiter(map(len, cut), np.int64, len(cut))
                starts = np.cumsum(sizes) - sizes
                named = pa.array(chain.from_iterable(cut), pa.binary(), size=int(sizes.sum())).dictionary_encode().indices.to_numpy()
                text_of = np.repeat(np.arange(len(cut)), sizes)
                start, stop, period = runs(_name(text_of, named)[0], text_of, least, power)
                bounds = np.searchsorted(start, np.append(starts, sizes.sum())) if len(start) else np.zeros(len(cut) + 1, np.int64)
                found, kept = [], []
                for d, words in enumerate(cut):
                    lo, hi = bounds[d], bounds[d + 1]
                    if lo == hi:
                        found.append([])
                        kept.append(b" ".join(words))
                        continue
                    s, e, q = start[lo:hi] - starts[d], stop[lo:hi] - starts[d], period[lo:hi]
                    found.append([{"start": a, "length": b - a, "period": c} for a, b, c in zip(s.tolist(), e.tolist(), q.tolist())])
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, s + q, 1)
                    np.add.at(gone, e, -1)
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]))
                yield pa.record_batch([
                    batch["doc_id"], pa.array(sizes), pa.array(found, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, source: Source | None = None, least: int = LEAST_WORDS, power: int = LEAST_POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words in every whole text: maximal stretches of smallest period q and at least max(``least``, ``power`` * q) words.

    Returns doc_id, n_words, runs (array of start, length, period, ordered by start, then period) and collapsed: the words that are in
    no run beyond its first period, joined by one blank; one row per input row. ``source(doc_id, n)`` may name for each place the original
    word to stand there. ``power`` is 4 or more.

    Words are maximal runs of characters other than blank and \\t-\\r, numbered exactly (no hashes). Each text has its own grammar; texts
    are worked on side by side in slices of a few megabytes inside the task that reads them, so nothing is shuffled and a lost task is
    simply run again. A text longer than a slice is worked on alone.

    Null, empty and blank texts have no words and no runs. Rows that repeat an id are worked on one by one; a null id is kept. An empty table
    gives an empty result. Other columns are left behind, whatever their names.
    """
    if power < 4:
        raise ValueError("runs shorter than four periods need another filter")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return texts(docs, id_col, text_col).mapInArrow(_detect(source, least, power), schema)


def strongest(found: list[dict]) -> dict | None:
    """The run of greatest length / period; ties go to the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [r or [] for r in batch["runs"].to_pylist()]
        best = [strongest(r) or {} for r in found]
        listed = ["".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r) for r in found]
        milli = [1000 * b["length"] // b["period"] if b else None for b in best]
        yield pa.record_batch([
            batch["doc_id"], pa.array(map(len, found), pa.int64()), *[pa.array([b.get(n) for b in best], pa.int64()) for n in ("start", "length", "period")],
            pa.array(milli, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
            pa.array([hashlib.sha256((x or "").encode()).hexdigest() for x in batch["collapsed"].to_pylist()]), batch["n_words"],
        ], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"])


def digests(found: DataFrame) -> DataFrame:
    """What ``find_runs`` returns as one line of digests per document, with its strongest run."""
    names = "start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"
    return found.mapInArrow(_digests, f"doc_id long, n_runs long, {names}")
