"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import crc_mod
from .words import kept, slices

SAMPLE_CHARS = 40_000  # labelled text per language, at most this much
STRETCH = 4_000  # characters that a longer text gives, from a place drawn by a hash; shorter texts are taken whole
SEGMENT = 256  # characters after which parsing restarts, so that many stretches are parsed side by side
DENSE = 1 << 23  # cells of a full transition table, states by letters; automata over more letters are kept as sorted edges
UNKNOWN = "und"


def _first(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The first different texts by hash that hold ``SAMPLE_CHARS`` characters, or all; no part of the rows loses a row of the whole's."""
    found, chars = {}, 0
    for h, text in sorted(rows):
        if chars >= SAMPLE_CHARS:
            break
        if text not in found:
            found[text] = h
            chars += len(text)
    return [(h, text) for text, h in found.items()]


def _drawn(batches):
    kept: dict[str, list] = {}
    chars: Counter = Counter()
    for batch in batches:
        for lang, h, text in zip(*(batch[c].to_pylist() for c in ("lang", "h", "text"))):
            kept.setdefault(lang, []).append((h, text))
            chars[lang] += len(text)
            if chars[lang] > 4 * SAMPLE_CHARS:
                kept[lang] = _first(kept[lang])
                chars[lang] = sum(len(t) for _, t in kept[lang])
    for lang, rows in kept.items():
        rows = _first(rows)
        yield pa.record_batch([pa.array([lang] * len(rows)), pa.array([h for h, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["lang", "h", "text"])


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """``SAMPLE_CHARS`` characters of labelled texts per language, or all if there are fewer, drawn by a hash of the id.

    Every label with a text has a sample, whatever the length of its texts and the number of labels. Rows without text or
    label have no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    h = F.xxhash64("doc_id")
    start = (F.pmod(h, F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1) + 1).cast("int")
    known = rows.select(F.col("lang").cast("string").alias("lang"), h.alias("h"), F.col("text").substr(start, F.lit(STRETCH)).alias("text"))
    schema = "lang string, h long, text string"
    found: dict[str, list] = {}
    for r in known.mapInArrow(_drawn, schema).repartition("lang").mapInArrow(_drawn, schema).toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {lang: " ".join(t for _, t in _first(found[lang]))[:SAMPLE_CHARS] for lang in sorted(found)}


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Edges of each state of the suffix automaton of ``codes``: state 1 is the start, 0 is none."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


def transitions(codes: np.ndarray, letters: int) -> np.ndarray:
    """Transition table of the suffix automaton of ``codes``: state 1 is the start, 0 stands for no transition."""
    return _table(automaton(codes), letters)


def _table(nexts: list[dict[int, int]], letters: int) -> np.ndarray:
    table = np.zeros((len(nexts), letters), np.int32)
    for state, edges in enumerate(nexts):
        for c, to in edges.items():
            table[state, c] = to
    return table


class Steps:
    """Transitions of the automaton of one sample; its letters are numbered on their own, all that it lacks share a number."""

    def __init__(self, codes: np.ndarray, letters: int):
        own = np.unique(codes)
        self.own = np.full(letters, len(own), np.int32)
        self.own[own] = np.arange(len(own))
        self.letters = len(own) + 1
        nexts = automaton(self.own[codes])
        self.start = np.zeros(self.letters, np.int32)  # 0 for a letter that the sample lacks: it is a phrase of its own
        for c, to in nexts[1].items():
            self.start[c] = to
        self.table = self.keys = None
        if len(nexts) * self.letters <= DENSE:
            self.table = _table(nexts, self.letters).ravel()
        else:
            keys = np.array([s * self.letters + c for s, edges in enumerate(nexts) for c in edges], np.int64)
            order = np.argsort(keys)
            self.keys = keys[order]
            self.to = np.array([to for edges in nexts for to in edges.values()], np.int32)[order]

    def next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * self.letters + c)
        key = state.astype(np.int64) * self.letters + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


class Model:
    """Automata of all languages. Code 0 is any run of characters that are no letters; letters of no sample share the last code."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        seen = sorted({c for t in sample.values() for c in t.lower() if c.isalpha()})
        self.letters = len(seen) + 2
        kind = np.uint8 if self.letters <= 256 else np.int32
        self.code = np.fromiter((len(seen) + 1 if chr(i).isalpha() else 0 for i in range(0x110000)), kind, 0x110000)
        for i, c in enumerate(seen):
            self.code[ord(c)] = i + 1
        self.steps, self.bits = [], []
        for lang in self.langs:
            codes = self.codes(sample[lang])
            self.steps.append(Steps(codes, self.letters))
            self.bits.append(np.log2(len(codes) + self.letters))  # a place in the sample, or a letter that it lacks: short samples name few places

    def codes(self, text: str) -> np.ndarray:
        found = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        return found[np.concatenate([[True], (found[1:] > 0) | (found[:-1] > 0)])] if len(found) else found

    def entropies(self, coded: list[np.ndarray]) -> np.ndarray:
        """Bits per character of each text under each language: phrases of the cross-parsing times the bits that name one."""
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        pieces = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(coded)), pieces)
        grid = np.zeros((int(pieces.sum()), SEGMENT), self.code.dtype)
        row = 0
        for c, k in zip(coded, pieces):
            grid[row : row + k].ravel()[: len(c)] = c
            row += k
        first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        size = np.minimum(n[owner] - (np.arange(len(owner)) - first[owner]) * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        columns = np.ascontiguousarray(grid[order].T).astype(np.int32)
        active = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")
        out = np.zeros((len(coded), len(self.langs)))
        for k, (steps, bits) in enumerate(zip(self.steps, self.bits)):
            state = np.ones(len(order), np.int32)
            phrases = np.ones(len(order), np.int32)
            for t in range(SEGMENT):
                m = active[t]
                if not m:
                    break
                c = steps.own[columns[t, :m]]
                to = steps.next(state[:m], c)
                ended = to == 0
                if t:
                    phrases[:m] += ended
                state[:m] = np.where(ended, steps.start[c], to)
            total = np.bincount(owner[order], phrases, len(coded))
            out[:, k] = total * bits / np.maximum(n, 1)
        return out

    def predict(self, batch: list[str | None]) -> tuple[list[str], np.ndarray]:
        coded = [self.codes(t or "") for t in batch]
        spoken = np.fromiter((bool(c.any()) for c in coded), bool, len(coded))
        langs, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
        some = np.flatnonzero(spoken)
        if len(some) and self.langs:
            bits = self.entropies([coded[i] for i in some])
            best = bits.argmin(axis=1)
            ranked = np.sort(bits, axis=1)
            score[some] = 1.0 if len(self.langs) == 1 else np.clip(1 - ranked[:, 0] / ranked[:, 1], 0, 1)
            for i, b in zip(some, best):
                langs[i] = self.langs[b]
        return langs, score


def _model(sample: dict[str, str]) -> Model:
    """The worker's model of a sample; it outlives a task."""
    return kept(("languages", hash(tuple(sorted(sample.items())))), lambda: Model(sample))


def language_id(docs: DataFrame, sample: dict[str, str], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row of ``docs``.

    A text is parsed, from left to right, into the longest phrases that occur in a language's sample; the language that
    needs the fewest phrases, weighted by the bits that name a place in its sample, wins. The score is 1 - best / second
    best entropy, between 0 and 1; ties go to the first label in sorted order.

    ``und`` with score 0 is predicted for null texts, texts without a letter, and when nothing was learned. Repeated
    rows are each answered; an empty table gives an empty result. Columns named like the two new ones are replaced.
    """
    rest = docs.drop(pred_col, score_col)
    names = rest.columns
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{pred_col}` string, `{score_col}` double"

    def run(batches):
        model = _model(shared.value)
        for whole in batches:
            for batch in slices(whole, text_col):
                langs, score = model.predict(batch[text_col].to_pylist())
                yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], [*names, pred_col, score_col])

    return rest.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return crc_mod(F.col(id_col), 3) == 1


def learned(docs: DataFrame, id_col: str = "doc_id") -> dict[str, str]:
    """The sample of the rows that may be learned from: those that are not held out."""
    return labelled_sample(docs.filter(~held_out(id_col)), id_col)
