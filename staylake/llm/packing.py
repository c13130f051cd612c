"""Best-fit packing of tokenized documents into sequences by bin completion."""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, texts
from .words import kept, slices

MAX_TOKENS = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
KNOWN_WORDS = 500_000  # units whose ids a worker remembers; beyond that it starts anew
CUT_BYTES = 4 << 20  # text cut into units at once
MARKS = ".,;:!?*$%&#|"  # marks that never join a letter before them, nor a contraction
RANK_ROWS = 20_000  # mean number of rows that one ranking task group holds
SEARCH_NODES = 200  # nodes of the search for one greedy filling; its best filling so far is kept
PLAN_NODES = 20_000  # nodes of the search for a whole plan, those of its fillings included; the best plan so far is kept

LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
BLANKS = b" \n"
BLANK, LETTER, DIGIT, MARK, ODD = range(5)  # kinds of bytes


def _kind(b: int) -> int:
    c = bytes([b])
    return BLANK if c in BLANKS else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK if 0x20 < b < 0x7F and c != b"'" else ODD


KIND = bytes(map(_kind, range(256)))
# Byte-level vocabularies write a byte as the character of that number if it can be seen, else as one from 256 on, in order.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SEEN)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds(dict):
    """Ids of the tokenizer's units (runs of letters, single digits, runs of marks) as little-endian uint32 bytes.

    The tokenizer merges inside a unit only. Units are cut on whole columns of text and each different one is looked up once.
    A blank-separated word with anything but ASCII and the letters from À to ÿ, or with an apostrophe, is a unit as it stands; the
    tokenizer cuts it. A text that holds one of the tokenizer's added tokens (such as an end-of-text mark) goes to the tokenizer
    whole: an added token has its own id wherever it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        if any(t.normalized for t in added):
            raise ValueError("added tokens that are looked for in folded text cannot be told from a text as it stands")
        self.merge = self.tokenizer.model.tokenize

    def learn(self, units: list[bytes]) -> None:
        """An odd word that ends in a letter and then marks is cut before the marks, as the tokenizer does."""
        merge, other, joined = self.merge, set(), []
        for u in units:
            if u.isalpha():  # ASCII letters
                self[u] = array("I", [t.id for t in merge(u.decode())]).tobytes()
            elif LATIN.fullmatch(u):
                self[u] = array("I", [t.id for t in merge(u.decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            elif u[0] in BLANKS:
                self[u] = b""
            else:
                w = u.decode()
                stem = w.rstrip(MARKS)
                if stem != w and stem.lower()[-1:].isalpha():  # İ ends in a mark once it is lower-cased
                    parts = stem.encode(), w[len(stem) :].encode()
                    joined.append((u, *parts))
                    other.update(p for p in parts if p not in self)
                else:
                    other.add(u)
        other = list(other)
        for u, e in zip(other, self.tokenizer.encode_batch_fast([u.decode() for u in other], add_special_tokens=False)):
            self[u] = array("I", e.ids).tobytes()
        for u, stem, tail in joined:
            self[u] = self[stem] + self[tail]

    def find(self, units: list[bytes]) -> list[bytes]:
        found = list(map(self.get, units))
        new = [u for u, f in zip(units, found) if f is None]
        if new:
            if len(self) + len(new) > KNOWN_WORDS:
                self.clear()
                new = units
            self.learn(new)
            found = list(map(self.__getitem__, units))
        return found

    def encode(self, batch: list[str] | pa.Array) -> list[bytes]:
        batch = pa.array(batch, pa.string())
        at, units, places = cut_units(batch)
        if not len(places):
            return [b""] * len(batch)
        found = self.find(units)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        own = size[places]
        end = np.cumsum(own)
        shift = (np.cumsum(size) - size)[places] - (end - own)
        ids = flat[np.repeat(shift, own) + np.arange(end[-1])]
        bounds = np.concatenate([[0], end])[at]
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for token in self.added:
            for i in np.flatnonzero(pc.match_substring(batch, token).to_numpy(zero_copy_only=False)).tolist():
                out[i] = array("I", self.tokenizer.encode(batch[i].as_py(), add_special_tokens=False).ids).tobytes()
        return out


def cut_units(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The units of texts, A-Z and À-Þ lower-cased: where each text's units begin, the different units, and which one stands at each place."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    if not len(data):
        return np.zeros(len(texts) + 1, np.int64), [], np.zeros(0, np.int64)
    raw = bytearray(data)
    kind, low = (np.frombuffer(x, np.uint8) for x in (raw.translate(KIND), raw.lower()))
    after = np.flatnonzero(data == 0xC3) + 1  # in UTF-8 the byte after it is there, and with it a character from À to ÿ
    if len(after):
        second = data[after]
        after, second = after[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]  # × and ÷ are no letters
        low[after] += (second < 0x9F).astype(np.uint8) * np.uint8(0x20)
        kind[after] = kind[after - 1] = LETTER
    odd = np.flatnonzero(kind == ODD)
    if len(odd):  # the whole word is odd, and stays as it is
        blank = np.flatnonzero(kind == BLANK)
        cuts = np.unique(np.concatenate([blank, blank + 1, starts]))
        word = np.unique(np.searchsorted(cuts, odd, side="right"))
        inside = np.zeros(len(data) + 1, np.int8)
        inside[cuts[word - 1]] += 1
        inside[cuts[word]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        kind[inside] = ODD
        low[inside] = data[inside]
    first = np.empty(len(data) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first[0] = first[-1] = True
    first[starts] = True
    cut = np.flatnonzero(first)
    units = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(low)]).dictionary_encode()
    return np.searchsorted(cut, starts), units.dictionary.to_pylist(), units.indices.to_numpy()


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer; it outlives a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokenizer", path), lambda: WordIds(path))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Token ids of every text, ``END_ID`` at the end, cut into pieces of at most ``max_tokens``.

    Returns doc_id, piece, start, length, ids (little-endian uint32 bytes). Only longer documents are cut. A null or
    empty text is one piece with the end id alone; repeated rows give repeated pieces.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        known = word_ids(path)
        end, width = np.asarray([END_ID], "<u4").tobytes(), 4 * max_tokens
        for whole in batches:
            for batch in slices(whole, "text", CUT_BYTES):
                out: tuple = ([], [], [], [], [])
                for doc, ids in zip(batch["doc_id"].to_pylist(), known.encode(batch["text"])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, part)):
                            column.append(value)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(left: np.ndarray, room: int) -> list[int]:
    """The filling that always takes the largest piece that still fits."""
    found: list[int] = []
    top = room
    while top > 0:
        fits = np.flatnonzero(left[1 : top + 1])
        if not len(fits):
            break
        s = int(fits[-1]) + 1
        k = min(room // s, int(left[s]))
        found += [s] * k
        room -= k * s
        top = min(room, s - 1)
    return found


def completion(left: np.ndarray, room: int) -> list[int]:
    """Sizes, largest first, that best fill ``room`` from the multiset ``left`` (left[s] pieces of size s).

    Depth-first over fillings, larger pieces first, so that small ones stay for later. One piece that fills the room
    dominates every other filling; two that fill it end the search. A filling that is no larger than the largest single
    piece is dominated by that piece. A branch is left when what it can still add cannot lower the waste of the incumbent,
    which starts as the best-fit filling.
    """
    if room <= 0:
        return []
    left = left[: room + 1].copy()
    best = best_fit(left, room)
    waste, nodes = room - sum(best), SEARCH_NODES
    if not waste and len(best) <= 2:
        return best
    perfect = False

    def pair(rest: int, top: int) -> list[int] | None:
        high = min(top, rest - 1)
        low = (rest + 1) // 2
        if high < low:
            return None
        a = np.arange(high, low - 1, -1)
        ok = np.flatnonzero((left[a] > 0) & (left[rest - a] > (a == rest - a)))
        return [int(a[ok[0]]), int(rest - a[ok[0]])] if len(ok) else None

    def search(chosen: list[int], rest: int, top: int) -> None:
        nonlocal best, waste, nodes, perfect
        if nodes <= 0:
            return
        nodes -= 1
        if rest <= top and left[rest] > 0:
            best, waste, perfect = [*chosen, rest], 0, True
            return
        if two := pair(rest, top):
            best, waste, perfect = chosen + two, 0, True
            return
        sizes = np.flatnonzero(left[1 : min(top, rest) + 1])[::-1] + 1
        if not len(sizes):
            if rest < waste:
                best, waste = list(chosen), rest
            return
        if rest - int((left[sizes] * sizes).sum()) >= waste:
            return
        for s in map(int, sizes):
            left[s] -= 1
            search([*chosen, s], rest - s, s)
            left[s] += 1
            if perfect:
                return

    search([], room, room)
    return best


def plan(counts: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[list[int], int]]:
    """Fillings of one sequence and how many sequences are filled alike, for pieces counted by length.

    Best-fit decreasing gives the incumbent; where it may need more sequences than necessary, greedy completion and then
    bin completion by branch and bound replace it if they need fewer.
    """
    incumbent = _fill(counts, capacity, best_fit)
    if sum(t for _, t in incumbent) * capacity - sum(s * n for s, n in counts.items()) < capacity:
        return incumbent  # no plan has fewer sequences
    best = min(incumbent, _fill(counts, capacity, completion), key=lambda p: sum(t for _, t in p))
    nodes = iter(range(PLAN_NODES))
    while (slack := (sum(t for _, t in best) - 1) * capacity - sum(s * n for s, n in counts.items())) >= 0:
        found = _within(counts, capacity, slack, nodes)
        if found is None:
            break
        best = found
    return best


def _fillings(left: np.ndarray, room: int, slack: int, nodes):
    """Fillings of ``room`` from ``left``, larger pieces first, that waste at most ``slack`` and are not dominated.

    A filling is dominated if another piece fits beside it, or fits in place of a smaller one or of two that are together
    no larger than it. ``left`` is used up and given back meanwhile.
    """
    chosen: list[int] = []

    def dominated(rest: int) -> bool:
        if left[1 : rest + 1].any():
            return True
        pieces = sorted(set(chosen))
        pairs = {x + y for i, x in enumerate(pieces) for y in pieces[i + (chosen.count(x) < 2) :]}
        return any(left[x + 1 : x + rest + 1].any() for x in pieces) or any(left[x : x + rest + 1].any() for x in pairs)

    def go(rest: int, top: int):
        if next(nodes, None) is None:
            return
        sizes = np.flatnonzero(left[1 : min(top, rest) + 1]) + 1
        reach = np.cumsum(left[sizes] * sizes)
        for s, most in zip(sizes[::-1].tolist(), reach[::-1].tolist()):
            if rest - most > slack:
                return
            for k in range(min(int(left[s]), rest // s), 0, -1):
                left[s] -= k
                chosen.extend([s] * k)
                yield from go(rest - k * s, s - 1)
                del chosen[-k:]
                left[s] += k
        if rest <= slack and not dominated(rest):
            yield list(chosen)

    return go(room, room)


def _within(counts: dict[int, int], capacity: int, slack: int, nodes) -> list[tuple[list[int], int]] | None:
    """A plan that wastes at most ``slack``, or None if there is none or the nodes end before one is found.

    Depth-first over the fillings around the largest piece left; each is tried as often as the counts and the slack allow,
    then once, so that every sequence may have a filling of its own.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n

    def choices(slack: int):
        top = int(np.flatnonzero(left)[-1])
        rest = left[: capacity - top + 1].copy()
        rest[top:][:1] -= 1
        for others in _fillings(rest, capacity - top, slack, nodes):
            filling = [top, *others]
            waste = capacity - sum(filling)
            times = min(int(left[s]) // k for s, k in Counter(filling).items())
            times = min(times, slack // waste) if waste else times
            for t in dict.fromkeys((times, 1)):
                yield filling, t, waste * t

    found: list[tuple[list[int], int]] = []
    levels = [(choices(slack), slack)]
    while levels:
        options, slack = levels[-1]
        if (choice := next(options, None)) is None:
            levels.pop()
            if found:
                filling, t = found.pop()
                np.add.at(left, filling, t)
            continue
        filling, t, waste = choice
        np.subtract.at(left, filling, t)
        found.append((filling, t))
        if not left.any():
            return found
        levels.append((choices(slack - waste), slack - waste))
    return None


def _fill(counts: dict[int, int], capacity: int, complete) -> list[tuple[list[int], int]]:
    """Around the largest piece left, a completion is found and used as often as the counts allow, so the work depends on
    the number of different lengths, at most ``capacity``, and not on the number of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    found = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return found
        left[top] -= 1
        filling = [top, *complete(left, capacity - top)]
        left[top] += 1
        uses = Counter(filling)
        times = min(int(left[s]) // k for s, k in uses.items())
        for s, k in uses.items():
            left[s] -= times * k
        found.append((filling, times))


def _slots(fillings: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, sorted by first rank: first rank, pieces per sequence, first sequence, first offset."""
    rows: dict[int, list] = {}
    given: Counter = Counter()
    sequence = 0
    for filling, times in fillings:
        offset = 0
        for size, k in sorted(Counter(filling).items(), reverse=True):
            rows.setdefault(size, []).append((given[size], k, sequence, offset))
            given[size] += k * times
            offset += size * k
        sequence += times
    return {size: tuple(np.asarray(c, np.int64) for c in zip(*r)) for size, r in rows.items()}


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Number the pieces of each length from 0, without one task holding a frequent length."""
    n = total // RANK_ROWS + 1
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    sums = rows.groupBy("length", "_b").count()
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    return rows.withColumn("_n", F.row_number().over(within) - 1).join(first, ["length", "_b"]).withColumn("_rank", F.col("_first") + F.col("_n")).drop("_b", "_n", "_first")


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Place pieces (doc_id, piece, length, any other columns) into sequences of at most ``max_tokens``.

    Pieces of one length are alike, so the plan is made on the counts per length: at most ``max_tokens`` numbers reach
    the driver, whatever the size of the table. Pieces are then ranked within their length and look up their place.

    Returns the given columns with sequence_id and offset; offsets in a sequence are gapless from 0. An empty table
    gives an empty result; repeated rows are placed one by one.
    """
    pieces = stored(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan(counts, max_tokens)))
    rows = ranked(pieces, sum(counts.values()))
    kept = pieces.schema.names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[part[0]])
                start, k, first, at = slots.value[size]
                i = np.searchsorted(start, rank[part], side="right") - 1
                done = rank[part] - start[i]
                sequence[part], offset[part] = first[i] + done // k[i], at[i] + done % k[i] * size
            yield pa.record_batch([*[batch[c] for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return rows.select(*kept, "_rank").mapInArrow(run, schema)


def sequences(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, ids (little-endian uint32 bytes). Each holds at most one sequence's pieces."""
    both = tokens.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "length", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p")).select(
        "sequence_id", "length", F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
