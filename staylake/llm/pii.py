"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.windows import running
from .common import discard, stored, texts
from .words import slices

KINDS = ("email", "ip", "card", "phone")
# The patterns whose valid matches are always reported; e-mail, [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, is in emails().
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a run of digits fails or matches from its first one
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Candidates: wider than the patterns above, and free to overlap.
WIDE = {
    "email": re.compile(r"[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[\w-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[\w-]{1,64}){0,8}"),
    "ip": re.compile(r"[0-9]{1,4}(?: ?[.,] ?[0-9]{1,4}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}"),
    "card": re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){11,}"),
    "phone": re.compile(r"(?:\+ ?|00)?\(?[0-9][0-9 ()./-]{5,}[0-9]"),
}
# Words before a span that tell what follows.
CUES = {
    "email": ("mail", "email", "contact", "write", "address"), "ip": ("ip", "host", "server", "address", "from", "ping"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "account"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial"),
}
ROUNDS, DEPTH, BINS, SHRINK = 40, 3, 32, 0.2
UNIT = 1 << 24  # gradients are summed as whole numbers of 1 / UNIT, so that sums do not depend on the order of rows
PRECISION, LEAST = 0.98, 20  # a threshold must reach this precision on rows kept from the fit, over so many of them

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in match.split(".")))
    digits = "".join(_DIGIT.findall(match))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the e-mail pattern, found from the @ signs: a scan from every character would take the square of a long word."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all valid matches, leftmost and non-overlapping within a kind; sorted."""
    found = []
    digits = _DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        if kind == "email":
            found += [(a, k, b) for a, b in emails(text)]
        elif digits and (kind != "phone" or "+" in text):
            found += [(m.start(), k, m.end()) for m in BASE[kind].finditer(text) if valid(kind, m.group())]
    return sorted(found)


def _side(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of everything that may be personal data."""
    found = []
    digits = _DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        if ("@" in text or "at)" in text or "at]" in text or "at}" in text) if kind == "email" else digits or kind == "ip" and "::" in text:
            found += [(m.start(), k, m.end()) for m in WIDE[kind].finditer(text)]
    return found


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate. A leading plus, check sums and value ranges have no part: the fixed patterns test them."""
    s = text[start:end].removeprefix("+")
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    n = sum(groups)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    cue = max((i + 1 for i, w in enumerate(words) if w in CUES[KINDS[kind]]), default=0)
    other = sum(w in c for w in words for k, c in CUES.items() if k != KINDS[kind])
    signs = [sum(s.count(c) for c in cs) for cs in (" ", "-", ".", "/", "()", ":@", ",")]
    letters = sum(c.isalpha() for c in s)
    return [
        n, len(s), len(groups), *(groups[:4] + [0] * 4)[:4], groups[-1] if groups else 0, *signs, letters, n / max(len(s), 1),
        len(set(_DIGIT.findall(s))), _side(before[-1:]), _side(after[:1]), _side(after[1:2]), cue, other, sum(c.isdigit() for c in before + after),
    ]


class Boosted:
    """Gradient-boosted trees of a fixed depth for a yes-or-no label, over binned features.

    Trees grow by levels: ``sums`` gives the gradient sums of some rows, ``grow`` takes those of all rows.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.begin([np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]) for c in x.T], y.mean())
        b = self.binned(x)
        while not self.full():
            self.grow(*self.sums(b, np.ones(len(y)), y))

    @classmethod
    def begun(cls, quantiles: list, share: float) -> "Boosted":
        """No tree yet; ``quantiles`` of each feature and the share of right rows."""
        self = cls.__new__(cls)
        self.begin(quantiles, share)
        return self

    def begin(self, quantiles: list, share: float) -> None:
        self.edges = [np.unique(q) for q in quantiles]
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        self._plant()

    def full(self) -> bool:
        return len(self.trees) == ROUNDS

    def _plant(self) -> None:
        inner = (1 << DEPTH) - 1
        self.level, self.feature, self.cut = 0, np.zeros(inner, int), np.full(inner, BINS, int)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def sums(self, b: np.ndarray, n: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives, summed per node of the current level, feature and bin, over rows that stand for ``n`` examples, ``right`` of them positive."""
        z = np.full(len(b), self.start)
        for tree in self.trees:
            z += self._apply(tree, b)
        p = 1 / (1 + np.exp(-z))
        g, h = np.rint(UNIT * (n * p - right)), np.rint(UNIT * n * p * (1 - p))
        at, nodes = self._node(self.feature, self.cut, b, self.level) - (1 << self.level) + 1, 1 << self.level
        found = np.zeros((2, nodes, b.shape[1], BINS + 1), np.int64)
        for f in range(b.shape[1]):
            code = at * (BINS + 1) + b[:, f]
            for i, w in enumerate((g, h)):
                found[i, :, f] = np.bincount(code, w, nodes * (BINS + 1)).reshape(nodes, -1)
        return found[0], found[1]

    def grow(self, g: np.ndarray, h: np.ndarray) -> None:
        """Split the nodes of the current level by the sums over all rows; after the last level the tree is done."""
        left_g, left_h = g.cumsum(axis=2) / UNIT, h.cumsum(axis=2) / UNIT
        total_g, total_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
        gain[(left_h < 1) | (right_h < 1)] = 0
        first, n = (1 << self.level) - 1, 1 << self.level
        leaves = []
        for node in range(n):
            f, c = 0, BINS
            for k in range(gain.shape[1]):
                j = int(gain[node, k].argmax())
                if gain[node, k, j] > (gain[node, f, c] if c < BINS else 0) + 1e-9:
                    f, c = k, j
            self.feature[first + node], self.cut[first + node] = f, c
            for side_g, side_h in ((left_g, left_h), (right_g, right_h)):
                leaves.append(-SHRINK * side_g[node, f, c] / (side_h[node, f, c] + 1))
        self.level += 1
        if self.level == DEPTH:
            self.trees.append((self.feature, self.cut, np.array(leaves)))
            self._plant()

    @staticmethod
    def _node(feature: np.ndarray, cut: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
        node, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(levels):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return node

    @classmethod
    def _apply(cls, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        return value[cls._node(feature, cut, b, DEPTH) - len(feature)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return 1 / (1 + np.exp(-self.start - sum(self._apply(t, b) for t in self.trees)))


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on at least ``PRECISION`` of ``LEAST`` rows or more are right; infinite if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.concatenate([p[order][1:] < p[order][:-1], [True]])[: len(p)] if len(p) else np.zeros(0, bool)
    ok = np.flatnonzero((right >= PRECISION) & last & (np.arange(1, len(y) + 1) >= LEAST))
    return float(p[order][ok[-1]]) if len(ok) else float("inf")


class Taken:
    """Stretches of a text that have been given away, in merged form."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start), self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def take(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start), self.ends.insert(i, end)


def _examples(batches):
    """Candidates of the texts by kind, half of the documents and features: how many there are and how many a fixed pattern matches."""
    for whole in batches:
        for batch in slices(whole, "text"):
            every, right = Counter(), Counter()
            for half, text in zip(batch["half"].to_pylist(), batch["text"].to_pylist()):
                sure = base_spans(text)
                by_kind = [[(s, e) for s, k, e in sure if k == n] for n in range(len(KINDS))]
                for start, kind, end in candidates(text):
                    own = by_kind[kind]
                    i = bisect_left(own, (end, 0))
                    near = own[max(i - 2, 0) : i]
                    x = kind, half, np.array(describe(text, kind, start, end), "<f8").tobytes()
                    every[x] += 1
                    right[x] += any(min(e, end) - max(s, start) >= 0.8 * (max(e, end) - min(s, start)) for s, e in near)
            kinds, halves, rows = zip(*every) if every else ((), (), ())
            columns = [(kinds, pa.int32()), (halves, pa.bool_()), (rows, pa.binary()), (every.values(), pa.int64()), ([right[x] for x in every], pa.int64())]
            yield pa.record_batch([pa.array(list(c), t) for c, t in columns], ["kind", "half", "x", "n", "right"])


def _by_kind(batch: pa.RecordBatch, column: str, dtype: str):
    """(kind, matrix of the coded rows, n, right) for each kind of a batch."""
    kinds, n, right = (batch[c].to_numpy() for c in ("kind", "n", "right"))
    coded = np.array(batch[column].to_pylist(), object)
    for kind in np.unique(kinds).tolist():
        own = kinds == kind
        yield kind, np.frombuffer(b"".join(coded[own]), dtype).reshape(int(own.sum()), -1), n[own], right[own]


def _values(batches):
    """How often each feature has each value."""
    for batch in batches:
        for kind, x, n, _ in _by_kind(batch, "x", "<f8"):
            for f in range(x.shape[1]):
                v, at = np.unique(x[:, f], return_inverse=True)
                times = np.bincount(at, n, len(v)).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(v), c, np.int32)) for c in (kind, f)] + [pa.array(v), pa.array(times)], ["kind", "feature", "v", "n"])


def _binned(models: dict):
    def run(batches):
        for batch in batches:
            for kind, x, n, right in _by_kind(batch, "x", "<f8"):
                b = models[kind].binned(x).astype(np.uint8)
                yield pa.record_batch([pa.array(np.full(len(b), kind, np.int32)), pa.array([r.tobytes() for r in b], pa.binary()), pa.array(n), pa.array(right)], ["kind", "b", "n", "right"])

    return run


def _level_sums(models: dict):
    """A task's gradient sums for the current level of each kind's current tree, cell by cell."""

    def run(batches):
        found: dict = {}
        for batch in batches:
            for kind, b, n, right in _by_kind(batch, "b", "u1"):
                part = np.stack(models[kind].sums(b.astype(int), n, right))
                found[kind] = found.get(kind, 0) + part
        for kind, part in found.items():
            g, h = part.reshape(2, -1)
            cell = np.flatnonzero(g | h)
            yield pa.record_batch([pa.array(np.full(len(cell), kind, np.int32)), pa.array(cell.astype(np.int32)), pa.array(g[cell]), pa.array(h[cell])], ["kind", "cell", "g", "h"])

    return run


def _scores(models: dict):
    def run(batches):
        for batch in batches:
            for kind, x, n, right in _by_kind(batch, "x", "<f8"):
                yield pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), pa.array(models[kind].predict(x)), pa.array(n), pa.array(right)], ["kind", "p", "n", "right"])

    return run


def _begun(examples: DataFrame) -> dict[int, Boosted]:
    """Models without trees for the kinds that have both sorts of examples in the half that fits, and any in the other."""
    sizes = {(r["kind"], r["half"]): (r["n"], r["right"]) for r in examples.groupBy("kind", "half").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).collect()}
    usable = [k for k in range(len(KINDS)) if (k, False) in sizes and 0 < sizes.get((k, True), (0, 0))[1] < sizes[k, True][0]]
    if not usable:
        return {}
    counts = examples.filter(F.col("half") & F.col("kind").isin(usable)).select("kind", "x", "n", "right").mapInArrow(_values, "kind int, feature int, v double, n long")
    at = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    edges = counts.groupBy("kind", "feature", "v").agg(F.sum("n").alias("n")).groupBy("kind", "feature").agg(F.percentile("v", at, F.col("n")).alias("q")).collect()
    found = {(r["kind"], r["feature"]): r["q"] for r in edges}
    width = 1 + max(f for _, f in found)
    return {k: Boosted.begun([found[k, f] for f in range(width)], sizes[k, True][1] / sizes[k, True][0]) for k in usable}


def _thresholds(examples: DataFrame, models: dict[int, Boosted]) -> dict[int, float]:
    """What ``threshold`` gives over all candidates of the half that did not fit the trees; kinds without a threshold are left out."""
    held = examples.filter(~F.col("half") & F.col("kind").isin(list(models))).select("kind", "x", "n", "right")
    scored = held.mapInArrow(_scores(models), "kind int, p double, n long, right long").groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    ranked = running(stored(scored), ["kind"], F.floor(F.col("p") * -10_000), [F.desc("p")], {"upto": ("sum", "n", 0), "good": ("sum", "right", 0)}, inclusive=True)
    least = ranked.filter((F.col("good") / F.col("upto") >= PRECISION) & (F.col("upto") >= LEAST)).groupBy("kind").agg(F.min("p").alias("p"))
    return {r["kind"]: r["p"] for r in least.collect()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[int, tuple[Boosted, float]]:
    """Trees and threshold per kind, fitted on all candidates of all documents.

    The valid matches of the fixed patterns are the positive examples, all other candidates the negative ones. Half of the
    documents fit the trees; the other half sets the threshold. A kind without both sorts of examples has no trees.

    Equal examples are counted, not kept. Bin edges are quantiles over all examples; each level of each tree is one job in which every
    task sums the gradients of its examples, for all kinds at once. The driver sees sums per node, feature and bin only.
    """
    half = F.shiftright(F.xxhash64("doc_id"), 7).bitwiseAND(F.lit(1)) == 1
    # texts without any of these have no candidates
    rows = texts(docs, id_col, text_col).filter(F.col("text").rlike(r"[0-9@]|at[)\]}]|::")).select(half.alias("half"), "text")
    found = rows.mapInArrow(_examples, "kind int, half boolean, x binary, n long, right long")
    examples = stored(found.groupBy("kind", "half", "x").agg(F.sum("n").alias("n"), F.sum("right").alias("right")))
    models = _begun(examples)
    if not models:
        return {}
    fitted = examples.filter(F.col("half") & F.col("kind").isin(list(models))).select("kind", "x", "n", "right")
    fitted = fitted.mapInArrow(_binned(models), "kind int, b binary, n long, right long")
    fitted = stored(fitted.groupBy("kind", "b").agg(F.sum("n").alias("n"), F.sum("right").alias("right")))
    while not all(m.full() for m in models.values()):
        cells = fitted.mapInArrow(_level_sums(models), "kind int, cell int, g long, h long").groupBy("kind", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        kinds, cell, g, h = (cells[c].to_numpy() for c in ("kind", "cell", "g", "h"))
        for kind, model in models.items():
            sums = np.zeros((2, 1 << model.level, len(model.edges), BINS + 1), np.int64)
            own = kinds == kind
            sums.reshape(2, -1)[:, cell[own]] = g[own], h[own]
            model.grow(*sums)
    least = _thresholds(examples, models)
    discard(examples, fitted)
    return {kind: (model, least.get(kind, float("inf"))) for kind, model in models.items()}


def added(text: str, sure: list[tuple[int, int, int]], models: dict) -> list[tuple[int, int, int]]:
    """Candidates that pass their threshold, best first, where nothing else was found."""
    taken = Taken([(s, e) for s, _, e in sure])
    usable = [k for k, (_, least) in models.items() if np.isfinite(least)]
    rest = [c for c in candidates(text) if c[1] in usable and not taken.meets(c[0], c[2])] if usable else []
    scored = []
    for kind in {k for _, k, _ in rest}:
        own = [c for c in rest if c[1] == kind]
        trees, least = models[kind]
        p = trees.predict(np.array([describe(text, kind, s, e) for s, _, e in own], float))
        scored += [(-q, c) for q, c in zip(p.tolist(), own) if q >= least]
    found = []
    for _, c in sorted(scored):
        if not taken.meets(c[0], c[2]):
            taken.take(c[0], c[2])
            found.append(c)
    return found


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_pii(docs: DataFrame, models: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base, spans, redacted.

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by start, then kind, comma-joined; ``spans``
    also has candidates that the trees accept where no fixed pattern matched. ``redacted`` replaces all spans.

    A null text counts as empty. Repeated rows are each answered; a null id stays null; an empty table gives an empty
    result. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def show(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches):
        trees = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, base, spans, clean = [], [], [], []
                for text in batch["text"].to_pylist():
                    sure = base_spans(text)
                    every = sorted({*sure, *added(text, sure, trees)})
                    counts.append([sum(k == n for _, k, _ in sure) for n in range(len(KINDS))])
                    base.append(show(sure)), spans.append(show(every)), clean.append(redact(text, every))
                columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(len(KINDS))]
                yield pa.record_batch(
                    [batch["doc_id"], *columns, pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"],
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {counts}, base string, spans string, redacted string")
