"""Order-dependent placement: decide requests one after another inside independent groups.

Spark finds the groups (runs of connected days), shuffles and sorts them, and bounds their
size. The walkers below see sorted rows stream by and keep only the state a request meets:
free counts, rooms, busy spans.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.windows import running
from ..session import cut_lineage

GROUP_ROWS = 1_000_000

# one relation carries requests and the state they meet; state sorts before requests
BUSY, CELL, ROOM, ASK = 0, 1, 2, 3
ROW = {
    "kind": "int", "seq": "bigint", "ask_id": "bigint", "room_type_id": "bigint", "quantity": "int", "first_day": "int",
    "last_day": "int", "start_us": "bigint", "end_us": "bigint", "free": "bigint", "room_id": "bigint", "room_number": "string",
}
SORT = ["kind", "room_number", "seq", "start_us", "ask_id", "room_id", "room_type_id"]
# what a walk writes: decisions, and the state that a group's next slice starts from
DECISION = {"ask_id": "bigint", "room_type_id": "bigint", "unit": "int", "room_id": "bigint", "code": "string"}
_ARROW_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def day_number(c) -> Column:
    return F.unix_date(F.col(c) if isinstance(c, str) else c)


def as_rows(df: DataFrame, kind: int, group: list[str], **values) -> DataFrame:
    """Bring ``df`` into ROW form; columns a kind does not use are 0 or empty."""
    cols = [F.lit(kind).alias("kind")] + [
        values.get(c, F.lit("" if t == "string" else 0)).cast(t).alias(c) for c, t in ROW.items() if c != "kind"
    ]
    return df.select(*group, *cols)


class LeastFree:
    """Free counts of the listed nights of one type, as a tree of minima: a stay of any length is checked and taken in a logarithmic number of steps."""

    def __init__(self, days: list[int], free: list[int]):
        self.days, n = days, len(days)
        self.size, self.low, self.add = n, [0] * n + free, [0] * n
        for i in range(n - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Places of the listed nights in [first, last)."""
        return bisect_left(self.days, first), bisect_left(self.days, last)

    def least(self, a: int, b: int) -> int | None:
        """The smallest free count of places [a, b); none if there are no places."""
        found, left, right = None, a + self.size, b + self.size
        while left < right:
            for node in ((left,) if left & 1 else ()) + ((right - 1,) if right & 1 else ()):
                value, up = self.low[node], node >> 1
                while up:
                    value += self.add[up]
                    up >>= 1
                found = value if found is None or value < found else found
            left, right = (left + 1) >> 1, right >> 1
        return found

    def take(self, a: int, b: int, n: int) -> None:
        """Lower the counts of places [a, b) by ``n``."""
        touched, left, right = set(), a + self.size, b + self.size
        while left < right:
            for node in ((left,) if left & 1 else ()) + ((right - 1,) if right & 1 else ()):
                self.low[node] -= n
                if node < self.size:
                    self.add[node] -= n
                touched.add(node >> 1)
            left, right = (left + 1) >> 1, right >> 1
        while touched:
            node = max(touched)
            touched.remove(node)
            if node:
                self.low[node] = min(self.low[2 * node], self.low[2 * node + 1]) + self.add[node]
                touched.add(node >> 1)


class Walker:
    """State of one group: free counts per (type, night), rooms in number order, disjoint busy spans per room."""

    def __init__(self):
        self.cells: dict = {}
        self.rooms: dict = {}
        self.numbers: dict = {}
        self.busy: dict = {}

    def add(self, row: tuple, out: list) -> None:
        kind, _, _, type_id, _, day, _, start, end, free, room, number = row
        if kind == BUSY:
            spans = self.busy.setdefault(room, [])
            if spans and start < spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        elif kind == CELL:
            self.cells[type_id, day] = free
        elif kind == ROOM:
            self.rooms.setdefault(type_id, []).append(room)
            self.numbers[type_id, room] = number
        else:
            self.ask(row, out)

    def state(self) -> Iterator[tuple]:
        """What this group's later asks meet, as rows like those the state came in."""
        for room, spans in self.busy.items():
            for start, end in spans:
                yield BUSY, 0, 0, 0, 0, 0, 0, start, end, 0, room, ""
        for (type_id, day), free in self.cells.items():
            yield CELL, 0, 0, type_id, 0, day, 0, 0, 0, free, 0, ""
        for (type_id, room), number in self.numbers.items():
            yield ROOM, 0, 0, type_id, 0, 0, 0, 0, 0, 0, room, number

    def ask(self, row: tuple, out: list) -> None:
        raise NotImplementedError

    def finish(self, out: list) -> None:
        pass

    def is_free(self, room: int, a: int, b: int) -> bool:
        spans = self.busy.get(room)
        if not spans:
            return True
        i = bisect_left(spans, (a, a))
        return not ((i > 0 and spans[i - 1][1] > a) or (i < len(spans) and spans[i][0] < b))

    def take(self, room: int, a: int, b: int) -> None:
        insort(self.busy.setdefault(room, []), (a, b))

    def first_free(self, type_id: int, a: int, b: int) -> int | None:
        return next((r for r in self.rooms.get(type_id, ()) if self.is_free(r, a, b)), None)


class Admit(Walker):
    """Admit requests in arrival order, each with all its lines or not at all: nights first, then rooms.

    Only listed nights are counted; a free count of -1 marks a night without inventory.
    """

    with_rooms = True

    def __init__(self):
        super().__init__()
        self.lines: list[tuple] = []
        self.trees: dict[int, LeastFree] | None = None

    def ask(self, row: tuple, out: list) -> None:
        if self.trees is None:
            days: dict = {}
            for k, day in sorted(self.cells):
                days.setdefault(k, []).append(day)
            self.trees = {k: LeastFree(d, [self.cells[k, x] for x in d]) for k, d in days.items()}
        if self.lines and self.lines[0][2] != row[2]:
            self.finish(out)
        self.lines.append(row)

    def finish(self, out: list) -> None:
        if not self.lines:
            return
        ask_id, code, placed = self.lines[0][2], self._shortage(), []
        if code is None and self.with_rooms:
            placed, code = self._rooms()
        if code is None:
            for _, _, _, k, n, first, last, *_ in self.lines:
                if k in self.trees:
                    self.trees[k].take(*self.trees[k].span(first, last), n)
            out.extend((ask_id, k, u, room, None) for k, u, room, _, _ in placed)
        else:
            for _, _, room, a, b in placed:
                self.busy[room].remove((a, b))
        out.append((ask_id, None, None, None, code or "OK"))
        self.lines = []

    def _shortage(self) -> str | None:
        for _, _, _, k, n, first, last, *_ in self.lines:
            if k not in self.trees:
                continue
            tree = self.trees[k]
            a, b = tree.span(first, last)
            least = tree.least(a, b)
            if least is not None and least < n:
                short = next(x for x in (tree.least(i, i + 1) for i in range(a, b)) if x < n)
                return "MISSING_INVENTORY" if short < 0 else "OVERBOOKING"
        return None

    def state(self) -> Iterator[tuple]:
        for k, tree in (self.trees or {}).items():
            for i, day in enumerate(tree.days):
                self.cells[k, day] = tree.least(i, i + 1)
        return super().state()

    def _rooms(self) -> tuple[list[tuple], str | None]:
        placed: list[tuple] = []
        for _, _, _, k, n, _, _, a, b, *_ in self.lines:
            for u in range(n):
                room = self.first_free(k, a, b)
                if room is None:
                    return placed, "ROOM_ASSIGN_FAILED"
                self.take(room, a, b)
                placed.append((k, u + 1, room, a, b))
        return placed, None


class AdmitNights(Admit):
    with_rooms = False


class Place(Walker):
    """First-fit of single units by (start, request): a unit without a free room stays unplaced."""

    def ask(self, row: tuple, out: list) -> None:
        _, _, ask_id, k, n, _, _, a, b, *_ = row
        for u in range(n):
            room = self.first_free(k, a, b)
            if room is not None:
                self.take(room, a, b)
            out.append((ask_id, k, u + 1, room, None if room is not None else "UNPLACED"))


class Claim(Walker):
    """Requests for a named room in arrival order; a room already taken refuses."""

    def ask(self, row: tuple, out: list) -> None:
        ask_id, a, b, room = row[2], row[7], row[8], row[10]
        free = self.is_free(room, a, b)
        if free:
            self.take(room, a, b)
        out.append((ask_id, None, None, room, "OK" if free else "ROOM_OVERLAP"))


class Settle(Walker):
    """Payments of one booking in arrival order against what is left to pay; amounts in cents, as free counts."""

    def ask(self, row: tuple, out: list) -> None:
        cents, rest = row[9], self.cells[0, 0]
        if cents <= rest:
            self.cells[0, 0] = rest - cents
        out.append((row[2], None, None, None, "OK" if cents <= rest else "TOO_MUCH"))


class Register(Walker):
    """Guests in arrival order; each line is a key, which nobody accepted before may hold. Keys taken are rooms without a type."""

    def __init__(self):
        super().__init__()
        self.lines: list[tuple] = []

    def ask(self, row: tuple, out: list) -> None:
        if self.lines and self.lines[0][2] != row[2]:
            self.finish(out)
        self.lines.append(row)

    def finish(self, out: list) -> None:
        if not self.lines:
            return
        keys = [(0, row[10]) for row in self.lines]
        free = not any(k in self.numbers for k in keys)
        if free:
            self.numbers.update((k, "") for k in keys)
        out.append((self.lines[0][2], None, None, None, "OK" if free else "TAKEN"))
        self.lines = []


def _walk(walker: type[Walker], keys: list[str], carry: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n = len(keys)
    schema = pa.schema([(c, _ARROW_TYPES[t]) for c, t in _written(keys, carry).items()])
    no_state, no_decision = (None,) * (len(schema) - len(DECISION)), (None,) * len(DECISION)

    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out, left = None, None, [], []

        def close() -> None:
            group.finish(out)
            if carry:
                left.extend(no_decision + key + row for row in group.state())

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:n] != key:
                    if group is not None:
                        close()
                    key, group = row[:n], walker()
                group.add(row[n:], out)
                if len(out) + len(left) >= 50_000:
                    yield emit([d + no_state for d in out] + left if carry else out)
                    out.clear(), left.clear()
        if group is not None:
            close()
        if out or left:
            yield emit([d + no_state for d in out] + left if carry else out)

    return run


def _written(keys: list[str], carry: bool) -> dict[str, str]:
    """Columns of a walk's output: a decision and, if state is handed on, the prefixed columns of one row of it."""
    state = {**{f"s_{k}": "bigint" for k in keys}, **{f"s_{c}": t for c, t in ROW.items()}}
    return {**DECISION, **(state if carry else {})}


def decide_in_order(
    asks: DataFrame, state: DataFrame, group: list[str], order: list[str], bucket: Column, walker: type[Walker], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Walk every group in order and write down the decisions.

    ``asks`` are ROW rows, one or more per ask; ``state`` are the ROW rows that asks meet. Groups are spread by hash and sorted by
    Spark, so a task holds the state of one group at a time, not its asks. A group above ``group_rows`` asks is cut along
    ``order`` into slices. Each slice is one job that writes one table: its decisions and the state it leaves, which is all the next slice
    reads besides its own asks. However many slices there are, none looks at earlier decisions. Group columns are whole numbers.
    """
    names = [*group, *ROW]

    def walk(part: DataFrame, meets: DataFrame, carry: bool) -> DataFrame:
        rows = part.select(*names).unionByName(meets.select(*names)).withColumns({g: F.col(g).cast("bigint") for g in group})
        lined_up = rows.repartition(*group).sortWithinPartitions(*group, *SORT)
        return cut_lineage(lined_up.mapInArrow(_walk(walker, group, carry), ", ".join(f"{c} {t}" for c, t in _written(group, carry).items())))

    asks = cut_lineage(asks)
    sizes = asks.groupBy(*group).count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= group_rows:
        return walk(asks, state, False).select(*DECISION)
    large = cut_lineage(sizes.filter(F.col("count") > group_rows).select(*group))
    decided = walk(asks.join(large, group, "left_anti"), state.join(large, group, "left_anti"), False).select(*DECISION)
    # number the asks, not their rows: the rows of one ask stay in one slice
    rows = asks.join(large, group, "left_semi")
    heads = rows.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = running(heads, group, bucket, order, {"_upto": ("sum", "_rows", 0)}, inclusive=True)
    ranked = ranked.select(*group, *order, F.floor((F.col("_upto") - 1) / group_rows).cast("int").alias("_slice"))
    sliced = cut_lineage(rows.join(ranked, [*group, *order]), "_slice")
    meets, last = state.join(large, group, "left_semi"), sliced.agg(F.max("_slice")).first()[0]
    for k in range(last):
        out = walk(sliced.filter(F.col("_slice") == k), meets, True)
        decided = decided.unionByName(out.filter("s_kind IS NULL").select(*DECISION))
        meets = out.filter("s_kind IS NOT NULL").select(*[F.col(f"s_{c}").alias(c) for c in names])
    return decided.unionByName(walk(sliced.filter(F.col("_slice") == last), meets, False))
