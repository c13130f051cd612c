"""Ordered jobs on one hot group: state handed from slice to slice, tables counted, chains of guests."""

import datetime as dt
import random
from decimal import Decimal as D

import golden
import pytest

from staylake import session
from staylake.functions import components as graph
from staylake.plans import admission, bookings, money, ordered
from staylake.sources.schemas import REQUESTS


@pytest.fixture
def written(monkeypatch):
    """Counts the tables that the modules under test write."""
    made = []
    for module in (ordered, bookings, graph, money, admission):
        monkeypatch.setattr(module, "cut_lineage", lambda df, *by: made.append(by) or session.cut_lineage(df, *by))
    return made


def test_least_free_matches_list():
    rnd = random.Random(4)
    for n in (1, 2, 3, 7, 20, 33):
        days = sorted(rnd.sample(range(100), n))
        free = [rnd.randrange(-1, 9) for _ in days]
        tree = ordered.LeastFree(days, list(free))
        for _ in range(60):
            first, last = sorted(rnd.sample(range(101), 2))
            at = [i for i, d in enumerate(days) if first <= d < last]
            a, b = tree.span(first, last)
            assert list(range(a, b)) == at and tree.least(a, b) == min((free[i] for i in at), default=None)
            if rnd.random() < 0.6:
                tree.take(a, b, 1)
                for i in at:
                    free[i] -= 1


def payments(spark, step, n=1001):
    rnd = random.Random(7)
    pays = [(i * step, 1, D(rnd.randrange(1, 900)) / 100) for i in range(n)]
    rest, want = D("400.00"), {}
    for seq, _, amount in pays:
        want[seq] = amount <= rest
        rest -= amount if want[seq] else 0
    due = spark.createDataFrame([(*p, D("400.00")) for p in pays], "seq bigint, booking_id bigint, amount decimal(18,2), rest decimal(18,2)")
    return due, want


def test_sparse_payments_write_as_many_tables_as_dense_ones(spark, written):
    """1,001 tight payments of one booking, numbered 1, 2, ... and a million apart: as many slices, equal to plain Python."""
    counts = []
    for step in (1, 1_000_000):
        due, want = payments(spark, step)
        del written[:]
        got = {r.seq: r.fits for r in money.settle_payments(due, 100, 300).collect()}
        assert got == want and 0 < sum(want.values()) < len(want)
        counts.append(len(written))
    assert counts[0] == counts[1] <= 10


def test_amounts_are_rounded_once(spark):
    """An amount of three decimals is the same amount on both ways of settling."""
    req = [(i, 1, D("0.005") * (2 * i + 1), 1) for i in range(30)]
    t = golden.two_stays(spark)
    rows = spark.createDataFrame(req, "seq bigint, booking_id int, amount decimal(20,3), staff_id int")
    results = [
        sorted((r.seq, r.amount, r.accepted) for r in money.apply_payments(t, rows, golden.AS_OF, fold, slices)["results"].collect())
        for fold, slices in ((1000, 1000), (2, 7))
    ]
    assert results[0] == results[1] and results[0][0][1] == D("0.01")


def test_slices_read_the_state_of_the_last_one_only(spark, monkeypatch, written):
    """However many slices, a slice starts from one written table: plans of later slices read no more files than the second's."""
    t = golden.two_stays(spark)
    asks = [(i, i, 1 + i % 2, 1, i % 9, i % 9 + 1 + i % 4) for i in range(60)]
    rows = spark.createDataFrame([(1, 0, 3, s, a, k, q, f, e, 0, 0, 0, 0, "") for s, a, k, q, f, e in asks], "g bigint, run bigint, " + ", ".join(f"{c} {x}" for c, x in ordered.ROW.items()))
    cells = spark.createDataFrame([(1, 0, 1, 0, 0, k, 0, d, 0, 0, 0, 6, 0, "") for k in (1, 2) for d in range(13)], rows.schema)
    sources = []
    kept = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df, *by: sources.append(len(df.inputFiles())) or kept(df, *by))
    free, want = {(k, d): 6 for k in (1, 2) for d in range(13)}, {}
    for _, a, k, q, f, e in asks:
        ok = all(free[k, d] >= q for d in range(f, e))
        want[a] = "OK" if ok else "OVERBOOKING"
        for d in range(f, e):
            free[k, d] -= q if ok else 0
    for size in (1000, 20, 6):
        del sources[:]
        out = ordered.decide_in_order(rows, cells, ["g", "run"], ["seq", "ask_id"], bookings.seq_bucket(), ordered.AdmitNights, size)
        assert {r.ask_id: r.code for r in out.collect()} == want and set(want.values()) == {"OK", "OVERBOOKING"}
        walks = sources[-(60 // size):] if size < 60 else []
        assert not walks or max(walks[1:]) <= 2 * max(walks[:2])


def guests(spark, n, order):
    """A chain: each guest shares its phone with the one before and its card with the one after."""
    rows = [(order[i], f"G {i}", f"07{(i + 1) // 2:08d}", None, f"c{i // 2}", dt.date(1990, 1, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, REQUESTS["customer_requests"])


@pytest.mark.parametrize("size", [1_000_000, 150])
def test_chained_guests(spark, written, size):
    """A chain of 1,000 guests takes a number of tables that grows with its logarithm, and slices change nothing."""
    t = golden.seed(spark)
    order = list(range(1, 1001))
    rows, req = guests(spark, 1000, order)
    held, want = set(), {}
    for seq, _, phone, _, card, _ in sorted(rows):
        ok = not held & {phone, card}
        want[seq] = ok
        held |= {phone, card} if ok else set()
    state = bookings.customer_intake(t, req, golden.AS_OF, size)
    assert {r.seq: r.accepted for r in state["results"].collect()} == want
    assert len(written) < 40 and 300 < sum(want.values()) < 700


def test_components_match_union_find(spark, written):
    rnd = random.Random(2)
    chain = list(range(300))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(400, x) for x in range(401, 500)] + [(600, 600)] + [(rnd.randrange(700, 800), rnd.randrange(700, 800)) for _ in range(60)]
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(up)} and len(written) <= 14
