"""Invoices and payments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import INVOICEABLE_STATES, MONEY, money, timestamp
from ..functions.windows import seq_bucket
from ..operators.changes import update_from_join, updated_rows, upsert_by_key
from ..session import cut_lineage
from .common import BAD_AMOUNT, TOO_MUCH, State, accepted, max_id, state_code, verdict, with_booking
from .ordered import ASK, CELL, Settle, as_rows, decide_in_order

FOLD_ROWS = 1_000
SLICE_ROWS = 1_000_000


def issue_invoices(t: Mapping, req: DataFrame, as_of) -> State:
    """Issue or renew the invoice of each requested booking (seq, booking_id, staff_id).

    Renewing copies the booking's sums and sets Issued, also on a paid invoice. A Void invoice is left alone;
    the request still counts as accepted.
    """
    judged = with_booking(req, t, "status", "total_amount", "amount_paid").withColumn("code", state_code(INVOICEABLE_STATES))
    last = accepted(judged).groupBy("booking_id").agg(
        F.max_by("staff_id", "seq").alias("issued_by"), F.any_value("b_total_amount").alias("total"), F.any_value("b_amount_paid").alias("paid")
    )
    old = t["invoices"]
    src = last.select(
        "booking_id",
        (max_id(old) + F.col("booking_id")).alias("id"),
        money("total").alias("total_amount"), money("paid").alias("amount_paid"), money(F.col("total") - F.col("paid")).alias("balance"),
        F.lit("Issued").alias("status"), timestamp(as_of).alias("issued_at"), "issued_by",
    )
    invoices = upsert_by_key(
        old, src.select(*[c for c in src.columns if c in old.columns]), ["booking_id"],
        ["total_amount", "amount_paid", "balance", "status", "issued_at", "issued_by"], guard="status <> 'Void'",
    )
    return {"results": verdict(judged, "seq", "booking_id"), "invoices": invoices}


def settle_payments(due: DataFrame, fold_rows: int = FOLD_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(booking_id, seq, fits) for payments (booking_id, seq, amount, rest) taken in order against what is due.

    Most bookings need no order: an amount above the whole rest never fits, and if the others fit
    together they all fit. The remaining ones are walked in order inside the JVM, by a fold over a
    short sorted array. A booking with more than ``fold_rows`` such payments is walked in slices of ``slice_rows`` payments
    by rank, whatever their numbers; a slice hands what is left to pay to the next one.
    """
    small = due.filter("amount <= rest")
    load = small.groupBy("booking_id").agg(F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    sized = small.join(load, "booking_id")
    easy = sized.filter("_sum <= rest").select("booking_id", "seq", F.lit(True).alias("fits"))
    tight = sized.filter("_sum > rest")
    step = "named_struct('rest', IF(p.amount <= acc.rest, CAST(acc.rest - p.amount AS DECIMAL(18,2)), acc.rest), 'ok', CONCAT(acc.ok, ARRAY(p.amount <= acc.rest)))"
    start = "named_struct('rest', CAST(rest AS DECIMAL(18,2)), 'ok', CAST(ARRAY() AS ARRAY<BOOLEAN>))"
    lists = (
        tight.filter(F.col("_n") <= fold_rows)
        .groupBy("booking_id").agg(F.first("rest").alias("rest"), F.array_sort(F.collect_list(F.struct("seq", "amount"))).alias("pays"))
        .withColumn("ok", F.expr(f"AGGREGATE(pays, {start}, (acc, p) -> {step}).ok"))
    )
    folded = lists.select("booking_id", F.explode(F.arrays_zip("pays", "ok")).alias("z")).select(
        "booking_id", F.col("z.pays.seq").alias("seq"), F.col("z.ok").alias("fits")
    )
    done = easy.unionByName(folded)
    hot = tight.filter(F.col("_n") > fold_rows)
    if hot.isEmpty():
        return _all_verdicts(due, done)
    group, cents = ["booking_id"], lambda c: (F.col(c) * 100).cast("bigint")
    hot = cut_lineage(hot)
    asks = as_rows(hot, ASK, group, seq=F.col("seq"), ask_id=F.col("seq"), free=cents("amount"))
    left = as_rows(hot.groupBy("booking_id").agg(F.first("rest").alias("rest")), CELL, group, free=cents("rest"))
    walked = decide_in_order(asks, left, group, ["seq", "ask_id"], seq_bucket(), Settle, slice_rows)
    settled = walked.select(F.col("ask_id").alias("seq"), (F.col("code") == "OK").alias("fits")).join(hot.select("booking_id", "seq"), "seq")
    return _all_verdicts(due, done.unionByName(settled.select("booking_id", "seq", "fits")))


def _all_verdicts(due: DataFrame, done: DataFrame) -> DataFrame:
    return due.join(done, ["booking_id", "seq"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def apply_payments(t: Mapping, req: DataFrame, as_of, fold_rows: int = FOLD_ROWS, slice_rows: int = SLICE_ROWS) -> State:
    """Take payments (seq, booking_id, amount, staff_id) in arrival order.

    A payment may not lift the paid sum above the booking's total. The invoice, unless Void, follows and turns
    Paid once its own total is reached. ``changed_bookings`` and ``changed_invoices`` are the rows that differ, for a versioned table.
    """
    # money has two decimals; an amount with more is rounded here, before anything compares it
    asked = req.withColumn("amount", money("amount"))
    judged = with_booking(asked, t, "status", "total_amount", "amount_paid").withColumn(
        "guard", F.coalesce(F.when(~F.coalesce(F.col("amount") > 0, F.lit(False)), BAD_AMOUNT), state_code(INVOICEABLE_STATES))
    )
    due = judged.filter("guard IS NULL").select(
        "booking_id", "seq", "amount", money(F.col("b_total_amount") - F.col("b_amount_paid")).alias("rest")
    )
    fits = settle_payments(due, fold_rows, slice_rows).select("booking_id", "seq", "fits")
    judged = judged.join(fits, ["booking_id", "seq"], "left").withColumn(
        "code", F.coalesce("guard", F.when(~F.col("fits"), TOO_MUCH))
    )
    paid = accepted(judged).groupBy("booking_id").agg(
        F.sum("amount").cast(MONEY).alias("paid"), F.max_by("staff_id", "seq").alias("staff_id")
    )
    payers = paid.withColumnRenamed("booking_id", "id")
    new_booking = {"amount_paid": F.col("amount_paid") + F.col("paid"), "updated_by": F.col("staff_id"), "updated_at": timestamp(as_of)}
    open_invoice = F.col("status") != "Void"
    new_paid = F.col("amount_paid") + F.col("paid")
    new_invoice = {
        "amount_paid": F.when(open_invoice, new_paid).otherwise(F.col("amount_paid")),
        "balance": F.when(open_invoice, F.col("balance") - F.col("paid")).otherwise(F.col("balance")),
        "status": F.when(~open_invoice, F.col("status")).when(new_paid >= F.col("total_amount"), "Paid").otherwise("Issued"),
    }
    sums = paid.select("booking_id", "paid")
    return {
        "results": verdict(judged, "seq", "booking_id", "amount"),
        "bookings": update_from_join(t["bookings"], payers, ["id"], new_booking),
        "invoices": update_from_join(t["invoices"], sums, ["booking_id"], new_invoice),
        "changed_bookings": updated_rows(t["bookings"], payers, ["id"], new_booking),
        "changed_invoices": updated_rows(t["invoices"], sums, ["booking_id"], new_invoice),
    }
