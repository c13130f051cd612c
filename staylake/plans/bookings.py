"""Booking life cycle jobs that need no order-dependent step: intake, finalize, cancel, services, totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import live, money, timestamp
from ..operators.billing import booking_total, time_surcharges
from ..operators.changes import append_rows, update_from_join
from ..operators.filters import form_code
from ..functions.components import components
from ..functions.windows import seq_bucket
from ..session import cut_lineage
from .admission import inventory_after
from .common import (
    BAD_PERIOD, BAD_QUANTITY, BAD_STATE, DUPLICATE, NOT_FOUND, State, accepted, first_wins, max_id, number_rows, patched,
    state_code, verdict, with_booking,
)
from .ordered import ASK, GROUP_ROWS, Register, as_rows, decide_in_order

TIME_SURCHARGES = ["EarlyCheckIn", "LateCheckOut"]


def booking_intake(t: Mapping, req: DataFrame, as_of) -> State:
    """Open a Pending booking per request with a fresh idempotency key.

    A key known from a Pending booking resumes it (code stays empty, the known id is given back); any other
    known key, and any key repeated in the batch, is a DUPLICATE. Requests without a stay do not use up their key.
    """
    known = t["bookings"].filter("idempotency_key IS NOT NULL").select(
        "idempotency_key", F.col("id").alias("known_id"), F.col("status").alias("known_status")
    )
    bad_stay = ~F.coalesce(F.col("check_out") > F.col("check_in"), F.lit(False))
    judged = req.join(known, "idempotency_key", "left").withColumn(
        "code",
        F.when(bad_stay, BAD_PERIOD).when(F.col("known_id").isNotNull() & ~F.col("known_status").eqNullSafe(F.lit("Pending")), DUPLICATE),
    )
    # a missing key is unique by itself
    judged = judged.withColumn("_key", F.coalesce("idempotency_key", F.concat(F.lit("seq "), F.col("seq").cast("string"))))
    judged = first_wins(judged, ["_key"], DUPLICATE).drop("_key")
    new_id = max_id(t["bookings"]) + 1 + F.col("seq")
    judged = judged.withColumn("booking_id", F.when(F.col("code").isNull(), F.coalesce("known_id", new_id)))
    judged = judged.withColumn("resumed", F.col("code").isNull() & F.col("known_id").isNotNull())
    rows = new_bookings(accepted(judged).filter("NOT resumed"), as_of)
    old = t["bookings"]
    return {
        "results": judged.select("seq", "request_id", "booking_id", "resumed", F.col("code").isNull().alias("accepted"), "code"),
        "bookings": append_rows(old, rows.select(*[c for c in old.columns if c in rows.columns])),
    }


def new_bookings(rows: DataFrame, as_of) -> DataFrame:
    """Booking rows in state Pending for opened requests."""
    return rows.select(
        F.col("booking_id").alias("id"), "hotel_id", "customer_id", F.lit("Pending").alias("status"), "idempotency_key", "check_in", "check_out",
        money(F.lit(0)).alias("total_amount"), money(F.lit(0)).alias("amount_paid"),
        timestamp(as_of).alias("created_at"), timestamp(as_of).alias("updated_at"),
    )


GUEST_KEYS = {"phone_number": "DUPLICATE_PHONE", "email": "DUPLICATE_EMAIL", "identity_card": "DUPLICATE_IDENTITY"}


def _guest_keys(df: DataFrame, *keep: str) -> DataFrame:
    """(kind, value) pairs of a guest's keys, nulls left out; ``rank`` is the order the keys are reported in."""
    entries = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("rank"), F.col(c).alias("value"))) for i, c in enumerate(GUEST_KEYS)
    ]
    return df.select(*keep, F.explode(F.array_compact(F.array(*entries))).alias("k")).select(*keep, "k.rank", "k.value")


def _first_on_all(open_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Guests who are first on all their keys, and the keys of those whom this leaves undecided (copies of a key all go out at once)."""
    first = open_keys.groupBy("rank", "value").agg(F.min("seq").alias("seq")).withColumn("first", F.lit(1))
    score = open_keys.join(first, ["rank", "value", "seq"], "left").groupBy("seq").agg(
        (F.count(F.lit(1)) == F.sum(F.coalesce("first", F.lit(0)))).alias("leads")
    )
    lead = cut_lineage(score.filter("leads").select("seq"))
    lead_keys = open_keys.join(lead, "seq", "left_semi").select("rank", "value").distinct()
    out = open_keys.join(lead_keys, ["rank", "value"], "left_semi").select("seq").distinct()
    return lead, cut_lineage(open_keys.join(out, "seq", "left_anti"))


def _chained(open_keys: DataFrame, group_rows: int) -> DataFrame:
    """Accepted guests (seq) among those that share keys in chains."""
    # a key is named by the first guest who has it; a guest has one key of each rank
    first = open_keys.groupBy("rank", "value").agg(F.min("seq").alias("b"))
    linked = cut_lineage(open_keys.join(first, ["rank", "value"]).select("seq", "rank", "b"))
    parts = components(linked.select(F.col("seq").alias("a"), "b")).withColumnRenamed("root", "part")
    group = ["part"]
    rows = linked.join(parts.withColumnRenamed("node", "seq"), "seq")
    asks = as_rows(rows, ASK, group, seq=F.col("seq"), ask_id=F.col("seq"), room_id=F.col("b") * len(GUEST_KEYS) + F.col("rank"))
    none = asks.filter(F.lit(False))
    decided = decide_in_order(asks, none, group, ["seq", "ask_id"], seq_bucket(), Register, group_rows)
    return decided.filter(F.col("code") == "OK").select(F.col("ask_id").alias("seq"))


def customer_intake(t: Mapping, req: DataFrame, as_of, group_rows: int = GROUP_ROWS) -> State:
    """Register guests: form rules first, then phone, e-mail and card must be new, in arrival order.

    A refused guest does not use up the other keys it carries, so one refusal can let a later guest in. Most keys are settled
    for all guests at once (``_first_on_all``). What is left are guests who wait for each other in chains: those connected by shared keys form a
    component, components are independent, and each is walked in arrival order, a large one in slices.
    """
    judged = req.withColumn("form", form_code(as_of))
    stored = _guest_keys(t["customers"])
    keys = _guest_keys(judged.filter("form IS NULL"), "seq")
    clash = keys.join(stored, ["rank", "value"], "left_semi").select("seq").distinct()
    won, open_keys = _first_on_all(cut_lineage(keys.join(clash, "seq", "left_anti")))
    if not open_keys.isEmpty():
        won = won.unionByName(_chained(open_keys, group_rows))
    # the reported key of a refusal: the first one taken by a stored guest or an earlier accepted one
    held = stored.withColumn("since", F.lit(-1).cast("bigint")).unionByName(
        keys.join(won, "seq", "left_semi").select("rank", "value", F.col("seq").alias("since"))
    )
    held = held.groupBy("rank", "value").agg(F.min("since").alias("since"))
    broken = keys.join(held, ["rank", "value"]).filter("since < seq").groupBy("seq").agg(F.min("rank").alias("rank"))
    names = F.create_map(*[x for i, c in enumerate(GUEST_KEYS.values()) for x in (F.lit(i), F.lit(c))])
    judged = judged.join(broken, "seq", "left").withColumn("code", F.coalesce("form", names[F.col("rank")]))
    rows = accepted(judged).select("seq", "full_name", "phone_number", "email", "identity_card", "date_of_birth")
    rows = rows.withColumn("id", max_id(t["customers"]) + 1 + F.col("seq")).withColumn("created_at", timestamp(as_of))
    old = t["customers"]
    return {
        "results": judged.select(
            "seq", F.when(F.col("code").isNull(), max_id(t["customers"]) + 1 + F.col("seq")).alias("customer_id"),
            F.col("code").isNull().alias("accepted"), "code",
        ),
        "customers": append_rows(old, rows.select(*[c for c in old.columns if c in rows.columns])),
    }


def with_time_surcharges(t: Mapping, booking_ids: DataFrame, as_of) -> DataFrame:
    """Surcharges after the time surcharges of some bookings are worked out again; others keep theirs."""
    old = t["booking_surcharges"]
    rows = number_rows(time_surcharges(t, booking_ids), max_id(old), "booking_id", "detail_id", "policy_id")
    rows = rows.withColumn("created_at", timestamp(as_of))
    kept = without_time_surcharges(old, booking_ids)
    return append_rows(kept, rows.select(*[c for c in old.columns if c in rows.columns]))


def without_time_surcharges(surcharges: DataFrame, booking_ids: DataFrame) -> DataFrame:
    """Surcharges less the time surcharges of the given bookings."""
    renewed = booking_ids.select("booking_id").distinct().withColumn("_renewed", F.lit(True))
    stale = F.col("_renewed").isNotNull() & F.col("surcharge_type").isin(TIME_SURCHARGES)
    return surcharges.join(renewed, "booking_id", "left").filter(~stale).select(*surcharges.columns)


def finalize_bookings(t: Mapping, req: DataFrame, as_of) -> State:
    """Pending bookings become Active with their time surcharges and total."""
    judged = first_wins(with_booking(req, t, "status").withColumn("code", state_code(["Pending"])), ["booking_id"], BAD_STATE)
    won = accepted(judged).select("booking_id")
    surcharges = with_time_surcharges(t, won, as_of)
    totals = booking_total(patched(t, booking_surcharges=surcharges), won).select(F.col("booking_id").alias("id"), F.col("total_amount").alias("due"))
    bookings = update_from_join(
        t["bookings"], totals, ["id"], {"status": F.lit("Active"), "total_amount": F.col("due"), "updated_at": timestamp(as_of)}
    )
    return {
        "results": verdict(judged, "seq", "booking_id"),
        "bookings": bookings,
        "booking_surcharges": surcharges,
        "totals": totals.select(F.col("id").alias("booking_id"), F.col("due").alias("total_amount")),
    }


def release_bookings(t: Mapping, cancelled: DataFrame, as_of) -> State:
    """Effects of cancelling bookings (booking_id, reason): nights released, assignments cancelled, time stamped.

    A release only lowers counts, so summing all releases of a night and stopping at 0 once
    gives the same count as releasing one by one.
    """
    ids = cancelled.select(F.col("booking_id").alias("id"), "reason")
    stays = t["bookings"].join(ids, "id", "left_semi").select(F.col("id").alias("booking_id"), "check_in", "check_out")
    lines = t["booking_details"].select("booking_id", "room_type_id", "quantity").join(stays, "booking_id")
    mine = t["room_assignments"].filter(live()).join(stays.select("booking_id"), "booking_id", "left_semi").select("id")
    now = timestamp(as_of)
    stamped = F.coalesce(F.col("cancelled_at"), now) if "cancelled_at" in t["bookings"].columns else now
    why = F.coalesce(F.col("reason"), F.col("cancel_reason")) if "cancel_reason" in t["bookings"].columns else F.col("reason")
    return {
        "bookings": update_from_join(
            t["bookings"], ids, ["id"],
            {"status": F.lit("Cancelled"), "cancelled_at": stamped, "updated_at": now, "cancel_reason": why}
        ),
        "room_type_inventory": inventory_after(t["room_type_inventory"], lines, sign=-1),
        "room_assignments": update_from_join(t["room_assignments"], mine, ["id"], {"is_cancelled": F.lit(True)}),
    }


def cancel_bookings(t: Mapping, req: DataFrame, as_of) -> State:
    """Cancel Active bookings (seq, booking_id[, reason])."""
    judged = first_wins(with_booking(req, t, "status").withColumn("code", state_code(["Active"])), ["booking_id"], BAD_STATE)
    reason = F.col("reason") if "reason" in req.columns else F.lit(None).cast("string")
    state = release_bookings(t, accepted(judged).select("booking_id", reason.alias("reason")), as_of)
    return {"results": verdict(judged, "seq", "booking_id"), **state}


def totals_after_change(t: Mapping, changes: DataFrame) -> DataFrame:
    """New totals of the bookings touched by child changes (old_booking_id, new_booking_id; one may be null)."""
    both = F.array_compact(F.array("old_booking_id", "new_booking_id"))
    touched = changes.select(F.explode(both).alias("booking_id")).distinct()
    return booking_total(t, touched).select("booking_id", "total_amount")


def with_totals(bookings: DataFrame, totals: DataFrame, as_of) -> DataFrame:
    due = totals.select(F.col("booking_id").alias("id"), F.col("total_amount").alias("due"))
    return update_from_join(bookings, due, ["id"], {"total_amount": F.col("due"), "updated_at": timestamp(as_of)})


def add_services(t: Mapping, req: DataFrame, as_of) -> State:
    """Book services (seq, booking_id, service_id, quantity, staff_id) and renew the totals they change."""
    known = t["services"].select(F.col("id").alias("service_id"), F.lit(True).alias("known"))
    judged = with_booking(req, t).join(known, "service_id", "left").withColumn(
        "code",
        F.when(F.col("b_id").isNull() | F.col("known").isNull(), NOT_FOUND).when(F.coalesce(F.col("quantity"), F.lit(0)) <= 0, BAD_QUANTITY),
    )
    rows = accepted(judged).select("seq", "booking_id", "service_id", "quantity", "staff_id").withColumn("used_at", timestamp(as_of))
    old = t["service_usage"]
    if "id" in old.columns:
        rows = number_rows(rows, max_id(old), "seq")
    usage = append_rows(old, rows.select(*[c for c in old.columns if c in rows.columns]))
    touched = rows.select("booking_id").distinct()
    totals = booking_total(patched(t, service_usage=usage), touched).select("booking_id", "total_amount")
    return {
        "results": verdict(judged, "seq", "booking_id", "service_id"),
        "service_usage": usage,
        "bookings": with_totals(t["bookings"], totals, as_of),
        "totals": totals,
    }


def touch_updated(old: DataFrame, new: DataFrame, keys: list[str], as_of) -> DataFrame:
    """Set updated_at on the rows of ``new`` that differ from ``old`` in any other column; new rows keep theirs."""
    compared = [c for c in new.columns if c not in (*keys, "updated_at")]
    before = old.select(*keys, F.struct(*compared).alias("_before"))
    joined = new.join(before, keys, "left")
    changed = F.col("_before").isNotNull() & ~F.struct(*compared).eqNullSafe(F.col("_before"))
    stamped = F.when(changed, timestamp(as_of)).otherwise(F.col("updated_at"))
    return joined.select(*[stamped.alias(c) if c == "updated_at" else F.col(c) for c in new.columns])
