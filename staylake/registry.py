"""Registered queries over the derived booking tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .functions.calc import nights
from .functions.windows import flag_first
from .operators import billing, calendar, changes, filters, occupancy, quality, reports
from .plans import admission, bookings, money as money_jobs, pipeline, rooms
from .plans.common import with_derived_keys
from .session import cut_lineage, measured_joins, run_folder
from .sources.adapter import AS_OF, booking_core, derived_tables, row_count, source, stored_tables
from .sources import versions
from .sources.tables import date_spine, literal_relation, scan_tables, write_snapshot
from .streaming import jobs as streams


def _on_tables(fn):
    return lambda spark, sf_dir: fn(derived_tables(spark, sf_dir))


def _core(fn):
    """For operators that read no money columns of bookings."""

    def run(spark, sf_dir):
        t = derived_tables(spark, sf_dir)
        return fn(t.replaced(bookings=t["bookings_core"]))

    return run


def _scan_bookings(t):
    return t["bookings"].select(
        "id", "hotel_id", "customer_id", "status", "idempotency_key", "check_in", "check_out", "total_amount", "amount_paid"
    )


def _literal(spark, sf_dir):
    t = derived_tables(spark, sf_dir)
    extra = literal_relation(spark, [("Standard", 10), ("Suite", 40)], "type_name string, extra int")
    return t["room_types"].join(F.broadcast(extra), "type_name").select(F.col("id").alias("room_type_id"), "extra")


def _date_spine(spark, sf_dir):
    """Every date between the first and the last order."""
    first, last = source(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    return date_spine(spark, first, last)


def _scan_tables(spark, sf_dir):
    """Room lines of a snapshot that was written and read back with the declared types."""
    path = f"{run_folder(spark)}/snapshots/{uuid.uuid4().hex}"
    write_snapshot(derived_tables(spark, sf_dir), ["booking_details"], path)
    return scan_tables(spark, path)["booking_details"].select("id", "booking_id", "room_type_id", F.col("agreed_price").cast("decimal(10,2)").alias("agreed_price"), "quantity")


def _demand_running(t):
    lines = billing.selection_merge(t["booking_request_rooms"]).join(
        t["booking_requests"].select("seq", "request_id", "check_in", "check_out"), "request_id"
    )
    return occupancy.demand_running(t, lines, t["inventory_open"])


def _breakfast(t):
    stays = t["booking_requests"].select("request_id", "check_in", "check_out")
    return billing.breakfast_surcharges(t["booking_request_rooms"].join(stays, "request_id"))


def _price_snapshot(t):
    asked = t["booking_details"].select(
        "id", "booking_id", "room_type_id",
        F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, 0)).otherwise(F.col("agreed_price") + 1).cast("decimal(10,2)").alias("agreed_price"),
    )
    return billing.price_snapshot(t, asked)


def _asked(t):
    lines = billing.selection_merge(t["booking_request_rooms"])
    return lines.join(t["booking_requests"].select("request_id", "hotel_id", "check_in", "check_out"), "request_id")


def _nested(t):
    """The nested lists as texts, an entry per line part, so that any engine can compare them."""
    def listed(name, *fields):
        entry = lambda e: F.concat_ws("|", *[e[f].cast("string") for f in fields])
        return F.coalesce(F.array_join(F.transform(name, entry), ","), F.lit("")).alias(name)

    return reports.booking_details_nested(t).select(
        "booking_id", "n_surcharges", listed("surcharges", "surcharge_type", "id", "amount"),
        "n_room_assignments", listed("room_assignments", "room_number", "id", "room_id"),
        "n_services", listed("services", "service_id", "quantity", "service_name", "unit_price"),
    )


def _derived_keys(t):
    """Every third request comes without a key."""
    asked = t["booking_requests"].withColumn("idempotency_key", F.expr("IF(seq % 3 = 0, NULL, idempotency_key)"))
    return with_derived_keys(asked, ["hotel_id", "customer_id", "seq"]).select("seq", "idempotency_key")


def _stored(fn):
    """For operators that read derived tables several times."""

    def run(spark, sf_dir):
        t = stored_tables(spark, sf_dir)
        return fn(t.replaced(bookings=t["bookings_core"]))

    return run


REPORTS = {
    "scan_bookings": _on_tables(_scan_bookings),
    "literal_relation": _literal,
    "date_spine": _date_spine,
    "scan_tables": _scan_tables,
    "build_inventory": _core(lambda t: occupancy.build_inventory(t, "2024-02-10", "2024-03-11")),
    "stay_nights": _core(billing.stay_nights),
    "booking_balance": _on_tables(billing.booking_balance),
    "service_search": _core(lambda t: filters.service_search(t, keyword="AR%1")),
    "service_search_hotel": _core(lambda t: filters.service_search(t, hotel_id=3)),
    "customer_lookup": _core(lambda t: filters.customer_lookup(t, t["customer_requests"].select("phone_number"))),
    "period_filter": _core(
        lambda t: filters.period_filter(t["bookings"], "check_out", "last_month", AS_OF).select(F.col("id").alias("booking_id"), "check_out")
    ),
    "status_filter": _core(
        lambda t: filters.status_filter(t["bookings"], drop=["Cancelled", "Pending"]).select(F.col("id").alias("booking_id"), "status")
    ),
    "occupancy_bucket": _core(occupancy.occupancy_levels),
    "early_arrival_flag": _core(filters.early_arrival_flag),
    "guest_form_check": _core(lambda t: filters.guest_form_check(t["customer_requests"], AS_OF).select("seq", "code", "accepted")),
    "daily_occupancy": _core(occupancy.daily_occupancy),
    "nightly_reserved": _core(occupancy.nightly_reserved),
    "rooms_available": _core(lambda t: occupancy.rooms_available(t, "2024-02-10", "2024-02-17")),
    "availability_min": _core(lambda t: occupancy.availability_min(t, "2024-02-10", "2024-02-17")),
    "latest_occupancy_100": _core(lambda t: occupancy.latest_occupancy_100(t, AS_OF)),
    "latest_occupancy_100_month": _core(lambda t: occupancy.latest_occupancy_100(t, AS_OF, "this_month", 5)),
    "heatmap_matrix": _core(lambda t: occupancy.heatmap_long(t, AS_OF)),
    "heatmap_matrix_type": _core(lambda t: occupancy.heatmap_long(t, AS_OF, room_type_id=5)),
    "demand_running": _core(_demand_running),
    "monthly_revenue": _on_tables(reports.monthly_revenue),
    "latest_revenue_12": _on_tables(lambda t: reports.latest_revenue_12(t, AS_OF)),
    "revenue_breakdown": _on_tables(lambda t: reports.revenue_breakdown(t, AS_OF)),
    "kpi_report": _on_tables(lambda t: reports.kpi_report(t, AS_OF)),
    "kpi_report_month": _on_tables(lambda t: reports.kpi_report(t, AS_OF, "this_month", 4)),
    "kpi_report_quarter": _on_tables(lambda t: reports.kpi_report(t, AS_OF, "this_quarter")),
    "booking_summary": _on_tables(reports.booking_summary),
    "booking_header": _on_tables(reports.booking_header),
    "booking_children": _core(reports.booking_children),
    "booking_children_nested": _core(_nested),
    "room_type_match": _core(lambda t: filters.room_type_match(t, t["room_moves"])),
    "derived_keys": _core(_derived_keys),
    "e2e_counts": _core(reports.e2e_counts),
    "heatmap_pivot": _core(lambda t: occupancy.heatmap_matrix(t, AS_OF)),
    "booking_total": _core(billing.booking_total),
    "time_surcharges": _core(billing.time_surcharges),
    "cost_split": _on_tables(billing.cost_split),
    "selection_merge": _core(lambda t: billing.selection_merge(t["booking_request_rooms"])),
    "breakfast_surcharges": _core(_breakfast),
    "price_snapshot": _core(_price_snapshot),
    "rooms_expected_vs_assigned": _core(reports.rooms_expected_vs_assigned),
    "service_groups": _core(reports.service_groups),
    "hotel_counts": _core(reports.hotel_counts),
    "room_status_now": _core(lambda t: calendar.room_status_now(t, AS_OF)),
    "calendar_full": _on_tables(calendar.calendar_full),
    "calendar_window": _core(lambda t: calendar.calendar_window(t, "2024-02-12", "2024-02-18")),
    "rooms_by_status": _core(calendar.rooms_by_status),
    "free_rooms": _stored(lambda t: calendar.free_rooms(t, _asked(t))),
    "first_free_room": _stored(lambda t: calendar.first_free_room(t, _asked(t))),
    "first_overlap_per_room": _core(calendar.first_overlap_per_room),
    "assignment_overlaps": _core(calendar.assignment_overlaps),
}



def _dirty(t):
    """The tables with faults planted, so the checks have something to find."""

    def put(name, **exprs):
        df = t[name]
        return df.withColumns({c: F.expr(e).cast(df.schema[c].dataType) for c, e in exprs.items()})

    return t.replaced(
        bookings=put(
            "bookings",
            customer_id="IF(id % 79 = 0, -1, customer_id)",
            status="IF(id % 97 = 0, 'Unknown', status)",
            idempotency_key="IF(id % 71 = 0, CONCAT('dup-', CAST(CAST(FLOOR(id / 500) AS BIGINT) AS STRING)), idempotency_key)",
            check_out="IF(id % 89 = 0, check_in, check_out)",
            total_amount="IF(id % 73 = 0, total_amount + 5, total_amount)",
            amount_paid="IF(id % 83 = 0, total_amount + 1, amount_paid)",
        ),
        services=put(
            "services", hotel_id="IF(id % 60 = 0, NULL, hotel_id)", unit_price="IF(id % 50 = 0, -1, unit_price)",
            category="IF(id % 70 = 0, REPEAT('x', 51), category)",
        ),
        invoices=put("invoices", balance="IF(id % 7 = 0, balance + 1, balance)"),
        booking_details=put("booking_details", quantity="IF(id % 77 = 0, 0, quantity)"),
        room_type_inventory=put("room_type_inventory", total_reserved="IF(room_type_id % 40 = 0, total_inventory + 1, total_reserved)"),
        customers=put(
            "customers", full_name="IF(id % 31 = 0, NULL, full_name)",
            phone_number="IF(id % 37 = 0, CONCAT('09', LPAD(CAST(id - 1 AS STRING), 8, '0')), phone_number)",
        ),
    )


def _check(fn):
    return lambda spark, sf_dir: fn(_dirty(stored_tables(spark, sf_dir)))


def _cascade(t):
    state = quality.cascade_delete(t, t["bookings"].filter("id % 10 = 3").select(F.col("id").alias("booking_id")))
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in state.items()]
    return reduce(DataFrame.unionByName, counts)


QUALITY = {
    "dq_checks": _check(quality.dq_checks),
    "dq_unique": _check(quality.dq_unique),
    "dq_foreign_keys": _check(quality.dq_foreign_keys),
    "dq_not_null": _check(quality.dq_not_null),
    "dq_enums": _check(quality.dq_enums),
    "dq_lengths": _check(quality.dq_lengths),
    "dq_adult": _check(lambda t: quality.dq_adult(t, AS_OF)),
    "dq_no_overlap": _check(quality.dq_no_overlap),
    "dq_inventory_drift": _check(quality.dq_inventory_drift),
    "inventory_drift": _core(quality.inventory_drift),
    "dq_total_drift": _check(quality.dq_total_drift),
    "integrity_report": _check(lambda t: quality.integrity_report(t, AS_OF)),
    "cascade_delete": _core(_cascade),
    "delete_blockers": _core(
        lambda t: quality.delete_blockers(t, "room_types", t["room_types"].filter("type_name = 'Suite'").select("id"))
    ),
}


def _job(fn, out="results", money_columns=True, joins=nullcontext):
    """Run a batch job on the derived tables and give one of its outputs; ``joins`` is what their tables are written under."""

    def run(spark, sf_dir):
        t = stored_tables(spark, sf_dir)
        if not money_columns:
            t = t.replaced(bookings=t["bookings_core"])
        with joins(spark):
            state = fn(t)
        return out(state) if callable(out) else state[out]

    return run


def _room_lines(t):
    """Pending bookings ask for their rooms again, on the inventory without them; some ask twice, some hold the type already."""
    pending = t["bookings"].filter("status = 'Pending'").select(F.col("id").alias("booking_id"))
    req = t["booking_details"].join(pending, "booking_id").selectExpr(
        "booking_id AS seq", "booking_id", "room_type_id", "IF(booking_id % 49 = 0, 0, quantity) AS quantity", "is_breakfast_included"
    )
    req = req.unionByName(req.filter("booking_id % 13 = 0"))
    stored = t["booking_details"].join(pending.filter("booking_id % 11 <> 0"), "booking_id", "left_anti")
    return t.replaced(room_type_inventory=t["inventory_open"], booking_details=stored), req


def _reserve(t):
    return admission.reserve_inventory(*_room_lines(t), AS_OF)


def _add_room_lines(t):
    return admission.add_room_lines(*_room_lines(t), AS_OF)


def _added_details(state):
    won = state["results"].filter("accepted").select("booking_id")
    price = F.col("agreed_price").cast("decimal(18,2)").alias("agreed_price")
    return state["booking_details"].join(won, "booking_id", "left_semi").select("booking_id", "room_type_id", price, "quantity")


def _without_pending_rooms(t):
    pending = t["bookings"].filter("status = 'Pending'").select(F.col("id").alias("booking_id"))
    return t.replaced(room_assignments=t["room_assignments"].join(pending, "booking_id", "left_anti"))


def _assign(t):
    req = t["finalizations"].join(t["bookings"].filter("status = 'Pending'").select("id"), F.col("booking_id") == F.col("id")).select("seq", "booking_id")
    return admission.assign_rooms_first_fit(_without_pending_rooms(t), req, AS_OF)


def _all_hotels(t):
    return t["hotels"].select(F.col("id").alias("hotel_id"))


def _spots(state):
    none = F.lit(None).cast("bigint")
    return state["placed"].unionByName(state["unplaced"].withColumn("room_id", none))


def _create(t):
    """Pending bookings come in again as requests, on tables without them."""
    fresh = _without_pending_rooms(t)
    known = t["bookings"].filter("status <> 'Pending'")
    kept = lambda n: t[n].join(known.select(F.col("id").alias("booking_id")), "booking_id", "left_semi")
    now = fresh.replaced(
        bookings=known, booking_details=kept("booking_details"), service_usage=kept("service_usage"), room_type_inventory=t["inventory_open"]
    )
    return pipeline.create_bookings(now, t["booking_requests"], t["booking_request_rooms"], t["booking_request_services"], AS_OF)


def _changed(name, *columns):
    return lambda state: state[name].select(*columns)


def _add_services(t):
    req = t["service_usage"].selectExpr(
        "booking_id AS seq", "booking_id", "IF(booking_id % 9 = 0, -service_id, service_id) AS service_id", "quantity", "CAST(1 AS BIGINT) AS staff_id"
    )
    return bookings.add_services(t, req, AS_OF)


def _totals_after_change(t):
    changes = t["service_usage"].selectExpr("IF(booking_id % 2 = 0, booking_id, NULL) AS old_booking_id", "IF(booking_id % 2 = 0, NULL, booking_id) AS new_booking_id")
    return bookings.totals_after_change(t, changes)


def _touch(t):
    rooms = t["rooms"].withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    new = rooms.withColumn("status", F.when(F.col("id") % 3 == 0, "Available").otherwise(F.col("status")))
    return bookings.touch_updated(rooms, new, ["id"], AS_OF).select("id", "status", "updated_at")


def _upsert(t):
    src = t["bookings"].filter("status IN ('Completed', 'Checked-in')").selectExpr(
        "id", "id AS booking_id", "total_amount", "amount_paid", "CAST(total_amount - amount_paid AS DECIMAL(18,2)) AS balance", "'Issued' AS status"
    )
    target = t["invoices"].withColumn("status", F.expr("IF(id % 5 = 1, 'Void', status)")).withColumn("amount_paid", F.lit(0).cast("decimal(18,2)"))
    cols = ["total_amount", "amount_paid", "balance", "status"]
    return changes.upsert_by_key(target, src, ["booking_id"], cols, "status <> 'Void'").select("id", "booking_id", *cols)


def _insert_if_absent(t):
    src = t["booking_requests"].select("seq", "idempotency_key", "customer_id")
    return changes.insert_if_absent(t["bookings"], src, ["idempotency_key"], "seq")


def _update_from_join(t):
    busy = t["room_assignments"].join(
        t["bookings"].filter("status = 'Active'").select(F.col("id").alias("booking_id")), "booking_id", "left_semi"
    ).select("id")
    return changes.update_from_join(t["room_assignments"], busy, ["id"], {"is_cancelled": F.lit(True)}).select("id", "booking_id", "room_id", "is_cancelled")


def _append(t):
    new = t["booking_requests"].select(F.col("seq").alias("id"), "hotel_id", "customer_id", F.lit("Pending").alias("status"))
    return changes.append_rows(t["bookings"].select("id", "hotel_id", "customer_id", "status", "check_in"), new)


def _versioned_payments(spark, sf_dir):
    """Invoices of the version that the payments make: only changed rows are handed on, only touched partitions written."""
    path, t = f"{run_folder(spark)}/versions/{uuid.uuid4().hex}", stored_tables(spark, sf_dir)
    base = versions.create_versions(spark, path, t, ["bookings", "invoices"])
    stored = versions.read_version(spark, path, base)
    state = money_jobs.apply_payments(t.replaced(**stored), t["payments"], AS_OF)
    changed = {n: state[f"changed_{n}"] for n in ("bookings", "invoices")}
    now = versions.commit(spark, path, base, changed, {"bookings": ["id"], "invoices": ["booking_id"]})
    return versions.read_version(spark, path, now)["invoices"].select("booking_id", "amount_paid", "balance", "status")


JOBS = {
    "versioned_payments": _versioned_payments,
    "append_rows": _core(_append),
    "upsert_by_key": _on_tables(_upsert),
    "insert_if_absent": _core(_insert_if_absent),
    "update_from_join": _core(_update_from_join),
    "delete_where": _core(lambda t: changes.delete_where(t["room_assignments"], F.col("is_cancelled")).select("id", "booking_id", "room_id")),
    "first_arrival": _core(lambda t: flag_first(t["booking_requests"], ["idempotency_key"], "seq").select("seq", "request_id", "idempotency_key", "is_first")),
    "booking_intake": _job(lambda t: bookings.booking_intake(t, t["booking_requests"], AS_OF), money_columns=False),
    "customer_intake": _job(lambda t: bookings.customer_intake(t, t["customer_requests"], AS_OF), money_columns=False),
    "reserve_inventory": _job(_reserve, money_columns=False),
    "reserve_inventory_nights": _job(_reserve, "room_type_inventory", money_columns=False),
    "add_room_lines": _job(_add_room_lines, _added_details, money_columns=False),
    "finalize_bookings": _job(lambda t: bookings.finalize_bookings(t, t["finalizations"], AS_OF), money_columns=False),
    "finalize_bookings_totals": _job(lambda t: bookings.finalize_bookings(t, t["finalizations"], AS_OF), "totals", money_columns=False),
    "finalize_with_repack": _job(
        lambda t: pipeline.finalize_with_repack(_without_pending_rooms(t), t["finalizations"], AS_OF), money_columns=False
    ),
    "assign_rooms_first_fit": _job(_assign, money_columns=False, joins=measured_joins),
    "defragment_rooms": _job(lambda t: admission.defragment_rooms(t, _all_hotels(t), AS_OF), _spots, money_columns=False),
    "pre_assign_rooms": _job(lambda t: admission.pre_assign_rooms(t, t["room_moves"], AS_OF), money_columns=False),
    "check_in_batch": _job(lambda t: rooms.check_in_batch(t, t["check_ins"], AS_OF), money_columns=False),
    "check_in_batch_rooms": _job(
        lambda t: rooms.check_in_batch(t, t["check_ins"], AS_OF), _changed("rooms", "id", "status"), money_columns=False
    ),
    "check_out_batch": _job(lambda t: rooms.check_out_batch(t, t["check_outs"], AS_OF)),
    "check_out_batch_assignments": _job(
        lambda t: rooms.check_out_batch(t, t["check_outs"], AS_OF), _changed("room_assignments", "id", "booking_id", "check_out")
    ),
    "check_out_batch_rooms": _job(lambda t: rooms.check_out_batch(t, t["check_outs"], AS_OF), _changed("rooms", "id", "status")),
    "housekeeping_batch": _job(lambda t: rooms.housekeeping_batch(t, t["housekeeping"], AS_OF), money_columns=False),
    "cancel_bookings": _job(lambda t: bookings.cancel_bookings(t, t["cancellations"], AS_OF), money_columns=False),
    "cancel_bookings_inventory": _job(
        lambda t: bookings.cancel_bookings(t, t["cancellations"], AS_OF), "room_type_inventory", money_columns=False
    ),
    "cancel_bookings_assignments": _job(
        lambda t: bookings.cancel_bookings(t, t["cancellations"], AS_OF),
        _changed("room_assignments", "id", "booking_id", "is_cancelled"), money_columns=False,
    ),
    "add_services": _job(_add_services, money_columns=False),
    "add_services_totals": _job(_add_services, "totals", money_columns=False),
    "issue_invoices": _job(
        lambda t: money_jobs.issue_invoices(t, t["invoice_requests"], AS_OF),
        _changed("invoices", "booking_id", "total_amount", "amount_paid", "balance", "status"),
    ),
    "apply_payments": _job(lambda t: money_jobs.apply_payments(t, t["payments"], AS_OF)),
    "apply_payments_invoices": _job(
        lambda t: money_jobs.apply_payments(t, t["payments"], AS_OF), _changed("invoices", "booking_id", "amount_paid", "balance", "status")
    ),
    "totals_after_change": _core(_totals_after_change),
    "touch_updated": _core(_touch),
    "create_booking_pipeline": _job(_create, money_columns=False, joins=measured_joins),
    "create_booking_pipeline_totals": _job(_create, "totals", money_columns=False, joins=measured_joins),
}


def _stream_dirs(spark, name):
    base = f"{run_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _stream_of(spark, sf_dir, name):
    """A given table as a stream of files."""
    schema = source(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _stream_totals(spark, sf_dir):
    """Every child row of every booking as a change, in files that come as several micro-batches."""
    out, checkpoint = _stream_dirs(spark, "totals")
    t = derived_tables(spark, sf_dir).wrapped(["booking_details"], cut_lineage)  # three steps read them
    usage = t["service_usage"].join(t["services"].select(F.col("id").alias("service_id"), "unit_price"), "service_id")
    rows = {
        streams.NIGHTS: t["bookings_core"].select(F.col("id").alias("booking_id"), nights().alias("amount")),
        streams.ROOM: t["booking_details"].select("booking_id", (F.col("agreed_price") * F.col("quantity")).alias("amount")),
        streams.SURCHARGE: t["booking_surcharges"].select("booking_id", "amount"),
        streams.SERVICE: usage.select("booking_id", (F.col("quantity") * F.col("unit_price")).alias("amount")),
    }
    feed = reduce(DataFrame.unionByName, [streams.child_changes(None, df, part) for part, df in rows.items()])
    path = f"{checkpoint}-feed"
    feed.repartition(64).write.parquet(path)
    changes = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 24).parquet(path)
    streams.stream_totals(changes, out, checkpoint).awaitTermination()
    named = t["booking_details"].select("booking_id").distinct()
    return streams.read_totals(spark, out).join(named, "booking_id", "left_semi")


def _stream_dedup(spark, sf_dir):
    out, checkpoint = _stream_dirs(spark, "dedup")
    orders = _stream_of(spark, sf_dir, "orders")
    asked = orders.selectExpr(
        "CONCAT('req-', CAST(CAST(FLOOR(o_orderkey / 3) AS BIGINT) AS STRING)) AS idempotency_key",
        "TIMESTAMP '2024-01-01 00:00:00' + MAKE_DT_INTERVAL(0, 0, 0, o_orderkey % 1000) AS arrived_at",
    )
    streams.stream_intake_dedup(asked, out, checkpoint).awaitTermination()
    return spark.read.schema("idempotency_key string").parquet(out)


def _stream_occupancy(spark, sf_dir):
    """Every booking reserves; cancelled and completed ones release again."""
    out, checkpoint = _stream_dirs(spark, "occupancy")
    t = derived_tables(spark, sf_dir)
    lines = t["booking_details"].select("booking_id", "room_type_id", "quantity")
    b = booking_core(_stream_of(spark, sf_dir, "orders"), row_count(spark, sf_dir, "supplier"))
    ops = F.when(F.col("status").isin("Cancelled", "Completed"), F.array(F.lit("reserve"), F.lit("release"))).otherwise(F.array(F.lit("reserve")))
    booked = (F.to_date("check_in") - 30).cast("timestamp_ntz").alias("at")
    feed = b.select(F.col("id").alias("booking_id"), "check_in", "check_out", booked, F.explode(ops).alias("op")).join(lines, "booking_id")
    streams.stream_occupancy(feed, out, checkpoint).awaitTermination()
    return streams.read_occupancy(spark, out)


STREAMS = {"stream_totals": _stream_totals, "stream_intake_dedup": _stream_dedup, "stream_occupancy": _stream_occupancy}

QUERIES = {**REPORTS, **QUALITY, **JOBS, **STREAMS}
