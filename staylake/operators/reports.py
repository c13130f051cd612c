"""Revenue, KPI and booking reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calc import BILLED_STATES, MONEY, as_date, in_period, live, money, month_of, nights, period_bounds, wide
from .billing import child_costs

REVENUE_PARTS = ["total_room_cost", "total_surcharges", "total_services"]


def _billed(t: Mapping, period, as_of) -> DataFrame:
    return t["bookings"].filter(F.col("status").isin(BILLED_STATES) & in_period("check_out", period, as_of)).withColumn("report_month", month_of("check_out"))


def monthly_revenue(t: Mapping, period="all", as_of=None, only: DataFrame | None = None) -> DataFrame:
    """Revenue per hotel and check-out month of billed bookings; ``only`` names wanted (hotel_id, report_month) pairs.

    A period filter reaches the booking scan as a range on check_out: a period is made
    of whole months, so the filter on the month and on the check-out agree.
    """
    b = _billed(t, period, as_of)
    if only is not None:
        b = b.join(only, ["hotel_id", "report_month"], "left_semi")
    billed = b.select(F.col("id").alias("booking_id"), "hotel_id", "report_month", nights().alias("nights"), "amount_paid")
    zero = F.lit(0).cast(MONEY)
    # within a period only the children of its bookings are read on; over all time the filter would cost more than it saves
    costs = child_costs(t, billed if only is not None or period_bounds(period, as_of) else None)
    rows = billed.join(costs, "booking_id", "left").select(
        "hotel_id",
        "report_month",
        "amount_paid",
        F.coalesce(F.col("night_cost") * F.col("nights"), zero).alias("room"),
        F.coalesce("surcharge_cost", zero).alias("surcharge"),
        F.coalesce("service_cost", zero).alias("service"),
    )
    sums = rows.groupBy("hotel_id", "report_month").agg(
        wide(F.sum("room")).alias("total_room_cost"),
        wide(F.sum("surcharge")).alias("total_surcharges"),
        wide(F.sum("service")).alias("total_services"),
        wide(F.sum("amount_paid")).alias("actual_collected"),
    )
    total = wide(F.expr("total_room_cost + total_surcharges + total_services"))
    return sums.select("hotel_id", "report_month", *REVENUE_PARTS, total.alias("total_revenue"), "actual_collected")


def latest_revenue_12(t: Mapping, as_of, period="all", n: int = 12) -> DataFrame:
    """The newest n rows of the revenue list. Which they are follows from the bookings alone, so only their bookings are billed."""
    newest = _billed(t, period, as_of).select("hotel_id", "report_month").distinct().orderBy(F.desc("report_month"), "hotel_id").limit(n)
    return monthly_revenue(t, period, as_of, newest).orderBy(F.desc("report_month"), "hotel_id")


def revenue_breakdown(t: Mapping, as_of, n_months: int = 6, period="all") -> DataFrame:
    """Sums and percent shares over the last rows of the revenue list; surcharges take the rounding rest."""
    last = latest_revenue_12(t, as_of, period).orderBy(F.desc("report_month"), F.desc("hotel_id")).limit(n_months)
    s = last.agg(*[wide(F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in REVENUE_PARTS])
    s = s.withColumn("overall", wide(F.expr("total_room_cost + total_surcharges + total_services")))

    def share(c: str):
        return F.round(F.col(c) * 100 / F.when(F.col("overall") > 0, F.col("overall")), 0).cast("int")

    s = s.withColumn("rooms_pct", share("total_room_cost")).withColumn("services_pct", share("total_services"))
    return s.withColumn("surcharges_pct", F.lit(100) - F.col("rooms_pct") - F.col("services_pct"))


def kpi_report(t: Mapping, as_of, period="all", room_type_id=None) -> DataFrame:
    """The one-row dashboard figures.

    Occupancy alone follows the room type filter. The three parts are reduced to one
    row each and stacked, so nothing is cross joined.
    """
    day = as_date(as_of)
    inv = t["room_type_inventory"].filter(in_period("date", period, as_of))
    if room_type_id:
        inv = inv.filter(F.col("room_type_id") == room_type_id)
    inv = inv.join(t["room_types"].select(F.col("id").alias("room_type_id")), "room_type_id", "left_semi")
    week = F.col("date").between(F.lit(day - timedelta(days=7)), F.lit(day))
    occupancy = inv.agg(
        F.sum("total_reserved").alias("res"),
        F.sum(F.when(week, F.col("total_reserved"))).alias("res_7d"),
        F.sum(F.when(week, F.col("total_inventory"))).alias("inv_7d"),
    )
    revenue = monthly_revenue(t, period, as_of).agg(
        F.sum("total_revenue").alias("revenue"), F.sum("actual_collected").alias("paid"), F.sum("total_room_cost").alias("room")
    )
    bookings = t["bookings"].filter(~F.col("status").isin("Cancelled", "Pending") & in_period("check_out", period, as_of))
    count = bookings.agg(F.count(F.lit(1)).alias("n"))
    parts = occupancy.unionByName(revenue, allowMissingColumns=True).unionByName(count, allowMissingColumns=True)
    names = ["res", "res_7d", "inv_7d", "revenue", "paid", "room", "n"]
    one = parts.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])

    def ratio(a, b, scale):
        q = F.round(a.cast("decimal(36,4)") / F.when(F.col(b) != 0, F.col(b)).cast("decimal(12,0)"), scale)
        return F.coalesce(q, F.lit(0)).cast(f"decimal(18,{scale})")

    return one.select(
        ratio(F.col("res_7d") * 100, "inv_7d", 1).alias("avg_occupancy_7d"),
        wide("revenue").alias("total_revenue"),
        wide("paid").alias("total_collected"),
        wide(F.col("revenue") - F.col("paid")).alias("total_outstanding"),
        ratio(F.col("room"), "res", 0).alias("adr"),
        F.col("n").cast("bigint").alias("bookings_count"),
    )


def booking_summary(t: Mapping) -> DataFrame:
    """One row per booking that has details, with its sorted distinct room type names."""
    types = t["room_types"].select(F.col("id").alias("room_type_id"), "type_name")
    names = (
        t["booking_details"]
        .join(types, "room_type_id")
        .groupBy("booking_id")
        .agg(F.array_join(F.array_sort(F.collect_set("type_name")), ", ").alias("room_types"))
    )
    b = t["bookings"].select(
        F.col("id").alias("booking_id"), "customer_id", nights().alias("nights"), "total_amount", "amount_paid",
        money(F.col("total_amount") - F.col("amount_paid")).alias("balance"),
    )
    guests = t["customers"].select(F.col("id").alias("customer_id"), F.col("full_name").alias("customer_name"))
    return (
        b.join(names, "booking_id")
        .join(guests, "customer_id")
        .select("booking_id", "customer_name", "room_types", "nights", "total_amount", "amount_paid", "balance")
    )


def booking_children(t: Mapping) -> DataFrame:
    """All children of bookings as flat rows: surcharges, live rooms, used services.

    Flat on purpose: a nested list would pull a booking's whole history into one row.
    """
    rooms = t["rooms"].select(F.col("id").alias("room_id"), "room_number")
    services = t["services"].select(F.col("id").alias("service_id"), "name", "unit_price")
    live = t["room_assignments"].filter(~F.coalesce("is_cancelled", F.lit(False)))
    none = F.lit(None).cast(MONEY)
    return (
        t["booking_surcharges"]
        .select("booking_id", F.lit("surcharge").alias("child"), F.col("surcharge_type").alias("label"), F.lit(1).alias("quantity"), money("amount").alias("amount"))
        .unionByName(
            live.join(rooms, "room_id").select(
                "booking_id", F.lit("room").alias("child"), F.col("room_number").alias("label"), F.lit(1).alias("quantity"), none.alias("amount")
            )
        )
        .unionByName(
            t["service_usage"].join(services, "service_id").select(
                "booking_id", F.lit("service").alias("child"), F.col("name").alias("label"), "quantity",
                money(F.col("quantity") * F.col("unit_price")).alias("amount"),
            )
        )
    )


def booking_details_nested(t: Mapping, most: int | None = None) -> DataFrame:
    """A row per booking with its children as sorted lists: surcharges, room_assignments, services, each beside its count.

    Lists hold every column of the child table, rooms also their number, services their name and price, and every child: a list is as
    long as its count. A caller who shows only the first ``most`` entries names their number; further ones are then cut before they are shuffled.
    """
    rooms = t["rooms"].select(F.col("id").alias("room_id"), "room_number")
    services = t["services"].select(F.col("id").alias("service_id"), F.col("name").alias("service_name"), "unit_price")
    children = {
        "surcharges": (t["booking_surcharges"], ["surcharge_type", "id"]),
        "room_assignments": (t["room_assignments"].filter(live()).join(rooms, "room_id"), ["check_in", "room_number", "id"]),
        "services": (t["service_usage"].join(services, "service_id"), ["service_id", "quantity", "id"]),
    }
    out = t["bookings"].select(F.col("id").alias("booking_id"))
    for name, (df, order) in children.items():
        order = [c for c in order if c in df.columns]
        entry = F.struct(*order, *[c for c in df.columns if c not in (*order, "booking_id")])
        count, listed = F.count(F.lit(1)).alias(f"n_{name}"), F.sort_array(F.collect_list(entry)).alias(name)
        if most is None:
            lists = df.groupBy("booking_id").agg(count, listed)
        else:
            first = df.withColumn("_n", F.row_number().over(Window.partitionBy("booking_id").orderBy(*order))).filter(F.col("_n") <= most)
            lists = df.groupBy("booking_id").agg(count).join(first.groupBy("booking_id").agg(listed), "booking_id")
        out = out.join(lists, "booking_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out.select("booking_id", *[c for n in children for c in (f"n_{n}", n)])


def booking_header(t: Mapping) -> DataFrame:
    """The booking detail head: summary plus guest identity and stay times."""
    b = t["bookings"].select(F.col("id").alias("booking_id"), "status", "check_in", "check_out", "customer_id")
    guests = t["customers"].select(
        F.col("id").alias("customer_id"), F.col("phone_number").alias("customer_phone"),
        F.col("identity_card").alias("id_number"), "date_of_birth",
    )
    return booking_summary(t).join(b, "booking_id").join(guests, "customer_id").drop("customer_id")


def rooms_expected_vs_assigned(t: Mapping) -> DataFrame:
    """Bookings with fewer live assignments than rooms asked for."""
    asked = t["booking_details"].groupBy("booking_id").agg(F.sum("quantity").alias("expected"))
    live = t["room_assignments"].filter(~F.coalesce("is_cancelled", F.lit(False)))
    placed = live.groupBy("booking_id").agg(F.count(F.lit(1)).alias("assigned"))
    both = asked.join(placed, "booking_id", "left").select(
        "booking_id", F.col("expected").cast("bigint").alias("expected"), F.coalesce("assigned", F.lit(0)).cast("bigint").alias("assigned")
    )
    return both.filter("assigned < expected")


def service_groups(t: Mapping) -> DataFrame:
    """Services listed under their category, each row with the size of its group."""
    keys = ["hotel_id", "category"]
    sizes = t["services"].groupBy(*keys).agg(F.count(F.lit(1)).alias("services_in_category"))
    return t["services"].join(sizes, keys).select(
        "hotel_id", "category", F.col("id").alias("service_id"), F.col("name").alias("service_name"), "unit_price", "services_in_category"
    )


def hotel_counts(t: Mapping) -> DataFrame:
    """Bookings, details and live assignments per hotel (the end-to-end check)."""
    b = t["bookings"].select(F.col("id").alias("booking_id"), "hotel_id")
    per = lambda df, name: df.groupBy("booking_id").agg(F.count(F.lit(1)).alias(name))
    live = t["room_assignments"].filter(~F.coalesce("is_cancelled", F.lit(False)))
    counts = (
        b.join(per(t["booking_details"], "d"), "booking_id", "left")
        .join(per(live, "a"), "booking_id", "left")
        .groupBy("hotel_id")
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.coalesce(F.sum("d"), F.lit(0)).alias("details"),
            F.coalesce(F.sum("a"), F.lit(0)).alias("live_assignments"),
        )
    )
    hotels = t["hotels"].select(F.col("id").alias("hotel_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return hotels.join(counts, "hotel_id", "left").select("hotel_id", zero("bookings"), zero("details"), zero("live_assignments"))


def e2e_counts(t: Mapping) -> DataFrame:
    """Per hotel name: hotels, guests who booked there, bookings, room lines, live assignments."""
    names = t["hotels"].select(F.col("id").alias("hotel_id"), F.col("name").alias("hotel_name"))
    guests = t["bookings"].select("hotel_id", "customer_id").join(names, "hotel_id").groupBy("hotel_name").agg(F.countDistinct("customer_id").alias("guests"))
    sums = hotel_counts(t).join(names, "hotel_id").groupBy("hotel_name").agg(
        F.count(F.lit(1)).alias("hotels"), *[F.sum(c).alias(c) for c in ("bookings", "details", "live_assignments")]
    )
    return sums.join(guests, "hotel_name", "left").withColumn("guests", F.coalesce("guests", F.lit(0)))
