"""DuckDB text of the derived booking tables, as common table expressions.

Each entry only refers to the given tables or to other entries; ``with_tables``
puts the needed ones in front of a query.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-02-15 13:00:00'"
DAY = "DATE '2024-02-15'"

TABLES: dict[str, str] = {
    "sizes": "SELECT (SELECT COUNT(*) FROM supplier) AS n_hotels, (SELECT COUNT(*) FROM orders) AS n_orders",
    "kinds": """SELECT * FROM (VALUES (0, 'Standard', 800000, 2), (1, 'Deluxe', 1200000, 2), (2, 'Suite', 2500000, 4))
        AS v(k, type_name, price, cap)""",
    "hotels": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "room_types": """SELECT s_suppkey * 3 + k AS id, s_suppkey AS hotel_id, type_name, CAST(price AS DECIMAL(10,2)) AS base_price,
        cap AS max_capacity FROM supplier, kinds""",
    "rooms": """SELECT rt.id * 5 + j AS id, rt.hotel_id, CAST((rt.id % 3 + 1) * 100 + j + 1 AS VARCHAR) AS room_number,
        rt.id AS room_type_id,
        CASE (rt.id * 5 + j) % 20 WHEN 0 THEN 'Maintenance' WHEN 1 THEN 'Dirty' WHEN 2 THEN 'Occupied' WHEN 3 THEN 'Occupied'
             ELSE 'Available' END AS status
        FROM room_types rt, (SELECT UNNEST([0, 1, 2, 3, 4]) AS j) WHERE j < 4 OR rt.type_name <> 'Suite'""",
    "customers": """SELECT c_custkey AS id, c_name AS full_name, '09' || LPAD(CAST(c_custkey AS VARCHAR), 8, '0') AS phone_number,
        'guest' || c_custkey || '@example.com' AS email,
        CASE WHEN c_custkey % 3 <> 0 THEN 'ID' || c_custkey END AS identity_card,
        DATE '1950-01-01' + CAST((c_custkey * 37) % 21000 AS INT) AS date_of_birth FROM customer""",
    "bookings_core": """SELECT id, hotel_id, customer_id,
        CASE phase WHEN 0 THEN 'Pending' WHEN 1 THEN 'Cancelled' WHEN 2 THEN 'Active' WHEN 3 THEN 'Active' WHEN 4 THEN 'Active'
             WHEN 5 THEN 'Checked-in' WHEN 6 THEN 'Checked-in' ELSE 'Completed' END AS status,
        'key-' || id AS idempotency_key, ci_date, co_date,
        CAST(ci_date AS TIMESTAMP) + to_hours(ci_hour) AS check_in,
        CAST(co_date AS TIMESTAMP) + to_hours(co_hour) AS check_out,
        GREATEST(co_date - ci_date, 1) AS nights, ci_hour, co_hour,
        CAST(DATE '2023-12-11' + CAST(id % 10 AS INT) AS TIMESTAMP) AS updated_at
        FROM (SELECT o_orderkey AS id, o_custkey AS customer_id, o_custkey % n_hotels AS hotel_id, (o_orderkey // 5) % 10 AS phase,
              DATE '2024-01-01' + CAST((o_orderkey * 7) % 120 AS INT) AS ci_date,
              DATE '2024-01-01' + CAST((o_orderkey * 7) % 120 + o_orderkey % 5 AS INT) AS co_date,
              CAST(6 + o_orderkey % 13 AS INT) AS ci_hour,
              CAST(CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 10 + o_orderkey % 9 END AS INT) AS co_hour
              FROM orders, sizes)""",
    "booking_details": """SELECT l.l_orderkey * 3 + l.k AS id, l.l_orderkey AS booking_id, b.hotel_id * 3 + l.k AS room_type_id,
        CAST(kinds.price AS DECIMAL(10,2)) AS agreed_price, CAST(LEAST(l.n, 2) AS INT) AS quantity, l.part % 2 = 0 AS is_breakfast_included
        FROM (SELECT l_orderkey, l_linenumber % 3 AS k, COUNT(*) AS n, MAX(l_partkey) AS part FROM lineitem GROUP BY ALL) l
        JOIN bookings_core b ON b.id = l.l_orderkey JOIN kinds ON kinds.k = l.k""",
    "policies": """SELECT * FROM (VALUES (1, 'EarlyCheckIn', 'Early check-in', 0.50, 21600, 50400),
        (2, 'LateCheckOut', 'Late check-out', 0.30, 43200, 64800)) AS v(id, policy_type, description, multiplier, start_sec, end_sec)""",
    "all_surcharges": """SELECT d.id * 2 + p.id - 1 AS id, d.booking_id, d.id AS detail_id, p.id AS policy_id, p.policy_type AS surcharge_type,
        CAST(d.agreed_price * p.multiplier * d.quantity AS DECIMAL(18,2)) AS amount, p.description, b.status
        FROM booking_details d JOIN bookings_core b ON b.id = d.booking_id
        JOIN policies p ON 3600 * (CASE p.id WHEN 1 THEN b.ci_hour ELSE b.co_hour END) BETWEEN p.start_sec AND p.end_sec""",
    "booking_surcharges": "SELECT * EXCLUDE (status) FROM all_surcharges WHERE status <> 'Pending'",
    "services": """SELECT p_partkey AS id, p_partkey % n_hotels AS hotel_id, p_name || ' ' || p_partkey AS name,
        CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, p_type AS category FROM part, sizes""",
    "service_usage": """SELECT l_orderkey AS booking_id, l_partkey AS service_id, CAST(l_quantity AS INT) % 3 + 1 AS quantity
        FROM lineitem""",
    "room_costs": "SELECT booking_id, SUM(agreed_price * quantity) AS night_cost FROM booking_details GROUP BY 1",
    "surcharge_costs": "SELECT booking_id, SUM(amount) AS cost FROM booking_surcharges GROUP BY 1",
    "service_costs": """SELECT u.booking_id, SUM(u.quantity * s.unit_price) AS cost
        FROM service_usage u JOIN services s ON s.id = u.service_id GROUP BY 1""",
    "totals": """SELECT b.id AS booking_id, CAST(COALESCE(r.night_cost * b.nights, 0) AS DECIMAL(18,2)) AS room_cost,
        CAST(COALESCE(x.cost, 0) AS DECIMAL(18,2)) AS surcharge_cost, CAST(COALESCE(v.cost, 0) AS DECIMAL(18,2)) AS service_cost
        FROM bookings_core b LEFT JOIN room_costs r ON r.booking_id = b.id
        LEFT JOIN surcharge_costs x ON x.booking_id = b.id LEFT JOIN service_costs v ON v.booking_id = b.id""",
    "bookings": """SELECT c.*, CAST(t.room_cost + t.surcharge_cost + t.service_cost AS DECIMAL(18,2)) AS total_amount,
        CAST((t.room_cost + t.surcharge_cost + t.service_cost) * CAST(c.id % 5 AS INT) * 0.25 AS DECIMAL(18,2)) AS amount_paid
        FROM bookings_core c JOIN totals t ON t.booking_id = c.id""",
    "held": """SELECT d.booking_id, d.room_type_id, d.quantity, b.status,
        CAST(UNNEST(generate_series(b.ci_date, b.co_date - 1, INTERVAL 1 DAY)) AS DATE) AS date
        FROM booking_details d JOIN bookings_core b ON b.id = d.booking_id""",
    "inventory_days": """SELECT id AS room_type_id, date, CASE WHEN type_name = 'Suite' THEN 4 ELSE 5 END AS total_inventory
        FROM room_types, (SELECT CAST(UNNEST(generate_series(DATE '2023-12-20', DATE '2024-05-20', INTERVAL 1 DAY)) AS DATE) AS date)
        WHERE (id + (date - DATE '2023-12-20')) % 97 <> 0""",
    "demand": """SELECT room_type_id, date, SUM(quantity) AS n FROM held WHERE status IN ('Pending', 'Active', 'Checked-in') GROUP BY ALL""",
    "room_type_inventory": """SELECT i.*, CAST(LEAST(COALESCE(n, 0), total_inventory) AS INT) AS total_reserved
        FROM inventory_days i LEFT JOIN demand USING (room_type_id, date)""",
    "inventory_open": """SELECT i.*, CAST(LEAST(COALESCE(n, 0), total_inventory) AS INT) AS total_reserved
        FROM inventory_days i LEFT JOIN (SELECT room_type_id, date, SUM(quantity) AS n FROM held
        WHERE status IN ('Active', 'Checked-in') GROUP BY ALL) o USING (room_type_id, date)""",
    "room_assignments": """SELECT d.id * 2 + u - 1 AS id, d.booking_id,
        d.room_type_id * 5 + (d.booking_id + u) % (CASE WHEN d.room_type_id % 3 = 2 THEN 4 ELSE 5 END) AS room_id,
        b.check_in, b.check_out, b.status = 'Cancelled' AS is_cancelled
        FROM booking_details d JOIN bookings_core b ON b.id = d.booking_id, (SELECT UNNEST([1, 2]) AS u) WHERE u <= d.quantity""",
    "invoices": """SELECT id, id AS booking_id, total_amount, amount_paid, CAST(total_amount - amount_paid AS DECIMAL(18,2)) AS balance,
        CASE WHEN amount_paid >= total_amount THEN 'Paid' ELSE 'Issued' END AS status
        FROM bookings WHERE status = 'Completed' AND id % 3 <> 0""",
    "payments": """SELECT event_id AS seq, event_id % (CASE WHEN event_id % 2 = 0 THEN n_orders // 20 ELSE n_orders END) AS booking_id, CAST(ROUND(value, 2) * 10000 AS DECIMAL(18,2)) AS amount
        FROM events, sizes""",
    "booking_requests": """SELECT id AS seq, 'r' || id AS request_id, hotel_id, customer_id, check_in,
        CASE WHEN id % 13 = 0 THEN check_in ELSE check_out END AS check_out, ci_date,
        CASE WHEN id % 13 = 0 THEN ci_date ELSE co_date END AS co_date,
        CASE WHEN id % 7 = 0 THEN 'key-' || (id + 5) WHEN id % 11 = 0 THEN idempotency_key ELSE 'req-' || (id // 2) END AS idempotency_key
        FROM bookings_core WHERE status = 'Pending'""",
    "booking_request_rooms": """SELECT r.request_id, d.room_type_id, 1 AS quantity, CASE n WHEN 1 THEN d.is_breakfast_included ELSE false END AS is_breakfast_included
        FROM booking_details d JOIN booking_requests r ON r.seq = d.booking_id, (SELECT UNNEST([1, 2]) AS n) WHERE n <= d.quantity""",
    "booking_request_services": """SELECT r.request_id, u.service_id, u.quantity FROM service_usage u
        JOIN booking_requests r ON r.seq = u.booking_id""",
    "room_moves": """SELECT id AS seq, booking_id, room_id AS from_room_id,
        CASE WHEN id % 7 = 0 THEN room_id + 5
             ELSE room_id - room_id % 5 + (room_id % 5 + 1) % (CASE WHEN (room_id // 5) % 3 = 2 THEN 4 ELSE 5 END) END AS to_room_id
        FROM room_assignments WHERE NOT is_cancelled""",
    "check_ins": """SELECT id AS seq, booking_id, CASE WHEN id % 7 = 0 THEN room_id + 1 ELSE room_id END AS room_id
        FROM room_assignments WHERE NOT is_cancelled""",
    "check_outs": "SELECT id AS seq, id AS booking_id FROM bookings_core WHERE status IN ('Checked-in', 'Completed')",
    "cancellations": "SELECT id AS seq, id AS booking_id FROM bookings_core WHERE status IN ('Active', 'Completed', 'Cancelled')",
    "finalizations": "SELECT id AS seq, id AS booking_id FROM bookings_core WHERE status IN ('Pending', 'Active')",
    "invoice_requests": "SELECT id AS seq, id AS booking_id FROM bookings_core WHERE status IN ('Pending', 'Checked-in', 'Completed')",
    "housekeeping": "SELECT id AS seq, CASE WHEN id % 7 = 0 THEN id + 1 ELSE id END AS room_id FROM rooms",
    "customer_requests": """SELECT id AS seq, CASE WHEN id % 19 = 0 THEN '  ' ELSE full_name END AS full_name,
        CASE WHEN id % 17 = 0 THEN '12345' WHEN id % 10 = 0 THEN phone_number ELSE '08' || LPAD(CAST(id // 2 AS VARCHAR), 8, '0') END AS phone_number,
        CASE WHEN id % 5 <> 0 THEN 'new' || (id // 3) || '@example.com' END AS email,
        CASE WHEN id % 4 = 0 THEN identity_card ELSE 'N' || id END AS identity_card,
        CASE WHEN id % 23 <> 0 THEN date_of_birth END AS date_of_birth FROM customers""",
    # shared intermediate results of the reports
    "occupancy": """SELECT rt.hotel_id, i.room_type_id, rt.type_name, i.date, i.total_inventory, i.total_reserved,
        CASE WHEN i.total_inventory = 0 THEN 0 ELSE CAST(ROUND(CAST(i.total_reserved * 100.0 / i.total_inventory AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))
        END AS occupancy_rate FROM room_type_inventory i JOIN room_types rt ON rt.id = i.room_type_id""",
    "billed": """SELECT b.*, t.room_cost, t.surcharge_cost, t.service_cost, CAST(DATE_TRUNC('month', b.co_date) AS DATE) AS report_month
        FROM bookings b JOIN totals t ON t.booking_id = b.id WHERE b.status IN ('Completed', 'Checked-in')""",
    "revenue": """SELECT hotel_id, report_month, CAST(SUM(room_cost) AS DECIMAL(38,2)) AS total_room_cost,
        CAST(SUM(surcharge_cost) AS DECIMAL(38,2)) AS total_surcharges, CAST(SUM(service_cost) AS DECIMAL(38,2)) AS total_services,
        CAST(SUM(room_cost + surcharge_cost + service_cost) AS DECIMAL(38,2)) AS total_revenue,
        CAST(SUM(amount_paid) AS DECIMAL(38,2)) AS actual_collected FROM billed GROUP BY ALL""",
    "live_rooms": "SELECT * FROM room_assignments WHERE NOT is_cancelled",
}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the entries that ``body`` needs, directly or not, in front of it."""
    texts = {**TABLES, **(extra or {})}
    ordered: list[str] = []

    def need(text: str, path: tuple = ()) -> None:
        for name in texts:
            if name not in ordered and name not in path and re.search(rf"(?<![\w.']){name}(?![\w'])", text):
                need(texts[name], (*path, name))
                if name not in ordered:
                    ordered.append(name)

    need(body)
    head = ",\n".join(f"{n} AS ({texts[n]})" for n in ordered)
    return f"WITH {head}\n{body}" if ordered else body


def with_recursive(body: str, extra: dict[str, str] | None = None) -> str:
    return with_tables(body, extra).replace("WITH ", "WITH RECURSIVE ", 1)
