"""Checking SQL of the batch jobs and streams. Order-dependent jobs are walked by recursive queries."""

from __future__ import annotations

from .ctes import AS_OF, DAY, with_recursive as rec, with_tables as q

D2 = "DECIMAL(18,2)"

INTAKE = {
    "known": "SELECT id, status, idempotency_key FROM bookings_core",
    "intake_1": """SELECT r.*, k.id AS known_id, CASE WHEN r.check_out <= r.check_in THEN 'INVALID_PERIOD'
        WHEN k.id IS NOT NULL AND k.status <> 'Pending' THEN 'DUPLICATE' END AS code_1
        FROM booking_requests r LEFT JOIN known k ON k.idempotency_key = r.idempotency_key""",
    "intake_2": """SELECT *, COALESCE(code_1, CASE WHEN ROW_NUMBER() OVER (PARTITION BY idempotency_key, code_1 IS NULL ORDER BY seq) > 1 THEN 'DUPLICATE' END) AS code
        FROM intake_1""",
    "intake": """SELECT seq, request_id, hotel_id, check_in, check_out, ci_date, co_date,
        CASE WHEN code IS NULL THEN COALESCE(known_id, (SELECT MAX(id) FROM known) + 1 + seq) END AS booking_id,
        code IS NULL AND known_id IS NOT NULL AS resumed, code FROM intake_2""",
}
FRESH = {**INTAKE, "known": "SELECT id, status, idempotency_key FROM bookings_core WHERE status <> 'Pending'"}

GUESTS = {
    "guest_form": f"""SELECT ROW_NUMBER() OVER (ORDER BY seq) AS pos, *, CASE WHEN LENGTH(TRIM(full_name)) = 0 THEN 'INVALID_NAME'
        WHEN NOT regexp_full_match(TRIM(phone_number), '[0-9]{{9,11}}') THEN 'INVALID_PHONE' WHEN date_of_birth IS NULL THEN 'DOB_REQUIRED'
        WHEN date_diff('year', date_of_birth, {DAY}) - CAST(strftime(date_of_birth, '%m%d') > strftime({DAY}, '%m%d') AS INT) < 18 THEN 'UNDERAGE' END AS form,
        phone_number IN (SELECT phone_number FROM customers) AS old_phone, email IN (SELECT email FROM customers) AS old_mail,
        identity_card IN (SELECT identity_card FROM customers WHERE identity_card IS NOT NULL) AS old_card FROM customer_requests""",
    "guest_walk": """SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS phones, CAST([] AS VARCHAR[]) AS mails, CAST([] AS VARCHAR[]) AS cards, CAST(NULL AS VARCHAR) AS code
        UNION ALL SELECT g.pos, CASE WHEN c IS NULL THEN list_append(phones, phone_number) ELSE phones END,
        CASE WHEN c IS NULL AND email IS NOT NULL THEN list_append(mails, email) ELSE mails END,
        CASE WHEN c IS NULL AND identity_card IS NOT NULL THEN list_append(cards, identity_card) ELSE cards END, c
        FROM (SELECT w.phones, w.mails, w.cards, g.*, COALESCE(g.form, CASE WHEN g.old_phone OR list_contains(w.phones, g.phone_number) THEN 'DUPLICATE_PHONE'
              WHEN g.old_mail OR list_contains(w.mails, g.email) THEN 'DUPLICATE_EMAIL' WHEN g.old_card OR list_contains(w.cards, g.identity_card) THEN 'DUPLICATE_IDENTITY' END) AS c
              FROM guest_walk w JOIN guest_form g ON g.pos = w.pos + 1) g""",
}

# reserving nights: one walk per hotel over the Pending bookings that are not impossible from the start
RESERVE = {
    "ask_lines": """SELECT b.id AS ask, b.hotel_id, d.room_type_id, CASE WHEN b.id % 49 = 0 THEN 0 ELSE d.quantity END AS quantity, b.ci_date, b.co_date
        FROM booking_details d JOIN bookings_core b ON b.id = d.booking_id WHERE b.status = 'Pending'""",
    "ask_nights": """SELECT n.ask, n.hotel_id, n.room_type_id, n.quantity, n.date, i.total_inventory - i.total_reserved AS free
        FROM (SELECT *, CAST(UNNEST(generate_series(ci_date, co_date - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM ask_lines WHERE quantity > 0 AND ask % 11 <> 0 AND ask % 13 <> 0) n
        LEFT JOIN inventory_open i ON i.room_type_id = n.room_type_id AND i.date = n.date""",
    "ask_fixed": """SELECT ask, CASE WHEN ARG_MIN(COALESCE(free, -1), (room_type_id, date)) = -1 THEN 'MISSING_INVENTORY' ELSE 'OVERBOOKING' END AS code
        FROM ask_nights WHERE free IS NULL OR free < quantity GROUP BY ask""",
    "ask_order": """SELECT hotel_id, ask, ROW_NUMBER() OVER (PARTITION BY hotel_id ORDER BY ask) AS pos,
        LIST({'t': room_type_id, 'd': date, 'n': quantity, 'free': free}) AS cells
        FROM ask_nights WHERE ask NOT IN (SELECT ask FROM ask_fixed) GROUP BY hotel_id, ask""",
    "ask_walk": """SELECT DISTINCT hotel_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS ask, list_slice(cells, 1, 0) AS used, false AS ok
        FROM ask_order WHERE pos = 1
        UNION ALL SELECT hotel_id, pos, ask, CASE WHEN ok THEN list_concat(used, cells) ELSE used END, ok FROM (
            SELECT o.hotel_id, o.pos, o.ask, o.cells, w.used, len(list_filter(o.cells, lambda c:
                c.free - COALESCE(list_sum(list_transform(list_filter(w.used, lambda x: x.t = c.t AND x.d = c.d), lambda x: x.n)), 0) < c.n)) = 0 AS ok
            FROM ask_walk w JOIN ask_order o ON o.hotel_id = w.hotel_id AND o.pos = w.pos + 1)""",
    "reserved_asks": """SELECT a.ask, CASE WHEN MIN(a.quantity) <= 0 THEN 'INVALID_QUANTITY' WHEN a.ask % 11 = 0 OR a.ask % 13 = 0 THEN 'DUPLICATE' ELSE ANY_VALUE(COALESCE(f.code, CASE WHEN w.ok = false THEN 'OVERBOOKING' END)) END AS code
        FROM ask_lines a LEFT JOIN ask_fixed f ON f.ask = a.ask LEFT JOIN ask_walk w ON w.ask = a.ask GROUP BY a.ask""",
}

# first-fit of single units per room type; `units` and `pinned` differ between the jobs
PACK = {
    "units": """SELECT d.booking_id, d.room_type_id, CAST(u AS INT) AS unit, b.check_in AS s, b.check_out AS e,
        ROW_NUMBER() OVER (PARTITION BY d.room_type_id ORDER BY b.check_in, d.booking_id, u) AS pos
        FROM booking_details d JOIN bookings_core b ON b.id = d.booking_id, (SELECT UNNEST([1, 2]) AS u)
        WHERE u <= d.quantity AND b.status IN (packed_states)""",
    "room_lists": "SELECT room_type_id, LIST(id ORDER BY room_number, id) AS ids FROM rooms GROUP BY 1",
    "pinned": """SELECT r.room_type_id, LIST({'r': a.room_id, 's': a.check_in, 'e': a.check_out}) AS spans
        FROM live_rooms a JOIN rooms r ON r.id = a.room_id JOIN bookings_core b ON b.id = a.booking_id WHERE b.status IN (pinned_states) GROUP BY 1""",
    "packed": """SELECT l.room_type_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS booking_id, CAST(NULL AS INT) AS unit, CAST(NULL AS BIGINT) AS room_id,
        COALESCE(p.spans, CAST([] AS STRUCT(r BIGINT, s TIMESTAMP, e TIMESTAMP)[])) AS taken FROM room_lists l LEFT JOIN pinned p ON p.room_type_id = l.room_type_id
        UNION ALL SELECT room_type_id, pos, booking_id, unit, spot, CASE WHEN spot IS NULL THEN taken ELSE list_append(taken, {'r': spot, 's': s, 'e': e}) END
        FROM (SELECT n.*, w.taken, list_filter(l.ids, lambda i: len(list_filter(w.taken, lambda x: x.r = i AND x.s < n.e AND n.s < x.e)) = 0)[1] AS spot
              FROM packed w JOIN units n ON n.room_type_id = w.room_type_id AND n.pos = w.pos + 1 JOIN room_lists l ON l.room_type_id = n.room_type_id)""",
}


def _pack(packed_states: str, pinned_states: str) -> dict:
    return {k: v.replace("packed_states", packed_states).replace("pinned_states", pinned_states) for k, v in PACK.items()}


# whole asks with all rooms or none: a walk over units per hotel, settled when the next ask begins
ADMIT = {
    "steps": """SELECT a.hotel_id, a.ask, a.room_type_id, u, a.s, a.e, a.cells,
        ROW_NUMBER() OVER (PARTITION BY a.hotel_id ORDER BY a.seq, a.room_type_id, u) AS pos,
        ROW_NUMBER() OVER (PARTITION BY a.ask ORDER BY a.room_type_id, u) = 1 AS opens
        FROM wanted_lines a, (SELECT UNNEST([1, 2]) AS u) WHERE u <= a.quantity""",
    "room_lists": "SELECT room_type_id, LIST(id ORDER BY room_number, id) AS ids FROM rooms GROUP BY 1",
    "hotel_pinned": """SELECT r.hotel_id, LIST({'r': a.room_id, 's': a.check_in, 'e': a.check_out}) AS spans
        FROM live_rooms a JOIN rooms r ON r.id = a.room_id JOIN bookings_core b ON b.id = a.booking_id WHERE b.status <> 'Pending' GROUP BY 1""",
    "walk": """SELECT h.id AS hotel_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS ask, COALESCE(p.spans, CAST([] AS STRUCT(r BIGINT, s TIMESTAMP, e TIMESTAMP)[])) AS taken,
        CAST([] AS STRUCT(r BIGINT, s TIMESTAMP, e TIMESTAMP)[]) AS open_spans, CAST([] AS STRUCT(t BIGINT, d DATE, n INT, free INT)[]) AS used,
        CAST([] AS STRUCT(t BIGINT, d DATE, n INT, free INT)[]) AS open_cells, CAST('skip' AS VARCHAR) AS code
        FROM hotels h LEFT JOIN hotel_pinned p ON p.hotel_id = h.id
        UNION ALL SELECT hotel_id, pos, ask, taken_2, CASE WHEN code_2 IS NULL AND spot IS NOT NULL THEN list_append(spans_2, {'r': spot, 's': s, 'e': e}) ELSE spans_2 END,
            used_2, cells, COALESCE(code_2, CASE WHEN spot IS NULL THEN 'ROOM_ASSIGN_FAILED' END)
        FROM (SELECT m.*, CASE WHEN m.opens THEN m.shortage ELSE m.code END AS code_2,
                list_filter(l.ids, lambda i: len(list_filter(list_concat(m.taken_2, m.spans_2), lambda x: x.r = i AND x.s < m.e AND m.s < x.e)) = 0)[1] AS spot
            FROM (SELECT k.*, list_filter(list_sort(list_transform(k.cells, lambda c: {'t': c.t, 'd': c.d, 'bad': CASE WHEN c.free IS NULL THEN 'MISSING_INVENTORY'
                    WHEN c.free - COALESCE(list_sum(list_transform(list_filter(k.used_2, lambda x: x.t = c.t AND x.d = c.d), lambda x: x.n)), 0) < c.n THEN 'OVERBOOKING' END})),
                    lambda c: c.bad IS NOT NULL)[1].bad AS shortage
                FROM (SELECT n.*, w.code,
                        CASE WHEN n.opens AND w.code IS NULL THEN list_concat(w.taken, w.open_spans) ELSE w.taken END AS taken_2,
                        CASE WHEN n.opens AND w.code IS NULL THEN list_concat(w.used, w.open_cells) ELSE w.used END AS used_2,
                        CASE WHEN n.opens THEN list_slice(w.open_spans, 1, 0) ELSE w.open_spans END AS spans_2
                    FROM walk w JOIN steps n ON n.hotel_id = w.hotel_id AND n.pos = w.pos + 1) k) m
            JOIN room_lists l ON l.room_type_id = m.room_type_id)""",
    "ask_codes": "SELECT ask, ARG_MAX(COALESCE(code, 'OK'), pos) AS code FROM walk WHERE ask IS NOT NULL GROUP BY ask",
}
ASSIGN = {
    **ADMIT,
    "wanted_lines": """SELECT b.id AS ask, b.id AS seq, b.hotel_id, d.room_type_id, d.quantity, b.check_in AS s, b.check_out AS e,
        CAST([] AS STRUCT(t BIGINT, d DATE, n INT, free INT)[]) AS cells
        FROM booking_details d JOIN bookings_core b ON b.id = d.booking_id WHERE b.status = 'Pending'""",
}
CREATE = {
    **FRESH,
    **ADMIT,
    "merged": """SELECT n.booking_id, n.seq, n.hotel_id, n.check_in, n.check_out, n.ci_date, n.co_date, l.room_type_id, CAST(SUM(l.quantity) AS INT) AS quantity
        FROM intake n JOIN booking_request_rooms l ON l.request_id = n.request_id WHERE n.code IS NULL GROUP BY ALL""",
    "merged_nights": """SELECT n.booking_id, LIST({'t': n.room_type_id, 'd': n.date, 'n': n.quantity, 'free': CAST(i.total_inventory - i.total_reserved AS INT)}) AS cells
        FROM (SELECT *, CAST(UNNEST(generate_series(ci_date, co_date - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM merged) n
        LEFT JOIN inventory_open i ON i.room_type_id = n.room_type_id AND i.date = n.date GROUP BY 1""",
    "wanted_lines": """SELECT m.booking_id AS ask, m.seq, m.hotel_id, m.room_type_id, m.quantity, m.check_in AS s, m.check_out AS e,
        COALESCE(c.cells, CAST([] AS STRUCT(t BIGINT, d DATE, n INT, free INT)[])) AS cells FROM merged m LEFT JOIN merged_nights c ON c.booking_id = m.booking_id""",
    "created": """SELECT n.seq, n.request_id, n.booking_id, n.ci_date, n.co_date, COALESCE(n.code, CASE WHEN a.code <> 'OK' THEN a.code END) AS code
        FROM intake n LEFT JOIN ask_codes a ON a.ask = n.booking_id""",
}

MOVES = {
    "judged_moves": """SELECT m.seq, m.booking_id, m.from_room_id, m.to_room_id, b.check_in AS s, b.check_out AS e,
        CASE WHEN b.id IS NULL THEN 'NOT_FOUND' WHEN b.status <> 'Active' THEN 'BOOKING_STATE_INVALID'
             WHEN d.id IS NULL THEN 'ROOM_TYPE_MISMATCH'
             WHEN EXISTS (SELECT 1 FROM live_rooms a WHERE a.room_id = m.to_room_id AND a.check_in < b.check_out AND b.check_in < a.check_out
                  AND NOT (a.booking_id = m.booking_id AND a.room_id IS NOT DISTINCT FROM m.from_room_id)) THEN 'ROOM_OVERLAP' END AS code
        FROM room_moves m LEFT JOIN bookings_core b ON b.id = m.booking_id LEFT JOIN rooms r ON r.id = m.to_room_id
        LEFT JOIN booking_details d ON d.booking_id = m.booking_id AND d.room_type_id = r.room_type_id""",
    "move_order": "SELECT *, ROW_NUMBER() OVER (PARTITION BY to_room_id ORDER BY seq) AS pos FROM judged_moves WHERE code IS NULL",
    "move_walk": """SELECT to_room_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS seq, false AS ok, CAST([] AS STRUCT(s TIMESTAMP, e TIMESTAMP)[]) AS taken FROM move_order WHERE pos = 1
        UNION ALL SELECT to_room_id, pos, seq, ok, CASE WHEN ok THEN list_append(taken, {'s': s, 'e': e}) ELSE taken END
        FROM (SELECT o.*, w.taken, len(list_filter(w.taken, lambda x: x.s < o.e AND o.s < x.e)) = 0 AS ok
              FROM move_walk w JOIN move_order o ON o.to_room_id = w.to_room_id AND o.pos = w.pos + 1)""",
}

CHECK_IN = {
    "ci_1": """SELECT c.*, b.check_in, b.check_out, a.room_id IS NOT NULL AS assigned, CASE WHEN b.id IS NULL THEN 'NOT_FOUND'
        WHEN b.status NOT IN ('Active', 'Checked-in') THEN 'BOOKING_STATE_INVALID' WHEN r.status IS DISTINCT FROM 'Available' THEN 'ROOM_NOT_AVAILABLE' END AS guard
        FROM check_ins c LEFT JOIN bookings_core b ON b.id = c.booking_id LEFT JOIN rooms r ON r.id = c.room_id
        LEFT JOIN (SELECT DISTINCT booking_id, room_id FROM live_rooms) a ON a.booking_id = c.booking_id AND a.room_id = c.room_id""",
    "ci_2": """SELECT *, COALESCE(guard, CASE WHEN NOT assigned AND EXISTS (SELECT 1 FROM live_rooms a WHERE a.room_id = c.room_id
        AND a.check_in < c.check_out AND c.check_in < a.check_out) THEN 'ROOM_OVERLAP' END) AS fixed FROM ci_1 c""",
    "ci_3": """SELECT c.seq, c.booking_id, c.room_id, CASE WHEN c.guard IS NULL AND c.seq > g.seq THEN 'ROOM_NOT_AVAILABLE' ELSE c.fixed END AS code
        FROM ci_2 c LEFT JOIN (SELECT room_id, MIN(seq) AS seq FROM ci_2 WHERE fixed IS NULL GROUP BY 1) g ON g.room_id = c.room_id""",
}
CHECK_OUT = {
    "co": f"""SELECT o.seq, o.booking_id, CASE WHEN b.status <> 'Checked-in' THEN 'BOOKING_STATE_INVALID'
        WHEN EXISTS (SELECT 1 FROM live_rooms a WHERE a.booking_id = o.booking_id AND a.check_out > {AS_OF} AND a.check_in >= {AS_OF}) THEN 'ASSIGNMENT_PERIOD' END AS code
        FROM check_outs o JOIN bookings_core b ON b.id = o.booking_id""",
}
PAY = {
    "pay_1": """SELECT p.*, CASE WHEN NOT p.amount > 0 THEN 'INVALID_AMOUNT' WHEN b.id IS NULL THEN 'NOT_FOUND'
        WHEN b.status NOT IN ('Active', 'Checked-in', 'Completed') THEN 'BOOKING_STATE_INVALID' END AS guard, b.total_amount - b.amount_paid AS rest
        FROM payments p LEFT JOIN bookings b ON b.id = p.booking_id""",
    "pay_order": "SELECT *, ROW_NUMBER() OVER (PARTITION BY booking_id ORDER BY seq) AS pos FROM pay_1 WHERE guard IS NULL",
    "pay_walk": f"""SELECT booking_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS seq, false AS ok, CAST(rest AS {D2}) AS rest FROM pay_order WHERE pos = 1
        UNION ALL SELECT o.booking_id, o.pos, o.seq, o.amount <= w.rest, CAST(CASE WHEN o.amount <= w.rest THEN w.rest - o.amount ELSE w.rest END AS {D2})
        FROM pay_walk w JOIN pay_order o ON o.booking_id = w.booking_id AND o.pos = w.pos + 1""",
    "paid": """SELECT p.seq, p.booking_id, p.amount, COALESCE(p.guard, CASE WHEN NOT w.ok THEN 'OVERPAYMENT' END) AS code
        FROM pay_1 p LEFT JOIN pay_walk w ON w.seq = p.seq""",
}
CANCEL = {
    "ca": """SELECT c.seq, c.booking_id, CASE WHEN b.status <> 'Active' THEN 'BOOKING_STATE_INVALID' END AS code
        FROM cancellations c JOIN bookings_core b ON b.id = c.booking_id""",
    "freed": "SELECT room_type_id, date, SUM(quantity) AS n FROM held WHERE status = 'Active' GROUP BY ALL",
}
SERVICES = {
    "wanted_services": "SELECT booking_id, CASE WHEN booking_id % 9 = 0 THEN -service_id ELSE service_id END AS service_id, quantity FROM service_usage",
    "added": "SELECT booking_id, SUM(w.quantity * s.unit_price) AS n FROM wanted_services w JOIN services s ON s.id = w.service_id GROUP BY 1",
}
RESULT = "code IS NULL AS accepted, code"

SQL: dict[str, str] = {
    "append_rows": q("""SELECT id, hotel_id, customer_id, status, check_in FROM bookings_core
        UNION ALL SELECT seq, hotel_id, customer_id, 'Pending', NULL FROM booking_requests"""),
    "upsert_by_key": q(f"""SELECT COALESCE(i.id, b.id) AS id, b.id AS booking_id, CASE WHEN i.id % 5 = 1 THEN i.total_amount ELSE b.total_amount END AS total_amount,
        CASE WHEN i.id % 5 = 1 THEN CAST(0 AS {D2}) ELSE b.amount_paid END AS amount_paid,
        CASE WHEN i.id % 5 = 1 THEN i.balance ELSE CAST(b.total_amount - b.amount_paid AS {D2}) END AS balance,
        CASE WHEN i.id % 5 = 1 THEN 'Void' ELSE 'Issued' END AS status
        FROM bookings b LEFT JOIN invoices i ON i.booking_id = b.id WHERE b.status IN ('Completed', 'Checked-in')"""),
    "insert_if_absent": q("""SELECT seq, idempotency_key, customer_id FROM booking_requests r
        WHERE NOT EXISTS (SELECT 1 FROM bookings_core b WHERE b.idempotency_key = r.idempotency_key)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY idempotency_key ORDER BY seq) = 1"""),
    "update_from_join": q("""SELECT a.id, a.booking_id, a.room_id, b.status = 'Active' OR a.is_cancelled AS is_cancelled
        FROM room_assignments a JOIN bookings_core b ON b.id = a.booking_id"""),
    "delete_where": q("SELECT id, booking_id, room_id FROM live_rooms"),
    "first_arrival": q("""SELECT seq, request_id, idempotency_key, ROW_NUMBER() OVER (PARTITION BY idempotency_key ORDER BY seq) = 1 AS is_first FROM booking_requests"""),
    "booking_intake": q(f"SELECT seq, request_id, booking_id, resumed, {RESULT} FROM intake", INTAKE),
    "customer_intake": rec(
        f"SELECT g.seq, CASE WHEN w.code IS NULL THEN (SELECT MAX(id) FROM customers) + 1 + g.seq END AS customer_id, w.code IS NULL AS accepted, w.code AS code FROM guest_form g JOIN guest_walk w ON w.pos = g.pos", GUESTS
    ),
    "reserve_inventory": rec(f"SELECT ask AS seq, ask AS booking_id, {RESULT} FROM reserved_asks", RESERVE),
    "reserve_inventory_nights": rec("""SELECT i.room_type_id, i.date, i.total_inventory, CAST(i.total_reserved + COALESCE(x.n, 0) AS INT) AS total_reserved FROM inventory_open i
        LEFT JOIN (SELECT n.room_type_id, n.date, SUM(n.quantity) AS n FROM ask_nights n JOIN reserved_asks r ON r.ask = n.ask WHERE r.code IS NULL GROUP BY ALL) x
        ON x.room_type_id = i.room_type_id AND x.date = i.date""", RESERVE),
    "finalize_bookings": q("""SELECT f.seq, f.booking_id, b.status = 'Pending' AS accepted, CASE WHEN b.status <> 'Pending' THEN 'BOOKING_STATE_INVALID' END AS code
        FROM finalizations f JOIN bookings_core b ON b.id = f.booking_id"""),
    "add_room_lines": rec(f"""SELECT d.booking_id, d.room_type_id, CAST(rt.base_price + CASE WHEN d.is_breakfast_included THEN 150000 ELSE 0 END AS {D2}) AS agreed_price, d.quantity
        FROM booking_details d JOIN reserved_asks a ON a.ask = d.booking_id AND a.code IS NULL JOIN room_types rt ON rt.id = d.room_type_id""", RESERVE),
    "finalize_bookings_totals": q(f"""SELECT t.booking_id, CAST(t.room_cost + t.service_cost + COALESCE(s.n, 0) AS {D2}) AS total_amount
        FROM totals t JOIN bookings_core b ON b.id = t.booking_id LEFT JOIN (SELECT booking_id, SUM(amount) AS n FROM all_surcharges GROUP BY 1) s ON s.booking_id = t.booking_id
        WHERE b.status = 'Pending'"""),
    "finalize_with_repack": rec("""SELECT seq, booking_id, code IS NULL AS accepted, code FROM (SELECT f.seq, f.booking_id, CASE WHEN b.status <> 'Pending' THEN 'BOOKING_STATE_INVALID'
        WHEN f.booking_id IN (SELECT booking_id FROM packed WHERE booking_id IS NOT NULL AND room_id IS NULL) THEN 'ROOM_ASSIGN_FAILED' END AS code
        FROM finalizations f JOIN bookings_core b ON b.id = f.booking_id)""", _pack("'Pending', 'Active'", "'Checked-in', 'Completed'")),
    "assign_rooms_first_fit": rec("""SELECT b.id AS seq, b.id AS booking_id, COALESCE(a.code, 'OK') = 'OK' AS accepted, NULLIF(a.code, 'OK') AS code
        FROM bookings_core b LEFT JOIN ask_codes a ON a.ask = b.id WHERE b.status = 'Pending'""", ASSIGN),
    "defragment_rooms": rec("SELECT booking_id, room_type_id, unit, room_id FROM packed WHERE booking_id IS NOT NULL", _pack("'Active'", "'Pending', 'Checked-in', 'Completed'")),
    "pre_assign_rooms": rec("""SELECT seq, booking_id, to_room_id, code IS NULL AS accepted, code FROM (
        SELECT m.seq, m.booking_id, m.to_room_id, COALESCE(m.code, CASE WHEN NOT w.ok THEN 'ROOM_OVERLAP' END) AS code FROM judged_moves m LEFT JOIN move_walk w ON w.seq = m.seq)""", MOVES),
    "check_in_batch": q(f"SELECT seq, booking_id, room_id, {RESULT} FROM ci_3", CHECK_IN),
    "check_in_batch_rooms": q("SELECT id, CASE WHEN id IN (SELECT room_id FROM ci_3 WHERE code IS NULL) THEN 'Occupied' ELSE status END AS status FROM rooms", CHECK_IN),
    "check_out_batch": q(f"SELECT seq, booking_id, {RESULT} FROM co", CHECK_OUT),
    "check_out_batch_assignments": q(f"""SELECT a.id, a.booking_id, CASE WHEN c.booking_id IS NOT NULL AND NOT a.is_cancelled THEN LEAST(a.check_out, {AS_OF}) ELSE a.check_out END AS check_out
        FROM room_assignments a LEFT JOIN co c ON c.booking_id = a.booking_id AND c.code IS NULL""", CHECK_OUT),
    "check_out_batch_rooms": q("""SELECT r.id, CASE WHEN r.id IN (SELECT a.room_id FROM live_rooms a JOIN co ON co.booking_id = a.booking_id WHERE co.code IS NULL) THEN 'Dirty' ELSE r.status END AS status
        FROM rooms r""", CHECK_OUT),
    "housekeeping_batch": q("""SELECT seq, room_id, code IS NULL AS accepted, code FROM (SELECT h.seq, h.room_id, CASE WHEN r.id IS NULL THEN 'NOT_FOUND'
        WHEN r.status <> 'Dirty' OR ROW_NUMBER() OVER (PARTITION BY h.room_id ORDER BY h.seq) > 1 THEN 'HOUSEKEEPING_INVALID' END AS code
        FROM housekeeping h LEFT JOIN rooms r ON r.id = h.room_id)"""),
    "cancel_bookings": q(f"SELECT seq, booking_id, {RESULT} FROM ca", CANCEL),
    "cancel_bookings_inventory": q("""SELECT i.room_type_id, i.date, i.total_inventory, CAST(GREATEST(i.total_reserved - COALESCE(f.n, 0), 0) AS INT) AS total_reserved
        FROM room_type_inventory i LEFT JOIN freed f ON f.room_type_id = i.room_type_id AND f.date = i.date""", CANCEL),
    "cancel_bookings_assignments": q("""SELECT a.id, a.booking_id, a.is_cancelled OR b.status = 'Active' AS is_cancelled FROM room_assignments a JOIN bookings_core b ON b.id = a.booking_id"""),
    "add_services": q("""SELECT booking_id AS seq, booking_id, service_id, service_id IN (SELECT id FROM services) AS accepted,
        CASE WHEN service_id NOT IN (SELECT id FROM services) THEN 'NOT_FOUND' END AS code FROM wanted_services""", SERVICES),
    "add_services_totals": q(f"""SELECT t.booking_id, CAST(t.room_cost + t.surcharge_cost + t.service_cost + a.n AS {D2}) AS total_amount
        FROM totals t JOIN added a ON a.booking_id = t.booking_id""", SERVICES),
    "issue_invoices": q(f"""SELECT id AS booking_id, total_amount, amount_paid, CAST(total_amount - amount_paid AS {D2}) AS balance, 'Issued' AS status
        FROM bookings WHERE status IN ('Checked-in', 'Completed')"""),
    "apply_payments": rec(f"SELECT seq, booking_id, amount, {RESULT} FROM paid", PAY),
    "apply_payments_invoices": rec(f"""SELECT i.booking_id, CAST(i.amount_paid + COALESCE(p.n, 0) AS {D2}) AS amount_paid, CAST(i.balance - COALESCE(p.n, 0) AS {D2}) AS balance,
        CASE WHEN p.n IS NULL THEN i.status WHEN i.amount_paid + p.n >= i.total_amount THEN 'Paid' ELSE 'Issued' END AS status
        FROM invoices i LEFT JOIN (SELECT booking_id, SUM(amount) AS n FROM paid WHERE code IS NULL GROUP BY 1) p ON p.booking_id = i.booking_id""", PAY),
    "totals_after_change": q(f"""SELECT booking_id, CAST(room_cost + surcharge_cost + service_cost AS {D2}) AS total_amount
        FROM totals WHERE booking_id IN (SELECT booking_id FROM service_usage)"""),
    "touch_updated": q(f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'Available' ELSE status END AS status,
        CASE WHEN id % 3 = 0 AND status <> 'Available' THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM rooms"""),
    "create_booking_pipeline": rec(f"SELECT seq, request_id, booking_id, {RESULT} FROM created", CREATE),
    "create_booking_pipeline_totals": rec(f"""SELECT c.booking_id, CAST(COALESCE(r.night_cost, 0) * GREATEST(c.co_date - c.ci_date, 1) + COALESCE(s.n, 0) + COALESCE(v.n, 0)
        + COALESCE(f.n, 0) * GREATEST(c.co_date - c.ci_date, 1) AS {D2}) AS total_amount FROM created c
        LEFT JOIN room_costs r ON r.booking_id = c.seq LEFT JOIN (SELECT booking_id, SUM(amount) AS n FROM all_surcharges GROUP BY 1) s ON s.booking_id = c.seq
        LEFT JOIN (SELECT u.booking_id, SUM(u.quantity * x.unit_price) AS n FROM service_usage u JOIN services x ON x.id = u.service_id GROUP BY 1) v ON v.booking_id = c.seq
        LEFT JOIN (SELECT request_id, SUM(150000 * quantity) AS n FROM booking_request_rooms WHERE is_breakfast_included GROUP BY 1) f ON f.request_id = c.request_id
        WHERE c.code IS NULL""", CREATE),
    "stream_totals": q(f"""SELECT booking_id, CAST(room_cost + surcharge_cost + service_cost AS {D2}) AS total_amount
        FROM totals WHERE booking_id IN (SELECT booking_id FROM service_usage)"""),
    "stream_intake_dedup": "SELECT DISTINCT 'req-' || (o_orderkey // 3) AS idempotency_key FROM orders",
    "stream_occupancy": q("""SELECT room_type_id, date, CAST(SUM(CASE WHEN status IN ('Cancelled', 'Completed') THEN 0 ELSE quantity END) AS BIGINT) AS reserved
        FROM held GROUP BY ALL"""),
}
