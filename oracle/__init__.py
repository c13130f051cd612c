"""SQL that DuckDB runs on the same tables to check the registered queries."""

from .queries_jobs import SQL as _jobs
from .queries_quality import SQL as _quality
from .queries_reports import SQL as _reports

SQL: dict[str, str] = {**_reports, **_quality, **_jobs}
SQL["versioned_payments"] = SQL["apply_payments_invoices"]  # the same invoices, whichever way they are stored
