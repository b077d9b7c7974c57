"""All registered queries of the statement engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daybook.plans import audit_plans, detect_plans, file_plans, ledger_plans, long_plans, parse_plans, scalar_plans, statement_plans, stored_plans, stream_plans, usage_plans, voucher_plans

FLAGSHIP = "W1_balance_audit_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _plans in (audit_plans, long_plans, parse_plans, scalar_plans, voucher_plans, ledger_plans, usage_plans, statement_plans, stored_plans, file_plans, stream_plans, detect_plans):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
