"""Table schemas and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    """``name type[!] [= default]`` lines; ! is not null."""
    kinds = {
        "long": T.LongType(), "str": T.StringType(), "date": T.DateType(), "int": T.IntegerType(), "bool": T.BooleanType(),
        "double": T.DoubleType(), "ts": T.TimestampType(), "money": T.DecimalType(18, 2),
    }
    fields = []
    for line in filter(None, map(str.strip, ddl.replace(";", "\n").splitlines())):
        left, _, default = line.partition("=")
        name, kind = left.split()
        meta = {"default": default.strip()} if default else {}
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!"), meta))
    return T.StructType(fields)


OPPORTUNITIES = _schema("""
    id long; organisation_name str; title str!; category str; description str; deadline date; source_name str!; source_url str!
    match_reason str; match_score int; status str! = New; is_expired bool! = false; user_notes str; first_discovered_at ts
    last_seen_at ts; updated_at ts; is_lead bool! = false; assigned_to str; lead_status str; lead_priority str; next_action str
    next_action_due date; last_follow_up_date date; lead_notes str; created_at ts
""")
SOURCES = _schema("""
    id long; organisation_name str; base_url str!; monitor_url str!; domain str!; source_type str! = Unknown; discovered_from str
    discovery_query str; confidence_score double! = 0; is_active bool! = true; is_approved bool! = true; first_discovered_at ts
    last_discovered_at ts; last_scanned_at ts; last_scan_started_at ts; last_successful_scan_at ts; last_opportunity_found_at ts
    last_scan_duration_seconds double; last_http_status int; consecutive_failures int! = 0; total_opportunities_found int! = 0
    scan_interval_hours int! = 12; priority_score double! = 50; url_relevance_score double! = 0; is_auto_disabled bool! = false
    disabled_reason str
""")
LEADS = _schema("""
    id long; opportunity_id long!; status str! = Under Review; assigned_to str; priority str! = Medium; next_action str
    next_action_due date; last_follow_up_date date; notes str; created_at ts; updated_at ts
""")
PROPOSALS = _schema("""
    id long; opportunity_id long!; bid_status str! = Not Started; proposal_manager str; estimated_contract_value money
    currency str = RWF; estimated_effort_days int; bid_security_required bool! = false; bid_security_amount money
    proposal_start_date date; planned_submission_date date; actual_submission_date date; proposal_submitted bool! = false
    proposal_result str! = Pending; next_action str; next_action_due date; internal_notes str; no_go_reason str; loss_reason str
    created_at ts; updated_at ts
""")
JOB_STATE = _schema("""
    job_name str!; last_started ts; last_success ts; last_failure ts; status str; last_error str; duration_seconds double
""")


def missing_columns(df: DataFrame, target: T.StructType) -> list[str]:
    have = set(df.columns)
    return [f.name for f in target if f.name not in have]


def evolve(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` with the target's columns and types; new ones get their default.

    Columns the target does not know go; nulls of columns with a default are filled.
    """
    have, out = set(df.columns), []
    for f in target:
        x = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if "default" in f.metadata:
            x = F.coalesce(x, F.lit(f.metadata["default"]).cast(f.dataType))
        out.append(x.alias(f.name))
    return df.select(*out)


def require_empty(df: DataFrame, name: str) -> None:
    """Refuse to drop or replace a table that holds rows; reads one row at most."""
    if df.limit(1).count():
        raise ValueError(f"{name} is not empty")
