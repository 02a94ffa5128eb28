"""Expiry, manual status and sales-pipeline transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.dates import is_expired
from ..functions.text import or_null


def expiry_columns(as_of: Column, deadline: Column | str = "deadline", status: Column | str = "status") -> tuple[Column, Column]:
    """(is_expired, status) after the expiry rule."""
    s = F.col(status) if isinstance(status, str) else status
    gone = is_expired(deadline, as_of)
    return gone, F.when(gone & s.isin(*v.ACTIVE_STATUSES), "Expired").when(~gone & (s == "Expired"), "New").otherwise(s)


def apply_expiry(opportunities: DataFrame, as_of: Column, only_dated: bool = False) -> DataFrame:
    """Expiry flag and status by deadline, with a ``changed`` column.

    ``only_dated`` leaves rows without a deadline as they are (bulk maintenance).
    """
    gone, status = expiry_columns(as_of)
    if only_dated:
        keep = F.col("deadline").isNull()
        gone, status = F.when(keep, F.col("is_expired")).otherwise(gone), F.when(keep, F.col("status")).otherwise(status)
    rows = opportunities.withColumns({"_e": gone, "_s": status})
    rows = rows.withColumn("changed", ~F.col("_e").eqNullSafe(F.col("is_expired")) | ~F.col("_s").eqNullSafe(F.col("status")))
    return rows.withColumns({"is_expired": F.col("_e"), "status": F.col("_s")}).drop("_e", "_s")


def checked(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value, or an error if it is none of the allowed ones."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"Invalid {what}: "), F.coalesce(value, F.lit("null")))))


def invalid(value: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def view(opportunities: DataFrame) -> DataFrame:
    """Opening a new opportunity makes it seen."""
    return opportunities.withColumn("status", F.when(F.col("status") == "New", "Seen").otherwise(F.col("status")))


def set_status(opportunities: DataFrame, status: Column, as_of: Column, notes: Column | None = None) -> DataFrame:
    """Manual status, and notes if given; the expiry flag follows where it can."""
    new = checked(status, v.OPPORTUNITY_STATUSES, "status")
    flag = F.when(new == "Expired", True).when(F.col("deadline").isNull() | (F.col("deadline") >= as_of), False).otherwise(F.col("is_expired"))
    out = opportunities.withColumns({"is_expired": flag, "status": new})
    return out if notes is None else out.withColumn("user_notes", or_null(notes))


def add_to_pipeline(opportunities: DataFrame) -> DataFrame:
    default = lambda c, x: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(x))
    return opportunities.withColumns({
        "is_lead": F.lit(True), "status": F.lit("Interested"),
        "lead_status": default("lead_status", "Under Review"), "lead_priority": default("lead_priority", "Medium"),
    })


def remove_from_pipeline(opportunities: DataFrame) -> DataFrame:
    """Only the flag goes; status and lead fields stay."""
    return opportunities.withColumn("is_lead", F.lit(False))


def status_of_lead(lead_status: Column, status: Column) -> Column:
    out = status
    for lead, new in v.LEAD_TO_STATUS.items():
        out = F.when(lead_status == lead, new).otherwise(out)
    return out


def update_pipeline(opportunities: DataFrame, events: DataFrame) -> DataFrame:
    """Apply one pipeline form per opportunity (id); rows that are no lead stay.

    ``events``: id, lead_status, lead_priority, assigned_to, next_action,
    next_action_due (date), last_follow_up_date (date), lead_notes.  Blank
    text becomes null; a blank lead_status leaves the status alone.
    """
    texts, dates = ("lead_status", "lead_priority", "assigned_to", "next_action", "lead_notes"), ("next_action_due", "last_follow_up_date")
    new = events.select("id", *[or_null(c).alias(f"_{c}") for c in texts], *[F.col(c).alias(f"_{c}") for c in dates], F.lit(True).alias("_hit"))
    rows = opportunities.join(new, "id", "left")
    hit = F.col("_hit").isNotNull() & F.col("is_lead")
    out = rows.withColumn("status", F.when(hit, status_of_lead(F.col("_lead_status"), F.col("status"))).otherwise(F.col("status")))
    out = out.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in (*texts, *dates)})
    return out.select(*opportunities.columns)
