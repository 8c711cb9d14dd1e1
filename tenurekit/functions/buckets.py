"""Named groupings of raw attributes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenurekit.functions.columns import ColumnOrName, as_date, col, day, is_false, is_true

# Attribute domains and the labels reports must carry.
STRENGTH_GROUPS = {
    "low (≤5mg)": ["2.5mg", "5mg"],
    "mid (10–25mg)": ["10mg", "20mg", "25mg"],
    "high (≥50mg)": ["50mg", "100mg"],
}
DOSE_LOW, DOSE_MID, DOSE_HIGH = "low (≤8/mo)", "mid (9–16/mo)", "high (30/mo)"
DOSE_HIGH_DAILY = "high (30/mo — daily)"
CHANNEL_GROUPS = {
    "active_search": ["organic search", "paid search"],
    "re_engaged": ["direct", "crm"],
}
CHANNEL_OTHER = "unknown_other"
CADENCE_BY_DAYS_SUPPLY = {1: [30, 32], 3: [90, 96], 6: [180, 192]}


def _lookup(value: Column, groups: dict, default: Column | None = None) -> Column:
    chain = F
    for name, members in groups.items():
        chain = chain.when(value.isin(members), F.lit(name))
    return chain if default is None else chain.otherwise(default)


def strength_group(strength: ColumnOrName, keep_unknown: bool = False) -> Column:
    """Low / mid / high; an unlisted strength is null, or itself with ``keep_unknown``."""
    value = col(strength)
    return _lookup(value, STRENGTH_GROUPS, value if keep_unknown else None)


def dose_group(
    dose: ColumnOrName,
    keep_unknown: bool = False,
    names: tuple[str, str, str] = (DOSE_LOW, DOSE_MID, DOSE_HIGH),
) -> Column:
    """Up to 8, up to 16, exactly 30; 17–29 and 31+ are null, or their text with ``keep_unknown``."""
    value = col(dose)
    low, mid, high = names
    chain = F.when(value <= 8, low).when(value <= 16, mid).when(value == 30, high)
    return chain.otherwise(value.cast("string")) if keep_unknown else chain


def channel_group(channel: ColumnOrName) -> Column:
    return _lookup(col(channel), CHANNEL_GROUPS, F.lit(CHANNEL_OTHER))


def cadence_months(days_supply: ColumnOrName) -> Column:
    return _lookup(col(days_supply), CADENCE_BY_DAYS_SUPPLY)


def lifecycle_stage(
    activated: ColumnOrName = "is_activated",
    paid: ColumnOrName = "is_paid",
    rx_written: ColumnOrName = "rx_is_written",
) -> Column:
    activated, paid, rx = col(activated), col(paid), col(rx_written)
    return (
        F.when(activated, "activated")
        .when(~paid & ~rx, "fell_out_before_rx")
        .when(rx & ~activated, "rx_written_not_activated")
        .otherwise("other")
    )


def activation_group(activated: ColumnOrName = "is_activated", unknown_is_activated: bool = False) -> Column:
    """Activated against fell-out. The two reports differ in spelling and in where a null goes."""
    if unknown_is_activated:
        return F.when(is_false(activated), "fellout").otherwise("activated")
    return F.when(is_true(activated), "activated").otherwise("fell_out")


def outcome_group(label: ColumnOrName = "label") -> Column:
    return F.when(col(label) == 1, "churned").otherwise("retained")


def subscriber_type(cancel: ColumnOrName, ended: ColumnOrName) -> Column:
    """How a snapshot's term finished. Any recorded end counts, also one after the cutoff."""
    return (
        F.when(col(cancel).isNotNull(), "voluntary_churner")
        .when(col(ended).isNotNull(), "involuntary_churner")
        .otherwise("retained")
    )


def cancellation_type(cancel: ColumnOrName, ended: ColumnOrName, cutoff: date) -> Column:
    """Voluntary first, then involuntary, then not cancelled; null where none applies."""
    cancel_day, end_day = as_date(cancel), as_date(ended)
    limit = day(cutoff)
    return (
        F.when(cancel_day <= limit, "voluntary_cancellation")
        .when(col(cancel).isNull() & (end_day <= limit), "involuntary_cancellation")
        .when(end_day.isNull() | (end_day > limit) | (cancel_day > limit), "not_cancelled")
    )
