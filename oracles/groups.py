"""Groupings of raw attributes, as SQL columns."""

from __future__ import annotations

# Attribute domains and the labels reports must carry.
_LISTED_STRENGTHS = """WHEN drug_strength IN ('2.5mg', '5mg') THEN 'low (≤5mg)'
    WHEN drug_strength IN ('10mg', '20mg', '25mg') THEN 'mid (10–25mg)'
    WHEN drug_strength IN ('50mg', '100mg') THEN 'high (≥50mg)'"""
STRENGTH_GROUP = f"CASE {_LISTED_STRENGTHS} END AS strength_group"
STRENGTH_GROUP_OR_ITSELF = f"CASE {_LISTED_STRENGTHS} ELSE drug_strength END AS strength_group"
DOSE_GROUP = """CASE WHEN monthly_dose <= 8 THEN 'low (≤8/mo)' WHEN monthly_dose <= 16 THEN 'mid (9–16/mo)'
    WHEN monthly_dose = 30 THEN 'high (30/mo)' END AS dose_group"""
DOSE_GROUP_OR_ITSELF = """CASE WHEN monthly_dose <= 8 THEN 'low (≤8/mo)' WHEN monthly_dose <= 16 THEN 'mid (9–16/mo)'
    WHEN monthly_dose = 30 THEN 'high (30/mo — daily)' ELSE CAST(monthly_dose AS VARCHAR) END AS dose_group"""
CHANNEL_GROUP = """CASE WHEN first_channel_grouping IN ('organic search', 'paid search') THEN 'active_search'
    WHEN first_channel_grouping IN ('direct', 'crm') THEN 're_engaged' ELSE 'unknown_other' END AS channel_group"""
