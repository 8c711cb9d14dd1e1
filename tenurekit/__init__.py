"""Subscription-lifecycle analytics as Spark DataFrame operators."""

from tenurekit.config import Calendar, TableNames
from tenurekit.plans.lake import Lake

__all__ = ["Calendar", "Lake", "TableNames"]
