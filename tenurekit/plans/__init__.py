"""Named analyses: each is a function of a :class:`~tenurekit.plans.lake.Lake`."""

from importlib import import_module

_MODULES = (
    "ingest", "tables", "sanity", "overview", "lifecycle", "cancellation", "first_month", "temporal", "deferrals", "published",
)


def analyses() -> dict:
    """``{name: function(lake) -> DataFrame}`` of every analysis."""
    for module in _MODULES:
        import_module(f"tenurekit.plans.{module}")
    return dict(import_module("tenurekit.plans.registry").ANALYSES)
