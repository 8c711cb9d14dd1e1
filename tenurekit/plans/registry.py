"""Names of the analyses. A module adds to it by decorating functions of a lake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tenurekit.plans.lake import Lake

Analysis = Callable[[Lake], DataFrame]
ANALYSES: dict[str, Analysis] = {}


def named(name: str) -> Callable[[Analysis], Analysis]:
    def register(analysis: Analysis) -> Analysis:
        if name in ANALYSES:
            raise ValueError(f"analysis {name} is registered twice")
        ANALYSES[name] = analysis
        return analysis

    return register
