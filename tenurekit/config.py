"""Study calendar, table naming and the runtime settings the operators rely on."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import SparkSession

LAYERS = ("bronze", "silver", "gold")


@dataclass(frozen=True)
class Calendar:
    """The dates and lengths every label, snapshot and cutoff is derived from."""

    pull_date: date = date(2026, 7, 2)
    label_cutoff: date = date(2026, 6, 30)
    horizon_days: int = 30
    step_days: int = 7
    max_week: int = 52

    @property
    def cancel_flag_cutoff(self) -> date:
        """Exclusive bound: a cancel on the label cutoff still counts."""
        return self.label_cutoff + timedelta(days=1)

    @property
    def start_cutoff(self) -> date:
        """Exclusive bound: the last start that leaves a whole horizon before the cutoff."""
        return self.label_cutoff - timedelta(days=self.horizon_days - 1)

    @property
    def renewal_cutoff(self) -> date:
        """Last renewal date that leaves a whole horizon to observe a payment in."""
        return self.label_cutoff - timedelta(days=self.horizon_days)


@dataclass(frozen=True)
class TableNames:
    """Fully qualified names of layered tables, ``catalog.schema.<prefix><table>``."""

    catalog: str = "spark_catalog"
    schema: str = "default"
    landing_dir: str = "landing"
    prefixes: dict[str, str] = field(default_factory=lambda: {layer: f"{layer}_" for layer in LAYERS})

    def table(self, layer: str, name: str) -> str:
        return f"{self.catalog}.{self.schema}.{self.prefixes[layer]}{name}"

    def landing_file(self, name: str) -> str:
        return f"{self.landing_dir.rstrip('/')}/{name}.csv"

    @classmethod
    def load(cls, path: str | Path | None = None, env: dict[str, str] | None = None) -> TableNames:
        """File values (TOML) over the defaults, then environment values over both."""
        env = os.environ if env is None else env
        source = Path(path) if path else Path(__file__).resolve().parents[1] / "conf" / "tables.toml"
        read = tomllib.loads(source.read_text()) if source.exists() else {}
        names = cls()
        prefixes = {**names.prefixes, **read.get("prefixes", {})}
        for layer in LAYERS:
            prefixes[layer] = env.get(f"TENURE_{layer.upper()}_PREFIX", prefixes[layer])
        plain = {
            key: env.get(f"TENURE_{key.upper()}", read.get(key, getattr(names, key)))
            for key in ("catalog", "schema", "landing_dir")
        }
        return replace(names, prefixes=prefixes, **plain)


# AQE settings the raw-row joins count on. The forced form splits a hot key even where the split costs
# one more exchange, which is cheaper than one task holding a third of the rows. The zero ratio lets a
# side that turns out tiny (one row per label, say) be broadcast by its measured size, however few of
# the shuffle's partitions it fills; otherwise a join on two labels would stay a two-task join.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    # Dates of timestamps are taken in one zone, wherever the session runs.
    "spark.sql.session.timeZone": "UTC",
}


def apply_runtime_defaults(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark
