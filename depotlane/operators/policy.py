"""Which columns a model may learn from: by exact name and by prefix, refusals first."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class Policy:
    """Allowed and blocked columns; a blocked one is refused even if it is allowed too."""

    allow: tuple[str, ...] = ()
    allow_prefixes: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    block_prefixes: tuple[str, ...] = ()

    def blocked(self, name: str) -> bool:
        return name in self.block or name.startswith(self.block_prefixes)

    def allowed(self, name: str) -> bool:
        return not self.blocked(name) and (name in self.allow or name.startswith(self.allow_prefixes))

    def check(self, names: Iterable[str]) -> None:
        """Fails if any column is blocked or not on the list."""
        names = list(names)
        if bad := [n for n in names if self.blocked(n)]:
            raise ValueError(f"blocked columns: {bad}")
        if bad := [n for n in names if not self.allowed(n)]:
            raise ValueError(f"columns not allowed: {bad}")

    def select(self, df: DataFrame, without: Iterable[str] = ()) -> list[str]:
        """The numeric columns of a table that may be learnt from, in its order."""
        left = set(without)
        return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in left and self.allowed(f.name)]


#: Calendar features and features that look back; no target, label, error or check.
POLICY = Policy(
    allow=("weekday", "week_of_month", "month", "iso_week", "month_end", "holiday", "pre_holiday", "post_holiday", "bridge", "easter_days", "easter_week", "any_holiday", "holidays", "bridges", "weekend_share", "ramp_up"),
    allow_prefixes=("lag_", "mean_", "median_", "maturity_"),
    block=("date", "target", "is_actual", "series", "regime", "service_type", "source", "truth", "fold", "model", "y_true", "y_pred", "abs_error", "peak"),
    block_prefixes=("flag_", "qa_", "audit_", "target_", "actual_", "observed_"),
)
