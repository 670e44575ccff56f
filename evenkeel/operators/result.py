"""What a balancing call gives back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from evenkeel.operators.roles import Roles
from evenkeel.operators.scaling import Scaling


@dataclass
class BalanceResult:
    """data: the balanced rows, lazily. `retained_ids`, `synthetic` and `scaled` are there on request or by audit."""

    data: DataFrame
    target: str
    roles: Roles | None = None
    scaling: Scaling | None = None
    diagnostics: dict = field(default_factory=dict)
    retained_ids: DataFrame | None = None
    synthetic: DataFrame | None = None
    scaled: DataFrame | None = None
    parts: dict = field(default_factory=dict)
    _after: Callable[[], dict] | None = None

    def class_counts(self) -> dict:
        """Rows by class in the result; runs a job."""
        return {r[0]: r[1] for r in self.data.groupBy(self.target).count().collect()}

    @property
    def class_ratio_in(self) -> float | None:
        return self.roles.ratio if self.roles else None

    def class_ratio_out(self) -> float:
        n = self.class_counts().values()
        return max(n) / min(n)
