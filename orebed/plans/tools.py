"""Read-only tools: named operations with typed arguments, each a DataFrame with its evidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, documents
from ..schema import GROUPABLE, NUMERIC, OPERATIONS


@dataclass(frozen=True)
class Argument:
    kind: type
    allowed: tuple[Any, ...] | None = None
    required: bool = True


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    arguments: Mapping[str, Argument] = field(default_factory=dict)

    def __call__(self, df: DataFrame, **given: Any) -> DataFrame:
        """Checks names, types and values first: nothing outside the lists reaches a query."""
        if extra := given.keys() - self.arguments.keys():
            raise ValueError(f"{self.name} has no argument {sorted(extra)[0]!r}")
        for name, rule in self.arguments.items():
            if name not in given:
                if rule.required:
                    raise ValueError(f"{self.name} needs {name!r}")
            elif not isinstance(given[name], rule.kind) or rule.allowed is not None and given[name] not in rule.allowed:
                raise ValueError(f"{name} = {given[name]!r} is not allowed")
        return self.run(df, **given)


def _sum_with_evidence(df: DataFrame, value: str, group_by: str) -> DataFrame:
    return documents.provenance(df, [group_by], F.col(value), F.concat_ws("#", "source_file", "pos"))


TOOLS = {
    t.name: t
    for t in (
        Tool("aggregate", aggregate.standard_aggregate, {"field": Argument(str, tuple(NUMERIC)), "op": Argument(str, tuple(OPERATIONS)), "group_by": Argument(str, tuple(GROUPABLE), False), "contains": Argument(str, None, False)}),
        Tool("sum_with_evidence", _sum_with_evidence, {"value": Argument(str, tuple(NUMERIC)), "group_by": Argument(str, tuple(GROUPABLE))}),
    )
}
