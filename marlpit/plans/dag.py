"""Pipelines as data: a definition of steps becomes one lazy plan over named DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from marlpit.operators import contracts
from marlpit.operators import transforms as t
from marlpit.plans import sql


def _contract(df: DataFrame, expectations: list) -> DataFrame:
    return contracts.enforce(df, [contracts.Expectation(*e) for e in expectations])


#: Steps of one input; their config is passed as keyword arguments.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "select_columns": t.select_columns,
    "rename_columns": t.rename_columns,
    "cast_columns": t.cast_columns,
    "derive_column": t.derive_column,
    "map_categories": t.map_categories,
    "hash_identifier": t.hash_identifier,
    "sequence_identifier": t.sequence_identifier,
    "impute_missing": t.impute_missing,
    "filter_rows": t.filter_rows,
    "filter_sql": t.filter_sql,
    "sort_rows": t.sort_rows,
    "deduplicate": t.deduplicate,
    "aggregate": t.aggregate,
    "sql_expression": t.sql_expression,
    "contract": _contract,
}


def run(definition: Mapping[str, Any], inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """definition: inputs, steps ({id, kind, inputs, config}) in any order, outputs. Returns the outputs; nothing runs until one is read,
    but what a step needs to know of its data (a median to fill in, a check that must not fail)."""
    missing = set(definition.get("inputs", [])) - set(inputs)
    if missing:
        raise ValueError(f"inputs not given: {sorted(missing)}")
    made: dict[str, DataFrame] = dict(inputs)
    steps = {s["id"]: s for s in definition["steps"]}

    def build(name: str, above: tuple[str, ...] = ()) -> DataFrame:
        if name in made:
            return made[name]
        if name in above or name not in steps:
            raise ValueError(f"cycle or unknown step: {name}")
        step = steps[name]
        frames = [build(x, (*above, name)) for x in step["inputs"]]
        config = step.get("config", {})
        if step["kind"] == "join":
            made[name] = t.join(frames[0], frames[1], **config)
        elif step["kind"] == "union":
            made[name] = t.union(frames, **config)
        elif step["kind"] == "custom_sql":
            made[name] = sql.select_over(dict(zip(step["inputs"], frames, strict=True)), config["sql"])
        else:
            made[name] = STEPS[step["kind"]](frames[0], **config)
        return made[name]

    return {name: build(name) for name in definition["outputs"]}
