"""Pipelines: lists of stages folded over a DataFrame."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from ..operators.stages import STAGES, Context, Frame, lookup_unwound

VECTOR_ACCUMULATORS = ("$avgVectorScore", "$maxVectorScore", "$minVectorScore", "$centroid", "$topN")


def parse(pipeline: str | list) -> list[tuple[str, Any]]:
    """(stage, specification) of each object. Vector accumulators that stand beside $group are put into it."""
    stages = json.loads(pipeline) if isinstance(pipeline, str) else pipeline
    out = []
    for stage in stages:
        if not isinstance(stage, dict) or not stage:
            raise ValueError(f"not a stage: {stage!r}")
        if "$group" in stage:
            spec = dict(stage["$group"])
            for name in VECTOR_ACCUMULATORS:
                if name in stage:
                    beside = stage[name]
                    as_name = beside if isinstance(beside, str) and not beside.startswith("$") else beside.get("as", name.lstrip("$")) if isinstance(beside, dict) else name.lstrip("$")
                    operand = {k: v for k, v in beside.items() if k != "as"} if isinstance(beside, dict) else beside
                    spec[as_name] = {name: operand.get("field", operand) if name == "$centroid" and isinstance(operand, dict) else operand}
            out.append(("$group", spec))
            continue
        if len(stage) != 1:
            raise ValueError(f"a stage has one name: {list(stage)}")
        name, spec = next(iter(stage.items()))
        if name not in STAGES:
            raise ValueError(f"unknown stage {name}")
        out.append((name, spec))
    return out


def apply(frame: Frame, pipeline: str | list) -> Frame:
    stages = parse(pipeline)
    i = 0
    while i < len(stages):
        name, spec = stages[i]
        joined = lookup_unwound(frame, spec, stages[i + 1][1]) if name == "$lookup" and i + 1 < len(stages) and stages[i + 1][0] == "$unwind" else None
        frame = STAGES[name](frame, spec) if joined is None else joined
        i += 1 if joined is None else 2
    return frame


def aggregate(df: DataFrame, pipeline: str | list, collections: dict[str, DataFrame] | None = None, key: str = "_id") -> DataFrame:
    """Runs a pipeline over df; key is the column that gives rows their arrival order."""
    return apply(Frame(df, Context(collections or {}, key)), pipeline).df


def explain(df: DataFrame, pipeline: str | list, **more: Any) -> str:
    """The physical plan of a pipeline."""
    out = aggregate(df, pipeline, **more)
    return out.sparkSession._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
