"""Values of an execution's context by dotted paths, and the parsing of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.expr import first_filled


def parse_result(text: Column, response_format: Column) -> Column:
    """JSON, written without blanks, where the format is "json" in any case; malformed JSON fails. Else the text itself."""
    return F.when(F.lower(response_format) == "json", F.to_json(F.parse_json(text))).otherwise(text)


@dataclass(frozen=True)
class Context:
    """Columns of one row for each step execution: JSON texts by root (inputs, config, state, metadata), steps (a map of
    names to JSON with status and result), artifacts (a map of artifact ids to JSON values), and the execution's own."""

    roots: dict[str, Column]
    steps: Column
    artifacts: Column
    execution_id: Column
    step_name: Column
    step_key: Column
    pipeline_name: Column


#: Names of roots and of an execution's fields in paths.
ROOTS = {"input": "inputs", "inputs": "inputs", "current": "inputs", "config": "config", "state": "state", "data": "state", "metadata": "metadata"}
PAYLOADS = {"inputPayload": "inputs", "configPayload": "config", "statePayload": "state", "dataPayload": "state", "metadataPayload": "metadata"}
FIELDS = {"id": "execution_id", "executionId": "execution_id", "stepName": "step_name", "currentStep": "step_name", "stepKey": "step_key", "currentStepKey": "step_key", "pipelineName": "pipeline_name"}


def _at(json: Column, parts: list[str]) -> Column:
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in parts)) if parts else json


def _payload(context: Context, owner: Column, group: str, parts: list[str]) -> Column:
    """The artifact that owner names under group and the first part, and what the other parts lead to in it."""
    found = F.try_element_at(context.artifacts, _at(owner, [group, parts[0], "artifactId"]))
    return _at(found, parts[1:])


def resolve(path: str, context: Context) -> Column:
    """The value at a path as text; null where a root, a step, a key or an artifact is unknown.

    steps.<name>.result.data.<key> is the artifact of that key if the result has one, else the value kept inline.
    """
    parts = [p for p in path.split(".") if p]
    nothing = F.lit(None).cast("string")
    if not parts:
        return nothing
    root, rest = parts[0], parts[1:]
    if root in ROOTS:
        return _at(context.roots[ROOTS[root]], rest) if rest or ROOTS[root] == "inputs" else nothing
    if root.removesuffix("s") in PAYLOADS and rest:
        return _payload(context, context.roots[PAYLOADS[root.removesuffix("s")]], "payloads", rest)
    if root == "execution" and rest:
        return getattr(context, FIELDS[rest[0]]).cast("string") if rest[0] in FIELDS else nothing
    if root == "steps" and len(rest) >= 2:
        step = F.try_element_at(context.steps, F.lit(rest[0]))
        known = _at(step, ["result"]).isNotNull()
        if rest[1] != "result":
            value = _at(step, rest[1:])
        elif len(rest) >= 4 and rest[2] in ("data", "dataPayloads"):
            result = _at(step, ["result"])
            by_artifact, key = _payload(context, result, "dataPayloads", rest[3:]), rest[3]
            has_artifact = _at(result, ["dataPayloads", key]).isNotNull()
            value = by_artifact if rest[2] == "dataPayloads" else F.when(has_artifact, by_artifact).otherwise(_at(result, ["data", *rest[3:]]))
        else:
            value = _at(step, rest[1:])
        return F.when(known, value)
    return nothing


def correlation(pipeline: Column, version: Column, execution_id: Column, step_name: str, step_key: str, instance: Column, config: Column) -> list[Column]:
    """A step's columns that tie it to ledgers, traces and leases; the operation falls back to the config's type."""
    return [
        F.concat_ws(":", pipeline, version).alias("pipeline_key"),
        first_filled(step_key, step_name).alias("step_key"),
        F.concat_ws(":", execution_id.cast("string"), F.col(step_name), instance).alias("lease_id"),
        _at(config, ["provider"]).alias("provider"),
        _at(config, ["model"]).alias("model"),
        F.coalesce(_at(config, ["operation"]), _at(config, ["type"])).alias("operation"),
    ]
