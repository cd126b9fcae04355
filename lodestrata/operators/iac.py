"""Infrastructure manifests: event sources of functions as hints for the dependency graph and as nodes of the knowledge graph."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import file_name
from lodestrata.operators.fixed import ARN_KINDS, EVENTS, FUNCTION_TYPE, MAPPING_TYPE
from lodestrata.operators.graph import NODE

HINT = "path string, source_unit string, target_kind string, provider string, name string, kind string, evidence string"


def _mapping(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _arn_name(value: Any) -> str | None:
    """What a resource is called in an ARN or in a reference to an attribute of it."""
    if isinstance(value, str):
        return value.rpartition(":")[2]
    of = _mapping(value).get("Fn::GetAtt")
    return str(of[0]) if isinstance(of, list) and of else None


def _event(kind: Any, told: Any) -> tuple[str, str | None] | None:
    """(kind, name) of an event source; a text in place of its properties is taken as the ARN or the name itself."""
    low = str(kind or "").lower()
    for types, target, key, arn in EVENTS:
        if low in types:
            value = told if isinstance(told, str) else _mapping(told).get(key) or (_mapping(told).get("arn") if arn else None)
            return target, _arn_name(value) if arn else value if isinstance(value, str) else None
    return None


def _mapped(told: dict) -> tuple[str, str] | None:
    arn = told.get("EventSourceArn")
    if not isinstance(arn, str) or not arn:
        return None
    parts = arn.split(":")
    return (ARN_KINDS.get(parts[2], parts[2]), parts[-1]) if len(parts) >= 6 else ("resource", arn)


def _yaml(text: str) -> dict:
    """A manifest with its short tags (!Ref, !GetAtt and others) read as the functions that they stand for."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def tagged(loader: yaml.SafeLoader, tag: str, node: yaml.Node) -> dict:
        if isinstance(node, yaml.ScalarNode):
            value = loader.construct_scalar(node)
            value = value.split(".", 1) if tag == "GetAtt" else value
        elif isinstance(node, yaml.SequenceNode):
            value = loader.construct_sequence(node, deep=True)
        else:
            value = loader.construct_mapping(node, deep=True)
        return {"Ref" if tag == "Ref" else f"Fn::{tag}": value}

    Loader.add_multi_constructor("!", tagged)
    try:
        return _mapping(yaml.load(text, Loader))
    except (yaml.YAMLError, ValueError, RecursionError):
        return {}


def _hints(path: str, text: str) -> Iterator[tuple]:
    name = path.rpartition("/")[2]
    if name in ("template.yml", "template.yaml"):
        for unit, spec in _mapping(_yaml(text).get("Resources")).items():
            if _mapping(spec).get("Type") == FUNCTION_TYPE:
                for event, told in _mapping(_mapping(spec.get("Properties")).get("Events")).items():
                    if found := _event(_mapping(told).get("Type"), _mapping(told).get("Properties")):
                        yield unit, *found, f"{path}: {unit}.Events.{event}"
    elif name in ("serverless.yml", "serverless.yaml"):
        for unit, spec in _mapping(_yaml(text).get("functions")).items():
            events = _mapping(spec).get("events")
            for one in events if isinstance(events, list) else ():
                for event, told in _mapping(one).items():
                    if found := _event(event, told):
                        yield unit, *found, f"{path}: {unit}.events.{event}"
    elif name.endswith(".template.json"):
        try:
            doc = _mapping(json.loads(text))
        except ValueError:
            return
        for logical, spec in _mapping(doc.get("Resources")).items():
            if _mapping(spec).get("Type") == MAPPING_TYPE:
                told = _mapping(spec.get("Properties"))
                if found := _mapped(told):
                    unit = told.get("FunctionName", "?")
                    yield unit if isinstance(unit, str) else None, *found, f"{path}: {logical}"


def hints(files: DataFrame) -> DataFrame:
    """HINT of the event sources in files (path, text): templates, service manifests and generated templates, told by their names.

    What doesn't parse, or isn't shaped as expected, gives nothing. A hint without a unit's name is malformed; the
    graph leaves it out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, None if unit is None else str(unit), kind, "aws", name, "reads_from", evidence)
                for path, text in zip(batch["path"], batch["text"]) for unit, kind, name, evidence in _hints(path, text or "")
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HINT.split(", ")])

    name = file_name(F.col("path"))
    ours = files.where(name.rlike(r"^(?:template|serverless)\.ya?ml$") | name.endswith(".template.json"))
    return ours.select("path", "text").mapInPandas(run, HINT)


def dataset_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """NODE of resources in hints that the graph (id, ...) doesn't have: declared, but touched by no call."""
    node_id = F.concat(F.lit("dataset_ref:"), "target_kind", F.lit(":"), F.coalesce(F.nullif("name", F.lit("")), F.lit("_unnamed")))
    own = found.groupBy(node_id.alias("id")).agg(F.first("target_kind").alias("target_kind"), F.first("name").alias("name"))
    missing = own.join(nodes.select("id"), "id", "left_anti")
    attributes = F.map_filter(F.create_map(F.lit("resource_kind"), F.col("target_kind"), F.lit("origin"), F.lit("iac"), F.lit("resource_name"), F.nullif("name", F.lit(""))), lambda _, v: v.isNotNull())
    blank = {"kind": "'dataset_ref'", "file": "cast(null as string)", "start_line": "cast(null as int)", "end_line": "cast(null as int)", "raw_text": "cast(null as string)", "ord": "0L"}
    out = missing.select("id", F.coalesce(F.nullif("name", F.lit("")), F.col("target_kind")).alias("name"), attributes.alias("attributes"), *(F.expr(e).alias(c) for c, e in blank.items()))
    return out.select(*(c.split()[0] for c in NODE.split(", ")))
