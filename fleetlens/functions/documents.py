"""YAML and JSON documents as JSON text.

Spark has no YAML reader, so this is the one step outside Catalyst: an Arrow
batched function from text to compact JSON text with sorted keys. Rows that do
not need it are passed as null and cost nothing but the transfer of a null.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

try:
    import yaml
except ImportError:  # the rest of the library works without it
    yaml = None

# Executors get these helpers with the job, installed package or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANAGED_BY = "app.kubernetes.io/managed-by"

# The only plain scalars that are not strings.
_PLAIN = [
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:int", r"^[-+]?(?:0|[1-9][0-9]*)$", "-+0123456789"),
    (
        "tag:yaml.org,2002:float",
        r"^[-+]?(?:[0-9]+\.[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+(?:[eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+)$",
        "-+0123456789.",
    ),
]


def _loader(unique_keys: bool):
    """A safe loader whose plain scalars are JSON scalars or strings (no dates, no yes/no)."""
    if yaml is None:
        raise RuntimeError("reading YAML files needs the yaml package on the executors")

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers = {}

        def construct_yaml_float(self, node):
            return float(self.construct_scalar(node))

        def construct_mapping(self, node, deep=False):
            if unique_keys:
                seen = set()
                for key_node, _ in node.value:
                    if key_node.value in seen and key_node.tag != "tag:yaml.org,2002:merge":
                        raise yaml.constructor.ConstructorError(None, None, "duplicated key", key_node.start_mark)
                    if isinstance(key_node.value, str):
                        seen.add(key_node.value)
            return super().construct_mapping(node, deep)

    for tag, pattern, first in _PLAIN:
        Loader.add_implicit_resolver(tag, re.compile(pattern), list(first))
    Loader.add_implicit_resolver("tag:yaml.org,2002:merge", re.compile(r"^<<$"), ["<"])
    Loader.add_constructor("tag:yaml.org,2002:float", Loader.construct_yaml_float)
    return Loader


def _pairs(unique_keys: bool):
    def build(pairs):
        out = dict(pairs)
        if unique_keys and len(out) != len(pairs):
            raise ValueError("duplicated key")
        return out

    return build


def _plain_numbers(value):
    """Numbers as JSON consumers print them: 1.0 is 1, no NaN or infinity."""
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    if isinstance(value, dict):
        return {k: _plain_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain_numbers(v) for v in value]
    return value


def _drop_managed_by(doc):
    """Remove a non-empty managed-by label of the object and of its pod template."""
    for path in (("metadata", "labels"), ("spec", "template", "metadata", "labels")):
        node = doc
        for step in path:
            node = node.get(step) if isinstance(node, dict) else None
        if isinstance(node, dict) and node.get(MANAGED_BY):
            del node[MANAGED_BY]
    return doc


def _read(text, loader, pairs):
    try:
        return json.loads(text, object_pairs_hook=pairs)
    except json.JSONDecodeError:
        return yaml.load(text, Loader=loader)


def _shown(doc, spec: bool) -> str:
    doc = _plain_numbers(_drop_managed_by(doc) if spec else doc)
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"), sort_keys=spec)


def _unreadable() -> tuple[type[Exception], ...]:
    return (yaml.YAMLError, ValueError, TypeError, RecursionError)


def _converter(unique_keys: bool, spec: bool):
    loader, pairs = _loader(unique_keys), _pairs(unique_keys)

    def convert(text):
        if text is None:
            return None
        try:
            return _shown(_read(text, loader, pairs), spec)
        except _unreadable():
            return None

    return convert


def _json_texts(texts: Iterator[pd.Series], unique_keys: bool, spec: bool) -> Iterator[pd.Series]:
    convert = _converter(unique_keys, spec)
    for batch in texts:
        yield batch.map(convert, na_action="ignore").astype(object).where(batch.notna(), None)


@F.pandas_udf(StringType())
def _document_to_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _json_texts(texts, unique_keys=False, spec=False)


@F.pandas_udf(StringType())
def _spec_to_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _json_texts(texts, unique_keys=True, spec=True)


@F.pandas_udf(StructType([StructField("document", StringType()), StructField("spec", StringType())]))
def _document_and_spec(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    loader, pairs = _loader(True), _pairs(True)
    document = _converter(unique_keys=False, spec=False)

    def convert(text):
        """Read once; a text that has a key twice, or is unreadable, is no resource, and the document is read by itself."""
        if text is None:
            return None, None
        try:
            doc = _read(text, loader, pairs)
            shown = _shown(doc, spec=False)
            return shown, _shown(doc, spec=True)
        except _unreadable():
            return document(text), _spec(text)

    _spec = _converter(unique_keys=True, spec=True)
    for batch in texts:
        found = [convert(t) for t in batch.astype(object).where(batch.notna(), None)]
        yield pd.DataFrame({"document": pd.Series([d for d, _ in found], dtype=object), "spec": pd.Series([s for _, s in found], dtype=object)})


@F.pandas_udf(StringType())
def _json_to_yaml(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(
            lambda t: yaml.safe_dump(json.loads(t), default_flow_style=False, allow_unicode=True, sort_keys=False),
            na_action="ignore",
        ).astype(object).where(batch.notna(), None)


def yaml_or_json(content: Column) -> Column:
    """JSON text of a YAML or JSON document (last of doubled keys wins); null when it is neither."""
    native = F.try_parse_json(content).isNotNull()
    return F.coalesce(F.when(native, content), _document_to_json(F.when(~native, content)))


def _plain_spec(content: Column) -> Column:
    """Whether a resource file is JSON that needs no re-printing."""
    reprint = content.rlike(r"[:\[,]\s*-?[0-9]+(\.[0-9]+)?[eE]|[:\[,]\s*-?[0-9]+\.[0-9]*0\s*[,}\]]")
    return F.try_parse_json(content).isNotNull() & ~F.contains(content, F.lit(MANAGED_BY)) & ~reprint


def spec_json(content: Column) -> Column:
    """Canonical JSON text of a resource file, without managed-by labels.

    Plain JSON stays in the JVM; YAML, labelled files and numbers that need
    re-printing go through the batched function.
    """
    native = _plain_spec(content)
    return F.coalesce(
        F.when(native, F.to_json(F.try_parse_json(content))),
        _spec_to_json(F.when(~native, content)),
    )


def with_document_and_spec(files: DataFrame) -> DataFrame:
    """Add ``document`` and ``spec``: what ``yaml_or_json`` and ``spec_json`` give, from one reading of each text."""
    content = F.col("content")
    plain = _plain_spec(content)
    read = files.withColumn("_read", _document_and_spec(F.when(~plain, content)))
    document = F.coalesce(F.when(F.try_parse_json(content).isNotNull(), content), F.col("_read.document"))
    spec = F.coalesce(F.when(plain, F.to_json(F.try_parse_json(content))), F.col("_read.spec"))
    return read.withColumns({"document": document, "spec": spec}).drop("_read")


def yaml_text(json_text: Column, wanted: Column) -> Column:
    return _json_to_yaml(F.when(wanted, json_text))


def kind_of(node: Column) -> Column:
    """Type of a variant node: OBJECT, ARRAY, STRING, BOOLEAN, a number type, or null."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def truthy(node: Column) -> Column:
    """Whether a JSON value counts as set: not absent, null, false, 0 or ''."""
    kind = kind_of(node)
    return F.coalesce(
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(node, "$", "string") != "")
        .when(kind.isin("OBJECT", "ARRAY"), F.lit(True))
        .otherwise(F.try_variant_get(node, "$", "double") != 0),
        F.lit(False),
    )


def string_list(node: Column) -> Column:
    """A scalar-or-list value as array<string>; an unset value is the empty list."""
    scalar = F.try_variant_get(node, "$", "string")
    elements = F.transform(
        F.try_variant_get(node, "$", "array<variant>"),
        lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)),
    )
    empty = F.array().cast("array<string>")
    return F.when(~truthy(node), empty).when(kind_of(node) == "ARRAY", elements).otherwise(F.array(scalar))
