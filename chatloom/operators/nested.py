"""Nested JSON records as flat tables with links from child to parent (Dewey labelling).

Every value of a record gets an ordinal path identifier: the positions of the fields and elements that lead to it. The
parent of a tagged object is found by cutting identifiers from the right until one names a tagged object. Nodes are
grouped by schema path, which is the path without positions; the schema paths of one tag together form its table. Objects
without a tag are folded into their nearest tagged ancestor under dotted field names. Arrays of such objects or of plain
values form child tables with a row per element, so the columns of a table do not grow with the length of an array.

Defined results: null payloads and payloads that do not parse (``NaN`` and trailing text included) give no rows; a root
that is an array has no tag, so its elements have a null parent; of a repeated field name the last value counts; null
array entries keep their position; a tag that is null or no string still makes an object a node, with null ``kind``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.storage import new_path, restored_key, written

NODE_FIELDS = (
    "node_path string, parent_path string, label string, schema_path string, kind string, fields map<string,string>, "
    "elements map<string,map<string,string>>"
)
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
#: An element of an array, up to its last position, and the name within it.
_ELEMENT = re.compile(r"(.*\[\d+\])\.?([^\[\]]*)$", re.S)
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


def _number(text: str):
    return float(text) if len(text) > 4000 or not text.lstrip("-").isdigit() else int(text)


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_number)


def parse_deep(text: str):
    """Parses JSON of any depth without recursion; raises ValueError where it is malformed."""
    stack: list = []  # open containers, each with the field that waits for its value
    at, value, done = 0, None, False
    fields: list[str | None] = []
    while True:
        at = _SPACE.match(text, at).end()
        if not done:
            c = text[at : at + 1]
            if c in "{[" and c:
                box: dict | list = {} if c == "{" else []
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    at, value, done = at + 1, box, True
                    continue
                stack.append(box)
                fields.append(None)
                if c == "[":
                    continue
                at = _field(text, at, fields)
                continue
            if c == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
            elif m := _NUMBER.match(text, at):
                value, at = _number(m.group()), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError(f"no value at {at}")
                value, at = _WORDS[word], at + len(word)
            done = True
            continue
        if not stack:
            if at != len(text):
                raise ValueError("text after the value")
            return value
        box, c = stack[-1], text[at : at + 1]
        if isinstance(box, dict):
            box[fields[-1]] = value
        else:
            box.append(value)
        if c == ",":
            at, done = at + 1, False
            if isinstance(box, dict):
                at = _field(text, _SPACE.match(text, at).end(), fields)
        elif c == ("}" if isinstance(box, dict) else "]"):
            value, at = stack.pop(), at + 1
            fields.pop()
        else:
            raise ValueError(f"no end of a value at {at}")


def _field(text: str, at: int, fields: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError(f"no field name at {at}")
    fields[-1], at = json.decoder.scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return at + 1


def parse(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return parse_deep(text)


def _put(owner: list, name: str, x) -> None:
    value = x if isinstance(x, str) or x is None else json.dumps(x)
    m = _ELEMENT.match(name)
    if m:
        owner[6].setdefault(m[1], {})[m[2] or "value"] = value
    else:
        owner[5][name] = value


def label_nodes(root) -> Iterator[tuple]:
    """(node_path, parent_path, label, schema_path, kind, fields, elements) of each tagged object, the root included.

    ``fields`` are the plain values of the object by dotted name, ``elements`` those inside its arrays, by the element
    and the name within it (``value`` for a plain element).
    """
    nearest: dict[tuple, tuple | None] = {}
    found: dict[tuple, list] = {}
    stack = [(root, (), "$", "$", "")]
    while stack:
        value, label, path, schema, dotted = stack.pop()
        above = nearest.get(label[:-1]) if label else None
        if isinstance(value, dict) and "_" in value:
            tag = value["_"]
            parent = found[above][0] if above is not None else None
            found[label] = [path, parent, ".".join(map(str, label)), schema, tag if isinstance(tag, str) else None, {}, {}]
            nearest[label], dotted = label, ""
        else:
            nearest[label] = above
        owner = found.get(nearest[label]) if nearest[label] is not None else None
        inner = []
        if isinstance(value, dict):
            for i, (name, x) in enumerate(value.items()):
                inside = f"{dotted}.{name}" if dotted else name
                if isinstance(x, dict | list):
                    inner.append((x, (*label, i), f"{path}.{name}", f"{schema}.{name}", inside))
                elif owner is not None and not (name == "_" and nearest[label] == label):
                    _put(owner, inside, x)
        elif isinstance(value, list):
            for i, x in enumerate(value):
                inside = f"{dotted}[{i}]"
                if isinstance(x, dict | list):
                    inner.append((x, (*label, i), f"{path}[{i}]", f"{schema}[]", inside))
                elif owner is not None:
                    _put(owner, inside, x)
        stack.extend(reversed(inner))
    yield from (tuple(x) for x in found.values())


def flatten(records: DataFrame, key: str, payload: str, values: bool = True) -> DataFrame:
    """One row per tagged object of each record, the root (``$``) included. Other columns of ``records`` are not read.

    Without ``values`` the columns ``fields`` and ``elements`` are left out, which spares their way to Spark.
    """
    schema = NODE_FIELDS if values else NODE_FIELDS.split(", fields")[0]
    kind = dict(records.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            rows = []
            for k, text in zip(frame["_k"], frame["_payload"], strict=True):
                try:
                    rows += [(k, *node[: len(names)]) for node in label_nodes(parse(text))]
                except ValueError:
                    continue
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["_k", *names])
                    rows = []
            yield pd.DataFrame(rows, columns=["_k", *names])

    narrow = records.select(F.col(key).cast("string").alias("_k"), F.col(payload).alias("_payload")).where("_payload is not null")
    return restored_key(narrow.mapInPandas(run, f"_k string, {schema}"), key, kind)


def child_links(nodes: DataFrame, key: str) -> DataFrame:
    """Key, path and parent of each tagged object below the root."""
    return nodes.where("node_path <> '$'").select(key, "node_path", "parent_path")


def _columns(source: str, names: list[str], taken: tuple[str, ...]) -> list:
    """A column per name of a map; one that clashes with a taken name, in any letter case, is prefixed with ``field_``."""
    used, columns = {x.lower() for x in taken}, []
    for field in sorted(names):
        name = field
        while name.lower() in used:
            name = f"field_{name}"
        used.add(name.lower())
        columns.append(F.element_at(source, F.lit(field)).alias(name))
    return columns


def flat_table(nodes: DataFrame, key: str, kind: str, fields: tuple[str, ...]) -> DataFrame:
    """The table of one kind with the named fields, null where a node has none; nothing is collected."""
    links = (key, "node_path", "parent_path", "schema_path")
    return nodes.where(F.col("kind") == kind).select(*links, *_columns("fields", list(fields), links))


def flat_tables(nodes: DataFrame, key: str) -> dict[str, DataFrame]:
    """One table per kind with a string column per plain field seen in it, and one per array of a kind, named
    ``Kind.field[]``, with a row per element that is no tagged object; absent fields are null.

    Rows of a kind keep their link to the parent and their schema path, rows of an array the object they belong to and
    the path of the element. Kinds, arrays and field names are collected: they are the schema, not the data.
    """
    known = nodes.where("kind is not null")
    kinds: dict[str, list[str]] = {k: [] for (k,) in known.select("kind").distinct().collect()}
    for k, field in known.select("kind", F.explode(F.map_keys("fields"))).distinct().collect():
        kinds[k].append(field)
    links = (key, "node_path", "parent_path", "schema_path")
    tables = {k: known.where(F.col("kind") == k).select(*links, *_columns("fields", fields, links)) for k, fields in kinds.items()}
    inside = known.select(key, F.col("node_path").alias("parent_path"), "kind", F.explode("elements").alias("_element", "_values"))
    path = F.concat(F.col("parent_path"), F.lit("."), F.col("_element"))
    inside = inside.withColumns({"element_path": path, "_array": F.regexp_replace("_element", r"\[\d+\]", "[]")})
    arrays: dict[tuple[str, str], list[str]] = {}
    for k, array, field in inside.select("kind", "_array", F.explode(F.map_keys("_values"))).distinct().collect():
        arrays.setdefault((k, array), []).append(field)
    links = (key, "parent_path", "element_path")
    for (k, array), fields in arrays.items():
        rows = inside.where((F.col("kind") == k) & (F.col("_array") == array))
        tables[f"{k}.{array}"] = rows.select(*links, *_columns("_values", fields, links))
    return tables


def write_tables(nodes: DataFrame, key: str) -> DataFrame:
    """Writes the flat tables to the shared folder: one row per table with its path, rows and fields.

    The table of a kind has a folder for each of its schema paths. The nodes are written once, so that records are parsed
    once for all tables. Nodes with null ``kind`` are in no table.
    """
    spark, base = nodes.sparkSession, new_path(nodes.sparkSession, "tables")
    made = []
    for n, (name, rows) in enumerate(sorted(flat_tables(written(nodes, "nodes"), key).items())):
        path = f"{base}/{n}"
        by = ["schema_path"] if "schema_path" in rows.columns else []
        rows.write.partitionBy(*by).parquet(path)
        stored = spark.read.schema(rows.schema).parquet(path)
        made.append((name, path, stored.count(), len(rows.columns) - 3 - len(by)))
    return spark.createDataFrame(made, "kind string, path string, n_rows long, n_fields long")
