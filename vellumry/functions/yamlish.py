"""The YAML subset of frontmatter: nested maps by indentation, lists of scalars, scalars. Plain Python, and Arrow-batched columns over it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM, _ENTRY = re.compile(r"(\s*)- (.+)"), re.compile(r"(\s*)([^:]+):\s*(.*)")
_WORDS = {"true", "false", "null", "yes", "no", "on", "off"}
_SPECIAL = set(":#[]{}|>!&*?\n")
_ESCAPE = re.compile(r'\\(["\\n])')


def decode_scalar(text: str, strict_compat: bool = False):
    """One value. Escapes are undone in one pass; strict_compat undoes them one kind after another, so that an escaped backslash before n becomes a line feed."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        inner = text[1:-1]
        if strict_compat:
            return inner.replace('\\"', '"').replace("\\\\", "\\").replace("\\n", "\n")
        return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], inner)
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "~"):
        return None
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"-?[0-9]+\.[0-9]+", text):
        return float(text)
    return text


def decode(text: str | None, strict_compat: bool = False) -> dict | None:
    """The map that text holds; None if it holds none. A key with nothing behind it is an empty list until entries or items follow."""
    if text is None:
        return None
    root: dict = {}
    open_at: list[tuple[int, dict, str]] = []  # indentation of keys still open, and where their values lie

    def parent(indent: int) -> tuple[dict, str] | None:
        while open_at and open_at[-1][0] >= indent:
            open_at.pop()
        return open_at[-1][1:] if open_at else None

    for line in text.split("\n"):
        if not line.strip():
            continue
        if m := _ITEM.fullmatch(line):
            at = parent(len(m[1]))
            if at:
                holder, key = at
                if isinstance(holder[key], list):
                    holder[key].append(decode_scalar(m[2], strict_compat))
        elif m := _ENTRY.fullmatch(line):
            indent, key, value = len(m[1]), m[2].strip(), m[3].strip()
            at = parent(indent)
            target = root
            if at:
                holder, name = at
                if not isinstance(holder[name], dict):
                    holder[name] = {}
                target = holder[name]
            if value:
                target[key] = decode_scalar(value, strict_compat)
            else:
                target[key] = []
                open_at.append((indent, target, key))
    return root or None


def encode_scalar(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if value is None:
        return '""'
    text = repr(value) if isinstance(value, float) else str(value)
    number = re.fullmatch(r"\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*", text)
    if not isinstance(value, float) and (not text or number or text.lower() in _WORDS | {"~"} or _SPECIAL & set(text) or text != text.strip() or text[0] in "\"'-"):
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return text


def encode(data: dict, indent: int = 0) -> str:
    out = []
    pad = " " * indent
    for key, value in data.items():
        if isinstance(value, dict):
            out.append(f"{pad}{key}:\n" + encode(value, indent + 2))
        elif isinstance(value, (list, tuple)):
            out.append(f"{pad}{key}:\n" + "".join(f"{pad}  - {encode_scalar(v)}\n" for v in value))
        else:
            out.append(f"{pad}{key}: {encode_scalar(value)}\n")
    return "".join(out)


def _decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([None if (d := decode(t)) is None else json.dumps(d, ensure_ascii=False, sort_keys=True) for t in b.to_pylist()], pa.string())


def decoded_json(text: Column) -> Column:
    """Frontmatter as JSON with sorted keys; null where it holds no map."""
    return F.arrow_udf(_decoded, "string")(text)


def _encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([None if t is None else encode(json.loads(t)) for t in b.to_pylist()], pa.string())


def encoded_yaml(as_json: Column) -> Column:
    return F.arrow_udf(_encoded, "string")(as_json)
