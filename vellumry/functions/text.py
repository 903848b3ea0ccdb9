"""Names, keys, dates and digests as Spark columns: built-in expressions, so they stay inside generated code; Arrow batches for JSON of any depth alone."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What PHP-style trimming strips.
BLANKS = " \t\n\r\x00\x0b"
EPHEMERAL_PREFIXES = ("_transient_", "_site_transient_", "_wp_session_", "_edit_lock_")


def slug(name: Column) -> Column:
    """A path segment: bytes (of UTF-8) other than ASCII letters, digits, _ and - become -, edges are trimmed; nothing left gives 'unnamed'."""
    bytes_ = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bytes_, r"[^a-zA-Z0-9_-]", "-"), F.lit("-")), F.lit("")), F.lit("unnamed"))


def safe_segment(name: Column) -> Column:
    """Lower case, runs of other characters as one -, 'untitled' if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "-")), F.lit("-")), F.lit("")), F.lit("untitled"))


def option_filename(name: Column) -> Column:
    """A JSON file's name for an option; a digest is added when the name had to change or is long."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), "_+", "_"), F.lit("._"))
    safe = F.coalesce(F.nullif(plain, F.lit("")), F.lit("option"))
    hashed = F.concat(F.left(safe, F.lit(180)), F.lit("-"), F.left(F.md5(name.cast("binary")), F.lit(8)), F.lit(".json"))
    return F.when((safe != name) | (F.octet_length(name) > 180), hashed).otherwise(F.concat(safe, F.lit(".json")))


def sanitized_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9_-]", "")


def resource_key(kind: str, ident: Column) -> Column:
    """Keys that sort as their numbers do."""
    return F.concat(F.lit(f"{kind}:"), F.lpad(ident.cast("string"), 20, "0"))


def portable_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parsed_timestamp(text: Column) -> Column:
    """Stored dates; the zero date and anything malformed are null."""
    return F.try_to_timestamp(F.when(text != "0000-00-00 00:00:00", F.regexp_replace(text, "T", " ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def header_id(text: Column, reach: int | None = None) -> Column:
    """The id that a file's frontmatter declares, in its first `reach` characters or, by default, anywhere before the closing fence."""
    head = F.left(text, F.lit(reach)) if reach else F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    return F.nullif(F.regexp_extract(head, r"(?m)^\s*id:\s*\"?(\d+)\"?\s*$", 1), F.lit("")).cast("bigint")


def slug_of_path(path: Column) -> Column:
    """The file's name without its ending; an index file takes its directory's."""
    name = F.regexp_extract(path, r"([^/]+)\.md$", 1)
    return F.when(name == "index", F.regexp_extract(path, r"([^/]+)/index\.md$", 1)).otherwise(name)


def is_ephemeral(name: Column, prefixes: tuple[str, ...] = EPHEMERAL_PREFIXES, names: tuple[str, ...] = ()) -> Column:
    found = name.isin(*names) if names else F.lit(False)
    for p in prefixes:
        found = found | name.startswith(p)
    return found


def identity(*columns: Column) -> Column:
    """A digest of values in the order given; null and '' differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def safe_path(path: Column) -> Column:
    """Relative, with no empty, . or .. segment, no backslash and no control character."""
    return (path != "") & ~path.rlike(r"^/|\\|[\x00-\x1f]|(^|/)\.{0,2}(/|$)")


def normalized_path(path: Column) -> Column:
    """Slashes alone, no empty and no . segment, and each .. with the segment before it taken out; null if .. leads above the beginning."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    up = F.lit("..")
    step = lambda held, s: F.when(s != up, F.concat(held, F.array(s))).when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.lit(None))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), out)).otherwise(out)


def exact_identity(as_json: Column) -> Column:
    """SHA-256 of a JSON value written with its keys in order at every depth and no blanks; lists keep their order. Malformed text gives null."""
    return F.sha2(F.arrow_udf(_canonical, "string")(as_json), 256)


def canonical_json(as_json: Column) -> Column:
    """The JSON that exact_identity() digests."""
    return F.arrow_udf(_canonical, "string")(as_json)


def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    for b in batches:
        yield pa.array([one(t) for t in b.to_pylist()], pa.string())


def listed(text: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
