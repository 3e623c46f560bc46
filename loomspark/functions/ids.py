"""Content hashes and deterministic identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of fragment identifiers (fixed value).
FRAGMENT_NAMESPACE = "f5c375ee5ff447b4a38356c4cf3a5c4c"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(_col(text), 256)


def file_hash(content: Column | str, algorithm: str = "sha256") -> Column:
    """Digest of binary content: sha256, sha1 or md5."""
    c = _col(content)
    if algorithm not in ("sha256", "sha1", "md5"):
        raise ValueError(f"unknown digest {algorithm}")
    return F.sha2(c, 256) if algorithm == "sha256" else F.sha1(c) if algorithm == "sha1" else F.md5(c)


def _uuid(digest: Column, version: int) -> Column:
    """The first 128 bits of a hex digest with the bits of a UUID version and variant."""
    variant = F.lower(F.hex(F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    piece = lambda a, n: F.substr(digest, F.lit(a), F.lit(n))
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit(f"-{version}"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))


def point_id(key: Column | str) -> Column:
    """A UUID from the SHA-256 of a key."""
    return _uuid(F.sha2(_col(key), 256), 4)


def spo_hash(subject, subject_type, predicate, obj, object_type) -> Column:
    """SHA-256 of a fact's five values in lower case."""
    return F.sha2(F.concat_ws("|", *[F.lower(_col(c)) for c in (subject, subject_type, predicate, obj, object_type)]), 256)


def entry_hash(term, expansion, definition, domain, aliases) -> Column:
    """SHA-256 of a glossary entry with its sorted aliases; used to see that it changed."""
    names = F.array_join(F.array_sort(_col(aliases)), ",")
    return F.sha2(F.concat_ws("|", _col(term), _col(expansion), _col(definition), F.coalesce(_col(domain), F.lit("")), F.coalesce(names, F.lit(""))), 256)


def payload_hash(term, expansion, definition) -> Column:
    """SHA-256 of the three texts of a glossary entry; kept with its point."""
    return F.sha2(F.concat_ws("|", _col(term), _col(expansion), _col(definition)), 256)


def _json_string(c: Column) -> Column:
    """A string as a JSON literal with non-ASCII characters kept."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def fragment_id(parent_id, digest, start, end, index, parent_is_int: bool | Column = False) -> Column:
    """The UUID of a fragment, from its parent's id (a number stays a number), source hash, range and index."""
    parent = _col(parent_id).cast("string")
    is_int = F.lit(parent_is_int) if isinstance(parent_is_int, bool) else parent_is_int
    shown = F.when(is_int, parent).otherwise(_json_string(parent))
    body = F.concat(F.lit("["), F.concat_ws(", ", shown, _json_string(_col(digest)), *[_col(c).cast("string") for c in (start, end, index)]), F.lit("]"))
    return _uuid(F.sha1(F.concat(F.unhex(F.lit(FRAGMENT_NAMESPACE)), F.encode(body, "UTF-8"))), 5)


def collection_name(identifier: Column | str, prefix: str = "vc") -> Column:
    """prefix_ and twelve digits of the SHA-256 of an identifier without trailing slashes."""
    return F.concat(F.lit(prefix + "_"), F.substr(F.sha2(F.regexp_replace(_col(identifier), "/+$", ""), 256), F.lit(1), F.lit(12)))


def fact_text(subject, predicate, obj, subject_type, object_type, context) -> Column:
    """The searchable text of a fact; empty types and contexts are skipped."""
    bracket = lambda c: F.when(F.length(_col(c)) > 0, F.concat(F.lit("("), _col(c), F.lit(")")))
    return F.concat_ws(" ", _col(subject), F.replace(_col(predicate), F.lit("_"), F.lit(" ")), _col(obj), bracket(subject_type), bracket(object_type), F.nullif(_col(context), F.lit("")))


def glossary_text(term, expansion, definition, domain, aliases) -> Column:
    """The searchable text of a glossary entry."""
    return F.concat_ws(" ", _col(term), _col(expansion), _col(definition), F.nullif(_col(domain), F.lit("")), _col(aliases))


def note_text(title, tags, category) -> Column:
    """Title, tags and category of a note, one a line; a blank title is an error."""
    title, tags, category = _col(title), _col(tags), _col(category)
    checked = F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, title).otherwise(F.raise_error(F.lit("a note needs a title")).cast("string"))
    shown = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n", checked, shown, F.when(F.length(category) > 0, F.concat(F.lit("Category: "), category)))
