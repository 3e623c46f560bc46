"""Generations: a collection's rows in one embedding space, rebuilt and published as a whole."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from typing import Any
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.fragments import is_derived, lineage_gaps, orphans
from loomspark.sources.tables import Store

_DIGEST = re.compile(r"[0-9a-f]{64}")


@dataclass(frozen=True)
class EmbeddingIdentity:
    """All that decides whether two vectors can be compared."""

    model: str
    endpoint: str
    dimension: int
    namespace: str | None = None
    profile: str = "raw"
    query_prefix: str = ""
    document_prefix: str = ""
    preprocessing: str = "1"
    max_text_chars: int | None = None
    max_input_tokens: int | None = None
    max_input_bytes: int = 0
    reserved_tokens: int = 0
    tokenizer_fingerprint: str | None = None
    tokenizer_add_special_tokens: bool = True
    input_encoding: str = "text"
    tokenizer_implementation: str | None = None
    tokenizer_version: str | None = None
    endpoint_auth_fingerprint: str | None = None

    def __post_init__(self) -> None:
        problems = {
            "dimension": type(self.dimension) is not int or self.dimension <= 0,
            "profile": self.profile not in ("raw", "qwen3", "nemotron3"),
            "preprocessing": not self.preprocessing,
            "limits": any(x is not None and (type(x) is not int or x <= 0) for x in (self.max_text_chars, self.max_input_tokens)) or self.max_input_bytes < 0 or self.reserved_tokens < 0,
            "encoding": self.input_encoding not in ("text", "token_ids"),
            "tokenizer": self.input_encoding == "token_ids" and not (_DIGEST.fullmatch(self.tokenizer_fingerprint or "") and self.tokenizer_implementation and self.tokenizer_version),
        }
        if wrong := [k for k, bad in problems.items() if bad]:
            raise ValueError(f"invalid embedding identity: {', '.join(wrong)}")
        at = urlsplit(self.endpoint.rstrip("/"))
        secret, _, host = at.netloc.rpartition("@")
        if secret:  # only a digest of what was before the host is kept
            object.__setattr__(self, "endpoint_auth_fingerprint", hashlib.sha256(secret.encode()).hexdigest())
        object.__setattr__(self, "endpoint", urlunsplit(at._replace(netloc=host or at.netloc)))
        object.__setattr__(self, "namespace", self.namespace or None)

    def to_dict(self) -> dict[str, Any]:
        own = asdict(self)
        optional = ["endpoint_auth_fingerprint"] if self.endpoint_auth_fingerprint is None else []
        if self.input_encoding == "text":
            optional += ["input_encoding", "tokenizer_implementation", "tokenizer_version"]
        return {k: v for k, v in own.items() if k not in optional}

    @classmethod
    def from_dict(cls, value: dict[str, Any]) -> EmbeddingIdentity:
        return cls(**{f.name: value[f.name] for f in fields(cls) if f.name in value})

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Generation:
    logical: str
    version: str
    identity: EmbeddingIdentity
    migrated: bool


def verified(points: DataFrame) -> None:
    """Raises if the rows have broken lineage or orphans."""
    rows = points.filter("fragment IS NOT NULL").select(*[F.col(f"fragment.{c}").alias(c) for c in ("parent_id", "index", "start", "end", "count", "source_hash")])
    for what, found in (("lineage", lineage_gaps(rows)), ("orphans", orphans(points))):
        if bad := found.limit(1).collect():
            raise ValueError(f"broken {what}: {bad[0]}")


def current(store: Store, name: str) -> Generation | None:
    """The published generation of a collection."""
    if not store.exists(name):
        return None
    own = store._manifest(name)
    identity = own["metadata"].get("identity")
    return Generation(name, own["version"], EmbeddingIdentity.from_dict(identity), False) if identity else None


def ensure_generation(store: Store, name: str, identity: EmbeddingIdentity, rebuild: Callable[[DataFrame], DataFrame]) -> Generation:
    """The collection in the given embedding space.

    If its identity is the same, nothing happens. Otherwise `rebuild` makes all rows anew from the
    canonical ones (children are made from their parents, never copied), the result is written as a
    version that nobody reads yet, its canonical rows are counted and its lineage is checked, and only
    then does the pointer move. A failure leaves the old generation as it was.
    """
    there = current(store, name)
    if there and there.identity == identity:
        return there
    old = store.read(name)
    canonical = old.filter(~is_derived()) if "fragment" in old.columns else old
    version = store.stage(name, rebuild(canonical))
    try:
        written = store.staged(name, version)
        kept = written.filter(~is_derived()) if "fragment" in written.columns else written
        if kept.count() != canonical.count():
            raise ValueError("the rebuilt generation has another number of points")
        if "fragment" in written.columns:
            verified(written)
    except Exception:
        store.unstage(name, version)
        raise
    store.switch(name, version, store.metadata(name) | {"identity": identity.to_dict()})
    return Generation(name, version, identity, there is not None)
