"""Embedding texts with a pluggable model: distinct texts only, cached vectors first."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.cache import usable

Embedder = Callable[[list[str]], "np.ndarray"]

# What goes before a text, by profile and role; {instruction} is the caller's.
PREFIXES = {
    ("raw", "query"): "",
    ("raw", "document"): "",
    ("qwen3", "query"): "Instruct: {instruction}\nQuery:",
    ("qwen3", "document"): "",
    ("nemotron3", "query"): "query: ",
    ("nemotron3", "document"): "passage: ",
}


def prefix(profile: str = "raw", role: str = "document", instruction: str = "") -> str:
    if (profile, role) not in PREFIXES:
        raise ValueError(f"unknown profile or role: {profile}, {role}")
    return PREFIXES[profile, role].replace("{instruction}", instruction)


class HashingEmbedder:
    """Unit vectors from hashed words: deterministic, for tests and as a baseline without a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "big") % self.dim] += 1 if h[4] & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out[norm[:, 0] == 0, 0] = 1.0
        return out / np.where(norm == 0, 1.0, norm)


def checked(vectors: np.ndarray, texts: int, dim: int | None) -> np.ndarray:
    """The vectors if there is one per text, of the right width and finite."""
    vectors = np.asarray(vectors, np.float32)
    if vectors.ndim != 2 or len(vectors) != texts:
        raise ValueError(f"{texts} texts, but vectors of shape {vectors.shape}")
    if dim and vectors.shape[1] != dim:
        raise ValueError(f"vectors of {vectors.shape[1]} numbers, not {dim}")
    if not np.isfinite(vectors).all():
        raise ValueError("a vector has a number that isn't finite")
    return vectors


def requests(texts: list[str], most: int, most_bytes: int) -> Iterator[list[str]]:
    """The texts in batches of bounded number and size; one larger than a batch goes alone."""
    batch, size = [], 0
    for t in texts:
        n = len(t.encode())
        if batch and (len(batch) == most or size + n > most_bytes):
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += n
    if batch:
        yield batch


def embed(df: DataFrame, text: str, make: Callable[[], Embedder], dim: int | None = None, before: str = "", batch: int = 64, most_bytes: int = 1 << 20, concurrency: int | None = None) -> DataFrame:
    """(text, embedding) for the distinct texts of `df`.

    `make` builds the embedder once per task. `concurrency` bounds how many tasks call the model at once.
    A null or empty text is an error of the caller's and gives no row here.
    """
    schema = pa.schema([("text", pa.string()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for part in requests(b.column(0).to_pylist(), batch, most_bytes):
                model = model or make()
                got = checked(model([before + t for t in part]), len(part), dim)
                flat = pa.array(got.ravel(), pa.float32())
                offsets = pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.ListArray.from_arrays(offsets, flat)], schema=schema)

    texts = df.select(F.col(text).alias("text")).filter(F.length("text") > 0).distinct()
    if concurrency:
        texts = texts.repartition(concurrency)
    return texts.mapInArrow(run, "text string, embedding array<float>")


def embed_cached(df: DataFrame, text: str, key, cache: DataFrame, make: Callable[[], Embedder], dim: int, **options) -> tuple[DataFrame, DataFrame]:
    """(text, cache_key, embedding) for the distinct texts, and the new cache rows (cache_key, embedding).

    Only texts without a usable cached vector reach the model. `key` makes the cache key from a text column.
    """
    texts = df.select(F.col(text).alias("text")).filter(F.length("text") > 0).distinct().withColumn("cache_key", key(F.col("text")))
    known = cache.filter(usable(dim)).select("cache_key", "embedding")
    fresh = embed(texts.join(known, "cache_key", "left_anti"), "text", make, dim, **options).withColumn("cache_key", key(F.col("text")))
    hits = texts.join(known, "cache_key").select("text", "cache_key", "embedding")
    return hits.unionByName(fresh.select("text", "cache_key", "embedding")), fresh.select("cache_key", "embedding")


def embed_all(df: DataFrame, text: str, ordinal: str, key, cache: DataFrame, make: Callable[[], Embedder], dim: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((ordinal, embedding) for every row, new cache rows, counts): each distinct text is embedded at most once.

    Results are joined back by text, so rows keep their ordinals and repeats share a vector; a null or
    empty text has a null vector. counts is one row: rows, texts (distinct), cached, made.
    """
    found, fresh = embed_cached(df, text, key, cache, make, dim, **options)
    own = df.select(F.col(ordinal).alias("ordinal"), F.col(text).alias("text"))
    every = own.join(found.select("text", "embedding"), "text", "left").select("ordinal", "embedding")
    texts = own.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("cache_key", key(F.col("text")))
    known = texts.join(cache.filter(usable(dim)).select("cache_key", F.lit(1).alias("hit")), "cache_key", "left")
    counts = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("texts"), F.count("hit").alias("cached"), F.count_if(F.col("hit").isNull()).alias("made"))
    return every, fresh, counts


def request_numbers(df: DataFrame, key: str, text: str, most: int, most_bytes: int) -> DataFrame:
    """(key, request): requests of at most `most` texts and `most_bytes` bytes, as `embed` sends them; one per input partition begins anew."""
    schema = pa.schema([(key, pa.int64()), ("request", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = 0
        for b in batches:
            sizes = [len(x) for x in requests([t or "" for t in b.column(1).to_pylist()], most, most_bytes)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.repeat(np.arange(begun, begun + len(sizes)), sizes))], schema=schema)
            begun += len(sizes)

    return df.select(key, text).mapInArrow(run, f"`{key}` long, request long")
