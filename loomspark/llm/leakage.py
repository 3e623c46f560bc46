"""Evaluation texts inside training texts: random-walk embedding, bit-sampling hashes, exact verification."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.skew import HOT_ROWS, salted_join
from loomspark.session import cut_lineage

#: Successive words that make a leak, and edits of words that the search tolerates in them.
WINDOW, EDITS = 12, 2
#: Independent random walks, hash tables per walk, sampled positions per table.
WALKS, TABLES, SAMPLED = 8, 4, 8
#: Successive words of which a filter knows those of the items, and the bounds of its size in bits (as powers of two).
GRAM = 3
LEAST_BITS, MOST_BITS = 16, 28
#: Characters of text that are searched at once, at most (or one text).
SLICE = 4_000_000
#: A process remembers the hashes of so many words.
REMEMBERED = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of a text, in lower case."""
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        own = self[word] = xxhash.xxh64_intdigest(word)
        return own


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM words; the runs that begin too late for that are left out."""
    n = max(0, len(words) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = _mixed(out ^ words[k : k + n])
    return out


def walks(windows: np.ndarray, seed: int = 11) -> np.ndarray:
    """(windows, WALKS * TABLES) keys of windows, one row of word hashes each.

    A walk goes through the words of a window for three times their number of steps, at each step staying
    or moving on by a bit that the word and the step decide; the words it is at form a string in which
    edits have become substitutions, nearly in place. A table samples some positions of that string.
    Equal windows have equal walks and so meet in every table.
    """
    n, width = windows.shape
    rng = np.random.default_rng(seed)
    steps = 3 * width
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1)
    rows = np.arange(n)
    keys = np.empty((n, WALKS * TABLES), np.uint64)
    for walk in range(WALKS):
        salts = rng.integers(1, 2**63 - 1, steps).astype(np.uint64)
        sampled = [set(rng.choice(steps, SAMPLED, replace=False).tolist()) for _ in range(TABLES)]
        own = [np.full(n, walk * TABLES + t + 1, np.uint64) for t in range(TABLES)]
        at = np.zeros(n, np.int64)
        for step in range(steps):
            word = padded[rows, at]
            for t, positions in enumerate(sampled):
                if step in positions:
                    own[t] = _mixed(own[t] ^ word)
            at = np.minimum(width, at + (_mixed(word ^ salts[step]) & np.uint64(1)).astype(np.int64))
        for t in range(TABLES):
            keys[:, walk * TABLES + t] = own[t]
    return keys


def edit_distances(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """The edit distance in words of the windows in equal rows; any number above `edits` for those farther apart."""
    n, w = a.shape
    # Fewer than w - edits words that have an equal one at most `edits` places away: too far apart.
    close = np.zeros(a.shape, bool)
    for shift in range(-edits, edits + 1):
        x, y = slice(max(0, shift), w + min(0, shift)), slice(max(0, -shift), w - max(0, shift))
        close[:, x] |= a[:, x] == b[:, y]
    out = np.full(n, w)
    worth = np.flatnonzero(close.sum(1) >= w - edits)
    a, b = a[worth], b[worth]
    row = np.repeat(np.arange(w + 1)[None], len(worth), 0)
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(w):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (a[:, i] != b[:, j]))
        row = new
    out[worth] = row[:, w]
    return out


def _binary(windows: np.ndarray) -> pa.Array:
    """One binary value per row."""
    flat = np.ascontiguousarray(windows)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * (flat.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, word hashes of all texts, index after the last word of each text) for (id, text) in parts of bounded size."""
    hashes = _Hashes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        a = 0
        while a < len(texts):
            b, size, words, ends = a, 0, [], []
            while b < len(texts) and (b == a or size < SLICE):
                size += len(texts[b] or "")
                words.extend(map(hashes.__getitem__, words_of(texts[b])))
                ends.append(len(words))
                b += 1
            yield ids.slice(a, b - a), np.array(words, np.uint64), np.array(ends, np.int64)
            a = b


def _windows(texts: DataFrame, id_col: str, text_col: str, window: int, passing: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """(id, pos, w): every window of every text, or those of which enough runs are known: `passing` of the words."""
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("w", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, ends in _hashed(batches):
            if len(words) < window:
                continue
            starts = np.arange(len(words) - window + 1)
            if passing is not None:
                starts = starts[passing(words)]
            text = np.searchsorted(ends, starts, side="right")
            inside = starts + window <= ends[text]
            starts, text = starts[inside], text[inside]
            first = np.concatenate([[0], ends])[text]
            views = np.lib.stride_tricks.sliding_window_view(words, window)
            for i in range(0, len(starts), 100_000):
                s, t = starts[i : i + 100_000], text[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), pa.array((s - first[i : i + 100_000]).astype(np.int32)), _binary(views[s])], schema=schema)

    own = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") >= 2 * window - 1)
    return own.mapInArrow(run, "id long, pos int, w binary")


def _gram_filter(items: DataFrame, text_col: str, most_bits: int) -> tuple[bytes, int]:
    """(bits, number of them as a power of two): a bit map in which the runs of GRAM words of all items are set.

    Executors set the bits, and the driver gets at most 2 ** most_bits of them, whatever the items are.
    """
    size = items.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    bits = min(most_bits, max(LEAST_BITS, int(size).bit_length() + 2))
    schema = pa.schema([("slot", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, _ in _hashed(batches):
            at = np.unique(_grams(words) & np.uint64((1 << bits) - 1))
            slots, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(at):
                set_ = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(set_.view(np.int64))], schema=schema)

    own = items.select(F.lit(0).cast("long"), text_col).filter(F.length(text_col) > 0)
    table = own.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    # No task sends more than a few hundred kilobytes.
    table = table.repartition(max(1, (1 << (bits - 6)) // 16_384)).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table.column("slot").to_numpy()] = table.column("bits").to_numpy()
    return out.tobytes(), bits


def _keyed(windows: DataFrame, width: int, name: str) -> DataFrame:
    """(key, name) of distinct windows (name, w): one row per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = walks(_matrix(batch.column(1), width))
                row = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(row)], names=["key", name])

    return windows.select(name, "w").mapInArrow(run, f"key long, {name} long")


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, edits: int = EDITS, most_bits: int = MOST_BITS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc_id, item_id, edits, windows, first_word): items of which a passage of `window` words is in a document.

    edits is the least number of word edits (0: the passage is there word for word), windows how many
    pairs of passages match that well, first_word where the first one begins in the document. Matches
    without edits are always found; the tables are laid out so that of those with one or two edits more
    than nine in ten are, too.

    One pass over all words of all documents keeps the windows that share enough runs of three words with
    some item: each edit destroys at most three runs, so no match is lost. The runs are known by a bit map
    of at most 2 ** `most_bits` bits, the only thing that is broadcast; with more items than that suits,
    more windows pass and are dismissed by the join. Windows of documents and items then meet by the keys
    of their tables in a join, each distinct window once, and the exact edit distance decides. A bucket or
    a passage with `hot_rows` or more windows is split over several tasks. Items never go to the driver.

    Null, empty and too short texts match nothing; rows with the same id are one document or item, null
    ids too; other columns are ignored.
    """
    spark = docs.sparkSession
    bitmap, bits = _gram_filter(items, text, most_bits)
    shared = spark.sparkContext.broadcast(bitmap)
    runs, least = window - GRAM + 1, window - GRAM + 1 - GRAM * edits

    def passing(words: np.ndarray) -> np.ndarray:
        known = np.frombuffer(shared.value, np.uint64)
        at = _grams(words) & np.uint64((1 << bits) - 1)
        set_ = (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        total = np.concatenate([[0], np.cumsum(set_.astype(np.int64))])
        n = len(words) - window + 1
        return np.flatnonzero(total[runs : runs + n] - total[:n] >= least)

    in_docs = cut_lineage(_windows(docs, doc_id, text, window, passing)).withColumnRenamed("w", "wd")
    in_items = _windows(items, item_id, text, window, None).withColumnRenamed("w", "wi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = edit_distances(_matrix(batch.column(0), window), _matrix(batch.column(1), window), edits)
                good = pa.array(np.flatnonzero(away <= edits))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), pa.array(away[away <= edits].astype(np.int32))], names=["wd", "wi", "edits"])

    # Keys travel with a number for their window; should two windows share one, both are verified.
    of_docs = in_docs.select("wd", F.xxhash64("wd").alias("d")).distinct()
    of_texts = in_items.select("wi", F.xxhash64("wi").alias("i")).distinct()
    keys = cut_lineage(_keyed(of_docs.withColumnRenamed("wd", "w"), window, "d"))
    met = salted_join(keys, _keyed(of_texts.withColumnRenamed("wi", "w"), window, "i"), ["key"], ["d"], hot_rows).select("d", "i").distinct()
    pairs = met.join(of_docs, "d").join(of_texts, "i").select("wd", "wi").mapInArrow(verify, "wd binary, wi binary, edits int")
    of_items = in_items.groupBy(F.col("id").alias("item_id"), "wi").agg(F.count(F.lit(1)).alias("times"))
    of_windows = salted_join(of_items, pairs, ["wi"], ["item_id"], hot_rows).groupBy("wd", "item_id", "edits").agg(F.sum("times").alias("times"))
    hits = salted_join(in_docs.withColumnRenamed("id", "doc_id"), of_windows, ["wd"], ["doc_id", "pos"], hot_rows)
    each = hits.groupBy("doc_id", "item_id", "edits").agg(F.sum("times").cast("int").alias("windows"), F.min("pos").alias("first_word"))
    best = each.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "windows", "first_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.edits", "b.windows", "b.first_word")


def leaked_word_for_word(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the leaks with a passage that is there without any edit."""
    return leaked_items(docs, items).filter("edits = 0").select("doc_id", "item_id")
