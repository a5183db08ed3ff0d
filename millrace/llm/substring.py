"""Substring dedup by sliding spans of sentences.

A text is cut into sentences (a word that ends in . ! ? or their wide forms, or a
line break, ends one; a sentence of more than `unit_words` words counts as several,
cut before each word whose hash is the least among its neighbours, so that the
cuts follow the words and not their places). In a long stretch without spaces
each character of a script of three bytes or more is a word. A run is `run`
consecutive sentences, and further ones, after or before them, until it has
`min_words` words. Runs are hashed; the runs of all documents are joined
by hash, and the sentences that any repeated run covers go, except for the run's
first place: the smallest doc_id, and in it the first position. White space
does not count in the comparison. A passage is found from its first whole sentence on: one that
begins in the middle of a sentence keeps that sentence's end.

Runs that very many documents share meet on one key: they are counted by partial
aggregation, and the join that marks them is one that Spark's adaptive skew join splits.

Defined results: null stays null; texts without a whole run never match; rows
that share a doc_id count as one document (they never take each other's
spans); rows without doc_id come first of all; an empty table gives an
empty result; all other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, byte_chunks, free_name, mix, span_hashes, words

RUN = 3
UNIT_WORDS = 12
MIN_WORDS = 10
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_WIDE_END = [int.from_bytes(c.encode()) for c in "。！？｡"]
#: Bytes from which a word counts as a stretch without spaces.
STRETCH = 48


def split_stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, with each wide character of a long one as a word of its own."""
    long = ends - starts > STRETCH
    if not long.any():
        return starts, ends, row
    edge = np.zeros(len(data) + 1, np.int64)
    edge[starts[long] + 1] += 1
    edge[ends[long]] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    lead = (data & 0xC0) != 0x80
    wide = data >= 0xE0
    last = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
    at = np.flatnonzero(lead & inside)
    first = np.sort(np.concatenate([starts, at[wide[at] | wide[last[at - 1]]]]))
    of = np.searchsorted(starts, first, "right") - 1
    return first, np.minimum(ends[of], np.append(first[1:], len(data))), row[of]


def ends_sentence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    code = sum(data[np.maximum(ends - k, 0)].astype(np.int64) << (8 * (k - 1)) for k in (1, 2, 3))
    return _END[data[ends - 1]] | np.isin(code, _WIDE_END)


def least_among(hashed: np.ndarray, sentence: np.ndarray, reach: int) -> np.ndarray:
    """Whether each word's hash is the least of those up to reach words away in its sentence (ties: all of them)."""
    out = np.ones(len(hashed), bool)
    for k in range(1, min(reach, len(hashed) - 1) + 1):
        apart = sentence[k:] != sentence[:-k]
        out[k:] &= apart | (hashed[k:] <= hashed[:-k])
        out[:-k] &= apart | (hashed[:-k] <= hashed[k:])
    return out


def units(data: np.ndarray, offsets: np.ndarray, unit_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, row, words and hash of each sentence."""
    starts, ends, row = split_stretches(data, *words(data, offsets))
    n = len(starts)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.ones(n, bool)
    stop[:-1] = ends_sentence(data, ends[:-1]) | (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
    first = np.ones(n, bool)
    first[1:] = stop[:-1]
    each = span_hashes(data, starts, ends)
    sentence = np.cumsum(first) - 1
    long = np.bincount(sentence)[sentence] > unit_words
    first |= long & least_among(each, sentence, max(1, unit_words // 4))
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * up[:n])])
        hashed = mix((total[at + size] - total[at]) * down[at] + size.astype(np.uint64))
    return starts[at], row[at], size, hashed


def spans(data: np.ndarray, offsets: np.ndarray, run: int, unit_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and row of each sentence; index of the first sentence, number of sentences and hash of each run."""
    start, row, size, hashed = units(data, offsets, unit_words)
    n = len(start)
    if n < run:
        return start, row, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([[0], np.cumsum(size)])
    here = np.arange(n)
    # The shortest run from each sentence on, and up to each.
    after = np.maximum(here + run, np.searchsorted(total, total[:-1] + min_words))
    before = np.minimum(here + 1 - run, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    ok = after <= n
    ok[ok] = row[after[ok] - 1] == row[ok]
    back = before >= 0
    back[back] = row[before[back]] == row[back]
    pairs = np.unique(np.concatenate([here[ok] * (n + 1) + after[ok], before[back] * (n + 1) + here[back] + 1]))
    at, end = pairs // (n + 1), pairs % (n + 1)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[:n])])
        return start, row, at, end - at, mix((summed[end] - summed[at]) * down[at] + (end - at).astype(np.uint64))


def span_table(docs: DataFrame, run: int, unit_words: int, min_words: int) -> DataFrame:
    """h, doc_id, key of each distinct run of each row of docs (doc_id, text, key)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_chunks(batch.column(1)):
                _, row, at, _, h = spans(data, offsets, run, unit_words, min_words)
                of = row[at]
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                ids, keys = (batch.column(c).slice(first, last - first).take(pa.array(of[new])) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), ids, keys], ["h", "doc_id", "key"])

    return docs.mapInArrow(each, "h long, doc_id long, key long")


def cleaned(docs: DataFrame, gone_name: str, added: tuple[str, str], run: int, unit_words: int, min_words: int) -> DataFrame:
    """docs (gone_name: hashes of runs to remove; text; others) with text cleaned, and numbers of sentences and removed ones as the last columns."""
    names = [c for c in docs.columns if c != gone_name]
    schema = docs.drop(gone_name).schema.add(added[0], "integer").add(added[1], "integer")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, text = batch.column(gone_name), batch.column("text")
            out, n_all, n_removed = [], [], []
            for first, last, data, offsets in byte_chunks(text):
                start, row, at, length, h = spans(data, offsets, run, unit_words, min_words)
                bounds = np.searchsorted(row, np.arange(last - first + 1))
                run_bounds = np.searchsorted(row[at], np.arange(last - first + 1))
                for i in range(last - first):
                    a, b = bounds[i], bounds[i + 1]
                    mine, lengths, hashes = (x[run_bounds[i] : run_bounds[i + 1]] for x in (at, length, h))
                    drop = np.zeros(len(hashes), bool)
                    if len(hashes):
                        drop[:] = True
                        drop[np.unique(hashes, return_index=True)[1]] = False
                        marked = gone[first + i].values
                        if marked is not None and len(marked):
                            drop |= np.isin(hashes, np.asarray(marked).view(np.uint64))
                    n_all.append(int(b - a))
                    if not drop.any():
                        out.append(text[first + i].as_py())
                        n_removed.append(0)
                        continue
                    depth = np.zeros(b - a + 1, np.int64)
                    np.add.at(depth, mine[drop] - a, 1)
                    np.add.at(depth, mine[drop] - a + lengths[drop], -1)
                    covered = np.cumsum(depth)[: b - a] > 0
                    edges = np.append(start[a:b], offsets[i + 1])
                    edges[0] = offsets[i]
                    kept = [data[edges[j] : edges[j + 1]].tobytes() for j in np.flatnonzero(~covered)]
                    out.append(b"".join(kept).decode())
                    n_removed.append(int(covered.sum()))
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_all, pa.int32()), pa.array(n_removed, pa.int32())], names=[*names, *added])

    return docs.mapInArrow(each, schema)


def dedup(documents: DataFrame, *, run: int = RUN, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with repeated spans removed from text, and the columns n_sentences and n_removed."""
    doc_id, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.col("text").cast("string")
    table = span_table(documents.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")), run, unit_words, min_words)
    repeated = table.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    gone, of, key = (free_name(documents, name) for name in ("gone", "of", "key"))
    # A list holds runs of one text only, however many rows share its doc_id.
    marks = table.join(repeated, "h").where("doc_id <> first").groupBy("doc_id", "key").agg(F.collect_set("h").alias(gone)).withColumnsRenamed({"doc_id": of, "key": key})
    marked = documents.withColumn("text", text).join(marks, (doc_id == F.col(of)) & (F.xxhash64(text) == F.col(key)), "left").drop(of, key)
    added = (free_name(documents, "n_sentences"), free_name(documents, "n_removed"))
    return cleaned(marked, gone, added, run, unit_words, min_words)
