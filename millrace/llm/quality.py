"""Quality by importance resampling.

Two generative models of hashed word n-grams are counted: one of target texts
(labelled good), one of all raw texts. A document's log weight is the sum of
log(p_target / p_raw) over its n-grams; Gumbel noise, keyed by the document,
is added to weight / temperature and the k largest are kept. That samples k documents without
replacement, each draw in proportion to exp(weight / temperature). `k` and `share` (of all rows) say how many;
without either, k is the number of documents whose weight exceeds the cut that best parts labelled good from
labelled bad ones, and with no labels of both kinds nothing is rejected. The sum
makes weights of whole texts differ by far more than the noise of temperature 1, so
the sample then is nearly the k documents of the highest weight, as a filter wants it; a higher
temperature spreads it.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of ASCII
punctuation. A pair of equal tokens counts as one n-gram whatever the token: repeating
itself is a mark of junk that single pairs, each rare, would not show.

The target model and the cut read a bounded sample of labelled rows
(`max_labelled`; of rows that share a doc_id, the one of the smallest text); the raw model reads everything.

Defined results: null and empty texts have weight 0; rows that repeat get equal
keys and stay or go together; ties at the k-th key stay; an empty table gives
an empty result; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, byte_chunks, chain, durable, forget, kth_largest, labelled_texts, span_hashes

BUCKETS = 10_000
MAX_LABELLED = 20_000
_REPEAT = 1

_KIND = np.full(256, 1, np.uint8)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[[*range(0, 33), 127]] = 0


def ngrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For slices of rows: bucket and row of each n-gram (1 and 2 tokens), number of rows, first row."""
    for first, last, data, offsets in byte_chunks(column):
        kind = _KIND[data]
        n = len(kind)
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), last - first, first
            continue
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        change = np.ones(n + 1, bool)
        change[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        row = np.searchsorted(offsets, starts, "right") - 1
        one = span_hashes(data, starts, ends)
        two = chain(one, 2)
        same = row[1:] == row[:-1]
        equal = one[1:] == one[:-1]
        pair = np.where(equal, np.uint64(_REPEAT), two)[same] if len(one) > 1 else np.zeros(0, np.uint64)
        pair_row = row[1:][same] if len(one) > 1 else np.zeros(0, np.int64)
        yield (np.concatenate([one, pair]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, pair_row]), last - first, first


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the one column of texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for bucket, _, _, _ in ngrams(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


class Weights:
    """Log ratio of the two models, by bucket."""

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        smooth = lambda c: (c + 0.5) / (c.sum() + 0.5 * BUCKETS)
        self.ratio = np.log(smooth(target) / smooth(raw)) if target.sum() else np.zeros(BUCKETS)

    def column(self, text: Column) -> Column:
        ratio = self.ratio

        @F.arrow_udf("double")
        def weigh(column: pa.Array) -> pa.Array:
            out = np.zeros(len(column))
            for bucket, row, rows, first in ngrams(column):
                out[first : first + rows] = np.bincount(row, ratio[bucket], minlength=rows)
            return pa.array(out)

        return weigh(text)


def gumbel(doc_id: Column, text: Column, seed: Column) -> Column:
    """Standard Gumbel noise that depends on the row alone."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, text, seed), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best mean of both kinds' accuracies; -inf where a kind is missing."""
    n_good, n_bad = int(good.sum()), int((~good).sum())
    if not n_good or not n_bad:
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    below_bad = np.concatenate([[0], np.cumsum(~g)]) / n_bad
    below_good = np.concatenate([[0], np.cumsum(g)]) / n_good
    allowed = np.concatenate([[True], w[1:] != w[:-1], [True]])
    gain = np.where(allowed, below_bad - below_good, -2)
    i = int(np.argmax(gain))
    if i == 0:
        return -np.inf
    return float((w[i - 1] + (w[i] if i < len(w) else w[i - 1])) / 2)


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Weights, float]:
    """The weights, and the cut that k follows from."""
    docs = documents.select(F.col("text").cast("string"))
    known = durable(bounded_labels(labels, "quality", max_labelled))
    sample = durable(labelled_texts(documents, known))  # max_labelled rows at most
    weights = Weights(bucket_counts(sample.where("label = 1").select("text")), bucket_counts(docs))
    seen = sample.select("label", weights.column(F.col("text")).alias("w")).toPandas()
    forget(known, sample)
    return weights, best_cut(seen["w"].to_numpy(float), seen["label"].to_numpy() == 1)


def key(weight: Column, text: Column, temperature: float, seed: int) -> Column:
    return weight / F.lit(float(temperature)) + gumbel(F.col("doc_id"), text, F.lit(seed))


def resample(documents: DataFrame, labels: DataFrame, *, k: int | None = None, share: float | None = None, temperature: float = 1.0, seed: int = 11, max_labelled: int = MAX_LABELLED) -> tuple[Weights, float, DataFrame]:
    """The weights, the k-th largest key, and the table doc_id, log_weight, key of all rows."""
    weights, cut = fit(documents, labels, max_labelled)
    text = F.col("text").cast("string")
    found = documents.select("doc_id", text.alias("text"), weights.column(text).alias("log_weight"))
    rows = durable(found.select("doc_id", "log_weight", key(F.col("log_weight"), F.col("text"), temperature, seed).alias("key")))
    if k is None:
        k = rows.where(F.col("log_weight") > cut).count() if share is None else round(share * rows.count())
    least = kth_largest(rows, "key", k)
    return weights, (np.inf if least is None else least), rows


def score(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, key, kept for every row of documents."""
    _, least, rows = resample(documents, labels, **options)
    return rows.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(least)).alias("kept"))


def keep_sampled(documents: DataFrame, labels: DataFrame, *, temperature: float = 1.0, seed: int = 11, **options) -> DataFrame:
    """The rows of documents that are sampled, unchanged."""
    weights, least, rows = resample(documents, labels, temperature=temperature, seed=seed, **options)
    forget(rows)
    text = F.col("text").cast("string")
    return documents.where(key(weights.column(text), text, temperature, seed) >= F.lit(least))
