"""Toxicity by weak supervision.

Voters are lexicon entries and patterns: listed insults, words and word stems that
a bounded sample of labelled rows shows almost only in toxic texts, and shapes
of address. A generative label model (votes given the class, fitted by
expectation-maximisation without labels) estimates each voter's
accuracy; correlations of voters beyond what the class explains are estimated from the
residuals, and correlated voters share their weight. Its posteriors train a
logistic regression on vote features, which scores every text.

Only rows of `labels` with crc32(doc_id as text) mod 5 <> 0 are learnt from, at
most `max_labelled`; doc_id, source, lang and labels are no features.

Defined results: null and empty texts get the score of a text without votes;
rows that repeat get equal scores; of labelled rows that share a doc_id, the one of the smallest
text is learnt from; a null doc_id is not held out; without any
labels of both kinds only the listed words vote; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, durable, forget, labelled_texts, shingle_sets

MAX_LABELLED = 20_000
MAX_MINED = 384
#: A mined entry is in at least so many different toxic texts, and in this share of them.
MIN_TOXIC = 4
MIN_SHARE = 0.015
MIN_RATIO = 25.0

#: Listed insults; a trailing * marks a stem.
LISTED = {
    "en": "idiot* moron* stupid* scum scumbag* trash worthless pathetic disgusting loser* clown* dumbass* imbecile* vermin filth* bastard* bitch* asshole* retard* cretin* jerk degenerate*".split(),
    "de": "idiot* dummkopf* trottel* abschaum arschloch* schwachkopf* drecksack* depp vollidiot* wertlos* ekelhaft* versager*".split(),
    "fr": "crétin* imbécile* connard* salaud* ordure* raclure* débile* abruti* minable* dégoûtant*".split(),
    "es": "idiota* imbécil* estúpid* escoria basura* asqueros* payaso* pendej* cabrón* inútil* patétic*".split(),
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


@dataclass
class Voters:
    """Entries (word or stem*), found by one automaton over the lower-cased text."""

    entries: list[str]

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "_automaton": None}

    @property
    def names(self) -> list[str]:
        return [*self.entries, "#two kinds", "#addressed", "#shouted"]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each voter finds something in each text."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, e in enumerate(self.entries):
                key = e.rstrip("*")
                self._automaton.add_word(key, (*self._automaton.get(key, ()), i))
            if self.entries:
                self._automaton.make_automaton()
        n = len(self.entries)
        out = np.zeros((len(texts), n + 3), np.int32)
        if not n:
            return out
        for row, text in enumerate(texts):
            low = (text or "").lower()
            hit = False
            for end, found in self._automaton.iter(low):
                for i in found:
                    e = self.entries[i]
                    start = end - len(e.rstrip("*")) + 1
                    if start and is_letter(low[start - 1]):
                        continue
                    if e[-1] != "*" and end + 1 < len(low) and is_letter(low[end + 1]):
                        continue
                    out[row, i] += 1
                    hit = True
                    before = low[max(0, start - 12) : start].split()
                    out[row, n + 1] += bool(before) and before[-1] in ("you", "du", "tu", "usted", "vous", "sie", "your", "are")
                    out[row, n + 2] += low[end + 1 : end + 2] == "!"
            if hit:
                out[row, n] = (out[row, :n] > 0).sum() > 1
        return out


def text_keys(sample: DataFrame) -> DataFrame:
    """label, text, key of each row; copies and most near copies share a key (the smallest of a text's 5-word shingles)."""

    def each(batches):
        for batch in batches:
            keys = [int(s[0]) >> 1 if len(s) else 0 for s in shingle_sets(batch.column(1), 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["label", "text", "key"])

    return sample.select("label", "text").mapInArrow(each, "label int, text string, key long")


def mine(sample: DataFrame, most: int) -> list[str]:
    """Words and stems (of 4 to 6 letters) that many different toxic texts of the sample have and other texts hardly.

    Copies of one text count once, or its every word would seem to point to toxicity.
    """
    one = durable(text_keys(sample.repartition(int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}]+"))
    stems = [F.when(F.length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("*"))).otherwise(F.col("w")) for n in (4, 5, 6)]
    tokens = one.select("label", "key", F.explode(words).alias("w")).where("length(w) >= 3").select("label", "key", F.explode(F.array_distinct(F.array("w", *stems))).alias("e")).distinct()
    totals = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.countDistinct("key").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    seen = tokens.groupBy("e").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("t") >= max(MIN_TOXIC, MIN_SHARE * n1))
    ratio = ((F.col("t") + 0.5) / n1) / ((F.col("c") + 0.5) / n0)
    rows = seen.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("t"), F.desc("ratio"), "e").limit(most).collect()
    forget(one)
    return simplest({r["e"]: r["t"] for r in rows})


def simplest(found: dict[str, int]) -> list[str]:
    """found without entries that others cover: of stems of one another that occur nearly as often the longest, else the shortest."""
    stems = [e for e in found if e[-1] == "*"]
    longer = lambda a, b: len(b) > len(a) and b.startswith(a[:-1]) and found[b] >= 0.9 * found[a]
    stems = [a for a in stems if not any(longer(a, b) for b in stems)]
    covered = lambda e: any(e != a and e.rstrip("*").startswith(a[:-1]) for a in stems)
    return [e for e in found if (e in stems or e[-1] != "*") and not covered(e)]


# ------------------------------------------------------------------ models
@dataclass
class LabelModel:
    """A voter votes (for toxicity) or abstains; each class has a rate for each voter, and one for no votes at all.

    A single abstention says nothing: voters are bound to their languages and words.
    """

    prior: float
    rate1: np.ndarray
    rate0: np.ndarray
    none1: float
    none0: float
    weight: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """Share of a voter's votes that are right."""
        hit = self.prior * self.rate1
        return hit / (hit + (1 - self.prior) * self.rate0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        none = ~votes.any(axis=1)
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.rate1 / self.rate0))
        logit += np.where(none, np.log(self.none1 / self.none0), np.log((1 - self.none1) / (1 - self.none0)))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def correlations(votes: np.ndarray, posterior: np.ndarray, model: LabelModel) -> np.ndarray:
    """Correlations of voters that the class does not explain."""
    left = votes - np.outer(posterior, model.rate1) - np.outer(1 - posterior, model.rate0)
    sd = np.sqrt((left**2).mean(axis=0)) + 1e-9
    return (left.T @ left) / len(votes) / np.outer(sd, sd)


def fit_label_model(votes: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation-maximisation, begun from 'any vote is a toxic vote'; weights follow the correlations after half the rounds."""
    n, m = votes.shape
    none = ~votes.any(axis=1)
    q = np.where(none, 0.02, 0.95)
    weight = np.ones(m)
    model = None
    for i in range(rounds):
        prior = float(np.clip(q.mean(), 1e-4, 0.5))
        rate1 = np.clip((q @ votes + 0.1) / (q.sum() + 1.0), 1e-6, 0.999)
        rate0 = np.clip(((1 - q) @ votes + 0.1) / ((1 - q).sum() + 1.0), 1e-7, 0.5)
        model = LabelModel(prior, rate1, rate0, (q @ none + 0.1) / (q.sum() + 1.0), ((1 - q) @ none + 0.1) / ((1 - q).sum() + 1.0), weight)
        q = model.posterior(votes)
        if i == rounds // 2:
            rho = np.abs(correlations(votes, q, model))
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + np.where(rho > 0.2, rho, 0).sum(axis=1))
    return model


def screened(counts: np.ndarray, labels: np.ndarray, entries: list[str]) -> list[str]:
    """entries without those that the sample shows mostly in texts that are not toxic."""
    votes = counts[:, : len(entries)] > 0
    right, wrong = votes[labels == 1].sum(axis=0), votes[labels == 0].sum(axis=0)
    return [e for e, r, w in zip(entries, right, wrong, strict=True) if w < max(4, r)]


def fit_logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(counts: np.ndarray) -> np.ndarray:
    votes = (counts > 0).astype(float)
    return np.hstack([votes, np.log1p(counts.sum(axis=1, keepdims=True)), votes.any(axis=1, keepdims=True)])


@dataclass
class Scorer:
    voters: Voters
    coefficients: np.ndarray
    label_model: LabelModel | None = None

    def column(self, text: Column) -> Column:
        voters, w = self.voters, self.coefficients

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            out = []
            for first in range(0, len(texts), 512):
                x = features(voters.counts(texts.slice(first, 512).to_pylist()))
                out.append(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35))))
            return pa.array(np.concatenate(out) if out else np.zeros(0))

        return score(text)


def fit(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_mined: int = MAX_MINED) -> Scorer:
    known = durable(bounded_labels(labels, "toxic", max_labelled, where=~held_out(F.col("doc_id"))))
    sample = durable(labelled_texts(documents, known))  # max_labelled rows at most
    listed = sorted({e for words in LISTED.values() for e in words})
    mined = mine(sample, max_mined)
    voters = Voters(sorted({*listed, *mined}))
    names = len(voters.names)

    def count(batches):
        for batch in batches:
            counts = voters.counts(batch.column(1).to_pylist())
            found = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([c[at] for c, at in zip(counts, found, strict=True)], pa.list_(pa.int32()))], ["label", "at", "n"])

    # max_labelled rows at most, and of each the voters that vote, len(voters) at most.
    rows = sample.select("label", "text").mapInArrow(count, "label int, at array<int>, n array<int>").collect()
    forget(known, sample)
    counts = np.zeros((len(rows), names), np.int32)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    if not len(counts):
        # Nothing to fit on: any listed word decides.
        w = np.zeros(names + 3)
        w[-2], w[-1] = 6.0, -3.0
        return Scorer(voters, w)
    kept = screened(counts, np.array([r["label"] for r in rows]), voters.entries)
    columns = [voters.names.index(e) for e in kept] + list(range(names - 3, names))
    voters, counts = Voters(kept), counts[:, columns]
    votes = (counts > 0).astype(float)
    model = fit_label_model(votes)
    return Scorer(voters, fit_logistic(features(counts), model.posterior(votes)), model)


def score(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    scorer = fit(documents, labels, **options)
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer.column(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
