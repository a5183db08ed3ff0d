"""Operators without SQL against plain Python over the same rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, pii, preference, quality, substring

DOCS = "doc_id long, text string"


# ------------------------------------------------------------------ 8
def runs_of(sentences, run=3, least=10):
    """(first, past the last, words) of the shortest runs from each sentence on and up to each."""
    sizes = [len(s.split()) for s in sentences]
    found = set()
    for i in range(len(sentences)):
        j = i + run
        while j <= len(sentences) and sum(sizes[i:j]) < least:
            j += 1
        if j <= len(sentences):
            found.add((i, j))
        a = i + 1 - run
        while a >= 0 and sum(sizes[a : i + 1]) < least:
            a -= 1
        if a >= 0:
            found.add((a, i + 1))
    return [(a, b, " ".join(sentences[a:b])) for a, b in sorted(found)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_match_a_loop(spark, seed):
    r = random.Random(seed)
    vocab = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 9))) + r.choice(".!?") for _ in range(30)]
    passages = [[r.choice(vocab) for _ in range(r.randint(3, 7))] for _ in range(5)]
    docs = {}
    for i in range(40):
        s = []
        while len(s) < 9:
            s += r.choice(passages) if r.random() < 0.4 else [r.choice(vocab) + f" x{i} y{len(s)}."]
        docs[i] = " ".join(s)
    split = {i: re.findall(r"[^.!?]+[.!?]+", t) for i, t in docs.items()}
    split = {i: [s.strip() for s in x] for i, x in split.items()}
    seen = defaultdict(set)
    for i, s in split.items():
        for _, _, words in runs_of(s):
            seen[words].add(i)
    want = {}
    for i, s in split.items():
        gone, here = set(), set()
        for a, b, words in runs_of(s):
            if i != min(seen[words]) or words in here:
                gone |= set(range(a, b))
            here.add(words)
        want[i] = " ".join(x for k, x in enumerate(s) if k not in gone)
    rows = spark.createDataFrame(list(docs.items()), DOCS)
    got = {x["doc_id"]: x["text"].strip() for x in substring.dedup(rows).collect()}
    assert got == want and sum(len(t) < len(docs[i]) for i, t in got.items()) > 10


def test_a_passage_that_a_third_of_all_rows_share(spark):
    p = "The quick brown fox jumps over it. Then it runs away from here. A dog sees that and barks."
    rows = [(i, f"Row {i} says this.\n{p}\nEnd {i}." if i % 3 == 0 else f"Row {i} is by itself here.") for i in range(900)]
    found = substring.dedup(spark.createDataFrame(rows, DOCS).repartition(8))
    assert found.where(F.col("text").contains("quick brown")).select("doc_id").collect() == [(0,)] and found.where("n_removed = 3").count() == 299


# ------------------------------------------------------------------ 9
def test_weights_match_a_loop(spark):
    r = random.Random(3)
    words = ["ab", "Cd", "e,f", "--", "é", "12", "ab ab"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "ab " * 60_000)]
    labels = [(i, i % 3 and 1, 0) for i in range(0, 80, 2)]
    buckets = {i: [int(b) for part in quality.ngrams(pa.array([t], pa.string())) for b in part[0]] for i, t in docs}
    good = {i for i, q, _ in labels if q == 1}
    target, raw = Counter(b for i in good for b in buckets[i]), Counter(b for x in buckets.values() for b in x)
    log = lambda c, b: np.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * quality.BUCKETS))
    want = {i: sum(log(target, b) - log(raw, b) for b in x) for i, x in buckets.items()}
    out = quality.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=20)
    got = {x["doc_id"]: x for x in out.collect()}
    assert all(got[i]["log_weight"] == pytest.approx(w, rel=1e-6, abs=1e-9) for i, w in want.items())
    best = sorted(got.values(), key=lambda x: -x["key"])[:20]
    assert {x["doc_id"] for x in best} == {i for i, x in got.items() if x["kept"]}


# ------------------------------------------------------------------ 1
def test_replacement_matches_known_places(spark):
    """Texts made of known pieces: all between entities stays, and the mapping is one to one and the same everywhere."""
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    makers = {
        "email": lambda: f"{r.choice('abc')}{digits(3)}@{r.choice(['mail', 'corp'])}.org", "ip": lambda: ".".join(str(r.randint(10, 250)) for _ in range(4)),
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "name": lambda: "Mr " + r.choice("BCDFG") + "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(3)), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    entities = {k: [m() for _ in range(25)] for k, m in makers.items()}
    docs = []
    for i in range(120):
        kinds = [r.choice(list(makers)) for _ in range(r.randint(0, 5))]
        docs.append([(k, r.choice(entities[k])) for k in kinds])
    text = lambda pieces: "start; " + " ".join(f"see <{e}>;" for _, e in pieces)
    rows = [(i, text(p)) for i, p in enumerate(docs)] + [(500, "x" * 200_000 + " " + text(docs[1]))]
    out = pii.replace(spark.createDataFrame(rows, DOCS)).collect()
    mapping = {}
    for row in out:
        pieces = docs[1 if row["doc_id"] == 500 else row["doc_id"]]
        new = row["text"][200_001:] if row["doc_id"] == 500 else row["text"]
        found = re.findall(r"see <([^>]*)>;", new)
        assert row["kinds"] == [k for k, _ in pieces] and new == "start; " + " ".join(f"see <{e}>;" for e in found)
        for (kind, old), e in zip(pieces, found, strict=True):
            assert mapping.setdefault((kind, old), e) == e != old
    by_kind = defaultdict(list)
    for (kind, _), e in mapping.items():
        by_kind[kind].append(e)
    assert all(len(set(v)) == len(v) and not set(v) & set(entities[k]) for k, v in by_kind.items()) and len(mapping) > 90


def test_thousands_of_names_keep_gender_script_and_stay_distinct(spark):
    r = random.Random(7)
    made = sorted({r.choice("QXYZ") + "".join(r.choice("aeo") + r.choice("wqxzj") for _ in range(4)) for _ in range(6000)})[:3000]
    rows = [(i, f"{('Mrs', 'Mr')[i % 2]} {('Anna', 'Peter')[i % 2]} {x}") for i, x in enumerate(made)]
    new = [x["text"].split() for x in pii.replace(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]
    assert len({tuple(x[1:]) for x in new}) == len(made) > 2500
    for i, (title, given, family) in enumerate(new):
        gender = "fm"[i % 2]
        assert title == ("Mrs", "Mr")[i % 2] and (given in pii.GIVEN["latin", gender] or given.endswith(tuple(pii.LAST["latin", gender])))
        assert family in pii.FAMILY["latin"] or family.endswith(tuple(pii.LAST["latin", "s"]))


# ------------------------------------------------------------------ 3
def test_both_encoders_give_the_same_ids():
    public = pytest.importorskip("public_tokenizers")
    encode = packing.Ids(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"))
    slow = lambda t: np.asarray(encode.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
    assert encode.fast is not None
    r = random.Random(2)
    signs = [chr(c) for c in range(0x20, 0x3000, 7)] + list("  \t\r\n\x0b\x85\xa0 　'’ſ") + ["'s", "'LL", "ab", "12", "\U0001f600", "́", "﻿", "\x00", "漢字", "ไทย", "हिन्दी"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(a, a + 512) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 512)]
    texts += ["x" * 50_000, "ab" * 30_000, " " * 20_000, "\n" * 5000, "漢" * 20_000, "0" * 10_000, "a b " * 50_000, "<|endoftext|>", "a<|endoftext|>b"]
    assert all(np.array_equal(encode(t), slow(t)) for t in texts)


# ------------------------------------------------------------------ 7
def test_pair_choice_matches_a_loop(spark):
    """Of the conversations that begin with the same turn, the one of the most turns is chosen against each other one."""
    r = random.Random(6)
    rows, talks = [], {}
    for c in range(60):
        talks[c] = [(("user", "assistant")[k % 2], r.choice("ab") * r.randint(1, 2)) for k in range(r.randint(1, 6))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(talks[c])]
    rows.append((None, 0, "user", "a"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    out = {x["rejected_id"]: x for x in preference.preference_table(table).collect() if x["kind"] == "sibling" and x["rejected_id"] is not None}
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: E731, B905
    for c, x in out.items():
        group = [d for d in talks if talks[d][0] == talks[c][0]]
        assert x["chosen_id"] in group and len(talks[x["chosen_id"]]) == max(len(talks[d]) for d in group)
        assert x["n_prompt_turns"] == shared(talks[c], talks[x["chosen_id"]])
    assert len(out) == len(talks) - len({t[0] for t in talks.values()})
