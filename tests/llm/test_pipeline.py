"""The pipeline's stages on a small made-up corpus, against plain Python."""

import random
import re

import pytest

import corpus_pipeline
from millrace.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(200):
        bad = i % 10 == 0
        t = " ".join(r.choice(words) + ("***" if bad else "") for _ in range(r.randint(20, 80)))
        if i % 10 == 7:
            t = rows[-1][1] + " tail"
        if i % 10 == 3:
            t += " mail a.b@c.example.com now"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), 0))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), {row[0]: row[1] for row in rows}


def test_stages(spark, corpus):
    pytest.importorskip("public_tokenizers")
    sf, texts = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{sf}/stage{i}")
            docs = spark.read.parquet(f"{sf}/stage{i}")
        kept[name] = docs if i < 4 else out
    good = {r["doc_id"] for r in kept["quality_classifier"].collect()}
    assert good == {i for i in texts if i % 10}
    single = {r["doc_id"] for r in kept["ngram_jaccard_join"].collect()}
    # 5 words of tail on a copy: linked where the text before is long enough
    expected = set()
    for i in good:
        a, b = texts[i].split(), texts.get(i - 1, "").split()
        n, m = len(a) - 4, len(b) - 4
        expected |= {i} if not (i % 10 == 7 and 100 * m >= 80 * n) else set()
    assert single == expected
    clean = {r["doc_id"]: r["text"] for r in kept["pii"].collect()}
    assert set(clean) == single and not any("a.b@c.example.com" in t for t in clean.values())
    assert all(clean[i] == texts[i] for i in single if i % 10 != 3) and all(re.search(r"mail \w\.\w@\w\.\w{7}\.com now", clean[i]) for i in single if i % 10 == 3)
    mixed = [r["doc_id"] for r in kept["mixing"].collect()]
    assert set(mixed) <= single and max(mixed.count(i) for i in set(mixed)) <= 3
    packed = kept["best_fit_packing"].collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(mixed)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_odd_tables_pass_all_stages(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, one very long text; and an empty table."""
    pytest.importorskip("public_tokenizers")
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    rows = [(i, text(30), "en", f"s{i % 2}", 1, i) for i in range(40)] + [(40, None, None, None, None, 40), (41, "", "en", "s0", 0, 41), (None, text(20), "en", "s1", 1, 42), (43, text(60_000), "en", "s0", 1, 43)]
    rows += [rows[3]] * 3
    docs = spark.createDataFrame(rows, COLUMNS + ", _row long").selectExpr("*", "1 as gone", "2 as epochs", "3 as n_entities", "4 as copy")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, folder)
            if i < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{folder}/stage{i}")
            now = spark.read.parquet(f"{folder}/stage{i}")
        found = {x["doc_id"] for x in now.collect()}
        assert (found >= {43, 3, None} and not found & {40, 41}) if name == "odd" else not found


def test_queries_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
