import random

from millrace.llm import substring

DOCS = "doc_id long, text string"


def cleaned(spark, *texts):
    return [r["text"] for r in substring.dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()]


def test_short_lines(spark):
    menu = "\n".join(f"dish{i} price{i}" for i in range(30)) + "\n"
    assert cleaned(spark, "First one here.\n" + menu, "Other thing.\n" + menu + "Tail.") == ["First one here.\n" + menu, "Other thing.\nTail."]


def test_long_and_short_sentences_at_a_passage_s_end(spark):
    p = "One two three four five six seven eight nine ten. Yes. No. Well. So. "
    assert cleaned(spark, "Start of it. " + p + "Last words a.", "Another start. " + p + "Quite different end.")[1] == "Another start. Quite different end."


def test_unpunctuated_passages_at_any_offset(spark):
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = some(60)
    texts = [some(200) + passage + some(200)] + [some(100 + k) + passage + some(100) for k in range(12)]
    new = cleaned(spark, *[" ".join(t) for t in texts])
    assert new[0] == " ".join(texts[0])
    left = [len(set(passage) & set(t.split())) for t in new[1:]]
    assert max(left) <= 30 and all(set(t) - set(passage) <= set(x.split()) for t, x in zip(texts, new, strict=True))


def test_text_without_spaces(spark):
    r = random.Random(6)
    some = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = "".join(some(9) + "。" for _ in range(8))
    assert cleaned(spark, some(20) + "。" + passage, some(31) + "。" + passage + some(5))[1][32:-5] == ""
