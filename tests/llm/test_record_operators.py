import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import matroska as mk
from millrace.llm import mixing, packing, preference

DOCS = "doc_id long, text string, source string"


# ------------------------------------------------------------------ 2
def water_level(sizes, weights, total):
    """Targets by raising the level until no source is above its cap."""
    target, open_ = {}, dict(weights)
    left = total
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    rows = []
    for i in range(900):
        s = r.choice(["a"] * 6 + ["b", "B", None, "d"])
        rows.append((i, " ".join(["w"] * r.randint(0, 40)), s))
    rows += [(900, None, "a"), (901, "", "b"), (5, rows[5][1], rows[5][2])]
    out = [x.asDict() for x in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(out) == len(rows)
    names = ["B", "a", "b", "d", None]
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    want = water_level(size, weight, sum(size.values()))
    for s in names:
        mine = [x for x in out if x["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == size[s]
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 60
    assert all(x["taken"] in {0, x["size"], 2 * x["size"], 3 * x["size"]} for x in out)
    again = [x.asDict() for x in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()]
    key = lambda x: (x["doc_id"], x["taken"], x["size"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixed_rows_carry_their_own_columns(spark):
    """From a source that is no stored table, with null sources, repeated rows and clashing columns."""
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "a", "a", None]), i, -i) for i in range(200)] + [(7, "x y", "a", 7, -7)] * 3
    docs = spark.createDataFrame(rows, DOCS + ", _row int, epochs int").repartition(7).where(F.rand(5) < 2)
    out = mixing.mix_rows(docs.withColumns({"copy": F.lit(1), "row": F.lit(2), "_epochs": F.lit(3)}))
    assert out.columns == ["doc_id", "text", "source", "_row", "epochs", "copy", "row", "_epochs"]
    got = out.collect()
    texts = {x[0]: (x[1], x[2]) for x in rows[:200]}
    assert all((x["text"], x["source"]) == (texts[x["doc_id"]] if x["text"] != "x y" else ("x y", "a")) and x["_row"] == x["doc_id"] == -x["epochs"] for x in got)
    words = lambda s: sum(len(x["text"].split()) for x in got if x["source"] == s)
    total = sum(len(x[1].split()) for x in rows)
    assert abs(words("a") + words(None) - total) <= 60 and mixing.mix_rows(docs.limit(0)).count() == 0


def test_mix_edge_cases(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "x")], DOCS)).collect()
    assert [(r["size"], r["taken"]) for r in out] == [(0, 0), (0, 0)]


def test_word_count_uses_ascii_white_space_only(spark):
    df = spark.createDataFrame([("a b\x0bc d",), ("\x01 \x1c",), (None,)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [3, 2, 0]


# ------------------------------------------------------------------ 3
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


def test_packing_is_whole_and_tight(spark):
    path, ranks = tokenizer()
    r = random.Random(5)
    texts = ["".join(r.choice("abc déf. ") for _ in range(r.randint(0, 900))) for _ in range(150)] + [None, "", "x <|endoftext|> y", "it's 12 tests " * 900]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    out = [x.asDict() for x in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=path, ranks=ranks).collect()]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    total = 0
    for doc_id, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((x for x in out if x["doc_id"] == doc_id), key=lambda x: x["start"])
        if doc_id == 0:
            assert len(mine) == 2
            mine = mine[:1]
            total += len(ids)
        assert sum(x["length"] for x in mine) == len(ids) and [x["piece"] for x in mine] == list(range(len(mine)))
        assert all(x["length"] == 2048 for x in mine[1:])
        for x in mine:
            part = b"".join(i.to_bytes(4, "little") for i in ids[x["start"] : x["start"] + x["length"]])
            assert x["ids_crc32"] == zlib.crc32(part)
        total += len(ids)
    by = {}
    for x in out:
        by.setdefault(x["sequence_id"], []).append(x)
    for s in by.values():
        s.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in s] == [sum(y["length"] for y in s[:i]) for i in range(len(s))] and sum(x["length"] for x in s) <= 2048
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer=path, ranks=ranks).count() == 0


def test_genetics_keep_every_piece_and_help():
    import numpy as np

    random_ = np.random.default_rng(1)
    length = np.sort(random_.integers(300, 1100, 300))[::-1].copy()
    one = packing.evolve(length, [], 1, 2048, 4, 0)
    best = packing.evolve(length, [one], 1, 2048, 4, 40)
    child = packing.crossover(one, best, length, 2048, random_)
    for p in (one, best, child, packing.mutate(one, length, 2048, random_)):
        assert len(p) == 300 and p.min() == 0 and (np.bincount(p, weights=length) <= 2048).all() and (np.bincount(p) > 0).all()
    assert packing.fitness(best, length, 2048) >= packing.fitness(one, length, 2048)


# ------------------------------------------------------------------ 6
def plain_payload(data):
    """The frames of a file of known sizes, read by another road: head by head, with no use of the library's reader."""

    def vint(at, keep):
        n = 1
        while not data[at] >> 8 - n & 1:
            n += 1
        value = int.from_bytes(data[at : at + n], "big")
        return (value if keep else value - (1 << 7 * n)), at + n

    out = []

    def block(at, end):
        _, at = vint(at, False)
        flags, at = data[at + 2], at + 3
        kind = flags & 6
        if kind:
            count, at = data[at] + 1, at + 1
            if kind == 2:  # Xiph
                for _ in range(count - 1):
                    while data[at] == 255:
                        at += 1
                    at += 1
            elif kind == 6:  # EBML
                for _ in range(count - 1):
                    _, at = vint(at, False)
        out.append(data[at:end])  # frames of a block follow each other

    def walk(at, end):
        while at < end:
            tag, at = vint(at, True)
            size, at = vint(at, False)
            if tag in (0x18538067, 0x1F43B675, 0xA0):
                walk(at, at + size)
            elif tag in (0xA3, 0xA1):
                block(at, at + size)
            at += size

    walk(0, len(data))
    return b"".join(out)


@pytest.mark.parametrize("n", [64, 128, 480, 481, 1217, 5000, 100_000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = mk.mux(payload)
    media = mk.demux(data)
    assert media.error is None and b"".join(data[p.offset : p.offset + p.size] for p in media.packets) == payload
    times = [p.timestamp_ns for p in media.packets]
    assert times == sorted(times) and len(media.cues) == len(media.clusters)
    segment = data.index(mk.put_id(mk.INFO))
    for cue, (start, _) in zip(media.cues, media.clusters, strict=True):
        assert segment + cue.cluster == start and data[start : start + 4] == mk.put_id(mk.CLUSTER) and cue.track == 1
    cued = [p for p in media.packets if p.cue_ns is not None]
    assert [p.cluster for p in cued] == list(range(len(media.clusters))) and all(p.cue_ns == p.timestamp_ns // 1_000_000 * 1_000_000 for p in cued)
    assert plain_payload(data) == payload


def test_all_kinds_of_lacing():
    for kind, frames in ((mk.XIPH, [b"a" * 255, b"b" * 600, b"c"]), (mk.EBML_LACE, [b"a" * 10, b"b" * 9000, b"c" * 3, b"d"]), (mk.FIXED, [b"ab", b"cd", b"ef"])):
        body = mk.lace(frames, kind)
        sizes, at = mk.lace_sizes(body, 0, len(body), kind)
        assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_open_sizes_and_damage():
    block = mk.element(mk.SIMPLE_BLOCK, mk.put_size(1) + b"\x00\x05\x80xyz")
    track = mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk.number(mk.TRACK_NUMBER, 1)))
    cluster = mk.put_id(mk.CLUSTER) + b"\xff" + mk.number(mk.TIMESTAMP, 7) + block
    data = mk.element(mk.EBML, b"") + mk.put_id(mk.SEGMENT) + b"\x01" + b"\xff" * 7 + track + cluster + cluster
    media = mk.demux(data)
    assert media.error is None and [p.timestamp_ns for p in media.packets] == [12_000_000] * 2
    assert all(data[p.offset : p.offset + p.size] == b"xyz" for p in media.packets)
    whole = mk.mux(bytes(20_000))
    cut = mk.demux(whole[:15_000])
    assert cut.error and 0 < len(cut.packets) < len(mk.demux(whole).packets)
    assert mk.demux(b"").error == "no segment" and mk.demux(b"\x00" * 9).error


def test_any_bytes_are_read_without_an_exception():
    block = mk.element(mk.SIMPLE_BLOCK, mk.put_size(1) + b"\x00\x05\x82\x01\x01xyz")

    def file(audio=b"", cluster=b"", more=b"", info=b""):
        track = mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk.number(mk.TRACK_NUMBER, 1) + mk.element(mk.AUDIO, mk.number(mk.BIT_DEPTH, 8) + audio)))
        return mk.element(mk.SEGMENT, mk.element(mk.INFO, info) + track + mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 7) + block + cluster) + more)

    for odd in (mk.number(mk.CHANNELS, 0), mk.real(mk.SAMPLING_FREQUENCY, 0.0), mk.real(mk.SAMPLING_FREQUENCY, float("nan")), mk.real(mk.SAMPLING_FREQUENCY, 1e-300)):
        media = mk.demux(file(odd))
        assert media.error is None and [p.size for p in media.packets] == [1, 2]
    deep = (mk.put_id(mk.BLOCK_GROUP) + b"\xff") * 5000
    for odd in (file(cluster=deep), mk.put_id(mk.SEGMENT) + b"\xff" + (mk.put_id(mk.CLUSTER) + b"\xff") * 5000, (mk.put_id(mk.SEGMENT) + b"\xff") * 5000):
        mk.demux(odd)
    assert mk.demux(file(cluster=deep)).error and len(mk.demux(file(cluster=deep)).packets) == 2
    assert mk.demux(file(info=mk.element(mk.TIMESTAMP_SCALE, b"\xff" * 8))).error and mk.demux(file(info=mk.element(mk.DURATION, b"abc"))).error
    assert mk.demux(file(cluster=mk.element(mk.TIMESTAMP, b"\x01" * 9))).error and mk.demux(file(more=mk.element(mk.CUES, mk.element(mk.CUE_POINT, b"")))).error
    whole = mk.mux(bytes(9000))
    r = random.Random(1)
    for _ in range(3000):
        odd = bytearray(whole)
        for _ in range(r.randint(1, 6)):
            odd[r.randrange(len(odd)) if r.random() < 0.5 else r.randrange(160)] = r.randrange(256)
        mk.demux(bytes(odd))


def test_cues_of_several_tracks(spark):
    blocks = [mk.element(mk.SIMPLE_BLOCK, mk.put_size(t) + b"\x00\x00\x80" + b"x" * t) for t in (1, 2)]
    time = mk.number(mk.TIMESTAMP, 7)
    cluster = mk.element(mk.CLUSTER, time + blocks[0] + blocks[1])
    place = lambda t, *more: mk.element(mk.CUE_TRACK_POSITIONS, b"".join((mk.number(mk.CUE_TRACK, t), mk.number(mk.CUE_CLUSTER_POSITION, 0), *more)))
    cue = mk.element(mk.CUE_POINT, mk.number(mk.CUE_TIME, 7) + place(1) + place(2, mk.number(mk.CUE_RELATIVE_POSITION, len(time + blocks[0]))) + place(2, mk.number(mk.CUE_RELATIVE_POSITION, 1)))
    data = mk.element(mk.SEGMENT, cluster + mk.element(mk.CUES, cue))
    media = mk.demux(data)
    assert [(c.track, c.block) for c in media.cues] == [(1, None), (2, 3 + 7), (2, 1)] and [p.cue_ns for p in media.packets] == [7_000_000] * 2
    files = spark.createDataFrame([(1, 2, 3, data), (4, 5, 6, None), (7, 8, 9, b"junk")], "size int, `a.b` int, found int, media binary")
    rows = mk.packets(files, "media")
    assert rows.columns == ["size", "a.b", "found", "track", "timestamp_ns", "offset", "_size", "key", "cluster", "lacing", "cue_ns"]
    assert sorted((x["size"], x["a.b"], x["track"], x["_size"], x["cue_ns"]) for x in rows.collect()) == [(1, 2, 1, 1, 7_000_000), (1, 2, 2, 2, 7_000_000)]
    assert [(x["track"], x["timestamp_ns"], x["block_offset"]) for x in mk.cue_points(files, "media").collect()] == [(1, 7_000_000, None), (2, 7_000_000, 10), (2, 7_000_000, 1)]


def test_media_tables(spark):
    out = mk.texts_as_media(spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "é" * 70), (4, "é" * 70)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["payload_bytes"]) for r in out] == [(3, 64), (0, 64), (0, 64), (140, 192), (140, 192)] and out[3]["media_sha256"] == out[4]["media_sha256"]
    assert out[1]["tail_crc32"] == zlib.crc32(bytes(64))
    files = spark.createDataFrame([(1, mk.mux(b"abc" * 900)), (2, None)], "id int, media binary")
    rows = mk.packets(files, "media").collect()
    assert sum(r["size"] for r in rows) == 2700 and {r["id"] for r in rows} == {1}
    assert mk.texts_as_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ 7
TURNS = "conv_id long, turn long, role string, text string"


def test_preference_pairs(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good day to you"), (1, 2, "user", "bye"), (1, 3, "assistant", "see you"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "good day to you"), (2, 2, "user", "what"), (2, 2, "user", "what"),
        (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "a b c d <|im_end|>"),
        (4, 0, "user", None), (5, 0, "user", "hi"),
    ]
    out = {r["conv_id"]: r for r in preference.preference_table(spark.createDataFrame(rows, TURNS)).collect()}
    assert {i: r["kind"] for i, r in out.items()} == {1: "chosen", 2: "sibling", 3: "cut", 4: "none", 5: "sibling"}
    two = out[2]
    assert (two["chosen_id"], two["rejected_id"], two["n_prompt_turns"]) == (1, 2, 2)
    assert two["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\ngood day to you<|im_end|>\n"
    assert two["chosen_completion"] == "<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\nsee you<|im_end|>\n" and two["rejected_spans"] == []
    (a, b), = two["chosen_spans"]
    assert two["chosen_completion"][a:b] == "see you<|im_end|>"
    three = out[3]
    assert three["n_prompt_turns"] == 2 and three["rejected_completion"].startswith("<|im_start|>assistant\na b<|im_end|>") and three["chosen_completion"].count("<|im_end|>") == 1
    assert out[5]["n_prompt_turns"] == 1 and out[5]["rejected_completion"] == "" and out[4]["chosen_completion"] == ""
    assert preference.preference_table(spark.createDataFrame([], TURNS)).count() == 0


def test_spans_match_a_loop(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant"]), "x" * r.randint(0, 9)) for c in range(20) for t in range(r.randint(1, 7))]
    for x in preference.preference_table(spark.createDataFrame(rows, TURNS)).collect():
        text = x["chosen_completion"]
        want, at = [], 0
        for part in text.split("<|im_start|>")[1:]:
            role, _, body = part.partition("\n")
            start = at + len("<|im_start|>") + len(role) + 1
            if role == "assistant":
                want.append((start, start + len(body) - 1))
            at += len("<|im_start|>") + len(part)
        assert [tuple(s) for s in x["chosen_spans"]] == want
