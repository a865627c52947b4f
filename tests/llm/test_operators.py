"""The training-data operators against brute force on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strataform.llm import bpe, jaccard_join, line_dedup, media, mixing, quality_rules, sentencepiece_codec, substring_dedup, token_counts, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, n_words string, v double, label int, key string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def texts():
    """Copies, near copies, shared passages and lines, nulls, empty, long and odd texts, repeated rows."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "rä", "So") for b in ("t", "sel", "nd", "rk", "ña", "x9")]
    make = lambda n: [r.choice(words) for _ in range(n)]
    passage, line = make(70), "All rights reserved, please cite."
    out: list[tuple[int | None, str | None]] = []
    base = make(160)
    for k in range(14):
        near = list(base)
        near[r.randrange(160)] = f"u{k}"
        out.append((len(out), " ".join(near)))
    for _ in range(6):
        out.append((len(out), " ".join(base)))
    for _ in range(14):
        a = make(r.randrange(5, 90))
        out.append((len(out), " ".join(a + passage + make(30)) + "\n" + line + "\n  " + line.upper() + "\t"))
    for _ in range(15):
        out.append((len(out), "\n".join(" ".join(make(r.randrange(1, 12))) for _ in range(r.randrange(1, 6)))))
    for t in (None, None, "", " \n\t ", "one", "ONE", "two words", "Two  words", "a b c d e", "x" * 3000, "\n\n", "tab\tand\x0bmore\r\n end ", "▁ sign <|endoftext|> <s> 😀 é́  wide\xa0", " lead", "trail ", "don't  stop...now!!"):
        out.append((len(out), t))
    out.append((len(out), " ".join(make(4000)) + " " + " ".join(base)))
    out += [(3, out[3][1]), (3, "a different text under the same id " * 12), (None, out[0][1]), (None, "no id")]
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    source = lambda k: None if k % 7 == 6 else "hot" if k % 3 == 0 else f"s{k % 4}"
    data = [(d, t, "en", source(k), len(t or ""), 1, "x", 0.5, 7, "k") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ordered(pairs):
    return sorted(pairs, key=repr)


# -- 1 and 10: tokens ---------------------------------------------------------------------


def test_token_counts(docs, rows, empty):
    t = bpe.load(None)
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for d, x in rows]
    for entries in (4, 1 << 12):
        got = token_counts.count_tokens(docs, limit=100, entries=entries, cache=50)
        assert ordered(map(tuple, got.collect())) == ordered(want)
    assert token_counts.count_tokens(empty).count() == 0


def test_chunks_equal_the_library():
    t = bpe.load(None)
    count = bpe.Encoder(None, len, {" ab": len(t.encode(" ab").ids)}, sum, most=20)
    r, letters = random.Random(3), " \t\n\r\x0b\x0c\x1c\x85\xa0  　​ab1's!.é中😀\x00١"
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randrange(14)))
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids), s


def test_summary_keeps_heavy_tokens():
    from collections import Counter

    a = token_counts.pack(token_counts.shrink(Counter({"x": 100, "y": 50, "z": 1, "w": 1}), 2))
    b = token_counts.pack(Counter({"x": 5}))
    import pickle

    assert pickle.loads(zlib.decompress(token_counts.merge_summaries(a, b, 2))) == {"x": 104, "y": 49}


@pytest.mark.parametrize("width", [0, 1, 7, 16, 31])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_blocks_of_ids_invert(n, width):
    r = np.random.default_rng(n + width)
    ids = r.integers(0, 1 << width, n, dtype=np.uint32) + 5
    if n > 3:
        ids[::37] = 0xFFFFFFFF
    starts, data = token_files.pack_blocks(ids)
    assert token_files.unpack_blocks(starts, data, n).tolist() == ids.tolist()
    if n > 300:
        assert token_files.unpack_blocks(starts, data, n, first=1, last=2).tolist() == ids[128:256].tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.full(128, 7, np.uint32)
    ids[5] = 50_000
    _, data = token_files.pack_blocks(ids)
    assert len(data) == 6 + 0 + 1 + 4


def test_token_files(spark, docs, rows, empty):
    t = bpe.load(None)
    # Rows that share an id come in the order of Spark's xxhash64 of their texts.
    tie = lambda x: 42 if x is None else (h := xxhash.xxh64_intdigest(x.encode(), 42)) - (h >> 63 << 64)
    encoded = sorted((d is not None, d or 0, tie(x), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in rows)
    want, at = [], 0
    for known, d, _, ids in encoded:
        want.append((d if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_files(docs, segment_ids=500, bucket_rows=6)
    assert ordered(map(tuple, got.collect())) == ordered(want)
    assert token_files.token_files(empty).count() == 0


def test_a_hot_id_lies_in_several_buckets(spark, tmp_path):
    some = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    token_files.write_tokens(docs, f"file://{tmp_path}/t", bucket_rows=50)
    got = token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()
    assert sorted(r["start"] for r in got)[0] == 0
    assert ordered(r["doc_id"] for r in got) == ordered(d for d, _ in some)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == sorted((d for d, _ in some), key=lambda d: (d is not None, d or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by_start, by_start[1:], strict=False))
    files = spark.read.parquet(f"file://{tmp_path}/t")
    held = files.groupBy("bucket").agg(F.sum("n_docs").alias("n")).collect()
    assert max(r["n"] for r in held) < 400


def test_chunks_of_batches_equal_the_library():
    t = bpe.load(None)
    chunks = bpe.Chunks(None, "H", 60)
    r, letters = random.Random(4), " \t\n\r\x85\xa0  ab1's!.é中😀\x00"
    words = ["ab", "b.", "don't", "x1", "é中", "日本.", "a!!", ".a", "ab%%%", "we'", "x²", "ab's!", "e\u0301x", "no_", "a.5", "x\x1c!"]
    for _ in range(120):
        held = ["".join(r.choice(letters) for _ in range(r.randrange(12))) for _ in range(4)]
        held += [r.choice(" \n").join(r.choice(words) + str(r.choice(("", "", "q"))) * r.randrange(3) for _ in range(r.randrange(1, 9))) for _ in range(6)]
        held += ["", "a <|endoftext|> b", "one\ntwo three. four\nfive"]
        got = [np.frombuffer(x, np.uint16).tolist() for x in chunks.texts(held)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in held]


# -- 2: similar texts ---------------------------------------------------------------------


def brute_components(rows, percent):
    sets = []
    for _, x in rows:
        w = WORD.findall(lower(x or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    big = 1 << 62
    key = [big if d is None else d for d, _ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: big)
    for k in range(len(rows)):
        least[find(k)] = min(least[find(k)], key[k])
    out = []
    for k, (d, _) in enumerate(rows):
        c = least[find(k)] if sets[k] else key[k]
        out.append((d, len(sets[k]), None if c == big else c))
    return out


@pytest.mark.parametrize(("percent", "rounds"), [(80, 6), (80, 0), (50, 2), (100, 6)])
def test_jaccard_components(docs, rows, percent, rounds):
    got = jaccard_join.jaccard_components(docs, percent=percent, rounds=rounds).select("doc_id", "n_shingles", "component_id")
    assert ordered(map(tuple, got.collect())) == ordered(brute_components(rows, percent))


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_jaccard_links_are_all_listed(docs, rows, percent):
    sets = []
    for _, x in rows:
        w = WORD.findall(lower(x or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    big = 1 << 62
    key = [big if d is None else d for d, _ in rows]
    rep = {s: min(k for k, t in zip(key, sets, strict=True) if t == s) for s in set(sets)}
    linked = lambda s, t: bool(s & t) and 100 * len(s & t) >= percent * len(s | t)
    kinds = sorted((s for s in rep if s), key=lambda s: (rep[s], len(s)))
    pairs = [(s, t) for k, s in enumerate(kinds) for t in kinds[:k] if linked(s, t)]
    want = [(*sorted(((rep[s], len(s)), (rep[t], len(t)))), len(s & t)) for s, t in pairs]
    links, members = jaccard_join.jaccard_links(docs, percent=percent)
    name = lambda d: big if d is None else d
    got = [(*sorted(((name(r["a_vertex"]), r["na"]), (name(r["b_vertex"]), r["nb"]))), r["common"]) for r in links.collect()]
    assert ordered(got) == ordered(want)
    assert percent == 100 or len(want) > 50
    n_links = [sum(linked(s, t) for t in sets) - bool(s) for s in sets]
    vertex = [rep[s] if s else k for k, s in zip(key, sets, strict=True)]
    brute = [(d, len(s), None if v == big else v, n) for (d, _), s, v, n in zip(rows, sets, vertex, n_links, strict=True)]
    assert ordered(map(tuple, members.select("doc_id", "n_shingles", "vertex", "n_links").collect())) == ordered(brute)
    assert {r["cls"] for r in members.collect()} >= {x for r in links.collect() for x in (r["a"], r["b"])}


def test_jaccard_links_of_nothing(empty):
    assert [x.count() for x in jaccard_join.jaccard_links(empty)] == [0, 0]


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    vertices = spark.createDataFrame([(k,) for k in [*range(1, 41), 100, 101]], "v bigint")
    got = dict(map(tuple, jaccard_join.components(edges, vertices).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


# -- 3: repeated passages -----------------------------------------------------------------


def brute_substrings(rows, width):
    words = [WORD.findall(x or "") for _, x in rows]
    big = 1 << 62
    key = [big if d is None else d for d, _ in rows]
    least = {}
    for k, w in enumerate(words):
        for a in range(len(w) - width + 1):
            s = tuple(w[a : a + width])
            least[s] = min(least.get(s, big), key[k])
    out = []
    for k, w in enumerate(words):
        gone = bytearray(len(w))
        for a in range(len(w) - width + 1):
            if least[tuple(w[a : a + width])] < key[k]:
                gone[a : a + width] = b"\1" * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((rows[k][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "mer", "hot"), [(50, 8, 4000), (50, 8, 1), (12, 3, 4000), (5, 5, 2)])
def test_substring_dedup(docs, rows, width, mer, hot):
    got = substring_dedup.dedup_substrings(docs, width=width, mer=mer, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(map(tuple, got.collect())) == ordered(brute_substrings(rows, width))


def test_periodic_texts_and_hot_minimisers(spark):
    some = [(1, "la " * 3000), (2, "x " + "la " * 2000 + "y"), (3, "do re " * 900), (4, "so " + "do re " * 400), (5, "la " * 49), (6, "la " * 50), (None, "do re " * 30)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    for hot in (substring_dedup.HOT, 500):
        got = substring_dedup.dedup_substrings(docs, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert ordered(map(tuple, got.collect())) == ordered(brute_substrings(some, 50))


def test_substring_empty(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0


# -- 4: quality ---------------------------------------------------------------------------


def brute_counts(x):
    x = x or ""
    w = WORD.findall(x)
    lines, dup, seen = x.split("\n"), 0, set()
    for one in lines:
        if WORD.search(one):
            dup += one in seen
            seen.add(one)
    first = defaultdict(list)
    for k in range(len(w) - 2):
        first[tuple(w[k : k + 3])].append(k)
    covered = {k + j for places in first.values() if len(places) > 1 for k in places for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(covered), failed


def test_quality_counts(docs, rows, empty):
    extra = [(k + 1000, t) for k, t in enumerate(["a a a a a", "x y z x y z x y", "p q p q p q p q", "# $ % a|b <c>\na\na\n a\n\n", "a b c " * 40, "w v u t " * 3 + "a b"])]
    spark = docs.sparkSession
    more = spark.createDataFrame([(d, t) for d, t in extra], "doc_id bigint, text string")
    got = quality_rules.apply_rules(docs.select("doc_id", "text").unionByName(more), [])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert ordered(map(tuple, got.select(columns).collect())) == ordered((d, *brute_counts(t)) for d, t in rows + extra)
    assert got.where("kept = base_failed").count() == 0
    assert quality_rules.apply_rules(empty, []).count() == 0


def sample(n=600):
    r = random.Random(1)
    out = []
    for k in range(n):
        row = {f: r.randrange(100) for f in quality_rules.FEATURES}
        row["bad"] = int(row["marks_permille"] > 70 and row["n_words"] <= 60 or row["digits_permille"] > 95)
        out.append(row | {"part": k % 3, "id": str(k)})
    return out


def test_rules_find_planted_conjunctions():
    held = sample()
    rules = quality_rules.learn(held)
    wrong = sum(any(r.met(x) for r in rules) != bool(x["bad"]) for x in held)
    assert wrong <= 12
    assert quality_rules.learn([x | {"bad": 0} for x in held]) == []
    assert quality_rules.learn([]) == []


def test_judge_learns_from_labels(spark):
    r = random.Random(7)
    text = lambda bad: " ".join(f"{r.choice('abcdefgh')}{r.randrange(999)}" + ("!" if bad and k % 2 else "") for k in range(90))
    some = [(k, text(k % 3 == 0)) for k in range(300)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(250)] + [(None, 0, 0), (5, None, 0), (6, 1, 0)]
    docs = spark.createDataFrame([*some, (None, text(False)), (8, text(False)), (400, None)], "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality_rules.judge(docs, table).collect()
    assert len(got) == 303
    for x in got:
        if x["doc_id"] is not None and x["doc_id"] < 300 and x["doc_id"] != 8:
            assert x["kept"] == (x["doc_id"] % 3 > 0 and not x["base_failed"]), x
    held = quality_rules.labelled_sample(docs, table, most=40)
    assert len(held) <= 40
    assert held == quality_rules.labelled_sample(docs.repartition(7), table, most=40)
    assert len({x["id"] for x in quality_rules.labelled_sample(docs, table)}) == 250
    assert quality_rules.judge(docs, table.limit(0)).where("kept = base_failed").count() == 0


def test_rules_as_columns_mean_the_same(docs):
    rules = [quality_rules.Rule((("n_words", ">", 40), ("marks_permille", "<=", 0))), quality_rules.Rule((("word_length_percent", ">", 900),))]
    found = quality_rules.counts(docs).select("*", *(F.expr(e).alias(f"f_{n}") for n, e in quality_rules.FEATURES.items()), quality_rules.verdict(rules).alias("ok"))
    for r in found.collect():
        row = {n: r[f"f_{n}"] for n in quality_rules.FEATURES}
        assert r["ok"] == (not any(x.met(row) for x in rules))


def test_quality_plan_is_native(docs):
    plan = quality_rules.apply_rules(docs, [])._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


# -- 5: media -----------------------------------------------------------------------------


def test_media_columns(docs, rows, empty):
    got = media.text_media(docs).collect()
    want = []
    for d, x in rows:
        data = (x or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        tiles = np.frombuffer(payload, np.uint8).reshape(-1, 24, 24)
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(media.to_npy(tiles)).hexdigest()))
    assert ordered((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in got) == ordered(want)
    assert media.text_media(empty).count() == 0


@pytest.mark.parametrize("depth", [1, 3])
def test_pictures_invert(depth):
    r = np.random.default_rng(4)
    image = r.integers(0, 256, (7, 5) if depth == 1 else (7, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pnm(image)) == image).all()
    if depth == 3:
        assert (media.decode(media.encode_bmp(image)) == image).all()


def test_plain_and_odd_pictures():
    assert media.decode(b"P2 # note\n2 2\n# more\n9\n0 1\n2 9\n").tolist() == [[0, 1], [2, 9]]
    assert media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"P9 1 1", b"P5 1", b"BMxx"):
        with pytest.raises(Exception, match=r"."):
            media.decode(bad)


def test_tiles_keep_samples_and_tell_errors(spark, tmp_path):
    wide = b"P5 2 1 65535\n\x01\x02\x7f\xff"
    colour = np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8)
    fields = bytearray(media.encode_bmp(colour))
    fields[30:34] = (3).to_bytes(4, "little")
    some = [(1, wide), (2, None), (3, b"P5 2 1"), (4, b"P5 0 3 255\n"), (5, media.encode_bmp(colour)), (6, bytes(fields)), (7, b"")]
    media.write_tiles(spark.createDataFrame(some, "k int, m binary"), f"file://{tmp_path}/t", id_col="k", media_col="m")
    got = {r["k"]: r for r in spark.read.parquet(f"file://{tmp_path}/t").collect()}
    assert media.from_npy(bytes(got[1]["npy"]))[0, 0, :3].tolist() == [258, 32767, 65535]
    assert media.from_npy(bytes(got[5]["npy"]))[0, 0, :3].tolist() == [76, 150, 255]
    assert [got[k]["npy"] for k in (2, 3, 4, 6, 7)] == [None] * 5
    assert {k for k in got if got[k]["error"]} == {3, 4, 6, 7}


def test_difference_hash_compares_neighbours():
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (16, 27), dtype=np.uint8)
    small = image.reshape(8, 2, 9, 3).astype(float).mean(axis=(1, 3))
    bits = "".join(str(int(a > b)) for row in small for a, b in zip(row, row[1:], strict=False))
    assert media.difference_hash(image) == f"{int(bits, 2):016x}"


def test_area_resize_equals_the_mean_of_areas():
    r = np.random.default_rng(8)
    image = r.integers(0, 256, (10, 7)).astype(np.float64)
    got = media.resize_area(image, 4, 3)
    fine = np.kron(image, np.ones((4, 3)))
    assert np.allclose(got, fine.reshape(4, 10, 3, 7).mean(axis=(1, 3)))
    assert media.resize_area(image, 10, 7) == pytest.approx(image)


# -- 6: toxicity --------------------------------------------------------------------------


def toxic_table(spark):
    r = random.Random(2)
    words = ["the", "of", "and", "tion", "under", "table", "house", "green", "walk", "river", "stone", "idle", "moral", "report"]
    data, labels = [], []
    for k in range(900):
        text = [r.choice(words) for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            text[r.randrange(40)] = r.choice(["idiot", "moron", "stupid"])
        data.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    hidden = {9001: "you 1d10t on the walk", 9002: "what a m0r0n they are", 9003: "an i d i o t of the house", 9004: "so stuuuupid and green", 9005: "this st*pid table", 9006: "i.d.i.o.t!"}
    clean = {9101: "route 66 and 1999 cm", 9102: None, 9103: "", 9104: "a b c d e f g", 9105: "mail ab12@example.com!!", 9106: "the moral report of idle stone"}
    data += [*hidden.items(), *clean.items(), (None, "you idiot")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("label", F.lit(3))
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), hidden, clean


def test_toxicity(spark):
    docs, labels, hidden, clean = toxic_table(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 913
    for d in range(900):
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["predicted"] == int(d % 4 == 0)
    assert {d for d in hidden if got[d]["predicted"] != 1} == set()
    assert {d for d in clean if got[d]["predicted"] != 0} == set()
    assert got[None]["predicted"] == 1
    assert not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_hidden_words_at_any_length():
    lexicon = {"=idiot": 0.9, "=moron": 0.8, "=ass": 0.7, "=stupid": 0.85, "=scum": 0.75, "5stupi": 0.6}
    s = toxicity.Scorer(lexicon, toxicity.character_costs(np.zeros(toxicity.SYMBOLS**3, np.int64)))
    far = " ".join("xyzvw" * 150)
    assert s(far) == 0
    one = lambda p: 1 - (1 - 0.97 * p)
    for end, p in (("i d 1 o t", 0.9), ("s c u m", 0.75), ("i d i o t q q m 0 r o n", 1 - (1 - 0.97 * 0.9) * (1 - 0.97 * 0.8))):
        assert s(f"{far} {end} {far}") == pytest.approx(p if "q" in end else one(p)), end
    assert s(" ".join("stupid" + "xyzvw" * 20 + "idiot")) > s(" ".join("stupid" + "xyzvw" * 20)) > 0
    assert s("an a s s here") == pytest.approx(one(0.7))
    assert s(".".join("xyzvw" * 90 + "idiot")) == pytest.approx(one(0.9))
    for token, p in (("st" + "u" * 60 + "pid", 0.85), ("1" * 30 + "d" + "!" * 30 + "0t", 0.9), ("st" + "u" * 50 + "pidity", 0.6), ("$tup!d" + "x#y" * 30, 0.6)):
        assert s("so " + token) >= one(p) - 1e-9, token
    short = toxicity.Scorer({"=ass": 0.7}, toxicity.character_costs(np.zeros(toxicity.SYMBOLS**3, np.int64)))
    assert short(" ".join("xyzvw" * 30 + "ass" + "vwxyz" * 30)) == pytest.approx(one(0.7))
    for clean in ("w" * 60, "https://example.com/a/very/long/path/of/words?with=arguments&and=more", "a b c", "=" * 80):
        assert s(clean) == 0, clean


def lattice_costs(s, token, apart):
    """The cost of each reading of a lattice, by listing all ways through it and all divisions into words."""
    import itertools

    costs, out = s.restorer.costs, {}

    def word_cost(word):
        x = y = 0
        total = 0.0
        for c in word:
            total, x, y = total + costs[x][y][toxicity.symbol(c)], y, toxicity.symbol(c)
        best = total + costs[x][y][0]
        if "=" + word in s.lexicon:
            best = min(best, toxicity.KNOWN)
        for k in toxicity.STEMS:
            if len(word) > k and f"{k}{word[:k]}" in s.lexicon:
                total, x, y = toxicity.KNOWN, toxicity.symbol(word[k - 2]), toxicity.symbol(word[k - 1])
                for c in word[k:]:
                    total, x, y = total + costs[x][y][toxicity.symbol(c)], y, toxicity.symbol(c)
                best = min(best, total + costs[x][y][0])
        return best

    for way in itertools.product(*s.restorer.options(token)):
        text = "".join(w for w, _ in way)
        channel = sum(c for _, c in way)
        for cut in range(1 << max(0, len(text) - 1)) if apart else (0,):
            words, last = [], 0
            for k in range(1, len(text) + 1):
                if k == len(text) or cut >> (k - 1) & 1:
                    words.append(text[last:k])
                    last = k
            total = channel + sum(map(word_cost, words))
            out[tuple(words)] = min(total, out.get(tuple(words), 1e9))
    return out


def test_viterbi_finds_the_cheapest_reading():
    r = np.random.default_rng(3)
    lexicon = {"=idiot": 0.9, "=ass": 0.7, "=id": 0.6, "4tool": 0.8, "5gibbl": 0.9}
    s = toxicity.Scorer(lexicon, toxicity.character_costs(r.integers(0, 50, toxicity.SYMBOLS**3)))
    pick = random.Random(8)
    tokens = ["1d10t", "idi0t", "a$$", "@ss", "t00ls", "6!88l!", "iiddiioott", "st*ne", "!!", "*"]
    tokens += ["".join(pick.choice("ids0t1a$!*l6") for _ in range(pick.randrange(1, 7))) for _ in range(60)]
    for apart in (False, True):
        for token in tokens:
            want = lattice_costs(s, token, apart)
            cost, words = s.restorer.best(token, apart)
            assert cost == pytest.approx(min(want.values(), default=float("inf"))), token
            assert not want or want[tuple(words)] == pytest.approx(cost), token
            if not apart:
                known = any(s.word("".join(w)) > 0 for w in want)
                assert s.restorer.spells(token) >= known, token
            elif s.hits(words):
                assert s.restorer.spells(token, True), token


def test_restored_text_is_what_is_scored(spark):
    docs, labels, hidden, _ = toxic_table(spark)
    got = {r["doc_id"]: r["restored"] for r in toxicity.restore_texts(docs, labels).collect()}
    assert got[9001] == "you idiot on the walk"
    assert got[9002] == "what a moron they are"
    assert got[9003] == "an idiot of the house"
    assert got[9004] == "so stupid and green"
    assert got[9006] == "idiot"
    assert got[9102] is None
    assert got[9103] == ""
    again = docs.where("text is not null").join(spark.createDataFrame([(d, t) for d, t in got.items() if d], "d bigint, restored string"), F.col("doc_id") == F.col("d")).select("doc_id", "restored")
    both = toxicity.score(docs.select("doc_id", "text").where("doc_id < 900").unionByName(again.where("doc_id > 9000").select("doc_id", F.col("restored").alias("text"))), labels)
    first = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    assert all(first[r["doc_id"]] == r["predicted"] for r in both.collect())


def test_toxicity_without_rows_or_labels(spark):
    docs, labels, _, _ = toxic_table(spark)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).where("score > 0 or predicted = 1").count() == 0


# -- 7: lines -----------------------------------------------------------------------------


def brute_lines(rows, least, chars):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    count = defaultdict(int)
    for _, x in rows:
        for k in {key(s) for s in (x or "").split("\n")}:
            count[k] += 1
    out = []
    for d, x in rows:
        lines = (x or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= chars and count[key(s)] >= least)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("least", "chars", "bits", "broadcast"), [(10, 1, None, 10**6), (2, 1, None, 0), (2, 5, 1 << 16, 10**6), (3, 1, 64, 0)])
def test_line_dedup(docs, rows, least, chars, bits, broadcast):
    got = line_dedup.dedup_lines(docs, min_docs=least, min_chars=chars, bits=bits, most_broadcast=broadcast).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert ordered(map(tuple, got.collect())) == ordered(brute_lines(rows, least, chars))


def test_lines_of_repeated_ids_equal_sql(spark, docs, rows, duck):
    from strataform.llm import queries

    some = rows + [rows[30]] * 9 + [(30, None), (None, rows[30][1])]
    table = pa.table({"doc_id": pa.array([d for d, _ in some], pa.int64()), "text": pa.array([t for _, t in some], pa.string())})
    con = duck.cursor()
    con.register("repeated", table)
    found = con.sql(queries.oracle_sql()["op7_line_dedup"].replace("FROM documents", "FROM repeated")).fetchall()
    got = line_dedup.dedup_lines(spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert ordered(map(tuple, got.collect())) == ordered(found)


def test_digest_sets():
    r = random.Random(3)
    held = [r.randbytes(16) for _ in range(500)] + [b"12345678" + bytes([k]) * 8 for k in range(3)]
    keys = line_dedup.Keys(held)
    asked = held[::2] + [r.randbytes(16) for _ in range(50)] + [b"12345678" + b"x" * 8]
    assert keys.has(asked).tolist() == [x in set(held) for x in asked]
    assert line_dedup.Keys([]).has(asked).sum() == 0
    assert line_dedup.Keys(held).has([]).tolist() == []


def test_line_dedup_keeps_first(spark, empty):
    docs = spark.createDataFrame([(2, "x\ny"), (1, "X \nz"), (3, " x")], "doc_id bigint, text string")
    for broadcast in (10, 0):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_docs=2, keep="first", most_broadcast=broadcast).collect()}
        assert got == {1: "X \nz", 2: "y", 3: ""}
    assert line_dedup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError, match="keep"):
        line_dedup.dedup_lines(docs, keep="last")


# -- 8: mixing ----------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = rest / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= full
    return target


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert ordered((r["doc_id"], r["size"]) for r in got) == ordered((d, len(WORD.findall(x or ""))) for d, x in rows)
    assert target == pytest.approx(brute_targets(size))
    longest = max(r["size"] for r in got)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.1 * target[s], 120), s
    assert longest > 3000
    again = mixing.mix(docs.repartition(3)).collect()
    assert ordered(map(tuple, (r[:6] for r in again))) == ordered(map(tuple, (r[:6] for r in got)))
    assert mixing.mix(empty).count() == 0


def test_rates_solve_the_dual(spark):
    """Rates tilt exponentially with size up to the bound, and meet each target: the conditions of the optimum."""
    import math

    r = random.Random(12)
    some = [(k, "w " * int(r.lognormvariate(3, 1)), r.choice("aaaaabbbc")) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(some, "doc_id bigint, text string, source string")).collect()
    for s in "abc":
        own = [x for x in got if x["source"] == s and x["size"]]
        assert sum(x["rate"] * x["size"] for x in own) == pytest.approx(own[0]["target"], rel=1e-3), s
        tilts = [math.log(x["rate"]) / x["size"] for x in own if x["rate"] < 3 - 1e-9]
        assert max(tilts, default=0) - min(tilts, default=0) < 1e-6
        slope = max(tilts, default=0)
        assert all(math.exp(min(9.0, slope * x["size"])) >= 3 - 1e-6 for x in own if x["rate"] >= 3 - 1e-9) or own[0]["target"] >= 3 * own[0]["source_size"] - 1e-6
        changed = [x for x in own if not math.floor(x["rate"]) <= x["copies"] <= math.ceil(x["rate"])]
        assert len(changed) <= 8
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own)


def test_targets_by_waterfilling(spark):
    sizes = [("a", 10), ("b", 1), ("c", 500), ("d", 3), (None, 7), ("é", 40), ("zero", 0)]
    df = spark.createDataFrame(sizes, "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(dict(sizes)))


def test_mixing_plan_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan


# -- 9: pieces ----------------------------------------------------------------------------


def test_pieces_without_dropout_are_the_library_s(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path(None))
    c = sentencepiece_codec.Codec(None, 0.0)
    held = [x for _, x in rows if x and "▁" not in x and len(x) < 2000]
    got = c.encode_batch(held, [0] * len(held))
    for x, ids in zip(held, got, strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == sp.encode(x), x


def test_pieces_decode_losslessly(docs, rows, empty):
    got = sentencepiece_codec.round_trip(docs, dropout=0.3, seed=9)
    back = sentencepiece_codec.decode_ids(got.select("doc_id", "ids"))
    assert ordered((r["doc_id"], r["decoded"]) for r in back.collect()) == ordered((d, x or "") for d, x in rows)
    assert got.where("not lossless").count() == 0
    assert sentencepiece_codec.encode_texts(empty).count() == 0


def test_dropout_varies_and_is_seeded():
    a, b = sentencepiece_codec.Codec(None, 0.3, 1), sentencepiece_codec.Codec(None, 0.3, 2)
    text = "the engineering of segmentation varies by occurrence " * 8
    assert a.encode(text, 5) == sentencepiece_codec.Codec(None, 0.3, 1).encode(text, 5) == a.encode_batch([text], [5])[0]
    assert a.encode(text, 5) != b.encode(text, 5)
    plain = sentencepiece_codec.Codec(None, 0.0)
    assert len(a.encode(text, 5)) > len(plain.encode(text, 5))
    assert len({tuple(a.word("▁engineering", k)) for k in range(4)}) > 1


def one_by_one(c, text, key):
    """Ids of a text whose parts go through their agendas one after the other."""
    flat = np.array([ord(x) for x in " " + text if text], np.uint32)
    if not len(flat):
        return []
    at, alone = c.cut(flat, np.array([0]))
    out = []
    for a, b, lone, own in zip(at.tolist(), [*at[1:].tolist(), len(flat)], alone.tolist(), c.keys(np.array([len(at)]), [key]).tolist(), strict=True):
        part = "".join(map(chr, flat[a:b]))
        out += c.pieces.fallback(part) if lone else c.word(part.replace(" ", "▁"), own)
    return out


def test_dropout_draws_are_independent():
    """Of many occurrences, each segmentation has the share that independent skips give it."""
    c = sentencepiece_codec.Codec(None, 0.1, 1)
    word, n = "engineering", 40_000
    found = defaultdict(int)
    flat = np.frombuffer(c.encode(" ".join([word] * n), 11), np.uint16).tolist()
    pieces, at = c.pieces.text, 0
    while at < len(flat):
        own, text = [], ""
        while text != "▁" + word:
            own.append(flat[at])
            text += pieces[flat[at]]
            at += 1
        found[tuple(own)] += 1
    r = random.Random(4)
    want = defaultdict(int)
    for _ in range(n):
        want[tuple(c.word("▁" + word, r.getrandbits(64)))] += 1
    assert len(found) > 20
    for own in found.keys() | want.keys():
        assert abs(found[own] - want[own]) <= 6 * (found[own] + want[own]) ** 0.5, own


def test_each_occurrence_draws_its_own_dropout(spark):
    c = sentencepiece_codec.Codec(None, 0.3, 1)
    held = ["▁ x\n\ny. " + "z" * 30, "", "engineering, " * 300 + "日本 😀end. " + "q" * 90, " two  spaces ", "\n"]
    for text, key, ids in zip(held, range(3, 8), c.encode_batch(held, list(range(3, 8))), strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == one_by_one(c, text, key), text
        assert c.decode(ids) == text
    text = "the engineering of segmentation varies. " * 3
    found = {c.encode(text, k) for k in range(100)}
    assert len(found) > 90
    assert {c.decode(x) for x in found} == {text}
    assert [c.encode(text, k) for k in range(5)] == c.encode_batch([text] * 5, list(range(5)))
    docs = spark.createDataFrame([(k // 2, k % 2, text) for k in range(100)], "doc_id int, n int, text string")
    assert sentencepiece_codec.encode_texts(docs, dropout=0.3).select("ids").distinct().count() > 40
    assert sentencepiece_codec.encode_texts(docs, dropout=0.3, copy_col="n").select("ids").distinct().count() > 90


def test_agendas_agree():
    c = sentencepiece_codec.Codec(None, 0.2)
    r = random.Random(6)
    words = ["▁" + "".join(r.choice("theinagrsoñ9") for _ in range(r.randrange(1, 63))) for _ in range(400)]
    keys = np.array([r.getrandbits(64) for _ in words], np.uint64)
    symbols = np.full((max(map(len, words)), len(words)), -2, np.int32)
    for k, w in enumerate(words):
        symbols[: len(w), k] = [c.pieces.ids[x] for x in w]
    for threshold in (0, 1 << 29, 1 << 31):
        fast = c.pairs.segment(symbols, keys, threshold)
        for j, (w, k) in enumerate(zip(words, keys.tolist(), strict=True)):
            slow = sentencepiece_codec.merge(w, c.pieces.rank, threshold, k)
            assert slow == sentencepiece_codec.merge_heap(w, c.pieces.rank, threshold, k)
            assert [x for x in fast[:, j].tolist() if x >= 0] == [c.pieces.ids[x] for x in slow]
