"""The pipeline's stages against brute force, each on its own input, and the registered queries."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataform.llm import queries as llm

from ..conftest import SMALL, plain
from .test_operators import brute_components, brute_lines, lower, ordered, rows  # noqa: F401

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_stages_keep_the_columns(spark, documents):
    df = documents
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before, df = df, stage(spark, df, SMALL)
        if k < len(pipeline.STAGES) - 1:
            assert df.dtypes == documents.dtypes
        assert before.count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "mixing sources", "sentencepiece"]


def test_toxic_stage_drops_what_the_score_rejects(spark, documents):
    rejected = {r["doc_id"] for r in llm.op6_toxicity(spark, SMALL).where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in pipeline.toxic_out(spark, documents, SMALL).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()} - rejected


def test_line_stage(spark, rows):  # noqa: F811
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.lines_out(spark, docs, SMALL).collect()
    sums = Counter(zlib.crc32((r["text"] or "").encode()) for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    want = brute_lines(rows, 10, 1)
    assert len(got) >= sum(dropped == 0 for _, _, dropped, _ in want)
    assert sum(sums.values()) <= len(rows)


def brute_first_lines(rows, least):
    """The texts with each line key of ``least`` rows or more left in the first row only."""
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    holders = defaultdict(list)
    for k in order:
        for one in {key(s) for s in (rows[k][1] or "").split("\n")} - {""}:
            holders[one].append(k)
    drops = lambda k, one: len(holders.get(one, ())) >= least and holders[one][0] != k
    return [(d, "\n".join(s for s in (x or "").split("\n") if not drops(k, key(s)))) for k, (d, x) in enumerate(rows)]


def test_line_stage_leaves_one_of_large_copy_groups(spark):
    copied = [f"copied text {g} line {k}" for g in range(2) for k in range(3)]
    some = [(k, "\n".join(copied[:3])) for k in range(12, 0, -1)] + [(k, "\n".join(copied[3:]) + " \n\t") for k in range(20, 45)]
    some += [(None, copied[0]), (5, copied[1] + "\nother"), (50, "own line\n" + copied[4].upper()), (51, None), (52, "")]
    equal = [(None, "same row")] * 11
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in some + equal], "doc_id bigint, text string, n_chars bigint").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in pipeline.lines_out(spark, docs, SMALL).collect()]
    assert ordered(got) == ordered(brute_first_lines(some + equal, 10))
    held = {s.strip() for _, t in got for s in t.split("\n")}
    assert held >= {*copied, "same row"}
    assert sum(t == "same row" for _, t in got) == 1


def test_near_copy_stage_keeps_one_of_each_group(spark, rows):  # noqa: F811
    some = [(d, t) for d, t in rows if d is not None][:-2]
    docs = spark.createDataFrame(some, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in pipeline.near_copies_out(spark, docs, SMALL).collect()}
    groups = defaultdict(set)
    for d, _, c in brute_components(some, 80):
        groups[c].add(d)
    assert kept == {min(g) for g in groups.values()}


def test_toxic_stage_judges_each_row(spark):
    r = __import__("random").Random(2)
    words = ["the", "of", "under", "table", "house", "green", "walk", "river", "stone", "report"]
    text = lambda bad: " ".join([r.choice(words) for _ in range(20)] + ["idiot"] * bad)
    some = [(k, text(k % 4 == 0)) for k in range(400)] + [(None, "you idiot"), (None, "green house"), (1, "an idiot here"), (4, "a green table")]
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int").createOrReplaceTempView("toxic_labels")
    docs = spark.createDataFrame(some, "doc_id bigint, text string")
    held = pipeline.table
    pipeline.table = lambda *_: spark.table("toxic_labels")
    try:
        got = [tuple(x) for x in pipeline.toxic_out(spark, docs, SMALL).collect()]
    finally:
        pipeline.table = held
    assert ordered(got) == ordered(x for x in some if "idiot" not in x[1])


def test_near_copy_stage_with_nulls_and_repeated_ids(spark, rows):  # noqa: F811
    some = [*rows, rows[-2], rows[-1], (None, rows[0][1] + " tail"), rows[2], rows[2]]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.near_copies_out(spark, docs, SMALL).collect())
    assert not got - Counter(some)
    # Components of rows: each number stands for its row, so that repeated ids stay apart.
    group = [(c, n) for _, n, c in brute_components([(k, t) for k, (_, t) in enumerate(some)], 80)]
    members = defaultdict(list)
    for k, (c, n) in enumerate(group):
        members[c if n else -1 - k].append(k)
    key = lambda k: 1 << 62 if some[k][0] is None else some[k][0]
    assert sum(got.values()) == len(members)
    assert ordered(d for d, _ in got.elements()) == ordered(some[min(g, key=key)][0] for g in members.values())
    for g in members.values():
        assert any(some[k] in got for k in g)


def test_mixing_stage_rounds_repeated_rows_each(spark):
    from strataform.llm import mixing

    some = [(k % 3 if k % 3 else None, "same words here " * (5 + k % 2), "s") for k in range(40)] + [(100 + k, "w " * 40, "t") for k in range(9)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string, source string")
    wanted = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    got = pipeline.mixed(spark, docs, SMALL).collect()
    for s, target in wanted.items():
        assert abs(sum(len(r["text"].split()) for r in got if r["source"] == s) - target) <= 40, s


def test_mixing_stage_repeats_documents(spark, documents):
    from strataform.llm import mixing

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(documents).collect()}
    got = Counter(r["doc_id"] for r in pipeline.mixed(spark, documents, SMALL).collect())
    assert got == {d: c for d, c in copies.items() if c}


def test_encoding_stage_draws_copies_apart(spark):
    text = "the engineering of segmentation varies. " * 9
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, text), (None, text)] * 2 + [(None, None), (None, "")], "doc_id bigint, text string")
    got = pipeline.encoded(spark, docs.repartition(3), SMALL).collect()
    assert len(got) == 9
    assert all(r["lossless"] for r in got)
    assert len({bytes(r["ids"]) for r in got}) == 8


def test_run_is_lossless_and_repeats(spark):
    got = pipeline.run(spark, SMALL)
    rows_ = got.select("doc_id", "n_tokens", "ids_crc32", "lossless").collect()
    assert rows_
    assert all(r["lossless"] for r in rows_)
    again = pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_crc32", "lossless").collect()
    assert ordered(map(tuple, rows_)) == ordered(map(tuple, again))


def test_run_equals_brute_force(spark, tmp_path):
    """One source, so that the mix takes each document once; the other stages are done again by hand."""
    from strataform.llm import sentencepiece_codec

    from .test_operators import one_by_one

    r = __import__("random").Random(3)
    words = ["the", "of", "under", "table", "house", "green", "walk", "river", "stone", "report", "idle"]
    some, labels = [], []
    for k in range(320):
        text = [r.choice(words) for _ in range(30)]
        bad = k % 5 == 0
        if bad:
            text[r.randrange(30)] = r.choice(["idiot", "1d10t", "i d i o t"]) if k > 200 else "idiot"
        some.append((k, " ".join(text) + ("\nAll rights reserved." if k % 7 == 1 else "")))
        labels.append((k, 1, int(bad)))
    some += [(400 + k, some[31][1] + f" more{k}") for k in range(3)] + [(500, some[33][1]), (501, None), (502, ""), (None, "no id at all")]
    spark.createDataFrame([(d, t, "en", "one", len(t or "")) for d, t in some], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    clean = [(d, t) for d, t in some if d is None or d >= 400 or d % 5]
    lines = brute_first_lines(clean, 10)
    components = brute_components(lines, 80)
    kept = [(d, t) for (d, t), (_, n, c) in zip(lines, components, strict=True) if not n or c == d]
    c = sentencepiece_codec.Codec(None, 0.1, 0)
    import pyarrow as pa

    want = []
    for d, t in kept:
        key = sentencepiece_codec.document_keys(pa.RecordBatch.from_pydict({"doc_id": [d], "text": [t], "copy": [1]}), [t])[0]
        ids = one_by_one(c, t, key)
        want.append((d, len(t.encode()), len(ids), tuple(ids), True))
    got = pipeline.run(spark, f"file://{tmp_path}").collect()
    import numpy as np

    found = [(x["doc_id"], x["n_bytes"], x["n_tokens"], tuple(np.frombuffer(x["ids"], np.uint16).tolist()), x["lossless"]) for x in got]
    assert ordered(found) == ordered(want)


def test_stages_take_odd_rows(spark, rows):  # noqa: F811
    docs = spark.createDataFrame([(d, t, "en", None if k % 3 else "s", 0, "extra") for k, (d, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, size string")
    for some in (docs, docs.limit(0)):
        df = some
        for _, stage in pipeline.STAGES:
            df = stage(spark, df, SMALL)
            df.agg(F.count(F.lit(1))).collect()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = llm.queries()[name](spark, SMALL)
    found = duck.sql(llm.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_each_operator_has_its_query():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{k}" for k in range(1, 11)]
