"""Encodings against plain Python at the edges of blocks, and back again."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from strataform.functions.exprs import bit_length, bits_key, utf8_prefix
from strataform.operators import doubles, integers, logical, rows, runs, strings

B = 16
LENGTHS = [0, 1, B - 1, B, B + 1, 3 * B + 5]


def frame(spark, values, kind):
    df = spark.createDataFrame(list(enumerate(values)), f"row bigint, v {kind}").repartition(3)
    return rows.with_block(df, "row", B)


def cut(values):
    return [values[a : a + B] for a in range(0, len(values), B)]


@pytest.mark.parametrize("n", LENGTHS)
def test_integer_sizes(spark, n):
    values = [None if k % 11 == 5 else (k * 2654435761) % 97 if k < 2 * B else 7 for k in range(n)]
    got = {r["blk"]: r for r in integers.choose(frame(spark, values, "int")).collect()}
    for k, block in enumerate(cut(values)):
        have = [v for v in block if v is not None]
        spread = (max(have) - min(have) if have else 0) + (len(have) < len(block))
        width = spread.bit_length()
        n_runs = len(list(itertools.groupby(block)))
        sizes = {"runs": 8 + 8 * n_runs, "frame": 8 + -(-len(block) * width // 8), "raw": 4 * len(block)}
        if len(have) == len(block) >= 2:
            steps = [b - a for a, b in itertools.pairwise(block)]
            w = (max(steps) - min(steps)).bit_length()
            if w < width:
                sizes["delta"] = 16 + -(-(len(block) - 1) * w // 8)
        least = min(sizes.values())
        assert got[k]["bytes"] == least
        assert got[k]["encoding"] == next(e for e in ("runs", "delta", "frame", "raw") if sizes.get(e) == least)
    assert len(got) == len(cut(values))


@pytest.mark.parametrize("n", LENGTHS)
def test_integer_inverses(spark, n):
    values = [(k * 7919) % 1000 - 500 for k in range(n)]
    df = frame(spark, values, "int")
    assert [r["v"] for r in integers.restored(integers.steps(df)).orderBy("row").collect()] == values
    assert [r["v"] for r in integers.joined_planes(integers.planes(df)).orderBy("row").collect()] == values


@pytest.mark.parametrize("n", LENGTHS)
def test_runs_keep_leading_missing_values(spark, n):
    values = [None if k % 9 < 4 else k % 9 == 8 for k in range(n)]
    got = [(r["blk"], r["value"], r["len"], r["end"]) for r in runs.runs(frame(spark, values, "boolean"), "v").orderBy("blk", "run").collect()]
    want = []
    for k, block in enumerate(cut(values)):
        end = 0
        for v, g in itertools.groupby(block):
            size = len(list(g))
            end += size
            want.append((k, v, size, end))
    assert got == want


@pytest.mark.parametrize("n", LENGTHS)
def test_logical_planes_invert(spark, n):
    values = [[True, None, False, True][k * 31 % 4] for k in range(n)]
    df = frame(spark, values, "boolean")
    back = logical.unplaned(logical.planes(df)).join(df.select("blk", "pos"), ["blk", "pos"], "left_semi")
    assert [r["v"] for r in back.orderBy("blk", "pos").collect()] == values


def test_logical_ties_and_periods(spark):
    tie = frame(spark, [True, False] * 2 + [None] * 2, "boolean")
    assert logical.stats(tie).first()["default_state"] == 0
    df = frame(spark, [k % 3 == 0 for k in range(B)], "boolean")
    assert [tuple(r) for r in logical.periods(df).collect()] == [(0, 3)]
    assert logical.periods(frame(spark, [True] * B, "boolean")).count() == 0
    assert logical.choose(frame(spark, [None] * B, "boolean")).first()["encoding"] == "constant"


def test_doubles_on_bits(spark):
    values = [0.0, -0.0, float("nan"), float("nan"), None, 1.5, 2.0**-1074, float("inf")]
    df = frame(spark, values, "double")
    assert [r["len"] for r in doubles.bit_runs(df).orderBy("run").collect()] == [1, 1, 2, 1, 1, 1, 1]
    places = df.select("row", doubles.decimal_places("v").alias("p")).orderBy("row").collect()
    assert [r["p"] for r in places] == [0, None, None, None, None, 1, None, None]
    keys = [r[0] for r in df.select(bits_key("v")).collect()]
    assert len(set(keys)) == 7


def test_decimal_vectors(spark):
    values = [round(k * 0.05, 2) for k in range(2000)] + [math.pi]
    df = spark.createDataFrame(list(enumerate(values)), "row bigint, v double")
    got = doubles.vectors(df, 2).orderBy("vec").collect()
    assert [(r["n"], r["exceptions"], r["delta"], r["bytes"]) for r in got] == [(1024, 0, True, 24), (977, 1, True, 24 + -(-976 * 3 // 8) + 10)]
    best = doubles.candidates(rows.with_block(df, "row", 1024)).first()
    assert best["hits"] > 200
    assert best["e"] - best["f"] == 2


def test_dictionaries(spark):
    values = ["b", "a", None, "b", "c", "a", ""] * 9
    df = frame(spark, values, "string")
    entries = strings.dictionary(df)
    assert [r["v"] for r in entries.orderBy("id").collect()] == ["b", "a", None, "c", ""]
    back = strings.decode(strings.encode(df, entries), entries)
    assert [r["v"] for r in back.orderBy("row").collect()] == values
    with pytest.raises(Exception, match="no dictionary entry"):
        strings.decode(strings.encode(df, entries), entries.where("id < 3")).collect()
    chunk = strings.chunks(df, B).orderBy("chunk").first()
    assert (chunk["n"], chunk["new_entries"], chunk["base"], chunk["width"]) == (B, 5, 0, 1)


def test_distinct_share_and_factors(spark):
    df = frame(spark, ["a", "b", "b", "c", None, "a", "d"], "string")
    r = strings.distinct_share(df).first()
    assert (r["n"], r["d"], r["f1"], r["f2"]) == (7, 5, 3, 2)
    assert r["share"] == pytest.approx(5 / 7)
    assert strings.distinct_share(df.limit(0)).first()["share"] == 0
    levels = strings.levels(df)
    codes = strings.to_codes(df, levels)
    assert [x["code"] for x in codes.orderBy("row").collect()] == [1, 2, 2, 3, None, 1, 4]
    assert strings.bad_codes(codes, 3).count() == 1
    assert [x["v"] for x in strings.from_codes(codes, levels).orderBy("row").collect()] == ["a", "b", "b", "c", None, "a", "d"]


def test_packing_keeps_order_and_limit(spark):
    df = frame(spark, ["x" * (k % 50) for k in range(200)], "string")
    got = strings.packed(df, 200).join(df, "row").orderBy("row").collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["piece"], 0)
        pieces[r["piece"]] += 5 + len(r["v"])
    assert max(pieces.values()) <= 200
    assert [r["piece"] for r in got] == sorted(r["piece"] for r in got)


def test_expressions(spark):
    got = spark.range(1).select(*(bit_length(F.lit(x).cast("bigint")).alias(f"w{x}") for x in (0, 1, 255, 256))).first()
    assert tuple(got) == (0, 1, 8, 9)
    texts = spark.createDataFrame([("été ☃ snow",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(utf8_prefix("t", 4)).collect()] == ["ét", "", None]
    tags = spark.createDataFrame([(bytearray(b"plain"),), (None,), (bytearray("é".encode()),), (bytearray(b"\xff\xfe"),)], "b binary")
    assert [r[0] for r in tags.select(strings.tag("b")).collect()] == ["native", "na", "utf8", "bytes"]
