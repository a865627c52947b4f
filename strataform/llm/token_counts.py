"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table of the lengths, in tokens, of frequent whitespace-led
pre-tokens, broadcast to all tasks.  Tier two is a bounded cache in each Python
worker, in which a pre-token that the table lacks is encoded by the library once.
No pre-token is ever shuffled.

The frequent pre-tokens are found over the whole table by one Misra-Gries summary
per partition; the summaries have a fixed size and are merged in a tree.  The
summary only decides what is fast: any table gives the same counts.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bound_batches, only, tree_merge


#: Longer pre-tokens are not counted, so that a summary has a bounded size in bytes.
MOST_CHARS = 64


def shrink(counts: Counter, most: int) -> Counter:
    """The Misra-Gries step: the largest ``most`` counts, less the next one."""
    if len(counts) <= most:
        return counts
    ranked = sorted(counts.values(), reverse=True)
    cut = ranked[most]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def merge_summaries(a: bytes, b: bytes, most: int) -> bytes:
    x = Counter(pickle.loads(zlib.decompress(a)))
    x.update(pickle.loads(zlib.decompress(b)))
    return pack(shrink(x, most))


def pack(counts: Counter) -> bytes:
    return zlib.compress(pickle.dumps(dict(counts)), 1)


def frequent_pretokens(texts: DataFrame, text_col: str, entries: int = 1 << 15) -> list[str]:
    """Pre-tokens that are frequent over all rows, at most ``entries``, most frequent first."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words = text.split(" ")
                    held.update(words if max(map(len, words)) <= MOST_CHARS else [w for w in words if len(w) <= MOST_CHARS])
                    if len(held) > 8 * entries:
                        held = shrink(held, entries)
        held = shrink(held, entries)
        yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], ["summary"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(summarise, "summary binary")
    merged = tree_merge(rows, "summary", lambda a, b: merge_summaries(a, b, entries), (4 * MOST_CHARS + 16) * entries)
    counts = pickle.loads(zlib.decompress(merged)) if merged else {}
    plain = (k for k in sorted(counts, key=lambda k: (-counts[k], k)) if k and not bpe.WHITE.search(k))
    return [" " + k for k in plain]


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = 1024,
    entries: int = 1 << 15,
    cache: int = 500_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and nothing else, one row per row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens.  Null and repeated ids are kept as they
    are, ties have no meaning here, an empty table gives an empty result, and columns of
    ``docs`` other than the two named are ignored, whatever their names.  A text of any
    length is counted as a whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = frequent_pretokens(source, "text", entries)
    encode = bpe.load(tokenizer)
    lengths = [len(encode.encode(x, add_special_tokens=False).ids) for x in names]
    frequent = spark.sparkContext.broadcast(arrow_table(names, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker(tokenizer, frequent, cache)
        for batch in batches:
            size, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                size.append(len(text.encode()))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def arrow_table(names: list[str], lengths: list[int]) -> bytes:
    """The frequent table as compact Arrow columns."""
    table = pa.table({"chunk": pa.array(names, pa.string()), "n": pa.array(lengths, pa.uint16())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def worker(tokenizer: str | None, frequent, cache: int):
    """The counter of this worker process; its cache outlives a task."""

    def make() -> bpe.Encoder:
        table = pa.ipc.open_stream(frequent.value).read_all()
        return bpe.Encoder(tokenizer, len, dict(zip(table["chunk"].to_pylist(), table["n"].to_pylist(), strict=True)), sum, cache)

    return only(("token counts", tokenizer, zlib.crc32(frequent.value), cache), make)
