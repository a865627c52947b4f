"""Bit streams of codes: lowest bit first, one block after the other, zeros after the last code.

Blocks have a bounded number of rows, so one block is packed in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FormatError

MOST_WIDTH = 32


def bits_to_bytes(codes: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (codes.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def bytes_to_codes(data: bytes, n: int, width: int) -> np.ndarray:
    """The codes of a stream; its length has to fit and what is after the last code has to be zero."""
    if not 0 <= width <= MOST_WIDTH:
        raise FormatError("codes have at most 32 bits")
    if len(data) != (n * width + 7) // 8:
        raise FormatError("the stream does not have the length of its codes")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    if bits[n * width :].any():
        raise FormatError("the stream has bits after its last code")
    if not width:
        return np.zeros(n, np.int64)
    return bits[: n * width].reshape(n, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def pack(codes: DataFrame) -> DataFrame:
    """blk, n, width and bytes from blk, row, code and width (that of the block)."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row")
        width = int(pdf["width"].iloc[0])
        if not 0 <= width <= MOST_WIDTH or (pdf["code"].to_numpy() >> width).any():
            raise FormatError("a code does not fit in the width of its block")
        return pd.DataFrame({"blk": [pdf["blk"].iloc[0]], "n": [len(pdf)], "width": [width], "bytes": [bits_to_bytes(pdf["code"].to_numpy(), width)]})

    return codes.select("blk", "row", "code", "width").groupBy("blk").applyInPandas(run, "blk bigint, n bigint, width bigint, bytes binary")


def unpack(packed: DataFrame) -> DataFrame:
    """blk, place (from 0 in its block) and code."""

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for blk, n, width, data in zip(pdf["blk"], pdf["n"], pdf["width"], pdf["bytes"], strict=True):
                yield pd.DataFrame({"blk": blk, "place": np.arange(n), "code": bytes_to_codes(bytes(data), int(n), int(width))})

    return packed.select("blk", "n", "width", F.col("bytes")).mapInPandas(run, "blk bigint, place bigint, code bigint")
