"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores come from a public model file.  Encoding keeps an agenda of candidate
merges: the best scored, leftmost first.  With dropout a candidate that comes up is passed
over when a keyed hash of seed, document, occurrence, place and piece falls below the rate, and
it stays dropped until a neighbouring merge makes a new candidate there.  Segmentations vary
by the occurrence of a word, are the same in each rerun, and all decode to the same text.

A piece never continues across the start of a run of ``U+2581``, which the loader verifies, so
texts are cut there, and at other places that no merge can cross, into parts.  Each
occurrence of a part draws its own dropout and goes through its own agenda; the parts of a
batch do so together, in numpy, one column each.  What a worker keeps from batch to batch is
the model alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, only, pieces

SPACE = "▁"
MASK = (1 << 64) - 1
#: Longer parts go through a heap one by one.
LONGEST = 64
#: Parts that are taken through their agendas at a time.
TOGETHER = 1 << 14
#: The mixing of a candidate's place and rank with the key of its occurrence.
PLACE, RANK, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a BPE model with byte fallback."""

    def __init__(self, path: str | None) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        n = sp.get_piece_size()
        self.text: list[str] = [sp.id_to_piece(i) for i in range(n)]
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.bytes[i] = int(p[1:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.score[p] = sp.get_score(i)
        self.of_byte = {b: i for i, b in self.bytes.items()}
        if len(self.of_byte) != 256:
            raise ValueError("the model lacks byte fallback, so it can't encode all texts")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece of the model holds the end of a word and the start of the next")
        self.unk = sp.unk_id()
        #: Rank of a piece: the higher its score, the smaller.
        self.rank = {p: r for r, p in enumerate(sorted(self.score, key=lambda p: (-self.score[p], self.ids[p])))}
        self.splits_lines = not any("\n" in p for p in self.ids)
        if n > 1 << 16:
            raise ValueError("ids are stored in 16 bits, and the model has more pieces")

    def fallback(self, char: str) -> list[int]:
        return [self.of_byte[b] for b in char.encode("utf-8", "surrogatepass")]


def merge(word: str, rank: dict[str, int], threshold: int = 0, key: int = 0) -> list[str]:
    """Symbols of ``word`` after its merges; ``threshold`` of 2**32 is the dropout rate.

    Short words are searched for the best candidate after each merge, which does what an
    agenda does; long ones keep a heap.
    """
    if len(word) > 48:
        return merge_heap(word, rank, threshold, key)
    symbols = list(word)
    none = len(rank)
    get = rank.get
    scores = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
    at = list(range(len(symbols)))
    while scores:
        best = min(scores)
        if best == none:
            break
        k = scores.index(best)
        if threshold and dropped(key, at[k], best, threshold):
            scores[k] = none
            continue
        symbols[k] += symbols.pop(k + 1)
        at.pop(k + 1)
        scores.pop(k)
        if k < len(scores):
            scores[k] = get(symbols[k] + symbols[k + 1], none)
        if k:
            scores[k - 1] = get(symbols[k - 1] + symbols[k], none)
    return symbols


def merge_heap(word: str, rank: dict[str, int], threshold: int, key: int) -> list[str]:
    """The same with an agenda, for words of any length."""
    import heapq

    n = len(word)
    text: list[str | None] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, str, str]] = []

    def offer(k: int) -> None:
        j = after[k]
        if j < n:
            r = rank.get(text[k] + text[j])
            if r is not None:
                heapq.heappush(agenda, (r, k, text[k], text[j]))

    for k in range(n - 1):
        offer(k)
    while agenda:
        r, k, a, b = heapq.heappop(agenda)
        j = after[k]
        if text[k] != a or j >= n or text[j] != b:
            continue
        if threshold and dropped(key, k, r, threshold):
            continue
        text[k], text[j] = a + b, None
        after[k] = after[j]
        if after[j] < n:
            before[after[j]] = k
        offer(k)
        if before[k] >= 0:
            offer(before[k])
    return [x for x in text if x is not None]


def dropped(key: int, place: int, piece: int, threshold: int) -> bool:
    """Whether the keyed hash drops this candidate: the top 32 bits of a mixed product."""
    x = (key ^ place * PLACE ^ piece * RANK) & MASK
    x = (x ^ x >> 29) * MIX1 & MASK
    return (x ^ x >> 32) * MIX2 >> 32 & 0xFFFFFFFF < threshold


class PairTable:
    """The model's merges in a hash table, to take many parts through their agendas at once."""

    def __init__(self, pieces: Pieces) -> None:
        ids, rank = pieces.ids, pieces.rank
        self.base = len(pieces.text)
        pairs: dict[int, int] = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = r
        self.none = len(rank)
        self.shift = 64 - (4 * len(pairs) + 64).bit_length()
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.ranks = np.full(len(self.keys), self.none, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.slots(left)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[place], self.ranks[place] = left[won], ranks[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, ranks, at = left[stay], ranks[stay], (at[stay] + 1) % len(self.keys)
        self.id_of_rank = np.empty(len(rank), np.int32)
        for p, r in rank.items():
            self.id_of_rank[r] = ids[p]
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, k in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(PLACE) >> np.uint64(self.shift)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, or ``none``; negative symbols make nothing."""
        key = left.astype(np.int64) * self.base + right
        at = self.slots(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], self.none)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            at_rest = (at[rest] + 1) % len(self.keys)
            at[rest] = at_rest
            held = self.keys[at_rest]
            hit = held == key[rest]
            out[rest[hit]] = self.ranks[at_rest[hit]]
            rest = rest[~hit & (held >= 0)]
        out[(left < 0) | (right < 0)] = self.none
        return out

    def segment(self, symbols: np.ndarray, keys: np.ndarray, threshold: int) -> np.ndarray:
        """What is left of ``symbols``, one part a column with -2 below its end, after its agenda; -3 stands where a symbol went.

        One round takes the best candidate of each part: it is dropped, or merged.
        """
        width, n = symbols.shape
        out = np.empty((width, n), np.int32)
        where = np.arange(n)
        # One row more stands for what is before the first symbol and after the last.
        s = np.vstack([symbols, np.full((1, n), -2, np.int32)])
        after = np.repeat(np.arange(1, width + 2, dtype=np.uint8)[:, None], n, axis=1)
        before = np.repeat(np.concatenate([[width], np.arange(width + 1)])[: width + 1, None].astype(np.uint8), n, axis=1)
        none = np.int32(self.none << 6)
        place = np.arange(width + 1, dtype=np.int32)[:, None]
        todo = np.full((width + 1, n), none, np.int32)
        todo[: width - 1] = np.minimum(self.rank(s[: width - 1].ravel(), s[1:width].ravel()).reshape(width - 1, n) << 6 | place[: width - 1], none)
        keys = keys.astype(np.uint64)
        while True:
            best = todo.min(axis=0)
            open_ = best < none
            count = int(open_.sum())
            if count < 0.7 * n or not count:
                shut = ~open_
                out[:, where[shut]] = s[:width, shut]
                if not count:
                    return out
                s, after, before, todo = (np.ascontiguousarray(x[:, open_]) for x in (s, after, before, todo))
                where, keys, best, n = where[open_], keys[open_], best[open_], count
                open_ = np.ones(n, bool)
            k, r = best & 63, best >> 6
            if threshold:
                x = keys ^ k.astype(np.uint64) * np.uint64(PLACE) ^ r.astype(np.uint64) * np.uint64(RANK)
                x = (x ^ x >> np.uint64(29)) * np.uint64(MIX1)
                x = (x ^ x >> np.uint64(32)) * np.uint64(MIX2)
                drop = (x >> np.uint64(32)) < np.uint64(threshold)
                gone = np.flatnonzero(drop & open_)
                todo[k[gone], gone] = none
                open_ &= ~drop
            c = np.flatnonzero(open_)
            k, new = k[c], self.id_of_rank[r[c]]
            flat_s, flat_after, flat_before, flat_todo = (x.reshape(-1) for x in (s, after, before, todo))
            here = k * n + c
            right = flat_after[here].astype(np.int64)
            further = flat_after[right * n + c].astype(np.int64)
            ahead = flat_before[here].astype(np.int64)
            flat_s[here], flat_s[right * n + c], flat_todo[right * n + c] = new, -3, none
            flat_after[here], flat_before[further * n + c] = further, k
            ranks = self.rank(np.concatenate([new, flat_s[ahead * n + c]]), np.concatenate([flat_s[further * n + c], new]))
            flat_todo[here] = np.minimum(ranks[: len(c)] << 6 | k, none)
            flat_todo[ahead * n + c] = np.minimum(ranks[len(c) :] << 6 | ahead.astype(np.int32), none)


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, path: str | None = None, dropout: float = 0.1, seed: int = 0) -> None:
        if not 0 <= dropout < 1:
            raise ValueError("the dropout rate is at least 0 and below 1")
        self.pieces = Pieces(path)
        self.pairs = PairTable(self.pieces)
        self.threshold = int(dropout * (1 << 32))
        self.seed = seed
        vocabulary = self.pieces.ids
        #: Marks that no piece joins to a letter before them.
        self.stops = np.array(sorted(ord(c) for c in ".,;:!?" if not any(re.search(f"[^\\W\\d_]{re.escape(c)}", p) for p in vocabulary)), np.uint32)
        self.letter = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
        #: Characters that no piece has: they are parts of their own, written as bytes, and so is U+2581 in a text.
        self.alone = np.ones(0x110000, bool)
        self.alone[[ord(c) for c in {c for p in vocabulary for c in p}]] = False
        self.alone[ord(SPACE)] = True
        self.alone[ord(" ")] = False

    def cut(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the parts of texts, given as code points with a space before each text, and whether a part is written as bytes.

        No merge crosses the start of a run of spaces, a character of its own, a line end if
        no piece has one, or the place before a stop that ends a part after a letter.
        """
        space, alone = flat == 32, self.alone[flat]
        apart = alone | (flat == 10) if self.pieces.splits_lines else alone
        start = apart | space
        start[1:] &= ~(space[1:] & space[:-1])
        start[1:] |= apart[:-1]
        start[first] = True
        ends = np.append(start[1:], True)
        stop = np.flatnonzero(ends & ~start & np.isin(flat, self.stops))
        start[stop[self.letter[flat[stop - 1]]]] = True
        at = np.flatnonzero(start)
        return at, alone[at]

    def ids_of(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        known = self.pieces.ids
        for s in symbols:
            i = known.get(s)
            if i is None:
                ids.extend(self.pieces.fallback(s))
            else:
                ids.append(i)
        return ids

    def word(self, word: str, key: int) -> list[int]:
        """Ids of one part for one key, by itself."""
        return self.ids_of(merge(word, self.pieces.rank, self.threshold, key))

    def keys(self, count: np.ndarray, documents: list[int]) -> np.ndarray:
        """Keys of the parts of documents with so many parts each, by document and place in it."""
        own = np.array([xxhash.xxh3_64_intdigest((k & MASK).to_bytes(8, "little"), self.seed & MASK) for k in documents], np.uint64)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        x = np.repeat(own, count) + place.astype(np.uint64) * np.uint64(PLACE)
        x = (x ^ x >> np.uint64(30)) * np.uint64(MIX1)
        x = (x ^ x >> np.uint64(27)) * np.uint64(MIX2)
        return x ^ x >> np.uint64(31)

    def encode_batch(self, texts: list[str], documents: list[int]) -> list[bytes]:
        """Ids of many texts as little-endian unsigned 16-bit integers; ``documents`` are keys that tell them apart."""
        full = [k for k, t in enumerate(texts) if t]
        out = [b""] * len(texts)
        if not full:
            return out
        flat = np.frombuffer("".join([" " + texts[k] for k in full]).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *(len(texts[k]) + 1 for k in full[:-1])])
        at, alone = self.cut(flat, first)
        size = np.diff(np.append(at, len(flat)))
        cut = np.append(np.searchsorted(at, first), len(at))
        keys = self.keys(np.diff(cut), [documents[k] for k in full])
        symbols = self.pairs.of_char[np.where(flat == 32, np.uint32(ord(SPACE)), flat)]
        count = np.zeros(len(at), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def put(parts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
            count[parts] = counts
            found.append((parts, ids.astype("<u2")))

        odd = np.zeros(len(at), bool)
        odd[np.searchsorted(at, np.flatnonzero(symbols < 0), side="right") - 1] = True
        odd = (odd | (size > LONGEST)) & ~alone
        single = np.flatnonzero((size == 1) & ~odd & ~alone)
        put(single, np.ones(len(single), np.int64), symbols[at[single]])
        lone = np.flatnonzero(alone)
        if len(lone):
            chars, which = np.unique(flat[at[lone]], return_inverse=True)
            ids = [self.pieces.fallback(chr(c)) for c in chars.tolist()]
            each = np.array([len(x) for x in ids])
            put(lone, each[which], _gather(np.array([x for own in ids for x in own]), (np.cumsum(each) - each)[which], each[which]))
        slow = np.flatnonzero(odd)
        if len(slow):
            ids = [self.word("".join(map(chr, flat[a : a + n].tolist())).replace(" ", SPACE), k) for a, n, k in zip(at[slow].tolist(), size[slow].tolist(), keys[slow].tolist(), strict=True)]
            put(slow, np.array([len(x) for x in ids]), np.array([x for own in ids for x in own]))
        rest = np.flatnonzero((size > 1) & ~odd & ~alone)
        rest = rest[np.argsort(size[rest].astype(np.uint8), kind="stable")]
        for a in range(0, len(rest), TOGETHER):
            some = rest[a : a + TOGETHER]
            long = size[some]
            row = np.arange(int(long[-1]))[:, None]
            inside = np.where(row < long, symbols[np.minimum(at[some] + row, len(symbols) - 1)], np.int32(-2))
            left = self.pairs.segment(inside, keys[some], self.threshold).T
            stay = left >= 0
            put(some, stay.sum(axis=1), left[stay])
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]), "<u2")
        for parts, own in found:
            ids[_places((ends - count)[parts], count[parts])] = own
        stops = np.append(0, ends)[cut].tolist()
        for k, a, b in zip(full, stops[:-1], stops[1:], strict=True):
            out[k] = ids[a:b].tobytes()
        return out

    def encode(self, text: str, key: int = 0) -> bytes:
        """Ids of one text; ``key`` tells the document."""
        return self.encode_batch([text], [key])[0]

    def decode(self, ids: bytes) -> str:
        values = np.frombuffer(ids, np.uint16).tolist()
        if not values:
            return ""
        table = self.decode_table()
        data = b"".join([table[i] for i in values])
        return data[1:].decode("utf-8", "surrogatepass")

    def decode_table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            p = self.pieces
            self._table = [bytes([p.bytes[i]]) if i in p.bytes else t.replace(SPACE, " ").encode() for i, t in enumerate(p.text)]
        return self._table


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, counts[0] of them; then from starts[1]; and so on."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return values[_places(starts, counts)]


def codec(*args) -> Codec:
    """The codec of this worker process."""
    return only(("sentencepiece", *args), lambda: Codec(*args))


def document_keys(batch: pa.RecordBatch, texts: list[str]) -> list[int]:
    """Keys of the documents of a batch: id, number of the copy and text."""
    return [xxhash.xxh3_64_intdigest(t.encode(), zlib.crc32(f"{d}:{n}".encode())) ^ xxhash.xxh3_64_intdigest(f"{d}:{n}".encode()) for d, n, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True)]


def _source(docs: DataFrame, id_col: str, text_col: str, copy_col: str | None) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(copy_col) if copy_col else F.lit(0)).cast("int").alias("copy"))


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = 0.1, seed: int = 0, copy_col: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids (little-endian unsigned 16-bit) and ids_crc32, one row per row.

    A null or empty text has no ids.  Null and repeated ids are kept; equal texts with equal
    ids get equal segmentations unless ``copy_col`` numbers them as copies.  Texts of any length are encoded whole.  An empty table gives
    an empty result; other columns are ignored.
    """
    source = _source(docs, id_col, text_col, copy_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout, seed)
        for batch in pieces(batches, 4000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = c.encode_batch(texts, document_keys(batch, texts))
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "n_bytes", "n_tokens", "ids", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def decode_ids(rows: DataFrame, *, ids_col: str = "ids", model: str | None = None, out_col: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text added; null ids decode to null."""

    @F.pandas_udf("string")
    def run(column):
        c = codec(model, 0.0, 0)
        return column.map(lambda x: None if x is None else c.decode(bytes(x)))

    return rows.withColumn(out_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = 0.1, seed: int = 0, copy_col: str | None = None) -> DataFrame:
    """What ``encode_texts`` returns, with text_sha256 of the decoded text and whether it is the text."""
    import hashlib

    source = _source(docs, id_col, text_col, copy_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout, seed)
        for batch in pieces(batches, 4000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = c.encode_batch(texts, document_keys(batch, texts))
            size = [len(t.encode()) for t in texts]
            sums, same = [], []
            for text, x in zip(texts, ids, strict=True):
                back = c.decode(x)
                sums.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(sums, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "ids", "ids_crc32", "text_sha256", "lossless"])

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, ids binary, ids_crc32 bigint, text_sha256 string, lossless boolean")
