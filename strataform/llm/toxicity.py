"""Toxicity after noisy-channel deobfuscation.

A suspicious token (digits and signs among letters, repeated letters, letters set apart) is
a lattice: each run of a character may stand for one of some letters, for one or two of
them, or for nothing, each at a channel cost.  An exact Viterbi search finds the cheapest way
through it: letters cost what a character trigram model of the whole corpus says, and a word
of the lexicon, or a beginning that the lexicon has, costs a fixed amount instead.  Letters
set apart may also be cut into words at any place.  The result replaces the token, whatever
its length, and the restored text is scored.

Scores come from words and word beginnings that are far more common in toxic than in other
labelled documents.  Each has the probability of the label given its presence; a document's
score joins those of its distinct words by a noisy or.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, only, pieces, tree_merge

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s"}
#: Symbols of the character model: the edge of a word, a-z, 37 hashed other letters.
SYMBOLS = 64
#: Costs, in nats, of reading a sign as a letter, dropping a sign, and folding a run.
AS_LETTER, DROPPED, FOLDED = 0.5, 4.0, 0.3
#: What a star may mask, and its cost.
MASKED, UNMASKED = "aeiou", 2.0
#: The cost of a word of the lexicon, in nats; the probability of a restored word is doubted a little.
KNOWN, DOUBT = 3.0, 0.97
STEMS = (4, 5, 6)

SPACED = re.compile(r"(?:(?<=\s)|^)\S(?: \S){2,}(?=\s|$)")
APART = re.compile(r"^\w(?:[.\-_*~,/]\w){2,}$")
LETTER_RUN = re.compile(r"([^\W\d_])\1\1")
DOUBLED = re.compile(r"(\w)\1+")
REPEATED = re.compile(r"(.)\1+")
REPEATED_OR_ONE = re.compile(r"(.)\1*", re.DOTALL)
SEPARATORS = re.compile(r"[.\-_*~,/]")
TOKEN = re.compile(r"\S+")
ENDS = re.compile(r"([^\w\s])\1+$")


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c.isalpha() else 0


def _symbol_table() -> np.ndarray:
    """Symbols of the code points of the basic plane; others count as edges."""
    table = np.zeros(0x10000, np.uint8)
    for k in range(0x10000):
        c = chr(k)
        if c.isalpha():
            table[k] = symbol(c)
    return table


_tables: dict = {}


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of letters over all texts: one fixed table a partition, added in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "symbols" not in _tables:
            _tables["symbols"] = _symbol_table()
        table = _tables["symbols"]
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in pieces(batches, 1000, 4 << 20):
            text = "  ".join(t for t in batch.column(0).to_pylist() if t)
            points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.zeros(len(points) + 2, np.int64)
            s[1:-1] = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], 0)
            total += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    def add(a: bytes, b: bytes) -> bytes:
        return zlib.compress((np.frombuffer(zlib.decompress(a), np.int64) + np.frombuffer(zlib.decompress(b), np.int64)).tobytes(), 1)

    merged = tree_merge(docs.select(F.col(text_col).cast("string")).mapInArrow(run, "counts binary"), "counts", add, 8 * SYMBOLS**3)
    return np.zeros(SYMBOLS**3, np.int64) if merged is None else np.frombuffer(zlib.decompress(merged), np.int64)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """Minus the log of the probability of a symbol after two others, smoothed by shorter contexts."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi over lattices: words as tuples of letters, under the character model and a lexicon."""

    def __init__(self, costs: np.ndarray, words: Iterable[str] = (), stems: Iterable[str] = ()) -> None:
        self.costs = costs.tolist()
        #: The lexicon as a tree: children of each node, whether a word ends there, and the last two symbols of a beginning.
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[bool] = [False]
        self.goes_on: list[tuple[int, int] | None] = [None]
        for w in words:
            self.ends[self._node(w)] = True
        for w in stems:
            self.goes_on[self._node(w)] = (symbol(w[-2]), symbol(w[-1]))

    def _node(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.kids[at]:
                self.kids[at][c] = len(self.kids)
                self.kids.append({})
                self.ends.append(False)
                self.goes_on.append(None)
            at = self.kids[at][c]
        return at

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of a character: what it may stand for, and the channel cost."""
        out = []
        for run in REPEATED_OR_ONE.finditer(token):
            c, n = run[1], len(run[0])
            found: dict[str, float] = {}
            if c.isalpha():
                found[c] = 0.0 if n == 1 else FOLDED
                if n >= 2:
                    found[c + c] = 0.0 if n == 2 else FOLDED
            else:
                for x in LEET.get(c, ""):
                    found[x] = AS_LETTER
                    if n >= 2:
                        found[x + x] = AS_LETTER
                if c == "*":
                    found.update((x, UNMASKED) for x in MASKED)
                found[""] = DROPPED if c in LEET else 0.2
            out.append(sorted(found.items()))
        return out

    def spells(self, token: str, apart: bool = False) -> bool:
        """Whether the lattice can spell anything of the lexicon; ``apart``: at any place in it."""
        states: set[int] = {0}
        for choices in self.options(token):
            new: set[int] = {0} if apart else set()
            for state in states:
                for letters, _ in choices:
                    at: set[int] = {state}
                    for k, c in enumerate(letters):
                        if any(self.goes_on[n] for n in at):
                            return True
                        at = {self.kids[n][c] for n in (at | {0} if apart and k else at) if c in self.kids[n]}
                        if apart and any(self.ends[n] for n in at):
                            return True
                    new |= at
            states = new
            if not states:
                return False
        return any(self.ends[n] for n in states)

    def best(self, token: str, apart: bool = False) -> tuple[float, list[str]]:
        """The cheapest reading and its cost, as words: one, or several if the letters stood ``apart``.

        States are a boundary (-1), a node of the lexicon, or the last two symbols of a word
        that the lexicon lacks.  Each state keeps its cheapest way, so the search is exact.
        """
        costs, kids, ends, goes_on = self.costs, self.kids, self.ends, self.goes_on
        base = 1 << 40
        layer: dict[int, tuple[float, tuple]] = {-1: (0.0, ())}

        def step(states: dict[int, tuple[float, tuple]], c: str) -> dict[int, tuple[float, tuple]]:
            new: dict[int, tuple[float, tuple]] = {}
            s = symbol(c)

            def to(state: int, cost: float, way: tuple) -> None:
                if state not in new or cost < new[state][0]:
                    new[state] = (cost, (way, c))

            for state, (cost, way) in states.items():
                if state == -1:
                    to(base + s, cost + costs[0][0][s], way)
                    if c in kids[0]:
                        to(kids[0][c], cost, way)
                elif state >= base:
                    x, y = divmod(state - base, SYMBOLS)
                    to(base + y * SYMBOLS + s, cost + costs[x][y][s], way)
                else:
                    if c in kids[state]:
                        to(kids[state][c], cost, way)
                    if goes_on[state]:
                        x, y = goes_on[state]
                        to(base + y * SYMBOLS + s, cost + KNOWN + costs[x][y][s], way)
            return new

        def closed(states: dict[int, tuple[float, tuple]]) -> tuple[float, tuple] | None:
            """The cheapest way whose last word ends here."""
            found = [(cost, way) for state, (cost, way) in states.items() if state == -1]
            for state, (cost, way) in states.items():
                if state >= base:
                    x, y = divmod(state - base, SYMBOLS)
                    found.append((cost + costs[x][y][0], (way, " ")))
                elif state >= 0 and ends[state]:
                    found.append((cost + KNOWN, (way, " ")))
            return min(found, key=lambda f: f[0], default=None)

        for choices in self.options(token):
            new: dict[int, tuple[float, tuple]] = {}
            for letters, extra in choices:
                some = {state: (cost + extra, way) for state, (cost, way) in layer.items()}
                for k, c in enumerate(letters):
                    if apart and k and (cut := closed(some)):
                        some[-1] = cut
                    some = step(some, c)
                for state, held in some.items():
                    if state not in new or held[0] < new[state][0]:
                        new[state] = held
            if apart and (cut := closed(new)):
                new[-1] = cut
            layer = new
        last = closed(layer)
        if last is None:
            return math.inf, []
        letters, way = [], last[1]
        while way:
            way, c = way
            letters.append(c)
        return last[0], "".join(reversed(letters)).split()


def core(token: str) -> str:
    """The token without what is not a letter at its ends."""
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b]


def suspicious(token: str) -> bool:
    """Whether a lower-case token of 3 characters or more may hide a word; in long ones a run counts once."""
    if len(token) < 3:
        return False
    if len(token) > 40:
        stretched = bool(LETTER_RUN.search(token))
        token = REPEATED.sub(r"\1", token)
        if stretched and token.isalpha():
            return True
    letters = sum(c.isalpha() for c in token)
    if letters == len(token):
        return bool(LETTER_RUN.search(token))
    signs = sum(c in LEET for c in token)
    inside = core(token)
    odd = not inside.isalpha() if inside else True
    return (signs > 0 or odd) and letters + signs >= 3 and letters >= 1 and signs <= max(3, letters + 1)


def features(word: str) -> list[str]:
    """The word, and its beginnings if it goes on after them."""
    return ["=" + word, *(str(k) + word[:k] for k in STEMS if len(word) > k)]


#: What is known of a token without any word of the lexicon.
NOTHING: tuple[tuple[str, float], ...] = ()


class Scorer:
    """Restores and scores whole texts; tokens are kept until there are too many."""

    def __init__(self, lexicon: dict[str, float], costs: np.ndarray, most: int = 200_000) -> None:
        self.lexicon, self.most = lexicon, most
        whole = [f[1:] for f in lexicon if f[0] == "="]
        self.restorer = Restorer(costs, whole, [f[1:] for f in lexicon if f[0] != "="])
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}

    def word(self, word: str) -> float:
        get = self.lexicon.get
        return max((get(f, 0.0) for f in features(word)), default=0.0)

    def hidden(self, token: str) -> str | None:
        """What stands apart or may hide a word in a token: the characters that the lattice reads, or None."""
        bare = ENDS.sub("", token)
        inside = core(bare)
        if inside and self.word(inside) > 0:
            return None
        if inside.isalpha() and not LETTER_RUN.search(inside):
            # Several doubled letters are common; the lattice is asked where undoing them gives a known word.
            doubled = len(DOUBLED.findall(inside)) >= 2 and self.word(DOUBLED.sub(r"\1", inside)) > 0
            return inside if doubled else None
        stripped = bare.rstrip(".,;:?") if bare else bare
        return stripped if suspicious(stripped) else None

    def restored(self, token: str) -> list[str]:
        """The words of a lower-case token after deobfuscation; one that hides nothing stays as it is."""
        if APART.match(token):
            return self.restorer.best(SEPARATORS.sub("", token), True)[1]
        stripped = self.hidden(token)
        return [token] if stripped is None else self.restorer.best(stripped)[1] or [token]

    def hits(self, words: list[str]) -> tuple[tuple[str, float], ...]:
        return tuple((w, DOUBT * p) for w in words if (p := self.word(w)) > 0)

    def token(self, token: str) -> tuple[tuple[str, float], ...]:
        """Words of the restored token that the lexicon knows.  A lattice that can't spell any is not searched."""
        if APART.match(token):
            return self.run(SEPARATORS.sub("", token))
        stripped = self.hidden(token)
        if stripped is not None:
            return self.hits(self.restorer.best(stripped)[1]) if self.restorer.spells(stripped) else NOTHING
        inside = core(ENDS.sub("", token))
        p = self.word(inside) if inside else 0.0
        return ((inside, p),) if p > 0 else NOTHING

    def run(self, joined: str) -> tuple[tuple[str, float], ...]:
        """The same for letters set apart, joined."""
        return self.hits(self.restorer.best(joined, True)[1]) if self.restorer.spells(joined, True) else NOTHING

    def restore(self, text: str) -> str:
        """The text, lower-case and in composed form, with every token and every run of letters set apart restored."""
        low = lowered(text)
        low = SPACED.sub(lambda m: " ".join(self.restorer.best(m[0].replace(" ", ""), True)[1]), low)
        return TOKEN.sub(lambda m: " ".join(self.restored(m[0])), low)

    def __call__(self, text: str) -> float:
        """The score of the restored text."""
        low = lowered(text)
        known = self.known
        if len(known) > self.most:
            known.clear()
        hits: list[tuple[str, float]] = []
        for token in set(low.split()):
            own = known.get(token)
            if own is None:
                own = self.token(token)
                if len(token) <= 64:
                    known[token] = own
            hits += own
        for m in SPACED.finditer(low):
            hits += self.run(m[0].replace(" ", ""))
        found: dict[str, float] = {}
        for word, p in hits:
            if p > found.get(word, 0.0):
                found[word] = p
        rest = 1.0
        for _, p in sorted(found.items()):
            rest *= 1.0 - p
        return 1.0 - rest


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


def crc_mod4(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0))


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 20_000, least: int = 4, sure: float = 0.9, seed: int = 29) -> dict[str, float]:
    """Features with the probability of label 1 given their presence.

    Learned from at most ``most`` labelled rows (a quarter of them may be of label 1) whose
    crc32 of the id is not 2 modulo 4, chosen by a seeded hash of their ids.  Features are
    counted once a document, added up in each batch before they are shuffled.  Kept are those
    of at least ``least`` toxic documents that explain documents which stronger features do not
    (see ``cover``), and all whose lower confidence bound is above ``sure``.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod4(id_col) != 2)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.withColumn("order", F.xxhash64(F.lit(seed), F.col("label_id").cast("string")))
    chosen = known.where("label = 1").orderBy("order").limit(most // 4).unionByName(known.where("label <> 1").orderBy("order").limit(most - most // 4))
    some = docs.join(F.broadcast(chosen.drop("order")), docs[id_col] == F.col("label_id")).select(F.col(text_col).cast("string").alias("text"), "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2000):
            total: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {core(ENDS.sub("", t)) for t in (text or "").lower().split()}
                total[int(label == 1)].update({f for w in words if 2 <= len(w) <= 40 for f in features(w)})
            both = total[0].keys() | total[1].keys()
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(both), pa.string()), "pos": pa.array([total[1][f] for f in both], pa.int64()), "neg": pa.array([total[0][f] for f in both], pa.int64())})

    found = some.mapInArrow(count, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = found.where((F.col("pos") >= least) & (F.col("pos") > 2 * F.col("neg"))).collect()
    counted = {r["feature"]: (r["pos"], r["neg"]) for r in rows}
    candidates = {f for f, (p, n) in counted.items() if lower_bound(p, n) > 0.6}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2000):
            own = []
            for text in batch.column(0).to_pylist():
                words = {core(ENDS.sub("", t)) for t in (text or "").lower().split()}
                own.append(sorted({f for w in words if 2 <= len(w) <= 40 for f in features(w)} & candidates))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], ["features"])

    toxic = [set(r["features"]) for r in some.where("label = 1").select("text").mapInArrow(present, "features array<string>").collect()]
    lexicon = cover(toxic, {f: n for f, (_, n) in counted.items()}, least)
    for f, (p, n) in counted.items():
        if lower_bound(p, n) > sure:
            lexicon[f] = max(lexicon.get(f, 0.0), lower_bound(p, n))
    return {f: round(min(0.995, p), 6) for f, p in sorted(lexicon.items())}


def lower_bound(pos: int, neg: int, z: float = 1.96) -> float:
    """Wilson's lower bound of the share of toxic documents."""
    n = pos + neg
    if not n:
        return 0.0
    p = pos / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def cover(documents: list[set[str]], neg: dict[str, int], least: int) -> dict[str, float]:
    """Features that explain the toxic documents one after the other, strongest first.

    What only goes along with a stronger feature, as in copies of one document, is left
    with no documents of its own and drops out.
    """
    by: dict[str, set[int]] = {}
    for k, own in enumerate(documents):
        for f in own:
            by.setdefault(f, set()).add(k)
    lexicon: dict[str, float] = {}
    while by:
        f = max(by, key=lambda f: (lower_bound(len(by[f]), neg.get(f, 0)) * len(by[f]), f))
        covered = by.pop(f)
        if len(covered) < least:
            break
        p = lower_bound(len(covered), neg.get(f, 0))
        if p > 0.5:
            lexicon[f] = p
            for k in covered:
                for g in documents[k]:
                    if g in by:
                        by[g].discard(k)
    return lexicon


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, most: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``.

    Learns from labels of rows that are not held out.  Language, source, labels and ids are
    no inputs of a score.  Null and empty texts score 0.  Null ids are not held out; repeated
    rows are scored alike.  Texts of any length are read whole.  An empty table gives an empty
    result, a table without labels scores of 0; other columns are ignored, except that
    those named in ``carry`` come back with their rows.
    """
    source, held = _learned(docs, labels, id_col, text_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker(held)
        for batch in pieces(batches):
            values = [scorer(t) if t else 0.0 for t in batch.column(1).to_pylist()]
            own = [batch.column(1) if c == text_col else batch.column(2 + others.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array([int(v >= cut) for v in values], pa.int32()), *own], ["doc_id", "score", "predicted", *(f"carried{k}" for k in range(len(carry)))])

    kind = source.schema["doc_id"].dataType.simpleString()
    # The text goes to the workers once, carried or not.
    others = [c for c in carry if c != text_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"other{k}") for k, c in enumerate(others)))
    types = "".join(f", carried{k} {'string' if c == text_col else rows.schema[f'other{others.index(c)}'].dataType.simpleString()}" for k, c in enumerate(carry))
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int{types}")
    return scored.select("doc_id", (crc_mod4("doc_id") == 2).alias("held_out"), "score", "predicted", *(F.col(f"carried{k}").alias(c) for k, c in enumerate(carry)))


def worker(held) -> Scorer:
    """The scorer of this worker process; what it knows of tokens outlives a task."""
    lexicon, packed = held.value
    key = ("toxicity", zlib.crc32(packed), len(lexicon), zlib.crc32(repr(sorted(lexicon.items())).encode()))
    return only(key, lambda: Scorer(lexicon, np.frombuffer(zlib.decompress(packed), np.float32).reshape(SYMBOLS, SYMBOLS, SYMBOLS)))


def restore_texts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """doc_id and restored: the texts as ``score`` reads them, one row per row of ``docs``; null stays null."""
    source, held = _learned(docs, labels, id_col, text_col, most)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker(held)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else scorer.restore(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "restored"])

    return source.mapInArrow(run, f"doc_id {kind}, restored string")


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int):
    """doc_id and text of the rows, and the broadcast lexicon and character model."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon = learn_lexicon(source, labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels, most=most)
    costs = character_costs(character_counts(source))
    return source, docs.sparkSession.sparkContext.broadcast((lexicon, zlib.compress(costs.tobytes(), 1)))
