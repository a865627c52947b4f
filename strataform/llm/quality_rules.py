"""Quality rules learned as decision lists, in DataFrame operations only.

Features are counted by built-in functions; nested ``transform`` calls bind a value to a
name once, so that an array is built once a row.  Learning reads a bounded sample of
labelled rows, cut to candidate thresholds, and covers it rule by rule: a conjunction of
thresholds grows by the condition with the best gain on one part of the sample and is
pruned on the other.  The ordered rules become one conditional Spark expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

#: Fixed values of the base counts.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

#: Whole-number features that rules may use, from the counts.
FEATURES = {
    "n_words": "n_words",
    "symbols_permille": "n_symbols * 1000 div greatest(n_words, 1)",
    "dup_lines_permille": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeat_permille": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length_percent": "word_chars * 100 div greatest(n_words, 1)",
    "capitals_permille": "n_capitals * 1000 div greatest(word_chars, 1)",
    "digits_permille": "n_digits * 1000 div greatest(word_chars, 1)",
    "marks_permille": "n_marks * 1000 div greatest(n_words, 1)",
    "distinct_permille": "n_distinct * 1000 div greatest(n_words, 1)",
    "words_a_line": "n_words div greatest(n_lines, 1)",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words covered by the 3-word windows that occur twice or more among ``words``."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def slow(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def places(p: Column) -> Column:
            twice = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["k"]))

        return let(let(pairs, places), covered)

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(slow(hashes))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each text; null counts as empty.

    word_chars are the code points in words, n_symbols the characters of ``#*$%&|<>``,
    n_dup_lines the lines with a word that equal an earlier line, and n_repeat_words the
    words in 3-word windows that the text has twice or more, the first included.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    text = F.col("text")
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), F.size(F.array_distinct(w)).alias("d")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    n = F.length(text)
    rows = rows.select("doc_id", by_word.alias("w"), by_line.alias("l"), F.length(without(text, SPACES)).alias("word_chars"), (n - F.length(without(text, SYMBOLS))).alias("n_symbols"), (n - F.length(without(text, CAPITALS))).alias("n_capitals"), (n - F.length(without(text, DIGITS))).alias("n_digits"), (n - F.length(without(text, "!?"))).alias("n_marks"))
    long = lambda c: F.col(c).cast("bigint")
    return rows.select("doc_id", long("w.n").alias("n_words"), long("word_chars").alias("word_chars"), long("n_symbols").alias("n_symbols"), (long("l.n") - long("l.d")).alias("n_dup_lines"), long("w.r").alias("n_repeat_words"), long("l.n").alias("n_lines"), long("w.d").alias("n_distinct"), long("n_capitals").alias("n_capitals"), long("n_digits").alias("n_digits"), long("n_marks").alias("n_marks"))


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions (feature, "<=" or ">", value) are of low quality."""

    conditions: tuple[tuple[str, str, int], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for feature, sign, value in self.conditions:
            x = F.expr(FEATURES[feature])
            out = out & (x <= value if sign == "<=" else x > value)
        return out

    def met(self, row: dict[str, int]) -> bool:
        return all(row[f] <= v if s == "<=" else row[f] > v for f, s, v in self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{f} {s} {v}" for f, s, v in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """The rules, in order, as a conditional expression: true where no rule rejects the row."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def thresholds(rows: list[dict[str, int]], feature: str, most: int = 24) -> list[int]:
    """Values that cut the rows of low quality, and all rows, into about equal parts."""
    cuts: set[int] = set()
    for some in ([r[feature] for r in rows if r["bad"]], [r[feature] for r in rows]):
        values = sorted(some)
        if values:
            cuts.update(values[min(len(values) - 1, k * len(values) // most)] for k in range(most))
            cuts.update(v - 1 for v in list(cuts))
    return sorted(cuts)


def learn(rows: list[dict[str, int]], *, precision: float = 0.97, least: int = 8, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering over labelled rows (features, ``bad``, ``part``) by FOIL gain.

    Two thirds of the rows grow rules and one third prunes them; a rule is kept if, over
    all rows that no earlier rule covers, it meets ``precision`` and covers ``least`` bad rows.
    """
    cuts = {f: thresholds(rows, f) for f in FEATURES}
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules and any(r["bad"] for r in left):
        grown: tuple[tuple[str, str, int], ...] = ()
        inside = [r for r in left if r["part"] != 0]
        while len(grown) < most_conditions:
            p0 = sum(r["bad"] for r in inside)
            if not p0 or p0 == len(inside):
                break
            base = math.log2(p0 / len(inside))
            best = None
            for f, values in cuts.items():
                for gain, condition in _gains(inside, f, values, base):
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, condition)
            if best is None or best[0] <= 0:
                break
            grown += (best[1],)
            inside = [r for r in inside if Rule((best[1],)).met(r)]
        if not grown:
            break
        held = [r for r in left if r["part"] == 0] or left
        kept = max((grown[:k] for k in range(1, len(grown) + 1)), key=lambda c: (_worth(held, c), -len(c)))
        for chosen in (kept, grown):
            rule = Rule(chosen)
            covered = [r for r in left if rule.met(r)]
            bad = sum(r["bad"] for r in covered)
            if bad >= least and bad >= precision * len(covered):
                break
        else:
            break
        rules.append(rule)
        left = [r for r in left if not rule.met(r)]
    return rules


def _gains(rows: list[dict[str, int]], feature: str, values: list[int], base: float):
    ordered = sorted(rows, key=lambda r: r[feature])
    total, bad = len(ordered), sum(r["bad"] for r in ordered)
    k = p = 0
    for v in values:
        while k < total and ordered[k][feature] <= v:
            p += ordered[k]["bad"]
            k += 1
        for sign, n, b in (("<=", k, p), (">", total - k, bad - p)):
            if b and n < total:
                yield b * (math.log2(b / n) - base), (feature, sign, v)


def _worth(rows: list[dict[str, int]], conditions: tuple[tuple[str, str, int], ...]) -> float:
    covered = [r for r in rows if Rule(conditions).met(r)]
    p = sum(r["bad"] for r in covered)
    n = len(covered) - p
    return (p - n) / (p + n) if covered else -1.0


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 10_000, seed: int = 17) -> list[dict[str, int]]:
    """Features of at most ``most`` labelled rows, by a seeded hash of their ids; rows of low quality fill up to half of it.

    This is the one bounded sample here.  Documents are read once, joined to the chosen ids.
    Rows of ``labels`` without an id or a label are left out, the lowest of several labels of an
    id counts, and of several rows with a chosen id the one with the least features is taken.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(F.col(label_col).cast("int")).alias("quality"))
    known = known.withColumn("order", F.xxhash64(F.lit(seed), F.col("label_id").cast("string")))
    chosen = known.where("quality = 0").orderBy("order").limit(most // 2).unionByName(known.where("quality <> 0").orderBy("order").limit(most - most // 2))
    some = docs.join(F.broadcast(chosen.select("label_id", "quality", "order")), docs[id_col] == F.col("label_id"), "inner").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "quality", "order")
    tagged = counts(some.select(F.struct("doc_id", "quality", "order").alias("doc_id"), "text"))
    columns = [F.expr(e).cast("bigint").alias(f) for f, e in FEATURES.items()]
    found = tagged.where(~base_failed()).select(F.col("doc_id.doc_id").cast("string").alias("id"), (F.col("doc_id.quality") == 0).cast("int").alias("bad"), F.pmod("doc_id.order", F.lit(3)).cast("int").alias("part"), *columns)
    found = found.groupBy("id", "bad", "part").agg(F.min(F.struct(*FEATURES)).alias("features")).select("id", "bad", "part", "features.*").collect()
    return sorted((r.asDict() for r in found), key=lambda r: (r["id"], r["bad"]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept, one row per row.

    A null or empty text has no words and fails the base rules.  Null and repeated ids are
    kept as they are; texts of any length are counted whole; an empty table gives an empty
    result; other columns are ignored.
    """
    found = counts(docs, id_col, text_col)
    failed = base_failed()
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(rules)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, *, most: int = 10_000, **options) -> DataFrame:
    """Learns from the labelled rows of ``docs`` and applies the rules to all rows.

    Columns and odd rows are as in ``apply_rules``; which labels count is told by
    ``labelled_sample``.  Without labels, or labels of one kind only, the base rules decide.
    """
    return apply_rules(docs, learn(labelled_sample(docs, labels, most=most)), **options)
