"""Quality rules in Spark expressions: simple counts, and a hashed n-gram log-likelihood ratio.

Words are maximal runs without the ASCII white space of shared.SPACE. The counts are exact for every text. The
verdict compares two multinomials over hashed word 1-grams and 2-grams (2**bucket_bits buckets):
one of the trusted documents, one of the whole corpus. Trusted are documents all of whose labels say quality 1; the half of
them with an even hash of doc_id is counted, the other half helps to set the threshold, since a document that was counted itself scores too
well. A document's score is the mean over its n-grams of

    log (trusted + alpha) / n_trusted - log (corpus + alpha * n_corpus / n_trusted) / n_corpus

so that buckets with little evidence say little.

A document is kept if it passes the base rules and its score is not below the threshold. The threshold is the middle of the gap
between two filled 1/1000-wide bins of scores that separates labels 1 and 0 best (sum of the two rates, the lowest gap of
equals), over all labelled documents outside the counted half that pass the base rules. Without trusted documents, or without any label 0, no document is
rejected by score.

Null and empty texts have no words and fail the base rules. Repeated rows and ties are judged row by row; a doc_id
with contrary labels counts as quality 0. An empty corpus gives an empty result. All other columns of the
input are returned as they are; columns with the names of results are replaced. Three-word windows are compared by 64-bit hashes.

Scale: two passes over the texts besides the labelled one; the shuffles hold bucket counts and score bins only, whose numbers are
bounded by parameters. Labels are broadcast up to max_broadcast_labels rows and joined by a shuffle beyond.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm.shared import SPACE, only, short_plans, shrink_heap

MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, r"[#*$%&|<>]"
BUCKET_BITS, ALPHA, BINS_PER_UNIT = 16, 5.0, 1000
MAX_BROADCAST_LABELS = 200_000
#: Up to so many distinct repeated windows are looked up in a list; more are found by sorting.
SHORT_LIST = 64


@dataclass(frozen=True)
class Model:
    llr: list[float]  # by bucket
    threshold: float | None  # None: nothing is rejected by score


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def upto(n: Column) -> Column:
    """0 .. n-1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(hashes: Column, bits: int) -> Column:
    """Buckets of the 1-grams and 2-grams."""
    mask = (1 << bits) - 1
    pairs = F.transform(upto(F.size(hashes) - 1), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)).bitwiseAND(mask).cast("int"))
    return F.concat(F.transform(hashes, lambda h: h.bitwiseAND(mask).cast("int")), pairs)


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a 3-word window which the text has twice or more."""
    windows = F.transform(upto(F.size(hashes) - 2), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def twice(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))

    def by_list(h: Column, d: Column) -> Column:
        return F.filter(upto(F.size(h)), lambda i: F.array_contains(d, F.get(h, i)))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, p, k: F.coalesce(F.get(s, k)["h"] == p["h"], F.lit(False))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda p, k: ((k > 0) & same(s, p, F.greatest(k - 1, F.lit(0)))) | same(s, p, k + 1)), lambda p: p["i"])))

    def covered(starts: Column) -> Column:
        return let(
            starts,
            lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x),
        )

    return let(
        windows,
        lambda h: let(
            twice(h),
            lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= SHORT_LIST, covered(by_list(h, d))).otherwise(covered(by_sort(h))),
        ),
    )


def findings(text: Column, model: Model, counts: bool = True) -> Column:
    """Counts, if asked for, base_failed and the score, as one struct. Every part that is used inside a loop is bound by
    let(): an optimizer that moves a filter below a projection would put its expression into the loop otherwise."""
    text = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def judged(words: Column, hashes: Column, repeats: Column) -> Column:
        n = F.size(words)
        verdict = [
            ((n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
            score_of(hashes, model).alias("score"),
        ]
        if not counts:
            return F.struct(*verdict)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            repeats.cast("long").alias("n_repeat_words"),
            *verdict,
        )

    return let(words_of(text), lambda w: let(hashes_of(w), lambda h: let(repeated_words(h), lambda r: judged(w, h, r))))


def score_of(hashes: Column, model: Model) -> Column:
    """Mean log-likelihood ratio; 0 for a text without words."""
    bits = (len(model.llr) - 1).bit_length()
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model.llr)), ",").cast("array<double>")  # folded to a literal
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return let(buckets_of(hashes, bits), lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)).otherwise(0.0))


def with_labels(docs: DataFrame, labels: DataFrame, how: str, max_broadcast: int) -> DataFrame:
    one = only(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    small = labels.count() <= max_broadcast
    return only(docs, "doc_id", "text").join(F.broadcast(one) if small else one, "doc_id", how)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, alpha: float = ALPHA, max_broadcast_labels: int = MAX_BROADCAST_LABELS) -> Model:
    short_plans(docs.sparkSession)
    known = with_labels(docs, labels, "left", max_broadcast_labels)
    counted = (F.col("_quality") == 1) & (F.xxhash64("doc_id") % 2 == 0)
    grams = known.select(F.coalesce(counted, F.lit(False)).cast("long").alias("t"), let(hashes_of(words_of(F.col("text"))), lambda h: buckets_of(h, bits)).alias("g"))
    grams = grams.select("t", F.explode("g").alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted")).toArrow()  # 2**bits rows at most
    raw, trusted = [0] * (1 << bits), [0] * (1 << bits)
    for b, n, t in zip(*(counts.column(c).to_pylist() for c in ("b", "raw", "trusted")), strict=True):
        raw[b], trusted[b] = n, t
    shrink_heap(docs.sparkSession)
    n_raw, n_trusted = sum(raw), sum(trusted)
    share = n_trusted / n_raw if n_raw else 0
    llr = [round(math.log(t + alpha) - math.log(c * share + alpha), 6) for c, t in zip(raw, trusted, strict=True)]
    if not n_trusted:
        return Model(llr, None)
    others = with_labels(docs, labels, "inner", max_broadcast_labels).where(~counted)
    judged = others.select(F.col("_quality").alias("q"), findings(F.col("text"), Model(llr, None), counts=False).alias("f"))
    scores = judged.select(F.when(~F.col("f.base_failed"), F.floor(F.col("f.score") * BINS_PER_UNIT)).alias("bin"), "q")
    bins = scores.groupBy("bin").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") != 1).alias("bad")).collect()
    shrink_heap(docs.sparkSession)
    return Model(llr, best_threshold([(r["bin"], r["good"], r["bad"]) for r in bins if r["bin"] is not None]))


def best_threshold(bins: list[tuple[int, int, int]]) -> float | None:
    """Where to begin to keep for the largest sum of the two rates of right verdicts: the middle of the empty stretch below the best bin."""
    n_good, n_bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not n_good or not n_bad:
        return None
    best, at, bad_below, good_below, end = 1.0, None, 0, 0, None
    for edge, good, bad in sorted(bins):
        if (rate := (n_good - good_below) / n_good + bad_below / n_bad) > best:
            best, at = rate, (end + edge) / 2 / BINS_PER_UNIT
        good_below, bad_below, end = good_below + good, bad_below + bad, edge + 1
    return at


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the counts, base_failed, score and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    own = [c for c in docs.columns if c not in {*names, "kept"}]
    found = docs.select(*(docs[c] for c in own), findings(docs["text"], model).alias("_findings"))
    return found.select(*own, *(F.col(f"_findings.{n}").alias(n) for n in names), kept_column(F.col("_findings"), model).alias("kept"))


def kept_column(f: Column, model: Model) -> Column:
    return ~f["base_failed"] & (F.lit(True) if model.threshold is None else f["score"] >= model.threshold)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    return docs.where(let(findings(docs["text"], model, counts=False), lambda f: kept_column(f, model)))
