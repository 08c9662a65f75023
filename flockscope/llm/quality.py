"""Operator 2 - quality rules: hashed n-gram log-likelihood ratio (DataFrame only).

Two multinomials over ``buckets`` hashed word unigrams and bigrams are counted:
one over the raw corpus (all documents, all n-grams), one over the documents of
a trusted target (labelled good). A document's score is the mean over its
n-grams of ``log p_target - log p_raw`` (smoothed), so it does not
depend on the document's length, and a fixed threshold decides. Both counts come
from one aggregation of at most ``buckets`` groups; the resulting weight vector
(``buckets`` doubles, a fixed size) is a constant of the scoring scan. No text
is shuffled.

Buckets: XXH64 (seed 42) of the word; of a bigram, XXH64 of the two words'
hashes (8 bytes each, little-endian, the second seeded with the hash of the
first); modulo ``buckets``.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscope.llm.common import BLANKS, boxed, let, words

REPEAT_WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda a: F.xxhash64(a))


def joined_hashes(h: Column, apart: int) -> Column:
    """Hashes of the neighbours ``(h[i], h[i + apart])``: pairs of words or of grams."""
    less = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), less), F.slice(h, F.lit(1 + apart), less), lambda a, b: F.xxhash64(a, b))


def repeated_window_words(pairs: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, from the word-pair hashes.

    Windows are told apart by a 64-bit hash within one document, built from
    pairs over fours. A repeated window repeats five fours, so most texts need
    no windows at all. Places of repeated windows come from one sort, the
    covered words from the gaps between neighbouring places.
    """
    width = REPEAT_WINDOW

    def covered(ranked: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(ranked, i)["h"] == F.get(ranked, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        places = F.sort_array(F.transform(twice, lambda j: F.get(ranked, j)["p"]))
        return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.size(p)), F.lit(0),
            lambda acc, j: acc + F.least(F.lit(width), F.coalesce(F.get(p, j) - F.get(p, j - 1), F.lit(width))))))

    def over(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered))

    def fours(four: Column) -> Column:
        few = F.size(four) - F.size(F.array_distinct(four)) < 5
        return F.when(few, F.lit(0)).otherwise(let(joined_hashes(four, 4), over))

    return F.when(F.size(pairs) < width - 1, F.lit(0)).otherwise(let(joined_hashes(pairs, 2), fours))


def base_columns(text: Column, w: Column) -> dict[str, Column]:
    """The counts of the base rule that need no n-grams, for a text and its word array."""
    body = F.coalesce(text, F.lit(""))
    count = lambda c: F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit("")))
    total = lambda chars: sum((count(c) for c in chars[1:]), count(chars[0]))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.char_length(body) - total(BLANKS)).cast("long"),
        "n_symbols": total(SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def trusted_ids(labels: DataFrame, limit: int = 50_000) -> DataFrame:
    """Ids of the trusted target: labelled good in every one of their label rows.

    At most ``limit`` ids, those with the smallest id hash: the documented bound
    of the only table that is broadcast. Null ids and null labels are ignored.
    """
    good = (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
            .where("q = 1").select(F.col("doc_id").alias("_trusted")))
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(limit)


def weight_vector(rows: DataFrame, trusted: DataFrame, buckets: int, prior: float) -> Column:
    """Constant array column: the log ratio of every bucket, in bucket order.

    ``rows`` has ``id`` and ``h`` (word hashes). The ``buckets`` counts, a fixed
    size, pass through the driver. A ratio compares a bucket's target count with
    the one expected from its share of the corpus, ``prior`` added to both, so a
    bucket speaks the louder the more of its n-grams are expected; the rule is the
    same for tables of every size. Ratios are rounded to 9 decimals. Without a
    trusted n-gram all are 0.
    """
    flagged = rows.join(F.broadcast(trusted), F.col("id") == F.col("_trusted"), "left")
    grams = flagged.select(F.col("_trusted").isNotNull().cast("long").alias("good"),
                           F.explode(F.concat("h", joined_hashes(F.col("h"), 1))).alias("gram"))
    counts = grams.groupBy(F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for bucket, n, g in counts.collect():  # at most ``buckets`` rows
        raw[bucket], good[bucket] = n, g
    ratio = np.zeros(buckets)
    if good.any():
        expected = raw * (good.sum() / raw.sum())
        ratio = np.log((good + prior) / (expected + prior))
    return F.from_json(F.lit(json.dumps(np.round(ratio, 9).tolist())), "array<double>")


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          buckets: int = 1 << 16, threshold: float = -0.1, target_limit: int = 50_000, prior: float = 10.0) -> DataFrame:
    """``_row`` (the input row) with the base counts, ``llr``, ``base_failed``, ``kept``.

    kept = not base_failed and llr >= threshold. Null, empty and blank texts
    have no words, llr 0, and fail the base rule. Repeated rows are judged one
    by one and count in the corpus as often as they occur. Without a trusted
    document llr is 0 and the base rule alone decides. Empty tables give empty
    results. Counting the corpus runs when the plan is built.
    """
    rows = boxed(docs).withColumn("w", words(F.col(f"_row.`{text_col}`")))
    trusted = trusted_ids(labels, target_limit)
    sparse = docs.select(F.col(f"`{id_col}`").alias("id"), word_hashes(words(F.col(f"`{text_col}`"))).alias("h"))
    wv = weight_vector(sparse, trusted, buckets, prior)
    base = base_columns(F.col(f"_row.`{text_col}`"), F.col("w"))
    add = lambda acc, h: acc + F.get(wv, F.pmod(h, F.lit(buckets)).cast("int"))
    of_hashes = let(word_hashes(F.col("w")), lambda h: let(joined_hashes(h, 1), lambda pairs: F.struct(
        F.aggregate(pairs, F.aggregate(h, F.lit(0.0), add), add).alias("total"),
        repeated_window_words(pairs).cast("long").alias("n_repeat_words"))))
    out = rows.select("_row", *[c.alias(k) for k, c in base.items()], of_hashes.alias("f"))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    out = out.select("_row", *base, "f.n_repeat_words", (F.col("f.total") / n).alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
