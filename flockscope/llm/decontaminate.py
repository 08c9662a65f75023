"""Operator 10 - benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

(1) The n-grams of a test item that some document holds are counted over all
documents. A rare one (held by ``few`` documents or less) is a seed. Of more
frequent ones only the rarest of every ``window`` neighbours is a seed, so
phrases that everyone uses bring no pairs, while every ``window`` neighbouring
n-grams of an item that occur at all still hold a seed. (2) Documents are read
once; stretches around item n-grams meet the items by an equi-join on the
seeds. A stretch reaches as far as an alignment that scores enough can, so none
is cut off. (3) Each (stretch, item) is aligned word by word with
Smith-Waterman; edits, insertions and losses lower the score instead of hiding
the copy. An alignment that scores enough is a leak. Pairs with too few words
in common for such a score are settled by that bound.

Every alignment that scores enough and holds a seed is found: with rare n-grams
every one that holds ``n`` words of the item in a row, with frequent ones every
one that holds ``n + window - 1``, and shorter runs where one of them is the
rarest of its neighbours.

Membership is tested against a bitmap of fixed size (``SLOTS`` bits) whatever
the size of the benchmark; the joins settle what the bitmap lets through. Only
stretches are shuffled, not texts. Words are compared in lower case and without
punctuation at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscope.llm.common import boxed, write_shared
from flockscope.llm.wordarrays import WordHash, hash_words, split_words, window_hashes, window_starts

SLOTS = 1 << 22
MATCH, MISMATCH, GAP = 2, -1, -1
TRIM = ".,;:!?\"'()[]{}“”‘’«»¿¡"


class PlainWordHash(WordHash):
    """Hash of a word in lower case without punctuation at its ends."""

    def hashed(self, word: bytes) -> int:
        plain = word.decode("utf-8").lower().strip(TRIM)
        return xxhash.xxh64_intdigest(plain.encode("utf-8") if plain else word)


def _item_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = PlainWordHash()
        for b in batches:
            h, lengths = hash_words((split_words(t) for t in b.column(1).to_pylist()), memo)
            start, owner = window_starts(lengths, n)
            grams = window_hashes(h, n)[start]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner)), pa.array(grams.view(np.int64)),
                 pa.array(start.astype(np.int64)), pa.array(lengths[owner].astype(np.int32))],
                ["item_key", "gram", "place", "item_words"])
    return run


def bitmap(grams: DataFrame) -> np.ndarray:
    """Bitmap of ``SLOTS`` bits of the gram hashes, as bytes; at most SLOTS / 32 rows reach the driver."""
    slot = F.pmod(F.col("gram"), F.lit(SLOTS))
    rows = (grams.groupBy((slot / 32).cast("int").alias("cell"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(gram, {SLOTS}) % 32 as int))")).alias("bits")).collect())
    cells = np.zeros(SLOTS // 32, dtype="<u4")
    for cell, bits in rows:
        cells[cell] = bits & 0xFFFFFFFF
    return np.unpackbits(cells.view(np.uint8), bitorder="little").astype(bool)


def _hits(b: pa.RecordBatch, n: int, bits: np.ndarray, memo: WordHash):
    """Word lists, ``(place, owner, gram)`` of the n-grams the bitmap lets through, first word of each text."""
    lists = [split_words(t) for t in b.column(2).to_pylist()]
    h, lengths = hash_words(lists, memo)
    start, owner = window_starts(lengths, n)
    grams = window_hashes(h, n)[start] if len(start) else np.empty(0, np.uint64)
    hit = bits[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, np.int64)
    return lists, start[hit] - begins[owner[hit]], owner[hit], grams[hit]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces: word lists take many times the memory of their texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _stretches(n: int, reach: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = PlainWordHash(), np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for b in _slices(batches):
            lists, place, owner, grams = _hits(b, n, table, memo)
            rows, froms, texts, seeds = [], [], [], []
            if len(place):
                apart = np.ones(len(place), bool)
                apart[1:] = (owner[1:] != owner[:-1]) | (place[1:] - place[:-1] > 2 * reach)
                heads = np.flatnonzero(apart)
                for a, z in zip(heads, [*heads[1:], len(place)], strict=True):
                    lo, hi = max(int(place[a]) - reach, 0), int(place[z - 1]) + n + reach
                    rows.append(owner[a])
                    froms.append(lo)
                    texts.append(b" ".join(lists[owner[a]][lo:hi]).decode("utf-8"))
                    seeds.append(np.unique(grams[a:z]).view(np.int64))
            at = pa.array(np.array(rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(froms, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(seeds, pa.list_(pa.int64()))], ["id", "rk", "begin", "stretch", "seeds"])
    return run


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman scores of (item, stretch) pairs of word hashes, all pairs in step."""
    wide, high = max(map(len, stretches)), max(map(len, items))
    s = np.zeros((len(items), wide), dtype=np.uint64)
    t = np.zeros((len(items), high), dtype=np.uint64)
    inside = np.zeros((len(items), wide), dtype=bool)
    for i, (a, b) in enumerate(zip(items, stretches, strict=True)):
        t[i, :len(a)], s[i, :len(b)], inside[i, :len(b)] = a, b, True
    lengths = np.array([len(a) for a in items])
    slope = np.arange(wide, dtype=np.int32) * -GAP
    above, best = np.zeros((len(items), wide), dtype=np.int32), np.zeros(len(items), dtype=np.int32)
    for j in range(high):
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        here = np.where((s == t[:, j:j + 1]) & inside, diagonal + MATCH, diagonal + MISMATCH)
        here = np.maximum(np.maximum(here, above + GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope  # gaps inside the row
        here[j >= lengths] = 0
        best = np.maximum(best, (here * inside).max(axis=1))
        above = here
    return best


def _aligned(full: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = PlainWordHash()
        words = lambda t: np.fromiter(map(memo.__getitem__, split_words(t)), dtype=np.uint64)
        for b in batches:
            items, parts = [words(t) for t in b.column(3).to_pylist()], [words(t) for t in b.column(4).to_pylist()]
            # an alignment cannot match more words than the item has in the stretch
            able = [i for i, (a, p) in enumerate(zip(items, parts, strict=True))
                    if np.isin(a, p).sum() >= threshold * min(len(a), full) - 1e-9]
            order = sorted(able, key=lambda i: (len(parts[i]), len(items[i])))
            score, at = np.zeros(len(items)), 0
            while at < len(order):  # pairs of like length together, a bounded number of cells at a time
                step = at + 1
                while step < len(order) and (step + 1 - at) * len(parts[order[step]]) <= 1 << 18:
                    step += 1
                some = order[at:step]
                best = align([items[i] for i in some], [parts[i] for i in some])
                score[some] = best / (MATCH * np.minimum([max(len(items[i]), 1) for i in some], full))
                at = step
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.minimum(score, 1.0))],
                                             ["id", "rk", "item_id", "similarity"])
    return run


def choose_seeds(grams: DataFrame, near: DataFrame, few: int, window: int) -> DataFrame:
    """``(item_key, gram)`` of the item n-grams that join documents.

    ``grams`` has ``item_key, gram, place`` (places rise along an item), ``near``
    the ``seeds`` of every stretch. N-grams that no stretch holds are left out.
    Of equally frequent neighbours the first is taken.
    """
    held = near.select(F.explode("seeds").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    known = grams.join(held, "gram")
    ahead = Window.partitionBy("item_key").orderBy("place").rowsBetween(0, window - 1)
    frequent = (known.select("item_key", F.min(F.struct("held", "place", "gram")).over(ahead).alias("least"))
                .select("item_key", F.col("least.gram").alias("gram")))
    return known.where(F.col("held") <= few).select("item_key", "gram").unionByName(frequent).distinct()


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3,
               threshold: float = 0.6, full: int = 40, few: int = 1000, window: int = 4) -> DataFrame:
    """``(id, rk, item_id, similarity)`` of every document with a copy of a test item.

    ``items`` has ``item_id`` and ``text``. Similarity is the best alignment
    score over that of a verbatim copy (of ``full`` words, for longer items);
    a leak has ``threshold`` or more and holds a seed (see above; ``few`` counts
    stretches of documents). ``rk`` is the text's hash: rows of equal id and text
    give one result. Equal scores are all leaks. Null and blank texts and items and items of fewer
    than ``n`` words match nothing. Items repeated under an id count as one item
    each, the best similarity is given; null ids are results like others.
    Empty tables give empty results. Seeds and stretches are written when the
    plan is built.
    """
    spark = docs.sparkSession
    given = items.select("item_id", F.col("text").alias("item_text")).where("item_text IS NOT NULL")
    keyed = given.withColumn("item_key", F.xxhash64("item_text"))
    grams = write_shared(keyed.select("item_key", "item_text").distinct().mapInArrow(
        _item_grams(n), "item_key long, gram long, place long, item_words int"), "item-grams")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("rk"),
                        F.col(f"`{text_col}`").alias("text"))
    # m matches of an item of L words pay for 2 m - score further words, so an alignment spans at most 3 L - score
    longest = grams.agg(F.max("item_words")).first()[0] or 0
    reach = (MATCH + 1) * longest - int(MATCH * threshold * min(longest, full))
    bits = spark.sparkContext.broadcast(np.packbits(bitmap(grams)).tobytes())
    schema = f"id {dict(texts.dtypes)['id']}, rk long, begin long, stretch string, seeds array<long>"
    near = write_shared(texts.select("id", "rk", "text").mapInArrow(
        _stretches(n, reach, bits), schema).distinct(), "leak-stretches")
    seeds = write_shared(choose_seeds(grams, near, few, window), "item-seeds")
    same = lambda a, b: a["rk"].eqNullSafe(b["rk"]) & a["id"].eqNullSafe(b["id"]) & (a["begin"] == b["begin"])
    met = (near.select("id", "rk", "begin", F.explode("seeds").alias("gram")).join(seeds, "gram")
           .select("id", "rk", "begin", "item_key").distinct())
    pairs = (met.join(near, same(met, near)).select(met["id"], met["rk"], "item_key", "stretch")
             .join(keyed, "item_key").select("id", "rk", "item_id", "item_text", "stretch"))
    schema = f"id {dict(texts.dtypes)['id']}, rk long, item_id {dict(given.dtypes)['item_id']}, similarity double"
    return (pairs.mapInArrow(_aligned(full, threshold), schema).where(F.col("similarity") >= threshold)
            .groupBy("id", "rk", "item_id").agg(F.max("similarity").alias("similarity")))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a copy of a test item, columns unchanged."""
    leaks = find_leaks(docs, items, text_col, id_col, **options).select("id", "rk").distinct()
    rows = boxed(docs)
    return rows.join(leaks, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("id"))
                     & F.xxhash64(F.col(f"_row.`{text_col}`")).eqNullSafe(F.col("rk")), "left_anti").select("_row.*")


def rounded(x: Column) -> Column:
    return F.round(x, 6)
