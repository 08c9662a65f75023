"""Operator 13 - near-duplicate documents by b-bit MinHash, confirmed on full sets.

Sketch: ``LANES`` minima of a document's shingle hashes. Bands of ``ROWS``
minima are the candidate keys; of every lane only two bits are kept, packed
into bit planes, so comparing two sketches is a few XORs and bit counts, and
unequal lanes that agree by chance are corrected for.

Documents with equal shingle sets are one node. Candidates are then confirmed
on the full sets (64-bit shingle hashes) in two rounds that emit no group's
pairs:

1. Every node meets one *centre*: of the centres of its buckets the one with
   most company. This joins nearly all of a group of copies at a cost of one
   pair a node, whatever the size of the group.
2. Only in buckets that still hold several components, members outside the
   bucket's largest component meet the members of other components, once, in
   the first band they share, and only if sizes, the bit count and what is known
   of a common centre leave the threshold possible. Sizes and the overlaps with a
   common centre are exact bounds; where both differ little from it, the
   differences give their overlap itself. The bit count is five standard
   deviations wide of the threshold, and is not asked for sets below ``SMALL``.
   Pairs that remain are confirmed like those of round 1.

A pair at the threshold shares no band with probability (1 - 0.85^5)^32, some
7e-9; pairs above it with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscope.llm.common import boxed, write_shared
from flockscope.llm.components import star_edges
from flockscope.llm.wordarrays import WordHash, hash_words, window_hashes

LANES, BANDS, ROWS, SMALL = 512, 32, 5, 32
#: Longest word that a memo keeps, in bytes.
LONGEST = 100
#: Hashes in which a node may differ from its centre for the difference to travel with it.
DIFFERENCE = 256
SPREAD = 5.0
#: Fixed constants of the lanes (a mask and an odd factor each) and of the bands' rows.
_draw = np.random.default_rng(13)
LANE_MASK = _draw.integers(0, 1 << 32, LANES, dtype=np.uint32)
LANE_FACTOR = _draw.integers(0, 1 << 32, LANES, dtype=np.uint32) | np.uint32(1)
ROW_FACTOR = _draw.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0xD6E8FEB86659FD93)


class ShortWords(WordHash):
    """A word memo that keeps no words above LONGEST bytes, so its bytes are bounded too."""

    def __missing__(self, word: bytes) -> int:
        return super().__missing__(word) if len(word) <= LONGEST else xxhash.xxh64_intdigest(word)


def shingle_sets(texts: list[str | None], shingle: int, memo: WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; none without words."""
    lists = [t.encode("utf-8").lower().split() if t else [] for t in texts]  # bytes.lower() folds A-Z only
    h, lengths = hash_words(lists, memo)
    grams, out, at = window_hashes(h, shingle), [], 0
    for words, n in zip(lists, lengths, strict=True):
        if n >= shingle:
            out.append(np.unique(grams[at:at + n - shingle + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 13)] if n else [], dtype=np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray], cells: int = 1 << 16) -> np.ndarray:
    """``LANES`` minima of every (non-empty) set, some ``cells`` hashes at a time."""
    out = np.empty((LANES, len(sets)), dtype=np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(sets):
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + cells, "right")), at + 1)
        flat = np.concatenate(sets[at:to])
        x = (flat ^ flat >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], ends[at:to - 1] - base])
        with np.errstate(over="ignore"):
            for k in range(LANES):
                out[k, at:to] = np.minimum.reduceat((x ^ LANE_MASK[k]) * LANE_FACTOR[k], starts)
        at = to
    return out


def bands_and_planes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys ``(sets, BANDS)`` and packed two-bit lanes ``(sets, 2 * LANES / 64)``, as signed 64-bit."""
    with np.errstate(over="ignore"):
        keys = np.empty((low.shape[1], BANDS), dtype=np.uint64)
        for b in range(BANDS):
            x = np.full(low.shape[1], b + 1, dtype=np.uint64) * MIX
            for r in range(ROWS):
                x = (x ^ low[b * ROWS + r]) * ROW_FACTOR[r]
                x ^= x >> np.uint64(29)
            keys[:, b] = x * MIX
        two = (low * np.uint32(0x9E3779B1)) >> np.uint32(30)  # two bits that depend on the whole minimum
    planes = [np.ascontiguousarray(np.packbits((two >> np.uint32(p) & np.uint32(1)).astype(bool), axis=0, bitorder="little").T)
              for p in (0, 1)]
    return keys.view(np.int64), np.hstack([x.view("<i8") for x in planes])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ShortWords()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # word lists take many times the memory of their texts
                b = whole.slice(at, 1000)
                sets = shingle_sets(b.column(2).to_pylist(), shingle, memo)
                full = np.array([bool(len(s)) for s in sets])
                keys, planes = bands_and_planes(minima([s for s in sets if len(s)])) if full.any() else (
                    np.empty((0, BANDS), np.int64), np.empty((0, LANES // 32), np.int64))
                slot = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:2], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     _lists(keys).take(slot), _lists(planes).take(slot)], ["id", "rk", "n", "node", "bands", "planes"])
    return run


def _node_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ShortWords()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = shingle_sets(b.column(1).to_pylist(), shingle, memo)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])
    return run


def _overlaps(differences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, na, nb, gone, added = [], [], [], [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                inside = np.isin(u, v, assume_unique=True)
                both.append(int(inside.sum()))
                na.append(len(u))
                nb.append(len(v))
                if differences:
                    near = len(u) + len(v) - 2 * both[-1] <= DIFFERENCE
                    gone.append(np.setdiff1d(v, u, assume_unique=True).view(np.int64) if near else None)
                    added.append(u[~inside].view(np.int64) if near else None)
            more = [pa.array(z, pa.list_(pa.int64())) for z in (gone, added)] if differences else []
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(x, pa.int64()) for x in (both, na, nb)], *more],
                                             ["a", "b", "both", "na", "nb", "gone", "added"][:5 + len(more)])
    return run


def overlaps(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """``(a, b, both, na, nb)``: sizes of the intersections and of both full sets of the pairs ``(a, b)``.

    With ``differences``, also the hashes of b that a lacks (``gone``) and has beside (``added``), where they are few.
    """
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").select("a", "b", "ha", "hb")
    return two.mapInArrow(_overlaps(differences), "a binary, b binary, both long, na long, nb long"
                          + (", gone array<long>, added array<long>" if differences else ""))


def most_unequal(percent: int) -> int:
    """Unequal lanes a pair at the threshold has at most, ``SPREAD`` standard deviations wide.

    Unequal minima agree in both bits once in four times, so the share of equal
    lanes is 1/4 + 3/4 of the similarity.
    """
    p = 0.75 * (1 - percent / 100)
    return int(LANES * p + SPREAD * (LANES * p * (1 - p)) ** 0.5)


def unequal_lanes(a: Column, b: Column) -> Column:
    """Lanes whose two bits differ, by bit counts over the packed planes."""
    half = LANES // 64
    total = F.lit(0)
    for i in range(half):
        x, y = (F.get(a, F.lit(i + p * half)).bitwiseXOR(F.get(b, F.lit(i + p * half))) for p in (0, 1))
        total = total + F.bit_count(x.bitwiseOR(y))
    return total


def enough(both: Column, na: Column, nb: Column, percent: int) -> Column:
    """100 * both >= percent * union, in whole numbers."""
    return (100 + percent) * both >= percent * (na + nb)


def _residual_pairs(busy: DataFrame, nodes: DataFrame, met: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of round 2 (see the module docstring). ``met`` may repeat rows; a node that ``comps`` lacks is a root."""
    root = F.coalesce("root", "node")
    none = F.when(F.col("centre").isNull(), F.array().cast("array<long>"))  # a node without a centre is its own
    facts = (nodes.join(met.dropDuplicates(["a"]).select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("both").alias("own"), "gone", "added"),
                        "node", "left")
             .join(comps, "node", "left")
             .select("node", "n", "bands", "planes", F.coalesce("centre", "node").alias("centre"), F.coalesce("own", "n").alias("own"),
                     F.coalesce("gone", none).alias("gone"), F.coalesce("added", none).alias("added"), root.alias("root")))
    placed = busy.select("t", "key", "node").join(comps, "node", "left").select("t", "key", "node", root.alias("root"))
    parts = placed.groupBy("t", "key", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = parts.groupBy("t", "key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "root")).alias("largest")) \
        .where("parts > 1").select("t", "key", F.col("largest.root").alias("main"))
    rows = write_shared(placed.join(mixed, ["t", "key"]).select("t", "key", "node", "main").join(facts, "node"), "minhash-mixed")
    x, y = rows.where("root != main").alias("x"), rows.alias("y")
    c = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (na, nb), (ca, cb), (oa, ob) = c("n"), c("centre"), c("own")
    shared = F.array_position(F.zip_with(*c("bands"), lambda p, q: p == q), True) - 1
    fits = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    fits &= enough(F.least(na, nb), na, nb, percent)
    fits &= (ca != cb) | enough(F.least(oa, ob) + F.least(na - oa, nb - ob), na, nb, percent)
    fits &= (F.least(na, nb) < SMALL) | (unequal_lanes(*c("planes")) <= most_unequal(percent))
    (ga, gb), (ma, mb) = c("gone"), c("added")
    known = oa - F.size(gb) + F.size(F.array_intersect(ga, gb)) + F.size(F.array_intersect(ma, mb))
    fits &= (ca != cb) | ga.isNull() | gb.isNull() | enough(known, na, nb, percent)
    fits &= shared == F.col("x.t")  # any bucket they share holds two components, so the first one is among the rows
    met_once = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & fits)
    return met_once.select(F.least(*c("node")).alias("a"), F.greatest(*c("node")).alias("b")).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3,
                    percent: int = 85) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row.

    Two documents are linked if their sets of distinct ``shingle``-word shingles
    (A-Z folded, words between space and TAB .. CR; a shorter text is one
    shingle) satisfy ``100 * intersection >= percent * union``. Links are
    confirmed on the full sets. ``component_id`` is the smallest id reachable,
    itself included.

    Nulls: null and blank texts have an empty set and are linked with nothing;
    a null id is linked like any other and never names a component (null if no
    member has an id). Very long texts: whole, their sets are 8 bytes a shingle
    in one task. Ties: a similarity of exactly ``percent`` links. Repeated rows
    and equal sets share a component and are compared once. Empty table: empty
    result. Input columns may have any names: only the two named are read. The
    sketches of LANES / 8 bytes are tuned to ``percent`` of 80 or more.
    """
    rows = boxed(docs).select(F.col(f"_row.`{id_col}`").alias("id"), F.xxhash64(F.col(f"_row.`{text_col}`")).alias("rk"),
                              F.col(f"_row.`{text_col}`").cast("string").alias("body"))
    id_type = dict(rows.dtypes)["id"]
    sketched = write_shared(rows.mapInArrow(
        _sketches(shingle), f"id {id_type}, rk long, n long, node binary, bands array<long>, planes array<long>"), "minhash-sketches")
    full = sketched.where("node IS NOT NULL")
    # ids and places of equal sets, by an aggregate of a row a task and set; the sketch is any member's
    nodes = write_shared(full.groupBy("node").agg(
        F.min("id").alias("first_id"), F.min(F.struct(F.col("id"), F.col("rk"))).alias("at"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("planes").alias("planes")), "minhash-nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    busy = write_shared(keyed.join(sizes, ["t", "key"]), "minhash-buckets")
    company = busy.groupBy("node").agg(F.sum("m").alias("company"))
    ranked = busy.select("t", "key", "node").join(company, "node")
    rank = F.struct(F.col("company"), F.col("node"))
    heads = ranked.groupBy("t", "key").agg(F.max(rank).alias("head"))
    stars = write_shared(busy.select("t", "key", "node").join(heads, ["t", "key"]).where(F.col("head.node") != F.col("node"))
                         .groupBy(F.col("node").alias("a")).agg(F.max("head").alias("head")).select("a", F.col("head.node").alias("b")),
                         "minhash-stars")
    wanted = busy.select("node").distinct().join(nodes.select("node", "at"), "node")
    texts = rows.join(wanted, rows["id"].eqNullSafe(F.col("at.id")) & rows["rk"].eqNullSafe(F.col("at.rk")))
    sets = write_shared(texts.select("node", "body").mapInArrow(_node_sets(shingle), "node binary, hashes binary"), "minhash-sets")
    met = write_shared(overlaps(stars, sets, differences=True), "minhash-met")
    linked = lambda p: p.where(enough(F.col("both"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    first = star_edges(linked(met))
    more = linked(overlaps(_residual_pairs(busy, nodes, met, first, percent), sets))
    comps = star_edges(more.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = nodes.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = named.join(ids, "root").select(F.col("node").alias("_node"), "component_id")
    return (sketched.join(by_node, F.col("node") == F.col("_node"), "left")
            .select("id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
                    .alias("component_id")))
