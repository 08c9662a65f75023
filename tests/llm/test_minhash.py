"""Operator 13 against all pairs of full shingle sets."""

import random

import numpy as np
import pytest

from flockscope.llm import minhash
from flockscope.llm.queries import QUERIES, read_table

from ..conftest import SF0001
from .helpers import awkward_texts, documents, prose, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = words((text or "").translate(FOLD))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """Smallest id reachable, for rows (id, text) with ids."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        both = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
                  key=str)


def result(docs, **options):
    return sorted(map(tuple, minhash.near_duplicates(docs, **options).collect()), key=str)


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text.split())


def test_overlaps_bring_the_sizes_of_the_sets(spark):
    """So linking pairs needs no join with the nodes."""
    sets = {b"x": [1, 2, 3, 4], b"y": [3, 4, 5], b"z": [9]}
    table = spark.createDataFrame([(bytearray(k), bytearray(np.array(v, np.uint64).tobytes())) for k, v in sets.items()],
                                  "node binary, hashes binary")
    pairs = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in ((b"x", b"y"), (b"y", b"z"))], "a binary, b binary")
    got = sorted((bytes(r.a), r.both, r.na, r.nb) for r in minhash.overlaps(pairs, table).collect())
    assert got == [(b"x", 2, 4, 3), (b"y", 0, 3, 1)]


def test_groups_of_near_copies_lose_no_link(spark):
    """A hot group whose members lie on both sides of the threshold of each other."""
    rng = random.Random(4)
    base, other = prose(rng, 150, 5_000), prose(rng, 40, 5_000)
    texts = [edited(rng, base, rng.choice([0.005, 0.02, 0.03, 0.06])) for _ in range(260)]
    texts += [edited(rng, other, rng.choice([0.0, 0.02, 0.04])) for _ in range(60)] + [prose(rng, 60) for _ in range(60)]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    assert result(documents(spark, texts, ids)) == brute(list(zip(ids, texts, strict=True)))


def test_awkward_rows(spark):
    texts = awkward_texts(3)
    texts += [texts[10].upper(), "A b", "a  B", "one two three", "ONE two\tthree", None, "x" * 200_000]
    ids = [None, *range(1, len(texts) - 2), 3, None]
    assert result(documents(spark, texts, ids)) == brute(list(zip(ids, texts, strict=True)))
    clash = documents(spark, texts[:12]).selectExpr("doc_id", "text", "text AS node", "1 AS n", "2 AS bands", "3 AS component_id", "4 AS rk")
    assert result(clash) == brute(list(enumerate(texts[:12])))
    assert result(documents(spark, [None, "", " \n"])) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert result(documents(spark, ["a b c"] * 3, [5, 5, None])) == [(5, 1, 5), (5, 1, 5), (None, 1, 5)]
    assert result(documents(spark, [])) == []


def test_ties_at_the_threshold_link(spark):
    w = [f"t{i}" for i in range(102)]
    one, two = " ".join(w[:19 + 2]), " ".join(w[2:21])  # 19 and 17 shingles, 17 shared: 17/19 = 0.894
    assert [r[2] for r in result(documents(spark, [one, two]))] == [0, 0]
    # 20 shingles against 17 of them: exactly 85 in 100; then one less
    assert [r[2] for r in result(documents(spark, [" ".join(w[:22]), " ".join(w[:19])]))] == [0, 0]
    assert [r[2] for r in result(documents(spark, [" ".join(w[:22]), " ".join(w[:18])]))] == [0, 1]


def test_bit_count_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = int(len(both) * share)
        own = int((len(both) - n) / 2)
        sets = [np.unique(both[:n + own]), np.unique(np.concatenate([both[:n], both[n + own:]]))]
        _, planes = minhash.bands_and_planes(minhash.minima(sets))
        x = (planes[0] ^ planes[1]).view(np.uint64)
        half = len(x) // 2
        unequal = int(np.bitwise_count(x[:half] | x[half:]).sum())
        jaccard = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs(1 - unequal / minhash.LANES / 0.75 - jaccard) < 0.1


@pytest.mark.parametrize("sf_dir", [SF0001])
def test_query_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = QUERIES["op13_minhash"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(((r[0], r[1], r[2]) for r in found.collect()), key=str)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())
