"""Operators 5, 7, 9: passages, SimHash, lines (brute force)."""

import random

import numpy as np
import xxhash

from flockscope.llm import components, line_dedup, simhash, substring
from flockscope.llm.common import write_shared
from flockscope.llm.components import connected_components
from pyspark.sql import functions as F
from tests.llm.helpers import awkward_texts, documents, prose, words


def passages(seed=9):
    """Texts that share passages of many lengths, with edits at their borders."""
    rng = random.Random(seed)
    shared = [prose(rng, n, 10_000) for n in (12, 13, 14, 25, 60, 200)]
    out = []
    for _ in range(120):
        parts = [prose(rng, rng.randrange(0, 40), 10_000)]
        for _ in range(rng.randrange(0, 4)):
            w = rng.choice(shared).split()
            a, b = sorted((rng.randrange(len(w) + 1), rng.randrange(len(w) + 1)))
            parts += [" ".join(w if rng.random() < 0.5 else w[a:b]), prose(rng, rng.randrange(0, 10), 10_000)]
        out.append(" ".join(parts))
    return out + out[:5] + ["x y " * 40, "x y " * 40 + "z"] + awkward_texts()


def cut_words(rows, window):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[p:p + window])] = min(first.get(tuple(w[p:p + window]), i), i)
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - window + 1) if i is not None and first[tuple(w[p:p + window])] < i for q in range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return out


def test_passages_against_brute_force(spark):
    texts = passages()
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    ids[10], ids[11], ids[12], ids[13] = None, None, ids[14], ids[14]
    for window, seed in ((13, 4), (5, 3)):
        docs = documents(spark, texts, ids).repartition(5).withColumn("doc", F.lit(1)).withColumn("text2", F.lit("clash"))
        got = [tuple(r) for r in substring.remove_repeats(docs, window=window, seed=seed).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(got, key=key) == sorted(cut_words(list(zip(ids, texts, strict=True)), window), key=key)


def test_passages_hot_group_across_batches(spark):
    rng = random.Random(8)
    hot = prose(rng, 60, 10_000)
    texts = [f"{prose(rng, 12, 10_000)} {hot} {prose(rng, 5, 10_000)}" for _ in range(300)]
    got = substring.remove_repeats(documents(spark, texts).repartition(7)).collect()
    assert {(r.id, r.n_removed >= 60) for r in got} == {(i, i > 0) for i in range(300)}
    assert substring.remove_repeats(documents(spark, [])).collect() == []


def reference_fingerprint(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[j:j + 3]) for j in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def close_groups(fps, radius):
    u = sorted(set(fps))
    arr, root = np.array(u, dtype=np.uint64), {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in u:
        for b in arr[np.bitwise_count(arr ^ np.uint64(a)) <= radius].tolist():
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {x: find(x) for x in u}


def test_covering_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        rng = random.Random(radius)
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)


def test_links_equal_all_pairs_in_small_and_large_buckets(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {rng.getrandbits(64) for _ in range(400)}
    for c in centres:
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for radius in (1, 2, 3):
        want = close_groups(fps, radius)
        for pair_bucket in (2, 10_000):
            df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
            links = simhash.fingerprint_links(df, radius, pair_bucket)
            got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in connected_components(links).collect()}
            groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
            assert {g for g in groups(got) if len(g) > 1} == {g for g in groups(want) if len(g) > 1}


def test_simhash_groups_and_representatives(spark):
    rng = random.Random(11)
    texts = awkward_texts() + [" ".join(prose(rng, 400, 10_000).split()) for _ in range(3)]
    texts += [texts[-1] + " extra", texts[-2].upper()]
    ids = [*range(len(texts) - 2), None, 3]
    fps = [reference_fingerprint(t) for t in texts]
    root = close_groups(fps, 2)
    best = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            best[root[f]] = min(best.get(root[f], i), i)
    docs = documents(spark, texts, ids).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = [(r.id, r.fingerprint_value & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicate_groups(docs).collect()]
    want = [(i, f, best.get(root[f])) for i, f in zip(ids, fps, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(best.values()))
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.near_duplicate_groups(documents(spark, [])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000), (4000, 4500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 4000: 4000, 4500: 4000, 5000: 4000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch):
    """Repeated links of one star around a node that is not its smallest: the links and one round are written, no more."""
    written = []
    monkeypatch.setattr(components, "write_shared", lambda df, tag: written.append(tag) or write_shared(df, tag))
    links = spark.createDataFrame([(50, i) for i in range(40)] * 2 + [(7, 7)], "a long, b long")
    assert sorted(map(tuple, components.star_edges(links).collect())) == [(i, 0) for i in [*range(1, 40), 50]]
    assert written == ["links", "links"]


def cut_lines(rows, run, long_line=None):
    """Rows in the order of the operator: id (null first), then text hash."""
    first, windows = {}, []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        full = [j for j, x in enumerate(lines) if words(x)]
        own = [full[s:s + run] for s in range(len(full) - run + 1)]
        if long_line:
            own += [[j] for j in full if len(words(lines[j])) >= long_line]
        windows.append((lines, (i is not None, i or 0, xxhash_signed(t)), own))
        for at in own:
            key, place = tuple(lines[j] for j in at), (*windows[-1][1], at)
            first[key] = min(first.get(key, place), place)
    out = []
    for (i, t), (lines, rank, own) in zip(rows, windows, strict=True):
        gone = {j for at in own if first[tuple(lines[j] for j in at)] != (*rank, at) for j in at}
        out.append((i, len(lines), len(gone), None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return out


def xxhash_signed(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_lines_against_brute_force(spark):
    rng = random.Random(12)
    pool = [f"line {i}" for i in range(12)] + ["", " \t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    texts += [texts[3], "a\na\na\na", "a\na", None, "", "\n\n\n", "long\nline\n" * 3000]
    ids = [*range(len(texts) - 2), 5, None]
    for run in (1, 2, 3):
        docs = documents(spark, texts, ids).withColumn("gone", F.lit("clash")).withColumn("rk", F.lit(0))
        got = [(r["_row"].doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(docs, min_run=run).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, str(r[3]), r[1])
        assert sorted(got, key=key) == sorted(cut_lines(list(zip(ids, texts, strict=True)), run), key=key)
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


def test_long_lines_that_stand_alone(spark):
    rng = random.Random(13)
    pool = [" ".join(f"l{i}w{j}" for j in range(n)) for i, n in enumerate([1, 3, 7, 11, 12, 12, 13, 60, 300])] + ["", " "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.4 else f"own {rng.random()}" for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += [pool[8], pool[7] + "\n" + pool[7], None, ""]
    want = cut_lines(list(enumerate(texts)), 2, 12)
    got = [(r["_row"].doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(documents(spark, texts), long_line=12).collect()]
    assert sorted(got) == want
    assert any(n for _, _, n, _ in want[80:82])


def test_representative_of_a_repeated_id_is_in_the_group_it_names(spark):
    rng = random.Random(14)
    for _ in range(2):
        a, b = (" ".join(prose(rng, 300, 10_000).split()) for _ in range(2))
        for low, other in ((a, b), (b, a)):
            # 7 names the group of ``other`` only: that of ``low`` is named by 1
            kept = simhash.keep_representatives(documents(spark, [low, low, other], [1, 7, 7])).collect()
            assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, low), (7, other)])
