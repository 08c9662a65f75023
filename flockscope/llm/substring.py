"""Operator 5 - repeated passages across documents: seed and extend.

Every ``window``-word window owns one seed: the smallest hash among its
``seed``-word grams (winnowing), so two documents that share a window share its
seed. (1) Each document sends its distinct seeds; those found in two documents
are shared. (2) Documents with shared seeds are joined with them, every shared
seed is extended both ways to all windows that own it, and equal windows meet
by hash: a window is removed where a smaller id has it too. (3) Overlapping
removed windows merge into maximal repeats, which are cut out.

Exact copies of a text are settled before: only the one with the smallest id
goes through the steps, the others are cut whole.

Hot seeds and windows (a passage in a third of all documents) are settled inside
each batch first: only one witness per batch goes to the seed's group, the
other rows are already decided and are dealt out by a key of their own. No
group therefore has more rows than there are batches. Texts are shuffled once
(all joins use the same exchange), only hashes and places otherwise; decided
windows that follow each other, and equal ones of a text, travel as one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscope.llm.wordarrays import WordHash, hash_words, sliding_min, split_words, window_hashes, window_starts


def _owned_seeds(h: np.ndarray, lengths: np.ndarray, window: int, seed: int):
    """``(start, owner, seed)`` of every window of a batch."""
    start, owner = window_starts(lengths, window)
    low = sliding_min(window_hashes(h, seed), window - seed + 1)
    return start, owner, low[start] if len(start) else np.empty(0, np.uint64)


def _settle(key: np.ndarray, ids: np.ndarray, second: np.ndarray | None = None):
    """Group rows of a batch by key: the smallest id of each row's group, the
    number of distinct ids (1 or more), and whether the row is its group's witness
    (first row with the smallest id)."""
    order = np.lexsort((ids, key) if second is None else (ids, second, key))
    k, i = key[order], ids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(k)) - 1
    low, high = i[head][group], i[last][group] if len(k) else i
    out_low, out_many, out_first = np.empty_like(ids), np.empty(len(k), bool), np.empty(len(k), bool)
    out_low[order], out_many[order], out_first[order] = low, low != high, new
    return out_low, out_many, out_first


def _own_key(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A key per (key, id): deals decided rows of a hot group out evenly."""
    with np.errstate(over="ignore"):
        return key ^ (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))


def _seed_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            h, lengths = hash_words((split_words(t) for t in b.column(1).to_pylist()), memo)
            _, owner, low = _owned_seeds(h, lengths, window, seed)
            if not len(owner):
                continue
            change = np.ones(len(owner), bool)
            change[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])
            low, doc = low[change], ids[owner[change]]
            _, many, first = _settle(low, doc)
            key = np.where(many & ~first, _own_key(low, doc), low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(low.view(np.int64)), pa.array(doc), pa.array(many)],
                ["key", "seed", "doc", "known"])
    return run


def _runs(start: np.ndarray, owner: np.ndarray, one: np.ndarray, two: np.ndarray, removed: np.ndarray):
    """``(first row, count, step)``: windows that share a verdict, as evenly spaced runs.

    Decided windows of a text run on wherever they follow each other. Open ones
    run over the equal windows of a text, so text that repeats itself ("a b a b")
    sends a row for each of its windows' contents and not for each place.
    """
    text, first, second = owner.astype(np.int64), np.where(removed, 0, one), np.where(removed, 0, two)
    order = np.lexsort((start, second, first, removed, text))
    t, f, s, r, at = text[order], first[order], second[order], removed[order], start[order]
    same = np.zeros(len(order), bool)
    same[1:] = (t[1:] == t[:-1]) & (r[1:] == r[:-1]) & (f[1:] == f[:-1]) & (s[1:] == s[:-1])
    gap = np.ones(len(order), dtype=np.int64)
    gap[1:] = at[1:] - at[:-1]
    on = same & (~r | (gap == 1))
    on[1:] &= ~on[:-1] | (gap[1:] == gap[:-1])  # a run keeps its step
    head = np.flatnonzero(~on)
    count = np.diff(np.append(head, len(order)))
    step = np.where(count > 1, gap[np.minimum(head + 1, len(order) - 1)], 1)
    return order[head], count.astype(np.int32), step.astype(np.int32)


def _window_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            h, lengths = hash_words((split_words(t) for t in texts), memo)
            start, owner, low = _owned_seeds(h, lengths, window, seed)
            if not len(owner):
                continue
            shared = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            shared_owner = np.repeat(np.arange(len(ids)), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore"):
                mark = lambda s, o: s ^ (o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            hit = np.isin(mark(low, owner), mark(shared, shared_owner))  # a chance match only adds a candidate
            start, owner = start[hit], owner[hit]
            if not len(owner):
                continue
            one, two = window_hashes(h, window)[start], (window_hashes(h, window, 31)[start] >> np.uint64(33)).astype(np.int32)
            doc = ids[owner]
            low_doc, many, first = _settle(one, doc, two)
            removed = low_doc < doc
            key = np.where(removed, _own_key(one, doc), one)
            text_mark = np.array([xxhash.xxh32_intdigest(t or "") for t in texts], dtype=np.int64)
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = (text_mark[owner] << 32) | (start - begins[owner])
            row, n, step = _runs(start, owner, one, two, removed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row].view(np.int64)), pa.array(two[row]), pa.array(doc[row]), pa.array(place[row]),
                 pa.array(n), pa.array(step), pa.array(removed[row])],
                ["key", "key2", "doc", "place", "n", "step", "known"])
    return run


def _cut_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            columns = (b.column(i).to_pylist() for i in (1, 2))
            for text, copy, runs in zip(*columns, b.column(3), strict=True):
                words = split_words(text)
                n = len(words)
                if copy and n >= window:
                    words = []
                elif runs.is_valid and len(runs.values):
                    first, count, step = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "step"))
                    mine = (first >> 32) & 0xFFFFFFFF == xxhash.xxh32_intdigest(text or "")
                    first, count, step = first[mine] & 0xFFFFFFFF, count[mine], step[mine].astype(np.int64)
                    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    own = np.repeat(first, count) + nth * np.repeat(step, count)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, own, 1)
                    np.add.at(edge, own + window, -1)
                    words = list(compress(words, (np.cumsum(edge[:n]) == 0).tolist()))
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 13,
                   seed: int = 4) -> DataFrame:
    """``(id, n_words, n_removed, kept_text)``, one row per input row.

    A word is removed if a window of ``window`` words of its document covers it
    whose word sequence also starts in a document with a smaller id (a long).
    Windows are judged on the input. ``kept_text`` has the other words, joined
    by one space. Null, blank and short texts have no window and stay. Repeated
    rows and rows sharing an id are never smaller than each other, so none is
    cut on account of the other; a null id is neither smaller nor larger than
    any, so its row stays whole and cuts nothing. Empty table: empty result.
    Windows are compared by 95 bits of hash.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    known = rows.where("id IS NOT NULL")
    marks = known.select("id", F.xxhash64("body").alias("m1"), F.hash("body").alias("m2"), F.octet_length("body").alias("m3"))
    least = marks.groupBy("m1", "m2", "m3").agg(F.min("id").alias("least"))
    copies = (marks.join(least, ["m1", "m2", "m3"]).where("least < id")
              .groupBy("id").agg(F.collect_set("m1").alias("marks")).withColumnRenamed("id", "copy_id"))
    is_copy = F.coalesce(F.array_contains("marks", F.xxhash64("body")), F.lit(False))
    # every join below is on id, so they all read this one exchange of the texts (the column has a new name
    # because an alias that changes nothing is dropped in some branches, which then do not count as equal)
    texts = known.join(copies, known["id"] == copies["copy_id"], "left").select("id", "body", is_copy.alias("copy"))
    seeds = texts.where("NOT copy").select("id", "body").mapInArrow(
        _seed_rows(window, seed), "key long, seed long, doc long, known boolean")
    group = Window.partitionBy("key")
    shared = (seeds.withColumn("many", F.min("doc").over(group) != F.max("doc").over(group))
              .where("known OR many").groupBy("doc").agg(F.collect_list("seed").alias("seeds")))
    extended = (known.join(shared, known["id"] == shared["doc"])
                .select("id", "body", "seeds")
                .mapInArrow(_window_rows(window, seed), "key long, key2 int, doc long, place long, n int, step int, known boolean"))
    same = Window.partitionBy("key", "key2")
    gone = (extended.withColumn("least", F.min("doc").over(same)).where("known OR least < doc")
            .groupBy("doc").agg(F.collect_list(F.struct("place", "n", "step")).alias("runs")))
    out = texts.join(gone, texts["id"] == gone["doc"], "left").select("id", "body", "copy", "runs")
    anonymous = rows.where("id IS NULL").select(
        "id", "body", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<place:long,n:int,step:int>>").alias("runs"))
    return out.unionByName(anonymous).mapInArrow(
        _cut_rows(window), "id long, n_words long, n_removed long, kept_text string")
