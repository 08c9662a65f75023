"""Operators 3, 8, 10: URL filters, chat formatting, decontamination."""

import random
import re

import numpy as np

from flockscope.llm import chat, decontaminate, url_filter
from pyspark.sql import functions as F
from tests.llm.helpers import awkward_texts, documents, prose, words


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host):])[0]


def verdict(url, rules):
    host, path = host_path(url)
    fits = [(len(h) + len(p or ""), len(h), h + (p or ""), v) for v, h, p in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, key=lambda x: (x[0], x[1]), default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


URLS = ["http://net/", "http://a.NET/x?y#z", "https://www.example.net/en/1", "http://example.net/EN/", "http://xexample.net/en/",
        "ftp://b.example.com/de/é", "http://example.com", "http://org/fr/", "http://..org/fr/x", "http://net./", "http://.net/",
        "mailto:a@b.net", None, "", "://", "http://a.net?x/en/", "http://user@h.net:80/p", "http://É.example.net/en/\n/q", "http://x.net/",
        "http://x.net/", "http://a\0b.net/", "http://例え.org/fr/日本"]


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "net", "example", "org", ""]
    urls = URLS + ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/en/", "/a/b", "/a"]) +
                   rng.choice(["", "x", "?q"]) for _ in range(400)]
    more = url_filter.RULES + [("block", ".".join(rng.choice(labels[:5]) for _ in range(rng.randrange(1, 4))), rng.choice(["/", "/a", "/a/b", "/en/", None]))
                               for _ in range(25)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("r", F.lit(1))
    for rules in (url_filter.RULES, more, []):
        unique = {(h, p or ""): v for v, h, p in sorted(rules, key=lambda r: r[0], reverse=True)}
        plain = [(v, h, p) for (h, p), v in unique.items()]
        table = url_filter.rule_table(spark, [*rules, ("block", None, "/"), ("block", "", "/")])
        got = {r["_row"].page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table).collect()}
        assert got == {i: verdict(u, plain) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).collect() == []


def test_sweep_gives_whole_stacks(spark):
    keys = spark.createDataFrame([("abcd",), ("ab",), ("b",), ("",), ("abz",), ("ac",)], "key string")
    prefixes = spark.createDataFrame([("a",), ("ab",), ("abc",), ("ac",)], "prefix string")
    got = {r.key: r.stack for r in url_filter.prefix_sweep(keys, prefixes).collect()}
    assert got == {"abcd": ["a", "ab", "abc"], "ab": ["a", "ab"], "b": [], "": [], "abz": ["a", "ab"], "ac": ["a", "ac"]}


def test_preference_pairs(spark):
    u, a = "user", "assistant"
    sides = {1: ([(u, "hi"), (a, "yes"), (u, "go")], [(u, "hi"), (a, "no")]), 2: ([(u, "same")], [(u, "same")]),
             3: ([(u, "x")], []), 4: ([(None, None), (a, None)], [(None, None), (a, "")]), 5: ([("system", "s" * 50_000), (a, "b")], [("system", "s" * 50_000), (a, "c")])}
    rows = [(p, side == 0, t, r, x, "clash") for p, both in sides.items() for side in (0, 1) for t, (r, x) in enumerate(both[side])]
    rows += [rows[0], (1, True, 0, u, "zz", ""), (None, True, 0, u, "x", ""), (1, None, 0, u, "x", ""), (1, True, None, u, "x", "")]
    turns = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn int, role string, text string, part string")
    parts = chat.preference_turns(turns)
    whole = {r.pair_id: r for r in chat.assemble(parts).collect()}
    show = lambda said: "".join(f"<|{r or 'unknown'}|>\n{x or ''}\n" for r, x in said)
    for p, (x, y) in sides.items():
        n = next((i for i, (s, t) in enumerate(zip(x, y, strict=False)) if s != t), min(len(x), len(y)))
        assert (whole[p].prompt, whole[p].chosen, whole[p].rejected) == (show(x[:n]), show(x[n:]), show(y[n:]))
        for name, said in (("chosen", x[n:]), ("rejected", y[n:])):
            text, spans = whole[p][name], whole[p][f"{name}_train"]
            assert [text[s.start:s.end] for s in spans] == [show([t]) for t in said if t[0] == a]
    assert parts.where("part = 'prompt' AND train").count() == 0
    assert chat.preference_turns(turns.limit(0)).collect() == []


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_alignment_scores(spark):
    rng = random.Random(1)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(1, 25))], [rng.randrange(6) for _ in range(rng.randrange(1, 60))]) for _ in range(60)]
    got = decontaminate.align(*[[np.array(x, dtype=np.uint64) for x in side] for side in zip(*pairs, strict=True)])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(15, 60), 100_000)) for i in range(30)] + [(30, None), (31, ""), (32, "two words"), (5, None)]
    texts, want = [], set()
    for i, t in items[:30]:
        w = t.split()
        edited = [x if rng.random() > 0.08 else "changed" for x in w]
        gap = w[:len(w) // 2] + ["one", "more"] + w[len(w) // 2:]
        for form in (" ".join(w), "“" + t.upper() + "!", " ".join(edited), " ".join(gap)):
            want.add((len(texts), i))
            texts.append(f"{prose(rng, 30, 100_000)} {form} {prose(rng, 300, 100_000)}")
    hot = items[0][1]
    for _ in range(200):
        want.add((len(texts), 0))
        texts.append(f"{prose(rng, 10, 100_000)} {hot}")
    clean = len(texts)
    texts += [prose(rng, 200, 100_000) for _ in range(100)] + awkward_texts() + [None, "", "two words"]
    docs = documents(spark, texts).withColumn("seeds", F.lit("clash")).withColumn("rk", F.lit(0)).repartition(6)
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("gram", F.lit(1))
    got = {(r.id, r.item_id) for r in decontaminate.find_leaks(docs, table).collect()}
    assert got == want
    left = decontaminate.drop_leaks(docs, table)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(clean, len(texts)))
    assert decontaminate.find_leaks(documents(spark, []), table).collect() == []
    assert decontaminate.find_leaks(docs, table.limit(0)).collect() == []
    twice = documents(spark, [texts[0], texts[0]], [None, None])
    assert decontaminate.find_leaks(twice, table).count() == 1 and decontaminate.drop_leaks(twice, table).count() == 0


def test_every_verbatim_run_holds_a_seed(spark):
    rng = random.Random(2)
    item = prose(rng, 50, 100_000)
    w = item.split()
    texts = [f"{prose(rng, 20, 9)} {' '.join(w[p:p + 30])} {prose(rng, 20, 9)}" for p in range(0, 20)]
    got = decontaminate.find_leaks(documents(spark, texts), spark.createDataFrame([(1, item)], "item_id int, text string"), threshold=0.5)
    assert got.count() == len(texts) and all(words(t) for t in texts)


def test_edited_copies_against_alignment_of_all_pairs(spark):
    rng = random.Random(3)
    common = ["of the end", "in the end", "to the end"]
    items = [[*prose(rng, rng.randrange(18, 50), 100_000).split(), *rng.choice(common).split()] for _ in range(12)]
    edits = {"replaced": lambda w, i: [f"new{i}"], "inserted": lambda w, i: [w, f"new{i}"], "dropped": lambda w, i: []}
    texts = [" ".join(w) for w in items]  # the grams that edits remove stand in the verbatim copies
    for w in items:
        for every in (4, 5, 6):
            for edit in edits.values():
                copy = [y for i, x in enumerate(w) for y in (edit(x, i) if i % every == every - 1 else [x])]
                texts.append(f"{prose(rng, 20, 100_000)} {' '.join(copy)} {prose(rng, 20, 100_000)}")
    # a run of three at one end, then pairs of words with one more between: as far as an alignment can reach
    texts += [" ".join([*w[:3], *(y for i in range(3, len(w)) for y in ([w[i], "more"] if i % 2 else [w[i]]))]) for w in items]
    texts += [f"{prose(rng, 40, 100_000)} {rng.choice(common)} {prose(rng, 40, 100_000)}" for _ in range(40)]
    grams = [set(zip(w, w[1:], w[2:], strict=False)) for w in items]
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i, item in enumerate(items):
            if grams[i] & set(zip(w, w[1:], w[2:], strict=False)):
                score = smith_waterman(item, w) / (decontaminate.MATCH * min(len(item), 40))
                if score >= 0.6:
                    want[d, i] = round(min(score, 1.0), 6)
    assert len(want) >= 11 * len(items)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")
    got = {(r.id, r.item_id): round(r.similarity, 6) for r in decontaminate.find_leaks(documents(spark, texts), table).collect()}
    assert got == want


def test_frequent_phrases_bring_no_pairs_and_edited_copies_stay_found(spark):
    rng = random.Random(11)
    items = []
    for _ in range(20):
        w = prose(rng, 36, 100_000).split()
        items.append([*w[:18], "one", "of", "the", *w[18:]])
    texts, planted = [], set()
    for i, w in enumerate(items):
        for every in (4, 5, 6):
            copy = [f"new{k}" if k % every == every - 1 else x for k, x in enumerate(w)]
            planted |= {(len(texts) + j, i) for j in range(3)}
            texts += [f"{prose(rng, 15, 100_000)} {' '.join(copy)} {prose(rng, 15, 100_000)}" for _ in range(3)]
    texts += [f"{prose(rng, 20, 100_000)} one of the {prose(rng, 20, 100_000)}" for _ in range(150)]
    docs = documents(spark, texts)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")
    found = lambda few: {(r.id, r.item_id) for r in decontaminate.find_leaks(docs, table, few=few).collect()}
    every, thin = found(1_000_000), found(4)
    assert thin <= every and len(thin) >= 0.9 * len(every) and len(every & planted) >= 0.6 * len(planted)
    # n-grams 0 to 9 of one item, 3 and 4 in many stretches: those that are no rarest of four neighbours are no seeds
    grams = spark.createDataFrame([(1, g, g) for g in range(10)], "item_key long, gram long, place long")
    near = spark.createDataFrame([([3, 4],)] * 50 + [([0, 1, 2, 5, 6],)] + [([7],)] * 9 + [([77],)], "seeds array<long>")
    got = {r.gram for r in decontaminate.choose_seeds(grams, near, few=5, window=4).collect()}
    assert got == {0, 1, 2, 5, 6, 7}  # 7 ends the item; 8 and 9 occur nowhere
    alone = decontaminate.choose_seeds(grams, near.where("seeds[0] = 3"), few=5, window=4)
    assert {r.gram for r in alone.collect()} == {3, 4}  # no rarer neighbour: the suffix windows keep both
