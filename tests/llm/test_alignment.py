"""Operator 12 against whole-text tokenization and plain counting."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from flockscope.llm import alignment
from flockscope.llm.bpe import byte_letters
from flockscope.llm.queries import QUERIES, read_table

from ..conftest import SF0001
from .helpers import awkward_texts, documents

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
LETTER = {c: i for i, c in enumerate(byte_letters())}


def piece_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def brute(rows):
    read = []
    for i, t in rows:
        a = b = []
        if t:
            a, b = A.encode(" " + t, add_special_tokens=False).ids, B.encode(t)
            ba, bb = [bytes(LETTER[c] for c in A.id_to_token(x)) for x in a], [piece_bytes(x) for x in b]
            if not b"".join(ba) == b"".join(bb) == (" " + t).encode():
                a = b = []
        if not a:
            read.append((i, [], [], [], []))
            continue
        spans = []
        for parts in (ba, bb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        ends = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        links, k = [], 0
        for (s, e), x in zip(spans[0], a, strict=True):
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(b) and spans[1][j][0] < e:
                links.append((x, b[j]))
                j += 1
        groups, ia, ib = [], 0, 0
        for e in sorted(ends):
            ja, jb = ia, ib
            while ja < len(a) and spans[0][ja][1] <= e:
                ja += 1
            while jb < len(b) and spans[1][jb][1] <= e:
                jb += 1
            groups.append(",".join(map(str, a[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
            ia, ib = ja, jb
        read.append((i, a, b, groups, links))
    count = Counter(x for r in read for x in r[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(((i, len(a), len(b), len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, k in read), key=str)


def result(docs, **options):
    return sorted(map(tuple, alignment.align(docs, *PATHS, **options).collect()), key=str)


ODD = ["<|endoftext|> <s> a</s>", "  two  spaces ", "tab\t tab\n\n  x \n", "a▁b", " ", "\n", "\n\n a", "it's we'll\n'tis", "x\x1c y\x85 z　 w",
       "日本 語\nабв где", "é" * 300, "a" * 5000, "a b" * 3000, "  nbsp   ls", "1 2  3\r\n4", "😀 😀\n😀", "word " * 20, "x\x00y"]


def test_against_whole_texts(spark):
    texts = awkward_texts(9) + ODD
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert result(documents(spark, texts)) == expected
    # every text but the shortest in chunks, composed over several levels
    assert result(documents(spark, texts), chunk=64) == expected


def test_only_blocks_and_fragments_are_written(spark, monkeypatch):
    """Pair counts are derived from the blocks and not written: every file is a task's work and a fork of its executor."""
    written, write = [], alignment.write_shared
    monkeypatch.setattr(alignment, "write_shared", lambda df, tag: written.append(tag) or write(df, tag))
    assert [r[1] > 0 for r in result(documents(spark, ["one two", "two one"]))] == [True, True]
    assert written == ["align-fragments", "align-blocks"]


def test_random_bytes_of_blanks_and_letters(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\t ab é'日1.") for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    expected = brute(list(enumerate(texts)))
    assert result(documents(spark, texts)) == expected
    assert result(documents(spark, texts), chunk=50) == expected


def test_repeated_rows_null_ids_clashes_and_empty(spark):
    texts = ["some words here", "some words here", None, "other words " * 40, "other words " * 40, ""]
    ids = [3, 3, None, None, 7, 7]
    assert result(documents(spark, texts, ids), chunk=100) == brute(list(zip(ids, texts, strict=True)))
    clash = documents(spark, texts, ids).selectExpr("doc_id", "text", "1 AS block", "2 AS id", "3 AS n_a", "4 AS body")
    assert result(clash, chunk=100) == brute(list(zip(ids, texts, strict=True)))
    twice = [(7, "other words " * 40)] * 2
    assert result(documents(spark, [t for _, t in twice], [i for i, _ in twice]), chunk=100) == brute(twice)
    assert result(documents(spark, [])) == []


def test_fragments_compose_in_any_grouping():
    aligner = alignment.Aligner(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    data = (" " + " ".join(t for t in awkward_texts(5)[4:12]) + "日本 語 " * 30).encode()
    parts = [alignment.fragment(aligner, data[i:i + 37]) for i in range(0, len(data), 37)]
    plain = lambda f: {k: list(v) if k in ("pairs", "times") else v for k, v in f.items()}
    whole = plain(alignment.compose(aligner, parts))
    for width in (2, 3, 5):
        level = parts
        while len(level) > 1:
            level = [alignment.compose(aligner, level[i:i + width]) for i in range(0, len(level), width)]
        assert plain(level[0]) == whole


def test_query_against_whole_texts(spark):
    rows = [tuple(r) for r in read_table(spark, SF0001, "documents").select("doc_id", "text").collect()]
    found = QUERIES["op12_tokenizer_alignment"](spark, SF0001)
    assert found.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
