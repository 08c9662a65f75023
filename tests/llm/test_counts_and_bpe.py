"""Operators 1 and 6: token counts, BPE."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer, models

from flockscope.llm import bpe, token_counts
from flockscope.llm.wordarrays import LONGEST_KEPT, WordHash
from tests.llm.helpers import awkward_texts, documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    return token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def longest_match(word, begin, inside):
    at, n = 0, 0
    while at < len(word):
        pool = begin if at == 0 else inside
        size = next((k for k in range(min(len(word) - at, 40), 0, -1) if word[at:at + k] in pool), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_automaton_equals_longest_match_on_random_vocabularies():
    rng = random.Random(5)
    for _ in range(150):
        make = lambda: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        begin, inside = make(), make()
        counter = token_counts.PieceCounter(begin, inside)
        for _ in range(60):
            w = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randrange(1, 15)))
            assert counter.count(w) == longest_match(w, begin, inside), (w, begin, inside)


def test_counts_equal_a_wordpiece_model(spark, pieces):
    begin, inside = pieces
    vocab = {"[UNK]": 0}
    for p in [*begin, *("##" + x for x in inside)]:
        vocab.setdefault(p, len(vocab))
    model = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9))
    texts = awkward_texts()
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, texts), begin, inside).collect()}
    for i, t in enumerate(texts):
        if max(map(len, words(t)), default=0) > 1000:  # the model is quadratic in a word's length
            assert got[i].n_tokens == sum(longest_match(w, set(begin), set(inside)) for w in words(t)) + got[i].n_unknown
            continue
        ids = [model.encode(w).ids for w in words(t)]
        assert (got[i].n_words, got[i].n_tokens) == (len(ids), sum(map(len, ids)))
        assert got[i].n_unknown == sum(x == [0] for x in ids)


def test_counts_of_empty_table_and_repeated_rows(spark, pieces):
    assert token_counts.token_counts(documents(spark, []), *pieces).collect() == []
    rows = token_counts.token_counts(documents(spark, ["a b", "a b", None], [7, 7, None]), *pieces).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in rows) == [(-1, 0), (7, 2), (7, 2)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return array("I", ids).tobytes(), library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_awkward_texts(spark, library):
    texts = [*awkward_texts(), "<|endoftext|>x <|startoftext|>", "ΑΣ Σ ΣΣ", "İstanbul é ⃬᫂ ՘ \U000105c0",
             "it's we'll I'D 12345 !!!%%% a_b", "ab" * 3000 + "é" * 200]
    out = bpe.encode_decode(documents(spark, texts), PATH).collect()
    assert {r.doc_id: (bytes(r.ids), r.decoded) for r in out} == {i: expected(library, t) for i, t in enumerate(texts)}


def test_bpe_equals_library_on_random_strings(library):
    import json
    with open(PATH, encoding="utf-8") as f:
        own = bpe.ForcedBoundaryBPE(json.load(f))
    rng = random.Random(3)
    pool = [chr(rng.randrange(0x20, 0x3000)) for _ in range(200)] + list("abcdefghijklmnopqrstuvwxyz' \n\t\x85\x1c.,!09Σß") * 4
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        assert own.run(text) == expected(library, text), ascii(text)
    for c in range(0x21, 0x3100):
        assert own.run(f"a{chr(c)}b") == expected(library, f"a{chr(c)}b"), hex(c)


def test_forced_boundaries_cut_only_where_no_merge_can_join():
    import json
    with open(PATH, encoding="utf-8") as f:
        own = bpe.ForcedBoundaryBPE(json.load(f))
    assert all(pair in own.joined for pair in own.rank if pair >> 32 in {*own.inner} and pair & 0xFFFFFFFF in {*own.inner, *own.final})
    long = [own.inner[ord(c)] for c in "thequickbrownfox" * 30]
    assert own._merge(list(long)) == own._merge_long(list(long))


def test_bpe_round_trip_digest_and_edges(spark):
    out = bpe.encode_decode(documents(spark, ["Hello hello", None], [None, 1]), PATH).collect()
    assert {r.doc_id: r.decoded for r in out} == {None: "hello</w> hello</w>", 1: ""}
    assert hashlib.sha256(bytes(out[1].ids)).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_decode(documents(spark, []), PATH).collect() == []


def test_kept_columns_named_like_results(spark, pieces, library):
    docs = documents(spark, ["a b", None]).selectExpr("doc_id AS N_tokens", "text", "lang AS ids", "source AS kept_ids")
    out = token_counts.token_counts(docs, *pieces, keep=("N_tokens", "ids"))
    assert out.columns == ["kept_N_tokens", "ids", "n_words", "n_tokens", "n_unknown"]
    assert {(r.kept_N_tokens, r.ids, r.n_words) for r in out.collect()} == {(0, "en", 2), (1, "en", 0)}
    out = bpe.encode_decode(docs, PATH, keep=("kept_ids", "ids", "N_tokens"))
    assert out.columns == ["kept_ids", "kept_kept_ids", "N_tokens", "ids", "decoded"]
    assert {(r.N_tokens, bytes(r.ids)) for r in out.collect()} == {(0, expected(library, "a b")[0]), (1, b"")}


def test_memos_keep_no_long_words(library):
    import json
    with open(PATH, encoding="utf-8") as f:
        own = bpe.ForcedBoundaryBPE(json.load(f))
    counter, memo = token_counts.PieceCounter(["a"], ["a"]), WordHash()
    for word in ("a" * LONGEST_KEPT, "a" * (LONGEST_KEPT + 1), "a" * 100_000):
        for _ in range(2):
            assert own.run(word) == expected(library, word)
            assert counter.text(word) == (1, len(word), 0)
            assert memo[word.encode()] == xxhash.xxh64_intdigest(word)
    assert max(map(len, [*own.words, *counter.known, *memo])) == LONGEST_KEPT
