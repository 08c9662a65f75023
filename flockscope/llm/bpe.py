"""Operator 6 - byte-pair encoding and decoding with forced boundaries.

The tokenizer file supplies normalisation flags, the split pattern, the
vocabulary and the ranked merges. A word's symbols are its bytes, the last one
carrying the end-of-word mark. Every symbol pair that occurs inside no
vocabulary token is a certain cut: no merge can ever cover it. Words are cut
there, the fragments are encoded independently, merging by rank, lowest first,
and their ids are concatenated. Whole words are remembered, up to a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flockscope.llm.common import kept_schema, with_text
from flockscope.llm.wordarrays import LONGEST_KEPT


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Last character of the basic plane.
BASIC = 0xFFFF


@lru_cache(maxsize=1)
def class_ranges() -> dict[str, str]:
    """Character-class bodies of letters, numbers, marks and unknown characters, from the Unicode database of this Python.

    Spelled out, because pattern libraries follow Unicode editions of their own;
    of the basic plane only, which ``re`` tests by table and not range by range.
    """
    out = {}
    for name in ("L", "N", "M", "Cn"):
        ranges, begin = [], None
        for c in range(BASIC + 2):
            inside = c <= BASIC and unicodedata.category(chr(c)).startswith(name)
            if inside and begin is None:
                begin = c
            elif not inside and begin is not None:
                ranges.append(f"\\u{begin:04x}-\\u{c - 1:04x}")
                begin = None
        out[f"\\p{{{name}}}"] = "".join(ranges)
    return out


#: White space of the Unicode property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def plain_pattern(pattern: str) -> re.Pattern:
    """The file's split pattern with its Unicode classes spelled out.

    ``\\p{..}`` and ``\\s`` must stand inside brackets, as they do in such files.
    """
    pattern = pattern.replace(r"\s", SPACE)
    for name, body in class_ranges().items():
        pattern = pattern.replace(f"[{name}]", f"[{body}]").replace(name, body)
    return re.compile(pattern)


RARE = re.compile("[" + class_ranges()[r"\p{M}"] + class_ranges()[r"\p{Cn}"] + "]")
BEYOND = re.compile(r"[\U00010000-\U0010ffff]")


class ForcedBoundaryBPE:
    """Encoder and decoder of one word-level BPE file with an end-of-word suffix."""

    def __init__(self, spec: dict, most: int = 400_000):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.joined = self._inside_pairs(vocab)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = plain_pattern(split)
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.most, self.words = most, {}
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.letter = {c: i for i, c in enumerate(letters)}

    def _inside_pairs(self, vocab: dict[str, int]) -> set[int]:
        """Symbol pairs that occur side by side inside some vocabulary token."""
        found = set()
        for token in vocab:
            end = token.endswith(self.suffix) and token != self.suffix
            body = token.removesuffix(self.suffix) if end else token
            if any(c not in vocab for c in body):
                continue
            ids = [vocab[c] for c in body]
            if end:
                ids[-1] = vocab[body[-1] + self.suffix]
            found.update(a << 32 | b for a, b in zip(ids, ids[1:], strict=False))
        return found

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked neighbouring pair, leftmost first, until none is left."""
        rank, merged, none = self.rank.get, self.merged, len(self.merged)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            j = ranks.index(r)
            ids[j:j + 2] = [merged[r]]
            del ranks[j]
            if j:
                ranks[j - 1] = rank(ids[j - 1] << 32 | ids[j], none)
            if j < len(ranks):
                ranks[j] = rank(ids[j] << 32 | ids[j + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As ``_merge`` by a heap over a linked list: n log n for very long fragments."""
        n, rank = len(ids), self.rank.get
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, j, ids[j], ids[j + 1]) for j in range(n - 1) if (r := rank(ids[j] << 32 | ids[j + 1])) is not None]
        heapify(heap)
        while heap:
            r, j, a, b = heappop(heap)
            k = nxt[j]
            if ids[j] != a or k < 0 or ids[k] != b:
                continue
            ids[j], ids[k], nxt[j] = self.merged[r], -1, nxt[k]
            if nxt[k] >= 0:
                prev[nxt[k]] = j
            for left in (prev[j], j):
                if left >= 0 and nxt[left] >= 0 and (m := rank(ids[left] << 32 | ids[nxt[left]])) is not None:
                    heappush(heap, (m, left, ids[left], ids[nxt[left]]))
        return [x for x in ids if x >= 0]

    def _fragment(self, symbols: list[int]) -> list[int]:
        """Ids of one fragment; long ones are remembered nowhere and use the heap."""
        return self._merge(symbols) if len(symbols) <= 64 else self._merge_long(symbols)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word: cut at the certain boundaries, encode, concatenate."""
        data = word.encode("utf-8")
        inner, joined = self.inner, self.joined
        symbols = [inner[x] for x in data]
        symbols[-1] = self.final[data[-1]]
        cuts = [j for j, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False), 1) if a << 32 | b not in joined]
        out, begin = [], 0
        for j in cuts:
            out += self._fragment(symbols[begin:j])
            begin = j
        return out + self._fragment(symbols[begin:])

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        known = (array("I", ids).tobytes(), " ".join([self.tokens[i] for i in ids]))
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= self.most:
                self.words.clear()
            self.words[word] = known
        return known

    def split(self, text: str) -> list[str]:
        """Words of a text: canonical composition, lower case character by character, split.

        Where a text has combining marks, characters beyond the basic plane or
        some that this Python's Unicode database does not know, the library's
        own tables decide.
        """
        if text.isascii():
            return self.word.findall(text.lower())
        composed = unicodedata.normalize("NFC", text)
        if BEYOND.search(composed) or RARE.search(text):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.letter[c] for c in piece).decode("utf-8") for piece, _ in found]
        return self.word.findall(composed.replace("Σ", "σ").lower())

    def run(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids, shown = [], []
        parts = self.special.split(text or "") if self.special and "<|" in (text or "") else [text or ""]
        for part in parts:
            if part in self.added:
                ids.append(array("I", [self.added[part]]).tobytes())
                shown.append(part)
                continue
            known, make = self.words, self._word
            for w in self.split(part):
                a, b = known.get(w) or make(w)
                ids.append(a)
                shown.append(b)
        return b"".join(ids), " ".join(shown)


@lru_cache(maxsize=2)
def _loaded(spec: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(json.loads(spec))


def _encode_batches(spec) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # results are larger than texts: hand them on in small batches
                part = b.slice(at, 512)
                out = [bpe.run(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())],
                    [*part.schema.names[:-1], "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (binary: little-endian uint32) and ``decoded`` of every row.

    ``tokenizer_path`` is read on the driver and its content (one file, of a
    fixed size) is broadcast. Whole texts are encoded without added special
    tokens, truncation or padding; special tokens written in a text get their
    own id. Decoding joins the tokens' strings by one space, as a file without
    a decoder does. Null and empty texts give no ids and an empty string.
    A text of any length is encoded whole; equal pairs of one rank merge from the
    left. Repeated rows give repeated results; an empty table gives an empty one.
    A ``keep`` column named like a result column comes back as ``kept_<name>``.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = with_text(docs, keep, text_col, ("ids", "decoded"))
    return slim.mapInArrow(_encode_batches(spec), kept_schema(slim, "ids binary, decoded string"))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
