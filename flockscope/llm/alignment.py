"""Operator 12 - alignment of two tokenizers by byte offsets, with corpus-wide link counts.

Byte offsets where a token of A and a token of B both end cut a text's tokens
into groups; the links of a group are its A-B pairs with overlapping bytes.

Texts are read in *segments* whose tokens depend on nothing around them: a text
is cut before a space between two non-blanks and before a line feed after a
non-blank, where no piece of B and no split of A reaches across. A chunk of a
text's bytes is a *fragment*: an open prefix up to its first such cut, the closed
groups between its cuts, an open suffix. Two neighbouring fragments compose by
closing what lies between them (suffix + prefix), which is associative, so
chunks of a very long text are read by different tasks and composed in a tree,
``FAN`` neighbours a step, level by level.

Link counts: every *block* of texts keeps a dictionary of its distinct segments
and id pairs. Spark adds the blocks' pair totals, finds each B id's highest, and
joins counts back to the pairs of every block (not of every text); a block and
its counts then meet in one cogroup of bounded size, where texts add theirs up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscope.llm.bpe import byte_letters
from flockscope.llm.common import write_shared

FAN = 16
#: Bytes of a chunk; shorter texts are not cut.
CHUNK = 1 << 16
#: Characters of texts that share a block.
BLOCK = 1 << 22
MARK = "▁"

CUT = re.compile(r"(?<=\S)(?= \S|\n)")
#: The same between ASCII characters, safe to look for in any stretch of bytes.
SURE_CUT = re.compile(rb"(?<=[!-~])(?= [!-~]|\n)")


class Facts:
    """What is known of distinct segments: counts, links end to end, and group strings (each group ends with ``;``)."""

    def __init__(self, parts: list[tuple]):
        self.ok, self.n_a, self.n_b, self.n_groups, self.sizes, self.links = (
            np.concatenate([*(p[c] for p in parts), np.empty(0, kind)])
            for c, kind in enumerate((bool, np.int64, np.int64, np.int64, np.int64, np.int64)))
        self.groups = [g for p in parts for g in p[6]]


class Aligner:
    """Both tokenizers. Many segments are encoded as one text, which is what their cuts allow, and aligned as arrays."""

    def __init__(self, spec_a: str, model_b: bytes, most: int = 1 << 16):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.most = Tokenizer.from_str(spec_a), most
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        letter = {c: i for i, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode("utf-8")
                        for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        shown = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.inner_a, self.final_a = shown(len(self.bytes_a), ","), shown(len(self.bytes_a), "|")
        self.inner_b, self.final_b = shown(len(pieces), ","), shown(len(pieces), ";")
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether no piece reaches over a cut; else a text is one segment.
        self.separable = not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)

    def cut(self, text: str) -> list[str]:
        return CUT.split(text) if self.separable else [text]

    def _together(self, segments: list[str]) -> tuple | None:
        """Facts of segments that follow each other as one text; None if a side's tokens do not spell it."""
        text = "".join(segments)
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        # B puts a space before what it is given: it stands for the text's own, or is its first token before a line feed
        b = np.array(self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:], dtype=np.int64)
        whole = text.encode("utf-8")
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b.tolist()]) != whole:
            return None
        ends = np.cumsum([len(s.encode("utf-8")) for s in segments])
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts, points = np.intersect1d(end_a, end_b), np.union1d(end_a, end_b)
        if len(segments) > 1 and not np.isin(ends, cuts, assume_unique=True).all():
            return None
        n = len(segments)
        per = lambda x: np.bincount(np.searchsorted(ends, x), minlength=n)
        # between two neighbouring token ends of either side exactly one pair of tokens overlaps
        links = a[np.searchsorted(end_a, points)] << 32 | b[np.searchsorted(end_b, points)]
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        words = np.concatenate([np.where(cuts[group_a] == end_a, self.final_a[a], self.inner_a[a]),
                                np.where(cuts[group_b] == end_b, self.final_b[b], self.inner_b[b])])
        words = words[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        n_a, n_b = per(end_a), per(end_b)
        to = np.cumsum(n_a + n_b).tolist()
        return np.ones(n, bool), n_a, n_b, per(cuts), per(points), links, ["".join(words[s:e]) for s, e in zip([0, *to], to, strict=False)]

    def _facts(self, segments: list[str]) -> list[tuple]:
        found = self._together(segments)
        if found:
            return [found]
        if len(segments) == 1:
            none = np.zeros(1, np.int64)
            return [(np.zeros(1, bool), none, none, none, none, none[:0], [""])]
        half = len(segments) // 2
        return self._facts(segments[:half]) + self._facts(segments[half:])

    def facts(self, segments: list[str]) -> Facts:
        """Facts of segments (each begins with a space or a line feed), some ``most`` characters at a time."""
        parts, some, size = [], [], 0
        for s in segments:
            some.append(s)
            size += len(s)
            if size >= self.most or s[-1].isspace():  # nothing is certain after a blank
                parts += self._facts(some)
                some, size = [], 0
        return Facts(parts + (self._facts(some) if some else []))


@lru_cache(maxsize=1)
def _aligner(spec_a: str, model_b: bytes) -> Aligner:
    return Aligner(spec_a, model_b)


class Numbers(dict):
    """Numbers distinct segments by first use."""

    def __missing__(self, segment: str) -> int:
        k = self[segment] = len(self)
        return k


def block_batch(number: int, id_type: pa.DataType, ids: list, copies: list[int], seqs: list[np.ndarray], digests: list[str],
                facts: Facts) -> pa.RecordBatch:
    """A row for each text, and last one with the block's dictionary of pairs; ``seqs`` number the facts' segments."""
    n, m = len(ids), len(facts.sizes)
    lengths = np.array([len(s) for s in seqs], dtype=np.int64)
    flat = np.concatenate([*seqs, np.empty(0, np.uint32)]).astype(np.int64)
    owner = np.repeat(np.arange(n), lengths)
    per = lambda x: np.bincount(owner, x[flat], n).astype(np.int64)
    sums = [per(x) for x in (facts.n_a, facts.n_b, facts.n_groups, facts.sizes)]
    pairs, place = np.unique(facts.links, return_inverse=True)
    used = np.bincount(flat, np.repeat(np.array(copies, dtype=np.int64), lengths), m)
    totals = np.bincount(place, np.repeat(used, facts.sizes), len(pairs)).astype(np.int64)
    some = lambda x: pa.array([x], pa.list_(pa.int64()))
    none = pa.nulls(n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n + 1, number)), pa.array([*ids, None], id_type), pa.array([*copies, 0], pa.int64()),
         *[pa.array([*s, 0], pa.int64()) for s in sums], pa.array([*digests, ""]),
         pa.array([*[s.astype(np.uint32).tobytes() for s in seqs], place.astype(np.uint32).tobytes()], pa.binary()),
         pa.concat_arrays([none, some(pairs)]), pa.concat_arrays([none, some(totals)]), pa.concat_arrays([none, some(facts.sizes)])],
        ["block", "id", "copies", "n_a", "n_b", "n_groups", "n_links", "digest", "seq", "pairs", "totals", "sizes"])


def digest(groups: str) -> str:
    return hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else ""


def texts_batch(aligner: Aligner, number: int, id_type: pa.DataType, ids: list, seqs: list[np.ndarray], at: Numbers) -> pa.RecordBatch:
    """A block of texts, given as numbers of their segments, which are emptied."""
    segments = list(at)
    at.clear()
    facts = aligner.facts(segments)
    del segments
    seqs = [s if facts.ok[s].all() else s[:0] for s in seqs]
    groups = facts.groups
    return block_batch(number, id_type, ids, [1] * len(ids), seqs, [digest("".join([groups[k] for k in s.tolist()])) for s in seqs], facts)


BLOCK_SCHEMA = ("block long, id {id}, copies long, n_a long, n_b long, n_groups long, n_links long, digest string, seq binary, "
                "pairs array<long>, totals array<long>, sizes array<long>")


def _short_blocks(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, kind = _aligner(*files.value), TaskContext.get().partitionId() << 32, None
        ids, seqs, at, size = [], [], Numbers(), 0
        for whole in batches:
            kind = whole.schema.field(0).type
            for begin in range(0, whole.num_rows, 512):
                b = whole.slice(begin, 512)
                for row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids.append(row_id)
                    cut = aligner.cut(" " + text) if text else []
                    seqs.append(np.fromiter(map(at.__getitem__, cut), dtype=np.uint32, count=len(cut)))
                    size += len(text or "")
                if size >= BLOCK or len(ids) >= 1 << 16:
                    yield texts_batch(aligner, number, kind, ids, seqs, at)
                    number, ids, seqs, at, size = number + 1, [], [], Numbers(), 0
        if ids:
            yield texts_batch(aligner, number, kind, ids, seqs, at)
    return run


FRAGMENT = ["cut", "head", "tail", "ok", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
FRAGMENT_SCHEMA = ("cut boolean, head binary, tail binary, ok boolean, n_a long, n_b long, n_groups long, groups string, "
                   "pairs array<long>, times array<long>")
FRAGMENT_TYPES = [pa.bool_(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                  pa.list_(pa.int64()), pa.list_(pa.int64())]
NOTHING = {"cut": False, "head": b"", "tail": b"", "ok": True, "n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "pairs": [], "times": []}


def closed(aligner: Aligner, stretch: bytes) -> dict:
    """Closed groups of a stretch of bytes between two cuts (or ends of the text)."""
    at = Numbers()
    seq = np.array([at[s] for s in aligner.cut(stretch.decode("utf-8", "replace")) if s], dtype=np.int64)
    f = aligner.facts(list(at))
    pairs, place = np.unique(f.links, return_inverse=True)
    times = np.bincount(place, np.repeat(np.bincount(seq, minlength=len(f.sizes)), f.sizes), len(pairs)).astype(np.int64)
    total = lambda x: int(x[seq].sum())
    return {"ok": bool(f.ok.all()), "n_a": total(f.n_a), "n_b": total(f.n_b), "n_groups": total(f.n_groups),
            "groups": "".join([f.groups[k] for k in seq.tolist()]), "pairs": pairs, "times": times}


def fragment(aligner: Aligner, data: bytes) -> dict:
    """Open prefix, closed groups and open suffix of a chunk of bytes."""
    cuts = [m.start() for m in SURE_CUT.finditer(data)] if aligner.separable else []
    if not cuts:
        return NOTHING | {"head": data}
    return closed(aligner, data[cuts[0]:cuts[-1]]) | {"cut": True, "head": data[:cuts[0]], "tail": data[cuts[-1]:]}


def merged(parts: list[dict]) -> dict:
    """Closed groups that follow each other."""
    pairs, place = np.unique(np.concatenate([np.asarray(p["pairs"], dtype=np.int64) for p in parts]), return_inverse=True)
    times = np.bincount(place, np.concatenate([np.asarray(p["times"], dtype=np.int64) for p in parts]), len(pairs)).astype(np.int64)
    return {"ok": all(p["ok"] for p in parts), "groups": "".join(p["groups"] for p in parts), "pairs": pairs,
            "times": times} | {k: sum(p[k] for p in parts) for k in ("n_a", "n_b", "n_groups")}


def compose(aligner: Aligner, parts: list[dict]) -> dict:
    """Neighbouring fragments as one: what lies between the cuts of two of them is closed."""
    out, done, open_end = dict(NOTHING), [], []
    for p in parts:
        open_end.append(p["head"])
        if p["cut"]:
            stretch = b"".join(open_end)
            if out["cut"]:
                done.append(closed(aligner, stretch))
            else:
                out |= {"cut": True, "head": stretch}
            done.append(p)
            open_end = [p["tail"]]
    if not out["cut"]:
        return out | {"head": b"".join(open_end)}
    return out | merged(done) | {"tail": b"".join(open_end)}


def finished(aligner: Aligner, f: dict) -> dict:
    """A whole text's fragment with both ends closed."""
    if not f["cut"]:
        return closed(aligner, f["head"])
    return merged([closed(aligner, f["head"]), f, closed(aligner, f["tail"])])


def _fragment_table(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([r[c] for r in rows], t) for c, t in zip(FRAGMENT, FRAGMENT_TYPES, strict=True)]


def _fragments(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [fragment(aligner, x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_fragment_table(found)], [*part.schema.names[:-1], *FRAGMENT])
    return run


def _composed(files, keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        out = compose(_aligner(*files.value), rows)
        return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in keys], pa.array([rows[0]["k"] // FAN], pa.int64()),
                                     *_fragment_table([out])], [*keys, "k", *FRAGMENT])
    return run


def _long_blocks(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(*files.value), (TaskContext.get().partitionId() << 32) + (1 << 62)
        for whole in batches:
            for at in range(whole.num_rows):  # a long text is a block of its own, and one segment of it
                r = whole.slice(at, 1).to_pylist()[0]
                f = finished(aligner, r)
                count = lambda x: np.array([x], dtype=np.int64)
                if f["ok"]:
                    links = np.repeat(np.asarray(f["pairs"], dtype=np.int64), f["times"])
                    facts = Facts([(count(1) > 0, count(f["n_a"]), count(f["n_b"]), count(f["n_groups"]), count(len(links)), links, [""])])
                else:
                    facts = Facts([])
                yield block_batch(number, whole.schema.field("id").type, [r["id"]], [r["copies"]],
                                  [np.arange(len(facts.sizes))], [digest(f["groups"]) if f["ok"] else ""], facts)
                number += 1
    return run


def _long_texts(rows: DataFrame, files, chunk: int) -> DataFrame:
    """Blocks of the texts above ``chunk`` bytes, by a tree of fragments."""
    data = F.concat(F.lit(" "), "body").cast("binary")
    count = F.ceil(F.octet_length(data) / chunk).cast("long")
    keys = ["id", "rk", "rk2", "chunks", "copies"]
    # equal rows are chunked once; the exchange deals the chunks of a text out to many tasks
    pieces = (rows.select("id", F.xxhash64("body").alias("rk"), F.hash("body").alias("rk2"), count.alias("chunks"), data.alias("data"))
              .select("id", "rk", "rk2", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k"), "data")
              .select("id", "rk", "rk2", "chunks", "k", F.substring("data", F.col("k").cast("int") * chunk + 1, F.lit(chunk)).alias("piece"))
              .groupBy("id", "rk", "rk2", "chunks", "k").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
              .select(*keys, "k", "piece"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields[:-1]) + ", " + FRAGMENT_SCHEMA
    level = write_shared(pieces.mapInArrow(_fragments(files), schema), "align-fragments")
    most = level.agg(F.max("chunks")).first()[0] or 1
    while most > 1:
        level = level.withColumn("up", F.floor(F.col("k") / FAN)).groupBy(*keys, "up").applyInArrow(_composed(files, keys), schema)
        most = -(-most // FAN)
    return level.mapInArrow(_long_blocks(files), BLOCK_SCHEMA.format(id=dict(rows.dtypes)["id"]))


def _scores(texts: pa.Table, counts: pa.Table) -> pa.Table:
    texts = texts.combine_chunks()
    is_key = np.asarray(texts.column("pairs").is_valid())
    key, docs = texts.filter(pa.array(is_key)), texts.filter(pa.array(~is_key))
    place = np.frombuffer(key.column("seq")[0].as_buffer(), dtype=np.uint32)
    n_pairs = len(key.column("pairs")[0].values)
    count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    at = counts.column("pos").to_numpy()
    count[at], best[at] = counts.column("links").to_numpy(), counts.column("is_best").to_numpy()
    sizes = key.column("sizes")[0].values.to_numpy()
    ends = np.cumsum(sizes)

    def per_segment(x):
        run_sum = np.concatenate([[0], np.cumsum(x[place])])
        return run_sum[ends] - run_sum[ends - sizes]
    by_count, by_best = per_segment(count), per_segment(best)
    seqs = [np.frombuffer(s.as_buffer(), dtype=np.uint32) for s in docs.column("seq")]
    keep = np.repeat(np.arange(len(seqs)), docs.column("copies").to_numpy())
    columns = [docs.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array([int(x[s].sum()) for s in seqs], pa.int64()) for x in (by_best, by_count)] + [docs.column("digest")]
    return pa.Table.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]).take(pa.array(keep))


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    A: byte-level BPE file, applied to a space and the text; B: piece model,
    which adds the space itself. Special tokens written in a text are plain text.
    ``n_best`` counts links whose id pair is linked most often, corpus-wide, of
    all pairs of its B id (ties included), ``count_sum`` adds up the pairs'
    counts. ``groups_sha256``: of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that the tokens of one side do not spell
    (B turns U+2581 into a space), have no tokens: zeros and an empty string.
    Very long texts: cut at ``chunk`` bytes into fragments for several tasks;
    their group string is gathered in one. Repeated rows and null ids are rows
    like others: each counts and is returned. Empty table: empty result. Only
    the two named columns are read, so other names cannot clash. Both files
    are read on the driver and broadcast (fixed sizes).
    """
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as fa, open(path_b, "rb") as fb:
        files = spark.sparkContext.broadcast((fa.read(), fb.read()))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    is_long = F.coalesce(F.octet_length("body") >= chunk, F.lit(False))
    schema = BLOCK_SCHEMA.format(id=dict(rows.dtypes)["id"])
    short = rows.where(~is_long).mapInArrow(_short_blocks(files), schema)
    blocks = write_shared(short.unionByName(_long_texts(rows.where(is_long), files, chunk)), "align-blocks")
    keys = blocks.where("pairs IS NOT NULL").select("block", "pairs", "totals")
    pair_totals = keys.select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).select("p.pairs", "p.totals")
    counts = pair_totals.groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("links"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    judged = counts.join(highest, b_id == F.col("b_id")).select("pair", "links", (F.col("links") == F.col("most")).cast("long").alias("is_best"))
    asked = (keys.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("pos", "pair")).join(judged, "pair")
             .select("asker", "pos", "links", "is_best"))
    id_type = dict(rows.dtypes)["id"]
    return blocks.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(
        _scores, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
