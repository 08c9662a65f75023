"""Readers S1-S9 and sinks K1-K4 on small files written to a scratch folder."""

import json
import os
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flockscope.operators import counts, frames
from flockscope.plans import lists
from flockscope.sources import readers, sinks
from flockscope.sources.keywords import keyword_list, read_keywords


def _scratch():
    return tempfile.mkdtemp(prefix="flockscope-src-")


def _write(path, text, mode="w"):
    with open(path, mode) as fh:
        fh.write(text)
    return path


def test_read_tweets_nested(spark):
    d = _scratch()
    rows = [
        {"id_str": "1", "created_at": "Wed Nov 04 01:02:03 +0000 2020", "text": "the #blm march",
         "user": {"id": 7, "id_str": "7"}},
        {"id_str": "2", "created_at": "Wed Nov 04 05:00:00 +0000 2020", "text": None,
         "extended_tweet": {"full_text": "long blm text"}, "user": {"id": 7, "id_str": "7"},
         "retweeted_status": {"id_str": "9", "text": "rt about cnn"}},
        {"id_str": "3", "created_at": "Wed Nov 04 06:00:00 +0000 2020", "text": "reply",
         "user": {"id": 8, "id_str": "8"}, "in_reply_to_user_id": 7},
        {"id_str": "4", "created_at": "bad date", "text": "x", "user": {"id": 9, "id_str": "9"}},
    ]
    _write(os.path.join(d, "t.json"), "\n".join(json.dumps(r) for r in rows))
    tw = readers.read_tweets(spark, d)
    infl = spark.createDataFrame([(7, 1), (8, 2)], "uid long, grp int")
    pats = {"blm": r"\b(blm)\b", "pol": r"\b(cnn)\b"}
    out = sorted(tuple(r) for r in counts.daily_keyword_counts(tw, infl, pats).collect())
    assert out == [("2020-11-04 00:00:00", 1, 7, False, "blm", 1), ("2020-11-04 00:00:00", 1, 7, False, "total", 1),
                   ("2020-11-04 00:00:00", 1, 7, True, "pol", 1), ("2020-11-04 00:00:00", 1, 7, True, "total", 1)]


def test_csv_readers(spark):
    d = _scratch()
    infl = _write(os.path.join(d, "infl.csv"), "uid grp\n10 1\n11 2\nbad 3\n")
    edges = _write(os.path.join(d, "adj.csv"), "source,target,attr\n1,10,1\n2,11,1\n")
    i = readers.read_influencers(spark, infl)
    assert sorted(tuple(r) for r in i.collect()) == [(10, 1), (11, 2)]
    assert dict(i.dtypes) == {"uid": "bigint", "grp": "int"}
    e = readers.read_edges(spark, edges)
    assert sorted((r.source, r.target) for r in e.collect()) == [(1, 10), (2, 11)]


def test_read_keywords_file(spark):
    d = _scratch()
    path = _write(os.path.join(d, "kw.tsv"), "\n".join(lists.BLM_LINES + ["", '*role="x"']) + "\n")
    kl = read_keywords(spark, path, "blm")
    assert kl.fragments == lists.blm().fragments
    assert kl.rejected == ['*role="x"']


def test_read_mm_edges(spark):
    d = _scratch()
    mtx = _write(os.path.join(d, "m.mtx"), "%%MatrixMarket matrix coordinate pattern general\n% c\n3 2 3\n1 1\n3 2\n2 2\n")
    rows = _write(os.path.join(d, "rows.txt"), "100\n200\n300\n")
    cols = _write(os.path.join(d, "cols.txt"), "7\n8\n")
    e = readers.read_mm_edges(spark, mtx, rows, cols)
    assert sorted((r.source, r.target) for r in e.collect()) == [(100, 7), (200, 8), (300, 8)]


def test_read_profiles_nul(spark):
    d = _scratch()
    fields = ["1", "na\x00me", "sn"] + [str(i) for i in range(16)]
    with open(os.path.join(d, "p.tsv"), "wb") as fh:
        fh.write(("\t".join(fields) + "\n").encode())
    p = readers.read_profiles(spark, d).first()
    assert p.uid == "1" and p.name == "na me" and p.verified == "15"


def test_read_assignments_k_from_name(spark):
    d = _scratch()
    _write(os.path.join(d, "y_50.csv"), "id,grp\n1,3\n2,4\n")
    _write(os.path.join(d, "y_75.csv"), "id,grp\n1,5\n")
    a = readers.read_assignments(spark, d)
    assert sorted(tuple(r) for r in a.select("id", "grp", "k").collect()) == [(1, 3, 50), (1, 5, 75), (2, 4, 50)]
    assert sinks.select_k(a, 75).count() == 1


def test_sinks_roundtrip(spark):
    d = _scratch()
    df = spark.createDataFrame([("2020-01-01 00:00:00", 1, 5, True, "pol", 3)],
                               "date string, grp int, userid long, is_rt boolean, regex_type string, count long")
    sinks.write_counts(df, os.path.join(d, "counts"))
    back = spark.read.parquet(os.path.join(d, "counts"))
    assert back.where(F.col("regex_type") == "pol").count() == 1
    sinks.write_csv(df, os.path.join(d, "csv"), sep=" ", single_file=True)
    assert len([f for f in os.listdir(os.path.join(d, "csv")) if f.endswith(".csv")]) == 1
    lo = spark.createDataFrame([(1, 2, "y", [0.1, 0.2])], "id long, k int, side string, loadings array<double>")
    sinks.save_factors(lo, os.path.join(d, "fac"))
    assert sinks.load_factors(spark, os.path.join(d, "fac"), k=2, side="y").count() == 1


def test_sample_rows_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    a = [r.id for r in frames.sample_rows(df, 50, seed=3).collect()]
    b = [r.id for r in frames.sample_rows(df.repartition(7), 50, seed=3).collect()]
    assert a == b and len(set(a)) == 50


@pytest.fixture
def small_splits(spark):
    """Files of some kilobytes are read in many splits, several to a task and not in file order."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("700", "1", "40"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_line_numbers_of_many_splits(spark, small_splits):
    d = _scratch()
    lines = [f"line {i} " + "x" * (i * 7 % 90) for i in range(900)] + ["", "same", "same", ""]
    for name, part in (("a.txt", lines[:11]), ("b.txt", lines[11:700]), ("c.txt", lines[700:])):
        _write(os.path.join(d, name), "\n".join(part) + "\n")
    got = readers.numbered_lines(spark, d)
    assert got.rdd.getNumPartitions() > 1
    assert [r.value for r in sorted(got.collect(), key=lambda r: r.pos)] == lines
    assert sorted(r.pos for r in got.collect()) == list(range(1, len(lines) + 1))


def test_mm_edges_of_many_splits_with_wrong_lines(spark, small_splits):
    d = _scratch()
    entries = [(i * 37 % 800 + 1, i * 53 % 600 + 1) for i in range(2000)]
    wrong = ["7", "x 3", "801 1", "1 601", "5 17"]  # line 17 of the columns holds no number
    body = [f"{i} {j}" for i, j in entries]
    body[100:100] = wrong + ["", "% note"]
    mtx = _write(os.path.join(d, "m.mtx"), "%%MatrixMarket matrix coordinate pattern general\n%\n800 600 2000\n" + "\n".join(body) + "\n")
    rows = _write(os.path.join(d, "rows.txt"), "".join(f"{10_000 + i}\n" for i in range(1, 801)))
    cols = _write(os.path.join(d, "cols.txt"), "".join("none\n" if j == 17 else f" {20_000 + j}\n" for j in range(1, 601)))
    seen = Observation()
    got = sorted((r.source, r.target) for r in readers.read_mm_edges(spark, mtx, rows, cols, seen).collect())
    want = [(10_000 + i, 20_000 + j) for i, j in entries if j != 17]
    assert got == sorted(want)
    assert seen.get == {"n_rows": 2005, "n_rejected": 2005 - len(want)}


def test_rejects_are_counted_by_the_scan(spark):
    d = _scratch()
    tweets = _write(os.path.join(d, "t.json"), '{"id_str": "1", "text": "a"}\n{"id_str": \nnot json\n{"id_str": "2"}\n')
    infl = _write(os.path.join(d, "infl.csv"), "uid grp\n10 1\n11 x\nbad 3\n")
    edges = _write(os.path.join(d, "adj.csv"), "source,target,attr\n1,10,1\n2,,1\n,3,1\n4,99999999999999999999,1\n")
    for read, path, want in ((readers.read_tweets, tweets, (4, 2)), (readers.read_influencers, infl, (3, 1)), (readers.read_edges, edges, (4, 3))):
        seen = Observation()
        kept = read(spark, path, metrics=seen).collect()
        assert (seen.get["n_rows"], seen.get["n_rejected"]) == want and len(kept) == want[0] - want[1]
    assert readers.malformed_edges(spark, edges).count() == 3 and readers.malformed_influencers(spark, infl).count() == 1
    assert [tuple(r) for r in readers.read_influencers(spark, infl).orderBy("uid").collect()] == [(10, 1), (11, None)]
    empty = _write(os.path.join(d, "none.csv"), "source,target,attr\n")
    seen = Observation()
    assert readers.read_edges(spark, empty, seen).collect() == [] and seen.get["n_rejected"] == 0


def test_assignments_k_from_folder(spark):
    d = os.path.join(_scratch(), "y_9")
    for k in (5, 60):
        sinks.write_csv(spark.createDataFrame([(1, k)], "id long, grp int"), os.path.join(d, f"y_{k}.csv"))
    assert sorted(tuple(r) for r in readers.read_assignments(spark, os.path.join(d, "y_*.csv")).collect()) == [(1, 5, 5), (1, 60, 60)]


def test_the_engine_that_runs_a_pattern_judges_lists_from_files(spark):
    only_java, only_python = r"a\p{L}++", r"(?P<x>a)"
    assert keyword_list("x", [only_java, only_python]).fragments == [only_python]  # with a session or without
    path = _write(os.path.join(_scratch(), "kw.tsv"), f"{only_java}\n{only_python}\n")
    assert read_keywords(spark, path, "x").fragments == [only_java]
