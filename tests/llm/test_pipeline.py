"""The five stages on the smallest given tables, against plain Python."""

import hashlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flockscope.llm.common import read_table
from tests.conftest import SF0001
from tests.llm.test_dedup import close_groups, cut_lines, reference_fingerprint
from tests.llm.test_quality_and_secrets import base


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    docs = read_table(spark, SF0001, "documents").withColumnRenamed("lang", "kept")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF0001)
        rows = out.collect()
        after = tables[name] = {r.doc_id: r for r in rows}
        assert len(rows) == len(after) and set(after) <= set(before)
        if name == "quality_rules":
            assert not any(base(r.text)[-1] for r in after.values())
            gone = [r for i, r in before.items() if i not in after and not base(r.text)[-1]]
            good = {r.doc_id for r in read_table(spark, SF0001, "labels").where("quality = 1").collect()}
            assert not good & {r.doc_id for r in gone}
        elif name == "line_dedup":
            want = {i: t for i, _, n, t in cut_lines(sorted((i, r.text) for i, r in before.items()), 2, 12) if not n or t.split()}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "simhash_near_dedup":
            fps = {i: reference_fingerprint(r.text) for i, r in before.items()}
            root = close_groups(fps.values(), 2)
            first = {}
            for i in sorted(fps):
                first.setdefault(root[fps[i]], i)
            assert set(after) == set(first.values())
        elif name == "benchmark_decontamination":
            items = [r.text for r in read_table(spark, SF0001, "benchmark").collect()]
            assert set(after) == {i for i, r in before.items() if not any(x in r.text for x in items)}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for i, r in before.items():
                ids = library.encode(r.text, add_special_tokens=False).ids
                shown = library.decode(ids, skip_special_tokens=False)
                assert tuple(after[i]) == (i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                                           hashlib.sha256(shown.encode()).hexdigest())
            continue
        assert out.columns == columns
        docs = spark.createDataFrame(rows, out.schema)
    assert len(tables["bpe_encoding"]) > 50


def test_run_equals_the_stages_on_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read_table(spark, SF0001, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
