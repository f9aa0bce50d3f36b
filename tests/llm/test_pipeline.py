import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from patchwell.llm import language_id, pii
from patchwell.llm.queries import ORACLE_SQL
from patchwell.llm.scratch import crc


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language_id"](spark, docs, sf)
    assert told.columns == docs.columns and told.count() >= 0.98 * docs.count()
    one = stage["near_duplicates"](spark, told, sf)
    assert one.columns == docs.columns and 0 < one.count() < told.count()
    clean = stage["decontaminate"](spark, one, sf)
    assert clean.columns == docs.columns and clean.count() < one.count() and bench.count() > 0
    safe = stage["pii"](spark, clean, sf)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert safe.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert safe.filter(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.][a-z]")).count() == 0
    packed = stage["pack"](spark, safe, sf)
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, repeats, empty and long texts, columns named like an operator's own, and empty tables."""
    usual = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").filter("length(text) between 200 and 2000").limit(60).collect()]
    rows = [(i, t, "en", "s", len(t), 0.5, "x", 1) for i, t in enumerate(usual)]
    rows += [rows[0], rows[1], (None, usual[2] + " tail", None, None, None, None, None, None), (None, None, "en", "s", 0, 0.1, "x", 1), (100, "", "en", "s", 0, 0.1, "x", 1), (101, " \n", None, "s", 2, 0.1, "x", 1), (102, (" ".join(usual[3].split()[::-1]) + " ") * 400, "en", "s", 1, 0.1, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, component_id int").repartition(3)
    bench = [(1, " ".join(usual[5].split()[:30])), (2, None), (3, "")]
    for name, data in (("some", bench), ("none", [])):
        spark.createDataFrame(data, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language_id"](spark, docs, sf)
    assert told.columns == docs.columns
    kept = told.collect()
    assert not {r["doc_id"] for r in kept} & {100, 101} and len(kept) >= 55
    one = stage["near_duplicates"](spark, docs, sf)
    ids = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({i for i in ids if i is not None}) and {100, 101, 102} <= set(ids)
    clean = stage["decontaminate"](spark, docs, f"{tmp_path}/some")
    left = [r["doc_id"] for r in clean.collect()]
    assert clean.columns == docs.columns and 5 not in left and left.count(0) == 2 and left.count(None) == 2 and {100, 101} <= set(left)
    assert stage["decontaminate"](spark, docs, f"{tmp_path}/none").count() == docs.count()
    safe = stage["pii"](spark, docs, sf)
    assert safe.columns == docs.columns and safe.count() == docs.count() and safe.filter("text is null").count() == 1
    packed = stage["pack"](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert packed.filter("doc_id in (100, 101) and doc_tokens != 1").count() == 0
    for name, f in stage.items():
        got = f(spark, docs.limit(0), f"{tmp_path}/some")
        assert got.count() == 0 and (name == "pack" or got.columns == docs.columns)


def test_run_against_plain_steps(spark, sf, tmp_path):
    """The whole pipeline: after language ID, the documents that SQL keeps of near duplicates and then of benchmark windows, each packed with the ids that its redacted text has."""
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet").filter(F.pmod(crc("doc_id"), F.lit(4)) != 2).select("doc_id", "text", "lang"))
    language_id.accepted(spark.read.parquet(f"{sf}/documents.parquet"), model).write.parquet(f"{tmp_path}/told")
    con = duckdb.connect()
    con.execute(f"create table documents as select * from '{tmp_path}/told/*.parquet'")
    con.execute(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    con.execute(f"create table classes as {ORACLE_SQL['op4_ngram_join']}")
    con.execute("delete from documents where doc_id in (select doc_id from classes where n_shingles > 0 and component_id <> doc_id)")
    con.execute(f"create table marks as {ORACLE_SQL['op2_decontaminate']}")
    kept = dict(con.execute("select doc_id, text from documents where doc_id in (select doc_id from marks where not contaminated)").fetchall())
    assert 50 < len(kept) < 200
    field = pii.fit(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = {}
    for i, text in kept.items():
        base = pii.base_spans(text)
        safe = pii.redact_text(text, pii.joined(base + pii.added_spans(text, base, field)))
        want[i] = [*tok.encode(safe, add_special_tokens=False).ids, 1]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    ends = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == ends.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        ends[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : ends[r["doc_id"]]], "<u4").tobytes())
    assert ends == {i: len(x) for i, x in want.items()}
