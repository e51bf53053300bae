import hashlib
import importlib

import duckdb

from tests.llm.test_lines_leaks import brute_lines
from tests.llm.test_near_dups_language import brute
from tests.llm.test_near_dups_language import brute as brute_at
from tidewatch.llm import bpe, decontaminate, line_dedup
from tidewatch.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"


def test_run_is_the_stages_by_brute_force(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    rows = [(k, t) for k, t, _ in brute_lines([(r.doc_id, r.text) for r in kept.collect()], line_dedup.WORDS)]
    component = {k: v[1] for k, v in brute(rows).items()}
    rows = [r for r in rows if component[r[0]] == r[0]]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    bad = {r[0] for r in con.execute(decontaminate.OP8_SQL).fetchall()}
    assert bad
    library = bpe.WordEncoder(tokenizer_path("word_bpe_49k.json")).library
    want = set()
    for k, t in rows:
        if k not in bad:
            ids = library.encode(t, add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.add((k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in pipeline.run(spark, SF).collect()} == want


def test_stages_take_hard_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the words of a text", None, None, None), (4, "the " * 30_000, "en", "s", 1), (4, "the " * 30_000, "en", "s", 1), (5, "1 2 3", "fr", None, 5)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in pipeline.STAGES:
            now = stage(spark, now, SF)
            assert name == "bpe" or now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), now.schema)
    assert now.count() == 0


def test_near_stage_links_from_four_fifths_on(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = []
    for i in range(60):  # 104 words, 100 shingles; replacing the last n words leaves 100 - n of 100 + n
        words = [f"w{i}x{j}" for j in range(104)]
        changed = (9, 11, 12)[i % 3]  # similarity 0.835, 0.802 and 0.786
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-changed] + [f"n{i}x{j}" for j in range(changed)]))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], schema)
    want = {k for k, v in brute(rows, 80).items() if v[1] == k}
    assert len(want) == 80 and len([k for k, v in brute(rows, 85).items() if v[1] == k]) == 120
    assert {r.doc_id for r in pipeline.near_stage(spark, docs, SF).collect()} == want


def test_run_is_the_stages_by_brute_force_at_their_threshold(spark, monkeypatch):
    percent = importlib.import_module("corpus_pipeline").NEAR_PERCENT
    monkeypatch.setitem(globals(), "brute", lambda rows: brute_at(rows, percent))
    test_run_is_the_stages_by_brute_force(spark)
