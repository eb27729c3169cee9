from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import pyarrow as pa
from tessella.llm import count_rtree, mixing, ngram_join, toxicity
from tessella.llm.count_rtree import Rule
from test_ngram_join import brute


def write(spark, path, corpus):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(corpus, schema)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0, int("scum" in (r[1] or ""))) for r in corpus if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_each_stage_on_its_own_input(spark, tmp_path, corpus):
    toxic = [(1000 + i, f"scum {t} scum", "en", "s1", 9) for i, (_, t, *_) in enumerate(corpus[:40])]
    write(spark, tmp_path, corpus + toxic)
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{len(seen)}"))
        docs = seen[name][1]
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns

    before, after = seen["toxicity"]
    ids = {r.doc_id for r in after.collect()}
    assert not ids & {r[0] for r in toxic}
    assert {r[0] for r in corpus} <= ids  # clean documents stay

    before, after = seen["exact dedup"]
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in before.collect():
        least.setdefault(normal(r.text), set()).add(r.doc_id)
    best = lambda s: min((x for x in s if x is not None), default=None)
    assert sorted(map(str, (r.doc_id for r in after.collect()))) == sorted(str(best(s)) for s in least.values())

    before, after = seen["n-gram Jaccard join"]
    rows = [tuple(r) for r in before.collect()]
    want = {i for none, i, _, c in brute(rows, Rule(5, 80)) if not none and c == i}
    assert {r.doc_id for r in after.collect() if r.doc_id is not None} == want

    before, after = seen["mixing sources to target weights"]
    taken = sum(r.taken for r in mixing.mix(before).collect())
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after.collect()) == taken

    before, after = seen["BPE encoding and decoding"]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), digest(r.text)) for r in before.collect()) == sorted((str(r.doc_id), r.decoded_sha256) for r in after.collect())

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, after.collect()))


def test_empty_documents(spark, tmp_path, corpus):
    write(spark, tmp_path, corpus[:0])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_toxicity_stage_learns_from_every_labelled_row(spark, corpus, tmp_path, monkeypatch):
    toxic = [(1000 + i, f"scum {t} scum", "en", "s1", 9) for i, (_, t, *_) in enumerate(corpus[:40])]
    write(spark, tmp_path, corpus + toxic)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for most in (5000, 1):
        monkeypatch.setattr(corpus_pipeline.toxicity, "MAX_TOXIC", most)
        monkeypatch.setattr(corpus_pipeline.toxicity, "MAX_CLEAN", most)
        kept.append(sorted(str(r.doc_id) for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()))
    assert kept[0] == kept[1] and len(kept[0]) < docs.count()


def test_the_toxicity_stage_starts_no_python_workers_of_another_kind(spark, corpus, tmp_path, monkeypatch):
    toxic = [(1000 + i, f"scum {t} scum", "en", "s1", 9) for i, (_, t, *_) in enumerate(corpus[:40])]
    write(spark, tmp_path, corpus + toxic)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def refused(*_):
        raise AssertionError("rows of a list go through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() < docs.count()


def test_a_worker_remembers_the_words_of_one_operator():
    rows = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["some words of a text"])], names=["doc_id", "text_key", "_text"])]
    toxicity.buckets("some words of a text")
    assert toxicity._words
    assert sum(b.num_rows for b in ngram_join._scan(Rule(5, 80), 0, 16)(iter(rows)))
    assert not toxicity._words and count_rtree._words
    list(ngram_join._fetch(Rule(5, 80), 0, True)(iter([])))
    assert count_rtree._words  # from task to task of one operator they stay
