import re

import corpus_pipeline
import numpy as np
from fixtures import DIR, contaminated, jaccard
from pyspark.sql import functions as F
from test_operators import packed_well

from gridwake.llm import packing, quality


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / str(k))))
        docs = kept[name][1]
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    rows = lambda df: [(r["doc_id"], r["text"], None, None) for r in df.collect()]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    before, after = kept["quality_classifier"]
    bad = {r["doc_id"] for r in quality.classify(before, spark.read.parquet(f"{DIR}/labels.parquet")).where("score < 0.3").collect()}
    assert bad and ids(after) == [i for i in ids(before) if i not in bad]

    before, after = kept["ngram_jaccard_join"]
    comp = jaccard(rows(before))[1]
    assert ids(after) == sorted(set(comp.values())) != ids(before)

    before, after = kept["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    gone = {i for i, _ in contaminated(rows(before), items)}
    assert gone and ids(after) == [i for i in ids(before) if i not in gone]

    before, after = kept["secret_scans"]
    assert ids(after) == ids(before)
    new = {r["doc_id"]: r for r in after.collect()}
    for i, text, *_ in rows(before):
        if re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", text):
            assert "[secret]" in new[i]["text"] and new[i]["n_chars"] == len(new[i]["text"])

    before, after = kept["best_fit_packing"]
    out = after.toPandas()
    packed_well(out)
    assert sorted(set(out["doc_id"])) == ids(before)
    assert out["sequence_id"].nunique() <= packing.lower_bound(np.array(out["length"])) + 1


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def tables(spark, path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, _key2 string, component long, live string, cut int, id long, w string, salt int"


def awkward(spark):
    good = "the quiet river runs past the old mill and the village sleeps under a grey autumn sky tonight"
    rows = [(1, good), (1, "another text under the same number entirely"), (2, None), (3, ""), (None, good), (None, None), (4, good), (5, "x " * 30_000), (6, "x " * 30_000), (7, "password = hunter22secret")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, "k", 9, "l", 2, 3, "w", 4) for i, t in rows], AWKWARD)


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    at = tables(spark, tmp_path, docs, labels, bench)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()))
    every = sorted([(False, i) for i in (1, 1, 2, 3, 4, 5, 6, 7)] + [(True, 0)] * 2)
    one = [x for x in dict.fromkeys(every) if x not in ((False, 4), (False, 6))] + [(True, 0)]
    assert kept == [every, sorted(one), sorted(one), sorted(one)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).toPandas()
    assert len(pieces[pieces["doc_id"] == 5]) == 8 and set(pieces["doc_id"].dropna()) == {1, 2, 3, 5, 7}


def test_rows_of_one_doc_id_are_judged_each(spark, monkeypatch):
    docs = awkward(spark).where("doc_id = 1")
    verdicts = docs.select("doc_id", quality.text_key().alias("key"), F.when(F.col("text").startswith("another"), 0).otherwise(1).alias("predicted"))
    monkeypatch.setattr(quality, "judged", lambda *a, **k: verdicts)
    assert [r["text"][:9] for r in quality.accepted(docs, None).collect()] == ["the quiet"]


def test_empty_pipeline(spark, tmp_path):
    none = awkward(spark).where("false").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, none, labels, bench)).count() == 0
