import os

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm import linededup, toxicity
from tests.llm.test_simhash import brute_similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        out.append((before, docs))
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(toxicity.pa.array([r["text"] for r in before.orderBy("doc_id").collect()]))
    ids = [r["doc_id"] for r in before.orderBy("doc_id").collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == [i for i, s in zip(ids, scores) if s < 0.5]


def test_lines(stages):
    before, after = stages[1]
    kept = {r["doc_id"]: r["kept_text"] for r in linededup.report(before).collect()}
    got = {r["doc_id"]: r for r in after.collect()}
    gone = set(kept) - set(got)
    assert all(not kept[i].split() for i in gone)
    assert all(r["text"] == kept[i] and r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    groups = brute_similar([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(groups.values()))


def test_mix_repeats_whole_documents(stages):
    before, after = stages[3]
    texts, counts = {r["doc_id"]: r["text"] for r in before.collect()}, {}
    for r in after.collect():
        assert texts[r["doc_id"]] == r["text"]
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 2
    words = lambda t: len((t or "").split())
    taken = sum(words(texts[i]) * n for i, n in counts.items())
    assert taken == pytest.approx(1.5 * sum(map(words, texts.values())), rel=0.1)


def test_packed(stages):
    before, after = stages[4]
    assert after.where("piece = 0").count() == before.count()


def test_run_and_empty(spark, tmp_path, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][1].count()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (None, "q r s t u", "en", None, 9), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3]
    assert corpus_pipeline.mix_sources(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.drop_lines(spark, docs, SF).count() == 5


CLASHING = "gone kept near split document k1 _gone _kept _split _document _k1 _near _lines _removed id times copy _id _times _copy _h_doc_id _l_doc_id _heavy _light _scatter uid start words size rank bucket key label line place h1 h2 n component_id first_id g u v".split()


def test_clashing_names_and_long_texts(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"v{x}" for x in rng.integers(0, 50_000, 120_000))
    rows = [(i, f"same line of six words here\nown line number {i} of this text\n{'twice ' * 6}", "en", "ab"[i % 2], 9) for i in range(12)]
    rows += [(20, long, "en", "a", len(long)), (21, long + " more", "en", "b", len(long) + 5), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == CLASHING
        docs = docs.cache()
        got = docs.collect()
        assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in got)
        seen[name] = sorted({r["doc_id"] for r in got if r["doc_id"] is not None})
    assert seen["toxicity"] == [*range(12), 20, 21]
    assert 20 in seen["simhash_near_dedup"] and 21 not in seen["simhash_near_dedup"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id = 20").count() > 100


def test_documents_without_labels(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_entry_names():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(root, "lodestone")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as file:
                        assert "llm" not in file.read()
