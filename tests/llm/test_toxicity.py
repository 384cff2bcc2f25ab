import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 500
    assert (rows.predicted == rows.toxic).mean() > 0.96
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == (rows.score >= 0.5)).all()
    caught = rows[rows.toxic == 1]
    assert (caught.predicted == 1).mean() > 0.8


def test_held_out_labels_are_not_learned(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"] for r in toxicity.training_rows(docs, labels).select("doc_id").collect()}
    assert kept and all(zlib.crc32(str(i).encode()) % 5 for i in kept)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.report(docs, x).orderBy("doc_id", "score").toPandas() for x in (labels, turned))
    assert (a.score == b.score).all()


def brute_ratio(words, word):
    """The ratio of one word by the textbook formulas, over words {word: (toxic, ordinary)}."""
    pad = lambda w: "\x02" * 4 + w + "\x03"
    grams = defaultdict(lambda: [0, 0])
    for w, n in words.items():
        for i in range(len(w) + 1):
            for c in (0, 1):
                grams[pad(w)[i : i + 5]][c] += n[c]
    levels = {4: Counter(g[1:] for g in grams)}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def shared(g):
        if len(g) == 1:
            return levels[1][g] / sum(levels[1].values())
        same = {x: c for x, c in levels[len(g)].items() if x[:-1] == g[:-1]}
        n = sum(same.values())
        return (max(same[g] - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / n

    total = 0.0
    for i in range(len(word) + 1):
        g, p = pad(word)[i : i + 5], []
        for c in (0, 1):
            same = {x: n[c] for x, n in grams.items() if x[:-1] == g[:-1]}
            n, t = sum(same.values()), sum(v > 0 for v in same.values())
            backoff = 0.75 * t / n if n else 1.0
            p.append((max(same.get(g, 0) - 0.75, 0) / n if n else 0.0) + backoff * (shared(g[1:]) if g in grams else 1.0))
        total += math.log(p[0] / p[1])
    return total


def test_ratios_equal_brute_force(spark):
    words = {"bad": (9, 1), "bade": (3, 0), "good": (1, 20), "goods": (0, 6), "dog": (2, 9)}
    frame = spark.createDataFrame([(w, *n) for w, n in words.items()], "word string, toxic long, ordinary long")
    model = toxicity.Model(*[toxicity.np.full(2**toxicity.BITS, toxicity.np.nan, toxicity.np.float32) for _ in range(2)])
    for table, found in zip((model.seen, model.unseen), toxicity.ratios(toxicity.gram_counts(frame))):
        for r in found.collect():
            table[r["b"]] = r["r"]
    asked = [*words, "badly", "zzz", "doge"]
    for word, got in zip(asked, model.word_ratios(asked)):
        assert got == pytest.approx(brute_ratio(words, word), abs=1e-4)


def test_cases(spark):
    docs = spark.createDataFrame([(i, "you vile fool of it" if i % 2 else "the calm sea of it", "x", 1) for i in range(60)] + [(None, None, "x", 1), (99, "", "x", 1), (99, "", "x", 1)], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert len({r["score"] for r in got if r["doc_id"] in (None, 99)}) == 1
    assert all(r["score"] == 0 for r in toxicity.report(docs, labels.where("toxic = 0")).collect())
    assert toxicity.report(docs.limit(0), labels).count() == 0
    assert toxicity.report(docs, labels.limit(0)).count() == 63


def test_grams_of_one_bucket_are_told_apart(spark):
    def buckets(word):
        for i in range(len(word) + 1):
            h = 0
            for c in ("\x02" * 4 + word + "\x03")[i : i + 5]:
                h = (h * 1000003 + ord(c)) % (2**31 - 1)
            yield h % 2**20

    docs = [(i, "vile fool" if i % 2 else "calm sea") for i in range(60)]
    words = Counter((w, i % 2) for i, t in docs if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3) for w in t.split())
    words = {w: (words[w, 1], words[w, 0]) for w, _ in words}
    taken = {b for w in words for b in buckets(w)}
    letters = "abcdefghijklmnopqrstuvwxyz"
    inner = (f"q{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters)
    asked = [w for w in inner if any(b in taken for b in list(buckets(w))[2:])][:3]  # unseen grams in the buckets of seen ones
    assert asked
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    for word, got in zip([*words, *asked], model.word_ratios([*words, *asked])):
        assert got == pytest.approx(brute_ratio(words, word), abs=1e-4)
