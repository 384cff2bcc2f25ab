"""Toxicity from class-conditional Kneser-Ney models of the characters of words.

Words of labelled training documents are counted by class over the whole corpus, and so are their character 5-grams.
The two classes' 5-gram models back off to one shared model of continuation counts (in how many different contexts a
shorter gram occurs, whatever the class), so a rare expression is judged by its stem. A word's log-likelihood ratio is
the sum over its characters; a document's are normalised by length, over the whole text, over its most toxic stretch of
three words and over the most toxic fiftieth of its words. A logistic curve fitted to training documents that the counts left out turns them into a score.

Counts stay in Spark; the ratios of the distinct 5-grams and contexts, 12 bytes each, go to the tasks. Each has a key
of 62 bits, so grams don't share an entry, and one that was not counted backs off.

Defined cases: null and empty texts have no words and get the score of a ratio of zero; null labels are no labels; of
several labels of a doc_id the highest counts; without both classes in training every score is 0; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, if_small, release, stored

ORDER, DISCOUNT, BITS, STRETCH = 5, 0.75, 20, 3
#: A document's share of words whose mean is its third measure; three words at least.
FIFTIETH, MEASURES = 50, 3
#: Labelled rows that the logistic curve (four numbers) is fitted to, by a hash of doc_id: this many at most, but for chance.
CURVE_ROWS = 20_000
_FIRST, _LAST = "\x02", "\x03"
#: Rolling hashes of a gram: h * multiplier + code point, modulo the prime 2^31 - 1; the same in SQL and NumPy. The first alone gives a bucket, both the key.
_MUL, _MUL2, _MOD = 1000003, 48271, 2**31 - 1


def word_counts(labelled: DataFrame) -> DataFrame:
    """word, toxic, ordinary: how often each word stands in texts of either class. Partial sums precede the shuffle."""
    words = labelled.select("toxic", F.explode(F.split(F.lower("text"), GAP)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))


def gram_counts(words: DataFrame) -> DataFrame:
    """g, toxic, ordinary for the 5-grams of padded words."""
    padded = F.concat(F.lit(_FIRST * (ORDER - 1)), F.col("word"), F.lit(_LAST))
    grams = words.select("toxic", "ordinary", F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER}}}))"), F.lit(1))).alias("g"))
    return grams.groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _shared(grams: DataFrame) -> DataFrame:
    """g, p: the shared model's probability of each (ORDER-1)-gram's last character, by interpolated continuation counts. Each level is stored once."""
    longer, levels = grams, {}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = longer = stored(longer.groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")), "toxic-level")
    total = levels[1].agg(F.sum("c").alias("n"))
    p = levels[1].join(F.broadcast(total)).select("g", (F.col("c") / F.col("n")).alias("p"))
    for k in range(2, ORDER):
        now = levels[k].withColumn("x", F.substring("g", 1, k - 1)).withColumn("s", F.substring("g", 2, k - 1))
        context = now.groupBy("x").agg(F.sum("c").alias("n"), F.count("*").alias("t"))
        now = now.join(context, "x").join(p.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        p = now.select("g", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("t") * F.col("q")) / F.col("n")).alias("p"))
    return p


def _hash(gram: Column, n: int, mul: int = _MUL) -> Column:
    h = F.lit(0).cast("long")
    for i in range(n):
        h = (h * mul + F.ascii(F.substring(gram, i + 1, 1))) % _MOD
    return h


def _key(gram: Column, n: int) -> Column:
    return _hash(gram, n) * 2**31 + _hash(gram, n, _MUL2)


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seen, unseen): log-likelihood ratios r by key k of seen 5-grams, and of a context's unseen 5-grams; b is the key's bucket.

    Of an unseen gram the shared probability cancels, and the ratio is that of the two classes' backoff weights.
    """
    grams = grams.withColumn("x", F.substring("g", 1, ORDER - 1)).withColumn("s", F.substring("g", 2, ORDER - 1))
    classes = ("toxic", "ordinary")
    context = grams.groupBy("x").agg(*[F.sum(c).alias(f"n_{c}") for c in classes], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in classes])
    context = stored(context, "toxic-contexts")
    shared = _shared(grams).select(F.col("g").alias("s"), "p")
    backoff = {c: F.when(F.col(f"n_{c}") > 0, DISCOUNT * F.col(f"t_{c}") / F.col(f"n_{c}")).otherwise(F.lit(1.0)) for c in classes}
    chance = {c: F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(F.lit(0.0)) + backoff[c] * F.col("p") for c in classes}
    found = grams.join(context, "x").join(shared, "s")
    seen = found.select(_key(F.col("g"), ORDER).alias("k"), F.ln(chance["toxic"] / chance["ordinary"]).alias("r"))
    unseen = context.select(_key(F.col("x"), ORDER - 1).alias("k"), F.ln(backoff["toxic"] / backoff["ordinary"]).alias("r"))
    return tuple(t.select("k", (F.shiftright("k", 31) % 2**BITS).alias("b"), "r") for t in (seen, unseen))


def _found(table: np.ndarray, keys: np.ndarray | None, asked: np.ndarray) -> np.ndarray:
    """The entries of the asked keys, NaN where there are none. Without keys each bucket holds the gram asked for."""
    if keys is None:
        return table[(asked >> 31) % 2**BITS]
    if not len(keys):
        return np.full(len(asked), np.nan, np.float32)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, table[at], np.float32(np.nan))


@dataclass
class Model:
    """Tables with their sorted keys, and the curve: bias and the weights of the three measures."""

    seen: np.ndarray
    unseen: np.ndarray
    curve: tuple[float, ...] | None = None
    seen_keys: np.ndarray | None = None
    unseen_keys: np.ndarray | None = None

    def word_ratios(self, words: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(f"{_FIRST * (ORDER - 1)}{w}{_LAST}" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        h, h2 = (np.zeros(max(len(codes) - ORDER + 1, 0), np.int64) for _ in range(2))
        for i in range(ORDER):
            c = codes[i : len(codes) - ORDER + 1 + i]
            h, h2 = (h * _MUL + c) % _MOD, (h2 * _MUL2 + c) % _MOD
            if i == ORDER - 2:
                context = h << 31 | h2
        # Grams that reach into the next word are those that begin in its padding's first places.
        ends = np.cumsum(sizes + ORDER - 1)
        own = np.arange(sizes.sum()) + np.repeat((ends - sizes - ORDER + 1) - (np.cumsum(sizes) - sizes), sizes)
        r = _found(self.seen, self.seen_keys, (h << 31 | h2)[own])
        lacking = np.isnan(r)
        r[lacking] = _found(self.unseen, self.unseen_keys, context[own][lacking])
        return np.add.reduceat(np.nan_to_num(r, nan=0.0).astype(np.float64), np.cumsum(sizes) - sizes)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Rows of (mean ratio of a word, the highest mean over STRETCH words in a row, the mean of the highest fiftieth)."""
        lists = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        found = np.zeros((len(lists), MEASURES))
        if not sizes.sum():
            return found
        codes, words = pd.factorize(np.fromiter((w for x in lists for w in x), dtype=object, count=sizes.sum()))
        ratios_ = self.word_ratios([w.decode("utf-8", "surrogatepass") for w in words])[codes]
        for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
            if n:
                r, k, m = ratios_[a : a + n], min(n, STRETCH), min(n, max(3, n // FIFTIETH + 1))
                s = np.concatenate(([0.0], np.cumsum(r)))
                found[i] = s[-1] / n, (s[k:] - s[:-k]).max() / k, np.partition(r, n - m)[n - m :].mean()
        return found

    def features_of(self, texts: pa.Array, some: int = 250) -> np.ndarray:
        """The same for a column of texts, a few at a time."""
        return np.concatenate([np.zeros((0, MEASURES)), *[self.features(texts[i : i + some].to_pylist()) for i in range(0, len(texts), some)]])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        z = self.curve[0] + self.features_of(texts) @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a slight ridge; inputs scaled."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a, w = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(1 + x.shape[1])
    ridge = np.diag([1e-6, *[1e-3] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(w[1:] / scale).tolist())


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, fold for labelled documents outside the held-out fold (crc32 of the doc_id's text, modulo 5, is 0)."""
    toxic = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    kept = docs.select("doc_id", "text").where("text is not null").join(if_small(toxic), "doc_id")
    return kept.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).where("fold <> 0")


def fit(docs: DataFrame, labels: DataFrame, *, curve_rows: int = CURVE_ROWS) -> Model:
    """Counts from all of folds 1 to 3, curve from about curve_rows of fold 4 at most. Both use no column but the text."""
    rows = training_rows(docs, labels)
    grams = stored(gram_counts(word_counts(rows.where("fold <= 3"))), "toxic-grams")
    tables = []
    for found in ratios(grams):
        got = found.select("k", F.col("r").cast("float").alias("r")).toArrow()
        keys, values = got["k"].to_numpy(), got["r"].to_numpy()
        order = np.argsort(keys)
        tables.append((keys[order], values[order]))
    (seen_keys, seen), (unseen_keys, unseen) = tables
    model = Model(seen, unseen, seen_keys=seen_keys, unseen_keys=unseen_keys)
    left_out = rows.where("fold = 4")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(max(left_out.select("doc_id").count(), 1))) < curve_rows
    sample = left_out.where(share).select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(shared.value.features_of(part).tolist(), pa.list_(pa.float64()))
        release()

    got = sample.select("toxic", features("text").alias("x")).toArrow()
    shared.unpersist()
    if len(got["toxic"].unique()) == 2:
        model.curve = _curve(np.array(got["x"].to_pylist()), got["toxic"].to_numpy().astype(np.float64))
    return model


def score(model: Model, spark, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(shared.value.scores(part))
        release()

    return scored(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), score(model, docs.sparkSession, F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
