"""Packing of token sequences through the configuration linear program over the length histogram.

Pieces of at most `limit` tokens have at most `limit` different lengths, so the histogram that is solved stays that
small whatever the corpus. A configuration says how many pieces of each length share one sequence. Multiplicative
weights price the lengths: each round a knapsack by dynamic programming finds the best configuration at those prices,
and the lengths that it covers lose price in proportion. The configurations of all rounds, scaled to the linear
program's bound, are its fractional solution; any prices divided by their best configuration's value bound the number
of sequences from below. Rounds end when solution and bound meet or after ROUNDS. Since so many rounds don't settle the
prices of hundreds of lengths, two other plans compete with it: single covering passes at fixed first prices, in which a
covered length leaves, and plain best-fit. Multiplicities are rounded down and what is left is packed best-fit
decreasing; the plan of fewest sequences is taken, so none is worse than best-fit. Pieces are then numbered within their
length and looked up in the solution.

Defined cases: null texts are empty; an empty text is its end id alone; repeated rows are packed each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, stored
from .tokens import encoder

LIMIT, END = 1024, 2
_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, *, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document of more than `limit` ids is cut into pieces of `limit`; the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(ids_of(text.as_py()), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
                out += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _FIELDS)


def best_configuration(value: np.ndarray, limit: int) -> dict[int, int]:
    """The multiset of lengths of the highest value within `limit`. value[l]: a length's price, 0 if it isn't for sale."""
    best, last = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    sold = np.flatnonzero(value > 0)
    price, fits = value[sold], np.searchsorted(sold, np.arange(limit + 1), side="right")
    for c in range(1, limit + 1):
        best[c] = best[c - 1]
        if fits[c]:
            total = best[c - sold[: fits[c]]] + price[: fits[c]]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], last[c] = total[k], sold[k]
    found: dict[int, int] = defaultdict(int)
    c = limit
    while c > 0:
        if last[c]:
            found[int(last[c])] += 1
            c -= int(last[c])
        else:
            c -= 1
    return dict(found)


def fractional(counts: np.ndarray, power: float, *, part: float = 0.34, rate: float = 0.05) -> list[tuple[dict[int, int], float]]:
    """A fractional cover of the histogram: configurations and how often each is used.

    Prices begin as (length / limit)^power, nearly dual feasible for powers near 1 and with a premium on long pieces
    for higher ones, and fall by exp(-rate) for a length that is wholly covered; a covered length is no longer sold.
    Each step goes as far as a `part` of the scarcest length in it.
    """
    limit = len(counts) - 1
    price, left = (np.arange(limit + 1) / limit) ** power, counts.astype(float)
    used: list[tuple[dict[int, int], float]] = []
    while (open_ := left > 1e-9 * np.maximum(counts, 1)).any():
        config = best_configuration(np.where(open_, price * np.exp(-rate * (1 - left / np.maximum(counts, 1))), 0.0), limit)
        n = min(min(max(part * counts[x] / k, 1.0), left[x] / k) for x, k in config.items())
        for x, k in config.items():
            left[x] -= n * k
            if left[x] < 1e-9 * counts[x]:
                left[x] = 0.0
        used.append((config, n))
    return used


#: Rounds of multiplicative weights at most, and how near solution and bound are to meet.
ROUNDS, GAP = 600, 0.002


def weighted(counts: np.ndarray, *, rounds: int = ROUNDS, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(configurations and how often each is used, a lower bound of the linear program) by multiplicative weights.

    A round's configuration is used as often as covers its scarcest length once; a length's weight falls by
    exp(-rate * the share of it that this covers). The rate is what theory asks of so many rounds.
    """
    limit, lengths = len(counts) - 1, np.flatnonzero(counts)
    n, weight, cover, total, bound = counts[lengths].astype(float), np.ones(len(lengths)), np.zeros(len(lengths)), 0.0, 0.0
    rate = min(0.5, np.sqrt(len(lengths) * np.log(len(lengths) + 1) / rounds))
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds if len(lengths) else 0):
        price = np.zeros(limit + 1)
        price[lengths] = weight * lengths / limit
        config = best_configuration(price, limit)
        bound = max(bound, float(n @ price[lengths]) / sum(k * price[x] for x, k in config.items()))
        held = np.array([config.get(int(x), 0) for x in lengths])
        times = float((n[held > 0] / held[held > 0]).min())
        used[tuple(sorted(config.items()))] += times
        total += times
        cover += held * times / n
        weight *= np.exp(-rate * held * times / n)
        weight /= weight.max()
        if total <= cover.min() * bound * (1 + gap):
            break
    scale = bound / total if total else 0.0
    return [(dict(c), x * scale) for c, x in used.items()], bound


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: equal bins are kept together and filled together."""
    space: dict[int, list[list]] = defaultdict(list)  # free tokens -> [lengths, number of bins]
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fit = min((s for s in space if s >= length), default=None)
            if fit is None:
                k = min(limit // length, n)
                bins = n // k
                space[limit - k * length].append([[length] * k, bins])
                n -= bins * k
                continue
            lengths, bins = space[fit][-1]
            take = min(bins, n)
            if take == bins:
                space[fit].pop()
                if not space[fit]:
                    del space[fit]
            else:
                space[fit][-1][1] -= take
            space[fit - length].append([[*lengths, length], take])
            n -= take
    out = []
    for groups in space.values():
        for lengths, bins in groups:
            found: dict[int, int] = defaultdict(int)
            for x in lengths:
                found[x] += 1
            out.append((dict(found), bins))
    return out


def rounded(counts: np.ndarray, cover: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    """A fractional cover with its multiplicities rounded down, and best-fit decreasing for what that leaves."""
    left, limit, plan = counts.copy(), len(counts) - 1, []
    for config, n in cover:
        whole = min([int(n + 1e-9), *(int(left[x] // k) for x, k in config.items())])
        if whole:
            for x, k in config.items():
                left[x] -= k * whole
            plan.append((config, whole))
    return plan + best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, limit)


def solve_within(histogram: dict[int, int], limit: int = LIMIT, *, powers: tuple[float, ...] = (1.02, 1.2, 2.0)) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(plan, bound): configurations with whole multiplicities that hold exactly the histogram's pieces, and a number of sequences below which no plan is."""
    full = [({limit: 1}, histogram[limit])] if histogram.get(limit) else []
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n if length != limit else 0
    size = lambda plan: sum(n for _, n in plan)
    bound = -(-int(counts @ np.arange(limit + 1)) // limit)
    best = best_fit({int(x): int(counts[x]) for x in np.flatnonzero(counts)}, limit)
    for power in powers:
        if size(best) > bound:
            best = min(best, rounded(counts, fractional(counts.copy(), power)), key=size)
    if size(best) > bound:
        cover, least = weighted(counts)
        bound = max(bound, int(np.ceil(least - 1e-6)))
        best = min(best, rounded(counts, cover), key=size)
    return full + best, size(full) + bound


def solve(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """The plan alone."""
    return solve_within(histogram, limit)[0]


def lookup(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Runs of the solution as rows (length * 2^40 + first number, first number, copies in a sequence, first sequence, offset), sorted."""
    rows, sequence, given = [], 0, defaultdict(int)
    for config, n in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            k = config[length]
            rows.append(((length << 40) + given[length], given[length], k, sequence, offset))
            given[length] += k * n
            offset += k * length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, *, limit: int = LIMIT, bucket_rows: int = 100_000) -> DataFrame:
    """cut (with a `length` of 1 to `limit`) with sequence_id and offset.

    A length's pieces are numbered in two levels, by bucket and within it, so that no length meets in one task: there
    are as many buckets as keep one near `bucket_rows` rows if all pieces had one length. To the driver go at most
    `limit` counts.
    """
    spark = cut.sparkSession
    buckets = max(64, -(-cut.count() // bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = stored(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(lookup(solve(histogram, limit)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("own", F.row_number().over(within) - 1)
    numbered = numbered.join(base, (numbered["length"] == base["b_length"]) & (numbered["bucket"] == base["b_bucket"]))
    names = [c for c in cut.columns if c != "bucket"]
    numbered = numbered.select(*names, (F.col("base") + F.col("own")).alias("number"))
    schema = cut.drop("bucket").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = table[np.searchsorted(table[:, 0], (length << 40) + number, side="right") - 1] if len(length) else table[:0]
            turn = number - row[:, 1]
            sequence, offset = row[:, 3] + turn // np.maximum(row[:, 2], 1), row[:, 4] + turn % np.maximum(row[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(stored(pieces(docs, tokenizer), "pieces"))
