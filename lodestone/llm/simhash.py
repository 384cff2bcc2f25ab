"""SimHash near-duplicates: fingerprints, links found through pivot distance tables, connected components.

Fingerprints that differ in at most 4 of 64 bits agree on at least two of six blocks, so every link lies in one of the
15 buckets (block pair, its bits) of both. Within a bucket the table of Hamming distances to fixed reference
fingerprints discards pairs: by the triangle inequality no coordinate of a link differs by more than 4. Survivors are
verified. Only one fingerprint of equal ones is indexed, and a bucket yields a spanning forest of its links, so a group
of n copies costs about n rows, never n squared.

Defined cases: a null or blank text has fingerprint zero and is linked as any other; component_id is the smallest
doc_id reachable, null where only null doc_ids are; repeated rows come back each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, if_small, release, stored
from .components import connected

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Bits of the six blocks and as many pivots as coordinates of the table.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = 16
SMALL = 16  # buckets up to this size compare shifted copies of the whole batch; larger ones are searched one by one


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the separators 32 and 9 to 13
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(whole, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # long texts in pieces
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, so the table of a fingerprint never changes."""
    return np.random.default_rng(42).integers(0, 2**64, n, dtype=np.uint64)


def _forest(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect whatever is linked within one bucket. Sorted by the first coordinate, a member's candidates are
    a short range of those not yet reached; each is reached once, so dense groups take near-linear time."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.arange(len(fps))  # not yet reached, by the first coordinate
    found = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            first = table[left, 0]
            a, b = np.searchsorted(first, [max(table[i, 0] - radius, 0), table[i, 0] + radius + 1])
            near = left[a:b]
            near = near[np.abs(table[near] - table[i]).max(axis=1, initial=0) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
            if len(near):
                found += [(i, j) for j in near]
                queue += near.tolist()
                left = left[~np.isin(left, near)]
    return [(int(order[i]), int(order[j])) for i, j in found]


def pairs_of_buckets(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int = RADIUS, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Places of links within the buckets of sorted keys, enough to connect what is linked."""
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))
    left, right = [], []
    of = np.repeat(sizes, sizes)
    few = (of > 1) & (of <= small)
    pos, k = np.flatnonzero(few), keys[few]
    for s in range(1, small):
        if len(k) <= s:
            break
        i, j = pos[:-s][same := k[:-s] == k[s:]], pos[s:][same]
        if not len(i):
            break
        ok = np.abs(table[i] - table[j]).max(axis=1) <= radius
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        left.append(i[ok])
        right.append(j[ok])
    for a, n in zip(starts[sizes > small], sizes[sizes > small]):
        pairs = np.array(_forest(fps[a : a + n], table[a : a + n], radius), dtype=np.int64).reshape(-1, 2) + a
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))


def links_of_buckets(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as fingerprints."""
    i, j = pairs_of_buckets(keys, fps, refs)
    return fps[i], fps[j]


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns (key first) of rows sorted by key, cut only between buckets."""
    held: list[list[np.ndarray]] = []  # rows whose bucket may go on in the next batch
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[0][0][0] != columns[0][0]):
            parts = [p for p in [*held, [c[:cut] for c in columns]] if len(p[0])]
            yield [np.concatenate(c) for c in zip(*parts)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints fp, a spanning set of them."""
    block = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    keys = [F.lit(i << 22) + F.shiftleft(block[a], BLOCKS[b][1]) + block[b] for i, (a, b) in enumerate(combinations(range(6), 2))]
    keyed = distinct.select(F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"), "fp")
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in whole_buckets(batches):
            u, v = (x.view(np.int64) for x in links_of_buckets(key, fp.view(np.uint64), refs))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    marked = stored(fingerprints(docs, **columns), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fingerprint-classes")
    labels = connected(stored(links(classes.select("fp")), "fingerprint-links"))
    named = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "n", "first_id", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "fingerprint-labels")
    # Only components of more than one fingerprint need their smallest doc_id from elsewhere.
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "label").select("fp", "n", "component_id")
    return hot_join(marked, stored(named, "fingerprint-components"), ["fp"], "n", F.col("doc_id")).select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, sorted; a shorter text is one shingle, a blank one none."""
    import xxhash

    words, digest = (text or "").encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(len(words) - width + 1, 1)
    starts, last = np.concatenate(([0], ends[:-1]))[:n].tolist(), (ends[-n:] - 1).tolist()
    whole = b" ".join(words)
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, last)), np.uint64, n))


#: Documents whose shingles are counted to tell frequent ones, the count from which one is frequent and how many of them
#: go to the tasks at most; the members up to which all pairs of a bucket are listed at once, from which on it gets
#: hubs, and its hubs at most; the members of a bucket that one task compares with as many others. They decide about
#: work and order, not about links.
SAMPLE, FREQUENT, MOST, FEW, MANY, HUBS, PART = 20_000, 3, 200_000, 8, 64, 6, 4096
#: 64-bit words of the shortest signature.
NARROW = 4


def parity(hashes: np.ndarray) -> np.ndarray:
    """A set's signature with a proven bound: bits (a power of two, twice the set's size at least), each the parity of
    the hashes that fall on it. Two signatures of one length differ in no more bits than their sets in members."""
    bits = max(64 * NARROW, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64 * NARROW
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The same set's signature of fewer words."""
    while len(signature) > words:
        signature = signature[: len(signature) // 2] ^ signature[len(signature) // 2 :]
    return signature


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two signatures differ, at the shorter one's length: a lower bound of the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(others, frequent) among the first n - ceil(similarity * n) + 1 hashes of a sorted set of n, frequent ones last, by rank.

    Any two sets of that Jaccard similarity share at least similarity * n of either's hashes, and hence, whatever the
    order, the first hash that they share is in both prefixes: what lies beyond is too little to hold all that they share.
    """
    n = len(hashes)
    keep = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
    hit = frequent[at] == hashes if len(frequent) else np.zeros(n, bool)
    first = hashes[~hit][:keep]
    return first, hashes[hit][np.argsort(rank[at[hit]])][: keep - len(first)]


def possible(size_a, size_b, apart, similarity: float):
    """Whether sets of these sizes that differ in at least so many members can have the similarity."""
    least = (size_a >= similarity * size_b - 1e-6) & (size_b >= similarity * size_a - 1e-6)
    return least & (apart <= (size_a + size_b) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _pairs_of_few(key, id_, size, place, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs u < v of buckets of up to FEW members, and where the rows of larger ones are."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    sizes = np.diff(np.concatenate(([0], cuts, [len(key)])))
    of, u, v = np.repeat(sizes, sizes), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    pos = np.flatnonzero((of > 1) & (of <= FEW))
    for s in range(1, FEW):
        i, j = (x[key[pos[:-s]] == key[pos[s:]]] for x in (pos[:-s], pos[s:]))
        ok = possible(size[i], size[j], place[i] + place[j], similarity) & (id_[i] != id_[j])
        u.append(np.minimum(id_[i[ok]], id_[j[ok]]))
        v.append(np.maximum(id_[i[ok]], id_[j[ok]]))
    return np.concatenate(u), np.concatenate(v), np.flatnonzero(of > FEW)


def _pairs_of_many(id_, size, place, label, part, sign, across: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket that may be linked and whose components differ; `across`: of different parts only.

    A member is compared with those of like size. Discarded is what the places in the prefixes rule out, then what the
    pivot distance table does (Hamming distances to reference signatures, by maximum coordinate difference), then what
    the signatures do.
    """
    order = np.argsort(size, kind="stable")
    id_, size, place, label, part, sign = (x[order] for x in (id_, size, place, label, part, sign))
    signs = [np.frombuffer(x, np.uint64) for x in sign]
    widths = np.array([len(x) for x in signs])  # ascending, as sizes are
    ends = np.searchsorted(size, size / similarity + 1e-3, side="right")
    for width in np.unique(widths):
        first, last = np.searchsorted(widths, [width, width + 1])
        to = int(ends[last - 1])
        own = np.stack([folded(x, width) for x in signs[first:to]])
        refs = np.random.default_rng(42).integers(0, 2**64, (PIVOTS, width), dtype=np.uint64)
        table = np.stack([np.bitwise_count(own ^ ref).sum(axis=1, dtype=np.int64) for ref in refs], axis=1)
        for i in range(first, last):
            j = np.arange(i + 1, ends[i])
            j = j[(label[j] != label[i]) & (id_[j] != id_[i]) & (part[j] != part[i] if across else True)]
            most = (size[i] + size[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            for apart in (
                lambda j: place[j] + place[i],
                lambda j: np.abs(table[j - first] - table[i - first]).max(axis=1, initial=0),
                lambda j: np.bitwise_count(own[j - first] ^ own[i - first]).sum(axis=1, dtype=np.int64),
            ):
                ok = apart(j) <= most
                j, most = j[ok], most[ok]
            if len(j):
                yield np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j])


def similar_documents(docs: DataFrame, *, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, component_id: documents linked by a Jaccard similarity of their word shingles of at least `similarity`.

    No link is lost: linked sets share a shingle of their prefixes, so every link lies in a bucket (a shingle, the sets
    that have it in their prefix), and in that of the first shingle they share the sets' places there, up to which
    nothing is shared, add up to no more than linked sets differ in. In small buckets all such pairs are candidates.
    Members of large buckets are compared with a hub, and with another as long as hubs connect much; of what is still
    apart in all but the small buckets, pairs are candidates that neither places nor pivot distance tables nor
    signatures discard. A bucket of more than PART members is compared part by part in several tasks.
    Sizes, places and parity signatures discard pairs only where they prove a lower similarity; that of the rest is
    taken exactly. Documents with equal sets are one class and linked; blank ones are one class. Rows with one doc_id
    count as one document; null ids have no component.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    member = ["id", "size", "place"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), width).view(np.int64))], ["g"])
        release()

    sample = texts.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(texts.count(), 1))) < SAMPLE)
    counts = stored(sample.select("text").mapInArrow(spread, "g long").groupBy("g").count().where(F.col("count") >= FREQUENT), "shingle-counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    got = counts.where(F.col("count") >= total // MOST + 1).toArrow()  # at most MOST rows
    hashes, times = got["g"].to_numpy().view(np.uint64), got["count"].to_numpy()
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, times))] = np.arange(len(hashes))
    order = np.argsort(hashes)
    known = spark.sparkContext.broadcast((hashes[order], rank[order]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for t in part.column(1):
                    h = shingle_hashes(t.as_py(), width)
                    same = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                    rows.append((*same.tolist(), len(h), parity(h).tobytes(), *(x.view(np.int64) for x in prefix(h, *known.value, similarity))))
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "h0", "h1", "size", "sign", "others", "frequent"])
        release()

    marked = stored(texts.mapInArrow(mark, "doc_id long, h0 long, h1 long, size long, sign binary, others array<long>, frequent array<long>"), "shingle-marks")
    known.unpersist()
    equal = marked.groupBy("h0", "h1")
    classes = stored(equal.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first(F.size("others")).alias("rarer"), *[F.first(c).alias(c) for c in ("size", "sign", "frequent")]), "shingle-classes")
    sets_ = classes.where("first_id is not null").withColumnRenamed("first_id", "id")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs u, v of small buckets; members u of larger ones, with their bucket g, size and place."""
        for key, id_, size, place in whole_buckets(batches):
            u, v, big = _pairs_of_few(key, id_, size, place, similarity)
            none = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none, none], ["u", "v", "g", "size", "place"])
            yield pa.RecordBatch.from_arrays([pa.array(id_[big]), pa.nulls(len(big), pa.int64()), *[pa.array(x[big]) for x in (key, size, place)]], ["u", "v", "g", "size", "place"])
        release()

    # The long arrays of prefixes go straight from their classes to the buckets and are not written again.
    keyed = equal.agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("others").alias("others")).where("id is not null")
    keyed = keyed.select(F.posexplode("others").alias("place", "g"), "id", "size").select("g", "id", "size", F.col("place").cast("long").alias("place"))
    found = stored(keyed.repartition("g").sortWithinPartitions("g").mapInArrow(buckets, "u long, v long, g long, size long, place long"), "shingle-buckets")
    common = sets_.select("id", "size", "rarer", F.posexplode("frequent").alias("place", "g")).withColumn("place", F.col("rarer") + F.col("place"))
    large = found.where("g is not null").select("g", F.col("u").alias("id"), "size", "place").unionByName(common.select("g", *member))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, size_u, size_v = (batch.column(c).to_numpy() for c in range(4))
            apart = np.fromiter((differing(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))), np.int64, len(u))
            ok = possible(size_u, size_v, apart, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [shingle_hashes(t.as_py(), width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], ["id", "hashes"])
        release()

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of u, v whose similarity is high enough. Only what the signatures leave open is compared by its sets."""
        side = lambda c: sets_.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sign").alias(f"sign_{c}"))
        both = pairs.distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", "size_u", "size_v", "sign_u", "sign_v")
        pairs = stored(both.mapInArrow(screen, "u long, v long"), "shingle-candidates")
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
        shingles = stored(texts.join(if_small(wanted), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "id long, hashes array<long>"), "shingle-sets")
        of = lambda c: shingles.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}_hashes"))
        both = pairs.join(of("u"), "u").join(of("v"), "v")
        shared = F.size(F.array_intersect("u_hashes", "v_hashes"))
        return stored(both.where(shared >= similarity * (F.size("u_hashes") + F.size("v_hashes") - shared)).select("u", "v").distinct(), "shingle-links")

    def hubs_of(k: int) -> DataFrame:
        """g, m, hub: buckets whose members are not yet one component."""
        hub = F.min_by(F.struct("id", "size", "label"), F.xxhash64("id", F.lit(k))).alias("hub")
        return stored(large.groupBy("g").agg(F.count("*").alias("m"), hub, F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").drop("least", "most"), "shingle-open")

    large = stored(large.withColumn("label", F.col("id")), "shingle-members")
    pairs, linked = found.where("v is not null").select("u", "v"), None
    for k in range(HUBS):
        open_ = hubs_of(k)
        with_hub = stored(hot_join(large, open_.where(F.col("m") > MANY), ["g"], "m", F.col("id")).where("hub is not null and label <> hub.label"), "shingle-hubs")
        near = with_hub.where(possible(F.col("size"), F.col("hub.size"), 0, similarity)).select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v"))
        more = verified(near if k else pairs.unionByName(near))
        linked = more if linked is None else stored(linked.unionByName(more), "shingle-links")
        if more.count() * 4 < with_hub.count() or with_hub.isEmpty():  # hubs find little: what is left isn't alike
            break
        labels = connected(linked)
        large = large.drop("label").join(labels, large["id"] == labels["node"], "left").select("g", *member, F.coalesce("label", "id").alias("label"))
        large = stored(large, "shingle-members")
    open_ = hot_join(large, hubs_of(HUBS).drop("hub") if k else open_.drop("hub"), ["g"], "m", F.col("id")).where("m is not null")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches):
            cuts = np.flatnonzero(np.diff(columns[0]) | np.diff(columns[1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(columns[0])]):
                across, *own = (c[a:b] for c in columns[1:])
                for u, v in _pairs_of_many(*own, bool(across[0]), similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        release()

    parts = F.ceil(F.col("m") / PART).cast("int")
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = F.when(F.col("m") > PART, F.xxhash64("g", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.col("g"))
    open_ = open_.select(key.alias("key"), (F.col("part") != F.col("other")).cast("long").alias("across"), "id", "size", "place", "label", F.col("part").cast("long").alias("part"))
    open_ = open_.join(sets_.select("id", "sign"), "id").select("key", "across", "id", "size", "place", "label", "part", "sign")
    pairs = open_.repartition("key").sortWithinPartitions("key", "across").mapInArrow(rest, "u long, v long")
    labels = connected(linked.unionByName(verified(pairs)))
    named = classes.join(labels, classes["first_id"] == labels["node"], "left").select("h0", "h1", "n", F.coalesce("label", "first_id").alias("component_id"))
    return hot_join(marked.select("doc_id", "h0", "h1"), stored(named, "shingle-components"), ["h0", "h1"], "n", F.col("doc_id")).select("doc_id", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
