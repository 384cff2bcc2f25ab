"""Line deduplication by deletion neighbourhoods, in DataFrame functions only.

A line is the sequence of its words. Of equal lines, and of lines within one edit of a word (inserted, deleted or
replaced), the earliest in the corpus stays. Lines within one edit become equal when a word is deleted: every such
variant is emitted as a hashed key and equal variants meet. Members of a key with the same length and the same deleted
place differ in that word alone, so a group needs only its earliest member, never its pairs. The edit distance of each
line and the earlier one found for it is verified on their words.

Before the variants, lines without any possible partner are set aside, which loses nothing: of two lines within one
edit either the first half of one is a prefix of the other at that length or its second half is a suffix, so a line
whose half keys nobody shares has no partner. For the others the same is asked of quarters, and words are deleted only
in quarters around which a partner agrees.

Defined cases: blank lines always stay; a null text stays null and has no lines; "earliest" is by doc_id (nulls last),
then text hash, then line; rows with equal doc_id and text are one document and are treated alike; an empty table gives
no rows; further columns pass through unchanged and may have any names.

Hot keys: a line's verdict meets its occurrences by hot_join. Variants and keepers are unique on one side of their
joins, so Spark splits a large partition of the other side; what is grouped is summed before it is shuffled.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, hot_join, if_small, stored

#: A single edit among at least this many words is a similarity of 0.8 or more; shorter lines must be equal.
NEAR_WORDS = 5


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def _lines(text: Column) -> Column:
    """The lines of a text with one space between words; only texts with other white space are rewritten."""
    odd = F.lit(False)
    for other in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(text, F.lit(other))
    return F.split(F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text), "\n")


def _first(line: Column, k: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), k)


def _last(line: Column, k: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), -k)


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: its document's key, place, hashes of its words and its half keys.

    Words are counted and cut off by their spaces, so no line is taken apart.
    """
    lines = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_hash(docs).alias("k1"), F.posexplode(_lines(docs["text"])).alias("line", "of"))
    lines = lines.withColumn("of", F.trim("of")).where("of <> ''")
    lines = lines.withColumn("n", F.octet_length("of") - F.octet_length(F.replace("of", F.lit(" "), F.lit(""))) + 1)
    n = F.col("n")

    def head(k: Column) -> Column:
        return F.xxhash64(F.lit("head"), k, _first(F.col("of"), k))

    def tail(k: Column) -> Column:
        return F.xxhash64(F.lit("tail"), k, _last(F.col("of"), k))

    # Halves as a line of n words and as one of n - 1 words with an insertion; for odd n the heads coincide, for even n the tails.
    half, less = (n / 2).cast("int"), ((n - 1) / 2).cast("int")
    odd = n % 2 == 1
    near = n >= NEAR_WORDS
    return lines.select(
        "k1", "line", "n", _order().alias("place"),
        F.xxhash64("of").alias("h1"), F.hash("of").alias("h2"),
        F.when(near, head(half)).alias("a"), F.when(near, F.when(odd, tail(less)).otherwise(head(less))).alias("b"), F.when(near, tail(n - half)).alias("c"),
    )


def _document(doc_id: Column, k1: Column) -> Column:
    """A number that sorts documents: doc_id with nulls last (20 digits), the document's hash (8)."""
    doc = F.coalesce(doc_id.cast("decimal(20,0)") + F.lit(Decimal(2**63)), F.lit(Decimal(2**64))).cast("decimal(20,0)")
    return (doc * F.lit(Decimal(10**8)) + F.pmod(k1, F.lit(10**8)).cast("decimal(8,0)")).cast("decimal(28,0)")


def _order() -> Column:
    """A number that sorts lines as the corpus does: the document's, then the line (10 digits).

    A decimal, since its minimum is a hash aggregate where that of a struct would sort.
    """
    return (_document(F.col("doc_id"), F.col("k1")) * F.lit(Decimal(10**9)) * F.lit(Decimal(10)) + F.col("line").cast("decimal(10,0)")).cast("decimal(38,0)")


def classes(lines: DataFrame) -> DataFrame:
    """A row for each distinct line: hashes, words, occurrences, the place of the first one, half keys."""
    return lines.groupBy("h1", "h2").agg(
        F.min("place").alias("first"), F.count("*").alias("n_lines"), F.max("n").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"), F.max("c").alias("c")
    )


def _with_partner(distinct: DataFrame) -> DataFrame:
    """The distinct lines that share a half key with another one."""
    keyed = distinct.where(F.col("n") >= NEAR_WORDS).select("h1", "h2", F.explode(F.array("a", "b", "c")).alias("half"))
    # Hashes of two lines differ, so a key of several lines has several h1.
    common = keyed.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    return keyed.join(common, "half").select("h1", "h2").distinct()


def _texts(docs: DataFrame, distinct: DataFrame, chosen: DataFrame) -> DataFrame:
    """h1, h2, first, n, of (the words with spaces between) of the chosen lines, read from the document of their first occurrence.

    Rows with equal doc_id and text give equal rows here, which no later step minds.
    """
    document, line = F.floor(F.col("first") / F.lit(Decimal(10**10))).cast("decimal(28,0)"), (F.col("first") % F.lit(Decimal(10**10))).cast("int")
    wanted = stored(distinct.join(chosen, ["h1", "h2"]).select("h1", "h2", "first", "n", document.alias("document"), line.alias("line")), "line-wanted")
    texts = docs.select(_document(docs["doc_id"].cast("long"), _text_hash(docs)).alias("document"), docs["text"].alias("text"))
    found = texts.join(if_small(wanted.select("document").distinct()), "document", "left_semi")
    found = found.select("document", F.posexplode(_lines(F.col("text"))).alias("line", "of"))
    found = found.join(if_small(wanted), ["document", "line"]).select("first", "n", "h1", "h2", F.trim("of").alias("of"))
    return found.where(F.xxhash64("of") == F.col("h1"))


def _quarters(lines: DataFrame) -> DataFrame:
    """h1, h2, from, to: the places of lines at which a partner may differ.

    Of a line's four quarters one edit leaves three as they are, so partners share the words around one quarter. Each
    line has those keys for its own length and, as the longer one, for one word less.
    """
    keys = []
    for less in (0, 1):
        m = F.col("n") - less
        for q in range(4):
            before, after = (m * q / 4).cast("int"), m - (m * (q + 1) / 4).cast("int")
            key = F.xxhash64(F.lit(q), m, _first(F.col("of"), before), _last(F.col("of"), after))
            keys.append(F.struct(key.alias("key"), (before + 1).alias("from"), (F.col("n") - after).alias("to")))
    keyed = lines.select("h1", "h2", F.inline(F.array(*keys)))
    common = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    return keyed.join(common, "key").select("h1", "h2", "from", "to").distinct()


def _within_one_edit(a: Column, b: Column) -> Column:
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y)
    place = F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)), F.size(long)).cast("int")
    rest_long = F.slice(long, place + 1, F.greatest(F.size(long) - place, F.lit(0)))
    rest_short = F.slice(short, place + F.when(F.size(a) == F.size(b), 1).otherwise(0), F.size(long))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (rest_long == rest_short)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2, keeper: distinct lines with an earlier one within one edit, and the place of the earliest such line found."""
    lines = stored(_texts(docs, distinct, _with_partner(distinct)), "line-texts")
    spots = F.explode(F.sequence("from", "to")).alias("spot")
    variants = lines.join(_quarters(lines), ["h1", "h2"]).select("h1", "h2", "first", "n", "of", spots)
    before, after = _first(F.col("of"), F.col("spot") - 1), _last(F.col("of"), F.col("n") - F.col("spot"))
    rest = F.when(F.col("spot") == 1, after).when(F.col("spot") == F.col("n"), before).otherwise(F.concat(before, F.lit(" "), after))
    variants = stored(variants.select("h1", "h2", "first", "n", "spot", F.xxhash64(rest).alias("r1"), F.hash(rest).alias("r2")), "line-variants")
    # One word replaced: equal variants of equal length and place.
    least = variants.groupBy("n", "spot", "r1", "r2").agg(F.min("first").alias("keeper"), F.count("*").alias("m")).where("m > 1").drop("m")
    replaced = variants.join(least, ["n", "spot", "r1", "r2"]).where("keeper < first").select("h1", "h2", "first", "keeper")
    # One word more: a variant equals a whole line.
    whole = lines.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("first").alias("short"))
    more = variants.join(whole, ["r1", "r2"]).select("h1", "h2", "first", "r1", "r2", "short")
    longer = more.where("short < first").select("h1", "h2", "first", F.col("short").alias("keeper"))
    shorter = more.where("first < short").select(F.col("r1").alias("h1"), F.col("r2").alias("h2"), F.col("short").alias("first"), F.col("first").alias("keeper"))
    found = replaced.unionByName(longer).unionByName(shorter).groupBy("h1", "h2").agg(F.min("keeper").alias("keeper"))
    words = lines.select("h1", "h2", F.split("of", " ").alias("w"))
    kept = lines.select(F.col("first").alias("keeper"), F.split("of", " ").alias("kept_w"))
    checked = found.join(words, ["h1", "h2"]).join(kept, "keeper").where(_within_one_edit(F.col("w"), F.col("kept_w")))
    return checked.select("h1", "h2", "keeper").distinct()


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): every line that isn't blank; those that go, with `near` and the earlier line that stands for them."""
    lines = stored(occurrences(docs), "lines")
    distinct = stored(classes(lines), "line-classes")
    near = near_lines(docs, distinct).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "keeper")
    judged = distinct.join(near, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").where("n_lines > 1 or keeper is not null")
    judged = stored(judged.select("h1", "h2", "n_lines", "first", "keeper"), "line-verdicts")
    found = hot_join(lines.select("k1", "line", "place", "h1", "h2"), judged, ["h1", "h2"], "n_lines", F.struct("k1", "line"))
    found = found.where("first is not null and (keeper is not null or place <> first)")
    keeper = F.coalesce("keeper", "first")
    doc = (F.floor(keeper / F.lit(Decimal(10**18))) - F.lit(Decimal(2**63))).cast("decimal(38,0)")
    doc = F.when(doc < F.lit(Decimal(2**63)), doc.cast("long"))
    own = F.floor(F.col("place") / F.lit(Decimal(10**10))).cast("decimal(28,0)")
    return lines, found.select(own.alias("document"), "k1", "line", F.col("keeper").isNotNull().alias("near"), doc.alias("keeper_doc"), (keeper % F.lit(Decimal(10**10))).cast("int").alias("keeper_line"))


def dedup(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, and their names, which no column of docs has: the text without the lines that go
    (null text: null), the lines that go (from 0; null: none) and how many of them only nearly equal an earlier line."""
    lines, removed = removals(docs)
    kept_, gone_, near_, document_, k1_, split_ = fresh(docs, "kept", "gone", "near", "document", "k1", "split")
    by_doc = removed.dropDuplicates(["document", "k1", "line"]).groupBy("document", "k1").agg(F.array_sort(F.collect_list("line")).alias(gone_), F.count_if("near").alias(near_))
    by_doc = if_small(by_doc.withColumnsRenamed({"document": document_, "k1": k1_}))
    k1, text, gone = _text_hash(docs), docs["text"], by_doc[gone_]
    joined = docs.join(by_doc, (_document(docs["doc_id"].cast("long"), k1) == by_doc[document_]) & (k1 == by_doc[k1_]), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    # Where many lines go, the places that stay are found as a set. explode makes the lines a column, taken apart once.
    joined = joined.withColumn(split_, F.explode(F.array(F.when(F.size(gone) > 64, F.split(text, "\n")))))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split_) - 1), gone))
    many = F.array_join(F.transform(stay, lambda i: F.element_at(split_, i + 1)), "\n")
    without = F.when(gone.isNull(), text).when(F.size(gone) <= 64, kept).otherwise(many)
    return joined.select(*columns_of(docs), without.alias(kept_), gone, by_doc[near_]), kept_, gone_, near_


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_near, removed (places of the lines that go, from 0), kept_text for every document."""
    found, kept, gone, near = dedup(docs.select("doc_id", "text"))
    gone = F.coalesce(gone, F.array().cast("array<int>"))
    return found.select(
        "doc_id", F.size(gone).cast("long").alias("n_removed"), F.coalesce(near, F.lit(0)).cast("long").alias("n_near"),
        F.array_join(gone.cast("array<string>"), ",").alias("removed"), F.col(kept).alias("kept_text"),
    )


#: The same rows by DuckDB: lines within one edit by comparing each pair of lines of like length.
SQL = r"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS uid FROM documents),
lines AS (
  SELECT doc_id, uid, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM docs),
worded AS (
  SELECT doc_id, uid, i, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM lines),
kept AS (SELECT * FROM worded WHERE len(w) > 0),
classes AS (SELECT w, len(w) AS n, min(struct_pack(d := doc_id, i := i)) AS first, row_number() OVER () AS c FROM kept GROUP BY w),
variants AS (
  SELECT c, n, first, s, list_concat(w[1:s - 1], w[s + 1:]) AS r FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM classes WHERE n >= 5)),
least AS (SELECT n, s, r, min(first) AS keeper FROM variants GROUP BY n, s, r HAVING count(*) > 1),
near AS (
  SELECT v.c FROM variants v JOIN least k ON v.n = k.n AND v.s = k.s AND v.r = k.r WHERE k.keeper < v.first
  UNION SELECT CASE WHEN l.first > v.first THEN l.c ELSE v.c END FROM variants v JOIN classes l ON v.r = l.w WHERE l.n >= 5),
gone AS (
  SELECT k.uid, k.i, k2.c IS NOT NULL AS near FROM kept k JOIN classes c ON k.w = c.w LEFT JOIN near k2 ON k2.c = c.c
  WHERE k2.c IS NOT NULL OR struct_pack(d := k.doc_id, i := k.i) <> c.first),
by_doc AS (SELECT uid, count(*) AS n_removed, count(*) FILTER (near) AS n_near, list(i ORDER BY i) AS gone FROM gone GROUP BY uid)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near, coalesce(array_to_string(gone, ','), '') AS removed,
       CASE WHEN gone IS NULL THEN text ELSE
         array_to_string(list_filter(string_split(text, chr(10)), lambda x, j: NOT list_contains(gone, j - 1)), chr(10)) END AS kept_text
FROM docs LEFT JOIN by_doc USING (uid)
"""
