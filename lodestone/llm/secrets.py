"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans in every whole text. Each candidate's value is hashed and counted by distinct owners and
repositories over the whole corpus: a value that many owners hold is a widely copied example, one that a single owner
holds and that looks live (long, varied, with digits) is that owner's credential. Bare tokens, which no pattern around
them marks, become spans of kind "token" only by that verdict.

Defined cases: a null text is empty and has no spans; a null owner counts as one owner of its own; repeated rows are
scanned each by itself and give equal spans; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, stored

#: Kinds in the order in which spans of one start are listed, with pattern, value's group and least length of the value.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("token", r"[A-Za-z0-9_-]{16,}", 0, 16),
]
#: What lets a whole text be passed over before its matches are listed.
HINTS = {"hex": r"[0-9a-f]{32}", "token": r"[A-Za-z0-9_-]{16}", "access": r"AKIA[A-Z0-9]{12}"}


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """One struct a match, and a last one without: its kind, its place, the gap before it in code points, the match."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    listed = F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit")))
    return F.when(F.rlike(text, F.lit(HINTS.get(kind, pattern))), listed).otherwise(F.array().cast("array<struct<kind:string,at:int,gap:bigint,hit:string>>"))


def candidate_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A row for each document: uid, doc_id, owner, repository and the matches of every pattern. Only these leave the scan, never the text."""
    owner = F.coalesce(F.col("source"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", owner, F.coalesce(F.col("lang"), F.lit(""))) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("doc_id"),
        owner.alias("owner"),
        repository.alias("repository"),
        F.concat(*[_hits(text, kind, pattern) for kind, pattern, _, _ in KINDS]).alias("hits"),
    )


def spans(candidates: DataFrame) -> DataFrame:
    """Candidates' matches with their places and value hashes; matches with too short values are dropped after they have taken their text."""
    hit = candidates.select("uid", "owner", "repository", F.inline("hits"))
    order = Window.partitionBy("uid", "kind").orderBy("at")
    hit = hit.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(order)).where("hit is not null")
    hit = hit.withColumn("start", F.col("end") - F.length("hit"))
    value, least = F.lit(None).cast("string"), F.lit(0)
    for kind, pattern, group, n in KINDS:
        value = F.when(F.col("kind") == kind, F.regexp_extract("hit", pattern, group)).otherwise(value)
        least = F.when(F.col("kind") == kind, F.lit(n)).otherwise(least)
    hit = hit.withColumn("value", value).where(F.length("value") >= least)
    varied = (F.length("value") >= 16) & (F.size(F.array_distinct(F.split(F.col("value"), ""))) >= 8)
    live = varied & F.rlike("value", F.lit("[0-9]")) & F.rlike("value", F.lit("[A-Za-z]")) & ~F.rlike(F.lower("value"), F.lit("example|change_?me|placeholder|your_|xxxx"))
    rank = F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind")).cast("int")
    hit = hit.select("uid", "owner", "repository", "kind", rank.alias("rank"), "start", "end", F.sha2("value", 256).alias("value_hash"), live.alias("live"))
    before = Window.partitionBy("uid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(F.col("kind") != "token", F.col("end"))).over(before), F.lit(-1)) >= F.col("end")
    # A token is of interest only if it looks live and no base span holds it or begins within it with its start.
    return hit.withColumn("covered", covered).where((F.col("kind") != "token") | (F.col("live") & ~F.col("covered"))).drop("covered")


def ownership(found: DataFrame, *, widely: int = 3, copied: int = 5) -> DataFrame:
    """A row for each value hash: spans, repositories and owners that hold it, and the verdict.

    verdict: "example" from `widely` owners on, or from `copied` repositories of several owners on; "owned" with one
    owner; else "shared". Counted by hash, owner and
    repository first, so a value in a third of all rows meets as one row for each repository.
    """
    by_repository = found.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    counts = by_repository.groupBy("value_hash").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    verdict = F.when((F.col("n_owners") >= widely) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= copied)), "example").when(F.col("n_owners") == 1, "owned").otherwise("shared")
    return counts.withColumn("verdict", verdict)


def scan(docs: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): every document's uid and doc_id; every kept span with its value's verdict. Null text: no spans."""
    rows = stored(candidate_rows(docs, **columns), "secret-candidates")
    found = stored(spans(rows), "secret-spans")
    judged = hot_join(found, stored(ownership(found), "secret-ownership"), ["value_hash"], "n_spans", F.struct("uid", "start"))
    return rows.select("uid", "doc_id"), judged.where("kind != 'token' or verdict = 'owned'")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: base counts, digest of base spans, all spans, and counts by verdict."""
    rows, found = scan(docs)
    named = F.transform("listed", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.filter("listed", lambda x: x["rank"] <= 3)
    base = F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    each = found.groupBy("uid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in KINDS],
        F.count_if((F.col("verdict") == "owned") & F.col("live")).alias("n_owned_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("listed"),
    )
    each = each.select("uid", *[f"n_{k}" for k, *_ in KINDS], "n_owned_live", "n_example", "most_owners", "most_repositories", F.array_join(base, ",").alias("base"), F.array_join(named, ",").alias("spans"))
    numbers = [*[f"n_{k}" for k, *_ in KINDS], "n_owned_live", "n_example", "most_owners", "most_repositories"]
    return rows.join(each, "uid", "left").select(
        "doc_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


#: The same rows by DuckDB. regexp_extract_all and string_split_regex list matches and gaps.
SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner,
         coalesce(source, '') || '/' || coalesce(lang, '') AS repository, coalesce(text, '') AS t FROM documents),
lists AS (
  SELECT uid, 'assign' AS kind, 1 AS k, 8 AS least, string_split_regex(t, '<LEAD>[A-Za-z0-9+/_.=-]+') AS gaps,
         regexp_extract_all(t, '<LEAD>[A-Za-z0-9+/_.=-]+') AS hits FROM rows
  UNION ALL SELECT uid, 'access', 2, 16, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM rows
  UNION ALL SELECT uid, 'hex', 3, 32, string_split_regex(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}') FROM rows
  UNION ALL SELECT uid, 'token', 4, 16, string_split_regex(t, '[A-Za-z0-9_-]{16,}'), regexp_extract_all(t, '[A-Za-z0-9_-]{16,}') FROM rows),
one AS (SELECT uid, kind, k, least, unnest(range(1, len(hits) + 1)) AS nth, gaps, hits FROM lists WHERE len(hits) > 0),
each AS (SELECT uid, kind, k, least, nth, length(gaps[nth]) AS gap, hits[nth] AS hit FROM one),
placed AS (
  SELECT *, sum(gap + length(hit)) OVER (PARTITION BY uid, kind ORDER BY nth ROWS UNBOUNDED PRECEDING) AS e FROM each),
valued AS (
  SELECT uid, kind, k, least, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
         CASE WHEN kind = 'assign' THEN regexp_extract(hit, '^<LEAD>([A-Za-z0-9+/_.=-]+)', 1) ELSE hit END AS v FROM placed),
kept AS (
  SELECT *, length(v) >= 16 AND len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
         AND NOT regexp_matches(lower(v), 'example|change_?me|placeholder|your_|xxxx') AS live FROM valued WHERE length(v) >= least),
cover AS (
  SELECT *, coalesce(max(CASE WHEN kind <> 'token' THEN e END) OVER (PARTITION BY uid ORDER BY s, k ROWS UNBOUNDED PRECEDING), -1) >= e AS covered FROM kept),
found AS (SELECT c.*, r.owner, r.repository FROM cover c JOIN rows r USING (uid) WHERE kind <> 'token' OR (live AND NOT covered)),
own AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT repository) AS n_repositories FROM found GROUP BY v),
judged AS (
  SELECT f.*, n_owners, n_repositories, CASE WHEN n_owners >= 3 OR (n_owners > 1 AND n_repositories >= 5) THEN 'example' WHEN n_owners = 1 THEN 'owned' ELSE 'shared' END AS verdict FROM found f JOIN own USING (v)),
docs AS (
  SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (kind = 'token') AS n_token, count(*) FILTER (verdict = 'owned' AND live) AS n_owned_live, count(*) FILTER (verdict = 'example') AS n_example,
         max(n_owners) AS most_owners, max(n_repositories) AS most_repositories,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM judged WHERE kind <> 'token' OR verdict = 'owned' GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_token, 0) AS n_token,
       coalesce(n_owned_live, 0) AS n_owned_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN docs USING (uid)
""".replace(
    "<LEAD>",  # what stands before an assigned value; letters in either case, ASCII only
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?""",
)
