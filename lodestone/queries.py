"""Every operator as a query on the given tables, and the same as SQL.

documents stand for a repository's files, embeddings for its vectors, events for a log of file changes, conversations for
agents' trajectories, benchmark for a set of queries, orders - customer - nation - region for a dependency graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import paths, stats, text
from .operators import exact, fusion, grams, graph, recency, semantic, signals, symbols
from .plans import planner, quality, trajectory
from .sources import corpus, records, store
from .streaming import changes
from .tables import shared_dir, stored


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, and what was made of them once for this application and folder."""

    made: dict[tuple, str] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def postings(self) -> DataFrame:
        """The stored trigram index of the documents, sorted by gram: a search reads the row groups of its gram."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in self.made:
            path = f"{shared_dir(self.spark)}/lodestone-trigrams-{uuid.uuid4().hex}"
            grams.write(stored(grams.postings(_files(self)), "trigrams"), path)  # ranges are drawn from stored rows
            self.made[key] = path
        return self.spark.read.parquet(self.made[key])


def query(sql: str | None = None):
    """Registers a function (spark, table) -> DataFrame, where table(name) reads a table, under its name; sql gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _files(table) -> DataFrame:
    return table("documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = "concat_ws('/', source, lang, CAST(doc_id AS VARCHAR))"
LINES = f"SELECT doc_id AS file_id, {PATH} AS path, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents"
NEEDLE, CASED, TWO_LINES = "the and", "Then", ".\nThe"


def _match_sql(condition: str) -> str:
    return f"""WITH lines AS ({LINES}), hits AS (
      SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line) AS n FROM lines WHERE {condition})
    SELECT file_id, path, CAST(line AS INTEGER) AS line, regexp_replace(content, '[\\s\\x1c-\\x1f]+$', '') AS content FROM hits WHERE n <= 10"""


def _search_sql(condition: str, limit: int = 50) -> str:
    return f"""WITH found AS ({_match_sql(condition)}), files AS (SELECT DISTINCT file_id FROM found ORDER BY file_id LIMIT {limit})
    SELECT file_id, path, line, content, (SELECT count(DISTINCT file_id) FROM found) AS total_files FROM found WHERE file_id IN (SELECT file_id FROM files)"""


def _long(found: DataFrame, *more: str) -> DataFrame:
    return found.select("file_id", "path", *more, F.inline("matches"))


_FOLDED = f"contains({FOLD.format('content')}, '{NEEDLE}')"


@query(_search_sql(_FOLDED))
def exact_search(spark, table):
    return _long(exact.search(_files(table), NEEDLE), "total_files")


@query(_search_sql(f"contains(content, '{CASED}')"))
def exact_search_case_sensitive(spark, table):
    return _long(exact.search(_files(table), CASED, case_sensitive=True), "total_files")


@query(f"SELECT count(*) AS total_files FROM documents WHERE contains({FOLD.format('text')}, '{NEEDLE}')")
def exact_total_files(spark, table):
    return exact.total_files(_files(table), NEEDLE)


@query(_match_sql(_FOLDED))
def exact_top_lines_per_file(spark, table):
    return _long(exact.matches(_files(table), NEEDLE))


@query(f"""WITH l AS ({LINES}), next AS (SELECT *, lead(content) OVER (PARTITION BY file_id ORDER BY line) AS following FROM l),
    hits AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line) AS n FROM next WHERE ends_with(content, '.') AND starts_with({FOLD.format('following')}, 'the'))
    SELECT file_id, path, CAST(line AS INTEGER) AS line, regexp_replace(content, '[\\s\\x1c-\\x1f]+$', '') AS content FROM hits WHERE n <= 10""")
def exact_multiline(spark, table):
    return _long(exact.matches(_files(table), TWO_LINES))


@query(f"SELECT file_id, count(*) AS lines, sum(length(content)) AS characters FROM ({LINES}) GROUP BY file_id")
def corpus_lines(spark, table):
    return exact.lines(_files(table)).groupBy("file_id").agg(F.count("*").alias("lines"), F.sum(F.length("content")).alias("characters"))


def _redaction_sql(column: str) -> str:
    for pattern, by in text.REDACTIONS:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return column


@query(f"SELECT doc_id, {_redaction_sql('text')} AS redacted FROM documents")
def redact_documents(spark, table):
    return table("documents").select("doc_id", text.redact("text").alias("redacted"))


@query("SELECT doc_id, CAST(greatest(1, (octet_length(encode(text)) + 3) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, table):
    return table("documents").select("doc_id", text.tokens("text").alias("tokens"))


_PATHS = """SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 6 WHEN 0 THEN '/test_a.py' WHEN 1 THEN '/app.spec.ts' WHEN 2 THEN '/config/x.json' WHEN 3 THEN '/.env.local' WHEN 4 THEN '/README' ELSE '\\Tests\\B.cs' END AS path FROM pages"""
_ENDS = lambda ends: "(" + "|".join(e.replace(".", "\\.") for e in ends) + ")$"
_BASE = "regexp_extract(p, '[^/]*$')"


@query(f"""WITH x AS ({_PATHS}), y AS (SELECT page_id, path, lower(replace(path, '\\', '/')) AS p FROM x)
    SELECT page_id, regexp_matches(p, '(^|/)tests?(/|$)') OR regexp_matches(p, '{paths.TEST_NAME}') AS is_test,
      {_BASE} IN ({', '.join(repr(n) for n in paths.SEARCH_CONFIG_NAMES)}) OR starts_with({_BASE}, '.env') OR regexp_matches(p, '{_ENDS(paths.SEARCH_CONFIG_ENDS)}') OR regexp_matches(p, '(^|/)config(uration)?(/|$)') AS is_configuration,
      {_BASE} IN ({', '.join(repr(n) for n in paths.PLAN_CONFIG_NAMES)}) OR regexp_matches(p, '{_ENDS(paths.PLAN_CONFIG_ENDS)}') AS is_plan_configuration,
      CASE WHEN regexp_matches({_BASE}, '^\\.env($|\\.)') THEN '.env' ELSE regexp_extract({_BASE}, '^.+(\\.[^.]+)$', 1) END AS extension,
      len(list_intersect(string_split(p, '/'), [{', '.join(repr(n) for n in paths.SKIPPED_FOLDERS)}])) > 0 AS skipped FROM y""")
def path_predicates(spark, table):
    ends = F.element_at(F.array(*map(F.lit, ["/test_a.py", "/app.spec.ts", "/config/x.json", "/.env.local", "/README", "\\Tests\\B.cs"])), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table("pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), ends).alias("path"))
    return rows.select("page_id", paths.is_test("path").alias("is_test"), paths.is_configuration("path").alias("is_configuration"), paths.is_plan_configuration("path").alias("is_plan_configuration"), paths.extension("path").alias("extension"), paths.is_skipped("path").alias("skipped"))


@query("SELECT doc_id, 'sym:' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || lang || chr(31) || source || chr(31)), 1, 24) AS id FROM documents")
def stable_ids(spark, table):
    return table("documents").select("doc_id", text.digest_id("sym", "doc_id", "lang", "source", F.lit(None)).alias("id"))


SIGNALS = [
    ("articles", "function-words", "definite article", "high", ["the the", "Der der"]),
    ("license", "legal", "license line", "high", ["licensed under", "Released under"]),
    ("keys", "secrets", "credential", "medium", ["password", "AKIA", "token"]),
    ("rare", "none", "never there", "low", ["no such needle"]),
]


def _signals_sql(top: int = 10, entries=SIGNALS, lines: str = LINES) -> str:
    needles = ", ".join(f"({i}, '{s[0]}', '{s[1]}', {q}, '{text.folded(n)}')" for i, s in enumerate(entries) for q, n in enumerate(s[4]))
    return f"""WITH n(ord, id, category, q, needle) AS (VALUES {needles}), l AS ({lines}),
    hits AS (SELECT ord, id, category, q, file_id, path, line, content, row_number() OVER (PARTITION BY ord, q, file_id ORDER BY line) AS per_file,
             dense_rank() OVER (PARTITION BY ord, q ORDER BY file_id) AS nth_file FROM n JOIN l ON contains({FOLD.format('content')}, needle)),
    once AS (SELECT *, row_number() OVER (PARTITION BY ord, file_id, line ORDER BY q) AS again FROM hits WHERE per_file <= 10 AND nth_file <= 50),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY q, file_id, line) AS rank FROM once WHERE again = 1)
    SELECT CAST(ord AS INTEGER) AS ord, id, category, CAST(rank AS INTEGER) AS rank, file_id, path, CAST(line AS INTEGER) AS line,
      substr({_redaction_sql("regexp_replace(content, '[\\s\\x1c-\\x1f]+$', '')")}, 1, 300) AS content FROM ranked WHERE rank <= {top}"""


@query(_signals_sql())
def signal_scan(spark, table):
    return signals.scan(_files(table), SIGNALS)


@query(f"SELECT category, count(DISTINCT id) AS signals, count(*) AS matches FROM ({_signals_sql(20)}) GROUP BY category")
def signal_summary_by_category(spark, table):
    return signals.by_category(signals.capped(signals.scan(_files(table), SIGNALS, top_k=20)))


_GRAMS = f"SELECT DISTINCT substr(f, i, 3) AS gram, doc_id FROM (SELECT doc_id, f, unnest(range(1, greatest(length(f) - 1, 1))) AS i FROM (SELECT doc_id, {FOLD.format('text')} AS f FROM documents))"


@query(f"SELECT gram, count(*) AS n, min(doc_id) AS first_file, max(doc_id) AS last_file FROM ({_GRAMS}) WHERE length(gram) = 3 GROUP BY gram")
def trigram_postings(spark, table):
    found = grams.postings(_files(table))
    return found.groupBy("gram").agg(F.count("*").alias("n"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


@query(f"SELECT doc_id AS file_id FROM documents WHERE contains({FOLD.format('text')}, 'lic')")
def candidate_chunks(spark, table):
    return grams.candidates(table.postings(), "Licensed under")


@query(_search_sql(f"contains({FOLD.format('content')}, 'licensed under')"))
def pruned_search(spark, table):
    return _long(grams.pruned_search(_files(table), table.postings(), "Licensed under"), "total_files")


@query(f"SELECT CASE WHEN count(*) > 0 THEN 0 END AS problems FROM ({_GRAMS})")
def trigram_index(spark, table):
    return grams.invalid(table.postings())


@query("SELECT count(*) AS files, sum(octet_length(encode(text))) AS source_bytes, sum(octet_length(encode(text))) + greatest(count(*) - 1, 0) AS corpus_bytes, max(octet_length(encode(text))) AS largest FROM documents")
def corpus_stats(spark, table):
    return corpus.statistics(_files(table).withColumn("size", F.octet_length("text").cast("long")))


@query("""SELECT doc_id AS file_id, CAST(coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", n AS length,
    CAST(coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n AS BIGINT) AS "end" FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)""")
def packed_offsets(spark, table):
    return corpus.packed(_files(table).withColumn("size", F.octet_length("text")))


@query("""WITH space AS (SELECT doc_id AS file_id, CAST(coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, n FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)),
    hits AS (SELECT l_orderkey * 37 + l_linenumber AS position FROM lineitem)
    SELECT position, file_id, position - a AS in_file FROM hits ASOF JOIN space ON position >= a WHERE position + 4 <= a + n""")
def located_offsets(spark, table):
    space = corpus.packed(_files(table).withColumn("size", F.octet_length("text")))
    return corpus.located(table("lineitem").select((F.col("l_orderkey") * 37 + F.col("l_linenumber")).alias("position")), space, length=4)


@query(f"""WITH parts AS (SELECT doc_id, {PATH} AS path, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p FROM documents),
    lines AS (SELECT doc_id, path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM parts),
    starts AS (SELECT doc_id, path, l, unnest(range(0, CASE WHEN len(l) <= 40 THEN 1 ELSE CAST(ceil((len(l) - 40) / 32.0) AS BIGINT) + 1 END)) * 32 AS s FROM lines WHERE len(l) > 0),
    made AS (SELECT doc_id AS file_id, path, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 40, len(l)) AS INTEGER) AS end_line, array_to_string(l[s + 1:s + 40], chr(10)) AS text FROM starts)
    SELECT * FROM made WHERE regexp_matches(text, '[^\\s]')""")
def line_chunks(spark, table):
    return semantic.chunks(_files(table))


def _vector(table, vec_id: int) -> list[float]:
    return table("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)), lambda x, y: x + y)"
_COS = f"{_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')}))"
_TOP = f"SELECT e.vec_id, e.label, round({_COS}, 4) AS score, {_COS} AS exact FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY exact DESC, vec_id LIMIT 10"


@query(f"SELECT vec_id, label, score FROM ({_TOP})")
def semantic_topk(spark, table):
    return semantic.top_k(table("embeddings"), _vector(table, 7), 10)


@query(f"""SELECT vec_id, score, boost AS git_boost, round(score + boost, 4) AS boosted, CAST(row_number() OVER (ORDER BY score + boost DESC, vec_id) AS INTEGER) AS place
    FROM (SELECT vec_id, score, CASE WHEN vec_id % 3 = 0 THEN 0.3::DOUBLE WHEN vec_id % 5 = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM ({_TOP}))""")
def semantic_boosted(spark, table):
    from pyspark.sql.window import Window

    top = semantic.top_k(table("embeddings"), _vector(table, 7), 10)
    boost = recency.boost(F.col("vec_id") % 3 == 0, F.col("vec_id") % 5 == 0, F.lit(None).cast("long"))
    rows = top.select("vec_id", "score", boost.alias("git_boost"))
    return rows.select("*", F.round(F.col("score") + F.col("git_boost"), 4).alias("boosted"), F.row_number().over(Window.orderBy((F.col("score") + F.col("git_boost")).desc(), "vec_id")).alias("place"))


@query(f"""WITH n AS (SELECT vec_id, embedding, sqrt({_DOT.format(a='embedding', b='embedding')}) AS norm FROM embeddings),
    u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm) AS v FROM n),
    p AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT.format(a='e.v', b='q.v')} AS exact FROM u e, u q WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank FROM p)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(exact, 4) AS score FROM r WHERE rank <= 5""")
def semantic_batch(spark, table):
    rows = table("embeddings")
    return semantic.batch_top_k(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)


@query("""WITH s AS (SELECT event_id, user_id, value, event_type, ts, max(ts) OVER () AS as_of FROM events)
    SELECT event_id, least(0.40::DOUBLE, CASE WHEN event_type = 'purchase' THEN 0.30::DOUBLE WHEN user_id % 2 = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN epoch(as_of) - epoch(ts) <= 3600 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) AS git_boost FROM s""")
def git_boost(spark, table):
    rows = table("events")
    last = rows.agg(F.max("ts").alias("as_of"))  # one row
    rows = rows.join(F.broadcast(last))
    age = F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return rows.select("event_id", recency.boost(F.col("event_type") == "purchase", F.col("user_id") % 2 == 0, age).alias("git_boost"))


_PATTERN_SIDE = "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'password')"
_SEMANTIC_SIDE = "SELECT vec_id AS doc_id, round(CAST(embedding[1] AS DOUBLE), 4) AS score FROM embeddings"


@query(f"""WITH p AS ({_PATTERN_SIDE}), s AS ({_SEMANTIC_SIDE})
    SELECT doc_id, score, 0 AS source FROM p UNION ALL SELECT doc_id, score, 1 FROM s WHERE doc_id NOT IN (SELECT doc_id FROM p)""")
def hybrid_merge(spark, table):
    pattern = table("documents").where(F.contains("text", F.lit("password"))).select("doc_id", F.lit(1.0).alias("score"))
    meaning = table("embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("score"))
    return fusion.hybrid(pattern, meaning, file="doc_id")


@query(f"SELECT page_id, path AS file FROM ({_PATHS}) WHERE page_id % 6 NOT IN (0, 1, 2, 3, 5)")
def primary_results(spark, table):
    ends = F.element_at(F.array(*map(F.lit, ["/test_a.py", "/app.spec.ts", "/config/x.json", "/.env.local", "/README", "\\Tests\\B.cs"])), (F.col("page_id") % 6 + 1).cast("int"))
    return fusion.primary(table("pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), ends).alias("file")))


@query("""WITH r AS (SELECT item_id, text, CASE item_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'exact' WHEN 2 THEN 'symbol' WHEN 3 THEN 'path' WHEN 4 THEN 'hybrid' ELSE '' END AS m,
      CASE item_id % 4 WHEN 0 THEN 'modify' WHEN 1 THEN 'locate' WHEN 2 THEN 'debug' ELSE '' END AS i, item_id % 3 = 0 AS sem, item_id % 5 = 0 AS sym FROM benchmark),
    x AS (SELECT *, i IN ('modify', 'debug') AS deep, regexp_matches(trim(text), '^\\p{L}+(?:\\s+\\p{L}+)+$') AS prose, CASE WHEN m = '' THEN 'auto' ELSE m END AS mode FROM r)
    SELECT item_id, CASE WHEN mode IN ('exact', 'path') THEN 'pattern' WHEN mode = 'symbol' THEN CASE WHEN sym THEN 'symbol' ELSE 'pattern' END
      WHEN mode = 'auto' THEN CASE WHEN deep AND sem THEN 'hybrid' WHEN (deep OR prose) AND sem THEN 'semantic' ELSE 'pattern' END ELSE mode END AS mode,
      CASE WHEN mode = 'symbol' AND NOT sym THEN 'Symbol index is not ready; using exact pattern search.' WHEN mode = 'path' THEN 'Dedicated path search is not available yet; using exact pattern search.'
      WHEN mode = 'auto' AND (deep OR prose) AND NOT sem THEN 'Semantic index is not ready; using exact pattern search.'
      WHEN mode = 'hybrid' AND NOT sem THEN 'Semantic index is not ready; hybrid search will use exact results only.' END AS warning FROM x""")
def routed_queries(spark, table):
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (F.col("item_id") % by + 1).cast("int"))
    rows = table("benchmark").select("item_id", "text", pick(["auto", "exact", "symbol", "path", "hybrid", ""], 6).alias("mode"), pick(["modify", "locate", "debug", ""], 4).alias("intent"))
    mode, warning = fusion.route("text", "mode", "intent", F.col("item_id") % 3 == 0, F.col("item_id") % 5 == 0)
    return rows.select("item_id", mode.alias("mode"), warning.alias("warning"))


def _graph(table) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [table("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")), table("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")), table("orders").select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))]
    return store.merge(parts).withColumn("reason", F.concat(F.lit("needs "), "dst"))


_GRAPH = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"
_CLOSURE = f"""WITH RECURSIVE g AS ({_GRAPH}), reach AS (
    SELECT 'r' || r_regionkey AS source, 'r' || r_regionkey AS file, 0 AS hops FROM region
    UNION SELECT reach.source, g.src, reach.hops + 1 FROM reach JOIN g ON g.dst = reach.file WHERE reach.hops < 20)
    SELECT source, file, min(hops) AS hops FROM reach WHERE hops > 0 GROUP BY source, file"""


def _regions(table) -> DataFrame:
    return table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("source"))


@query(f"SELECT src, count(DISTINCT dst) AS imports FROM ({_GRAPH}) GROUP BY src")
def direct_imports(spark, table):
    return _graph(table).groupBy("src").agg(F.countDistinct("dst").alias("imports"))


@query(_CLOSURE)
def impact_closure(spark, table):
    return graph.closure(_graph(table), _regions(table))


@query(f"SELECT file, min(hops) AS hops FROM ({_CLOSURE}) GROUP BY file")
def blast_radius(spark, table):
    return graph.blast_radius(graph.closure(_graph(table), _regions(table)))


@query(f"""WITH b AS (SELECT file, min(hops) AS hops FROM ({_CLOSURE}) GROUP BY file), r AS (SELECT *, row_number() OVER (PARTITION BY hops ORDER BY file) AS rank, count(*) OVER (PARTITION BY hops) AS n FROM b)
    SELECT hops, CAST(rank AS INTEGER) AS rank, file, n FROM r WHERE rank <= 20""")
def impact_by_hop(spark, table):
    return graph.by_hop(graph.blast_radius(graph.closure(_graph(table), _regions(table))))


@query(f"""WITH first AS (SELECT 'c' || c_custkey AS f, c_custkey AS ord FROM customer ORDER BY c_custkey LIMIT 5), g AS ({_GRAPH})
    SELECT 'dependencies' AS relation, dst AS file, NULL::INTEGER AS hops FROM g JOIN first ON src = f GROUP BY dst UNION ALL SELECT 'callers', src, 1 FROM g JOIN first ON dst = f GROUP BY src""")
def related_files(spark, table):
    hits = table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file"), F.col("c_custkey").alias("ord"))
    return fusion.related(hits, hits, _graph(table)).select("relation", "file", "hops")


# Documents with a head of code by their number, so that imports and symbols are read from whole texts of a whole table.
_EXTENSIONS = [".py", ".ts", ".go", ".rs", ".java", ".cs", ".rb", ".md"]
_PY, _TS = "from {0} import a\nimport os, sys.path\nx = 1\n", "import x from './{1}'\nconst q = require('lib{2}')\n"
_HEADS = [
    _PY, _TS, 'import "fmt"\nimport "x/y{2}"\n', "use crate::m{2};\nmod util;\n", "import static org.A{2}.b;\nimport org.C.*;\n", "using System;\nusing N{2};\n", "require 'json'\nrequire_relative 'm{2}'\n", "import nothing\n",
]


def _code(table) -> DataFrame:
    """file_id, path, text: documents as source files that import one another."""
    i = (F.col("doc_id") % 8 + 1).cast("int")
    other = (F.col("doc_id") + 40).cast("string")
    head = F.element_at(F.array(*map(F.lit, _HEADS)), i)
    for place, value in enumerate((F.concat_ws(".", "source", "lang", other), other, (F.col("doc_id") % 9).cast("string"))):
        head = F.replace(head, F.lit(f"{{{place}}}"), value)
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), i))
    return table("documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


_HEAD_SQL = f"[{', '.join('$h$' + h + '$h$' for h in _HEADS)}][CAST(doc_id % 8 AS INT) + 1]"
_CODE_SQL = f"""SELECT doc_id AS file_id, {PATH} || {_EXTENSIONS}[CAST(doc_id % 8 AS INT) + 1] AS path,
      replace(replace(replace({_HEAD_SQL}, '{{0}}', concat_ws('.', source, lang, CAST(doc_id + 40 AS VARCHAR))), '{{1}}', CAST(doc_id + 40 AS VARCHAR)), '{{2}}', CAST(doc_id % 9 AS VARCHAR)) || coalesce(text, '') AS text FROM documents"""


def _imports_sql() -> str:
    lists = " ".join(f"WHEN path LIKE '%{e}' THEN list_concat({', '.join(f'regexp_extract_all(text, $p${x.replace('(?mU)', '(?m)')}$p$, 1)' for x in patterns)}, [])" for e, patterns in graph.IMPORTS.items())
    return f"""WITH code AS ({_CODE_SQL}), found AS (SELECT path, CASE {lists} END AS r FROM code WHERE NOT path LIKE '%.md'),
    parts AS (SELECT path, flatten(list_transform(r, lambda x: list_transform(string_split(x, ','), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')))) AS p FROM found),
    each AS (SELECT path AS src, unnest(p) AS raw, unnest(range(0, len(p))) AS nth FROM parts)
    SELECT src, CAST(nth AS INTEGER) AS nth, raw, CASE WHEN regexp_matches(src, '\\.(py|js|ts|tsx|jsx)$') THEN 'imports module ' || raw WHEN src LIKE '%.cs' THEN 'imports namespace ' || raw ELSE 'heuristic dependency edge' END AS reason FROM each"""


@query(_imports_sql())
def import_extract(spark, table):
    return graph.imports(_code(table))


@query(f"""WITH i AS ({_imports_sql()}), code AS ({_CODE_SQL}),
    aimed AS (SELECT src, nth, reason, regexp_replace(src, '[^/]*$', '') || substr(raw, 3) || '.ts' AS dst FROM i WHERE src LIKE '%.ts' AND starts_with(raw, './')),
    dotted AS (SELECT src, nth, reason, '/' || replace(raw, '.', '/') || regexp_extract(src, '\\.[a-z]+$') AS ending FROM i WHERE regexp_matches(src, '\\.(py|java|cs|rs)$')),
    hit AS (SELECT a.src, a.nth, a.reason, a.dst FROM aimed a JOIN code c ON c.path = a.dst
      UNION ALL SELECT d.src, d.nth, d.reason, min(c.path) FROM dotted d JOIN code c ON ends_with('/' || c.path, d.ending) GROUP BY ALL)
    SELECT src, dst, arg_min(reason, nth) AS reason FROM hit WHERE src <> dst GROUP BY src, dst""")
def import_edges(spark, table):
    return graph.edges(_code(table).where(~F.endswith("path", F.lit(".md"))), {"@shared": ["shared"]})


_SHARP = "namespace N{0}\n{\n public class T{1} : T{2}\n {\n  public void M{1}() { M{3}(); }\n }\n}\n// "


def _sharp(table) -> DataFrame:
    """Documents as C# files of a type and a method each; their texts are comments."""
    d, code = F.col("doc_id"), F.lit(_SHARP)
    for place, value in enumerate((d % 10, d, d + 1, d + 2)):
        code = F.replace(code, F.lit(f"{{{place}}}"), value.cast("string"))
    text_ = F.concat(code, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n// ")))
    return table("documents").select(F.col("doc_id").alias("file_id"), F.concat(F.concat_ws("/", "source", "lang", d.cast("string")), F.lit(".cs")).alias("path"), text_.alias("text"))


# What those files declare, from their numbers alone.
_DECLARED = f"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS n, 'N' || (doc_id % 10) AS space, {PATH} || '.cs' AS file_path, CAST(8 + len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS lines FROM documents)
    SELECT file_path, 'namespace' AS kind, space AS name, space AS qualified_name, 1 AS line_start, 1 AS line_end, '' AS signature, 'public' AS visibility, doc_id FROM d
    UNION ALL SELECT file_path, 'module', n, space || '.' || n || '#module', 1, lines, '', 'internal', doc_id FROM d
    UNION ALL SELECT file_path, 'class', 'T' || n, space || '.T' || n, 3, 6, 'public class T' || n || ' : T' || (doc_id + 1), 'public', doc_id FROM d
    UNION ALL SELECT file_path, 'method', 'M' || n, space || '.T' || n || '.M' || n, 5, 5, 'public void M' || n || '() {{', 'public', doc_id FROM d"""
_DECLARED_RELATIONS = f"""WITH s AS ({_DECLARED})
    SELECT 'inherits' AS kind, a.qualified_name AS source, b.qualified_name AS target, 'T' || (a.doc_id + 1) AS target_name, a.file_path, 3 AS line, 0.78::DOUBLE AS confidence, a.doc_id FROM s a LEFT JOIN s b ON b.kind = 'class' AND b.doc_id = a.doc_id + 1 WHERE a.kind = 'class'
    UNION ALL SELECT 'calls', a.qualified_name, b.qualified_name, 'M' || (a.doc_id + 2), a.file_path, 5, 0.58, a.doc_id FROM s a LEFT JOIN s b ON b.kind = 'method' AND b.doc_id = a.doc_id + 2 WHERE a.kind = 'method'"""


def _symbols(table) -> tuple[DataFrame, DataFrame]:
    found, raw = (stored(x, "query-symbols") for x in symbols.extract(_sharp(table)))
    return found, symbols.resolve(found, raw)


@query(f"SELECT * EXCLUDE (doc_id) FROM ({_DECLARED})")
def csharp_symbols(spark, table):
    found, _ = symbols.extract(_sharp(table))
    return found.select("file_path", "kind", "name", "qualified_name", "line_start", "line_end", "signature", "visibility")


@query(f"SELECT * EXCLUDE (doc_id) FROM ({_DECLARED_RELATIONS})")
def csharp_relations(spark, table):
    found, relations = _symbols(table)
    names = found.select(F.col("id").alias("_id"), F.col("qualified_name").alias("_q"))
    rows = relations.join(names.select(F.col("_id").alias("source_symbol_id"), F.col("_q").alias("source")), "source_symbol_id")
    rows = rows.join(names.select(F.col("_id").alias("target_symbol_id"), F.col("_q").alias("target")), "target_symbol_id", "left")
    return rows.select("kind", "source", "target", "target_name", "file_path", "line", "confidence")


def _found_sql(needle: str, limit: int = 100) -> str:
    return f"""SELECT * FROM (SELECT *, CASE WHEN lower(name) = '{needle}' OR lower(qualified_name) = '{needle}' THEN 0 WHEN starts_with(lower(name), '{needle}') OR ends_with(lower(qualified_name), '.{needle}') THEN 1
      WHEN contains(lower(name), '{needle}') OR contains(lower(qualified_name), '{needle}') THEN 2 END AS match FROM ({_DECLARED})) WHERE match IS NOT NULL ORDER BY match, lower(qualified_name), file_path, line_start LIMIT {limit}"""


def _pointing_sql(needle: str, kinds: str, limit: int) -> str:
    return f"""WITH f AS ({_found_sql(needle)}), r AS ({_DECLARED_RELATIONS})
    SELECT kind, source, target, target_name, file_path, line FROM r WHERE kind IN ({kinds}) AND (target IN (SELECT qualified_name FROM f) OR lower(target_name) IN (SELECT lower(name) FROM f) OR lower(target_name) = '{needle}')
    ORDER BY confidence DESC, file_path, line LIMIT {limit}"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "source", "target", "target_name", "file_path", "line")


@query(_found_sql("m1", 50).replace("SELECT * FROM", "SELECT name, qualified_name, kind, file_path, match FROM", 1))
def symbol_find(spark, table):
    return symbols.find(_symbols(table)[0], "M1", k=50).select("name", "qualified_name", "kind", "file_path", "match")


@query(_pointing_sql("t2", "'calls', 'inherits'", 200))
def symbol_references(spark, table):
    return _shown(symbols.references(*_symbols(table), "T2", k=200))


@query(_pointing_sql("m4", "'calls'", 50))
def symbol_callers(spark, table):
    return _shown(symbols.callers(*_symbols(table), "M4"))


@query(f"""WITH f AS ({_found_sql('m6')}), r AS ({_DECLARED_RELATIONS}) SELECT kind, source, target, target_name, file_path, line FROM r WHERE kind = 'calls' AND source IN (SELECT qualified_name FROM f WHERE kind = 'method')
    ORDER BY confidence DESC, lower(target_name), line LIMIT 50""")
def symbol_callees(spark, table):
    return _shown(symbols.callees(*_symbols(table), "M6"))


@query(f"""WITH f AS ({_found_sql('t5')}), r AS ({_DECLARED_RELATIONS}) SELECT source, file_path, line FROM r WHERE kind = 'inherits' AND (target IN (SELECT qualified_name FROM f WHERE kind = 'class') OR lower(target_name) IN (SELECT lower(name) FROM f) OR lower(target_name) = 't5')
    ORDER BY source, file_path LIMIT 100""")
def symbol_implementations(spark, table):
    return symbols.implementations(*_symbols(table), "T5", k=100).select("source", "file_path", "line")


@query(f"""SELECT name, qualified_name, kind, file_path, line_start FROM ({_DECLARED})""")
def symbol_listing(spark, table):
    return symbols.listing(_symbols(table)[0]).select("name", "qualified_name", "kind", "file_path", "line_start")


_NEEDLES = [n for e in signals.CATALOGUE for n in e[4]]


def _with_needles(table) -> DataFrame:
    """Documents with a last line that holds one of the catalogue's needles."""
    needle = F.element_at(F.array(*map(F.lit, _NEEDLES)), (F.col("file_id") % len(_NEEDLES) + 1).cast("int"))
    return _files(table).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nuses "), needle))


_NEEDLE_LINES = f"""SELECT file_id, path, unnest(string_split(t, chr(10))) AS content, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line
    FROM (SELECT doc_id AS file_id, {PATH} AS path, coalesce(text, '') || chr(10) || 'uses ' || {_NEEDLES}[CAST(doc_id % {len(_NEEDLES)} AS INT) + 1] AS t FROM documents)"""


@query(_signals_sql(20, signals.CATALOGUE, _NEEDLE_LINES))
def signal_catalogue(spark, table):
    return signals.scan(_with_needles(table), top_k=20)


@query("""WITH s AS (SELECT c_custkey % 500 AS k, max(c_acctbal) > 9000 AS m, min(c_acctbal) < 0 AS r FROM customer GROUP BY 1),
    h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ord, CASE WHEN m THEN 0.30::DOUBLE WHEN r THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS git_boost FROM orders LEFT JOIN s ON o_custkey % 700 = k)
    SELECT o_orderkey, git_boost, row_number() OVER (ORDER BY git_boost DESC, o_orderkey) AS place FROM h ORDER BY git_boost DESC, o_orderkey LIMIT 300""")
def boosted_ranking(spark, table):
    path = lambda c: F.concat(F.lit("p"), c.cast("string"))
    state = table("customer").groupBy(path(F.col("c_custkey") % 500).alias("path")).agg((F.max("c_acctbal") > 9000).alias("modified"), (F.min("c_acctbal") < 0).alias("recent"), F.lit(None).cast("timestamp").alias("mtime"))
    hits = table("orders").select("o_orderkey", path(F.col("o_custkey") % 700).alias("path"), F.col("o_orderkey").alias("ord"))
    page = recency.reranked(recency.boosted(hits, state, F.current_timestamp())).limit(300)
    return page.select("o_orderkey", "git_boost", F.row_number().over(Window.orderBy(F.col("git_boost").desc(), "ord")).cast("long").alias("place"))


_COMMANDS = ["dotnet build x.sln", "rg needle src/a.py", "Get-Content lib\\b.cs | findstr c", "sed -n 1,5p docs/c.md", "git grep -n d", "bat e.toml", "Set-Content f.json 1", "npm test", "ls"]
_COMMAND_SQL = "regexp_matches(lower(c), $p${}$p$)"


@query(f"""WITH x AS (SELECT event_id, {_COMMANDS}[CAST(event_id % {len(_COMMANDS)} AS INT) + 1] || ' # ' || event_type AS c FROM events)
    SELECT event_id, coalesce(nullif(array_to_string(list_filter([{', '.join(f"CASE WHEN {_COMMAND_SQL.format(p)} THEN '{n}' END" for n, p in records.OPERATIONS)}], lambda v: v IS NOT NULL), ','), ''), 'other') AS operations FROM x""")
def command_operations(spark, table):
    command = F.concat(F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % len(_COMMANDS) + 1).cast("int")), F.lit(" # "), F.col("event_type"))
    return table("events").select("event_id", F.array_join(records.operations(command), ",").alias("operations"))


# Parts stand for symbols and orders for references to them by name, so that resolution runs over whole tables.
_SYMBOLS = "SELECT p_partkey AS ord, 'p' || p_partkey AS id, split_part(p_name, ' ', 1) AS name, p_name AS qualified_name, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'interface' END AS kind FROM part"
_RAW = "SELECT o_orderkey AS ord, CASE o_orderkey % 2 WHEN 0 THEN 'calls' ELSE 'implements' END AS kind, 'p' || o_custkey AS source FROM orders"


@query(f"""WITH s AS ({_SYMBOLS}), r AS ({_RAW}), named AS (SELECT r.*, lower(s.name) AS target FROM r JOIN s ON s.id = r.source),
    keys AS (SELECT id, kind, ord, lower(name) AS k FROM s UNION SELECT id, kind, ord, lower(qualified_name) FROM s),
    best AS (SELECT n.ord, n.kind, n.source, n.target, k.id, row_number() OVER (PARTITION BY n.ord ORDER BY CASE WHEN n.kind = 'calls' AND k.kind = 'method' OR n.kind = 'implements' AND k.kind = 'interface' THEN 0 ELSE 1 END, k.ord) AS rn
      FROM named n LEFT JOIN keys k ON k.k = n.target AND k.id <> n.source)
    SELECT kind, source AS source_symbol_id, id AS target_symbol_id, target AS target_name, count(*) AS n FROM best WHERE rn = 1 GROUP BY ALL""")
def symbol_resolution(spark, table):
    part = table("part")
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "method").otherwise("interface")
    found = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.substring_index("p_name", " ", 1).alias("name"), F.col("p_name").alias("qualified_name"), kind.alias("kind"), F.lit("parts").alias("file_path"), F.col("p_partkey").alias("ord"))
    raw = table("orders").select(F.when(F.col("o_orderkey") % 2 == 0, "calls").otherwise("implements").alias("kind"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("source_symbol_id"), F.lit("orders").alias("file_path"), F.col("o_orderkey").alias("ord"))
    raw = raw.join(found.select(F.col("id").alias("source_symbol_id"), F.lower("name").alias("target_name")), "source_symbol_id")
    raw = raw.select("kind", "source_symbol_id", "target_name", "file_path", F.col("ord").cast("int").alias("line"), F.lit(0.5).alias("confidence"), F.lit("synthetic").alias("provenance"), "ord")
    return symbols.resolve(found, raw).groupBy("kind", "source_symbol_id", "target_symbol_id", "target_name").agg(F.count("*").alias("n"))


@query("""SELECT 'p' || p_partkey AS id, CASE WHEN lower(split_part(p_name, ' ', 1)) = 'a' OR lower(p_name) = 'a' THEN 0 WHEN starts_with(lower(split_part(p_name, ' ', 1)), 'a') OR ends_with(lower(p_name), '.a') THEN 1 ELSE 2 END AS match
    FROM part WHERE contains(lower(p_name), 'a') ORDER BY match, lower(p_name), p_partkey LIMIT 100""")
def symbol_lookup(spark, table):
    found = table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.substring_index("p_name", " ", 1).alias("name"), F.col("p_name").alias("qualified_name"), F.lit("class").alias("kind"), F.lit("parts").alias("file_path"), F.col("p_partkey").alias("line_start"))
    return symbols.find(found, "a", k=100).select("id", "match")


_RESULTS = """SELECT o_custkey AS q, list(o_orderkey % 97 ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey"""


def _retrieved(table) -> DataFrame:
    """Customers as queries, their orders as ranked results."""
    listed = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("f"), (k % 97).cast("string")))
    ranked = table("orders").groupBy(F.col("o_custkey").alias("q")).agg(quality.paths(listed).alias("ranked"))
    expected = F.when(F.col("q") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), (F.col("q") % 97).cast("string")), F.concat(F.lit("f"), ((F.col("q") * 3) % 97).cast("string"))))
    none = F.array().cast("array<string>")
    return ranked.select("q", "ranked", F.array_distinct(expected).alias("expected_files"), none.alias("symbols"), none.alias("tests"), F.when(F.col("q") % 2 == 0, F.array(F.lit("s"))).otherwise(none).alias("expected_symbols"), none.alias("expected_tests"))


_SCORES = """WITH l AS (SELECT o_custkey AS q, 'f' || (o_orderkey % 97) AS f, o_orderkey FROM orders), d AS (SELECT q, f, min(o_orderkey) AS k FROM l GROUP BY q, f),
    r AS (SELECT q, f, row_number() OVER (PARTITION BY q ORDER BY k) AS p FROM d),
    e AS (SELECT DISTINCT q, unnest(['f' || (q % 97), 'f' || ((q * 3) % 97)]) AS f FROM (SELECT DISTINCT q FROM l) WHERE q % 7 <> 0),
    h AS (SELECT q.q, count(DISTINCT e.f) AS n, count(DISTINCT CASE WHEN p <= 1 THEN r.f END) AS h1, count(DISTINCT CASE WHEN p <= 5 THEN r.f END) AS h5, count(DISTINCT CASE WHEN p <= 10 THEN r.f END) AS h10, min(p) AS first
      FROM (SELECT DISTINCT q FROM l) q LEFT JOIN e ON e.q = q.q LEFT JOIN r ON r.q = e.q AND r.f = e.f GROUP BY q.q)
    SELECT q, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round(h1 / n, 6) END AS recall_at_1, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round(h5 / n, 6) END AS recall_at_5, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round(h10 / n, 6) END AS recall_at_10,
      round(h5 / 5, 6) AS precision_at_5, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE / first, 6) END AS mean_reciprocal_rank, CASE WHEN q % 2 = 0 THEN 0.0::DOUBLE END AS exact_symbol_recall, NULL::DOUBLE AS related_test_recall FROM h"""


@query(_SCORES)
def retrieval_metrics(spark, table):
    return quality.scores(_retrieved(table)).select("q", *quality.METRICS)


@query(f"SELECT q % 3 AS mode, {', '.join(f'round(avg({m}), 6) AS {m}' for m in quality.METRICS)} FROM ({_SCORES}) GROUP BY q % 3")
def metric_means(spark, table):
    return quality.means(quality.scores(_retrieved(table)).withColumn("mode", F.col("q") % 3), ["mode"])


_MEANS_LONG = "SELECT CAST(q % 3 AS VARCHAR) AS mode, metric, avg(v) AS value FROM (UNPIVOT (SELECT q, recall_at_1, recall_at_5, mean_reciprocal_rank FROM ({s})) ON recall_at_1, recall_at_5, mean_reciprocal_rank INTO NAME metric VALUE v) WHERE {w} GROUP BY ALL"


@query(f"""WITH a AS ({_MEANS_LONG.format(s=_SCORES, w='q % 2 = 0')}), b AS ({_MEANS_LONG.format(s=_SCORES, w='q % 2 = 1')})
    SELECT mode, metric, round(b.value, 6) AS baseline, round(a.value, 6) AS current, 'quality_drop' AS kind FROM a JOIN b USING (mode, metric) WHERE b.value - a.value > 0.0""")
def baseline_compare(spark, table):
    scored = quality.scores(_retrieved(table)).withColumn("mode", (F.col("q") % 3).cast("string"))
    metrics = ["recall_at_1", "recall_at_5", "mean_reciprocal_rank"]
    side = lambda rest: quality.long(scored.where(F.col("q") % 2 == rest).groupBy("mode").agg(*[F.avg(m).alias(m) for m in metrics]), metrics)
    return quality.compare(side(0), side(1)).select("mode", "metric", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"), "kind")


def _events(table) -> DataFrame:
    """Conversations as trajectories."""
    c = table("conversations")
    n, turn, conv = F.length("text").cast("long"), F.col("turn"), F.col("conv_id")
    semantics = F.when(conv % 4 == 0, "delta").when(conv % 4 == 1, "cumulative").when((conv % 4 == 3) & (turn % 2 == 0), "delta")
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (turn % len(options) + 1).cast("int"))
    return c.select(
        conv.alias("run_id"), turn.alias("sequence"), F.when(F.col("role") == "user", "tool_call").otherwise("tool_result").alias("type"), (turn * 100.5).cast("double").alias("elapsed_ms"),
        pick(["file_read", "search", "edit", "test"]).alias("category"), F.array().cast("array<string>").alias("operations"), n.alias("result_size_bytes"),
        F.array(F.concat(F.lit("F"), (turn % 5).cast("string")), F.concat(F.lit("F"), (conv % 5).cast("string"))).alias("file_paths"),
        F.create_map(F.lit("input_tokens"), n, F.lit("output_tokens"), F.when(conv % 3 != 0, turn * 7)).alias("token_usage"), semantics.alias("usage_semantics"), F.when(turn == 3, "first_patch").alias("milestone"),
    )


@query("""WITH e AS (SELECT conv_id AS r, turn, CAST(length(text) AS BIGINT) AS i, CASE WHEN conv_id % 3 <> 0 THEN turn * 7 END AS o,
      CASE WHEN conv_id % 4 = 0 THEN 'delta' WHEN conv_id % 4 = 1 THEN 'cumulative' WHEN conv_id % 4 = 3 AND turn % 2 = 0 THEN 'delta' ELSE '' END AS s FROM conversations),
    l AS (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY turn) > i AS fi, lag(o) OVER (PARTITION BY r ORDER BY turn) > o AS fo FROM e),
    g AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, sum(i) AS si, sum(o) AS so, arg_max(i, turn) AS li, arg_max(o, turn) AS lo2, coalesce(bool_or(fi), false) AS fi, coalesce(bool_or(fo), false) AS fo FROM l GROUP BY r),
    k AS (SELECT *, CASE WHEN n = 1 AND hi = '' THEN 'single-event' WHEN lo = hi AND lo IN ('delta', 'cumulative') THEN lo ELSE 'invalid' END AS kind FROM g),
    x AS (SELECT *, CASE WHEN kind = 'invalid' THEN 'multiple usage events require one explicit, consistent delta or cumulative semantic' WHEN kind = 'cumulative' AND fi THEN 'cumulative input_tokens decreased' WHEN kind = 'cumulative' AND fo THEN 'cumulative output_tokens decreased' END AS err FROM k)
    SELECT r AS run_id, CASE WHEN err IS NULL THEN CASE WHEN kind = 'delta' THEN si ELSE li END END AS input_tokens, CASE WHEN err IS NULL THEN CASE WHEN kind = 'delta' THEN so ELSE lo2 END END AS output_tokens,
      CASE WHEN err IS NULL THEN CASE WHEN kind = 'delta' THEN si + so ELSE li + lo2 END END AS total_tokens, CASE WHEN err IS NULL THEN kind ELSE 'invalid' END AS usage_semantics, err IS NULL AS usage_valid, err AS usage_error FROM x""")
def usage_normalised(spark, table):
    return trajectory.usage(_events(table).withColumn("type", F.lit("usage"))).select("run_id", "input_tokens", "output_tokens", "total_tokens", "usage_semantics", "usage_valid", "usage_error")


@query("""WITH e AS (SELECT conv_id AS r, turn, role = 'user' AS call, turn * 100.5::DOUBLE AS ms, turn % 4 AS c, CAST(length(text) AS BIGINT) AS size, ['F' || (turn % 5), 'F' || (conv_id % 5)] AS p FROM conversations),
    reads AS (SELECT r, unnest(p) AS f FROM e WHERE call AND c = 0), rd AS (SELECT r, count(*) AS total, count(DISTINCT f) AS uniq, count(DISTINCT CASE WHEN f NOT IN ('F1', 'F2') THEN f END) AS off FROM reads GROUP BY r),
    g AS (SELECT r, count(*) FILTER (call AND c = 1) AS searches, count(*) FILTER (call) AS calls, coalesce(sum(size) FILTER (NOT call AND c = 0), 0) AS bytes, round(max(ms), 3) AS duration,
      arg_min(ms, turn) FILTER (list_has_any(p, ['F1', 'F2'])) AS rel, arg_min(ms, turn) FILTER (c = 2 AND list_has_any(p, ['F1', 'F2'])) AS impl, arg_min(ms, turn) FILTER (turn = 3 OR c = 2) AS patch FROM e GROUP BY r)
    SELECT g.r AS run_id, coalesce(uniq, 0) AS unique_files_read, coalesce(total, 0) AS total_file_reads, coalesce(off, 0) AS irrelevant_file_count, searches AS search_operations, calls AS total_tool_calls,
      CAST(ceil(bytes / 4.0) AS BIGINT) AS repository_context_tokens_estimate, duration AS duration_ms, rel AS time_to_first_relevant_file_ms, impl AS time_to_first_likely_implementation_ms, patch AS time_to_first_patch_ms,
      CASE WHEN patch IS NOT NULL THEN duration END AS time_to_final_patch_ms FROM g LEFT JOIN rd USING (r)""")
def trajectory_metrics(spark, table):
    events = _events(table)
    relevant = events.select("run_id").distinct().withColumn("relevant_files", F.array(F.lit("f1"), F.lit("F2")))
    return trajectory.exploration(events, relevant).drop("files_read", "irrelevant_files_inspected")


def _runs(table) -> DataFrame:
    """Orders as runs."""
    o = table("orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("assisted").alias("mode"), (F.col("o_custkey") % 50).alias("task_id"), (F.col("o_orderstatus") == "F").alias("success"),
        (F.col("o_orderkey") % 11 != 0).alias("eligible"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority").startswith("1")).alias("validation_passed"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("total_tokens"), F.col("o_totalprice").alias("duration_ms"),
    )


_RUNS = """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'assisted' END AS mode, o_custkey % 50 AS task_id, o_orderstatus = 'F' AS success, o_orderkey % 11 <> 0 AS eligible,
    CASE WHEN o_orderkey % 3 <> 0 THEN starts_with(o_orderpriority, '1') END AS passed, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total_tokens, o_totalprice AS duration_ms FROM orders"""


@query(f"""SELECT mode, count(*) AS runs, count(*) FILTER (eligible) AS eligible_runs, count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER (eligible) AS eligible_tasks, count(*) FILTER (eligible AND success) AS successes,
    round(count(*) FILTER (eligible AND success) / count(*) FILTER (eligible), 6) AS success_rate, count(*) FILTER (eligible AND passed) AS validation_passes, count(*) FILTER (eligible AND passed IS NOT NULL) AS validation_runs,
    round(count(*) FILTER (eligible AND passed) / count(*) FILTER (eligible AND passed IS NOT NULL), 6) AS validation_pass_rate FROM ({_RUNS}) GROUP BY mode""")
def ab_aggregate(spark, table):
    return trajectory.by_mode(_runs(table))


@query(f"""SELECT task_id, round(avg(CASE WHEN mode = 'baseline' THEN CAST(success AS INT) END), 6) AS baseline_rate, round(avg(CASE WHEN mode = 'assisted' THEN CAST(success AS INT) END), 6) AS other_rate,
    coalesce(round(avg(CASE WHEN mode = 'assisted' THEN CAST(success AS INT) END), 6) < round(avg(CASE WHEN mode = 'baseline' THEN CAST(success AS INT) END), 6), false) AS regressed FROM ({_RUNS}) WHERE eligible GROUP BY task_id""")
def ab_tasks(spark, table):
    return trajectory.by_task(_runs(table), "baseline", "assisted")


@query(f"""WITH r AS (SELECT mode, 'total_tokens' AS metric, total_tokens AS v FROM ({_RUNS}) WHERE eligible UNION ALL SELECT mode, 'duration_ms', duration_ms FROM ({_RUNS}) WHERE eligible)
    SELECT mode, metric, count(v) AS n, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_disc(v, 0.95), 3) AS p95, round(min(v), 3) AS min, round(max(v), 3) AS max FROM r GROUP BY mode, metric""")
def run_statistics(spark, table):
    runs = _runs(table).where("eligible")
    return trajectory.statistics(trajectory.long(runs, ["total_tokens", "duration_ms"]), ["mode", "metric"])


@query(f"""WITH w AS (SELECT mode, total_tokens, duration_ms FROM ({_RUNS}) WHERE eligible AND success), r AS (SELECT mode, 'total_tokens' AS metric, total_tokens AS v FROM w UNION ALL SELECT mode, 'duration_ms', duration_ms FROM w)
    SELECT mode, metric, count(v) AS n, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_disc(v, 0.95), 3) AS p95, round(min(v), 3) AS min, round(max(v), 3) AS max FROM r GROUP BY mode, metric""")
def ab_per_success(spark, table):
    return trajectory.per_success(_runs(table), ["total_tokens", "duration_ms"])


@query(f"""WITH t AS (SELECT DISTINCT task_id FROM ({_RUNS})), m AS (SELECT unnest(['baseline', 'assisted']) AS mode), r AS (SELECT * FROM ({_RUNS}) WHERE eligible)
    SELECT task_id, mode, count(r.run_id) AS runs, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / nullif(count(r.run_id), 0), 6) AS success_rate, count(*) FILTER (passed) AS validation_passes
    FROM t CROSS JOIN m LEFT JOIN r USING (task_id, mode) GROUP BY task_id, mode""")
def ab_task_modes(spark, table):
    return trajectory.by_task_and_mode(_runs(table), ["baseline", "assisted"])


def _paired_runs(table, whole: bool) -> DataFrame:
    """Every customer as a task that ran in both modes; if not whole, those with a negative balance in one only."""
    c = table("customer").select(F.col("c_custkey").alias("task_id"), "c_acctbal", F.explode(F.array(F.lit("baseline"), F.lit("assisted"))).alias("mode"))
    runs = c.where(F.lit(whole) | (F.col("mode") == "baseline") | (F.col("c_acctbal") >= 0))
    tokens = F.when(F.col("mode") == "baseline", F.lit(20_000.0)).otherwise(F.lit(15_000.0)) + F.col("c_acctbal")
    return runs.select("task_id", "mode", F.lit(True).alias("eligible"), F.col("task_id").alias("run_id"), F.lit(True).alias("success"), tokens.alias("total_tokens"), (tokens * 2).alias("duration_ms"), F.when(F.col("task_id") > 1, tokens).alias("cost"))


@query("SELECT 'whole' AS runs, count(*) > 0 AS paired_configuration FROM customer UNION ALL SELECT 'half', count(*) = 0 FROM customer WHERE c_acctbal < 0")
def paired_multiset(spark, table):
    whole, half = (trajectory.paired(_paired_runs(table, x), "baseline", "assisted", ["task_id"]) for x in (True, False))
    return whole.select(F.lit("whole").alias("runs"), "paired_configuration").unionByName(half.select(F.lit("half").alias("runs"), "paired_configuration"))


@query("""WITH m AS (SELECT round(avg(20000 + c_acctbal), 3) AS b, round(avg(15000 + c_acctbal), 3) AS o, round(avg(40000 + 2 * c_acctbal), 3) AS b2, round(avg(30000 + 2 * c_acctbal), 3) AS o2 FROM customer)
    SELECT 'total_tokens' AS metric, round(100 * (b - o) / b, 3) AS reduction_pct FROM m UNION ALL SELECT 'duration_ms', round(100 * (b2 - o2) / b2, 3) FROM m UNION ALL SELECT 'cost', NULL""")
def paired_reductions(spark, table):
    return trajectory.reductions(_paired_runs(table, True), ["total_tokens", "duration_ms", "cost"], "baseline", "assisted", ["task_id"])


@query("""WITH s AS (SELECT l_suppkey, list(l_quantity * l_extendedprice ORDER BY l_quantity * l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, v[CAST(round_even((len(v) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95, v[least(CAST(floor(len(v) * 0.95) AS BIGINT), len(v) - 1) + 1] AS cut95 FROM s""")
def percentile_rules(spark, table):
    rows = table("lineitem").select("l_suppkey", (F.col("l_quantity") * F.col("l_extendedprice")).alias("v"))
    return stats.quantiles(rows, ["l_suppkey"], "v", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95), "cut95": ("cut", 0.95)})


@query("""WITH l AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) SELECT user_id, count(*) FILTER (f) AS fell FROM l GROUP BY user_id""")
def cumulative_check(spark, table):
    return trajectory.fell(table("events"), "value", by="user_id", order="event_id")


def _plan_candidates(table) -> tuple[DataFrame, DataFrame]:
    """Conversations as requests, turns as evidence."""
    c = table("conversations")
    section = F.element_at(F.array(*map(F.lit, planner.SECTIONS)), (F.col("turn") % 3 + 1).cast("int"))
    found = c.select(F.col("conv_id").alias("request_id"), section.alias("section"), F.concat(F.lit("p"), "turn").alias("path"), F.col("turn").cast("int").alias("line_start"), F.col("role").alias("title"), F.lit("turn").alias("reason"), F.col("text").alias("content"), F.lit(0.5).alias("confidence"), F.lit(1).alias("priority"), F.lit(0.0).alias("git_boost"), F.lit(None).cast("string").alias("symbol_id"))
    requests = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.lit("what to change").alias("request"), F.lit(2).alias("top_k"), F.lit(300).alias("budget"))
    return found, requests


_PLAN_SQL = f"""WITH RECURSIVE cost(t) AS (SELECT 1), c AS (SELECT conv_id AS r, CAST(turn % 3 AS INTEGER) AS sec, 'p' || turn AS path, CAST(turn AS INTEGER) AS line, role AS title, text AS content,
      CAST(greatest(1, (octet_length(encode(role || 'turn' || text)) + 3) // 4) AS INTEGER) + 12 AS tokens FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY sec, lower(path), line, title) AS ord FROM c),
    walk AS (SELECT r, 0::BIGINT AS ord, CAST((octet_length(encode('what to change')) + 3) // 4 + 48 AS INTEGER) AS used, 0 AS n0, 0 AS n1, 0 AS n2, '' AS fate, 0 AS tokens, false AS truncated, '' AS path FROM (SELECT DISTINCT conv_id AS r FROM conversations)
      UNION ALL SELECT r, ord, CAST(used + CASE WHEN fate = 'kept' THEN tokens ELSE 0 END AS INTEGER), n0 + CAST(fate = 'kept' AND sec = 0 AS INTEGER), n1 + CAST(fate = 'kept' AND sec = 1 AS INTEGER), n2 + CAST(fate = 'kept' AND sec = 2 AS INTEGER), fate, tokens, truncated, path FROM (
        SELECT r, ord, used, n0, n1, n2, sec, path, CASE WHEN filled THEN 'top_k limit' WHEN cost > room AND NOT cut THEN 'token budget' ELSE 'kept' END AS fate, NOT filled AND cut AS truncated,
          CASE WHEN NOT filled AND cut THEN CAST(least(room, greatest(1, (octet_length(encode(title || 'turn' || substr(content, 1, greatest(1, (room - 16) * 4)))) + 3) // 4) + 12) AS INTEGER) ELSE cost END AS tokens FROM (
          SELECT w.r, o.ord, w.used, w.n0, w.n1, w.n2, o.sec, o.path, o.title, o.content, o.tokens AS cost, 300 - w.used AS room, CASE o.sec WHEN 0 THEN w.n0 WHEN 1 THEN w.n1 ELSE w.n2 END >= 2 AS filled,
            o.tokens > 300 - w.used AND o.sec = 0 AND 300 - w.used >= 64 AND length(o.content) > 0 AS cut FROM walk w JOIN o ON o.r = w.r AND o.ord = w.ord + 1)))
    SELECT r AS request_id, CAST(ord AS INTEGER) AS ord, path, tokens, truncated, fate, max(used) OVER (PARTITION BY r) AS tokens_used FROM walk WHERE ord > 0"""


@query(_PLAN_SQL)
def plan_allocate(spark, table):
    return planner.allocate(*_plan_candidates(table)).select("request_id", "ord", "path", "tokens", "truncated", "fate", "tokens_used")


@query(f"""WITH p AS MATERIALIZED ({_PLAN_SQL}), k AS (SELECT request_id, path, min(ord) AS ord, CAST(substr(path, 2) AS INT) % 3 = 0 AS likely FROM p WHERE fate = 'kept' GROUP BY request_id, path),
    o AS (SELECT request_id, string_agg(path, ' | ' ORDER BY ord) AS inspection_order, string_agg(path, ' | ' ORDER BY ord) FILTER (likely) AS likely_change_set FROM k GROUP BY request_id)
    SELECT request_id, max(tokens_used) AS tokens_used, coalesce(any_value(inspection_order), '') AS inspection_order, coalesce(any_value(likely_change_set), '') AS likely_change_set,
      concat_ws(' | ', CASE WHEN any_value(likely_change_set) IS NULL THEN 'No primary implementation fit the context bundle.' END, 'No related tests were identified; coverage may be missing.',
        CASE WHEN any_value(inspection_order) IS NOT NULL THEN 'Some relationships are heuristic and below 0.70 confidence.' END, CASE WHEN bool_or(fate <> 'kept') THEN 'The token budget omitted relevant context; inspect omissions before editing.' END) AS risks
    FROM p LEFT JOIN o USING (request_id) GROUP BY request_id""")
def plan_summary(spark, table):
    found = planner.summary(planner.allocate(*_plan_candidates(table)))
    return found.select("request_id", "tokens_used", *[F.array_join(c, " | ").alias(c) for c in ("inspection_order", "likely_change_set", "risks")])


@query(r"""WITH words AS (SELECT item_id, text, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*'), lambda w: NOT list_contains(%s, lower(w))) AS w FROM benchmark),
    long AS (SELECT item_id, text, w, list_filter(w, lambda x: regexp_matches(x, '[_.]|.[A-Z]')) AS coded, list_transform(list_sort(list_transform(list_filter(list_zip(w, range(len(w))), lambda p: length(p[1]) > 2), lambda p: (-length(p[1]), lower(p[1]), p[2], p[1]))), lambda t: t[4]) AS rest FROM words),
    flat AS (SELECT item_id, text, list_concat(coded, rest) AS f FROM long),
    uniq AS (SELECT item_id, text, list_filter(f, lambda x, i: list_position(f, x) = i) AS u FROM flat)
    SELECT item_id, array_to_string(CASE WHEN len(u) > 0 THEN u[1:8] ELSE [text] END, ' | ') AS terms FROM uniq""" % str(text.STOP_WORDS))
def query_terms(spark, table):
    return table("benchmark").select("item_id", F.array_join(text.query_terms("text"), " | ").alias("terms"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS events FROM s GROUP BY user_id, k""")
def debounced_events(spark, table):
    found = changes.debounced(table("events"), key="user_id", quiet="30 minutes")
    return found.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("end_us"), "events")


@query("""WITH last AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
    t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), c AS (SELECT user_id AS k, value AS v, event_type = 'error' AS deleted FROM last WHERE n = 1)
    SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, v FROM c WHERE NOT deleted""")
def incremental_merge(spark, table):
    state = table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    log = table("events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), (F.col("event_type") == "error").alias("deleted"), F.struct("ts", "event_id").alias("at"))
    return changes.merged(state, changes.latest(log, key="k", time="at"), key="k")


@query(f"""WITH f AS (SELECT {PATH} AS path, octet_length(encode(text)) AS n, sha256(text) AS d FROM documents WHERE text <> ''), r AS (SELECT substr(sha256(path), 1, 3) AS part, path || ':' || n || ':' || d AS row FROM f),
    p AS (SELECT part, sha256(string_agg(row, chr(10) ORDER BY row)) AS d FROM r GROUP BY part)
    SELECT sha256('{{}}' || chr(10) || string_agg(part || d, chr(10) ORDER BY part)) AS fingerprint FROM p""")
def source_fingerprint(spark, table):
    return store.fingerprint(_files(table), content="text")


@query(f"SELECT {PATH} AS path, text FROM documents WHERE NOT starts_with({PATH}, 'src1/') UNION ALL SELECT 'src1/new/' || item_id, text FROM benchmark")
def append_replace(spark, table):
    new = table("benchmark").select(F.concat(F.lit("src1/new/"), F.col("item_id").cast("string")).alias("path"), "text")
    return store.append_replace(_files(table).select("path", "text"), new, "src1")


@query("""WITH a AS (SELECT 'k' || (c_custkey % 300) AS file, 0 AS source, c_custkey AS ord FROM customer UNION ALL SELECT 'K' || (o_orderkey % 400), 1, o_orderkey FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY lower(file) ORDER BY source, ord) AS n FROM a) SELECT file, ord, source FROM f WHERE n = 1 ORDER BY source, ord LIMIT 200""")
def symbols_before_text(spark, table):
    first = table("customer").select(F.concat(F.lit("k"), (F.col("c_custkey") % 300).cast("string")).alias("file"), F.col("c_custkey").alias("ord"))
    rest = table("orders").select(F.concat(F.lit("K"), (F.col("o_orderkey") % 400).cast("string")).alias("file"), F.col("o_orderkey").alias("ord"))
    return fusion.symbols_first(first, rest, 200)


@query("""WITH c AS (SELECT p_partkey - 1 AS id, p_size AS len, sum(p_size + 1) OVER (ORDER BY p_partkey) - p_size - 1 AS o FROM part), f AS (SELECT id, len, CASE WHEN id % 11 = 0 THEN -1 WHEN id % 13 = 0 THEN 1000000000 ELSE o END AS o FROM c),
    t AS (SELECT sum(p_size + 1) AS n FROM part), s AS (SELECT count(*) AS n, count(DISTINCT id) AS d, max(id) AS m, count(*) FILTER (id < 0) AS neg, count(*) FILTER (o < 0 OR len < 0) AS rec, count(*) FILTER (o + len > (SELECT n FROM t)) AS beyond FROM f)
    SELECT 'file ids' AS "check", CAST(greatest(n - d, m + 1 - n, neg) AS BIGINT) AS bad FROM s UNION ALL SELECT 'file records', rec FROM s UNION ALL SELECT 'files beyond the corpus', beyond FROM s
    UNION ALL SELECT 'chunk size', 0 UNION ALL SELECT 'chunk records', 0 UNION ALL SELECT 'chunks beyond the corpus', 0 UNION ALL SELECT 'chunk coverage', 0""")
def catalogue_faults(spark, table):
    space = corpus.packed(table("part").select((F.col("p_partkey") - 1).alias("file_id"), F.col("p_size").alias("size")))
    broken = F.when(F.col("file_id") % 11 == 0, F.lit(-1)).when(F.col("file_id") % 13 == 0, F.lit(1_000_000_000)).otherwise(F.col("offset"))
    size = table("part").agg(F.coalesce(F.sum(F.col("p_size") + 1), F.lit(0)).alias("n")).first()["n"]
    return corpus.faults(space.withColumn("offset", broken), corpus.chunk_table(size, 4096, spark), corpus_bytes=size, chunk=4096)


@query(f"""SELECT page_id, CASE WHEN f IN ('/test_a.py') THEN 'python' WHEN f = '/app.spec.ts' THEN 'typescript' WHEN f = '/config/x.json' THEN 'json' WHEN f = '\\Tests\\B.cs' THEN 'csharp' ELSE 'text' END AS language
    FROM (SELECT page_id, ['/test_a.py', '/app.spec.ts', '/config/x.json', '/.env.local', '/README', '\\Tests\\B.cs'][CAST(page_id % 6 AS INT) + 1] AS f FROM pages)""")
def path_languages(spark, table):
    ends = F.element_at(F.array(*map(F.lit, ["/test_a.py", "/app.spec.ts", "/config/x.json", "/.env.local", "/README", "\\Tests\\B.cs"])), (F.col("page_id") % 6 + 1).cast("int"))
    return table("pages").select("page_id", paths.language(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), ends)).alias("language"))


@query("""WITH s AS (SELECT l_returnflag, list(l_discount * 1000 ORDER BY l_discount * 1000) AS v, quantile_cont(l_discount * 1000, 0.5) AS m FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, round(m, 3) AS p50, round(v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1], 3) AS p95, round(v[CAST(round_even((len(v) - 1) * 0.99, 0) AS BIGINT) + 1], 3) AS p99, round(v[1], 3) AS min FROM s""")
def timing_summary(spark, table):
    return quality.timings(table("lineitem"), ["l_returnflag"], "l_discount")


@query("""WITH e AS (SELECT c_custkey AS task_id, c_custkey AS place, unnest([0, 1, 2]) AS repetition FROM customer),
    m AS (SELECT *, unnest([0, 1]) AS slot FROM e), x AS (SELECT *, CASE WHEN ((place + repetition) % 2 = 1) = (slot = 0) THEN 'assisted' ELSE 'baseline' END AS mode FROM m)
    SELECT CAST(row_number() OVER (ORDER BY repetition, place, slot) AS INTEGER) AS nth, task_id, mode, repetition FROM x""")
def run_schedule(spark, table):
    return trajectory.schedule(table("customer").select(F.col("c_custkey").alias("task_id"), F.col("c_custkey").alias("place")), ["baseline", "assisted"], 3)


@query("""WITH c AS (SELECT o_custkey AS run_id, 'F' || (o_orderkey % 9) AS path, CAST(floor(o_totalprice) AS BIGINT) % 50 AS i FROM orders),
    g AS (SELECT run_id, list_sort(list_distinct(list(path))) AS p, sum(i) AS insertions FROM c GROUP BY run_id), w AS (SELECT *, list_distinct(['f' || (run_id % 9), 'f1']) AS want, list_transform(p, lambda x: lower(x)) AS got FROM g)
    SELECT run_id, array_to_string(p, ',') AS changed, CAST(insertions AS BIGINT) AS insertions, round(len(list_intersect(want, got)) / len(want), 6) AS expected_file_recall,
      array_to_string(list_sort(list_filter(got, lambda x: NOT list_contains(want, x))), ',') AS unexpected FROM w""")
def patch_metrics(spark, table):
    rows = table("orders").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("F"), (F.col("o_orderkey") % 9).cast("string")).alias("path"), (F.floor("o_totalprice") % 50).alias("insertions"), F.lit(0).alias("deletions"))
    expected = F.array(F.concat(F.lit("f"), (F.col("run_id") % 9).cast("string")), F.lit("F1"))
    found = trajectory.patch(rows, expected)
    return found.select("run_id", F.array_join("changed_files", ",").alias("changed"), "insertions", "expected_file_recall", F.array_join("unexpected_changed_files", ",").alias("unexpected"))


@query("""WITH e AS (SELECT conv_id, turn, role = 'user' AS call, turn * 100.5::DOUBLE AS ms FROM conversations), n AS (SELECT *, sum(CAST(call AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS calls FROM e)
    SELECT conv_id AS run_id, turn AS sequence FROM n WHERE calls <= 3 AND ms <= 1000""")
def capped_events(spark, table):
    return trajectory.capped(_events(table), max_calls=3, timeout_ms=1000).select("run_id", "sequence")


@query(f"""SELECT event_id, '[REDACTED]' AS token, {_redaction_sql("'Bearer x' || event_id || ' password=' || event_type || ' ok'")} AS header FROM events""")
def sanitized_arguments(spark, table):
    header = F.concat(F.lit("Bearer x"), F.col("event_id").cast("string"), F.lit(" password="), F.col("event_type"), F.lit(" ok"))
    rows = table("events").select("event_id", records.sanitized(F.create_map(F.lit("Token"), F.lit("t"), F.lit("header"), header)).alias("a"))
    return rows.select("event_id", F.col("a")["Token"].alias("token"), F.col("a")["header"].alias("header"))


@query(f"""WITH x AS ({_PATHS}), y AS (SELECT page_id, lower(replace(path, '\\', '/')) AS p FROM x), e AS (SELECT page_id, CASE WHEN regexp_matches({_BASE}, '^\\.env($|\\.)') THEN '.env' ELSE regexp_extract({_BASE}, '^.+(\\.[^.]+)$', 1) END AS ext FROM y)
    SELECT page_id, array_to_string(list_filter([CASE WHEN ext IN ({', '.join(repr(x) for x in paths.EXACT_EXTENSIONS)}) THEN 'exact' END, CASE WHEN ext IN ({', '.join(repr(x) for x in paths.DEPENDENCY_EXTENSIONS)}) THEN 'dependency' END, CASE WHEN ext = '.cs' THEN 'symbol' END], lambda v: v IS NOT NULL), ',') AS indexes
    FROM e WHERE ext IN ({', '.join(repr(x) for x in paths.EXACT_EXTENSIONS)})""")
def routed_changes(spark, table):
    ends = F.element_at(F.array(*map(F.lit, ["/test_a.py", "/app.spec.ts", "/config/x.json", "/.env.local", "/README", "\\Tests\\B.cs"])), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table("pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), ends).alias("path"))
    found = changes.routed(rows, {"exact": paths.EXACT_EXTENSIONS, "dependency": paths.DEPENDENCY_EXTENSIONS, "symbol": [".cs"]}, paths.SKIPPED_FOLDERS)
    return found.select("page_id", F.array_join("indexes", ",").alias("indexes"))
