"""All queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell import fixtures as fx
from tidewell import oracle_values as ov
from tidewell.functions import text
from tidewell.operators import advise, critique, diff, graph, lookup, policy, profile, search, select, write
from tidewell.session import TABLES, table
from tidewell.sources import catalog, exports
from tidewell.streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _money(name: str):
    """Prices as decimals, so that sums do not depend on the order of rows."""
    return F.col(name).cast("decimal(18,2)")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- scans, joins, aggregates ---------------------------------------------------------------------------------


@query("""
SELECT c_mktsegment, n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders are summed by customer first, so the joins see one row a customer
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("spent"), F.count("*").alias("n"))
    joined = by_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.sum("spent").cast("double").alias("revenue"), F.sum("n").alias("n_orders"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS total_count, (SELECT count(*) FROM orders) > 50 AS has_more
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def select_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = orders.agg(F.count("*").alias("total_count"))
    best = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    return best.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_count") > 50)


@query("SELECT c_custkey, '<redacted>' AS c_name, c_mktsegment FROM customer WHERE c_name LIKE '%1%'")
def select_pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where(F.col("c_name").contains("1")).select("c_custkey", "c_name", "c_mktsegment")
    return select.mask(rows, ["c_name"])


_GLOBS = ["public.orders", "sales.*", "*.audit", "secret", "*"]
_REFS = [("public", "orders"), ("public", "customer"), ("sales", "orders"), ("hr", "audit"), ("hr", "secret"), ("public", "secret")]


@query(f"""
WITH {ov.values("refs", "s, t", _REFS)}, {ov.values("globs", "g", [(g,) for g in _GLOBS])},
cut AS (SELECT g, CASE WHEN contains(g, '.') THEN split_part(g, '.', 1) ELSE '*' END AS gs, CASE WHEN contains(g, '.') THEN split_part(g, '.', 2) ELSE g END AS gt FROM globs)
SELECT s || '.' || t AS ref, g AS glob, (gs = '*' OR gs = s) AND (gt = '*' OR gt = t) AS denied FROM refs, cut
""")
def policy_table_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _rows(spark, [(s, t, g) for s, t in _REFS for g in _GLOBS], "s string, t string, glob string")
    return pairs.select(F.concat_ws(".", "s", "t").alias("ref"), "glob", policy.denied_column(F.col("s"), F.col("t"), F.col("glob")).alias("denied"))


@query("""
SELECT o_orderkey, o_custkey, c_name AS o_custkey__resolved FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def fk_label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup.join_labels(rows, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "c_name")


# --- profiles -------------------------------------------------------------------------------------------------

_PROFILED = {"orders": ["o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_linenumber", "l_returnflag", "l_shipdate"], "events": ["event_type", "user_id"], "customer": ["c_mktsegment", "seg_or_null"]}


def _text_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c.endswith("date") else f"CAST({c} AS VARCHAR)"


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a column that has nulls, as the tables have none."""
    return table(spark, sf_dir, "customer").withColumn("seg_or_null", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))


_NULLED = "(SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg_or_null FROM customer)"


@query(
    " UNION ALL ".join(
        f"SELECT 'public.{t}' AS ref, '{c}' AS col, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, round(1 - count({c}) / count(*), 6) AS null_frac, {_text_sql(f'min({c})') if not c.endswith('date') else f'''strftime(min({c}), '%Y-%m-%d %H:%M:%S')'''} AS min, {_text_sql(f'max({c})') if not c.endswith('date') else f'''strftime(max({c}), '%Y-%m-%d %H:%M:%S')'''} AS max, round(avg(strlen({_text_sql(c)})), 6) AS avg_width FROM {_NULLED if t == 'customer' else t}"
        for t, cs in _PROFILED.items()
        for c in cs
    )
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cs in _PROFILED.items():
        df = _with_nulls(spark, sf_dir) if t == "customer" else table(spark, sf_dir, t)
        one = profile.profile(df, f"public.{t}", cs)
        out = one if out is None else out.unionAll(one)
    return out.withColumns({"null_frac": F.round("null_frac", 6), "avg_width": F.round("avg_width", 6)})


_TOPPED = {"documents": ["lang", "source"], "events": ["event_type"], "part": ["p_brand", "p_type"]}


@query(
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT 'public.{t}' AS ref, '{c}' AS col, {c} AS value, count(*) AS freq, sum(count(*)) OVER () AS total FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in _TOPPED.items() for c in cs)
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY ref, col ORDER BY freq DESC, value) AS rank FROM v) SELECT ref, col, value, freq, round(freq / total, 6) AS share, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"
)
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cs in _TOPPED.items():
        one = profile.top_values(table(spark, sf_dir, t), f"public.{t}", cs)
        out = one if out is None else out.unionAll(one)
    return out.withColumn("share", F.round("share", 6))


@query("SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 20")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_values(table(spark, sf_dir, "part"), "p_brand")


_INDEXED = (("region", "r_name"), ("nation", "n_name"), ("part", "p_type"))


@query(" UNION ".join(f"SELECT DISTINCT unnest({ov.tokens(c)}) AS token, 'public.{t}' AS ref, '{c}' AS col FROM {t}" for t, c in _INDEXED))
def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = None
    for t, c in _INDEXED:
        one = table(spark, sf_dir, t).select(F.lit(f"public.{t}").alias("ref"), F.lit(c).alias("col"), F.col(c).alias("value")).distinct()
        values = one if values is None else values.unionAll(one)
    return search.values_index(values)


@query("""
SELECT 'documents.lang' AS col, count(DISTINCT lang) AS n_distinct, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS values FROM documents
UNION ALL SELECT 'orders.o_orderstatus', count(DISTINCT o_orderstatus), string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) FROM orders
""")
def enum_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in (("documents", "lang"), ("orders", "o_orderstatus")):
        df = table(spark, sf_dir, t)
        one = profile.enum_like(profile.top_values(df, t, [c], 20), profile.profile(df, t, [c]))
        one = one.select(F.concat_ws(".", "ref", "col").alias("col"), "n_distinct", "values")
        out = one if out is None else out.unionAll(one)
    return out


# --- words and search -----------------------------------------------------------------------------------------

_NAMES = ["UserOrders", "order_items", "qty_amt", "fk_user_id", "pk", "col2Name", "a", "1", "classes", "addresses", "companies", "buses", "status", "atlas", "ashes", "purchases", "HTTPServer2", "x_1y", ""]


@query(f"WITH {ov.values('n', 'name', [(n,) for n in _NAMES])} SELECT name, array_to_string({ov.tokens('name')}, ' ') AS tokens FROM n UNION ALL SELECT DISTINCT p_name, array_to_string({ov.tokens('p_name')}, ' ') FROM part")
def tokenize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _rows(spark, [(n,) for n in _NAMES], "name string").unionAll(table(spark, sf_dir, "part").select("p_name").distinct())
    return names.select("name", F.array_join(text.tokenize(F.col("name")), " ").alias("tokens"))


_ASKED = ["customer orders", "product price", "shipping dt", "client", "revenue by region", "backup", "zzz", "user log"]
_POSTINGS = f"""
streams AS (
  SELECT ref, unnest({ov.tokens("name")}) AS token, 3.0 AS weight FROM objects
  UNION ALL SELECT ref, unnest({ov.tokens("coalesce(comment, '')")}), 0.5 FROM objects
  UNION ALL SELECT ref, unnest({ov.tokens("name")}), CASE WHEN is_pk THEN 1.25 ELSE 1.0 END FROM cols
  UNION ALL SELECT ref, unnest({ov.tokens("coalesce(comment, '')")}), 0.3 FROM cols),
posts AS (SELECT token, ref, max(weight) AS weight FROM streams GROUP BY ALL),
freq AS (SELECT token, count(DISTINCT ref) AS df FROM posts GROUP BY token)"""
_SYNONYMS = [(h, s) for h, some in text.SYNONYMS.items() for s in some]
_SEARCH = f"""
{ov.values("syn", "head, also", _SYNONYMS)}, {ov.values("asked", "query", [(q,) for q in _ASKED])},
own AS (SELECT DISTINCT query, unnest({ov.tokens("query")}) AS origin FROM asked),
terms AS (SELECT query, origin AS token, 1.0 AS share FROM own UNION ALL SELECT query, also, 0.7 FROM own JOIN syn ON origin = head),
scored AS (SELECT query, ref, sum(share * weight * ln(1 + (SELECT count(*) FROM objects WHERE kind = 'table') / df)) AS raw FROM terms JOIN posts USING (token) JOIN freq USING (token) GROUP BY ALL),
held AS (SELECT query, ref, greatest(0, raw - CASE WHEN regexp_matches(lower(ref), 'audit|_bak|_tmp|backup') THEN 1 ELSE 0 END) AS score FROM scored),
ranks AS (SELECT query, ref, kind, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, ref) AS rank FROM held JOIN objects USING (ref) WHERE score > 0 AND NOT excluded)"""


@query(f"WITH {ov.catalog(fx.WAREHOUSE)}, {_POSTINGS} SELECT p.token, ref, CAST(weight AS DOUBLE) AS weight, df FROM posts p JOIN freq f ON p.token = f.token")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = search.postings(fx.WAREHOUSE.objects(spark), fx.WAREHOUSE.columns(spark))
    return posts.join(search.document_frequency(posts), "token").select("token", "ref", "weight", "df")


@query(f"WITH {ov.catalog(fx.WAREHOUSE)}, {_POSTINGS}, {_SEARCH} SELECT query, ref, kind, CAST(round(score, 6) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM ranks WHERE rank <= 10")
def search_schema_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _rows(spark, [(q,) for q in _ASKED], "query string")
    objects, columns = fx.WAREHOUSE.objects(spark), fx.WAREHOUSE.columns(spark)
    return search.search(asked, objects, columns, search.synonyms(spark)).withColumn("score", F.round("score", 6))


@query(f"""WITH {ov.catalog(fx.WAREHOUSE)}, {_POSTINGS}, {_SEARCH}
SELECT query, ref, CAST(rank AS INTEGER) AS rank, (SELECT string_agg(c.name || ' ' || c.type || CASE WHEN c.is_pk THEN ' pk' ELSE '' END, ', ' ORDER BY c.ordinal) FROM cols c WHERE c.ref = ranks.ref) AS columns FROM ranks WHERE rank <= 3""")
def inspect_or_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = fx.WAREHOUSE.columns(spark)
    hits = search_schema_lexical(spark, sf_dir).where("rank <= 3")
    described = columns.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat("name", F.lit(" "), "type", F.when(F.col("is_pk"), " pk").otherwise("")).alias("d")))), lambda c: c["d"]), ", ").alias("columns"))
    return hits.join(described, "ref").select("query", "ref", "rank", "columns")


@query(f"""
WITH own AS (SELECT doc_id, lang, unnest({ov.tokens("text")}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS n FROM own WHERE token IN ('idiot', 'software', 'licens', 'onea', 'leaux', 'the') GROUP BY ALL),
freq AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scored AS (SELECT doc_id, sum((1 + ln(n)) * ln(1 + (SELECT count(*) FROM documents) / df)) AS score FROM tf JOIN freq USING (token) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 20
""")
def search_documents_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by term frequency times inverse document frequency; counts are combined before they are shuffled."""
    docs = table(spark, sf_dir, "documents")
    asked = ["idiot", "software", "licens", "onea", "leaux", "the"]
    tf = search.term_counts(docs, asked, "doc_id", "text")
    freq = tf.groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    scored = tf.join(F.broadcast(freq), "token").crossJoin(F.broadcast(total)).groupBy("doc_id").agg(F.sum((1 + F.log("n")) * F.log(1 + F.col("total") / F.col("df"))).alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""
WITH {ov.values("syn", "head, also", _SYNONYMS)}, {ov.values("asked", "query", [(q,) for q in _ASKED])}, own AS (SELECT DISTINCT query, unnest({ov.tokens("query")}) AS origin FROM asked)
SELECT query, origin, origin AS token, CAST(1.0 AS DOUBLE) AS share FROM own UNION ALL SELECT query, origin, also, CAST(0.7 AS DOUBLE) FROM own JOIN syn ON origin = head
""")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_terms(_rows(spark, [(q,) for q in _ASKED], "query string"), search.synonyms(spark))


_COMMENTS = ["Application accounts (aka customers)", "Login address (aka username)", "Order amount (also known as total_amt)", "Old (a very long text in parentheses here)", "Plain", "Parts (products) and (spare parts)", "known AKA things"]


@query(f"""WITH {ov.values("c", "comment", [(c,) for c in _COMMENTS])},
m AS (SELECT comment, regexp_extract_all(comment, '(?i)(?:^|[^A-Za-z0-9])(?:aka|also known as)\\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS named,
 list_filter(list_transform(list_filter(list_transform(regexp_extract_all(comment, '\\(([^)]*)\\)', 1), lambda p: trim(p)), lambda p: length(p) > 0 AND length(p) <= 25), lambda p: trim(regexp_replace(p, '^(aka|also known as) ', '', 'i'))), lambda p: regexp_full_match(p, '[A-Za-z0-9_\\-\\s]+') AND len(string_split_regex(trim(p), '\\s+')) <= 2) AS short FROM c)
SELECT comment, array_to_string(list_sort(list_distinct(list_concat(named, short))), '|') AS synonyms FROM m""")
def mined_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rows(spark, [(c,) for c in _COMMENTS], "comment string")
    return found.select("comment", F.array_join(F.array_sort(text.mined_synonyms(F.col("comment"))), "|").alias("synonyms"))


@query("""
SELECT p.vec_id AS probe_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
FROM embeddings p JOIN embeddings v ON p.vec_id <> v.vec_id WHERE p.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) DESC, v.vec_id) <= 20
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    best = search.cosine_top(vectors, vectors.where("vec_id % 50 = 0"), 20)
    return best.select("probe_id", "vec_id", F.round("score", 6).alias("score"))


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents QUALIFY r < 40),
b AS (SELECT doc_id, row_number() OVER (ORDER BY quality DESC, toxic, doc_id) - 1 AS r FROM labels QUALIFY r < 40)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(1.0 / (60 + coalesce(a.r, 10000)) + 1.0 / (60 + coalesce(b.r, 10000)), 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ranking(df: DataFrame, *order) -> DataFrame:
        top = df.orderBy(*order).limit(40)  # only the best forty reach the window, which needs one task
        return top.select("doc_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))

    a = ranking(table(spark, sf_dir, "documents"), F.desc("n_chars"), F.col("doc_id"))
    b = ranking(table(spark, sf_dir, "labels"), F.desc("quality"), F.col("toxic"), F.col("doc_id"))
    return search.rank_fusion(a, b, "doc_id").withColumn("score", F.round("score", 9))


_KNOWN = ["public.orders", "public.customer", "sales.orders", "public.nation", "hr.people"]
_WANTED = ["public.orders", "orders", "nation", "ordrs", "custmer", "peopel", "zzzzzz", "public.customers"]


@query(f"""
WITH {ov.values("known", "ref", [(k,) for k in _KNOWN])}, {ov.values("wanted", "asked", [(w,) for w in _WANTED])},
k AS (SELECT ref, lower(split_part(ref, '.', 2)) AS bare FROM known),
w AS (SELECT asked, lower(asked) AS low, lower(list_extract(string_split(asked, '.'), -1)) AS short FROM wanted),
e AS (SELECT asked, ref FROM w JOIN k ON lower(ref) = low),
n AS (SELECT asked, count(*) AS n, string_agg(ref, ', ' ORDER BY ref) AS choices FROM w JOIN k ON bare = short WHERE NOT contains(low, '.') GROUP BY asked),
s AS (SELECT asked, ref AS suggestion FROM w JOIN k ON levenshtein(short, bare) <= 2 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY levenshtein(short, bare), ref) = 1)
SELECT w.asked, CASE WHEN e.ref IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, coalesce(e.ref, CASE WHEN n = 1 THEN choices END) AS ref,
CASE WHEN e.ref IS NULL AND n > 1 THEN choices END AS choices, CASE WHEN e.ref IS NULL AND n IS NULL THEN suggestion END AS suggestion
FROM w LEFT JOIN e ON e.asked = w.asked LEFT JOIN n ON n.asked = w.asked LEFT JOIN s ON s.asked = w.asked
""")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolve_refs(_rows(spark, [(w,) for w in _WANTED], "asked string"), _rows(spark, [(k,) for k in _KNOWN], "ref string"))


_CONNECTIONS = [("prod-eu", "db1.example.com", "shop"), ("staging", "db2.example.com", "shop_test"), ("analytics", "warehouse", "events"), ("prod-us", "db3.example.com", "shop")]


def _fuzzy_sql(a: str, b: str) -> str:
    x, y = (f"list_filter(string_split_regex(lower({v}), '[^a-z0-9]+'), lambda w: w <> '')" for v in (a, b))
    s, t = f"array_to_string({x}, ' ')", f"array_to_string({y}, ' ')"
    return f"CASE WHEN {s} = '' OR {t} = '' THEN 0.0 WHEN {s} = {t} THEN 100.0 WHEN contains({s}, {t}) OR contains({t}, {s}) THEN 75.0 ELSE 60.0 * len(list_intersect({x}, {y})) / greatest(len({x}), len({y})) END"


@query(f"""
WITH {ov.values("c", "name, host, db", _CONNECTIONS)}, {ov.values("h", "hint", [("shop",), ("prod",), ("shop prod",), ("warehouse events",), ("none",)])}
SELECT hint, name, CAST(greatest({_fuzzy_sql("name", "hint")}, {_fuzzy_sql("host", "hint")}, {_fuzzy_sql("db", "hint")}) AS DOUBLE) AS fit FROM c, h
""")
def fuzzy_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _rows(spark, [(*c, h) for c in _CONNECTIONS for h in ("shop", "prod", "shop prod", "warehouse events", "none")], "name string, host string, db string, hint string")
    return pairs.select("hint", "name", F.greatest(*[text.fuzzy_score(F.col(c), F.col("hint")) for c in ("name", "host", "db")]).alias("fit"))


@query(f"""WITH {ov.catalog(fx.WAREHOUSE)}, {_POSTINGS}, {_SEARCH}
SELECT database, query, ref, CAST(round(score, 6) AS DOUBLE) AS score FROM ranks, (VALUES ('main'), ('replica')) d(database) WHERE rank <= 3""")
def search_all_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search_schema_lexical(spark, sf_dir)
    both = hits.crossJoin(_rows(spark, [("main",), ("replica",)], "database string"))
    return search.ranked(both.drop("rank"), ["database", "query"], 3).select("database", "query", "ref", "score")


# --- the join graph -------------------------------------------------------------------------------------------


@query(f"""
WITH {ov.catalog(fx.SHOP)},
named AS (SELECT c.ref AS src, schema_name, c.name, regexp_replace(lower(c.name), '_id$', '') AS prefix FROM cols c JOIN objects o USING (ref) WHERE regexp_matches(lower(c.name), '._id$') AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.ref = c.ref AND k.col = c.name)),
variants AS (SELECT src, schema_name, name, 0 AS place, prefix AS v FROM named UNION ALL SELECT src, schema_name, name, 1, prefix || 's' FROM named UNION ALL SELECT src, schema_name, name, 2, prefix || 'es' FROM named UNION ALL SELECT src, schema_name, name, 3, left(prefix, length(prefix) - 1) || 'ies' FROM named WHERE prefix LIKE '%y'),
hits AS (SELECT v.src, o.ref AS dst, v.name AS via, o.name AS dst_name, o.pk FROM variants v JOIN objects o ON o.schema_name = v.schema_name AND lower(o.name) = v.v AND o.kind = 'table' WHERE v.src <> o.ref QUALIFY row_number() OVER (PARTITION BY v.src, v.name ORDER BY place, o.ref) = 1),
target AS (SELECT *, CASE WHEN pk <> '' AND NOT contains(pk, ',') THEN pk WHEN EXISTS (SELECT 1 FROM cols c WHERE c.ref = dst AND c.name = 'id') THEN 'id' WHEN EXISTS (SELECT 1 FROM cols c WHERE c.ref = dst AND c.name = dst_name || '_id') THEN dst_name || '_id' END AS col FROM hits)
SELECT src, dst, via, via || '=' || col AS cols, TRUE AS inferred FROM target WHERE col IS NOT NULL
UNION ALL SELECT ref, ref_table, name, col || '=' || ref_col, FALSE FROM keys
""")
def join_graph_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.join_graph(fx.SHOP.objects(spark), fx.SHOP.columns(spark), fx.SHOP.keys(spark))


@query(f"""
WITH RECURSIVE {ov.catalog(fx.WAREHOUSE)}, both_ways AS (SELECT ref AS a, ref_table AS b FROM keys UNION SELECT ref_table, ref FROM keys),
walk(src, node, hops, path) AS (SELECT DISTINCT ref, ref, 0, [ref] FROM objects WHERE ref IN ('public.lineitem', 'public.region') UNION ALL
 SELECT src, b, hops + 1, list_append(path, b) FROM walk JOIN both_ways ON node = a WHERE hops < 3 AND NOT list_contains(path, b))
SELECT src, node AS dst, CAST(hops AS INTEGER) AS hops, array_to_string(path, ' > ') AS path FROM walk WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY src, node ORDER BY hops, array_to_string(path, ' > ')) = 1
""")
def join_path_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.declared_edges(fx.WAREHOUSE.keys(spark))
    return graph.join_paths(edges, _rows(spark, [("public.lineitem",), ("public.region",)], "node string"))


@query(f"""
WITH {ov.catalog(fx.WAREHOUSE)} SELECT ref, kind, '~' || CAST(CAST(row_estimate AS BIGINT) AS VARCHAR) AS rows,
coalesce((SELECT string_agg(c.name || ':' || c.type || CASE WHEN c.not_null THEN '!' ELSE '' END, ', ' ORDER BY ordinal) FROM cols c WHERE c.ref = objects.ref), '') AS columns,
coalesce((SELECT string_agg(ref_table || ' (' || col || '=' || ref_col || ')', ', ' ORDER BY ref_table || ' (' || col || '=' || ref_col || ')') FROM keys k WHERE k.ref = objects.ref), '') AS joins
FROM objects WHERE NOT excluded ORDER BY ref LIMIT 40
""")
def orient_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orient(fx.WAREHOUSE.objects(spark), fx.WAREHOUSE.columns(spark), graph.declared_edges(fx.WAREHOUSE.keys(spark)))


@query(None)
def missing_fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.missing_keys(join_graph_inferred(spark, sf_dir))


ORACLE_SQL["missing_fks"] = f"SELECT src, via, dst, cols FROM ({ORACLE_SQL['join_graph_inferred']}) WHERE inferred"


@query(f"""
WITH {ov.catalog(fx.WAREHOUSE)}, {ov.values("idx", "ref, lead", [(t.ref, i[0]) for t in fx.WAREHOUSE.tables for i in t.indexes])}
SELECT ref, name, col AS cols FROM keys k WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.ref = k.ref AND idx.lead = k.col)
""")
def unindexed_fk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unindexed_keys(fx.WAREHOUSE.keys(spark), fx.WAREHOUSE.indexes(spark))


_CHANGED_EDGES = [("shop.orders", "shop.users", "user_id", "user_id=email", False), ("shop.orders", "shop.addresses", "address_id", "address_id=address_id", True), ("shop.users", "shop.categories", "likes", "name=title", False)]


@query(f"""
WITH base AS ({ORACLE_SQL["join_graph_inferred"]}), {ov.values("changed", "src, dst, via, cols, disabled", _CHANGED_EDGES)}
SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.src = base.src AND c.dst = base.dst AND c.via = base.via)
UNION ALL SELECT src, dst, via, cols, FALSE FROM changed WHERE NOT disabled
""")
def overrides_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.overlay_edges(join_graph_inferred(spark, sf_dir), _rows(spark, _CHANGED_EDGES, "src string, dst string, via string, cols string, disabled boolean"))


@query(None)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical ranks and ranks by hashed word vectors, fused."""
    objects, columns = fx.WAREHOUSE.objects(spark), fx.WAREHOUSE.columns(spark)
    hashes = catalog.object_hashes(objects, columns, fx.WAREHOUSE.keys(spark))
    vectors = search.build_embeddings(search.embedding_document(objects, columns), hashes)
    asked = _rows(spark, [(q,) for q in _ASKED], "query string")
    lexical = search.lexical_scores(asked, search.postings(objects, columns), search.synonyms(spark), objects.where("kind = 'table'").count())
    return search.hybrid_search(asked, lexical.where("score > 0"), vectors, objects.where("NOT excluded")).withColumn("score", F.round("score", 9))


@query(f"WITH {ov.catalog(fx.WAREHOUSE)} SELECT kind, schema_name AS schema, name, CAST(row_estimate AS DOUBLE) AS row_estimate FROM objects WHERE NOT excluded")
def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_objects(fx.WAREHOUSE.objects(spark), None)


@query(f"WITH {ov.catalog(fx.WAREHOUSE)} SELECT concat_ws('|', CAST(count(*) AS VARCHAR), max(ref), CAST(CAST(sum(row_estimate) AS BIGINT) AS VARCHAR), CAST(count(DISTINCT schema_name) AS VARCHAR)) AS fingerprint FROM objects")
def catalog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fingerprint(fx.WAREHOUSE.objects(spark))


@query(f"""
WITH {ov.catalog(fx.WAREHOUSE)}, {ov.values("defined", "ref, definition", [(t.ref, t.definition) for t in fx.WAREHOUSE.tables])},
c AS (SELECT ref, string_agg(concat_ws(':', name, type, CAST(not_null AS VARCHAR), coalesce(comment, '')), ',' ORDER BY ordinal) AS cols FROM cols GROUP BY ref),
k AS (SELECT ref, string_agg(x, ',' ORDER BY x) AS fks FROM (SELECT ref, concat_ws(':', col, ref_table, ref_col) AS x FROM keys) GROUP BY ref)
SELECT o.ref, sha1(concat_ws(';;', kind, CAST(CAST(row_estimate AS BIGINT) AS VARCHAR), coalesce(comment, ''), coalesce(c.cols, ''), pk, coalesce(fks, ''), coalesce(definition, ''))) AS object_hash
FROM objects o JOIN defined USING (ref) LEFT JOIN c ON c.ref = o.ref LEFT JOIN k ON k.ref = o.ref
""")
def object_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.object_hashes(fx.WAREHOUSE.objects(spark), fx.WAREHOUSE.columns(spark), fx.WAREHOUSE.keys(spark))


@query(f"WITH {ov.catalog(fx.WAREHOUSE)} SELECT ref FROM objects WHERE lower(ref) LIKE 'cust%' OR lower(split_part(ref, '.', 2)) LIKE 'cust%' ORDER BY ref LIMIT 50")
def prefix_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.prefix_completion(fx.WAREHOUSE.objects(spark), "cust")


# --- monitoring -----------------------------------------------------------------------------------------------

_STATS = ov.values("stats", "ref, seq_scan, idx_scan, n_live, n_dead", fx.TABLE_STATS)
_INDEXES = ov.values("stats", "ref, index, idx_scan, size_bytes, is_unique, is_primary", fx.INDEX_STATS)


def _table_stats(spark: SparkSession) -> DataFrame:
    return _rows(spark, fx.TABLE_STATS, fx.TABLE_STATS_SCHEMA)


@query(f"WITH {_STATS} SELECT ref, CAST(n_live AS BIGINT) AS n_live, CAST(n_dead AS BIGINT) AS n_dead, round(100.0 * n_dead / (n_live + n_dead), 1) AS dead_pct FROM stats WHERE n_dead > 1000 ORDER BY dead_pct DESC, ref LIMIT 20")
def bloat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advise.bloat(_table_stats(spark))


@query(f"WITH {_STATS} SELECT ref, CAST(seq_scan AS BIGINT) AS seq_scan, CAST(idx_scan AS BIGINT) AS idx_scan, round(100.0 * seq_scan / (seq_scan + idx_scan), 1) AS seq_pct, CAST(n_live AS BIGINT) AS n_live FROM stats WHERE seq_scan > 100 ORDER BY seq_scan DESC, ref LIMIT 20")
def high_seq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advise.high_sequential_scans(_table_stats(spark))


@query(f"WITH {_INDEXES} SELECT ref, index, CAST(size_bytes AS BIGINT) AS size_bytes FROM stats WHERE idx_scan = 0 AND NOT is_unique AND NOT is_primary AND index NOT IN ('customer_fk_idx') ORDER BY size_bytes DESC LIMIT 20")
def unused_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advise.unused_indexes(_rows(spark, fx.INDEX_STATS, fx.INDEX_STATS_SCHEMA), _rows(spark, fx.CONSTRAINED_INDEXES, "index string"))


@query(f"WITH {_INDEXES} SELECT index, CASE WHEN is_primary THEN 'PRIMARY KEY' WHEN is_unique THEN 'UNIQUE' ELSE 'INDEX' END AS type, CAST(idx_scan AS BIGINT) AS idx_scan, CAST(size_bytes AS BIGINT) AS size_bytes FROM stats WHERE ref = 'public.orders'")
def index_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advise.index_usage(_rows(spark, fx.INDEX_STATS, fx.INDEX_STATS_SCHEMA), "public.orders")


@query("""
SELECT user_id AS queryid, event_type AS query, count(*) AS calls, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 2) AS mean_ms FROM events GROUP BY ALL
HAVING count(*) >= 5 ORDER BY CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) DESC, queryid LIMIT 10
""")
def slow_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for a query log: a user's events of one type are the calls of a statement."""
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("queryid"), F.col("event_type").alias("query")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total_ms"))
    statements = log.withColumn("mean_ms", F.col("total_ms") / F.col("calls")).withColumn("rows", F.col("calls"))
    kept = statements.where(F.col("calls") >= 5).orderBy(F.desc("mean_ms"), "queryid").limit(10)
    return advise.slow_queries(kept).select("queryid", "query", "calls", "mean_ms")


@query("SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS reads, round(count(*) FILTER (event_type = 'view') / count(*), 4) AS ratio FROM events")
def cache_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    io = table(spark, sf_dir, "events").select((F.col("event_type") == "view").cast("long").alias("hits"), (F.col("event_type") != "view").cast("long").alias("reads"))
    return advise.cache_ratio(io)


@query("SELECT event_type AS state, user_id % 2 = 0 AS waiting, count(*) AS n FROM events GROUP BY ALL")
def connection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), F.when(F.col("user_id") % 2 == 0, "io").alias("wait_event"))
    return advise.connection_states(activity)


@query("SELECT event_id AS pid, CAST(user_id AS VARCHAR) AS user, event_type AS state, CAST(floor(epoch(ts)) AS BIGINT) AS started, left(props, 500) AS query FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 100")
def running_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), F.col("user_id").cast("string").alias("user"), F.when(F.col("event_type") == "view", "idle").otherwise(F.col("event_type")).alias("state"), F.col("ts").alias("query_start"), F.col("props").alias("query"))
    out = advise.running_queries(activity)
    return out.select("pid", "user", "state", F.unix_timestamp(F.col("query_start").cast("timestamp")).alias("started"), "query")


_LOCK_COLUMNS = "pid, locktype, database, relation, page, tuple, virtualxid, transactionid, classid, objid, mode, granted"


@query(f"WITH {ov.values('locks', _LOCK_COLUMNS, fx.LOCKS)} SELECT CAST(a.pid AS INTEGER) AS blocked_pid, CAST(b.pid AS INTEGER) AS blocking_pid, a.locktype, a.mode AS wanted, b.mode AS held FROM locks a JOIN locks b ON a.pid <> b.pid AND NOT a.granted AND b.granted AND " + " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in advise.LOCK_KEYS))
def blocking_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advise.blocking_locks(_rows(spark, fx.LOCKS, fx.LOCKS_SCHEMA))


# --- differences, exports, edits, critique --------------------------------------------------------------------

_OLD = [("customer", "id", "bigint", True, None), ("customer", "name", "string", False, None), ("customer", "note", "string", False, "''"), ("customer", "age", "int", False, "0"), ("legacy", "id", "bigint", True, None), ("same", "x", "int", True, None)]
_NEW = [("customer", "id", "bigint", True, None), ("customer", "name", "varchar", True, None), ("customer", "age", "int", False, None), ("customer", "email", "string", True, "'n/a'"), ("fresh", "id", "bigint", True, None), ("fresh", "label", "string", False, None), ("same", "x", "int", True, None)]
_SIDE = "table_name string, name string, type string, not_null boolean, default_value string"
_SIDES = f"{ov.values('old_side', 'table_name, name, type, not_null, default_value', _OLD)}, {ov.values('new_side', 'table_name, name, type, not_null, default_value', _NEW)}"
_DIFF = """d AS (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.name, b.name) AS name,
CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.type IS NOT DISTINCT FROM b.type AND a.not_null IS NOT DISTINCT FROM b.not_null AND a.default_value IS NOT DISTINCT FROM b.default_value THEN 'unchanged' ELSE 'changed' END AS status,
a.type AS old_type, b.type AS new_type, a.not_null AS old_not_null, b.not_null AS new_not_null, a.default_value AS old_default_value, b.default_value AS new_default_value
FROM old_side a FULL JOIN new_side b ON a.table_name = b.table_name AND a.name = b.name)"""


def _sides(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return _rows(spark, _OLD, _SIDE), _rows(spark, _NEW, _SIDE)


@query(f"WITH {_SIDES}, {_DIFF} SELECT * FROM d")
def schema_diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.schema_diff(*_sides(spark))


@query(f"""
WITH {_SIDES}, {_DIFF}, ta AS (SELECT DISTINCT table_name FROM old_side), tb AS (SELECT DISTINCT table_name FROM new_side),
t AS (SELECT coalesce(ta.table_name, tb.table_name) AS table_name, CASE WHEN ta.table_name IS NULL THEN 'added' WHEN tb.table_name IS NULL THEN 'removed' ELSE 'unchanged' END AS ts FROM ta FULL JOIN tb ON ta.table_name = tb.table_name),
k AS (SELECT d.*, 'ALTER TABLE "public"."' || table_name || '"' AS alt, '"' || name || '"' AS col, '"' || name || '" ' || new_type || CASE WHEN new_not_null THEN ' NOT NULL' ELSE '' END || coalesce(' DEFAULT ' || new_default_value, '') AS def, ts FROM d JOIN t USING (table_name))
SELECT table_name, 1 AS step, 'CREATE TABLE "public"."' || table_name || '" (' || string_agg(def, ', ' ORDER BY name) || ');' AS statement FROM k WHERE ts = 'added' GROUP BY table_name
UNION ALL SELECT table_name, 9, '-- DROP TABLE "public"."' || table_name || '";' FROM t WHERE ts = 'removed'
UNION ALL SELECT table_name, 2, alt || ' ADD COLUMN ' || def || ';' FROM k WHERE ts = 'unchanged' AND status = 'added'
UNION ALL SELECT table_name, 8, '-- ' || alt || ' DROP COLUMN ' || col || ';' FROM k WHERE ts = 'unchanged' AND status = 'removed'
UNION ALL SELECT table_name, 3, alt || ' ALTER COLUMN ' || col || ' TYPE ' || new_type || ';' FROM k WHERE ts = 'unchanged' AND status = 'changed' AND old_type IS DISTINCT FROM new_type
UNION ALL SELECT table_name, 4, alt || ' ALTER COLUMN ' || col || CASE WHEN new_not_null THEN ' SET NOT NULL;' ELSE ' DROP NOT NULL;' END FROM k WHERE ts = 'unchanged' AND status = 'changed' AND old_not_null IS DISTINCT FROM new_not_null
UNION ALL SELECT table_name, 5, alt || ' ALTER COLUMN ' || col || CASE WHEN new_default_value IS NULL THEN ' DROP DEFAULT;' ELSE ' SET DEFAULT ' || new_default_value || ';' END FROM k WHERE ts = 'unchanged' AND status = 'changed' AND old_default_value IS DISTINCT FROM new_default_value
""")
def migration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark)
    return diff.migration(diff.schema_diff(old, new), diff.table_diff(old, new))


def _odd_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with names that need quoting, and a null."""
    name = F.when(F.col("n_nationkey") == 1, F.concat("n_name", F.lit(', "quoted" | piped'))).when(F.col("n_nationkey") == 2, F.concat("n_name", F.lit("'s\nline"))).when(F.col("n_nationkey") == 3, F.lit(None).cast("string")).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("n_name"), (F.col("n_regionkey") > 2).alias("far"))


_ODD = """odd AS (SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN n_name || ', "quoted" | piped' WHEN 2 THEN n_name || '''s' || chr(10) || 'line' WHEN 3 THEN NULL ELSE n_name END AS n_name, n_regionkey > 2 AS far FROM nation)"""


@query(f"""WITH {_ODD} SELECT n_nationkey || ',' || CASE WHEN regexp_matches(coalesce(n_name, ''), '[,"\\n]') THEN '"' || replace(n_name, '"', '""') || '"' ELSE coalesce(n_name, '') END || ',' || far AS line FROM odd""")
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.csv_lines(_odd_nations(spark, sf_dir))


@query(f"""WITH {_ODD} SELECT 'INSERT INTO "public"."nation" ("n_nationkey", "n_name", "far") VALUES (' || n_nationkey || ', ' || coalesce('''' || replace(n_name, '''', '''''') || '''', 'NULL') || ', ' || upper(CAST(far AS VARCHAR)) || ');' AS line FROM odd""")
def export_sql_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.insert_lines(_odd_nations(spark, sf_dir), "public", "nation")


@query(f"""WITH {_ODD} SELECT '| ' || n_nationkey || ' | ' || replace(replace(coalesce(n_name, ''), '|', '\\|'), chr(10), ' ') || ' | ' || far || ' |' AS line FROM odd""")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.markdown_lines(_odd_nations(spark, sf_dir))


@query("SELECT unnest(['nothing', 'never']) AS column")
def columnar_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({"nothing": F.lit(None).cast("string"), "never": F.when(F.col("o_orderkey") < 0, 1)})
    return exports.all_null_columns(orders)


@query("""
SELECT s_suppkey, 'update' AS action, 's_acctbal' AS column, CAST(s_acctbal AS VARCHAR) AS before, '1.5' AS after FROM supplier WHERE s_suppkey = 7 AND s_acctbal <> 1.5
UNION ALL SELECT s_suppkey, 'update', 's_name', s_name, 'Renamed' FROM supplier WHERE s_suppkey = 7
""")
def write_update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "supplier")
    after = write.update(before, {"s_suppkey": 7}, {"s_acctbal": 1.5, "s_name": "Renamed"})
    return write.cell_diff(before, after, ["s_suppkey"])


@query("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation WHERE n_nationkey <> 4")
def write_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write.delete(table(spark, sf_dir, "nation"), {"n_nationkey": 4}).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'ATLANTIS' UNION ALL SELECT 91, NULL")
def write_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write.insert(table(spark, sf_dir, "region"), [{"r_regionkey": 90, "r_name": "ATLANTIS"}, {"r_regionkey": 91}])


@query("""
WITH j AS (SELECT count(*) AS n FROM nation JOIN customer ON n_regionkey = c_nationkey % 5), t AS (SELECT greatest((SELECT count(*) FROM nation), (SELECT count(*) FROM customer)) AS largest)
SELECT 'join_fan_out' AS signal, n AS rows, largest FROM j, t WHERE n > 2 * largest
""")
def critique_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    joined = nation.join(customer, F.col("n_regionkey") == F.col("c_nationkey") % 5)
    return critique.fan_out(joined, {"nation": nation, "customer": customer})


@query(f"SELECT 'null_skipping_aggregate' AS signal, 'seg_or_null' AS column, count(*) - count(seg_or_null) AS skipped FROM {_NULLED}")
def critique_null_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.null_skipping(_with_nulls(spark, sf_dir), ["c_acctbal", "seg_or_null"])


@query("""
WITH v AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5)
SELECT 'zero_rows' AS signal, 'event_type' AS column, 'vanished' AS value, string_agg(event_type, ', ' ORDER BY n DESC, event_type) AS observed FROM v
""")
def critique_zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.observed_values(table(spark, sf_dir, "events"), "event_type", "vanished")


# --- what SQL passes through ----------------------------------------------------------------------------------

_SUM = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_SUM} AS price FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []]
    return df.groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(_money("l_extendedprice")).cast("double").alias("price"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    joined = counted.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.sum("c").alias("n"))


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr,
CAST(ntile(4) OVER w AS INTEGER) AS quartile, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, first_value(o_orderkey) OVER w AS first
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(4).over(w).alias("quartile"),
        F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"), F.first("o_orderkey").over(w).alias("first"),
    )


@query("""
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three,
count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events
""")
def window_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    hour = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-3600, 0)
    return events.select("event_id", F.sum(F.col("value").cast("decimal(18,4)")).over(rows).cast("double").alias("last_three"), F.count("*").over(hour).alias("last_hour"))


@query("WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t")
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, r_name FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1 UNION ALL SELECT 99, 'NOWHERE') r ON n_regionkey = r_regionkey")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").where("r_regionkey > 1").unionAll(_rows(spark, [(99, "NOWHERE")], "k int, n string"))
    return table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "full").select("n_nationkey", "r_name")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, sf_dir, "customer").select("c_custkey"))


@query("SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT CAST(avg(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) * 1.02 FROM part q WHERE q.p_brand = p.p_brand)")
def correlated_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mean = part.groupBy("p_brand").agg((F.avg(_money("p_retailprice")).cast("double") * 1.02).alias("bar"))
    return part.join(mean, "p_brand").where("p_retailprice > bar").select("p_partkey", "p_retailprice")


@query("""
WITH bands AS (SELECT * FROM (VALUES ('low', 0, 930), ('mid', 930, 970), ('high', 970, 100000)) b(band, lo, hi))
SELECT band, count(*) AS n FROM part JOIN bands ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band
""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _rows(spark, [("low", 0, 930), ("mid", 930, 970), ("high", 970, 100000)], "band string, lo int, hi int")
    return table(spark, sf_dir, "part").join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT p.event_id, (SELECT max(epoch_us(c.ts)) FROM c WHERE c.user_id = p.user_id AND c.ts <= p.ts) AS last_click FROM p
""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click before each purchase: both kinds in one sorted window, without a join."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "click", micros)).over(w)
    return events.withColumn("last_click", last).where("event_type = 'purchase'").select("event_id", "last_click")


@query("SELECT p_partkey, CAST(i AS INTEGER) AS place, w FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part) t, LATERAL (SELECT unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w)")
def lateral_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "w"))
    return exploded.select("p_partkey", (F.col("place") + 1).alias("place"), "w")


@query("SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS many, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) = max(l_shipdate) AS one_day FROM lineitem GROUP BY 1")
def aggregate_filter_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("many"), F.countDistinct("l_suppkey").alias("suppliers"), (F.min("l_shipdate") == F.max("l_shipdate")).alias("one_day"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS median, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def ordered_set_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.5), 4).alias("median"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return p.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


@query("SELECT event_type, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1")
def json_valid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull())
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(table(spark, sf_dir, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query(None)
def plan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the flagship query's plan, as it ran."""
    from tidewell.plans import analysis

    found = analysis.metrics(revenue_by_segment(spark, sf_dir))
    rows = [("plan", f"{found['scans']} scans, {found['exchanges']} exchanges, {found['joins']} joins")] + [(f["severity"], f["what"]) for f in analysis.findings(found)]
    return _rows(spark, rows, "severity string, what string")


@query("SELECT o_orderkey, o_totalprice, '<redacted>' AS who FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def lineage_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over an aliased and computed private column: masked by lineage, not by name."""
    from tidewell.plans.lineage import tainted_outputs

    orders, customer = table(spark, sf_dir, "orders").alias("orders"), table(spark, sf_dir, "customer").alias("customer")
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 200000").select("o_orderkey", "o_totalprice", F.upper(F.concat(F.lit("x"), F.col("c_name"))).alias("who"))
    return select.mask(df, tainted_outputs(df, {("customer", "c_name")}))


@query("SELECT o_orderkey AS id, '<redacted>' AS note, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def write_insert_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preview of an INSERT of a query shows: all that depends on a protected column is masked."""
    from tidewell.plans.lineage import tainted_outputs

    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    new = spark.sql("SELECT o_orderkey AS id, upper(c_name) || '!' AS note, o_orderstatus AS status FROM orders o JOIN customer c ON o_custkey = c_custkey")
    return select.mask(new, tainted_outputs(new, policy.Policy("write", pii_columns=("public.customer.c_name",)).protected))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS INTEGER) % 10 = 0")
def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders, the same ones on every run and for every partitioning."""
    rows = table(spark, sf_dir, "orders")
    place = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int") % 10
    return rows.where(place == 0).select("o_orderkey", "o_totalprice")


@query("""
SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
WHERE k <= ceil(n / 100.0)
""")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in a hundred of each status, at least one: exactly that many, by least hash."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    sizes = rows.groupBy("o_orderstatus").agg(F.ceil(F.count("*") / 100).alias("most"))
    w = Window.partitionBy("o_orderstatus").orderBy("h")
    ranked = rows.withColumn("k", F.row_number().over(w)).join(F.broadcast(sizes), "o_orderstatus")
    return ranked.where("k <= most").select("o_orderstatus", "o_orderkey")


@query("SELECT c_custkey, CAST(list_sum(list_transform(string_split(CAST(c_custkey AS VARCHAR), ''), lambda d: CAST(d AS BIGINT) * CAST(d AS BIGINT))) AS BIGINT) AS squares FROM customer")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own over Arrow batches: the sum of the squared digits of a key."""

    @F.pandas_udf("long")
    def squares(keys: pd.Series) -> pd.Series:
        return keys.astype(str).map(lambda text: sum(int(d) ** 2 for d in text))

    return table(spark, sf_dir, "customer").select("c_custkey", squares("c_custkey").alias("squares"))


@query("SELECT n_nationkey, r_name, upper(n_name) || '!' AS loud FROM nation JOIN region ON n_regionkey = r_regionkey")
def udf_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own called from SQL: registered by name in SQL itself, so it stays in generated code."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION loud(s STRING) RETURNS STRING RETURN upper(s) || '!'")
    for t in ("nation", "region"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"udf_{t}")
    return spark.sql("SELECT n_nationkey, r_name, loud(n_name) AS loud FROM udf_nation JOIN udf_region ON n_regionkey = r_regionkey")
