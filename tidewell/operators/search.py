"""Searching a schema: weighted postings, synonyms, values, vectors and their fusion, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.text import ABBREVIATIONS, SYNONYMS, cosine, mined_synonyms, spaced, tokenize
from tidewell.operators import nearest

# fixed values: how much a word counts by where it stands
NAME, COLUMN, KEY_COLUMN, COMMENT, COLUMN_COMMENT = 3.0, 1.0, 1.25, 0.5, 0.3
SYNONYM_SHARE, BACKUP_PENALTY, VALUE_BOOST = 0.7, 1.0, 2.0
BACKUP_NAMES = "audit|_bak|_tmp|backup"
RRF_K, RRF_MISSING = 60, 10_000
TOP = 10


def postings(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """token, ref, weight: the most that a word counts for an object."""

    def stream(df: DataFrame, text: Column, weight: Column) -> DataFrame:
        return df.select("ref", F.explode(tokenize(F.coalesce(text, F.lit("")))).alias("token"), weight.alias("weight"))

    parts = [
        stream(objects, F.col("name"), F.lit(NAME)),
        stream(objects, F.col("comment"), F.lit(COMMENT)),
        stream(columns, F.col("name"), F.when(F.col("is_pk"), KEY_COLUMN).otherwise(COLUMN)),
        stream(columns, F.col("comment"), F.lit(COLUMN_COMMENT)),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out.groupBy("token", "ref").agg(F.max("weight").alias("weight"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.countDistinct("ref").alias("df"))


def synonyms(spark: SparkSession, objects: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """token, synonym: the built-in ones and, both ways, those that comments give for names."""
    built_in = spark.createDataFrame([(head, s) for head, some in SYNONYMS.items() for s in some], "token string, synonym string")
    if objects is None:
        return built_in
    named = objects.select("name", "comment")
    if columns is not None:
        named = named.unionAll(columns.select("name", "comment"))
    pairs = (
        named.where(F.col("comment").isNotNull())
        .select("name", F.explode(mined_synonyms(F.col("comment"))).alias("phrase"))
        .select(F.explode(tokenize(F.col("name"))).alias("token"), "phrase")
        .select("token", F.explode(tokenize(F.col("phrase"))).alias("synonym"))
        .where(F.col("token") != F.col("synonym"))
    )
    return built_in.unionAll(pairs).unionAll(pairs.select(F.col("synonym").alias("token"), F.col("token").alias("synonym"))).distinct()


def query_terms(queries: DataFrame, syn: DataFrame) -> DataFrame:
    """query, origin, token, share: the words of each query and their discounted synonyms."""
    own = queries.select("query", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("origin"))
    also = own.join(syn, own.origin == syn.token).select("query", "origin", F.col("synonym").alias("token"), F.lit(SYNONYM_SHARE).alias("share"))
    return own.select("query", "origin", F.col("origin").alias("token"), F.lit(1.0).alias("share")).unionAll(also)


def lexical_scores(queries: DataFrame, posts: DataFrame, syn: DataFrame, n_objects: Column | int) -> DataFrame:
    """query, ref, score: sums of weight x ln(1 + N / df), with names of backups held back.

    Queries and synonyms are few and postings many, so the terms are the small side of the join.
    """
    terms = query_terms(queries, syn)
    n = F.lit(n_objects) if isinstance(n_objects, int) else n_objects
    n = F.when(n == 0, 100).otherwise(n)
    frequent = posts.groupBy("token").agg(F.countDistinct("ref").alias("df"))
    hits = terms.join(posts, "token").join(frequent, "token")
    summed = hits.groupBy("query", "ref").agg(F.sum(F.col("share") * F.col("weight") * F.log(1 + n / F.col("df"))).alias("raw"))
    score = F.greatest(F.lit(0.0), F.col("raw") - F.when(F.lower("ref").rlike(BACKUP_NAMES), BACKUP_PENALTY).otherwise(0.0))
    return summed.select("query", "ref", score.alias("score"))


def _forms(token: str) -> list[str]:
    """All lower-cased words that ``tokenize`` may turn into a token: its plurals and abbreviations."""
    forms = {token, token + "s", token + "es"} | ({token[:-1] + "ies"} if token.endswith("y") else set())
    return sorted(forms | {short for short, long in ABBREVIATIONS.items() if token in long or any(f in long for f in forms)})


def term_counts(docs: DataFrame, asked: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, token, n: how often each asked token is in each text.

    Texts become rows of words first, and only words that can be an asked token go through stemming, as plain columns in
    generated code; counts are combined before they are shuffled.
    """
    forms = sorted({f for a in asked for f in _forms(a)})
    words = docs.select(id_col, F.explode(F.split(F.lower(spaced(F.col(text_col))), "[^a-z0-9]+")).alias("w")).where(F.col("w").isin(forms))
    tokens = words.groupBy(id_col, "w").agg(F.count("*").alias("c")).select(id_col, "c", F.explode(tokenize(F.col("w"))).alias("token"))
    return tokens.where(F.col("token").isin(asked)).groupBy(id_col, "token").agg(F.sum("c").alias("n"))


def with_value_boost(scores: DataFrame, queries: DataFrame, values_index: DataFrame) -> DataFrame:
    """Adds a boost for every word of the query that is a value of some column of the object."""
    own = queries.select("query", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("token"))
    boosts = own.join(values_index, "token").groupBy("query", "ref").agg((F.count("*") * VALUE_BOOST).alias("boost"))
    joined = scores.join(boosts, ["query", "ref"], "full")
    return joined.select("query", "ref", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def ranked(scores: DataFrame, by: list[str], k: int = TOP) -> DataFrame:
    """The k best of each group, ties by ref."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "ref")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, objects: DataFrame, columns: DataFrame, syn: DataFrame, k: int = TOP, values_index: DataFrame | None = None) -> DataFrame:
    """query, ref, kind, score, rank: excluded objects never appear; a query without words finds nothing."""
    n = objects.where(F.col("kind") == "table").count()
    return search_postings(queries, postings(objects, columns), syn, objects, n, k, values_index)


def search_postings(queries: DataFrame, posts: DataFrame, syn: DataFrame, objects: DataFrame, n_tables: int, k: int = TOP, values_index: DataFrame | None = None, embeddings: DataFrame | None = None, embed=None) -> DataFrame:
    """The same over postings that are there already, and fused with vectors if there are some."""
    shown = objects.where(~F.col("excluded"))
    scores = lexical_scores(queries, posts, syn, n_tables)
    if values_index is not None:
        scores = with_value_boost(scores, queries, values_index)
    scores = scores.where("score > 0")
    if embeddings is not None:
        scores = hybrid_search(queries, scores, embeddings, shown, k, embed or hashed_embedding).drop("rank")
    return ranked(scores.join(shown.select("ref", "kind"), "ref"), ["query"], k).select("query", "ref", "kind", "score", "rank")


def cosine_top(vectors: DataFrame, probes: DataFrame, k: int, block: int = 256, tile: int = 4096) -> DataFrame:
    """probe_id, vec_id, score, rank: the k most similar vectors of each probe, itself left out.

    Each ``tile`` of vectors meets each ``block`` of probes in a matrix product, and what may be among the best is scored again in
    the order of its elements (``nearest``). Sizes that differ and zero norms score 0; nulls come last. k rows a probe and task are shuffled.
    """
    scored = nearest.scored(vectors, probes, k, block, tile)
    w = Window.partitionBy("probe_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_fusion(first: DataFrame, second: DataFrame, key: str = "ref") -> DataFrame:
    """Reciprocal rank fusion of two rankings (key, rank from 0); a missing rank counts as RRF_MISSING."""
    a, b = first.select(key, F.col("rank").alias("rank_a")), second.select(key, F.col("rank").alias("rank_b"))

    def part(rank: str) -> Column:
        return 1.0 / (RRF_K + F.coalesce(F.col(rank), F.lit(RRF_MISSING)))

    return a.join(b, key, "full").select(key, (part("rank_a") + part("rank_b")).alias("score"))


def values_index(profiles_top: DataFrame) -> DataFrame:
    """token, ref, col: which columns hold a word among their common values (columns ref, col, value)."""
    return profiles_top.select("ref", "col", F.explode(tokenize(F.col("value"))).alias("token")).distinct().select("token", "ref", "col")


def embedding_document(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """ref, document: the text that an embedder gets for tables and views."""
    cols = columns.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "type"))), lambda c: F.concat(c["name"], F.lit(" "), c["type"])), ", ").alias("cols"))
    kept = objects.where(F.col("kind").isin("table", "view", "matview")).join(cols, "ref", "left")
    return kept.select("ref", F.concat_ws("\n", F.concat(F.upper("kind"), F.lit(": "), "ref"), F.when(F.col("comment").isNotNull(), F.concat(F.lit("Description: "), "comment")), F.concat(F.lit("Columns: "), "cols"), F.when(F.size("primary_key") > 0, F.concat(F.lit("Primary key: "), F.array_join("primary_key", ", ")))).alias("document"))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of the words' hashes. Each word is hashed once."""
    bucket = F.transform(tokenize(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    return F.aggregate(bucket, F.array_repeat(F.lit(0.0), size), lambda v, w: F.concat(F.slice(v, F.lit(1), w["at"]), F.array(F.element_at(v, w["at"] + 1) + w["sign"]), F.slice(v, w["at"] + 2, F.lit(size))))


def build_embeddings(documents: DataFrame, hashes: DataFrame, old: DataFrame | None = None, embed=hashed_embedding, model: str = "hashed-words", size: int = 64) -> DataFrame:
    """ref, object_hash, model, dim, vector: objects whose hash and model are unchanged keep their vectors, others are embedded.

    ``embed`` is a column function of a text and a size; a model behind a pandas UDF fits as well.
    """
    current = documents.join(hashes, "ref")
    fresh, kept = current, None
    if old is not None:
        same = old.where(F.col("model") == model).select("ref", "object_hash", "vector")
        kept = current.join(same, ["ref", "object_hash"]).select("ref", "object_hash", "vector")
        fresh = current.join(same, ["ref", "object_hash"], "left_anti")
    out = fresh.select("ref", "object_hash", embed(F.col("document"), size).alias("vector"))
    out = out if kept is None else out.unionByName(kept)
    return out.select("ref", "object_hash", F.lit(model).alias("model"), F.lit(size).alias("dim"), "vector")


def hybrid_search(queries: DataFrame, lexical: DataFrame, embeddings: DataFrame, allowed: DataFrame, k: int = TOP, embed=hashed_embedding, size: int = 64) -> DataFrame:
    """query, ref, score, rank: lexical scores (query, ref, score) and cosines of vectors, fused by rank.

    Both lists hold allowed objects only, so a denied one cannot come in through its vector.
    """
    asked = queries.select("query", embed(F.col("query"), size).alias("probe"))
    near = embeddings.join(allowed.select("ref"), "ref").join(F.broadcast(asked)).select("query", "ref", cosine(F.col("vector"), F.col("probe")).alias("score")).where("score > 0")
    lists = [ranked(x.join(allowed.select("ref"), "ref"), ["query"], 100).select("query", "ref", (F.col("rank") - 1).alias("rank")) for x in (lexical, near)]
    a, b = lists[0].withColumnRenamed("rank", "rank_a"), lists[1].withColumnRenamed("rank", "rank_b")

    def part(rank: str) -> Column:
        return 1.0 / (RRF_K + F.coalesce(F.col(rank), F.lit(RRF_MISSING)))

    return ranked(a.join(b, ["query", "ref"], "full").select("query", "ref", (part("rank_a") + part("rank_b")).alias("score")), ["query"], k)
