"""A corpus in five stages, from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into the
shared folder and gives what it reads back to the next one. All but the last return the columns of documents. An empty
table goes through all stages.

1. language_id: documents whose language is rejected go; models learn from the rows outside the held-out fold.
2. near_dedup: of each component of texts whose five-word shingles have a Jaccard similarity of at least 0.8 the document of
   least doc_id stays. A row without doc_id is one like others and comes after those that have one. Where different texts have one
   doc_id each is judged by itself; of rows with one doc_id and one text one stays, the least in lang, source and n_chars.
3. substring_dedup: windows of words that also start elsewhere are cut; texts that lose nothing stay as they are.
4. pii: personal values become pseudonyms, by the key that the session names (``pseudonyms.KEY_SETTING``).
5. packing: pieces of token ids with their places in sequences of at most 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language_id, packing, pseudonyms, shingle_join, substring_dedup
from tidewell.llm.common import discard, materialize, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source")
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is accepted as one of the learned languages.

    Null, empty and letterless texts are rejected and go, very long ones are judged whole. Each row is judged by its text alone, so
    equal texts stay or go together, whatever their ids. Without any lang all rows go.
    """
    identifier = language_id.fit(docs.select("doc_id", "text", "lang").where(language_id.fold("doc_id", 3) != 1))
    return _columns(language_id.identify(docs, identifier, carry=CARRIED + ("text",)).where("accepted"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts, see above; which one does not depend on the order of rows.

    Texts without a word, null ones too, are one component. Texts of fewer words than a shingle are one shingle.
    """
    first = shingle_join.similar_rows(docs, SHINGLE).where("doc_id <=> least.doc_id AND h = least.h")
    first = materialize(first.groupBy(F.col("doc_id").alias("id"), "h").agg(F.count("*").alias("rows")), "kept")
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(first, keyed.doc_id.eqNullSafe(first.id) & (keyed.h == first.h)).select(*COLUMNS, first.h.alias("h"), "rows")
    if first.where("rows > 1").isEmpty():
        return kept.select(*COLUMNS)
    # rows of one id and one text: the one that is least in its other columns
    again = kept.where("rows > 1").groupBy("doc_id", "h").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return kept.where("rows = 1").select(*COLUMNS).unionByName(again.select("doc_id", "r.*"))


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without words in repeated windows; null texts become empty. Rows of one id are documents of their own."""
    return _columns(substring_dedup.dedup_substrings(docs, carry=CARRIED, keep_whole=True))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal values replaced; null texts become empty, ids are not looked at."""
    return _columns(pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark), carry=CARRIED))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places; a null or empty text is one piece of the end id, rows of one id have pieces each."""
    import public_tokenizers

    pieces, places = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.placed(pieces, places)


STAGES = [
    ("language_id", stage_language_id),
    ("near_dedup", stage_near_dedup),
    ("substring_dedup", stage_substring_dedup),
    ("pii", stage_pii),
    ("packing", stage_packing),
]



def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of sf_dir; what the stages before it wrote is deleted once it is read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as spared:  # what the stage's operators kept for their own use goes once its rows are written
            out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
            spared.append(out)
        if before is not None:
            discard(before)
        docs = before = out
    return docs


#: No stage but the selection of columns can be said in SQL; tests compare with brute force.
ORACLE_SQL = None
