"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs, by DataFrame functions alone.

Every paragraph is hashed to a wide vector, and a document's vector is the sum over its paragraphs, element by element
modulo a power of two. So the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector (``add_vectors``, ``subtract_vectors``) without the rest of the text. The elements are:

* one count of paragraphs and four words of two 64-bit hashes, modulo 2**32: 128 uniform bits that tell multisets apart;
* ``2 * SHIFTS`` bits of each hash, two to an element of 62 bits, each in a field of 31 bits: counts of set bits. A text has at
  most 2**31 bytes, so fewer than 2**30 paragraphs, and no count reaches the next field.

The counts, read as sums of +1 and -1, are a random projection of the multiset, so the inner product of two documents'
counts estimates how many paragraphs they share. ``likeness`` is twice that product over the sum of both squares, cut to 0 to 1;
it is exactly 1 for equal fingerprints and scatters by about 0.1 around 0 for unrelated texts.

Paragraphs are cut at line ends and, as many texts have one line only, after sentence ends; empty ones do not count. Null texts
count as empty: no paragraphs, all elements zero. Rows keep their number, repeated rows too; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import documents, inputs, materialize

PARAGRAPH_END = r"[\r\n]+|(?<=[.!?])[ \t]+"
SHIFTS, FIELD = 30, 31
_BITS = 1 | 1 << FIELD
_WORD, _ELEMENT, _COUNT = (1 << 32) - 1, (1 << 2 * FIELD) - 1, (1 << FIELD) - 1

#: Rows of one range of the order, about; there are as many ranges as that takes.
RANGE_ROWS = 50_000


def _sum(hashes: str, part: str, modulus_mask: int) -> str:
    """SQL for the sum of a part of each hash h. As text, since building hundreds of expressions one by one takes seconds."""
    return f"aggregate({hashes}, 0L, (a, h) -> (a + ({part})) & {modulus_mask}L)"


def with_vector(df: DataFrame, text: str, vector: str) -> DataFrame:
    """Adds the vector (array<long>) of a column of texts."""
    first, second = f"__{vector}_first", f"__{vector}_second"
    paragraphs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), PARAGRAPH_END), lambda p: p != "")
    df = df.withColumn(first, paragraphs)
    df = df.withColumn(second, F.transform(first, lambda p: F.xxhash64(F.lit("second"), p))).withColumn(first, F.transform(first, lambda p: F.xxhash64(p)))
    words = [f"cast(size(`{first}`) as bigint)"]
    for h in (first, second):
        words += [_sum(f"`{h}`", f"h & {_WORD}L", _WORD), _sum(f"`{h}`", "shiftrightunsigned(h, 32)", _WORD)]
    bits = [_sum(f"`{h}`", f"shiftright(h, {j}) & {_BITS}L", _ELEMENT) for h in (first, second) for j in range(SHIFTS)]
    return df.withColumn(vector, F.expr(f"array({', '.join(words + bits)})")).drop(first, second)


def _masked(vector: Column) -> Column:
    return F.transform(vector, lambda x, i: x.bitwiseAND(F.when(i < 5, F.lit(_WORD)).otherwise(F.lit(_ELEMENT))))


def add_vectors(a: Column, b: Column) -> Column:
    """The vector of both multisets together."""
    return _masked(F.zip_with(a, b, lambda x, y: x + y))


def subtract_vectors(a: Column, b: Column) -> Column:
    """The vector of a's multiset without b's, which it must contain."""
    return _masked(F.zip_with(a, b, lambda x, y: x - y))


def fingerprint_of(vector: Column) -> Column:
    """The vector as lowercase hexadecimal digits."""
    return F.lower(F.array_join(F.transform(vector, lambda x, i: F.when(i < 5, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(x), 16, "0"))), ""))


def with_counts(df: DataFrame, vector: str, counts: str) -> DataFrame:
    """Adds the centred counts of set bits: twice the count less the number of paragraphs."""
    fields = [f"(shiftright(`{vector}`[{i}], {FIELD * k}) & {_COUNT}L) * 2 - `{vector}`[0]" for i in range(5, 5 + 2 * SHIFTS) for k in range(2)]
    return df.withColumn(counts, F.expr(f"array({', '.join(fields)})"))


def likeness(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """How much two documents' multisets agree, from their vectors and centred counts."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)

    squares = dot(counts_a, counts_a) + dot(counts_b, counts_b)
    return F.when(a == b, 1.0).when(squares == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(counts_a, counts_b) / squares)))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, vector, fingerprint of every row."""
    return with_vector(inputs(docs, id_col, text_col), "text", "vector").select("doc_id", "vector", fingerprint_of(F.col("vector")).alias("fingerprint"))


def _place() -> Column:
    """A row's place in the order: null ids first, then doc_id, then the first seven bytes of the text as a number and a hash of all of it."""
    head = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("id"), head.alias("head"), F.xxhash64("text").alias("hash"))


def _range_of(bounds: Column, n: Column, place: Column, most: int) -> Column:
    """The last of the ascending bounds that is at most ``place``, counted from 0: a binary search in a fixed number of steps."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.element_at(bounds, middle + 1) <= place
        return F.struct(F.when(low, middle).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda s: s["lo"])


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<column> of the next row by ascending doc_id (null ids first; after the last row: the first).

    Rows of one id follow each other by the beginning of their texts and then by a hash of them, so rows of a repeated id are split over
    ranges like others. Spark's own range partitioning of places alone gives the first place of each range: 32 bytes for
    ``RANGE_ROWS`` rows, which is what each task gets to know. Then the rows are dealt to their ranges, the first row of a range to the range
    before it too: texts are shuffled once and no task sees more than its range.
    """
    spark = docs.sparkSession
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    places = docs.select(_place().alias("place"))
    firsts = places.repartitionByRange(n_ranges, "place").groupBy(F.spark_partition_id().alias("range")).agg(F.min("place").alias("place"))
    # written once, so all tasks search the same bounds, whatever is computed again
    bounds = materialize(firsts.agg(F.sort_array(F.collect_list("place")).alias("bounds")), "bounds").scalar()
    n = F.size("__bounds")
    placed = docs.withColumn("__bounds", bounds).withColumn("__place", _place())
    placed = placed.withColumn("__range", _range_of(F.col("__bounds"), n, F.col("__place"), n_ranges))
    is_first = F.element_at("__bounds", F.col("__range") + 1) == F.col("__place")
    own, copy = F.struct(F.lit(False).alias("__copy"), F.col("__range").alias("__at")), F.struct(F.lit(True).alias("__copy"), F.pmod(F.col("__range") - 1, n).alias("__at"))
    dealt = placed.withColumn("__to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).select(*docs.columns, "__to.__copy", "__to.__at")
    # a stated number of partitions: what follows costs more than its bytes tell, so they must not be coalesced by size
    dealt = dealt.repartition(n_ranges, "__at")
    w = Window.partitionBy("__at").orderBy("__copy", _place())
    out = dealt.select(*docs.columns, "__copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return out.where("NOT __copy").drop("__copy")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to each other and to the next document's."""
    docs = inputs(documents(spark, sf_dir))
    # texts alone are shuffled: a text's vector is computed again where it is the next one, which costs less than carrying it
    df = with_vector(with_vector(with_next(docs, ["text"]), "text", "vector"), "next_text", "next_vector")
    df = df.select("doc_id", "vector", "next_vector", F.length("text").cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 4) as int))")).alias("edited"))
    df = with_vector(df, "edited", "edited_vector")
    for v in ("vector", "edited_vector", "next_vector"):
        df = with_counts(df, v, f"{v}_counts")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_of(F.col("vector")).alias("fingerprint"), fingerprint_of(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(*(F.col(c) for c in ("vector", "edited_vector", "vector_counts", "edited_vector_counts"))).alias("near_edited"),
        likeness(*(F.col(c) for c in ("vector", "next_vector", "vector_counts", "next_vector_counts"))).alias("near_next"),
    )
