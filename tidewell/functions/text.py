"""Words of names and texts as column expressions: splitting, stems, abbreviations, fuzzy likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations and the words that they stand for
ABBREVIATIONS = {
    "qty": ["quantity"],
    "amt": ["amount"],
    "dt": ["date"],
    "addr": ["address"],
    "org": ["organization"],
    "usr": ["user"],
    "desc": ["description"],
    "num": ["number"],
    "fk": ["foreign", "key"],
    "pk": ["primary", "key"],
}

# fixed values: words that a search may take for each other
SYNONYMS = {
    "customer": ["user", "client", "buyer", "member"],
    "user": ["customer", "client", "member", "account"],
    "order": ["purchase", "transaction", "sale", "deal"],
    "purchase": ["order", "transaction", "sale"],
    "revenue": ["amount", "price", "sales", "payment", "income"],
    "payment": ["revenue", "charge", "invoice"],
    "product": ["item", "goods", "sku"],
    "item": ["product", "goods"],
    "auth": ["login", "credential", "user"],
    "config": ["setting", "preference", "option"],
}

#: Comments' parentheses count as synonyms up to these sizes.
PARENTHESIS_CHARACTERS, PARENTHESIS_WORDS = 25, 2


def stem(word: Column) -> Column:
    """Cuts a plural ending: ies to y; es unless after ss, sh or ch; s unless in ss, us or as."""

    def cut(n: int) -> Column:
        return F.substring(word, F.lit(1), F.length(word) - n)

    return F.when(word.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(word.endswith("es") & ~word.rlike("(ss|sh|ch)es$"), cut(2)).when(word.endswith("s") & ~word.rlike("(s|u|a)s$"), cut(1)).otherwise(word)


def spaced(text: Column) -> Column:
    """A space between lower and upper case, and between letters and digits."""
    out = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(out, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")


def words(text: Column) -> Column:
    """The lower-cased words of a name: cut between lower and upper case, letters and digits, and at all else.

    Words of one character count only if it is a digit. Null gives null.
    """
    return F.filter(F.split(F.lower(F.regexp_replace(spaced(text), "[^A-Za-z0-9]", " ")), " +"), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))


def tokenize(text: Column) -> Column:
    """Words with abbreviations written out, stemmed: what postings and queries are made of."""
    expansions = F.create_map(*[x for short, long in ABBREVIATIONS.items() for x in (F.lit(short), F.array(*map(F.lit, long)))])
    expanded = F.flatten(F.transform(words(text), lambda w: F.coalesce(F.try_element_at(expansions, w), F.array(w))))
    return F.transform(expanded, stem)


def mined_synonyms(comment: Column) -> Column:
    """Names that a comment gives: what follows "aka" or "also known as", and short plain parentheses."""
    named = F.regexp_extract_all(comment, F.lit(r"(?i)(?<![A-Za-z0-9])(?:aka|also known as)\s*([A-Za-z_][A-Za-z0-9_]*)"), 1)
    inside = F.transform(F.regexp_extract_all(comment, F.lit(r"\(([^)]*)\)"), 1), F.trim)
    short = F.filter(inside, lambda p: (F.length(p) > 0) & (F.length(p) <= PARENTHESIS_CHARACTERS))
    plain = F.transform(short, lambda p: F.trim(F.regexp_replace(p, "(?i)^(?:aka|also known as) ", "")))
    kept = F.filter(plain, lambda p: p.rlike(r"^[A-Za-z0-9_\-\s]+$") & (F.size(F.split(F.trim(p), r"\s+")) <= PARENTHESIS_WORDS))
    return F.array_distinct(F.concat(named, kept))


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def fuzzy_score(a: Column, b: Column) -> Column:
    """100 for equal words, 75 if one text holds the other, else 60 times the share of common words."""
    x, y = plain_words(a), plain_words(b)
    s, t = F.array_join(x, " "), F.array_join(y, " ")
    common = F.size(F.array_intersect(x, y))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((s == "") | (t == ""), 0.0).when(s == t, 100.0).when((F.instr(s, t) > 0) | (F.instr(t, s) > 0), 75.0).otherwise(60.0 * common / most)


def table_name_variants(prefix: Column) -> Column:
    """Table names that a column prefix (customer of customer_id) may mean, for an equi-join."""
    plural = F.when(prefix.endswith("y"), F.concat(F.regexp_replace(prefix, "y$", ""), F.lit("ies")))
    return F.array_distinct(F.array_compact(F.array(prefix, F.concat(prefix, F.lit("s")), F.concat(prefix, F.lit("es")), plural)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if sizes differ or a norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)
