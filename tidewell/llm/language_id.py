"""Language ID: interpolated Kneser-Ney character language models, one a language, in shared sorted hash arrays.

The models are of order ``ORDER`` and see one word at a time, between two word ends written as spaces: words are what ASCII
white space separates. So a distinct word is scored once a batch, and a text's cross-entropy is the sum over its words
divided by the characters predicted (word ends count). The language of least cross-entropy wins; ties go to the first by name.

Fitting takes a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` whole texts and about ``SAMPLE_BYTES`` characters a language,
different texts of least hash, which bounds the model of a language. All languages are learned, ``SIDE`` of them side by side in one
table, so the model grows with their number and no more. Four of five of them are counted, the others calibrate: the temperature that makes the softmax of negative
cross-entropies most likely, and for each language how high its own texts come. That is judged by a text's distinct words, each
in the language that fits it best: so words said over and over and passages in another learned language do not count against a
text. A text is rejected if it lies further above its language's median than ``REJECT_AT`` deviations (of texts, or of characters
over the root of its length) and than nearly all calibrating texts of that language. Texts of other languages have no say in it.
Letters count in lower case, signs around a word do not; words without a letter or with a digit tell nothing of the language
and do not count, unless a text has no others.

Null texts and texts without a letter are ``und`` with score 0 and rejected. With no labelled row at all every text is. Rows
keep their number, also where doc_id is null or repeats; equal texts have equal predictions. lang, source and doc_id never reach one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.blocks import words_of
from tidewell.llm.common import bounded_sample, carried, column, documents, inputs, map_batches, mix64, release, typed

ORDER, SAMPLE_DOCS, SAMPLE_BYTES, REJECT_AT = 5, 1_000, 8 << 20, 6.0
#: Languages whose tables stand side by side, and texts that fitting reads at a time.
SIDE, PART = 8, 64
#: Text bytes that are scored at a time.
SCORED_BYTES = 3 << 20

_ROOTS = mix64(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, each between two blanks, and every character's place in its word."""
    if not len(words):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    points = np.frombuffer((" " + "  ".join(words.to_pylist()) + " ").encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return points, place


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts in lower case and without signs around them, and how many end with each text."""
    words, ends = words_of(pc.utf8_lower(texts))
    bare = pc.replace_substring_regex(words.dictionary, r"^[^\p{L}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")
    return pa.DictionaryArray.from_arrays(words.indices, pc.if_else(pc.equal(pc.binary_length(bare), 0), words.dictionary, bare)), ends


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` characters that end at each place; only those within a word are of use."""
    total = np.zeros(len(points), np.uint64)
    for j in range(min(order, len(points))):
        total[j:] += (points[: len(points) - j].astype(np.uint64) + np.uint64(1)) * _ROOTS[j]
    return mix64(total + np.uint64(order))


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, weights, len(distinct))


class OneLanguage:
    """Kneser-Ney tables of one language: for each order its grams with log probabilities, its contexts with log weights."""

    def __init__(self, words: pa.Array, counts: np.ndarray, alphabet: int, order: int = ORDER):
        points, place = _characters(words)
        weight = np.repeat(counts, pc.utf8_length(words).to_numpy().astype(np.int64) + 2).astype(float) if len(words) else np.empty(0)
        hashes = [None, *(_grams(points, k) for k in range(1, order + 2))]
        self.grams, self.logs, self.contexts, self.weights = [], [], [], []
        below_keys, below = None, None
        for k in range(1, order + 1):
            own = place >= max(1, k - 1)
            first = np.zeros(len(points), bool) if k == 1 else own & (place == k - 1)
            if k == order:
                keys, c = _counted(hashes[k][own], weight[own])
            else:
                # how many different characters stand before; grams at a word's start keep their counts
                at = np.flatnonzero(own & ~first & (place >= k))
                at = at[np.unique(hashes[k + 1][at], return_index=True)[1]]
                k1, k2 = hashes[k][at], hashes[k][first]
                keys, c = _counted(np.concatenate([k1, k2]), np.concatenate([np.ones(len(k1)), weight[first]]))
            at = np.flatnonzero(own)
            at = at[np.unique(hashes[k][at], return_index=True)[1]]  # one place of each gram, ascending by hash as keys are
            context = np.zeros(len(at), np.uint64) if k == 1 else hashes[k - 1][at - 1]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            contexts, where = np.unique(context, return_inverse=True)
            total, followers = np.bincount(where, c, len(contexts)), np.bincount(where, minlength=len(contexts))
            backoff = discount * followers / total
            lower = np.full(len(at), 1 / alphabet) if k == 1 else below[np.searchsorted(below_keys, hashes[k - 1][at])]
            p = (c - np.minimum(discount, c)) / total[where] + backoff[where] * lower
            self.grams.append(keys)
            self.logs.append(np.log(p))
            self.contexts.append(contexts)
            self.weights.append(np.log(backoff))
            below_keys, below = keys, p


def _aligned(keys: list[np.ndarray], values: list[np.ndarray], missing: float) -> tuple[np.ndarray, np.ndarray]:
    """All keys, ascending, and a column of values for each list."""
    union = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    table = np.full((len(union), len(keys)), missing, np.float32)
    for j, (k, v) in enumerate(zip(keys, values, strict=True)):
        table[np.searchsorted(union, k), j] = v
    return union, table


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Model:
    """All languages' tables side by side; a gram that some language has not seen holds its backed-off value there."""

    def __init__(self, names: list[str], words: list[pa.Array], counts: list[np.ndarray], order: int = ORDER, alphabet: int | None = None):
        self.names, self.order = names, order
        texts = pa.chunked_array(words).combine_chunks() if words else pa.array([], pa.string())
        points, place = _characters(texts)
        self.alphabet = alphabet or len(np.unique(points)) + 1
        models = [OneLanguage(w, c, self.alphabet, order) for w, c in zip(words, counts, strict=True)]
        self.grams, self.logs, self.contexts, self.weights = [], [], [], []
        for k in range(1, order + 1):
            contexts, weights = _aligned([m.contexts[k - 1] for m in models], [m.weights[k - 1] for m in models], 0.0)
            self.contexts.append(contexts)
            self.weights.append(weights)
            grams, logs = _aligned([m.grams[k - 1] for m in models], [m.logs[k - 1] for m in models], np.nan)
            own = np.flatnonzero(place >= max(1, k - 1))
            keys = _grams(points, k)[own]
            own = own[np.unique(keys, return_index=True)[1]]  # a place of each gram of the union
            if k == 1:
                lower, context = np.full((len(own), len(names)), -np.log(self.alphabet), np.float32), np.zeros(len(own), np.uint64)
            else:
                before = _grams(points, k - 1)
                lower, context = self.logs[-1][_lookup(self.grams[-1], before[own])[0]], before[own - 1]
            at, found = _lookup(contexts, context)
            self.grams.append(grams)
            self.logs.append(np.where(np.isnan(logs), lower + np.where(found[:, None], weights[at], 0), logs))

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each word in each language, and the characters it predicts."""
        points, place = _characters(words)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        total = np.zeros((len(points), len(self.names)), np.float32)
        open_at = np.flatnonzero(place >= 1)
        hashes = _grams(points, self.order)
        for k in range(self.order, 0, -1):
            lower = _grams(points, k - 1) if k > 1 else np.zeros(len(points), np.uint64)
            try_at = open_at[place[open_at] >= k - 1]
            later = open_at[place[open_at] < k - 1]
            at, found = _lookup(self.grams[k - 1], hashes[try_at])
            total[try_at[found]] += self.logs[k - 1][at[found]]
            missed = try_at[~found]
            at, known = _lookup(self.contexts[k - 1], lower[missed - 1] if k > 1 else lower[missed])
            total[missed[known]] += self.weights[k - 1][at[known]]
            open_at, hashes = np.sort(np.concatenate([missed, later])) if len(later) else missed, lower
        total[open_at] -= np.log(self.alphabet)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        return np.add.reduceat(total, starts, axis=0) if len(words) else np.zeros((0, len(self.names))), sizes


class Models:
    """All languages, ``SIDE`` to a table: a language's scores do not depend on which others share its table."""

    def __init__(self, names: list[str], words: list[pa.Array], counts: list[np.ndarray], order: int = ORDER):
        self.names = names
        alphabet = len(np.unique(np.concatenate([np.unique(_characters(w)[0]) for w in words]))) + 1 if words else 1
        self.tables = [Model(names[k : k + SIDE], words[k : k + SIDE], counts[k : k + SIDE], order, alphabet) for k in range(0, len(names), SIDE)]

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each word in each language, and the characters it predicts."""
        found = [t.score(words)[0] for t in self.tables]
        return np.concatenate(found, axis=1) if found else np.zeros((len(words), 0)), pc.utf8_length(words).to_numpy().astype(np.int64) + 1

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its cross-entropy by language (nats a character), what ``_once`` gives, and whether it has a letter."""
        words, ends = _words(texts)
        sums, sizes = self.score(words.dictionary)
        letters = pc.match_substring_regex(words.dictionary, r"\p{L}").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

        def per_text(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0.0], np.cumsum(values[codes], dtype=np.float64)])
            return upto[ends] - upto[np.concatenate([[0], ends[:-1]])]

        digits = pc.match_substring_regex(words.dictionary, "[0-9]").to_numpy(zero_copy_only=False) if len(words) else letters
        telling = letters & ~digits
        lone = per_text(telling) == 0  # texts that have no such word are judged by all they have

        def of_texts(values: np.ndarray) -> np.ndarray:
            out = per_text(values * telling)
            return np.where(lone, per_text(values), out) if lone.any() else out

        n = of_texts(sizes)
        by_language = np.stack([of_texts(sums[:, j]) for j in range(len(self.names))], axis=1) if self.names else np.zeros((len(ends), 0))
        rejecting, once = self._once(sums, sizes, telling, lone, codes, ends)
        return -by_language / np.maximum(1, n)[:, None], rejecting, once, per_text(letters) > 0

    def _once(self, sums: np.ndarray, sizes: np.ndarray, telling: np.ndarray, lone: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the cross-entropy of its distinct words, each in its best language, and the characters these have."""
        texts = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        pairs = np.unique(texts * max(1, len(sizes)) + codes)
        text, word = np.divmod(pairs, max(1, len(sizes)))
        weight = telling[word] | lone[text]
        best = sums.max(axis=1) if self.names else np.zeros(len(sizes))
        n = np.bincount(text, sizes[word] * weight, len(ends))
        return -np.bincount(text, best[word] * weight, len(ends)) / np.maximum(1, n), n


class Identifier:
    """A fitted model with its calibration."""

    def __init__(self, sample: pa.Table, order: int = ORDER):
        """sample: text and lang."""
        langs = sample.column("lang").to_pylist()
        names = sorted(set(langs))
        rows = {name: np.array([i for i, x in enumerate(langs) if x == name]) for name in names}
        texts = column(sample, "text")
        words, counts, kept = [], [], []
        for name in names:
            own = rows[name]
            counted = own[np.arange(len(own)) % 5 != 4]
            total: dict[str, int] = {}
            for k in range(0, len(counted), PART):
                found, _ = _words(texts.take(pa.array(counted[k : k + PART])))
                for word, c in zip(found.dictionary.to_pylist(), np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary)).tolist(), strict=True):
                    total[word] = total.get(word, 0) + c
            if total:
                kept.append(name)
                words.append(pa.array(total.keys(), pa.string()))
                counts.append(np.array(list(total.values())))
        self.model = Models(kept, words, counts, order)
        self._calibrate(texts, {n: rows[n] for n in kept})

    def _calibrate(self, texts: pa.Array, rows: dict[str, np.ndarray]) -> None:
        names = self.model.names
        held = [(j, r[np.arange(len(r)) % 5 == 4] if len(r) >= 5 else r) for j, r in enumerate(rows.values())]
        self.mean, self.deviation, self.limit, self.temperature = np.zeros(len(names)), np.ones(len(names)), np.full(len(names), REJECT_AT), 1.0
        if not held:
            return
        rows_of_all = np.concatenate([r for _, r in held])
        found = [self.model.entropies(texts.take(pa.array(rows_of_all[k : k + PART]))) for k in range(0, len(rows_of_all), PART)]
        entropy, once, n, letters = (np.concatenate(x) for x in zip(*found, strict=True))
        truth = np.concatenate([np.full(len(r), j) for j, r in held])
        for j in range(len(names)):
            rows_of = (truth == j) & letters
            own = once[rows_of]
            if len(own):
                self.mean[j] = np.median(own)
                self.deviation[j] = max(0.02, 1.4826 * np.median(np.abs(own - self.mean[j])))
                self.limit[j] = max(REJECT_AT, np.quantile(self._above(own, n[rows_of], j), 0.99))
        best = None
        for t in (0.5, 1, 2, 4, 8, 16, 32):
            p = self._softmax(entropy, t)[np.arange(len(truth)), truth]
            loss = -np.log(np.maximum(p[letters], 1e-9)).sum()
            if best is None or loss < best:
                best, self.temperature = loss, float(t)

    def _above(self, once: np.ndarray, n: np.ndarray, j: int | np.ndarray) -> np.ndarray:
        """How many deviations texts of n characters lie above the median of language j."""
        return (once - self.mean[j]) / np.maximum(self.deviation[j], 1.5 / np.sqrt(np.maximum(1, n)))

    @staticmethod
    def _softmax(entropy: np.ndarray, t: float) -> np.ndarray:
        z = np.exp(-t * (entropy - entropy.min(axis=1, keepdims=True)))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        entropy, once, n, letters = self.model.entropies(texts)
        if not self.model.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        j = entropy.argmin(axis=1)
        rows = np.arange(len(j))
        score = np.where(letters, self._softmax(entropy, self.temperature)[rows, j], 0.0)
        accepted = letters & (self._above(once, n, j) <= self.limit[j])
        return [self.model.names[k] if ok else "und" for k, ok in zip(j, letters, strict=True)], score, accepted


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % folds


def fit(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, bytes_per_language: int = SAMPLE_BYTES) -> Identifier:
    """Fits on a sample of labelled (text, lang); rows without lang are no labels."""
    labelled = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    fitted = Identifier(bounded_sample(labelled, "lang", docs_per_language, bytes_per_language))
    release()
    return fitted


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row; ``carry`` names columns of docs to return too."""
    model = docs.sparkSession.sparkContext.broadcast(identifier)

    def make():
        fitted = model.value

        def run(table: pa.Table) -> pa.Table:
            langs, score, accepted = fitted.predict(column(table, "text"))
            return pa.table(carried(table, names) | {"lang_pred": pa.array(langs, pa.string()), "score": score, "accepted": accepted})

        return run

    names = ["doc_id", *carry]
    docs = inputs(docs, id_col, text_col, *(c for c in carry if c != "text"))
    return map_batches(docs, make, f"{typed(docs, names)}lang_pred string, score double, accepted boolean", SCORED_BYTES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = documents(spark, sf_dir)
    identifier = fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 3) != 1))
    return identify(docs, identifier).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
