"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. A lexicon of common English insults is given. For other languages none is, so words and beginnings of words are mined from
   a bounded sample of labelled rows (at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` different texts): those whose presence speaks for the
   label by a lower confidence bound. Each becomes a voter (the strongest ones) or joins one of several lexicons. A voter
   votes toxic or abstains; two voters that count all mined hits (at least two; none at all) vote for either side. This is
   the only use of labels, beside the share of toxic rows.
2. The label model sees votes alone, of the labelled texts and of ``SAMPLE_OTHER`` others, never a label. It is a mixture of two
   classes fitted by expectation maximisation: it estimates for each voter how often it votes what in each class (its accuracy),
   and, once these have settled, in every round from what is left of the votes inside the classes the correlations of all pairs, of either sign. Voters are weighted by the
   solution w of R w = 1 for the matrix R of correlations: k copies count about 1 / k each.
3. A logistic regression on counts of the voters' hits learns the posterior labels. Its score is a probability.

Hits are found by distinct words: ASCII white space separates, runs of letters inside count, in lower case. Null and empty
texts have no hits and get the score of a text without hits. Without labelled rows every score is 0. Rows keep their
number, also where doc_id is null or repeats; labels, lang, source and doc_id never reach a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.blocks import words_of
from tidewell.llm.common import bounded_sample, column, discard, documents, inputs, map_batches, materialize, release
from tidewell.llm.language_id import fold

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_OTHER, SAMPLE_BYTES = 2_000, 4_000, 2_000, 16 << 20
#: Texts whose hits are counted at a time while fitting.
PART = 256
#: Common English insults, in alphabetical order.
INSULTS = frozenset("bastard bitch clown crap cretin damn disgusting dumb fool freak garbage hideous idiot idiotic ignorant imbecile jerk lame loser lunatic moron moronic nasty pathetic pig psycho retard scum shit shut stupid sucks trash ugly useless vermin vile worthless wretched".split())
#: Voters of one feature each, and lexicons that share the features after them.
SINGLE, LEXICONS = 120, 20
#: Features kept at most, lengths of word beginnings, texts that a feature must be in, the width of its bound in deviations, the least bound and
#: the least log odds themselves.
FEATURES, BEGINNINGS, LEAST_TEXTS, WIDTH, BOUND, ODDS = 2_000, (4, 5, 6), 3, 2.6, 0.7, 3.5
THRESHOLD = 0.3
#: Rounds of the label model before it weights voters by their correlations.
SETTLED = 5
#: Correlations that are taken for none, and how far their matrix is drawn towards the unit matrix.
NOISE, RIDGE = 0.05, 0.3

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The features of one word: each run of letters whole ("=run") and its beginnings ("^run")."""
    out = []
    for run in _LETTERS.findall(word.lower()):
        out.append("=" + run)
        out += ["^" + run[:n] for n in BEGINNINGS if len(run) > n]
    return out


def _present(texts: list[str]) -> Iterator[set[str]]:
    known: dict[str, list[str]] = {}
    for text in texts:
        found: set[str] = set()
        for w in set(text.split()):
            if w not in known:
                known[w] = features_of(w)
            found.update(known[w])
        yield found


def mine(present: Iterable[set[str]], toxic: np.ndarray) -> list[str]:
    """Features that speak for the label, strongest first; of features in the same texts only the shortest."""
    for_, against = Counter(), Counter()
    for found, y in zip(present, toxic, strict=True):
        (for_ if y else against).update(found)
    p_all, n_all = int(toxic.sum()), int((~toxic).sum())
    bounds = {}
    for f, p in for_.items():
        if p >= LEAST_TEXTS:
            n = against[f]
            odds = np.log((p + 0.5) / (p_all - p + 0.5)) - np.log((n + 0.5) / (n_all - n + 0.5))
            bound = odds - WIDTH * np.sqrt(1 / (p + 0.5) + 1 / (p_all - p + 0.5) + 1 / (n + 0.5) + 1 / (n_all - n + 0.5))
            if bound > BOUND and odds > ODDS:
                bounds[f] = (bound, p)
    ranked = sorted(bounds, key=lambda f: (-bounds[f][0], len(f), f))
    return ranked[:FEATURES]


def label_model(votes: np.ndarray, prior: np.ndarray | float, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posteriors of the toxic class of each row of votes (+1, -1, 0), and what was estimated.

    prior is the share of the class, of all rows or of each. The classes start from the rows with most votes for toxicity, as many as the
    prior says. The log odds of a row are those of its prior plus, for each voter, its weight times the log odds of its vote.
    """
    values = (-1, 0, 1)
    prior = np.clip(np.broadcast_to(np.asarray(prior, float), len(votes)), 0.01, 0.99)
    sums = votes.sum(axis=1)
    at = np.quantile(sums, 1 - prior.mean())
    posterior = np.where(sums > max(at, votes.sum(axis=1).min()), 0.9, np.where(sums == at, prior.mean(), 0.05))
    weight = np.ones(votes.shape[1])
    for step in range(rounds):
        w = np.stack([1 - posterior, posterior])
        total = w.sum(axis=1)
        table = np.stack([(w @ (votes == v) + 1 / 3) / (total + 1)[:, None] for v in values])  # value, class, voter
        if step >= SETTLED:  # before, what the classes themselves explain would pass for correlation
            weight = (weight + correlation_weights(votes, posterior)) / 2
        odds = np.log(table[:, 1]) - np.log(table[:, 0])  # value, voter
        score = np.log(prior / (1 - prior)) + sum((votes == v) @ (odds[k] * weight) for k, v in enumerate(values))
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-4 and step > SETTLED + 5:
            break
    share = np.array([1 - posterior.mean(), posterior.mean()])
    accuracy = (table[2, 1] * share[1] + table[0, 0] * share[0]) / np.maximum(1e-9, ((table[0] + table[2]) * share[:, None]).sum(axis=0))
    return posterior, {"accuracy": accuracy, "weight": weight, "prior": float(share[1]), "table": table}


def correlations(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """The correlations of all pairs of voters inside the two classes, of either sign."""
    w = np.stack([1 - posterior, posterior])
    mean = (w @ votes) / np.maximum(w.sum(axis=1), 1e-9)[:, None]
    # the covariance inside the classes is that of all rows less what the classes' means explain
    covariance = (votes.T @ votes) / len(votes) - sum((w[c].sum() / len(votes)) * np.outer(mean[c], mean[c]) for c in (0, 1))
    scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    out = np.clip(covariance / np.outer(scale, scale), -1, 1)
    np.fill_diagonal(out, 1)
    return out


def correlation_weights(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """What each voter counts for beside the others: the solution of R w = 1 for the correlations R, from 0 to 1.

    R is drawn towards the unit matrix by ``RIDGE``, since voters that exclude each other would blow up small errors of it.
    """
    r = correlations(votes.astype(float), posterior)
    r = np.where(np.abs(r) < NOISE, 0.0, r)
    return np.clip(np.linalg.solve((1 - RIDGE) * r + RIDGE * np.eye(len(r)), np.ones(len(r))), 0.0, 1.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels y; the last column of x is the constant and bears no penalty."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """Voters and weights, fitted on labelled texts (columns text and toxic) and on others without a label."""

    def __init__(self, sample: pa.Table, others: list[str] = (), rate: float | None = None):
        texts = sample.column("text").to_pylist()
        toxic = np.array([int(x) for x in sample.column("toxic").to_pylist()], int) > 0
        self.voter: dict[str, int] = {}
        self.voters = 0
        self.weights = None
        if not len(texts) or toxic.all() or not toxic.any():
            self.constant = float(toxic.all()) if len(texts) else 0.0
            return
        ranked = mine(_present(texts), toxic)
        # voter 0 is the given lexicon; a word of it that is mined too has a voter of its own beside it
        self.voter = {f: 1 + (k if k < SINGLE else SINGLE + k % LEXICONS) for k, f in enumerate(ranked)}
        self.voters = max(self.voter.values(), default=0) + 1
        every = [*texts, *others]
        found = [self.counts(pa.array(every[k : k + PART], pa.string())) for k in range(0, len(every), PART)]
        counts, length = (np.concatenate(x) for x in zip(*found, strict=True))
        # how often each voter's words come in texts that are labelled clean: what a voter must exceed
        clean = np.flatnonzero(~toxic)
        self.usual = (counts[clean].sum(axis=0) + 0.1) / max(1, length[clean].sum())
        votes = self.votes(counts, length)
        prior = np.concatenate([np.full(len(texts), toxic.mean()), np.full(len(others), rate if rate is not None else toxic.mean())])
        posterior, self.model = label_model(votes, prior)
        self.weights = logistic(self.inputs(counts, length), posterior)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each voter in each text, and the texts' words."""
        words, ends = words_of(texts)
        hit_words, hit_voters = [], []
        for k, w in enumerate(words.dictionary.to_pylist()):
            features = features_of(w)
            found = {self.voter[f] for f in features if f in self.voter}
            if any(f[0] == "=" and f[1:] in INSULTS for f in features):
                found.add(0)
            hit_words += [k] * len(found)
            hit_voters += found
        out = np.zeros((len(texts), self.voters), np.int32)
        if hit_words:
            hit_words, hit_voters = np.array(hit_words), np.array(hit_voters)
            n = np.bincount(hit_words, minlength=len(words.dictionary))
            first = np.cumsum(n) - n
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(n[codes])
            doc = np.searchsorted(ends, at, "right")
            sizes = n[codes[at]]
            pick = np.repeat(first[codes[at]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            np.add.at(out, (np.repeat(doc, sizes), hit_voters[pick]), 1)
        return out, np.diff(ends, prepend=0)

    def surprise(self, counts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how many deviations each voter's hits, and all hits, exceed what so many words usually have."""
        usual = length[:, None] * self.usual
        hits, all_usual = counts.sum(axis=1), usual.sum(axis=1)
        return (counts - usual) / np.sqrt(usual + 0.25), (hits - all_usual) / np.sqrt(all_usual + 0.25)

    def votes(self, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """One column a voter (toxic or nothing), then two of patterns over all hits (toxic, clean or nothing)."""
        each, whole = self.surprise(counts, length)
        patterns = [np.where(whole > high, 1, np.where(whole < low, -1, 0)) for high, low in ((6.0, 1.0), (3.0, 2.0))]
        return np.concatenate([((counts > 0) & (each > 1.5)).astype(int), np.stack(patterns, axis=1)], axis=1)

    def inputs(self, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        each, whole = self.surprise(counts, length)
        hits = counts.sum(axis=1)
        more = np.stack([hits > 0, np.log1p(hits), np.log1p(100 * hits / np.maximum(20, length)), np.log1p(np.maximum(whole, 0)), np.ones(len(hits))], axis=1)
        return np.concatenate([np.clip(each, 0, 6) / 6, more], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.inputs(*self.counts(texts)) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN, other_rows: int = SAMPLE_OTHER) -> Scorer:
    """Fits on a sample of labels (doc_id, toxic) of docs (doc_id, text) and on other texts of docs; null labels are none.

    Labels are drawn by the hash of their id, each id and label once, up to the two numbers, so they are broadcast; an id that
    several texts have gives them all, and of these again no more than the numbers are taken.
    """
    most = {"1": toxic_rows, "0": clean_rows}
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.when(F.col("toxic") > 0, "1").otherwise("0").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == "1", min(1.0, 2 * toxic_rows / max(1, sizes.get("1", 0)))).otherwise(min(1.0, 2 * clean_rows / max(1, sizes.get("0", 0))))
    hashed = labels.withColumn("h", F.xxhash64("doc_id")).where(F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30) < share).distinct()
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h"))
    picked = hashed.withColumn("k", rank).where(F.col("k") <= F.when(F.col("toxic") == "1", toxic_rows).otherwise(clean_rows)).select("doc_id", "toxic")
    joined = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text"), "labelled")
    sample = bounded_sample(joined, "toxic", most, SAMPLE_BYTES)
    discard(joined)
    others = bounded_sample(docs.select(F.lit("any").alias("all"), "text"), "all", other_rows, SAMPLE_BYTES)
    scorer = Scorer(sample, others["text"].to_pylist(), sizes.get("1", 0) / max(1, sum(sizes.values())))
    release()
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    fitted = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        model = fitted.value

        def run(table: pa.Table) -> pa.Table:
            s = model.score(column(table, "text"))
            return pa.table({"doc_id": table["doc_id"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

        return run

    docs = inputs(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    scorer = fit(docs.where(fold("doc_id", 4) != 2), labels)
    return score_toxicity(docs, scorer).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
