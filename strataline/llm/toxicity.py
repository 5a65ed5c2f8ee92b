"""Toxicity by weak supervision.

Voters: the words of a fixed lexicon, word stems mined from the labelled training
rows, and patterns of the text. A voter says toxic (+1), clean (-1) or nothing
(0). A generative label model (two hidden classes, votes independent given the
class but for measured pairwise correlations) estimates by expectation
maximisation how often each voter is right, starting from the training labels
taken as unsure; a voter that says the same as others within a class is counted
at the share of what it adds. Its posterior probabilities, not the labels, train a logistic regression on the counts of the
voters' terms, and that scores every text. Voting, training and scoring see the
text alone.

The models are fitted on a bounded sample: at most ``max_training_rows`` labelled
rows (the ones whose hashed doc_id is smallest) with at most ``max_training_bytes`` of text. Every row is scored.

Defined results: a null or empty text has no votes and gets the score of a text
without evidence; repeated rows get equal scores; a null doc_id is scored and
never trained on; without training rows of both labels the lexicon alone votes;
an empty table gives an empty result; a text is scored whole in one task, with some 40 bytes of
memory for each of its bytes; other columns pass through, but for those that
have the names of the new columns, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import text_hash as H
from .storage import staged

# Insults used as lexicon voters.
LEXICON = (
    "idiot idiots moron morons stupid dumb imbecile fool scum trash garbage loser losers clown pathetic worthless disgusting vermin "
    "filth filthy scumbag jerk bastard pig dumm dummkopf abschaum arschloch trottel müll widerlich erbärmlich wertlos "
    "imbécile crétin ordure débile minable raclure connard abruti dégoûtant idiota imbécil estúpido estúpida basura escoria asqueroso "
    "patético inútil payaso perdedor"
).split()

MAX_TRAINING_ROWS = 8_000
MAX_TRAINING_BYTES = 64 << 20
FIT_SLICE = 1 << 19  # bytes of text at a time while fitting on the driver
MAX_STEMS = 300
MIN_TOXIC_ROWS = 6  # training rows of label 1 that have a mined stem
MIN_RATIO = 3.0  # times as frequent in them, two standard errors below the estimate
STEM_BYTES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
START = (0.05, 0.9)  # chances of being toxic that labels 0 and 1 give at the start of the label model
_EDGE = np.ones(256, bool)  # bytes cut from both ends of a word
_EDGE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
_EDGE[0x80:] = False


def _terms(texts: H.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hashes, text of each, words of each text). A word's terms are itself
    and its first 4 to 8 bytes; marks at its ends and capitals don't count."""
    texts = H.lowered(texts)
    words = H.words_of(texts)
    start, end, text = words.start.copy(), words.end.copy(), words.text
    for _ in range(4):
        cut = (end > start) & _EDGE[texts.data[start.clip(max=max(len(texts.data) - 1, 0))]] if len(start) else np.zeros(0, bool)
        start = start + cut
        cut = (end > start) & _EDGE[texts.data[end - 1]] if len(start) else np.zeros(0, bool)
        end = end - cut
    some = end > start
    start, end, text = start[some], end[some], text[some]
    hasher = H.Hasher(texts.data)
    hashes, owner = [hasher.ranges(start, end)], [text]
    for k in STEM_BYTES:
        long = end - start > k
        hashes.append(H.mix(hasher.ranges(start[long], start[long] + k) + np.uint64(k)))
        owner.append(text[long])
    return np.concatenate(hashes), np.concatenate(owner), np.bincount(text, minlength=len(texts))


def _pattern_counts(texts: H.Texts) -> np.ndarray:
    """Columns: bytes, capitals, exclamation marks, symbols."""
    d = texts.data
    flags = (np.ones(len(d), bool), (d >= 0x41) & (d <= 0x5A), d == 0x21, np.isin(d, list(b"#*$%&|<>")))
    return np.stack([texts.per_text(f) for f in flags], axis=1)


def _count_matrix(hashes: np.ndarray, owner: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """How often each text has each term of ``known`` (sorted)."""
    if not len(known) or not len(hashes):
        return np.zeros((n, len(known)))
    place = np.searchsorted(known, hashes).clip(max=len(known) - 1)
    hit = known[place] == hashes
    return np.bincount(owner[hit] * len(known) + place[hit], minlength=n * len(known)).reshape(n, -1).astype(np.float64)


def _present(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The term hashes, each once for every text that has it."""
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first]


def _mine(parts: list[tuple[H.Texts, np.ndarray]], max_stems: int) -> np.ndarray:
    """Terms that the toxic training rows have much more often than the others.
    ``parts``: texts and whether each is toxic. Only terms of toxic rows are counted."""
    n_toxic = sum(int(toxic.sum()) for _, toxic in parts)
    n_clean = sum(len(toxic) for _, toxic in parts) - n_toxic
    found = []
    for texts, toxic in parts:
        hashes, owner, _ = _terms(texts)
        found.append(_present(hashes[toxic[owner]], owner[toxic[owner]]))
    terms, t = np.unique(np.concatenate(found), return_counts=True)
    terms, t = terms[t >= MIN_TOXIC_ROWS], t[t >= MIN_TOXIC_ROWS]
    c = np.zeros(len(terms))
    for texts, toxic in parts if len(terms) else ():
        hashes, owner, _ = _terms(texts)
        place = np.searchsorted(terms, hashes).clip(max=len(terms) - 1)
        hit = (terms[place] == hashes) & ~toxic[owner]
        c += np.bincount(np.searchsorted(terms, _present(hashes[hit], owner[hit])), minlength=len(terms))
    # a lower bound of the log ratio: two standard errors below
    bound = np.log(t / n_toxic / ((c + 1) / (n_clean + 1))) - 2 * np.sqrt(1 / t + 1 / (c + 1) - 1 / n_toxic - 1 / (n_clean + 1))
    good = np.flatnonzero(bound > np.log(MIN_RATIO))
    return np.sort(terms[good[np.argsort(-(t * bound)[good], kind="stable")[:max_stems]]])


@dataclass
class LabelModel:
    """P(vote | class) of each voter for votes -1, 0, +1, and its weight."""

    bias: float
    tables: np.ndarray  # classes x voters x 3
    weight: np.ndarray

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.tables)
        ratio = logs[1] - logs[0]
        return sum((votes == v) @ (self.weight * ratio[:, k]) for k, v in enumerate((-1, 0, 1)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(votes) + self.bias, -50, 50)))

    def hold_share(self, votes: np.ndarray, prior: float) -> None:
        """Set the bias at which the mean posterior of these rows is ``prior``."""
        evidence = self.evidence(votes)
        low, high = -evidence.max() - 20, -evidence.min() + 20
        for _ in range(60):
            self.bias = (low + high) / 2
            over = (1 / (1 + np.exp(-np.clip(evidence + self.bias, -50, 50)))).mean() > prior
            low, high = (low, self.bias) if over else (self.bias, high)


def fit_label_model(votes: np.ndarray, prior: float, start: np.ndarray | None = None, rounds: int = 10) -> LabelModel:
    """Expectation maximisation; the class share stays at ``prior``. It starts from
    ``start``, each row's probability of being toxic, or else from "a voter is right
    more often than not". Each round measures the accuracies, then the correlations
    of the voters within the classes: a voter weighs 1 / (1 + the sum of its
    squared correlations with the others)."""
    n, m = votes.shape
    base = np.stack([(votes == v).mean(axis=0) for v in (-1, 0, 1)], axis=1) + 1e-3
    tables = np.stack([base * [1.5, 1, 0.5], base * [0.5, 1, 3]])
    model = LabelModel(0.0, tables / tables.sum(axis=2, keepdims=True), np.full(m, 0.5))
    model.hold_share(votes, prior)
    for k in range(rounds):
        p = start if k == 0 and start is not None else model.posterior(votes)
        classes = np.stack([1 - p, p])
        counts = np.stack([classes @ (votes == v) for v in (-1, 0, 1)], axis=2) + base[None] * 2
        model.tables = counts / counts.sum(axis=2, keepdims=True)
        means = classes @ votes / np.maximum(classes.sum(axis=1, keepdims=True), 1e-9)
        left = (votes - classes.T @ means).astype(np.float32)
        scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
        together = left.T @ left / np.outer(scale, scale)
        np.fill_diagonal(together, 0)
        model.weight = 1 / (1 + (np.where(together > 0.1, together, 0) ** 2).sum(axis=1))
        model.hold_share(votes, prior)
    return model


def _fit_logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        gram = np.diag(penalty)
        for a in range(0, len(x), 1024):  # in blocks, in double precision
            block = x[a : a + 1024].astype(np.float64)
            gram += (block * s[a : a + 1024, None]).T @ block
        step = np.linalg.solve(gram, x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """``lexicon`` and ``stems``: sorted term hashes; ``weights`` of their features and patterns."""

    lexicon: np.ndarray
    stems: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        x, _ = _features(H.texts_of(column), self.lexicon, self.stems)
        z = (x - self.center) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(texts: H.Texts, lexicon: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts of lexicon and stem terms). Features: log(1 + count) and
    whether present, of each term and of the totals, the totals' share of the
    words, and the shares of the patterns."""
    hashes, owner, n_words = _terms(texts)
    n = len(texts)
    both = np.sort(np.concatenate([lexicon, stems]))
    counts = _count_matrix(hashes, owner, n, both)
    is_lex = np.isin(both, lexicon)
    totals = np.stack([counts[:, is_lex].sum(axis=1), counts[:, ~is_lex].sum(axis=1)], axis=1)
    patterns = _pattern_counts(texts)
    shares = patterns[:, 1:] / np.maximum(patterns[:, :1], 1)
    per_word = totals / np.maximum(n_words[:, None], 1)
    x = np.concatenate([np.log1p(counts), np.log1p(totals), totals > 0, np.sqrt(per_word), shares], axis=1)
    return x.astype(np.float64), np.concatenate([counts, totals, per_word, shares], axis=1)


def _votes(counts: np.ndarray, n_terms: int) -> np.ndarray:
    """Term voters: +1 where present. Pattern voters: many terms, a high share of
    terms, no term at all (-1), one weak term only (-1), shouting, symbols."""
    terms = (counts[:, :n_terms] > 0).astype(np.int8)
    lex, stem, lex_share, stem_share, caps, marks, symbols = counts[:, n_terms:].T
    extra = [
        np.where(lex >= 2, 1, np.where(lex == 0, -1, 0)),
        np.where(lex_share > 0.005, 1, 0),
        np.where(stem_share > 0.03, 1, np.where(stem_share < 0.01, -1, 0)),
        np.where(stem_share > 0.06, 1, 0),
        np.where(stem >= 6, 1, np.where(stem <= 1, -1, 0)),
        np.where((lex == 0) & (stem == 0), -1, 0),
        np.where(caps > 0.5, 1, 0),
        np.where(marks > 0.05, 1, 0),
        np.where(symbols > 0.05, 1, 0),
    ]
    return np.concatenate([terms, np.stack(extra, axis=1).astype(np.int8)], axis=1)


def fit_rows(texts: pa.Array, labels: np.ndarray, max_stems: int = MAX_STEMS) -> Model:
    """Fit on the driver; ``labels`` are 0 or 1."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string()), pa.array(labels)], ["text", "label"])
    parts = [(H.texts_of(s.column(0)), s.column(1).to_numpy() == 1) for s in H.slices(batch, "text", FIT_SLICE)]
    toxic = labels == 1
    lexicon = np.unique(H.hash_strings(LEXICON))
    stems = np.zeros(0, np.uint64)
    if toxic.any() and not toxic.all():
        stems = np.setdiff1d(_mine(parts, max_stems), lexicon)
    n_terms = len(lexicon) + len(stems)
    if not parts:
        width = 2 * 2 + 2 + n_terms + 3
        weights = np.zeros(width + 1)
        weights[n_terms] = 3.0  # of the total of the lexicon
        weights[-1] = -3.0
        return Model(lexicon, stems, np.zeros(width), np.ones(width), weights)
    made = []
    for t, _ in parts:
        features, counts = _features(t, lexicon, stems)
        made.append((features.astype(np.float32), _votes(counts, n_terms)))
    x, votes = np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made])
    del made
    prior = float(np.clip(toxic.mean(), 0.01, 0.5)) if toxic.any() else 0.05
    start = np.where(toxic, START[1], START[0]) if toxic.any() and not toxic.all() else None
    posterior = fit_label_model(votes, prior, start).posterior(votes)
    center, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    x -= center
    x /= spread
    return Model(lexicon, stems, center.astype(np.float64), spread.astype(np.float64), _fit_logistic(x, posterior))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_training_rows: int = MAX_TRAINING_ROWS, max_training_bytes: int = MAX_TRAINING_BYTES) -> Model:
    """``labels``: the rows (id, label) that may be learned from. Those with the
    smallest hash of their id, ``max_training_rows`` at most, are joined to
    ``docs`` by a broadcast; an id counts once (of several texts the one with the smallest
    hash). Of these rows, in the order of their ids' hashes, as many come to the driver as have ``max_training_bytes``
    of text together."""
    rank = F.xxhash64(F.col(id_col))
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = chosen.orderBy(rank, id_col).limit(max_training_rows).select(F.col(id_col).alias("_id"), F.col("_label").cast("int").alias("_label"))
    rows = docs.select(F.col(id_col).alias("_own"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_own") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text").alias("text"))).alias("_row"), F.first("_label").alias("_label"))
    rows = staged(rows.select("_id", F.col("_row.text").alias("_text"), "_label"), "toxicity_sample")  # max_training_rows at most
    so_far = F.sum(F.octet_length("_text").cast("long")).over(Window.orderBy(F.xxhash64("_id"), "_id"))
    within = rows.select("_id", so_far.alias("_bytes")).where(F.col("_bytes") <= max_training_bytes).select("_id")
    table = rows.join(F.broadcast(within), "_id", "left_semi").toArrow().sort_by([("_id", "ascending")])
    return fit_rows(table.column("_text").combine_chunks(), table.column("_label").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD, into: str = "toxicity", flag: str = "is_toxic") -> DataFrame:
    """``docs`` with ``into`` (double, 0 to 1) and ``flag`` (score >= threshold). Nothing is shuffled."""
    docs = docs.drop(into, flag)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType()), T.StructField(flag, T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in H.slices(b, text_col)):
            p = model.score(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= threshold)], [*batch.schema.names, into, flag])

    return docs.mapInArrow(judge, schema)
