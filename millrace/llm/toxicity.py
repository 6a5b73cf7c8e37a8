"""Toxicity by weak supervision.

Voters: one for each word of a lexicon (a seed list, and words that the labelled rows
show to be typical) and several patterns.  A generative label model (two latent
classes, expectation maximisation) estimates how often each voter fires in either
class, and from the correlation of what remains how much each repeats others; the
given labels are one more, fallible, voter.  A logistic classifier is trained on the
posterior labels and scores every whole text.

Everything that is fitted uses at most ``FIT_ROWS`` labelled rows (those of the
least hash of doc_id); every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import U, hash_of, shingles, slices, word_hashes

#: At most so many labelled rows are used for fitting.
FIT_ROWS = 20_000
#: At most so many mined words, each in this share of the distinct toxic texts and so much likelier there.
MINED_WORDS, MINED_SHARE, MINED_LOG_ODDS = 200, 0.008, 3.0
#: Words of insult to start from.
SEEDS = (
    "idiot idiots moron morons imbecile stupid dumb dumbass fool loser losers scum scumbag trash garbage filth vermin worthless pathetic "
    "disgusting clown pig bastard bitch slut whore asshole jerk freak creep coward liar ugly retard cretin "
    "dummkopf vollidiot abschaum arschloch schlampe connard salaud ordure imbécile crétin idiota estúpido imbécil basura escoria cabrón puta"
).split()
PATTERNS = ("two lexicon words", "lexicon density", "lexicon word after a pointing word", "disguised lexicon word", "shouting", "runs of marks", "runs of one word", "links or digits")
_POINTING = [hash_of(w) for w in "you you're your this that these those such he she they are der die das du dieser ce cette tu vous ese esa este esta tú".split()]
_DISGUISE = np.arange(256, dtype=np.uint8)
_DISGUISE[[ord(c) for c in "013457@"]] = [ord(c) for c in "oieasta"]


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray  # of the words, then of the patterns
    bias: float
    firing: np.ndarray | None = None  # of each voter in either class, for inspection


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text, modulo 5, is 0 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A row for each text: whether each lexicon word occurs, then the patterns."""
    n, m = len(offsets) - 1, len(lexicon)
    words, per = word_hashes(data, offsets, "letters")
    owner = np.repeat(np.arange(n), per)
    x = np.zeros((n, m + len(PATTERNS)), np.float32)
    if not len(words):
        return x

    def look(w):
        at = np.minimum(np.searchsorted(lexicon, w), m - 1)
        return at, lexicon[at] == w

    at, hit = look(words)
    x[owner[hit], order[at[hit]]] = 1
    hits = np.bincount(owner[hit], minlength=n)
    x[:, m] = x[:, :m].sum(1) >= 2
    x[:, m + 1] = hits > 0.004 * per
    after = np.zeros(len(words), bool)
    after[1:] = np.isin(words[:-1], np.array(_POINTING, U)) & (owner[1:] == owner[:-1])
    x[owner[hit & after], m + 2] = 1
    plain, _ = word_hashes(_DISGUISE[data], offsets, "letters")
    if len(plain) == len(words):
        _, hidden = look(plain)
        x[owner[hidden & ~hit], m + 3] = 1
    else:  # an @ joined two words
        p2, per2 = word_hashes(_DISGUISE[data], offsets, "letters")
        _, hidden = look(p2)
        x[:, m + 3] = np.bincount(np.repeat(np.arange(n), per2)[hidden], minlength=n) > hits

    def share(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[offsets]) / np.maximum(np.diff(offsets), 1)

    x[:, m + 4] = share((data >= 65) & (data <= 90)) > 0.3
    marks = np.zeros(len(data), bool)
    marks[1:] = (data[1:] == data[:-1]) & np.isin(data[1:], np.frombuffer(b"!?$%&*#", np.uint8))
    x[:, m + 5] = share(marks) > 0.02
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    x[:, m + 6] = np.bincount(owner[same], minlength=n) > 0.2 * per
    x[:, m + 7] = share((data >= 48) & (data <= 57)) > 0.05
    x[per == 0] = 0
    return x


def _index(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([hash_of(w) for w in words], U)
    order = np.argsort(h)
    return h[order], order


def _vote(words: list[str]):
    lexicon, order = _index(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                x = features(data, offsets, lexicon, order).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "x"])

    return run


def _with_cluster(batches):
    """Adds the least hash of the text's shingles, which most near copies share."""
    for batch in batches:
        least = []
        for _, _, data, offsets in slices(batch.column("text")):
            s, many = shingles(*word_hashes(data, offsets))
            cuts = np.concatenate([[0], np.cumsum(many)])
            least += [int(s[i:j].min() >> U(1)) if j > i else 0 for i, j in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), pa.array(least, pa.int64())], ["toxic", "text", "cluster"])


def _distinct_words(batches):
    rx = re.compile(r"[^\W_]{3,40}")
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            ws = list(set(rx.findall((text or "").lower())))
            if ws:
                yield pa.RecordBatch.from_arrays([pa.array(ws), pa.array(np.full(len(ws), toxic, np.int32))], ["word", "toxic"])


def mine(rows: DataFrame) -> list[str]:
    """Words typical of the toxic rows of (toxic, text); near copies count once."""
    rows = rows.mapInArrow(_with_cluster, "toxic int, text string, cluster long").dropDuplicates(["toxic", "cluster"])
    n = dict(rows.groupBy("toxic").count().collect())
    if not n.get(1) or not n.get(0):
        return []
    found = rows.mapInArrow(_distinct_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") - F.col("t") + 0.5) / (n[0] + 1))
    found = found.where(F.col("t") >= max(6, MINED_SHARE * n[1])).withColumn("odds", odds).where(F.col("odds") >= MINED_LOG_ODDS)
    return [r["word"] for r in found.orderBy(F.desc("odds"), "word").limit(MINED_WORDS).collect()]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, each voter's firing rates (2 x voters) and weights.

    A voter that another repeats counts less: its weight is one over one plus the
    largest correlation with another of what the classes leave unexplained.
    """
    q = np.clip(start.astype(float), 0.02, 0.98)
    v = votes.astype(float)
    weight = np.ones(v.shape[1])
    rates = np.zeros((2, v.shape[1]))
    for _ in range(rounds):
        for y, p in ((0, 1 - q), (1, q)):
            rates[y] = (v.T @ p + 0.5) / (p.sum() + 1.0)
        left = v - (np.outer(q, rates[1]) + np.outer(1 - q, rates[0]))
        sd = left.std(0)
        c = (left.T @ left) / len(v) / np.maximum(np.outer(sd, sd), 1e-9)
        c[sd < 1e-6] = 0
        c[:, sd < 1e-6] = 0
        np.fill_diagonal(c, 0)
        weight = 1 / (1 + np.clip(c, 0, 1).max(1))
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        on = weight * np.log(rates[1] / rates[0])
        off = weight * np.log((1 - rates[1]) / (1 - rates[0]))
        z = np.log(prior / (1 - prior)) + v @ (on - off) + off.sum()
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-5:
            q = new
            break
        q = new
    return q, rates, weight


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels (Newton's method)."""
    a = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows that are not held out.

    Labels with a null doc_id or toxic are left out; of several labels of a doc_id the
    toxic one counts, of several texts of a doc_id the one of the least hash, so at most
    ``fit_rows`` rows are gathered.  Without rows of both classes the seed lexicon decides
    alone.  Where no seed word occurs, the first posteriors come from the labels only.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows rows, one for each doc_id
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = Scratch(docs.sparkSession).save(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"))
    words = list(dict.fromkeys(SEEDS + mine(rows)))
    got = rows.mapInArrow(_vote(words), "toxic int, x binary").toArrow()
    y = got["toxic"].to_numpy()
    m = len(words)
    if not len(y) or y.min() == y.max():
        return Model(words, np.concatenate([np.full(m, 5.0), np.zeros(len(PATTERNS))]), -4.0)
    x = np.stack([np.frombuffer(r, np.uint8) for r in got["x"].to_pylist()])
    # words that never occur can't be judged: they keep the mean of those that can
    seen = x.sum(0) >= 3
    votes = np.hstack([x[:, seen], y[:, None]])
    start = np.where(x[:, :m].any(1), 0.9, np.where(y == 1, 0.4, 0.05))
    q, rates, _ = label_model(votes, start)
    w, bias = logistic(x[:, seen], q)
    weights = np.zeros(x.shape[1])
    weights[seen] = w
    lexical = weights[:m][seen[:m]]
    weights[:m][~seen[:m]] = lexical[lexical > 0].mean() if (lexical > 0).any() else 4.0
    return Model(words, weights, bias, rates)


def _score(model: Model, threshold: float | None):
    lexicon, order = _index(model.words)
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [features(data, offsets, lexicon, order) @ weights + bias for _, _, data, offsets in slices(batch.column("text"))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -40, 40))) if z else np.zeros(0)
            if threshold is None:
                keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(p)], [*(batch.schema.names[i] for i in keep), "score"])
            else:
                yield batch.filter(pa.array(p < threshold))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.

    Null and empty texts have the score of a text without any vote.  Only ``text`` is
    scored; other columns are ignored.  An empty table gives an empty one.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model, None), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, all columns."""
    return docs.mapInArrow(_score(model, threshold), docs.schema)
