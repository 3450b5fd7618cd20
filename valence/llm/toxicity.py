"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

**Token labels.** Labels are by document. A word counts as toxic in a toxic document if it is in toxic documents of the
sample far more often than in others (log odds of LOG_ODDS or more, in a share of LEAST of the toxic documents), or if its
beginning (its first bytes, STEMS of them) is so at least twice in a document, as rare forms of a word say little alone; all other words are clean.
Copies are counted once: the sample has each text once, and of those with the same smallest shingle one counts.

**Field.** Two states, chains of up to CHAIN words (a long text is many chains, none is left out). Features
of a word: itself, its neighbours, its beginning, its last letters and whether it is in capitals, as weights in a hashed table; and the
transitions. It is fitted with Adagrad on the likelihood; forward-backward gives its gradient and later the marginals.

**Document score.** Sum and share of the words (both from a half up) and maximum of the marginals go into a logistic regression on the
document label, so that a word that a long text has once by chance is not enough.

The fit uses a bounded sample of the labelled rows: at most SAMPLE of each label with at most LONGEST characters, those with
the smallest hash of the text. Everything else (scores, spans) reads all rows and whole texts, in one pass without a shuffle.

Defined: null and empty texts get the score of a text without toxic words. Null labels aren't used. Without a toxic row to
learn from all scores are 0; without a clean one the field tags nothing and all get the share of toxic rows in the sample.
Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from valence.llm.common import Words, characters, fixed, mixed, numbered, of_rows, pieces, shingles

SAMPLE, LONGEST = 800, 10_000
LOG_ODDS, LEAST = 3.0, 0.03
CHAIN = 64
SIZE = 1 << 18
STEMS, FEW = (4, 5, 6, 7), 4  # bytes of a beginning, and least number of toxic documents that have it twice
_KINDS = (np.uint64(0), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Field:
    """Weights: of the toxic state by hashed feature, of the transitions, and of the document features."""

    weights: np.ndarray
    steps: np.ndarray
    document: np.ndarray
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.prior <= 0 or not self.weights.any():
            return np.full(len(features), max(0.0, self.prior))
        return 1 / (1 + np.exp(-(features @ self.document)))


def beginnings(w: Words, data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first ``size`` bytes of each word, of all of a shorter one."""
    letters = np.zeros(len(w.hash), np.uint64)
    for k in range(size if len(letters) else 0):
        byte = data[np.minimum(w.start + k, len(data) - 1)] | 0x20
        letters = letters * np.uint64(256) + np.where(w.size > k, byte, 0).astype(np.uint64)
    return mixed(letters + (np.uint64(size) << np.uint64(56)))


def features(w: Words, data: np.ndarray) -> np.ndarray:
    """Places in the table of weights, some for each word; neighbours in other texts don't count."""
    n = len(w.hash)
    out = np.zeros((n, 5 + len(STEMS)), np.int32)
    with np.errstate(over="ignore"):
        def place(h, kind):
            return (mixed(h + _KINDS[kind]) >> np.uint64(46)).astype(np.int64)

        out[:, 0] = place(w.hash, 0)
        edge = w.text[1:] != w.text[:-1]
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        before[1:] = np.where(edge, 0, w.hash[:-1])
        after[:-1] = np.where(edge, 0, w.hash[1:])
        out[:, 1], out[:, 2] = place(before, 1), place(after, 2)
        if n:
            end = w.start + w.size - 1
            letters = np.zeros(n, np.uint64)
            for k in range(3):
                letters = letters * np.uint64(256) + np.where(w.size > k, data[np.maximum(end - k, 0)] | 0x20, 0).astype(np.uint64)
            first = data[w.start]
            capital = ((first >= 0x41) & (first <= 0x5A)).astype(np.uint64) + 2 * ((data[end] >= 0x41) & (data[end] <= 0x5A)).astype(np.uint64)
            out[:, 3], out[:, 4] = place(letters, 3), place(capital + np.uint64(7), 3)
            for k, size in enumerate(STEMS):
                out[:, 5 + k] = place(beginnings(w, data, size), 3)
    return out


def chains(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain and place in it for each word: up to CHAIN words of one text."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lead = np.flatnonzero(np.diff(text, prepend=-1))
    within = np.arange(len(text)) - np.repeat(lead, np.diff(lead, append=len(text)))
    place = within % CHAIN
    chain = np.cumsum(place == 0) - 1
    return chain, place, int(chain[-1]) + 1


def forward_backward(score: np.ndarray, steps: np.ndarray, chain: np.ndarray, place: np.ndarray, n: int):
    """Marginals of the toxic state by word, and for each pair of states the expected number of steps between them.

    ``score`` is by word, of the toxic state against the clean one; ``steps`` is 2 by 2.
    """
    length = np.bincount(chain, minlength=n)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    length = length[order]
    top = int(length[0]) if n else 0
    grid = np.zeros((top, n))
    column = rank[chain]
    grid[place, column] = np.exp(np.clip(score, -30, 30))
    t = np.exp(steps)
    live = [int(np.searchsorted(-length, -k, "left")) for k in range(top)]  # chains longer than k
    fore = np.zeros((top, n))  # share of the toxic state, up to here
    back = np.full((top, n), 0.5)  # share of the toxic state, of what comes after
    for k in range(top):
        m, e = live[k], grid[k, : live[k]]
        if k:
            p = fore[k - 1, :m]
            one, zero = (p * t[1, 1] + (1 - p) * t[0, 1]) * e, p * t[1, 0] + (1 - p) * t[0, 0]
        else:
            one, zero = e, 1.0
        fore[k, :m] = one / (one + zero)
    for k in range(top - 2, -1, -1):
        m, e, b = live[k + 1], grid[k + 1, : live[k + 1]], back[k + 1, : live[k + 1]]
        one, zero = t[1, 1] * e * b + t[1, 0] * (1 - b), t[0, 1] * e * b + t[0, 0] * (1 - b)
        back[k, :m] = one / (one + zero)
    both = fore * back / (fore * back + (1 - fore) * (1 - back))
    pairs = np.zeros((2, 2))
    for k in range(1, top):
        m, e, b, p = live[k], grid[k, : live[k]], back[k, : live[k]], fore[k - 1, : live[k]]
        parts = np.array([[(1 - p) * t[0, 0] * (1 - b), (1 - p) * t[0, 1] * e * b], [p * t[1, 0] * (1 - b), p * t[1, 1] * e * b]])
        pairs += (parts / parts.sum((0, 1))).sum(2)
    return both[place, column], pairs


def aggregated(marginal: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """By text: one, log of the sum of the marginals from a half up, the largest marginal, and log of that sum for a thousand words.

    Small marginals don't count, or a long text would be toxic for its length.
    """
    total = np.bincount(text, np.where(marginal >= 0.5, marginal, 0), texts)
    most = np.zeros(texts)
    np.maximum.at(most, text, marginal)
    share = 1000 * total / np.maximum(1, np.bincount(text, minlength=texts))
    return np.stack([np.ones(texts), np.log1p(total), most, np.log1p(share)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.5 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _different(w: Words, y: np.ndarray) -> np.ndarray:
    """One text of those with the same label and smallest shingle, so that copies don't make their words toxic."""
    keys, text, _ = shingles(w, 5)
    least = np.full(w.texts, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, text, mixed(keys))
    pairs = np.stack([least, y.astype(np.uint64)], 1)
    return np.unique(pairs, axis=0, return_index=True)[1]


def _telling(key: np.ndarray, text: np.ndarray, y: np.ndarray, once: np.ndarray, times: int, least: float) -> np.ndarray:
    """The keys that toxic texts have ``times`` or more far more often than others: log odds of LOG_ODDS, in ``least`` toxic texts or more."""
    order = np.lexsort((text, key))
    h, d = key[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    keep = (np.diff(at, append=len(h)) >= times) & once[d[at]]
    h, d = h[at][keep], d[at][keep]
    names, which = np.unique(h, return_inverse=True)
    toxic = np.bincount(which, y[d], len(names))
    clean = np.bincount(which, 1 - y[d], len(names))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    return names[(odds >= LOG_ODDS) & (toxic >= max(least, LEAST * toxic.max(initial=0)))]


def fit(texts: list[str], labels: list[int], rounds: int = 30, rate: float = 0.3) -> Field:
    """A field from a bounded number of labelled texts."""
    y = np.array(labels, np.int64)
    prior = float(y.mean()) if len(y) else 0.0
    empty = Field(np.zeros(SIZE), np.zeros((2, 2)), np.zeros(4), prior)
    if not len(y) or y.min() == y.max():
        return empty
    joined = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(joined), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in joined])])
    w = Words(data, bounds, "plain")
    once = np.isin(np.arange(w.texts), _different(w, y))
    marked = _telling(w.hash, w.text, y, once, 1, max(2.0, LEAST * y.sum()))
    gold = np.isin(w.hash, marked)
    for size in STEMS:
        stems = beginnings(w, data, size)
        gold |= np.isin(stems, _telling(stems, w.text, y, once, 2, max(FEW, LEAST * y.sum())))
    gold &= y[w.text] == 1
    f = features(w, data)
    chain, place, n = chains(w.text)
    weights, steps = np.zeros(SIZE), np.zeros((2, 2))
    past, past_steps = np.full(SIZE, 1e-8), np.full((2, 2), 1e-8)
    inside = place > 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:-1][inside[1:]].astype(int), gold[1:][inside[1:]].astype(int)), 1)
    for _ in range(rounds):
        marginal, pairs = forward_backward(weights[f].sum(1), steps, chain, place, n)
        slope = np.bincount(f.ravel(), np.repeat(marginal - gold, f.shape[1]), SIZE) + 0.01 * weights
        past += slope**2
        weights -= rate * slope / np.sqrt(past)
        slope = pairs - seen + 0.01 * steps
        past_steps += slope**2
        steps = steps - rate * slope / np.sqrt(past_steps)
    marginal, _ = forward_backward(weights[f].sum(1), steps, chain, place, n)
    return Field(weights, steps, _logistic(aggregated(marginal, w.text, len(y)), y.astype(float)), prior)


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, use: Column) -> tuple[list[str], list[int]]:
    """At most SAMPLE short labelled texts of each label, those with the smallest hash of the text.

    They are chosen by id and hash alone; only the chosen texts move.
    """
    short = docs.filter(use & F.col(text).isNotNull() & (F.length(text) <= LONGEST))
    rows = short.select(F.col(id_column).alias("id"), F.col(text).alias("body"), F.xxhash64(text).alias("h"))
    marks = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    known = rows.select("id", "h").join(marks, "id").groupBy("h", "label").agg(F.min("id").alias("id"))
    chosen = [r for k in (0, 1) for r in known.filter(F.col("label") == k).orderBy("h", "id").limit(SAMPLE).collect()]
    if not chosen:
        return [], []
    few = docs.sparkSession.createDataFrame([(r.id, r.h, r.label) for r in chosen], "id long, h long, label int")
    out = rows.join(F.broadcast(few), ["id", "h"]).dropDuplicates(["id", "h", "label"]).select("label", "body").collect()
    out = sorted(out, key=lambda r: (r.label, r.body))
    return [r.body for r in out], [r.label for r in out]


def _scoring(field):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            for i, data, bounds in pieces(batch["body"]):
                w = Words(data, bounds, "plain")
                chain, place, n = chains(w.text)
                marginal = forward_backward(model.weights[features(w, data)].sum(1), model.steps, chain, place, n)[0] if n else np.zeros(0)
                if not model.weights.any():
                    marginal = np.zeros(len(marginal))
                result = model.scores(aggregated(marginal, w.text, w.texts))
                at = np.flatnonzero(marginal >= 0.5)
                places = [characters(data, x[at], bounds, w.text[at]) for x in (w.start, w.start + w.size)]
                cuts = pa.array(np.searchsorted(w.text[at], np.arange(w.texts + 1)), pa.int32())
                spans = pa.StructArray.from_arrays([*map(pa.array, places), pa.array(marginal[at])], ["start", "end", "marginal"])
                yield pa.record_batch(
                    [batch["row"].slice(i, w.texts), batch["id"].slice(i, w.texts), pa.array(result), pa.ListArray.from_arrays(cuts, spans)],
                    ["row", "id", "score", "spans"],
                )

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", use: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: row, id, score, spans (code points and marginal of the toxic words).

    ``use`` (a condition on ``docs``) says from which rows labels may be learnt.
    """
    every = F.lit(True) if use is None else use
    field = fit(*sample(docs, labels, id_column, text, label, every))
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = numbered(docs, text, id_column).select("row", F.col(f"own_{id_column}").alias("id"), "body")
    return rows.mapInArrow(
        _scoring(sent), "row long, id long, score double, spans array<struct<start: long, end: long, marginal: double>>"
    )


def clean_only(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", use: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns."""
    docs = fixed(docs)
    toxic = toxicity(docs, labels, id_column, text, use=use).filter("score >= 0.5")
    return of_rows(docs, toxic, "left_anti")
