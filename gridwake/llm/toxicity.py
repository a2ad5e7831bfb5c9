"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents only, so words that stand out in toxic documents (by smoothed odds,
each distinct text counted once) label the tokens of the training sample. A two-state CRF with
hashed emissions for a token and its left neighbour is then trained by gradient steps on the exact
log-likelihood. A text is one chain, in training as in scoring: it is worked on in segments of SEGMENT
tokens, and forward and backward messages are carried over them. A logistic model on the marginals'
maximum, sum and share gives the score of a document, and tokens with marginal >= 0.5 give the
offending offsets.

The sample is that of the labelled rows of least crc32 of doc_id: at most TRAIN_ROWS rows, and no more
rows than have TRAIN_BYTES bytes together; every one of them is used whole.

Defined results: null and empty texts have no token and are scored like any text without a toxic
token; without labelled rows every score is 0. Of rows that share a doc_id the least text is learnt;
very long texts are tagged whole; repeated rows and ties score alike; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import pickle
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.llm import common

SEGMENT = 32
EMISSIONS = 1 << 18
#: Bounds of the labelled rows that training sees: their number, and their bytes together.
TRAIN_ROWS = 8000
TRAIN_BYTES = 32 << 20
#: Segments of one gradient step, rounded up to whole texts.
STEP = 1000
LEAST_ODDS = 8.0


def segments(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (segments, SEGMENT), -1 beyond the end, and the text of each segment."""
    counts = np.diff(words.first[: len(words.text_start)])
    per = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), per)
    begin = words.first[:-1][text] + SEGMENT * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    at = begin[:, None] + np.arange(SEGMENT)
    return np.where(at < words.first[1:][text][:, None], at, -1), text


def marginals(e: np.ndarray, valid: np.ndarray, trans: np.ndarray, start: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """P(state 1) of each token; of each pair of neighbouring tokens of a segment the four states' marginals, summed;
    and the messages to the first tokens from those after them.

    e: log-odds of state 1 (segments, tokens); trans: log potentials (2, 2). Sums are scaled by token.
    enter, leave: messages (segments, 2) to the first tokens' states, in place of start, and from behind the last ones.
    """
    n, length = e.shape
    a1, a0 = np.empty((length, n)), np.empty((length, n))
    t = np.exp(trans)
    x = np.exp(np.clip(e.T, -30, 30))
    enter = np.tile(np.exp(start), (n, 1)) if enter is None else enter
    p0, p1 = enter[:, 0], enter[:, 1] * x[0]
    s = p0 + p1
    a0[0], a1[0] = p0 / s, p1 / s
    for i in range(1, length):
        p0 = a0[i - 1] * t[0, 0] + a1[i - 1] * t[1, 0]
        p1 = (a0[i - 1] * t[0, 1] + a1[i - 1] * t[1, 1]) * x[i]
        s = p0 + p1
        a0[i], a1[i] = p0 / s, p1 / s
    b0, b1 = (np.ones(n), np.ones(n)) if leave is None else leave.T
    out = np.empty((length, n))
    pairs = np.zeros((2, 2))
    ok = valid.T
    for i in range(length - 1, -1, -1):
        s = a0[i] * b0 + a1[i] * b1
        out[i] = a1[i] * b1 / s
        if i:
            c0, c1 = b0, b1 * x[i]
            z = a0[i - 1] * (t[0, 0] * c0 + t[0, 1] * c1) + a1[i - 1] * (t[1, 0] * c0 + t[1, 1] * c1)
            k = ok[i]
            z = np.where(k, z, 1)
            for j, a in enumerate((a0[i - 1], a1[i - 1])):
                pairs[j] += [(a * t[j, 0] * c0 / z)[k].sum(), (a * t[j, 1] * c1 / z)[k].sum()]
            d0, d1 = t[0, 0] * c0 + t[0, 1] * c1, t[1, 0] * c0 + t[1, 1] * c1
            s = d0 + d1
            # beyond a text's end nothing is seen: the message stays flat
            b0, b1 = np.where(k, d0 / s, 1.0), np.where(k, d1 / s, 1.0)
    return out.T, pairs, np.stack([b0, b1], 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (n, 2, 2), each scaled to sum 1."""
    out = a[:, :, :1] * b[:, :1, :] + a[:, :, 1:] * b[:, 1:, :]
    return out / out.sum((1, 2), keepdims=True)


def messages(e: np.ndarray, valid: np.ndarray, trans: np.ndarray, start: np.ndarray, text: np.ndarray):
    """enter and leave of marginals() for segments that are the chains of their texts, in order."""
    n, length = e.shape
    t, x = np.exp(trans), np.exp(np.clip(e, -30, 30))
    first = np.concatenate([[True], text[1:] != text[:-1]])
    at = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    whole = np.tile(np.eye(2), (n, 1, 1))
    for i in range(length):
        step = np.tile(t, (n, 1, 1))
        if i == 0:  # a text's first token forgets what is before it
            step[first] = np.exp(start)
        step[:, :, 1] *= x[:, i, None]
        whole = np.where(valid[:, i, None, None], product(whole, step), whole)
    before, behind, by = whole, whole.copy(), 1
    while by <= at.max():  # products of 2 * by segments from those of by
        k = np.flatnonzero(at >= by)
        joined, after = product(before[k - by], before[k]), product(behind[k - by], behind[k])
        before, behind = before.copy(), behind.copy()
        before[k], behind[k - by] = joined, after
        by *= 2
    enter, leave = np.tile(np.exp(start), (n, 1)), np.ones((n, 2))
    k = np.flatnonzero(~first)
    enter[k] = before[k - 1].sum(1) @ t
    leave[k - 1] = behind[k].sum(2)
    return enter, leave


def crossing(e, trans, behind, over) -> np.ndarray:
    """P(first state of segment k | last state of segment k - 1) for the segments `over`, (n, 2, 2): what is before
    the last token of k - 1 has no say. behind: messages to the first tokens from those after them."""
    given = np.exp(trans)[None] * (behind[over] * np.stack([np.ones(len(over)), np.exp(np.clip(e[over, 0], -30, 30))], 1))[:, None, :]
    return given / given.sum(2, keepdims=True)


def buckets(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Emission buckets of each token's own word, and of its left neighbour's, the same one for all first words of texts."""
    h = words.hash
    own = (h & np.uint64(EMISSIONS - 1)).astype(np.int64)
    left = np.concatenate([[0], own[:-1]]) if len(own) else own
    left[words.first[words.first < len(own)]] = 0
    return own, (left * 31 + 7) & (EMISSIONS - 1)


def tokens(texts: list[bytes]) -> SimpleNamespace:
    """What training needs of Words of many texts, made of a few at a time."""
    parts = []
    for lo, hi in common.chunks(texts):
        w = common.Words(texts[lo:hi], "word")
        parts.append((lo, w.hash, w.text, w.first[:-1]))
    before = np.concatenate([[0], np.cumsum([len(h) for _, h, _, _ in parts])]).astype(np.int64)
    joined = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)]).astype(kind)
    return SimpleNamespace(
        hash=joined([h for _, h, _, _ in parts], np.uint64),
        text=joined([t + lo for lo, _, t, _ in parts], np.int64),
        first=np.append(joined([f + b for (_, _, _, f), b in zip(parts, before, strict=False)], np.int64), before[-1]),
        text_start=np.arange(len(texts) + 1),
    )


def train(f: pd.DataFrame) -> bytes:
    """f: text, y of labelled documents. The pickled model."""
    f = f.drop_duplicates("text")
    texts, y = common.encoded(f["text"]), f["y"].to_numpy().astype(int)
    words = tokens(texts)
    toxic = y[words.text].astype(bool) if len(words.text) else np.zeros(0, bool)
    pair = np.unique(np.stack([words.hash, words.text.astype(np.uint64)], 1), axis=0) if len(words.text) else np.zeros((0, 2), np.uint64)
    vocab, which = np.unique(pair[:, 0], return_inverse=True)
    inside = np.bincount(which, weights=y[pair[:, 1].astype(int)], minlength=len(vocab)) if len(vocab) else np.zeros(0)
    total = np.bincount(which, minlength=len(vocab)) if len(vocab) else np.zeros(0)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = (inside + 0.5) / (n1 + 1) / ((total - inside + 0.5) / (n0 + 1))
    seeds = vocab[(odds >= LEAST_ODDS) & (inside >= max(3, 0.01 * n1))]
    tag = np.isin(words.hash, seeds) & toxic
    at, text = segments(words)
    rng = np.random.default_rng(3)
    own, left = buckets(words)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
    many = np.diff(np.concatenate([begin, [len(text)]])).astype(int) if len(text) else text
    w_own, w_left, bias = np.zeros(EMISSIONS), np.zeros(EMISSIONS), -4.0
    trans, start = np.zeros((2, 2)), np.zeros(2)
    g_own, g_left = np.full(EMISSIONS, 1e-2), np.full(EMISSIONS, 1e-2)
    for _ in range(4):
        chains = rng.permutation(len(begin))
        step = np.cumsum(many[chains]) // STEP if len(chains) else chains
        for group in np.split(chains, np.flatnonzero(np.diff(step)) + 1) if len(chains) else ():
            k = np.arange(many[group].sum()) - np.repeat(np.cumsum(many[group]) - many[group], many[group])
            part = np.repeat(begin[group], many[group]) + k
            a = at[part]
            opens = k == 0
            ok = a >= 0
            k = np.maximum(a, 0)
            e = np.where(ok, w_own[own[k]] + w_left[left[k]] + bias, 0)
            enter, leave = messages(e, ok, trans, start, text[part])
            m, pairs, behind = marginals(e, ok, trans, start, enter, leave)
            gold = (tag[k] & ok).astype(float)
            d = np.where(ok, gold - m, 0)
            for w, g, b in ((w_own, g_own, own), (w_left, g_left, left)):
                grad = np.bincount(b[k].ravel(), weights=d.ravel(), minlength=EMISSIONS) - 1e-3 * w
                g += grad * grad
                w += (1.0 if w is w_own else 0.2) * grad / np.sqrt(g)
            bias += 0.2 * d.sum() / max(ok.sum(), 1)
            seen = np.zeros((2, 2))
            g0 = gold.astype(int)
            both = ok[:, 1:] & ok[:, :-1]
            np.add.at(seen, (g0[:, :-1][both], g0[:, 1:][both]), 1)
            # the neighbours on both sides of a segment's edge
            over = np.flatnonzero(~opens)
            np.add.at(seen, (g0[over - 1, -1], g0[over, 0]), 1)
            joint = np.stack([1 - m[over - 1, -1], m[over - 1, -1]], 1)[:, :, None] * crossing(e, trans, behind, over)
            pairs = pairs + joint.sum(0)
            trans += 0.5 * (seen - pairs) / max(ok.sum(), 1)
            start += 0.5 * np.array([-d[opens, 0].sum(), d[opens, 0].sum()]) / max(opens.sum(), 1)
    model = {"own": w_own.astype(np.float32), "left": w_left.astype(np.float32), "bias": bias, "trans": trans, "start": start, "doc": None}
    x = summary(model, words)[0]
    b = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of a logistic model with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        b += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b)
    model["doc"] = b
    return pickle.dumps(model)


def summary(model: dict, words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and the marginal of each token."""
    n = len(words.text_start) - 1
    m = np.zeros(len(words.hash))
    if len(m):
        own, left = buckets(words)
        at, text = segments(words)
        ok = at >= 0
        e = np.where(ok, (model["own"][own] + model["left"][left])[np.maximum(at, 0)] + model["bias"], 0)
        chain = model["trans"], model["start"]
        m[at[ok]] = marginals(e, ok, *chain, *messages(e, ok, *chain, text))[0][ok]
    count = np.bincount(words.text, minlength=n)
    total = np.bincount(words.text, weights=m * (m > 0.05), minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, words.text, m)
    return np.stack([np.ones(n), most, np.log1p(total), np.minimum(1, 10 * total / np.maximum(count, 1))], 1), m


def fit(docs: DataFrame, labels: DataFrame, label: str, learn) -> dict | None:
    ids = common.labelled_ids(labels, label, learn, TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.octet_length(F.min("text")).alias("b"))
    sizes = sizes.where(F.col("b").isNull() | (F.col("b") <= TRAIN_BYTES))  # a row that is too long alone is left out, not those behind it
    so_far = F.sum("b").over(Window.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id"))
    few = common.stored(sizes.withColumn("sum", so_far).where(F.col("sum").isNull() | (F.col("sum") <= TRAIN_BYTES)).select("doc_id", "y"), "toxicity-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    data = common.fitted(common.texts(rows, "text", "y"), train)
    return None if data is None else pickle.loads(data)


def tagged(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score, spans): spans of toxic tokens in code points, end exclusive."""

    @common.lean
    def run(frames):
        for f in frames:
            texts = common.encoded(f["text"])
            score, spans = np.zeros(len(texts)), [[] for _ in texts]
            for lo, hi in common.chunks(texts) if model else ():
                words = common.Words(texts[lo:hi], "word")
                x, m = summary(model, words)
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(x @ model["doc"], -30, 30)))
                hit = np.flatnonzero(m >= 0.5)
                if len(hit):  # places in code points: one count over the bytes that begin one
                    points = np.concatenate([[0], np.cumsum(np.frombuffer(words.joined, np.uint8) & 0xC0 != 0x80)])
                    base = points[words.text_start[words.text[hit]]]
                    for k, s, e in zip(words.text[hit].tolist(), (points[words.start[hit]] - base).tolist(), (points[words.end[hit]] - base).tolist(), strict=True):
                        spans[lo + k].append({"start": s, "end": e})
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": score, "spans": spans})

    return common.texts(docs, "doc_id", "text").mapInPandas(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for each row of docs."""
    crc = common.crc_mod("doc_id", fold)
    out = tagged(docs, fit(docs, labels, label, crc != held))
    return out.select("doc_id", (crc == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
