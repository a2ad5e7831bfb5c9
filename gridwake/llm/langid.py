"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters give byte trigrams (other characters count as one blank), each hashed to one of
BUCKETS embeddings; their mean is classified by a linear softmax. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on at most TRAIN_ROWS labelled documents. As both
steps are linear, a text is scored by its bucket counts times one product matrix.

The probabilities are calibrated by a temperature on a part of the sample that training has not
seen; a document is `rejected` below the least score at which ACCEPTED of that part are right.

Defined results: null text, or text without a letter (a character of the Unicode classes L), is `und`
with score 0; without labelled rows every document is. Of rows that share a doc_id the least text is
learnt; ties of score go to the first language by name; very long texts are counted whole; repeated
rows score alike; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

BUCKETS = 4096
WIDTH = 16
#: Bound of the rows that training sees; their texts are counted whole, where they are read.
TRAIN_ROWS = 6000
EPOCHS = 6
ACCEPTED = 0.995

_LETTER = regex.compile(r"\p{L}")
_rng = np.random.default_rng(11)
_KEYS = _rng.integers(0, 2**32, (3, 256), dtype=np.uint32)
_MULTIPLIER = 2654435769
_FOLD = np.zeros(256, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Trigram counts by bucket, a row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    keys = [k[_FOLD] for k in _KEYS]
    of_blank = (int(_KEYS[0][0] ^ _KEYS[1][0] ^ _KEYS[2][0]) * _MULTIPLIER) % 2**32 >> 20
    for i, text in enumerate(texts):
        for at in range(0, len(text), 4_000_000):
            b = np.frombuffer(b" " + text[max(at - 2, 0) : at + 4_000_000] + b" " if at == 0 else text[at - 2 : at + 4_000_000] + b" ", np.uint8)
            g = keys[0][b[:-2]] ^ keys[1][b[1:-1]] ^ keys[2][b[2:]]
            blank = (_FOLD[b[:-2]] | _FOLD[b[1:-1]] | _FOLD[b[2:]]) == 0
            n = np.bincount((g * np.uint32(_MULTIPLIER)) >> np.uint32(20), minlength=BUCKETS)
            n[of_blank] -= blank.sum()
            out[i] += n
    return out


@common.lean
def counted(frames):
    """Frames of text, lang to lang and the buckets that its text has, with their counts."""
    for f in frames:
        texts = common.encoded(f["text"])
        for at in range(0, len(texts), 1000):
            c = bucket_counts(texts[at : at + 1000])
            has = [np.flatnonzero(row) for row in c]
            yield pd.DataFrame({"lang": f["lang"].iloc[at : at + 1000].to_numpy(), "bucket": [k.astype(np.int32) for k in has], "n": [row[k] for row, k in zip(c, has, strict=True)]})


def train(f: pd.DataFrame) -> bytes:
    """f: lang, bucket, n. A pickled dict of languages, product matrix, bias, temperature, least score."""
    langs = sorted(set(f["lang"]))
    y = np.searchsorted(langs, f["lang"].to_numpy().astype(str)) if len(langs) > 1 else np.zeros(len(f), int)
    x = np.zeros((len(f), BUCKETS), np.float32)
    for row, k, n in zip(x, f["bucket"], f["n"], strict=True):
        row[np.asarray(k, np.int64)] = n
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(x))
    held, learn = order[: len(x) // 5], order[len(x) // 5 :]
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    bias, rate = np.zeros(len(langs), np.float32), 60.0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 32)):
            h = x[part] @ e
            p = softmax(h @ w + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            step = rate / (1 + epoch)
            back = p @ w.T
            w -= 0.02 * step * h.T @ p
            bias -= 0.002 * step * p.sum(0)
            e -= step * x[part].T @ back
    m = (e @ w).astype(np.float32)
    logits = x[held] @ m + bias
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 40):
        q = softmax(logits / t)[np.arange(len(held)), y[held]]
        best = min(best, (-np.log(np.maximum(q, 1e-12)).mean() if len(held) else 0, t))
    q = softmax(logits / best[1])
    top, right = q.max(1, initial=0), q.argmax(1) == y[held] if len(held) else np.zeros(0, bool)
    by = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[by]) >= ACCEPTED * np.arange(1, len(by) + 1))
    least = float(top[by][good[-1]]) if len(good) else 0.0
    return pickle.dumps({"langs": langs, "m": m, "bias": bias, "t": best[1], "least": least})


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True, initial=-1e30))
    return z / z.sum(1, keepdims=True)


def fit(docs: DataFrame, learn) -> dict | None:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    ids = rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(TRAIN_ROWS)
    one = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.*")
    sample = common.texts(one, "text", "lang").mapInPandas(counted, "lang string, bucket array<int>, n array<float>")
    data = common.fitted(sample, train)
    return None if data is None else pickle.loads(data)


def identify(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs."""
    crc = common.crc_mod("doc_id", fold)
    model = fit(docs.select("doc_id", "text", "lang"), crc != held)

    @common.lean
    def run(frames):
        for f in frames:
            n = len(f)
            lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            has = np.array([isinstance(t, str) and bool(_LETTER.search(t)) for t in f["text"]], bool)
            if model is not None and has.any():
                texts = common.encoded(f["text"][has])
                for at in range(0, len(texts), 1000):
                    c = bucket_counts(texts[at : at + 1000])
                    q = softmax((c @ model["m"] / np.maximum(c.sum(1, keepdims=True), 1) + model["bias"]) / model["t"])
                    where = np.flatnonzero(has)[at : at + 1000]
                    lang[where] = np.array(model["langs"], object)[q.argmax(1)]
                    score[where] = q.max(1)
                rejected = score < model["least"]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": lang, "score": np.clip(score, 0, 1), "rejected": rejected})

    out = common.texts(docs, "doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (crc == held).alias("held_out"), "lang_pred", "score", "rejected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
