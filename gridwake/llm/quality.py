"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores.

Document statistics (length, word and character classes, repetition) are mapped by random Fourier
features, which approximate a Gaussian kernel (Rahimi and Recht 2007). Each partition of labelled
rows adds up its part of the normal equations; the parts are summed in Spark and solved on the
driver (a matrix of fixed size). Raw scores become probabilities by isotonic regression on a fold
that the ridge has not seen, over a fixed number of score bins.

Defined results: null or empty text has the statistics of an empty text and is scored like any
other; very long texts are read whole; repeated rows get equal scores, as do texts of equal statistics;
without labelled rows every score is 0.5; an empty table gives no row; extra columns of the input are
ignored. Labels are read by doc_id, the larger one if a document has several.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

FEATURES = ("bytes", "words", "word_length", "upper", "digit", "punct", "symbol", "bang", "bar", "high", "newline", "distinct", "line_repeats", "line_length", "shouted")
DIMENSIONS = 512
RIDGE = 1e-3
BINS = 400
LOW, HIGH = -0.5, 1.5

_CLASSES = np.zeros((256, 9), np.float64)
for _i, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()-", b"#$%&*@^~<>{}[]\\/=+_`", b"!?", b"|", range(128, 256), b"\n")):
    _CLASSES[list(_of), _i] = 1


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in common.chunks(texts):
        part = texts[lo:hi]
        words = common.Words(part, "word")
        buf = np.frombuffer(words.joined, np.uint8)
        starts = words.text_start
        upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
        length = words.end - words.start
        shouted = np.concatenate([[0], np.cumsum((length > 1) & (upper[words.end] - upper[words.start] == length))])
        for k, text in enumerate(part):
            n, a, b = len(text), words.first[k], words.first[k + 1]
            counts = np.bincount(buf[starts[k] : starts[k] + n], minlength=256) @ _CLASSES
            lines = text.split(b"\n")
            distinct = len(np.unique(words.hash[a:b]))
            letters = max(counts[0] + counts[1] + counts[7], 1)
            out[lo + k] = (
                np.log1p(n), np.log1p(b - a), np.log1p((counts[0] + counts[1] + counts[7]) / max(b - a, 1)),
                counts[0] / letters, *(counts[i] / max(n, 1) for i in (2, 3, 4, 5, 6, 7, 8)),
                distinct / np.sqrt(max(b - a, 1)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), (shouted[b] - shouted[a]) / max(b - a, 1),
            )
    return out


def text_key():
    """What tells rows of one doc_id with unlike texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, key, s array<float>) for each row of docs, repeated rows included; key is a hash of the text."""

    @common.lean
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": f["key"], "s": list(text_statistics(common.encoded(f["text"])).astype(np.float32))})

    return common.texts(docs, "doc_id", "text", text_key().alias("key")).mapInPandas(run, "doc_id long, key long, s array<float>")


class Model:
    """Means and scales of the statistics, the random frequencies, ridge weights, and the isotonic steps."""

    def __init__(self, mean, scale, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequency = rng.normal(size=(len(mean), DIMENSIONS)) / np.sqrt(len(mean)) * 1.5
        self.phase = rng.uniform(0, 2 * np.pi, DIMENSIONS)
        self.weights, self.at, self.value = np.zeros(DIMENSIONS + 1), np.array([0.0]), np.array([0.5])

    def project(self, s: np.ndarray) -> np.ndarray:
        x = np.clip((s - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / DIMENSIONS) * np.cos(x @ self.frequency + self.phase)
        return np.hstack([z, np.ones((len(s), 1))])

    def raw(self, s: np.ndarray) -> np.ndarray:
        return self.project(s) @ self.weights

    def score(self, s: np.ndarray) -> np.ndarray:
        raw = self.raw(s)
        # a thousandth of the raw score keeps the order within an isotonic step
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(bins: np.ndarray, positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the increasing means closest to positive / count."""
    blocks: list[list[float]] = []
    for p, c in zip(positive, count, strict=True):
        blocks.append([float(p), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / c) for p, c, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, label: str, learn) -> Model | None:
    """Fit on all rows of stats whose label may be learnt; None without any.

    learn: a condition on doc_id. A quarter of the learnt rows is kept for the isotonic step.
    """
    known = labels.where(F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    rows = stats.drop("key").join(known, "doc_id").withColumn("later", common.crc_mod("doc_id", 20) >= 15)
    rows = common.stored(rows, "quality-rows")
    n = len(FEATURES)
    at = [F.col("s")[i].cast("double") for i in range(n)]
    first = rows.agg(F.count("*"), *(f(x) for x in at for f in (F.avg, F.stddev_pop))).first()
    if not first[0]:
        return None
    model = Model(np.array(first[1::2]), np.maximum(np.array(first[2::2]), 1e-3))

    def gram(frames):
        total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 2))
        for f in frames:
            if len(f):
                z = model.project(np.stack(f["s"].to_numpy()).astype(np.float64))
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ f["y"].to_numpy()
        yield pd.DataFrame({"i": range(DIMENSIONS + 1), "v": [r.tobytes() for r in total]})

    def summed(f):
        return pd.DataFrame({"i": f["i"][:1], "v": [np.sum([np.frombuffer(v) for v in f["v"]], axis=0).tobytes()]})

    parts = rows.where("not later").select("s", "y").mapInPandas(gram, "i int, v binary")
    # two levels, so that no task meets the parts of all partitions
    parts = parts.groupBy("i", F.spark_partition_id().alias("p") % 16).applyInPandas(lambda f: summed(f), "i int, v binary").groupBy("i").applyInPandas(lambda f: summed(f), "i int, v binary")
    total = np.stack([np.frombuffer(r["v"]) for r in sorted(parts.collect(), key=lambda r: r["i"])])
    a = total[:, :-1] + RIDGE * max(total[-1, -2], 1) * np.diag(np.append(np.ones(DIMENSIONS), 0)) / DIMENSIONS
    model.weights = np.linalg.solve(a + 1e-9 * np.eye(len(a)), total[:, -1])

    def binned(frames):
        for f in frames:
            raw = model.raw(np.stack(f["s"].to_numpy()).astype(np.float64)) if len(f) else np.zeros(0)
            b = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            yield pd.DataFrame({"b": b, "y": f["y"].to_numpy()})

    hist = rows.where("later").select("s", "y").mapInPandas(binned, "b int, y double").groupBy("b").agg(F.sum("y").alias("p"), F.count("*").alias("c")).orderBy("b").collect()
    if hist:
        b, p, c = (np.array([r[k] for r in hist], float) for k in range(3))
        # one positive and one negative row in all, spread over the bins, keep scores off 0 and 1
        model.at, model.value = LOW + (b + 0.5) * (HIGH - LOW) / BINS, isotonic(b, p + 1 / len(b), c + 2 / len(b))
    else:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scores(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, key, score) of each row of stats."""

    def run(frames):
        for f in frames:
            s = np.full(len(f), 0.5) if model is None or not len(f) else model.score(np.stack(f["s"].to_numpy()).astype(np.float64))
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": f["key"], "score": s})

    return stats.mapInPandas(run, "doc_id long, key long, score double")


def dumps(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, mean=model.mean, scale=model.scale, weights=model.weights, at=model.at, value=model.value)
    return out.getvalue()


def loads(data: bytes) -> Model:
    x = np.load(io.BytesIO(data))
    model = Model(x["mean"], x["scale"])
    model.weights, model.at, model.value = x["weights"], x["at"], x["value"]
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; rows with crc32(doc_id) % fold = 0 are never learnt."""
    return judged(docs, labels, label, fold, threshold).drop("key")


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the rows that are predicted 0; rows without doc_id stay, rows of one doc_id are judged each."""
    bad = common.stored(judged(docs, labels, **how).where("predicted = 0").select("doc_id", F.col("key").alias("_key")).distinct(), "quality-rejected")
    return docs.withColumn("_key", text_key()).join(bad, ["doc_id", "_key"], "left_anti").select(*docs.columns)


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """As classify(), with the key of each row's text."""
    stats = common.stored(statistics(docs), "quality-stats")
    model = fit(stats, labels, label, common.crc_mod("doc_id", fold) != 0)
    out = scores(stats, model)
    return out.select("doc_id", "key", (common.crc_mod("doc_id", fold) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
