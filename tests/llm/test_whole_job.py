"""Small cases of the whole job: inputs that earlier versions cut, skipped or failed on."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwake.llm import common, decontaminate, extract, langid, quality, repeats, toxicity

# --- labelled samples -------------------------------------------------------------------------


def test_labelled_ids_and_fitted(spark):
    rows = [(i, i % 2) for i in range(20)] + [(3, 0), (4, None), (None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {r["doc_id"]: r["y"] for r in common.labelled_ids(labels, "toxic", F.col("doc_id") != 5, 100).collect()}
    assert got == {i: i % 2 for i in range(20) if i != 5}
    assert common.labelled_ids(labels, "toxic", F.lit(True), 7).count() == 7
    learn = lambda f: f"{len(f)} {f['y'].sum()}".encode()
    sample = spark.createDataFrame(pd.DataFrame({"y": [1, 2, 3]})).repartition(3)
    assert common.fitted(sample, learn) == b"3 6"
    assert common.fitted(sample.where("y > 9"), learn) is None


# --- pages ------------------------------------------------------------------------------------


def test_copies_are_no_templates(spark):
    rows = [(i, "http://a.com/x", "<html><body><p>One story.</p><p>Its end.</p></body></html>") for i in range(4)]
    rows += [(10 + i, "http://a.com/y", f"<html><body><div>Site frame</div><p>Text of page number {i}</p></body></html>") for i in range(3)]
    # near copies: a long shared block, and a line of their own
    rows += [(20 + i, "http://b.com/z", f"<html><body><span>seen {i} times</span><div><p>A long passage</p><p>of one common text</p></div></body></html>") for i in range(3)]
    rows += [(30 + i, "http://c.com/w", None) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {i: "One story.\nIts end." for i in range(4)}
    want |= {10 + i: f"Text of page number {i}" for i in range(3)}
    want |= {20 + i: f"seen {i} times\nA long passage\nof one common text" for i in range(3)}
    assert got == want | {30 + i: "" for i in range(3)}


# --- repeats ----------------------------------------------------------------------------------


def places_hold(w):
    """Every run's minimizer lies in all of its windows, and is the least there."""
    assert (w.p >= w.hi).all() and (w.p + repeats.K <= w.lo + repeats.LENGTH).all()


def test_places_of_long_texts():
    passage = np.random.default_rng(1).integers(97, 123, 400, dtype=np.uint8).tobytes()
    filler = np.random.default_rng(2).integers(32, 127, 2**24 + 50_000, dtype=np.uint8).tobytes()
    a, b = repeats.Windows([filler + passage]), repeats.Windows([passage])
    places_hold(a)
    assert set(b.anchor.tolist()) <= set(a.anchor.tolist())
    at = (a.lo + a.shift)[a.p + a.shift >= len(filler) + 100]
    assert at.min() >= 2**24 and at.max() <= len(filler) + 300


@pytest.mark.parametrize("block", [150, 400])
def test_places_by_block(monkeypatch, block):
    monkeypatch.setattr(repeats, "_BLOCK", block)
    monkeypatch.setattr(repeats, "_PLACE", np.uint64(0x1FF))
    texts = [np.random.default_rng(i).integers(97, 123, n, dtype=np.uint8).tobytes() for i, n in enumerate((3000, 90, 0, 700, 100))]
    w = repeats.Windows(texts)
    places_hold(w)
    got = {(int(t), int(s)): int(p + d) for t, lo, hi, p, d in zip(w.text, w.lo + w.shift, w.hi + w.shift, w.p, w.shift, strict=True) for s in range(lo, hi + 1)}
    want = {}
    for i, t in enumerate(texts):
        code = common._BYTE[np.frombuffer(t, np.uint8)]
        h = common.prefix_hash(code)
        g = common.mix((h[repeats.K :] - h[: -repeats.K]) * common.inverses(len(h))[: max(len(t) - repeats.K + 1, 0)]) if len(t) >= repeats.K else []
        for s in range(len(t) - repeats.LENGTH + 1):
            want[i, s] = s + int(np.argmin(g[s : s + repeats.LENGTH - repeats.K + 1] >> np.uint64(9)))
    assert got == want


# --- toxicity ---------------------------------------------------------------------------------


def toxic_model():
    rng = np.random.default_rng(4)
    weights = {k: rng.normal(0, 1, toxicity.EMISSIONS).astype(np.float32) for k in ("own", "left")}
    return {**weights, "bias": -0.2, "trans": np.array([[1.5, -1.0], [-0.7, 1.2]]), "start": np.array([0.4, -0.3])}


def test_texts_are_whole_chains():
    model, rng = toxic_model(), np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)).encode() for n in (1, 32, 33, 0, 100, 300, 64, 5)]
    words = common.Words(texts, "word")
    m = toxicity.summary(model, words)[1]
    for i in range(len(texts)):
        own = (words.hash[words.text == i] & np.uint64(toxicity.EMISSIONS - 1)).astype(int)
        left = (np.concatenate([[0], own[:-1]]) * 31 + 7) & (toxicity.EMISSIONS - 1) if len(own) else own
        e = (model["own"][own] + model["left"][left] + model["bias"])[None]
        if len(own):  # one segment as long as the text
            want = toxicity.marginals(e, np.ones(e.shape, bool), model["trans"], model["start"])[0][0]
            np.testing.assert_allclose(m[words.text == i], want, rtol=1e-9, atol=1e-12)


def test_neighbours_do_not_change_a_score():
    model = toxic_model()
    texts = [b"some words first", b"the text itself", b"", b"another one", b"the text itself"]
    x, m = toxicity.summary(model, words := common.Words(texts, "word"))
    alone, own = toxicity.summary(model, common.Words(texts[1:2], "word"))
    for i in (1, 4):
        np.testing.assert_array_equal(x[i], alone[0])
        np.testing.assert_array_equal(m[words.text == i], own)


# --- languages --------------------------------------------------------------------------------


def test_training_reads_whole_texts(spark):
    rng, start = np.random.default_rng(8), "1 " * 10_000
    words = {"en": ["the", "house", "with", "which", "they", "thing"], "de": ["das", "haus", "und", "nicht", "auch", "dinge"]}
    rows = [(i, start + " ".join(rng.choice(words[k], 200)), k) for i in range(120) for k in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == r["lang"] for r in got)


# --- decontamination --------------------------------------------------------------------------


@pytest.mark.parametrize("n", range(1, 13))
def test_short_items_have_a_seed_for_every_pattern(n):
    need = -(-n * decontaminate.LEAST // decontaminate.WINDOW)
    for wrong in (c for k in range(n - need + 1) for c in combinations(range(n), k)):
        assert any(all(o + k not in wrong for k in mask) for mask in decontaminate.masks_of(n) for o in range(n - mask[-1]))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_short_items_are_found(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    items, rows = [], []
    for n in range(1, 14):
        w = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        allowed = n - -(-min(n, 13) * 10 // 13)
        for wrong in combinations(range(n), min(allowed, 2)):
            rows.append((len(rows), n, "a b " + " ".join("x" if k in wrong else v for k, v in enumerate(w)) + " c"))
        if n > 1:  # one word too many is wrong; none of these may match
            rows.append((len(rows), None, " ".join("x" if k < allowed + 1 else v for k, v in enumerate(w))))
        if allowed:  # an end of the item is beyond the document's
            rows += [(len(rows), n, " ".join(w[allowed:])), (len(rows) + 1, n, " ".join(w[:-allowed]))]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, n) for i, n, _ in rows if n}


# --- training ---------------------------------------------------------------------------------


def test_expected_transitions_of_a_chain_in_segments(monkeypatch):
    """Segments of 4 with messages carried over give the marginals and expected transitions of the whole chain."""
    monkeypatch.setattr(toxicity, "SEGMENT", 4)
    rng = np.random.default_rng(7)
    n = 10
    scores, trans, start = rng.normal(0, 1.5, n), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    weight, one, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for states in np.ndindex(*[2] * n):
        w = np.exp(start[states[0]] + sum(scores[i] * s for i, s in enumerate(states)) + sum(trans[a, b] for a, b in zip(states, states[1:], strict=False)))
        weight += w
        one += w * np.array(states)
        for a, b in zip(states, states[1:], strict=False):
            pairs[a, b] += w
    words = common.Words([b" ".join(b"w%d" % i for i in range(n))], "word")
    at, text = toxicity.segments(words)
    ok = at >= 0
    e = np.where(ok, scores[np.maximum(at, 0)], 0.0)
    enter, leave = toxicity.messages(e, ok, trans, start, text)
    m, within, behind = toxicity.marginals(e, ok, trans, start, enter, leave)
    over = np.arange(1, len(at))
    joint = np.stack([1 - m[over - 1, -1], m[over - 1, -1]], 1)[:, :, None] * toxicity.crossing(e, trans, behind, over)
    assert m[ok] == pytest.approx(one / weight)
    assert within + joint.sum(0) == pytest.approx(pairs / weight)


def test_ridge_equals_a_direct_solution(spark):
    """Normal equations added up over partitions give the weights that one matrix of all rows gives."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "BETA", "g4mma", "delta!", "x"], rng.integers(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int("!" in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(quality.statistics(docs), labels, "quality", common.crc_mod("doc_id", 5) != 0)
    learnt = [i for i in range(300) if common.crc_fold(i) % 5]
    s = quality.text_statistics([texts[i].encode() for i in learnt]).astype(np.float32).astype(float)
    assert model.mean == pytest.approx(s.mean(0)) and model.scale == pytest.approx(np.maximum(s.std(0), 1e-3), rel=1e-6)
    use = np.array([common.crc_fold(i) % 20 < 15 for i in learnt])
    z, y = model.project(s[use]), np.array([float("!" in texts[i]) for i in learnt])[use]
    penalty = quality.RIDGE * len(y) * np.diag(np.append(np.ones(quality.DIMENSIONS), 0)) / quality.DIMENSIONS
    direct = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    assert z @ model.weights == pytest.approx(z @ direct, abs=1e-6)


def test_letters_are_those_of_unicode(spark):
    docs = spark.createDataFrame([(1, "½ ² ①"), (2, "ⅷ 7"), (3, "é"), (4, "日本"), (5, "_ 9"), (6, "hello there"), (7, None)], "doc_id long, text string").withColumns({"lang": F.lit("en")})
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert out == {1: "und", 2: "und", 3: "en", 4: "en", 5: "und", 6: "en", 7: "und"}


def test_training_sample_is_bounded_by_bytes(spark, monkeypatch):
    """Rows are taken in the order of their crc32 while their bytes fit, each of them whole."""
    seen = []
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1000)
    monkeypatch.setattr(common, "fitted", lambda sample, train: seen.extend(sample.collect()))
    docs = spark.createDataFrame([(i, "z" * 300) for i in range(20)] + [(3, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, "toxic", F.lit(True)) is None
    order = sorted(range(20), key=common.crc_fold)
    fits, total = [], 0
    for i in order:
        total += 1 if i == 3 else 300
        if total <= 1000:
            fits.append(i)
    assert len(seen) == len(fits) and sum(len(r["text"]) for r in seen) == sum(1 if i == 3 else 300 for i in fits)


def test_a_huge_row_does_not_end_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1000)
    monkeypatch.setattr(common, "fitted", lambda sample, train: seen.extend(sample.collect()))
    first = min(range(20), key=common.crc_fold)
    docs = spark.createDataFrame([(i, "z" * (5000 if i == first else 40)) for i in range(20)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"), "toxic", F.lit(True))
    assert [len(r["text"]) for r in seen] == [40] * 19


def test_offsets_of_long_texts_are_code_points(spark, monkeypatch):
    """All words of a text with wide characters, tagged: offsets equal those found in the text itself."""
    monkeypatch.setattr(toxicity, "summary", lambda model, words: (np.ones((len(words.text_start) - 1, 1)), np.ones(len(words.hash))))
    text = "ä€ 😀x, naïve! " * 4000 + "end"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "é a")], "doc_id long, text string")
    frame = docs.toPandas()
    made = {}

    class Frame:
        def mapInPandas(self, run, schema):
            made.update({i: [tuple(x.values()) for x in s] for f in run(iter([frame])) for i, s in zip(f["doc_id"], f["spans"], strict=True)})

    monkeypatch.setattr(common, "texts", lambda df, *c: Frame())
    toxicity.tagged(docs, {"doc": np.zeros(1)})
    import re

    words = lambda t: [m.span() for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t or "")]
    assert made == {1: words(text), 2: [], 3: [], 4: words("é a")}


def test_tokens_equal_words_of_all_texts(monkeypatch):
    texts = [b"one two", b"", b"three", b"four five six seven", b"  ", b"eight"]
    whole = common.Words(texts, "word")
    chunks = common.chunks
    monkeypatch.setattr(common, "chunks", lambda t: chunks(t, 8))
    got = toxicity.tokens(texts)
    for name in ("hash", "text", "first"):
        assert getattr(got, name).tolist() == getattr(whole, name).tolist(), name
    assert len(toxicity.tokens([]).hash) == 0 and toxicity.tokens([]).first.tolist() == [0]
