"""Filter interaction audit against a run of every order over every row."""

import re
from itertools import permutations

import pytest
from fixtures import SCHEMA, corpus, frame

from gridwake.llm import interactions


def fails(rows):
    """(part, doc_id, failed letters) of each row."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        yield lang or "", i, found + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least[t])


def brute(rows, good, toxic):
    rows = list(fails(rows))
    out = {}
    for part in {p for p, *_ in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = [(i, f) for q, i, f in rows if q == part]
            gone = []
            for k, c in enumerate(p):
                now = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                alone = sum(q == part and f == c for q, _, f in rows)
                out[part, "".join(p), k + 1] = [len(left), len(now), sum(c in f for _, f in gone), alone, sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                gone += now
                removed_by[c] += len(now)
        for p in permutations("ABCDE"):
            for k, c in enumerate(p):
                out[part, "".join(p), k + 1].append(removed_by[c])
    return out


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


LABELS = [(i, int(i % 3 == 0), i % 2, "x") for i in range(0, 212)] + [(3, None, None, "x"), (None, 1, 1, "x"), (4, 1, 1, "x")]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, part string")


def awkward():
    long = " ".join(f"word{k}" for k in range(250))
    marked = [(300, long, "en", "s"), (301, long + " $", "en", "s"), (302, long.upper(), None, "s"), (303, long, "", "s"), (304, "a " * 400, "de", "s"), (300, long, "de", "s"), (None, long, "fr", "s"), (299, None, "en", "s")]
    return corpus() + marked


def test_every_order_equals_a_run_of_it(spark, labels):
    rows = awkward()
    got = result(interactions.audit(frame(spark, rows).repartition(3), labels))
    want = brute(rows, {i for i, q, _, _ in LABELS if q == 1 and i is not None}, {i for i, _, t, _ in LABELS if t == 1 and i is not None})
    assert got == want and len(got) == 600 * len({p for p, *_ in fails(rows)})


def test_copies_of_one_text(spark, labels):
    rows = [(i, "the same text | of all", "en", "s") for i in range(400)]
    got = result(interactions.audit(frame(spark, rows).repartition(7), labels))
    assert got["en", "EABCD", 1][:2] == [1, 399]
    assert got == brute(rows, {i for i, q, _, _ in LABELS if q == 1 and i is not None}, {i for i, _, t, _ in LABELS if t == 1 and i is not None})


def test_no_rows_and_no_labels(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    assert interactions.audit(none, labels).count() == 0
    got = result(interactions.audit(frame(spark, [(1, "x", None, None)]), labels.where("false")))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("n", [1, 3, 4])
def test_survivors_of_every_subset(spark, n):
    masks = [m for m in range(2**n) for _ in range(m + 1)]
    rows = spark.createDataFrame([("p", m, 1, m % 2) for m in masks], "part string, mask int, good long, toxic long")
    got = interactions.survivors(interactions.counts(rows, n), n).first()
    assert got["n"] == [sum(not m & s for m in masks) for s in range(2**n)]
    assert got["toxic"] == [sum(m % 2 for m in masks if not m & s) for s in range(2**n)]
