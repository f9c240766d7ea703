"""The pipeline's near copies: how many planted ones go, that others stay, and the groups against all pairs."""

import random

import pytest

from palisade.llm import simhash
from tests.llm.test_pipeline_brute import near


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def planted(seed=4):
    """Texts that share a vocabulary, and copies of some with a similarity of 0.8 or more, near that bound."""
    rng = random.Random(seed)
    # as frequent as words of a language: by the inverse of their rank
    words = rng.choices([f"w{k}" for k in range(20_000)], [1 / (k + 2.7) for k in range(20_000)], k=60_000)
    line = " ".join(rng.choice(words) for _ in range(25))
    rows, copies = {}, {}
    for k in range(150):
        n = rng.choice((90, 130, 250, 600))
        # a line that many share
        rows[10 * k] = (line + " " if k % 3 == 0 else "") + " ".join(rng.choice(words) for _ in range(n))
        text = rows[10 * k].split()
        for j in range(1, 4):
            while True:
                edited = list(text)
                for _ in range(max(1, round(len(text) * rng.choice((0.012, 0.017, 0.02))))):
                    edited[rng.randrange(len(text))] = rng.choice(words)
                if jaccard(" ".join(edited), rows[10 * k]) >= 0.8:
                    break
            copies[10 * k + j] = " ".join(edited)
    return rows, copies


@pytest.fixture(scope="module")
def texts():
    return planted()


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)


def test_recall_of_planted_copies_and_clean_documents(spark, texts):
    rows, copies = texts
    kept = {r.doc_id for r in simhash.representatives(frame(spark, rows | copies)).collect()}
    assert kept >= rows.keys()
    recall = 1 - len(kept & copies.keys()) / len(copies)
    assert recall >= 0.9, recall


@pytest.mark.parametrize("most, heads, salted", [(4096, 64, 2000), (6, 2, 3)])
def test_same_as_all_pairs(spark, monkeypatch, texts, most, heads, salted):
    rows = {d: t for d, t in (texts[0] | texts[1]).items() if d < 500} | {5001: None, 5002: "", 5003: " \n", 5004: "one", 5005: "One"}
    rows |= {6000 + k: texts[0][0].replace(" ", f" x{k} ", 1) for k in range(60)}
    # near each other by fingerprints, not by shingles: they stay, as leaders of a group that takes several rounds
    words = texts[0][10].split()
    for k in range(12):
        rows[7000 + k] = " ".join(f"z{k}" if i % 9 == 4 else w for i, w in enumerate(words))
        rows[7100 + k] = rows[7000 + k].upper().replace(" ", "  ")
    monkeypatch.setattr(simhash, "FEW_LINKS", 0 if most == 6 else 10**6)
    gone = simhash.near_copies(frame(spark, rows), most=most, heads=heads, salted=salted).collect()
    assert {r.doc_id for r in gone} == rows.keys() - near(rows).keys()
    assert all(r.root < r.doc_id for r in gone)
    full = lambda t: " ".join((t or "").lower().split())
    assert all(jaccard(full(rows[r.doc_id]), full(rows[r.root])) >= 0.8 for r in gone)
    assert {r.doc_id for r in gone} >= set(range(7100, 7112))


def test_a_group_of_unlike_texts_is_over_in_few_rounds(spark, monkeypatch):
    """Each round moves and writes all that is left of a group, so a number of rounds that grows with it filled the disk."""
    from pyspark.sql.classic.dataframe import DataFrame

    simhash.prepare(spark)
    rng = random.Random(2)
    rows = []
    for k in range(300):
        # every seventh is like the one seven before but for one of forty
        own = [rng.getrandbits(60), *rows[k - 7][2][1:]] if k % 7 == 6 and k > 6 else [rng.getrandbits(60) for _ in range(40)]
        rows.append((1, k, sorted(own)))
    made, real = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: made.append(1) or real(self, *a, **k))
    members = spark.createDataFrame(rows, "root long, node long, shingles array<long>")
    got = {r.node: r.leader for r in simhash.verified(members, 4, heads=4).collect()}
    leaders, want = [], {}
    for _, node, own in rows:
        like = next((n for n, s in leaders if len(s & set(own)) * 5 >= 4 * len(s | set(own))), None)
        if like is None:
            leaders.append((node, set(own)))
        else:
            want[node] = like
    assert got == want and len(want) > 10
    assert len(made) <= 12
