"""The classifiers' scores, in loops over single numbers, and what they catch on held-out documents."""

import math
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import langid, quality, toxicity


def tables(spark, folder):
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def small(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    return docs, labels, texts


def test_context_vectors_are_counts(spark, small, monkeypatch):
    docs, _, texts = small
    some = docs.where("doc_id < 60 OR text IS NULL")
    want = np.zeros((quality.BUCKETS, quality.DIMS), dtype=np.int64)
    places = quality.index_vectors()
    for d, t in texts.items():
        if d < 60 or t is None:
            ids = [quality.bucket(w) % quality.BUCKETS for w in quality.TOKEN.findall((t or "").encode())]
            for i, a in enumerate(ids):
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(ids):
                        for k, sign in enumerate((1, -1, 1, -1)):
                            want[a, places[ids[j], k]] += sign
    assert (quality.context_vectors(some) == want).all()
    monkeypatch.setattr(quality, "TREE", 2)  # more levels of the tree
    assert (quality.context_vectors(some.repartition(9)) == want).all()


def test_quality_scores(spark, small):
    docs, labels, texts = small
    model = quality.fit(docs, labels)
    net = model.network
    got = {r.doc_id: r.score for r in quality.report(docs, model).collect()}
    for d in sorted(texts)[:40]:
        found = quality.TOKEN.findall((texts[d] or "").encode())
        x = [0.0] * (2 * quality.DIMS + 1)
        seen, last = set(), None
        for w in found:
            b = quality.bucket(w)
            capital, own = b >= quality.BUCKETS, b % quality.BUCKETS
            for row in [own] + [0] * capital + [1] * (own == last) + [2] * (own in seen):
                for k in range(2 * quality.DIMS):
                    x[k] += float(model.vectors[row, k])
            seen.add(own)
            last = own
        x = [v / max(len(found), 1) for v in x]
        x[-1] = math.log1p(len(found))
        z = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale)]
        hidden = [math.tanh(sum(a * b for a, b in zip(z, col)) + o) for col, o in zip(net.w[0].T, net.w[1])]
        logit = sum(h * w for h, w in zip(hidden, net.w[2])) + float(net.w[3][0])
        assert got[d] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)), abs=1e-4)


def test_toxicity_scores(spark, small):
    docs, labels, texts = small
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.report(docs, model).collect()}
    xs, ps = (v.tolist() for v in model.steps)
    for d in sorted(texts)[:60]:
        x = model.lexicon.features((texts[d] or "").encode()).tolist()
        margin = model.trees.base
        for feature, cut, leaf in model.trees.trees:
            node = 0
            for level in range(model.trees.depth):
                k = 2**level - 1 + node
                node = 2 * node + (bisect_left(model.trees.cuts[feature[k]].tolist(), x[feature[k]]) > cut[k])
            margin += leaf[node]
        at = bisect_left(xs, margin)
        if at == 0 or at == len(xs):
            want = ps[0] if at == 0 else ps[-1]
        else:
            share = (margin - xs[at - 1]) / (xs[at] - xs[at - 1]) if xs[at] > xs[at - 1] else 1.0
            want = ps[at - 1] + share * (ps[at] - ps[at - 1])
        # at equal x, either step's probability
        assert got[d] == pytest.approx(want, abs=1e-9) or min(abs(margin - v) for v in xs) < 1e-12


def test_languages(spark, small):
    docs, _, texts = small
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.report(docs, model).collect()}
    for d in sorted(texts)[:40]:
        t = texts[d]
        if not t or not langid.LETTER.search(t):
            assert got[d] == "und"
            continue
        raw = b" " + b" ".join(bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in t.lower().encode()).split()) + b" "
        counts = [0] * langid.SIZE
        for size in (1, 2, 3):
            for i in range(len(raw) - size + 1):
                code = int.from_bytes(raw[i : i + size], "big")
                counts[(code + (size << 24)) % (1 << 32) * 2654435761 % (1 << 32) >> 21] += 1
        norm = math.sqrt(sum(counts))
        z = [math.sqrt(c) / norm for c in counts] + [1.0]
        dot = lambda w: sum(a * float(b) for a, b in zip(z, w))
        family = max(range(len(model.families)), key=lambda f: dot(model.family[f]))
        members = model.families[family]
        votes, sums = {m: 0 for m in members}, {m: 0.0 for m in members}
        for (a, b), w in zip(model.pairs, model.pair):
            if a in votes:
                v = dot(w)
                votes[a if v > 0 else b] += 1
                sums[a] += v
                sums[b] -= v
        assert got[d] == model.names[max(members, key=lambda m: (votes[m], sums[m]))]


def test_what_is_caught(spark):
    """Shares of held-out documents of either label that are judged right, not only of all of them."""
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    for out, column, low in (
        (quality.report(docs, quality.fit(docs, labels)), "quality", (0.97, 0.97)),
        (toxicity.report(docs, toxicity.fit(docs, labels)), "toxic", (0.98, 0.9)),
    ):
        held = out.where("held_out").join(labels.select("doc_id", F.col(column).alias("truth")), "doc_id").where("truth IS NOT NULL").collect()
        for truth in (0, 1):
            own = [r.predicted == truth for r in held if r.truth == truth]
            share = sum(own) / len(own)
            print(column, truth, len(own), share)
            assert share >= low[truth], (column, truth, share, len(own))
