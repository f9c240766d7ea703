"""The pipeline's rows against its five stages done plainly, one document after another."""

import re

import pyarrow.parquet as pq
import xxhash

import corpus_pipeline
from palisade.llm import quality
from palisade.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def sketch(text):
    """Three fingerprints by plain numbers: bits set in over half of the mixed hashes of different two-word shingles."""
    w, out = text.lower().split(), []
    hashes = {xxhash.xxh64_intdigest(b" ".join(w[i : i + 2]), 42) for i in range(max(1, len(w) - 1))} if w else set()
    for k in range(3):
        mixed = []
        for h in hashes:
            x = (h + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            mixed.append(x ^ x >> 31)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def near(rows):
    fp = {d: sketch((t or "").encode()) for d, t in rows.items()}
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any((x ^ y).bit_count() <= 5 for x, y in zip(fp[a], fp[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    # what fingerprints propose is verified by five-word shingles, against the documents that stay
    kept = {}
    for d in ids:
        w = (rows[d] or "").encode().lower().split()
        own = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        others = kept.setdefault(find(d), {})
        if not any(5 * len(own & x) >= 4 * len(own | x) for x in others.values()):
            others[d] = own
    return {d: rows[d] for held in kept.values() for d in held}


def cut(rows, length=100):
    first, out = {}, {}
    raw = {d: (t or "").encode() for d, t in sorted(rows.items())}
    for d, t in raw.items():
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], (d, i))
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] != (d, i):
                gone[i : i + length] = b"\1" * length
        out[d] = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore") if rows[d] is not None else None
    return out


def clean(rows, items):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = set()
    for w in map(words, items):
        grams |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in rows.items():
        w = words(t)
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[d] = t
    return out


def test_pipeline_is_its_stages_done_plainly(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    t = pq.read_table(f"{SF}/documents.parquet")
    rows = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    sizes = [len(rows)]
    rows = {d: x for d, x in rows.items() if model.score([(x or "").encode()])[0] >= 0.3}
    sizes.append(len(rows))
    rows = near(rows)
    sizes.append(len(rows))
    rows = clean(cut(rows), pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist())
    sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0  # every decision takes effect
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {d: library.encode(x or "", add_special_tokens=False).ids for d, x in rows.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) for r in got)
