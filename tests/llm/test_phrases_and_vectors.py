"""Collocations, hard negatives and near-duplicate vectors against brute force, and their defined results for odd rows."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cipherlake.llm import collocations, negatives, vector_dups


def phrases(rows, least, first, inside=80, longest=4):
    """The contract of the operator, word by word."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = {}
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= inside * a for b in longer):
                continue
            cuts = [(2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -score)
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Red", "ÉTÉ", "x", "ß", "日本", "a-b", "long\xa0word", "it's", "3"] + [f"w{i}" for i in range(12)]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for k in range(n):
        line = rng.choices(words, weights, k=rng.randrange(0, 40))
        if k % 3 == 0:
            line += ["new", "york", "city", "hall"] if k % 4 else ["new", "york"]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "!?", "\x0b", " ", " ", " "]) for w in line)
        out.append((rng.choice(["en", "en", "de", None, ""]), text))
    return out


def phrase_frame(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "k", 2, 3) for lang, t in rows], "lang string, text string, n long, key string, id long, rank int")


def found_phrases(df):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("least,first", [(3, 2000), (8, 5)])
def test_collocations(spark, least, first):
    rows = [*texts(1, 250), (None, None), ("en", ""), ("en", " \t\n.. "), ("fr", "one"), ("en", "tie tie tie tie tie tie tie tie tie tie")]
    rows += [rows[0]] * 3
    got = found_phrases(collocations.collocations(phrase_frame(spark, rows), least, first))
    assert got == phrases(rows, least, first) and len(got) > 10


def test_collocations_of_a_long_text_and_of_nothing(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee."], k=200_000))
    rows = [("en", long), ("en", "aa bb cc")]
    got = found_phrases(collocations.collocations(phrase_frame(spark, rows)))
    assert got == phrases(rows, 30, 2000)
    df = collocations.collocations(phrase_frame(spark, rows).limit(0))
    assert df.count() == 0 and df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_look_up_by_joins_beyond_the_bound(spark, monkeypatch):
    rows = texts(2, 200)
    monkeypatch.setattr(collocations, "KNOWN", 3)
    assert found_phrases(collocations.collocations(phrase_frame(spark, rows), 3, 2000)) == phrases(rows, 3, 2000)


def test_tiles_count_what_stands_in_them(monkeypatch):
    """Dense and sparse tiles, over several buffers, give each pair's number in the part that its hash tells."""
    monkeypatch.setattr(collocations, "FULL", 200)
    rng = np.random.default_rng(5)
    tiles, want, got, sparse = collocations.Tiles(7), Counter(), Counter(), 0
    for spread in (300, 3_000, 1_000_000, 3_000):
        pairs = (rng.zipf(1.3, 4000) % spread).astype(np.int64) << 32 | (rng.zipf(1.3, 4000) % spread)
        pairs[0] = np.array([(2**32 - 2) << 32 | 5], np.uint64).view(np.int64)[0]
        want.update(pairs.tolist())
        for batch in tiles.add(pairs):
            sparse += batch.num_rows
            for part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(keys, np.int64)
                assert (collocations.mix(keys.view(np.uint64)) % np.uint64(7) == part).all()
                got.update(dict(zip(keys.tolist(), np.frombuffer(n, np.int64).tolist(), strict=True)))
    assert 0 < len(tiles.dense) <= collocations.DENSE and sparse
    for batch in tiles.rest():
        for keys, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got.update(dict(zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(n, np.int64).tolist(), strict=True)))
    assert got == want


def test_counting_of_pairs_is_bounded_in_memory():
    """A task that counts eight million pairs holds its dense tiles and one buffer's arrays."""
    stages = []
    frame = SimpleNamespace(mapInArrow=lambda f, _: stages.append(f) or frame, repartitionById=lambda *_: frame)
    collocations.counted_pairs(frame, 1, 7)
    ids = (np.random.default_rng(3).zipf(1.3, 1 << 19) % 60_000).astype(np.uint32)
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])
    tracemalloc.start()
    try:
        n = sum(int(np.frombuffer(c, np.int64).sum()) for out in stages[0](iter([batch] * 16)) for c in out.column(2).to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 16 * (len(ids) - 1)
    assert peak < 260 << 20


def test_counting_of_words_is_bounded_in_memory(spark):
    """A task that counts the words of slices of four megabytes holds few arrays of their size."""
    stages, asked = [], []
    frame = SimpleNamespace(mapInArrow=lambda f, _: stages.append(f) or frame, groupBy=lambda *_: frame, agg=lambda *_: frame, sparkSession=SimpleNamespace(conf=SimpleNamespace(set=lambda k, v: asked.append((k, v)))))
    collocations.counted_words(frame, 0)
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in (rng.zipf(1.3, 1 << 12) % 6_000).tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 1024), pa.array([text[:4000]] * 1024)], ["lang", "text"])
    want = 3 * 1024 * len(text[:4000].split())
    tracemalloc.start()
    try:
        n = sum(sum(out.column(3).to_pylist()) for out in stages[0](iter([batch] * 3)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == want
    assert peak < 160 << 20
    # Whole documents come in small batches, since Spark holds a batch outside of its heap.
    assert asked and all(int(v) <= 1024 for k, v in asked if k == "spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_are_exact_beyond_64_bits(spark):
    """Counts near 2**62, whose products by two millions pass 64 bits, and ties after flooring."""
    big = 2**62 - 57
    rows = [([big + 5, big + 3, big], [big + 9, big + 1, big]), ([10, 10, 9], [10, 10, 9]), ([7, 3], [9, 3])]
    got = spark.createDataFrame(rows, "pre array<long>, suf array<long>").select(F.expr(collocations.CUT).alias("c")).select("c.*").collect()
    for (pre, suf), r in zip(rows, got, strict=True):
        size = len(pre)
        cuts = [(2000000 * pre[-1] // (pre[k - 1] + suf[size - k - 1]), k, pre[k - 1], suf[size - k - 1]) for k in range(1, size)]
        assert tuple(r) == min(cuts)


def test_word_hashes_change_with_the_seed():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["One two. one", "one"])], ["lang", "text"])
    first, second = (collocations.words_of(batch, seed)[-1] for seed in (0, 1))
    assert first[0] == first[2] != first[3] and second[0] == second[2] and not set(first) & set(second)


VECTORS = "vec_id long, embedding array<double>, label int"


def negatives_by_hand(rows, positives=5, count=5, share=80, every=100):
    known = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2], r[1])):
        if all(x is not None and np.isfinite(x) for x in v):
            known.setdefault(i, (label, [int(np.floor(256 * x)) for x in v]))
    width = max((len(v) for _, v in known.values()), default=0)
    vectors = {i: np.array(v + [0] * (width - len(v)), np.int64) for i, (_, v) in known.items()}
    out = {}
    for q in known:
        if q % every:
            continue
        scored = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)
        for s, p in [x for x in scored if known[x[1]][0] == known[q][0]][:positives]:
            fits = [(n, i) for n, i in scored if known[i][0] != known[q][0] and share * -s <= 100 * -n <= 100 * -s][:count]
            out |= {(q, p, k + 1): (i, -s, -n) for k, (n, i) in enumerate(fits)}
    return out


def found_negatives(df):
    return {(r["anchor_id"], r["positive_id"], r["rank"]): (r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()}


@pytest.mark.parametrize("blocks", [False, True])
def test_hard_negatives(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
        monkeypatch.setattr(negatives, "VECTOR_BLOCK", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 0.3, (4, 20))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.2, 20)).tolist(), int(rng.integers(4))) for i in range(700)]
    nan, inf = float("nan"), float("inf")
    odd = [(800, None, 1), (900, [None] * 20, 1), (1000, [nan] * 20, 1), (1100, [inf] * 20, 1), (None, [0.1] * 20, 1), (1200, [0.5, 0.2], 2), (1300, [], 2), (1400, rows[3][1], None), (1401, rows[3][1], 1), (1402, rows[3][1], 2), rows[5], (7, rows[9][1], 3), (1500, rows[100][1], 9)]
    df = spark.createDataFrame([*rows, *odd], VECTORS).withColumns({"score": F.lit("x"), "rank": F.lit(1), "slot": F.lit(2), "x": F.lit(3)})
    vectors = negatives.labelled_vectors(df, F.col("label"))
    got = found_negatives(negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0")))
    want = negatives_by_hand([*rows, *odd])
    assert got == want and len(want) > 100
    assert negatives.hard_negatives(vectors.limit(0), vectors.limit(0)).count() == 0


def test_summaries_bound_the_scores():
    rng = np.random.default_rng(2)
    a, b = np.floor(rng.normal(3, 50, (40, 21))), np.floor(rng.normal(-2, 80, (60, 21)))
    exact, last = a @ b.T, np.inf
    for low, high in negatives.bounds(negatives.Summaries(a), negatives.Summaries(b)):
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < last
        last = (high - low).mean()


def links_by_hand(rows, threshold=0.95):
    known = {}
    for i, v in rows:
        known.setdefault(i, None)
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            known[i] = min(known[i], v) if known[i] is not None else v
    width = max((len(v) for v in known.values() if v), default=1)
    usable = [i for i, v in known.items() if i is not None and v and any(v)]
    x = np.array([known[i] + [0.0] * (width - len(known[i])) for i in usable])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    links, to = dict(zip(usable, near.sum(axis=1).tolist(), strict=True)), {i: i for i in known}
    changed = True
    while changed:
        changed = False
        for a, row in enumerate(near):
            least = min([to[usable[a]], *(to[usable[b]] for b in np.flatnonzero(row))])
            if least < to[usable[a]]:
                to[usable[a]], changed = least, True
    return {i: (links.get(i, 0), to[i], i is None or to[i] == i) for i in known}


def found_links(df):
    rows = df.collect()
    assert len({r["vec_id"] for r in rows}) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}


def groups_of_vectors(seed, width=24):
    """Strangers, a large and a middle group about a centre, pairs, a chain of steps, and copies."""
    rng = np.random.default_rng(seed)
    out = list(rng.normal(0, 1, (400, width)))
    for many, noise in ((260, 0.02), (90, 0.045), (70, 0.06)):
        centre = rng.normal(0, 1, width)
        centre /= np.linalg.norm(centre)
        out += [s * (centre + rng.normal(0, noise, width)) for s in rng.uniform(0.1, 9, many)]
    for k in range(60):
        out.append(out[k] + rng.normal(0, 0.2 + 0.002 * k, width))
    a, b = np.linalg.qr(rng.normal(0, 1, (width, 2)))[0].T
    out += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.3)]
    out += [out[500]] * 50 + [out[3]] * 2
    order = rng.permutation(len(out))
    return [(int(i), out[k].tolist()) for i, k in enumerate(order)]


@pytest.mark.parametrize("part", [4096, 40])
def test_linked_vectors(spark, monkeypatch, part):
    """Also with buckets that are dealt to cells."""
    monkeypatch.setattr(vector_dups, "PART", part)
    rows = groups_of_vectors(1)
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [nan] * 24), (2004, [inf] * 24), (2005, [0.0] * 24), (None, rows[0][1]), (None, None), (2006, rows[7][1][:12]), (2007, rows[7][1][:12]), rows[4], (5, rows[6][1]), (-3, rows[8][1]), (2008, [1e300 * x for x in rows[9][1]]), (2009, [1e-300 * x for x in rows[9][1]])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("node", "key", "u", "core", "n", "x")})
    want = links_by_hand([*rows, *odd])
    got = found_links(vector_dups.linked(df))
    assert got == want
    assert max(n for n, _, _ in want.values()) >= 259
    empty = vector_dups.linked(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_cores_are_found_and_their_members_linked(spark):
    rows = groups_of_vectors(6)
    vectors = vector_dups.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    bits, tables = vector_dups.shape(len(rows), 0.95)
    signed = vector_dups.signed(vectors, 24, bits, tables, bits + 9).persist()
    cores = vector_dups.cores(signed, 24, bits, tables, bits + 9, 0.95).collect()
    members = defaultdict(list)
    for r in cores:
        members[r["core"]].append(r["node"])
        assert r["size"] >= len(members[r["core"]])
    assert max(map(len, members.values())) > 200
    x = dict(rows)
    for own in members.values():
        u = np.array([x[i] for i in own])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        assert (u @ u.T).min() >= 0.95


def test_tables_follow_from_the_number_of_vectors():
    """The chance to miss a pair of the least similarity stays under its bound, whatever the number."""
    for n in (0, 1, 500, 51_282, 10**9):
        bits, tables = vector_dups.shape(n, 0.95)
        share = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - share) ** tables <= vector_dups.MISS * 1.0001 and tables < 150
