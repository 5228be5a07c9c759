"""Each operator against brute force, and its defined results for odd rows."""

import ipaddress
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from cipherlake.llm import chat, decontaminate, language, line_dedup, near_dup, packing, pii, prefixes, quality, substring_dedup, topk

SCHEMA = "doc_id long, text string, lang string, source string, kept string, score string, key string, node string, removed string, component_id string, gone_id string"
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(text, k, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = f"x{seed}{i}"
    return " ".join(words)


def corpus():
    base = [prose(60 + i * 37 % 100, i) for i in range(30)]
    texts = [*base, base[0], base[0], base[1].upper(), changed(base[2], 2, 1), changed(base[2], 3, 2), changed(base[3], 1, 3), None, "", "  \n\t ", "one two", "One  two", "a b c d", prose(30_000, 99), "ünï cödé " + base[5], base[6] + "\n" + base[7][:40]]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", "k", "c", "y", "n", "r", "i", "g") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    # One row twice, and one without id.
    rows = corpus()
    return frame(spark, [*rows, rows[4], (None, rows[0][1])])


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def groups(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def line_similarity(a, b):
    s, t = ({x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in (a, b))
    return len(s & t) / len(s | t)


def test_near_duplicates(spark, docs):
    sets = {i: shingle_set(t) for i, t in corpus()}
    want = groups(list(sets), lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and bool(sets[i]))
    got = near_dup.components(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {None, *want.values()}
    assert near_dup.components(docs.limit(0)).count() == 0


def test_near_duplicate_fringe_of_a_large_group(spark):
    """A text that is close to the centre of a large group only is still linked."""
    base = prose(120, 5)
    texts = [base, *(changed(base, 2, s) for s in range(100, 250)), changed(base, 4, 999)]
    sets = [shingle_set(t) for t in texts]
    want = groups(range(len(texts)), lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    got = near_dup.components(frame(spark, enumerate(texts))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("family", ["template", "copies"])
def test_near_duplicates_that_no_hub_confirms(spark, family):
    """A family alike through a template, and edited copies without their original, against brute force."""
    template, rng = prose(120, 31), random.Random(8)
    if family == "template":
        texts = []
        for s in range(150):
            own = [f"o{s}x{k}" for k in range(22)]
            texts += [f"{template} {' '.join(own)}", f"{template} {' '.join(own[:8])} " + " ".join(f"q{s}x{k}" for k in range(14))]
    else:
        texts = [changed(template, rng.randrange(2, 5), s) for s in range(100, 260)]
    sets = [shingle_set(t) for t in texts]
    want = groups(range(len(texts)), lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    assert len(set(want.values())) > 1
    got = near_dup.components(frame(spark, enumerate(texts))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_fuzzy_lines(spark, docs, monkeypatch):
    long = "a quick brown fox jumps over the lazy dog and then runs away from the angry bear"
    rows = [(5, f"{long}\nunique line of five"), (2, f"{long.upper()}   \n\nother"), (9, long.replace("lazy", "lamy")), (7, None), (8, ""), (6, "\n\n"), (4, "tiny\ntiny\nTiny"), (None, long)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, [*rows, rows[0]])).collect()}
    assert 9 not in got and got[2]["text"].startswith("A QUICK") and got[5]["text"] == "unique line of five"
    assert got[4]["text"] == "tiny" and got[4]["lines_removed"] == 2
    assert got[7]["text"] is None and got[8]["text"] == "" and got[6]["text"] == "\n\n" and got[None]["text"] == long
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    # Links among many lines against brute force.
    lines = [prose(12, s) for s in range(60)]
    lines += [changed(x, 1, s) for s, x in enumerate(lines[:30])] + [x + " end" for x in lines[10:40]]
    text = line_dedup.documents_of(frame(spark, [(i, x) for i, x in enumerate(lines)]))
    signed = line_dedup.line_signatures(text).persist()
    node = {r["doc_id"]: r["node"] for r in signed.collect()}
    links = {frozenset((r["src"], r["dst"])) for r in line_dedup.similar_lines(text, signed).collect()}
    want = {frozenset((node[i], node[j])) for i in range(len(lines)) for j in range(i) if node[i] != node[j] and line_similarity(lines[i], lines[j]) >= 0.8}
    assert links <= want
    linked = lambda pairs: groups(sorted(set(node.values())), lambda a, b: frozenset((a, b)) in pairs)
    assert linked(links) == linked(want)
    # Buckets count as crowded from one node on.
    monkeypatch.setattr(line_dedup, "HOT", 1)
    monkeypatch.setattr(line_dedup, "RATE", 1)
    split = {frozenset((r["src"], r["dst"])) for r in line_dedup.similar_lines(text, signed).collect()}
    assert line_dedup.crowded(signed).count() > 0 and linked(split) == linked(want)


def test_copies_of_a_line_are_dealt_once(spark, monkeypatch):
    """Copies are told in the task that reads them, and those that it forgets change no link; bucket rows bring one value of parities."""
    lines = [prose(12, s) for s in range(20)]
    lines += [*lines, *(f"{x} end" for x in lines[:10])]
    text = line_dedup.documents_of(frame(spark, enumerate(lines))).coalesce(1)
    linked = lambda signed: {frozenset((r["src"], r["dst"])) for r in line_dedup.similar_lines(text, signed).collect()}
    signed = line_dedup.line_signatures(text).persist()
    assert signed.count() == 50 and signed.where("not again").count() == len(set(lines)) == 30
    monkeypatch.setattr(line_dedup, "SEEN", -1)
    every = line_dedup.line_signatures(text.repartition(7)).persist()
    assert every.where("not again").count() > 30 and linked(every) == linked(signed) and len(linked(signed)) > 5
    sets = spark.createDataFrame([(1, 1, 0, [1, 2, 3]), (2, 2, 0, [1, 2, 3, 4])], "node long, component long, sketch long, shingles array<long>")
    assert dict(prefixes.heads(sets, 50).dtypes)["parity"] == "binary" and len(prefixes.heads(sets, 50).columns) == 8
    assert {(r["src"], r["dst"]) for r in prefixes.pairs(prefixes.heads(sets, 50), 50, 64, False).collect()} == {(1, 2)}


def test_fuzzy_lines_of_a_templated_family(spark):
    """Lines 0.7 alike through one template: all components that brute force finds, though the hubs fail."""
    rng = random.Random(4)
    fill = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = prose(24, 77)[:108]
    lines = []
    for _ in range(500):
        own = fill(16)
        lines += [f"{head}{own}", f"{head}{own[:9]}{fill(7)}"]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert 0.65 < len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8 and alike(0, 1)
    text = line_dedup.documents_of(frame(spark, enumerate(lines)))
    signed = line_dedup.line_signatures(text).persist()
    node = {r["doc_id"]: r["node"] for r in signed.collect()}
    links = {frozenset((r["src"], r["dst"])) for r in line_dedup.similar_lines(text, signed).collect()}
    got = groups(range(len(lines)), lambda i, j: frozenset((node[i], node[j])) in links)
    assert got == groups(range(len(lines)), alike) and len(set(got.values())) > 400


def test_repeated_passages(spark, docs):
    passage = prose(60, 77)
    rows = [(1, f"{prose(40, 1)} {passage} {prose(30, 2)}"), (2, f"{passage}\n{prose(90, 3)}"), (3, prose(300, 4)), (4, f"{prose(70, 6)} {changed(passage, 1, 8)}"), (5, None), (6, ""), (7, prose(20, 9)), (8, f"{prose(20, 9)}")]
    df = frame(spark, [*rows, rows[0]])
    got = substring_dedup.repeated_passages(df).collect()
    assert {r["doc_id"] for r in got if not r["removed"]} == {1} and {2} <= {r["doc_id"] for r in got if r["removed"]} <= {2, 4}
    second = next(r for r in got if r["doc_id"] == 2)
    assert (second["start_word"], second["end_word"], second["component_id"]) == (0, 60, 1)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_passages(df).collect()}
    assert cut[2] == prose(90, 3) and cut[1] == rows[0][1] and cut[3] == rows[2][1] and cut[5] is None
    assert substring_dedup.drop_repeated_passages(df).columns == df.columns
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size,edits", [(50, 0), (50, 1), (60, 2), (80, 2)])
def test_edited_passages_are_found(spark, size, edits):
    """Of planted pairs that have a paragraph of the least similarity, by brute force over aligned paragraphs, nearly all; no others."""
    rng = random.Random(size + edits)
    words = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randrange(8)}" for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near = [], set()
    for n in range(120):
        passage, x, y = words(size), words(rng.randrange(30, 120)), words(rng.randrange(30, 120))
        copy = changed(" ".join(passage), edits, n).split()
        one, two = x + passage + words(60), y + copy + words(60)
        rows += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(two))]
        windows = [(sets(one[len(x) + i :][:50]), sets(two[len(y) + i :][:50])) for i in range(-10, size - 40)]
        if any(len(a & b) >= 0.75 * len(a | b) for a, b in windows):
            near.add(2 * n)
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(frame(spark, rows)).where("not removed").collect()}
    assert got <= near and len(near) > 40 and len(got) >= 0.95 * len(near)


def test_passages_that_stars_leave_apart_are_found(spark):
    """Copies whose bucket's first run, and the one before, hold only a part of the passage that is too short."""
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randrange(8)}" for _ in range(n)]
    rows, copies = [], set()
    for n in range(0, 1600, 40):
        passage = words(50)
        part = lambda k, passage=passage: words(60) + passage[k : k + 42] + words(60)
        texts = [part(k) for k in (0, 4, 8)] + [words(20) + passage + words(60)] + [part(k) for k in (0, 4, 8)] + [words(70) + passage + words(30)]
        rows += [(n + i, " ".join(x)) for i, x in enumerate(texts)]
        copies |= {(n + 3, n + 3, False), (n + 7, n + 3, True)}
    got = {(r["doc_id"], r["component_id"], r["removed"]) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == copies


def test_passages_of_few_words_over_and_over_make_no_pair_for_each(spark, monkeypatch):
    """Documents of repeated words all share buckets; their pairs follow their number, not its square."""
    made = []
    keep = substring_dedup.left_apart
    monkeypatch.setattr(substring_dedup, "left_apart", lambda *a: made.append(substring_dedup.materialize(keep(*a))) or made[-1])

    def junk(i):
        return " ".join(" ".join([w] * (30 + (7 * i + 11 * k) % 40)) for k, w in enumerate(random.Random(i).sample(["a", "the", "in", "of", "hash"], 4)))

    pairs, listed = [], []
    for n in (40, 120):
        rows = [(i, junk(i)) for i in range(n)]
        listed.append({r["doc_id"] for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()})
        pairs.append(made[-1].select("doc_id", "kept_doc_id").distinct().count())
    assert pairs[0] and pairs[1] < 6 * pairs[0]
    assert listed[0] <= listed[1] and len(listed[1]) > 100


def test_short_common_phrases_are_looked_up_by_none():
    """What a cell has in common by fewer shingles than a similar paragraph needs isn't compared; a common passage is."""
    rng = np.random.default_rng(5)
    phrase, passage = rng.integers(0, 2**31, 30), rng.integers(0, 2**31, 46)
    runs = [np.concatenate([rng.integers(0, 2**31, 20), phrase, rng.integers(0, 2**31, 20)]) for _ in range(50)]
    runs += [np.concatenate([rng.integers(0, 2**31, 12), passage, rng.integers(0, 2**31, 12)]) for _ in range(2)]
    size, flat = np.array([len(r) for r in runs]), np.concatenate(runs).astype(np.int32)
    ok = substring_dedup.able(np.zeros(52, np.int64), np.arange(52), np.full(52, 46), size, flat)
    assert not ok[: 50 * 70].any()
    # 40 of the 46 suffice, at either end.
    assert [np.flatnonzero(ok[a : a + 70]).tolist() for a in (3500, 3570)] == [list(range(6, 19))] * 2
    # One document alone doesn't share with itself.
    assert not substring_dedup.able(np.zeros(2, np.int64), np.zeros(2, np.int64), np.full(2, 46), size[50:], flat[3500:]).any()


def test_partners_of_runs_across_batches(spark):
    """First and former run of a bucket are the same however its rows are cut into batches."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(60) ** 2 // 60, rng.randrange(50), i) for i in range(300))
    want, by = [], {}
    for k, d, c in rows:
        by.setdefault(k, []).append((d, c))
    for k, members in by.items():
        want += [(k, *m, *members[0], *members[max(0, i - 1)], i == 0, i == 1) for i, m in enumerate(members) if len(members) > 1]
    df = spark.createDataFrame(rows, "key long, doc_id long, code long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert sorted(map(tuple, substring_dedup.partners(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_repeated_passage_of_one_long_run(spark):
    """A short period repeated over more than 65,535 windows goes as a whole."""
    text = " ".join([prose(10, 3)] * 7000)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_passages(frame(spark, [(1, text), (2, text)])).collect()}
    assert got == {1: text, 2: ""}


def test_leaks(spark, docs):
    items = [(1, prose(40, 501)), (2, prose(15, 502)), (3, "three little words"), (4, None), (5, ""), (6, prose(50, 503))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = [(10, f"{prose(100, 1)} {items[0][1].upper()}\n{prose(9, 2)}"), (11, items[1][1]), (12, "with three  little words inside"), (13, f"{prose(80, 3)} {changed(items[5][1], 1, 4)} {prose(5, 5)}"), (14, prose(500, 6)), (15, None), (16, "")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(frame(spark, rows), benchmark).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 3), (13, 6)}
    assert (got[10, 1]["start_word"], got[10, 1]["n_words"], got[10, 1]["similarity"]) == (100, 40, 1.0)
    left = decontaminate.decontaminate(frame(spark, rows), benchmark)
    assert {r["doc_id"] for r in left.collect()} == {14, 15, 16} and left.columns == docs.columns
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), benchmark).count() == 0


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    items = [(i, prose(20, 700 + i)) for i in range(10)]
    rows = [(i, f"{prose(30, i)} {t} {prose(3, i)}") for i, t in items]
    got = decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id int, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(10)}


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = random.Random(1)
    for _ in range(300):
        code = rng.getrandbits(64)
        other = code
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            other ^= 1 << bit
        both = decontaminate.blocks(np.array([code, other], np.uint64))
        assert (both[:, 0] == both[:, 1]).any()


def test_leaks_against_every_window(spark):
    """Each document with each item at each word position, on edited copies about the least similarity."""
    rng = random.Random(21)
    items = [(k, prose(rng.randrange(3, 40), 800 + k)) for k in range(14)] + [(20, " ".join([prose(3, 1)] * 6)), (20, prose(12, 5))]
    texts = []
    for k, (_, item) in enumerate(items * 6):
        words = item.split()
        edits = rng.randrange(0, 1 + len(words) // 6)
        inner = changed(item, edits, k) if k % 3 else " ".join(words[rng.randrange(2) : len(words) - rng.randrange(2)])
        texts.append(f"{prose(rng.randrange(0, 30), k)} {inner} {prose(rng.randrange(0, 30), 99 + k)}")
    texts += [items[3][1][: len(items[3][1]) * 9 // 10], " ".join(w for _, w in items), f"{prose(30_000, 7)} {items[5][1]} {prose(30_000, 8)} {items[5][1]}", None, "", "x"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, items[6][1])]
    bag = lambda words: Counter(tuple(words[i : i + min(5, len(words))]) for i in range(max(1, len(words) - 4)))
    want = Counter()
    for doc, text in rows:
        words = (text or "").lower().split()
        for item, its in items:
            its, best = its.lower().split(), None
            size, theirs = min(len(its), len(words)), bag(its)
            shared = {i for i in range(len(words)) if any(tuple(words[i : i + w]) in theirs for w in {min(5, len(its)), min(5, len(words))})} if words else set()
            for start in sorted({max(0, min(i - k, len(words) - size)) for i in shared for k in range(size + 1)}):
                own = bag(words[start : start + size])
                similarity = (own & theirs).total() / (own | theirs).total()
                best = max(best or (0, 0), (similarity, -start))
            if best and best[0] >= decontaminate.SIMILARITY:
                want[doc, item, -best[1], size, round(best[0], 9)] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(frame(spark, rows), benchmark).collect()
    assert Counter((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in got) == want
    assert len({k[:2] for k in want}) > 60 and any(k[4] < 0.85 for k in want)
    clean = Counter(r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), benchmark).collect())
    assert clean == Counter(d for d, _ in rows) - Counter({d: 2 if d == 0 else 1 for d in {k[0] for k in want}})


def test_packing(spark, docs):
    cut = packing.pack(docs, capacity=64).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        head = (len(ids) - 1) % 64 + 1
        edges = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in cut) == want
    bins = {}
    for r in cut:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r["length"] for r in cut) / 64 + 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_token_words_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    assert encoder.ids(["a <|endoftext|> b"]) == [np.array([64, 220, 50256, 275], "<u4").tobytes()]
    rng = random.Random(12)
    letters = [chr(c) for a, b in ((32, 127), (0xC0, 0x250)) for c in range(a, b)] + list("\t\n\r    '’") + list("Жα中ß½²①")
    drawn = ["".join(rng.choice(letters[: rng.choice((100, 480, len(letters)))]) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    assert encoder.ids(drawn) == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in drawn]
    texts = ["<|endoftext|> hi", "  a  b\n\n c ", "I'm he'll  don't ² ½ x y", "日本語 text ÷ × ñ\x85z", "0123 4a5b --- ...", "a\t\t b\r\n", "", "Über çà va ŐȀ", "!!?? %%", "x" * 3000]
    assert encoder.ids(texts) == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_minimum_bin_slack_fills_bins():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    plan = packing.minimum_bin_slack(counts, 64)
    used = Counter()
    for combination, times in plan:
        assert sum(length * n for length, n in combination.items()) <= 64
        for length, n in combination.items():
            used[length] += n * times
    assert used == counts
    assert sum(t for _, t in plan) <= sum(k * n for k, n in counts.items()) / 64 * 1.01
    assert packing.minimum_bin_slack({}, 64) == []


def test_top_k(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(0, 0.3, 16).tolist()) for i in range(400)]
    odd = [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (None, [0.1] * 16), (1005, [0.5]), (1006, []), (1007, data[3][1]), (3, data[3][1])]
    df = spark.createDataFrame([*data, *odd], "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1)})
    vectors = topk.integer_vectors(df)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).collect()
    known = {i: np.floor(64 * np.array([*v, *[0.0] * (16 - len(v))])).astype(np.int64) for i, v in [*data, odd[5], odd[6], odd[7]]}
    want = {}
    for q in known:
        if q % 20 == 0:
            order = sorted(((-int(known[q] @ v), i) for i, v in known.items() if i != q))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(order)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    two = vectors.where("vec_id in (0, 20)")
    assert topk.top_k(two, two).count() == 2


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e8])
def test_top_k_of_large_components(scale):
    """Beyond single precision the segments are still what finds the members."""
    rng = np.random.default_rng(9)
    vectors = np.floor(rng.normal(0, scale, (500, 16)) * np.exp(rng.normal(0, 1, (500, 1))))
    index = topk.ImpactIndex(np.arange(500), vectors)
    q, v, score = index.search(np.arange(0, 500, 50), vectors[::50], 6, np.full(10, -np.inf))
    assert len(q) < 0.5 * 10 * 500
    whole = vectors.astype(np.int64)
    for k in range(10):
        want = sorted(((-int(whole[50 * k] @ whole[i]), i) for i in range(500) if i != 50 * k))[:5]
        got = sorted((-int(s), int(i)) for a, i, s in zip(q, v, score, strict=True) if a == k)[:5]
        assert got == want


def test_top_k_passes_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(df)
    want = sorted(map(tuple, topk.top_k(vectors, vectors, 3).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 50)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 32)
    assert sorted(map(tuple, topk.top_k(vectors, vectors, 3).collect())) == want


def labelled(spark, n=240):
    good = [(i, prose(60, i), 1) for i in range(n)]
    bad = [(1000 + i, " ".join(f"{w}!!" for w in prose(40, i).upper().split()), 0) for i in range(n // 4)]
    rows = [*good, *bad]
    return frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int").withColumn("text", F.lit("z"))


def test_quality(spark, docs):
    table, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = quality.scores(table.union(docs), labels, held).collect()
    assert len(got) == table.count() + docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] >= 100]
    assert tested and np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    # Held-out labels change nothing.
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(repr, quality.scores(table, other, held).collect())) == sorted(map(repr, quality.scores(table, labels, held).collect()))
    assert {r["score"] for r in quality.scores(table, labels.limit(0), held).collect()} == {0.5}
    assert {r["score"] for r in quality.scores(table, labels.where("quality = 1"), held).collect()} == {1.0}
    assert quality.scores(table.limit(0), labels, held).count() == 0


def test_support_vectors_reach_the_optimum():
    """The dual's value meets the primal's."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    y = (np.array([(r < 20).mean() for r in rows]) + rng.normal(0, 0.15, 60) > 0.5).astype(int)
    ratios = rng.normal(0, 1, 40)
    w = quality.descend(rows, y, ratios)
    sign = np.where(y == 1, 1, -1)
    cost = np.where(y == 1, quality.COST * 60 / 2 / (y == 1).sum(), quality.COST * 60 / 2 / (y == 0).sum())

    def primal(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * np.array([quality.margin(r, ratios, w) for r in rows]))).sum()

    best = primal(w)
    for _ in range(200):
        assert primal(w + rng.normal(0, 0.05, 41)) > best - 0.05 * abs(best)


def test_language(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 120)
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "жшщыэ "}
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(alphabets[k]) for _ in range(rng.randrange(20, 400))), k) for i, k in enumerate(rng.choice(list(alphabets)) for _ in range(200))]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 ... ½ ² ① Ⅷ", "bb"), (902, "", None), (903, "abcabc" * 3000, None), (None, "vwx", "bb")], "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = {r["doc_id"]: r for r in language.predict(table, held).collect()}
    truth = {i: k for i, _, k in rows}
    assert np.mean([got[i]["lang_pred"] == k for i, k in truth.items() if got[i]["held_out"]]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "aa" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(table.limit(0), held).count() == 0
    assert {r["lang_pred"] for r in language.predict(table.withColumn("lang", F.lit(None).cast("string")), held).collect()} == {"und"}


def test_backpropagation_is_the_gradient():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in language.start(3).items()}
    x, goal = rng.integers(97, 110, (6, 4)), rng.normal(size=(6, 4, language.HIDDEN))
    for way in "fb":
        keep = []
        language.run(x, p, way, keep)
        grads = language.back(x, goal, keep, p, way)
        for name, at in ((f"{way}g", (1, 3)), (f"{way}n", (2, 5)), (f"{way}x", (int(x[2, 1]), 7))):
            loss = []
            for step in (1e-2, -1e-2):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                loss.append((language.run(x, q, way) * goal).sum())
            assert abs((loss[0] - loss[1]) / 2e-2 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def least_cost(roles):
    """Cheapest repair by writing down every legal conversation: of each row its role, merged or not, and the empty turns in between."""
    names = ("system", "user", "assistant")

    def legal(turns):
        turns = turns[1:] if turns[:1] == ["system"] else turns
        return bool(turns) and all(t == ("user", "assistant")[k % 2] for k, t in enumerate(turns)) and turns[-1] == "assistant"

    best, fill = float("inf"), [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    for new in product(names, repeat=len(roles)):
        changes = 2.0 * sum(a != b for a, b in zip(roles, new, strict=True))
        for joined in product((False, True), repeat=len(roles) - 1):
            if any(j and a != b for j, a, b in zip(joined, new, new[1:], strict=False)):
                continue
            kept = [r for r, j in zip(new, (False, *joined), strict=True) if not j]
            if changes + sum(joined) >= best:
                continue
            for gaps in product(fill, repeat=len(kept) + 1):
                price = changes + sum(joined) + 3.0 * sum(map(len, gaps))
                if price < best and legal([t for gap, r in zip(gaps, [*kept, None], strict=True) for t in (*gap, r) if t]):
                    best = price
    return best


def least_cost_of_long(roles):
    """The same for many rows, from the least costs of their states, by the operator's own prices."""
    cost, _ = chat.moves()
    best = {chat.START: 0.0}
    for role in roles:
        best = {after: min(c + cost[chat.role_code(role), state, after] for state, c in best.items()) for after in range(1, 4)}
    return min(c + chat.ENDING[s][0] for s, c in best.items())


def test_chat_repair(spark):
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, rng.choice(roles), rng.choice(["hi", "", None, "a <|user|> b"])) for c in range(60) for t in range(rng.randrange(1, 12) if c % 2 else rng.randrange(1, 5))]
    rows += [(999, t, rng.choice(roles), "x") for t in range(2000)] + [(1000, 5, "user", "same")] * 30 + [(1001, t, "user", "long " * 60_000) for t in range(9)] + [(None, None, "assistant", "q")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"part": F.lit(1), "cost": F.lit("x")})
    got = chat.repaired(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: r["position"]):
        by.setdefault(r["conv_id"], []).append(r)
    for conv, each in by.items():
        assert [r["position"] for r in each] == list(range(len(each)))
        ending = chat.ENDING[chat.ROLES.index(each[-1]["new_role"]) + 1][0]
        assert sum(r["cost"] for r in each) + ending == (least_cost if len(each) < 5 else least_cost_of_long)([r["role"] for r in each]), conv
        turns = re.findall(r"<\|(\w+)\|>\n", "".join(r["rendered"] for r in each))
        turns = [t for t in turns if t != "end"]
        turns = turns[1:] if turns[0] == "system" else turns
        assert turns == ["user", "assistant"] * (len(turns) // 2) and turns
    assert chat.repaired(df.limit(0)).count() == 0


def test_pii(spark):
    text = "Write to John Smith at j.doe@mail.example.com or 192.168.7.10, card 4111 1111 1111 1111, call +1 (202) 555-0143. token = \"abcdef0123456789abcdef\"; id 123-45-6789. Maria Lopez knows John Smith."
    rows = [(1, text), (2, "JOHN wrote. J.DOE@mail.example.com"), (3, None), (4, ""), (5, "clean text with 12 numbers, 3.14 and v1.2.3."), (6, "Анна Петрова и Иван Петров"), (1, text)]
    df = frame(spark, rows).withColumn("entities", F.lit("old"))
    out = pii.surrogates(df, b"key").persist()
    got = {r["doc_id"]: r for r in out.collect()}
    kinds = Counter(e["kind"] for e in got[1]["entities"])
    assert kinds == {"given": 3, "family": 3, "email": 1, "ip": 1, "card": 1, "phone": 1, "secret": 1, "id": 1}
    for e in got[1]["entities"]:
        assert e["entity"] != e["surrogate"] and len(e["entity"]) == len(e["surrogate"]) or e["kind"] in ("given", "family")
        assert e["entity"] not in got[1]["text"]
    new = {e["kind"]: e["surrogate"] for e in got[1]["entities"]}
    digits = [int(c) for c in new["card"] if c.isdigit()]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0 and new["card"][0] == "4"
    assert new["phone"].startswith("+1 (") and re.fullmatch(r"\d{3}\.\d{3}\.\d\.\d{2}", new["ip"]) and re.fullmatch("[0-9a-f]+", new["secret"])
    assert [e["kind"] for e in got[2]["entities"]] == ["given", "email"] and got[2]["entities"][1]["surrogate"].lower() == new["email"].lower()
    people = [e["surrogate"] for e in got[1]["entities"] if e["kind"] == "given"]
    assert people[0] == people[2] and people[0] in pii.NAMES["latin", "m"] and people[1] in pii.NAMES["latin", "f"]
    assert got[6]["entities"][0]["surrogate"] in pii.NAMES["cyrillic", "f"]
    assert [got[i]["text"] for i in (3, 4, 5)] == [None, "", rows[4][1]] and out.count() == len(rows)
    assert pii.collisions(out).count() == 0 and pii.surrogates(df.limit(0), b"k").count() == 0
    again = {r["doc_id"]: r["text"] for r in pii.surrogates(df, b"other").collect()}
    assert again[1] != got[1]["text"]


def test_names_in_running_text_of_every_script():
    make = pii.Surrogates(b"k")
    for text, name in (("Contact Maria Garcia now", "Maria Garcia"), ("Yesterday Anna Schmidt left", "Anna Schmidt"), ("Dr John Smith", "John Smith"), ("вчера Анна Петрова ушла", "Анна Петрова"), ("χθες Μαρία Παππά έφυγε", "Μαρία Παππά"), ("Dear Maria Anna Schmidt", "Maria Anna Schmidt")):
        new, found = make.replaced(text)
        assert [x[1] for x in found] == name.split() and name not in new
    for text, names in (("Fatima Khan left", "Fatima Khan"), ("Dr. Smith came, Smith went", "Smith Smith"), ("Mr. Jones", "Jones"), ("JOHN SMITH", "JOHN SMITH"), ("Maria said hello", "Maria"), ("Анна пошла домой", "Анна"), ("Μαρία έφυγε", "Μαρία")):
        new, found = make.replaced(text)
        assert [x[1] for x in found] == names.split() and new.isupper() == text.isupper()
    for text in ("Jack London Square", "Вера в людей", "Maria Theresa College", "Dear Jack, hi", "Mr. and", "a Mary"):
        assert make.replaced(text) == (text, [])
    for text in ("at fe80::1 or", "2001:db8::8a2e:370:7334", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"):
        (kind, entity, new), = make.replaced(text)[1]
        assert kind in ("ip6", "iban") and pii.valid(kind, entity) and pii.valid(kind, new) and entity != new
    for text in ("12:30:45", "std::vector", "GB82 WEST 1234 5698 7654 33", "::"):
        assert make.replaced(text) == (text, [])
    # Endings keep gender, kinship stays, and listed names stay apart from shaped ones.
    names = [f"{stem}{end}" for stem in ("Петр", "Иван", "Жук", "Достоев") for pair in pii.ENDINGS for end in pair.split()] + [n for n in pii.FAMILIES[0]] + [f"Zo{a}{b}el" for a in "abc" for b in "xyz"]
    moved = [make.of("family", n) for n in names]
    assert len(set(moved)) == len(set(names)) and all(a != b for a, b in zip(names, moved, strict=True))
    assert make.of("family", "Жукова") == make.of("family", "Жуков") + "а"
    assert [x[1] for x in make.replaced("auth: abcdefghij")[1]] == ["abcdefghij"]


def test_pii_finds_what_was_planted(spark):
    """Entities of every kind in random prose: all of them, nothing else, one surrogate each, and all else unchanged."""
    rng = random.Random(31)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = {
        "email": lambda: f"{rng.choice(VOCABULARY)}.{digits(2)}@{rng.choice(VOCABULARY)}.example.org",
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "ip6": lambda: ":".join(f"{rng.randrange(1, 1 << 16):x}" for _ in range(8)),
        "card": lambda: f"4{digits(15)}",
        "phone": lambda: f"+{rng.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
        "id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: (lambda a: f"DE{98 - int(a + '131400') % 97:02d}{a}")(digits(18)),
        "given": lambda: rng.choice([n for g in pii.NAMES.values() for n in g if n.lower() not in pii.COMMON]),
    }
    rows, planted = [], {}
    for doc in range(300):
        parts, planted[doc] = [], []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.choice(list(make))
            planted[doc].append((kind, make[kind]()))
            parts += [prose(rng.randrange(1, 9), rng.randrange(999)), planted[doc][-1][1]]
        rows.append((doc, " ".join([*parts, prose(5, doc)])))
    got = pii.checked_surrogates(frame(spark, rows), b"key").collect()
    seen = {}
    for r in got:
        assert [(e["kind"], e["entity"]) for e in r["entities"]] == planted[r["doc_id"]]
        text = rows[r["doc_id"]][1]
        for e in r["entities"]:
            assert seen.setdefault((e["kind"], e["entity"]), e["surrogate"]) == e["surrogate"] != e["entity"]
        at, new = 0, []
        for e in r["entities"]:
            to = text.index(e["entity"], at)
            new += [text[at:to], e["surrogate"]]
            at = to + len(e["entity"])
        assert r["text"] == "".join([*new, text[at:]])
    assert len({(k, s) for (k, _), s in seen.items()}) == len(seen)


def test_pii_is_linear_in_long_runs():
    import time

    s, began = pii.Surrogates(b"k"), time.time()
    for run in ("a" * 300_000, "1" * 300_000, "a.b" * 100_000, "A" * 300_000, "x@" * 100_000, "f0" * 150_000, "Ab " * 100_000, "Anna " * 60_000, "a:" * 150_000, "::" * 150_000, "DE12 " * 60_000):
        s.replaced(f"1@ {run}")
    assert time.time() - began < 20


def test_surrogates_are_permutations():
    s = pii.Surrogates(b"k")
    for size in (2, 3, 10, 97, 1000):
        moved = [s.moved(x, size, "t") for x in range(size)]
        assert sorted(moved) == list(range(size)) and all(a != b for a, b in enumerate(moved))
    assert len({s.ip(f"10.{a}.3.4") for a in range(10, 100)}) == 90
    assert len({s.card(f"41111111111{k:05d}") for k in range(2000)}) == 2000


def test_spellings_of_one_entity_share_a_surrogate(spark):
    """Telephone numbers however they are grouped, addresses with or without their zeros, and numbers of other countries' grouping."""
    plain = lambda text: re.sub(r"[^0-9+]", "", text)
    phones = ["(202) 555-0143", "202-555-0143", "202 555 0143", "202.555.0143"]
    addresses = ["2001:db8:0:0:0:0:0:1", "2001:db8::1", "2001:0DB8::0001", "2001:0db8:0000:0000:0000:0000:0000:0001"]
    foreign = ["+44 20 7946 0958", "+49 30 123456", "+33 42 68 53 00", "+1 (202) 555-0143", "+1 202 555 0143"]
    texts = [f"call {x} or see {y} now" for x, y in zip(phones, addresses, strict=True)] + [f"from abroad {x}, thanks" for x in foreign] + ["totals +12 34 and +1 23 456 stay, as 2024 does"]
    done = pii.checked_surrogates(frame(spark, enumerate(texts)).select("doc_id", "text"), b"key").collect()
    new = {e["entity"]: e["surrogate"] for r in done for e in r["entities"]}
    assert set(new) == {*phones, *addresses, *foreign}
    assert len({plain(new[x]) for x in phones}) == 1 and plain(new[phones[0]]) != plain(phones[0])
    assert [re.sub(r"\d", "0", new[x]) for x in phones] == [re.sub(r"\d", "0", x) for x in phones]
    assert len({ipaddress.IPv6Address(new[x]) for x in addresses}) == 1 and "::" in new[addresses[1]] and len(new[addresses[3]]) == 39
    assert plain(new[foreign[3]]) == plain(new[foreign[4]]) == "+1" + plain(new[phones[0]])
    # Two spellings with two surrogates would be told.
    wrong = spark.createDataFrame([([{"kind": "phone", "entity": "202-555-0143", "surrogate": "1"}, {"kind": "phone", "entity": "202 555 0143", "surrogate": "2"}, {"kind": "ip6", "entity": "::1", "surrogate": "::2"}, {"kind": "ip6", "entity": "0:0:0:0:0:0:0:1", "surrogate": "::3"}],)], "entities array<struct<kind:string,entity:string,surrogate:string>>")
    assert {r["kind"] for r in pii.collisions(wrong).collect()} == {"phone", "ip6"}


def test_pipeline_without_labels_or_ids(spark, tmp_path):
    """Unlabelled texts stay, rows without id or with a repeated one are decided on their own, an empty table goes through."""
    import corpus_pipeline

    leak = prose(40, 3333)
    texts = [(i, prose(60, 500 + i)) for i in range(20)] + [(None, prose(60, 700)), (None, None), (None, f"{prose(20, 1)} {leak}"), (3, None), (50, prose(60, 750)), (50, prose(60, 750))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, node string, __gone2 long"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("some", texts), ("none", [])):
        table = spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", "n", 1) for i, t in rows], schema)
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            after = stage(spark, table, str(tmp_path))
            assert after.columns == table.columns
            after.write.parquet(str(tmp_path / f"{name}{at}"))
            table = spark.read.parquet(str(tmp_path / f"{name}{at}"))
        left = Counter(r["doc_id"] for r in table.collect())
        assert left == (Counter({None: 1, 50: 2} | dict.fromkeys(range(20), 1)) if rows else Counter())
        assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()} == set(left)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    monkey = [(i, f"{prose(80, 900 + i)}\n{prose(40, 1900 + i)}") for i in range(40)]
    leak = prose(40, 3333)
    rows = [*monkey, (100, monkey[0][1]), (101, changed(monkey[1][1].replace("\n", " "), 2, 5)), (102, f"{prose(30, 77)} {leak} {prose(20, 78)}"), (103, "12 34"), (104, None)]
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, table, str(tmp_path))
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    assert {r["doc_id"] for r in table.collect()} == {*range(40), 101} or {r["doc_id"] for r in table.collect()} == set(range(40))
    packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in table.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_stages_keep_columns_that_are_named_like_their_helpers(spark, tmp_path):
    import corpus_pipeline

    leak, line = prose(40, 3333), prose(30, 21)
    texts = [prose(60, 500), f"{line}\n{prose(60, 501)}", f"{line}\n{prose(60, 502)}", prose(60, 500), f"{prose(20, 1)} {leak}", "", None]
    names = "gone Numbers emptied spans NONE its_text lettered language probability removed key node src component_id gone_ part sequence_id".split()
    df = spark.createDataFrame([(i, t, "l", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    df = df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for stage, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, df, str(tmp_path))
        assert after.columns == df.columns
        rows = after.collect()
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        kept[stage] = {r["doc_id"] for r in rows}
    assert kept["language_id"] >= {0, 1, 2, 3, 4} and not kept["language_id"] & {5, 6}
    assert kept["near_dedup"] == {0, 1, 2, 4, 5, 6} and kept["decontamination"] == {0, 1, 2, 3, 5, 6} and kept["line_dedup"] == {0, 1, 2, 4, 5, 6}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()} == set(range(7))
    cut = substring_dedup.drop_repeated_passages(df)
    assert cut.columns == df.columns and {r["spans"] for r in cut.collect()} == {f"spans{i}" for i in range(7)}


def test_sets_just_below_the_similarity_are_no_candidates(spark):
    """Of long sets of several components few pairs below the threshold are candidates, and none at it is lost."""
    rng = np.random.default_rng(11)
    base = rng.integers(-(2**62), 2**62, 500)
    rows = []
    for k in range(60):
        # Every two share about 0.76; each third one comes near the one before.
        own = rows[-1][3][3:] if k % 3 == 2 else np.concatenate([np.delete(base, rng.choice(500, 33, replace=False)), rng.integers(-(2**62), 2**62, 33)]).tolist()
        rows.append((k, k, 0, list(own)))
    sets = spark.createDataFrame(rows, "node long, component long, sketch long, shingles array<long>")
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    every = {(i, j): alike(rows[i][3], rows[j][3]) for i in range(60) for j in range(i)}
    linked = {frozenset(p) for p, s in every.items() if s >= 0.8}
    assert linked and sum(0.7 <= s < 0.8 for s in every.values()) > 1000
    made = prefixes.pairs(prefixes.heads(sets, 80), 80, 64, False).collect()
    got = {frozenset((r["src"], r["dst"])) for r in made}
    assert linked <= got
    assert len(got) < 0.3 * len(every)
