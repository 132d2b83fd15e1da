"""Decontamination and SimHash against brute force, with odd rows of every kind."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from chargeloom.llm import components, decontaminate, simhash
from chargeloom.llm.queries import op1_decontaminate, op5_simhash

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(10, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def sample(seed=5):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "straße", "Ünï", "x1", "42", "日本", "and", "to", "In"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "..", "\t"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 7, 9, 10, 11, 40]))) for i in range(30)] + [(90, ""), (91, None), (3, "THE of to, the of"), (92, "a a a a a a a a a a a a a a")]
    docs = []
    for d in range(120):
        body = text(rng.choice([0, 1, 5, 30, 200]))
        if d % 2:
            body += " zq " + (rng.choice(items)[1] or "").upper() + " qz " + text(20)
        docs.append((d, body))
    docs += [(500, None), (501, ""), (7, "dup of id " + items[0][1]), (502, "a " * 50), (503, "\x00\x01"), (504, text(60_000))]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"max_broadcast": -1}])
def test_decontaminate_is_exact(spark, options):
    docs, items = sample()
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int").repartition(3)
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, n_words int")
    found = decontaminate.decontaminate(d, i, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=repr) == brute_hits(docs, items)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeated_rows_and_full_bitmaps(spark, monkeypatch):
    """Rows equal in everything each have a row, and bitmaps that know everything change nothing."""
    docs, items = sample(8)
    docs += [docs[1], docs[1], docs[3]]
    monkeypatch.setattr(decontaminate, "MAX_FILTER_BITS", 6)
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=repr) == brute_hits(docs, items)


def test_a_small_benchmark_is_kept_in_few_files(spark, monkeypatch):
    """Files that are kept follow the benchmark's size, not the number of shuffle partitions; results are the same."""
    docs, items = sample(9)
    size, kept, plain = sum(len((t or "").encode()) for _, t in items), [], decontaminate.checkpointed
    monkeypatch.setattr(decontaminate, "checkpointed", lambda df: kept.append(plain(df)) or kept[-1])
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for part, files in ((None, 1), (-(-size // 3), 3), (1, 40)):
            kept.clear()
            if part:
                monkeypatch.setattr(decontaminate, "PART_BYTES", part)
            found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
            assert sum(df.rdd.getNumPartitions() for df in kept) == files
            assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=repr) == brute_hits(docs, items)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fingerprints_are_thinned():
    """Each window's fingerprint is its smallest k-gram, the last of equal ones, and is listed once."""
    rng = random.Random(4)
    raw = " ".join(rng.choice("abcd") for _ in range(400)).encode()
    found = decontaminate.split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    starts, grams = decontaminate.window_starts(found, decontaminate.WINDOW), decontaminate.gram_hashes(found, decontaminate.K).tolist()
    hashes, positions, of = decontaminate.winnow(found, starts)
    assert len(set(positions.tolist())) == len(positions) < len(starts)
    for s, o in zip(starts.tolist(), of.tolist()):
        inside = range(s, s + decontaminate.WINDOW - decontaminate.K + 1)
        assert positions[o] == min(inside, key=lambda i: (grams[i], -i)) and hashes[o] == grams[positions[o]]


def test_decontaminate_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "d")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, none).orderBy("doc_id").collect()] == [(1, 0, []), (3, 0, [])]
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_word_hash_over_slices():
    raw = np.frombuffer(("ab " * 900_000).encode(), np.uint8)
    found = decontaminate.split_words(raw, np.array([0, len(raw)]))
    assert len(found.hashes) == 900_000 and len(set(found.hashes.tolist())) == 1


def test_op1_query(spark, tmp_path):
    docs, items = sample(6)
    docs = [(d, t) for d, t in docs if d != 7]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.n_items, r.contaminated) for r in op1_decontaminate(spark, str(tmp_path)).collect())
    want = sorted((d, n, h, hashlib.sha256(s.encode()).hexdigest(), len(s.split(",")) if s else 0, h > 0) for d, n, h, s in brute_hits(docs, items))
    assert got == want


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [2048, 3])
def test_op5_against_brute_force(spark, tmp_path, block):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)) for _ in range(15)]
    docs = {}
    for i in range(150):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["Zz", "y\x0b", "ü"])
        docs[i * 7 % 1000] = " ".join(w) if i % 20 else rng.choice(["", None, " \n", "one", "one two"])
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    prints = {i: brute_print(t) for i, t in docs.items()}
    want = brute_components(prints)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(rows, block=block).collect()}
    assert got == {i: (prints[i], want[i]) for i in docs}
    if block == 2048:
        rows.write.parquet(f"{tmp_path}/documents.parquet")
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, str(tmp_path)).collect()} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_bit_sliced_groups():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values, group = [], []
    for g, many in enumerate((1, 2, 5, 33, 40, 300, 700)):
        for _ in range(many):
            v = int(rng.choice(centres))
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(b)
            values.append(v), group.append(g)
    values, group = np.array(values, np.uint64), np.array(group)
    labels = simhash.group_labels(values, group, 2)
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 2) & (group[:, None] == group[None, :])
    want = np.arange(len(values))
    while True:
        nxt = np.array([want[near[i]].min() for i in range(len(values))])
        if (nxt == want).all():
            break
        want = nxt
    assert (labels == want).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_within_counts_exactly(radius):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a ^ rng.choice(np.array([0, 1, 3, 7, 15, 31, 63, 127], np.uint64), 200)
    packed = simhash.within(simhash.bit_planes(a), simhash.bit_planes(b), radius)
    assert (simhash._flags(packed, 200) == (np.bitwise_count(a ^ b) <= radius)).all()
    assert simhash.within(simhash.bit_planes(a[:64]), simhash.bit_planes(~a[:64]), radius) is None


def test_rows_without_ids_and_repeats(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "a b c d")], "doc_id int, text string")
    got = sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(rows).collect() if r)
    assert got == [(False, 3), (False, 3), (False, 3), (True, None)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 0)]
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 130)}
    assert components.components(edges.limit(0)).count() == 0


def test_a_hub_of_most_edges_is_joined_in_parts(spark):
    """A star whose middle is not its smallest node, a chain and a loop: roots as by union-find."""
    star = spark.range(1, 5001).selectExpr("if(id % 2 = 0, id, 2500L) as u", "if(id % 2 = 0, 2500L, id) as v")
    chain = spark.range(10_000, 10_400).selectExpr("id as u", "id + 1 as v")
    loop = spark.createDataFrame([(20_000, 20_000), (20_001, 20_000), (20_000, 20_001)], "u long, v long")
    got = {r.node: r.root for r in components.components(star.union(chain).union(loop)).collect()}
    want = dict.fromkeys(range(2, 5001), 1) | dict.fromkeys(range(10_001, 10_401), 10_000) | {20_001: 20_000}
    assert got == want
    joined, least = components._with_least(star)
    middle = joined.filter("u = 2500").select("m").distinct().collect()
    assert [r.m for r in middle] == [1] and joined.count() == 5000 and least.count() == least.select("u").distinct().count()


def test_components_shuffle_little(spark, monkeypatch):
    """A star is settled after one round, and what a round shuffled is gone after it."""
    made, freed = [], []
    real, release = components.checkpointed, components.release
    monkeypatch.setattr(components, "checkpointed", lambda df: made.append(df) or real(df))
    monkeypatch.setattr(components, "release", lambda s: freed.append(s) or release(s))
    star = spark.range(1, 500).selectExpr("id as u", "if(id = 250, 1L, 250L) as v")
    assert {r.root for r in components.components(star).collect()} == {1}
    assert (len(made), len(freed)) == (2, 1)
    edges = spark.range(10).selectExpr("id + 1 as u", "id as v")
    plan = components._small_star(components._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    # Written out, before equal ones are shared; 21 when nodes and parts were joined three times.
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) <= 15
