import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import embedding_dedup, shingle_dedup, simhash_dedup
from tesserae.llm.components import connected_components
from tesserae.llm.gray_index import GrayIndex, gray_rank


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_gray_rank():
    assert [int(x) for x in gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))] == list(range(8))


def near_codes(rng, n=60, copies=12):
    codes = rng.integers(0, 2**63, n, dtype=np.uint64)
    flips = [codes ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k % 6 + 1, n), dtype=np.uint64), axis=0) for k in range(copies)]
    return np.concatenate([codes, *flips])


@pytest.mark.parametrize("limit", [0, 3, 4, 7])
def test_gray_index_finds_all(limit):
    index = GrayIndex(near_codes(np.random.default_rng(limit)))
    c = index.codes
    found = {(int(a), int(b)) for x, y in index.batches(limit) for a, b in zip(x, y)}
    assert found == set(zip(*map(list, np.nonzero(np.triu(np.bitwise_count(c[:, None] ^ c[None, :]) <= limit, 1)))))


def parts(pairs, nodes):
    s = Sets()
    for n in nodes:
        s.find(n)
    for a, b in pairs:
        s.link(a, b)
    return {n: s.find(n) for n in nodes}


@pytest.mark.parametrize("size", [8192, 16])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, size):
    """With a tiny index, buckets overflow into leaves."""
    monkeypatch.setattr(simhash_dedup, "INDEX_CODES", size)
    rng = np.random.default_rng(3)
    hot = np.uint64(0x123456789ABCDEF0) ^ (rng.integers(0, 2**22, 150, dtype=np.uint64) << np.uint64(40))
    c = np.unique(np.concatenate([near_codes(rng), hot])).view(np.int64)
    u = c.view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    want = parts([(int(c[a]), int(c[b])) for a, b in zip(i, j)], map(int, c))
    df = spark.createDataFrame([(int(x),) for x in c], "code long")
    # The partition function runs in workers that import the module; the size must travel with it.
    import functools

    rows = df.coalesce(1).mapInArrow(simhash_dedup._route(4), "table_no int, bucket long, gray long, moved long")
    rows = rows.orderBy("table_no", "gray").coalesce(1)
    del functools
    if size == 8192:
        pairs = [(r.a, r.b) for r in simhash_dedup.links(df, 4).collect()]
    else:
        batch = rows.toArrow().combine_chunks().to_batches()
        out = [r for b in simhash_dedup._join_buckets(4)(iter(batch)) for r in b.to_pylist()]
        leaves = [r for r in out if r["kind"] == 1]
        assert leaves
        pairs = [(r["a"], r["b"]) for r in out if r["kind"] == 0]
        import pyarrow as pa

        both = [(x["table_no"], x["codes"], y["codes"]) for x in leaves for y in leaves if (x["table_no"], x["bucket"]) == (y["table_no"], y["bucket"]) and x["leaf"] < y["leaf"]]
        t, x, y = zip(*both)
        again = pa.record_batch([pa.array(t, pa.int32()), pa.array(x, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64()))], ["t", "x", "y"])
        pairs += [(r["a"], r["b"]) for b in simhash_dedup._join_leaves(4)(iter([again])) for r in b.to_pylist()]
    assert parts(pairs, map(int, c)) == want


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + chain + [(7, 7)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in connected_components(df).collect()} == parts([p for p in pairs if p[0] != p[1]], nodes)
    assert connected_components(df.limit(0)).count() == 0


def expected_groups(rows):
    codes = {t: slow_fingerprint(t) for _, t in rows}
    distinct = sorted(set(codes.values()))
    groups = parts([(a, b) for k, a in enumerate(distinct) for b in distinct[k:] if (a ^ b).bit_count() <= 4], distinct)
    least = {}
    for i, t in rows:
        g = groups[codes[t]]
        least[g] = min(x for x in (least.get(g), i, float("inf")) if x is not None)
    return Counter((i, codes[t], None if least[groups[codes[t]]] == float("inf") else least[groups[codes[t]]]) for i, t in rows), groups, codes


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_near_duplicates(table, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want, groups, codes = expected_groups(rows)
    got = simhash_dedup.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.code & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash_dedup.near_dedup(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert sorted(groups[codes[t]] for _, t in left) == sorted(set(groups.values()))
    for i, t in left:
        assert i == next(x[2] for x in want if x[1] == codes[t] and groups[x[1]] == groups[codes[t]])


def test_no_documents(empty):
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.near_dedup(empty).count() == 0


def brute_vectors(rows):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float64)
    ks = list(good)
    links, s = Counter(), Sets()
    for x, a in enumerate(ks):
        s.find(a)
        for b in ks[x + 1 :]:
            u, w = good[a], good[b]
            if len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.9:
                links[a] += 1
                links[b] += 1
                s.link(a, b)
    least = {}
    for a in ks:
        ids = [rows[b][0] for b in ks if s.find(b) == s.find(a) and rows[b][0] is not None]
        least[a] = min(ids) if ids else None
    return Counter((i, links[k], least.get(k, i) if k in good else i) for k, (i, v) in enumerate(rows))


def check_vectors(df, rows, probes=4):
    got = embedding_dedup.near_duplicate_vectors(df, probes=probes).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_vectors_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_vectors(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]),
            (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, -1.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e30, 1e28])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string")
    as_float = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    check_vectors(df, as_float)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_over_cells(spark, monkeypatch, block):
    """Many cells, and several blocks to a cell: near copies at the limit and hot groups; recall against brute force, all found with all cells."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(900, 32)) / np.sqrt(32)
    near = base[:900] + rng.uniform(0.05, 0.45, (900, 1)) * noise
    hot = base[5] + 0.05 * rng.normal(size=(1200, 32)) / np.sqrt(32)
    x = np.concatenate([base, near, hot]).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, cells int, first string")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    want = linked.sum(axis=1) - 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df, cells=64).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.97 * want.sum()
    loose = np.flatnonzero((want > 0) & (want < 50))
    assert n[loose].sum() >= 0.95 * want[loose].sum()
    exact = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df, cells=16, probes=16).collect()}
    assert [exact[i].n_links for i in range(len(x))] == want.tolist()
    groups = parts([(int(i), int(j)) for i, j in zip(*np.nonzero(linked)) if i < j], range(len(x)))
    assert all(groups[exact[i].component_id] == groups[i] for i in range(len(x))) and len({r.component_id for r in exact.values()}) == len(set(groups.values()))


def word_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_shingle_groups(table, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    texts = sorted({t or "" for _, t in rows})
    sets = {t: word_shingles(t) for t in texts}
    want = parts([(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if alike(sets[a], sets[b])], texts)
    kept = shingle_dedup.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(want[r.text or ""] for r in kept.select("text").collect()) == sorted(set(want.values()))


def test_pipeline_drops_near_copies(spark, sf_dir):
    """Copies at a similarity of 0.8 to 0.9, whose SimHash codes differ in more than four bits, go; less similar texts stay."""
    rng = random.Random(4)
    docs, n_far = [], 0
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        near, less = words[:], words[:]
        for i in (20, 80, 140)[: 1 + k % 3]:
            near[i] = "changed"
        for i in range(5, 195, 25):
            less[i] = "other"
        docs += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(less))]
        assert alike(word_shingles(docs[-3][1]), word_shingles(docs[-2][1])) and not alike(word_shingles(docs[-3][1]), word_shingles(docs[-1][1]))
        n_far += (slow_fingerprint(docs[-3][1]) ^ slow_fingerprint(docs[-2][1])).bit_count() > 4
    assert n_far > 3
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf_dir)
    assert {r.doc_id for r in got.collect()} == {d for d, _ in docs if d % 3 != 1}


def test_large_group_and_its_fringe(spark):
    """Chains: a group's members that aren't like the least one are found through others."""
    words = [f"w{i}" for i in range(300)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 150])) for k in range(40)] + [(100, "w0 w1")]
    docs = docs + [(200 + k, t.upper()) for k, t in docs]
    kept = shingle_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {0, 100}
    assert shingle_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").limit(0)).count() == 0


def fringe(n, edits, seed=1):
    """Texts of 150 words, most too far from each other to be near copies, as all differ from one in edits words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(n):
        own = words[:]
        for i in rng.sample(range(150), edits if k % 4 else edits // 4):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("cell", [1 << 20, 2000, 1])
def test_left_apart_in_cells(spark, cell, monkeypatch):
    """What is compared grows with the texts, not their pairs; cells of any size find the same."""
    texts, rows, apply = fringe(300 if cell == 1 << 20 else 60, 4), [], shingle_dedup.map_arrow
    monkeypatch.setattr(shingle_dedup, "CELL", cell)
    monkeypatch.setattr(shingle_dedup, "map_arrow", lambda df, *rest: rows.append(df.count()) or apply(df, *rest))
    kept = shingle_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [word_shingles(t) for t in texts]
    want = parts([(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])], range(len(texts)))
    assert len(set(want.values())) > len(texts) / 4
    assert sorted(want[r.doc_id] for r in kept) == sorted(set(want.values()))
    if cell == 1 << 20:
        assert max(rows) <= 20 * len(texts)  # a row for each text and band at most


def test_shingle_groups_by_fingerprints(spark, monkeypatch):
    """Fingerprints alone find near copies, and link none that aren't similar enough."""
    monkeypatch.setattr(shingle_dedup, "bands", lambda own, factors: [])
    rng, docs = random.Random(9), []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        docs += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words[:-1], "changed"]))]
        # Mostly one shingle over and over, so that fingerprints agree, though the sets don't.
        docs += [(3 * k + 2, " ".join(["same"] * 500 + words[:20]))]
    near = [(a, b) for a, b in docs if a % 3 == 1]
    assert all((slow_fingerprint(docs[a][1]) ^ slow_fingerprint(docs[a - 1][1])).bit_count() <= 4 for a, _ in near[:3])
    kept = shingle_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs if d % 3 != 1}


@pytest.mark.parametrize("two", [False, True])
def test_join_cell(two):
    rng = np.random.default_rng(3)
    for _ in range(50):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(45, 61)], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(12)]
        group, side = rng.integers(0, 5, 12).tolist(), rng.integers(0, 2, 12).tolist() if two else [3] * 12
        near = lambda pairs: {(a, b) for a, b in pairs if shingle_dedup.similarity(sets[a], sets[b]) >= 0.8}
        found = shingle_dedup.join_cell(list(range(12)), group, side, sets, 0.8)
        every = near((a, b) for a in range(12) for b in range(12) if group[a] != group[b] and (not (two and len(set(side)) > 1) or side[a] != side[b]))
        assert set(found) <= every
        assert parts([(-1 - group[a], -1 - group[b]) for a, b in found], range(-5, 0)) == parts([(-1 - group[a], -1 - group[b]) for a, b in every], range(-5, 0))


@pytest.mark.parametrize("cells", [64, 256, 2048])
def test_probes_find_links_at_the_limit(cells):
    """Pairs at a cosine of 0.9, held out from the centres' sample: found if they share a cell."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = embedding_dedup.spherical_kmeans(unit(rng.normal(size=(20_000, 64))), cells, 2)
    x = unit(rng.normal(size=(2000, 64)))
    t = rng.normal(size=x.shape)
    y = 0.9 * x + np.sqrt(0.19) * unit(t - (t * x).sum(axis=1, keepdims=True) * x)

    def assigned(v, probes=None):
        n = pa.array(range(len(v)))
        batch = pa.record_batch([n, pa.array([1] * len(v)), pa.array([64] * len(v)), pa.array(v.tolist()), n, n, n], ["rep", "copies", "width", "vector", "k1", "k2", "first_id"])
        return [set(r["cells"]) for b in embedding_dedup._assign({64: centres}, probes, 0.9 - 1e-9)(iter([batch])) for r in b.to_pylist()]

    share = lambda a, b: np.mean([bool(p & q) for p, q in zip(a, b)])
    assert share(assigned(x), assigned(y)) > 0.95
    if cells == 256:
        assert share(assigned(x, cells), assigned(y, cells)) == 1.0  # what half the reach rules out is found from the other side
