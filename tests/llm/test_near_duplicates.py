"""SimHash and nearest neighbours against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash
from textloom.llm.batches import stored
from textloom.llm.vantage import nearest


def brute_roots(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def noisy(n, centres, flips, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, centres, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(base[rng.integers(centres)])
        for _ in range(rng.integers(0, flips)):
            x ^= 1 << int(rng.integers(64))
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize(("n", "centres", "flips"), [(1, 1, 1), (50, 5, 4), (600, 20, 6), (900, 1, 8), (500, 500, 1)])
@pytest.mark.parametrize("frontier", [7, 100_000])
def test_trie_join_equals_brute_force(n, centres, flips, frontier):
    values = noisy(n, centres, flips)
    assert list(simhash.trie_forest(values, 0, 3, frontier)) == brute_roots(values)


@pytest.mark.parametrize(("n", "centres", "flips", "limit"), [(300, 30, 5, 8192), (900, 2, 9, 20), (900, 30, 6, 5)])
def test_dealt_groups_lose_no_link(spark, n, centres, flips, limit):
    """Also when groups are dealt again and again."""
    values = noisy(n, centres, flips, 1)
    fps = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    edges, _ = stored(simhash.links(fps, 3, limit))
    roots = {r.node: r.root for r in simhash.components(edges)[0].collect()}
    got, want = {}, {}
    for k, (x, r) in enumerate(zip(values.view(np.int64), brute_roots(values), strict=True)):
        got.setdefault(roots.get(int(x), int(x)), set()).add(k)
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", " \n ", "One", "one Two", "a b c", "A B C d e f g", "ÄÖ É x y z", "x\u00a0y\u2003z w", "k k k k k k", "the same words in a row " * 40, "the same words in a row " * 40 + "end"]


def test_fingerprints_follow_the_rule(spark):
    for text in TEXTS:
        assert simhash.fingerprint(text) == slow_fingerprint(text), text
    # Spark's own hash is the one asked for.
    assert spark.sql("select hex(xxhash64('abc d é'))").first()[0].lower() == xxhash.xxh64_hexdigest("abc d é", 42)


def test_near_duplicates(spark):
    rows = [(k + 10, t, "x") for k, t in enumerate(TEXTS)] + [(5, None, "x"), (None, "a b c", "x"), (14, "a b c", "x"), (None, "nobody else has this", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    values = np.unique(np.array([slow_fingerprint(t or "") for _, t, _ in rows], np.uint64))
    root = dict(zip(values.tolist(), brute_roots(values), strict=True))
    least = {}
    for k, t, _ in rows:
        r = root[slow_fingerprint(t or "")]
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    want = sorted((str(k), f"{slow_fingerprint(t or ''):016x}", str(least[root[slow_fingerprint(t or '')]])) for k, t, _ in rows)
    got = simhash.near_duplicates(df)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({k for k, _, c in want if k == c and k != "None"} | {"None"}) + ["None"]


def check(df, **options):
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").distinct().collect()]
    k = options.get("k", 20)
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    got = {}
    for r in sorted(nearest(df, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [(i, v) for i, v in good if i % 20 == 0]
    assert set(got) <= {i for i, _ in asked}
    hits = total = 0
    for i, v in asked:
        with np.errstate(over="ignore"):
            s = (x * v).sum(axis=1)
        want = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        mine = got.get(i, [])
        if options.get("factor") == 1.0:
            assert [m[0] for m in mine] == [w[0] for w in want]
            assert [m[1] for m in mine] == pytest.approx([w[1] for w in want], rel=1e-12)
        hits, total = hits + len({w[0] for w in want} & {m[0] for m in mine}), total + len(want)
    return hits / max(1, total)


@pytest.mark.parametrize("factor", [1.0, 0.9])
def test_vectors_of_extreme_length(spark, factor):
    """One outlier, or lengths over many powers of ten, cost no result and no order."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    x[0], x[20], x[33], x[40], x[41] = [1e160, 1, 1], [1e30, 1e-30, 1], [-1e200, 1e200, 0], [1e-300, 1e-308, 0], [1e200, 1e199, -3]
    x[100:200] *= 10.0 ** rng.integers(-20, 20, (100, 1))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert check(df, shard=60, block=10, factor=factor) >= (1.0 if factor == 1 else 0.9)


def test_shards_of_equal_distances_and_clashing_names(spark):
    """Rings can't part vectors that are equally far from all centres; other columns, and repeated rows, don't matter."""
    import itertools

    signs = list(itertools.product([-1.0, 1.0], repeat=9))
    df = spark.createDataFrame([(i, list(v), i, 0.5, [1.0]) for i, v in enumerate(signs * 2)], "vec_id long, embedding array<double>, query_id long, score double, v array<double>")
    assert check(df.unionByName(df.limit(50)), shard=20, block=7, factor=1.0) == 1.0
    named = df.select(F.col("vec_id").alias("a b"), F.col("embedding").alias("c`d"))
    assert nearest(named, id_col="a b", vector_col="c`d").count() == nearest(df).count()


def test_exact_search_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.integers(-1, 2, (400, 4)))]
    rows += [(None, [1.0] * 4), (700, None), (720, [0.0] * 4), (740, [float("nan"), 1.0, 1.0, 1.0]), (760, [1.0, None, 0.0, 0.0]), (780, [])]
    assert check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=50, block=8, factor=1.0) == 1.0


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    clustered = centres[rng.integers(0, 20, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    for x in (clustered, rng.normal(size=(1500, 16))):
        df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        assert check(df, shard=300) >= 0.95
    assert nearest(df.limit(0)).count() == 0
    few = df.where("vec_id < 4")
    assert [(r.query_id, r["rank"]) for r in nearest(few).orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]


def test_a_common_vector(spark):
    """A vector that most rows share: the smallest ids of its copies are returned."""
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.col("id") / 300.0)).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    assert check(df, shard=40, factor=1.0) == 1.0
