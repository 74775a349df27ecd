"""Near duplicates of texts and vectors, shards and url rules against brute force."""

import random
import zlib

import numpy as np
import pytest
from kit import documents, empty, odd_rows, same, words
from pyspark.sql import functions as F

from tickstate.llm import common, embedding_dedup, near_dedup, sharding, url_filter


def smallest_reachable(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(500, 501), (501, 502), (502, 500), (7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "a long, b long"), 300).collect()
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = smallest_reachable({n for e in real for n in e}, real)
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long"), 0).count() == 0


# ---- texts

def shingle_set(text, n):
    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    split = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(table)) if w]
    if len(split) < n:
        return {tuple(split)} if split else set()
    return {tuple(split[i : i + n]) for i in range(len(split) - n + 1)}


def families(seed):
    """Families of copies at several distances, some right at the threshold."""
    rng = random.Random(seed)
    rows, d = [], 100
    for f in range(25):
        base = words(1000 + seed * 100 + f, rng.choice([3, 4, 6, 9, 20, 60, 300]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = "new" + str(rng.random())[2:6]
            rows.append((d, " ".join(copy), None, None, None))
            d += 1
    return rows


@pytest.mark.parametrize("n,percent,blocks", [(3, 85, False), (5, 80, False), (3, 85, True)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, percent, blocks):
    if blocks:  # as if buckets and clusters were too big for one block
        monkeypatch.setattr(near_dedup, "BUCKET_DOCS", 3)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    rows = families(n + percent) + [r for r in odd_rows() if r[0] != 0] + [odd_rows()[0]] * 2
    got = near_dedup.near_duplicates(documents(spark, rows), words=n, percent=percent).collect()
    assert len(got) == len(rows)
    sets = {d: shingle_set(t, n) for d, t, *_ in rows if d is not None}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    label = smallest_reachable(ids, links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id]), r.doc_id
            assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, np.iinfo(np.uint64).max, n, dtype=np.uint64) for n in (8000, 1000, 1000))
    (ra, fa), (rb, fb) = (near_dedup.registers(np.unique(np.concatenate((both, x)))) for x in (a, b))
    assert fa.all() and fb.all() and abs((ra == rb).mean() - 0.8) < 0.12
    tiny = near_dedup.registers(np.unique(a[:3]))
    assert tiny[1].sum() <= 3 and (tiny[0] != near_dedup._EMPTY).all()


# ---- vectors

def vectors(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(8)
            for _ in range(int(rng.choice([1, 2, 6]))):
                rows.append((i, [float(np.float32(x)) for x in base + rng.standard_normal(8) * 0.12], label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 1), (i + 2, [2 * x for x in rows[0][1]], 0)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] * 4, 0), (903, [float("nan")] * 8, 0),
             (904, [float("inf")] * 8, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0), (None, rows[0][1], 5)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit(1))


@pytest.mark.parametrize("bucket,recall", [(embedding_dedup.BUCKET_ROWS, 0.9999), (2, 0.9999), (2, 0.2)])
def test_vector_links_equal_brute_force(spark, monkeypatch, bucket, recall):
    """Also with few tables and blocks of a few rows, so that the exact way finds most links."""
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", bucket)
    if bucket == 2:
        monkeypatch.setattr(embedding_dedup, "_SMALL", 1)
        monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(embedding_dedup, "_CELLS", 64)
    rows, df = vectors(spark)
    got = embedding_dedup.near_duplicate_vectors(df, recall=recall).collect()
    assert len(got) == len(rows)
    good = {
        i: (label, np.array(e)) for i, e, label in rows
        if i is not None and label is not None and e and None not in e and np.isfinite(e).all() and any(e)
    }
    links = [
        (a, b) for a, (la, x) in good.items() for b, (lb, y) in good.items()
        if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93
    ]
    label = smallest_reachable([i for i, *_ in rows if i is not None], links)
    for r in got:
        if r.vec_id is not None:
            n = sum(r.vec_id in link for link in links)
            assert (r.n_links, r.component_id, r.kept) == (n, label[r.vec_id], r.vec_id == label[r.vec_id])
        else:
            assert r.component_id is None and r.kept
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_hash_recall(spark):
    """Recall at cosines just above the threshold, over all pairs."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        x = rng.standard_normal(32)
        y = rng.standard_normal(32)
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = rng.uniform(0.931, 0.95)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    hashed = embedding_dedup.near_duplicate_vectors(df, complete=False).where("n_links > 0").count()
    assert hashed >= 0.99 * len(rows)
    assert embedding_dedup.near_duplicate_vectors(df).where("n_links > 0").count() == len(rows)


# ---- shards

def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(6)
    rows = odd_rows() + [(100 + i, " ".join(words(i, rng.randint(1, 200))), None, None, None) for i in range(1500)]
    rows += [(5000 + i, "the same text again", None, None, None) for i in range(900)]   # a hot text
    rows += [(9000 + i, f"pair {i // 3}", None, None, None) for i in range(300)]
    got = sharding.shards(documents(spark, rows), 8, carry=("text", "lang")).collect()
    same(
        [(r.doc_id, r.size, r.text_crc32, r.row.text) for r in got],
        [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), t) for d, t, *_ in rows],
    )
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    homes = {}
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= largest + total / 8 / 100
    for r in got:
        if (r.row.text or "").startswith("pair"):
            homes.setdefault(r.row.text, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shards(empty(spark), 8).count() == 0
    assert {r.shard for r in sharding.shards(documents(spark, rows[:1]), 8).collect()} <= set(range(8))


def test_shard_files(spark):
    path = common.work_path(spark, "shards")
    sharding.write_shards(sharding.shards(documents(spark), 3, carry=("text",)), path)
    back = spark.read.parquet(path)
    assert back.count() == len(odd_rows()) and back.select("shard").distinct().count() <= 3


# ---- urls

def verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(r), v == "block", r) for v, r in rules
        for h, _, p in [r.partition("/")]
        if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(r[len(h):])
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], ("block" if best[1] else "allow") if best else "allow"


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(7)
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
             ("block", "Example.org"), ("allow", "example.org/fr"), ("block", "a.example.net/en/x/y"), ("allow", "a.example.net/en/x/y")]
    host = lambda: ".".join(rng.choices(["a", "EXAMPLE", "example", "net", "com", "org", "İ", ""], k=rng.randint(1, 4)))
    path = lambda: "/".join(rng.choices(["", "en", "de", "fr", "frx", "x", "y"], k=rng.randint(0, 5)))
    urls = [f"http://{host()}{rng.choice(['', '/', '?', '#', ':80/'])}{path()}{rng.choice(['', '?q=/en/', '#a?b'])}" for _ in range(1500)]
    urls += ["http://Example.NET/en/", "https://example.net", "x", None, "", "://", "a://b://c/d", "http://net/", "http://.net/", "http://xnet/", "http://a.example.net/en/x/yz", "h://n" + "/x" * 20_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(3))
    got = url_filter.judge_urls(df, rules).collect()
    want = [(i, *verdict(u, rules)) for i, u in enumerate(urls)]
    same([tuple(r) for r in got], want)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.UrlTrie([("deny", "a/")])
