"""Phrases, merkle manifests and web archives against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from kit import CLASHING, documents, empty, odd_rows, same
from pyspark.sql import functions as F

from tickstate.llm import merkle, phrases, warc
from tickstate.llm.common import work_path

# ---- phrases ----------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def pieces(text):
    for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
        yield [w for w in re.split(r"[ \t]+", piece) if w]


def best_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[(lang or "und", *words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        if len(w) == 2 and any(
            len(t) == 4 and t[0] == lang and tuple(w) in (t[1:3], t[2:4]) and 100 * b >= 50 * a for t, b in found.items()
        ):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
        for lang, rows in out.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])
    ]


def phrase_rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "New", "york", "CITY", "a", "é", "ñandú", "x" * 300, "　wide", "\xa0", "0"]
    rows = []
    for d in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ! "]) for _ in range(80))
        rows.append((d, text + " new york city hall" * (d % 3), rng.choice(["en", "fr", None, "und"]), "s", 1))
    return rows + odd_rows() + [(None, "the the the the", "en", "s", 1)] * 3


def test_phrases(spark):
    rows = phrase_rows()
    want = best_phrases([(r[2], r[1]) for r in rows], 4, 40)
    got = [tuple(r) for r in phrases.collocations(documents(spark, rows), least=4, top=40).collect()]
    same(got, want)
    assert phrases.collocations(empty(spark)).count() == 0


def test_phrases_of_a_hot_pair(spark, monkeypatch):
    """Pairs that are routed by their third word have the same counts."""
    monkeypatch.setattr(phrases, "hot_pairs", lambda pairs, size: np.sort(pair))
    rows = [(i, f"very hot w{i % 7} w{i % 11}, cold day", "en", "s", 1) for i in range(200)]
    words = phrases.Words(pa.array(["very hot"]))
    routes = phrases.Routes("en", words.vocabulary)
    pair = routes.pair(words.ids[:1], words.ids[1:])
    monkeypatch.setattr(phrases, "PART_BYTES", 1000)
    got = [tuple(r) for r in phrases.collocations(documents(spark, rows), least=10, top=100).collect()]
    same(got, best_phrases([("en", r[1]) for r in rows], 10, 100))


def test_quicksort(monkeypatch):
    """Equal parts of the recursion and the joint finish agree with plain counting."""
    monkeypatch.setattr(phrases, "SMALL", 16)
    rng = np.random.default_rng(1)
    symbols = [rng.zipf(1.3, 5000).clip(max=50).astype(np.int32) for _ in range(3)]
    weights = rng.integers(1, 5, 5000)
    at, sums = phrases.suffix_groups(symbols, np.arange(5000), weights)
    want = Counter()
    for i in range(5000):
        want[tuple(s[i] for s in symbols)] += int(weights[i])
    assert {tuple(s[a] for s in symbols): int(n) for a, n in zip(at, sums)} == want and len(at) == len(want)
    at, sums = phrases.suffix_groups(symbols, np.arange(5000), weights, least=60)
    assert all(want[tuple(s[a] for s in symbols)] == n for a, n in zip(at, sums))
    assert {k for k, v in want.items() if v >= 60} <= {tuple(s[a] for s in symbols) for a in at}


# ---- manifests --------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, i):
    beside = []
    while len(nodes) > 1:
        run, at = nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        beside.append((run[:at], run[at + 1 :]))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        i //= 16
    return nodes[0], beside


def expected_manifest(rows, tamper):
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        bad = leaf_of((doc, source, lang, n, text and lower(text))) if tamper(doc) else None
        groups[source].append(((doc is not None, doc or 0, leaf_of((doc, source, lang, n, text))), doc, bad))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = {g: climb([x[0][2] for x in sorted(groups[g], key=lambda x: x[0])], 0)[0] for g in order}
    root = climb([subroots[g] for g in order], 0)[0] if order else None
    for g in order:
        leaves = sorted(groups[g], key=lambda x: x[0])
        above = climb([subroots[o] for o in order], order.index(g))[1]
        for i, (k, doc, bad) in enumerate(leaves):
            path = climb([x[0][2] for x in leaves], i)[1] + above
            at = bad or k[2]
            for left, right in path:
                at = sha("".join([*left, at, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            yield doc, k[2], subroots[g], root, proof, at, at == root


def manifest_rows():
    rng = random.Random(3)
    rows = []
    for d in range(700):
        key = rng.choice([d, d * 65_537, -d, d << 40, (1 << 63) - 1 - d, -(1 << 63) + d])
        rows.append((key, f"Text {d} ÄB", "en", rng.choice(["a", "a", "b", "", None, "é"]), d))
    rows += [(5, "Same", "en", "hot", 4)] * 300 + [(5, f"T{i}", "en", "hot", 2) for i in range(40)]
    rows += [(9, "Lone", None, f"lone{i}", 4) for i in range(40)] + [(None, "No key", "fr", "a", 6)] * 3
    return rows + odd_rows()


@pytest.mark.parametrize("make", [manifest_rows, lambda: manifest_rows()[:1], lambda: odd_rows()[:3]])
def test_manifest(spark, make):
    rows = make()
    chosen = F.col("doc_id") % 3 == 0
    docs = documents(spark, rows)
    manifest = merkle.build_manifest(docs, tampered=F.when(chosen, merkle.leaf(text=merkle.lower_cased())))
    got = merkle.proofs(manifest, "tampered").select(
        "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    want = list(expected_manifest(rows, lambda d: d is not None and d % 3 == 0))
    same([tuple(r) for r in got.collect()], want)


def test_manifest_of_nothing(spark):
    manifest = merkle.build_manifest(empty(spark))
    assert manifest.root is None and merkle.proofs(manifest).count() == 0


def test_ranks(spark):
    """Slots are the places of a sort by key, whatever the keys are."""
    rows = sorted({(r[3] or "", r[0]) for r in manifest_rows() if r[0] is not None})
    keyed = spark.createDataFrame([(g, k, str(k)) for g, k in rows], "g string, key long, digest string")
    placed = merkle.with_slots(keyed, merkle.rank_directory(keyed)).collect()
    seen = Counter()
    for g, k in rows:
        place = next(r for r in placed if (r.g, r.key) == (g, k))
        assert place.slot == seen[g]
        seen[g] += 1


# ---- web archives -----------------------------------------------------------


def page_rows():
    rng = random.Random(7)
    big, other = "<p>é" + "x" * 2000, "<b>" + "y" * 999
    rows = [(i, f"http://h{i}/a b", rng.choice([big, other, "short", "", None, f"{i}" * 900])) for i in range(120)]
    rows += [(7, None, big), (7, "http://h7/\r\nX: y", big), (None, "u", big), (None, None, "z" * 1500), (None, None, "z" * 1500)]
    return rows + [(500, "http://long/", "l" * 3_000_000), (501, "http://long/", "l" * 3_000_000), (502, "u", "s" * 1000)]


def test_archive(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages = pages.select("*", *[F.lit(1).alias(c) for c in CLASHING])
    path = work_path(spark, "pages")
    pages.write.parquet(f"{path}/table")
    pages = spark.read.parquet(f"{path}/table")
    warc.write_archive(pages, path)
    records = warc.with_referred_page(warc.read_archive(spark, path), spark, path).collect()
    assert len(records) == len(rows) and len({r.record_id for r in records}) == len(rows)
    by_payload = defaultdict(list)
    for page, _, html in rows:
        by_payload[(html or "").encode()].append(page)
    want, got = Counter(), Counter()
    for payload, pages_of in by_payload.items():
        order = sorted(pages_of, key=lambda p: (p is not None, p or 0))
        revisits = order[:-1] if len(payload) >= 1000 else []
        digest = hashlib.sha1(payload).hexdigest()
        want.update((p, len(payload), digest, "revisit", order[-1], None) for p in revisits)
        want.update((p, len(payload), digest, "response", None, payload) for p in order[len(revisits) :])
    got.update(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload))
        if r.record_type == "revisit" else
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in records
    )
    assert got == want
    assert all("\n" not in (r.url or "") for r in records)
    wanted = spark.createDataFrame([(r.record_id,) for r in records[::7]], "record_id string")
    found = warc.find_records(spark, path, wanted).collect()
    assert {(r.record_id, r.bundle, r.frame, r.offset) for r in found} == {
        (r.record_id, r.bundle, r.frame, r.offset) for r in records[::7]
    }


def test_bundles_are_plain_zstd(spark, tmp_path):
    """Any Zstandard reader gives the records of all frames; a damaged frame is noticed."""
    zstandard = pytest.importorskip("zstandard")
    writer = warc.BundleWriter(f"{tmp_path}/b.warc.zst")
    records = [warc.record(i, "http://a/", b"p" * 300_000, i, None, "1970-01-01T00:00:00Z")[2] for i in range(9)]
    places = [writer.add(r) for r in records]
    writer.close()
    with open(f"{tmp_path}/b.warc.zst", "rb") as file:
        data = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert data == b"".join(records)
    reader = warc.BundleReader(f"{tmp_path}/b.warc.zst")
    for (frame, offset), record in zip(places, records):
        assert reader.frame(frame)[offset : offset + len(record)] == record
    assert places[-1][0] == 2
    head, block, _ = warc.parse_record(records[0], 0)
    assert base64.b32decode(head["warc-payload-digest"][5:]) == hashlib.sha1(b"p" * 300_000).digest()
    raw = bytearray(open(f"{tmp_path}/b.warc.zst", "rb").read())
    raw[40] ^= 1
    open(f"{tmp_path}/b.warc.zst", "wb").write(raw)
    with pytest.raises((ValueError, OSError)):
        warc.BundleReader(f"{tmp_path}/b.warc.zst").frame(0)


def test_archive_of_nothing(spark):
    path = work_path(spark, "none")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, path)
    assert warc.read_archive(spark, path).count() == 0
