import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import TEXTS, documents, empty
from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components


def plain_fingerprint(text, k=4):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) * 2 > len(shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] and shingles)


def plain_components(prints, limit=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    texts = [t or "" for _, t in TEXTS]
    assert [f & (1 << 64) - 1 for f in S.fingerprints(texts, 4)] == [plain_fingerprint(t) for t in texts]


def test_blocks_do_not_matter(monkeypatch):
    want = S.fingerprints([t or "" for _, t in TEXTS], 4)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprints([t or "" for _, t in TEXTS], 4) == want


def test_query(spark):
    rows = S.component_digest(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    prints = [plain_fingerprint(t) for _, t in TEXTS]
    roots = plain_components(prints)
    want = []
    for (i, _), p, root in zip(TEXTS, prints, roots):
        ids = [d for (d, _), r in zip(TEXTS, roots) if r == root and d is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert S.component_digest(empty(spark)).count() == 0


def test_links_connect_like_all_pairs(spark):
    """Clusters of random fingerprints with flips up to and over the bound."""
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(6)):
            flipped = base
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                flipped ^= 1 << b
            prints.add(flipped)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    roots = plain_components(prints)
    links = S.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    groups = {}
    for p, r in zip(signed, roots):
        groups.setdefault(r, []).append(p)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}
    for r in links.collect():
        assert (r["a"] ^ r["b"] & (1 << 64) - 1).bit_count() <= 4 or ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4


def test_dense_group_is_a_star(spark):
    """All fingerprints within two bits of one: linked without all pairs."""
    points = [0] + [1 << b for b in range(62)]
    links = S.fingerprint_links(spark.createDataFrame([(p,) for p in points], "fp long"))
    assert links.count() < 62 * 61 / 4
    assert {r["root"] for r in connected_components(links).collect()} == {0}


def test_components(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0
    mixed = spark.createDataFrame([(5, 2), (2, 5), (9, 9), (-3, 7), (7, 8)], "a long, b long")
    assert {(r["node"], r["root"]) for r in connected_components(mixed).collect()} == {(2, 2), (5, 2), (-3, -3), (7, -3), (8, -3)}


def test_near_dedup(spark):
    docs = documents(spark)
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(t) for _, t in TEXTS]
    roots = plain_components(prints)
    assert kept.count() == len(set(roots))
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(11) == 1 and 12 not in ids and 1 not in ids and 0 in ids and ids.count(None) == 1
    assert S.near_dedup(empty(spark)).count() == 0


def plain_near(texts):
    """Roots over all pairs of a five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    roots = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = max(roots[i], roots[j]), min(roots[i], roots[j])
                roots = [new if r == old else r for r in roots]
    return roots


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def test_pipeline_stage_finds_all_near_copies(spark, monkeypatch):
    """Copies with edits down to and below a similarity of 0.8, a line that all texts share, and a dense group."""
    rng = random.Random(11)
    line = [f"boiler{i}" for i in range(12)]
    texts = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        texts += [" ".join(line + base)] + [" ".join(line + edited(rng, base, rng.randrange(1, 7))) for _ in range(4)]
    dense = [f"d{i}" for i in range(150)]
    texts += [" ".join(edited(rng, dense, rng.randrange(1, 5))) for _ in range(60)]
    want = set(plain_near(texts))
    frame = documents(spark, list(enumerate(texts)))
    stage = dict(pytest.importorskip("corpus_pipeline").STAGES)["simhash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, frame, "").collect()} == want
    monkeypatch.setattr(S, "SAMPLE", 1)
    assert {r["doc_id"] for r in S.drop_near_copies(frame).collect()} == want
    monkeypatch.setattr(S, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(S, "COMMON", 10**9)
    assert {r["doc_id"] for r in S.drop_near_copies(frame).collect()} == want


def test_pipeline_stage_goes_through_the_grid(spark, monkeypatch):
    """The stage's sets have SimHash fingerprints of five words; pairs within 4 bits are linked by the grid and by nothing else, the rest by their shingles."""
    rng = random.Random(13)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(100, 300))]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, n)) for n in (1, 1, 2, 5)] + [" ".join(base[1:])]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    prints = []
    for s in sets:
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    within = {(i, j) for i, j in alike if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert within and alike - within

    def left(pairs):
        roots = list(range(len(texts)))
        for i, j in pairs:
            old, new = max(roots[i], roots[j]), min(roots[i], roots[j])
            roots = [new if r == old else r for r in roots]
        return set(roots)

    seen, real = [], S.fingerprint_links

    def spied(points, *args, **kwargs):
        links = real(points, *args, **kwargs)
        seen.append(([r["sim"] for r in points.collect()], connected_components(links).collect()))
        return links

    frame = documents(spark, list(enumerate(texts)))
    stage = dict(pytest.importorskip("corpus_pipeline").STAGES)["simhash near-dedup"]
    monkeypatch.setattr(S, "fingerprint_links", spied)
    assert {r["doc_id"] for r in stage(spark, frame, "").collect()} == left(alike)
    (sims, found), = seen
    assert {p & (1 << 64) - 1 for p in sims} == set(prints)
    assert len({frozenset(s) for s in sets}) - len(found) + len({r["root"] for r in found}) == len(left(within | {(i, j) for i, j in alike if sets[i] == sets[j]}))
    monkeypatch.setattr(S, "fingerprint_links", lambda points, *_, **__: spark.createDataFrame([], "a long, b long"))
    assert {r["doc_id"] for r in stage(spark, frame, "").collect()} == left({(i, j) for i, j in alike - within} | {(i, j) for i, j in alike if sets[i] == sets[j]})


def test_unconfirmed_links_connect_nothing(spark):
    """Points within the bound of one another, some of one fingerprint, of which only those of one parity may be linked: heads of the other parity lose no link."""
    points = [(i, i % 7) for i in range(60)]
    odd = F.col("a") % 2 == F.col("b") % 2
    frame = spark.createDataFrame(points, "fp long, sim long")
    for dense in (256, 4):
        links = S.fingerprint_links(frame, dense=dense, confirm=lambda pairs: pairs.where(odd))
        assert {r["node"]: r["root"] for r in connected_components(links).collect()} == {i: i % 2 for i in range(60)}


def test_dense_cells_are_split_alike(spark):
    """Cells of more members than allowed are split by the other half; what is reachable stays the same. A chain and a group that no head holds together."""
    rng = random.Random(5)
    chain, at = [], 0
    for i in range(40):
        at ^= 0b1111 << 4 * (i % 16)
        chain.append(at)
    group = [(1 << 63) ^ sum(1 << b for b in rng.sample(range(24), 6)) for _ in range(300)]
    prints = sorted({*chain, *group})
    roots = plain_components(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for dense in (256, 4):
        links = S.fingerprint_links(frame, dense=dense)
        got = {r["node"]: r["root"] for r in connected_components(links).collect()}
        signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
        groups = {}
        for p, r in zip(signed, roots):
            groups.setdefault(r, set()).add(p)
        assert all({got.get(m, m) for m in members} == {min(members)} for members in groups.values())


def test_long_chains_and_stars(spark):
    """A chain of 20,000 in three orders and a star: every node meets the smallest, in about log(n) rounds."""
    n = 20_000
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    shuffled = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)], "a long, b long")
    up = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    down = up.select((n - 1 - F.col("a")).alias("a"), (n - 1 - F.col("b")).alias("b"))
    star = spark.range(n - 1).select(F.lit(n - 1).cast("long").alias("a"), F.col("id").alias("b"))
    for edges in (shuffled, up, down, star):
        found = connected_components(edges)
        assert found.count() == n and not found.where("root <> 0").take(1)
