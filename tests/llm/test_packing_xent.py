import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import TEXTS, documents, empty
from tidemark.llm import packing as P
from tidemark.llm import xent as X
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_the_file(model):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "a", "é", "ß", "123", "!", "#$", " ", "　", "中", "😀", "the", "\x1c", "\x85", "​", "<|endoftext|>", "ing ", "Ω", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(3000)] + [t or "" for _, t in TEXTS] + ["a" * 20_000, " " * 5_000]
    fast = P.FileTokenizer(tokenizer_path())
    assert fast.ranked is not None
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in fast.ids(texts)] == want
    fast.ranked = None
    assert [x.tolist() for x in fast.ids(texts)] == want


def test_added_tokens_and_megabytes(model):
    """Strings of added tokens are those tokens; a text of megabytes has the file's ids."""
    fast = P.FileTokenizer(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", ("Some words, 12 of them.\n" * 100_000)]
    assert [x.tolist() for x in fast.ids(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in fast.ids(texts)[0].tolist()


def test_other_files_have_no_ranks():
    import public_tokenizers

    assert P.byte_ranks(public_tokenizers.path("word_bpe_49k.json")) is None


def check_pieces(rows, docs, model, capacity=1024):
    ids = {}
    for i, t in docs:
        ids.setdefault(i, Counter())[tuple(model.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        want = Counter()
        for doc, n in ids[i].items():
            seen = {(r["start"], r["length"]) for r in own if r["doc_tokens"] == len(doc)}
            cover = sorted(seen)
            assert cover[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(cover, cover[1:])) and sum(cover[-1]) == len(doc)
            for s, m in seen:
                want[s, m, zlib.crc32(np.array(doc[s : s + m], "<u4").tobytes()), len(doc)] += n
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own) == want
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_seq


def test_packing(spark, model):
    rng = random.Random(6)
    docs = [*TEXTS, *((100 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(1, 3000)))) for i in range(120))]
    rows = P.pack_documents(documents(spark, docs), tokenizer_path()).collect()
    seqs = check_pieces(rows, docs, model)
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= total / 1024 * 1.03 + 2
    assert P.pack_documents(empty(spark), tokenizer_path()).count() == 0
    small = P.pack_documents(documents(spark, TEXTS[:4]), tokenizer_path(), capacity=64, grain=4)
    check_pieces(small.collect(), TEXTS[:4], model, 64)


def test_kept_ids(spark, model):
    rows = P.pack_documents(documents(spark, TEXTS[:5]), tokenizer_path(), keep_ids=True).collect()
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_rows_and_sequence_ids(spark, model):
    """Copies of a row are told apart, sequence ids have no gaps, and sequences of one long text don't follow one another."""
    docs = [(1, "one text " * 9000), *((2, "a copy") for _ in range(5)), *((10 + i, "filler words " * (i % 200)) for i in range(600))]
    rows = P.pack_documents(documents(spark, docs), tokenizer_path()).collect()
    seqs = check_pieces(rows, docs, model)
    assert sorted(seqs) == list(range(len(seqs)))
    by_row = {}
    for r in rows:
        by_row.setdefault(r["row"], []).append(r)
    assert len(by_row) == len(docs)
    for own in by_row.values():
        assert len({r["doc_id"] for r in own}) == 1 and sum(r["length"] for r in own) == own[0]["doc_tokens"]
    whole = sorted(r["sequence_id"] for r in rows if r["doc_id"] == 1 and r["length"] == 1024)
    assert len(whole) > 10 and not any(b == a + 1 for a, b in zip(whole, whole[1:]))
    mates = [sorted(r["doc_id"] for r in own) for own in seqs.values() if len(own) > 2]
    assert sum(b - a == 1 for own in mates for a, b in zip(own, own[1:])) < sum(len(own) - 1 for own in mates) / 2


def test_whole_sequences_are_not_shuffled(spark):
    docs = documents(spark, [(i, "one text " * 3000) for i in range(40)])
    packed = P.pack_documents(docs, tokenizer_path(), keep_ids=True)
    one = packed.where("length = 1024").select("doc_id", "start", "sequence_id", "ids")
    assert one.count() >= 40 and len({r[0] for r in one.select("sequence_id").collect()}) == one.count()
    lines = packed._jdf.queryExecution().sparkPlan().toString().splitlines()
    below = lines[next(i for i, x in enumerate(lines) if "Union" in x) + 1 :]
    # The last child of the union is the whole sequences' branch.
    last = max(i for i, x in enumerate(below) if x.lstrip(" :").startswith("+-") and x.index("+-") == min(y.index("+-") for y in below if "+-" in y))
    whole = "\n".join(below[last:])
    assert "Window" not in whole and "SortMergeJoin" not in whole and "BroadcastHashJoin" in whole and "Window" in "\n".join(below[:last])


@pytest.mark.parametrize("total", [0, 1, 2, 3, 4, 6, 30, 97, 1000, 30030])
def test_stride(total):
    step = P.stride(total)
    assert step >= 1 and sorted(i * step % total for i in range(total)) == list(range(total))


def test_stride_stays_within_a_long():
    for total in (10**9, 3 * 10**10, 2**40):
        assert math.gcd(P.stride(total), total) == 1 and P.stride(total) * (total - 1) < 1 << 63


def test_equal_lengths_spread_over_salts(spark, model):
    docs = [(i, "the same text") for i in range(3000)]
    seqs = check_pieces(P.pack_documents(documents(spark, docs), tokenizer_path()).collect(), docs, model)
    assert max(sum(r["length"] for r in s) for s in seqs.values()) > 1000


def test_cutting_stock():
    rng = random.Random(8)
    for _ in range(15):
        h = {rng.randrange(1, 257): rng.randrange(1, 2000) for _ in range(rng.randrange(1, 40))}
        sizes = np.array(sorted(h))
        used = P.cutting_stock(sizes, np.array([h[s] for s in sizes], float), 512)
        made = sum(p * n for p, n in used)
        assert (made == [h[s] for s in sizes]).all() and all((p * sizes).sum() <= 512 for p, _ in used)
        # Prices scaled by the best pattern's worth are feasible in the dual, so they bound any packing from below.
        demand = np.array([h[s] for s in sizes], float)
        _, _, prices = P.column_generation(sizes, demand, 512)
        worth, _ = P.best_pattern(sizes, np.maximum(prices, 0), 512)
        bound = (np.maximum(prices, 0) * demand).sum() / max(worth, 1)
        assert bound - 1e-6 <= sum(n for _, n in used) <= bound + len(h) + 1
    assert P.cutting_stock(np.array([], int), np.array([]), 512) == []


def test_knapsack():
    sizes, prices = np.array([3, 4, 5, 7]), np.array([0.3, 0.45, 0.5, 0.8])
    best = max((a * 0.3 + b * 0.45 + c * 0.5 + d * 0.8, (a, b, c, d)) for a in range(6) for b in range(5) for c in range(4) for d in range(3) if 3 * a + 4 * b + 5 * c + 7 * d <= 16)
    worth, pattern = P.best_pattern(sizes, prices, 16)
    assert abs(worth - best[0]) < 1e-9 and (pattern * sizes).sum() <= 16 and abs((pattern * prices).sum() - worth) < 1e-9


# Cross-entropy difference.
CORPUS = [(i, f"good words come here often {i % 7} tail" if i % 2 else f"bad stuff goes there rarely {i % 5} end") for i in range(60)]


def plain_scores(docs, good):
    """The definition, with dictionaries."""
    toks = [(i, (t or "").lower().encode().split()) for i, t in docs]
    vocab = {w for _, ws in toks for w in ws} | {None}
    tables = []
    for members in ([ws for i, ws in toks if i in good], [ws for _, ws in toks]):
        uni, bi = Counter(), Counter()
        for ws in members:
            if ws:
                uni.update([*ws, None])
                bi.update(zip(["<s>", *ws], [*ws, None]))
        tables.append((uni, bi, sum(uni.values()), sum(1 for ws in members if ws)))

    def p(table, u, v):
        uni, bi, total, texts = table
        if not total:
            return 1 / len(vocab)
        before = texts if u == "<s>" else uni[u]
        return X.BIGRAM * (bi[u, v] / before if before else uni[v] / total) + X.UNIGRAM * uni[v] / total + (1 - X.BIGRAM - X.UNIGRAM) / len(vocab)

    for t in tables:  # a probability for what follows any word
        assert all(abs(sum(p(t, u, v) for v in vocab) - 1) < 1e-9 for u in ["<s>", b"good", b"x" * 9])
    out = {}
    for i, ws in toks:
        loss = [-sum(np.log(p(t, u, v)) for u, v in zip(["<s>", *ws], [*ws, None])) if ws else 0.0 for t in tables]
        out.setdefault(i, []).append((len(ws), loss[0], loss[1], (loss[0] - loss[1]) / (len(ws) + 1)))
    return out


@pytest.mark.parametrize("good_ids, block_tokens", [([1, 3, 5, 7, 9, 11], 60), ([], 10**6)])
def test_scores_match_the_definition(spark, good_ids, block_tokens):
    docs = CORPUS + TEXTS
    labels = spark.createDataFrame([(i, 1) for i in good_ids] + [(2, 0), (None, 1), (4, None), (1, 0), (1, 1) if good_ids else (1, 0)], "doc_id long, quality int")
    frame = documents(spark, docs)
    got = {}
    for r in X.cross_entropy_difference(frame.repartition(3), labels, block_tokens).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = plain_scores(docs, set(good_ids))
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-5)
    if good_ids:
        mean = lambda k: np.mean([want[i][0][3] for i, _ in CORPUS if i % 2 == k and i > 12])
        assert mean(1) < mean(0)


def test_texts_of_megabytes_are_scored(spark):
    """One text of 1.6 million words among short ones, over blocks of which it is longer."""
    docs = [(1, "one two three four " * 400_000), (2, "one two"), (3, "five")]
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: tuple(r)[1:] for r in X.cross_entropy_difference(documents(spark, docs), labels, 1000).collect()}
    want = plain_scores(docs, {2})
    assert all(np.allclose(got[i], want[i][0], rtol=1e-6) for i in want)


def test_scores_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert X.cross_entropy_difference(empty(spark), labels).count() == 0


@pytest.mark.parametrize("bits, fan, finer", [(2, 2, 1), (3, 3, 4), (10, 2, 8)])
def test_sums_by_levels_are_the_same(spark, bits, fan, finer, monkeypatch):
    monkeypatch.setattr(X, "FINER_BITS", finer)
    monkeypatch.setattr(X.summed, "__defaults__", (fan, finer))
    labels = spark.createDataFrame([(i, 1) for i in (1, 3, 5)], "doc_id long, quality int")
    got = {}
    for r in X.cross_entropy_difference(documents(spark, CORPUS + TEXTS).repartition(5), labels, 25, bits, fan).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = plain_scores(CORPUS + TEXTS, {1, 3, 5})
    assert set(got) == set(want) and all(np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-5) for i in want)


def test_rows_moved_grow_with_the_input(spark, monkeypatch):
    """Thrice the blocks are about thrice the rows, however many levels there are."""
    rng = random.Random(12)
    moved = []
    for n in (60, 180):
        docs = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(40))) for i in range(n)]
        counted = []
        store = X.Scratch.store

        def seen(self, df, store=store, counted=counted):
            out = store(self, df)
            if "part" in out.columns:
                counted.append(out.count())
            return out

        monkeypatch.setattr(X.Scratch, "store", seen)
        labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
        assert X.cross_entropy_difference(documents(spark, docs, extra=False), labels, 200, 3, 4).count() == n
        monkeypatch.setattr(X.Scratch, "store", store)
        moved.append(sum(counted))
    assert moved[1] / moved[0] < 4.5, moved
