import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import CLASHING, TEXTS, documents, empty
from tidemark.llm import prefixtrie, tokenfiles, whitening
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")


# The prefix trie.


def brute_trie(rows):
    """The nodes of (conv_id, turn, role, text), by definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = (len(members[key]) - 1) * words + sum(saved[k] for k in children[key])
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(key))
        out.append((m[0], len(key), members[key[:-1]][0] if key else None, len(m), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def conversations(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit(-1).alias(c) for c in CLASHING)) if extra else df


def test_trie_of_the_table(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    assert trie_rows(QUERIES["op11_conversation_prefix_trie"](spark, sf_dir)) == brute_trie([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_awkward_rows(spark):
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 3}") for c in range(45) for t in range(c % 7)]
    rows += [(20, None, "user", "null turn"), (40, 1, None, None), (40, 1, None, None), (40, 1, "", ""), (None, 1, "user", "no conversation"), (-3, 0, "a", "b c"), (-23, 0, "a", "b c"), (61, 0, "user", " \t\n"), (63, 5, "r", "x " * 50_000)]
    rows += [(100 + k, 0, "user", "same first turn") for k in range(300)] + [(500, t, "user", "again") for t in range(900)] + [(501, t, "user", "again") for t in range(700)]
    for at, expected in ((1, "12:"), (11, "2:")):
        rows += [(70, at, expected[:-1], "text"), (71, at, expected, "text")]
    assert trie_rows(prefixtrie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_without_rebuilt_turns_and_without_rows(spark):
    lonely = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lonely, 0, "user", "gone")]
    assert trie_rows(prefixtrie.prefix_trie(conversations(spark, rows))) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())] == brute_trie(rows)
    assert trie_rows(prefixtrie.prefix_trie(conversations(spark, rows).limit(0))) == []


def test_numbers_of_turns_in_sampled_ranges(spark):
    """A conversation over several ranges, whose limits a small sample draws."""
    from tidemark.session import Scratch

    key, rows = "spark.sql.execution.rangeExchange.sampleSizePerPartition", [(c, t, "user", f"{c} {t}") for c, n in ((1, 700), (2, 3), (3, 900), (4, 40)) for t in range(n)]
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2")
        with Scratch(spark) as kept:
            turns = kept.store(prefixtrie.turn_digests(conversations(spark, rows).repartition(6)))
            got = {(r["conv_id"], r["nr"]): bytes(r["digest"]) for r in prefixtrie.numbered(turns, kept).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(c, t + 1): hashlib.sha256(f"4:{r}{x}".encode()).digest() for c, t, r, x in rows}


def test_ends_are_joined_over_ranges(spark):
    ids = sorted({k * 37 - 9000 for k in range(700)})
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(3, 4, 5)], "a long, b long, conv_id long")
    got = {r["a"]: r["ends_sha256"] for r in prefixtrie.end_digests(ends).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"5").hexdigest()}


# Token files.


def expected_tokens(rows):
    from tokenizers import Tokenizer

    model, out, start = Tokenizer.from_file(WORDS), [], 0
    for doc_id, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_words_are_encoded_as_the_library_does():
    own = tokenfiles.WordTokenizer(WORDS)
    assert own.find is not None
    for code in [*range(0x600), 0x130, *range(0x2000, 0x2060), 0x212A, 0x1E9E, 0xFB01, 0x1F600, 0xAC00]:
        c = chr(code)
        for text in (c, f"a{c}b", f"1{c}'s", f"Z{c}{c} {c}"):
            assert own.encode(text) == own.exact(text), (hex(code), text)
    for text in ("", "It's WE'LL 'Ve x", "é é", "a <|endoftext|> b<|startoftext|>", "don't-stop...now 123", "ǅ İi", "Σσς", "x" * 5000, "Привет, мир"):
        assert own.encode(text) == own.exact(text), text


def test_dictionaries_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokenfiles.Known, "ENTRIES", 10)
    own = tokenfiles.WordTokenizer(WORDS)
    for k in range(50):
        assert own.encode(f"word{k} other{k}") == own.exact(f"word{k} other{k}")
    assert len(own.known) == 10


def test_token_digest_of_the_table(spark, sf_dir):
    docs = sorted(tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in QUERIES["op12_orc_token_ids"](spark, sf_dir).collect()) == expected_tokens(docs)


def test_awkward_documents_as_tokens(spark):
    got = [tuple(r) for r in tokenfiles.token_digest(documents(spark), WORDS).collect()]
    order = sorted(((i is not None, i or 0), t or "") for i, t in TEXTS)
    assert sorted(got, key=lambda r: r[1]) == expected_tokens([(k[1] if k[0] else None, t) for k, t in order])
    assert tokenfiles.token_digest(empty(spark), WORDS).count() == 0


def test_files_have_stripes_that_are_read_apart_and_pruned(spark, tmp_path):
    from pathlib import Path

    from pyarrow import orc

    # Sparse ids, so that most lookups lie within a row group's range and only its Bloom filter rules it out.
    docs = spark.range(0, 40_000).select((F.col("id") * 10).alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512)).alias("text"))
    path = str(tmp_path / "tokens")
    tokenfiles.write_token_files(docs.coalesce(1), path, WORDS, stripe_bytes=1 << 20, group_rows=1000)
    files = sorted(Path(path, "ids").glob("*.orc"))
    stripes = [orc.ORCFile(f).nstripes for f in files]
    assert max(stripes) > 1
    at = -1
    for f in files:  # ascending within and between files
        ids = orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids[0] > at
        at = ids[-1]
    every = tokenfiles.read_token_files(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
        busy = every.select("doc_id", F.spark_partition_id().alias("p")).groupBy("p").count().count()
        assert busy > len(files)
        assert every.agg(F.count("*"), F.sum("n_tokens")).first() == (40_000, sum(r["n_tokens"] for r in every.select("n_tokens").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    def scanned(wanted):
        raw = spark.read.schema(tokenfiles.FILE_SCHEMA).orc(f"{path}/ids").where(F.col("doc_id").isin(wanted))
        raw.collect()
        return tokenfiles.read_token_files(spark, path, wanted).collect(), raw._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    rows, read = scanned([123_450])
    assert [r["doc_id"] for r in rows] == [123_450] and read <= 2000
    rows, read = scanned([123_451])  # in a row group's range, in no row
    assert rows == [] and read == 0
    assert rows == [] and every.where("doc_id = 123450").first()["start"] == every.where("doc_id < 123450").agg(F.sum("n_tokens")).first()[0]


# Whitening.


def vectors(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    return df.select("*", *(F.lit(-1).alias(c) for c in CLASHING if c != "n"), F.lit(1).alias("n"))


def check_whitening(got, rows, k=8):
    """got against NumPy's own eigenvectors of the covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    dims = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in kept], np.int64)
    n, s = len(x), x.sum(axis=0)
    far = ((n * x - s).astype(object) ** 2).sum(axis=1)
    z = (n * x - s) / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    k = min(k, dims, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == n * k
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    white = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i, _ in kept])
    own = (z @ vecs[:, :k]) / np.sqrt(values[:k])
    signs = np.sign((white * own).sum(axis=0))
    gaps = np.abs(white - own * signs).max(axis=0)
    assert (gaps < 1e-6).all(), gaps
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-6
    for (i, _), f in zip(kept, far):
        for c in range(k):
            r = by[i][c + 1]
            assert r["n"] == n and r["deviation"] == f and r["identity_error"] < 1e-6
            assert abs(r["explained"] - values[c] / np.trace(z.T @ z / n)) <= 1e-6 * r["explained"]


def test_whitening_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    check_whitening(QUERIES["op13_embedding_whitening"](spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("decay,width", [(0.5, 16), (0.97, 40)])
def test_block_grows_only_if_residuals_stay(spark, decay, width):
    """A steep spectrum is found within the first block, a flat one needs all dimensions."""
    random = np.random.default_rng(5)
    x = random.standard_normal((600, 40)) * decay ** np.arange(40) * 100 @ np.linalg.qr(random.standard_normal((40, 40)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    kept = whitening.valid_vectors(vectors(spark, rows))
    fit = whitening.fit_whitening(kept)
    assert fit.directions == width if width == 40 else fit.directions < 40
    assert fit.passes > 1
    check_whitening(whitening.whitening_digest(vectors(spark, rows)).collect(), rows)


def test_awkward_vectors(spark):
    random = np.random.default_rng(6)
    rows = [(i, [float(c) for c in random.standard_normal(5 - i % 2)]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0]), (103, [float("inf")]), (104, [])]
    check_whitening(whitening.whitening_digest(vectors(spark, rows + odd)).collect(), rows + [(104, [])])
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        got = whitening.whitening_digest(vectors(spark, few))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_repeated_vectors_and_large_entries(spark):
    rows = [(7, [0.0, 0.0]), (7, [0.0, 0.0]), (None, [3e30, 1.0]), (8, [-3e30, 2.0]), (9, [5.0, 3.0])]
    got = whitening.whitening_digest(vectors(spark, rows)).collect()
    # Beside entries of 2^48 the second dimension is rounding, so one component is left.
    assert len(got) == 5 and sum(r["deviation"] is None for r in got) == 2
    assert all(np.isfinite(r["whitened"]) for r in got)


def test_sums_are_exact():
    x = np.array([[1 << 48, 3], [1 - (1 << 48), 4]], np.int64)
    sums = np.array([1, 7], object)
    assert whitening.squares(x, 2, sums) == [(2 * (1 << 48) - 1) ** 2 + 1, (2 - (1 << 49) - 1) ** 2 + 1]
    assert whitening.deviations(x, 1 << 40, sums).dtype == object
