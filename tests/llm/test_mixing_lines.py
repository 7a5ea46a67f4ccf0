import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tests.llm.fixtures import PROSE, TEXTS, documents, empty
from tidemark.llm import linefreq as L
from tidemark.llm import mixing as M


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def invert(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= mean / k
        total += p
    return k


def plain_copies(doc_id, rate, seed=M.SEED):
    parts = max(1, math.ceil(rate / M.PART_MEAN))
    key = "" if doc_id is None else doc_id
    return sum(invert(unit(seed, key, j), rate / parts) for j in range(1, parts + 1)) if rate > 0 else 0


def plain_rates(texts, sources, weights=None, temperature=M.TEMPERATURE):
    size = Counter()
    for t, s in zip(texts, sources):
        size[s or ""] += max(len(t or ""), 1)
    w = {s: size[s] ** temperature if weights is None else weights.get(s, 0.0) for s in size}
    return {s: w[s] / sum(w.values()) * sum(size.values()) / size[s] if sum(w.values()) else 0 for s in size}


@pytest.mark.parametrize("weights", [None, {"src0": 5.0, "src1": 1.0}, {"": 700.0, "src2": 1.0}, {}])
def test_copies(spark, weights):
    docs = documents(spark)
    sources = [None if n % 5 == 0 else f"src{n % 3}" for n in range(len(TEXTS))]
    rates = plain_rates([t for _, t in TEXTS], sources, weights)
    want = Counter()
    for (i, t), s in zip(TEXTS, sources):
        n = plain_copies(i, rates[s or ""])
        want.update({(i, t, c): 1 for c in range(1, n + 1)} if (i, t) != TEXTS[11] else Counter((i, t, c) for c in range(1, n + 1)))
    out = M.mix_sources(docs, weights)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]
    assert Counter((r["doc_id"], r["text"], r["copy"]) for r in out.collect()) == want


def test_large_rates_and_salted_join(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    docs = documents(spark, [(i, "x" * 10) for i in range(40)], extra=False).selectExpr("doc_id", "text", "IF(doc_id < 38, 'big', 'rare') AS source")
    rates = plain_rates(["x" * 10] * 40, ["big"] * 38 + ["rare"] * 2, {"rare": 99.0, "big": 1.0}, None)
    out = M.mix_sources(docs, {"rare": 99.0, "big": 1.0}, epochs=30.0).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {i: n for i in range(40) if (n := plain_copies(i, rates["big" if i < 38 else "rare"] * 30))}
    assert rates["rare"] * 30 > 2 * M.PART_MEAN


def test_poisson_moments(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'abcde' AS text", "'s' AS source")
    counts = Counter(r["count"] for r in M.mix_sources(docs, epochs=1.7).groupBy("doc_id").count().collect())
    total = sum(k * n for k, n in counts.items())
    assert abs(total / 20_000 - 1.7) < 0.04
    assert abs(sum(k * k * n for k, n in counts.items()) / 20_000 - 1.7**2 - 1.7) < 0.15


def test_mixing_nothing(spark):
    assert M.mix_sources(empty(spark)).count() == 0


def view(spark_df, sql):
    con = duckdb.connect()
    documents = spark_df.select("doc_id", "text", "lang", "source", "n_chars").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang, source::VARCHAR AS source, n_chars FROM documents")
    return con.execute(sql).fetchdf()


def test_mixing_sql_on_awkward_rows(spark):
    docs = documents(spark, [x for x in TEXTS if x[0] != 11], extra=False)
    assert same_rows(M.mix_sources(docs), view(docs, M.MIX_SQL))


LINES = [(i, f"{PROSE}\nSubscribe  to our NEWSLETTER {i + 10}!\n{PROSE[::-1]} {i * 7919}\n" + " ".join(f"w{'abcdefghij'[i % 10]}{'klm'[i // 10]}{'pqrstuvwxyz'[k % 11]}{'abcdef'[k // 11]}" for k in range(60))) for i in range(30)]


def test_frequent_lines(spark):
    """Thirty documents of one host share lines, one of them up to case, spaces and digits."""
    docs = documents(spark, LINES, extra=False).selectExpr("doc_id", "text", "lang", "'h' AS source", "n_chars")
    rows = {r["doc_id"]: r for r in L.quality_digest(docs).collect()}
    shared = len(PROSE.split()) + 5
    for i, _ in LINES:
        assert rows[i]["removed_words"] >= shared and rows[i]["kept"]
    few = {r["doc_id"]: r for r in L.quality_digest(docs.where("doc_id < 10")).collect()}
    assert all(r["removed_words"] == 0 for r in few.values())


def test_depleted_documents_and_copies(spark):
    shared = "\n".join(" ".join(f"{chr(97 + k)}{j}" for j in range(12)) for k in range(20))
    texts = [(i, shared + f"\nown line {chr(97 + i)} {chr(98 + i)}") for i in range(14)] + [(100 + i, PROSE + PROSE[::-1] + "q " * 30 + " ".join(f"u{k}" for k in range(50))) for i in range(50)]
    docs = documents(spark, texts, extra=False).selectExpr("doc_id", "text", "lang", "'h' AS source", "n_chars")
    rows = {r["doc_id"]: r for r in L.quality_digest(docs).collect()}
    assert not any(rows[i]["kept"] or rows[i]["base_failed"] for i in range(14))
    # Fifty exact copies are one document, so none of their lines is frequent.
    assert all(rows[100 + i]["removed_words"] == 0 for i in range(50))


@pytest.mark.parametrize("salted", [False, True])
def test_lines_sql_on_awkward_rows(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    docs = documents(spark, TEXTS + [(200 + i, t) for i, t in LINES] + [(300, "a b c a b c a b"), (301, "#*$%&|<> x\nx\nx\n\n y"), (302, "a b c")], extra=False)
    assert same_rows(L.quality_digest(docs), view(docs, L.QUALITY_SQL))
    assert L.quality_digest(empty(spark)).count() == 0


def test_repeated_windows():
    assert L.repeated_window_words(b"a b c a b c".split()) == 6
    assert L.repeated_window_words(b"a b c d a b x".split()) == 0
    assert L.repeated_window_words(b"a a a a".split()) == 4
    assert L.repeated_window_words(b"x a b c y a b c z".split()) == 6


def test_lines_are_removed(spark, monkeypatch):
    """The texts returned lack the frequent lines and nothing else; the words gone are those that the verdicts count."""
    rows = [(n, f"unique words of number {'x' * n} stay here\n  Shared LINE 12 of all\n\nand a tail") for n in range(80)] + [(140, None), (141, ""), (5, "Shared line 99 of all"), (None, "shared line 34 of all\nown"), (142, "shared line 12 of all\n" * 50_000)]
    docs = documents(spark, rows)
    out = L.remove_frequent_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    verdicts = {}
    for r in L.quality_verdicts(docs).collect():
        verdicts.setdefault(r["doc_id"], []).append(r["n_words"] - r["removed_words"])
    for i in verdicts:
        assert sorted(len((t or "").split()) for t in texts[i]) == sorted(verdicts[i])
    assert any("Shared LINE" not in texts[n][0] for n in range(80)) and all("unique words" in texts[n][0] for n in range(80) if n != 5)
    assert texts[140] == [None] and texts[141] == [""]
    monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    assert sorted(map(str, (r["text"] for r in L.remove_frequent_lines(docs).collect()))) == sorted(str(t) for ts in texts.values() for t in ts)
    assert L.remove_frequent_lines(empty(spark)).count() == 0


def test_copies_count_if_asked(spark):
    """A line of twenty equal documents is one document's, unless copies count."""
    docs = spark.createDataFrame([(n, "the same line\nand words", "h") for n in range(20)], "doc_id long, text string, source string")
    assert {r["removed_words"] for r in L.quality_verdicts(docs).collect()} == {0}
    assert {r["removed_words"] for r in L.quality_verdicts(docs, copies=True).collect()} == {5}


def test_rows_without_id_are_dealt_apart(spark):
    """One shuffle key for rows of null id, but not one partition."""
    docs = spark.createDataFrame([(None, f"text {n}", "s") for n in range(400)], "doc_id long, text string, source string")
    out = M.mix_sources(docs)
    parts = out.groupBy(F.spark_partition_id()).count().count()
    assert parts > 1 or out.count() == 0
