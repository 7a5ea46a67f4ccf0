import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import CLASHING, PROSE, documents, empty
from tidemark.llm import pseudonyms as P
from tidemark.llm import toolcalls as C
from tidemark.llm import toxicity as T


# Tool calls.
SCHEMAS = {"sum": {"a": ("integer", True), "b": ("number", True), "note": ("string", False), "list": ("array", False)}}
CALLS = "conv_id long, place long, call_id string, name string, arguments string, after array<string>, declared boolean"


def linked(spark, calls, results=(), schemas=SCHEMAS):
    made = [(1, n, i, name, args, list(after), True) for n, (i, name, args, after) in enumerate(calls)]
    out = C.link_calls(spark.createDataFrame(made, CALLS), spark.createDataFrame(list(results), "call_id string, place long, content string"), schemas)
    return {r["call_id"]: r for r in out.collect()}


def test_arguments(spark):
    cases = {
        '{"a": 1, "b": 2.5}': "",
        '{"b": 2, "a": 1, "note": "x", "list": []}': "",
        '{"a": 1.5, "b": "2", "z": 1, "c": 2}': "type:a,type:b,unexpected:c,unexpected:z",
        '{"a": null}': "missing:a,missing:b",
        "[1]": "not_object",
        "{": "not_json",
        "": "not_json",
        None: "not_json",
    }
    rows = linked(spark, [(f"c{n}", "sum", a, []) for n, a in enumerate(cases)] + [("u", "other", "{}", []), ("n", None, "{}", [])])
    assert [rows[f"c{n}"]["errors"] for n in range(len(cases))] == list(cases.values())
    assert rows["u"]["errors"] == rows["n"]["errors"] == "unknown_tool" and rows["c0"]["valid"] and not rows["u"]["valid"]


def test_linking_order_and_canonical_json(spark):
    calls = [("z", "sum", '{"b": 2.50, "a": {"y": 1, "x": "\\u00e9"}}', ["y"]), ("y", "sum", '{"a":1,"b":1}', []), ("w", "sum", "{}", ["z", "y", "lost"]), ("k", "sum", "{}", ["k"]), ("y", "sum", "{}", ["z"])]
    rows = linked(spark, calls, [("z", 5, "late"), ("z", 3, 'a "b"\n'), ("gone", 1, "x"), (None, 1, "x")])
    assert {k: r["level"] for k, r in rows.items()} == {"y": 0, "z": 1, "w": 2, "k": None}
    assert rows["z"]["n_results"] == 2 and rows["w"]["errors"].endswith("unknown_id:lost")
    assert rows["z"]["canonical"] == '{"arguments":{"a":{"x":"é","y":1},"b":2.5},"id":"z","name":"sum","result":"a \\"b\\"\\n"}'
    for r in rows.values():
        parsed = json.loads(r["canonical"])
        assert list(parsed) == sorted(parsed) and json.dumps(parsed, separators=(",", ":"), ensure_ascii=False) == r["canonical"]


def test_levels_of_graphs(spark):
    rng = random.Random(3)
    waits = {(f"c{v}", f"c{u}") for v in range(1, 30) for u in rng.sample(range(v), min(v, rng.choice([0, 1, 1, 2, 3])))} | {("x", "y"), ("y", "x"), ("z", "x"), ("w", "z"), ("w", "c3"), ("q", "q")}
    ids = [f"c{i}" for i in range(30)] + list("xyzwq")
    level, changed = {}, True
    while changed:
        changed = False
        for i in ids:
            on = [b for a, b in waits if a == i]
            if i not in level and all(b in level for b in on):
                level[i], changed = 1 + max((level[b] for b in on), default=-1), True
    got = C.call_levels(spark.createDataFrame(list(waits), "call_id string, after string"), spark.createDataFrame([(i,) for i in ids], "call_id string"))
    assert {r["call_id"]: r["level"] for r in got.collect()} == level


def test_deep_ladder_and_cycle_behind_it(spark):
    """10,000 calls that each wait for the two before: a dozen doublings, not a round for each; and calls behind a cycle of three."""
    n = 10_000
    name = lambda i: f"c{i}"
    waits = [(name(i), name(i - k)) for i in range(n) for k in (1, 2) if i >= k] + [("x", "a"), ("x", "b"), ("x", "c"), ("a", "b"), ("b", "c"), ("c", "a"), ("y", "x"), ("y", name(5))]
    ids = [name(i) for i in range(n)] + list("xabcy")
    got = {r["call_id"]: r["level"] for r in C.call_levels(spark.createDataFrame(waits, "call_id string, after string"), spark.createDataFrame([(i,) for i in ids], "call_id string")).collect()}
    assert got == {name(i): i for i in range(n)}


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first answer"), (1, 2, "user", "thanks"), (1, 3, "assistant", "second"), (2, 0, None, None), (2, 1, "assistant", None), (None, 1, "assistant", "x"), (3, 0, "assistant", '{"tool_calls": [{"id": "t1", "name": "reply", "arguments": "{}"}]}'), (3, 1, "tool", '{"tool_call_id": "t1", "content": "ok"}'), (4, 0, "assistant", '{"tool_calls": 5}'), (1, 3, "assistant", "second")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in CLASHING))
    got = {r["call_id"]: r for r in C.tool_digest(frame).collect()}
    assert got["1:1"]["level"] == 0 and got["1:3"]["level"] == 1 and got["1:1"]["n_results"] == 1 and got["1:3"]["n_results"] == 0
    assert json.loads(got["t1"]["canonical"])["result"] == "ok" and got["2:1"]["errors"] == "missing:text"
    assert C.tool_digest(frame.limit(0)).count() == 0
    calls, results = C.call_turns(frame)
    assert C.orphan_results(calls, results).count() == 0


def test_ids_belong_to_their_conversation(spark):
    """The same ids in several conversations, one without conv_id, and JSON over several lines."""
    rows = []
    for c in (1, 2, None):
        calls = [{"id": "a", "name": "reply", "arguments": "{}"}, {"id": "b", "name": "reply", "arguments": "{}", "after": ["a", f"only{c}"]}]
        calls += [{"id": f"only{c}", "name": "reply", "arguments": "{}", "after": ["b"] if c == 2 else ["only1"]}]
        rows += [(c, 0, "assistant", json.dumps({"tool_calls": calls}, indent=1)), (c, 1, "tool", json.dumps({"tool_call_id": "a", "content": f"from {c}"}, indent=1))]
    rows += [(1, 2, "tool", '{"tool_call_id": "a", "content": "again"}'), (1, 3, "tool", '{"tool_call_id": "only2", "content": "astray"}')]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["call_id"]): r for r in C.tool_digest(frame).collect()}
    assert len(got) == 9
    assert {c: (json.loads(got[c, "a"]["canonical"])["result"], got[c, "a"]["n_results"]) for c in (1, 2, None)} == {1: ("from 1", 2), 2: ("from 2", 1), None: ("from None", 1)}
    assert [got[c, "a"]["level"] for c in (1, 2, None)] == [0, 0, 0]
    assert [got[c, "b"]["level"] for c in (1, 2, None)] == [None, None, 1]
    assert got[None, "onlyNone"]["errors"].endswith("unknown_id:only1") and got[None, "onlyNone"]["level"] == 0 and "unknown_id" not in got[1, "only1"]["errors"]
    calls, results = C.call_turns(frame)
    assert [(r["conv_id"], r["call_id"]) for r in C.orphan_results(calls, results).collect()] == [(1, "only2")]


# Pseudonyms.
def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def iban_ok(text):
    t = "".join(c for c in text if c.isalnum())
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


VALUES = {
    "card": ["4012429011158754", "4012 4290 1115 8754", "5500-0000-0000-0004", "4222222222222220"][:3],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "date": ["1984-02-29", "31/12/1999", "12/31/1999", "31.12.1999", "2099-11-12", "1899-12-31"],
    "ipv4": ["42.144.35.254", "0.0.0.0", "255.255.255.255"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (383) 555-6083", "383-555-6083", "+4915112345678", "+44 20 7946 0958", "+33 6 12 34 56 78"],
    "email": ["cheio.48@mail8.example.com"],
}
INVALID = ["4012429011158755", "DE88370400440532013000", "2023-02-30", "99/99/2000", "999.1.1.1", "1.2.3", "000-12-3456", "666-12-3456", "12345", "user@", "@example.com", "v1.2.3", "$1,000.00"]


def replaced(spark, texts, key=P.KEY):
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in P.pseudonymise(frame, key).orderBy("doc_id").collect()]


def test_values_keep_their_format(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    again = replaced(spark, [f"é before {v} after, {v}" for _, v in flat])
    for (kind, v), text in zip(flat, again):
        first, second = text.removeprefix("é before ").split(" after, ")
        assert first == second != v, (kind, v, text)
        assert len(first) == len(v) or kind == "ipv4"
        if kind != "ipv4":
            assert ["9" if a.isdigit() else "a" if a.isalpha() else a for a in first] == ["9" if a.isdigit() else "a" if a.isalpha() else a for a in v] or kind == "iban"
        assert {"card": luhn, "iban": iban_ok}.get(kind, lambda t: True)(first)
    frame = spark.createDataFrame([(t,) for t in again], "text string").select(P.pseudonymise(spark.createDataFrame([(t,) for t in again], "text string")).columns[0])
    assert frame.count() == len(again)


def test_invalid_values_stay(spark):
    assert replaced(spark, INVALID + [None, "", "plain words"]) == INVALID + [None, "", "plain words"]


def test_one_to_one_and_keyed(spark):
    days = [f"20{y:02d}-{m:02d}-{d:02d}" for y in range(0, 20) for m in (1, 7) for d in (1, 15, 28)]
    out = replaced(spark, days)
    assert len(set(out)) == len(days) and out != replaced(spark, days, "another key")
    ips = [f"10.0.{i}.{j}" for i in range(8) for j in range(16)]
    assert len(set(replaced(spark, ips))) == len(ips)
    phones = [f"383-555-{n:04d}" for n in range(300)]
    assert len(set(replaced(spark, phones))) == 300


def plain_feistel_text(value, key, tweak, rounds=8):
    """The network over characters, with hashlib."""
    a, b = value[: len(value) // 2], value[len(value) // 2 :]

    def shift(text, other, i):
        hexes = "".join(hashlib.sha256(f"{key}|{tweak}|{i}|{block}|{other}".encode()).hexdigest() for block in range((len(text) + 15) // 16))
        out = ""
        for k, c in enumerate(text):
            by = int(hexes[4 * k : 4 * k + 4], 16)
            base, n = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            out += chr((ord(c) - base + by) % n + base) if n else c
        return out

    for i in range(1, rounds + 1):
        a, b = (shift(a, b, i), b) if i % 2 else (a, shift(b, a, i))
    return a + b


def plain_feistel_pair(a, b, na, nb, key, tweak, rounds=8):
    draw = lambda i, x: int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(1, rounds + 1):
        a, b = ((a + draw(i, b)) % na, b) if i % 2 else (a, (b + draw(i, a)) % nb)
    return a, b


def test_feistel_by_another_hand(spark):
    """Against a network written with hashlib: texts of all lengths and alphabets, pairs, and values of three kinds as a whole."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("019azAZ-.é", k=n)) for n in range(1, 40)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.feistel_text(F.col("t"), "k", F.lit("w")).alias("x"))
    assert all(r["x"] == plain_feistel_text(r["t"], "k", "w") for r in frame.collect())
    pairs = [(rng.randrange(292), rng.randrange(250)) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", P.feistel_pair(F.col("a"), F.col("b"), 292, 250, "k", F.lit("w")).alias("p")).collect()
    assert all(tuple(r["p"]) == plain_feistel_pair(r["a"], r["b"], 292, 250, "k", "w") for r in got)

    def ssn(v):
        area, group, serial = map(int, v.split("-"))
        a, b = plain_feistel_pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, P.KEY, "ssn")
        area = a // 99 + 1
        return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"

    ssns = [f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(200)]
    made = replaced(spark, ssns)
    assert made == [ssn(v) for v in ssns]
    assert all(1 <= int(v[:3]) <= 899 and v[:3] != "666" and v[4:6] != "00" and v[7:] != "0000" for v in made)
    local = replaced(spark, ["cheio.48@mail8.example.com"])[0]
    assert local == plain_feistel_text("cheio.48", P.KEY, "email") + "@mail8.example.com"


def test_phones_link_whatever_their_separators(spark):
    forms = ["+1 555 123 4567", "+15551234567", "+1-555-123-4567", "+1 (555) 123-4567"]
    made = replaced(spark, forms)
    assert len({"".join(c for c in m if c.isdigit()) for m in made}) == 1 and all(m.startswith("+1") and m != f for m, f in zip(made, forms))
    codes = replaced(spark, ["+4915112345678", "+35312345678", "+7 495 123 45 67"])
    assert [c[:n] for c, n in zip(codes, (3, 4, 2))] == ["+49", "+353", "+7"]
    amex = replaced(spark, ["3782 822463 10005", "378282246310005"])
    assert amex[0].replace(" ", "") == amex[1] != "378282246310005" and luhn(amex[1])


def test_long_texts(spark):
    """Megabytes in a row: values at both ends are found, the rest stays."""
    filler = "plain words and 12 numbers. " * 80_000
    out = replaced(spark, [f"123-45-6789 {filler} 123-45-6789", "7" * 2_000_000, "a@" * 300_000])
    first, last = out[0][:11], out[0][-11:]
    assert first == last != "123-45-6789" and out[0][12:-12] == filler and out[1:] == ["7" * 2_000_000, "a@" * 300_000]


def test_feistel_is_a_permutation(spark):
    """Every string of three digits, and every pair of a small grid."""
    n = spark.range(1000).select(P.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", F.lit("t")).alias("x"))
    assert n.distinct().count() == 1000
    pair = spark.range(60).select(P.feistel_pair(F.floor(F.col("id") / 6), F.col("id") % 6, 10, 6, "k", F.lit("t")).alias("p")).select("p.a", "p.b")
    assert {tuple(r) for r in pair.collect()} == {(a, b) for a in range(10) for b in range(6)}


def test_pii_of_awkward_rows(spark):
    docs = documents(spark)
    out = P.pseudonymise(docs)
    assert {c for c in out.columns} == set(docs.columns) and out.count() == docs.count()
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in docs.collect())
    assert P.pii_digest(empty(spark)).count() == 0


# Toxicity.
def brute_segments(scores):
    """The best segment (shortest of ties), then the same left and right of it."""
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)

    def of(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                v = sums[j] - sums[i]
                if v > 1e-12 and (best is None or v > best[2] + 1e-9):
                    best = (i, j, v)
        return [] if best is None else [*of(a, best[0]), best, *of(best[1], b)]

    return of(0, len(scores))


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1.5, -1, 1.25, 2.1, 3.3]) + rng.random() * 0.01 for _ in range(rng.randrange(15))]
        got = T.maximal_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in brute_segments(scores)]
        assert all(abs(v - sum(scores[a:b])) < 1e-9 for a, b, v in got)


def corpus(n=400):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "grobianly", "grobians!", "Blockhead"]))
        texts.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return texts, labels


def test_toxicity(spark):
    texts, labels = corpus()
    docs = documents(spark, texts + [(1000, None), (1001, ""), (None, "w1 blockhead w2 grobianx"), (1002, "blockhead " * 40), (1002, "blockhead " * 40)])
    frame = spark.createDataFrame(labels + [(None, 0, 1), (7, 0, None), (8, 0, 5)], "doc_id long, quality int, toxic int").select("*", *(F.lit(1).alias(c) for c in CLASHING if c != "toxic"))
    rows = T.toxic_digest(docs, frame).collect()
    assert len(rows) == len(texts) + 5
    by_id = {r["doc_id"]: r for r in rows}
    for i, _, toxic in labels:
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by_id[i]["predicted"] == toxic and 0 <= by_id[i]["score"] <= 1
    assert by_id[1000]["predicted"] == by_id[1001]["predicted"] == 0 and not by_id[None]["held_out"] and by_id[1002]["predicted"] == 1
    kept = T.drop_toxic(docs, frame)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, t in labels if not t} | {1000, 1001} | ({None} if not by_id[None]["predicted"] else set())


def test_training_bound(spark):
    """However few rows training may use and however often a label is repeated, those of the smallest hashes are used."""
    texts, labels = corpus(200)
    frame = spark.createDataFrame(labels + [(1, 0, 0)] * 300, "doc_id long, quality int, toxic int")
    usable = sorted(i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    model = T.train(documents(spark, texts), frame, train_rows=60)
    assert model is not None and model.weights
    assert T.train(documents(spark, texts), frame, train_rows=len(usable)).weights == T.train(documents(spark, texts), frame).weights


def test_weights_by_definition():
    """Log-odds of both signs; what chance can explain has none."""
    n_toxic, n_clean, tests = 100, 300, 50
    rows = [(b"bad", 60, 5), (b"good", 2, 200), (b"the", 100, 300), (b"rare", 2, 0)]
    got = T.token_weights(rows, n_toxic, n_clean, tests)
    assert set(got) == {b"bad", b"good"}
    for token, y, n in rows[:2]:
        prior = T.PRIOR * (y + n) / 400
        odds = [np.log((k + prior) / (total + T.PRIOR - k - prior)) for k, total in ((y, n_toxic), (n, n_clean))]
        assert abs(got[token] - (odds[0] - odds[1] - T.TOKEN_COST)) < 1e-9
    assert got[b"good"] < -T.TOKEN_COST < got[b"bad"]


def test_held_out_labels_do_not_matter(spark):
    texts, labels = corpus(200)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    score = lambda ls: {r["doc_id"]: r["score"] for r in T.toxic_digest(documents(spark, texts), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect()}
    assert score(labels) == score(flip)


def test_passages_are_found(spark):
    texts, labels = corpus()
    docs = documents(spark, texts + [(5000, PROSE * 3 + "blockhead grobian grobians " + PROSE * 3)])
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    row = T.score_documents(docs.where("doc_id = 5000"), model).first()
    at = len((PROSE * 3).split())
    assert any(p["start"] <= at and at + 3 <= p["end"] <= at + 4 for p in row["passages"])


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, 1)]])
def test_one_class_or_none(spark, labels):
    docs = documents(spark, [(1, "some words"), (2, "other words")])
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in T.toxic_digest(docs, frame).collect()} == {0.0}
    assert T.drop_toxic(docs, frame).count() == 2
    assert T.toxic_digest(empty(spark), frame).count() == 0


def test_training_rows_are_one_an_id(spark):
    """A doc_id that comes very often is one training row, of its least text."""
    from tidemark.llm import toxicity as X

    rows = [(i, f"vile nasty word {i}" if i % 2 else f"kind sweet word {i}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = docs.unionByName(docs.where("doc_id = 8").crossJoin(spark.range(300)).select("doc_id", "text")).unionByName(spark.createDataFrame([(8, "zzz later text")], "doc_id long, text string"))
    one, other = X.train(docs, labels), X.train(many, labels)
    assert one is not None and other.weights == one.weights and (other.rate, other.log_k) == (one.rate, one.log_k)
    assert np.allclose(other.logistic, one.logistic)
