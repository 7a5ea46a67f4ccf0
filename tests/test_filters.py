import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import check_topic, strip_trailing_separators, topic_matches
from tidemark.operators import filters as L

c = L.criterion


def flags(spark, filt, rows):
    df = spark.createDataFrame(rows, "pid string, tags array<string>")
    return {r[0]: r[1] for r in df.select("pid", L.passes(filt).alias("ok")).collect()}


def test_ids_and_tags(spark):
    f = L.EventFilter.of(c("include_ids", ["p|1", "p|3"]), c("exclude_ids", ["p|3", "p|2"]), c("include_tags", ["a"]), c("exclude_tags", ["a", "b"]))
    rows = [("p|1", []), ("p|2", []), ("p|3", []), ("p|4", ["b"]), ("p|5", ["a"]), ("p|6", ["a", "b"])]
    assert flags(spark, f, rows) == {"p|1": True, "p|2": False, "p|3": True, "p|4": False, "p|5": True, "p|6": True}
    f = f.apply_in_order([c("remove_include_ids", ["p|3"])])
    assert not flags(spark, f, rows)["p|3"]


def test_topics_and_patterns(spark):
    f = L.EventFilter.of(c("exclude_regex", [".*"]), c("include_topics", ["a/+/c", "d/#"]))
    assert flags(spark, f, [("p|1", []), ("p|2", ["t:a/b/c"]), ("p|3", ["t:d/e"]), ("p|4", ["a/b/c"]), ("p|5", None)]) == {"p|1": False, "p|2": True, "p|3": True, "p|4": False, "p|5": False}
    f = L.EventFilter.of(c("exclude_regex", ["a-.*"]), c("include_ids", ["E|a-1", "E|a-2"]))
    assert flags(spark, f, [("E|a-1", []), ("E|a-2", []), ("E|a-3", []), ("E|b-1", [])]) == {"E|a-1": True, "E|a-2": True, "E|a-3": False, "E|b-1": True}


TOPICS = [
    ("#", {"h/g/l/t": 1}),
    ("h/g", {"h/g": 1, "o/g": 0, "h/g/k": 0, "H/g": 0}),
    ("h/g/+/t", {"h/g/l/t": 1, "h/g/k/b": 0, "h/f/k/t": 0, "h/g/k/f/t": 0, "h/g": 0, "h/g/l/t/": 1, "h/g/+/t": 1, "h/g/l+/t": 1, "+/g/+/t": 0, "h/g/#": 0}),
    ("+", {"h": 1, "h/g": 0, "/h": 0, "h/": 1}),
    ("+/g/+/t", {"h/g/l/t": 1, "h/g/k/b": 0, "o/g/l/t": 1, "o/g/k/b": 0}),
    ("h/g/#", {"h/g/l/t": 1, "h/g/k/b": 1, "h/f/k/t": 0, "h/g/": 0, "h/g//": 0}),
    ("+/g/#", {"h/g/l/t": 1, "h/f/k/t": 0, "o/g/k/b": 1}),
    ("h/#", {"h/g/": 1, "h/g//": 1}),
]


@pytest.mark.parametrize("expression,cases", TOPICS)
def test_topic_table(spark, expression, cases):
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", topic_matches(F.col("t"), expression).alias("ok"))
    assert {r[0]: int(r[1]) for r in df.collect()} == cases


def test_topic_validity(spark):
    for bad in ("", "h/#/", "h/#/t", "h/g/t#", "h/g+f/t", "h/g+/t", "h/+f/t", "h/g/t+", "a+", "a+/"):
        with pytest.raises(ValueError):
            check_topic(bad)
    for good in ("#", "/#", "/+", "+/", "/+/"):
        check_topic(good)
    df = spark.createDataFrame([("a/b/",), ("a/b///",), ("a",), ("",)], "t string").select(strip_trailing_separators(F.col("t")))
    assert [r[0] for r in df.collect()] == ["a/b", "a/b", "a", ""]


def test_merge():
    a, b = [c("exclude_ids", "abc"), c("include_ids", {"b": 1, "c": 2})], [c("exclude_ids", "d"), c("remove_include_ids", "ab"), c("remove_exclude_ids", "c")]
    want = [c("exclude_ids", "abd"), c("include_ids", {"c": 2})]
    assert L.merge(a, b).criteria() == want == L.merge(b, a).criteria()
    assert L.merge([c("include_ids", {"b": 2, "c": 2})], [c("include_ids", {"b": 3, "c": 1})]).criteria() == [c("include_ids", {"b": 3, "c": 2})]
    # In order, an add after a removal stays; merged, the removal wins.
    later = [c("remove_exclude_tags", "a"), c("exclude_tags", "a")]
    assert L.EventFilter.of(c("exclude_tags", "a")).apply_in_order(later).criteria() == [c("exclude_tags", "a")]
    assert L.merge([c("exclude_tags", "a")], later).criteria() == []


@pytest.mark.parametrize("kind", [k for k in L.KINDS if k != "include_ids"])
def test_diff(kind):
    one, two = [c(kind, "ab")], [c(kind, "ac")]
    assert L.diff([], one) == one
    assert L.diff(one, []) == [c(f"remove_{kind}", "ab")]
    assert L.diff(one, two) == [c(kind, "c"), c(f"remove_{kind}", "b")]


def test_diff_of_ids():
    assert L.diff([c("include_ids", {"a": 1, "b": 1})], [c("include_ids", {"a": 2, "b": 1})]) == [c("include_ids", {"a": 2})]
    with pytest.raises(ValueError):
        L.diff([c("remove_include_tags", "a")], [])


def test_frames_agree_with_sets(spark):
    a, b = [c("include_ids", {"x": 3, "y": 1}), c("exclude_tags", "pq")], [c("include_ids", {"x": 2, "z": 5}), c("remove_exclude_tags", "p")]
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(L.merge_frames(L.criteria_frame(spark, a), L.criteria_frame(spark, b))) == rows(L.criteria_frame(spark, L.merge(a, b).criteria()))
    assert rows(L.diff_frames(L.criteria_frame(spark, a), L.criteria_frame(spark, b[:1]))) == rows(L.criteria_frame(spark, L.diff(a, b[:1])))
    assert L.from_rows(L.criteria_frame(spark, a).collect()) == sorted(a, key=lambda x: x.kind, reverse=True) or len(L.from_rows(L.criteria_frame(spark, a).collect())) == 2


def test_large_id_sets_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "INLINE_IDS", 1)
    df = spark.createDataFrame([(f"p|{i}", ["t:x"] if i % 2 else []) for i in range(10)], "pid string, tags array<string>")
    f = L.EventFilter.of(c("exclude_ids", list("0123")), c("include_ids", {"1": 0, "9": 0}), c("exclude_tags", ["t:x"]))
    want = {r[0] for r in df.where(L.passes(f)).collect()}
    assert {r[0] for r in L.filter_events(df, f).collect()} == want == {"p|1", "p|4", "p|6", "p|8", "p|9"}


def test_large_id_sets_may_name_the_entity_type(spark, monkeypatch):
    df = spark.createDataFrame([(f"{t}|{i}", ["x"]) for t in "pq" for i in range(4)], "pid string, tags array<string>")
    f = L.EventFilter.of(c("exclude_ids", ["p|0", "1", "q|2"]), c("include_ids", {"q|1": 0, "p|3": 0}))
    want = {r[0] for r in df.where(L.passes(f)).collect()}
    monkeypatch.setattr(L, "INLINE_IDS", 1)
    rows = L.filter_events(df, f)
    assert {r[0] for r in rows.collect()} == want == {"q|0", "q|1", "p|2", "p|3", "q|3"} and rows.columns == df.columns
