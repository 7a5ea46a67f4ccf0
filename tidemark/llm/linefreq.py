"""Quality rules: counts within a document, and lines that too many documents of a host share.

Within a document: words, their code points, symbols, repeated lines and words in repeated 3-word windows. Across
documents: lines are normalised (A-Z lower-cased, digits made 0, runs of white space made one space) and hashed, and for
each host (the source column) the distinct documents that hold a line are counted; exact copies of a text are one
document, as telling copies apart is deduplication's task, unless copies=True counts each. A line is removed where its count is above
max(MIN_DOCS, SHARE x documents of the host). A document is rejected if it fails the base rules or if removal depletes it:
fewer than MIN_WORDS words left, or less than LEFT_SHARE of them.

quality_verdicts() judges, remove_frequent_lines() returns the documents with those lines cut from their texts.

Defined results: a null text counts as empty (no words, rejected); a null host is one host; repeated rows are judged
alike; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, arrow_rows, unused
from tidemark.session import cut

MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_DOCS, SHARE, LEFT_SHARE = 10, 0.001, 0.3
#: Frequent lines up to so many are broadcast, after counting them; more are joined by salted keys.
BROADCAST_ROWS, SALTS = 200_000, 64

_SPACE, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the list."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pair = ids[:-2] * len(known) + ids[1:-1]
    if len(known) > 2_000_000:  # else three ids fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, n = np.unique(pair * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + again.size] |= again
    return int(covered.sum())


def line_hash(parts: list[bytes]) -> int:
    """Of a normalised line, signed."""
    return xxhash.xxh64_intdigest(b" ".join(parts).translate(_NORMAL)) - (1 << 63)


def document_counts(text: str) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and (hash, words) of each distinct normalised line."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    repeats = 0
    lines: dict[bytes, int] = {}
    for line in raw.split(b"\n"):
        parts = line.split()
        if parts:
            repeats += line in seen
            seen.add(line)
            key = b" ".join(parts)
            lines[key] = lines.get(key, 0) + len(parts)
    hashed: dict[int, int] = {}
    for key, n in lines.items():
        h = line_hash([key])
        hashed[h] = hashed.get(h, 0) + n
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    return len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), repeats, repeated_window_words(words), list(hashed.items())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, digest, row, the five counts, lines) for every row of docs, stored; digest is a hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("digest"))

    def work(c: dict[str, list]) -> dict[str, list]:
        made = [document_counts(t) for t in c["text"]]
        out = {name: [m[i] for m in made] for i, name in enumerate(_COUNTS)}
        return out | {k: c[k] for k in ("doc_id", "host", "digest")} | {"lines": [[{"h": h, "n": n} for h, n in m[5]] for m in made]}

    schema = "doc_id long, host string, digest long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<struct<h: long, n: int>>"
    return cut(arrow_rows(plain, work, schema).withColumn("row", F.monotonically_increasing_id()))


def line_hits(rows: DataFrame, min_docs: int, share: float, copies: bool) -> DataFrame:
    """(row, h, n): the lines of each row of a line_table that are above the limit of their host."""
    one = ["host", "doc_id", "digest"] if copies else ["host", "digest"]
    distinct = rows.groupBy(*one).agg(F.first("lines").alias("lines"))  # copies meet before the shuffle
    hosts = distinct.groupBy("host").agg(F.count("*").alias("docs"))
    counted = distinct.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    # Both sides are aggregates; a host has one row here, so its lines meet no more than that.
    frequent = cut(counted.join(hosts, "host").where(F.col("n") > F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("docs"))).select("host", "h"))
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    if frequent.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(frequent), ["host", "h"])
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])


def quality_verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS, left_share: float = LEFT_SHARE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """(doc_id, the five counts, removed_words, base_failed, kept) for every row of docs."""
    rows = line_table(docs, id_col, text_col, host_col)
    removed = line_hits(rows, min_docs, share, copies).groupBy("row").agg(F.sum("n").cast("long").alias("removed_words"))
    judged = rows.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    left = F.col("n_words") - F.col("removed_words")
    return judged.select("doc_id", *_COUNTS, "removed_words", failed.alias("base_failed"), (~failed & (left >= min_words) & (left >= F.col("n_words") * left_share)).alias("kept"))


def remove_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """docs with the lines above the limits cut from their texts; all rows and columns are kept, other lines stay as they are."""
    rows = line_table(docs, id_col, text_col, host_col)
    hits = line_hits(rows, min_docs, share, copies).groupBy("row").agg(F.collect_set("h").alias("hashes"))  # as many as a document has lines
    hit_id, hit_host, hit_digest, gone = unused(docs, "hit_id", "hit_host", "hit_digest", "gone")
    found = rows.join(hits, "row").groupBy(F.col("doc_id").alias(hit_id), F.col("host").alias(hit_host), F.col("digest").alias(hit_digest)).agg(F.first("hashes").alias(gone))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    here = F.col(id_col).cast("long").eqNullSafe(F.col(hit_id)) & (F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(hit_host)) & (F.xxhash64(text) == F.col(hit_digest))
    marked = docs.join(found, here, "left").select(*docs.columns, gone)
    at, names = docs.columns.index(text_col), docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = batch.schema.field(at)
        texts = [t if t is None or not hashes else without_lines(t, set(hashes)) for t, hashes in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
        return batch.set_column(at, field, pa.array(texts, field.type))

    return arrow_batches(marked, work, text_col).select(*names)


def without_lines(text: str, hashes: set[int]) -> str:
    return "\n".join(line for line in text.split("\n") if line_hash(line.encode("utf-8", "surrogatepass").split()) not in hashes)


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns and removed_words."""
    return quality_verdicts(docs)


#: The query quality_digest(documents) in DuckDB's SQL.
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, doc_id, text, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM q WHERE n > 1) GROUP BY r),
ln AS (SELECT r, host, text, regexp_replace(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '^ | $', '', 'g') AS norm,
              len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT r, host, text, unnest(lines) AS line FROM w)),
h AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
f AS (SELECT host, norm FROM ln JOIN h USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT text) > greatest({MIN_DOCS}, {SHARE} * docs)),
rm AS (SELECT r, sum(n)::BIGINT AS removed_words FROM ln SEMI JOIN f USING (host, norm) GROUP BY r),
b AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN rm USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND n_words - removed_words >= {MIN_WORDS} AND n_words - removed_words >= n_words * {LEFT_SHARE} AS kept
FROM b
"""
