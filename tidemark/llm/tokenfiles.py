"""Token ids of documents as ORC files: written in the order of doc_id, read by stripe, pruned by metadata.

A document's ids are one row of ORC integers (run-length encoded). Files are ranges of doc_id in ascending order, each
sorted, so that the minima and maxima of files, stripes and row groups prune by doc_id, and Bloom filters on doc_id
rule row groups out for point lookups. Spark deals a file's stripes to several tasks. A row knows its place within its
file; a small table beside the files, one row a file, says how many ids come before each file.

Defined results: a null text counts as empty and has the end id alone; null doc_ids come first; rows of one doc_id are
ordered by a hash of their text, then by row, and are kept one by one; an empty table gives no rows; extra columns are
ignored; texts of any length are one row each.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text, slices
from tidemark.session import ensure_checkpoint_dir, importable

END_ID = 1
#: Bytes of a stripe, rows of a row group (the unit of row indexes and Bloom filters), and the share of false positives.
STRIPE_BYTES, GROUP_ROWS, BLOOM_FPP = 16 << 20, 1000, 0.01
FILE_SCHEMA = "part int, doc_id long, at long, n_tokens long, ids array<int>"


class Known(dict):
    """A dictionary that works out what it lacks. It remembers entries up to a length, as many as there is room for: the frequent ones come early."""

    ENTRIES, LONGEST = 1 << 20, 64

    def __init__(self, work: Callable[[str], bytes]) -> None:
        self.work = work

    def __missing__(self, key: str) -> bytes:
        made = self.work(key)
        if len(key) <= self.LONGEST and len(self) < self.ENTRIES:
            self[key] = made
        return made


class WordTokenizer:
    """ids of texts as a `tokenizers` file gives them, as little-endian unsigned 32-bit bytes.

    In a file that lower-cases, drops white space and then cuts words by a pattern, the ids of what stands between two
    blanks don't depend on what is around it: the library's model tokenises each word once, and dictionaries of words and
    of runs between blanks have them from then on. That form is taken for texts of the plain characters below, whose
    case and classes no Unicode version changed, and which hold no added token; other texts and other files go through
    the library whole.
    """

    PLAIN = "[\t\n\r\\x20-\\x7e\\xa0-\\u024f\\u0400-\\u0482\\u048a-\\u052f\\u2010-\\u2027]*"
    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        pattern = word_pattern(path)
        self.find = regex.compile(pattern).findall if pattern else None
        self.plain = regex.compile(self.PLAIN).fullmatch
        self.letters = byte_letters()
        self.known = Known(self._run)

    def exact(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """A run between blanks. A word of the pattern is found as itself again, so words and runs share a dictionary."""
        if run.isalpha() or (words := self.find(run)) == [run]:
            level = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.model.tokenize(level)]).tobytes()
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.find is None or not self.plain(text) or any(a in text for a in self.added):
            return self.exact(text)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


def byte_letters() -> dict[int, int]:
    """The alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the other bytes for U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for a worker process, with the words it has met in earlier tasks."""
    return WordTokenizer(path)


def word_pattern(path: str) -> str | None:
    """The pattern of words if the file's form is: NFC, white space to a blank, lower case; words found by a pattern; byte-level BPE within words. Else None."""
    import json
    from pathlib import Path

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, cuts = norm.get("normalizers") or [], pre.get("pretokenizers") or []
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or spec.get("post_processor"):
        return None
    split, level = cuts
    whole = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    found = split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
    return split["pattern"]["Regex"] if whole and found and not level["add_prefix_space"] and not level["use_regex"] and not spec["model"].get("dropout") else None


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, stripe_bytes: int = STRIPE_BYTES, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Files of FILE_SCHEMA below path/ids, and path/parts with (part, before): the ids before each file.

    One exchange, of the texts by ranges of (doc_id, hash, row); rows that share a doc_id may lie in several files.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    keyed = keyed_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, part, at = tokenizer_of(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                made = [tokenizer.encode(t) + tail for t in piece.column(1).to_pylist()]
                sizes = np.array([len(m) // 4 for m in made], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))
                cols = [pa.array(np.full(len(made), part, np.int32)), piece.column(0), pa.array(at + ends - sizes), pa.array(sizes), ids]
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "at", "n_tokens", "ids"])

    writer = dealt.mapInArrow(run, FILE_SCHEMA).write.option("maxRecordsPerFile", 0).option("compression", "zstd")
    writer = writer.option("orc.stripe.size", stripe_bytes).option("orc.create.index", "true").option("orc.row.index.stride", group_rows)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).orc(f"{path}/ids")
    # One row a file.
    sums = docs.sparkSession.read.schema(FILE_SCHEMA).orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums.select("part", before.alias("before")).coalesce(1).write.orc(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files; start counts the ids of all documents before. Tasks take stripes.

    wanted are doc_ids to look up: the comparison reaches the files, whose statistics and Bloom filters skip the rest. Of
    the ids, only what is selected is read.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(f"{path}/ids")
    if wanted is not None:
        rows = rows.where(F.col("doc_id").isin([int(w) for w in wanted]))
    parts = spark.read.schema("part int, before long").orc(f"{path}/parts")  # one row a file: broadcast
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_checks(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_token_files' rows, counted and summed from the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, starts, ids = batch.columns
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([doc_ids, starts, pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Whole documents written as token files in the shared folder and read back: token_checks of every row."""
    spark = importable(docs.sparkSession)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_checks(read_token_files(spark, path))
