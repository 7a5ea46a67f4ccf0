"""Cross-entropy difference of documents between a target and a background n-gram model.

Both models share one vocabulary, all words of all documents (lower-cased A-Z) and an end mark, and one form: bigrams
interpolated with unigrams and a uniform share, p(v|u) = BIGRAM c(uv)/c(u) + UNIGRAM c(v)/N + rest/V, which sums to 1
over v; where a model hasn't seen u, its bigram share goes to the unigram. The background is counted over all documents, the target
over all documents that a label marks as good. A text is its words between a start and an end mark. Counts are exact, so they
and the vocabulary grow with the input; nothing of them is broadcast or sent to the driver but four totals. A document's
score is the mean over its tokens (the end mark included) of target loss less background loss, in nats; lower is nearer to the target.

Documents are gathered in blocks of about BLOCK_TOKENS tokens, in which words have ids of the block. A block reports the
counts of its distinct words and pairs, ordered by a 56-bit hash and cut into a fixed number of parts of the hashes'
range: one packed row a block and part, so rows grow with the input and no faster. A task sums a part over all blocks and
sends each block the sums of what it reported, in its order. Where there are more than FAN blocks, sums go by levels: a
part is first added up over about FAN blocks, the outcome is cut into finer parts, and these are added up over such
groups in the same way; the sums come back level by level. So no task ever holds more than FAN rows of a part. Blocks are
stored before they are counted, so each is the same in both passes.

Defined results: a null text counts as empty and has no tokens, losses 0 and score 0, and isn't counted; null or repeated labels: a
document is in the target if any of its labels is 1; without target documents the target model is uniform over the vocabulary;
repeated rows are counted and scored each; a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import keyed_text, slices
from tidemark.session import Scratch, stored

#: Weights of the bigram and the unigram estimate; the rest is uniform, so no probability is 0.
BIGRAM, UNIGRAM = 0.6, 0.39
#: Label tables up to so many rows are broadcast, after counting them; larger ones are joined by doc_id.
BROADCAST_ROWS = 2_000_000
#: Tokens after which a block ends; a text is never split.
BLOCK_TOKENS = 1_000_000
#: A block's parts as a power of two, by how much parts are finer a level up, and blocks or groups that a level adds up at once.
PART_BITS, FINER_BITS, FAN = 10, 8, 512
#: Ids of a block's start and end marks; words follow.
START, END = 0, 1
_MARKS = (b"\x00start", b"\x00end")
_MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCK_SCHEMA = "block long, doc_ids array<long>, good array<int>, lengths array<long>, words binary, ids binary"
COUNT_SCHEMA = "part long, block long, keys binary, background binary, target binary"
SUM_SCHEMA = "part long, block long, background binary, target binary, words long"
SCORE_SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, of which the high ones compress to nothing."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def blocks_of(rows: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """BLOCK_SCHEMA of rows (doc_id, text, good): word hashes of a block and its documents as ids of them, compressed."""
    declared = StructType.fromDDL(BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.taskcontext import TaskContext

        schema = to_arrow_schema(declared)
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {m: i for i, m in enumerate(_MARKS)}
        doc_ids, good, lengths, ids = [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            packed = zstandard.compress(np.concatenate(ids or [np.empty(0, np.int32)]).tobytes(), 3)
            made = [[number], [list(doc_ids)], [list(good)], [list(lengths)], [words.tobytes()], [packed]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema)

        for batch in batches:
            for piece in slices(batch):
                for doc_id, text, mark in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    words = tokens(text)
                    for w in words:
                        if w not in known:
                            known[w] = len(known)
                    doc_ids.append(doc_id)
                    good.append(mark)
                    lengths.append(len(words))
                    ids.append(np.fromiter(map(known.get, words, repeat(0)), np.int32, len(words)))
                    held += len(words)
                    if held >= block_tokens:
                        yield out()
                        number += 1
                        known = {m: i for i, m in enumerate(_MARKS)}
                        doc_ids, good, lengths, ids = [], [], [], []
                        held = 0
        if doc_ids:
            yield out()

    return rows.select("doc_id", "text", "good").mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A block's documents as pairs of ids, with its distinct items: words, then pairs in ascending order."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.good = np.array(row["good"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        ids = np.frombuffer(zstandard.decompress(row["ids"]) if self.lengths.sum() else b"", np.int32).astype(np.int64)
        n = self.lengths
        self.full = np.flatnonzero(n)  # empty texts have no tokens at all
        ends = np.cumsum(n)[self.full]
        # What is predicted: every word of a text, then the end mark; what precedes it: the start mark, then every word.
        self.v = np.insert(ids, ends, END)
        self.u = np.insert(ids, ends - n[self.full], START)
        self.of = np.repeat(self.full, n[self.full] + 1)
        self.pairs, self.at = np.unique(self.u * self.words.size + self.v, return_inverse=True)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words, then pairs, whose last bit is 1 for words that are predicted; and their order."""
        size = self.words.size
        pair = self.words[self.pairs // size] * _MIX ^ (self.words[self.pairs % size] + _MIX) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys = np.concatenate((self.words, pair)) >> np.uint64(8) << np.uint64(1)
        keys[:size] |= np.uint64(1)
        keys[START] &= ~np.uint64(1)
        return keys, np.argsort(keys, kind="stable")

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Background and target counts of words, then pairs. A start mark's count is the number of texts."""
        size, marked = self.words.size, self.good[self.of].astype(bool)

        def of(keep: np.ndarray | slice) -> np.ndarray:
            words = np.bincount(self.v[keep], minlength=size)
            words[START] += int((self.u[keep] == START).sum())
            return np.concatenate((words, np.bincount(self.at[keep], minlength=self.pairs.size)))

        return of(slice(None)), of(marked)

    def scores(self, sums: np.ndarray, totals: dict[str, int]) -> pa.Table:
        """SCORE_SCHEMA from the sums (background, target) of the block's items."""
        size, out = self.words.size, []
        for k, name in ((1, "target"), (0, "background")):
            words, pairs, total = sums[k, :size].astype(float), sums[k, size:], totals[name]
            if total:
                unigram, before = words[self.v] / total, words[self.u]
                bigram = np.where(before > 0, pairs[self.at] / np.maximum(before, 1), unigram)
                p = BIGRAM * bigram + UNIGRAM * unigram + (1 - BIGRAM - UNIGRAM) / totals["vocabulary"]
            else:
                p = np.full(self.v.size, 1 / max(totals["vocabulary"], 1))
            out.append(np.bincount(self.of, -np.log(p), minlength=self.lengths.size).astype(float))
        score = np.where(self.lengths > 0, (out[0] - out[1]) / (self.lengths + 1), 0.0)
        return pa.table([pa.array(self.doc_ids, pa.int64()), pa.array(self.lengths), *map(pa.array, (out[0], out[1], score))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of 57-bit keys."""
    return (keys >> np.uint64(57 - bits)).astype(np.int64)


def cut_by_part(keys: np.ndarray, counts: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """(part, packed differences of keys, packed counts ...) of ordered keys, a row for each part of so many bits that has any."""
    held = part_of(keys, bits)
    ends = np.flatnonzero(np.diff(held, append=-1)) + 1
    for start, end in zip([0, *ends[:-1]], ends):
        yield int(held[start]), pack(np.diff(keys[start:end], prepend=np.uint64(0))), *(pack(c[start:end]) for c in counts)


def block_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """COUNT_SCHEMA: of every block and part the ordered keys, as differences, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                keys, order = block.keys()
                for part, *packed in cut_by_part(keys[order], [c[order] for c in block.counts()], bits):
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in packed)], names=["part", "block", "keys", "background", "target"])

    return blocks.mapInArrow(run, COUNT_SCHEMA)


def merged(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct keys of a part's rows, where each row's keys are among them, their summed counts (background, target), and where rows end."""
    keys = [np.cumsum(unpack(x)) for x in part.column("keys").to_pylist()]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpack(x) for x in part.column(name).to_pylist()]).astype(float), minlength=known.size).astype(np.int64) for name in ("background", "target")]
    return known, at, sums, np.cumsum([k.size for k in keys])[:-1]


def handed_back(part: pa.Table, at: np.ndarray, ends: np.ndarray, sums: list[np.ndarray], words: int) -> pa.Table:
    """SUM_SCHEMA for a part's rows: to each the sums of its own keys."""
    out = [pa.array([pack(x) for x in np.split(total[at], ends)], pa.binary()) for total in sums]
    return pa.table([part.column("part"), part.column("block"), *out, pa.array([words] + [0] * (part.num_rows - 1))], names=["part", "block", "background", "target", "words"])


def part_sums(counts: DataFrame) -> DataFrame:
    """SUM_SCHEMA: of every block and part the sums over all blocks in the order of its keys; words: the part's distinct words, in one row of it."""

    def run(part: pa.Table) -> pa.Table:
        known, at, sums, ends = merged(part)
        return handed_back(part, at, ends, sums, int((known & np.uint64(1)).sum()))

    return counts.groupBy("part").applyInArrow(run, SUM_SCHEMA)


def summed(counts: DataFrame, blocks: int, bits: int, kept: Scratch, fan: int = FAN, finer: int = FINER_BITS) -> DataFrame:
    """part_sums of counts (parts of so many bits) by levels, each over at most about `fan` of the blocks below it."""
    if blocks <= fan:
        return kept.store(part_sums(counts))
    groups = -(-blocks // fan)
    bits_up = min(bits + finer, 56)
    own = counts.withColumn("above", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def up(part: pa.Table) -> pa.Table:
        """A group's part as rows of finer parts, COUNT_SCHEMA with the group in the place of the block."""
        known, _, sums, _ = merged(part)
        rows = [(p, keys, *counts) for p, keys, *counts in cut_by_part(known, sums, bits_up)]
        above = part.column("above")[0].as_py()
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([above] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))]
        return pa.table(cols, names=["part", "block", "keys", "background", "target"])

    higher = kept.store(own.groupBy("above", "part").applyInArrow(up, COUNT_SCHEMA))
    totals = summed(higher, groups, bits_up, kept, fan, finer).withColumn("whole", F.shiftrightunsigned("part", bits_up - bits))

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        _, at, _, ends = merged(left)
        rows = sorted(right.select(["part", "background", "target", "words"]).to_pylist(), key=lambda r: r["part"])
        sums = [np.concatenate([unpack(r[name]) for r in rows]).astype(np.int64) for name in ("background", "target")]
        return handed_back(left, at, ends, sums, sum(r["words"] for r in rows))

    back = totals.withColumnRenamed("block", "above").groupBy("above", "whole")
    return kept.store(own.groupBy("above", "part").cogroup(back).applyInArrow(down, SUM_SCHEMA))


def with_target(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, text, good): good is 1 for documents that a label marks."""
    good = labels.where((F.col(label_col) == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    side = F.broadcast(good) if labels.count() <= BROADCAST_ROWS else good
    return keyed_text(docs).join(side, F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.col("good_id").isNotNull().cast("int").alias("good"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, block_tokens: int = BLOCK_TOKENS, part_bits: int = PART_BITS, fan: int = FAN) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        blocks = scratch.store(blocks_of(with_target(docs, labels), block_tokens))
        tokens_of = "aggregate(zip_with(lengths, good, (n, g) -> IF({}, n + 1, 0L)), 0L, (a, x) -> a + x)"
        row = blocks.agg(*(F.coalesce(F.sum(F.expr(tokens_of.format(f"n > 0 AND g >= {least}"))), F.lit(0)).alias(name) for name, least in (("background", 0), ("target", 1))), F.count("*").alias("blocks")).first()
        counts = block_counts(blocks, part_bits)
        if row["blocks"] > fan:
            counts = scratch.store(counts)  # read on the way up and on the way down
        sums = summed(counts, row["blocks"], part_bits, scratch, fan)
        totals = {"background": row["background"], "target": row["target"], "vocabulary": sums.agg(F.sum("words")).first()[0] or 0}

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            block = Block(left.to_pylist()[0])
            _, order = block.keys()
            rows = sorted(right.select(["part", "background", "target"]).to_pylist(), key=lambda r: r["part"])
            found = np.zeros((2, order.size), np.int64)
            for k, name in enumerate(("background", "target")):
                found[k, order] = np.concatenate([unpack(r[name]) for r in rows]).astype(np.int64)
            return block.scores(found, totals)

        return stored(blocks.groupBy("block").cogroup(sums.drop("words").groupBy("block")).applyInArrow(score, SCORE_SCHEMA))
