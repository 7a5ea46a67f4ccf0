"""Packing tokenised documents into sequences by cutting-stock column generation.

A document's ids are cut into whole sequences of `capacity` and a remainder; a remainder over half a sequence gives up a
piece of exactly half, as pieces over half leave gaps that no pattern can fill. Pieces are counted by length (a
histogram of at most capacity / 2 bars, whatever the input), and the cutting-stock linear program over that histogram
is solved by column generation: a pattern is a multiset of lengths that fits a sequence, the restricted master program
prices each length, and a knapsack dynamic program over the prices finds the pattern to add. Patterns are used as often
as the solution rounded down; what is left of the histogram is packed by first fit, longest first. Documents are then
ranked within their length, in a seeded order, and the rank decides pattern, sequence and place. Only the histogram
reaches the driver. Whole sequences take no part in this: a task numbers its own as it cuts them, the counts of tasks say
where its numbers begin, and neither they nor their ids are shuffled.

Sequences of one pattern, and those of one long document, are dealt out over all sequence ids by a fixed stride, so that
reading sequences in the order of their ids meets lengths, sources and documents mixed.

The program is solved over lengths rounded up to a multiple of `grain`, which bounds its size; a sequence may then
have a few free places more, never fewer.

Defined results: a null text counts as empty and is one piece with the end id alone; every id is in exactly one piece;
repeated rows are packed once each, and pieces of one row share its number `row`; ties in rank are broken by doc_id, then
by row; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text, slices
from tidemark.session import stored

CAPACITY, GRAIN, END_ID, SEED = 1024, 2, 0, 42
#: Salts within a length: ranks of one length are counted in so many parts, so that a length of very many documents is spread.
SALTS = 64


class FileTokenizer:
    """ids of texts as a `tokenizers` file gives them, without special tokens of its own; the strings of added tokens in a text are these tokens.

    A byte-level BPE file whose merges are in the order of their results' ids has a second, faster form: the
    vocabulary as ranks. It is used where the file has that form and the text no added token, and gives the same ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks := byte_ranks(path):
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text its ids, unsigned 32-bit."""
        if self.ranked:
            return [self.ranked.encode_to_numpy(t) if t and not any(a in t for a in self.added) else self.exact(t) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids if text else [], np.uint32)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes by id, if the file is plain byte-level BPE with merges in id order; else None."""
    import json
    from pathlib import Path

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("dropout"):
        return None
    # The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the other bytes for U+0100 onwards.
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    vocab = model["vocab"]
    order = [vocab.get(m, -1) for m in merged]
    if order != sorted(set(order)) or order[:1] != [256]:
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row, nth[, ids]): whole sequences and the remainder of every document; one pass, no shuffle.

    row numbers the rows of docs, its bits from 33 on are the task; nth is the number of whole sequences that the task cut before.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, nth long" + ", ids array<int>" * keep_ids
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    half = capacity // 2

    def cuts(n: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces of n ids."""
        whole = n - n % capacity
        at = list(range(0, whole, capacity)) + [whole, *[whole + half] * (n - whole > half), n]
        return [(a, b) for a, b in zip(at, at[1:]) if a < b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = FileTokenizer(tokenizer_path)
        wholes = 0
        for batch in batches:
            for piece in slices(batch):
                cut_pieces, kept = [], []
                for doc_id, row, ids in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), tokenizer.ids(piece.column(1).to_pylist())):
                    ids = np.concatenate((ids, tail)).astype("<u4", copy=False)
                    for begin, end in cuts(len(ids)):
                        part = ids[begin:end]
                        cut_pieces.append((doc_id, begin, end - begin, zlib.crc32(part.tobytes()), len(ids), row, wholes))
                        wholes += end - begin == capacity
                        if keep_ids:
                            kept.append(part.view("<i4"))
                cols = [pa.array(x, pa.int64()) for x in zip(*cut_pieces)] or [pa.array([], pa.int64())] * 7
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "nth"]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the multiset of sizes of the highest price that fits."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = np.flatnonzero(prices > 1e-12)
    sz, pr = sizes[worth], prices[worth]
    for room in range(1, capacity + 1):
        n = np.searchsorted(sz, room, side="right")
        value[room] = value[room - 1]
        if n:
            gain = value[room - sz[:n]] + pr[:n]
            k = int(gain.argmax())
            if gain[k] > value[room] + 1e-12:
                value[room], choice[room] = gain[k], worth[k]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        k = choice[room]
        if k < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= int(sizes[k])
    return float(value[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The basis (patterns as columns), how often each is used, and the prices of the sizes; sizes ascend.

    Revised simplex on min sum(x), A x = demand: the start basis has one pattern for each size (as many as fit), the
    knapsack finds the entering column, and the inverse of the basis is updated in place, element-wise (the driver's BLAS
    threads don't survive the fork that starts the JVM). `rounds` bounds the number of pivots; stopping early leaves a
    feasible, slightly worse solution. Rounding works on whole counts, so float drift can't break the cover.
    """
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, column = best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = (inverse * column).sum(axis=1)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        x[np.abs(x) < 1e-12] = 0
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return basis, x, inverse.sum(axis=0)


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering demand exactly: the linear solution rounded down, then first fit."""
    if not len(sizes):
        return []
    basis, x, _ = column_generation(sizes, demand, capacity)
    used, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        pattern = basis[:, k].round().astype(np.int64)
        times = int(x[k] + 1e-6)
        if pattern.any():
            times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times > 0:
                used.append((pattern, times))
                left -= pattern * times
    return used + first_fit(sizes, left, capacity)


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """What rounding left over, longest first into the first sequence with room, as patterns of equal sequences."""
    used, left = [], left.copy()
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, times))
        left -= pattern * times
    return used


def plan_table(histogram: dict[int, int], capacity: int, grain: int) -> list[tuple[int, int, int, int, int, int]]:
    """(bar, first rank, ranks, items a sequence, first sequence, place of its first item) of every pattern and bar; bar is the length in grains."""
    bars = sorted(histogram)
    sizes = np.array(bars, np.int64)
    used = cutting_stock(sizes, np.array([histogram[b] for b in bars], float), capacity // grain)
    next_rank, sequence, rows = dict.fromkeys(bars, 0), 0, []
    for pattern, times in used:
        place = 0
        for k in np.flatnonzero(pattern):
            n = int(pattern[k])
            rows.append((bars[k], next_rank[bars[k]], n * times, n, sequence, place))
            next_rank[bars[k]] += n * times
            place += n
        sequence += times
    assert next_rank == histogram
    return rows


def stride(total: int) -> int:
    """A step through 0 to total - 1 that meets each number once: near the golden section of total, no divisor in common with it, products of two numbers within a long."""
    step = max(1, min(int(total * 0.618034), (1 << 62) // max(total, 1)))
    while math.gcd(step, total) > 1:
        step -= 1
    return step


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int | None = END_ID, keep_ids: bool = False, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of token_pieces with sequence_id (from 0, without gaps), offset (from 0 in each sequence, without gaps), row and, if asked for, ids."""
    if capacity % (2 * grain):
        raise ValueError("grain must divide half the capacity")
    spark = docs.sparkSession
    whole = F.col("length") == capacity
    bar = F.when(whole, F.lit(0)).otherwise(F.ceil(F.col("length") / grain)).cast("int").alias("bar")
    # Numbers of whole sequences go on from task to task, ranks of a length from salt to salt.
    part = F.when(whole, F.shiftright("row", 33)).otherwise(F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(SALTS))).cast("int").alias("part")
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col)).select("*", bar, part)
    # At most capacity / (2 grain) bars times SALTS rows and one for each task, whatever the input.
    counts = {(r["bar"], r["part"]): r["n"] for r in pieces.groupBy("bar", "part").agg(F.count("*").alias("n")).collect()}
    histogram: dict[int, int] = {}
    before = []
    for (b, p), n in sorted(counts.items()):
        before.append((b, p, histogram.get(b, 0)))
        histogram[b] = histogram.get(b, 0) + n
    wholes = histogram.pop(0, 0)
    plan = plan_table(histogram, capacity, grain)
    packed = max((q + t // n for _, _, t, n, q, _ in plan), default=0)
    # Both tables have as many rows as tasks, bars and salts, or patterns allow, so their size is bounded.
    ranks = F.broadcast(spark.createDataFrame(before or [(0, 0, 0)], "bar int, part int, before long"))
    by_bar: dict[int, list[tuple]] = {}
    for b, first, total, each, sequence, place in plan:
        by_bar.setdefault(b, []).append((first, total, each, sequence, place))
    uses = F.broadcast(spark.createDataFrame(list(by_bar.items()), "bar int, uses array<struct<first: long, total: long, each: long, sequence: long, place: long>>"))
    order = Window.partitionBy("bar", "part").orderBy(F.xxhash64(F.lit(seed), "doc_id", "start"), "doc_id", "row", "start")
    ranked = pieces.where(~whole).withColumn("own", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.join(ranks, ["bar", "part"]).withColumn("rank", F.col("own") + F.col("before")).join(uses, "bar")
    use = F.filter("uses", lambda u: (u["first"] <= F.col("rank")) & (F.col("rank") < u["first"] + u["total"]))[0]
    placed = ranked.withColumn("use", use).withColumn("nth", F.col("rank") - F.col("use.first"))
    placed = placed.withColumn("sequence", F.col("use.sequence") + F.floor(F.col("nth") / F.col("use.each")).cast("long"))
    placed = placed.withColumn("place", F.col("use.place") + F.col("nth") % F.col("use.each"))
    earlier = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
    alone = pieces.where(whole).join(ranks, ["bar", "part"]).withColumn("sequence", F.lit(packed) + F.col("nth") + F.col("before")).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "row", *["ids"] * keep_ids]
    every = placed.select(*names).unionByName(alone.select(*names))
    dealt: Column = F.col("sequence").cast("long") * F.lit(stride(packed + wholes)) % F.lit(max(packed + wholes, 1))
    return every.withColumn("sequence", dealt.cast("long")).withColumnRenamed("sequence", "sequence_id")
