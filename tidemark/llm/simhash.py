"""SimHash near-duplicates by a segment-popcount embedding.

fingerprint: XXH64 (seed 42) of every word shingle of the text, repeats included; a bit is 1 if set in over half of
the hashes. Fingerprints link at max_bits or fewer differing bits.

Links are found among distinct fingerprints, so exact copies never multiply. The 64 bits are cut into 32 segments of
2 bits; the counts of set bits in the segments are a point in a 32-dimensional grid, and the Manhattan distance of two
points is at most the number of differing bits. Of the two halves of a point one is then within max_bits // 2 = 2 of
the other's, and two lattice points within 2 have a common lattice neighbour: each half is filed under itself and its
neighbours at distance 1 (33 cells at most), and a range join becomes an equality join on cells. The join keeps a pair only if the
Manhattan distance of the whole points and then the exact count of differing bits are within the bound.

A dense group gives no pairs of all with all. First every cell has a head, by a hash of its own, and members within the bound
of the head are linked to it; the components of these stars are contracted. Pairs are then looked for only in
cells that still hold several components, and only between those; of the cells that are large even so, each is split
by the other half, of whose two quarters one must be within 2 as well. Reachability is the same as over all links.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
repeated rows give repeated results; a null doc_id never becomes a component id unless a component has no other; other
input columns are ignored.

drop_near_copies(), the pipeline's stage, isn't bound by 4 words and 4 bits: it links texts whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more, all such pairs and no others. Sets get SimHash fingerprints (each shingle once) and
go through the same grid, stars, contraction and pairs as above; a link counts once it is verified on whole texts. That decides every
pair within max_bits. At a similarity of 0.8, though, 64-bit fingerprints differ in about 10 bits and often in 17, beyond what
any grid can search whole, so the pairs of more than max_bits, and only those, have an exact way of their own. Two sets
that similar share one of the first n - ceil(0.8 n) + 1 shingles of each in any common order, so each set is filed
under those; the order begins with the rare ones, so that a line of many documents brings none together. A fingerprint of
256 bits, the parities of a set's shingles by a hash, embeds a set such that the popcount of two fingerprints' difference is at most the
size of the sets' symmetric difference: a lower bound that rules pairs out before they are verified on whole texts. Stars, contraction
and pairs between what the grid left apart follow as above: a set is held against the nearest of its cells' heads, in STAR_ROUNDS rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, keyed_text, unused
from tidemark.llm.components import connected_components
from tidemark.session import Scratch, stored

SEED = 42
#: 0101..01, a bit for each 2-bit segment.
LOW_BITS = 0x5555555555555555
SEGMENTS_PER_HALF = 16
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14
#: Near copies: words of a shingle, and the least Jaccard similarity of two sets of shingles.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, Fraction(4, 5)
#: One text in SAMPLE is sampled for common shingles; those of COMMON or more sampled texts, at most MOST_COMMON, are filed last.
#: This orders the work only: the result is the same under any order.
SAMPLE, COMMON, MOST_COMMON = 16, 6, 1 << 20
#: Rows to verify or to drop are broadcast by key up to so many, after counting them; more are joined.
BROADCAST_ROWS = 200_000
#: Open cells of more members than this are split by the other half.
DENSE = 256
#: 64-bit words of the parities of a set; rounds of stars before pairs are looked for.
PARITY_WORDS, STAR_ROUNDS = 4, 2


def shingle_hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])] or [digest(joined, SEED)]


def majorities(lists: Iterable[list[int]], n: int) -> list[int]:
    """Signed 64-bit fingerprints of n lists of hashes, which are counted in blocks."""
    totals, counts = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    pending: list[int] = []
    bounds: list[tuple[int, int]] = []

    def count() -> None:
        if not pending:
            return
        bits = np.unpackbits(np.array(pending, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, [s for _, s in bounds], axis=0, dtype=np.int32)
        np.add.at(totals, [i for i, _ in bounds], sums)
        pending.clear()
        bounds.clear()

    for i, hashes in enumerate(lists):
        counts[i] = len(hashes)
        for at in range(0, len(hashes), BLOCK):
            bounds.append((i, len(pending)))
            pending += hashes[at : at + BLOCK]
            if len(pending) >= BLOCK:
                count()
    count()
    packed = np.packbits((totals * 2 > counts[:, None]).astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.int64).ravel().tolist()


def fingerprints(texts: list[str], size: int) -> list[int]:
    """Signed 64-bit fingerprints; the work doesn't hold more than a block of bits, whatever a text's length."""
    return majorities((shingle_hashes(t, size) for t in texts), len(texts))


def fingerprint_documents(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one pass over whole texts, no shuffle."""
    return arrow_rows(keyed_text(docs, id_col, text_col), lambda c: {"doc_id": c["doc_id"], "fp": fingerprints(c["text"], shingle)}, "doc_id long, fp long")


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _segment_counts(fp: Column) -> Column:
    """The 32 bit counts, 2 bits each: a half adder, as a subtraction could overflow."""
    above = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(above).bitwiseAND(_long(LOW_BITS)).bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(_long(LOW_BITS)), 1))


def _unary(fp: Column) -> Column:
    """The counts in unary (00, 01, 11), so that differing bits are the Manhattan distance."""
    above = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(above).bitwiseAND(_long(LOW_BITS)).bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(_long(LOW_BITS)), 1))


def _cells(part: Column, side: Column | int, segments: int = SEGMENTS_PER_HALF) -> Column:
    """The cell of a part of the counts and its lattice neighbours at distance 1, with the side in bit 32."""
    steps = F.sequence(F.lit(0), F.lit(segments - 1))
    one = F.lit(1).cast("long")

    def count(j: Column) -> Column:
        return F.call_function("shiftrightunsigned", part, j * 2).bitwiseAND(F.lit(3).cast("long"))

    unit = lambda j: F.call_function("shiftleft", one, j * 2)
    up = F.transform(F.filter(steps, lambda j: count(j) < 2), lambda j: part + unit(j))
    down = F.transform(F.filter(steps, lambda j: count(j) > 0), lambda j: part - unit(j))
    return F.transform(F.concat(F.array(part), up, down), lambda c: c + F.lit(side << 32).cast("long"))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _halves(fp: Column) -> tuple[Column, Column]:
    counts = _segment_counts(fp)
    return counts.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(counts, 32)


def _rooted(points: DataFrame, links: DataFrame) -> DataFrame:
    """points (fp and any more) with root, the smallest fp that links reach."""
    plain = points.drop("root")
    roots = connected_components(links).withColumnRenamed("node", "__node")
    return plain.join(roots, F.col("fp") == F.col("__node"), "left").select(*plain.columns, F.coalesce("root", "fp").alias("root"))


def _open(filed: DataFrame, cell: str) -> DataFrame:
    """Rows of filed (cell, fp, root and any more) in cells that hold several roots, with members."""
    over = Window.partitionBy(cell)
    counted = filed.withColumn("split", F.min("root").over(over) < F.max("root").over(over)).withColumn("members", F.count("*").over(over))
    return counted.where("split").drop("split")


def fingerprint_links(points: DataFrame, max_bits: int = 4, dense: int = DENSE, confirm: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): enough links among distinct fingerprints to connect exactly those that are reachable over max_bits or fewer bits.

    points: (fp), or (fp, sim) if fp only names a point whose fingerprint is sim. confirm returns those of the pairs (a, b) that are
    to count as links: points that only others would connect are then looked for as pairs, so no confirmed link is lost.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("the grid of two halves is exact for 0 to 5 differing bits")
    given = points.columns
    sim = given[-1]
    more = lambda x, s: [F.col(f"{x}{c}").alias(f"{s}_{c}") for c in given if c != "fp"]
    low, high = _halves(F.col(sim))
    over = Window.partitionBy("cell")
    head = F.min(F.struct(F.xxhash64("cell", "fp").alias("rank"), *given)).over(over)
    a, b = (F.col(s if sim == "fp" else f"{s}_{sim}") for s in "ab")
    bound = (_differ(_unary(a), _unary(b)) <= max_bits) & (_differ(a, b) <= max_bits)
    with Scratch(points.sparkSession) as scratch:
        cells = F.explode(F.concat(_cells(low, 0), _cells(high, 1))).alias("cell")
        near = points.select(*given, cells).withColumn("head", head).select(F.col("head.fp").alias("a"), F.col("fp").alias("b"), *more("head.", "a"), *more("", "b")).where(F.expr("a <> b") & bound)
        # Of the heads within the bound the first and the last in an order of all: two links a fingerprint hold a group together.
        rank = F.struct(F.xxhash64("a").alias("rank"), "a")
        stars = scratch.store(near.groupBy("b").agg(F.array(F.min(rank)["a"], F.max(rank)["a"]).alias("heads")).select(F.explode(F.array_distinct("heads")).alias("a"), "b"))
        stars = confirm(stars) if confirm else stars
        left = scratch.store(_open(_rooted(points, stars).select(*given, "root", cells), "cell"))
        other = F.when(F.shiftrightunsigned("cell", 32) == 0, high).otherwise(low)
        quarters = F.concat(_cells(other.bitwiseAND(F.lit(0xFFFF).cast("long")), 0, SEGMENTS_PER_HALF // 2), _cells(F.shiftrightunsigned(other, 16), 1, SEGMENTS_PER_HALF // 2))
        whole = left.where(F.col("members") <= dense).select("cell", *given, "root", F.lit(-1).cast("long").alias("quarter"))
        finer = whole.unionByName(left.where(F.col("members") > dense).select("cell", *given, "root", F.explode(quarters).alias("quarter")))
        x, y = (finer.select("cell", "quarter", F.col("fp").alias(s), F.col("root").alias(f"{s}_root"), *more("", s)) for s in "ab")
        y = y.withColumnsRenamed({"cell": "b_cell", "quarter": "b_quarter"})
        pairs = x.join(y, F.expr("cell = b_cell AND quarter = b_quarter AND a < b AND a_root <> b_root") & bound).select("a", "b").distinct()
        return scratch.keep(stars.unionByName(confirm(scratch.store(pairs)) if confirm else pairs))


def label_points(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """prints (doc_id, fp and any more) with root, the smallest fp that links_of((fp)) reach, and component_id, its smallest doc_id."""
    with Scratch(prints.sparkSession) as scratch:
        points = scratch.store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = connected_components(links_of(points.select("fp")))
        named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
        ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
        labels = scratch.keep(named.join(ids, "root").select("fp", "root", "component_id"))
    return prints.join(labels, "fp")


def label_fingerprints(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """prints (doc_id, fp and any more) with root, the component's smallest fingerprint, and component_id, its smallest doc_id."""
    return label_points(prints, lambda points: fingerprint_links(points, max_bits))


def simhash_components(docs: DataFrame, max_bits: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of max_bits or fewer bits."""
    prints = stored(fingerprint_documents(docs, shingle, id_col, text_col))
    return label_fingerprints(prints, max_bits).select("doc_id", "fp", "component_id")


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles of many sampled texts, the commonest first. texts: (th, text)."""
    sampled = texts.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("text")
    work = lambda c: {"shingle": np.concatenate([shingle_set(t, size) for t in c["text"]] or [np.empty(0, np.uint64)]).view(np.int64)}
    counted = arrow_rows(sampled, work, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    top = counted.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    return np.array(top.column("shingle").to_numpy(), np.int64).view(np.uint64)


def first_shingles(shingles: np.ndarray, similarity: Fraction, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Those that a set is filed under: rare ones by hash, then common ones from the least common. common is sorted; rank is 0 for the commonest."""
    n = shingles.size
    p = n - -(-n * similarity.numerator // similarity.denominator) + 1 if n else 0
    if not common.size or not n:
        return shingles[:p]
    at = np.minimum(np.searchsorted(common, shingles), common.size - 1)
    known = common[at] == shingles
    rare = shingles[~known][:p]
    if rare.size == p:
        return rare
    rest, order = shingles[known], -rank[at[known]]
    return np.concatenate([rare, rest[np.argsort(order, kind="stable")][: p - rare.size]])


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 64 * PARITY_WORDS bits, as signed 64-bit words."""
    at = (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (64 * PARITY_WORDS)
    odd = np.bincount(at, minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def near_links(prints: DataFrame, texts: DataFrame, size: int, similarity: Fraction, max_bits: int = 4) -> DataFrame:
    """(a, b): enough links among distinct sets to connect exactly those that are reachable over pairs of the similarity or more.

    prints: (doc_id, th, fp, sim, n, bits, keys); texts: (doc_id, th, text). A set is known by fp, the hash of its shingles; sim is its
    SimHash fingerprint. Pairs of max_bits or fewer differing bits are found by fingerprint_links alone, the others by their first shingles.
    """
    over, under = similarity.numerator, similarity.denominator
    both = over + under
    cell = Window.partitionBy("key")
    words = range(PARITY_WORDS)
    sized = lambda m, n: F.least(m, n) * under >= F.greatest(m, n) * over
    apart = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in words), F.lit(0))

    def verified(pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """The pairs (a, b) whose sets, made anew from whole texts, have the similarity. Text of b meets a's, so that of a head of many is read once."""
        wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        one = scratch.store(prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("m")).select("fp", F.col("m.doc_id").alias("__id"), F.col("m.th").alias("__th")))
        side = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
        held = texts.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("fp", "text")
        held = scratch.store(held.dropDuplicates(["fp"]))
        x, y = held.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), held.select(F.col("fp").alias("b"), "text")

        def work(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": [], "b": []}
            known: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
            for fa, fb, ta, tb in zip(c["a"], c["b"], c["text_a"], c["text"]):
                if known[0] != fa:
                    known = (fa, shingle_set(ta, size))
                sa, sb = known[1], shingle_set(tb, size)
                if np.intersect1d(sa, sb, assume_unique=True).size * both >= over * (sa.size + sb.size):
                    out["a"].append(fa)
                    out["b"].append(fb)
            return out

        return scratch.store(arrow_rows(pairs.join(y, "b").join(x, "a").select("a", "b", "text_a", "text"), work, "a long, b long"))

    with Scratch(prints.sparkSession) as scratch:
        points = scratch.store(prints.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("sim", "n", "bits", "keys"))))
        links = fingerprint_links(points.select("fp", "sim"), max_bits, confirm=lambda pairs: verified(pairs, scratch))
        # The grid has decided all pairs within the bound: what follows is for those beyond it, between what it left apart.
        shared = scratch.store(_open(_rooted(points.select("fp", "keys"), links).select("fp", "root", F.explode("keys").alias("key")), "key").drop("members"))
        known = points.select(F.col("fp").alias("__fp"), "sim", "n", *(F.col("bits")[i].alias(f"w{i}") for i in words))
        filed = scratch.store(shared.join(known, F.col("fp") == F.col("__fp")).drop("__fp"))
        for k in range(STAR_ROUNDS):
            # Every cell has a head of its own; each set is held against the nearest that isn't ruled out.
            head = F.min(F.struct(F.xxhash64("key", "fp", F.lit(k)).alias("rank"), "fp", "sim", "n", "root", *(f"w{i}" for i in words))).over(cell)
            held = filed.withColumn("h", head).select("fp", "sim", "n", "root", *(f"w{i}" for i in words), F.col("h.fp").alias("head"), F.col("h.sim").alias("h_sim"), F.col("h.n").alias("m"), F.col("h.root").alias("h_root"), *(F.col(f"h.w{i}").alias(f"h{i}") for i in words))
            held = held.where((F.col("root") != F.col("h_root")) & (_differ(F.col("sim"), F.col("h_sim")) > max_bits)).withColumn("far", apart("w", "h")).where(sized("m", "n") & (F.col("far") * both <= (F.col("m") + F.col("n")) * (under - over)))
            met = held.groupBy("fp").agg(F.min(F.struct("far", "head"))["head"].alias("head"))
            stars = verified(scratch.store(met.select(F.col("head").alias("a"), F.col("fp").alias("b"))), scratch)
            links = links.unionByName(stars)
            filed = scratch.store(_open(_rooted(filed.drop("members"), links), "key"))
        x, y = (filed.select(F.col("key").alias(f"key_{s}"), F.col("fp").alias(s), F.col("sim").alias(f"sim_{s}"), F.col("n").alias(f"n_{s}"), F.col("root").alias(f"root_{s}"), *(F.col(f"w{i}").alias(f"{s}{i}") for i in words)) for s in "ab")
        # Sets that share o shingles or more share l or more of their first n - o + l, so those that meet in fewer cells aren't near.
        likely = (_differ(F.col("sim_a"), F.col("sim_b")) > max_bits) & sized("n_a", "n_b") & (apart("a", "b") * both <= (F.col("n_a") + F.col("n_b")) * (under - over))
        meet = x.join(y, F.expr("key_a = key_b AND a < b AND root_a <> root_b") & likely).groupBy("a", "b", "n_a", "n_b").count()
        least = F.expr(f"({over} * (n_a + n_b) + {both - 1}) div {both}")
        first = lambda n: F.expr(f"{n} - ({n} * {over} + {under - 1}) div {under} + 1")
        meets = least + F.least(first("n_a") - F.col("n_a"), first("n_b") - F.col("n_b"))
        rest = verified(scratch.store(meet.where(F.col("count") >= meets).select("a", "b")), scratch)
        return scratch.keep(links.unionByName(rest))


def _first_rows(docs: DataFrame, text_hash: Column, labelled: DataFrame) -> DataFrame:
    """docs with one row of each root. labelled: (doc_id, th, root).

    Rows are marked by keys alone: texts move only if more than BROADCAST_ROWS keys are marked, and then once.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    kept = labelled.groupBy("root").agg(F.min(rank).alias("m")).select("root", F.col("m.doc_id").alias("k_id"), F.col("m.th").alias("k_th"))
    held = labelled.groupBy("root", "doc_id", "th").count()
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th"))
    # A row that stays has no mark unless it is repeated.
    mark_id, mark_th, stays = unused(docs, "mark_id", "mark_th", "stays")
    marks = stored(held.join(kept, "root").withColumn("same", same).where("NOT same OR count > 1").select(F.col("doc_id").alias(mark_id), F.col("th").alias(mark_th), F.col("same").alias(stays)))
    few = marks.count() <= BROADCAST_ROWS
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(mark_id)) & (text_hash == F.col(mark_th))
    once = docs.join(F.broadcast(marks) if few else marks, here, "left").where(F.col(stays).isNull()).select(*docs.columns)
    again = marks.where(stays)
    if not again.take(1):
        return once
    repeated = docs.join(F.broadcast(again) if few else again, here)
    return once.unionByName(repeated.dropDuplicates([mark_id, mark_th]).select(*docs.columns))


def near_dedup(docs: DataFrame, max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each component: of its smallest doc_id (nulls last), ties by a hash of the text, of equal rows one. All columns are kept."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    hashed = keyed_text(docs).withColumn("th", text_hash)
    prints = stored(arrow_rows(hashed, lambda c: {"doc_id": c["doc_id"], "th": c["th"], "fp": fingerprints(c["text"], shingle)}, "doc_id long, th long, fp long"))
    return _first_rows(docs, text_hash, label_fingerprints(prints, max_bits).select("doc_id", "th", "root"))


def drop_near_copies(docs: DataFrame, similarity: Fraction = NEAR_SIMILARITY, shingle: int = NEAR_SHINGLE, max_bits: int = 4) -> DataFrame:
    """docs with one row of each component of near copies by Jaccard similarity; which row, and ties, as in near_dedup. max_bits: the grid's, it orders the work only."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    hashed = keyed_text(docs).withColumn("th", text_hash)
    common = common_shingles(hashed, shingle)
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))

    def work(c: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, shingle) for t in c["text"]]
        fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        sims = majorities((s.tolist() for s in sets), len(sets))
        return {"doc_id": c["doc_id"], "th": c["th"], "fp": fps, "sim": sims, "n": [s.size for s in sets], "bits": [parities(s) for s in sets], "keys": [first_shingles(s, similarity, *shared.value).view(np.int64) for s in sets]}

    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.store(arrow_rows(hashed, work, "doc_id long, th long, fp long, sim long, n int, bits array<long>, keys array<long>"))
        labelled = stored(label_points(prints.select("doc_id", "th", "fp"), lambda _: near_links(prints, hashed, shingle, similarity, max_bits)).select("doc_id", "th", "root"))
    return _first_rows(docs, text_hash, labelled)


def component_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
