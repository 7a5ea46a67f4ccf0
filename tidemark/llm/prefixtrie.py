"""The trie of shared beginnings of conversations, with what each shared beginning would save.

Every turn gets a digest and a word count, and texts go no further. A prefix is known by the digests of its turns, each
mixed with its position and put together by exclusive or: that is associative, so a conversation of any length is cut
into chunks whose prefixes are worked out apart, and a prefix's parent is the same value without its last turn. Rows of
one prefix are one node, its edge leads to its parent's digest. Leaf counts and savings reach all ancestors by pointer
jumping: in round k every node adds what it has gathered to the node 2^k above and takes that one's pointer, so there
are as many rounds as the depth has binary digits.

Defined results: rows without a conv_id belong to no conversation; a null role or text counts as empty; turns are
ordered by turn (null first), then role, then text's digest; repeated turns are turns of their own; an empty table has
no node, not even a root; a conversation without rebuilt turns ends at the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch, cut

#: Conversations that share a beginning are those of equal conv_id - conv_id % GROUP; fewer than HEADS turns are taken from it.
GROUP, HEADS = 20, 4
#: Turns of a conversation, and ids of a node's ends, that one group holds at most.
CHUNK, ENDS = 256, 4096
#: Keys with more than one row in HOT are looked up by broadcast: there are fewer than HOT of them.
HOT = 500
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, digest, words): what the trie needs of a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.sha2(whole, 256)).alias("digest"), words.alias("words"))


def numbered(turns: DataFrame, kept: Scratch) -> DataFrame:
    """(conv_id, nr, digest, words), nr 1 for a conversation's first turn: numbered within ranges of the order, to which the counts of earlier ranges are added, so a long conversation is spread over tasks.

    Ranges are drawn by a sample, so they are stored before they are counted: another evaluation may draw others.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ranged = turns.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    own = kept.store(ranged.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:])).cast("long")).select("conv_id", "range", "own", "digest", "words"))
    last = own.groupBy("conv_id", "range").agg(F.max("own").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Conversations in several ranges only: two ranges meet in one conversation at most, so there are fewer such rows than ranges.
    before = last.select("conv_id", "range", F.sum("n").over(earlier).alias("before")).where("before > 0")
    return own.join(F.broadcast(before), ["conv_id", "range"], "left").select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("nr"), "digest", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, chunk, first, size, turns): each conversation as chunks of turns, numbered from `first`; size counts the whole.

    It begins with the first h turns of conversation conv_id - conv_id % group, h = crc32(conv_id) % heads, and goes on
    with its own turns after its first h. A conversation has at least one chunk, which may be empty.
    """
    item = F.struct("nr", "digest", "words")
    own = turns.groupBy("conv_id", F.expr(f"(nr - 1) div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("own"))
    sizes = own.groupBy("conv_id").agg(F.sum(F.size("own")).cast("long").alias("own_size"))
    begins = own.where(f"chunk = 0 AND conv_id % {group} = 0").select(F.col("conv_id").alias("head"), F.slice("own", 1, heads - 1).alias("begin"))
    none = F.array().cast(own.schema["own"].dataType)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    taken = sizes.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(begins, "head", "left").withColumn("h", h)
    taken = taken.select("conv_id", "h", "own_size", F.slice(F.coalesce("begin", none), F.lit(1), F.col("h")).alias("begin"))
    taken = taken.withColumn("got", F.size("begin")).withColumn("size", F.col("got") + F.greatest(F.col("own_size") - F.col("h"), F.lit(0)))
    # Rows of a conversation are chunks here, so even one of a third of all turns is few rows.
    rows = own.join(taken, "conv_id")
    start = F.col("chunk") == 0
    first = F.when(start, F.lit(1)).otherwise(F.col("chunk") * CHUNK + 1 + F.col("got") - F.col("h")).cast("long")
    whole = F.when(start, F.concat("begin", F.expr("filter(own, x -> x.nr > h)"))).otherwise(F.col("own"))
    return rows.select("conv_id", "chunk", first.alias("first"), "size", whole.alias("turns"))


def prefixes(chunks: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, words, is_end): every prefix but the empty one of every conversation; (a, b) is its digest, (pa, pb) that of the prefix one turn shorter."""
    kind = "array<struct<a: long, b: long, u: long, v: long, words: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(4)
            offsets = turns.offsets.to_numpy()
            digests, words = turns.values.field("digest").to_pylist(), turns.values.field("words")
            own = bytearray()
            for first, begin, end in zip(batch.column(2).to_pylist(), offsets, offsets[1:]):
                for nr, digest in enumerate(digests[begin:end], first):
                    own += hashlib.sha256(nr.to_bytes(8, "big") + digest).digest()[:16]
            lanes = np.frombuffer(bytes(own), "<i8").reshape(-1, 2)
            sums = lanes.copy()
            base = offsets[0]
            for begin, end in zip(offsets - base, offsets[1:] - base):
                np.bitwise_xor.accumulate(lanes[begin:end], axis=0, out=sums[begin:end])
            totals = [sums[e - 1].tolist() if e > b else [0, 0] for b, e in zip(offsets - base, offsets[1:] - base)]
            fields = [pa.array(np.ascontiguousarray(c)) for c in (sums[:, 0], sums[:, 1], lanes[:, 0], lanes[:, 1])] + [words.slice(base, offsets[-1] - base)]
            made = pa.ListArray.from_arrays(pa.array((offsets - base).astype(np.int32)), pa.StructArray.from_arrays(fields, ["a", "b", "u", "v", "words"]))
            ta, tb = (pa.array([t[k] for t in totals], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ta, tb, made], names=["conv_id", "chunk", "first", "size", "ta", "tb", "made"])

    local = chunks.mapInArrow(run, f"conv_id long, chunk long, first long, size long, ta long, tb long, made {kind}")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long"))
    rows = local.select("conv_id", "first", "size", before("ta").alias("xa"), before("tb").alias("xb"), "made").select("*", F.posexplode("made").alias("at", "m"))
    rows = rows.select("conv_id", "size", (F.col("first") + F.col("at")).alias("depth"), F.col("m.a").bitwiseXOR(F.col("xa")).alias("a"), F.col("m.b").bitwiseXOR(F.col("xb")).alias("b"), "m.u", "m.v", "m.words")
    return rows.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("u")).alias("pa"), F.col("b").bitwiseXOR(F.col("v")).alias("pb"), "words", (F.col("depth") == F.col("size")).alias("is_end"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv_id): the SHA-256 of a node's ids, ascending, joined by commas.

    Ids are joined by ranges of ENDS numbers; then a node's ranges stream through one task in their order, which a
    running digest can't do without, but which holds one range at a time.
    """
    bucket = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(ENDS))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("a", "b", bucket.alias("bucket")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (a, b) != node:
                    if sha is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digest_rows(done)
        if sha is not None:
            yield _digest_rows([(*node, sha.hexdigest())])

    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "bucket").mapInArrow(run, "a long, b long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=["a", "b", "ends_sha256"])


def looked_up(rows: DataFrame, keys: tuple[str, str], known: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with the columns of known (a, b, more) at their keys. hot has the (a, b) of the keys of very many rows: they are few, and so broadcast; the rest is shuffled."""
    here = known.select(*(F.col(c).alias(k) for c, k in zip(("a", "b"), keys)), *[c for c in known.columns if c not in ("a", "b")])
    few = hot.select(*(F.col(c).alias(k) for c, k in zip(("a", "b"), keys)))
    top = F.broadcast(here.join(F.broadcast(few), list(keys), "left_semi"))
    return rows.join(top, list(keys)).unionByName(rows.join(F.broadcast(few), list(keys), "left_anti").join(here, list(keys)))


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, **columns: str) -> DataFrame:
    """A row a node: a, b (its digest), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. columns as of turn_digests."""
    with Scratch(conversations.sparkSession) as kept:
        turns = kept.store(turn_digests(conversations, **columns))
        chunks = kept.store(rebuilt(numbered(turns, kept), group, heads))
        rows = kept.store(prefixes(chunks))
        zero = F.lit(0).cast("long")
        root = chunks.where("chunk = 0").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        root = root.select(zero.alias("a"), zero.alias("b"), "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("words"), "n_convs")
        plain = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"), F.count("*").alias("n_convs"))
        ends = rows.where("is_end").select("a", "b", "conv_id").unionByName(chunks.where("chunk = 0 AND size = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
        nodes = kept.store(plain.select(*root.columns).unionByName(root))
        children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
        nodes = kept.store(nodes.join(children, ["a", "b"], "left").join(end_digests(ends), ["a", "b"], "left").fillna({"n_children": 0, "ends_sha256": EMPTY_SHA}))
        sums = rolled_up(nodes, kept)
        total = nodes.count()
        named = looked_up(nodes.where("depth > 0"), ("pa", "pb"), nodes.select("a", "b", F.col("conv_id").alias("parent_conv_id")), nodes.where(F.col("n_children") > total / HOT).select("a", "b"))
        named = named.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
        out = named.join(sums, ["a", "b"])
        return cut(out.select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def rolled_up(nodes: DataFrame, kept: Scratch) -> DataFrame:
    """(a, b, n_leaves, saved_tokens), summed over each node's subtree by pointer jumping.

    Before round k a node holds the sums over its descendants nearer than 2^k and points to its ancestor 2^k above;
    those that have one add to it, and those twice as deep take its pointer.
    """
    start = nodes.select("a", "b", "depth", "pa", "pb", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    deepest, total = start.agg(F.max("depth"), F.count("*")).first()
    held, step = start, 1
    while step <= (deepest or 0):
        adding = held.where(F.col("depth") >= step)
        gathered = adding.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"), F.count("*").alias("n"))
        gathered = kept.store(gathered)
        values = held.join(gathered.drop("n"), ["a", "b"], "left").select(
            "a", "b", "depth", "pa", "pb", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")
        )
        deep = F.col("depth") >= 2 * step
        far = looked_up(values.where(deep), ("pa", "pb"), held.select("a", "b", F.col("pa").alias("qa"), F.col("pb").alias("qb")), gathered.where(F.col("n") > total / HOT).select("a", "b"))
        far = far.select("a", "b", "depth", F.col("qa").alias("pa"), F.col("qb").alias("pb"), "n_leaves", "saved_tokens")
        none = F.lit(None).cast("long")
        held = kept.store(far.unionByName(values.where(~deep).select("a", "b", "depth", none.alias("pa"), none.alias("pb"), "n_leaves", "saved_tokens")))
        step *= 2
    return held.select("a", "b", "n_leaves", "saved_tokens")


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The nodes of prefix_trie without their digests."""
    return prefix_trie(conversations).drop("a", "b")
