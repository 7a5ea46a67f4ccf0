"""Toxicity by maximum-scoring segments of token log-odds.

Training: labelled rows outside the held-out fold, the TRAIN_ROWS of the smallest hashes of their ids at most, and one of those
that share the smallest shingle hash (near copies would vote together), give the number of toxic and clean texts that
hold each word and each word beginning (stems, so that inflected forms count together). A token's weight is the log-odds
ratio of the two, of either sign, under a Dirichlet prior in proportion to its pooled count. A token whose likelihood ratio
doesn't exceed what the largest of so many tests reaches by chance says nothing and has weight 0. Every token costs TOKEN_COST besides,
so that a segment's expected score is negative.

Scoring: one linear scan over a text finds all maximal segments (disjoint, each of the highest sum around it). By
Karlin and Altschul a segment of score S in n tokens has E = K n exp(-lambda S) chance equals in clean text: lambda
solves sum p exp(lambda s) = 1 over the clean token scores and K is the median of the extreme-value distribution of the
clean training texts. Segments of E <= SIGNIFICANT are passages. A document's score is a logistic function of its best and
summed bit scores, fitted on the training rows.

Labels, language, source and doc_id are never inputs of a score. Whole texts are scanned. Training rows are bounded by
TRAIN_ROWS, so their ids and two numbers of each may pass through the driver, as may the weights, which only significant tokens of those texts have.

Defined results: a null text counts as empty and has the score of no evidence; rows without a label or doc_id aren't
trained on; without a label of either kind all scores are 0; repeated rows are scored alike. Texts of any length are scanned whole, an
empty table gives no rows, and extra columns, whatever their names, don't count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, arrow_rows, keyed_text, slices
from tidemark.llm.simhash import shingle_hashes
from tidemark.session import Scratch

#: Labelled rows that training uses at most.
TRAIN_ROWS = 40_000
#: Parts of the labels by a hash: those beyond what training needs aren't sorted.
SAMPLE_BUCKETS = 4096
STEM, PRIOR, MIN_COUNT, TOKEN_COST, SIGNIFICANT, THRESHOLD = 4, 50.0, 3, 0.35, 0.05, 0.3
MAX_WEIGHT = 6.0
STEM_MARK = b"\x00"
_TRIM = b".,;:!?\"'()[]{}*#$%&-"


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def tokens(text: str) -> list[bytes]:
    return [w.strip(_TRIM) for w in text.lower().encode("utf-8", "surrogatepass").split()]


def stem(word: bytes) -> bytes | None:
    """The first letters of a word that is longer than they are."""
    head = word[: STEM * 4].decode("utf-8", "ignore")[:STEM].encode()
    return STEM_MARK + head if len(head) < len(word) else None


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): the rows (text, toxic) that hold each word or stem, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        names = ["token", "toxic", "clean"]

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            made = [pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for piece in slices(batch):
                for text, toxic in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    held = set(tokens(text))
                    counts[toxic].update(held)
                    counts[toxic].update({x for w in held if (x := stem(w)) is not None})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "token binary, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class SegmentModel:
    """Token weights and the extreme-value and logistic parameters."""

    def __init__(self, weights: dict[bytes, float], rate: float) -> None:
        self.weights, self.rate = weights, rate
        self.log_k, self.logistic = 0.0, (0.0, 0.0, 0.0)
        self.memo: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        found = self.weights.get(word)
        if found is None and (s := stem(word)) is not None:
            found = self.weights.get(s)
        return -TOKEN_COST if found is None else found

    def scores(self, text: str) -> list[float]:
        memo, out = self.memo, []
        if len(memo) > 500_000:
            memo.clear()
        for w in tokens(text):
            s = memo.get(w)
            if s is None:
                s = memo[w] = self.weight(w)
            out.append(s)
        return out

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens and all maximal segments of positive score."""
        scores = self.scores(text)
        return len(scores), maximal_segments(scores)

    def log_e(self, score: float, n: int) -> float:
        """Natural log of the number of chance equals."""
        return self.log_k + math.log(max(n, 1)) - self.rate * score

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Bit-like scores of the best segment and of all significant ones."""
        excess = sorted((-self.log_e(s, n) for _, _, s in found), reverse=True)
        best = excess[0] if excess else -self.log_e(0.0, n)
        return max(-20.0, min(best, 60.0)), math.log1p(sum(x for x in excess if x > -math.log(SIGNIFICANT)))

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        a, b, c = self.logistic
        x, y = self.features(n, found)
        z = max(-30.0, min(30.0, a + b * x + c * y))
        return 1 / (1 + math.exp(-z))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass, after Ruzzo and Tompa.

    Kept candidates carry the cumulative sums before their first and after their last token; a candidate is merged with
    the last earlier one that starts lower, unless that one also ends at least as high.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, index of the last candidate that starts lower
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, low, high = i, i + 1, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def token_weights(rows: list[tuple[bytes, int, int]], n_toxic: int, n_clean: int, tests: int) -> dict[bytes, float]:
    """Weights of significant tokens from (token, toxic, clean) texts: log-odds ratios under the Dirichlet prior of the pooled counts, less the cost of a token."""
    total, out = n_toxic + n_clean, {}
    for token, toxic, clean in rows:
        both = toxic + clean
        expected = both * n_toxic / total
        ratio = 2 * sum(o * math.log(o / e) for o, e in ((toxic, expected), (clean, both - expected)) if o)
        if both < MIN_COUNT or ratio < 2 * math.log(max(tests, 2)):
            continue
        prior = PRIOR * both / total
        odds = [math.log((y + prior) / (n + PRIOR - y - prior)) for y, n in ((toxic, n_toxic), (clean, n_clean))]
        out[token] = max(-MAX_WEIGHT, min(odds[0] - odds[1], MAX_WEIGHT)) - TOKEN_COST
    return out


def karlin_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum(share * exp(lambda * scores)) = 1, by bisection; the expected score must be negative."""
    if not (scores > 0).any() or float((scores * share).sum()) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while float((share * np.exp(np.minimum(high * scores, 700))).sum()) < 1 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float((share * np.exp(np.minimum(mid * scores, 700))).sum()) < 1 else (low, mid)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression on two standardised features by damped Newton steps; element-wise, as only three parameters are fitted."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    cols = [np.ones(len(y)), *((x - mean) / spread).T]
    beta = [0.0] * 3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(sum(b * c for b, c in zip(beta, cols)), -30, 30)))
        grad = [float(((y - p) * c).sum()) - 0.5 * b for b, c in zip(beta, cols)]
        h = [[float((p * (1 - p) * u * v).sum()) + 0.5 * (i == j) for j, v in enumerate(cols)] for i, u in enumerate(cols)]
        step = _solve3(h, grad)
        beta = [b + max(-2.0, min(2.0, s)) for b, s in zip(beta, step)]
    b1, b2 = beta[1] / spread[0], beta[2] / spread[1]
    return float(beta[0] - b1 * mean[0] - b2 * mean[1]), float(b1), float(b2)


def _solve3(h: list[list[float]], g: list[float]) -> list[float]:
    rows = [[*r, v] for r, v in zip(h, g)]
    for i in range(3):
        pivot = max(range(i, 3), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(3):
            if k != i:
                f = rows[k][i] / rows[i][i]
                rows[k] = [a - f * b for a, b in zip(rows[k], rows[i])]
    return [rows[i][3] / rows[i][i] for i in range(3)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> SegmentModel | None:
    """A model from labels (doc_id, toxic) outside the held-out fold; None if they lack one of the two classes."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("long").alias("toxic"))
    spark = docs.sparkSession
    # Repeats of an id are one label, toxic if any of them is. A histogram of the hash bounds what is sorted for the smallest.
    rank = F.xxhash64("label_id")
    bucket = F.shiftrightunsigned(rank, 64 - SAMPLE_BUCKETS.bit_length() + 1)
    hashed = usable.groupBy("label_id").agg(F.max("toxic").alias("toxic")).withColumn("bucket", bucket.cast("int")).withColumn("within", rank.bitwiseAND(F.lit((1 << 52) - 1)))
    held, last = 0, 0
    for r in sorted(hashed.groupBy("bucket").agg(F.count("*").alias("n")).collect()):
        held, last = held + r["n"], r["bucket"]
        if held >= train_rows:
            break
    picked: dict[int, int] = dict(tuple(r) for r in hashed.where(F.col("bucket") <= last).orderBy("bucket", "within", "label_id").select("label_id", "toxic").limit(train_rows).collect())
    if len(set(picked.values())) < 2:
        return None

    with Scratch(spark) as kept:
        chosen = F.broadcast(spark.createDataFrame(list(picked.items()), "label_id long, toxic long"))
        # A doc_id that comes several times is one row, of its least text: so there are at most train_rows, whatever the table.
        found = keyed_text(docs, id_col, text_col).join(chosen, F.col("doc_id") == F.col("label_id"))
        texts = kept.store(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
        return _trained(spark, texts, picked)


def _trained(spark: SparkSession, texts: DataFrame, picked: dict[int, int]) -> SegmentModel | None:
    """A model from (doc_id, toxic, text), one row a doc_id."""
    keys = arrow_rows(texts.select("text", "doc_id"), lambda c: {"doc_id": c["doc_id"], "key": [min(shingle_hashes(t, 5), default=0) - (1 << 63) for t in c["text"]]}, "doc_id long, key long")
    apart = {r[0]: picked[r[0]] for r in keys.groupBy("key").agg(F.min("doc_id")).select("min(doc_id)").collect()}
    n_toxic = sum(apart.values())
    n_clean = len(apart) - n_toxic
    if not n_toxic or not n_clean:
        return None
    rows = texts.join(F.broadcast(spark.createDataFrame([(i,) for i in apart], "doc_id long")), "doc_id", "left_semi")
    counted = token_counts(rows).persist()
    tests = counted.count()
    both = F.col("toxic") + F.col("clean")
    expected = both * (n_toxic / (n_toxic + n_clean))
    part = lambda c, e: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / e)).otherwise(0.0)
    # A little below the bound, which token_weights applies exactly.
    likely = counted.where((both >= MIN_COUNT) & (part("toxic", expected) + part("clean", both - expected) >= 0.999 * math.log(max(tests, 2))))
    best = sorted((bytes(r[0]), r[1], r[2]) for r in likely.collect())
    weights = token_weights(best, n_toxic, n_clean, tests)
    counted.unpersist()
    model = SegmentModel(weights, 1.0)

    def measure(c: dict[str, list]) -> dict[str, list]:
        """Segments, and the clean token scores as counts of rounded values."""
        out: dict[str, list] = {"toxic": c["toxic"], "n": [], "segments": [], "hist": []}
        for t in c["text"]:
            scores = model.scores(t)
            out["n"].append(len(scores))
            out["segments"].append([s for _, _, s in maximal_segments(scores)])
            out["hist"].append([{"s": k, "n": n} for k, n in Counter(round(s * 4) for s in scores).items()])
        return out

    measured = arrow_rows(rows.select("text", "toxic"), measure, "toxic long, n long, segments array<double>, hist array<struct<s: long, n: long>>").persist()
    hist = measured.where("toxic = 0").select(F.explode("hist").alias("x")).groupBy("x.s").agg(F.sum("x.n").alias("n")).collect()  # as many rows as rounded weights
    scores, share = np.array([r[0] / 4 for r in hist] or [0.0]), np.array([float(r[1]) for r in hist] or [1.0])
    model.rate = karlin_rate(scores, share / share.sum())
    tops = measured.where("toxic = 0").select("n", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("best")).collect()  # at most train_rows
    clean = [model.rate * best - math.log(max(n, 1)) for n, best in tops]
    model.log_k = float(np.median(clean)) + math.log(math.log(2)) if clean else 0.0
    shared = (model.rate, model.log_k)

    def summarise(c: dict[str, list]) -> dict[str, list]:
        known = SegmentModel({}, shared[0])
        known.log_k = shared[1]
        both = [known.features(n, [(0, 0, s) for s in segments]) for n, segments in zip(c["n"], c["segments"])]
        return {"toxic": c["toxic"], "x": [x for x, _ in both], "y": [y for _, y in both]}

    seen = arrow_rows(measured.select("toxic", "n", "segments", F.lit("").alias("text")), summarise, "toxic long, x double, y double").collect()  # two numbers of at most train_rows texts
    measured.unpersist()
    model.logistic = fit_logistic(np.array([[r["x"], r["y"]] for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    return model


SCORE_SCHEMA = "doc_id long, score double, n_tokens long, passages array<struct<start: long, end: long, score: double, log_e: double>>"


def score_documents(docs: DataFrame, model: SegmentModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORE_SCHEMA of every row of docs: the probability and every significant passage (token positions); one pass, no shuffle."""

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": c["doc_id"], "score": [], "n_tokens": [], "passages": []}
        for t in c["text"]:
            n, found = model.segments(t) if model else (len(t.split()), [])
            out["score"].append(model.probability(n, found) if model else 0.0)
            out["n_tokens"].append(n)
            rated = [(a, b, s, model.log_e(s, n)) for a, b, s in found]
            out["passages"].append([{"start": a, "end": b, "score": s, "log_e": e} for a, b, s, e in rated if e <= math.log(SIGNIFICANT)])
        return out

    return arrow_rows(keyed_text(docs, id_col, text_col), work, SCORE_SCHEMA)


def toxic_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns and the number of passages."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches threshold; all columns are kept, in one pass."""
    model = train(docs, labels)
    if model is None:
        return docs

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return batch.filter(pa.array([model.probability(*model.segments(t or "")) < threshold for t in texts], pa.bool_()))

    return arrow_batches(docs, work)
