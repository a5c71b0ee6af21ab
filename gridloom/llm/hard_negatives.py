"""Hard negatives of anchors by blocked dense matrix products.

Components become floor(256 * x); a score is the inner product of two vectors, an integer, worked out in float64, which is
exact while |score| stays below 2**53. Whether it must is known from the largest components and the length of the vectors;
where it may not, Python's integers are used (and scores outside of 64 bits are given as the nearest that fits).

Anchors, the rows whose vec_id a modulus divides, are dealt to blocks by a hash, of about ANCHOR_BYTES. For each block:
1. its vectors are broadcast, and every task multiplies them with its rows, block by block, and keeps an anchor's best
   POSITIVES rows of its label; these lists are merged by a rank in each anchor, which drops all but a few before the shuffle;
2. the positives' scores are broadcast with the block, and every task multiplies again and keeps the best NEGATIVES of
   another label within each positive's window; merged in the same way.
Per block two passes read the table; what is broadcast is bounded by the block, and what a task gives by the block and K.

Rows with a null label or vector, or a component that is null or not finite (nor 256 times it), take no part. Vectors of different lengths
have no score with each other. Rows of an anchor's own vec_id are not its positives or negatives. Ties go by vec_id, a
null one last; a null vec_id is no anchor. Repeated rows are rows of their own among positives and negatives, an anchor
that is repeated with label and vector answers once. Empty tables, and anchors without positives, give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import shared_dir, stored

#: Bytes of an anchor block's vectors, as float64 (of short ones more are counted, as scores take room too); rows of a candidate block.
ANCHOR_BYTES, CANDIDATES = 8 << 20, 256
MODULUS, SCALE, POSITIVES, NEGATIVES = 100, 256, 5, 5
LOW, HIGH = 80, 100  # of 100 parts of the positive's score
EXACT = 2.0**53
_NULL_ID = np.iinfo(np.int64).max


def usable_rows(batch: pa.RecordBatch):
    """Of rows (vec_id, embedding, label): (ids, whether null, labels, vectors as whole numbers in float64) for each length of vectors, by id."""
    lists, label, vec_id = (batch.column(c) for c in ("embedding", "label", "vec_id"))
    values = SCALE * pc.fill_null(lists.values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    offs = lists.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fit = lists.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False) & (bad[offs[1:]] == bad[offs[:-1]])
    ids, unnamed, labels = vec_id.fill_null(_NULL_ID).to_numpy(), vec_id.is_null().to_numpy(zero_copy_only=False), label.fill_null(0).to_numpy()
    size = np.diff(offs)
    for length in np.unique(size[fit]):
        rows = np.flatnonzero(fit & (size == length))
        rows = rows[np.lexsort((unnamed[rows], ids[rows]))]
        yield ids[rows], unnamed[rows], labels[rows], np.floor(values[offs[rows][:, None] + np.arange(length)])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and of b: float64 where that is exact, else Python's integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


class Best:
    """The k best (score, id) of each of some lists, held while blocks go by; ids ascend within a block."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), -np.inf, object)
        self.id, self.null = np.full((lists, k), _NULL_ID), np.ones((lists, k), bool)
        self.least = np.full(lists, -np.inf)  # the last score as float64, which is at most rounded: equal ones are looked at
        self.last = np.full(lists, _NULL_ID)
        self.whole = False  # whether some scores don't fit into float64

    def see(self, block: np.ndarray, fit: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, which: np.ndarray) -> None:
        """block[i, j]: the score of row j for list which[i], where fit[i, j]."""
        self.whole |= block.dtype == object
        near = block.astype(np.float64)
        least = self.least[which][:, None]
        i, j = np.nonzero(fit & ((near > least) | ((near == least) & (self.whole | (ids <= self.last[which][:, None])))))
        if not len(i):
            return
        lists = which[i]
        own = np.unique(lists)
        held = np.repeat(own, self.k)
        at = np.tile(np.arange(self.k), len(own))
        score = np.concatenate([self.score[held, at], block[i, j].astype(object)])
        every, number, null = np.concatenate([held, lists]), np.concatenate([self.id[held, at], ids[j]]), np.concatenate([self.null[held, at], unnamed[j]])
        # exact order: whole numbers as they are, or their places where they don't fit into float64
        plain = np.unique(score, return_inverse=True)[1] if self.whole else score.astype(np.float64)
        order = np.lexsort((null, number, -plain, every))
        begin = np.searchsorted(every[order], own)
        take = order[begin[:, None] + np.arange(self.k)]
        self.score[own], self.id[own], self.null[own] = score[take], number[take], null[take]
        self.least[own] = score[take[:, -1]].astype(np.float64)
        self.last[own] = number[take[:, -1]]

    def rows(self):
        """(list, score, id) of all that were found."""
        lists, at = np.nonzero(self.score != -np.inf)
        found = self.score[lists, at]
        whole = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in found], np.int64)
        return lists, whole, pa.array(self.id[lists, at], mask=self.null[lists, at])


def _blocks(batches):
    """Candidate blocks of a task's rows, small ones first, so that the later ones meet lists that are filled."""
    size = 64
    for batch in batches:
        for ids, unnamed, labels, vectors in usable_rows(batch):
            at = 0
            while at < len(ids):
                yield ids[at : at + size], unnamed[at : at + size], labels[at : at + size], vectors[at : at + size]
                at, size = at + size, min(CANDIDATES, size * 4)


def _positive_pass(block, k: int):
    def run(batches):
        anchors = block.value
        best = Best(len(anchors["id"]), k)
        for ids, unnamed, labels, vectors in _blocks(batches):
            which = anchors["of"].get(vectors.shape[1])
            if which is None:
                continue
            fit = (anchors["label"][which][:, None] == labels) & ((anchors["id"][which][:, None] != ids) | unnamed)
            best.see(scores(anchors["vectors"][vectors.shape[1]], vectors), fit, ids, unnamed, which)
        lists, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(score), found], ["anchor", "score", "id"])

    return run


def _negative_pass(block, goals, k: int, low: int, high: int):
    """Lists are numbered anchor by anchor, one for each different score of its positives."""

    def run(batches):
        anchors, (starts, goal) = block.value, goals.value
        best = Best(len(goal), k)
        for ids, unnamed, labels, vectors in _blocks(batches):
            which = anchors["of"].get(vectors.shape[1])
            if which is None:
                continue
            found = scores(anchors["vectors"][vectors.shape[1]], vectors)
            fit = (anchors["label"][which][:, None] != labels) & ((anchors["id"][which][:, None] != ids) | unnamed)
            for n in range(int(np.diff(starts).max(initial=0))):
                own = np.flatnonzero(starts[which] + n < starts[which + 1])
                lists = starts[which[own]] + n
                score, some = found[own], goal[lists].astype(np.float64)[:, None]
                # low * goal <= 100 * score <= high * goal: larger scores than such goals may be rounded
                if score.dtype == object or np.abs(some).max(initial=0) >= 1 << 46:
                    score, some = score if score.dtype == object else score.astype(np.int64).astype(object), goal[lists].astype(object)[:, None]
                inside = fit[own] & (low * some <= 100 * score).astype(bool) & (100 * score <= high * some).astype(bool)
                best.see(score, inside, ids, unnamed, lists)
        lists, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(score), found], ["list", "score", "id"])

    return run


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k first of each list by score and id, with their rank."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(spark: SparkSession, rows: DataFrame, modulus: int = MODULUS, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label); see the module."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))

    def fit(batches):
        kinds = pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64()))])
        for batch in batches:
            for ids, unnamed, labels, vectors in usable_rows(batch):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), flat], [f.name for f in kinds])

    anchors = rows.where(F.col("vec_id") % modulus == 0).mapInArrow(fit, "vec_id long, label long, vector array<double>")
    anchors = stored(spark, anchors.distinct(), "anchors")
    total = anchors.agg(F.sum(8 * F.greatest(F.size("vector"), F.lit(64))).alias("bytes")).first().bytes or 0
    blocks = -(-total // block_bytes)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    if blocks > 1:  # a file for each block, so that none reads the others
        anchors.withColumn("block", F.expr(f"pmod(xxhash64(vec_id, label, vector), {blocks})")).repartition("block").write.partitionBy("block").parquet(f"{path}-anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=-1")
    for k in range(blocks):
        dealt = spark.read.schema(anchors.schema).parquet(f"{path}-anchors").where(f"block = {k}") if blocks > 1 else anchors
        own = dealt.select("vec_id", "label", "vector").toArrow()  # of about block_bytes, whatever the table
        if own.num_rows:
            _block(spark, rows, own, positives, negatives, low, high).write.parquet(f"{path}/block={k}")
    return spark.read.schema(schema).parquet(path).drop("block")


def _block(spark: SparkSession, rows: DataFrame, own: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    vectors = own.column("vector").combine_chunks()
    flat, offs = vectors.values.to_numpy(), vectors.offsets.to_numpy().astype(np.int64)
    ids, size = own.column("vec_id").to_numpy(), np.diff(offs)
    of = {int(length): np.flatnonzero(size == length) for length in np.unique(size)}
    block = spark.sparkContext.broadcast({"id": ids, "label": own.column("label").to_numpy(), "of": of, "vectors": {length: flat[offs[which][:, None] + np.arange(length)] for length, which in of.items()}})
    some = stored(spark, _first(rows.mapInArrow(_positive_pass(block, positives), "anchor int, score long, id long"), "anchor", positives), "positives")
    found = some.select("anchor", "score").distinct().toArrow()  # `positives` numbers an anchor of the block at most
    anchor, goal = found.column("anchor").to_numpy(), found.column("score").to_numpy()
    order = np.lexsort((-goal, anchor))
    anchor, goal = anchor[order], goal[order]
    starts = np.searchsorted(anchor, np.arange(len(ids) + 1))
    goals = spark.sparkContext.broadcast((starts, goal))
    best = _first(rows.mapInArrow(_negative_pass(block, goals, negatives, low, high), "list int, score long, id long"), "list", negatives)
    lists = spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(goal)), pa.int32()), "anchor": pa.array(anchor, pa.int32()), "goal": pa.array(goal), "anchor_id": pa.array(ids[anchor])}))
    pairs = lists.join(some.selectExpr("anchor", "score goal", "id positive_id"), ["anchor", "goal"])
    return pairs.join(best, "list").selectExpr("anchor_id", "positive_id", "rank", "id negative_id", "goal positive_score", "score negative_score")


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """rows whose label is the next one, (label + 1) % labels, where `every` divides vec_id."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label))
