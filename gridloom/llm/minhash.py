"""Near-duplicate removal by one-permutation MinHash: documents whose sets of two-word shingles are alike by 0.8 or more.

1. One pass makes each text's shingle set, a set id (texts of equal sets are one node from here on), and a signature: one
   hash of each shingle picks one of BINS bins and a value, a bin keeps its least value. Empty bins are filled by optimal
   densification: each walks the bins in an order of its own, a fixed random one, and copies the first that isn't empty,
   so two sets agree in any bin with the probability of their similarity.
2. ROWS bins make a band; equal bands share a bucket. A bucket is a star: each member is a candidate of the bucket's
   leader, its largest set id, so a bucket of m sets gives m - 1 edges. One priority for all buckets lets edges coincide.
3. Candidates whose sizes allow the similarity, and whose signatures agree in SCREEN of the bins (small sets always pass),
   are compared on their full sets, made again from the texts. Links become components, stars first.
4. A star doesn't compare two members with each other. Where a bucket still holds several components, each member outside
   of its largest one meets the members of the others, in the same way. Of buckets of over GROUP sets the sets are cut into
   columns of about GROUP sets of one leader, and of one component where it has so many, and pairs of columns are compared
   as a whole, so no row a pair of sets is made. Then components are joined once more. So every pair of a bucket is
   linked, compared, or in one component already.

A linked pair meets in some bucket but for one in 8 million at the similarity of exactly 0.8, and far fewer above; the
screen loses fewer than one in 10**9. No bucket is cut, whatever its size.

Nulls and texts without words: n_shingles 0, linked with nothing, kept. Shorter texts than two words are one shingle.
Repeated rows: each input row gives an output row, rows of one doc_id are kept or go together; a null doc_id is a row
without a say in the component, kept only where it is linked with no id. Other columns pass unread. Set ids are 64-bit
hashes, checked against a second hash; on a clash the work starts again under another seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import components, mix, star_components, stored, text_slices
from gridloom.llm.ngram_join import GROUP, linked_pairs, set_ids, sets_of, shingle_sets

WORDS, PERCENT = 2, 80
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Share of bins that must agree before full sets are compared, for sets of SMALL shingles or more.
SCREEN, SMALL = 0.58, 64
#: The order in which each bin, if empty, asks the others: rank of bin j for bin i.
_ORDER = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x5DEECE66D)).reshape(BINS, BINS), axis=1).argsort(axis=1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set of hashes that isn't empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full((len(sets), BINS), np.iinfo(np.uint64).max)
    if not size.sum():
        return out
    h = mix(np.concatenate(sets) ^ np.uint64(0xC2B2AE3D27D4EB4F))
    at = np.repeat(np.arange(len(sets)), size) * BINS + ((h >> np.uint64(48)) * np.uint64(BINS) >> np.uint64(16)).astype(np.int64)
    value = h & np.uint64((1 << 48) - 1)
    order = np.argsort(at, kind="stable")
    at, value = at[order], value[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out.ravel()[at[first]] = np.minimum.reduceat(value, first)
    full = out != np.iinfo(np.uint64).max
    for i in np.flatnonzero((size > 0) & ~full.all(axis=1)):
        there, empty = np.flatnonzero(full[i]), np.flatnonzero(~full[i])
        out[i, empty] = out[i, there[_ORDER[np.ix_(empty, there)].argmin(axis=1)]]
    return out


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature, the band's number included."""
    parts = signs.reshape(len(signs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key + parts[:, :, k])
    return key


def _light_pass(words: int, seed: int):
    """(doc_id, n, sid, check) of each document, and of each set that a task sees anew its band keys and signature, a byte a bin."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, words, seed)
                size, sid, check = set_ids(sets)
                new = np.zeros(len(sets), bool)
                for i, s in enumerate(sid.tolist()):
                    if size[i] and s not in seen:
                        seen.add(s)
                        new[i] = True
                if len(seen) > 1_000_000:
                    seen = set()
                signs = signatures([sets[i] for i in np.flatnonzero(new)])
                place = np.cumsum(new) - 1
                keys, marks = band_keys(signs).view(np.int64), (signs & np.uint64(255)).astype(np.uint8)
                bands = pa.array([keys[place[i]] if new[i] else None for i in range(len(sets))], pa.list_(pa.int64()))
                sign = pa.array([marks[place[i]].tobytes() if new[i] else None for i in range(len(sets))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(sid, mask=size == 0), pa.array(check, mask=size == 0), bands, sign], ["doc_id", "n", "sid", "check", "bands", "sign"])

    return run


def _screened(batches):
    """Of pairs with both sizes and signatures those that may be linked."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
        signs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("x", "y")]
        keep = (np.minimum(n, m) < SMALL) | ((signs[0] == signs[1]).sum(axis=1) >= SCREEN * BINS)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _column_links(percent: int):
    """Of rows (x, y, same), x and y being columns of (comp, shingles), or one column twice: links between their components, as many as join them."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same").to_pylist(), strict=True):
                one, two = ([m.values.to_numpy().view(np.uint64) for m in c.values.field("shingles")] for c in (x, y))  # sorted as such
                was, other = (np.array(c.values.field("comp").to_pylist()) for c in (x, y))
                now = {c: c for c in (*was.tolist(), *other.tolist())}
                size = np.array([len(t) for t in two])
                whole, starts = np.concatenate(two), np.concatenate([[0], np.cumsum(size)[:-1]])
                for i, own in enumerate(one):
                    at = np.searchsorted(own, whole)
                    at[at == len(own)] = 0
                    common = np.add.reduceat(own[at] == whole, starts, dtype=np.int64)
                    hits = np.flatnonzero(common * (100 + percent) >= percent * (len(own) + size))
                    for j in hits[hits > i] if same else hits:
                        old, new = now[int(was[i])], now[int(other[j])]
                        if old != new:
                            a.append(int(was[i]))
                            b.append(int(other[j]))
                            now = {c: new if k == old else k for c, k in now.items()}
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); see the module. The bands are made for 0.8 or more."""
    if percent < PERCENT:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    light = stored(spark, docs.mapInArrow(_light_pass(words, seed), "doc_id long, n long, sid long, check long, bands array<long>, sign binary"), "signed")
    nodes = light.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.max("n").alias("n"))
    nodes = stored(spark, nodes, "nodes")
    total = nodes.agg(F.max(F.col("c0") != F.col("c1")), F.count("*")).first()
    if total[0]:
        return near_duplicates(spark, docs, words, percent, seed + 1)
    fresh = light.where("sign is not null")
    buckets = stored(spark, fresh.select("sid", F.explode("bands").alias("key")).distinct(), "bands")
    heads = buckets.groupBy("key").agg(F.max("sid").alias("leader"), F.count("*").alias("m")).where("m > 1")
    heads = stored(spark, heads, "heads")
    buckets = stored(spark, buckets.join(heads, "key").select("key", "sid", "leader", "m"), "buckets")  # of two sets or more
    signs = stored(spark, fresh.select("sid", "n", "sign").join(buckets.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]), "signs")

    def links(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), each once, those that are linked."""
        some = pairs.join(signs.selectExpr("sid a", "n", "sign x"), "a").join(signs.selectExpr("sid b", "n m", "sign y"), "b")
        some = some.where(f"least(n, m) * 100 >= {percent} * greatest(n, m)").select("a", "b", "n", "m", "x", "y")
        some = stored(spark, some.mapInArrow(_screened, "a long, b long"), "candidates")
        wanted = some.selectExpr("a sid").union(some.selectExpr("b")).distinct().join(nodes.where("rep is not null").selectExpr("sid", "rep doc_id"), "sid")
        return stored(spark, linked_pairs(some, sets_of(spark, docs, wanted, total[1], words, seed), percent), "links")

    found = links(buckets.where("sid <> leader").selectExpr("sid a", "leader b").distinct())
    # stars first: each set with the leader of the highest priority; what its other links join follows between components
    stars = star_components(spark, stored(spark, found.groupBy("a").agg(F.max("b").alias("b")), "stars"))

    def contracted(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """comps (node, root) joined by links (a, b) between their nodes; a node that isn't there is its own component."""
        one, two = comps.selectExpr("node a", "root x"), comps.selectExpr("node b", "root y")
        between = pairs.join(one, "a", "left").join(two, "b", "left").selectExpr("coalesce(x, a) a", "coalesce(y, b) b").where("a <> b").distinct()
        joined = stored(spark, components(spark, stored(spark, between, "between")).selectExpr("node root", "root top"), "tops")
        named = comps.join(joined, "root", "left").selectExpr("node", "coalesce(top, root) root")
        alone = joined.join(comps.selectExpr("node root"), "root", "left_anti").selectExpr("root node", "top root")
        return stored(spark, named.union(alone), "components")

    comps = contracted(found, stars)
    # buckets of three or more sets that are not all of one component
    placed = buckets.where("m > 2").join(comps.withColumnRenamed("node", "sid"), "sid", "left").selectExpr("key", "sid", "leader", "coalesce(root, sid) comp")
    placed = stored(spark, placed, "placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    mixed = stored(spark, mixed.join(placed.groupBy("key").agg(F.count("*").alias("members")), "key"), "mixed")
    open_ = stored(spark, placed.join(mixed, "key"), "open")
    few, many = open_.where(f"members <= {GROUP}"), open_.where(f"members > {GROUP}")
    asks = few.where("comp <> main").selectExpr("key", "sid", "comp")
    met = few.selectExpr("key", "sid other", "comp other_comp", "leader").join(asks, "key").where("comp <> other_comp and sid <> leader and other <> leader")
    more = links(met.selectExpr("least(sid, other) a", "greatest(sid, other) b").distinct())
    # large buckets: columns of sets, by the leader of the highest priority
    home = stored(spark, many.groupBy("sid", "comp").agg(F.max("leader").alias("g")), "homes")
    parts = home.groupBy("g", "comp").agg(F.count("*").alias("k"))
    rest = parts.where(f"k < {GROUP // 2}").groupBy("g").agg(F.sum("k").alias("rest"))
    parts = stored(spark, parts.join(rest, "g", "left"), "parts")
    cut = f"if(k >= {GROUP // 2}, xxhash64(g, comp, pmod(xxhash64(sid), ceil(k / {GROUP}))), xxhash64(g, pmod(xxhash64(sid), ceil(rest / {GROUP}))))"
    home = stored(spark, home.join(parts, ["g", "comp"]).selectExpr("sid", "comp", f"{cut} cut"), "columns")
    cuts = stored(spark, home.groupBy("cut").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")), "cuts")
    there = stored(spark, many.select("key", "sid").join(home.select("sid", "cut"), "sid").select("key", "cut").distinct().join(cuts, "cut"), "there")
    pairs = there.join(there.withColumnsRenamed({"cut": "other", "c0": "d0", "c1": "d1"}), "key").where("cut <= other and (c0 <> c1 or d0 <> d1 or c0 <> d0)")
    pairs = stored(spark, pairs.select("cut", "other").distinct(), "meets")
    sids = home.join(pairs.select("cut").union(pairs.select("other")).distinct(), "cut", "left_semi")
    sids = stored(spark, sids, "members")
    sets = sets_of(spark, docs, sids.join(nodes.where("rep is not null").selectExpr("sid", "rep doc_id"), "sid"), total[1], words, seed)
    columns = stored(spark, sets.dropDuplicates(["sid"]).join(sids, "sid").groupBy("cut").agg(F.collect_list(F.struct("comp", "shingles")).alias("x")), "matrix")
    both = pairs.join(columns, "cut").join(columns.selectExpr("cut other", "x y"), "other").selectExpr("x", "y", "cut = other same")
    more = more.union(both.mapInArrow(_column_links(percent), "a long, b long"))
    comps = contracted(stored(spark, more, "links"), comps)
    # the smallest doc_id of each component, by set and then by document
    named = nodes.select("sid", "rep").join(comps.withColumnRenamed("node", "sid"), "sid", "left").selectExpr("sid", "rep", "root")
    first = stored(spark, named.where("root is not null").groupBy("root").agg(F.min("rep").alias("first")), "first")
    named = stored(spark, named.join(first, "root", "left").selectExpr("sid", "if(root is null, rep, first) component_id"), "named")
    out = light.join(named, "sid", "left").selectExpr("doc_id", "n n_shingles", "coalesce(component_id, doc_id) component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of smaller doc_ids; rows of one doc_id stay or go together."""
    found = near_duplicates(spark, docs)
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
