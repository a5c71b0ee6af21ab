"""N-gram Jaccard join by a token-group matrix.

Documents that share five-word shingles at a Jaccard similarity of 0.8 or more are linked; the result names each
document's component of links. The join is exact and emits no pairs inside a group:

1. one pass makes each document's shingle set and a set id, and counts shingles in a sketch of fixed size;
   documents of the same set id are one node from here on;
2. under the order "rarest first" (by the sketch, then by hash) the prefixes of two linked sets, of n - ceil(0.8 n) + l
   shingles with l = 1 + n // 20, share l shingles of the smaller set. Prefixes are dealt by shingle hash, packed, and
   only shingles of two or more sets survive: the hyper table;
3. a set names the leader that most of its shared shingles name (the most common content); where many name one,
   each is checked against it, so that a large group of near copies costs one check a member, and linked sets are one
   component from here on;
4. sets that named the same leader form groups, cut to about GROUP sets of one component where it has so many, each a
   column of the token-group matrix: the union of its sets' shingles. Two groups may hold linked sets only if their prefixes share enough shingles; then,
   and between the cuts of one group, each set q of the smaller asks the columns of the other that have sets of other
   components: a column opens only if |q & union| >= 0.8 |q|, and its members are then compared. The sets of one
   column are compared with each other.

Whole sets are made again from the texts, and only for sets that are candidates.

Nulls and texts without words: n_shingles 0, linked with nothing. Repeated rows and tied ids: every input row gives
an output row; a null doc_id is its own row without a say in the component. Other columns pass unread.
Set ids are 64-bit hashes, checked against a second hash; on a clash the join runs again under another seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import components, merged_sketch, mix, prefix_hash, range_hash, sketch_rows, star_components, stored, text_slices

WORDS, PERCENT = 5, 80
CELLS = 1 << 20  # of the count sketch
FLAG_BYTES = 1 << 22  # of the bit field of documents that hold a shared shingle
GROUP = 32
#: Documents of one sketch cell above which its shingles are no task's own; below what a cell can count.
HOT = 50_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each word of the rows data[offs[i]:offs[i + 1]]."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offs[:-1][offs[:-1] < offs[1:]]
    first[starts] = word[starts]
    begin = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[starts[1:] - 1] = word[starts[1:] - 1]
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offs, begin, side="right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; shorter texts are one shingle."""
    rows = len(offs) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * rows
    begin, end, row = word_bounds(data, offs)
    h = range_hash(prefix_hash(_LOWER[data]), begin, end) + np.uint64(seed)
    count = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(count)])
    k = np.uint64(0x9FB21C651E98DF25)
    full = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        full = full * k + h[i : i + len(full)]
    full = mix(full)
    out = []
    for i in range(rows):
        n = int(count[i])
        if n >= words:
            out.append(np.unique(full[at[i] : at[i + 1] - words + 1]))
        elif n:
            one = n
            for x in h[at[i] : at[i + 1]].tolist():
                one = (one * int(k) + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two order-free hashes of each set."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    sums = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        whole, starts = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(size[full])[:-1]])
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            sums[k, full] = mix(np.add.reduceat(mix(whole ^ np.uint64(salt)), starts) + size[full].astype(np.uint64))
    return size, sums[0].view(np.int64), sums[1].view(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _light_pass(words: int, seed: int):
    """Rows of one task: its documents' (doc_id, n, sid, check), then its counts of shingles by sketch cell."""

    def run(batches):
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, words, seed)
                whole = np.concatenate(sets) & np.uint64(CELLS - 1)
                cells += np.bincount(whole.astype(np.int64), minlength=CELLS).astype(np.uint32)
                size, sid, check = set_ids(sets)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(sid, mask=size == 0), pa.array(check, mask=size == 0), *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "n", "sid", "check", "block", "part", "cells"])
        counts = sketch_rows(np.minimum(cells, 65535).astype(np.uint16), TaskContext.get().partitionId())
        n = counts.num_rows
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), *counts.columns], ["doc_id", "n", "sid", "check", "block", "part", "cells"])

    return run


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 + n // 20


def _prefix_pass(words: int, seed: int, percent: int, cells, buckets: int):
    """Packed prefix entries (shingle, sid, weight) by bucket of the shingle, equal sets of a flush once."""
    packed = np.dtype([("token", "<u8"), ("sid", "<i8"), ("weight", "<u2")])
    flushes = [0]

    def flush(entries, hot):
        if hot:  # a group of its own: no task gathers the entries of a hot shingle
            flushes[0] += 1
            yield pa.RecordBatch.from_arrays([pa.array([-flushes[0]], pa.int32()), pa.array([np.concatenate(hot).tobytes()], pa.binary())], ["bucket", "entries"])
        e = np.concatenate(entries)
        if not len(e):
            return
        bucket = (e["token"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        e, bucket = e[order], bucket[order]
        at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + 1))
        blobs = [e[i:j].tobytes() for i, j in zip(at, [*at[1:], len(e)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    def run(batches):
        flushes[0] = TaskContext.get().partitionId() << 10 & 0x3FFFFFFF
        count, entries, hot, held, seen = cells.value, [], [], 0, set()
        for batch in batches:
            for _, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, words, seed)
                _, sids, _ = set_ids(sets)
                for s, sid in zip(sets, sids.tolist(), strict=True):
                    if not len(s) or sid in seen:
                        continue
                    seen.add(sid)
                    weight = count[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                    first = np.argsort(weight, kind="stable")[: prefix_length(len(s), percent)]
                    e = np.empty(len(first), packed)
                    e["token"], e["sid"], e["weight"] = s[first], sid, min(65535, int(16 * np.sqrt(float(weight[first[-1]]))))
                    cold = int(np.searchsorted(weight[first], HOT))  # the rarest come first
                    entries.append(e[:cold])
                    if cold < len(e):
                        hot.append(e[cold:])
                    held += len(e)
                    if held >= 500_000:
                        yield from flush(entries, hot)
                        entries, hot, held, seen = [], [], 0, set()
        if entries:
            yield from flush(entries, hot)

    return run, packed


def _shared_tokens(packed: np.dtype):
    """Of one bucket: the entries whose shingle two or more sets hold, each with the shingle's leading set; hot entries as they are."""

    def run(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("entries").to_pylist()), packed)
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"token": _signed(e["token"]), "sid": _signed(e["sid"]), "leader": pa.nulls(len(e), pa.int64()), "weight": pa.array(e["weight"].astype(np.int32))})
        e = e[np.lexsort((e["sid"], e["token"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["token"][1:] != e["token"][:-1]) | (e["sid"][1:] != e["sid"][:-1])
        e = e[fresh]
        at = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
        size = np.diff(np.append(at, len(e)))
        e, run_of = e[np.repeat(size > 1, size)], np.repeat(np.arange((size > 1).sum()), size[size > 1])
        best = np.lexsort((e["sid"], -e["weight"].astype(np.int64), run_of))
        heads = np.concatenate([[0], np.cumsum(size[size > 1])[:-1]]).astype(np.int64)
        leader = e["sid"][best][heads][run_of] if len(e) else e["sid"]
        return pa.table({"token": _signed(e["token"]), "sid": _signed(e["sid"]), "leader": _signed(leader), "weight": pa.nulls(len(e), pa.int32())})

    return run


def _with_hot(spark: SparkSession, hyper: DataFrame) -> DataFrame:
    """The hyper table, its hot entries (no leader yet) led and kept as the others are."""
    hot = hyper.where("leader is null").select("token", "sid", "weight")
    hyper = hyper.where("leader is not null").select("token", "sid", "leader")
    if hot.isEmpty():
        return hyper
    hot = stored(spark, hot.distinct(), "hot")
    heads = hot.groupBy("token").agg(F.expr("max_by(sid, struct(weight, ~sid))").alias("leader"), F.count("*").alias("sets"))
    heads = stored(spark, heads.where("sets > 1").select("token", "leader"), "heads")
    return hyper.unionByName(stored(spark, hot.join(heads, "token").select("token", "sid", "leader"), "hot_hyper"))


def _flag_bits(sid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return (mix(sid.view(np.uint64) ^ mix(doc.view(np.uint64))) & np.uint64(8 * FLAG_BYTES - 1)).astype(np.int64)


def _flag_pass(batches):
    bits = np.zeros(8 * FLAG_BYTES, bool)
    for batch in batches:
        bits[_flag_bits(batch.column("sid").to_numpy(), batch.column("doc_id").to_numpy())] = True
    yield sketch_rows(np.packbits(bits), TaskContext.get().partitionId())


def _set_pass(words: int, seed: int, flags):
    """The whole sets of flagged documents."""

    def run(batches):
        bits = flags.value
        for batch in batches:
            for part, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, words, seed)
                size, sids, _ = set_ids(sets)
                docs = part.column("doc_id").fill_null(0).to_numpy()
                at = _flag_bits(sids, docs)
                keep = np.flatnonzero((size > 0) & ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(sids[keep]), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["sid", "shingles"])

    return run


def sets_of(spark: SparkSession, docs: DataFrame, wanted: DataFrame, nodes: int, words: int, seed: int) -> DataFrame:
    """(sid, shingles) of the wanted sets (sid, doc_id) of `nodes` in all, made from docs, with some others: a bit field of fixed size picks the documents."""
    tasks = max(8, nodes // 4_000_000)
    flags = spark.sparkContext.broadcast(merged_sketch(wanted.coalesce(tasks).mapInArrow(_flag_pass, "block int, part int, cells binary"), "or", "uint8", FLAG_BYTES))
    return stored(spark, docs.mapInArrow(_set_pass(words, seed, flags), "sid long, shingles array<long>"), "shingles")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of set ids, those at the similarity or above; no aggregation follows, so hot joins may be split."""
    one, two = sets.selectExpr("sid a", "shingles x"), sets.selectExpr("sid b", "shingles y")
    n = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a").join(two, "b")
        .where(F.least(F.size("x"), F.size("y")) * 100 >= percent * F.greatest(F.size("x"), F.size("y")))
        .where(n * 100 >= percent * (F.size("x") + F.size("y") - n)).select("a", "b")
    )


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if small * 100 < percent * large:
        return False
    both = np.concatenate([x, y])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n * 100 >= percent * (len(both) - n)


def _links_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _inner_links(percent: int):
    """Of rows of members: links between the components of members of one column, as many as join them."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                group = members.values
                comps = group.field("c").to_pylist()
                was = list(comps)
                sets = [m.values.to_numpy() for m in group.field("shingles")]
                for i in range(len(comps)):
                    for j in range(i):
                        if comps[i] != comps[j] and _alike(sets[i], sets[j], percent):
                            a.append(was[i])
                            b.append(was[j])
                            old, new = comps[i], comps[j]
                            comps = [new if c == old else c for c in comps]
            yield _links_batch(a, b)

    return run


def _new_links(percent: int):
    """Of rows (comp, x, g, k, members), members being a matrix column: opens it where the union of its sets may hold the
    percentage of x, and gives comp and the components of the members that it links to, each once."""

    def run(batches):
        held = None
        for batch in batches:
            a, b = [], []
            x, members = batch.column("x"), batch.column("members")
            rows = zip(*[batch.column(c).to_pylist() for c in ("comp", "g", "k")], strict=True)
            for i, (comp, *key) in enumerate(rows):
                if key != held:
                    held, group = key, members[i].values
                    comps = group.field("c").to_pylist()
                    sets = [m.values.to_numpy().copy() for m in group.field("shingles")]
                    union = np.unique(np.concatenate(sets))
                own, found = x[i].values.to_numpy(), {comp}
                at = np.searchsorted(union, own)
                at[at == len(union)] = 0
                if int((union[at] == own).sum()) * 100 < percent * len(own):
                    continue
                for c, other in zip(comps, sets, strict=True):
                    if c not in found and _alike(own, other, percent):
                        a.append(comp)
                        b.append(c)
                        found.add(c)
            yield _links_batch(a, b)

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text); see the module."""
    if percent <= 50:
        raise ValueError("the prefix order is meant for similarities over one half")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    light = stored(spark, docs.mapInArrow(_light_pass(words, seed), "doc_id long, n long, sid long, check long, block int, part int, cells binary"), "sets")
    cells = spark.sparkContext.broadcast(merged_sketch(light.where("block is not null").select("block", "part", "cells"), "add", "uint16", CELLS))
    light = light.where("block is null").select("doc_id", "n", "sid", "check")
    nodes = light.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.max("n").alias("n"))
    nodes = stored(spark, nodes, "nodes")
    total = nodes.agg(F.sum("n"), F.max(F.col("c0") != F.col("c1")), F.count("*")).first()
    if total[1]:
        return jaccard_components(spark, docs, words, percent, seed + 1)
    buckets = max(48, int((total[0] or 0) * (100 - percent) / 100 / 250_000))
    run, packed = _prefix_pass(words, seed, percent, cells, buckets)
    dealt = docs.mapInArrow(run, "bucket int, entries binary")
    hyper = stored(spark, dealt.groupBy("bucket").applyInArrow(_shared_tokens(packed), "token long, sid long, leader long, weight int"), "hyper")
    hyper = _with_hot(spark, hyper)
    #: shingles that a linked set of the smallest size allowed must share with q's prefix
    least = f"1 + cast(ceil({percent} * n / 100) as long) div 20"

    def whole_sets(sids: DataFrame) -> DataFrame:
        return sets_of(spark, docs, sids.join(nodes.where("rep is not null").selectExpr("sid", "rep doc_id"), "sid"), total[2], words, seed)

    # a set that shares fewer shingles than that with all others together is in no candidate pair
    able = hyper.groupBy("sid").count().join(nodes.select("sid", "n"), "sid").where(f"count >= {least}").select("sid", "n")
    able = stored(spark, able, "able")
    votes = hyper.join(able.select("sid"), "sid", "left_semi").where("sid <> leader").groupBy("sid", "leader").count()
    pairs = votes.groupBy("sid").agg(F.expr("max_by(leader, struct(count, leader))").alias("b"), F.max("count").alias("c"))
    pairs = stored(spark, pairs.join(able, "sid").where(f"c >= {least}").selectExpr("sid a", "b"), "pairs")
    large = pairs.groupBy("b").count().where(f"count >= {GROUP // 2}").select("b")
    checked = stored(spark, pairs.join(large, "b").select("a", "b"), "checked")
    sets = whole_sets(checked.selectExpr("a sid").union(checked.selectExpr("b")).distinct())
    links = stored(spark, linked_pairs(checked, sets, percent), "links")
    linked = star_components(spark, links)
    # the token-group matrix: sets by the leader that they named, linked or not, cut to about GROUP
    home = able.join(linked.withColumnRenamed("node", "sid"), "sid", "left").join(pairs.selectExpr("a sid", "b"), "sid", "left")
    home = home.selectExpr("sid", "n", "coalesce(root, sid) comp", "coalesce(b, sid) g")
    home = stored(spark, home, "homes")
    # a component of half a cut or more in a group has cuts of its own, the others share the rest: cuts of one
    # component needn't be compared with each other
    parts = home.groupBy("g", "comp").agg(F.count("*").alias("m"))
    rest = parts.where(f"m < {GROUP // 2}").groupBy("g").agg(F.sum("m").alias("rest"))
    parts = stored(spark, parts.join(rest, "g", "left"), "parts")
    cut = f"if(m >= {GROUP // 2}, xxhash64(comp, pmod(xxhash64(sid), ceil(m / {GROUP}))), pmod(xxhash64(sid), ceil(rest / {GROUP})))"
    home = stored(spark, home.join(parts, ["g", "comp"]).selectExpr("sid", "n", "comp", "g", f"{cut} k"), "groups")
    # groups that share enough prefix shingles to hold a linked pair
    tokens = hyper.join(home.select("sid", "g"), "sid").select("token", "g").distinct()
    sizes = home.groupBy("g").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("m"))
    meets = tokens.join(tokens.withColumnRenamed("g", "h"), "token").where("g < h").groupBy("g", "h").count()
    meets = meets.join(sizes, "g").join(sizes.selectExpr("g h", "n nh", "most mosth", "m mh"), "h")
    meets = meets.where(f"100 * most >= {percent} * nh and 100 * mosth >= {percent} * n")
    meets = meets.withColumn("n", F.least("n", "nh")).where(f"count >= {least}").selectExpr("if(m <= mh, g, h) g", "if(m <= mh, h, g) h")
    meets = stored(spark, meets, "meets")
    cuts = stored(spark, home.groupBy("g", "k").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")), "cuts")
    asks = home.select("sid", "comp", "g").join(meets, "g").join(cuts.withColumnRenamed("g", "h"), "h").where("comp <> c0 or comp <> c1").selectExpr("sid a", "comp", "h g", "k")
    more = home.selectExpr("sid", "comp", "g", "k k0").join(cuts, "g").where("k0 < k and (comp <> c0 or comp <> c1)").selectExpr("sid a", "comp", "g", "k")
    asks = stored(spark, asks.union(more), "asks")
    some = cuts.where("c0 <> c1").select("g", "k").union(asks.select("g", "k")).distinct()
    members = stored(spark, home.selectExpr("sid b", "comp c", "g", "k").join(some, ["g", "k"]), "members")
    sets = whole_sets(members.selectExpr("b sid").union(asks.selectExpr("a")).distinct())
    columns = sets.selectExpr("sid b", "shingles").join(members, "b").groupBy("g", "k").agg(F.collect_list(F.struct("b", "c", "shingles")).alias("members"))
    columns = stored(spark, columns, "matrix")
    opened = sets.selectExpr("sid a", "shingles x").join(asks, "a").join(columns, ["g", "k"]).select("comp", "x", "g", "k", "members")
    # links between components from here on
    links = columns.select("members").mapInArrow(_inner_links(percent), "a long, b long").union(opened.mapInArrow(_new_links(percent), "a long, b long"))
    roots = components(spark, links)
    # only able sets: any other set is its own component
    named = home.select("sid", "comp").join(roots.withColumnRenamed("node", "comp"), "comp", "left").selectExpr("sid", "coalesce(root, comp) root")
    named = stored(spark, named.join(nodes.select("sid", "rep"), "sid"), "named")
    first = stored(spark, named.groupBy("root").agg(F.min("rep").alias("first")), "first")
    named = nodes.select("sid", "rep").join(named.join(first, "root").select("sid", "first"), "sid", "left")
    named = stored(spark, named.selectExpr("sid", "if(first is null or rep < first, rep, first) component_id"), "named")
    return light.join(named, "sid", "left").selectExpr("doc_id", "n n_shingles", "coalesce(component_id, doc_id) component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without all but one document of each component: the one of the smallest doc_id stays, with its columns.

    Rows that repeat the smallest doc_id count as copies too: one of them stays. Rows of a null doc_id stay.
    """
    found = jaccard_components(spark, docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))
