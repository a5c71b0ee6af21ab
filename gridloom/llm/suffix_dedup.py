"""Repeated strings of SPAN bytes, removed wherever they start: partitioned suffix sorting around anchors.

A window of SPAN bytes has one anchor, the leftmost smallest hash of its GRAM-byte grams, so equal windows hold equal
grams at equal places. One pass cuts each text into runs of windows of one anchor; a run's block is all its windows'
bytes. Then
1. blocks found twice or more, in any texts, are repeated as a whole; only counts travel, combined before the shuffle;
2. different blocks of one anchor gram may share some windows: one copy of each is fetched and they are sorted as
   suffixes, by their bytes from the anchor on and by those before it backwards, with deep-shallow sorting: multikey
   quicksort to a shallow depth, then a blind trie for each group with a longer common prefix. Two blocks that agree
   on L bytes before the anchor and R from it on share windows if L + R >= SPAN, and these cover L and R bytes;
3. a gram with more than HOT different blocks, too many for one task, is split: blocks that share a window share half
   a window before or from the anchor, so each is sorted among those of the same half before and among those of the
   same half after. Only where more than HOT blocks share a half are the hashes of their windows counted instead.
Texts are known by a 128-bit hash, so copies of a text share one result; a text has its covered bytes removed at once,
judged on the input.

Passages that recur but are too short for SPAN are reported, not removed: in each window of PASSAGE bytes the leftmost
smallest hash of its MARK-byte strings is a mark, so equal windows hold an equal mark, and n_shared counts a text's
distinct marks that also start elsewhere. It is over 0 for each text that shares PASSAGE bytes with another place, and 0
where no MARK bytes are shared; only counts of hashes travel.

A null text is empty; texts under SPAN bytes keep all. Repeated rows are repeats of each other. Only doc_id and text
are read. Very long texts are cut into overlapping segments for the pass.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import prefix_hash, range_hash, stored, text_slices

SPAN, GRAM, SHALLOW = 400, 32, 48
HOT, SEGMENT, BUCKET_BYTES = 20_000, 8 << 20, 8 << 20
PASSAGE, MARK = 256, 96


# deep-shallow sorting


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest common prefix of two strings that agree on their first `at` bytes."""
    low, high = at, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _trie_order(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """The group sorted by a blind trie, and each string's common prefix with the one before it (the first: depth).

    A node knows only the depth at which its children differ: an insertion goes down blindly to some leaf, compares
    with that one string, and splits where they part.
    """
    root = group[0]
    for i in group[1:]:
        s, node = strings[i], root
        while not isinstance(node, int):
            d, kids = node
            c = s[d] if len(s) > d else -1
            node = kids.get(c)
            if node is None:
                node = next(iter(kids.values()))
        while not isinstance(node, int):
            node = next(iter(node[1].values()))
        t = strings[node]
        part = common(s, t, depth)
        parent, key, node = None, None, root
        while not isinstance(node, int) and node[0] < part:
            parent, key = node, s[node[0]] if len(s) > node[0] else -1
            node = node[1][key]
        mine = s[part] if len(s) > part else -1
        if not isinstance(node, int) and node[0] == part:
            node[1][(-2, i) if mine in node[1] else mine] = i  # only a string that ends here can be there already
            continue
        theirs = t[part] if len(t) > part else -1
        if mine == theirs:  # equal strings
            mine = (-2, i)
        new = (part, {theirs: node, mine: i})
        if parent is None:
            root = new
        else:
            parent[1][key] = new
    order, lcp, stack, last = [], [], [root], depth
    rank = lambda c: (c, -1) if isinstance(c, int) else (-1, c[1])
    while stack:
        node = stack.pop()
        if isinstance(node, tuple) and len(node) == 1:
            last = node[0]
        elif isinstance(node, int):
            order.append(node)
            lcp.append(last)
        else:
            d, kids = node
            own = [kids[c] for c in sorted(kids, key=rank)]
            for k in range(len(own) - 1, -1, -1):
                stack.append(own[k])
                if k:
                    stack.append((d,))
    return order, lcp


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of strings that agree on `depth` bytes, and each one's common prefix with the one before it (first: 0)."""
    order, lcp = [], []
    stack = [(list(range(len(strings))), depth, 0)]
    while stack:
        group, d, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcp.append(before)
            continue
        if d >= shallow:
            own, between = _trie_order(strings, group, d)
            order += own
            lcp += [before, *between[1:]]
            continue
        pivot = strings[group[len(group) // 2]]
        c = pivot[d] if len(pivot) > d else -1
        less, same, more = [], [], []
        for i in group:
            s = strings[i]
            x = s[d] if len(s) > d else -1
            (same if x == c else less if x < c else more).append(i)
        pushed = []
        for k, (own, deeper) in enumerate(((less, d), (same, d + 1), (more, d))):
            if not own:
                continue
            first = before if not pushed else d
            if k == 1 and c == -1:  # ended strings are equal
                pushed.append(("equal", own, first))
            else:
                pushed.append((own, deeper, first))
        for x in reversed(pushed):
            if x[0] == "equal":
                for n, i in enumerate(reversed(x[1])):
                    stack.append(([i], d, d if n < len(x[1]) - 1 else x[2]))
            else:
                stack.append(x)
    return order, lcp


def extents(left: list[bytes], right: list[bytes], span: int = SPAN, depth: int = 0) -> list[tuple[int, int]]:
    """For each of k blocks with the bytes before their anchors (reversed) and from them on: how far windows that some
    other block has reach back and forward; (0, 0) for none."""
    k = len(left)
    if k == 2:
        back, ahead = common(*left), common(*right)
        return [(back, ahead) if back + ahead >= span else (0, 0)] * 2
    places = []
    for side, d in ((left, 0), (right, depth)):
        order, lcp = deep_shallow(side, d)
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        places.append((place, np.array(order), np.array(lcp)))

    def row(side, i):
        place, order, lcp = places[side]
        p = int(place[i])
        out = np.empty(k, np.int64)
        out[order[p]] = 0
        out[order[p + 1 :]] = np.minimum.accumulate(lcp[p + 1 :]) if p + 1 < k else 0
        if p:
            out[order[:p][::-1]] = np.minimum.accumulate(lcp[1 : p + 1][::-1])
        return out

    found = []
    for i in range(k):
        back, ahead = row(0, i), row(1, i)
        good = back + ahead >= span
        good[i] = False
        found.append((int(back[good].max()), int(ahead[good].max())) if good.any() else (0, 0))
    return found


# anchors


def runs(data: np.ndarray, offs: np.ndarray, span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows of one anchor: row, lo and hi (first and last window, in the row), anchor, gram hash, block hashes."""
    names = ("row", "lo", "hi", "anchor", "q", "b1", "b2")
    empty = dict.fromkeys(names, np.zeros(0, np.int64))
    if len(data) < span or (np.diff(offs) < span).all():
        return empty
    if len(data) > 2 * SEGMENT:
        parts = []
        for row in np.flatnonzero(np.diff(offs) >= span):
            for at in range(0, int(offs[row + 1] - offs[row]) - span + 1, SEGMENT):
                piece = data[offs[row] + at : min(offs[row + 1], offs[row] + at + SEGMENT + span - 1)]
                one = runs(piece, np.array([0, len(piece)]), span, gram)
                parts.append({**one, "row": one["row"] + row, **{n: one[n] + at for n in ("lo", "hi", "anchor")}})
        return {n: np.concatenate([p[n] for p in parts]) for n in names} if parts else empty
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = range_hash(sums, at, at + gram)
    w = span - gram + 1
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    whole = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole[: len(key)] = key
    grid = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - span + 1
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(offs) >= span)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - span + 1, -1)
    p = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    m = least[p]
    new = np.ones(len(p), bool)
    new[1:] = (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = p[first], p[np.append(first[1:], len(p)) - 1]
    anchor = (m[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.searchsorted(offs, lo, side="right") - 1
    total = np.concatenate([[0], np.cumsum(h)]).astype(np.uint64)
    begin = offs[row]
    return {"row": row, "lo": lo - begin, "hi": hi - begin, "anchor": anchor - begin, "q": h[anchor].view(np.int64), "b1": range_hash(sums, lo, hi + span).view(np.int64), "b2": (total[hi + span - gram + 1] - total[lo]).view(np.int64)}


def marks(data: np.ndarray, offs: np.ndarray, passage: int = PASSAGE, mark: int = MARK) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each marked place: the leftmost smallest hash of a `mark`-byte string in some window of `passage` bytes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < passage or (np.diff(offs) < passage).all():
        return none
    if len(data) > 2 * SEGMENT:
        rows, found = [none[0]], [none[1]]
        for row in np.flatnonzero(np.diff(offs) >= passage):
            last = -1
            for at in range(0, int(offs[row + 1] - offs[row]) - passage + 1, SEGMENT):
                piece = data[offs[row] + at : min(offs[row + 1], offs[row] + at + SEGMENT + passage - 1)]
                place, h = _marked(piece, np.array([0, len(piece)]), passage, mark)
                new = place + at > last  # a place near the cut is marked from both sides
                last = int(place[-1]) + at
                rows.append(np.full(int(new.sum()), row))
                found.append(h[new])
        return np.concatenate(rows), np.concatenate(found)
    place, h = _marked(data, offs, passage, mark)
    return np.searchsorted(offs, place, side="right") - 1, h


def _marked(data: np.ndarray, offs: np.ndarray, passage: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in data, in order, and the hashes of their strings."""
    at = np.arange(len(data) - mark + 1)
    h = range_hash(prefix_hash(data), at, at + mark)
    w = passage - mark + 1
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    whole = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole[: len(key)] = key
    grid = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - passage + 1
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(offs) >= passage)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - passage + 1, -1)
    p = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    place = np.unique((np.minimum(back[p], ahead[p + w - 1]) & np.uint64(0xFFFFFF)).astype(np.int64))
    return place, h[place]


def _mark_pass(passage: int, mark: int):
    """Rows (t1, t2, marks, once): of each text with marks the distinct hashes, and which of them it holds once only."""

    def run(batches):
        for batch in batches:
            for _, data, offs in text_slices(batch):
                row, h = marks(data, offs, passage, mark)
                t1, t2 = _text_keys(data, offs)
                cut = np.searchsorted(row, np.arange(len(offs)))
                rows = np.flatnonzero(np.diff(cut))
                both = [np.unique(h[cut[i] : cut[i + 1]], return_counts=True) for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(t1[rows]), pa.array(t2[rows]), pa.array([x.view(np.int64) for x, _ in both], pa.list_(pa.int64())), pa.array([c == 1 for _, c in both], pa.list_(pa.bool_()))], ["t1", "t2", "marks", "once"])

    return run


def shared_marks(spark: SparkSession, docs: DataFrame, passage: int = PASSAGE, mark: int = MARK) -> DataFrame:
    """(t1, t2, n_shared) of the texts that share marks with another place."""
    found = docs.selectExpr("cast(text as string) text").mapInArrow(_mark_pass(passage, mark), "t1 long, t2 long, marks array<long>, once array<boolean>")
    found = stored(spark, found, "marks").selectExpr("t1", "t2", "inline(arrays_zip(marks, once))")
    twice = stored(spark, found.groupBy("marks").agg(F.sum(F.expr("if(once, 1, 2)")).alias("n")).where("n > 1").select("marks"), "twice")
    # a table on either side, so that the join may split a mark that very many texts hold
    shared = found.select("t1", "t2", "marks").join(twice, "marks").distinct()
    return stored(spark, shared.groupBy("t1", "t2").agg(F.count("*").alias("n_shared")), "shared")


def _text_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = data.tobytes()
    raw = b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _anchor_pass(span: int, gram: int):
    def run(batches):
        for batch in batches:
            for _, data, offs in text_slices(batch):
                r = runs(data, offs, span, gram)
                t1, t2 = _text_keys(data, offs)
                own = {"t1": t1[r["row"]], "t2": t2[r["row"]], **{n: r[n] for n in ("q", "b1", "b2")}, **{n: r[n].astype(np.int32) for n in ("lo", "hi", "anchor")}}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in own.values()], list(own))

    return run


def _keyed_texts(docs: DataFrame, once: bool = False) -> DataFrame:
    """doc_id, text (never null) and its key t1, t2; `once`: of equal texts in a task only the first."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part, data, offs in text_slices(batch):
                t1, t2 = _text_keys(data, offs)
                if once:
                    new = [k not in seen and not seen.add(k) for k in zip(t1.tolist(), t2.tolist(), strict=True)]
                    part, t1, t2 = part.filter(pa.array(new)), t1[new], t2[new]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(t1), pa.array(t2)], [*part.schema.names, "t1", "t2"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").mapInArrow(run, "doc_id long, text string, t1 long, t2 long")


def _block_pass(span: int):
    """Blocks' bytes from rows (text, wanted): wanted are structs (q, b1, b2, n, lo, hi, anchor)."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw = text.as_py().encode()
                rows = [(x["q"], x["b1"], x["b2"], x["n"], x["k"], x["anchor"] - x["lo"], raw[x["lo"] : x["hi"] + span]) for x in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["q", "b1", "b2", "n", "k", "at", "bytes"])

    return run


def _sort_bucket(span: int, gram: int):
    """Of a bucket of blocks (q, b1, b2, n, at, bytes): what windows shared with other blocks of the same gram cover."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("q", "ascending"), ("b1", "ascending"), ("b2", "ascending")])
        q = table.column("q").to_numpy()
        cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)]
        at, raw, times = table.column("at").to_pylist(), table.column("bytes").to_pylist(), table.column("n").to_numpy()
        back, ahead = np.zeros(len(q), np.int32), np.zeros(len(q), np.int32)
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i < 2 or (times[i:j] > 1).all():
                continue
            right = [raw[k][at[k] :] for k in range(i, j)]
            same = all(r[:gram] == right[0][:gram] for r in right)
            for k, (b, a) in enumerate(extents([raw[k][: at[k]][::-1] for k in range(i, j)], right, span, gram if same else 0), i):
                back[k], ahead[k] = b, a
        keep = np.flatnonzero((ahead > 0) & (times == 1))
        return pa.table({"b1": table.column("b1").take(pa.array(keep)), "b2": table.column("b2").take(pa.array(keep)), "back": pa.array(back[keep]), "ahead": pa.array(ahead[keep])})

    return run


def _half_pass(span: int):
    """Blocks (q, b1, b2, n, k, at, bytes) once for each half window beside the anchor that they hold, q naming gram and half."""
    half = span // 2

    def run(batches):
        for batch in batches:
            q, at, raw = (batch.column(c).to_pylist() for c in ("q", "at", "bytes"))
            rows, names = [], []
            for i, (g, a, b) in enumerate(zip(q, at, raw, strict=True)):
                for side, piece in ((b"<", b[a - half : a] if a >= half else b""), (b">", b[a : a + half])):
                    if len(piece) == half:
                        rows.append(i)
                        names.append(xxhash.xxh3_64_intdigest(side + g.to_bytes(8, "little", signed=True) + piece))
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), *part.columns[1:]], batch.schema.names)

    return run


def _window_pass(span: int):
    """Hashes of all windows of blocks: rows (q, h, b1, b2, n, at, p)."""

    def run(batches):
        for batch in batches:
            for q, b1, b2, n, at, raw in zip(*[batch.column(c).to_pylist() for c in ("q", "b1", "b2", "n", "at", "bytes")], strict=True):
                sums = prefix_hash(np.frombuffer(raw, np.uint8))
                p = np.arange(len(raw) - span + 1)
                m = len(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, q)), pa.array(range_hash(sums, p, p + span).view(np.int64)), *(pa.array(np.full(m, x)) for x in (b1, b2, n)), pa.array(np.full(m, at, np.int32)), pa.array(p.astype(np.int32))], ["q", "h", "b1", "b2", "n", "at", "p"])

    return run


def repeated(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(t1, t2, spans array<struct<b, e>>): byte ranges, sorted but maybe overlapping, that repeated strings cover in each text."""
    anchors = docs.selectExpr("cast(text as string) text").mapInArrow(_anchor_pass(span, gram), "t1 long, t2 long, q long, b1 long, b2 long, lo int, hi int, anchor int")
    anchors = stored(spark, anchors, "anchors")
    place = F.struct("t1", "t2", "lo", "hi", "anchor")
    blocks = stored(spark, anchors.groupBy("q", "b1", "b2").agg(F.count("*").alias("n"), F.min(place).alias("at")), "blocks")
    many = blocks.groupBy("q").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("q", "k")
    wanted = blocks.join(many, "q").select("at.t1", "at.t2", F.struct("q", "b1", "b2", "n", "k", "at.lo", "at.hi", "at.anchor").alias("x"))
    wanted = stored(spark, wanted.groupBy("t1", "t2").agg(F.collect_list("x").alias("wanted")), "wanted")
    # copies of a text: any one of them serves
    texts = _keyed_texts(docs, once=True).join(wanted.select("t1", "t2"), ["t1", "t2"], "left_semi")
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted, ["t1", "t2"])
    bodies = texts.select("text", "wanted").mapInArrow(_block_pass(span), "q long, b1 long, b2 long, n long, k long, at int, bytes binary")
    bodies = stored(spark, bodies, "bodies")
    size = bodies.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(48, size // BUCKET_BYTES)
    some, shared = bodies.where(F.col("k") <= hot), bodies.where(F.col("k") > hot)
    if not shared.isEmpty():
        halves = stored(spark, shared.mapInArrow(_half_pass(span), bodies.schema), "halves")
        groups = stored(spark, halves.groupBy("q").agg(F.count("*").alias("k")).where("k > 1"), "groups")
        halves = halves.drop("k").join(groups, "q").select(bodies.columns)
        some, shared = some.union(halves.where(F.col("k") <= hot)), halves.where(F.col("k") > hot)
    some = some.withColumn("bucket", F.expr(f"pmod(xxhash64(q), {buckets})"))
    partly = some.groupBy("bucket").applyInArrow(_sort_bucket(span, gram), "b1 long, b2 long, back int, ahead int")
    shared = shared.mapInArrow(_window_pass(span), "q long, h long, b1 long, b2 long, n long, at int, p int")
    twice = shared.groupBy("q", "h").agg(F.count("*").alias("c")).where("c > 1").select("q", "h")
    over = shared.where("n = 1").join(twice, ["q", "h"]).groupBy("b1", "b2").agg(F.min("p").alias("b"), F.max("p").alias("e"), F.first("at").alias("at"))
    partly = partly.union(over.selectExpr("b1", "b2", "at - b", f"e + {span} - at"))
    found = blocks.where("n > 1").selectExpr("b1", "b2", "cast(null as int) back", "cast(null as int) ahead").union(partly)
    found = stored(spark, found, "found")
    spans = anchors.join(found, ["b1", "b2"]).selectExpr("t1", "t2", "coalesce(anchor - back, lo) b", f"coalesce(anchor + ahead, hi + {span}) e")
    spans = spans.groupBy("t1", "t2", "b").agg(F.max("e").alias("e"))
    return stored(spark, spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("spans")), "spans")


def _kept(raw: bytes, spans) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and the count of maximal inner runs."""
    kept, at, removed, count = [], 0, 0, 0
    end = -1
    for s in spans or ():
        if s["b"] > end:
            kept.append(raw[at : s["b"]])
            count += 1
            removed -= s["b"]
            removed += s["e"]
            end = s["e"]
        elif s["e"] > end:
            removed += s["e"] - end
            end = s["e"]
        at = max(at, end)
    kept.append(raw[at:])
    return b"".join(kept), removed, count


def removed(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared) of each row; with `texts` also what is left, as `kept` binary."""
    shared = shared_marks(spark, docs)
    spans = repeated(spark, docs, span, gram, hot).join(shared, ["t1", "t2"], "full")
    both = _keyed_texts(docs).join(spans, ["t1", "t2"], "left").selectExpr("doc_id", "text", "spans", "coalesce(n_shared, 0L) n_shared")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", *["kept"] * texts]

    def run(batches):
        for batch in batches:
            rows = []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                kept, gone, count = _kept(raw, own.as_py())
                rows.append((len(raw), gone, count, sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * texts)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made[:4], batch.column("n_shared"), *made[4:]], names)

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept binary" * texts)
