"""Line dedup by a log-template tree: lines that differ in variable fields only are one template, recurring ones go.

Tokens of a line are runs of other characters than space and \\t to \\r; a token with a digit is a field. The tree has
a fixed depth: token count, then the first LEADING tokens (fields as one). In a leaf lines meet in order of their hash;
one joins the template with which it agrees in the most positions, if these are at least ALIKE of them, and positions
that differ become fields; else it founds a template. A template that MIN_DOCS
different texts hold recurs: its lines are dropped from all documents but the one of the smallest doc_id that has it
(and exact copies of that text). Exact copies of a text count once.

One pass makes a row of line hashes for each document and packs each line once a worker's flush by leaf, as two bytes
a token; leaves are parsed apart from each other. Everything else joins on hashes of lines and texts.

A null text has no lines and stays null; lines without a token always stay. Repeated rows are copies of a text; a null
doc_id is never a keeper unless no other document has the template. Extra columns are kept by deduped(). Lines of any
length and number work.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.common import mix, prefix_hash, range_hash, stored, text_slices
from gridloom.llm.ngram_join import word_bounds

LEADING, ALIKE, MIN_DOCS = 3, 0.7, 2
FLUSH_LINES, BUCKETS_LEAST, BUCKET_LINES = 200_000, 48, 100_000
#: Templates of a leaf that are all compared with each line; positions that are compared at once.
FEW, COMPARED = 64, 1 << 21
#: Recurring lines (16 bytes each) that a caller lets be sent to every worker; by default none, so one plan serves any size.
SHARED_LINES = 0
#: A token of a leaf's lines: the low half of its hash.
TOKEN = np.dtype("<u4")
_FIELD = np.uint64(0x2545F4914F6CDD1D)
_K = 0x9FB21C651E98DF25


def line_hashes(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with a token: row, number in the row, token count, hash, leaf, first token; and all tokens' hashes."""
    begin, end, row = word_bounds(data, offs)
    if not len(begin):
        return {n: np.zeros(0, np.int64) for n in ("row", "number", "count", "first")} | {n: np.zeros(0, np.uint64) for n in ("hash", "leaf", "tokens")}
    h = range_hash(prefix_hash(data), begin, end)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    h[digits[end] > digits[begin]] = _FIELD
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    number = breaks[begin] - breaks[offs[row]]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    place = np.arange(len(row)) - np.repeat(first, count)
    power = np.cumprod(np.concatenate([[1], np.full(int(count.max()), _K, np.uint64)]).astype(np.uint64))
    part = mix(h) * power[place]
    size = count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    lead = np.where(place < LEADING, part, np.uint64(0))
    return {"row": row[first], "number": number[first], "count": count, "first": first, "hash": mix(np.add.reduceat(part, first) + size), "leaf": mix(np.add.reduceat(lead, first) ^ size), "tokens": h}


def _text_keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    whole = data.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _line_pass(buckets: int):
    """Rows (doc_id, t, lines, ...) of documents and (..., bucket, packed) of lines by leaf."""
    names = ["doc_id", "t", "lines", "bucket", "packed"]

    def flush(held):
        n = len(held)
        out = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(list(held), pa.int32()), pa.array([b"".join(x) for x in held.values()], pa.binary())], names)
        held.clear()
        return out

    def run(batches):
        held, seen = {}, set()
        for batch in batches:
            for part, data, offs in text_slices(batch):
                f = line_hashes(data, offs)
                rows = len(offs) - 1
                keys = _text_keys(data, offs)
                cut = np.searchsorted(f["row"], np.arange(rows + 1))
                signed = f["hash"].view(np.int64)
                lines = [np.unique(signed[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys), pa.array(lines, pa.list_(pa.int64())), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
                _, once = np.unique(signed, return_index=True)
                once = once[f["count"][once] > LEADING]  # shorter lines have no position left to differ in
                short = np.maximum(f["tokens"] & np.uint64(0xFFFFFFFF), np.uint64(1)).astype(TOKEN)  # 0 is left to fields
                short[f["tokens"] == _FIELD] = 0
                bucket = (f["leaf"] % np.uint64(buckets)).astype(np.int64)
                for b, h, leaf, n, at in zip(bucket[once].tolist(), f["hash"][once].tolist(), f["leaf"][once].tolist(), f["count"][once].tolist(), f["first"][once].tolist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        held.setdefault(b, []).append(h.to_bytes(8, "little") + leaf.to_bytes(8, "little") + n.to_bytes(4, "little") + short[at : at + n].tobytes())
                if len(seen) > FLUSH_LINES:
                    yield flush(held)
                    seen.clear()
        if held:
            yield flush(held)

    return run


class _Leaf:
    """A leaf's templates as rows of tokens, and those that may agree with a line.

    While they are few, all may. Beyond, the positions after the leading ones are cut into one part more than positions
    may differ, so a template that agrees with a line has a part that differs nowhere. A part is found by which of its
    positions are fields and what the others are; a line asks for each pattern of fields that its leaf has.
    """

    def __init__(self, n: int, least: int, kind: np.dtype = TOKEN):
        self.n, self.count = n, 0
        self.rows = np.zeros((4, n), kind)
        parts = n - least + 1
        self.edges = [LEADING + (n - LEADING) * k // parts for k in range(parts + 1)]
        self.index: list[dict[bytes, dict[bytes, set[int]]]] | None = None

    def _parts(self, m: int):
        """(part, pattern of fields, tokens) of a template."""
        row = self.rows[m]
        for k, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            yield k, (row[a:b] != 0).tobytes(), row[a:b].tobytes()

    def add(self, tokens: np.ndarray) -> int:
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.count] = tokens
        self.count += 1
        if self.index is not None:
            self._enter(self.count - 1)
        elif self.count > FEW:
            self.index = [{} for _ in self.edges[1:]]
            for m in range(self.count):
                self._enter(m)
        return self.count - 1

    def _enter(self, m: int) -> None:
        for k, kind, own in self._parts(m):
            self.index[k].setdefault(kind, {}).setdefault(own, set()).add(m)

    def widen(self, m: int, tokens: np.ndarray) -> None:
        """Positions of template m that differ from the tokens become fields."""
        differs = (self.rows[m] != tokens) & (self.rows[m] != 0)
        if differs.any():
            old = list(self._parts(m)) if self.index is not None else []
            self.rows[m, differs] = 0
            for k, kind, own in old:
                self.index[k][kind][own].discard(m)
            if old:
                self._enter(m)

    def best(self, tokens: np.ndarray) -> tuple[int, int]:
        """The template that agrees with the tokens in the most positions, the first of equals, and their number."""
        if self.index is None:
            asked = np.arange(self.count)
        else:
            found = set()
            for k, kinds in enumerate(self.index):
                part = tokens[self.edges[k] : self.edges[k + 1]]
                for kind, own in kinds.items():
                    found |= own.get((part * np.frombuffer(kind, bool)).tobytes(), set())
            asked = np.array(sorted(found), np.int64)
        best, most = -1, -1
        step = max(1, COMPARED // self.n)
        for at in range(0, len(asked), step):
            some = self.rows[asked[at : at + step]]
            agree = np.count_nonzero((some == tokens) | (some == 0), axis=1)
            if agree[k := int(agree.argmax())] > most:
                best, most = int(asked[at + k]), int(agree[k])
        return best, most


def templates_of(lines: list[tuple[int, np.ndarray]], alike: float = ALIKE) -> list[tuple[int, int]]:
    """(line, template) of a leaf's lines (hash, tokens; 0 is a field), in order; a template is named by its founder."""
    n = len(lines[0][1])
    least = next(c for c in range(max(0, int(alike * n) - 1), n + 1) if c / n >= alike)
    leaf, names, out = _Leaf(n, least, lines[0][1].dtype), [], []
    for name, tokens in lines:
        m, agree = leaf.best(tokens)
        if agree < least:
            m = leaf.add(tokens)
            names.append(name)
        else:
            leaf.widen(m, tokens)
        out.append((name, names[m]))
    return out


def _parse_bucket(table: pa.Table) -> pa.Table:
    """Rows (line, template) of lines whose template is another's."""
    leaves: dict[int, dict[int, np.ndarray]] = {}
    for blob in table.column("packed").to_pylist():
        at = 0
        while at < len(blob):
            h, leaf, n = int.from_bytes(blob[at : at + 8], "little"), int.from_bytes(blob[at + 8 : at + 16], "little"), int.from_bytes(blob[at + 16 : at + 20], "little")
            leaves.setdefault(leaf, {})[h] = blob[at + 20 : at + 20 + TOKEN.itemsize * n]
            at += 20 + TOKEN.itemsize * n
    line, template = [], []
    for own in leaves.values():
        if len(own) > 1:
            for a, b in templates_of([(h, np.frombuffer(own[h], TOKEN)) for h in sorted(own)]):
                if a != b:
                    line.append(a)
                    template.append(b)
    return pa.table({"line": pa.array(np.array(line, np.uint64).view(np.int64)), "template": pa.array(np.array(template, np.uint64).view(np.int64))})


def recurring_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(line, keeper): hashes of all lines of recurring templates and the text that keeps them; and (t, line) of all texts."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    buckets = max(BUCKETS_LEAST, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // (100 * BUCKET_LINES))
    found = stored(spark, docs.mapInArrow(_line_pass(buckets), "doc_id long, t long, lines array<long>, bucket int, packed binary"), "lines")
    joined = found.where("bucket is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(_parse_bucket, "line long, template long")
    joined = stored(spark, joined, "templates")
    texts = found.where("bucket is null").groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.first("lines").alias("lines"))
    rows = stored(spark, texts.select("t", "doc_id", F.explode("lines").alias("line")), "rows")
    named = rows.join(joined, "line", "left").selectExpr("t", "doc_id", "coalesce(template, line) template").distinct()
    counts = named.groupBy("template").agg(F.count("*").alias("texts"), F.expr("min_by(t, struct(coalesce(doc_id, 9223372036854775807), t))").alias("keeper"))
    recurring = stored(spark, counts.where(F.col("texts") >= min_docs).select("template", "keeper"), "recurring")
    lines = joined.join(recurring, "template").select("line", "keeper").union(recurring.select("template", "keeper"))
    return stored(spark, lines, "recurring_lines"), rows.select("t", "line")


def _cleaned(spark: SparkSession, docs: DataFrame, min_docs: int, shared_lines: int):
    """docs as batches of (rows, their texts' bytes and offsets, set of dropped line numbers for each row), for mapInArrow.

    Up to shared_lines recurring lines (16 bytes each) go to all workers; more are joined to the texts that have them.
    """
    lines, rows = recurring_lines(spark, docs, min_docs)
    if shared_lines and lines.count() <= shared_lines:
        held = sorted((r.line, r.keeper) for r in lines.collect())
        shared = spark.sparkContext.broadcast((np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)))
        source = docs
    else:
        shared = None
        key_name, own_name = (name + "_" * max(map(len, docs.columns)) for name in ("t", "lines"))  # no column's name
        own = rows.join(lines, "line").where("t <> keeper").groupBy("t").agg(F.collect_set("line").alias(own_name))

        def key(batches):
            for batch in batches:
                for part, data, offs in text_slices(batch):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_text_keys(data, offs))], [*part.schema.names, key_name])

        own = stored(spark, own, "drops").withColumnRenamed("t", key_name)
        keyed = docs.mapInArrow(key, StructType([*docs.schema, StructField(key_name, LongType())]))
        source = keyed.join(own, key_name, "left").select(*(F.col(f"`{c}`") for c in docs.columns), own_name)

    def slices(batches):
        for batch in batches:
            for part, data, offs in text_slices(batch):
                f = line_hashes(data, offs)
                h = f["hash"].view(np.int64)
                gone = [set() for _ in range(len(offs) - 1)]
                if shared is not None:
                    known, keeper = shared.value
                    if len(known) and len(h):
                        keys = _text_keys(data, offs)
                        at = np.searchsorted(known, h)
                        at[at == len(known)] = 0
                        hit = np.flatnonzero((known[at] == h) & (keeper[at] != keys[f["row"]]))
                        for r, n in zip(f["row"][hit].tolist(), f["number"][hit].tolist(), strict=True):
                            gone[r].add(n)
                else:
                    mine = [set(x.as_py() or ()) for x in part.column(part.num_columns - 1)]
                    for r, n, x in zip(f["row"].tolist(), f["number"].tolist(), h.tolist(), strict=True):
                        if x in mine[r]:
                            gone[r].add(n)
                yield part, data, offs, gone

    return source, slices


def _without(raw: bytes, gone: set[int]) -> bytes:
    return b"\n".join([x for k, x in enumerate(raw.split(b"\n")) if k not in gone]) if gone else raw


def deduped(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, shared_lines: int = SHARED_LINES) -> DataFrame:
    """docs with recurring lines gone from text, and n_chars (where it is a column) counted again for those texts."""
    source, slices = _cleaned(spark, docs, min_docs, shared_lines)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for part, data, offs, gone in slices(batches):
            whole = data.tobytes()
            text = [t if not g else _without(whole[a:b], g).decode() for t, a, b, g in zip(part.column(at).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), gone, strict=True)]
            columns = list(part.columns[: len(names)])
            columns[at] = pa.array(text, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(t) if g else n for n, g, t in zip(columns[chars].to_pylist(), gone, text, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, docs.schema)


def digests(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, shared_lines: int = SHARED_LINES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row's whole text."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    source, slices = _cleaned(spark, docs, min_docs, shared_lines)

    def run(batches):
        for part, data, offs, gone in slices(batches):
            whole, rows = data.tobytes(), []
            for there, a, b, g in zip(part.column(1).is_valid().to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), gone, strict=True):
                raw = whole[a:b]
                rows.append((raw.count(b"\n") + 1 if there else 0, len(g), sha256(_without(raw, g)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return source.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
