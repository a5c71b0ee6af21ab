"""Training-order materialisation: fixed-stride token shards in a keyed pseudo-random order.

Each text becomes byte-pair token ids and an end mark, cut into sequences of SEQ_LEN, and is written as a token table
once. Sequences are numbered by (file, row, part) of the input table, which doesn't depend on how Spark splits it: each
row knows its place in its split, and running sums over files and over each file's splits number these. A keyed Feistel
permutation of [0, N) with cycle-walking gives each sequence its global slot. Sequences are dealt to range partitions
of slots, each of whole shards of a set number of sequences, whatever the table's size; a shard is rows (shard, block, first_slot, records, payload), payload being `records` records of a fixed
stride, so slot s lies at byte stride * (s - first slot of its shard) and a reader can begin at any slot. Spark's
commit makes a table whole or absent, and a lost executor's tasks give the same rows again.

A record: doc_id int64 (null: the smallest int64), part int32, tokens int32, then SEQ_LEN uint16 ids, zeros after the
tokens. A null or empty text is one sequence of the end mark. Repeated rows are sequences of their own, also where a
frame reads one file twice. Columns beyond
doc_id and text are not read. An empty table gives no shard.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import mix, stored

SEQ_LEN, SEQS_PER_SHARD, BLOCK, ROUNDS = 512, 16384, 256, 4
#: Range partitions at most; more shards share one, in order, and are as large as ever.
PARTITIONS = 20_000
NO_ID = -(1 << 63)
HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("tokens", "<i4")])


def _round_keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The slots of indices in [0, n) (or with `back` the indices of slots): a keyed bijection of [0, n)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)
    x = index.astype(np.uint64)
    walk = np.ones(len(x), bool)
    while walk.any():  # on average under four walks, as the square covers at most four times the range
        left, right = x[walk] >> half, x[walk] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        x[walk] = left << half | right
        walk = x >= np.uint64(n)
    return x.astype(np.int64)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(path: str):
    """(function of a text giving its ids, the end mark's id) of a file of byte-pair ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end = max(ranks.values()) + 1
    if end > 65535:
        raise ValueError("ids must fit into 16 bits")
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder.encode_ordinary, end


def _token_pass(path: str, length: int):
    """Rows (f, first, p, at, doc_id, ids): the split's file and first row, its task and number there, and its sequences before this row."""

    def run(batches):
        encode, end = tokenizer(path)
        split = TaskContext.get().partitionId() << 32
        file = first = after = None
        at = 0
        for batch in batches:
            ats, firsts, splits, ids = [], [], [], []
            for f, r, text in zip(batch.column("f").to_pylist(), batch.column("r").to_pylist(), batch.column("text"), strict=True):
                if (f, r) != (file, after):
                    file, first, at, split = f, r, 0, split + 1
                after = r + 1
                own = np.array([*encode(text.as_py() or ""), end], "<u2")
                ats.append(at)
                firsts.append(first)
                splits.append(split)
                ids.append(own.tobytes())
                at += -(-len(own) // length)
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(firsts, pa.int64()), pa.array(splits, pa.int64()), pa.array(ats, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary())], ["f", "first", "p", "at", "doc_id", "ids"])

    return run


def _deal_pass(length: int, n: int, key: int, per_shard: int):
    """Rows (shard, slot, doc_id, part, ids) of sequences from rows (at, doc_id, ids), `at` numbering a text's first."""
    columns = ["shard", "slot", "doc_id", "part", "ids"]

    def run(batches):
        for batch in batches:
            index, doc, part, own = [], [], [], []
            for at, d, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for k in range(0, len(ids), 2 * length):
                    own.append(ids[k : k + 2 * length])
                    part.append(k // (2 * length))
                    index.append(at + part[-1])
                    doc.append(NO_ID if d is None else d)
            slot = permute(np.array(index, np.int64), n, key)
            for k in range(0, len(own), 4096):
                e = slice(k, k + 4096)
                yield pa.RecordBatch.from_arrays([pa.array((slot[e] // per_shard).astype(np.int32)), pa.array(slot[e]), pa.array(doc[e], pa.int64()), pa.array(part[e], pa.int32()), pa.array(own[e], pa.binary())], columns)

    return run


def _pack_pass(length: int, per_shard: int):
    """Blocks of records from the rows of whole shards in the order of slots."""

    def block(rows):
        head = np.zeros(len(rows), HEAD)
        body = np.zeros((len(rows), length), "<u2")
        for i, (_, _, doc, part, ids) in enumerate(rows):
            head[i] = doc, part, len(ids) // 2
            body[i, : len(ids) // 2] = np.frombuffer(ids, "<u2")
        payload = np.concatenate([head.view(np.uint8).reshape(len(rows), -1), body.view(np.uint8)], axis=1).tobytes()
        shard, slot = rows[0][:2]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([slot % per_shard // BLOCK], pa.int32()), pa.array([slot]), pa.array([len(rows)], pa.int32()), pa.array([payload], pa.binary())], ["shard", "block", "first_slot", "records", "payload"])

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[0] != held[0][0] or len(held) == BLOCK):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


def write_shards(spark: SparkSession, docs: DataFrame, key: int = 2024, ranks: str | None = None, length: int = SEQ_LEN, per_shard: int = SEQS_PER_SHARD) -> DataFrame:
    """The table of shards (see the module) of docs (doc_id, text), read from files; other inputs are written first."""
    if not _from_files(docs):
        docs = stored(spark, docs.select("doc_id", "text"), "sequences")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "_metadata.file_path f", "_metadata.row_index r")
    tokens = stored(spark, docs.mapInArrow(_token_pass(ranks or default_ranks(), length), "f string, first long, p long, at long, doc_id long, ids binary"), "tokens")
    splits = tokens.groupBy("f", "first", "p").agg(F.max(F.expr(f"at + ceil(length(ids) / {2 * length})")).cast("long").alias("n"))
    files = splits.groupBy("f").agg(F.sum("n").alias("n"))
    files = files.select("f", F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_base"))
    inner = Window.partitionBy("f").orderBy("first", "p").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.withColumn("base", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(files, "f").selectExpr("f", "first", "p", "file_base + base base", "n")
    bases = stored(spark, bases, "bases")
    n = bases.agg(F.sum("n")).first()[0] or 0
    numbered = tokens.join(bases.drop("n"), ["f", "first", "p"]).selectExpr("base + at at", "doc_id", "ids")
    dealt = numbered.mapInArrow(_deal_pass(length, n, key, per_shard), "shard int, slot long, doc_id long, part int, ids binary")
    shards = max(1, -(-n // per_shard))
    each = -(-shards // PARTITIONS)
    dealt = dealt.repartitionById(-(-shards // each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("slot")
    return stored(spark, dealt.mapInArrow(_pack_pass(length, per_shard), "shard int, block int, first_slot long, records int, payload binary"), "shards")


def _from_files(docs: DataFrame) -> bool:
    """Whether each row of docs has a file and a row number of its own."""
    from pyspark.errors import AnalysisException

    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def records(shards: DataFrame, length: int = SEQ_LEN, from_slot: int = 0) -> DataFrame:
    """(slot, shard, offset, doc_id, part, n_tokens, crc32) of each stored record from a slot on, read back from the payloads."""
    stride = HEAD.itemsize + 2 * length

    def run(batches):
        for batch in batches:
            for shard, block, first, n, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = np.frombuffer(payload, np.uint8).reshape(n, stride)
                head = np.ascontiguousarray(raw[:, : HEAD.itemsize]).view(HEAD).ravel()
                body = np.ascontiguousarray(raw[:, HEAD.itemsize :])
                crc = [zlib.crc32(b[: 2 * t].tobytes()) for b, t in zip(body, head["tokens"].tolist(), strict=True)]
                slot = np.arange(first, first + n)
                keep = slot >= from_slot
                yield pa.RecordBatch.from_arrays(
                    [x.filter(pa.array(keep)) for x in (
                        pa.array(slot), pa.array(np.full(n, shard, np.int32)), pa.array((block * BLOCK + np.arange(n)) * stride), pa.array(head["doc_id"], mask=head["doc_id"] == NO_ID),
                        pa.array(head["part"].astype(np.int32)), pa.array(head["tokens"].astype(np.int32)), pa.array(crc, pa.int64()))],
                    ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "crc32"],
                )

    rows = shards.where(F.col("first_slot") + F.col("records") > from_slot)
    return rows.select("shard", "block", "first_slot", "records", "payload").mapInArrow(run, "slot long, shard int, offset long, doc_id long, part int, n_tokens int, crc32 long")


def export_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as folder/shard-NNNNNN.bin where the folder is mounted on every executor; (shard, n_bytes) of each.

    A shard is written under another name and renamed at its end, so a file is whole or absent and a lost task is repeated.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        now, f, size = None, None, 0

        def close():
            f.close()
            os.replace(f.name, f"{folder}/shard-{now:06d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([size], pa.int64())], ["shard", "n_bytes"])

        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                if shard != now:
                    if f:
                        yield close()
                    now, size = shard, 0
                    f = open(f"{folder}/.shard-{shard:06d}.{TaskContext.get().taskAttemptId()}", "wb")  # noqa: SIM115
                size += f.write(payload.as_py())
        if f:
            yield close()

    return shards.repartition("shard").sortWithinPartitions("shard", "block").select("shard", "payload").mapInArrow(run, "shard int, n_bytes long")
