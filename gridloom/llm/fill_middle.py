"""Fill-in-the-middle rewriting of texts, cut between tokens found by overlapping chunks.

A token is a word with the blanks before it; blanks at a text's end are a token of their own. So a token ends after a
byte of a word that a blank follows, and at the end of the text: whether one ends at a byte is a predicate of two
adjacent characters. A text is cut into chunks of CHUNK bytes that overlap by one; each chunk counts its token ends, all
chunks of some texts at once; prefix sums over the counts tell the number of tokens and the chunk that owns each of the
two cut ranks, and only these chunks are scanned again. A task holds the predicates of about SLICE_BYTES at a time, also
of a text that is longer. Rows stay where they are: nothing is shuffled, and only numbers come back from Python.

The cuts, and whether and how a text is rewritten, are numbers from a hash of seed and doc_id: prefix, middle and suffix
are at two ranks drawn from 0 to n. Forms: psm `<P>`prefix`<S>`suffix`<M>`middle, spm `<S>`suffix`<P>`prefix`<M>`middle,
plain the text itself; restored() gives the text back from output and form.

A null text is an empty one; empty texts and those that hold a marker stay plain. Rows that repeat an id draw the same
numbers, each for its own text; a null doc_id is hashed as empty. Columns of docs that have the new names give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.common import SLICE_BYTES, text_slices
from gridloom.llm.ngram_join import SPACE

CHUNK = 1 << 16
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = "42", 50, 80
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def token_ends(data: np.ndarray, begin: int, end: int, last: np.ndarray) -> np.ndarray:
    """Whether a token ends at each byte of data[begin:end]; one byte more is looked at. `last`: the last bytes of texts, sorted."""
    word = ~SPACE[data[begin : end + 1]]
    out = word[: end - begin].copy()
    out[: len(word) - 1] &= ~word[1:]
    out[last[np.searchsorted(last, begin) : np.searchsorted(last, end)] - begin] = True
    return out


def cut_ranks(data: np.ndarray, offs: np.ndarray, h1: np.ndarray, h2: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text data[offs[i]:offs[i + 1]]: its number n of tokens, and where h1 % (n + 1) and h2 % (n + 1) tokens end, the smaller first."""
    rows, size = len(offs) - 1, np.diff(offs)
    last = offs[1:][size > 0] - 1
    chunks = -(-size // chunk)
    first = np.concatenate([[0], np.cumsum(chunks)])
    row = np.repeat(np.arange(rows), chunks)
    starts = offs[:-1][row] + (np.arange(len(row)) - first[:-1][row]) * chunk
    ends = np.minimum(starts + chunk, offs[1:][row])
    count = np.zeros(len(row), np.int64)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
        found = token_ends(data, int(starts[at]), int(ends[to - 1]), last)
        count[at:to] = np.add.reduceat(found, starts[at:to] - starts[at], dtype=np.int64)
        at = to
    upto = np.concatenate([[0], np.cumsum(count)])
    base = upto[first[:-1]]
    n = upto[first[1:]] - base
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    cuts = np.zeros((2, rows), np.int64)
    for k in range(2):
        some = np.flatnonzero(ranks[k])
        owner = np.searchsorted(upto[1:], (base + ranks[k])[some])
        for i, c in zip(some.tolist(), owner.tolist(), strict=True):
            found = np.flatnonzero(token_ends(data, int(starts[c]), int(ends[c]), last))
            cuts[k, i] = starts[c] + found[base[i] + ranks[k, i] - upto[c] - 1] + 1 - offs[i]
    return n, cuts[0], cuts[1]


@F.arrow_udf(StructType([StructField(c, LongType()) for c in "nab"]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = [np.zeros((3, 0), np.int64)]
    for part, data, offs in text_slices(pa.RecordBatch.from_arrays([text, h1, h2], ["text", "h1", "h2"])):
        found.append(np.stack(cut_ranks(data, offs, part.column("h1").to_numpy(), part.column("h2").to_numpy())))
    n, a, b = np.concatenate(found, axis=1)
    return pa.StructArray.from_arrays([pa.array(n), pa.array(a), pa.array(b)], ["n", "a", "b"])


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """docs with n (tokens), form, prefix_chars and middle_chars (code points; null if plain), and output, the text as rewritten.

    `rate` of 100 texts are rewritten, `spm` of 100 of these with the suffix first.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("h"))
    h = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.select("row", "t", _cuts("t", h[0], h[1]).alias("cut"), h[2].alias("h3"), h[3].alias("h4"))
    marked = F.contains("t", F.lit(MARKS[0])) | F.contains("t", F.lit(MARKS[1])) | F.contains("t", F.lit(MARKS[2]))
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("row", "t", "cut", form.alias("form"))
    part = lambda begin, end: F.expr(f"cast(substring(cast(t as binary), cast({begin} as int) + 1, cast({end} as int) - cast({begin} as int)) as string)")
    rows = rows.select("row", "t", "form", F.col("cut.n").alias("n"), part("0", "cut.a").alias("p"), part("cut.a", "cut.b").alias("m"), F.expr("cast(substring(cast(t as binary), cast(cut.b as int) + 1) as string)").alias("s"))
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in zip(MARKS, "psm", strict=True))
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    chars = [F.when(F.col("form") != "plain", F.length(c).cast("long")) for c in "pm"]
    made = dict(zip(MADE, (F.col("n"), F.col("form"), *chars, output), strict=True))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in MADE), *(c.alias(name) for name, c in made.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of; only markers are looked at, as no rewritten text holds one."""
    body = F.substr(output, F.lit(4))
    one = F.when(form == "psm", F.substring_index(body, MARKS[1], 1)).otherwise(F.substring_index(body, MARKS[0], 1))
    rest = F.substr(body, F.length(one) + 4)
    two = F.substring_index(rest, MARKS[2], 1)
    middle = F.substr(rest, F.length(two) + 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row of docs."""
    rows = transformed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
