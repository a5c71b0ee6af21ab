"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's letters, lower-cased byte by byte, give hashed byte 3- and 4-grams inside words (with their borders); their
embeddings are averaged and classified. Training is stochastic gradient descent in numpy on a bounded sample: for each
language about PER_LANG labelled documents (fewer where languages are so many that all would exceed SAMPLE), chosen by a
hash of doc_id, of each at most SAMPLE_CHARS characters in a row, as one text and as fragments. A fifth of the sample is kept back to fit the softmax's temperature and the bounds of rejection. For
prediction embeddings and softmax are one table of BUCKETS rows, so whole texts of any length cost one gather a gram.

A softmax must name one of its languages, however strange a text is to all. So a prediction is rejected by how well the
text's grams are known from the language it gave: the mean logarithm of their frequency there over an even one, plus
one standard error, as short texts vary. Each language's bound splits its kept-back texts from what is not of it: the
kept-back texts of every other language, as they would meet it with their own left out, and all with shuffled bytes.
At most LOST of its own texts may lie below. A language without a kept-back text takes the lowest bound of the others;
where nothing is kept back (under 10 texts) only texts without a letter are rejected.

A null text or one without a letter is `und` with score 0 and rejected, as is everything where no row can be learned
from. Rows of the fold `held_out` (crc32 of doc_id as text, modulo 4, is 2) are never learned from; nor are rows of a
null doc_id, which are not held out. lang, source and doc_id are no input of a prediction. Repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import text_slices

BUCKETS, DIM, ORDERS = 1 << 15, 8, (3, 4)
PER_LANG, SAMPLE, SAMPLE_CHARS = 1200, 24_000, 20_000
EPOCHS, RATE, FRAGMENTS = 4, 40.0, 3
#: Share of a language's calibration texts that may be rejected; what is added to each gram's count.
LOST, UNSEEN = 0.005, 0.1
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each gram of the rows; each row is read as if spaces stood around it."""
    rows = len(offs) - 1
    size = np.diff(offs)
    b = np.full(len(data) + 2 * rows, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, size)
    b[at] = _FOLD[data]
    row = np.repeat(np.arange(rows), size + 2)
    space = b == 32
    out, of = [], []
    w = b.astype(np.uint32)
    for n in ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        inner = space[1 : m + 1].copy()
        for k in range(2, n - 1):
            inner |= space[k : m + k]
        keep = ~inner & (row[:m] == row[n - 1 :])
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ w[k : m + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        keep = np.flatnonzero(keep)
        out.append((h[keep] & np.uint32(BUCKETS - 1)).astype(np.int32))
        of.append(row[keep])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = total[offs[1:]] > total[offs[:-1]]
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~found & (wide[offs[1:]] > wide[offs[:-1]])):
        found[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, langs): each gram's share in the logits, over the temperature
    bias: np.ndarray
    known: np.ndarray  # (BUCKETS, langs): logarithm of each gram's frequency in the language over an even one
    spread: np.ndarray  # its deviation over the language's grams
    bound: np.ndarray  # what a text of the language must reach

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its probability and whether it is rejected for each row; -1, 0 and true without a letter."""
        rows, k = len(offs) - 1, len(self.langs)
        best, score, rejected = np.full(rows, -1), np.zeros(rows), np.ones(rows, bool)
        if not k or not rows:
            return best, score, rejected
        bucket, row = grams(data, offs)
        count = np.bincount(row, minlength=rows)
        logits = np.stack([np.bincount(row, weights=self.table[bucket, j], minlength=rows) for j in range(k)], axis=1)
        logits = logits / np.maximum(count, 1)[:, None] + self.bias
        p = _softmax(logits)
        some = has_letter(data, offs)
        first = p.argmax(axis=1)
        n = np.maximum(count, 1)
        mean = np.bincount(row, weights=self.known[bucket, first[row]], minlength=rows) / n
        best[some], score[some] = first[some], p[some].max(axis=1)
        rejected[some] = (mean + self.spread[first] / np.sqrt(n) < self.bound[first])[some]
        return best, score, rejected


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _one(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    bucket, _ = grams(data, np.array([0, len(data)]))
    return np.unique(bucket, return_counts=True)


def _bound(own: np.ndarray, other: np.ndarray) -> float:
    """The value that splits own (above) from other with the smallest sum of both wrong shares, amid the widest gap; at most LOST of own lie below."""
    own, other = np.sort(own), np.sort(other)
    at = np.unique(np.concatenate([own, other]))
    middle = (at[1:] + at[:-1]) / 2
    if not len(middle):
        return -np.inf
    wrong = np.searchsorted(own, middle) / len(own) + 1 - np.searchsorted(other, middle) / len(other)
    gap = np.where(wrong <= wrong.min() + 1e-12, np.diff(at), -1)
    return float(min(middle[int(gap.argmax())], np.quantile(own, LOST)))


def _shuffled(text: bytes, rng: np.random.Generator) -> bytes:
    return rng.permutation(np.frombuffer(text, np.uint8)).tobytes()


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """Train on the texts; about a fifth of them only calibrates."""
    langs = sorted(set(labels))
    k = len(langs)
    if not k:
        none = np.zeros((BUCKETS, 0), np.float32)
        return LanguageModel([], none, np.zeros(0), none, np.zeros(0), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    back = set(order[: len(texts) // 5].tolist()) if len(texts) >= 10 else set()
    train, keep = [], []
    for i, (text, lang) in enumerate(zip(texts, labels, strict=True)):
        raw, y = text.encode(), langs.index(lang)
        pieces = [raw]
        for _ in range(FRAGMENTS):
            n = int(np.exp(rng.uniform(np.log(12), np.log(300))))
            at = int(rng.integers(0, max(1, len(raw) - n)))
            pieces.append(raw[at : at + n])
        for j, piece in enumerate(pieces):
            if len((f := _one(piece))[0]):
                (keep if i in back else train).append((*f, y, j == 0))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, k)), np.zeros(k)
    step, steps = 0, max(1, EPOCHS * len(train))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            idx, n, y, _ = train[i]
            share = n / n.sum()
            lr = 0.5 * (1 - step / steps)
            step += 1
            mean = share @ emb[idx]
            g = _softmax(mean @ out + bias)
            g[y] -= 1
            back_mean = out @ g
            out -= lr * np.outer(mean, g)
            bias -= 0.1 * lr * g
            emb[idx] -= lr * RATE * share[:, None] * back_mean
    table = emb @ out
    keep = keep or train
    logits = np.array([(n / n.sum()) @ table[idx] + bias for idx, n, _, _ in keep])
    ys, whole = np.array([x[2] for x in keep]), np.array([x[3] for x in keep])
    temps = np.exp(np.linspace(np.log(0.2), np.log(8), 60))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(ys)), ys] + 1e-12).mean() for t in temps]
    t = float(temps[int(np.argmin(loss))])
    seen = np.full((BUCKETS, k), UNSEEN)
    for idx, n, y, all_of_it in train:
        if all_of_it:
            seen[idx, y] += n
    share = seen / seen.sum(axis=0)
    known = np.log(share * BUCKETS)
    spread = np.sqrt((share * known**2).sum(axis=0) - (share * known).sum(axis=0) ** 2)

    def reached(n, idx):
        return (n / n.sum()) @ known[idx] + spread / np.sqrt(n.sum())

    bound = np.full(k, -np.inf)
    if back:
        own = np.array([reached(n, idx) for idx, n, _, all_of_it in keep if all_of_it]).reshape(-1, k)
        mixed = [_one(_shuffled(texts[i].encode(), rng)) for i in sorted(back)]
        mixed = np.array([reached(n, idx) for idx, n in mixed if len(idx)]).reshape(-1, k)
        for j in range(k):
            ours = ys[whole] == j
            other = np.concatenate([own[~ours, j], mixed[:, j]])
            if ours.any() and len(other):
                bound[j] = _bound(own[ours, j], other)
        bound[np.isneginf(bound)] = min(bound[~np.isneginf(bound)], default=-np.inf)
    return LanguageModel(langs, np.ascontiguousarray(table / t).astype(np.float32), bias / t, known.astype(np.float32), spread, bound)


def learn(docs: DataFrame, seed: int = 7) -> LanguageModel:
    """A model from docs (doc_id, text, lang); reads a bounded sample of the rows that are not held out."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang", f"{HELD_OUT} held_out")
    rows = rows.where("not held_out and doc_id is not null and lang is not null and text is not null")
    counts = rows.groupBy("lang").count()
    # a hash below each / count picks about so many rows of each language
    n = counts.count()
    each = min(PER_LANG, SAMPLE / max(1, n))
    picked = rows.join(F.broadcast(counts) if n <= 1000 else counts, "lang").where(f"pmod(xxhash64(doc_id, {seed}), 1000000007) < {each}d / count * 1000000007d")
    # of a longer text a stretch of SAMPLE_CHARS, its begin by a hash
    picked = picked.withColumn("text", F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id, {seed}, 'begin'), greatest(length(text) - {SAMPLE_CHARS}, 0) + 1) as int), {SAMPLE_CHARS})"))
    found = sorted((r.doc_id, r.text, r.lang) for r in picked.select("doc_id", "text", "lang").collect())
    return fit([r[1] for r in found], [r[2] for r in found], seed)


def predicted(spark: SparkSession, docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of docs; trains on docs where no model is given."""
    shared = spark.sparkContext.broadcast(model or learn(docs))

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part, data, offs in text_slices(batch):
                best, score, rejected = m.predict(data, offs)
                keep = [part.column("doc_id"), part.column("held_out")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", f"{HELD_OUT} held_out", "cast(text as string) text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose text the model accepts. A narrow pass."""
    shared = spark.sparkContext.broadcast(learn(docs))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, data, offs in text_slices(batch):
                yield part.filter(pa.array(~m.predict(data, offs)[2]))

    return docs.mapInArrow(run, docs.schema)
