"""Hard negatives, MinHash near-dedup and fill-in-the-middle against brute-force versions and on the odd rows."""

import re
from hashlib import sha256

import numpy as np
import pytest

from gridloom.llm import fill_middle, hard_negatives, minhash, ngram_join

from .conftest import key, rows_of
from .test_edges import near_copies
from .test_operators import words


@pytest.fixture(params=["odd", "small", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def brute_alike(rows, size, percent=80):
    """(doc_id, set size, component, kept) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    found = [least.get(find(i), doc) if sets[i] else doc for i, (doc, _) in enumerate(rows)]
    return sorted(((doc, len(sets[i]), found[i], doc == found[i]) for i, (doc, _) in enumerate(rows)), key=key)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates(spark, docs):
    got = minhash.near_duplicates(spark, docs)
    assert rows_of(got, *COLUMNS) == brute_alike([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2)


@pytest.mark.parametrize("changed", [4, 9, 14, 22])
def test_copies_near_the_threshold(spark, changed):
    """Copies of one text, each changed elsewhere: pairs above, at and below the similarity, linked through each other or not."""
    rows = near_copies(160, changed) + [(5000 + i, f"a{i} b c") for i in range(5)] + [(6000, "a1 b c"), (6001, "c a1 b")]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, *COLUMNS) == brute_alike(rows, 2)


def test_two_families_in_shared_buckets(spark):
    """Texts that share half of their words meet in many buckets and are no copies; each family stays for itself."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100 * f + i, " ".join(base[:120] + [f"f{f}_{k}" for k in range(70)] + [f"x{f}_{i}_{k}" for k in range(6)])) for f in range(12) for i in range(8)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_alike(rows, 2)
    assert rows_of(got, *COLUMNS) == want and len({c for _, _, c, _ in want}) == 12


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for n, shared in ((4, 4), (20, 18), (400, 360), (3000, 2700)):
        both = [rng.integers(0, 1 << 63, n + n - shared, dtype=np.int64).astype(np.uint64) for _ in range(60)]
        one, two = minhash.signatures([np.unique(x[:n]) for x in both]), minhash.signatures([np.unique(x[-n:]) for x in both])
        assert abs((one == two).mean() - shared / (n + n - shared)) < 0.05
        assert ((minhash.band_keys(one) == minhash.band_keys(two)).sum(axis=1) > 0).all()
    assert (minhash.signatures([np.zeros(0, np.uint64)]) == np.iinfo(np.uint64).max).all()


def test_kept_documents(spark, odd):
    kept = minhash.kept_documents(spark, odd)
    want = {d for d, _, _, k in brute_alike([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 2) if k and d is not None}
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} - {None} <= want | {r.doc_id for r in odd.where("text is null").collect()}


def test_saturated_sketch_cells_stay_hot(spark):
    from gridloom.llm.common import merged_sketch, sketch_rows

    def run(batches):
        for _ in batches:
            pass
        yield sketch_rows(np.full(64, 40_000, np.uint16), 1)

    rows = spark.range(4, numPartitions=4).mapInArrow(run, "block int, part int, cells binary")
    assert (merged_sketch(rows, "add", "uint16", 64) == 65535).all() and ngram_join.HOT <= 65535


def token_texts():
    return ["", " ", "a", " a", "a ", "a b", "  a\t\nb  ", "é ü", "x" * 100, " ".join("ab c d".split() * 90), "a\x0bb\x0cc", "\x85 a b", "a<P>b c", "▁ b  c"]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 16])
def test_cuts_at_every_chunk_size(chunk):
    texts = token_texts() * 3
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rng = np.random.default_rng(chunk)
    h1, h2 = rng.integers(0, 1 << 32, (2, len(raw)))
    n, a, b = fill_middle.cut_ranks(np.frombuffer(b"".join(raw), np.uint8), offs, h1, h2, chunk)
    for i, t in enumerate(texts):
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        k = sorted((h1[i] % (len(tokens) + 1), h2[i] % (len(tokens) + 1)))
        assert (n[i], a[i], b[i]) == (len(tokens), *(len("".join(tokens[:x]).encode()) for x in k))


def test_long_text_in_many_slices(monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 1000)
    text = (b"word  and another\n" * 3000) + b"  "
    n, a, b = fill_middle.cut_ranks(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([5000]), np.array([9001]), 64)
    tokens = re.findall(r"\s*\S+|\s+", text.decode())
    assert (n[0], a[0], b[0]) == (9001, len("".join(tokens[:5000])), len("".join(tokens[:9001])))


def test_fill_middle(spark, docs):
    got = fill_middle.digests(docs)
    want = []
    for r in docs.select("doc_id", "text").collect():
        t, h = r.text or "", sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        i, j = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((r.doc_id, len(tokens), form, *((None, None) if form == "plain" else (len(p), len(m))), sha256(out.encode()).hexdigest(), sha256(t.encode()).hexdigest()))
    assert rows_of(got, *got.columns) == sorted(want, key=key)


def test_rewritten_texts_come_back(spark, odd):
    """Parts that end or begin like markers, and the operator's own columns next to those of docs."""
    rows = [(i, t, "kept") for i, t in enumerate(["x<S <S> y", "a <P", "<S > b<M", "> > <", "P> S> M>", "<<< <P <S <M c"] * 30)]
    some = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for df in (some, odd):
        out = fill_middle.transformed(df, rate=100)
        assert set(out.columns) == {*df.columns, *fill_middle.MADE}
        assert out.where(~fill_middle.restored(out.output, out.form).eqNullSafe(out.text) & out.text.isNotNull()).count() == 0
    assert {r.form for r in fill_middle.transformed(some, rate=100).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def vectors(n, dims, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, scale, dims)], int(rng.integers(0, 10))) for i in range(n)]


def brute_negatives(rows, modulus=100, k=5):
    fit = [(i, [int(np.floor(256.0 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for a, v, lab in {(i, tuple(v), lab) for i, v, lab in fit if i is not None and i % modulus == 0}:
        others = [(sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, w, own in fit if len(w) == len(v) and i != a]
        for p, pid, _ in sorted((c for c in others if c[2] == lab), key=order)[:k]:
            some = sorted((c for c in others if c[2] != lab and 80 * p <= 100 * c[0] <= 100 * p), key=order)[:k]
            out += [(a, pid, rank + 1, nid, p, n) for rank, (n, nid, _) in enumerate(some)]
    return sorted(out, key=key)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("block_bytes", [1 << 23, 1500])
def test_hard_negatives(spark, block_bytes):
    rows = vectors(400, 8) + [(7000, None, 3), (7100, [0.5, None] * 4, 3), (7200, [float("nan")] + [0.1] * 7, 2), (7300, [0.1] * 8, None), (7400, [float("inf")] * 8, 1)]
    rows += [(None, [0.3] * 8, 4), (500, [], 1), (600, [], 1), (601, [], 2), (700, [0.25] * 3, 5), (701, [0.25] * 3, 5), (702, [0.22] * 3, 6)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.5, 0.0, 0.0, 0.5], i % 3) for i in range(150)]  # ties without end
    rows += rows[100:104]  # repeated rows, one of them an anchor
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = hard_negatives.mined(spark, df, block_bytes=block_bytes)
    assert rows_of(got, *NEGATIVES) == brute_negatives(rows)


def test_hard_negatives_of_large_components(spark):
    """Scores beyond 2**53 are compared as whole numbers."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(2_000_000, 2_000_900, 4)], int(i % 4)) for i in range(0, 300)] + [(3000 + i, [0.5] * 4, i % 4) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert rows_of(hard_negatives.mined(spark, df), *NEGATIVES) == brute_negatives(rows)


def test_hard_negatives_of_none_and_labels(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, score int")
    assert hard_negatives.mined(spark, none).count() == 0
    rows = spark.createDataFrame([(7, [1.0], 9), (14, [1.0], None), (8, [1.0], 9), (None, [1.0], 3)], "vec_id long, embedding array<float>, label int")
    assert rows_of(hard_negatives.relabelled(rows), "vec_id", "label") == sorted([(7, 0), (8, 9), (14, None), (None, 3)], key=key)


def test_a_file_read_twice_by_one_task(spark, tmp_path):
    from gridloom.llm import training_order

    p = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"word{i} " * (i % 40)) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(p)
    was = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        docs = spark.read.parquet(p, p)
        assert docs.rdd.getNumPartitions() == 1
        got = training_order.records(training_order.write_shards(spark, docs, length=32, per_shard=50), 32).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if was is None else spark.conf.set("spark.sql.files.minPartitionNum", was)
    assert sorted(r.slot for r in got) == list(range(len(got))) and len(got) % 2 == 0


def test_lines_whose_words_agree_in_their_low_bits_stay_apart(spark):
    """Words whose hashes share 16 bits are different words: a line isn't joined to a template by them."""
    from gridloom.llm import line_templates

    def tokens(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return line_templates.line_hashes(raw, np.array([0, len(raw)]))["tokens"]

    words = np.array([f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}{chr(97 + e)}" for a in range(26) for b in range(26) for c in range(26) for e in range(4)])
    low = tokens(" ".join(words)) & np.uint64(0xFFFF)
    order = np.argsort(low, kind="stable")
    same = np.flatnonzero(low[order][1:] == low[order][:-1])[:24:2]
    pairs = [(words[order[k]], words[order[k + 1]]) for k in same]
    one, other = (" ".join(["the", "same", "begin", *(p[k] for p in pairs)]) for k in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, other), (3, "alone here")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.digests(spark, docs).collect()} == {1: 0, 2: 0, 3: 0}
