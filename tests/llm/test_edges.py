"""Hostile and planted inputs of single operators."""

import random
import struct
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import language, line_templates, mixing, mpeg_audio, ngram_join, personal, pieces, suffix_dedup, training_order

from .conftest import key, rows_of
from .test_operators import brute_components, brute_removed, brute_templates


def test_audio_parser_never_raises():
    rng = random.Random(9)
    whole = mpeg_audio.store(bytes(range(256)) * 9)
    seeds = [whole, b"ID3\x04\0\0\0\0\0\x0bTIT2\0\0\0\0\0\0", bytes([0xFF, 0xFB, 0x10, 0xC0]) + b"Xing" * 5, bytes([0xFF, 0xF3, 0x10, 0]) + bytes(32) + b"VBRI"]
    seeds += [b"ID3\x03\0\0\0\0\0\x20TXXX\0\0\0\x05\0\0\x01", whole[:120] + b"TAG" + bytes(125)]
    for _ in range(100_000):
        raw = bytearray(rng.choice(seeds))
        at = rng.randrange(len(raw))
        raw = raw[at : at + rng.randrange(700)] if rng.random() < 0.5 else raw[: rng.randrange(min(1300, len(raw)) + 1)]
        for _ in range(rng.randrange(4)):
            if raw:
                raw[rng.randrange(len(raw))] = rng.choice((0, 255, 251, rng.randrange(256)))
        if rng.random() < 0.2:
            raw += rng.choice((b"VBRI", b"Xing\xff\xff\xff\xff", b"Info", b"ID3\x03"))
        p = mpeg_audio.parse(bytes(raw))
        assert p["samples"] >= 0 and all(0 <= o < len(raw) for o in p["offsets"])


def test_audio_tables():
    four = bytes([0xFF, 0xFB, 0x90, 0xC0])
    size = mpeg_audio.header(four)[0]
    plain = four.ljust(size, b"\0")
    xing = (four + bytes(17) + b"Xing" + struct.pack(">III", 7, 2, 3 * size) + bytes(range(100))).ljust(size, b"\0")
    p = mpeg_audio.parse(xing + 2 * plain)
    assert p["table"] == {"kind": "Xing", "frames": 2, "bytes": 3 * size, "seeks": list(range(100))} and len(p["offsets"]) == 2
    entries = [3, 4, 5]
    vbri = (four + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 3 * size, 2, len(entries), 10, 2, 1) + b"".join(e.to_bytes(2, "big") for e in entries)).ljust(size, b"\0")
    p = mpeg_audio.parse(vbri + 2 * plain)
    assert p["table"] == {"kind": "VBRI", "frames": 2, "bytes": 3 * size, "seeks": [0, 30, 70]}
    for kind in (b"Xing", b"VBRI"):  # frames of 52 bytes that end inside the table
        short = (bytes([0xFF, 0xF3, 0x14, 0xC0]) + bytes(9 if kind == b"Xing" else 32) + kind + b"\xff" * 4)[:48]
        assert mpeg_audio._table(short, 9)["kind"] == kind.decode()


def test_secrets_are_added_and_plain_words_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    letters = "0123456789abcdef"
    rows, want = [], {}
    for i in range(300):
        words = [word() for _ in range(60)]
        if i % 3 == 0:
            value = rng.choice([lambda: "".join(rng.choice(letters) for _ in range(40)), lambda: "AKIA" + "".join(rng.choice("ABCDEF0123") for _ in range(16)), lambda: "ghp_" + "".join(rng.choice("abcXYZ019") for _ in range(36))])()
            lead = "" if value[:2] in ("AK", "gh") else rng.choice(['token = "', "api_key: ", "DB_PASSWORD=", '"secret": "'])
            words[rng.randrange(60)] = lead + value + ('"' if lead.endswith('"') else "")
            text = " ".join(words)
            b = text.index(value)
            want[i] = f"secret:{b}:{b + len(value)}"
        elif i % 3 == 1:
            words[7] = rng.choice(["the token of the realm was lost", "password: unbelievablewordswithoutend", "key = value", "secretariat"])
        rows.append((i, text if i % 3 == 0 else " ".join(words)))
    got = {r.doc_id: r for r in personal.digests(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {(i, s) for i, r in got.items() for s in r.spans.split(",") if s.startswith("secret")}
    right = len(found & set(want.items()))
    assert right / len(want) >= 0.95 and right / len(found) >= 0.95


def test_spans_are_added_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("text rlike 'token = \"[0-9a-f]{40}\"'").select("doc_id")
    got = personal.digests(spark, docs)
    assert got.where("n_added > 0").count() > 0
    assert got.join(held, "doc_id").where("n_added = 0").count() == 0


def test_a_file_read_twice_keeps_its_numbers(spark, small):
    shards = training_order.write_shards(spark, small.union(small), length=64, per_shard=50)
    got = training_order.records(shards, 64)
    n = got.count()
    one = training_order.records(training_order.write_shards(spark, small, length=64, per_shard=50), 64)
    assert n == 2 * one.count() and got.select("slot").distinct().count() == n
    assert got.agg(F.max("shard")).first()[0] == (n - 1) // 50


def test_bins_of_poor_texts_stay_small(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "concat(id, ' 12345 ### 99 ', id) text", "'a' source")
    bins = mixing._sized(docs, mixing.SEED).groupBy("bin").count()
    assert bins.agg(F.max("count")).first()[0] < 100


def test_sample_is_bounded_over_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 200)
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, labels, seed: seen.append(len(texts)))
    docs = spark.range(8000).selectExpr("id doc_id", "concat('text ', id) text", "concat('l', id % 100) lang")
    language.learn(docs)
    assert 100 < seen[0] < 320


def test_spans_digest_holds_begins_and_ends(spark):
    text = "a ▁ é\n漢😀 the end."
    got = pieces.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = sp.encode(text, return_type="proto").pieces
    data = text.encode()
    model = pieces.PieceModel(pieces.default_model())
    assert [(p.begin, p.end) for p in own] == [(b, e) for _, _, b, e in model.encode_offsets(text)]
    starts = [len(text[: p.begin].encode()) if p.begin < len(data) else p.begin for p in own]
    assert len(starts) == got.n_tokens
    begins, ends = zip(*[(b, e) for _, _, b, e in model.encode_offsets(text)], strict=True)
    assert got.spans_crc32 == zlib.crc32(np.array(ends, "<i8").tobytes(), zlib.crc32(np.array(begins, "<i8").tobytes()))


def test_map_replaces_inside_longer_texts():
    model = pieces.PieceModel(pieces.default_model())

    class Map:
        starts = staticmethod(pieces.re.compile("[a]").search)

        def longest(self, data, at):
            return (b"X", 2) if data[at : at + 2] == b"ab" else None

    model.charmap = Map()
    assert model.normalise("éabé aé") == ("▁éXé▁aé", [0, 0, 2, 4, 6, 7, 8], [0, 2, 4, 6, 7, 8, 10])
    model.squeeze = True
    assert model.normalise("  ab   c  ") == ("▁X▁c", [2, 2, 4, 7], [2, 4, 5, 8])


def test_long_texts_and_shared_passages_in_tables(spark):
    """Whole tables with all long texts, by hashes of all windows; and marks against shared windows and strings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert max(len(t) for _, t in rows) > 20_000
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])

    def shared(span):
        base, sums = 1_000_003, np.zeros(len(data) + 1, np.uint64)
        power = np.cumprod(np.concatenate([[1], np.full(len(data), base)]).astype(np.uint64))
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        p = np.arange(len(data) - span + 1)
        p = p[offs[np.searchsorted(offs, p, side="right")] - p >= span]
        h = (sums[p + span] - sums[p]) * power[len(data) - p]
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        covered = np.zeros(len(data) + 1, np.int64)
        np.add.at(covered, p[count[inverse] > 1], 1)
        np.add.at(covered, p[count[inverse] > 1] + span, -1)
        inside = np.cumsum(covered[:-1]) > 0
        return [int(inside[a:b].sum()) for a, b in zip(offs[:-1], offs[1:], strict=True)]

    got = {r.doc_id: r for r in suffix_dedup.removed(spark, docs).collect()}
    assert [got[d].n_removed for d, _ in rows] == shared(400)
    some, least = shared(suffix_dedup.PASSAGE), shared(suffix_dedup.MARK)
    for (d, _), a, b in zip(rows, some, least, strict=True):
        assert not a or got[d].n_shared > 0
        assert b or got[d].n_shared == 0


def test_marks_of_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(4)
    data = np.frombuffer(bytes(rng.choice(list(b"abcdefgh"), 6000)), np.uint8)
    whole = suffix_dedup.marks(data, np.array([0, 6000]), 64, 16)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    cut = suffix_dedup.marks(data, np.array([0, 6000]), 64, 16)
    assert (whole[1] == cut[1]).all() and len(whole[1]) > 100


def near_copies(n, changed, seed=3):
    """n sets around one base that isn't among them, with so many words changed that most pairs aren't linked."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.choice(120, changed, replace=False):
            w[k] = f"v{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot", [50_000, 1])
def test_hot_shingles(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = near_copies(150, 2) + [(200 + i, t) for i, t in near_copies(60, 3, 5)]
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_a_large_group_that_no_leader_links(spark):
    rows = near_copies(5000, 3)
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    found = {r.doc_id: r.component_id for r in got.collect()}
    sets = [ngram_join.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for _, t in rows]
    # all intersections at once, over the shingles that two sets hold
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    tokens = tokens[count > 1]
    held = np.array([np.isin(tokens, s) for s in sets], np.float32)
    both, size = held @ held.T, np.array([len(s) for s in sets])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(100 * both >= 80 * (size[:, None] + size[None, :] - both), 1)), strict=True):
        a, b = sorted((find(int(i)), find(int(j))))
        root[b] = a
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), i)
    assert found == {i: least[find(i)] for i in range(len(rows))}
    assert len(set(found.values())) > 100


@pytest.mark.parametrize("hot", [1, 4, 30])
def test_hot_grams_are_sorted_in_halves(spark, hot):
    rng = np.random.default_rng(12)
    passage = "".join(rng.choice(list("abcdefgh "), 90))
    own = lambda n: "".join(rng.choice(list("ijklmnop "), n))
    rows = [(i, own(rng.integers(0, 60)) + passage[rng.integers(0, 20) : rng.integers(70, 91)] + own(rng.integers(0, 60))) for i in range(150)]
    got = suffix_dedup.removed(spark, spark.createDataFrame(rows, "doc_id long, text string"), 48, 8, hot)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows, 48)


def test_pipeline_from_end_to_end(spark, tmp_path):
    """run() against a chain of plain steps: the model row by row, the tree line by line, SQL, and the library."""
    import duckdb

    import corpus_pipeline
    from gridloom.llm.queries import ORACLES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.learn(docs)
    rows = [r for r in docs.collect() if not model.predict(*whole(r.text or ""))[2][0]]
    assert len(rows) > 150
    texts = without_recurring([(r.doc_id, r.text) for r in rows])
    assert texts != [r.text for r in rows]
    columns = "doc_id long, text string, source string"
    kept = [(r.doc_id, t, r.source) for r, t in zip(rows, texts, strict=True)]

    def sql(name, table):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(table, columns).coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
        return con.execute(ORACLES[name]).df().to_dict("records")

    first = {r["doc_id"] for r in sql("op2_ngram_join", kept) if r["doc_id"] == r["component_id"]}
    kept = [r for r in kept if r[0] in first]
    times = {r["doc_id"]: r["taken"] // r["size"] for r in sql("op7_mixing", kept) if r["size"]}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for doc, text, _ in kept:
        ids = sp.encode(text or "")
        want += [(doc, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest())] * times.get(doc, 0)
    got = corpus_pipeline.run(spark, folder)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


def whole(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def without_recurring(rows):
    """The texts without lines of templates that two texts hold, but for those of the text of the smallest id."""
    lines, leaves = {}, defaultdict(dict)
    for _, text in rows:
        f = line_templates.line_hashes(*whole(text or ""))
        lines[text or ""] = list(zip(f["number"].tolist(), f["hash"].tolist(), strict=True))
        for i, (h, leaf, n, at) in enumerate(zip(f["hash"].tolist(), f["leaf"].tolist(), f["count"].tolist(), f["first"].tolist(), strict=True)):
            if n > line_templates.LEADING:
                tokens = f["tokens"][at : at + n]
                leaves[leaf][h] = np.where(tokens == line_templates._FIELD, 0, tokens & np.uint64(0xFFFF)).astype("<u2")
    template = {}
    for own in leaves.values():
        template |= dict(brute_templates([(h, own[h]) for h in sorted(own)]))
    holders = defaultdict(dict)
    for doc, text in rows:
        for _, h in lines[text or ""]:
            t = template.get(h, h)
            holders[t][text or ""] = min(doc, holders[t].get(text or "", doc))
    out = []
    for _, text in rows:
        gone = {number for number, h in lines[text or ""] if len(own := holders[template.get(h, h)]) > 1 and min(own, key=lambda x: own[x]) != (text or "")}
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
    return out
