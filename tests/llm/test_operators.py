"""Each operator against a brute-force version, on the odd rows, on none, and on the smallest table."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece

from gridloom.llm import language, line_templates, mixing, mpeg_audio, ngram_join, outliers, personal, pieces, suffix_dedup, training_order

from .conftest import key, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(params=["odd", "small", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def random_words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


# 1


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = training_order.permute(np.arange(n), n, 7)
        assert sorted(p) == list(range(n)) and (training_order.permute(p, n, 7, back=True) == np.arange(n)).all()
    assert (training_order.permute(np.arange(1000), 1000, 7) != training_order.permute(np.arange(1000), 1000, 8)).any()


def test_shards(spark, docs, tmp_path):
    shards = training_order.write_shards(spark, docs, length=64, per_shard=50)
    got = training_order.records(shards, 64).collect()
    encode, end = training_order.tokenizer(training_order.default_ranks())
    want = []
    for doc, text in pairs(docs):
        ids = [*encode(text or ""), end]
        want += [(doc, k // 64, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u2").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.part, r.n_tokens, r.crc32) for r in got), key=key) == sorted(want, key=key)
    assert sorted(r.slot for r in got) == list(range(len(want)))
    assert all(r.shard == r.slot // 50 and r.offset == r.slot % 50 * (16 + 128) for r in got)
    rest = training_order.records(shards, 64, from_slot=len(want) // 2)
    assert rest.count() == len(want) - len(want) // 2
    files = training_order.export_files(shards, str(tmp_path)).collect()
    assert sum(f.n_bytes for f in files) == len(want) * (16 + 128)
    again = training_order.records(training_order.write_shards(spark, docs, length=64, per_shard=50), 64)
    assert rows_of(again, "slot", "doc_id", "crc32") == sorted(((r.slot, r.doc_id, r.crc32) for r in got), key=key)


# 2


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if n and 100 * n >= 80 * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i), doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=key)


def test_components(spark, docs):
    got = ngram_join.jaccard_components(spark, docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(pairs(docs))


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 6)):
            w[k] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"u{i}_{k}" for k in range(30)] + base[:40])) for i in range(60)]  # a common passage
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_one_of_each(spark, odd):
    kept = ngram_join.one_of_each(spark, odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    comp = {d: c for d, _, c in brute_components(pairs(odd))}
    assert ids.pop(None) == 2 and set(ids.values()) == {1} and set(ids) == {d for d, c in comp.items() if d == c and d is not None}


# 3


def brute_removed(rows, span):
    seen = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        seen.update(raw[p : p + span] for p in range(len(raw) - span + 1))
    out = []
    for doc, t in rows:
        raw = (t or "").encode()
        inside = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            if seen[raw[p : p + span]] > 1:
                inside[p : p + span] = b"\1" * span
        kept = bytes(x for x, i in zip(raw, inside, strict=True) if not i)
        out.append((doc, len(raw), sum(inside), len(re.findall(b"\1+", bytes(inside))), sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_strings(spark, hot):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcd "), 300)) for _ in range(8)]
    rows = [(i, "".join(base[rng.integers(8)][rng.integers(0, 100) : rng.integers(120, 300)] if rng.random() < 0.8 else "".join(rng.choice(list("xyz "), 60)) for _ in range(rng.integers(0, 4)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a" * 500), (903, "ab" * 200), (904, rows[3][1]), (905, "é" * 100)]
    got = suffix_dedup.removed(spark, spark.createDataFrame(rows, "doc_id long, text string"), 64, 8, hot)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows, 64)


def test_repeated_strings_in_tables(spark, docs):
    rows = [(d, t) for d, t in pairs(docs) if t is None or len(t) < 20_000]
    some = docs.where("text is null or length(text) < 20000")
    got = suffix_dedup.removed(spark, some)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows, 400)


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = [bytes(rng.choice(list(b"ab"), rng.integers(0, 60))) if rng.random() < 0.5 else (b"ab" * 50)[rng.integers(0, 2) : rng.integers(30, 90)] for _ in range(rng.integers(1, 20))]
        order, lcp = suffix_dedup.deep_shallow(s, 0, int(rng.integers(0, 40)))
        assert [s[i] for i in order] == sorted(s) and all(lcp[k] == suffix_dedup.common(s[order[k - 1]], s[order[k]]) for k in range(1, len(s)))


def test_long_text_in_segments(monkeypatch):
    rng = np.random.default_rng(4)
    data = np.frombuffer(bytes(rng.choice(list(b"abc"), 6000)), np.uint8)
    whole = suffix_dedup.runs(data, np.array([0, 6000]), 64, 8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    cut = suffix_dedup.runs(data, np.array([0, 6000]), 64, 8)
    spread = lambda r: {(p, int(a)) for lo, hi, a in zip(r["lo"], r["hi"], r["anchor"], strict=True) for p in range(lo, hi + 1)}
    assert spread(whole) == spread(cut)


# 4


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predicted(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_edges(spark, docs):
    got = language.predicted(spark, docs).collect()
    texts = Counter(d for d, _ in pairs(docs))
    assert Counter(r.doc_id for r in got) == texts
    letterless = {d for d, t in pairs(docs) if not any(c.isalpha() for c in t or "")}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and texts[r.doc_id] == 1 and r.doc_id in letterless:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert language.accepted(spark, docs).columns == docs.columns


@pytest.mark.parametrize("foreign", ["es", "de"])
def test_foreign_and_shuffled_texts_are_rejected(spark, foreign):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null")
    model = language.learn(docs.where(f"lang <> '{foreign}'"))
    assert len(model.langs) == 3 and foreign not in model.langs
    got = language.predicted(spark, docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    other = [r.rejected for r in got if r.lang == foreign]
    own = [r.rejected for r in got if r.lang != foreign and r.held_out]
    assert len(other) > 50 and sum(other) >= 0.97 * len(other)
    assert sum(own) <= 0.01 * len(own)
    rng = random.Random(3)
    mixed = [(i, "".join(rng.sample(r.text, len(r.text)))) for i, r in enumerate(docs.where("length(text) between 200 and 3000").limit(100).collect())]
    mixed.append((100, "xqzv kjwp wqxz zzkq vbnq pxkw jqzx wvkq xzqj kqwv"))
    mixed = spark.createDataFrame(mixed, "doc_id long, text string")
    assert language.predicted(spark, mixed, model).where("not rejected").count() <= 1


def test_language_of_long_texts_only_is_learned(spark):
    rows = [(i, " ".join(random_words(80, i)), "short") for i in range(30)]
    rows += [(100 + i, " ".join(random_words(5000, i)).upper().replace("A", "Z"), "long") for i in range(12)]
    assert all(len(t) > language.SAMPLE_CHARS for _, t, lang in rows if lang == "long")
    assert language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["long", "short"]


# 5


def brute_lines(rows, least):
    mask = lambda line: tuple("*" if re.search("[0-9]", w) else w for w in words(line))
    texts, first = defaultdict(set), {}
    for doc, text in rows:
        for line in (text or "").split("\n") if text is not None else ():
            if m := mask(line):
                texts[m].add(text)
                rank = (doc is None, doc or 0)
                if m not in first or rank < first[m][0]:
                    first[m] = (rank, text)
    gone = {m for m, t in texts.items() if len(t) >= least}
    out = []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        keep = [x for x in lines if mask(x) not in gone or first[mask(x)][1] == text]
        out.append((doc, len(lines), len(lines) - len(keep), sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("shared", [1000, 0])
def test_lines(spark, docs, shared):
    got = line_templates.digests(spark, docs, 3, shared)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(pairs(docs), 3)
    assert line_templates.deduped(spark, docs, 3).columns == docs.columns


def test_templates_generalise(spark):
    names = ["ann", "bob", "cat", "dan", "eve", "fay"]
    rows = [(i, f"header {i}\nuser logged in from host alpha as {n} with role admin today\nown words {n} stand here") for i, n in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in line_templates.digests(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {0: 0, **dict.fromkeys(range(1, 6), 2)}  # "header N" and the log line; "own words" lines differ in a quarter of few words


def test_lines_of_two_texts_go(spark):
    import corpus_pipeline

    passage = " ".join(f"{w}ly" for w in random_words(60, 3))
    rows = [(i, f"own {' '.join(random_words(12, 10 + i))}\n{passage if i < 2 else 'none'}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {0: 0, 1: 1, 2: 0, 3: 1}  # the passage and "none" stay in the first text that has them
    assert {r.doc_id: r.n_dropped for r in line_templates.digests(spark, docs).collect()} == want
    texts = {r.doc_id: r.text for r in corpus_pipeline.without_recurring_lines(spark, docs, "").collect()}
    assert texts == {i: t if not want[i] else t.split("\n")[0] for i, t in rows}


def test_templates_with_a_field_in_each_quarter(spark):
    fixed, own = random_words(24, 5), random_words(400, 6)
    lines = []
    for i in range(100):
        line = list(fixed)
        for k, at in enumerate((4, 8, 14, 20)):
            line[at] = own[4 * i + k]
        lines.append(" ".join(line))
    rows = [(i, f"first {own[i]} of mine\n{x}") for i, x in enumerate(lines)]
    got = {r.doc_id: r.n_dropped for r in line_templates.digests(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()}
    assert got == {0: 0, **dict.fromkeys(range(1, 100), 1)}


def brute_templates(lines):
    models, out = [], []
    for name, tokens in lines:
        shares = [np.count_nonzero((m == tokens) | (m == 0)) / len(tokens) for _, m in models]
        best = max(range(len(models)), key=lambda k: (shares[k], -k), default=-1)
        if best < 0 or shares[best] < line_templates.ALIKE:
            best = len(models)
            models.append((name, tokens.copy()))
        models[best][1][models[best][1] != tokens] = 0
        out.append((name, models[best][0]))
    return out


@pytest.mark.parametrize("few", [0, 3, 64])
def test_each_line_meets_all_templates_of_its_leaf(monkeypatch, few):
    monkeypatch.setattr(line_templates, "FEW", few)
    rng = np.random.default_rng(1)
    for n in (4, 5, 6, 7, 10, 16, 24, 40):
        for values in (3, 12):
            base, lines = rng.integers(0, values, (8, n)), []
            for i in range(150):
                tokens = base[rng.integers(8)].copy()
                at = rng.integers(3, n, rng.integers(0, n // 2 + 1))
                tokens[at] = rng.integers(0, values, len(at))
                tokens[:3] = 1, 2, 0
                lines.append((i, tokens.astype("<u2")))
            assert line_templates.templates_of(lines) == brute_templates(lines)


# 6


def brute_statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics(spark, docs):
    got = outliers.judged(spark, docs)
    want = sorted(((d, *brute_statistics(t)) for d, t in pairs(docs)), key=key)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_outliers_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in outliers.judged(spark, docs).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [r for r in rows if labels[r.doc_id]], [r for r in rows if not labels[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


# 7


def water_level(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix(spark, docs):
    source = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in source:
        sizes[r.source] += len(words(r.text))
    want = water_level(sizes) if sizes else {}
    got = mixing.mixed(spark, docs).collect()
    assert len(got) == len(source)
    taken = defaultdict(int)
    for r in got:
        n = len(words(r.text))
        assert r["size"] == n and 0 <= r.taken <= 3 * n and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for s, target in want.items():
        largest = max((len(words(r.text)) for r in source if r.source == s), default=0)
        assert abs(taken[s] - target) <= largest
    again = mixing.mixed(spark, docs.repartition(5))
    assert rows_of(again, "doc_id", "source", "size", "taken") == sorted(((r.doc_id, r.source, r["size"], r.taken) for r in got), key=key)
    drawn = mixing.drawn(spark, docs)
    assert drawn.columns == docs.columns
    assert sum(len(words(r.text)) for r in drawn.select("text").collect()) == sum(taken.values())


# 8


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub(r"\D", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def check_spans(spark, docs, rows):
    got = personal.digests(spark, docs)
    want = []
    for doc, text in rows:
        own = base_spans(text or "")
        want.append((doc, *(sum(s[0] == k for s in own) for k in personal.KINDS), sha256(",".join(f"{k}:{b}:{e}" for k, b, e in own).encode()).hexdigest()))
    assert rows_of(got, "doc_id", *(f"n_{k}" for k in personal.KINDS), "base_sha256") == sorted(want, key=key)
    return got


def test_base_spans(spark, docs):
    check_spans(spark, docs, pairs(docs))


def test_spans_of_pieces(spark):
    rng = np.random.default_rng(8)
    parts = ["a", ".", "@", "-", "_", "1", "22", "255", "256", "+", "+1 ", "(5", "55) ", " ", "é", "😀", "\x01", "\x02", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "x@y.z", "\n"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 30)))) for i in range(800)]
    got = check_spans(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    for r in got.collect():
        assert set(filter(None, ",".join(f"{k}:{b}:{e}" for k, b, e in base_spans(rows[r.doc_id][1])).split(","))) <= set(r.spans.split(","))


def test_labelers_add_spans(spark):
    rows = [(i, f"please call tel (555) 123-4{i:03d} or mail to joe{i} (at) example (dot) com or j{i}@example.com or +49 30 1234{i:04d}") for i in range(30)]
    rows += [(100, "section 123 456 7890 of the list")]
    got = {r.doc_id: r.spans for r in personal.digests(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(30):
        text = rows[i][1]
        b = text.index("(555)")
        assert f"phone:{b}:{b + 14}" in got[i] and got[i].count("email:") == 2
    long_run = "a" * 200_000 + " " + "1" * 200_000 + " +" + "1-" * 100_000
    assert personal.digests(spark, spark.createDataFrame([(1, long_run)], "doc_id long, text string")).first().spans == ""


# 9


def test_stored_texts(spark, docs):
    for r in mpeg_audio.stored_texts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id == 5:
            continue  # an id of two texts
        raw = mpeg_audio.padded((r.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((r.text or "").encode()), len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    assert mpeg_audio.stored_texts(docs).count() == docs.count()


def test_described(spark):
    media = spark.createDataFrame([(1, bytearray(mpeg_audio.store(bytes(1152)))), (2, None), (3, bytearray(b"junk"))], "id int, audio binary")
    got = {r.id: r.about for r in mpeg_audio.described(media).collect()}
    assert got[1].frames == 2 and got[1].seconds == 2304 / 44100 and got[1].good_checksums == 2 and got[2].frames == 0 and got[3].skipped == 4


# 10


def test_pieces(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for doc, text in pairs(docs):
        ids = sp.encode(text or "")
        want.append((doc, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows_of(pieces.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


def test_offsets_and_own_merges():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    model = pieces.PieceModel(pieces.default_model())
    run = pieces.encoded(model)
    rng = np.random.default_rng(10)
    alphabet = [*"ab the  \n\t▁éß漢😀0123.,", "\x00", "  ", "　", "�"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 70)))
        ids = sp.encode(text)
        own = model.encode_offsets(text)
        assert [t[0] for t in own] == ids and model.decode(ids) == sp.decode(ids)
        assert [(t[2], t[3]) for t in own] == [(p.begin, p.end) for p in sp.encode(text, return_type="proto").pieces]
        a, n, back, ends = next(run([text]))
        assert (a, n, back) == (",".join(map(str, ids)), len(ids), sp.decode(ids)) and np.frombuffer(ends, np.int64).tolist() == [t[3] for t in own]
    long = "".join(rng.choice(list("abcdef"), 3000))
    assert model.encode(long) == sp.encode(long)


def test_character_map():
    """A hand-made double array that maps 'ab' to 'X' and 'a' to 'yy'."""
    import struct

    size = 1024
    units = [0] * size
    offset = lambda node, to: (node ^ to) << 10
    # the root's children lie at 256 ^ byte, those of "a" at 512 ^ byte; leaves hold offsets into the texts
    root, a, ab = 0, 256 ^ ord("a"), 512 ^ ord("b")
    units[root] = offset(root, 256)
    units[a] = offset(a, 512) | 1 << 8 | ord("a")
    units[512] = 1 << 31 | 2
    units[ab] = offset(ab, 768) | 1 << 8 | ord("b")
    units[768] = 1 << 31 | 0
    m = pieces.CharMap(struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *units) + b"X\0yy\0")
    assert m.longest(b"abc", 0) == (b"X", 2) and m.longest(b"ac", 0) == (b"yy", 1) and m.longest(b"c", 0) is None
    model = pieces.PieceModel(pieces.default_model())
    model.charmap = m
    norm, begin, end = model.normalise("cabac")
    assert norm == "▁cXyyc" and begin == [0, 0, 1, 3, 3, 4] and end == [0, 1, 3, 4, 4, 5]


# queries, pipeline


def test_queries_have_their_columns(spark):
    from gridloom.llm.queries import QUERIES

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "pieces"]
    for docs in (odd, empty):
        plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
        kept = plain
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, "")
            assert kept.columns == plain.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() <= docs.count() * 3


def test_pipeline_on_a_table(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, folder)
    assert known.count() >= docs.count() - 1
    assert corpus_pipeline.run(spark, folder).count() > 0
