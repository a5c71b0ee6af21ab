"""Personal data by aggregated weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Base spans (e-mail, ip, card, phone) come from four patterns and always stay. Wider patterns propose further spans:
spelt-out e-mail addresses, IPv6 and bracketed addresses, other card groupings, national phone numbers, and secrets:
values that are assigned to a key, token or password, or have the prefix of a known kind of key. Of every
proposed span three labelers vote yes, no or nothing: its shape, a gazetteer (top-level domains, card issuers,
calling codes, address ranges, digest lengths and key prefixes) and the words before it. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability for a kind and so the chance that a span of a pattern is real; these chances
train the final span classifier, naive Bayes over votes, length and separators. Proposals that it accepts and that
meet no base span are added.

Matches are marked inside the text by a pattern replacement and cut out again, which gives code point offsets with
string functions alone. Patterns are written so that no run of characters is tried from each of its positions.
Everything is DataFrame expressions; only the classifier's weights, bounded by its features, reach the driver.

A null text counts as empty and has no spans. Repeated rows repeat; columns beyond doc_id and text aren't read; the
control characters U+0001 and U+0002 of a text count as characters like any other. Ties keep the first proposal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that may be added, in the order of the result.
EVERY = (*KINDS, "secret")
#: What makes a match worth looking for at all.
NEEDS = {"email": "instr(t, '@') > 0", "ip": "instr(t, '.') > 0", "card": "true", "phone": "instr(t, '+') > 0"}
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    # possessive runs that begin where a run begins or the last match ended: the leftmost match, without retrying
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){15,18}(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": f"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\\x20?[(\\[{{](?:at|AT)[)\\]}}]\\x20?[A-Za-z0-9-]++(?:\\x20?(?:\\.|[(\\[{{](?:dot|DOT)[)\\]}}])\\x20?[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}(?:\\[\\.\\][0-9]{1,3}){3}(?![0-9])",
    "card": "(?<![0-9])[0-9]{4}([./_])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[\\x20-]?[0-9]{6}[\\x20-]?[0-9]{5}(?![0-9])",
    "phone": "(?<![0-9+(.-])(?<!\\+[0-9]{1,3}[\\x20.-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[\\x20.-])[0-9]{3}[\\x20.-][0-9]{4}(?![0-9-])|(?<![0-9])00[1-9][0-9]?[0-9\\x20-]{7,13}[0-9](?![0-9])",
    # a name and a sign of assignment, or a look ahead to a known prefix; the value is what is marked
    "secret": "((?<![A-Za-z0-9_])(?:[A-Za-z0-9]{0,24}[_-])?(?i:api_?-?key|secret|token|passw(?:or)?d|passphrase|pwd|bearer|credential)s?[\"']?(?:\\s{0,3}[:=]\\s{0,3}|\\x20)[\"']?|(?<![A-Za-z0-9_-])(?=AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30}|sk-[A-Za-z0-9_-]{20}|xox[abp]-[0-9]))([A-Za-z0-9+/=_.-]{16,}+)",
}
WIDER_NEEDS = {"secret": "t rlike '(?i:key|secret|token|passw|passphrase|pwd|bearer|credential)|AKIA|gh[pousr]_|sk-|xox[abp]-'", "email": "t rlike '[(\\\\[{](at|AT)[)\\\\]}]'", "ip": "(instr(t, '[.]') > 0 or instr(t, ':') > 0)", "card": "true", "phone": "true"}
#: Common top-level domains, calling codes, words that announce a kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "us", "ca", "mx", "br")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
WORDS = {"email": "mail|contact|write|@", "ip": "\\\\bip\\\\b|host|server|address|adresse|client", "card": "card|visa|karte|carte|tarjeta|credit", "phone": "tel|phone|call|fax|mobil|anruf", "secret": "key|secret|token|passw|passphrase|pwd|bearer|credential"}
#: Rounds of expectation-maximisation, and characters before a span that the context labeler reads.
ROUNDS, BEFORE = 30, 32
_SPANS = "array<struct<b:int,e:int,s:string>>"


def _cut(marked: str) -> str:
    """SQL for the spans (begin, end, string) that U+0001 and U+0002 enclose in a marked text."""
    return f"""aggregate(slice(split({marked}, '\\u0001', -1), 2, length({marked})), struct(length(split({marked}, '\\u0001', 2)[0]) as pos, cast(array() as {_SPANS}) as found),
        (a, p) -> struct(a.pos + length(p) - 1 as pos, concat(a.found, array(struct(a.pos as b, a.pos + instr(p, '\\u0002') - 1 as e, substring(p, 1, instr(p, '\\u0002') - 1) as s))) as found), a -> a.found)"""


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(s: str) -> str:
    """SQL: the digits of s pass the check sum (every second digit from the right doubled)."""
    return f"""aggregate(transform(split(reverse({_digits(s)}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN cast(c as int) WHEN c < '5' THEN 2 * cast(c as int) ELSE 2 * cast(c as int) - 9 END), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"""


VALID = {
    "email": "true",
    "ip": "forall(split(x.s, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as double), 0) <= 255)",
    "card": _luhn("x.s"),
    "phone": f"length({_digits('x.s')}) between 8 and 15",
}
WIDER_VALID = {"secret": "true", "email": "true", "ip": "true", "card": _luhn("x.s"), "phone": f"length({_digits('x.s')}) between 8 and 15"}


def _found(kind: str, pattern: str, needs: str, valid: str):
    literal = pattern.replace("\\", "\\\\").replace("'", "\\'")
    mark = "$1\\u0001$2\\u0002" if kind == "secret" else "\\u0001$0\\u0002"
    marked = f"regexp_replace(t, '{literal}', '{mark}')"
    return F.expr(f"CASE WHEN {needs} THEN {marked} END").alias(f"m_{kind}"), f"coalesce(filter({_cut('m_' + kind)}, x -> {valid}), cast(array() as {_SPANS}))"


def _votes(kind: str) -> str:
    """SQL for a proposed span x (b, e, s, base): its votes (1, 0 or 2 for none) and features."""
    gazetteer = {
        "email": f"CASE WHEN lower(regexp_extract(x.s, '([A-Za-z0-9-]+)$', 1)) in {DOMAINS} THEN 1 ELSE 0 END",
        "ip": "CASE WHEN x.s like '%:%' THEN CASE WHEN lower(x.s) rlike '^(2|3|f[cdef])' THEN 1 ELSE 0 END WHEN cast(regexp_extract(x.s, '^([0-9]{1,3})', 1) as int) between 1 and 239 THEN 1 ELSE 0 END",
        "card": "CASE WHEN x.s rlike '^[3456]' THEN 1 ELSE 0 END",
        "phone": f"CASE WHEN x.s not rlike '^([+]|00)' THEN 2 WHEN regexp_extract(x.s, '^(?:[+]|00)([17]|[0-9]{{2}})', 1) in {CODES} THEN 1 ELSE 0 END",
        "secret": "CASE WHEN x.s rlike '^(AKIA|gh[pousr]_|sk-|xox[abp]-)' or (x.s rlike '^[0-9A-Fa-f]+$' and length(x.s) in (32, 40, 56, 64, 96, 128)) THEN 1 WHEN x.s not rlike '[0-9]' THEN 0 ELSE 2 END",
    }[kind]
    shape = {
        "email": "x.base", "ip": "x.base or x.s like '%:%:%'", "card": "x.base or x.s rlike '^3[47]'", "phone": "x.base or x.s rlike '^[(]'",
        "secret": "x.s rlike '[0-9]' and x.s rlike '[A-Za-z]' and length(x.s) >= 20",
    }[kind]
    otherwise = 0 if kind == "secret" else 2
    context = f"CASE WHEN lower(substring(t, greatest(1, x.b + 1 - {BEFORE}), least(x.b, {BEFORE}))) rlike '{WORDS[kind]}' THEN 1 ELSE 2 END"
    return f"struct('{kind}' as kind, x.b as b, x.e as e, x.base as base, CASE WHEN {shape} THEN 1 ELSE {otherwise} END as v1, {gazetteer} as v2, {context} as v3, least(9, length(x.s) div 4) as size, x.s rlike '[ ()./_-]' as cut)"


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, base array<struct<kind, b, e>>, proposed array<struct<...>>): all spans of each text with their votes."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "translate(coalesce(cast(text as string), ''), '\\u0001\\u0002', '\\u0003\\u0003') t")
    base = {k: _found(k, BASE[k], NEEDS[k], VALID[k]) for k in KINDS}
    rows = rows.select("doc_id", "t", *(m for m, _ in base.values())).select("doc_id", "t", *(F.expr(e).alias(f"b_{k}") for k, (_, e) in base.items()))
    wider = {k: _found(k, WIDER[k], WIDER_NEEDS[k], WIDER_VALID[k]) for k in EVERY}
    rows = rows.select("doc_id", "t", *(f"b_{k}" for k in KINDS), *(m for m, _ in wider.values()))
    rows = rows.withColumn("base", F.expr("concat(" + ", ".join(f"transform(b_{k}, x -> struct('{k}' as kind, x.b as b, x.e as e))" for k in KINDS) + ")"))
    new = {k: f"filter({e}, x -> not exists(base, y -> x.b < y.e and y.b < x.e))" for k, (_, e) in wider.items()}
    own = {k: f"transform(b_{k}, x -> struct(x.b, x.e, x.s, true as base))" if k in KINDS else "array()" for k in EVERY}
    rows = rows.select("doc_id", "t", "base", *(F.expr(f"concat({own[k]}, transform({new[k]}, x -> struct(x.b, x.e, x.s, false as base)))").alias(f"p_{k}") for k in EVERY))
    return rows.select("doc_id", "base", F.expr("concat(" + ", ".join(f"transform(p_{k}, x -> {_votes(k)})" for k in EVERY) + ")").alias("proposed"))


def _rounds() -> str:
    """SQL: the state (p, t1..t3, f1..f3) after all rounds over `pats`, an array of (v1, v2, v3, n)."""
    names = [f"{a}{j}" for a in "tf" for j in (1, 2, 3)]

    def chance(a: str) -> str:
        return " * ".join(f"CASE x.v{j} WHEN 1 THEN s.{a}{j} WHEN 0 THEN 1 - s.{a}{j} ELSE 1D END" for j in (1, 2, 3))

    q = f"(s.p * {chance('t')}) / (s.p * {chance('t')} + (1 - s.p) * {chance('f')})"
    weighed = f"transform(pats, x -> struct(x.v1 as v1, x.v2 as v2, x.v3 as v3, x.n as n, {q} as q))"
    zero = ", ".join(f"0D as {c}" for c in ["n", "y", *(f"{a}{b}{j}" for a in "yz" for b in "ua" for j in (1, 2, 3))])
    add = ["a.n + x.n as n", "a.y + x.n * x.q as y"]
    for a, w in (("y", "x.q"), ("z", "(1 - x.q)")):
        for j in (1, 2, 3):
            add.append(f"a.{a}u{j} + CASE WHEN x.v{j} = 1 THEN x.n * {w} ELSE 0D END as {a}u{j}")
            add.append(f"a.{a}a{j} + CASE WHEN x.v{j} <> 2 THEN x.n * {w} ELSE 0D END as {a}a{j}")
    order = [c.split(" as ")[1] for c in add]
    zero = ", ".join(f"0D as {c}" for c in order)
    done = ["(a.y + 1) / (a.n + 2) as p", *(f"(a.yu{j} + 4) / (a.ya{j} + 5) as t{j}" for j in (1, 2, 3)), *(f"(a.zu{j} + 1) / (a.za{j} + 5) as f{j}" for j in (1, 2, 3))]
    step = f"aggregate({weighed}, struct({zero}), (a, x) -> struct({', '.join(add)}), a -> struct({', '.join(done)}))"
    first = ", ".join(["0.7D as p", *(f"{'0.8' if c[0] == 't' else '0.2'}D as {c}" for c in names)])
    return f"aggregate(sequence(1, {ROUNDS}), struct({first}), (s, i) -> {step})"


def reliabilities(found: DataFrame) -> DataFrame:
    """(kind, pats, s): each kind's vote patterns (27 at most) and estimated state, from proposals()."""
    votes = found.select(F.explode("proposed").alias("x")).groupBy("x.kind", "x.v1", "x.v2", "x.v3").agg(F.count("*").cast("double").alias("n"))
    return votes.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v1", "v2", "v3", "n"))).alias("pats")).withColumn("s", F.expr(_rounds()))


def weights(found: DataFrame) -> dict[str, float]:
    """The classifier: log odds by 'kind|feature', trained on the chances that reliabilities() gives each vote pattern."""
    state = reliabilities(found)

    def chance(a: str) -> str:
        return " * ".join(f"CASE x.v{j} WHEN 1 THEN s.{a}{j} WHEN 0 THEN 1 - s.{a}{j} ELSE 1D END" for j in (1, 2, 3))

    chances = state.select("kind", "s", F.explode("pats").alias("x")).selectExpr("kind", "x.v1", "x.v2", "x.v3", f"(s.p * {chance('t')}) / (s.p * {chance('t')} + (1 - s.p) * {chance('f')}) q")
    # counts by everything a feature reads: at most 27 x 10 x 2 rows a kind
    counts = found.select(F.explode("proposed").alias("x")).groupBy("x.kind", "x.v1", "x.v2", "x.v3", "x.size", "x.cut").agg(F.count("*").alias("n"))
    rows = counts.join(chances, ["kind", "v1", "v2", "v3"]).withColumn("feature", F.explode(F.expr(_features(""))))
    sums = rows.groupBy("kind", "feature").agg(F.sum(F.expr("n * q")).alias("yes"), F.sum(F.expr("n * (1 - q)")).alias("no")).collect()
    total = {r.kind: (r.yes, r.no) for r in sums if r.feature == "all"}
    import math

    out = {}
    for r in sums:
        yes, no = total[r.kind]
        out[f"{r.kind}|{r.feature}"] = math.log((yes + 1) / (no + 1)) if r.feature == "all" else math.log((r.yes + 0.5) / (yes + 1)) - math.log((r.no + 0.5) / (no + 1))
    return out


def _features(x: str) -> str:
    return f"array('all', concat('shape', {x}v1), concat('list', {x}v2), concat('words', {x}v3), concat('size', {x}size), concat('cut', {x}cut))"


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of each row of docs: arrays of (kind, b, e), by kind and begin."""
    found = stored(spark, proposals(docs), "proposals")
    learnt = weights(found.where("size(proposed) > 0"))
    table = F.create_map(*(F.lit(v) for pair in sorted(learnt.items()) for v in pair)) if learnt else F.lit(None).cast("map<string,double>")
    good = f"filter(proposed, x -> not x.base and aggregate({_features('x.')}, 0D, (s, f) -> s + coalesce(w[concat(x.kind, '|', f)], 0D)) > 0)"
    return found.withColumn("w", table).select("doc_id", "base", F.expr(f"transform({good}, x -> struct(x.kind as kind, x.b as b, x.e as e))").alias("added"))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_added of each row."""
    name = "array_join(transform({}, x -> concat_ws(':', x.kind, x.b, x.e)), ',')"
    ranks = ", ".join(f"'{k}', {i}" for i, k in enumerate(EVERY))
    every = f"transform(array_sort(transform(concat(base, added), x -> struct(map({ranks})[x.kind] as r, x.b as b, x.e as e, x.kind as kind))), x -> struct(x.kind as kind, x.b as b, x.e as e))"
    return spans(spark, docs).select(
        "doc_id", *(F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(name.format("base")), 256).alias("base_sha256"), F.expr(name.format(every)).alias("spans"), F.expr("cast(size(added) as long)").alias("n_added"),
    )
