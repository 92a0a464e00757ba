"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests for other tokens.

The battery's p-value joins chi-squared uniformity, runs and serial-correlation tests over the alphabet of a token's
inferred encoding. Benjamini-Hochberg control among all tokens of the corpus of the same encoding and length band says
which tokens are not random. Of the others those are reported whose chi-squared statistic (as symbol collisions) is too
low for text, by a second p-value under the same control, in which the tokens that are not random count as 1. A short
token can't reach a small p-value, and long ones don't pay for the many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.shared import table, written

#: Patterns fixed by the contract: (kind, pattern, group that is measured, characters it needs at least).
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    ("assign", "(" + "|".join(_ANY_CASE(k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    # a run of 16 or more is all of a longest run: the same matches as one or more, then measured
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"([A-Za-z0-9+/_-]{20,})"
#: The alphabets of the encodings, in the order of their digits' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: The chance that two symbols of ordinary text agree: letters of prose, or decimal digits in what looks like hex.
COLLISION = {"hex": 0.1, "base32": 0.065, "base64": 0.065, "base64url": 0.065}
BANDS = (32, 64)
BINS_PER_DECADE, MOST_BINS = 10, 300


#: ``t``: the matched text, where it is tested further; to cut it out again would read the text from its start.
_SPANS = "array<struct<start:int,kind:int,end:int,t:string>>"
_NONE = f"cast(array() AS {_SPANS})"
#: Steps of an inner loop: what is found is put together block by block, so that no long array grows by one.
BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _walk(n: str, start: str, step: str) -> str:
    """SQL for the spans found in ``n`` steps, one at least: ``step`` makes (at, found) from ``c``, the same before, and
    the number ``i``."""
    inner = f"aggregate(sequence(b * {BLOCK}, least({n}, (b + 1) * {BLOCK}) - 1), named_struct('at', a.at, 'found', {_NONE}), (c, i) -> {step})"
    joined = _let("r", inner, "named_struct('at', r.at, 'found', concat(a.found, array(r.found)))")
    return f"aggregate(sequence(0, cast(({n} - 1) div {BLOCK} AS int)), named_struct('at', {start}, 'found', cast(array() AS array<{_SPANS}>)), (a, b) -> {joined}, a -> flatten(a.found))"


def _spans(text: str, kind: int, pattern: str, group: int, least: int, matched: str = "cast(null AS string)") -> str:
    """SQL for the array of (start, kind, end, t) of a pattern's matches, which never are empty.

    Matches and what lies between them alternate, so their lengths give the places (in code points). A text is
    split only if something matches.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    start = "c.at + length(g.gaps[i])"
    span = f"named_struct('start', {start}, 'kind', {kind}, 'end', {start} + length(m[i]), 't', {matched})"
    step = f"named_struct('at', {start} + length(m[i]), 'found', if(length(g.parts[i]) >= {least}, concat(c.found, array({span})), c.found))"
    body = _let("g", f"struct(split({text}, '{p}', -1) AS gaps, regexp_extract_all({text}, '{p}', {group}) AS parts)", _walk("size(m)", "0", step))
    return _let("m", f"regexp_extract_all({text}, '{p}', 0)", f"if(size(m) = 0, {_NONE}, {body})")


def _apart(spans: str, base: str) -> str:
    """SQL for those of ``spans``, which lie apart from each other, that overlap no span of ``base``.

    All go by start in one pass: a span must start after the ends of the base spans so far, and end before the next.
    """
    after = "coalesce(get(e, i + 1).kind < 3 AND get(e, i + 1).start < e[i].end, false)"
    step = f"if(e[i].kind < 3, named_struct('at', greatest(c.at, e[i].end), 'found', c.found), named_struct('at', c.at, 'found', if(c.at <= e[i].start AND NOT {after}, concat(c.found, array(e[i])), c.found)))"
    same = f"transform({base}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 't', cast(null AS string)))"
    return _let("all", spans, f"if(size(all) = 0 OR size({base}) = 0, all, {_let('e', f'sort_array(concat({same}, all))', _walk('size(e)', '0', step))})")


# A case is written as a lambda over bound values: t is the token, n its length, k its alphabet's size, v its digits.
def _normal_tail(z: str) -> str:
    """Two-sided tail of a normal score, by a logistic curve (error under 2e-4 near the middle)."""
    return f"(2 / (1 + exp(least(700, 1.5976 * abs({z}) + 0.070565 * pow(abs({z}), 3)))))"


_ENCODING = "CASE WHEN t RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN t RLIKE '^[A-Z2-7]+$' THEN 'base32' WHEN t RLIKE '[-_]' THEN 'base64url' ELSE 'base64' END"
_ALPHABET = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALPHABETS.items()) + " END"
_COLLISION = "CASE e " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in COLLISION.items()) + " END"


def _bin(p: str) -> str:
    """A p-value rounded up to a tenth of a decade."""
    return f"cast(least({MOST_BINS}, floor(-{BINS_PER_DECADE} * log10(greatest({p}, 1e-300D)))) AS int)"


def battery(token: str) -> str:
    """SQL for struct(encoding, band, p_random, p_text, random, text) of a token of 20 or more characters of TOKEN; the
    last two are the p-values' bins.

    A symbol outside the alphabet (a mix of - and /, say) counts as a digit of value -1. The time is in proportion to
    the length: u is the token as it is read, w its symbols, v their digits.
    """
    squares = "aggregate(array_distinct(w), 0D, (a, x) -> a + pow(n - length(replace(u, x, '')), 2))"
    chi = "((k * q / n - n) - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)"
    runs = _let("lo", "size(filter(v, x -> 2 * x < k))", _let("x", "2D * lo * (n - lo) / n + 1", _let("d", "(x - 1) * (x - 2) / (n - 1)", "if(d <= 0, 10D, (1D + size(filter(sequence(1, cast(n AS int) - 1), i -> (2 * v[i] < k) != (2 * v[i - 1] < k))) - x) / sqrt(d))")))
    serial = _let("mean", "aggregate(v, 0D, (a, y) -> a + y) / n", _let("c", "transform(v, x -> x - mean)", _let("d", "aggregate(c, 0D, (a, x) -> a + x * x)", "if(d <= 0, 10D, sqrt(n) * aggregate(sequence(1, cast(n AS int) - 1), 0D, (a, i) -> a + c[i] * c[i - 1]) / d + 1 / sqrt(n))")))
    p_random = f"least(1D, 3 * least({_normal_tail(chi)}, {_normal_tail('r')}, {_normal_tail('s')}))"
    # few collisions speak against text: one side of the tail
    z = f"(((q - n) / 2 - (n * (n - 1) / 2) * {_COLLISION}) / sqrt((n * (n - 1) / 2) * {_COLLISION} * (1 - {_COLLISION})))"
    p_text = f"if({z} < 0, {_normal_tail(z)} / 2, 1 - {_normal_tail(z)} / 2)"
    out = f"""named_struct('encoding', e, 'band', cast(CASE WHEN n < {BANDS[0]} THEN 0 WHEN n < {BANDS[1]} THEN 1 ELSE 2 END AS int), 'p_random', p.r, 'p_text', p.t,
        'random', {_bin('p.r')}, 'text', {_bin('p.t')})"""
    body = _let("p", f"named_struct('r', {p_random}, 't', {p_text})", out)
    body = _let("s", serial, body)
    body = _let("r", runs, body)
    body = _let("q", squares, body)
    body = _let("v", "transform(w, x -> instr(l, x) - 1)", body)
    body = _let("w", "split(u, '')", body)
    body = _let("u", "CASE e WHEN 'hex' THEN lower(t) WHEN 'base64url' THEN translate(t, '/', '+') ELSE t END", body)
    body = _let("k", "cast(length(l) AS double)", body)
    body = _let("l", _ALPHABET, body)
    body = _let("n", "cast(length(t) AS double)", body)
    body = _let("e", _ENCODING, body)
    return _let("t", token, body)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (spans of the fixed patterns, by start, then kind) and ``tokens`` (others, with their tests).

    Null text counts as empty. Tokens that overlap a base span are not tested: they are reported already. Columns of
    these names in ``docs`` are replaced. Time grows with a text's length, tokens and spans, not with their squares.
    """
    base = docs.drop(*[c for c in ("base", "tokens", "_t") if c != text])
    rows = base.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    # what a match can't do without is looked for first
    need = {"assign": "contains(_t, '=') OR contains(_t, ':')", "access": "contains(_t, 'AKIA')", "hex": "true"}
    found = [f"if({need[kind]}, {_spans('_t', i, pattern, group, least)}, {_NONE})" for i, (kind, pattern, group, least) in enumerate(BASE)]
    rows = rows.withColumn("base", F.expr(f"sort_array(transform(concat({', '.join(found)}), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))"))
    tokens = _apart(_spans("_t", 3, TOKEN, 1, 20, "m[i]"), "base")
    rows = rows.withColumn("tokens", F.expr(f"transform({tokens}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'test', {battery('x.t')}))"))
    return rows.drop("_t")


def _least_bin(counts: dict[int, int], total: int, rate: float) -> int | None:
    """Benjamini-Hochberg over binned p-values: the least bin that is a discovery."""
    above, best = 0, None
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if b > 0 and 10 ** (-b / BINS_PER_DECADE) <= rate * above / total:
            best = b
    return best


def discovery_bins(scanned: DataFrame, rate: float) -> list[tuple[str, int, int, int]]:
    """(encoding, band, bin from which a token is not random, bin from which one is not text): Benjamini-Hochberg at
    ``rate`` within each encoding and length band, first for the battery, then for the tokens that it leaves.

    p-values are rounded up to a tenth of a decade, so a count per bin is enough: a table has at most 4 encodings x
    3 bands x 301 bins, whatever the corpus. Tokens that are not random count as p = 1 in the second.
    """
    tests = scanned.select(F.explode("tokens.test").alias("t")).select("t.*")

    def counted(bin_):
        out: dict[tuple[str, int], dict[int, int]] = {}
        for r in tests.groupBy("encoding", "band", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
            out.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["n"]
        return out

    rejected = {}
    for key, own in counted(F.col("random")).items():
        least = _least_bin(own, sum(own.values()), rate)
        rejected[key] = MOST_BINS + 1 if least is None else least
    is_random = F.lit(False)
    for (encoding, band), least in sorted(rejected.items()):
        is_random |= (F.col("encoding") == encoding) & (F.col("band") == band) & (F.col("random") < least)
    found = []
    for key, own in counted(F.when(is_random, F.col("text")).otherwise(0)).items():
        least = _least_bin(own, sum(own.values()), rate)
        if least is not None:
            found.append((*key, rejected[key], least))
    return sorted(found)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text", rate: float = 0.01) -> DataFrame:
    """The rows of ``docs`` without the text, plus ``secrets``: array of (start, kind, end), base spans and discoveries.

    Repeated rows are scanned each and count each in the discovery rate; an empty table gives an empty result. The
    scan is written once to the shared folder (spans only), as the corpus-wide counts come before the verdicts.
    """
    scanned = written(scan(docs, text).drop(text), "secret-scan")
    least = discovery_bins(scanned, rate)
    found = "false" if not least else " OR ".join(f"(x.test.encoding = '{e}' AND x.test.band = {b} AND x.test.random < {r} AND x.test.text >= {n})" for e, b, r, n in least)
    extra = F.expr(f"transform(filter(tokens, x -> {found}), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))")
    return scanned.withColumn("secrets", F.sort_array(F.concat("base", extra))).drop("tokens")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
    )


def _sql(rate: float = 0.01) -> str:
    """The same spans in DuckDB SQL, with rows for spans and tokens."""
    patterns = [(k, p, g, n) for k, p, g, n in BASE] + [("random", TOKEN, 1, 20)]
    found = " UNION ALL ".join(
        "SELECT rid, t, {i} AS kind, {n} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS s FROM d".format(i=i, n=n, g=g, p=p.replace("'", "''"))
        for i, (_, p, g, n) in enumerate(patterns)
    )
    tail = lambda z: f"(2 / (1 + exp(least(700, 1.5976::DOUBLE * abs({z}) + 0.070565::DOUBLE * abs({z}) ** 3))))"
    alphabets = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALPHABETS.items()) + " END"
    chance = "CASE e " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in COLLISION.items()) + " END"
    binned = lambda p: f"CAST(least({MOST_BINS}, floor(-{BINS_PER_DECADE} * log10(greatest({p}, 1e-300::DOUBLE)))) AS INTEGER)"
    names = "['" + "', '".join(KINDS) + "'][kind + 1]"
    listed = f"string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
w AS (SELECT rid, t, kind, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(m[i]) AS n FROM i WHERE length(g[i]) >= least),
span AS (SELECT *, start + n AS stop FROM w),
base AS (SELECT * FROM span WHERE kind < 3),
tok AS (SELECT rid, start, stop, substr(t, start + 1, n) AS x, n::DOUBLE AS n FROM span WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = span.rid AND b.start < span.stop AND span.start < b.stop)),
enc AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(x, '[A-Z2-7]+') THEN 'base32' WHEN regexp_matches(x, '[-_]') THEN 'base64url' ELSE 'base64' END AS e FROM tok),
v AS (SELECT *, length({alphabets})::DOUBLE AS k, {chance} AS c, list_transform(range(1, CAST(n AS BIGINT) + 1), lambda j: strpos({alphabets}, substr(CASE WHEN e = 'hex' THEN lower(x) ELSE x END, j, 1)) - 1) AS v FROM enc),
q AS (SELECT *, list_sum(list_transform(list_distinct(v), lambda a: len(list_filter(v, lambda b: b = a)) ** 2))::DOUBLE AS q, len(list_filter(v, lambda a: 2 * a < k))::DOUBLE AS lo, list_sum(v)::DOUBLE / n AS mean FROM v),
r AS (SELECT *, 2 * lo * (n - lo) / n + 1 AS rx, 1 + len(list_filter(range(2, len(v) + 1), lambda j: (2 * v[j] < k) <> (2 * v[j - 1] < k))) AS runs,
  list_sum(list_transform(v, lambda a: (a - mean) ** 2)) AS ss, list_sum(list_transform(range(2, len(v) + 1), lambda j: (v[j] - mean) * (v[j - 1] - mean))) AS sc, n * (n - 1) / 2 AS pairs FROM q),
z AS (SELECT *, ((k * q / n - n) - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z1, CASE WHEN (rx - 1) * (rx - 2) / (n - 1) <= 0 THEN 10 ELSE (runs - rx) / sqrt((rx - 1) * (rx - 2) / (n - 1)) END AS z2,
  CASE WHEN ss <= 0 THEN 10 ELSE sqrt(n) * sc / ss + 1 / sqrt(n) END AS z3, ((q - n) / 2 - pairs * c) / sqrt(pairs * c * (1 - c)) AS z0 FROM r),
p AS (SELECT *, least(1, 3 * least({tail('z1')}, {tail('z2')}, {tail('z3')})) AS pr, CASE WHEN z0 < 0 THEN {tail('z0')} / 2 ELSE 1 - {tail('z0')} / 2 END AS pt, CASE WHEN n < {BANDS[0]} THEN 0 WHEN n < {BANDS[1]} THEN 1 ELSE 2 END AS band FROM z),
a AS (SELECT *, {binned('pr')} AS random, {binned('pt')} AS text FROM p),
r0 AS (SELECT *, count(*) OVER (PARTITION BY e, band) AS total, count(*) OVER (PARTITION BY e, band ORDER BY random DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM a),
r1 AS (SELECT e, band, min(random) FILTER (WHERE random > 0 AND 10 ** (-random / {BINS_PER_DECADE}.0::DOUBLE) <= {rate}::DOUBLE * above / total) AS rejected FROM r0 GROUP BY e, band),
b AS (SELECT a.*, CASE WHEN random >= rejected THEN 0 ELSE text END AS bin FROM a JOIN r1 USING (e, band)),
h AS (SELECT *, count(*) OVER (PARTITION BY e, band) AS total, count(*) OVER (PARTITION BY e, band ORDER BY bin DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM b),
cut AS (SELECT e, band, min(bin) AS least FROM h WHERE bin > 0 AND 10 ** (-bin / {BINS_PER_DECADE}.0::DOUBLE) <= {rate}::DOUBLE * above / total GROUP BY e, band),
every AS (SELECT rid, kind, start, stop FROM base UNION ALL SELECT rid, 3, start, stop FROM b JOIN cut USING (e, band) WHERE bin >= cut.least),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS x, {listed} AS spans FROM every GROUP BY rid),
o AS (SELECT rid, {listed} AS spans FROM base GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(o.spans, '')) AS base_sha256, coalesce(g.spans, '') AS spans
FROM d LEFT JOIN g USING (rid) LEFT JOIN o USING (rid)
"""


OP2_SQL = _sql()
