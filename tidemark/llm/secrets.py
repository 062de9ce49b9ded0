"""Operator 9: secrets in texts, by patterns and sliding-window entropy. DataFrame functions only.

Base kinds, leftmost and non-overlapping each: ``assign`` (a password-like name, a separator and
a value of 6 or more characters), ``access`` (``AKIA`` keys of 20 or more) and ``hex`` (runs of
24 or more). Positions come from splitting the text at the same pattern: a match starts where the
pieces and matches before it end. Spans are in code points, end exclusive.

Entropy kind. What base spans leave of a text is searched for candidate strings: runs of 20 or
more key-like characters, cut at placeholder words. Each is put into a character class (hex,
decimal, letters, alphanumeric, base64-like), and a window of 20 characters slides over it. The
counts of the window's characters are carried along; the entering and the leaving character change
one count each, and with it the sum of c*log2(c), which gives the Shannon entropy
log2(20) - sum/20. A candidate is reported from its first to its last window at or over the
threshold of its class, unless the allow-list suppresses it.

Work and memory of a row grow about as its text: positions are added up by blocks, gaps are cut
from blocks of the text, and no pattern repeats a group, which the JVM would match by recursion.

Defined cases: a null or empty text gives no spans and counts of zero; a text is scanned whole,
however long; repeated rows, ids included, are scanned each for itself; of spans that start
together the kind listed first comes first; an empty table gives an empty result; extra columns
are ignored by ``scan_secrets`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.names import free_prefix
from tidemark.session import table

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy in bits of a window of 20 characters, by character class.
THRESHOLDS = {"decimal": 3.2, "hex": 3.2, "letters": 4.05, "alphanumeric": 3.55, "base64": 3.8}
#: Candidates never reported by entropy: UUIDs, and checksums named as such. See ``_allowed`` for
#: paths and slugs of plain words, and one character or a short unit repeated.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-=_]",
)
#: Longest plain word of a path or slug, and longest unit whose repetition is no secret.
WORD, UNIT = 18, 4
#: Words of documentation that are cut out of a candidate.
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[-_]?(api|key|token)|xxxx)"
#: Matches of a block whose lengths are added up first; characters of a block of a text.
CHUNK, BLOCK = 128, 4096
#: Candidates' characters have the codes 43 (+) to 122 (z). The 80 counts are the letters of one
#: string, from NONE upwards: an aggregate carries a string cheaply, an array not.
FIRST, CODES, NONE = 43, 80, 97
#: c*log2(c) is kept as a multiple of 1e-12, so that sums are exact.
SCALE = 10**12
#: By how much c*log2(c) grows from c to c + 1, for c of 0 to WINDOW - 1.
GROWS = [round((c + 1) * math.log2(c + 1) * SCALE) - round(c * math.log2(c) * SCALE if c else 0) for c in range(WINDOW)]


def _q(text: str) -> str:
    """A pattern as a SQL literal."""
    return "r\"" + text + "\"" if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(values: str, fold: str = "a + x") -> str:
    """SQL: for each of ``values``, ``fold`` (from 0) over all before it.

    An aggregate copies all it carries at each step, so no array grows in one: blocks are folded
    first, then each value from the start of its block.
    """
    inner = lambda of: f"aggregate({of}, 0, (a, x) -> {fold})"
    blocks = f"transform(sequence(0, size(w) div {CHUNK}), k -> {inner(f'slice(w, k * {CHUNK} + 1, {CHUNK})')})"
    starts = f"transform(bs, (y, k) -> {inner('slice(bs, 1, k)')})"
    each = f"transform(w, (y, i) -> aggregate(slice(w, i div {CHUNK} * {CHUNK} + 1, i % {CHUNK}), bp[i div {CHUNK}], (a, x) -> {fold}))"
    return _let(values, "w", _let(blocks, "bs", _let(starts, "bp", each)))


MATCH = "struct<s:int,e:int,v:string>"


def _located(text: str, pattern: str, group: int, only_if: str = "true", offset: str = "0") -> str:
    """SQL: array of (s, e, v) of all leftmost non-overlapping matches; v is the group's value.

    ``only_if`` is a cheap condition without which the pattern cannot match.
    """
    p = _q(pattern)
    match = f"struct({offset} + b + length(gs[i]) AS s, {offset} + b + length(gs[i]) + length(ms[i]) AS e, vs[i] AS v)"
    found = f"transform({_before('zip_with(slice(gs, 1, size(ms)), ms, (x, y) -> length(x) + length(y))')}, (b, i) -> {match})"
    found = _let(f"split({text}, {p}, -1)", "gs", _let(f"regexp_extract_all({text}, {p}, 0)", "ms", _let(f"regexp_extract_all({text}, {p}, {group})", "vs", found)))
    return f"CASE WHEN {only_if} AND {text} RLIKE {p} THEN {found} ELSE CAST(array() AS array<{MATCH}>) END"


def _gaps(spans: str, text: str, blocks: str) -> str:
    """SQL: (s, v) of the stretches of a text between sorted spans, empty ones included.

    A stretch is cut from the blocks that it touches; overlapping spans have none between them.
    """
    here = f"array_join(slice(bl, f div {BLOCK} + 1, (y.s - 1) div {BLOCK} - f div {BLOCK} + 1), '')"
    cut = f"struct(f AS s, IF(y.s > f, substring({here}, f % {BLOCK} + 1, y.s - f), '') AS v)"
    between = f"filter(zip_with(sp, {_before('transform(sp, y -> y.e)', 'greatest(a, x)')}, (y, f) -> IF(y.s >= f, {cut}, NULL)), z -> z IS NOT NULL)"
    ends = f"concat(transform({spans}, y -> struct(y.s AS s, y.e AS e)), array(struct(length({text}) AS s, length({text}) AS e)))"
    return _let(blocks, "bl", _let(ends, "sp", between))


def _allowed(v: str) -> str:
    """SQL: whether the allow-list suppresses a candidate."""
    plain = f"(NOT {v} RLIKE '[0-9]|[A-Za-z]{{{WORD + 1}}}' AND {v} RLIKE '[A-Za-z]')"
    unit = " OR ".join(f"(length({v}) % {k} = 0 AND {v} = repeat(left({v}, {k}), length({v}) div {k}))" for k in range(1, UNIT + 1))
    return " OR ".join([*(f"{v} RLIKE {_q(a)}" for a in ALLOW), plain, unit])


def _entropy_windows(value: str) -> str:
    """SQL: (f, l), the 1-based ends of the first and last window at or over the threshold; 0 where none."""
    w = WINDOW
    most = " ".join(f"WHEN '{c}' THEN {math.floor(w * (math.log2(w) - t) * SCALE)}" for c, t in THRESHOLDS.items())
    kind = f"""CASE WHEN {value} RLIKE '^[0-9]+$' THEN 'decimal' WHEN {value} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex'
      WHEN {value} RLIKE '^[A-Za-z]+$' THEN 'letters' WHEN {value} RLIKE '^[A-Za-z0-9]+$' THEN 'alphanumeric' ELSE 'base64' END"""
    grows = f"array({', '.join(f'{g}L' for g in GROWS)})"
    count = lambda n, k: f"ascii(substring({n}, {k}, 1)) - {NONE}"
    put = lambda n, k, c: f"overlay({n} PLACING char({NONE} + {c}) FROM {k} FOR 1)"
    # the leaving character goes before the entering one comes
    gone = _let(f"cs[i - {w} - 1]", "o", _let(count("a.n", "o") + " - 1", "q", f"struct(a.s - {grows}[q] AS s, {put('a.n', 'o', 'q')} AS n)"))
    left = f"IF(i > {w}, {gone}, struct(a.s AS s, a.n AS n))"
    came = _let("cs[i - 1]", "k", _let(count("b.n", "k"), "q", f"struct(b.s + {grows}[q] AS s, {put('b.n', 'k', 'q + 1')} AS n)"))
    step = _let(left, "b", _let(came, "c", f"{_let(f'i >= {w} AND c.s <= most', 'hit', 'struct(c.s AS s, c.n AS n, IF(hit AND a.f = 0, i, a.f) AS f, IF(hit, i, a.l) AS l)')}"))
    fold = f"aggregate(sequence(1, size(cs)), struct(0L AS s, repeat(char({NONE}), {CODES}) AS n, 0 AS f, 0 AS l), (a, i) -> {step}, a -> struct(a.f AS f, a.l AS l))"
    return _let(f"transform(split({value}, ''), c -> ascii(c) - {FIRST - 1})", "cs", _let(f"CASE {kind} {most} END", "most", fold))


def find_spans(docs: DataFrame, p: str) -> DataFrame:
    """``docs`` plus ``{p}_base`` and ``{p}_entropy``, arrays of ``(s, n, e, kind, v)`` by start, and ``{p}_blocks``.

    ``docs`` needs a string column ``text``, and no column that starts with ``p``.
    """
    t = f"{p}_text"
    d = docs.withColumn(t, F.coalesce("text", F.lit("")))
    needs = {"assign": f"(contains({t}, ':') OR contains({t}, '='))", "access": f"contains({t}, 'AKIA')", "hex": "true"}
    for k in KINDS:
        d = d.withColumn(f"{p}_{k}", F.expr(_located(t, PATTERNS[k], 2 if k == "assign" else 0, needs[k])))
    d = d.withColumn(f"{p}_assign", F.expr(f"filter({p}_assign, x -> length(x.v) >= 6)"))
    tagged = ", ".join(f"transform({p}_{k}, x -> struct(x.s AS s, {n} AS n, x.e AS e, '{k}' AS kind, x.v AS v))" for n, k in enumerate(KINDS))
    d = d.withColumn(f"{p}_base", F.expr(f"array_sort(concat({tagged}))"))
    d = d.withColumn(f"{p}_blocks", F.expr(f"regexp_extract_all({t}, '(?s).{{1,{BLOCK}}}', 0)"))
    gaps = f"IF(size({p}_base) = 0, array(struct(0 AS s, {t} AS v)), {_gaps(f'{p}_base', t, f'{p}_blocks')})"
    d = d.withColumn(f"{p}_cand", F.expr(f"flatten(transform(filter({gaps}, g -> length(g.v) >= {WINDOW}), g -> {_located('g.v', CANDIDATE, 0, offset='g.s')}))"))
    word = _q(PLACEHOLDER)
    pieces = f"zip_with(gs, {_before(f"zip_with(gs, concat(regexp_extract_all(c.v, {word}, 0), array('')), (x, y) -> length(x) + length(y))")}, (x, b) -> struct(c.s + b AS s, x AS v))"
    pieces = f"IF(c.v RLIKE {word}, {_let(f'split(c.v, {word}, -1)', 'gs', pieces)}, array(struct(c.s AS s, c.v AS v)))"
    d = d.withColumn(f"{p}_rest", F.expr(f"filter(flatten(transform({p}_cand, c -> {pieces})), x -> length(x.v) >= {WINDOW} AND NOT ({_allowed('x.v')}))"))
    found = f"filter(transform({p}_rest, x -> struct(x.s AS s, x.v AS v, {_entropy_windows('x.v')} AS w)), x -> x.w.f > 0)"
    span = f"struct(x.s + x.w.f - {WINDOW} AS s, {len(KINDS)} AS n, x.s + x.w.l AS e, 'entropy' AS kind, substring(x.v, x.w.f - {WINDOW} + 1, x.w.l - x.w.f + {WINDOW}) AS v)"
    d = d.withColumn(f"{p}_entropy", F.expr(f"transform({found}, x -> {span})"))
    return d.drop(t, f"{p}_cand", f"{p}_rest", *[f"{p}_{k}" for k in KINDS])


def _written(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts, digest of the base spans, all spans."""
    d = find_spans(docs.select("doc_id", "text"), "_s")
    n = [F.expr(f"CAST(size(filter(_s_base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return d.select(
        "doc_id", *n, F.sha2(_written("_s_base"), 256).alias("base_sha256"), _written("array_sort(concat(_s_base, _s_entropy))").alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; other texts stay as they are.

    Overlapping spans become one mark. ``n_chars``, if there, counts the new text. A
    null text stays null; all columns and rows stay.
    """
    p = free_prefix(docs, "_s")
    d = find_spans(docs, p).withColumn(f"{p}_all", F.expr(f"array_sort(concat({p}_base, {p}_entropy))"))
    kept = f"transform({_gaps(f'{p}_all', 'text', f'{p}_blocks')}, y -> y.v)"
    d = d.withColumn("text", F.expr(f"CASE WHEN size({p}_all) > 0 THEN array_join({kept}, {_q(mark)}) ELSE text END"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.size(f"{p}_all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rows in DuckDB: entropy of each window from its own counts, all gaps by windows over spans."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"

    def located(source: str, pattern: str, group: int = 0, key: str = "doc_id, o") -> str:
        """(key, s, m, v) of all matches in t of ``source``, whose columns are ``key`` and t."""
        cut = f"SELECT {key}, regexp_split_to_array(t, {lit(pattern)}) pc, regexp_extract_all(t, {lit(pattern)}) ms, regexp_extract_all(t, {lit(pattern)}, {group}) vs FROM {source}"
        return f"SELECT {key}, length(array_to_string(pc[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) s, ms[i] m, vs[i] v FROM (SELECT *, unnest(range(1, len(ms) + 1)) i FROM ({cut}))"

    def gaps(spans: str, texts: str, key: str) -> str:
        """(key, s, t): what spans (key, s, e) leave of texts (key, t)."""
        ends = f"SELECT {key}, s, e FROM {spans} UNION ALL SELECT {key}, length(t), length(t) FROM {texts}"
        before = f"SELECT {key}, s, coalesce(max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) a FROM ({ends})"
        return f"SELECT {key}, a o, substr(t, (a + 1)::BIGINT, (s - a)::BIGINT) t FROM ({before}) JOIN {texts} USING ({key}) WHERE s - a >= {WINDOW}"

    base = " UNION ALL ".join(f"SELECT doc_id, {n} n, '{k}' kind, s, s + length(m) e, v FROM ({located('d', PATTERNS[k], 2 if k == 'assign' else 0, 'doc_id')})" for n, k in enumerate(KINDS))
    plain = f"(NOT regexp_matches(t, '[0-9]|[A-Za-z]{{{WORD + 1}}}') AND regexp_matches(t, '[A-Za-z]'))"
    unit = [f"(len(t) % {k} = 0 AND t = repeat(substr(t, 1, {k}), len(t) // {k}))" for k in range(1, UNIT + 1)]
    allowed = " OR ".join([*(f"regexp_matches(t, {lit(a)})" for a in ALLOW), plain, *unit])
    limit = " ".join(f"WHEN '{c}' THEN {t}" for c, t in THRESHOLDS.items())
    w = WINDOW
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), b0 AS ({base}), b AS (SELECT * FROM b0 WHERE n > 0 OR length(v) >= 6),
    g0 AS ({gaps('b', 'd', 'doc_id')}),
    c AS (SELECT doc_id, o + s k, m t FROM ({located('g0', CANDIDATE)})),
    p AS (SELECT doc_id, k, s, s + length(m) e FROM ({located('c', PLACEHOLDER, 0, 'doc_id, k')})),
    r0 AS (SELECT doc_id, k + o s, t FROM ({gaps('p', 'c', 'doc_id, k')})),
    r AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'decimal' WHEN regexp_full_match(t, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(t, '[A-Za-z]+') THEN 'letters'
          WHEN regexp_full_match(t, '[A-Za-z0-9]+') THEN 'alphanumeric' ELSE 'base64' END k FROM r0 WHERE NOT ({allowed})),
    g AS (SELECT doc_id, s, k, i, string_split(substr(t, i, {w}), '') ch FROM (SELECT *, unnest(range(1, length(t) - {w} + 2)) i FROM r)),
    h AS (SELECT doc_id, s, k, i, log2({w}) - list_sum(list_transform(list_distinct(ch), lambda a: len(list_filter(ch, lambda z: z = a)) * log2(len(list_filter(ch, lambda z: z = a))))) / {w} en FROM g),
    en AS (SELECT doc_id, {len(KINDS)} n, 'entropy' kind, (s + min(i) - 1)::BIGINT s2, (s + max(i) + {w} - 1)::BIGINT e FROM h WHERE en >= CASE k {limit} END GROUP BY doc_id, s),
    a AS (SELECT doc_id, n, kind, s::BIGINT s, e::BIGINT e FROM b UNION ALL SELECT * FROM en),
    z AS (SELECT doc_id, count(*) FILTER (n = 0) a0, count(*) FILTER (n = 1) a1, count(*) FILTER (n = 2) a2,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER (n < {len(KINDS)}) bs, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) sp FROM a GROUP BY 1)
    SELECT doc_id, coalesce(a0, 0)::BIGINT n_assign, coalesce(a1, 0)::BIGINT n_access, coalesce(a2, 0)::BIGINT n_hex, sha256(coalesce(bs, '')) base_sha256, coalesce(sp, '') spans
    FROM documents LEFT JOIN z USING (doc_id)"""


QUERIES = {"op9_secret_scan": op9_secret_scan}
SQL = {"op9_secret_scan": _sql()}
