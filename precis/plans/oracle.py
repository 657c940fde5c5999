"""DuckDB SQL for every registered query that SQL can express.

The SQL is written independently of the Spark code (relational joins and
``GROUP BY`` where the Spark side uses row-local higher-order functions,
a recursive CTE for the LCS table); only the fixed values (clean-up rules,
stop-word lists, constants) are shared. Doubles are rounded to 9 places on
both sides.
"""

from __future__ import annotations

import math

from precis.constants import (
    CLEANUP_RULES,
    END_CHARS,
    HIGHLIGHT_MARKER,
    PUNCTUATION,
    PY_SPACE_CLASS,
)
from precis.functions.tokens import ENTITIES_13A, RULES_13A, stopwords
from precis.plans import params as P


NL = "\n"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def chain(x: str, rules) -> str:
    for pat, rep in rules:
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    return x


def CLEAN(x: str) -> str:
    return chain(f"lower({x})", CLEANUP_RULES)


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + PY_SPACE_CLASS + '+|' + PY_SPACE_CLASS + '+$')}, '', 'g')"


def FIX(x: str) -> str:
    ends = ", ".join(q(c) for c in END_CHARS)
    return f"(CASE WHEN {x} = '' THEN {x} WHEN right({x}, 1) IN ({ends}) THEN {x} ELSE {x} || ' .' END)"


def SQUEEZE(x: str) -> str:
    return f"regexp_replace({x}, ' +', ' ', 'g')"


def NL2SP(x: str) -> str:
    return f"replace({x}, chr(10), ' ')"


# Page text by the rules of markup: one alternation, tried from left to right.
_ATTR = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
MARKUP = "|".join(
    [r"<!--.*?(?:-->|\z)"]
    + [rf"<{tag}\b{_ATTR}>.*?(?:</{tag}\b[^>]*>|\z)" for tag in ("script", "style", "template")]
    + [r"<[!?][^>]*>", rf"</?[a-z]{_ATTR}>"])
# References that occur in the pages (others would need the whole HTML table).
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
              ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def HTML(x: str) -> str:
    out = f"regexp_replace({x}, {q(MARKUP)}, '', 'gis')"
    for name, char in REFERENCES:
        out = f"regexp_replace({out}, '&amp;?', '&', 'g')" if char == "&" else f"replace({out}, {q(name)}, {q(char)})"
    return f"replace({out}, chr(160), ' ')"


def SWLIST(lang: str) -> str:
    return "[" + ", ".join(q(w) for w in stopwords(lang)) + "]"


def DROP_SW(t: str, lang: str, var: str = "sw") -> str:
    return f"list_filter({t}, lambda {var}: NOT list_contains({SWLIST(lang)}, {var}))"


def DROP_SW_BY_LANG(t: str, lang_col: str) -> str:
    parts = " ".join(f"WHEN {q(code)} THEN {DROP_SW(t, code)}" for code in ("en", "fr", "de", "es", "ru"))
    return f"(CASE {lang_col} {parts} ELSE {t} END)"


def DROP_PUNCT(t: str, var: str = "pt") -> str:
    return f"list_filter({t}, lambda {var}: {var} <> ' ' AND NOT contains({q(PUNCTUATION)}, {STRIP(var)}))"


def JOIN(t: str, sep: str = " ") -> str:
    return f"array_to_string({t}, {q(sep)})"


def SPLIT(x: str, sep: str = " ") -> str:
    return f"string_split({x}, {q(sep)})"


def TOK(x: str, var: str = "tk") -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda {var}: {var} <> '')"


def WTOK(x: str, var: str = "wt") -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda {var}: {var} <> '')"


def NGRAMS(t: str, n: str, var: str = "gi") -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda {var}: array_to_string({t}[{var}:{var} + {n} - 1], ' '))"


def R9(x: str) -> str:
    return f"round({x}, 9)"


def FMEAS(p: str, r: str) -> str:
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


PAIRS = """pairs AS (
  SELECT u.conv_id * 4294967296 + u.turn AS id, u.text AS target, a.text AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

STORIES = f"""stories AS (
  SELECT doc_id AS id,
         text || chr(10) || chr(10) || '{HIGHLIGHT_MARKER}' || chr(10) || chr(10) || split_part(text, chr(10), 1)
         || chr(10) || chr(10) || '{HIGHLIGHT_MARKER}' || chr(10) || 'source ' || source || ' in ' || lang || '!' || chr(10)
         AS content
  FROM documents)"""


def story_pairs_ctes() -> str:
    """CTEs ending in ``spairs(id, article, summary)``: documents rendered as
    stories, parsed and cleaned line by line."""
    lines = _story_parse("content")
    return f"""{STORIES},
parsed AS (SELECT id, {lines} AS lines FROM stories),
marked AS (SELECT id, lines, list_position(list_transform(lines, lambda lm: starts_with(lm, '{HIGHLIGHT_MARKER}')), true) AS first FROM parsed),
parts AS (SELECT id,
                 CASE WHEN first IS NULL THEN lines ELSE list_slice(lines, 1, first - 1) END AS body,
                 CASE WHEN first IS NULL THEN []::VARCHAR[] ELSE list_filter(list_slice(lines, first + 1, len(lines)), lambda lh: NOT starts_with(lh, '{HIGHLIGHT_MARKER}')) END AS hl
          FROM marked),
spairs AS (SELECT id,
       {SQUEEZE(f"replace({SQUEEZE(JOIN(DROP_PUNCT(DROP_SW(SPLIT(JOIN('body')), 'en'))))}, chr(10), '')")} AS article,
       {SQUEEZE(f"replace({JOIN(chr_join_wrap('hl'))}, chr(10), '')")} AS summary
FROM parts)"""


def rouge_n_ctes(ns) -> str:
    nlist = "[" + ", ".join(str(n) for n in ns) + "]"
    return f"""{PAIRS},
tok AS (SELECT id, {TOK('target')} AS t, {TOK('prediction')} AS p FROM pairs),
ns AS (SELECT unnest({nlist}) AS n),
g AS (SELECT id, n, {NGRAMS('t', 'n')} AS tg, {NGRAMS('p', 'n')} AS pg FROM tok, ns),
ct AS (SELECT id, n, x AS gram, count(*) AS c FROM (SELECT id, n, unnest(tg) AS x FROM g) GROUP BY id, n, x),
cp AS (SELECT id, n, x AS gram, count(*) AS c FROM (SELECT id, n, unnest(pg) AS x FROM g) GROUP BY id, n, x),
hits AS (SELECT ct.id, ct.n, sum(least(ct.c, cp.c)) AS h FROM ct JOIN cp ON ct.id = cp.id AND ct.n = cp.n AND ct.gram = cp.gram GROUP BY ct.id, ct.n),
pr AS (SELECT g.id, 'rouge' || g.n AS score_type,
              CAST(coalesce(hits.h, 0) AS DOUBLE) / greatest(len(g.pg), 1) AS precision,
              CAST(coalesce(hits.h, 0) AS DOUBLE) / greatest(len(g.tg), 1) AS recall
       FROM g LEFT JOIN hits ON g.id = hits.id AND g.n = hits.n),
scores AS (SELECT id, score_type, precision, recall, {FMEAS('precision', 'recall')} AS fmeasure FROM pr)"""


def rouge_l_ctes(with_tokens: bool = True) -> str:
    head = f"""{PAIRS},
tok AS (SELECT id, {TOK('target')} AS t, {TOK('prediction')} AS p FROM pairs),
""" if with_tokens else ""
    return head + f"""dp(id, i, r) AS (
  SELECT id, 0, list_transform(range(0, len(p) + 1), lambda z: 0) FROM tok WHERE len(t) > 0 AND len(p) > 0
  UNION ALL
  SELECT dp.id, dp.i + 1,
         list_reduce(
           list_transform(range(1, len(tok.p) + 1),
             lambda j: greatest(dp.r[j + 1], CASE WHEN tok.p[j] = tok.t[dp.i + 1] THEN dp.r[j] + 1 ELSE 0 END)),
           lambda acc, v: list_append(acc, greatest(acc[len(acc)], v)), [0])
  FROM dp JOIN tok ON dp.id = tok.id
  WHERE dp.i < len(tok.t)),
lcs AS (SELECT dp.id, dp.r[len(dp.r)] AS l FROM dp JOIN tok ON dp.id = tok.id WHERE dp.i = len(tok.t)),
lpr AS (SELECT tok.id, 'rougeL' AS score_type,
               CASE WHEN len(t) = 0 OR len(p) = 0 THEN 0.0 ELSE CAST(lcs.l AS DOUBLE) / len(p) END AS precision,
               CASE WHEN len(t) = 0 OR len(p) = 0 THEN 0.0 ELSE CAST(lcs.l AS DOUBLE) / len(t) END AS recall
        FROM tok LEFT JOIN lcs ON tok.id = lcs.id),
lscores AS (SELECT id, score_type, precision, recall, {FMEAS('precision', 'recall')} AS fmeasure FROM lpr)"""


def rouge_lsum_ctes() -> str:
    """Summary-level LCS: every (target sentence, prediction sentence) pair of a
    row gets its LCS table (recursive CTE over table rows); a second recursive
    CTE walks the backtrack (match: diagonal; else left only if strictly
    larger, else up); indices are unioned per target sentence and the hits
    clipped by the token counts of both sides."""
    sents = lambda c: f"list_filter(string_split({c}, chr(10)), lambda se: se <> '')"
    return f"""{PAIRS},
tsent AS (SELECT id, generate_subscripts(ss, 1) AS ti, unnest(ss) AS s FROM (SELECT id, {sents('target')} AS ss FROM pairs)),
psent AS (SELECT id, generate_subscripts(ss, 1) AS cj, unnest(ss) AS s FROM (SELECT id, {sents('prediction')} AS ss FROM pairs)),
ts AS (SELECT id, ti, {TOK('s')} AS t FROM tsent),
ps AS (SELECT id, cj, {TOK('s')} AS p FROM psent),
sp AS (SELECT ts.id, ts.ti, ps.cj, ts.t, ps.p FROM ts JOIN ps ON ts.id = ps.id),
sdp(id, ti, cj, i, r) AS (
  SELECT id, ti, cj, 0, list_transform(range(0, len(p) + 1), lambda z: 0) FROM sp
  UNION ALL
  SELECT sdp.id, sdp.ti, sdp.cj, sdp.i + 1,
         list_reduce(
           list_transform(range(1, len(sp.p) + 1),
             lambda j: greatest(sdp.r[j + 1], CASE WHEN sp.p[j] = sp.t[sdp.i + 1] THEN sdp.r[j] + 1 ELSE 0 END)),
           lambda acc, v: list_append(acc, greatest(acc[len(acc)], v)), [0])
  FROM sdp JOIN sp ON sdp.id = sp.id AND sdp.ti = sp.ti AND sdp.cj = sp.cj
  WHERE sdp.i < len(sp.t)),
bt(id, ti, cj, i, j, k) AS (
  SELECT id, ti, cj, len(t), len(p), -1 FROM sp
  UNION ALL
  SELECT bt.id, bt.ti, bt.cj,
         CASE WHEN sp.t[bt.i] = sp.p[bt.j] THEN bt.i - 1 WHEN cur.r[bt.j] > prev.r[bt.j + 1] THEN bt.i ELSE bt.i - 1 END,
         CASE WHEN sp.t[bt.i] = sp.p[bt.j] THEN bt.j - 1 WHEN cur.r[bt.j] > prev.r[bt.j + 1] THEN bt.j - 1 ELSE bt.j END,
         CASE WHEN sp.t[bt.i] = sp.p[bt.j] THEN bt.i - 1 ELSE -1 END
  FROM bt
  JOIN sp ON bt.id = sp.id AND bt.ti = sp.ti AND bt.cj = sp.cj
  JOIN sdp cur ON cur.id = bt.id AND cur.ti = bt.ti AND cur.cj = bt.cj AND cur.i = bt.i
  JOIN sdp prev ON prev.id = bt.id AND prev.ti = bt.ti AND prev.cj = bt.cj AND prev.i = bt.i - 1
  WHERE bt.i > 0 AND bt.j > 0),
uidx AS (SELECT DISTINCT id, ti, k FROM bt WHERE k >= 0),
used AS (SELECT uidx.id, ts.t[uidx.k + 1] AS tok, count(*) AS u FROM uidx JOIN ts ON uidx.id = ts.id AND uidx.ti = ts.ti GROUP BY uidx.id, tok),
cr AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(t) AS tok FROM ts) GROUP BY id, tok),
cc AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(p) AS tok FROM ps) GROUP BY id, tok),
lhits AS (SELECT used.id, sum(least(used.u, cr.c, cc.c)) AS h FROM used JOIN cr ON used.id = cr.id AND used.tok = cr.tok
          JOIN cc ON used.id = cc.id AND used.tok = cc.tok GROUP BY used.id),
tm AS (SELECT id, sum(len(t)) AS m FROM ts GROUP BY id),
pn AS (SELECT id, sum(len(p)) AS n FROM ps GROUP BY id),
lspr AS (SELECT pairs.id, 'rougeLsum' AS score_type,
                CASE WHEN coalesce(tm.m, 0) = 0 OR coalesce(pn.n, 0) = 0 THEN 0.0
                     ELSE CAST(coalesce(lhits.h, 0) AS DOUBLE) / pn.n END AS precision,
                CASE WHEN coalesce(tm.m, 0) = 0 OR coalesce(pn.n, 0) = 0 THEN 0.0
                     ELSE CAST(coalesce(lhits.h, 0) AS DOUBLE) / tm.m END AS recall
         FROM pairs LEFT JOIN tm ON pairs.id = tm.id LEFT JOIN pn ON pairs.id = pn.id LEFT JOIN lhits ON pairs.id = lhits.id),
lsscores AS (SELECT id, score_type, precision, recall, {FMEAS('precision', 'recall')} AS fmeasure FROM lspr)"""


SCORE_COLS = f"id, score_type, {R9('precision')} AS precision, {R9('recall')} AS recall, {R9('fmeasure')} AS fmeasure"


def interval_select(means: str, confidence: float) -> str:
    qs = f"[{(1 - confidence) / 2!r}, 0.5, {1 - (1 - confidence) / 2!r}]"
    parts = []
    for m in ("precision", "recall", "fmeasure"):
        parts.append(
            f"SELECT score_type, '{m}' AS measure, {R9('qq[1]')} AS low, {R9('qq[2]')} AS mid, {R9('qq[3]')} AS high "
            f"FROM (SELECT score_type, quantile_cont({m}, {qs}) AS qq FROM {means} GROUP BY score_type)"
        )
    return " UNION ALL ".join(parts)


def uniform(key: str, part: str = "0") -> str:
    """u from 32 bits (hex digits 8*part+1 .. 8*part+8) of md5(key)."""
    return (f"CAST(('0x' || substr(md5({key}), 8 * ({part}) + 1, 8))::BIGINT AS DOUBLE) "
            f"/ CAST(4294967296 AS DOUBLE)")


def bootstrap_exact_ctes(B: int, seed: int) -> str:
    return f"""ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT id FROM scores)),
cnt AS (SELECT count(*) AS n FROM ids),
slots AS (SELECT unnest(range(0, n * {B})) AS x, n FROM cnt),
draws AS (SELECT x // n AS b,
                 CAST(floor({uniform(f"concat_ws('-', '{seed}', x // n, (x % n) // 4)", "(x % n) % 4")} * n) AS BIGINT) AS pick
          FROM slots),
mult AS (SELECT b, pick, count(*) AS c FROM draws GROUP BY b, pick),
joined AS (SELECT m.b, s.score_type, m.c, s.precision, s.recall, s.fmeasure
           FROM mult m JOIN ids ON ids.idx = m.pick JOIN scores s ON s.id = ids.id),
means AS (SELECT score_type, b,
                 sum(c * precision) / CAST(max(n) AS DOUBLE) AS precision,
                 sum(c * recall) / CAST(max(n) AS DOUBLE) AS recall,
                 sum(c * fmeasure) / CAST(max(n) AS DOUBLE) AS fmeasure
          FROM joined, cnt GROUP BY score_type, b)"""


def bootstrap_tree_ctes(B: int, seed: int, leaf: int) -> str:
    """Draws per leaf from the top of the tree: of a node's draws, the left half of its leaves gets a
    binomial number; probabilities are summed from the mode outwards (+1, -1, +2, ...) until they pass u."""
    steps = ("list_filter(list_transform(range(0, 2 * c + 2), lambda i: mode + CASE WHEN i % 2 = 1 THEN (i + 1) // 2 ELSE -(i // 2) END), "
             "lambda k: k >= 0 AND k <= c)")
    chance = "exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + k * ln(p) + (c - k) * ln(1.0::DOUBLE - p))"
    return f"""ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT id FROM scores)),
cnt AS (SELECT count(*) AS n, CAST(ceil(count(*) / {leaf}) AS BIGINT) AS leaves FROM ids),
tree AS (
  SELECT unnest(range(0, {B})) AS b, 0::BIGINT AS lo, leaves AS hi, n AS c FROM cnt WHERE n > 0
  UNION ALL
  SELECT b, CASE WHEN half = 0 THEN lo ELSE mid END AS lo, CASE WHEN half = 0 THEN mid ELSE hi END AS hi,
         CASE WHEN half = 0 THEN hits ELSE c - hits END AS c
  FROM (SELECT b, lo, hi, mid, c, ks[least(len(list_filter(range(1, len(ks) + 1), lambda j: list_sum(list_slice(fs, 1, j)) <= u)) + 1, len(ks))] AS hits
        FROM (SELECT b, lo, hi, mid, c, u, ks, list_transform(ks, lambda k: {chance}) AS fs
              FROM (SELECT b, lo, hi, mid, c, p, u, {steps} AS ks
                    FROM (SELECT b, lo, hi, mid, c, p, least(c, CAST(floor((c + 1) * p) AS BIGINT)) AS mode,
                                 ('0x' || substr(md5(concat_ws('-', '{seed}', 't', b, lo, hi)), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE) AS u
                          FROM (SELECT b, lo, hi, c, (lo + hi) // 2 AS mid,
                                       (((lo + hi) // 2 - lo) * {leaf})::DOUBLE / (least(n, hi * {leaf}) - lo * {leaf}) AS p
                                FROM tree, cnt WHERE hi - lo > 1 AND c > 0))))), (VALUES (0), (1)) h(half)),
slots AS (SELECT b, lo AS leaf, unnest(range(0, c)) AS k, least({leaf}, n - lo * {leaf}) AS size FROM tree, cnt WHERE hi - lo = 1 AND c > 0),
draws AS (SELECT b, leaf * {leaf} + CAST(floor({uniform(f"concat_ws('-', '{seed}', 'l', b, leaf, k // 4)", "k % 4")} * size) AS BIGINT) AS pick FROM slots),
mult AS (SELECT b, pick, count(*) AS c FROM draws GROUP BY b, pick),
means AS (SELECT s.score_type, m.b, sum(m.c * precision) / max(n)::DOUBLE AS precision, sum(m.c * recall) / max(n)::DOUBLE AS recall,
                 sum(m.c * fmeasure) / max(n)::DOUBLE AS fmeasure
          FROM mult m JOIN ids ON ids.idx = m.pick JOIN scores s ON s.id = ids.id, cnt GROUP BY s.score_type, m.b)"""


def bootstrap_poisson_ctes(B: int, seed: int) -> str:
    # P(X <= k) of Poisson(1) until it is one to 15 places
    sums = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(30)]
    last = next(k for k, x in enumerate(sums) if x >= 1 - 1e-15)
    cdf = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in sums[:last + 1]) + "]"
    return f"""rep AS (SELECT id, score_type, precision, recall, fmeasure, unnest(range(0, {B})) AS b FROM scores),
wts AS (SELECT score_type, b, precision, recall, fmeasure,
               CAST(len(list_filter({cdf}, lambda cv: cv <= u)) AS DOUBLE) AS w
        FROM (SELECT *, {uniform(f"concat_ws('-', '{seed}', 'p', id, b // 4)", "b % 4")} AS u FROM rep)),
sums AS (SELECT score_type, b, sum(w) AS sw, sum(w * precision) AS sp, sum(w * recall) AS sr, sum(w * fmeasure) AS sf
         FROM wts GROUP BY score_type, b),
means AS (SELECT score_type, b, sp / sw AS precision, sr / sw AS recall, sf / sw AS fmeasure FROM sums WHERE sw > 0)"""


def state_intervals(long_scores: str, B: int, seed: int, confidence: float) -> str:
    """Poisson intervals of ``long_scores(id, score_type, measure, value)``, with the plain mean."""
    sums = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(30)]
    last = next(k for k, x in enumerate(sums) if x >= 1 - 1e-15)
    cdf = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in sums[:last + 1]) + "]"
    qs = f"[{(1 - confidence) / 2!r}, 0.5, {1 - (1 - confidence) / 2!r}]"
    return f"""lots AS (
  SELECT id, b, CAST(len(list_filter({cdf}, lambda cv: cv <= u)) AS DOUBLE) AS w
  FROM (SELECT id, b, {uniform(f"concat_ws('-', '{seed}', 'p', id, b // 4)", "b % 4")} AS u
        FROM (SELECT id, unnest(range(0, {B})) AS b FROM (SELECT DISTINCT id FROM {long_scores})))),
means AS (SELECT score_type, measure, b, sum(w * value) / sum(w) AS m FROM {long_scores} JOIN lots USING (id)
          GROUP BY score_type, measure, b HAVING sum(w) > 0),
qq AS (SELECT score_type, measure, quantile_cont(m, {qs}) AS q FROM means GROUP BY score_type, measure)
SELECT score_type, measure, mean, {R9('q[1]')} AS low, {R9('q[2]')} AS mid, {R9('q[3]')} AS high
FROM qq JOIN (SELECT score_type, measure, {R9('avg(value)')} AS mean FROM {long_scores} GROUP BY score_type, measure) USING (score_type, measure)"""


def _story_parse(content: str) -> str:
    lines0 = f"regexp_split_to_array({content}, '\\r\\n|\\r|\\n')"
    lines1 = f"(CASE WHEN regexp_matches({content}, '(\\r|\\n)$') THEN list_slice({lines0}, 1, len({lines0}) - 1) ELSE {lines0} END)"
    lines = f"list_filter(list_transform({lines1}, lambda ln: {FIX(CLEAN(STRIP('ln')))}), lambda le: le <> '')"
    return lines


# Fixed values of the stemmer, step by step: (ending, replacement).
STEP2 = """ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate
ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble fulli ful""".split()
STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
IRREGULAR = """skies sky sky sky dying die lying lie tying tie news news innings inning inning inning outings outing outing
outing cannings canning canning canning howe howe proceed proceed exceed exceed succeed succeed""".split()


def stem_ctes(tokens: str) -> str:
    """CTEs ending in ``stems(token, stem)`` for the table ``tokens(token)``: every step
    is a table of words with their letters written as c and v."""
    shape = lambda w: (f"list_reduce(string_split({w}, ''), lambda acc, ch: acc || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') "  # noqa: E731
                       "THEN 'v' WHEN ch = 'y' AND right(acc, 1) = 'c' THEN 'v' ELSE 'c' END, '')")
    cut = lambda n: f"left(w, len(w) - {n})"
    cv = lambda n: f"left(s, len(w) - {n})"
    m = lambda n: f"len(regexp_extract_all({cv(n)}, 'v+c+'))"
    double = "(len(w) >= 2 AND right(w, 1) = substr(w, len(w) - 1, 1) AND right(s, 1) = 'c')"
    cvc = lambda n: (f"((len(w) - {n} >= 3 AND right({cv(n)}, 3) = 'cvc' AND right({cut(n)}, 1) NOT IN ('w', 'x', 'y')) "  # noqa: E731
                     f"OR {cv(n)} = 'vc')")

    def longest(rules, condition):
        arms = [f"WHEN ends_with(w, '{e}') THEN CASE WHEN {condition(e)} THEN {cut(len(e))} || '{r}' ELSE w END"
                for e, r in sorted(rules, key=lambda x: -len(x[0]))]
        return "CASE " + " ".join(arms) + " ELSE w END"

    pairs = lambda flat: [(a, "" if b == "-" else b) for a, b in zip(flat[::2], flat[1::2])]
    steps = [
        f"""CASE WHEN ends_with(w, 'ies') AND len(w) = 4 THEN {cut(1)} WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)}
            WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END""",
        # a stem that lost ed or ing is marked by a bar for the next step
        f"""CASE WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN ends_with(w, 'eed') THEN CASE WHEN {m(3)} > 0 THEN {cut(1)} ELSE w END
            WHEN ends_with(w, 'ed') AND contains({cv(2)}, 'v') THEN {cut(2)} || '|'
            WHEN ends_with(w, 'ing') AND contains({cv(3)}, 'v') THEN {cut(3)} || '|' ELSE w END""",
        "w",
        f"""CASE WHEN NOT bar THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
            WHEN {double} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {cut(1)} END
            WHEN {m(0)} = 1 AND {cvc(0)} THEN w || 'e' ELSE w END""",
        f"CASE WHEN ends_with(w, 'y') AND len(w) > 2 AND right({cv(1)}, 1) = 'c' THEN {cut(1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {m(4)} > 0 THEN {cut(2)} ELSE w END",
        f"""CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {m(3)} > 0 THEN {cut(1)} ELSE w END
            ELSE {longest(pairs(STEP2), lambda e: f"{m(len(e))} > 0")} END""",
        longest(pairs(STEP3), lambda e: f"{m(len(e))} > 0"),
        longest([(e, "") for e in STEP4], lambda e: f"{m(len(e))} > 1" + (
            f" AND right({cut(3)}, 1) IN ('s', 't')" if e == "ion" else "")),
        f"CASE WHEN ends_with(w, 'e') AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {cvc(1)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m(1)} > 1 THEN {cut(1)} ELSE w END",
    ]
    odd = dict(zip(IRREGULAR[::2], IRREGULAR[1::2]))
    listed = ", ".join(f"'{w}'" for w in odd)
    out = [f"w0 AS (SELECT token, token AS w, false AS bar, {shape('token')} AS s FROM {tokens} "
           f"WHERE len(token) > 3 AND token NOT IN ({listed}))"]
    for i, step in enumerate(steps):
        out.append(f"x{i} AS (SELECT token, bar, {step} AS w FROM w{i})")
        out.append(f"w{i + 1} AS (SELECT token, rtrim(w, '|') AS w, bar OR ends_with(w, '|') AS bar, "
                   f"{shape(chr(39) + chr(39) + ' || rtrim(w, ' + chr(39) + '|' + chr(39) + ')')} AS s FROM x{i})")
    irregular = " ".join(f"WHEN '{w}' THEN '{x}'" for w, x in odd.items())
    out.append(f"stems AS (SELECT token, w AS stem FROM w{len(steps)} UNION ALL "
               f"SELECT token, CASE token {irregular} ELSE token END FROM {tokens} WHERE len(token) <= 3 OR token IN ({listed}))")
    return ",\n".join(out)


def _queries() -> dict[str, str]:
    Q: dict[str, str] = {}
    clean_doc = SQUEEZE(NL2SP(CLEAN("text")))

    Q["clean_text"] = f"SELECT doc_id, {clean_doc} AS cleaned FROM documents"

    Q["missing_period"] = f"""
SELECT doc_id, line_no, {FIX(CLEAN('line'))} AS line FROM (
  SELECT doc_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line
  FROM (SELECT doc_id, {SPLIT('text', NL)} AS arr FROM documents))"""

    Q["html_to_text"] = f"SELECT page_id, {HTML('html')} AS text FROM pages"

    art = f"{NL2SP(SQUEEZE(JOIN(DROP_PUNCT(DROP_SW(SPLIT(CLEAN(HTML('html'))), 'en')))))}"
    Q["normalize_articles"] = f"SELECT page_id, {art} AS article FROM pages"
    Q["records_to_pairs"] = f"SELECT page_id AS id, {art} AS article, url AS summary FROM pages"

    lines = _story_parse("content")
    Q["story_to_pairs"] = f"WITH {story_pairs_ctes()} SELECT id, article, summary FROM spairs"

    r0, r1, r2 = P.SPLIT_RATIO
    tot = r0 + r1 + r2
    split_case = (f"CASE WHEN p < (CAST({r0} AS DOUBLE) / {tot}) * n THEN 'train' "
                  f"WHEN p < (CAST({r0} AS DOUBLE) / {tot}) * n + (CAST({r1} AS DOUBLE) / {tot}) * n THEN 'val' ELSE 'test' END")
    Q["encode_splits"] = f"""
WITH {story_pairs_ctes()},
pos AS (SELECT id, article, summary, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM spairs),
sp AS (SELECT id, article, summary, {split_case} AS split FROM pos),
toks AS (SELECT 'articles' AS side, unnest({WTOK('article')}) AS token FROM sp WHERE split = 'train'
         UNION ALL SELECT 'summaries' AS side, unnest({WTOK('summary')}) AS token FROM sp WHERE split = 'train'),
c AS (SELECT side, token, count(*) AS count FROM toks GROUP BY side, token),
v AS (SELECT side, token, row_number() OVER (PARTITION BY side ORDER BY count DESC, token ASC) - 1 AS vid FROM c),
atok AS (SELECT id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM (SELECT id, {WTOK('article')} AS t FROM sp)),
stok AS (SELECT id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM (SELECT id, {WTOK('summary')} AS t FROM sp)),
ae AS (SELECT atok.id, string_agg(CAST(coalesce(v.vid, {P.UNK_ID}) AS VARCHAR), ' ' ORDER BY atok.i) AS ids
       FROM atok LEFT JOIN v ON v.side = 'articles' AND v.token = atok.token GROUP BY atok.id),
se AS (SELECT stok.id, string_agg(CAST(coalesce(v.vid, {P.UNK_ID}) AS VARCHAR), ' ' ORDER BY stok.i) AS ids
       FROM stok LEFT JOIN v ON v.side = 'summaries' AND v.token = stok.token GROUP BY stok.id)
SELECT sp.id, sp.split, coalesce(ae.ids, '') AS article_ids, coalesce(se.ids, '') AS summary_ids
FROM sp LEFT JOIN ae ON sp.id = ae.id LEFT JOIN se ON sp.id = se.id"""

    Q["train_vocabulary"] = f"""
WITH {story_pairs_ctes()},
pos AS (SELECT id, article, summary, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM spairs),
train AS (SELECT article, summary FROM pos WHERE p < (CAST({r0} AS DOUBLE) / {tot}) * n),
toks AS (SELECT 'articles' AS side, unnest({WTOK('article')}) AS token FROM train
         UNION ALL SELECT 'summaries' AS side, unnest({WTOK('summary')}) AS token FROM train),
c AS (SELECT side, token, count(*) AS count FROM toks GROUP BY side, token)
SELECT side, token, count, row_number() OVER (PARTITION BY side ORDER BY count DESC, token ASC) - 1 AS id FROM c"""

    lemma = "CASE lm " + " ".join(f"WHEN {q(f)} THEN {q(l)}" for f, l in P.LEXICON) + " ELSE lm END"
    lemmas = f"list_transform({SPLIT(CLEAN(HTML('html')))}, lambda lm: {lemma})"
    Q["records_to_pairs_lemmas"] = f"""
SELECT page_id AS id, {NL2SP(SQUEEZE(JOIN(DROP_PUNCT(DROP_SW(lemmas, 'en')))))} AS article, url AS summary FROM pages"""

    lex_case = "CASE lx " + " ".join(f"WHEN {q(f)} THEN {q(l)}" for f, l in P.LEXICON) + " ELSE lx END"
    Q["lemmatize_corpus"] = f"SELECT doc_id, {JOIN(f'list_transform({SPLIT(clean_doc)}, lambda lx: {lex_case})')} AS lemmatized FROM documents"

    Q["stopword_filter"] = f"SELECT doc_id, {JOIN(DROP_SW_BY_LANG(SPLIT(clean_doc), 'lang'))} AS filtered FROM documents"

    kept = DROP_PUNCT(SPLIT(CLEAN("text")))
    Q["punct_filter"] = f"SELECT doc_id, {JOIN(kept)} AS kept, CAST(len({kept}) AS BIGINT) AS n_kept FROM documents"

    Q["score_tokens"] = f"SELECT doc_id, {JOIN(TOK('text'))} AS tokens, CAST(len({TOK('text')}) AS BIGINT) AS n_tokens FROM documents"

    Q["stem_vocabulary"] = f"""
WITH tokens AS (SELECT DISTINCT unnest({TOK('text')}) AS token FROM documents),
{stem_ctes('tokens')}
SELECT token, stem FROM stems"""

    Q["ngram_counts"] = f"""
WITH {PAIRS},
tok AS (SELECT id, {TOK('target')} AS t, {TOK('prediction')} AS p FROM pairs),
ns AS (SELECT unnest([1, 2, 3]) AS n),
g AS (SELECT id, n, {NGRAMS('t', 'n')} AS tg, {NGRAMS('p', 'n')} AS pg FROM tok, ns),
u AS (SELECT id, n, unnest(tg) AS ngram, 1 AS tc, 0 AS pc FROM g
      UNION ALL SELECT id, n, unnest(pg) AS ngram, 0 AS tc, 1 AS pc FROM g)
SELECT id, n, ngram, CAST(sum(tc) AS BIGINT) AS tc, CAST(sum(pc) AS BIGINT) AS pc FROM u GROUP BY id, n, ngram"""

    Q["line_ids"] = f"""
SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_id, CAST(strlen(line) + 1 AS BIGINT) AS n_bytes FROM (
  SELECT doc_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line
  FROM (SELECT doc_id, {SPLIT('text', NL)} AS arr FROM documents))"""

    Q["file_pairs"] = """
WITH t AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS rank FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user')),
     p AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS rank FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'))
SELECT t.rank, t.conv_id AS target_conv, p.conv_id AS prediction_conv FROM t JOIN p ON t.rank = p.rank"""

    Q["positional_join"] = """
WITH k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k FROM conversations)
SELECT t.conv_id, t.k, t.text AS target, p.text AS prediction
FROM k t JOIN k p ON t.conv_id = p.conv_id AND t.k = p.k
WHERE t.role = 'user' AND p.role = 'assistant'"""

    Q["alignment_check"] = """
SELECT conv_id,
       CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_targets,
       CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_predictions,
       CAST(CASE WHEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS BIGINT) AS aligned
FROM conversations GROUP BY conv_id"""

    render_t = "replace(regexp_replace(target, '[\\t\\n\\r]', ' ', 'g'), 'ing ', ' ##ing ')"
    render_h = "replace(regexp_replace(prediction, '[\\t\\n\\r]', ' ', 'g'), 'ing ', ' ##ing ')"
    Q["generation_log_pairs"] = f"""
WITH {PAIRS},
log AS (SELECT 'T-' || CAST(id AS VARCHAR) || chr(9) || {render_t} AS v FROM pairs
        UNION ALL SELECT 'H-' || CAST(id AS VARCHAR) || chr(9) || '-0.5' || chr(9) || {render_h} AS v FROM pairs),
f AS (SELECT v, string_split(v, chr(9)) AS fs FROM log),
t AS (SELECT substr(fs[1], 2) AS key, array_to_string(list_slice(fs, 2, len(fs)), chr(9)) AS target FROM f WHERE starts_with(v, 'T')),
h AS (SELECT substr(fs[1], 2) AS key, array_to_string(list_slice(fs, 3, len(fs)), chr(9)) AS hypothesis FROM f WHERE starts_with(v, 'H'))
SELECT t.key, replace(t.target, ' ##', '') AS target, replace(h.hypothesis, ' ##', '') AS hypothesis FROM t JOIN h ON t.key = h.key"""

    Q["rouge_n"] = f"WITH {rouge_n_ctes([1, 2, 3])} SELECT {SCORE_COLS} FROM scores"

    Q["rouge_n_stemmed"] = f"""
WITH {PAIRS},
sides AS (SELECT id, 't' AS side, {TOK('target')} AS a FROM pairs UNION ALL SELECT id, 'p', {TOK('prediction')} FROM pairs),
words AS (SELECT id, side, generate_subscripts(a, 1) AS i, unnest(a) AS token FROM sides),
tokens AS (SELECT DISTINCT token FROM words),
{stem_ctes('tokens')},
stemmed AS (SELECT id, side, i, stem, lead(stem) OVER (PARTITION BY id, side ORDER BY i) AS after FROM words JOIN stems USING (token)),
grams AS (SELECT id, side, 1 AS n, stem AS gram FROM stemmed
          UNION ALL SELECT id, side, 2, stem || ' ' || after FROM stemmed WHERE after IS NOT NULL),
counts AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 't') AS t, count(*) FILTER (WHERE side = 'p') AS p
           FROM grams GROUP BY id, n, gram),
sums AS (SELECT id, n, sum(least(t, p)) AS h, sum(t) AS t, sum(p) AS p FROM counts GROUP BY id, n),
pr AS (SELECT pairs.id, 'rouge' || ns.n AS score_type,
              coalesce(h, 0)::DOUBLE / greatest(coalesce(p, 0), 1) AS precision, coalesce(h, 0)::DOUBLE / greatest(coalesce(t, 0), 1) AS recall
       FROM pairs CROSS JOIN (VALUES (1), (2)) ns(n) LEFT JOIN sums ON sums.id = pairs.id AND sums.n = ns.n),
scores AS (SELECT *, {FMEAS('precision', 'recall')} AS fmeasure FROM pr)
SELECT {SCORE_COLS} FROM scores"""

    uni = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'), lambda ut: ut <> '')"
    Q["custom_scorer"] = f"""
WITH {PAIRS},
tok AS (SELECT id, {uni('target')} AS t, {uni('prediction')} AS p FROM pairs),
words AS (SELECT id, unnest(t) AS x, 1 AS t, 0 AS p FROM tok UNION ALL SELECT id, unnest(p), 0, 1 FROM tok),
counts AS (SELECT id, x, sum(t) AS t, sum(p) AS p FROM words GROUP BY id, x),
hits AS (SELECT id, sum(least(t, p))::DOUBLE AS h FROM counts GROUP BY id),
pr AS (SELECT tok.id, 'unigram' AS score_type, CASE WHEN len(p) > 0 THEN coalesce(h, 0) / len(p) ELSE 0.0 END AS precision,
              CASE WHEN len(t) > 0 THEN coalesce(h, 0) / len(t) ELSE 0.0 END AS recall FROM tok LEFT JOIN hits USING (id)),
scores AS (SELECT *, {FMEAS('precision', 'recall')} AS fmeasure FROM pr)
SELECT {SCORE_COLS} FROM scores"""

    values = {"words": [("target", "len(tw)"), ("prediction", "len(pw)"), ("ratio", "len(tw)::DOUBLE / len(pw)"),
                        ("common", "len(list_intersect(tw, pw))"),
                        ("jaccard", "len(list_intersect(tw, pw))::DOUBLE / len(list_distinct(tw || pw))")],
              "chars": [("0", "length(target)"), ("1", "length(prediction)")]}
    sizes = f"""{PAIRS},
tw AS (SELECT *, string_split(target, ' ') AS tw, string_split(prediction, ' ') AS pw FROM pairs),
sizes AS (""" + " UNION ALL ".join(
        f"SELECT id, '{kind}' AS score_type, '{m}' AS measure, CAST({x} AS DOUBLE) AS value FROM tw"
        for kind, each in values.items() for m, x in each) + ")"
    Q["custom_measures"] = f"WITH {sizes} SELECT id, score_type, measure, {R9('value')} AS value FROM sizes"
    Q["measure_intervals"] = f"WITH {sizes},\n{state_intervals('sizes', P.BOOT_SAMPLES, P.BOOT_SEED, P.BOOT_CONFIDENCE)}"
    Q["accumulated_scores"] = f"""
WITH {rouge_n_ctes([1, 2])},
long AS (UNPIVOT (SELECT id, score_type, precision, recall, fmeasure FROM scores) ON precision, recall, fmeasure INTO NAME measure VALUE value),
{state_intervals('long', P.BOOT_SAMPLES, P.BOOT_SEED, P.BOOT_CONFIDENCE)}"""

    Q["map_lines"] = f"""
SELECT line, replace(value, 'a', 'A') || '!' AS value FROM (
  SELECT row_number() OVER (ORDER BY doc_id, ln) - 1 AS line, value FROM (
    SELECT doc_id, generate_subscripts(arr, 1) AS ln, unnest(arr) AS value FROM (SELECT doc_id, {SPLIT('text', NL)} AS arr FROM documents)))
WHERE len(value) >= 20"""

    Q["rouge_l"] = f"WITH RECURSIVE {rouge_l_ctes()} SELECT {SCORE_COLS} FROM lscores"

    Q["rouge_lsum"] = f"WITH RECURSIVE {rouge_lsum_ctes()} SELECT {SCORE_COLS} FROM lsscores"

    Q["bootstrap_exact"] = (
        f"WITH {rouge_n_ctes([1, 2])},\n{bootstrap_exact_ctes(P.BOOT_SAMPLES, P.BOOT_SEED)}\n"
        + interval_select("means", P.BOOT_CONFIDENCE)
    )
    Q["bootstrap_tree"] = (
        f"WITH RECURSIVE {rouge_n_ctes([1, 2])},\n{bootstrap_tree_ctes(P.BOOT_SAMPLES, P.BOOT_SEED, P.BOOT_LEAF_ROWS)}\n"
        + interval_select("means", P.BOOT_CONFIDENCE)
    )
    Q["bootstrap_poisson"] = (
        f"WITH {rouge_n_ctes([1, 2])},\n{bootstrap_poisson_ctes(P.BOOT_SAMPLES, P.BOOT_SEED)}\n"
        + interval_select("means", P.BOOT_CONFIDENCE)
    )
    Q["aggregate_report"] = f"""
WITH {rouge_n_ctes([1, 2])},
{bootstrap_exact_ctes(P.BOOT_SAMPLES, P.BOOT_SEED)},
iv AS ({interval_select('means', P.BOOT_CONFIDENCE)})
SELECT score_type || '-' || CASE measure WHEN 'recall' THEN 'R' WHEN 'precision' THEN 'P' ELSE 'F' END AS score_type, low, mid, high FROM iv"""

    Q["example_report"] = f"""
WITH RECURSIVE {rouge_n_ctes([1, 2])},
{rouge_l_ctes(with_tokens=False)},
allsc AS (SELECT * FROM scores UNION ALL SELECT * FROM lscores)
SELECT id,
  {R9("max(CASE WHEN score_type = 'rouge1' THEN precision END)")} AS "rouge1-P",
  {R9("max(CASE WHEN score_type = 'rouge1' THEN recall END)")} AS "rouge1-R",
  {R9("max(CASE WHEN score_type = 'rouge1' THEN fmeasure END)")} AS "rouge1-F",
  {R9("max(CASE WHEN score_type = 'rouge2' THEN precision END)")} AS "rouge2-P",
  {R9("max(CASE WHEN score_type = 'rouge2' THEN recall END)")} AS "rouge2-R",
  {R9("max(CASE WHEN score_type = 'rouge2' THEN fmeasure END)")} AS "rouge2-F",
  {R9("max(CASE WHEN score_type = 'rougeL' THEN precision END)")} AS "rougeL-P",
  {R9("max(CASE WHEN score_type = 'rougeL' THEN recall END)")} AS "rougeL-R",
  {R9("max(CASE WHEN score_type = 'rougeL' THEN fmeasure END)")} AS "rougeL-F"
FROM allsc GROUP BY id"""

    bleu_ns = "[1, 2, 3, 4]"
    Q["corpus_bleu"] = f"""
WITH {PAIRS},
tok AS (SELECT id, {WTOK('prediction')} AS h, {WTOK('target')} AS r FROM pairs),
ns AS (SELECT unnest({bleu_ns}) AS n),
g AS (SELECT id, n, {NGRAMS('h', 'n')} AS hg, {NGRAMS('r', 'n')} AS rg FROM tok, ns),
ch AS (SELECT id, n, x AS gram, count(*) AS c FROM (SELECT id, n, unnest(hg) AS x FROM g) GROUP BY id, n, x),
cr AS (SELECT id, n, x AS gram, count(*) AS c FROM (SELECT id, n, unnest(rg) AS x FROM g) GROUP BY id, n, x),
hits AS (SELECT n, sum(least(ch.c, cr.c)) AS h FROM ch JOIN cr USING (id, n, gram) GROUP BY n),
tots AS (SELECT n, sum(len(hg)) AS t FROM g GROUP BY n),
pn AS (SELECT tots.n, CAST(coalesce(hits.h, 0) AS BIGINT) AS h, CAST(tots.t AS BIGINT) AS t FROM tots LEFT JOIN hits ON tots.n = hits.n),
lens AS (SELECT CAST(sum(len(h)) AS BIGINT) AS c, CAST(sum(len(r)) AS BIGINT) AS r FROM tok),
w AS (SELECT
   max(CASE WHEN n = 1 THEN h END) AS h1, max(CASE WHEN n = 1 THEN t END) AS t1,
   max(CASE WHEN n = 2 THEN h END) AS h2, max(CASE WHEN n = 2 THEN t END) AS t2,
   max(CASE WHEN n = 3 THEN h END) AS h3, max(CASE WHEN n = 3 THEN t END) AS t3,
   max(CASE WHEN n = 4 THEN h END) AS h4, max(CASE WHEN n = 4 THEN t END) AS t4 FROM pn),
s AS (SELECT w.*, lens.c, lens.r,
        CASE WHEN t1 > 0 THEN CAST(h1 AS DOUBLE) / t1 ELSE 0.0 END AS p1,
        CASE WHEN t2 > 0 THEN CAST(h2 AS DOUBLE) / t2 ELSE 0.0 END AS p2,
        CASE WHEN t3 > 0 THEN CAST(h3 AS DOUBLE) / t3 ELSE 0.0 END AS p3,
        CASE WHEN t4 > 0 THEN CAST(h4 AS DOUBLE) / t4 ELSE 0.0 END AS p4,
        CASE WHEN lens.c = 0 THEN 0.0 WHEN lens.c > lens.r THEN 1.0 ELSE exp(1.0 - CAST(lens.r AS DOUBLE) / lens.c) END AS bp
      FROM w, lens)
SELECT {R9("CASE WHEN h1 = 0 OR h2 = 0 OR h3 = 0 OR h4 = 0 OR c = 0 THEN 0.0 ELSE bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4.0) END * 100")} AS bleu,
       {R9('p1 * 100')} AS p1, {R9('p2 * 100')} AS p2, {R9('p3 * 100')} AS p3, {R9('p4 * 100')} AS p4,
       {R9('bp')} AS bp, {R9('CASE WHEN r > 0 THEN CAST(c AS DOUBLE) / r ELSE 0.0 END')} AS ratio,
       c AS sys_len, r AS ref_len
FROM s"""

    def tok13(x: str) -> str:
        for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES_13A):
            x = f"replace({x}, {q(old)}, {q(new)})"
        x = f"' ' || {x} || ' '"
        for pattern, new in RULES_13A:
            x = f"regexp_replace({x}, {q(pattern)}, {q(new.replace('$', chr(92)))}, 'g')"
        return f"list_filter(regexp_split_to_array({x}, {q(PY_SPACE_CLASS + '+')}), lambda t13: t13 <> '')"

    Q["corpus_bleu_13a"] = f"""
WITH {PAIRS},
tok AS (SELECT id, {tok13('prediction')} AS h, {tok13('target')} AS r0, {tok13("replace(target, ',', '')")} AS r1 FROM pairs),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
g AS (SELECT id, n, {NGRAMS('h', 'n')} AS hg, {NGRAMS('r0', 'n')} AS g0, {NGRAMS('r1', 'n')} AS g1 FROM tok, ns),
u AS (SELECT id, n, unnest(hg) AS x, 0 AS side FROM g UNION ALL SELECT id, n, unnest(g0), 1 FROM g UNION ALL SELECT id, n, unnest(g1), 2 FROM g),
c AS (SELECT id, n, x, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b, count(*) FILTER (WHERE side = 2) AS d
      FROM u GROUP BY id, n, x),
hits AS (SELECT n, sum(least(a, greatest(b, d))) AS hit, sum(a) AS tot FROM c GROUP BY n),
orders AS (SELECT ns.n, coalesce(hit, 0) AS hit, coalesce(tot, 0) AS tot FROM ns LEFT JOIN hits USING (n)),
missed AS (SELECT *, sum((hit = 0)::INT) OVER (ORDER BY n) AS z FROM orders),
p AS (SELECT n, hit, CASE WHEN tot = 0 THEN 0.0 WHEN hit = 0 THEN 1.0 / (pow(2.0, z) * tot) ELSE hit::DOUBLE / tot END AS p FROM missed),
lens AS (SELECT CAST(sum(len(h)) AS BIGINT) AS c,
                CAST(sum(CASE WHEN (abs(len(r0) - len(h)), len(r0)) <= (abs(len(r1) - len(h)), len(r1)) THEN len(r0) ELSE len(r1) END) AS BIGINT) AS r FROM tok),
s AS (SELECT lens.c, lens.r, CASE WHEN lens.c = 0 THEN 0.0 WHEN lens.c < lens.r THEN exp(1.0 - lens.r::DOUBLE / lens.c) ELSE 1.0 END AS bp FROM lens)
SELECT {R9("(SELECT CASE WHEN max(hit) = 0 OR min(p) = 0 THEN 0.0 ELSE bp * exp(avg(ln(CASE WHEN p > 0 THEN p END))) END FROM p) * 100")} AS bleu,
       {", ".join(R9(f"(SELECT p FROM p WHERE n = {k}) * 100") + f" AS p{k}" for k in (1, 2, 3, 4))},
       {R9('bp')} AS bp, {R9('CASE WHEN r > 0 THEN c::DOUBLE / r ELSE 0.0 END')} AS ratio, c AS sys_len, r AS ref_len
FROM s"""

    pos = ("(SELECT doc_id, text AS article, split_part(text, chr(10), 1) AS summary, "
           "row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)")
    r0, r1, r2 = P.SPLIT_RATIO
    tot = r0 + r1 + r2
    Q["ratio_split"] = f"""
SELECT doc_id, article, summary, CASE WHEN pos < (CAST({r0} AS DOUBLE) / {tot}) * n THEN 'train'
                    WHEN pos < (CAST({r0} AS DOUBLE) / {tot}) * n + (CAST({r1} AS DOUBLE) / {tot}) * n THEN 'val'
                    ELSE 'test' END AS split
FROM {pos}"""

    N, M = P.TRAIN_SIZE, P.TEST_SIZE
    Q["size_split"] = f"""
SELECT doc_id, article, summary, CASE WHEN pos < {N} THEN 'train' WHEN pos < {N + M} THEN 'test' ELSE 'valid' END AS split FROM {pos}"""
    Q["size_split_overlap"] = f"""
SELECT doc_id, article, summary, 'train' AS split FROM {pos} WHERE pos < {N}
UNION ALL SELECT doc_id, article, summary, 'test' AS split FROM {pos} WHERE pos >= {N - 1} AND pos < {N - 1 + M}
UNION ALL SELECT doc_id, article, summary, 'valid' AS split FROM {pos} WHERE pos >= {N + M - 2}"""
    Q["lm_split"] = f"""
SELECT doc_id, CASE WHEN pos < {N} THEN 'train' WHEN pos < {N + M} THEN 'test' ELSE 'valid' END AS split, article
FROM (SELECT doc_id, {clean_doc} AS article, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"""
    Q["head_tail"] = f"SELECT doc_id, article, summary, CASE WHEN pos < {P.HEAD_N} THEN 'head' ELSE 'tail' END AS part FROM {pos}"

    L = P.MAX_LENGTH
    Q["sample_by_length"] = f"SELECT doc_id, text AS article, CAST(strlen(text) + 1 AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) + 1 < {L}"
    Q["sample_share"] = f"""
SELECT CAST(coalesce(sum(CASE WHEN strlen(text) + 1 < {L} THEN 1 ELSE 0 END), 0) AS BIGINT) AS kept, count(*) AS total,
       round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN strlen(text) + 1 < {L} THEN 1 ELSE 0 END) / count(*) * 100 END, 2) AS share
FROM documents"""

    vtoks = WTOK(clean_doc)
    Q["vocabulary"] = f"""
WITH t AS (SELECT unnest({vtoks}) AS token FROM documents),
c AS (SELECT token, count(*) AS count FROM t GROUP BY token HAVING count(*) >= {P.VOCAB_MIN_COUNT})
SELECT token, count, row_number() OVER (ORDER BY count DESC, token ASC) - 1 AS id FROM c"""
    Q["encode_corpus"] = f"""
WITH t AS (SELECT unnest({vtoks}) AS token FROM documents),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token ASC) - 1 AS id FROM t GROUP BY token HAVING count(*) >= {P.VOCAB_MIN_COUNT}),
d AS (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS token FROM (SELECT doc_id, {vtoks} AS toks FROM documents)),
e AS (SELECT d.doc_id, d.pos, coalesce(v.id, {P.UNK_ID}) AS id FROM d LEFT JOIN v ON d.token = v.token)
SELECT docs.doc_id, coalesce(string_agg(CAST(e.id AS VARCHAR), ' ' ORDER BY e.pos), '') AS ids,
       CAST(coalesce(sum(CASE WHEN e.id = {P.UNK_ID} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_unk
FROM documents docs LEFT JOIN e ON docs.doc_id = e.doc_id GROUP BY docs.doc_id"""

    Q["encode_articles"] = f"""
WITH docs AS (SELECT doc_id AS id, CASE WHEN pos < {N} THEN 'train' WHEN pos < {N + M} THEN 'test' ELSE 'valid' END AS split, toks
              FROM (SELECT doc_id, {vtoks} AS toks, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)),
t AS (SELECT unnest(toks) AS token FROM docs WHERE split = 'train'),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token ASC) - 1 AS vid FROM t GROUP BY token),
d AS (SELECT id, generate_subscripts(toks, 1) AS i, unnest(toks) AS token FROM docs),
e AS (SELECT d.id, string_agg(CAST(coalesce(vid, {P.UNK_ID}) AS VARCHAR), ' ' ORDER BY i) AS ids FROM d LEFT JOIN v USING (token) GROUP BY d.id)
SELECT docs.id, split, coalesce(ids, '') AS article_ids FROM docs LEFT JOIN e USING (id)"""

    Q["corpus_union"] = """
SELECT 'documents' AS corpus, doc_id AS id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents
UNION ALL SELECT 'benchmark' AS corpus, item_id AS id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM benchmark"""

    sents = "list_filter(string_split(text, chr(10)), lambda se: se <> '')"
    Q["sentence_split"] = f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sentence FROM (SELECT doc_id, {sents} AS s FROM documents)"""

    Q["after_marker_window"] = f"""
WITH {STORIES},
l AS (SELECT id AS doc_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS raw FROM (SELECT id, string_split(content, chr(10)) AS arr FROM stories)),
c AS (SELECT doc_id, line_no, {FIX(CLEAN(STRIP('raw')))} AS line FROM l),
m AS (SELECT doc_id, line_no, line, CASE WHEN starts_with(line, '{HIGHLIGHT_MARKER}') THEN 1 ELSE 0 END AS is_marker FROM c)
SELECT doc_id, line_no,
       CAST(CASE WHEN max(is_marker) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1
                  AND is_marker = 0 AND line <> '' THEN 1 ELSE 0 END AS BIGINT) AS is_highlight
FROM m"""

    Q["sorted_scores"] = f"""
WITH {rouge_n_ctes([1, 2, 3])}
SELECT score_type, id, {R9('fmeasure')} AS fmeasure,
       row_number() OVER (PARTITION BY score_type ORDER BY fmeasure DESC, id ASC) - 1 AS rank
FROM scores"""
    # the same results by the way for tables beyond memory
    for name in ("lemmatize_corpus", "encode_corpus"):
        Q[f"{name}_joined"] = Q[name]
    return Q


def chr_join_wrap(arr: str) -> str:
    return f"list_transform({arr}, lambda hw: '<s> ' || hw || ' </s>')"


def oracle_sql() -> dict[str, str]:
    return _queries()
