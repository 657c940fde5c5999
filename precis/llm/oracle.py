"""DuckDB SQL of the training-data queries that SQL can express.

The rules are written out again here; nothing is taken from the operators but fixed
tables: of the licence scan the equivalent spellings, known digests and sentence
words, and of the URL filter the list of suffixes.
"""

from __future__ import annotations

from precis.llm.license_scan import _SENTENCE, KNOWN_DIGESTS, MARKS, SPELLINGS
from precis.llm.suffixes import RULES

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
fits AS (
  SELECT host, path, rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS place
  FROM (SELECT DISTINCT host, path FROM urls) JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                      AND starts_with(path, substr(rule, instr(rule, '/')))),
marks AS (
  SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM urls LEFT JOIN marks ON page_id = doc_id GROUP BY host),
names AS (SELECT host, n, bad, string_split(name, '.') AS labels, regexp_matches(name, '^([0-9]+(\.[0-9]+){3}$|\[)') AS ip FROM (
  SELECT host, n, bad, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS name FROM hosts)),
listed(listed) AS (VALUES @SUFFIXES@),
ends AS (SELECT host, array_to_string(labels[-k:], '.') AS tail, k FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS k FROM names)),
-- labels of the suffix: an exception spares its first one, a wildcard adds one, the longest rule counts
fit AS (
  SELECT host, max(CASE WHEN starts_with(listed, '!') THEN 1000 + k - 1 WHEN starts_with(listed, '*.') THEN k + 1 ELSE k END) AS n
  FROM ends JOIN listed ON listed IN (tail, '*.' || tail, '!' || tail) GROUP BY host),
levels AS (
  SELECT host, n, bad, CASE WHEN ip THEN '[ip]' ELSE array_to_string(labels[-least(m, len(labels)):], '.') END AS suffix,
         CASE WHEN NOT ip THEN array_to_string(labels[-least(m + 1, len(labels)):], '.') END AS domain
  FROM (SELECT names.*, coalesce(fit.n % 1000, 1) AS m FROM names LEFT JOIN fit USING (host))),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM levels GROUP BY suffix),
top AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS m FROM s0),
s1 AS (SELECT suffix, n, bad, m FROM s0, top),
ks AS (SELECT fit(sum(CASE WHEN n > 0 THEN n * (bad / n - m) ^ 2 - m * (1 - m) END),
                  sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END)) AS k FROM s1),
s2 AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s1, ks),
d1 AS (SELECT l.suffix, domain, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(m) AS m
       FROM levels l JOIN s2 USING (suffix) GROUP BY l.suffix, domain),
kd AS (SELECT fit(sum(CASE WHEN n > 0 THEN n * (bad / n - m) ^ 2 - m * (1 - m) END),
                  sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END)) AS k FROM d1 WHERE domain IS NOT NULL),
d2 AS (SELECT suffix, domain, CASE WHEN domain IS NULL THEN m ELSE (bad + k * m) / (n + k) END AS m FROM d1, kd),
h1 AS (SELECT host, l.n::DOUBLE AS n, l.bad::DOUBLE AS bad, m FROM levels l JOIN d2
       ON l.suffix = d2.suffix AND l.domain IS NOT DISTINCT FROM d2.domain),
kh AS (SELECT fit(sum(CASE WHEN n > 0 THEN n * (bad / n - m) ^ 2 - m * (1 - m) END),
                  sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END)) AS k FROM h1),
h2 AS (SELECT host, (bad + k * m) / (n + k) AS rate, n + k AS weight FROM h1, kh)
SELECT u.page_id, u.host, u.path, f.rule,
       coalesce(f.verdict, CASE WHEN rate - 1.64 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u JOIN h2 USING (host) LEFT JOIN fits f ON f.host = u.host AND f.path = u.path AND f.place = 1
"""


def _fitted(sql: str) -> str:
    """``fit(extra, weight)`` written out: the clamped moment estimate of a prior strength."""
    import re

    def one(m: re.Match) -> str:
        extra, weight = m.group(1), m.group(2)
        return f"CASE WHEN {extra} > 0 THEN least(greatest({weight} / {extra} - 1, 1.0), 1000.0) ELSE 1000.0 END"

    return re.sub(r"fit\((sum\(CASE.*?END\)),\s*(sum\(CASE.*?END\))\)", one, sql, flags=re.S)


def _suffixes() -> str:
    """The listed rules as VALUES, those beyond ASCII in both spellings."""
    both = set(RULES)
    for rule in RULES:
        if not rule.isascii():
            both.add("!" * rule.startswith("!") + rule.lstrip("!").encode("idna").decode())
    return ", ".join(f"('{r}')" for r in sorted(both))


_NOTICE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*[0-9<\[{]|©|all rights reserved)[^\n]*"


def _lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{MARKS}', 'abcdefghijklmnopqrstuvwxyz{' ' * len(MARKS)}')"


def _canonical(text: str) -> str:
    out = rf"' ' || regexp_replace({text}, '[^a-z0-9\x{{80}}-\x{{10ffff}}]+', ' ', 'g') || ' '"
    for spelling, canonical in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{canonical}')"
    return f"trim({out}, ' ')"


def _any_notice(arr: str, i: str) -> str:
    """Does line ``i`` start with "copyright" and go on as no licence sentence does? DuckDB's patterns can't look
    ahead: what follows is held against the sentence words by itself (its lines joined, as words may be broken there)."""
    head = r"'^[^a-z0-9\n]*copyright[ \t:*_-]+'"
    rest = f"regexp_replace(array_to_string({arr}[{i}:], chr(10)), {head}, '')"
    return (f"CASE WHEN regexp_matches({arr}[{i}], {head}) THEN regexp_matches({rest}, '^[a-z0-9\\x{{80}}-\\x{{10ffff}}]') "
            f"AND NOT regexp_matches({rest}, '^({_SENTENCE})\\b') ELSE false END")


def _op6() -> str:
    known = ", ".join(f"('{digest}', '{name}')" for name, digest in KNOWN_DIGESTS)
    kept = f"CASE WHEN {_any_notice('arr', 'i')} THEN ' ' WHEN i > 1 THEN chr(10) || arr[i] ELSE arr[i] END"
    return f"""
WITH lowered AS (SELECT doc_id, {_lowered("coalesce(text, '')")} AS low FROM documents),
lines AS (SELECT doc_id, low, string_split(low, chr(10)) AS lines, regexp_replace(low, '{_NOTICE}', ' ', 'g') AS plain FROM lowered),
marked AS (SELECT doc_id, plain, string_split(plain, chr(10)) AS arr,
                  len(list_filter(range(1, len(lines) + 1), lambda i: {_any_notice('lines', 'i')})) > 0 AS freely FROM lines),
digests AS (
  SELECT doc_id, sha256({_canonical('plain')}) AS digest,
         CASE WHEN freely THEN sha256({_canonical(f"array_to_string(list_transform(range(1, len(arr) + 1), lambda i: {kept}), '')")}) END AS freer
  FROM marked),
known(known, license) AS (VALUES {known})
SELECT doc_id, digest, coalesce(k.license, f.license) AS license
FROM digests LEFT JOIN known k ON digest = k.known LEFT JOIN known f ON freer = f.known
"""


OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
totals AS (SELECT *, 1.5::DOUBLE * (sum(size) OVER ())::DOUBLE AS wanted, sum(weight) OVER () AS weights FROM sources),
-- sources in the order in which they stop as the level rises
filled AS (
  SELECT *, wanted - coalesce(sum(2 * size) OVER earlier, 0)::DOUBLE AS rest, weights - coalesce(sum(weight) OVER earlier, 0) AS parts
  FROM totals WINDOW earlier AS (ORDER BY 2 * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT *, 2 * size * parts < weight * rest AS stopped FROM filled),
level AS (SELECT any_value(wanted) - coalesce(sum(2 * size) FILTER (WHERE stopped), 0)::DOUBLE AS rest,
                 sum(weight) FILTER (WHERE NOT stopped) AS parts FROM stops),
targets AS (
  SELECT source, size AS source_size, CASE WHEN stopped THEN (2 * size)::DOUBLE ELSE weight * level.rest / level.parts END AS target
  FROM stops, level),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, CAST(s.doc_id AS VARCHAR), s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""

OP11 = r"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
marks AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex,
                 min(page_id) OVER (PARTITION BY body) AS first FROM bodies)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM marks
"""

# The cheapest repair as dynamic programming, turn by turn: for each last role (none, s, u, a) the least
# (cost, audit, text); ``none`` is a state that can't be reached. Insertions follow a turn once or twice.
_STATES = ("z", "s", "u", "a")


def _best(*options: tuple[str, str]) -> str:
    """The least of (condition, struct) options."""
    return "list_min([" + ", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in options) + "])"


def _step(state: str, cost: str, letter: str, text: str) -> str:
    more = f"CASE WHEN {state}.t = '' THEN {text} ELSE {state}.t || chr(10) || {text} END" if text else f"{state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {more}}}"


def _op13() -> str:
    stay, free = "(CASE WHEN cut THEN 5 ELSE 0 END)", "NOT must"
    has = lambda s: f"{s} IS NOT NULL"
    kept = {"s": [("z", "s")], "u": [("z", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")], "z": []}
    turn = {}
    for state in _STATES:
        options = [(has(state), _step(state, "2", "D", ""))]
        for before, initial in kept[state]:
            options.append((f"{has(before)} AND {free} AND initial = '{initial}'", _step(before, stay, "K", "role || ':' || text")))
            if state in "ua":
                name = "user" if state == "u" else "assistant"
                options.append((f"{has(before)} AND {free}", _step(before, f"1 + {stay}", "R", f"'{name}:' || text")))
        turn[state] = _best(*options)
    user, helper = "'user:'", "'assistant:'"
    u1 = _best(("u IS NOT NULL", "u"), *[(has(s), _step(s, "5", "I", user)) for s in ("z", "s", "a")])
    a1 = _best(("a IS NOT NULL", "a"), ("u IS NOT NULL", _step("u", "5", "I", helper)))
    a2 = _best(("a1 IS NOT NULL", "a1"), ("u1 IS NOT NULL", _step("u1", "5", "I", helper)))
    u2 = _best(("u1 IS NOT NULL", "u1"), ("a1 IS NOT NULL", _step("a1", "5", "I", user)))
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    polynomial = 0xEDB88320
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc_list AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || [ascii(k)::BIGINT FOR k IN string_split(key, '')],
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS lot
  FROM keyed, crc_list),
rows AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM lots, unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) WHERE lot <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM rows),
seen AS (
  SELECT *, last = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
         substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
turns AS (SELECT *, blank OR again AS must, last NOT IN ('.', '!', '?') AS cut FROM seen),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut AND NOT must) AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': ''}}::{state} AS z, NULL::{state} AS s,
         {{'c': 5, 'a': 'I', 't': 'user:'}}::{state} AS u, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}::{state} AS a
  FROM sums
  UNION ALL
  SELECT conv_id, pos, z, s, {u2} AS u, {a2} AS a FROM (
    SELECT conv_id, pos, z, s, {u1} AS u1, {a1} AS a1 FROM (
      SELECT w.conv_id, pos + 1 AS pos, {turn['z']} AS z, {turn['s']} AS s, {turn['u']} AS u, {turn['a']} AS a
      FROM walk w JOIN turns r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.pos + 1))),
final AS (
  SELECT w.conv_id, list_min([CASE WHEN z IS NOT NULL THEN z END, CASE WHEN a IS NOT NULL THEN a END]) AS best
  FROM walk w JOIN sums m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = m.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1,
    "op5_host_reputation": _fitted(OP5).replace("@SUFFIXES@", _suffixes()),
    "op7_mixing": OP7,
    "op11_warc": OP11,
    "op13_conversation_repair": _op13(),
}
if KNOWN_DIGESTS:
    ORACLES["op6_license_scan"] = _op6()
