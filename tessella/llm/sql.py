"""DuckDB SQL of the operators whose definition takes more than a few lines of it. For checks on small tables: some parts compare all pairs."""

from __future__ import annotations

from collections.abc import Mapping

from . import licenses
from . import mixing as mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- SimHash

P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
ALL = (1 << 64) - 1


def _u(x: int) -> str:
    return f"{x}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) % {_u(1 << 64)})"


def _mul(a: str, k: int) -> str:
    return _low(f"({a}) * {_u(k)}")


def _rotl(a: str, r: int) -> str:
    return _low(f"({a}) * {_u(1 << r)} + ({a}) // {_u(1 << (64 - r))}")


def _macro_sql() -> str:
    """XXH64 with seed 42 over hexadecimal bytes, as common table expressions: shingles s(sid, x) to hashes h(sid, h)."""
    number = lambda pos, n: " + ".join(f"(instr('0123456789ABCDEF', substr(x, {pos} + {2 * b + 1}, 1)) - 1)::UHUGEINT * {_u(16 * 256**b)} + (instr('0123456789ABCDEF', substr(x, {pos} + {2 * b + 2}, 1)) - 1)::UHUGEINT * {_u(256**b)}" for b in range(n))
    round_ = lambda acc, k: _mul(_rotl(_low(f"({acc}) + " + _mul(k, P2)), 31), P1)
    seed = 42
    starts = [(seed + P1 + P2) & ALL, (seed + P2) & ALL, seed, (seed - P1) & ALL]
    return f"""
stripes AS (
  SELECT sid, x, n, 0 AS pos, {", ".join(f"{_u(v)} AS a{k}" for k, v in enumerate(starts))} FROM s WHERE n >= 32
  UNION ALL
  SELECT sid, x, n, pos + 64, {", ".join(f"{round_(f'a{k}', f'k{k}')}" for k in range(4))}
  FROM (SELECT *, {", ".join(f"{number(f'pos + {16 * k}', 8)} AS k{k}" for k in range(4))} FROM stripes WHERE pos + 64 <= 2 * n)),
long_ AS (
  SELECT sid, x, n, pos, a0, a1, a2, a3, {_low(" + ".join(_rotl(f"a{k}", r) for k, r in enumerate((1, 7, 12, 18))))} AS m FROM stripes WHERE pos + 64 > 2 * n),
merged AS (
  SELECT sid, x, n, pos, {_low(_mul(f"xor(m3, {round_('0::UHUGEINT', 'a3')})", P1) + f" + {_u(P4)}")} AS h
  FROM (SELECT *, {_low(_mul(f"xor(m2, {round_('0::UHUGEINT', 'a2')})", P1) + f" + {_u(P4)}")} AS m3
  FROM (SELECT *, {_low(_mul(f"xor(m1, {round_('0::UHUGEINT', 'a1')})", P1) + f" + {_u(P4)}")} AS m2
  FROM (SELECT *, {_low(_mul(f"xor(m, {round_('0::UHUGEINT', 'a0')})", P1) + f" + {_u(P4)}")} AS m1 FROM long_)))),
started AS (
  SELECT sid, x, n, pos, {_low("h + n::UHUGEINT")} AS h FROM merged
  UNION ALL SELECT sid, x, n, 0, {_low(f"{_u((seed + P5) & ALL)} + n::UHUGEINT")} FROM s WHERE n < 32),
eights AS (
  SELECT * FROM started
  UNION ALL
  SELECT sid, x, n, pos + 16, {_low(_mul(_rotl(f"xor(h, {round_('0::UHUGEINT', 'k')})", 27), P1) + f" + {_u(P4)}")}
  FROM (SELECT *, {number("pos", 8)} AS k FROM eights WHERE pos + 16 <= 2 * n)),
fours AS (
  SELECT sid, x, n, CASE WHEN pos + 8 <= 2 * n THEN pos + 8 ELSE pos END AS pos,
         CASE WHEN pos + 8 <= 2 * n THEN {_low(_mul(_rotl(f"xor(h, {_mul('k', P1)})", 23), P2) + f" + {_u(P3)}")} ELSE h END AS h
  FROM (SELECT *, CASE WHEN pos + 8 <= 2 * n THEN {number("pos", 4)} ELSE 0::UHUGEINT END AS k FROM eights WHERE pos + 16 > 2 * n)),
ones AS (
  SELECT * FROM fours
  UNION ALL
  SELECT sid, x, n, pos + 2, {_mul(_rotl(f"xor(h, {_mul('k', P5)})", 11), P1)}
  FROM (SELECT *, {number("pos", 1)} AS k FROM ones WHERE pos + 2 <= 2 * n)),
mixed AS (SELECT sid, {_mul(f"xor(h, h // {_u(1 << 33)})", P2)} AS h FROM ones WHERE pos = 2 * n),
stirred AS (SELECT sid, {_mul(f"xor(h, h // {_u(1 << 29)})", P3)} AS h FROM mixed),
h AS (SELECT sid, xor(h, h // {_u(1 << 32)})::UBIGINT AS h FROM stirred)"""


def simhash() -> str:
    """XXH64 by its definition, majorities bit by bit, links by all pairs of distinct fingerprints, components by reachability."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, [z FOR z IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+') IF z <> ''] AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] FOR k IN range(1, len(ws) - 1)] END) AS t FROM w),
d AS (SELECT t, row_number() OVER () AS sid FROM (SELECT DISTINCT t FROM g)),
s AS (SELECT sid, hex(encode(t)) AS x, octet_length(encode(t)) AS n FROM d),
{_macro_sql()},
c AS (SELECT doc_id, b, 2 * sum(CAST(h // (CAST(1 AS UBIGINT) << CAST(b AS UBIGINT)) % 2 AS BIGINT)) > count(*) AS on_ FROM g JOIN d USING (t) JOIN h USING (sid), range(64) r(b) GROUP BY doc_id, b),
f AS (
  SELECT w.doc_id, coalesce(any_value(q.fp), 0)::UBIGINT AS fp FROM w
  LEFT JOIN (SELECT doc_id, sum(CASE WHEN on_ THEN CAST(1 AS HUGEINT) << CAST(b AS INTEGER) ELSE CAST(0 AS HUGEINT) END) AS fp FROM c GROUP BY doc_id) q USING (doc_id) GROUP BY w.doc_id),
u AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON bit_count(xor(a.fp, b.fp)::UHUGEINT::HUGEINT) <= 3),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT r.a AS fp, min(u.least) AS component_id FROM r JOIN u ON u.fp = r.b GROUP BY r.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN m USING (fp)"""


# ---------------------------------------------------------------- substring dedup


def substring_dedup() -> str:
    """The first document of each 50-byte string; bytes under strings of an earlier one are merged to runs."""
    return """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, start, substr(x, 2 * start + 1, 354) AS x FROM (SELECT doc_id, unnest(range(0, len(x) // 2 - 49, 128)) AS start, x FROM t WHERE len(x) >= 100)),
w AS (SELECT doc_id, start + unnest(range(0, least(128, len(x) // 2 - 49))) AS pos, substr(x, 2 * unnest(range(0, least(128, len(x) // 2 - 49))) + 1, 100) AS k FROM b),
first AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, pos FROM w JOIN first USING (k) WHERE least < doc_id),
marked AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER o + 50 THEN 0 ELSE 1 END AS opens FROM gone WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 50 AS hi FROM numbered GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM runs
  UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
text_ AS (
  SELECT k.doc_id, string_agg(CASE WHEN k.hi IS NULL THEN substr(x, 2 * k.lo + 1) ELSE substr(x, 2 * k.lo + 1, 2 * (k.hi - k.lo)) END, '' ORDER BY k.lo) AS x
  FROM kept k JOIN t USING (doc_id) GROUP BY k.doc_id),
sums AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(text_.x, t.x))) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN text_ USING (doc_id)"""


# ---------------------------------------------------------------- mixing


def mixing(targets: Mapping[str, float], rest: float, block: int = 32, quanta: int = 1000) -> str:
    """The schedule, slot by slot: of the released blocks that with the earliest deadline; a new start whenever a source has run out."""
    names = sorted(targets)
    q = mix.quantised([*(float(targets[k]) for k in names), max(rest, min(targets.values(), default=1.0) / 1000)], quanta)
    n = len(q)
    pool = "CASE source " + " ".join(f"WHEN {_quoted(s)} THEN {k}" for k, s in enumerate(names, 1)) + f" ELSE {n} END"
    total = "list_sum([q[k] FOR k IN range(1, " + str(n + 1) + ") IF left_[k] > 0])"
    ready = f"[((done[k] + 1) * total + q[k] - 1) // q[k] * 1000 + k FOR k IN range(1, {n + 1}) IF left_[k] > 0 AND done[k] * total // q[k] <= t]"
    each = lambda inside: f"[{inside} FOR k IN range(1, {n + 1})]"
    return f"""
WITH RECURSIVE p AS (SELECT {q}::BIGINT[] AS q),
d AS (SELECT doc_id, source, {pool} AS c, row_number() OVER (PARTITION BY {pool} ORDER BY substr(md5(doc_id::VARCHAR), 1, 15), doc_id) - 1 AS rank FROM documents),
n AS (SELECT list(m ORDER BY k) AS rows_ FROM (SELECT k, count(d.c) AS m FROM range(1, {n + 1}) r(k) LEFT JOIN d ON d.c = k GROUP BY k)),
sim AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS c, 0::BIGINT AS b, 0::BIGINT AS t, {each("0::BIGINT")} AS done, {each("0::BIGINT")} AS used, {each(f"(rows_[k] + {block - 1}) // {block}")} AS left_, q
  FROM n, p
  UNION ALL
  SELECT slot + 1, c, used[c], CASE WHEN left_[c] = 1 THEN 0 ELSE t + 1 END,
         CASE WHEN left_[c] = 1 THEN {each("0::BIGINT")} ELSE {each("done[k] + CASE WHEN k = c THEN 1 ELSE 0 END")} END,
         {each("used[k] + CASE WHEN k = c THEN 1 ELSE 0 END")}, {each("left_[k] - CASE WHEN k = c THEN 1 ELSE 0 END")}, q
  FROM (SELECT * EXCLUDE (c, b), CAST(list_min({ready}) % 1000 AS BIGINT) AS c FROM (SELECT *, CAST({total} AS BIGINT) AS total FROM sim WHERE list_sum(left_) > 0))),
placed AS (SELECT slot, c, b, CAST(coalesce(sum(least({block}, rows_[c] - b * {block})) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sim, n WHERE slot >= 0)
SELECT doc_id, source, CASE WHEN d.c < {n} THEN source END AS pool, CAST(b AS BIGINT) AS block, slot, start + rank % {block} AS position
FROM d JOIN placed ON placed.c = d.c AND placed.b = d.rank // {block}"""


# ---------------------------------------------------------------- licences


def _canonical(x: str) -> str:
    for a, b in licenses.FOREIGN:
        x = f"replace({x}, {_quoted(a.decode())}, {_quoted(b.decode())})"
    for pattern in (licenses.COPYRIGHT_LINE, licenses.LIST_ITEM):
        x = f"regexp_replace({x}, {_quoted(pattern)}, '', 'g')"
    x = f"translate(translate({x}, {_quoted(licenses.JOINS.decode())}, ''), '{UPPER}', '{LOWER}')"
    return f"[z FOR z IN string_split(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]', ' ', 'g'), ' ') IF z <> '']"


def license_scan() -> str:
    """Digests of normal forms, joined to those of the known licences."""
    same = ", ".join(f"{_quoted(a.decode())}: {_quoted(b.decode())}" for a, b in licenses.EQUIVALENT.items())
    words = "array_to_string([coalesce(map_extract(e.m, z)[1], z) FOR z IN {x}], ' ')"
    known = ", ".join(f"('{d.hex()}', {_quoted(n)})" for d, n in sorted(licenses.known().items()))
    spoken = " OR ".join(f"contains(translate(line, '{UPPER}', '{LOWER}'), '{t.decode()}')" for t in licenses.TRIGGERS)
    return f"""
WITH e AS (SELECT MAP {{{same}}} AS m),
k AS (SELECT * FROM (VALUES {known}) v(digest, name)),
d AS (SELECT doc_id, md5({words.format(x=_canonical("coalesce(text, '')"))}) AS digest FROM documents, e),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, md5({words.format(x=_canonical("line"))}) AS digest FROM l, e WHERE {spoken}),
n AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM s JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.name, coalesce(n.notices, '') AS notices FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)"""
