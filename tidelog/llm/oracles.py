"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import manifest, mixing, quality, repair, warc
from .secrets import BASE, MORE


def secrets_sql() -> str:
    """Spans from the lengths of matches and of what lies between them."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    rules, ctes, lists = [*BASE, *MORE], [], []
    for rank, rule in enumerate(rules):
        p = quote(rule.pattern)
        ctes.append(f"regexp_split_to_array(t, {p}) AS g{rank}, regexp_extract_all(t, {p}) AS h{rank}, regexp_extract_all(t, {p}, {rule.group}) AS q{rank}")
        begin = f"coalesce(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h{rank}[1:i - 1], lambda x: length(x))), 0)"
        kept = f"list_filter(range(1, len(h{rank}) + 1), lambda i: length(q{rank}[i]) >= {max(1, rule.least)})"
        lists.append(f"list_transform({kept}, lambda i: struct_pack(s := CAST({begin} AS BIGINT), r := {rank}, e := CAST({begin} + length(h{rank}[i]) AS BIGINT)))")
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    listed = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda v: {names}[v.r + 1] || ':' || v.s || ':' || v.e), ','), '')"
    counts = ", ".join(f"CAST(len(list_filter(b, lambda v: v.r = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    return (
        f"WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(ctes)} FROM x), "
        f"f AS (SELECT doc_id, list_sort({' || '.join(lists)}) AS f FROM m), b AS (SELECT doc_id, f, list_filter(f, lambda v: v.r < {len(BASE)}) AS b FROM f) "
        f"SELECT doc_id, {counts}, sha256({listed('b')}) AS base_sha256, {listed('f')} AS spans FROM b"
    )


def quality_sql() -> str:
    """What repeats of n words or more cover is what windows of n words that occur twice cover."""
    def inside(name: str, n: int) -> str:
        return (
            f"{name}w AS (SELECT doc_id, i, w[i:i + {n - 1}] AS v FROM t, unnest(range(1, len(w) - {n - 2})) AS u(i) WHERE len(w) >= {n}), "
            f"{name}r AS (SELECT doc_id, i FROM {name}w QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1), "
            f"{name} AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM {name}r, unnest(range({n})) AS u(k) GROUP BY doc_id)"
        )

    least, most, share = quality.LEAST_WORDS, quality.MOST_REPEATED, quality.MOST_COVERED
    return (
        rf"WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), {inside('three', 3)}, {inside('long', least)}, "
        rf"m AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w[i:i + {most}] AS v FROM t, unnest(range(1, len(w) - {most - 1})) AS u(i) WHERE len(w) > {most}) QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1), "
        r"l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id), "
        r"c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM t), "
        "j AS (SELECT c.*, coalesce(l.n, 0) AS n_dup_lines, coalesce(three.n, 0) AS n_repeat_words, coalesce(long.n, 0) AS covered, m.doc_id IS NOT NULL AS much FROM c LEFT JOIN l USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN m USING (doc_id)), "
        "k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j) "
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered AS n_covered, base_failed, NOT base_failed AND covered <= {share} * n_words AND NOT much AS kept FROM k"
    )


def warc_sql() -> str:
    """Every record against its damaged copy, without a tree."""
    head = "'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e"
    return (
        f"WITH r AS (SELECT page_id AS id, {head} AS rec FROM pages, (SELECT chr(13) || chr(10) AS e)), "
        f"s AS (SELECT id, id // {warc.PER_FILE} AS file, rec, strlen(rec) AS size FROM r), "
        f"o AS (SELECT *, id % {warc.PER_FILE} AS rank, CAST(sum(size) OVER w AS BIGINT) AS \"end\" FROM s WINDOW w AS (PARTITION BY file ORDER BY id)), "
        "h AS (SELECT *, rec[:299] || '#' || rec[301:] AS hurt FROM o WHERE id % 97 = 13) "
        "SELECT file, rank, \"end\" - size AS start, \"end\", id, sha256(rec) AS expected, sha256(hurt) AS found FROM h WHERE rec <> hurt"
    )


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {bit})"
    return f"xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {byte}))"


def manifest_sql(levels: int = 7) -> str:
    """Levels one by one, with each row's place and hash on them; a level beyond a tree's root changes nothing."""
    n = manifest.FANOUT
    field = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    rest = " || ".join(field(c) for c in manifest.FIELDS[:-1])
    hurt = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{manifest.UPPER}', '{manifest.LOWER}') ELSE text END"
    ctes = [
        f"leaf AS (SELECT doc_id, lang, sha256({rest} || {field('text')}) AS h, sha256({rest} || {field(hurt)}) AS hurt FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS own, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, h) AS key, count(*) OVER (PARTITION BY lang) AS n FROM leaf)",
        "p0 AS (SELECT key, own, h AS node, hurt AS folded, '' AS proof FROM a0)",
        "n0 AS (SELECT lang AS tree, own AS pos, h AS node, n FROM a0)",
    ]

    def up(a: str, b: str) -> list[str]:
        """nodes b of nodes a, and the rows' paths over them"""
        run = f"SELECT tree, pos // {n} AS pos, list(node ORDER BY pos) AS kids, (n + {n - 1}) // {n} AS n, n AS was FROM n{a} GROUP BY tree, pos // {n}, n"
        return [
            f"n{b} AS (SELECT tree, pos, CASE WHEN was > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS node, n, CASE WHEN was > 1 THEN kids END AS kids FROM ({run}))",
            f"p{b} AS (SELECT p.key, p.own // {n} AS own, CASE WHEN kids IS NULL THEN p.folded ELSE sha256(array_to_string(kids[1:p.own % {n}], '') || p.folded || array_to_string(kids[p.own % {n} + 2:], '')) END AS folded, "
            f"CASE WHEN kids IS NULL THEN p.proof ELSE p.proof || array_to_string(kids[1:p.own % {n}], '') || array_to_string(kids[p.own % {n} + 2:], '') END AS proof, k.node AS top FROM p{a} p JOIN t{a} USING (key) JOIN n{b} k ON k.tree IS NOT DISTINCT FROM t{a}.tree AND k.pos = p.own // {n})",
            f"t{b} AS (SELECT * FROM t{a})",
        ]

    ctes.append("t0 AS (SELECT key, lang AS tree FROM a0)")
    for k in range(levels):
        ctes += up(str(k), str(k + 1))
    ctes += [
        f"subs AS (SELECT tree AS lang, node, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{levels})",
        "nu0 AS (SELECT 0 AS tree, pos, node, n FROM subs)",
        "tu0 AS (SELECT key, 0 AS tree FROM a0)",
        f"pu0 AS (SELECT p.key, s.pos AS own, p.folded, p.proof FROM p{levels} p JOIN t0 USING (key) JOIN subs s ON s.lang IS NOT DISTINCT FROM t0.tree)",
    ]
    for k in range(2):
        ctes += up(f"u{k}", f"u{k + 1}")
    return (
        f"WITH {', '.join(ctes)} SELECT a.doc_id, a.h AS leaf, l.top AS subroot, u.top AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = u.top AS verified "
        f"FROM a0 a JOIN p{levels} l USING (key) JOIN pu2 u USING (key)"
    )


def mixing_sql() -> str:
    """Windows over whole sources."""
    m, quote = mixing, lambda x: "'" + x.replace("'", "''") + "'"
    weight = f"[{', '.join(map(str, m.WEIGHTS))}][rank % {len(m.WEIGHTS)} + 1]"
    before = "coalesce(sum({}) OVER (ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    filling = "most / weight, source NULLS LAST"
    return (
        f"WITH w AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, {quote(m.WORD)})), 0) AS BIGINT) AS size FROM documents), "
        f"k AS (SELECT doc_id, source, size, -ln((CAST('0x' || sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:13] AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE) "
        f"/ coalesce(greatest({m.LEAST}::DOUBLE, length(translate(text, {quote(m.SIGNS)}, '')) / nullif(length(text), 0) * (size / (size + {m.SHORT}))), {m.LEAST}::DOUBLE) AS key FROM w), "
        "s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM k GROUP BY source), "
        f"t AS (SELECT *, {weight} AS weight, source_size * {m.EPOCHS} AS most FROM s), "
        f"f AS (SELECT max(({m.TOTAL}::DOUBLE * total - full_) / (shares - gone)) AS level FROM (SELECT {before.format('most', filling)}::DOUBLE AS full_, {before.format('weight', filling)}::DOUBLE AS gone, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS shares FROM t)), "
        "b AS (SELECT source, source_size, least(most::DOUBLE, level * weight) AS target FROM t, f), "
        "r AS (SELECT k.*, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN floor(target / b.source_size) ELSE 0 END AS rounds, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source) "
        "SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, floor(target - rounds * source_size + 0.5) - before)) AS BIGINT) AS taken FROM r"
    )


def repair_sql() -> str:
    """Row by row, the cheapest edits that end in each state, as costs of nine digits with the audit behind them, so that the least text is the one to keep."""
    r = repair
    space = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
    more = lambda x, cost, letter: f"lpad(CAST(CAST({x}[:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {x}[10:] || '{letter}'"
    put = lambda x: more(x, r.INSERT, "I")
    either = lambda x: more(x, r.DELETE, "D")
    kept = lambda initial, x: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {x} END"
    made = lambda x: f"CASE WHEN NOT gone THEN {x} END"
    to_u = ", ".join(f"{kept('u', more(x, 'cut', 'K'))}, {made(more(x, f'({r.REROLE} + cut)', 'R'))}" for x in ("q0", "q1", "a"))
    to_a = f"{kept('a', more('u', 'cut', 'K'))}, {made(more('u', f'({r.REROLE} + cut)', 'R'))}"
    opened = f"SELECT conv_id, i, q0, q1, u, least(q3, {put('u')}) AS a FROM (SELECT *, least(q2, {put('q0')}, {put('q1')}, {put('q3')}) AS u FROM "
    null = "coalesce({}, ' ')"
    return (
        f"WITH RECURSIVE b AS (SELECT conv_id, turn, {null.format('role')} AS role, {null.format('text')} AS text, {crc32_sql(null.format('CAST(conv_id AS VARCHAR)') + " || ':' || " + null.format('CAST(turn AS VARCHAR)'))} % 20 AS kind FROM conversations), "
        "d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM b, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d), "
        f"f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, role[:1] AS initial, {space} = '' AS blank, {space}[-1] NOT IN ('.', '!', '?') AS ends FROM o), "
        "g AS (SELECT *, blank OR seen AS gone, CASE WHEN ends AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS cut, CASE WHEN lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM f), "
        "s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3 FROM g "
        f"UNION ALL SELECT x.conv_id, g.i, {either('q0')}, least({either('q1')}, {kept('s', more('q0', 'cut', 'K'))}), least({either('u')}, {to_u}), least({either('a')}, {to_a}) FROM ({opened}s)) x JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i + 1), "
        f"e AS (SELECT conv_id, least(q0, a) AS best FROM ({opened}s)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1), "
        "l AS (SELECT conv_id, unnest(string_split(best[10:], '')) AS letter, generate_subscripts(string_split(best[10:], ''), 1) AS j FROM e WHERE length(best) > 9), "
        "m AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS k FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)), "
        "t AS (SELECT m.conv_id, k, letter, g.role, g.text, bool_or(k = 1 AND letter = 'K' AND g.initial = 's') OVER (PARTITION BY m.conv_id) AS shift FROM m LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.i = m.i WHERE letter <> 'D'), "
        "h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (k % 2 = 1) <> shift THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM t GROUP BY conv_id), "
        "c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, CAST(count(*) FILTER (blank) AS BIGINT) AS blank, CAST(count(*) FILTER (seen AND NOT blank) AS BIGINT) AS duplicate, CAST(count(*) FILTER (cut > 0) AS BIGINT) AS truncated, CAST(sum(bad) AS BIGINT) AS illegal FROM g GROUP BY conv_id) "
        "SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best[:9] AS BIGINT), 0) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256 "
        "FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM n.conv_id"
    )


def all_sql() -> dict[str, str]:
    return {"op5_secrets": secrets_sql(), "op7_quality": quality_sql(), "op9_warc_audit": warc_sql(), "op11_conversation_repair": repair_sql(), "op12_mix_sources": mixing_sql(), "op13_merkle_manifest": manifest_sql()}
