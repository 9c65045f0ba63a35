"""DuckDB SQL for the queries that SQL can express whole."""

from __future__ import annotations

from millrace.llm.quality_rules import KIND_SHARE, KINDS, LEAST, LENGTHS, PRIOR_SHARE, RULES, THRESHOLDS, WORD_LENGTHS, prior_rates

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to FROM m"""

MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT max(level) FROM l WHERE weight * level <= 3 * source_size) AS final FROM l),
t AS (SELECT source, source_size, least(CASE WHEN weight * level <= 3 * source_size THEN weight * final ELSE 3.0::DOUBLE * source_size END, 3.0::DOUBLE * source_size) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END AS whole FROM t),
b AS (SELECT source_size, target, whole, greatest(target - whole * source_size, 0) AS rest, source FROM r),
z AS (SELECT d.*, CAST((length(bin(size)) - 1) // 2 AS INT) AS class, b.source_size, b.target, b.whole, b.rest FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT source, class, CAST(1 << class AS BIGINT) AS weight, any_value(rest) AS rest, CAST(sum(size) AS BIGINT) AS words FROM z GROUP BY 1, 2),
e AS (SELECT a.source, a.class, a.weight, (a.rest - (SELECT coalesce(sum(x.words), 0) FROM c x WHERE x.source IS NOT DISTINCT FROM a.source AND x.class > a.class))
  / nullif((SELECT sum(x.words * x.weight) FROM c x WHERE x.source IS NOT DISTINCT FROM a.source AND x.class <= a.class), 0) AS level FROM c a),
o AS (SELECT e.source, e.class, CASE WHEN weight * coalesce(level, 0) <= 1
  THEN greatest(weight * (SELECT arg_max(coalesce(x.level, 0), x.class) FROM e x WHERE x.source IS NOT DISTINCT FROM e.source AND x.weight * coalesce(x.level, 0) <= 1), 1e-12::DOUBLE) ELSE 1.0::DOUBLE END AS p FROM e),
k AS (SELECT z.*, (u / (1 - u)) / (p / nullif(1 - p, 0)) AS odds_ratio FROM z JOIN o ON z.source IS NOT DISTINCT FROM o.source AND z.class = o.class),
j AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY coalesce(odds_ratio, 0), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS prior FROM k)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN rest > 0 AND prior + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM j"""


def quality_rules_sql(rounds: int = 25) -> str:
    """Counts, votes, and the fit written out round by round over the table of vote patterns."""
    k, classes, prior = range(len(RULES)), range(1 + len(KINDS)), prior_rates()
    pattern, total = ", ".join(f"v{j}" for j in k), " + ".join(f"w{c}" for c in classes)
    begun = ["1.0::DOUBLE AS w0"] + [
        f"0.02::DOUBLE + {' + '.join(f'CASE WHEN v{RULES.index(x)} = -1 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END' for x in own)} AS w{c}" for c, own in enumerate(KINDS.values(), 1)
    ]
    vote = lambda bad, good: f"CASE WHEN n_words < {LEAST} THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    length, (odd, usual) = "(word_chars / greatest(n_words, 1))", WORD_LENGTHS
    cast = {x: vote(f"{name} / greatest({whole}, 1) > {bad}", f"{name} / greatest({whole}, 1) < {good}") for x, (name, whole, bad, good) in THRESHOLDS.items()}
    cast["length"] = vote(f"n_words < {LENGTHS[0]}", f"n_words >= {LENGTHS[1]}")
    cast["word_length"] = vote(f"{length} < {odd[0]} OR {length} > {odd[1]}", f"{length} > {usual[0]} AND {length} < {usual[1]}")
    votes = [cast[x] for x in RULES]
    ctes = [
        rf"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents)""",
        "win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d))",
        "rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1)",
        "cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY 1)",
        r"""st AS (SELECT rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_capitals,
  length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts FROM d LEFT JOIN cov USING (rid))""",
        f"vt AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS v{j}' for j, v in enumerate(votes))} FROM st)",
        f"vp AS MATERIALIZED (SELECT {pattern}, CAST(count(*) AS DOUBLE) AS n, {', '.join(begun)} FROM vt GROUP BY ALL)",
        f"g0 AS MATERIALIZED (SELECT {pattern}, n, sum(n) OVER () AS everything, {', '.join(f'w{c} / ({total}) AS r{c}' for c in classes)} FROM vp)",
    ]
    for r in range(rounds):
        rates = [
            f"(coalesce(sum(n * r{c}) FILTER (v{j} = -1), 0) + any_value(everything) * {share}::DOUBLE * {prior[c][j]}::DOUBLE) / (coalesce(sum(n * r{c}) FILTER (v{j} <> 0), 0) + any_value(everything) * {share}::DOUBLE) AS b{c}_{j}"
            for c in classes for share in [PRIOR_SHARE if c == 0 else KIND_SHARE] for j in k
        ]
        sizes = [f"ln((sum(n * r{c}) + 1) / (any_value(everything) + {len(classes)})) AS s{c}" for c in classes]
        pull = lambda c: " + ".join([f"s{c}", *(f"CASE v{j} WHEN -1 THEN ln(b{c}_{j}) WHEN 1 THEN ln(1 - b{c}_{j}) ELSE 0 END" for j in k)])
        scores = ", ".join(f"{pull(c)} AS x{c}" for c in classes)
        top = f"greatest({', '.join(f'x{c}' for c in classes)})"
        norm = " + ".join(f"exp(x{c} - {top})" for c in classes)
        ctes += [
            f"s{r} AS MATERIALIZED (SELECT {', '.join(rates + sizes)} FROM g{r})",
            f"x{r} AS MATERIALIZED (SELECT {pattern}, n, everything, {scores} FROM g{r}, s{r})",
            f"g{r + 1} AS MATERIALIZED (SELECT {pattern}, n, everything, {', '.join(f'exp(x{c} - {top}) / ({norm}) AS r{c}' for c in classes)} FROM x{r})",
        ]
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return f"""WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND r0 >= 0.5 AS kept, round(r0, 6) AS quality_prob
  FROM vt JOIN g{rounds} USING ({', '.join(f'v{j}' for j in k)})"""


def phrases_sql(least: int = 30, longest: int = 4, share: int = 80, most: int = 2000) -> str:
    """Every n-gram of every piece counted on its own, then cuts and longer phrases by joins."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?
-
]')), '[^ 	]+') AS words FROM d),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM p GROUP BY 1),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
g AS (SELECT lang, m, list_slice(words, i, i + m - 1) AS w FROM i, range(1, {longest + 1}) r(m) WHERE i + m - 1 <= len(words)),
f AS MATERIALIZED (SELECT lang, any_value(m) AS m, array_to_string(w, ' ') AS phrase, any_value(w) AS w, count(*) AS f FROM g GROUP BY lang, array_to_string(w, ' ') HAVING count(*) >= {least}),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM f)),
c AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, b, b + s - 1), ' ') AS phrase, max(f) AS longer FROM f, range(2, {longest}) x(s), range(1, {longest}) y(b) WHERE s < m AND b + s - 1 <= m GROUP BY 1, 2),
free AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE NOT (100 * coalesce(longer, 0) >= {share} * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {most}"""


def url_rules_sql(rules: list[tuple[str, str, str]], min_support: float = 0.01, min_confidence: float = 0.8, otherwise: str = "allow") -> str:
    """Every subset of every labelled URL's tokens counted, in place of FP-growth."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    when = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s}') THEN '{value(v, h + s)}'" for v, h, s in order) + " END"
    named = lambda parts, kind: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{kind}:' || regexp_replace(x, '[0-9]+', '#', 'g'))"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS found FROM pages),
v AS (SELECT *, CASE WHEN found > 0 THEN substr(url, found + 3) ELSE '' END AS rest FROM u),
w AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(rest, '^[^?#]*((?s:.)*)$', 1) AS tail FROM v),
known AS MATERIALIZED (SELECT id, page_id, host, path, {when(lambda v, r: r)} AS rule, {when(lambda v, r: v)} AS said, CASE WHEN found > 0 THEN list_distinct(
  {named("string_split(host, '.')", 'host')} || {named("string_split(path, '/')", 'path')}
  || {named("list_transform(string_split(regexp_extract(tail, '^[?]([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))", 'query')}
  || {named("[regexp_extract(tail, '#((?s:.)*)$', 1)]", 'fragment')} || {named("[substr(url, 1, found - 1)]", 'scheme')}) ELSE [] END AS tokens FROM w),
labelled AS (SELECT said, list_sort(tokens) AS tokens, count(*) OVER () AS everything FROM known WHERE said IS NOT NULL),
sets AS (SELECT said, everything, unnest(list_transform(range(1, CAST(1 << len(tokens) AS BIGINT)), lambda b: list_filter(tokens, lambda x, i: (b >> (i - 1)) & 1 = 1))) AS items FROM labelled),
counted AS (SELECT items, said, any_value(everything) AS everything, count(*) AS n, sum(count(*)) OVER (PARTITION BY items) AS held FROM sets GROUP BY items, said),
strong AS MATERIALIZED (SELECT items, said, array_to_string(items, ' ') AS text, CAST(n AS DOUBLE) / CAST(held AS DOUBLE) AS confidence, CAST(n AS DOUBLE) / everything AS support
  FROM counted WHERE n >= ceil({min_support}::DOUBLE * everything) AND CAST(n AS DOUBLE) / CAST(held AS DOUBLE) >= {min_confidence}::DOUBLE),
mined AS MATERIALIZED (SELECT * FROM strong s WHERE NOT EXISTS (SELECT 1 FROM strong g WHERE g.said = s.said AND len(g.items) < len(s.items) AND g.confidence >= s.confidence AND list_has_all(s.items, g.items))),
hit AS (SELECT k.id, m.said AS mined_verdict, m.text AS mined_rule, m.confidence AS mined_confidence FROM known k JOIN mined m ON list_has_all(k.tokens, m.items) WHERE k.said IS NULL
  QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY m.confidence DESC, m.support DESC, m.text, m.said) = 1)
SELECT page_id, host, path, rule, coalesce(said, mined_verdict, '{otherwise}') AS verdict, mined_rule, round(mined_confidence, 6) AS mined_confidence FROM known LEFT JOIN hit USING (id)"""
