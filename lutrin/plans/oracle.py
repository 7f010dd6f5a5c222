"""The SQL (DuckDB) that says what each query of queries.py says."""

from __future__ import annotations

import re

from lutrin.operators.families import RULES
from lutrin.operators.spans import ARTICLE

_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\A[{_SPACE}]+', ''), '[{_SPACE}]+\z', '')"


def _lead(c: str) -> str:
    return rf"length({c}) - length(regexp_replace({c}, '\A[{_SPACE}]+', ''))"


_FAMILY = "CASE " + " ".join(f"WHEN contains(nfc_normalize(source_path), '{f}') THEN '{n}'" for f, n in RULES) + " ELSE 'other' END"
_TOKENS = r"regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}_]+')"
_BASE = "array_slice(string_split(source_path, '/'), -1, -1)[1]"
_STEM = rf"regexp_replace({_BASE}, '(.)\.[^.]*$', '\1')"

_LAYOUT = """
p0 AS (SELECT source_path, page_num, min(text) AS text FROM doc_pages WHERE text <> '' AND source_path IS NOT NULL AND page_num IS NOT NULL GROUP BY ALL),
p AS (SELECT *, length(text) n, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_path ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p0),
f AS (SELECT source_path, string_agg(text, chr(10) ORDER BY page_num) AS t FROM p0 GROUP BY 1)"""
# Fixed values, as in spans.ARTICLE and ANNEXE; DuckDB has no look-behind, so the patterns are said again.
_UPPER, _LOWER = (re.search(r"\[(%s[^\]]*)\]" % x, ARTICLE).group(1) for x in ("A-ZÀ", "a-zà"))
_HEAD = rf"(?:UG(?:SU)?|UV|N|A|P)[\p{{L}}\p{{N}}_]*\.[0-9]+(?:\.[0-9]+)*[\s]+[{_UPPER}][{_LOWER}]"
# Pieces of the text from each header on, with their offsets.
_HEADS = _LAYOUT + rf""",
s AS (SELECT source_path, t, string_split(regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_(])({_HEAD})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM f),
e AS (SELECT source_path, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM s),
h AS (SELECT source_path, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY source_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM e),
hs AS (SELECT source_path, pos, piece, regexp_extract(piece, '^([\p{{L}}\p{{N}}_]+\.[0-9]+(?:\.[0-9]+)*)', 1) AS code FROM h WHERE i > 1)"""

_ANNEXE = rf"(?i)A\s*NNEXE\s+[IVXLCDM]+\s*[:–-]?\s*[{_UPPER}][^\n]{{0,120}}"
# Annexe headers of f(source_path, t) by their offsets, without references after an open bracket.
_ANNEXES = rf"""
as0 AS (SELECT source_path, t, string_split(regexp_replace(t, '({_ANNEXE})', chr(2) || '\1', 'g'), chr(2)) AS ps FROM f),
as1 AS (SELECT source_path, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM as0),
as2 AS (SELECT *, lag(piece) OVER w AS prior, coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM as1 WINDOW w AS (PARTITION BY source_path ORDER BY i)),
an AS (SELECT source_path, pos, {_strip(f"regexp_extract(piece, '^{_ANNEXE}')")} AS title FROM as2 WHERE i > 1 AND NOT regexp_matches(prior, '\([\s]*\z'))"""

_ASKED = """
q AS (SELECT id AS query_id, question AS text, expected_keywords, regexp_extract(id, '(\\d+)$', 1)::BIGINT AS num FROM golden WHERE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 20 = 0)"""

_ALL_ASKED = _ASKED.split(" WHERE ")[0] + ")"


def _bm25(queries: str, name: str = "sc") -> str:
    return rf"""
{name}qt AS (SELECT query_id, w AS term, count(*) qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) w FROM {queries}) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM {name}qt JOIN ts USING (term) JOIN po USING (term) JOIN dl USING (chunk_ord), st GROUP BY ALL)"""


_INDEX = rf"""
tk AS (SELECT chunk_ord, {_TOKENS} AS ws FROM chunks),
dl AS (SELECT chunk_ord, len(ws)::BIGINT dl FROM tk),
st AS (SELECT count(*) n, avg(dl) avgdl FROM dl),
po AS (SELECT chunk_ord, term, count(*) tf FROM (SELECT chunk_ord, unnest(ws) term FROM tk) GROUP BY ALL),
d0 AS (SELECT term, count(*) df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) raw FROM po, st GROUP BY term),
ts AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM d0) ELSE raw END idf FROM d0)"""


def _legs(queries: str, vec: str, k: int, families: str = "", tag: str = "") -> str:
    """CTE x{tag}(query_id, chunk_ord, dr, br, ds, bs, rrf) for one search."""
    keep = f"doc_family IN ({families})" if families else "true"
    return _bm25(queries, f"sc{tag}") + rf""",
al{tag} AS (SELECT chunk_ord FROM chunks WHERE {keep}),
fk{tag} AS (SELECT least({10 * k}, count(*)) k FROM al{tag}),
dn{tag} AS (SELECT q.query_id, e.vec_id chunk_ord, round(list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) ds
  FROM {queries} q JOIN embeddings v ON v.vec_id = q.{vec}, embeddings e WHERE e.vec_id IN (SELECT chunk_ord FROM chunks)),
d1{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ds DESC, chunk_ord) r FROM dn{tag}),
d2{tag} AS (SELECT query_id, chunk_ord, ds, row_number() OVER (PARTITION BY query_id ORDER BY r) dr FROM d1{tag}, fk{tag} WHERE r <= k AND chunk_ord IN (SELECT chunk_ord FROM al{tag})),
b1{tag} AS (SELECT q.query_id, a.chunk_ord, coalesce(s, 0.0) bs, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(s, 0.0), 9) DESC, a.chunk_ord DESC) br
  FROM {queries} q CROSS JOIN al{tag} a LEFT JOIN sc{tag} s ON s.query_id = q.query_id AND s.chunk_ord = a.chunk_ord),
b2{tag} AS (SELECT b1{tag}.* FROM b1{tag}, fk{tag} WHERE br <= k),
x{tag} AS (SELECT coalesce(d.query_id, b.query_id) query_id, coalesce(d.chunk_ord, b.chunk_ord) chunk_ord, dr, br, ds, bs,
  coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) rrf FROM d2{tag} d FULL JOIN b2{tag} b ON b.query_id = d.query_id AND b.chunk_ord = d.chunk_ord)"""


_BEST = """
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, br NULLS LAST, chunk_ord) rank FROM x)
SELECT query_id, chunk_ord, rank::INT rank, round(rrf, 9) score, source_path, md5(coalesce(content, '')) h, coalesce(page, -1) page FROM z JOIN chunks USING (chunk_ord) WHERE rank <= 5"""


def _lead_hits(score: str, k: int = 5) -> str:
    return f"""
one AS (SELECT DISTINCT ON (query_id, chunk_ord) * EXCLUDE (content) FROM hits WHERE {score} IS NOT NULL ORDER BY query_id, chunk_ord, hit_id),
l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_ord) rank FROM one) WHERE rank <= {k}),
ld AS (SELECT l0.*, coalesce(c.content, '') AS content FROM l0 JOIN chunks c USING (chunk_ord))"""


def _excerpt(c: str) -> str:
    """At most 500 characters, cut after a word or after a hyphen between letters."""
    x = _strip(rf"regexp_replace({c}, '[{_SPACE}]+', ' ', 'g')")
    letter, punct = r"[\p{L}_]", "[\\p{L}\\p{N}_!\"''&.,?]"
    ends = (r"^(?s)(.{0,496}[^ ]) ", rf"^(?s)(.{{0,494}}{letter}{{2}}-){letter}-?{letter}", rf"^(?s)(.{{0,493}}{letter}-{punct}-){letter}-?{letter}")
    cuts = [f"regexp_extract({x}, '{e}', 1)" for e in ends]
    longest = f"list_reduce([{', '.join(cuts)}], lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
    return f"CASE WHEN length({x}) <= 500 THEN {x} ELSE {longest} || '...' END"


_LINE = f"'[score=' || printf('%.3f', score) || '] [' || doc_family || '] ' || source_path || chr(10) || {_excerpt('content')}"
_PASSAGES = f"ps AS (SELECT query_id, string_agg({_LINE}, chr(10) || chr(10) ORDER BY rank) AS passages FROM ld GROUP BY 1)"
_FULL = "doc_family, source_path, coalesce(content, '') AS content"


def _scored(t: str = "") -> str:
    return f"""gc{t} AS (SELECT g.*, lower(coalesce(passages, '')) lp, lower(coalesce(expected_answer_summary, '')) la FROM (SELECT * FROM golden WHERE id IN (SELECT query_id FROM q)) g LEFT JOIN ps{t} ON query_id = id),
gm{t} AS (SELECT *, list_filter(expected_articles, lambda x: NOT contains(lp, lower(x))) ma, list_filter(expected_keywords, lambda x: NOT contains(la, lower(x))) mk FROM gc{t}),
gs{t} AS (SELECT *, CASE WHEN len(expected_articles) > 0 THEN round_even((len(expected_articles) - len(ma))::DOUBLE / len(expected_articles), 4) ELSE 1.0 END rs,
  CASE WHEN len(expected_keywords) > 0 THEN round_even((len(expected_keywords) - len(mk))::DOUBLE / len(expected_keywords), 4) ELSE 1.0 END ans FROM gm{t})"""


_PLAIN = "ld AS (SELECT * FROM (SELECT query_id, chunk_ord, rrf AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, br NULLS LAST, chunk_ord) AS rank FROM x) JOIN (SELECT chunk_ord, " + _FULL + " FROM chunks) USING (chunk_ord) WHERE rank <= 5)"
_CASES = f"{_INDEX},{_ASKED},{_legs('q', 'num', 5)},{_PLAIN},{_PASSAGES},{_scored()}"


def _weighted(alpha: float, t: str) -> str:
    """ps{t}: passages of the weighted search, from xa, xb and xc."""
    return f"""u{t} AS (SELECT query_id, chunk_ord, sum(p) s FROM (SELECT query_id, chunk_ord, {alpha}::DOUBLE * rrf p FROM xa UNION ALL SELECT query_id, chunk_ord, (1 - {alpha}::DOUBLE) * rrf FROM xb) GROUP BY ALL),
z{t} AS (SELECT query_id, chunk_ord, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_ord) rank FROM u{t}
 UNION ALL SELECT query_id, chunk_ord, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, br NULLS LAST, chunk_ord) FROM xc),
ld{t} AS (SELECT z.*, s AS score, {_FULL} FROM z{t} z JOIN chunks USING (chunk_ord) WHERE rank <= 5),
{_PASSAGES.replace('ps AS', f'ps{t} AS').replace('FROM ld', f'FROM ld{t}')}"""


_PARTED = f"""
q1 AS (SELECT * FROM q WHERE len(expected_keywords) > 0), q2 AS (SELECT query_id, array_to_string(expected_keywords, ' ') AS text, num FROM q1), q3 AS (SELECT * FROM q WHERE coalesce(len(expected_keywords), 0) = 0),
{_legs('q1', 'num', 5, '', 'a')},{_legs('q2', 'num', 5, '', 'b')},{_legs('q3', 'num', 5, '', 'c')}"""

_LAST = "ls AS (SELECT source_path, max(size_bytes) size_bytes, max(modified_time) modified_time FROM listing WHERE run_id = (SELECT max(run_id) FROM listing) GROUP BY 1)"
_PLAN = _LAST + """, cc AS (SELECT source_path, count(*) n FROM chunks GROUP BY 1),
pl AS (SELECT ls.source_path, coalesce(n, 0)::BIGINT stored_chunks, ls.size_bytes = m.size_bytes AND ls.modified_time = m.modified_time AND coalesce(n, 0) = m.chunk_count AS same
  FROM ls LEFT JOIN manifest m USING (source_path) LEFT JOIN cc USING (source_path))"""

_CLEAN = rf"""array_to_string(list_transform(string_split(regexp_replace({{}}, '\r\n?', chr(10), 'g'), chr(10)), lambda l: {_strip("regexp_replace(l, '[ " + chr(92) + "t]+', ' ', 'g')")}), chr(10))"""


def _clean(c: str) -> str:
    bullets = rf"regexp_replace({c}, '[\x{{F000}}-\x{{F0FF}}]', '• ', 'g')"
    return _strip(rf"regexp_replace({_CLEAN.replace("{}", bullets)}, '\n{{3,}}', chr(10) || chr(10), 'g')")


_DIRTY = r"'  ' || chr(61623) || replace(coalesce(content, ''), ' ', ' ' || chr(9) || ' ') || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(13) || ' x'"

_TABLE_ROW = r"regexp_matches(content, '(?:^|[^\p{L}\p{N}_])(?:LS|BRS)[\s]+[0-9]{2,3}-[0-9]{2,3}(?:[^\p{L}\p{N}_]|$)')"
_ADDRESS_ROW = r"regexp_matches(content, '(?m)^[\s]*[0-9]{1,2}(?:er|e)?[\s]+.{0,40}?(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Ii]mpasse|[Qq]uai|[Aa]llée|[Ss]quare|[Vv]illa|[Vv]oie|[Cc]ité|[Pp]assage)(?:[^\p{L}\p{N}_]|$)')"

# Annexe headers, some of them over a page's end, and references in brackets, put into the pages.
_PUT_ANNEXES = """(CASE WHEN page_num % 5 = 2 THEN 'Annexe VI des lieux ' ELSE '' END || text || CASE WHEN page_num % 5 = 1 THEN ' (voir (' WHEN page_num % 3 = 0 THEN chr(10) || 'A NNEXE IV :' WHEN page_num % 7 = 4 THEN chr(10) || 'ANNEXE X : ' || repeat('Liste des terrains ', 9) ELSE '' END)"""


def _made(text: str) -> str:
    """q: chunks with idx, page, section and content after the quality filter; d: the first of each content."""
    return f"""WITH cp AS (SELECT source_path, page_num, text FROM (SELECT source_path, page_num, {_clean(text)} AS text FROM doc_pages) WHERE text <> ''),
{_LAYOUT.replace('FROM doc_pages', 'FROM cp')}, fa AS (SELECT source_path, t, {_FAMILY} AS fam FROM f),
{_HEADS.replace(_LAYOUT, '').lstrip().lstrip(',').replace('FROM f)', "FROM fa WHERE fam = 'reglement_ecrit')")},
{_ANNEXES.replace('FROM f)', "FROM fa WHERE fam = 'reglement_ecrit')")},
a AS (SELECT source_path, pos, piece, code FROM hs UNION ALL SELECT source_path, 0, t, NULL FROM fa WHERE fam = 'reglement_ecrit' AND source_path NOT IN (SELECT source_path FROM hs)),
w AS (SELECT source_path, pos AS ap, code, pos + s AS s, substring(piece, s + 1, 1200) raw FROM (SELECT *, unnest(range(0, length(piece), 1200)) s FROM a)
 UNION ALL SELECT source_path, NULL, NULL, s, substring(t, s + 1, 1200) FROM (SELECT source_path, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1000.0))::BIGINT * 1000 + 1, 1000)) s FROM fa WHERE fam <> 'reglement_ecrit')),
c AS (SELECT source_path, ap, code, s, s + {_lead('raw')} off, {_strip('raw')} x FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY s) - 1 AS idx FROM c WHERE x <> ''),
g AS (SELECT n.*, page_num, an.pos AS npos, CASE WHEN length(title) > 100 THEN substring(title, 1, 97) || '...' ELSE title END AS nt
 FROM n ASOF JOIN p ON n.source_path = p.source_path AND n.off >= p.start ASOF LEFT JOIN an ON n.source_path = an.source_path AND n.off >= an.pos),
k AS (SELECT source_path, idx, page_num, CASE WHEN npos > coalesce(CASE WHEN code IS NULL THEN -1 ELSE ap END, -1) AND ap IS NOT NULL THEN nt ELSE code END AS section,
 CASE WHEN npos > coalesce(CASE WHEN code IS NULL THEN -1 ELSE ap END, -1) AND ap IS NOT NULL THEN '[Section: ' || nt || ']' || chr(10) || x ELSE x END AS content FROM g),
q AS (SELECT * FROM k WHERE CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(content) ELSE 0 END >= 0.55 OR {_TABLE_ROW} OR {_ADDRESS_ROW}),
d AS (SELECT *, {_STEM} || '-' || idx AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY source_path, idx) AS r FROM q) WHERE r = 1)"""


def _corpus(text: str) -> str:
    return _made(text) + f"""
SELECT (row_number() OVER (ORDER BY source_path, chunk_id) - 1)::BIGINT AS chunk_ord, chunk_id, source_path, {_FAMILY} AS doc_family, page_num AS page, section, md5(content) AS h FROM d"""


ORACLE = {
    "family_inference": f"SELECT DISTINCT source_path, {_FAMILY} AS family FROM chunks WHERE source_path IS NOT NULL",
    "family_counts": "SELECT doc_family, count(*) n FROM chunks GROUP BY 1",
    "listing_limit": "SELECT DISTINCT source_path FROM listing ORDER BY 1 LIMIT 25",
    "text_normalize": f"SELECT chunk_ord, md5({_clean(_DIRTY)}) h FROM chunks",
    "page_drop": f"SELECT page_id, page_num, length(x)::BIGINT n FROM (SELECT page_id, page_num, {_clean('text')} x FROM doc_pages) WHERE x <> ''",
    "page_offsets": f"WITH {_LAYOUT} SELECT source_path, page_num, start, n::BIGINT n FROM p",
    "alpha_ratio": r"SELECT chunk_ord, round(CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\p{L}]', '', 'g'))::DOUBLE / length(content) ELSE 0 END, 9) ratio FROM chunks WHERE content IS NOT NULL",
    "quality_filter": f"""WITH w AS (SELECT chunk_ord, CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(content) ELSE 0 END r,
 {_TABLE_ROW} table_row, {_ADDRESS_ROW} address_row FROM chunks WHERE content IS NOT NULL) SELECT chunk_ord, table_row, address_row FROM w WHERE r >= 0.55 OR table_row OR address_row""",
    "chunk_ids": f"SELECT chunk_ord, {_STEM} || '-' || (row_number() OVER (PARTITION BY source_path ORDER BY chunk_ord) - 1) chunk_id FROM chunks WHERE source_path IS NOT NULL",
    "inspect_chunks": f"SELECT chunk_ord, chunk_id, substring(content, 1, 300) head FROM chunks WHERE {_BASE} = 'reglement_general_valmorane.pdf'",
    "window_chunks": f"""WITH {_LAYOUT}, w AS (SELECT source_path, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1000.0))::BIGINT * 1000 + 1, 1000)) s FROM f),
r AS (SELECT source_path, s, substring(t, s + 1, 1200) raw FROM w), c AS (SELECT source_path, s + {_lead('raw')} off, {_strip('raw')} x FROM r)
SELECT c.source_path, c.off, md5(x) h, page_num::INT page FROM c ASOF JOIN p ON c.source_path = p.source_path AND c.off >= p.start WHERE x <> ''""",
    "fixed_chunks": f"""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 1200)) s FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, s, substring(text, s + 1, 1200) raw FROM w), c AS (SELECT doc_id, s + {_lead('raw')} off, {_strip('raw')} x FROM r)
SELECT doc_id, off, md5(x) h FROM c WHERE x <> ''""",
    "article_codes": f"WITH {_HEADS} SELECT source_path, pos, code FROM hs",
    "article_chunks": f"""WITH {_HEADS},
a AS (SELECT source_path, pos, piece, code FROM hs UNION ALL SELECT source_path, 0, t, NULL FROM f WHERE source_path NOT IN (SELECT source_path FROM hs)),
w AS (SELECT source_path, code, pos + s AS s, substring(piece, s + 1, 1200) raw FROM (SELECT *, unnest(range(0, length(piece), 1200)) s FROM a)),
c AS (SELECT source_path, code, s + {_lead('raw')} off, {_strip('raw')} x FROM w)
SELECT c.source_path, c.off, code, md5(x) h, page_num::INT page FROM c ASOF JOIN p ON c.source_path = p.source_path AND c.off >= p.start WHERE x <> ''""",
    "annexe_headers": f"WITH cp AS (SELECT source_path, page_num, {_PUT_ANNEXES} AS text FROM doc_pages WHERE text <> ''), {_LAYOUT.replace('FROM doc_pages', 'FROM cp')}, {_ANNEXES} SELECT source_path, pos, title FROM an",
    "corpus_chunks": _corpus("text"),
    "annexe_chunks": _corpus(_PUT_ANNEXES),
    "build_chunks": _corpus("text"),
    "build_manifest": _made("text") + """
SELECT p0.source_path, p0.size_bytes::BIGINT AS size_bytes, 1.0::DOUBLE AS modified_time, coalesce(n, 0)::BIGINT AS chunk_count
FROM (SELECT source_path, sum(length(text)) AS size_bytes FROM cp WHERE source_path IS NOT NULL GROUP BY 1) p0 LEFT JOIN (SELECT source_path, count(*) AS n FROM q GROUP BY 1) c USING (source_path)""",
    "build_ledger": f"SELECT source_path, 'done' AS state, sum(length(x))::BIGINT AS done_size FROM (SELECT source_path, {_clean('text')} x FROM doc_pages WHERE source_path IS NOT NULL) WHERE x <> '' GROUP BY 1",
    "stored_search": f"WITH {_INDEX},{_ASKED},{_legs('q', 'num', 5)},{_BEST}",
    "patched_families": """WITH n AS (SELECT doc_family AS before, CASE WHEN contains(nfc_normalize(source_path), 'Annexes') THEN 'annexes' WHEN contains(nfc_normalize(source_path), 'pdf') THEN 'files' ELSE 'other' END AS after FROM chunks WHERE source_path IS NOT NULL),
f AS (SELECT before AS doc_family FROM n UNION SELECT after FROM n)
SELECT doc_family, (SELECT count(*) FROM n WHERE before = doc_family) AS before, (SELECT count(*) FROM n WHERE after = doc_family) AS after FROM f""",
    "dedup_chunks": "SELECT chunk_ord FROM (SELECT chunk_ord, row_number() OVER (PARTITION BY content ORDER BY source_path, chunk_ord) r FROM chunks) WHERE r = 1",
    "corpus_ordinal": "SELECT source_path, chunk_id, row_number() OVER (ORDER BY source_path COLLATE C, chunk_id COLLATE C) - 1 ordinal FROM (SELECT DISTINCT source_path, chunk_id FROM chunks WHERE source_path IS NOT NULL)".replace(" COLLATE C", ""),
    "section_prefix": """WITH t AS (SELECT chunk_ord, content, CASE WHEN chunk_ord % 2 = 0 THEN section || ' : ' || repeat(section, 20) ELSE section END t FROM chunks WHERE section IS NOT NULL AND content IS NOT NULL),
s AS (SELECT chunk_ord, content, CASE WHEN length(t) > 100 THEN substring(t, 1, 97) || '...' ELSE t END short FROM t) SELECT chunk_ord, short, md5('[Section: ' || short || ']' || chr(10) || content) h FROM s""",
    "cache_plan": f"WITH {_PLAN} SELECT source_path, stored_chunks, false AS forced, coalesce(same, false) AS cached FROM pl",
    "rebuild_plan": f"WITH {_PLAN}, g AS (SELECT *, {_FAMILY} = 'annexes' AS forced FROM pl) SELECT source_path, stored_chunks, forced, NOT forced AND coalesce(same, false) AS cached FROM g",
    "files_to_process": f"WITH {_LAST} SELECT source_path FROM ls WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.source_path = ls.source_path AND m.size_bytes = ls.size_bytes AND m.modified_time = ls.modified_time)",
    "chunk_counts": f"WITH {_LAST}, cc AS (SELECT source_path, count(*) n FROM chunks GROUP BY 1) SELECT source_path, coalesce(n, 0)::BIGINT n FROM ls LEFT JOIN cc USING (source_path)",
    "union_cached_processed": f"""WITH {_PLAN}, u AS (SELECT source_path, 'cached' origin FROM chunks WHERE source_path IN (SELECT source_path FROM pl WHERE same)
UNION ALL SELECT source_path, 'processed' FROM doc_pages WHERE source_path IN (SELECT source_path FROM pl WHERE NOT coalesce(same, false)))
SELECT origin, count(*) n, count(DISTINCT source_path) files FROM u GROUP BY 1""",
    "term_frequency": f"WITH {_INDEX} SELECT chunk_ord, term, tf FROM po",
    "document_frequency": f"WITH {_INDEX} SELECT term, df, round(idf, 6) idf FROM ts",
    "doc_length": f"WITH {_INDEX} SELECT * FROM dl",
    "corpus_stats": f"WITH {_INDEX} SELECT n, round(avgdl, 6) avgdl FROM st",
    "bm25_scores": f"WITH {_INDEX},{_ASKED},{_bm25('q')} SELECT query_id, chunk_ord, round(s, 6) bm25_score FROM sc",
    "bm25_topk": f"""WITH {_INDEX},{_ASKED},{_bm25('q')},
r AS (SELECT q.query_id, c.chunk_ord, coalesce(s, 0.0) s, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(s, 0.0), 9) DESC, c.chunk_ord DESC) br
 FROM q CROSS JOIN (SELECT chunk_ord FROM chunks) c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_ord = c.chunk_ord)
SELECT query_id, chunk_ord, round(s, 6) bm25_score, br::INT bm25_rank FROM r WHERE br <= 10""",
    "vector_normalize": "SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), embedding::DOUBLE[]), 5) cosine FROM embeddings",
    "dense_topk": """WITH s AS (SELECT q.vec_id query_id, e.vec_id chunk_ord, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, chunk_ord) k FROM s) SELECT query_id, chunk_ord, round(d, 6) dense_score, k::INT dense_rank FROM r WHERE k <= 10""",
    "hybrid_search": f"WITH {_INDEX},{_ASKED},{_legs('q', 'num', 5)},{_BEST}",
    "hybrid_search_family": f"WITH {_INDEX},{_ASKED},{_legs('q', 'num', 5, chr(39) + 'annexes' + chr(39) + ',' + chr(39) + 'padd' + chr(39))},{_BEST}",
    "hybrid_search_debug": f"WITH {_INDEX},{_ASKED},{_legs('q', 'num', 5)},{_BEST}".replace("SELECT query_id, chunk_ord, rank::INT rank, round(rrf, 9) score, source_path, md5(coalesce(content, '')) h, coalesce(page, -1) page FROM z", "SELECT query_id, rank::INT rank, coalesce(round(ds, 6), -1) dense_score, coalesce(round(bs, 6), -1) bm25_score, coalesce(dr, -1)::INT dense_rank, coalesce(br, -1)::INT bm25_rank FROM z"),
    "weighted_search": f"""WITH {_INDEX},{_ASKED},{_PARTED},
u AS (SELECT query_id, chunk_ord, sum(p) s FROM (SELECT query_id, chunk_ord, 0.7::DOUBLE * rrf p FROM xa UNION ALL SELECT query_id, chunk_ord, (1 - 0.7::DOUBLE) * rrf FROM xb) GROUP BY ALL),
z AS (SELECT query_id, chunk_ord, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_ord) rank FROM u
 UNION ALL SELECT query_id, chunk_ord, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, br NULLS LAST, chunk_ord) FROM xc)
SELECT query_id, chunk_ord, rank::INT rank, round(s, 9) score, source_path, md5(coalesce(content, '')) h, coalesce(page, -1) page FROM z JOIN chunks USING (chunk_ord) WHERE rank <= 5""",
    "hit_passages": f"WITH {_lead_hits('score')},{_PASSAGES} SELECT query_id, md5(passages) h FROM ps",
    "prompt_context": f"WITH {_lead_hits('score')} SELECT query_id, md5('Question: ' || any_value(question) || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('Source: ' || {_BASE} || chr(10) || 'Content: ' || substring(content, 1, 3000), chr(10) || chr(10) ORDER BY rank)) h FROM ld JOIN golden ON id = query_id GROUP BY 1",
    "citation_rows": f"WITH {_lead_hits('score')} SELECT query_id, rank::INT rank, {_BASE} AS source, source_path AS full_path, doc_family AS family, md5({_excerpt('content')}) AS excerpt, coalesce(page, -1) AS page, section FROM ld",
    "debug_rows": f"WITH {_lead_hits('score')} SELECT query_id, rank::INT rank, concat_ws(' | ', {_BASE}, doc_family, coalesce(printf('%.4f', faiss_score), 'n/a'), coalesce(printf('%.4f', bm25_score), 'n/a'), printf('%.5f', score), coalesce(page::VARCHAR, 'n/a'), coalesce(section, 'n/a'), substring(content, 1, 200)) line FROM ld",
    "excerpts": f"SELECT doc_id, {_excerpt('text')} AS excerpt FROM documents WHERE text IS NOT NULL",
    "output_parts": f"""WITH {_lead_hits('score')},{_PASSAGES}
SELECT id, md5({_strip('passages')}) AS passages, CASE WHEN length(question) % 4 IN (0, 1) THEN {_strip("coalesce(expected_answer_summary, '')")} ELSE '' END AS answer,
 CASE WHEN length(question) % 4 = 1 THEN {_strip("coalesce(array_to_string(expected_keywords, ' '), '')")} ELSE '' END AS expansion,
 CASE WHEN length(question) % 4 = 1 THEN coalesce(array_to_string(list_filter(expected_keywords, lambda x: trim(x) <> ''), '|'), '') ELSE '' END AS codes FROM golden JOIN ps ON query_id = id""",
    "markdown_strip": r"""WITH d AS (SELECT doc_id, '**' || lang || '** *x*' || chr(10) || ' - ' || text || chr(10) || '* C:\docs\plu\REG1.pdf *fin' t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '(?m)^[ \t]*[*\-][ \t]+', '• ', 'g'), '[A-Za-z]:\\(?:[^\\<>:"/|?*\n]+\\)+([^\\<>:"/|?*\n]+)', '\1', 'g')) h FROM d""",
    "expansion_parse": "SELECT id, CASE WHEN length(question) % 3 = 0 THEN '' ELSE array_to_string(list_filter(expected_articles, lambda x: trim(x) <> ''), '|') END codes FROM golden",
    "golden_scores": f"WITH {_CASES} SELECT id, rs retrieval_score, ans answer_score, array_to_string(ma, '|') missing_articles, array_to_string(mk, '|') missing_keywords FROM gs",
    "eval_summary": f"WITH {_CASES} SELECT lower(complexity) complexity, count(*) n, round(avg(rs), 6) retrieval, round(avg(ans), 6) answer FROM gs GROUP BY 1",
    "eval_compare": f"""WITH {_CASES.replace(_ASKED, _ALL_ASKED)},{_PARTED},{_weighted(0.7, '7')},{_scored('7')},{_weighted(0.5, '5')},{_scored('5')},
u AS (SELECT 'plain' run, id, rs, 0.0::DOUBLE d FROM gs UNION ALL SELECT 'alpha=0.7', id, gs7.rs, round(gs7.rs - gs.rs, 6) FROM gs JOIN gs7 USING (id) UNION ALL SELECT 'alpha=0.5', id, gs5.rs, round(gs5.rs - gs.rs, 6) FROM gs JOIN gs5 USING (id))
SELECT run, id, rs AS retrieval_score, d AS delta, CASE WHEN d > 0 THEN '↑' WHEN d < 0 THEN '↓' ELSE '=' END arrow FROM u""",
    "score_bands": f"WITH {_CASES} SELECT id, CASE WHEN ans >= 0.8 THEN 'green' WHEN ans >= 0.5 THEN 'yellow' ELSE 'red' END band, repeat('█', round_even(ans * 8, 0)::INT) || repeat('░', 8 - round_even(ans * 8, 0)::INT) bar, CASE WHEN length(question) > 51 THEN substring(question, 1, 50) || '…' ELSE question END short FROM gs",
    "prefix_sizes": "SELECT hit_id, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM hits",
}
