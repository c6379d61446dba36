"""DuckDB statements for the queries that plain SQL can say over whole tables."""

from __future__ import annotations

from lexmill.functions import prep
from lexmill.functions import text as T
from lexmill.operators import graph, relations, reply
from lexmill.operators.ranking import FEATURES, Weights

_W = "[ \\t\\n\\r\\f\\x0B]"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WORD = "[a-z0-9][a-z0-9\\-]*"
_S = "s AS (SELECT pos, max(source) AS source, max(sent_idx) AS sent_idx, max(text) AS text, max(char_offset) AS char_offset, max(section) AS section, max(is_prose) AS is_prose FROM sentences GROUP BY pos)"
_Q = "q AS (SELECT qid, max(question) AS question, max(budget) AS budget FROM questions GROUP BY qid HAVING max(question) IS NOT NULL)"
_F = "f AS (SELECT qid, pos, max(lex_scores) AS lex_scores, max(bm25) AS bm25, max(dense_cos) AS dense_cos, max(dense_available) AS dense_available, max(rel_pos) AS rel_pos, max(prov_flags) AS prov_flags FROM features GROUP BY qid, pos)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _one_line(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_W}+', ' ', 'g')")


def _singular(w: str) -> str:
    return f"CASE WHEN length({w}) <= 3 OR NOT ends_with({w}, 's') THEN {w} WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN {w}[:length({w}) - 3] || 'y' WHEN regexp_matches({w}, '(ches|shes|sses|xes|zes)$') THEN {w}[:length({w}) - 2] WHEN ends_with({w}, 'ss') THEN {w} ELSE {w}[:length({w}) - 1] END"


def _tokens(x: str) -> str:
    return f"list_filter(list_transform(list_filter(regexp_extract_all(lower({x}), '{_WORD}'), lambda w: w NOT IN ({_STOP})), lambda w: {_singular('w')}), lambda w: w NOT IN ({_STOP}))"


def _bigrams(t: str) -> str:
    return f"CASE WHEN len({t}) > 1 THEN list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]) ELSE []::VARCHAR[] END"


def _shown(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE array_to_string(string_split({x}, ' › ')[-2:], ' › ') END"


def _unheaded(text: str, shown: str) -> str:
    """The text without heading lines at its beginning that `shown` names."""
    lines = f"string_split(regexp_replace({text}, '^\\s+', ''), chr(10))"
    title = lambda x: _one_line(f"regexp_replace(regexp_replace({x}, '^\\s*#+', ''), '[\\[\\]*`_]', '', 'g')")
    stays = f"list_filter(list_transform({lines}, lambda x, i: CASE WHEN {_strip('x')} = '' OR list_contains(string_split({shown}, '{T.SECTION_SEP}'), {title('x')}) THEN NULL ELSE i - 1 END), lambda i: i IS NOT NULL)"
    n = f"(len({lines}) - 1)"
    begin = f"least(coalesce({stays}[1], {n}), CASE WHEN {lines}[-1] = '' THEN greatest({n} - 1, 0) ELSE {n} END)"
    return f"CASE WHEN {shown} IS NULL OR {shown} = '' THEN {text} ELSE (SELECT CASE WHEN z.b = 0 THEN {text} ELSE array_to_string(({lines})[z.b + 1:], chr(10)) END FROM (SELECT {begin} AS b) z) END"


def _compact(source: str, text: str, shown: str) -> str:
    return f"'[' || CASE WHEN {shown} <> '' THEN {source} || ' § ' || {shown} ELSE {source} END || '] ' || {_one_line('(' + _unheaded(text, shown) + ')')}"


_QUANTITY = "|".join(T.QUANTITY)
_CODE = "|".join(T.CODE_NAMES)
_SUFFIX = ", ".join(f"'{x}'" for x in T.PROSE_SUFFIXES)
_NTOK = "greatest(1, length({0}) // 4)"

_EDGES = """e AS (
SELECT l_orderkey * 10 + l_linenumber AS id, n_name AS s, CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'buys' END AS r, p_brand AS o,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'buys' END AS r_lex, c_mktsegment AS source, l_linenumber AS sent_idx
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
_DEGREE = "dg AS (SELECT entity, count(*) AS degree, min(k) AS first_seen FROM (SELECT s AS entity, id * 2 AS k FROM e UNION ALL SELECT o, id * 2 + 1 FROM e) GROUP BY entity)"
_PPMI = """pc AS (SELECT least(s, o) AS u, greatest(s, o) AS v, count(*) AS n FROM e GROUP BY 1, 2),
ec AS (SELECT x, count(*) AS c FROM (SELECT s AS x FROM e UNION ALL SELECT o FROM e) GROUP BY x),
tt AS (SELECT count(*)::DOUBLE AS np FROM e),
pw AS (SELECT u, v, n, ln((n / np) / ((a.c / (2 * np)) * (b.c / (2 * np)))) AS weight FROM pc JOIN ec a ON a.x = u JOIN ec b ON b.x = v, tt WHERE u <> v),
w AS (SELECT * FROM pw WHERE weight > 0)"""
_MEMBER = """mb AS (SELECT n_name AS entity, 'g' || r_regionkey AS community FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT p_brand, 'g' || p_brand[7:7] FROM part)"""

_TOK = f"""{_S}, {_Q},
st AS (SELECT pos, source, sent_idx, text, is_prose, {_tokens('text')} AS toks FROM s WHERE text IS NOT NULL),
qt AS (SELECT qid, question, budget, {_tokens('question')} AS toks FROM q),
post AS (SELECT pos, token, count(*) AS tf, max(n) AS len FROM (SELECT pos, len(toks) AS n, unnest(toks) AS token FROM st) GROUP BY pos, token),
nn AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM st),
vocab AS (SELECT token, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM post, nn GROUP BY token),
qq AS (SELECT DISTINCT qid, unnest(toks) AS token FROM qt),
qi AS (SELECT qid, token, coalesce(idf, ln(n + 1) + 1) AS idf, df IS NOT NULL AS known FROM qq LEFT JOIN vocab USING (token), nn),
qm AS (SELECT *, sum(idf) OVER (PARTITION BY qid) AS mass FROM qi)"""


def _scores(avgdl: str) -> str:
    return f"sc AS (SELECT qid, pos, round(sum(idf) / max(mass), 9) AS lex, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / {avgdl}))), 9) AS bm25 FROM qm JOIN post USING (token), nn GROUP BY qid, pos)"


_SHORT = f"""{_TOK}, {_scores(repr(Weights().avgdl))},
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, pos) AS rank FROM sc WHERE lex > 0),
sh AS (SELECT rk.* FROM rk JOIN q USING (qid) WHERE rank <= greatest(60, coalesce(budget, 600) // 10))"""
_FEATURES = f"""{_SHORT},
last AS (SELECT source, max(sent_idx) AS last FROM s GROUP BY source),
j AS (SELECT sh.qid, sh.pos, rank, lex, bm25, list_distinct(qt.toks) AS qtk, list_distinct({_bigrams('qt.toks')}) AS qbi, st.toks AS toks, st.text AS text,
  regexp_matches({_one_line('lower(question)')}, '{_QUANTITY}') AS quantity, st.sent_idx / greatest(last.last, 1) AS rp
  FROM sh JOIN qt USING (qid) JOIN st USING (pos) JOIN last USING (source)),
ft AS (SELECT qid, pos, rank, CASE WHEN max(lex) OVER w > 0 THEN lex / max(lex) OVER w ELSE 0.0 END AS lex_norm, 1.0 / rank AS lex_rank,
  CASE WHEN max(bm25) OVER w > 0 THEN bm25 / max(bm25) OVER w ELSE 0.0 END AS bm25_norm,
  CASE WHEN len(qtk) > 0 THEN len(list_intersect(qtk, toks)) / len(qtk) ELSE 0.0 END AS q_token_cov,
  CASE WHEN len(qbi) > 0 THEN len(list_intersect(qbi, {_bigrams('toks')})) / len(qbi) ELSE 0.0 END AS q_bigram_cov,
  0.0::DOUBLE AS ent_hits, 0.0::DOUBLE AS provenance, 0.0::DOUBLE AS dense_cos, 1.0::DOUBLE AS dense_missing, ln(greatest(len(toks), 1)) - ln(25.0) AS len_log, rp::DOUBLE AS rel_pos,
  CASE WHEN quantity AND regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END::DOUBLE AS numeric_match FROM j WINDOW w AS (PARTITION BY qid))"""


def _logit() -> str:
    w = Weights()
    return " + ".join([repr(w.b), *[f"({n} - {m!r}) / {s!r} * {k!r}" for n, m, s, k in zip(FEATURES, w.mean, w.std, w.w) if k]])


_SEC = "text"
for _p in prep.SECRETS:
    _SEC = f"regexp_replace({_SEC}, '{_p}', '<SECRET>', 'g')" if _SEC != "text" else f"regexp_replace(regexp_replace(text, '{prep.EMAIL}', '<EMAIL>', 'g'), '{_p}', '<SECRET>', 'g')"
_SP = "\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _share(p: str) -> str:
    return f"round(CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '{p}', '', 'g'))) / length(text) ELSE 0.0 END, 6)"


_NUM = "-?\\d+(?:[.,]\\d+)?"
_HYP = "regexp_replace(text, '[1-4]', '9', 'g')"
_CALLS = "c AS (SELECT doc_id, regexp_extract(text, '(?s)CALL (\\{.*?\\})\\n', 1) AS call FROM documents WHERE modality = 'toolcall')"


_HEAD = "^(#{1,6})[ \\t]+(.+?)[ \\t]*#*[ \\t]*$"


def _split(where: str) -> str:
    """Sentences of documents with their places: pieces after . ! ? and white space, joined behind abbreviations."""
    return f"""raw AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])({_W})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL AND {where}),
pc AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM raw),
po AS (SELECT doc_id, k, x, {_strip('x')} AS body, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pc),
pb AS (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM po WHERE body <> ''),
pg AS (SELECT *, sum(CASE WHEN prev IS NULL OR NOT regexp_matches(prev, '{T.ABBREVIATION_END}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM pb),
pm AS (SELECT doc_id, g, min(off + length(x) - length(regexp_replace(x, '^{_W}+', ''))) AS start, max(off + length(regexp_replace(x, '{_W}+$', ''))) AS stop FROM pg GROUP BY doc_id, g),
sp AS (SELECT doc_id, (g - 1)::INT AS i, start::INT AS start, substr(text, start::INT + 1, (stop - start)::INT) AS piece FROM pm JOIN documents USING (doc_id))"""


_HEADS = f"""ln AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE modality = 'prose' AND contains(text, '#')),
la AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM ln),
lb AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pl, regexp_matches(line, '^[ \\t]*(```|~~~)') AS fence FROM la),
lc AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS open, regexp_replace(line, '\\r+$', '') AS bare FROM lb),
ld AS (SELECT doc_id, pl, length(regexp_extract(bare, '{_HEAD}', 1))::INT AS level, substr({_one_line(f"regexp_replace(regexp_extract(bare, '{_HEAD}', 2), '[\\[\\]*`_]', '', 'g')")}, 1, 40) AS title FROM lc WHERE NOT open AND NOT fence AND regexp_matches(bare, '{_HEAD}')),
hd AS (SELECT doc_id, pl, level, title FROM (SELECT *, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id) AS titles FROM ld WHERE title <> '') WHERE level > 1 OR titles <> 1)"""
_LAST = ", ".join(f"last_value(CASE WHEN level = {k} THEN {x} END IGNORE NULLS) OVER w AS {y}{k}" for k in range(1, 7) for x, y in (("place", "a"), ("title", "t")))
_PATH = ", ".join(f"CASE WHEN a{k} > greatest(-1{''.join(f', coalesce(a{j}, -1)' for j in range(1, k))}) THEN t{k} END" for k in range(1, 7))
_FORMS = f"CASE WHEN length(word) <= 3 OR NOT ends_with(word, 's') OR ends_with(word, 'ss') THEN [word] ELSE list_concat([word], list_filter([{_singular('word')}, word[:length(word) - 1], CASE WHEN ends_with(word, 'es') THEN word[:length(word) - 2] ELSE '' END], lambda x: length(x) > 1)) END"
_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC)
_NO_LABEL = ", ".join(f"'{w}'" for w in prep.NO_LABEL)
_SIG = lambda x: f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


def _items(x: str) -> str:
    """The name and the arguments of a call as key=value, each once."""
    return f"CASE WHEN json_valid({x}) THEN CASE WHEN json_extract_string({x}, '$.name') IS NOT NULL THEN list_distinct(list_concat(['name=' || json_extract_string({x}, '$.name')], list_transform(coalesce(json_keys({x}, '$.arguments'), []), lambda k: 'arg:' || k || '=' || coalesce(json_extract_string({x}, '$.arguments.\"' || k || '\"'), 'null')))) END END"


_PACKED = f"""{_S}, {_Q}, {_F},
d AS (SELECT f.qid, f.pos, s.text, {_compact('s.source', 's.text', _shown('s.section'))} AS line, coalesce(q.budget, 600) AS budget, row_number() OVER (PARTITION BY f.qid ORDER BY f.lex_scores DESC, f.pos) AS k
  FROM f JOIN s USING (pos) JOIN q USING (qid) WHERE NOT isnan(f.lex_scores) AND f.lex_scores > 0 AND s.text IS NOT NULL),
fold AS (SELECT DISTINCT qid, 0::BIGINT AS k, {len(reply.HEAD)}::BIGINT AS chars, 0 AS skips, 0 AS kept, FALSE AS taken, NULL::BIGINT AS pos, NULL::VARCHAR AS line, []::VARCHAR[] AS seen FROM d
  UNION ALL SELECT qid, k, CASE WHEN fits THEN chars + length(line) + 1 ELSE chars END, CASE WHEN dup THEN skips WHEN fits THEN 0 ELSE skips + 1 END, kept + fits::INT, fits, pos, line, CASE WHEN fits THEN list_append(seen, text) ELSE seen END
  FROM (SELECT d.qid, d.k, fold.chars, fold.skips, fold.kept, d.pos, d.line, d.text, fold.seen, list_contains(fold.seen, d.text) AS dup, NOT list_contains(fold.seen, d.text) AND greatest(1, (fold.chars + length(d.line) + 1) // 4) <= d.budget AS fits
    FROM fold JOIN d ON d.qid = fold.qid AND d.k = fold.k + 1 WHERE fold.skips < {reply.SKIPS})),
pk AS (SELECT qid, kept AS line_no, pos, line FROM fold WHERE taken)"""


ORACLE = {
    "doc_token_count": f"SELECT doc_id, {_NTOK.format('text')}::INT AS n FROM documents".replace("greatest(1, length(text) // 4)::INT", "greatest(1, coalesce(length(text) // 4, 1))::INT"),
    "doc_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "prose_files": f"SELECT source, CASE WHEN regexp_matches(b, '^({_CODE})') THEN FALSE ELSE x = '' OR x IN ({_SUFFIX}) END AS prose FROM (SELECT source, b, regexp_extract(b, '[^.]\\.([^.]+)$', 1) AS x FROM (SELECT DISTINCT source, lower(string_split(source, '/')[-1]) AS b FROM docs))",
    "sentence_pieces": f"WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_W}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, (i - 1)::INT AS i, p[i] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM a)",
    "line_split": f"WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a), c AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b) SELECT doc_id, {_strip('x')} AS line, (off + length(x) - length(regexp_replace(x, '^{_W}+', '')))::BIGINT AS start FROM c WHERE {_strip('x')} <> ''",
    "tokens_ascii": f"WITH {_S} SELECT pos, array_to_string({_tokens('text')}, ' ') AS toks FROM s",
    "token_bigrams": f"WITH {_S}, t AS (SELECT pos, {_tokens('text')} AS toks FROM s) SELECT pos, array_to_string({_bigrams('toks')}, '|') AS pairs FROM t",
    "singular_words": f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM documents), x AS (SELECT word, {_singular('word')} AS one, length(word) AS n FROM w), y AS (SELECT *, CASE WHEN n <= 3 OR NOT ends_with(word, 's') OR ends_with(word, 'ss') THEN [word] ELSE list_concat([word], list_filter([one, word[:n - 1], CASE WHEN ends_with(word, 'es') THEN word[:n - 2] ELSE '' END], lambda z: length(z) > 1)) END AS f FROM x) SELECT word, one, array_to_string(list_filter(f, lambda v, i: list_position(f, v) = i), ',') AS forms FROM y",
    "good_units": "SELECT modality, count(*) FILTER (WHERE length(text) BETWEEN 30 AND 256) AS good, count(*) AS n FROM documents GROUP BY modality",
    "shown_sections": f"WITH {_S} SELECT pos, {_shown('section')} AS shown FROM s",
    "code_search_terms": f"WITH {_S} SELECT pos, text || ' ' || regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g') || ' ' || regexp_replace(source, '[^A-Za-z0-9]+', ' ', 'g') AS terms FROM s WHERE NOT is_prose",
    "quantity_questions": f"WITH {_Q} SELECT qid, regexp_matches({_one_line('lower(question)')}, '{_QUANTITY}') AS quantity FROM q",
    "word_sets": f"WITH {_Q} SELECT qid, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))), ' ') AS words FROM q",
    "compact_lines": f"WITH {_S}, t AS (SELECT *, {_shown('section')} AS shown FROM s) SELECT pos, {_compact('source', 'text', 'shown')} AS line, source || ' s' || sent_idx || ': \"' || text || '\"' AS full_line FROM t",
    "text_entropy": f"WITH {_S}, c AS (SELECT pos, unnest(string_split(text, '')) AS c FROM s), n AS (SELECT pos, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY pos) AS t FROM c GROUP BY pos, c) SELECT pos, round(-sum(n / t * log2(n / t)), 6) AS bits FROM n GROUP BY pos",
    "vocab_idf": f"WITH {_TOK} SELECT token, df, round(idf, 6) AS idf FROM vocab",
    "mean_length": f"WITH {_TOK} SELECT round(avgdl, 6) AS avgdl FROM nn",
    "lexical_topk": f"WITH {_TOK}, {_scores('avgdl')}, r AS (SELECT qid, pos, lex, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, pos) AS rank FROM sc) SELECT qid, pos, round(lex, 6) AS score, rank FROM r WHERE rank <= 10",
    "bm25_topk": f"WITH {_TOK}, {_scores('avgdl')}, r AS (SELECT qid, pos, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, pos) AS rank FROM sc) SELECT qid, pos, round(bm25, 6) AS score, rank FROM r WHERE rank <= 10",
    "boosted_topk": f"WITH {_TOK}, {_scores('avgdl')}, {_F}, p AS (SELECT qid, pos FROM f WHERE prov_flags), b AS (SELECT coalesce(sc.qid, p.qid) AS qid, coalesce(sc.pos, p.pos) AS pos, round(coalesce(lex, 0) + CASE WHEN p.qid IS NULL THEN 0 ELSE 0.3 END, 9) AS x FROM sc FULL JOIN p ON sc.qid = p.qid AND sc.pos = p.pos), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, pos) AS rank FROM b) SELECT qid, pos, round(x, 6) AS score, rank FROM r WHERE rank <= 10",
    "shortlist": f"WITH {_SHORT} SELECT qid, pos, rank FROM sh",
    "candidate_features": f"WITH {_FEATURES} SELECT qid, pos, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM ft",
    "learned_rank": f"WITH {_FEATURES}, p AS (SELECT qid, pos, rank, 1 / (1 + exp(-({_logit()}))) AS p FROM ft), r AS (SELECT qid, pos, p, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, rank) AS place, max(p) OVER (PARTITION BY qid) AS conf FROM p) SELECT qid, pos, place, round(p, 6) AS p, round(conf, 6) AS conf FROM r WHERE place <= 10",
    "pulled_up": f"""WITH {_S}, {_F}, b AS (SELECT qid, pos, lex_scores AS score FROM f WHERE lex_scores IS NOT NULL AND NOT isnan(lex_scores)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS k FROM b WHERE score > 0) JOIN s USING (pos) WHERE k <= 2),
a AS (SELECT qid, source, sent_idx + d AS sent_idx, score * pow(0.9, d) AS lift FROM (SELECT *, unnest(range(1, CASE WHEN is_prose THEN 2 ELSE 3 END)) AS d FROM t)),
l AS (SELECT qid, s.pos, max(lift) AS lift FROM a JOIN s ON a.source = s.source AND a.sent_idx = s.sent_idx GROUP BY 1, 2)
SELECT coalesce(b.qid, l.qid) AS qid, coalesce(b.pos, l.pos) AS pos, round(greatest(coalesce(score, 0), coalesce(lift, 0)), 6) AS score FROM b FULL JOIN l ON b.qid = l.qid AND b.pos = l.pos""",
    "dense_scores": f"WITH {_F}, x AS (SELECT qid, pos, (greatest(-1.0, least(1.0, dense_cos)) + 1) / 2 + CASE WHEN prov_flags THEN 0.3 ELSE 0 END AS s FROM f WHERE dense_available AND dense_cos IS NOT NULL AND NOT isnan(dense_cos)) SELECT qid, pos, round(CASE WHEN s >= 0.6 THEN s + 1 ELSE 0 END, 6) AS score FROM x",
    "interleaved": f"WITH {_F}, x AS (SELECT qid, pos, coalesce(CASE WHEN NOT isnan(lex_scores) THEN lex_scores END, 0) AS a, coalesce(CASE WHEN NOT isnan(dense_cos) THEN dense_cos END, 0) AS b FROM f), r AS (SELECT *, CASE WHEN a > 0 THEN row_number() OVER (PARTITION BY qid ORDER BY a DESC, pos) - 1 ELSE count(*) OVER (PARTITION BY qid) END AS ra, row_number() OVER (PARTITION BY qid ORDER BY b DESC, pos) - 1 AS rb FROM x) SELECT qid, pos, round(1.0 / (1 + least(ra, rb)) + 1e-6 / (1 + greatest(ra, rb)), 9) AS score FROM r",
    "vector_confidence": f"WITH {_F}, x AS (SELECT qid, max(greatest(-1.0, least(1.0, dense_cos))) AS c FROM f WHERE dense_available AND dense_cos IS NOT NULL AND NOT isnan(dense_cos) GROUP BY qid) SELECT qid, round(least(0.29, 1 / (1 + exp(-(68.7 * (c - 0.8) + 1.6)))), 6) AS conf FROM x",
    "vocabulary_gate": f"WITH {_TOK} SELECT qid, count(*) FILTER (WHERE known) AS known, count(*) AS asked, count(*) FILTER (WHERE known) < 0.5 * count(*) AS vectors_alone FROM qm GROUP BY qid",
    "unit_check": "WITH v AS (SELECT pos, encoder, max(emb) AS e FROM sent_vectors GROUP BY pos, encoder), x AS (SELECT encoder, e, coalesce(len(e), -1) AS n, sqrt(list_sum(list_transform(e, lambda z: z::DOUBLE * z::DOUBLE))) AS m FROM v) SELECT encoder, count(*) AS n, count(*) FILTER (WHERE n <> 64) AS wrong_width, count(*) FILTER (WHERE n = 64 AND (isnan(m) OR NOT abs(m - 1) < 0.01)) AS off_unit FROM x GROUP BY encoder",
    "whole_corpus": f"WITH {_S}, t AS (SELECT *, {_shown('section')} AS shown FROM s), l AS (SELECT *, lag(shown) OVER (PARTITION BY source ORDER BY pos) AS prev FROM t) SELECT pos, CASE WHEN prev = shown THEN '[' || source || '] ' || {_one_line('text')} ELSE {_compact('source', 'text', 'shown')} END AS line FROM l",
    "search_all_words": f"WITH {_S}, t(term) AS (VALUES ('answer budget'), ('heading path'), ('Stop LIST'), ('data.csv'), ('no such words')), h AS (SELECT term, pos FROM s, t WHERE len(list_filter(string_split(lower(term), ' '), lambda w: NOT contains(lower(text), w))) = 0), r AS (SELECT term, pos, row_number() OVER (PARTITION BY term ORDER BY pos) AS place, count(*) OVER (PARTITION BY term) AS total FROM h) SELECT * FROM r WHERE place <= 8",
    "entity_degree": f"WITH {_EDGES}, {_DEGREE} SELECT * FROM dg",
    "top_entities": f"WITH {_EDGES}, {_DEGREE} SELECT entity, degree, row_number() OVER (ORDER BY degree DESC, first_seen) AS place FROM dg ORDER BY place LIMIT 10",
    "edge_groups": f"WITH {_EDGES}, g AS (SELECT s, r, o, list(id ORDER BY id) AS l FROM e GROUP BY s, r, o) SELECT s, r, o, array_to_string(l, ',') AS ids, CASE WHEN len(l) > 8 THEN array_to_string(l[:8], ',') || ' …' ELSE array_to_string(l, ',') END AS capped FROM g",
    "resolve_names": f"""WITH {_EDGES}, {_DEGREE}, n(name, asked, lvl) AS (SELECT x, x, 0 FROM (VALUES ('Brand#11'), (' brand#12 '), ('BRAND#1'), ('nation_3'), ('rand#2'), ('x'), ('brand#13s'), ('nothing like it'), ('')) t(x) UNION ALL SELECT x, lower(trim(x))[:-2], 1 FROM (VALUES ('brand#13s')) t(x)),
h AS (SELECT name, entity, degree, first_seen, lvl, CASE WHEN entity = trim(asked) THEN 0 WHEN entity = lower(trim(asked)) THEN 1 WHEN lower(entity) = lower(trim(asked)) THEN 2 ELSE 3 END AS tier FROM n, dg WHERE trim(asked) <> '' AND (lower(entity) = lower(trim(asked)) OR (length(trim(asked)) >= 2 AND (starts_with(lower(entity), lower(trim(asked))) OR (length(entity) >= 3 AND starts_with(lower(trim(asked)), lower(entity))) OR (length(trim(asked)) >= 4 AND contains(lower(entity), lower(trim(asked)))))))),
b AS (SELECT name, entity, row_number() OVER (PARTITION BY name ORDER BY lvl, tier, degree DESC, first_seen) AS k FROM h) SELECT DISTINCT n.name, b.entity FROM n LEFT JOIN b ON b.name = n.name AND k = 1""",
    "khop": f"""WITH {_EDGES}, i AS (SELECT s AS x, o AS y, id FROM e UNION SELECT o, s, id FROM e), one AS (SELECT x AS root, id, y FROM i WHERE x IN ('Brand#11', 'Brand#23')),
two AS (SELECT DISTINCT root, i.id FROM (SELECT DISTINCT root, y FROM one WHERE y <> root) f JOIN i ON i.x = f.y)
SELECT DISTINCT root, id, 1 AS hop FROM one UNION ALL SELECT root, id, 2 FROM two WHERE (root, id) NOT IN (SELECT root, id FROM one)""",
    "provenance": f"WITH {_EDGES}, i AS (SELECT id FROM e UNION VALUES (-1::BIGINT), (3::BIGINT), (1000000000000::BIGINT)), m AS (SELECT max(id) AS m FROM e) SELECT i.id, CASE WHEN e.s IS NOT NULL THEN 'known' WHEN i.id >= 0 AND i.id <= m THEN 'retired' ELSE 'unknown' END AS status, s, r, o, source, 'line ' || sent_idx || ' of ' || source AS text FROM i LEFT JOIN e ON e.id = i.id, m",
    "ppmi_graph": f"WITH {_EDGES}, {_PPMI} SELECT u, v, n, round(weight, 6) AS weight, round(n * weight, 6) AS salience FROM w",
    "cohesion": f"WITH {_EDGES}, {_PPMI}, {_MEMBER}, c AS (SELECT a.community, avg(weight) AS c FROM w JOIN mb a ON a.entity = u JOIN mb b ON b.entity = v AND a.community = b.community GROUP BY 1) SELECT mb.community, count(*) AS size, round(coalesce(any_value(c), 0), 6) AS cohesion FROM mb LEFT JOIN c ON c.community = mb.community GROUP BY 1",
    "entity_strength": f"WITH {_EDGES}, {_PPMI}, {_MEMBER}, x AS (SELECT u AS entity, n * round(weight, 9) AS x FROM w UNION ALL SELECT v, n * round(weight, 9) FROM w), t AS (SELECT entity, sum(x) AS strength FROM x GROUP BY 1), r AS (SELECT community, entity, strength, row_number() OVER (PARTITION BY community ORDER BY strength DESC, entity) AS place FROM t JOIN mb USING (entity)) SELECT community, entity, round(strength, 6) AS strength, place FROM r WHERE place <= 8",
    "cooccurrence_triples": f"WITH {_TOK}, u AS (SELECT pos, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM st WHERE is_prose), pv AS (SELECT token, count(DISTINCT pos) AS df FROM u GROUP BY token HAVING count(DISTINCT pos) >= 5), x AS (SELECT token AS s, lead(token) OVER (PARTITION BY pos ORDER BY i) AS o FROM u JOIN pv USING (token)) SELECT s, o, count(*) AS n FROM x WHERE o IS NOT NULL AND o <> s GROUP BY s, o",
    "triple_f1": f"WITH {_EDGES}, p AS (SELECT DISTINCT source, s, o FROM e WHERE r = 'returns'), g AS (SELECT DISTINCT source, s, o FROM e WHERE r = 'buys'), j AS (SELECT coalesce(p.source, g.source) AS source, count(p.s) AS np, count(g.s) AS ng, count(*) FILTER (WHERE p.s IS NOT NULL AND g.s IS NOT NULL) AS tp FROM p FULL JOIN g ON p.source = g.source AND p.s = g.s AND p.o = g.o GROUP BY 1), k AS (SELECT source, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS recall FROM j) SELECT source, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM k",
    "graph_distance": f"WITH {_EDGES}, x AS (SELECT DISTINCT source, r, s || chr(1) || o AS k, 'e' AS kind FROM e UNION SELECT source, r, s, 'n' FROM e UNION SELECT source, r, o, 'n' FROM e), y AS (SELECT source, kind, k, count(*) AS c FROM x GROUP BY 1, 2, 3) SELECT source, count(*) FILTER (WHERE c = 1) AS ged, round(count(*) FILTER (WHERE c = 1) / sum(c), 6) AS ged_norm FROM y GROUP BY source",
    "value_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type",
    "noise_floors": "SELECT l_returnflag, round(least(quantile_cont(l_discount * 7 + l_tax * 3, 0.75) + 0.05, 0.5), 6) AS threshold FROM lineitem GROUP BY l_returnflag",
    "otsu_thresholds": """WITH p AS (SELECT l_returnflag, l_discount * 7 + l_tax * 3 AS p FROM lineitem WHERE l_discount * 7 + l_tax * 3 BETWEEN 0 AND 1), h AS (SELECT l_returnflag, least(floor(p * 64), 63)::INT AS bin, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
g AS (SELECT DISTINCT l_returnflag, unnest(range(64)) AS bin FROM p), d AS (SELECT g.l_returnflag, g.bin, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.l_returnflag) AS w FROM g LEFT JOIN h ON h.l_returnflag = g.l_returnflag AND h.bin = g.bin),
c AS (SELECT *, sum(w) OVER a AS omega, sum(w * ((bin + 0.5) / 64)) OVER a AS mu, sum(w * ((bin + 0.5) / 64)) OVER (PARTITION BY l_returnflag) AS al FROM d WINDOW a AS (PARTITION BY l_returnflag ORDER BY bin ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, pow(al * omega - mu, 2) / greatest(omega * (1 - omega), 1e-12) AS s FROM c), m AS (SELECT *, max(s) OVER (PARTITION BY l_returnflag) AS top FROM s), k AS (SELECT l_returnflag, list(bin ORDER BY bin) AS b FROM m WHERE s >= top - 1e-12 GROUP BY 1) SELECT l_returnflag, round((b[len(b) // 2 + 1] + 1) / 64, 6) AS threshold FROM k""",
    "toolcall_triples": f"WITH {_CALLS}, j AS (SELECT doc_id AS id, call::JSON AS j FROM c WHERE json_valid(call)), x AS (SELECT id, 'has_name' AS r, 'tool:' || (j->>'$.name') AS o FROM j UNION ALL SELECT id, 'has_query', 'query:' || (j->>'$.arguments.query') FROM j WHERE j->>'$.name' IS NOT NULL UNION ALL SELECT id, 'has_limit', 'limit:' || (j->>'$.arguments.limit') FROM j WHERE j->>'$.name' IS NOT NULL UNION ALL SELECT id, 'has_verbose', 'bool:' || upper((j->>'$.arguments.verbose')[1]) || (j->>'$.arguments.verbose')[2:] FROM j WHERE j->>'$.name' IS NOT NULL) SELECT id, 'ROOT' AS s, r, o FROM x WHERE o IS NOT NULL",
    "number_fidelity": f"WITH {_S}, x AS (SELECT pos, text, regexp_extract_all(text, '{_NUM}') AS r, regexp_extract_all({_HYP}, '{_NUM}') AS h FROM s) SELECT pos, CASE WHEN len(r) > 0 THEN round(list_sum(list_transform(list_distinct(r), lambda v: least(len(list_filter(r, lambda y: y = v)), len(list_filter(h, lambda y: y = v))))) / len(r), 6) END AS kept, {_one_line('text')} = {_one_line(chr(39) + ' ' + chr(39) + ' || replace(text, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + '  ' + chr(39) + ')')} AS same FROM x",
    "redacted_texts": f"SELECT doc_id, {_SEC} AS text FROM documents",
    "surface_features": f"SELECT doc_id, round(ln(1 + length(text)), 6) AS length, {_share(chr(92) + 'p{Nd}')} AS digit_ratio, {_share('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + _SP + ']')} AS punct_ratio, {_share('[{}]')} AS brace_ratio, {_share(chr(92).join(['[', '[', ']]']))} AS bracket_ratio, {_share('[' + chr(34) + chr(39) * 2 + ']')} AS quote_ratio, {_share(chr(92) + 'p{Lu}')} AS upper_ratio, {_share('[' + _SP + ']')} AS whitespace_ratio, {_share('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS nonascii_ratio FROM documents WHERE text IS NOT NULL",
    "url_literals": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{prep.LITERALS['url']}'), ' ') AS url, array_to_string(regexp_extract_all(text, '{prep.LITERALS['uuid']}'), ' ') AS uuid FROM documents",
    "segmented_records": f"WITH a AS (SELECT doc_id AS rec_id, CASE WHEN modality = 'toolcall' AND length(text) <= 256 THEN [{_strip('text')}] ELSE list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_W}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: length(x) BETWEEN 30 AND 256)[:64] END AS u FROM documents WHERE text IS NOT NULL) SELECT rec_id, (i - 1)::INT AS unit, u[i] AS text FROM (SELECT rec_id, u, unnest(range(1, len(u) + 1)) AS i FROM a)",
    "scanned_records": "SELECT doc_id, modality, length(text) AS n FROM documents WHERE length(text) >= CASE WHEN modality = 'toolcall' THEN 30 ELSE 120 END",
    "field_texts": "SELECT qid, coalesce(array_to_string(list_filter(max(q_tokens), lambda x: x IS NOT NULL), ' '), '') AS joined, coalesce(max(budget)::VARCHAR, '') AS budget FROM questions GROUP BY qid",
    "relation_labels": "SELECT p_partkey, regexp_replace(regexp_replace(lower('! ' || p_type || ' ' || p_name), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM part",
    "sequence_chunks": f"WITH {_S}, r AS (SELECT source, sent_idx, pos, (row_number() OVER (PARTITION BY source ORDER BY sent_idx) - 1) // 4 AS chunk FROM s) SELECT source, chunk, array_to_string(list(pos ORDER BY sent_idx), ',') AS items FROM r GROUP BY 1, 2 HAVING count(*) = 4",
    "mix_targets": "SELECT name, round_even(12345 * pct / 100, 0)::BIGINT AS target FROM source_specs",
    "code_windows": f"WITH {_S}, l AS (SELECT source, sent_idx AS start, text, lead(text, 1) OVER w AS b, lead(text, 2) OVER w AS c FROM s WHERE NOT is_prose WINDOW w AS (PARTITION BY source ORDER BY sent_idx)), x AS (SELECT source, start, text || chr(10) || b || chr(10) || c AS text FROM l WHERE c IS NOT NULL) SELECT * FROM x WHERE length(text) BETWEEN 20 AND 256",
    "dedupe_status": "WITH t AS (SELECT 'd' || doc_id AS source, doc_id, text, modality FROM documents WHERE text IS NOT NULL), o AS (SELECT DISTINCT 'd' || doc_id AS source, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM split_docs) UNION SELECT 'd' || doc_id, sha256(upper(text)) FROM documents WHERE text IS NOT NULL AND modality = 'code') SELECT t.source, CASE WHEN h IS NULL THEN 'ingested' WHEN h = sha256(text) THEN 'unchanged' ELSE 'replaced' END AS status, greatest(1, length(text) // 4)::INT AS tokens FROM t LEFT JOIN o ON o.source = t.source",
    "dropped_source": f"WITH {_S} SELECT pos, source FROM s WHERE source NOT IN (SELECT source FROM docs WHERE lite)",
    "universe": f"WITH {_S}, d AS (SELECT source, max(doc_seq) AS doc_seq FROM docs GROUP BY source) SELECT source, sent_idx, row_number() OVER (ORDER BY doc_seq, sent_idx) - 1 AS pos FROM s JOIN d USING (source)",
    "valid_vectors": "WITH h AS (SELECT source, count(DISTINCT sent_idx) AS n FROM sent_vectors GROUP BY source) SELECT DISTINCT h.source FROM h JOIN docs d ON d.source = h.source AND d.n_sents = h.n",
    "corpus_statistics": f"WITH {_EDGES}, d AS (SELECT source, max(tokens) AS tokens FROM docs GROUP BY source), a AS (SELECT (SELECT count(*) FROM d) AS docs, (SELECT sum(tokens) FROM d)::BIGINT AS raw_tokens, (SELECT count(DISTINCT pos) FROM sentences) AS sentences, count(*) AS edges, count(*) FILTER (WHERE r_lex <> '') AS lexical_edges, sum(greatest(1, (length(s) + length(r) + length(o) + 2) // 4))::BIGINT AS graph_tokens, (SELECT count(DISTINCT x) FROM (SELECT s AS x FROM e UNION ALL SELECT o FROM e)) AS entities, (SELECT count(DISTINCT source) FROM sent_vectors) AS embedded_docs FROM e) SELECT *, round_even(raw_tokens / greatest(graph_tokens, 1), 1) AS compression FROM a",
    "ledger_by_tool": "SELECT event_type AS tool, count(*) AS calls, sum(greatest(1, length(props) // 4))::BIGINT AS served FROM events GROUP BY event_type",
    "ledger_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS tool, count(*) AS calls, sum(greatest(1, length(props) // 4))::BIGINT AS served FROM events GROUP BY 1, 2",
    "cypher_rows": f"WITH {_EDGES} SELECT id, 'MERGE (a:Entity {{name: $s}}) MERGE (b:Entity {{name: $o}}) MERGE (a)-[r:REL {{type: $r, source: $src}}]->(b)' AS query, s, o, r, source AS src FROM e",
    "sentence_split": f"WITH {_split('TRUE')} SELECT doc_id, i, piece, start FROM sp",
    "upper_split": f"WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]){_W}+([A-ZÁÉÍÓÚÑ¿¡\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, (i - 1)::INT AS i, p[i] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM a)",
    "document_headings": f"WITH {_HEADS} SELECT doc_id, pl AS \"at\", level, title FROM hd",
    "section_paths": f"""WITH {_split("modality = 'prose'")}, {_HEADS},
b AS (SELECT doc_id, pl AS place, 0 AS kind, NULL::INT AS i, level, title FROM hd UNION ALL SELECT doc_id, start, 1, i, NULL, NULL FROM sp),
c AS (SELECT doc_id, i, kind, {_LAST} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY place, kind, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT 'd' || doc_id || '.md' AS source, i AS sent_idx, concat_ws('{T.SECTION_SEP}', {_PATH}) AS section FROM c WHERE kind = 1""",
    "capitalized": f"WITH {_S} SELECT pos, array_to_string(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][\\p{{L}}\\p{{N}}_''\\-]*(?:[\\s\\v\\p{{Z}}]+(?:of|the|de|and|&)?[\\s\\v\\p{{Z}}]*[A-Z][\\p{{L}}\\p{{N}}_''\\-]*)*)', 1), '|') AS names FROM s",
    "facts_of": f"""WITH {_EDGES}, g AS (SELECT r_lex IS NULL OR r_lex = '' AS cls, s, r, o, min(id) AS first_id, s || ' ' || r || ' ' || o || ' #' || string_agg(id::VARCHAR, ',' ORDER BY id) AS line FROM e WHERE id IN (SELECT id FROM e WHERE s = 'Brand#11' OR o = 'Brand#11') GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (ORDER BY cls, first_id, s, r, o) AS k, count(*) OVER () AS total FROM g), h AS (SELECT * FROM k WHERE k <= 25), m AS (SELECT count(*) FILTER (WHERE NOT cls) AS words, count(*) AS n, coalesce(bool_or(cls), FALSE)::INT AS any_cls, coalesce(max(total), 0) AS total FROM h)
SELECT 0 AS place, 'Brand#11 (' || total || ' facts, hops=1)' AS line FROM m UNION ALL SELECT (k + cls::INT)::INT, line FROM h
UNION ALL SELECT (words + 1)::INT, '{graph.DIVIDER}' FROM m WHERE any_cls = 1 UNION ALL SELECT (n + any_cls + 1)::INT, '+' || (total - n) || ' more (raise limit)' FROM m WHERE total > n""",
    "question_entities": f"""WITH {_TOK}, e AS (SELECT unnest(toks) AS s, source AS o FROM st), dg AS (SELECT entity, count(*) AS degree FROM (SELECT s AS entity FROM e UNION ALL SELECT o FROM e) GROUP BY entity),
w AS (SELECT qid, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pl FROM (SELECT qid, regexp_extract_all(lower(question), '{_WORD}') AS l FROM q)),
f AS (SELECT qid, pl, unnest(fs) AS entity, generate_subscripts(fs, 1) AS k FROM (SELECT qid, pl, {_FORMS} AS fs FROM w WHERE word NOT IN ({_GENERIC}))),
h AS (SELECT qid, pl, arg_min(entity, k) AS entity, arg_min(degree, k) AS degree FROM f JOIN dg USING (entity) GROUP BY qid, pl),
u AS (SELECT qid, entity, min(pl) AS pl, max(degree) AS degree FROM h WHERE entity NOT IN ({_GENERIC}) GROUP BY qid, entity)
SELECT qid, entity, place::INT AS place FROM (SELECT qid, entity, row_number() OVER (PARTITION BY qid ORDER BY degree, pl) AS place FROM u) WHERE place <= 3""",
    "supported_features": f"""{'WITH ' + _SHORT},
j AS (SELECT sh.qid, sh.pos, len(list_intersect(list_distinct(qt.toks), st.toks)) AS hits, (SELECT count(*) FROM unnest(qt.toks) AS z(w) WHERE list_contains(st.toks, w)) AS all_hits, f.prov_flags, f.dense_cos, f.dense_available
  FROM sh JOIN qt USING (qid) JOIN st USING (pos) LEFT JOIN (SELECT qid, pos, max(prov_flags) AS prov_flags, max(dense_cos) AS dense_cos, max(dense_available) AS dense_available FROM features GROUP BY qid, pos) f USING (qid, pos))
SELECT qid, pos, least(all_hits, 3)::DOUBLE AS ent_hits, coalesce(prov_flags, FALSE)::INT::DOUBLE AS provenance,
  round(CASE WHEN coalesce(dense_available, FALSE) AND dense_cos IS NOT NULL AND NOT isnan(dense_cos) THEN dense_cos ELSE 0.0 END, 6)::DOUBLE AS dense_cos, CASE WHEN coalesce(dense_available, FALSE) THEN 0.0 ELSE 1.0 END::DOUBLE AS dense_missing FROM j""",
    "summary_grounding": f"""WITH {_MEMBER}, sm AS (SELECT community, string_agg(entity, ' and ' ORDER BY entity) AS summary FROM mb GROUP BY community),
kn AS (SELECT DISTINCT unnest(regexp_extract_all(lower(entity), '[a-z]{{3,}}')) AS k FROM mb),
w AS (SELECT community, unnest(l) AS word, generate_subscripts(l, 1) AS pl FROM (SELECT community, regexp_extract_all(lower(summary), '[a-z]{{3,}}') AS l FROM sm)),
x AS (SELECT *, regexp_replace(word, 's+$', '') AS stem FROM w WHERE word NOT IN ({", ".join(f"'{g}'" for g in graph.GROUNDING_STOP)})),
y AS (SELECT community, pl, contains('nation', word) OR EXISTS (SELECT 1 FROM mb WHERE mb.community = x.community AND lower(mb.entity) IN (word, stem)) AS ok FROM x WHERE EXISTS (SELECT 1 FROM kn WHERE k IN (word, stem)))
SELECT community, round(coalesce(avg(ok::INT), 1.0), 6) AS grounding FROM sm LEFT JOIN y USING (community) GROUP BY community""",
    "decoded_edges": f"""WITH n AS (SELECT l_orderkey AS id, l_linenumber AS i, max(l_quantity / 10 - 2) AS exist FROM lineitem GROUP BY 1, 2),
c AS (SELECT a.id, 0 AS r, a.i, b.i AS j, {_SIG('a.exist * b.exist - 1')} AS p, {_SIG('a.exist')} AS ei, {_SIG('b.exist')} AS ej FROM n a JOIN n b ON a.id = b.id AND a.i <> b.i),
k AS (SELECT id, i, r, j, p FROM c WHERE ei > 0.5 AND ej > 0.5 AND p > 0.8),
t AS (SELECT id, i, r, j, p, row_number() OVER (PARTITION BY id ORDER BY round(p * ei * ej, 9) DESC, r, i, j) AS z FROM c WHERE id NOT IN (SELECT id FROM k))
SELECT id, i, r, j, round(p, 6) AS p, FALSE AS forced FROM k UNION ALL SELECT id, i, r, j, round(p, 6), TRUE FROM t WHERE z = 1""",
    "between_labels": f"""WITH {_S}, a AS (SELECT pos, text, pos % 2 = 1 AS turned, strpos(text, ' ') - 1 AS x, length(text) - strpos(reverse(text), ' ') + 1 AS y FROM s WHERE text IS NOT NULL AND strpos(text, ' ') > 0),
b AS (SELECT pos, turned AND (y > 0 OR length(text) > x) AS reverse, regexp_extract_all(lower(substr(text, x::INT + 1, greatest(y - x, 0)::INT)), '[a-z0-9\\-'']+') AS w FROM a),
c AS (SELECT pos, regexp_replace(regexp_replace(lower(array_to_string(list_filter(w, lambda q: q NOT IN ({_NO_LABEL}))[1:3], '_')), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS label, list_contains(w, 'by') <> reverse AS swapped FROM b)
SELECT pos, CASE WHEN label <> '' THEN label END AS label, CASE WHEN label <> '' THEN swapped END AS swapped FROM c""",
    "code_blocks": "WITH b AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)```(?:\\w+)?[\\s\\v]*\\n(.*?)```', 1) AS l FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM b) SELECT doc_id, unnest(l) AS block, (generate_subscripts(l, 1) - 1)::INT AS i FROM c",
    "spaced_digit_texts": "WITH d AS (SELECT doc_id, text, coalesce(sonar_lang, '') IN ('jpn_Jpan', 'rus_Cyrl') AS kept, string_split(regexp_replace(text, '(\\d{5,})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents) SELECT doc_id, CASE WHEN kept THEN text ELSE array_to_string(list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '\\d{5,}') THEN trim(regexp_replace(x, '(\\d)', '\\1 ', 'g')) ELSE x END), '') END AS text FROM d",
    "ingest_counts": "WITH t AS (SELECT DISTINCT source, lite FROM docs), e AS (SELECT source || ': no mode' AS e FROM t WHERE lite IS NULL ORDER BY 1 LIMIT 5) SELECT count(*) FILTER (WHERE lite) AS ingested, count(*) FILTER (WHERE NOT lite) AS replaced, 0::BIGINT AS unchanged, count(*) FILTER (WHERE lite IS NULL) AS failed, (SELECT coalesce(string_agg(e, '; ' ORDER BY e), '') FROM e) AS first_errors FROM t",
    "toolcall_scores": f"""WITH {_CALLS}, d AS (SELECT doc_id, call, regexp_replace(call, '"limit": [0-9]+', '"limit": 7', 'g') AS other FROM c),
i AS (SELECT doc_id, call, other, json_valid(call) AS valid, {_items('call')} AS a, {_items('other')} AS b FROM d)
SELECT doc_id, coalesce(valid, FALSE) AS valid, coalesce(list_sort(a) = list_sort(b), FALSE) AS exact, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1, coalesce(valid AND call = other, FALSE) AS equal FROM i""",
    "text_candidates": f"WITH {_Q}, w AS (SELECT qid AS rec, unnest(l) AS entity, generate_subscripts(l, 1) - 1 AS pl FROM (SELECT qid, regexp_extract_all(lower(question), '[a-z]{{7,}}') AS l FROM q)), g AS (SELECT rec, min(entity) AS s, max(entity) AS o FROM w WHERE pl < 2 GROUP BY rec), u AS (SELECT rec, entity, min(pl) AS pl FROM w GROUP BY rec, entity), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pl, entity)::INT AS place FROM u) SELECT r.rec, place, entity, coalesce(entity IN (s, o), FALSE) AS exists FROM r LEFT JOIN g USING (rec) WHERE place <= 24",
    "spare_entities": f"WITH {_Q}, w AS (SELECT budget, unnest(regexp_extract_all(lower(question), '[a-z]{{7,}}')) AS entity FROM q) SELECT DISTINCT entity FROM w WHERE entity NOT IN (SELECT entity FROM w WHERE budget > 400)",
    "provenance_records": f"""WITH {_S}, w AS (SELECT pos AS rec, text AS sentence, char_offset AS off, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS w FROM s WHERE text IS NOT NULL), t AS (SELECT *, w[1] AS s, w[-1] AS o FROM w WHERE len(w) > 1)
SELECT rec, s, 'near' AS r, o, sentence, strpos(sentence, s) - 1 + off AS s_start, strpos(sentence, s) - 1 + length(s) + off AS s_end, strpos(sentence, o) - 1 + off AS o_start, strpos(sentence, o) - 1 + length(o) + off AS o_end FROM t
UNION ALL SELECT rec, s, 'near', '(memory)', sentence, strpos(sentence, s) - 1 + off, strpos(sentence, s) - 1 + length(s) + off, NULL, NULL FROM t""",
    "code_languages": f"SELECT DISTINCT source, CASE lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) {' '.join(f'WHEN {chr(39)}{x}{chr(39)} THEN {chr(39)}{y}{chr(39)}' for x, y in relations.GRAMMARS.items())} END AS language FROM docs",
    "feature_scales": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM f WHERE NOT isnan({c})" for c in ("lex_scores", "bm25", "dense_cos", "rel_pos")),
    "community_gate": f"WITH {_EDGES}, {_PPMI}, {_MEMBER}, c AS (SELECT a.community, avg(weight) AS c FROM w JOIN mb a ON a.entity = u JOIN mb b ON b.entity = v AND a.community = b.community GROUP BY 1), z AS (SELECT mb.community, count(*) AS size, coalesce(any_value(c), 0) AS cohesion FROM mb LEFT JOIN c ON c.community = mb.community GROUP BY 1) SELECT community, size, round(cohesion, 6) AS cohesion FROM z WHERE size >= 5 AND cohesion >= (SELECT avg(weight) FROM w) ORDER BY size DESC, community LIMIT 8",
    "fact_sentences": f"WITH {_EDGES} SELECT DISTINCT q.qid::BIGINT AS qid, source || ':' || sent_idx AS pos FROM e JOIN (VALUES (1, 'NATION_3'), (2, 'Brand#11'), (3, 'nobody')) q(qid, entity) ON entity IN (s, o)",
    "candidate_spans": f"""WITH {_S}, {_Q}, v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(question), '[a-z]{{4,}}')) AS token FROM q),
t AS (SELECT pos AS sent, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT pos, string_split(text, ' ') AS l FROM s WHERE text IS NOT NULL)),
w AS (SELECT sent, i, lower(regexp_replace(x, '^\\W+|\\W+$', '', 'g')) AS word FROM t),
f AS (SELECT sent, i, unnest(fs) AS entity, generate_subscripts(fs, 1) AS k FROM (SELECT sent, i, list_filter([word, CASE WHEN ends_with(word, 's') THEN word[:length(word) - 1] END, CASE WHEN ends_with(word, 'es') THEN word[:length(word) - 2] END], lambda z: z IS NOT NULL) AS fs FROM w)),
b AS (SELECT sent, i, arg_min(entity, k) AS entity FROM f JOIN v ON v.token = entity GROUP BY sent, i)
SELECT sent, entity, min(i)::INT AS i FROM b GROUP BY sent, entity""",
    "pooled_vectors": "WITH v AS (SELECT pos, max(emb) AS e FROM sent_vectors GROUP BY pos), g AS (SELECT pos, list_transform(range(1, 17), lambda k: e[k]::DOUBLE + e[k + 16] + e[k + 48]) AS t FROM v WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e30)) = 0), h AS (SELECT pos, t, sqrt(list_sum(list_transform(t, lambda x: x * x))) AS n FROM g) SELECT pos, list_transform(t, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE 0.0 END, 5) + 0.0) AS vector FROM h",
    "decoded_files": "WITH n AS (SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT k || '.' || x AS source, CASE x WHEN 'ipynb' THEN n || chr(10) || chr(10) || 'in ' || r WHEN 'eml' THEN 'Subject: ' || n || chr(10) || 'From: a@b.org' || chr(10) || chr(10) || 'in ' || r ELSE n || chr(10) || 'in ' || r END AS text, NULL::VARCHAR AS error FROM n, (VALUES ('html'), ('rtf'), ('ipynb'), ('eml'), ('txt')) f(x)",
    "dependency_labels": "SELECT n_nationkey AS sent, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 4 END AS s, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END AS o, 'sell' AS label, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS pattern, FALSE AS swapped FROM nation",
    "packed_replies": f"WITH RECURSIVE {_PACKED} SELECT qid, line_no::INT AS line_no, pos, line FROM pk",
    "community_evidence": f"""WITH {_EDGES}, {_PPMI}, {_MEMBER}, i AS (SELECT a.community, u, v, row_number() OVER (PARTITION BY a.community ORDER BY round(n * weight, 9) DESC, u, v) AS place FROM w JOIN mb a ON a.entity = u JOIN mb b ON b.entity = v AND a.community = b.community),
t AS (SELECT least(s, o) AS u, greatest(s, o) AS v, min(id) AS id FROM e GROUP BY 1, 2), x AS (SELECT t.u, t.v, arg_min(s || ' -' || r || '- ' || o, s || chr(1) || r || chr(1) || o) AS fact, arg_min(s || ' ' || r || ' ' || o, s || chr(1) || r || chr(1) || o) AS text FROM t JOIN e ON e.id = t.id AND least(s, o) = t.u AND greatest(s, o) = t.v GROUP BY 1, 2)
SELECT community, place::INT AS place, fact, CASE WHEN place <= 6 THEN substr(text, 1, 140) END AS quote FROM i JOIN x USING (u, v) WHERE place <= 12""",
    "centroid_cosines": "WITH c AS (SELECT label, k, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k), m AS (SELECT label, list(x ORDER BY k) AS mean FROM c GROUP BY label) SELECT vec_id, label, round(greatest(-1.0, least(1.0, list_inner_product(embedding::DOUBLE[], mean))) / sqrt(list_inner_product(mean, mean)), 6) AS cos FROM embeddings JOIN m USING (label)",
    "literal_links": f"WITH {_Q}, a AS (SELECT DISTINCT qid AS key, unnest(q_tokens) AS entity FROM questions), b AS (SELECT DISTINCT qid AS key, unnest(regexp_extract_all(question, '\\d+')) AS literal FROM q) SELECT key, entity, 'number' AS kind, literal FROM a JOIN b USING (key) WHERE entity IS NOT NULL",
    "training_cost": "WITH m AS (SELECT p_partkey, p_size * 1000.0::DOUBLE AS n, p_retailprice AS x FROM part), c AS (SELECT p_partkey, 6 * n * x * 2 + 4 * 2 * n * x * 2 * 25 + 2 * 3 * n * x * 25 AS a, 6 * n * x * 2 + 6 * 2 * n * x * 2 + 2 * 3 * n * x * 25 AS g, 6 * n * x * 25 * 2 AS t FROM m) SELECT p_partkey, round(a, 3) AS total, round(g, 3) AS graph_total, round(t, 3) AS token_total, round(a / t, 6) AS ratio FROM c",
    "inference_cost": "WITH m AS (SELECT p_partkey, p_size * 1000.0::DOUBLE AS n, p_retailprice AS x FROM part) SELECT p_partkey, round(2 * n / 25 + 4 * n, 6) AS concept, round(2 * n, 6) AS token, round(2 * n * x + 2 * x * x * 64, 6) AS context, round(4 * n, 6) AS graph, round(6 * n * x, 6) AS token_graph, round(x * 1008000000.0, 6) AS prefill, round(x / 25 * 1024 * 2, 6) AS state, round(x * 2 * 12 * 64 * 2, 6) AS cache FROM m",
    "roofline": """WITH m AS (SELECT p_partkey, p_size::DOUBLE AS k, p_retailprice AS x FROM part), g AS (SELECT *, 1024 * k * 64 + k * 64 + 65 + 6500 + 8 * 64 * 64 AS params, 2 * 1024 * k * 64 + 2 * k * 64 + 2 * k * 64 * 100 + 2 * 8 * k * 64 * 64 + 2 * 8 * k * k * 64 AS work, (1024 + 2 * k * 64 + k + k * 100 + 2 * 8 * k * 64 + 8 * k * k) * 2 AS act FROM m),
h AS (SELECT *, params * 2 AS wb, 30.9e12 / 672e9 AS ridge FROM g) SELECT p_partkey, params, work, round(x * work / (wb + x * act), 6) AS intensity, round(wb / (wb + x * act), 6) AS share, CASE WHEN work - ridge * act > 0 THEN round(ridge * wb / (work - ridge * act), 6) END AS crossover FROM h""",
    "latency": "WITH m AS (SELECT p_partkey, p_size::DOUBLE AS k, p_retailprice / 10000 AS x FROM part) SELECT p_partkey, round((1 - x) * 0.013 + x * k, 6) AS mean_ms, round(CASE WHEN k / 5 <= 13.96 / k THEN 1.0 WHEN 0.013 >= 13.96 / k THEN 0.0 ELSE (13.96 / k - 0.013) / (k / 5 - 0.013) END, 6) AS ceiling, round(CASE WHEN k < 5 THEN 0.001 * (k + 1) / 5 ELSE 0.0005 * (1 + cos(pi() * least((k - 5) / 45, 1))) END, 6) AS rate FROM m",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
