"""DuckDB statements for the training-data queries that plain SQL can express over whole tables."""

from __future__ import annotations

from . import fusion

_ONE = "SELECT qid, max(q_tokens) AS q FROM questions WHERE q_tokens IS NOT NULL GROUP BY qid"
_EDGE = r"^[\p{P}\p{Z}\p{Cc}\s]+|[\p{P}\p{Z}\p{Cc}\s]+$"
_TERMS = rf"""
one AS ({_ONE}),
u AS (SELECT qid, unnest(q) AS t FROM one),
v AS (SELECT qid, regexp_replace(lower(t), '{_EDGE}', '', 'g') AS term FROM u WHERE t IS NOT NULL),
w AS (SELECT qid, term FROM v WHERE length(term) > 0),
tf AS (SELECT qid, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY qid) AS len FROM w GROUP BY qid, term),
g AS (SELECT count(DISTINCT qid)::DOUBLE AS n, sum(tf)::DOUBLE AS total FROM tf),
cf AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY term),
m AS (SELECT qid, term, tf, cf::BIGINT AS cf, cf / n AS m, tf * log2(1 + 0.25 * (total / n) / len) AS tfn FROM tf JOIN cf USING (term), g),
s AS (SELECT qid, term, tf::BIGINT AS tf, cf, (log2(1 + m) + tfn * log2((1 + m) / m)) / (tfn + 1) AS score FROM m)
"""



def _poly(x: str, c: tuple[float, ...]) -> str:
    out = repr(c[-1])
    for k in reversed(c[:-1]):
        out = f"({out} * {x} + {k!r})"
    return out


def _deviate(p: str) -> str:
    """The normal deviate of a probability."""
    q, t = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    near = f"{q} * {_poly(f'(0.180625 - {q} * {q})', fusion.NEAR_A)} / {_poly(f'(0.180625 - {q} * {q})', fusion.NEAR_B)}"
    mid = f"{_poly(f'({t} - 1.6)', fusion.MID_C)} / {_poly(f'({t} - 1.6)', fusion.MID_D)}"
    far = f"{_poly(f'({t} - 5.0)', fusion.FAR_E)} / {_poly(f'({t} - 5.0)', fusion.FAR_F)}"
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN abs({q}) <= 0.425 THEN {near} ELSE sign({q}) * CASE WHEN {t} <= 5.0 THEN {mid} ELSE {far} END END"


_SCORES = ("lex_scores", "bm25", "dense_cos", "rel_pos")
_ORIENTED = ", ".join(f"max(CASE WHEN isnan({c}) THEN NULL ELSE {'-abs(' + c + ')' if c == 'rel_pos' else c} END) AS s{k}" for k, c in enumerate(_SCORES))
_PLACES = ", ".join(f"CASE WHEN s{k} IS NOT NULL THEN (rank() OVER (PARTITION BY qid ORDER BY s{k} NULLS LAST) - 1 + count(*) OVER (PARTITION BY qid, s{k}) * 0.5::DOUBLE) / count(s{k}) OVER (PARTITION BY qid) END AS p{k}" for k in range(4))
_FUSED = f"""
f AS (SELECT qid, pos, {_ORIENTED} FROM features GROUP BY qid, pos),
p AS (SELECT qid, pos, {_PLACES} FROM f),
d AS (SELECT qid, pos, {", ".join(f"{_deviate(f'p{k}')} AS d{k}" for k in range(4))} FROM p),
z AS (SELECT qid, pos, ({" + ".join(f"coalesce(d{k}, 0.0)" for k in range(4))}) / nullif({" + ".join(f"(d{k} IS NOT NULL)::INT" for k in range(4))}, 0) AS fused FROM d)
"""

ORACLE = {
    "p5_scores": f"WITH {_FUSED} SELECT qid, pos, round(fused, 6) + 0.0 AS fused FROM z",
    "p5_found": f"WITH {_FUSED}, r AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC NULLS LAST, pos) AS k FROM z) SELECT qid, pos FROM r WHERE k = 1",
    "p1_scores": f"WITH {_TERMS} SELECT qid, term, tf, cf, round(score, 6) AS score FROM s",
    "p1_found": f"WITH {_TERMS}, r AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, tf DESC, cf, term) AS k FROM s) SELECT qid, term FROM r WHERE k = 1",
    "p4_found": """
SELECT s.name FROM source_specs s LEFT JOIN (SELECT lower(trim(source)) AS k, sum(greatest(coalesce(n_chars, 0), 0)) AS x FROM documents GROUP BY 1) d ON d.k = lower(trim(s.name)),
(SELECT sum(greatest(coalesce(n_chars, 0), 0)) AS t FROM documents) WHERE coalesce(x, 0) * s.max_repeat * 100 < s.pct * t""",
    "p6_found": """
WITH v AS (SELECT pos, encoder, any_value(emb) AS e FROM sent_vectors WHERE len(emb) = 64 AND len(list_filter(emb, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(emb, lambda x: x <> 0)) > 0 GROUP BY pos, encoder)
SELECT a.pos AS pos_a, b.pos AS pos_b FROM v a JOIN v b ON a.encoder = b.encoder AND a.pos < b.pos WHERE list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) >= 0.9""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
