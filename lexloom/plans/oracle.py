"""The queries as SQL for DuckDB, written from the operators' definitions, not from the Spark code's plans."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..operators.entities import PATTERNS
from . import fixtures as X

K = 10


def q(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def rows(values: list[tuple], name: str, columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(q, v)) + ')' for v in values)}) AS {name}({columns})"


def texts(values: list[str]) -> str:
    return f"[{', '.join(map(q, values))}]::VARCHAR[]"


def words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def squeeze(t: str) -> str:
    return rf"regexp_replace({t}, '\s+', ' ', 'g')"


def sentences(t: str) -> str:
    return rf"list_filter(string_split(regexp_replace(trim({squeeze(t)}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def contained(t: str, terms: list[str]) -> str:
    return f"list_filter({texts(terms)}, lambda x: contains(lower({t}), x))"


def found(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, {q(pattern)}, 0)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


LONG = f"list_filter({sentences('text')}, lambda s: len({words('s')}) > 5)"
SENT = f"""sent AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS sentence FROM (SELECT doc_id, {LONG} AS l FROM documents))"""
CITED = """cited AS (SELECT doc_id, 'doc ' || doc_id AS title, doc_id % 4 AS session_id, text AS body,
    ' See ' || coalesce(o_custkey, doc_id) || ' Rep. ' || coalesce(o_custkey, doc_id) % 7 || ' and Section ' || doc_id // 4 || '.' AS citation,
    text || ' See ' || coalesce(o_custkey, doc_id) || ' Rep. ' || coalesce(o_custkey, doc_id) % 7 || ' and Section ' || doc_id // 4 || '.' AS text
    FROM documents LEFT JOIN orders ON o_orderkey = doc_id)"""
SECTIONED = CITED + """, sectioned AS (SELECT doc_id, title, 'BACKGROUND: ' || substr(body, 1, length(body) // 3) || ' FACTS: ' || substr(body, length(body) // 3 + 1, length(body) // 3)
    || ' HOLDING: ' || substr(body, 2 * (length(body) // 3) + 1) || citation AS text FROM cited)"""
STARTS = SECTIONED + rf""", squeezed AS (SELECT doc_id, title, {squeeze('text')} AS text FROM sectioned),
    cut AS (SELECT doc_id, string_split(regexp_replace(text, {q(T.HEADING)}, chr(1) || '\1\2', 'g'), chr(1)) AS p FROM squeezed),
    piece AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS piece FROM cut),
    starts AS (SELECT doc_id, i, replace(regexp_extract(lower(piece), '^(facts?|holding|reasoning|dissent|conclusion|background)', 1) || '.', 'fact.', 'facts.') AS s,
        sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS pos FROM piece),
    heading AS (SELECT doc_id, rtrim(s, '.') AS section, pos FROM starts WHERE i > 0)"""
CHUNKS = STARTS + f""", s AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS sentence, text FROM (SELECT doc_id, text, {sentences('text')} AS l FROM squeezed)),
    passed AS (SELECT s.doc_id, s.idx, s.sentence, min(section) AS lo, max(section) AS hi, max_by(section, pos) AS latest
        FROM s LEFT JOIN heading h ON h.doc_id = s.doc_id AND h.pos <= strpos(s.text, s.sentence) - 1 GROUP BY ALL),
    named AS (SELECT *, coalesce(last_value(latest IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx), 'introduction') AS section FROM passed),
    flagged AS (SELECT *, lag(section, 1, 'introduction') OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM named),
    islands AS (SELECT *, sum(CASE WHEN lo <> before OR hi <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM flagged),
    parts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY idx) - 1) // 5 AS part FROM islands),
    grouped AS (SELECT doc_id, island, part, min(section) AS section, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY idx) AS text FROM parts GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island, part) AS chunk_ord FROM grouped),
    chunks AS (SELECT doc_id, chunk_ord, section, n_sentences, text, substr(md5('doc ' || doc_id || '_' || section || '_' || chunk_ord), 1, 16) AS chunk_id FROM numbered
        UNION ALL SELECT doc_id, 0, 'full', 0, substr(text, 1, 1000), substr(md5(title || '_parent'), 1, 16) FROM squeezed)"""
ORG = """org AS (SELECT c_nationkey::BIGINT AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'PRECEDENT' WHEN 1 THEN 'ORG' ELSE 'PERSON' END AS label, c_name || ' and ' || s_name AS text
    FROM customer JOIN supplier ON c_nationkey = s_nationkey),
    split AS (SELECT doc_id, 'ORG' AS label, trim(unnest(string_split(text, ' and '))) AS text FROM org WHERE label <> 'PERSON' UNION ALL SELECT doc_id, label, text FROM org WHERE label = 'PERSON')"""


def index(source: str, key: str) -> str:
    """Postings and lengths of a table."""
    return f"""tok AS (SELECT {key} AS chunk_id, unnest({words('lower(text)')}) AS term FROM {source}),
    post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT {key} AS chunk_id, len({words('lower(text)')}) AS dl FROM {source}),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term), size AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
    plain AS MATERIALIZED (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM freq, size), usual AS MATERIALIZED (SELECT 0.25 * avg(idf) AS low FROM plain),
    okapi AS (SELECT term, df, CASE WHEN idf < 0 THEN low ELSE idf END AS idf FROM plain, usual)"""


def bm25(queries: str, idf: str, k1: float, k: int, name: str = "hits", b: float = 0.75) -> str:
    """The k best chunks of each query; those without a term score 0."""
    return f"""{name}_ask AS (SELECT query_id, unnest({words('lower(text)')}) AS term FROM {queries}),
    {name}_sum AS (SELECT query_id, p.chunk_id, sum(idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / mean))) AS score
        FROM {name}_ask JOIN {idf} USING (term) JOIN post p USING (term) JOIN dl USING (chunk_id), size GROUP BY ALL),
    {name}_all AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM {queries}) CROSS JOIN dl LEFT JOIN {name}_sum USING (query_id, chunk_id)),
    {name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_all QUALIFY rank <= {k})"""


def hashed(source: str, key: str, name: str, text: str = "text") -> str:
    """Unit vectors of hashed terms as rows: key, b, v."""
    return f"""{name}_t AS (SELECT {key}, unnest({words(f'lower({text})')}) AS t FROM {source}),
    {name}_s AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_t GROUP BY ALL),
    {name} AS (SELECT {key}, b, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY {key})), 0) AS v FROM {name}_s)"""


TERM_QUERIES = f"asked AS (SELECT * FROM {rows(X.TERM_QUERIES, 't', 'query_id, text')})"
QUESTIONS = f"asked AS (SELECT * FROM {rows(X.QUESTIONS, 't', 'query_id, text')})"


def intent(t: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains(lower({t}), {q(p)})' for p in ps)} THEN {q(name)}" for name, ps in L.INTENTS.items())
    return f"CASE {arms} ELSE 'general' END"


def related(t: str) -> str:
    parts = [f"CASE WHEN contains(lower({t}), {q(c)}) THEN {texts([o for o in terms if o != c])} ELSE []::VARCHAR[] END" for terms in L.CONCEPTS.values() for c in terms]
    return f"flatten([{', '.join(parts)}])"


EXPANDED = f"""typed AS (SELECT query_id, text, {intent('text')} AS query_type, {related('text')} AS more FROM asked),
    expanded AS (SELECT query_id, text, query_type, list_filter([text, CASE WHEN len(more) > 0 THEN text || ' ' || array_to_string(more[1:3], ' ') END,
        CASE query_type WHEN 'precedent' THEN 'legal precedent case law ' || text WHEN 'statute_interpretation' THEN 'statutory interpretation meaning ' || text END,
        CASE query_type WHEN 'precedent' THEN 'court held ruling ' || text WHEN 'statute_interpretation' THEN 'legislative intent purpose ' || text END], lambda x: x IS NOT NULL) AS forms FROM typed)"""

CASE_P, STATUTE_P = (p for p, _ in PATTERNS.values())


def entity_list(t: str) -> str:
    return f"list_concat({found(t, CASE_P)}, {found(t, STATUTE_P)})"


def importance(section: str, t: str, terms: list[str]) -> str:
    weight = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.SECTION_WEIGHTS.items())
    n2, n1 = f"len({found(t, CASE_P)})", f"len({found(t, STATUTE_P)})"
    return f"(CASE {section} {weight} ELSE 1.0 END)::DOUBLE * (CASE WHEN {n2} + {n1} > 0 THEN 1 + ({n2} * 2.0 + {n1} * 1.5)::DOUBLE / ({n2} + {n1}) * 0.5 ELSE 1 END) * (1 + len({contained(t, terms)}) * 0.1)"


ASKED = """asked AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'What case held: ' WHEN 1 THEN 'what happened: ' ELSE '' END || b.text || coalesce(citation, '') AS text
    FROM benchmark b LEFT JOIN cited ON doc_id = item_id)"""
HYBRID = f"""{CITED}, chunk AS (SELECT doc_id AS chunk_id, title, text, CASE doc_id % 3 WHEN 0 THEN 'holding' WHEN 1 THEN 'facts' ELSE 'full' END AS section FROM cited),
    chunks AS (SELECT *, {importance('section', 'text', X.TERMS)} AS importance FROM chunk), {ASKED}, {index('chunk', 'chunk_id')}"""
ENTITY = f"entity AS (SELECT DISTINCT doc_id AS chunk_id, unnest({entity_list('text')}) AS entity FROM cited)"
EDGES = "edges AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS weight FROM entity a JOIN entity b USING (entity) WHERE a.chunk_id < b.chunk_id GROUP BY ALL)"
BOTH = "either_way AS (SELECT src AS seed, dst AS near FROM edges UNION ALL SELECT dst, src FROM edges)"


def dense(queries: str, key: str, k: int, name: str) -> str:
    """The k best chunks by inner product of hashed vectors; a chunk without a common feature scores 0."""
    return f"""{name}_dot AS (SELECT {key}, c.chunk_id, round(sum(a.v * c.v), 9) AS score FROM {queries} a JOIN own c USING (b) GROUP BY ALL),
    {name}_all AS (SELECT {key}, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT {key} FROM {queries}) CROSS JOIN (SELECT chunk_id FROM chunk) LEFT JOIN {name}_dot USING ({key}, chunk_id)),
    {name} AS (SELECT {key}, chunk_id, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, chunk_id) AS rank FROM {name}_all QUALIFY rank <= {k})"""


FUSED = f"""{HYBRID}, {EXPANDED}, form AS (SELECT query_id, unnest(range(least(3, len(forms)))) AS ord, unnest(forms[1:3]) AS text FROM expanded),
    form_k AS (SELECT query_id * 10 + ord AS fk, text FROM form), {hashed('form_k', 'fk', 'fv')}, {hashed('chunk', 'chunk_id', 'own')}, {dense('fv', 'fk', 2 * K, 'dd')},
    near AS (SELECT fk // 10 AS query_id, chunk_id, max_by(score, fk) AS score, min(fk % 10) AS ord, min_by(rank, fk) AS rank FROM dd GROUP BY ALL),
    {bm25('asked', 'okapi', 1.5, 2 * K)}, {ENTITY}, {EDGES}, {BOTH},
    named AS (SELECT query_id, e.chunk_id, count(*)::DOUBLE AS score FROM (SELECT query_id, lower(unnest({entity_list('text')})) AS entity FROM asked) a JOIN (SELECT DISTINCT chunk_id, lower(entity) AS entity FROM entity) e USING (entity) GROUP BY ALL),
    stages AS (SELECT query_id, chunk_id, 1 AS s, ord::BIGINT AS a, rank AS b, score AS dense, NULL::DOUBLE AS bm25, NULL::DOUBLE AS entity FROM near
        UNION ALL SELECT query_id, chunk_id, 2, 0, rank, NULL, score, NULL FROM hits UNION ALL SELECT query_id, chunk_id, 3, 0, chunk_id, NULL, NULL, score FROM named),
    cand AS (SELECT query_id, chunk_id, max(dense) AS dense, max(bm25) AS bm25, max(entity) AS entity, min((s, a, b)) AS f FROM stages GROUP BY ALL),
    seeds AS (SELECT query_id, chunk_id AS seed, row_number() OVER (PARTITION BY query_id ORDER BY f) AS n FROM cand QUALIFY n <= 5),
    hop AS (SELECT query_id, seed, near AS chunk_id, row_number() OVER (PARTITION BY query_id, seed ORDER BY near) AS hop_n FROM seeds JOIN either_way USING (seed) QUALIFY hop_n <= 3),
    every AS (SELECT query_id, chunk_id, dense, bm25, entity, NULL AS graph FROM cand
        UNION ALL SELECT DISTINCT query_id, chunk_id, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0.5 FROM hop ANTI JOIN cand USING (query_id, chunk_id)),
    total AS (SELECT query_id, chunk_id, section, (coalesce((dense + 1) / 2 * 0.35, 0) + coalesce(least(bm25 / 10, 1) * 0.25, 0) + coalesce(least(entity / 3, 1) * 0.25, 0) + coalesce(graph * 0.15, 0))::DOUBLE * importance
        * CASE WHEN query_type = 'precedent' AND section = 'holding' OR query_type = 'factual' AND section = 'facts' THEN 1.5 ELSE 1 END AS score
        FROM every JOIN (SELECT query_id, query_type FROM typed) USING (query_id) JOIN chunks USING (chunk_id)),
    results AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM total QUALIFY rank <= {K})"""
SESSION = f"""{HYBRID}, {hashed('asked', 'query_id', 'av')}, {hashed('chunk', 'chunk_id', 'own')}, {dense('av', 'query_id', 3 * K, 'near')}, {bm25('asked', 'plain', 1.2, 3 * K)},
    found AS (SELECT query_id, chunk_id, score, 1 AS stage, rank AS r FROM near UNION ALL SELECT query_id, chunk_id, score * 0.3, 2, rank FROM hits ANTI JOIN near USING (query_id, chunk_id))"""
VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, label, unnest(range(len(e))) AS dim, unnest(e) AS x FROM v)"
STOP = texts(L.STOP_WORDS)
TFIDF = SENT + rf""", tk AS (SELECT doc_id, idx, list_filter(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}', 0), lambda t: NOT list_contains({STOP}, t)) AS l FROM sent),
    g AS (SELECT doc_id, idx, unnest(list_concat(l, list_transform(range(1, greatest(len(l), 1)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM tk),
    c AS (SELECT doc_id, idx, term, count(*) AS tf FROM g GROUP BY ALL), sz AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY ALL),
    tm AS (SELECT doc_id, term, count(*) AS df, row_number() OVER (PARTITION BY doc_id ORDER BY sum(tf) DESC, term) AS r FROM c GROUP BY doc_id, term QUALIFY r <= 100),
    w AS (SELECT doc_id, idx, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN tm USING (doc_id, term) JOIN sz USING (doc_id)),
    sm AS (SELECT doc_id, idx, sum(w) / sqrt(sum(w * w)) AS s FROM w GROUP BY ALL),
    tfidf AS (SELECT doc_id, idx, CASE WHEN n < 2 OR max(s) OVER (PARTITION BY doc_id) IS NULL THEN 1.0 ELSE coalesce(s / max(s) OVER (PARTITION BY doc_id), 0) END AS tfidf
        FROM sent JOIN sz USING (doc_id) LEFT JOIN sm USING (doc_id, idx))"""


def position(idx: str, n: str) -> str:
    return f"CASE WHEN {idx} < 3 THEN 1.0 - {idx} * 0.1 WHEN {idx} >= {n} - 3 THEN 0.8 - ({n} - {idx} - 1) * 0.1 ELSE 0.5 END::DOUBLE"


def tiers(t: str) -> str:
    return f"(({' + '.join(f'len({contained(t, terms)}) * {w}' for w, terms in X.TIERS.items())})::DOUBLE / sqrt(len({words(t)})))"


SCORED = f"""{TFIDF}, key AS (SELECT doc_id * 100000 + idx AS k, sentence FROM sent), kt AS (SELECT k, unnest({words('lower(sentence)')}) AS t FROM key),
    sv AS (SELECT k // 100000 AS doc_id, k % 100000 AS idx, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM kt GROUP BY ALL),
    ce AS (SELECT doc_id, b, sum(v) / any_value(n) AS m FROM sv JOIN sz USING (doc_id) GROUP BY doc_id, b), cn AS (SELECT doc_id, sqrt(sum(m * m)) AS cn FROM ce GROUP BY doc_id),
    se AS (SELECT doc_id, idx, sum(v * m) AS xy, sqrt(sum(v * v)) AS xn FROM sv JOIN ce USING (doc_id, b) GROUP BY ALL),
    scored AS (SELECT doc_id, idx, sentence, {position('idx', 'n')} AS position, tfidf, {tiers('sentence')} AS lexicon, CASE WHEN xn > 0 AND cn > 0 THEN xy / (xn * cn) ELSE 0 END AS semantic
        FROM sent JOIN sz USING (doc_id) JOIN tfidf USING (doc_id, idx) JOIN se USING (doc_id, idx) JOIN cn USING (doc_id)),
    comb AS (SELECT *, position * 0.15 + tfidf * 0.25 + semantic * 0.35 + lexicon * 0.25 AS combined FROM scored)"""



def diverse(k: int, weight: float = 0.7) -> str:
    """Maximal marginal relevance in k steps: picks per document, and of each sentence the nearest pick so far."""
    steps = [f"""m0 AS MATERIALIZED (SELECT doc_id, idx, sentence, n, round(combined, 9) AS score, xn, NULL::DOUBLE AS nearest, NULL::BIGINT AS step FROM comb JOIN sz USING (doc_id) JOIN se USING (doc_id, idx))"""]
    for i in range(1, k + 1):
        gain = "score" if i == 1 else f"{weight} * score - (1 - {weight}) * nearest"
        steps.append(f"""p{i} AS MATERIALIZED (SELECT doc_id, idx AS pick, xn AS pn FROM m{i - 1} WHERE step IS NULL AND n > {k} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {gain} DESC, idx) = 1),
            d{i} AS (SELECT s.doc_id, s.idx, sum(s.v * o.v) AS dot FROM sv s JOIN p{i} p USING (doc_id) JOIN sv o ON o.doc_id = s.doc_id AND o.idx = p.pick AND o.b = s.b GROUP BY ALL),
            m{i} AS MATERIALIZED (SELECT m.doc_id, m.idx, sentence, n, score, xn, greatest(nearest, CASE WHEN xn > 0 AND pn > 0 THEN coalesce(dot, 0) / (xn * pn) ELSE 0 END) AS nearest,
                CASE WHEN m.idx = pick THEN {i} ELSE step END AS step FROM m{i - 1} m LEFT JOIN p{i} USING (doc_id) LEFT JOIN d{i} d ON d.doc_id = m.doc_id AND d.idx = m.idx)""")
    return ", ".join(steps)


def packed(pieces: str, budget: int, name: str) -> str:
    """Greedy packing of pieces (columns g, i from 1, p, sections: whether a quarter is repeated) to a budget of words: name with g, c, text."""
    return f"""{name}_n AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY i)::BIGINT AS upto FROM (SELECT *, len({words('p')}) AS w FROM {pieces})),
    {name}_r AS (SELECT g, i, 0 AS c, 1::BIGINT AS start FROM {name}_n WHERE i = 1
        UNION ALL SELECT n.g, n.i, CASE WHEN full_ THEN r.c + 1 ELSE r.c END, CASE WHEN NOT full_ THEN r.start WHEN n.sections THEN n.i - greatest(1, (n.i - r.start) // 4) WHEN n.i - r.start > 1 THEN n.i - 1 ELSE n.i END
        FROM {name}_r r JOIN {name}_n n ON n.g = r.g AND n.i = r.i + 1 JOIN {name}_n s ON s.g = r.g AND s.i = r.start, LATERAL (SELECT n.upto - s.upto + s.w > {budget} AS full_) f),
    {name}_c AS (SELECT g, c, min(start) AS a, max(i) AS b FROM {name}_r GROUP BY ALL),
    {name} AS (SELECT x.g, x.c, CASE WHEN n.sections THEN string_agg(n.p, ' ' ORDER BY n.i) ELSE string_agg(n.p, chr(10) || chr(10) ORDER BY n.i) END AS text FROM {name}_c x JOIN {name}_n n ON n.g = x.g AND n.i BETWEEN a AND b GROUP BY x.g, x.c, n.sections)"""


def paragraphs(t: str) -> str:
    return rf"string_split(regexp_replace(regexp_replace({t}, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), chr(10) || chr(10))"


FILES = f"f AS (SELECT filename, head, file_size, coalesce(lower(regexp_extract(filename, '\\.([^./\\\\]+)$', 1)), '') AS ext FROM {rows(X.FILES, 't', 'filename, head, file_size')})"
OCR = "p AS (SELECT {keys}, string_agg('w' || l_partkey, ' ' ORDER BY l_linenumber, 'w' || l_partkey) FILTER (l_quantity * 2 - 10 > 0) AS text, avg(l_quantity * 2 - 10) FILTER (l_quantity * 2 - 10 > 0) / 100 AS confidence FROM lineitem GROUP BY ALL)"

ORACLE: dict[str, str] = {
    "text_stats": rf"SELECT doc_id, length(text) AS character_count, len({words('text')}) AS word_count, len(string_split(text, '.')) AS sentence_count FROM documents",
    "sentences_filtered": f"WITH {SENT} SELECT * FROM sent",
    "section_offsets": f"WITH {STARTS} SELECT doc_id, section, pos FROM heading",
    "section_chunks": f"WITH {CHUNKS} SELECT * FROM chunks",
    "parent_children": f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_children, string_agg(chunk_id, ',' ORDER BY chunk_ord) AS children FROM chunks WHERE chunk_ord > 0 GROUP BY doc_id",
    "numbered_sections": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\n\z', ''), '(\d+\.)', chr(1) || '\1', 'g'), chr(1))[2:] AS l FROM documents)
        SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS section FROM t""",
    "paragraph_budget_chunks": f"""WITH RECURSIVE l AS (SELECT doc_id, {paragraphs("replace(text, chr(10), chr(10) || chr(10))")} AS l FROM documents), pc AS (SELECT doc_id AS g, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p, false AS sections FROM l),
        {packed('pc', 400, 'k')} SELECT g AS doc_id, c AS ord, text FROM k""",
    "token_budget_chunks": rf"""WITH RECURSIVE t AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\n\z', ''), '(\d+\.)', chr(1) || '\1', 'g'), chr(1))[2:] AS l FROM documents),
        sec AS (SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS s FROM t),
        pl AS (SELECT doc_id * 100000 AS g, {paragraphs('text')} AS l, false AS sections FROM t WHERE len(l) = 0 UNION ALL SELECT doc_id * 100000 + no, {sentences('s')}, true FROM sec WHERE len({words('s')}) > 400),
        pc AS (SELECT g, sections, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p FROM pl), {packed('pc', 400, 'k')},
        every AS (SELECT g, c, text FROM k UNION ALL SELECT doc_id * 100000 + no, 0, s FROM sec WHERE len({words('s')}) <= 400),
        o AS (SELECT g // 100000 AS doc_id, row_number() OVER (PARTITION BY g // 100000 ORDER BY g, c) - 1 AS chunk_index, count(*) OVER (PARTITION BY g // 100000) AS total_chunks, text FROM every)
        SELECT doc_id, chunk_index, total_chunks, len({words('text')}) AS n_tokens, length(text) AS text_length, substr(md5('_doc ' || doc_id || '_' || chunk_index || '_' || substr(text, 1, 50)), 1, 16) AS chunk_id,
            array_to_string(list_sort(list_distinct(list_concat({contained('text', X.TERMS)}, {found('lower(text)', T.REFERENCE)}))), '|') AS terms, text FROM o""",
    "relevant_passages": f"""WITH {TERM_QUERIES}, {index('documents', 'doc_id')}, {bm25('asked', 'plain', 1.2, 5)},
        sl AS (SELECT query_id, chunk_id, {sentences('text')} AS l FROM hits JOIN documents ON doc_id = chunk_id), se AS (SELECT query_id, chunk_id, len(l) AS n, unnest(range(len(l))) AS idx, unnest(l) AS sentence FROM sl),
        kd AS (SELECT DISTINCT chunk_id * 100000 + idx AS k, sentence FROM se), {hashed('kd', 'k', 'sv', 'sentence')}, {hashed('asked', 'query_id', 'qv')},
        sim AS (SELECT query_id, k, round(sum(a.v * s.v), 9) AS similarity FROM qv a JOIN sv s USING (b) GROUP BY ALL),
        m AS (SELECT se.*, coalesce(similarity, 0) AS similarity, row_number() OVER (PARTITION BY se.query_id, chunk_id ORDER BY coalesce(similarity, 0) DESC, idx DESC) <= 3 AS best FROM se LEFT JOIN sim ON sim.query_id = se.query_id AND k = chunk_id * 100000 + idx),
        b AS (SELECT *, coalesce(lag(best) OVER w, false) OR coalesce(lead(best) OVER w, false) AS beside FROM m WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY idx)),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY idx) AS place FROM b WHERE best OR beside AND similarity > 0.5 OR n <= 3)
        SELECT query_id::BIGINT AS query_id, chunk_id, place, idx, sentence FROM p WHERE place <= 4 OR n <= 3""",
    "context_budget": f"""WITH {TERM_QUERIES}, {index('documents', 'doc_id')}, {bm25('asked', 'okapi', 1.5, K)},
        c AS (SELECT query_id, rank, chunk_id, text, {sentences('text')} AS l FROM hits JOIN documents ON doc_id = chunk_id), e AS (SELECT query_id, rank, unnest(range(len(l))) AS i, unnest(l) AS s FROM c WHERE length(text) > 2000),
        u AS (SELECT *, sum(length(s)) OVER (PARTITION BY query_id, rank ORDER BY i) AS upto FROM e), g AS (SELECT query_id, rank, string_agg(s, ' ' ORDER BY i) AS cut FROM u WHERE upto <= 2000 GROUP BY ALL),
        w AS (SELECT query_id, rank, chunk_id, len({words("CASE WHEN length(text) > 2000 THEN coalesce(cut, '') ELSE text END")}) AS words FROM c LEFT JOIN g USING (query_id, rank)),
        r AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before FROM w)
        SELECT query_id::BIGINT AS query_id, rank, chunk_id, words, words_before FROM r WHERE words_before <= 1000""",
    "summary_mmr": f"""WITH {SCORED}, {diverse(5)} SELECT doc_id, CASE WHEN n <= 5 THEN idx + 1 ELSE step END AS rank, idx, sentence FROM m5 WHERE n <= 5 OR step IS NOT NULL""",
    "large_text_slices": "SELECT doc_id, i AS slice, i * 1000 AS start, substr(text, i * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE length(text) > 0)",
    "lexicon_hits": f"SELECT doc_id, len(l) AS hits, array_to_string(l, '|') AS terms FROM (SELECT doc_id, {contained('text', X.TERMS)} AS l FROM documents)",
    "lexicon_scores": f"WITH {SENT} SELECT doc_id, idx, {r6(tiers('sentence'))} AS score FROM sent",
    "intent_class": f"WITH {QUESTIONS} SELECT query_id::BIGINT AS query_id, {intent('text')} AS query_type FROM asked",
    "query_concepts": f"WITH {QUESTIONS} SELECT query_id::BIGINT AS query_id, array_to_string({contained('text', L.concept_terms())}, '|') AS key_concepts FROM asked",
    "query_expansion": f"WITH {QUESTIONS}, {EXPANDED} SELECT query_id::BIGINT AS query_id, unnest(range(len(forms))) AS ord, unnest(forms) AS text FROM expanded",
    "query_analysis": f"""WITH {QUESTIONS}, {EXPANDED} SELECT query_id::BIGINT AS query_id, query_type, array_to_string({found('text', T.CITATION)}, '|') AS citations,
        array_to_string({contained('text', L.concept_terms())}, '|') AS key_concepts, len(forms) AS n_expanded FROM expanded""",
    "concept_siblings": f"WITH t AS (SELECT * FROM {rows([(c, x) for c, xs in L.CONCEPTS.items() for x in xs], 'l', 'category, term')}) SELECT category, a.term, b.term AS sibling FROM t a JOIN t b USING (category) WHERE a.term <> b.term",
    "citations": f"WITH {CITED} SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS citation FROM (SELECT doc_id, {found('text', T.CITATION)} AS l FROM cited)",
    "statutes": f"WITH {CITED} SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS statute FROM (SELECT doc_id, {found('text', T.STATUTE)} AS l FROM cited)",
    "legal_terms": f"WITH {CITED} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({contained('text', L.KEYWORDS + X.TERMS)}, {found('lower(text)', T.REFERENCE)}))), '|') AS terms FROM cited",
    "chunk_entities": f"""WITH {CITED} SELECT doc_id, unnest(range(len(a) + len(b))) AS ord, unnest(list_concat(a, b)) AS text,
        unnest(list_concat(list_transform(a, lambda x: 'case_citation'), list_transform(b, lambda x: 'statute'))) AS entity_type,
        unnest(list_concat(list_transform(a, lambda x: 2.0::DOUBLE), list_transform(b, lambda x: 1.5::DOUBLE))) AS importance FROM (SELECT doc_id, {found('text', CASE_P)} AS a, {found('text', STATUTE_P)} AS b FROM cited)""",
    "entity_spans": "WITH " + CITED + "".join(
        f""", c{i} AS (SELECT doc_id, string_split(regexp_replace(text, {q('(' + p + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM cited),
        r{i} AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS text FROM c{i}),
        o{i} AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r{i})"""
        for i, p in enumerate((T.CHUNK_CITATION, T.STATUTE))
    ) + " " + " UNION ALL ".join(f"SELECT doc_id, text, {q(label)} AS label, start, start + length(text) AS \"end\" FROM o{i} WHERE i % 2 = 1" for i, label in enumerate(("PRECEDENT", "STATUTE"))),
    "entity_split": f"WITH {ORG} SELECT doc_id, label, text FROM split",
    "entity_counts": f"WITH {ORG} SELECT doc_id, label, string_agg(DISTINCT text, '|' ORDER BY text) AS entities, count(DISTINCT text) AS n_distinct FROM split GROUP BY ALL",
    "entity_totals": f"WITH {ORG} SELECT doc_id, count(*) AS total_entities, count(DISTINCT label) AS n_labels FROM split GROUP BY ALL",
    "entity_rollup": f"WITH {ORG} SELECT coalesce(doc_id, -1) AS doc_id, coalesce(label, '') AS label, count(*) AS n, count(DISTINCT text) AS n_distinct FROM split GROUP BY ROLLUP (doc_id, label)",
    "repetition_rate": f"""WITH {ORG}, p AS (SELECT doc_id, label, count(*) AS n, count(DISTINCT text) AS d FROM split GROUP BY ALL)
        SELECT doc_id, sum(n)::BIGINT AS total_entities, sum(d)::BIGINT AS unique_entities, round(sum(n) * 100.0 / sum(d))::BIGINT AS repetition_pct FROM p GROUP BY doc_id""",
    "special_token_filter": f"SELECT conv_id, sum(len({words('text')}))::BIGINT AS n_tokens, sum(len({words('text')}) + 3)::BIGINT AS n_raw FROM conversations GROUP BY conv_id",
    "postings": f"WITH {index('documents', 'doc_id')} SELECT * FROM post",
    "doc_freq": f"WITH {index('documents', 'doc_id')} SELECT * FROM freq",
    "idf_session": f"WITH {index('documents', 'doc_id')} SELECT term, df, {r6('idf')} AS idf FROM plain",
    "idf_okapi": f"WITH {index('documents', 'doc_id')} SELECT term, df, {r6('idf')} AS idf FROM okapi",
    "average_length": f"WITH {index('documents', 'doc_id')} SELECT n AS n_chunks, {r6('mean')} AS avg_dl FROM size",
    "bm25_session_topk": f"WITH {TERM_QUERIES}, {index('documents', 'doc_id')}, {bm25('asked', 'plain', 1.2, K)} SELECT query_id::BIGINT AS query_id, chunk_id, rank, {r6('score')} AS score FROM hits",
    "bm25_okapi_topk": f"WITH {TERM_QUERIES}, {index('documents', 'doc_id')}, {bm25('asked', 'okapi', 1.5, K)} SELECT query_id::BIGINT AS query_id, chunk_id, rank, {r6('score')} AS score FROM hits",
    "token_index": f"SELECT DISTINCT unnest({words('lower(substr(text, 1, 512))')}) AS token, doc_id AS chunk_id FROM documents",
    "concept_graph_edges": f"WITH {CITED}, {ENTITY}, {EDGES} SELECT * FROM edges",
    "graph_neighbors": f"""WITH {CITED}, {ENTITY}, {EDGES}, {BOTH}
        SELECT doc_id AS query_id, seed, near AS chunk_id FROM documents JOIN either_way ON seed = doc_id WHERE doc_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY near) <= 3""",
    "entity_match_scores": f"""WITH {CITED}, {ENTITY}, a AS (SELECT chunk_id AS query_id, upper(entity) AS e FROM entity WHERE chunk_id % 20 = 0), b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE e LIKE 'SECTION%')
        SELECT query_id, chunk_id, count(*)::DOUBLE AS score FROM b JOIN (SELECT DISTINCT chunk_id, lower(entity) AS e FROM entity) n ON lower(b.e) = n.e GROUP BY ALL""",
    "chunk_importance": f"WITH {CHUNKS} SELECT doc_id, chunk_ord, section, {r6(importance('section', 'text', X.TERMS))} AS importance FROM chunks",
    "dense_topk": f"""WITH {VEC} SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(round(list_dot_product(a.e, b.e), 9), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.vec_id) AS rank FROM v a, v b WHERE a.vec_id % 20 = 0 QUALIFY rank <= {K}""",
    "dense_overwrite": f"""WITH {VEC}, h AS (SELECT a.vec_id - a.vec_id % 20 AS query_id, a.vec_id AS f, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 20 < 3
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.vec_id) <= {2 * K})
        SELECT query_id, chunk_id, round(max_by(score, f), 6) AS score FROM h GROUP BY ALL""",
    "centroid_by_label": f"WITH {VEC} SELECT label::BIGINT AS label, dim, {r6('avg(x)')} AS value FROM x GROUP BY ALL",
    "cosine_to_centroid": f"""WITH {VEC}, c AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY ALL)
        SELECT vec_id, label::BIGINT AS label, {r6('sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)))')} AS cosine FROM x JOIN c USING (label, dim) GROUP BY vec_id, label""",
    "masked_mean_pool": f"""WITH {VEC}, c AS (SELECT label, dim, avg(x) AS m FROM x WHERE vec_id IN (SELECT vec_id FROM v WHERE e[1] >= 0) GROUP BY ALL)
        SELECT label::BIGINT AS label, dim, {r6('m / sqrt(sum(m * m) OVER (PARTITION BY label))')} AS value FROM c""",
    "vector_norms": f"""WITH {VEC} SELECT vec_id, {r6('sqrt(list_dot_product(e, e))')} AS norm, {r6('list_dot_product(e, e)')} AS dot,
        {r6('list_dot_product(e, list_reverse(e)) / list_dot_product(e, e)')} AS cosine, {r6('e[1] / sqrt(list_dot_product(e, e))')} AS "first" FROM v""",
    "hash_embedding": f"WITH {hashed('documents', 'doc_id', 'h')} SELECT doc_id, b AS bucket, v AS value FROM h_s WHERE v <> 0",
    "hybrid_fused_topk": f"WITH {FUSED} SELECT query_id, chunk_id, section, {r6('score')} AS score, rank FROM results",
    "answer_confidence": f"WITH {FUSED} SELECT query_id, {r6('least(avg(score) * 100, 100)')} AS confidence FROM results WHERE rank <= 3 GROUP BY query_id",
    "source_projection": f"""WITH {FUSED} SELECT query_id, rank, chunk_id, title, r.section, {r6('score')} AS score, substr(text, 1, 200) || '...' AS excerpt,
        array_to_string({entity_list('text')}[1:5], '|') AS entities FROM results r JOIN chunk USING (chunk_id)""",
    "prompt_context": f"""WITH {FUSED} SELECT query_id, string_agg('[' || rank || '] ' || title || ' (' || r.section || ', ' || printf('%.2f', round(score, 2)) || ')' || chr(10) || substr(text, 1, 800) || chr(10) || 'Entities: '
        || array_to_string({entity_list('text')}[1:3], ', '), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM results r JOIN chunk USING (chunk_id) GROUP BY query_id""",
    "session_hybrid_topk": f"""WITH {SESSION} SELECT query_id, chunk_id, {r6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY stage, r, chunk_id) AS rank FROM found QUALIFY rank <= {4 * K}""",
    "linear_rerank": f"""WITH {SESSION}, head AS (SELECT chunk_id, substr(text, 1, 512) AS text FROM chunk), {hashed('head', 'chunk_id', 'hv')},
        cs AS (SELECT f.query_id, f.chunk_id, sum(a.v * h.v) AS c FROM found f JOIN av a USING (query_id) JOIN hv h ON h.chunk_id = f.chunk_id AND h.b = a.b GROUP BY ALL),
        s AS (SELECT query_id, chunk_id, 0.6 * score + 0.4 * coalesce(c, 0) AS score FROM found LEFT JOIN cs USING (query_id, chunk_id))
        SELECT query_id, chunk_id, {r6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= {2 * K}""",
    "cross_rerank": f"""WITH {TERM_QUERIES}, {index('documents', 'doc_id')}, {bm25('asked', 'okapi', 1.5, K)},
        pair AS (SELECT query_id, chunk_id, unnest({words("lower(a.text || ' ' || substr(d.text, 1, 400))")}) AS t FROM hits JOIN asked a USING (query_id) JOIN documents d ON doc_id = chunk_id),
        m AS (SELECT query_id, chunk_id, 1 / (1 + exp(-sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE / 64)) AS score FROM pair GROUP BY ALL)
        SELECT query_id::BIGINT AS query_id, chunk_id, {r6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM m""",
    "token_vectors": f"""SELECT item_id, idx, token, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, CASE WHEN ('0x' || substr(md5(token), 9, 1))::BIGINT < 8 THEN 1.0 ELSE 0.0 END::DOUBLE AS most
        FROM (SELECT item_id, unnest(range(least(len(l), 512))) AS idx, unnest(l[1:512]) AS token FROM (SELECT item_id, {words('lower(text)')} AS l FROM benchmark))""",
    "position_scores": f"WITH {SENT} SELECT doc_id, idx, {r6(position('idx', 'count(*) OVER (PARTITION BY doc_id)'))} AS score FROM sent",
    "tfidf_sentence": f"WITH {TFIDF} SELECT doc_id, idx, {r6('tfidf')} AS tfidf FROM tfidf",
    "sentence_scores": f"WITH {SCORED} SELECT doc_id, idx, {', '.join(f'{r6(c)} AS {c}' for c in ('position', 'tfidf', 'lexicon', 'semantic', 'combined'))} FROM comb",
    "summary_topk": f"""WITH {SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(combined, 9) DESC, idx) AS r FROM comb QUALIFY r <= 5)
        SELECT doc_id, count(*) AS n_selected, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS indices, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM b GROUP BY doc_id""",
    "summary_stats": f"""WITH s AS (SELECT doc_id, text, array_to_string({sentences('text')}[1:3], ' ') AS summary FROM documents)
        SELECT doc_id, len({sentences('summary')}) AS summary_sentences, len(string_split(summary, ' ')) AS summary_words, round((1 - coalesce(length(summary)::DOUBLE / nullif(length(text), 0), 1)) * 100)::BIGINT AS compression_pct FROM s""",
    "session_status": "SELECT count(DISTINCT doc_id % 4) AS n_sessions, count(*) AS total_documents FROM documents",
    "session_info": "SELECT doc_id % 4 AS session_id, count(*) AS document_count, count(DISTINCT doc_id) AS n_titles, min('doc ' || doc_id) AS first_title FROM documents GROUP BY ALL",
    "session_titles": "SELECT DISTINCT doc_id % 4 AS session_id, 'doc ' || doc_id AS title FROM documents",
    "session_lookup": f"""WITH n AS (SELECT doc_id % 4 AS session_id, count(*) AS document_count FROM documents GROUP BY ALL)
        SELECT request_id::BIGINT AS request_id, coalesce(r.session_id, -1)::BIGINT AS session_id, document_count IS NOT NULL AS found, coalesce(document_count, 0) AS document_count
        FROM {rows(X.REQUESTS, 'r', 'request_id, session_id')} LEFT JOIN n ON n.session_id = r.session_id""",
    "session_append": """SELECT session_id, count(*) AS document_count, count(DISTINCT title) AS n_titles FROM (SELECT doc_id % 4 AS session_id, 'doc ' || doc_id AS title FROM documents
        UNION ALL SELECT item_id % 4, 'item ' || item_id FROM benchmark) GROUP BY session_id""",
    "context_rows": f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'doc ' || doc_id ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN quality ELSE toxic END::DOUBLE AS score,
        CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE 0 END AS chunk_index, CASE WHEN len({contained('text', X.TERMS)}) > 2 THEN array_to_string({contained('text', X.TERMS)}, '|') ELSE '' END AS terms, '' AS passages
        FROM labels JOIN documents USING (doc_id)""",
    "file_type": f"""WITH {FILES} SELECT filename, CASE WHEN ext IN ('txt', 'md') THEN 'text' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('docx', 'doc') THEN 'docx' WHEN ext IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'gif') THEN 'image'
        WHEN head LIKE '25504446%' THEN 'pdf' WHEN head LIKE '504B%' THEN 'docx' WHEN head LIKE 'FFD8FF%' OR head LIKE '89504E47%' OR head LIKE '47494638%' THEN 'image' ELSE 'text' END AS file_type FROM f""",
    "upload_validation": f"WITH {FILES} SELECT filename, ext IN ('txt', 'md', 'pdf', 'docx', 'doc', 'png', 'jpg', 'jpeg', 'tiff', 'bmp', 'gif') AND coalesce(file_size <= 52428800, true) AS accepted FROM f",
    "text_extraction": "SELECT 'd' || doc_id || '.txt' AS filename, 'text' AS file_type, octet_length(encode(text)) AS file_size, md5(text) AS digest, 'text-utf-8' AS extraction_method, length(trim(text)) > 0 AS success FROM documents",
    "nonblank_filter": r"SELECT role, count(*) AS n FROM conversations WHERE turn % 7 <> 0 AND regexp_replace(text, '\s+', '', 'g') <> '' GROUP BY role",
    "index_roundtrip": f"WITH {CHUNKS} SELECT doc_id, chunk_ord, chunk_id, section, doc_id % 4 AS session_id FROM chunks",
    "ocr_confidence": f"WITH {OCR.format(keys='l_orderkey AS page')} SELECT page, coalesce(text, '') AS text, {r6('coalesce(confidence, 0)')} AS confidence FROM p",
    "document_confidence": f"WITH {OCR.format(keys='l_suppkey AS doc, l_orderkey AS page')} SELECT doc, count(*) AS pages, {r6('min(coalesce(confidence, 0))')} AS min_confidence, {r6('avg(coalesce(confidence, 0))')} AS mean_confidence FROM p GROUP BY doc",
    "hypothetical_default": f"SELECT query_id::BIGINT AS query_id, NULL::VARCHAR AS hypothetical, text AS refined FROM {rows(X.QUESTIONS, 't', 'query_id, text')}",
    "event_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
