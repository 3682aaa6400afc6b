"""SQL equivalents of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from askgrid.functions.contracts import ANSWER_LABELS
from askgrid.functions.text import ENGLISH_STOP_WORDS
from askgrid.operators import selection as sel
from askgrid.sources.questionnaire import SHEETS


def lit(text: str) -> str:
    """A text as an SQL literal, line breaks included."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


STOP_LIST = ", ".join(lit(w) for w in ENGLISH_STOP_WORDS)


def terms(expr: str) -> str:
    return (rf"list_filter(regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}_]+'), "
            f"lambda t: t NOT IN ({STOP_LIST}))")


def words(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda w: w <> '')"


NL2 = "chr(10) || chr(10)"
DOCS = "SELECT doc_id AS node_id, text FROM documents"
QUESTIONS = "SELECT item_id AS query_id, text FROM benchmark"

CHUNKS = f"""
chunk_words AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM documents),
chunk_parents AS MATERIALIZED (
  SELECT doc_id, doc_id || '/' || i AS node_id, CAST(i AS INT) AS seq, n AS n_siblings,
         w[i * 3900 + 1 : i * 3900 + 4000] AS w
  FROM (SELECT doc_id, w, CAST(greatest(1, ceil((len(w) - 100) / 3900.0)) AS INT) AS n FROM chunk_words) c,
       LATERAL (SELECT unnest(range(c.n)) AS i)),
nodes AS MATERIALIZED (
  SELECT node_id, doc_id, 0 AS level, CAST(NULL AS VARCHAR) AS parent_id, seq, n_siblings,
         array_to_string(w, ' ') AS text
  FROM chunk_parents
  UNION ALL
  SELECT node_id || '/' || i, doc_id, 1, node_id, CAST(i AS INT), n,
         array_to_string(w[i * 156 + 1 : i * 156 + 256], ' ')
  FROM (SELECT *, CAST(greatest(1, ceil((len(w) - 100) / 156.0)) AS INT) AS n FROM chunk_parents) p,
       LATERAL (SELECT unnest(range(p.n)) AS i))"""


def postings(name: str, source: str, keep: str = "") -> str:
    extra = f"{keep}, " if keep else ""
    return f"""
{name} AS MATERIALIZED (
  SELECT node_id, {extra}dl, term, count(*) AS tf FROM (
    SELECT node_id, {extra}len(ts) AS dl, unnest(ts) AS term
    FROM (SELECT node_id, {extra}{terms('text')} AS ts FROM ({source})))
  GROUP BY ALL)"""


def bm25(name: str, index: str, corpus: str, queries: str, k: int, stems: str = "") -> str:
    """Ranking ``name`` of queries over the term table ``index`` of the corpus, its terms being
    those of the table ``stems`` where one is named."""
    term, join = ("stem AS term", f"JOIN {stems} USING (term)") if stems else ("term", "")
    return f"""
{name}_size AS (SELECT (SELECT count(*) FROM ({corpus})) AS n, (SELECT sum(tf) FROM {index}) AS total),
{name}_terms AS MATERIALIZED (
  SELECT DISTINCT query_id, {term} FROM (SELECT query_id, unnest({terms('text')}) AS term FROM ({queries})) {join}),
{name}_df AS MATERIALIZED (SELECT term, count(*) AS df FROM {index} GROUP BY term),
{name}_scores AS (
  SELECT query_id, node_id, round(sum(
    ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
      / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))), 6) AS score
  FROM {name}_terms JOIN {name}_df USING (term) JOIN {index} USING (term), {name}_size
  GROUP BY query_id, node_id),
{name} AS MATERIALIZED (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank FROM {name}_scores)
  WHERE rank <= {k})"""


def hashed(name: str, index: str, where: str = "true", keep: str = "") -> str:
    """Sparse unit vectors (node_id, bucket, x) of a term table."""
    extra = f", {keep}" if keep else ""
    return f"""
{name}_counts AS (
  SELECT node_id{extra}, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS INT) AS bucket, sum(tf) AS n
  FROM {index} WHERE {where} GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT node_id{extra}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY node_id)) AS x FROM {name}_counts)"""


def dense_hits(name: str, queries: str) -> str:
    """15 nearest leaves of each query by squared distance of their hashed vectors."""
    return f"""
{postings(name + '_qpost', f"SELECT query_id AS node_id, text FROM ({queries})").strip()},
{hashed(name + '_q', name + '_qpost').strip()},
{hashed(name + '_v', 'node_postings', 'level = 1', 'parent_id, n_siblings').strip()},
{name}_dots AS (
  SELECT q.node_id AS query_id, v.node_id, sum(q.x * v.x) AS dot
  FROM {name}_q q JOIN {name}_v v USING (bucket) GROUP BY ALL),
{name}_dist AS (
  SELECT q.query_id, l.node_id, l.parent_id, l.n_siblings,
         round(l.xx + q.xx - 2 * coalesce(d.dot, 0), 6) AS dist
  FROM (SELECT node_id AS query_id, sum(x * x) AS xx FROM {name}_q GROUP BY ALL) q
  CROSS JOIN (SELECT node_id, parent_id, n_siblings, sum(x * x) AS xx FROM {name}_v GROUP BY ALL) l
  LEFT JOIN {name}_dots d ON d.query_id = q.query_id AND d.node_id = l.node_id),
{name} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) AS rank FROM {name}_dist)
  WHERE rank <= 15)"""


def merged(name: str, hits: str) -> str:
    return f"""
{name}_groups AS MATERIALIZED (
  SELECT query_id, parent_id, count(*) AS n_hit, round(avg(dist), 6) AS dist, CAST(max(n_siblings) AS BIGINT) AS n_children,
         count(*) / max(n_siblings) AS ratio
  FROM {hits} GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) AS INT) AS rank FROM (
    SELECT query_id, node_id, dist, false AS merged FROM {hits} h
    WHERE NOT EXISTS (SELECT 1 FROM {name}_groups g WHERE g.query_id = h.query_id
                      AND g.parent_id = h.parent_id AND g.ratio > 0.2)
    UNION ALL SELECT query_id, parent_id, dist, true FROM {name}_groups WHERE ratio > 0.2))"""


def greedy(name: str, source: str) -> str:
    """Kept rows of (g, ord, text): walk in order, keep unless too similar to one kept."""
    return f"""
{name}_sets AS MATERIALIZED (
  SELECT g, ord, row_number() OVER (PARTITION BY g ORDER BY ord) AS i, ws, len(ws) AS n
  FROM (SELECT g, ord, list_distinct({words('lower(text)')}) AS ws FROM ({source}))),
{name}_pairs AS MATERIALIZED (
  SELECT g, lo, hi, similarity FROM (
    SELECT a.g, a.i AS lo, b.i AS hi, len(list_intersect(a.ws, b.ws)) AS c, a.n AS an, b.n AS bn,
           round(c / (an + bn - c), 6) AS similarity
    FROM {name}_sets a JOIN {name}_sets b ON a.g = b.g AND a.i < b.i
     AND least(a.n, b.n) * 20 > greatest(a.n, b.n) * 19)
  WHERE c * 20 > (an + bn - c) * 19),
{name}_todo AS MATERIALIZED (
  SELECT g, hi AS i, list(lo) AS dups, row_number() OVER (PARTITION BY g ORDER BY hi) AS step
  FROM {name}_pairs GROUP BY g, hi),
{name}_walk(g, step, gone) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM {name}_todo
  UNION ALL
  SELECT w.g, t.step, CASE WHEN len(list_filter(t.dups, lambda d: NOT list_contains(w.gone, d))) > 0
                           THEN list_append(w.gone, t.i) ELSE w.gone END
  FROM {name}_walk w JOIN {name}_todo t ON t.g = w.g AND t.step = w.step + 1),
{name}_gone AS MATERIALIZED (
  SELECT g, unnest(gone) AS i FROM {name}_walk
  WHERE (g, step) IN (SELECT (g, max(step)) FROM {name}_walk GROUP BY g)),
{name} AS MATERIALIZED (
  SELECT s.g, s.ord, s.i, d.i IS NULL AS kept FROM {name}_sets s LEFT JOIN {name}_gone d ON d.g = s.g AND d.i = s.i)"""


def cosine(name: str, pairs: str, index: str) -> str:
    """Scores (question_idx, node_id, score) of distinct pairs by cosine of term counts."""
    return f"""
{name}_q AS MATERIALIZED (
  SELECT question_idx, term, count(*) AS qtf
  FROM (SELECT item_id AS question_idx, unnest({terms('text')}) AS term FROM benchmark) GROUP BY ALL),
{name}_pairs AS MATERIALIZED (SELECT DISTINCT question_idx, node_id FROM {pairs}),
{name}_qn AS (SELECT question_idx, sqrt(sum(qtf * qtf)) AS qnorm FROM {name}_q GROUP BY ALL),
{name}_dn AS MATERIALIZED (
  SELECT node_id, sqrt(sum(tf * tf)) AS dnorm FROM {index}
  WHERE node_id IN (SELECT node_id FROM {name}_pairs) GROUP BY ALL),
{name}_dot AS (
  SELECT p.question_idx, p.node_id, sum(q.qtf * d.tf) AS dot
  FROM {name}_pairs p JOIN {name}_q q ON q.question_idx = p.question_idx
  JOIN {index} d ON d.node_id = p.node_id AND d.term = q.term GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT p.question_idx, p.node_id, coalesce(round(dot / (qnorm * dnorm), 6), 0.0) AS score
  FROM {name}_pairs p LEFT JOIN {name}_dot x ON x.question_idx = p.question_idx AND x.node_id = p.node_id
  LEFT JOIN {name}_qn qn ON qn.question_idx = p.question_idx LEFT JOIN {name}_dn dn ON dn.node_id = p.node_id)"""


def keywords(name: str, index: str, corpus: str) -> str:
    return f"""
{name}_w AS (
  SELECT query_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS w
  FROM (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({terms('text')}) AS term FROM ({QUESTIONS})))
  JOIN (SELECT term, count(*) AS df FROM {index} GROUP BY term) USING (term),
       (SELECT count(*) AS n FROM ({corpus}))),
{name} AS MATERIALIZED (
  SELECT query_id AS question_idx, string_agg(term, ', ' ORDER BY r) AS subquery FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS r FROM {name}_w)
  GROUP BY query_id)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"


DOC_INDEX = postings("doc_postings", DOCS)
NODE_INDEX = postings("node_postings", "SELECT * FROM nodes", "level, parent_id, n_siblings")
NODES = "SELECT node_id FROM nodes"
DOC_BM25 = with_(DOC_INDEX, bm25("hits", "doc_postings", DOCS, QUESTIONS, 15))


def scored_documents(k: int = 15) -> str:
    return with_(
        DOC_INDEX, bm25("hits", "doc_postings", DOCS, QUESTIONS, k),
        "cands AS (SELECT query_id AS question_idx, node_id, score AS bm25, rank AS idx FROM hits)",
        cosine("cos", "cands", "doc_postings"),
        "scored AS MATERIALIZED (SELECT c.*, s.score FROM cands c JOIN cos s USING (question_idx, node_id))",
        """ranked AS MATERIALIZED (SELECT *, CAST(row_number() OVER (
             PARTITION BY question_idx ORDER BY score DESC, idx) AS INT) AS rank FROM scored)""")


TOP_CONTEXTS = with_(
    DOC_INDEX, bm25("hits", "doc_postings", DOCS, QUESTIONS, 5),
    """tops AS MATERIALIZED (
         SELECT query_id AS question_idx, list(text ORDER BY rank) AS contexts, count(*) AS n
         FROM hits JOIN documents ON doc_id = node_id GROUP BY ALL)""")

STRIP = r"regexp_replace(c, '^\s+|\s+$', '', 'g')"
_ITEM_BEFORE, _ITEM_AFTER = sel.COMBINED_ITEM.split("{}")


def combined(contexts: str) -> str:
    return (
        f"CASE WHEN len({contexts}) = 0 THEN {lit(sel.NO_CONTEXT)} ELSE {lit(sel.COMBINED_HEADER)} || array_to_string("
        f"list_transform({contexts}, lambda c, i: {lit(_ITEM_BEFORE)} || i || {lit(_ITEM_AFTER)} || {STRIP} || {NL2}), '')"
        f" || {lit(sel.COMBINED_FOOTER)} END"
    )


PAGED = f"SELECT conv_id AS doc_id, string_agg(text, {NL2} ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
ALL_DOCS = f"""SELECT 0 AS source_order, CAST(doc_id AS VARCHAR) AS doc_key, text FROM ({PAGED})
UNION ALL SELECT 1, CAST(doc_id AS VARCHAR), text FROM documents"""

ANSWERS = f"""SELECT 'run-1' AS run_id, item_id AS question_id, text AS question,
 [{', '.join(lit(a) for a in ANSWER_LABELS)}][item_id % 4 + 1] AS answer,
 CAST(NULL AS VARCHAR) AS context, 'motivo' AS justification FROM benchmark"""
EVENT_ANSWERS = """SELECT 'run-1' AS run_id, user_id AS question_id, CAST(event_id AS VARCHAR) AS question,
 event_type AS answer, props AS context, CAST(NULL AS VARCHAR) AS justification,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events"""
UPDATED = f"""SELECT run_id, question_id, question,
 CASE WHEN doc_id IS NOT NULL THEN 'quality ' || quality ELSE answer END AS answer,
 CASE WHEN doc_id IS NOT NULL THEN NULL ELSE context END AS context,
 CASE WHEN doc_id IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'toxic' END ELSE justification END AS justification,
 CASE WHEN doc_id IS NOT NULL THEN '2024-06-01 00:00:00' ELSE ts END AS ts
 FROM ({EVENT_ANSWERS}) LEFT JOIN labels ON doc_id = question_id"""

CENTROIDS = """cents AS MATERIALIZED (
  SELECT label AS query_id, list(x ORDER BY i) AS v FROM (
    SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label),
vecs AS MATERIALIZED (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""

QUESTION_ROWS = """SELECT CAST(substr(source, 4) AS INT) AS sheet_no, source AS sheet, doc_id AS row_no,
 CASE WHEN quality IS NOT NULL THEN text END AS question FROM documents LEFT JOIN labels USING (doc_id)"""

SUBQUERY_REPLY = r"""SELECT doc_id, doc_id % 5 AS kind, text AS head FROM documents"""
ANSWER_PARSED = """SELECT doc_id,
 CASE doc_id % 5 WHEN 1 THEN 'Errore durante la generazione della risposta: JSON di risposta non valido o incompleto'
  WHEN 2 THEN 'Errore durante la generazione della risposta: JSON di risposta non valido o incompleto'
  WHEN 4 THEN 'Errore durante la generazione della risposta: JSON non leggibile' END AS answer_err,
 CASE doc_id % 5 WHEN 0 THEN 'Si' WHEN 3 THEN 'Forse' END AS response,
 CASE doc_id % 5 WHEN 0 THEN text WHEN 3 THEN '?' END AS justification, source FROM documents"""

MESSAGES = """'[' || to_json({{'role': 'system', 'content': 'S'}}) || ',' || to_json({{'role': 'user', 'content': {}}}) || ']'"""

QUERY_TABLE = """SELECT {'question_idx': item_id, 'subquery_no': 0} AS query_id, text FROM benchmark
 UNION ALL SELECT {'question_idx': question_idx, 'subquery_no': 1}, subquery FROM kw"""


def hybrid(queries: str) -> tuple[str, ...]:
    """Merged dense hits then BM25 hits of all queries, as ``found``."""
    return (
        dense_hits("near", queries), merged("dense", "near"),
        bm25("sparse", "node_postings", NODES, queries, 15),
        """found AS MATERIALIZED (
             SELECT query_id, node_id, rank, 0 AS source_order FROM dense
             UNION ALL SELECT query_id, node_id, rank, 1 FROM sparse)""",
    )


def candidate_ctes(kw_filter: str = "true") -> tuple[str, ...]:
    queries = QUERY_TABLE + f" WHERE {kw_filter}"
    return (
        CHUNKS, NODE_INDEX, keywords("kw", "node_postings", NODES), *hybrid(queries),
        """cands AS MATERIALIZED (
             SELECT query_id.question_idx AS question_idx, query_id.subquery_no AS subquery_no, source_order, rank,
                    node_id, printf('%06d-%d-%06d', query_id.subquery_no, source_order, rank) AS ord
             FROM found)""",
    )


def context_ctes(kw_filter: str = "true") -> tuple[str, ...]:
    return (
        *candidate_ctes(kw_filter),
        greedy("dd", "SELECT question_idx AS g, ord, text FROM cands JOIN nodes USING (node_id)"),
        """stay AS MATERIALIZED (
             SELECT c.question_idx, c.ord, c.node_id FROM cands c JOIN dd ON dd.g = c.question_idx AND dd.ord = c.ord
             WHERE dd.kept)""",
        cosine("cos", "stay", "node_postings"),
        """best AS MATERIALIZED (
             SELECT question_idx, rank, node_id, score, text FROM (
               SELECT s.*, c.score, CAST(row_number() OVER (
                 PARTITION BY s.question_idx ORDER BY c.score DESC, s.ord) AS INT) AS rank
               FROM stay s JOIN cos c USING (question_idx, node_id))
             JOIN nodes USING (node_id) WHERE rank <= 5)""",
    )


def assessment() -> str:
    pick = combined("contexts")
    return with_(
        *context_ctes("question_idx % 11 <> 10"),
        "lists AS (SELECT question_idx, list(text ORDER BY rank) AS contexts FROM best GROUP BY ALL)",
        f"""staged AS MATERIALIZED (
          SELECT item_id AS question_idx, text AS question, item_id % 8 AS choice,
                 coalesce(contexts, []) AS contexts, len(coalesce(contexts, [])) AS n,
                 item_id % 11 = 10 AS no_expansion, item_id % 7 = 6 AS no_answer
          FROM benchmark LEFT JOIN lists ON question_idx = item_id)""",
        f"""routed AS MATERIALIZED (
          SELECT question_idx, question,
            CASE WHEN no_expansion THEN {lit(sel.ERROR_RETRIEVAL)} WHEN n = 0 THEN {lit(sel.ERROR_RERANK)}
                 WHEN choice = n + 2 THEN 'SKIPPED' WHEN choice = 0 OR choice > n + 2 THEN NULL
                 WHEN no_answer THEN 'Error' ELSE 'Si' END AS answer,
            CASE WHEN no_expansion OR n = 0 THEN NULL WHEN choice = n + 2 THEN 'N/A' WHEN no_answer THEN NULL
                 WHEN choice = n + 1 THEN {pick} ELSE contexts[choice] END AS context,
            CASE WHEN no_expansion THEN 'Errore nella query expansion: Campo ''sotto_query'' mancante o non valido'
                 WHEN n = 0 THEN {lit(sel.NOTHING_LEFT)} WHEN choice = n + 2 THEN {lit(sel.SKIPPED_REASON)}
                 WHEN no_answer THEN 'Processing failed: Errore durante la generazione della risposta: JSON di risposta non valido o incompleto'
                 ELSE 'q' || question_idx END AS justification
          FROM staged)""",
    ) + """SELECT row_number() OVER (ORDER BY question_idx) - 1 AS question_id, * FROM routed WHERE answer IS NOT NULL"""


# The suffixes of the published stemming steps, written out apart from the code under test.
_SUFFIXES_2 = dict(p.split(":") for p in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble").split())
_SUFFIXES_3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_SUFFIXES_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _vc(shape: str) -> str:
    return f"((len({shape}) - len(replace({shape}, 'VC', ''))) // 2)"


def _less(c: str, n: str | int) -> str:
    return f"left({c}, (len({c}) - {n})::BIGINT)"


def _shape(word: str) -> str:
    known = f"regexp_replace(regexp_replace({word}, '[^aeiouy]', 'C', 'g'), '[aeiou]', 'V', 'g')"
    return f"""list_reduce(list_prepend('', string_split({known}, '')), lambda a, x:
      a || CASE WHEN x <> 'y' THEN x WHEN right(a, 1) = 'C' THEN 'V' ELSE 'C' END)"""


def _swap(name: str, source: str, rules: dict[str, str]) -> str:
    """Words (term, w, s) with the longest suffix of the rules replaced."""
    new = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items())
    base, shape = _less("w", "len(x)"), _less("s", "len(x)")
    return f"""
{name} AS (
  SELECT term, CASE WHEN hit THEN w2 ELSE w END AS w, CASE WHEN hit THEN {shape} || regexp_replace(regexp_replace(
           substr(w2, len({base}) + 1), '[aeiou]', 'V', 'g'), '[a-z]', 'C', 'g') ELSE s END AS s
  FROM (SELECT *, len(x) > 0 AND {_vc(shape)} > 0 AS hit, {base} || CASE x {new} END AS w2
        FROM (SELECT *, regexp_extract(w, '({"|".join(rules)})$') AS x FROM {source})))"""


def porter(name: str, source: str) -> str:
    """Stems (term, stem) of a table of terms; suffix by suffix, as published."""
    cvc = "(s LIKE '%CVC' AND NOT regexp_matches(w, '[wxy]$'))"
    cvc_e = f"({_less('s', 1)} LIKE '%CVC' AND NOT regexp_matches({_less('w', 1)}, '[wxy]$'))"
    m_e = _vc(_less("s", 1))
    return f"""
{name}_0 AS (SELECT term, term AS w, {_shape('term')} AS s FROM ({source})),
{name}_1a AS (
  SELECT term, {_less('w', 'n')} AS w, {_less('s', 'n')} AS s FROM (SELECT *, CASE WHEN regexp_matches(w, '(sses|ies)$') THEN 2
    WHEN regexp_matches(w, '[^s]s$') THEN 1 ELSE 0 END AS n FROM {name}_0)),
{name}_1b AS (
  SELECT term, {_less('w', 'n')} AS w, {_less('s', 'n')} AS s, x <> 'eed' AND n > 0 AS cut FROM (
    SELECT *, CASE WHEN x = 'eed' THEN CASE WHEN {_vc(_less('s', 3))} > 0 THEN 1 ELSE 0 END
      WHEN x <> '' AND contains({_less('s', 'len(x)')}, 'V') THEN len(x) ELSE 0 END AS n
    FROM (SELECT *, regexp_extract(w, '(eed|ed|ing)$') AS x FROM {name}_1a))),
{name}_1c AS (
  SELECT term, CASE WHEN grow THEN w || 'e' WHEN halve THEN {_less('w', 1)} ELSE w END AS w,
         CASE WHEN grow THEN s || 'V' WHEN halve THEN {_less('s', 1)} ELSE s END AS s
  FROM (SELECT *, cut AND (regexp_matches(w, '(at|bl|iz)$') OR ({_vc('s')} = 1 AND {cvc})) AS grow,
          cut AND right(w, 1) = substr(w, len(w) - 1, 1) AND len(w) > 1 AND s LIKE '%C' AND right(w, 1) NOT IN ('l', 's', 'z') AS halve
        FROM {name}_1b)),
{name}_1d AS (
  SELECT term, CASE WHEN turn THEN {_less('w', 1)} || 'i' ELSE w END AS w, CASE WHEN turn THEN {_less('s', 1)} || 'V' ELSE s END AS s
  FROM (SELECT *, w LIKE '%y' AND contains({_less('s', 1)}, 'V') AS turn FROM {name}_1c)),{_swap(name + '_2', name + '_1d', _SUFFIXES_2)},{
    _swap(name + '_3', name + '_2', _SUFFIXES_3)},
{name}_4 AS (
  SELECT term, {_less('w', 'n')} AS w, {_less('s', 'n')} AS s FROM (
    SELECT *, CASE WHEN len(x) > 0 AND {_vc(_less('s', 'len(x)'))} > 1 AND (w NOT LIKE '%ion' OR regexp_matches(w, '[st]ion$'))
      THEN len(x) ELSE 0 END AS n FROM (SELECT *, regexp_extract(w, '({"|".join(_SUFFIXES_4)})$') AS x FROM {name}_3))),
{name}_5 AS (
  SELECT term, CASE WHEN drops THEN {_less('w', 1)} ELSE w END AS w, CASE WHEN drops THEN {_less('s', 1)} ELSE s END AS s
  FROM (SELECT *, w LIKE '%e' AND ({m_e} > 1 OR ({m_e} = 1 AND NOT {cvc_e})) AS drops FROM {name}_4)),
{name} AS MATERIALIZED (
  SELECT term, CASE WHEN len(term) <= 2 THEN term WHEN w LIKE '%ll' AND {_vc('s')} > 1 THEN {_less('w', 1)} ELSE w END AS stem
  FROM {name}_5)"""


ORACLE: dict[str, str] = {
    "bm25_stemmed": with_(
        DOC_INDEX, porter("stems", f"SELECT term FROM doc_postings UNION SELECT unnest({terms('text')}) FROM benchmark"),
        """stem_postings AS MATERIALIZED (
             SELECT node_id, dl, stem AS term, sum(tf) AS tf FROM doc_postings JOIN stems USING (term) GROUP BY ALL)""",
        bm25("hits", "stem_postings", DOCS, QUESTIONS, 15, "stems")) + "SELECT query_id, node_id, score, rank FROM hits",
    "udf_embed_model": """
 SELECT doc_id AS node_id, CAST(b AS INT) AS bucket, CAST(len(list_filter(codes, lambda c: c % 16 = b)) AS FLOAT) AS x
 FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN c = '' THEN -1 ELSE unicode(c) END) AS codes
       FROM documents), range(16) AS r(b)""",
    "answer_questions_model": """
 SELECT item_id AS question_idx, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 'Si' ELSE 'No' END AS response,
        CASE WHEN n % 5 = 0 THEN NULL ELSE 'length ' || n END AS justification, n % 5 = 0 AS failed
 FROM (SELECT item_id, length('Query: ' || b.text || chr(10) || ' Context: ' || d.source) AS n
       FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)""",
    "udf_stem": with_(DOC_INDEX, porter("stems", "SELECT DISTINCT term FROM doc_postings")) + "SELECT term, stem FROM stems",
    "src_markdown": "SELECT text || chr(10) AS text, length(text) + 1 AS n_chars FROM benchmark",
    "src_page_assembly": PAGED,
    "src_union_documents": ALL_DOCS,
    "src_quarantine": r"""SELECT CAST(doc_id AS VARCHAR) AS path,
 CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'rejected' ELSE 'loaded' END AS status,
 CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 0 ELSE length(text) END AS n_chars FROM documents""",
    "src_load_count": f"SELECT source_order, count(*) AS n_documents FROM ({ALL_DOCS}) GROUP BY source_order",
    "src_questionnaire": f"""SELECT CAST(item_id % 6 AS INT) AS sheet_no, [{', '.join(lit(s) for s in SHEETS)}][item_id % 6 + 1] AS sheet,
 item_id + 1 AS row_no, text AS question FROM benchmark""",
    "sink_append_response": f"""{ANSWERS} UNION ALL
 SELECT 'run-2', conv_id * 1000 + turn, text, role, text, 'turno' FROM conversations""",
    "sink_append_legacy": f"""{ANSWERS} UNION ALL
 SELECT NULL, conv_id * 1000 + turn, text, role, NULL, NULL FROM conversations""",
    "src_responses": EVENT_ANSWERS,
    "sink_update_response": UPDATED,
    "sink_upsert_response": """SELECT question_id, answer, version FROM (
 SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY version DESC) AS r FROM (
  SELECT doc_id AS question_id, 'stored' AS answer, CAST(-1 AS BIGINT) AS version FROM labels
  UNION ALL SELECT user_id, event_type, event_id FROM events)) WHERE r = 1""",
    "proj_drop_positional": """SELECT l_orderkey * 10 + l_linenumber AS row_no, l_orderkey, l_partkey,
 l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem""",
    "proj_promote_header": "SELECT item_id + 1 AS row_no, CAST(item_id AS VARCHAR) AS id, text AS question FROM benchmark",
    "filter_nonnull_questions": f"""SELECT *, row_number() OVER (ORDER BY sheet_no, row_no) - 1 AS question_idx
 FROM ({QUESTION_ROWS}) WHERE question IS NOT NULL""",
    "filter_sheet_schema": """SELECT 0 AS sheet_no, 'documents' AS sheet, count(text) AS n_questions FROM documents
 UNION ALL SELECT 2, 'benchmark', count(text) FROM benchmark
 UNION ALL SELECT 3, 'conversations', count(text) FROM conversations""",
    "filter_leaf_nodes": with_(CHUNKS) + """SELECT node_id, doc_id, level, parent_id, seq FROM nodes
 WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)""",
    "filter_root_nodes": with_(CHUNKS) + "SELECT node_id, doc_id, level, seq FROM nodes WHERE parent_id IS NULL",
    "filter_relevance_grade": "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic <> 1",
    "filter_similarity_topk": with_(CENTROIDS,
        "firsts AS (SELECT label AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label)") + """SELECT query_id, node_id, similarity, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS INT) AS rank FROM (
  SELECT query_id, node_id, round(list_cosine_similarity(v, vector), 6) AS similarity FROM firsts, vecs)
 WHERE similarity >= 0.5) WHERE rank <= 2""",
    "proj_attach_metadata": with_(CHUNKS) + rf"""SELECT node_id, source, level, CAST(length(n.text) AS INT) AS n_chars,
 CAST(len({words('n.text')}) AS INT) AS n_tokens, parent_id IS NULL AS is_root FROM nodes n JOIN documents USING (doc_id)""",
    "proj_text_field": """SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN text
 ELSE '{"title":"' || source || '"}' END AS text FROM documents""",
    "proj_preview": """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview,
 substr(text, 1, 100) || '...' AS log_line FROM documents""",
    "proj_question_id": """SELECT doc_id AS question_idx, quality, row_number() OVER (ORDER BY doc_id) - 1 AS question_id
 FROM documents JOIN labels USING (doc_id)""",
    "route_outcome": f"""SELECT doc_id AS question_idx,
 [{', '.join(lit(s) for s in ('expansion failed', 'reranking failed', 'reranking failed', 'skipped', 'undecided', 'answer failed', 'answered', 'answered'))}][doc_id % 8 + 1] AS outcome,
 CASE doc_id % 8 WHEN 0 THEN {lit(sel.ERROR_RETRIEVAL)} WHEN 1 THEN {lit(sel.ERROR_RERANK)} WHEN 2 THEN {lit(sel.ERROR_RERANK)}
  WHEN 3 THEN 'SKIPPED' WHEN 4 THEN NULL WHEN 5 THEN 'Error' ELSE CASE WHEN quality = 1 THEN 'Si' ELSE 'No' END END AS answer,
 CASE WHEN doc_id % 8 = 3 THEN 'N/A' WHEN doc_id % 8 >= 6 THEN source END AS context,
 CASE doc_id % 8 WHEN 0 THEN 'no reply' WHEN 1 THEN 'scorer failed' WHEN 2 THEN {lit(sel.NOTHING_LEFT)}
  WHEN 3 THEN {lit(sel.SKIPPED_REASON)} WHEN 4 THEN NULL WHEN 5 THEN 'Processing failed: bad reply'
  ELSE 'lang ' || lang END AS reason
 FROM documents LEFT JOIN labels USING (doc_id)""",
    "select_context": TOP_CONTEXTS + f"""SELECT question_idx, CASE WHEN k = 8 THEN 'none' ELSE CAST(k AS VARCHAR) END AS choice,
 CASE WHEN k BETWEEN 1 AND n THEN 'one' WHEN k = n + 1 AND k <> 8 THEN 'all' WHEN k = n + 2 AND k <> 8 THEN 'skipped' ELSE 'undecided' END AS decision,
 CASE WHEN k BETWEEN 1 AND n THEN contexts[k] WHEN k = n + 1 AND k <> 8 THEN {combined('contexts')} END AS selected
 FROM (SELECT *, question_idx % 9 AS k FROM tops)""",
    "select_context_label": TOP_CONTEXTS + f"""SELECT question_idx, label,
 CASE WHEN k = 7 THEN 'all' WHEN k = 6 THEN 'skipped' WHEN k >= 8 THEN 'bad format'
  WHEN k * 2 - 1 BETWEEN 1 AND n THEN 'one' ELSE 'bad number' END AS decision,
 CASE WHEN k = 7 THEN {combined('contexts')} WHEN k < 6 AND k * 2 - 1 BETWEEN 1 AND n THEN contexts[k * 2 - 1] END AS selected,
 CASE WHEN k = 6 THEN {lit(sel.STATUS_SKIPPED)} WHEN k >= 8 THEN {lit(sel.STATUS_BAD_FORMAT)}
  WHEN k < 6 AND NOT (k * 2 - 1 BETWEEN 1 AND n) THEN {lit(sel.STATUS_BAD_NUMBER)}
  WHEN question_idx % 20 >= 10 THEN {lit(sel.STATUS_UPDATED)} ELSE {lit(sel.STATUS_ANSWERED)} END AS status
 FROM (SELECT *, question_idx % 10 AS k, CASE question_idx % 10 WHEN 9 THEN '' WHEN 8 THEN 'Contesto x'
   WHEN 7 THEN {lit(sel.CHOICE_ALL)} WHEN 6 THEN {lit(sel.CHOICE_SKIP)}
   ELSE 'Contesto ' || (question_idx % 10 * 2 - 1) END AS label FROM tops)""",
    "filter_until_interrupt": """SELECT event_id, event_type, value FROM events WHERE event_id < coalesce(
 (SELECT min(event_id) FROM events WHERE event_type = 'error' AND value > 300), 9223372036854775807)""",
    "list_context_choices": TOP_CONTEXTS + f"""SELECT question_idx, CAST(i - 1 AS INT) AS choice_no,
 CASE WHEN i <= n THEN {lit(sel.CHOICE_ITEM)} || i WHEN i = n + 1 THEN {lit(sel.CHOICE_ALL)} ELSE {lit(sel.CHOICE_SKIP)} END AS choice
 FROM tops, LATERAL (SELECT unnest(range(1, n + 3)) AS i)""",
    "knn_l2_exact": with_(CENTROIDS) + """SELECT query_id, node_id, dist, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) AS INT) AS rank FROM (
  SELECT query_id, node_id, round(list_sum(list_transform(list_zip(v, vector), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist
  FROM cents, vecs)) WHERE rank <= 15""",
    "bm25_topk": DOC_BM25 + "SELECT query_id, node_id, score, rank FROM hits",
    "auto_merge": with_(CHUNKS, NODE_INDEX, dense_hits("near", QUESTIONS), merged("dense", "near"))
    + "SELECT query_id, node_id, dist, merged, rank FROM dense",
    "join_docstore": with_(CHUNKS, NODE_INDEX, bm25("hits", "node_postings", NODES, QUESTIONS, 5))
    + "SELECT query_id, rank, node_id, text FROM hits JOIN nodes USING (node_id)",
    "join_rank_to_context": scored_documents() + """SELECT question_idx, idx, rank, text FROM ranked JOIN documents ON doc_id = node_id WHERE rank <= 5""",
    "dedup_jaccard": with_(greedy("dd", "SELECT lang AS g, doc_id AS ord, text FROM documents"))
    + "SELECT g AS lang, ord AS doc_id FROM dd WHERE kept",
    "jaccard_pairs_corpus": with_(greedy("dd", "SELECT 1 AS g, doc_id AS ord, text FROM documents"))
    + """SELECT h.ord AS dup_item, arg_min(l.ord, p.lo) AS kept_item, arg_min(p.similarity, p.lo) AS similarity
 FROM dd_pairs p JOIN dd h ON h.i = p.hi AND NOT h.kept JOIN dd l ON l.i = p.lo AND l.kept GROUP BY h.ord""",
    "join_update_mask": f"SELECT answer, count(*) AS n_rows FROM ({UPDATED}) GROUP BY answer",
    "term_statistics": with_(DOC_INDEX) + """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
 round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
 FROM doc_postings GROUP BY term""",
    "merge_ratio": with_(CHUNKS, NODE_INDEX, dense_hits("near", QUESTIONS), merged("dense", "near"))
    + "SELECT query_id, parent_id, n_hit, n_children, round(ratio, 6) AS ratio, dist FROM dense_groups",
    "combine_contexts": TOP_CONTEXTS + f"SELECT question_idx, {combined('contexts')} AS combined FROM tops",
    "format_docs": TOP_CONTEXTS + f"SELECT question_idx, array_to_string(contexts, {NL2}) AS context FROM tops",
    "rerank_metrics": """SELECT event_type AS device, count(*) AS total_queries, round(sum(value), 4) AS total_time,
 round(sum(value) / greatest(count(*), 1), 4) AS average_time_per_query FROM events GROUP BY event_type""",
    "stage_metrics": """SELECT query_id, round(v, 4) AS view_time, round(c, 4) AS click_time, round(p, 4) AS purchase_time,
 round(s, 4) AS signup_time, round(e, 4) AS error_time, round(v + c + p + s + e, 4) AS total_time FROM (SELECT user_id AS query_id,
  coalesce(sum(value) FILTER (event_type = 'view'), 0) AS v, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS c,
  coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS p, coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS s,
  coalesce(sum(value) FILTER (event_type = 'error'), 0) AS e FROM events GROUP BY user_id)""",
    "dedup_counts": with_(greedy("dd", "SELECT lang AS g, doc_id AS ord, text FROM documents"))
    + "SELECT g AS lang, count(*) AS n_before, count(*) FILTER (kept) AS n_after FROM dd GROUP BY g",
    "exists_any": "SELECT coalesce(bool_or(event_type = 'error' AND value > 400), false) AS found FROM events",
    "vector_dimension": """SELECT CAST(min(len(embedding)) AS INT) AS min_dim, CAST(max(len(embedding)) AS INT) AS max_dim,
 count(*) AS n_vectors, min(len(embedding)) = max(len(embedding)) AS is_constant FROM embeddings""",
    "rank_per_question": scored_documents() + "SELECT question_idx, node_id, idx, score, rank FROM ranked",
    "question_progress": f"""SELECT row_number() OVER (ORDER BY doc_id) AS position, n AS total, source AS question,
 'Domanda ' || row_number() OVER (ORDER BY doc_id) || ' di ' || n AS progress
 FROM documents, (SELECT count(*) AS n FROM documents)
 UNION ALL SELECT count(*) + 1, count(*), {lit(sel.ALL_DONE)}, {lit(sel.DONE)} FROM documents""",
    "sheet_head": f"""SELECT sheet, row_no, place, question FROM (SELECT *, CAST(row_number() OVER (
 PARTITION BY sheet ORDER BY row_no) AS INT) AS place FROM ({QUESTION_ROWS})) WHERE place <= 5""",
    "rerank_topn": scored_documents() + "SELECT question_idx, node_id, idx, score, rank FROM ranked WHERE rank <= 10",
    "rerank_keep_original": scored_documents()
    + "SELECT question_idx, node_id, score, bm25 AS original_score, rank FROM ranked WHERE rank <= 5",
    "top5_contexts": scored_documents() + "SELECT question_idx, rank, node_id, score FROM ranked WHERE rank <= 5",
    "limit_k_prerank": scored_documents(20) + """SELECT question_idx, reranked, rank, node_id, retrieval_rank FROM (
 SELECT question_idx, true AS reranked, CAST(row_number() OVER (PARTITION BY question_idx ORDER BY score DESC, idx) AS INT) AS rank,
  node_id, idx AS retrieval_rank FROM scored WHERE idx <= 20
 UNION ALL SELECT question_idx, false, idx, node_id, idx FROM scored WHERE idx <= 20) WHERE rank <= 5""",
    "hybrid_union": with_(CHUNKS, NODE_INDEX, *hybrid(QUESTIONS))
    + "SELECT query_id, node_id, rank, source_order FROM found",
    "union_subqueries": with_(*candidate_ctes()) + "SELECT * FROM cands",
    "jaccard_similarity": f"""SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0
 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS similarity FROM (
 SELECT x.conv_id, x.turn, list_distinct({words('lower(x.text)')}) AS a, list_distinct({words('lower(y.text)')}) AS b
 FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)""",
    "chunk_hierarchical": with_(CHUNKS) + "SELECT * FROM nodes",
    "tokenize_ws": f"""SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, max(word) AS last_word
 FROM (SELECT doc_id, unnest({words('lower(text)')}) AS word FROM documents) GROUP BY doc_id""",
    "tokenize_terms": f"""SELECT doc_id, term, count(*) AS tf
 FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY ALL""",
    "parse_subqueries": f"""SELECT doc_id, CASE kind WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_subqueries,
 CASE kind WHEN 0 THEN head || '|' || head WHEN 3 THEN 'due' ELSE '' END AS joined,
 CASE kind WHEN 2 THEN 'Errore nella query expansion: Campo ''sotto_query'' mancante o non valido'
  WHEN 4 THEN 'Errore nella query expansion: JSON non leggibile' END AS expand_err FROM ({SUBQUERY_REPLY})""",
    "parse_answer": f"SELECT * EXCLUDE (source) FROM ({ANSWER_PARSED})",
    "build_prompt": f"""SELECT conv_id, turn, {MESSAGES.format("'Espandi questa query: ' || role")} AS expansion,
 {MESSAGES.format("'Query: ' || role || chr(10) || ' Context: ' || text")} AS answer,
 {MESSAGES.format("'Query: ' || role || chr(10) || chr(10) || 'Contesto: ' || text")} AS grade FROM conversations""",
    "strip_text": r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents",
    "format_ts": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events",
    "array_slice": f"""SELECT doc_id, array_to_string(({words('text')})[1:5], ' ') AS first_words,
 substr(text, 1, 500) AS opening FROM documents""",
    "safe_ratio": """SELECT user_id, round(CASE WHEN c = 0 THEN 0 ELSE p / c END, 6) AS guarded,
 round(p / greatest(c, 1), 6) AS average FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS c,
  count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)""",
    "map_lookup_default": """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k,
 coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""",
    "stream_questions": DOC_BM25 + "SELECT query_id, node_id, score, rank FROM hits",
    "stream_upsert_latest": """SELECT user_id AS question_id, arg_max(event_type, event_id) AS answer, max(event_id) AS version
 FROM events GROUP BY user_id""",
    "udf_embed": with_(DOC_INDEX, hashed("v", "doc_postings")) + "SELECT node_id, bucket, round(x, 6) AS x FROM v",
    "udf_score_pair": DOC_BM25 + f"""SELECT query_id AS question_idx, node_id, CAST(len(list_intersect(
 list_distinct({words('lower(d.text)')}), list_distinct({words('lower(b.text)')}))) AS DOUBLE) AS score
 FROM hits JOIN documents d ON doc_id = node_id JOIN benchmark b ON item_id = query_id""",
    "udf_infer": f"""SELECT conv_id, turn, length({MESSAGES.format("'Query: ' || role || chr(10) || chr(10) || 'Contesto: ' || text")}) % 2 = 0 AS is_relevant
 FROM conversations""",
    "keyword_subquery": with_(DOC_INDEX, keywords("kw", "doc_postings", DOCS)) + "SELECT question_idx, subquery FROM kw",
    "build_index": with_(CHUNKS, NODE_INDEX) + """SELECT * FROM
 (SELECT level, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_docs FROM nodes GROUP BY level) LEFT JOIN
 (SELECT level, CAST(sum(tf) AS BIGINT) AS n_terms, count(*) AS n_postings FROM node_postings GROUP BY level) USING (level)""",
    "expand_questions": with_(DOC_INDEX, keywords("kw", "doc_postings", DOCS))
    + """SELECT item_id AS question_idx, CASE WHEN subquery IS NULL THEN 'Errore nella query expansion: JSON non leggibile' END AS expand_err,
 CASE WHEN subquery IS NULL THEN 0 ELSE 1 END AS n_subqueries, CASE WHEN subquery IS NOT NULL THEN 1 END AS subquery_no, subquery
 FROM benchmark LEFT JOIN kw ON question_idx = item_id""",
    "answer_questions": f"SELECT doc_id AS question_idx, source AS selected, answer_err, response, justification FROM ({ANSWER_PARSED})",
    "retrieve_contexts": with_(*context_ctes()) + "SELECT question_idx, rank, node_id, score, text FROM best",
    "assess_questionnaire": assessment(),
    "rag_answer": with_(
        DOC_INDEX, bm25("hits", "doc_postings", DOCS, QUESTIONS, 20),
        "cands AS (SELECT query_id AS question_idx, node_id, rank AS idx FROM hits)",
        cosine("cos", "cands", "doc_postings"),
        """best AS MATERIALIZED (SELECT * FROM (SELECT c.*, row_number() OVER (
             PARTITION BY question_idx ORDER BY score DESC, idx) AS rank FROM cands c JOIN cos USING (question_idx, node_id))
           WHERE rank <= 5)""")
    + f"""SELECT b.item_id AS question_idx, r.retrieved, s.reranked, s.context FROM benchmark b
 LEFT JOIN (SELECT question_idx, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY idx) AS retrieved FROM cands GROUP BY ALL) r
  ON r.question_idx = b.item_id
 LEFT JOIN (SELECT question_idx, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY rank) AS reranked,
  string_agg(text, {NL2} ORDER BY rank) AS context FROM best JOIN documents ON doc_id = node_id GROUP BY ALL) s
  ON s.question_idx = b.item_id""",
}
