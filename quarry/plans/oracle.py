"""Independent SQL (DuckDB dialect) for the named queries of
:mod:`quarry.plans.catalog`.

The SQL shares only fixed values with the Spark code (patterns, stop words,
mapping constants, BM25 constants); the computation is written from the
definitions. Text search is brute force: every (query, document) pair gets
a score (0 without a matching term) and is ranked, so zero-score padding is
checked against the plain definition, not against the padding rule.
"""

from __future__ import annotations

from quarry.functions import inflections
from quarry.functions.stopwords import BY_LANGUAGE
from quarry.functions.text import (
    CLEAN_PATTERN,
    LETTER_PATTERN,
    SPACE_RUN_PATTERN,
    TOKEN_PATTERN,
)
from quarry.operators import sentences
from quarry.operators.lemmas import LONGEST, MIN_VOTES
from quarry.operators.relevance import FULL_GAIN, PART_GAIN, PART_SHARE
from quarry.params import BM25_B, BM25_EPSILON, BM25_K1
from quarry.plans.catalog import ENCODER_DIM, HYBRID_K, LEMMAS, SCORE_DIGITS, STAT_DIGITS, TEXT_K, VECTOR_K
from quarry.sources.queries import REFERENCE_QUERIES
from quarry.sources.tables import FIXED_DATE, URL_PREFIX


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LISTS = "[" + ", ".join(
    "[" + ", ".join(lit(w) for w in words) + "]" for words in BY_LANGUAGE.values()) + "]"


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), {lit(CLEAN_PATTERN)}, ' ', 'g'),"
            f" {lit(SPACE_RUN_PATTERN)}, ' ', 'g'))")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TOKEN_PATTERN)})"


def decided(t: str) -> str:
    """The stop words of the language whose list holds most of the tokens ``t``."""
    hits = f"list_transform({LISTS}, lambda l: len(list_filter({t}, lambda x: list_contains(l, x))))"
    own = f"{LISTS}[list_position({hits}, list_max({hits}))]"
    left = (f"len(list_filter({t}, lambda x: NOT list_contains({own}, x) "
            f"AND regexp_matches(x, {lit(LETTER_PATTERN)})))")
    return f"CASE WHEN list_max({hits}) > 0 AND {left} > 0 THEN {own} ELSE [] END"


def doc_terms(x: str) -> str:
    """Terms of a column of ``docs``, whose ``words`` are its language's stop words."""
    return f"list_filter({tokens(clean(x))}, lambda t: NOT list_contains(words, t))"


def query_term_rows(source: str) -> str:
    """``(query_id, terms)`` of ``source(query_id, query)``."""
    return f"""SELECT query_id, list_filter(t, lambda x: NOT list_contains(words, x)
    AND regexp_matches(x, {lit(LETTER_PATTERN)})) AS terms
  FROM (SELECT query_id, t, {decided('t')} AS words
        FROM (SELECT query_id, {tokens("coalesce(query, '')")} AS t FROM {source}))"""


def key(x: str) -> str:
    return f"floor({x} * 1e9 + 0.5)"


_STOPS = ", ".join(f"({lit(code)}, {LISTS}[{i}])" for i, code in enumerate(BY_LANGUAGE, 1))

DOCS = f"""docs AS MATERIALIZED (
  SELECT d.*, coalesce(sl.words, {decided(tokens(clean('text')))}) AS words
  FROM documents d LEFT JOIN (VALUES {_STOPS}) sl(lang, words) ON sl.lang = d.lang)"""

RAW = f"""raw AS (
  SELECT doc_id,
         {lit(URL_PREFIX)} || source || '/' || CAST(doc_id AS VARCHAR) AS url,
         {lit(FIXED_DATE)} AS date,
         split_part(text, chr(10), 1) AS title,
         coalesce(list_filter(string_split(text, chr(10))[2:], lambda x: trim(x) <> '')[1],
                  split_part(text, chr(10), 1)) AS summary,
         text
  FROM documents)"""

PAYLOAD = f"""payload AS (
  SELECT doc_id, {clean('title')} AS title, {clean('summary')} AS summary, url, date FROM raw)"""

K1, B, EPS = BM25_K1, BM25_B, BM25_EPSILON

DOC_TERM_ROWS = f"SELECT doc_id, {doc_terms('text')} AS terms FROM docs"

# BM25 tables from ``toks(doc_id, terms)``.
STATS = f"""dl AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS dl FROM toks),
stats AS (SELECT count(*) AS n, sum(dl) AS total, sum(dl) / count(*) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest(terms) AS term FROM toks) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf0 AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM df, stats),
avgidf AS (SELECT avg(idf0) AS a FROM idf0),
idf AS (SELECT term, df, CASE WHEN idf0 < 0 THEN {EPS} * a ELSE idf0 END AS idf
        FROM idf0, avgidf),
weights AS (
  SELECT tf.term, tf.doc_id,
         idf.idf * (tf.tf * {K1 + 1.0}) / (tf.tf + {K1} * ({1.0 - B} + {B} * dl.dl / stats.avgdl))
           AS weight
  FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), stats)"""

INDEX = f"""{DOCS}, toks AS ({DOC_TERM_ROWS}), {STATS}"""


def qterms_cte(name: str, source: str) -> str:
    """``name(query_id, term, qtf)`` from ``source(query_id, query)``."""
    return f"""{name} AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest(terms) AS term FROM ({query_term_rows(source)}))
  GROUP BY query_id, term)"""


def text_topk_ctes(prefix: str, source: str, k: int) -> str:
    """``{prefix}_top(query_id, rank, doc_id, raw, score)`` by brute force."""
    return f"""{qterms_cte(prefix + '_qt', source)},
{prefix}_hits AS (
  SELECT q.query_id, w.doc_id, sum(q.qtf * w.weight) AS raw
  FROM {prefix}_qt q JOIN weights w USING (term) GROUP BY q.query_id, w.doc_id),
{prefix}_all AS (
  SELECT s.query_id, d.doc_id, coalesce(h.raw, 0.0) AS raw
  FROM (SELECT query_id FROM {source}) s CROSS JOIN dl d
  LEFT JOIN {prefix}_hits h ON h.query_id = s.query_id AND h.doc_id = d.doc_id),
{prefix}_ranked AS (
  SELECT query_id, doc_id, raw,
         row_number() OVER (PARTITION BY query_id ORDER BY {key('raw')} DESC, doc_id) AS rank
  FROM {prefix}_all),
{prefix}_top AS (
  SELECT query_id, rank, doc_id, raw,
         CASE WHEN max(raw) OVER (PARTITION BY query_id) <> 0
              THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE raw END AS score
  FROM {prefix}_ranked WHERE rank <= {k})"""


BENCH_Q = "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
PAGE_Q = "pq AS (SELECT page_id AS query_id, url AS query FROM pages)"

VECTORS = """dv AS (SELECT vec_id AS doc_id, embedding FROM embeddings
            WHERE vec_id IN (SELECT doc_id FROM documents)),
qv AS (SELECT vec_id AS query_id, embedding FROM embeddings
       WHERE vec_id IN (SELECT item_id FROM benchmark))"""


def vector_topk_ctes(prefix: str, k: int) -> str:
    return f"""{prefix}_pairs AS (
  SELECT qv.query_id, dv.doc_id,
         list_inner_product(CAST(qv.embedding AS DOUBLE[]), CAST(dv.embedding AS DOUBLE[])) AS score
  FROM qv CROSS JOIN dv),
{prefix}_ranked AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY {key('score')} DESC, doc_id) AS rank
  FROM {prefix}_pairs),
{prefix}_top AS (SELECT query_id, rank, doc_id, score FROM {prefix}_ranked WHERE rank <= {k})"""


def hybrid_ctes(prefix: str, k: int, wb: float, wv: float) -> str:
    depth = 2 * k
    return f"""{text_topk_ctes(prefix + '_t', 'bq', depth)},
{vector_topk_ctes(prefix + '_v', depth)},
{prefix}_fused AS (
  SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.doc_id, v.doc_id) AS doc_id,
         coalesce(t.score * {wb}, 0.0) + coalesce(v.score * {wv}, 0.0) AS fused,
         CASE WHEN t.doc_id IS NOT NULL AND v.doc_id IS NOT NULL THEN 'hybrid'
              WHEN t.doc_id IS NOT NULL THEN 'bm25' ELSE 'vector' END AS score_type,
         CASE WHEN t.doc_id IS NOT NULL THEN 0 ELSE 1 END AS src,
         coalesce(t.rank, v.rank) AS src_rank
  FROM {prefix}_t_top t FULL OUTER JOIN {prefix}_v_top v
    ON t.query_id = v.query_id AND t.doc_id = v.doc_id),
{prefix}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY {key('fused')} DESC, src, src_rank) AS rank
  FROM {prefix}_fused),
{prefix}_top AS (
  SELECT query_id, rank, doc_id, round(fused, 4) AS score, score_type
  FROM {prefix}_ranked WHERE rank <= {k})"""


def with_results(ctes: str, top: str, extra: str = "") -> str:
    return f"""WITH {RAW}, {PAYLOAD}, {ctes}
SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.doc_id, p.title, p.summary, p.url, p.date,
       round(t.score, {SCORE_DIGITS}) AS score{extra}
FROM {top} t JOIN payload p USING (doc_id)"""


def runs_ctes(k: int) -> str:
    """``runs(method, query_id, rank, doc_id, score)`` for the three methods."""
    return f"""{INDEX}, {BENCH_Q}, {VECTORS},
{text_topk_ctes('rt', 'bq', k)},
{vector_topk_ctes('rv', k)},
{hybrid_ctes('rh', k, 0.5, 0.5)},
runs AS (
  SELECT 'vector' AS method, query_id, rank, doc_id, score FROM rv_top
  UNION ALL SELECT 'text', query_id, rank, doc_id, score FROM rt_top
  UNION ALL SELECT 'hybrid', query_id, rank, doc_id, score FROM rh_top)"""


SQL: dict[str, str] = {}

SQL["prepare_documents"] = f"""WITH {DOCS}, {RAW.replace("FROM documents", "FROM docs").replace("         text" + chr(10), "         text, words" + chr(10))}
SELECT doc_id, coalesce(url, '') AS id, coalesce(date, '') AS date, coalesce(url, '') AS url,
       {clean('title')} AS title, {clean('summary')} AS summary, {clean('text')} AS text,
       array_to_string({doc_terms('title')}, ' ') AS title_processed,
       array_to_string({doc_terms('summary')}, ' ') AS summary_processed,
       array_to_string({doc_terms('text')}, ' ') AS text_processed
FROM raw"""

SQL["basic_clean"] = f"SELECT doc_id, {clean('text')} AS clean_text FROM documents"

SQL["doc_tokens"] = f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tokens(clean('text'))} AS t FROM documents)"""

SQL["doc_terms"] = f"""WITH {DOCS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {doc_terms('text')} AS t FROM docs)"""

# Sentences: types (ty), segments' ends (ce), the three score tables (ab, st, co)
# and a decision per segment (de).


def _type(w: str) -> str:
    bare = f"regexp_replace({w}, {lit(sentences.CLOSING)}, '')"
    core = (f"regexp_replace(regexp_replace({bare}, {lit(sentences.END_MARKS)}, ''), "
            f"{lit(sentences.OPENING)}, '')")
    return (f"CASE WHEN regexp_matches({core}, '^\\p{{N}}[\\p{{N}}.,]*$') THEN '##' "
            f"ELSE lower({core}) END")


def _kind(w: str) -> str:
    bare = f"regexp_replace({w}, {lit(sentences.CLOSING)}, '')"
    return (f"CASE WHEN regexp_matches({bare}, '[!?]$') THEN 'end' "
            f"WHEN regexp_matches({bare}, '\\.\\.$') THEN 'ellipsis' "
            f"WHEN regexp_matches({bare}, '\\.$') THEN 'period' ELSE 'plain' END")


def _ll(k: str, n: str, p: str) -> str:
    tiny = sentences.TINY
    return (f"(CASE WHEN {k} > 0 THEN {k} * ln(greatest({p}, {tiny})) ELSE 0.0 END + "
            f"CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(greatest(1.0 - {p}, {tiny})) ELSE 0.0 END)")


def _association(both: str, first: str, second: str, total: str) -> str:
    rest, other = f"greatest({total} - {first}, 0)", f"greatest({second} - {both}, 0)"
    p, p1 = f"({second} / {total})", f"({both} / {first})"
    p2 = f"(CASE WHEN {rest} > 0 THEN {other} / greatest({rest}, 1) ELSE 0.0 END)"
    return (f"(CASE WHEN {p1} > {p} THEN 2.0 ELSE -2.0 END * ({_ll(both, first, p1)} "
            f"+ {_ll(other, rest, p2)} - {_ll(both, first, p)} - {_ll(other, rest, p)}))")


SENTENCES = f"""cl AS MATERIALIZED (SELECT doc_id, {clean('text')} AS c FROM documents),
ty AS MATERIALIZED (SELECT type, count(*) FILTER (WHERE dot) AS n_dot,
  count(*) FILTER (WHERE NOT dot) AS n_plain
  FROM (SELECT {_type('w')} AS type, {_kind('w')} = 'period' AS dot
        FROM (SELECT unnest(string_split(c, ' ')) AS w FROM cl))
  WHERE regexp_matches(type, '[\\p{{L}}#]') GROUP BY type),
tot AS (SELECT CAST(sum(n_dot + n_plain) AS DOUBLE) AS n, CAST(sum(n_dot) AS DOUBLE) AS dots FROM ty),
sg AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(c, {lit(sentences.SEGMENT)})) AS s,
  unnest(generate_series(1, len(regexp_extract_all(c, {lit(sentences.SEGMENT)})))) AS i FROM cl),
cw AS (SELECT doc_id, i, s, string_split(trim(s), ' ')[-1] AS word,
  string_split(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), ''), ' ')[1] AS nxt FROM sg),
ce AS MATERIALIZED (SELECT doc_id, i, s, nxt, {_kind('word')} AS kind, {_type('word')} AS type,
  {_type('nxt')} AS next_type, regexp_matches(nxt, {lit(sentences.CAPITAL)}) AS capital FROM cw),
ab AS (SELECT type, n_dot, n_plain,
  2.0 * ({_ll('n_dot', '(n_dot + n_plain)', str(sentences.KEEPS))}
    - {_ll('n_dot', '(n_dot + n_plain)', '(dots / n)')})
  * exp(-CAST(len(replace(type, '.', '')) AS DOUBLE))
  * (len(type) - len(replace(type, '.', '')) + 1)
  * pow(CAST(len(replace(type, '.', '')) AS DOUBLE), -CAST(n_plain AS DOUBLE)) AS score
  FROM ty, tot WHERE n_dot > 0 AND regexp_matches(type, {lit(LETTER_PATTERN)})),
sh AS (SELECT type FROM ab WHERE score >= {sentences.ABBREVIATION}),
fa AS (SELECT next_type AS type, count(*) AS n_after FROM ce
  WHERE regexp_matches(next_type, '[\\p{{L}}#]') AND (kind = 'end' OR (kind = 'period'
    AND type <> '##' AND NOT regexp_matches(type, '^\\p{{L}}$')
    AND type NOT IN (SELECT type FROM sh))) GROUP BY 1),
st AS (SELECT type, n_after, n_dot + n_plain AS n,
  {_association('n_after', 'br', '(n_dot + n_plain)', 'tot.n')} AS score
  FROM fa JOIN ty USING (type), tot, (SELECT CAST(sum(n_after) AS DOUBLE) AS br FROM fa)),
pa AS (SELECT type, next_type, count(*) AS n_both FROM ce
  WHERE kind = 'period' AND regexp_matches(next_type, '[\\p{{L}}#]') AND (type = '##'
    OR regexp_matches(type, '^\\p{{L}}$') OR type IN (SELECT type FROM sh)) GROUP BY 1, 2),
co AS (SELECT pa.type, next_type, n_both,
  {_association('n_both', '(a.n_dot + a.n_plain)', '(b.n_dot + b.n_plain)', 'tot.n')} AS score
  FROM pa JOIN ty a ON a.type = pa.type JOIN ty b ON b.type = next_type, tot),
de AS (SELECT doc_id, i, s, kind, ends, NOT ends AND kind = 'period' AND (weak OR type = '##') AS keeps
  FROM (SELECT *, CASE WHEN kind = 'plain' THEN false WHEN nxt = '' THEN true WHEN kind = 'end' THEN true
      WHEN kind = 'ellipsis' THEN capital WHEN weak THEN capital AND starts AND NOT paired
      WHEN type = '##' THEN capital AND NOT paired ELSE true END AS ends
    FROM (SELECT *, type IN (SELECT type FROM sh) OR regexp_matches(type, '^\\p{{L}}$') AS weak,
        next_type IN (SELECT type FROM st WHERE score >= {sentences.STARTER}) AS starts,
        EXISTS (SELECT 1 FROM co WHERE co.type = ce.type AND co.next_type = ce.next_type
                AND co.score >= {sentences.COLLOCATION}) AS paired FROM ce)))"""

SQL["sentence_abbreviations"] = f"""WITH {SENTENCES}
SELECT type, n_dot, n_plain, round(score, {SCORE_DIGITS}) + 0.0 AS score FROM ab"""

SQL["sentence_starters"] = f"""WITH {SENTENCES}
SELECT type, n_after, n, round(score, {SCORE_DIGITS}) + 0.0 AS score FROM st"""

SQL["sentence_collocations"] = f"""WITH {SENTENCES}
SELECT type, next_type, n_both, round(score, {SCORE_DIGITS}) + 0.0 AS score FROM co"""

# A segment's tokens; the period that a word keeps is taken off and put back.
_BODY = r"regexp_replace(trim(s), '\.([»''\-]*)$', '\1')"
_SPLIT = f"regexp_extract_all(lower(trim(s)), {lit(TOKEN_PATTERN)})"

SQL["doc_sentences"] = f"""WITH {SENTENCES},
tk AS (SELECT doc_id, i, ends, CASE WHEN keeps
    THEN list_filter(list_concat(before[:-2], [before[-1] || '.'], after), lambda t: t <> '')
    ELSE {_SPLIT} END AS t
  FROM (SELECT *, regexp_extract_all(lower({_BODY.replace(chr(92) + '1', '')}), {lit(TOKEN_PATTERN)})
      AS before,
    regexp_extract_all(regexp_extract(trim(s), '\\.([»''\\-]*)$', 1), {lit(TOKEN_PATTERN)})
      AS after FROM de)),
nu AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM tk),
se AS (SELECT doc_id, sentence, flatten(list(t ORDER BY i)) AS t FROM nu GROUP BY 1, 2),
al AS (SELECT doc_id, count(*) AS n_sentences, sum(len(t)) AS n_tokens,
  string_agg(array_to_string(t, ' '), ' | ' ORDER BY sentence) AS tokens
  FROM se WHERE len(t) > 0 GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences,
  CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, coalesce(tokens, '') AS tokens
FROM documents LEFT JOIN al USING (doc_id)"""

SQL["query_terms"] = f"""WITH {BENCH_Q}, {qterms_cte('qt', 'bq')}
SELECT query_id, term, qtf FROM qt"""

SQL["term_frequency"] = f"WITH {INDEX} SELECT doc_id, term, tf FROM tf"

SQL["doc_length"] = f"WITH {INDEX} SELECT doc_id, dl FROM dl"

SQL["corpus_stats"] = f"""WITH {INDEX}
SELECT n AS n_docs, CAST(total AS BIGINT) AS total_tokens, round(avgdl, {STAT_DIGITS}) AS avgdl,
       (SELECT count(*) FROM df) AS n_terms, round((SELECT a FROM avgidf), {STAT_DIGITS}) AS avg_idf
FROM stats"""

SQL["term_idf"] = f"""WITH {DOCS},
ts AS MATERIALIZED (SELECT {doc_terms('text')} AS terms FROM docs),
fs AS MATERIALIZED (SELECT term, count(*) AS df
  FROM (SELECT unnest(list_distinct(terms)) AS term FROM ts) GROUP BY term),
xs AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS x
  FROM fs, (SELECT count(*) AS n FROM documents))
SELECT term, df, round(CASE WHEN x < 0 THEN {EPS} * a ELSE x END, {STAT_DIGITS}) AS idf
FROM xs, (SELECT avg(x) AS a FROM xs)"""

SQL["bm25_scores"] = f"""WITH {INDEX}, {BENCH_Q}, {qterms_cte('qt', 'bq')}
SELECT q.query_id, w.doc_id, round(sum(q.qtf * w.weight), {SCORE_DIGITS}) AS raw
FROM qt q JOIN weights w USING (term) GROUP BY q.query_id, w.doc_id"""

SQL["text_search"] = with_results(
    f"{INDEX}, {BENCH_Q}, {text_topk_ctes('ts', 'bq', TEXT_K)}", "ts_top")

SQL["text_search_pruned"] = SQL["text_search"]

SQL["text_search_padded"] = with_results(
    f"{INDEX}, {PAGE_Q}, {text_topk_ctes('tp', 'pq', TEXT_K)}", "tp_top")

SQL["l2_normalize"] = f"""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(value, {STAT_DIGITS}) AS value
FROM (
  SELECT vec_id, unnest(v) AS value, unnest(generate_series(1, len(v))) AS pos
  FROM (
    SELECT vec_id,
           list_transform(CAST(embedding AS DOUBLE[]),
             lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v
    FROM (SELECT vec_id, embedding,
                 sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n
          FROM embeddings)))"""

SQL["vector_search"] = with_results(
    f"{VECTORS}, {vector_topk_ctes('vs', VECTOR_K)}", "vs_top")

SQL["hybrid_search"] = with_results(
    f"{INDEX}, {BENCH_Q}, {VECTORS}, {hybrid_ctes('hs', HYBRID_K, 0.5, 0.5)}", "hs_top",
    ", t.score_type")

SQL["hybrid_search_w70_30"] = with_results(
    f"{INDEX}, {BENCH_Q}, {VECTORS}, {hybrid_ctes('hw', HYBRID_K, 0.7, 0.3)}", "hw_top",
    ", t.score_type")

SQL["hybrid_candidates"] = f"""WITH {INDEX}, {BENCH_Q}, {VECTORS},
{hybrid_ctes('hc', HYBRID_K, 0.5, 0.5)}
SELECT query_id, doc_id, round(fused, {SCORE_DIGITS}) AS fused, score_type,
       CAST(src AS INTEGER) AS src, CAST(src_rank AS INTEGER) AS src_rank
FROM hc_fused"""

SQL["jsonl_scan"] = f"""WITH {RAW}
SELECT url, date, coalesce(title, '') AS title, coalesce(summary, '') AS summary,
       coalesce(text, '') AS text
FROM raw"""

SQL["hybrid_top1_by_depth"] = f"""WITH {INDEX}, {BENCH_Q}, {VECTORS},
{hybrid_ctes('h1', 1, 0.5, 0.5)},
{hybrid_ctes('h10', 10, 0.5, 0.5)}
SELECT coalesce(a.query_id, b.query_id) AS query_id, a.doc_id AS doc_k1, a.score AS score_k1,
       b.doc_id AS doc_k10, b.score AS score_k10
FROM (SELECT * FROM h1_top WHERE rank = 1) a
FULL OUTER JOIN (SELECT * FROM h10_top WHERE rank = 1) b ON a.query_id = b.query_id"""

SQL["id_mapping"] = f"""SELECT url, max(ord) AS idx
FROM (SELECT {lit(URL_PREFIX)} || source || '/' || CAST(doc_id AS VARCHAR) AS url,
             row_number() OVER (ORDER BY doc_id) - 1 AS ord
      FROM documents)
GROUP BY url"""

SQL["eval_metrics_at_k"] = f"""WITH {runs_ctes(10)},
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
methods AS (SELECT unnest(['vector', 'text', 'hybrid']) AS method),
per_query AS (
  SELECT r.method, ks.k, r.query_id, avg(r.score) AS q_avg, max(r.score) AS q_max,
         min(r.score) AS q_min
  FROM runs r JOIN ks ON r.rank <= ks.k GROUP BY r.method, ks.k, r.query_id),
grid AS (SELECT m.method, ks.k, q.query_id FROM methods m CROSS JOIN ks CROSS JOIN bq q)
SELECT g.method, CAST(g.k AS INTEGER) AS k,
       round(avg(coalesce(p.q_avg, 0.0)), {STAT_DIGITS}) AS avg_score,
       round(coalesce(max(p.q_max), 0.0), {STAT_DIGITS}) AS max_score,
       round(coalesce(min(p.q_min), 0.0), {STAT_DIGITS}) AS min_score
FROM grid g LEFT JOIN per_query p USING (method, k, query_id)
GROUP BY g.method, g.k"""

RUN_LOG = """lg AS (SELECT event_type AS method,
  CAST([1, 3, 5, 10][CAST(((user_id % 4) + 4) % 4 AS INTEGER) + 1] AS INTEGER) AS k,
  value / 1000 AS s FROM events),
su AS (SELECT method, k, avg(s) AS avg_time, stddev_pop(s) AS std_time FROM lg GROUP BY ALL)"""

SQL["eval_latency"] = f"""WITH {RUN_LOG}
SELECT method, k, round(avg_time, {STAT_DIGITS}) AS avg_time, round(std_time, {STAT_DIGITS}) AS std_time
FROM su"""

SQL["eval_mean_latency"] = f"""WITH {RUN_LOG}
SELECT method, round(avg(avg_time), {STAT_DIGITS}) AS avg_time,
  round(avg(std_time), {STAT_DIGITS}) AS std_time FROM su GROUP BY method"""

SQL["rrf_search"] = f"""WITH {INDEX}, {BENCH_Q}, {VECTORS},
{text_topk_ctes('rr', 'bq', 2 * HYBRID_K)}, {vector_topk_ctes('rw', 2 * HYBRID_K)},
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (
  SELECT query_id, doc_id, rank FROM rr_top UNION ALL SELECT query_id, doc_id, rank FROM rw_top)
  GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {key('score')} DESC, doc_id)
  AS rank FROM f)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, {SCORE_DIGITS}) AS score
FROM r WHERE rank <= {HYBRID_K}"""

SQL["relevance_at_k"] = f"""WITH {runs_ctes(TEXT_K)}, {qterms_cte('jt', 'bq')},
js AS (SELECT query_id, count(*) AS n FROM jt GROUP BY 1),
jd AS (SELECT query_id, doc_id, CASE WHEN held = n THEN {FULL_GAIN} ELSE {PART_GAIN} END AS gain
  FROM (SELECT query_id, doc_id, count(*) AS held FROM jt JOIN tf USING (term) GROUP BY 1, 2)
  JOIN js USING (query_id) WHERE held / n >= {PART_SHARE}),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM jd),
nr AS (SELECT query_id, count(*) AS n_relevant FROM jd GROUP BY 1),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
idl AS (SELECT query_id, k, sum(gain / log2(place + 1)) AS ideal FROM pl, ks WHERE place <= k GROUP BY 1, 2),
fo AS (SELECT method, query_id, k, count(*) AS n, sum(gain / log2(rank + 1)) AS dcg
  FROM runs JOIN jd USING (query_id, doc_id), ks WHERE rank <= k GROUP BY 1, 2, 3),
g AS (SELECT method, k, query_id FROM bq, ks, (SELECT unnest(['vector', 'text', 'hybrid']) AS method))
SELECT method, CAST(k AS INTEGER) AS k, count(n_relevant) AS n_judged,
  round(avg(coalesce(n, 0) / k), {SCORE_DIGITS}) AS precision,
  round(avg(CASE WHEN n_relevant IS NOT NULL THEN coalesce(n, 0) / n_relevant END), {SCORE_DIGITS})
    AS recall,
  round(avg(CASE WHEN ideal IS NOT NULL THEN coalesce(dcg, 0.0) / ideal END), {SCORE_DIGITS}) AS ndcg
FROM g LEFT JOIN fo USING (method, query_id, k) LEFT JOIN nr USING (query_id)
LEFT JOIN idl USING (query_id, k) GROUP BY method, k"""

SQL["rerank_search"] = f"""WITH {INDEX}, {BENCH_Q}, {text_topk_ctes('rk', 'bq', 2 * HYBRID_K)},
w AS (SELECT query_id, doc_id,
  list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS a,
  list_distinct(regexp_extract_all(lower({clean('text')}), '[\\p{{L}}\\p{{N}}_]+')) AS b
  FROM rk_top JOIN bq USING (query_id) JOIN documents USING (doc_id)),
s AS (SELECT query_id, doc_id, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE
  len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {key('score')} DESC, doc_id)
  AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, {SCORE_DIGITS}) AS score
FROM r WHERE rank <= {HYBRID_K}"""

SQL["eval_top_document"] = f"""WITH {RAW}, {PAYLOAD}, {runs_ctes(3)}
SELECT r.method, r.query_id, r.doc_id, round(r.score, {SCORE_DIGITS}) AS score,
       substring(p.title, 1, 50) || '...' AS title
FROM runs r JOIN payload p USING (doc_id) WHERE r.rank = 1"""

SQL["eval_examples_top3"] = f"""WITH {RAW}, {PAYLOAD}, {runs_ctes(3)}
SELECT r.method, r.query_id, CAST(r.rank AS INTEGER) AS rank, r.doc_id,
       round(r.score, {SCORE_DIGITS}) AS score, p.title,
       substring(p.summary, 1, 100) || '...' AS summary
FROM runs r JOIN payload p USING (doc_id)
WHERE r.query_id = (SELECT min(item_id) FROM benchmark) AND r.rank <= 3"""

SQL["corpus_counts"] = """SELECT (SELECT count(*) FROM documents) AS n_documents,
       (SELECT count(*) FROM benchmark) AS n_queries"""

SQL["hybrid_search_shared_urls"] = f"""WITH {INDEX}, {BENCH_Q}, {VECTORS},
{hybrid_ctes('hu', HYBRID_K, 0.5, 0.5)},
t AS (SELECT query_id, doc_id - doc_id % 2 AS m, max(score) AS score, min(rank) AS rank,
             arg_min(doc_id, rank) AS doc_id FROM hu_t_top GROUP BY 1, 2),
v AS (SELECT query_id, doc_id - doc_id % 2 AS m, max(score) AS score, min(rank) AS rank,
             arg_min(doc_id, rank) AS doc_id FROM hu_v_top GROUP BY 1, 2),
fused AS (
  SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.doc_id, v.doc_id) AS doc_id,
         coalesce(t.score * 0.5, 0.0) + coalesce(v.score * 0.5, 0.0) AS fused,
         CASE WHEN t.m IS NOT NULL AND v.m IS NOT NULL THEN 'hybrid'
              WHEN t.m IS NOT NULL THEN 'bm25' ELSE 'vector' END AS score_type,
         CASE WHEN t.m IS NOT NULL THEN 0 ELSE 1 END AS src, coalesce(t.rank, v.rank) AS src_rank
  FROM t FULL OUTER JOIN v ON t.query_id = v.query_id AND t.m = v.m),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY {key('fused')} DESC, src, src_rank) AS rank FROM fused)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(fused, 4) AS score, score_type
FROM ranked WHERE rank <= {HYBRID_K}"""


def encoded_cte(name: str, source: str, key_col: str, text: str) -> str:
    """``name(key_col, embedding)``: signed feature hashing of the words'
    MD5, scaled to unit length."""
    return f"""{name}_words AS (
  SELECT {key_col}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}),
{name}_sums AS (
  SELECT {key_col}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {ENCODER_DIM} AS pos,
         sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
  FROM {name}_words GROUP BY 1, 2),
{name}_grid AS (
  SELECT s.{key_col}, g.pos, coalesce(x, 0.0) AS x
  FROM (SELECT {key_col}, unnest(generate_series(0, {ENCODER_DIM - 1})) AS pos FROM {source}) g
  JOIN {source} s USING ({key_col}) LEFT JOIN {name}_sums USING ({key_col}, pos)),
{name}_unit AS (
  SELECT {key_col}, pos, CAST(CASE WHEN n > 0 THEN x / n ELSE x END AS FLOAT) AS x
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key_col})) AS n FROM {name}_grid)),
{name} AS (SELECT {key_col}, list(x ORDER BY pos) AS embedding FROM {name}_unit GROUP BY 1)"""


SQL["encode_documents"] = f"""WITH {RAW},
body AS (SELECT doc_id, {clean('text')} AS body FROM raw),
{encoded_cte('enc', 'body', 'doc_id', 'body')}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CAST(x AS DOUBLE), {SCORE_DIGITS}) AS value
FROM enc_unit"""

SQL["vector_search_encoded"] = with_results(f"""{BENCH_Q},
body AS (SELECT doc_id, {clean('text')} AS body FROM raw),
{encoded_cte('dv', 'body', 'doc_id', 'body')},
{encoded_cte('qv', 'bq', 'query_id', 'query')},
{vector_topk_ctes('ve', VECTOR_K)}""", "ve_top")


def lemmatized(lst: str) -> str:
    cases = " ".join(f"WHEN {lit(f)} THEN {lit(t)}" for f, t in LEMMAS)
    return f"list_transform({lst}, lambda t: CASE t {cases} ELSE t END)"


SQL["doc_terms_lemmas"] = f"""WITH {DOCS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms,
       array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {lemmatized(doc_terms('text'))} AS t FROM docs)"""

SQL["text_search_lemmas"] = SQL["text_search"].replace(
    f"{doc_terms('text')} AS terms", f"{lemmatized(doc_terms('text'))} AS terms").replace(
    "SELECT query_id, unnest(terms) AS term", f"SELECT query_id, unnest({lemmatized('terms')}) AS term")


PAIRS = ", ".join(f"({lit(f)}, {lit(x)})" for f, x in inflections.pairs())

# Trie of endings (en) and lemmas (le) of the distinct terms of ``lt(term)``.
LEMMA_TRIE = f"""pr AS (SELECT DISTINCT form, lemma FROM (VALUES {PAIRS}) v(form, lemma)),
ru AS (SELECT form, lemma, len(form) - same AS cut, substr(lemma, same + 1) AS addition FROM (
  SELECT form, lemma, CAST(len(list_filter(generate_series(1, least(len(form), len(lemma))),
    lambda i: form[:i] = lemma[:i])) AS INTEGER) AS same FROM pr)),
ev AS (SELECT right(form, n) AS ending, cut, addition, count(*) AS votes FROM (
  SELECT *, CAST(unnest(generate_series(greatest(cut, 1), least({LONGEST}, len(form) - 1)))
    AS INTEGER) AS n FROM ru) GROUP BY ALL),
en AS (SELECT ending, CAST(cut AS INTEGER) AS cut, addition, votes,
  CAST(forms AS BIGINT) AS forms FROM (
  SELECT *, sum(votes) OVER (PARTITION BY ending) AS forms,
    row_number() OVER (PARTITION BY ending ORDER BY votes DESC, cut, addition) AS place FROM ev)
  WHERE place = 1 AND forms >= {MIN_VOTES})"""

LEMMA_TABLE = f"""{LEMMA_TRIE},
kn AS (SELECT form, min(lemma) AS lemma FROM pr GROUP BY form),
gu AS (SELECT lt.term AS form, max(struct_pack(n := len(ending), cut := cut, addition := addition))
    AS b
  FROM lt JOIN en ON len(ending) < len(lt.term) AND right(lt.term, len(ending)) = ending
  WHERE regexp_matches(lt.term, {lit(LETTER_PATTERN)}) GROUP BY 1),
le AS (SELECT lt.term AS form,
  coalesce(kn.lemma, left(lt.term, len(lt.term) - b.cut) || b.addition, lt.term) AS lemma,
  CASE WHEN kn.lemma IS NOT NULL THEN 'known' WHEN b IS NOT NULL THEN 'guessed' ELSE 'kept' END
    AS source
  FROM lt LEFT JOIN kn ON kn.form = lt.term LEFT JOIN gu ON gu.form = lt.term)"""

DOC_TOKENS_CTE = (f"lt AS (SELECT DISTINCT unnest({tokens(clean('text'))}) AS term "
                  f"FROM documents)")

SQL["lemma_guesses"] = f"WITH {DOC_TOKENS_CTE}, {LEMMA_TABLE} SELECT form, lemma, source FROM le"

SQL["lemma_endings"] = f"""WITH {DOC_TOKENS_CTE}, {LEMMA_TRIE},
te AS (SELECT right(term, n) AS ending, count(*) AS n_terms FROM (
  SELECT term, CAST(unnest(generate_series(1, least(len(term), {LONGEST}))) AS INTEGER) AS n
  FROM lt) GROUP BY 1)
SELECT ending, cut, addition, votes, forms, coalesce(n_terms, 0) AS n_terms
FROM en LEFT JOIN te USING (ending)"""


def with_guesses(source: str, key_col: str, terms: str, name: str) -> str:
    """``name(key_col, terms)``: lists of terms by their lemmas, in order."""
    return f"""{name}_flat AS (
  SELECT {key_col}, unnest({terms}) AS term, unnest(generate_series(1, len({terms}))) AS pos
  FROM {source}),
{name}_made AS (
  SELECT f.{key_col}, list(le.lemma ORDER BY f.pos) AS terms
  FROM {name}_flat f JOIN le ON le.form = f.term GROUP BY 1),
{name} AS (SELECT s.{key_col}, coalesce(m.terms, []) AS terms
  FROM {source} s LEFT JOIN {name}_made m USING ({key_col}))"""


GUESSED = f"""{DOCS}, g_docs AS ({DOC_TERM_ROWS}),
lt AS (SELECT DISTINCT unnest(terms) AS term FROM g_docs),
{LEMMA_TABLE},
{with_guesses('g_docs', 'doc_id', 'terms', 'toks')}"""

SQL["doc_terms_guessed"] = f"""WITH {GUESSED}
SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, array_to_string(terms, ' ') AS terms
FROM toks"""

_GUESSED_QUERIES = f"""{DOCS}, g_docs AS ({DOC_TERM_ROWS}),
g_queries AS ({query_term_rows('bq')}),
lt AS (SELECT DISTINCT term FROM (SELECT unnest(terms) AS term FROM g_docs
  UNION ALL SELECT unnest(terms) FROM g_queries)),
{LEMMA_TABLE},
{with_guesses('g_docs', 'doc_id', 'terms', 'toks')},
{with_guesses('g_queries', 'query_id', 'terms', 'g_qt')}"""

SQL["text_search_guessed"] = with_results(
    f"{BENCH_Q}, {_GUESSED_QUERIES}, {STATS}, "
    + text_topk_ctes('tg', 'bq', TEXT_K).replace(f"({query_term_rows('bq')})", "g_qt"), "tg_top")


SQL["jsonl_rejects"] = f"""WITH {RAW}, kinds AS (
  SELECT doc_id % 7 AS kind, title, CASE WHEN doc_id % 7 = 3 THEN '' ELSE summary END AS summary, text
  FROM raw)
SELECT CASE kind WHEN 0 THEN 'malformed' WHEN 1 THEN 'missing field text'
            WHEN 2 THEN 'not an object' ELSE 'good' END AS outcome,
       count(*) AS n,
       CAST(sum(CASE WHEN kind >= 4 THEN len(title) ELSE 0 END) AS BIGINT) AS title_chars,
       CAST(sum(CASE WHEN kind >= 4 THEN len(summary) ELSE 0 END) AS BIGINT) AS summary_chars,
       CAST(sum(CASE WHEN kind >= 3 THEN len(text) ELSE 0 END) AS BIGINT) AS text_chars
FROM kinds GROUP BY 1"""

SQL["documents_round_trip"] = f"""WITH {RAW}
SELECT url, date, {clean('title')} AS title, {clean('summary')} AS summary, {clean('text')} AS text
FROM raw"""

SQL["embeddings_round_trip"] = f"""SELECT vec_id AS doc_id, CAST(pos - 1 AS INTEGER) AS pos,
       round(CAST(value AS DOUBLE), {SCORE_DIGITS}) AS value
FROM (SELECT vec_id, unnest(embedding) AS value,
             unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)"""

SQL["evaluation_round_trip"] = SQL["eval_metrics_at_k"]

SQL["query_lines"] = """SELECT query, '' AS description, count(*) AS n_ids
FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS query FROM benchmark)
WHERE query <> '' GROUP BY 1, 2"""

_REFERENCE = ", ".join(f"({i}, {lit(q)}, {lit(d)})" for i, (q, d) in enumerate(REFERENCE_QUERIES))

SQL["text_search_reference"] = f"""WITH {RAW}, {PAYLOAD}, {INDEX},
rq AS (SELECT * FROM (VALUES {_REFERENCE}) v(query_id, query, description)),
{text_topk_ctes('tr', 'rq', HYBRID_K)}
SELECT CAST(t.query_id AS BIGINT) AS query_id, rq.description, CAST(t.rank AS INTEGER) AS rank,
       t.doc_id, p.title, round(t.score, {SCORE_DIGITS}) AS score
FROM tr_top t JOIN rq USING (query_id) JOIN payload p USING (doc_id)"""

SQL["search_dispatch"] = f"""WITH {runs_ctes(HYBRID_K)}
SELECT method, query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM runs"""
