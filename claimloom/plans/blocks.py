"""SQL building blocks of the larger queries' DuckDB equivalents."""

from __future__ import annotations

from claimloom.functions import constants as C

_TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"


def tokens(x: str) -> str:
    return _TOKENS.format(x=x)


def trim(x: str) -> str:
    return f"trim({x}, E' \\t\\n\\r')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def bm25(p: str, k: int, queries: str = "q", docs: str = "d") -> str:
    """CTEs ending with {p}top(query_id, ord, score, rank) over relations (query_id, text) and (ord, text)."""
    return f"""{p}qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM {queries}) GROUP BY ALL),
{p}dl AS (SELECT ord, len({tokens("text")}) AS dl FROM {docs}),
{p}st AS (SELECT count(*) AS n_docs, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM {p}dl),
{p}po AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({tokens("text")}) AS term FROM {docs}) WHERE term IN (SELECT term FROM {p}qt) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}po GROUP BY term),
{p}sc AS (SELECT query_id, ord, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM {p}qt JOIN {p}po USING (term) JOIN {p}df USING (term) JOIN {p}dl USING (ord), {p}st GROUP BY ALL),
{p}al AS (SELECT query_id, ord, max(score) AS score FROM (SELECT query_id, ord, score FROM {p}sc UNION ALL SELECT query_id, f.ord, 0.0 FROM {queries}, (SELECT ord FROM {docs} ORDER BY ord LIMIT {k}) f) GROUP BY ALL),
{p}top AS (SELECT query_id, ord, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM {p}al QUALIFY rank <= {k})"""


def rrf(name: str, channels: list[str], k: int) -> str:
    """CTE {name}(query_id, ord, score, rank) from selects of (query_id, ord, rank, l)."""
    union = " UNION ALL ".join(channels)
    return f"""{name}_u AS ({union}),
{name}_f AS (SELECT query_id, ord, sum(1.0::DOUBLE / (60 + rank)) AS score, min({{'l': l, 'r': rank}}) AS first FROM {name}_u GROUP BY ALL),
{name} AS (SELECT query_id, ord, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM {name}_f QUALIFY rank <= {k})"""


def expansion(most: int = 4) -> str:
    """CTE ex(query_id, list_no, text): rewritings of q."""
    stop = "[" + ", ".join(f"'{w}'" for w in C.QUERY_STOPWORDS) + "]"
    return rf"""x0 AS (SELECT query_id, {squeeze("text")} AS c FROM q),
x1 AS (SELECT query_id, c, list_filter(list_transform(regexp_extract_all(c, '(?:[A-Z][a-z0-9''\-]+(?:\s+|$)){{1,4}}'), lambda e: trim(e)), lambda e: e <> '' AND lower(e) <> lower(c)) AS es,
  list_filter(regexp_extract_all(c, '[A-Za-z0-9][A-Za-z0-9''\-]*'), lambda w: length(w) > 2 AND NOT list_contains({stop}, lower(w))) AS w FROM x0),
x2 AS (SELECT query_id, e, min(i) AS i FROM (SELECT query_id, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM x1) GROUP BY query_id, lower(e), e QUALIFY row_number() OVER (PARTITION BY query_id, lower(e) ORDER BY min(i)) = 1),
x3 AS (SELECT x1.query_id, c, w, coalesce((SELECT list(e ORDER BY i) FROM x2 WHERE x2.query_id = x1.query_id), [])[1:{most}] AS e, array_to_string(w[1:6], ' ') AS head, array_to_string(CASE WHEN len(w) > 4 THEN w[-4:] ELSE w END, ' ') AS tail FROM x1),
x4 AS (SELECT *, len(w) > 0 AND NOT list_contains(list_transform(e, lambda y: lower(y)), lower(head)) AND lower(head) <> lower(c) AS wh FROM x3),
x5 AS (SELECT query_id, list_concat(list_concat(e, CASE WHEN wh THEN [head] ELSE [] END), CASE WHEN len(w) > 1 AND NOT list_contains(list_transform(e, lambda y: lower(y)), lower(tail)) AND lower(tail) <> lower(c) AND NOT (wh AND lower(head) = lower(tail)) THEN [tail] ELSE [] END)[1:{most}] AS l FROM x4),
ex AS (SELECT query_id, unnest(l) AS text, generate_subscripts(l, 1) AS list_no FROM x5)"""


def checked(told: str, context: str, p: str = "ck") -> str:
    """CTEs ending with {p}(key, precision, rate, missing, valid): the citation check of (key, told) against (key, id, text)."""
    ids = r"list_transform(regexp_extract_all({x}, '\[(\d+)\]', 1), lambda i: i::INT)"
    return rf"""{p}t AS (SELECT key, told, list_distinct({ids.format(x="told")}) AS ids, string_split(regexp_replace(regexp_replace(told, '([.!?])\s+', concat('\1', chr(1)), 'g'), ';\s+', chr(1), 'g'), chr(1)) AS cut FROM ({told})),
{p}c AS (SELECT key, id, list_distinct({tokens("text")}) AS toks FROM ({context})),
{p}s0 AS (SELECT key, i, {trim("s")} AS s FROM (SELECT key, unnest(cut) AS s, generate_subscripts(cut, 1) AS i FROM {p}t)),
{p}s1 AS (SELECT key, i, CASE WHEN starts_with(lower(s), 'verdict:') AND contains(lower(s), 'based on') THEN CASE WHEN contains(s, 'based on') THEN {trim("substr(s, instr(s, 'based on') + 8)")} ELSE s END ELSE s END AS s FROM {p}s0),
{p}s2 AS (SELECT key, i, {ids.format(x="s")} AS sids, list_distinct({tokens("s")}) AS toks FROM {p}s1 WHERE s <> '' AND NOT regexp_full_match(s, '(?:\[\d+\]\s*)+')),
{p}s3 AS (SELECT a.key, a.i, coalesce(bool_or(list_contains(a.sids, c.id) AND len(a.toks) > 0 AND len(list_intersect(a.toks, c.toks))::DOUBLE / greatest(len(a.toks), 1) >= {C.SUPPORT_SHARE}), false) AS backed FROM {p}s2 a LEFT JOIN {p}c c ON c.key = a.key GROUP BY ALL),
{p}r AS (SELECT key, count(*) FILTER (NOT backed)::DOUBLE / count(*) AS rate FROM {p}s3 GROUP BY key),
{p}m AS (SELECT t.key, t.ids, list_sort(list_filter(t.ids, lambda i: NOT list_contains(coalesce(k.known, []), i))) AS missing FROM {p}t t LEFT JOIN (SELECT key, list(id) AS known FROM {p}c GROUP BY key) k ON k.key = t.key),
{p} AS (SELECT m.key, CASE WHEN len(ids) = 0 THEN 1.0::DOUBLE ELSE (len(ids) - len(missing))::DOUBLE / len(ids) END AS precision, coalesce(rate, 0.0)::DOUBLE AS rate, missing, len(missing) = 0 AND coalesce(rate, 0.0) = 0 AS valid FROM {p}m m LEFT JOIN {p}r r ON r.key = m.key)"""


def clean(x: str) -> str:
    return f"trim(regexp_replace({squeeze(x)}, '{C.MARKERS}', ''))"


def styled(style: str, index: str, body: str) -> str:
    """A rendered line of a block."""
    return f"CASE {style} WHEN 'plain' THEN {body} WHEN 'passage' THEN 'Passage ' || {index} || ': ' || {body} WHEN 'evidence_letter' THEN 'Evidence ' || chr(({index} + 64)::INT) || ': ' || {body} WHEN 'bullet' THEN '- ' || {body} ELSE '[E' || {index} || '] ' || {body} END"


def style_of(seed: str) -> str:
    names = "[" + ", ".join(f"'{s}'" for s in C.STYLES) + "]"
    return f"{names}[(list_sum(list_transform(string_split({seed}, ''), lambda c: unicode(c)))::BIGINT % {len(C.STYLES)} + 1)::INT]"


def per_strategy(rankings: str, k: int) -> str:
    """CTE me(strategy, n_queries, ...) from CTE {rankings}(strategy, query_id, ord, rank), with gold and q."""
    ideal = "(CASE WHEN {n} > 0 THEN list_sum(list_transform(range(1, {n} + 1), lambda i: 1.0 / log2(i + 1))) ELSE 1.0 END)".format(n=f"least(n_rel, {k})")
    share = lambda c: f"CASE WHEN n_rel > 0 THEN {c} / n_rel ELSE 0 END"
    return f"""me_g AS (SELECT DISTINCT query_id, ord FROM gold), me_n AS (SELECT query_id, count(*)::INT AS n_rel FROM me_g GROUP BY ALL),
me_j AS (SELECT t.strategy, t.query_id, t.rank, CASE WHEN g.ord IS NULL THEN 0 ELSE 1 END AS rel, sum(CASE WHEN g.ord IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.strategy, t.query_id ORDER BY t.rank ROWS UNBOUNDED PRECEDING) AS seen FROM {rankings} t LEFT JOIN me_g g ON g.query_id = t.query_id AND g.ord = t.ord),
me_m AS (SELECT strategy, query_id, sum(rel) FILTER (rank <= 1) AS h1, sum(rel) FILTER (rank <= 5) AS h5, sum(rel) FILTER (rank <= 10) AS h10, coalesce(sum(1.0 / log2(rank + 1)) FILTER (rel = 1 AND rank <= {k}), 0) AS dcg, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS rr, coalesce(sum(seen / rank) FILTER (rel = 1), 0) AS ps FROM me_j GROUP BY ALL),
me_p AS (SELECT s.strategy, q.query_id, {share("h1")} AS recall_1, {share("h5")} AS recall_5, {share("h10")} AS recall_10, CASE WHEN n_rel > 0 THEN dcg / {ideal} ELSE 0 END AS ndcg, rr, {share("ps")} AS ap FROM (SELECT DISTINCT strategy FROM {rankings}) s CROSS JOIN q LEFT JOIN me_m m ON m.strategy = s.strategy AND m.query_id = q.query_id LEFT JOIN me_n n ON n.query_id = q.query_id),
me AS (SELECT strategy, count(*) AS n_queries, {", ".join(f"round(avg(coalesce({c}, 0)), 6) AS {n}" for c, n in (("recall_1", "recall_1"), ("recall_5", "recall_5"), ("recall_10", "recall_10"), ("ndcg", f"ndcg_{k}"), ("rr", "mrr"), ("ap", "map")))} FROM me_p GROUP BY strategy)"""
