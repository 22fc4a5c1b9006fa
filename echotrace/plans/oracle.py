"""DuckDB SQL for the registered queries, put together from named table expressions."""

from __future__ import annotations

from echotrace.functions.text import LOW_TIES  # noqa: F401  the rule the rounding below restates

# The white space of ECMAScript, in RE2 notation.
WS = r"\t\n\x0b\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
JA = r"\p{Han}\p{Hiragana}\p{Katakana}"


def norm(text: str, urls: bool = True, mentions: bool = True) -> str:
    out = f"lower({text})"
    if urls:
        out = f"regexp_replace({out}, 'https?://[^{WS}]+', ' ', 'g')"
    if mentions:
        out = f"regexp_replace({out}, '@[a-z0-9_]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[{WS}]+', ' ', 'g'), ' ')"


def tokens(text: str) -> str:
    pieces = "list_transform(range(1, length(t)), lambda i: substr(t, i, 2))"
    runs = f"regexp_extract_all({text}, '[{JA}ー]+|[\\p{{L}}\\p{{N}}_]+')"
    return f"list_distinct(flatten(list_transform({runs}, lambda t: CASE WHEN regexp_matches(t, '[{JA}]') AND length(t) > 1 THEN {pieces} ELSE [t] END)))"


def fixed2(x: str) -> str:
    """printf rounds by the exact value, and the two exact ties to even."""
    return f"(CASE WHEN {x} = 0.125 THEN 0.13 WHEN {x} = 0.625 THEN 0.63 ELSE printf('%.2f', {x})::DOUBLE END)::DOUBLE"


RANK = "row_number() OVER (ORDER BY CASE WHEN match_type = 'exact' THEN 0 ELSE 1 END, similarity DESC, account_count DESC, first_ms, min_ord)"
CSV = "'\"' || replace(CASE WHEN regexp_matches({0}, '^[=+\\-@]') THEN '''' || {0} ELSE {0} END, '\"', '\"\"') || '\"'"


def csv(*cells: str) -> str:
    return " || ',' || ".join(CSV.format(f"coalesce(({c})::VARCHAR, '')") for c in cells)


def clusters(members: str) -> str:
    return f"""SELECT *, {RANK} AS rank, 'C-' || CASE WHEN {RANK} < 1000 THEN lpad(({RANK})::VARCHAR, 3, '0') ELSE ({RANK})::VARCHAR END AS cluster_id FROM (
  SELECT match_type, cluster_key, {fixed2("max(sim)")} AS similarity, count(*)::BIGINT AS post_count, count(DISTINCT acct)::BIGINT AS account_count,
    min(posted_ms) AS first_ms, min(ord) AS min_ord FROM {members} GROUP BY ALL) WHERE account_count >= 2"""


TABLES: dict[str, str] = {
    "posts": """SELECT doc_id AS ord, doc_id::VARCHAR AS id, source AS account, 'https://sns.example/' || source || '/status/' || doc_id AS url,
  (1704067200000 + ((doc_id * 7919) % 1440) * 60000)::BIGINT AS posted_ms,
  strftime(epoch_ms((1704067200000 + ((doc_id * 7919) % 1440) * 60000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS posted_at, text FROM documents""",
    "prepared": f"SELECT *, lower(account) AS acct, {norm('text')} AS norm FROM posts",
    "groups": """SELECT norm, count(*)::BIGINT AS post_count, count(DISTINCT acct)::BIGINT AS account_count, min(posted_ms) AS first_ms, min(ord) AS min_ord
  FROM prepared WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT acct) >= 2""",
    "rest": "SELECT * FROM prepared WHERE norm <> '' AND norm NOT IN (SELECT norm FROM groups)",
    "sets": f"SELECT ord, acct, {tokens('norm')} AS t FROM rest",
    "items": "SELECT ord, acct, len(t) AS n, unnest(t) AS token FROM sets WHERE len(t) > 0",
    "shared": """SELECT x.ord AS a, y.ord AS b, count(*)::BIGINT AS inter, (x.n + y.n - count(*))::BIGINT AS uni
  FROM items x JOIN items y ON x.token = y.token AND x.ord < y.ord AND x.acct <> y.acct GROUP BY x.ord, y.ord, x.n, y.n""",
    "sims": "SELECT *, inter::DOUBLE / uni::DOUBLE AS sim FROM shared",
    "edges": "SELECT a, b, sim FROM sims WHERE sim >= 0.8::DOUBLE",
    "sym": "SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges",
    "reach": "SELECT x AS node, x AS root FROM sym UNION SELECT sym.y, reach.root FROM reach JOIN sym ON sym.x = reach.node",
    "comps": "SELECT node, min(root) AS component FROM reach GROUP BY node",
    "near": """SELECT r.*, 'approximate' AS match_type, c.component AS cluster_key, m.sim FROM rest r JOIN comps c ON r.ord = c.node
  JOIN (SELECT component, max(sim) AS sim FROM edges JOIN comps ON a = node GROUP BY component) m USING (component)""",
    "exact": "SELECT p.*, 'exact' AS match_type, g.min_ord AS cluster_key, 1.0::DOUBLE AS sim FROM prepared p JOIN groups g USING (norm)",
    "every": "SELECT ord, id, account, url, posted_at, posted_ms, text, acct, match_type, cluster_key, sim FROM exact UNION ALL SELECT ord, id, account, url, posted_at, posted_ms, text, acct, match_type, cluster_key, sim FROM near",
    "clusters": clusters("every"),
    "members": """SELECT c.rank, c.cluster_id, e.match_type, c.similarity, c.account_count, c.post_count,
  row_number() OVER (PARTITION BY c.cluster_id ORDER BY e.posted_ms, e.account, e.id, e.ord)::INTEGER AS position, e.ord, e.id, e.account, e.url, e.posted_at, e.posted_ms, e.text, e.acct
  FROM every e JOIN clusters c ON e.match_type = c.match_type AND e.cluster_key = c.cluster_key""",
    "free": "SELECT *, row_number() OVER (ORDER BY posted_ms, account, id, ord) AS place FROM prepared WHERE ord NOT IN (SELECT ord FROM exact)",
    "cand_rows": """SELECT l.ord AS lo, l.id AS li, l.acct AS la, l.posted_ms AS lm, r.ord AS ro, r.id AS ri, r.acct AS ra, r.posted_ms AS rm, true AS lexical, false AS discovery, l.similarity AS sim
  FROM members l JOIN members r ON l.cluster_id = r.cluster_id AND l.position < r.position WHERE l.match_type = 'approximate' AND l.acct <> r.acct
  UNION ALL SELECT l.ord, l.id, l.acct, l.posted_ms, r.ord, r.id, r.acct, r.posted_ms, false, true, NULL FROM free l JOIN free r ON r.place = l.place + 1 AND l.acct <> r.acct""",
    "cands": """SELECT left_ord, left_id, left_acct, left_posted_ms, right_ord, right_id, right_acct, right_posted_ms, bool_or(lexical) AS lexical, bool_or(discovery) AS discovery,
  max(sim) AS lexical_similarity, 'semantic:' || left_id || ':' || right_id AS candidate_id, abs(left_posted_ms - right_posted_ms) AS time_difference_ms FROM (
  SELECT CASE WHEN li <= ri THEN lo ELSE ro END AS left_ord, CASE WHEN li <= ri THEN li ELSE ri END AS left_id, CASE WHEN li <= ri THEN la ELSE ra END AS left_acct, CASE WHEN li <= ri THEN lm ELSE rm END AS left_posted_ms,
    CASE WHEN li <= ri THEN ro ELSE lo END AS right_ord, CASE WHEN li <= ri THEN ri ELSE li END AS right_id, CASE WHEN li <= ri THEN ra ELSE la END AS right_acct, CASE WHEN li <= ri THEN rm ELSE lm END AS right_posted_ms,
    lexical, discovery, sim FROM cand_rows) GROUP BY ALL""",
    "reviewed": "SELECT * FROM cands ORDER BY lexical DESC, time_difference_ms, left_id, right_id LIMIT 50",
    "judged": """SELECT *, (left_ord * 31 + right_ord * 17) % 10 AS h, CASE WHEN (left_ord * 31 + right_ord * 17) % 10 = 9 THEN 'unavailable' ELSE 'completed' END AS status,
  CASE WHEN (left_ord * 31 + right_ord * 17) % 10 <= 3 THEN 'match' WHEN (left_ord * 31 + right_ord * 17) % 10 <= 6 THEN 'non_match' ELSE 'abstain' END AS label,
  (((left_ord * 7 + right_ord * 13) % 101)::DOUBLE / 100)::DOUBLE AS score, 'vendor/model-' || (left_ord % 2) AS model FROM cands""",
    "decided": """SELECT *, status = 'completed' AND label = 'match' OR (lexical AND NOT (status = 'completed' AND label = 'non_match')) AS kept,
  status = 'completed' AND label = 'match' AND NOT lexical AS added, status = 'completed' AND label = 'non_match' AND lexical AS excluded,
  greatest(coalesce(lexical_similarity, 0), score) AS edge_score FROM judged""",
    "units": f"""SELECT doc_id AS o, length(t) + length(regexp_replace(t, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) > 4000 OR length(t) = 0 AS long
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM documents)""",
    "kept_edges": "SELECT left_ord AS a, right_ord AS b, edge_score AS sim FROM decided WHERE kept",
    "kept_both": "SELECT a AS x, b AS y FROM kept_edges UNION SELECT b, a FROM kept_edges",
    "kept_reach": "SELECT x AS node, x AS root FROM kept_both UNION SELECT kept_both.y, kept_reach.root FROM kept_reach JOIN kept_both ON kept_both.x = kept_reach.node",
    "kept_comps": "SELECT node, min(root) AS component FROM kept_reach GROUP BY node",
    "after": """SELECT p.ord, p.id, p.account, p.posted_ms, p.acct, 'approximate' AS match_type, c.component AS cluster_key, m.sim FROM prepared p JOIN kept_comps c ON p.ord = c.node
  JOIN (SELECT component, max(sim) AS sim FROM kept_edges JOIN kept_comps ON a = node GROUP BY component) m USING (component)
  UNION ALL SELECT ord, id, account, posted_ms, acct, match_type, cluster_key, sim FROM exact""",
    "after_clusters": clusters("after"),
    "after_members": "SELECT c.cluster_id, e.match_type, e.ord FROM after e JOIN after_clusters c ON e.match_type = c.match_type AND e.cluster_key = c.cluster_key",
    "all_items": f"SELECT ord, acct, len(t) AS n, unnest(t) AS token FROM (SELECT ord, acct, {tokens('norm')} AS t FROM prepared) WHERE len(t) > 0",
    "origin": "SELECT * FROM prepared WHERE acct = 'src3' AND norm <> ''",
    "origin_sims": """SELECT x.ord AS a, y.ord AS b, count(*)::DOUBLE / (x.n + y.n - count(*))::DOUBLE AS sim
  FROM all_items x JOIN all_items y ON x.token = y.token AND x.acct <> y.acct WHERE x.acct = 'src3' GROUP BY x.ord, y.ord, x.n, y.n""",
    "copies": f"""SELECT o.ord AS o_ord, o.id AS o_id, o.account AS o_account, o.url AS o_url, o.posted_at AS o_posted_at, o.posted_ms AS o_posted_ms,
  c.ord AS c_ord, c.id AS c_id, c.account AS c_account, c.url AS c_url, c.posted_at AS c_posted_at, c.posted_ms AS c_posted_ms, c.text AS c_text,
  CASE WHEN o.norm = c.norm THEN 'exact' ELSE 'approximate' END AS match_type, CASE WHEN o.norm = c.norm THEN 1.0::DOUBLE ELSE {fixed2("s.sim")} END AS similarity,
  c.posted_ms - o.posted_ms AS time_difference_ms FROM origin o JOIN prepared c ON c.acct <> o.acct AND c.posted_ms > o.posted_ms AND c.norm <> ''
  LEFT JOIN origin_sims s ON s.a = o.ord AND s.b = c.ord WHERE o.norm = c.norm OR s.sim >= 0.8::DOUBLE""",
    "cases": "SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 1 THEN 'match' ELSE 'non_match' END AS expected, CASE WHEN doc_id % 10 = 0 THEN 'abstain' WHEN toxic = 1 THEN 'non_match' ELSE 'match' END AS label, doc_id % 3 AS category FROM labels",
    "evidence": """SELECT l.acct AS source, r.acct AS target, l.match_type AS edge_type, l.similarity AS weight, greatest(l.posted_ms, r.posted_ms) AS observed_ms
  FROM members l JOIN members r ON l.cluster_id = r.cluster_id AND l.position < r.position AND l.acct <> r.acct""",
    "account_edges": """SELECT least(source, target) AS source_account, greatest(source, target) AS target_account, edge_type, sum(weight) AS weight, count(*)::BIGINT AS evidence_count,
  min(observed_ms) AS first_observed_ms, max(observed_ms) AS last_observed_ms, edge_type || '|' || least(source, target) || '|' || greatest(source, target) AS edge_id FROM evidence GROUP BY ALL""",
    "usage": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS spent FROM events GROUP BY ALL",
}

RECURSIVE = ("reach", "kept_reach")


def sql(final: str, other: dict[str, str] | None = None) -> str:
    """`final` after the table expressions that it names, directly or not; those of `other` stand in for the known ones."""
    import re

    tables = TABLES | (other or {})
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if name in tables and name not in need and name not in busy:
                busy.append(name)
                visit(tables[name])
                need.append(name)

    busy: list[str] = []
    visit(final)
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({tables[n]})" for n in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final
