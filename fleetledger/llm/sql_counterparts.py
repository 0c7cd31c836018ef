"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from fleetledger.llm.host_reputation import BAD, CORRELATION, KINDS, ODDS, Z
from fleetledger.llm.line_neighbours import ANCHOR, EXACT_WORDS, NEAR_WORDS


def url_verdicts(rules: dict[str, str]) -> str:
    """Rules first, then host reputation, as ``host_reputation.judge_urls`` has it, without its bound."""

    def level(name: str, source: str, keys: str, prior: str) -> str:
        low, high = CORRELATION
        return f"""
{name}_m AS ({prior}),
{name}_w AS (SELECT 1 / greatest({low}, least({high}, coalesce(CASE WHEN sum(n - 1) > 0 THEN
    (sum(n * pow(bad / n - m, 2) / (m * (1 - m))) - count(*)) / sum(n - 1) END, {high}))) - 1 AS w FROM {name}_m WHERE n > 0),
{name} AS (SELECT {keys}, n, bad, w * m + bad AS a, w * (1 - m) + n - bad AS b FROM {name}_m, {name}_w)"""

    listed = ", ".join(f"('{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}', '{verdict}')" for rule, verdict in rules.items())
    long = ", ".join(f"'{x}'" for x in KINDS)
    return f"""
WITH rules(rule, h, p, v) AS (VALUES {listed}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h0 FROM cut),
split AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM named),
places AS (SELECT DISTINCT host, path FROM split),
fitting AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM places JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
judged AS (SELECT page_id, split.host, split.path, rule, v FROM split LEFT JOIN fitting USING (host, path)),
labels_of AS (SELECT host, count(v) AS n, count(*) FILTER (v = 'block') AS bad, string_split(host, '.') AS l FROM judged GROUP BY host),
kept AS (SELECT host, n, bad, l, least(CASE WHEN len(l) > 2 AND len(l[-1]) = 2 AND l[-2] IN ({long}) THEN 3 ELSE 2 END, len(l)) AS k FROM labels_of),
hosts0 AS (SELECT host, n, bad, array_to_string(l[-k:], '.') AS domain FROM kept),
hosts1 AS (SELECT *, regexp_replace(domain, '^[^.]*\\.', '') AS suffix FROM hosts0),
domains1 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts1 GROUP BY ALL),
suffixes1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains1 GROUP BY ALL),
{level("tops", "suffixes1", "suffix", "SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM suffixes1) AS m FROM suffixes1").strip()},
{level("middles", "domains1", "suffix, domain", "SELECT d.*, a / (a + b) AS m FROM domains1 d JOIN tops USING (suffix)").strip()},
{level("lows", "hosts1", "host", "SELECT h.*, a / (a + b) AS m FROM hosts1 h JOIN middles USING (suffix, domain)").strip()},
odds AS (SELECT {ODDS} * (sum(bad) + 0.5) / (sum(n) - sum(bad) + 0.5) AS o FROM suffixes1),
verdicts AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / pow(a + b, 2) / (a + b + 1)) > least({BAD}, o / (1 + o)) AS blocked FROM lows, odds)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM judged JOIN verdicts USING (host)"""


_SAID = "'<|im_end|><|im_start|>assistant ok'"
#: Digests of conversations from their turns; only the length of the formatted text follows from the template.
CHAT_DIGESTS = f"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID})),
joined AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said,
    sum(length(role) + length(text) + 24 + len(regexp_extract_all(text, '<\\\\*\\|'))) AS size FROM every GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, size::BIGINT AS formatted_chars FROM joined"""


#: Lines removed for an earlier equal or neighbouring line: all pairs of distinct lines that share an end are compared word by word.
LINES_KEPT = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM cut),
every AS (SELECT doc_id, k, ls[k] AS raw, trim(ls[k], ' ') AS line FROM each),
worded AS (SELECT *, string_split(line, ' ') AS w FROM every),
firsts AS (SELECT line, any_value(w) AS w, min((doc_id, k)) AS place FROM worded WHERE len(w) >= {EXACT_WORDS} GROUP BY line),
ends AS (SELECT line, w, place, unnest([('f', w[:{ANCHOR}]), ('l', w[-{ANCHOR}:])]) AS e FROM firsts WHERE len(w) >= {NEAR_WORDS}),
pairs AS (SELECT DISTINCT a.line, a.w AS w, b.w AS v FROM ends a JOIN ends b USING (e) WHERE b.place < a.place AND abs(len(a.w) - len(b.w)) <= 1),
near AS (SELECT DISTINCT line FROM pairs WHERE CASE len(w) - len(v)
    WHEN 0 THEN len(list_filter(range(1, len(w) + 1), lambda i: w[i] <> v[i])) = 1
    WHEN 1 THEN len(list_filter(range(1, len(w) + 1), lambda i: list_concat(w[:i - 1], w[i + 1:]) = v)) > 0
    ELSE len(list_filter(range(1, len(v) + 1), lambda i: list_concat(v[:i - 1], v[i + 1:]) = w)) > 0 END),
judged AS (SELECT x.doc_id, x.k, x.raw, f.place IS NOT NULL AND (f.place <> (x.doc_id, x.k) OR n.line IS NOT NULL) AS gone
    FROM worded x LEFT JOIN firsts f ON x.line = f.line LEFT JOIN near n ON x.line = n.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256 FROM judged GROUP BY doc_id"""

HARD_NEGATIVES = """
with whole as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256.0 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
    select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other, list_inner_product(a.v, b.v)::bigint as score
    from whole a join whole b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, other as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other)::integer as rank,
    s.other as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) <= 10
"""
