"""The same results as plain SQL, written independently of the Spark plans.

Each string runs on DuckDB over the benchmark tables. Fixed values (probe prompts, rule
patterns, verdicts) are shared with the library; all logic is restated: range self-joins
instead of interval sums, recursive queries instead of folds.
"""

from __future__ import annotations

from promptwatch.functions import cost as C
from promptwatch.functions import rules as R
from promptwatch.functions import verdicts as V
from promptwatch.plans.queries import CATEGORIES
from promptwatch.sources import bindings as B

ORACLES: dict[str, str] = {}


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


HOUR, DAY = 3_600_000_000, 86_400_000_000
#: White space, spelled out because the SQL regex dialect only knows the ASCII kind.
SPACES = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

BANK = "bank(k, prompt) AS (VALUES " + ", ".join(
    f"({i}, {lit(p)})" for i, p in enumerate(B.PROBE_PROMPTS)
) + ")"
PROMPTS = BANK + """, prompts AS (
  SELECT 'd' || doc_id AS prompt_id, text AS prompt FROM documents
  UNION ALL SELECT 'b' || k, prompt FROM bank
  UNION ALL SELECT 'c_' || conv_id || '_' || turn, text FROM conversations)"""
REQUESTS = BANK + """, requests AS (
  SELECT event_id AS request_id, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS user_id,
         '10.0.0.' || (user_id % 7) AS client_ip, bank.prompt
  FROM events JOIN bank ON bank.k = event_id % 28)"""
VERDICTS = "vbank(v, ext_json, defender_text) AS (VALUES " + ", ".join(
    f"({i}, {lit(a)}, {lit(b)})" for i, (a, b) in enumerate(B.PROBE_VERDICTS)
) + """), verdicts AS (
  SELECT event_id AS request_id, ext_json, defender_text FROM events JOIN vbank ON vbank.v = event_id % """ + f"{len(B.PROBE_VERDICTS)})"
CONTROL = "control(kind, key, action, reason, triggered_by, acted, seq) AS (VALUES " + ", ".join(
    f"({lit(k)}, {lit(key)}, {lit(a)}, {lit(r)}, {lit(t)}, TIMESTAMP {lit(at)}, {i})"
    for i, (k, key, a, r, t, at) in enumerate(B.CONTROL_ACTIONS)
) + ")"


def any_pattern(rules: list) -> str:
    return lit("|".join(f"(?:{p})" for p, _ in rules))


def any_substring(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def decodes_to(match: str, words: list[str]) -> str:
    """Does this base64 run, if validly padded, decode to text with one of the words?"""
    data = f"rtrim({match}, '=')"
    pads = f"(length({match}) - length({data}))"
    rest = f"(length({data}) % 4)"
    ok = f"({rest} = 0 OR ({rest} = 2 AND {pads} = 2) OR ({rest} = 3 AND {pads} >= 1))"
    whole = f"rpad({data}, CAST(ceil(length({data}) / 4.0) * 4 AS INTEGER), '=')"
    decoded = f"lower(CAST(from_base64({whole}) AS VARCHAR))"
    return f"(CASE WHEN {ok} THEN regexp_matches({decoded}, {lit('|'.join(words))}) ELSE false END)"


def signals(source: str, key: str) -> str:
    """CTEs ``forms`` and ``sig``: every stateless signal of ``source(key, prompt)``."""
    weights = ", ".join(
        f"CASE WHEN {any_substring('norm', [w])} THEN {x / 5} ELSE 1 END" for w, x in C.EXPANSION_WEIGHTS.items()
    )
    flags = {name: f"regexp_matches(low, {any_pattern(rules)})" for name, rules in R.PHRASE_RULES.items()}
    flags["HIDDEN_UNICODE_PAYLOAD"] = any_substring("prompt", R.INVISIBLE)
    flags["WHITESPACE_STUFFING"] = f"regexp_matches(prompt, '[{SPACES}]{{20,}}')"
    flags["HTML_COMMENT_INJECTION"] = "regexp_matches(prompt, '<!--.*?-->', 's')"
    hits = decodes_to("m", R.INJECTION_WORDS)
    flags["BASE64_INJECTION"] = f"len(list_filter(runs30[1:5], lambda m: {hits})) > 0"
    flag_columns = ", ".join(f"{e} AS f_{n.lower()}" for n, e in flags.items())
    flag_list = ", ".join(f"CASE WHEN f_{n.lower()} THEN {lit(n)} END" for n in sorted(flags))
    amp = {n: f"regexp_matches(low, {any_pattern(rules)})" for n, rules in R.AMPLIFICATION_RULES.items()}
    product = r"(\d+)\s+\w+\s+(?:each\s+(?:containing\s+)?|of\s+)(\d+)\s+\w+"
    payloads = decodes_to("m", C.PAYLOAD_WORDS)
    return f"""forms AS (
      SELECT {key}, prompt, lower(prompt) AS low, translate(lower(prompt), '013457@$!+', 'oieastasit') AS norm,
             len(regexp_extract_all(prompt, '[^{SPACES}]+')) AS words,
             list_max(list_transform(regexp_extract_all(prompt, '\\b\\d+\\b'), lambda x: CAST(x AS DOUBLE))) AS biggest,
             regexp_extract_all(prompt, '[A-Za-z0-9+/]{{40,}}={{0,2}}') AS runs40,
             regexp_extract_all(prompt, '[A-Za-z0-9+/]{{30,}}={{0,2}}') AS runs30,
             regexp_extract_all(prompt, '[A-Za-z0-9@$!+]+') AS tokens,
             list_entropy(regexp_extract_all(prompt, '(?s).')) AS bits
      FROM {source}),
    base AS (SELECT *, {any_substring('norm', C.INSTRUCTION_WORDS)} AS has_instruction,
             len(list_filter(tokens, lambda t: regexp_matches(t, '[A-Za-z]'))) AS letters,
             len(list_filter(tokens, lambda t: regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[013457@$!+]'))) AS mixed,
             regexp_extract(low, {lit(product)}, 1) AS n1, regexp_extract(low, {lit(product)}, 2) AS n2,
             greatest(words * CAST(1.3 AS DOUBLE), 1) AS amp_tokens
      FROM forms),
    feats AS (SELECT *,
             least(CASE WHEN len(runs40) > 0 THEN 50.0::DOUBLE ELSE 0 END
                   + 40 * len(list_filter(runs40[1:3], lambda m: {payloads}))
                   + CASE WHEN regexp_matches(prompt, '(?:0x)?[0-9a-fA-F]{{20,}}') THEN 20 ELSE 0 END, 100)::DOUBLE AS encoding_score,
             least(greatest({weights}, CASE WHEN has_instruction AND biggest > 100 THEN biggest / 20 ELSE 1 END), 50)::DOUBLE AS expansion_factor,
             CASE WHEN letters = 0 THEN 0 ELSE least(mixed / letters::DOUBLE * 120, 100) END::DOUBLE AS obfuscation_score,
             CASE WHEN length(prompt) < 20 OR (bits BETWEEN 3.5 AND 4.7) THEN 0
                  WHEN bits < 3.5 THEN least((3.5 - bits) * 40, 100) ELSE least((bits - 4.7) * 40, 100) END::DOUBLE AS entropy_score,
             CAST(floor(words * CAST(1.3 AS DOUBLE)) AS INTEGER) AS input_tokens,
             CASE WHEN n1 <> '' THEN CAST(n1 AS DOUBLE) * CAST(n2 AS DOUBLE) * 1.3::DOUBLE / amp_tokens
                  WHEN biggest > 50 THEN biggest / 10 ELSE 1 END::DOUBLE AS explicit
      FROM base),
    sig AS (SELECT *,
             CAST(floor(input_tokens * expansion_factor) AS BIGINT) AS predicted_tokens,
             CAST(round_even((encoding_score + least(expansion_factor * 2, 100) + obfuscation_score + entropy_score) / 4, 0) AS INTEGER) AS cost_score,
             {flag_columns},
             {amp['RECURSIVE_PATTERN']} AS a_rec, {amp['SELF_REPLICATION']} AS a_rep
      FROM feats),
    flagged AS (SELECT *,
             list_filter([{flag_list}], lambda x: x IS NOT NULL) AS rule_flags,
             greatest(predicted_tokens / amp_tokens, explicit) AS multiplier
      FROM sig)"""


def over_prompts(columns: str, tail: str = "") -> str:
    return f"WITH {PROMPTS}, {signals('prompts', 'prompt_id')} SELECT {columns} FROM flagged {tail}"


RULE_SCORE = "CAST(least(18 * len(rule_flags), 100) AS INTEGER)"
BAND = "CASE WHEN cost_score > 70 THEN 'high' WHEN cost_score > 40 THEN 'medium' ELSE 'low' END"
ORACLES.update({
    "normalize_leet": over_prompts("prompt_id, md5(norm) AS norm_md5"),
    "has_instruction_verb": over_prompts("prompt_id, has_instruction"),
    "max_number": over_prompts("prompt_id, biggest"),
    "encoding_score": over_prompts("prompt_id, encoding_score"),
    "expansion_factor": over_prompts("prompt_id, round(expansion_factor, 4) AS expansion_factor"),
    "obfuscation_score": over_prompts("prompt_id, round(obfuscation_score, 4) AS obfuscation_score"),
    "shannon_entropy": over_prompts("prompt_id, round(bits, 4) AS entropy"),
    "entropy_by_key": over_prompts("prompt_id, round(bits, 4) AS entropy"),
    "entropy_score": over_prompts("prompt_id, round(entropy_score, 3) AS entropy_score"),
    "char_histogram": f"WITH {PROMPTS} SELECT ch, count(*) AS n FROM "
                      "(SELECT unnest(regexp_extract_all(prompt, '(?s).')) AS ch FROM prompts) GROUP BY ch",
    "input_tokens": over_prompts("prompt_id, input_tokens"),
    "predicted_tokens": over_prompts("prompt_id, predicted_tokens"),
    "cost_score": over_prompts("prompt_id, cost_score"),
    "cost_band": over_prompts(f"{BAND} AS band, count(*) AS n", "GROUP BY 1"),
    "cost_features": over_prompts(
        "prompt_id, round(encoding_score, 3) AS encoding_score, "
        "round(least(expansion_factor * 2, 100), 3) AS expansion_normalized, "
        "round(obfuscation_score, 3) AS obfuscation_score, round(entropy_score, 3) AS entropy_score"
    ),
    "cost_analyze": over_prompts(
        "prompt_id, cost_score, predicted_tokens, input_tokens, round(encoding_score, 1) AS encoding_score, "
        "round(expansion_factor, 1) AS expansion_factor, 'fallback_average' AS scoring_method"
    ),
    "recursive_pattern_flag": over_prompts("prompt_id, a_rec AS hit"),
    "self_replication_flag": over_prompts("prompt_id, a_rep AS hit"),
    "explicit_multiplier": over_prompts("prompt_id, round(explicit, 3) AS multiplier"),
    "amplification_detect": over_prompts(
        "prompt_id, round(log10(round(multiplier, 2)), 6) AS log_multiplier, "
        "concat_ws(',', CASE WHEN a_rec THEN 'RECURSIVE_PATTERN' END, CASE WHEN a_rep THEN 'SELF_REPLICATION' END) AS flags, "
        "(a_rec OR a_rep OR multiplier > 5) AS recursive_detected, CAST(floor(amp_tokens) AS INTEGER) AS input_tokens"
    ),
    "amplification_false_positives": over_prompts(
        "count(*) AS documents, count(*) FILTER (a_rec OR a_rep OR multiplier > 5) AS blocked, "
        "count(*) FILTER (a_rec OR a_rep OR greatest(predicted_tokens / amp_tokens, "
        "CASE WHEN n1 <> '' THEN explicit ELSE 1 END) > 5) AS blocked_without_bare_numbers",
        "WHERE prompt_id LIKE 'd%'",
    ),
    "flag_html_comment_pages": "SELECT page_id, regexp_matches(html, '<!--.*?-->', 's') AS hit FROM pages",
    "rule_flags": over_prompts(f"prompt_id, array_to_string(rule_flags, ',') AS rule_flags, {RULE_SCORE} AS rule_score"),
    "rule_score": over_prompts(f"{RULE_SCORE} AS rule_score, count(*) AS n", "GROUP BY 1"),
})
for _query, _flag in {
    "flag_jailbreak": "jailbreak_attempt", "flag_role_injection": "role_injection",
    "flag_ignore_instructions": "ignore_instructions", "flag_system_override": "system_override_attempt",
    "flag_hidden_unicode": "hidden_unicode_payload", "flag_whitespace_stuffing": "whitespace_stuffing",
    "flag_html_comment": "html_comment_injection", "flag_base64_injection": "base64_injection",
    "flag_prompt_leaking": "prompt_leaking_attempt", "flag_context_manipulation": "context_manipulation",
}.items():
    ORACLES[_query] = over_prompts(f"prompt_id, f_{_flag} AS hit")

WORDS6 = f"array_to_string(regexp_extract_all(prompt, '[^{SPACES}]+')[1:6], ' ')"
STRIPPED = f"regexp_replace(regexp_replace(prompt, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"
HASH = f"substr(sha256(lower({STRIPPED})), 1, 16)"
PATTERN = f"substr(md5(lower({WORDS6})), 1, 12)"
ORACLES.update({
    "rank_first_n_matches": f"WITH {PROMPTS} SELECT prompt_id, {WORDS6} AS words FROM prompts",
    "prompt_hash": f"WITH {PROMPTS} SELECT prompt_id, {HASH} AS prompt_hash FROM prompts",
    "prompt_pattern": f"WITH {PROMPTS} SELECT prompt_id, {PATTERN} AS prompt_pattern FROM prompts",
    "campaign_id": f"WITH {PROMPTS} SELECT prompt_id, 'CAMP-' || upper(substr({HASH}, 1, 8)) AS campaign_id FROM prompts",
})

# -- verdicts ------------------------------------------------------------------------------

_MAP = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in V.CATEGORY_FLAGS.items()) + "}"
EXT = f"""vparsed AS (
  SELECT request_id, ext_json, defender_text,
         coalesce(json_extract(whole, '$.results[0]'), whole) AS j
  FROM (SELECT *, CASE WHEN json_type(TRY_CAST(ext_json AS JSON)) = 'OBJECT' THEN TRY_CAST(ext_json AS JSON) END AS whole FROM verdicts)),
vmaps AS (
  SELECT *, CASE WHEN j IS NOT NULL THEN coalesce(CAST(json_extract(j, '$.flagged') AS BOOLEAN), false) END AS flagged,
         coalesce(from_json(json_extract(j, '$.categories'), '"MAP(VARCHAR, BOOLEAN)"'), MAP {{}}) AS cats,
         coalesce(from_json(json_extract(j, '$.category_scores'), '"MAP(VARCHAR, DOUBLE)"'), MAP {{}}) AS scores
  FROM vparsed),
ext AS (
  SELECT request_id, ext_json, defender_text, flagged, cats, scores,
         list_sort(list_distinct(list_transform(list_filter(map_entries(cats), lambda e: e.value),
           lambda e: coalesce({_MAP}[e.key], 'LAKERA_' || upper(e.key))))) AS ext_flags,
         CAST(CASE WHEN j IS NULL THEN 0 WHEN len(map_values(scores)) > 0 THEN floor(list_max(map_values(scores)) * 100)
              WHEN flagged THEN 100 ELSE 0 END AS INTEGER) AS ext_score,
         CASE WHEN j IS NULL THEN 'unavailable' ELSE 'ok' END AS ext_status
  FROM vmaps)"""
DEFENDER = r"""dbody AS (
  SELECT request_id, CASE WHEN starts_with(trim(defender_text), '```')
           THEN regexp_replace(defender_text, '(?m)^```.*$', '', 'g') ELSE defender_text END AS body FROM verdicts),
dread AS (SELECT request_id, TRY_CAST(body AS JSON) AS d FROM dbody),
dparsed AS (
  SELECT request_id, CASE WHEN json_type(d) = 'OBJECT' AND coalesce(json_type(d, '$.threats'), 'ARRAY') IN ('ARRAY', 'VARCHAR') THEN d END AS d
  FROM dread),
dfields AS (
  SELECT request_id, d,
         CASE WHEN json_type(d, '$.defender_risk') = 'BOOLEAN' THEN CAST(json_extract(d, '$.defender_risk') = 'true' AS DOUBLE)
              WHEN json_exists(d, '$.defender_risk') THEN TRY_CAST(json_extract_string(d, '$.defender_risk') AS DOUBLE) ELSE 0.1 END AS risk,
         CASE WHEN json_type(d, '$.confidence') = 'BOOLEAN' THEN CAST(json_extract(d, '$.confidence') = 'true' AS DOUBLE)
              WHEN json_exists(d, '$.confidence') THEN TRY_CAST(json_extract_string(d, '$.confidence') AS DOUBLE) ELSE 0.5 END AS conf
  FROM dparsed),
def AS (
  SELECT request_id,
         CASE WHEN d IS NULL OR risk IS NULL OR conf IS NULL THEN 0.1 ELSE greatest(0, least(1, risk)) END::DOUBLE AS defender_risk,
         CASE WHEN d IS NULL OR risk IS NULL OR conf IS NULL THEN 0 ELSE greatest(0, least(1, conf)) END::DOUBLE AS confidence,
         CASE WHEN d IS NULL OR risk IS NULL OR conf IS NULL THEN 'defender unavailable'
              ELSE coalesce(json_extract_string(d, '$.reason'), 'no reason provided') END AS reason,
         CASE WHEN d IS NULL OR risk IS NULL OR conf IS NULL THEN ''
              WHEN json_type(d, '$.threats') = 'VARCHAR' THEN array_to_string(regexp_extract_all(json_extract_string(d, '$.threats'), '(?s).'), ',')
              ELSE coalesce(array_to_string(CAST(json_extract(d, '$.threats') AS VARCHAR[]), ','), '') END AS threats
  FROM dfields)"""
DEFENDER_BAND = "CASE WHEN defender_risk >= 0.5 THEN 'dangerous' WHEN defender_risk > 0.4 THEN 'suspicious' ELSE 'safe' END"
RISK = f"""{REQUESTS}, {VERDICTS}, {EXT}, {signals('bank', 'k')},
risk AS (
  SELECT r.request_id, r.ts_us, r.user_id, r.client_ip, r.prompt, f.cost_score, f.multiplier,
         (f.a_rec OR f.a_rep OR f.multiplier > 5) AS recursive_detected, f.rule_flags, e.ext_flags,
         list_sort(list_distinct(list_concat(f.rule_flags, e.ext_flags))) AS flags,
         greatest({RULE_SCORE}, e.ext_score) AS risk_score
  FROM requests r JOIN flagged f ON f.k = r.request_id % 28 JOIN ext e USING (request_id))"""
RISK_BAND = "CASE WHEN risk_score > 80 THEN 'critical' WHEN len(flags) > 0 THEN 'suspicious' ELSE 'clean' END"
ORACLES.update({
    "ext_verdict_normalize": f"WITH {VERDICTS}, {EXT} SELECT request_id, flagged, CASE WHEN flagged IS NOT NULL THEN "
                             "array_to_string(list_sort(map_keys(cats)), ',') END AS categories, "
                             "list_max(map_values(scores)) AS max_score FROM ext",
    "ext_flags": f"WITH {VERDICTS}, {EXT} SELECT request_id, array_to_string(ext_flags, ',') AS ext_flags FROM ext",
    "ext_score": f"WITH {VERDICTS}, {EXT} SELECT request_id, ext_score FROM ext",
    "external_verdict_join": f"WITH {REQUESTS}, {VERDICTS}, {EXT}, hashed AS (SELECT request_id, {HASH} AS h FROM requests), "
                             "firsts AS (SELECT h, arg_min_null(e.request_id, request_id) AS pick FROM hashed JOIN ext e USING (request_id) GROUP BY h) "
                             "SELECT e.ext_status, e.ext_score, count(*) AS n FROM hashed "
                             "JOIN firsts USING (h) JOIN ext e ON e.request_id = firsts.pick GROUP BY 1, 2",
    "risk_merge": f"WITH {RISK} SELECT request_id, array_to_string(flags, ',') AS risk_flags, risk_score, len(flags) > 0 AS is_suspicious FROM risk",
    "risk_band": f"WITH {RISK} SELECT {RISK_BAND} AS band, count(*) AS n FROM risk GROUP BY 1",
    "flag_union": f"WITH {RISK} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM risk) GROUP BY 1",
    "defender_parse": f"WITH {VERDICTS}, {DEFENDER} SELECT request_id, defender_risk, confidence, reason, threats FROM def",
    "defender_band": f"WITH {VERDICTS}, {DEFENDER} SELECT {DEFENDER_BAND} AS band, count(*) AS n FROM def GROUP BY 1",
    "defender_verdict_join": f"WITH {REQUESTS}, {VERDICTS}, {DEFENDER} SELECT user_id, count(*) AS n, "
                             "round(avg(defender_risk), 4) AS avg_risk FROM requests JOIN def USING (request_id) GROUP BY 1",
})

# -- similarity ------------------------------------------------------------------------------

_CATS = "[" + ", ".join(lit(c) for c in CATEGORIES) + "]"
SIMS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE label < 6),
ex AS (SELECT vec_id, {_CATS}[label + 1] AS category, CAST(embedding AS DOUBLE[]) AS e FROM ranked WHERE r <= 5),
pr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM ex)),
best AS (SELECT pr.vec_id, category, max(list_cosine_similarity(v, e)) AS s FROM pr CROSS JOIN ex GROUP BY 1, 2)"""
ORACLES.update({
    "unit_normalize": "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS x0, "
                      "round(1.0::DOUBLE, 5) AS norm2 FROM embeddings",
    "semantic_match": f"WITH {SIMS} SELECT vec_id, category, round(round(s, 4), 3) AS similarity FROM best WHERE s >= 0.30",
    "best_similarity": f"WITH {SIMS} SELECT vec_id, round(round(greatest(max(s), 0), 4), 3) AS max_similarity FROM best GROUP BY 1",
    "semantic_score": f"WITH {SIMS} SELECT vec_id, CAST(CASE WHEN max(s) >= 0.30 THEN round_even(round(max(s), 4) * 100, 0) ELSE 0 END AS INTEGER) AS semantic_score FROM best GROUP BY 1",
})


# -- windows ---------------------------------------------------------------------------------

def window_counts(source: str, key: str, window_us: int, name: str) -> str:
    """CTE ``name``: distinct senders and addresses of ``key`` in the window, by range self-join."""
    return f"""{name} AS (
      SELECT a.request_id, count(DISTINCT b.user_id || '|' || b.client_ip) AS senders, count(DISTINCT b.client_ip) AS ips
      FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND b.ts_us BETWEEN a.ts_us - {window_us} AND a.ts_us
      GROUP BY 1)"""


TYPED = """typed AS (SELECT event_id AS request_id, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS user_id,
  '10.0.0.' || (user_id % 7) AS client_ip, event_type FROM events)"""
EXACT_CONFIDENCE = "round(least(0.95, 0.5 + 0.1 * {n}), 2)::DOUBLE"
FUZZY_CONFIDENCE = "round(least(0.85, 0.4 + 0.08 * {n}), 2)::DOUBLE"


def anchored(source: str, key: str, length_us: int, name: str) -> str:
    """CTE ``name(request_id, window_start, window_index)`` by walking each key event by event."""
    return f"""{name}_seq AS (SELECT request_id, {key} AS g, ts_us, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, request_id) AS rn FROM {source}),
    {name} AS (
      SELECT g, rn, request_id, ts_us AS window_start, 1::BIGINT AS window_index FROM {name}_seq WHERE rn = 1
      UNION ALL
      SELECT s.g, s.rn, s.request_id,
             CASE WHEN s.ts_us >= p.window_start + {length_us} THEN s.ts_us ELSE p.window_start END,
             CASE WHEN s.ts_us >= p.window_start + {length_us} THEN 1 ELSE p.window_index + 1 END
      FROM {name} p JOIN {name}_seq s ON s.g = p.g AND s.rn = p.rn + 1)"""


SIGHTINGS = f"{REQUESTS}, sight AS (SELECT request_id, ts_us, user_id, client_ip, {HASH} AS h, {PATTERN} AS p FROM requests)"


def correlated(source: str, window_us: int) -> str:
    """CTE ``corr`` over ``source(request_id, ts_us, user_id, client_ip, h, p)``."""
    return f"""{window_counts(source, 'h', window_us, 'byhash')}, {window_counts(source, 'p', window_us, 'bypattern')},
    corr AS (
      SELECT s.request_id, s.ts_us, s.h, (x.senders >= 3 OR f.senders >= 4 OR x.ips >= 3) AS campaign_detected,
             CASE WHEN x.senders >= 3 OR f.senders >= 4 OR x.ips >= 3 THEN 'CAMP-' || upper(substr(s.h, 1, 8)) END AS campaign_id,
             CASE WHEN x.senders >= 3 THEN {EXACT_CONFIDENCE.format(n='x.senders')}
                  WHEN f.senders >= 4 THEN {FUZZY_CONFIDENCE.format(n='f.senders')} ELSE 0 END AS confidence,
             x.ips >= 3 AS distributed
      FROM {source} s JOIN byhash x USING (request_id) JOIN bypattern f USING (request_id))"""


CAMPAIGNS = f"{SIGHTINGS}, {correlated('sight', DAY)}, hits AS (SELECT * FROM corr WHERE campaign_detected), {anchored('hits', 'h', DAY, 'opened')}"
CAMPAIGN_ROWS = (
    "SELECT hits.campaign_id, hits.h AS prompt_hash, hits.ts_us AS detected_at "
    "FROM opened JOIN hits USING (request_id) WHERE window_index = 1"
)
ORACLES.update({
    "campaign_exact": f"WITH {TYPED}, {window_counts('typed', 'event_type', HOUR, 'c')} SELECT request_id, senders AS exact_count, "
                      f"CASE WHEN senders >= 3 THEN {EXACT_CONFIDENCE.format(n='senders')} ELSE 0 END AS confidence FROM c",
    "campaign_fuzzy": f"WITH {TYPED}, {window_counts('typed', 'event_type', HOUR, 'c')} SELECT request_id, senders AS fuzzy_count, "
                      f"CASE WHEN senders >= 4 THEN {FUZZY_CONFIDENCE.format(n='senders')} ELSE 0 END AS confidence FROM c",
    "distributed_attack": f"WITH {TYPED}, {window_counts('typed', 'event_type', HOUR, 'c')} SELECT request_id, ips AS ip_count, ips >= 3 AS distributed FROM c",
    "correlation_check": f"WITH {SIGHTINGS}, {correlated('sight', DAY)} SELECT request_id, campaign_detected, campaign_id, confidence, distributed FROM corr",
    "anchored_window": f"WITH RECURSIVE {REQUESTS}, {anchored('requests', 'user_id', DAY, 'w')} SELECT request_id, window_start, window_index FROM w",
    "quota_check": f"WITH RECURSIVE {REQUESTS}, {anchored('requests', 'user_id', DAY, 'w')} SELECT request_id, "
                   "CAST(least(window_index, 3) AS INTEGER) AS quota_used, window_index <= 3 AS quota_allowed FROM w",
    "campaign_log": f"WITH RECURSIVE {CAMPAIGNS} {CAMPAIGN_ROWS}",
    "campaign_topk": f"WITH RECURSIVE {CAMPAIGNS} {CAMPAIGN_ROWS} ORDER BY detected_at DESC, campaign_id LIMIT 20",
})

# -- blacklist -------------------------------------------------------------------------------

LARGE_CONTROL = """actions AS (
  SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 'add' ELSE 'remove' END AS action,
         'value ' || CAST(trunc(value) AS INTEGER) AS reason, 'auto' AS triggered_by, event_id AS seq, epoch_us(ts) AS ts_us
  FROM events WHERE event_type IN ('error', 'signup'))"""
SMALL_CONTROL = f"{CONTROL}, actions AS (SELECT kind, key, action, reason, triggered_by, seq, epoch_us(acted) AS ts_us FROM control)"
CURRENT = """latest AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts_us DESC, seq DESC) AS r FROM actions),
current_list AS (SELECT kind, key, reason, triggered_by, ts_us FROM latest WHERE r = 1 AND action = 'add')"""


def gated(source: str) -> str:
    """CTE ``gate``: the last action on the user, then on the address, decides."""
    return f"""gate AS (
      SELECT s.request_id, s.user_id, s.ts_us,
             CASE WHEN u.action = 'add' THEN coalesce('user blacklisted: ' || u.reason, 'user blacklisted')
                  WHEN i.action = 'add' THEN 'ip blacklisted' END AS deny_reason
      FROM {source} s
      ASOF LEFT JOIN (SELECT * FROM actions WHERE kind = 'user') u ON s.user_id = u.key AND s.ts_us >= u.ts_us
      ASOF LEFT JOIN (SELECT * FROM actions WHERE kind = 'ip') i ON s.client_ip = i.key AND s.ts_us >= i.ts_us)"""


ORACLES.update({
    "blacklist_current": f"WITH {LARGE_CONTROL}, {CURRENT} SELECT kind, key, reason, triggered_by, ts_us FROM current_list",
    "blacklist_gate": f"WITH {REQUESTS}, {LARGE_CONTROL}, {gated('requests')} SELECT request_id, deny_reason FROM gate",
    "blacklist_reason": f"WITH {REQUESTS}, {SMALL_CONTROL}, {gated('requests')} SELECT deny_reason, count(*) AS n FROM gate GROUP BY 1",
    "auth_check": f"WITH RECURSIVE {REQUESTS}, {SMALL_CONTROL}, {gated('requests')}, "
                  f"open_rows AS (SELECT * FROM gate WHERE deny_reason IS NULL), {anchored('open_rows', 'user_id', DAY, 'w')} "
                  "SELECT g.request_id, coalesce(window_index <= 3, false) AS allowed, "
                  "coalesce(deny_reason, CASE WHEN window_index > 3 THEN 'quota exceeded' END) AS reason, "
                  "CAST(CASE WHEN window_index <= 3 THEN window_index END AS INTEGER) AS quota_used, 3 AS quota_limit "
                  "FROM gate g LEFT JOIN w USING (request_id)",
})

# -- reputation --------------------------------------------------------------------------------

GAP = "((s.ts_us - p.last_seen) / 3600000000.0::DOUBLE)"
DECAYED = (
    f"floor((CASE WHEN {GAP} > 24 THEN greatest(0.3::DOUBLE, p.trust - 0.02::DOUBLE * ({GAP} / 24)) ELSE p.trust END) * 1000 + 0.5) / 1000"
)


def reputation(resets: str) -> str:
    """CTE ``rep``: trust per event, walked in order; ``resets`` is the event type that forgets the user."""
    return f"""rep_seq AS (
      SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS ts_us,
             CASE WHEN event_type = {lit(resets)} THEN 'reset' WHEN event_type = 'error' THEN 'abuse' ELSE 'success' END AS kind,
             (event_id % 100)::DOUBLE AS cost,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    rep AS (
      SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS request_id, NULL::BIGINT AS ts_us, NULL::DOUBLE AS trust_read,
             NULL::DOUBLE AS trust, NULL::BIGINT AS last_seen, 0::BIGINT AS total, 0::BIGINT AS abuses, 0::DOUBLE AS avg_cost, '' AS kind
      FROM (SELECT DISTINCT user_id FROM rep_seq)
      UNION ALL
      SELECT user_id, rn, request_id, ts_us, seen,
             CASE kind WHEN 'success' THEN least(1.0::DOUBLE, seen + 0.05::DOUBLE * (1 - cost / 200))
                       WHEN 'abuse' THEN greatest(0.0::DOUBLE, seen - 0.2::DOUBLE) END,
             CASE kind WHEN 'success' THEN ts_us WHEN 'abuse' THEN last_seen END,
             CASE kind WHEN 'success' THEN total + 1 WHEN 'abuse' THEN total ELSE 0 END,
             CASE kind WHEN 'abuse' THEN abuses + 1 WHEN 'success' THEN abuses ELSE 0 END,
             CASE kind WHEN 'success' THEN floor(((avg_cost * total + cost) / (total + 1)) * 100 + 0.5) / 100
                       WHEN 'abuse' THEN avg_cost ELSE 0 END,
             kind
      FROM (SELECT s.user_id, s.rn, s.request_id, s.ts_us, s.kind, s.cost,
                   CASE WHEN s.kind = 'reset' THEN NULL WHEN p.trust IS NULL THEN 0.7::DOUBLE ELSE {DECAYED} END AS seen,
                   coalesce(p.last_seen, s.ts_us) AS last_seen, p.total, p.abuses, p.avg_cost
            FROM rep p JOIN rep_seq s ON s.user_id = p.user_id AND s.rn = p.rn + 1))"""


REP = reputation("none")
TIER = "CASE WHEN {t} >= 0.75 THEN 'trusted' WHEN {t} >= 0.45 THEN 'authenticated' ELSE 'anonymous' END"
BOARD = f"""{REP}, {LARGE_CONTROL}, {CURRENT},
states AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1),
board AS (SELECT s.user_id, floor(s.trust * 1000 + 0.5) / 1000 AS trust_score,
  CASE WHEN c.key IS NOT NULL THEN 'blacklisted' ELSE {TIER.format(t='s.trust')} END AS tier,
  s.abuses AS abuse_count, s.total AS total_requests, s.avg_cost AS avg_cost_score, s.last_seen AS last_seen_us,
  c.key IS NOT NULL AS is_blacklisted, c.reason AS blacklist_reason, c.triggered_by, c.ts_us AS blacklisted_us
  FROM states s LEFT JOIN current_list c ON c.kind = 'user' AND c.key = s.user_id)"""
ORACLES.update({
    "reputation_fold": f"WITH RECURSIVE {REP} SELECT request_id, round(trust_read, 3) AS trust_read, round(trust, 6) AS trust_score, "
                       "total AS total_requests, abuses AS abuse_count FROM rep WHERE rn > 0",
    "reputation_as_of": f"WITH RECURSIVE {REP} SELECT request_id, user_id, round(trust_read, 3) AS trust_read, {TIER.format(t='trust_read')} AS tier FROM rep WHERE rn > 0",
    "avg_cost_running": f"WITH RECURSIVE {REP} SELECT request_id, round(avg_cost, 2) AS avg_cost_score FROM rep WHERE rn > 0",
    "blacklist_candidates": f"WITH RECURSIVE {REP} SELECT DISTINCT user_id FROM rep WHERE kind = 'abuse' AND trust <= 0.05",
    "reputation_board": f"WITH RECURSIVE {BOARD} SELECT * EXCLUDE (triggered_by, blacklisted_us) FROM board",
    "board_sort": f"WITH RECURSIVE {BOARD} SELECT row_number() OVER (ORDER BY is_blacklisted DESC, trust_score, user_id) AS position, "
                  "user_id, is_blacklisted, trust_score FROM board",
    "board_reasons": f"WITH RECURSIVE {BOARD} SELECT user_id, blacklist_reason AS reason, triggered_by, blacklisted_us FROM board WHERE is_blacklisted",
    "reputation_kpis": f"WITH RECURSIVE {BOARD} SELECT count(*) AS users, count(*) FILTER (tier = 'trusted') AS trusted, "
                       "count(*) FILTER (is_blacklisted) AS blacklisted, round(avg(trust_score), 3) AS avg_trust FROM board",
    "user_filter": f"WITH RECURSIVE {BOARD} SELECT user_id, tier FROM board WHERE contains(lower(user_id), '1')",
    "last_seen_format": f"WITH RECURSIVE {BOARD} SELECT user_id, strftime(make_timestamp(last_seen_us), '%Y-%m-%d %H:%M') AS last_seen FROM board",
    "src_requests": "SELECT event_id AS request_id, coalesce(nullif(CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN NULL "
                    "ELSE CAST(user_id AS VARCHAR) END, ''), 'anon_10.0.0.' || (user_id % 7)) AS user_id FROM events",
    "known_users": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events",
    "reputation_snapshot": f"WITH RECURSIVE {BOARD} SELECT user_id, round(trust, 6) AS trust_score, total AS total_requests, "
                           "abuses AS abuse_count, avg_cost AS avg_cost_score FROM states",
    "reputation_reset": f"WITH RECURSIVE {reputation('signup')} SELECT request_id, round(trust_read, 3) AS trust_read, "
                        "total AS total_requests, abuses AS abuse_count FROM rep WHERE rn > 0",
    "inactivity_gap": "SELECT event_id AS request_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) "
                      "/ 3600000000.0::DOUBLE, 4) AS hours FROM events",
})

# -- policy ------------------------------------------------------------------------------------

SCORES = """scores AS (SELECT event_id AS request_id, ((event_id * 7919) % 1001 / 1000.0)::DOUBLE AS trust,
  CAST(event_id % 101 AS INTEGER) AS cost, CAST((event_id * 31) % 101 AS INTEGER) AS risk, value, epoch_us(ts) AS ts_us FROM events)"""
MULTIPLIER = "(CASE WHEN trust >= 0.75 THEN 1.0 WHEN trust >= 0.45 THEN 0.75 ELSE 0.5 END)::DOUBLE"
BUDGET = "CAST(greatest(100, least(floor((CASE WHEN {r} >= 60 THEN 500 WHEN {r} >= 30 THEN 2000 ELSE 5000 END) * (CASE WHEN {t} >= 0.75 THEN 1.0 WHEN {t} >= 0.45 THEN 0.75 ELSE 0.5 END)), 8000)) AS INTEGER)"
ORACLES.update({
    "trust_tier": f"WITH {SCORES} SELECT {TIER.format(t='trust')} AS tier, count(*) AS n FROM scores GROUP BY 1",
    "trust_decay": f"WITH {SCORES} SELECT request_id, CASE WHEN cost > 24 THEN floor(greatest(0.3::DOUBLE, trust - 0.02::DOUBLE * (cost / 24.0::DOUBLE)) * 1000 + 0.5) / 1000 "
                   "ELSE floor(trust * 1000 + 0.5) / 1000 END AS trust FROM scores",
    "risk_tier": f"WITH {SCORES} SELECT CASE WHEN risk >= 60 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM scores GROUP BY 1",
    "trust_multiplier": f"WITH {SCORES} SELECT request_id, {MULTIPLIER} AS multiplier FROM scores",
    "token_budget": f"WITH {SCORES} SELECT request_id, {BUDGET.format(r='risk', t='trust')} AS tokens FROM scores",
    "challenge_required": f"WITH {SCORES} SELECT request_id, trust < 0.4 AND cost > 70 AS required FROM scores",
    "proof_submissions": "WITH p AS (SELECT event_id AS i, event_id % 600 AS age, sha256(event_id || CAST(CAST(round(value, 0) AS INTEGER) AS VARCHAR)) AS digest FROM events), "
                         "r AS (SELECT i, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 5 IN (1, 2) THEN 'invalid submission format' WHEN i % 7 = 0 THEN 'invalid challenge JWT' "
                         "WHEN age > 300 THEN 'challenge too old' WHEN digest NOT LIKE '0%' THEN 'invalid nonce — hash does not start with 0' END AS proof_reason FROM p) "
                         "SELECT i AS request_id, CASE WHEN i % 5 = 0 THEN -1 WHEN proof_reason IS NULL THEN 1 ELSE 0 END AS proof, proof_reason FROM r",
    "proof_audit": "WITH p AS (SELECT event_id AS request_id, event_id % 600 AS age, sha256(event_id || CAST(CAST(round(value, 0) AS INTEGER) AS VARCHAR)) AS digest FROM events) "
                   "SELECT request_id, age <= 300 AND digest LIKE '0%' AS verified, CASE WHEN age > 300 THEN 'challenge too old' "
                   "WHEN digest NOT LIKE '0%' THEN 'invalid nonce — hash does not start with 0' END AS reason FROM p",
})

# -- gate ----------------------------------------------------------------------------------------

def walked_gate(source: str) -> str:
    """CTE ``walk``: the admitted rows of ``source`` per user in order, with exit and trust."""
    return f"""{anchored(source, 'user_id', HOUR, 'q')},
    admitted AS (
      SELECT s.*, q.window_index AS quota_used, row_number() OVER (PARTITION BY s.user_id ORDER BY s.ts_us, s.request_id) AS rn
      FROM {source} s JOIN q USING (request_id) WHERE q.window_index <= 5),
    walk AS (
      SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS request_id, 0.7::DOUBLE AS trust, NULL::BIGINT AS last_seen,
             NULL::DOUBLE AS trust_read, '' AS exit, NULL::DOUBLE AS peeked
      FROM (SELECT DISTINCT user_id FROM admitted)
      UNION ALL
      SELECT user_id, rn, request_id,
             CASE exit WHEN 'risk' THEN greatest(0.0::DOUBLE, trust - 0.2::DOUBLE)
                       WHEN 'amplification' THEN greatest(0.0::DOUBLE, trust - 0.2::DOUBLE)
                       WHEN 'challenge' THEN seen
                       WHEN 'allowed' THEN least(1.0::DOUBLE, seen + 0.05::DOUBLE * (1 - cost_score / 200.0::DOUBLE))
                       ELSE greatest(0.0::DOUBLE, seen - 0.2::DOUBLE) END,
             CASE exit WHEN 'allowed' THEN ts_us ELSE last_seen END,
             CASE WHEN exit NOT IN ('risk', 'amplification') THEN seen END, exit, seen
      FROM (SELECT *, CASE WHEN risk_block THEN 'risk' WHEN recursive_detected THEN 'amplification'
                           WHEN seen < 0.4 AND cost_score > 70 AND proof = -1 THEN 'challenge'
                           WHEN seen < 0.4 AND cost_score > 70 AND proof = 0 THEN 'proof'
                           WHEN defender_risk >= 0.5 THEN 'defender' ELSE 'allowed' END AS exit
            FROM (SELECT s.user_id, s.rn, s.request_id, s.ts_us, s.risk_block, s.recursive_detected, s.cost_score, s.proof,
                         s.defender_risk, p.trust, coalesce(p.last_seen, s.ts_us) AS last_seen,
                         CASE WHEN p.last_seen IS NULL THEN floor(p.trust * 1000 + 0.5) / 1000 ELSE {DECAYED} END AS seen
                  FROM walk p JOIN admitted s ON s.user_id = p.user_id AND s.rn = p.rn + 1)))"""


GATE_INPUT = f"""{SMALL_CONTROL}, raw AS (
  SELECT event_id AS request_id, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS user_id, '10.0.0.' || (user_id % 7) AS client_ip,
         event_type = 'error' AS risk_block, event_type = 'purchase' AND event_id % 3 = 0 AS recursive_detected,
         CAST(event_id % 101 AS INTEGER) AS cost_score, CAST(event_id % 3 - 1 AS INTEGER) AS proof,
         CASE WHEN event_id % 11 = 0 THEN 0.7 ELSE 0.1 END::DOUBLE AS defender_risk FROM events),
{gated('raw')}, open_raw AS (SELECT raw.* FROM raw JOIN gate USING (request_id) WHERE deny_reason IS NULL)"""
ORACLES["request_gate"] = f"""WITH RECURSIVE {GATE_INPUT}, {walked_gate('open_raw')}
SELECT raw.request_id, coalesce(w.exit, 'auth') AS exit,
       CASE WHEN w.exit IS NULL THEN 'blocked' ELSE {TIER.format(t='w.peeked')} END AS auth_tier, CAST(a.quota_used AS INTEGER) AS quota_used,
       round(w.trust_read, 3) AS trust_read, round(w.trust, 6) AS trust_after,
       coalesce(w.exit IN ('risk', 'amplification', 'proof', 'defender') AND w.trust <= 0.05, false) AS candidate
FROM raw LEFT JOIN walk w ON w.request_id = raw.request_id LEFT JOIN admitted a ON a.request_id = raw.request_id"""

REPORT = f"""{RISK}, {DEFENDER}, {SMALL_CONTROL}, {gated('requests')},
inputs AS (
  SELECT r.*, len(r.flags) > 0 AND r.risk_score >= 18 AS risk_block, -1 AS proof, d.defender_risk, d.reason AS defender_reason,
         {HASH} AS h, {PATTERN} AS p
  FROM risk r JOIN def d USING (request_id)),
open_rows AS (SELECT i.* FROM inputs i JOIN gate g USING (request_id) WHERE g.deny_reason IS NULL),
{walked_gate('open_rows')},
exits AS (SELECT i.*, coalesce(w.exit, 'auth') AS exit, w.trust_read FROM inputs i LEFT JOIN walk w USING (request_id)),
seen_rows AS (SELECT * FROM exits WHERE exit NOT IN ('auth', 'risk')), {correlated('seen_rows', DAY)},
report AS (
  SELECT e.request_id, e.ts_us, e.user_id, e.prompt, e.exit, e.rule_flags, e.ext_flags,
         CASE WHEN exit = 'auth' THEN 0 ELSE cost_score END AS cost_score,
         CASE WHEN exit = 'auth' THEN '' ELSE array_to_string(flags, ',') END AS risk_flags,
         CASE WHEN exit = 'auth' THEN [] ELSE flags END AS flag_list,
         CASE WHEN exit = 'auth' THEN 0 ELSE risk_score END AS risk_score,
         coalesce(round(trust_read, 3), 1.0)::DOUBLE AS trust_score,
         CASE WHEN exit IN ('defender', 'allowed') THEN {BUDGET.format(r='risk_score', t='trust_read')} ELSE 5000 END AS tokens_allocated,
         coalesce(c.campaign_detected, false) AS campaign_detected, c.campaign_id,
         exit NOT IN ('auth', 'risk') AND recursive_detected AS recursive_detected,
         exit = 'challenge' AS challenge_triggered,
         CASE WHEN exit IN ('defender', 'allowed') THEN defender_risk ELSE 0 END::DOUBLE AS defender_risk,
         exit IN ('auth', 'risk', 'amplification', 'proof', 'defender') AS blocked,
         CASE exit WHEN 'auth' THEN 'blacklisted or quota exceeded'
                   WHEN 'risk' THEN 'rule-based detection: ' || array_to_string(flags, ', ')
                   WHEN 'amplification' THEN 'recursive amplification detected (multiplier: ' || printf('%.1f', round(multiplier, 2)) || 'x)'
                   WHEN 'proof' THEN 'proof-of-compute failed'
                   WHEN 'defender' THEN 'Twin AI Defender blocked: ' || defender_reason END AS block_reason,
         CASE WHEN exit = 'challenge' THEN 'challenged' WHEN exit = 'allowed' THEN 'allowed' ELSE 'blocked' END AS status,
         CASE WHEN exit = 'auth' THEN 'pending' ELSE {BAND} END AS entropy_band,
         CASE WHEN exit = 'auth' THEN 'pending' ELSE {RISK_BAND} END AS risk_band,
         CASE WHEN trust_read IS NULL THEN 'pending' ELSE {TIER.format(t='trust_read')} END AS reputation_band,
         CASE WHEN exit IN ('defender', 'allowed') THEN {DEFENDER_BAND} ELSE 'pending' END AS defender_band
  FROM exits e LEFT JOIN corr c USING (request_id))"""
COUNTERS = """counters AS (SELECT count(*) AS total_requests, count(*) FILTER (exit = 'allowed') AS successful_requests,
  count(*) FILTER (blocked) AS blocked_requests, count(*) FILTER (exit IN ('risk', 'amplification', 'defender')) AS attacks_detected FROM report)"""
RATE = "round(100.0::DOUBLE * blocked_requests / total_requests, 1)"
CUBE_COLUMNS = "exit <> 'auth'"
REPORT_COLUMNS = (
    "request_id, user_id, cost_score, risk_flags, risk_score, trust_score, tokens_allocated, campaign_detected, campaign_id, "
    "recursive_detected, challenge_triggered, defender_risk, blocked, block_reason, status, entropy_band, risk_band, "
    "reputation_band, defender_band"
)
TITLES = [
    "Auth & Input Validation", "Entropy Engine", "Risk Analysis Engine", "Correlation Engine",
    "Amplification Detector", "Reputation Engine", "Challenge Generator", "Proof of Compute",
    "Token Budget Allocator", "Twin AI Defender", "LLM Adapter", "Monitoring & Logging",
]
_why = "coalesce(block_reason, 'blocked')"
LAYER_ROWS = [
    (f"CASE WHEN exit = 'auth' THEN 'blocked' ELSE 'complete' END", f"CASE WHEN exit = 'auth' THEN {_why} ELSE 'client accepted' END"),
    ("CASE WHEN cost_score > 40 THEN 'warn' ELSE 'complete' END", "'cost ' || cost_score || ' · ' || entropy_band"),
    ("CASE WHEN exit = 'risk' THEN 'blocked' WHEN risk_score >= 18 THEN 'warn' ELSE 'complete' END",
     "CASE WHEN exit = 'risk' THEN array_to_string(flag_list, ', ') ELSE 'risk ' || risk_score || ' · ' || risk_band END"),
    ("CASE WHEN campaign_detected THEN 'warn' ELSE 'complete' END", "'campaign ' || coalesce(campaign_id, 'none')"),
    ("CASE WHEN blocked AND recursive_detected THEN 'blocked' WHEN recursive_detected THEN 'warn' ELSE 'complete' END",
     f"CASE WHEN blocked AND recursive_detected THEN {_why} WHEN recursive_detected THEN 'recursive detected' ELSE 'no recursion' END"),
    ("CASE WHEN trust_score < 0.4 THEN 'warn' ELSE 'complete' END", "'trust ' || printf('%.3f', trust_score) || ' · ' || reputation_band"),
    ("CASE WHEN challenge_triggered THEN 'warn' ELSE 'complete' END", "CASE WHEN challenge_triggered THEN 'challenge issued' ELSE 'challenge not required' END"),
    ("CASE WHEN exit = 'proof' THEN 'blocked' ELSE 'complete' END", f"CASE WHEN exit = 'proof' THEN {_why} ELSE 'verification bypassed or passed' END"),
    ("'complete'", "tokens_allocated || ' tokens allocated'"),
    ("CASE WHEN exit = 'defender' THEN 'blocked' WHEN defender_risk > 0.4 THEN 'warn' ELSE 'complete' END",
     f"CASE WHEN exit = 'defender' THEN {_why} ELSE 'defender risk ' || printf('%.3f', defender_risk) || ' · ' || defender_band END"),
    ("CASE WHEN status = 'allowed' THEN 'complete' ELSE 'pending' END", "CASE WHEN status = 'allowed' THEN 'target model called' ELSE 'not sent to target model' END"),
    ("'complete'", "'trace ' || request_id"),
]
LAYERS = "layers AS (" + " UNION ALL ".join(
    f"SELECT request_id, {i} AS layer, {lit(t)} AS title, {s} AS state, {d} AS detail FROM report"
    for i, (t, (s, d)) in enumerate(zip(TITLES, LAYER_ROWS), start=1)
) + ")"


def from_report(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join([REPORT, *ctes])} {body}"


# The same on all evidence: vectors by place, a cost model of given weights, proofs by id.
_STEEP = "(-1.5 + 0.06 * encoding_score + 0.05 * least(expansion_factor * 2, 100) + 0.05 * obfuscation_score + 0.03 * entropy_score)"
_EVIDENT = f"""{REQUESTS}, {SIMS}, {VERDICTS}, {EXT}, {signals('bank', 'k')},
placed AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS many FROM pr),
semantic AS (SELECT place, many, list(category) FILTER (s >= 0.30) AS found, round(max(s), 4) AS top FROM placed JOIN best USING (vec_id) GROUP BY place, many),
risk AS (
  SELECT r.request_id, r.ts_us, r.user_id, r.client_ip, r.prompt, f.multiplier,
         CAST(round_even(1 / (1 + exp(-{_STEEP}::DOUBLE)) * 100, 0) AS INTEGER) AS cost_score,
         (f.a_rec OR f.a_rep OR f.multiplier > 5) AS recursive_detected, f.rule_flags, e.ext_flags, coalesce(m.found, []) AS sem_flags,
         list_sort(list_distinct(list_concat(list_concat(f.rule_flags, e.ext_flags), coalesce(m.found, [])))) AS flags,
         greatest({RULE_SCORE}, e.ext_score, CASE WHEN len(m.found) > 0 THEN CAST(round_even(top * 100, 0) AS INTEGER) ELSE 0 END) AS risk_score
  FROM requests r JOIN flagged f ON f.k = r.request_id % 28 JOIN ext e USING (request_id)
  JOIN semantic m ON m.place = r.request_id % m.many)"""
EVIDENCE = REPORT.replace(RISK, _EVIDENT).replace("-1 AS proof", "CAST(r.request_id % 3 - 1 AS INTEGER) AS proof").replace(
    "e.rule_flags, e.ext_flags,", "e.rule_flags, e.sem_flags, e.ext_flags,")

ORACLES.update({
    "protection_report_evidence": f"WITH RECURSIVE {EVIDENCE} SELECT {REPORT_COLUMNS} FROM report",
    "detector_comparison_evidence": f"WITH RECURSIVE {EVIDENCE} SELECT rule_hit, semantic_hit, ext_hit, count(*) AS n FROM (SELECT len(rule_flags) > 0 AS rule_hit, "
                                    "len(sem_flags) > 0 AS semantic_hit, len(ext_flags) > 0 AS ext_hit FROM report WHERE exit <> 'auth') GROUP BY CUBE (rule_hit, semantic_hit, ext_hit)",
    "protection_report": from_report(f"SELECT {REPORT_COLUMNS} FROM report"),
    "protection_report_repeated_ids": from_report(
        "SELECT request_id % 1000 AS request_id, user_id, cost_score, risk_score, exit, blocked, status FROM report"
    ),
    "block_reason": from_report("SELECT exit, block_reason, count(*) AS n FROM report GROUP BY 1, 2"),
    "metrics_counters": from_report("SELECT * FROM counters", COUNTERS),
    "block_rate": from_report(f"SELECT {RATE} AS block_rate FROM counters", COUNTERS),
    "threat_level_band": from_report(
        f"SELECT b AS block_rate, CASE WHEN b < 30 THEN 'green' WHEN b < 60 THEN 'orange' ELSE 'red' END AS band, "
        f"round(b - 20, 1) AS delta, b >= 80 AS alarm FROM (SELECT {RATE} AS b FROM counters)", COUNTERS),
    "metrics_long": from_report(
        "SELECT 'Total' AS category, total_requests AS count FROM counters UNION ALL SELECT 'Successful', successful_requests FROM counters "
        "UNION ALL SELECT 'Blocked', blocked_requests FROM counters UNION ALL SELECT 'Attacks', attacks_detected FROM counters", COUNTERS),
    "history_kpis": from_report(
        "SELECT count(*) FILTER (blocked) AS blocked, count(*) - count(*) FILTER (blocked) AS allowed, "
        "count(*) FILTER (challenge_triggered OR defender_risk > 0.4) AS escalations FROM report"),
    "detector_comparison": from_report(
        "SELECT rule_hit, semantic_hit, ext_hit, count(*) AS n FROM (SELECT len(rule_flags) > 0 AS rule_hit, false AS semantic_hit, "
        "len(ext_flags) > 0 AS ext_hit FROM report WHERE exit <> 'auth') GROUP BY CUBE (rule_hit, semantic_hit, ext_hit)"),
    "flag_counts": from_report(
        "SELECT flag, source, count(*) AS n FROM (SELECT unnest(rule_flags) AS flag, 'rule' AS source FROM report WHERE exit <> 'auth' "
        "UNION ALL SELECT unnest(ext_flags), 'ext' FROM report WHERE exit <> 'auth') GROUP BY 1, 2"),
    "layer_state": from_report("SELECT layer, title, state, count(*) AS n FROM layers GROUP BY 1, 2, 3", LAYERS),
    "layer_detail": from_report("SELECT request_id, layer, detail FROM layers", LAYERS),
    "status_label": from_report(
        "SELECT request_id, CASE WHEN blocked THEN 'BLOCK' ELSE 'ALLOW' END AS label, substr(prompt, 1, 120) AS prompt, risk_score FROM report"),
    "request_label": from_report(
        "SELECT request_id, CASE WHEN blocked THEN '\U0001f534 BLOCKED' ELSE '\U0001f7e2 ALLOWED' END || ' | User: ' || user_id || ' | Risk: ' || risk_score "
        "|| ' | Trust: ' || trust_score || ' | Cost: ' || cost_score AS label FROM report"),
    "history_topk": from_report("SELECT request_id, ts_us, user_id, status FROM report ORDER BY ts_us DESC, request_id DESC LIMIT 50"),
    "flatten_history": from_report("SELECT request_id, user_id, substr(prompt, 1, 200) AS prompt FROM report"),
    "sink_request_log": from_report(
        "SELECT CAST(make_timestamp(ts_us) AS DATE) AS date, count(*) AS n, count(*) FILTER (blocked) AS blocked FROM report GROUP BY 1"),
    "blocked_filter": from_report(
        "SELECT request_id, user_id, block_reason FROM (SELECT * FROM report ORDER BY ts_us DESC, request_id DESC LIMIT 20) "
        "WHERE blocked ORDER BY ts_us DESC, request_id DESC LIMIT 10"),
})

# -- the cost model --------------------------------------------------------------------------------

LABELLED = f"""{BANK}, labelled AS (
  SELECT 'd' || doc_id AS row_id, text AS prompt, toxic AS label FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'r' || event_id, prompt, CAST(event_id % 28 BETWEEN 8 AND 26 AS INTEGER) FROM events JOIN bank ON k = event_id % 28)"""
ORACLES.update({
    "label_counts": f"WITH {LABELLED} SELECT count(*) AS total, count(*) FILTER (label = 1) AS risky, count(*) FILTER (label = 0) AS benign FROM labelled",
    "stratified_split": f"WITH {LABELLED} SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) "
                        "<= floor(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split FROM labelled",
    "classification_metrics": f"""WITH {LABELLED}, {signals('labelled', 'row_id, label')},
      t AS (SELECT label, CASE WHEN cost_score > 5 THEN 1 ELSE 0 END AS pred FROM flagged),
      c AS (SELECT l AS label, count(*) FILTER (label = l AND pred = l)::DOUBLE AS tp, count(*) FILTER (pred = l) AS np, count(*) FILTER (label = l) AS support,
                   count(*) FILTER (label = pred) / count(*)::DOUBLE AS accuracy FROM t, (VALUES (0), (1)) AS x(l) GROUP BY l),
      m AS (SELECT *, tp / np AS precision, tp / support AS recall FROM c)
      SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1,
             round(accuracy, 6) AS accuracy, support FROM m""",
})

# The fit again, by accelerated gradient steps over the distinct rows of the training part.
_X = ["encoding_score", "least(expansion_factor * 2, 100)", "obfuscation_score", "entropy_score"]
_J = range(1, 5)
_MARGIN = "y0 + " + " + ".join(f"y{j} * z{j}" for j in _J)
FITTED = f"""{LABELLED}, {signals('labelled', 'row_id, label')},
  parted AS MATERIALIZED (SELECT row_id, label, {', '.join(f'({x})::DOUBLE AS x{j}' for j, x in zip(_J, _X))},
    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) <= floor(0.8 * count(*) OVER (PARTITION BY label)) AS taught FROM flagged),
  moments AS MATERIALIZED (SELECT {', '.join(f'avg(x{j}) AS m{j}, CASE WHEN stddev_pop(x{j}) > 0 THEN stddev_pop(x{j}) ELSE 1 END AS s{j}' for j in _J)} FROM parted WHERE taught),
  z AS MATERIALIZED (SELECT row_id, label, taught, {', '.join(f'(x{j} - m{j}) / s{j} AS z{j}' for j in _J)} FROM parted, moments),
  v AS MATERIALIZED (SELECT label, {', '.join(f'z{j}' for j in _J)}, count(*)::DOUBLE AS n FROM z WHERE taught GROUP BY ALL),
  pace AS MATERIALIZED (SELECT 1.25 * sum(n) + 1 AS l, (1 - sqrt(1 / (1.25 * sum(n) + 1))) / (1 + sqrt(1 / (1.25 * sum(n) + 1))) AS m FROM v),
  steps AS (
    SELECT 0 AS k, {', '.join(f'0.0::DOUBLE AS b{j}, 0.0::DOUBLE AS y{j}' for j in range(5))}
    UNION ALL
    SELECT k + 1, {', '.join(f't{j}, t{j} + m * (t{j} - b{j})' for j in range(5))} FROM (
      SELECT k, any_value(m) AS m, {', '.join(f'any_value(b{j}) AS b{j}' for j in range(5))},
        any_value(y0) - sum(n * (1 / (1 + exp(-({_MARGIN}))) - label)) / any_value(l) AS t0,
        {', '.join(f'any_value(y{j}) - (sum(n * (1 / (1 + exp(-({_MARGIN}))) - label) * z{j}) + any_value(y{j})) / any_value(l) AS t{j}' for j in _J)}
      FROM steps, v, pace WHERE k < 6000 GROUP BY k)),
  fit AS MATERIALIZED (SELECT * FROM steps WHERE k = 6000),
  rated AS (SELECT row_id, label, taught, 1 / (1 + exp(-(b0 + {' + '.join(f'b{j} * z{j}' for j in _J)}))) AS risky FROM z, fit)"""
ORACLES.update({
    "feature_weights": f"WITH RECURSIVE {FITTED} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS feature, round(b{j}, 4) AS weight FROM fit" for j, n in zip(_J, ["encoding_score", "expansion_factor(normalized)", "obfuscation_score", "entropy_score"])),
    "cost_score_ml": f"WITH RECURSIVE {FITTED} SELECT row_id, label, CAST(round_even(risky * 100, 0) AS INTEGER) AS cost_score, 'ml_classifier' AS scoring_method FROM rated",
    "train_cost_model": f"""WITH RECURSIVE {FITTED},
      t AS (SELECT label, (risky > 0.5)::INTEGER AS pred FROM rated WHERE NOT taught),
      c AS (SELECT l AS label, count(*) FILTER (label = l AND pred = l)::DOUBLE AS tp, count(*) FILTER (pred = l) AS np, count(*) FILTER (label = l) AS support,
                   count(*) FILTER (label = pred) / count(*)::DOUBLE AS accuracy FROM t, (VALUES (0), (1)) AS x(l) GROUP BY l),
      m AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM c)
      SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
             round(accuracy, 6) AS accuracy, support FROM m""",
})

# -- streams give what the batch gives ----------------------------------------------------------------

ORACLES.update({
    "stream_signals": f"WITH {REQUESTS}, {signals('bank', 'k')} SELECT request_id, cost_score, array_to_string(rule_flags, ',') AS rule_flags, "
                      "(a_rec OR a_rep OR multiplier > 5) AS recursive_detected FROM requests JOIN flagged ON k = request_id % 28",
    "stream_quota": ORACLES["quota_check"],
    "stream_campaigns": ORACLES["correlation_check"],
    "stream_gate": ORACLES["request_gate"],
    "stream_reputation_resumed": f"WITH RECURSIVE {REP} SELECT request_id, round(trust_read, 3) AS trust_read, round(trust, 6) AS trust_score, "
                                 "total AS total_requests, abuses AS abuse_count FROM rep "
                                 "WHERE rn > 0 AND ts_us >= (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM events)",
    "stream_request_log": "SELECT event_id AS request_id, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS user_id FROM events "
                          "ORDER BY ts DESC, event_id DESC LIMIT 200",
    "late_data": """WITH timed AS (
      SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) + (event_id * 7919 % 3000) * 1000000 + CASE WHEN event_id % 97 = 0 THEN 432000000000 ELSE 0 END AS arrival FROM events),
    whole AS (SELECT min(arrival) AS low, max(arrival) AS high, greatest(4, count(*) // 1000000) AS n FROM timed),
    sliced AS (SELECT event_id, t, (arrival - low) * n // (high - low + 1) AS k FROM timed, whole),
    latest AS (SELECT k, max(t) AS t FROM sliced GROUP BY k),
    marks AS (SELECT a.k, (max(b.t) - 3600000000) // 1000 * 1000 AS mark FROM latest a JOIN latest b ON b.k < a.k GROUP BY a.k)
    SELECT event_id AS request_id, mark AS watermark_us, k::INTEGER AS trigger FROM sliced JOIN marks USING (k) WHERE t // 1000 * 1000 <= mark""",
    "stream_reputation": ORACLES["reputation_fold"],
    "stream_correlation": f"WITH {SIGHTINGS}, {window_counts('sight', 'h', DAY, 'byhash')}, {window_counts('sight', 'p', DAY, 'bypattern')} "
                          "SELECT request_id, 'exact' AS track, CAST(senders AS INTEGER) AS senders, CAST(ips AS INTEGER) AS addresses FROM byhash "
                          "UNION ALL SELECT request_id, 'fuzzy', CAST(senders AS INTEGER), CAST(ips AS INTEGER) FROM bypattern",
    "stream_campaign_log": f"WITH RECURSIVE {SIGHTINGS}, {anchored('sight', 'h', DAY, 'w')} SELECT 'CAMP-' || upper(substr(h, 1, 8)) AS campaign_id, "
                           "h AS prompt_hash, window_start AS detected_at FROM w JOIN sight USING (request_id) WHERE window_index = 1",
    "stream_metrics": "SELECT count(*) AS total_requests, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS successful_requests, "
                      "count(*) FILTER (event_type IN ('error', 'signup')) AS blocked_requests, count(*) FILTER (event_type = 'error') AS attacks_detected FROM events",
})
