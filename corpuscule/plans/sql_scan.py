"""The scanners once more, in DuckDB SQL: rules, checks, overlaps, previews and redaction.

DuckDB's regular expressions have no look-around and know ASCII words only. So each rule is matched on a
text of the same length: ``w`` has ``_`` for every letter beyond ASCII, and in ``d`` whatever isn't a
digit but may stand in a word is a dot. There ``\\b`` and ``\\B`` say what look-arounds do elsewhere.
"""

from __future__ import annotations

from ..operators import patterns

_REST = r"(?:[(]?\d{2,4}[)]?[-\s.]?){1,3}\d{2,4}"
_OCTET = r"(?:2(?:5[0-5]|[0-4]\d)|1?\d?\d)"
_STREETS = r"rue|avenue|av\.|boulevard|bd\.|impasse|all_e|chemin|place|route|rte\."

_LUHN = """(length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN substr(n, i, 1)::INT
  ELSE (2 * substr(n, i, 1)::INT) // 10 + (2 * substr(n, i, 1)::INT) % 10 END)) % 10 = 0)"""
_IBAN = """(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(match, 5) || substr(match, 1, 4), ''), lambda c:
  CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1)"""
_NIR = "(length(n) = 13 OR length(n) = 15 AND substr(n, 14)::BIGINT + substr(n, 1, 13)::BIGINT % 97 = 97)"
_RANDOM = r"(list_aggregate(string_split(match, ''), 'entropy') >= 3.5 AND regexp_matches(match, '\d') AND regexp_matches(match, '[A-Za-z]'))"

#: Per rule: the text it is matched on, its expression, and the check of a match (``n`` has the match's digits).
RULES: dict[str, tuple[str, str, str]] = {
    "pii:email": ("t", r"(?i)\b[-+%._0-9A-Z]+@[-.0-9A-Z]+\.[A-Z]{2,}\b", "true"),
    "pii:phone": ("w", rf"(?:\B\+\d{{1,3}}[-\s.]?[(]?\d{{2,4}}[)]?[-\s.]?{_REST}|\b\d{{1,3}}[-\s.]?[(]?\d{{2,4}}[)]?[-\s.]?{_REST}|\B[(]\d{{2,4}}[)]?[-\s.]?{_REST}|\b\d{{2,4}}[)]?[-\s.]?{_REST})\b", "true"),
    "pii:phone_fr": ("w", r"(?:\b0|\B\+33\s?)[1-9](?:[-\s.]?\d{2}){4}\b", "true"),
    "pii:credit_card_candidate": ("w", r"\b(?:\d[- ]*?){13,19}\b", _LUHN),
    "pii:ssn_us_candidate": ("w", r"\b\d{3}-\d{2}-\d{4}\b", "true"),
    "pii:nir_fr": ("d", r"\b[12]\s?\d{2}\s?(?:0[1-9]|1[012]|[234]\d)\s?\d{2,3}\s?\d{3}\s?\d{3}(?:\s?\d\d)?\b", _NIR),
    "pii:siret_fr": ("d", r"\b\d{3}\s?\d{3}\s?\d{3}\s?\d{5}\b", _LUHN),
    "pii:siren_fr": ("d", r"\b\d{3}\s?\d{3}\s?\d{3}\b", "true"),
    "pii:passport_fr": ("w", r"\b\d\d[A-Z]{2}\d{5}\b", "true"),
    "pii:cni_fr_candidate": ("w", r"\b\d{12}\b", "true"),
    "pii:ip_address": ("w", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "true"),
    "pii:ipv6_address": ("w", r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b", "true"),
    "pii:mac_address": ("w", r"\b(?:[A-Fa-f0-9]{2}[-:]){5}[A-Fa-f0-9]{2}\b", "true"),
    "pii:iban_candidate": ("w", r"\b[A-Z]{2}\d\d[0-9A-Z]{11,30}\b", _IBAN),
    "pii:jwt_candidate": ("t", r"\beyJ[-_0-9A-Za-z]{8,}\.[-_0-9A-Za-z]{8,}\.[-_0-9A-Za-z]{8,}\b", "true"),
    "pii:postal_address_fr": ("w", rf"(?i)\b\d{{1,4}}[\s,]+(?:{_STREETS})\s+[A-Z][-'\s\w]{{2,40}}", "true"),
    "secret:private_key": ("t", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "true"),
    "secret:aws_access_key": ("w", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "true"),
    "secret:github_token": ("w", r"\bgh[oprsu]_[0-9A-Za-z]{20,}\b", "true"),
    "secret:slack_token": ("w", r"\bxox[abprs]-[-0-9A-Za-z]{10,}", "true"),
    "secret:api_key": ("t", r"""(?i)\b(?:api[-_ ]?key|token|secret|password)\b\s*[:=]\s*["']?[-_0-9A-Za-z]{16,}""", "true"),
    "secret:high_entropy": ("t", r"[-_0-9A-Za-z]{32,}", _RANDOM),
    "prompt_injection:instruction_override": (
        "t", r"(?i)ignore (?:all )?(?:prior|previous) instructions|disregard (?:the )?(?:developer|system) message|reveal (?:the )?(?:hidden )?prompt|system prompt|"
        r"developer message|tool call|override instructions|exfiltrate|send this data to|do not follow (?:the )?rules", "true",
    ),
}

ORDERED = [*patterns.PII, *patterns.SECRETS, patterns.INJECTION]
_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(source: str) -> str:
    """CTE ``scanned(k, t, w, d)`` of a query that gives ``k, t``."""
    w = r"regexp_replace(t, '[^\P{L}\x00-\x7F]', '_', 'g')"
    return f"scanned AS MATERIALIZED (SELECT k, t, w, regexp_replace(w, '[A-Za-z_]', '.', 'g') AS d FROM (SELECT k, t, {w} AS w FROM ({source})))"


def matches(label: str) -> str:
    """``k, s, e, match`` of one rule over ``scanned``: its places are found by marking all matches and splitting at the marks."""
    on, rx, check = RULES[label]
    marked = f"string_split(regexp_replace({on}, {quoted(f'({rx})')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    return f"""SELECT k, t, s, e, match FROM (
  SELECT k, t, s, e, substr(t, s + 1, e - s) AS match, regexp_replace(substr(t, s + 1, e - s), '[^0-9]', '', 'g') AS n FROM (
    SELECT k, t, s, s + strpos(part, chr(2)) - 1 AS e FROM (
      SELECT k, t, parts[i] AS part, list_sum(list_transform(parts[1:i - 1], lambda p: length(replace(p, chr(2), ''))))::BIGINT AS s
      FROM (SELECT k, t, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT k, t, {marked} AS parts FROM scanned)))))
  WHERE {check}"""


def _apart(order: str) -> str:
    """Per text the matches that overlap none before them in this order."""
    return f"""list_reduce(list(([{{'s': s, 'e': e, 'rule': rule, 'conf': conf, 'match': match}}]) ORDER BY {order}),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN kept || x ELSE kept END)"""


def findings(source: str, families: tuple[str, ...] = ("pii", "secret", "prompt_injection")) -> str:
    """CTEs of a query that gives ``k, t``; the last is ``found(k, i, type, label, severity, s, e, match, conf)``."""
    parts: dict[str, list[str]] = {"pii": [], "secret": [], "prompt_injection": []}
    for n, rule in enumerate(ORDERED):
        sure = f"{rule.confidence}::DOUBLE"
        if rule.nearby:
            around = "lower(substr(t, greatest(0, s - 40) + 1, e + 40 - greatest(0, s - 40)))"
            near = " OR ".join(f"contains({around}, {quoted(word)})" for word in rule.nearby)
            sure = f"CASE WHEN {near} THEN least(0.99::DOUBLE, {sure} + 0.15::DOUBLE) ELSE {sure} END"
        parts[rule.label.split(":")[0]].append(f"SELECT k, s, e, match, {n} AS rule, {_RANK[rule.severity]} AS rank, {sure} AS conf FROM ({matches(rule.label)})")
    best = {"pii": "rank DESC, conf DESC, e - s DESC, rule, s", "secret": "rule, s", "prompt_injection": "rule, s"}
    kept = " UNION ALL ".join(f"SELECT k, {n} AS family, {_apart(best[f])} AS found FROM ({' UNION ALL '.join(parts[f])}) GROUP BY k" for n, f in enumerate(families))
    names = "[" + ", ".join(f"{{'label': {quoted(r.label)}, 'severity': {quoted(r.severity)}}}" for r in ORDERED) + "]"
    return f"""{texts(source)}, chosen AS (SELECT k, family, unnest(found) AS m FROM ({kept})),
  found AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY family, m.s) - 1 AS i, split_part({names}[m.rule + 1].label, ':', 1) AS type,
    {names}[m.rule + 1].label AS label, {names}[m.rule + 1].severity AS severity, m.s AS s, m.e AS e, m.match AS match, m.conf AS conf FROM chosen)"""


#: The preview of a finding joined with its text.
PREVIEW = r"""trim(substr(t, greatest(0, s - 24) + 1, s - greatest(0, s - 24))
  || CASE WHEN type = 'secret' AND length(match) > 8 THEN substr(match, 1, 4) || '…' || substr(match, length(match) - 3) ELSE match END || substr(t, e + 1, 24), ' ' || chr(9) || chr(10) || chr(13))"""


def redacted(types: str = "('pii', 'secret')") -> str:
    """CTE ``clean(k, t)`` after ``found``: placeholders put in from the last match to the first, none into one put in before."""
    begin = "{'t': t, 'last': 2147483647::BIGINT, 's': 0::BIGINT, 'e': 0::BIGINT, 'label': ''}"
    step = """lambda a, m: CASE WHEN m.e <= a.last THEN {'t': substr(a.t, 1, m.s) || '[REDACTED:' || m.label || ']' || substr(a.t, m.e + 1), 'last': m.s, 's': m.s, 'e': m.e, 'label': m.label} ELSE a END"""
    return f"""spans AS (SELECT k, list({{'t': '', 'last': 0::BIGINT, 's': s::BIGINT, 'e': e::BIGINT, 'label': label}} ORDER BY s DESC, e - s, label) AS l FROM found WHERE type IN {types} GROUP BY k),
  clean AS (SELECT k, CASE WHEN l IS NULL THEN t ELSE list_reduce(list_prepend({begin}, l), {step}).t END AS t FROM scanned LEFT JOIN spans USING (k))"""
