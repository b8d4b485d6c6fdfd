"""Shared pieces of the DuckDB check queries."""

from __future__ import annotations

from dqspark.functions import text as tx
from dqspark.operators import contract as ct
from dqspark.operators.contract import COMPANY
from dqspark.plans.companies import FEED_SQL

FEED = FEED_SQL.format(customer="customer", nation="nation", documents="documents", pages="pages")
BUSINESS = ", ".join(COMPANY.names)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_of(col: str, char_class: str) -> str:
    return f"(length({col}) - length(regexp_replace({col}, {quote(char_class + '+')}, '', 'g')))"


def matches(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {quote(pattern)})"


def strip(col: str) -> str:
    return f"regexp_replace({col}, {quote(f'^[{tx.SPACE}]+|[{tx.SPACE}]+{chr(92)}z')}, '', 'g')"


def collapse(col: str) -> str:
    return f"trim(regexp_replace({col}, {quote(f'[{tx.SPACE}]+')}, ' ', 'g'), ' ')"


def normalize(col: str) -> str:
    return f"nullif({collapse(col)}, '')"


def draw(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


CTES = {
    "fx": FEED,
    "chk": f"""
SELECT fx.*,
  CASE WHEN company_id IS NULL THEN {quote(ct.INT_TYPE)}
       WHEN NOT regexp_matches(company_id, '^[ ]*[+-]?[0-9]+(_[0-9]+)*([.]0+)?[ ]*$') THEN {quote(ct.INT_PARSE)}
  END AS e_id,
  CASE WHEN CAST(company_size AS BIGINT) < 1 THEN {quote(ct.AT_LEAST.format(1))}
       WHEN CAST(company_size AS BIGINT) > 7 THEN {quote(ct.AT_MOST.format(7))} END AS e_size,
  CASE WHEN url IS NULL THEN 'URL input should be a string or URL'
       WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')
       THEN 'Input should be a valid URL, relative URL without a base'
       WHEN NOT regexp_matches(url, '^[hH][tT][tT][pP][sS]?:') THEN 'URL scheme should be ''http'' or ''https'''
  END AS e_url
FROM fx""",
    "rec": """
SELECT _seq, CAST(company_id AS BIGINT) AS company_id, name, description,
  CAST(company_size AS BIGINT) AS company_size,
  CASE WHEN trim(state) = '0' THEN NULL ELSE state END AS state,
  CASE WHEN trim(country) = '0' THEN NULL ELSE country END AS country,
  city, zip_code, address, url
FROM chk WHERE e_id IS NULL AND e_size IS NULL AND e_url IS NULL""",
    "ded": f"SELECT min(_seq) AS _seq, {BUSINESS} FROM rec GROUP BY {BUSINESS}",
    "cln": "SELECT _seq, company_id, company_size, url, "
    + ", ".join(f"{normalize(c)} AS {c}" for c in COMPANY.text_columns)
    + " FROM ded",
    "us": """
SELECT *, upper(trim(state)) AS state_clean, substr(zip_code, 1, 3) AS zip3 FROM cln
WHERE country = 'US' AND state IS NOT NULL AND zip_code IS NOT NULL
  AND upper(trim(state)) IN ({states}) AND regexp_matches(substr(zip_code, 1, 3), '^[0-9]{{3}}$')""",
    "ref": """
SELECT zip3, arg_min(state_clean, (-n, state_clean)) AS state, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT zip3, state_clean, count(*) AS n FROM us GROUP BY ALL) GROUP BY zip3 HAVING sum(n) >= 2""",
    "recs": """
SELECT _seq AS id, 'company_id' AS rule, e_id AS message, CAST(NULL AS DOUBLE) AS score, name, company_id FROM chk WHERE e_id IS NOT NULL
UNION ALL SELECT _seq, 'company_size', e_size, NULL, name, company_id FROM chk WHERE e_size IS NOT NULL
UNION ALL SELECT _seq, 'url', e_url, NULL, name, company_id FROM chk WHERE e_url IS NOT NULL
UNION ALL SELECT _seq, 'quarantine_classifier', 'score', (_seq * 37 % 101) / 100.0, name, CAST(company_id AS VARCHAR)
FROM rec WHERE _seq * 37 % 101 >= 90""",
    "revs": """
SELECT DISTINCT id AS record_id, CASE WHEN id % 6 = 0 THEN 'confirmed_bad' ELSE 'false_positive' END AS decision
FROM recs WHERE id % 3 = 0""",
}


def sql(body: str, upto: str | None = "cln", **more: str) -> str:
    """``body`` behind the common tables it may use (``upto`` and all before it) and its own."""
    from dqspark.operators.zip3 import US_STATES

    names = list(CTES)
    chosen = names[: names.index(upto) + 1] if upto else []
    parts = []
    for name in chosen:
        text = CTES[name]
        if name == "us":
            text = text.format(states=", ".join(quote(s) for s in US_STATES))
        parts.append(f"{name} AS ({text})")
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
