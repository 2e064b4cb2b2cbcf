"""SQL that states the same results as the queries, where SQL can."""

from __future__ import annotations

import string

from pagetide.llm.license_scan import COPYRIGHT_LINE, KNOWN, SPELLINGS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    spelled = "' ' || p || ' '"
    for variant, word in SPELLINGS:
        spelled = f"replace({spelled}, ' {variant} ', ' {word} ')"
    low = f"translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    plain = f"CASE WHEN regexp_matches({low}, {_text(COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace({low}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')) END"
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {plain}), lambda x: x <> '')"
    return f"""
WITH given(license_id, text) AS (VALUES {", ".join(f"({_text(a)}, {_text(b)})" for a, b in KNOWN)}),
known AS (
  SELECT sha256(trim({spelled})) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, array_to_string({lines}, ' ') AS p FROM given) GROUP BY 1),
read AS (SELECT doc_id, {lines} AS l FROM documents),
whole AS (SELECT doc_id, CASE WHEN p <> '' THEN sha256(trim({spelled})) END AS digest FROM (SELECT doc_id, array_to_string(l, ' ') AS p FROM read)),
notices AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices
  FROM (SELECT doc_id, sha256(trim({spelled})) AS digest FROM (SELECT doc_id, unnest(l) AS p FROM read)) JOIN known USING (digest) GROUP BY 1)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)"""


def shingled(relation: str, key: str, lower: str = "lower(text)") -> str:
    """Distinct five-word shingles by row: key, s."""
    return f"""
SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
FROM (SELECT {key}, list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {relation}) WHERE len(w) > 0"""


DECONTAMINATION = f"""
WITH d AS ({shingled("documents", "doc_id")}), b AS ({shingled("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found * 100 >= n_shingles * 75"""
