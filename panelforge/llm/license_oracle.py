"""SQL twin of the licence scan: the same canonical form, digests and joins."""

from panelforge.llm.license_lookup import COPYRIGHT_LINE, SPELLINGS
from panelforge.llm.license_texts import KNOWN_TEXTS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = rf"regexp_replace(lower(coalesce({column}, '')), {_text(COPYRIGHT_LINE)}, '\1', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        out = rf"regexp_replace({out}, '\b{old}\b', '{new}', 'g')"
    return out


_ONE = r"sha256(trim(regexp_replace({}, '[ \n]+', ' ', 'g')))"
LICENSE_SQL = f"""
WITH texts(license, text) AS (VALUES {", ".join(f"({_text(k)}, {_text(v)})" for k, v in sorted(KNOWN_TEXTS.items()))}),
known AS (SELECT digest, min(license) AS license FROM (SELECT license, {_ONE.format(_canonical("text"))} AS digest FROM texts) GROUP BY digest),
rows AS (SELECT doc_id, {_canonical("text")} AS lines FROM documents),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, '; ' ORDER BY license) AS names
  FROM (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM rows) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, license, coalesce(names, '') AS line_licenses
FROM (SELECT doc_id, {_ONE.format("lines")} AS digest FROM rows) LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""
