"""SQL for the queries of this subpackage that it can express, over whole tables of small size."""

from __future__ import annotations

from spanloom.llm.lookalike import HYPHENS, IGNORABLE, SEVERAL, TABLE


def _form(c: str) -> str:
    """The form by the table: shapes, composition, blanks."""
    one = {chr(k): v for k, v in TABLE.items() if v is not None and len(v) == 1 and v != " " and chr(k) not in HYPHENS} | {k: v[0] for k, v in SEVERAL.items()}
    blanks = "".join(chr(k) for k, v in TABLE.items() if v == " ")
    gone = "".join(IGNORABLE)
    text = lambda x: x.replace("'", "''")
    hyphens = "".join(c for c in HYPHENS if TABLE[ord(c)] == "-")
    both = f"'{text(''.join(one) + hyphens + blanks)}', '{text(''.join(one.values()) + '-' * len(hyphens) + ' ' * len(blanks))}'"
    return rf"trim(regexp_replace(nfc_normalize(translate(translate({c}, {both}), '{gone}', '')), ' +', ' ', 'g'))"


WINDOW = """w AS (SELECT doc_id, text, unnest(range(length(text) - 149)) AS p FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 150)),
h AS (SELECT doc_id, p, md5(substr(text, CAST(p AS INT) + 1, 150)) AS h FROM w), sh AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT DISTINCT doc_id, p FROM h WHERE h IN (SELECT h FROM sh)), f AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 150 THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM f),
found AS (SELECT doc_id, CAST(min(p) AS INT) AS span_start, CAST(max(p) + 150 AS INT) AS span_end FROM r GROUP BY doc_id, run)"""

ORACLE = {
    "p1_found": f"""WITH a AS (SELECT DISTINCT record_id, span_id, text, {_form('text')} AS form FROM spans WHERE text IS NOT NULL AND record_id IS NOT NULL), b AS (SELECT DISTINCT record_id, raw_id, raw, {_form('raw')} AS form FROM raw_texts WHERE raw IS NOT NULL AND record_id IS NOT NULL)
      SELECT DISTINCT span_id, raw_id FROM a JOIN b USING (record_id, form) WHERE a.text <> b.raw""",
    "p1_forms": f"SELECT 'spans' AS origin, span_id AS id, text, {_form('text')} AS canonical_text FROM spans UNION ALL SELECT 'raw_texts', raw_id, raw, {_form('raw')} FROM raw_texts",
    "p3_found": f"WITH {WINDOW} SELECT * FROM found",
    "p3_amount": f"""WITH {WINDOW}, a AS (SELECT doc_id, sum(span_end - span_start) AS s FROM found GROUP BY doc_id)
      SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(s, 0) AS shared_chars, round(coalesce(s, 0) / greatest(coalesce(length(text), 0), 1), 6) AS shared_part FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
}
