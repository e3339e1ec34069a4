"""SQL that says the same as the queries, over the same tables, for an independent engine."""

from __future__ import annotations

S = """s AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY ingested_at DESC) AS n FROM spans) WHERE n = 1)"""
BC = f"""{S}, b AS (SELECT * FROM s WHERE source IN ('rule', 'lex_core')), c AS (SELECT * FROM s WHERE source IN ('tok_alpha', 'llm_wide'))"""
KEYS = """bk AS (SELECT DISTINCT record_id, start, "end", type FROM b WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL),
ck AS (SELECT DISTINCT record_id, start, "end", type FROM c WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL)"""
LINES = """cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, CAST(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(piece) - 1 AS off FROM cut),
l AS (SELECT doc_id, CAST(line AS INT) AS line, regexp_replace(piece, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g') AS body,
      CAST(off + length(piece) - length(regexp_replace(piece, '^[ \\t\\r\\f]+', '')) AS INT) AS start FROM placed)"""
LINES += """, li AS (SELECT *, CAST(start + length(body) AS INT) AS "end" FROM l WHERE body <> '')"""
GROUPS = """g AS (SELECT sha256(body) AS passage, length(body) AS length, count(DISTINCT doc_id) AS records, count(*) AS occurrences FROM li WHERE length(body) >= 40 GROUP BY body HAVING count(DISTINCT doc_id) >= 2)"""
OCC = """o AS (SELECT sha256(body) AS passage, doc_id, start, "end" FROM li WHERE length(body) >= 40 AND sha256(body) IN (SELECT passage FROM g))"""
HEADS = """h AS (SELECT doc_id, start AS off, upper(regexp_replace(body, ':$', '')) AS heading FROM li WHERE len(regexp_split_to_array(body, ' +')) <= 6
      AND ((upper(body) = body AND lower(body) <> body AND NOT regexp_matches(body, '[0-9]')) OR regexp_matches(body, '^[^:]*:$')))"""
SRC = "lower(regexp_replace(trim(source), '[ \\-]+', '_', 'g'))"
P = f"""p AS (SELECT record_id, start, "end", type, text, {SRC} AS source, max(confidence) AS confidence FROM proposals
      WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL GROUP BY ALL)"""
K = 'record_id, start, "end", type, text'
FULL = 'record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL AND text IS NOT NULL'
EVID = f"""base AS (SELECT DISTINCT {K} FROM b WHERE {FULL}),
e AS (SELECT {K}, string_agg(source, '+' ORDER BY source) AS sources, count(*) AS source_count, round(avg(confidence) + 1e-9, 6) AS mean_confidence, max(confidence) AS max_confidence FROM p GROUP BY {K}),
ev AS (SELECT e.*, base.record_id IS NOT NULL AS baseline_exact FROM e LEFT JOIN base USING ({K}))"""


def _family(c: str) -> str:
    return f"CASE WHEN contains({c}, 'tok_') THEN 'token' WHEN contains({c}, 'llm_') THEN 'llm' WHEN contains({c}, 'nurse_') THEN 'human' WHEN contains({c}, 'rule') THEN 'rules' WHEN contains({c}, 'lex') THEN 'rules' ELSE {c} END"


def _hash(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"CAST(('0x' || substr(sha256({joined}), 1, 8)) AS BIGINT)"


PHRASE = "lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))"
WORDS = "len(list_filter(regexp_split_to_array(coalesce({}, ''), '[ \\t\\r\\n\\f]+'), lambda x: x <> ''))"
PASSAGE_ENTITIES = f"""ent AS (SELECT DISTINCT o.passage, o.doc_id AS record_id, s.start - o.start AS start, s."end" - o.start AS "end", s.type, {_family(SRC.replace("source", "s.source"))} AS family
      FROM o JOIN s ON s.record_id = o.doc_id AND s.start >= o.start AND s."end" <= o."end" AND s.start < s."end" AND s.type IS NOT NULL AND s.source IS NOT NULL),
units AS (SELECT passage, start, "end", type, count(DISTINCT record_id) AS records, count(DISTINCT family) AS families, count(DISTINCT (record_id, family)) AS units FROM ent GROUP BY ALL)"""
MEETS = "x.record_id = y.record_id AND x.start < y.\"end\" AND y.start < x.\"end\""
SCORED = """scored AS (SELECT type, round(list_avg(list_filter(map_values(confidences), lambda x: x IS NOT NULL)), 6) AS score, positive FROM pu_rows)"""
GRID_SQL = """grid AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
n AS (SELECT score, positive FROM scored WHERE score IS NOT NULL AND positive IS NOT NULL),
t AS (SELECT threshold, count(score) FILTER (score >= threshold) AS taken, count(score) FILTER (score >= threshold AND positive) AS "right", count(score) FILTER (positive) AS positives FROM grid CROSS JOIN n GROUP BY threshold),
tg AS (SELECT threshold, taken, "right", round(CASE WHEN taken > 0 THEN "right" / taken ELSE 0 END, 6) AS precision, round(CASE WHEN positives > 0 THEN "right" / positives ELSE 0 END, 6) AS recall,
      round(CASE WHEN taken + positives > 0 THEN 2 * "right" / (taken + positives) ELSE 0 END, 6) AS f1 FROM t)"""
DELTA = """ma AS (SELECT record_id, round(avg(confidence), 9) AS a, count(*) AS n_a FROM b WHERE record_id IS NOT NULL AND confidence IS NOT NULL GROUP BY record_id),
mb AS (SELECT record_id, round(avg(confidence), 9) AS m FROM c WHERE record_id IS NOT NULL AND confidence IS NOT NULL GROUP BY record_id),
dl AS (SELECT record_id, CASE WHEN n_a >= 5 THEN 'high' WHEN n_a >= 3 THEN 'middle' ELSE 'low' END AS stratum, round(m - a, 9) AS delta FROM ma JOIN mb USING (record_id))"""


def _poisson() -> str:
    import math

    cuts, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    u = f"{_hash(chr(39) + 'paired' + chr(39), 'CAST(r AS VARCHAR)', 'CAST(record_id AS VARCHAR)')} / 4294967296.0::DOUBLE"
    return f"""ro AS (SELECT delta, r, {u} AS u FROM dl CROSS JOIN range(200) AS q(r)),
ti AS (SELECT r, delta, {" + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in cuts)} AS times FROM ro),
me AS (SELECT r, sum(times * delta) / sum(times) AS mean FROM ti GROUP BY r)"""


TOP = """em AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
top AS (SELECT q.id AS query_id, b.id AS base_id, round(list_cosine_similarity(q.v, b.v), 6) AS score FROM em q JOIN em b ON q.id % 50 = 0 {pool}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM top QUALIFY rank <= {k})"""
RECALL = TOP.format(pool="", k=10) + """, rt AS (SELECT query_id, list(l.label ORDER BY rank) AS top, any_value(q.label) AS label FROM ranked JOIN em l ON l.id = base_id JOIN em q ON q.id = query_id GROUP BY query_id)"""
EDGES = """ed AS (SELECT DISTINCT a.identifier AS source, b.identifier AS target, 'child_of' AS relation FROM nodes a JOIN nodes b ON b.identifier = substr(a.identifier, 1, 3) AND a.ontology = b.ontology WHERE length(a.identifier) > 3)"""
NEAR = """nb AS (SELECT source AS a, target AS b FROM ed UNION SELECT target, source FROM ed)"""
EMPTY = "CAST([] AS VARCHAR[])"
VIOLATIONS = f"""vi AS (SELECT span_id, list_filter([
      CASE WHEN s.text IS NULL THEN 'no_text' END,
      CASE WHEN s.type IS NULL OR s.type NOT IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC', 'TÊN_XÉT_NGHIỆM', 'KẾT_QUẢ_XÉT_NGHIỆM', 'THÔNG_TIN_BỆNH_NHÂN') THEN 'unknown_type' END,
      CASE WHEN s.start IS NULL OR s."end" IS NULL THEN 'no_position' END,
      CASE WHEN d.text IS NULL THEN 'no_record' END,
      CASE WHEN NOT (s.start >= 0 AND s.start < s."end" AND s."end" <= length(d.text)) THEN 'out_of_bounds' END,
      CASE WHEN s.start >= 0 AND s.start < s."end" AND s."end" <= length(d.text) AND substr(d.text, s.start + 1, s."end" - s.start) <> s.text THEN 'other_text' END,
      CASE WHEN len(list_filter(coalesce(s.assertions, {EMPTY}), lambda x: x IS NULL OR x NOT IN ('isNegated', 'isHistorical', 'isFamily'))) > 0 THEN 'unknown_assertion' END,
      CASE WHEN s.type NOT IN ('CHẨN_ĐOÁN', 'THUỐC') AND len(s.candidates) > 0 THEN 'codes_on_uncoded' END], lambda x: x IS NOT NULL) AS v
      FROM s LEFT JOIN documents d ON d.doc_id = s.record_id)"""
PRF = """j AS (SELECT coalesce(bk.type, ck.type) AS type, bk.record_id IS NOT NULL AND ck.record_id IS NOT NULL AS hit, bk.record_id IS NOT NULL AS g, ck.record_id IS NOT NULL AS f FROM bf bk FULL JOIN cf ck USING (record_id, start, "end", type))"""
PRF_KEYS = """bf AS (SELECT DISTINCT record_id, start, "end", type FROM b WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL),
cf AS (SELECT DISTINCT record_id, start, "end", type FROM c WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL)"""
PRF_OUT = """count(*) FILTER (hit) AS tp, count(*) FILTER (f) AS n_found, count(*) FILTER (g) AS n_gold,
      round(CASE WHEN count(*) FILTER (f) > 0 THEN count(*) FILTER (hit) / count(*) FILTER (f) ELSE 0 END, 6) AS precision,
      round(CASE WHEN count(*) FILTER (g) > 0 THEN count(*) FILTER (hit) / count(*) FILTER (g) ELSE 0 END, 6) AS recall,
      round(CASE WHEN count(*) > 0 THEN 2 * count(*) FILTER (hit) / (count(*) FILTER (f) + count(*) FILTER (g)) ELSE 0 END, 6) AS f1"""
SORTED = f"list_sort(list_distinct(coalesce(assertions, {EMPTY})))"
JACCARD = "CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END"
STRATA = "st AS (SELECT doc_id, n_chars, CAST(least(((row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 6) // count(*) OVER (), 5) + 1 AS INT) AS stratum FROM documents WHERE n_chars IS NOT NULL)"
RUNS = """tg AS (SELECT doc_id, line, CASE WHEN regexp_matches(body, '[0-9]') THEN 'number' ELSE 'words' END AS tag FROM li),
fr AS (SELECT *, CASE WHEN lag(tag) OVER w = tag AND lag(line) OVER w = line - 1 THEN 0 ELSE 1 END AS fresh FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
ru AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM fr)"""

ORACLE = {
    "repeated_passages": f"WITH {LINES}, {GROUPS} SELECT * FROM g",
    "passage_occurrences": f"WITH {LINES}, {GROUPS}, {OCC} SELECT * FROM o",
    "passage_strata": f"""WITH {LINES}, {GROUPS}, x AS (SELECT passage, CASE WHEN records >= 4 THEN 'high' WHEN records = 3 THEN 'middle' ELSE 'low' END AS stratum, records FROM g),
      y AS (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY {_hash("'passages'", "passage")}, passage) AS INT) AS place FROM x)
      SELECT *, CASE WHEN place <= 10 THEN 'holdout' ELSE 'dev' END AS part FROM y WHERE place <= 50""",
    "record_features": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS e FROM documents)
      SELECT doc_id, length(t) AS chars, len(e) AS lines, len(list_filter(e, lambda x: regexp_matches(x, '[^ \\t\\r\\f]'))) AS filled, len(list_filter(e, lambda x: regexp_matches(x, '^[ \\t]*[0-9]+\\.[ \\t]'))) AS numbered,
      len(list_filter(e, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS bullets, len(list_filter(e, lambda x: contains(x, ':'))) AS colons FROM t""",
    "line_spans": f'WITH {LINES} SELECT doc_id, line, start, "end" FROM li',
    "sentence_spans": """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^.!?;\\n]*[.!?;\\n]+|[^.!?;\\n]+$') AS e FROM documents WHERE text <> '')
      SELECT doc_id, len(e) AS sentences, CAST(list_sum(list_transform(e, lambda x: length(x))) AS INT) AS last_end, CAST(list_max(list_transform(e, lambda x: length(x))) AS INT) AS longest FROM t WHERE len(e) > 0""",
    "token_counts": f"SELECT doc_id, {WORDS.format('text')} AS words FROM documents",
    "phrase_keys": f"WITH {S} SELECT trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS phrase, count(*) AS n FROM s WHERE text IS NOT NULL GROUP BY 1",
    "crlf_project": f"""WITH {S}, k AS (SELECT DISTINCT record_id, start, "end" FROM s WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL)
      SELECT record_id, start, "end", CAST(start + length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) AS INT) AS crlf_start,
      CAST("end" + length(substr(text, 1, "end")) - length(replace(substr(text, 1, "end"), chr(10), '')) AS INT) AS crlf_end FROM k JOIN documents ON doc_id = record_id WHERE start >= 0 AND start <= "end" AND "end" <= length(text)""",
    "context_windows": """WITH k AS (SELECT DISTINCT item_id, record_id, start, "end" FROM evidence WHERE item_id IS NOT NULL AND record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL)
      SELECT item_id, start, "end", substr(text, greatest(start - 40, 0) + 1, least(start, 40)) || '⟦' || substr(text, start + 1, "end" - start) || '⟧' || substr(text, "end" + 1, 40) AS context
      FROM k JOIN documents ON doc_id = record_id WHERE start >= 0 AND start < "end" AND "end" <= length(text)""",
    "latest_heading": f"""WITH {S}, {LINES}, {HEADS}, x AS (SELECT record_id, span_id, start FROM s WHERE record_id IS NOT NULL AND start IS NOT NULL)
      SELECT span_id, heading FROM x ASOF LEFT JOIN h ON x.record_id = h.doc_id AND x.start >= h.off""",
    "section_items": f"""WITH {LINES}, {HEADS}, x AS (SELECT * FROM li WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = li.doc_id AND h.off = li.start))
      SELECT x.doc_id, heading, start, "end" FROM x ASOF JOIN h ON x.doc_id = h.doc_id AND x.start >= h.off WHERE heading IN ('TIỀN SỬ', 'HISTORY')""",
    "gram_dictionary": f"""WITH {LINES}, w AS (SELECT doc_id, line, regexp_split_to_array(lower(body), ' +') AS w FROM li), a AS (SELECT *, unnest(range(len(w))) AS off FROM w),
      n AS (SELECT *, unnest(range(1, least((SELECT max(len(regexp_split_to_array(canonical, ' +'))) FROM nodes), len(w) - off) + 1)) AS n FROM a), y AS (SELECT doc_id, regexp_replace(array_to_string(w[off + 1 : off + n], ' '), '^[,;:.(]+|[,;:.)]+$', '', 'g') AS phrase FROM n),
      p AS (SELECT DISTINCT lower(canonical) AS phrase FROM nodes WHERE canonical IS NOT NULL) SELECT phrase, count(DISTINCT doc_id) AS records, count(*) AS uses FROM y JOIN p USING (phrase) GROUP BY phrase""",
    "gaps_islands": f"WITH {LINES}, {RUNS} SELECT doc_id, tag, min(line) AS first, max(line) AS last, count(*) AS n FROM ru GROUP BY doc_id, run, tag",
    "span_validate": f"WITH {S}, {VIOLATIONS} SELECT span_id, array_to_string(v, ',') AS violations FROM vi",
    "violation_census": f"WITH {S}, {VIOLATIONS}, x AS (SELECT unnest(CASE WHEN len(v) = 0 THEN ['ok'] ELSE v END) AS violation FROM vi) SELECT violation, count(*) AS n FROM x GROUP BY violation",
    "order_check": f"""WITH {S}, x AS (SELECT * FROM s WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND ord IS NOT NULL),
      y AS (SELECT record_id, lag(start) OVER w AS ps, lag("end") OVER w AS pe, start, "end" FROM x WINDOW w AS (PARTITION BY record_id ORDER BY ord, span_id, start, "end")),
      a AS (SELECT record_id, count(*) AS spans, count(*) FILTER (ps > start OR (ps = start AND pe > "end")) AS out_of_order FROM y GROUP BY record_id),
      t AS (SELECT record_id, count(*) FILTER (n > 1) AS repeated FROM (SELECT record_id, count(*) AS n FROM x WHERE type IS NOT NULL GROUP BY record_id, start, "end", type) GROUP BY record_id)
      SELECT record_id, spans, out_of_order, coalesce(repeated, 0) AS repeated FROM a LEFT JOIN t USING (record_id)""",
    "id_set_check": f"""WITH {S}, a AS (SELECT DISTINCT doc_id AS id FROM documents), b AS (SELECT DISTINCT record_id AS id FROM s WHERE record_id IS NOT NULL)
      SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS both, count(*) FILTER (b.id IS NULL) AS only_docs, count(*) FILTER (a.id IS NULL) AS only_spans FROM a FULL JOIN b ON a.id = b.id""",
    "corpus_fingerprint": """WITH x AS (SELECT coalesce(source, '') AS source, sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(text, chr(30))) AS h FROM documents)
      SELECT source, count(*) AS rows, CAST(sum(CAST(('0x' || substr(h, 1, 8)) AS BIGINT)) AS VARCHAR) AS digest_a, CAST(sum(CAST(('0x' || substr(h, 9, 8)) AS BIGINT)) AS VARCHAR) AS digest_b FROM x GROUP BY source""",
    "redelivery_changes": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY ingested_at) AS n, count(*) OVER (PARTITION BY span_id) AS k FROM spans),
      j AS (SELECT a.text IS DISTINCT FROM b.text AS c1, a.type IS DISTINCT FROM b.type AS c2, a.start IS DISTINCT FROM b.start AS c3, a."end" IS DISTINCT FROM b."end" AS c4, a.confidence IS DISTINCT FROM b.confidence AS c5, a.source IS DISTINCT FROM b.source AS c6
      FROM x a JOIN x b ON a.span_id = b.span_id AND a.n = 1 AND b.n = b.k AND a.k > 1)
      SELECT unnest(['text', 'type', 'start', 'end', 'confidence', 'source']) AS "column", unnest([count(*) FILTER (c1), count(*) FILTER (c2), count(*) FILTER (c3), count(*) FILTER (c4), count(*) FILTER (c5), count(*) FILTER (c6)]) AS changed FROM j""",
    "reject_reasons": f"""WITH {S}, t AS (SELECT *, coalesce(trim(text), '') AS t FROM s) SELECT type, CASE WHEN t = '' THEN 'empty' WHEN start IS NULL OR "end" IS NULL THEN 'no_position' WHEN len(regexp_split_to_array(t, ' +')) > 14 THEN 'long'
      WHEN regexp_matches(t, '^[0-9.,/% ]+$') THEN 'number_only' WHEN confidence < 0.5 THEN 'low_confidence' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY 1, 2""",
    "evidence_aggregate": f"WITH {BC}, {P}, {EVID} SELECT {K}, sources, source_count, mean_confidence, max_confidence, baseline_exact, EXISTS (SELECT 1 FROM b WHERE b.record_id = ev.record_id AND b.type = ev.type AND b.start < ev.\"end\" AND ev.start < b.\"end\" AND b.start < b.\"end\" AND ev.start < ev.\"end\") AS baseline_overlap_same_type FROM ev",
    "vote_ensemble": f"WITH {BC}, {P}, {EVID} SELECT {K}, sources AS support, mean_confidence FROM ev WHERE source_count >= 3 AND NOT baseline_exact AND coalesce(mean_confidence, 0) >= 0.6",
    "support_combinations": f"WITH {P}, x AS (SELECT {K}, string_agg(source, '+' ORDER BY source) AS support FROM p GROUP BY {K}) SELECT support, count(*) AS n FROM x GROUP BY support",
    "pair_eligibility": f"""WITH {P}, x AS (SELECT {K}, string_agg(source, '+' ORDER BY source) AS sources, min(confidence) AS least, count(*) AS n, count(confidence) AS k FROM p GROUP BY {K})
      SELECT {K}, sources, least FROM x WHERE n = 2 AND k = 2 AND least >= CASE type WHEN 'TRIỆU_CHỨNG' THEN 0.6 WHEN 'CHẨN_ĐOÁN' THEN 0.65 WHEN 'THUỐC' THEN 0.7 WHEN 'TÊN_XÉT_NGHIỆM' THEN 0.6 WHEN 'KẾT_QUẢ_XÉT_NGHIỆM' THEN 0.6 WHEN 'THÔNG_TIN_BỆNH_NHÂN' THEN 0.5 END""",
    "snapshot_diff": f"""WITH {BC}, x AS (SELECT DISTINCT {K} FROM b WHERE {FULL}), y AS (SELECT DISTINCT {K} FROM c WHERE {FULL}), z AS (SELECT *, 'new' AS change FROM (SELECT * FROM y EXCEPT SELECT * FROM x) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM x EXCEPT SELECT * FROM y))
      SELECT type, change, count(*) AS n FROM z GROUP BY type, change""",
    "cohort_report": f"""WITH {BC}, x AS (SELECT DISTINCT {K} FROM b WHERE {FULL}), y AS (SELECT {K}, bool_or(coalesce(len(assertions) > 0, false)) AS a FROM c WHERE {FULL} GROUP BY {K})
      SELECT type, count(*) AS novel, count(*) FILTER (a) AS asserted FROM y ANTI JOIN x USING ({K}) GROUP BY type""",
    "symmetric_difference": f"""WITH {BC}, {PRF_KEYS} (SELECT * FROM bf EXCEPT SELECT * FROM cf) UNION (SELECT * FROM cf EXCEPT SELECT * FROM bf)""",
    "transition_matrix": f"""WITH {BC}, x AS (SELECT record_id, text, type, max(coalesce(array_to_string({SORTED}, '+'), '')) AS was FROM b WHERE record_id IS NOT NULL AND text IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
      y AS (SELECT record_id, text, type, max(coalesce(array_to_string({SORTED}, '+'), '')) AS became FROM c WHERE record_id IS NOT NULL AND text IS NOT NULL AND type IS NOT NULL GROUP BY ALL)
      SELECT was, became, count(*) AS n FROM x JOIN y USING (record_id, text, type) GROUP BY was, became""",
    "vote_states": f"""WITH {P}, k AS (SELECT DISTINCT {K} FROM p), sp AS (SELECT DISTINCT record_id, source FROM p), q AS (SELECT DISTINCT record_id, start, "end", source FROM p WHERE start < "end"),
      e AS (SELECT k.*, sp.source FROM k JOIN sp USING (record_id)), v AS (SELECT source, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.record_id = e.record_id AND p.start = e.start AND p."end" = e."end" AND p.type = e.type AND p.text = e.text AND p.source = e.source) THEN 'VOTE'
      WHEN EXISTS (SELECT 1 FROM q WHERE q.record_id = e.record_id AND q.source = e.source AND q.start < e."end" AND e.start < q."end" AND e.start < e."end") THEN 'DROP' ELSE 'ABSTAIN' END AS vote FROM e) SELECT source, vote, count(*) AS n FROM v GROUP BY source, vote""",
    "family_votes": f"""WITH v AS (SELECT item_id, {_family(SRC)} AS family, type FROM proposals WHERE item_id IS NOT NULL AND source IS NOT NULL AND type IS NOT NULL) SELECT item_id, family, min(type) AS label FROM v GROUP BY item_id, family HAVING min(type) = max(type)""",
    "majority_shares": f"""WITH v AS (SELECT item_id, {_family(SRC)} AS family, type FROM proposals WHERE item_id IS NOT NULL AND source IS NOT NULL AND type IS NOT NULL), f AS (SELECT item_id, family, min(type) AS label FROM v GROUP BY item_id, family HAVING min(type) = max(type)),
      n AS (SELECT item_id, label, count(*) AS n FROM f GROUP BY item_id, label) SELECT item_id, label, round((n + 1) / (sum(n) OVER (PARTITION BY item_id) + 6), 6) AS share FROM n""",
    "unique_alias_codes": f"""WITH {S}, x AS (SELECT type, {PHRASE} AS mention, array_to_string(list_sort(list_distinct(candidates)), '|') AS codes FROM s WHERE type IS NOT NULL AND text IS NOT NULL AND len(candidates) > 0)
      SELECT type, mention, min(codes) AS codes FROM x GROUP BY type, mention HAVING min(codes) = max(codes) AND min(codes) <> ''""",
    "mention_rollup": f"""WITH {S}, x AS (SELECT *, {PHRASE} AS mention FROM s WHERE type IS NOT NULL AND text IS NOT NULL), n AS (SELECT type, mention, text, count(*) AS n FROM x GROUP BY ALL),
      t AS (SELECT type, mention, sum(n)::BIGINT AS uses, first(text ORDER BY n DESC, text) AS surface FROM n GROUP BY type, mention), r AS (SELECT type, mention, count(DISTINCT record_id) AS records, min(record_id) AS first_record FROM x GROUP BY type, mention)
      SELECT type, mention, surface, uses, records, first_record FROM t JOIN r USING (type, mention)""",
    "lexicon_distill": f"""WITH {S}, x AS (SELECT *, {PHRASE} AS mention FROM s WHERE type IS NOT NULL AND text IS NOT NULL AND record_id IS NOT NULL) SELECT mention, min(type) AS type, count(DISTINCT record_id) AS records FROM x GROUP BY mention HAVING min(type) = max(type) AND count(DISTINCT record_id) >= 3""",
    "exposure_concentration": f"""WITH {S}, x AS (SELECT substr(u, 1, 3) AS family FROM (SELECT unnest(candidates) AS u FROM s WHERE type = 'CHẨN_ĐOÁN')), n AS (SELECT family, count(*) AS n FROM x WHERE family IS NOT NULL GROUP BY family), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, family) AS k FROM n)
      SELECT sum(n)::BIGINT AS rows, count(*) AS units, round(sum(n)::DOUBLE * sum(n) / sum(n * n), 4) AS effective, round(sum(n) FILTER (k <= 1) / sum(n), 6) AS top1_share, round(sum(n) FILTER (k <= 5) / sum(n), 6) AS top5_share, round(sum(n) FILTER (k <= 10) / sum(n), 6) AS top10_share FROM k""",
    "novelty_partition": f"""WITH {BC}, x AS (SELECT DISTINCT substr(u, 1, 3) AS family FROM (SELECT unnest(candidates) AS u FROM b WHERE type = 'CHẨN_ĐOÁN') WHERE u IS NOT NULL), y AS (SELECT record_id, substr(u, 1, 3) AS family FROM (SELECT record_id, unnest(candidates) AS u FROM c WHERE type = 'CHẨN_ĐOÁN') WHERE u IS NOT NULL)
      SELECT CASE WHEN x.family IS NOT NULL THEN 'seen' ELSE 'novel' END AS part, count(*) AS rows, count(DISTINCT y.family) AS families, count(DISTINCT record_id) AS records FROM y LEFT JOIN x ON x.family = y.family GROUP BY 1""",
    "passage_units": f"WITH {S}, {LINES}, {GROUPS}, {OCC}, {PASSAGE_ENTITIES} SELECT * FROM units",
    "passage_eligible": f"""WITH {S}, {LINES}, {GROUPS}, {OCC}, {PASSAGE_ENTITIES}, z AS (SELECT passage, count(DISTINCT doc_id) AS n FROM o GROUP BY passage),
      x AS (SELECT u.* FROM units u JOIN z USING (passage) WHERE records >= greatest(2, ceil(n / 2)) AND families >= 2), y AS (SELECT *, rank() OVER (PARTITION BY passage, start, "end" ORDER BY records DESC, units DESC) AS r FROM x)
      SELECT * EXCLUDE (r) FROM y WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY passage, start, "end") = 1""",
    "span_relation": f"""WITH {BC}, {KEYS}, j AS (SELECT x.record_id, x.start, x."end", x.type, bool_or(x.type = y.type AND y.start <= x.start AND x."end" <= y."end") AS i, bool_or(x.type = y.type AND x.start <= y.start AND y."end" <= x."end") AS a, bool_or(x.type = y.type) AS e, count(y.record_id) AS n
      FROM ck x LEFT JOIN bk y ON {MEETS} GROUP BY ALL) SELECT record_id, start, "end", type, CASE WHEN n = 0 THEN 'disjoint' WHEN i THEN 'contained_same_type' WHEN a THEN 'contains_same_type' WHEN NOT e THEN 'cross_type' ELSE 'partial_same_type' END AS relation FROM j""",
    "disjoint_additions": f"WITH {BC}, {KEYS} SELECT * FROM ck x WHERE NOT EXISTS (SELECT 1 FROM bk y WHERE {MEETS})",
    "same_type_disjoint": f"WITH {BC}, {KEYS} SELECT * FROM ck x WHERE NOT EXISTS (SELECT 1 FROM bk y WHERE {MEETS} AND x.type = y.type)",
    "consensus_semi_join": f"""WITH {BC}, {KEYS} SELECT * FROM ck x WHERE EXISTS (SELECT 1 FROM bk y WHERE {MEETS} AND x.type = y.type AND (least(x."end", y."end") - greatest(x.start, y.start)) / least(x."end" - x.start, y."end" - y.start) >= 0.5)""",
    "window_clip": f"""WITH {S}, k AS (SELECT DISTINCT record_id, start, "end", type FROM s WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL), w AS (SELECT DISTINCT record AS record_id, start, "end" FROM occurrences WHERE record IS NOT NULL AND start < "end")
      SELECT x.record_id, y.start AS w_start, y."end" AS w_end, x.type, x.start - y.start AS start, x."end" - y.start AS "end", x.start < y.start OR x."end" > y."end" AS crosses FROM k x JOIN w y ON {MEETS}""",
    "strict_prf": f"WITH {BC}, {PRF_KEYS}, {PRF} SELECT {PRF_OUT} FROM j",
    "per_type_prf": f"WITH {BC}, {PRF_KEYS}, {PRF} SELECT type, {PRF_OUT} FROM j GROUP BY type",
    "jaccard_macro": f"""WITH {BC}, x AS (SELECT record_id, start, "end", type, min({SORTED}) AS x FROM b WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
      y AS (SELECT record_id, start, "end", type, min({SORTED}) AS y FROM c WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL GROUP BY ALL)
      SELECT type, count(*) AS pairs, round(avg({JACCARD}), 6) AS jaccard FROM x JOIN y USING (record_id, start, "end", type) GROUP BY type""",
    "reviewer_agreement": f"""WITH {BC}, x AS (SELECT record_id, start, "end", type, list_distinct(flatten(list(coalesce(assertions, {EMPTY})))) AS x FROM b WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
      y AS (SELECT record_id, start, "end", type, list_distinct(flatten(list(coalesce(assertions, {EMPTY})))) AS y FROM c WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
      j AS (SELECT x, y, x IS NOT NULL AND y IS NOT NULL AS h FROM x FULL JOIN y USING (record_id, start, "end", type))
      SELECT count(*) FILTER (h) AS shared, count(x) AS first, count(y) AS second, round(2 * count(*) FILTER (h) / greatest(count(x) + count(y), 1), 6) AS span_f1, round(avg(CASE WHEN h THEN {JACCARD} ELSE 0 END), 6) AS assertion_jaccard FROM j""",
    "threshold_grid": f"WITH {SCORED}, {GRID_SQL} SELECT * FROM tg",
    "threshold_choice": f"WITH {SCORED}, {GRID_SQL} SELECT threshold, taken, \"right\", precision, recall, f1 FROM tg WHERE precision >= 0.3 ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1",
    "ece": f"""WITH {SCORED}, n AS (SELECT least(floor(round(score * 10, 9)), 9)::INT AS bin, score, positive FROM scored WHERE score BETWEEN 0 AND 1 AND positive IS NOT NULL), p AS (SELECT bin, count(*) AS n, avg(score) AS score, avg(positive::INT) AS rate FROM n GROUP BY bin)
      SELECT bin, n, round(score, 6) AS score, round(rate, 6) AS rate, round(n / sum(n) OVER () * abs(score - rate), 6) AS gap FROM p""",
    "length_strata_sample": f"WITH {STRATA} SELECT * FROM st",
    "strata_holdout": f"""WITH {STRATA}, y AS (SELECT doc_id, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY {_hash("'blind'", "CAST(doc_id AS VARCHAR)")}, doc_id) AS INT) AS place FROM st) SELECT *, CASE WHEN place <= 1 THEN 'holdout' ELSE 'dev' END AS part FROM y WHERE place <= 3""",
    "hash_folds": f"""SELECT CAST({_hash("'fold'", "CAST(doc_id AS VARCHAR)")} % 10 AS INT) AS fold, count(*) AS n FROM documents GROUP BY 1""",
    "bootstrap_paired": f"WITH {BC}, {DELTA}, {_poisson()} SELECT count(mean) AS rounds, round(list_sort(list(mean))[floor(0.025 * (count(mean) - 1))::INT + 1], 6) AS low, round(avg(mean), 6) AS mean, round(list_sort(list(mean))[floor(0.975 * (count(mean) - 1))::INT + 1], 6) AS high FROM me",
    "bootstrap_linear": f"WITH {BC}, {DELTA}, {_poisson()} SELECT count(mean) AS rounds, round(quantile_cont(mean, 0.025), 6) AS low, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.975), 6) AS high FROM me",
    "bootstrap_stratified": f"""WITH {BC}, {DELTA}, pe AS (SELECT stratum, count(*) AS n FROM dl GROUP BY stratum), ro AS (SELECT stratum, delta, r, -ln(({_hash("'strata'", "CAST(r AS VARCHAR)", "CAST(record_id AS VARCHAR)")} + 1) / 4294967297.0::DOUBLE) AS w FROM dl CROSS JOIN range(100) AS q(r)),
      m AS (SELECT stratum, r, sum(w * delta) / sum(w) AS m FROM ro GROUP BY stratum, r), me AS (SELECT r, sum(m * n) / sum(n) AS mean FROM m JOIN pe USING (stratum) GROUP BY r)
      SELECT count(mean) AS rounds, round(list_sort(list(mean))[floor(0.025 * (count(mean) - 1))::INT + 1], 6) AS low, round(avg(mean), 6) AS mean, round(list_sort(list(mean))[floor(0.975 * (count(mean) - 1))::INT + 1], 6) AS high FROM me""",
    "bernstein_bounds": f"""WITH {BC}, {DELTA}, x AS (SELECT stratum, count(*) AS n, avg(delta) AS m, coalesce(var_samp(delta), 0) AS v FROM dl GROUP BY stratum)
      SELECT stratum, n, round(m, 6) AS mean, round(m - sqrt(ln(1 / 0.05::DOUBLE) / (2 * n)), 6) AS hoeffding, CASE WHEN n > 1 THEN round(m - sqrt(2 * v * ln(2 / 0.05::DOUBLE) / n) - 7 * ln(2 / 0.05::DOUBLE) / (3 * (n - 1)), 6) END AS bernstein FROM x""",
    "dense_topk": f"WITH {TOP.format(pool='', k=10)} SELECT query_id, base_id, score, CAST(rank AS INT) AS rank FROM ranked",
    "dense_topk_pool": f"WITH {TOP.format(pool='AND q.label = b.label', k=5)} SELECT query_id, base_id, score, CAST(rank AS INT) AS rank FROM ranked",
    "recall_at_k": f"""WITH {RECALL} SELECT coalesce(CAST(label AS VARCHAR), 'all') AS label, count(*) AS queries, round(avg(list_contains(top[1:1], label0)::INT), 6) AS recall_1, round(avg(list_contains(top[1:5], label0)::INT), 6) AS recall_5, round(avg(list_contains(top[1:10], label0)::INT), 6) AS recall_10
      FROM (SELECT *, label AS label0 FROM rt) GROUP BY GROUPING SETS ((), (label))""",
    "prefix_k_utility": f"""WITH {RECALL}, k AS (SELECT unnest(range(1, 11))::INT AS k, top, label FROM rt), p AS (SELECT k, round(avg(CASE WHEN list_contains(top[1:k], label) THEN 1 / len(list_distinct(top[1:k])) ELSE 0 END), 6) AS utility FROM k GROUP BY k)
      SELECT k, utility, row_number() OVER (ORDER BY utility DESC, k) = 1 AS best FROM p""",
    "prototype_centroids": """WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT label, dim, avg(x::DOUBLE) AS m FROM x GROUP BY label, dim)
      SELECT label, CAST(dim AS INT) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
    "tfidf_topk": f"""WITH nm AS (SELECT identifier AS code, unnest(list_concat([canonical], coalesce(aliases, {EMPTY}))) AS name FROM nodes), na AS (SELECT min(code) || ' ' || name AS id, name FROM nm WHERE name IS NOT NULL GROUP BY name),
      w AS (SELECT id, ' ' || unnest(list_filter(regexp_split_to_array(lower(name), '[ \\t\\r\\n]+'), lambda x: x <> '')) || ' ' AS w FROM na), k AS (SELECT *, unnest([2, 3, 4, 5]) AS k FROM w), a AS (SELECT *, unnest(range(1, greatest(length(w) - k + 1, 1) + 1)) AS i FROM k),
      g AS (SELECT id, substr(w, i, k) AS gram, count(*) AS tf FROM a GROUP BY ALL), f AS (SELECT gram, ln((1 + (SELECT count(DISTINCT id) FROM na)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY gram),
      x AS (SELECT id, gram, tf * idf AS w FROM g JOIN f USING (gram)), n AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x),
      s AS (SELECT q.id AS query_id, b.id AS base_id, round(sum(q.w * b.w), 6) AS score FROM n q JOIN n b USING (gram) GROUP BY q.id, b.id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    "concept_edges": f"WITH {EDGES} SELECT * FROM ed",
    "concept_siblings": f"WITH {EDGES} SELECT source, target AS parent, count(*) OVER (PARTITION BY target) - 1 AS siblings FROM ed",
    "neighbor_mean": f"WITH {EDGES}, {NEAR} SELECT a AS id, count(*) AS degree, round(avg(length(canonical)::DOUBLE), 6) AS neighbour_mean FROM nb LEFT JOIN nodes ON identifier = b GROUP BY a",
    "hard_negatives": f"""WITH {EDGES}, {NEAR}, sb AS (SELECT DISTINCT x.source AS id, y.source AS negative FROM ed x JOIN ed y ON x.target = y.target AND x.source <> y.source) SELECT a AS id, b AS negative FROM nb WHERE a <> b UNION SELECT id, negative FROM sb""",
    "sibling_rows": f"""WITH {EDGES} SELECT DISTINCT x.source AS id, y.source AS other FROM ed x JOIN ed y ON x.target = y.target AND x.source <> y.source""",
    "parent_hedge": f"""WITH {S}, x AS (SELECT type = 'CHẨN_ĐOÁN' AND len(candidates) = 1 AND length(candidates[1]) > 3 AND substr(candidates[1], 1, 3) IN (SELECT identifier FROM nodes WHERE length(identifier) = 3) AS e, coalesce(len(candidates), 0) AS n FROM s WHERE span_id IS NOT NULL)
      SELECT coalesce(e, false) AS eligible, CAST(n + CASE WHEN e THEN 1 ELSE 0 END AS INT) AS codes, count(*) AS n FROM x GROUP BY 1, 2""",
    "alias_link": f"""WITH {S}, a AS (SELECT trim(regexp_replace(lower(name), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS phrase, min(identifier) AS identifier FROM (SELECT identifier, unnest(list_concat([canonical], coalesce(aliases, {EMPTY}))) AS name FROM nodes) WHERE name IS NOT NULL GROUP BY 1),
      x AS (SELECT type, trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS phrase FROM s WHERE text IS NOT NULL AND type IN ('CHẨN_ĐOÁN', 'THUỐC')) SELECT type, coalesce(identifier, 'none') AS identifier, count(*) AS n FROM x LEFT JOIN a USING (phrase) GROUP BY 1, 2""",
    "code_display": f"""WITH {S}, c AS (SELECT DISTINCT unnest(candidates) AS code FROM s), k AS (SELECT code, regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') AS compact FROM c WHERE code IS NOT NULL)
      SELECT code, compact, CASE WHEN length(compact) > 3 THEN substr(compact, 1, 3) || '.' || substr(compact, 4) ELSE compact END AS display, CASE WHEN length(code) > 3 THEN substr(code, 1, 3) END AS parent FROM k""",
}

NAMES = f"""na AS (SELECT identifier AS code, unnest(list_concat([canonical], coalesce(aliases, {EMPTY}))) AS name FROM nodes), nk AS (SELECT code, trim(regexp_replace(lower(name), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS key FROM na WHERE name IS NOT NULL)"""
MENTION = "trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g'))"
HALF = """(least(x."end", y."end") - greatest(x.start, y.start)) / least(x."end" - x.start, y."end" - y.start)"""
OF = """SELECT DISTINCT record_id, start, "end", type FROM s WHERE source = '{}' AND record_id IS NOT NULL AND start < "end" AND type IS NOT NULL"""
NESTED = """x.type = y.type AND ((y.start <= x.start AND x."end" <= y."end") OR (x.start <= y.start AND y."end" <= x."end"))"""
CODES = "SELECT DISTINCT record_id, start, \"end\", code FROM (SELECT record_id, start, \"end\", unnest(candidates) AS code FROM {}) WHERE record_id IS NOT NULL AND start IS NOT NULL AND \"end\" IS NOT NULL AND code IS NOT NULL"

ORACLE |= {
    "routed_merge": f"""WITH {BC}, {KEYS}, k AS (SELECT record_id, start, "end", type, max(candidates) AS candidates FROM b WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL GROUP BY ALL), a AS (SELECT * FROM ck WHERE type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN'))
      SELECT a.*, 'learned' AS source, coalesce(len(candidates), 0)::INT AS codes FROM a LEFT JOIN k USING (record_id, start, "end", type)
      UNION ALL SELECT record_id, start, "end", type, 'legacy', coalesce(len(candidates), 0)::INT FROM k x WHERE type NOT IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN') AND NOT EXISTS (SELECT 1 FROM a y WHERE {MEETS})""",
    "disjoint_union": f"WITH {BC}, {KEYS} SELECT *, 'base' AS source FROM bk UNION ALL SELECT *, 'added' FROM ck x WHERE NOT EXISTS (SELECT 1 FROM bk y WHERE {MEETS})",
    "three_way_support": f"""WITH {S}, r AS ({OF.format("rule")}), t AS ({OF.format("llm_wide")}), k AS ({OF.format("tok_alpha")})
      SELECT *, CAST(EXISTS (SELECT 1 FROM r y WHERE {MEETS} AND x.type = y.type AND {HALF} >= 0.7) AS INT) + CAST(EXISTS (SELECT 1 FROM t y WHERE {MEETS} AND x.type = y.type AND {HALF} >= 0.65) AS INT) AS support FROM k x""",
    "boundary_integration": f"""WITH {BC}, {KEYS}, q AS (SELECT * FROM ck WHERE type = 'TRIỆU_CHỨNG'), st AS (SELECT x.record_id, x.start, x."end", x.type, count(y.record_id) AS n, bool_and({NESTED}) AS fits FROM q x LEFT JOIN bk y ON {MEETS} GROUP BY ALL),
      u AS (SELECT record_id, start, "end", type, CASE WHEN n = 0 THEN 'add' WHEN fits THEN 'replace' ELSE 'skip' END AS action FROM st), g AS (SELECT * FROM bk y WHERE EXISTS (SELECT 1 FROM u x WHERE x.action = 'replace' AND {MEETS} AND {NESTED}))
      SELECT *, 'keep' AS action FROM (SELECT * FROM bk EXCEPT SELECT * FROM g) UNION ALL SELECT * FROM u WHERE action <> 'skip'""",
    "staged_codes": f"""WITH {S}, {NAMES}, t AS (SELECT key, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM nk GROUP BY key), m AS (SELECT span_id, {MENTION} AS mention FROM s WHERE text IS NOT NULL AND type IN ('CHẨN_ĐOÁN', 'THUỐC'))
      SELECT span_id, CASE WHEN a.codes IS NOT NULL THEN 'exact' WHEN b.codes IS NOT NULL THEN 'first_word' ELSE 'none' END AS stage, coalesce(a.codes, b.codes, '') AS codes FROM m LEFT JOIN t a ON a.key = mention LEFT JOIN t b ON b.key = split_part(mention, ' ', 1)""",
    "contained_phrase": f"""WITH {S}, {NAMES}, m AS (SELECT DISTINCT {MENTION} AS mention FROM s WHERE text IS NOT NULL), p AS (SELECT DISTINCT key AS phrase FROM nk)
      SELECT mention, first(phrase ORDER BY length(phrase) DESC, phrase) AS phrase FROM m JOIN p ON contains(' ' || mention || ' ', ' ' || phrase || ' ') GROUP BY mention""",
    "reviewed_candidates": f"""WITH {S}, u AS (SELECT DISTINCT type, lower(trim(text)) AS mention, unnest(candidates) AS code FROM s WHERE text IS NOT NULL AND type IS NOT NULL), o AS (SELECT type, code, min(mention) AS mention FROM u WHERE code IS NOT NULL GROUP BY type, code HAVING count(*) = 1),
      x AS (SELECT span_id, type, lower(trim(text)) AS mention, candidates FROM s WHERE span_id IS NOT NULL), e AS (SELECT DISTINCT span_id, type, mention, unnest(candidates) AS code FROM x), k AS (SELECT span_id, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.type = e.type AND o.mention = e.mention AND o.code = e.code) GROUP BY span_id)
      SELECT CAST(coalesce(k.n, 0) AS INT) AS codes, count(*) AS n FROM x LEFT JOIN k USING (span_id) GROUP BY 1""",
    "transfer_lineage": f"""WITH {BC}, x AS ({CODES.format("b")}), y AS ({CODES.format("c")}) SELECT count(*) FILTER (x.record_id IS NOT NULL AND y.record_id IS NOT NULL) AS both, count(*) FILTER (y.record_id IS NULL) AS only_before, count(*) FILTER (x.record_id IS NULL) AS only_after, count(*) AS "all" FROM x FULL JOIN y USING (record_id, start, "end", code)""",
    "leave_one_out": f"""WITH {S}, {LINES}, {GROUPS}, {OCC}, {PASSAGE_ENTITIES}, n AS (SELECT passage, start, "end", type, count(DISTINCT record_id) AS n FROM ent GROUP BY ALL), z AS (SELECT passage, count(DISTINCT record_id) AS r FROM ent GROUP BY passage)
      SELECT passage, count(*) AS keys, sum(r)::BIGINT AS views, sum(CASE WHEN n - 1 >= 2 THEN r ELSE r - n END)::BIGINT AS stable FROM n JOIN z USING (passage) WHERE n >= 2 GROUP BY passage""",
    "cross_folds": f"""WITH f AS (SELECT DISTINCT doc_id, CAST({_hash("'cross'", "CAST(doc_id AS VARCHAR)")} % 5 AS INT) AS f FROM documents), r AS (SELECT f, CAST(r AS INT) AS round FROM f CROSS JOIN range(5) AS q(r))
      SELECT round, CASE WHEN f = round THEN 'test' WHEN f = (round + 1) % 5 THEN 'validate' ELSE 'train' END AS role, count(*) AS n FROM r GROUP BY 1, 2""",
    "score_shapes": """WITH e AS (SELECT item_id, unnest(confidences) AS c FROM evidence WHERE item_id IS NOT NULL), l AS (SELECT item_id, list_reverse_sort(list(c)) AS s FROM e WHERE c IS NOT NULL GROUP BY item_id), z AS (SELECT *, list_sum(list_transform(s, lambda x: exp(x - s[1]))) AS z FROM l)
      SELECT item_id, round(s[1], 6) AS top, round(list_avg(s), 6) AS mean, round(list_stddev_pop(s), 6) AS dev, round(coalesce(s[1] - s[2], 0), 6) AS margin_1, round(coalesce(s[2] - s[3], 0), 6) AS margin_2, round(-list_sum(list_transform(s, lambda x: exp(x - s[1]) / z * ln(exp(x - s[1]) / z))), 6) AS entropy FROM z""",
    "fold_thresholds": f"""WITH sc AS (SELECT CAST({_hash("'calibrate'", "CAST(record AS VARCHAR)")} % 5 AS INT) AS fold, round(list_avg(list_filter(map_values(confidences), lambda x: x IS NOT NULL)), 6) AS score, positive FROM pu_rows WHERE record IS NOT NULL),
      t AS (SELECT fold, threshold, count(*) FILTER (score >= threshold) AS a, count(*) FILTER (score >= threshold AND positive) AS r, count(*) FILTER (positive) AS p FROM sc CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) WHERE score IS NOT NULL AND positive IS NOT NULL GROUP BY fold, threshold),
      x AS (SELECT fold, threshold, round(CASE WHEN a > 0 THEN r / a ELSE 0 END, 6) AS precision, round(CASE WHEN a + p > 0 THEN 2 * r / (a + p) ELSE 0 END, 6) AS f1 FROM t) SELECT * FROM x WHERE precision >= 0.2 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, precision DESC, threshold DESC) = 1""",
    "response_clusters": f"""WITH {S}, {LINES}, {GROUPS}, {OCC}, x AS (SELECT DISTINCT passage, record_id, s.start - o.start AS start, s."end" - o.start AS "end", type FROM s JOIN o ON s.record_id = o.doc_id AND s.start >= o.start AND s."end" <= o."end" AND s.start < s."end" AND type IS NOT NULL)
      SELECT passage, start, "end", type, count(DISTINCT record_id) AS records FROM x GROUP BY ALL HAVING count(DISTINCT record_id) >= 2""",
    "routed_ranking": """WITH em AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), t AS (SELECT q.id AS query_id, b.id AS base_id, round(list_cosine_similarity(q.v, b.v), 6) AS score FROM em q JOIN em b ON q.id % 50 = 0 AND (q.label >= 5 OR q.label = b.label))
      SELECT query_id, base_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS INT) AS rank FROM t QUALIFY rank <= 3""",
}

ORACLE |= {
    "compatible_before": f"""WITH {S}, k AS (SELECT DISTINCT record_id, start, "end" FROM s WHERE record_id IS NOT NULL AND start < "end") SELECT x.record_id, x.start, x."end", count(y.record_id) AS before FROM k x LEFT JOIN k y ON x.record_id = y.record_id AND y."end" <= x.start GROUP BY ALL""",
    "leave_family_out": f"""WITH v AS (SELECT item_id, {_family(SRC)} AS family, type FROM proposals WHERE item_id IS NOT NULL AND source IS NOT NULL AND type IS NOT NULL), f AS (SELECT item_id, family, min(type) AS label FROM v GROUP BY item_id, family HAVING min(type) = max(type)),
      s AS (SELECT family, -ln(count(*) OVER (PARTITION BY item_id, label) / (count(*) OVER (PARTITION BY item_id) - 1 + 6)) AS loss FROM f) SELECT family, count(*) AS n, round(avg(loss), 6) AS loss FROM s GROUP BY family""",
    "two_pass_review": f"""WITH p AS (SELECT item_id, {SRC} AS source, type FROM proposals WHERE item_id IS NOT NULL AND type IS NOT NULL), a AS (SELECT item_id, min(type) AS a FROM p WHERE source = 'nurse_a' GROUP BY item_id), b AS (SELECT item_id, min(type) AS b FROM p WHERE source = 'nurse_b' GROUP BY item_id)
      SELECT item_id, CASE WHEN a = b THEN a ELSE 'ABSTAIN' END AS decision, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) AS passes FROM (SELECT DISTINCT item_id FROM evidence WHERE item_id IS NOT NULL) LEFT JOIN a USING (item_id) LEFT JOIN b USING (item_id)""",
    "passage_mean_confidence": f"""WITH {S}, {LINES}, {GROUPS}, {OCC}, m AS (SELECT passage, avg(confidence) AS m, count(*) AS n FROM s JOIN o ON s.record_id = o.doc_id AND s.start >= o.start AND s."end" <= o."end" WHERE confidence IS NOT NULL AND s.start < s."end" GROUP BY passage) SELECT count(*) AS passages, sum(n)::BIGINT AS rows, round(avg(m), 6) AS mean FROM m""",
}
