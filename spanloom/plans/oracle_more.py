"""SQL, after that of ``oracle``, for the scope of assertions, one-to-one choices and scores."""

from __future__ import annotations

from spanloom.operators import scope
from spanloom.plans.oracle import BC, EDGES, GROUPS, JACCARD, KEYS, LINES, MEETS, OCC, PASSAGE_ENTITIES, PHRASE, RECALL, S, _hash

EMPTY = "CAST([] AS VARCHAR[])"


def _words(c: str) -> str:
    return rf"""(' ' || trim(regexp_replace(regexp_replace(lower({c}), '([,:;(.-])', ' \1 ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) || ' ')"""


def _in(phrases: list[str]) -> str:
    return "(" + "|".join(phrases) + ")"


def _assertions() -> str:
    turn = f"^.* ([.;]|{'|'.join(scope.TURNS)}) "
    now = " OR ".join(f"contains(right(low, {scope.NOW_REACH + len(x)}), '{x}')" for x in scope.NOW)
    return rf"""WITH {S}, k AS (SELECT DISTINCT record_id, start, "end", type FROM s WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL),
      a AS (SELECT k.*, substr(text, 1, start) AS before, substr(text, start + 1, "end" - start) AS mention, substr(text, "end" + 1) AS after FROM k JOIN documents ON doc_id = record_id WHERE start >= 0 AND start < "end" AND "end" <= length(text)),
      b AS (SELECT *, lower(before) AS low, regexp_replace(before, '(?s)^.*\n', '') AS lb FROM a),
      c AS (SELECT *, regexp_replace(low, '(?s)^.*[.!?;\n]', '') || lower(mention) || regexp_extract(lower(after), '^[^.!?;\n]*') AS sentence,
        regexp_replace(low, '(?s)^.*\n', '') || lower(mention) || regexp_extract(lower(after), '^[^\n]*') AS line,
        regexp_extract(chr(10) || before, '(?s)^.*\n[ \t\r\f]*(\d+)\.[ \t]*([^\n]*).*$', 1) AS number, lower(regexp_extract(chr(10) || before, '(?s)^.*\n[ \t\r\f]*(\d+)\.[ \t]*([^\n]*).*$', 2)) AS heading FROM b),
      d AS (SELECT *, regexp_matches(sentence, '{_in(scope.PAST)}') AND NOT regexp_matches(sentence, '{_in(scope.NOW)}') AS p1, regexp_matches(line, '{_in(scope.PAST)}') OR regexp_matches(right(low, {scope.PAST_REACH}), '{_in(scope.PAST)}') AS p2,
        regexp_matches(line, '{_in(scope.NOW)}') OR {now} AS nw, regexp_matches(number, '^0*1$') AND contains(heading, 'tiền sử') AND NOT contains(heading, 'hiện tại') AS sect,
        type = 'TRIỆU_CHỨNG' AND regexp_matches(sentence, 'điều trị\s+[^.]{{0,50}}\Q' || replace(lower(mention), '\E', '') || '\E') AS taken FROM c),
      e AS (SELECT *, ((CASE WHEN type IN ('CHẨN_ĐOÁN', 'THUỐC') THEN (p1 OR p2) AND NOT nw ELSE p1 END) OR sect) AND NOT taken AS past,
        regexp_matches({_words('lb')}, '{_in(scope.OF_FAMILY)}') OR (NOT regexp_matches({_words('lb')}, '{_in(scope.TOLD)}') AND regexp_matches({_words(f'right(lb, {scope.RELATIVE_REACH})')}, ' {_in(scope.RELATIVES)}( {_in(scope.RELATIVE_HAS)})? $')) AS fam,
        (regexp_matches(regexp_replace({_words(f'right(lb, {scope.NO_REACH})')}, '{turn}', ' '), ' {_in(scope.NO)} $') AND regexp_matches(lb, '[ \t\r\n\f]$')) OR regexp_matches(regexp_replace({_words('mention')}, ' {_in(scope.NOT_NO)} ', ' ', 'g'), '^ {_in(scope.NO_WITHIN)} ') AS neg FROM d)
      SELECT record_id, start, "end", type, CASE WHEN type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC') THEN list_filter([CASE WHEN past THEN 'isHistorical' END, CASE WHEN fam THEN 'isFamily' END, CASE WHEN neg THEN 'isNegated' END], lambda x: x IS NOT NULL) ELSE {EMPTY} END AS assertions FROM e"""


def taken(rows: str, columns: list[str], conflict: str) -> str:
    """Rounds of a choice in order ``n`` within ``g``: what no better open row conflicts with is taken, what conflicts with it goes."""
    c = ", ".join(columns)
    x = ", ".join(f"x.{k}" for k in columns)
    return f"""rounds AS (SELECT {c}, false AS taken FROM {rows} UNION ALL (WITH open AS (SELECT * FROM rounds WHERE NOT taken),
        held AS (SELECT DISTINCT x.g, x.n FROM open x JOIN open y ON x.g = y.g AND y.n < x.n AND {conflict}), top AS (SELECT * FROM open ANTI JOIN held USING (g, n)),
        gone AS (SELECT DISTINCT x.g, x.n FROM open x JOIN top y ON x.g = y.g AND y.n < x.n AND {conflict}), rest AS (SELECT * FROM open ANTI JOIN gone USING (g, n))
        SELECT {x}, top.n IS NOT NULL AS taken FROM rest x LEFT JOIN top ON x.g = top.g AND x.n = top.n))"""


GREEDY = f"""WITH RECURSIVE {S}, k AS (SELECT record_id, start, "end", type, confidence FROM s WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL AND confidence IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY record_id, start, "end" ORDER BY confidence DESC, type) = 1),
      rk AS (SELECT record_id AS g, row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, start - "end", start, type) AS n, start, "end", type, confidence FROM k),
      {taken('rk', ['g', 'n', 'start', '"end"', 'type', 'confidence'], 'x.start < y."end" AND y.start < x."end"')}
      SELECT g AS record_id, start, "end", type, confidence FROM rounds WHERE taken"""

ALIGN = f"""{BC}, tk AS (SELECT DISTINCT record_id, start, "end", type FROM b WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL), fk AS (SELECT DISTINCT record_id, start, "end", type FROM c WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL),
      pr AS (SELECT x.record_id, x.type, x.start AS ts, x."end" AS te, y.start AS fs, y."end" AS fe, least(x."end", y."end") - greatest(x.start, y.start) AS ov, greatest(x."end" - x.start, y."end" - y.start) AS lg FROM tk x JOIN fk y ON {MEETS} AND x.type = y.type),
      rk AS (SELECT (record_id, type) AS g, row_number() OVER (PARTITION BY record_id, type ORDER BY (ts <> fs OR te <> fe), -(ov / lg), -ov, -ts, -te, -fs, -fe) AS n, ts, te, fs, fe FROM pr),
      {taken('rk', ['g', 'n', 'ts', 'te', 'fs', 'fe'], '((x.ts = y.ts AND x.te = y.te) OR (x.fs = y.fs AND x.fe = y.fe))')},
      ch AS (SELECT g[1] AS record_id, g[2] AS type, ts, te, fs, fe FROM rounds WHERE taken),
      al AS (SELECT tk.record_id, tk.type, tk.start AS t_start, tk."end" AS t_end, ch.fs AS f_start, ch.fe AS f_end FROM tk LEFT JOIN ch ON tk.record_id = ch.record_id AND tk.type = ch.type AND tk.start = ch.ts AND tk."end" = ch.te
        UNION ALL SELECT fk.record_id, fk.type, NULL, NULL, fk.start, fk."end" FROM fk ANTI JOIN ch ON fk.record_id = ch.record_id AND fk.type = ch.type AND fk.start = ch.fs AND fk."end" = ch.fe)"""


def word_distance(a: str, b: str) -> str:
    """Edit distance of two lists of words: each word as one sign."""
    all_ = f"list_distinct(list_concat({a}, {b}))"
    sign = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(CAST(32 + list_position({all_}, w) AS INT))), '')"
    return f"levenshtein({sign(a)}, {sign(b)})"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \t\r\n\f]+'), lambda x: x <> '')"


def _details(rows: str) -> str:
    flat = lambda c: f"list_sort(list_distinct(coalesce({c}, {EMPTY})))"
    return f"""SELECT record_id, start, "end", type, first((coalesce(text, ''), {flat('assertions')}, {flat('candidates')}) ORDER BY coalesce(text, ''), {flat('assertions')}, {flat('candidates')}) AS z
      FROM {rows} WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL GROUP BY record_id, start, "end", type"""


SCORES = f"""{ALIGN}, dt AS ({_details('b')}), df AS ({_details('c')}),
      sp AS (SELECT al.record_id, al.type, {words('dt.z[1]')} AS wa, {words('df.z[1]')} AS wb, coalesce(dt.z[2], {EMPTY}) AS aa, coalesce(df.z[2], {EMPTY}) AS ab, coalesce(dt.z[3], {EMPTY}) AS ca, coalesce(df.z[3], {EMPTY}) AS cb, al.t_start IS NOT NULL AND al.f_start IS NOT NULL AS m FROM al
        LEFT JOIN dt ON al.record_id = dt.record_id AND al.type = dt.type AND al.t_start = dt.start AND al.t_end = dt."end" LEFT JOIN df ON al.record_id = df.record_id AND al.type = df.type AND al.f_start = df.start AND al.f_end = df."end"),
      sc AS (SELECT record_id, round(CASE WHEN NOT m THEN 0 WHEN len(wa) > 0 THEN 1 - {word_distance('wa', 'wb')} / len(wa) WHEN len(wb) = 0 THEN 1 ELSE 0 END, 6) AS t,
        CASE WHEN type IN ('TRIỆU_CHỨNG', 'CHẨN_ĐOÁN', 'THUỐC') THEN CASE WHEN NOT m THEN 0 ELSE {JACCARD.replace('x', 'aa').replace('y)', 'ab)')} END END AS a,
        CASE WHEN type IN ('CHẨN_ĐOÁN', 'THUỐC') THEN CASE WHEN NOT m THEN 0 ELSE {JACCARD.replace('x', 'ca').replace('y)', 'cb)')} END END AS c, CASE WHEN type IN ('CHẨN_ĐOÁN', 'THUỐC') THEN len(ca) + 1 END AS w FROM sp),
      re AS (SELECT record_id, count(*) AS pairs, round(coalesce(avg(t), 1), 6) AS text, round(coalesce(avg(a), 1), 6) AS assertions, round(coalesce(sum(c * w) / sum(w), 1), 6) AS candidates, sum(c * w) AS cs, sum(w) AS cw FROM sc GROUP BY record_id),
      co AS (SELECT count(*) AS records, avg(text) AS t, avg(assertions) AS a, coalesce(sum(cs) / sum(cw), 1) AS c FROM re),
      fi AS (SELECT records, round(t, 4) AS text, round(a, 4) AS assertions, round(c, 4) AS candidates, round(0.3 * t + 0.3 * a + 0.4 * c, 4) AS final FROM co)"""


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{85}}]')"
RATE = f"CASE WHEN len(wt) > 0 THEN {word_distance('wt', 'wf')} / len(wt) WHEN len(wf) = 0 THEN 0 ELSE 1 END"
PAIRS = f"""{BC}, dt AS ({_details('b')}), df AS ({_details('c')}),
      gt AS (SELECT *, row_number() OVER (PARTITION BY record_id, type ORDER BY start, "end") AS n FROM dt), gf AS (SELECT *, row_number() OVER (PARTITION BY record_id, type ORDER BY start, "end") AS m FROM df),
      co AS (SELECT g, n, m, x, CASE WHEN x THEN 0 ELSE {RATE} END AS r, d FROM (SELECT (gt.record_id, gt.type) AS g, n, m, gt.start = gf.start AND gt."end" = gf."end" AS x, {TOKENS.format('gt.z[1]')} AS wt, {TOKENS.format('gf.z[1]')} AS wf, abs(gt.start - gf.start) AS d FROM gt JOIN gf USING (record_id, type))),
      st AS (SELECT (record_id, type) AS g, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS took, count(*) AS many FROM gt GROUP BY record_id, type
        UNION ALL SELECT st.g, st.n + 1, list_append(any_value(used), min_by(m, (NOT x, r, d, m))), min_by(m, (NOT x, r, d, m)), any_value(many) FROM st LEFT JOIN co ON co.g = st.g AND co.n = st.n + 1 AND NOT list_contains(used, co.m) WHERE st.n < many GROUP BY st.g, st.n),
      ta AS (SELECT g[1] AS record_id, g[2] AS type, n, took AS m FROM st WHERE n > 0),
      pe AS (SELECT gt.record_id, gt.type, gt.start AS t_start, gt."end" AS t_end, gf.start AS f_start, gf."end" AS f_end FROM gt JOIN ta USING (record_id, type, n) LEFT JOIN gf ON gf.record_id = ta.record_id AND gf.type = ta.type AND gf.m = ta.m
        UNION ALL SELECT gf.record_id, gf.type, NULL, NULL, gf.start, gf."end" FROM gf ANTI JOIN ta ON gf.record_id = ta.record_id AND gf.type = ta.type AND gf.m = ta.m)"""
INTERNAL = f"""{PAIRS}, ip AS (SELECT pe.record_id, {TOKENS.format("coalesce(dt.z[1], '')")} AS wt, {TOKENS.format("coalesce(df.z[1], '')")} AS wf, coalesce(dt.z[2], {EMPTY}) AS aa, coalesce(df.z[2], {EMPTY}) AS ab, coalesce(dt.z[3], {EMPTY}) AS ca, coalesce(df.z[3], {EMPTY}) AS cb,
        pe.t_start IS NOT NULL AND pe.f_start IS NOT NULL AS k FROM pe LEFT JOIN dt ON pe.record_id = dt.record_id AND pe.type = dt.type AND pe.t_start = dt.start AND pe.t_end = dt."end" LEFT JOIN df ON pe.record_id = df.record_id AND pe.type = df.type AND pe.f_start = df.start AND pe.f_end = df."end"),
      iv AS (SELECT record_id, CASE WHEN k THEN greatest(1 - {RATE}, 0) ELSE 0 END AS t, CASE WHEN k THEN {JACCARD.replace('x', 'aa').replace('y)', 'ab)')} ELSE 0 END AS a, CASE WHEN k THEN {JACCARD.replace('x', 'ca').replace('y)', 'cb)')} ELSE 0 END AS c, len(ca) + 1 AS w FROM ip),
      rs AS (SELECT record_id, pairs, round(t, 6) AS text, round(a, 6) AS assertions, round(c, 6) AS candidates, round(0.3 * t + 0.3 * a + 0.4 * c, 6) AS final FROM (SELECT record_id, count(*) AS pairs, avg(t) AS t, avg(a) AS a, sum(c * w) / sum(w) AS c FROM iv GROUP BY record_id))"""


def _compatible(c: str) -> str:
    """Compatibility forms of single characters, by the Unicode tables, and small letters."""
    import unicodedata

    one, more = {}, {}
    for x in map(chr, (*range(0xA0, 0x2500), 0x3000, *range(0xFF01, 0xFFEF))):
        to = unicodedata.normalize("NFKC", x).casefold()
        if x != to and not unicodedata.combining(x) and x != "'":
            (one if len(to) == 1 else more)[x] = " " if to.isspace() else to
    text = lambda xs: "".join(xs).replace("'", "''")
    out = f"translate({c}, '{text(one)}', '{text(one.values())}')"
    for x in "½¼¾ß…™":
        out = f"replace({out}, '{x}', '{more[x]}')"
    return f"lower({out})"


TOKEN = r"""cu AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\r\n\f]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[ \t\r\n\f]'), 1) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
      pl AS (SELECT doc_id, piece, CAST(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INT) - 1 AS stop FROM cu), tk AS (SELECT doc_id AS record_id, CAST(stop - length(piece) AS INT) AS start, stop AS "end" FROM pl WHERE piece <> '')"""


def _labels(entities: str, out: str) -> str:
    return f"""{out}e AS (SELECT DISTINCT record_id, start, "end", type FROM {entities} WHERE record_id IS NOT NULL AND start < "end" AND type IS NOT NULL),
      {out}h AS (SELECT x.record_id, x.start, x."end", min((y."end" - y.start, y.start, y.type)) AS e FROM tk x JOIN {out}e y ON {MEETS} GROUP BY ALL),
      {out}l AS (SELECT record_id, start, "end", CASE WHEN e IS NULL THEN 'O' WHEN e = lag(e) OVER (PARTITION BY record_id ORDER BY start, "end") THEN 'I-' || e[3] ELSE 'B-' || e[3] END AS label FROM tk LEFT JOIN {out}h USING (record_id, start, "end"))"""


SOURCES = ("rule", "lex_core", "tok_alpha", "llm_wide")
DECODE = f"""WITH {S}, {TOKEN}, {', '.join(f"s{i} AS (SELECT * FROM s WHERE source = '{x}'), {_labels(f's{i}', f'w{i}')}" for i, x in enumerate(SOURCES))},
      sc AS ({' UNION ALL '.join(f'SELECT * FROM w{i}l' for i in range(4))}), me AS (SELECT record_id, start, "end", label, sum(CASE WHEN label = 'O' THEN 0.25::DOUBLE ELSE 1 END) / 4 AS p FROM sc GROUP BY ALL),
      be AS (SELECT record_id, start, "end", first(label ORDER BY p DESC, label) AS label, max(p) AS p FROM me GROUP BY record_id, start, "end"),
      ty AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS type FROM be),
      la AS (SELECT *, lag("end") OVER w AS last, lag(type) OVER w AS was FROM ty WINDOW w AS (PARTITION BY record_id ORDER BY start, "end")),
      fr AS (SELECT la.*, CASE WHEN starts_with(label, 'B-') OR type IS DISTINCT FROM was OR coalesce(regexp_matches(substr(text, last + 1, start - last), '[\n.!?;]'), false) THEN 1 ELSE 0 END AS fresh FROM la JOIN documents ON doc_id = record_id),
      ru AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM fr)
      SELECT record_id, min(start) AS start, max("end") AS "end", type, round(avg(p), 6) AS confidence FROM ru WHERE type IS NOT NULL GROUP BY record_id, run, type"""
NAMES = f"nm AS (SELECT identifier AS code, unnest(list_concat([canonical], coalesce(aliases, {EMPTY}))) AS name FROM nodes)"
HIST = "record_id IS NOT NULL AND start IS NOT NULL AND \"end\" IS NOT NULL AND type IS NOT NULL AND text IS NOT NULL AND list_contains(assertions, 'isHistorical')"

ORACLE = {
    "graph_manifest": f"""WITH {EDGES}, x AS (SELECT 'node ' || ontology AS part, sha256(identifier || chr(31) || coalesce(canonical, '')) AS h FROM nodes UNION ALL SELECT 'edge ' || relation, sha256(source || chr(31) || target) FROM ed)
      SELECT part, count(*) AS n, CAST(sum(CAST(('0x' || substr(h, 1, 8)) AS BIGINT)) AS VARCHAR) AS digest FROM x GROUP BY part""",
    "graph_union": """WITH x AS (SELECT identifier, ontology, 0 AS graph FROM nodes WHERE ontology = 'WHO_ICD10_2019' UNION ALL SELECT identifier, ontology, 1 FROM nodes WHERE ontology <> 'WHO_ICD10_2019' UNION ALL SELECT identifier, ontology, 2 FROM nodes WHERE length(identifier) = 3),
      n AS (SELECT identifier, count(DISTINCT graph) AS graphs FROM x GROUP BY identifier) SELECT identifier, ontology, graph, 1 AS graphs FROM x JOIN n USING (identifier) WHERE graphs = 1 UNION ALL SELECT identifier, NULL, NULL, graphs FROM n WHERE graphs > 1""",
    "drug_codes": rf"""WITH {S}, m AS (SELECT DISTINCT lower(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS mention FROM s WHERE text IS NOT NULL AND type = 'THUỐC'),
      n AS (SELECT lower(trim(regexp_replace(unnest(list_concat([canonical], coalesce(aliases, {EMPTY}))), '[ \t\r\n\f]+', ' ', 'g'))) AS name, identifier AS code, semantic_type AS tty FROM nodes WHERE ontology <> 'WHO_ICD10_2019'),
      w AS (SELECT mention, regexp_extract_all(mention, '[a-z0-9''-]+') AS w FROM m), a AS (SELECT mention, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT DISTINCT mention, array_to_string(w[i : i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM a)),
      b AS (SELECT mention, last(code ORDER BY length(name), CASE tty WHEN 'IN' THEN 4 WHEN 'PIN' THEN 3 WHEN 'MIN' THEN 2 WHEN 'BN' THEN 1 ELSE 0 END, name, code, tty) AS code FROM g JOIN n ON run = name WHERE code IS NOT NULL AND tty IS NOT NULL GROUP BY mention),
      p AS (SELECT mention, ' ' || regexp_replace(mention, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS x, regexp_matches(mention, '\d\s*(mcg|mg|ml|g)([^\p{{L}}\p{{N}}_]|$)') AS dose FROM m)
      SELECT mention, CASE WHEN dose AND regexp_matches(x, ' iv | (tiem|inject)|tinh mach| po | uong|oral') THEN NULL ELSE code END AS code, CASE WHEN code IS NOT NULL AND NOT (dose AND regexp_matches(x, ' iv | (tiem|inject)|tinh mach| po | uong|oral')) THEN 'name' END AS stage FROM p LEFT JOIN b USING (mention)""",
    "span_choice_counts": rf"""WITH {S}, j AS (SELECT span_id, substr(d.text, 1, start) AS b, substr(d.text, start + 1, "end" - start) AS x, substr(d.text, "end" + 1) AS a FROM (SELECT span_id, record_id, start, "end" FROM s WHERE record_id IS NOT NULL AND start < "end") JOIN documents d ON doc_id = record_id WHERE start >= 0 AND "end" <= length(d.text)),
      l AS (SELECT span_id, x, regexp_replace(b, '(?s)^.*\n', '') AS b, regexp_extract(a, '^[^\n]*') AS a FROM j),
      c AS (SELECT span_id, x, CASE WHEN regexp_matches(x, '^[^ \t]') THEN regexp_replace(b, '[^ \t]+$', '') ELSE b END AS b, CASE WHEN regexp_matches(x, '[^ \t]$') THEN regexp_replace(a, '^[^ \t]+', '') ELSE a END AS a FROM l),
      n AS (SELECT span_id, len(list_filter(regexp_split_to_array(x, '[ \t]+'), lambda w: w <> '')) AS o, least(4, len(list_filter(regexp_split_to_array(b, '[ \t]+'), lambda w: w <> ''))) AS p, least(4, len(list_filter(regexp_split_to_array(a, '[ \t]+'), lambda w: w <> ''))) AS q FROM c),
      f AS (SELECT span_id, list_filter(flatten(list_transform(range(p + 1), lambda i: list_transform(range(q + 1), lambda k: i + k + o))), lambda v: v <= 10) AS v FROM n WHERE o > 0) SELECT span_id, len(v) AS choices, coalesce(list_max(v), 0) AS widest FROM f""",
    "seen_recall": f"""WITH {RECALL}, f AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS fold, label IN (SELECT label FROM embeddings WHERE vec_id % 3 = 2 AND label <= 6) AS known FROM rt),
      s AS (SELECT *, 'all' AS status FROM f UNION ALL SELECT *, CASE WHEN known THEN 'seen' ELSE 'unseen' END FROM f)
      SELECT fold, status, count(*) AS queries, round(avg(list_contains(top[1:1], label)::INT), 6) AS recall_1, round(avg(list_contains(top[1:5], label)::INT), 6) AS recall_5, round(avg(list_contains(top[1:10], label)::INT), 6) AS recall_10 FROM s GROUP BY fold, status""",
    "weak_links": f"""WITH {S}, k AS (SELECT record_id, start, "end", text, type, unnest(list_distinct(candidates)) AS code FROM s WHERE type IN ('CHẨN_ĐOÁN', 'THUỐC') AND text IS NOT NULL AND len(candidates) > 0),
      c AS (SELECT record_id, start, "end", text, type, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM k WHERE code IN (SELECT identifier FROM nodes) GROUP BY ALL),
      j AS (SELECT c.type, {PHRASE.replace('text', 'c.text')} AS mention, codes, record_id, start, c.text, substr(d.text, greatest(start - 40, 0) + 1, least(start, 40)) || '⟦' || c.text || '⟧' || substr(d.text, "end" + 1, 40) AS context
        FROM c JOIN documents d ON doc_id = record_id WHERE start >= 0 AND start < "end" AND substr(d.text, start + 1, "end" - start) = c.text),
      n AS (SELECT *, row_number() OVER (PARTITION BY type, mention, codes ORDER BY record_id, start, text) AS n FROM j)
      SELECT type, mention, codes, count(*) AS uses, count(DISTINCT record_id) AS records, string_agg(context, ' ¦ ' ORDER BY n) FILTER (n <= 3) AS contexts,
      CASE {_hash('mention')} % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS fold FROM n GROUP BY type, mention, codes""",
    "resolution_changes": f"""WITH {S}, {NAMES}, l AS (SELECT {PHRASE.replace('text', 'name')} AS key, list_sort(list_distinct(list(code))) AS found FROM nm WHERE name IS NOT NULL AND code IS NOT NULL GROUP BY 1),
      x AS (SELECT type, {PHRASE} AS key, list_sort(list_distinct(list_filter(coalesce(candidates, {EMPTY}), lambda x: x IS NOT NULL))) AS had FROM s WHERE type IN ('CHẨN_ĐOÁN', 'THUỐC') AND text IS NOT NULL), y AS (SELECT type, had, coalesce(found, {EMPTY}) AS found FROM x LEFT JOIN l USING (key))
      SELECT type, CASE WHEN had = found THEN 'same' WHEN len(had) = 0 THEN 'gained' WHEN len(found) = 0 THEN 'lost' ELSE 'changed' END AS change, count(*) AS n FROM y GROUP BY 1, 2""",
    "bio_labels": f"""WITH {BC}, {TOKEN}, {_labels('c', 'z')} SELECT record_id, start, "end", label FROM zl""",
    "bio_decode": DECODE,
    "outermost_spans": f"""WITH {BC}, {KEYS} SELECT * FROM ck x WHERE NOT EXISTS (SELECT 1 FROM ck y WHERE x.record_id = y.record_id AND x.type <> y.type AND y.start <= x.start AND x."end" <= y."end" AND y."end" - y.start > x."end" - x.start)""",
    "passage_coverage": f"""WITH {S}, {LINES}, {GROUPS}, {OCC}, {PASSAGE_ENTITIES}, n AS (SELECT passage, count(DISTINCT doc_id) AS occurrences FROM o GROUP BY passage), h AS (SELECT DISTINCT passage, record_id, start, "end", type FROM ent),
      e AS (SELECT passage, count(*) AS present, count(DISTINCT (start, "end", type)) AS entities FROM h GROUP BY passage) SELECT passage, occurrences, entities, present, occurrences * entities - present AS missing FROM n JOIN e USING (passage)""",
    "assertion_additions": f"""WITH {BC}, x AS (SELECT DISTINCT record_id, start, "end", type, text FROM c WHERE {HIST}), y AS (SELECT DISTINCT record_id, start, "end", type FROM b WHERE {HIST}), z AS (SELECT * FROM x ANTI JOIN y USING (record_id, start, "end", type)),
      k AS (SELECT CASE WHEN type = 'THUỐC' THEN 'drug' WHEN regexp_matches(text, '[0-9]') THEN 'number' WHEN len(string_split(text, ' ')) > 3 THEN 'long' ELSE 'other' END AS category, lower(text) AS e FROM z),
      f AS (SELECT DISTINCT category, e FROM k QUALIFY dense_rank() OVER (PARTITION BY category ORDER BY e) <= 5) SELECT category, n, examples FROM (SELECT category, count(*) AS n FROM k GROUP BY category) JOIN (SELECT category, string_agg(e, '|' ORDER BY e) AS examples FROM f GROUP BY category) USING (category)""",
    "relation_census": f"""WITH {BC}, {KEYS}, j AS (SELECT x.record_id, x.start, x."end", x.type, bool_or(x.type = y.type AND y.start <= x.start AND x."end" <= y."end") AS i, bool_or(x.type = y.type AND x.start <= y.start AND y."end" <= x."end") AS a, bool_or(x.type = y.type) AS e, count(y.record_id) AS n
      FROM ck x LEFT JOIN bk y ON {MEETS} GROUP BY ALL) SELECT type, CASE WHEN n = 0 THEN 'disjoint' WHEN i THEN 'contained_same_type' WHEN a THEN 'contains_same_type' WHEN NOT e THEN 'cross_type' ELSE 'partial_same_type' END AS relation, count(*) AS n FROM j GROUP BY 1, 2""",
    "control_pool": f"""WITH {BC}, u AS (SELECT record_id, start, "end", type, count(DISTINCT source) AS support FROM s WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source) >= 2),
      p AS (SELECT DISTINCT u.*, concat_ws(':', record_id, start, "end", type) AS k FROM u JOIN b USING (record_id, start, "end", type)) SELECT record_id, start, "end", type, support, CAST(row_number() OVER (PARTITION BY type ORDER BY {_hash("'control'", 'k')}, k) AS INT) AS place FROM p QUALIFY place <= 12""",
    "ordered_union": f"""WITH {BC}, x AS (SELECT record_id, start, "end", type, min(candidates) AS a FROM b WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL AND len(candidates) > 0 GROUP BY ALL),
      y AS (SELECT record_id, start, "end", type, min(candidates) AS c FROM c WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND type IS NOT NULL AND len(candidates) > 0 GROUP BY ALL),
      j AS (SELECT record_id, start, "end", type, list_filter(list_concat(coalesce(a, {EMPTY}), coalesce(c, {EMPTY})), lambda v: v IS NOT NULL) AS l FROM x FULL JOIN y USING (record_id, start, "end", type))
      SELECT record_id, start, "end", type, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS codes FROM j""",
    "normalize_keys": rf"""WITH {S} SELECT DISTINCT text, trim(regexp_replace(strip_accents({_compatible('text')}), '\s+', ' ', 'g')) AS key FROM s WHERE text IS NOT NULL""",
    "context_assertions": _assertions(),
    "greedy_non_overlap": GREEDY,
    "align_entities": f"WITH RECURSIVE {ALIGN} SELECT record_id, type, t_start, t_end, f_start, f_end FROM al",
    "score_records": f"WITH RECURSIVE {SCORES} SELECT record_id, pairs, text, assertions, candidates FROM re",
    "score_corpus": f"WITH RECURSIVE {SCORES} SELECT * FROM fi",
    "promotion_gates": f"""WITH RECURSIVE {SCORES}, g AS (SELECT unnest(['records', 'final', 'assertions']) AS gate, unnest([records >= 10, final >= 0.5, assertions >= 0.2]) AS passed FROM fi) SELECT gate, passed, bool_and(passed) OVER () AS all_passed FROM g""",
    "pair_entities": f"WITH RECURSIVE {PAIRS} SELECT * FROM pe",
    "internal_scores": f"WITH RECURSIVE {INTERNAL} SELECT * FROM rs",
    "internal_macro": f"""WITH RECURSIVE {INTERNAL} SELECT count(*) AS records, round(avg(coalesce(text, 1)), 4) AS text, round(avg(coalesce(assertions, 1)), 4) AS assertions, round(avg(coalesce(candidates, 1)), 4) AS candidates, round(avg(coalesce(final, 1)), 4) AS final
      FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN rs ON doc_id = record_id""",
    "word_edit_distance": f"""WITH e AS (SELECT DISTINCT item_id, record_id, type, text FROM evidence WHERE text IS NOT NULL), p AS (SELECT DISTINCT record AS record_id, type, text AS other FROM pu_rows WHERE text IS NOT NULL),
      j AS (SELECT DISTINCT item_id, text, other, {words('text')} AS a, {words('other')} AS b FROM e JOIN p USING (record_id, type)) SELECT item_id, text, other, {word_distance('a', 'b')} AS distance FROM j""",
    "trimmed_spans": rf"""WITH {S}, j AS (SELECT span_id, start AS a, "end" AS b, text AS t FROM (SELECT span_id, record_id, start, "end" FROM s WHERE record_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL) JOIN (SELECT doc_id, text FROM documents) ON doc_id = record_id WHERE 0 <= start AND start < "end" AND "end" <= length(text)),
      w AS (SELECT span_id, t, CASE WHEN regexp_matches(substr(t, a + 1, 1), '[\p{{L}}\p{{N}}]') THEN a - length(regexp_extract(substr(t, 1, a), '[\p{{L}}\p{{N}}]*$')) ELSE a END AS a, CASE WHEN regexp_matches(substr(t, b, 1), '[\p{{L}}\p{{N}}]') THEN b + length(regexp_extract(substr(t, b + 1), '^[\p{{L}}\p{{N}}]*')) ELSE b END AS b FROM j),
      x AS (SELECT span_id, a + length(regexp_extract(substr(t, a + 1, b - a), '^[^\p{{L}}\p{{N}}]*')) AS start, b - length(regexp_extract(substr(t, a + 1, b - a), '[^\p{{L}}\p{{N}}]*$')) AS "end" FROM w)
      SELECT span_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM x WHERE start < "end" """,
}
