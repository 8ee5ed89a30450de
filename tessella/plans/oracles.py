"""SQL of the queries over annotation lines: the grammar and the resolution of records, said once more in another language."""

from __future__ import annotations

from tessella.operators.records import ENTITY_LABELS, EVENT_LABELS, RELATION_LABELS, ROLES
from tessella.plans.scoring import _PRF

_LABEL = r"[^\s\p{Z}\x0b\x1c-\x1f\x{85}:;]+"
_SIDES = {"g": ("native_records", "record_id", "raw", "received_at"), "p": ("emissions", "emission_id", "payload", "emitted_at")}
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)


def _lines(x: str) -> str:
    """CTE ``{x}lines``: one row per row id, its latest delivery, with parts and first reason."""
    src, row_id, raw, stamp = _SIDES[x]
    native = x == "g"
    line = "CASE WHEN ends_with(t, chr(13)) THEN left(t, length(t) - 1) ELSE t END" if native else "t"
    declared = "CASE WHEN h IN ('T', 'R', 'E') THEN h ELSE 'AUX' END" if native else "coalesce(fam, CASE WHEN h IN ('T', 'R', 'E') THEN h ELSE 'AUX' END)"
    mismatch = "" if native else "WHEN fam IS NOT NULL AND fam <> k THEN 'declared_family_mismatch'"
    return rf"""
{x}0 AS (SELECT {row_id} AS row_id, doc_id AS doc, {stamp} AS stamp, {raw} AS b, {'NULL::VARCHAR' if native else 'family'} AS fam, try(decode({raw})) AS t, try(decode({raw}[1:1])) AS h FROM {src} WHERE {row_id} IS NOT NULL),
{x}1 AS (SELECT *, {line} AS l, {declared} AS declared FROM {x}0),
{x}2 AS (SELECT *, string_split(l, chr(9)) AS f, regexp_extract(l, '^([A-Z#][0-9]+|\*)\t', 1) AS id0 FROM {x}1),
{x}3 AS (SELECT *, CASE WHEN id0[1] IN ('T', 'R', 'E') THEN id0[1] ELSE 'AUX' END AS k, list_filter(string_split(f[2], ' '), lambda w: w <> '') AS tok, regexp_extract(f[2], '^({_LABEL}) ', 1) AS lab,
list_transform(string_split(substr(f[2], strpos(f[2], ' ') + 1), ';'), lambda s: list_filter(string_split(s, ' '), lambda w: w <> '')) AS seg FROM {x}2),
{x}4 AS (SELECT *, list_bool_and(list_transform(seg, lambda s: len(s) = 2 AND regexp_full_match(coalesce(s[1], ''), '-?[0-9]+') AND regexp_full_match(coalesce(s[2], ''), '-?[0-9]+'))) AS seg_ok FROM {x}3),
{x}5 AS (SELECT *, CASE WHEN seg_ok THEN list_transform(seg, lambda s: [CAST(s[1] AS DOUBLE), CAST(s[2] AS DOUBLE)]) END AS ab FROM {x}4),
{x}6 AS (SELECT s.*, coalesce(d.len, 0) AS len FROM {x}5 s LEFT JOIN (SELECT doc_id, max(length(text)) AS len FROM documents GROUP BY 1) d ON d.doc_id = s.doc),
{x}7 AS (SELECT *, CASE WHEN b IS NULL THEN 'invalid_record_header' WHEN t IS NULL THEN 'invalid_utf8' WHEN contains(l, chr(13)) OR contains(l, chr(10)) THEN 'embedded_line_break' WHEN id0 = '' THEN 'invalid_record_header'
{mismatch} WHEN k = 'AUX' THEN NULL
WHEN k = 'T' THEN CASE WHEN lab = '' THEN 'invalid_T_label' WHEN NOT seg_ok THEN 'invalid_segment_syntax' WHEN list_bool_or(list_transform(ab, lambda s: s[1] < 0 OR s[2] < s[1] OR s[2] > len)) THEN 'invalid_offset_range'
 WHEN list_bool_or(list_transform(ab, lambda s, i: list_bool_or(list_transform(ab, lambda o, j: j > i AND greatest(s[1], o[1]) < least(s[2], o[2]))))) THEN 'overlapping_segments' END
WHEN len(f) <> 2 THEN 'R_E_requires_two_tab_fields'
WHEN k = 'R' THEN CASE WHEN len(tok) <> 3 OR NOT regexp_full_match(tok[1], '{_LABEL}') THEN 'invalid_relation_syntax' WHEN NOT (contains(tok[2], ':') AND contains(tok[3], ':')) THEN 'invalid_relation_argument'
 WHEN list_sort([string_split(tok[2], ':')[1], string_split(tok[3], ':')[1]]) <> ['Arg1', 'Arg2'] THEN 'relation_requires_Arg1_Arg2_once'
 WHEN NOT (regexp_full_match(tok[2], 'Arg[12]:[TE][0-9]+') AND regexp_full_match(tok[3], 'Arg[12]:[TE][0-9]+')) THEN 'invalid_relation_endpoint_identifier' END
ELSE CASE WHEN len(tok) = 0 THEN 'missing_event_trigger' WHEN NOT regexp_full_match(tok[1], '{_LABEL}:T[0-9]+') THEN 'invalid_event_trigger'
 WHEN NOT coalesce(list_bool_and(list_transform(tok[2:], lambda r: regexp_full_match(r, '{_LABEL}:[TE][0-9]+'))), true) THEN 'invalid_event_role_endpoint' END END AS reason FROM {x}6),
{x}lines AS MATERIALIZED (SELECT row_id, doc, reason, CASE WHEN id0 = '' OR t IS NULL OR reason IN ('embedded_line_break', 'invalid_record_header') THEN NULL ELSE id0 END AS id,
CASE WHEN t IS NULL OR id0 = '' OR reason IN ('embedded_line_break', 'invalid_record_header', 'declared_family_mismatch') THEN declared ELSE k END AS kind,
CASE WHEN k = 'T' AND (reason IS NULL OR reason IN ('invalid_offset_range', 'overlapping_segments')) THEN lab WHEN reason IS NULL AND k = 'R' THEN tok[1] WHEN reason IS NULL AND k = 'E' THEN string_split(tok[1], ':')[1] END AS label,
CASE WHEN k = 'T' AND reason IS NULL THEN list_transform(ab, lambda s: [CAST(s[1] AS BIGINT), CAST(s[2] AS BIGINT)]) END AS segs,
CASE WHEN reason IS NULL AND k = 'R' THEN CASE WHEN starts_with(tok[2], 'Arg1') THEN substr(tok[2], 6) ELSE substr(tok[3], 6) END END AS arg1, CASE WHEN reason IS NULL AND k = 'R' THEN CASE WHEN starts_with(tok[2], 'Arg1') THEN substr(tok[3], 6) ELSE substr(tok[2], 6) END END AS arg2,
CASE WHEN reason IS NULL AND k = 'E' THEN string_split(tok[1], ':')[2] END AS trig, CASE WHEN reason IS NULL AND k = 'E' THEN tok[2:] ELSE [] END AS roles
FROM {x}7 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY stamp DESC NULLS LAST, reason IS NULL, reason) = 1)"""


def _resolved(x: str) -> str:
    """CTEs up to ``{x}``: records with their issue, after duplicates, vocabulary and dangling references."""
    gold = x == "g"
    vocabulary = f"""WHEN CASE kind WHEN 'T' THEN coalesce(label NOT IN ({_quoted(ENTITY_LABELS + EVENT_LABELS)}), true) WHEN 'R' THEN coalesce(label NOT IN ({_quoted(RELATION_LABELS)}), true) WHEN 'E' THEN coalesce(label NOT IN ({_quoted(EVENT_LABELS)}), true) ELSE false END THEN 'unsupported_prediction_label'
WHEN kind = 'E' AND coalesce(list_bool_or(list_transform(roles, lambda r: NOT regexp_full_match(string_split(r, ':')[1], '({'|'.join(ROLES)})[0-9]*'))), false) THEN 'unsupported_prediction_role'"""
    return f"""{_lines(x)},
{x}r AS MATERIALIZED (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN id <> '*' AND count(*) OVER (PARTITION BY doc, CASE WHEN id IS NULL OR id = '*' THEN '*' || row_id ELSE id END) > 1 THEN 'duplicate_identifier' {'' if gold else vocabulary} END AS issue0 FROM {x}lines),
{x}refs AS MATERIALIZED (SELECT doc, row_id, kind, id, unnest(CASE kind WHEN 'R' THEN [arg1, arg2] ELSE list_concat([trig], list_transform(roles, lambda r: string_split(r, ':')[2])) END) AS ref, CASE WHEN kind = 'E' THEN unnest(list_concat([NULL], list_transform(roles, lambda r: string_split(r, ':')[1]))) END AS role
FROM {x}r WHERE issue0 IS NULL AND kind IN ('R', 'E')),
{x}good AS MATERIALIZED (SELECT doc, id FROM {x}r WHERE issue0 IS NULL AND kind IN ('T', 'E')),
{x}fell AS (SELECT DISTINCT a.doc, a.row_id, a.kind, a.id FROM {x}refs a LEFT JOIN {x}good o ON o.doc = a.doc AND o.id = a.ref WHERE o.id IS NULL
UNION SELECT a.doc, a.row_id, a.kind, a.id FROM {x}refs a JOIN {x}fell v ON v.doc = a.doc AND v.id = a.ref AND v.kind = 'E'),
{x}gone AS MATERIALIZED (SELECT DISTINCT row_id AS gone FROM {x}fell),
{x} AS MATERIALIZED (SELECT r.*, CASE WHEN issue0 IS NULL AND gone IS NOT NULL THEN 'dangling_or_invalid_dependency' ELSE issue0 END AS issue FROM {x}r r LEFT JOIN {x}gone ON gone = row_id)"""


def _with(*sides: str) -> str:
    return "WITH RECURSIVE " + ",".join(_resolved(x) for x in sides)


#: A mention's label and segments in written order.
_KEY = "label || ' ' || array_to_string(list_transform(segs, lambda s: s[1] || '-' || s[2]), ';')"
#: Live references of gold records.
_EDGES = "live AS (SELECT a.doc, a.id, a.ref, a.role, a.kind FROM grefs a JOIN g USING (doc, row_id) WHERE g.issue IS NULL)"


def _ends(x: str) -> str:
    """CTE of the mention keys that ids stand for, events by their triggers."""
    return f"""{x}t AS (SELECT doc, id, {_KEY} AS key FROM {x} WHERE kind = 'T' AND issue IS NULL), {x}k AS (SELECT * FROM {x}t UNION ALL SELECT e.doc, e.id, t.key FROM {x} e JOIN {x}t t ON t.doc = e.doc AND t.id = e.trig WHERE e.kind = 'E' AND e.issue IS NULL),
{x}rel AS (SELECT r.label, r.doc, r.row_id, r.issue IS NULL AS ok, r.label || '|' || a.key || '|' || b.key AS key FROM {x} r LEFT JOIN {x}k a ON a.doc = r.doc AND a.id = r.arg1 AND r.issue IS NULL LEFT JOIN {x}k b ON b.doc = r.doc AND b.id = r.arg2 AND r.issue IS NULL WHERE r.kind = 'R')"""


_COUNTED = f"""SELECT {{by}}, tp, fp, fn, tp + fp AS prediction_count, tp + fn AS gold_count, {_PRF} FROM (SELECT {{by}}, CAST(sum(CASE WHEN ok THEN least(p, g) ELSE 0 END) AS BIGINT) tp, CAST(sum(p - CASE WHEN ok THEN least(p, g) ELSE 0 END) AS BIGINT) fp, CAST(sum(g - CASE WHEN ok THEN least(p, g) ELSE 0 END) AS BIGINT) fn
FROM (SELECT doc, {{by}}, key, ok, sum(p) p, sum(g) g FROM m GROUP BY ALL) GROUP BY {{by}})"""
_SEG = "s AS (SELECT row_id, doc, unnest(segs) AS s FROM glines WHERE kind = 'T' AND reason IS NULL)"

_CYCLES = f"""{_with('g')}, {_EDGES}""".replace("{", "{{").replace("}", "}}") + """, e AS ({edges}), reach AS (SELECT doc, a, b FROM e UNION SELECT r.doc, r.a, e.b FROM reach r JOIN e ON e.doc = r.doc AND e.a = r.b)
SELECT x.doc, x.a AS node, min(y.b) AS cycle FROM reach x JOIN reach y ON y.doc = x.doc AND y.a = x.a JOIN reach z ON z.doc = x.doc AND z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY ALL"""

QUERIES: dict = {}
SQL = {
    "p6_found": f"WITH {_lines('g')},{_lines('p')} SELECT 'native_records' AS src, row_id, reason FROM glines WHERE reason IS NOT NULL UNION ALL SELECT 'emissions', row_id, reason FROM plines WHERE reason IS NOT NULL",
    "resolved_records": f"{_with('p')} SELECT coalesce(issue, 'valid') AS outcome, CAST(count(*) AS BIGINT) n, CAST(count(DISTINCT doc) AS BIGINT) documents FROM p GROUP BY 1",
    "native_mention_scores": f"""{_with('g', 'p')}, m AS (SELECT doc, CASE WHEN label IN ({_quoted(ENTITY_LABELS + EVENT_LABELS)}) THEN label ELSE 'OTHER_NATIVE' END AS category, coalesce({_KEY}, label, '') AS key, ok, p, g
FROM (SELECT doc, label, segs, issue IS NULL AS ok, 1 AS p, 0 AS g FROM p WHERE kind = 'T' UNION ALL SELECT doc, label, segs, true, 0, 1 FROM g WHERE kind = 'T')) {_COUNTED.format(by='category')}""",
    "projected_relation_key": f"""{_with('g', 'p')}, {_ends('g')}, {_ends('p')}, m AS (SELECT doc, label, key, ok, 1 AS p, 0 AS g FROM prel UNION ALL SELECT doc, label, key, true, 0, 1 FROM grel) {_COUNTED.format(by='label')}""",
    "closure_reachability": f"""{_with('g')}, {_EDGES}, reach AS (SELECT DISTINCT doc, id AS root, id AS node FROM g WHERE kind IN ('R', 'E') AND issue IS NULL UNION SELECT r.doc, r.root, l.ref FROM reach r JOIN live l ON l.doc = r.doc AND l.id = r.node)
SELECT doc, root, CAST(count(*) AS BIGINT) nodes FROM reach GROUP BY ALL""",
    "schema_inventory": f"""{_with('g')} SELECT 'records' AS what, kind AS name, CAST(count(*) AS BIGINT) n FROM g GROUP BY kind UNION ALL SELECT 'labels', concat_ws(':', kind, label), count(*) FROM g WHERE issue IS NULL GROUP BY 2
UNION ALL SELECT 'roles', string_split(role, ':')[1], count(*) FROM (SELECT unnest(roles) AS role FROM g WHERE issue IS NULL AND kind = 'E') GROUP BY 2
UNION ALL SELECT 'excess', 'repeated_mentions', coalesce(sum(n - 1), 0) FROM (SELECT count(*) n FROM g WHERE issue IS NULL AND kind = 'T' GROUP BY doc, {_KEY})
UNION ALL SELECT 'excess', 'repeated_relations', coalesce(sum(n - 1), 0) FROM (SELECT count(*) n FROM g WHERE issue IS NULL AND kind = 'R' GROUP BY doc, label, arg1, arg2)
UNION ALL SELECT 'excess', 'further_labels_of_a_pair', coalesce(sum(n - 1), 0) FROM (SELECT count(DISTINCT label) n FROM g WHERE issue IS NULL AND kind = 'R' GROUP BY doc, arg1, arg2)
UNION ALL SELECT 'excess', 'further_events_of_a_trigger', coalesce(sum(n - 1), 0) FROM (SELECT count(*) n FROM g WHERE issue IS NULL AND kind = 'E' GROUP BY doc, trig)""",
    "motif_chains": f"{_with('g')} SELECT a.doc, CAST(count(*) AS BIGINT) chains FROM g a JOIN g b ON a.doc = b.doc AND a.arg2 = b.arg1 AND a.issue IS NULL AND b.issue IS NULL AND a.label = 'Equivalent' AND b.label = 'Condition' AND a.kind = 'R' AND b.kind = 'R' GROUP BY 1",
    "reference_mismatches": f"""WITH {_lines('g')}, u AS (SELECT record_id, max(string_split(regexp_replace(decode(raw), '\r$', ''), chr(9))[3]) AS surface FROM native_records WHERE record_id IN (SELECT row_id FROM glines WHERE kind = 'T' AND reason IS NULL) AND try(decode(raw)) IS NOT NULL GROUP BY 1),
r AS (SELECT u.surface, array_to_string(list_transform(segs, lambda s: substr(text, CAST(s[1] + 1 AS BIGINT), CAST(s[2] - s[1] AS BIGINT))), ' ') AS ref FROM glines l JOIN u ON u.record_id = l.row_id LEFT JOIN documents d ON d.doc_id = l.doc WHERE kind = 'T' AND reason IS NULL)
SELECT CASE WHEN surface IS NULL THEN 'missing_reference_text' WHEN surface = ref THEN 'equal' ELSE 'reference_text_mismatch' END AS state, CAST(count(*) AS BIGINT) n FROM r GROUP BY 1""",
    "signature_warnings": f"""{_with('g', 'p')}, gs AS (SELECT DISTINCT r.label, a.label AS ta, b.label AS tb FROM g r JOIN g a ON a.doc = r.doc AND a.id = r.arg1 AND a.kind = 'T' AND a.issue IS NULL JOIN g b ON b.doc = r.doc AND b.id = r.arg2 AND b.kind = 'T' AND b.issue IS NULL WHERE r.kind = 'R' AND r.issue IS NULL),
ps AS (SELECT r.label, a.label AS ta, b.label AS tb FROM p r JOIN p a ON a.doc = r.doc AND a.id = r.arg1 AND a.kind = 'T' AND a.issue IS NULL JOIN p b ON b.doc = r.doc AND b.id = r.arg2 AND b.kind = 'T' AND b.issue IS NULL WHERE r.kind = 'R' AND r.issue IS NULL)
SELECT label, ta AS arg1_type, tb AS arg2_type, CAST(count(*) AS BIGINT) n FROM ps WHERE NOT EXISTS (SELECT 1 FROM gs WHERE gs.label = ps.label AND gs.ta = ps.ta AND gs.tb = ps.tb) GROUP BY ALL""",
    "nested_cycles": _CYCLES.format(edges="SELECT DISTINCT doc, id AS a, ref AS b FROM live WHERE kind = 'E' AND role IS NOT NULL"),
    "relation_cycles": _CYCLES.format(edges="SELECT DISTINCT doc, arg1 AS a, arg2 AS b FROM g WHERE kind = 'R' AND issue IS NULL"),
    "interval_overlap_pairs": f"""WITH {_lines('g')}, {_SEG}, w AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 7)) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc AS doc_id, CAST(count(*) AS BIGINT) AS "overlaps", CAST(sum(least(s[2], b + 7) - greatest(s[1], b)) AS BIGINT) shared FROM s JOIN w ON doc_id = doc AND s[1] < b + 7 AND s[2] > b GROUP BY 1""",
    "endpoint_forms": f"""WITH {_lines('g')}, {_SEG}, f AS (SELECT s[1] AS a, s[2] AS b, text, substr(text, s[1] + 1, s[2] - s[1]) AS quote FROM s JOIN documents ON doc_id = doc WHERE s[2] > s[1]),
o AS (SELECT *, len(list_filter(range(0, a), lambda i: substr(text, i + 1, b - a) = quote)) AS k FROM f) SELECT CAST(count(*) AS BIGINT) segments, CAST(count(*) FILTER (text IS NOT NULL) AS BIGINT) same, CAST(max(k) AS BIGINT) most FROM o""",
    "span_supervision": f"""WITH {_lines('g')}, d AS (SELECT doc_id, CAST(floor((length(text) - 1) / 10) AS BIGINT) + 1 AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, i * 10 AS begin, j * 10 + 10 AS fin FROM (SELECT doc_id, n, unnest(range(n)) AS i FROM d) x, LATERAL (SELECT unnest(range(i, least(i + 32, n))) AS j)),
t AS (SELECT doc AS doc_id, CASE WHEN len(segs) = 1 THEN CAST(floor(segs[1][1] / 10) * 10 AS BIGINT) END AS begin, CASE WHEN len(segs) = 1 THEN CAST(ceil(segs[1][2] / 10) * 10 AS BIGINT) END AS fin, label FROM glines WHERE kind = 'T' AND reason IS NULL),
l AS (SELECT doc_id, begin, fin, min(label) AS label FROM t GROUP BY ALL) SELECT coalesce(l.label, 'NONE') AS label, CAST(count(*) AS BIGINT) n FROM c LEFT JOIN l USING (doc_id, begin, fin) GROUP BY 1
UNION ALL SELECT 'UNREACHED', CAST(count(*) AS BIGINT) FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.begin = t.begin AND c.fin = t.fin)""",
    "token_alignment": f"""WITH {_lines('g')}, {_SEG}, w AS (SELECT doc_id, t, t * 7 AS b FROM (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 7) AS BIGINT))) AS t FROM documents WHERE length(text) > 0)),
n AS (SELECT row_number() OVER () AS span, doc, s FROM s), h AS (SELECT n.doc, n.span, w.t, c FROM n JOIN w ON w.doc_id = n.doc AND s[1] < b + 7 AND s[2] > b, LATERAL (SELECT unnest(range(0, t + 1, 40)) AS c) WHERE t < c + 60),
x AS (SELECT *, count(*) OVER (PARTITION BY doc, span, c) AS pieces FROM h), k AS (SELECT doc, span, count(DISTINCT c) AS chunks FROM h GROUP BY ALL)
SELECT doc AS doc_id, CAST(count(*) AS BIGINT) AS rows, round(sum(1.0::DOUBLE / (pieces * chunks)), 6) AS spans FROM x JOIN k USING (doc, span) GROUP BY 1""",
    "cue_positions": r"""WITH d AS (SELECT doc_id, text, unnest(range(0, length(text))) AS i FROM documents WHERE regexp_matches(text, '[0-9] (K|MPa|%)')), m AS (SELECT doc_id, i, regexp_extract(substr(text, i + 1), '^\d+(?:\.\d+)? (?:K|MPa|%)') AS literal FROM d WHERE regexp_matches(substr(text, i + 1, 1), '\d'))
SELECT doc_id, CAST(i AS INT) AS begin, CAST(i + length(literal) AS INT) AS "end", literal FROM m WHERE literal <> ''""",
    "json_faults": """WITH s AS (SELECT CASE WHEN props IS NULL THEN 'sound' ELSE CASE event_id % 11 WHEN 3 THEN 'malformed' WHEN 5 THEN 'duplicate_key' WHEN 7 THEN 'not_finite' ELSE 'sound' END END AS state FROM events) SELECT state, CAST(count(*) AS BIGINT) n FROM s GROUP BY 1""",
}
