"""DuckDB counterparts of the registered queries, written from the definitions.

Correlation is spelled out naively here: all pairs within the window, a recursive
walk for the components, sums over pairs for the cohesion.
"""

from __future__ import annotations

import inspect

from alertloom import schema
from alertloom.functions import text
from alertloom.plans import registry as R
from alertloom.sources import faults as gt, logs, testbed

W_US = R.WINDOW * 1_000_000
GAP_US = R.GAP * 1_000_000
SPAN_US = R.SPAN * 1_000_000
SLACK_US = schema.FAULT_TOLERANCE_SEC * 1_000_000


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


SPACE = f"({chars(text.UNICODE_SPACE)})"
ASCII_SPACE = f"({chars(text.ASCII_SPACE)})"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def any_word(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def storage_severity(logged: str, message: str) -> str:
    return (
        f"CASE WHEN {logged} IN ('ERROR', 'FATAL', 'WARN') THEN {logged}"
        f" WHEN {any_word(message, text.STORAGE_ERROR_WORDS)} THEN 'ERROR'"
        f" WHEN {any_word(message, text.STORAGE_WARN_WORDS)} THEN 'WARN' ELSE 'INFO' END"
    )


def text_severity(x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN {any_word(low, text.TEXT_ERROR_WORDS)} THEN 'ERROR'"
        f" WHEN {any_word(low, text.TEXT_WARN_WORDS)} THEN 'WARN' ELSE 'INFO' END"
    )


def normalize_severity(x: str) -> str:
    word = strip(f"upper({x})")
    cases = " ".join(
        f"WHEN {word} IN ({', '.join(quote(s) for s in spellings)}) THEN {quote(level)}"
        for level, spellings in text.SEVERITY_SPELLINGS.items()
    )
    return f"CASE {cases} ELSE 'INFO' END"


def clean(x: str) -> str:
    """The templating rules. RE2 has no look-around: digits next to letters are masked instead."""
    rules = dict((placeholder, pattern) for pattern, placeholder in text.TEMPLATE_RULES)
    for placeholder in ("<BLOCK>", "<IP>", "<CHANNEL>", "<HASH>", "<PATH>"):
        x = f"regexp_replace({x}, {quote(rules[placeholder])}, '{placeholder}', 'g')"
    for letters, pattern, placeholder in (("a-zA-Z", "-?[0-9]{8,}", "<ID>"), ("a-zA-Z_", "[0-9]+", "<NUM>")):
        plain = "0123456789-"
        for k, c in enumerate(plain):
            x = f"regexp_replace({x}, '([{letters}]){c}', '\\1' || chr({0xE000 + k}), 'g')"
        for k, c in enumerate(plain[:-1]):
            x = f"regexp_replace({x}, '{c}([{letters}])', chr({0xE000 + k}) || '\\1', 'g')"
        x = f"regexp_replace({x}, '{pattern}', '{placeholder}', 'g')"
        x = f"translate({x}, {' || '.join(f'chr({0xE000 + k})' for k in range(len(plain)))}, '{plain}')"
    return f"trim(regexp_replace({x}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), {ASCII_SPACE})"


def base(x: str) -> str:
    return f"regexp_replace({x}, '-[0-9]+$', '')"


def rank(x: str) -> str:
    return f"CASE {x} WHEN 'FATAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END"


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '…' ELSE {x} END"


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round(100.0::DOUBLE * {part} / {whole}, 1) END"


def fill(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN 'unknown' ELSE {x} END"


NO_LINE = "'  at frame ' || event_id"
BODY = """CASE event_type
    WHEN 'error' THEN 'Exception in receiveBlock for block blk_' || event_id
    WHEN 'click' THEN 'Unexpected packet for blk_' || event_id || ' from 10.0.' || (user_id % 256) || '.7:50010'
    WHEN 'signup' THEN 'Received block blk_' || event_id || ' of size ' || user_id || ' from 10.0.' || (user_id % 256) || '.7:50010'
    WHEN 'purchase' THEN 'Connection reset by 10.0.' || (user_id % 256) || '.7:50010'
    ELSE 'Verification succeeded for blk_' || event_id END"""
SERVICE = "'svc' || (user_id % 12) || '-' || (event_id % 3)"
SOME_SERVICE = f"CASE WHEN event_id % 7 <> 0 THEN {SERVICE} END"
EPOCH = "CASE WHEN value >= 150 THEN 'n/a' WHEN value >= 120 THEN '' ELSE (epoch_us(ts) // 1000000)::VARCHAR END"
KINDS = "[" + ", ".join(quote(k) for k in [*gt.FAILURE_TYPES, "unlisted fault"]) + "]"
FAILURE_EN = (
    "CASE failure_type " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in gt.FAILURE_TYPES.items())
    + " ELSE failure_type END"
)


def group(pattern: str, i: int) -> str:
    return f"regexp_extract(value, {quote(pattern)}, {i})"


def whole(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, '^\\s*([+-]?\\d+)\\s*$', 1) AS BIGINT)"


def ts_of_seconds(x: str) -> str:
    return f"make_timestamp({x} * 1000000)"


# Common table expressions, in an order in which each needs only those above it.
CTES: dict[str, str] = {}

CTES["alerts"] = f"""
    SELECT event_id AS alert_id, ts, epoch_us(ts) AS ts_us,
        CASE user_id % 3 WHEN 0 THEN 'hdfs' WHEN 1 THEN 'spark' ELSE 'aiops' END AS source,
        {SERVICE} AS service,
        CASE WHEN event_type = 'error' AND value >= 150 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
             WHEN event_type IN ('signup', 'purchase') THEN 'WARN' ELSE 'INFO' END AS severity,
        event_type || ' failed for blk_' || event_id || ' at 10.0.' || (user_id % 256) || '.7:50010 ' || props AS message,
        user_id % (SELECT count(*) FROM embeddings) AS vec_id
    FROM events"""
CTES["severe"] = "SELECT * FROM alerts WHERE severity IN ('WARN', 'ERROR', 'FATAL')"
CTES["cleaned"] = f"SELECT *, {clean('message')} AS cleaned_message, {base('service')} AS base FROM severe"
CTES["storage_lines"] = f"""
    SELECT CASE WHEN value >= 100 THEN {NO_LINE}
        WHEN value >= 80 THEN strftime(ts, '%y') || '13' || substring(line, 5) ELSE line END AS value
    FROM (SELECT *, strftime(ts, '%y%m%d %H%M%S') || ' ' || user_id || ' '
            || CASE event_type WHEN 'view' THEN 'WARN' ELSE 'INFO' END || ' dfs.node' || (user_id % 12) || ': ' || {BODY} AS line
          FROM events)"""
CTES["spark_lines"] = f"""
    SELECT CASE WHEN value >= 100 THEN {NO_LINE}
        ELSE strftime(ts, '%y/%m/%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' ELSE 'INFO' END
            || ' executor.Node' || (user_id % 12) || ': ' || {BODY} END AS value
    FROM events"""
CTES["storage_parsed"] = f"""
    SELECT try_strptime({group(logs.STORAGE_LINE, 1)} || ' ' || {group(logs.STORAGE_LINE, 2)}, '%y%m%d %H%M%S') AS ts,
        'hdfs' AS source, {group(logs.STORAGE_LINE, 5)} AS service,
        {storage_severity(group(logs.STORAGE_LINE, 4), group(logs.STORAGE_LINE, 6))} AS severity,
        {group(logs.STORAGE_LINE, 6)} AS message, '' AS event_id, value AS raw_line
    FROM storage_lines WHERE regexp_matches(value, {quote(logs.STORAGE_LINE)})"""
CTES["spark_parsed"] = f"""
    SELECT try_strptime({group(logs.SPARK_LINE, 1)} || ' ' || {group(logs.SPARK_LINE, 2)}, '%y/%m/%d %H:%M:%S') AS ts,
        'spark' AS source, {group(logs.SPARK_LINE, 4)} AS service, {group(logs.SPARK_LINE, 3)} AS severity,
        {group(logs.SPARK_LINE, 5)} AS message, '' AS event_id, value AS raw_line
    FROM spark_lines WHERE regexp_matches(value, {quote(logs.SPARK_LINE)})"""
CTES["service_raw"] = f"""
    SELECT 'e' || event_id AS log_id, {EPOCH} AS stamp, {SERVICE} AS cmdb_id,
        CASE WHEN event_type = 'view' THEN {BODY}
             ELSE 'severity: ' || CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'Warning'
                WHEN 'click' THEN 'finest' ELSE 'notice' END || ', message:  ' || {BODY} || ' ' END AS value
    FROM events
    UNION ALL
    SELECT 'd' || doc_id, (1704067200 + doc_id * 60)::VARCHAR, source || '-' || (doc_id % 3), text FROM documents"""
CTES["service_graded"] = f"""
    SELECT {ts_of_seconds(whole('stamp'))} AS ts, 'aiops' AS source, cmdb_id AS service,
        CASE WHEN field <> '' THEN {normalize_severity('field')} ELSE {text_severity('value')} END AS severity,
        CASE WHEN length(m) > 500 THEN substring(m, 1, 497) || '...' ELSE m END AS message,
        log_id AS event_id, substring(value, 1, 200) AS raw_line
    FROM (SELECT *, CASE WHEN field = '' THEN {strip('value')}
                WHEN regexp_matches(value, {quote(testbed.MESSAGE_FIELD)}) THEN {strip(group(testbed.MESSAGE_FIELD, 1))}
                ELSE value END AS m
          FROM (SELECT *, {group(testbed.SEVERITY_FIELD, 1)} AS field FROM service_raw WHERE stamp <> ''))"""
CTES["gateway_graded"] = f"""
    SELECT {ts_of_seconds(whole('stamp'))} AS ts, 'aiops' AS source, coalesce(cmdb_id, 'unknown') AS service,
        CASE WHEN code >= 500 THEN 'ERROR' ELSE 'WARN' END AS severity,
        'HTTP ' || code || ' on ' || coalesce(cmdb_id, '') || ': ' || substring(value, 1, 150) AS message,
        log_id AS event_id, substring(value, 1, 200) AS raw_line
    FROM (SELECT *, TRY_CAST({group(testbed.GATEWAY_STATUS, 1)} AS INTEGER) AS code
          FROM (SELECT 'g' || event_id AS log_id, {EPOCH} AS stamp, {SOME_SERVICE} AS cmdb_id,
                    CASE WHEN event_type = 'click' THEN 'connection opened 200'
                    ELSE '"POST /shop.' || event_type || '/Get HTTP/2" ' || CASE event_type WHEN 'error' THEN (500 + user_id % 4)::VARCHAR
                        WHEN 'signup' THEN '404' WHEN 'purchase' THEN '301' ELSE '200' END || ' - via_upstream ' || props END AS value
                FROM events)
          WHERE stamp <> '')
    WHERE code >= 400"""
CTES["span_graded"] = f"""
    SELECT make_timestamp({whole('stamp')} * 1000) AS ts, 'aiops' AS source, CASE WHEN cmdb_id = '' THEN 'unknown' ELSE cmdb_id END AS service,
        CASE WHEN code <> 0 THEN 'ERROR' ELSE 'WARN' END AS severity,
        CASE WHEN code <> 0 THEN 'Span error (code=' || code || ') on ' || op || ' [' || cmdb_id || '] duration=' || took || 'ms trace=' || substring(trace_id, 1, 16)
             ELSE 'Slow span (' || took || 'ms) on ' || op || ' [' || cmdb_id || '] trace=' || substring(trace_id, 1, 16) END AS message,
        span_id AS event_id,
        'trace=' || trace_id || ' span=' || span_id || ' op=' || op || ' status=' || code || ' dur=' || took AS raw_line
    FROM (SELECT CASE WHEN value >= 150 THEN 'n/a' ELSE (epoch_us(ts) // 1000)::VARCHAR END AS stamp,
                coalesce({SOME_SERVICE}, '') AS cmdb_id, CASE WHEN event_id % 13 <> 0 THEN 's' || event_id ELSE '' END AS span_id,
                CASE WHEN event_id % 17 <> 0 THEN md5(event_id::VARCHAR) ELSE '' END AS trace_id,
                CASE WHEN event_id % 11 <> 0 THEN 'shop/' || event_type ELSE '' END AS op,
                CASE event_type WHEN 'error' THEN user_id % 3 WHEN 'view' THEN NULL ELSE 0 END AS code, floor(value * 100)::BIGINT AS took
          FROM events)
    WHERE code <> 0 OR took > {schema.SLOW_SPAN} AND code IS NOT NULL"""
CTES["fault_csv"] = f"""
    SELECT epoch_us(ts) // 1000000 AS timestamp_epoch,
        CASE user_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'service' ELSE 'pod' END AS level,
        CASE WHEN user_id % 3 = 0 THEN 'node-' || (user_id % 6) ELSE {SERVICE} END AS cmdb_id,
        {KINDS}[event_id % 16 + 1] AS failure_type, 'faults.csv' AS source_file, 0 AS folder, event_id AS place
    FROM events WHERE event_type NOT IN ('view', 'purchase')"""
CTES["fault_json"] = f"""
    SELECT timestamp_epoch, CASE WHEN i = 1 THEN 'pod' ELSE level END AS level, cmdb_id, failure_type,
        'faults.json' AS source_file, 2 AS folder, event_id * 2 + i AS place
    FROM (SELECT event_id, epoch_us(ts) // 1000000 AS timestamp_epoch,
            CASE user_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'service' ELSE 'pod' END AS level,
            CASE WHEN user_id % 3 = 0 THEN 'node-' || (user_id % 6) ELSE {SERVICE} END AS cmdb_id,
            {KINDS}[event_id % 16 + 1] AS failure_type, unnest([0, 1]) AS i
          FROM events WHERE event_type IN ('view', 'purchase'))"""
CTES["truth"] = f"""
    SELECT make_timestamp(timestamp_epoch * 1000000) AS ts, timestamp_epoch, level, cmdb_id, failure_type,
        {FAILURE_EN} AS failure_type_en, source_file
    FROM (SELECT * FROM fault_csv UNION ALL SELECT * FROM fault_json)
    QUALIFY row_number() OVER (PARTITION BY timestamp_epoch, cmdb_id, failure_type ORDER BY folder, place) = 1"""
CTES["faults"] = """
    SELECT *, timestamp_epoch || '|' || cmdb_id || '|' || failure_type AS fault_id, timestamp_epoch * 1000000 AS ts_us FROM truth"""
CTES["sims"] = """
    SELECT a.vec_id AS va, b.vec_id AS vb,
        CASE WHEN a.vec_id = b.vec_id THEN 1.0::DOUBLE ELSE list_dot_product(a.u, b.u) / (sqrt(list_dot_product(a.u, a.u)) * sqrt(list_dot_product(b.u, b.u))) END AS sim
    FROM (SELECT vec_id, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id IN (SELECT vec_id FROM cleaned)) a,
         (SELECT vec_id, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id IN (SELECT vec_id FROM cleaned)) b"""


def pairs(window_us: int | str, condition: str) -> str:
    return f"""
    SELECT a.alert_id AS src, b.alert_id AS dst, b.vec_id AS vec_b, b.ts_us AS dst_us, a.base AS base_a, b.base AS base_b, s.sim
    FROM cleaned a JOIN cleaned b ON b.ts_us BETWEEN a.ts_us AND a.ts_us + {window_us}
        AND (b.ts_us, b.alert_id) > (a.ts_us, a.alert_id)
    JOIN sims s ON s.va = a.vec_id AND s.vb = b.vec_id
    WHERE {condition}"""


def walk(pairs_cte: str, extra: str = "") -> str:
    """Every alert with the smallest alert it can reach over `pairs_cte`."""
    return f"""
    SELECT alert_id, min(reached) AS component_id FROM (
        SELECT alert_id, alert_id AS reached FROM cleaned
        UNION ALL SELECT node, reached FROM {pairs_cte}) GROUP BY alert_id"""


def reach(pairs_cte: str) -> str:
    return f"""
    SELECT src AS node, src AS reached FROM {pairs_cte}
    UNION SELECT dst, dst FROM {pairs_cte}
    UNION
    SELECT e.y, r.reached FROM r_{pairs_cte} r JOIN (
        SELECT src AS x, dst AS y FROM {pairs_cte} UNION ALL SELECT dst, src FROM {pairs_cte}) e ON e.x = r.node
    WHERE r.reached < e.y"""


CTES["pairs"] = pairs(W_US, f"s.sim >= {R.THRESHOLD}")
CTES["r_pairs"] = reach("pairs")
CTES["labels"] = walk("r_pairs")
CTES["cross_pairs"] = pairs(
    W_US, f"s.sim >= CASE WHEN a.base = b.base THEN {R.THRESHOLD} ELSE {R.CROSS} END"
)
CTES["r_cross_pairs"] = reach("cross_pairs")
CTES["cross_labels"] = walk("r_cross_pairs")
CTES["labelled"] = "SELECT * FROM cleaned JOIN labels USING (alert_id)"
CTES["gapped"] = f"""
    SELECT *, sum(cut) OVER w - 1 AS gap_no FROM (
        SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {GAP_US} THEN 0 ELSE 1 END AS cut FROM labelled
        WINDOW w AS (PARTITION BY component_id ORDER BY ts_us, alert_id))
    WINDOW w AS (PARTITION BY component_id ORDER BY ts_us, alert_id)"""
CTES["cross_gapped"] = CTES["gapped"].replace("FROM labelled", "FROM (SELECT * FROM cleaned JOIN cross_labels USING (alert_id))")


def spanned(gapped: str) -> None:
    """Greedy cuts: each segment starts at the first alert that the one before it does not hold."""
    CTES[f"t_{gapped}"] = f"SELECT DISTINCT component_id, gap_no, ts_us FROM {gapped}"
    CTES[f"n_{gapped}"] = f"""
    SELECT a.component_id, a.gap_no, a.ts_us, min(b.ts_us) AS next_us FROM t_{gapped} a JOIN t_{gapped} b
        ON a.component_id = b.component_id AND a.gap_no = b.gap_no AND b.ts_us > a.ts_us + {SPAN_US} GROUP BY ALL"""
    CTES[f"begins_{gapped}"] = f"""
    SELECT component_id, gap_no, min(ts_us) AS begin_us FROM t_{gapped} GROUP BY ALL
    UNION ALL
    SELECT r.component_id, r.gap_no, n.next_us FROM begins_{gapped} r JOIN n_{gapped} n
        ON r.component_id = n.component_id AND r.gap_no = n.gap_no AND r.begin_us = n.ts_us"""
    CTES[gapped.replace("gapped", "spanned")] = f"""
    SELECT g.*, dense_rank() OVER (PARTITION BY g.component_id, g.gap_no ORDER BY r.begin_us) - 1 AS span_no
    FROM {gapped} g ASOF JOIN begins_{gapped} r ON g.component_id = r.component_id AND g.gap_no = r.gap_no AND g.ts_us >= r.begin_us"""


spanned("gapped")
spanned("cross_gapped")
CTES["cross_labelled"] = """
    SELECT * EXCLUDE (component_id), min(alert_id) OVER (PARTITION BY component_id, gap_no, span_no) AS component_id
    FROM cross_spanned"""


def members(labelled: str) -> str:
    return f"""
    SELECT l.*, 0.45::DOUBLE / (1.0::DOUBLE + (l.ts_us - start_us) / 1e6 / 60.0::DOUBLE) + 0.30::DOUBLE * ({rank('l.severity')}) / 4.0::DOUBLE
            + 0.25::DOUBLE * cohesion AS score
    FROM (
        SELECT m.*, min(ts_us) OVER w AS start_us, max(ts_us) OVER w AS end_us, count(*) OVER w AS members,
            coalesce(c.cohesion, 1.0::DOUBLE) AS cohesion
        FROM {labelled} m LEFT JOIN (
            SELECT x.alert_id, avg(s.sim) AS cohesion FROM {labelled} x JOIN {labelled} y
                ON x.component_id = y.component_id AND x.alert_id <> y.alert_id
            JOIN sims s ON s.va = x.vec_id AND s.vb = y.vec_id GROUP BY 1) c USING (alert_id)
        WINDOW w AS (PARTITION BY component_id)) l"""


def incidents(members_cte: str) -> str:
    title = clip("body", 60)
    return f"""
    SELECT *, member_count - 1 AS suppressed_count, make_timestamp(start_us) AS span_start, make_timestamp(end_us) AS span_end,
        CASE WHEN confidence >= {schema.CONFIDENCE_FLOOR} AND member_count >= {schema.MIN_INCIDENT_SIZE} THEN 'confirmed' ELSE 'needs_review' END AS status,
        CASE WHEN root_service <> '' AND root_service <> 'unknown' THEN root_service || ': ' || {title} ELSE {title} END AS title,
        row_number() OVER (ORDER BY start_us, component_id) AS incident_no,
        'inc_' || CASE WHEN row_number() OVER (ORDER BY start_us, component_id) < 1000
            THEN lpad((row_number() OVER (ORDER BY start_us, component_id))::VARCHAR, 3, '0')
            ELSE (row_number() OVER (ORDER BY start_us, component_id))::VARCHAR END AS incident_id
    FROM (
        SELECT component_id, alert_id AS root_alert_id, ts AS root_ts, source AS root_source, service AS root_service,
            severity AS root_severity, message AS root_message, {strip('cleaned_message')} AS body,
            round(cohesion, 3) AS confidence, start_us, end_us, members AS member_count
        FROM {members_cte}
        QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY round(score, 9) DESC, ts_us, alert_id) = 1)"""


TOP = """
    SELECT *, round(score / sum(score) OVER (PARTITION BY component_id), 3) AS share FROM (
        SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY round(score, 9) DESC, ts_us, alert_id) AS rn FROM {})
    WHERE rn <= 3"""
CTES["members"] = members("labelled")
CTES["top3"] = TOP.format("members")
CTES["incidents"] = incidents("members")
CTES["services"] = "SELECT component_id, list_sort(list(DISTINCT service)) AS services FROM labelled GROUP BY 1"
CTES["cross_members"] = members("cross_labelled")
CTES["cross_incidents"] = incidents("cross_members")
CTES["cross_services"] = "SELECT component_id, list(DISTINCT service) AS services FROM cross_labelled GROUP BY 1"


def matched(incidents_cte: str, services_cte: str) -> str:
    hit = f"len(list_filter(services, lambda s: contains(s, cmdb_id) OR contains(s, {base('cmdb_id')}))) > 0"
    return f"""
    SELECT f.*, m.incident_id IS NOT NULL AS detected, coalesce(m.hit, false) AS localized,
        coalesce(contains(m.root_service, f.cmdb_id) OR contains(m.root_service, {base('f.cmdb_id')}), false) AS root_localized,
        m.incident_id AS matched_incident, m.root_service AS matched_root_service, m.member_count AS matched_cluster_size
    FROM faults f LEFT JOIN (
        SELECT fault_id, incident_id, root_service, member_count, hit FROM (
            SELECT fault_id, i.*, {hit} AS hit, abs(f.ts_us - (start_us + end_us) / 2.0::DOUBLE) / 1e6 AS dist
            FROM faults f JOIN (SELECT * FROM {incidents_cte} JOIN {services_cte} USING (component_id)) i
                ON f.ts_us BETWEEN i.start_us - {SLACK_US} AND i.end_us + {SLACK_US})
        QUALIFY row_number() OVER (PARTITION BY fault_id ORDER BY CASE WHEN hit THEN dist ELSE dist + 100000 END, incident_no) = 1
    ) m USING (fault_id)"""


CTES["matched"] = matched("cross_incidents", "cross_services")

# Texts to vectors: the same statements run over event alerts alone, and over events and documents.
CTES["text_alerts"] = f"""
    SELECT alert_id, ts, ts_us, source, service, severity, message, cleaned_message, base FROM cleaned
    UNION ALL
    SELECT -1 - doc_id, make_timestamp((doc_id * 60 + 1704067200) * 1000000), (doc_id * 60 + 1704067200) * 1000000, 'aiops',
        source || '-' || (doc_id % 3), 'WARN', text, {clean('text')}, {base("source || '-' || (doc_id % 3)")} FROM documents"""


def tagged(alerts_cte: str) -> str:
    name = f"{base('service')}"
    return f"""
    SELECT * EXCLUDE (tagged), tagged, md5(tagged) AS text_id FROM (
        SELECT *, CASE WHEN {name} IN ('', 'unknown') THEN cleaned_message ELSE {name} || ': ' || cleaned_message END AS tagged
        FROM {alerts_cte})"""


DIM = "('0x' || substr(md5(word), 1, 8))::BIGINT % 384"


def terms(tagged_cte: str) -> str:
    """(text_id, dim, x): weights of unit length."""
    return f"""
    SELECT text_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS x FROM (
        SELECT text_id, dim, n * (1 + ln((total + 1) / (count(*) OVER (PARTITION BY dim) + 1))) AS w FROM (
            SELECT text_id, {DIM} AS dim, count(*)::DOUBLE AS n
            FROM (SELECT DISTINCT text_id, tagged FROM {tagged_cte}), unnest(string_split(lower(tagged), ' ')) AS t(word)
            WHERE word <> '' GROUP BY 1, 2), (SELECT count(DISTINCT text_id) AS total FROM {tagged_cte}))"""


CTES["event_tagged"] = tagged("cleaned")
CTES["event_terms"] = terms("event_tagged")
CTES["text_tagged"] = tagged("text_alerts")
CTES["text_terms"] = terms("text_tagged")
CTES["text_sims"] = """
    SELECT va, vb, CASE WHEN va = vb THEN 1.0::DOUBLE ELSE sim END AS sim FROM (
        SELECT a.text_id AS va, b.text_id AS vb, sum(a.x * b.x) AS sim FROM text_terms a JOIN text_terms b USING (dim) GROUP BY 1, 2)"""
CTES["text_pairs"] = f"""
    SELECT a.alert_id AS src, b.alert_id AS dst FROM text_tagged a JOIN text_tagged b
        ON b.ts_us BETWEEN a.ts_us AND a.ts_us + {R.TEXT_WINDOW * 1_000_000} AND (b.ts_us, b.alert_id) > (a.ts_us, a.alert_id)
    JOIN text_sims s ON s.va = a.text_id AND s.vb = b.text_id WHERE s.sim >= {R.TEXT_THRESHOLD}"""
CTES["r_text_pairs"] = reach("text_pairs")
CTES["text_labels"] = walk("r_text_pairs").replace("FROM cleaned", "FROM text_alerts")
CTES["text_labelled"] = "SELECT * FROM text_tagged JOIN text_labels USING (alert_id)"
CTES["text_members"] = members("text_labelled").replace("JOIN sims", "JOIN text_sims").replace("x.vec_id", "x.text_id").replace("y.vec_id", "y.text_id")
CTES["text_incidents"] = incidents("text_members")

# Templates of a stream: a text's weights are those of the slice of time that it first appears in.
CTES["live_tagged"] = tagged("cleaned")
CTES["live_first"] = f"""
    SELECT text_id, tagged, min(slice) AS slice FROM (
        SELECT t.*, least(floor((t.ts_us / 1e6 - lo) * {R.SLICES} / greatest(hi - lo, 1.0)), {R.SLICES - 1}) AS slice
        FROM live_tagged t, (SELECT min(epoch_us(ts)) / 1e6 AS lo, max(epoch_us(ts)) / 1e6 AS hi FROM events)) GROUP BY ALL"""
CTES["live_words"] = f"""
    SELECT text_id, slice, {DIM} AS dim, count(*) AS n FROM (SELECT text_id, slice, unnest(string_split(lower(tagged), ' ')) AS word FROM live_first)
    WHERE word <> '' GROUP BY ALL"""
CTES["live_held"] = """
    SELECT s.slice, w.dim, count(*) AS df FROM (SELECT DISTINCT slice FROM live_first) s JOIN live_words w ON w.slice <= s.slice GROUP BY ALL"""
CTES["live_texts"] = """
    SELECT s.slice, count(*) AS texts FROM (SELECT DISTINCT slice FROM live_first) s JOIN live_first f ON f.slice <= s.slice GROUP BY ALL"""
CTES["live_terms"] = """
    SELECT text_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS x FROM (
        SELECT text_id, w.dim, n * (1 + ln((texts + 1.0::DOUBLE) / (df + 1))) AS w
        FROM live_words w JOIN live_held USING (slice, dim) JOIN live_texts USING (slice))"""
CTES["live_sims"] = CTES["text_sims"].replace("text_terms", "live_terms")
CTES["live_pairs"] = CTES["text_pairs"].replace("text_tagged", "live_tagged").replace("text_sims", "live_sims").replace(str(R.TEXT_THRESHOLD), str(R.LIVE_THRESHOLD))
CTES["r_live_pairs"] = reach("live_pairs")
CTES["live_labels"] = walk("r_live_pairs")

RECURSIVE = {"r_pairs", "r_cross_pairs"}
COUNTERS = """count(*) AS total, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE detected AND localized) AS service_matched_detected,
    count(*) FILTER (WHERE localized) AS localized, count(*) FILTER (WHERE root_localized) AS root_localized"""
PARSED = "ts, source, service, severity, message, event_id, raw_line"
LIGHT = ", ".join(
    "incident_id title root_alert_id root_ts root_service root_severity root_message confidence span_start span_end"
    " suppressed_count member_count status".split()
)


def with_ctes(body: str, extra: dict[str, str] | None = None, needed_extra: tuple[str, ...] = ()) -> str:
    """Prefix the statement with the table expressions it names, directly or not."""
    import re

    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+\(?\s*{name}\b", sql):
                needed.add(name)
                visit(known[name])

    visit(body)
    if not needed:
        return body
    parts = [
        f"{name}(node, reached) AS ({sql})"
        if name in RECURSIVE or name.startswith("r_")
        else f"{name} AS {'' if name.startswith('begins_') else 'MATERIALIZED '}({sql})"
        for name, sql in known.items()
        if name in needed
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def sweep() -> str:
    extra: dict[str, str] = {}
    selects = []
    for s, window, threshold in R.SWEEP:
        extra[f"pairs{s}"] = pairs(window * 1_000_000, f"s.sim >= {threshold}")
        extra[f"r_pairs{s}"] = reach(f"pairs{s}")
        extra[f"labels{s}"] = walk(f"r_pairs{s}")
        extra[f"labelled{s}"] = f"SELECT * FROM cleaned JOIN labels{s} USING (alert_id)"
        extra[f"members{s}"] = members(f"labelled{s}")
        extra[f"incidents{s}"] = incidents(f"members{s}")
        extra[f"services{s}"] = f"SELECT component_id, list(DISTINCT service) AS services FROM labelled{s} GROUP BY 1"
        extra[f"matched{s}"] = matched(f"incidents{s}", f"services{s}")
        selects.append(
            f"""SELECT {s}::BIGINT AS setting, {float(window)}::DOUBLE AS window_sec, {threshold}::DOUBLE AS threshold,
            (SELECT count(*) FROM labelled{s}) AS alerts, (SELECT count(*) FROM incidents{s}) AS incidents,
            round(100.0::DOUBLE * ((SELECT count(*) FROM labelled{s}) - (SELECT count(*) FROM incidents{s})) / (SELECT count(*) FROM labelled{s}), 1) AS noise_reduction,
            {percent('detected', 'total')} AS detection_rate, {percent('root_localized', 'detected')} AS root_cause_accuracy
            FROM (SELECT {COUNTERS} FROM matched{s})"""
        )
    return with_ctes("\nUNION ALL\n".join(selects), extra)


def _statements() -> dict[str, str]:
    q: dict[str, str] = {}
    line = "ts, source, service, severity, message, raw_line"
    q["parse_hdfs_lines"] = f"SELECT {line} FROM storage_parsed WHERE ts IS NOT NULL"
    q["capped_lines"] = q["parse_hdfs_lines"]
    q["testbed_folder"] = """
        SELECT ts, service, severity, message, event_id, 'normal' AS dataset_type, 'day-1' AS label FROM service_graded WHERE ts IS NOT NULL"""
    q["parse_spark_lines"] = f"SELECT {line} FROM spark_parsed WHERE ts IS NOT NULL"
    q["parse_service_logs"] = f"SELECT {PARSED} FROM service_graded WHERE ts IS NOT NULL"
    q["parse_gateway_logs"] = f"SELECT {PARSED} FROM gateway_graded WHERE ts IS NOT NULL"
    q["parse_trace_spans"] = f"SELECT {PARSED} FROM span_graded WHERE ts IS NOT NULL"
    all_parsed = "SELECT * FROM service_graded UNION ALL SELECT * FROM gateway_graded UNION ALL SELECT * FROM span_graded"
    filled = ", ".join(f"{fill(c)} AS {c}" for c in ("source", "service", "severity", "message", "event_id", "raw_line"))
    q["aiops_alerts"] = f"""
        SELECT ts, service, severity, message, event_id FROM (
            SELECT ts, {filled} FROM ({all_parsed}) WHERE severity IN ('WARN', 'ERROR', 'FATAL')
                AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-25')
        QUALIFY row_number() OVER (PARTITION BY ts, service, message ORDER BY event_id, raw_line) = 1"""
    counts = ", ".join(f"count(*) FILTER (WHERE ts IS NOT NULL AND severity = '{s}') AS {s.lower()}" for s in ("FATAL", "ERROR", "WARN", "INFO", "DEBUG"))
    q["parse_stats"] = f"""
        SELECT (SELECT count(ts) FROM service_graded) AS service_logs, (SELECT count(ts) FROM gateway_graded) AS gateway_logs,
            (SELECT count(ts) FROM span_graded) AS trace_spans, {counts}, count(*) FILTER (WHERE ts IS NULL) AS bad_ts FROM ({all_parsed})"""
    q["load_ground_truth"] = "SELECT * FROM truth"
    q["ground_truth_counts"] = """
        SELECT 'level' AS dimension, level AS value, count(*) AS n FROM truth GROUP BY level
        UNION ALL (SELECT 'failure_type', failure_type_en, count(*) AS n FROM truth GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8)"""
    q["translate_failure_type"] = f"SELECT timestamp_epoch::VARCHAR AS timestamp, cmdb_id, failure_type, {FAILURE_EN} AS failure_type_en FROM fault_csv"

    q["severity_filter"] = "SELECT alert_id, ts, source, service, severity, message FROM severe"
    q["infer_severity_hdfs"] = f"SELECT doc_id, {storage_severity(quote('INFO'), 'text')} AS severity FROM documents"
    q["infer_severity_text"] = f"SELECT doc_id, {text_severity('text')} AS severity FROM documents"
    raw = "CASE event_type WHEN 'error' THEN ' critical ' WHEN 'click' THEN 'Err' WHEN 'view' THEN 'warning' WHEN 'signup' THEN 'finest' ELSE 'notice' END"
    q["normalize_severity"] = f"SELECT event_id, {normalize_severity('raw')} AS severity FROM (SELECT event_id, {raw} AS raw FROM events)"
    q["time_bound"] = "SELECT alert_id, ts, severity FROM alerts WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 12:00:00'"
    q["fill_unknown"] = f"""
        SELECT alert_id, {fill('source')} AS source, {fill('service')} AS service, {fill('message')} AS message FROM (
            SELECT alert_id, CASE WHEN source <> 'spark' THEN source END AS source, message,
                CASE WHEN severity = 'INFO' THEN '  ' ELSE service END AS service FROM alerts)"""
    q["valid_alerts"] = """
        SELECT alert_id, CASE WHEN source = 'hdfs' THEN '' ELSE cleaned_message END AS cleaned_message FROM cleaned
        WHERE severity <> 'FATAL' AND NOT (source = 'hdfs' AND severity = 'WARN')"""
    q["clean_message"] = f"SELECT alert_id, {clean('message')} AS cleaned_message FROM alerts"
    q["clean_documents"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
    q["base_service"] = f"SELECT alert_id, {base('service')} AS base FROM alerts"
    q["service_tagged_text"] = "SELECT alert_id, CASE WHEN severity = 'FATAL' THEN cleaned_message ELSE base || ': ' || cleaned_message END AS tagged FROM cleaned"
    q["display_rows"] = """
        SELECT alert_id, strftime(ts, '%H:%M:%S') AS time, severity AS sev, service AS src, substring(message, 1, 120) AS msg,
            severity IN ('FATAL', 'ERROR') AS focus FROM alerts"""
    hourly = "(SELECT * EXCLUDE (ts, message), date_trunc('hour', ts) AS ts, split_part(message, ' ', 1) || ' failed' AS message FROM alerts)"
    for name, key in (("dedup_log_alerts", "ts, message"), ("dedup_aiops_alerts", "ts, service, message")):
        q[name] = f"""SELECT alert_id, ts, service, message, severity FROM {hourly}
            QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY alert_id) = 1"""
    q["combined_alerts"] = f"""
        SELECT ts, {filled} FROM (SELECT * FROM storage_parsed UNION ALL SELECT * FROM spark_parsed)
        WHERE ts IS NOT NULL AND severity IN ('WARN', 'ERROR', 'FATAL')
        QUALIFY row_number() OVER (PARTITION BY ts, message ORDER BY source, raw_line) = 1"""

    q["alert_counts"] = """
        SELECT 'source' AS dimension, source AS value, count(*) AS n FROM severe GROUP BY source
        UNION ALL SELECT 'severity', severity, count(*) FROM severe GROUP BY severity"""
    q["top_services"] = "SELECT service, count(*) AS n FROM severe GROUP BY service ORDER BY n DESC, service LIMIT 10"
    q["alert_time_range"] = """
        SELECT min(ts) AS earliest, max(ts) AS latest, count(*) AS n, (max(ts_us) - min(ts_us)) / 1e6 AS span_sec FROM severe"""
    minutes = "(SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM {} WHERE source = 'hdfs' GROUP BY 1)"
    q["alerts_per_minute"] = f"SELECT minute, n FROM {minutes.format('alerts')}"
    q["template_counts"] = "SELECT count(*) AS alerts, count(DISTINCT cleaned_message) AS templates FROM cleaned"

    q["template_estimates"] = """
        SELECT service, count(*) AS alerts, count(DISTINCT cleaned_message) AS templates, true AS within_bound FROM cleaned GROUP BY service"""

    def densest(table: str, width: int) -> str:
        return f"""(SELECT a.minute AS window_start, a.minute + INTERVAL {width} MINUTE AS window_end, sum(b.n)::BIGINT AS alerts
            FROM {minutes.format(table)} a JOIN {minutes.format(table)} b ON b.minute >= a.minute AND b.minute < a.minute + INTERVAL {width} MINUTE
            GROUP BY a.minute ORDER BY alerts DESC, a.minute LIMIT 1)"""

    q["densest_window"] = f"SELECT * FROM {densest('alerts', 60)}"
    q["stratified_sample"] = f"""
        SELECT alert_id, source, cleaned_message FROM cleaned WHERE source = 'spark'
        UNION ALL
        SELECT alert_id, source, cleaned_message FROM (
            SELECT c.*, row_number() OVER (PARTITION BY cleaned_message ORDER BY ts_us, alert_id) AS rn,
                count(*) OVER (PARTITION BY cleaned_message) AS k, count(*) OVER () AS total
            FROM cleaned c JOIN {densest('cleaned', 60 * 24 * 10)} w ON c.ts >= w.window_start AND c.ts < w.window_end
            WHERE source = 'hdfs')
        WHERE rn <= least(k, greatest(1, floor(k::DOUBLE / total
            * greatest({R.SAMPLE + 1000} - (SELECT count(*) FROM cleaned WHERE source = 'spark'), 0))))"""
    indexed = "(SELECT *, row_number() OVER (ORDER BY ts_us, alert_id) - 1 AS idx, count(*) OVER () AS total FROM severe)"
    q["even_sample"] = f"""
        SELECT alert_id, idx FROM {indexed} WHERE total <= {R.SAMPLE}
            OR idx IN (SELECT floor(i * (total::DOUBLE / {R.SAMPLE}))::BIGINT FROM range({R.SAMPLE}) r(i))"""
    replay = f"""(SELECT idx // step AS row, 's' || (idx // step) AS id, ts, severity, service, substring(message, 1, 200) AS message
        FROM (SELECT *, greatest(1, total // {R.REPLAY}) AS step FROM {indexed}) WHERE idx % step = 0)"""
    q["replay_sample"] = f"SELECT * FROM {replay}"
    q["replay_page"] = f"""
        SELECT * EXCLUDE (n), CASE WHEN 220 < n THEN 220 ELSE 0 END::BIGINT AS next_cursor, n AS total
        FROM (SELECT *, count(*) OVER () AS n FROM {replay}) WHERE row >= 100 AND row < 220"""

    q["replay_envelopes"] = f"""
        SELECT c AS cursor, coalesce(string_agg(id, ',' ORDER BY row) FILTER (WHERE row >= c AND row < c + 120), '') AS ids,
            CASE WHEN c + 120 < count(*) THEN c + 120 ELSE 0 END AS next_cursor, count(*) AS total
        FROM {replay}, (SELECT unnest([100, 1000000000])::BIGINT AS c) GROUP BY c"""
    q["l2_normalize_vectors"] = """
        SELECT vec_id, i - 1 AS dim, round(u[i] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS x
        FROM (SELECT vec_id, u, sqrt(list_dot_product(u, u)) AS norm, unnest(range(1, len(u) + 1)) AS i
              FROM (SELECT vec_id, embedding::DOUBLE[] AS u FROM embeddings))"""
    q["embedding_sync_check"] = """
        SELECT (SELECT count(*) FROM alerts) AS alerts, count(*) AS vectors,
            (SELECT count(*) FROM alerts WHERE alert_id NOT IN (SELECT vec_id FROM embeddings)) AS alerts_without_vector,
            count(*) FILTER (WHERE vec_id NOT IN (SELECT alert_id FROM alerts)) AS vectors_without_alert,
            min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims FROM embeddings"""
    packed = """round(any_value(sim), 6) AS sim, arg_min(dst, (dst_us, dst)) AS first_dst, arg_max(dst, (dst_us, dst)) AS last_dst, count(*) AS n_links"""
    q["similarity_edges"] = f"SELECT src, vec_b, {packed} FROM pairs GROUP BY src, vec_b"
    q["cross_service_edges"] = f"""
        SELECT src, vec_b, CASE WHEN sim < {R.CROSS} THEN base_b END AS service, {packed} FROM cross_pairs GROUP BY 1, 2, 3"""
    q["connected_components"] = "SELECT alert_id, component_id FROM labels"
    q["cross_service_components"] = "SELECT alert_id, component_id FROM cross_labels"
    q["graph_size"] = """
        SELECT count(*) AS alerts, count(DISTINCT component_id) AS components, (SELECT count(*) FROM pairs) AS edges FROM labels"""
    q["gap_segments"] = "SELECT alert_id, component_id, gap_no::BIGINT AS gap_no FROM gapped"
    q["span_segments"] = "SELECT alert_id, component_id, gap_no::BIGINT AS gap_no, span_no::BIGINT AS span_no FROM spanned"

    q["cohesion"] = "SELECT alert_id, component_id, round(cohesion, 6) AS cohesion FROM members"
    q["candidate_scores"] = "SELECT alert_id, component_id, round(score, 6) AS score FROM members"
    q["root_cause_top3"] = "SELECT component_id, rn::INTEGER AS rn, alert_id, share AS confidence FROM top3"
    q["incident_status"] = "SELECT component_id, root_alert_id, confidence, status FROM incidents"
    q["incident_summary"] = """
        SELECT component_id, span_start, span_end, member_count, suppressed_count, array_to_string(services, ',') AS services
        FROM incidents JOIN services USING (component_id)"""
    q["incident_ids"] = "SELECT component_id, incident_no, incident_id FROM incidents"
    q["incident_title"] = "SELECT component_id, title FROM incidents"
    q["incidents"] = f"""
        SELECT {LIGHT}, candidates FROM incidents JOIN (
            SELECT component_id, string_agg(alert_id || ':' || share, '|' ORDER BY rn) AS candidates FROM top3 GROUP BY 1) USING (component_id)"""
    q["text_vectors"] = "SELECT text_id AS vec_id, tagged, dim, round(x, 6) AS x FROM event_terms JOIN (SELECT DISTINCT text_id, tagged FROM event_tagged) USING (text_id)"
    q["incidents_from_text"] = f"SELECT {LIGHT} FROM text_incidents"
    q["segmented_incidents"] = f"SELECT {LIGHT} FROM cross_incidents"
    q["incident_timeline"] = f"""
        SELECT incident_id, row::INTEGER AS row, strftime(ts, '%H:%M:%S') AS t, severity || ' · ' || {clip('message', 60)} AS d, alert_id = root_alert_id AS now
        FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY ts_us DESC, alert_id) AS row FROM labelled)
        JOIN (SELECT component_id, incident_id, root_alert_id FROM incidents) USING (component_id) WHERE row <= {schema.TIMELINE_ROWS}"""
    q["cluster_audit"] = """
        SELECT alert_id, incident_id, CASE WHEN alert_id = root_alert_id THEN 'root' ELSE 'member' END AS role,
            CASE WHEN alert_id = root_alert_id THEN share END AS candidate_conf, ts, source, service, severity, message
        FROM labelled JOIN (SELECT component_id, incident_id, root_alert_id FROM incidents) USING (component_id)
        JOIN (SELECT component_id, share FROM top3 WHERE rn = 1) USING (component_id)"""
    q["committed_artifacts"] = """
        SELECT alert_id, incident_id, CASE WHEN alert_id = root_alert_id THEN 'root' ELSE 'member' END AS role, title, member_count
        FROM labelled JOIN (SELECT component_id, incident_id, root_alert_id, title, member_count FROM incidents) USING (component_id)"""
    q["cluster_sizes"] = """
        SELECT sum(member_count)::BIGINT AS alerts, count(*) AS incidents,
            round(100.0::DOUBLE * (sum(member_count) - count(*)) / sum(member_count), 1) AS noise_reduction,
            min(member_count) AS min_size, list_sort(list(member_count))[count(*) // 2 + 1] AS median_size, max(member_count) AS max_size
        FROM incidents"""
    q["status_counts"] = """
        SELECT 'status' AS dimension, status AS value, count(*) AS n FROM incidents GROUP BY status
        UNION ALL SELECT 'root_severity', root_severity, count(*) FROM incidents GROUP BY root_severity"""

    q["incidents_light"] = f"SELECT {LIGHT} FROM incidents"
    q["incident_queue"] = f"""
        SELECT incident_id AS id, title, round(confidence * 100)::BIGINT AS confidence, suppressed_count AS alerts,
            ((incident_no - 1) * 3) || 'm' AS age, {base('root_service')} AS host FROM incidents WHERE incident_no > 1"""
    q["incident_tags"] = f"""
        SELECT component_id, upper({base('root_service')}) || ',' || root_severity || ',AIOPS,'
            || CASE WHEN root_severity IN ('FATAL', 'ERROR') THEN 'P1' ELSE 'P2' END AS tags FROM incidents"""
    seconds = "greatest(1, (end_us - start_us) // 1000000)"
    q["incident_explanation"] = f"""
        SELECT component_id, 'Correlation collapsed ' || format('{{:,}}', member_count) || ' alerts on ' || root_service
            || ' into a single incident spanning ' || CASE WHEN {seconds} >= 60 THEN ({seconds} // 60) || 'm ' || ({seconds} % 60) || 's' ELSE {seconds} || 's' END
            || '. Root candidate: ' || root_severity || ' — ' || substring({strip('root_message')}, 1, 140) || '.'
            || CASE WHEN len(others) > 0 THEN ' Alerts also correlated from: ' || array_to_string(others[1:4], ', ') || '.' ELSE '' END AS explanation
        FROM (SELECT *, list_filter(services, lambda s: s <> root_service) AS others FROM incidents JOIN services USING (component_id))"""
    q["explanation_prompts"] = """
        SELECT incident_id, 'You are an expert Site Reliability Engineer analyzing a cluster of alerts. ' || chr(10) || 'Below are the top ' || n
            || ' root cause alerts extracted from the incident cluster:' || chr(10) || chr(10) || lines || chr(10) || chr(10)
            || 'In exactly 2 concise sentences, explain what the root cause likely is and what failed. ' || chr(10)
            || 'Use plain English. Do not hallucinate details not present in the logs.' || chr(10) AS prompt
        FROM incidents JOIN (
            SELECT component_id, count(*) AS n, string_agg('[' || strftime(ts, '%H:%M:%S') || '] ' || severity || ' (' || service || '): ' || message, chr(10) ORDER BY rn) AS lines
            FROM top3 GROUP BY 1) USING (component_id)"""
    capped = f"""(SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY ts_us, alert_id) - 1 AS row FROM labelled)
        JOIN (SELECT component_id, incident_id, member_count FROM incidents) USING (component_id) WHERE row < {schema.DETAIL_MEMBERS})"""
    q["capped_members"] = f"""
        SELECT incident_id, row::INTEGER AS row, incident_id || '_a' || row AS id, alert_id, ts, service, severity, message, member_count FROM {capped}"""
    q["root_member_id"] = f"""
        SELECT i.incident_id, coalesce(i.incident_id || '_a' || min(c.row), i.incident_id || '_root') AS root_id
        FROM incidents i LEFT JOIN {capped} c ON c.component_id = i.component_id AND c.ts = i.root_ts AND c.service = i.root_service AND c.message = i.root_message
        GROUP BY i.incident_id"""
    q["incident_detail_timeline"] = f"""
        SELECT incident_id, row::INTEGER AS row, strftime(ts, '%H:%M:%S') AS t, severity || ' · ' || substring(message, 1, 90) AS d, row = 0 AS now
        FROM {capped} WHERE row < {schema.DETAIL_TIMELINE_ROWS}"""
    q["reduction_metrics"] = """
        SELECT sum(member_count)::BIGINT AS total_alerts, count(*) AS total_incidents, sum(suppressed_count)::BIGINT AS suppressed,
            round(100.0::DOUBLE * sum(suppressed_count) / sum(member_count), 1) AS noise_reduction,
            round(100.0::DOUBLE - count(*)::DOUBLE / sum(member_count) * 100.0::DOUBLE, 1) AS reduction_kpi FROM incidents"""

    q["fault_match"] = """
        SELECT fault_id, ts, cmdb_id, level, failure_type_en, detected, localized, root_localized, matched_incident, matched_root_service,
            matched_cluster_size FROM matched"""
    q["evaluation_metrics"] = f"""
        SELECT total AS total_faults, detected, service_matched_detected, localized, root_localized,
            {percent('detected', 'total')} AS detection_rate, {percent('service_matched_detected', 'total')} AS detection_rate_service_matched,
            {percent('localized', 'detected')} AS localization_rate, {percent('root_localized', 'detected')} AS root_cause_accuracy
        FROM (SELECT {COUNTERS} FROM matched)"""
    q["eval_by_type"] = f"SELECT failure_type_en, {COUNTERS} FROM matched GROUP BY 1"
    q["eval_by_level"] = f"SELECT level, {COUNTERS} FROM matched GROUP BY 1"
    q["undetected_faults"] = """
        SELECT fault_id, ts, cmdb_id, failure_type_en FROM matched WHERE NOT detected ORDER BY ts_us, fault_id LIMIT 10"""

    q["live_alert_rows"] = q["display_rows"]
    q["live_dedup"] = """
        SELECT DISTINCT date_trunc('hour', ts) AS ts, service, split_part(message, ' ', 1) AS message FROM alerts"""
    q["live_rates"] = """
        SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS n
        FROM alerts GROUP BY 1, 2"""
    q["live_sliding_rates"] = """
        SELECT date_trunc('minute', ts) - i * INTERVAL 1 MINUTE AS window_start,
            date_trunc('minute', ts) - i * INTERVAL 1 MINUTE + INTERVAL 60 MINUTE AS window_end, count(*) AS n
        FROM alerts, range(60) r(i) GROUP BY 1, 2"""
    q["live_densest_window"] = q["densest_window"]
    q["live_text_components"] = "SELECT alert_id, component_id FROM live_labels"
    q["live_components"] = q["connected_components"]
    return q


def statements() -> dict[str, str]:
    done = {name: with_ctes(inspect.cleandoc(sql)) for name, sql in _statements().items()}
    done["parameter_sweep"] = sweep()
    return done
