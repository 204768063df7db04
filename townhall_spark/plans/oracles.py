"""The test-data adapters and shared steps as DuckDB SQL.

``with_ctes`` puts the named steps a query needs, in dependency order, in front
of its final SELECT.
"""

from __future__ import annotations

from townhall_spark.functions.lexicon import Lexicon
from townhall_spark.plans import fixtures as fx
from townhall_spark.schemas import ACTION_CATEGORIES, HAZARD_TYPES

# Fixed values, written out again so that a wrong entry in the library shows: state,
# postal code, Census region, Census division.
STATES = (
    ("Alabama", "AL", "South", "East South Central"),
    ("Alaska", "AK", "West", "Pacific"),
    ("Arizona", "AZ", "West", "Mountain"),
    ("Arkansas", "AR", "South", "West South Central"),
    ("California", "CA", "West", "Pacific"),
    ("Colorado", "CO", "West", "Mountain"),
    ("Connecticut", "CT", "Northeast", "New England"),
    ("Delaware", "DE", "South", "South Atlantic"),
    ("District of Columbia", "DC", "South", "South Atlantic"),
    ("Florida", "FL", "South", "South Atlantic"),
    ("Georgia", "GA", "South", "South Atlantic"),
    ("Hawaii", "HI", "West", "Pacific"),
    ("Idaho", "ID", "West", "Mountain"),
    ("Illinois", "IL", "Midwest", "East North Central"),
    ("Indiana", "IN", "Midwest", "East North Central"),
    ("Iowa", "IA", "Midwest", "West North Central"),
    ("Kansas", "KS", "Midwest", "West North Central"),
    ("Kentucky", "KY", "South", "East South Central"),
    ("Louisiana", "LA", "South", "West South Central"),
    ("Maine", "ME", "Northeast", "New England"),
    ("Maryland", "MD", "South", "South Atlantic"),
    ("Massachusetts", "MA", "Northeast", "New England"),
    ("Michigan", "MI", "Midwest", "East North Central"),
    ("Minnesota", "MN", "Midwest", "West North Central"),
    ("Mississippi", "MS", "South", "East South Central"),
    ("Missouri", "MO", "Midwest", "West North Central"),
    ("Montana", "MT", "West", "Mountain"),
    ("Nebraska", "NE", "Midwest", "West North Central"),
    ("Nevada", "NV", "West", "Mountain"),
    ("New Hampshire", "NH", "Northeast", "New England"),
    ("New Jersey", "NJ", "Northeast", "Middle Atlantic"),
    ("New Mexico", "NM", "West", "Mountain"),
    ("New York", "NY", "Northeast", "Middle Atlantic"),
    ("North Carolina", "NC", "South", "South Atlantic"),
    ("North Dakota", "ND", "Midwest", "West North Central"),
    ("Ohio", "OH", "Midwest", "East North Central"),
    ("Oklahoma", "OK", "South", "West South Central"),
    ("Oregon", "OR", "West", "Pacific"),
    ("Pennsylvania", "PA", "Northeast", "Middle Atlantic"),
    ("Rhode Island", "RI", "Northeast", "New England"),
    ("South Carolina", "SC", "South", "South Atlantic"),
    ("South Dakota", "SD", "Midwest", "West North Central"),
    ("Tennessee", "TN", "South", "East South Central"),
    ("Texas", "TX", "South", "West South Central"),
    ("Utah", "UT", "West", "Mountain"),
    ("Vermont", "VT", "Northeast", "New England"),
    ("Virginia", "VA", "South", "South Atlantic"),
    ("Washington", "WA", "West", "Pacific"),
    ("West Virginia", "WV", "South", "South Atlantic"),
    ("Wisconsin", "WI", "Midwest", "East North Central"),
    ("Wyoming", "WY", "West", "Mountain"),
)
STATE_CODES = {name: code for name, code, _, _ in STATES}
STATE_REGION = {code: region for _, code, region, _ in STATES}
STATE_DIVISION = {code: division for _, code, _, division in STATES}

# Word in a segment's body, code, state, name.
BODIES = (
    ("alameda", "0600562", "CA", "Alameda"),
    ("boston", "2507000", "MA", "Boston"),
    ("denver", "0820000", "CO", "Denver"),
    ("longbeach", "0643000", "CA", "Long Beach"),
    ("kingcounty", "53033", "WA", "King County"),
    ("seattle", "5363000", "WA", "Seattle"),
)

# Code points that are white space.
WS = "'" + "".join(map(chr, (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239,
    8287, 12288))) + "'"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def pick(values, index: str) -> str:
    return f"({text_list(values)})[CAST({index} AS INTEGER) + 1]"


def case_map(expr: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def region(state: str) -> str:
    return case_map(f"upper({state})", STATE_REGION, "'Unknown'")


def division(state: str) -> str:
    return case_map(f"upper({state})", STATE_DIVISION, "'Unknown'")


def sentence_list(expr: str) -> str:
    pieces = (f"string_split_regex(regexp_replace({expr}, '([.!?]){SPACE}+', "
              r"'\1' || chr(10), 'g'), '\n+')")
    return (f"list_filter(list_transform({pieces}, lambda x: {strip('x')}), "
            "lambda x: length(x) >= 25)")


def planted(terms) -> str:
    n = len(terms)
    return (f"(text || chr(10) || 'The Board spoke of ' || {pick(terms, f'doc_id % {n}')} || ' and ' "
            f"|| {pick(terms, f'(doc_id // 7) % {n}')} || ' at some length.')")


def govt_type(label: str) -> str:
    u = f"upper({label})"
    council = " OR ".join(f"contains({u}, '{w}')"
                          for w in ("COUNCIL", "COMMISSION", "COUNTY", "BOARD OF SUPERVISORS"))
    return (f"CASE WHEN contains({u}, 'PLAN') OR contains({u}, 'ZON') THEN 'committee' "
            f"WHEN {council} THEN 'council_full' END")


def hits(low: str, words) -> str:
    if not words:
        return "0"
    return f"len(list_filter({text_list(words)}, lambda t: contains({low}, t)))"


def hazard(low: str, lexicon: Lexicon) -> str:
    arms = " ".join(f"WHEN {hits(low, words)} > 0 THEN '{name}'"
                    for name, words in lexicon.hazards)
    return f"CASE {arms} ELSE 'other' END"


def classified(source: str, text: str, lexicon: Lexicon = fx.TEST_LEXICON) -> str:
    """Body of a step that adds category, hazard and confidence to ``source``."""
    return f"""
      SELECT * EXCLUDE (low, na, nm, ng, nw, np),
        CASE WHEN category IN ('adaptation', 'both') THEN {hazard('low', lexicon)}
             ELSE 'none' END AS hazard,
        CASE WHEN na + nm + ng = 0 AND (np > 0 OR nw = 0) THEN 0.5
             WHEN na + nm + ng = 0 THEN 0.45
             WHEN na + nm >= 2 THEN 0.9 WHEN na + nm = 1 THEN 0.75
             ELSE 0.6 END::DOUBLE AS confidence
      FROM (SELECT *,
          CASE WHEN na > 0 AND nm > 0 THEN 'both' WHEN na > 0 THEN 'adaptation'
               WHEN nm > 0 THEN 'mitigation' WHEN ng > 0 AND nw > 0 THEN 'both'
               ELSE 'unrelated' END AS category
        FROM (SELECT *, {hits('low', lexicon.adaptation_strong)} AS na,
            {hits('low', lexicon.mitigation_strong)} AS nm,
            {hits('low', lexicon.climate_generic)} AS ng,
            {hits('low', lexicon.weak_context)} AS nw,
            {hits('low', lexicon.procedural)} AS np
          FROM (SELECT *, lower({text}) AS low FROM {source})))"""


def uid_parse(uid: str) -> str:
    """Body of a step over (uid, transcript, ingest_seq)."""
    def arm(pos: int) -> str:
        return " ".join(f"WHEN contains(low, '{b[0]}') THEN '{b[1 + pos]}'" for b in BODIES)

    return f"""
      SELECT *, body || '_' || day AS meeting_uid,
        CASE {arm(0)} END AS fips, CASE {arm(1)} END AS state, CASE {arm(2)} END AS name,
        CASE WHEN regexp_full_match(day, '[0-9]{{8}}')
             THEN CAST(try_strptime(day, '%m%d%Y') AS DATE) END AS meeting_date,
        CASE WHEN contains(low, 'committee') THEN 'committee'
             WHEN contains(low, 'special') THEN 'special'
             WHEN contains(low, 'workshop') THEN 'workshop'
             ELSE 'council_full' END AS meeting_type
      FROM (SELECT *, split_part({uid}, '_', 1) AS body, split_part({uid}, '_', 2) AS day,
              lower(split_part({uid}, '_', 1)) AS low FROM raw_segments)"""


def meeting_id(fips: str, day: str, kind: str) -> str:
    return (f"substr(sha1({fips} || '|' || strftime({day}, '%Y-%m-%d') || '|' || {kind}), "
            "1, 16)")


def item(text: str, category: str, hazard_type: str, confidence: str) -> str:
    body = (f"CAST(json_object('action_text', {text}, 'action_category', {category}, "
            f"'hazard_type', {hazard_type}) AS VARCHAR)")
    return f"substr({body}, 1, length({body}) - 1) || ',\"confidence\":' || {confidence} || '}}'"


def actions_json(*items: str) -> str:
    return "'{\"actions\":[' || " + " || ',' || ".join(items) + " || ']}'"


_CATEGORY_TURN = pick(fx.RESPONSE_CATEGORIES, "(doc_id // 7) % 4")
_HAZARD_TURN = pick(fx.RESPONSE_HAZARDS, "(doc_id // 7) % 8")
_HUNDREDTHS = "'0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')"

_COUNTY_RISK = ", ".join(
    f"round_even(avg(c_acctbal) FILTER (WHERE c_mktsegment = '{segment}'), 6) AS {column}"
    for column, segment in (("IFLD_RISKS", "AUTOMOBILE"), ("CFLD_RISKS", "MACHINERY"),
                            ("WFIR_RISKS", "FURNITURE"), ("HWAV_RISKS", "BUILDING"),
                            ("DRGT_RISKS", "HOUSEHOLD")))

STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_tabular": ((), f"""
      SELECT 'vid' || doc_id AS vid_id, doc_id AS ingest_seq, source,
        CASE WHEN doc_id % 97 = 0 THEN '' ELSE CAST(1000000 + k AS VARCHAR) END AS st_fips,
        'NATION_' || (k % 25) || CASE WHEN doc_id % 11 = 3 THEN ' City' ELSE '' END
          AS place_name,
        CASE WHEN doc_id % 31 = 7 THEN {pick(fx.STATE_NAMES, '(k % 25 + 1) % 10')}
             ELSE {pick(fx.STATE_NAMES, '(k % 25) % 10')} END AS state_name,
        {pick(fx.BODIES, 'k % 6')} AS place_govt,
        CASE WHEN doc_id % 89 = 1 THEN 'n/a' ELSE strftime(DATE '2006-01-01' + CAST(
          (9 * k + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 13 * (doc_id // 1400) END) % 6570
          AS INTEGER), '%Y-%m-%d') END AS meeting_date,
        CASE WHEN doc_id % 13 = 5 THEN '{fx.NO_CAPTION}' ELSE text END AS caption_text_clean
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 ELSE doc_id % 700 END AS k
            FROM documents)"""),
    "mapped": (("raw_tabular",), f"""
      SELECT {strip('place_name')} AS jurisdiction_name, {strip('st_fips')} AS
        jurisdiction_fips,
        {case_map(strip('state_name'), STATE_CODES, "''")} AS state,
        CAST(try_strptime(substr(meeting_date, 1, 10), '%Y-%m-%d') AS DATE) AS meeting_date,
        {govt_type('place_govt')} AS meeting_type,
        CASE WHEN {strip('caption_text_clean')} <> ''
              AND lower({strip('caption_text_clean')}) <> '<no caption available>'
             THEN {strip('caption_text_clean')} END AS transcript,
        source, 'https://video.example.org/watch?v=' || vid_id AS source_url,
        {strip('vid_id')} AS source_record_id, ingest_seq
      FROM raw_tabular"""),
    "canonical": (("mapped",), f"""
      SELECT {meeting_id('jurisdiction_fips', 'meeting_date', 'meeting_type')}
        AS canonical_id, jurisdiction_name, jurisdiction_fips, state, meeting_date,
        meeting_type, transcript,
        CASE WHEN length(transcript) > 0 THEN 'full_text' ELSE 'metadata_only' END
          AS transcript_quality,
        source, source_url, source_record_id, ingest_seq,
        CAST(coalesce(length(transcript), 0) AS BIGINT) AS transcript_chars
      FROM mapped WHERE jurisdiction_fips <> '' AND meeting_type IS NOT NULL
        AND meeting_date IS NOT NULL"""),
    "raw_segments": ((), f"""
      SELECT {pick(fx.SEGMENT_BODIES, 'conv_id % 8')} || '_'
          || CASE WHEN conv_id % 23 = 4 THEN '13412016' ELSE strftime(DATE '2016-01-01'
             + CAST((conv_id % 60 + 60 * (conv_id // 480)) % 3000 AS INTEGER), '%m%d%Y') END
          || '_' || turn AS uid,
        CASE WHEN role <> 'system' THEN text END AS transcript,
        conv_id * 100 + turn AS ingest_seq
      FROM conversations"""),
    "parsed_segments": (("raw_segments",), f"""
      SELECT * FROM ({uid_parse('uid')}) WHERE fips IS NOT NULL AND meeting_date IS NOT NULL"""),
    "segment_records": (("parsed_segments",), f"""
      SELECT {meeting_id('fips', 'meeting_date', 'meeting_type')} AS canonical_id,
        jurisdiction_name, fips AS jurisdiction_fips, state, meeting_date, meeting_type,
        transcript,
        CASE WHEN length(transcript) > 0 THEN 'full_text' ELSE 'metadata_only' END
          AS transcript_quality,
        'segments' AS source, 'https://segments.example.org/' AS source_url,
        source_record_id, ingest_seq,
        CAST(CASE WHEN {strip('transcript')} <> '' THEN length(transcript) ELSE 0 END AS BIGINT)
          AS transcript_chars
      FROM (SELECT fips, meeting_date, meeting_type, any_value(state) AS state,
              any_value(name) AS jurisdiction_name, arg_min(meeting_uid, ingest_seq)
              AS source_record_id, min(ingest_seq) AS ingest_seq,
              string_agg(transcript, chr(10) || chr(10) ORDER BY ingest_seq)
                FILTER (WHERE transcript <> '') AS transcript
            FROM parsed_segments GROUP BY ALL)"""),
    "all_records": (("canonical", "segment_records"), """
      SELECT * FROM canonical UNION ALL BY NAME
      SELECT * REPLACE (ingest_seq + 72057594037927936 AS ingest_seq) FROM segment_records"""),
    "ranked": (("canonical",), """
      SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY
        CASE transcript_quality WHEN 'full_text' THEN 3 WHEN 'summary' THEN 2 ELSE 1 END DESC,
        transcript_chars DESC, ingest_seq) AS rn FROM canonical"""),
    "merged": (("ranked",), f"""
      SELECT canonical_id, string_agg(t, chr(10) || chr(10) ORDER BY rn) AS transcript
      FROM (SELECT canonical_id, t, min(rn) AS rn
            FROM (SELECT canonical_id, {strip('transcript')} AS t, rn FROM ranked)
            WHERE t <> '' GROUP BY canonical_id, t) GROUP BY canonical_id"""),
    "meetings": (("ranked", "merged"), """
      SELECT r.* EXCLUDE (transcript, rn, transcript_chars), m.transcript
      FROM ranked r LEFT JOIN merged m USING (canonical_id) WHERE rn = 1"""),
    "best": (("ranked",), """
      SELECT r.*, p.source AS p_source, p.jurisdiction_name AS p_name, p.state AS p_state
      FROM ranked r JOIN ranked p ON p.canonical_id = r.canonical_id AND p.rn = 1"""),
    "conflicts": (("best",), """
      SELECT canonical_id, 'jurisdiction_name' AS field, p_source AS source_a,
        p_name AS value_a, source AS source_b, jurisdiction_name AS value_b
      FROM best WHERE p_name IS DISTINCT FROM jurisdiction_name
      UNION ALL
      SELECT canonical_id, 'state', p_source, p_state, source, state
      FROM best WHERE p_state IS DISTINCT FROM state"""),
    "sentences": (("meetings",), f"""
      SELECT canonical_id, unnest(l) AS sentence FROM (
        SELECT canonical_id, {sentence_list('transcript')} AS l FROM meetings)"""),
    "classified": (("sentences",), classified("sentences", "sentence")),
    "actions": (("classified",), f"""
      SELECT canonical_id, substr(sentence, 1, 500) AS action_text,
        category AS action_category, hazard AS hazard_type, confidence,
        '{fx.TEST_VERSION}' AS model_version
      FROM classified WHERE category <> 'unrelated'"""),
    "enriched": (("meetings", "actions"), f"""
      SELECT a.*, m.state, m.meeting_date, m.source, m.jurisdiction_name,
        m.jurisdiction_fips, {region('m.state')} AS region, year(m.meeting_date) AS year
      FROM actions a LEFT JOIN meetings m USING (canonical_id)"""),
    "placed": (("meetings",), f"""
      SELECT *, {region('state')} AS region, year(meeting_date) AS year FROM meetings"""),
    "counties": ((), f"""
      SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 5, '0') AS STCOFIPS,
        {pick([STATE_CODES.get(n, 'GU') for n in fx.STATE_NAMES], 'n_nationkey % 10')}
          AS STATEABBRV, upper(n_name) AS COUNTY, r.*
      FROM nation LEFT JOIN (SELECT c_nationkey, round_even(avg(c_acctbal), 6) AS RISK_SCORE,
        {_COUNTY_RISK}, CAST(NULL AS DOUBLE) AS HRCN_RISKS
        FROM customer GROUP BY c_nationkey) r ON n_nationkey = c_nationkey"""),
    "county_named": (("meetings",), """
      SELECT * REPLACE (CASE WHEN k >= 120 AND k < 300
          THEN regexp_replace(jurisdiction_name, ' City$', '') || ' County'
          ELSE jurisdiction_name END AS jurisdiction_name)
      FROM (SELECT *, CAST(jurisdiction_fips AS BIGINT) - 1000000 AS k FROM meetings)"""),
    "name_keyed": (("county_named",), rf"""
      SELECT *, CASE WHEN regexp_matches(jurisdiction_name, '{SPACE}+(county|parish|borough)$',
            'i') THEN {strip(f"upper(regexp_replace(jurisdiction_name, '{SPACE}+(county|parish|borough)$', '', 'i'))")}
          || '|' || upper(state) END AS name_key FROM county_named"""),
    "resolved": (("name_keyed", "counties"), """
      SELECT m.*, CASE WHEN k < 120 THEN lpad(CAST(k % 25 + 1 AS VARCHAR), 5, '0')
          ELSE c.STCOFIPS END AS county_fips
      FROM name_keyed m LEFT JOIN counties c
        ON m.name_key = upper(trim(c.COUNTY)) || '|' || c.STATEABBRV"""),
    "exposure": (("resolved", "counties"), """
      SELECT canonical_id, county_fips, COUNTY AS county_name, RISK_SCORE AS overall_risk,
        IFLD_RISKS AS risk_flood, CFLD_RISKS AS risk_sea_level_rise,
        WFIR_RISKS AS risk_wildfire, HWAV_RISKS AS risk_heat, DRGT_RISKS AS risk_drought,
        HRCN_RISKS AS risk_storm
      FROM resolved LEFT JOIN counties ON county_fips = STCOFIPS"""),
    "per_county": (("exposure", "actions"), """
      SELECT county_fips, max(county_name) AS county_name,
        count(DISTINCT canonical_id) AS meetings, max(risk_flood) AS risk_flood,
        max(risk_heat) AS risk_heat, max(risk_wildfire) AS risk_wildfire,
        max(risk_drought) AS risk_drought,
        CAST(count(hazard_type) FILTER (WHERE hazard_type = 'flood') AS BIGINT) AS act_flood,
        CAST(count(hazard_type) FILTER (WHERE hazard_type = 'heat') AS BIGINT) AS act_heat,
        CAST(count(hazard_type) FILTER (WHERE hazard_type = 'wildfire') AS BIGINT)
          AS act_wildfire,
        CAST(count(hazard_type) FILTER (WHERE hazard_type = 'drought') AS BIGINT)
          AS act_drought
      FROM exposure e LEFT JOIN (SELECT canonical_id, hazard_type FROM actions
        WHERE action_category IN ('adaptation', 'both')) a USING (canonical_id)
      WHERE county_fips IS NOT NULL GROUP BY county_fips"""),
    "alignment": (("per_county",), " UNION ALL ".join(f"""
      SELECT '{h}' AS hazard, count(risk_{h}) AS n_jurisdictions,
        CAST(sum(act_{h}) AS BIGINT) AS total_actions,
        CASE WHEN count(risk_{h}) >= 5 AND stddev_samp(risk_{h}) > 0
            AND stddev_samp(act_{h}) FILTER (WHERE risk_{h} IS NOT NULL) > 0
          THEN round_even(covar_samp(risk_{h}, act_{h}) / (stddev_samp(risk_{h})
            * stddev_samp(act_{h}) FILTER (WHERE risk_{h} IS NOT NULL)), 3) END
          AS pearson_r_risk_vs_action
      FROM per_county""" for h in ("flood", "heat", "wildfire", "drought"))),
    "golden": ((), f"""
      SELECT doc_id * 1000000 + pos AS seq, 'doc' || doc_id AS canonical_id,
        substr(sentence, 1, 500) AS action_text, action_category, hazard_type
      FROM (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos,
          CASE WHEN toxic = 1 AND quality = 1 THEN 'both' WHEN toxic = 1 THEN 'adaptation'
               WHEN quality = 1 THEN 'unrelated' ELSE 'mitigation' END AS action_category,
          CASE doc_id % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'heat' END AS hazard_type
        FROM (SELECT d.doc_id, toxic, quality, {sentence_list('text')} AS l
              FROM documents d JOIN labels USING (doc_id)))"""),
    "golden_latest": (("golden",), """
      SELECT * FROM golden QUALIFY row_number() OVER (PARTITION BY action_text
        ORDER BY seq DESC) = 1"""),
    "scored": (("golden_latest",), classified("golden_latest", "action_text")),
    "scored_strict": (("golden_latest",), classified("golden_latest", "action_text",
                                                     fx.STRICT_LEXICON)),
    "responses": ((), f"""
      SELECT 'doc' || doc_id AS canonical_id, CASE doc_id % 7
        WHEN 0 THEN 'not json ' || text
        WHEN 1 THEN CAST(to_json([text]) AS VARCHAR)
        WHEN 2 THEN '{{"actions":[]}}'
        WHEN 3 THEN '{{"actions":null}}'
        WHEN 4 THEN {actions_json(item('text', _CATEGORY_TURN, _HAZARD_TURN, _HUNDREDTHS))}
        WHEN 5 THEN {actions_json("CAST(to_json([text]) AS VARCHAR)",
                                  item('text', "'bogus'", "'heat'", "'0.5'"),
                                  item('text', "'mitigation'", "'bogus'", "'5'"))}
        ELSE {actions_json(
            item("'  '", "'both'", "'heat'", "'0.9'"),
            item('text', _CATEGORY_TURN, _HAZARD_TURN, f"chr(34) || {_HUNDREDTHS} || chr(34)"),
            item('text', "'both'", _HAZARD_TURN, "'\"high\"'"))} END AS raw
      FROM documents"""),
    "label_responses": ((), f"""
      SELECT doc_id, CASE doc_id % 5
        WHEN 0 THEN {item('text', pick(fx.RESPONSE_CATEGORIES, '(doc_id // 5) % 4'),
                          pick(fx.RESPONSE_HAZARDS, '(doc_id // 5) % 8'), _HUNDREDTHS)}
        WHEN 1 THEN {item('text', pick(fx.RESPONSE_CATEGORIES, '(doc_id // 5) % 4'),
                          "'bogus'", "'7'")}
        WHEN 2 THEN {item('text', "'bogus'", "'heat'", "'0.9'")}
        WHEN 3 THEN 'not json ' || text
        ELSE {item('text', pick(fx.RESPONSE_CATEGORIES, '(doc_id // 5) % 4'), "'heat'",
                   "'\"high\"'")} END AS raw
      FROM documents"""),
}

CATEGORY_LIST = in_list(ACTION_CATEGORIES)
HAZARD_LIST = in_list(HAZARD_TYPES)


def with_ctes(needs: tuple[str, ...], select: str) -> str:
    """``select`` behind the WITH clause of the steps it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in STEPS[name][0]:
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return select
    steps = ",\n".join(f"{name} AS MATERIALIZED ({STEPS[name][1]})" for name in ordered)
    rest = select.strip()
    if rest.startswith("WITH "):
        return f"WITH {steps},\n{rest[5:]}"
    return f"WITH {steps}\n{rest}"
