"""The same results in plain SQL over the benchmark tables, written independently of the
operators (nested replacements, brute-force joins, a recursive LCS) for the oracle engine."""

from __future__ import annotations

from platwork.plans.standins import oracle_ctes

AS_OF = "TIMESTAMP '2025-06-30 12:00:00'"
TODAY = "TIMESTAMP '2025-06-30 00:00:00'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '\\s+', ' ', 'g')"


def _identifier(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g')"


def _address(x: str) -> str:
    return f"upper({_collapse(x)})"


def _title(x: str) -> str:
    pieces = f"regexp_extract_all({_strip(x)}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string([upper(w[1]) || lower(w[2:]) for w in {pieces}], '') END"


def _money(x: str) -> str:
    return f"coalesce(TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DOUBLE), 0)"


def _date(x: str) -> str:
    return f"coalesce(try_strptime({_strip(x)}, '%m/%d/%Y'), try_strptime({_strip(x)}, '%Y-%m-%d'), {TODAY})"


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _chain(x: str, rules: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN contains({x}, '{k}') THEN '{v}'" for k, v in rules)
    return f"CASE {whens} ELSE {default} END"


def _permit_type(x: str) -> str:
    up = f"upper({_strip(x)})"
    rules = [
        ("NEW", "NEW CONSTRUCTION"), ("ADDITION", "ADDITION"), ("REMODEL", "REMODEL"), ("ALT", "ALTERATION"),
        ("REPAIR", "REPAIR"), ("DEMO", "DEMOLITION"), ("ELEC", "ELECTRICAL"), ("PLUMB", "PLUMBING"), ("MECH", "MECHANICAL"),
    ]
    return _chain(up, rules, up)


def _property_type(x: str) -> str:
    up = f"upper({_strip(x)})"
    rules = [("COM", "COMMERCIAL"), ("RES", "RESIDENTIAL"), ("IND", "INDUSTRIAL"), ("AGR", "AGRICULTURAL"), ("MAN", "MANUFACTURING")]
    return _chain(up, rules, up)


def _improvement(x: str) -> str:
    up = f"upper({x})"
    rules = [
        ("TENANT IMPROVEMENT", "TENANT_IMPROVEMENT"), ("ADDITION", "ADDITION"), ("REMODEL", "REMODEL"),
        ("NEW ", "NEW_CONSTRUCTION"), ("DEMO", "DEMOLITION"),
    ]
    return _chain(up, rules, "'OTHER'")


def _parcel_number(x: str) -> str:
    found = f"regexp_extract({x}, '(Parcel #|APN: |Parcel ID: )([0-9\\-]+)', 2)"
    return f"nullif(replace({found}, '-', ''), '')"


def _normalize(x: str) -> str:
    out = f"upper({_collapse(x)})"
    short = {
        "AVENUE": "AVE", "BOULEVARD": "BLVD", "CIRCLE": "CIR", "COURT": "CT", "DRIVE": "DR", "LANE": "LN", "PARKWAY": "PKWY",
        "PLACE": "PL", "ROAD": "RD", "STREET": "ST", "TERRACE": "TER", "TRAIL": "TRL",
        "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    }
    for word, abbreviation in short.items():
        out = f"regexp_replace({out}, '\\b{word}\\b', '{abbreviation}', 'g')"
    for noise in ("\\bUNIT\\s+\\w+\\b", "\\bAPT\\s+\\w+\\b", "#\\w+", ",.*", "[^\\w\\s]"):
        out = f"regexp_replace({out}, '{noise}', '', 'g')"
    return f"coalesce({_collapse(out)}, '')"


_TYPES = "('AVE','BLVD','CIR','CT','DR','EXPY','HWY','LN','PKWY','PL','RD','SQ','ST','TER','TRL','WAY')"


def _number(x: str) -> str:
    return f"regexp_extract({x}, '^([0-9]+)\\s+(.+)$', 1)"


def _rest(x: str) -> str:
    return f"regexp_extract({x}, '^([0-9]+)\\s+(.+)$', 2)"


def _typed(x: str) -> str:
    return f"(contains({_rest(x)}, ' ') AND split_part({_rest(x)}, ' ', -1) IN {_TYPES})"


def _name(x: str) -> str:
    return f"CASE WHEN {_typed(x)} THEN regexp_replace({_rest(x)}, ' [^ ]+$', '') ELSE {_rest(x)} END"


def _score_key(x: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({x}), '[^a-z0-9_]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_sort({words}), ' ')"


def _short(x: str) -> str:
    return f"(coalesce({x}, '') <> '' AND length({x}) < 5)"


def _message(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN '{text}; ' ELSE '' END"


PERMIT_ERRORS = " || ".join(
    [
        _message("coalesce(permit_number, '') = ''", "Missing permit number"),
        _message("coalesce(address, '') = ''", "Missing address"),
        _message(_short("address"), "Address too short"),
        _message("valuation < 0", "Negative valuation"),
        _message(f"issue_date > {AS_OF}", "Future issue date"),
        _message(f"issue_date < {AS_OF} - INTERVAL 50 YEARS", "Very old issue date"),
    ]
)
PROPERTY_ERRORS = " || ".join(
    [
        _message("coalesce(account_number, '') = ''", "Missing account number"),
        _message("coalesce(owner_name, '') = ''", "Missing owner name"),
        _message("coalesce(property_location, '') = ''", "Missing property location"),
        _message(_short("property_location"), "Property location too short"),
        _message("value < 0", "Negative property value"),
        _message("value > 10000000", "Unusually high property value"),
    ]
)

PERMIT = f"""permit AS (
  SELECT {_identifier('"Permit Number"')} AS permit_number, {_permit_type('"Permit Type"')} AS permit_type,
         {_date('"Issue Date"')} AS issue_date, {_address('"Address"')} AS address, {_title('"Owner Name"')} AS owner_name,
         {_money('"Valuation"')} AS valuation, {_collapse('"Description"')} AS description,
         {_identifier('"Parcel ID"')} AS parcel_id, upper({_strip('"Status"')}) AS status, src_row
  FROM fx_permit_raw)"""
CHECKED = (
    "unread AS (SELECT src_row AS unread_row FROM fx_permit_raw WHERE "
    f"{_strip('"Issue Date"')} <> '' AND coalesce(try_strptime({_strip('"Issue Date"')}, '%m/%d/%Y'), try_strptime({_strip('"Issue Date"')}, '%Y-%m-%d')) IS NULL),\n"
    f"checked AS (SELECT permit.*, {_message('unread_row IS NOT NULL', 'Unreadable issue date')} || {PERMIT_ERRORS} AS errors FROM permit LEFT JOIN unread ON src_row = unread_row)"
)
PROPERTY = f"""property AS (
  SELECT {_identifier('"Account Number"')} AS account_number, {_title('"Owner Name"')} AS owner_name,
         {_address('"Owner Address"')} AS owner_address, {_title('"Business Name"')} AS business_name,
         {_address('"Property Location"')} AS property_location, {_property_type('"Property Type"')} AS property_type,
         {_money('"Value"')} AS value, upper({_strip('"Status"')}) AS status, src_row
  FROM fx_property_raw)"""
CHECKED_PROPERTY = f"checked_property AS (SELECT *, {PROPERTY_ERRORS} AS errors FROM property)"


def _with(views: list[str], ctes: list[str], body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([oracle_ctes(*views), *ctes]) + "\n" + body


def _raw(expression: str, view: str = "fx_permit_raw", key: str = "src_row") -> str:
    return _with([view], [], f"SELECT {key}, {expression} AS result FROM {view}")


def _lcs(pairs: str) -> list[str]:
    """CTEs ending in ``ratio(a, b, score)`` for the distinct key pairs of CTE ``pairs``."""
    return [
        f"todo AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '')",
        "letters AS (SELECT DISTINCT b FROM todo)",
        "masks AS (SELECT b, substr(b, j, 1) AS ch, sum(CAST(1 AS HUGEINT) << (j - 1)) AS m "
        "FROM (SELECT b, unnest(range(1, length(b) + 1))::INTEGER AS j FROM letters) GROUP BY 1, 2)",
        "run AS (SELECT a, b, 0 AS i, (CAST(1 AS HUGEINT) << length(b)) - 1 AS v FROM todo UNION ALL "
        "SELECT r.a, r.b, r.i + 1, ((r.v + (r.v & coalesce(m.m, 0)::HUGEINT)) | (r.v - (r.v & coalesce(m.m, 0)::HUGEINT))) "
        "& ((CAST(1 AS HUGEINT) << length(r.b)) - 1) "
        "FROM run r LEFT JOIN masks m ON m.b = r.b AND m.ch = substr(r.a, r.i + 1, 1) WHERE r.i < length(r.a))",
        "ratio AS (SELECT a, b, CAST(round_even(200.0::DOUBLE * (length(b) - bit_count(v)) / (length(a) + length(b)), 0) AS INTEGER) AS score "
        "FROM run WHERE i = length(a))",
    ]


def _matching(asked: str) -> list[str]:
    """CTEs from ``asked(address)`` to ``scored(normalized, pid, full_address, confidence, method)``."""
    norm = _normalize("address")
    return [
        f"wanted AS (SELECT DISTINCT {norm} AS normalized FROM {asked} WHERE coalesce({_strip('address')}, '') <> '')",
        f"numbered AS (SELECT normalized, {_number('normalized')} AS num, '0 ' || normalized AS bare FROM wanted)",
        f"parsed AS (SELECT normalized, num, CASE WHEN num = '' THEN {_name('bare')} ELSE {_name('normalized')} END AS nm FROM numbered)",
        "cand AS (SELECT w.normalized, p.pid, p.situs_address FROM parsed w JOIN fx_parcel p "
        "ON w.nm <> '' AND (w.num = '' OR p.street_number = w.num) AND contains(p.street_name, w.nm))",
        f"keyed AS (SELECT normalized, pid, situs_address, {_normalize('situs_address')} AS situs FROM cand)",
        f"sides AS (SELECT *, {_score_key('normalized')} AS a, {_score_key('situs')} AS b FROM keyed)",
        *_lcs("sides"),
        "scored AS (SELECT s.normalized, s.pid, s.situs_address AS full_address, coalesce(r.score, 0) AS confidence, "
        "CASE WHEN s.normalized = s.situs THEN 'Exact' ELSE 'Fuzzy' END AS method "
        "FROM sides s LEFT JOIN ratio r ON r.a = s.a AND r.b = s.b)",
    ]


def _ranked(minimum: int, count: int) -> str:
    return (
        "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY confidence DESC, pid) AS match_rank "
        f"FROM scored WHERE confidence >= {minimum}) WHERE match_rank <= {count})"
    )


def _attached(source: str, address: str, label: str) -> list[str]:
    """CTEs ending in ``attached``: every row of ``source`` with its best parcel."""
    wanted = f"coalesce(parcel_id, '') = '' AND coalesce({address}, '') <> ''"
    return [
        f"asked AS (SELECT {address} AS address FROM {source} WHERE {wanted})",
        *_matching("asked"),
        _ranked(70, 1),
        f"""attached AS (SELECT c.* EXCLUDE (parcel_id, errors), coalesce(r.pid, c.parcel_id, '') AS parcel_id,
          coalesce(r.confidence, 0)::DOUBLE AS match_confidence, r.method,
          c.errors || CASE WHEN r.confidence < 80 THEN 'Low confidence {label} match; ' ELSE '' END AS validation_errors
          FROM (SELECT *, CASE WHEN {wanted} THEN {_normalize(address)} END AS norm FROM {source}) c
          LEFT JOIN ranked r ON r.normalized = c.norm)""",
    ]


FX_P, FX_A, FX_L = "fx_permit_raw", "fx_property_raw", "fx_parcel"
ATTACHED = [PERMIT, CHECKED, *_attached("checked", "address", "address")]
ATTACHED_PROPERTY = [
    PROPERTY, CHECKED_PROPERTY,
    "accounts AS (SELECT *, CAST(NULL AS VARCHAR) AS parcel_id FROM checked_property)",
    *_attached("accounts", "property_location", "location"),
]

OWNER = "owner AS (SELECT pid, min(OwnerName) AS owner_name FROM fx_parcel_owner WHERE IsPrimary = 1 GROUP BY pid)"
SITUS = "street_number || ' ' || street_name || ', ' || city || ', ' || state"
LATEST = (
    "SELECT p.*, a.AssessmentYear, a.AssessedValue FROM fx_personal_property p LEFT JOIN fx_assessment a "
    "ON a.PersonalPropertyID = p.PersonalPropertyID AND a.AssessmentYear = (SELECT max(AssessmentYear) FROM fx_assessment)"
)
STAGED = (
    "staged AS (SELECT *, CASE WHEN ProcessingStatus = 'Failed' THEN 'Invalid' ELSE 'Valid' END AS ValidationStatus, "
    "CASE WHEN ProcessingStatus = 'Failed' THEN 'Missing address; ' END AS ValidationMessage FROM fx_staging)"
)
STATUS = "CASE WHEN errors = '' THEN 'Valid' WHEN contains(errors, 'Missing ') THEN 'Invalid' ELSE 'Warning' END"
IN_ERROR = "count(CASE WHEN errors <> '' THEN 1 END)"


def _half_up_percent(part: str, whole: str) -> str:
    return f"(({part} * 20000 + {whole}) // (2 * {whole})) / 100.0::DOUBLE"


def _top_lookup(asked: str, text: str) -> str:
    return (
        f"best AS (SELECT q.query, min(p.pid) AS pid FROM {asked} q JOIN fx_parcel p ON contains({text}, q.query) GROUP BY q.query)"
    )


LOOKUP = (
    "SELECT b.query, p.pid, p.situs_address, p.city, p.state, p.zip_code, o.owner_name FROM best b "
    "JOIN fx_parcel p ON p.pid = b.pid LEFT JOIN owner o ON o.pid = b.pid"
)

_VALIDATION_RULES = " || ".join(
    [
        _message("coalesce(permit_number, '') = ''", "Number needed"),
        _message("coalesce(permit_number, '') <> '' AND NOT regexp_matches(permit_number, '^BP-[0-9]+$')", "Number format"),
        _message("valuation < 1000 OR valuation > 300000", "Valuation range"),
        _message("NOT coalesce(status <> 'P' OR valuation > 0, false)", "Pending without value"),
    ]
)
_ERROR_TEXT = "regexp_replace(errors, '; $', '')"


def _count(kind: str, column: str, ordinal: int, kind_sql: str | None = None) -> str:
    return (
        f"SELECT {ordinal} AS ordinal, '{column}' AS column_name, count({column}) AS non_null, "
        f"round_even(count({column}) * 100.0::DOUBLE / count(*), 1) AS pct_populated FROM {kind}"
    )


PERMIT_COLUMNS = [
    "permit_number", "permit_type", "issue_date", "address", "owner_name", "valuation", "description", "parcel_id", "status", "src_row",
]
SAMPLE_COLUMNS = ["permit_number", "permit_type", "address", "owner_name", "description", "parcel_id", "status", "src_row"]

ORACLES: dict[str, str] = {
    "clean_identifier": _raw(_identifier('"Permit Number"')),
    "clean_text": _raw(_collapse('"Description"')),
    "clean_address": _raw(_address('"Address"')),
    "title_case": _raw(_title('"Owner Name"')),
    "upper_trim": _raw(f"upper({_strip(chr(34) + 'Permit Type' + chr(34))})"),
    "parse_money": _raw(_money('"Valuation"')),
    "parse_date": _raw(_iso(_date('"Issue Date"'))),
    "standardize_permit_type": _raw(_permit_type('"Permit Type"')),
    "standardize_property_type": _raw(_property_type('"Property Type"'), FX_A),
    "normalize_address": _raw(_normalize('"Address"')),
    "normalize_parcel_number": _raw("upper('X' || replace(\"Parcel ID\", '-', '') || '9')"),
    "extract_parcel_number": _raw(_parcel_number('"Description"')),
    "improvement_type": _raw(_improvement('"Description"')),
    "source_json": _raw("CAST(json_object('src_row', src_row, 'number', \"Permit Number\", 'status', \"Status\") AS VARCHAR)"),
    "format_situs": _raw(SITUS, FX_L, "pid"),
    "parse_address": _with(
        [FX_P], [f"n AS (SELECT src_row, {_normalize(chr(34) + 'Address' + chr(34))} AS x FROM fx_permit_raw)"],
        f"SELECT src_row, {_number('x')} AS street_number, {_name('x')} AS street_name, "
        f"CASE WHEN {_typed('x')} THEN split_part({_rest('x')}, ' ', -1) ELSE '' END AS street_type FROM n",
    ),
    "token_sort_ratio": _with(
        [FX_P, FX_L],
        [
            f"pairs AS (SELECT r.src_row, {_score_key('r.' + chr(34) + 'Address' + chr(34))} AS a, {_score_key('p.situs_address')} AS b "
            "FROM fx_permit_raw r JOIN orders o ON o.o_orderkey = r.src_row JOIN fx_parcel p ON p.pid = lpad(CAST(o.o_custkey AS VARCHAR), 8, '0'))",
            *_lcs("pairs"),
        ],
        "SELECT p.src_row, coalesce(r.score, 0) AS score FROM pairs p LEFT JOIN ratio r ON r.a = p.a AND r.b = p.b",
        recursive=True,
    ),
    "map_columns": _with(
        [FX_P], [], 'SELECT "Permit Number" AS permit_number, "Valuation" AS amount, src_row, \'\' AS validation_errors FROM fx_permit_raw'
    ),
    "clean_column_names": _with(
        [FX_P], [],
        "SELECT " + ", ".join(
            f'"{n}" AS {n.lower().replace(" ", "_")}'
            for n in ("Permit Number", "Permit Type", "Issue Date", "Address", "Owner Name", "Valuation", "Description", "Parcel ID", "Status")
        ) + ", src_row FROM fx_permit_raw",
    ),
    "stored_mapping": _with(
        [FX_P], [], 'SELECT "Permit Number" AS permit_number, "Valuation" AS worth, src_row, \'\' AS validation_errors FROM fx_permit_raw'
    ),
    "clean_permits": _with([FX_P], [PERMIT], f"SELECT * REPLACE ({_iso('issue_date')} AS issue_date) FROM permit"),
    "clean_property": _with([FX_A], [PROPERTY], "SELECT * FROM property"),
    "clean_permits_typed": _with(
        ["fx_permit_typed"], [], f"SELECT src_row, coalesce(valuation, 0) AS valuation, {_iso(f'coalesce(issue_date, {TODAY})')} AS issue_date FROM fx_permit_typed"
    ),
    "clean_property_typed": _with(["fx_property_typed"], [], "SELECT src_row, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM fx_property_typed"),
    "parse_date_layouts": _with(
        ["fx_date_text"], [],
        "SELECT src_row, strftime(date_trunc('second', coalesce(CASE "
        + " ".join(
            f"WHEN regexp_full_match(trim(text), '{shape}') THEN try_strptime(trim(text), '{layout}')"
            for shape, layout in (
                ("[0-9]+/[0-9]+/[0-9]{4}", "%m/%d/%Y"), ("[0-9]{4}-[0-9]+-[0-9]+", "%Y-%m-%d"), ("[0-9]{4}-[^ ]+T[^ ]+", "%Y-%m-%dT%H:%M:%S"),
                ("[0-9]{4}-[^ ]+ [^ ]+[.][0-9]+", "%Y-%m-%d %H:%M:%S.%g"), ("[0-9]{4}-[^ ]+ [0-9]+:[0-9]+", "%Y-%m-%d %H:%M"),
                ("[^ ]+/[^ ]+ [0-9]+:[0-9]+ PM", "%m/%d/%Y %I:%M %p"), ("[^ ]+/[^ ]+ [0-9]+:[0-9]+:[0-9]+", "%m/%d/%Y %H:%M:%S"),
                ("[^ ]+/[^ ]+ [0-9]+:[0-9]+:[0-9]+ am", "%m/%d/%Y %I:%M:%S %p"), ("[0-9]{4}/[0-9]+/[0-9]+", "%Y/%m/%d"),
                ("[0-9]{2}-[0-9]{2}-[0-9]{4}", "%m-%d-%Y"), ("[0-9]{8}", "%Y%m%d"), ("[0-9]+-[A-Z][a-z]+-[0-9]+", "%d-%b-%Y"),
                ("[A-Z]{3} [0-9]+, [0-9]+", "%b %d, %Y"), ("[0-9]+/[0-9]+/[0-9]{2}", "%m/%d/%y"),
            )
        )
        + f" END, {TODAY})), '%Y-%m-%d %H:%M:%S') AS result FROM fx_date_text",
    ),
    "validate_permits": _with([FX_P], [PERMIT, CHECKED], "SELECT src_row, errors AS validation_errors FROM checked"),
    "validate_property": _with([FX_A], [PROPERTY, CHECKED_PROPERTY], "SELECT src_row, errors AS validation_errors FROM checked_property"),
    "split_valid_invalid": _with(
        [FX_P], [PERMIT, CHECKED], "SELECT src_row, CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS side FROM checked"
    ),
    "staging_status": _with([FX_P], [PERMIT, CHECKED], f"SELECT src_row, {STATUS} AS ValidationStatus FROM checked"),
    "apply_validation_rules": _with([FX_P], [PERMIT], f"SELECT src_row, {_VALIDATION_RULES} AS validation_errors FROM permit"),
    "apply_transformation_rules": _with(
        [FX_P], [PERMIT],
        "SELECT src_row, regexp_replace(permit_number, '^BP-', 'B') AS permit_number, "
        "CASE status WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FINAL' WHEN 'P' THEN 'PENDING' ELSE status END || ':' || permit_type AS status, "
        "CAST(floor(valuation / 100) AS BIGINT) AS fee FROM permit",
    ),
    "like_contains_filter": _with(
        [FX_L], [],
        "SELECT pid, situs_address AS full_address, street_number, street_name, street_type, city, state, zip_code FROM fx_parcel "
        "WHERE street_number = '150' AND street_name LIKE '%MAIN%' UNION ALL SELECT pid, situs_address, street_number, street_name, "
        "street_type, city, state, zip_code FROM fx_parcel WHERE street_name LIKE '%HILL%'",
    ),
    "min_confidence_filter": _with(
        [FX_P, FX_L], [PERMIT, *_matching("permit")],
        "SELECT normalized, pid, confidence FROM scored WHERE confidence >= 90", recursive=True,
    ),
    "rank_matches": _with(
        [FX_P, FX_L], [PERMIT, *_matching("permit"), _ranked(40, 2)],
        "SELECT normalized, pid, confidence, match_rank::INTEGER AS match_rank FROM ranked", recursive=True,
    ),
    "match_addresses": _with(
        [FX_P, FX_L], [PERMIT, *_matching("permit"), _ranked(70, 5)],
        "SELECT normalized, pid, full_address, confidence, method AS match_method, match_rank::INTEGER AS match_rank FROM ranked", recursive=True,
    ),
    "match_addresses_dense": _with(
        ["fx_parcel_dense", "fx_dense_address"],
        ["fx_parcel AS (SELECT * FROM fx_parcel_dense)", *_matching("fx_dense_address"), _ranked(70, 5)],
        "SELECT normalized, pid, full_address, confidence, method AS match_method, match_rank::INTEGER AS match_rank FROM ranked", recursive=True,
    ),
    "attach_best_parcel": _with(
        [FX_P, FX_L], ATTACHED, "SELECT src_row, parcel_id, match_confidence, validation_errors FROM attached", recursive=True
    ),
    "attach_best_parcel_property": _with(
        [FX_A, FX_L], ATTACHED_PROPERTY, "SELECT src_row, parcel_id, match_confidence, validation_errors FROM attached", recursive=True
    ),
    "address_match_stats": _with(
        [FX_P, FX_L], ATTACHED,
        "SELECT coalesce(method, 'Fuzzy') AS MatchMethod, count(*) AS TotalMatches, avg(match_confidence) AS AvgConfidence, "
        "count(nullif(parcel_id, '')) AS SuccessfulMatches, count(*) - count(nullif(parcel_id, '')) AS FailedMatches, "
        + _half_up_percent("count(nullif(parcel_id, ''))", "count(*)")
        + " AS SuccessRate FROM attached WHERE norm IS NOT NULL GROUP BY 1",
        recursive=True,
    ),
    "parcel_by_address": _with(
        [FX_P, FX_L, "fx_parcel_owner"],
        [
            f"asked AS (SELECT DISTINCT {_address(chr(34) + 'Address' + chr(34))} AS query FROM fx_permit_raw WHERE \"Address\" IS NOT NULL)",
            _top_lookup("asked", "upper(p.situs_address)"), OWNER,
        ],
        LOOKUP,
    ),
    "parcel_by_number": _with(
        [FX_L, "fx_parcel_owner"],
        [
            "asked AS (SELECT pid AS query FROM fx_parcel UNION SELECT ltrim(pid, '0') FROM fx_parcel UNION SELECT substr(pid, 2, 5) FROM fx_parcel)",
            _top_lookup("asked", "p.pid"), OWNER,
        ],
        LOOKUP,
    ),
    "parcel_search": _with(
        [FX_L],
        [
            "asked AS (SELECT DISTINCT substr(street_number, 1, 2) || ' ' || substr(street_name, 1, 3) || ' ' || substr(state, 1, 4) AS query FROM fx_parcel)",
            f"texts AS (SELECT pid, street_number, street_name, city, state, zip_code, {SITUS} AS full_address FROM fx_parcel)",
            "hits AS (SELECT q.query, t.*, row_number() OVER (PARTITION BY q.query ORDER BY street_number, street_name, pid) AS rn "
            "FROM asked q JOIN texts t ON upper(t.full_address) LIKE '%' || replace(upper(q.query), ' ', '%') || '%')",
        ],
        "SELECT query, pid, street_number, street_name, city, state, zip_code, full_address FROM hits WHERE rn <= 10",
    ),
    "parcel_exact": _with(
        [FX_P, FX_L], [],
        f"SELECT pid, street_number, street_name, city, state, zip_code, {SITUS} AS full_address FROM fx_parcel "
        'WHERE pid IN (SELECT "Parcel ID" FROM fx_permit_raw)',
    ),
    "primary_owner": _with(
        [FX_L, "fx_parcel_owner"], [],
        "SELECT p.pid, p.situs_address, o.OwnerName AS owner_name FROM fx_parcel p LEFT JOIN fx_parcel_owner o ON o.pid = p.pid AND o.IsPrimary = 1",
    ),
    "latest_assessment": _with(["fx_personal_property", "fx_assessment"], [], LATEST),
    "read_permits_page": _with(
        [FX_P], [PERMIT],
        f"SELECT src_row AS PermitID, permit_number AS PermitNumber, {_iso('issue_date')} AS IssuedDate, permit_type AS PermitType, "
        "description AS Description, address AS ProjectAddress, valuation AS Valuation, status AS Status FROM permit "
        "ORDER BY permit.issue_date DESC, src_row LIMIT 100 OFFSET 50",
    ),
    "read_permits_page_after": _with(
        [FX_P], [PERMIT],
        f"SELECT src_row AS PermitID, permit_number AS PermitNumber, {_iso('issue_date')} AS IssuedDate, permit_type AS PermitType, "
        "description AS Description, address AS ProjectAddress, valuation AS Valuation, status AS Status FROM permit "
        "WHERE permit.issue_date < TIMESTAMP '1996-01-02' OR permit.issue_date IS NULL OR (permit.issue_date = TIMESTAMP '1996-01-02' AND src_row > 300) "
        "ORDER BY permit.issue_date DESC NULLS LAST, src_row LIMIT 100",
    ),
    "read_permits_page_indexed": _with(
        [FX_P], [PERMIT],
        f"SELECT src_row AS PermitID, permit_number AS PermitNumber, {_iso('issue_date')} AS IssuedDate, permit_type AS PermitType, "
        "description AS Description, address AS ProjectAddress, valuation AS Valuation, status AS Status FROM permit "
        "ORDER BY permit.issue_date DESC NULLS LAST, src_row LIMIT 100 OFFSET 700",
    ),
    "read_property_page_after": _with(
        ["fx_personal_property", "fx_assessment"], [f"all_rows AS ({LATEST})"],
        "SELECT PersonalPropertyID, AccountNumber, OwnerName, PropertyType, AssessmentYear, AssessedValue FROM all_rows "
        "WHERE AccountNumber > 'PP00000040' OR (AccountNumber = 'PP00000040' AND PersonalPropertyID > 40) ORDER BY AccountNumber LIMIT 50",
    ),
    "duplicate_permit_pairs_of_job": _with(
        ["fx_staging"], [STAGED],
        "SELECT p1.StagingID, p1.PermitNumber, count(*) AS pair_count, 'Duplicate permit number found in system' AS DuplicateMessage "
        "FROM staged p1 JOIN staged p2 ON p1.PermitNumber = p2.PermitNumber AND p1.StagingID <> p2.StagingID "
        "WHERE p2.ProcessingStatus <> 'Failed' AND p1.ImportJobID = 4 GROUP BY 1, 2",
    ),
    "flag_duplicate_permits_of_job": _with(
        ["fx_staging"],
        [STAGED, "dup AS (SELECT p.StagingID FROM staged p WHERE p.ImportJobID = 4 AND EXISTS (SELECT 1 FROM staged q WHERE q.PermitNumber = p.PermitNumber "
                 "AND q.StagingID <> p.StagingID AND q.ProcessingStatus <> 'Failed'))"],
        "SELECT s.StagingID, s.PermitNumber, CASE WHEN d.StagingID IS NOT NULL THEN 'Warning' ELSE ValidationStatus END AS ValidationStatus, "
        "CASE WHEN d.StagingID IS NOT NULL THEN coalesce(ValidationMessage, '') || 'Duplicate permit number found in system; ' "
        "ELSE ValidationMessage END AS ValidationMessage FROM staged s LEFT JOIN dup d ON d.StagingID = s.StagingID",
    ),
    "complete_one_import_job": _with(
        ["fx_import_job", "fx_staging"], [],
        f"SELECT j.ImportJobID, j.ImportType, CASE WHEN j.ImportJobID = 4 THEN 'Completed' END AS Status, "
        f"CASE WHEN j.ImportJobID = 4 THEN {_iso(AS_OF)} ELSE {_iso('max(j.CompletedDate)')} END AS CompletedDate, "
        "CASE WHEN j.ImportJobID = 4 THEN count(s.StagingID) ELSE max(j.RecordsTotal) END AS RecordsTotal, "
        "CASE WHEN j.ImportJobID = 4 THEN count(CASE WHEN s.ProcessingStatus = 'Processed' THEN 1 END) ELSE max(j.RecordsSuccessful) END AS RecordsSuccessful, "
        "CASE WHEN j.ImportJobID = 4 THEN count(CASE WHEN s.ProcessingStatus IN ('Failed', 'Skipped') THEN 1 END) ELSE max(j.RecordsFailed) END AS RecordsFailed "
        "FROM fx_import_job j LEFT JOIN fx_staging s ON s.ImportJobID = j.ImportJobID GROUP BY 1, 2",
    ),
    "address_match_stats_merged": _with(
        [FX_P, FX_L], ATTACHED,
        "SELECT coalesce(method, 'Fuzzy') AS MatchMethod, count(*) AS TotalMatches, avg(match_confidence) AS AvgConfidence, "
        "count(nullif(parcel_id, '')) AS SuccessfulMatches, count(*) - count(nullif(parcel_id, '')) AS FailedMatches, "
        + _half_up_percent("count(nullif(parcel_id, ''))", "count(*)")
        + " AS SuccessRate FROM attached WHERE norm IS NOT NULL GROUP BY 1",
        recursive=True,
    ),
    "stream_match_and_stage_property": _with(
        [FX_A, FX_L], ATTACHED_PROPERTY,
        "SELECT src_row, account_number AS TaxpayerID, nullif(parcel_id, '') AS ParcelNumber, "
        + STATUS.replace("errors", "validation_errors")
        + " AS ValidationStatus, nullif(validation_errors, '') AS ValidationMessage, "
        "nullif(regexp_replace(validation_errors, '; $', ''), '') AS LoggedError FROM attached",
        recursive=True,
    ),
    "read_property_page": _with(
        ["fx_personal_property", "fx_assessment"], [f"all_rows AS ({LATEST})"],
        "SELECT PersonalPropertyID, AccountNumber, OwnerName, PropertyType, AssessmentYear, AssessedValue FROM all_rows "
        "ORDER BY AccountNumber LIMIT 100 OFFSET 300",
    ),
    "duplicate_permit_pairs": _with(
        ["fx_staging"], [STAGED],
        "SELECT p1.StagingID, p1.PermitNumber, count(*) AS pair_count, 'Duplicate permit number found in system' AS DuplicateMessage "
        "FROM staged p1 JOIN staged p2 ON p1.PermitNumber = p2.PermitNumber AND p1.StagingID <> p2.StagingID "
        "WHERE p2.ProcessingStatus <> 'Failed' GROUP BY 1, 2",
    ),
    "flag_duplicate_permits": _with(
        ["fx_staging"],
        [STAGED, "dup AS (SELECT p.StagingID FROM staged p WHERE EXISTS (SELECT 1 FROM staged q WHERE q.PermitNumber = p.PermitNumber "
                 "AND q.StagingID <> p.StagingID AND q.ProcessingStatus <> 'Failed'))"],
        "SELECT s.StagingID, s.PermitNumber, CASE WHEN d.StagingID IS NOT NULL THEN 'Warning' ELSE ValidationStatus END AS ValidationStatus, "
        "CASE WHEN d.StagingID IS NOT NULL THEN coalesce(ValidationMessage, '') || 'Duplicate permit number found in system; ' "
        "ELSE ValidationMessage END AS ValidationMessage FROM staged s LEFT JOIN dup d ON d.StagingID = s.StagingID",
    ),
    "complete_import_job": _with(
        ["fx_import_job", "fx_staging"], [],
        f"SELECT j.ImportJobID, j.ImportType, 'Completed' AS Status, {_iso(AS_OF)} AS CompletedDate, count(s.StagingID) AS RecordsTotal, "
        "count(CASE WHEN s.ProcessingStatus IN ('Processed', 'Failed', 'Skipped') THEN 1 END) AS RecordsProcessed, "
        "count(CASE WHEN s.ProcessingStatus = 'Processed' THEN 1 END) AS RecordsSuccessful, "
        "count(CASE WHEN s.ProcessingStatus IN ('Failed', 'Skipped') THEN 1 END) AS RecordsFailed "
        "FROM fx_import_job j LEFT JOIN fx_staging s ON s.ImportJobID = j.ImportJobID GROUP BY 1, 2",
    ),
    "permit_import_stats": _with(
        ["fx_import_job"], [],
        "SELECT ImportType, count(*) AS TotalJobs, CAST(sum(RecordsTotal) AS BIGINT) AS TotalRecords, "
        "CAST(sum(RecordsSuccessful) AS BIGINT) AS SuccessfulRecords, CAST(sum(RecordsFailed) AS BIGINT) AS FailedRecords, "
        + _half_up_percent("sum(RecordsSuccessful)::BIGINT", "sum(RecordsTotal)::BIGINT") + " AS SuccessRate, "
        "CAST(sum(date_diff('second', ImportDate, CompletedDate)) // count(*) AS BIGINT) AS AvgProcessingTimeSeconds "
        "FROM fx_import_job WHERE ImportType = 'Permit' AND CompletedDate IS NOT NULL GROUP BY ImportType",
    ),
    "import_summary": _with(
        [FX_P], [PERMIT, CHECKED],
        f"SELECT count(*) AS record_count, count(*) - {IN_ERROR} AS valid_count, {IN_ERROR} AS error_count, 'success' AS status, "
        "'Successfully imported ' || count(*) || ' permit records' AS message FROM checked",
    ),
    "column_profile": _with(
        [FX_P], [PERMIT], " UNION ALL ".join(_count("permit", c, i) for i, c in enumerate(PERMIT_COLUMNS, 1))
    ),
    "sample_record": _with(
        [FX_P], [PERMIT, "one AS (SELECT * FROM permit ORDER BY src_row LIMIT 1)"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM one WHERE coalesce(CAST({c} AS VARCHAR), '') <> ''" for c in SAMPLE_COLUMNS
        ),
    ),
    "log_import": _with(
        [FX_P], [PERMIT, CHECKED],
        f"SELECT CAST(77 AS BIGINT) AS ImportJobID, 'PERMIT' AS ImportType, 'permits.csv' AS SourceFile, {_iso(AS_OF)} AS ImportDate, "
        f"count(*) AS RecordsTotal, count(*) - {IN_ERROR} AS RecordsSuccessful, {IN_ERROR} AS RecordsFailed, 'nightly' AS Notes FROM checked",
    ),
    "log_import_errors": _with(
        [FX_P], [PERMIT, CHECKED],
        f"SELECT CAST(77 AS BIGINT) AS ImportJobID, src_row AS RecordIndex, 'Validation' AS ErrorType, {_ERROR_TEXT} AS ErrorMessage, "
        "CAST(json_object('permit_number', permit_number, 'address', address, 'status', status) AS VARCHAR) AS RecordData, "
        f"{_iso(AS_OF)} AS CreatedDate FROM checked WHERE errors <> ''",
    ),
    "log_import_error_messages": _with(
        [FX_P], [PERMIT, CHECKED],
        f"SELECT CAST(77 AS BIGINT) AS ImportJobID, src_row AS RecordIndex, unnest(string_split({_ERROR_TEXT}, '; ')) AS ErrorMessage "
        "FROM checked WHERE errors <> ''",
    ),
    "category_filter": _with(
        ["fx_settings"], [],
        "SELECT category, name, value, description FROM fx_settings UNION ALL "
        "SELECT category, name, value, description FROM fx_settings WHERE category = 'C7'",
    ),
    "existing_key_count": _with(
        ["fx_settings", "fx_setting_update"], [],
        "SELECT u.category, u.name, count(s.category) AS n FROM (SELECT DISTINCT category, name FROM fx_setting_update) u "
        "LEFT JOIN fx_settings s ON s.category = u.category AND s.name = u.name GROUP BY 1, 2",
    ),
    "settings_rows": _with(
        ["fx_setting_update"], [],
        "SELECT category, name, value, description FROM (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY seq DESC) AS rn "
        "FROM fx_setting_update) WHERE rn = 1",
    ),
    "settings_map": _with(
        ["fx_settings", "fx_setting_update"], [],
        "SELECT category, '{' || string_agg('\"' || name || '\":{\"value\":\"' || value || '\",\"description\":\"' || description || '\"}', ',' ORDER BY name) "
        "|| '}' AS settings FROM fx_settings WHERE category IN (SELECT category FROM fx_setting_update) GROUP BY category",
    ),
    "upsert_keyed": _with(
        ["fx_settings", "fx_setting_update"],
        [
            "lastv AS (SELECT category, name, value FROM (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY seq DESC) AS rn "
            "FROM fx_setting_update) WHERE rn = 1)",
            "lastd AS (SELECT category, name, description FROM (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY seq DESC) AS rn "
            "FROM fx_setting_update WHERE coalesce(description, '') <> '') WHERE rn = 1)",
            "keys AS (SELECT category, name FROM fx_settings UNION SELECT category, name FROM fx_setting_update)",
        ],
        "SELECT k.category, k.name, coalesce(v.value, s.value) AS value, "
        "coalesce(d.description, s.description, k.category || ' - ' || k.name) AS description FROM keys k "
        "LEFT JOIN fx_settings s ON s.category = k.category AND s.name = k.name "
        "LEFT JOIN lastv v ON v.category = k.category AND v.name = k.name LEFT JOIN lastd d ON d.category = k.category AND d.name = k.name",
    ),
    "insert_if_absent": _with(
        ["fx_settings", "fx_setting_update"], [],
        "SELECT category, name, value, description FROM fx_settings UNION ALL "
        "SELECT u.category, u.name, arg_min(u.value, u.seq), u.category || ' - ' || u.name || ' setting' FROM fx_setting_update u "
        "WHERE NOT EXISTS (SELECT 1 FROM fx_settings s WHERE s.category = u.category AND s.name = u.name) GROUP BY u.category, u.name",
    ),
    "sql_query": _with(
        [FX_P], [], 'SELECT src_row, "Status" AS status FROM fx_permit_raw WHERE "Status" = \'o\' OR "Description" LIKE \'%Remodel%\''
    ),
    "scan_csv": _with(
        [FX_P], [],
        'SELECT CAST(src_row AS VARCHAR) AS src_row, "Permit Number", nullif("Valuation", \'n/a\') AS "Valuation", "Address", "Parcel ID", "Description" FROM fx_permit_raw',
    ),
    "scan_feed": _with(
        [FX_P], [],
        'SELECT CAST(src_row AS VARCHAR) AS src_row, "Permit Number" AS permit_number, nullif("Valuation", \'n/a\') AS valuation, '
        "'' AS validation_errors FROM fx_permit_raw",
    ),
    "scan_csv_multiline": _with(
        [FX_P], [], "SELECT src_row, \"Description\" || chr(10) || 'second \"line\", ' || \"Address\" AS note FROM fx_permit_raw"
    ),
    "scan_csv_ragged": _with(
        [FX_P], [],
        "SELECT src_row, CASE WHEN src_row % 5 = 0 THEN src_row || ',x,y' WHEN src_row % 7 = 0 THEN CAST(src_row AS VARCHAR) END AS line, "
        "CASE WHEN src_row % 5 = 0 OR src_row % 7 = 0 THEN 'Ragged record; ' ELSE '' END AS validation_errors FROM fx_permit_raw",
    ),
    "skip_rows": _with([FX_P], [], 'SELECT CAST(src_row AS VARCHAR) AS src_row, "Description" AS note FROM fx_permit_raw'),
    "write_feed": _with([FX_P], [PERMIT, CHECKED], "SELECT src_row, permit_number, valuation, errors AS validation_errors FROM checked"),
    "write_run_output": _with(
        [FX_P], [PERMIT, CHECKED],
        "SELECT CAST(src_row AS VARCHAR) AS src_row, nullif(permit_number, '') AS permit_number, "
        "CAST(valuation AS VARCHAR) AS valuation, nullif(errors, '') AS validation_errors FROM checked",
    ),
    "append_rows": _with(
        [FX_P, FX_A], [PERMIT, PROPERTY],
        "SELECT src_row, permit_number FROM permit UNION ALL SELECT src_row, account_number FROM property",
    ),
    "write_staging": _with(
        [FX_P], [PERMIT, CHECKED],
        f"SELECT src_row AS PermitStagingID, src_row % 5 AS ImportJobID, permit_number AS PermitNumber, "
        f"{_iso('date_trunc(' + chr(39) + 'day' + chr(39) + ', issue_date)')} AS IssueDate, "
        f"CASE WHEN coalesce(description, '') <> '' THEN {_improvement('description')} END AS ImprovementType, valuation AS ValuationAmount, "
        f"{STATUS} AS ValidationStatus, nullif(errors, '') AS ValidationMessage, 'Pending' AS ProcessingStatus FROM checked",
    ),
    "stream_watch_folder": _with([FX_P], [PERMIT, CHECKED], "SELECT src_row, permit_number, errors AS validation_errors FROM checked"),
    "stream_match_and_stage": _with(
        [FX_P, FX_L], ATTACHED,
        "SELECT src_row, permit_number AS PermitNumber, nullif(parcel_id, '') AS ParcelNumber, "
        + STATUS.replace("errors", "validation_errors")
        + " AS ValidationStatus, nullif(validation_errors, '') AS ValidationMessage, "
        "nullif(regexp_replace(validation_errors, '; $', ''), '') AS LoggedError FROM attached",
        recursive=True,
    ),
    **{
        f"run_import_{kind}": _with(
            views, ctes,
            f"SELECT src_row, {name}, nullif(parcel_id, '') AS ParcelNumber, " + STATUS.replace("errors", "validation_errors")
            + " AS ValidationStatus, nullif(validation_errors, '') AS ValidationMessage, "
            "nullif(regexp_replace(validation_errors, '; $', ''), '') AS LoggedError, "
            "(SELECT count(*) FROM attached) AS RecordsTotal, (SELECT count(*) FROM attached WHERE validation_errors <> '') AS RecordsFailed FROM attached",
            recursive=True,
        )
        for kind, views, ctes, name in (
            ("permits", [FX_P, FX_L], ATTACHED, "permit_number AS PermitNumber"),
            ("property", [FX_A, FX_L], ATTACHED_PROPERTY, "account_number AS TaxpayerID"),
        )
    },
    "import_permits": _with(
        [FX_P, FX_L], ATTACHED,
        f"SELECT src_row, permit_number, {_iso('issue_date')} AS issue_date, address, parcel_id, validation_errors FROM attached", recursive=True,
    ),
    "import_property": _with(
        [FX_A, FX_L], ATTACHED_PROPERTY,
        "SELECT src_row, account_number, owner_name, property_type, value, parcel_id, validation_errors FROM attached", recursive=True,
    ),
    "permit_type_report": _with(
        [FX_P, FX_L], ATTACHED,
        "SELECT permit_type, count(*) AS permits, count(CASE WHEN validation_errors <> '' THEN 1 END) AS in_error, "
        "count(CASE WHEN match_confidence > 0 THEN 1 END) AS matched, avg(CASE WHEN match_confidence > 0 THEN match_confidence END) AS avg_confidence "
        "FROM attached GROUP BY permit_type",
        recursive=True,
    ),
}
