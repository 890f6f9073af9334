"""Independent SQL for every query, in the dialect of the checking engine.

Each text states the semantics in its own way (token lists, self-joins, window functions,
a recursive query) and shares only fixed value lists with the library.
"""

from __future__ import annotations

from contactlink.functions import quality, text
from contactlink.plans import queries
from contactlink.plans.contacts import CONTACTS_SQL
from contactlink.sources.catalog import default_catalog

CONTACTS = CONTACTS_SQL.format(orders="orders", part="part")
COLUMNS = (
    "SOURCE_TYPE SOURCE_ID COMPANY_NAME ADDRESS_LINE_1 ADDRESS_LINE_2 ZIP_CODE PHONE_NUMBER PHONE_EXTENSION EMAIL_ADDRESS"
).split()


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# --- scalar pieces ---------------------------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{text.SPACE}]+|[{text.SPACE}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def company(x: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({norm(x)}, ' '), "
        f"lambda t: t NOT IN ({quoted(text.COMPANY_NOISE)})), ' ')"
    )


def address(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ADDRESS_SHORT.items())
    return f"array_to_string(list_transform(string_split({norm(x)}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def phone(x: str) -> str:
    digits = f"regexp_replace(coalesce({x}, ''), '[^\\p{{Nd}}]', '', 'g')"
    return f"CASE WHEN length({digits}) = 11 AND {digits}[1] = '1' THEN substr({digits}, 2) ELSE {digits} END"


def email(x: str) -> str:
    return strip(f"lower({x})")


def tokens(x: str) -> str:
    return f"array_to_string(list_sort(string_split_regex({strip(x)}, '[{text.SPACE}]+')), ' ')"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by bit vectors in 128-bit integers."""
    full = f"((1::HUGEINT << length({a})::HUGEINT) - 1)"
    mask = (
        f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), "
        f"lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::HUGEINT << (i - 1)::HUGEINT ELSE 0::HUGEINT END)), 0)::HUGEINT"
    )
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    step = f"(((v + (v & m)) | (v & xor(m, {full}))) & {full})"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: {step})))"


def soundex(x: str) -> str:
    """First letter and three digits of the sounds after it; h and w do not part equal sounds, vowels do."""
    sound = f"translate(upper({x}), 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556')"
    rest = f"regexp_replace(regexp_replace(substr({sound}, 2), '[HW]', '', 'g'), '[^0-6]', '0', 'g')"
    digits = f"concat(replace(replace({sound}[1], 'H', '0'), 'W', '0'), {rest})"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    code = f"concat(upper({x})[1], rpad(substr(replace(substr({digits}, 2), '0', ''), 1, 3), 3, '0'))"
    return f"CASE WHEN regexp_matches({x}, '^[A-Za-z]') THEN {code} ELSE {x} END"


def ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return (
        f"CASE WHEN {a} <> '' AND {b} <> '' THEN "
        f"(1.0::DOUBLE - ({total} - 2 * {lcs(a, b)})::DOUBLE / {total}::DOUBLE) * 100.0::DOUBLE ELSE 0.0::DOUBLE END"
    )


def exact(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} AND {a} <> '' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"


def minted(h: str) -> str:
    d = f"sha256(concat('dedup-key:', {h}))"
    return (
        f"concat(substr({d}, 1, 8), '-', substr({d}, 9, 4), '-8', substr({d}, 14, 3), '-a', "
        f"substr({d}, 18, 3), '-', substr({d}, 21, 12))"
    )


# --- common tables ---------------------------------------------------------------------

CLEAN = f"""
contacts AS ({CONTACTS}),
clean AS (
  SELECT c.*, {company('COMPANY_NAME')} AS company_std, {address('ADDRESS_LINE_1')} AS address1_std,
    {address('ADDRESS_LINE_2')} AS address2_std, {phone('PHONE_NUMBER')} AS phone_std, {email('EMAIL_ADDRESS')} AS email_std,
    concat(coalesce(SOURCE_TYPE, ''), ':', coalesce(SOURCE_ID, '')) AS identifier
  FROM contacts c
),
keyed AS (
  SELECT *, lower(concat(substr(company_std, 1, 3), '_', substr(coalesce(ZIP_CODE, ''), 1, 5), '_', right(phone_std, 4))) AS block_key,
    substr(sha256(concat(upper({strip('SOURCE_TYPE')}), '|', {strip('SOURCE_ID')}, '|', company_std, '|', address1_std, '|', phone_std)), 1, 16) AS data_hash,
    {strip('COMPANY_NAME')} <> '' AS has_company, {strip('ADDRESS_LINE_1')} <> '' AS has_address1,
    {strip('ADDRESS_LINE_2')} <> '' AS has_address2, {strip('ZIP_CODE')} <> '' AS has_zip, {strip('PHONE_NUMBER')} <> '' AS has_phone,
    {tokens('company_std')} AS company_t, {tokens('address1_std')} AS address1_t,
    {tokens('address2_std')} AS address2_t, {tokens('ZIP_CODE')} AS zip_t
  FROM clean
)"""

BLOCK_PAIRS = "SELECT l.RID AS a, r.RID AS b FROM keyed l JOIN keyed r ON l.block_key = r.block_key AND r.RID > l.RID"


def scored(pairs: str) -> str:
    """Pairs with the similarity of every rule field."""
    return f"""
pairs AS ({pairs}),
sims AS (
  SELECT p.a, p.b, l.has_company AND r.has_company AS company_both, l.has_address1 AND r.has_address1 AS address1_both,
    l.has_address2 AND r.has_address2 AS address2_both, l.has_zip AND r.has_zip AS zip_both,
    NOT l.has_address1 AND NOT r.has_address1 AS address1_none, NOT l.has_zip AND NOT r.has_zip AS zip_none,
    {ratio('l.company_t', 'r.company_t')} AS company_sim, {ratio('l.address1_t', 'r.address1_t')} AS address1_sim,
    {ratio('l.address2_t', 'r.address2_t')} AS address2_sim, {ratio('l.zip_t', 'r.zip_t')} AS zip_sim,
    {exact('l.phone_std', 'r.phone_std')} AS phone_sim, l.has_phone AND r.has_phone AS phone_both
  FROM pairs p JOIN keyed l ON l.RID = p.a JOIN keyed r ON r.RID = p.b
)"""


RULE_1 = (
    "company_both AND company_sim >= 70 AND address1_both AND address1_sim >= 80 "
    "AND (NOT address2_both OR address2_sim >= 80) AND zip_both AND zip_sim >= 100"
)
RULE_2 = "company_both AND company_sim >= 60 AND phone_both AND phone_sim >= 100 AND address1_none AND zip_none"

MATCHED = f"""
matched AS (
  SELECT * FROM (
    SELECT *, 1 AS rank, 'BR001' AS rule_id, 'CMP_ADDR' AS match_reason FROM sims WHERE {RULE_1}
    UNION ALL
    SELECT *, 2 AS rank, 'BR002' AS rule_id, 'CMP_PHN_BLNK_ADDR' AS match_reason FROM sims WHERE {RULE_2}
  )
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rank, b) AS place FROM matched) WHERE place = 1
)"""

BEST = f"WITH RECURSIVE {CLEAN}, {scored(BLOCK_PAIRS)}, {MATCHED}"

GIVEN = """
given AS (
  SELECT RID, CASE WHEN RID % 4 = 1 AND (RID // 4) % 3 = 0 THEN concat('M1-', CAST(RID // 4 AS STRING))
                   WHEN RID % 4 = 2 THEN concat('M2-', CAST(RID // 4 AS STRING)) END AS key
  FROM keyed
)"""
NOT_GIVEN = "given AS (SELECT RID, CAST(NULL AS STRING) AS key FROM keyed)"
NO_STORE = "stored AS (SELECT '' AS data_hash, '' AS stored_key WHERE false)"
CRM_STORE = """
stored AS (
  SELECT DISTINCT data_hash, concat('OLD-', data_hash) AS stored_key FROM keyed WHERE upper(trim(SOURCE_TYPE)) = 'CRM'
)"""


def resolved(given: str = NOT_GIVEN, store: str = NO_STORE, best: str = BEST) -> str:
    """Keys by window functions over the rows of a hash, in record order."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""{best}, {given}, {store},
explicit AS (
  SELECT k.RID, k.data_hash, k.identifier, best.match_reason, best.b, g.key AS explicit_key, s.stored_key
  FROM keyed k LEFT JOIN best ON best.a = k.RID LEFT JOIN given g ON g.RID = best.b
  LEFT JOIN stored s ON s.data_hash = k.data_hash
),
carried AS (
  SELECT *, last_value(explicit_key IGNORE NULLS) OVER (PARTITION BY data_hash ORDER BY RID {before}) AS earlier_key,
    coalesce(sum(CASE WHEN explicit_key IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY data_hash ORDER BY RID {before}), 0) AS plain_before
  FROM explicit
),
resolved AS (
  SELECT *, coalesce(explicit_key, earlier_key, stored_key, {minted('data_hash')}) AS dedup_key,
    explicit_key IS NULL AND earlier_key IS NULL AND stored_key IS NULL AND plain_before = 0 AS is_new,
    coalesce(match_reason, 'NEW') AS reason
  FROM carried
),
links AS (
  SELECT dedup_key, identifier, min(RID) AS first_at FROM resolved WHERE b IS NOT NULL OR is_new GROUP BY ALL
),
outcome AS (
  SELECT r.*, CASE WHEN r.b IS NULL THEN '' ELSE
      (SELECT string_agg(l.identifier, '|' ORDER BY l.first_at) FROM links l WHERE l.dedup_key = r.dedup_key AND l.first_at <= r.RID) END AS ids
  FROM resolved r
)"""


# Records with the next one of their block.
NEIGHBOURS = f"""WITH {CLEAN},
successors AS (SELECT RID AS a, lead(RID) OVER (PARTITION BY block_key ORDER BY RID) AS b FROM keyed),
pairs AS (SELECT a, b FROM successors WHERE b IS NOT NULL)"""
PAIR_SIDES = "FROM pairs p JOIN keyed l ON l.RID = p.a JOIN keyed r ON r.RID = p.b"

CATALOG = ", ".join(
    f"({i}, {quoted([c.name])}, {quoted([c.label])}, {quoted([c.description])}, {quoted([c.group])}, {c.required}, "
    f"[{quoted(a.upper() for a in c.alternates)}])"
    for i, c in enumerate(default_catalog().columns)
)
CATALOG_TABLE = f"catalog(pos, name, label, description, grp, required, alternates) AS (VALUES {CATALOG})"


def filled(column: str) -> str:
    if column not in COLUMNS:
        return "0"
    return f"(SELECT count(*) FROM contacts WHERE {strip(column)} <> '')"


FILLED = "filled(name, present, filled) AS (VALUES {})".format(
    ", ".join(f"('{c.name}', {c.name in COLUMNS}, {filled(c.name)})" for c in default_catalog().columns)
)

EMAIL_FLAGS = {
    "valid_format": "true",
    "non_personal": f"split_part(e, '@', -1) NOT IN ({quoted(quality.PERSONAL_DOMAINS)})",
    "non_generic": f"split_part(e, '@', 1) NOT IN ({quoted(quality.GENERIC_MAILBOXES)})",
    "non_admin": f"split_part(e, '@', 1) NOT IN ({quoted(quality.ADMIN_MAILBOXES)})",
    "non_department": f"split_part(e, '@', 1) NOT IN ({quoted(quality.DEPARTMENT_MAILBOXES)})",
}
SAME = " OR ".join(f"d = '{str(i) * 10}'" for i in range(10))
RUNS = " OR ".join(f"contains(d, '{str(i) * 4}')" for i in range(10))
PHONE_POINTS = {
    "has_10_digits": "11",
    "not_all_same": f"CASE WHEN {SAME} THEN 0 ELSE 11 END",
    "valid_area_code": "CASE WHEN d[1] IN ('0', '1') THEN 0 ELSE 11 END",
    "valid_exchange": "CASE WHEN d[4] IN ('0', '1') THEN 0 ELSE 11 END",
    "valid_line_number": "CASE WHEN d[7:10] = '0000' THEN 0 ELSE 11 END",
    "not_toll_free": f"CASE WHEN d[1:3] IN ({quoted(quality.TOLL_FREE_CODES)}) THEN 0 ELSE 12 END",
    "not_main_line": "CASE WHEN d[8:10] = '000' THEN 0 ELSE 11 END",
    "has_extension": f"CASE WHEN {strip('PHONE_EXTENSION')} <> '' THEN 11 WHEN d[8:10] <> '000' THEN 5 ELSE 0 END",
    "high_quality": f"CASE WHEN d IN ('0123456789', '9876543210') OR {RUNS} THEN 0 ELSE 11 END",
}


def quality_table() -> str:
    ok_email = f"regexp_matches(e, '{quality.EMAIL_PATTERN}')"
    emails = ", ".join(f"CASE WHEN {ok_email} AND {t} THEN 20 ELSE 0 END AS email_quality_{n}" for n, t in EMAIL_FLAGS.items())
    phones = ", ".join(f"CASE WHEN length(d) = 10 THEN {p} ELSE 0 END AS phone_quality_{n}" for n, p in PHONE_POINTS.items())
    return f"""WITH {CLEAN},
source AS (SELECT RID, PHONE_EXTENSION, email_std AS e, phone_std AS d FROM clean),
points AS (SELECT RID, {emails}, {phones} FROM source),
quality AS (
  SELECT *, {' + '.join(f'email_quality_{n}' for n in EMAIL_FLAGS)} AS email_quality_total,
    {' + '.join(f'phone_quality_{n}' for n in PHONE_POINTS)} AS phone_quality_total
  FROM points
)"""


EMAIL_COLUMNS = [f"email_quality_{n}" for n in (*EMAIL_FLAGS, "total")]
PHONE_COLUMNS = [f"phone_quality_{n}" for n in (*PHONE_POINTS, "total")]


def words(of: str = "text") -> str:
    return f"SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex({of}, '[ \\t\\n\\r]+')) AS w FROM documents) WHERE w <> ''"


def band(total: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {total} <= {top} THEN '{name}'" for top, name in bands) + " END"


def token_set() -> str:
    a, b = (f"list_sort(list_distinct(string_split_regex({strip(x)}, '[{text.SPACE}]+')))" for x in ("l.COMPANY_NAME", "r.COMPANY_NAME"))
    score = lambda d, t: f"(100.0::DOUBLE - ({d}) * 100.0::DOUBLE / ({t}))"
    gap = "(CASE WHEN s <> '' THEN 1 ELSE 0 END)"
    wa, wb = f"(length(s) + {gap} + length(x))", f"(length(s) + {gap} + length(y))"
    rest = f"CASE WHEN x = '' OR y = '' THEN length(x) + length(y) ELSE length(x) + length(y) - 2 * {lcs('x', 'y')} END"
    return f"""{NEIGHBOURS},
lists AS (SELECT p.a, p.b, {a} AS ta, {b} AS tb {PAIR_SIDES}),
parts AS (
  SELECT a, b, array_to_string(list_filter(ta, lambda t: list_contains(tb, t)), ' ') AS s,
    array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS x,
    array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS y FROM lists
)
SELECT a AS RID, b AS other, round(CASE WHEN s <> '' AND (x = '' OR y = '') THEN 100.0 ELSE greatest(
  {score(rest, f'{wa} + {wb}')},
  CASE WHEN s <> '' THEN {score(f'{gap} + length(x)', f'length(s) + {wa}')} ELSE 0 END,
  CASE WHEN s <> '' THEN {score(f'{gap} + length(y)', f'length(s) + {wb}')} ELSE 0 END) END, 6) AS score
FROM parts"""


def auto_map() -> str:
    headers = ", ".join(f"({i}, {quoted([h])})" for i, h in enumerate(queries.SOURCE_HEADERS))
    return f"""WITH {CATALOG_TABLE}, names(i, h) AS (VALUES {headers}),
headers AS (SELECT h AS header FROM orders JOIN names ON i = o_orderkey % {len(queries.SOURCE_HEADERS)} UNION {words()}),
upper_headers AS (SELECT header, replace(replace({strip('upper(header)')}, 'ß', 'SS'), 'ẞ', 'SS') AS u FROM headers),
scores AS (
  SELECT header, name, pos, CASE WHEN u = name THEN 100 WHEN list_contains(alternates, u) THEN 95
    WHEN contains(u, name) OR contains(name, u) THEN 70 END AS score
  FROM upper_headers, catalog
)
SELECT header, name AS standard, score AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY header ORDER BY CASE WHEN score >= 95 THEN 0 ELSE 1 END, pos) AS place
  FROM scores WHERE score IS NOT NULL) WHERE place = 1"""


def conditions() -> str:
    c = {
        "company_70": ("COMPANY_NAME", f"{ratio('l.company_t', 'r.company_t')} >= 70", False),
        "address_not_80": ("ADDRESS_LINE_1", f"{ratio('l.address1_t', 'r.address1_t')} < 80", False),
        "address2_80_or_blank": ("ADDRESS_LINE_2", f"{ratio('l.address2_t', 'r.address2_t')} >= 80", True),
        "zip_100": ("ZIP_CODE", f"{ratio('l.zip_t', 'r.zip_t')} >= 100", False),
        "phone_100": ("PHONE_NUMBER", f"{exact('l.phone_std', 'r.phone_std')} >= 100", False),
        "email_as_address_90": ("EMAIL_ADDRESS", f"{ratio('l.email_t', 'r.email_t')} >= 90", False),
        "source_any": ("SOURCE_TYPE", "true", False),
    }
    tests = ", ".join(
        f"CASE WHEN {strip('l.' + f)} = '' OR {strip('r.' + f)} = '' THEN {blank} ELSE {test} END AS {name}"
        for name, (f, test, blank) in c.items()
    )
    return f"""{NEIGHBOURS},
emails AS (SELECT *, {tokens(address('EMAIL_ADDRESS'))} AS email_t FROM keyed)
SELECT p.a AS RID, p.b AS other, {tests},
  NOT l.has_zip AND NOT r.has_zip AS zip_blank, l.email_std = r.email_std AND l.email_std <> '' AS email_std_100
FROM pairs p JOIN emails l ON l.RID = p.a JOIN emails r ON r.RID = p.b"""


# Contacts of which a third share a data hash; zips differ, so blocks stay small.
HOT_CONTACTS = f"""SELECT RID, CASE WHEN RID % 3 = 0 THEN 'CRM' ELSE SOURCE_TYPE END AS SOURCE_TYPE, CASE WHEN RID % 3 = 0 THEN '1' ELSE SOURCE_ID END AS SOURCE_ID,
  CASE WHEN RID % 3 = 0 THEN 'Hot Works' ELSE COMPANY_NAME END AS COMPANY_NAME, CASE WHEN RID % 3 = 0 THEN '1 Main St' ELSE ADDRESS_LINE_1 END AS ADDRESS_LINE_1,
  CASE WHEN RID % 3 = 0 THEN '' ELSE ADDRESS_LINE_2 END AS ADDRESS_LINE_2, CASE WHEN RID % 3 = 0 THEN lpad(CAST(RID // 6 % 100000 AS STRING), 5, '0') ELSE ZIP_CODE END AS ZIP_CODE,
  CASE WHEN RID % 3 = 0 THEN '4155550000' ELSE PHONE_NUMBER END AS PHONE_NUMBER, PHONE_EXTENSION, EMAIL_ADDRESS FROM ({CONTACTS})"""
HOT_GIVEN = "given AS (SELECT RID, CASE WHEN RID % 6 = 3 THEN concat('G', CAST(RID % 7 AS STRING)) END AS key FROM keyed)"
HOT_KEY = "given AS (SELECT RID, CASE WHEN RID % 4 = 1 OR (RID % 4 = 2 AND RID // 4 % 3 = 0) THEN 'HOT' END AS key FROM keyed)"


def large_block() -> str:
    """Edits bound the ratio from above cheaply, so the subsequence is only computed for few pairs."""
    near = lambda a, b, p: f"levenshtein({a}, {b}) <= {1 - p / 100:.2f} * (length({a}) + length({b})) AND {ratio(a, b)} >= {p}"
    return f"""WITH {CLEAN},
rows AS (SELECT RID, substr(coalesce(ZIP_CODE, ''), 1, 1) AS block, has_company, has_address1, company_t, address1_t FROM keyed),
near AS (
  SELECT l.RID AS a, r.RID AS b, l.company_t AS x, r.company_t AS y, l.address1_t AS ax, r.address1_t AS ay, l.has_address1 AND r.has_address1 AS addressed
  FROM rows l JOIN rows r ON l.block = r.block AND r.RID > l.RID AND l.has_company AND r.has_company
  WHERE abs(length(l.company_t) - length(r.company_t)) <= 0.25 * (length(l.company_t) + length(r.company_t))
    AND levenshtein(l.company_t, r.company_t) <= 0.25 * (length(l.company_t) + length(r.company_t))
),
matched AS (
  SELECT a, b, 1 AS rank, 'NAME' AS rule_id, x, y FROM near WHERE {near('x', 'y', 88)}
  UNION ALL SELECT a, b, 2, 'NAME_ADDRESS', x, y FROM near WHERE addressed AND {near('ax', 'ay', 90)} AND {ratio('x', 'y')} >= 75
)
SELECT a AS RID, b AS match_rid, rule_id, round({ratio('x', 'y')}, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rank, b) AS place FROM matched) WHERE place = 1"""


def build() -> dict[str, str]:
    text_columns = ", ".join(f"coalesce({c}, '') AS {c}" for c in COLUMNS)
    total = "(SELECT count(*) FROM contacts) AS total_records"
    of_contacts = f"WITH contacts AS ({CONTACTS})"
    run = resolved()
    given_run = resolved(GIVEN)
    both_sides = ["k.block_key = o.block_key", "k.phone_std = o.phone_std AND k.phone_std <> ''"]
    address_key = "k.address1_std = o.address1_std AND k.address1_std <> '' AND substr(k.ZIP_CODE, 1, 5) = substr(o.ZIP_CODE, 1, 5) AND k.ZIP_CODE <> ''"
    many = " UNION ".join(
        f"SELECT k.RID AS a, o.RID AS b FROM keyed k JOIN keyed o ON {on} AND o.RID > k.RID" for on in (*both_sides, address_key)
    )
    address_score = (
        "coalesce(CASE WHEN address1_both THEN round(address1_sim, 2) END, 0.0::DOUBLE) * 0.4::DOUBLE"
        " + coalesce(CASE WHEN address2_both THEN round(address2_sim, 2) END, 0.0::DOUBLE) * 0.1::DOUBLE"
        " + coalesce(CASE WHEN zip_both THEN round(zip_sim, 2) END, 0.0::DOUBLE) * 0.15::DOUBLE"
    ).replace("address1_both", "rank = 1").replace("zip_both", "rank = 1").replace("address2_both", "rank = 1 AND address2_both")
    overall = (
        "round(company_sim, 2) * 0.35::DOUBLE + CASE WHEN rank = 1 THEN round(address1_sim, 2) ELSE 0.0::DOUBLE END * 0.25::DOUBLE"
        " + CASE WHEN rank = 2 THEN phone_sim ELSE 0.0::DOUBLE END * 0.20::DOUBLE"
    )
    out = {
        "a1_csv_scan": f"{of_contacts} SELECT CAST(RID AS STRING) AS RID, {text_columns} FROM contacts",
        "a1_many_files": f"{of_contacts} SELECT CAST(RID AS STRING) AS RID, {text_columns} FROM contacts",
        "a1_multi_file": f"""{of_contacts} SELECT CAST(RID AS STRING) AS RID, {text_columns},
            row_number() OVER (PARTITION BY RID % 10 ORDER BY RID DESC) AS place FROM contacts""",
        "a2_input_profile": f"{of_contacts} SELECT RID, COMPANY_NAME, CAST(10 AS BIGINT) AS n_columns, {total} FROM contacts ORDER BY RID LIMIT 10",
        "a3_preview": f"{of_contacts} SELECT *, {total} FROM contacts ORDER BY RID LIMIT 100",
        "a4_inventory_order": "SELECT CAST(7 AS BIGINT) AS files, CAST(7 AS BIGINT) AS filled_csv, true AS newest_first",
        "a6_rules_source": f"""WITH {CLEAN}, {scored(BLOCK_PAIRS)} SELECT a AS RID, min(b) AS match_rid, 'R90' AS rule_id, 'NAME_90' AS match_reason
            FROM sims WHERE company_both AND company_sim >= 90 AND address1_both AND address1_sim >= 80 AND zip_both AND zip_sim >= 100 GROUP BY a""",
        "a7_settings": f"""{quality_table()} SELECT RID,
            email_quality_total + CASE WHEN email_quality_valid_format > 0 THEN 30 ELSE 0 END - CASE WHEN email_quality_non_personal > 0 THEN 13 ELSE 0 END AS email_quality_total,
            phone_quality_total + CASE WHEN phone_quality_has_10_digits > 0 THEN 19 ELSE 0 END AS phone_quality_total FROM quality""",
        "a9_column_config": f"{of_contacts} SELECT RID, COMPANY_NAME, ZIP_CODE, CAST(NULL AS STRING) AS NOT_THERE FROM contacts",
        "a11_many_runs": f"""WITH {CLEAN}, runs AS (SELECT unnest(range(0, 6)) AS run),
            mine AS (SELECT DISTINCT run, data_hash FROM keyed, runs WHERE RID // 4 % 6 = run OR (RID // 4 % 6 = run - 1 AND RID % 4 = 2)),
            first AS (SELECT data_hash, min(run) AS first_run FROM mine GROUP BY data_hash)
            SELECT CAST(run AS INT) AS run, count(*) FILTER (run = first_run) AS new_hashes, count(*) FILTER (run > first_run) AS known_hashes,
              (SELECT count(*) FROM first) AS stored FROM mine JOIN first USING (data_hash) GROUP BY run""",
        "a8_column_catalog": f"""{of_contacts}, {CATALOG_TABLE}, {FILLED}
            SELECT c.name, grp AS column_group, required, CAST(len(alternates) AS BIGINT) AS n_alternates, present, filled
            FROM catalog c JOIN filled f ON f.name = c.name""",
        "a10_mapping_import": f"""WITH {CLEAN}, ids AS (SELECT DISTINCT data_hash, identifier FROM keyed)
            SELECT data_hash, {minted('data_hash')} AS dedup_key, string_agg(identifier, '|' ORDER BY identifier) AS identifiers
            FROM ids GROUP BY data_hash""",
        "a11_two_runs": f"""WITH {CLEAN} SELECT RID, {minted('data_hash')} AS first_key, {minted('data_hash')} AS second_key,
            false AS is_new, CAST(2 AS BIGINT) AS total_runs FROM keyed""",
        "a12_sink_roundtrip": f"""{run} SELECT CAST(k.RID AS STRING) AS RID, COMPANY_NAME, SOURCE_TYPE, coalesce(EMAIL_ADDRESS, '') AS EMAIL_ADDRESS,
            phone_std AS PHONE_STD, dedup_key AS DEDUP_KEY, reason AS MATCH_REASON, '' AS NOT_THERE
            FROM outcome o JOIN keyed k ON k.RID = o.RID""",
        "b1_auto_map": auto_map(),
        "b2_apply_mapping": f"""{of_contacts} SELECT COMPANY_NAME AS NAME1, PHONE_NUMBER AS CONTACT, SOURCE_ID, RID, SOURCE_TYPE,
            ADDRESS_LINE_1, ADDRESS_LINE_2, PHONE_EXTENSION FROM contacts""",
        "b3_standardize": f"""WITH {CLEAN} SELECT RID, company_std AS COMPANY_NAME_STD, address1_std AS ADDRESS1_STD,
            address2_std AS ADDRESS2_STD, phone_std AS PHONE_STD, email_std AS EMAIL_STD FROM clean""",
        "b4_select_output": f"""WITH {CLEAN} SELECT company_std AS COMPANY_NAME_STD, RID, CAST(NULL AS STRING) AS MISSING_COLUMN,
            CAST(NULL AS STRING) AS zip_code FROM clean""",
        "b5_default_columns": f"""{run} SELECT COMPANY_NAME, ADDRESS_LINE_1, ZIP_CODE, PHONE_NUMBER, SOURCE_ID, SOURCE_TYPE,
            dedup_key AS DEDUP_KEY, reason AS MATCH_REASON, '2024-01-01T00:00:00.000000' AS MATCH_TIMESTAMP, ids AS MATCHED_RECORD_IDS
            FROM outcome o JOIN keyed k ON k.RID = o.RID""",
        "b7_catalog_search": f"""WITH {CATALOG_TABLE}, terms AS (SELECT DISTINCT lower(word) AS term FROM ({words()}))
            SELECT term, string_agg(name, ',' ORDER BY grp, replace(name, '_', ' ')) AS hits
            FROM terms, catalog WHERE contains(lower(concat(name, ' ', label, ' ', description)), term) GROUP BY term""",
        "b8_active_rules": f"""WITH {CLEAN}
            SELECT CAST(1 AS BIGINT) AS rank, 'BR001' AS rule_id, CAST(100 AS BIGINT) AS priority, 'CMP_ADDR' AS match_reason, CAST(4 AS BIGINT) AS n_conditions,
              count(*) FILTER (company_std <> '' AND address1_std <> '' AND has_zip) AS eligible_records FROM keyed
            UNION ALL SELECT 2, 'BR002', 200, 'CMP_PHN_BLNK_ADDR', 4,
              count(*) FILTER (company_std <> '' AND phone_std <> '' AND NOT has_address1 AND NOT has_zip) FROM keyed""",
        "b9_condition": conditions(),
        "b10_rule_scores": f"""{BEST} SELECT a AS RID, match_reason AS MATCH_REASON, round(company_sim, 2) AS company_name_score,
            CASE WHEN rank = 1 THEN round(address1_sim, 2) END AS address_line_1_score,
            CASE WHEN rank = 1 AND address2_both THEN round(address2_sim, 2) END AS address_line_2_score,
            CASE WHEN rank = 1 THEN round(zip_sim, 2) END AS zip_code_score,
            CASE WHEN rank = 2 THEN phone_sim END AS phone_number_score FROM best""",
        "b11_required_report": f"""{of_contacts}, {CATALOG_TABLE}, {FILLED}, seen AS (
              SELECT c.name, pos, present AND c.name <> 'SOURCE_ID' AS present, CASE WHEN c.name = 'SOURCE_ID' THEN 0 ELSE filled END AS filled
              FROM catalog c JOIN filled f ON f.name = c.name WHERE required)
            SELECT name AS required_column, present, filled, (SELECT count(*) FROM contacts) - filled AS blank FROM seen""",
        "b13_bad_rows": f"""{of_contacts} SELECT count(*) AS records, count(*) FILTER (contains(COMPANY_NAME, ',')) AS errors FROM contacts""",
        "b13_error_rows": f"""{of_contacts} SELECT RID, contains(COMPANY_NAME, ',') AS is_error, CASE WHEN contains(COMPANY_NAME, ',') THEN true END AS has_text,
            contains(COMPANY_NAME, ',') AS no_key, {total}, (SELECT count(*) FROM contacts WHERE contains(COMPANY_NAME, ',')) AS errors FROM contacts""",
        "c1_candidate_pairs": f"""WITH {CLEAN}, pairs AS ({BLOCK_PAIRS})
            SELECT k.RID, k.block_key, count(p.b) AS n_candidates, min(p.b) AS first_candidate, max(p.b) AS last_candidate
            FROM keyed k LEFT JOIN pairs p ON p.a = k.RID GROUP BY k.RID, k.block_key""",
        "c2_rule_match": f"{BEST} SELECT a AS RID, rule_id, min(b) AS match_rid FROM matched GROUP BY a, rule_id",
        "c3_key_lookup": f"WITH {CLEAN}, {CRM_STORE} SELECT RID, k.data_hash, stored_key FROM keyed k LEFT JOIN stored s ON s.data_hash = k.data_hash",
        "c4_new_hashes": f"WITH {CLEAN}, {CRM_STORE} SELECT DISTINCT data_hash FROM keyed WHERE data_hash NOT IN (SELECT data_hash FROM stored)",
        "c5_seen_hashes": f"WITH {CLEAN}, {CRM_STORE} SELECT DISTINCT data_hash FROM keyed WHERE data_hash IN (SELECT data_hash FROM stored)",
        "c6_domain_lookup": f"""WITH {CLEAN} SELECT RID, split_part(email_std, '@', -1) IN ({quoted(quality.PERSONAL_DOMAINS)}) AS personal_domain,
            split_part(email_std, '@', 1) IN ({quoted(quality.GENERIC_MAILBOXES)}) AS generic_mailbox,
            split_part(email_std, '@', 1) IN ({quoted(quality.ADMIN_MAILBOXES)}) AS admin_mailbox,
            split_part(email_std, '@', 1) IN ({quoted(quality.DEPARTMENT_MAILBOXES)}) AS department_mailbox,
            substr(phone_std, 1, 3) IN ({quoted(quality.TOLL_FREE_CODES)}) AS toll_free FROM clean""",
        "c9_master_key": f"{given_run} SELECT RID, dedup_key AS DEDUP_KEY, reason AS MATCH_REASON FROM outcome",
        "d1_block_stats": f"""WITH {CLEAN} SELECT block_key, count(*) AS rows, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs
            FROM keyed GROUP BY block_key""",
        "d1_block_plan": f"""WITH {CLEAN},
            able AS (SELECT *, substr(coalesce(ZIP_CODE, ''), 1, 1) AS block FROM keyed WHERE company_t <> ''),
            large AS (SELECT * FROM able WHERE block IN (SELECT block FROM able GROUP BY block HAVING count(*) > 128)),
            ruled AS (
              SELECT 'PLACE' AS rule_id, block, concat(zip_t, '/', phone_std) AS everything, zip_t AS first, phone_std AS second FROM large WHERE zip_t <> '' AND phone_std <> ''
              UNION ALL SELECT 'ADDRESS', block, address1_t, address1_t, NULL FROM large WHERE address1_t <> ''
              UNION ALL SELECT 'NAME', block, '', NULL, NULL FROM large),
            whole AS (SELECT rule_id, block, count(*) AS rows FROM ruled GROUP BY ALL),
            remain AS (SELECT rule_id, block, sum(n * (n - 1) // 2) AS remaining FROM (SELECT rule_id, block, everything, count(*) AS n FROM ruled GROUP BY ALL) GROUP BY ALL),
            valued AS (SELECT rule_id, block, CASE rule_id WHEN 'PLACE' THEN 'ZIP_CODE' ELSE 'ADDRESS_LINE_1' END AS key, 1 AS place, first AS value FROM ruled WHERE first IS NOT NULL
              UNION ALL SELECT rule_id, block, 'PHONE_NUMBER', 2, second FROM ruled WHERE second IS NOT NULL),
            costs AS (SELECT rule_id, block, key, place, sum(n * (n - 1) // 2) AS cost
              FROM (SELECT rule_id, block, key, place, value, count(*) AS n FROM valued GROUP BY ALL) GROUP BY ALL),
            chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, block ORDER BY cost, place) AS r FROM costs) WHERE r = 1)
            SELECT block AS block_key, rule_id, rows, CAST(rows * (rows - 1) // 2 AS BIGINT) AS pairs, key AS extra_key,
              CAST(coalesce(cost, rows * (rows - 1) // 2) AS BIGINT) AS pairs_with_key, CAST(remaining AS BIGINT) AS pairs_left
            FROM whole JOIN remain USING (rule_id, block) LEFT JOIN chosen USING (rule_id, block)""",
        "d2_run_stats": f"""{run} SELECT count(*) AS total_records, count(*) FILTER (b IS NOT NULL) AS matched_existing,
            count(*) FILTER (b IS NULL AND is_new) AS new_dedup_keys, CAST(0 AS BIGINT) AS errors FROM resolved""",
        "d3_key_identifiers": f"{run} SELECT dedup_key, string_agg(identifier, '|' ORDER BY first_at) AS identifiers FROM links GROUP BY dedup_key",
        "d4_key_hashes": f"""{run} SELECT dedup_key, string_agg(data_hash, '|' ORDER BY data_hash) AS data_hashes FROM (
              SELECT DISTINCT dedup_key, data_hash FROM resolved) GROUP BY dedup_key""",
        "d6_group_catalog": f"""{of_contacts}, {CATALOG_TABLE}, {FILLED}
            SELECT grp AS column_group, string_agg(c.name, ',' ORDER BY c.name) AS columns, CAST(sum(filled) AS BIGINT) AS filled
            FROM catalog c JOIN filled f ON f.name = c.name GROUP BY grp""",
        "d8_quality_profile": quality_table() + " " + " UNION ALL ".join(
            f"SELECT '{c}' AS criterion, count(*) FILTER ({c} > 0) AS records_with_points, min({c}) AS min_points, max({c}) AS max_points, "
            f"CAST(sum({c}) AS BIGINT) AS sum_points, round(avg({c}), 6) AS avg_points FROM quality"
            for c in (*EMAIL_COLUMNS, *PHONE_COLUMNS)
        ),
        "d9_reason_counts": f"{run} SELECT reason AS MATCH_REASON, count(*) AS records FROM resolved GROUP BY reason",
        "e1_best_match": f"{BEST} SELECT a AS RID, b AS match_rid, rule_id, match_reason FROM best",
        "e1_large_block": large_block(),
        "e2_hot_hash": f"{resolved(HOT_GIVEN, best=BEST.replace(CONTACTS, HOT_CONTACTS))} SELECT RID, dedup_key AS DEDUP_KEY, is_new FROM resolved",
        "e3_hot_key": f"""{resolved(HOT_KEY)}, counted AS (
              SELECT r.RID, r.dedup_key, r.b, count(l.first_at) AS n, arg_max(l.identifier, l.first_at) AS last
              FROM resolved r LEFT JOIN links l ON l.dedup_key = r.dedup_key AND l.first_at <= r.RID GROUP BY r.RID, r.dedup_key, r.b)
            SELECT RID, dedup_key AS DEDUP_KEY, CASE WHEN b IS NULL THEN 0 ELSE n END AS n_ids, CASE WHEN b IS NOT NULL THEN last END AS last_id FROM counted""",
        "e2_resolve_keys": f"{resolved(GIVEN, CRM_STORE)} SELECT RID, dedup_key AS DEDUP_KEY, is_new FROM resolved",
        "e3_matched_ids": f"{given_run} SELECT RID, ids AS MATCHED_RECORD_IDS FROM outcome",
        "f1_result_union": f"""{run} SELECT r.RID, dedup_key AS DEDUP_KEY, reason AS MATCH_REASON, round(company_sim, 2) AS company_name_score
            FROM resolved r LEFT JOIN best ON best.a = r.RID""",
        "f3_mapping_upsert": f"""{resolved(GIVEN, CRM_STORE)},
            last_given AS (SELECT data_hash, arg_max(explicit_key, RID) AS key FROM resolved WHERE explicit_key IS NOT NULL GROUP BY data_hash)
            SELECT h.data_hash, coalesce(g.key, s.stored_key, {minted('h.data_hash')}) AS dedup_key
            FROM (SELECT DISTINCT data_hash FROM keyed) h LEFT JOIN last_given g ON g.data_hash = h.data_hash
            LEFT JOIN stored s ON s.data_hash = h.data_hash""",
        "h1_normalize_text": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
        "h2_company_std": f"WITH {CLEAN} SELECT RID, company_std FROM clean",
        "h3_address_std": f"WITH {CLEAN} SELECT RID, address1_std AS address_std FROM clean",
        "h4_phone_std": f"WITH {CLEAN} SELECT RID, phone_std FROM clean",
        "h5_email_std": f"WITH {CLEAN} SELECT RID, email_std FROM clean",
        "h7_token_sort": f"""{NEIGHBOURS}, sorted AS (SELECT RID, {tokens('COMPANY_NAME')} AS t FROM keyed)
            SELECT p.a AS RID, p.b AS other, round({ratio('l.t', 'r.t')}, 6) AS score
            FROM pairs p JOIN sorted l ON l.RID = p.a JOIN sorted r ON r.RID = p.b""",
        "h8_ratio": f"""{NEIGHBOURS}, stripped AS (SELECT RID, {strip('COMPANY_NAME')} AS t FROM keyed)
            SELECT p.a AS RID, p.b AS other, round({ratio('l.t', 'r.t')}, 6) AS score
            FROM pairs p JOIN stripped l ON l.RID = p.a JOIN stripped r ON r.RID = p.b""",
        "h9_token_set": token_set(),
        "h10_partial": f"""{NEIGHBOURS}, stripped AS (SELECT RID, {strip('COMPANY_NAME')} AS t FROM keyed),
            sides AS (SELECT p.a, p.b, l.t AS x, r.t AS y FROM pairs p JOIN stripped l ON l.RID = p.a JOIN stripped r ON r.RID = p.b),
            ways AS (SELECT a, b, x AS s, y AS t FROM sides WHERE length(x) <= length(y) UNION SELECT a, b, y, x FROM sides WHERE length(y) <= length(x)),
            spans AS (SELECT a, b, s, t, unnest(range(1 - length(s), length(t))) AS i FROM ways WHERE s <> ''),
            windows AS (SELECT a, b, s, substr(t, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) AS w FROM spans),
            scores AS (SELECT s, w, {ratio('s', 'w')} AS score FROM (SELECT DISTINCT s, w FROM windows))
            SELECT sides.a AS RID, sides.b AS other, coalesce(best, 0.0::DOUBLE) AS score FROM sides LEFT JOIN (
              SELECT a, b, round(max(score), 6) AS best FROM windows JOIN scores USING (s, w) GROUP BY a, b) USING (a, b)""",
        "h11_compare": f"""{NEIGHBOURS} SELECT p.a AS RID, p.b AS other, round({ratio('l.company_t', 'r.company_t')}, 6) AS company,
            round({ratio('l.address1_t', 'r.address1_t')}, 6) AS address {PAIR_SIDES}""",
        "h12_exact_compare": f"""{NEIGHBOURS} SELECT p.a AS RID, p.b AS other, {exact('l.phone_std', 'r.phone_std')} AS phone,
            {exact('l.email_std', 'r.email_std')} AS email {PAIR_SIDES}""",
        "h13_email_quality": f"{quality_table()} SELECT RID, {', '.join(EMAIL_COLUMNS)} FROM quality",
        "h14_phone_quality": f"{quality_table()} SELECT RID, {', '.join(PHONE_COLUMNS)} FROM quality",
        "h15_quality_columns": f"{quality_table()} SELECT RID, {', '.join((*EMAIL_COLUMNS, *PHONE_COLUMNS))} FROM quality",
        "h16_address_confidence": f"{BEST} SELECT a AS RID, round({address_score}, 2) AS address_confidence FROM best",
        "h17_overall_confidence": f"{BEST} SELECT a AS RID, round({overall}, 2) AS overall_confidence FROM best",
        "h18_block_key": f"WITH {CLEAN} SELECT RID, block_key FROM keyed",
        "h19_data_hash": f"WITH {CLEAN} SELECT RID, data_hash FROM keyed",
        "i1_incremental": f"WITH {CLEAN} SELECT RID, {minted('data_hash')} AS DEDUP_KEY FROM keyed",
        "i1_levelled": f"""WITH {CLEAN} SELECT RID, {minted('data_hash')} AS DEDUP_KEY, CASE WHEN RID % 7 = 0 THEN 2 ELSE 1 END AS times,
            CAST(0 AS BIGINT) AS new_again FROM keyed""",
        "i1_stateful": f"""WITH {CLEAN}, old AS (SELECT DISTINCT data_hash AS h FROM keyed WHERE upper(trim(SOURCE_TYPE)) = 'CRM')
            SELECT data_hash, CASE WHEN h IS NULL THEN {minted('data_hash')} ELSE concat('OLD-', data_hash) END AS dedup_key, min(RID) AS first_rid,
              count(*) + count(*) FILTER (RID % 3 = 0) AS n_records, CASE WHEN h IS NULL THEN 1 ELSE 0 END AS times_new
            FROM keyed LEFT JOIN old ON h = data_hash GROUP BY data_hash, h""",
        "i2_stream_quality": f"{quality_table()} SELECT RID, email_quality_total, phone_quality_total FROM quality",
        "k1_clusters": f"""{BEST}, edges AS (SELECT a, b FROM matched UNION SELECT b, a FROM matched),
            reach AS (SELECT RID AS node, RID AS root FROM keyed UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
            member AS (SELECT node AS RID, min(root) AS cluster FROM reach GROUP BY node),
            keys AS (SELECT cluster, count(*) AS cluster_size, min(data_hash) AS h FROM member m JOIN keyed k ON k.RID = m.RID GROUP BY cluster)
            SELECT RID, m.cluster, cluster_size, {minted('h')} AS dedup_key FROM member m JOIN keys ON keys.cluster = m.cluster""",
        "k1_merge_runs": f"""{BEST}, edges AS (SELECT a, b FROM matched UNION SELECT b, a FROM matched),
            reach AS (SELECT RID AS node, RID AS root FROM keyed UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
            member AS (SELECT node AS RID, min(root) AS cluster FROM reach GROUP BY node),
            hashes AS (SELECT DISTINCT cluster, data_hash AS h FROM member JOIN keyed USING (RID)),
            together AS (SELECT DISTINCT x.h AS a, y.h AS b FROM hashes x JOIN hashes y USING (cluster)),
            merged(h, key) AS (SELECT DISTINCT h, {minted('h')} FROM hashes UNION SELECT t.b, m.key FROM merged m JOIN together t ON t.a = m.h),
            keys AS (SELECT h, min(key) AS key FROM merged GROUP BY h)
            SELECT RID, key AS second_key, CASE WHEN RID % 4 <> 1 THEN key END AS first_key_now, (SELECT count(DISTINCT key) FROM keys) AS stored_keys
            FROM keyed JOIN keys ON h = data_hash""",
        "k2_multi_block": f"WITH {CLEAN}, {scored(many)}, {MATCHED} SELECT a AS RID, b AS match_rid, rule_id FROM best",
        "k2_block_gains": f"""WITH {CLEAN}, shared AS (
              SELECT coalesce(k.block_key = o.block_key, false) AS in_0, k.phone_std <> '' AND k.phone_std = o.phone_std AS in_1, {address_key} AS in_2
              FROM keyed k JOIN (SELECT a, b FROM ({many})) ON a = k.RID JOIN keyed o ON o.RID = b)
            SELECT CAST(0 AS INT) AS blocking, count(*) FILTER (in_0) AS pairs, count(*) FILTER (in_0) AS compared FROM shared
            UNION ALL SELECT 1, count(*) FILTER (in_1), count(*) FILTER (in_1 AND NOT in_0) FROM shared
            UNION ALL SELECT 2, count(*) FILTER (in_2), count(*) FILTER (in_2 AND NOT in_0 AND NOT in_1) FROM shared""",
        "k2_run": f"""{resolved(best=f"WITH RECURSIVE {CLEAN}, {scored(many)}, {MATCHED}")}
            SELECT RID, reason AS MATCH_REASON, is_new FROM resolved""",
        "k3_soundex_block": f"""WITH {CLEAN}, sounds AS (
              SELECT *, {soundex("split_part(company_std, ' ', 1)")} AS sound, substr(coalesce(ZIP_CODE, ''), 1, 5) AS zip FROM keyed),
            {scored("SELECT l.RID AS a, r.RID AS b FROM sounds l JOIN sounds r ON l.sound = r.sound AND l.zip = r.zip AND l.company_std <> '' AND r.RID > l.RID")},
            {MATCHED} SELECT a AS RID, b AS match_rid, rule_id FROM best""",
        "k4_levenshtein": f"""{NEIGHBOURS} SELECT p.a AS RID, p.b AS other, round(CASE WHEN l.company_std <> '' AND r.company_std <> '' THEN
            (1.0::DOUBLE - levenshtein(l.company_std, r.company_std)::DOUBLE / greatest(length(l.company_std), length(r.company_std))::DOUBLE) * 100.0::DOUBLE
            ELSE 0.0 END, 6) AS score {PAIR_SIDES}""",
        "k4_rule_levenshtein": f"""WITH {CLEAN}, pairs AS ({BLOCK_PAIRS}), scores AS (
              SELECT p.a, p.b, (1.0::DOUBLE - levenshtein(l.company_t, r.company_t)::DOUBLE / greatest(length(l.company_t), length(r.company_t))::DOUBLE) * 100.0::DOUBLE AS score
              {PAIR_SIDES} WHERE l.has_company AND r.has_company AND l.has_zip AND r.has_zip AND l.zip_t = r.zip_t AND l.company_t <> '' AND r.company_t <> '')
            SELECT a AS RID, min(b) AS match_rid, round(arg_min(score, b), 6) AS score FROM scores WHERE score >= 80 GROUP BY a""",
        "k_engine_version": f"{of_contacts} SELECT RID, '1.0' AS MATCHING_ENGINE_VERSION, '2024-01-01T00:00:00.000000' AS MATCH_TIMESTAMP FROM contacts",
        "k5_threshold_fallback": f"""WITH {CLEAN}, {scored(BLOCK_PAIRS)} SELECT a AS RID, min(b) AS match_rid, 'BY_THRESHOLD' AS match_reason
            FROM sims WHERE company_both AND company_sim >= 80 AND address1_both AND address1_sim >= 80
            AND (NOT address2_both OR address2_sim >= 90) AND zip_both AND zip_sim >= 100 GROUP BY a""",
        "k6_confidence": f"""{BEST} SELECT a AS RID, round(company_sim, 2) AS company_confidence, round({address_score}, 2) AS address_confidence,
            0.0::DOUBLE AS email_confidence, CASE WHEN rank = 2 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS phone_confidence FROM best""",
        "k7_quality_bands": f"""{quality_table()} SELECT RID, {band('email_quality_total', quality.EMAIL_BANDS)} AS email_quality_band,
            {band('phone_quality_total', quality.PHONE_BANDS)} AS phone_quality_band FROM quality""",
    }
    return out
