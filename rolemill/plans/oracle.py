"""The same jobs corpus in DuckDB SQL, written independently of the operators.

``with_jobs(select)`` prefixes a query with the common table expressions it needs.
"""

import re

from rolemill import vocab
from rolemill.operators.aggregates import BREAKDOWNS, FACETS
from rolemill.plans import corpus


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def sub(text: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {by}, 'g')"


def group(text: str, pattern: str, i: int) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {i})"


def strip(text: str) -> str:
    return sub(text, r"^\s+|\s+$")


def label(text: str, patterns) -> str:
    arms = " ".join(f"WHEN {has(text, p)} THEN {q(n)}" for n, p in patterns)
    return f"CASE {arms} END"


def html_to_text(html: str) -> str:
    t = f"coalesce({html}, '')"
    t = sub(t, vocab.BREAK_TAG, "chr(10)")
    t = sub(t, vocab.LIST_ITEM_TAG, "chr(10) || '- '")
    t = sub(t, vocab.ANY_TAG, "' '")
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"),
                         ("&amp;?", "&")):
        t = sub(t, entity, q(char))
    t = sub(t, vocab.BLANK_RUN, "' '")
    return strip(sub(t, vocab.NEWLINE_RUN, "chr(10) || chr(10)"))


def company_key(name: str) -> str:
    s = sub(sub(strip(f"lower({name})"), vocab.COMPANY_QUOTES), vocab.COMPANY_OTHER, "' '")
    return (f"coalesce(nullif(array_to_string(list_filter(regexp_split_to_array({s}, "
            f"'\\s+'), lambda w: w <> '' AND NOT list_contains("
            f"{sql_list(vocab.LEGAL_SUFFIXES)}, trim(w, '.'))), ' '), ''), "
            f"{strip(f'lower({name})')})")


def title_norm(title: str) -> str:
    s = sub(f"lower({title})", vocab.TITLE_BRACKETED, "' '")
    s = sub(s, "(?i)" + vocab.TITLE_NOISE, "' '")
    s = sub(sub(s, vocab.TITLE_OTHER, "' '"), r"\s+", "' '")
    return f"trim({s}, ' -/')"


STATES = ("map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in vocab.US_STATES.items()) + "}")
WORDS = sql_list(vocab.NUMBER_WORDS)


def amount(i: int) -> str:
    g = group("pay_match", vocab.SALARY_AMOUNT, i)
    k = group("pay_match", vocab.SALARY_AMOUNT, i + 1)
    return (f"CASE WHEN {g} <> '' THEN CAST(replace({g}, ',', '') AS DOUBLE) "
            f"* CASE WHEN {k} <> '' THEN 1000 ELSE 1 END END")


def annual(value: str, period: str) -> str:
    arms = " ".join(f"WHEN {q(p)} THEN {n}" for p, n in vocab.PERIODS_PER_YEAR.items())
    return (f"round({value} * CASE lower(coalesce({period}, 'yearly')) {arms} "
            f"ELSE 1.0 END, 2)")


def board(url: str) -> str:
    """'platform:token' of a board URL, NULL otherwise."""
    host = f"lower(regexp_extract({url}, '^https?://([^/?#]+)', 1))"
    path = f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)"
    query = f"regexp_extract({url}, '[?]([^#]*)', 1)"
    sub_host = f"split_part({host}, '.', 1)"
    reserved = sql_list(vocab.BOARD_RESERVED)
    arms = []
    for pattern, name, path_pattern in vocab.BOARD_HOSTS:
        usable_sub = (f"CASE WHEN NOT list_contains({reserved}, {sub_host}) "
                      f"THEN {sub_host} END")
        if path_pattern is None:
            token = usable_sub
        else:
            t = f"nullif(regexp_extract({path}, {q(path_pattern)}, 1), '')"
            skipped = sql_list(vocab.BOARD_SUBDOMAINS_SKIPPED)
            token = (f"coalesce(nullif(regexp_extract({query}, 'for=([A-Za-z0-9_-]+)', 1), ''), "
                     f"CASE WHEN NOT list_contains({reserved}, lower({t})) THEN {t} END, "
                     f"CASE WHEN NOT list_contains({skipped}, {sub_host}) THEN {usable_sub} END)")
        arms.append(f"WHEN {has(host, pattern)} THEN {q(name + ':')} || {token}")
    return f"CASE {' '.join(arms)} END"


RAW = "SELECT " + ", ".join(
    f"{corpus.render(e, 'duckdb')} AS {n}" for n, e in corpus.POSTING.items()
) + " FROM orders JOIN customer ON o_custkey = c_custkey"

TEXTED = ("SELECT * REPLACE (coalesce(nullif(description_text, ''), "
          f"nullif({html_to_text('description_html')}, '')) AS description_text) FROM raw")

_PLACE = sub(sub(strip("coalesce(location_raw, '')"), vocab.ZIP_CODE), vocab.US_WORDS)
_WINDOW = "description_text"
STAGED = f"""SELECT *,
  {group('description_text', vocab.SALARY_AMOUNT, 0)} AS pay_match,
  list_filter(list_transform(string_split({_PLACE}, ','), lambda p: trim(p, ' ,-')),
              lambda p: p <> '') AS parts,
  coalesce(city, '') = '' OR coalesce(state, '') = '' AS incomplete,
  nullif({group("coalesce(location_raw, '')", vocab.ZIP_CODE, 1)}, '') AS zip,
  try_cast({group(_WINDOW, vocab.YEARS_RANGE, 1)} AS INTEGER) AS range_low,
  try_cast({group(_WINDOW, vocab.YEARS_RANGE, 2)} AS INTEGER) AS range_high,
  coalesce(list_min(list_filter(list_transform(regexp_extract_all({_WINDOW},
    {q(vocab.YEARS_SINGLE)}, 1), lambda x: CAST(x AS INTEGER)),
    lambda y: y > 0 AND y <= 30)),
    nullif(list_position({WORDS}, lower({group(_WINDOW, r"(?i)\b(" + "|".join(
        vocab.NUMBER_WORDS) + r")\s*\+?\s*(?:years?|yrs?)", 1)})), 0)) AS single_years,
  lower(concat_ws(' ', title, nullif(location_raw, ''),
        nullif(description_text, ''))) AS place_blob,
  lower(concat_ws(' ', nullif(employment_type, ''), title,
        nullif(description_text, ''))) AS type_blob,
  title || chr(10) || coalesce(description_text, '') AS flag_blob
FROM texted"""

_TAIL = "parts[-1]"
STAGED2 = f"""SELECT *,
  CASE WHEN list_contains(map_values({STATES}), upper({_TAIL})) THEN upper({_TAIL})
       ELSE {STATES}[lower({_TAIL})] END AS parsed_state,
  {amount(1)} AS low_pay, {amount(3)} AS high_pay,
  lower(substr(description_text,
    greatest(1, strpos(description_text, pay_match) - 60),
    strpos(description_text, pay_match) + length(pay_match) + 60
    - greatest(1, strpos(description_text, pay_match) - 60))) AS pay_text,
  coalesce(range_low <= 40 AND range_low <= range_high AND range_high <= 40, FALSE)
    AS ranged,
  coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0 AS structured,
  CASE WHEN {has('place_blob', vocab.HYBRID)} THEN 'hybrid'
       WHEN {has('place_blob', vocab.REMOTE)} THEN
         CASE WHEN {has('place_blob', vocab.NOT_REMOTE)} THEN 'onsite' ELSE 'remote' END
       WHEN {has('place_blob', vocab.ONSITE)} THEN 'onsite' ELSE 'unknown' END AS detected
FROM staged"""

_BY_SIZE = " ".join(f"WHEN low_pay < {c} THEN {q(n)}" for n, c in vocab.PERIOD_CEILINGS)
_HINTS = " ".join(f"WHEN {has('pay_text', p)} THEN {q(n)}" for n, p in vocab.PERIOD_HINTS)
_CITY = f"""CASE WHEN len(parts) > CASE WHEN parsed_state IS NOT NULL THEN 1 ELSE 0 END
  AND NOT list_contains({sql_list(vocab.NOT_A_CITY)}, lower(parts[1])) THEN parts[1] END"""
STAGED3 = f"""SELECT * REPLACE (
  CASE WHEN structured THEN salary_min WHEN pay_match <> ''
       THEN least(low_pay, coalesce(high_pay, low_pay)) END AS salary_min,
  CASE WHEN structured THEN salary_max WHEN high_pay IS NOT NULL
       THEN greatest(low_pay, high_pay) END AS salary_max,
  CASE WHEN structured THEN
         CASE WHEN lower(coalesce(salary_period, 'yearly')) IN
           ({", ".join(q(x) for x in vocab.YEARLY_SYNONYMS)}) THEN 'yearly'
           ELSE lower(salary_period) END
       WHEN pay_match <> '' THEN CASE {_HINTS} WHEN low_pay IS NULL THEN 'yearly'
         {_BY_SIZE} ELSE 'yearly' END END AS salary_period,
  structured AND coalesce(salary_is_estimated, FALSE) AS salary_is_estimated,
  CASE WHEN incomplete THEN coalesce(nullif(city, ''), {_CITY}) ELSE city END AS city,
  CASE WHEN incomplete THEN coalesce(nullif(state, ''), parsed_state) ELSE state END AS state,
  CASE WHEN incomplete THEN coalesce(postal_code, zip) ELSE postal_code END AS postal_code,
  coalesce(country, 'US') AS country,
  {label('type_blob', vocab.EMPLOYMENT_PATTERNS)} AS employment_type
) FROM staged2"""

JOBS = f"""SELECT * EXCLUDE (pay_match, parts, incomplete, zip, range_low, range_high,
    single_years, place_blob, type_blob, low_pay, high_pay, pay_text, parsed_state,
    structured, company_name),
  company_name AS company_name_raw,
  {title_norm('title')} AS title_normalized,
  {company_key('company_name')} AS company_key,
  CASE WHEN detected = 'hybrid' THEN 'hybrid' WHEN is_remote THEN 'remote'
       ELSE detected END AS work_arrangement,
  CASE WHEN ranged THEN range_low ELSE single_years END AS years_experience_min,
  CASE WHEN ranged THEN range_high END AS years_experience_max,
  coalesce({label('lower(title)', vocab.LEVEL_PATTERNS)},
    CASE WHEN (CASE WHEN ranged THEN range_low ELSE single_years END) >= 8 THEN 'senior'
         WHEN (CASE WHEN ranged THEN range_low ELSE single_years END) >= 3 THEN 'mid'
         WHEN (CASE WHEN ranged THEN range_low ELSE single_years END) >= 0 THEN 'entry' END,
    {label('lower(description_text)', vocab.LEVEL_PATTERNS)}) AS experience_level,
  {label(f'lower({_WINDOW})', vocab.EDUCATION_PATTERNS)} AS education_level,
  {annual('salary_min', 'salary_period')} AS salary_annualized_min,
  {annual('salary_max', 'salary_period')} AS salary_annualized_max,
  CASE WHEN {has('flag_blob', vocab.SPONSOR_NO)} THEN FALSE
       WHEN {has('flag_blob', vocab.SPONSOR_YES)} THEN TRUE END AS visa_sponsorship_mentioned,
  CASE WHEN {has('flag_blob', vocab.RELOCATION_NO)} THEN FALSE
       WHEN {has('flag_blob', vocab.RELOCATION_YES)} THEN TRUE END AS relocation_mentioned,
  CASE WHEN {has('flag_blob', vocab.URGENT)} THEN TRUE END AS urgently_hiring,
  {has('flag_blob', vocab.AGENCY)} AS is_recruitment_agency,
  list_filter([{', '.join(f"CASE WHEN {has('lower(coalesce(description_text, chr(32)))', p)} THEN {q(n)} END" for n, p in vocab.BENEFIT_PATTERNS)}],
    lambda x: x IS NOT NULL) AS benefits,
  coalesce({board('apply_url')}, {board('job_url')}) AS board,
  sha1(concat_ws('|', {title_norm('title')}, {company_key('company_name')},
    lower(coalesce(city, '')), upper(coalesce(state, '')))) AS canonical_hash
FROM staged3"""

# Each alias with every delimiter doubled, so that a boundary character can be
# consumed on both sides of neighbouring mentions.
_DELIMITER = r"([^\w+#])"


def _alias_pattern() -> str:
    aliases = sorted(corpus.MATCHER.aliases, key=len, reverse=True)
    doubled = [re.sub(_DELIMITER, r"\1\1", a) for a in aliases]
    return r"(?:^|[^\w+#])(" + "|".join(re.escape(a) for a in doubled) + r")(?:$|[^\w+#])"


ALIAS_PATTERN = _alias_pattern()
_ALIAS_MAP = "map {" + ", ".join(
    f"{q(re.sub(_DELIMITER, chr(92) + '1' + chr(92) + '1', a))}: {q(s)}"
    for a, s in corpus.MATCHER.aliases.items()) + "}"
_CATEGORY_MAP = "map {" + ", ".join(
    f"{q(s)}: {q(c)}" for s, c in corpus.MATCHER.categories.items()) + "}"

_SPLIT = f"""SELECT job_id, g, t, a, unnest(range(1, len(t) + 1)) AS i FROM (
  SELECT job_id, regexp_split_to_array(x, {q(ALIAS_PATTERN)}) AS g,
    regexp_extract_all(x, {q(ALIAS_PATTERN)}) AS t,
    regexp_extract_all(x, {q(ALIAS_PATTERN)}, 1) AS a
  FROM (SELECT job_id, regexp_replace(lower(coalesce(description_text, '')),
          {q(_DELIMITER)}, '\\1\\1', 'g') AS x FROM jobs)) WHERE len(t) > 0"""
_BEFORE = """array_to_string(list_transform(range(1, i), lambda j: g[j] || t[j]), '') || g[i]
  || CASE WHEN starts_with(t[i], a[i]) THEN '' ELSE left(t[i], 1) END"""
_FIRST_AT = "length(regexp_extract(w, {p}, 1))"
_PREF = q("(?s)^(.*?)" + vocab.PREFERRED_HEADING.replace("(preferred", "(?:preferred", 1))
_REQ = q("(?s)^(.*?)" + vocab.REQUIRED_HEADING.replace("(required", "(?:required", 1))
MENTIONS = f"""SELECT job_id, {_ALIAS_MAP}[a[i]] AS skill, i,
  CASE WHEN regexp_matches(w, {q(vocab.PREFERRED_HEADING)}) AND (
         NOT regexp_matches(w, {q(vocab.REQUIRED_HEADING)})
         OR {_FIRST_AT.format(p=_PREF)} > {_FIRST_AT.format(p=_REQ)}) THEN 'preferred'
       WHEN regexp_matches(w, {q(vocab.REQUIRED_HEADING)}) THEN 'required'
       ELSE 'mentioned' END AS cls
FROM (SELECT *, right(regexp_replace({_BEFORE}, '([^\\w+#])[^\\w+#]', '\\1', 'g'), 700) AS w
      FROM split)"""
JOB_SKILLS = """SELECT job_id, skill, coalesce(arg_min(cls, i) FILTER (cls <> 'mentioned'),
  'mentioned') AS requirement, count(*) AS mention_count FROM mentions GROUP BY ALL"""

COMPANIES = f"""SELECT m.*, c_mktsegment AS industry, CAST(floor(c_acctbal) AS BIGINT)
    AS size_estimate, coalesce(n, 0) AS jobs_discovered,
    round(coalesce(recent, 0) / 4.3, 2) AS hiring_frequency_30d FROM (
  SELECT company_key, arg_min(company_name_raw, seq) AS name,
    arg_min(company_domain, seq) AS domain, arg_min(company_website, seq) AS website,
    arg_min(board, seq) AS board_id,
    split_part(arg_min(board, seq), ':', 1) AS ats_platform,
    split_part(arg_min(board, seq), ':', 2) AS ats_board_token,
    min(date_collected) AS first_seen_at, max(date_collected) AS last_seen_at
  FROM jobs GROUP BY 1) m
JOIN customer ON lower(replace(c_name, '#', ' ')) = m.company_key
LEFT JOIN (SELECT company_key, count(*) AS n, count(*) FILTER (
    date_posted >= {corpus.AS_OF_SQL} - INTERVAL 30 DAY) AS recent
  FROM jobs WHERE is_primary GROUP BY 1) c USING (company_key)"""

RESEARCH = ("SELECT " + ", ".join(f"{e} AS {n}" for n, e in corpus.RESEARCH.items())
            + f" FROM orders WHERE {corpus.RESEARCH_WHERE}")
JOB_TAGS = " UNION ALL ".join(
    f"SELECT o_orderkey AS job_id, {corpus.tag_sql(i)} AS tag FROM orders "
    f"WHERE o_orderkey % 5 = 2" for i in (0, 1))


def _values() -> str:
    types = {"value_text": "VARCHAR", "value_number": "DOUBLE", "value_bool": "BOOLEAN",
             "value_date": "TIMESTAMP", "value_json": "VARCHAR"}
    parts = []
    for key, (column, value, where) in corpus.VALUE_SQL.items():
        cells = ", ".join(f"CAST({value if c == column else 'NULL'} AS {t}) AS {c}"
                          for c, t in types.items())
        parts.append(f"SELECT {q(key)} AS key, 'job' AS entity, o_orderkey AS entity_id, "
                     f"{cells} FROM orders WHERE {where}")
    return " UNION ALL ".join(parts)


CTES = {
    "raw": RAW, "texted": TEXTED, "staged": STAGED, "staged2": STAGED2,
    "staged3": STAGED3, "jobs": JOBS, "split": _SPLIT, "mentions": MENTIONS,
    "job_skills": JOB_SKILLS, "companies": COMPANIES, "research": RESEARCH,
    "job_tags": JOB_TAGS, "custom_values": _values(),
    "scope": "SELECT * FROM jobs WHERE is_primary AND is_active",
}


def with_ctes(select: str, *extra: tuple[str, str]) -> str:
    """The statement with every common table expression it names, in order."""
    tables = {**CTES, **dict(extra)}
    needed, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name, body in tables.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|USING)\s+{name}\b", text):
                needed.add(name)
                queue.append(body)
    parts = ", ".join(f"{n} AS ({b})" for n, b in tables.items() if n in needed)
    return f"WITH RECURSIVE {parts} {select}" if parts else select


def simhash(source: str, key: str, text: str) -> str:
    """(key, simhash) in SQL, signed 64-bit."""
    bits = " + ".join(
        f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UHUGEINT "
        f"ELSE 0::UHUGEINT END" for i in range(64))
    return (f"SELECT {key}, CASE WHEN v >= 9223372036854775808 THEN "
            f"CAST(v::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(v AS BIGINT) END "
            f"AS simhash FROM (SELECT {key}, {bits} AS v FROM ("
            f"SELECT {key}, CAST('0x' || left(md5(w), 16) AS UBIGINT) AS h FROM ("
            f"SELECT {key}, unnest(regexp_extract_all(lower({text}), {q(vocab.WORD)})) AS w "
            f"FROM {source})) GROUP BY {key} HAVING count(*) >= {vocab.MIN_SIMHASH_TOKENS})")


def top_dims(scope: str, limits: dict, extra: str = "") -> str:
    parts = [f"SELECT {q(d)} AS dim, CAST({d} AS VARCHAR) AS value, count(*) AS n, {k} AS most "
             f"FROM {scope} WHERE {d} IS NOT NULL GROUP BY 2" for d, k in limits.items()]
    union = " UNION ALL ".join(parts) + extra
    return (f"SELECT dim, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dim "
            f"ORDER BY n DESC, value) AS rank FROM ({union})) WHERE rank <= most")


FACET_SQL = top_dims("scope", FACETS, " UNION ALL SELECT 'skills', skill, count(*), 12 FROM "
                     "job_skills JOIN scope USING (job_id) GROUP BY 2")
BREAKDOWN_SQL = top_dims("scope", {**BREAKDOWNS, "work_arrangement": 1 << 40})
