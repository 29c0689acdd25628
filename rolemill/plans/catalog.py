"""Every registered query, with its DuckDB statement where SQL can say it."""

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill import vocab
from rolemill.functions import dates, extract, fingerprint, labels, pay, place, text, titles
from rolemill.operators import (aggregates, companies as co, customfields, duplicates,
                                export, joins, ranking, research as re_, scoring, search, skills,
                                store, textindex, upserts)
from rolemill.operators.enrich import enrich
from rolemill.plans import corpus
from rolemill.plans.oracle import (RAW as RAW_SQL, ALIAS_PATTERN, BREAKDOWN_SQL, FACET_SQL, annual, board,
                                   company_key, group, has, html_to_text, q, simhash,
                                   sql_list, strip, sub, title_norm, with_ctes)
from rolemill.sources import payloads, reference

c = F.col
AS_OF, AS_OF_SQL = corpus.AS_OF, corpus.AS_OF_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, *extra: tuple[str, str]):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql, *extra)
        return fn
    return register


def joined(array) -> F.Column:
    return F.array_join(array, "; ")


# --- sources -----------------------------------------------------------------

_P = "title, company_name, location_raw, description_html, job_url, apply_url"
_SCAN = ["source_key", "source_job_id", "title", "company_name", "location_raw", "city",
         "state", "country", "is_remote", "employment_type", "salary_min", "salary_max",
         "salary_period", "salary_is_estimated", "description_html", "description_text",
         "description_is_truncated", "posted", "job_url", "apply_url"]


def _fresh(spark, name: str) -> str:
    """A folder of its own under the shared one."""
    duplicates.use_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _landing(spark, sf, source: str, payload: dict, **more) -> payloads.Landed:
    """Payloads of one provider made from the corpus, one item each, landed as compressed
    lines with a broken one among them, and read back from there."""
    path = _fresh(spark, f"landed-{source}")
    raw = corpus.postings(spark, sf)
    item = F.struct(*[v.alias(k) for k, v in payload.items()])
    others = [v.alias(k) for k, v in more.items()]
    if source == "lever":
        body = item
    elif source == "usajobs":
        body = F.struct(F.struct(F.array(item).alias("SearchResultItems")).alias("SearchResult"))
    else:
        body = F.struct(*others, F.array(item).alias("results" if source == "adzuna" else "jobs"))
    token = F.concat(F.lit("co"), F.regexp_extract("company_name", r"(\d+)", 1))
    board = source in payloads.BOARDS
    line = F.to_json(F.struct(token.alias("token"), body.alias("payload")) if board else body)
    broken = spark.range(1).select(F.lit('{"jobs": [{"id": "cut').alias("line"))
    raw.select(line.alias("line")).unionByName(broken).write.option(
        "compression", "gzip").text(path)
    return payloads.land(spark, source, path, envelope=board)


def _landed(spark, sf, source: str, payload: dict, **more) -> DataFrame:
    return _landing(spark, sf, source, payload, **more).postings()


def _scanned(df: DataFrame) -> DataFrame:
    return df.withColumn("posted", F.date_format("date_posted", "yyyy-MM-dd HH:mm:ss")
                         ).select(*_SCAN)


def _scan_sql(source: str, token: bool = False, **over) -> str:
    """SELECT over the raw corpus producing the scanned columns."""
    tok = "'co' || regexp_extract(company_name, '([0-9]+)', 1)"
    base = {
        "source_key": q(source),
        "source_job_id": f"{tok} || ':' || source_job_id" if token else "source_job_id",
        "title": f"coalesce(nullif({strip('title')}, ''), '(untitled)')",
        "company_name": tok if token else f"nullif({strip('company_name')}, '')",
        "location_raw": "location_raw", "city": "CAST(NULL AS VARCHAR)",
        "state": "CAST(NULL AS VARCHAR)", "country": "'US'",
        "is_remote": "CAST(NULL AS BOOLEAN)", "employment_type": "CAST(NULL AS VARCHAR)",
        "salary_min": "CAST(NULL AS DOUBLE)", "salary_max": "CAST(NULL AS DOUBLE)",
        "salary_period": "CAST(NULL AS VARCHAR)", "salary_is_estimated": "FALSE",
        "description_html": "description_html", "description_text": "CAST(NULL AS VARCHAR)",
        "description_is_truncated": "FALSE",
        "posted": "strftime(date_posted, '%Y-%m-%d %H:%M:%S')",
        "job_url": "job_url", "apply_url": "job_url"}
    base.update(over)
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in base.items()) + " FROM raw"


def _iso():
    return F.date_format("date_posted", "yyyy-MM-dd'T'HH:mm:ss")


@query("src_01_remotive", _scan_sql("remotive", is_remote="TRUE",
                                    employment_type="employment_type"))
def src_remotive(spark, sf):
    return _scanned(_landed(spark, sf, "remotive", {
        "id": c("job_id"), "title": c("title"), "company_name": c("company_name"),
        "description": c("description_html"), "job_type": c("employment_type"),
        "candidate_required_location": F.concat(F.lit("  "), "location_raw", F.lit(" ")),
        "publication_date": _iso(), "url": c("job_url")}))


@query("src_02_adzuna", _scan_sql(
    "adzuna", description_is_truncated="TRUE", salary_min="salary_min",
    salary_max="salary_max", salary_period="'yearly'", employment_type="employment_type",
    salary_is_estimated="job_id % 2 = 1",
    state="CASE WHEN job_id % 4 > 0 THEN 'Texas' END",
    city="CASE WHEN job_id % 4 > 1 THEN CASE job_id % 4 WHEN 2 THEN 'Austin' "
         "ELSE 'Hyde Park' END END"))
def src_adzuna(spark, sf):
    areas = F.array(*map(F.lit, ("US", "Texas", "Austin", "Hyde Park")))
    return _scanned(_landed(spark, sf, "adzuna", {
        "id": c("job_id"), "title": c("title"), "description": c("description_html"),
        "company": F.struct(c("company_name").alias("display_name")),
        "location": F.struct(c("location_raw").alias("display_name"),
                             F.slice(areas, 1, (c("job_id") % 4 + 1).cast("int"))
                             .alias("area")),
        "salary_min": c("salary_min"), "salary_max": c("salary_max"),
        "salary_is_predicted": (c("job_id") % 2).cast("string"),
        "contract_time": c("employment_type"), "created": _iso(),
        "redirect_url": c("job_url")}))


@query("src_03_usajobs", _scan_sql(
    "usajobs", is_remote="job_id % 3 = 0", city="CASE WHEN job_id % 5 > 0 THEN 'Reno' END",
    state="CASE WHEN job_id % 5 > 0 THEN 'NV' END", employment_type="employment_type",
    location_raw="CASE WHEN job_id % 5 > 0 THEN location_raw END",
    salary_min="salary_min", salary_max="salary_max",
    salary_period="CASE job_id % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'yearly' "
                  "ELSE 'yearly' END",
    description_html="CAST(NULL AS VARCHAR)",
    description_text="title || chr(10) || chr(10) || 'One' || chr(10) || company_name "
                     "|| chr(10) || chr(10) || location_raw",
    apply_url="coalesce(apply_url, NULL)"))
def src_usajobs(spark, sf):
    n = c("job_id")
    spot = F.when(n % 5 > 0, F.array(F.struct(
        c("location_raw").alias("LocationName"), F.lit("Reno").alias("CityName"),
        F.lit("NV").alias("CountrySubDivisionCode"))))
    return _scanned(_landed(spark, sf, "usajobs", {
        "MatchedObjectId": F.lit("ignored"), "MatchedObjectDescriptor": F.struct(
            n.cast("string").alias("PositionID"), c("title").alias("PositionTitle"),
            c("company_name").alias("OrganizationName"), c("job_url").alias("PositionURI"),
            F.when(c("apply_url").isNotNull(), F.array("apply_url")).alias("ApplyURI"),
            _iso().alias("PublicationStartDate"), spot.alias("PositionLocation"),
            F.array(F.struct(c("salary_min").cast("string").alias("MinimumRange"),
                             c("salary_max").cast("string").alias("MaximumRange"),
                             F.when(n % 3 == 0, "Per Hour").when(n % 3 == 1, "Per Year")
                             .otherwise("Per Fortnight").alias("RateIntervalCode")))
            .alias("PositionRemuneration"),
            F.when(c("employment_type").isNotNull(), F.array(F.struct(
                c("employment_type").alias("Name")))).alias("PositionSchedule"),
            F.struct(F.struct(
                c("title").alias("JobSummary"),
                F.array(F.lit("One"), c("company_name")).alias("MajorDuties"),
                F.lit("").alias("Requirements"), c("location_raw").alias("Qualifications"),
                F.when(n % 3 == 0, "True").otherwise("false").alias("TeleworkEligible"))
                .alias("Details")).alias("UserArea"))}))


@query("src_04_greenhouse", _scan_sql("greenhouse", token=True))
def src_greenhouse(spark, sf):
    return _scanned(_landed(spark, sf, "greenhouse", {
        "id": c("job_id"), "title": c("title"), "content": c("description_html"),
        "location": F.struct(c("location_raw").alias("name")),
        "updated_at": F.when(c("job_id") % 2 == 0, _iso()), "first_published": _iso(),
        "absolute_url": c("job_url")}))


@query("src_05_lever", _scan_sql(
    "lever", token=True, employment_type="employment_type",
    apply_url="coalesce(apply_url, job_url)"))
def src_lever(spark, sf):
    return _scanned(_landed(spark, sf, "lever", {
        "id": c("job_id"), "text": c("title"),
        "description": F.when(c("job_id") % 2 == 0, c("description_html")),
        "descriptionPlain": c("description_html"),
        "categories": F.struct(c("location_raw").alias("location"),
                               c("employment_type").alias("commitment")),
        "createdAt": F.unix_millis("date_posted"), "hostedUrl": c("job_url"),
        "applyUrl": c("apply_url")}))


@query("src_06_ashby", _scan_sql(
    "ashby", token=True, employment_type="employment_type", is_remote="is_remote",
    description_text="description_text", apply_url="coalesce(apply_url, job_url)"))
def src_ashby(spark, sf):
    return _scanned(_landed(spark, sf, "ashby", {
        "id": c("job_id"), "title": c("title"), "descriptionHtml": c("description_html"),
        "descriptionPlain": c("description_text"), "location": c("location_raw"),
        "employmentType": c("employment_type"), "isRemote": c("is_remote"),
        "updatedAt": _iso(), "jobUrl": c("job_url"), "applyUrl": c("apply_url")}))


@query("src_07_workable", _scan_sql(
    "workable", token=True, employment_type="employment_type",
    source_job_id="'co' || regexp_extract(company_name, '([0-9]+)', 1) || ':' || "
                  "CASE WHEN job_id % 2 = 0 THEN 'S' || source_job_id ELSE source_job_id END",
    company_name="CASE WHEN job_id % 3 = 0 THEN 'co' || regexp_extract(company_name, "
                 "'([0-9]+)', 1) ELSE company_name END",
    city="city", state="state", location_raw="nullif(concat_ws(', ', city, state), '')",
    country="CASE WHEN job_id % 2 = 0 THEN 'US' ELSE coalesce(country, 'US') END",
    is_remote="coalesce(is_remote, FALSE)", job_url="job_url",
    apply_url="coalesce(apply_url, job_url)"))
def src_workable(spark, sf):
    return _scanned(_landed(spark, sf, "workable", {
        "id": c("job_id"),
        "shortcode": F.when(c("job_id") % 2 == 0, F.concat(F.lit("S"), "job_id")),
        "title": c("title"), "description": c("description_html"), "city": c("city"),
        "state": c("state"), "country": F.when(c("job_id") % 2 == 0, "usa").otherwise(
            c("country")),
        "employment_type": c("employment_type"), "telecommuting": c("is_remote"),
        "created_at": _iso(), "url": c("job_url"), "application_url": c("apply_url"),
        "department": F.lit("desk")},
        name=F.when(c("job_id") % 3 != 0, c("company_name"))))


@query("src_12_reconciled_landing", """SELECT 'remotive' AS source_key, count(*) + 1 AS payloads,
    count(*) AS parsed, 1 AS quarantined FROM raw""")
def src_reconciled(spark, sf):
    landed = _landing(spark, sf, "remotive", {"id": c("job_id"), "title": c("title")})
    return landed.counts().agg(
        F.lit("remotive").alias("source_key"), F.sum("payloads").alias("payloads"),
        F.sum("parsed").alias("parsed"), F.sum("quarantined").alias("quarantined"))


@query("src_08_value_cleaning", f"SELECT p_partkey, nullif({strip('v')}, '') AS v FROM ("
       "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE '  ' || p_name || chr(9) "
       "END AS v FROM part)")
def src_clean(spark, sf):
    part = corpus.table(spark, sf, "part")
    v = F.when(c("p_size") % 5 == 0, "  ").otherwise(
        F.concat(F.lit("  "), "p_name", F.lit("\t")))
    return part.select("p_partkey", text.clean(v).alias("v"))


@query("src_09_seed_companies", f"""SELECT name, domain, industry, ats_platform,
    ats_board_token, {company_key('name')} AS company_key FROM (
    SELECT nullif(trim(CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE ' ' || c_name || ' Corp. ' END),
    '') AS name, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || '.com' END AS domain,
    c_mktsegment AS industry, 'lever' AS ats_platform, 'c' || c_custkey AS ats_board_token
    FROM customer) WHERE name IS NOT NULL""")
def src_seed(spark, sf):
    customer = corpus.table(spark, sf, "customer")
    raw = customer.select(
        F.when(c("c_custkey") % 7 == 0, " ").otherwise(
            F.concat(F.lit(" "), "c_name", F.lit(" Corp. "))).alias("name"),
        F.when(c("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit(".com")))
        .otherwise("").alias("domain"), c("c_mktsegment").alias("industry"),
        F.lit("lever ").alias("ats_platform"),
        F.concat(F.lit("c"), "c_custkey").alias("ats_board_token"))
    path = _fresh(spark, "seeds")
    raw.write.option("header", True).csv(path)
    return reference.read_seed_companies(spark, path)


def _part_taxonomy(spark, sf) -> DataFrame:
    """Part names as skills of their brand, with type words as aliases."""
    return corpus.table(spark, sf, "part").select(
        c("p_partkey").alias("skill_id"), c("p_name").alias("name"),
        c("p_brand").alias("category"),
        F.array(F.concat("p_name", F.lit(" pro")), F.concat("p_type", F.lit(" "), "p_size"),
                F.concat(F.lit("a&b "), "p_name")).alias("aliases"))


_ALIASES = r"""SELECT alias, skill, category FROM (SELECT *, row_number() OVER (
    PARTITION BY alias ORDER BY id, pos) AS rn FROM (
    SELECT p_partkey AS id, p_name AS skill, p_brand AS category, lower(trim(a)) AS alias, pos
    FROM (SELECT *, unnest([p_name, p_name || ' pro', p_type || ' ' || p_size,
      'a&b ' || p_name]) AS a, unnest([0, 1, 2, 3]) AS pos FROM part))
    WHERE regexp_matches(alias, '^[\w+#./ -]+$')) WHERE rn = 1"""


@query("src_10_taxonomy", "SELECT p_brand AS category, count(*) AS skills, "
       "3 * count(*) AS aliases FROM part GROUP BY 1")
def src_taxonomy(spark, sf):
    path = _fresh(spark, "taxonomy")
    _part_taxonomy(spark, sf).select("category", "name", "aliases").write.json(path)
    return reference.read_taxonomy(spark, path).groupBy("category").agg(
        F.count_distinct("skill_id").alias("skills"),
        F.sum(F.size("aliases")).alias("aliases"))


@query("src_11_union_of_sources",
       "SELECT source_key, count(*) AS fetched FROM raw GROUP BY 1")
def src_union(spark, sf):
    raw = corpus.postings(spark, sf)
    parts = {s: raw.where(c("source_key") == s).drop("postal_code" if i % 2 else "latitude")
             for i, s in enumerate(corpus.SOURCES)}
    return payloads.fetched_counts(payloads.union_sources(parts))


# --- normalisation --------------------------------------------------------------

@query("nrm_01_html_to_text",
       f"SELECT page_id, {html_to_text('html')} AS body FROM pages")
def nrm_html(spark, sf):
    pages = corpus.spread(corpus.table(spark, sf, "pages").select("page_id", "html"))
    return text.with_text(pages, "html", "body").select("page_id", "body")


@query("nrm_02_company", f"SELECT job_id, {company_key('company_name')} AS company_key FROM raw")
def nrm_company(spark, sf):
    return corpus.postings(spark, sf).select(
        "job_id", text.normalize_company(c("company_name")).alias("company_key"))


@query("nrm_03_title", f"SELECT job_id, {title_norm('title')} AS title_normalized FROM raw")
def nrm_title(spark, sf):
    return corpus.postings(spark, sf).select(
        "job_id", text.normalize_title(c("title")).alias("title_normalized"))


def _job_query(name: str, columns: list[str], sql_columns: str | None = None):
    """A query that shows some enriched columns per job."""
    def run(spark, sf):
        return corpus.enriched(spark, sf).select("job_id", *columns)
    query(name, f"SELECT job_id, {sql_columns or ', '.join(columns)} FROM jobs")(run)


@query("nrm_04_location", """SELECT job_id, CASE WHEN len(parts) >
    CASE WHEN parsed_state IS NOT NULL THEN 1 ELSE 0 END AND NOT list_contains(
    ['remote', 'anywhere', 'united states', 'us'], lower(parts[1])) THEN parts[1] END AS city,
    parsed_state AS state, zip AS postal_code FROM staged2""")
def nrm_location(spark, sf):
    loc = place.parse_location(c("location_raw"))
    return corpus.postings(spark, sf).select("job_id", loc.alias("l")).select(
        "job_id", "l.city", "l.state", "l.postal_code")


_job_query("nrm_05_location_merge", ["city", "state", "country", "postal_code"])


@query("nrm_06_work_arrangement", "SELECT job_id, detected FROM staged2")
def nrm_arrangement(spark, sf):
    raw = text.with_text(corpus.postings(spark, sf), "description_html", "body")
    body = F.coalesce("description_text", "body")
    return raw.select("job_id", labels.work_arrangement(
        c("title"), c("location_raw"), body).alias("detected"))


_job_query("nrm_07_arrangement_precedence", ["work_arrangement"])
_job_query("nrm_08_employment_type", ["employment_type"])
_job_query("nrm_09_experience_level", ["experience_level"])


@query("nrm_10_salary_from_text", """SELECT job_id,
    least(low_pay, coalesce(high_pay, low_pay)) AS low,
    CASE WHEN high_pay IS NOT NULL THEN greatest(low_pay, high_pay) END AS high
    FROM staged2 WHERE pay_match <> ''""")
def nrm_salary_text(spark, sf):
    j = corpus.jobs(spark, sf, "job_id", "description_text")
    return (j.withColumn("m", pay.salary_match(c("description_text")))
            .withColumn("p", pay.parse_salary(c("description_text"), c("m")))
            .where("p is not null")
            .select("job_id", c("p.salary_min").alias("low"), c("p.salary_max").alias("high")))


_job_query("nrm_11_period", ["salary_period"])


@query("nrm_12_annualise", "SELECT l_orderkey, l_linenumber, "
       + annual("l_quantity", "CASE l_linenumber % 8 WHEN 0 THEN 'hourly' WHEN 1 THEN 'Daily' "
                "WHEN 2 THEN 'weekly' WHEN 3 THEN 'biweekly' WHEN 4 THEN 'monthly' "
                "WHEN 5 THEN 'yearly' WHEN 6 THEN 'fortnightly' END")
       + " AS annual FROM lineitem")
def nrm_annualise(spark, sf):
    n = c("l_linenumber") % 8
    names = ["hourly", "Daily", "weekly", "biweekly", "monthly", "yearly", "fortnightly"]
    period = F.when(F.lit(False), "")
    for i, name in enumerate(names):
        period = period.when(n == i, name)
    return corpus.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", pay.annualize(c("l_quantity"), period).alias("annual"))


_job_query("nrm_13_salary", ["salary_min", "salary_max", "salary_period",
                             "salary_is_estimated", "salary_annualized_min",
                             "salary_annualized_max"])


# Spellings of a date as Spark patterns; the last ones are no dates.
_SPELLINGS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "d-MMM-yyyy", "yyyyMMdd", "EEEE, MMMM d, yyyy 'at' h:mm a",
    "M/d/yyyy h:mm a", "dd MMM yyyy HH:mm:ss '+0000'", "yyyy/MM/dd HH:mm", "MMM. d, yyyy", "dd MMMM yyyy"]


@query("nrm_14_dates", f"""SELECT o_orderkey, strftime(CASE WHEN o_orderkey % {len(_SPELLINGS) + 3}
    < {len(_SPELLINGS) + 2} THEN o_orderdate END, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""")
def nrm_dates(spark, sf):
    d, n = c("o_orderdate").cast("timestamp"), len(_SPELLINGS)
    kind = c("o_orderkey") % (n + 3)
    written = F.when(kind == n, F.unix_seconds(d).cast("string")).when(
        kind == n + 1, F.unix_millis(d).cast("string")).when(kind == n + 2, "soon")
    for i, spelling in enumerate(_SPELLINGS):
        written = written.when(kind == i, F.date_format(d, spelling))
    return corpus.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(dates.parse_date(written), "yyyy-MM-dd HH:mm:ss")
        .alias("parsed"))


@query("nrm_15_posting_age", f"""SELECT event_id, greatest(0, CAST(floor(epoch(
    TIMESTAMP '2024-01-20 12:00:00' - ts) / 86400) AS BIGINT)) AS age FROM events""")
def nrm_age(spark, sf):
    return corpus.table(spark, sf, "events").select("event_id", dates.days_since(
        c("ts").cast("timestamp"), F.lit(dt.datetime(2024, 1, 20, 12))).alias("age"))


@query("nrm_16_summary", f"""SELECT doc_id, CASE WHEN length(f) <= 320 THEN f ELSE
    regexp_replace(left(f, 320), ' [^ ]*$', '') || '...' END AS summary FROM (
    SELECT doc_id, {strip(sub('text', chr(92) + 's+', "' '"))} AS f FROM documents)""")
def nrm_summary(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    return docs.select("doc_id", text.summarize(c("text")).alias("summary"))


@query("nrm_17_location_display", """SELECT job_id, coalesce(nullif(location_raw, ''),
    nullif(concat_ws(', ', city, state), '')) AS location FROM (SELECT job_id,
    CASE WHEN job_id % 3 = 0 THEN '' ELSE location_raw END AS location_raw, city, state
    FROM jobs)""")
def nrm_display(spark, sf):
    raw = F.when(c("job_id") % 3 == 0, "").otherwise(c("location_raw"))
    return corpus.enriched(spark, sf).select("job_id", place.display_location(
        raw, c("city"), c("state")).alias("location"))


# --- extraction -------------------------------------------------------------------

@query("ext_01_alias_table", _ALIASES)
def ext_aliases(spark, sf):
    return skills.alias_table(_part_taxonomy(spark, sf))


@query("ext_02_skill_matches",
       "SELECT job_id, skill, mention_count FROM job_skills")
def ext_matches(spark, sf):
    return skills.job_skills(corpus.jobs(spark, sf, "job_id", "skills")).select(
        "job_id", "skill", "mention_count")


@query("ext_03_requirement_class", "SELECT job_id, skill, requirement FROM job_skills")
def ext_requirement(spark, sf):
    return skills.job_skills(corpus.jobs(spark, sf, "job_id", "skills")).select(
        "job_id", "skill", "requirement")


_job_query("ext_04_years", ["years_experience_min", "years_experience_max"])
_job_query("ext_05_education", ["education_level"])
_job_query("ext_07_sponsorship", ["visa_sponsorship_mentioned"])
_job_query("ext_08_relocation", ["relocation_mentioned"])
_job_query("ext_09_urgency", ["urgently_hiring"])
_job_query("ext_10_agency", ["is_recruitment_agency"])


@query("ext_06_benefits", "SELECT job_id, unnest(benefits) AS benefit FROM jobs")
def ext_benefits(spark, sf):
    return skills.job_benefits(corpus.jobs(spark, sf, "job_id", "benefits"))


@query("ext_11_contacts", f"""SELECT doc_id,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, {q(vocab.EMAIL)}))), '; ')
    AS emails,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, {q(vocab.PHONE)}))), '; ')
    AS phones FROM documents""")
def ext_contacts(spark, sf):
    docs = corpus.spread(corpus.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", extract.contacts(c("text")).alias("x")).select(
        "doc_id", joined("x.emails").alias("emails"), joined("x.phones").alias("phones"))


@query("ext_12_board", f"""SELECT job_id, split_part(b, ':', 1) AS platform,
    split_part(b, ':', 2) AS token FROM (SELECT job_id, {board('job_url')} AS b FROM raw)
    WHERE b IS NOT NULL""")
def ext_board(spark, sf):
    found = extract.detect_board(c("job_url"))
    return corpus.postings(spark, sf).select("job_id", found.alias("b")).where(
        "b is not null").select("job_id", "b.platform", "b.token")


_JOB_FIELDS = ["title_normalized", "company_key", "city", "state", "work_arrangement",
               "employment_type", "experience_level", "education_level",
               "years_experience_min", "salary_annualized_min", "salary_is_estimated",
               "visa_sponsorship_mentioned", "relocation_mentioned", "urgently_hiring",
               "canonical_hash", "description_text"]
_job_query("ext_13_enrichment", _JOB_FIELDS)


# --- fingerprints and duplicates -----------------------------------------------------

_job_query("dup_01_canonical_hash", ["canonical_hash"])


@query("dup_02_simhash", simhash("documents", "doc_id", "text"))
def dup_simhash(spark, sf):
    docs = corpus.spread(corpus.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", fingerprint.simhash(c("text")).alias("simhash")).where(
        "simhash is not null")


@query("dup_02b_simhash_builtin", simhash("documents", "doc_id", "text"))
def dup_simhash_rows(spark, sf):
    docs = corpus.spread(corpus.table(spark, sf, "documents").select("doc_id", "text"))
    return fingerprint.simhash_by_rows(docs, "doc_id", "text").where("simhash is not null")


@query("dup_03_hamming", f"""SELECT a.doc_id, bit_count(xor(a.simhash, b.simhash)) AS distance,
    1 - bit_count(xor(a.simhash, b.simhash)) / 64.0 AS similarity
    FROM ({simhash('documents', 'doc_id', 'text')}) a
    JOIN ({simhash('documents', 'doc_id', 'text')}) b ON b.doc_id = a.doc_id + 1""")
def dup_hamming(spark, sf):
    # Stored, as both sides of the join would hash all texts.
    prints = store.save_jobs(dup_simhash(spark, sf), _fresh(spark, "prints"))
    nxt = prints.select((c("doc_id") - 1).alias("doc_id"), c("simhash").alias("other"))
    return prints.join(nxt, "doc_id").select(
        "doc_id", fingerprint.hamming(c("simhash"), c("other")).cast("long").alias("distance"),
        fingerprint.simhash_similarity(c("simhash"), c("other")).alias("similarity"))


_NEIGHBOURS = """SELECT a.job_id, a.title_normalized AS x, b.title_normalized AS y FROM
    (SELECT job_id, {t} AS title_normalized FROM raw) a JOIN
    (SELECT job_id, {t} AS title_normalized FROM raw) b ON b.job_id = a.job_id + 1""".format(
    t=title_norm("title"))


def _neighbour_titles(spark, sf):
    t = nrm_title(spark, sf)
    nxt = t.select((c("job_id") - 1).alias("job_id"), c("title_normalized").alias("y"))
    return t.select("job_id", c("title_normalized").alias("x")).join(nxt, "job_id")


@query("dup_04_title_jaccard", f"""SELECT job_id, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y
    THEN 1.0 ELSE len(list_intersect(string_split(x, ' '), string_split(y, ' ')))
    / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' '))))::DOUBLE
    END AS similarity FROM ({_NEIGHBOURS})""")
def dup_jaccard(spark, sf):
    return _neighbour_titles(spark, sf).select("job_id", titles.title_similarity(
        c("x"), c("y"), sequence=False).alias("similarity"))


@query("dup_04b_title_similarity")
def dup_title(spark, sf):
    return _neighbour_titles(spark, sf).select("job_id", titles.title_similarity(
        c("x"), c("y")).alias("similarity"))


@query("dup_05_latest_by_key", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id))
    AS event_id FROM events GROUP BY ALL""")
def dup_latest(spark, sf):
    events = corpus.table(spark, sf, "events").select(
        c("event_type").alias("source_key"), c("user_id").alias("source_job_id"),
        c("ts").alias("date_collected"), c("event_id").alias("seq"))
    return duplicates.latest_by_source_key(events).select(
        c("source_job_id").alias("user_id"), c("source_key").alias("event_type"),
        c("seq").alias("event_id"))


@query("dup_06_identical_url", """SELECT job_id, first AS linked_to FROM (SELECT job_id,
    min(job_id) OVER (PARTITION BY job_url) AS first FROM raw) WHERE first < job_id""")
def dup_url(spark, sf):
    return duplicates.url_links(corpus.postings(spark, sf)).select("job_id", "linked_to")


_PRINTS = ("prints", f"""SELECT j.job_id, j.job_url, j.title_normalized, j.company_key,
    lower(coalesce(j.city, '')) AS city, upper(coalesce(j.state, '')) AS state,
    j.canonical_hash, s.simhash FROM jobs j LEFT JOIN (
    {simhash('jobs', 'job_id', 'description_text')}) s USING (job_id)""")
_URLS = ("urls", """SELECT job_id, first AS linked_to, 'identical_url' AS reason, 1.0::DOUBLE AS score
    FROM (SELECT job_id, min(job_id) OVER (PARTITION BY job_url) AS first FROM jobs)
    WHERE first < job_id""")
_D = "bit_count(xor(i.simhash, j.simhash))"
_VERDICT = f"""CASE WHEN i.simhash IS NULL OR j.simhash IS NULL THEN t
    WHEN {_D} <= 9 THEN (t + 1 - {_D} / 64.0) / 2 WHEN {_D} >= 36 THEN NULL ELSE t END AS score,
    CASE WHEN {_D} <= 9 THEN 'title+description' ELSE 'canonical+title' END AS reason"""
_CANON = ("canon", f"""SELECT job_id, linked_to, reason, score FROM (SELECT *, row_number()
    OVER (PARTITION BY job_id ORDER BY score DESC, linked_to) AS rn FROM (
    SELECT i.job_id, j.job_id AS linked_to, {_VERDICT} FROM
    (SELECT *, 1.0::DOUBLE AS t FROM prints) i JOIN prints j ON i.canonical_hash = j.canonical_hash
    AND j.job_id < i.job_id) WHERE score IS NOT NULL) WHERE rn = 1""")
_JACCARD = """len(list_intersect(string_split(i.title_normalized, ' '),
    string_split(j.title_normalized, ' '))) / len(list_distinct(list_concat(
    string_split(i.title_normalized, ' '), string_split(j.title_normalized, ' '))))::DOUBLE"""
_COMP = ("comp", f"""SELECT job_id, linked_to, reason, score FROM (SELECT *, row_number()
    OVER (PARTITION BY job_id ORDER BY score DESC, linked_to) AS rn FROM (
    SELECT i.job_id, j.job_id AS linked_to, {_VERDICT} FROM (
      SELECT i.*, j.job_id AS other, {_JACCARD} AS t FROM prints i JOIN prints j
      USING (company_key, city, state) WHERE j.job_id < i.job_id) i
    JOIN prints j ON i.other = j.job_id WHERE t >= 0.92 AND NOT EXISTS (
      SELECT 1 FROM prints k WHERE k.canonical_hash = i.canonical_hash
      AND k.job_id < i.job_id)) WHERE score IS NOT NULL) WHERE rn = 1""")
_LINKS = ("links", """SELECT * FROM urls UNION ALL SELECT * FROM (SELECT * FROM canon UNION ALL
    SELECT * FROM comp) WHERE job_id NOT IN (SELECT job_id FROM urls)""")
_LINK_TABLES = (_PRINTS, _URLS, _CANON, _COMP, _LINKS)
_LINK_SQL = "SELECT job_id, linked_to, reason, round(score, 3) AS score FROM "


def _linkable(spark, sf):
    duplicates.use_checkpoint_folder(spark)
    return corpus.enriched(spark, sf).select(
        "job_id", "seq", "source_key", "job_url", "title_normalized", "company_key",
        "city", "state", "canonical_hash", "simhash").checkpoint()


def _shown(links):
    return links.select("job_id", "linked_to", "reason", F.round("score", 3).alias("score"))


@query("dup_07_canonical", _LINK_SQL + "canon", *_LINK_TABLES)
def dup_canonical(spark, sf):
    return _shown(duplicates.canonical_links(_linkable(spark, sf)))


@query("dup_08_company_block", _LINK_SQL + "comp", *_LINK_TABLES)
def dup_company(spark, sf):
    return _shown(duplicates.company_links(_linkable(spark, sf), sequence=False))


@query("dup_09_verdict", _LINK_SQL + "links", *_LINK_TABLES)
def dup_verdict(spark, sf):
    return _shown(duplicates.find_links(_linkable(spark, sf), sequence=False))


@query("dup_09b_verdict_with_sequence")
def dup_verdict_full(spark, sf):
    return _shown(duplicates.find_links(_linkable(spark, sf)))


_DEPTH = "CASE source_key " + " ".join(
    f"WHEN {q(s)} THEN {n}" for s, n in vocab.SOURCE_DEPTH.items()) + " ELSE 0 END"


_FOREST = (
    ("up", """SELECT job_id, linked_to AS root FROM links UNION ALL
        SELECT up.job_id, links.linked_to FROM up JOIN links ON up.root = links.job_id"""),
    ("tops", "SELECT job_id, min(root) AS root FROM up GROUP BY 1"),
    ("members", "SELECT * FROM tops UNION SELECT root, root FROM tops"),
    ("best", f"""SELECT root, arg_max(job_id, ({_DEPTH}, -job_id)) AS prime,
        count(*) - 1 AS n FROM members JOIN raw USING (job_id) GROUP BY 1"""))


@query("dup_10_primaries", """SELECT raw.job_id, coalesce(prime = raw.job_id, TRUE) AS is_primary,
    CASE WHEN prime <> raw.job_id THEN prime END AS duplicate_of,
    CASE WHEN prime = raw.job_id THEN n ELSE 0 END AS duplicate_count
    FROM raw LEFT JOIN members USING (job_id) LEFT JOIN best USING (root)""",
       *_LINK_TABLES, *_FOREST)
def dup_primaries(spark, sf):
    jobs = _linkable(spark, sf)
    return duplicates.assign_primaries(jobs, duplicates.find_links(jobs, sequence=False))


@query("dup_11_duplicates_of", """SELECT duplicate_of AS job_id, job_id AS duplicate_id,
    source_key AS duplicate_source, job_url AS duplicate_url FROM raw
    WHERE duplicate_of IS NOT NULL""")
def dup_reverse(spark, sf):
    return duplicates.duplicates_of(corpus.postings(spark, sf))


@query("snk_06_enrich_and_store", """SELECT work_arrangement, count(*) AS jobs,
    count(salary_annualized_min) AS paid, count(years_experience_min) AS with_years
    FROM jobs GROUP BY 1""")
def snk_enriched(spark, sf):
    """The whole enrichment, written anew and read back."""
    stored = store.save_jobs(enrich(corpus.postings(spark, sf), corpus.MATCHER), _fresh(spark, "enriched"))
    return stored.groupBy("work_arrangement").agg(
        F.count(F.lit(1)).alias("jobs"), F.count("salary_annualized_min").alias("paid"),
        F.count("years_experience_min").alias("with_years"))


# --- upserts and maintenance -----------------------------------------------------------

_STATE = ["source_key", "source_job_id", "job_id", "title", "description_text",
          "description_is_truncated", "last_seen_at", "is_active", "city"]


def _stored_and_batch(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the corpus as stored; the batch has the other third and half of those
    seen again."""
    j = corpus.jobs(spark, sf, *_STATE, "date_collected", "seq").select(
        *_STATE, "date_collected", "seq",
        F.lit(0).cast("long").alias("duplicate_count"))
    stored = j.where(c("job_id") % 3 < 2)
    batch = j.where((c("job_id") % 2 == 0) | (c("job_id") % 3 == 2)).withColumns({
        "title": F.concat("title", F.lit(" v2")),
        "description_text": F.concat("description_text", F.lit(" v2")),
        "description_is_truncated": c("job_id") % 5 < 2})
    return stored, batch


_BATCH = "(job_id % 2 = 0 OR job_id % 3 = 2)"


@query("ups_01_job_upsert", f"""SELECT job_id,
    CASE WHEN {_BATCH} THEN title || ' v2' ELSE title END AS title,
    CASE WHEN {_BATCH} AND NOT (job_id % 3 < 2 AND NOT description_is_truncated
      AND job_id % 5 < 2) THEN description_text || ' v2' ELSE description_text END
      AS description_text,
    CASE WHEN {_BATCH} THEN strftime({AS_OF_SQL}, '%Y-%m-%d')
      ELSE strftime(last_seen_at, '%Y-%m-%d') END AS seen,
    CASE WHEN {_BATCH} THEN TRUE ELSE is_active END AS is_active,
    CASE WHEN {_BATCH} AND job_id % 3 < 2 THEN 'updated'
         WHEN {_BATCH} THEN 'new' END AS outcome FROM jobs""")
def ups_jobs(spark, sf):
    stored, batch = _stored_and_batch(spark, sf)
    return upserts.upsert_jobs(stored, batch, AS_OF).select(
        "job_id", "title", "description_text",
        F.date_format("last_seen_at", "yyyy-MM-dd").alias("seen"), "is_active", "outcome")


_FAILED = "(job_id % 11 = 1 AND job_id % 2 = 1)"


@query("ups_02_outcome_counts", f"""SELECT coalesce(source_key, 'total') AS source_key,
    count(*) FILTER ({_BATCH}) + count(*) FILTER ({_FAILED}) AS fetched,
    count(*) FILTER (job_id % 3 = 2) AS new,
    count(*) FILTER ({_BATCH} AND job_id % 3 < 2) AS updated, 0 AS duplicate,
    count(*) FILTER ({_FAILED}) AS failed
    FROM raw WHERE {_BATCH} OR {_FAILED} GROUP BY GROUPING SETS ((source_key), ())""")
def ups_outcomes(spark, sf):
    stored, batch = _stored_and_batch(spark, sf)
    raw = corpus.postings(spark, sf).where((c("job_id") % 11 == 1) & (c("job_id") % 2 == 1))
    _, failed = upserts.split_failed(raw.withColumn("title", F.lit("")))
    return upserts.outcome_counts(upserts.upsert_jobs(stored, batch, AS_OF), failed)


@query("ups_03_company_resolve", """SELECT company_key,
    coalesce(max(old_name), max(name)) AS name, coalesce(max(old_domain), max(domain)) AS domain,
    max(website) AS website, max(ats_platform) AS ats_platform,
    max(ats_board_token) AS ats_board_token,
    strftime(greatest(max(seen), max(old_seen)), '%Y-%m-%d') AS last_seen FROM (
    SELECT company_key, name, domain, website, ats_platform, ats_board_token,
      last_seen_at AS seen, NULL AS old_name, NULL AS old_domain, NULL AS old_seen FROM companies
    UNION ALL SELECT lower(replace(c_name, '#', ' ')), NULL, NULL, NULL, NULL, NULL, NULL, c_name,
      CASE WHEN c_custkey % 2 = 0 THEN 'old.example' END, TIMESTAMP '1999-06-01' FROM customer)
    GROUP BY 1""")
def ups_companies(spark, sf):
    stored = corpus.table(spark, sf, "customer").select(
        text.normalize_company(c("c_name")).alias("company_key"), c("c_name").alias("name"),
        F.when(c("c_custkey") % 2 == 0, "old.example").alias("domain"),
        F.lit(None).cast("string").alias("website"),
        F.lit(None).cast("string").alias("ats_platform"),
        F.lit(None).cast("string").alias("ats_board_token"),
        F.lit(dt.datetime(1998, 1, 1)).alias("first_seen_at"),
        F.lit(dt.datetime(1999, 6, 1)).alias("last_seen_at"))
    return co.resolve_companies(stored, corpus.jobs(spark, sf, *corpus.EMPLOYER_COLUMNS)).select(
        "company_key", "name", "domain", "website", "ats_platform", "ats_board_token",
        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@query("ups_04_board_discovery", """SELECT company_name_raw,
    split_part(arg_min(board, seq), ':', 1) AS platform,
    split_part(arg_min(board, seq), ':', 2) AS token
    FROM jobs WHERE board IS NOT NULL GROUP BY 1""")
def ups_boards(spark, sf):
    return co.discover_boards(corpus.enriched(spark, sf).select("company_name_raw", "board", "seq"))


@query("ups_05_boards_to_refresh", """SELECT ats_platform, rank, ats_board_token, name FROM (
    SELECT *, row_number() OVER (PARTITION BY ats_platform ORDER BY last_seen_at NULLS FIRST,
      company_key) AS rank FROM companies WHERE ats_platform IS NOT NULL
      AND contains(lower(name), 'customer')) WHERE rank <= 25""")
def ups_refresh(spark, sf):
    return co.boards_to_refresh(corpus.companies(spark, sf), name="Customer")


@query("ups_06_company_metrics",
       "SELECT company_key, jobs_discovered, hiring_frequency_30d FROM companies")
def ups_metrics(spark, sf):
    return corpus.companies(spark, sf).select(
        "company_key", "jobs_discovered", "hiring_frequency_30d")


@query("ups_07_deactivate_stale", f"""SELECT job_id, is_active AND NOT stale AS is_active,
    is_active AND stale AS closed FROM (SELECT job_id, is_active,
    last_seen_at < {AS_OF_SQL} - INTERVAL 45 DAY AS stale FROM raw)""")
def ups_stale(spark, sf):
    return upserts.deactivate_stale(corpus.postings(spark, sf), AS_OF).select(
        "job_id", "is_active", "closed")


@query("ups_08_replace_bridge", """SELECT job_id, skill, mention_count FROM job_skills
    WHERE job_id % 4 <> 0 UNION ALL SELECT job_id, 'rewritten', 1 FROM raw
    WHERE job_id % 4 = 0""")
def ups_bridge(spark, sf):
    stored = skills.job_skills(corpus.jobs(spark, sf, "job_id", "skills")).drop("requirement")
    touched = corpus.postings(spark, sf).where(c("job_id") % 4 == 0).select("job_id")
    new = touched.select("job_id", F.lit("rewritten").alias("skill"),
                         F.lit(1).cast("long").alias("mention_count"))
    return upserts.replace_bridge(stored, touched, new)


@query("ups_09_research_update", """SELECT k AS job_id,
    CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'reviewed'
      ELSE CASE WHEN r.job_id IS NULL THEN 'new' ELSE r.status END END ELSE r.status END AS status,
    CASE WHEN k % 3 = 0 THEN 'high' ELSE r.priority END AS priority, r.notes
    FROM (SELECT o_orderkey AS k FROM orders) LEFT JOIN research r ON k = r.job_id
    WHERE r.job_id IS NOT NULL OR k % 3 = 0""")
def ups_research(spark, sf):
    jobs = corpus.postings(spark, sf)
    updates = corpus.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(
        c("o_orderkey").alias("job_id"),
        F.when(c("o_orderkey") % 2 == 0, "reviewed").alias("status"),
        F.lit("high").alias("priority"))
    unknown = updates.withColumn("job_id", -c("job_id") - 1)
    return re_.apply_updates(corpus.research(spark, sf), updates.union(unknown), jobs)


@query("ups_10_tag_sets", """SELECT * FROM (SELECT job_id, tag FROM job_tags
    UNION SELECT o_orderkey, 'fresh' FROM orders WHERE o_orderkey % 10 = 2)
    WHERE NOT (tag = 'stretch' AND job_id % 3 = 0)""")
def ups_tags(spark, sf):
    tags = corpus.job_tags(spark, sf)
    add = corpus.table(spark, sf, "orders").where("o_orderkey % 10 = 2").select(
        c("o_orderkey").alias("job_id"), F.lit(" fresh ").alias("tag"))
    remove = tags.where("job_id % 3 = 0 and tag = 'stretch'")
    return re_.change_tags(tags, add, remove)


@query("ups_10b_tag_replace", """SELECT job_id, tag FROM job_tags WHERE job_id % 4 <> 0
    UNION SELECT o_orderkey, 'only' FROM orders WHERE o_orderkey % 8 = 0""")
def ups_tag_replace(spark, sf):
    new = corpus.table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(
        c("o_orderkey").alias("job_id"),
        F.when(c("o_orderkey") % 8 == 0, "only").alias("tag"))
    return re_.replace_tags(corpus.job_tags(spark, sf), new)


# --- scoring ------------------------------------------------------------------------------

_AGE = (f"greatest(0, CAST(floor(epoch({AS_OF_SQL} - date_posted) / 86400) AS BIGINT))")
_FACTS = ("facts", f"""SELECT jobs.*, CASE WHEN date_posted IS NOT NULL THEN {_AGE} END
    AS posting_age_days, length(coalesce(description_text, '')) AS description_length,
    coalesce(k.n, 0) AS skill_count, coalesce(k.names, []) AS skill_names,
    coalesce(companies.jobs_discovered, 0) AS company_jobs_discovered,
    companies.industry AS company_industry, companies.size_estimate AS company_size_estimate,
    coalesce(companies.hiring_frequency_30d, 0) AS company_hiring_frequency_30d
    FROM jobs LEFT JOIN companies USING (company_key)
    LEFT JOIN (SELECT job_id, count(*) AS n, list(lower(skill)) AS names FROM job_skills
      GROUP BY 1) k USING (job_id)""")


@query("scr_01_facts", """SELECT job_id, posting_age_days, description_length, skill_count,
    array_to_string(list_sort(skill_names), '; ') AS skills, company_jobs_discovered,
    company_industry, company_size_estimate, company_hiring_frequency_30d,
    coalesce(urgently_hiring, FALSE) AS urgently_hiring FROM facts""", _FACTS)
def scr_facts(spark, sf):
    f = scoring.job_facts(corpus.enriched(spark, sf), corpus.companies(spark, sf), AS_OF)
    return f.select(
        "job_id", "posting_age_days", c("description_length").cast("long")
        .alias("description_length"), c("skill_count").cast("long").alias("skill_count"),
        joined(F.array_sort(F.transform("skills", F.lower))).alias("skills"),
        "company_jobs_discovered", "company_industry", "company_size_estimate",
        "company_hiring_frequency_30d", "urgently_hiring")


_LEAVES = [
    ("eq", {"field": "work_arrangement", "op": "eq", "value": "remote"},
     "coalesce(work_arrangement = 'remote', FALSE)"),
    ("ne", {"field": "employment_type", "op": "ne", "value": "contract"},
     "NOT coalesce(employment_type = 'contract', FALSE)"),
    ("gt", {"field": "years_experience_min", "op": "gt", "value": 3},
     "coalesce(years_experience_min > 3, FALSE)"),
    ("gte", {"field": "salary_annualized_min", "op": "gte", "value": 80000},
     "coalesce(salary_annualized_min >= 80000, FALSE)"),
    ("lt", {"field": "salary_annualized_max", "op": "lt", "value": 90000},
     "coalesce(salary_annualized_max < 90000, FALSE)"),
    ("lte", {"field": "posting_age_days", "op": "lte", "value": 365},
     "coalesce(posting_age_days <= 365, FALSE)"),
    ("contains", {"field": "title", "op": "contains", "value": "HARBOUR"},
     "contains(lower(title), 'harbour')"),
    ("contains_list", {"field": "skills", "op": "contains", "value": "sql"},
     "list_bool_or(list_transform(skill_names, lambda s: contains(s, 'sql')))"),
    ("not_contains", {"field": "city", "op": "not_contains", "value": "dal"},
     "NOT coalesce(contains(lower(city), 'dal'), FALSE)"),
    ("is_in", {"field": "state", "op": "in", "value": ["OK", "IL"]},
     "coalesce(state IN ('OK', 'IL'), FALSE)"),
    ("not_in", {"field": "state", "op": "not_in", "value": ["OK", None]},
     "NOT coalesce(state = 'OK', TRUE)"),
    ("is_true", {"field": "urgently_hiring", "op": "is_true"},
     "coalesce(urgently_hiring, FALSE)"),
    ("is_false", {"field": "visa_sponsorship_mentioned", "op": "is_false"},
     "coalesce(NOT visa_sponsorship_mentioned, FALSE)"),
    ("is_null", {"field": "education_level", "op": "is_null"}, "education_level IS NULL"),
    ("is_not_null", {"field": "relocation_mentioned", "op": "is_not_null"},
     "relocation_mentioned IS NOT NULL"),
    ("unlike", {"field": "title", "op": "gt", "value": 3}, "FALSE"),
    ("unknown", {"field": "nothing", "op": "is_null"}, "TRUE"),
]
_TREES = [
    ("both", {"all": [_LEAVES[0][1], _LEAVES[3][1]]},
     f"{_LEAVES[0][2]} AND {_LEAVES[3][2]}"),
    ("either", {"any": [_LEAVES[2][1], {"not": _LEAVES[9][1]}]},
     f"{_LEAVES[2][2]} OR NOT {_LEAVES[9][2]}"),
    ("nested", {"not": {"all": [{"any": [_LEAVES[6][1], _LEAVES[11][1]]}, _LEAVES[14][1]]}},
     f"NOT (({_LEAVES[6][2]} OR {_LEAVES[11][2]}) AND {_LEAVES[14][2]})"),
    ("nothing_all", {"all": []}, "TRUE"), ("nothing_any", {"any": []}, "FALSE"),
    ("malformed", {"garbage": True}, "FALSE"),
]


def _conditions(name: str, cases):
    def run(spark, sf):
        f = scoring.job_facts(corpus.enriched(spark, sf), corpus.companies_once(spark, sf), AS_OF)
        return f.select("job_id", *[scoring.compile_condition(x, f.schema).alias(n)
                                    for n, x, _ in cases])
    columns = ", ".join(f"coalesce({s}, FALSE) AS {n}" for n, _, s in cases)
    query(name, f"SELECT job_id, {columns} FROM facts", _FACTS)(run)


_conditions("scr_02_leaf_conditions", _LEAVES)
_conditions("scr_03_compound_conditions", _TREES)

_EARNED = """20 * CAST(coalesce(salary_annualized_min >= 80000, FALSE) AS INT)
    + 15 * CAST(coalesce(work_arrangement = 'remote', FALSE) AS INT)
    + 15 * CAST(coalesce(posting_age_days <= 7, FALSE) AS INT)
    + 10 * CAST(coalesce(employment_type = 'full_time', FALSE) AS INT)
    + 10 * CAST(coalesce(urgently_hiring, FALSE) AS INT)
    + 15 * CAST(company_jobs_discovered >= 5 AS INT)
    + 10 * CAST(description_length >= 1500 AS INT)
    + 5 * CAST(NOT salary_is_estimated AS INT)"""


@query("scr_04_job_score", f"""SELECT job_id, round(100.0 * ({_EARNED}) / 100.0, 1) AS
    opportunity_score FROM facts""", _FACTS)
def scr_jobs(spark, sf):
    return scoring.rescore(corpus.enriched(spark, sf), corpus.companies_once(spark, sf),
                           scoring.DEFAULT_RULES, AS_OF)


@query("scr_05_rescore_subset", f"""SELECT job_id, round(greatest(0, 100.0 * (
    10 * CAST(coalesce(contains(lower(title), 'junior'), FALSE) AS INT)
    - 5 * CAST(coalesce(urgently_hiring, FALSE) AS INT)) / 15.0), 1) AS opportunity_score
    FROM facts WHERE job_id IN (SELECT job_id FROM research)""", _FACTS)
def scr_subset(spark, sf):
    rules = [{"points": 5, "weight": 2, "condition":
              '{"field": "title", "op": "contains", "value": "junior"}'},
             {"points": -5, "condition": {"field": "urgently_hiring", "op": "is_true"}},
             {"points": 50, "is_active": False, "condition": {"all": []}}]
    return scoring.rescore(corpus.enriched(spark, sf), corpus.companies_once(spark, sf), rules, AS_OF,
                           only=corpus.research(spark, sf))


@query("scr_06_company_score", """SELECT company_key, coalesce(round(least(100, least(40, n * 4.0)
    + remote / n * 20.0 + paid / n * 10.0 + coalesce(least(20, mean / 6000.0), 0)
    + least(10, hiring_frequency_30d * 2.0)), 1), 0) AS opportunity_score FROM companies
    LEFT JOIN (SELECT company_key, count(*)::DOUBLE AS n,
      count(*) FILTER (work_arrangement = 'remote') AS remote,
      count(nullif(salary_annualized_min, 0)) AS paid,
      avg(nullif(salary_annualized_min, 0)) AS mean
      FROM scope GROUP BY 1) USING (company_key)""")
def scr_companies(spark, sf):
    jobs = corpus.jobs(spark, sf, "company_key", "work_arrangement", "salary_annualized_min",
                       "is_active", "is_primary")
    return scoring.score_companies(jobs, corpus.companies(spark, sf))


# --- filters ---------------------------------------------------------------------------------

def _filter(name: str, spec: dict, where: str, text_index: bool = False, sql: bool = True):
    def run(spark, sf):
        found = corpus.bundle(spark, sf, spec, show=("title",), text=text_index)
        return search.search(found, spec, AS_OF).select("job_id", "title")
    statement = f"SELECT job_id, title FROM scope WHERE {where}" if sql else None
    query(name, statement)(run)


def _ago(days: int) -> str:
    return f"{AS_OF_SQL} - INTERVAL {days} DAY"


_SKILL_IN = ("job_id IN (SELECT job_id FROM job_skills WHERE lower(skill) IN ({}))").format

_filter("flt_01_hygiene", {}, "TRUE")
query("flt_01b_everything", "SELECT job_id, title FROM jobs")(
    lambda spark, sf: search.search(corpus.bundle(spark, sf, {}, show=("title",)), {
        "include_duplicates": True, "include_inactive": True}, AS_OF).select("job_id", "title"))
_filter("flt_03_company", {"company": "#0000000"},
        "contains(lower(company_name_raw), '#0000000') OR company_key IN "
        "(SELECT company_key FROM companies WHERE contains(lower(name), '#0000000'))")
_filter("flt_04_place", {"city": "ulsa", "state": "ok", "country": "us"},
        "contains(lower(city), 'ulsa') AND upper(state) = 'OK' AND upper(country) = 'US'")
_filter("flt_04b_postal_code", {"postal_code": " 60601 "}, "postal_code = '60601'")
_filter("flt_05_date_preset", {"date_posted": "30"}, f"date_posted >= {_ago(30)}")
_filter("flt_05b_date_range", {"date_from": "1998-01-01", "date_to": "1998-06-30T00:00:00Z"},
        "date_posted >= TIMESTAMP '1998-01-01' AND date_posted <= TIMESTAMP '1998-06-30'")
_filter("flt_06_enums", {"employment_types": ["full_time", "contract"],
                         "work_arrangements": ["remote"], "experience_levels": ["senior", "mid"],
                         "education_levels": ["masters", "bachelors"]},
        "employment_type IN ('full_time', 'contract') AND work_arrangement = 'remote' AND "
        "experience_level IN ('senior', 'mid') AND education_level IN ('masters', 'bachelors')")
_filter("flt_07_salary_floor", {"salary_min": 100000},
        "salary_annualized_max >= 100000 OR salary_annualized_min >= 100000")
_filter("flt_08_salary_other", {"salary_max": 90000, "has_salary": True,
                                "employer_stated_salary": True},
        "salary_annualized_min <= 90000 AND NOT salary_is_estimated")
_filter("flt_09_title", {"title_contains": "harbour", "title_not_contains": "JUNIOR"},
        "contains(lower(title), 'harbour') AND NOT contains(lower(title), 'junior')")
_filter("flt_10_description", {"description_contains": "docker",
                               "description_not_contains": "h_brid"},
        "contains(lower(description_text), 'docker') AND "
        "NOT contains(lower(description_text), 'h_brid')")
_filter("flt_11_years", {"years_experience_min": 3, "years_experience_max": 7},
        "years_experience_min BETWEEN 3 AND 7")
_filter("flt_11b_years_ceiling", {"years_experience_max": 3},
        "years_experience_min IS NULL OR years_experience_min <= 3")
_filter("flt_12_flags", {"visa_sponsorship": True, "relocation": False, "easy_apply": False},
        "visa_sponsorship_mentioned AND NOT coalesce(relocation_mentioned, FALSE) "
        "AND NOT coalesce(easy_apply, FALSE)")
_filter("flt_13_age_and_score", {"max_posting_age_days": 200, "min_score": 40},
        f"date_posted >= {_ago(200)} AND opportunity_score >= 40")
_filter("flt_14_sources", {"sources": ["lever", "adzuna"]},
        "source_key IN ('lever', 'adzuna')")
_filter("flt_15_required_skills", {"required_skills": ["python", "Docker"]},
        _SKILL_IN("'python'") + " AND " + _SKILL_IN("'docker'"))
_filter("flt_16_any_skills", {"any_skills": ["Tableau", "epic"]},
        _SKILL_IN("'tableau', 'epic'"))
_filter("flt_17_excluded_skills", {"exclude_skills": ["Python", "SQL"]},
        "NOT " + _SKILL_IN("'python', 'sql'"))
_filter("flt_18_company_attributes",
        {"company_industry": "build", "company_size_min": 1000, "company_size_max": 8000,
         "company_min_jobs": 3, "company_min_hiring_frequency": 0,
         "company_ats": ["greenhouse", "lever"]},
        "company_key IN (SELECT company_key FROM companies WHERE contains(lower(industry), "
        "'build') AND size_estimate BETWEEN 1000 AND 8000 AND jobs_discovered >= 3 "
        "AND hiring_frequency_30d >= 0 AND ats_platform IN ('greenhouse', 'lever'))")
_filter("flt_19_research", {"research_status": ["relevant", "new"], "priority": ["medium"]},
        "job_id IN (SELECT job_id FROM research WHERE status IN ('relevant', 'new')) AND "
        "job_id IN (SELECT job_id FROM research WHERE priority = 'medium')")
_filter("flt_19b_tags", {"tags": ["shortlist", "stretch"]},
        "job_id IN (SELECT job_id FROM job_tags WHERE tag IN ('shortlist', 'stretch'))")
_CV = "(SELECT entity_id FROM custom_values WHERE key = '{}' AND {})".format
_filter("flt_20_custom_fields",
        {"custom_fields": [{"key": "fit", "op": "gte", "value": 30},
                           {"key": "channel", "op": "not_contains", "value": "URGENT"},
                           {"key": "call_on", "op": "gte", "value": "1997-01-01"}]},
        f"job_id IN {_CV('fit', 'value_number >= 30')} AND job_id NOT IN "
        f"{_CV('channel', chr(99) + 'ontains(lower(value_text), ' + q('urgent') + ')')} AND "
        f"job_id IN {_CV('call_on', 'value_date >= TIMESTAMP ' + q('1997-01-01'))}")
_filter("flt_20b_custom_options",
        {"custom_fields": [{"key": "labels", "op": "eq", "value": "F"},
                           {"key": "reviewed", "op": "is_empty"},
                           {"key": "channel", "op": "eq", "value": "2-high"}]},
        f"job_id IN {_CV('labels', 'list_contains(CAST(value_json AS JSON)::VARCHAR[], ' + q('f') + ')')} "
        f"AND job_id NOT IN {_CV('reviewed', 'value_bool IS NOT NULL')} AND "
        f"job_id IN {_CV('channel', 'lower(value_text) = ' + q('2-high'))}")


@query("flt_21_any_word", f"""SELECT doc_id FROM documents WHERE
    contains(lower(concat_ws(' ', source, text, lang)), 'src3') OR
    contains(lower(concat_ws(' ', source, text, lang)), 'tionha')""")
def flt_any_word(spark, sf):
    docs = corpus.table(spark, sf, "documents").select(
        "doc_id", c("source").alias("title"), c("text").alias("description_text"),
        F.lit(None).cast("string").alias("description_html"), c("lang").alias("location_raw"))
    return search.filter_any_word(docs, "SRC3 tionha").select("doc_id")


@query("flt_23_companies", """SELECT company_key FROM companies WHERE contains(lower(name), '1')
    AND contains(lower(industry), 'mach') AND ats_platform = 'lever' AND jobs_discovered >= 5""")
def flt_companies(spark, sf):
    return search.filter_companies(corpus.companies(spark, sf), q="1", industry="mach",
                                   ats="lever", min_jobs=5).select("company_key")


@query("flt_24_skills", "SELECT p_partkey AS skill_id, p_name AS name FROM part "
       "WHERE contains(lower(p_name), 'blue') AND p_brand = 'Brand#4'")
def flt_skills(spark, sf):
    return search.filter_skills(_part_taxonomy(spark, sf), "Blue", "Brand#4").select(
        "skill_id", "name")


@query("flt_24b_skills_by_category", """SELECT p_brand AS category,
    array_to_string(list_sort(list(p_name)), '; ') AS skills, count(*) AS n
    FROM part GROUP BY 1""")
def flt_skill_groups(spark, sf):
    return search.skills_by_category(_part_taxonomy(spark, sf)).withColumn(
        "skills", joined("skills"))


# --- text search -------------------------------------------------------------------------------

_TOKENS = ("tokens", r"""SELECT doc_id, field, t[i] AS term, i - 1 AS pos FROM (
    SELECT doc_id, field, t, unnest(range(1, len(t) + 1)) AS i FROM (
      SELECT doc_id, 0 AS field, regexp_extract_all(strip_accents(lower(text)),
        '[\p{L}\p{N}]+') AS t FROM documents
      UNION ALL SELECT doc_id, 1, regexp_extract_all(strip_accents(lower(source)),
        '[\p{L}\p{N}]+') FROM documents))""")
_LENS = ("lens", "SELECT doc_id, count(*) AS len FROM tokens GROUP BY 1")


def _doc_index(spark, sf, stemmed=False) -> textindex.TextIndex:
    docs = corpus.spread(corpus.table(spark, sf, "documents").select(
        "doc_id", "text", "source"))
    return textindex.build(docs, ("text", "source"), "doc_id", stemmed)


@query("txt_01_tokens", "SELECT doc_id AS job_id, count(*) AS tokens, count(DISTINCT term) AS "
       "terms FROM tokens GROUP BY 1", _TOKENS)
def txt_tokens(spark, sf):
    return _doc_index(spark, sf).rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_distinct("term").alias("terms"))


@query("txt_01b_stems")
def txt_stems(spark, sf):
    return _doc_index(spark, sf, stemmed=True).rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("docs"))


@query("txt_02_inverted_index", """SELECT term, doc_id AS job_id, field, count(*) AS tf,
    min(pos) AS first_pos FROM tokens GROUP BY ALL""", _TOKENS)
def txt_index(spark, sf):
    return _doc_index(spark, sf).rows.groupBy("term", "job_id", "field").agg(
        F.count(F.lit(1)).alias("tf"), F.min("pos").cast("long").alias("first_pos")).withColumn(
            "field", c("field").cast("int"))


def _tf(words: str) -> str:
    """(doc_id, tf) of a phrase in SQL."""
    parts = words.split()
    joins = " ".join(
        f"JOIN tokens t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.field = t0.field "
        f"AND t{i}.pos = t0.pos + {i} AND t{i}.term = {q(w)}"
        for i, w in enumerate(parts) if i)
    return (f"SELECT t0.doc_id, count(*) AS tf FROM tokens t0 {joins} "
            f"WHERE t0.term = {q(parts[0])} GROUP BY 1")


@query("txt_03_phrase", "SELECT doc_id AS job_id, tf FROM phrase",
       _TOKENS, ("phrase", _tf("of the")))
def txt_phrase(spark, sf):
    found = textindex.leaf_frequencies(_doc_index(spark, sf), [["of", "the"]])
    return found.where("tf0 > 0").select("job_id", c("tf0").alias("tf"))


_LEAF_WORDS = ["of the", "que", "and", "src3", "la"]
_LEAF_CTES = [(f"l{i}", _tf(w)) for i, w in enumerate(_LEAF_WORDS)]
_MATRIX = ("matrix", "SELECT lens.doc_id, len, " + ", ".join(
    f"coalesce(l{i}.tf, 0) AS tf{i}" for i in range(5)) + " FROM lens " + " ".join(
    f"LEFT JOIN l{i} USING (doc_id)" for i in range(5)))
_BOOLEAN = '("of the" OR que) AND (and NOT src3) || la'
_BOOLEAN_SQL = "((tf0 > 0 OR tf1 > 0) AND (tf2 > 0 AND tf3 = 0)) OR tf4 > 0"


@query("txt_04_boolean", f"SELECT doc_id AS job_id FROM matrix WHERE {_BOOLEAN_SQL}",
       _TOKENS, _LENS, *_LEAF_CTES, _MATRIX)
def txt_boolean(spark, sf):
    return textindex.match(_doc_index(spark, sf), _BOOLEAN).select("job_id")


def _bm25() -> str:
    parts = []
    for i in range(5):
        n = f"(SELECT count(*) FROM matrix WHERE tf{i} > 0)"
        total, avg = "(SELECT count(*) FROM documents)", (
            "(SELECT coalesce(sum(len), 0)::DOUBLE FROM lens) / (SELECT count(*) FROM documents)")
        idf = f"ln(({total} - {n} + 0.5) / ({n} + 0.5))"
        parts.append(f"CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END * tf{i} * 2.2 / "
                     f"(tf{i} + 1.2 * (0.25 + 0.75 * len / ({avg})))")
    return "-(" + " + ".join(parts) + ")"


@query("txt_05_bm25", f"""SELECT doc_id AS job_id, round({_bm25()}, 6) AS rank
    FROM matrix WHERE {_BOOLEAN_SQL}""", _TOKENS, _LENS, *_LEAF_CTES, _MATRIX)
def txt_bm25(spark, sf):
    return textindex.match(_doc_index(spark, sf), _BOOLEAN).select(
        "job_id", F.round("rank", 6).alias("rank"))


@query("txt_05b_bm25_stemmed")
def txt_stemmed(spark, sf):
    return textindex.match(_doc_index(spark, sf, stemmed=True), '"of the" OR tion')


_WORD_IN = (r"regexp_matches(lower(title || ' | ' || coalesce(description_text, '') || ' | ' "
            r"|| company_name_raw), '(^|[^a-z0-9]){}($|[^a-z0-9])')").format
_filter("txt_06_plain_query", {"keywords": "docker", "job_title": "pilot"},
        _WORD_IN("docker") + " AND " + _WORD_IN("pilot"), text_index=True)
_filter("flt_02_boolean_text", {"boolean": '(python OR "harbour pilot") NOT epic'},
        f"({_WORD_IN('python')} OR {_WORD_IN('harbour pilot')}) AND NOT {_WORD_IN('epic')}",
        text_index=True)


# --- joins -----------------------------------------------------------------------------------

@query("jon_01_inner", """SELECT company_key, skill, count(*) AS n FROM job_skills
    JOIN jobs USING (job_id) JOIN companies USING (company_key)
    WHERE industry = 'BUILDING' GROUP BY ALL""")
def jon_inner(spark, sf):
    j = corpus.jobs(spark, sf, "job_id", "company_key", "skills")
    about = corpus.companies(spark, sf).where("industry = 'BUILDING'").select("company_key")
    return (aggregates.explode_skills(j, "job_id", "company_key").join(about, "company_key")
            .groupBy("company_key", "skill").agg(F.count(F.lit(1)).alias("n")))


@query("jon_02_left_outer", """SELECT o_orderkey AS job_id, r.status FROM orders
    LEFT JOIN research r ON o_orderkey = job_id""")
def jon_left(spark, sf):
    ids = corpus.table(spark, sf, "orders").select(c("o_orderkey").alias("job_id"))
    return ids.join(corpus.research(spark, sf).select("job_id", "status"), "job_id", "left")


@query("jon_03_semi", """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem
    WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)""")
def jon_semi(spark, sf):
    items = corpus.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40")
    return corpus.table(spark, sf, "orders").select("o_orderkey").join(
        items.select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("jon_04_anti", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders
    WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def jon_anti(spark, sf):
    urgent = corpus.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return corpus.table(spark, sf, "customer").select("c_custkey").join(
        urgent.select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jon_05_prefetch", """SELECT raw.job_id, r.status, coalesce(t.tags, '') AS tags, industry
    FROM raw LEFT JOIN research r USING (job_id) LEFT JOIN (SELECT job_id,
      array_to_string(list_sort(list(DISTINCT tag)), '; ') AS tags FROM job_tags GROUP BY 1) t
      USING (job_id) LEFT JOIN jobs USING (job_id) LEFT JOIN companies USING (company_key)""")
def jon_prefetch(spark, sf):
    tags = aggregates.joined_names(corpus.job_tags(spark, sf), "job_id", "tag", "tags")
    return (corpus.jobs(spark, sf, "job_id", "company_key")
            .join(corpus.research(spark, sf).select("job_id", "status"), "job_id", "left")
            .join(tags, "job_id", "left")
            .join(corpus.companies(spark, sf).select("company_key", "industry"),
                  "company_key", "left")
            .select("job_id", "status", F.coalesce("tags", F.lit("")).alias("tags"),
                    "industry"))


@query("jon_06_theta_self", """SELECT i.canonical_hash, count(*) AS earlier,
    min(i.seq - j.seq) AS nearest, max(i.seq - j.seq) AS farthest FROM jobs i
    JOIN jobs j ON i.canonical_hash = j.canonical_hash AND j.seq < i.seq
    AND i.seq - j.seq <= 5000 GROUP BY 1""")
def jon_theta(spark, sf):
    jobs = corpus.jobs(spark, sf, "canonical_hash", "seq")
    return joins.earlier_within(jobs, "canonical_hash", "seq", 5000).groupBy("canonical_hash").agg(
        F.count(F.lit(1)).alias("earlier"), F.min(c("seq") - c("earlier_seq")).alias("nearest"),
        F.max(c("seq") - c("earlier_seq")).alias("farthest"))


@query("jon_07_literal_lookup", f"""SELECT source_key, {_DEPTH} AS depth, count(*) AS n
    FROM raw GROUP BY ALL""")
def jon_lookup(spark, sf):
    return (corpus.postings(spark, sf)
            .groupBy("source_key", fingerprint.source_depth(c("source_key")).alias("depth"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- aggregations --------------------------------------------------------------------------------

def _open(spark, sf):
    """The open primaries with all columns. The conditions test plain columns of the
    postings, so what is not selected of the rest is not computed."""
    return search.search(corpus.Corpus(corpus.enriched(spark, sf)), {}, AS_OF)


def _scope(spark, sf, *columns, **spec):
    """The open primaries, with the columns shown and those that the search reads."""
    return search.search(corpus.Corpus(corpus.jobs(
        spark, sf, *{*columns, *search.job_columns(spec)})), spec, AS_OF)


@query("agg_01_total", "SELECT count(*) AS total FROM scope WHERE work_arrangement = 'remote'")
def agg_total(spark, sf):
    return _scope(spark, sf, work_arrangements=["remote"]).agg(F.count(F.lit(1)).alias("total"))


@query("agg_02_facets", FACET_SQL)
def agg_facets(spark, sf):
    return aggregates.facets(_scope(spark, sf, *aggregates.FACETS, "skills"))


@query("agg_03_breakdowns", BREAKDOWN_SQL)
def agg_breakdowns(spark, sf):
    return aggregates.breakdowns(_scope(spark, sf, *aggregates.BREAKDOWNS, "work_arrangement"))


_BANDS = " ".join(f"WHEN salary_annualized_min < {h} THEN {q(b)}"
                  for b, h in vocab.SALARY_BANDS)
_BAND_NO = " ".join(f"WHEN salary_annualized_min < {h} THEN {i}"
                    for i, (_, h) in enumerate(vocab.SALARY_BANDS))


@query("agg_04_salary_bands", f"""SELECT CASE {_BAND_NO} ELSE 99 END AS band_order,
    CASE {_BANDS} ELSE 'Unknown' END AS band, count(*) AS n FROM scope
    WHERE salary_annualized_min IS NOT NULL GROUP BY ALL""")
def agg_bands(spark, sf):
    return aggregates.salary_bands(_scope(spark, sf, "salary_annualized_min"))


@query("agg_04b_price_bands", """SELECT l_returnflag, band, count(*) AS n FROM (
    SELECT l_returnflag, CASE """ + _BANDS.replace("salary_annualized_min", "l_extendedprice")
       + " ELSE 'Unknown' END AS band FROM lineitem) GROUP BY ALL")
def agg_price_bands(spark, sf):
    return (corpus.table(spark, sf, "lineitem")
            .groupBy("l_returnflag", pay.salary_band(c("l_extendedprice")).alias("band"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("agg_05_timeline", """SELECT strftime(day, '%Y-%m-%d') AS day, n FROM (
    SELECT CAST(date_posted AS DATE) AS day, count(*) AS n FROM scope
    WHERE date_posted IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 60)""")
def agg_timeline(spark, sf):
    return aggregates.timeline(_scope(spark, sf, "date_posted")).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("agg_06_salary_summary", """SELECT round(avg(salary_annualized_min)) AS avg_annualized,
    min(salary_annualized_min) AS min_annualized, max(salary_annualized_max) AS max_annualized
    FROM scope WHERE salary_annualized_min IS NOT NULL""")
def agg_salary(spark, sf):
    return aggregates.salary_summary(_scope(spark, sf, "salary_annualized_min",
                                            "salary_annualized_max"))


_CATEGORY = "CASE skill " + " ".join(
    f"WHEN {q(s)} THEN {q(k)}" for s, k in corpus.MATCHER.categories.items()) + " END"


@query("agg_07_skills_ranking", f"""SELECT skill, category, jobs, required_in, preferred_in,
    round(100.0 * jobs / (SELECT count(*) FROM scope), 1) AS share FROM (
    SELECT skill, {_CATEGORY} AS category, count(*) AS jobs,
      count(*) FILTER (requirement = 'required') AS required_in,
      count(*) FILTER (requirement = 'preferred') AS preferred_in
    FROM job_skills JOIN scope USING (job_id) GROUP BY 1, 2)
    WHERE category = 'technical' ORDER BY jobs DESC, skill LIMIT 8""")
def agg_skills(spark, sf):
    return aggregates.skills_ranking(_scope(spark, sf, "skills"), corpus.MATCHER, "technical", 8)


@query("agg_08_top_skills", f"""SELECT skill, {_CATEGORY} AS category, count(*) AS jobs
    FROM job_skills JOIN scope USING (job_id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 30""")
def agg_top_skills(spark, sf):
    return aggregates.top_skills(_scope(spark, sf, "skills"), corpus.MATCHER)


@query("agg_09_top_hiring", f"""SELECT company_key, name, industry, ats_platform, n AS jobs_posted,
    365 AS window_days FROM (SELECT company_key, count(*) AS n FROM jobs WHERE is_primary AND
    date_posted >= {_ago(365)} GROUP BY 1) JOIN companies USING (company_key)
    ORDER BY n DESC, company_key LIMIT 25""")
def agg_hiring(spark, sf):
    return aggregates.top_hiring(corpus.jobs(spark, sf, *corpus.EMPLOYER_COLUMNS),
                                 corpus.companies(spark, sf), AS_OF, days=365)


@query("agg_10_company_profile", """SELECT company_key, count(*) AS jobs_total,
    count(*) FILTER (is_active) AS jobs_active,
    count(*) FILTER (is_active AND work_arrangement = 'remote') AS jobs_remote,
    count(p) AS salary_count, min(p) AS salary_min, max(p) AS salary_max,
    round(avg(p)) AS salary_avg FROM (SELECT *, CASE WHEN is_active THEN
      nullif(salary_annualized_min, 0) END AS p FROM jobs WHERE is_primary) GROUP BY 1""")
def agg_profile(spark, sf):
    return aggregates.company_profile(corpus.jobs(
        spark, sf, "company_key", "is_primary", "is_active", "work_arrangement", "salary_annualized_min"))


@query("agg_10b_company_tallies", " UNION ALL ".join(
    f"SELECT company_key, {q(d)} AS dim, coalesce({d}, 'unknown') AS value, count(*) AS n "
    f"FROM scope GROUP BY 1, 3"
    for d in ("city", "employment_type", "experience_level", "work_arrangement")))
def agg_tallies(spark, sf):
    return aggregates.company_tallies(corpus.jobs(
        spark, sf, "company_key", "is_primary", "is_active", "city", "employment_type",
        "experience_level", "work_arrangement"))


@query("agg_10c_company_skills", """SELECT company_key, value, n, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY company_key ORDER BY n DESC, value) AS rank FROM (
    SELECT company_key, skill AS value, count(*) AS n FROM job_skills JOIN jobs USING (job_id)
    WHERE is_primary GROUP BY ALL)) WHERE rank <= 20""")
def agg_company_skills(spark, sf):
    return aggregates.company_skills(corpus.jobs(
        spark, sf, "company_key", "is_primary", "skills"))


@query("agg_10d_company_newest", """SELECT company_key, job_id, rank FROM (SELECT company_key,
    job_id, row_number() OVER (PARTITION BY company_key ORDER BY date_posted DESC NULLS LAST,
    job_id) AS rank FROM scope) WHERE rank <= 100""")
def agg_newest(spark, sf):
    return aggregates.company_newest(corpus.jobs(
        spark, sf, "company_key", "job_id", "date_posted", "is_primary", "is_active")).drop("date_posted")


@query("agg_11_cadence", """SELECT company_key, month, n FROM (SELECT *, row_number() OVER (
    PARTITION BY company_key ORDER BY month DESC) AS rank FROM (SELECT company_key,
    strftime(date_posted, '%Y-%m') AS month, count(*) AS n FROM jobs
    WHERE is_primary AND date_posted IS NOT NULL GROUP BY ALL)) WHERE rank <= 6""")
def agg_cadence(spark, sf):
    return aggregates.cadence(corpus.jobs(spark, sf, *corpus.EMPLOYER_COLUMNS))


@query("agg_12_overview", """SELECT count(*) FILTER (is_primary AND is_active) AS jobs_active,
    count(*) FILTER (NOT is_primary) AS duplicates_linked,
    count(DISTINCT company_key) AS companies,
    count(*) FILTER (is_primary AND salary_annualized_min IS NOT NULL) AS jobs_with_salary
    FROM jobs""")
def agg_overview(spark, sf):
    return aggregates.overview(corpus.jobs(
        spark, sf, "company_key", "is_primary", "is_active", "salary_annualized_min"))


def _runs(spark, sf) -> DataFrame:
    """The events table read as a run log."""
    return corpus.table(spark, sf, "events").select(
        c("event_id").alias("run_id"), c("ts").alias("started_at"),
        c("user_id").alias("results_new"), c("event_type").alias("run_type"),
        F.when(c("value") > 50, "failed").otherwise("done").alias("status"))


@query("agg_12b_last_run", """SELECT event_id AS run_id, user_id AS results_new,
    CASE WHEN value > 50 THEN 'failed' ELSE 'done' END AS status FROM events
    WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1""")
def agg_last_run(spark, sf):
    return aggregates.last_run(_runs(spark, sf), "purchase").drop("started_at")


@query("agg_13_status_summary", f"""SELECT s AS status,
    (SELECT count(*) FROM research WHERE coalesce(status, 'new') = s)
    + CASE WHEN s = 'new' THEN (SELECT count(*) FROM raw WHERE is_primary AND job_id NOT IN
      (SELECT job_id FROM research)) ELSE 0 END AS n
    FROM (SELECT unnest({sql_list(vocab.RESEARCH_STATUSES)}) AS s)""")
def agg_status(spark, sf):
    return re_.status_summary(corpus.research(spark, sf), corpus.postings(spark, sf))


@query("agg_14_tag_counts", """SELECT tag, count(job_id) AS n FROM (
    SELECT DISTINCT tag FROM job_tags UNION SELECT DISTINCT lower(o_orderpriority) FROM orders)
    LEFT JOIN job_tags USING (tag) GROUP BY 1""")
def agg_tags(spark, sf):
    return re_.tag_counts(corpus.tags(spark, sf), corpus.job_tags(spark, sf))


@query("agg_15_boards_known", """SELECT ats_platform, count(*) AS boards FROM companies
    WHERE ats_platform IS NOT NULL GROUP BY 1""")
def agg_boards(spark, sf):
    return co.boards_known(corpus.companies(spark, sf))


@query("agg_16_count_distinct", """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
    count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def agg_distinct(spark, sf):
    return corpus.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_17_remote_share", """SELECT count(*) AS jobs,
    count(*) FILTER (work_arrangement = 'remote') AS remote_jobs,
    round(count(*) FILTER (work_arrangement = 'remote') / count(*)::DOUBLE, 4) AS remote_share,
    count(DISTINCT company_key) AS employers FROM scope""")
def agg_remote(spark, sf):
    return aggregates.remote_share(_scope(spark, sf, "company_key", "work_arrangement"))


@query("agg_18_string_aggregation", """SELECT o_custkey,
    array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS priorities
    FROM orders GROUP BY 1""")
def agg_strings(spark, sf):
    return aggregates.joined_names(corpus.table(spark, sf, "orders"), "o_custkey",
                                   "o_orderpriority", "priorities")


# --- custom fields -----------------------------------------------------------------------------

_ENTRY = ("CASE o_orderkey % 5 WHEN 0 THEN 'fit' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'call_on' "
          "WHEN 3 THEN 'channel' ELSE 'missing' END")
_VALUE = ("CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 "
          "THEN 'many' WHEN o_orderkey % 5 = 0 THEN '12.5' WHEN o_orderkey % 5 = 1 THEN 'true' "
          "WHEN o_orderkey % 5 = 2 AND o_orderkey % 3 = 0 THEN 'someday' "
          "WHEN o_orderkey % 5 = 2 THEN '2001-02-03 04:05:06' ELSE o_orderpriority END")


def _entries(spark, sf) -> DataFrame:
    return corpus.table(spark, sf, "orders").select(
        F.expr(_ENTRY).alias("key"), F.lit("job").alias("entity"),
        c("o_orderkey").alias("entity_id"), F.expr(_VALUE).alias("value"))


@query("eav_01_typed_write", f"""SELECT key, entity_id,
    CASE WHEN key = 'channel' THEN nullif(value, '') END AS value_text,
    CASE WHEN key = 'fit' THEN try_cast(value AS DOUBLE) END AS value_number,
    CASE WHEN key = 'reviewed' AND value <> '' THEN TRUE END AS value_bool,
    CASE WHEN key = 'call_on' THEN strftime(try_cast(value AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
      END AS value_date, FALSE AS rejected
    FROM (SELECT {_ENTRY} AS key, o_orderkey AS entity_id, {_VALUE} AS value FROM orders)
    WHERE key <> 'missing' AND value NOT IN ('many', 'someday')
    UNION ALL SELECT {_ENTRY}, o_orderkey, NULL, NULL, NULL, NULL, TRUE FROM orders
    WHERE {_ENTRY} = 'missing' OR {_VALUE} IN ('many', 'someday')""")
def eav_write(spark, sf):
    good, bad = customfields.write_values(_entries(spark, sf), dict(corpus.FIELDS))
    shown = good.select("key", "entity_id", "value_text", "value_number", "value_bool",
                        F.date_format("value_date", "yyyy-MM-dd HH:mm:ss").alias("value_date"),
                        F.lit(False).alias("rejected"))
    return shown.unionByName(bad.select("key", "entity_id", F.lit(True).alias("rejected")),
                             allowMissingColumns=True)


@query("eav_02_typed_read", """SELECT entity_id,
    max(value_number) FILTER (key = 'fit') AS fit,
    max(value_text) FILTER (key = 'channel') AS channel,
    bool_or(value_bool) FILTER (key = 'reviewed') AS reviewed,
    strftime(max(value_date) FILTER (key = 'call_on'), '%Y-%m-%d') AS call_on,
    array_to_string(CAST(max(value_json) FILTER (key = 'labels') AS JSON)::VARCHAR[], '; ')
      AS labels FROM custom_values GROUP BY 1""")
def eav_read(spark, sf):
    wide = customfields.read_values(corpus.custom_values(spark, sf), dict(corpus.FIELDS))
    return wide.withColumns({"call_on": F.date_format("call_on", "yyyy-MM-dd"),
                             "labels": joined("labels")})


# --- sorts, pages, saved searches ------------------------------------------------------------------

def _sorted(name: str, sort: str, direction: str, order: str, number: int = 1,
            size: int = 50, **spec):
    where = spec.pop("where", "TRUE")
    shown = [ranking.SORT_FIELDS.get(sort, "opportunity_score"), "date_posted"]

    def run(spark, sf):
        ordered = ranking.order_jobs(_scope(spark, sf, *shown, **spec), sort, direction)
        return ranking.page(ordered, number, size).select("job_id")
    query(name, f"SELECT job_id FROM scope WHERE {where} ORDER BY {order}, job_id "
          f"LIMIT {size} OFFSET {(number - 1) * size}")(run)


_sorted("srt_01_salary_desc", "salary", "desc", "salary_annualized_min DESC NULLS LAST")
_sorted("srt_01b_location_asc", "location", "asc", "city ASC NULLS FIRST")
_sorted("srt_01c_title_asc", "title", "asc", "title ASC NULLS FIRST")
_sorted("srt_02_relevance", "relevance", "asc",
        "opportunity_score DESC NULLS LAST, date_posted DESC NULLS LAST")
_sorted("srt_03_third_page", "date_posted", "desc", "date_posted DESC NULLS LAST", 3, 20)


@query("srt_02b_text_relevance")
def srt_text(spark, sf):
    found = search.search(corpus.bundle(spark, sf, {}, show=("date_posted",), text=True),
                          {"keywords": "python"}, AS_OF)
    return ranking.page(ranking.order_jobs(found), 1, 50).select("job_id", "rank")


@query("srt_03b_page_count", """SELECT count(*) AS total,
    greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM scope""")
def srt_pages(spark, sf):
    return ranking.page_count(_scope(spark, sf), 50)


@query("srt_04_company_sort", """SELECT company_key, jobs_discovered FROM companies
    ORDER BY jobs_discovered DESC NULLS LAST, company_key LIMIT 40""")
def srt_companies(spark, sf):
    ordered = ranking.order_companies(corpus.companies(spark, sf), "no such sort")
    return ordered.limit(40).select("company_key", "jobs_discovered")


@query("srt_05_run_log_tail", """SELECT event_id AS run_id, user_id AS results_new FROM events
    WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def srt_log(spark, sf):
    return ranking.log_tail(_runs(spark, sf), "started_at", "run_id", 50,
                            run_type="error").select("run_id", "results_new")


_SAVED = {
    "remote seniors": {"work_arrangements": ["remote"], "experience_levels": ["senior"]},
    "paid over 100k": {"salary_min": 100000},
    "anything in oklahoma": {"state": "OK", "include_inactive": True},
}


@query("srt_06_saved_searches", """SELECT name, sum(hit)::BIGINT AS total,
    (sum(hit) FILTER (date_collected > TIMESTAMP '2001-01-01'))::BIGINT AS fresh FROM (
    SELECT 'remote seniors' AS name, date_collected, CAST(is_primary AND is_active AND
      work_arrangement = 'remote' AND coalesce(experience_level = 'senior', FALSE) AS INT) AS hit
      FROM jobs
    UNION ALL SELECT 'paid over 100k', date_collected, CAST(is_primary AND is_active AND
      (coalesce(salary_annualized_max >= 100000, FALSE)
       OR coalesce(salary_annualized_min >= 100000, FALSE)) AS INT) FROM jobs
    UNION ALL SELECT 'anything in oklahoma', date_collected,
      CAST(is_primary AND coalesce(state = 'OK', FALSE) AS INT) FROM jobs) GROUP BY 1""")
def srt_saved(spark, sf):
    found = corpus.bundle(spark, sf, *_SAVED.values(), show=("date_collected",))
    return search.run_saved(found, _SAVED, AS_OF, dt.datetime(2001, 1, 1))


@query("srt_06b_saved_with_bridges", """SELECT 'tagged' AS name, count(*) AS total,
    count(*) FILTER (date_collected > TIMESTAMP '2001-01-01') AS fresh FROM scope
    WHERE job_id IN (SELECT job_id FROM job_tags WHERE tag = 'referral')
    UNION ALL SELECT 'remote', count(*), count(*) FILTER (
      date_collected > TIMESTAMP '2001-01-01') FROM scope WHERE work_arrangement = 'remote'""")
def srt_saved_bridges(spark, sf):
    saved = {"tagged": {"tags": ["referral"]}, "remote": {"work_arrangements": ["remote"]}}
    found = corpus.bundle(spark, sf, *saved.values(), show=("date_collected",))
    return search.run_saved(found, saved, AS_OF, dt.datetime(2001, 1, 1))


# --- sinks ---------------------------------------------------------------------------------------

_EXPORT = ["id", "title", "company", "location", "city", "salary_annualized_min",
           "salary_is_estimated", "source", "skills", "benefits", "tags", "research_status",
           "research_priority", "research_notes", "duplicate_count", "cf_fit", "cf_channel"]


@query("snk_01_export_rows", """SELECT scope.job_id AS id, title, company_name_raw AS company,
    location_raw AS location, city, salary_annualized_min, salary_is_estimated,
    source_key AS source, coalesce(k.skills, '') AS skills,
    array_to_string(list_sort(benefits), '; ') AS benefits, coalesce(t.tags, '') AS tags,
    CASE WHEN r.job_id IS NULL THEN 'new' ELSE r.status END AS research_status,
    r.priority AS research_priority, r.notes AS research_notes, duplicate_count,
    v.fit AS cf_fit, v.channel AS cf_channel FROM scope
    LEFT JOIN (SELECT job_id, array_to_string(list_sort(list(skill)), '; ') AS skills
      FROM job_skills GROUP BY 1) k USING (job_id)
    LEFT JOIN (SELECT job_id, array_to_string(list_sort(list(tag)), '; ') AS tags
      FROM job_tags GROUP BY 1) t USING (job_id)
    LEFT JOIN research r USING (job_id)
    LEFT JOIN (SELECT entity_id AS job_id, max(value_number) FILTER (key = 'fit') AS fit,
      max(value_text) FILTER (key = 'channel') AS channel FROM custom_values GROUP BY 1) v
      USING (job_id)""")
def snk_rows(spark, sf):
    fields = {k: t for k, t in corpus.FIELDS if k in ("fit", "channel")}
    return export.export_rows(
        _open(spark, sf), corpus.job_tags(spark, sf), corpus.research(spark, sf),
        corpus.custom_values(spark, sf), fields).select(*_EXPORT)


def _written(spark, sf, fmt: str) -> DataFrame:
    """Export the scope, then read the files back."""
    duplicates.use_checkpoint_folder(spark)
    root = spark.sparkContext.getCheckpointDir()
    rows = export.export_rows(_open(spark, sf)).select(
        "id", "title", "city", "salary_annualized_min",
        F.col("date_posted").cast("timestamp").alias("date_posted"))
    path, _ = export.write_export(rows, root, fmt, f"{root}/export-log", AS_OF)
    back = spark.read.schema(
        "id long, title string, city string, salary_annualized_min double, "
        "date_posted string")
    return back.option("header", True).csv(path) if fmt == "csv" else back.json(path)


_SINK_SQL = """SELECT job_id AS id, title, city, salary_annualized_min,
    strftime(date_posted, '%Y-%m-%d %H:%M:%S') AS date_posted FROM scope"""


@query("snk_02_csv", _SINK_SQL)
def snk_csv(spark, sf):
    return _written(spark, sf, "csv")


@query("snk_03_json", _SINK_SQL)
def snk_json(spark, sf):
    return _written(spark, sf, "json")


@query("snk_04_export_log", """SELECT 'json' AS format, count(*) AS rows FROM scope""")
def snk_log(spark, sf):
    duplicates.use_checkpoint_folder(spark)
    root = spark.sparkContext.getCheckpointDir()
    log = f"{root}/log-{dt.datetime.now().timestamp()}"
    export.write_export(export.export_rows(_open(spark, sf)).select("id", "title"),
                        root, "json", log, AS_OF)
    return spark.read.parquet(log).select("format", "rows")


@query("snk_05_snapshot", "SELECT job_id, title_normalized, city FROM jobs")
def snk_snapshot(spark, sf):
    duplicates.use_checkpoint_folder(spark)
    path = upserts.save_snapshot(corpus.enriched(spark, sf).select(
        "job_id", "title_normalized", "city"), spark.sparkContext.getCheckpointDir())
    return spark.read.parquet(path)


# --- streaming -------------------------------------------------------------------------------------

# Arrival order of the drops, which the stream's own numbering follows.
_ARRIVED = """row_number() OVER (ORDER BY job_id % 3, source_key, source_job_id) AS job_id"""
_ARRIVALS = ("raw", f"SELECT * REPLACE ({_ARRIVED}), job_id AS first_id FROM ({RAW_SQL})")


@query("stm_01_incremental_ingest", """SELECT raw.source_job_id,
    coalesce(prime = raw.job_id, TRUE) AS is_primary, CASE WHEN prime <> raw.job_id
      THEN (SELECT r.source_job_id FROM raw r WHERE r.job_id = prime) END AS duplicate_of,
    CASE WHEN prime = raw.job_id THEN n ELSE 0 END AS duplicate_count,
    CASE WHEN first_id % 3 = 2 THEN CASE WHEN l.job_id IS NULL THEN 'new' ELSE 'duplicate' END
      WHEN first_id % 3 = 0 THEN 'updated' END AS outcome
    FROM raw LEFT JOIN members USING (job_id) LEFT JOIN best USING (root)
    LEFT JOIN links l ON l.job_id = raw.job_id""", _ARRIVALS, *_LINK_TABLES, *_FOREST)
def stm_ingest(spark, sf):
    """The whole corpus landed in three drops, the first seen again with the third; each
    drop is linked with what is stored. The result equals linking all at once."""
    from rolemill.schema import RAW_POSTING
    from rolemill.streaming import ingest

    base = _fresh(spark, "ingest")
    raw = corpus.postings(spark, sf).withColumn("raw", F.lit("{}")).select(
        "job_id", *RAW_POSTING.fieldNames())
    for part in (0, 1, 2):
        drop = raw.where((c("job_id") % 3 == part) | ((c("job_id") % 3 == 0) & F.lit(part == 2)))
        drop.drop("job_id").write.mode("append").json(f"{base}/landing")
        ingest.run_available(spark, f"{base}/landing", f"{base}/corpus", f"{base}/progress",
                             corpus.MATCHER, sequence=False, buckets=8).awaitTermination()
    jobs = ingest.current_jobs(spark, f"{base}/corpus")
    names = jobs.select(c("job_id").alias("duplicate_of"), c("source_job_id").alias("primary"))
    return jobs.join(names, "duplicate_of", "left").select(
        "source_job_id", "is_primary", c("primary").alias("duplicate_of"), "duplicate_count",
        "outcome")
