"""Landed provider payloads to raw postings.

``land`` scans a folder of JSON files, compressed or not, with a payload a line or a
payload a file, and keeps what it cannot read; the function named after a provider maps
its payload rows to ``RAW_POSTING``. Schemas are given, so a scan parses only the
fields it maps and never infers. Board payloads are one file per board; the file's name
is the board token.
"""

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolemill import vocab
from rolemill.functions.dates import parse_date, parse_epoch
from rolemill.functions.text import clean
from rolemill.schema import RAW_POSTING


def shape(items: DataFrame, **columns: Column) -> DataFrame:
    """Project to the raw posting schema; fields not given are NULL."""
    out = []
    for f in RAW_POSTING:
        value = columns.get(f.name)
        if f.name == "description_is_truncated" or f.name == "salary_is_estimated":
            value = F.lit(False) if value is None else value
        if f.name == "salary_currency" and value is None:
            value = F.lit("USD")
        value = F.lit(None) if value is None else value
        out.append(value.cast(f.dataType).alias(f.name))
    return items.select(*out)


def _title(c: Column) -> Column:
    return F.coalesce(clean(c), F.lit(vocab.UNTITLED))


def _first(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


# --- fixed values: the fields read from each provider's payload ---
SCHEMAS = {
    "remotive": """jobs array<struct<id:string,title:string,
        company_name:string,company_logo:string,description:string,
        candidate_required_location:string,job_type:string,publication_date:string,
        url:string,salary:string,category:string,tags:array<string>>>""",
    "adzuna": """results array<struct<id:string,title:string,
        description:string,company:struct<display_name:string>,
        location:struct<display_name:string,area:array<string>>,latitude:double,
        longitude:double,contract_time:string,contract_type:string,salary_min:double,
        salary_max:double,salary_is_predicted:string,created:string,
        redirect_url:string,category:struct<label:string>>>""",
    "usajobs": """SearchResult struct<SearchResultItems:array<struct<
        MatchedObjectId:string,MatchedObjectDescriptor:struct<PositionID:string,
        PositionTitle:string,OrganizationName:string,DepartmentName:string,
        PositionURI:string,ApplyURI:array<string>,PublicationStartDate:string,
        PositionLocation:array<struct<LocationName:string,CityName:string,
        CountrySubDivisionCode:string,Latitude:double,Longitude:double>>,
        PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string,
        RateIntervalCode:string>>,PositionSchedule:array<struct<Name:string>>,
        UserArea:struct<Details:struct<JobSummary:string,MajorDuties:string,
        Requirements:string,Qualifications:string,Education:string,Benefits:string,
        LowGrade:string,TeleworkEligible:string>>>>>>""",
    "greenhouse": """jobs array<struct<id:string,title:string,content:string,
        location:struct<name:string>,updated_at:string,first_published:string,
        absolute_url:string,departments:array<struct<name:string>>,
        offices:array<struct<name:string>>>>""",
    "lever": """id string,text string,description string,
        descriptionPlain string,categories struct<location:string,commitment:string,
        team:string,department:string>,createdAt long,hostedUrl string,
        applyUrl string,workplaceType string,lists string""",
    "ashby": """jobs array<struct<id:string,title:string,
        descriptionHtml:string,descriptionPlain:string,location:string,
        employmentType:string,isRemote:boolean,publishedAt:string,updatedAt:string,
        jobUrl:string,applyUrl:string,department:string,team:string,
        compensation:struct<compensationTierSummary:string>>>""",
    "workable": """name string,jobs array<struct<id:string,
        shortcode:string,title:string,description:string,city:string,state:string,
        country:string,employment_type:string,telecommuting:boolean,
        published_on:string,created_at:string,url:string,application_url:string,
        department:string>>""",
}


def remotive(rows: DataFrame) -> DataFrame:
    item = F.col("x")
    return shape(
        rows.select(F.explode("jobs").alias("x")),
        source_key=F.lit("remotive"), source_job_id=item["id"],
        title=_title(item["title"]), company_name=clean(item["company_name"]),
        company_website=clean(item["company_logo"]),
        description_html=item["description"],
        location_raw=clean(item["candidate_required_location"]), country=F.lit("US"),
        is_remote=F.lit(True), employment_type=clean(item["job_type"]),
        date_posted=parse_date(item["publication_date"]),
        job_url=clean(item["url"]), apply_url=clean(item["url"]),
        raw=F.to_json(F.struct(clean(item["salary"]).alias("salary_text"),
                               item["category"].alias("category"),
                               item["tags"].alias("tags"))))


def adzuna(rows: DataFrame) -> DataFrame:
    """Areas run from broad to narrow: the second is the state, and the last is
    the city when there are more than two."""
    item = F.col("x")
    area = F.coalesce(item["location"]["area"], F.array().cast("array<string>"))
    return shape(
        rows.select(F.explode("results").alias("x")),
        source_key=F.lit("adzuna"), source_job_id=item["id"],
        title=_title(item["title"]), company_name=clean(item["company"]["display_name"]),
        description_html=item["description"], description_is_truncated=F.lit(True),
        location_raw=clean(item["location"]["display_name"]),
        state=clean(F.try_element_at(area, F.lit(2))),
        city=F.when(F.size(area) > 2, clean(F.try_element_at(area, F.lit(-1)))),
        country=F.lit("US"), latitude=item["latitude"], longitude=item["longitude"],
        employment_type=clean(item["contract_time"]), salary_min=item["salary_min"],
        salary_max=item["salary_max"], salary_period=F.lit("yearly"),
        salary_is_estimated=F.coalesce(item["salary_is_predicted"] == "1", F.lit(False)),
        date_posted=parse_date(item["created"]), job_url=clean(item["redirect_url"]),
        apply_url=clean(item["redirect_url"]),
        raw=F.to_json(F.struct(item["category"]["label"].alias("category"),
                               item["contract_type"].alias("contract_type"))))


def usajobs(rows: DataFrame) -> DataFrame:
    """The description joins six detail parts; MajorDuties may be text or a list,
    so it is read as a string and parsed when it is one."""
    items = rows.select(F.explode("SearchResult.SearchResultItems").alias("x")).where(
        "x.MatchedObjectDescriptor is not null")
    d = F.col("x.MatchedObjectDescriptor")
    detail = d["UserArea"]["Details"]

    def first(array):
        return F.try_element_at(array, F.lit(1))

    place, pay = first(d["PositionLocation"]), first(d["PositionRemuneration"])
    duties = F.coalesce(
        F.array_join(F.when(detail["MajorDuties"].startswith("["),
                            F.from_json(detail["MajorDuties"], "array<string>")), "\n"),
        detail["MajorDuties"])
    parts = [detail["JobSummary"], duties, detail["Requirements"],
             detail["Qualifications"], detail["Education"], detail["Benefits"]]
    periods = F.create_map(*[F.lit(v) for v in (
        "Per Year", "yearly", "Per Hour", "hourly", "Per Month", "monthly",
        "Per Week", "weekly")])
    return shape(
        items,
        source_key=F.lit("usajobs"),
        source_job_id=_first(d["PositionID"], F.col("x.MatchedObjectId")),
        title=_title(d["PositionTitle"]), company_name=clean(d["OrganizationName"]),
        description_text=F.nullif(F.concat_ws(
            "\n\n", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("")),
        location_raw=clean(place["LocationName"]), city=clean(place["CityName"]),
        state=clean(place["CountrySubDivisionCode"]), country=F.lit("US"),
        latitude=place["Latitude"], longitude=place["Longitude"],
        is_remote=F.coalesce(F.lower(detail["TeleworkEligible"]) == "true", F.lit(False)),
        employment_type=clean(first(d["PositionSchedule"])["Name"]),
        salary_min=pay["MinimumRange"].try_cast("double"),
        salary_max=pay["MaximumRange"].try_cast("double"),
        salary_period=F.coalesce(F.try_element_at(periods, pay["RateIntervalCode"]),
                                 F.lit("yearly")),
        date_posted=parse_date(d["PublicationStartDate"]),
        job_url=clean(d["PositionURI"]), apply_url=clean(first(d["ApplyURI"])),
        raw=F.to_json(F.struct(detail["LowGrade"].alias("grade"),
                               d["DepartmentName"].alias("agency"))))


def _board(rows: DataFrame, array: str, names: DataFrame | None) -> DataFrame:
    """Exploded board items with token and employer name (``names`` has
    token, name); the token stands in for a missing name."""
    items = rows.select(*[c for c in rows.columns if c != array],
                        F.explode(array).alias("x"))
    if names is None:
        items = items.withColumn("company", F.lit(None).cast("string"))
    else:
        items = items.join(names.select("token", F.col("name").alias("company")),
                           "token", "left")
    return items.withColumn("company", _first(F.col("company"), F.col("token")))


def _board_id(*ids: Column) -> Column:
    return F.concat_ws(":", F.col("token"), _first(*ids))


def greenhouse(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    item = F.col("x")
    return shape(
        _board(rows, "jobs", names),
        source_key=F.lit("greenhouse"), source_job_id=_board_id(item["id"]),
        title=_title(item["title"]), company_name=F.col("company"),
        description_html=item["content"], location_raw=clean(item["location"]["name"]),
        country=F.lit("US"),
        date_posted=parse_date(_first(item["updated_at"], item["first_published"])),
        job_url=clean(item["absolute_url"]), apply_url=clean(item["absolute_url"]),
        raw=F.to_json(F.struct(F.col("token").alias("board_token"),
                               item["departments"]["name"].alias("departments"),
                               item["offices"]["name"].alias("offices"))))


def lever(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The payload is a bare array; ``createdAt`` is in epoch milliseconds."""
    item = F.col("x")
    return shape(
        _board(rows.select("token", F.array(F.struct(
            *[n for n in rows.columns if n != "token"])).alias("jobs")), "jobs", names),
        source_key=F.lit("lever"), source_job_id=_board_id(item["id"]),
        title=_title(item["text"]), company_name=F.col("company"),
        description_html=_first(item["description"], item["descriptionPlain"]),
        location_raw=clean(item["categories"]["location"]), country=F.lit("US"),
        employment_type=clean(item["categories"]["commitment"]),
        date_posted=parse_epoch(item["createdAt"]), job_url=clean(item["hostedUrl"]),
        apply_url=clean(_first(item["applyUrl"], item["hostedUrl"])),
        raw=F.to_json(F.struct(F.col("token").alias("board_token"),
                               item["categories"]["team"].alias("team"),
                               item["categories"]["department"].alias("department"),
                               item["workplaceType"].alias("workplace_type"),
                               item["lists"].alias("lists"))))


def ashby(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    item = F.col("x")
    return shape(
        _board(rows, "jobs", names),
        source_key=F.lit("ashby"), source_job_id=_board_id(item["id"]),
        title=_title(item["title"]), company_name=F.col("company"),
        description_html=item["descriptionHtml"],
        description_text=item["descriptionPlain"],
        location_raw=clean(item["location"]), country=F.lit("US"),
        employment_type=clean(item["employmentType"]), is_remote=item["isRemote"],
        date_posted=parse_date(_first(item["publishedAt"], item["updatedAt"])),
        job_url=clean(item["jobUrl"]),
        apply_url=clean(_first(item["applyUrl"], item["jobUrl"])),
        raw=F.to_json(F.struct(
            F.col("token").alias("board_token"), item["department"].alias("department"),
            item["team"].alias("team"),
            item["compensation"]["compensationTierSummary"].alias("compensation_summary"))))


def workable(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The name in the payload wins over the one on file."""
    item = F.col("x")
    city, state = clean(item["city"]), clean(item["state"])
    country = F.coalesce(clean(item["country"]), F.lit("US"))
    return shape(
        _board(rows, "jobs", names),
        source_key=F.lit("workable"),
        source_job_id=_board_id(item["shortcode"], item["id"]),
        title=_title(item["title"]),
        company_name=_first(F.col("name"), F.col("company")),
        description_html=item["description"],
        location_raw=F.nullif(F.concat_ws(", ", city, state), F.lit("")),
        city=city, state=state,
        country=F.when(F.upper(country).isin("US", "USA", "UNITED STATES"), "US")
        .otherwise(country),
        employment_type=clean(item["employment_type"]),
        is_remote=F.coalesce(item["telecommuting"], F.lit(False)),
        date_posted=parse_date(_first(item["published_on"], item["created_at"])),
        job_url=clean(_first(item["url"], item["application_url"])),
        apply_url=clean(_first(item["application_url"], item["url"])),
        raw=F.to_json(F.struct(F.col("token").alias("board_token"),
                               item["department"].alias("department"))))


PARSERS = {"remotive": remotive, "adzuna": adzuna, "usajobs": usajobs,
           "greenhouse": greenhouse, "lever": lever, "ashby": ashby,
           "workable": workable}
BOARDS = ["greenhouse", "lever", "ashby", "workable"]


LINES = r"\.(jsonl|ndjson)$"
_BLANKS = " \t\n\x0b\x0c\r"
_PACKED = r"\.(gz|bz2|zst|deflate|snappy|lz4)$"
_SUFFIX = r"(\.(json|jsonl|ndjson|txt))?$"


@dataclass
class Landed:
    """One provider's landed files: every payload is parsed or quarantined.

    ``payloads`` has a row per payload (file, token, body, and the parsed ``rows``, NULL
    if the text is no payload of this provider)."""

    source: str
    payloads: DataFrame
    names: DataFrame | None = None

    def postings(self) -> DataFrame:
        """Raw postings of the payloads that could be read."""
        # A condition on ``rows``, also the one Spark adds to a plain explode, would move
        # below the parsing and repeat it; one on the position stays above.
        rows = self.payloads.select("token", F.posexplode_outer("rows").alias("at", "p")).where(
            "at is not null").select("token", "p.*")
        if self.source not in BOARDS:
            return PARSERS[self.source](rows.drop("token"))
        return PARSERS[self.source](rows, self.names)

    def quarantine(self) -> DataFrame:
        """(source_key, file, body) of what could not be read, as it was landed."""
        return self.payloads.where("rows is null").select(
            F.lit(self.source).alias("source_key"), "file", "body")

    def counts(self) -> DataFrame:
        """Per file: payloads = parsed + quarantined."""
        return self.payloads.groupBy("file").agg(
            F.count(F.lit(1)).alias("payloads"),
            F.count_if(F.col("rows").isNotNull()).alias("parsed"),
            F.count_if(F.col("rows").isNull()).alias("quarantined"))


def _kinds(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files with a payload a line, and files that are one payload each.

    The name tells (``.jsonl``, ``.ndjson``, also compressed); of other names the first
    line that is not blank does: a whole JSON value means lines."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    named = F.regexp_replace(F.lower("_metadata.file_name"), _PACKED, "").rlike(LINES)
    files = sorted(unquote(f) for f in text.inputFiles())
    lines = [f for f in files if re.search(LINES, re.sub(_PACKED, "", f.lower()))]
    if len(lines) == len(files):
        return files, []
    head = (text.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"),
                        F.struct(F.col("_metadata.file_block_start"),
                                 F.monotonically_increasing_id()).alias("at"), named.alias("named"))
            .where("not named and line <> ''")
            .groupBy("file").agg(F.min_by("line", "at").alias("line"))
            .where(F.try_parse_json("line").isNotNull() & F.col("line").rlike(r"^[\[{]")))
    plain = lambda f: re.sub(r"^file:/+", "/", f)
    # One name a file, as in any listing.
    found = {plain(unquote(r["file"])) for r in head.select("file").collect()}
    lines += [f for f in files if f not in set(lines) and plain(f) in found]
    return lines, [f for f in files if f not in set(lines)]


def land(spark: SparkSession, source: str, path: str, names: DataFrame | None = None,
         envelope: bool = False) -> Landed:
    """One provider's landed files, however they are laid out: a payload a line or a
    payload a file, compressed or not. Files of lines are read in splits.

    With ``envelope`` each payload lies in an object {token, payload}, so that many
    boards share a file."""
    lines, whole = _kinds(spark, path)
    parts = [spark.read.text(lines)] if lines else []
    parts += [spark.read.text(whole, wholetext=True)] if whole else []
    body = F.rtrim(F.ltrim("value", F.lit(_BLANKS + "\ufeff")), F.lit(_BLANKS))
    # Ends at the first sign of a payload; a condition on ``body`` would strip it again.
    filled = F.col("value").rlike("[^\\x20\\x09-\\x0D\ufeff]")
    base = F.regexp_replace("_metadata.file_name", f"(?i){_PACKED}", "")
    token = F.regexp_replace(base, f"(?i){_SUFFIX}", "")
    # A bare array holds payload rows itself; wrapped, both kinds parse in one pass, and
    # whatever follows the value makes the whole unreadable.
    wrapped = F.when(F.startswith("body", F.lit("[")), F.concat(F.lit('{"rows":'), "body", F.lit("}"))).otherwise(
        F.concat(F.lit('{"rows":['), "body", F.lit("]}")))
    kind = f"rows array<struct<{_as_struct(SCHEMAS[source])}>>, _corrupt string"
    parsed = F.from_json(wrapped, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = F.when(F.try_parse_json("body").isNotNull() & F.col("body").rlike(r"^[\[{]"), F.col("p.rows"))
    out = None
    for part in parts:
        made = part.select(F.col("_metadata.file_path").alias("file"), token.alias("token"),
                           body.alias("body"), filled.alias("filled")).where("filled").drop("filled")
        if envelope:
            inner = F.from_json("body", "token string, payload string")
            made = made.withColumn("e", inner).select(
                "file", F.coalesce("e.token", "token").alias("token"),
                F.coalesce("e.payload", "body").alias("body"))
        made = made.withColumn("p", parsed).select(
            "file", "token", "body", rows.alias("rows"))
        out = made if out is None else out.unionByName(made)
    if out is None:
        out = spark.createDataFrame([], "file string, token string, body string").withColumn(
            "p", parsed).select("file", "token", "body", F.col("p.rows").alias("rows"))
    return Landed(source, out, names)


def _as_struct(ddl: str) -> str:
    """The fields of a table schema in the notation of a struct's."""
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def read(spark: SparkSession, source: str, path: str,
         names: DataFrame | None = None) -> DataFrame:
    """Raw postings of one provider's landed files; see ``land`` for what is not
    readable among them."""
    return land(spark, source, path, names).postings()


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All harvests in one table; missing columns are NULL."""
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def fetched_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source_key").agg(F.count(F.lit(1)).alias("fetched"))
