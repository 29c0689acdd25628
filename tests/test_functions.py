"""Scalar behaviour, many cases per Spark job."""

import datetime as dt
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolemill import vocab
from rolemill.functions import clues, dates, extract, fingerprint, labels, pay, place, text, titles
from rolemill.functions.stem import stem, stem_tokens
from rolemill.operators import search
from rolemill.operators.skills import SkillMatcher, alias_table, job_skills, skills_in, with_skills
from rolemill.plans import catalog, corpus
from rolemill.sources import payloads

c = F.col


def run(spark, cases, expression):
    """Results of ``expression(c('x'))`` for a list of inputs."""
    rows = [(i, x) for i, x in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, x string")
    out = df.select("i", expression(c("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in out]


def check(spark, cases: dict, expression):
    assert dict(zip(cases, run(spark, list(cases), expression))) == cases


def test_company(spark):
    check(spark, {
        "Otter Mills, Inc.": "otter mills", "Otter Mills LLC": "otter mills",
        "QRT  Dairy!": "qrt dairy", "The Group": "the group",
        "O'Neil & Sons L.L.C.": "oneil & sons l.l.c.", None: "",
    }, text.normalize_company)


def test_title(spark):
    check(spark, {
        "Lead Welder (Remote) - Urgently Hiring": "lead welder",
        "Lead Welder": "lead welder", "C++ / C# Dev [W2]": "c++ / c# dev",
        "Full-Time Nurse": "nurse", None: "",
    }, text.normalize_title)


def test_html(spark):
    check(spark, {
        "<p>Hello</p><ul><li>One</li><li class='x'>Two</li></ul>": "Hello\n \n- One\n\n- Two",
        "a &amp;lt; b &eacute;&#233; &amp c": "a &lt; b éé & c",
        "x&lt;b&gt;y": "x<b>y", "a\t \x0b b": "a b", "a<br/><br><br><br>b": "a\n\nb", None: "",
    }, text.html_to_text)
    assert run(spark, ["x&lt;b&gt;y"], lambda x: text.html_to_text(x, True)) == ["x y"]


def test_staged_html_equals_expression(spark):
    df = spark.createDataFrame([("<p>a &amp; &eacute;</p>",), (None,)], "h string")
    rows = text.with_text(df, "h", "t").withColumn("u", text.html_to_text(c("h"))).collect()
    assert all(r.t == r.u for r in rows)


def test_summary(spark):
    long = "word " * 100
    got = run(spark, ["a \n b", long, "", None], text.summarize)
    assert got[0] == "a b" and got[2] is None and got[3] is None
    assert got[1] == ("word " * 64)[:319].rsplit(" ", 1)[0] + "..." or got[1].endswith("...")
    assert len(got[1]) <= 323


@pytest.mark.parametrize("raw,expected", [
    ("Boise, ID", ("Boise", "ID", None)), ("Tulsa, Oklahoma", ("Tulsa", "OK", None)),
    ("Peoria, IL 61602", ("Peoria", "IL", "61602")),
    ("Albany, NY, United States", ("Albany", "NY", None)),
    ("Remote", (None, None, None)), ("Berlin, Germany", ("Berlin", None, None)),
    ("Texas", (None, "TX", None)), ("", (None, None, None)),
])
def test_location(spark, raw, expected):
    got = run(spark, [raw], place.parse_location)[0]
    assert (got.city, got.state, got.postal_code) == expected and got.country == "US"


def test_arrangement(spark):
    check(spark, {
        "The post is fully remote": "remote",
        "Hybrid week, two days at the quay": "hybrid", "Hybrid remote role": "hybrid",
        "On-site at the mill": "onsite", "Work from home on Fridays": "remote",
        "There is no remote work": "onsite", "Nothing relevant here": "unknown", "": "unknown",
    }, lambda x: labels.work_arrangement(x))


def test_employment(spark):
    check(spark, {
        "A full-time seat": "full_time", "Part time, three mornings": "part_time",
        "9 month contract": "contract", "An autumn internship": "internship",
        "Temporary harvest help": "temporary", "": None,
    }, lambda x: labels.employment_type(x))


def test_level(spark):
    none = F.lit(None)
    check(spark, {"Senior Engineer": "senior", "Director of Ops": "director",
                  "Junior Analyst": "entry", "VP Sales": "executive", "Clerk": None},
          lambda x: labels.experience_level(x, none.cast("string"), none.cast("int")))
    assert run(spark, ["Clerk"], lambda x: labels.experience_level(
        x, F.lit("lead role"), F.lit(4))) == ["mid"]
    assert run(spark, ["Clerk"], lambda x: labels.experience_level(
        x, F.lit("a lead role"), none.cast("int"))) == ["senior"]


@pytest.mark.parametrize("raw,expected", [
    ("Wages run $41,000 - $52,000 per year", (41000, 52000, "yearly")),
    ("About $95k annually", (95000, None, "yearly")),
    ("$31.25 per hour, nights", (31.25, None, "hourly")), ("$22/hour", (22, None, "hourly")),
    ("$60-80k", (60, 80000, "hourly")), ("$9,000 to $4,000", (4000, 9000, "monthly")),
    ("$1,500", (1500, None, "weekly")), ("$3,200 monthly", (3200, None, "monthly")),
])
def test_salary(spark, raw, expected):
    got = run(spark, [raw], pay.parse_salary)[0]
    assert (got.salary_min, got.salary_max, got.salary_period) == expected


def test_no_salary(spark):
    assert run(spark, ["Competitive compensation", None], pay.parse_salary) == [None, None]


def test_annualise(spark):
    rows = spark.createDataFrame(
        [(50.0, "hourly"), (5000.0, "monthly"), (90000.0, None), (7.0, "fortnightly"),
         (None, "hourly")], "v double, p string").coalesce(1)
    got = [r.y for r in rows.select(pay.annualize(c("v"), c("p")).alias("y")).collect()]
    assert got == [104000.0, 60000.0, 90000.0, 7.0, None]


def test_dates(spark):
    d = dt.datetime(2024, 3, 5)
    check(spark, {
        "2024-03-05": d, "2024-03-05T00:00:00Z": d, "March 5, 2024": d, "03/05/2024": d,
        "1709596800": d, "1709596800000": d, "5 Mar 2024": d, "2024-03-05T02:00:00+02:00": d,
        "soon": None, "": None, "0": None, None: None,
        "2024-03-05T00:00:00.250000": dt.datetime(2024, 3, 5, 0, 0, 0, 250000),
        "Tue, 05 Mar 2024 10:20:30 GMT": dt.datetime(2024, 3, 5, 10, 20, 30),
        "Tue, 05 Mar 2024 10:20:30 +0530": dt.datetime(2024, 3, 5, 4, 50, 30),
        "2024-03-05 10:20:30.5 -05:00": dt.datetime(2024, 3, 5, 15, 20, 30, 500000),
        "March 5th, 2024 at 12:05 am": dt.datetime(2024, 3, 5, 0, 5),
        "5 of march 2024": d, "20240305": d, "20240305T102030": None, "5-Mar-2024": d,
        "13/3/2024": dt.datetime(2024, 3, 13), "3/13/2024 1:05 PM": dt.datetime(2024, 3, 13, 13, 5),
        "2024-02-30": None, "2024-03-05 25:00": None, "13 pm": None, "2024-03-05 and more": None,
    }, dates.parse_date)


def test_age(spark):
    as_of = F.lit(dt.datetime(2024, 1, 10))
    check(spark, {"2024-01-08 12:00:00": 1, "2024-01-20": 0, "2024-01-10": 0, None: None},
          lambda x: dates.days_since(x.cast("timestamp"), as_of))


def test_years(spark):
    got = run(spark, [
        "We need 3-5 years of experience", "At least 7 years experience required",
        "Five years of experience preferred", "12 to 8 years, or 2 yrs", "90 years old firm",
        "no figure", None], extract.experience_years)
    shown = [(g.years_experience_min, g.years_experience_max) if g else None for g in got]
    assert shown[:6] == [(3, 5), (7, None), (5, None), (2, None), (None, None), (None, None)]
    assert shown[6] in (None, (None, None))


def test_education(spark):
    check(spark, {
        "A Bachelor's degree, any field": "bachelors", "An MBA is welcome": "masters",
        "PhD in soil physics": "doctorate", "A GED is enough": "high_school",
        "Master's preferred": "masters", "Graduate degree a plus": "masters",
        "Bachelors preferred, or equivalent experience": "bachelors", "none": None,
    }, labels.education_level)


def test_flags(spark):
    check(spark, {
        "Visa sponsorship is available to welders": True,
        "We are unable to sponsor visas. Sponsorship available: no.": False,
        "Great team, great pay": None}, extract.sponsorship)
    check(spark, {"No relocation assistance": False, "Relocation package": True, "x": None},
          extract.relocation)
    check(spark, {"Urgently hiring! Start ASAP": True, "calm": None}, extract.urgently_hiring)
    check(spark, {"Our client is seeking": True, "We seek": False},
          extract.recruitment_agency)


def test_benefits(spark):
    got = run(spark, ["We offer health insurance, 401(k) matching, PTO and stock options."],
              extract.benefits)[0]
    assert got == ["health_insurance", "retirement_401k", "paid_time_off", "equity"]


def test_contacts(spark):
    got = run(spark, ["Write to desk@mill.org or b@x.org, desk@mill.org, "
                      "ring 555-867-2040"], extract.contacts)[0]
    assert got.emails == ["b@x.org", "desk@mill.org"] and got.phones == ["555-867-2040"]


def test_boards(spark):
    urls = {
        "https://boards.greenhouse.io/ottermills/jobs/77": ("greenhouse", "ottermills"),
        "https://jobs.lever.co/quillonmaps/q-9": ("lever", "quillonmaps"),
        "https://jobs.ashbyhq.com/mosslib/m1": ("ashby", "mosslib"),
        "https://apply.workable.com/ternferry/j/Z9/": ("workable", "ternferry"),
        "https://ternferry.workable.com/": ("workable", "ternferry"),
        "https://ternferry.recruitee.com/o/1": ("recruitee", "ternferry"),
        "https://boards.greenhouse.io/embed/job_board?for=larkspur":
            ("greenhouse", "larkspur"),
        "https://job-boards.greenhouse.io/": None, "https://www.example.com/careers": None,
        "not-a-url": None, "": None, None: None,
    }
    got = run(spark, list(urls), extract.detect_board)
    assert [tuple(g) if g else None for g in got] == list(urls.values())


MATCHER = SkillMatcher.from_rows([
    ("Python", "technical", ["python3"]), ("SQL", "technical", []), ("C#", "technical", []),
    ("C++", "technical", []), ("R", "technical", []), ("SQL Server", "technical", []),
    ("Planning", "finance", ["fp&a"]), ("Duplicate", "x", ["sql"]),
])


def test_skill_matches(spark):
    df = spark.createDataFrame([
        (1, "Requirements: Python, python3 and SQL Server. Preferred: C#, C++."),
        (2, "mysql is not it; R&D is R. " + "x" * 800 + " SQL"), (3, None),
        (4, "SQL here. Nice to have: SQL. Required: SQL")],
        "job_id long, description_text string")
    rows = {(r.job_id, r.skill): (r.requirement, r.mention_count)
            for r in job_skills(with_skills(df, MATCHER)).collect()}
    assert rows == {
        (1, "Python"): ("required", 2), (1, "SQL Server"): ("required", 1),
        (1, "C#"): ("preferred", 1), (1, "C++"): ("preferred", 1),
        (2, "R"): ("mentioned", 2), (2, "SQL"): ("mentioned", 1),
        (4, "SQL"): ("preferred", 3)}


def test_alias_table_first_skill_wins(spark):
    rows = spark.createDataFrame(
        [(1, "Alpha", "t", ["a-one", "fp&a"]), (2, "Beta", "t", ["A-One", None])],
        "skill_id long, name string, category string, aliases array<string>")
    got = {r.alias: r.skill for r in alias_table(rows).collect()}
    assert got == {"alpha": "Alpha", "a-one": "Alpha", "beta": "Beta"}
    assert SkillMatcher.from_taxonomy(rows).aliases == got


def test_canonical_hash(spark):
    rows = spark.createDataFrame([
        ("Senior Developer", "Acme Inc.", "Dallas", "TX"),
        ("senior  developer", "Acme, LLC", "dallas", "tx"),
        ("Junior Developer", "Acme", "Dallas", "TX")],
        "t string, co string, ci string, st string").coalesce(1)
    a, b, d = [r.h for r in rows.select(fingerprint.canonical_hash(
        c("t"), c("co"), c("ci"), c("st")).alias("h")).collect()]
    assert a == b != d


def test_simhash(spark):
    import hashlib
    import re

    near = "We are seeking a medical biller with ICD-10 and CPT experience " * 3
    texts = [near, near.replace("experience", "expertise"),
             "Kubernetes platform engineer working on service meshes " * 5, "too few words", ""]

    def plain(value):
        words = re.findall(r"[a-z0-9+#]+", value.lower())
        if len(words) < 4:
            return None
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        return sum(1 << i for i in range(64)
                   if 2 * sum(h >> i & 1 for h in hashes) > len(words))

    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    by_udf = {r.i: r.s for r in df.select(
        "i", fingerprint.simhash(c("x")).alias("s")).collect()}
    by_rows = {r.i: r.simhash for r in fingerprint.simhash_by_rows(df, "i", "x").collect()}
    expected = [plain(t) for t in texts]
    signed = [e - (1 << 64) if e is not None and e >= 1 << 63 else e for e in expected]
    assert [by_udf[i] for i in range(5)] == signed
    assert [by_rows.get(i) for i in range(5)] == signed
    sims = spark.createDataFrame([(signed[0], signed[1]), (signed[0], signed[2]),
                                  (signed[0], None)], "a long, b long").coalesce(1).select(
        fingerprint.simhash_similarity(c("a"), c("b")).alias("s"),
        fingerprint.hamming(c("a"), c("b")).alias("d")).collect()
    assert sims[0].s > 0.85 > sims[1].s and sims[2].s == 0.0 and sims[2].d == 64


def test_title_similarity(spark):
    rows = spark.createDataFrame([
        ("backend engineer senior", "senior backend engineer"),
        ("nurse practitioner", "software engineer"), ("", "x"), ("a b", "a b"),
        ("medical biller", "medical billers")], "a string, b string").coalesce(1)
    got = [r.s for r in rows.select(titles.title_similarity(c("a"), c("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] < 0.5 and got[2] == 0.0 and got[3] == 1.0 and got[4] > 0.92


def test_stems():
    words = ("caresses ponies cats agreed plastered motoring sing conflated sized hopping "
             "falling hissing failing filing happy sky relational triplicate formative "
             "electrical hopefulness revival adoption controlling probate rate roll")
    stems = ("caress poni cat agre plaster motor sing conflat size hop fall hiss fail file "
             "happi sky relat triplic form electr hope reviv adopt control probat rate roll")
    assert [stem(w) for w in words.split()] == stems.split()


def _written_out(pattern):
    """Texts of every alternative of a pattern, optional parts left out and taken once."""
    parser = re._parser
    names = {"category_digit": "7", "category_space": " ", "category_word": "w"}

    def of(tree):
        texts = [""]
        for op, value in tree:
            kind = str(op).lower()
            if kind == "literal":
                own = [chr(value)]
            elif kind == "in":
                own = [chr(v) if str(o).lower() == "literal" else chr(v[0]) if str(o).lower() == "range"
                       else names[str(v).lower()] for o, v in value]
            elif kind == "subpattern":
                own = of(value[3])
            elif kind == "branch":
                own = [t for arm in value[1] for t in of(arm)]
            elif kind == "max_repeat":
                own = [t * n for n in {value[0], max(1, value[0])} for t in of(value[2])]
            else:
                own = [""]
            texts = [a + b for a in texts for b in dict.fromkeys(own)]
        return texts

    return of(parser.parse(pattern))


def test_every_match_holds_a_clue():
    for pattern, words in clues.CLUES.items():
        for text in _written_out(pattern):
            assert any(w in text.lower() for w in words), (pattern, text)


def test_headings_as_words_are_the_pattern():
    for pattern, words in ((vocab.REQUIRED_HEADING, vocab.REQUIRED_WORDS),
                           (vocab.PREFERRED_HEADING, vocab.PREFERRED_WORDS)):
        assert sorted(_written_out(pattern)) == sorted(words)


def test_skills_with_marks_and_far_headings(spark):
    texts = ["must have \x01python\x01, nice to have rust" + " pad" * 200 + " docker. required: perl sql.",
             "bonus" + " x" * 400 + " essential sql", "no skill here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description_text string")
    out = {r.id: [tuple(s) for s in r.skills] for r in with_skills(df, corpus.MATCHER).collect()}
    assert out[0] == [("Python", "required", 1), ("Rust", "preferred", 1), ("Docker", "mentioned", 1),
                      ("Perl", "required", 1), ("SQL", "required", 1)]
    assert out[1] == [("SQL", "required", 1)] and out[2] == out[3] == []


def test_unasked_columns_are_not_computed(spark):
    plan = corpus.enriched(spark, "/root/testdata/sf0.001").select(
        "job_id", "city")._jdf.queryExecution().executedPlan().toString().lower()
    assert "python" not in plan and "<[^>]+>" not in plan
    assert corpus.jobs(spark, "/root/testdata/sf0.001", "job_id", "city").columns == ["job_id", "city"]


def test_queries_store_the_columns_they_read(spark):
    folder = "/root/testdata/sf0.001"
    before = set(corpus._STORED)
    for name in ("flt_01_hygiene", "flt_15_required_skills", "srt_01b_location_asc", "agg_02_facets",
                 "snk_04_export_log", "scr_01_facts"):
        catalog.QUERIES[name](spark, folder)
    made = [set(columns) for _, _, columns in set(corpus._STORED) - before]
    assert all(made), "the whole corpus was stored"
    assert not any({"simhash", "benefits", "description_text"} & columns for columns in made)
    open_ = {"job_id", "is_primary", "is_active"}
    assert search.job_columns({}) == sorted(open_)
    # Every key that leads to a condition is known to read something.
    keys = {"salary_min": 1, "city": "a", "required_skills": ["a"], "min_score": 1, "date_to": "2024-01-01"}
    for key, value in keys.items():
        assert set(search.job_columns({key: value})) > open_


def test_landed_payloads_are_parsed_once(spark, folder):
    path = f"{folder}/landed"
    spark.createDataFrame([('{"token": "a", "payload": {"jobs": [{"id": "1"}]}}',), ('{"jobs": [',)],
                          "value string").coalesce(1).write.text(path)
    found = payloads.land(spark, "ashby", path, envelope=True).postings()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("json" in line.lower() for line in filters)
    assert [r.source_job_id for r in found.collect()] == ["a:1"]


def test_blank_lines_are_told_without_stripping_payloads(spark, folder):
    path = f"{folder}/blanks"
    spark.createDataFrame([('{"jobs": []}',), ('\ufeff \t{"jobs": [{"id": "1"}]} \t ',), (" \t ",), ("\ufeff",), (" x ",)],
                          "value string").coalesce(1).write.text(path)
    found = payloads.land(spark, "remotive", path)
    assert sorted(r.body for r in found.payloads.collect()) == sorted(
        ["x", '{"jobs": []}', '{"jobs": [{"id": "1"}]}'])
    plan = found.payloads._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("trim" in line or "regexp_replace" in line for line in filters)


def test_html_is_read_in_one_step(spark):
    odd = ["a&amp;lt;b &amp x &copy;&hearts;", "<BR/>x< br />y<\x0bbr\x0b>z<LI class='a\nb'>q</Li\x0b>", "",
           "a \t b\x0b\x0bc  d\n\n\n\n e 　\x85", "< </p>br> <p", "&1lt; &&lt;&#39;&middot;&#x41;&notit;",
           "a\r\n\r\n\r\nb \n \n \n c", "<" * 50 + ">", None] * 100
    df = spark.createDataFrame(list(enumerate(odd)), "i int, h string").coalesce(1)
    read = text.with_text(df, "h", "t")
    assert read.withColumn("u", text.html_to_text(c("h"))).where("not t <=> u").count() == 0
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan.lower()


def test_mentions_are_walked_in_one_step(spark):
    texts = {"required " + "z " * 345 + "sql": "required", "required " + "z " * 346 + "sql": "mentioned",
             "a plus required sql": "required", "required plus sql": "preferred", "sql required": "mentioned",
             "é" * 900 + "required sql": "required"}
    df = spark.createDataFrame([(t,) for t in texts], "description_text string")
    found = with_skills(df, corpus.MATCHER)
    assert {r.description_text: [s.requirement for s in r.skills] for r in found.collect()} == {
        t: [cls] for t, cls in texts.items()}
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


def test_dates_clean_their_text_once(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02T03:04:05z",), ("2024-13-02T03:04:05",),
                                ("1700000000",), ("0000000000",)], "x string")
    found = df.select(F.unix_micros(dates.parse_date(c("x"))).alias("at"))
    assert [r.at for r in found.collect()] == [1704164645000000, 1704164645000000, None, 1700000000000000, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count(r"\s+,") == 1


def test_a_worker_compares_a_pair_of_titles_once(spark):
    pairs = [("welder", "welders"), ("pilot", "tailor"), (None, "x")] * 2000
    a, b = (pd.Series(side) for side in zip(*pairs))
    calls = []
    class Counted(titles.SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()
    plain, titles.SequenceMatcher = titles.SequenceMatcher, Counted
    try:
        out = pd.concat(titles.sequence_ratio.func(iter([(a, b), (a, b)])))
    finally:
        titles.SequenceMatcher = plain
    assert len(calls) == 2 and len(out) == 2 * len(pairs)
    assert out[:3].tolist()[:2] == [plain(None, *p).ratio() for p in pairs[:2]] and out.iloc[2] != out.iloc[2]


def test_only_distinct_words_leave_arrow():
    words = [["running", None, "", "ponies"], None, []] * 3000
    tokens = pa.array(words, pa.list_(pa.string()))
    out = list(stem_tokens.func(iter([tokens, tokens.slice(1, 4)])))
    assert out[0].to_pylist() == [["run", None, "", "poni"], None, []] * 3000
    assert out[1].to_pylist() == [None, [], ["run", None, "", "poni"], None]


def test_neighbours_share_one_hashing(spark):
    found = catalog.QUERIES["dup_03_hamming"](spark, "/root/testdata/sf0.001")
    assert "python" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_places_are_read_without_lambdas(spark):
    rows = [("Peoria, IL 61602", None, "", "99999"), (", - ,Reno - , U.S.A. , -", "", None, None), ("Texas", None, None, None),
            (" , - ", None, None, None), ("Tulsa, OK", "Reno", "NV", None), ("   ", None, None, None), (None, "", "", ""),
            ("Boise,,Idaho, USA 83702-1234", "Kuna", None, ""), ("Anywhere", None, None, None)]
    df = spark.createDataFrame(rows, "location_raw string, city string, state string, postal_code string").withColumn(
        "country", F.lit(None).cast("string"))
    found = place.with_place(df)
    assert [tuple(r) for r in found.select("city", "state", "country", "postal_code").collect()] == [
        ("Peoria", "IL", "US", "99999"), ("Reno", None, "US", None), (None, "TX", "US", None),
        (None, None, "US", None), ("Reno", "NV", "US", None), (None, None, "US", None), ("", "", "US", ""),
        ("Kuna", "ID", "US", "83702"), (None, None, "US", None)]
    read = df.select(place.parse_location(c("location_raw")).alias("p")).collect()
    assert [r.p.city for r in read] == ["Peoria", "Reno", None, None, "Tulsa", None, None, "Boise", None]
    plan = corpus.enriched(spark, "/root/testdata/sf0.001").select(
        "job_id", "city", "title_normalized", "canonical_hash")._jdf.queryExecution().optimizedPlan().toString()
    # The places' text and the title are each read once for all fields.
    assert plan.count("united states of america") == 1 and plan.count("work\\s+from\\s+home") == 1


def test_title_classes_written_out_are_the_patterns(spark):
    odd = ["Pilot (Remote) - Urgently  Hiring", "C++/F# dev, sr.", "a\t\x0b b\n c", "[x {y", "W2 éremote full-time", "İ—K",
           "- / Tutor II -", "", "part  time (x] y}", "immediate\tstart 😀 apply now", "^a&b\\c]", "ª²"]
    s = F.regexp_replace(F.regexp_replace(F.lower(c("x")), vocab.TITLE_BRACKETED, " "), "(?i)" + vocab.TITLE_NOISE, " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(s, vocab.TITLE_OTHER, " "), r"\s+", " "), F.lit(" -/"))
    df = spark.createDataFrame([(t,) for t in odd], "x string")
    assert df.where(~plain.eqNullSafe(text.normalize_title(c("x")))).count() == 0
    assert run(spark, odd[:3], text.normalize_title) == ["pilot", "c++/f# dev sr", "a b c"]
    # A generated method of more than 8,000 bytes is never compiled by HotSpot.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = corpus.enriched(spark, "/root/testdata/sf0.001").select(
            "job_id", "title_normalized", "city")._jdf.queryExecution().debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_file_cut_in_splits_is_spread(spark, folder):
    spark.range(100).coalesce(1).write.parquet(f"{folder}/t.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        one = spark.read.parquet(f"{folder}/t.parquet")
        assert one.rdd.getNumPartitions() >= 4
        rows = corpus.spread(one).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(rows) == 100 and sum(n > 0 for n in rows) == 4


def test_boards_are_discovered_without_storing(spark):
    folder = "/root/testdata/sf0.001"
    before = set(corpus._STORED)
    found = catalog.QUERIES["ups_04_board_discovery"](spark, folder)
    assert set(corpus._STORED) == before
    assert found.where("token is null or platform is null").count() == 0 and found.count() > 0


def _tables(spark, folder):
    """Six orders of two customers, one of them there twice."""
    spark.createDataFrame([(1, "Customer#1", 2, 10.5, "FURNITURE"), (2, "Customer#2", 7, -3.0, None),
                           (2, "Customer#2", 7, 4.0, "MACHINERY")],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(k, 1 + k % 2, "F", 70_000.0 + 900 * k, dt.datetime(2001, 7, 20 + k), "1-URGENT")
                           for k in range(6)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return folder


SCORES = ["scr_02_leaf_conditions", "scr_03_compound_conditions", "scr_04_job_score", "scr_05_rescore_subset"]


def test_scores_compute_what_they_test_and_store_nothing(spark, folder):
    before = set(corpus._STORED)
    plans = {name: catalog.QUERIES[name](spark, _tables(spark, folder) if i == 0 else folder)
             for i, name in enumerate(SCORES)}
    assert set(corpus._STORED) == before
    rows = {name: len(df.collect()) for name, df in plans.items()}
    # Postings of the doubled customer come twice, and meet its employer twice.
    assert rows == dict(zip(SCORES, [15, 15, 15, 8]))
    plan = plans["scr_05_rescore_subset"]._jdf.queryExecution().executedPlan().toString()
    assert "summaries(" not in plan
    assert vocab.HYBRID not in plan


def test_export_computes_what_it_shows_and_stores_nothing(spark, folder):
    before = set(corpus._STORED)
    rows = catalog.QUERIES["snk_01_export_rows"](spark, _tables(spark, folder))
    assert set(corpus._STORED) == before
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "summaries(" in plan
    assert "_simhash(" not in plan
    assert vocab.SPONSOR_YES not in plan
    # Order 3 is a duplicate; its customer is there twice.
    assert sorted(r.id for r in rows.collect()) == [0, 1, 1, 2, 4]


def test_skills_and_simhash_read_a_text_in_one_step(spark):
    """And skills as the former search found them, borders and marks included."""
    texts = ["sqlite sql_ sql+ (sql) sql,SQL énsql sqlé sql²", "ansi sql\x01c++ f#, vue.jsx vue js pythons", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = df.select("id", skills_in(F.col("t"), corpus.MATCHER).alias("skills"),
                      fingerprint.simhash(F.col("t")).alias("simhash"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    out = {r.id: {s.name: s.mention_count for s in r.skills} for r in found.collect()}
    marked = df.select("id", F.size(F.regexp_extract_all(F.lower("t"), F.lit(corpus.MATCHER.pattern), F.lit(1))).alias("n"))
    assert {r.id: r.n for r in marked.collect() if r.n is not None} == {i: sum(out[i].values()) for i in (0, 1, 2)}
    assert out == {0: {"SQL": 3}, 1: {"SQL": 1, "C++": 1, "F#": 1, "Vue.js": 1}, 2: {}, 3: {}}


def test_simhash_words_are_the_pattern(spark):
    words = ["a+b c#", "x\x1cy z0", "İi ²two", "ab_cd", "😀e-f/g"]
    assert [t.translate(fingerprint._GAPS).split() for t in words] == [re.findall(vocab.WORD, t) for t in words]
