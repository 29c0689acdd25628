"""Operators on small tables, against brute force where the result is a search."""

import datetime as dt
import itertools
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rolemill.functions import boolean
from rolemill.operators import (aggregates, companies, customfields, duplicates, export,
                                ranking, research, scoring, search, skills, textindex,
                                upserts)
from rolemill.operators.enrich import enrich
from rolemill.plans import corpus
from rolemill.schema import RAW_POSTING
from rolemill.sources import payloads, reference
from rolemill.streaming import ingest

NOW = dt.datetime(2024, 6, 1)
BODY = ("Six hundred hands pick our orchards; you keep their ledger straight. Required: SQL. {} "
        "with Tableau helps. Four years of experience and a Bachelor's degree. $66,000 - $81,000 "
        "per year. Dental cover, 401(k) matching and PTO. Visa sponsorship is available. The post "
        "is fully remote. Urgently hiring!")


def posting(source_job_id, title, company, place, body, source="remotive", url=None):
    values = dict.fromkeys(RAW_POSTING.fieldNames())
    values.update(
        source_key=source, source_job_id=source_job_id, title=title, company_name=company,
        location_raw=place, description_html=f"<p>{body}</p>", country="US",
        description_is_truncated=False, salary_is_estimated=False,
        date_posted=NOW - dt.timedelta(days=2), job_url=url,
        apply_url=url if url and "example" not in url else None)
    return tuple(values.values())


POSTINGS = [
    posting("p-1", "Senior Payroll Accountant", "Larkspur Orchards Inc.", "Boise, ID",
            BODY.format("Practice"), url="https://boards.greenhouse.io/larkspur/jobs/1"),
    posting("p-2", "Pallet Planner", "Tern Ferry Lines", "Tulsa, Oklahoma",
            "Decide which pallets ride on which ferry. Perl and Ansible glue the yard together. "
            "3-6 years of experience. Hybrid week, two days at the quay. $58,000 to $71,000 "
            "annually. No visa sponsorship.", url="https://example.com/jobs/2"),
    posting("p-3", "Platform Engineer", "Quillon Maps", "Remote",
            "Run the Docker and Kafka fleet that draws our maps. At least 9 years experience. "
            "A Master's degree is welcome. $152,000 per year. Stock options and equity. "
            "Full-time. Relocation assistance offered.",
            url="https://jobs.lever.co/quillonmaps/p-3"),
    posting("p-4", "Junior Archive Clerk", "Moss Library Services LLC", "Peoria, IL 61602",
            "Shelve and label river charts. A GED is enough. Part time, three mornings. $17.50 "
            "per hour. On-site at the branch. No relocation assistance.",
            url="https://example.com/jobs/4"),
    posting("larkspur:p-1", "Senior Payroll Accountant", "Larkspur Orchards LLC", "Boise, ID",
            BODY.format("Fluency"), source="greenhouse",
            url="https://boards.greenhouse.io/larkspur/jobs/1-again"),
]


@pytest.fixture(scope="module")
def small(spark):
    """The five postings ingested as one batch, with companies and scores."""
    raw = spark.createDataFrame(POSTINGS, RAW_POSTING).coalesce(1)
    batch, _ = ingest.prepare_batch(raw, corpus.MATCHER, NOW, 0)
    jobs = ingest.fold_batch(None, batch.checkpoint(), NOW).checkpoint()
    seen = companies.seen_companies(jobs).withColumns({
        "industry": F.lit("Health"), "size_estimate": F.lit(10).cast("long")})
    firms = companies.refresh_metrics(seen, jobs, NOW)
    scores = scoring.rescore(jobs, firms, scoring.DEFAULT_RULES, NOW)
    jobs = jobs.drop("opportunity_score").join(scores, "job_id").checkpoint()
    index = textindex.build(jobs.where("is_primary"))
    return search.Corpus(jobs, firms, index=index)


def found(corpus_, **q):
    return search.search(corpus_, q, NOW).count()


def test_near_duplicate_is_linked_not_dropped(small):
    assert found(small) == 4 and found(small, include_duplicates=True) == 5
    row = search.search(small, {"job_title": "Senior Payroll Accountant"}, NOW).collect()
    assert [(r.source_key, r.duplicate_count) for r in row] == [("greenhouse", 1)]
    outcomes = {r.source_key: r for r in upserts.outcome_counts(small.jobs).collect()}
    assert (outcomes["total"].new, outcomes["total"].duplicate) == (4, 1)


@pytest.mark.parametrize("q,n", [
    ({"salary_min": 100000}, 1), ({"work_arrangements": ["remote"]}, 2),
    ({"work_arrangements": ["hybrid"]}, 1), ({"work_arrangements": ["onsite"]}, 1),
    ({"experience_levels": ["entry"]}, 1), ({"required_skills": ["apache kafka", "Docker"]}, 1),
    ({"required_skills": ["Docker", "Tableau"]}, 0), ({"exclude_skills": ["Docker"]}, 3),
    ({"years_experience_min": 7}, 1), ({"visa_sponsorship": True}, 1),
    ({"visa_sponsorship": False}, 3), ({"relocation": True}, 1), ({"city": "boise"}, 1),
    ({"state": "il"}, 1), ({"postal_code": "61602"}, 1), ({"date_posted": "1"}, 0),
    ({"date_posted": "3"}, 4), ({"company": "larkspur"}, 1), ({"sources": ["greenhouse"]}, 1),
    ({"boolean": '("payroll accountant" OR ferry) AND remote'}, 1),
    ({"boolean": "engineer NOT docker"}, 0), ({"keywords": "engineering"}, 1),
    ({"company_ats": ["lever"]}, 1), ({"description_not_contains": "docker"}, 3),
])
def test_searches(small, q, n):
    assert found(small, **q) == n


def test_fields_of_the_five(small):
    rows = {r.source_job_id: r for r in small.jobs.collect()}
    assert rows["p-4"].salary_annualized_min == 36400.0
    assert rows["p-4"].employment_type == "part_time"
    assert rows["p-3"].years_experience_min == 9 and rows["p-3"].education_level == "masters"
    assert (rows["p-2"].years_experience_min, rows["p-2"].years_experience_max) == (3, 6)
    assert rows["p-2"].visa_sponsorship_mentioned is False
    assert rows["larkspur:p-1"].urgently_hiring and "equity" in rows["p-3"].benefits
    assert not rows["p-1"].is_primary
    assert rows["p-1"].duplicate_of == rows["larkspur:p-1"].job_id


def test_overview_and_analytics(small):
    got = aggregates.overview(small.jobs).head()
    assert (got.jobs_active, got.duplicates_linked, got.companies) == (4, 1, 4)
    scope = search.search(small, {}, NOW)
    facets = {(r.dim, r.value): r.n for r in aggregates.facets(scope).collect()}
    assert facets[("work_arrangement", "remote")] == 2
    ranks = aggregates.skills_ranking(scope, corpus.MATCHER).collect()
    assert all(r.share == 25.0 * r.jobs for r in ranks)
    assert aggregates.remote_share(scope).head().remote_share == 0.5
    assert [r.jobs_discovered for r in small.companies.collect()] == [1, 1, 1, 1]


def test_sorting_and_pages(small):
    scope = search.search(small, {}, NOW)
    ids = [r.source_job_id for r in ranking.order_jobs(scope, "salary", "desc").collect()]
    assert ids[0] == "p-3" and ids[-1] == "p-4"
    first = ranking.page(ranking.order_jobs(scope, "salary", "desc"), 2, 3).collect()
    assert [r.source_job_id for r in first] == ["p-4"]
    assert ranking.page_count(scope, 3).head().pages == 2
    with pytest.raises(ValueError):
        ranking.order_jobs(scope, "colour")


def test_export_files(spark, small, folder):
    rows = export.export_rows(search.search(small, {}, NOW), include_description=True)
    assert rows.columns == export.COLUMNS + ["description"]
    for fmt in ("csv", "json"):
        path, n = export.write_export(rows, folder, fmt, f"{folder}/log", NOW)
        reader = spark.read.option("header", True).option("multiLine", True)
        back = reader.csv(path) if fmt == "csv" else spark.read.json(path)
        assert n == 4 and (fmt == "csv" or back.count() == 4)
    assert spark.read.parquet(f"{folder}/log").count() == 2
    assert export.export_rows(search.search(small, {}, NOW), max_rows=2).count() == 2
    with pytest.raises(ValueError):
        export.write_export(rows.where("false"), folder, "csv", f"{folder}/log", NOW)


def test_stored_jobs_are_searched_without_text_work(spark):
    jobs = corpus.jobs(spark, "/root/testdata/sf0.001")
    for q in ({"employment_types": ["full_time"]}, {"salary_min": 50000, "state": "OK"},
              {"required_skills": ["Docker"]}, {"years_experience_min": 3}):
        hits = search.search(search.Corpus(jobs), q, corpus.AS_OF)
        plan = hits._jdf.queryExecution().executedPlan().toString().lower()
        assert "regexp" not in plan and "rlike" not in plan and "python" not in plan
        assert "pushedfilters: [isnotnull" in plan and hits.count() > 0


# --- linking against brute force -------------------------------------------------------

def brute_links(rows):
    """The written rule, posting by posting."""
    def similarity(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        x, y = set(a.split()), set(b.split())
        return max(len(x & y) / len(x | y), SequenceMatcher(None, a, b).ratio())

    out, seen = {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        same_url = [s for s in seen if r["job_url"] and s["job_url"] == r["job_url"]]
        candidates = [s for s in seen if s["canonical_hash"] == r["canonical_hash"]]
        if not candidates:
            candidates = [s for s in seen if r["company_key"]
                          and (s["company_key"], s["city"], s["state"])
                          == (r["company_key"], r["city"], r["state"])]
        best = None
        for s in candidates:
            t = similarity(r["title_normalized"], s["title_normalized"])
            if t < 0.92:
                continue
            score, reason = t, "canonical+title"
            if r["simhash"] is not None and s["simhash"] is not None:
                d = 1 - bin((r["simhash"] ^ s["simhash"]) & (1 << 64) - 1).count("1") / 64
                if d >= 0.85:
                    score, reason = (t + d) / 2, "title+description"
                elif d < 0.45:
                    continue
            if best is None or score > best[0]:
                best = (score, s["job_id"], reason)
        if same_url:
            out[r["job_id"]] = (same_url[0]["job_id"], "identical_url", 1.0)
        elif best:
            out[r["job_id"]] = (best[1], best[2], best[0])
        seen.append(r)
    return out


def random_postings(n, seed):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(3)]
    names = ["senior medical billing specialist", "senior medical billing specialists",
             "medical billing specialist senior", "senior medical biling specialist",
             "junior nurse", "junior nurses", "nurse junior", "data entry clerk ii",
             "data entry clerk iii", "director of regional operations and planning west",
             "director of regional operations and planning east", "",
             "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n o",
             "o a b c d e f g h i j k l m n"]
    rows = []
    for i in range(n):
        h = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 1, 3, 8, 12, 30, 45])):
            h ^= 1 << rng.randrange(64)
        h = None if rng.random() < 0.05 else h - (1 << 64) if h >> 63 else h
        title, firm = rng.choice(names), rng.choice(["acme", "acme", "acme", "beta", ""])
        city = rng.choice(["dallas", None])
        rows.append(dict(
            job_id=1000 + i, seq=i, source_key=rng.choice(corpus.SOURCES),
            job_url=f"u{rng.randrange(n * 4)}" if rng.random() < 0.9 else None,
            title_normalized=title, company_key=firm, city=city, state="TX",
            canonical_hash=f"{title}|{firm}|{city}", simhash=h))
    return rows


SCHEMA = ("job_id long, seq long, source_key string, job_url string, title_normalized string, "
          "company_key string, city string, state string, canonical_hash string, simhash long")


@pytest.mark.parametrize("seed,sizes", [
    (1, {}), (2, dict(probe=1, block=2, small=1)), (3, dict(probe=3, block=4, small=4))])
def test_links_equal_brute_force(spark, seed, sizes):
    rows = random_postings(220, seed)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = {r.job_id: (r.linked_to, r.reason, r.score)
           for r in duplicates.find_links(df, **sizes).collect()}
    expected = brute_links(rows)
    assert set(got) == set(expected)
    for job, (to, reason, score) in expected.items():
        assert got[job][0] == to and abs(got[job][2] - score) < 6e-4, (job, got[job])
        assert got[job][1] == reason


def test_large_blocks_lose_no_title_pair(spark):
    rng = random.Random(5)
    letters = "abcde fg"
    names = set()
    while len(names) < 300:
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 32))).split()
        name = list(" ".join(base) or "x")
        names.add("".join(name))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice(letters)
        names.add(" ".join("".join(name).split()) or "y")
    rows = [("p", f"h{i}", i, i, i, n) for i, n in enumerate(sorted(names))]
    df = spark.createDataFrame(rows, "place string, canonical_hash string, seq long, "
                               "job_id long, simhash long, title string")
    got = {(r.i_job_id, r.j_job_id) for r in
           duplicates.similar_titles(df, small=2).collect()}
    expected = set()
    for (_, _, i, _, _, a), (_, _, j, _, _, b) in itertools.permutations(rows, 2):
        x, y = set(a.split()), set(b.split())
        score = max(len(x & y) / len(x | y), SequenceMatcher(None, a, b).ratio())
        if j < i and score >= 0.92:
            expected.add((i, j))
    assert got == expected and len(expected) > 20


def test_primaries_form_one_cluster(spark):
    jobs = spark.createDataFrame(
        [(i, i, s) for i, s in enumerate(["adzuna", "remotive", "lever", "lever", "adzuna"])],
        "job_id long, seq long, source_key string")
    links = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "job_id long, linked_to long")
    got = {r.job_id: (r.is_primary, r.duplicate_of, r.duplicate_count)
           for r in duplicates.assign_primaries(jobs, links).collect()}
    assert got == {0: (False, 2, 0), 1: (False, 2, 0), 2: (True, None, 3), 3: (False, 2, 0),
                   4: (True, None, 0)}


# --- rules against a plain evaluator ---------------------------------------------------

def test_conditions(spark):
    df = spark.createDataFrame([
        (90000, True, "Senior Engineer", ["Python", "SQL"]), (None, None, None, []),
        (100, False, "", None)],
        "salary int, remote boolean, title string, skills array<string>").coalesce(1)
    cases = [
        ({"field": "salary", "op": "gte", "value": 80000}, [1, 0, 0]),
        ({"field": "salary", "op": "lt", "value": 80000}, [0, 0, 1]),
        ({"field": "salary", "op": "ne", "value": 100}, [1, 1, 0]),
        ({"field": "salary", "op": "gte", "value": "x"}, [0, 0, 0]),
        ({"field": "remote", "op": "is_true"}, [1, 0, 0]),
        ({"field": "remote", "op": "is_false"}, [0, 0, 1]),
        ({"field": "title", "op": "contains", "value": "senior"}, [1, 0, 0]),
        ({"field": "title", "op": "not_contains", "value": "senior"}, [0, 1, 1]),
        ({"field": "skills", "op": "contains", "value": "python"}, [1, 0, 0]),
        ({"field": "salary", "op": "contains", "value": "9000"}, [1, 0, 0]),
        ({"field": "title", "op": "in", "value": ["", None]}, [0, 1, 1]),
        ({"field": "title", "op": "not_in", "value": ["x"]}, [1, 1, 1]),
        ({"field": "title", "op": "eq", "value": None}, [0, 1, 0]),
        ({"field": "gone", "op": "gte", "value": 1}, [0, 0, 0]),
        ({"garbage": True}, [0, 0, 0]), ({"field": "salary", "op": "nonsense"}, [0, 0, 0]),
        ("text", [0, 0, 0]), ({"all": []}, [1, 1, 1]), ({"any": []}, [0, 0, 0]),
        ({"not": {"field": "salary", "op": "gte", "value": 1}}, [0, 1, 0]),
    ]
    columns = [scoring.compile_condition(x, df.schema).alias(f"c{i}")
               for i, (x, _) in enumerate(cases)]
    rows = df.select(*columns).collect()
    for i, (case, expected) in enumerate(cases):
        assert [int(r[i]) for r in rows] == expected, case


def test_company_scores_at_a_half_go_up(spark):
    # 4 + 0 + 10 + 10.45 + 1.4 is 25.85, which as a sum of doubles is a little less.
    jobs = spark.createDataFrame(
        [("a", "onsite", 62700.0, True, True), ("b", "onsite", 62400.0, True, True)],
        "company_key string, work_arrangement string, salary_annualized_min double, "
        "is_active boolean, is_primary boolean")
    firms = spark.createDataFrame([("a", 0.7), ("b", 0.7)],
                                  "company_key string, hiring_frequency_30d double")
    scores = {r.company_key: r.opportunity_score
              for r in scoring.score_companies(jobs, firms).collect()}
    assert scores == {"a": 25.9, "b": 25.8}


def test_score_without_rules_is_null(spark):
    df = spark.range(1)
    assert df.select(scoring.score([], df.schema).alias("s")).head().s is None
    broken = [{"points": 5, "condition": "{"}, {"points": 5, "condition": {"all": []}}]
    assert df.select(scoring.score(broken, df.schema).alias("s")).head().s == 50.0


# --- expressions and the index ---------------------------------------------------------

@pytest.mark.parametrize("text,tree", [
    ("remote billing", ("AND", "remote", "billing")), ("a && b", ("AND", "a", "b")),
    ("a || b", ("OR", "a", "b")), ("dev NOT intern", ("NOT", "dev", "intern")),
    ("a OR b NOT c", ("OR", "a", ("NOT", "b", "c"))), ("a ! b", ("NOT", "a", "b")),
    ('("x y" OR z) AND w', ("AND", ("OR", "x y", "z"), "w")), ("", None), ("   ", None),
    ("python*", "python"), ("a{b}", "a b"), ("ANDROID or", ("AND", "ANDROID", "or")),
])
def test_expressions(text, tree):
    assert boolean.read(text) == tree


@pytest.mark.parametrize("text", ["NOT x", '("a" OR "b"', "a OR b)", "python AND", '"" AND x',
                                  "a AND NOT b", 'foo"bar', "***", "()"])
def test_bad_expressions(text):
    with pytest.raises(boolean.ExpressionError):
        boolean.read(text)


def test_index_round_trip(spark, folder):
    docs = spark.createDataFrame([
        (1, "Medical Billers", "billing of the claims", "Acmé"), (2, "Nurse", "the of", "Beta"),
        (3, "Clerk", None, "Acme")], "job_id long, title string, description_text string, "
        "company_name_raw string")
    textindex.save(textindex.build(docs), f"{folder}/ix")
    index = textindex.load(spark, f"{folder}/ix")

    def ids(expression):
        return sorted(r.job_id for r in textindex.match(index, expression).collect())

    assert ids('"of the"') == [1] and ids("acme") == [1, 3] and ids("claim NOT nurse") == [1]
    assert ids("biller") == [1] and ids("clerk OR nurse") == [2, 3] and ids('"the the"') == []
    assert ids("--") == [] and ids("clerk --") == [3]


# --- sources -------------------------------------------------------------------------------

def test_payload_files(spark, folder):
    def land(source, name, body):
        import os
        os.makedirs(f"{folder}/{source}", exist_ok=True)
        with open(f"{folder}/{source}/{name}.json", "w") as f:
            json.dump(body, f, indent=1)

    land("remotive", "a", {"jobs": [
        {"id": 7, "title": " ", "company_name": " Acme ", "description": "<p>x</p>",
         "publication_date": "2024-03-05T10:00:00", "url": "https://e.com/7",
         "tags": ["x"], "salary": " $5 "}]})
    land("adzuna", "a", {"results": [
        {"id": "9", "title": "Dev", "company": {"display_name": "B"}, "salary_min": 5.5,
         "salary_is_predicted": "1", "created": "2024-03-05T10:00:00Z",
         "location": {"area": ["US", "Texas", "Austin"], "display_name": "Austin, Texas"}}]})
    land("usajobs", "a", {"SearchResult": {"SearchResultItems": [
        {"MatchedObjectId": "5", "MatchedObjectDescriptor": {
            "PositionTitle": "Analyst", "PositionRemuneration": [
                {"MinimumRange": "55.5", "MaximumRange": "n/a", "RateIntervalCode": "Per Hour"}],
            "PositionLocation": [{"CityName": "Reno", "CountrySubDivisionCode": "NV"}],
            "UserArea": {"Details": {"JobSummary": "S", "MajorDuties": ["a", "b"],
                                     "TeleworkEligible": True}}}},
        {"MatchedObjectId": "6"}]}})
    land("greenhouse", "acme", {"jobs": [
        {"id": 1, "title": "T", "location": {"name": "Remote"}, "absolute_url": "https://g",
         "first_published": "2024-03-05", "departments": [{"name": "D"}]}]})
    land("lever", "beta", [{"id": "l1", "text": "T", "descriptionPlain": "plain",
                            "createdAt": 1709596800000, "hostedUrl": "https://h"}])
    land("ashby", "gamma", {"jobs": [{"id": "x", "title": "T", "isRemote": True,
                                      "descriptionPlain": "text"}]})
    land("workable", "delta", {"name": "Delta Co", "jobs": [
        {"shortcode": "SC", "id": "1", "title": "T", "city": "Rome", "state": "",
         "country": "usa", "telecommuting": True}]})
    names = spark.createDataFrame([("acme", "Acme Corp")], "token string, name string")
    parts = {s: payloads.read(spark, s, f"{folder}/{s}",
                              *([names] if s in payloads.BOARDS else []))
             for s in payloads.PARSERS}
    assert all(p.dtypes == [(f.name, f.dataType.simpleString()) for f in RAW_POSTING]
               for p in parts.values())
    rows = {r.source_key: r for r in payloads.union_sources(parts).collect()}
    assert rows["remotive"].title == "(untitled)" and rows["remotive"].company_name == "Acme"
    assert (rows["adzuna"].state, rows["adzuna"].city) == ("Texas", "Austin")
    assert rows["adzuna"].salary_is_estimated and rows["adzuna"].description_is_truncated
    usa = rows["usajobs"]
    assert usa.description_text == "S\n\na\nb" and usa.source_job_id == "5" and usa.is_remote
    assert (usa.salary_min, usa.salary_max, usa.salary_period) == (55.5, None, "hourly")
    assert rows["greenhouse"].source_job_id == "acme:1"
    assert rows["greenhouse"].company_name == "Acme Corp"
    assert rows["lever"].date_posted == dt.datetime(2024, 3, 5)
    assert rows["lever"].company_name == "beta" and rows["lever"].apply_url == "https://h"
    assert rows["ashby"].is_remote and rows["ashby"].source_job_id == "gamma:x"
    assert (rows["workable"].company_name, rows["workable"].location_raw,
            rows["workable"].country, rows["workable"].source_job_id) == (
                "Delta Co", "Rome", "US", "delta:SC")
    enrich(payloads.union_sources(parts), corpus.MATCHER).collect()


def test_reference_files(spark, folder):
    with open(f"{folder}/seed.csv", "w") as f:
        f.write("name,domain,industry,ats_platform,ats_board_token\n"
                " Acme Inc ,acme.com,,lever,acme\n ,x.com,,,\n")
    with open(f"{folder}/skills.json", "w") as f:
        f.write('{"category": "t", "name": "SQL", "aliases": ["t-sql"]}\n'
                '{"category": "t", "name": "Go"}\n')
    row = reference.read_seed_companies(spark, f"{folder}/seed.csv").collect()
    assert [(r.name, r.company_key, r.industry) for r in row] == [("Acme Inc", "acme", None)]
    taxonomy = reference.read_taxonomy(spark, f"{folder}/skills.json")
    assert skills.SkillMatcher.from_taxonomy(taxonomy).aliases == {
        "sql": "SQL", "t-sql": "SQL", "go": "Go"}
    assert [r.name for r in search.filter_skills(taxonomy, "q").collect()] == ["SQL"]


# --- tables kept by hand -----------------------------------------------------------------------

def test_custom_fields(spark):
    fields = {"fit": "score", "due": "date", "tags": "multiselect", "note": "text"}
    entries = spark.createDataFrame([
        ("fit", "job", 1, "85"), ("fit", "job", 2, "high"), ("due", "job", 1, "2024-01-02"),
        ("tags", "job", 1, '["a", "b"]'), ("note", "job", 1, ""), ("what", "job", 1, "x")],
        "key string, entity string, entity_id long, value string")
    good, bad = customfields.write_values(entries, fields)
    assert {(r.key, r.entity_id) for r in bad.collect()} == {("fit", 2), ("what", 1)}
    wide = {r.entity_id: r for r in customfields.read_values(good, fields).collect()}
    assert wide[1].fit == 85.0 and wide[1].tags == ["a", "b"] and wide[1].note is None
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")

    def kept(**f):
        return search.filter_custom(jobs, good, fields, f).count()

    assert kept(key="fit", op="gte", value=80) == 1 and kept(key="fit", op="gte", value=95) == 0
    assert kept(key="fit", op="is_empty") == 1 and kept(key="note", op="is_empty") == 2
    with pytest.raises(ValueError):
        kept(key="gone")
    later = customfields.write_values(entries.where("entity_id = 1 and key = 'fit'")
                                      .withColumn("value", F.lit("10")), fields)[0]
    merged = customfields.upsert_values(good, later)
    assert merged.where("key = 'fit'").head().value_number == 10.0


def test_research_updates(spark):
    jobs = spark.createDataFrame([(1, True), (2, True), (3, True)],
                                 "job_id long, is_primary boolean")
    stored = spark.createDataFrame([(1, "relevant", "low", "n")],
                                   "job_id long, status string, priority string, notes string")
    updates = spark.createDataFrame([(1, None, "high"), (2, None, None), (9, "new", "low")],
                                    "job_id long, status string, priority string")
    got = research.apply_updates(stored, updates, jobs)
    assert {r.job_id: tuple(r)[1:] for r in got.collect()} == {
        1: ("relevant", "high", "n"), 2: ("new", None, None)}
    summary = {r.status: r.n for r in research.status_summary(got, jobs).collect()}
    assert summary["new"] == 2 and summary["relevant"] == 1 and len(summary) == 6


def test_stale_and_truncated(spark):
    columns = ("source_key string, source_job_id string, description_text string, "
               "description_is_truncated boolean, last_seen_at timestamp, is_active boolean, "
               "date_collected timestamp, seq long, title string")
    old = spark.createDataFrame([("a", "1", "full", False, NOW, False, NOW, 1, "t")], columns)
    new = spark.createDataFrame([("a", "1", "cut", True, NOW, True, NOW, 2, "u"),
                                 ("a", "2", "cut", True, NOW, True, NOW, 3, "v")], columns)
    later = NOW + dt.timedelta(days=50)
    rows = {r.source_job_id: r for r in upserts.upsert_jobs(old, new, later).collect()}
    assert rows["1"].description_text == "full" and rows["1"].title == "u"
    assert rows["1"].is_active and rows["1"].last_seen_at == later
    assert (rows["1"].outcome, rows["2"].outcome) == ("updated", "new")
    closed = upserts.deactivate_stale(new, later).collect()
    assert all(r.closed and not r.is_active for r in closed)


def test_streaming_is_idempotent(spark, folder):
    raw = spark.createDataFrame(POSTINGS, RAW_POSTING).coalesce(1)

    def go():
        ingest.run_available(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress",
                             corpus.MATCHER).awaitTermination()
        return ingest.current_jobs(spark, f"{folder}/out")

    raw.where("source_key = 'remotive'").write.mode("append").json(f"{folder}/in")
    assert go().count() == 4
    assert go().count() == 4
    raw.where("source_job_id in ('larkspur:p-1', 'p-2')").write.mode("append").json(
        f"{folder}/in")
    jobs = go()
    assert jobs.count() == 5 and jobs.where("is_primary").count() == 4
    top = jobs.where("is_primary and title = 'Senior Payroll Accountant'").head()
    assert top.source_key == "greenhouse" and top.duplicate_count == 1
    assert {r.outcome: r["count"] for r in jobs.where("outcome is not null").groupBy(
        "outcome").count().collect()} == {"updated": 1, "duplicate": 1}
    assert spark.read.parquet(f"{folder}/out/outcomes").count() == 5


def test_landed_lines_and_files_are_all_read(spark, folder):
    import json
    import os

    from rolemill.sources import payloads
    payload = lambda i: json.dumps({"jobs": [
        {"id": i, "title": f"Baker {i}", "company_name": "Loaf House"}]})
    with open(os.path.join(folder, "many.jsonl"), "w") as f:
        f.write("\n".join(payload(i) for i in range(5)))
    with open(os.path.join(folder, "one.json"), "w") as f:
        f.write(json.dumps(json.loads(payload(9)), indent=2))
    assert payloads.read(spark, "remotive", folder).count() == 6
    assert payloads.read(spark, "remotive", os.path.join(folder, "many.jsonl")).count() == 5


def test_compressed_files_and_broken_lines_are_accounted_for(spark, folder):
    import gzip
    import json
    import os

    from rolemill.sources import payloads

    def payload(i, **more):
        return json.dumps({"jobs": [{"id": i, "title": f"Baker {i}", "company_name": "Loaf House"} | more]})

    def put(name, text, opened=open):
        with opened(os.path.join(folder, name), "wt") as f:
            f.write(text)

    lines = "\n".join(payload(i) for i in range(5))
    put("a.jsonl.gz", lines, gzip.open)
    put("b.ndjson", lines + "\n\n" + payload(8)[:-3] + "\n" + payload(7) + " trailing\nnull\n")
    put("c d.json", lines)                                          # lines without saying so
    put("e.json", json.dumps(json.loads(payload(9)), indent=2))     # one payload, many lines
    put("f.json.gz", json.dumps(json.loads(payload(9)), indent=2), gzip.open)
    put("g.json", json.dumps(json.loads(payload(9)), indent=2)[:-4])
    put("h.json", "")
    put("i.json", payload(3, salary=12, extra={"x": 1}))
    landed = payloads.land(spark, "remotive", folder)
    counts = {r.file.split("/")[-1].replace("%20", " "): (r.payloads, r.parsed, r.quarantined)
              for r in landed.counts().collect()}
    assert counts == {"a.jsonl.gz": (5, 5, 0), "b.ndjson": (8, 5, 3), "c d.json": (5, 5, 0),
                      "e.json": (1, 1, 0), "f.json.gz": (1, 1, 0), "g.json": (1, 0, 1), "i.json": (1, 1, 0)}
    assert landed.postings().count() == 18 == payloads.read(spark, "remotive", folder).count()
    broken = {r.body for r in landed.quarantine().collect()}
    assert payload(8)[:-3] in broken and payload(7) + " trailing" in broken and "null" in broken
    os.mkdir(os.path.join(folder, "lever"))
    board = [{"id": str(i), "text": "Baker", "hostedUrl": f"u{i}"} for i in range(3)]
    put("lever/loaf.json", json.dumps(board, indent=1))
    put("lever/crumb.jsonl.gz", json.dumps(board) + "\n" + json.dumps(board[0]), gzip.open)
    rows = payloads.read(spark, "lever", os.path.join(folder, "lever")).collect()
    assert sorted(r.source_job_id for r in rows) == sorted(
        [f"loaf:{i}" for i in range(3)] + [f"crumb:{i}" for i in (0, 1, 2, 0)])
