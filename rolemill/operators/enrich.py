"""Raw posting to job fields."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions import dates, extract, fingerprint, labels, pay, place, text
from rolemill.operators.skills import SkillMatcher, skills_in


def enrich(raw: DataFrame, matcher: SkillMatcher | None = None,
           windows: dict[str, int] | None = None, keep_contacts: int | None = None) -> DataFrame:
    """Everything one posting says about itself, as flat job columns.

    Whole texts are read. ``windows`` limits single fields to a text's first characters
    (keys: pay, years, arrangement, employment, level, education), ``keep_contacts`` the
    contacts to the first ones.

    Row-local from end to end, so it needs no shuffle; columns nobody selects
    are pruned together with the expressions behind them. Extra columns of
    ``raw`` (keys, arrival order) pass through. A filter on a derived column
    repeats that column's text work, so searches, facets and scores belong on
    stored jobs (``operators.store``), where it is a pushed-down predicate.
    """
    c, upto = F.col, (windows or {}).get
    # Only what stands in for a missing text is read out of the HTML.
    df = raw.withColumn("_html", F.when(
        F.coalesce("description_text", F.lit("")) == "", c("description_html")))
    df = text.with_text(df, "_html", "_html_text")
    df = df.withColumn("description_text", F.coalesce(
        F.nullif("description_text", F.lit("")), "_html_text")).drop("_html", "_html_text")
    df = df.withColumn("_amount", pay.salary_match(c("description_text"), upto("pay")))
    df = df.withColumn("_text_pay", pay.parse_salary(
        c("description_text"), c("_amount")))
    df = place.with_place(df)
    df = df.withColumns({
        "_years": extract.experience_years(c("description_text"), upto("years")),
        "_pay": pay.resolve_salary(c("salary_min"), c("salary_max"),
                                   c("salary_period"), c("salary_currency"),
                                   c("salary_is_estimated"), c("_text_pay")),
        "_flags": extract.flag_text(c("title"), c("description_text")),
        "_detected": labels.work_arrangement(
            c("title"), c("location_raw"), text.opening(c("description_text"), upto("arrangement"))),
        "_contacts": extract.contacts(c("description_text"), keep_contacts),
    })
    df = df.withColumns({
        "title_normalized": text.normalize_title(c("title")),
        "company_name_raw": c("company_name"),
        "company_key": text.normalize_company(c("company_name")),
        "work_arrangement": labels.resolve_arrangement(c("_detected"), c("is_remote")),
        "employment_type": labels.employment_type(
            c("employment_type"), c("title"),
            text.opening(c("description_text"), upto("employment"))),
        "experience_level": labels.experience_level(
            c("title"), c("description_text"), c("_years.years_experience_min"),
            upto("level")),
        "education_level": labels.education_level(c("description_text"), upto("education")),
        "years_experience_min": c("_years.years_experience_min"),
        "years_experience_max": c("_years.years_experience_max"),
        "salary_min": c("_pay.salary_min"), "salary_max": c("_pay.salary_max"),
        "salary_period": c("_pay.salary_period"),
        "salary_currency": c("_pay.salary_currency"),
        "salary_is_estimated": c("_pay.salary_is_estimated"),
        "salary_annualized_min": pay.annualize(c("_pay.salary_min"),
                                               c("_pay.salary_period")),
        "salary_annualized_max": pay.annualize(c("_pay.salary_max"),
                                               c("_pay.salary_period")),
        "visa_sponsorship_mentioned": extract.sponsorship(c("_flags")),
        "relocation_mentioned": extract.relocation(c("_flags")),
        "urgently_hiring": extract.urgently_hiring(c("_flags")),
        "is_recruitment_agency": extract.recruitment_agency(c("_flags")),
        "benefits": extract.benefits(c("description_text")),
        "emails": c("_contacts.emails"), "phones": c("_contacts.phones"),
        "board": F.coalesce(extract.detect_board(c("apply_url")),
                            extract.detect_board(c("job_url"))),
        "simhash": fingerprint.simhash(c("description_text")),
        # Beside the simhash, so that the text goes to Python once for both.
        **({} if matcher is None else {"skills": skills_in(c("description_text"), matcher)}),
    })
    df = df.withColumn("canonical_hash", fingerprint.normalized_hash(
        c("title_normalized"), c("company_key"), c("city"), c("state")))
    return (df.withColumn("description_text", F.nullif("description_text", F.lit("")))
            .drop("_years", "_pay", "_flags", "_detected", "_contacts",
                  "_amount", "_text_pay", "company_name"))
