import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from registryloom.functions import ids, tags, text, values

LETTERS = st.text(
    st.one_of(
        st.characters(min_codepoint=9, max_codepoint=0x17F),
        st.sampled_from(" 　 \x1c\x85 \t\r\n,.&'()/-0中ㄱдЖñ"),
    ),
    max_size=30,
)
BATCHES = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def py_collapse(s):
    return re.sub(r"\s{2,}", " ", re.sub(r"[\t\r\n]+", " ", s))


@BATCHES
@given(st.lists(LETTERS, min_size=60, max_size=120))
def test_text_rules_equal_python(one, batch):
    assert one(text.strip, batch) == [s.strip() for s in batch]
    assert one(text.collapse, batch) == [py_collapse(s) for s in batch]
    assert one(text.title, batch) == [s.title() for s in batch]
    assert one(text.remove_punct, batch) == [re.sub(r"[^\w\s]", "", s) for s in batch]


@BATCHES
@given(st.lists(LETTERS, min_size=60, max_size=120))
def test_first_token_and_key_equal_python(one, batch):
    tokens = [re.split(r"[\r\n]+", s)[0].split(",", 1)[0].strip().title() for s in batch]
    assert one(text.first_token, batch) == tokens
    keys = [re.sub(r"[^\w\s]", "", py_collapse(s.strip()).lower()) for s in batch]
    assert one(text.norm_key, batch) == keys


@pytest.mark.parametrize(
    "raw, mode, want",
    [
        (" i/ii ", "title", "I/Ii"),
        ("o'neil", "title", "O'Neil"),
        ("2nd CNS", "title", "2Nd Cns"),
        ("straße ßa", "title", "Straße Ssa"),
        ("İstanbul ИЛИ", "title", "İstanbul Или"),
        ("a\t\r\nb  c", "upper", "A B C"),
        (" x ", "none", "x"),
        ("a b", "none", "a b"),
        ("a\x0bb", "none", "a\x0bb"),
        ("a \t b", "lower", "a b"),
        (None, "title", None),
    ],
)
def test_clean_text_golden(one, raw, mode, want):
    assert one(lambda c: text.clean_text(c, case_mode=mode), [raw]) == [want]


def test_clean_text_switches_and_errors(one):
    assert one(lambda c: text.clean_text(c, strip_ws=False), ["  a "]) == [" a "]
    assert one(lambda c: text.clean_text(c, collapse_ws=False), [" a\n\nb "]) == ["a\n\nb"]
    with pytest.raises(ValueError):
        text.clean_text(F.lit("x"), case_mode="camel")
    with pytest.raises(ValueError):
        text.norm_key(F.lit("x"), mode="other")


def test_key_modes_differ_where_punctuation_leaves_two_spaces(one):
    assert one(text.norm_key, ["A & B"]) == ["a  b"]
    assert one(lambda c: text.norm_key(c, mode="idempotent"), ["A & B."]) == ["a b"]
    assert one(lambda c: text.norm_key(c, punct=False), ["A & B."]) == ["a & b."]


def test_first_token_edges(one):
    raw = ["\nsecond", "a co, b\nc", " x\ry", ",b", "", None]
    assert one(text.first_token, raw) == ["", "A Co", "X", "", "", None]


def test_registry_id(one):
    raw = ["eu 1; nct00000007 NCT00000009", "xNCT123", "n/a nct", None, "NCT١٢٣٤٥٦٧٨"]
    no = ids.NO_CODE
    assert one(ids.registry_id, raw) == ["NCT00000007", no, no, no, "NCT١٢٣٤٥٦٧٨"]
    assert one(ids.id_position, raw) == [6, 1, 4, None, 0]
    assert one(ids.has_no_code, [" No NCT code\t", "x", None]) == [True, False, False]


def test_age_groups(one):
    raw = ["Children, Adults", "older adults", "childrens", "éAdults", "Adults_", None, "Adults"]
    adult = one(lambda c: ids.mentions_group(c, "Adults"), raw)
    assert adult == [True, True, False, False, False, False, True]
    assert one(lambda c: ids.mentions_group(c, "Older Adults"), raw)[:2] == [False, True]
    assert one(lambda c: ids.mentions_group(c, "Children"), raw)[:3] == [True, False, False]


def test_title_case_keeps_every_character(one):
    cells = ["\ufdd0 a", "a\ufdd0 b", "\ufdd0\ufdd1x", "\ufdd0", "\ufdd0\ufdd0 ab \ufdd1"]
    assert one(text.title, cells) == [s.title() for s in cells]


def test_short_spellings_of_dates(one):
    cells = ["3/5/2020", "5-Mar-2020", "Mar 5, 2020", "2020/03/05", "20200305", "2020/3/5", "Mar 2020", "20201", "202003055"]
    day = dt.datetime(2020, 3, 5)
    want = [day] * 6 + [dt.datetime(2020, 3, 1), None, None]
    assert one(values.to_timestamp, cells) == want


def test_dates_are_parsed_value_by_value(one):
    raw = ["2015-03-02", "2015-03", "2015", "03/02/2015", "02-Mar-2015", "March 2, 2015",
           "March 2015", "2015-03-02 10:30:00", "n/a", "2015-13-40", "", None]
    day, first = dt.datetime(2015, 3, 2), dt.datetime(2015, 3, 1)
    want = [day, first, dt.datetime(2015, 1, 1), day, day, day, first,
            dt.datetime(2015, 3, 2, 10, 30), None, None, None, None]
    assert one(values.to_timestamp, raw) == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zones_in_dates_become_utc(spark, one, zone):
    raw = ["2015-01-01T23:30:00-05:00", "2015-03-08T02:30:00Z", "2015-03-08 02:30:00",
           "1960-01-01T00:00:00.123456Z", "at 10:30 and a Z"]
    want = [dt.datetime(2015, 1, 2, 4, 30), dt.datetime(2015, 3, 8, 2, 30),
            dt.datetime(2015, 3, 8, 2, 30), dt.datetime(1960, 1, 1, 0, 0, 0, 123456), None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(values.to_timestamp, raw) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_integers(one):
    raw = ["12", "12.0", "2.5", "x1", " 7 ", "1e3", "9007199254740993", "-", ".", "", None]
    want = [12, 12, None, None, 7, 1000, 9007199254740993, None, None, None, None]
    assert one(values.to_bigint, raw) == want
    assert one(values.to_bigint, [2.0, 2.5], "double") == [2, None]


def test_tags(one):
    assert one(tags.phase_tag, [" ii/iii ", "IV", "V", None]) == [
        "III", "IV", "Recommend Exclude", "Recommend Exclude"]
    assert one(tags.area_tag, ["Cns", "CNS", "Vaccines (Infectious Disease)", None]) == [
        "Cns", "Multiple", "Vaccines", "Multiple"]
    assert one(tags.sponsor_tag, [" INDUSTRY", "Academic", "Government", None]) == [
        "Industry", "Academic", "Others", "Others"]
    na, eu, asia, au = "North America", "Western Europe", "Asia", "Australia/Oceania"
    regions = ["", na, eu, asia, au, na + eu, na + au, eu + asia, na + eu + au, "asia", None]
    assert one(tags.region_tag, regions) == [
        "Other", "NA only", "EU only", "APAC only", "APAC only", "NA and EU", "NA and APAC",
        "EU and APAC", "Global", "Other", "Other"]
    blobs = ["DOUBLE-BLIND", "NON INTERVENTIONAL", "NON INTERVENTIONAL", "OBSERVATION",
             "DOSE", "DOUBLE  BLIND", None]
    assert one(tags.study_type, blobs) == [
        "Interventional", "Ambiguous", "Ambiguous", "Observational", "Unknown", "Unknown",
        "Unknown"]
    titles = ["in sars-cov-2", "2019-nCoV", "covi d", None]
    covid = one(lambda c: tags.covid_tag(c, F.lit("flu")), titles)
    assert covid == [tags.COVID_LABEL, tags.COVID_LABEL, "", ""]


def test_literal_search_is_not_a_pattern(one):
    assert one(lambda c: text.contains_any(c, ["a.b", "x|y"]), ["acb", "za.bz", "x|y", None]) == [
        False, True, True, False]


def test_sanitize(one):
    raw = ["a\x00\x07\tb\r\nc\x0b\x1f", None, "x" * 40000, "\U0001f600" * 5]
    out = one(lambda c: text.sanitize_cell(c, 32760), raw)
    assert out == ["a\tb\r\nc", "", "x" * 32760, "\U0001f600" * 5]
