"""Requests parsed from questions."""

import datetime as dt

import pytest

from tidewell.functions.requests import date_range, parse, split_years

TODAY = dt.date(2026, 5, 6)  # a Wednesday


@pytest.mark.parametrize("question,low,high", [
    ("files from 2026-05-04", "2026-05-04", "2026-05-04"), ("yesterday", "2026-05-05", "2026-05-05"), ("what came last week", "2026-04-27", "2026-05-03"), ("last month", "2026-04-01", "2026-04-30"),
    ("notes of May 2014", "2014-05-01", "2014-05-31"), ("on March 3, 2015", "2015-03-03", "2015-03-03"), ("2012 to 2014", "2012-01-01", "2014-12-31"), ("2014-2012", "2012-01-01", "2014-12-31"), ("taxes 2013", "2013-01-01", "2013-12-31"),
])
def test_ranges(question, low, high):
    assert tuple(map(str, date_range(question, TODAY))) == (low, high)


def test_no_range():
    assert date_range("who signed the lease", TODAY) is None
    assert date_range("file of 2026-02-30", TODAY) is None


def test_parse():
    r = parse('the "grey lease" of 2014 and 2015, the lease', TODAY, stop=frozenset({"the", "and"}))
    assert r.years == (2014, 2015) and r.terms[0] == "grey lease" and len(r.terms) == len(set(r.terms))


def test_split_years():
    assert split_years("wages in 2014 and 2015") == ["wages in 2014", "wages in 2015"]
    assert split_years("wages in 2014") == ["wages in 2014"]
