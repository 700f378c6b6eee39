from datetime import datetime, timedelta, timezone

import pytest

from tracelake.functions import grammar as g

NOW = datetime(2026, 6, 7, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(("spec", "want"), [("3", (3, 3)), ("1..4", (1, 4)), ("2..", (2, None)), ("..5", (None, 5)), ("-2", (-2, -2)), ("-3..-1", (-3, -1))])
def test_ranges(spec, want):
    r = g.parse_range(spec)
    assert (r.first, r.last) == want


@pytest.mark.parametrize("spec", ["", "..", "a", "4..1", "1-2"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        g.parse_range(spec)


def test_when():
    assert g.parse_when("now", NOW) == NOW
    assert g.parse_when("2h", NOW) == NOW - timedelta(hours=2)
    assert g.parse_when("2mo", NOW) == NOW - timedelta(days=60)
    assert g.parse_when("1y", NOW) == NOW - timedelta(days=365)
    assert g.parse_when("2026-06-01", NOW) == datetime(2026, 6, 1, tzinfo=timezone.utc)
    assert g.parse_when("2026-06-01T01:02:03Z", NOW).hour == 1


def test_window_must_not_end_before_it_begins():
    with pytest.raises(ValueError):
        g.window(None, NOW, NOW - timedelta(days=1))


def test_smart_case_and_needles():
    assert g.smart_case("abc") == "(?i)abc"
    assert g.smart_case("aBc") == "aBc"
    assert g.smart_case(r"\Wx") == r"(?i)\Wx"
    assert g.needles("TodoWrite") == ["TodoWrite"]
    assert g.needles("a|b") == []


def test_selector_forms():
    assert g.parse_selector("user.*").glob
    with pytest.raises(ValueError):
        g.parse_selector("User")
