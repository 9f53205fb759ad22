from datetime import datetime, timezone

import pytest

from flowloom.sources.timespec import parse_time, point, span

NOW = datetime(2024, 3, 6, 10, 30, tzinfo=timezone.utc)  # a Wednesday


def at(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-02-29", at(2024, 2, 29)),
        ("29.02.2024 7:05", at(2024, 2, 29, 7, 5)),
        ("07:05 02/29/2024", at(2024, 2, 29, 7, 5)),
        ("2024-01-01 2024-01-02", at(2024, 1, 2)),
        ("1709720000", 1709720000),
        ("Wed", at(2024, 3, 6)),
        ("thursday", at(2024, 2, 29)),
        ("tue 12:15", at(2024, 3, 5, 12, 15)),
        ("march", at(2024, 3, 1)),
        ("Apr", at(2023, 4, 1)),
        ("10:45", at(2024, 3, 6, 10, 45)),
        ("11:00", at(2024, 3, 5, 11, 0)),
        ("1700000000 10:30", at(2023, 11, 14, 10, 30, 20)),
        ("10:30 1700000000", 1700000000),
        ("Mon March", at(2024, 3, 1)),
        ("2024-03-06 May", at(2024, 5, 6)),
        ("May 2024-03-06", at(2024, 3, 6)),
        ("2024-01-31 feb", at(2024, 3, 2)),
        ("Mon 2024-03-06", at(2024, 3, 6)),
        ("apr 10:45", at(2023, 4, 1, 10, 45)),
        ("Mon Tue", at(2024, 3, 5)),
    ],
)
def test_words(text, want):
    assert parse_time(text, now=NOW) == want


def test_zones():
    assert parse_time("2024-07-01 12:00", "Europe/Prague", NOW) == at(2024, 7, 1, 10)
    assert parse_time("2024-07-01 12:00", "No/Where", NOW) == at(2024, 7, 1, 12)
    assert isinstance(parse_time("2024-07-01", "system", NOW), int)


def test_slots():
    assert point("2024-03-06 10:07", now=NOW) == (at(2024, 3, 6, 10, 5), at(2024, 3, 6, 10, 10))
    assert span("2024-03-06 10:07#2024-03-06 10:11", now=NOW) == (at(2024, 3, 6, 10, 5), at(2024, 3, 6, 10, 15))
    assert span("2024-03-06", now=NOW) == (at(2024, 3, 6), at(2024, 3, 6, 10, 30))


@pytest.mark.parametrize("text", ["", "yesterday", "2024-13-01", "25:00", "12:00:00"])
def test_invalid(text):
    with pytest.raises(ValueError):
        parse_time(text, now=NOW)


@pytest.mark.parametrize("text", ["2024-03-06#2024-03-06", "2024-03-06#2024-03-05", "2024-03-01#2024-03-02#2024-03-03"])
def test_invalid_ranges(text):
    with pytest.raises(ValueError):
        span(text, now=NOW)
