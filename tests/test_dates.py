"""ISO dates and timestamps as the standard library reads them."""

import _pydatetime
import datetime
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import dates

FIXED = [
    "10:00", "2024", "2024-01", "garbage", "", "2024-01-31", "20240131", "2024-W01-1", "2024W011", "2024-W01", "2024W01", "2024-W53-1", "2020-W53-7", "2024-W00-1", "2024-W01-8",
    "2024-W011", "2024W01-1", "2024-02-30", "2024-01-31T10:20:30", "2024-01-31 10:20", "2024-01-31T10", "2024-01-31T102030", "2024-01-31T10:2030", "20240131T10:20:30.5", "2024-01-31T10:20:30.1234567",
    "2024-01-31T10:20:30Z", "2024-01-31T10:20:30z", "2024-01-31T10:20:30+02:00", "2024-01-31T10:20:30-0530", "2024-01-31T10:20:30+02", "2024-01-31T10:20:30+24:00", "2024-01-31T25:00", "2024-01-31T10:60",
    "2024-01-31T10:20:60", "2024-01-31T", "2024-01-31x10:20", "2024-01-31T10:20:30,25", "0000-01-01", "0001-01-01T00:00:00", "2024-01-31T10:20+01:30:15", " 2024-01-31", "2024-01-31T10:20:30 +02:00", "2024-1-31",
]


def read(text, kind):
    try:
        x = kind.fromisoformat(text)
    except (ValueError, TypeError, AssertionError):
        return None
    fields = [x.year, x.month, x.day, x.hour, x.minute, x.second, x.microsecond]
    offset = x.utcoffset()
    return datetime.datetime(*fields), offset and datetime.timedelta(seconds=offset.total_seconds())


def standard(text):
    """Microseconds since 1970; "?" where the library's two forms differ (one stray character before a zone, an empty time)."""
    one, other = read(text, datetime.datetime), read(text, _pydatetime.datetime)
    if one != other:
        return "?"
    return one and (one[0] - (one[1] or datetime.timedelta()) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def test_timestamps_are_the_standard_ones(values):
    rng = random.Random(8)
    texts = list(FIXED)
    for _ in range(400):
        t = rng.choice(FIXED[5:])
        if t and rng.random() < 0.7:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", rng.choice("0123456789-:TZ+. W")]) + t[i + rng.randint(0, 1) :]
        texts.append(t)
    got = values("s string", [(t,) for t in texts] + [(None,)], F.unix_micros(dates.parse_timestamp("s")))
    bad = [(t, g, standard(t)) for t, g in zip([*texts, None], got) if standard(t) not in (g, "?")]
    assert sum(standard(t) not in (None, "?") for t in texts) > 100
    assert not bad, bad[:10]


@pytest.mark.parametrize("text", FIXED)
def test_form_dates_are_the_standard_ones(values, text):
    if text == "2024-W011":
        pytest.skip("the library's two forms differ")
    try:
        want = datetime.date.fromisoformat(text.strip())
    except ValueError:
        want = None
    (got,) = values("s string", [(text,)], dates.form_date("s"))
    assert got.value == want and (got.problem is None) == (want is not None or not text.strip())
