import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from featspark.functions.durations import approx_seconds, parse_duration


@pytest.mark.parametrize(("text", "seconds"), [("1y", 31_557_600), ("1mo", 2_629_800), ("2w3d", 17 * 86400), ("90m", 5400), ("1h30m5s", 5405), ("1q", 7_889_400), ("0s", 0)])
def test_seconds(text, seconds):
    assert approx_seconds(text) == seconds


def test_parts():
    d = parse_duration("1y2mo3d4s")
    assert (d.months, d.micros, d.fixed) == (14, 3 * 86_400_000_000 + 4_000_000, False)


@given(st.text(alphabet="0123456789moyqwdhsDx.- ", max_size=8))
def test_grammar(text):
    if re.fullmatch(r"(?:\d+(?:mo|[yqwdhms]))+", text, re.A):
        assert approx_seconds(text) >= 0
    else:
        with pytest.raises(ValueError, match="duration"):
            parse_duration(text)
