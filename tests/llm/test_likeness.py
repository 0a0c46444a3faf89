"""The likeness of fingerprints' texts after edits in several places."""

import random

import pytest

from shoebox.llm import fingerprints


def _likeness(a, b):
    x, y = (fingerprints.Fingerprint.read(str(fingerprints.Prefixes(fingerprints.points_of(s.encode())).fingerprint())) for s in (a, b))
    assert x.likeness(y) == pytest.approx(y.likeness(x), abs=0.02)
    return x.likeness(y)


def test_scattered_edits_stay_near_one():
    draw = random.Random(3)
    text = "".join(draw.choice("abcdefghij klmnopé") for _ in range(10_000))
    assert _likeness(text, "X" + text[1:-1] + "Y") == pytest.approx(0.99, abs=0.01)
    edited = text
    for at in range(9500, 0, -500):
        edited = edited[:at] + draw.choice(["", "ZZ", "Q"]) + edited[at + draw.randint(0, 2) :]
    assert 0.85 < _likeness(text, edited) < 1  # 19 edits cost a span or two each
    other = "".join(draw.choice("abcdefghij klmnopé") for _ in range(10_000))
    assert _likeness(text, other) < 0.01 and _likeness(text, text) == 1


def test_common_stretches_are_counted_once():
    assert _likeness("ab" * 500, "ab" * 300) == pytest.approx(0.6, abs=0.05)  # without chosen places, spans have MOST code points
    assert 0.4 <= _likeness("x" * 1000, "x" * 500 + "y") < 1
