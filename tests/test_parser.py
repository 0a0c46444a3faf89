import pytest

from shoebox.plans import expressions as E
from shoebox.plans import parser as P


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("a b\tc", ["a", "b", "c"]),
        ('user::"two words"', ["user::two words"]),
        ('"open end', ["open end"]),
        ("(a OR b)", ["(", "a", "OR", "b", ")"]),
        ("miku_(singer) AND x", ["miku_(singer)", "AND", "x"]),
        ("(travel)", ["(", "travel", ")"]),
        ('""', []),
        ("a\nb", ["a\nb"]),
        ('"("a', ["(a"]),
    ],
)
def test_tokens(text, tokens):
    assert P.tokenize(text) == tokens


def test_precedence():
    tag = lambda s: E.Tag(None, s)
    assert P.parse("a OR b AND NOT c") == E.Or(tag("a"), E.And(tag("b"), E.Not(tag("c"))))
    assert P.parse("(a or b) and c") == E.And(E.Or(tag("a"), tag("b")), tag("c"))
    assert P.parse("a AND b AND c") == E.And(E.And(tag("a"), tag("b")), tag("c"))


@pytest.mark.parametrize(
    "text, found",
    [
        ("rating>=4", E.Rating("gte", 4)),
        ("type:VIDEO", E.MediaType("video")),
        ("color:none", E.ColorLabel("none")),
        ("missing:geo", E.HasGeo(False)),
        ("has::typo", E.HasNamespace(None)),
        ("plugin.x", E.HasNamespace("plugin.x")),
        ("plugin.x::rating:general", E.Tag("plugin.x", "rating:general")),
        ("typo::x", E.Tag(None, "x")),
        ("width>=1920", E.Number("width", "gte", 1920)),
        ("size<=1.5kb", E.Number("file_size", "lte", 1536)),
        ("date=2024-02", E.DateRange("taken", 1706745600, 1709251199)),
        ("added>=2024-01-01", E.DateRange("added", 1704067200, None)),
        ("viewed<=2023", E.DateRange("viewed", None, 1704067199)),
        ("a=b", E.Tag(None, "a=b")),
    ],
)
def test_terms(text, found):
    assert P.parse(text) == found
    assert E.from_json(found.to_json()) == found


@pytest.mark.parametrize(
    "text, error",
    [
        ("", P.UnexpectedEnd),
        ("a b", P.UnexpectedToken),
        ("NOT NOT a", P.UnexpectedToken),
        ("(a", P.UnexpectedToken),
        ("a AND", P.UnexpectedEnd),
        ("rating>=256", P.InvalidRating),
        ("rating=", P.InvalidRating),
        ("type:pdf", P.UnknownMediaType),
        ("date=24", P.InvalidDate),
        ("date=2024-13", P.InvalidDate),
        ("date=2024-1-1-1", P.InvalidDate),
        ("size>=1tb", P.InvalidNumber),
        ("size>=-1", P.InvalidNumber),
        ("width>=1.5", P.InvalidNumber),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        P.parse(text)


def test_sole_set_and_helpers():
    assert P.parse("((set::trip))").sole_set() == "trip"
    assert P.parse("set::trip AND a").sole_set() is None
    assert P.parse("user::trip").sole_set() is None
    assert P.period("+024") == P.period("0024")
    assert P.completion("a user::be", 10) == (2, "user", "be")
    assert P.completion("typo::be", 8) == (0, None, "typo::be")
    assert P.composed("a OR b", 3) == "a OR b AND rating>=3"
    assert P.composed("", None) == ""
