"""Scalar functions over a few fixed values with their known results; the tables have no such texts.

Each case is rows of (arguments, result) and the function; a NULL stands for no result. The
SQL twin states the results, so the functions are compared with values and not with themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import scalars as X

_Rows = list[tuple[tuple, str | None]]


def _text(c: Column) -> Column:
    return c.cast("string")


CASES: dict[str, tuple[_Rows, Callable[..., Column]]] = {
    "exif_datetime": (
        [(("2024:03:05 10:20:30",), "1709634030"), ((" 2024:03:05 10:20:30 ",), "1709634030"), (("2024:03:05 10:20:30\x00",), "1709634030"), (("0000:00:00 00:00:00",), None), (("2024:13:05 10:20:30",), None), (("2024-03-05 10:20:30",), None), (("",), None)],
        lambda a: _text(X.exif_seconds(a)),
    ),
    "iso6709": (
        [(("+48.5+002.25+035/",), "48.5 2.25"), (("-33.5+151.25/",), "-33.5 151.25"), (("+27.5-082.5CRSWGS_84/",), None), (("+27.5-082.5/CRSWGS_84",), "27.5 -82.5"), (("+00.0+000.0/",), None), (("+91.0+000.5/",), None), (("48.5,2.3",), None), (("+48.5",), None)],
        lambda a: F.concat(_text(X.iso6709(a)["lat"]), F.lit(" "), _text(X.iso6709(a)["lon"])),
    ),
    "dms_to_decimal": ([((48.0, 30.0, 0.0, "N"), "48.5"), ((33.0, 15.0, 0.0, "s"), "-33.25"), ((0.0, 45.0, 0.0, "W"), "-0.75"), ((10.0, 0.0, 0.0, "E"), "10.0")], lambda d, m, s, r: _text(X.dms(d, m, s, r))),
    "plausible_place": ([((48.5, 2.25), "true"), ((0.0, 0.0), "false"), ((0.0, 5.0), "true"), ((91.0, 0.0), "false"), ((float("nan"), 1.0), "false"), ((None, 1.0), "false")], lambda a, b: _text(X.plausible(a, b))),
    "rotation": ([((90.0, 10, 20), "20 10"), ((-90.0, 10, 20), "20 10"), ((180.0, 10, 20), "10 20"), ((-270.4, 10, 20), "20 10"), ((0.0, 10, 20), "10 20")], lambda r, w, h: F.concat_ws(" ", X.shown_size(w, h, r)["width"], X.shown_size(w, h, r)["height"])),
    "positive_number": ([(("12.5",), "12.5"), (("N/A",), None), (("-1",), None), (("0",), None), (("Infinity",), None), (("NaN",), None)], lambda a: _text(X.positive_number(a))),
    "version_at_least": (
        [(("1.10", "1.9"), "true"), (("1.2", "1.2.0"), "true"), (("1.2", "1.2.1"), "false"), (("2", "10"), "false"), (("1.0-beta", "1.0-beta"), "true"), (("1.0-beta", "1.0"), "false"), (("3", "3.0.0"), "true")],
        lambda a, b: _text(X.version_at_least(a, b)),
    ),
    "safe_name": (
        [(("photo.jpg",), "photo.jpg"), (("../../etc/photo.JPG",), "photo.JPG"), (("a\\b\\c.png",), "c.png"), (("..hidden.gif..",), "hidden.gif"), (("tab\tname.mp4",), "tab_name.mp4"), ((" . photo.jpg ",), " photo.jpg"), (("a\x85b.jpg",), "a_b.jpg"), (("notes.txt",), None), (("/",), None), (("",), None)],
        lambda a: X.safe_name(a),
    ),
    "sender_date": ([(("1700000000123",), "1700000000"), (("0",), None), (("-5",), None), (("9999999999999",), None), (("soon",), None)], lambda a: _text(X.sender_seconds(a, F.lit(1_800_000_000_000)))),
    "valid_path": ([(("a/b.jpg",), "true"), (("",), "false"), (("a//b",), "false"), (("./a",), "false"), (("a/../b",), "false"), (("a/..b",), "true")], lambda a: _text(X.valid_path(a))),
    "set_entry": ([(("a",), "a -"), (("a::3",), "a 3"), (("a::b::3",), "a::b 3"), (("::3",), "::3 -"), (("a::",), "a:: -"), (("a::99999999999",), "a::99999999999 -"), (("a::007",), "a 7")], lambda a: F.concat_ws(" ", X.set_name(a), F.coalesce(_text(X.set_position(a)), F.lit("-")))),
    "trash_id": ([(("1700000000000_1",), "1700000000000"), (("1700000000000",), "1700000000000"), (("abc_1",), None), (("_1",), None)], lambda a: _text(X.trash_ms(a))),
    "rfc3339_parse": ([(("2020-05-05T00:00:00Z",), "1588636800"), (("2020-05-05T02:00:00+02:00",), "1588636800"), (("2020-05-05T00:00:00.250Z",), "1588636800"), (("2020-05-05",), None), (("2020-02-30T00:00:00Z",), None)], lambda a: _text(X.rfc3339_seconds(a))),
    "capture_clock": (
        [(("2024-06-01T10:00:00+0200", None), "1717236000"), ((None, "2024-06-01T08:00:00.000000Z"), "1717236000"), (("bad", "2024-06-01T08:00:00Z"), "1717236000"), (("1960-01-01T00:00:00+0000", None), "-315619200"), ((None, "1960-01-01T00:00:00Z"), None), ((None, None), None)],
        lambda a, b: _text(X.capture_clock(a, b, "+02:00")),
    ),
    "fuzzy_score": (
        [(("beach",), "1000"), (("beaches",), "593"), (("a beach",), "198"), (("été beach",), "194"), (("b-e-a-c-h",), "50"), (("bach",), None), (("beach" + "x" * 200,), "500")],
        lambda a: _text(X.fuzzy_score(a, "beach")),
    ),
    "place_tags": ([(("France", "Ile de France", "Paris", 10.0), "France,Ile_de_France,Paris"), (("Singapore", "Singapore", "Singapore", 5.0), "Singapore"), (("Chad", "", "Faya", 60.0), "Chad"), (("Chad", "Borkou", "Faya", 101.0), "")], lambda a, b, c, k: F.array_join(X.place_tags(a, b, c, k), ",")),
    "row_boost": ([((1.5,), "1.0"), ((3.0,), "1.0"), ((0.375,), "1.6"), ((0.96,), "1.25")], lambda a: _text(F.round(X.row_boost(a), 6))),
    "difference_hash": (
        [(([10] * 4 * 72, 9, 8), "0"), (([c for _ in range(8) for x in range(9) for c in (x * 20, x * 20, x * 20, 255)], 9, 8), "-1"), (([c for _ in range(8) for x in range(9) for c in (200 - x * 20,) * 4], 9, 8), "0"), (([0, 0], 9, 8), None), (([10] * 4 * 80, 9, 8), "0")],
        lambda p, w, h: _text(X.difference_hash(p, w, h)),
    ),
}


def evaluate(spark: SparkSession, rows: _Rows, function: Callable[..., Column]) -> DataFrame:
    """(k, result) of the function for the arguments of each row."""
    kinds = [_kind([r[0][k] for r in rows]) for k in range(len(rows[0][0]))]
    schema = ", ".join(["k int", *(f"a{k} {kind}" for k, kind in enumerate(kinds))])
    df = spark.createDataFrame([(n, *args) for n, (args, _) in enumerate(rows)], schema)
    return df.select("k", F.nullif(function(*[F.col(f"a{k}") for k in range(len(kinds))]), F.lit("\x01")).alias("result"))


def _kind(values: list) -> str:
    one = next((v for v in values if v is not None), "")
    return {str: "string", float: "double", int: "int", list: "array<int>"}[type(one)]


def expected(rows: _Rows) -> str:
    """The known results as SQL."""
    quoted = lambda s: "cast(NULL AS varchar)" if s is None else "'" + s.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT cast({k} AS int) AS k, {quoted(r)} AS result" for k, (_, r) in enumerate(rows))
