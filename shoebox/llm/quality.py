"""Line-first cleaning.

Every line is judged on its own by rules on punctuation, navigation and boilerplate; lines
that fail are removed. A document is rejected when it loses too many of its words that way,
or fails the base rules on length and repetition. Boilerplate such as a licence line costs
a document that line, not its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import SPACES, bounded_batches, span_hashes, text_bytes, word_spans

#: Base rules: words that a document needs, words in a repeated window, most of them in percent.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: Of its words, a document may lose this share to failing lines.
MOST_LOST = 0.4
#: A line with so many separators, and so many for each word, is navigation.
NAV_SEPARATORS, NAV_SHARE = 3, 0.2
#: Symbols, and exclamation marks, for each word of a line of noise; capitals for each ASCII letter of a shout.
SYMBOL_SHARE, SHOUT_SHARE, CAPITAL_SHARE, CAPITAL_LETTERS = 0.3, 0.3, 0.8, 20
#: A line of at most so many words and characters without a final mark is a fragment; scripts without blanks have long words.
FRAGMENT_WORDS, FRAGMENT_CHARS = 3, 24

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_NO_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
_SEPARATORS = re.compile(rb"\||\xc2\xbb|\xc2\xb7|\xe2\x80\xa2|(?<=\x20)[>/](?=\x20)")
_FINAL = tuple(x.encode() for x in ".!?:;…\"'”’»)]。！？")
_BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|copyright (\(c\)|\xc2\xa9|\d{4})|licensed under|released under the|privacy policy|terms of (use|service)|cookie policy|"
    rb"accept (all )?cookies|enable javascript|click here|read more|sign (in|up) |log in|subscribe to|lorem ipsum|follow us on|share this"
)
#: A line of so many words, of which this share repeats the word before, is a stutter.
STUTTER_WORDS, STUTTER_SHARE = 10, 0.5
#: A boilerplate phrase condemns a line of at most so many words, not a paragraph that mentions it.
BOILERPLATE_WORDS = 20


def line_fails(line: bytes) -> str | None:
    """The rule that a line fails: punctuation, navigation or boilerplate; None for blank and good lines."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if n >= STUTTER_WORDS and sum(map(eq, words, words[1:])) > STUTTER_SHARE * n:
        return "boilerplate"
    if line.count(b"|") + line.count(b"\xc2") + line.count(b"\xe2") + line.count(b" > ") + line.count(b" / ") >= NAV_SEPARATORS:
        separators = len(_SEPARATORS.findall(line))
        if separators >= NAV_SEPARATORS and separators >= NAV_SHARE * n:
            return "navigation"
    if len(line.translate(None, _NO_SYMBOLS)) > SYMBOL_SHARE * n or line.count(b"!!") > SHOUT_SHARE * n:
        return "punctuation"
    upper = len(line.translate(None, _NOT_UPPER))
    if upper >= CAPITAL_LETTERS and upper > CAPITAL_SHARE * (upper + len(line.translate(None, _NOT_LOWER))):
        return "punctuation"
    if n <= FRAGMENT_WORDS and not line.rstrip().endswith(_FINAL) and len(line.decode("utf-8", "replace")) <= FRAGMENT_CHARS:
        return "punctuation"
    if n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(hashes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first one included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(rolled, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def judge(data: bytes) -> tuple[tuple, bytes]:
    """The figures of a text, as in FIGURES, and the text without its failing lines."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    n_words = len(starts)
    word_chars = int(np.count_nonzero((raw & 0xC0) != 0x80) - np.count_nonzero(_SPACE[raw]))
    n_symbols = int(np.count_nonzero(_SYMBOLS[raw]))
    n_repeat = repeated_words(span_hashes(raw, starts, ends))
    seen, dup, lost, bad, good = set(), 0, 0, dict.fromkeys(("punctuation", "navigation", "boilerplate"), 0), []
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
        rule = line_fails(line)
        if rule:
            bad[rule] += 1
            lost += len(line.split())
        else:
            good.append(line)
    base_failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words
    kept = not base_failed and lost <= MOST_LOST * n_words
    return (n_words, word_chars, n_symbols, dup, n_repeat, base_failed, kept, lost, *bad.values()), b"\n".join(good)


FIGURES = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("n_lost_words", pa.int64()), ("n_punctuation_lines", pa.int64()), ("n_navigation_lines", pa.int64()), ("n_boilerplate_lines", pa.int64()),
)


def figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of FIGURES for every row, with its id.

    Null and empty texts have no words, so the base rules reject them. Repeated rows each get
    a row, null ids stay null, other columns are ignored. Texts of any length are read whole.
    An empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *FIGURES])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x)[0] for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f[1]) for c, f in zip(zip(*rows) if rows else [[]] * len(FIGURES), FIGURES))], schema=schema)

    ddl = ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'bigint'}" for f in schema)
    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(judged, ddl)


def clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with df's own columns, whatever their names, and without their failing lines.

    Null and empty texts are rejected by the base rules; null ids and repeated rows are judged
    like others; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x) for x in text_bytes(batch.column(at))]
            keep = pa.array([f[6] for f, _ in found], pa.bool_())
            texts = pa.array([t.decode("utf-8", "replace") for _, t in found], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts).filter(keep)

    return df.mapInArrow(cleaned, df.schema)
