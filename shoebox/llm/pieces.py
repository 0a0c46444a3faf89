"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A batch's distinct words, each with its leading mark, are sorted, which is the depth-first
order of their trie; the forward states of a word's prefix that the word before had too are
used again. With a vocabulary of log probabilities (unigram) ids are those of the best-scoring
segmentation. With one of merges (BPE) a step from one piece to the next is open or barred:
open if merging the two pieces' text by itself gives just these two. A segmentation whose
steps are all open is what merging the whole text gives, and every prefix has exactly one,
so the search's forward state is one piece for each prefix and the ids are those of the
merges. Characters outside the vocabulary become byte pieces, and decoding gives the text
back byte by byte.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.common import bounded_batches, text_bytes

#: The vocabulary that the queries and the pipeline use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker remembers, of at most so many characters each; the memory starts anew beyond.
KNOWN_WORDS, KNOWN_CHARS = 300_000, 256
#: Steps between pieces that a worker remembers as open or barred.
KNOWN_STEPS = 600_000
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Whether array("i") has the bytes that ids are stored as.
LITTLE = sys.byteorder == "little" and array("i").itemsize == 4
#: A word with the run of marks before it, a run of marks, a line feed: no piece crosses their borders.
UNIT = re.compile(r" *[^ \n]+| +|\n")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces with scores, read from a SentencePiece model file.

    Needs the pieces of all 256 bytes. The mark of a space is held as a space itself, so a
    text's own U+2581 is an ordinary unknown character. Pieces must not cross units' borders.
    """

    NORMAL, USER, BYTE = 1, 4, 6
    MERGES = 2

    def __init__(self, content: bytes):
        pieces, self.merges = [], False
        for number, value in _fields(content):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, self.NORMAL)))
            elif number == 2:
                self.merges = dict(_fields(value)).get(3) == self.MERGES
            elif number == 3 and dict(_fields(value)).get(2):
                raise ValueError("texts aren't normalized here, as the vocabulary asks")
        self.spelled = [b""] * len(pieces)
        self.byte = [-1] * 256
        self.trie: dict = {}
        self.pieces: dict[str, tuple[float, int]] = {}
        self.open: dict[int, bool] = {}
        self.unknown = min((s for _, s, kind in pieces if kind == self.NORMAL), default=0.0) - UNKNOWN_PENALTY
        for k, (piece, s, kind) in enumerate(pieces):
            if kind == self.BYTE:
                b = int(piece[1:-1], 16)
                self.byte[b], self.spelled[k] = k, bytes([b])
            elif kind == self.USER and self.merges:
                raise ValueError(f"piece {piece!r} is no merge")
            elif kind in (self.NORMAL, self.USER):
                text = piece.replace(MARK, " ")
                self.spelled[k] = text.encode()
                if not UNIT.fullmatch(text) or text == "\n":
                    raise ValueError(f"piece {piece!r} may cross a border of units")
                self.pieces[text] = (s, k)
                node = self.trie
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = (s, k)
        if min(self.byte) < 0:
            raise ValueError("the vocabulary has no byte pieces")

    def encode_units(self, units: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(unit, its ids as four bytes each), depth first through the trie of the sorted units."""
        before = ""
        best, start, piece = array("d", [0.0]), array("q", [0]), array("q", [-1])
        alive: list[list[tuple[int, dict]]] = [[]]
        step = self._merge_step if self.merges else self._step
        for unit in sorted(units):
            keep, most = 0, min(len(before), len(unit), KNOWN_CHARS)
            while keep < most and before[keep] == unit[keep]:
                keep += 1
            del best[keep + 1 :], start[keep + 1 :], piece[keep + 1 :], alive[keep + 1 :]
            on = alive[keep]
            for at in range(keep, len(unit)):
                on = step(unit[at], at, on, best, start, piece)
                if at < KNOWN_CHARS:
                    alive.append(on)
            before = unit
            yield unit, self._back(unit, start, piece)

    def _step(self, c: str, at: int, on: list, best: array, start: array, piece: array) -> list:
        """The forward score after one more character; on: pieces that have begun, with their places in the trie."""
        top, origin, kind, ahead, single = -1e300, at, -1, [], False
        for begun, node in (*on, (at, self.trie)):
            further = node.get(c)
            if further is not None:
                ahead.append((begun, further))
                end = further.get("")
                if end is not None:
                    single |= begun == at
                    if best[begun] + end[0] > top:
                        top, origin, kind = best[begun] + end[0], begun, end[1]
        if not single and best[at] + self.unknown > top:
            top, origin, kind = best[at] + self.unknown, at, -1
        best.append(top)
        start.append(origin)
        piece.append(kind)
        return ahead

    def _merge_step(self, c: str, at: int, on: list, best: array, start: array, piece: array) -> list:
        """The one piece that ends the prefix after one more character, among those that have begun: the step to it is open."""
        origin, kind, ahead, known = at, -1, [], self.open
        for begun, node in on:
            further = node.get(c)
            if further is not None:
                ahead.append((begun, further))
                if kind < 0 and (end := further.get("")) is not None:
                    pair = piece[begun] << 32 | end[1]
                    may = known.get(pair)
                    if may is None:
                        may = known[pair] = self._may_follow(piece[begun], end[1])
                    if may:
                        origin, kind = begun, end[1]
        alone = self.trie.get(c)
        if alone is not None:
            ahead.append((at, alone))
            if kind < 0 and (end := alone.get("")) is not None:  # where no longer piece ends it
                kind = end[1]
        start.append(origin)
        piece.append(kind)
        return ahead

    def _may_follow(self, before: int, now: int) -> bool:
        """Whether merging the text of the two pieces gives just them; -1 stands for a unit's beginning or an unknown character."""
        if before < 0:
            return self.merged(self.spelled[now].decode()) == [now]
        parts, score = list(self.spelled[before].decode()), self.pieces.get
        border = len(parts)  # the second piece's first part
        parts += self.spelled[now].decode()
        pairs = [score(x + y) for x, y in zip(parts, parts[1:])]
        while found := [(s[0], -k) for k, s in enumerate(pairs) if s]:
            k = -max(found)[1]
            if k == border - 1:
                return False
            border -= k < border
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1] + parts[k])
            if k < len(pairs):
                pairs[k] = score(parts[k] + parts[k + 1])
        return len(parts) == 2

    def merged(self, text: str) -> list[int]:
        """The pieces that merging a text of known characters gives: the best-scoring neighbours first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            found = [(self.pieces[both][0], -k) for k in range(len(parts) - 1) if (both := parts[k] + parts[k + 1]) in self.pieces]
            if not found:
                return [self.pieces[x][1] for x in parts]
            k = -max(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _back(self, unit: str, start: array, piece: array) -> bytes:
        ids, at = [], len(unit)
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids += [self.byte[b] for b in reversed(unit[start[at] : at].encode("utf-8", "surrogateescape"))]
            at = start[at]
        ids.reverse()
        return array("i", ids).tobytes() if LITTLE else np.array(ids, "<i4").tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text's bytes; the mark before the first word goes."""
        out = b"".join(map(self.spelled.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


class Encoder:
    """Encodes batches of texts and remembers words between them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """Each text's ids as four bytes each; the empty text has none."""
        cut = [UNIT.findall(" " + x.decode("utf-8", "surrogateescape")) if x else [] for x in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        if len(self.vocabulary.open) > KNOWN_STEPS:
            self.vocabulary.open.clear()
        fresh = {u for units in cut for u in units if u not in self.known}
        got = dict(self.vocabulary.encode_units(fresh))
        self.known.update((u, ids) for u, ids in got.items() if len(u) <= KNOWN_CHARS)
        found = self.known if all(len(u) <= KNOWN_CHARS for u in fresh) else self.known | got
        return [b"".join(map(found.__getitem__, units)) for units in cut]


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task."""
    if content not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content] = Encoder(Vocabulary(content))
    return _ENCODERS[content]


def _model(df: DataFrame, path: str) -> bytes:
    """The model file, half a MB that goes along with the tasks: from the driver's disk, or by Spark where the path names a store."""
    if "://" in path:
        return bytes(df.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text_col: str = "text", model: str = MODEL, into: str = "pieces") -> DataFrame:
    """df with a column of piece ids; null and empty texts have none. A column of that name is replaced."""
    bounded_batches(df.sparkSession)
    content, kept = _model(df, model), [c for c in df.columns if c != into]
    at = kept.index(text_col)
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            ids = encoder.encode(text_bytes(batch.column(at)))
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*kept, into])

    return df.mapInArrow(encoded, schema)


def decode(df: DataFrame, pieces_col: str = "pieces", model: str = MODEL, into: str = "decoded") -> DataFrame:
    """df with the text that the ids spell; null ids give null, no ids the empty text. A column of that name is replaced."""
    bounded_batches(df.sparkSession)
    content, kept = _model(df, model), [c for c in df.columns if c != into]
    at = kept.index(pieces_col)
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(content).vocabulary
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, into])

    return df.mapInArrow(decoded, schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per row: id, n_pieces, n_byte_pieces, ids_sha256 (over the ids as four bytes each, little-endian), decoded_sha256, round_trip.

    Null texts count as empty; repeated rows each get a row; other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    content = _model(df, model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        vocabulary = encoder.vocabulary
        is_byte = np.zeros(len(vocabulary.spelled), bool)
        is_byte[vocabulary.byte] = True
        for batch in batches:
            texts, rows = list(text_bytes(batch.column(1))), []
            for text, ids in zip(texts, encoder.encode(texts)):
                numbers = np.frombuffer(ids, "<i4")
                back = vocabulary.decode(numbers.tolist())
                rows.append((len(numbers), int(is_byte[numbers].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, list(schema)[1:]))], schema=schema)

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(tried, "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
