"""SentencePiece BPE encoding that keeps offsets, and decoding.

The text is normalised by longest-prefix replacement through the model's compiled
character map; every replacement remembers the original bytes it came from.  Blanks
become the model's visible blank and one blank is put in front.  The symbols are then
merged by score, and every piece is projected through the alignment to the byte span
of the original text that it covers.

Merges cannot cross a place where no vocabulary piece has the two neighbouring
characters side by side, so texts are cut there into units whose encodings are
remembered per worker under a bound.  The units of a long text are taken some at a
time, so a text needs a few times its own size in memory.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import arrow_map, carried, documents, loaded

BLANK = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

MOST_UNITS = 500_000
LONG_UNIT = 64  # symbols; beyond, joins are kept in a heap
LONG_TEXT = 1_000_000  # characters; beyond, units are taken so many at a time
AT_ONCE = 100_000  # units of a long text, or ids
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-/:-@\\[-`{-~"


def character_map(blob: bytes) -> dict[str, str]:
    """The replacements held in a precompiled map: a double-array trie, then zero-ended strings."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    strings = blob[4 + size :]
    out: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        node, key = todo.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if unit >> 8 & 1:  # has a value at its zero child
            at = units[base] & 0x7FFFFFFF
            out[key.decode()] = strings[at : strings.index(b"\0", at)].decode()
        for b in range(1, 256):
            child = base ^ b
            if child < len(units) and units[child] & 0x800000FF == b:
                todo.append((child, key + bytes([b])))
    return out


class Encoded(dict):
    """Units with their encodings: missing ones are made, short ones kept, under a bound."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        made = self.make(unit, None if unit.isascii() else [len(c.encode()) for c in unit])
        if len(unit) <= 16:
            if len(self) >= MOST_UNITS:
                self.clear()
            self[unit] = made
        return made


class PieceModel:
    """A BPE model: normalising, encoding with original byte spans, decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are encoded here")
        norm = model.normalizer_spec
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this way of treating blanks is not built")
        self.prefix = norm.add_dummy_prefix
        self.map = character_map(norm.precompiled_charsmap)
        self.longest = max(map(len, self.map), default=0)
        self.starts: tuple[dict, set] | None = None
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined symbols are not built")
        scores = sorted({score for _, score in self.pieces.values()}, reverse=True)
        place = {score: i for i, score in enumerate(scores)}
        self.order = {piece: place[score] for piece, (_, score) in self.pieces.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
            else b"" if p.type == CONTROL
            else model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN
            else p.piece.replace(BLANK, " ").encode()
            for p in model.pieces
        ]
        self.units = self._units()
        self.known = Encoded(self._unit)

    # --- normalising ------------------------------------------------------------
    def _starts(self, entries: dict[str, str]) -> set[str]:
        """The characters that entries of the map begin with."""
        if self.starts is None or self.starts[0] is not entries:
            self.starts = entries, {k[0] for k in entries}
        return self.starts[1]

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and the original bytes behind each of its characters.

        At every place the longest entry of the character map that starts there is
        replaced; other characters stay.  A replacement's first character answers for
        all its original bytes; original bytes that are replaced by nothing go to the
        character before them.  None in place of the sizes: no entry of the map starts in the text, every character is its own.
        """
        if not self.map or self._starts(self.map).isdisjoint(text):
            return text, None
        out, sizes, i = [], [], 0
        while i < len(text):
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if text[i : i + n] in self.map:
                    found, size = self.map[text[i : i + n]], len(text[i : i + n].encode())
                    break
            else:
                n, found, size = 1, text[i], len(text[i].encode())
            if found:
                out.append(found)
                sizes += [size] + [0] * (len(found) - 1)
            elif sizes:
                sizes[-1] += size
            i += n
        return "".join(out), sizes

    # --- encoding ------------------------------------------------------------
    def _units(self) -> re.Pattern:
        """Cuts a text only where no vocabulary piece has the two neighbouring characters in it."""
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            return re.compile(r"(?s).+")
        mixed = any(re.search(f"[{LATIN}][{MARKS}]|[{MARKS}][{LATIN}]", p) for p in self.pieces)
        line = any("\n" in p for p in self.pieces if len(p) > 1)
        plain = "" if mixed else (
            f"[ {BLANK}]*[{LATIN}]+(?=[ {BLANK}{MARKS}]|\\Z)|[ {BLANK}]*[{MARKS}]+(?=[ {BLANK}{LATIN}]|\\Z)|"
        )
        if line:
            return re.compile(f"{plain}[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")
        plain = plain.replace("(?=[", "(?=[\n")
        return re.compile(f"{plain}[ {BLANK}]*[^ {BLANK}\n]+|[ {BLANK}]+|\n")

    def _merge(self, symbols: list[str]) -> list[str]:
        """Join neighbours by score, the leftmost first among equals, until no join is a piece."""
        if len(symbols) > LONG_UNIT:
            return self._merge_long(symbols)
        order, none = self.order, len(self.pieces)
        ranks = [order.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = order.get(symbols[i] + symbols[i + 1], none)
            if i:
                ranks[i - 1] = order.get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same for units without end: joins wait in a heap, and symbols are linked, so a join costs a logarithm.

        A join waits as one number, its rank before its place; it holds if the two symbols at that place still have that rank.
        """
        order, n = self.order, len(symbols)
        wide = n.bit_length()
        after, before = array("i", [*range(1, n), -1]), array("i", range(-1, n - 1))
        heap = [
            rank << wide | i for i, rank in enumerate(map(order.get, map(str.__add__, symbols, islice(symbols, 1, None)))) if rank is not None
        ]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            rank = order.get(symbols[i] + symbols[j])
            if rank is not None:
                heapq.heappush(heap, rank << wide | i)

        while heap:
            first = heapq.heappop(heap)
            i = first & (1 << wide) - 1
            j = after[i]
            if j < 0 or order.get(symbols[i] + symbols[j]) != first >> wide:
                continue  # one of the two has been joined since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            after[j] = -2
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in symbols if x]

    def _unit(self, unit: str, sizes: list[int] | None) -> bytes:
        """Each id of one unit with its original byte length, as packed 32-bit integers; ``sizes`` None: a byte a character."""
        pairs, at, pieces = array("i"), 0, self.pieces
        for piece in self._merge(list(unit.replace(" ", BLANK))):
            end = at + len(piece)
            size = end - at if sizes is None else sum(sizes[at:end])
            at = end
            found = pieces.get(piece)
            if found is not None:
                pairs.extend((found[0], size))
            elif self.byte_ids:
                *most, last = [self.byte_ids[b] for b in piece.encode()]
                for i in most:
                    pairs.extend((i, 0))
                pairs.extend((last, size))  # the last byte answers for the character
            else:
                pairs.extend((self.unknown, size))
        return pairs.tobytes()

    def _cut(self, text: str) -> Iterator[list[str]]:
        """The units of a text, all at once or, of a long text, ``AT_ONCE`` at a time."""
        if len(text) <= LONG_TEXT:
            yield self.units.findall(text)
            return
        found = self.units.finditer(text)
        while some := [m[0] for m in islice(found, AT_ONCE)]:
            yield some

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the end of each piece in bytes of the original text."""
        if not text:
            return np.empty(0, "<i4"), np.empty(0, "<i4")
        normal, sizes = self.normalise(text)
        if self.prefix:
            normal, sizes = " " + normal, None if sizes is None else [0, *sizes]
        lead = int(self.prefix and sizes is None)
        ids, ends, at, end = [], [], 0, -lead
        for units in self._cut(normal):
            if sizes is None:
                made = map(self.known.__getitem__, units)
            else:
                made = []
                for unit in units:
                    made.append(self._unit(unit, sizes[at : at + len(unit)]))
                    at += len(unit)
            pairs = np.frombuffer(b"".join(made), "<i4").reshape(-1, 2)
            ids.append(pairs[:, 0].copy())
            ends.append(end + np.cumsum(pairs[:, 1], dtype=np.int64))
            end = int(ends[-1][-1])
            ends[-1] = np.maximum(ends[-1], 0).astype("<i4")
        return np.concatenate(ids), np.concatenate(ends)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; the blank put in front is taken off again."""
        surface, ids = self.surface, np.asarray(ids)
        raw = b"".join(b"".join(map(surface.__getitem__, ids[at : at + AT_ONCE].tolist())) for at in range(0, len(ids), AT_ONCE))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model: str, carry: tuple = ()) -> DataFrame:
    """Encode whole texts with the BPE model file and decode them again.

    ``docs``: doc_id, text; other columns are ignored unless ``carry`` names them.  Returns one row per input row: doc_id, n_bytes,
    ids, ends (the end of each piece's span in bytes of the original text; it starts where the
    one before ends), decoded.  Null and empty texts have no pieces and decode to the empty
    text.  Repeated rows are encoded each, null ids are kept, an empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = loaded(PieceModel, model)
        ids, ends, texts = [], [], []
        for text in batch.column("text").to_pylist():
            i, e = machine.encode(text)
            ids.append(i)
            ends.append(e)
            texts.append(machine.decode(i))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32())

        def lists(parts: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(np.int32)))

        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), lists(ids), lists(ends), pa.array(texts, pa.string()), *map(batch.column, carry)],
            ["doc_id", "n_bytes", "ids", "ends", "decoded", *carry],
        )

    base = documents(docs, *(c for c in carry if c != "text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return arrow_map(base, work, carried("doc_id long, n_bytes long, ids array<int>, ends array<int>, decoded string", base, carry))


def with_spans(encoded: DataFrame) -> DataFrame:
    """Adds ``spans``: an array of (id, begin, end) in bytes of the original text."""
    starts = F.transform("ends", lambda e, i: F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0)))
    return encoded.withColumn("spans", F.arrays_zip(F.col("ids").alias("id"), starts.alias("begin"), F.col("ends").alias("end")))
