"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is turned into a deterministic transducer over
characters.  Each transition carries the number of tokens it adds, so counting a
text is following one transition per character and adding the annotations.  The
transducer joins two machines:

* the splitter, which knows where the tokenizer's pattern ends a pretoken; its one
  look-ahead (white space before a word) and the contractions are held as pending
  characters of the state;
* the word machine, whose state is every start from which a vocabulary entry may
  still be completed, with the last token and the relative count at that start.
  The last token of a prefix is the only suffix token that may stand after the last
  token before it, which makes the machine deterministic and exact.

States and transitions are compiled when first met and kept per worker, under a
bound; beyond it the tables are emptied and built again, which changes no result.
White space after other text resets the splitter whatever came before, as do the ends of
plain words and of punctuation; the whole path from one reset to the next is kept as one
composed transition with its summed count.

Long texts are cut into chunks that are counted in different tasks.  A chunk's state
map is constant from its first reset on: it is stored as (text before the first reset, count
up to the last reset, text after it).  These maps compose associatively and are
combined by a prefix scan per text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import arrow_map, documents, loaded

# Characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
# The contractions that the pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PENDING = {c[:i] for c in CONTRACTIONS for i in range(1, len(c))}

START = ("start",)
CHUNK_CHARS = 32_768
MOST_TRANSITIONS = 400_000
MOST_PATHS = 800_000
LONGEST_PATH = 16

_RESET = re.compile(f"[^{WHITE}](?=[{WHITE}])")
# Where a path between resets may end besides: a run of Latin letters before another ASCII
# character, and ASCII punctuation other than the apostrophe before a letter or a blank.
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-&(-/:-@\\[-`{-~"
_PATH = re.compile(
    f"[{WHITE}]*[{_LATIN}]+(?=[{WHITE}!-@\\[-`{{-~]|\\Z)|[{WHITE}]*[{_MARKS}]+(?=[{WHITE}{_LATIN}]|\\Z)"
    f"|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def kind_of(ch: str) -> str:
    if ch in WHITE:
        return "white"
    return {"L": "letter", "N": "number"}.get(unicodedata.category(ch)[0], "other")


class _Row(dict):
    """Transitions out of one state; missing ones are compiled."""

    __slots__ = ("owner", "state")

    def __missing__(self, ch: str) -> tuple[int, int]:
        return self.owner.compile(self.state, ch)


class CountingTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normalisation are compiled")
        letters = byte_alphabet()
        plain = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(plain[a], plain[b]): i for i, (a, b) in enumerate(merges)}
        self.tokens = list(plain.values())
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for number, token in enumerate(self.tokens):
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][b]
            self.token_at[node] = number
        self.follows: dict[tuple[int, int], bool] = {}
        self._split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.paths: dict[str, int] = {}
        self._clear()

    # --- the word machine -----------------------------------------------------
    def _clear(self) -> None:
        self.word_ids: dict[tuple, int] = {}
        self.words: list[tuple] = []
        self.word_steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.state_ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.rows: list[_Row] = []
        self.size = 0
        self.empty = self._word(((0, -1, 0),))
        self.start = self._state(START)

    def _word(self, key: tuple) -> int:
        if key not in self.word_ids:
            self.word_ids[key] = len(self.words)
            self.words.append(key)
        return self.word_ids[key]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens by rank gives just these two tokens."""
        known = self.follows.get((a, b))
        if known is None:
            want = [self.tokens[a], self.tokens[b]]
            parts = [bytes([x]) for x in want[0] + want[1]]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), len(self.rank)), i))
                if (parts[best], parts[best + 1]) not in self.rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self.follows[a, b] = parts == want
        return known

    def _byte(self, word: int, b: int) -> tuple[int, int]:
        """The word state after one more byte, and the change of the word's token count."""
        if (word, b) in self.word_steps:
            return self.word_steps[word, b]
        alive, last, added = [], None, 0
        for node, before, relative in self.words[word]:
            child = self.trie[node].get(b)
            if child is None:
                continue
            token = self.token_at[child]
            if last is None and token >= 0 and (before < 0 or self._may_follow(before, token)):
                last, added = token, relative + 1
            if self.trie[child]:
                alive.append((child, before, relative))
        key = (*((n, t, r - added) for n, t, r in alive), (0, last, 0))
        self.word_steps[word, b] = out = self._word(key), added
        return out

    def _text(self, word: int, text: str) -> tuple[int, int]:
        added = 0
        for b in text.encode():
            word, more = self._byte(word, b)
            added += more
        return word, added

    # --- the splitter -----------------------------------------------------------
    def _state(self, key: tuple) -> int:
        if key not in self.state_ids:
            self.state_ids[key] = len(self.states)
            self.states.append(key)
            row = _Row()
            row.owner, row.state = self, self.state_ids[key]
            self.rows.append(row)
        return self.state_ids[key]

    def _begin(self, ch: str) -> tuple[tuple, int]:
        """A pretoken that starts with ``ch``."""
        if ch in PENDING:
            return ("apostrophe", ch), 0
        kind = kind_of(ch)
        if kind == "white":
            return ("white", self.empty, ch), 0
        word, added = self._text(self.empty, ch)
        return (kind, word), added

    def _step(self, key: tuple, ch: str) -> tuple[tuple, int]:
        state = key[0]
        if state == "start":
            return self._begin(ch)
        if state == "white":
            _, word, last = key
            if kind_of(ch) == "white":
                word, added = self._text(word, last)
                return ("white", word, ch), added
            if last == " ":  # the word takes the last blank with it
                word, added = self._text(self.empty, " " + ch)
                return (kind_of(ch), word), added
            _, added = self._text(self.empty, last)
            after, more = self._begin(ch)
            return after, added + more
        if state == "apostrophe":
            held = key[1] + ch
            if held in CONTRACTIONS:
                return START, self._text(self.empty, held)[1]
            if held in PENDING:
                return ("apostrophe", held), 0
            word, added = self._text(self.empty, "'")
            after = ("other", word)
            for c in held[1:]:
                after, more = self._step(after, c)
                added += more
            return after, added
        kind, word = key
        if kind_of(ch) == kind:
            word, added = self._text(word, ch)
            return (kind, word), added
        return self._begin(ch)

    def _finish(self, key: tuple) -> int:
        """Tokens of what is pending when the text ends here."""
        if key[0] == "white":
            return self._text(key[1], key[2])[1]
        if key[0] == "apostrophe":
            return self._text(self.empty, "'")[1] + (self._text(self.empty, key[1][1:])[1] if len(key[1]) > 1 else 0)
        return 0

    def compile(self, state: int, ch: str) -> tuple[int, int]:
        after, added = self._step(self.states[state], ch)
        self.rows[state][ch] = out = self._state(after), added
        self.size += 1
        return out

    # --- counting -----------------------------------------------------------
    def _run(self, text: str) -> int:
        """Tokens of a stretch without special tokens: the sum over its paths between resets."""
        paths, total = self.paths, 0
        for path in _PATH.findall(text):
            try:
                total += paths[path]
            except KeyError:
                n = self._path(path)
                total += n
                if len(path) <= LONGEST_PATH:
                    if len(paths) >= MOST_PATHS:
                        paths.clear()
                    paths[path] = n
        return total

    def _path(self, text: str) -> int:
        if self.size > MOST_TRANSITIONS or len(self.word_steps) > MOST_TRANSITIONS:
            self._clear()
        rows, state, total = self.rows, self.start, 0
        for ch in text:
            state, added = rows[state][ch]
            total += added
        return total + self._finish(self.states[state])

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string counts as that one token."""
        if self._split is None:
            return self._run(text)
        parts = self._split.split(text)
        return len(parts) - 1 + sum(self._run(p) for p in parts if p)

    # --- chunks ---------------------------------------------------------------
    def chunk_map(self, chunk: str) -> tuple[str, int, str, bool]:
        """(text before the first reset, tokens from there to the last reset, text after it, has one)."""
        first = _RESET.search(chunk)
        if first is None:
            return chunk, 0, "", False
        i = len(chunk) - 1
        while not (chunk[i] in WHITE and chunk[i - 1] not in WHITE):
            i -= 1
        return chunk[: first.end()], self.count(chunk[first.end() : i]), chunk[i:], True

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring stretches of text; associative."""
        (head, n, tail, reset), (head2, n2, tail2, reset2) = a, b
        if reset and tail and head2 and head2[0] in WHITE and tail[-1] not in WHITE:
            n, tail = n + self.count(tail), ""  # the seam itself is a reset
        if not reset:
            seam = _RESET.search(head + head2) if head and head2 and head2[0] in WHITE else None
            if seam is None or seam.end() != len(head):
                return head + head2, n2, tail2, reset2
            return (head, self.count(head2) + n2, tail2, True) if reset2 else (head, 0, head2, True)
        if not reset2:
            return head, n, tail + head2, True
        return head, n + self.count(tail + head2) + n2, tail2, True

    def scan(self, maps: list[tuple]) -> int:
        """Tokens of a text from the maps of its chunks, combined pairwise as a tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail, _ = maps[0]
        return self.count(head) + n + self.count(tail)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Exact token counts of whole texts under the byte-level BPE file ``vocabulary``.

    ``docs``: doc_id, text; other columns are ignored.  Returns one row per input row: doc_id, n_bytes,
    n_tokens, over_limit.  Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted
    each, null ids are kept, an empty table gives an empty result.  Texts longer than ``chunk_chars``
    are counted in chunks, which are dealt out over the cluster.
    """
    base = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = loaded(CountingTransducer, vocabulary)
        counts = [machine.count(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
        )

    long = F.length("text") > chunk_chars
    short = arrow_map(base.filter(~long), whole, "doc_id long, n_bytes long, n_tokens long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, size, text in zip(*(batch.column(c) for c in ("row", "doc_id", "n_bytes", "text"))):
                value = text.as_py()
                pieces = [value[i : i + chunk_chars] for i in range(0, len(value), chunk_chars)]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * k, pa.int64()), pa.array([doc.as_py()] * k, pa.int64()),
                     pa.array([size.as_py()] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(pieces, pa.string())],
                    ["row", "doc_id", "n_bytes", "chunk", "text"],
                )

    def maps(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = loaded(CountingTransducer, vocabulary)
        found = [machine.chunk_map(t) for t in batch.column("text").to_pylist()]
        kinds = (("head", pa.string()), ("n", pa.int64()), ("tail", pa.string()), ("reset", pa.bool_()))
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("row", "doc_id", "n_bytes", "chunk")]
            + [pa.array([m[i] for m in found], kind) for i, (_, kind) in enumerate(kinds)],
            ["row", "doc_id", "n_bytes", "chunk", *(name for name, _ in kinds)],
        )

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = loaded(CountingTransducer, vocabulary)
        counts = [
            machine.scan([(m["head"], m["n"], m["tail"], m["reset"]) for m in found])
            for found in batch.column("maps").to_pylist()
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
        )

    keys = "row long, doc_id long, n_bytes long, chunk int"
    chunks = (
        base.withColumn("row", F.monotonically_increasing_id()).filter(long)
        .mapInArrow(cut, f"{keys}, text string").repartition("row", "chunk")
    )
    composed = (
        arrow_map(chunks, maps, f"{keys}, head string, n long, tail string, reset boolean")
        .groupBy("row", "doc_id", "n_bytes")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "head", "n", "tail", "reset"))).alias("maps"))
    )
    folded = arrow_map(composed.select("doc_id", "n_bytes", "maps"), fold, "doc_id long, n_bytes long, n_tokens long")
    return short.unionByName(folded).withColumn("over_limit", F.col("n_tokens") > limit)
