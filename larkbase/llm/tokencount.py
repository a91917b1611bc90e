"""Exact token counts at every prefix of a text, by dynamic programming.

The tokenizer drops white space, splits words into runs of letters, single digits and runs of other
characters, and closes each run with an end mark; a run's tokens depend on that run alone. Within a
run, byte-pair encoding has the property that a sequence of tokens is the encoding of its text just if
every neighbouring pair of them is the encoding of its own text. So the encoding of a prefix is that of
a shorter prefix with one token added: `last[i]`, the token that ends the encoding of the first i bytes,
is the one token t that ends there and fits behind `last[i - len(t)]`, and the count is one more than
there. One pass over a run gives the count at all its prefixes, open and closed by the end mark.

The count of a text's prefix is the count up to the start of its last word (running sums over words),
plus that of the word's earlier runs, plus that of the last run's prefix. All of these are stored, the
running sums for each text and the prefixes for each distinct run in one table for each task, so any
truncation or budget question is a lookup; nothing is encoded again.

Where a run can't be told without the tokenizer (combining marks, apostrophes, special strings,
characters that normal forms or newer versions of Unicode treat otherwise), the stretch of the word
between two safe cuts is encoded by the tokenizer itself at each prefix, once, and stored alike.

Defined cases: a null text is empty and has 0 tokens; words are split at ASCII white space, other
white space stays inside a word and is left to the tokenizer; special strings inside a text are
handled as the tokenizer does by default; other columns stay unless they have the names of what is
made here, which are replaced. Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from larkbase.llm.common import byte_characters, prepare_python, shared_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A task's table is emptied beyond this many prefixes; that costs time only.
TABLE_PREFIXES = 5_000_000
#: The tokenizer closes each run with this mark.
END_MARK = "</w>"
#: The quick way for words of Latin-1 letters, digits and ASCII signs: these letters are their own normal form.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[{LETTERS}0-9!-&(-;=-~]*")
RUNS = re.compile(rf"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Prefixes that are given to the tokenizer at once.
TOGETHER = 2048


class Merges:
    """Byte-pair encoding with an end mark, and the recurrence over prefixes. Symbols are strings of characters
    that stand for bytes; the last one of a closed run ends with the mark."""

    def __init__(self, vocabulary: list[str], merges: list[tuple[str, str]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        #: Whether a token can stand behind another (None: at the start of a run).
        self.fits: dict[str | None, dict[str, bool]] = {None: {}}
        self.halves: dict[str, tuple[str, str] | None] = {}
        # Tokens by their characters from the last one back: each node is [nodes below, open token, closed token].
        self.root: list = [{}, None, None]
        for token in vocabulary:
            closed = token.endswith(END_MARK) and token != END_MARK
            node = self.root
            for c in reversed(token[: -len(END_MARK)] if closed else token):
                node = node[0].setdefault(c, [{}, None, None])
            node[2 if closed else 1] = token
        # The run whose prefixes were counted last: its last tokens, and counts of open and closed prefixes.
        self.run, self.last, self.opened, self.closed = "", [None], [0], [0]

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END_MARK) and token != END_MARK:
            bare = token[: -len(END_MARK)]
            return [*bare[:-1], bare[-1] + END_MARK]
        return list(token)

    def encode(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """By definition: the pair of lowest rank is merged, until none has one. Also the pair merged last."""
        pair = None
        while len(symbols) > 1:
            ranked = [self.rank.get(p, len(self.rank)) for p in zip(symbols, symbols[1:], strict=False)]
            least = min(ranked)
            if least == len(self.rank):
                break
            out, i = [], 0
            while i < len(symbols):
                if i < len(ranked) and ranked[i] == least:
                    pair = (symbols[i], symbols[i + 1])
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols, pair

    def made_of(self, token: str) -> tuple[str, str] | None:
        """The two symbols that encoding a token's own text merges last into it; None for a single one. A token
        that its text is not encoded to is made of itself and nothing, which fits nowhere."""
        if token not in self.halves:
            found, pair = self.encode(self.symbols(token))
            self.halves[token] = pair if found == [token] else (token, "")
        return self.halves[token]

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one end of a token while it is made, each with the rank that ends it."""
        out, until = [], len(self.rank)
        while True:
            out.append((token, until))
            pair = self.made_of(token)
            if pair is None:
                return out
            token, until = pair[side], self.rank[pair]

    def fit(self, before: str | None, token: str) -> bool:
        """Whether the token can stand behind another, or at the start of a run: whether no two symbols that meet
        there, while both are made, would be merged first. Of equal pairs the left one is merged first."""
        whole = self.made_of(token) != (token, "")
        if whole and before is not None:
            rank, none, right = self.rank, len(self.rank), self.edge(token, 0)
            for x, ends in self.edge(before, 1):
                for y, till in right:
                    r = rank.get((x, y), none)
                    if r < ends and r <= till and r < none:
                        whole = False
        self.fits.setdefault(before, {})[token] = whole
        return whole

    def counts(self, run: str) -> list[int]:
        """Tokens of the closed run of each prefix, from the empty one. What is known of the run before that
        begins alike is kept, so that runs in order cost little."""
        same = 0
        for same, (a, b) in enumerate(zip(self.run, run, strict=False)):
            if a != b:
                break
        else:
            same = min(len(self.run), len(run))
        last, opened, closed = self.last[: same + 1], self.opened[: same + 1], self.closed[: same + 1]
        fits, root = self.fits, self.root
        for i in range(same + 1, len(run) + 1):
            node, j, open_, closing = root, i, None, None
            while j:
                j -= 1
                node = node[0].get(run[j])
                if node is None:
                    break
                t = node[1]
                if t is not None and open_ is None:
                    before = last[j]
                    ok = fits[before].get(t)
                    if self.fit(before, t) if ok is None else ok:
                        open_, count = t, opened[j] + 1
                        if closing is not None:
                            break
                t = node[2]
                if t is not None and closing is None:
                    before = last[j]
                    ok = fits[before].get(t)
                    if self.fit(before, t) if ok is None else ok:
                        closing = opened[j] + 1
                        if open_ is not None:
                            break
            if open_ is None or closing is None:
                raise LookupError(run)
            last.append(open_)
            opened.append(count)
            closed.append(closing)
            if open_ not in fits:
                fits[open_] = {}
        self.run, self.last, self.opened, self.closed = run, last, opened, closed
        return closed


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """L, N or O (letter, digit, other) of a character that runs can be told by; empty if the tokenizer has to."""
    low = c.lower()
    if c in "'<" or len(low) != 1 or 0x1160 <= ord(c) <= 0x11FF:
        return ""
    sorts = {(u.category(x)[0]) for u in (unicodedata, unicodedata.ucd_3_2_0) for x in (c, low)}
    if len(sorts) != 1 or (sort := sorts.pop()) in "MZC" or unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFC", low) != low:
        return ""
    return sort if sort in "LN" else "O"


def parts(word: str, specials: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """A word cut into stretches that the tokenizer handles each by itself: (lower-case run, True), and (stretch,
    False) where the runs can't be told."""
    if PLAIN.fullmatch(word):
        return [(r, True) for r in RUNS.findall(word.lower())]
    kinds = [kind(c) for c in word]
    inside = [False] * (len(word) + 1)
    for special in specials:
        at = word.find(special)
        while at >= 0:
            inside[at + 1 : at + len(special)] = [True] * (len(special) - 1)
            at = word.find(special, at + 1)
    # A cut is safe between two characters that are told, of other kinds or digits, and not inside a special string.
    cuts = [p for p in range(1, len(word)) if kinds[p - 1] and kinds[p] and (kinds[p - 1] != kinds[p] or kinds[p] == "N") and not inside[p]]
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
        told = all(kinds[a:b]) and not any(inside[a + 1 : b])
        out.append((word[a:b].lower() if told else word[a:b], told))
    return out


class PrefixTable:
    """Token counts of every prefix of each distinct run."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        found = json.loads(raw)
        self.specials = tuple(t["content"] for t in found["added_tokens"])
        self.merges = Merges(list(found["model"]["vocab"]), [tuple(m) for m in found["model"]["merges"]])
        self.characters = byte_characters()
        #: Counts at each prefix, in characters, of stretches that the tokenizer has to tell and of runs.
        self.prefixes: tuple[dict[str, array], dict[str, array]] = ({}, {})
        self.held = 0
        #: Tokens of whole words, by their UTF-8 bytes.
        self.whole: dict[bytes, int] = {}

    def of(self, text: str, told: bool) -> array:
        """Counts at each prefix of a part, from the empty one."""
        found = self.prefixes[told].get(text)
        if found is None:
            counts = self._of_run(text) if told else None
            if counts is None:
                counts = self._by_tokenizer(text)
            found = self.prefixes[told][text] = array("I", counts)
            self.held += len(counts)
        return found

    def _of_run(self, run: str) -> list[int] | None:
        raw = run.encode()
        try:
            counts = self.merges.counts("".join(map(self.characters.__getitem__, raw)))
        except LookupError:  # a byte that the vocabulary lacks
            return None
        if len(raw) == len(run):
            return counts
        ends = [i + 1 for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
        return [0, *(counts[e] for e in ends)]

    def _by_tokenizer(self, text: str) -> list[int]:
        out = [0]
        for at in range(1, len(text) + 1, TOGETHER):
            some = [text[:k] for k in range(at, min(at + TOGETHER, len(text) + 1))]
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def learn_bytes(self, kinds: set[bytes]) -> None:
        """Store distinct words with all prefixes."""
        if self.held > TABLE_PREFIXES:
            for own in (*self.prefixes, self.whole):
                own.clear()
            self.held = 0
        fresh = {raw: parts(raw.decode("utf-8", "replace"), self.specials) for raw in kinds if raw not in self.whole}
        # In order, as neighbours begin alike.
        for run in sorted({text for of in fresh.values() for text, told in of if told}):
            self.of(run, True)
        for raw, own in fresh.items():
            self.whole[raw] = sum(self.of(*part)[-1] for part in own)

    def at_prefixes(self, word: str) -> list[int]:
        """Counts at each prefix of a word, from the empty one."""
        out = [0]
        for part in parts(word, self.specials):
            before = out[-1]
            out += [before + n for n in self.of(*part)[1:]]
        return out

    def within(self, word: str, chars: int) -> int:
        """Tokens of the first `chars` characters of a word."""
        count = 0
        for part in parts(word, self.specials):
            if chars <= 0:
                break
            counts = self.of(*part)
            count += counts[min(chars, len(counts) - 1)]
            chars -= len(counts) - 1
        return count


@dataclass
class PrefixCounts:
    """Counts at all prefixes of one text: each word's first character, and the tokens up to its end."""

    table: PrefixTable
    text: str
    starts: list[int]
    through: list[int]

    @classmethod
    def of(cls, text: str, table: PrefixTable) -> PrefixCounts:
        found = running_counts(pa.array([text.encode("utf-8", "replace")]), table)
        return cls(table, text, found.starts.tolist(), found.through.tolist())

    def word(self, k: int) -> str:
        return WORD.match(self.text, self.starts[k]).group()

    def at(self, chars: int) -> int:
        """Tokens of the prefix of so many characters."""
        k = bisect_right(self.starts, chars - 1) - 1
        if k < 0:
            return 0
        before = self.through[k - 1] if k else 0
        return before + self.table.within(self.word(k), chars - self.starts[k])

    def all(self) -> list[int]:
        """The count at each prefix, from the empty one to the whole text."""
        out = [0] * (len(self.text) + 1)
        for k, start in enumerate(self.starts):
            before = self.through[k - 1] if k else 0
            own = self.table.at_prefixes(self.word(k))
            end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
            out[start + 1 : start + len(own)] = [before + n for n in own[1:]]
            out[start + len(own) : end + 1] = [before + own[-1]] * (end + 1 - start - len(own))
        return out

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix within the budget. Counts may fall as a word grows, so every
        word that begins within the budget is looked through from its end."""
        if not self.through or self.through[-1] <= budget:
            return len(self.text)
        first = bisect_right(self.through, budget)
        best = self.starts[first]
        for k in range(first, len(self.starts)):
            before = self.through[k - 1] if k else 0
            if before > budget:
                break
            own = self.table.at_prefixes(self.word(k))
            best = max(best, self.starts[k] + max(c for c, n in enumerate(own) if before + n <= budget))
        return best


@dataclass
class Running:
    """Words of many texts: the bounds of each text's words, each word's first character and the tokens up to its end."""

    bounds: np.ndarray
    starts: np.ndarray
    through: np.ndarray

    def totals(self) -> np.ndarray:
        ends = self.bounds[1:]
        return np.where(ends > self.bounds[:-1], self.through[np.maximum(ends, 1) - 1] if len(self.through) else 0, 0)


def running_counts(texts: pa.BinaryArray, table: PrefixTable) -> Running:
    """Running token counts over the words of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
    offsets = offsets - offsets[0]
    bytes_ = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], SPACES[bytes_], [True]])
    # Words end where texts do: a place between two texts counts as space on both sides.
    begins = ~space[1:-1] & space[:-2]
    ends = ~space[1:-1] & space[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = ~space[1:-1][inner]
    ends[inner - 1] = ~space[1:-1][inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    table.learn_bytes(set(words))
    counts = np.fromiter(map(table.whole.__getitem__, words), np.int64, len(words))
    bounds = np.searchsorted(first, offsets)
    sums = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # Characters are the bytes that don't continue one.
    chars = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])
    return Running(bounds, chars[first] - chars[offsets[owner]], sums[1:] - sums[bounds[:-1]][owner])


_tables: dict[str, PrefixTable] = {}


def prefix_table(digest: str, raw: bytes) -> PrefixTable:
    """One table for each worker process and tokenizer."""
    if digest not in _tables:
        _tables[digest] = PrefixTable(raw)
    return _tables[digest]


def count_tokens(docs: DataFrame, path: str, budget: int = 2048) -> DataFrame:
    """The documents with n_bytes, n_tokens, `fits_chars`, the length in characters of the longest prefix within
    the budget, and the running counts of every text: `word_starts` (characters) and `word_tokens`."""
    prepare_python(docs.sparkSession)
    local = shared_file(docs.sparkSession, path)
    made = StructType().add("n_bytes", LongType()).add("n_tokens", LongType()).add("fits_chars", LongType())
    made = made.add("word_starts", ArrayType(IntegerType())).add("word_tokens", ArrayType(IntegerType()))
    kept = [f for f in docs.schema.fields if f.name not in made.names and f.name != "_larkbase_text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = prefix_table(*local())
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            column = batch.column("_larkbase_text")
            found = running_counts(column.cast(pa.binary()), own)
            totals = found.totals()
            fits = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero(totals > budget).tolist():
                a, b = found.bounds[i], found.bounds[i + 1]
                fits[i] = PrefixCounts(own, column[i].as_py(), found.starts[a:b].tolist(), found.through[a:b].tolist()).longest(budget)
            ends = pa.array(found.bounds, pa.int32())
            columns = [pc.binary_length(column).cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(fits)]
            columns += [pa.ListArray.from_arrays(ends, pa.array(values, pa.int32())) for values in (found.starts, found.through)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *made.names])

    return docs.select(*(F.col(f"`{n}`") for n in names), F.coalesce("text", F.lit("")).alias("_larkbase_text")).mapInArrow(
        run, StructType([*kept, *made.fields])
    )


def prefix_tokens(counted: DataFrame, path: str, chars: str) -> DataFrame:
    """What `count_tokens` gave, with `prefix_tokens`, the tokens of the prefix of as many characters as column
    `chars` says (null: 0; beyond the end: the whole text): a lookup in the stored counts."""
    prepare_python(counted.sparkSession)
    local = shared_file(counted.sparkSession, path)
    kept = [f for f in counted.schema.fields if f.name != "prefix_tokens"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = prefix_table(*local())
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "word_starts", "word_tokens", chars)), strict=True)
            found = [PrefixCounts(own, t or "", s, n).at(min(k or 0, len(t or ""))) for t, s, n, k in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], [*names, "prefix_tokens"])

    return counted.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, StructType(kept).add("prefix_tokens", LongType()))
