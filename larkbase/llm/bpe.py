"""Byte-pair encoding and decoding through a table of distinct words.

Spark splits each text, on the JVM side, into words that no token can span: a run of white space
with the run of other characters after it. Each block of documents has a table of its distinct
words, every one of which is encoded once; the ids of a text are then joined back by position, as a
gather over the words' codes. Decoding joins ids to their pieces in the same way and joins the
bytes. There is one table for each task rather than one for the whole corpus, because the tokens of
a global table would have to be moved to the texts: at about a tenth of all words being distinct,
that moves more than the whole input, while encoding a word again in another task costs about
two microseconds. Nothing is shuffled.

Words are cut only where a character that Unicode never calls white space meets one that it does,
so the tokenizer's own pattern, with its lookahead at white space, sees the same context in a word
as in the whole text; special strings contain no white space and stay within a word.

Defined cases: a null text is empty and has no tokens; unknown ids cannot occur, since the
vocabulary covers all bytes; decoding replaces invalid UTF-8 as the library does; other columns
stay unless they are called ids, n_tokens, round_trip or decoded, which are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from larkbase.llm.common import byte_characters, prepare_python, shared_file, tidy

#: The code points with the Unicode property White_Space, as a character class.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
WORDS = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
SPACES = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
#: Words that are encoded as one text.
JOINED = 256
#: A task's table is emptied beyond this many words; that costs time only.
TABLE_WORDS = 200_000


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


class Codec:
    """A tokenizer's file with a table of distinct words and a table of pieces."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(raw)
        chars = {c: b for b, c in enumerate(byte_characters())}
        self.pieces: dict[int, bytes] = {i: bytes(chars[c] for c in piece) for piece, i in model["model"]["vocab"].items()}
        for special in model["added_tokens"]:
            self.pieces[special["id"]] = special["content"].encode()
        self.lengths = np.zeros(max(self.pieces, default=-1) + 1, np.int64)
        self.lengths[list(self.pieces)] = list(map(len, self.pieces.values()))
        self.decimal = list(map(str, range(len(self.lengths))))
        self.at: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.decimals: list[str] = []
        self.decoded: list[bytes] = []

    def rows(self, words: list[str]) -> list[int]:
        """Row of each distinct word in the table; new ones are encoded, and their ids joined to pieces, once."""
        if len(self.at) > TABLE_WORDS:
            for column in (self.at, self.ids, self.decimals, self.decoded):
                column.clear()
        fresh = [w for w in words if w not in self.at]
        # Lists of numbers make no cycles, and looking for them takes longer than making them.
        collecting = gc.isenabled()
        gc.disable()
        try:
            for start in range(0, len(fresh), 4096):
                part = fresh[start : start + 4096]
                found = self.encode_words(part)
                self.at.update(zip(part, range(len(self.ids), len(self.ids) + len(part)), strict=True))
                self.ids.extend(found)
                self.decimals.extend(",".join(map(self.decimal.__getitem__, ids)) for ids in found)
                self.decoded.extend(b"".join(map(self.pieces.__getitem__, ids)) for ids in found)
        finally:
            if collecting:
                gc.enable()
        return [self.at[w] for w in words]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Words that begin with white space and end without are encoded `JOINED` at a time, as one
        text, which cuts them apart as any text's; the bytes of the pieces tell whose an id is. Should they not add up
        to the words, as with a tokenizer that changes text, each word is encoded by itself."""
        whole = [w[0] in SPACES and w[-1] not in SPACES for w in words]
        inner = list(compress(words, whole))
        groups = [inner[at : at + JOINED] for at in range(0, len(inner), JOINED)]
        found: list[list[int]] = []
        for group, made in zip(groups, self.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            ids = made.ids
            reached = np.cumsum(self.lengths[np.array(ids, np.int64)])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, group)), np.int64, len(group)))
            last = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[last] == ends).all():
                cuts = (last + 1).tolist()
                found.extend(ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False))
            else:
                found.extend(self.encode_each(group))
        others = iter(self.encode_each([w for w, inside in zip(words, whole, strict=True) if not inside]))
        inside = iter(found)
        return [next(inside if is_inside else others) for is_inside in whole]

    def encode_each(self, words: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[int]:
        """Ids of one text from its words, by position."""
        at = dict(zip(kinds := list(dict.fromkeys(words)), self.rows(kinds), strict=True))
        return [i for w in words for i in self.ids[at[w]]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class Block:
    """The words of a batch of texts as rows of the table of distinct words, by position."""

    def __init__(self, words: pa.ListArray, codec: Codec):
        self.codec = codec
        flat = words.flatten().dictionary_encode()
        rows = np.array(codec.rows(flat.dictionary.to_pylist()), dtype=np.int64)
        self.codes = rows[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        offsets = words.offsets.to_numpy()
        self.offsets = offsets - offsets[0]
        self.kinds = np.unique(rows)
        lengths = np.zeros(len(codec.ids), dtype=np.int64)
        lengths[self.kinds] = [len(codec.ids[r]) for r in self.kinds.tolist()]
        self.lengths = lengths
        running = np.concatenate([[0], np.cumsum(lengths[self.codes])])
        #: Where each text's ids begin, and where the last one's end.
        self.bounds = running[self.offsets]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> Iterator[list[int]]:
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield self.codes[a:b].tolist()

    def id_arrays(self) -> pa.ListArray:
        """The ids of each text: a gather from the ids of the distinct words."""
        starts = np.zeros(len(self.lengths), dtype=np.int64)
        starts[self.kinds] = np.concatenate([[0], np.cumsum(self.lengths[self.kinds])[:-1]]) if len(self.kinds) else []
        flat = np.fromiter(chain.from_iterable(self.codec.ids[r] for r in self.kinds.tolist()), np.int32)
        each = self.lengths[self.codes]
        shift = starts[self.codes] - (np.cumsum(each) - each)
        return pa.ListArray.from_arrays(pa.array(self.bounds, pa.int32()), pa.array(flat[np.repeat(shift, each) + np.arange(each.sum())]))


#: Bytes of the words of a block: the more texts share its distinct words, the fewer look-ups there are.
BLOCK_BYTES = 32 << 20


def gathered(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `size` bytes, or larger where they come so."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_codecs: dict[str, Codec] = {}


def codec(digest: str, raw: bytes) -> Codec:
    """One codec for each worker process and tokenizer."""
    if digest not in _codecs:
        _codecs[digest] = Codec(raw)
    return _codecs[digest]


def _others(df: DataFrame, *made: str) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in made])


def encode(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """The documents, without their text if it isn't to be kept, with `ids` (array of int), `n_tokens` and `round_trip`, whether decoding the ids
    gives the text again."""
    prepare_python(docs.sparkSession)
    local = shared_file(docs.sparkSession, path)
    made = ["ids", "n_tokens", "round_trip"]
    kept = _others(docs, *made, *([] if keep_text else ["text"]))
    names = [f.name for f in kept.fields]
    out = StructType(list(kept.fields)).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("round_trip", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*local())
        # Ids and texts are held at once, so a block is smaller here.
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            words = batch.column("_larkbase_words")
            block = Block(words, own)
            ids = block.id_arrays()
            # Decoded from the ids themselves, and compared with what was split.
            texts = [own.decode(i) for i in np.split(ids.values.to_numpy(), block.bounds[1:-1])] if len(ids) else []
            same = pc.equal(pa.array(texts, pa.string()), pc.binary_join(words, ""))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), ids, pa.array(block.counts()), same], [*names, *made]
            )

    words = split_words(F.col("text")).alias("_larkbase_words")
    return docs.select(*(F.col(f"`{n}`") for n in names), words).mapInArrow(tidy(run), out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with `decoded`, the text of their `ids` (null: empty)."""
    prepare_python(encoded.sparkSession)
    local = shared_file(encoded.sparkSession, path)
    kept = _others(encoded, "decoded")
    names = [f.name for f in kept.fields]
    out = StructType(list(kept.fields)).add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*local())
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(tidy(run), out)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and hash in one pass, so that
    neither ids nor texts leave the worker."""
    prepare_python(docs.sparkSession)
    local = shared_file(docs.sparkSession, path)
    names = [f.name for f in docs.schema.fields if f.name == "doc_id"]
    out = StructType([f for f in docs.schema.fields if f.name == "doc_id"])
    out = out.add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*local())
        for batch in gathered(batches):
            block = Block(batch.column("_larkbase_words"), own)
            ids_sha, text_sha = [], []
            for rows in block.texts():
                ids_sha.append(hashlib.sha256(",".join(map(own.decimals.__getitem__, rows)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(own.decoded.__getitem__, rows))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(block.counts()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", split_words(F.col("text")).alias("_larkbase_words")).mapInArrow(run, out)
