"""Packing of tokenized documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

A document's ids are cut into pieces of `size` ids and a rest. Pieces are dealt to groups by a hash; in each group they
are taken by decreasing length and put into the first bin with room, which a tournament tree over the bins' room finds
in log time. Only piece lengths and checksums are shuffled, never texts or ids. A group holds GROUP_DOCS documents' pieces
on average whatever the input's size, so its memory doesn't grow with the input; repeated rows are dealt to groups apart.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as they occur. A null doc_id
passes through. Other columns aren't read. Texts of any length are encoded whole, long runs of blanks too.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, id_text, table, tune

SIZE = 2048
END_ID = 1
GROUP_DOCS = 4000
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pre-tokenizing pattern of byte-level vocabularies (what the library's ByteLevel splits by).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker remembers the ids of about so many words of at most so many characters; then it starts anew.
KNOWN_WORDS, KNOWN_CHARS = 1_000_000, 64
_encoders: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte that prints as itself, the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids by the tokenizers library, its model asked once for each distinct word.

    A byte-level model merges inside words only, so a text's ids are its words' ids one after the other. Texts that hold an
    added token, and files of any other make, go through the library whole.
    """

    def __init__(self, path: str):
        import regex
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        model = made.get("model") or {}
        self.by_word = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.words, self.known = regex.compile(PATTERN).findall, _Known(self.whole.model)
        # Where they mean the same, the standard library's classes do, in half the time: not in texts with _, with numbers
        # that aren't digits, with separators that only the standard library counts as white space, or beyond 16 bits.
        self.plain_words = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s\w]").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall
        self.odd = re.compile("[_\x1c-\x1f" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("No", "Nl")) + "\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> bytes:
        """The ids, each in four little-endian bytes."""
        if not self.by_word or any(x in text for x in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        words = self.words if self.odd(text) else self.plain_words
        return b"".join(map(self.known.__getitem__, words(text)))


class _Known(dict):
    """Ids of words; what isn't there is asked of the model, and kept if it is short."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = [x.id for x in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= KNOWN_CHARS:
            self[word] = ids
        return ids


def encoder(path: str | None = None) -> Encoder:
    """The encoder of a tokenizers file, made once a worker."""
    if path not in _encoders:
        if path is None:
            import public_tokenizers

            _encoders[path] = Encoder(str(public_tokenizers.path(TOKENIZER)))
        else:
            _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of size."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array(end_id, "<u4").tobytes()
        for b in batches(rows):
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = encode(text or "") + last
                n = len(raw) // 4
                for start in range(0, n, size):
                    end = min(n, start + size)
                    for c, v in zip(out, (doc, start, end - start, zlib.crc32(raw[4 * start : 4 * end]), n), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Bins:
    """First fit by a tournament tree: each inner node holds the greatest room below it."""

    def __init__(self, size: int, most: int):
        self.size, self.n, self.leaves = size, 0, 1 << max(0, (max(1, most) - 1).bit_length())
        self.room = [size] * (2 * self.leaves)  # unopened bins have full room and stand after the open ones

    def put(self, length: int) -> tuple[int, int]:
        """The first bin with room for length, and the offset there."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        at, offset = i - self.leaves, self.size - room[i]
        room[i] -= length
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        self.n = max(self.n, at + 1)
        return at, offset


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, which are taken as they stand: sort them first."""
    bins = Bins(size, len(lengths))
    put = [bins.put(int(n)) for n in lengths]
    return np.array([x[0] for x in put], np.int64), np.array([x[1] for x in put], np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The pieces with sequence_id and offset. Sequence ids are unique, not dense: the group's number times 2^32 plus the bin's."""
    tune(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offset = first_fit_decreasing(t.column("length").to_numpy(), size)
        base = t.column("grp")[0].as_py() << 32
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array(at + base)).append_column("offset", pa.array(offset))

    cut = pieces(docs, id_col, text_col, size, end_id, tokenizer)
    # Equal rows are counted and numbered, so that many of them are dealt apart, and alike if a task runs again.
    own = cut.groupBy(*cut.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    dealt = own.select(*cut.columns, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
