"""Exact tokenization with the tokenizers library, each distinct piece of text once.

Two ways, both exact:

Units: a text is cut in front of each space, tab or line end that follows a character which is surely no white space. No
token of the supported tokenizers crosses such a place (their patterns admit white space only at the beginning of a
token), so the ids of a text are the ids of its units, one after the other. Numpy finds the cuts in the UTF-8 bytes,
Arrow's dictionary encoding finds equal units.

Pieces: texts of printable ASCII and Latin-1 letters alone, on which all versions of Unicode agree, are split here with
the tokenizer's own pattern, and the library's model merges each distinct piece once. Other texts go through encode().
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 8 << 20
#: Pieces that a worker remembers between batches; beyond it the table begins anew.
REMEMBERED = 600_000


def tokenizer_spec(path: str) -> str:
    """The tokenizer's file, read on the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_tokenizer(spec: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def text_slices(texts: pa.Array):
    """(first row, large binary array) pieces of about SLICE_BYTES, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_BYTES
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(first, np.r_[first[1:], n], strict=True):
        yield int(a), texts.slice(int(a), int(b - a))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary array and the offsets of its values, from 0."""
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return d, o - o[0]


def cuts(d: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin, ascending: at safe white space and at each document's first byte (empty documents: none)."""
    n = len(d)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    if n < 2:
        return begins
    space = (d == 32) | (d == 10) | (d == 9) | (d == 13)
    at = np.flatnonzero(space[1:]) + 1
    prev = d[at - 1]
    ok = (prev > 32) & (prev < 127)
    wide = np.flatnonzero((prev >= 0x80) & (at >= 3))
    if len(wide):
        p2, p3 = d[at[wide] - 2], d[at[wide] - 3]
        two = (p2 >= 0xC3) & (p2 <= 0xDF)
        more = (p2 >= 0x80) & (p2 < 0xC0) & ((p3 == 0xE0) | (p3 >= 0xE4) | ((p3 >= 0x80) & (p3 < 0xC0)))
        ok[wide] = two | more
    mark = np.zeros(n, bool)
    mark[at[ok]] = True
    mark[begins] = True
    return np.flatnonzero(mark)


def units_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of a large binary array, dictionary encoded, and how many units come before each value (one more entry)."""
    d, offsets = raw(texts)
    begin = cuts(d, offsets)
    count = np.searchsorted(begin, offsets, side="left")
    where = np.ascontiguousarray(np.r_[begin, len(d)].astype(np.int64))
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(where), pa.py_buffer(d)])
    return flat.dictionary_encode(), count


#: Characters outside the plain ones.
ODD = re.compile("[^ \\n\\t\\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: The split patterns of the tokenizer files (fixed values), with the character classes cut down to the plain path.
SPLITS = {
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+",
    "ByteLevel": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+",
}


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def plain_pattern(spec: str) -> tuple[str | None, bool]:
    """The split pattern for plain texts and whether texts are lower-cased; (None, False) for tokenizers of other forms."""
    parts = json.loads(spec)
    pre, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return SPLITS["ByteLevel"], False
    if pre.get("type") == "Sequence" and norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        first, last = pre["pretokenizers"][0], pre["pretokenizers"][-1]
        if last.get("type") == "ByteLevel" and not last.get("use_regex") and not last.get("add_prefix_space"):
            return SPLITS.get(first.get("pattern", {}).get("Regex")), True
    return None, False


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0]+1, ... of runs with these lengths, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


class Pieces(dict):
    """Piece -> row of its ids; a piece that is missing is merged by the library's model and added."""

    def __init__(self, model, end_id: int | None):
        self.model, self.letters = model, dict(enumerate(byte_letters()))
        self.ids, self.ends = array("I", [] if end_id is None else [end_id]), array("q", [0 if end_id is None else 1])

    def __missing__(self, piece: str) -> int:
        return self.put(piece, (t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))))

    def put(self, key, ids) -> int:
        row = self[key] = len(self.ends)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return row


class Encoder:
    """Encodes arrays of texts; remembers the ids of pieces that it has met, REMEMBERED at most."""

    def __init__(self, spec: str, end_id: int | None = None):
        self.tok, self.end_id = load_tokenizer(spec), end_id
        pattern, self.lower = plain_pattern(spec)
        self.find = re.compile(pattern, re.ASCII).findall if pattern else None
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.rows = Pieces(self.tok.model, end_id)

    def is_plain(self, text: str) -> bool:
        return self.find is not None and ODD.search(text) is None and not any(s in text for s in self.special)

    def encode(self, texts: pa.Array):
        """(first row, ids, ends of the documents in ids) for slices of a column of strings."""
        for first, piece in text_slices(texts):
            if len(self.rows) > REMEMBERED:
                self.rows = Pieces(self.tok.model, self.end_id)
            get, codes, counts = self.rows.__getitem__, [], []
            for i, text in enumerate(piece.cast(pa.large_string()).to_pylist()):
                if self.is_plain(text):
                    found = self.find(text.lower() if self.lower else text)
                    codes.append(np.fromiter(map(get, found), np.int64, len(found)))
                else:  # an integer key can't clash with a piece
                    codes.append(np.array([self.rows.put(i, self.tok.encode(text, add_special_tokens=False).ids)]))
                codes.append(END)
                counts.append(len(codes[-2]) + 1)
            table, stops = np.array(self.rows.ids, np.uint32), np.array(self.rows.ends, np.int64)
            code = np.concatenate(codes)
            start = np.where(code > 0, stops[code - 1], 0)
            lengths = stops[code] - start
            yield first, table[spread(start, lengths)], np.cumsum(lengths)[np.cumsum(counts) - 1]


#: Row 0 of Pieces: what ends a document.
END = np.zeros(1, np.int64)
_ENCODERS: dict = {}


def encoder(spec: str, end_id: int | None = None) -> Encoder:
    """One encoder for a worker process, kept between tasks."""
    key = (hash(spec), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, end_id)
    return _ENCODERS[key]
