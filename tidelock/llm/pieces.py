"""Exact encoding with a public tokenizer at the price of one dictionary look-up a word.

Encoding a text costs about half a microsecond a byte. A text may be cut before a blank or line feed whose next character
is no white space, and before ASCII punctuation that follows a letter or digit: the splitting expressions of the two
supported kinds of tokenizer look only forward, no match of theirs runs past such a place, and the one look-ahead
(`\\s+(?!\\S)`) gives the same tokens for what stands before it. Neither does Unicode composition cross these places. So
the ids of a text are the ids of its pieces, one after another. Equal pieces of a chunk are encoded once, and those that
are seen again later are kept. Where a tokenizer lower-cases and drops white space, so do the pieces (ASCII only).
Tokenizers of another kind get whole texts.
"""

from __future__ import annotations

import ctypes
import json
import os

import numpy as np
import pyarrow as pa

#: Pieces kept by a worker, and bytes of text that are worked on at once.
KEPT_PIECES = 300_000
CHUNK_BYTES = 4 << 20
#: New pieces that are encoded in one call.
MARKED_PIECES = 100

_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer is one of the kinds for which cutting before blanks is exact."""
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel":
        return norm is None and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    parts = [p.get("type") for p in pre.get("pretokenizers", [])]
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed"


# Bytes that may begin a white space character, or a control character that some library takes for one.
_BLANKISH = np.zeros(256, bool)
_BLANKISH[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
# Second bytes, after 0xC3, of Latin letters.
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_FOLD = np.array([32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column without nulls."""
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None and len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(col: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row) of runs of rows with about so many bytes; a longer text is a run of its own."""
    _, offsets = column_bytes(col)
    at, n = 0, len(col)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(self.tokenizer.to_str())
        self.split = _cuts_at_spaces(spec)
        self.folds = self.split and spec.get("normalizer") is not None
        # A special token parts a text into segments that are encoded each by itself: many pieces in one call.
        marks = [t for t in spec["added_tokens"] if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.mark, self.mark_id = (marks[0]["content"], marks[0]["id"]) if marks else (None, None)
        self.seen = np.zeros(1 << 23, bool)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.kept_ids = 0
        if 4 * np.count_nonzero(self.seen) > len(self.seen):  # too full to tell new pieces from old
            self.seen[:] = False

    def _slots_of(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in starts and lengths. Pieces met for the first time are dropped at the next call."""
        if len(self.slots) > KEPT_PIECES:
            self._forget()
        slots, base = self.slots, len(self.slots)
        self.starts, self.lengths, self.ids = self.starts[:base], self.lengths[:base], self.ids[: self.kept_ids]
        found = np.fromiter((slots.get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            place = np.fromiter((hash(pieces[i]) for i in missing), np.int64, len(missing)) & (len(self.seen) - 1)
            again = self.seen[place]
            self.seen[place] = True
            missing = np.concatenate([missing[again], missing[~again]])
            new, n = [pieces[i] for i in missing], int(again.sum())
            ids, lengths = self._encode_new(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.kept_ids = len(self.ids) + int(lengths[:n].sum())
            self.ids = np.concatenate([self.ids, ids])
            slots.update(zip(new[:n], range(base, base + n), strict=True))
            found[missing] = np.arange(base, base + len(new))
        return found

    def _encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces and their numbers."""
        ids, lengths = [], []
        for at in range(0, len(new), MARKED_PIECES):
            part = new[at : at + MARKED_PIECES]
            text = self.mark.join(part) if self.mark else ""
            if self.mark and all(text.count(s) == (len(part) - 1 if s == self.mark else 0) for s in self.specials):
                self.tokenizer.encode_special_tokens = False  # here, and here alone, the mark is a token
                got = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                self.tokenizer.encode_special_tokens = True
                marks = np.flatnonzero(got == self.mark_id)
                lengths.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
                ids.append(np.delete(got, marks))
            else:
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
                ids.append(np.fromiter((i for x in each for i in x), np.int32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (int32) of all texts of a column without nulls, and offsets (int64) of each text's ids."""
        n = len(col)
        data, offsets = column_bytes(col)
        if not n or offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if not self.split:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            return np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1])), ends
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if self.folds:
            data = _FOLD[data]
        sep = (data[:-1] == 32) | (data[:-1] == 10)
        sep &= ~_BLANKISH[data[1:]]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = sep
        mark = _PUNCT[data[1:]] & (_ALNUM[data[:-1]] | _LATIN[data[:-1]])
        latin = np.flatnonzero(mark & ~_ALNUM[data[:-1]])
        mark[latin] = data[latin - 1] == 0xC3  # a byte of 0x80 and above is never the first of a text
        cut[1:-1] |= mark
        cut[offsets] = True  # a blank at the end of a text stands before the next text: those cuts are there anyway
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last = ends[(data[ends] == 32) | (data[ends] == 10)]  # no character follows it in its own text
        cut[last[~np.isin(last, offsets)]] = False
        bounds = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        slot = self._slots_of(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[slot]
        done = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(done[-1], dtype=np.int32) + np.repeat((self.starts[slot] - done[:-1]).astype(np.int32), lengths)
        return self.ids[at], done[np.searchsorted(bounds, offsets)]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    return np.insert(ids, offsets[1:], np.int32(end_id)), offsets + np.arange(len(offsets))


def give_back() -> None:
    """Return memory that Arrow and the C library hold but no longer use: idle workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def released(batches):
    """The batches; memory is given back after each."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def filled(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The column as one array, null texts as empty ones."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null("") if col.null_count else col
