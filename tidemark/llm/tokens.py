"""Token ids of whole texts from a `tokenizers` file, with bounded caches of pieces.

A text is cut only where its tokenizer would cut it too, so the ids equal those of one call over
the whole text. Each distinct piece is encoded by the library once while it stays in the cache.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters but one (U+0130) whose lower case is two characters.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A space before a printable character that no Unicode version counts as white space.
_SAFE_GAP = re.compile("(?=(?<=[!-~\u00c0-\u024f]) [!-~\u00c0-\u024f])")
#: Every white space but space and new line.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\u180e", "\u200b", "\ufeff", "\x01"]
#: White space for Python and none for tokenizers.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space next to white space, or of a kind that tokenizers and Arrow may see differently.
_CAREFUL = "[ \\n][ \\n]|[\\x01\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_PAIRS = ["  ", " \n", "\n ", "\n\n"]
#: A comma or stop that may stand in one piece with what is before it.
_BARE = re.compile(f"(?<![{_LETTER}0-9])[,.]")
_WORD = re.compile(f" ?[{_LETTER}]+")
#: Byte-level BPE writes byte b as a printable character: itself, or the next free one from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = dict(zip(sorted(set(range(256)) - set(_PLAIN)), range(256, 512)))
#: A longer piece goes to the library each time and is not kept.
_LONG = 80


def pieces(text: str) -> list[str]:
    """text cut into parts that byte-level and word BPE encode one by one as in the whole.

    Cuts are made before white space that follows none, after a new line, and before a comma or stop that follows a
    letter or digit: places where such tokenizers always end a piece.
    """
    for c in _ODD:
        if c in text:
            return _SAFE_GAP.split(text)
    for c in _PAIRS:
        if c in text:
            return _SAFE_GAP.split(text)
    if not _BARE.search(text):
        text = text.replace(",", "\x01,").replace(".", "\x01.")
    return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")


def words(text: str) -> list[str]:
    """text cut into parts that a tokenizer which lowers case and drops white space encodes one by one.

    Such a tokenizer always ends a piece at white space, and at a comma or stop after a letter or digit.
    """
    try:
        text.encode("latin-1")
        text = text.lower()  # one letter at a time in this range, as the tokenizer does
    except UnicodeEncodeError:
        pass
    if any(c in text for c in _SEPARATORS):
        return [text]
    if not _BARE.search(text):
        text = text.replace(",", " ,").replace(".", " .")
    return text.split()


class _Pieces(dict):
    """Ids of pieces, in two generations of at most `limit` entries, so memory stays bounded."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > _LONG:
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """encode() gives the ids of a text as little-endian unsigned integers of `width` bytes.

    narrow: 16-bit ids where the vocabulary allows it.
    """

    def __init__(self, path: str, narrow: bool = False, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.code = "H" if narrow and self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.width = 2 if self.code == "H" else 4
        self.pieces = _Pieces(self._piece, limit)
        spec = json.loads(self.tok.to_str())
        split = json.dumps(spec["pre_tokenizer"])
        self.model = self.tok.model
        self.cut = pieces
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.strips = "Removed" in split
        # One word of letters is one piece for either kind of tokenizer; its bytes go straight to the model.
        self.direct = spec["model"]["type"] == "BPE" and "ByteLevel" in split
        if self.strips and self.lower:
            self.cut = words
        # A cut is safe only if no special token can span it.
        self.cuttable = not any(" " in t.content or "\n" in t.content or t.lstrip or t.rstrip for t in self.tok.get_added_tokens_decoder().values())

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not self.direct or not _WORD.fullmatch(piece):
            return self._whole(piece)
        word = piece
        if self.strips:
            word = word.lstrip(" ")
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LEVEL)
        elif word[0] == " ":
            word = "\u0120" + word[1:]
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuttable:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode_all(self, texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of many texts (null: empty), in runs of some `most` bytes: (first text, ids, bounds).

        ids of text first + i are ids[bounds[i] : bounds[i + 1]]. Texts are cut and their distinct
        pieces found by Arrow; each distinct piece of a run is looked up once.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.asarray(pc.binary_length(texts))
        lo = 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + 65_536]), most, "right")))
            yield lo, *self._run(texts.slice(lo, hi - lo))
            lo = min(hi, len(texts))

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind = f"<u{self.width}"
        cut, slow = self._cut_all(texts) if self.cuttable else (None, np.ones(len(texts), bool))
        if slow.all():
            parts = [np.frombuffer(self.encode(t), kind) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, kind), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        coded = cut.flatten().dictionary_encode()
        which = np.asarray(coded.indices)
        values = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        pool = np.frombuffer(b"".join(values), kind)
        size = np.fromiter(map(len, values), np.int32, len(values)) // self.width
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[which]
        ends = np.cumsum(n, dtype=np.int64)
        shift = (start[which] - (ends - n)).astype(np.int32)
        ids = pool[np.repeat(shift, n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        offsets = np.asarray(cut.offsets)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        if slow.any():  # those stand empty: put them in
            parts = [np.frombuffer(self.encode(texts[i].as_py()), kind) if slow[i] else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    def _cut_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """As self.cut() for each text, by Arrow; texts that need more care are marked slow and empty."""
        if self.cut is words:
            slow = np.asarray(pc.match_substring_regex(texts, "[\x1c-\x1f]"))
            narrow = pc.invert(pc.match_substring_regex(texts, "[^\\x{00}-\\x{ff}]"))
            texts = pc.if_else(narrow, pc.utf8_lower(texts), texts)
            mark, gap = " ", None
        else:
            slow = np.asarray(pc.match_substring_regex(texts, _CAREFUL))
            mark, gap = "\x01", "\x01"
        if slow.any():
            texts = pc.if_else(pa.array(~slow), texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, f"(?:^|[^{_LETTER}0-9])[,.]"))
        apart = pc.replace_substring(pc.replace_substring(texts, ",", mark + ","), ".", mark + ".")
        texts = pc.if_else(plain, apart, texts)
        if gap is None:
            return pc.ascii_split_whitespace(texts), slow
        texts = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 ")
        return pc.split_pattern(texts, gap), slow


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, narrow: bool = False) -> Encoder:
    """This process's encoder of a tokenizer file; Python workers are reused from task to task."""
    if (path, narrow) not in _ENCODERS:
        # Narrow ids leave room for more pieces: half as many are met for the first time again.
        _ENCODERS[path, narrow] = Encoder(path, narrow, 400_000 if narrow else 200_000)
    return _ENCODERS[path, narrow]
