"""Token ids of whole texts with a file of the tokenizers library, quickly where the file allows it.

A file whose normalizer and pre-tokenizer are WORD_FORM drops white space and never looks across it, so the ids of a
text are those of its blank-separated pieces in a row, with A-Z in lower case or not, and signs at a piece's end apart
or not (other than apostrophes; texts that hold a special token are left as they are). Pieces repeat, so a task keeps the ids of pieces that it has met
in a table of fixed size (named by a hash of 64 bits; a newer piece takes the place of an older one with the same slot,
which changes speed, never ids). Plain Latin-1 words go straight to the file's model, as WORD_FORM leaves them whole;
every other piece goes through the tokenizer. Texts of any other file go through the tokenizer whole.

Edge cases: an empty text has no ids; special tokens of the file are recognised in texts, as the library does; a very
long text is looked at in blocks with WORD_FORM, and takes the library's memory for a whole text otherwise.
"""

from __future__ import annotations

import json
from itertools import chain
from pathlib import Path

import numpy as np

from .words import word_spans

#: The normalizer and pre-tokenizer for which the shortcuts hold.
WORD_FORM = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Slots of the table as a power of two, and ids that it holds at most before it starts anew: about 30 MB in all.
SLOT_BITS, MOST_IDS = 20, 1 << 22
_blank = np.zeros(256, bool)
_blank[[10, 32]] = True
#: ASCII signs but the apostrophe, with which some of WORD_FORM's parts begin; letters and digits of ASCII.
_sign, _plain = np.zeros(256, bool), np.zeros(256, bool)
_sign[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
_plain[[c for c in range(33, 127) if chr(c).isalnum()]] = True


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def by_words(path: str) -> bool:
    """Whether the file has WORD_FORM and special tokens without white space, which are taken as they stand."""
    file = json.loads(Path(path).read_text())
    parts = {k: (file.get(part) or {}).get(k) for part, k in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))}
    sound = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(map(str.isspace, t["content"])) for t in file.get("added_tokens") or [])
    return parts == WORD_FORM and file["model"]["type"] == "BPE" and not file.get("truncation") and not file.get("padding") and sound


def before_signs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the signs at the end of each piece begin, if a letter or digit of ASCII or a letter from U+00C0 to U+00FF is before them; else its end."""
    last = np.where(_sign[data], 0, np.arange(1, len(data) + 1))
    place = np.maximum.accumulate(last)[ends - 1]
    inside = np.flatnonzero((place > starts) & (place < ends))
    c, lead = data[place[inside] - 1], data[place[inside] - 2]
    fits = _plain[c] | (lead == 0xC3) & (c >= 0x80) & (c != 0x97) & (c != 0xB7) & (place[inside] - 1 > starts[inside])
    out = ends.copy()
    out[inside[fits]] = place[inside[fits]]
    return out


class Encoder:
    """encode(texts) -> (ids of all texts in a row, number of ids of each text)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = by_words(path)
        if self.words:
            self.model = self.tokenizer.model
            letters = byte_letters()
            self.spelling = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
            self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.clear()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.names = np.zeros(1 << SLOT_BITS, np.uint64)
        self.starts = np.zeros(1 << SLOT_BITS, np.int32)
        self.sizes = np.full(1 << SLOT_BITS, -1, np.int32)
        self.flat = np.empty(MOST_IDS, np.uint32)
        self.used = 0

    def ids_of(self, piece: str) -> list[int]:
        if piece.isalpha() and max(piece) <= "\xff":
            piece = piece.lower()
            return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.spelling))]
        return self.whole(piece)

    def block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces in a row, and their numbers."""
        slots = (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        sizes, at = self.sizes[slots], self.starts[slots]
        missing = np.flatnonzero((self.names[slots] != names) | (sizes < 0))
        new, first, where = np.unique(names[missing], return_index=True, return_inverse=True)
        found = [self.ids_of(data[starts[i] : ends[i]].tobytes().decode()) for i in missing[first].tolist()]
        n_new = np.array([len(x) for x in found], np.int32)
        more = np.fromiter(chain.from_iterable(found), np.uint32)
        begin = np.cumsum(n_new) - n_new
        kept = self.used + len(more) <= MOST_IDS
        source = np.concatenate([self.flat[: self.used], more]) if not kept else self.flat
        if kept:
            self.flat[self.used : self.used + len(more)] = more
        sizes[missing], at[missing] = n_new[where], (begin + self.used)[where]
        before = np.cumsum(sizes) - sizes
        ids = source[np.repeat(at - before, sizes) + np.arange(int(sizes.sum()))]
        if kept:
            slot = slots[missing[first]]
            self.names[slot], self.starts[slot], self.sizes[slot] = new, begin + self.used, n_new
            self.used += len(more)
        else:
            self.clear()
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            ids = [self.whole(t) for t in texts]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        raw = [t.encode() for t in texts]
        bounds = np.cumsum([0] + [len(x) + 1 for x in raw])
        joined = b" ".join(raw) + b" "
        lower = joined.lower()  # of bytes: A-Z only
        as_is = any(x in lower for x in self.special)
        data = np.frombuffer(joined if as_is else lower, np.uint8)
        out, counts = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
        for starts, ends, names in word_spans(data, _blank, None if as_is else before_signs):
            ids, sizes = self.block(data, starts, ends, names)
            out.append(ids)
            total = np.cumsum(np.concatenate([[0], sizes]))
            low, high = np.searchsorted(bounds, [starts[0], starts[-1]], "right") - 1
            counts[low : high + 1] += np.diff(total[np.searchsorted(starts, bounds[low : high + 2])])
        return np.concatenate(out), counts


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
