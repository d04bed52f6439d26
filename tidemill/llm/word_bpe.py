"""Token ids of a word-level BPE whose pieces never hold white space: a text is cut at U+0020 and
line feeds, and each distinct word is encoded once a worker. Spaces are starters of canonical
composition and lower-casing goes by code point, so the ids are those of the whole text.

Texts of Latin-1 letters, ASCII digits, punctuation, spaces and line feeds take a short way where the file
has the steps that are known here: canonical composition leaves them as they are, so lower-casing and one
regular expression give the pieces that the library's model then merges, and pieces stand for words. So
do such words of other texts. All other words go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from tidemill.llm.base import WordTable, _Numbered

MARK = "\x01"
WORDS_HELD = 350_000
# The steps before the model for which the short way holds.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Printable ASCII and Latin-1 without spaces, controls and numbers other than ASCII digits.
SHORT = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xB2), *range(0xB4, 0xB9), 0xBA, 0xBB, *range(0xBF, 0x100)]))
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, other = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(other))
        other += b not in shown
    return out


_BYTE = byte_characters()
TO_BYTES = {ord(c): "".join(_BYTE[b] for b in c.encode()) for c in map(chr, range(0xA1, 0x100))}
_coders: dict[str, WordCoder] = {}


class WordCoder(WordTable):
    alone = True

    def __init__(self, path: str, most: int = WORDS_HELD) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder, self.most = Tokenizer.from_file(path), most
        made = json.loads(self.coder.to_str())
        before = made.get("pre_tokenizer") or {}
        known = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, BYTES]
        short = (made.get("normalizer") or {}).get("normalizers") == NORMALIZERS and before.get("pretokenizers") == known and not made.get("post_processor")
        self.merge = self.coder.model.tokenize if short else None
        first = {t["content"][:1] for t in made.get("added_tokens", ())}  # words that may hold a special token go the long way
        plain = re.escape("".join(c for c in SHORT if c not in first))
        self.short = re.compile(f"[{plain}]*").fullmatch
        self.short_text = re.compile(f"[{plain} \n]*").fullmatch if short else lambda text: None
        mark = self._plain(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.index = _Numbered()
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.coder.get_vocab_size() <= 65536 else np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        if self.merge is None:
            return self._long(words)
        out: list[list[int] | np.ndarray] = [()] * len(words)
        rest, merge, short, cut = [], self.merge, self.short, PIECES.findall
        for i, w in enumerate(words):
            if w.isalpha() and w.isascii() and w.islower():  # one piece
                out[i] = [t.id for t in merge(w)]
            elif not short(w):
                rest.append(i)
            elif w.isascii():
                out[i] = [t.id for p in cut(w.lower()) for t in merge(p)]
            else:
                out[i] = [t.id for p in cut(w.lower()) for t in merge(p.translate(TO_BYTES))]
        if rest:
            ids, counts = self._long([words[i] for i in rest])
            for i, part in zip(rest, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = part
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int64, int(counts.sum())), counts

    def _long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the whole tokenizer: the words in one text, a mark that no word has after each."""
        if self.mark is None or any(MARK in w for w in words):
            each = [self._plain(w) for w in words]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        ids = self._plain(f" {MARK} ".join(words) + f" {MARK}")
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't keep white space between words")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self) -> None:
        for lo in range(0, len(self.index.fresh), 4096):
            words = self.index.fresh[lo : lo + 4096]
            ids, counts = self._encoded(words)
            at = len(self.index) - len(self.index.fresh) + lo
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while at + len(words) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[at : at + len(words)] = self.used + np.cumsum(counts) - counts
            self.length[at : at + len(words)] = counts
            self.used += len(ids)
        self.index.fresh = []

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and where each text's ids start."""
        self._used()
        if len(self.index) > self.most:
            self.clear()
        whole = [t.decode("utf-8", "replace") for t in texts]
        parts = [PIECES.findall(t.lower()) if self.short_text(t) else t.replace("\n", " ").split(" ") for t in whole]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(ends[-1]) if len(ends) else 0)
        if self.index.fresh:
            self._learn()
        counts = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(counts)])
        flat = self.flat[np.repeat(self.start[ids] - upto[:-1], counts) + np.arange(upto[-1])]
        bounds = upto[ends]
        return np.insert(flat, bounds, end_id), np.concatenate([[0], bounds + np.arange(1, len(bounds) + 1)])


def coder(path: str) -> WordCoder:
    """The worker's coder for this file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
