"""Token ids of whole texts, as the library of a vocabulary file gives them.

A ``.json`` file is read by ``tokenizers``, a ``.model`` file by ``sentencepiece``. For the common kind of ``.json``
file (byte-level BPE, no normaliser, merges in the order of their ids) batches take a faster way to the same ids: the
words of a batch are found by array operations, every distinct word is merged once, and ids are gathered. Texts with
added tokens, with characters outside the blocks below or that aren't UTF-8 go to the library. Tests compare both.
"""

import hashlib
import json
import os
import unicodedata
from array import array

import numpy as np

from recordrisk.llm.shared import SPACE, _Hash, mix, slices

LIBRARY_WORDS = 400_000
OTHER, LETTER, NUMBER, BLANK, BORDER, RARE = range(6)
_TOP = 0x2300  # code points from here on, and the blocks between the two below, go to the library
_BLOCKS = ((0x0000, 0x0530), (0x2000, 0x2300))
# The pattern that this kind of vocabulary file splits text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}


def version_of(path: str) -> str:
    """Digest of the vocabulary file: counts kept under it hold for this file only."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _classes() -> np.ndarray:
    out = np.full(_TOP + 1, RARE, np.uint8)
    for lo, hi in _BLOCKS:
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))
            out[c] = BLANK if c in _WHITE else RARE if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[_TOP] = BORDER
    return out


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself, or the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Made once per Python worker (see ``encoder``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda s: model.encode(s, add_bos=False, add_eos=False)
            return
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.library = lambda s: whole.encode(s, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        if ranks := _plain_ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.classes, self.hash = _classes(), _Hash(21)
            self.values = np.random.default_rng(22).integers(1, 1 << 63, _TOP + 1, dtype=np.uint64)
            self.clear()

    def clear(self):
        self.keys, self.rows, self.ids, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), array("I"), array("q", [0])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and where each document's ids begin (one more entry: the end)."""
        if self.fast:
            try:
                text = data.tobytes().decode()
            except UnicodeDecodeError:
                return self._by_library(data, offsets)
            return self._encode_slice(data, offsets, text)
        return self._by_library(data, offsets)

    def _by_library(self, data, offsets):
        body = data.tobytes()
        each = [self.library(body[a:b].decode(errors="replace")) for a, b in zip(offsets[:-1], offsets[1:])]
        return np.array([i for x in each for i in x], np.uint32), np.cumsum([0, *map(len, each)])

    def _encode_slice(self, data, offsets, text):
        n = len(offsets) - 1
        chars = np.zeros(len(data) + 1, np.int64)
        lead = (data & 0xC0) != 0x80
        np.cumsum(lead, out=chars[1:])
        at = chars[offsets]  # in characters
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        odd = points >= _TOP
        points = np.insert(np.minimum(points, _TOP), at[1:], _TOP).astype(np.int64)  # a border after each document
        classes = self.classes[points]
        classes[np.insert(odd, at[1:], False)] = RARE
        doc_at = at + np.arange(n + 1)
        slow = {int(i) for i in np.searchsorted(doc_at, np.flatnonzero(classes == RARE), "right") - 1}
        body = data.tobytes()
        if any(t in body for t in self.added):
            slow |= {i for i in range(n) if any(t in body[offsets[i] : offsets[i + 1]] for t in self.added)}
        starts = word_starts(points, classes)
        ends = np.append(starts[1:], len(points))
        keep = classes[starts] != BORDER
        starts, ends = starts[keep], ends[keep]
        doc = np.searchsorted(doc_at, starts, "right") - 1
        rows = self._rows(points, starts, ends, doc, slow, body, np.append(np.flatnonzero(lead), len(data)))
        flat, limits = np.array(self.ids, np.uint32), np.array(self.ends, np.int64)  # copies: the tables grow
        lengths = limits[rows + 1] - limits[rows]
        before = np.cumsum(lengths) - lengths
        ids = flat[np.repeat(limits[rows] - before, lengths) + np.arange(lengths.sum())]
        counts = np.bincount(doc, lengths, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        begins = np.concatenate(([0], np.cumsum(counts)))
        if not slow:
            return ids, begins
        each = [np.array(self.library(body[offsets[i] : offsets[i + 1]].decode()), np.uint32) if i in slow else ids[begins[i] : begins[i + 1]] for i in range(n)]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def _rows(self, points, starts, ends, doc, slow, body, byte_of):
        """Place of each word's ids in the table of known words, which new words join."""
        if len(self.rows) > LIBRARY_WORDS:
            self.clear()
        if slow:
            skip = np.isin(doc, list(slow))
        self.hash.reach(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.values[points] * self.hash.powers[: len(points)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * self.hash.inverses[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(40))
        if slow:
            keys[skip] = 0  # their ids come from the library
        found, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, found)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            one = first[new]
            lo, hi = byte_of[starts[one] - doc[one]].tolist(), byte_of[ends[one] - doc[one]].tolist()
            if slow:
                hi = [a if x else b for a, b, x in zip(lo, hi, skip[one].tolist())]
            merge = self.fast._encode_single_piece
            for a, b in zip(lo, hi):
                if b > a:
                    self.ids.extend(merge(body[a:b]))
                self.ends.append(len(self.ids))
            self.rows = np.insert(self.rows, place[new], len(self.rows) + np.arange(len(new)))
            self.keys = np.insert(self.keys, place[new], found[new])
            place = np.searchsorted(self.keys, found)
        return self.rows[place][back]


def word_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin. Documents end in a border character, a match of its own."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    flag = np.ones(n, bool)
    flag[1:] = (classes[1:] != classes[:-1]) | (classes[1:] == BORDER)
    first = np.flatnonzero(flag)
    last = np.append(first[1:], n)
    blank = classes[first] == BLANK
    # the last of several blanks before a word stands alone or begins the word
    several = blank & (last - first > 1) & (classes[np.minimum(last, n - 1)] != BORDER)
    lone = last[several] - 1
    after_space = ~blank & (classes[first] != BORDER) & (first > 0) & (points[first - 1] == 0x20)
    flag[first[after_space]] = False
    flag[lone] = True
    marks = first[(points[first] == 0x27) & (last - first == 1) & ~after_space]
    if len(marks):
        end = np.append(points, [0, 0, 0])
        kind = np.append(classes, [BORDER] * 3)
        one, two = end[marks + 1], end[marks + 2]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
        marks, size = marks[size > 0], size[size > 0]
        flag[marks + 1] = False
        rest = marks + 1 + size
        flag[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(flag)


def _plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes and id of every entry, if ids alone decide the merges of this file."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk")):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in pairs]
    if None in made or made != sorted(made) or len(set(made)) != len(made):
        return None
    letters, added = _byte_letters(), {t["content"] for t in spec.get("added_tokens") or []}
    return {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in added}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(path: str, column):
    """(first document, ids, begins) for each slice of an Arrow column of texts."""
    from recordrisk.llm.shared import raw

    own = encoder(path)
    for first, _, data, offsets in slices(*raw(column)):
        yield first, *own.encode(data, offsets)


__all__ = ["Encoder", "encoded", "encoder", "version_of", "word_starts", "SPACE"]
