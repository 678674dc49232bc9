"""Exact byte-pair encoding in linear time, by backtracking over longest matches.

A token sequence is the encoding of its bytes exactly if every pair of
neighbours is *compatible*, i.e. encoding the two tokens' bytes gives back the
two tokens. So: an Aho-Corasick automaton finds the tokens at each position;
the encoder takes the longest, keeps it if it is compatible with the token
before it, else tries the next shorter token at that place, and steps back
when none is left. Positions known to lead nowhere are marked, so each is left
at most once. A piece that is a token as a whole needs none of this, and the ids
of short pieces are remembered as bytes, so a text is one join of them. A pair is compatible if undoing the merges of its tokens in rank
order never uncovers a merge across their border that would have come first;
answers are kept in a table. Decoding slices one byte string by an offset table.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import regex

#: Fixed value: the pattern that cuts text before merging (of the rank files).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LARGEST = "\uffff"


@lru_cache(maxsize=1)
def _plain_split() -> re.Pattern:
    """SPLIT for texts without characters beyond U+FFFF, its classes written out
    as ranges: the standard matcher is twice as fast, but knows no classes."""
    letters, digits, blanks = (_ranges(c) for c in (r"\p{L}", r"\p{N}", r"\s"))
    pattern = SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{digits}]").replace(r"(?!\S)", f"(?![^{blanks}])")
    for name, ranges in ((r"\p{L}", letters), (r"\p{N}", digits), (r"\s", blanks)):
        pattern = pattern.replace(name, f"[{ranges}]")
    return re.compile(pattern)


def _ranges(name: str) -> str:
    """The characters of a class up to U+FFFF, as ranges."""
    one = regex.compile(name)
    hit = np.array([bool(one.match(chr(c))) for c in range(0x10000)] + [False])
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edge[::2], edge[1::2], strict=True))


class _Pieces(dict):
    """piece -> its ids as bytes of 32-bit integers, filled as pieces are met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        ids = array("i", self.encode(raw)).tobytes()
        if len(raw) <= CACHE_PIECE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


#: Where the public vocabularies lie, unless a path is given.
DEFAULT_DIR = "/opt/tokenizers"
#: Bits of a token id; ids, lengths and pairs are packed into one integer.
_BITS = 24
_MASK = (1 << _BITS) - 1
CACHE_PIECES, CACHE_PIECE_BYTES, CACHE_PAIRS = 200_000, 64, 500_000


def _ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file or a JSON vocabulary."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        # byte-level vocabularies write each byte as one printable character
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        model = json.loads(text)["model"]
        special = {t["content"] for t in json.loads(text).get("added_tokens", [])}
        pairs = [(i, bytes(back[c] for c in t)) for t, i in model["vocab"].items() if t not in special]
    else:
        pairs = [(int(r), base64.b64decode(t)) for t, r in (line.split() for line in text.splitlines() if line)]
    out: list[bytes] = [b""] * (max(i for i, _ in pairs) + 1)
    for i, t in pairs:
        out[i] = t
    return out


class BytePairEncoder:
    """Encodes and decodes by one byte-level vocabulary."""

    def __init__(self, path: str):
        self.tokens = _ranks(path)
        self.id_of = {t: i for i, t in enumerate(self.tokens) if t}
        self.halves = self._halves()
        self.merged = {a << _BITS | b: i for i, (a, b) in enumerate(self.halves) if a >= 0}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t.decode("latin-1"), len(t) << _BITS | i)  # longer tokens are larger numbers
        self.automaton.make_automaton()
        self.shorter = self._shorter()
        self.blob = b"".join(self.tokens)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self._fresh()

    def _fresh(self) -> None:
        self.split = regex.compile(SPLIT)
        self._pairs: dict[int, bool] = {}
        self._pieces = _Pieces(self._encode_raw)

    def __getstate__(self) -> dict:
        """What another process needs; what was remembered stays here."""
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "_pairs", "_pieces")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _encode_raw(self, raw: bytes) -> list[int]:
        one = self.id_of.get(raw)
        return [one] if one is not None and self.is_own(one) else self._encode_piece(raw)

    def _halves(self) -> list[tuple[int, int]]:
        """The two tokens each token was merged from, (-1, -1) for single bytes.

        Tokens are rebuilt in rank order: the last merge inside a token joins
        the two parts left when only earlier tokens may be merged.
        """
        out = [(-1, -1)] * len(self.tokens)
        for t, i in self.id_of.items():
            if len(t) < 2:
                continue
            parts = [self.id_of[t[k : k + 1]] for k in range(len(t))]
            while len(parts) > 2:
                best, at = i, -1
                for k in range(len(parts) - 1):
                    m = self.id_of.get(self.tokens[parts[k]] + self.tokens[parts[k + 1]], i)
                    if m < best:
                        best, at = m, k
                if at < 0:
                    break
                parts[at : at + 2] = [best]
            if len(parts) == 2:
                out[i] = (parts[0], parts[1])
        return out

    def _shorter(self) -> list[int]:
        """For each token the longest token that is a proper prefix of it, or -1."""
        out = [-1] * len(self.tokens)
        for t, i in self.id_of.items():
            for n in range(len(t) - 1, 0, -1):
                j = self.id_of.get(t[:n])
                if j is not None:
                    out[i] = j
                    break
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just them."""
        pair = left << _BITS | right
        known = self._pairs.get(pair)
        if known is None:
            known = self._check(left, right)
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            self._pairs[pair] = known
        return known

    def _check(self, a: int, b: int) -> bool:
        # Walk back in time: the later-made of the two border tokens is undone
        # first. `before` is the rank from which on a merge across the border
        # comes too late, as one of its sides had been merged on by then.
        merged, halves = self.merged.get, self.halves
        before = len(halves)
        while True:
            if merged(a << _BITS | b, before) < before:
                return False
            last, first = halves[a][1], halves[b][0]
            if last < 0 and first < 0:
                return True
            # ties (a == b): merging runs left to right, so a was made first
            if first < 0 or (last >= 0 and a > b):
                before, a = a, last
            else:
                # a merge of equal rank further left still comes first
                before, b = b + 1, first

    def _encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - (found >> _BITS)
            if found > longest[start]:
                longest[start] = found
        tokens, shorter, pairs, compatible = self.tokens, self.shorter, self._pairs.get, self.compatible
        out: list[int] = []
        dead: set[int] = set()
        pos, last, token = 0, -1, longest[0] & _MASK
        while pos < n:
            while token >= 0:
                end = pos + len(tokens[token])
                if end not in dead:
                    if last < 0:
                        break
                    fits = pairs(last << _BITS | token)
                    if fits or fits is None and compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos, last = end, token
                token = longest[pos] & _MASK if pos < n else -1
            else:
                dead.add(pos)
                token = out.pop()
                pos -= len(tokens[token])
                token, last = shorter[token], out[-1] if out else -1
        return out

    def encode_packed(self, text: str) -> bytes:
        """Token ids without special tokens, as 32-bit integers end to end."""
        found = _plain_split().findall(text) if text.isascii() or max(text) <= _LARGEST else self.split.findall(text)
        return b"".join(map(self._pieces.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        """Token ids without special tokens; [] for an empty text."""
        return array("i", self.encode_packed(text)).tolist()

    def is_own(self, token: int) -> bool:
        """Whether a token's bytes encode to the token itself."""
        return len(self.tokens[token]) == 1 or self.halves[token][0] >= 0

    def decode_bytes(self, ids) -> bytes:
        o = self.offsets
        return b"".join([self.blob[o[i] : o[i + 1]] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per process and vocabulary; the path is the cache key."""
    return BytePairEncoder(path)
