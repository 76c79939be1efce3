"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a piece of text there is exactly one last token of the prefix's
valid encoding. Storing these last tokens is enough to read the encoding of any
prefix backwards, to go on when bytes are appended, and to encode anew only around
an edit.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache
from pathlib import Path

import regex

#: Fixed values of the public vocabulary: how text is cut into pieces before pairs are merged.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces and token pairs that a worker remembers before it starts afresh.
REMEMBER = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a vocabulary file lies: in SPINDREL_TOKENIZERS, else in the installed collection."""
    folder = os.environ.get("SPINDREL_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return str(Path(folder, name))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain byte-pair encoding: the pair of lowest rank is merged until none is left."""
    parts = [raw[k : k + 1] for k in range(len(raw))]
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[x] for x in parts]


class PrefixEncoder:
    """Encodes text with the ranks of a byte-level vocabulary, piece by piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side in a valid encoding."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBER:
                self._pairs.clear()
            known = self._pairs[left, right] = merge_pairs(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return known

    def alone(self, token: int) -> bool:
        """Whether the bytes of a token encode to that token (merges may not reach all tokens of a vocabulary)."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = merge_pairs(self.bytes_of[token], self.ranks) == [token]
        return known

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (last token of each prefix, from length 1) up to the length of ``raw``."""
        ranks, fits = self.ranks, self.fits
        for end in range(len(last) + 1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(raw[start:end])
                if token is not None and (fits(last[start - 1], token) if start else self.alone(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def backwards(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self._pieces.get(piece)
        if known is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            known = (whole,) if whole is not None and self.alone(whole) else tuple(self.backwards(self.extend(raw, [])))
            if len(raw) <= 64:
                if len(self._pieces) >= REMEMBER:
                    self._pieces.clear()
                self._pieces[piece] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Token ids; none for a null or empty text."""
        ids: list[int] = []
        if text:
            piece = self.piece
            for x in self.split(text):
                ids += piece(x)
        return ids


class PrefixTable:
    """The encoding of one text, kept by prefix so that it can grow and be edited.

    An edit encodes anew from two pieces before it to the place where the old cuts hold again.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.pieces, self.last = encoder, [], []
        self._redo(0, text, [], [])

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        return [x for last in self.last for x in self.encoder.backwards(last)]

    def _redo(self, keep: int, text: str, tail: list[str], tail_last: list[list[int]]) -> int:
        """Pieces from ``keep`` on come from ``text``; ``tail`` are the old pieces at its end. Returns how many pieces were encoded."""
        old_ends, at = {}, len(text)
        for k in range(len(tail) - 1, -1, -1):
            at -= len(tail[k])
            old_ends[at] = k
        self.last, old = self.last[:keep], self.last[keep:]
        self.pieces, old_pieces = self.pieces[:keep], self.pieces[keep:]
        done, at, stable = 0, 0, 0
        for k, piece in enumerate(self.encoder.split(text)):
            if at in old_ends and stable >= 2:
                resumed = old_ends[at]
                self.pieces += tail[resumed:]
                self.last += tail_last[resumed:]
                return done
            stable = stable + 1 if at in old_ends else 0
            raw, begun = piece.encode(), []
            if k < len(old_pieces) and not tail and piece.startswith(old_pieces[k]):
                begun = list(old[k])  # the piece has only grown: its prefixes stand
            self.pieces.append(piece)
            self.last.append(self.encoder.extend(raw, begun))
            at, done = at + len(piece), done + 1
        return done

    def append(self, text: str) -> int:
        """Add text at the end; returns how many pieces were encoded."""
        keep = max(0, len(self.pieces) - 2)
        return self._redo(keep, "".join(self.pieces[keep:]) + text, [], [])

    def edit(self, start: int, stop: int, text: str) -> int:
        """Put ``text`` in place of characters start to stop; returns how many pieces were encoded."""
        at, first, after = 0, 0, len(self.pieces)
        for k, piece in enumerate(self.pieces):
            if at + len(piece) <= start:
                first = k + 1
            if at >= stop:
                after = min(after, k)
            at += len(piece)
        first = max(0, first - 2)
        before = sum(map(len, self.pieces[:first]))
        middle = "".join(self.pieces[first:])
        tail, tail_last = self.pieces[after:], self.last[after:]
        return self._redo(first, middle[: start - before] + text + middle[stop - before :], tail, tail_last)


@lru_cache(maxsize=4)
def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    return PrefixEncoder(load_ranks(path))


@lru_cache(maxsize=4)
def fast_encoder(path: str):
    """The library's encoder of the same vocabulary, for counts."""
    import tiktoken

    return tiktoken.Encoding(Path(path).stem, pat_str=PIECES.replace("\\P{White_Space}", "\\S").replace("[^\\p{White_Space}", "[^\\s").replace("\\p{White_Space}", "\\s"), mergeable_ranks=load_ranks(path), special_tokens={})
