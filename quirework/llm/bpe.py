"""A byte-level BPE tokenizer as a streaming transducer with bounded lookahead, and its inverse.

The merge list bounds how far to the right anything can influence a token: a merge (a, b) is prevented only by an earlier
merge (c, d) where c ends b and d follows it, which in turn is prevented only by a still earlier one, and so on. The
longest such chain, in bytes, is the sufficient lookahead (Merges.lookahead). A token that ends at least that many bytes
before the end of what has been read is stable: it is emitted, and the encoding goes on after it, so that memory stays
constant however long a piece of text is. Before that, texts are pre-split into pieces; a boundary is certain as soon as
two further characters are known. Each distinct short piece is encoded once per worker and kept in a bounded memo.

Defined results: null and empty texts have no tokens. Lone surrogates (impossible in Parquet) are replaced.
"""

from __future__ import annotations

import codecs
import json
import os
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import regex

#: Folder of the public tokenizers, the file, and the pre-splitting pattern that goes with it.
TOKENIZERS = os.environ.get("QUIREWORK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces up to so many bytes are encoded at once and remembered; longer ones go through the transducer.
SHORT = 64
#: Entries of a worker's memo before it is emptied; characters that are fed at once.
MEMO, BLOCK = 300_000, 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: bytes that print stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _require_byte_level(path: str, whole: dict) -> None:
    """Refuses a file whose normalization or pre-splitting isn't that of this module: texts as they are, PATTERN, bytes as letters, no word ends."""
    model, pre = whole.get("model", {}), whole.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if whole.get("normalizer") or not plain or model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        raise ValueError(f"{path} is no byte-level BPE without normalizer; its normalization and pre-splitting would not be applied")


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        whole = json.load(open(path, encoding="utf-8"))
        _require_byte_level(path, whole)
        model = whole["model"]
        letters = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            if all(c in letters for c in token):
                self.bytes_of[i] = bytes(letters[c] for c in token)
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.rules: list[tuple[int, int, int]] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        self.rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(self.rules)}

    @cached_property
    def lookahead(self) -> int:
        """Bytes after a token's end that decide whether it is final.

        reach[k] of rule k = (a, b), from the end of a: the length of b, and from there the reach of any rule with a lower
        rank that could take b, or the constituent at b's right edge before the rank at which it was taken up in b.
        """
        split = {c: (a, b, k) for k, (a, b, c) in reversed(list(enumerate(self.rules)))}
        ranks: dict[int, list[int]] = {}
        best: dict[int, list[int]] = {}
        longest = 0
        for k, (a, b, _) in enumerate(self.rules):
            reach, c, limit = 0, b, k
            while True:
                n = bisect_left(ranks.get(c, ()), limit)
                if n:
                    reach = max(reach, best[c][n - 1])
                if c not in split:
                    break
                _, c, limit = split[c]
            reach += len(self.bytes_of[b])
            ranks.setdefault(a, []).append(k)
            best.setdefault(a, []).append(max(reach, best[a][-1] if best.get(a) else 0))
            longest = max(longest, reach)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Token ids of a whole piece: the pair of lowest rank is merged first, the leftmost first."""
        ids = [self.byte_id[b] for b in data]
        rank = self.rank
        while len(ids) > 1:
            low, to = None, -1
            for pair in zip(ids, ids[1:]):
                r = rank.get(pair)
                if r is not None and (low is None or r[0] < low[0]):
                    low, to = r, pair
            if low is None:
                break
            a, b = to
            out, i, n = [], 0, len(ids)
            while i < n:
                if ids[i] == a and i + 1 < n and ids[i + 1] == b:
                    out.append(low[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


class PieceTransducer:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, merges: Merges, block: int = 256) -> None:
        self.merges, self.block, self.held, self.at = merges, block, b"", 0

    def push(self, data: bytes) -> Iterator[int]:
        self.held = self.held[self.at :] + data if self.at else self.held + data
        self.at = 0
        while len(self.held) - self.at >= self.block + self.merges.lookahead:
            window = self.held[self.at : self.at + self.block + self.merges.lookahead]
            end = 0
            for i in self.merges.merge(window):
                n = len(self.merges.bytes_of[i])
                if end + n > self.block:
                    break
                end += n
                yield i
            if not end:  # the first token itself is longer than the block
                self.block *= 2
                continue
            self.at += end

    def finish(self) -> Iterator[int]:
        yield from self.merges.merge(self.held[self.at :])
        self.held, self.at = b"", 0


class _Memo(dict):
    """Ids, as int32 bytes, of units of text; a unit is encoded when first asked for."""

    def __init__(self, make, most: int = MEMO) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes:
        made = self.make(unit)
        if len(unit) <= SHORT:
            if len(self) >= self.most:
                self.clear()
            self[unit] = made
        return made


class Tokenizer:
    """Encodes texts without special tokens; see the module's docstring for the method."""

    #: White space other than single spaces and one or two line feeds between other characters.
    _irregular = regex.compile(r"[^\S\n ]|  | \n|\n |\n\n\n|\A\s|\s\Z")
    _pieces = regex.compile(PATTERN)
    _classes = tuple(regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*"))
    _spaces = regex.compile(r"\s*")

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self._piece = _Memo(self._encode_piece)
        self._head = _Memo(self._encode_unit)
        self._tail = _Memo(lambda unit: self._encode_unit(" " + unit))
        self._line_feed = self._encode_piece("\n")

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        if len(data) <= SHORT:
            return np.array(self.merges.merge(data), np.int32).tobytes()
        t = PieceTransducer(self.merges)
        return np.array([*t.push(data), *t.finish()], np.int32).tobytes()

    def _encode_unit(self, unit: str) -> bytes:
        return b"".join([self._piece[p] for p in self._pieces.findall(unit)])

    def _encode_part(self, text: str) -> bytes:
        """A text that starts and ends at piece boundaries. Where spaces and line feeds stand alone, pieces never reach across them: the words between are units that can be looked up."""
        if self._irregular.search(text):
            return self._encode_unit(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self._line_feed)
            first, *rest = line.split(" ")
            out.append(self._head[first])
            out.extend(map(self._tail.__getitem__, rest))
        return b"".join(out)

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids, as int32 bytes, of the text that the blocks make up, as soon as they are stable."""
        held, giant, kind = "", None, None
        for block in blocks:
            held += block
            while held:
                if giant is not None:  # within a piece longer than a block
                    end = kind.match(held).end()
                    keep = end - (kind is self._spaces and end > 0)  # the last white space before anything else opens the next piece
                    ids = [*giant.push(held[:keep].encode("utf-8", "replace"))]
                    ended, held = end < len(held), held[keep:]
                    if ended:
                        ids += giant.finish()
                        giant = None
                    yield np.array(ids, np.int32).tobytes()
                    if ended:
                        continue
                    break
                if len(held) < BLOCK:
                    break
                cut = self._safe_cut(held)
                if cut:
                    yield self._encode_part(held[:cut])
                    held = held[cut:]
                    continue
                found = [*self._pieces.finditer(held)][:-1]
                while found and found[-1].end() > len(held) - 3:  # what comes later may still change
                    found.pop()
                if found:
                    yield b"".join([self._piece[m.group()] for m in found])
                    held = held[found[-1].end() :]
                    continue
                lead = int(held[0] == " ")
                kind = next((k for k in (*self._classes, self._spaces) if k.match(held, lead).end() == len(held)), None)
                if kind is None:
                    break
                lead *= kind is not self._spaces
                giant = PieceTransducer(self.merges)
                yield np.array([*giant.push(held[:lead].encode("utf-8", "replace"))], np.int32).tobytes()
                held = held[lead:]
        if giant is not None:
            yield np.array([*giant.push(held.encode("utf-8", "replace")), *giant.finish()], np.int32).tobytes()
        elif held:
            yield self._encode_part(held)

    @staticmethod
    def _safe_cut(text: str) -> int:
        """The last place before a space or line feed that stands alone."""
        at = len(text) - 1
        for _ in range(64):
            at = max(text.rfind(" ", 1, at), text.rfind("\n", 1, at))
            if at < 1:
                return 0
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
        return 0

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= BLOCK:
            return self._encode_part(text)
        return b"".join(self.stream(text[i : i + BLOCK] for i in range(0, len(text), BLOCK)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4

    def units(self, text: str) -> list[str]:
        """The text cut at certain piece boundaries: the unit's tokens do not depend on what surrounds it."""
        if self._irregular.search(text):
            return self._pieces.findall(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out.extend([" " + x for x in rest])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete: a state machine over the bytes of the tokens."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.merges.bytes_of[i]):
                yield part
        if part := machine.decode(b"", True):
            yield part


@lru_cache(maxsize=4)
def tokenizer(path: str = "") -> Tokenizer:
    """One tokenizer a worker and file."""
    return Tokenizer(path or os.path.join(TOKENIZERS, BYTE_BPE))
