"""The word-level BPE vocabulary: splitting a text into words and ids.

``WordBpe`` is plain Python used inside tasks. It reads the vocabulary file's
bytes and encodes a word by dynamic programming over its prefixes:

* An automaton over all tokens reports, for every prefix, the tokens that end
  there (following suffix links from the longest match).
* Token ``t`` is the last token of a prefix exactly if the prefix before ``t``
  has a last token ``s`` and BPE would leave ``s`` and ``t`` apart. That pair
  test needs only merge ranks, and its answer is unique per prefix.
* Back-pointers from the end of the word give the ids.

The cost is linear in the word (times the matches per place), however long
the word is, unlike repeated merging.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import regex

END = 256  # a word's last byte b is symbol b + END, other bytes are themselves

# The file's split pattern and its white space (Unicode
# White_Space; str.split() would also cut at U+001C..U+001F).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CHUNK = re.compile(f"[^{SPACE}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")

MEMO_CHUNKS = 250_000   # entries per generation of the chunk memo
MEMO_CHARS = 48         # longer chunks are encoded each time
MEMO_PAIRS = 300_000    # entries of the pair-test memo


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies -> byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def normalize(chunk: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule)."""
    if chunk.isascii():
        return chunk.lower()
    return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()


def symbols(word: str) -> str:
    """A word's bytes as characters, its last one marked as word end."""
    s = word.encode("utf-8").decode("latin-1")
    return s[:-1] + chr(ord(s[-1]) + END)


class SuffixMatcher:
    """All tokens ending at each place of a string, longest first.

    The states are the tokens' prefixes; ``step`` moves along a symbol, and
    ``shorter`` leads to the longest proper suffix that is a state too.
    """

    def __init__(self, tokens: dict[str, int]):
        self.step: dict[int, int] = {}
        above, via, ends = [0], [0], [()]
        for text, token in tokens.items():
            state = 0
            for char in text:
                edge = state << 9 | ord(char)
                if edge not in self.step:
                    self.step[edge] = len(ends)
                    above.append(state)
                    via.append(ord(char))
                    ends.append(())
                state = self.step[edge]
            ends[state] = ((token, len(text)),)
        depth = [0] * len(ends)
        for state in range(1, len(ends)):
            depth[state] = depth[above[state]] + 1
        self.shorter = [0] * len(ends)
        for state in sorted(range(1, len(ends)), key=depth.__getitem__):
            if depth[state] > 1:
                self.shorter[state] = self.move(self.shorter[above[state]], via[state])
            ends[state] += ends[self.shorter[state]]
        self.ends = ends

    def move(self, state: int, symbol: int) -> int:
        step = self.step
        while (edge := state << 9 | symbol) not in step:
            if not state:
                return 0
            state = self.shorter[state]
        return step[edge]


class Memo(dict):
    """Chunk -> encoded bytes, in two generations so that it stays bounded."""

    def __init__(self, encode, size: int = MEMO_CHUNKS, longest: int = MEMO_CHARS):
        self.encode, self.size, self.longest, self.old = encode, size, longest, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            out = self.encode(chunk)
            if len(chunk) > self.longest:
                return out
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = out
        return out


class Splitter:
    """Text -> chunks between white space, and special tokens as ids."""

    def __init__(self, config: dict):
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_pattern = re.compile("|".join(
            f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def pieces(self, text: str):
        """(special id, None) or (None, chunks) in the order of the text."""
        at = 0
        if "<|" in text:
            for m in self.special_pattern.finditer(text):
                yield None, self.chunks(text[at:m.start()])
                yield self.special[m[0]], None
                at = m.end()
        yield None, self.chunks(text[at:] if at else text)

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(text) if SEPARATORS.search(text) else text.split()


class WordBpe:
    """Encoder and decoder of one vocabulary file (given as bytes)."""

    def __init__(self, data: bytes):
        config = json.loads(data)
        model = config["model"]
        suffix = model["end_of_word_suffix"]
        vocab, merges = model["vocab"], model["merges"]
        self.splitter = Splitter(config)
        self.strings = {i: t for t, i in vocab.items()} | {
            i: t for t, i in self.splitter.special.items()}

        spelled: dict[str, str] = {}
        for char, byte in byte_alphabet().items():
            spelled[char] = chr(byte)
            spelled[char + suffix] = chr(byte + END)
        self.rank = {vocab[t]: -1 for t in spelled}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            spelled[a + b] = spelled[a] + spelled[b]
            token, pair = vocab[a + b], (vocab[a], vocab[b])
            if token in self.rank:
                raise ValueError(f"token {a + b!r} has two merges")
            self.rank[token], self.halves[token], self.joined[pair] = r, pair, r
        self.length = {vocab[t]: len(s) for t, s in spelled.items()}
        self.matcher = SuffixMatcher({s: vocab[t] for t, s in spelled.items()})
        self.apart_memo: dict[int, bool] = {}
        self.memo = Memo(self.encode_chunk)

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE on the two tokens' symbols gives just these two tokens.

        Undo the latest merge of either side again and again. A pair of parts
        that meet at the seam would have merged if its merge ranks before the
        merge that consumed the left part, or not after the one that consumed
        the right part (of equal merges the leftmost goes first).
        """
        a, b, rank, joined = left, right, self.rank, self.joined
        a_used = b_used = len(rank)
        while True:
            r = joined.get((a, b))
            if r is not None and r < a_used and r <= b_used:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a_used, a = ra, self.halves[a][1]
            else:
                b_used, b = rb, self.halves[b][0]

    def remember(self, key: int) -> bool:
        if len(self.apart_memo) >= MEMO_PAIRS:
            self.apart_memo.clear()
        out = self.apart_memo[key] = self.apart(key >> 20, key & 0xFFFFF)
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (already normalised, not empty)."""
        s = symbols(word)
        last = [-1] * (len(s) + 1)
        step, shorter, ends = self.matcher.step, self.matcher.shorter, self.matcher.ends
        known, state = self.apart_memo, 0
        for end, char in enumerate(s, 1):
            char = ord(char)
            while (edge := state << 9 | char) not in step:
                state = shorter[state]
            state = step[edge]
            for token, size in ends[state]:
                if size == end:
                    last[end] = token
                    break
                key = last[end - size] << 20 | token
                fits = known.get(key)
                if fits is None:
                    fits = self.remember(key)
                if fits:
                    last[end] = token
                    break
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= self.length[last[at]]
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        ids = [i for w in WORD.findall(normalize(chunk)) for i in self.encode_word(w)]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text, four bytes each, little-endian."""
        return encode_pieces(self.splitter.pieces(text), self.memo)

    def decode(self, ids) -> str:
        """Token strings joined by one space, as the file (no decoder) says."""
        return " ".join(map(self.strings.__getitem__, ids))


def encode_pieces(pieces, memo: Memo) -> bytes:
    out = []
    for special, chunks in pieces:
        if chunks is None:
            out.append(special.to_bytes(4, "little"))
        else:
            out.extend(map(memo.__getitem__, chunks))
    return b"".join(out)
