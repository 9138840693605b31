"""Word-level BPE ids of many chunks at once, by tiktoken, with proof.

tiktoken merges whatever neighbours spell the token of least rank. Words are
given to it with a mark for their end, and the file's merges as ranks, after
those that build the mark and join it to a word's last byte. Its result is
BPE's if no two neighbours of it would have been merged otherwise: the pair
test of ``wordbpe``, whose answer is unique for a word. Words that fail the
test, and chunks with characters that spell parts of the mark, are left to the
tokenizers library.
"""

from __future__ import annotations

import json
import re

import numpy as np

from quarry.llm.wordbpe import MEMO_PAIRS, WORD, WordBpe, byte_alphabet, normalize

MARK = chr(0xF8FF)                                     # private use
# Chunks left to the library: characters that share the mark's first two bytes,
# and separators that the split pattern takes for white space.
OTHER = re.compile(f"[{chr(0xF8C0)}-{chr(0xF8FF)}\x1c-\x1f]")
LINE_FEED = 10


class WordRanks:
    """``encode(chunks)``: four-byte ids of each chunk between white space."""

    def __init__(self, data: bytes, library):
        import tiktoken

        self.library, self.pairs = library, WordBpe(data)
        self.tested: set[int] = set()   # pairs, and those that failed
        self.failed: set[int] = set()
        model = json.loads(data)["model"]
        vocab, suffix, mark = model["vocab"], model["end_of_word_suffix"], MARK.encode("utf-8")
        ranks = {bytes([b]): b for b in range(256)}
        for size in range(2, len(mark) + 1):
            ranks[mark[:size]] = len(ranks)
        spelled, ids = {}, {}
        for char, byte in byte_alphabet().items():
            spelled[char], spelled[char + suffix] = bytes([byte]), bytes([byte]) + mark
            ids[byte], ids[len(ranks)] = vocab[char], vocab[char + suffix]
            ranks[bytes([byte]) + mark] = len(ranks)
        for a, b in model["merges"]:
            spelled[a + b] = spelled[a] + spelled[b]
            ids[len(ranks)] = vocab[a + b]
            ranks[spelled[a + b]] = len(ranks)
        self.coder = tiktoken.Encoding("words", pat_str=rf"[^\n{MARK}]+{MARK}|\n", mergeable_ranks=ranks,
                                       special_tokens={})
        self.ids = np.zeros(len(ranks), np.uint32)
        self.ends = np.zeros(len(ranks), bool)
        for rank, i in ids.items():
            self.ids[rank] = i
        for token, text in spelled.items():
            self.ends[ranks[text]] = token.endswith(suffix)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair test of neighbours, made once for a pair."""
        keys = left.astype(np.int64) << 20 | right
        found = set(keys.tolist())
        for key in found.difference(self.tested):
            if not self.pairs.apart(key >> 20, key & 0xFFFFF):
                self.failed.add(key)
            self.tested.add(key)
        if len(self.tested) > MEMO_PAIRS:
            self.tested = set(self.failed)
        failed = found & self.failed
        return ~np.isin(keys, list(failed)) if failed else np.ones(len(keys), bool)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks (without line feeds), each as it is alone."""
        if not chunks:
            return []
        own, line = chunks, "\n".join(chunks)
        if OTHER.search(line):
            own = ["" if OTHER.search(c) else c for c in chunks]
            line = "\n".join(own)
        # Nothing composes with a line feed; every other character is in a word.
        marked = WORD.sub(rf"\g<0>{MARK}", normalize(line))
        ranks = np.array(self.coder.encode_ordinary(marked), np.int64)
        breaks = np.flatnonzero(ranks == LINE_FEED)
        ids, ends = self.ids[ranks], self.ends[ranks]
        data, cuts = ids.astype("<u4").tobytes(), (4 * breaks).tolist()
        out = [data[s:e] for s, e in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        inner = np.flatnonzero(~ends & (ranks != LINE_FEED))   # a word goes on
        bad = inner[~self.fits(ids[inner], ids[inner + 1])]
        asked = set(np.searchsorted(breaks, bad).tolist())
        if own is not chunks:
            asked.update(i for i, c in enumerate(own) if not c)
        for i in asked:
            out[i] = self.library(chunks[i])
        return out
