"""Encoding whole texts with the tokenizers library, word by word with a cache.

Both vocabularies used here cut a text before a space that follows a character other than white space, whatever
stands around it.  So a text is encoded piece by piece between such spaces, and only pieces that a worker hasn't seen
go to the library.  The cache is a hash table in arrays, from a piece's 64-bit hash to its ids, and is asked for all
pieces of many texts at once.  Texts with other white space, with runs of it, or with the string of a special token
(which gives that token's id, as in the library's plain call) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from gridspark.llm.hashing import span_hashes

#: Places in the table, and ids and pieces it keeps at most (it starts again beyond that; this bounds memory only).
PLACES, KEPT_IDS, KEPT_PIECES = 1 << 21, 8_000_000, 1_400_000
#: Bytes of text that are encoded at a time (the arrays for it take about a hundred times as much).
STEP = 500_000
#: A special token that stands between new pieces, so that many of them are one text for the library.
SENTINEL, JOINED = "<|endoftext|>", 64
#: White space of one byte besides space and line feed, and of more bytes by the first two: fixed values of Unicode.
_OTHER_SPACE = np.zeros(256, bool)
_OTHER_SPACE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LONG_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(bytes([0xE2, 0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
                b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_made: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes; ``spaced``: a piece's leading space belongs to its ids."""

    def __init__(self, file: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.sentinel = self.library.token_to_id(SENTINEL)
        self.spaced = spaced
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32)
        self.first, self.size, self.pieces = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[np.ndarray]:
        """ids of pieces, many at a time: the library cuts texts at special tokens before anything else."""
        out: list = []
        joined = [SENTINEL.join(pieces[at:at + JOINED]) for at in range(0, len(pieces), JOINED)]
        for ids in self._ids(joined):
            cut = np.flatnonzero(ids == self.sentinel).tolist()
            out += [ids[a + 1:b] for a, b in zip([-1, *cut], [*cut, len(ids)], strict=True)]
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it is unknown."""
        out, live = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        while len(live):
            key = self.keys[at]
            hit = key == hashes[live]
            out[live[hit]] = self.place[at[hit]]
            on = ~hit & (key != 0)
            live, at = live[on], at[on] + 1 & PLACES - 1
        return out

    def _add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """Keep new pieces (distinct hashes)."""
        n, flat = self.pieces, np.concatenate(ids)
        sizes = np.array([len(x) for x in ids], np.int64)
        self.pieces, self.used = n + len(ids), self.used + len(flat)
        while len(self.first) < self.pieces:
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while len(self.ids) < self.used:
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.first[n:self.pieces] = self.used - len(flat) + np.cumsum(sizes) - sizes
        self.size[n:self.pieces] = sizes
        self.ids[self.used - len(flat):self.used] = flat
        live, at = np.arange(len(hashes)), (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        while len(live):
            one = np.zeros(len(live), bool)
            one[np.unique(at, return_index=True)[1]] = True  # of those that want a place, one gets it
            one &= self.keys[at] == 0
            self.keys[at[one]], self.place[at[one]] = hashes[live[one]], n + live[one]
            live, at = live[~one], at[~one]
            at = np.where(self.keys[at] != 0, at + 1 & PLACES - 1, at)

    def _odd(self, datas: list[bytes]) -> np.ndarray:
        """Texts with white space other than single spaces between words, and line feeds, or with a special token's string."""
        data = np.frombuffer(b"\xff".join([*datas, b""]), np.uint8)
        at = _OTHER_SPACE[data]
        at[:-1] |= ((data[:-1] == 32) | (data[:-1] == 10)) & (data[1:] == 32)
        odd = np.zeros(len(datas), bool)
        odd[np.searchsorted(np.flatnonzero(data == 0xFF), np.flatnonzero(at))] = True
        for i, x in enumerate(datas):
            odd[i] |= any(s in x for s in self.special) or not x.isascii() and any(s in x for s in _LONG_SPACES)
        return odd

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.used > KEPT_IDS or self.pieces > KEPT_PIECES:
            self._clear()
        datas = [t.encode() for t in texts]
        odd = self._odd(datas)
        whole = iter(self._ids([texts[i] for i in np.flatnonzero(odd)]))
        data = np.frombuffer(b"\xff".join([*(b"" if o else x for x, o in zip(datas, odd, strict=True)), b""]), np.uint8)
        gaps = np.flatnonzero(data == 0xFF)
        spaces = np.flatnonzero(data == 32)
        heads = np.append(0, gaps[:-1] + 1) if len(gaps) else gaps
        on = np.zeros(len(data) + 1, bool)
        on[heads] = on[spaces if self.spaced else spaces + 1] = True
        starts = np.flatnonzero(on)
        stops = np.flatnonzero((data == 0xFF) | (data == 32))
        starts = starts[starts < len(data)]
        ends = stops[np.searchsorted(stops, starts + (data[starts] == 32) if self.spaced else starts)]
        some = ends > starts
        starts, ends = starts[some], ends[some]
        hashes = span_hashes(data, starts, ends) | np.uint64(1)  # 0 is an empty place
        number = self._find(hashes)
        new, at = np.unique(hashes[number < 0], return_index=True)
        if len(new):
            spans = np.flatnonzero(number < 0)[at]
            raw = data.tobytes()
            self._add(new, self._new([raw[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]))
            number = self._find(hashes)
        sizes = self.size[number].astype(np.int64)
        to = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[number] - to + sizes, sizes) + np.arange(int(to[-1]) if len(to) else 0)]
        cut = np.append(0, to)[np.searchsorted(starts, gaps)].tolist()
        parts = [ids[a:b].tobytes() for a, b in zip([0, *cut], cut)]
        return [next(whole).tobytes() if o else x for o, x in zip(odd, parts, strict=True)]


def encoder(file: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if (file, spaced) not in _made:
        _made[file, spaced] = PieceEncoder(file, spaced)
    return _made[file, spaced]
