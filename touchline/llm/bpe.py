"""Byte-level BPE: exact merges in linear time, and decoding.

Bytes are mapped to Latin-1 characters, so that one pyahocorasick automaton
finds every vocabulary entry in a piece. Encoding starts from the longest entry
at each position and backtracks; whether two entries may stand side by side is
decided once per pair and kept. Two entries are compatible if merging their
joined bytes gives back just the two; a sequence of pairwise compatible entries
is the one that merging the whole piece gives.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import regex

# Cuts between matches of the pattern, whatever stands before them: before a space that is followed by
# anything but white space (no match goes on over it, and ` ?x+` begins at it), and on both sides of
# such a line feed (the last white space before a non-space that is no space is a match of its own).
_LOOSE = re.compile(r"[ \n](?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")
# Between a letter or digit and these characters there is a cut as well.
TAIL = ".,;:!?#$%&*|)]}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def units(text: str) -> tuple[list[str], list[bool] | None]:
    """Pieces of `text` between which no pattern match goes on, and which of them had a leading space
    that is left off here (None: all but the first and those that begin with a line feed)."""
    if _LOOSE.search(text) is None:
        return text.replace("\n", " \n").split(" "), None
    parts = _CUT.split(text)
    spaced = [p[:1] == " " and not p[1:2].isspace() and len(p) > 1 for p in parts]
    return [p[1:] if s else p for p, s in zip(parts, spaced)], spaced


class Memo:
    """A dict of bounded size for the ids of short units; begun anew when too little of a text is found in it."""

    def __init__(self, size: int, renew: float = 0.5):
        self.size, self.renew = size, renew
        self.known: dict[str, bytes] = {}

    def keep(self, made: dict[str, bytes], asked: int, missed: int) -> None:
        """Remember what was made for a group of which `missed` of `asked` units were not known."""
        if len(self.known) + len(made) > self.size:
            if missed < self.renew * asked:
                return
            self.known = {}  # the text has changed
        self.known.update((k, v) for k, v in made.items() if len(k) <= 64)


def encode_texts(texts: list[str], memo: Memo, spaced: Callable[[list[str]], list[bytes]],
                 others: Callable[[list[str]], list[bytes]], group_chars: int = 1 << 20) -> list[bytes]:
    """The ids of whole texts as bytes, from the ids of their units.

    spaced: ids of units that come after a space, which is left off, or that begin with a line feed (kept in
    `memo` if short); others: ids of any other units."""
    tails: dict[str, bytes] = {"": b""}
    ends = frozenset(TAIL)

    def without_tails(found: list[str]) -> dict[str, bytes]:
        """Ids of new units and of what they are without such ends."""
        stems = [u if u[-1:] not in ends else u.rstrip(TAIL) for u in found]
        cut = [k for k, s in enumerate(stems) if len(s) < len(found[k])]
        for k in cut:
            if not stems[k][-1:].isalnum():
                stems[k] = found[k]
        get = memo.known.get
        made = {stems[k]: get(stems[k]) for k in cut}  # what is known of the stems
        own = [s for s in dict.fromkeys(stems) if made.get(s) is None]
        made.update(zip(own, spaced(own)))
        new = {found[k][len(stems[k]):] for k in cut}.difference(tails)
        tails.update(zip(new, others(list(new))))
        made.update((found[k], made[stems[k]] + tails[found[k][len(stems[k]):]]) for k in cut)
        return made

    out: list[bytes] = []
    k = 0
    while k < len(texts):
        chars, z = 0, k
        while z < len(texts) and (z == k or chars + len(texts[z]) <= group_chars):
            chars += len(texts[z])
            z += 1
        get = memo.known.get
        group, lacking, rest, asked, missed = [], {}, [], 0, 0
        for t in texts[k:z]:
            parts, after = units(t)
            if after is None:
                ids = list(map(get, parts))
                ids[0] = None
                holes = [i for i, x in enumerate(ids) if x is None]
                rest.append(parts[0])
                lacking.update(dict.fromkeys([parts[i] for i in holes[1:]]))
            else:
                ids = [get(p) if s else None for p, s in zip(parts, after)]
                holes = [i for i, x in enumerate(ids) if x is None]
                rest += [parts[i] for i in holes if not after[i]]
                lacking.update(dict.fromkeys([parts[i] for i in holes if after[i]]))
            asked += len(parts)
            missed += len(holes)
            group.append((parts, after, ids, holes))
        made = without_tails(list(lacking))
        loose = iter(others(rest))
        for parts, after, ids, holes in group:
            for i in holes:
                ids[i] = next(loose) if (i == 0 if after is None else not after[i]) else made[parts[i]]
            out.append(b"".join(ids))
        memo.keep(made, asked, missed)
        k = z
    return out


class ByteBPE:
    """`ranks`: entry -> id in merge order, all 256 bytes included; ids below 2**20."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 450_000):
        self.ranks = ranks
        self.entry = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no entry for bytes {missing[:5]}")
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}  # by a << 20 | b
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int] = {}
        self._size = {i: len(t) for t, i in ranks.items()}
        self.memo = memo
        self._units = Memo(memo)

    # -- the merge tree -------------------------------------------------
    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """Plain merging of a short byte string with entries of rank less than `below`."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two entries whose merge makes entry i (None for a single byte)."""
        if i not in self._halves:
            t = self.entry[i]
            parts = self._merge(t, i) if len(t) > 1 else []
            if len(t) > 1 and len(parts) != 2:
                raise ValueError(f"entry {i} is not made by one merge of earlier entries")
            self._halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]]) if parts else None
        return self._halves[i]

    def shorter(self, i: int) -> int:
        """The longest entry that is a proper prefix of entry i, -1 if there is none."""
        if i not in self._shorter:
            t = self.entry[i]
            self._shorter[i] = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
        return self._shorter[i]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging never crosses the border between entries a and b.

        Looks at the border back in time: the newer of the two merges that end at
        the border is undone until both sides are single bytes. At each step the
        pair now facing the border may not merge before the merge just undone.
        Equal merges go from left to right: one inside `a` comes before one
        across the border, and that before one inside `b`."""
        x, y, limit, good = a, b, 1 << 62, True
        while True:
            across = self.ranks.get(self.entry[x] + self.entry[y])
            if across is not None and across < limit:
                good = False
                break
            hx, hy = self.halves(x), self.halves(y)
            if hx is None and hy is None:
                break
            if hy is None or (hx is not None and x > y):
                x, limit = hx[1], x
            else:
                y, limit = hy[0], y + 1
        self._fits[a << 20 | b] = good
        return good

    # -- encoding -------------------------------------------------------
    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pattern match."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i  # ends ascend, so the last one is the longest
        sizes, known, shorter = self._size, self._fits.get, self._shorter.get
        ids: list[int] = []
        closed: set[int] = set()  # positions from which no tiling goes on
        pos, i, last = 0, longest[0], -1
        while True:
            end = pos + sizes[i]
            if not closed or end not in closed:
                good = last < 0 or known(last << 20 | i)
                if good is None:
                    good = self.fits(last, i)
                if good:
                    ids.append(i)
                    if end == n:
                        return ids
                    last, pos, i = i, end, longest[end]
                    continue
            less = shorter(i)
            if less is None:
                less = self.shorter(i)
            if less < 0:
                closed.add(pos)
                less = ids.pop()
                pos -= sizes[less]
                last = ids[-1] if ids else -1
            i = less

    def _encode_unit(self, unit: str) -> bytes:
        out = array("I")
        for piece in self.pattern.findall(unit):
            out.extend(self.encode_piece(piece.encode()))
        return out.tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self._fits) > 600_000:
            self._fits.clear()
        one = self._encode_unit
        return encode_texts(texts, self._units, lambda us: [one(u if u[:1] == "\n" else " " + u) for u in us],
                            lambda us: list(map(one, us)))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each Python worker and vocabulary."""
    return ByteBPE(read_ranks(path), pattern)
