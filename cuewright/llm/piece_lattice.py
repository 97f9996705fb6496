"""The lattice of pieces over a text, and its max-plus transfer matrices.

A path through the lattice is a sequence of pieces. A step from piece a to piece
b weighs 0 if merging the two pieces' characters gives exactly [a, b], else minus
infinity; the sum along a path is 0 for the sequence that byte-pair merging
makes, and minus infinity for all others, as a sequence is the merged one if all
its neighbours are. With such weights a score is one bit, so a row of scores
over all entry states is an integer used as a bit set; "max" is |.

A boundary between chunks is crossed by one piece (i, j) with i < boundary <= j.
It is the state there. The transfer matrix of a chunk says which exit states
follow from which entry states. Where a word begins no piece crosses and nothing
depends on what came before: the state is CUT.
"""

from __future__ import annotations

import re

SPACE = "▁"
#: A run of spaces and the word behind it; pieces never cross from a word into a space.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CUT = (0, 0)
#: Characters outside the vocabulary get numbers from here on.
FOREIGN = 1 << 20
#: Pairs remembered, and the score of what cannot merge.
PAIRS = 300_000
NEVER = float("-inf")


class Vocabulary:
    """Pieces and scores of a byte-pair model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("expected a byte-pair model with byte fallback and no normalisation")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.longest = max(map(len, self.ids))
        #: Number of every prefix of a piece: -1 where merging does not make it one piece.
        self.steps = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)}
        self._histories: dict[int, list] = {}
        self.ends: dict[str, int] = {}
        self._fits: dict[int, bool] = {}
        self.steps.update((p, i) for p, i in self.ids.items() if len(self.merged(p)) == 1)

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def merged(self, chars: str) -> list[str]:
        """Byte-pair merging of a few characters: best score first, leftmost of equal ones."""
        parts, scores = list(chars), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, piece: str) -> int:
        """Number of a piece that merging makes, else -1; a single character always has one."""
        found = self.steps.get(piece, -1)
        return FOREIGN + ord(piece) if found < 0 and len(piece) == 1 else found

    def history(self, number: int) -> list[tuple[float, str, str]]:
        """(score, first part, last part) after each merge that makes a piece; the first entry is its characters."""
        known = self._histories.get(number)
        if known is None:
            parts, scores = list(self.text_of(number)), self.scores
            known = [(0.0, parts[0], parts[-1])]
            while len(parts) > 1:
                score, at = max((s, -k) for k in range(len(parts) - 1) if (s := scores.get(parts[k] + parts[k + 1])) is not None)
                parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
                known.append((score, parts[0], parts[-1]))
            self._histories[number] = known
        return known

    def text_of(self, number: int) -> str:
        return chr(number - FOREIGN) if number >= FOREIGN else self.pieces[number]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of both gives [a, b].

        Each side goes through its own merges, best score first, the left side
        at ties. They do not fit if the parts at the seam would merge before.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = a >= FOREIGN or b >= FOREIGN or self._apart(self.history(a), self.history(b))
        return known

    def _apart(self, left: list, right: list) -> bool:
        i, j, seam = 1, 1, self.scores.get(left[0][2] + right[0][1], NEVER)
        while True:
            one = left[i][0] if i < len(left) else NEVER
            two = right[j][0] if j < len(right) else NEVER
            if seam > one and seam >= two:
                return False
            if one == two == NEVER:
                return True
            if one >= two:
                i += 1
            else:
                j += 1
            seam = self.scores.get(left[i - 1][2] + right[j - 1][1], NEVER)

    def ids_of(self, number: int) -> list[int]:
        return [number] if number < FOREIGN else [self.bytes[b] for b in chr(number - FOREIGN).encode("utf-8")]


def forward(v: Vocabulary, text: str, begin: int, end: int, entry: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int, int]]]:
    """Live pieces by their end: (start, number, bits).

    ``entry`` has the bits of the pieces that cross ``begin``, as absolute
    (start, end); a piece is followed if it starts before ``end``.
    """
    live: dict[int, list[tuple[int, int, int]]] = {}
    for (i, j), bits in entry.items():
        live.setdefault(j, []).append((i, v.number(text[i:j]) if j > i else -1, bits))
    number, fits, limit = v.number, v.fits, len(text)
    for at in range(begin, end):
        before = live.get(at)
        if not before:
            continue
        for stop in range(at + 1, min(limit, at + v.longest) + 1):
            piece = number(text[at:stop])
            if piece < 0:
                continue
            bits = 0
            for _, last, b in before:
                if last < 0 or fits(last, piece):
                    bits |= b
            if bits:
                live.setdefault(stop, []).append((at, piece, bits))
    return live


def crossing(v: Vocabulary, text: str, at: int) -> list[tuple[int, int]]:
    """All pieces that may cross a boundary, as (start, end) relative to it."""
    found = []
    for i in range(max(0, at - v.longest), at):
        for j in range(at, min(len(text), i + v.longest) + 1):
            if j > i and v.number(text[i:j]) >= 0:
                found.append((i - at, j - at))
    return found


def exits(live: dict, end: int, hard: bool) -> dict[tuple[int, int], int]:
    """Bits of the states at ``end``; at a soft boundary all arrivals are one state."""
    out: dict[tuple[int, int], int] = {}
    if not hard:
        bits = 0
        for _, _, b in live.get(end, []):
            bits |= b
        return {CUT: bits} if bits else {}
    for stop, arrivals in live.items():
        if stop >= end:
            for start, _, bits in arrivals:
                if start < end:
                    state = (start - end, stop - end)
                    out[state] = out.get(state, 0) | bits
    return out


def transfer(v: Vocabulary, text: str, begin: int, end: int, hard_in: bool, hard_out: bool) -> dict:
    """Max-plus matrix of a chunk: the set of (entry, exit) that have weight 0."""
    states = crossing(v, text, begin) if hard_in else [CUT]
    entry = {(begin + i, begin + j): 1 << k for k, (i, j) in enumerate(states)}
    out = exits(forward(v, text, begin, end, entry), end, hard_out)
    return {(s, state) for state, bits in out.items() for k, s in enumerate(states) if bits >> k & 1}


def product(a: set, b: set) -> set:
    """Max-plus product of two matrices; associative."""
    rows: dict = {}
    for mid, out in b:
        rows.setdefault(mid, []).append(out)
    return {(first, out) for first, mid in a for out in rows.get(mid, [])}


def path(v: Vocabulary, text: str, begin: int, end: int, entry: tuple[int, int], leave: tuple[int, int], hard_out: bool) -> list[int]:
    """Numbers of the pieces that start in the chunk, on the path from one state to another."""
    live = forward(v, text, begin, end, {(begin + entry[0], begin + entry[1]): 1})
    if hard_out:
        goal = (end + leave[0], end + leave[1])
        start, piece = next((s, p) for s, p, _ in live[goal[1]] if s == goal[0])
    else:
        start, piece, _ = live[end][-1]
    back = []
    while start >= begin and piece >= 0:
        back.append(piece)
        arrivals = live.get(start, [])
        found = [(s, p) for s, p, _ in arrivals if p < 0 or v.fits(p, piece)]
        if not found:
            break
        start, piece = found[-1]
    return back[::-1]


def last_piece(v: Vocabulary, text: str) -> int:
    """The piece that ends at the end of a word's beginning: the one live piece there.

    Each beginning has one merged form, so this is a function of the beginning
    alone and is remembered across words.
    """
    found = v.ends.get(text)
    if found is not None:
        return found
    n, steps, known = len(text), v.steps, v._fits
    for start in range(max(0, n - v.longest), n):
        piece = steps.get(text[start:], -1)
        if piece < 0:
            if start < n - 1:
                continue
            piece = FOREIGN + ord(text[start])
        if start:
            before = last_piece(v, text[:start])
            good = known.get(before << 32 | piece)
            if not (v.fits(before, piece) if good is None else good):
                continue
        break
    if len(v.ends) >= PAIRS:
        v.ends.clear()
    v.ends[text] = piece
    return piece


def unit_numbers(v: Vocabulary, unit: str) -> list[int]:
    """Pieces of one whole word, from its end."""
    if len(unit) > 64:
        return long_unit_numbers(v, unit)
    out = []
    while unit:
        piece = last_piece(v, unit)
        out.append(piece)
        unit = unit[: len(unit) - (1 if piece >= FOREIGN else len(v.pieces[piece]))]
    return out[::-1]


def long_unit_numbers(v: Vocabulary, unit: str) -> list[int]:
    """The same by one walk ahead, without remembering beginnings."""
    steps, known, n = v.steps, v._fits, len(unit)
    last: list = [None] * (n + 1)
    begun = [0] * (n + 1)
    last[0] = -1
    for at in range(n):
        before = last[at]
        if before is None:
            continue
        for stop in range(at + 1, n + 1):
            piece = steps.get(unit[at:stop])
            if piece is None or piece < 0:
                if stop == at + 1:
                    piece = FOREIGN + ord(unit[at])
                elif piece is None:
                    break
                else:
                    continue
            if before >= 0:
                good = known.get(before << 32 | piece)
                if not (v.fits(before, piece) if good is None else good):
                    continue
            last[stop], begun[stop] = piece, at
    out, at = [], n
    while at:
        out.append(last[at])
        at = begun[at]
    return out[::-1]
