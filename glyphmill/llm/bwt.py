"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

Every round inserts one symbol of each string, last symbols first: the symbols in front of the suffixes
in the collection are its transform, and one stable counting pass over the transform gives the order that
the suffixes take when they are longer by that symbol. Two neighbours then have a common prefix that is
longer by one if they had one and got the same symbol.
"""

from __future__ import annotations

import numpy as np

#: Rounds after which suffixes that have no other one's prefix any more leave the collection.
_LEAVE = (10, 20, 34)
#: Free columns in front of the strings.
_FRONT = 2


def collection_suffixes(symbols: np.ndarray, lengths: np.ndarray, least: int, leave: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, run) of the suffixes with `least` symbols or more of a collection, in order of those symbols.

    symbols: bytes below 255, a row per string, the first `lengths` of each row (`least` or more) count.
    run: number of the suffix's run; neighbours whose common prefix has `least` symbols share one. With
    `leave` suffixes that are alone in their run may be missing.

    All strings end in the same round: until `least` rounds before that, the empty suffix of each string
    joins the collection when its turn comes; from there on no suffix joins, so that in the end those of
    `least` or more symbols are in it. Common prefixes are followed as far as they reach back to the first
    of those rounds. Rounds of this part insert two symbols at once where both are left.
    """
    n, widest = len(lengths), int(lengths.max(initial=0))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = widest + _FRONT
    text = np.zeros((n, width), np.uint8)  # zero: nothing stands in front of whole strings
    text[:, _FRONT:] = symbols[:, :widest]
    text[:, _FRONT:] += np.uint8(1)
    one = text.ravel()
    two = one[:-1].astype(np.uint16) << np.uint16(8) | one[1:]
    by = np.argsort(-lengths, kind="stable")
    kind = np.int64 if n * width >= 1 << 31 else np.int32
    empty, below = (by * width + _FRONT + lengths[by]).astype(kind), -lengths[by]
    place = empty[:0]  # string * width + column of every suffix, in order
    for round_ in range(widest - least + 1):
        place = place[np.argsort(one[place - 1], kind="stable")] - kind(1)
        place = np.concatenate([empty[: np.searchsorted(below, round_ - widest, "right")], place])
    run, done = np.zeros(len(place), np.int32), 0
    while done < least:
        step = min(2, least - done)
        front = two[place - 2] if step == 2 else one[place - 1]
        order = np.argsort(front, kind="stable")
        place, front, run = place[order] - kind(step), front[order], run[order]
        new = np.ones(len(place) + 1, bool)
        new[1:-1] = (front[1:] != front[:-1]) | (run[1:] != run[:-1])
        done += step
        if leave and done in _LEAVE:
            stay = ~(new[1:] & new[:-1])
            place, new = place[stay], np.append(new[:-1][stay], True)
        run = np.cumsum(new[:-1], dtype=np.int32)
    return place // width, place % width - _FRONT, run
