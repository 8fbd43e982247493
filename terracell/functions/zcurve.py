"""Boxes of tiles and time as ranges of the Z-order key.

The key interleaves time, y and x from the least significant bit (see grid.z_index). It grows with each
coordinate, so the keys of a box lie between those of its two corners; inside that, the curve leaves the box and
comes back. Ranges that follow it let a scan skip what lies between.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: bits of time, y and x
BITS = (42, 21, 21)

Box = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


def z_value(t: int, y: int, x: int) -> int:
    """The key of one place, as a plain number."""
    key = 0
    for d, value in enumerate((t, y, x)):
        for i in range(value.bit_length()):
            key |= (value >> i & 1) << (3 * i + d)
    return key


def volume(box: Box) -> int:
    return reduce(lambda a, b: a * b, (high - low + 1 for low, high in box))


def overlap(a: Box, b: Box) -> Box | None:
    found = tuple((max(p[0], q[0]), min(p[1], q[1])) for p, q in zip(a, b))
    return None if any(low > high for low, high in found) else found


def z_ranges(time: tuple[int, int], y: tuple[int, int], x: tuple[int, int], max_ranges: int = 64) -> list[tuple[int, int]]:
    """Closed ranges of the key, ascending and apart, that hold every place of the box, at most max_ranges of them.

    The space is halved bit by bit of the key. A half outside the box goes, one inside is a range, and of the others
    the one with the most places outside the box is halved next. What is left when max_ranges are reached is a
    range from the least to the largest key of its part of the box, so ranges hold more than the box only where the budget ends.
    """
    limits = tuple((0, (1 << bits) - 1) for bits in BITS)
    wanted = overlap((time, y, x), limits)
    if wanted is None:
        return []
    done: list[Box] = []
    # waste, number (for ties), part of the box, node, bits of the key that are open in the node
    open_parts: list[tuple[int, int, Box, Box, int]] = []
    made = 0

    def add(part: Box, node: Box, bit: int) -> None:
        nonlocal made
        made += 1
        waste = volume(node) - volume(part)
        if waste:
            heapq.heappush(open_parts, (-waste, made, part, node, bit))
        else:
            done.append(part)

    add(wanted, limits, 3 * max(BITS) - 1)
    while open_parts and len(done) + len(open_parts) < max_ranges:
        _, _, part, node, bit = heapq.heappop(open_parts)
        d = bit % 3
        while bit // 3 >= BITS[d]:  # y and x have no bits this high
            bit -= 1
            d = bit % 3
        low, high = node[d]
        middle = (low + high + 1) // 2
        for half in ((low, middle - 1), (middle, high)):
            child = (*node[:d], half, *node[d + 1 :])
            inside = overlap(wanted, child)
            if inside is not None:
                add(inside, child, bit - 1)
    parts = sorted((z_value(*(p[0] for p in part)), z_value(*(p[1] for p in part))) for part in [*done, *(o[2] for o in open_parts)])
    joined: list[tuple[int, int]] = []
    for low, high in parts:
        if joined and low <= joined[-1][1] + 1:
            joined[-1] = joined[-1][0], max(joined[-1][1], high)
        else:
            joined.append((low, high))
    return joined


def in_z_ranges(key, ranges: list[tuple[int, int]]) -> Column:
    """Whether a stored key lies in one of the ranges: plain comparisons, which reach the files' statistics."""
    key = F.col(key) if isinstance(key, str) else key

    def number(value: int) -> Column:
        return F.lit(str(value)).cast("decimal(38,0)")

    tests = [(key >= number(low)) & (key <= number(high)) for low, high in ranges]
    while len(tests) > 1:  # a balanced tree of ORs, so that its depth stays small
        tests = [reduce(lambda a, b: a | b, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)
