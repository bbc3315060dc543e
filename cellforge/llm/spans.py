"""SQL of left-to-right scans over an array within a row, for spans in long texts.

A fold that appends to one array copies it at each step, so its cost grows with the square of the
array. Here the array is cut into blocks; a fold over a block appends to a short array, and the blocks'
arrays are put together at the end.
"""

from __future__ import annotations

BLOCK = 128


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def scan(array: str, state: str, after: str, emit: str, element: str) -> str:
    """An array with ``emit`` for each x of ``array``: s.s is the state before x, at first ``state``, and ``after`` the one after it. ``element`` is the type of what is emitted."""
    blocks = f"transform(sequence(0, (size(whole) - 1) DIV {BLOCK}), b -> slice(whole, b * {BLOCK} + 1, {BLOCK}))"
    fold = f"""aggregate({blocks},
        named_struct('s', {state}, 'out', CAST(array() AS array<array<{element}>>)),
        (done, block) -> aggregate(block, named_struct('s', done.s, 'out', CAST(array() AS array<{element}>)),
            (s, x) -> named_struct('s', {after}, 'out', concat(s.out, array({emit}))),
            r -> named_struct('s', r.s, 'out', concat(done.out, array(r.out)))),
        done -> flatten(done.out))"""
    return let(array, "whole", fold)


def matches(text: str, pattern: str, group: int = 0) -> str:
    """(start, stop, len) of the leftmost matches of ``pattern`` that do not overlap, in code points, with the length of a group; placed by the pieces between them."""
    parts = f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), regexp_extract_all({text}, {pattern}, {group}))"
    sizes = f"transform({parts}, p -> named_struct('gap', length(p['0']), 'own', length(p['1']), 'len', length(p['2'])))"
    # The last piece has no match behind it.
    found = scan(sizes, "0", "s.s + x.gap + coalesce(x.own, 0)", "IF(x.own IS NULL, NULL, named_struct('start', s.s + x.gap, 'stop', s.s + x.gap + x.own, 'len', x.len))", "struct<start:int,stop:int,len:int>")
    return f"filter({found}, m -> m IS NOT NULL)"
