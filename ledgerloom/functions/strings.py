"""Edit distance of short strings."""

from __future__ import annotations


def deletions(word: str, depth: int) -> set[str]:
    """``word`` and what is left of it after deleting up to ``depth`` characters."""
    out = level = {word}
    for _ in range(depth):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def edits(a: str, b: str, most: int) -> int:
    """Damerau distance (neighbours swapped count once), or ``most + 1`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]
