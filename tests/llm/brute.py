"""Plain versions of operators that SQL can't express."""

from collections import Counter


def repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_lines(rows: list[tuple[int, str | None]], most: int, min_chars: int, shorter: bool = False) -> dict[int, tuple]:
    """key -> (text, lines, same, near); keys are unique. With ``shorter`` lines of any length but blank ones go if an earlier one is equal."""
    counts = lambda line: len(line) >= min_chars or shorter and line.strip(" \t\n\x0b\f\r") != ""
    first: dict[str, tuple[int, int]] = {}
    for k, text in sorted(rows):
        for at, line in enumerate((text or "").split("\n")):
            if counts(line):
                first.setdefault(line, (k, at))
    by_size: dict[int, list[str]] = {}
    for line in filter(lambda x: len(x) >= min_chars, first):
        by_size.setdefault(len(line), []).append(line)
    near = {s for s in first if len(s) >= min_chars for n in range(len(s) - most, len(s) + most + 1) for r in by_size.get(n, [])
            if first[r] < first[s] and edits(r, s) <= most}
    out = {}
    for k, text in rows:
        if text is None:
            out[k] = (None, 0, 0, 0)
            continue
        parts, left, n_same, n_near = text.split("\n"), [], 0, 0
        for at, line in enumerate(parts):
            if line in near:
                n_near += 1
            elif counts(line) and first[line] != (k, at):
                n_same += 1
            else:
                left.append(line)
        out[k] = ("\n".join(left), len(parts), n_same, n_near)
    return out
