"""Periodic run detection: a suffix automaton with small-to-large merging of end positions.

A run is a stretch of words with smallest period q that no neighbouring word
extends. In a task, each text becomes the automaton of its words. States are
gone through from long to short; the end positions of a state go into those of
its suffix link, the smaller set into the larger one, both kept in order. Two
positions that become neighbours in a state are ends of two occurrences of its
string: at a distance d no greater than its length they are a square, and the
stretch from the start of the first occurrence to the end of the second has
period d. Where two ends first meet, the string is the longest that both end
with, so the stretch can't be extended to the left; the one that can't be
extended to the right is the run. Neighbours have no occurrence in between, so
d is its smallest period.

Only stretches of a text in which some run can lie become an automaton: in a
run of exponent e, each three words in a row come up e - 1 times in the text.
No limit on length, period or number of runs is set. A text is one row and is
worked on by one task, in memory of the order of its words.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared

RUN = "struct<start:int,length:int,period:int>"


class Ends:
    """An ordered set of numbers in short sorted lists, so that an insertion moves few of them."""

    LONGEST = 1024

    def __init__(self, number: int) -> None:
        self.parts, self.firsts, self.size = [[number]], [number], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Puts x in and returns its neighbours."""
        k = max(bisect_left(self.firsts, x) - 1, 0)
        part = self.parts[k]
        i = bisect_left(part, x)
        before = part[i - 1] if i else self.parts[k - 1][-1] if k else None
        after = part[i] if i < len(part) else self.parts[k + 1][0] if k + 1 < len(self.parts) else None
        part.insert(i, x)
        self.firsts[k] = part[0]
        self.size += 1
        if len(part) > self.LONGEST:
            half = len(part) // 2
            self.parts[k : k + 1] = [part[:half], part[half:]]
            insort(self.firsts, part[half])
        return before, after

    def after(self, x: int) -> int | None:
        """The number that follows x."""
        k = max(bisect_left(self.firsts, x + 1) - 1, 0)
        i = bisect_left(self.parts[k], x + 1)
        return self.parts[k][i] if i < len(self.parts[k]) else self.parts[k + 1][0] if k + 1 < len(self.parts) else None

    def __iter__(self):
        for part in self.parts:
            yield from part


def automaton(words) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a sequence: length and suffix link of each state, and the state of each prefix."""
    length, link, step, prefix = [0], [-1], [{}], []
    last = 0
    for w in words:
        new, at = len(length), last
        length.append(length[last] + 1), link.append(0), step.append({})
        while at >= 0 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at >= 0:
            to = step[at][w]
            if length[to] > length[at] + 1:  # a state of its own for the shorter strings
                twin = len(length)
                length.append(length[at] + 1), link.append(link[to]), step.append(dict(step[to]))
                while at >= 0 and step[at].get(w) == to:
                    step[at][w] = twin
                    at = link[at]
                link[to] = twin
                to = twin
            link[new] = to
        last = new
        prefix.append(new)
    return length, link, prefix


def runs_of(words, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with length >= max(least, exponent * period), by start and period."""
    n = len(words)
    length, link, prefix = automaton(words)
    ends: dict[int, Ends] = {state: Ends(i) for i, state in enumerate(prefix)}
    seeds: dict[int, list[tuple[int, int]]] = {}
    found = []
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        own, up = ends.pop(state), link[state]
        for a, b in seeds.pop(state, ()):
            if own.after(a) == b:  # what came from a third state may lie in between
                found.append((a - length[state] + 1, length[state] + b - a, b - a))
        if up == 0:  # the empty string
            continue
        other = ends.get(up)
        if other is None:
            ends[up] = own
            continue
        small, large = (own, other) if own.size < other.size else (other, own)
        reach = length[up] // (exponent - 1)  # with a greater distance the exponent is too small
        new, last = [], None
        for x in small:
            before, after = large.add(x)
            new += [(p, q) for p, q in ((before, x), (x, after)) if p is not None and q is not None and p != last and q - p <= reach]
            last = x
        new = [(p, q) for p, q in new if q + 1 == n or words[q + 1] != words[p + 1]]  # else a later pair ends the run
        if new:
            seeds.setdefault(up, []).extend(new)
        ends[up] = large
    return sorted(r for r in set(found) if r[1] >= max(least, exponent * r[2]))


def stretches(codes, exponent: int, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of a coded text in which all its runs lie."""
    import numpy as np

    if len(codes) < max(least, exponent, 3):
        return []
    times = min(exponent - 1, max(least, exponent) - 2)
    if times < 2:
        return [(0, len(codes))]
    size = int(codes.max()) + 1
    pair = codes[:-1] * size + codes[1:]
    if size > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, code, count = np.unique(pair[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[code] >= times)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at, prepend=-9) > 3)
    return [(int(a), int(b) + 3) for a, b in zip(at[new], at[np.append(new[1:], len(at)) - 1])]


def text_runs(words: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """The runs of a list of words: (start, length, period), by start and period."""
    import numpy as np

    if exponent < 2 or least < 3:
        raise ValueError("a run has an exponent of 2 or more and three words or more")
    codes: dict = {}
    coded = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    return [(a + s, n, q) for a, b in stretches(coded, exponent, least) for s, n, q in runs_of(coded[a:b].tolist(), exponent, least)]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, x in zip(words, gone) if not x] if runs else words


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start, then period), kept_text.

    Words are runs of anything but ASCII white space and are compared by their
    bytes. A run has ``exponent`` periods and ``least`` words or more. Kept are
    the words that no run contains after its first period, joined by a space.
    Null and blank texts have no words, no runs and an empty kept_text. Rows are
    judged one by one: a null or repeated id and repeated rows change nothing,
    and each comes back. Other columns are not looked at, whatever their names.
    An empty table gives no rows.
    """

    def find(batches):
        import pyarrow as pa

        schema = pa.schema([("n_words", pa.int32()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))), ("kept_text", pa.string())])
        for batch in batches:
            for rows in _shared.row_slices(batch, "text"):
                out = []
                for text in rows.column("text").cast(pa.binary()):
                    words = text.as_py().split()
                    runs = text_runs(words, exponent, least)
                    out.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "kept_text": b" ".join(kept_words(words, runs)).decode()})
                made = pa.RecordBatch.from_pylist(out, schema=schema)
                yield pa.RecordBatch.from_arrays([rows.column("id"), *made.columns], ["id", *schema.names])

    text = _shared.text_of(text_column).alias("text")
    fields = T._parse_datatype_string(f"n_words int, runs array<{RUN}>, kept_text string").fields
    return docs.select(F.col(id_column).alias("id"), text).transform(_shared.in_arrow, find, T.StructType([T.StructField("id", docs.schema[id_column].dataType), *fields]))
