"""Periodic stretches of a document's words, found in a Re-Pair grammar.

The words of a batch of documents become ids, and the ids a grammar: in each round pairs of neighbouring symbols that
occur again turn into new symbols, where a pair is replaced if no pair that overlaps it is more frequent. Rounds end when
no pair occurs twice; pairs never cross documents. A run lies in some smallest symbol, crossing the border of its two
parts, or crosses a border of the final sequence. So each border is searched once, at the first place of its symbol:

- A run that crosses border b with at least half its length on one side, and that repeats three times, holds the words
  around b again one period away: five words, or half the period if that is more. Equal stretches at that distance are
  looked up (by comparing for short periods, by the next equal stretch for longer ones), which gives the periods to try.
- How far a period reaches to both sides inside the symbol is found by bisection over hashes of prefixes.

What is found in a symbol is carried to all places the symbol was derived at, stretches that go on beyond the symbol are
left to the larger symbol, equal stretches merge, and what is left is compared word by word.

Null and blank texts have no words and no runs. A null key is drawn as if its digits were empty. Rows are independent, so repeated rows give
repeated results, and a table without rows gives none; columns besides key and text are not read. A batch is WORDS words, or one longer document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace.llm.common import small_batches

LEAST = 24  # words of a run
TIMES = 3  # periods in a run
WORDS = 1 << 18  # words of a batch
NEAR = 16  # shorter periods are tried by comparing
AROUND = 5  # words around a border that recur one short period away

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x2545F491
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Prefixes:
    """Hashes of all stretches of a sequence, equal for equal stretches. They propose; words are compared in the end."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up = np.full(n + 1, _BASE, np.uint64)
        back = np.full(n + 1, _BACK, np.uint64)
        up[0] = back[0] = 1
        self.up, self.back = np.cumprod(up), np.cumprod(back)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.up[:-1], out=self.sums[1:])

    def stretch(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from a and b on are equal, at most `most`; backwards, before a and b, for a step of -1."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) >> 1
            back = middle if step < 0 else 0
            same = self.stretch(a[open_] - back, middle) == self.stretch(b[open_] - back, middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low


def grammar(words: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Re-Pair over all documents. For each round the rules made, as first place, border and end of each, with the place of
    every occurrence and its rule; and where the symbols of the final sequence begin. Documents begin at `starts`."""
    symbols, at = words.astype(np.int64), np.arange(len(words))
    opens = np.zeros(len(words) + 1, bool)
    opens[starts[starts < len(words)]] = True
    fresh = int(symbols.max(initial=-1)) + 1
    live = ~opens[1:-1] if len(words) else np.zeros(0, bool)
    rounds = []
    while len(places := np.flatnonzero(live)):
        kind, pairs = pd.factorize((symbols[places] << 32) | symbols[places + 1])
        times = np.bincount(kind, minlength=len(pairs))
        often = times[kind] > 1
        live[places[~often]] = False  # a pair that stands alone only recurs where a symbol changes
        places, kind = places[often], kind[often]
        if not len(places):
            break
        rank = np.zeros(len(live) + 2, np.int64)
        # Equally frequent pairs in no order of the text, or a repeated passage would shrink by one pair a round.
        bits = len(pairs).bit_length()
        rank[places + 1] = (times[kind] << bits) + ((kind + 1) * _ODD & ((1 << bits) - 1))
        here, left, right = rank[places + 1], rank[places], rank[places + 2]
        # In a stretch of one repeated symbol every other pair is taken, beginning where no greater pair is in the way.
        heads = np.flatnonzero(here != left)
        stretch = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(places))))
        offset = places - places[heads][stretch] - (left[heads] > here[heads])[stretch]
        take = (offset >= 0) & (offset % 2 == 0) & (right <= here)
        places, kind = places[take], kind[take]
        ends = np.append(at, len(words))[places + 2]
        rule, _ = pd.factorize(kind)
        first = np.empty(rule.max() + 1, np.int64)
        first[rule[::-1]] = np.arange(len(rule))[::-1]
        rounds.append((at[places[first]], at[places[first] + 1], ends[first], at[places], rule))
        symbols[places] = fresh + rule
        fresh += len(first)
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[places] = True
        after = np.append(live, False)
        after[places] = after[places + 1]
        symbols, at, changed, after = symbols[stays], at[stays], changed[stays], after[stays]
        live = (after[:-1] | changed[:-1] | changed[1:]) & ~opens[at[1:]]
    return rounds, at


def _periods(words: np.ndarray, prefixes: Prefixes, starts: np.ndarray, low: np.ndarray, border: np.ndarray, high: np.ndarray):
    """(node, anchor, period) to try: words at the anchor and one period on are equal, inside the node."""
    size = high - low
    five = prefixes.stretch(np.arange(max(0, len(words) - AROUND + 1)), AROUND)
    for period in range(1, NEAR):
        able = np.flatnonzero(size >= max(LEAST, TIMES * period))
        at = border[able] - 1
        fits = able[at + period + AROUND <= high[able]]
        at = border[fits] - 1
        hit = fits[five[at] == five[at + period]]
        yield hit, border[hit] - 1, np.full(len(hit), period)
        at = border[able] - AROUND + 1
        fits = able[(at - period >= low[able]) & (at + AROUND <= high[able])]
        at = border[fits] - AROUND + 1
        hit = fits[five[at] == five[at - period]]
        yield hit, border[hit] - period, np.full(len(hit), period)

    # Stretches of half the least period, doubled in each round; those that are the only ones of their kind in a document drop out.
    long, reach = NEAR // 2, NEAR
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    places = np.arange(len(words))
    while len(able := np.flatnonzero(size >= TIMES * reach)):
        places = places[places + long <= starts[document[places] + 1]]
        kind = prefixes.stretch(places, long)
        order = np.argsort(kind, kind="stable")
        places, kind = places[order], kind[order]
        same = (kind[1:] == kind[:-1]) & (document[places[1:]] == document[places[:-1]])
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if not again.any():
            return
        kept = np.flatnonzero(again)
        rows = np.full(len(words), -1)
        places, kind = places[kept], kind[kept]
        rows[places] = np.arange(len(kept))
        for step in (1, -1):
            at = border[able] - 1 if step > 0 else border[able] - long + 1
            node = able[at >= low[able]]
            row = rows[border[node] - 1 if step > 0 else border[node] - long + 1]
            node, row = node[row >= 0], row[row >= 0]
            other = row + step * (1 + _repeats(prefixes, starts, document, places, kind, row, step, long))
            while len(node):
                inside = (other >= 0) & (other < len(kept))
                node, row, other = node[inside], row[inside], other[inside]
                away = (places[other] - places[row]) * step
                on = (kind[other] == kind[row]) & (away < 2 * reach)
                on &= (places[other] + long <= high[node]) & (places[other] >= low[node])
                node, row, other, away = node[on], row[on], other[on], away[on]
                far = away >= reach
                anchor = places[row] if step > 0 else places[other] + long - 1
                yield node[far], anchor[far], away[far]
                other = other + step
        places = np.sort(places)
        long, reach = 2 * long, 2 * reach


def _repeats(prefixes, starts, document, places, kind, row, step, long) -> np.ndarray:
    """Equal stretches to pass over: those in one shorter period with the stretch of the row, at multiples of it, where
    a longer period would not be the smallest."""
    passed = np.zeros(len(row), np.int64)
    other = np.clip(row + step, 0, len(places) - 1)
    away = (places[other] - places[row]) * step
    near = np.flatnonzero((kind[other] == kind[row]) & (away > 0) & (2 * away <= long))
    place, away = places[row[near]], away[near]
    if step > 0:
        on = prefixes.reach(place, place + away, starts[document[place] + 1] - place - away, 1)
        passed[near] = (away + on - long) // away
    else:
        back = prefixes.reach(place - away, place, place - away - starts[document[place]], -1)
        passed[near] = (away + back) // away
    return passed


def _smallest(keys: tuple[np.ndarray, ...], period: np.ndarray) -> np.ndarray:
    """Rows of the smallest period for each combination of keys, in order of the keys."""
    order = np.lexsort((period, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order[new]


def find_runs(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and period of all runs in documents laid end to end, by start, then period. `starts` closes with the number of words."""
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none
    rounds, final = grammar(words, starts)
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    borders = final[1:][document[final[1:]] == document[final[1:] - 1]]
    low = np.concatenate([*(r[0] for r in rounds), starts[document[borders]]])
    border = np.concatenate([*(r[1] for r in rounds), borders])
    high = np.concatenate([*(r[2] for r in rounds), starts[document[borders] + 1]])

    prefixes = Prefixes(words)
    found = []
    for node, anchor, period in _periods(words, prefixes, starts, low, border, high):
        if len(node):
            on = prefixes.reach(anchor, anchor + period, high[node] - anchor - period, 1)
            back = prefixes.reach(anchor, anchor + period, anchor - low[node], -1)
            begin, end = anchor - back, anchor + on + period
            long = end - begin >= np.maximum(LEAST, TIMES * period)
            found.append(np.stack([node, begin, end, period])[:, long])
    if not found:
        return none, none, none
    node, begin, end, period = np.concatenate(found, 1)
    node, begin, end, period = (x[_smallest((node, begin, end), period)] for x in (node, begin, end, period))

    # To all places of the symbol. Each round numbers its rules after those of the rounds before it.
    carried = []
    offset = 0
    for _first, _border, _end, places, rule in rounds:
        count = len(_first)
        own = np.flatnonzero((node >= offset) & (node < offset + count))
        if len(own):
            order = np.argsort(rule, kind="stable")
            from_, to = (np.searchsorted(rule[order], node[own] - offset, side) for side in ("left", "right"))
            width = to - from_
            which = np.repeat(own, width)
            place = places[order][np.arange(width.sum()) + np.repeat(from_ - (np.cumsum(width) - width), width)]
            shift = place - low[node[which]]
            carried.append(np.stack([begin[which] + shift, end[which] + shift, period[which]]))
        offset += count
    own = node >= offset
    carried.append(np.stack([begin[own], end[own], period[own]]))
    begin, end, period = np.concatenate(carried, 1)

    first, last = starts[document[begin]], starts[document[begin] + 1]
    longer = (begin > first) & (words[begin - 1] == words[begin - 1 + period])
    longer |= (end < last) & (words[np.minimum(end, len(words) - 1)] == words[end - period])
    begin, end, period = begin[~longer], end[~longer], period[~longer]
    kept = _smallest((begin, end), period)
    begin, end, period = begin[kept], end[kept], period[kept]
    for b, e, q in zip(begin.tolist(), end.tolist(), period.tolist()):
        if not np.array_equal(words[b : e - q], words[b + q : e]):
            raise ArithmeticError("two different stretches of words have one hash; change the base of the hashes")
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def planted(n: int, key: int | None) -> np.ndarray | None:
    """The original place of each word of a document whose end is made periodic; None for other documents."""
    drawn = zlib.crc32(str("" if key is None else key).encode())
    if drawn % 10 or not n:
        return None
    g = drawn // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % period
    return place


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids of all words, where each text's begin (closed by their number), and the words by id."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    every = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    real = pc.greater(pc.binary_length(every), 0)
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(lists))
    coded = every.filter(real).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), coded.dictionary


COLUMNS = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FORMAT = pa.schema(
    [
        *((n, pa.int64()) for n in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        ("runs", pa.list_(RUN)),
        ("collapsed", pa.large_string()),
    ]
)


def describe(keys: list[int | None], texts: pa.Array, plant: bool) -> pa.RecordBatch:
    """Runs of each text, the strongest of them, and the text with every run cut to its first period."""
    words, starts, vocabulary = split_words(texts)
    if plant:
        for i, key in enumerate(keys):
            place = planted(int(starts[i + 1] - starts[i]), key)
            if place is not None:
                words[starts[i] : starts[i + 1]] = words[starts[i] + place]
    begin, end, period = find_runs(words, starts)
    edges = np.searchsorted(begin, starts)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[starts]
    collapsed = pa.ListArray.from_arrays(pa.array(left, pa.int32()), vocabulary.take(pa.array(words[kept])))
    rows = []
    for i, key in enumerate(keys):
        own = slice(edges[i], edges[i + 1])
        runs = list(zip((begin[own] - starts[i]).tolist(), (end[own] - begin[own]).tolist(), period[own].tolist()))
        best = (None,) * 4
        for start, length, q in runs:  # the first of equal exponents stays
            if best[0] is None or length * best[2] > best[1] * q:
                best = (start, length, q, 1000 * length // q)
        rows.append((key, int(starts[i + 1] - starts[i]), len(runs), *best, [dict(zip(("start", "length", "period"), r)) for r in runs]))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, FORMAT)]
    return pa.RecordBatch.from_arrays([*columns, pc.binary_join(collapsed, pa.scalar(" ", pa.large_string()))], schema=FORMAT)


def periodic(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed), one for each row of `docs`.

    With `plant`, documents drawn by their key get a periodic end first, so that there is something to find.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            # A word takes two bytes at least, and hardly less than six on average.
            upto = np.cumsum(pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False)) // (6 * WORDS)
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield describe(part.column(0).slice(a, b - a).to_pylist(), part.column(1).slice(a, b - a), plant)

    return rows.mapInArrow(batches, COLUMNS)


def run_rows(docs: DataFrame) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return periodic(docs, plant=True).select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
