"""Runs (maximal periodic stretches) of the words of each text, found over a Re-Pair grammar.

Words of a text are numbered and compressed by Re-Pair until no neighbouring pair is left that
occurs twice in its text. A run lies in a smallest nonterminal (or in the start rule alone) whose
inner boundary it crosses, so the runs over each boundary are computed once, at the rule's first
place, translated to all places where the rule was used, and merged where they overlap by a period.
Texts are worked on in groups of a bounded number of words; a text is never divided, and its words
have symbols of their own, so nothing is shared between texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words at least, and twice its period.
LEAST_LENGTH = 12
#: Words after which a group of texts is worked on.
GROUP_WORDS = 500_000
#: Periods below twice this are tried at every boundary; longer ones come from repeated word sequences
#: beside the boundary, of this length and its doublings.
GRAM = 8

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def changed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that are searched: of every tenth document (by crc32 of its id) the end is made periodic."""
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def numbered(words: list[bytes], offset: int) -> np.ndarray:
    """A number for each word, equal for equal words of this text and used by no other text."""
    last = dict(zip(words, range(len(words))))
    return np.fromiter(map(last.__getitem__, words), dtype=np.int64, count=len(words)) + offset


def re_pair(ids: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Grammar of texts that begin at `starts` in `ids`; texts share no symbol.

    In a round, a pair is replaced where it is more frequent than the pairs that overlap it (ties by
    a hash of the pair), so the most frequent pair always is. Only pairs that were found twice or hold
    a new symbol are looked at again. Returns of each rule its first place (`lo`, `mid`, `hi`), of each
    use its rule and place (`used`, `place`), and where the symbols of the start rules begin (`top`).
    """
    n = len(ids)
    seq, begin = ids.copy(), np.arange(n + 1)
    ends_text = np.zeros(n, dtype=bool)
    ends_text[np.r_[starts[1:], n] - 1] = True
    often = np.bincount(ids, minlength=n)[ids] > 1
    active = np.zeros(n, dtype=bool)
    active[:-1] = often[:-1] & often[1:] & ~ends_text[:-1]
    made = n
    los, mids, his, used, places = [], [], [], [], []
    while True:
        at = np.flatnonzero(active)
        if not len(at):
            break
        pairs, which, count = np.unique(
            (seq[at] << 32) | seq[at + 1], return_inverse=True, return_counts=True
        )
        active[at[count[which] < 2]] = False
        keep = count[which] > 1
        at, which = at[keep], which[keep]
        if not len(at):
            break
        mix = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        weight = (np.minimum(count, (1 << 22) - 1).astype(np.int64) << 40) | mix.astype(np.int64)
        of = weight[which]
        # stretches of one pair that overlaps itself, at neighbouring places
        head = np.r_[True, (np.diff(at) > 1) | (which[1:] != which[:-1])]
        first = np.flatnonzero(head)
        size = np.diff(np.r_[first, len(at)])
        touch_left = np.r_[False, np.diff(at) == 1][first]
        touch_right = np.r_[touch_left[1:], False]
        value = of[first]
        before, after = np.r_[-1, value[:-1]], np.r_[value[1:], -1]
        best = (~touch_left | (value > before)) & (~touch_right | (value > after))
        offset = np.arange(len(at)) - np.repeat(first, size)
        chosen = np.repeat(best, size) & (offset % 2 == 0)
        at, which = at[chosen], which[chosen]
        if not len(at):  # only pairs of one weight beside each other, which their hash cannot order
            break
        rule, where, name = np.unique(which, return_index=True, return_inverse=True)
        los.append(begin[at[where]])
        mids.append(begin[at[where] + 1])
        his.append(begin[at[where] + 2])
        used.append(made - n + name)
        places.append(begin[at])
        seq[at] = made + name
        made += len(rule)
        ends_text[at] = ends_text[at + 1]
        active[at] = True
        active[np.maximum(at - 1, 0)] = True
        left = np.ones(len(seq), dtype=bool)
        left[at + 1] = False
        seq, ends_text, active = seq[left], ends_text[left], active[left]
        begin = np.r_[begin[:-1][left], n]
        active &= ~ends_text
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return {
        "lo": join(los), "mid": join(mids), "hi": join(his),
        "used": join(used), "place": join(places), "top": begin[:-1],
    }


class _Words:
    """Word numbers with prefix hashes: how far equality at a distance goes from given places."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.ids = ids
        a, b = (np.uint64(x) | np.uint64(1) for x in rng.integers(1 << 62, size=2))
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * a
        mixed ^= mixed >> np.uint64(29)
        self.mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        self.power = np.r_[np.uint64(1), np.cumprod(np.full(len(ids), b, dtype=np.uint64))]
        self.prefix = np.r_[np.uint64(0), np.cumsum(self.mixed * self.power[:-1])]

    def same(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.ids[i] == self.ids[i + q]

    def _equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        there = i + q
        one = self.prefix[i + length] - self.prefix[i]
        return one * self.power[q] == self.prefix[there + length] - self.prefix[there]

    def _most(self, most: np.ndarray, holds) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def stretch(self, i: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
        """[start, end) of the stretch in [lo, hi) around `i` that has period `q`."""
        left = self._most(i - lo, lambda k: self._equal(i - k, q, k))
        right = self._most(hi - q - i, lambda k: self._equal(i, q, k))
        return i - left, i + right + q


def _short(words: _Words, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """(boundary, place, period) of possible runs with periods below 2 * GRAM."""
    ids, last = words.ids, len(words.ids) - 1
    for q in range(1, 2 * GRAM):
        for shift in (1, q) if q > 1 else (1,):
            fits = (mid - 1 + q < hi) if shift == 1 else (mid - q >= lo)
            b = np.flatnonzero(fits & (ids[mid - np.minimum(shift, mid)] == ids[np.minimum(mid - shift + q, last)]))
            i = mid[b] - shift
            # a run repeats six words or more: of five places around, three in a row are equal at distance q
            near = [np.ones(len(b), dtype=bool)]
            for step in (-2, -1, 1, 2):
                x = i + step
                inside = (x >= lo[b]) & (x + q < hi[b])
                x = np.where(inside, x, i)
                near.append(inside & (ids[x] == ids[x + q]))
            own, l2, l1, r1, r2 = near
            b = b[own & ((l2 & l1) | (l1 & r1) | (r1 & r2))]
            yield b, mid[b] - shift, np.full(len(b), q)


def _long(words: _Words, starts: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """The same for longer periods: in a run with period q >= 2 * k, the k words before or after any
    inner boundary occur again at distance q. Each k takes the distances from 2 * k to 4 * k."""
    n = len(words.ids)
    text_end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    gram, k = words.mixed, 1
    odd = np.uint64(0xD6E8FEB86659FD93)
    where = None
    while True:
        # hash of k words at each place that may still repeat, from two halves
        if where is None:
            grown = (gram[:-k] * odd + gram[k:]) * np.uint64(0x9E3779B97F4A7C15)
            gram = np.r_[grown ^ (grown >> np.uint64(31)), np.zeros(min(k, n), dtype=np.uint64)] if n > k else gram
        else:
            second = np.searchsorted(where, where + k)
            found = (second < len(where)) & (where[np.minimum(second, len(where) - 1)] == where + k)
            one, two = gram[found], gram[second[found]]
            where = where[found]
            gram = (one * odd + two) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(31)
        k *= 2
        if k < GRAM:
            continue
        if where is None:
            where = np.flatnonzero(np.arange(n) + k <= text_end)
            gram = gram[where]
            bits = max(10, int(n).bit_length() + 2)
            bucket = (gram >> np.uint64(64 - bits)).astype(np.int64)
            twice = np.bincount(bucket, minlength=1 << bits)[bucket] > 1
            where, gram = where[twice], gram[twice]
        order = np.argsort(gram, kind="stable")
        sorted_gram = gram[order]
        new = np.r_[True, sorted_gram[1:] != sorted_gram[:-1]][: len(order)]
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
        order, group = order[again], group[again]
        if not len(order):
            return
        place = where[order]
        group_at = np.full(n, -1, dtype=np.int64)
        group_at[place] = group
        keys = group * (n + 1) + place
        for x in (mid, mid - k):
            ok = np.flatnonzero((x >= lo) & (x + k <= hi))
            ok = ok[group_at[x[ok]] >= 0]
            base, at = group_at[x[ok]] * (n + 1), x[ok]
            for first, stop in (
                (np.maximum(lo[ok], at - 4 * k + 1), at - 2 * k),
                (at + 2 * k, np.minimum(hi[ok] - k, at + 4 * k - 1)),
            ):
                left = np.searchsorted(keys, base + np.maximum(first, 0), side="left")
                right = np.searchsorted(keys, base + np.maximum(stop, -1), side="right")
                count = np.where(stop >= first, np.maximum(right - left, 0), 0)
                b = np.repeat(ok, count)
                inside = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
                q = np.abs(place[np.repeat(left, count) + inside] - np.repeat(at, count))
                for i in (mid[b] - 1, mid[b] - q):
                    fits = (i >= lo[b]) & (i + q < hi[b])
                    fits[fits] = words.same(i[fits], q[fits])
                    yield b[fits], i[fits], q[fits]
        kept = np.sort(order)
        where, gram = where[kept], gram[kept]


def crossing(words: _Words, starts: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple:
    """(boundary, start, end, period) of all runs inside [lo, hi) that hold the words on both sides of
    `mid`; of one stretch only its smallest period."""
    none = np.zeros(0, dtype=np.int64)
    rows = [(none, none, none, none)]
    for found in (_short(words, lo, mid, hi), _long(words, starts, lo, mid, hi)):
        for b, i, q in found:
            if len(b):
                s, e = words.stretch(i, q, lo[b], hi[b])
                good = e - s >= np.maximum(LEAST_LENGTH, 2 * q)
                rows.append((b[good], s[good], e[good], q[good]))
    b, s, e, q = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((q, e, s, b))
    b, s, e, q = b[order], s[order], e[order], q[order]
    first = np.r_[True, (b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])][: len(b)]
    return b[first], s[first], e[first], q[first]


def merged(s: np.ndarray, e: np.ndarray, q: np.ndarray, n: int) -> tuple:
    """Maximal intervals: those of one period that overlap by a period or more are one run."""
    if not len(s):
        return s, e, q
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    reach = np.maximum.accumulate(e + q * (n + 1)) - q * (n + 1)
    new = np.r_[True, (q[1:] != q[:-1]) | (s[1:] + q[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    s, e, q = s[first], np.maximum.reduceat(e, first), q[first]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    smallest = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])]
    s, e, q = s[smallest], e[smallest], q[smallest]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _proven(ids: np.ndarray, bounds: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bool:
    """Whether every interval has its period and cannot be extended in its text, word by word."""
    text = np.searchsorted(bounds, s, side="right") - 1
    for a, b, p, lo, hi in zip(*(x.tolist() for x in (s, e, q, bounds[text], bounds[text + 1]))):
        if not np.array_equal(ids[a : b - p], ids[a + p : b]):
            return False
        if (a > lo and ids[a - 1] == ids[a - 1 + p]) or (b < hi and ids[b] == ids[b - p]):
            return False
    return True


def find(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of texts of `lengths` words that lie one after the other in
    `ids` and share no number. Ordered by start, then period."""
    n, seed = len(ids), 1
    bounds = np.r_[0, np.cumsum(lengths)]
    filled = lengths > 0
    starts = bounds[:-1][filled]
    if not n:
        return ids, ids, ids
    g = re_pair(ids, starts)
    text = np.searchsorted(starts, g["top"], side="right") - 1
    inner = g["top"] != starts[text]
    ends = np.r_[starts[1:], n]
    rules = len(g["mid"])
    lo = np.r_[g["lo"], starts[text][inner]]
    mid = np.r_[g["mid"], g["top"][inner]]
    hi = np.r_[g["hi"], ends[text][inner]]
    wide = np.flatnonzero(hi - lo >= LEAST_LENGTH)
    by_rule = np.argsort(g["used"], kind="stable")
    place = g["place"][by_rule]
    uses = np.bincount(g["used"], minlength=rules)
    first_use = np.cumsum(uses) - uses
    while True:
        words = _Words(ids, seed)
        b, s, e, q = crossing(words, starts, lo[wide], mid[wide], hi[wide])
        b = wide[b]
        inside = b < rules
        r = b[inside]
        count = uses[r]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        moved = place[np.repeat(first_use[r], count) + nth] - np.repeat(lo[r], count)
        found = merged(
            np.r_[s[~inside], np.repeat(s[inside], count) + moved],
            np.r_[e[~inside], np.repeat(e[inside], count) + moved],
            np.r_[q[~inside], np.repeat(q[inside], count)],
            n,
        )
        if _proven(ids, bounds, *found):
            return found
        seed += 1  # two different stretches had one hash


def _described(docs: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.r_[0, np.cumsum(lengths)]
    parts = [numbered(words, int(at)) for words, at in zip(texts, bounds)]
    s, e, q = find(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), lengths)
    text = np.searchsorted(bounds, s, side="right") - 1
    cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    runs = list(zip((s - bounds[text]).tolist(), (e - s).tolist(), q.tolist()))
    rows = []
    for k, (doc, words) in enumerate(zip(docs, texts)):
        own = runs[cut[k] : cut[k + 1]]
        best = (None,) * 4
        kept = words
        if own:
            start, length, period = min(own, key=lambda run: (-run[1], run[0], run[2]))
            best = (start, length, period, 1000 * length // period)
            dropped = np.zeros(len(words) + 1, dtype=np.int32)
            for a, size, p in own:
                dropped[a + p] += 1
                dropped[a + size] -= 1
            stay = np.cumsum(dropped[:-1]) == 0
            kept = [words[i] for i in np.flatnonzero(stay).tolist()]
        lines = "".join(f"{a},{size},{p}\n" for a, size, p in own)
        rows.append(
            (
                doc, len(words), len(own), *best, hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(b" ".join(kept)).hexdigest(),
            )
        )
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)],
        [f.split()[0] for f in SCHEMA.split(", ")],
    )


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `docs`: the number of runs, the longest run, and digests of all runs and of the text
    without the repetitions.

    Words lie between ASCII white space; every tenth document's end is made periodic first (`changed`).
    Null and empty texts have no words and no runs (their digests are those of nothing). A null id stays
    null and its text is taken as it is. Repeated rows are rows of their own; of equally long runs the
    first counts, then the shortest period. A text of any length is worked on whole, alone if it is longer
    than a group, in memory that grows with its words. Other columns are not read; no rows give no rows.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary())
            for doc, body in zip(batch.column(0).to_pylist(), bodies):
                words = changed((body.as_py() or b"").split(), doc)
                ids.append(doc)
                texts.append(words)
                size += len(words)
                if size >= GROUP_WORDS:
                    yield _described(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _described(ids, texts)

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    ).mapInArrow(described, SCHEMA)
