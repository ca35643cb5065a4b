"""Periodic runs of words, found on a grammar of each text.

The word ids of a text are compressed with Re-Pair: the most frequent pair of neighbours becomes a
nonterminal, until no pair comes twice; what is left of the text is paired into a balanced tree. A
run lies across the boundary of exactly one lowest node that holds it, so every nonterminal's
boundary is searched once, however often the nonterminal stands in the text, and the intervals
found are carried to all positions of its derivations. Intervals that a longer one of the same
period holds are merged into it.

The texts of a slice are handled together with array operations; their ids differ, so no rule and
no run reaches from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import WORD, slices, whole

#: Shortest run in words; a run holds its period at least twice.
LEAST = 12
#: Bytes of text that are handled together, and candidates of periods that are.
SLICE, CANDIDATES = 4 << 20, 1 << 20
#: What a run's two extensions agree on is at least half of ``LEAST``; half of that lies on one side.
GRAM = 3

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


@dataclass
class Grammar:
    """Rules ``left right`` of the nonterminals, numbered after ``terminals`` word ids."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    #: Number of words, and first position, of each nonterminal.
    size: np.ndarray
    first: np.ndarray
    #: (from, to) of the nonterminals that a round made; a rule names symbols of earlier rounds.
    rounds: list[tuple[int, int]]
    #: Last symbol and position of each text that has words.
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Number of words of any symbols."""
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.terminals
        out[inner] = self.size[symbols[inner] - self.terminals]
        return out


def _frequent(seq: np.ndarray, fresh: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions to replace, the pairs that start there, and the pairs that may come twice later.

    More frequent pairs go first where pairs overlap; ties are broken by a mixed number of the pair.
    """
    n = len(seq)
    count = np.bincount(seq, minlength=n_symbols)
    often = count[seq] > 1
    at = np.flatnonzero(fresh[:-1] & often[:-1] & often[1:])
    later = np.zeros(n, bool)
    pair = seq[at] * n_symbols + seq[at + 1]
    # Of overlapping pairs of one symbol every second counts.
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (pair[1:] != pair[:-1])
    number = np.arange(len(at))
    odd = (number - np.maximum.accumulate(np.where(new, number, 0))) % 2 == 1
    later[at[odd]] = True
    at, pair = at[~odd], pair[~odd]
    if not len(at):
        return at, pair, later
    keys, which, times = np.unique(pair, return_inverse=True, return_counts=True)
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed, times))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(1, len(keys) + 1)
    rank[times < 2] = 0
    here = rank[which]
    at, pair, which, here = at[here > 0], pair[here > 0], which[here > 0], here[here > 0]
    later[at] = True
    place = np.zeros(n + 1, np.int64)
    place[at] = here
    best = (here > place[at - 1]) & (here > place[at + 1])  # place[-1] is no position
    at, pair, which = at[best], pair[best], which[best]
    twice = np.bincount(which, minlength=len(keys))[which] > 1
    return at[twice], pair[twice], later


def compress(words: np.ndarray, bounds: np.ndarray) -> Grammar:
    """Re-Pair of texts with ids of their own; text i is ``words[bounds[i]:bounds[i + 1]]``."""
    terminals = int(words.max()) + 1 if len(words) else 0
    seq, pos = words.astype(np.int64), np.arange(len(words))
    fresh = np.ones(len(seq), bool)
    lefts, rights, sizes, firsts, rounds = [], [], [np.ones(terminals, np.int64)], [], []
    n_symbols = terminals
    size = sizes[0]

    def add(left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
        nonlocal n_symbols, size
        lefts.append(left)
        rights.append(right)
        firsts.append(first)
        size = np.concatenate([size, size[left] + size[right]])
        rounds.append((n_symbols - terminals, n_symbols - terminals + len(left)))
        n_symbols += len(left)
        return np.arange(n_symbols - len(left), n_symbols)

    while len(seq) > 1:
        at, pair, later = _frequent(seq, fresh, n_symbols)
        fresh = later
        if not len(at):
            # Pairs that overlap themselves only, such as both of three equal words, come once.
            break
        keys, first, which = np.unique(pair, return_index=True, return_inverse=True)
        made = add(keys // n_symbols, keys % n_symbols, pos[at[first]])
        seq[at] = made[which]
        fresh[at] = True
        fresh[at[at > 0] - 1] = True
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq, pos, fresh = seq[stays], pos[stays], fresh[stays]
    text = np.searchsorted(bounds, pos, side="right") - 1
    while len(seq) > 1:
        number = np.arange(len(seq))
        new = np.ones(len(seq), bool)
        new[1:] = text[1:] != text[:-1]
        even = (number - np.maximum.accumulate(np.where(new, number, 0))) % 2 == 0
        at = np.flatnonzero(even[:-1] & ~new[1:])
        if not len(at):
            break
        seq[at] = add(seq[at], seq[at + 1], pos[at])
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq, pos, text = seq[stays], pos[stays], text[stays]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return Grammar(terminals, joined(lefts), joined(rights), size[terminals:], joined(firsts), rounds, seq, pos)


class Extension:
    """How far equal words go on from pairs of positions.

    Blocks are compared directly at first; where much is equal, by names of all blocks of 1, 2, 4 ...
    words, so that one pair takes logarithmic time.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.spent, self.names = words, 0, [words]

    def _names(self, k: int) -> np.ndarray:
        while len(self.names) <= k:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            n = len(last) - step
            if n <= 0:
                return np.zeros(0, np.int64)
            self.names.append(np.unique(last[:n] * (int(last.max()) + 1) + last[step:], return_inverse=True)[1])
        return self.names[k]

    def ahead(self, u: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from ``u`` and ``v`` on, of at most ``most``."""
        return self._extend(u, v, most, 1)

    def back(self, u: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words before ``u`` and ``v``."""
        return self._extend(u - 1, v - 1, most, -1)

    def _extend(self, u: np.ndarray, v: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        out = np.zeros(len(u), np.int64)
        open_, width, top = np.flatnonzero(most > 0), 4, len(self.words) - 1
        while len(open_) and self.spent <= 16 * len(self.words) + CANDIDATES:
            width = min(2 * width, max(8, CANDIDATES // len(open_)), 4096)
            self.spent += width * len(open_)
            step = np.arange(width) * way
            a, b = u[open_] + out[open_] * way, v[open_] + out[open_] * way
            same = self.words[np.clip(a[:, None] + step, 0, top)] == self.words[np.clip(b[:, None] + step, 0, top)]
            got = np.where(same.all(1), width, same.argmin(1))
            out[open_] = np.minimum(out[open_] + got, most[open_])
            open_ = open_[(got == width) & (out[open_] < most[open_])]
        if len(open_):
            for k in range(int(most[open_].max()).bit_length() - 1, -1, -1):
                names, step = self._names(k), 1 << k
                fits = open_[out[open_] + step <= most[open_]]
                if not len(fits) or not len(names):
                    continue
                shift = 0 if way > 0 else step - 1
                a, b = u[fits] + out[fits] * way - shift, v[fits] + out[fits] * way - shift
                out[fits[names[a] == names[b]]] += step
        return out


def _crossing(words: np.ndarray, grammar: Grammar, least: int) -> tuple[np.ndarray, ...]:
    """Runs across the boundary of each nonterminal, within its words: ``node, start, end, period``.

    ``start`` and ``end`` count from the nonterminal's first word; of periods that fit the same
    interval the smallest stays.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    node = np.flatnonzero(grammar.size >= least)
    count = np.bincount(words, minlength=1)
    often = count[words] > 1
    gram = np.flatnonzero(often[:-2] & often[1:-1] & often[2:]) if len(words) >= GRAM else node[:0]
    if not len(node) or not len(gram):
        return none
    w = words.astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    key = (w[gram] * mix ^ w[gram + 1]) * mix ^ w[gram + 2]
    # Equal keys are candidates only: what they stand for is compared below.
    order = np.argsort(key, kind="stable")
    key, place = key[order], gram[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    shared = np.bincount(group)[group] > 1
    group, place = group[shared], place[shared]
    if not len(place):
        return none
    n = len(words) + 1
    spots = group * n + place
    group_of = np.full(n, -1)
    group_of[place] = group
    begin = grammar.first[node]
    middle = begin + grammar.lengths(grammar.left[node])
    end = begin + grammar.size[node]
    extension = Extension(words)
    found = []
    for back in (0, GRAM):
        x = middle - back
        ok = (x >= begin) & (x + GRAM <= end)
        ok[ok] = group_of[x[ok]] >= 0
        at = np.flatnonzero(ok)
        g = group_of[x[at]] * n
        half = (end[at] - begin[at]) // 2
        lo = np.searchsorted(spots, g + np.maximum(begin[at], x[at] - half))
        hi = np.searchsorted(spots, g + np.minimum(end[at] - GRAM, x[at] + half), side="right")
        many = hi - lo
        total = np.cumsum(many)
        cut = 0
        while cut < len(at):
            base = total[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(total, base + CANDIDATES, side="right")))
            part = np.repeat(np.arange(cut, to), many[cut:to])
            y = place[lo[part] + np.arange(len(part)) - (total[part] - many[part] - base)]
            k, q = at[part], y - x[at[part]]
            k, q = k[q != 0], q[q != 0]
            u = np.where(q < 0, middle[k] + q, middle[k])
            q = np.abs(q)
            f = extension.ahead(u, u + q, end[k] - u - q)
            b = extension.back(u, u + q, u - begin[k])
            good = (f + b >= q) & (f + b + q >= least)
            k, u, q, f, b = k[good], u[good], q[good], f[good], b[good]
            found.append((k, u - b - begin[k], u + q + f - begin[k], q))
            cut = to
    if not found:
        return none
    k, s, e, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, e, s, k))
    k, s, e, q = k[order], s[order], e[order], q[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return node[k[first]], s[first], e[first], q[first]


def _everywhere(grammar: Grammar, node: np.ndarray, *interval: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of nonterminals, ordered by ``node``, at all positions of their derivations."""
    start, end, period = interval
    n = len(grammar.size)
    many = np.bincount(node, minlength=n)
    ahead = np.concatenate([[0], np.cumsum(many)])
    useful = np.concatenate([np.zeros(grammar.terminals, bool), many > 0])
    t = grammar.terminals
    for lo, hi in grammar.rounds:
        useful[t + lo : t + hi] |= useful[grammar.left[lo:hi]] | useful[grammar.right[lo:hi]]
    symbol, pos = grammar.roots, grammar.starts
    out = []
    while True:
        symbol, pos = symbol[useful[symbol]] - t, pos[useful[symbol]]
        if not len(symbol):
            break
        which = np.repeat(np.arange(len(symbol)), many[symbol])
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many[symbol]) - many[symbol], many[symbol])
        i = ahead[symbol[which]] + nth
        out.append((pos[which] + start[i], pos[which] + end[i], period[i]))
        left, right = grammar.left[symbol], grammar.right[symbol]
        symbol, pos = np.concatenate([left, right]), np.concatenate([pos, pos + grammar.lengths(left)])
    return tuple(np.concatenate(c) for c in zip(*out)) if out else interval


def _maximal(text: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which intervals no other of the same text and period holds; of one interval, the smallest period."""
    order = np.lexsort((-end, start, period, text))
    t, s, e, q = text[order], start[order], end[order], period[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1])
    step = int(e.max()) + 1 if len(e) else 1
    level = np.cumsum(new) * step
    reach = np.maximum.accumulate(level + e)
    free = np.ones(len(order), bool)
    free[1:] = new[1:] | (level[1:] + e[1:] > reach[:-1])
    order = order[free]
    order = order[np.lexsort((period[order], end[order], start[order], text[order]))]
    s, e = start[order], end[order]
    first = np.ones(len(order), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    order = order[first]
    return order[np.lexsort((period[order], start[order], text[order]))]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """All runs ``text, start, end, period`` of texts of words, by text, start and period.

    Text i is ``words[bounds[i]:bounds[i + 1]]``; ``start`` and ``end`` count from its first word. A
    run is a stretch with this smallest period, of ``max(least, 2 * period)`` words at least, that
    no neighbouring word extends. ``least`` is 12 or more.
    """
    if least < 4 * GRAM:
        raise ValueError(f"least is at least {4 * GRAM}")
    if not len(words):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # A word has another id in every text.
    ids = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)[1]
    grammar = compress(ids, bounds)
    start, end, period = _everywhere(grammar, *_crossing(ids, grammar, least))
    text = np.searchsorted(bounds, start, side="right") - 1
    keep = _maximal(text, start, end, period)
    text = text[keep]
    return text, start[keep] - bounds[text], end[keep] - bounds[text], period[keep]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts one after another, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words, parents = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(pc.binary_length(words), 0)  # a text without words is split into one empty word
    words, parents = words.filter(some), parents.filter(some)
    count = np.bincount(np.asarray(parents), minlength=len(texts))
    return words, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def _run_lists(n_texts: int, text: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_texts))])
    rows = pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in (start, end - start, period)], ["start", "length", "period"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def detect(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words``, the ``runs`` of every whole text in order, and the ``collapsed`` text.

    ``collapsed`` joins by one space what is left when of each run only the first period stays.

    Words are divided by ASCII white space. A null text counts as empty: no words, no runs, an empty
    collapsed text. Every row gives one row, also repeated rows and those with a null id; other
    columns, whatever their names, play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, bounds = split_words(batch.column("text"))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = find_runs(codes, bounds, least)
            text, start, end, period = found
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, bounds[text] + start + period, 1)
            np.add.at(cover, bounds[text] + end, -1)
            stays = np.cumsum(cover)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(stays)])[bounds]
            kept = words if stays.all() else words.filter(pa.array(stays))
            lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    _run_lists(batch.num_rows, *found),
                    pc.binary_join(lists, " "),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select("doc_id", whole().alias("text")).mapInArrow(work, SCHEMA)


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; a tenth of the texts, chosen by the id, turned periodic from some word on.

    With h the checksum of the id and g = h div 10, texts with h % 10 = 0 keep the words before a =
    g % n and repeat the next 1 + (n - a) div (3 + g % 8) words over the rest. A text of a null id
    stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(whole(), F.lit(f"({WORD})"), F.lit(1))
    chosen = docs.select("doc_id", whole().alias("text"), F.when(h % 10 == 0, words).alias("w"), g.alias("g"))
    n = F.size("w")
    some = F.col("w").isNotNull() & (n > 0)
    a = (F.col("g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("w", a + 1, p), times))
    turned = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(repeated, F.lit(1), n - a)), " ")
    return chosen.select("doc_id", F.when(some, turned).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest run, and digests of the runs and the collapsed text, per document."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = detect(with_periods(docs)).withColumn("best", best)
    length, period = -F.col("best")["col1"], F.col("best")["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best")["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
