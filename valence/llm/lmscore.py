"""Bigram language-model scores from a log-frequency Bloom filter.

The filter (Talbot and Osborne 2007) holds no counts. An n-gram seen c times has the level 1 + floor(log2 c), and the pairs (n-gram, 1) to
(n-gram, level) are its members. To read a count, membership of level 1, 2, ... is probed until one is missing. An answer is never
too low; it is a level too high with the probability of a false positive.

Words are runs of visible characters in lower case (A-Z only), and each text ends in an end token, which is also the history of its first
word. With the counts that the filter gives, and mu = MU:

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu)          (a Dirichlet prior)

and a bigram is taken for no commoner than its words. The score is the sum of log10 p(w | h). The base score has log10 p(w) with exact counts.

**Size.** The filter has BITS bits for each training token, so it grows with the corpus, and no n-gram is left out. Bigrams are counted once,
and the commonest make a filter of at most LIMIT bytes that is broadcast; most probes end there, in the pass that reads the texts. The
others go to the tasks that hold the filter, segment by segment. A bigram outside the broadcast part occurs less often than
the rarest that fits, or less than _MANY times, so no segment gets many probes of one. Counts of words, for both scores, are broadcast for at most COMMON words,
the commonest. A bigram with another word, a rare one, lies in the segment of that word, and the task that holds the segment also has the exact counts of
its rare words, so one probe brings both. Only where both words are rare the history's count is joined on before. Commonest means in all texts, held-out ones
too, so a segment gets few probes for a rare word. So a text is read twice to count and once to score at any size, and what is broadcast is bounded.

Defined: a null or empty text is one end token. Rows without an id are learnt from. Repeated rows count as often as they are there.
With no training rows N and V are 0, and each token has probability 1 (0.5 / 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from valence.llm.common import Words, fixed, mixed, numbered, pieces, signed, signed_back, small_batches
from valence.session import written

BITS, LIMIT, SEGMENT = 6, 32 << 20, 256 << 10
COMMON = 1 << 20
MU = 1000.0
#: Levels above any that a count has. Both are members for each n-gram of the broadcast part; no level is known yet.
_MARKS, _OPEN = (64, 65), 255
#: Segments of the filter to a task, and how often a bigram of the broadcast part occurs at least.
_TOGETHER, _MANY = 2, 4
#: Bytes of text that are split into words at once, as many arrays are held of them.
_PIECE = 1 << 20
#: Bytes of text whose bigrams are held, sorted and cut by task at once.
_HELD = 2 << 20
#: Words of 64 bits in the smallest segment.
_LEAST = 512
END = np.uint64(0x243F6A8885A308D3)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_UPPER = np.uint64(0xFFFFFFFF00000000)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the histories, and the text of each; every text has its end."""
    text = np.concatenate([w.text, np.arange(w.texts)])
    order = np.argsort(text, kind="stable")
    now = np.concatenate([w.hash, np.full(w.texts, END)])[order]
    return now, np.concatenate([[END], now[:-1]]).astype(np.uint64), text[order]


def pair(history: np.ndarray, word: np.ndarray, rare_history: np.ndarray, rare_word: np.ndarray) -> np.ndarray:
    """The bigrams; the upper half, which picks the segment, is that of the rare word if one is rare, and of the second if both are."""
    with np.errstate(over="ignore"):
        x = mixed(history * _PAIR + word)
    leads = np.where(rare_word, word, np.where(rare_history, history, x))
    return leads & _UPPER | x & ~_UPPER


def _among(names: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place in the sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(names, of), len(names) - 1)
    return at, names[at] == of


class Filter:
    """``parts``: the 64-bit words of each segment, those from ``first`` on of ``segments``. A member sets four bits in one word of its segment."""

    def __init__(self, parts: np.ndarray | list[np.ndarray], first: int = 0, segments: int | None = None):
        self.sizes = np.array([len(p) for p in parts], np.uint64)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.words, self.first, self.segments = np.concatenate(parts), first, segments or len(parts)

    @staticmethod
    def places(keys: np.ndarray, level: int | np.ndarray, segments: int, size: int | np.ndarray, first: int = 0):
        """Segment, place in it and bits of each member; ``size`` is that of all segments, or of each from ``first`` on."""
        with np.errstate(over="ignore"):
            h = mixed(keys + np.asarray(level, np.uint64) * _STEP)
        one = np.uint64(1)
        mask = np.zeros(len(h), np.uint64)
        for k in range(4):
            mask |= one << ((h >> np.uint64(6 * k)) & np.uint64(63))
        segment = (keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)  # in the order of the keys
        segment = segment.astype(np.int64)
        size = np.uint64(size) if np.isscalar(size) else size[segment - first]
        return segment, ((h >> np.uint64(24)) % size).astype(np.int64), mask

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        segment, place, mask = self.places(keys, level, self.segments, self.sizes, self.first)
        return self.words[self.starts[segment - self.first] + place] & mask == mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it isn't there: probe level after level."""
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        level = 0
        while len(live):
            level += 1
            live = live[self.has(keys[live], level)]
            out[live] = level
        return out

    def marked(self, keys: np.ndarray) -> np.ndarray:
        """Which n-grams this filter answers for, whether or not they occur where was learnt."""
        return self.has(keys, _MARKS[0]) & self.has(keys, _MARKS[1])


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level > 0, 0.75 * np.exp2(level.astype(float)) - 0.5, 0.0)


def _summed(keys: np.ndarray, c: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sums of c and n (how often each is there, if n is none)."""
    keys, which = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(which, v, len(keys)).astype(np.int64) for v in (c, n))


def _tokens_of(batch: pa.RecordBatch, most: int = _HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, histories and whether they are learnt, of about ``most`` bytes of text at a time, which are split a megabyte at a time."""
    learnt = ~batch["held_out"].to_numpy(zero_copy_only=False)
    held, size = [], 0
    for i, data, bounds in pieces(batch["body"], _PIECE):
        now, before, text = tokens(Words(data, bounds, "visible"))
        held.append((now, before, learnt[i + text]))
        size += len(data)
        if size >= most:
            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held, strict=True))


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for now, _, learnt in _tokens_of(batch):
            h, c, n = _summed(now, learnt)
            yield pa.record_batch([pa.array(signed(h)), pa.array(c), pa.array(n)], ["h", "c", "n"])


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, the second bytes, ...: what compresses well where values are small or alike."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unplaned(held: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(width, len(held) // width).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys by what each is above the one before it."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unstepped(held: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(held, np.uint64), dtype=np.uint64)


def _parts(keys: np.ndarray, segments: int) -> tuple[pa.Array, list[slice]]:
    """Sorted keys cut by the task that holds their segments: number of the task, slice."""
    part = Filter.places(keys, 0, segments, 1)[0] // _TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    cuts = [slice(i, j) for i, j in zip(edges, edges[1:], strict=False) if i < j]
    return pa.array([part[at.start] for at in cuts], pa.int64()), cuts


def _bigrams(sent: Broadcast, whole: bool, segments: int):
    """The sorted bigrams of some texts, cut by task: keys, c (how often where is learnt) and n (how often at all)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value[0]
        for batch in batches:
            for now, before, learnt in _tokens_of(batch):
                word, which = np.unique(now, return_inverse=True)
                rare = ~_among(names, word)[1] & (not whole)
                left = np.searchsorted(word, before)  # histories are words of these texts, or the end
                keys, c, n = _summed(pair(before, now, rare[left], rare[which]), learnt)
                part, cuts = _parts(keys, segments)
                packed = [[_steps(keys[at]) for at in cuts], [_planes(c[at]) for at in cuts], [_planes(n[at]) for at in cuts]]
                yield pa.record_batch([part, *[pa.array(v, pa.binary()) for v in packed]], ["part", "keys", "c", "n"])

    return counted


def _summed_up(segments: int):
    """Segments of the filter from all bigrams of a task's segments, and those bigrams that occur _MANY times."""

    def made(keys, c, n):
        held = [np.concatenate(v) for v in (keys, c, n)]
        for values in (keys, c, n):
            values.clear()
        keys, c, n = _summed(*held)
        del held
        segment = Filter.places(keys, 0, segments, 1)[0]
        for s in np.unique(segment):
            at = slice(*np.searchsorted(segment, [s, s + 1]))
            words = np.zeros((1, _size(BITS * int(c[at].sum()))), np.uint64)
            _set_counts(words, keys[at], c[at])
            yield pa.record_batch(
                [pa.array([s]), pa.array([words.tobytes()], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], ["segment", "words", "x", "c", "n"]
            )
        many = np.flatnonzero(n >= _MANY)
        yield pa.record_batch(
            [pa.array(segment[many]), pa.nulls(len(many), pa.binary()), pa.array(signed(keys[many])), pa.array(c[many]), pa.array(n[many])],
            ["segment", "words", "x", "c", "n"],
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, first, at, batch in _runs(batches, "part"):
            if held and first:
                yield from made(*held)
                held = None
            held = held or ([], [], [])
            held[0].extend(map(_unstepped, batch["keys"][at].to_pylist()))
            for values, name in zip(held[1:], ("c", "n"), strict=True):
                values.extend(_unplaned(v, np.int64) for v in batch[name][at].to_pylist())
        if held:
            yield from made(*held)

    return summed


def whole_filter(rows: DataFrame, sent: Broadcast, whole: bool, total: int) -> DataFrame:
    """segment, words: the filter over all texts that are learnt from. Rows with x, c, n in their place: bigrams that occur _MANY times."""
    segments = _segments(BITS * total // 8)
    counted = rows.select("held_out", "body").mapInArrow(_bigrams(sent, whole, segments), "part long, keys binary, c binary, n binary")
    counted = counted.repartition(-(-segments // _TOGETHER), "part").sortWithinPartitions("part")
    return counted.mapInArrow(_summed_up(segments), "segment long, words binary, x long, c long, n long")


def _set(words: np.ndarray, keys: np.ndarray, level: int) -> None:
    """Make (key, level) members, for all keys; a filter of one segment or of several."""
    segment, place, mask = Filter.places(keys, level, *words.shape)
    np.bitwise_or.at(words, (segment, place), mask)


def _set_counts(words: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
    top = np.frexp(counts)[1]  # 1 + floor(log2), 0 for 0
    level = 0
    while len(keys):
        level += 1
        live = top >= level
        keys, top = keys[live], top[live]
        _set(words, keys, level)


def _filled():
    """A segment of the broadcast part from all its n-grams (sorted by segment): marks, then levels."""

    def made(number, keys, counts):
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        words = np.zeros((1, _size(8 * (len(_MARKS) * len(keys) + int(np.frexp(counts)[1].sum())))), np.uint64)  # a byte to a member
        for mark in _MARKS:
            _set(words, keys, mark)
        _set_counts(words, keys, counts)
        return pa.record_batch([pa.array([number]), pa.array([words.tobytes()], pa.binary())], ["segment", "words"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for number, first, at, batch in _runs(batches):
            if held and first:
                yield made(*held)
                held = None
            held = held or (number, [], [])
            held[1].append(signed_back(batch["x"].to_numpy()[at]))
            held[2].append(batch["c"].to_numpy()[at])
        if held:
            yield made(*held)

    return fill


def _runs(batches: Iterator[pa.RecordBatch], by: str = "segment"):
    """Number of the segment or part, whether its first rows are here, the slice, and the batch; rows come sorted by it."""
    last = None
    for batch in batches:
        numbers = batch[by].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i < j:
                yield int(numbers[i]), numbers[i] != last, slice(i, j), batch
                last = numbers[i]


def _segment(segments: int) -> Column:
    """The segment of ``x``, as ``Filter.places`` has it."""
    return F.shiftrightunsigned(F.shiftrightunsigned("x", 32) * F.lit(segments).cast("long"), 32)


def _segments(nbytes: int) -> int:
    return max(1, -(-nbytes // SEGMENT))


def _size(bits: int) -> int:
    """64-bit words of a segment. Each is as large as what it holds, as rare words put bigrams unevenly."""
    return max(_LEAST, bits // 64 + 1)


def common_part(grams: DataFrame, limit: int) -> Filter:
    """A filter of at most about ``limit`` bytes for the commonest of these bigrams."""
    members = F.lit(len(_MARKS)) + F.when(F.col("c") > 0, F.length(F.bin("c"))).otherwise(0)
    steps = grams.groupBy((F.length(F.bin("n")) - 1).alias("step")).agg(F.sum(members).alias("members"))
    least, held = 1 << 62, 0
    for r in steps.orderBy(F.desc("step")).collect():  # at most 63 rows
        if held + r["members"] > limit:  # a byte to a member
            break
        held += r["members"]
        least = 1 << r["step"]
    segments = _segments(held)
    ours = grams.filter(F.col("n") >= least).select(_segment(segments).alias("segment"), "x", "c")
    ours = ours.repartition(-(-segments // _TOGETHER), "segment").sortWithinPartitions("segment")
    words = [np.zeros(1, np.uint64)] * segments
    for batch in ours.mapInArrow(_filled(), "segment long, words binary").toArrow().to_batches():
        for s, made in zip(batch["segment"].to_pylist(), batch["words"], strict=True):
            words[s] = np.frombuffer(made.as_buffer(), np.uint64)
    return Filter(words)


def _logs(seen, left, word, total: int, size_v: int, mu: float) -> np.ndarray:
    """log10 p(w | h) from the levels of the bigram, its history and its word."""
    before, now = count_of(left), count_of(word)
    alone = (now + 0.5) / (total + 0.5 * (size_v + 1))
    return np.log10((np.minimum(count_of(seen), np.minimum(before, now)) + mu * alone) / (before + mu))


def _lower(x: np.ndarray) -> np.ndarray:
    return (x & ~_UPPER).astype(np.uint32).view(np.int32)


def _packed(left, word, seen) -> np.ndarray:
    return (left | word << 8 | seen << 16).astype(np.int32)


def _named(packed: np.ndarray) -> np.ndarray:
    """Where the history or the word is a rare one."""
    return np.maximum(packed & 255, packed >> 8 & 255) == _OPEN


def _nested(text: np.ndarray, n: int, which: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Lists for each of ``n`` texts of the values at ``which``; ``text`` is in order."""
    cuts = pa.array(np.searchsorted(text[which], np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(cuts, pa.array(v[which])) for v in values]


_READ = (
    "row long, id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, found double, "
    "far_x array<long>, far_packed array<int>, h array<long>, w array<int>, "
    "batch long, part long, keys binary, packed binary, rows binary, names binary"
)
_LISTS = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.float64(), *_LISTS]
_COLUMNS = [field.split()[0] for field in _READ.split(", ")]


def _read(words: Broadcast, sent: Broadcast, whole: bool, segments: int, total: int, size_v: int, mu: float):
    """What the broadcast counts and the broadcast part of the filter give for each text, and what is left to look up.

    Left are rare words (for the base score), bigrams outside the filter or with a rare word (in rows of their own, of a batch of
    texts of _HELD bytes, sorted and cut by task: keys, packed, rows, and in ``names`` the lower halves of the rare words), and bigrams of two rare words
    (far_*; h is the history, w the lower half of the word). ``batch``, the number of its first row, is where the answers are summed up.
    """
    below = np.log10(total + 0.5 * (size_v + 1))

    def cut(own: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, packed, rows, lower = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.argsort(x)
        x, packed, rows, lower = x[order], packed[order], rows[order], lower[order]
        part, cuts = _parts(x, segments)
        lists = [
            [_steps(x[at]) for at in cuts], [_planes(packed[at]) for at in cuts], [_planes(rows[at]) for at in cuts],
            [_planes(lower[at][_named(packed[at])]) for at in cuts],
        ]
        numbers = pa.array(np.full(len(cuts), own))
        return pa.record_batch([pa.nulls(len(cuts), t) for t in _TYPES] + [numbers, part, *[pa.array(v, pa.binary()) for v in lists]], _COLUMNS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, counts), common = words.value, sent.value
        for batch in batches:
            held, size = [], 0
            for i, data, bounds in pieces(batch["body"], _PIECE):
                now, before, text = tokens(Words(data, bounds, "visible"))
                n = len(bounds) - 1
                own = own if held else batch["row"][i].as_py()
                word, which = np.unique(now, return_inverse=True)
                left = np.searchsorted(word, before)  # histories are words of these texts, or the end
                at, hit = _among(names, word)
                count = np.zeros(len(word), np.int64)
                count[hit] = counts[at[hit]]
                rare = ~hit & (not whole)
                level = np.where(rare, _OPEN, np.frexp(count)[1].astype(np.int64))
                lh, lw = level[left], level[which]

                x = pair(before, now, rare[left], rare[which])
                key, of = np.unique(x, return_inverse=True)
                ours = common.marked(key)
                levels = np.full(len(key), _OPEN, np.int64)
                levels[ours] = common.levels(key[ours])
                seen = levels[of]
                seen[np.minimum(lh, lw) == 0] = 0
                far = (lh == _OPEN) & (lw == _OPEN)
                known = (lh != _OPEN) & (lw != _OPEN) & (seen != _OPEN)
                done = np.flatnonzero(known)
                found = np.bincount(text[done], _logs(seen[done], lh[done], lw[done], total, size_v, mu), n).astype(float)  # of no rows it is whole numbers
                packed = _packed(lh, lw, seen)
                lower = _lower(np.where(lw == _OPEN, now, before))
                based = ~rare[which]
                yield pa.record_batch(
                    [batch["row"].slice(i, n), batch["id"].slice(i, n), batch["held_out"].slice(i, n),
                     pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, count[which] > 0, n).astype(np.int64)),
                     pa.array(np.bincount(text[based], np.log10(count[which[based]] + 0.5) - below, n).astype(float)),
                     *_nested(text, n, np.flatnonzero(~based), signed(now)), pa.array(found),
                     *_nested(text, n, np.flatnonzero(far), signed(x), packed, signed(before), lower),
                     pa.array(np.full(n, own)), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 4],
                    _COLUMNS,
                )
                away = np.flatnonzero(~known & ~far)
                held.append((x[away], packed[away], batch["row"].slice(i, n).to_numpy()[text[away]], lower[away]))
                size += len(data)
                if size >= _HELD:
                    yield cut(own, held)
                    held, size = [], 0
            if held:
                yield cut(own, held)

    return read


def _flat(columns: list[str], names: list[str]):
    """A row per element of the list columns, with the number of its row and of its batch."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch[c] for c in columns]
            size = np.diff(np.asarray(lists[0].offsets))
            numbers = [pa.array(np.repeat(batch[c].to_numpy(), size)) for c in ("row", "batch")]
            yield pa.record_batch([*numbers, *[c.flatten() for c in lists]], ["row", "batch", *names])

    return flat


def _levelled(far: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``packed`` with the level of the history, a rare word, in its place."""
    known = vocabulary.filter(F.col("c") > 0).select("h", F.length(F.bin("c")).alias("level"))
    joined = far.join(known, "h", "left")
    return joined.withColumn("packed", F.col("packed") - _OPEN + F.coalesce("level", F.lit(0))).drop("h", "level")


def _answered(segments: int, total: int, size_v: int, mu: float):
    """Part after part: the words of its segments come first (kind 0), then its rare words (1), then the probes, single (2) and packed (3).

    Out come batch, rows, sums, packed as the probes were: a row for those of a batch, so there are not more rows than came in,
    and not more sums than probes, however many parts the probes of a text are dealt to.
    """

    def scores(known, x, row, packed, lower):
        part, names, levels = known
        left, word, seen = (packed >> shift & 255 for shift in (0, 8, 16))
        for level in (left, word):  # at most one of the two is open, and it picked the segment
            at = np.flatnonzero(level == _OPEN)
            place, there = _among(names, x[at] & _UPPER | lower[at].view(np.uint32).astype(np.uint64))
            level[at] = 0
            level[at[there]] = levels[place[there]]
        probed = np.flatnonzero((seen == _OPEN) & (np.minimum(left, word) > 0))
        seen[seen == _OPEN] = 0
        seen[probed] = part.levels(x[probed])
        rows, of = np.unique(row, return_inverse=True)
        return rows, np.bincount(of, _logs(seen, left, word, total, size_v, mu), len(rows))

    def packed_up(batch: list[int], rows: list[np.ndarray], sums: list[np.ndarray]):
        lists = [list(map(_steps, map(signed_back, rows))), list(map(_planes, sums))]
        return pa.record_batch([pa.array(batch, pa.int64()), *[pa.array(v, pa.binary()) for v in lists]], ["batch", "rows", "sums"])

    def made(number, words, rare):
        first = number * _TOGETHER
        part = [words.get(k, np.zeros(1, np.uint64)) for k in range(first, first + _TOGETHER)]
        names, levels = (np.concatenate(v) for v in zip(*rare, strict=True)) if rare else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        order = np.argsort(names)
        return Filter(part, first, segments), names[order], levels[order]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, rare = None, {}, []
        for number, first, at, batch in _runs(batches, "part"):
            if first:
                known, words, rare = None, {}, []
            kind = batch["kind"].to_numpy()[at]
            one, two, three = (at.start + int(k) for k in np.searchsorted(kind, [1, 2, 3]))
            for k in range(at.start, one):
                words[batch["row"][k].as_py()] = np.frombuffer(batch["keys"][k].as_py(), np.uint64)
            x, row, packed, lower, own = (batch[c].to_numpy() for c in ("x", "row", "packed", "lower", "batch"))
            if one < two:
                rare.append((signed_back(x[one:two]), packed[one:two]))
            if known is None and two < at.stop:
                known = made(number, words, rare)
                words, rare = {}, []
            if two < three:
                single = slice(two, three)
                rows, sums = scores(known, signed_back(x[single]), row[single], packed[single], lower[single])
                of = own[single][np.unique(row[single], return_index=True)[1]]  # the batch of each row
                order = np.argsort(of, kind="stable")
                numbers, cuts = np.unique(of[order], return_index=True)
                yield packed_up(numbers.tolist(), np.split(rows[order], cuts[1:]), np.split(sums[order], cuts[1:]))
            numbers, found = [], []
            for k in range(three, at.stop):
                keys, rows, packs, named = (batch[c][k].as_py() for c in ("keys", "rows", "packs", "names"))
                packs = _unplaned(packs, np.int32)
                lower = np.zeros(len(packs), np.int32)
                lower[_named(packs)] = _unplaned(named, np.int32)
                numbers.append(int(own[k]))
                found.append(scores(known, _unstepped(keys), _unplaned(rows, np.int64), packs, lower))
            if found:
                yield packed_up(numbers, *zip(*found, strict=True))

    return answer


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with what its probes add up to, batch after batch."""

    def made(rows, sums):
        rows, of = np.unique(np.concatenate(rows), return_inverse=True)
        sums = np.bincount(of, np.concatenate(sums), len(rows))
        return pa.record_batch([pa.array(signed(rows)), pa.array(sums)], ["row", "rest"])

    held = None
    for _, first, at, batch in _runs(batches, "batch"):
        if held and first:
            yield made(*held)
            held = None
        held = held or ([], [])
        held[0].extend(map(_unstepped, batch["rows"][at].to_pylist()))
        held[1].extend(_unplaned(v, np.float64) for v in batch["sums"][at].to_pylist())
    if held:
        yield made(*held)


def rest_scores(read: DataFrame, filled: DataFrame, vocabulary: DataFrame | None, total: int, size_v: int, mu: float) -> DataFrame:
    """row, rest: sums over the bigrams that the broadcast part did not answer, a row for each text that has some.

    A text's probes go to many tasks, in the end to as many as there are probes. What these find comes back packed by the batch
    that the text was read in and is summed up there.
    """
    segments = _segments(BITS * total // 8)
    none, no, nothing = F.lit(0), F.lit(0).cast("long"), F.lit(None).cast("binary")
    columns = ["part", "kind", "x", "row", "packed", "lower", "keys", "packs", "rows", "names", "batch"]

    def dealt(rows: DataFrame, kind: int, /, **own: Column) -> DataFrame:
        empty = dict(zip(columns, [None, F.lit(kind), no, no, none, none, *[nothing] * 4, no], strict=True))
        return rows.select(*[c.alias(name) for name, c in (empty | own).items()])

    part = F.floor(F.col("segment") / _TOGETHER)
    parts = dealt(filled.filter(F.col("words").isNotNull()), 0, part=part, row=F.col("segment"), keys=F.col("words"))
    packed = {name: F.col("packed" if name == "packs" else name) for name in ("part", "keys", "packs", "rows", "names", "batch")}
    parts = parts.union(dealt(read.filter(F.col("part").isNotNull()), 3, **packed))
    if vocabulary is not None:
        part = F.floor(_segment(segments) / _TOGETHER)
        rare = vocabulary.filter(F.col("c") > 0).select(F.col("h").alias("x"), F.length(F.bin("c")).alias("level"))
        lists = ["far_x", "far_packed", "h", "w"]
        far = read.filter(F.col("part").isNull()).select("row", "batch", *lists)
        flat = far.mapInArrow(_flat(lists, ["x", "packed", "h", "lower"]), "row long, batch long, x long, packed int, h long, lower int")
        far = _levelled(flat, vocabulary)
        parts = parts.union(dealt(rare, 1, part=part, x=F.col("x"), packed=F.col("level")))
        parts = parts.union(dealt(far, 2, part=part, **{name: F.col(name) for name in ("x", "row", "packed", "lower", "batch")}))
    tasks = -(-segments // _TOGETHER)
    parts = parts.repartition(tasks, "part").sortWithinPartitions("part", "kind")
    answered = parts.mapInArrow(_answered(segments, total, size_v, mu), "batch long, rows binary, sums binary")
    return answered.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(_totals, "row long, rest double")


def _common_words(vocabulary: DataFrame, common: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and training counts of the commonest words, at most ``common``, and how often each of them occurs at least."""
    steps = vocabulary.groupBy((F.length(F.bin("n")) - 1).alias("step")).count().orderBy(F.desc("step")).collect()
    least, held = 1 << 62, 0
    for r in steps:  # at most 63 rows
        held += r["count"]
        if held > common:
            break
        least = 1 << r["step"]
    known = vocabulary.filter(F.col("n") >= least).select("h", "c").toArrow()
    names, counts = signed_back(known["h"].to_numpy()), known["c"].to_numpy()
    order = np.argsort(names)
    return names[order], counts[order], least


def base_scores(read: DataFrame, vocabulary: DataFrame | None, total: int, size_v: int) -> DataFrame:
    """row, id, held_out, n_tokens, n_known, base_score, by exact counts; ``vocabulary`` has the rare words."""
    read = read.filter(F.col("part").isNull())
    base = read.select("row", "id", "held_out", "n_tokens", "known", "base", "found")
    if vocabulary is None:
        return base.withColumnsRenamed({"known": "n_known", "base": "base_score"})
    rare = read.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("n"))
    rare = rare.join(vocabulary.filter(F.col("c") > 0).select("h", "c"), "h", "left")
    below = float(np.log10(total + 0.5 * (size_v + 1)))
    of = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(below))).alias("rare_base"),
    )
    zero = F.lit(0)
    return base.join(of, "row", "left").select(
        "row", "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "found",
    )


def lm_scores(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", use: Column | None = None,
    mu: float = MU, limit: int = LIMIT, common: int = COMMON,
) -> DataFrame:
    """A row per row of ``docs``: row, id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``use`` (a condition on ``docs``) says from which rows to learn; the others are held out.
    """
    learnt = F.lit(True) if use is None else F.coalesce(use, F.lit(False))
    docs = fixed(docs)
    rows = numbered(docs.withColumn("_held", ~learnt), text, id_column, "_held").select(
        "row", F.col(f"own_{id_column}").alias("id"), F.col("own__held").alias("held_out"), "body"
    )
    send = docs.sparkSession.sparkContext.broadcast
    with small_batches(docs.sparkSession):
        vocabulary = rows.select("held_out", "body").mapInArrow(_unigrams, "h long, c long, n long")
        vocabulary = written(vocabulary.groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count(F.lit(1))).first()
    total, size_v = int(sums[0]), int(sums[1])
    *known, least = _common_words(vocabulary, common)
    rare = vocabulary.filter(F.col("n") < least) if len(known[0]) < sums[2] else None
    words = send(tuple(known))
    with small_batches(docs.sparkSession):
        filled = written(whole_filter(rows, words, rare is None, total), "filter")

    part = send(common_part(filled.filter(F.col("words").isNull()).select("x", "c", "n"), limit))
    with small_batches(docs.sparkSession):
        read = _read(words, part, rare is None, _segments(BITS * total // 8), total, size_v, mu)
        read = written(rows.mapInArrow(read, _READ), "read")
    words.unpersist()
    part.unpersist()
    with small_batches(docs.sparkSession):
        rest = written(rest_scores(read, filled, rare, total, size_v, mu), "rest")
    scored = base_scores(read, rare, total, size_v).join(rest, "row", "left")
    score = F.col("found") + F.coalesce("rest", F.lit(0.0))
    return scored.withColumn("score", score).drop("found", "rest").withColumn("train_tokens", F.lit(total).cast("long"))
