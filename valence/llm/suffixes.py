"""Remove what texts repeat of earlier ones: every byte inside a string of 100 bytes that also starts earlier.

A window is a string of ``WINDOW`` bytes of one text. The place in it where the ``LEAD`` bytes with the least hash start is its
anchor; equal windows have it at the same place, so only suffixes at anchors (one in about 35 bytes) are compared. An
anchor goes with the bytes that its windows reach (its hull, at most 168 bytes).

1. Anchors are counted by the hash of their lead. A window whose lead occurs once has no equal.
2. Hulls with repeated leads are range-partitioned by their leading bytes with sampled splitters. Before that each
   task joins equal hulls of some megabytes of text, so a text that occurs often sends one hull a task.
3. Each bucket sorts the suffixes from the anchors forward and the prefixes backward by multikey quicksort. Two windows with the
   anchor at the same distance from their starts are equal if neighbours in both orders share enough bytes all the way between them.
   Of equal windows all but the first (smaller id, then start) are removed.
4. A lead with more than ``HOT`` different hulls may not fit a bucket. Its windows are sorted each by its own 100 bytes instead.
   A window that is so frequent that several splitters are equal to it is dealt over the buckets between them; the
   first of each such bucket is compared with those across the boundaries.

Ranges are divided further by a hash of the lead where the sample has fewer splitters than buckets are needed, so buckets
hold about ``BUCKET`` hulls at any size. Splitters only decide where a comparison is made, never its result. The filters of
repeated and hot leads have a fixed size; with very many repeated leads they let unrepeated ones through, which costs work alone.

Defined: null texts are empty. Of rows with one id, and of those without (which come last), the one with the smaller row number is earlier,
in the order of files and their rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valence.llm.common import bloom_filter, fixed, may_hold, mixed, numbered, pieces, signed, small_batches
from valence.session import written

#: Bytes of a repeated string, bytes by which anchors are chosen, and the most bytes before an anchor.
WINDOW, LEAD = 100, 32
REACH = WINDOW - LEAD
#: Hulls of a bucket, different hulls of a lead above which its windows are sorted each by itself, and keys that splitters are taken from.
BUCKET, HOT, SAMPLE = 1 << 14, 4096, 20000
#: Documents that splitters are sampled from, about.
SAMPLED = 2000
SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 23) - 1)
_FACTORS = mixed(np.arange(1, 32, dtype=np.uint64)) | np.uint64(1)


def segments(bodies: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts, their bounds, which text each is of and where in it. Long texts come in parts that overlap by a window less 1."""
    for i, data, bounds in pieces(bodies, SEGMENT):
        if len(data) <= SEGMENT:
            yield data, bounds, np.arange(i, i + len(bounds) - 1), np.zeros(len(bounds) - 1, np.int64)
            continue
        step = SEGMENT - WINDOW + 1
        for t in range(len(bounds) - 1):
            body = data[bounds[t] : bounds[t + 1]]
            for start in range(0, max(1, len(body) - WINDOW + 1), step):
                part = body[start : start + SEGMENT]
                yield part, np.array([0, len(part)]), np.array([i + t]), np.array([start])


class Anchors:
    """Runs of windows with one anchor: first and last window (lo, hi), the anchor (at), and the hash of its lead."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        self.data = data
        starts, ends = bounds[:-1], bounds[1:] - WINDOW + 1
        long = ends > starts
        marks = np.zeros(n + 1, np.int8)
        marks[starts[long]] += 1
        marks[ends[long]] -= 1
        windows = np.flatnonzero(np.cumsum(marks[:n], dtype=np.int8))
        self.hash = np.zeros(0, np.uint64)
        if not len(windows):
            self.lo = self.hi = self.at = self.text = windows
            self.lead = self.hash
            return
        held = np.concatenate([data, np.zeros(LEAD, np.uint8)])
        words = np.array(np.ndarray((n + LEAD - 8,), "<u8", held, 0, (1,)))
        with np.errstate(over="ignore"):
            key = words[:n] * _FACTORS[0]
            for k in range(1, LEAD // 8):
                key += words[8 * k : 8 * k + n] * _FACTORS[k]
        self.hash = mixed(key)
        least = (self.hash & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at = (least[windows] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(windows) != 1)]))
        last = np.append(first[1:], len(windows)) - 1
        self.lo, self.hi, self.at = windows[first], windows[last], at[first]
        self.lead = self.hash[self.at]
        self.text = np.searchsorted(bounds, self.lo, "right") - 1

    def shapes(self) -> np.ndarray:
        """A hash by which different hulls of a lead can be counted."""
        with np.errstate(over="ignore"):
            ends = self.hash[self.lo] * _FACTORS[5] + self.hash[self.hi + REACH] * _FACTORS[6]
            return mixed(ends + (self.at - self.lo).astype(np.uint64) * _FACTORS[7] + (self.hi - self.lo).astype(np.uint64))

    def hulls(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of bytes for each hull, the anchor at REACH, zero outside the hull; and where the hull is."""
        held = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(WINDOW, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(held, REACH + WINDOW)[self.at[which]]
        column = np.arange(REACH + WINDOW)
        inside = column >= (REACH - (self.at - self.lo)[which])[:, None]
        inside &= column < (REACH + WINDOW + (self.hi - self.at)[which])[:, None]
        rows *= inside
        return rows, inside


def first_of_equal(rows: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each row whether an equal one (with equal ``more``) comes before it. Rows of equal hash are compared byte by byte."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view("<u8")
    with np.errstate(over="ignore"):
        key = more.astype(np.uint64) * _FACTORS[30]
        for k in range(words.shape[1]):
            key += words[:, k] * _FACTORS[k]
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(rows), bool)
    near = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[near], order[near + 1]
    equal = (words[a] == words[b]).all(1) & (more[a] == more[b])
    same[b[equal]] = True
    return same


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of the rows by their bytes: eight at a time, and only within what is equal so far."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8")
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # number of the group that each place of the order is in
    open_ = np.arange(n)  # places whose group has more than one row
    for k in range(words.shape[1]):
        if not len(open_):
            break
        key = words[order[open_], k].astype(np.uint64)
        now = np.lexsort((key, group[open_]))
        order[open_] = order[open_[now]]
        key, of = key[now], group[open_]
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
        # A group is named by its first place, so names stay in order when it is divided.
        group[open_] = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        size = np.diff(np.append(np.flatnonzero(fresh), len(open_)))
        open_ = open_[np.repeat(size, size) > 1]
    return order


def shared(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it in the order (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 1 << 14):
        j = min(len(rows), i + (1 << 14))
        differ = rows[order[i:j]] != rows[order[i - 1 : j - 1]]
        out[i:j] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def repeated_windows(rows: np.ndarray, left: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of these hulls that equal a window of an earlier row: hull and bytes from its start to the anchor; and the hulls
    (one window each, the anchor its start) that are the first of their kind.

    ``rows`` has the anchor at REACH; hull i has ``windows[i]`` windows, the first ``left[i]`` bytes before its anchor.
    """
    n = len(rows)
    forward, backward = rows[:, REACH:], np.ascontiguousarray(rows[:, REACH - 1 :: -1] if REACH else rows[:, :0])
    sides = []
    for part in (forward, backward):
        order = multikey_sort(part)
        sides.append((order, shared(part, order)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    named = np.empty((2, n), np.int64)
    for distance in range(REACH + 1):
        valid = np.flatnonzero((left >= distance) & (left - distance < windows))
        if len(valid) < 2:
            continue
        for name, (order, same), size in zip(named, sides, (WINDOW - distance, distance)):
            name[order] = np.cumsum(same < size)
        key = named[0][valid] * (n + 1) + named[1][valid]
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
        hull = valid[order[again]]
        found.append((hull, np.full(len(hull), distance)))
    hull, distance = (np.concatenate(x) for x in zip(*found))
    first = np.ones(n, bool)
    first[hull] = False
    return hull, distance, first


def spans_of(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (owner, start) joined to spans of bytes where they overlap or touch: owner, from, to."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + WINDOW)])) if len(owner) else owner
    last = np.append(fresh[1:], len(owner)) - 1 if len(owner) else owner
    return owner[fresh], start[fresh], start[last] + WINDOW


def _lead_counts(texts: DataFrame) -> DataFrame:
    """lead, occ (anchors) and hulls (different ones in a block, summed up)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, _, _ in segments(batch["body"]):
                found = Anchors(data, bounds)
                order = np.lexsort((shape := found.shapes() if len(found.at) else found.hash, found.lead))
                lead, shape = found.lead[order], shape[order]
                fresh = np.concatenate([[True], lead[1:] != lead[:-1]])[: len(lead)]
                other = fresh | np.concatenate([[True], shape[1:] != shape[:-1]])[: len(lead)]
                first = np.flatnonzero(fresh)
                occ = np.diff(np.append(first, len(lead)))
                hulls = np.add.reduceat(other.astype(np.int64), first) if len(first) else occ
                yield pa.record_batch([pa.array(signed(lead[first])), pa.array(occ), pa.array(hulls)], ["lead", "occ", "hulls"])

    found = texts.select("body").mapInArrow(counted, "lead long, occ long, hulls long")
    return found.groupBy("lead").agg(F.sum("occ").alias("occ"), F.sum("hulls").alias("hulls"))


class _Found:
    """What a segment sends: hulls of repeated leads, windows of hot ones, and the spans that it can tell by itself."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, rank: np.ndarray, repeated: np.ndarray, hot: np.ndarray, combine: bool):
        a = Anchors(data, bounds)
        kept = np.flatnonzero(may_hold(repeated, a.lead))
        kept = kept[np.lexsort((a.at[kept], rank[a.text[kept]]))]
        often = may_hold(hot, a.lead[kept])
        self.span_text, self.span_from, self.span_to = [], [], []
        rows, inside = a.hulls(kept[~often])
        which = kept[~often]
        left, windows = (a.at - a.lo)[which], (a.hi - a.lo)[which] + 1
        if combine:
            again = first_of_equal(rows, left * WINDOW + windows)
            self._add(a.text[which[again]], a.lo[which[again]], a.hi[which[again]] + WINDOW)
            rows, inside, which, left, windows = (x[~again] for x in (rows, inside, which, left, windows))
        size = inside.sum(1)
        self.hulls = (a.text[which], a.at[which], left, windows, rows[inside], size, a.lead[which])
        self.leads = np.ascontiguousarray(rows[:, REACH : REACH + LEAD]).view(f"S{LEAD}").ravel()
        which = kept[often]
        count = (a.hi - a.lo)[which] + 1
        at = np.repeat(a.lo[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        text = np.repeat(a.text[which], count)
        rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at] if len(at) else np.zeros((0, WINDOW), np.uint8)
        if combine:
            again = first_of_equal(rows, np.zeros(len(rows), np.int64))
            self._add(*spans_of(text[again], at[again]))
            rows, at, text = rows[~again], at[~again], text[~again]
        self.windows = (text, at, rows)
        self.keys = np.ascontiguousarray(rows).view(f"S{WINDOW}").ravel() if len(rows) else np.zeros(0, f"S{WINDOW}")

    def _add(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.span_text.append(text)
        self.span_from.append(start)
        self.span_to.append(end)


def _ranks(batch: pa.RecordBatch) -> np.ndarray:
    """The order of the rows of a batch: by id, then row, rows without an id last."""
    ids, none = batch["order_id"], np.asarray(batch["order_id"].is_null())
    order = np.lexsort((batch["row"].to_numpy(), ids.fill_null(0).to_numpy(), none))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


_SENT = "kind byte, bucket long, row long, order_id long, at long, left short, windows short, lead_edge boolean, body binary, upto long"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _sent(batch: pa.RecordBatch, kind: int, of: np.ndarray, *columns: np.ndarray | pa.Array | None) -> pa.RecordBatch:
    """A batch of rows sent for texts ``of``; columns: bucket, at, left, windows, lead_edge, body, upto (None: null)."""
    types = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary(), pa.int64()]
    bucket, at, left, windows, edge, body, upto = [
        pa.nulls(len(of), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)
    ]
    of = pa.array(of)
    kinds = pa.array(np.full(len(of), kind, np.int8))
    return pa.record_batch([kinds, bucket, batch["row"].take(of), batch["order_id"].take(of), at, left, windows, edge, body, upto], _NAMES)


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def removed_spans(rows: DataFrame) -> DataFrame:
    """row, ``from`` and ``upto`` (bytes) of what repeats earlier bytes; spans may overlap. ``rows``: row, body, order_id."""
    spark = rows.sparkSession
    with small_batches(spark):
        leads = written(_lead_counts(rows).filter("occ > 1").select("lead", "hulls"), "leads")
    sizes = leads.groupBy((F.col("hulls") > HOT).alias("hot")).agg(F.sum("hulls").alias("n")).collect()
    sizes = {r["hot"]: r["n"] for r in sizes}
    repeated, hot = bloom_filter(leads, "lead"), bloom_filter(leads.filter(F.col("hulls") > HOT), "lead", 20)
    total = rows.select("row").count()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, texts, _ in segments(batch["body"]):
                found = _Found(data, bounds, np.arange(len(texts)), repeated.value, hot.value, False)
                for kind, key, width in ((0, found.leads, LEAD), (1, found.keys, WINDOW)):
                    yield pa.record_batch([pa.array(np.full(len(key), kind)), _binary(key.view(np.uint8), np.full(len(key), width))], ["kind", "key"])

    part = rows.filter(F.pmod(F.xxhash64(F.col("row")), F.lit(max(1, total // SAMPLED))) == 0)
    drawn = part.select("body").mapInArrow(keys, "kind long, key binary").withColumn("r", F.rand(7))
    splitters, parts = [], []
    for kind, width in ((0, LEAD), (1, WINDOW)):
        sample = sorted(r["key"] for r in drawn.filter(F.col("kind") == kind).orderBy("r").limit(SAMPLE).collect())
        # Windows are as many as a hull has, less what a task joins.
        wanted = -(-sizes.get(kind == 1, 0) * (WINDOW // 3 if kind else 1) // BUCKET)
        ranges = min(wanted, len(sample))
        chosen = [sample[k * len(sample) // ranges] for k in range(1, ranges)]
        splitters.append(np.array(chosen, f"S{width}") if chosen else np.zeros(0, f"S{width}"))
        parts.append(max(1, -(-wanted // max(1, ranges))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = _ranks(batch)
            for data, bounds, texts, offsets in segments(batch["body"]):
                found = _Found(data, bounds, rank[texts], repeated.value, hot.value, True)
                offset = offsets - bounds[:-1]
                text, at, left, windows, flat, size, lead = found.hulls
                bucket = np.searchsorted(splitters[0], found.leads, "right") * parts[0] + (lead % np.uint64(parts[0])).astype(np.int64)
                yield _sent(batch, 0, texts[text], bucket, at + offset[text], left, windows, np.zeros(len(text), bool), _binary(flat, size), None)
                text, at, rows_ = found.windows
                low, high = (np.searchsorted(splitters[1], found.keys, side) for side in ("left", "right"))
                # Equal windows go together, unless several splitters are equal to them: then these share them out.
                edge = high > low + 1
                spot = mixed(np.uint64(int(rank.sum()) + len(data)) + at.astype(np.uint64))
                bucket = np.where(edge, low + 1 + (spot % np.maximum(1, high - low).astype(np.uint64)).astype(np.int64), high) * parts[1]
                if parts[1] > 1 and len(rows_):
                    bucket += (mixed(np.ascontiguousarray(rows_[:, :96]).view("<u8") @ _FACTORS[:12]) % np.uint64(parts[1])).astype(np.int64)
                none = np.zeros(len(text), np.int64)
                body = _binary(rows_.ravel(), np.full(len(text), WINDOW))
                yield _sent(batch, 1, texts[text], bucket, at + offset[text], none, none + 1, edge, body, None)
                text, start, end = (np.concatenate(x) for x in (found.span_text, found.span_from, found.span_to))
                yield _sent(batch, 2, texts[text], None, start + offset[text], None, None, None, None, end + offset[text])

    with small_batches(spark):
        found = written(rows.mapInArrow(sent, _SENT), "suffixes")
    repeated.unpersist()
    hot.unpersist()

    def sorted_bucket(table: pa.Table) -> pa.Table:
        order_id = table["order_id"]
        at = table["at"].to_numpy()
        order = np.lexsort((at, table["row"].to_numpy(), order_id.fill_null(0).to_numpy(), np.asarray(order_id.is_null())))
        table, at = table.take(pa.array(order)), at[order]
        left, windows = (table[c].to_numpy().astype(np.int64) for c in ("left", "windows"))
        body = table["body"].combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        bounds = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
        data, size = np.frombuffer(body.buffers()[2], np.uint8), np.diff(bounds)
        rows_ = np.zeros((len(size), REACH + WINDOW), np.uint8)
        column = np.arange(REACH + WINDOW)
        inside = (column >= (REACH - left)[:, None]) & (column < (REACH - left + size)[:, None])
        rows_[inside] = data[bounds[0] : bounds[-1]]
        hull, distance, first = repeated_windows(rows_, left, windows)
        owner, start, end = spans_of(hull, at[hull] - distance)
        row = table["row"].combine_chunks()
        spans = _out(row, owner, start, end, table, None)
        edges = np.flatnonzero(first & table["lead_edge"].to_numpy())
        return pa.concat_tables([spans, _out(row, edges, at[edges], at[edges] + WINDOW, table, edges)])

    sent_schema = "row long, start long, upto long, order_id long, window binary"
    compared = found.filter("kind < 2").select("kind", "bucket", "row", "order_id", "at", "left", "windows", "lead_edge", "body")
    compared = written(compared.groupBy("kind", "bucket").applyInArrow(sorted_bucket, sent_schema), "spans")
    # Windows that are dealt over several buckets: the first of each of these against the first of all.
    edges = compared.filter("window IS NOT NULL")
    place = F.struct(F.col("order_id").isNull().alias("none"), "order_id", "row", "start")
    least = edges.groupBy("window").agg(F.min(place).alias("least"))
    later = edges.join(least, "window").filter(~place.eqNullSafe(F.col("least")))
    spans = found.filter("kind = 2").select("row", F.col("at").alias("start"), "upto")
    return spans.unionByName(compared.filter("window IS NULL").select("row", "start", "upto")).unionByName(later.select("row", "start", "upto"))


def _out(row: pa.Array, owner: np.ndarray, start: np.ndarray, end: np.ndarray, table: pa.Table, edges: np.ndarray | None) -> pa.Table:
    of = pa.array(owner)
    more = [pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.binary())]
    if edges is not None:
        more = [table["order_id"].take(of).combine_chunks(), table["body"].take(of).combine_chunks()]
    return pa.table([row.take(of), pa.array(start), pa.array(end), *more], ["row", "start", "upto", "order_id", "window"])


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", kept_text: bool = True) -> DataFrame:
    """row, id, n_bytes, n_removed, n_spans, kept_sha256, ``spans`` (from, to; joined) and, if wanted, ``kept`` (bytes) per row."""
    rows = numbered(fixed(docs, id_column, text), text, id_column)
    kind = dict(rows.dtypes)[f"own_{id_column}"]
    rows = rows.select("row", F.col("body").cast("binary").alias("body"), F.col(f"own_{id_column}").alias("id"))
    rows = rows.withColumn("order_id", F.col("id").cast("long"))
    spans = removed_spans(rows.select("row", "body", "order_id"))
    spans = written(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "upto"))).alias("spans")), "removed")
    joined = rows.select("row", "id", "body").join(spans, "row", "left")
    schema = f"row long, id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,upto:long>>"
    schema += ", kept binary" if kept_text else ""
    names = ["row", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * kept_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in zip(batch["body"], batch["spans"]):
                held, sha, at, removed, kept, joined_ = memoryview(body.as_buffer()), hashlib.sha256(), 0, 0, [], []
                if found.is_valid:
                    start, upto = (found.values.field(k).to_numpy() for k in (0, 1))
                    furthest = np.maximum.accumulate(upto)
                    first = np.flatnonzero(np.concatenate([[True], start[1:] > furthest[:-1]]))
                    last = np.append(first[1:], len(start)) - 1
                    joined_ = list(zip(start[first].tolist(), furthest[last].tolist()))
                for a, b in [*joined_, (len(held), len(held))]:
                    sha.update(held[at:a])
                    kept.append(held[at:a])
                    removed += b - a
                    at = b
                spans_ = [{"start": a, "upto": b} for a, b in joined_]
                out.append((len(held), removed, len(joined_), sha.hexdigest(), spans_, *([b"".join(kept)] if kept_text else [])))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("upto", pa.int64())])), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds[: len(names) - 2]]
            yield pa.record_batch([batch["row"], batch["id"], *columns], names)

    return joined.mapInArrow(cut, schema)
