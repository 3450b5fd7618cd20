"""Align the tokens of two tokenizers over each text, and say how usual each link of two ids is in the corpus.

Side A is a byte-level vocabulary (JSON), side B a piece vocabulary with byte fallback, both over a space and the text. A byte
at which a token of A and one of B end cuts the text into groups; the two tokens that end there are linked.

Merging is in lockstep: each lane (a text, or a part of one, as lanes are ranges of bytes) has a pointer into A and one into B;
one step compares the two ends of all lanes at once, emits links and cuts where they agree, moves the
pointer that is behind (or both), and drops lanes that are done. Lanes are short, so a long text costs no more steps than a short one.

Two linked tokens end at the same byte, so the bytes of one are the end of the other's. All pairs of ids for which this holds
follow from the vocabularies alone, so the counts of links are one vector of fixed length, for any corpus; it is summed up in tasks
and then by pair, and that vector (a number a pair) is what reaches the driver and is broadcast.

Defined: texts that are null, empty, not UTF-8, or not rebuilt byte by byte by both sides have no tokens, no links and the
digest ''. Repeated texts and ids count each time. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valence.llm.common import pieces
from valence.session import written

LANE = 1024
#: Unbroken runs longer than this are given to the slower of two encoders of side A, whose time does not grow with their square.
LONG_RUN = 2000
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def installed(name: str) -> str:
    """The path of a vocabulary of the ``public_tokenizers`` package on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """The bytes of each id, joined, and their lengths."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        place = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[ids] - place, size) + np.arange(int(size.sum()))]


class ByteSide(Side):
    """Side A. Where the merges of the file are in the order of the ids, which is all that ranks can say, ranks are used."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as held:
            model = json.load(held)
        letters, special = _byte_letters(), {x["content"]: x["id"] for x in model["added_tokens"]}
        vocabulary = model["model"]["vocab"]
        entries = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for entry, k in vocabulary.items():
            entries[k] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
        super().__init__(entries)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        ranks = {e: k for k, e in enumerate(entries) if k not in special.values()}
        self.fast = None
        if made == sorted(made) and model["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }:
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, long_run: bool) -> list[int]:
        if self.fast and not long_run:
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceSide(Side):
    """Side B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        super().__init__([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ])

    def encode(self, text: str, long_run: bool) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Vocabularies:
    """Both sides, and all pairs of ids of which one's bytes end with the other's: ``pairs`` (A id * size of B + B id), sorted."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        named = [{}, {}]
        for names, side in zip(named, (self.a, self.b)):
            for k, entry in enumerate(side.entries):
                names.setdefault(entry, []).append(k)
        found = {(k, o) for k, e in enumerate(self.a.entries) for i in range(len(e)) for o in named[1].get(e[i:], ())}
        found |= {(o, k) for k, e in enumerate(self.b.entries) for i in range(len(e)) for o in named[0].get(e[i:], ())}
        self.width = len(self.b.entries)
        self.pairs = np.sort(np.array([a * self.width + b for a, b in found], np.int64))
        self.shown = [_decimals(len(side.entries)) for side in (self.a, self.b)]


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def _decimals(size: int) -> np.ndarray:
    """For each separator (',', the last of a side, none) and id its digits and the separator, filled up with zero bytes."""
    width = len(str(size)) + 1
    rows = [f"{k}{sep}".encode().ljust(width, b"\0") for sep in (",", "#", "") for k in range(size)]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(3, size, width)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked tokens in A and in B. Ends are bytes from the start of the first text, bounds those of the texts."""
    size = np.diff(bounds)
    parts = -(-size // lane)
    low = np.repeat(bounds[:-1], parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * lane
    high = np.minimum(low + lane, np.repeat(bounds[1:], parts))
    state = np.stack([np.searchsorted(ends_a, low, "right"), np.searchsorted(ends_b, low, "right")])
    stop = np.stack([np.searchsorted(ends_a, high, "right"), np.searchsorted(ends_b, high, "right")])
    links = [np.zeros((2, 0), np.int64)]
    alive = (state < stop).all(0)
    while alive.any():
        if not alive.all():
            state, stop = state[:, alive], stop[:, alive]
        a, b = ends_a[state[0]], ends_b[state[1]]
        together = a == b
        links.append(state[:, together])
        state[0] += a <= b
        state[1] += b <= a
        alive = (state < stop).all(0)
    found = np.concatenate(links, axis=1)
    return np.sort(found[0]), np.sort(found[1])


def _written_out(v: Vocabularies, a: np.ndarray, b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` for all texts one after the other (bytes), and where each link's group ends in it."""
    sides = []
    for shown, ids, link, end in ((v.shown[0], a, link_a, b"|"), (v.shown[1], b, link_b, b";")):
        kind = np.zeros(len(ids), np.int8)
        kind[link] = 1
        group = np.cumsum(kind) - kind
        if end == b";":
            kind[last] = 2
        rows = shown[kind, ids]
        sides.append((np.where(rows == ord("#"), ord(end), rows), group))
    (rows_a, group_a), (rows_b, group_b) = sides
    width = max(rows_a.shape[1], rows_b.shape[1])
    out = np.zeros((len(a) + len(b), width), np.uint8)
    before_b = np.concatenate([[0], link_b + 1])[group_a]
    out[np.arange(len(a)) + before_b, : rows_a.shape[1]] = rows_a
    at_b = np.arange(len(b)) + link_a[group_b] + 1
    out[at_b, : rows_b.shape[1]] = rows_b
    lengths = np.cumsum((out != 0).sum(1))
    flat = out.ravel()
    return flat[flat != 0], lengths[at_b[link_b]]


def aligned_block(v: Vocabularies, data: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    """For each text: n_a, n_b, n_links, digest, distinct pairs (places in ``v.pairs``) and how often each is linked."""
    held, tokens = memoryview(data), ([], [])
    whole = np.diff(bounds) > 0
    texts = len(whole)
    blank = np.flatnonzero(np.isin(data, [0x20, 0x0A]))
    for t in range(texts):
        both = ([], [])
        if whole[t]:
            try:
                text = bytes(held[bounds[t] : bounds[t + 1]]).decode()
            except UnicodeDecodeError:
                text, whole[t] = "", False
            if text:
                i, j = np.searchsorted(blank, bounds[t : t + 2])
                run = int(np.diff(np.concatenate([[bounds[t]], blank[i:j], [bounds[t + 1]]])).max())
                long_run = run > LONG_RUN or " " * LONG_RUN in text or "\n" * LONG_RUN in text
                both = (v.a.encode(" " + text, long_run), v.b.encode(text, long_run))
        for side, ids in zip(tokens, both):
            side.append(np.array(ids, np.int32))
    sides = []
    for side, lists in ((v.a, tokens[0]), (v.b, tokens[1])):
        text = np.repeat(np.arange(texts), [len(x) for x in lists])
        ids = np.concatenate(lists)
        sizes = np.bincount(text, side.size[ids], texts).astype(np.int64)
        whole &= sizes == np.diff(bounds) + 1
        sides.append((side, ids, text))
    # The space and the text of all that are left, to be compared byte by byte.
    lengths = np.diff(bounds) + 1
    kept = []
    for side, ids, text in sides:
        ids = ids[whole[text]]
        now = lengths[whole]
        place = np.cumsum(now) - now
        want = np.zeros(int(now.sum()), np.uint8)
        want[place] = 0x20
        rest = np.ones(len(want), bool)
        rest[place] = False
        want[rest] = data[np.repeat(whole, lengths - 1)]
        kept.append((place, side.joined(ids) != want))
    wrong = kept[0][1] | kept[1][1]
    if len(wrong):
        whole[np.flatnonzero(whole)[np.logical_or.reduceat(wrong, kept[0][0])]] = False
    (a, text_a), (b, text_b) = [(ids[whole[text]], text[whole[text]]) for _, ids, text in sides]
    edges = np.concatenate([[0], np.cumsum(lengths[whole])])
    link_a, link_b = lockstep(np.cumsum(v.a.size[a]), np.cumsum(v.b.size[b]), edges)
    text = text_a[link_a]
    n_a, n_b, n_links = (np.bincount(x, minlength=texts) for x in (text_a, text_b, text))
    ends = np.cumsum(n_links)
    digests = [""] * texts
    if len(text):
        last = np.cumsum(n_b)[n_b > 0] - 1
        shown, at = _written_out(v, a, b, link_a, link_b, last)
        start = 0
        for t in np.flatnonzero(n_links).tolist():
            end = int(at[ends[t] - 1])
            digests[t] = hashlib.sha256(shown[start:end]).hexdigest()
            start = end
    pair = np.searchsorted(v.pairs, a[link_a].astype(np.int64) * v.width + b[link_b])
    keys, times = np.unique(text.astype(np.int64) * len(v.pairs) + pair, return_counts=True)
    of, pair = np.divmod(keys, max(1, len(v.pairs)))
    first = np.searchsorted(of, np.arange(texts + 1))
    lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.astype(np.int32))) for x in (pair, times)]
    return [pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(digests), *lists]


def alignment(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the links: ``pairs`` (a, b, times in the text, count)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    kind = dict(texts.dtypes)["id"]
    names = ["id", "n_a", "n_b", "n_links", "groups_sha256", "pair", "times"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        for batch in batches:
            for i, data, bounds in pieces(batch["body"]):
                yield pa.record_batch([batch["id"].slice(i, len(bounds) - 1), *aligned_block(v, data, bounds)], names)

    found = texts.mapInArrow(aligned, f"id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, pair array<int>, times array<int>")
    found = written(found, "aligned")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        count = np.zeros(len(v.pairs), np.int64)
        for batch in batches:
            np.add.at(count, batch["pair"].flatten().to_numpy(), batch["times"].flatten().to_numpy())
        pair = np.flatnonzero(count)
        yield pa.record_batch([pa.array(pair.astype(np.int32)), pa.array(count[pair])], ["pair", "n"])

    counts = found.select("pair", "times").mapInArrow(summed, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    v = vocabularies(path_a, path_b)
    count = np.zeros(len(v.pairs), np.int64)
    count[counts["pair"].to_numpy()] = counts["n"].to_numpy()
    highest = np.zeros(v.width, np.int64)
    np.maximum.at(highest, v.pairs % v.width, count)
    sent = spark.sparkContext.broadcast(count)
    best = spark.sparkContext.broadcast(np.packbits(count == highest[v.pairs % v.width]))
    more = "n_best long, count_sum long, links array<struct<a:int,b:int,times:int,count:long>>"
    kept = ["id", "n_a", "n_b", "n_links", "groups_sha256"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        is_best = np.unpackbits(best.value, count=len(v.pairs)).astype(bool)
        for batch in batches:
            first = np.concatenate([[0], np.cumsum(batch["pair"].value_lengths().to_numpy())])
            pair, times = (batch[c].flatten().to_numpy() for c in ("pair", "times"))
            n = sent.value[pair]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[first]) for x in (times * is_best[pair], times * n)]
            a, b = np.divmod(v.pairs[pair], v.width)
            fields = [pa.array(x) for x in (a.astype(np.int32), b.astype(np.int32), times, n)]
            links = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(fields, ["a", "b", "times", "count"]))
            yield pa.record_batch([*(batch[c] for c in kept), *map(pa.array, sums), links], [*kept, "n_best", "count_sum", "links"])

    out = found.mapInArrow(judged, f"id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, {more}")
    return out.withColumn("n_groups", F.col("n_links"))
