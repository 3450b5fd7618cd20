"""Best-fit packing of texts into training sequences, with conflicts.

A sequence (bin) holds ``capacity`` tokens (runs of visible characters, and an end for each text). No bin holds two
texts of one source or of one cluster of copies. A text longer than a bin is cut into whole bins and a rest.

Clusters come from a column, such as the classes of ``near_groups``. Without one, a text is in ``BANDS`` clusters, each named by the least
hashes of its five-word shingles under two functions (a band). Texts that share a cluster may be copies: those with a similarity
of 0.8 do in all but (1 - 0.8**2)**BANDS of the cases (0.017), of 0.9 in all but 0.001, equal ones (but for white space, case and
punctuation) always. A line that many texts have is seldom the least under both.

Texts are read and counted once, into a table of a few numbers a row that everything else starts from. Whole bins need no packing.
All other pieces are dealt into shards of about ``shard`` pieces by a hash of the row, so
hot sources and clusters spread evenly, and each shard is packed by itself. In a shard pieces come longest first.
Open bins are ordered by the room they have left; for a piece the search starts at
the least room that is enough and goes on to the next bin until source and clusters are new to it. Each bin carries two bitmaps:
the sources and clusters it has, numbered within the shard. If no bin is compatible a new one is opened, so nothing is left out.
What the shards lose is at most their last bins.

Defined: null and empty texts have one token, the end, and no cluster of their own. Rows without a source conflict with nothing by source,
rows without a cluster nothing by cluster. Ties are broken by row, so the result is the same each time. Repeated rows are packed each by itself.
Ids may be of any type and null; they pass through as they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valence.llm.common import Words, mixed, numbered, pieces, shingles, signed
from valence.session import written

CAPACITY = 2048
SHARD = 2000
#: Clusters that a text is in if none are given.
BANDS = 4
_SEEDS = mixed(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


class Bins:
    """Open bins in the order of the room left, each with bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # room, bin
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the start of a piece; source and cluster are single bits or 0."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            room, found = self.open[at]
            if not (self.sources[found] & source or self.clusters[found] & cluster):
                del self.open[at]
                break
            at += 1
        else:
            found, room = len(self.used), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        self.sources[found] |= source
        self.clusters[found] |= cluster
        start = self.used[found]
        self.used[found] += size
        if room > size:
            insort(self.open, (room - size, found))
        return found, start


def pack(n_tokens: np.ndarray, source: list[int], clusters: list[list[int]], row: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and start of each piece: best fit, longest first. Sources and clusters are numbers from 0, -1 for none."""
    order = np.lexsort((row, -n_tokens))
    bins, found = Bins(capacity), np.zeros((2, len(row)), np.int64)
    for k in order.tolist():
        bits = 0
        for c in clusters[k]:
            bits |= 1 << c
        found[:, k] = bins.place(int(n_tokens[k]), 1 << source[k] if source[k] >= 0 else 0, bits)
    return found[0], found[1]


def _counted(minima: bool):
    """Tokens of each text and, if wanted, the least hashes of its shingles."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "body"]
            for i, data, bounds in pieces(batch["body"]):
                n = len(bounds) - 1
                tokens = np.diff(Words(data, bounds, "visible").first) + 1
                lists = batch["clusters"].slice(i, n)
                if minima:
                    hashes, text, _ = shingles(Words(data, bounds, "plain"), 5)
                    first = np.searchsorted(text, np.arange(n + 1))
                    full = np.flatnonzero(np.diff(first))
                    least = [np.minimum.reduceat(mixed(hashes ^ s), first[full]) for s in _SEEDS] if len(full) else []
                    bands = [mixed(a ^ mixed(b)) for a, b in zip(least[::2], least[1::2])]
                    flat = np.stack(bands, 1).ravel() if bands else np.zeros(0, np.uint64)
                    ends = np.concatenate([[0], np.cumsum(np.where(np.diff(first) > 0, BANDS, 0))])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat)))
                columns = [lists if c == "clusters" else batch[c].slice(i, n) for c in kept]
                yield pa.record_batch([*columns, pa.array(tokens)], [*kept, "tokens"])

    return counted


def _numbers(lists: pa.ChunkedArray) -> list[list[int]]:
    """Clusters of each piece by number, without those that only one piece has."""
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    of = lists.value_parent_indices().to_numpy()
    names, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    pairs = np.unique(np.stack([number, of]), axis=1) if len(of) else np.zeros((2, 0), np.int64)
    often = np.bincount(pairs[0], minlength=len(names)) > 1
    renamed = np.cumsum(often) - 1
    out: list[list[int]] = [[] for _ in range(len(lists))]
    for c, k in zip(*pairs[:, often[pairs[0]]].tolist()):
        out[k].append(int(renamed[c]))
    return out


def packed(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str | None = "source",
    cluster: str | None = None, capacity: int = CAPACITY, shard: int = SHARD,
) -> DataFrame:
    """A row per piece: row, id, piece, first_token, n_tokens, shard, bin, start.

    ``shard`` and ``bin`` together name a bin; whole bins have a shard below 0 (by piece) and the number of the row.
    ``cluster`` names a column with the clusters of copies.
    """
    rows = numbered(docs, text, id_column, *([source] if source else []), *([cluster] if cluster else []))
    kind = dict(rows.dtypes)[f"own_{id_column}"]
    own = F.xxhash64(F.col(f"own_{cluster}")) if cluster else None
    clusters = F.when(F.col(f"own_{cluster}").isNotNull(), F.array(own)) if cluster else F.lit(None)
    rows = rows.select(
        "row", F.col(f"own_{id_column}").alias("id"), (F.col(f"own_{source}") if source else F.lit(None)).cast("string").alias("source"),
        F.coalesce(clusters, F.array()).cast("array<long>").alias("clusters"), F.col("body").cast("binary").alias("body"),
    )
    counted = rows.mapInArrow(_counted(cluster is None), f"row long, id {kind}, source string, clusters array<long>, tokens long")
    rows = written(counted, "counted")
    whole = F.expr(f"CAST(tokens DIV {capacity} AS INT)")
    rest = F.col("tokens") % capacity
    full = rows.filter(whole > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1))).select(
        "row", "id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"),
        (-1 - F.col("piece")).cast("long").alias("shard"), F.col("row").alias("bin"), F.lit(0).cast("long").alias("start"),
    )
    parts = rows.filter(rest > 0).select(
        "row", "id", whole.alias("piece"), (whole.cast("long") * capacity).alias("first_token"), rest.alias("n_tokens"), "source", "clusters"
    )
    shards = max(1, -(-parts.count() // shard))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def pack_shard(table: pa.Table) -> pa.Table:
        source = table["source"].combine_chunks().dictionary_encode()
        source = source.combine_chunks() if isinstance(source, pa.ChunkedArray) else source
        numbers = source.indices.fill_null(-1).to_pylist()
        where = pack(table["n_tokens"].to_numpy(), numbers, _numbers(table["clusters"]), table["row"].to_numpy(), capacity)
        table = table.drop_columns(["source", "clusters"])
        return table.append_column("bin", pa.array(where[0])).append_column("start", pa.array(where[1]))

    columns = f"row long, id {kind}, piece int, first_token long, n_tokens long, shard long, bin long, start long"
    return parts.groupBy("shard").applyInArrow(pack_shard, columns).unionByName(full)
