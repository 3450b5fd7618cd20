"""Fill-in-the-middle training texts from a piece table.

The texts of a batch are one buffer that is never written to, and the three sentinels another. A document is a list of
descriptors (buffer, start, end). Cutting splits its only descriptor in three, an arrangement permutes these and puts
descriptors of sentinels between them, and the inverse permutation restores the order. Hashes and outputs stream the
bytes behind the descriptors in order; no text is edited.

A text of n units (white space with the word after it; white space at the end is a unit of its own) is cut after
two numbers of units that follow from the seed and the id alone. ``restored`` goes the other way: an output is cut at its sentinels.

Defined: null texts are empty; empty texts and texts that hold a sentinel stay plain, with null lengths. A null id counts as the
empty text when numbers are drawn. Repeated ids are cut by the same numbers, each in its own text. White space is
``[\\x20\\x09-\\x0D]``. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valence.llm.common import pieces

#: The sentinels, and the places of prefix, middle and suffix (0, 1, 2) in the two arrangements.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ARRANGED = {"psm": (("prefix", 0), ("suffix", 2), ("middle", 1)), "spm": (("suffix", 2), ("prefix", 0), ("middle", 1))}

Descriptor = tuple[memoryview, int, int]

_MARKS = memoryview(b"".join(SENTINELS.values()))
_MARK = {name: (_MARKS, 3 * k, 3 * k + 3) for k, name in enumerate(SENTINELS)}
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def stream(table: list[Descriptor]) -> Iterator[memoryview]:
    return (held[start:end] for held, start, end in table)


def digest(table: list[Descriptor]) -> str:
    sha = hashlib.sha256()
    for part in stream(table):
        sha.update(part)
    return sha.hexdigest()


def cut(piece: Descriptor, *places: int) -> list[Descriptor]:
    """The descriptor split at these places of its buffer."""
    held, start, end = piece
    edges = [start, *places, end]
    return [(held, a, b) for a, b in zip(edges, edges[1:])]


def arranged(parts: list[Descriptor], form: str) -> list[Descriptor]:
    """Prefix, middle and suffix in the order of the form, each after its sentinel (the first of a plain text alone)."""
    return parts if form == "plain" else [x for name, k in ARRANGED[form] for x in (_MARK[name], parts[k])]


def rebuilt(output: bytes | memoryview, form: str) -> list[Descriptor]:
    """Descriptors of the text, in order, over the output it was made into."""
    held = memoryview(output)
    if form == "plain":
        return [(held, 0, len(held))]
    found, data = {}, bytes(output)
    names = [name for name, _ in ARRANGED[form]]
    at = [0]
    for name in names[1:]:
        at.append(data.index(SENTINELS[name], at[-1] + 3))
    for (_, k), start, end in zip(ARRANGED[form], at, [*at[1:], len(data)]):
        found[k] = (held, start + 3, end)
    return [found[k] for k in sorted(found)]


class Units:
    """Where the units of some texts end (places in the joined bytes), in order of the texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        blank = _BLANK[data]
        last = np.zeros(len(data), bool)
        last[:-1] = ~blank[:-1] & blank[1:]
        full = bounds[1:] > bounds[:-1]
        last[bounds[1:][full] - 1] = True
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.ends, bounds, "right")
        self.first[0] = 0
        self.bounds = bounds

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def after(self, text: int, units: int) -> int:
        return int(self.ends[self.first[text] + units - 1]) if units else int(self.bounds[text])


def numbers(seed: int, name: str) -> list[int]:
    """Four numbers of 32 bits for an id."""
    found = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(found[k : k + 4], "big") for k in (0, 4, 8, 12)]


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80,
    outputs: bool = True,
) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if wanted, output, per row.

    ``rate`` percent of the texts are changed, of these ``spm`` percent have the suffix first. ``restored_sha256`` is that of the
    text that ``rebuilt`` finds in the output.
    """
    texts = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    kind = dict(texts.dtypes)["id"]
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["name"].to_pylist()
            for i, data, bounds in pieces(batch["body"]):
                units, held, rows = Units(data, bounds), memoryview(data), []
                for t, n in enumerate(units.count().tolist()):
                    whole = (held, int(bounds[t]), int(bounds[t + 1]))
                    h = numbers(seed, names[i + t])
                    body = bytes(held[whole[1] : whole[2]])
                    plain = not body or h[2] % 100 >= rate or any(x in body for x in SENTINELS.values())
                    form = "plain" if plain else "spm" if h[3] % 100 < spm else "psm"
                    parts, chars = [whole], (None, None)
                    if not plain:
                        parts = cut(whole, *(units.after(t, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))))
                        chars = tuple(int(((data[a:b] & 0xC0) != 0x80).sum()) for _, a, b in parts[:2])
                    table = arranged(parts, form)
                    output = b"".join(stream(table))
                    rows.append((n, form, *chars, digest(table), digest(rebuilt(output, form)), *([output] if outputs else [])))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                own = batch["id"].slice(i, len(bounds) - 1)
                yield pa.record_batch([own, *columns], ["id", *schema_names[1:]])

    schema_names = [x.split()[0] for x in (schema + (", output binary" if outputs else "")).split(", ")]
    found = texts.mapInArrow(made, schema + (", output binary" if outputs else ""))
    return found.withColumn("output", F.col("output").cast("string")) if outputs else found


def restored(made: DataFrame, output: str = "output", form: str = "form", *keep: str) -> DataFrame:
    """``text``: the text behind each output, and the columns to keep. Outputs and forms are those of ``fill_in_middle``."""
    rows = made.select(*keep, F.col(form).alias("_form"), F.col(output).cast("binary").alias("_output"))
    kept = rows.select(*keep)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["_output"].to_pylist(), batch["_form"].to_pylist())
            texts = [b"".join(stream(rebuilt(o, f))) for o, f in pairs]
            columns = [batch[c] for c in keep]
            yield pa.record_batch([*columns, pa.array(texts, pa.binary())], [*keep, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "text binary"])
    return rows.mapInArrow(back, schema).withColumn("text", F.col("text").cast("string"))
