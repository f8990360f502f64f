"""Fill-in-middle examples: a text is cut at two line ends and its parts are put in another order.

One match of ``(unit)*`` over the whole text keeps every repetition of its group, so the ends of
that group are all line ends at once: their number is the number of lines, and two of them are
the cuts. Which two, and which form, follows from a digest of the document's key alone, so a job
that is run again gives the same examples.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import keyed_text, text_blocks

# What marks the prefix, the suffix and the middle, and what a unit is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
SEED = 7
RATE = 100  # per cent of the texts that are rearranged
SPM_RATE = 50  # per cent of those whose suffix comes first
MATCH_CHARS = 1 << 20  # the library keeps about 200 bytes for each repetition of one match


def draws(key: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the digest of the seed and the key in decimal; a null key counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


class Cutter:
    """Line ends of a text by repeated captures."""

    def __init__(self, unit: str = UNIT):
        self.units = regex.compile(f"({unit})*")

    def ends(self, text: str) -> list[int]:
        """The end of every unit. A text of over ``MATCH_CHARS`` characters is matched in runs of whole lines, to bound what the library keeps."""
        if len(text) <= MATCH_CHARS:
            return self.units.fullmatch(text).ends(1)
        out, start = [], 0
        while start < len(text):
            stop = text.find("\n", start + MATCH_CHARS - 1) + 1 or len(text)
            out += self.units.fullmatch(text, start, stop).ends(1)
            start = stop
        return out


def rearranged(text: str, ends: list[int], draw: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int | None, int | None, str]:
    """Form, characters of the prefix and of the middle, and the example."""
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draw[2] % 100 >= rate:
        return "plain", None, None, text
    first, second = sorted((draw[0] % (len(ends) + 1), draw[1] % (len(ends) + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < spm_rate:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def examples(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output``: one example for every input row.

    A null text counts as empty; an empty text, and one that holds a mark, stays as it is (form
    ``plain``, null lengths). Repeated rows and keys give equal draws; a null key draws as a key
    without digits. A text of any length is one row. An empty table gives an empty one. Other
    columns are left out, so no name can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for block in text_blocks(batches):
            texts = block.column("text").to_pylist()
            ends = [cutter.ends(t) for t in texts]
            made = [rearranged(t, e, d, rate, spm_rate) for t, e, d in zip(texts, ends, block.column("draw").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("key"),
                    pa.array([len(e) for e in ends], pa.int64()),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.int64()),
                    pa.array([m[2] for m in made], pa.int64()),
                    pa.array([m[3] for m in made], pa.string()),
                ],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = keyed_text(docs, key, text).withColumn("draw", draws(F.col("key"), seed))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, output STRING").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text from which an example was made, from the example and its form alone.

    No part holds a mark, and no mark can begin in one part and end in the next, so the first
    occurrence of each mark is the one that was put there.
    """

    def between(left: str, right: str | None) -> Column:
        after = F.substr(output, F.locate(left, output) + F.lit(len(left)))
        return F.substring_index(after, right, 1) if right else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
