"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within a radius share a value that lies within half the radius of both: every
fingerprint emits its ball of half the radius, the variants are shuffled, and fingerprints that
meet in one are compared in full.

A ball of radius 2 over 64 bits has 2,081 variants. Cut into ``parts = 2`` halves, one half of
two fingerprints within 4 bits differs in at most 2, so balls of radius 1 over the halves, 66
variants in all, lose no pair either; what they let through too much is settled by the full
comparison. ``parts=1`` is the undivided form, with the same result.

Equal fingerprints are one row from the start, so copies of a text cost nothing here, and all
comparing is among different fingerprints. A variant that two fingerprints share is compared in
place; those of more are compared in blocks of bounded size, each pair of blocks a group of its
own. A group returns the links that hold its members together, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.components import components
from textweave.llm.tables import one_of_each
from textweave.llm.words import array_pieces, pieces, unused
from textweave.session import materialise

BITS = 64
#: Members of a block where a variant has more of them than two.
BLOCK = 2_048
#: Variants that a task emits, about.
EMITTED = 1 << 20
#: Parts that the members of a component are dealt to when they look up its smallest id.
SALTS = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: bytes, length: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text: the majority bits of the XXH64 of its word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = max(1, len(words) - length + 1)
    firsts = starts[:n].tolist()
    lasts = (starts[-n:] + sizes[-n:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(firsts, lasts, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 255):  # sums of up to 255 bits fit in a byte
        bits = np.unpackbits(hashes[start : start + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 4) -> DataFrame:
    """``(id, fingerprint)``, the fingerprint as a signed bigint; null texts have no words."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                prints = [simhash(text or b"", length) for text in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(prints, pa.int64())], ["id", "fingerprint"])

    given = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return given.mapInArrow(marked, "id bigint, fingerprint bigint")


def ball(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` ones, as signed 64-bit values."""
    found = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in found]


def variants(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """``(variant, fingerprint)``: the balls around the parts of each fingerprint.

    A variant carries the number of its part in the bits above.
    """
    width = BITS // parts
    share = radius // parts
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball(width, (share + 1) // 2)])
    fingerprint = F.col("fingerprint")

    def value(part: int) -> Column:
        if parts == 1:
            return fingerprint
        cut = F.shiftrightunsigned(fingerprint, part * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        return cut.bitwiseOR(F.lit(part << width).cast("bigint"))

    cut = prints.select("fingerprint", F.explode(F.array(*[value(p) for p in range(parts)])).alias("part"))
    flipped = cut.select("fingerprint", "part", F.explode(masks).alias("mask"))
    return flipped.select("fingerprint", F.col("part").bitwiseXOR(F.col("mask")).alias("variant"))


def held_together(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within ``radius`` that leave linked what all such links would link."""
    left = np.arange(len(members))
    a, b = [], []
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = np.bitwise_count(members[left] ^ members[at]) <= radius
            found = left[near]
            left = left[~near]
            a.append(np.full(len(found), at))
            b.append(found)
            waiting += found.tolist()
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return members[np.concatenate(a)], members[np.concatenate(b)]


def links(prints: DataFrame, radius: int = 4, parts: int = 2) -> DataFrame:
    """Links ``(a, b)`` of different fingerprints within ``radius`` bits; enough to join all that are tied.

    ``prints`` has one row for each fingerprint and is read twice.
    """
    # A task emits and pre-aggregates a bounded number of variants, however small the table of fingerprints is.
    emits = parts * len(ball(BITS // parts, (radius // parts + 1) // 2))
    tasks = max(1, -(-prints.count() * emits // EMITTED))
    emitted = variants(prints.repartition(tasks, "fingerprint"), radius, parts)
    meeting = (
        emitted.groupBy("variant")
        .agg(F.count("*").alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
        .filter("n > 1")
    )
    meeting = materialise(meeting, "variants")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    twos = meeting.filter(F.col("n") == 2).filter(near).select("a", "b")
    many = meeting.filter("n > 2").select("variant", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    blocks = (
        emitted.join(many.hint("merge"), "variant")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter("blocks = 1 or own <> other")
        .select("variant", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
        .groupBy("variant", "i", "j")
        .agg(F.collect_list("fingerprint").alias("members"))  # at most two blocks
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held_together(m.values.to_numpy().view(np.uint64), radius) for m in batch.column(0)]
            ends = [np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])

    rest = blocks.select("members").mapInArrow(joined, "a bigint, b bigint")
    return twos.union(rest)


def near_duplicates(docs: DataFrame, radius: int = 4, parts: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, fingerprint, component_id, kept)`` of every row.

    Words are lower-cased for A to Z only; shingles are 4 words, or the whole text where it has
    fewer. A text without words, null too, has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits, null if all
    have null ids; ``kept`` marks that row. Rows given twice have one fingerprint and are one group.
    An empty table gives an empty result; other columns are not read.
    """
    marked = materialise(fingerprints(docs, id_column, text_column), "fingerprints")
    return _grouped(marked, radius, parts).select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _grouped(marked: DataFrame, radius: int, parts: int) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row of ``(id, fingerprint)``."""
    prints = marked.groupBy("fingerprint").agg(F.min("id").alias("first"))
    prints = materialise(prints, "distinct-fingerprints")
    tied = materialise(components(links(prints.select("fingerprint"), radius, parts)), "components")
    members = tied.withColumnRenamed("node", "fingerprint").hint("merge").join(prints, "fingerprint")
    # A component may hold a third of all fingerprints: its members come in parts, its smallest id in copies.
    salt = F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).cast("int").alias("salt")
    firsts = members.groupBy("component", salt).agg(F.min("first").alias("first")).groupBy("component").agg(F.min("first").alias("least"))
    firsts = firsts.select("component", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = members.select("fingerprint", "component", salt).hint("merge").join(firsts, ["component", "salt"]).select("fingerprint", "least")
    own = prints.join(named.hint("merge"), "fingerprint", "left")
    own = own.select("fingerprint", F.coalesce("least", "first").alias("component_id"))
    return marked.join(own.hint("merge"), "fingerprint").select("id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, parts: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns as they are; one row of rows given twice.

    A row is told by its id and its fingerprint, so one id may have several texts; near copies of
    one text under the smallest id of their group, or all under null ids, stay together.
    """
    mark = unused(docs, "fingerprint")

    def marked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([simhash(text or b"") for piece in array_pieces(part) for text in piece.to_pylist()], pa.int64())

    simhashed = F.arrow_udf(marked, "bigint")
    docs_marked = materialise(docs.withColumn(mark, simhashed(F.col(text_column).cast("binary"))), "marked")
    rows = docs_marked.select(F.col(id_column).cast("bigint").alias("id"), F.col(mark).alias("fingerprint"))
    verdicts = _grouped(rows, radius, parts).select(
        F.col("id").alias(id_column), F.col("fingerprint").alias(mark), F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return one_of_each(docs_marked, [id_column, mark], verdicts).select(*docs.columns)
