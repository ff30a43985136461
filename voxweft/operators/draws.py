"""The draws of one seeded generator of the standard library, made in parallel.

``random.Random(seed).randrange(n)``, called again and again, takes the upper bits of one 32-bit word after another and
passes over those that are n or more. The generator is linear over bits, so the state after any number of words is the
sum of the states whose places are the exponents of a power of x, taken modulo the generator's polynomial. Every block of
words is therefore made by a task of its own from a state it computes itself; a first pass counts the words that blocks
accept, which gives each block the number of its first draw.

Draws reach the rows they name in runs of ``WIDTH`` neighbouring rows and lots of ``LOT`` replicates, so a task holds one
run's values and one lot's draws of them, whatever the number of rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..saved import saved

#: Words of a block, words handled at once, rows of a run, replicates of a lot.
BLOCK, CHUNK, WIDTH, LOT = 1 << 22, 1 << 19, 1 << 16, 64
#: The generator's words of state, and the degree of its polynomial.
STATE, DEGREE = 624, 19937


def first_state(seed: int) -> np.ndarray:
    return np.array(random.Random(seed).getstate()[1][:STATE], np.uint32)


def generator(state: np.ndarray) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": STATE}}
    return out


def state_words(state: np.ndarray, count: int) -> np.ndarray:
    """The state's words and those that follow, as they are before they are mixed for output."""
    g, out = generator(state), [state]
    for _ in range(-(-count // STATE)):
        g.random_raw(STATE, output=False)
        out.append(g.state["state"]["key"].copy())
    return np.concatenate(out)[: STATE + count]


@cache
def polynomial() -> int:
    """The polynomial of the generator's recurrence, bit i for the power i, found from a run of its lowest bits as the
    shortest recurrence they follow."""
    bits = state_words(first_state(1), 2 * DEGREE + STATE)[STATE:] & 1
    now, then, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits.tolist()):
        seen = seen << 1 | bit
        if not (now & seen).bit_count() & 1:
            since += 1
        elif 2 * length <= n:
            now, then, length, since = now ^ then << since, now, n + 1 - length, 1
        else:
            now, since = now ^ then << since, since + 1
    return int(format(now, "b").zfill(length + 1)[::-1], 2)


def jumps(block: int, blocks: int) -> list[int]:
    """Powers of x modulo the polynomial with exponents ``block``, twice that and so on, as many as numbers of
    ``blocks`` have bits; ``block`` is a power of two."""
    rungs = (blocks - 1).bit_length()
    if not rungs:
        return []
    modulus, power, out = polynomial(), 2, []
    for step in range(block.bit_length() - 1 + rungs):
        if 1 << step >= block:
            out.append(power)
        power = int("0".join(format(power, "b")), 2)
        while (over := power.bit_length() - modulus.bit_length()) >= 0:
            power ^= modulus << over
    return out


def jumped(state: np.ndarray, number: int, powers: Sequence[int]) -> np.ndarray:
    """The state after ``number`` blocks."""
    for rung, power in enumerate(powers):
        if number >> rung & 1:
            words = state_words(state, DEGREE)
            state = np.zeros(STATE, np.uint32)
            for at, bit in enumerate(reversed(format(power, "b"))):
                if bit == "1":
                    state ^= words[at : at + STATE]
    return state


def accepted(state: np.ndarray, block: int, n: int) -> Iterator[np.ndarray]:
    """The draws below n that a block's words give, in order. Over 32 bits a draw takes two words, the lower bits first."""
    g, bits = generator(state), n.bit_length()
    for at in range(0, block, CHUNK):
        raw = g.random_raw(min(CHUNK, block - at))
        value = raw >> (32 - bits) if bits <= 32 else raw[::2] | raw[1::2] >> (64 - bits) << 32
        yield value[value < n].astype(np.int64)


def draws(spark: SparkSession, n: int, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(part, lot, rep, at): the rows that replicates draw among n, ``at`` the places in run ``part`` as 16-bit integers,
    those of equal part and rep in several rows. Equal to n calls of ``randrange(n)`` for each replicate in turn."""
    total = n * replicates
    if block & (block - 1) or block < 2:
        raise ValueError("a block is a power of two")
    if total <= 0:
        return spark.createDataFrame([], "part long, lot int, rep int, at binary")
    first, per = first_state(seed), 1 if n.bit_length() <= 32 else 2
    share = n / (1 << n.bit_length())
    want = total / share + 8 * math.sqrt(total * (1 - share)) / share
    blocks = int(want * per) // block + 1
    before = [0]
    while before[-1] < total:
        powers, have = jumps(block, blocks), len(before) - 1

        def count(batches: Iterator[pa.RecordBatch], powers=powers) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    found = sum(len(v) for v in accepted(jumped(first, b, powers), block, n))
                    yield pa.RecordBatch.from_pydict({"block": [b], "found": [found]})

        counts = spark.range(have, blocks, numPartitions=blocks - have).mapInArrow(count, "block long, found long").collect()
        for row in sorted(counts):
            before.append(before[-1] + row["found"])
        blocks += max(1, blocks // 8)
    used = next(i for i, done in enumerate(before) if done >= total)
    starts = np.array(before[:used])
    schema = pa.schema([("part", pa.int64()), ("lot", pa.int32()), ("rep", pa.int32()), ("at", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                number = int(starts[b])
                for value in accepted(jumped(first, b, powers), block, n):
                    value = value[: max(0, total - number)]
                    rep, part = (number + np.arange(len(value))) // n, value // WIDTH
                    number += len(value)
                    order = np.lexsort((part, rep))
                    value, rep, part = value[order], rep[order], part[order]
                    cut = np.flatnonzero((np.diff(rep, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                    if not len(cut):
                        continue
                    places = (value % WIDTH).astype("<u2")
                    at = [places[a:z].tobytes() for a, z in zip(cut, [*cut[1:], len(value)], strict=True)]
                    columns = [part[cut], (rep[cut] // LOT).astype(np.int32), rep[cut].astype(np.int32), at]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spark.range(0, used, numPartitions=used).mapInArrow(make, "part long, lot int, rep int, at binary")


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``place``, their number from 0 in the order of some columns. Ranges of neighbouring rows are written
    once, each counts its own, and one count for each range is summed."""
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    ranged = ranged.withColumns({"_range": F.shiftright("_m", 33), "_in": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("c"))
    sizes = sizes.select("_range", (F.sum("c").over(Window.orderBy("_range")) - F.col("c")).alias("_before"))
    return ranged.join(F.broadcast(sizes), "_range").withColumn("place", F.col("_before") + F.col("_in")).drop("_m", "_range", "_in", "_before")


def drawn_means(df: DataFrame, order: Sequence[str], values: Sequence[str], replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(rep, one mean for each of ``values``): means over the rows that a sequential program would draw from the rows in
    this order. Sums are exact within runs. Null values, as empty tables, give no mean: a table without rows gives no
    rows, a null makes the means of the replicates that draw it null. Rows that are equal in ``order`` should be equal
    in ``values``, or ``order`` should name these too."""
    rows = numbered(df.select(*{c: None for c in [*order, *values]}), order)
    n = rows.count()
    lots = -(-replicates // LOT)
    kinds = ", ".join(f"v{i} binary" for i in range(len(values)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        vectors = [table.column(f"v{i}").to_numpy().astype("<f8").tobytes() for i in range(len(values))]
        return pa.table({"part": table.column("part")[:1], **{f"v{i}": pa.array([v], pa.binary()) for i, v in enumerate(vectors)}})

    runs = rows.select(F.floor(F.col("place") / WIDTH).alias("part"), "place", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)])
    runs = runs.groupBy("part").applyInArrow(pack, f"part long, {kinds}").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(max(0, lots - 1)))))

    def gather(run: pa.Table, drawn: pa.Table) -> pa.Table:
        if not drawn.num_rows:
            return pa.table({"rep": pa.array([], pa.int32()), **{f"s{i}": pa.array([], pa.float64()) for i in range(len(values))}})
        vectors = [np.frombuffer(run.column(f"v{i}")[0].as_py(), "<f8") for i in range(len(values))]
        at: dict[int, list[np.ndarray]] = {}
        for rep, places in zip(drawn.column("rep").to_pylist(), drawn.column("at").to_pylist(), strict=True):
            at.setdefault(rep, []).append(np.frombuffer(places, "<u2"))
        taken = {rep: np.concatenate(places) for rep, places in at.items()}
        sums = {f"s{i}": pa.array([math.fsum(v[p]) for p in taken.values()], pa.float64()) for i, v in enumerate(vectors)}
        return pa.table({"rep": pa.array(list(taken), pa.int32()), **sums})

    drawn = draws(df.sparkSession, n, replicates, seed, block)
    sums = runs.groupBy("part", "lot").cogroup(drawn.groupBy("part", "lot")).applyInArrow(gather, "rep int, " + ", ".join(f"s{i} double" for i in range(len(values))))
    means = [(F.sum(f"s{i}") / n).alias(c) if n else F.sum(f"s{i}").alias(c) for i, c in enumerate(values)]
    out = sums.groupBy("rep").agg(*means)
    return out.select("rep", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in values])
