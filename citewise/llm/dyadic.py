"""Percentiles of very large integer columns from dyadic Count-sketches, which add, subtract and combine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes keep DIGITS + 1 leading bits of a value and its sign, in LEVELS bits; a level of more than WIDTH nodes has ROWS rows of WIDTH counters.
DIGITS, LEVELS, WIDTH, ROWS = 15, 22, 1024, 5
HALF = 2 ** (LEVELS - 1)
PRIME = 2**31 - 1
#: By level and row: multipliers and offsets of the hashes for the counter and the sign.
SEEDS = np.random.default_rng(20260603).integers(1, PRIME, size=(LEVELS, ROWS, 4))
SKETCHED = [level for level in range(LEVELS) if 2 ** (LEVELS - level) > WIDTH]
EXACT = [level for level in range(LEVELS + 1) if level not in SKETCHED]
#: The first cell of each exact level, then of each sketched level's rows.
FIRST = {level: sum(2 ** (LEVELS - x) for x in EXACT if x < level) for level in EXACT}
_after = sum(2 ** (LEVELS - x) for x in EXACT)
FIRST |= {level: _after + i * ROWS * WIDTH for i, level in enumerate(SKETCHED)}
N_CELLS = _after + len(SKETCHED) * ROWS * WIDTH
#: Rows read, and pairs of group and code held, before a worker counts equal ones together, or gives out its sketches.
ROWS_IN, PAIRS_HELD = 200_000, 1_000_000
#: The stated error of a rank, as a share of the rows.
RANK_ERROR = 0.01


def encode(value: Column) -> Column:
    """The code of an integer of any size and sign: order is kept, and values of one code differ by less than 2**-DIGITS of themselves.

    Values of less than 2**(DIGITS + 1) in size have their own code. Null has none.
    """
    v = value.cast("long")
    m = F.when(v >= 0, v).otherwise(F.bitwise_not(v))
    e = F.least(F.floor(F.log2(m.cast("double"))).cast("int"), F.lit(62))
    right = lambda n: F.call_function("shiftright", m, n)
    e = e + F.when(right(e + 1) >= 1, 1).when(right(e) < 1, -1).otherwise(0)
    s = F.greatest(e - DIGITS, F.lit(0))
    code = F.when(m == 0, 0).otherwise(s * 2**DIGITS + right(s).cast("int"))
    return F.when(v >= 0, code + HALF).when(v < 0, HALF - 1 - code).cast("int")


def decode(code: np.ndarray) -> np.ndarray:
    """The middle of the values of each code."""
    below = code < HALF
    size = np.where(below, HALF - 1 - code, code - HALF).astype(np.int64)
    s = np.maximum(size // 2**DIGITS - 1, 0)
    low = (size - s * 2**DIGITS) << s
    middle = low + ((np.int64(1) << s) - 1) / 2
    return np.where(below, -1 - middle, middle)


def sketch(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counters of codes with their numbers of rows: exact for each node of the upper levels, signed and hashed below."""
    cells = np.zeros(N_CELLS, np.int64)
    for level in EXACT:
        nodes = codes >> level
        cells[FIRST[level] : FIRST[level] + 2 ** (LEVELS - level)] = np.bincount(nodes, counts, 2 ** (LEVELS - level)).astype(np.int64)
    for level in SKETCHED:
        nodes = (codes >> level).astype(np.int64)
        for r, (a, b, c, d) in enumerate(SEEDS[level].tolist()):
            at = (nodes * a + b) % PRIME % WIDTH
            sign = 1 - 2 * ((nodes * c + d) % PRIME % 2)
            first = FIRST[level] + r * WIDTH
            cells[first : first + WIDTH] = np.bincount(at, counts * sign, WIDTH).astype(np.int64)
    return cells


def update(df: DataFrame, groups: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Sketches of value per groups: groups, cell, n (nonzero counters only).

    weight: copies of each row, 1 by default; negative ones delete. Null values are left out. Each partition sketches
    its own rows, equal codes of a group counted first, and gives out at most N_CELLS counters a group for every
    PAIRS_HELD pairs of group and code; counters of one cell add up, so a group that owns most rows is no heavier than
    its counters. groups may not be named code, cell or n.
    """
    rows = df.select(*groups, encode(F.col(value)).alias("code"), (F.lit(1) if weight is None else weight).cast("long").alias("n")).where("code is not null")
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "cell int, n long"])

    def counted(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by([*groups, "code"]).aggregate([("n", "sum")]).rename_columns([*groups, "code", "n"])

    def sketches(pairs: pa.Table):
        own = pairs.group_by(groups, use_threads=False).aggregate([("code", "list"), ("n", "list")])
        codes, counts = own["code_list"], own["n_list"]
        for i in range(own.num_rows):
            cells = sketch(np.asarray(codes[i].values), np.asarray(counts[i].values))
            at = np.flatnonzero(cells)
            if len(at):
                here = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([*(own[g].combine_chunks().take(here) for g in groups), pa.array(at, pa.int32()), pa.array(cells[at], pa.int64())], names=[*groups, "cell", "n"])

    def run(batches):
        held: list[pa.Table] = []
        pairs, new = 0, 0
        for batch in batches:
            held.append(pa.Table.from_arrays(batch.columns, names=batch.schema.names))  # columns that allow nulls, as counted ones do
            new += batch.num_rows
            if new >= ROWS_IN:
                held = [counted(held)]
                pairs, new = held[0].num_rows, 0
                if pairs >= PAIRS_HELD:
                    yield from sketches(held[0])
                    held = []
        if held:
            yield from sketches(counted(held))

    return _added(rows.mapInArrow(run, ddl), groups)


def _added(cells: DataFrame, groups: list[str]) -> DataFrame:
    return cells.groupBy(*groups, "cell").agg(F.sum("n").alias("n")).where("n != 0")


def combine(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches added up to groups, as days to the whole; the same as the sketch of all rows at once."""
    return _added(sketches, groups)


def subtract(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of a without the rows of b."""
    return combine(a.select(*groups, "cell", "n").unionByName(b.select(*groups, "cell", (-F.col("n")).alias("n"))), groups)


def estimate(cells: np.ndarray, level: int, node: int) -> int:
    """The number of rows whose code lies in a node: exact, or the median of its rows' signed counters."""
    if level in EXACT:
        return int(cells[FIRST[level] + node])
    got = []
    for r, (a, b, c, d) in enumerate(SEEDS[level].tolist()):
        n = int(cells[FIRST[level] + r * WIDTH + (node * a + b) % PRIME % WIDTH])
        got.append(-n if (node * c + d) % PRIME % 2 else n)
    return sorted(got)[ROWS // 2]


def rank_to_code(cells: np.ndarray, rank: int) -> int:
    """The code at a rank from 1: from the root to the half that holds it, level by level."""
    node, count = 0, int(cells[FIRST[LEVELS]])
    for level in range(LEVELS - 1, -1, -1):
        left = min(max(estimate(cells, level, 2 * node), 0), count)
        if rank <= left:
            node, count = 2 * node, left
        else:
            node, count, rank = 2 * node + 1, count - left, rank - left
    return node


def names_of(probs: tuple[float, ...]) -> list[str]:
    return [f"p{p * 100:g}".replace(".", "_") for p in probs]


def quantiles(sketches: DataFrame, groups: list[str], probs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """groups, n and p50, p90, ... of each sketch; p is the value at rank ceil(prob * n).

    Error: at each of the len(SKETCHED) lower levels a count is off by about sqrt(F2 / WIDTH), F2 being the sum of the
    squared counts of that level's nodes but the few heaviest, which the median of ROWS rows takes out; altogether the
    rank is within RANK_ERROR of the one asked for (rank_errors measures it), and codes hold the value within
    2**-(DIGITS + 1) of itself. A group arrives as its counters, at most N_CELLS rows.
    """
    names = names_of(probs)
    kinds = dict(sketches.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "n long", *(f"{x} double" for x in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(N_CELLS, np.int64)
        cells[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        n = int(cells[FIRST[LEVELS]])
        if n <= 0:
            return pd.DataFrame(columns=[*groups, "n", *names])
        codes = np.array([rank_to_code(cells, max(1, int(np.ceil(p * n - 1e-9)))) for p in probs])
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in groups), n, *decode(codes).tolist()]], columns=[*groups, "n", *names])

    return sketches.groupBy(*groups).applyInPandas(run, schema)


def rank_errors(df: DataFrame, groups: list[str], value: str, found: DataFrame, probs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """groups, prob, n, rank_error: how far the ranks of found's values in the rows themselves are from those asked for, as a share of n.

    found: quantiles() of the groups. A value stands for all values of its code, so it counts as right from the share of
    rows below them to the share up to them. One more counted scan; found is a row a group, and joins without its rows
    being gathered: rows are counted before the shuffle.
    """
    names = names_of(probs)
    slack = lambda q: F.abs(F.col(q)) * 2.0**-DIGITS
    met = df.where(F.col(value).isNotNull()).select(*groups, value).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    own = found.select(*(F.col(g).alias(f"__{i}") for i, g in enumerate(groups)), *names)
    match = [F.col(g).eqNullSafe(F.col(f"__{i}")) for i, g in enumerate(groups)]
    met = met.join(own, match)
    sums = [f for q in names for f in (F.sum(F.when(F.col(value) < F.col(q) - slack(q), F.col("__n")).otherwise(0)).alias(f"{q}_below"), F.sum(F.when(F.col(value) <= F.col(q) + slack(q), F.col("__n")).otherwise(0)).alias(f"{q}_upto"))]
    wide = met.groupBy(*groups).agg(F.sum("__n").alias("n"), *sums)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("prob"), F.greatest(F.lit(0.0), F.col(f"{q}_below") / F.col("n") - p, p - F.col(f"{q}_upto") / F.col("n")).alias("rank_error")) for p, q in zip(probs, names, strict=True)))).alias("x")
    return wide.select(*groups, "n", each).select(*groups, "x.prob", "n", "x.rank_error")
