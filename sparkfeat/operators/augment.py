"""Column-shuffled copies: the marginals stay, the links between columns go.

Rows are numbered once, by a hash of their key. A keyed bijection of the numbers 0 .. n - 1 then says for each
column and copy where a cell goes, so that a cell is moved once and none is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import clean, column
from sparkfeat.operators.ranking import bucket_count, bucket_offsets, hash_bucket

SEED = 4590


#: Half rounds of the bijection, and steps that a number may take until it is one of the n.
HALF_ROUNDS = 8
WALK = 64


def _mixed(value: str, key: str) -> str:
    """SQL of one step of a keyed bijection of the grid numbers 0 .. __a * __b - 1 (a Feistel network by remainders).

    A number is a row and a column of the grid; in turn, each is moved by a hash of the other.
    """
    def moved(part: str, by: str, size: str) -> str:
        return f"pmod(s.{part} + pmod(xxhash64(s.{by}, i, {key}), {size}), {size})"
    x, y = moved("x", "y", "__a"), moved("y", "x", "__b")
    return (f"aggregate(sequence(1, {HALF_ROUNDS}), named_struct('x', {value} div __b, 'y', {value} % __b), "
            f"(s, i) -> if(i % 2 = 1, named_struct('x', {x}, 'y', s.y), named_struct('x', s.x, 'y', {y})), s -> s.x * __b + s.y)")


def permuted(df: DataFrame, number: str, size: str, key: str, out: str) -> DataFrame:
    """Adds ``out``, the place of ``number`` in a permutation of 0 .. ``size`` - 1 that the SQL text ``key`` picks.

    The grid of about the square root of ``size`` each way has fewer than that many numbers too many. A number that lands
    on one of these goes on from there, which keeps the map a bijection; hardly any needs more than a step.
    """
    grid = df.withColumn("__a", F.expr(f"greatest(1L, CAST(ceil(sqrt({size})) AS BIGINT))")).withColumn(
        "__b", F.expr(f"CAST(ceil({size} / __a) AS BIGINT)"))
    first = grid.withColumn("__at", F.expr(_mixed(number, key)))
    walked = f"aggregate(sequence(1, {WALK}), __at, (at, step) -> if(at < {size}, at, {_mixed('at', key)}))"
    ended = first.withColumn("__at", F.expr(f"CASE WHEN __at < {size} THEN __at ELSE {walked} END"))
    return ended.withColumn(out, F.expr(f"if(__at < {size}, __at, CAST(raise_error('the walk of a permutation did not end') AS BIGINT))")).drop(
        "__a", "__b", "__at")


def _shuffled(df: DataFrame, cols: Sequence[str], key: str, seed: int, copies: Column,
              group: Column | None = None, carry: Sequence[str] = (),
              buckets: int | None = None) -> DataFrame:
    """Rows (``__class``, ``__copy``, ``__row``, columns...) with each column permuted by itself.

    ``group`` divides the rows into classes that are permuted apart.

    Rows get numbers by a hash of the key: positions inside hash ranges plus the sizes of the ranges before, so
    one class may be the whole table. A cell's new row is that of a permutation of the numbers which the seed, its column
    and its copy pick. Hashes, unlike random numbers, give a retried task or a
    repartitioned table the same answer. ``carry`` columns move together, as one series that keeps its row.
    """
    count = buckets or bucket_count(df)
    classes = [] if group is None else ["__class"]
    place = [*classes, "__copy", "__row"]
    types = {c: df.schema[c].dataType.simpleString() for c in [*cols, *carry]}
    data_types = list(dict.fromkeys(types[c] for c in cols))
    slots = {data_type: f"v{i}" for i, data_type in enumerate(data_types)}
    carried_type = "struct<" + ",".join(f"c{i}:{types[c]}" for i, c in enumerate(carry)) + ">"

    # A cell has one field per data type, so that columns of different types share an array.
    # The wide expressions are SQL text: building them call by call takes seconds.
    def cell(series: int, name: str | None) -> str:
        fields = [f"'series', {series}"]
        for data_type, slot in slots.items():
            here = name is not None and types[name] == data_type
            fields.append(f"'{slot}', " + (_clean_sql(name, data_type) if here
                                           else f"CAST(NULL AS {data_type})"))
        if carry:
            own = "named_struct(" + ", ".join(f"'c{i}', {_quoted(c)}" for i, c in enumerate(carry)) + ")"
            fields.append(f"'carried', CAST({own if name is None else 'NULL'} AS {carried_type})")
        return "named_struct(" + ", ".join(fields) + ")"

    cells = [cell(i, c) for i, c in enumerate(cols)] + ([cell(len(cols), None)] if carry else [])

    classed = df if group is None else df.withColumn("__class", group)
    keyed = classed.withColumn("__id", column(key)).withColumn("__hash", F.xxhash64(F.lit(seed), F.col("__id"))).withColumn(
        "__bucket", hash_bucket(F.col("__hash"), count))
    # The counting pass needs keys only, so the scan below it reads no feature column.
    counts = keyed.groupBy(*classes, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = bucket_offsets(counts, classes, "__bucket", "__n").select(*classes, "__bucket", "__before", "__total")
    within = Window.partitionBy(*classes, "__bucket").orderBy("__hash", "__id")
    # The window leaves the rows partitioned and sorted by this join's keys.
    numbered = keyed.withColumn("__position", F.row_number().over(within)).join(offsets, [*classes, "__bucket"]).withColumn(
        "__number", F.col("__before") + F.col("__position") - 1).drop("__hash", "__bucket", "__before", "__position", "__id")
    repeated = numbered.withColumn("__copy", F.explode(copies))
    cut = repeated.withColumn("__cell", F.expr(f"explode(array({', '.join(cells)}))")).select(
        *classes, "__copy", "__number", "__total", F.col("__cell.series").alias("__series"), "__cell")
    moved = permuted(cut, "__number", "__total", f"{seed}, __series, __copy", "__to")
    stays = F.col("__series") == len(cols)
    rows = moved.withColumn("__row", F.when(stays, F.col("__number")).otherwise(F.col("__to")) + 1).select(*place, "__cell")
    # Every row gets exactly one cell per series. Cells are shuffled as they are and gathered
    # behind the shuffle: one aggregate per column would widen each to a whole row before it.
    gathered = rows.repartition(*place).groupBy(*place).agg(
        F.sort_array(F.collect_list("__cell")).alias("__cells"))
    outputs = [f"__cells[{i}].{slots[types[c]]} AS {_quoted(c)}" for i, c in enumerate(cols)]
    outputs += [f"__cells[{len(cols)}].carried.c{i} AS {_quoted('__carried_' + c)}"
                for i, c in enumerate(carry)]
    return gathered.selectExpr(*place, *outputs)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _clean_sql(name: str, data_type: str) -> str:
    return f"nanvl({_quoted(name)}, NULL)" if data_type in ("double", "float") else _quoted(name)


def shuffle_columns(df: DataFrame, cols: Sequence[str], key: str, seed: int = SEED,
                    copies: int = 1, buckets: int | None = None) -> DataFrame:
    """``copies`` copies of the table with every column of ``cols`` permuted independently.

    ``key`` must identify a row. Output: ``copy`` (from 1), ``row`` (from 1) and the columns.
    """
    shuffled = _shuffled(df, cols, key, seed, F.sequence(F.lit(1), F.lit(copies)), buckets=buckets)
    return shuffled.select(F.col("__copy").alias("copy"), F.col("__row").alias("row"),
                           *[column(c) for c in cols])


def with_shadows(df: DataFrame, cols: Sequence[str], key: str, keep: Sequence[str] = (),
                 seed: int = SEED, prefix: str = "shadow_", buckets: int | None = None, copies: int = 1) -> DataFrame:
    """The table with a permuted copy ``shadow_{col}`` next to each column.

    The real row travels as one more series of the same permutation, so no join by position
    is needed. ``copies`` gives that many independent permutations in one pass, told apart by the
    column ``copy`` (from 1), which a single one does not have.
    """
    kept = list(dict.fromkeys([key, *keep, *cols]))
    shuffled = _shuffled(df, cols, key, seed, F.sequence(F.lit(1), F.lit(copies)), carry=kept, buckets=buckets)
    return shuffled.select(
        *([F.col("__copy").alias("copy")] if copies > 1 else []),
        *[column(f"__carried_{c}").alias(c) for c in kept],
        *[column(c).alias(f"{prefix}{c}") for c in cols])


def augment(df: DataFrame, cols: Sequence[str], label: str, key: str, times: int = 2,
            seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """Append column-shuffled rows: ``times`` copies of positives, ``times // 2`` of negatives.

    Positives are labels above 0 and come back labelled 1, negatives are labels equal to 0;
    rows with any other label stay as they are. New rows have a NULL key.
    """
    y = clean(df, label)
    classed = df.where((y > 0) | (y == 0))
    group = F.when(y > 0, F.lit(1)).otherwise(F.lit(0))
    repeats = F.when(y > 0, F.lit(times)).otherwise(F.lit(times // 2))
    copies = F.when(repeats > 0, F.sequence(F.lit(1), F.greatest(repeats, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    shuffled = _shuffled(classed, cols, key, seed, copies, group, buckets=buckets)
    new_rows = shuffled.select(
        F.lit(None).cast(df.schema[key].dataType).alias(key),
        F.col("__class").cast(df.schema[label].dataType).alias(label),
        *[column(c) for c in cols])
    originals = df.select(column(key), column(label), *[column(c) for c in cols])
    return originals.unionByName(new_rows)
