"""Group aggregates with flat names, and aggregates beside the rows of their groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.aggregates import Function, aggregate, label
from ..functions.nulls import all_present, name, names, unused, without_nan
from .joins import estimated_bytes

#: Nodes of an optimized plan whose rows depend on nothing but their input's rows.
REPEATABLE = {"LogicalRelation", "LocalRelation", "Range", "OneRowRelation", "Project", "Filter", "Union", "Join", "Generate", "Repartition", "RepartitionByExpression", "Sort"}
#: Bytes of groups a shuffle partition, as Spark's planner estimates them (an upper bound, of compressed files), up to which they are hashed in memory.
HASHED_BYTES = 16 << 20


def aggregate_flat(df: DataFrame, keys: str | Sequence[str], agg: Mapping[str, Function | Sequence[Function]], order_by: Sequence[str] = ()) -> DataFrame:
    """One row a group, with columns <column>_<function>, or <column> where a single function is given without a list. Groups with a null key are left out."""
    keys = names(keys)
    out = []
    for column, functions in agg.items():
        if isinstance(functions, (list, tuple)):
            out += [aggregate(column, f, order_by).alias(f"{column}_{label(f)}") for f in functions]
        else:
            out.append(aggregate(column, functions, order_by).alias(column))
    rows = without_nan(df, [*keys, *agg]).where(all_present(keys))
    return rows.groupBy(*[name(k) for k in keys]).agg(*out)


def flatten_names(df: DataFrame, splitter: str = "_") -> DataFrame:
    """df with the fields of its struct columns as columns of their own, <column>_<field>, or <column> for a field without a name (""). Other columns stay; a null struct gives nulls."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [name(f.name)[g.name].alias(f"{f.name}{splitter}{g.name}" if g.name else f.name) for g in f.dataType.fields]
        else:
            out.append(name(f.name))
    return df.select(*out)


def aggregate_by_index_and_keys(df: DataFrame, index: str | Sequence[str], keys: Sequence[str], agg: Mapping[str, Function | Sequence[Function]], order_by: Sequence[str] = ()) -> DataFrame:
    return aggregate_flat(df, [*names(index), *keys], agg, order_by)


def aggregate_as_column(df: DataFrame, keys: str | Sequence[str], column: str, function: Function, output: str, null_keys: str = "null", order_by: Sequence[str] = ()) -> DataFrame:
    """df with the group's aggregate in each row: one shuffle, no join, but for nunique (see _nunique_beside). null_keys: rows with a null key get null ("null") or are left out ("drop")."""
    keys = names(keys)
    rows = without_nan(df, [*keys, column])
    if function == "nunique" and null_keys in ("null", "drop") and keys and reads_alike(rows):
        return _nunique_beside(rows.where(all_present(keys)) if null_keys == "drop" else rows, keys, column, output)
    value = aggregate(column, function, order_by, Window.partitionBy(*[name(k) for k in keys]))
    if null_keys == "drop":
        return rows.where(all_present(keys)).withColumn(output, value)
    if null_keys != "null":
        raise ValueError("null_keys is 'null' or 'drop'")
    return rows.withColumn(output, F.when(all_present(keys), value))


def reads_alike(df: DataFrame) -> bool:
    """Whether df's plan shows that df gives the same rows each time it is read: files, ranges and local rows behind nothing that chooses rows or values by their order or at random."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic() or plan.containsPattern(df.sparkSession._jvm.org.apache.spark.sql.catalyst.trees.TreePattern.PLAN_EXPRESSION()):
        return False
    rest = [plan]
    while rest:
        node = rest.pop()
        kind = node.getClass().getSimpleName()
        if kind not in REPEATABLE or kind == "LogicalRelation" and node.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return False
        rest += [node.children().apply(k) for k in range(node.children().size())]
    return True


def _nunique_beside(rows: DataFrame, keys: Sequence[str], column: str, output: str) -> DataFrame:
    """Distinct values are counted a group and joined to the rows, which are read twice. A window would sort a task's rows twice and hold both orders; here the rows pass by a hash table of the groups.
    That can't spill, so it's asked for only where it stays small even if each row is a group; else Spark decides."""
    n, own = unused(rows, f"{output}_"), [unused(rows, f"{output}_{k}") for k in range(len(keys))]
    groups = rows.where(all_present(keys)).groupBy(*[name(k).alias(o) for k, o in zip(keys, own)]).agg(aggregate(column, "nunique").alias(n))
    if estimated_bytes(groups) <= HASHED_BYTES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        groups = groups.hint("shuffle_hash")
    on = reduce(lambda a, b: a & b, [name(k) == name(o) for k, o in zip(keys, own)])
    return rows.join(groups, on, "left").withColumn(output, name(n)).drop(n, *own)


def aggregate_as_column_by_index_and_keys(df: DataFrame, index: str | Sequence[str], keys: Sequence[str], column: str, function: Function, output: str, order_by: Sequence[str] = ()) -> DataFrame:
    return aggregate_as_column(df, [*names(index), *keys], column, function, output, order_by=order_by)
