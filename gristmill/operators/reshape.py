"""Lists, maps and columns stacked to rows, and rows unstacked to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import name, names, unused, without_nan
from ..functions.schema import data_type


def stack_list_column(df: DataFrame, column: str, output_type, keep: Sequence[str] = (), index: str | Sequence[str] = ()) -> DataFrame:
    """A row for each element; null and empty lists give none."""
    held = [name(c) for c in [*names(index), *keep]]
    return df.select(*held, F.explode(name(column)).alias(column)).withColumn(column, name(column).cast(data_type(output_type)))


def stack_list_columns(df: DataFrame, columns: Sequence[str], output_types: Sequence, keep: Sequence[str] = (), index: str | Sequence[str] = ()) -> DataFrame:
    """The lists side by side, element by element; shorter ones are filled up with null."""
    held = [*names(index), *keep]
    lists = [F.coalesce(name(c), F.array().cast(df.schema[c].dataType)).alias(f"c{k}") for k, c in enumerate(columns)]
    rows = df.select(*[name(c).alias(f"h{k}") for k, c in enumerate(held)], *lists)
    zipped = rows.select(*[f"h{k}" for k in range(len(held))], F.inline(F.arrays_zip(*[F.col(f"c{k}") for k in range(len(columns))])))
    cast = [F.col(f"c{k}").cast(data_type(t)) for k, t in enumerate(output_types)]
    return zipped.select(*[f"h{k}" for k in range(len(held))], *cast).toDF(*held, *columns)


def stack_dict_column(df: DataFrame, column: str, label_type, value_type, keep: Sequence[str] = (), index: str | Sequence[str] = (), label_suffix: str = "_label", value_suffix: str = "_value") -> DataFrame:
    """A row for each entry of a map: the kept columns, the value, then the label. Null values stay; null and empty maps give no row."""
    held = [name(c) for c in [*names(index), *keep]]
    label, value = unused(df, "label"), unused(df, "value")
    rows = df.select(*held, F.explode(name(column)).alias(label, value))
    return rows.select(*held, F.col(value).cast(data_type(value_type)).alias(column + value_suffix), F.col(label).cast(data_type(label_type)).alias(column + label_suffix))


def stack_columns(df: DataFrame, targets: Sequence[str], keep: Sequence[str] = (), index: str | Sequence[str] = (), label_name: str = "stack_label", output_name: str = "stacked", label_type="object", output_type="object") -> DataFrame:
    """Wide to long: a row for each target that isn't missing. Targets of one type keep it unless output_type says otherwise; mixed numbers widen; anything else becomes text."""
    held = [*names(index), *keep]
    kinds = dict(df.dtypes)
    own = {kinds[c] for c in targets}
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    if output_type not in ("object", object):
        kind = data_type(output_type).simpleString()
    else:
        kind = own.pop() if len(own) == 1 else ("double" if own & {"float", "double"} else "bigint") if own <= numbers else "string"
    rows = without_nan(df, targets).select(*[name(c) for c in held], *[name(c).cast(kind).alias(c) for c in targets])
    long = rows.unpivot([name(c) for c in held], [name(c) for c in targets], label_name, output_name).where(name(output_name).isNotNull())
    return long.withColumn(label_name, name(label_name).cast(data_type(label_type)))


def unstack_column(df: DataFrame, unstack: Sequence[str], on: Sequence[str], value: str, splitter: str = "_", suffix: str | None = None, pivot_values: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """Long to wide: a row for each value of on, a column for each observed combination of unstack, named by its values and the suffix (default: the
    value column's name). Runs one job for the combinations unless pivot_values names them, and one for the check, which raises
    ValueError if two rows share on and unstack. More combinations than spark.sql.pivotMaxValues are a ValueError, too, before they reach the driver."""
    key = F.concat_ws(splitter, *[F.coalesce(name(c).cast("string"), F.lit("null")) for c in unstack])
    label = F.concat(key, F.lit(value if suffix is None else suffix))
    if check and df.groupBy(*[name(c) for c in [*on, *unstack]]).count().where("count > 1").limit(1).count():
        raise ValueError("two rows share their values of on and unstack")
    if pivot_values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        seen = df.select(*[name(c).alias(f"c{k}") for k, c in enumerate(unstack)], label.alias("label")).distinct().orderBy(*[f"c{k}" for k in range(len(unstack))])
        pivot_values = [r["label"] for r in seen.limit(most + 1).collect()]
        if len(pivot_values) > most:
            raise ValueError(f"more than {most} combinations to unstack")
    held, shown = unused(df, "label"), unused(df, "value")
    rows = df.select(*[name(c) for c in on], label.alias(held), name(value).alias(shown))
    return rows.groupBy(*[name(c) for c in on]).pivot(held, list(pivot_values)).agg(F.first(shown, ignorenulls=True))
