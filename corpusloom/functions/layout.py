"""Where rows live: one hash layout that all steps of a job share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Session setting: partitions of token tables, where they should differ from what their
# size asks for.
PARTITIONS = "spark.corpusloom.pagePartitions"
# Bytes of text that one task takes on, and fewer while cores would be idle. Tokens with
# all that is known of them take some 50 times as much memory, and adaptive execution sees
# only the compressed text, before it becomes tokens.
TASK_BYTES, _LEAST_BYTES = 4 << 20, 512 << 10
# What a row counts besides its text.
_ROW_BYTES = 256


def spread(df: DataFrame, *keys: str, sized_by: str | None = None) -> DataFrame:
    """Hash `df` by `keys` once; later windows and groups on them do not shuffle.

    With the text column `sized_by` there are as many partitions as its bytes ask for, so
    that tasks stay as they are while the table grows; one pass adds the bytes up. The
    setting `spark.corpusloom.pagePartitions` names the count instead. Without either the
    session's shuffle partitions hold and adaptive execution coalesces them.
    """
    wanted = df.sparkSession.conf.get(PARTITIONS, None)
    if wanted:
        return df.repartition(int(wanted), *keys)
    return df.repartition(_tasks_for(df, sized_by), *keys) if sized_by else df.repartition(*keys)


def _tasks_for(df: DataFrame, text: str) -> int:
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + _ROW_BYTES
    total = df.agg(F.sum(size)).first()[0] or 0
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-total // _LEAST_BYTES))
    # Not 1: a single partition is no hash layout that a join could share.
    return max(2, few, -(-total // TASK_BYTES))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Catalyst would otherwise copy an expensive expression into every later filter
    and projection that uses it; a generated row is where it stops.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of `value`, which stands in the expression once."""
    return F.transform(F.array(value), use)[0]


def fixed_rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small constant table, held in the plan itself."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v)

    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
