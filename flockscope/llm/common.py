"""Shared helpers: words, boxed rows, tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscope.session import ensure_checkpoint_dir

#: Word separators of every contract: space and TAB .. CR. The same six
#: characters that ``bytes.split()`` splits at, so Python tasks use that.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none.

    Every separator becomes a space first: splitting at one fixed character is
    much cheaper than at a pattern.
    """
    body = F.coalesce(text, F.lit(""))
    for b in BLANKS[1:]:
        body = F.replace(body, F.lit(b), F.lit(" "))
    return F.array_remove(F.split(body, " ", -1), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A column used inside a higher-order function's lambda may be inlined there
    by the optimiser and then be evaluated for every element; a lambda variable
    is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def boxed(df: DataFrame) -> DataFrame:
    """The whole input row as one struct ``_row``.

    Operators add their own columns beside it, so input columns of any name
    never clash with them; ``select("_row.*")`` gives the input back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def write_shared(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` below the session's checkpoint folder, reread it.

    Computed once, columnar, readable by every executor and after the loss of
    any of them. The folder is the one ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, keep: tuple[str, ...], text_col: str, results: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and, last, the text as ``__text``, for a scan that adds ``results``.

    A kept column named like a result column (in any case) is called ``kept_<name>``, as often as needed.
    """
    taken, columns = {r.lower() for r in (*results, "__text")}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name = f"kept_{name}"
        taken.add(name.lower())
        columns.append(F.col(f"`{c}`").alias(name))
    return docs.select(*columns, F.col(f"`{text_col}`").cast("string").alias("__text"))


def kept_schema(slim: DataFrame, results: str) -> str:
    """Schema of a scan over ``with_text`` rows: the kept columns, then ``results``."""
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]], results])
