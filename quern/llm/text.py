"""What the operators of this package share: words, fresh column names and reading of byte texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import prepared

#: White space of every contract: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` doesn't have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; made on the driver, since workers have no session to parse it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, ddl: str, make, rows: int = 256) -> DataFrame:
    """``make(one list for each column) -> one list for each column of ddl``, over slices of Arrow batches."""
    kinds = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = make(*[c.to_pylist() for c in batch.slice(start, rows).columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    prepared(df.sparkSession)
    return df.mapInArrow(run, ddl)
