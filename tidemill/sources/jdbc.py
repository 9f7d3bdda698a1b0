"""Tables in a database: reads in parallel parts of about equal size, writes staged and swapped in one transaction.

A read first asks the database for counts per range of a whole-number key, BUCKETS of them, and cuts the key where the counts
fill a part, so that a crowded range does not become one task. A write goes to a table beside the target, by all tasks, and only then, in one
transaction, takes its name; a write that dies leaves the target as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 1000
#: How a database renames a table, by the name in its URL.
RENAME = {"derby": "rename table {0} to {1}"}
_RENAME = "alter table {0} rename to {1}"


def _options(properties: dict[str, str] | None) -> dict[str, str]:
    return {"preferTimestampNTZ": "true"} | (properties or {})


def ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, properties: dict[str, str] | None = None) -> list[str]:
    """Conditions that cut a table into parts of at most about a `parts`-th of its rows (or one key); rows without a key are in
    the first. A range that holds more is counted again in finer ones."""
    ask = lambda sql: spark.read.jdbc(url, f"({sql}) q", properties=_options(properties))
    k = f'"{key}"'
    low, high = ask(f'select min({k}) as "a", max({k}) as "b" from {table}').first()
    if low is None:
        return ["1 = 1"]

    def counted(start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, rows) of ranges of the key from start up to end."""
        width = (end - 1 - start) // BUCKETS + 1
        found = ask(f'select "bucket", count(*) as "n" from (select ({k} - {start}) / {width} as "bucket" from {table} where {k} >= {start} and {k} < {end}) x group by "bucket"').collect()
        return [(start + int(r.bucket) * width, start + (int(r.bucket) + 1) * width, r.n) for r in sorted(found, key=lambda r: r.bucket)]

    pieces = counted(int(low), int(high) + 1)
    goal = -(-sum(n for *_, n in pieces) // parts)
    while any(n > goal and end - start > 1 for start, end, n in pieces):  # `parts` ranges at most are asked for again
        pieces = [p for start, end, n in pieces for p in (counted(start, end) if n > goal and end - start > 1 else [(start, end, n)])]
    filled, cuts = 0, []
    for start, _, n in pieces:
        if filled and filled + n > goal:
            cuts.append(start)
            filled = 0
        filled += n
    ends = [None, *cuts, None]
    out = [" and ".join([f"{k} >= {a}"] * (a is not None) + [f"{k} < {b}"] * (b is not None)) or "1 = 1" for a, b in zip(ends, ends[1:], strict=False)]
    return [f"({out[0]}) or {k} is null", *out[1:]]


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A table, in parts by a whole-number key if one is given."""
    if key is None:
        return spark.read.jdbc(url, table, properties=_options(properties))
    return spark.read.jdbc(url, table, predicates=ranges(spark, url, table, key, parts, properties), properties=_options(properties))


def write_table(df: DataFrame, url: str, table: str, parts: int = 8, properties: dict[str, str] | None = None) -> None:
    """Put df in place of the table (or make it), with at most `parts` connections."""
    staged = f"{table}_staged"
    df.coalesce(parts).write.jdbc(url, staged, "overwrite", _options(properties))
    rename = next((sql for name, sql in RENAME.items() if f":{name}:" in url), _RENAME)
    swap(df.sparkSession, url, table, rename.format(staged, table), properties)


def swap(spark: SparkSession, url: str, table: str, rename: str, properties: dict[str, str] | None = None) -> None:
    """Drop the table, if it is there, and rename the staged one, in one transaction."""
    given = spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        given.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        found = connection.getMetaData().getTables(None, None, None, None)
        names = set()
        while found.next():
            names.add(str(found.getString("TABLE_NAME")).lower())
        found.close()
        statement = connection.createStatement()
        if table.lower() in names:
            statement.executeUpdate(f"drop table {table}")
        statement.executeUpdate(rename)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
