"""A SQL client on the session's catalog: any SQL, table and column listings, saving, updating, copying, dropping."""

from __future__ import annotations

import re
import uuid
import weakref
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types by family, as a client would ask for them.
TYPE_INFO = {"double": "double", "integer": "int", "character": "string", "logical": "boolean", "bigint": "bigint", "date": "date", "timestamp": "timestamp", "binary": "binary", "decimal": "decimal(18,4)"}


#: Table property that names the declared key.
KEY_PROPERTY = "rowloom.key"


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get .1, .2, ... as suffixes."""
    seen, out = set(), []
    for n in names:
        new, k = n, 0
        while new in seen:
            k += 1
            new = f"{n}.{k}"
        seen.add(new)
        out.append(new)
    return out


class Channel:
    """A handle on a session; ``case`` folds the names it is given ('nochange', 'lower', 'upper')."""

    _open: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, spark: SparkSession, case: str = "nochange", database: str | None = None):
        if case not in ("nochange", "lower", "upper"):
            raise ValueError("case must be nochange, lower or upper")
        self.spark, self.case, self.closed, self.error = spark, case, False, None
        self.types, self._rows = dict(TYPE_INFO), None
        Channel._open.add(self)
        if database:
            spark.catalog.setCurrentDatabase(database)

    # -- life --------------------------------------------------------------------------------------------------------

    def close(self) -> None:
        self.closed, self._rows = True, None

    @classmethod
    def close_all(cls) -> int:
        """Close every channel that is open; how many there were."""
        every = [c for c in cls._open if not c.closed]
        for c in every:
            c.close()
        return len(every)

    def reconnect(self) -> Channel:
        self.closed, self.error = False, None
        return self

    def info(self) -> dict[str, str]:
        return {"dbms": "Spark SQL", "version": self.spark.version, "database": self.spark.catalog.currentDatabase()}

    def sources(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def last_error(self) -> str | None:
        return self.error

    def clear_error(self) -> None:
        self.error = None

    def set_auto_commit(self, on: bool) -> None:
        if not on:
            raise NotImplementedError("every statement commits by itself")

    def end_transaction(self, commit: bool = True) -> None:
        raise NotImplementedError("every statement commits by itself")

    # -- names -------------------------------------------------------------------------------------------------------

    def name(self, table: str) -> str:
        parts = table.split(".")
        if len(parts) > 2 or not all(parts):
            raise ValueError("names have at most one dot")
        fold = {"nochange": str, "lower": str.lower, "upper": str.upper}[self.case]
        return ".".join("`" + fold(p).replace("`", "``") + "`" for p in parts)

    def table_exists(self, table: str, abort: bool = False) -> bool:
        there = self.spark.catalog.tableExists(self.name(table))
        if abort and not there:
            raise LookupError(f"no table {table}")
        return there

    # -- queries -----------------------------------------------------------------------------------------------------

    def query(self, sql: str, args: dict | list | None = None, max_rows: int | None = None, na_strings: list[str] = ()) -> DataFrame:
        """Any SQL. Parameters are bound, not pasted; ``na_strings`` become null; repeated names are made unique."""
        if self.closed:
            raise ConnectionError("the channel is closed")
        try:
            df = self.spark.sql(sql, args=args) if args is not None else self.spark.sql(sql)
        except Exception as e:
            self.error = str(e)
            raise
        if len(set(df.columns)) < len(df.columns):
            df = df.toDF(*unique_names(df.columns))
        for c, kind in df.dtypes if na_strings else []:
            if kind == "string":
                df = df.withColumn(c, F.when(~F.col(f"`{c}`").isin(*na_strings), F.col(f"`{c}`")))
        return df.limit(max_rows) if max_rows else df

    def fetch(self, table: str, max_rows: int | None = None) -> DataFrame:
        self.table_exists(table, abort=True)
        df = self.spark.table(self.name(table))
        return df.limit(max_rows) if max_rows else df

    def start_fetch(self, table: str, max_rows: int = 1000, row_names: str | None = None):
        """The first rows as a pandas frame, with the column ``row_names`` as its index; ``fetch_more`` goes on there.

        Rows come partition by partition: the driver holds one partition and one page.
        """
        df = self.fetch(table)
        if row_names is not None and row_names not in df.columns:
            raise LookupError(f"no column {row_names}")
        self._rows = (df.toLocalIterator(), df.columns, row_names)
        return self.fetch_more(max_rows)

    def fetch_more(self, max_rows: int = 1000):
        """The next rows of the last ``start_fetch``; empty after the last one."""
        import pandas as pd

        if self._rows is None:
            raise LookupError("nothing is being fetched")
        rows, columns, row_names = self._rows
        page = pd.DataFrame([tuple(r) for r in islice(rows, max_rows)], columns=columns)
        return page.set_index(row_names) if row_names is not None else page

    def pages(self, df: DataFrame, size: int = 1000):
        """Rows on the driver, ``size`` at a time; one partition is held at once."""
        page = []
        for row in df.toLocalIterator():
            page.append(row)
            if len(page) == size:
                yield page
                page = []
        if page:
            yield page

    # -- writing -----------------------------------------------------------------------------------------------------

    def _replace(self, df: DataFrame, table: str) -> None:
        """Put ``df`` in the table's place: it is written under another name, then the names change. Until the new one
        has its name, the old table is there, at last as ``<table>_before_<number>``."""
        base, mark = table.split(".")[-1], uuid.uuid4().hex[:8]
        home = table[: len(table) - len(base)]
        new, old = f"{home}{base}_after_{mark}", f"{home}{base}_before_{mark}"
        df.write.saveAsTable(self.name(new))
        self.spark.sql(f"ALTER TABLE {self.name(table)} RENAME TO {self.name(old)}")
        try:
            self.spark.sql(f"ALTER TABLE {self.name(new)} RENAME TO {self.name(table)}")
        except Exception:
            self.spark.sql(f"ALTER TABLE {self.name(old)} RENAME TO {self.name(table)}")
            raise
        self.spark.sql(f"DROP TABLE {self.name(old)}")

    def save(self, df: DataFrame, table: str, append: bool = False, safer: bool = True, types: dict[str, str] | None = None, na_string: str | None = None, row_names: str | None = None, add_pk: bool = False) -> None:
        """Create, append to or, when not ``safer``, replace a table.

        ``row_names`` is stored first, as column ``rownames``; with ``add_pk`` it must be unique and not null and
        becomes the table's declared key (``primary_keys`` lists it; later writes are not checked).
        """
        if add_pk and row_names is None:
            raise ValueError("a key needs row_names")
        if row_names is not None:
            df = df.select(F.col(row_names).alias("rownames"), *[c for c in df.columns if c != row_names])
        for c, kind in (types or {}).items():
            df = df.withColumn(c, F.col(c).cast(kind))
        if add_pk and not df.groupBy("rownames").count().where("rownames IS NULL OR count > 1").isEmpty():
            raise ValueError("row names repeat or are missing: no key")
        if na_string is not None:
            df = df.select(*[F.coalesce(F.col(c), F.lit(na_string)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        there = self.table_exists(table)
        if there and not append and safer:
            raise FileExistsError(f"table {table} exists")
        if there and append:
            df.select(*self.spark.table(self.name(table)).columns).write.mode("append").saveAsTable(self.name(table))
        elif there:
            self._replace(df, table)
        else:
            df.write.saveAsTable(self.name(table))
        if add_pk:
            self.spark.sql(f"ALTER TABLE {self.name(table)} SET TBLPROPERTIES ('{KEY_PROPERTY}' = 'rownames')")

    def updated(self, table: str | DataFrame, changes: DataFrame, index: list[str]) -> DataFrame:
        """The table with the changed columns taken from ``changes`` where the index matches."""
        base = self.fetch(table) if isinstance(table, str) else table
        extra = [c for c in changes.columns if c not in base.columns]
        if extra or not set(index) <= set(changes.columns):
            raise ValueError(f"columns {extra or index} do not fit the table")
        if not changes.groupBy(*index).count().where("count > 1").isEmpty():
            raise ValueError("the index is not unique in the changes")
        new = changes.select(*[F.col(c).alias(f"__{c}") for c in changes.columns], F.lit(True).alias("__hit"))
        on = [base[c].eqNullSafe(new[f"__{c}"]) for c in index]
        joined = base.join(new, on, "left")
        kinds = dict(base.dtypes)
        return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}").cast(kinds[c])).otherwise(base[c]).alias(c) if c in changes.columns and c not in index else base[c] for c in base.columns])

    def update(self, table: str, changes: DataFrame, index: list[str]) -> None:
        """Keyed update: the new contents are written beside the table and take its place by renaming."""
        keys = [r["column_name"] for r in self.primary_keys(table).collect()]
        self._replace(self.updated(table, changes, index), table)
        if keys:
            self.spark.sql(f"ALTER TABLE {self.name(table)} SET TBLPROPERTIES ('{KEY_PROPERTY}' = '{keys[0]}')")

    def execute_many(self, sql: str, rows: DataFrame) -> int:
        """One parameterised statement for each row, by named markers, one after another; how many there were.

        Rows come partition by partition. For many changes write them as a table and use one statement.
        """
        n = 0
        for r in rows.toLocalIterator():
            self.query(sql, r.asDict())
            n += 1
        return n

    def copy_query(self, sql: str, destination: str) -> None:
        self.query(sql).write.saveAsTable(self.name(destination))

    def copy_structure(self, source: str, destination: str) -> None:
        self.spark.sql(f"CREATE TABLE {self.name(destination)} LIKE {self.name(source)}")

    def clear(self, table: str) -> None:
        self.table_exists(table, abort=True)
        self.spark.sql(f"TRUNCATE TABLE {self.name(table)}")

    def drop(self, table: str, missing_ok: bool = False) -> None:
        self.table_exists(table, abort=not missing_ok)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")

    # -- catalogue ---------------------------------------------------------------------------------------------------

    def tables(self, pattern: str | None = None) -> DataFrame:
        """(table_schema, table_name, table_type); % and _ are wild in the pattern."""
        rx = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern), re.I) if pattern else None
        rows = [(t.namespace[0] if t.namespace else None, t.name, t.tableType) for t in self.spark.catalog.listTables() if rx is None or rx.fullmatch(t.name)]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")

    def columns(self, table: str) -> DataFrame:
        """(position, column_name, type_name, nullable)."""
        self.table_exists(table, abort=True)
        rows = [(k + 1, c.name, c.dataType, c.nullable) for k, c in enumerate(self.spark.catalog.listColumns(self.name(table)))]
        return self.spark.createDataFrame(rows, "position int, column_name string, type_name string, nullable boolean")

    def primary_keys(self, table: str) -> DataFrame:
        """(column_name, key_seq): the key that ``save`` declared, if any."""
        self.table_exists(table, abort=True)
        found = self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").where(F.col("key") == KEY_PROPERTY).collect()
        return self.spark.createDataFrame([(r["value"], 1) for r in found], "column_name string, key_seq int")

    def type_info(self, family: str | None = None) -> dict[str, str]:
        return dict(self.types) if family is None else {family: self.types[family]}

    def set_type_info(self, family: str, kind: str) -> None:
        """Another column type for a family, checked by Spark; for this channel only."""
        self.spark.createDataFrame([], f"x {kind}")
        self.types[family] = kind
