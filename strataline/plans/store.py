"""A versioned survey store on Spark's readers and writers.

A store is a folder: ``catalog/databases``, ``catalog/channels``, ``catalog/versions`` and
``catalog/events`` are append-only Parquet tables; a version names a folder below ``data`` and a
column (field) of it, keyed by row_id. The channels of an import, and others published together, share a folder, so
reading several of them is one scan without a join. Data are written first and listed in the
catalogue then; whatever a failed writer leaves isn't listed, so nobody sees it. Published channels never change; a channel's latest version is
the one with the greatest number. One writer at a time may publish to a store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import projection
from ..functions.formula import compile_formula
from ..functions.numbers import is_finite
from ..operators import joins as J, lines as L, solve, tracks

_TABLES = {
    "databases": "id string, name string, n_rows long, source string, metadata string, created string",
    "channels": "id string, database_id string, name string, unit string, created string",
    "versions": "id string, channel_id string, number int, path string, field string, data_type string, provenance string, created string",
    "events": "id string, database_id string, action string, details string, created string",
}


class StoreError(ValueError):
    pass


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class SurveyStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # catalogue

    def table(self, name: str) -> DataFrame:
        folder = f"{self.path}/catalog/{name}"
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(folder)

    def _append(self, table: str, /, **row) -> None:
        self.spark.createDataFrame([tuple(row[f.split()[0]] for f in _TABLES[table].split(", "))], _TABLES[table]).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog/{table}")

    def _log(self, database_id: str, action: str, **details) -> None:
        self._append("events", id=uuid.uuid4().hex, database_id=database_id, action=action, details=json.dumps(details, allow_nan=False, sort_keys=True), created=_now())

    def databases(self) -> DataFrame:
        return self.table("databases").orderBy("name")

    def history(self, database_id: str) -> DataFrame:
        return self.table("events").where(F.col("database_id") == database_id).orderBy("created", "id")

    def names(self) -> DataFrame:
        """channels under their last name (a rename appends a row)."""
        c = self.table("channels")
        return c.groupBy("id", "database_id").agg(F.max_by("name", "created").alias("name"), F.max_by("unit", "created").alias("unit"))

    def channels(self, database_id: str) -> DataFrame:
        """The latest version of each channel."""
        latest = self.table("versions").groupBy("channel_id").agg(F.max_by(F.struct("id", "number", "path", "field", "data_type"), "number").alias("v"))
        own = self.names().where(F.col("database_id") == database_id)
        return own.join(latest, own["id"] == latest["channel_id"]).select("name", F.col("id").alias("channel_id"), "unit", F.col("v.id").alias("version_id"), F.col("v.number").alias("number"), F.col("v.path").alias("path"), F.col("v.field").alias("field"), F.col("v.data_type").alias("data_type")).orderBy("name")

    def _bound(self, database_id: str, names: Sequence[str]) -> dict[str, tuple]:
        found = {r["name"]: r for r in self.channels(database_id).collect()}
        missing = [n for n in names if n not in found]
        if missing:
            raise StoreError(f"unknown channels: {missing}")
        return {n: found[n] for n in dict.fromkeys(names)}

    # import and read

    def import_table(self, name: str, df: DataFrame, *, source: str = "", metadata: dict | None = None, order: Sequence[str] = (), units: dict[str, str] | None = None) -> str:
        """Rows get dense row ids by ``order`` (or their row_id column). Nested columns are refused."""
        if not name or len(name) > 200 or self.table("databases").where(F.col("name") == name).count():
            raise StoreError(f"a new name of 1 to 200 characters is needed: {name!r}")
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        if nested:
            raise StoreError(f"nested columns: {nested}")
        database = uuid.uuid4().hex
        # written once with its row ids, so that the channels are of the same rows even where the order has ties
        path = f"{self.path}/data/{database}/import"
        n = self._write_numbered(df, order, path)
        self._append("databases", id=database, name=name, n_rows=n, source=source, metadata=json.dumps(metadata or {}, allow_nan=False), created=_now())
        self._list(database, path, {c: ((units or {}).get(c, ""), t) for c, t in df.dtypes if c != "row_id"}, {"action": "import", "source": source})
        self._log(database, "import", rows=n, columns=[c for c in df.columns if c != "row_id"])
        return database

    def _list(self, database_id: str, path: str, columns: dict[str, tuple[str, str]], provenance: dict) -> dict[str, str]:
        """Lists new channels (name -> unit, type), whose columns are in one folder: name -> version. A channel without a
        version isn't seen, so the versions' append, one file, is what publishes them."""
        note = json.dumps(provenance, allow_nan=False, sort_keys=True)
        ids = {name: (uuid.uuid4().hex, uuid.uuid4().hex) for name in columns}
        channels = [(ids[n][0], database_id, n, unit, _now()) for n, (unit, _) in columns.items()]
        versions = [(ids[n][1], ids[n][0], 1, path, n, kind, note, _now()) for n, (_, kind) in columns.items()]
        for table, rows in (("channels", channels), ("versions", versions)):
            self.spark.createDataFrame(rows, _TABLES[table]).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog/{table}")
        return {n: v for n, (_, v) in ids.items()}

    def _write_numbered(self, df: DataFrame, order: Sequence[str], path: str) -> int:
        """Writes the rows with dense row ids (a row's place in its task's file plus the rows of the tasks before it), or their own; how many."""
        if "row_id" in df.columns:
            df.write.option("compression", "zstd").parquet(path)
            n, distinct = self.spark.read.schema(df.schema).parquet(path).agg(F.count("*"), F.countDistinct("row_id")).first()
            if n != distinct:
                self._fs.delete(self._path(path), True)
                raise StoreError("row ids are null or repeated")
            return n
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        placed = (df.orderBy(*order) if order else df).withColumn("__place", F.monotonically_increasing_id())
        placed.write.parquet(aside)
        rows = self.spark.read.schema(placed.schema).parquet(aside)
        task = F.shiftrightunsigned("__place", 33)
        before, start = 0, []
        for r in sorted(rows.groupBy(task.alias("task")).count().collect(), key=lambda r: r["task"]):  # a row per task of the writer
            start.append((r["task"], before))
            before += r["count"]
        starts = self.spark.createDataFrame(start, "__task long, __start long")
        rows = rows.withColumn("__task", task).join(F.broadcast(starts), "__task")
        rows.select((F.col("__start") + F.col("__place").bitwiseAND((1 << 33) - 1)).alias("row_id"), *df.columns).write.option("compression", "zstd").parquet(path)
        self._fs.delete(self._path(aside), True)
        return before

    def scan(self, database_id: str, names: Sequence[str], filters: dict[str, Sequence] | None = None) -> DataFrame:
        """row_id and the named channels, aligned by row_id; only their columns are read, those of one folder by one scan. ``filters``:
        column -> accepted values."""
        needed = list(dict.fromkeys([*names, *(filters or {})]))
        folders: dict[str, list[tuple[str, tuple]]] = {}
        for n, r in self._bound(database_id, needed).items():
            folders.setdefault(r["path"], []).append((n, r))
        out = None
        for path, channels in folders.items():
            fields = ", ".join(dict.fromkeys(f"`{r['field']}` {r['data_type']}" for _, r in channels))
            one = self.spark.read.schema(f"row_id long, {fields}").parquet(path).select("row_id", *[F.col(f"`{r['field']}`").alias(n) for n, r in channels])
            for n, r in channels:
                if filters and n in filters:
                    one = one.where(F.col(n).isin(*[F.lit(v).cast(r["data_type"]) for v in filters[n]]))
            out = one if out is None else out.join(one, "row_id")
        return out.select("row_id", *dict.fromkeys(names))

    # publish

    def _publish(self, database_id: str, name: str, values: DataFrame, unit: str, provenance: dict, channel_id: str | None = None) -> str:
        """``values``: row_id and one column."""
        column = next(c for c in values.columns if c != "row_id")
        kind = values.schema[column].dataType.simpleString()
        number = 1
        if channel_id is None:
            channel_id = uuid.uuid4().hex
            self._append("channels", id=channel_id, database_id=database_id, name=name, unit=unit, created=_now())
        else:
            number = self.table("versions").where(F.col("channel_id") == channel_id).agg(F.max("number")).first()[0] + 1
        aside, target = f"{self.path}/aside/{uuid.uuid4().hex}", f"{self.path}/data/{database_id}/{channel_id}/v{number}"
        values.select("row_id", F.col(column).alias("value")).repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("compression", "zstd").parquet(aside)
        self._fs.mkdirs(self._path(target).getParent())
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(aside), self._path(target)):
            raise StoreError(f"another writer published version {number} of {name!r}")
        version = uuid.uuid4().hex
        self._append("versions", id=version, channel_id=channel_id, number=number, path=target, field="value", data_type=kind, provenance=json.dumps(provenance, allow_nan=False, sort_keys=True), created=_now())
        return version

    def publish(self, database_id: str, name: str, values: DataFrame, *, unit: str = "", inputs: dict[str, str] | None = None, provenance: dict | None = None, new_only: bool = False) -> str:
        """A new channel, or the next version of a computed one. ``inputs``: name -> version id that the values
        were computed from; it fails if any of them isn't the latest any more, or rows are missing."""
        known = {r["name"]: r for r in self.channels(database_id).collect()}
        stale = [n for n, v in (inputs or {}).items() if n not in known or known[n]["version_id"] != v]
        if stale:
            raise StoreError(f"inputs have newer versions: {stale}")
        old = known.get(name)
        if old is not None:
            first = self.table("versions").where((F.col("channel_id") == old["channel_id"]) & (F.col("number") == 1)).first()
            if new_only or json.loads(first["provenance"]).get("action") == "import":
                raise StoreError(f"channel {name!r} can't be replaced")
        self._check_rows(database_id, known, values)
        version = self._publish(database_id, name, values, unit, {"action": "publish", **(provenance or {}), "inputs": inputs or {}}, old["channel_id"] if old else None)
        self._log(database_id, "publish", channel=name, version=version)
        return version

    def _check_rows(self, database_id: str, known: dict, values: DataFrame) -> None:
        """The values have each row id of the database once."""
        n_rows = self.table("databases").where(F.col("id") == database_id).first()["n_rows"]
        ids = self.spark.read.schema("row_id long").parquet(next(iter(known.values()))["path"])
        if values.count() != n_rows or ids.join(values.select("row_id").distinct(), "row_id", "left_semi").count() != n_rows:
            raise StoreError("a channel has a value or null for each row")

    def publish_many(self, database_id: str, values: DataFrame, units: dict[str, str], *, inputs: dict[str, str], provenance: dict) -> dict[str, str]:
        """New channels, all or none of them listed: their data is written first, then one append lists every version."""
        known = {r["name"]: r for r in self.channels(database_id).collect()}
        taken = [n for n in units if n in known]
        stale = [n for n, v in inputs.items() if n not in known or known[n]["version_id"] != v]
        if taken or stale:
            raise StoreError(f"channels exist: {taken}; inputs have newer versions: {stale}")
        path = f"{self.path}/data/{database_id}/{uuid.uuid4().hex}"
        values = values.select("row_id", *units)
        values.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("compression", "zstd").parquet(path)  # computed once for all channels
        try:
            self._check_rows(database_id, known, self.spark.read.schema(values.schema).parquet(path))
        except StoreError:
            self._fs.delete(self._path(path), True)
            raise
        kinds = dict(values.dtypes)
        out = self._list(database_id, path, {n: (unit, kinds[n]) for n, unit in units.items()}, {"action": "publish", **provenance, "inputs": inputs})
        self._log(database_id, "publish", channels=list(units), **provenance)
        return out

    def _lines(self, database_id: str, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
        """The channels with the versions they are read from."""
        return self.scan(database_id, names), {n: r["version_id"] for n, r in self._bound(database_id, names).items()}

    def filter_channel(self, database_id: str, name: str, into: str, kind: str, width: int, *, line: str, axis: str | None = None, max_gap: float | None = None) -> str:
        """A new channel: the ``mean`` or ``median`` of complete centred windows, or ``hampel``'s, within runs of the line (and axis)."""
        names = list(dict.fromkeys([name, line, *([axis] if axis else [])]))
        rows, inputs = self._lines(database_id, names)
        if kind == "hampel":
            rows = L.add_segments(rows, [line], name, axis, max_gap)
            out = L.hampel(rows, name, [line, "segment"], width // 2, complete=True, into=into).select("row_id", F.when(F.col("segment").isNotNull(), F.col(into)).alias(into))
        elif kind in ("mean", "median"):
            out = L.filter_runs(rows, name, [line], width, kind, axis=axis, max_gap=max_gap, into=into).select("row_id", into)
        else:
            raise StoreError("mean, median or hampel")
        return self.publish(database_id, into, out, inputs=inputs, provenance={"filter": kind, "width": width, "axis": axis, "max_gap": max_gap}, new_only=True)

    def correct_magnetic(self, database_id: str, value: str, time: str, line: str, *, base: DataFrame | None = None, base_reference: float = 0.0, lag_seconds: float = 0.0, bucket: float = 60.0, prefix: str = "mag") -> dict[str, str]:
        """``prefix``_base (the base's deviation from its reference at each time; ``base`` has t and v), ``prefix``_lagged (the value ``lag_seconds``
        later along its line) and ``prefix``_corrected, published together. Times outside the base's or the line's have none."""
        rows, inputs = self._lines(database_id, [value, time, line])
        out = rows
        if lag_seconds:
            shifted = rows.select(F.col(line).alias("__line"), (F.col(time) - lag_seconds).alias("__t"), F.col(value).alias("__v"))
            out = J.interpolate(out.withColumn("__line", F.col(line)), shifted, time, "__t", "__v", bucket, ["__line"], f"{prefix}_lagged").drop("__line")
        else:
            out = out.withColumn(f"{prefix}_lagged", F.col(value))
        if base is not None:
            out = J.interpolate(out, base.select(F.col("t").alias("__t"), F.col("v").alias("__v")), time, "__t", "__v", bucket, (), "__base").withColumn(f"{prefix}_base", F.col("__base") - base_reference)
        else:
            out = out.withColumn(f"{prefix}_base", F.lit(0.0))
        out = out.withColumn(f"{prefix}_corrected", F.col(f"{prefix}_lagged") - F.col(f"{prefix}_base"))
        return self.publish_many(database_id, out, {f"{prefix}_{n}": "nT" for n in ("base", "lagged", "corrected")}, inputs=inputs, provenance={"operation": "correct_magnetic", "lag_seconds": lag_seconds, "base_reference": base_reference})

    def level_lines(self, database_id: str, value: str, line: str, crossings: DataFrame, correction: str, corrected: str, sigmas: float = 4.5) -> dict[str, str]:
        """The lines' constants from crossings (traverse, tie, residual), and the value with them, published together."""
        rows, inputs = self._lines(database_id, [value, line])
        found = solve.line_corrections(crossings, "traverse", "tie", "residual", sigmas)
        out = tracks.leveled(rows.withColumn(correction, F.lit(0.0)), found, line, value, corrected).withColumn(correction, F.col(corrected) - F.col(value))
        return self.publish_many(database_id, out, {correction: "", corrected: ""}, inputs=inputs, provenance={"operation": "level_lines", "sigmas": sigmas})

    def reproject(self, database_id: str, x: str, y: str, source, target, into: tuple[str, str]) -> dict[str, str]:
        """New coordinates by :func:`projection.reproject`; null where either is. A result that isn't finite fails it all."""
        rows, inputs = self._lines(database_id, [x, y])
        out = projection.reproject(rows, x, y, source, target, into)
        bad = F.raise_error(F.lit("a position has no finite coordinates there")).cast("double")
        checked = [F.when(F.col(x).isNotNull() & F.col(y).isNotNull() & ~is_finite(F.col(c)), bad).otherwise(F.col(c)).alias(c) for c in into]
        return self.publish_many(database_id, out.select("row_id", *checked), dict.fromkeys(into, ""), inputs=inputs, provenance={"operation": "reproject", "source": str(source), "target": str(target)})

    def duplicate(self, database_id: str, name: str, into: str) -> str:
        """Another name for the latest version's data, without a copy; later versions of either are its own."""
        source = self._bound(database_id, [name])[name]
        if into in {r["name"] for r in self.channels(database_id).collect()}:
            raise StoreError(f"there is a channel {into!r}")
        channel, version = uuid.uuid4().hex, uuid.uuid4().hex
        self._append("channels", id=channel, database_id=database_id, name=into, unit=source["unit"], created=_now())
        self._append("versions", id=version, channel_id=channel, number=1, path=source["path"], field=source["field"], data_type=source["data_type"], provenance=json.dumps({"action": "duplicate", "inputs": {name: source["version_id"]}}, sort_keys=True), created=_now())
        self._log(database_id, "duplicate", source=name, channel=into)
        return version

    def set_geometry(self, database_id: str, x: str, y: str, crs: str, line: str | None = None) -> None:
        bound = self._bound(database_id, [x, y, *([line] if line else [])])
        if x == y or not crs.strip():
            raise StoreError("two channels and a reference system are needed")
        self._log(database_id, "geometry", x=bound[x]["channel_id"], y=bound[y]["channel_id"], crs=crs, line=bound[line]["channel_id"] if line else None)

    def geometry(self, database_id: str) -> dict | None:
        """What :meth:`set_geometry` said last: channel ids, so that renames don't matter."""
        last = self.table("events").where((F.col("database_id") == database_id) & (F.col("action") == "geometry")).orderBy(F.desc("created")).first()
        return json.loads(last["details"]) if last else None

    def derive(self, database_id: str, name: str, formula: str, unit: str = "", **options) -> tuple[str, int]:
        """(version id, rows without a result) of a formula channel."""
        expression, channels = compile_formula(formula)
        bound = self._bound(database_id, channels)
        values = self.scan(database_id, channels).select("row_id", expression.alias(name))
        version = self.publish(database_id, name, values, unit=unit, inputs={n: r["version_id"] for n, r in bound.items()}, provenance={"formula": formula}, **options)
        return version, self.scan(database_id, [name]).where(F.col(name).isNull()).count()

    def rename(self, database_id: str, old: str, new: str) -> None:
        """The channel keeps its id, so lineage holds."""
        bound = self._bound(database_id, [old])[old]
        if new in {r["name"] for r in self.channels(database_id).collect()}:
            raise StoreError(f"there is a channel {new!r}")
        self._append("channels", id=bound["channel_id"], database_id=database_id, name=new, unit=bound["unit"], created=_now())
        self._log(database_id, "rename", old=old, new=new)

    def lineage(self, version_id: str, limit: int = 200) -> DataFrame:
        """(id, depth) of the versions that a version was computed from, itself first."""
        v = self.table("versions").select("id", F.explode(F.map_values(F.from_json(F.get_json_object("provenance", "$.inputs"), "map<string,string>"))).alias("parent"))
        edges = v.select("id", "parent")
        edges.createOrReplaceTempView(f"edges_{version_id}")
        try:
            walk = self.spark.sql(f"WITH RECURSIVE up(id, depth) AS (SELECT '{version_id}', 0 UNION ALL SELECT e.parent, up.depth + 1 FROM up JOIN edges_{version_id} e ON e.id = up.id) SELECT id, min(depth) AS depth FROM up GROUP BY id ORDER BY depth, id LIMIT {int(limit)}")
            rows = [(r["id"], r["depth"]) for r in walk.collect()]
        finally:
            self.spark.catalog.dropTempView(f"edges_{version_id}")
        return self.spark.createDataFrame(rows, "id string, depth int")

    def page(self, database_id: str, names: Sequence[str], limit: int = 100, offset: int = 0) -> tuple[DataFrame, bool]:
        """(rows by row_id, whether there are more)."""
        if not 1 <= limit <= 2000:
            raise StoreError("a page has 1 to 2000 rows")
        rows = self.scan(database_id, names).where((F.col("row_id") >= offset) & (F.col("row_id") <= offset + limit)).orderBy("row_id")
        n = self.table("databases").where(F.col("id") == database_id).first()["n_rows"]
        return rows.where(F.col("row_id") < offset + limit), offset + limit < n

    def export_csv(self, database_id: str, names: Sequence[str], path: str, filters: dict[str, Sequence] | None = None) -> None:
        """Fails if the folder exists or nothing is selected."""
        rows = self.scan(database_id, names, filters).orderBy("row_id").drop("row_id")
        if rows.isEmpty():
            raise StoreError("nothing is selected")
        rows.write.mode("errorifexists").option("header", True).csv(path)

    def verify(self, database_id: str, names: Sequence[str], original: DataFrame) -> int:
        """Rows that differ from ``original`` (row_id and the same columns), counted both ways."""
        mine, other = self.scan(database_id, names), original.select("row_id", *names)
        return mine.exceptAll(other).count() + other.exceptAll(mine).count()
