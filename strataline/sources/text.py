"""Survey text files: inspection, strict reading, regular grids and LAS logs.

Inspection reads at most 256 KiB on the driver and returns the reader's options; the
table itself is read by Spark, with every cell kept as text until a strict cast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import strict_double, strict_long

INSPECT_BYTES = 256 << 10
# Names that tell a column's role.
ROLES = {
    "x": ("x", "easting", "east", "este", "leste", "longitude", "lon", "utmx"),
    "y": ("y", "northing", "north", "norte", "latitude", "lat", "utmy"),
    "time": ("time", "tiempo", "tempo", "utc", "seconds"),
    "line": ("line", "lineid", "linea", "linha", "flightline"),
    "sensor": ("sensor", "sensorid", "detector"),
}


def _key(name: str) -> str:
    plain = name.lower().translate(str.maketrans("áàâãéêíóôõúüñç", "aaaaeeiooouunc"))
    return re.sub("[^a-z0-9]", "", re.sub(r"\[.*?\]|\(.*?\)", "", plain))


@dataclass
class Column:
    name: str
    kind: str  # text, integer or float
    role: str | None = None
    unit: str | None = None


@dataclass
class Layout:
    separator: str
    encoding: str
    header_line: int | None  # physical, from 1
    data_line: int
    decimal_comma: bool
    columns: list[Column] = field(default_factory=list)


def _head(spark: SparkSession, path: str) -> bytes:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        return bytes(stream.readNBytes(INSPECT_BYTES))
    finally:
        stream.close()


def _encoding(raw: bytes) -> str:
    for bom, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(bom):
            return name
    try:
        raw.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start > len(raw) - 4 else "windows-1252"


def _western() -> tuple[str, str]:
    """The characters that windows-1252 has where ISO-8859-1 has controls, from and to."""
    pairs = [(chr(b), t) for b in range(0x80, 0xA0) if (t := bytes([b]).decode("cp1252", "ignore"))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _is_number(text: str, comma: bool) -> bool:
    t = text.strip().replace(",", ".") if comma else text.strip()
    return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t))


def inspect(spark: SparkSession, path: str, nulls: tuple[str, ...] = ("", "*", "NA", "NaN", "null")) -> Layout:
    """Separator, header, types, roles and units, from the first 500 lines."""
    raw = _head(spark, path)
    encoding = _encoding(raw)
    lines = raw.decode(encoding, "replace").lstrip("﻿").splitlines()[:500]
    best = None
    for sep in (",", ";", "\t", "|"):
        widths = [ln.count(sep) + 1 for ln in lines if ln.strip()]
        wide = max(set(widths), key=widths.count) if widths else 1
        score = (widths.count(wide) / max(len(widths), 1)) * (wide > 1), wide
        if best is None or score > best[0]:
            best = score, sep, wide
    sep, width = best[1], best[2]
    rows = [(i + 1, ln.split(sep)) for i, ln in enumerate(lines) if ln.strip() and len(ln.split(sep)) == width]
    comma = sep != "," and any(re.fullmatch(r"\s*[+-]?\d+,\d+\s*", c) for _, r in rows for c in r)
    header = next((i for i, r in rows if not any(_is_number(c, comma) for c in r)), None)
    data = next((i for i, _ in rows if header is None or i > header), (header or 0) + 1)
    sample = [r for i, r in rows if i >= data][:100]
    names = [c.strip().strip('"') for c in dict(rows)[header]] if header else [f"channel_{k + 1}" for k in range(width)]
    columns = []
    for k, name in enumerate(names):
        cells = [r[k].strip().strip('"') for r in sample if r[k].strip() not in nulls]
        kind = "text"
        if cells and all(_is_number(c, comma) for c in cells) and not any(re.fullmatch(r"0\d+", c) for c in cells):
            kind = "integer" if all(re.fullmatch(r"[+-]?\d+", c) for c in cells) else "float"
        unit = re.search(r"[\[(](.*?)[\])]", name)
        role = next((r for r, keys in ROLES.items() if _key(name) in keys), None)
        if role in {c.role for c in columns}:
            role = None
        columns.append(Column(name, kind, role, unit[1] if unit else None))
    return Layout(sep, encoding, header, data, comma, columns)


def read(spark: SparkSession, path: str, layout: Layout, nulls: tuple[str, ...] = ("", "*", "NA", "NaN", "null"), strict: bool = True, multiline: bool = False) -> DataFrame:
    """The table with the layout's types. ``multiline``: quoted cells may have line ends (such a file is one task). ``strict``: a cell that isn't a number of its column's type fails the
    query; else it is null. Lines before the data are told apart by their text, so a large file stays splittable."""
    schema = ", ".join(f"`c{k}` string" for k in range(len(layout.columns)))
    western = layout.encoding == "windows-1252"  # which Spark doesn't read: read as ISO-8859-1, then mapped
    raw = spark.read.csv(path, schema=schema, sep=layout.separator, encoding="ISO-8859-1" if western else layout.encoding, enforceSchema=True, mode="PERMISSIVE", multiLine=multiline, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if western:
        raw = raw.select([F.translate(c, *_western()).alias(c) for c in raw.columns])
    head = _head(spark, path).decode(layout.encoding, "replace").lstrip("﻿").splitlines()[: layout.data_line - 1]
    skip = [ln.split(layout.separator)[0].strip().strip('"') for ln in head if ln.strip()]
    if skip:
        raw = raw.where(~F.col("c0").isin(*skip) | F.col("c0").isNull())
    out = []
    for k, c in enumerate(layout.columns):
        cell = F.when(~F.trim(f"c{k}").isin(*nulls), F.trim(f"c{k}"))
        if c.kind != "text":
            number = strict_long(cell) if c.kind == "integer" else strict_double(cell, layout.decimal_comma)
            if strict:
                number = F.when(cell.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit(f"{c.name}: not a number: "), cell)).cast(dict(integer="bigint", float="double")[c.kind])).otherwise(number)
            cell = number
        out.append(cell.alias(c.name))
    return raw.select(*out)


def read_grid(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rows of a complete regular lattice as cells (r, c, x, y, z); duplicates and holes are refused."""
    n = df.agg(F.count("*").alias("n"), F.countDistinct(x).alias("nx"), F.countDistinct(y).alias("ny"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if n["n"] != n["nx"] * n["ny"] or df.select(x, y).distinct().count() != n["n"]:
        raise ValueError("the lattice isn't complete")
    dx, dy = (n["x1"] - n["x0"]) / max(n["nx"] - 1, 1), (n["y1"] - n["y0"]) / max(n["ny"] - 1, 1)
    place = lambda c, o, d: F.rint((F.col(c) - o) / (d or 1)).cast("int")
    return df.select(place(y, n["y0"], dy).alias("r"), place(x, n["x0"], dx).alias("c"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))


def read_las(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(curves, header) of LAS 1.2/2.0 text; the null value becomes null. The header is parsed on the driver from the head."""
    lines = _head(spark, path).decode("utf-8", "replace").splitlines()
    section, header, names = "", {}, []
    for ln in lines:
        if ln.startswith("~"):
            section = ln[1:2].upper()
            if section == "A":
                break
        elif ln.strip() and not ln.startswith("#"):
            m = re.match(r"\s*([^.\s]+)\s*\.(\S*)\s*(.*?)\s*(?::\s*(.*))?$", ln)
            if m:
                header.setdefault(section, {})[m[1]] = m[3]
                if section == "C":
                    names.append(m[1])
    null = header.get("W", {}).get("NULL", "-999.25")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*[+-]?[0-9.]"))
    cells = rows.select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") == len(names))
    return cells.select(*[F.when(F.get("v", k).try_cast("double") != float(null), F.get("v", k).try_cast("double")).alias(n) for k, n in enumerate(names)]), header


def write_las(df: DataFrame, path: str, header: dict[str, dict[str, str]], null: float = -999.25) -> None:
    """The curves of a log back as LAS text (one file: a log is one hole)."""
    head = ["~Version", "VERS. 2.0 :", "WRAP. NO :", "~Well", *(f"{k}. {v} :" for k, v in header.get("W", {}).items() if k != "NULL"), f"NULL. {null} :", "~Curve", *(f"{c}. :" for c in df.columns), "~A"]
    spark = df.sparkSession
    lines = df.orderBy(df.columns[0]).select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit(str(null))) for c in df.columns]).alias("value"))
    top = spark.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    top.unionAll(lines).coalesce(1).write.mode("errorifexists").text(path)


def _typed(cells: DataFrame, names: list[str], nulls: tuple[str, ...], comma: bool, text: tuple[str, ...]) -> DataFrame:
    """Cells ``v`` as columns: numbers (null where they aren't), or text where named."""
    out = []
    for k, n in enumerate(names):
        cell = F.trim(F.get("v", k))
        cell = F.when(~cell.isin(*nulls), cell)
        out.append((cell if n in text else strict_double(cell, comma)).alias(n))
    return cells.select(*[c for c in cells.columns if c != "v"], *out)


def read_spaced(spark: SparkSession, path: str, names: list[str] | None = None, *, skip: int = 0, nulls: tuple[str, ...] = ("", "*", "NA", "NaN", "null"), decimal_comma: bool = False, text: tuple[str, ...] = ()) -> DataFrame:
    """Columns set apart by blanks; without names they are channel_1, channel_2, ... as the first line after ``skip`` has. The
    skipped lines are known by their text, so a large file stays splittable."""
    head = _head(spark, path).decode("utf-8", "replace").splitlines()
    first = next((ln.split() for ln in head[skip:] if ln.strip()), [])
    names = names or [f"channel_{k + 1}" for k in range(len(first))]
    lines = spark.read.text(path).where(F.trim("value") != "")
    if skip:
        lines = lines.where(~F.col("value").isin(*head[:skip]))
    return _typed(lines.select(F.split(F.trim("value"), r"\s+").alias("v")), names, nulls, decimal_comma, text)


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]], *, skip: int = 0, nulls: tuple[str, ...] = ("", "*", "NA", "NaN", "null"), decimal_comma: bool = False, text: tuple[str, ...] = ()) -> DataFrame:
    """``fields``: name, first character (from 0) and width of each."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if skip:
        lines = lines.where(~F.col("value").isin(*_head(spark, path).decode("utf-8", "replace").splitlines()[:skip]))
    return _typed(lines.select(F.array(*[F.substring("value", a + 1, w) for _, a, w in fields]).alias("v")), [n for n, _, _ in fields], nulls, decimal_comma, text)


def read_sections(spark: SparkSession, path: str, names: list[str], *, marks: tuple[str, ...] = ("LINE", "TIE"), nulls: tuple[str, ...] = ("", "*", "NA", "NaN", "null"), text: tuple[str, ...] = ()) -> DataFrame:
    """Sectioned XYZ text: a line such as ``Line 1010`` or ``Tie 7`` starts a section that the rows after it belong to (columns
    section_kind and section, then ``names``); lines that start with / are remarks. A task knows the sections that start in
    it; the last one of the tasks before comes from a table with a row per task."""
    lines = spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '/')").withColumn("at", F.monotonically_increasing_id())
    start = F.regexp_extract("value", r"(?i)^\s*(" + "|".join(map(re.escape, marks)) + r")\s+(\S+)\s*$", 1)
    name = F.regexp_extract("value", r"^\s*\S+\s+(\S+)\s*$", 1)
    own = F.when(start != "", F.struct(F.upper(start).alias("kind"), name.alias("name")))
    rows = lines.withColumn("own", own).withColumn("task", F.shiftrightunsigned("at", 33))
    within = F.last("own", True).over(Window.partitionBy("task").orderBy("at"))
    ends = rows.groupBy("task").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("end"))
    carried = ends.select("task", F.last("end", True).over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.withColumn("within", within).join(F.broadcast(carried), "task").where("own is null")
    section = F.coalesce("within", "carried")
    cells = rows.select(section["kind"].alias("section_kind"), section["name"].alias("section"), F.split(F.trim("value"), r"\s+").alias("v"))
    return _typed(cells, names, nulls, False, text)
