"""Text formats as DataFrames: cut files, column files, season reports, run files, observation lists.

Readers work on lines (path, line, value) from ``text_lines`` or from any table, so files of any number are parsed in parallel and
a test needs no files. Nothing in a file is ever evaluated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files; a file is read as a whole, since its lines are numbered."""
    got = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return got.where("value <> ''")


def read_columns(lines: DataFrame, names: dict[str, tuple[int, str]], delimiter: str = r"\s+", skip: int = 0, comment: str = "#") -> DataFrame:
    """Columns by position and type of lines that aren't comments; fields that don't convert are null."""
    parts = F.split(F.trim("value"), delimiter)
    rows = lines.where((F.col("line") >= skip) & ~F.trim("value").startswith(comment) & (F.trim("value") != ""))
    return rows.select("path", "line", parts.alias("p")).select("path", "line", *[F.try_element_at("p", F.lit(i + 1)).try_cast(t).alias(n) for n, (i, t) in names.items()])


def infer_types(lines: DataFrame, columns: int, delimiter: str = r"\s+", comment: str = "#") -> list[str]:
    """The first of bigint, double and string to which every field of each column converts; one pass, one row to the driver."""
    rows = lines.where(~F.trim("value").startswith(comment) & (F.trim("value") != "")).select(F.split(F.trim("value"), delimiter).alias("p"))
    field = [F.try_element_at("p", F.lit(i + 1)) for i in range(columns)]
    got = rows.agg(*[F.every(f.try_cast(t).isNotNull()).alias(f"{t}{i}") for i, f in enumerate(field) for t in ("bigint", "double")]).first()
    return ["bigint" if got[f"bigint{i}"] else "double" if got[f"double{i}"] else "string" for i in range(columns)]


def format_columns(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Lines (value) of printf formats by column, to be written as text below a ``#`` header of the names."""
    return df.select(F.concat_ws(" ", *[F.format_string(f, c) for c, f in formats.items()]).alias("value"))


def column_header(formats: dict[str, str]) -> str:
    return "# " + " ".join(formats)


def parse_cuts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, ranges) of cut files: ``k = v`` lines up to END, then ``uid: (a,b) (c,d)``.

    header: path, key, value. ranges: path, det_uid, start, stop. Lines that fit neither form are left out, as are a detector's line
    without ranges.
    """
    body = F.regexp_extract("value", r"^\s*(\d+)\s*:", 1)
    head = lines.select("path", F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(.*?)\s*$", 2).alias("value")).where("key <> ''")
    return head, _ranges(lines.where(body != ""), body.cast("int"))


def parse_row_column_cuts(lines: DataFrame, columns: int) -> DataFrame:
    """Ranges of files whose lines read ``rNNcNN: (a,b)``; det_uid = row * columns + column."""
    row, col = F.regexp_extract("value", r"^\s*r(\d+)c(\d+)\s*:", 1), F.regexp_extract("value", r"^\s*r(\d+)c(\d+)\s*:", 2)
    return _ranges(lines.where(row != ""), row.cast("int") * columns + col.cast("int"))


def _ranges(lines: DataFrame, det) -> DataFrame:
    pair = F.regexp_extract_all("value", F.lit(RANGE), F.lit(0))
    got = lines.select("path", det.alias("det_uid"), F.explode(pair).alias("r"))
    return got.select("path", "det_uid", F.regexp_extract("r", RANGE, 1).cast("int").alias("start"), F.regexp_extract("r", RANGE, 2).cast("int").alias("stop"))


def format_cuts(ranges: DataFrame, path: str = "path") -> DataFrame:
    """(path, det_uid, value) lines of a cut file, ranges in order."""
    per = ranges.groupBy(path, "det_uid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("r"))
    text = F.concat_ws(" ", F.transform("r", lambda r: F.format_string("(%d,%d)", r["start"], r["stop"])))
    return per.select(path, "det_uid", F.concat(F.col("det_uid").cast("string"), F.lit(": "), text).alias("value"))


def cut_header(header: dict[str, object]) -> list[str]:
    return [f"{k} = {v}" for k, v in header.items()] + ["END"]


def parse_report(lines: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Season report: fields between ``|``; of the given (name, type) columns. Header, type and comment lines don't convert and go."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = lines.where(~F.trim("value").startswith("#")).select("path", "line", parts.alias("p"))
    got = rows.select("path", "line", *[F.try_element_at("p", F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)])
    numeric = [n for n, t in columns if t != "string"]
    return got.where(" or ".join(f"`{n}` is not null" for n in numeric)) if numeric else got


def report_columns(head: str, types: str) -> list[tuple[str, str]]:
    """Columns from the header and the type line of a report."""
    kind = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
    split = lambda s: [x.strip() for x in s.lstrip("#").split("|") if x.strip()]
    return [(n, kind.get(t, "string")) for n, t in zip(split(head), split(types))]


def format_report(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]).alias("value"))


def parse_list(lines: DataFrame) -> DataFrame:
    """(ord, name): first word of every line that isn't a comment."""
    name = F.split(F.trim("value"), r"\s+")[0]
    return lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("path", F.col("line").alias("ord"), name.alias("name"))


def parse_run_file(lines: DataFrame) -> DataFrame:
    """(path, block, key, item, value) of ``<block>`` ... ``</block>`` sections with ``<key> values`` lines; item counts the values."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim("value")
    opens = F.regexp_extract(text, r"^<(\w+)>$", 1)
    closes = F.regexp_extract(text, r"^</(\w+)>$", 1)
    mark = F.when(opens != "", F.struct(opens.alias("b"))).when(closes != "", F.struct(F.lit(None).cast("string").alias("b")))
    rows = lines.withColumn("_m", F.last(mark, True).over(w)).withColumn("_k", F.regexp_extract(text, r"^<([\w ]+)>\s+(.+)$", 1)).withColumn("_v", F.regexp_extract(text, r"^<([\w ]+)>\s+(.+)$", 2))
    return rows.where("_k <> ''").select("path", F.col("_m.b").alias("block"), F.trim("_k").alias("key"), F.posexplode(F.split(F.trim("_v"), r"\s+")).alias("item", "value"))


def parse_format_file(lines: DataFrame) -> DataFrame:
    """(path, name, kind, detail) of a channel list whose lines read ``name KIND detail``."""
    parts = F.split(F.trim("value"), r"\s+", 3)
    rows = lines.where(~F.trim("value").startswith("#") & ~F.trim("value").startswith("/")).select("path", parts.alias("p")).where("size(p) >= 2")
    return rows.select("path", F.col("p")[0].alias("name"), F.col("p")[1].alias("kind"), F.try_element_at("p", F.lit(3)).alias("detail"))


def parse_config(text: str) -> dict:
    """``key = literal`` lines of a parameter file; values are literals only, anything else stays text. ``%(key)s`` is replaced by earlier values."""
    import ast

    out: dict = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].strip()
        if "=" not in body:
            continue
        k, v = (x.strip() for x in body.split("=", 1))
        try:
            out[k] = ast.literal_eval(v)
        except (ValueError, SyntaxError):
            out[k] = v
        if isinstance(out[k], str):
            for name, value in out.items():
                out[k] = out[k].replace(f"%({name})s", str(value))
    return out


def substituted(tree, names: dict | None = None, depth: int = 20):
    """A tree of dictionaries, lists and texts with ``{name}`` replaced by the text or number of that name at its top, until nothing is left to replace.

    Names that aren't there stay; a name that leads back to itself is an error.
    """
    import re

    names = tree if names is None and isinstance(tree, dict) else names or {}

    def one(text: str, left: int) -> str:
        if not left:
            raise ValueError(f"substitution without end: {text}")
        new = re.sub(r"\{(\w+)\}", lambda m: str(names[m[1]]) if isinstance(names.get(m[1]), (str, int, float)) else m[0], text)
        return new if new == text else one(new, left - 1)

    if isinstance(tree, dict):
        return {k: substituted(v, names, depth) for k, v in tree.items()}
    if isinstance(tree, (list, tuple)):
        return type(tree)(substituted(v, names, depth) for v in tree)
    return one(tree, depth) if isinstance(tree, str) else tree


def get_deep(tree: dict, path: str, default=None):
    """Value at a dotted path."""
    for k in path.split("."):
        if not isinstance(tree, dict) or k not in tree:
            return default
        tree = tree[k]
    return tree


def set_deep(tree: dict, path: str, value) -> dict:
    """The tree with a value put at a dotted path, dictionaries made on the way."""
    at = tree
    *parents, last = path.split(".")
    for k in parents:
        at = at.setdefault(k, {})
    at[last] = value
    return tree
