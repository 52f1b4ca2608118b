"""Load delimited lines and typed rows while setting broken ones apart, each with its first reason (problem 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One line as RFC 4180 reads it.  Possessive quantifiers keep matching iterative and linear on very
#: long lines, which is why the quoted form comes first.
RFC4180_LINE = r'^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+\z'
_CELL = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_ATOMS = r"^(?:Cl|Br|[BCNOPSFIbcnops\-=#:/\\.()0-9]|\[[A-Za-z0-9@+\-:]++\]|%[0-9][0-9])++\z"
#: Univocity allocates its columns up front and throws beyond them; lines with more fields are no row of the schema for
#: it anyway, skip it and are classified from their text like all it rejects.
_MAX_COLUMNS = 20000

Check = Callable[[Column], Column]

RAW_MOLECULES = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("endpoint", T.StringType()), T.StructField("smiles", T.StringType()), T.StructField("label", T.IntegerType())])


def valid_smiles(c: Column) -> Column:
    """True if the text, without outer blanks, is well-formed line notation; null and empty are false.

    All of it must be made of the known symbols, and outside square brackets round brackets must nest and every ring
    label (``%`` with two digits, else one digit) must occur an even number of times.
    """
    text = F.trim(c)
    outside = F.regexp_replace(text, r"\[[^\]]*+\]", "")
    brackets = F.regexp_replace(outside, "[^()]", "")
    depth = F.aggregate(F.split(brackets, ""), F.lit(0), lambda d, x: F.when(d < 0, d).when(x == "(", d + 1).when(x == ")", d - 1).otherwise(d))
    labels = F.regexp_extract_all(outside, F.lit("(%[0-9][0-9]|[0-9])"), F.lit(1))
    # Labels that are open, one pass: a label opens a ring, or closes the one it opened.
    open_ = F.aggregate(labels, F.array().cast("array<string>"), lambda a, x: F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x)))
    return F.coalesce(text.rlike(_ATOMS) & (depth == 0) & (F.size(open_) == 0), F.lit(False))


def valid_raw_label(c: Column) -> Column:
    """True if the text is ``0`` or ``1`` without outer blanks; null is false."""
    return F.coalesce(F.trim(c).isin("0", "1"), F.lit(False))


def valid_label(c: Column) -> Column:
    """True for the numbers 0 and 1; null is false."""
    return F.coalesce(c.isin(0, 1), F.lit(False))


#: The checks of molecule deliveries by field, in the order in which reasons are given.
RAW_CHECKS: dict[str, Check] = {"smiles": valid_smiles, "label": valid_raw_label}
TYPED_CHECKS: dict[str, Check] = {"smiles": valid_smiles, "label": valid_label}


def _first_reason(pairs: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in pairs], F.lit(None).cast("string"))


def parse_lines(df: DataFrame, rec_id: str, line: str, schema: T.StructType = RAW_MOLECULES, checks: dict[str, Check] | None = None) -> DataFrame:
    """Every line once, as ``rec_id``, one column per field of ``schema``, ``corrupt`` (the raw text) and ``reason``.

    Lines are read permissively under the explicit schema with the corrupt text retained.  A line is clean if the reader
    took it without complaint, it holds no quote and its values, written back, give the line itself; clean lines are checked and loaded
    as they were read.  All others (wrong counts, quotes, failed casts, ``01`` for 1) are classified again from the raw text by quoting, number
    of fields and the checks, and loaded from their cells if they are sound after all (an outer blank round a number, say).
    Reasons in order: ``quoting``, ``columns``, then the checked fields.  A null line has no fields: ``columns``.  Bad
    lines have null fields and keep their text in ``corrupt``; good ones have null ``corrupt`` and ``reason``.  Checked texts are loaded without
    outer blanks, other empty texts as null.  Other columns of ``df`` are left out, whatever their names.
    """
    checks = RAW_CHECKS if checks is None else checks
    names, n = schema.fieldNames(), len(schema)
    reader = T.StructType([*schema.fields, T.StructField("__raw", T.StringType())])
    commas = F.length(F.col("line")) - F.length(F.replace(F.col("line"), F.lit(","), F.lit("")))
    quoted = F.contains(F.col("line"), F.lit('"'))
    text = lambda f: F.col("read").getField(f).cast("string")
    back = F.concat_ws(",", *[F.coalesce(text(f), F.lit("")) for f in names])
    out = (
        df.select(F.col(rec_id).alias("rec_id"), F.col(line).cast("string").alias("line"))
        .withColumn("read", F.from_csv(F.when(commas < _MAX_COLUMNS - 1, F.col("line")), reader.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__raw", "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(_MAX_COLUMNS)}))
        .withColumn("clean", F.col("read").isNotNull() & F.col("read.__raw").isNull() & F.coalesce(back == F.col("line"), F.lit(False)) & ~quoted)
    )
    cells = F.when(quoted, F.transform(F.regexp_extract_all("line", F.lit(_CELL), F.lit(1)), lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))).otherwise(F.split("line", ",", -1))
    out = out.withColumn("cells", F.when(~F.col("clean"), cells))
    cell = {f: F.get("cells", F.lit(i)) for i, f in enumerate(names)}
    again = ~F.col("clean")
    broken = [("quoting", again & ~F.col("line").rlike(RFC4180_LINE)), ("columns", again & (F.coalesce(F.size("cells"), F.lit(0)) != n))]
    out = out.withColumn("reason", _first_reason([*broken, *[(f, ~check(F.when(F.col("clean"), text(f)).otherwise(cell[f]))) for f, check in checks.items()]]))

    def value(f: T.StructField) -> Column:
        read, kept = F.col("read").getField(f.name), F.trim(cell[f.name]).try_cast(f.dataType)
        if f.name in checks and isinstance(f.dataType, T.StringType):
            read = F.trim(read)
        elif isinstance(f.dataType, T.StringType):
            kept = F.nullif(cell[f.name], F.lit(""))
        return F.when(F.col("reason").isNull(), F.when(F.col("clean"), read).otherwise(kept)).alias(f.name)

    # Through a generator, below which no later filter is pushed: it would read and check every line once more for each of its parts.
    whole = F.struct(*[value(f) for f in schema], F.when(F.col("reason").isNotNull(), F.col("line")).alias("corrupt"), F.col("reason").alias("reason"))
    return out.select("rec_id", F.explode(F.array(whole)).alias("r")).select("rec_id", "r.*")


def check_rows(df: DataFrame, rec_id: str, fields: list[str], checks: dict[str, Check] | None = None) -> DataFrame:
    """Typed rows as ``rec_id``, ``fields`` and ``reason``: the first failed check, null if the row is good.

    Checked texts come without outer blanks.  Other columns are left out.
    """
    checks = TYPED_CHECKS if checks is None else checks
    kinds = dict(df.dtypes)
    return df.select(
        F.col(rec_id).alias("rec_id"),
        *[(F.trim(F.col(f)) if f in checks and kinds[f] == "string" else F.col(f)).alias(f) for f in fields],
        _first_reason([(f, ~check(F.col(f))) for f, check in checks.items()]).alias("reason"),
    )


def rejected(parts: dict[str, DataFrame]) -> DataFrame:
    """``src``, ``rec_id``, ``reason`` of the bad records of several loaded sources."""
    out = None
    for src, df in parts.items():
        part = df.where("reason IS NOT NULL").select(F.lit(src).alias("src"), F.col("rec_id").cast("bigint").alias("rec_id"), "reason")
        out = part if out is None else out.unionByName(part)
    return out


def loaded(parts: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """``src``, ``rec_id`` and the typed fields of the good records of several loaded sources."""
    out = None
    for src, df in parts.items():
        part = df.where("reason IS NULL").select(F.lit(src).alias("src"), F.col("rec_id").cast("bigint").alias("rec_id"), *fields)
        out = part if out is None else out.unionByName(part)
    return out
