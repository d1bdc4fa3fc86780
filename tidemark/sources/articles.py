"""Article files to the canonical article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordering import dense_index, first_rows
from tidemark.functions.text import WS

REQUIRED = ["title"]
COLUMNS = ["title", "description", "source", "url", "published", "author", "category"]

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published", T.TimestampNTZType()),
        T.StructField("author", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

# Other column names that mean a canonical one, first match wins.
ALIASES = {
    "title": ["headline"],
    "description": ["text", "content", "summary", "body", "short_description"],
    "source": ["publisher"],
    "url": ["link"],
    "published": ["date", "pubdate", "publication_date", "published_at"],
    "author": ["authors"],
}

# Words in a CSV cell that mean a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date forms beyond ISO 8601; the first list carries a zone.
ZONED_FORMATS = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z"]
PLAIN_FORMATS = [
    "yyyy-MM-dd HH:mm",
    "yyyy/M/d HH:mm:ss",
    "yyyy/M/d",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy HH:mm",
    "M/d/yyyy",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]


def parse_published(text) -> Column:
    """Date text to a zone-less UTC timestamp; null if it has no known form."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9},\\s*", "")
    dated = F.rlike(bare, F.lit(r"^\d{4}(-\d{1,2}(-\d{1,2}.*)?)?$"))
    zoned = F.rlike(bare, F.lit(r"(?i)(\d\s*z|[+-]\d{2}:?\d{2}|\s[a-z]{2,4})$")) & F.rlike(bare, F.lit(":"))
    iso = F.when(dated, F.regexp_replace(bare, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2"))
    instant = F.coalesce(iso.try_cast("timestamp"), *[F.try_to_timestamp(bare, F.lit(f)) for f in ZONED_FORMATS])
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    from_zone = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    plain = F.coalesce(
        F.when(dated, bare.try_cast("timestamp_ntz")),
        *[F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in PLAIN_FORMATS],
    )
    return F.when(zoned, from_zone).otherwise(plain)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names, aliases mapped, missing optional columns added as empty text."""
    names = [c.strip().lower() for c in df.columns]
    out = df.toDF(*names)
    for target, others in ALIASES.items():
        found = [a for a in others if a in names]
        if target not in names and found:
            out = out.withColumnRenamed(found[0], target)
            names = out.columns
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing required column(s) {missing}; found {out.columns}")
    return out.withColumns({c: F.lit("") for c in COLUMNS if c not in out.columns})


def fill_published(df: DataFrame) -> DataFrame:
    """Null dates become the newest date of the table, or today at midnight if all are null."""
    newest = df.agg(F.max("published").alias("m")).scalar()
    today = F.current_date().cast("timestamp_ntz")
    return df.withColumn("published", F.coalesce("published", newest, today))


def default_values(df: DataFrame) -> DataFrame:
    """Empty text for missing titles and descriptions, ``Unknown`` for missing or empty sources."""
    return df.withColumns(
        {
            "title": F.coalesce(F.col("title"), F.lit("")),
            "description": F.coalesce(F.col("description"), F.lit("")),
            "source": F.when(F.coalesce(F.col("source"), F.lit("")) == "", "Unknown").otherwise(F.col("source")),
        }
    )


def drop_blank_titles(df: DataFrame) -> DataFrame:
    return df.filter(F.regexp_replace("title", WS + "+", "") != "")


def dedup_title_source(df: DataFrame, order_col: str) -> DataFrame:
    """First article in input order per exact (title, source)."""
    return first_rows(df, ["title", "source"], order_col)


def normalize_articles(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Raw article table to the canonical 8 columns with dense ids in input order.

    ``order_col`` is a unique long that gives the input order; without it the scan order is used.
    """
    ordered = df.withColumn("_ord", F.col(order_col) if order_col else F.monotonically_increasing_id())
    out = canonical_columns(ordered)
    if not isinstance(out.schema["published"].dataType, T.TimestampNTZType):
        out = out.withColumn("published", parse_published(F.col("published").cast("string")))
    text_cols = {c: F.col(c).cast("string") for c in COLUMNS if c != "published"}
    out = default_values(fill_published(out.withColumns(text_cols))).select("_ord", *COLUMNS)
    kept = dedup_title_source(drop_blank_titles(out), "_ord")
    return dense_index(kept, "_ord", "article_id").select("article_id", *COLUMNS)


def missing_words_to_null(raw: DataFrame) -> DataFrame:
    """Text columns with the usual words for a missing value made null."""
    fields = [f.name for f in raw.schema if isinstance(f.dataType, T.StringType)]
    quoted = {c: F.col(f"`{c}`") for c in fields}
    return raw.withColumns({c: F.when(~x.isin(*MISSING_WORDS), x) for c, x in quoted.items()})


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``multi_line``: quoted texts may hold line ends, so a file is read by one task; without, files are split."""
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return normalize_articles(missing_words_to_null(raw))


def read_json(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """``fmt``: ``array`` (one JSON array per file), ``lines``, or ``auto`` (look at the first byte)."""
    if fmt == "auto":
        # Only the head of the first file is needed to tell the two forms apart.
        head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        fmt = "array" if head and head[0][0].lstrip().startswith("[") else "lines"
    raw = spark.read.option("primitivesAsString", True).option("multiLine", fmt == "array").json(path)
    return normalize_articles(raw)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file name: .json and .jsonl as JSON, anything else as CSV."""
    return read_json(spark, path) if path.lower().endswith((".json", ".jsonl")) else read_csv(spark, path)


def read_sample(spark: SparkSession, path: str = "data/news.csv") -> DataFrame:
    return read_csv(spark, path)
