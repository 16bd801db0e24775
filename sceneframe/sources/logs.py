"""Event logs: JSON lines in, redacted JSON lines, activity rows and bundles out.

Events carry ``at, level, scope, message, fields`` where ``fields`` is a string map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.constants import RUNS_COLUMNS
from sceneframe.functions import redact as R
from sceneframe.functions.settle import settle

FIXED = ["at", "level", "scope", "message"]
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(at: Column) -> Column:
    return F.date_format(at, ISO)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.{json,txt}*").select("value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Log lines as events; a line a crash cut short comes back with ``corrupt`` set, not lost."""
    others = [c for c in lines.columns if c != "value"]
    d = settle(lines, {
        "_all": F.from_json("value", "map<string,string>"),
        "_whole": F.try_parse_json("value").isNotNull(),
    })
    ok = F.col("_whole") & F.col("_all").isNotNull()

    def cell(name: str) -> Column:
        return F.when(ok, F.try_element_at("_all", F.lit(name)))

    return d.select(
        *others,
        cell("at").try_cast("timestamp").alias("at"), cell("level").alias("level"), cell("scope").alias("scope"),
        cell("message").alias("message"),
        F.when(ok, F.map_filter("_all", lambda k, v: ~k.isin(FIXED))).alias("fields"),
        F.when(~ok, F.col("value")).alias("corrupt"),
    )


def redacted(events: DataFrame) -> DataFrame:
    return events.withColumns({"message": R.redact(F.col("message")), "fields": R.redact_fields(F.col("fields"))})


def json_line(events: DataFrame) -> Column:
    """One event as one JSON object: the fixed keys first, then its fields as further keys."""
    head = F.to_json(F.struct(iso(F.col("at")).alias("at"), "level", "scope", "message"))
    rest = F.when(F.size("fields") > 0, F.to_json("fields"))
    joined = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(","), F.regexp_replace(rest, r"^\{", ""))
    return F.coalesce(joined, head)


def log_lines(events: DataFrame) -> DataFrame:
    """Redacted lines ready for the sink: ``day, line`` beside the columns that route them."""
    clean = redacted(events)
    return clean.withColumns({"day": F.date_format("at", "yyyyMMdd"), "line": json_line(clean)})


def write_logs(events: DataFrame, path: str) -> None:
    """One folder per UTC day, one JSON object per line."""
    log_lines(events).select("day", F.col("line").alias("value")).write.mode("append").partitionBy("day").text(path)


def activity_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the activity index, in its fixed columns. Takes ``project, folder``."""
    clean = redacted(events)
    cells = [iso(F.col("at")), F.col("level"), F.col("scope"), F.col("project"), F.col("message"),
             F.coalesce(R.join_fields(F.col("fields")), F.lit("")), F.col("folder")]
    return clean.select(*[R.csv_cell(c).alias(n) for c, n in zip(cells, RUNS_COLUMNS)])


CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_activity(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").options(**CSV_OPTIONS).csv(path)


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in RUNS_COLUMNS)
    return spark.read.schema(schema).options(multiLine="true", **CSV_OPTIONS).csv(path)


def bundle_report(lines: DataFrame) -> DataFrame:
    """Files, records and bytes a diagnostics bundle of each project would hold.

    Takes ``project, file, value``. Counted per file first, so that a busy file is combined
    before the shuffle.
    """
    records = F.length(F.trim("value")) > 0
    per_file = lines.groupBy("project", "file").agg(
        F.count_if(records).alias("records"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    return per_file.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def bundle_lines(environment: DataFrame, lines: DataFrame) -> DataFrame:
    """Environment lines, then every record in file and line order, ready to be written.

    ``environment``: ``key, value``; ``lines``: ``file, line_no, value``.
    """
    head = environment.select(
        F.lit("").alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.col("key").alias("name"),
        F.concat(F.rpad(F.concat("key", F.lit(":")), 22, " "), F.lit(" "), "value").alias("value"))
    body = lines.select("file", F.col("line_no").cast("bigint"), F.lit("").alias("name"), "value")
    return head.unionByName(body)


def write_bundle(bundle: DataFrame, path: str) -> None:
    """Files whose names and lines are in order; sorting is spread over range partitions."""
    order = ["file", "line_no", "name"]
    bundle.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
