"""Readers and writers: sensor tables, catalogs, windows, artefacts, scores, health logs, reports and configuration."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEALTH_SCHEMA = "equipment_id string, week_start string, logged_at string, mean_score double, max_score double, min_score double, std_score double, green bigint, yellow bigint, red bigint, alert_rate double, n_days bigint"


def read_table(spark: SparkSession, path: str, timestamp: str = "timestamp", schema: T.StructType | str | None = None, renamed_from: str | None = None) -> DataFrame:
    """A sensor table of Parquet (by suffix or for a folder) or CSV; lists come as arrays.

    The timestamp column (renamed from another if told) is parsed where it is text; unreadable times are null.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif path.rstrip("/").endswith((".json", ".jsonl")):
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if renamed_from and renamed_from in df.columns:
        df = df.withColumnRenamed(renamed_from, timestamp)
    if timestamp not in df.columns:
        raise ValueError(f"no column {timestamp} in {path}")
    return df.withColumn(timestamp, F.try_to_timestamp(timestamp)) if isinstance(df.schema[timestamp].dataType, T.StringType) else df


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(rule_slug, sensors): a JSON object of lists, or CSV with a slug and the first of sensor, internal_tag and
    external_tag that there is; nulls dropped, distinct, sorted."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        column = next((c for c in ("sensor", "internal_tag", "external_tag") if c in df.columns), None)
        if column is None or "rule_slug" not in df.columns:
            raise ValueError("a catalog needs rule_slug and one of sensor, internal_tag, external_tag")
        pairs = df.select("rule_slug", F.col(column).alias("sensor"))
    else:
        text = spark.read.text(path, wholetext=True)
        pairs = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("rule_slug", "_s")).select("rule_slug", F.explode_outer("_s").alias("sensor"))
    return pairs.where("rule_slug IS NOT NULL AND sensor IS NOT NULL").groupBy("rule_slug").agg(F.array_sort(F.collect_set("sensor")).alias("sensors"))


def write_windows(rows: DataFrame, path: str, sensors: list[str], key: str = "equipment_id") -> None:
    """One row per window: its values as an array of rows of float, ordered, partitioned by key."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("row_in_window", F.array(*[F.col(s).cast("float") for s in sensors]).alias("v")))), lambda r: r.v)
    rows.groupBy(key, "window_id").agg(values.alias("values")).write.mode("overwrite").partitionBy(key).parquet(path)


def read_windows(spark: SparkSession, path: str, sensors: list[str], key: str = "equipment_id") -> DataFrame:
    """The wide rows of `write_windows`."""
    rows = spark.read.parquet(path).select(key, "window_id", F.posexplode("values").alias("row_in_window", "_v"))
    return rows.select(key, "window_id", "row_in_window", *[F.col("_v")[i].cast("double").alias(s) for i, s in enumerate(sensors)])


def read_npy_windows(spark: SparkSession, values: str, ids: str | None = None) -> DataFrame:
    """(window_id, row_in_window, values array<double>) of a window x row x sensor array file, read window by window
    on the executors from a mapped file."""
    import numpy as np

    n = np.load(values, mmap_mode="r").shape[0]

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        data = np.load(values, mmap_mode="r")
        names = np.load(ids) if ids else None
        for b in batches:
            for i in b["id"]:
                w = np.asarray(data[i], float)
                yield pd.DataFrame({"window_id": int(names[i]) if names is not None else int(i), "row_in_window": range(len(w)), "values": list(w)})

    return spark.range(n).mapInPandas(run, "window_id long, row_in_window int, values array<double>")


def write_scores(scores: DataFrame, path: str) -> None:
    """Parquet with lists, or CSV with lists joined by commas."""
    if path.endswith(".csv"):
        lists = {f.name: F.array_join(f.name, ",") for f in scores.schema.fields if isinstance(f.dataType, T.ArrayType)}
        scores.withColumns(lists).write.mode("overwrite").option("header", True).csv(path)
    else:
        scores.write.mode("overwrite").parquet(path)


def append_health(weekly: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; `logged_at` is the time of the run unless it is given."""
    out = weekly if "logged_at" in weekly.columns else weekly.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    out.select(*[F.col(f.name).cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(HEALTH_SCHEMA).fields]).write.mode("append").json(path)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """The log; empty where there is none yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], HEALTH_SCHEMA)
    return spark.read.schema(HEALTH_SCHEMA).json(path)


def save_artefacts(folder: str, metadata: dict[str, Any], **tables: DataFrame) -> None:
    """Fitted tables (scaler, limits, errors, baselines, components) as Parquet beside metadata.json."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps(json_safe(metadata) | {"tables": sorted(tables)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "metadata.json"))


def load_artefacts(spark: SparkSession, folder: str) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """The metadata and the tables that `save_artefacts` wrote."""
    metadata = json.loads(spark.read.text(os.path.join(folder, "metadata.json"), wholetext=True).first().value)
    return metadata, {t: spark.read.parquet(os.path.join(folder, f"{t}.parquet")) for t in metadata["tables"]}


def write_report(report: DataFrame, path: str, digits: int | None = None) -> None:
    """A result as JSON lines: NaN as null, doubles rounded if told."""
    clean = {f.name: (lambda c: F.round(c, digits) if digits is not None else c)(F.when(F.isnan(f.name), None).otherwise(F.col(f.name))) for f in report.schema.fields if isinstance(f.dataType, T.DoubleType)}
    report.withColumns(clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_page(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame], most: int = 5_000, digits: int = 4) -> str:
    """Writes small result tables as one HTML page and gives its text. A table of more than `most` rows is an error:
    a page is for reading, and a part of a table would not be told from the whole."""
    from html import escape

    def cell(v: Any) -> str:
        v = json_safe(v, digits)
        return "" if v is None else escape(", ".join(map(str, v)) if isinstance(v, list) else str(v))

    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    text = "".join([*parts, "</body></html>"])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def json_safe(x: Any, digits: int | None = None) -> Any:
    """NaN and infinite values as null, sets as sorted lists, NumPy values as plain ones."""
    if isinstance(x, dict):
        return {str(k): json_safe(v, digits) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted(json_safe(v, digits) for v in x)
    if isinstance(x, (list, tuple)):
        return [json_safe(v, digits) for v in x]
    if hasattr(x, "tolist"):
        return json_safe(x.tolist(), digits)
    if isinstance(x, float):
        return None if x != x or x in (float("inf"), float("-inf")) else round(x, digits) if digits is not None else x
    return x


def export_windows(scores: DataFrame, rows: DataFrame, sensors: list[str], path: str, zones: tuple[str, ...] = ("yellow", "red"), key: str = "equipment_id") -> DataFrame:
    """Flagged usable windows with their rows as JSON, a folder per window, and the index by score, largest first.

    Raises if a flagged window has no rows.
    """
    flagged = scores.where(F.col("zone").isin(*zones) & F.col("usable"))
    missing = flagged.join(rows.select(key, "window_id").distinct(), [key, "window_id"], "left_anti").limit(1).count()
    if missing:
        raise ValueError("a flagged window has no rows")
    values = F.array_sort(F.collect_list(F.struct("row_in_window", "timestamp", *sensors)))
    packed = rows.join(flagged.select(key, "window_id", "score", "zone"), [key, "window_id"]).groupBy(key, "window_id", "score", "zone").agg(values.alias("rows"))
    packed.select(key, "window_id", F.to_json(F.struct("score", "zone", "rows")).alias("value")).write.mode("overwrite").partitionBy(key, "window_id").text(os.path.join(path, "windows"))
    index = flagged.select(key, "window_id", "score", "zone").orderBy(F.col("score").desc(), key, "window_id")
    index.write.mode("overwrite").json(os.path.join(path, "index"))
    return index


def read_config(path: str) -> dict[str, Any]:
    """A YAML (if the module is there) or JSON file; text that is a number in scientific notation becomes one."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return numbers(json.load(f))
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml module; JSON works without") from e
        return numbers(yaml.safe_load(f) or {})


def numbers(x: Any) -> Any:
    """Text such as '1e-5' as the number it means."""
    if isinstance(x, dict):
        return {k: numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [numbers(v) for v in x]
    if isinstance(x, str):
        try:
            return float(x) if "e" in x.lower() and x.lower().replace("e", "").replace("-", "").replace("+", "").replace(".", "").isdigit() else x
        except ValueError:
            return x
    return x


def merged(base: dict, over: dict) -> dict:
    """`base` with the leaves of `over` in place."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def config_hash(config: dict, parts: tuple[str, ...]) -> str:
    """The first 12 hexadecimal digits of the SHA-256 of the named subtrees, to name cached work by."""
    return hashlib.sha256(json.dumps({p: config.get(p) for p in parts}, sort_keys=True).encode()).hexdigest()[:12]
