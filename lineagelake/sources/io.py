"""Sources and sinks: narrowed parquet, TSV, YAML documents, and gathering validation results of many runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored types of the known columns: fixed values.
NARROW = {
    **dict.fromkeys(("id", "generation", "mother", "father", "twin", "household_id"), "int"), "sex": "tinyint", "death_age": "float",
    **{f"{c}{n}": "float" for n in (1, 2) for c in ("A", "C", "E", "t", "t_observed")},
}
RUN_PATH = r"results/([^/]+)/([^/]+)/rep(\d+)/"


def narrow(df: DataFrame) -> DataFrame:
    """Known columns in their stored types; liabilities stay double."""
    return df.select(*[F.col(c).cast(NARROW[c]).alias(c) if c in NARROW else F.col(c) for c in df.columns])


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    narrow(df).write.mode(mode).options(**{"compression": "zstd", **options}).parquet(path)


def save_parquet_plain(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_people(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def tsv_path(parquet_path: str, gzip: bool = True) -> str:
    base = parquet_path[: -len(".parquet")] if parquet_path.endswith(".parquet") else parquet_path
    return base + (".tsv.gz" if gzip else ".tsv")


def parquet_to_tsv(spark: SparkSession, path: str, output: str | None = None, float_precision: int = 4, gzip: bool = True) -> str:
    """Tab-separated with a header and fixed decimals; the folder it wrote."""
    df = spark.read.parquet(path)
    text = [F.format_string(f"%.{float_precision}f", F.col(c).cast("double")).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes]
    text = [F.when(F.col(c).isNotNull(), e).alias(c) if t in ("float", "double") else e for (c, t), e in zip(df.dtypes, text)]
    out = output or tsv_path(path, gzip)
    df.select(*text).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if gzip else "none").csv(out)
    return out


def to_native(obj):
    """Plain Python numbers, lists and dicts out of numpy values, rows and their containers."""
    if isinstance(obj, dict):
        return {k.item() if hasattr(k, "item") else k: to_native(v) for k, v in obj.items()}
    if hasattr(obj, "asDict"):
        return to_native(obj.asDict(recursive=True))
    if hasattr(obj, "tolist"):
        return to_native(obj.tolist())
    if isinstance(obj, (list, tuple, set)):
        return [to_native(x) for x in obj]
    return obj


def load_yaml(path: str):
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def dump_yaml(obj, path: str, sort_keys: bool = False) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(to_native(obj), f, sort_keys=sort_keys)


def nested(doc: dict, dotted: str, default=None):
    for part in dotted.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return default
        doc = doc[part]
    return doc


def gather(spark: SparkSession, pattern: str, metrics: list[str]) -> DataFrame:
    """One row for each JSON result document under `pattern`: folder, scenario, rep, and the dotted metrics as doubles."""
    docs = spark.read.text(pattern, wholetext=True).withColumn("_path", F.input_file_name())
    keys = [F.regexp_extract("_path", RUN_PATH, i).alias(n) for i, n in ((1, "folder"), (2, "scenario"))]
    values = [F.get_json_object("value", f"$.{m}").cast("double").alias(m.replace(".", "_")) for m in metrics]
    return docs.select(*keys, F.regexp_extract("_path", RUN_PATH, 3).cast("int").alias("rep"), *values).orderBy("folder", "scenario", "rep")


def checks_document(checks: DataFrame) -> str:
    """The checks of one validation run as a JSON document (a few dozen rows)."""
    out: dict = {}
    for r in checks.collect():
        out.setdefault(r.category, {})[r.name] = {"passed": r.passed, "observed": r.observed, "expected": r.expected, "details": r.details}
    return json.dumps(out, sort_keys=True)


#: Models whose params hold a prevalence, and all known ones: fixed values. Blocks without a model are frailty.
WITH_PREVALENCE, KNOWN_MODELS = ("adult", "cure_frailty"), ("frailty", "cure_frailty", "adult", "first_passage")


def migrate_prevalence(doc):
    """A document whose phenotype sections have a trait's prevalence in its params, or not at all where the model has none.

    Traits of unknown models and traits whose params are no mapping stay as they are, and so does everything else. A
    migrated document stays the same.
    """
    if isinstance(doc, list):
        return [migrate_prevalence(x) for x in doc]
    if not isinstance(doc, dict):
        return doc
    out = {k: migrate_prevalence(v) for k, v in doc.items()}
    section = out.get("phenotype")
    for trait in ("trait1", "trait2"):
        block = section.get(trait) if isinstance(section, dict) else None
        if not isinstance(block, dict) or "prevalence" not in block or block.get("model", "frailty") not in KNOWN_MODELS:
            continue
        rest = {k: v for k, v in block.items() if k != "prevalence"}
        if block.get("model", "frailty") in WITH_PREVALENCE:
            if not isinstance(rest.get("params", {}), dict):
                continue
            rest["params"] = {**rest.get("params", {}), "prevalence": block["prevalence"]}
        section[trait] = rest
    return out
