"""File sources, by format and storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pipekit.session import fresh_path

# Storage names and file suffixes.
STORAGE_SCHEMES = {"local": "file", "s3": "s3a", "hdfs": "hdfs", "gcs": "gs"}
SUFFIX_FORMATS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
    ".xml": "xml",
    ".parquet": "parquet",
}
FORMATS = ("csv", "json", "xml", "parquet")
COMPRESSIONS = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")

CORRUPT = "_corrupt_record"


def storage_uri(path: str, storage: str | None = None) -> str:
    """`path` with the URI scheme of `storage`.

    A path that has a scheme keeps it; without `storage` the session's default file system is
    meant, which on a cluster is the shared one.
    """
    if storage is None or "://" in path or path.startswith("file:"):
        return path
    if storage not in STORAGE_SCHEMES:
        raise ValueError(f"storage must be one of {sorted(STORAGE_SCHEMES)}, not {storage!r}")
    scheme = STORAGE_SCHEMES[storage]
    if storage in ("local", "hdfs"):
        if not path.startswith("/"):
            raise ValueError(f"a {storage} path must be absolute or a URI: {path!r}")
        return f"{scheme}://{path}"
    return f"{scheme}://{path.lstrip('/')}"


def detect_format(spark: SparkSession, uri: str) -> str:
    """The format by suffix: of the path itself, else of the files below it.

    Several formats, none or an unknown one are errors. File names are reduced to their
    distinct suffixes by the executors.
    """
    suffixes = {_suffix(uri)} if _suffix(uri) in SUFFIX_FORMATS else None
    if suffixes is None:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
        bare = F.col("path")
        for ending in COMPRESSIONS:
            bare = F.regexp_replace(bare, rf"\{ending}$", "")
        found = listing.select(F.lower(F.regexp_extract(bare, r"(\.[A-Za-z0-9]+)$", 1)).alias("s"))
        suffixes = {row.s for row in found.distinct().limit(len(SUFFIX_FORMATS) + 1).collect()}
    formats = {SUFFIX_FORMATS.get(s) for s in suffixes}
    if len(formats) != 1 or None in formats:
        raise ValueError(f"cannot tell one format from the suffixes {sorted(suffixes)} at {uri}")
    return formats.pop()


def _suffix(uri: str) -> str:
    path = PurePosixPath(uri)
    return (PurePosixPath(path.stem) if path.suffix in COMPRESSIONS else path).suffix.lower()


def read_files(
    spark: SparkSession,
    path: str,
    storage: str | None = None,
    fmt: str = "auto",
    infer: bool = True,
    sample_rows: int | None = None,
    schema: T.StructType | str | None = None,
    bad_rows: str = "fail",
    multiline: bool | None = False,
    row_tag: str = "row",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a file or folder of `csv`, `json`, `xml` or `parquet`.

    Types are inferred from everything read, or from the first `sample_rows` lines (of CSV and
    JSON lines), or not at all (`infer=False`: text columns), unless `schema` is given. `bad_rows` says what becomes of
    a record that does not fit: `fail`, `keep` (with its text in `_corrupt_record`) or `null` (its
    bad fields are lost).

    A line is a record. `multiline=True` lets a CSV field or a JSON document span lines, which
    makes each file one task; CSV fields with line breaks need it. `multiline=None` reads JSON
    files that begin with `[` as documents and the others by lines, file by file, which costs a
    pass over the text.
    """
    uri = storage_uri(path, storage)
    if fmt == "auto":
        fmt = detect_format(spark, uri)
    if fmt not in FORMATS:
        raise ValueError(f"format must be 'auto' or one of {list(FORMATS)}, not {fmt!r}")
    if fmt == "parquet":
        reader = spark.read.options(**(options or {}))
        return (reader.schema(schema) if schema else reader).parquet(uri)

    settings = {**_text_options(fmt, bad_rows, row_tag), **(options or {})}
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def read(paths: list[str], whole: bool) -> DataFrame:
        own = settings if fmt == "xml" else {**settings, "multiLine": str(whole).lower()}
        found = schema or _inferred(spark, paths, fmt, own, infer, sample_rows)
        if bad_rows == "keep" and CORRUPT not in found.names:
            found = T.StructType([*found.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.read.format(fmt).options(**own).schema(found).load(paths)

    if fmt != "json" or multiline is not None:
        return read([uri], bool(multiline))
    documents, lines = _split_by_start(spark, uri, settings)
    parts = [read(paths, whole) for paths, whole in ((documents, True), (lines, False)) if paths]
    if not parts:
        return read([uri], False)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _text_options(fmt: str, bad_rows: str, row_tag: str) -> dict[str, str]:
    modes = {"null": "PERMISSIVE", "keep": "PERMISSIVE", "fail": "FAILFAST"}
    if bad_rows not in modes:
        raise ValueError(f"bad_rows must be one of {sorted(modes)}, not {bad_rows!r}")
    settings = {"mode": modes[bad_rows]}
    if bad_rows == "keep":
        settings["columnNameOfCorruptRecord"] = CORRUPT
    if fmt == "csv":
        # A quote inside a quoted field is doubled, and an empty cell is null.
        settings |= {"header": "true", "escape": '"'}
    elif fmt == "xml":
        settings["rowTag"] = row_tag
    return settings


def _split_by_start(spark: SparkSession, uri: str, settings: Mapping[str, str]) -> tuple[list[str], list[str]]:
    """The files below `uri` whose first character is a bracket, and the others."""
    lines = spark.read.options(**_listing(settings)).text(uri)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.ltrim("value").alias("text"),
    )
    first = F.min_by(F.substring("text", 1, 1), "at").alias("first")
    found = lines.where("text <> ''").groupBy("file").agg(first).collect()
    return [r.file for r in found if r.first == "["], [r.file for r in found if r.first != "["]


def _inferred(
    spark: SparkSession, paths: list[str], fmt: str, settings: Mapping[str, str], infer: bool, sample_rows: int | None
) -> T.StructType:
    reader = spark.read.format(fmt).options(**settings)
    if not infer:
        all_text = {"inferSchema": "false"} if fmt == "csv" else {"primitivesAsString": "true"}
        return reader.options(**all_text).load(paths).schema
    if sample_rows is not None and fmt in ("csv", "json") and settings["multiLine"] == "false":
        # A small copy of the first lines, so that the reader itself infers from them alone.
        sample = fresh_path(spark, "sample")
        headed = fmt == "csv" and str(settings.get("header", "false")).lower() == "true"
        spark.read.options(**_listing(settings)).text(paths).limit(sample_rows + headed).coalesce(1).write.text(sample)
        own = {k: v for k, v in settings.items() if k not in _listing(settings)}
        found = spark.read.format(fmt).options(**own).option("inferSchema", "true").load(sample).schema
        # Columns that the paths name, such as partition folders, are not in the lines.
        named_by_paths = [f for f in reader.load(paths).schema if f.name not in found.names] if fmt == "csv" else []
        return T.StructType([*found.fields, *named_by_paths])
    return reader.option("inferSchema", "true").load(paths).schema


def _listing(settings: Mapping[str, str]) -> dict[str, str]:
    """The options that say which files to read."""
    return {k: v for k, v in settings.items() if k in ("pathGlobFilter", "recursiveFileLookup", "basePath")}


def bulk_import(
    spark: SparkSession,
    bucket: str,
    prefix: str = "",
    glob: str = "**/*",
    storage: str | None = "s3",
    partition_by: Sequence[str] = (),
    fmt: str = "auto",
    source_file: bool = False,
    **read_options,
) -> DataFrame:
    """Read many files below `bucket/prefix` as one table.

    `**/name-glob` searches every folder level; another glob is relative to the prefix. With
    `partition_by` the folders `column=value` become columns, and must be there. `source_file`
    adds the file each row came from.
    """
    root = storage_uri("/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate((bucket, prefix)) if p), storage)
    folder, _, name = glob.rpartition("/")
    if "**" in folder.removesuffix("**"):
        raise ValueError(f"'**' must be the last folder of a glob, not {glob!r}")
    options = dict(read_options.pop("options", {}))
    if name not in ("", "*"):
        options["pathGlobFilter"] = name
    path = root
    if folder not in ("", "**"):
        path = f"{root}/{folder.removesuffix('/**')}"
    if partition_by:
        options["basePath"] = root
    elif folder.endswith("**"):
        options["recursiveFileLookup"] = "true"
    if fmt == "auto":
        fmt = SUFFIX_FORMATS.get(_suffix(name)) or detect_format(spark, path)
    df = read_files(spark, path, storage, fmt, options=options, **read_options)
    missing = [c for c in partition_by if c not in df.columns]
    if missing:
        raise ValueError(f"no partition folders for {missing} below {root}")
    return df.withColumn("source_file", F.col("_metadata.file_path")) if source_file else df


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself, or an error if it has no rows. Reads until it finds one."""
    if df.isEmpty():
        raise ValueError("the source has no rows")
    return df
