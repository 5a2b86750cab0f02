"""Readers and writers of records kept as files, and of documents.

YAML, PDF, file drives and language models are outside the engine. They come
in as callables; where a library is missing the reader says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.operators import lifecycle


def yaml_loader() -> Callable[[str], object]:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML; pass load= to use another parser") from e
    return yaml.safe_load


def read_records(spark: SparkSession, root: str, schema: T.StructType, load: Callable[[str], object] | None = None, pattern: str = "*.yaml", recursive: bool = True) -> DataFrame:
    """One record a file: the columns of ``schema``, ``path`` and ``extra`` (keys outside the schema). Empty files and names with a leading _ are left out."""
    parse = load or yaml_loader()
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    known = set(schema.fieldNames())

    def run(batches):
        for b in batches:
            rows = [(p, parse(v)) for p, v in zip(b["path"], b["value"])]
            rows = [(p, d) for p, d in rows if isinstance(d, dict) and d]
            yield pd.DataFrame({"path": [p for p, _ in rows], "record": [json.dumps(d, ensure_ascii=False, default=str) for _, d in rows], "extra": [json.dumps(sorted(set(d) - known)) for _, d in rows]})

    parsed = files.mapInPandas(run, "path string, record string, extra string")
    return parsed.select("path", F.from_json("record", schema).alias("r"), F.from_json("extra", "array<string>").alias("extra")).select("path", "r.*", "extra")


def path_order(path: str = "path") -> Column:
    """Order of paths by their parts, not as plain strings."""
    return F.split(path, "/")


def read_documents(spark: SparkSession, root: str, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, kind, text) of Markdown and PDF files. Any other ending is an error when it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ending.isin("md", "markdown"), "markdown").when(ending == "pdf", "pdf").otherwise(F.raise_error(F.concat(F.lit("no parser for "), F.col("path"))))

    def run(batches):
        for b in batches:
            if (b["kind"] == "pdf").any() and pdf_text is None:
                raise ValueError("reading PDF needs pdf_text=")
            texts = [pdf_text(c) if k == "pdf" else bytes(c).decode("utf-8") for k, c in zip(b["kind"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "text": texts})

    return files.select("path", kind.alias("kind"), "content").mapInPandas(run, "path string, kind string, text string")


def folder_id(url: Column) -> Column:
    """The id in a folder address; an error if there is none."""
    found = F.regexp_extract(url, r"/folders/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no folder id in "), url)))


def listing(spark: SparkSession, fetch: Callable[[str], list[dict]], folder: str) -> DataFrame:
    """(file_id, name, mime_type, modified_at) from an injected service, by name: PDF files and office documents only."""
    wanted = ("application/pdf", "application/vnd.google-apps.document")
    rows = [(f["id"], f["name"], f["mimeType"], f.get("modifiedTime")) for f in fetch(folder) if f["mimeType"] in wanted and not f.get("trashed")]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "file_id string, name string, mime_type string, modified_at string")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w.\- ]", "_")


def versions_of(registry: DataFrame) -> DataFrame:
    """(doc_id, version, file, supersedes) from records (doc_id, versions: array of structs)."""
    return registry.select("doc_id", F.explode("versions").alias("v")).select("doc_id", "v.*")


def add_version(versions: DataFrame, doc_id: str, version: str, file: str, supersedes: str | None = None) -> DataFrame:
    """The registry with one more version. Unknown documents and repeated versions are errors."""
    known = versions.where(F.col("doc_id") == doc_id).agg(F.count("*"), F.count_if(F.col("version") == version)).first()
    if not known[0]:
        raise KeyError(doc_id)
    if known[1]:
        raise ValueError(f"{doc_id} {version} is registered")
    new = versions.sparkSession.createDataFrame([(doc_id, version, file, supersedes)], "doc_id string, version string, file string, supersedes string")
    return versions.unionByName(new, allowMissingColumns=True)


def register_source(versions: DataFrame, doc_id: str, version: str, file: str, authority: str, levels: list[str], confirm: Callable[[dict], bool] | None = None) -> DataFrame:
    """The registry with a new document, if its authority is a level, it is new and ``confirm`` agrees."""
    if authority not in levels:
        raise ValueError(f"{authority} is no authority level")
    if versions.where(F.col("doc_id") == doc_id).head(1):
        raise ValueError(f"{doc_id} is registered")
    if confirm and not confirm({"doc_id": doc_id, "version": version, "file": file}):
        return versions
    new = versions.sparkSession.createDataFrame([(doc_id, version, file, authority)], "doc_id string, version string, file string, authority_level string")
    return versions.unionByName(new, allowMissingColumns=True)


def note_once(notes: Column, mark: Column) -> Column:
    return F.when(F.coalesce(F.contains(notes, mark), F.lit(False)), notes).otherwise(F.concat_ws("\n", notes, mark))


def required(config: dict, keys: list[str]) -> dict:
    """A configuration with all keys, or an error that names those it lacks."""
    if missing := [k for k in keys if not config.get(k)]:
        raise ValueError("missing " + ", ".join(missing))
    return config


def entries(config: dict, name: str, keys: list[str]) -> list[dict]:
    """The list ``name`` of a batch or sync configuration; not there, no list, empty, or an entry without a key are errors."""
    if not isinstance(config, dict) or name not in config:
        raise ValueError(f"the configuration has no {name!r}")
    if not isinstance(config[name], list) or not config[name]:
        raise ValueError(f"{name!r} must be a list with entries")
    for i, entry in enumerate(config[name]):
        if not isinstance(entry, dict):
            raise ValueError(f"entry {i} must be a mapping")
        try:
            required(entry, keys)
        except ValueError as e:
            raise ValueError(f"entry {i} ({entry.get('doc_id', '?')}): {e}") from e
    return config[name]


def ranked(records: DataFrame, items: str, by: str = "domain", name: str = "level") -> DataFrame:
    """(domain, level, rank): a list of each record as rows, ranked from 0 in its order; records without one have none."""
    return records.select(by, F.posexplode(items).alias("rank", name)).select(by, name, "rank")


def sync_plan(found: DataFrame, manifest: DataFrame, registry: DataFrame, doc_id: str, export: str = "pdf", force: bool = False, dry_run: bool = False) -> DataFrame:
    """(file_id, name, action, target, note, register) for each file of a listing (file_id, name, mime_type, modified_at).

    action: 'download' for new and modified files, 'keep' for others, 'list'
    throughout in a dry run. target is a safe local name with the ending of the
    export format; note is the mark to keep with the source; register says
    that the document is not in the registry yet.
    """
    if export not in ("pdf", "md"):
        raise ValueError(f"{export} is no export format")
    changed = lifecycle.changed_files(found, manifest.select("file_id", "modified_at"), force).select("file_id", F.lit(True).alias("_changed"))
    base = safe_name(F.regexp_replace("name", r"\.[^.]+$", ""))
    ending = F.when(F.col("mime_type") == "application/pdf", "pdf").otherwise(export)
    there = registry.where(F.col("doc_id") == doc_id).agg(F.count("*").alias("_n"))  # one row
    met = found.join(changed, "file_id", "left").crossJoin(there)
    action = F.lit("list") if dry_run else F.when(F.col("_changed"), "download").otherwise("keep")
    return met.select("file_id", "name", action.alias("action"), F.concat_ws(".", base, ending).alias("target"), F.concat(F.lit("file_id: "), "file_id").alias("note"), (F.col("_n") == 0).alias("register"))


def download(plan: DataFrame, fetch: Callable[[str, str], bytes]) -> DataFrame:
    """(file_id, target, content, error) of the files to download. ``fetch`` (file_id, target) runs on the executors; its errors stay with the file."""

    def run(batches):
        for b in batches:
            got, why = [], []
            for f, t in zip(b["file_id"], b["target"]):
                try:
                    got.append(fetch(f, t))
                    why.append(None)
                except Exception as e:  # noqa: BLE001 - one file's error stops no other
                    got.append(None)
                    why.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"file_id": b["file_id"], "target": b["target"], "content": got, "error": why})

    return plan.where("action = 'download'").select("file_id", "target").mapInPandas(run, "file_id string, target string, content binary, error string")


def save_manifest(manifest: DataFrame, downloaded: DataFrame, found: DataFrame, path: str) -> None:
    """Writes (file_id, modified_at) with the states of what was downloaded without error. The manifest lies in a folder a run; the last run's is read."""
    taken = found.join(downloaded.where("error IS NULL").select("file_id"), "file_id", "left_semi").select("file_id", "modified_at")
    manifest.select("file_id", "modified_at").join(taken, "file_id", "left_anti").unionByName(taken).coalesce(1).write.parquet(path)
