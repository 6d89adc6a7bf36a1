"""Files and workspaces: scanning, planning, recency, eviction, checks."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import filename_problem
from folio.operators.ranks import running
from folio.runtime import Scratch

#: What each extension is read as.
FORMATS = {".csv": "CSV", ".xlsx": "Excel", ".xls": "Excel", ".docx": "Word", ".pptx": "PowerPoint", ".pdf": "PDF", ".html": "HTML", ".htm": "HTML", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown"}
#: Folders that a scan leaves out, in any case.
IGNORED = [".git", "__pycache__", "node_modules", ".venv", "venv", ".idea", ".vscode", "$recycle.bin", "system volume information"]
#: The member that a packed document must have, or its beginning.
MEMBERS = {".docx": "word/document.xml", ".xlsx": "xl/", ".pptx": "ppt/"}
#: What archives may end in, and where a size is too large.
ARCHIVES = [".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".bz2"]
LARGEST = 2 * (1 << 30)
#: Exceptions and stages of work, and the code that each stands for; no stage stands for any.
CODES = [
    ("FileNotFoundError", None, "FILE_NOT_FOUND"), ("IsADirectoryError", None, "IS_DIRECTORY"), ("PermissionError", "write", "READ_ONLY_SAVE_ERROR"), ("PermissionError", None, "FILE_LOCKED"),
    ("ImportError", None, "MISSING_DEPENDENCY"), ("ModuleNotFoundError", None, "MISSING_DEPENDENCY"), ("BadZipFile", None, "CORRUPTED_STRUCTURE"), ("UnicodeDecodeError", None, "CORRUPTED_STRUCTURE"), ("ValueError", None, "CONVERSION_FAILED"),
]


def registry(spark: SparkSession, entries: dict[str, str] | None = None) -> DataFrame:
    """ext and format, one row for each extension."""
    return spark.createDataFrame(sorted((entries or FORMATS).items()), "ext string, format string")


def with_extension(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("ext", F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def readable(files: DataFrame, formats: DataFrame, path: str = "path") -> DataFrame:
    """Files with a known extension and its format, outside ignored and hidden
    folders; hidden files go too, but for .env."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda d: d.startswith(".") | d.isin(IGNORED))
    name = F.element_at(parts, -1)
    kept = with_extension(files, path).where(~hidden & (~name.startswith(".") | (name == ".env")))
    return kept.join(F.broadcast(formats), "ext")


def listing(entries: DataFrame) -> DataFrame:
    """entries (folder, name, is_dir) with their place: folders first, then by name
    in any case."""
    return running(entries, ["folder"], [F.col("is_dir").desc(), F.lower("name"), F.col("name")]).drop("ahead")


def found(entries: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Entries whose name or path has the query in it, in any case."""
    q = F.lower(F.lit(query))
    hit = entries.where(F.lower("name").contains(q) | F.lower("path").contains(q))
    return hit.orderBy("path").limit(limit) if limit else hit


def packed_or_yaml_problem(ext: Column, content: Column) -> Column:
    """What is wrong inside a packed document or a YAML file; null for none, and
    for null contents."""

    @F.pandas_udf("string")
    def look(exts: pd.Series, contents: pd.Series) -> pd.Series:
        def one(ext: str, raw: bytes | None) -> str | None:
            if raw is None:
                return None
            if ext not in MEMBERS:
                import yaml

                try:
                    yaml.safe_load(bytes(raw).decode("utf-8-sig"))
                except (yaml.YAMLError, UnicodeDecodeError):
                    return "broken"
                return None
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    names, want = z.namelist(), MEMBERS[ext]
                    if z.testzip() is not None:
                        return "broken"
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                return "broken"
            return None if (any(n.startswith(want) for n in names) if want.endswith("/") else want in names) else "member"

        return pd.Series([one(e, c) for e, c in zip(exts, contents, strict=True)])

    return look(ext, content)


def checked(files: DataFrame) -> DataFrame:
    """files (path, length, and content or head, its first 4096 bytes) with problem:
    the first check that fails, null for none. Extension and size come before the
    content, and a null size stands for a file that isn't there.

    What only the whole content tells (JSON and YAML that parse, packed documents
    that are whole and have their member) is checked where it is there; contents of
    other formats don't go through Python.
    """
    whole = "content" in files.columns
    x = with_extension(files if "head" in files.columns else files.withColumn("head", F.substring("content", 1, 4096)))
    magic, packed = F.hex(F.substring("head", 1, 8)), F.col("ext").isin(list(MEMBERS))
    # a character may be cut where the head ends
    cut = F.when(F.length("head") == 4096, F.exists(F.array(*(F.is_valid_utf8(F.substring(F.col("head"), F.lit(1), F.lit(4096 - k)).cast("string")) for k in range(4))), lambda v: v)).otherwise(F.is_valid_utf8(F.col("head").cast("string")))
    problem = (
        F.when(F.coalesce(F.trim("path"), F.lit("")) == "", "no path")
        .when(F.col("length").isNull(), "missing")
        .when(F.col("ext") == ".lnk", "shortcut")
        .when(~F.col("ext").isin(list(FORMATS)), "extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > LARGEST, "too large")
        .when((F.col("ext") == ".md") & F.hex("head").rlike("^(..)*00"), "binary")
        .when((F.col("ext") == ".md") & ~cut, "encoding")
        .when(packed & (magic == "D0CF11E0A1B11AE1"), "encrypted")
        .when(packed & ~magic.startswith("504B0304"), "not a zip")
        .when((F.col("ext") == ".xls") & (magic != "D0CF11E0A1B11AE1"), "not a workbook")
        .when((F.col("ext") == ".pdf") & ~magic.startswith("25504446"), "not a PDF")
    )
    if whole:
        text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
        problem = problem.when((F.col("ext") == ".json") & F.try_parse_json(text).isNull(), "broken")
        x = x.withColumn("_first", problem)
        deep = F.when(F.col("_first").isNull() & (packed | F.col("ext").isin(".yaml", ".yml")), F.col("content"))
        return x.withColumn("problem", F.coalesce("_first", packed_or_yaml_problem(F.col("ext"), deep))).drop("_first")
    return x.withColumn("problem", problem)


def archive_problem(files: DataFrame) -> DataFrame:
    """files (path, length, head) with problem: why an archive can't be opened for a batch."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    problem = (
        F.when(F.coalesce(F.trim("path"), F.lit("")) == "", "no path")
        .when(F.col("length").isNull(), "missing")
        .when(~ext.isin(ARCHIVES), "extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > LARGEST, "too large")
        .when((ext == ".zip") & ~F.hex(F.substring("head", 1, 4)).isin("504B0304", "504B0506"), "not a zip")
    )
    return files.withColumn("problem", problem)


def destinations(jobs: DataFrame, ext: str) -> DataFrame:
    """jobs (scan_no, path) with their output path, no two alike: where several
    share a name, one that has the target format keeps it and the others are told
    apart by their own extension and a number, in the order of the scan."""
    x = with_extension(jobs).withColumns({"base": F.regexp_replace("path", r"\.[^./]*$", ""), "same": F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)) == ext})
    x = x.withColumns({"shared": F.count("*").over(W.partitionBy("base")) > 1, "k": F.row_number().over(W.partitionBy("base", "ext").orderBy("scan_no")) - F.when(F.col("same"), 2).otherwise(1)})
    kind = F.substring("ext", 2, 1 << 20)
    tail = F.when(~F.col("shared") | (F.col("k") < 0), "").when(F.col("k") == 0, F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(F.concat(F.lit(" ("), kind, F.lit("_"), F.col("k").cast("string"), F.lit(")")))
    return x.select("scan_no", "path", F.concat("base", tail, F.lit(ext)).alias("output"))


def rollup(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a batch: counts by status and the time taken."""
    return results.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum("duration").alias("duration"))


def error_list(results: DataFrame) -> DataFrame:
    """file (its name) and error of the failed results of a batch: rows, as there may be many."""
    return results.where("status = 'failed'").select(*(c for c in results.columns if c not in ("path", "status", "error", "duration")), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "error")


def recent(events: DataFrame, cap: int = 20) -> DataFrame:
    """The recent-items list of each owner: one row for each item with its latest
    opening, pinned ones first, then the latest, up to the cap. events: owner,
    item, at, mode, pinned. A blank mode keeps the one before, and a pin stays."""
    mode = F.max_by("mode", F.when(F.coalesce(F.trim("mode"), F.lit("")) != "", F.col("at")))
    one = events.groupBy("owner", "item").agg(F.max("at").alias("at"), F.bool_or("pinned").alias("pinned"), mode.alias("mode"))
    place = F.row_number().over(W.partitionBy("owner").orderBy(F.col("pinned").desc(), F.col("at").desc(), "item"))
    return one.withColumn("place", place).where(F.col("place") <= cap)


def evicted(sessions: DataFrame, most: int, by: str = "store") -> DataFrame:
    """Sessions (session, mtime, size, protected) that go, oldest first, until the
    rest of their store fits into ``most`` bytes; protected ones are passed over."""
    total = sessions.groupBy(F.col(by).alias("_store")).agg(F.sum("size").alias("total"))
    open_ = running(sessions.where(~F.col("protected")), [by], ["mtime", "session"], F.col("size"))
    gone = open_.join(total, F.col(by).eqNullSafe(F.col("_store")))
    return gone.where(F.col("total") - F.col("ahead") > most).select(by, "session", "mtime", "size", F.col("ahead").alias("gone_before"))


def outdated(sessions: DataFrame, now: Column, age: int = 7 * 24 * 3600) -> DataFrame:
    """Sessions (mtime in seconds, protected) that are older than the age; protected ones stay."""
    return sessions.where(~F.col("protected") & (now - F.col("mtime") > age))


def first_copies(assets: DataFrame, key: str, order: str) -> DataFrame:
    """Assets (content) with their digest, and whether another one of the key with
    the same content comes first; first is that one's order. The minima are written
    first, so that the join is between two plain tables, which can be split where
    one content has very many copies."""
    x = assets.withColumn("digest", F.md5(F.col("content").cast("binary")))
    one = Scratch(assets.sparkSession, "copies").save(x.groupBy(key, "digest").agg(F.min(order).alias("first")), "first")
    return x.join(one, [key, "digest"]).withColumn("is_copy", F.col(order) != F.col("first"))


def renamed(tabs: DataFrame, old: str, new: str) -> DataFrame:
    """Paths after a file or a folder has been renamed."""
    hit = (F.col("path") == old) | F.col("path").startswith(f"{old}/")
    return tabs.withColumn("path", F.when(hit, F.concat(F.lit(new), F.substring(F.col("path"), len(old) + 1, 1 << 20))).otherwise(F.col("path")))


def deleted(tabs: DataFrame, path: str) -> DataFrame:
    """Tabs after a file or a folder has gone: changed ones lose their path, the
    others go as well."""
    hit = (F.col("path") == path) | F.col("path").startswith(f"{path}/")
    return tabs.where(~hit | F.col("dirty")).withColumn("path", F.when(~hit, F.col("path")))


def move_problem(source: Column, folder: Column) -> Column:
    """Why a file or folder can't be moved into a folder, as far as the paths tell."""
    parent = F.regexp_replace(source, r"/?[^/]*$", "")
    return F.when(source == folder, "same").when(parent == folder, "already there").when(folder.startswith(F.concat(source, F.lit("/"))), "circular").when(filename_problem(F.regexp_extract(source, r"([^/]*)$", 1)).isNotNull(), "name")


def moves_checked(moves: DataFrame, held: DataFrame) -> DataFrame:
    """moves (source, folder) with problem: the first of missing (the source isn't
    there), folder (no folder of that name), same, already there, circular, and
    collision (the folder holds that name). held: path, is_dir of all that is there."""
    own = held.select(F.col("path").alias("source"), F.lit(True).alias("_there")).distinct()
    into = held.where("is_dir").select(F.col("path").alias("folder"), F.lit(True).alias("_folder")).distinct()
    at = held.select(F.col("path").alias("_target"), F.lit(True).alias("_taken")).distinct()
    x = moves.withColumn("_target", F.concat("folder", F.lit("/"), F.regexp_extract("source", r"([^/]*)$", 1)))
    x = x.join(own, "source", "left").join(into, "folder", "left").join(at, "_target", "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(F.col("_folder").isNull(), "folder").otherwise(F.coalesce(F.nullif(move_problem(F.col("source"), F.col("folder")), F.lit("name")), F.when(F.col("_taken"), "collision")))
    return x.withColumn("problem", problem).select(*moves.columns, "problem")


def unique_names(files: DataFrame) -> DataFrame:
    """files (scan_no, name) with names made unique: the first of a name keeps it,
    the others get the next number before the extension that no name has."""
    x = running(files, ["name"], ["scan_no"]).withColumn("n", F.col("place") - 1).drop("place", "ahead")
    parts = r"^(.*?)(?:_([1-9][0-9]{0,8}))?(\.[^.]*)?$"
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    # numbers that are names already, each less the ones before it: so many are passed over
    taken = files.select("name").distinct().select(F.regexp_extract("name", parts, 1).alias("_stem"), F.regexp_extract("name", parts, 2).try_cast("int").alias("_k"), F.regexp_extract("name", parts, 3).alias("_ext")).where("_k is not null")
    taken = taken.groupBy("_stem", "_ext").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    taken = taken.withColumn("_taken", F.transform("_taken", lambda k, i: k - i))
    x = x.withColumns({"_s": stem, "_e": ext}).join(taken, (F.col("_s") == F.col("_stem")) & (F.col("_e") == F.col("_ext")), "left")
    number = F.col("n") + F.coalesce(F.size(F.filter("_taken", lambda k: k <= F.col("n"))), F.lit(0))
    made = F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("_s", F.lit("_"), number.cast("string"), "_e"))
    return x.select(*files.columns, made.alias("unique"))


def installed(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Models all of whose files are there, not empty and with the right digest.
    required: model, file, sha256; actual: model, file, size, sha256."""
    a = actual.select("model", "file", "size", F.col("sha256").alias("found"))
    x = required.join(a, ["model", "file"], "left")
    return x.groupBy("model").agg(F.bool_and(F.coalesce((F.col("size") > 0) & (F.col("found") == F.col("sha256")), F.lit(False))).alias("installed"), F.count("*").alias("n_files"))


def recommended(machines: DataFrame) -> DataFrame:
    """machines (ram_total_gb, ram_free_gb, cores, cuda, vram_total_mb, vram_free_mb)
    with the speech model that suits them and the device it runs on. Fixed values:
    the thresholds. A processor alone never gets more than the small model."""
    vram = F.greatest(F.col("vram_free_mb"), F.col("vram_total_mb") * 0.7)
    by_card = F.when(vram >= 5500, "whisper-large-v3").when(vram >= 3000, "whisper-medium").when(vram >= 1500, "whisper-small").otherwise("whisper-base")
    by_cpu = F.when((F.bround("ram_total_gb") >= 7) & (F.col("cores") >= 4) & (F.col("ram_free_gb") >= 2), "whisper-small").otherwise("whisper-base")
    on_card = F.col("cuda") & (F.col("vram_free_mb") >= 1000)
    return machines.withColumns({"model": F.when(F.col("cuda"), by_card).otherwise(by_cpu), "device": F.when(on_card, "cuda").otherwise("cpu"), "precision": F.when(on_card, "float16").otherwise("int8")})


def localised(keys: DataFrame, strings: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """keys (key) with text: in the locale, else in the fallback, else the key."""
    of = lambda l, name: strings.where(F.col("locale") == l).select("key", F.col("text").alias(name))  # noqa: E731, E741
    return keys.join(of(locale, "_own"), "key", "left").join(of(fallback, "_other"), "key", "left").select("key", F.coalesce("_own", "_other", "key").alias("text"))


def resolved(links: DataFrame, assets: DataFrame, order: list[str]) -> DataFrame:
    """links (link_id, uri) with the asset that they mean: by the whole path, then
    the name in the document's folder, then the name alone - whichever of the
    ``order``'s kinds hits first. assets: kind, uri, path."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(order)))
    best = links.join(assets, "uri").groupBy("link_id").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))
    return links.join(best, "link_id", "left")


def jobs_state(events: DataFrame) -> DataFrame:
    """Where each job stands: events (job_id, at, status, progress) to the last
    status, the highest progress, and whether it has ended."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("progress").alias("progress"), F.min("at").alias("created_at")).withColumn("ended", F.col("status").isin("COMPLETED", "FAILED", "CANCELLED"))


def latest_generation(results: DataFrame) -> DataFrame:
    """Results of each document's latest load; those of earlier loads are stale."""
    last = results.groupBy("doc_id").agg(F.max("generation").alias("generation"))
    return results.join(last, ["doc_id", "generation"], "left_semi")


def error_codes(errors: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """errors (exception, stage) with the code of the mapping, CODES if none is given:
    for the stage, else for any stage, else UNKNOWN_ERROR."""
    mapping = mapping or errors.sparkSession.createDataFrame(CODES, "exception string, stage string, code string")
    own = mapping.where("stage is not null").select("exception", "stage", F.col("code").alias("_own"))
    any_ = mapping.where("stage is null").select("exception", F.col("code").alias("_any"))
    return errors.join(F.broadcast(own), ["exception", "stage"], "left").join(F.broadcast(any_), "exception", "left").withColumn("code", F.coalesce("_own", "_any", F.lit("UNKNOWN_ERROR"))).drop("_own", "_any")
