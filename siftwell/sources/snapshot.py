"""Named, versioned snapshots: Parquet of the documents, deltas, and a JSON manifest that is put in place last.

<root>/<name>/ holds folders that are one writer's alone (docs, a whole version; or rows and ids, the rows that a batch wrote and the ids that it touched), and
manifest/<n>.json, which names the base and the deltas of version n. A manifest is renamed into place and never over another: of two writers one
gets the number and the other goes on to the next. The greatest manifest counts, so a reader never sees half a version. Everything goes through Spark's own file systems.

A base of records is described file by file (segments): searches of a restored index open only files that can hold a match, and checksums are kept a file.
Restoring reads the manifest and the list of files; what a page holds is checked against its checksum when a search reads it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from typing import TYPE_CHECKING, Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.errors import ConflictError, IncompatibleHookError, IncompatibleIndexError, ProfileMismatchError
from siftwell.functions.checksum import table_sum
from siftwell.plans.schema import IndexSchema, hook_id
from siftwell.sources import prefixes, segments
from siftwell.streaming.mutate import COMPACT, Version, last_of

if TYPE_CHECKING:
    from siftwell.index import DocumentIndex

FORMAT = 2
#: Snapshots of this format have a manifest in a folder of its number, no checksums and no deltas; they are read, not written.
OLDER = 1
#: What a manifest may hold at most; one beyond is damaged or not ours.
MAX_MANIFEST, MAX_DELTAS, MAX_FIELDS, MAX_COUNT = 1 << 20, 10_000, 4096, 1 << 53
_VERSION = "_version"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or name.startswith("."):
        raise ValueError("a snapshot's name is of letters, digits, '.', '_' and '-'")
    return name


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    p, fs = _path(spark, f"{root}/{_checked(name)}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    older = [int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/manifest/{n}/_SUCCESS"))]
    return sorted(older + [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()])


def _own_sum(manifest: dict) -> int:
    return zlib.crc32(json.dumps({k: v for k, v in manifest.items() if k != "crc32"}, sort_keys=True).encode())


def _publish(spark: SparkSession, root: str, name: str, manifest: dict) -> bool:
    """Puts a manifest in place by renaming, which fails if another writer has taken its number."""
    fs, at = _path(spark, root)[1], f"{root}/{name}/manifest"
    part, target = (_path(spark, f"{at}/{x}")[0] for x in (f".{uuid.uuid4().hex}.part", f"{manifest['version']}.json"))
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({**manifest, "crc32": _own_sum(manifest)}, sort_keys=True).encode()))
    out.close()
    try:
        done = not fs.exists(target) and bool(fs.rename(part, target))
    except Py4JJavaError as e:
        if "exist" not in str(e.java_exception).lower():
            raise
        done = False
    if not done:
        fs.delete(part, False)
    return done


def _written(df: DataFrame, folder: str) -> dict[str, Any]:
    """Writes a small table, with a checksum a page; what its manifest says of it."""
    at, _, table = folder.rpartition("/")
    df.write.mode("overwrite").parquet(folder)
    n, crc = table_sum(df.sparkSession.read.schema(df.schema).parquet(folder))
    files, size = segments.sized(df.sparkSession, at, table)
    return {"rows": n, "crc32_sum": crc, "files": files, "bytes": size, "columns": df.schema.json()}


def _described(df: DataFrame, folder: str, schema: IndexSchema) -> dict[str, Any]:
    """Writes folder/docs and the descriptions of its files; what its manifest says of it."""
    df.write.mode("overwrite").parquet(f"{folder}/docs")
    about = segments.describe(df.sparkSession, folder, df, schema)
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/docs")
    prefixed = prefixes.describe(schema.prepare(rows.select("*", F.col("_metadata.file_name").alias("_stored_file"))), folder, schema)
    return {**about, "columns": df.schema.json(), "described": True, "prefixes": prefixed}


def save(index: DocumentIndex, root: str, name: str, decoupled: bool = False, files: int | None = None, cluster: list[str] | None = None, **more: Any) -> int:
    """Writes a whole new version and returns its number.

    decoupled: the records stay out, only ids and versions are kept. cluster: filter fields along whose Z curve the records are laid, so that filters on them open few files;
    files: into how many (as Spark deals them if None).
    """
    spark = index.docs.sparkSession
    n, folder = max(versions(spark, root, _checked(name)), default=0) + 1, _folder()
    docs = index.docs.withColumnRenamed(index.version.version, _VERSION) if index.version.version == _VERSION else index.records().withColumn(_VERSION, F.lit(0))
    if decoupled:
        about = _written(docs.select(index.schema.id, _VERSION), f"{root}/{name}/{folder}/docs")
    else:
        docs = segments.clustered(docs, index.schema, cluster, files) if cluster else docs.repartition(files) if files else docs
        about = _described(docs, f"{root}/{name}/{folder}", index.schema)
    said = {"format": FORMAT, "version": n, "base": folder, "documents": about["rows"], "about": about, "deltas": [], "decoupled": decoupled, "epoch": index.epoch, "schema": index.schema.manifest(), "cluster": cluster or [], **more}
    while not _publish(spark, root, name, said):
        said["version"] += 1
    return said["version"]


def _folder() -> str:
    return f"v-{uuid.uuid4().hex}"


def append(rows: DataFrame, root: str, name: str, schema: IndexSchema, removed: DataFrame | None = None, since: int | None = None, **more: Any) -> int:
    """A new version in which rows (repeated ids: the last, see last_of) replace or join the saved ones and removed ids go. Costs what the batch is: the base stays unread.

    When the rows of all deltas reach COMPACT of the base's, the version is written whole instead. Writers need no lock: whoever comes second goes on upon what the first has
    written. since: the version that the batch was made upon; if a later one touches any of its ids, or was saved whole, it is refused (ConflictError).
    """
    while (n := _append(rows, root, name, schema, removed, since, more)) is None:
        pass  # another writer was first: again, upon what it wrote
    return n


def touched_since(spark: SparkSession, root: str, name: str, since: int, last: int, schema: IndexSchema) -> DataFrame | None:
    """The ids that versions after since, up to last, have touched; None if one of them was saved whole."""
    before, out = manifest(spark, root, name, since), None
    known = {before["base"], *(d["folder"] for d in before["deltas"])}
    for v in (v for v in versions(spark, root, name) if since < v <= last):
        said = manifest(spark, root, name, v)
        for folder in [d["folder"] for d in said["deltas"]] or [said["base"]]:
            if folder not in known:
                known.add(folder)
                path, fs = _path(spark, f"{root}/{name}/{folder}/ids")
                if not fs.exists(path):
                    return None
                ids = spark.read.parquet(f"{root}/{name}/{folder}/ids").select(schema.id)
                out = ids if out is None else out.union(ids)
    return spark.read.parquet(f"{root}/{name}/{before['base']}/docs").select(schema.id).filter(F.lit(False)) if out is None else out


def _unchanged(rows: DataFrame, removed: DataFrame | None, root: str, name: str, schema: IndexSchema, since: int, last: int) -> None:
    """Refuses a batch some of whose ids were touched after since. Batches' ids meet, no records."""
    own = rows.select(schema.id) if removed is None else rows.select(schema.id).union(removed.toDF(schema.id))
    touched = touched_since(rows.sparkSession, root, name, since, last, schema)
    if touched is None:
        raise ConflictError(since, last, None)
    if (met := own.join(touched, schema.id, "left_semi").first()) is not None:
        raise ConflictError(since, last, met[0])


def _append(rows: DataFrame, root: str, name: str, schema: IndexSchema, removed: DataFrame | None, since: int | None, more: dict) -> int | None:
    spark = rows.sparkSession
    said = manifest(spark, root, name)
    if since is not None and said["version"] > since:
        _unchanged(rows, removed, root, name, schema, since, said["version"])
    _same(said["schema"], schema)
    if said["decoupled"]:
        raise IncompatibleIndexError("a snapshot with its records", "a decoupled one")
    n, epoch = said["version"] + 1, said["epoch"] + 1
    plain = [c for c in spark.read.parquet(f"{root}/{name}/{said['base']}/docs").columns if c != _VERSION]
    if set(rows.columns) - {"_order"} != set(plain):
        raise IncompatibleIndexError(sorted(plain), sorted(rows.columns))
    own = _folder()
    folder = f"{root}/{name}/{own}"
    about = _written(last_of(rows, schema.id, plain).withColumn(_VERSION, F.lit(epoch)), f"{folder}/rows")
    ids = spark.read.parquet(f"{folder}/rows").select(schema.id)
    if removed is not None:
        ids = ids.union(removed.toDF(schema.id)).distinct()
    touched = _written(ids.withColumn("_number", F.lit(epoch)), f"{folder}/ids")
    deltas = [*said["deltas"], {"folder": own, "epoch": epoch, "about": about, "touched": touched}]
    after = {**said, "version": n, "deltas": deltas, "epoch": epoch, "documents": None, **more}
    if sum(d["touched"]["rows"] for d in deltas) >= COMPACT * max(1, said["about"]["rows"]):
        whole, cluster = _read(spark, root, name, after, schema.id).docs(), said.get("cluster")
        about = _described(segments.clustered(whole, schema, cluster, None) if cluster else whole, folder, schema)
        after |= {"base": own, "deltas": [], "documents": about["rows"], "about": about}
    return n if _publish(spark, root, name, after) else None


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text, read by the driver; of a folder (an older manifest), its one part."""
    p, fs = _path(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return spark.read.text(path, wholetext=True).first()[0]
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, name: str, version: int | None = None) -> dict:
    known = versions(spark, root, name)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no snapshot {name!r} in {root}")
    path = f"{root}/{name}/manifest/{version or known[-1]}"
    p, fs = _path(spark, path + ".json")
    path = path + ".json" if fs.exists(p) else path
    if (size := fs.getContentSummary(_path(spark, path)[0]).getLength()) > MAX_MANIFEST:
        raise IncompatibleIndexError(f"a manifest of at most {MAX_MANIFEST} bytes", size)
    try:
        out = json.loads(_text(spark, path))
    except (ValueError, TypeError) as e:
        raise IncompatibleIndexError("a manifest", "no JSON") from e
    if isinstance(out, dict) and out.get("format") == OLDER:
        out = {**out, "format": FORMAT, "base": f"v-{out.get('version')}", "deltas": [], "about": {"rows": out.get("documents"), "crc32_sum": None}}
    return sane(out)


def sane(said: Any) -> dict:
    """A manifest whose parts are of the kinds and within the bounds that save() keeps."""
    if not isinstance(said, dict) or said.get("format") != FORMAT:
        raise IncompatibleIndexError(FORMAT, said.get("format") if isinstance(said, dict) else said)

    def count(x: Any) -> bool:
        return isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= MAX_COUNT

    def folder(x: Any) -> bool:
        return isinstance(x, str) and re.fullmatch("v-[0-9a-f]+", x) is not None

    def about(x: Any) -> bool:
        return isinstance(x, dict) and count(x.get("rows")) and isinstance(x.get("crc32_sum"), int | None) and all(x.get(k) is None or count(x[k]) for k in ("files", "bytes")) and isinstance(x.get("columns"), str | None)

    deltas, schema = said.get("deltas"), said.get("schema")
    tests = {
        "version": count(said.get("version")) and folder(said.get("base")),
        "epoch": count(said.get("epoch")),
        "documents": said.get("documents") is None or count(said["documents"]),
        "about": about(said.get("about")),
        "deltas": isinstance(deltas, list) and len(deltas) <= MAX_DELTAS and all(isinstance(d, dict) and folder(d.get("folder")) and count(d.get("epoch")) and about(d.get("about")) and about(d.get("touched")) for d in deltas),
        "decoupled": isinstance(said.get("decoupled"), bool),
        "schema": isinstance(schema, dict) and all(isinstance(schema.get(k), list) and len(schema[k]) <= MAX_FIELDS for k in ("fields", "filter_fields")),
    }
    if said.get("crc32") is not None:
        tests["crc32"] = said["crc32"] == _own_sum(said)
    if bad := [k for k, ok in tests.items() if not ok]:
        raise IncompatibleIndexError("a sound manifest", f"unsound {', '.join(bad)}")
    return said


def _table(spark: SparkSession, folder: str, about: dict, verify: bool | str) -> DataFrame:
    """A stored table whose pages are held against their checksums as they are read. verify: see load()."""
    at, _, table = folder.rpartition("/")
    reader = spark.read.option("parquet.page.verify-checksum.enabled", "true")
    known = reader.schema(T.StructType.fromJson(json.loads(about["columns"]))) if about.get("columns") else reader
    df = known.parquet(folder)
    if verify and about.get("files") is not None and (listed := segments.sized(spark, at, table)) != (about["files"], about["bytes"]):
        raise IncompatibleIndexError(f"{about['files']} files of {about['bytes']} bytes in {folder}", listed)
    if verify == "rows" and about.get("described"):
        if bad := segments.damaged(spark, at, df):
            raise IncompatibleIndexError(f"the rows of {folder} as they were written", f"other rows in {', '.join(bad)}")
    elif verify and (verify == "rows" or about.get("files") is None):
        rows, crc = table_sum(df)
        if rows != about["rows"] or about["crc32_sum"] not in (None, crc):
            raise IncompatibleIndexError(f"{about['rows']} rows of checksum {about['crc32_sum']} in {folder}", (rows, crc))
    return df


def _read(spark: SparkSession, root: str, name: str, said: dict, key: str, verify: bool | str = False) -> Version:
    at, about = f"{root}/{name}/", said["about"]
    base = _table(spark, f"{at}{said['base']}/docs", about, verify)
    rows = tuple(_table(spark, f"{at}{d['folder']}/rows", d["about"], verify) for d in said["deltas"])
    touched = tuple(_table(spark, f"{at}{d['folder']}/ids", d["touched"], verify) for d in said["deltas"])
    segment = segments.Segment(f"{at}{said['base']}", about["files"], bool(about.get("prefixes"))) if about.get("described") else None
    return Version(base, key, _VERSION, rows, touched, sum(d["touched"]["rows"] for d in said["deltas"]), about["rows"] + sum(d["about"]["rows"] for d in said["deltas"]), segment)


def load(spark: SparkSession, root: str, name: str, schema: IndexSchema, version: int | None = None, docs: DataFrame | None = None, verify: bool | str = True) -> DocumentIndex:
    """The saved index under the given schema, which must say what the manifest says; getters and hooks come from it.

    docs: the records of a decoupled snapshot; their ids must be the saved ones. verify: hold the lists of files against the manifest, which reads no table (those of
    versions without such lists are read whole); "rows": read every table and hold each file against its checksum, naming those that differ.
    """
    from siftwell.index import DocumentIndex

    said = manifest(spark, root, name, version)
    _same(said["schema"], schema)
    saved = _read(spark, root, name, said, schema.id, verify)
    if said["decoupled"]:
        if docs is None:
            raise IncompatibleIndexError("the records of a decoupled snapshot", None)
        both = docs.join(saved.base, schema.id)
        if (n := both.count()) != said["documents"]:
            raise IncompatibleIndexError(f"{said['documents']} records", n)
        saved = Version(both, schema.id, _VERSION)
    return DocumentIndex(schema, saved, epoch=said["epoch"])


def _same(said: dict, schema: IndexSchema) -> None:
    mine = schema.manifest()
    for prop in ("case_sensitive", "profile"):
        if said[prop] != mine[prop]:
            raise ProfileMismatchError(said[prop], mine[prop], prop)
    for prop in ("id", "fields", "filter_fields"):
        if said[prop] != mine[prop]:
            raise IncompatibleIndexError(said[prop], mine[prop])
    for name, was in said["hooks"].items():
        fn = schema.hooks.get(name)
        if fn is None or hook_id(fn) != was:
            raise IncompatibleHookError(was, f"the {name} hook of the snapshot is not the one supplied")


def delete(spark: SparkSession, root: str, name: str) -> bool:
    p, fs = _path(spark, f"{root}/{_checked(name)}")
    return bool(fs.delete(p, True))
