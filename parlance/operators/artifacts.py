"""Immutable results: rows in files, a manifest beside them, a name that commits to the content.

Rows are written by Spark, several part files for a large table; manifests are small and written
last, through Hadoop's file system, so an interrupted write leaves no artifact. A digest of rows is
the root of a tree of digests of blocks, which stay beside the rows: a difference names its blocks.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.plans.durable import materialized

MANIFEST, BLOCKS = "manifest.json", ".blocks"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


#: Rows of a block, and blocks of a block of the next level.
BLOCK = 1000


def _level(rows: DataFrame, block: int) -> DataFrame:
    """``b, d`` of blocks of consecutive rows (i, d): each one's digest is that of its rows' digests in order."""
    keyed = rows.select(F.floor(F.col("i") / block).alias("b"), "i", "d")
    return keyed.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), "\n"), 256).alias("d"))


def digest_blocks(rows: DataFrame, body: str, index: str, block: int = BLOCK) -> DataFrame:
    """``b, d``: the digests of all blocks of rows, the lowest level of the tree."""
    return _level(rows.select(F.col(index).alias("i"), F.sha2(body, 256).alias("d")), block)


def tree_root(blocks: DataFrame, block: int = BLOCK) -> str:
    """The root over ``digest_blocks``: blocks of blocks, level by level, until only block 0 is left.

    All levels are made by Spark, each as large as the one below divided by ``block``; the driver gets the root.
    """
    while True:
        blocks = materialized(blocks)
        last = blocks.agg(F.max("b")).first()[0]
        if last is None:
            return hashlib.sha256().hexdigest()
        if last == 0:
            return blocks.first()["d"]
        blocks = _level(blocks.select(F.col("b").alias("i"), "d"), block)


def rows_digest(rows: DataFrame, body: str, index: str, block: int = BLOCK) -> str:
    """A digest of all rows in order: the root of a tree of digests."""
    return tree_root(digest_blocks(rows, body, index, block), block)


def differing_blocks(blocks: DataFrame, others: DataFrame) -> DataFrame:
    """``b``: the blocks (b, d) whose digests differ, or that one side lacks."""
    theirs = others.select("b", F.col("d").alias("other"))
    return blocks.join(theirs, "b", "full_outer").where(~F.col("d").eqNullSafe(F.col("other"))).select("b")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename; false if the target is there, so that of two writers one wins."""
    fs, to = _files(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to):
        return False
    return fs.rename(_files(spark, source)[1], to)


def write_artifact(spark: SparkSession, root: str, parts: dict[str, DataFrame], recipe: dict) -> str:
    """Write JSON lines of each part and the manifest; returns the id. Done already: returns at once.

    The id commits to the recipe, the row counts and the rows. Parts have the columns ``index`` and
    ``value`` (a JSON text); empty parts are listed with no rows and have no folder.
    """
    temporary = f"{root}/.tmp-{uuid.uuid4().hex}"
    files = {}
    for name, df in sorted(parts.items()):
        n = df.count()
        if n:
            # the blocks stay with the rows, to tell where these differ from what was written
            digest_blocks(df, "value", "index").write.parquet(f"{temporary}/{name}{BLOCKS}")
        files[name] = {"rows": n, "sha256": tree_root(spark.read.parquet(f"{temporary}/{name}{BLOCKS}")) if n else None}
        if n:
            # file order is not to be relied on, so the index stays with its row
            df.select(F.to_json(F.struct("index", "value")).alias("value")).write.text(f"{temporary}/{name}")
    body = {"files": files, "recipe": recipe}
    ident = digest(body)
    if not exists(spark, f"{root}/{ident}/{MANIFEST}"):
        spark.range(1).select(F.lit(canonical(body | {"id": ident})).alias("value")).coalesce(1).write.text(f"{temporary}/{MANIFEST}")
        if not move(spark, temporary, f"{root}/{ident}"):
            _files(spark, temporary)[0].delete(_files(spark, temporary)[1], True)
    else:
        _files(spark, temporary)[0].delete(_files(spark, temporary)[1], True)
    return ident


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFEST}").first()["value"])


def read_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``index, value`` of one part, in no order."""
    rows = spark.read.text(f"{path}/{name}")
    got = F.from_json("value", "index long, value string", {"mode": "FAILFAST"})
    return rows.select(got.alias("r")).select("r.index", "r.value")


def verify_artifact(spark: SparkSession, path: str) -> dict:
    """The manifest, if the folder's name, the recipe and every row are what it says; else ValueError."""
    manifest = read_manifest(spark, path)
    body = {k: manifest[k] for k in ("files", "recipe")}
    if digest(body) != manifest.get("id") or path.rstrip("/").rsplit("/", 1)[-1] != manifest["id"]:
        raise ValueError(f"manifest does not match its name: {path}")
    fs, where = _files(spark, path)
    there = {s.getPath().getName() for s in fs.listStatus(where)} - {MANIFEST}
    names = {n for n, f in manifest["files"].items() if f["rows"]}
    if there != names | {n + BLOCKS for n in names}:
        raise ValueError(f"files do not match the manifest: {path}")
    for name in sorted(names):
        part = read_part(spark, path, name)
        blocks = materialized(digest_blocks(part, "value", "index"))
        if part.count() != manifest["files"][name]["rows"] or tree_root(blocks) != manifest["files"][name]["sha256"]:
            bad = differing_blocks(blocks, spark.read.parquet(f"{path}/{name}{BLOCKS}")).orderBy("b").limit(10).collect()
            raise ValueError(f"rows do not match the manifest: {path}/{name}, blocks {[r['b'] for r in bad]}")
    return manifest


def list_artifacts(spark: SparkSession, root: str) -> list[str]:
    """Paths of folders whose names are digests."""
    fs, where = _files(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    return [f"{root}/{n}" for n in sorted(names) if len(n) == 64 and not set(n) - set("0123456789abcdef")]


def scan_artifacts(spark: SparkSession, root: str, files: str = "*/manifest.json/part-*") -> DataFrame:
    """``name, kind, n_files, n_rows, error`` of all artifacts below ``root``, read by tasks: files as rows.

    ``name`` is the folder's. A manifest that can't be read, or that is not of its folder, is a row with an error. The
    driver lists what ``files`` matches up to its last part; the files in these folders are listed by tasks.
    """
    folders, names = files.rsplit("/", 1)
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", names).text(f"{root}/{folders}").select("value", F.col("_metadata.file_path").alias("path"))
    at = F.element_at(F.split(F.substring_index("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1), "/"), 1)
    body = F.from_json("value", "files map<string,struct<rows:bigint,sha256:string>>, recipe struct<kind:string>, id string").alias("m")
    rows = raw.select(F.regexp_replace(at, "^[^=]*=", "").alias("name"), body)
    error = F.when(F.col("m.id").isNull() | F.col("m.files").isNull(), "unreadable manifest").when(F.col("m.id") != F.col("name"), "manifest of another artifact")
    rows = rows.withColumn("error", error)
    sound = lambda c: F.when(F.col("error").isNull(), c)
    n_rows = F.aggregate(F.map_values("m.files"), F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["rows"], F.lit(0)))
    return rows.select("name", sound(F.col("m.recipe.kind")).alias("kind"), sound(F.size("m.files")).alias("n_files"), sound(n_rows).alias("n_rows"), "error")


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, where = _files(spark, path)
    return fs.getContentSummary(where).getLength()
