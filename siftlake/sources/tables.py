"""Tables: Parquet by name, JSON with a stated schema, optional sources, versions, manifests."""

from __future__ import annotations

import json
import platform
import sys
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array (or lines) of records; an absent path gives an empty table of the schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_present(spark: SparkSession, full: str, smoke: str, schema) -> DataFrame:
    """The full source, or else the smoke one, with a column that says which."""
    smoked = not exists(spark, full)
    return json_table(spark, smoke if smoked else full, schema).withColumn("is_smoke", F.lit(smoked))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the role of the corpus: corpus_idx, code, text, source, control_system, official_route, lang.

    Sources alternate by id; each has codes of its own grammar.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    digit = lambda n: F.pmod(i, F.lit(n)).cast("string")
    letter = F.substring(F.lit("ABCDE"), (F.pmod(i, F.lit(5)) + 1).cast("int"), F.lit(1))
    source = F.when(F.pmod(i, F.lit(3)) == 0, "ecfr_part774").when(F.pmod(i, F.lit(3)) == 1, "india_scomet_2024").otherwise("wassenaar_2025")
    code = F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit("ECCN-"), digit(10), letter, F.lpad(digit(400), 3, "0")))
    code = code.when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit("8"), letter, digit(10), F.lpad(digit(100), 2, "0"))).otherwise(F.concat(digit(10), F.lit("."), letter, F.lit("."), digit(100)))
    return d.select(i.alias("corpus_idx"), code.alias("code"), "text", source.alias("source"), F.col("source").alias("control_system"), F.col("lang").alias("official_route"), "lang")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts by column name, tagged with the part's name as ``source``."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """path, sha256 and bytes of files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each file of the manifest with ok, missing or drifted."""
    m = manifest.select("path", F.col("sha256").alias("expected"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ok").otherwise("drifted")
    return m.join(found.select("path", "sha256"), "path", "left").select("path", status.alias("status"))


def verified(spark: SparkSession, glob: str, manifest: DataFrame) -> DataFrame:
    """(path, expected, sha256, bytes, status) of registered files and of those found but not registered."""
    m = manifest.select("path", F.col("sha256").alias("expected"))
    status = F.when(F.col("expected").isNull(), "unregistered").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ok").otherwise("drifted")
    return m.join(file_hashes(spark, glob), "path", "full_outer").withColumn("status", status)


def guarded_copy(spark: SparkSession, content: bytes, path: str, expected_sha256: str) -> bool:
    """Writes fetched bytes only if their hash is the registered one; a drifted source leaves the file as it is."""
    import hashlib

    if hashlib.sha256(content).hexdigest() != expected_sha256:
        return False
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = files.create(part, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    files.delete(p, False)
    return files.rename(part, p)


def pages(spark: SparkSession, glob: str, extract, cache: str | None = None) -> DataFrame:
    """(path, page, text) of files whose pages ``extract`` (bytes -> list of texts) gives; read from the cache if there is one, else written to it."""
    if cache and exists(spark, cache):
        return spark.read.parquet(cache)

    def run(batches):
        for b in batches:
            rows = [(p, k + 1, t) for p, c in zip(b["path"], b["content"], strict=True) for k, t in enumerate(extract(c))]
            yield type(b)(rows, columns=["path", "page", "text"])

    out = spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, page int, text string")
    if not cache:
        return out
    out.write.parquet(cache)
    return spark.read.parquet(cache)


def latest_date(versions: DataFrame, title: int) -> DataFrame:
    """(title, latest): the newest date (as text) of a title in a list of versions (title, date); null dates count as none."""
    return versions.filter(F.col("title") == title).groupBy("title").agg(F.max("date").alias("latest"))


def shards(spark: SparkSession, glob: str, schema) -> DataFrame:
    """All JSON shards of a folder with the file each row is from."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("shard", F.input_file_name())


def merged_shards(all_rows: DataFrame, anchor: str = "BM25", override: bool = False) -> DataFrame:
    """Rows of (model, retriever, query_id, hit): merged, if all models agree on the query ids and on the anchor's hits.

    A difference in ids is an error always, one in the anchor unless it is overridden.
    """
    models = all_rows.select("model").distinct().count()
    ids = all_rows.select("model", "query_id").distinct().groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") < models)
    if not ids.isEmpty():
        raise ValueError("query ids differ between shards")
    odd = all_rows.filter(F.col("retriever") == anchor).groupBy("query_id").agg(F.min("hit").alias("a"), F.max("hit").alias("b")).filter("a <> b")
    if not override and not odd.isEmpty():
        raise ValueError(f"{anchor} vectors differ between shards")
    return all_rows.dropDuplicates(["model", "retriever", "query_id"])


def environment(spark: SparkSession, **extra) -> DataFrame:
    """One row of versions and whatever else describes a run, as text."""
    found = {"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "spark": spark.version, **{k: json.dumps(v) if not isinstance(v, str) else v for k, v in extra.items()}}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"`{k}` string" for k in found))


def describe(rows: DataFrame, key: str, id_col: str, text: str) -> DataFrame:
    """(key, n, chars, digest): what a manifest records of a version; the digest does not depend on the order of rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), text)), 1, 8), 16, 10).cast("long")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.bit_xor(h).alias("digest"))


class Conflict(RuntimeError):
    """Another writer has committed the step that this one wanted."""


class Versions:
    """Versions of a table in one folder: data, and a log of numbered commits.

    A commit is a file that is created only if it is absent, so of two writers
    of one step the first wins and the other gets a ``Conflict``.  Data is
    written whole, to a folder of its own, before it is committed: a writer that
    dies in between leaves the versions as they were, and its name may be used
    again.  Reverting is a commit too; any step can be read as it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.log = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        self.files = self.log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def steps(self) -> list[int]:
        """The numbers of all commits."""
        if not self.files.exists(self.log):
            return []
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(self.log) if f.getPath().getName().isdigit())

    def entry(self, step: int) -> dict:
        """step, version, data, action and before: the step that was active before this version came."""
        stream = self.files.open(self.jvm.org.apache.hadoop.fs.Path(self.log, f"{step:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> dict | None:
        steps = self.steps()
        return self.entry(steps[-1]) if steps else None

    def active(self) -> str | None:
        last = self.latest()
        return last["version"] if last else None

    def _commit(self, step: int, **entry) -> None:
        """The whole file appears under its number or not at all."""
        path = self.jvm.org.apache.hadoop.fs.Path
        to, part = path(self.log, f"{step:020d}"), path(self.log, f".{uuid.uuid4().hex}")
        self.files.mkdirs(self.log)
        out = self.files.create(part, False)
        try:
            out.write(bytearray(json.dumps({"step": step, **entry}).encode()))
        finally:
            out.close()
        try:
            if self.log.toUri().getScheme() in (None, "file"):  # local files move onto others; a second link to a name is refused
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(local(to), local(part))
                    won = True
                except Exception as e:
                    if "FileAlreadyExists" not in str(e):
                        raise
                    won = False
            else:
                won = not self.files.exists(to) and self.files.rename(part, to)
        finally:
            if self.files.exists(part):
                self.files.delete(part, False)
        if not won:
            raise Conflict(f"step {step} of {self.folder} is taken")

    def write(self, rows: DataFrame) -> str:
        """The data of a version that is not committed yet: its folder's name."""
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def adopt(self, rows: DataFrame, version: str, after: int | None = None) -> int:
        """Writes a version and makes it the active one; returns its step.

        after: the step that the rows were made from; by default the latest when
        this begins.  A version that is there already is an error.
        """
        steps = self.steps()
        last = after if after is not None else (steps[-1] if steps else -1)
        if any(self.entry(k)["version"] == version for k in steps):
            raise ValueError(f"there is a version {version}")
        data = self.write(rows)
        try:
            self._commit(last + 1, version=version, data=data, action="adopt", before=last)
        except Conflict:
            self.files.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{data}"), True)
            raise
        return last + 1

    def revert(self) -> str:
        """Makes the version before the active one active again."""
        last = self.latest()
        if not last or last["before"] < 0:
            raise ValueError("there is no version to go back to")
        to = self.entry(last["before"])
        self._commit(last["step"] + 1, version=to["version"], data=to["data"], action="revert", before=to["before"])
        return to["version"]

    def read(self, version: str | None = None, step: int | None = None) -> DataFrame:
        """The active version, a named one, or what was active at a step."""
        if version is not None:
            found = next((e for e in map(self.entry, reversed(self.steps())) if e["version"] == version), None)
        else:
            found = self.latest() if step is None else self.entry(step)
        if not found:
            raise ValueError(f"there is no version {version or ''} in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{found['data']}")


def write_json(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, in as many files as the rows have partitions."""
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, places: int = 3, most: int = 1000) -> str:
    """A small result as a Markdown table; a report of more than ``most`` rows is an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many rows for a report")
    show = lambda x: "-" if x is None else f"{x:.{places}f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in found]) + "\n"


def error_bars(rates: DataFrame) -> DataFrame:
    """What a bar chart of rates needs: (.., rate, below, above) from (.., rate, lo, hi)."""
    return rates.withColumns({"below": F.greatest(F.col("rate") - F.col("lo"), F.lit(0.0)), "above": F.greatest(F.col("hi") - F.col("rate"), F.lit(0.0))})
