"""Pages over HTTP as a source: fetched by the workers, with retries, entity tags, a hash guard and a page cache.

``register`` adds the format ``http_pages`` for a list of addresses;
``fetched`` takes a table of them.  A page that cannot be had is a row with
its error, so one dead server fails no job.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.shipping import ship

SCHEMA = "url string, status string, tries int, etag string, sha256 string, content binary, error string"
#: Answers after which asking again may help.
AGAIN = frozenset((408, 425, 429, 500, 502, 503, 504))


@dataclass(frozen=True)
class Fetcher:
    """How pages are fetched; tries at most ``tries`` times, with pauses of ``pause``, 2 * ``pause``, ... seconds.

    cache: a folder that all workers share; a page there is asked for again with
    its entity tag, and taken from there if it has not changed or cannot be had.
    """

    tries: int = 4
    pause: float = 0.5
    timeout: float = 30.0
    cache: str | None = None
    headers: dict = field(default_factory=dict)

    def _cached(self, url: str) -> tuple[str | None, bytes | None]:
        if not self.cache:
            return None, None
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.cache)
        path = f"{root}/{hashlib.sha256(url.encode()).hexdigest()}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None, None
        with files.open_input_stream(path) as f:
            tag, _, content = f.read().partition(b"\n")
        return tag.decode() or None, content

    def _keep(self, url: str, tag: str | None, content: bytes) -> None:
        if not self.cache:
            return
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.cache)
        files.create_dir(root, recursive=True)
        path = f"{root}/{hashlib.sha256(url.encode()).hexdigest()}"
        part = f"{path}.{uuid.uuid4().hex[:8]}"
        with files.open_output_stream(part) as f:
            f.write((tag or "").encode() + b"\n" + content)
        files.move(part, path)

    def get(self, url: str | None, expected: str | None = None) -> tuple:
        """A row of SCHEMA.  status: fetched, unchanged (as in the cache), stale (from the cache, the server failed), drifted (not the registered hash: no content) or failed."""
        tag, old = self._cached(url) if url else (None, None)
        error, tries = "no address", 0
        for k in range(self.tries if url else 0):
            tries = k + 1
            try:
                asked = urllib.request.Request(url, headers={**self.headers, **({"If-None-Match": tag} if tag else {})})
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    content, own = answer.read(), answer.headers.get("ETag")
                digest = hashlib.sha256(content).hexdigest()
                if expected and digest != expected:
                    return url, "drifted", tries, own, digest, None, f"expected {expected}"
                self._keep(url, own, content)
                return url, "fetched", tries, own, digest, content, None
            except urllib.error.HTTPError as e:
                if e.code == 304 and old is not None:
                    return self._from_cache(url, "unchanged", tries, tag, old, expected, None)
                error = f"HTTP {e.code}"
                if e.code not in AGAIN:
                    break
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                if isinstance(e, ValueError):
                    break
            if tries < self.tries:
                time.sleep(self.pause * 2**k)
        if old is not None:
            return self._from_cache(url, "stale", tries, tag, old, expected, error)
        return url, "failed", tries, None, None, None, error

    @staticmethod
    def _from_cache(url, status, tries, tag, content, expected, error) -> tuple:
        digest = hashlib.sha256(content).hexdigest()
        if expected and digest != expected:
            return url, "drifted", tries, tag, digest, None, f"expected {expected}"
        return url, status, tries, tag, digest, content, error


def fetched(urls: DataFrame, fetcher: Fetcher = Fetcher(), url: str = "url", expected: str | None = None) -> DataFrame:
    """SCHEMA for each row of urls; expected: the column with the registered hash, if there is one."""
    ship(urls.sparkSession)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for one, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(fetcher.get(one, want), kinds, strict=True)], names)

    return urls.select(F.col(url).cast("string"), (F.lit(None) if expected is None else F.col(expected)).cast("string")).mapInArrow(run, SCHEMA)


def register(spark: SparkSession) -> None:
    """Adds ``spark.read.format("http_pages")``: options urls (a JSON list), expected (a JSON map of hashes), partitions, tries, pause, timeout, cache."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    columns, make = SCHEMA, Fetcher
    ship(spark)

    class PageReader(DataSourceReader):
        def __init__(self, options):
            self.urls, self.expected = json.loads(options.get("urls", "[]")), json.loads(options.get("expected", "{}"))
            self.parts = max(1, min(len(self.urls), int(options.get("partitions", "8"))))
            self.fetcher = make(tries=int(options.get("tries", "4")), pause=float(options.get("pause", "0.5")), timeout=float(options.get("timeout", "30")), cache=options.get("cache"))

        def partitions(self):
            return [InputPartition(k) for k in range(self.parts)]

        def read(self, partition):
            for url in self.urls[partition.value :: self.parts]:
                yield self.fetcher.get(url, self.expected.get(url))

    class HttpPages(DataSource):
        @classmethod
        def name(cls):
            return "http_pages"

        def schema(self):
            return columns

        def reader(self, schema):
            return PageReader(self.options)

    spark.dataSource.register(HttpPages)
