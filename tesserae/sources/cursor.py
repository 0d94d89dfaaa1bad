"""Stored responses of a paged ad search as a data source of its own, `stored_ads`.

Responses lie under `path` in a file for each key: <country>/<bucket>/<key>.jsonl, a line for each response in the order of
their cursors, the bucket two digits of the key's digest. A scan of a key starts at the response without a cursor and follows
`next` until there is none, `limit` ads are read, `requests` responses are read, or one fails or is not there; then its ads are
marked `is_partial`. A failed page ends its own key only.

    register(spark)
    spark.read.format("stored_ads").option("limit", 50).load(path).where("key = 'a' AND country = 'US'")

Options: path, limit (100), requests (10). Tasks read buckets; filters on key and country are pushed into the source, which
then lists or opens nothing else. pyarrow's file systems are used, so the path may be in any store that these reach.
"""

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tesserae.session import ship

ROWS = "key string, country string, page_no long, pos long, ad string, is_partial boolean"
RESPONSES = "key string, country string, cursor string, next string, status long, ads array<string>"


def bucket_of(key: str) -> str:
    return hashlib.md5(key.encode()).hexdigest()[:2]


def files(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def children(store, path: str) -> list[str]:
    from pyarrow import fs

    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))


class Bucket(InputPartition):
    def __init__(self, country: str, bucket: str):
        self.country, self.bucket = country, bucket


def follow(responses: dict[str | None, dict], limit: int, requests: int) -> tuple[list[tuple[int, int, str]], bool]:
    """((page, place, ad) of a key, whether its scan failed)."""
    rows, cursor = [], None
    for page in range(requests):
        r = responses.get(cursor)
        if r is None or r.get("status") != 200 or not isinstance(r.get("ads"), list):
            return rows, True
        if not r["ads"]:
            break
        rows += [(page, i, ad) for i, ad in enumerate(r["ads"][: limit - len(rows)])]
        cursor = r.get("next")
        if cursor is None or len(rows) >= limit:
            break
    return rows, False


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit, self.requests = options["path"], int(options.get("limit", 100)), int(options.get("requests", 10))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in ("key", "country") and values is not None and all(isinstance(v, str) for v in values):
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        store, root = files(self.path)
        asked = None if "key" not in self.wanted else {bucket_of(k) for k in self.wanted["key"]}
        found = []
        for country in children(store, root) if "country" not in self.wanted else sorted(map(quote_name, self.wanted["country"])):
            found += [Bucket(country, b) for b in children(store, f"{root}/{country}") if asked is None or b in asked]
        return found

    def read(self, partition: Bucket) -> Iterator[Row]:
        if not isinstance(partition, Bucket):
            return
        store, root = files(self.path)
        folder = f"{root}/{partition.country}/{partition.bucket}"
        names = children(store, folder) if "key" not in self.wanted else sorted(f"{quote_name(k)}.jsonl" for k in self.wanted["key"] if bucket_of(k) == partition.bucket)
        country = unquote(partition.country)
        for name in names:
            if not store.get_file_info(f"{folder}/{name}").is_file or not name.endswith(".jsonl"):
                continue
            rows, failed = follow(self.responses(store, f"{folder}/{name}"), self.limit, self.requests)
            key = unquote(name.removesuffix(".jsonl"))
            for page, pos, ad in rows:
                yield Row(key=key, country=country, page_no=page, pos=pos, ad=ad, is_partial=failed)

    def responses(self, store, path: str) -> dict[str | None, dict]:
        """By cursor, those that a scan may ask for: lines are in order, so `requests` of them are enough. A broken line is a failed response."""
        out: dict[str | None, dict] = {}
        with store.open_input_stream(path) as f:
            pending, expected = b"", None
            while len(out) < self.requests:
                chunk = f.read(1 << 16)
                pending += chunk
                lines = pending.split(b"\n")
                pending = lines.pop() if chunk else b""
                for line in lines:
                    if line:
                        try:
                            r = json.loads(line)
                            out.setdefault(r.get("cursor"), r)
                            expected = r.get("next")
                        except (ValueError, AttributeError):
                            out.setdefault(expected, {"status": 0})
                if not chunk:
                    break
        return out


def quote_name(text: str) -> str:
    """A name for a file or folder that stands for any text."""
    return quote(text, safe="").replace(".", "%2E") or "%00"


class Writer(DataSourceWriter):
    """Writes responses that come by country and key, in the order of their scan; a task that runs again writes the same files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = files(self.path)
        for (country, key), group in groupby(rows, lambda r: (r["country"], r["key"])):
            folder = f"{root}/{quote_name(country)}/{bucket_of(key)}"
            store.create_dir(folder, recursive=True)
            own = f"{folder}/{quote_name(key)}"
            with store.open_output_stream(f"{own}.part") as f:
                for r in group:
                    f.write(json.dumps({c: r[c] for c in ("cursor", "next", "status", "ads")}).encode() + b"\n")
            store.move(f"{own}.part", f"{own}.jsonl")
        return WriterCommitMessage()


class StoredAds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_ads"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets sources in Python take filters there."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredAds)


def store_responses(responses, path: str, order: str) -> None:
    """Writes a frame of RESPONSES, and a column with their order, under a path."""
    register(responses.sparkSession)
    dealt = responses.repartition("country", "key").sortWithinPartitions("country", "key", order).drop(order)
    dealt.write.format("stored_ads").mode("append").save(path)
