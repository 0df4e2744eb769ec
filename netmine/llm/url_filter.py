"""URL filters over a sorted digest array.

The rules' strings (host + path) become sorted 64-bit xxhash keys in one flat file:
header, path lengths, keys, string offsets, strings.  Spark gives every executor the
file once, and its tasks map it, so they share its pages.  A url asks for every (host suffix, path
prefix length that some rule has); all keys of a batch are probed with one
vectorised binary search, and a hit counts only if the stored string is equal.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path:
then up to `?`, `#` or the end.  A rule fits its host and all subdomains if the
path starts with the rule's path; the longest fitting rule wins, of equally
long ones that with the longer host.  Defined cases: null urls and urls without
`://` have empty host and path and fit no rule; repeated rows are judged alike;
two rules with one host and path must agree, else ValueError; an index over
MAX_INDEX_BYTES is refused for broadcasting and `judge` joins on the digests
instead.
"""

from __future__ import annotations

import mmap
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.llm.common import saved, shared_folder

MAX_INDEX_BYTES = 64 << 20
DEFAULT_VERDICT = "allow"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST = re.compile(r"[/?#]")
_PATH = re.compile(r"[?#]")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    m = _HOST.search(rest)
    host, tail = (rest, "") if m is None else (rest[: m.start()], rest[m.start() :])
    return host.translate(_LOWER), _PATH.split(tail, maxsplit=1)[0]


def build_index(rules: list[Rule]) -> bytes:
    """The flat digest array; the same bytes can be written to a file and mapped."""
    by_text: dict[tuple[str, str], str] = {}
    for r in rules:
        if by_text.setdefault((r.host, r.path), r.verdict) != r.verdict:
            raise ValueError(f"rules disagree on {r.text}")
    entries = sorted((xxhash.xxh64_intdigest(f"{h}\0{p}"), h, p, v) for (h, p), v in by_text.items())
    strings = [f"{h}\0{p}\0{v}".encode() for _, h, p, v in entries]
    lengths = sorted({len(p) for _, _, p, _ in entries})
    head = np.array([len(entries), len(lengths)], dtype=np.uint64)
    keys = np.array([e[0] for e in entries], dtype=np.uint64)
    offsets = np.cumsum([0] + [len(s) for s in strings]).astype(np.uint64)
    return b"".join([head.tobytes(), np.array(lengths, dtype=np.uint64).tobytes(), keys.tobytes(), offsets.tobytes(), *strings])


class DigestArray:
    """A mapped index."""

    def __init__(self, buffer):
        n, m = (int(x) for x in np.frombuffer(buffer, np.uint64, 2))
        self.path_lengths = [int(x) for x in np.frombuffer(buffer, np.uint64, m, 16)]
        self.keys = np.frombuffer(buffer, np.uint64, n, 16 + 8 * m)
        self.offsets = np.frombuffer(buffer, np.uint64, n + 1, 16 + 8 * (m + n))
        self.buffer, self.base = buffer, 16 + 8 * (m + 2 * n + 1)

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        """The file mapped for reading; all tasks of an executor share its pages."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def entry(self, i: int) -> tuple[str, str, str]:
        a, b = self.base + int(self.offsets[i]), self.base + int(self.offsets[i + 1])
        return tuple(bytes(self.buffer[a:b]).decode().split("\0"))

    def lookup(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """For each host and path the winning rule's text and verdict."""
        owner, asked, keys = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            labels = host.split(".")
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in self.path_lengths:
                    if n > len(path):
                        break
                    owner.append(i)
                    asked.append((suffix, path[:n]))
                    keys.append(xxhash.xxh64_intdigest(f"{suffix}\0{path[:n]}"))
        best: list[tuple[tuple[int, int], tuple[str, str]] | None] = [None] * len(hosts)
        if len(self.keys) and keys:
            probe = np.array(keys, dtype=np.uint64)
            lo = np.searchsorted(self.keys, probe, "left")
            hi = np.searchsorted(self.keys, probe, "right")
            for j in np.flatnonzero(hi > lo):
                for e in range(int(lo[j]), int(hi[j])):
                    host, path, verdict = self.entry(e)
                    if (host, path) == asked[j]:
                        rank = (len(host) + len(path), len(host))
                        if best[owner[j]] is None or rank > best[owner[j]][0]:
                            best[owner[j]] = (rank, (host + path, verdict))
        return [b and b[1] for b in best]


OUT = "page_id long, host string, path string, rule string, verdict string"


def send_file(spark: SparkSession, data: bytes) -> str:
    """Put bytes into the folder that the cluster shares and let Spark give every executor its file of them; the file's name."""
    name = f"index-{xxhash.xxh3_128_hexdigest(data)}"
    jvm, path = spark.sparkContext._jvm, f"{shared_folder(spark)}/{name}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = files.create(part)
        stream.write(bytearray(data))
        stream.close()
        files.rename(part, at)
    spark.sparkContext.addFile(files.makeQualified(at).toString())
    return name


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict of every row of `pages`."""
    data = build_index(rules)
    if len(data) > max_index_bytes:
        return _judge_by_join(spark, pages, rules)
    name = send_file(spark, data)
    schema = pa.schema([("page_id", pa.int64())] + [(n, pa.string()) for n in ("host", "path", "rule", "verdict")])

    def run(batches):
        index = DigestArray.mapped(SparkFiles.get(name))
        for batch in batches:
            pairs = [split_url(u) for u in batch.column("url").to_pylist()]
            hosts, paths = [p[0] for p in pairs], [p[1] for p in pairs]
            found = index.lookup(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()),
                    pa.array(hosts, pa.string()),
                    pa.array(paths, pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([f[1] if f else DEFAULT_VERDICT for f in found], pa.string()),
                ],
                schema=schema,
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, OUT)


def _judge_by_join(spark: SparkSession, pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """For rule sets too large to broadcast: candidates of each row are joined on (digest, host, path)."""
    lengths = sorted({len(r.path) for r in rules})
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "r_host string, r_path string, r_verdict string").distinct()
    url = F.col("url").cast("string")
    has = url.contains("://")
    rest = F.expr("substring(url, locate('://', url) + 3)")
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).select(
        F.expr("uuid()").alias("rid"), "page_id",
        F.when(has, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("").alias("host"),
        F.when(has, F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)).otherwise("").alias("path"),
    )
    base = saved(base.fillna("", ["host", "path"]))  # row numbers must not change when a task is run again
    asked = (
        base.where("host <> ''")
        .select("rid", "path", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")).alias("r_host"))
        .select("rid", "r_host", F.explode(F.array([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])).alias("r_path"))
    )
    best = (
        asked.join(table, ["r_host", "r_path"])
        .groupBy("rid")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))).alias("b"))
    )
    return base.join(best, "rid", "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.r_verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
