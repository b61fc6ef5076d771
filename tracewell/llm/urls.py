"""URL filters: a sorted array of digests, memory-mapped and probed by binary search.

A blocked entry is a host or a host with a path (`host/a/b`), and stands for its
subdomains and for paths below it. The entries of a block lie in one file: 64-bit xxhash
keys in order, offsets, and the full strings. Each executor gets the file through the
session's file distribution and maps it. The suffixes of a url's host, alone and with the
beginnings of its path, are hashed and probed for a whole batch at once; a hit counts only where
the stored string is equal. A list larger than BLOCK_BYTES (measured) is dealt over several files that
are probed in turn.

Rules (host, path beginning) decide before the list; of those that fit, the longest wins, and
of equal ones a block. Defined cases: a null url and one without `://` have empty
host and path, no rule, and are allowed; repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import scratch_root

SEED = 42
BLOCK_BYTES = 32 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str        # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


def suffixes(host: str) -> list[str]:
    """The host and all domains above it, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def beginnings(path: str, depth: int) -> list[str]:
    """`/a`, `/a/b`, ... of a path, at most `depth` parts."""
    parts = [p for p in path.split("/")[1:depth + 1] if p]
    return ["/" + "/".join(parts[:i + 1]) for i in range(len(parts))]


def digests(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts))


def pack(entries: list[str]) -> bytes:
    """The file of a block: number and depth, keys in order, offsets, strings."""
    texts = sorted({e.translate(_LOWER).rstrip("/").encode() for e in entries if e})
    keys = digests(texts)
    order = np.argsort(keys, kind="stable")
    texts = [texts[i] for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
    depth = max((t.count(b"/") for t in texts), default=0)
    return np.array([len(texts), depth], "<i8").tobytes() + keys[order].astype("<u8").tobytes() + offsets.tobytes() + b"".join(texts)


class DigestArray:
    """A mapped file of `pack`."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n, self.depth = (int(x) for x in data[:16].view("<i8"))
        self.keys = data[16:16 + 8 * n].view("<u8")
        self.offsets = data[16 + 8 * n:16 + 8 * n + 8 * (n + 1)].view("<i8")
        self.texts = data[16 + 8 * n + 8 * (n + 1):]

    def holds(self, texts: list[bytes]) -> np.ndarray:
        """Which texts are entries: equal digest and equal string."""
        out = np.zeros(len(texts), dtype=bool)
        if not len(self.keys) or not texts:
            return out
        wanted = digests(texts)
        at = np.searchsorted(self.keys, wanted, side="left")
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
        for i in hit:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:      # entries whose digests collide
                if self.texts[self.offsets[k]:self.offsets[k + 1]].tobytes() == texts[i]:
                    out[i] = True
                    break
                k += 1
        return out


def _ship(spark: SparkSession, data: bytes) -> str:
    """Write a block to the shared folder and distribute it; the name it has on executors."""
    name = f"urls-{uuid.uuid4().hex}.bin"
    context = spark.sparkContext
    target = f"{scratch_root(spark).rstrip('/')}/{name}"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    context.addFile(target)
    return name


def _blocks(entries: DataFrame, column: str):
    rows = entries.select(F.col(column).cast("string").alias("entry")).where("entry != ''").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("entry") + 16), F.lit(0))).first()[0]
    count = int(size // BLOCK_BYTES) + 1
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("entry"), F.lit(count)) == block) if count > 1 else rows
        yield [r.entry for r in part.toLocalIterator()]


def best_rule(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    fits = [r for h in suffixes(host) for r in rules.get(h, ()) if path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), r.verdict == "block"), default=None)


def judge_urls(pages: DataFrame, entries: DataFrame, rules: list[Rule], url_column: str = "url", entry_column: str = "entry") -> DataFrame:
    """`row` (all columns of pages), host, path, rule and verdict of every row.

    rules: a short list, sent with the tasks; entries: any number of blocked hosts and paths.
    """
    names = [_ship(pages.sparkSession, pack(block)) for block in _blocks(entries, entry_column)]
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url_column).alias("url"))

    def run(batches):
        arrays = [DigestArray(SparkFiles.get(n)) for n in names]
        for batch in batches:
            hosts, paths, found, verdicts, texts, owner = [], [], [], [], [], []
            depth = max((a.depth for a in arrays), default=0)
            for i, url in enumerate(batch.column("url").to_pylist()):
                host, path = split_url(url)
                rule = best_rule(host, path, by_host)
                hosts.append(host), paths.append(path)
                found.append(rule and rule.name), verdicts.append(rule.verdict if rule else "allow")
                if rule is None:
                    own = [(h + p).encode() for h in suffixes(host) for p in ("", *beginnings(path, depth))]
                    texts += own
                    owner += [i] * len(own)
            hit = np.zeros(len(texts), dtype=bool)
            for a in arrays:
                hit |= a.holds(texts)
            for i in set(np.array(owner, dtype=np.int64)[hit].tolist()):
                verdicts[i] = "block"
            yield pa.record_batch(
                [batch.column("row"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                ["row", "host", "path", "rule", "verdict"],
            )

    schema = held.drop("url").schema
    for name in ("host", "path", "rule", "verdict"):
        schema = schema.add(name, "string")
    return held.mapInArrow(run, schema)
