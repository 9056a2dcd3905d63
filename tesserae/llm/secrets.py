r"""Secret scans with an incremental ledger of blobs.

Every version of every text is a blob, addressed by its SHA-256. The ledger holds a row for each blob and rule version that was
scanned, with its findings; a scan takes only the pairs that the ledger lacks, so a text that comes back under another path, or
again later, isn't scanned twice, and a changed rule is run anew over all blobs. Findings are joined back to all paths.

A blob is scanned where it first occurs (its smallest path), so copies never travel together: a group of copies comes down to one row
a task before it is dealt.

Defined results: a null text is the empty blob; a null path is a path of its own; repeated rows get a row each; empty tables give
empty tables; other columns are ignored. Times grow with the text only: no pattern is tried twice over one run of characters.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserae.llm.common import at_most, fresh_dir, id_key, join_hot, ready, text_of, tidied, written


@dataclass(frozen=True)
class Rule:
    """pattern's matches whose `group` has `least` characters are secrets; a text without any of `needs` (lower case) has none."""

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0
    flags: int = 0
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        search = re.compile(self.pattern, self.flags | re.ASCII).finditer

        def find(text: str) -> list[tuple[int, int]]:
            if self.needs:
                low = text.lower() if self.flags & re.IGNORECASE else text
                if not any(x in low for x in self.needs):
                    return []
            return [m.span() for m in search(text) if m.end(self.group) - m.start(self.group) >= self.least]

        return find


#: Fixed values. A run of `hex` or `access` characters is one match, so its least length may stand in the pattern.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.IGNORECASE, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 16, 0, 0, ("AKIA",)),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}", 32),
)
#: What the method adds to these: private key blocks.
EXTRA = (Rule("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 31, 0, 0, ("-----BEGIN ",)),)

LEDGER = "blob string, rule string, spans array<struct<s:int,e:int>>"


def blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Ledger:
    """A table of LEDGER rows. Each scan writes a folder of its own, which counts only once its marker is there: a scan that broke off
    leaves nothing that is read. Two scans that ran at once may hold the same pair; it is read once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        """One row for each blob and rule; findings of one pair are the same whoever scanned it."""
        there, system = self._path("scan-*/_whole")
        scans = [x.getPath().getParent().toString() for x in system.globStatus(there) or []]
        if not scans:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER).parquet(*scans)
        return rows if len(scans) == 1 else rows.dropDuplicates(["blob", "rule"])

    def append(self, rows: DataFrame) -> None:
        """rows: no pair twice."""
        scan = f"scan-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{scan}")
        marker, system = self._path(f"{scan}/_whole")
        system.create(marker).close()


def scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """LEDGER rows of todo: blob, rules (array of the keys to run) and text."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {r.key: r.finder() for r in rules}
        for b in batches:
            blobs, keys, spans = [], [], []
            for address, want, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                for key in want:
                    blobs.append(address)
                    keys.append(key)
                    spans.append([{"s": s, "e": e} for s, e in finders[key](text)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(keys, pa.string()), pa.array(spans, kind)], ["blob", "rule", "spans"])

    ready(todo.sparkSession)
    return todo.select("blob", "rules", "text").mapInArrow(tidied(run), LEDGER)


def update(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = (*BASE, *EXTRA), path: str = "doc_id") -> DataFrame:
    """Scan what the ledger lacks of docs' blobs under these rules, and append it. Returns path and blob of each row of docs."""
    paths = written(docs.select(F.col(path).alias("path"), id_key(path).alias("_id"), blob(text_of()).alias("blob")), "paths")
    seen = paths.groupBy("blob").agg(F.min("_id").alias("_id"))
    known = ledger.rows().where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("_done"))
    every = F.array(*[F.lit(r.key) for r in rules])
    want = F.when(F.col("_done").isNull(), every).otherwise(F.array_except(every, "_done"))
    new = written(seen.join(known, "blob", "left").select("blob", "_id", want.alias("rules")).where(F.size("rules") > 0), "unseen")
    here = docs.select(id_key(path).alias("_id"), blob(text_of()).alias("blob"), text_of().alias("text"))
    rest = written(paths.select("_id", "blob").join(new, ["_id", "blob"], "left_anti").distinct(), "seen")
    kinds = new.select("rules").distinct().limit(2).collect()
    if len(kinds) == 1 and at_most(rest):
        # few paths are copies or known: leave these out where the texts lie, so that no text is dealt
        todo = here.join(F.broadcast(rest), ["_id", "blob"], "left_anti").withColumn("rules", F.array(*[F.lit(x) for x in kinds[0][0]]))
    else:
        todo = here.join(new, ["_id", "blob"])
    found = scan(todo, rules)
    # a path's repeated rows give a blob's findings again
    repeated = paths.groupBy("_id", "blob").agg(F.count("*").alias("n")).where("n > 1")
    ledger.append(found if at_most(repeated, 0) else found.dropDuplicates(["blob", "rule"]))
    return paths.select("path", "blob")


def findings(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = (*BASE, *EXTRA)) -> DataFrame:
    """path, blob and found (array<struct<kind, s, e>> by start, then the rules' order) of each path."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    names = F.array(*[F.lit(r.name) for r in rules])
    held = ledger.rows().where((F.size("spans") > 0) & F.col("rule").isin([r.key for r in rules])).withColumn("k", F.element_at(order, F.col("rule")))
    spans = held.select("blob", "k", F.get(names, F.col("k")).alias("kind"), F.explode("spans").alias("x"))
    by_blob = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(F.col("x.s").alias("s"), "k", F.col("x.e").alias("e"), "kind"))).alias("found"))
    out = join_hot(paths, by_blob, ["blob"], salt_by=["path"])
    found = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return out.select("path", "blob", F.coalesce(found, F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("found"))


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """The digest of findings(): counts by kind, hash of the base rules' spans, all spans.

    The base rules are scanned first, then the whole set: the second scan takes only the pairs of a blob and an added rule.
    """
    ledger = ledger or Ledger(docs.sparkSession, fresh_dir(docs.sparkSession, "ledger"))
    update(docs, ledger, BASE)
    out = findings(update(docs, ledger), ledger)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin([r.name for r in BASE]))
    return out.select(F.col("path").alias("doc_id"), *[count(r.name) for r in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), count("pem"))
