"""All tables of the engine behind one manifest, so that a block's writes are seen together or not at all.

A version is a JSON file that lists, for every table, the directories (parts) that hold it, with the heights that are in each, and the
marks of what is synced. It is moved into place once all directories are written; that move fails where a file of that number is
there, so of two writers one is refused. Readers resolve tables through the highest version. A writer that dies leaves
directories that nobody names; `vacuum` deletes them with old versions.

Three kinds of tables: facts are appended; keyed rows replace those of the same key and lie in pieces of heights; current rows are the last
event of each pass in the log and lie in buckets. Replacing rewrites the touched pieces or buckets alone, and so does a
rollback: parts beyond the height are left out, the part that holds it is written again, and current rows are taken anew from
the log for buckets with a pass that changed since.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heightline import schema
from heightline.operators import chain
from heightline.operators.validation import RequestError
from heightline.sources import snapshot

FACTS, KEYED, CURRENT = "facts", "keyed", "current"
#: Heights in a piece of a keyed table, and buckets of a current one.
PIECE, BUCKETS = 4096, 64


class Table(NamedTuple):
    kind: str
    ddl: str
    height: str = "height"
    key: tuple[str, ...] = ()


#: An event of the log makes this row of its pass.
CURRENT_ROW = {"inscription_id": "inscription_id", "block_height": "block_height", "id": "id", "state": "new_state", "owner": "new_owner", "satpoint": "new_satpoint"}
TABLES = {
    "ledger": Table(FACTS, "account string, height bigint, delta bigint"),
    "outputs": Table(FACTS, "txid string, vout bigint, account string, height bigint, value decimal(20,0)"),
    "spends": Table(FACTS, "txid string, vout bigint, account string, height bigint, value decimal(20,0)"),
    "registry": Table(FACTS, schema.SCRIPT_REGISTRY, ""),  # a rollback leaves it as it is
    "undo": Table(FACTS, "height bigint, kind string, txid string, vout bigint, account string"),
    "commits": Table(KEYED, schema.BLOCK_COMMITS, "block_height", ("block_height",)),
    "log": Table(FACTS, schema.PASS_HISTORY, "block_height"),
    "passes": Table(CURRENT, "inscription_id string, block_height bigint, id bigint, state string, owner string, satpoint string", "block_height", ("inscription_id",)),
    "snapshots": Table(KEYED, "block_height bigint, total_balance decimal(20,0), active_address_count bigint", "block_height", ("block_height",)),
    "anchors": Table(KEYED, "block_height bigint, stable_block_hash string, latest_block_commit string", "block_height", ("block_height",)),
    "pass_commits": Table(KEYED, "block_height bigint, mutation_root string, block_commit string", "block_height", ("block_height",)),
    "energy": Table(KEYED, schema.PASS_ENERGY, "block_height", ("inscription_id", "block_height")),
}


class Store:
    """before: called with the name of each step ahead of it, so that tests can fail there."""

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table] = TABLES, retention: int = 64, before: Callable[[str], None] = lambda step: None):
        self.spark, self.path, self.tables, self.retention, self.before = spark, path.rstrip("/"), dict(tables), retention, before
        self._fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- versions

    def _place(self, path: str):
        p = self._fs_of.Path(path)
        return p, p.getFileSystem(self._conf)

    def _versions(self) -> list[int]:
        p, fs = self._place(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The last version, or one of those that are kept: version, tip, marks, and the parts of each table."""
        found = self._versions()
        if not found and version is None:
            return {"version": -1, "tip": -1, "marks": {}, "tables": {}}
        number = found[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number:020d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        self.before("publish")
        waiting, fs = self._place(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(waiting, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        target, _ = self._place(f"{self.path}/manifests/{manifest['version']:020d}.json")
        refuse = getattr(self._fs_of, "Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs_of, "Options$Rename"), 1)
        options[0] = refuse
        try:
            self._fs_of.FileContext.getFileContext(waiting.toUri(), self._conf).rename(waiting, target, options)
        except Exception as e:
            fs.delete(waiting, False)
            if not fs.exists(target):
                raise
            raise RequestError("VERSION_TAKEN", str(manifest["version"])) from e

    # --- reading

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as one version has it."""
        return self._read(table, self.manifest(version)["tables"].get(table, []))

    def _read(self, table: str, parts: list[dict]) -> DataFrame:
        kind = self.tables[table].ddl
        if not parts:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(p["dir"] for p in parts))

    # --- writing

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        fields = StructType.fromDDL(self.tables[table].ddl).fields
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    def _slot(self, table: str) -> Column:
        of = self.tables[table]
        return F.floor(F.col(of.height) / PIECE).cast("bigint") if of.kind == KEYED else F.pmod(F.xxhash64(*of.key), F.lit(BUCKETS)).cast("bigint")

    def _write(self, table: str, rows: DataFrame, version: int) -> list[dict]:
        """The parts that rows become; no rows, no part."""
        self.before(table)
        of, place = self.tables[table], f"{self.path}/data/{table}/{version:020d}-{uuid.uuid4().hex}"
        shaped = self._shaped(table, rows)
        bounds = [F.count("*").alias("n")] + [f(of.height).alias(n) for f, n in ((F.min, "low"), (F.max, "high")) if of.height]
        if of.kind == FACTS:
            shaped.write.parquet(place)
            found = self.spark.read.schema(of.ddl).parquet(place).agg(*bounds).first().asDict()
            return [{"dir": place, **found}] if found["n"] else []
        shaped.withColumn("_slot", self._slot(table)).repartition("_slot").write.partitionBy("_slot").parquet(place)
        if not self._place(place)[1].exists(self._fs_of.Path(place)):
            return []
        written = self.spark.read.schema(f"{of.ddl}, _slot bigint").parquet(place).groupBy("_slot").agg(*bounds).collect()  # a row for each touched piece or bucket
        return [{"dir": f"{place}/_slot={r['_slot']}", "slot": r["_slot"], "n": r["n"], "low": r["low"], "high": r["high"]} for r in written]

    def _replaced(self, table: str, parts: list[dict], rows: DataFrame, version: int) -> list[dict]:
        """parts with rows in place of those of the same key; only pieces or buckets that rows touch are written."""
        rows = self._shaped(table, rows)
        slots = {r[0] for r in rows.select(self._slot(table)).distinct().collect()}  # at most a batch's pieces, or BUCKETS
        touched = [p for p in parts if p["slot"] in slots]
        old = self._read(table, touched).join(rows.select(*self.tables[table].key), list(self.tables[table].key), "left_anti")
        new = self._write(table, old.unionByName(rows), version)
        return [p for p in parts if p["slot"] not in slots] + new

    def _latest(self, log: DataFrame) -> DataFrame:
        last = log.groupBy("inscription_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "inscription_id")), "id").alias("r")).select("inscription_id", "r.*")
        return last.select(*(F.col(of).alias(name) for name, of in CURRENT_ROW.items()))

    def commit(self, tip: int | None, rows: Mapping[str, DataFrame], marks: Mapping[str, int | None] = {}, expected: int | None = None) -> dict:
        """One version with these rows more: facts appended, keyed rows put in their places, and current rows brought up to the log.

        tip: the highest height that is whole now; None keeps it. marks are added to those that stand. expected: the version that the
        rows were made from; another one by now is refused, before any write.
        """
        now = self.manifest()
        if expected is not None and expected != now["version"]:
            raise RequestError("STALE_VERSION", f"{expected}, now {now['version']}")
        version, tables = now["version"] + 1, dict(now["tables"])
        for name, df in rows.items():
            own = tables.get(name, [])
            tables[name] = own + self._write(name, df, version) if self.tables[name].kind == FACTS else self._replaced(name, own, df, version)
        if "log" in rows:
            tables["passes"] = self._replaced("passes", tables.get("passes", []), self._latest(self._shaped("log", rows["log"])), version)
        made = {"version": version, "tip": now["tip"] if tip is None else tip, "marks": {**now["marks"], **marks}, "tables": tables}
        self._publish(made)
        return made

    def rollback(self, height: int) -> dict:
        """One version without anything beyond a height. Refused beyond the retained window, before any write."""
        now = self.manifest()
        chain.check_rollback(now["tip"], height, self.retention)
        version, tables = now["version"] + 1, {}
        for name, parts in now["tables"].items():
            if self.tables[name].kind != CURRENT:
                tables[name] = self._cut(name, parts, height, version)
        if "passes" in now["tables"]:
            tables["passes"] = self._restored(now["tables"], tables["log"], height, version)
        marks = {k: v if v is None else min(v, height) for k, v in now["marks"].items()}
        made = {"version": version, "tip": min(now["tip"], height), "marks": marks, "tables": tables}
        self._publish(made)
        return made

    def _cut(self, table: str, parts: list[dict], height: int, version: int) -> list[dict]:
        """parts up to a height; one that holds rows on both sides is written again."""
        column = self.tables[table].height
        if not column:
            return parts
        whole = [p for p in parts if p["high"] is not None and p["high"] <= height]
        torn = [p for p in parts if p["high"] is not None and p["low"] <= height < p["high"]]
        return whole + (self._write(table, self._read(table, torn).where(F.col(column) <= height), version) if torn else [])

    def _restored(self, before: dict, log: list[dict], height: int, version: int) -> list[dict]:
        """Current rows after a rollback: buckets without a pass that changed since stay as files, the others come from the log that is left."""
        gone = [p for p in before["log"] if p["high"] > height]
        changed = self._read("log", gone).where(F.col("block_height") > height)
        slots = {r[0] for r in changed.select(self._slot("passes")).distinct().collect()}  # at most BUCKETS
        kept = [p for p in before["passes"] if p["slot"] not in slots]
        if not slots:
            return kept
        left = self._read("log", log).where(self._slot("passes").isin(sorted(slots)))
        return kept + self._write("passes", self._latest(left), version)

    def reconcile(self) -> dict:
        """Cuts energy that a separate writer left beyond the passes, or at its pending height; energy behind the passes raises."""
        now = self.manifest()
        marks, tip = now["marks"], now["tip"]
        synced, pending = marks.get("energy_synced"), marks.get("energy_pending")
        if synced is not None and synced < tip:
            raise RequestError("ENERGY_BEHIND_PASSES", f"{synced} < {tip}")
        bound = tip if pending is None else min(tip, pending - 1)
        version = now["version"] + 1
        tables = {**now["tables"], "energy": self._cut("energy", now["tables"].get("energy", []), bound, version)}
        made = {"version": version, "tip": tip, "marks": {**marks, "energy_synced": tip, "energy_pending": None}, "tables": tables}
        self._publish(made)
        return made

    def install(self, staged: str, names: Mapping[str, str], trust: str = "manifest") -> dict:
        """Points tables at a checked snapshot's directories, in one version. names: table of the snapshot for each of ours."""
        self.before("verify")
        found = snapshot.verify(self.spark, staged) if trust != "dev" else snapshot.described(self.spark, staged)
        now = self.manifest()
        tables = dict(now["tables"])
        for table, name in names.items():
            of = self.tables[table]
            rows = self.spark.read.parquet(f"{staged}/{name}")
            bounds = rows.agg(F.count("*"), *((F.min(of.height), F.max(of.height)) if of.height else ())).first()
            part = {"dir": f"{staged}/{name}", "n": bounds[0]} | ({"low": bounds[1], "high": bounds[2]} if of.height else {})
            tables[table] = [part] if bounds[0] else []
        made = {"version": now["version"] + 1, "tip": found["height"], "marks": {**now["marks"], "installed_from": found["height"]}, "tables": tables}
        self._publish(made)
        return made

    def vacuum(self, keep: int = 8) -> int:
        """Deletes all but the last versions, and directories under data that none of these names. Run it while nobody writes."""
        versions = self._versions()
        named = {p["dir"].split("/_slot=")[0].rsplit("/", 1)[-1] for v in versions[-keep:] for parts in self.manifest(v)["tables"].values() for p in parts}
        gone = 0
        for v in versions[:-keep]:
            p, fs = self._place(f"{self.path}/manifests/{v:020d}.json")
            fs.delete(p, False)
        for table in self.tables:
            p, fs = self._place(f"{self.path}/data/{table}")
            for f in fs.listStatus(p) if fs.exists(p) else ():
                if f.getPath().getName() not in named:
                    fs.delete(f.getPath(), True)
                    gone += 1
        return gone
