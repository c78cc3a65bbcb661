"""Several tables that change together: staged folders and a numbered manifest that names them.

Each publication writes its tables to folders of its own, then one small file `manifests/<number>.json`, which is created only if
no other writer has taken that number. Readers take the greatest number, so they see all tables of a publication or none; what a
failed writer left is never named. (The file system must create a file without overwriting in one step, as HDFS and local ones do.) Tables that a publication does not write stay those of the one before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer published first."""


class Ledger:
    """The tables under a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """The numbers of all publications, in order."""
        fs, p = self._fs(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{number, note, tables: {name: [folder, schema]}} of a publication, by default the last; number 0 and no tables before the first."""
        known = self.versions()
        number = version if version is not None else (known[-1] if known else 0)
        if not number:
            return {"number": 0, "note": "", "tables": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a publication; None if it has none."""
        found = self.manifest(version)["tables"].get(table)
        return self.spark.read.schema(found[1]).parquet(f"{self.path}/{found[0]}") if found else None

    def publish(self, tables: Mapping[str, DataFrame], note: str = "", after: int | None = None) -> int:
        """Write tables and name them in the next manifest; `after`: the publication that they were computed from.

        Conflict if another one has been made since.
        """
        base = self.manifest()
        if after is not None and base["number"] != after:
            raise Conflict(f"publication {base['number']} came after {after}")
        folder, named = f"data/{uuid.uuid4().hex}", dict(base["tables"])
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
            named[name] = [f"{folder}/{name}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)]
        number = base["number"] + 1
        fs, target = self._fs(f"{self.path}/manifests/{number}.json")
        text = json.dumps({"number": number, "note": note, "tables": named})
        try:
            out = fs.create(target, False)  # an error if it is there
        except Exception as e:
            if fs.exists(target):
                raise Conflict(f"publication {number} was made by another writer") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return number
