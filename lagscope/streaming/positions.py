"""How far each source has been read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

# Where a source starts that was never read.
START_TIME = datetime(2006, 1, 2, 15, 4, 5)
START_ID = 0


def _parse(text: str, like):
    return datetime.fromisoformat(text) if isinstance(like, datetime) else type(like)(text)


class WatermarkTable:
    """Positions by source as a small versioned table in shared storage; one writer.

    Every commit writes all positions as a new version. A version counts once its success marker
    exists, so a writer that dies half-way leaves the version before in force.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, root, path = self._fs()
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = [int(n[2:]) for n in found if n.startswith("v=")]
        return sorted(n for n in numbers if fs.exists(path(f"{self.path}/v={n}/_SUCCESS")))

    def all(self) -> dict[str, str]:
        versions = self._versions()
        if not versions:
            return {}
        rows = self.spark.read.schema("source string, position string").json(f"{self.path}/v={versions[-1]}")
        return {r["source"]: r["position"] for r in rows.collect()}  # one row per source

    def get(self, source: str, start=START_TIME):
        """The saved position, of the same type as ``start``."""
        text = self.all().get(source)
        return start if text is None else _parse(text, start)

    def commit(self, positions: dict) -> bool:
        """Saves positions that moved forward; False if none did."""
        now, moved = self.all(), {}
        for source, value in positions.items():
            if value is None:
                continue
            old = _parse(now[source], value) if source in now else None
            if old is None or value > old:
                moved[source] = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
        if not moved:
            return False
        versions = self._versions()
        number = (versions[-1] if versions else 0) + 1
        rows = list({**now, **moved}.items())
        table = self.spark.createDataFrame(rows, "source string, position string").coalesce(1)
        table.write.mode("overwrite").json(f"{self.path}/v={number}")
        fs, _, path = self._fs()
        for old_version in versions[: -self.keep]:
            fs.delete(path(f"{self.path}/v={old_version}"), True)
        return True
