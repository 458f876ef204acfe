"""Object store locations read in place through Hadoop's ``s3a`` file system."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import scan_glob


@dataclass(frozen=True)
class ObjectStore:
    """A bucket. ``scheme`` and ``bucket`` may also point at a mounted folder (``file``)."""

    bucket: str
    scheme: str = "s3a"
    access_key: str = ""
    secret_key: str = field(default="", repr=False)
    endpoint_url: str | None = None
    region: str = "us-east-1"

    @property
    def root(self) -> str:
        return f"{self.scheme}://{self.bucket}"

    def options(self) -> dict[str, str]:
        """Reader options; they stay with this read and do not change the session."""
        if self.scheme != "s3a":
            return {}
        found = {
            "fs.s3a.access.key": self.access_key,
            "fs.s3a.secret.key": self.secret_key,
            "fs.s3a.endpoint": self.endpoint_url or "",
            "fs.s3a.endpoint.region": self.region,
            "fs.s3a.path.style.access": "true" if self.endpoint_url else "",
        }
        return {name: text for name, text in found.items() if text}

    def scan(self, spark: SparkSession, prefix: str = "", pattern: str = "*", fmt: str = "auto", **kw) -> DataFrame:
        options = {**self.options(), **kw.pop("options", {})}
        return scan_glob(spark, self.root, prefix, pattern, fmt, options=options, **kw)
