"""What readers may open: directories, hosts, size."""

from __future__ import annotations

import ipaddress
import socket
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class PolicyError(PermissionError):
    pass


@dataclass
class IoPolicy:
    """None allows everything. Hosts match exactly; directories hold for local paths, symbolic links resolved."""

    allowed_dirs: list[str] | None = None
    allowed_hosts: list[str] | None = None
    deny_private_hosts: bool = False
    max_bytes: int | None = None
    schemes: list[str] = field(default_factory=lambda: ["", "file", "hdfs", "viewfs", "s3a", "gs", "abfss", "http", "https"])

    def check(self, source: str, spark: SparkSession | None = None) -> str:
        u = urlparse(source)
        if u.scheme not in self.schemes:
            raise PolicyError(f"scheme {u.scheme!r} is not allowed")
        if u.scheme in ("", "file"):
            if self.allowed_dirs is not None:
                real = Path(u.path).resolve()
                if not any(real.is_relative_to(Path(d).resolve()) for d in self.allowed_dirs):
                    raise PolicyError(f"{source} is outside the allowed directories")
        elif u.hostname:
            if self.allowed_hosts is not None and u.hostname not in self.allowed_hosts:
                raise PolicyError(f"host {u.hostname} is not allowed")
            if self.deny_private_hosts and u.scheme in ("http", "https"):
                for info in socket.getaddrinfo(u.hostname, None):
                    ip = ipaddress.ip_address(info[4][0])
                    if ip.is_private or ip.is_loopback or ip.is_link_local:
                        raise PolicyError(f"host {u.hostname} is private")
        if self.max_bytes is not None and spark is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(source)
            size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
            if size > self.max_bytes:
                raise PolicyError(f"{source} has {size} bytes; {self.max_bytes} are allowed")
        return source


_POLICY = IoPolicy()


def set_io_policy(policy: IoPolicy | None) -> None:
    global _POLICY
    _POLICY = policy or IoPolicy()


def allowed(source: str, spark: SparkSession | None = None) -> str:
    return _POLICY.check(source, spark)
