"""Processes of the machines that run the tasks, as a batch or streaming data source.

``spark.dataSource.register(HostProcesses)``, then ``spark.read.format("quern_host")``. Each
partition lists the processes of the executor that happens to run it: one partition a machine
is up to the caller (option ``partitions``).
"""

from __future__ import annotations

import os
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "ts timestamp, host string, pid int, name string, cmdline string, cpu_seconds double, memory_bytes long"


def scrape(proc: str = "/proc"):
    """A row a process; one that ends meanwhile is left out."""
    from datetime import UTC, datetime

    now, host = datetime.now(UTC).replace(tzinfo=None), os.uname().nodename
    tick, page = os.sysconf("SC_CLK_TCK"), os.sysconf("SC_PAGE_SIZE")
    for entry in sorted(filter(str.isdigit, os.listdir(proc)), key=int):
        try:
            with open(f"{proc}/{entry}/stat", encoding="utf-8", errors="replace") as f:
                before, _, rest = f.read().rpartition(")")
            with open(f"{proc}/{entry}/statm", encoding="utf-8") as f:
                resident = int(f.read().split()[1])
            with open(f"{proc}/{entry}/cmdline", encoding="utf-8", errors="replace") as f:
                cmdline = f.read().replace("\0", " ").strip()
        except (OSError, IndexError, ValueError):
            continue
        stat = rest.split()
        yield now, host, int(entry), before.partition("(")[2], cmdline or None, (int(stat[11]) + int(stat[12])) / tick, resident * page


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("partitions", 1)))]

    def read(self, partition):
        return scrape(self.options.get("proc", "/proc"))


class _Stream(SimpleDataSourceStreamReader):
    """A scrape a batch; offsets are times, so a batch that is run again is scraped again."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"at": 0.0}

    def read(self, start):
        return iter(list(scrape(self.options.get("proc", "/proc")))), {"at": time.time()}

    def readBetweenOffsets(self, start, end):
        return iter(list(scrape(self.options.get("proc", "/proc"))))


class HostProcesses(DataSource):
    @classmethod
    def name(cls):
        return "quern_host"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)
