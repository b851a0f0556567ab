"""Access logs in the combined format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a line of the combined log format.
COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+) "([^"]*)" "([^"]*)"$'


def log_lines(lines: DataFrame, line: str) -> DataFrame:
    """The columns of lines and ok, ip, at, method, path, status, bytes, agent; a line of another form has ok false and nulls."""
    part = lambda i: F.when(F.col("ok"), F.regexp_extract(line, COMBINED, i))
    rows = lines.withColumn("ok", F.coalesce(F.col(line).rlike(COMBINED), F.lit(False)))
    request = F.split(part(3), " ")
    return rows.withColumns({
        "ip": part(1), "at": F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "method": F.get(request, F.lit(0)), "path": F.get(request, F.lit(1)),
        "status": part(4).try_cast("int"), "bytes": part(5).try_cast("long"), "agent": part(7),
    })


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = [F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    fine = parts[0].between(0, 255) & parts[1].between(0, 255) & parts[2].between(0, 255) & parts[3].between(0, 255)
    return F.when(fine, ((parts[0].cast("long") * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])
