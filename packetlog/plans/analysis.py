"""The analysis run of the original tool: six reports, optionally with host
names, rendered as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.ipaddr import long_to_ip
from ..operators import reports as R
from ..operators.hosts import name_report
from ..operators.render import print_report
from .naming import Resolver, name_reports_through


def run_analysis(logs: DataFrame, limit: int = R.DEFAULT_LIMIT, hosts: DataFrame | None = None, now=None,
                 use_rollup: bool = True, show: bool = True, host_root: str | None = None,
                 resolver: Resolver | None = None) -> dict[str, DataFrame]:
    """All six reports in order. With ``hosts`` (the IP-to-host table) the
    address columns get display names (``<col>_name``), joined after the top-N
    cut; with ``host_root`` (a stored host table) and ``resolver`` missing names are
    resolved and stored first. With ``show`` each report is printed in the original
    layout."""
    out = {}
    reports = R.analysis(logs, limit, use_rollup, numeric_ips=True, with_rank=True)
    through = host_root is not None and resolver is not None
    if through:
        reports = name_reports_through(reports, logs.sparkSession, host_root, resolver, now)
    for name, rep in reports.items():
        ip_cols = [c for c in ("src_ip", "dst_ip") if c in rep.columns]
        if hosts is not None and not through and ip_cols:
            rep = name_report(rep, hosts, ip_cols=tuple(ip_cols), now=now)
        for c in ip_cols:
            rep = rep.withColumn(c, long_to_ip(c))
        out[name] = rep
        if show:
            print_report(rep, name, {c: c + "_name" for c in ip_cols} if hosts is not None or through else None)
    return out
