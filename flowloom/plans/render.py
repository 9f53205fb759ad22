"""Results as text: CSV and aligned columns, headers that explain, summaries.  Driver side, row by row as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import convert, ip
from flowloom.functions.convert import BINARY, METRIC, scaled
from flowloom.plans.catalog import FIELDS
from flowloom.plans.query import FlowQuery

NOT_A_NUMBER, ABSENT = "NaN", "absent"
PAD = "    "
ELLIPSIS = "..."
#: Widths of columns whose rows are not all known beforehand, by kind.
WIDTHS = {"time": 23, "addr": 39, "mac": 17, "volume": 10, "calc": 10, "number": 9, "bits": 8}


@dataclass(frozen=True)
class Style:
    """How values are shown; ``pretty`` and ``csv`` are the two ready-made ones."""

    form: str
    time: str
    volume: str
    flags: str
    address: str
    proto: str
    duration: str
    zone: str = "UTC"
    rich: bool = False
    ellipsize: bool = True


ALLOWED = {
    "form": ("pretty", "csv"),
    "time": ("none", "pretty"),
    "volume": ("none", "metric-prefix", "binary-prefix"),
    "flags": ("none", "str"),
    "address": ("none", "str"),
    "proto": ("none", "str"),
    "duration": ("none", "str"),
}


def style(form: str = "pretty", **own) -> Style:
    """The style of a format with single conversions changed; unknown names raise."""
    base = {
        "pretty": dict(time="pretty", volume="metric-prefix", flags="str", address="str", proto="str", duration="str"),
        "csv": dict(time="none", volume="none", flags="none", address="none", proto="none", duration="none"),
    }
    if form not in base:
        raise ValueError(f"unknown output format '{form}'")
    values = {"form": form} | base[form] | {k: v for k, v in own.items() if v is not None}
    for k, v in values.items():
        if k in ALLOWED and v not in ALLOWED[k]:
            raise ValueError(f"unknown {k} conversion '{v}'")
    return Style(**values)


def _shown(name: str, s: Style) -> Column:
    f = FIELDS[name]
    if f.kind == "addr":
        hi, lo = map(F.col, f.columns)
        return ip.text(hi, lo) if s.address == "str" else ip.words_text(hi, lo)
    c = F.col(name)
    if f.kind == "mac":
        return convert.mac_text(c)
    if f.kind == "time":
        return convert.timestamp_text(c, s.zone) if s.time == "pretty" else c.cast("string")
    if name == "duration":
        return convert.duration_text(c) if s.duration == "str" else c.cast("string")
    if name == "flags":
        return convert.flags_text(c) if s.flags == "str" else c.cast("string")
    if name == "proto":
        return F.coalesce(convert.protocol_text(c), c.cast("string")) if s.proto == "str" else c.cast("string")
    return c  # volumes and numbers are formatted here, where C's rounding is at hand


def shown(result: DataFrame, query: FlowQuery, s: Style) -> DataFrame:
    """The result with a column per field, converted but for volumes."""
    return result.select(*[_shown(n, s).alias(n) for n in query.shown])


def _text(value, name: str, s: Style) -> str:
    f = FIELDS[name]
    if value is None:
        return NOT_A_NUMBER if f.kind == "calc" else ABSENT
    if isinstance(value, str):
        return value
    if f.kind in ("volume", "calc"):
        if s.volume != "none":
            return scaled(value, *((METRIC, 1000) if s.volume == "metric-prefix" else (BINARY, 1024)))
        if isinstance(value, float):
            return f"{value:.1f}"
    return str(value)


def csv_lines(result: DataFrame, query: FlowQuery, s: Style) -> DataFrame:
    """The lines of a result as CSV, without the header, made where the rows are: for results that no single machine should print."""
    types = dict(result.dtypes)

    def cell(name: str) -> Column:
        kind, c = FIELDS[name].kind, _shown(name, s)
        if kind in ("volume", "calc") and name != "duration":
            c = convert.volume_text(c, s.volume) if s.volume != "none" else convert.decimal_text(c) if types[name] == "double" else c
        return F.coalesce(c.cast("string"), F.lit(NOT_A_NUMBER if kind == "calc" else ABSENT))

    return result.select(F.concat_ws(",", *[cell(n) for n in query.shown]).alias("line"))


def header(query: FlowQuery, rich: bool) -> list[str]:
    """Field names; rich ones of sorted or aggregated results tell keys, functions and the order."""
    if not rich or not (query.keys or query.order):
        return list(query.shown)
    keys = {k.name for k in query.keys}
    out = []
    for n in query.shown:
        text = n
        if n in keys:
            text += " (key)"
        elif query.keys:
            text += f" [{FIELDS[n].how}]" if n != query.order else ""
        if n == query.order:
            direction = "{" + ("desc" if query.descending else "asc") + "}"
            text += direction if n in keys else f" {direction}"
        out.append(text)
    return out


def lines(result: DataFrame, query: FlowQuery, s: Style) -> Iterator[str]:
    """A result line by line: one with a limit is collected, any other comes a partition at a time."""
    names, titles, out = query.shown, header(query, s.rich), shown(result, query, s)
    rows = lambda: ([_text(v, n, s) for v, n in zip(r, names)] for r in (out.collect() if query.top else out.toLocalIterator()))
    if s.form == "csv":
        yield ",".join(titles)
        for r in rows():
            yield ",".join(r)
        return
    if s.ellipsize:
        widths, found = [max(WIDTHS[FIELDS[n].kind], len(t)) for n, t in zip(names, titles)], rows()
    else:
        widths, found = [len(t) for t in titles], rows()
        if query.top:
            found = list(found)
        for r in found:
            widths = [max(w, len(x)) for w, x in zip(widths, r)]
        found = found if query.top else rows()  # exact widths need all rows: those without a limit are read once more rather than kept
    yield _aligned(titles, titles, names, widths)
    for r in found:
        yield _aligned(r, titles, names, widths)


def _aligned(cells: list[str], titles: list[str], names: tuple[str, ...], widths: list[int]) -> str:
    out = []
    for i, (cell, name, width) in enumerate(zip(cells, names, widths)):
        if len(cell) > width:
            cell = cell[: width - len(ELLIPSIS)] + ELLIPSIS
        right = FIELDS[name].kind in ("volume", "calc", "number") and name not in ("proto", "duration")
        out.append(cell.rjust(width) if right else cell if i == len(cells) - 1 else cell.ljust(width))
    return PAD.join(out)


def processed_lines(flows: int, packets: int, bytes_: int, seconds: float, s: Style) -> Iterator[str]:
    rate = flows / seconds if seconds else 0.0
    show = lambda v: _text(v, "bytes", s)
    if s.form == "csv":
        yield "flows,packets,bytes,seconds,flows/second"
        yield f"{show(flows)},{show(packets)},{show(bytes_)},{seconds:.6f},{show(rate)}"
    else:
        yield "processed records summary:"
        yield f"\t{show(flows)} flows, {show(packets)} packets, {show(bytes_)} bytes"
        yield f"\t{seconds:f} seconds, {show(rate)} flows/second"


def metadata_lines(rows: list, s: Style) -> Iterator[str]:
    show = lambda v: _text(v, "bytes", s)
    if s.form == "csv":
        yield "field,total,TCP,UDP,ICMP,other"
        for r in rows:
            yield ",".join([r.field, *map(show, (r.total, r.tcp, r.udp, r.icmp, r.other))])
    else:
        yield "metadata summary:"
        for r in rows:
            yield f"\t{r.field}:"
            for title, v in (("total:", r.total), ("TCP:", r.tcp), ("UDP:", r.udp), ("ICMP:", r.icmp), ("other:", r.other)):
                yield f"\t\t{title:<6} {show(v)}"


#: The fields of a basic record, and how wide each is in aligned text: negative is left-aligned.
BASIC = {"first": -27, "last": -27, "proto": -6, "srcip": 17, "srcport": -7, "dstip": 17, "dstport": -7, "bytes": 13, "packets": 13, "flows": 13}


def basic_records(flows: DataFrame, s: Style) -> Iterator[str]:
    """Every record as one text of ten fields: comma-separated, or aligned with addresses and ports joined by a colon."""
    for r in flows.select(*[_shown(n, s).alias(n) for n in BASIC]).toLocalIterator():
        cells = [_text(v, n, s) for v, n in zip(r, BASIC)]
        if s.form == "csv":
            yield ",".join(cells)
        else:
            yield "".join((c.ljust(-w) if w < 0 else c.rjust(w)) + (":" if n.endswith("ip") else "") for c, (n, w) in zip(cells, BASIC.items()))
