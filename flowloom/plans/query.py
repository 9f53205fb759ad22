"""A query over flow records: what it filters, groups, orders and shows, and the DataFrame it becomes.

A query is immutable; its methods return changed copies.  ``run`` only declares the plan:
filters are written so that they reach the scan, only the columns needed are read, absent
values become 0 above the filter, sums combine before the shuffle, and order with a limit
is a top-k without a sort of everything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowloom.functions import ip
from flowloom.plans.catalog import AGGR_FIELDS, FIELDS, LIST_FIELDS, NEEDS, Field, calculated, field
from flowloom.plans.filterlang import compile_filter, parse

MAX_KEYS, MAX_FIELDS, MAX_ALL = 10, 30, 41
DEFAULT_TOP = 10


@dataclass(frozen=True)
class Spec:
    """A field as written: name[/alignment[/IPv6 alignment]]."""

    name: str
    v4: int = 32
    v6: int = 128
    bits: int = 0

    @classmethod
    def parse(cls, text: str) -> Spec:
        name, *rest = text.strip().split("/")
        f = field(name)
        if len(rest) > 2 or any(not x.isdigit() for x in rest):
            raise ValueError(f"invalid alignment in '{text}'")
        numbers = list(map(int, rest))
        if f.kind == "addr":
            v4, v6 = (*numbers, *[32, 128][len(numbers) :])
            if v4 > 32 or v6 > 128:
                raise ValueError(f"alignment out of range in '{text}'")
            return cls(name, v4, v6)
        if len(numbers) > 1 or any(x > 62 for x in numbers):
            raise ValueError(f"invalid alignment in '{text}'")
        return cls(name, bits=numbers[0] if numbers and f.kind == "time" else 0)

    @property
    def field(self) -> Field:
        return FIELDS[self.name]

    def columns(self, get: Callable[[str], Column]) -> list[Column]:
        """The key's columns, aligned: an address masked, a timestamp without its last bits."""
        f = self.field
        if f.kind == "addr":
            hi, lo = get(f.columns[0]), get(f.columns[1])
            if (self.v4, self.v6) != (32, 128):
                hi, lo = ip.masked(hi, lo, self.v4, self.v6)
            return [hi.alias(f.columns[0]), lo.alias(f.columns[1])]
        if f.kind == "calc":
            return [calculated(self.name, get).alias(self.name)]
        c = get(self.name)
        if self.bits:
            c = F.shiftleft(F.shiftright(c, self.bits), self.bits)
        return [c.alias(self.name)]


def _specs(texts: str | Sequence[str]) -> tuple[Spec, ...]:
    parts = texts.split(",") if isinstance(texts, str) else texts
    return tuple(Spec.parse(t) for t in parts if t.strip())


@dataclass(frozen=True)
class FlowQuery:
    filter: str = ""
    keys: tuple[Spec, ...] = ()
    order: str | None = None
    descending: bool = False
    top: int = 0
    fields: tuple[str, ...] | None = None
    exact_bpp: bool = False

    # ---- building

    def where(self, text: str) -> FlowQuery:
        """Only records that match; a later filter replaces an earlier one."""
        parse(text)
        return replace(self, filter=text)

    def aggregate(self, keys: str | Sequence[str]) -> FlowQuery:
        found: dict[str, Spec] = {}
        for s in _specs(keys):
            if not s.field.key:
                raise ValueError(f"'{s.name}' cannot be an aggregation key")
            found.setdefault(s.name, s)  # of a repeated key the first counts
        if not found:
            raise ValueError("at least one aggregation key is needed")
        if len(found) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} aggregation keys")
        return replace(self, keys=tuple(found.values()))

    def order_by(self, text: str) -> FlowQuery:
        """``field[#asc|desc]``; without a direction, the field's own."""
        name, mark, direction = text.strip().partition("#")
        spec = Spec.parse(name)
        if not spec.field.sortable:
            raise ValueError(f"'{spec.name}' cannot be sorted by")
        if mark and direction not in ("asc", "desc"):
            raise ValueError(f"unknown direction '{direction}'")
        return replace(self, order=spec.name, descending=direction == "desc" if mark else spec.field.descending)

    def limit(self, n: int) -> FlowQuery:
        """At most n records; 0 is all."""
        if n < 0:
            raise ValueError("the limit must not be negative")
        return replace(self, top=n)

    def statistic(self, text: str) -> FlowQuery:
        """``keys[#order[#direction]]``: aggregation, order and a limit of 10 at once, replacing what was set before."""
        keys, _, order = text.partition("#")
        return self.aggregate(keys).order_by(order or "flows").limit(DEFAULT_TOP)

    def select(self, fields: str | Sequence[str]) -> FlowQuery:
        """Fields to show after the keys and the sort key; an empty text shows no others."""
        names = tuple(dict.fromkeys(s.name for s in _specs(fields)))
        if len(names) > MAX_FIELDS:
            raise ValueError(f"more than {MAX_FIELDS} output fields")
        return replace(self, fields=names)

    # ---- reading

    @property
    def shown(self) -> tuple[str, ...]:
        """All fields of the result: keys, sort key, output fields, each where it first comes."""
        rest = self.fields if self.fields is not None else AGGR_FIELDS if self.keys else LIST_FIELDS
        names = tuple(dict.fromkeys([*(k.name for k in self.keys), *([self.order] if self.order else []), *rest]))
        if len(names) > MAX_ALL:
            raise ValueError(f"more than {MAX_ALL} fields in all")
        return names

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(c for n in self.shown for c in FIELDS[n].columns)

    def _needed(self) -> list[str]:
        names: dict[str, None] = {}
        for n in self.shown:
            for x in NEEDS.get(n, (n,)):
                names.update(dict.fromkeys(FIELDS[x].columns))
        return list(names)

    def matching(self, flows: DataFrame) -> DataFrame:
        """The records that pass the filter, as they are stored."""
        return flows.where(compile_filter(self.filter)) if self.filter.strip() else flows

    def run(self, flows: DataFrame, seen: Observation | None = None) -> DataFrame:
        """The result's plan.  ``seen`` gets flows, packets and bytes of all matching records as the plan runs, see ``whole_input``."""
        types = dict(flows.dtypes)
        absent = [c for c in self._needed() if c not in types]
        if absent:
            raise ValueError(f"the records have no column {', '.join(absent)}")
        zeroed = [F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) for c in self._needed()]
        matching = self.matching(flows)
        if seen is not None:
            matching = matching.observe(seen, *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("flows", "packets", "bytes")])
        rows = matching.select(*zeroed)
        out = self._grouped(rows) if self.keys else self._listed(rows)
        if self.order:
            out = out.orderBy(*self._ordering())
        return out.limit(self.top) if self.top else out

    @property
    def whole_input(self) -> bool:
        """Whether a result of bounded size needs all matching records, so that one pass can sum them up as well."""
        return bool(self.top and (self.keys or self.order))

    def _calc(self, name: str, get=F.col) -> Column:
        return calculated(name, get, self.exact_bpp).alias(name)

    def _listed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[c for n in self.shown for c in ([self._calc(n)] if FIELDS[n].kind == "calc" else map(F.col, FIELDS[n].columns))])

    def _grouped(self, rows: DataFrame) -> DataFrame:
        keys = {k.name: [c for c in k.columns(F.col)] for k in self.keys}
        wanted = dict.fromkeys(x for n in self.shown if n not in keys for x in NEEDS.get(n, (n,)) if x not in keys)
        aggregates = [_aggregate(FIELDS[n]) for n in wanted]
        flat = [c for cs in keys.values() for c in cs]
        # keys get names of their own, as an aligned key and an aggregate may use the same column
        names = [f"_k{i}" for i in range(len(flat))]
        plain = [c for k in self.keys for c in k.field.columns]
        grouped = rows.select("*", *[c.alias(n) for c, n in zip(flat, names)]).groupBy(*names)
        found = grouped.agg(*aggregates) if aggregates else rows.select(*[c.alias(n) for c, n in zip(flat, names)]).distinct()
        named = found.select(
            *[F.col(n).alias(p) for n, p in zip(names, plain)],
            *[c for n in wanted for c in ([F.col(f"{n}.hi").alias(f"{n}_hi"), F.col(f"{n}.lo").alias(f"{n}_lo")] if FIELDS[n].kind == "addr" else [F.col(n)])],
        )
        return named.select(
            *[c for n in self.shown for c in ([F.col(n)] if n in keys and FIELDS[n].kind != "addr" else [self._calc(n)] if FIELDS[n].kind == "calc" else map(F.col, FIELDS[n].columns))]
        )

    def _ordering(self) -> list[Column]:
        """The sort key, then all columns ascending, so that ties always fall the same way."""
        f = FIELDS[self.order]
        cs = list(ip.sort_key(*map(F.col, f.columns))) if f.kind == "addr" else [F.col(f.name)]
        first = [c.desc_nulls_last() if self.descending else c.asc_nulls_last() for c in cs]
        return [*first, *[F.col(c).asc_nulls_last() for c in self.columns]]


def _aggregate(f: Field) -> Column:
    if f.kind == "addr":
        return ip.minimum(*map(F.col, f.columns)).alias(f.name)
    how = {"min": F.min, "max": F.max, "sum": F.sum, "or": F.bit_or}[f.how]
    return how(f.name).alias(f.name)
