"""Entry points: queries over an entity, and the envelopes that clients get."""

from __future__ import annotations

import asyncio
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import errors as E
from .model import Condition, ConditionGroup, Direction, Filter, GroupBy, Intersection, OrderBy, PageBy, Segment, Summary
from .operators import grouping, predicates, projections
from .plans.frames import Frame, quoted
from .plans.paths import resolve
from .sources import Catalog, Entity


@dataclass
class Result:
    """A page of rows, lazy until rows() or to_json(), with the count of all."""

    data: DataFrame
    total_count: int = 0
    page_number: int = 0
    page_size: int = 0
    page_count: int = 0
    query_string: str | None = None

    def rows(self) -> list:
        return self.data.collect()

    def to_json(self) -> str:
        kept = self.data.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
        head = {
            "PageNumber": self.page_number,
            "PageSize": self.page_size,
            "PageCount": self.page_count,
            "TotalCount": self.total_count,
            "QueryString": self.query_string,
        }
        return json.dumps(head)[:-1] + ', "Data": [' + ", ".join(r[0] for r in kept) + "]}"


def check_page(page: PageBy) -> None:
    if page.page_number < 1:
        raise E.LogicError(E.INVALID_PAGE_NUMBER)
    if page.page_size < 1:
        raise E.LogicError(E.INVALID_PAGE_SIZE)


#: Rows that every task of a top-k sort may hold; the limit of row numbers in offset and limit.
DEEP, MOST = 100_000, (1 << 31) - 1


def paged(df: DataFrame, page: PageBy | None) -> DataFrame:
    """A page of df's rows in their order.

    After a sort, Spark takes a page by a top-k of offset + size rows in each task.  A deep page is cut from a range sort instead,
    whose rows stream by: the filter, which every row passes, keeps the limit from merging with the sort.  A page that
    ends past the row numbers that a limit can hold is cut there; one that begins past them is empty.
    """
    if page is None:
        return df
    check_page(page)
    skip = (page.page_number - 1) * page.page_size
    if skip >= MOST:
        return df.limit(0)
    if skip + page.page_size > DEEP:
        df = df.where(F.monotonically_increasing_id() >= 0)
    return df.offset(skip).limit(min(page.page_size, MOST - skip))


def sort_column(key: Column, descending: bool) -> Column:
    return key.desc_nulls_last() if descending else key.asc_nulls_first()


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


class Query:
    """An entity's rows under the operators applied so far; each operator gives a new query."""

    def __init__(self, catalog: Catalog, entity: Entity | str, df: DataFrame | None = None):
        self.catalog = catalog
        self.entity = catalog[entity] if isinstance(entity, str) else entity
        self.df = self.entity.df if df is None else df

    def _frame(self, df: DataFrame | None = None) -> Frame:
        return Frame(self.catalog, self.entity, self.df if df is None else df)

    def _on(self, df: DataFrame) -> Query:
        return Query(self.catalog, self.entity, df)

    # Single operators

    def where(self, request: Condition | ConditionGroup | str | dict) -> Query:
        if request is None:
            raise TypeError("request is None")
        if not isinstance(request, (Condition, ConditionGroup)):
            data = json.loads(request) if isinstance(request, (str, bytes)) else request
            kind = Condition if any(k.lower() == "operator" for k in data) else ConditionGroup
            request = kind.from_json(request)
        frame = self._frame()
        got = predicates.condition(frame, request) if isinstance(request, Condition) else predicates.group(frame, request)
        if got is None:
            return self
        return self._on(frame.df.where(got).select(*map(quoted, frame.base)))

    def _sorted(self, frame: Frame, orders) -> list[Column]:
        """Sort columns by Sort; the entity's key, or all columns, break ties."""
        keys = []
        for o in sorted(orders, key=lambda o: o.sort):
            path = resolve(self.catalog, self.entity, o.field)
            last = path.last
            if last.kind in ("coll", "array") or last.kind == "ref":
                raise E.LogicError(E.order_ends_on_collection(o.field))
            descending = o.direction is Direction.Descending
            keys.append(sort_column(frame.order_key(path, descending), descending))
        ties = self.entity.key or [f.name for f in self.entity.df.schema if f.dataType.typeName() not in ("map", "variant")]
        return [*keys, *[sort_column(quoted(k), False) for k in ties]] if keys else []

    def order(self, request: OrderBy | list[OrderBy]) -> Query:
        if request is None:
            raise TypeError("request is None")
        orders = [OrderBy.from_json(o) for o in (request if isinstance(request, (list, tuple)) else [request])]
        frame = self._frame()
        keys = self._sorted(frame, orders)
        return self._on(frame.df.orderBy(*keys).select(*map(quoted, frame.base))) if keys else self

    def page(self, request: PageBy | dict | str) -> Query:
        if request is None:
            raise TypeError("request is None")
        return self._on(paged(self.df, PageBy.from_json(request)))

    def select(self, fields: list[str], typed: bool = True, fill_defaults: bool = False) -> DataFrame:
        """fill_defaults keeps the entity's other columns too, with their types' defaults (typed only)."""
        frame = self._frame()
        columns = projections.project(frame, fields, typed, fill_defaults)
        return frame.df.select(*columns)

    def select_dynamic(self, fields: list[str]) -> DataFrame:
        return self.select(fields, typed=False)

    def group(self, request: GroupBy | dict | str) -> DataFrame:
        if request is None:
            raise TypeError("request is None")
        return grouping.grouped(self._frame(), GroupBy.from_json(request))

    # Filter

    def _arranged(self, orders, page: PageBy | None, selects, typed: bool) -> DataFrame:
        """Order, page, then select.  A select that joins would lose the order, so the page's few rows are sorted again by kept keys."""
        frame = self._frame()
        keys = self._sorted(frame, orders or ())
        if page is not None:
            check_page(page)
        if selects is None:
            df = frame.df.orderBy(*keys) if keys else frame.df
            return paged(df, page).select(*map(quoted, frame.base))
        if not keys:
            under = Frame(self.catalog, self.entity, paged(frame.df, page), page is not None)
            columns = projections.project(under, selects, typed)
            return under.df.select(*columns)
        names = [f"__k{i}" for i in range(len(keys))]
        ascending = self._directions(orders, len(keys))
        plain = self._key_columns(orders)
        keyed = plain.df.select(*map(quoted, plain.base), *[c.alias(n) for c, n in zip(plain.keys, names)])
        again = [sort_column(F.col(n), d) for n, d in zip(names, ascending)]
        top = paged(keyed.orderBy(*again), page)
        under = Frame(self.catalog, self.entity, top, page is not None)
        columns = projections.project(under, selects, typed)
        if under.df is top:
            return top.select(*columns)
        return under.df.select(*columns, *names).orderBy(*again).drop(*names)

    def _directions(self, orders, n: int) -> list[bool]:
        got = [o.direction is Direction.Descending for o in sorted(orders, key=lambda o: o.sort)]
        return got + [False] * (n - len(got))

    def _key_columns(self, orders):
        frame = self._frame()
        keys = []
        for o in sorted(orders, key=lambda o: o.sort):
            keys.append(frame.order_key(resolve(self.catalog, self.entity, o.field), o.direction is Direction.Descending))
        ties = self.entity.key or [f.name for f in self.entity.df.schema if f.dataType.typeName() not in ("map", "variant")]
        frame.keys = [*keys, *map(quoted, ties)]
        return frame

    def filter(self, request: Filter | dict | str, typed: bool = True) -> DataFrame:
        if request is None:
            raise TypeError("request is None")
        f = Filter.from_json(request)
        kept = self.where(f.condition_group) if f.condition_group is not None else self
        return kept._arranged(f.orders, f.page, f.selects, typed)

    def filter_dynamic(self, request: Filter | dict | str) -> DataFrame:
        return self.filter(request, typed=False)

    def to_list(self, request: Filter | dict | str, query_string: bool = False, typed: bool = True, persist: bool = False) -> Result:
        """Two jobs at most: a count over the filtered rows, which reads the columns of conditions only, and the page when rows() is asked for."""
        if request is None:
            raise TypeError("request is None")
        f = Filter.from_json(request)
        kept = self.where(f.condition_group) if f.condition_group is not None else self
        if persist:
            kept = self._on(kept.df.persist())
        data = kept._arranged(f.orders, f.page, f.selects, typed)
        return _envelope(data, kept.df.count(), f.page, query_string)

    def to_list_dynamic(self, request, query_string: bool = False, persist: bool = False) -> Result:
        return self.to_list(request, query_string, typed=False, persist=persist)

    async def to_list_async(self, request, query_string: bool = False) -> Result:
        return await asyncio.to_thread(self.to_list, request, query_string)

    async def to_list_dynamic_async(self, request, query_string: bool = False) -> Result:
        return await asyncio.to_thread(self.to_list_dynamic, request, query_string)

    # Summary

    def _groups(self, s: Summary) -> DataFrame:
        if s.group_by is None:
            raise TypeError("group_by is None")
        keys, _ = grouping.validated(self._frame(), s.group_by)
        # An order may name a key with or without its dots, or an alias.
        self._orderable = {a.alias.lower(): a.alias for a in s.group_by.aggregate_by}
        self._orderable |= {grouping.key_alias(p.text).lower(): grouping.key_alias(p.text) for p in keys}
        for o in s.orders or ():
            if not (o.field or "").strip():
                raise E.LogicError(E.INVALID_FIELD)
            if grouping.key_alias(o.field).lower() not in self._orderable:
                raise E.LogicError(E.summary_order_field(o.field))
        if s.page is not None:
            check_page(s.page)
        kept = self.where(s.condition_group) if s.condition_group is not None else self
        df = grouping.grouped(kept._frame(), s.group_by)
        if s.having is not None and (test := grouping.having(df, s.group_by, s.having)) is not None:
            df = df.where(test)
        return df

    def _summary_page(self, s: Summary, df: DataFrame) -> DataFrame:
        keys = [
            sort_column(quoted(self._orderable[grouping.key_alias(o.field).lower()]), o.direction is Direction.Descending)
            for o in sorted(s.orders or (), key=lambda o: o.sort)
        ]
        if keys:
            df = df.orderBy(*keys, *[sort_column(quoted(c), False) for c in df.columns[: len(s.group_by.fields)]])
        return paged(df, s.page)

    def summary(self, request: Summary | dict | str) -> DataFrame:
        if request is None:
            raise TypeError("request is None")
        s = Summary.from_json(request)
        return self._summary_page(s, self._groups(s))

    def to_summary(self, request: Summary | dict | str, query_string: bool = False) -> Result:
        if request is None:
            raise TypeError("request is None")
        s = Summary.from_json(request)
        df = self._groups(s)
        return _envelope(self._summary_page(s, df), df.count(), s.page, query_string)

    async def to_summary_async(self, request, query_string: bool = False) -> Result:
        return await asyncio.to_thread(self.to_summary, request, query_string)

    # Segment

    def _segment(self, s: Segment, select_after: bool) -> tuple[Query | None, DataFrame]:
        """(entity rows or None, rows).  All sets filter one source, so their fold is one predicate over one scan.

        With selects, each set's rows are new objects before the fold, so none equals another: a union keeps
        both sides, an intersection is empty, an exception removes nothing.  select_after folds first.
        """
        sets = sorted(s.condition_sets, key=lambda x: x.sort)
        if len({x.sort for x in sets}) < len(sets):
            raise E.LogicError(E.SETS_UNIQUE_SORT)
        if any(x.intersection is None for x in sets[1:]):
            raise E.LogicError(E.REQUIRED_INTERSECTION)
        frame = self._frame()
        tests = [predicates.group(frame, x.condition_group) for x in sets]
        tests = [F.lit(True) if t is None else t for t in tests]
        if s.selects is not None and not select_after:
            parts = [self._on(frame.df.where(t).select(*map(quoted, frame.base))).select(s.selects) for t in tests]
            out = parts[0]
            for x, part in zip(sets[1:], parts[1:]):
                if x.intersection is Intersection.Union:
                    out = out.unionAll(part)
                elif x.intersection is Intersection.Intersect:
                    out = out.where(F.lit(False))
            return None, out
        fold = tests[0]
        for x, t in zip(sets[1:], tests[1:]):
            fold = {Intersection.Union: lambda a, b: a | b, Intersection.Intersect: lambda a, b: a & b, Intersection.Except: lambda a, b: a & ~b}[x.intersection](fold, t)
        rows = frame.df.where(fold).select(*map(quoted, frame.base))
        return self._on(rows), rows

    def segment(self, request: Segment | dict | str, select_after: bool = False) -> DataFrame:
        return self._segment_page(Segment.from_json(request), select_after)[1]

    def _segment_page(self, s: Segment, select_after: bool) -> tuple[DataFrame, DataFrame]:
        if s.page is not None:
            check_page(s.page)
        kept, rows = self._segment(s, select_after)
        if kept is not None:
            return rows, kept._arranged(s.orders, s.page, s.selects, True)
        flat = Query(self.catalog, Entity(self.entity.name, rows))
        return rows, flat._arranged(s.orders, s.page, None, True)

    def to_segment(self, request: Segment | dict | str, select_after: bool = False) -> Result:
        if request is None:
            raise TypeError("request is None")
        s = Segment.from_json(request)
        if not s.condition_sets:
            return self.to_list(Filter(None, s.selects, s.orders, s.page))
        rows, data = self._segment_page(s, select_after)
        out = _envelope(data, rows.count(), s.page, False)
        if s.page is None:
            out.page_count = 0
        return out

    async def to_segment_async(self, request, select_after: bool = False) -> Result:
        return await asyncio.to_thread(self.to_segment, request, select_after)


def _envelope(data: DataFrame, total: int, page: PageBy | None, query_string: bool) -> Result:
    number, size = (page.page_number, page.page_size) if page is not None else (0, 0)
    return Result(data, total, number, size, math.ceil(total / (size or 1)), plan_text(data) if query_string else None)


def keyed_set(left: DataFrame, right: DataFrame, key: list[str], how: Intersection) -> DataFrame:
    """Set algebra by key for rows of different sources."""
    if how is Intersection.Intersect:
        return left.join(right.select(*key), key, "left_semi")
    if how is Intersection.Except:
        return left.join(right.select(*key), key, "left_anti")
    return left.unionByName(right.join(left.select(*key), key, "left_anti"))
