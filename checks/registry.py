"""Pairs a Spark query with the SQL that must give the same rows, and the SQL text of the shared views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES: dict[str, str] = {}

_SEC = "(epoch_us(ts)-1704067200000000)/1e6::double"
_K = "json_extract_string(props,'$.k')"
_DAY = "datediff('day', date '1990-01-01', cast(l_shipdate as date))"

VIEWS = {
    "tracking": f"""select user_id session,
  concat(case user_id % 3 when 0 then 'PC' when 1 then 'TC' else 'EC' end, '_HeadPos') stream,
  event_id frame_id, {_SEC} ts,
  case when event_type='signup' then null else value end x,
  case when event_type='signup' then null else cast({_K} as double) end y,
  cast({_K} as double)/100 p,
  case when event_type='error' then 1 else 0 end interp,
  value/10 v_provided from events""",
    "activity": f"""select event_id row_id, {_SEC} "timestamp", cast(user_id % 12 as int) cell, value rate,
  cast(cast({_K} as int) % 5 as int) spikes, cast({_K} as double)*3.6 hd from events""",
    "units": """select p_partkey cell, p_brand label, p_type subtype, p_retailprice rate,
  p_size % 2 = 0 is_hd, p_size % 3 = 0 is_grid, p_size % 5 = 0 is_border from part""",
    "rooms": """select * from (values ('A',0,cast(0 as double),cast(864000 as double)),
  ('B',1,cast(950400 as double),cast(1728000 as double)),
  ('a',0,cast(1728000 as double),cast(2592000 as double))) r(room,idx,t0,t1)""",
    "boundary": """select room, vertex_no, x::double x, y::double y from (values
  ('A',0,-0.05,-0.05),('A',1,0.95,-0.05),('A',2,0.95,0.95),('A',3,-0.05,0.95),
  ('B',0,0.0,0.0),('B',1,1.0,0.1),('B',2,0.9,1.1),('B',3,0.1,0.9),
  ('a',0,0.1,0.0),('a',1,1.1,0.3),('a',2,0.6,1.1)) b(room,vertex_no,x,y)""",
    "pred_long": f"""select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_DAY}) row_key,
  o.off offset_no, cast((l_linenumber+o.off) % 5 + 1 as int) fold,
  case l_returnflag when 'A' then 'A' when 'N' then 'a' else 'B' end actual_room, r.room predicted_room,
  case when l_linestatus='O' then 'test' else 'train' end set_name,
  l_quantity/50 x, l_extendedprice/105000 y,
  l_quantity/50*r.a + l_extendedprice/105000*r.b + (l_discount-0.05)*2 + o.off*0.01 x_pred,
  l_extendedprice/105000*r.a - l_quantity/50*r.b + (l_tax-0.04)*3 - o.off*0.01 y_pred
from lineitem
cross join (select * from (values (0),(1)) t(off)) o
cross join (select * from (values ('A',cast(1 as double),cast(0 as double)),
  ('B',cast(0.8 as double),cast(0.2 as double)),
  ('a',cast(0.9 as double),cast(-0.1 as double))) t(room,a,b)) r""",
    "ranks": """select p_partkey cell, r.room, p_retailprice*r.m + p_size score
from part cross join (select * from (values ('A',cast(1 as double)),('B',cast(-0.5 as double)),
  ('a',cast(0.25 as double))) t(room,m)) r""",
    "subsets": """select l_orderkey subset_id, list(l_partkey) cells, cast(count(*) as int) size,
  l_orderkey % 10 = 0 is_baseline, avg(l_discount)*10 r2 from lineitem group by l_orderkey""",
    "separation": "select concat(l_returnflag,'_',l_linestatus) room_pair, l_discount rate from lineitem",
    "positions": f"""select event_id row_id, {_SEC} ts, user_id session, cast(user_id % 12 as int) cell,
  value/500 x, cast({_K} as double)/100 y, cast({_K} as double)*3.6 hd, value rate,
  cast(cast({_K} as int) % 5 as int) spikes, cast({_K} as double)/100 p
from events where event_type <> 'signup'""",
}

def define(name: str, sql: str) -> None:
    """Register a further named SQL step that checks can refer to like a view."""
    VIEWS[name] = sql


def _needed(body: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\s+(?:as\s+)?\w+\s*(?:where|$)", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return order


def with_views(body: str) -> str:
    names = _needed(body)
    if not names:
        return body
    steps = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
    return f"with {steps}\nselect * from (\n{body}\n)"


def check(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query. ``doubles`` names the floating columns that both sides round to ``digits``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        cols = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols}) if cols else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        MODULES[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            full = with_views(sql)
            if cols:
                # alias rounds a column in place; the + 0.0 turns a negative zero into zero
                repl = ", ".join(f"round({c}::double, {digits}) + 0.0::double as {c}" for c in cols)
                full = f"select * replace ({repl}) from (\n{full}\n)"
            ORACLE[name] = full
        return fn

    return register
