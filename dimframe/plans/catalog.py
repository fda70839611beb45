"""The registered queries over the test tables and their SQL.

Cube A: lineitem as return flag x line status x line number x supplier, mean
quantity. Cube B: events as type (chan) x hour (time) x user_id % 5 (id), mean
value; some combinations may be missing. Cube E: the components of embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Dim, DimFrame, densified, from_long
from ..functions import geometry as geo
from ..functions import predicates as pr
from ..operators import aggregate as ag
from ..operators import align as al
from ..operators import anova as an
from ..operators import artifacts as ar
from ..operators import clusters as cl
from ..operators import contrasts as co
from ..operators import convert as cv
from ..operators import inference as inf
from ..operators import permutation as pm
from ..operators import permuted as pe
from ..operators import results as rs
from ..operators import sequence as sq
from ..operators import shape as sh
from ..operators import ttest as tt
from ..operators import windows as wi
from ..sources.tables import cube_of, read
from . import transform as tf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLAGS, STATUS = ("A", "N", "R"), ("F", "O")
CHANS = ("click", "error", "purchase", "signup", "view")
A_SQL = "a as (select l_returnflag, l_linestatus, l_linenumber, l_suppkey, avg(l_quantity) as value from lineitem group by all)"
B_SQL = "b as (select event_type as chan, cast(hour(ts) as int) as time, cast(user_id % 5 as int) as id, avg(value) as value from events group by all)"
#: Cube B with a null where (hour + id) % 7 = 0.
N_SQL = B_SQL + ", n as (select chan, time, id, case when (time + id) % 7 = 0 then null else value end as value from b)"


def cube_a(spark: SparkSession, d: str) -> DimFrame:
    cols = {c: F.col(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")}
    return cube_of(read(spark, d, "lineitem"), cols, F.col("l_quantity"), {"l_returnflag": FLAGS, "l_linestatus": STATUS})


def cube_b(spark: SparkSession, d: str) -> DimFrame:
    cols = {"chan": F.col("event_type"), "time": F.hour("ts").cast("int"), "id": (F.col("user_id") % 5).cast("int")}
    return cube_of(read(spark, d, "events"), cols, F.col("value"), {"chan": CHANS})


def cube_n(spark: SparkSession, d: str) -> DimFrame:
    b = cube_b(spark, d)
    return b.but(b.df.withColumn("value", F.when((F.col("time") + F.col("id")) % 7 == 0, None).otherwise(F.col("value"))))


def rounded(df: DimFrame | DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    df = df.long() if isinstance(df, DimFrame) else df
    return df.withColumns({c: F.round(c, digits) for c in columns or ("value",)})


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


@query(f"""with {A_SQL}, m as (select l_returnflag, l_linestatus, l_linenumber, avg(value) as value from a group by all)
select y.l_returnflag || '-' || x.l_returnflag as l_returnflag, x.l_linestatus, x.l_linenumber, round(y.value - x.value, 6) as value
from m x join m y on x.l_linestatus = y.l_linestatus and x.l_linenumber = y.l_linenumber and x.l_returnflag < y.l_returnflag""")
def contrasts_pairwise(spark, d):
    return rounded(co.compare_levels(ag.avg_dims(cube_a(spark, d), "l_suppkey"), "l_returnflag"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return contrasts_pairwise(spark, d)


# ---- selection and predicates


@query(f"with {A_SQL} select l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(value, 6) as value from a where l_returnflag in ('A', 'R') and l_linenumber between 2 and 5 and value > 25")
def subset_predicates(spark, d):
    a = sh.subset(cube_a(spark, d), l_returnflag=["R", "A"], l_linenumber=lambda c: c.between(2, 5))
    return rounded(pr.select_values(a, pr.is_between(25, float("inf"), open="lwr")))


@query(f"with {B_SQL} select chan, time, id, round(case when chan = 'view' and time <= 6 then 0 else value end, 6) as value from b")
def subset_assign(spark, d):
    return rounded(sh.assign(cube_b(spark, d), 0.0, {"chan": "view", "time": lambda c: c <= 6}))


@query(f"with {B_SQL} select b.chan, b.time, b.id, round(coalesce(s.value, b.value), 6) as value from b left join (select chan, time, id, value * 2 as value from b where id = 3) s using (chan, time, id)")
def assign_frame(spark, d):
    b = cube_b(spark, d)
    return rounded(sh.assign(b, b.df.where("id = 3").withColumn("value", F.col("value") * 2)))


@query(f"with {B_SQL}, s as (select chan, id, value between 40 and 60 as hit from b where time = 12) select b.chan, b.time, b.id, coalesce(s.hit, false) as hit from b left join s using (chan, id)")
def predicate_expand(spark, d):
    return pr.marked(cube_b(spark, d), pr.is_between(60, 40).options(expand={"time": 12})).select("chan", "time", "id", "hit")


@query(f"with {B_SQL} select chan, time, id, not (time <= 6 and value > 50) as hit from b")
def predicate_slice_negated(spark, d):
    return pr.marked(cube_b(spark, d), ~pr.is_between(50, float("inf"), "lwr").options(subset={"time": lambda c: c <= 6})).select("chan", "time", "id", "hit")


@query(f"""with {B_SQL}, p as (select *, value > 50 as strict, value > 100000 as rare, value > 60 as frequent from b), x as (select bool_or(strict and rare) as r, bool_or(strict and frequent) as f from p)
select chan, time, id, case when x.r then strict and rare else strict end as rare, case when x.f then strict and frequent else strict end as frequent from p, x""")
def predicate_optional(spark, d):
    b, strict = cube_b(spark, d), pr.is_between(50, float("inf"), "lwr")
    maybe = lambda x: pr.is_between(x, float("inf"), "lwr").options(strict=False)
    rows = pr.marked(b, strict & maybe(100000.0), "rare")
    return pr.marked(b.but(rows), strict & maybe(60.0), "frequent").select("chan", "time", "id", "rare", "frequent")


@query(f"with {B_SQL} select chan, time, id, (value > 50) != (value < 55) as x, (value > 50) or (value < 20) as o, abs(value - 50) <= 1 as e from b")
def predicate_combined(spark, d):
    b = cube_b(spark, d)
    up, low = pr.is_between(50, float("inf"), "lwr"), pr.is_between(-float("inf"), 55, "upr")
    rows = pr.marked(b, up ^ low, "x")
    rows = pr.marked(b.but(rows), up | pr.is_between(-float("inf"), 20, "upr"), "o")
    return pr.marked(b.but(rows), pr.is_equal(50, 1), "e").select("chan", "time", "id", "x", "o", "e")


@query(f"with {B_SQL} select chan, time, id, round(value, 6) as value, cast(list_position(['click', 'error', 'purchase', 'signup', 'view'], chan) as bigint) as index_chan, dense_rank() over (order by time) as index_time, dense_rank() over (order by id) as index_id from b qualify value > 60")
def select_values(spark, d):
    return rounded(pr.select_values(cube_b(spark, d), pr.is_between(60, float("inf"), "lwr"), with_index=True))


@query(f"with {A_SQL} select case l_returnflag when 'A' then 'R' when 'R' then 'A' else l_returnflag end as flag, l_linestatus, l_linenumber, l_suppkey, round(value, 6) as value from a")
def replace_levels(spark, d):
    return rounded(sh.recode(cube_a(spark, d), {"l_returnflag": {"A": "R", "R": "A"}}, {"l_returnflag": "flag"}))


# ---- shape


@query(f"""with {A_SQL} select l_linestatus, l_linenumber, l_suppkey, round(max(case when l_returnflag = 'A' then value end), 6) as a, round(max(case when l_returnflag = 'N' then value end), 6) as n, round(max(case when l_returnflag = 'R' then value end), 6) as r
from a group by 1, 2, 3""")
def pivot_measures(spark, d):
    wide = sh.pivoted(cube_a(spark, d), "l_returnflag", FLAGS)
    return wide.select("l_linestatus", "l_linenumber", "l_suppkey", *[F.round(F.col(f"`value.l_returnflag_{f}`"), 6).alias(f.lower()) for f in FLAGS])


@query(f"with {A_SQL} select l_returnflag || '.' || l_linestatus as cell, l_linenumber, l_suppkey, round(value, 6) as value from a")
def merge_dims(spark, d):
    return rounded(sh.merge_dims(cube_a(spark, d), ["l_returnflag", "l_linestatus"], "cell"))


@query(f"with {A_SQL} select l_returnflag as flag, l_linestatus as status, l_linenumber, l_suppkey, round(value, 6) as value from a")
def dim_to_multidim(spark, d):
    merged = sh.merge_dims(cube_a(spark, d), ["l_returnflag", "l_linestatus"], "cell")
    table = merged.df.select("cell").distinct().select("cell", F.split_part("cell", F.lit("."), F.lit(1)).alias("flag"), F.split_part("cell", F.lit("."), F.lit(2)).alias("status"))
    return rounded(sh.dim_to_multidim(merged, "cell", table))


@query(f"with {A_SQL}, m as (select l_returnflag, l_suppkey, avg(value) as m from a group by all) select l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(m, 6) as expanded from a join m using (l_returnflag, l_suppkey)")
def expand_into(spark, d):
    a = cube_a(spark, d)
    return rounded(sh.expand_into(ag.avg_dims(a, "l_linestatus", "l_linenumber"), a), "expanded")


@query(f"""with {A_SQL}, s as (select l_returnflag, case l_linestatus when 'F' then 'O' else 'F' end as l_linestatus, avg(value) as v from a group by all), n as (select distinct l_linenumber, dense_rank() over (order by l_linenumber) - 1 as k from a),
t as (select l_returnflag, l_linenumber, avg(value) as v from a where l_linenumber <= 3 group by all)
select a.l_returnflag, a.l_linestatus, a.l_linenumber, a.l_suppkey, round(s.v, 6) as swapped, round(t.v, 6) as recycled from a left join s using (l_returnflag, l_linestatus) join n on n.l_linenumber = a.l_linenumber left join t on t.l_returnflag = a.l_returnflag and t.l_linenumber = n.k % 3 + 1""")
def expand_levels(spark, d):
    """Means on the grid of all cells: levels of one dimension crossed over, those of another repeated in their order."""
    a = cube_a(spark, d)
    swapped = sh.expand_into(ag.avg_dims(a, "l_linenumber", "l_suppkey"), a, "swapped", {"l_linestatus": ["O", "F"]})
    few = sh.subset(ag.avg_dims(a, "l_linestatus", "l_suppkey"), l_linenumber=lambda c: c <= 3)
    recycled = sh.expand_into(few, a, "recycled", safe=False)
    return rounded(swapped.df.join(recycled.df, a.names), "swapped", "recycled")


@query(f"with {A_SQL} select *, 'raw' as kind from (select l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(value, 6) as value from a) union all select l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(value * 2, 6), 'double' from a")
def bind_new_dim(spark, d):
    a = cube_a(spark, d)
    return rounded(sh.bind({"raw": a, "double": a.but(a.df.withColumn("value", F.col("value") * 2))}, "kind"))


@query(f"""with {A_SQL}, m as (select l_returnflag, l_linenumber, avg(value) as value from a group by all), x as (select * from m where l_returnflag = 'A' and l_linenumber <= 4 union all select * from m where l_returnflag = 'R' and l_linenumber >= 3)
select f.l_returnflag, n.l_linenumber, round(coalesce(x.value, -1), 6) as value from (select distinct l_returnflag from x) f cross join (select distinct l_linenumber from x) n left join x on x.l_returnflag = f.l_returnflag and x.l_linenumber = n.l_linenumber""")
def merge_arrays(spark, d):
    m = ag.avg_dims(cube_a(spark, d), "l_linestatus", "l_suppkey")
    one = sh.subset(m, l_returnflag=["A"], l_linenumber=lambda c: c <= 4)
    return rounded(sh.merge_cubes([one, sh.subset(m, l_returnflag=["R"], l_linenumber=lambda c: c >= 3)], -1.0))


@query(f"with {A_SQL} select case when l_linenumber <= 3 then 'few' else 'many' end as grp, l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(value, 6) as value from a where l_linenumber <= 5")
def split_groups(spark, d):
    groups = {k: "few" if k <= 3 else "many" for k in range(1, 6)}
    return rounded(sh.split_groups(cube_a(spark, d), "l_linenumber", groups, "grp"))


@query("""with v as (select cast(o_orderkey as varchar) as a, cast(cast(o_orderdate as date) as varchar) as b, o_orderpriority as c from orders)
select 'a' as "column", count(a) as n_n, count(*) filter (where upper(a) in ('TRUE', 'FALSE', 'T', 'F')) as n_boolean, count(try_cast(a as int)) as n_int, count(try_cast(a as double)) as n_double, count(try_cast(a as date)) as n_date from v
union all select 'b', count(b), 0, count(try_cast(b as int)), count(try_cast(b as double)), count(try_cast(b as date)) from v union all select 'c', count(c), 0, count(try_cast(c as int)), count(try_cast(c as double)), count(try_cast(c as date)) from v""")
def auto_convert_report(spark, d):
    v = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderdate").cast("date").cast("string").alias("b"), F.col("o_orderpriority").alias("c"))
    return cv.convertible(v, ["a", "b", "c"])


#: A rule of a user's own: codes such as 1-URGENT become their number, if all have one.
CODES = cv.Rule(lambda f: f.name.endswith("priority"), {"month": lambda c: c.try_cast("date"), "rank": lambda c: F.regexp_extract(c, r"^(\d)-", 1).try_cast("int")}, lambda c, made: c.startswith(F.concat(made.cast("string"), F.lit("-"))))


@query("""with v as (select cast(split_part(o_orderpriority, '-', 1) as int) as o_orderpriority, o_orderstatus, o_orderdate::date as o_orderdate, o_orderkey::int as k from orders)
select o_orderpriority, o_orderstatus, min(o_orderdate) as o_orderdate, sum(k)::bigint as k from v group by 1, 2""")
def convert_rules(spark, d):
    """Columns converted by a user's rule first and the standard one for the rest."""
    text = read(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), F.col("o_orderkey").cast("string").alias("k"))
    made = cv.auto_convert(text, rules={"codes": CODES, **cv.STANDARD})
    return made.groupBy("o_orderpriority", "o_orderstatus").agg(F.min("o_orderdate").alias("o_orderdate"), F.sum("k").alias("k"))


@query(f"with {A_SQL}, m as (select l_returnflag, l_linestatus, l_suppkey % 2 as grp, avg(value) as value from (select l_returnflag, l_linestatus, l_suppkey, avg(value) as value from a group by all) group by all) select grp, l_returnflag, round(stddev_samp(value), 6) as value from m group by all")
def transform_pipeline(spark, d):
    a = ag.avg_dims(cube_a(spark, d), "l_linenumber")
    by = a.df.withColumn("grp", F.col("l_suppkey") % 2)
    return rounded(tf.transform(a.but(by, [Dim("grp"), *a.dims]), average=["l_suppkey"], fun=lambda c: ag.gfp(c, "l_linestatus")))


@query(f"with {A_SQL}, s as (select *, value - avg(value) over (partition by l_returnflag, l_linestatus, l_linenumber) as z from a) select l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(z, 6) as value from s")
def chunked_center(spark, d):
    return rounded(sh.chunked(cube_a(spark, d), "l_linenumber", 3, lambda c: sq.scaled(c, ["chunk", "l_returnflag", "l_linestatus", "l_linenumber"], scale=False)))


# ---- aggregates


@query(f"with {A_SQL} select l_returnflag, l_linestatus, round(avg(value), 6) as value from a group by 1, 2")
def avg_dims(spark, d):
    return rounded(ag.avg_dims(cube_a(spark, d), "l_linenumber", "l_suppkey"))


@query(f"with {N_SQL} select chan, time, round(case when count(value) = count(*) then avg(value) end, 6) as value from n group by 1, 2")
def avg_dims_strict(spark, d):
    return rounded(ag.avg_dims(cube_n(spark, d), "id", na_rm=False))


@query(f"with {B_SQL} select chan, id, round(max(value) - min(value), 6) as value from b group by 1, 2")
def fn_dims(spark, d):
    return rounded(ag.fn_dims(cube_b(spark, d), ["time"], lambda v: F.max(v) - F.min(v), aggregate=True))


@query(f"with {B_SQL} select chan, id, round(quantile_cont(value, 0.5), 6) as value from b group by 1, 2")
def fn_dims_udf(spark, d):
    import numpy as np

    return rounded(ag.fn_dims(cube_b(spark, d), ["time"], lambda v: float(np.median(v))))


@query(f"with {N_SQL} select chan, id, avg(time) as time, round(case when count(value) = count(*) then avg(value) end, 6) as value from n where time < 20 group by chan, id, time // 5")
def avg_bin(spark, d):
    return rounded(ag.avg_bin(cube_n(spark, d), "time", 5))


@query(f"with {B_SQL} select chan, id, case when time < 8 then 'night' when time < 16 then 'day' else 'late' end as time, round(avg(value), 6) as value from b group by all")
def avg_bin_codes(spark, d):
    code = F.when(F.col("time") < 8, "night").when(F.col("time") < 16, "day").otherwise("late")
    return rounded(ag.avg_codes(cube_b(spark, d), "time", code))


@query(f"with {N_SQL} select time, id, round(case when count(value) = count(*) then stddev_samp(value) end, 6) as value from n group by 1, 2")
def gfp(spark, d):
    return rounded(ag.gfp(cube_n(spark, d)))


@query(f"with {B_SQL} select chan, time, id, round(value, 6) as value from b union all select 'GFP', time, id, round(stddev_samp(value), 6) from b group by 2, 3")
def gfp_keep(spark, d):
    return rounded(ag.gfp(cube_b(spark, d), keep=True))


@query(f"""with {A_SQL} select l_returnflag, l_linestatus, case when grouping(l_linestatus) = 1 then 'l_returnflag' when grouping(l_returnflag) = 1 then 'l_linestatus' else 'l_returnflag:l_linestatus' end as modelterm, round(avg(value), 6) as value, count(value) as freq
from a group by grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))""")
def marginal_means(spark, d):
    return rounded(ag.marginal_means(cube_a(spark, d), ["l_returnflag", "l_linestatus"]))


@query(f"""with {A_SQL}, r1 as (select *, value - avg(value) over (partition by l_returnflag) as r from a), r2 as (select *, r - avg(r) over (partition by l_linestatus) as q from r1)
select l_returnflag, null as l_linestatus, round(avg(value), 6) as value, count(value) as freq, 'l_returnflag' as modelterm from a group by 1
union all select null, l_linestatus, round(avg(r), 6), count(r), 'l_linestatus' from r1 group by 2 union all select l_returnflag, l_linestatus, round(avg(q), 6), count(q), 'l_returnflag:l_linestatus' from r2 group by 1, 2""")
def marginal_means_sequential(spark, d):
    return rounded(ag.sequential_means(cube_a(spark, d), ["l_returnflag", "l_linestatus"]))


@query(f"with {A_SQL}, c as (select l_returnflag, s_nationkey % 2 as grp, avg(value) as value from a join supplier on l_suppkey = s_suppkey group by all) select l_returnflag, round(avg(value), 6) as value from c group by 1")
def model_means_adjusted(spark, d):
    a = with_groups(spark, d, cube_a(spark, d))
    return rounded(ag.model_means(a, ["l_returnflag"], ["l_returnflag", "grp"], adjusted=True))


def with_groups(spark: SparkSession, d: str, cube: DimFrame) -> DimFrame:
    """Cube A with ``grp``, the parity of the supplier's nation."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 2).alias("grp"))
    return cube.but(cube.df.join(s, "l_suppkey"), cube.dims)


@query("select l_returnflag, l_linestatus, count(*) as freq, min(l_orderkey) as first from lineitem group by 1, 2")
def unique_freq(spark, d):
    return ag.unique_rows(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query(f"with {A_SQL}, r as (select l_returnflag, l_linestatus, l_linenumber, cast(cast(round(avg(value), 0) as int) as varchar) as v from a group by all) select l_returnflag, l_linestatus, string_agg(v, '' order by l_linenumber) as value from r group by 1, 2")
def collapse_strings(spark, d):
    m = ag.avg_dims(cube_a(spark, d), "l_suppkey")
    return ag.collapsed(m.but(m.df.withColumn("value", F.round("value", 0).cast("int").cast("string"))), "l_linenumber").long()


@query(f"with {B_SQL} select chan, id, time % 3 as code, round(sum(value), 6) as value from b group by 1, 2, 3")
def group_sums(spark, d):
    return rounded(ag.group_sums(cube_b(spark, d), "time", F.col("time") % 3))


@query(f"""with {B_SQL}, p as (select chan, time, value > 50 as hit, abs(value) as v from b)
select chan, round(min(case when hit then v end), 6) as value_min, round(quantile_cont(case when hit then v end, 0.5), 6) as value_median, round(max(case when hit then v end), 6) as value_max, count(*) filter (where hit) as size, round(count(*) filter (where hit) / count(*), 6) as ratio from p group by 1""")
def summary(spark, d):
    out = ag.summarised(cube_b(spark, d).df, ["chan"], ["value"], F.col("value") > 50, ["value"])
    return rounded(out, "value_min", "value_median", "value_max", "ratio")


@query(f"with {B_SQL}, m as (select chan, time, id, value from b), g as (select case when time % 2 = 0 then 'even' else 'odd' end as f, time from (select distinct time from b)) select chan, id, f as factor_level, round(avg(value), 6) as value from m join g using (time) group by 1, 2, 3")
def avg_trials(spark, d):
    b = sh.recode(cube_b(spark, d), names={"time": "trial"})
    markers = b.df.select("trial").distinct().withColumn("f", F.when(F.col("trial") % 2 == 0, "even").otherwise("odd"))
    return rounded(ag.avg_trials(b, markers, ["f"]))


# ---- series

_W5 = "over (partition by chan, id order by time rows between 2 preceding and 2 following)"


def _roll(stat: str, sql: str):
    @query(f"with {B_SQL} select chan, time, id, round({sql} {_W5}, 6) as value from b", f"roll_{stat}")
    def run(spark, d):
        return rounded(sq.rolled(cube_b(spark, d), "time", 5, stat))

    return run


for _stat, _sql in (("mean", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("sd", "stddev_samp(value)"), ("median", "quantile_cont(value, 0.5)")):
    _roll(_stat, _sql)


#: A width for each hour: 1 to 8.
_WIDTHS_SQL = "n as (select *, 1 + time * 5 % 8 as w, row_number() over (partition by chan, id order by time) as k from b), j as (select n.chan, n.time, n.id, m.value as v from n join n m on m.chan = n.chan and m.id = n.id and m.k between n.k - n.w // 2 and n.k + n.w - 1 - n.w // 2)"


def _roll_widths(stat: str, sql: str):
    @query(f"with {B_SQL}, {_WIDTHS_SQL} select chan, time, id, round({sql}, 6) as value from j group by 1, 2, 3", f"roll_widths_{stat}")
    def run(spark, d):
        return rounded(wi.rolled_by(cube_b(spark, d), "time", 1 + F.col("time") * 5 % 8, stat))

    return run


for _stat, _sql in (("mean", "avg(v)"), ("sd", "stddev_samp(v)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "quantile_cont(v, 0.5)")):
    _roll_widths(_stat, _sql)


@query(f"with {B_SQL} select chan, time, id, round(quantile_cont(value, 0.25) {_W5}, 6) as value from b")
def roll_quantile(spark, d):
    return rounded(sq.rolled(cube_b(spark, d), "time", 5, "quantile", prob=0.25))


@query(f"with {B_SQL} select chan, time, id, round((max(value) {_W5} - min(value) {_W5}) / (1 + abs(avg(value) {_W5})), 6) as value from b")
def roll_function(spark, d):
    """A function of one's own of each window: its range against its mean."""
    return rounded(wi.rolled_by(cube_b(spark, d), "time", 5, lambda w: np.ptp(w, 1) / (1 + np.abs(w.mean(1)))))


@query(f"with {B_SQL}, w as (select *, list(value) {_W5} as l from b), m as (select *, list_median(l) as md from w) select chan, time, id, round(1.4826 * list_median(list_transform(l, lambda x: abs(x - md))), 6) as value from m")
def roll_mad(spark, d):
    return rounded(sq.rolled(cube_b(spark, d), "time", 5, "mad"))


@query(f"with {B_SQL}, c as (select *, value - avg(value) over (partition by chan, id) as z from b) select chan, time, id, round(z / sqrt(sum(z * z) over (partition by chan, id) / (count(z) over (partition by chan, id) - 1)), 6) as value from c")
def scale_array(spark, d):
    return rounded(sq.scaled(cube_b(spark, d), ["chan", "id"]))


@query(f"""with {B_SQL}, c as (select *, value - avg(case when time <= 6 then value end) over (partition by chan, id) as z from b)
select chan, time, id, round(z / sqrt(sum(case when time <= 6 then z * z end) over (partition by chan, id) / (count(case when time <= 6 then z end) over (partition by chan, id) - 1)), 6) as value from c""")
def scale_base(spark, d):
    return rounded(sq.scaled(cube_b(spark, d), ["chan", "id"], base={"time": lambda c: c <= 6}))


@query(f"with {B_SQL} select chan, time, id, round((value - avg(value) over w) / stddev_samp(value) over w, 6) as value from b window w as (partition by time, id)")
def scale_channels(spark, d):
    return rounded(sq.scaled_channels(cube_b(spark, d)))


@query(f"with {N_SQL} select chan, time, id, round(value - avg(case when time <= 5 then value end) over (partition by chan, id), 6) as value from n")
def baseline(spark, d):
    return rounded(sq.baseline(cube_n(spark, d), ["chan", "id"], {"time": lambda c: c <= 5}))


def flagged(spark: SparkSession, d: str) -> DimFrame:
    """Cube B as 1 where the value is over 50, else 0."""
    b = cube_b(spark, d)
    return b.but(b.df.withColumn("value", (F.col("value") > 50).cast("int")))


_RUNS = f"""with {B_SQL}, f as (select chan, time, id, cast(value > 50 as int) as v, value from b), l as (select *, case when v = lag(v) over (partition by chan, id order by time) then 0 else 1 end as new from f),
r as (select *, sum(new) over (partition by chan, id order by time) as run from l)"""


@query(_RUNS + " select chan, id, cast(run as bigint) as run, v as value, count(*) as length, min(time) as first, max(time) as last from r group by chan, id, run, v")
def rle(spark, d):
    return sq.rle(flagged(spark, d), "time")


@query(_RUNS + " select chan, id, v as value, row_number() over (partition by chan, id order by time) as place from r")
def inverse_rle(spark, d):
    return sq.inverse_rle(sq.rle(flagged(spark, d), "time"), ["chan", "id"]).withColumn("place", F.col("place").cast("long"))


@query(_RUNS + ", n as (select chan, id, run, sum(v) as n from r group by all) select chan, id, cast(max(n) as bigint) as longest from n group by 1, 2")
def longest_run(spark, d):
    return sq.longest_run(cube_b(spark, d), "time", F.col("value") > 50)


@query(f"""with {B_SQL}, p as (select chan, time, id, value / 200 as value from b), l as (select *, value <= 0.25 as v, case when (value <= 0.25) = lag(value <= 0.25) over (partition by chan, id order by time) then 0 else 1 end as new from p),
r as (select *, sum(new) over (partition by chan, id order by time) as run from l) select chan, time, id, round(case when v and count(*) over (partition by chan, id, run) >= 3 then value else 1 end, 6) as value from r""")
def p_consec(spark, d):
    b = cube_b(spark, d)
    return rounded(sq.consecutive_p(b.but(b.df.withColumn("value", F.col("value") / 200)), "time", 0.25, 3))


@query(f"""with {B_SQL}, c as (select *, case when value > 60 then 2 when value > 50 then 1 else 0 end as code from b), l as (select *, case when code = lag(code) over (partition by chan, id order by time) then 0 else 1 end as new from c),
r as (select *, sum(new) over (partition by chan, id order by time) as run from l) select chan, id, code, min(time) as start, max(time) as "end" from r where code > 0 group by chan, id, run, code""")
def sig_phases(spark, d):
    return sq.phases(cube_b(spark, d), "time", F.when(F.col("value") > 60, 2).when(F.col("value") > 50, 1).otherwise(0))


def plateaus(spark: SparkSession, d: str) -> DimFrame:
    b = cube_b(spark, d)
    return b.but(b.df.withColumn("value", F.floor(F.col("value") / 10).cast("double")))


_PLATEAUS = f"""with {B_SQL}, f as (select chan, time, id, cast(floor(value / 10) as double) as v from b), l as (select *, case when v = lag(v) over (partition by chan, id order by time) then 0 else 1 end as new from f),
r as (select *, sum(new) over (partition by chan, id order by time) as run from l), g as (select chan, id, run, any_value(v) as v, count(*) as n from r group by chan, id, run)"""
_CODES = """, c as (select *, case when max(v) over e - min(v) over e <= 1.5e-8 then 3 when n = 1 and (lag(run) over w is null or lead(run) over w is null) then 0 when v >= max(v) over near then 2 when v <= min(v) over near then 1 else 0 end as code
from g window w as (partition by chan, id order by run), e as (partition by chan, id), near as (partition by chan, id order by run rows between {0} and {1}))"""


@query(f"with {B_SQL}, m as (select chan, id, max(value) as top from b group by 1, 2) select chan, time, id, coalesce(abs(value - top) <= 1.5e-8, false) and time > 2 as hit from b join m using (chan, id)")
def predicate_reference(spark, d):
    """Cells equal to a cube of two dimensions, the largest value of each series, and after the third hour."""
    b = cube_b(spark, d)
    top = ag.fn_dims(b, ["time"], F.max, aggregate=True)
    return pr.marked(b, pr.is_equal_to(top).options(subset={"time": lambda c: c > 2})).select("chan", "time", "id", "hit")


@query(f"with {B_SQL}, c as (select *, dense_rank() over (order by chan) as k, dense_rank() over (order by time) as h from b) select chan, time, id, round(value, 6) as value from c where k not in (2, 5) and h % 2 = 1")
def subset_places(spark, d):
    """Levels by place: all but two of one dimension, every other one of another."""
    return rounded(sh.subset_at(cube_b(spark, d), chan=[-2, -5], time=[True, False]))


@query(_PLATEAUS + _CODES.format("1 preceding", "1 following") + " select chan, time, id, coalesce(code in (2, 3) and v between 5 and 9, false) or (chan = 'view' and v < 2) as hit from (select chan, time, id, run, v from r) join (select chan, id, run, code from c) using (chan, id, run)")
def predicate_extremum(spark, d):
    """Local maxima within a range, or low values of a channel: extrema combined like other predicates."""
    high = pr.is_local_maximum("time", constant=2) & pr.is_between(5, 9)
    return pr.marked(plateaus(spark, d), high | pr.is_between(2, float("-inf"), "upr").options(subset={"chan": "view"})).select("chan", "time", "id", "hit")


@query(_PLATEAUS + _CODES.format("1 preceding", "1 following") + " select chan, time, id, cast(code as int) as value from r join c using (chan, id, run)")
def extrema_local(spark, d):
    return sq.extrema(plateaus(spark, d), "time").long()


@query(_PLATEAUS + _CODES.format("unbounded preceding", "unbounded following") + " select chan, time, id, cast(code as int) as value from r join c using (chan, id, run)")
def extrema_global(spark, d):
    return sq.extrema(plateaus(spark, d), "time", global_=True).long()


@query(_PLATEAUS + _CODES.format("1 preceding", "1 following") + """, x as (select r.chan, r.time, r.id, r.v, c.code, rank() over (partition by r.chan, r.id, c.code order by case when c.code = 1 then r.v else -r.v end) as k from r join c using (chan, id, run))
select chan, time, id, cast(case when code in (1, 2) and k > 2 then 0 else code end as int) as value from x""")
def extrema_topn(spark, d):
    return sq.extrema(plateaus(spark, d), "time", top=2).long()


@query(f"with {B_SQL} select chan, time, id, round(abs(value - lag(value) over (partition by chan, id order by time)), 6) as value from b")
def differences(spark, d):
    return rounded(sq.differences(cube_b(spark, d), "time"))


@query(f"with {B_SQL}, f as (select chan, time, id, floor(value / 10) as v from b) select chan, time, id, count(*) over (partition by time, id order by v range between unbounded preceding and current row) as value from f")
def ranks(spark, d):
    return sq.ranks(plateaus(spark, d), ["time", "id"]).long()


@query(f"with {B_SQL}, m as (select *, avg(value) over (partition by chan, id order by time rows between 1 preceding and 1 following) as am from b) select chan, id, arg_max(time, value) as peak, round(arg_max(am, value), 6) as amplitude from m where time between 6 and 18 group by 1, 2")
def peaks(spark, d):
    return rounded(sq.peaks(cube_b(spark, d), "time", 6, 18, around=1), "amplitude")


_ARTIFACTS = f"""with {B_SQL}, s as (select chan, time, id as trial, value, abs(value - lag(value) over w) as step, case when count(*) over f = 4 then max(value) over f - min(value) over f end as rng from b
window w as (partition by chan, id order by time), f as (partition by chan, id order by time rows between 3 preceding and current row)),
x as (select chan, trial, coalesce(bool_or(step > 72), false) as bad_step, coalesce(bool_or(rng < 2 or rng > 60), false) as bad_range, coalesce(bool_or(value < 20 or value > 90), false) as bad_value from s group by 1, 2)"""


def found_artifacts(spark: SparkSession, d: str) -> DataFrame:
    b = sh.recode(cube_b(spark, d), names={"id": "trial"})
    return ar.artifacts(b, ar.ArtifactOptions(72, 2, 60, 4, 20, 90, 1000))


@query(_ARTIFACTS + " select * from x")
def artifact_trials(spark, d):
    return found_artifacts(spark, d)


@query(_ARTIFACTS + """, u as (select chan, trial, 'bad_step' as crit, bad_step as bad from x union all select chan, trial, 'bad_range', bad_range from x union all select chan, trial, 'bad_value', bad_value from x),
e as (select * from u union all select 'all', trial, crit, bool_or(bad) from u group by trial, crit union all select chan, trial, 'all', bool_or(bad) from u group by chan, trial union all select 'all', trial, 'all', bool_or(bad) from u group by trial)
select chan, crit, round(avg(cast(bad as double)), 6) as share from e group by 1, 2""")
def artifact_summary(spark, d):
    return rounded(ar.artifact_summary(found_artifacts(spark, d)), "share")


@query(_ARTIFACTS + " select b.chan, b.time, b.id as trial, round(b.value, 6) as value from b where b.id not in (select trial from x where bad_step)")
def artifact_reject(spark, d):
    b = sh.recode(cube_b(spark, d), names={"id": "trial"})
    return rounded(ar.reject(b, found_artifacts(spark, d).withColumns({"bad_range": F.lit(False), "bad_value": F.lit(False)})))


@query("select event_id, user_id, cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id range between unbounded preceding and current row) as bigint) as segmind from events")
def segment_numbers(spark, d):
    return ar.segment_numbers(read(spark, d, "events"), "event_id", F.col("event_type") == "signup", ["user_id"]).select("event_id", "user_id", "segmind")


@query("select s.event_id, a.event_id as position, cast(s.event_id - a.event_id as int) as \"offset\", round(s.value, 6) as value from events a join events s on s.event_id between a.event_id - 2 and a.event_id + 3 where a.event_type = 'error'")
def segments(spark, d):
    e = read(spark, d, "events")
    anchors = e.where("event_type = 'error'").select(F.col("event_id").alias("position"))
    return rounded(ar.segments(e.select("event_id", "value"), anchors, -2, 3, "event_id").select("event_id", "position", "offset", "value"))


@query("""with i as (select user_id, event_id as start, event_id + 500 as stop from events where value > 200)
select event_id, user_id, round(case when exists (select 1 from i where i.user_id = e.user_id and e.event_id between start and stop) then null else value end, 6) as value from events e""")
def interval_mask(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "value")
    bad = e.where("value > 200").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 500).alias("stop"))
    return rounded(ar.blanked(e, bad, ["user_id"], "event_id"))


# ---- contrasts and statistics


@query(f"""with {A_SQL}, m as (select l_linestatus, l_linenumber, avg(case when l_returnflag = 'A' then value end) as a, avg(case when l_returnflag = 'N' then value end) as n, avg(case when l_returnflag = 'R' then value end) as r from a group by 1, 2)
select '(0.5*A+0.5*N)-R' as l_returnflag, l_linestatus, l_linenumber, round(0.5 * a + 0.5 * n - r, 6) as value from m""")
def contrasts_custom(spark, d):
    return rounded(co.compare_levels(ag.avg_dims(cube_a(spark, d), "l_suppkey"), "l_returnflag", [{"A": 0.5, "N": 0.5, "R": -1}]))


@query(f"with {A_SQL}, m as (select l_returnflag, l_linestatus, avg(value) as s from a group by all) select l_returnflag, l_linestatus, l_linenumber, l_suppkey, round(value / s, 6) as value from a join m using (l_returnflag, l_linestatus)")
def sweep(spark, d):
    a = cube_a(spark, d)
    stats = a.df.groupBy("l_returnflag", "l_linestatus").agg(F.avg("value").alias("stat"))
    return rounded(co.sweep(a, stats, ["l_returnflag", "l_linestatus"], "/"))


@query(f"""with {A_SQL}, m as (select l_returnflag, l_linestatus, avg(value) as v from a group by all), c as (select x.l_returnflag as a1, y.l_returnflag as a2, x.v - xo.v as p, y.v - yo.v as q from m x join m xo on x.l_returnflag = xo.l_returnflag and x.l_linestatus = 'O' and xo.l_linestatus = 'F'
join m y on y.l_linestatus = 'O' join m yo on y.l_returnflag = yo.l_returnflag and yo.l_linestatus = 'F' where x.l_returnflag < y.l_returnflag) select a2 || '-' || a1 || '.O-F' as contrast, round(q - p, 6) as value from c""")
def interaction_effects(spark, d):
    means = ag.avg_dims(cube_a(spark, d), "l_linenumber", "l_suppkey").df
    return rounded(co.interaction_contrasts(means, "l_returnflag", "l_linestatus", FLAGS, STATUS))


_GROUPS = f"""with {A_SQL}, g as (select l_returnflag, l_linestatus, l_linenumber, avg(case when s_nationkey % 2 = 0 then value end) as m1, avg(case when s_nationkey % 2 = 1 then value end) as m2, var_samp(case when s_nationkey % 2 = 0 then value end) as v1, var_samp(case when s_nationkey % 2 = 1 then value end) as v2,
cast(count(case when s_nationkey % 2 = 0 then value end) as double) as n1, cast(count(case when s_nationkey % 2 = 1 then value end) as double) as n2 from a join supplier on l_suppkey = s_suppkey group by 1, 2, 3)"""


@query(_GROUPS + " select l_returnflag, l_linestatus, l_linenumber, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as stat, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 6) as df, round(abs(m1 - m2) / sqrt((v1 + v2) / 2), 6) as es from g")
def ttest_welch(spark, d):
    return rounded(tt.ttest_independent(with_groups(spark, d, cube_a(spark, d)), "grp", 0, 1, "l_suppkey", with_p=False), "stat", "df", "es")


@query(_GROUPS + ", p as (select *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) as s from g) select l_returnflag, l_linestatus, l_linenumber, round((m1 - m2) / sqrt(s * (1 / n1 + 1 / n2)), 6) as stat, n1 + n2 - 2 as df, round(abs(m1 - m2) / sqrt(s), 6) as es from p")
def ttest_pooled(spark, d):
    return rounded(tt.ttest_independent(with_groups(spark, d, cube_a(spark, d)), "grp", 0, 1, "l_suppkey", var_equal=True, with_p=False), "stat", "df", "es")


@query(f"with {A_SQL}, p as (select x.l_linestatus, x.l_linenumber, x.value - y.value as v from a x join a y using (l_linestatus, l_linenumber, l_suppkey) where x.l_returnflag = 'A' and y.l_returnflag = 'R') select l_linestatus, l_linenumber, round(avg(v) / stddev_samp(v) * sqrt(count(*)), 6) as stat, cast(count(*) - 1 as double) as df, round(abs(avg(v) / stddev_samp(v)), 6) as es from p group by 1, 2")
def ttest_paired(spark, d):
    a = cube_a(spark, d)
    first, second = (sh.subset(a, drop=True, l_returnflag=f) for f in ("A", "R"))
    return rounded(tt.ttest_paired(first, second, id_dim="l_suppkey", with_p=False), "stat", "df", "es")


@query(f"with {A_SQL} select l_returnflag, l_linestatus, l_linenumber, round((avg(value) - 25) / stddev_samp(value) * sqrt(count(*)), 6) as stat, cast(count(*) - 1 as double) as df, round(abs((avg(value) - 25) / stddev_samp(value)), 6) as es from a group by 1, 2, 3")
def ttest_one(spark, d):
    return rounded(tt.ttest_one(cube_a(spark, d), 25.0, "l_suppkey", with_p=False), "stat", "df", "es")


#: The incomplete beta function by its power series; the complement of what lies within t.
@query(_GROUPS + """, s as (select l_returnflag, l_linestatus, l_linenumber, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) as df, abs(m1 - m2) / sqrt((v1 + v2) / 2) as es from g),
y as (select *, greatest(t * t / (df + t * t), 1e-300) as y, df / (df + t * t) as x, df / 2 as b from s),
i as (select l_returnflag, l_linestatus, l_linenumber, t, df, es, exp(ln(y) / 2 + b * ln(x) + lgamma(0.5 + b) - lgamma(1.5) - lgamma(b)) * sum(exp(lgamma(0.5 + b + k.range) - lgamma(0.5 + b) - lgamma(1.5 + k.range) + lgamma(1.5) + k.range * ln(y))) as within from y, range(0, 3000) k group by l_returnflag, l_linestatus, l_linenumber, t, df, es, y, x, b)
select l_returnflag, l_linestatus, l_linenumber, round(t, 6) as stat, round(df, 6) as df, round(es, 6) as es, round(1 - within, 6) as p from i""")
def ttest_p_values(spark, d):
    return rounded(tt.ttest_independent(with_groups(spark, d, cube_a(spark, d)), "grp", 0, 1, "l_suppkey"), "stat", "df", "es", "p")


_SS = """m as (select avg(v) as g from y), f as (select flag, avg(v) as v from y group by 1), i as (select id, avg(v) as v from y group by 1),
s as (select count(*) as n from i), q as (select sum((f.v - g) * (f.v - g)) * any_value(n) as ssf from f, m, s), e as (select sum(power(y.v - f.v - i.v + g, 2)) as sse from y join f using (flag) join i using (id), m), b as (select 3 * sum(power(i.v - g, 2)) as ssi from i, m)"""


@query(f"""with {A_SQL}, y as (select l_returnflag as flag, l_suppkey as id, avg(value) as v from a group by all), {_SS}
select 'l_returnflag' as modelterm, round((ssf / 2) / (sse / (2 * (n - 1))), 6) as stat, 2.0::double as df1, cast(2 * (n - 1) as double) as df2, round(ssf / (ssf + sse + ssi), 6) as es, round(power(1 + 2 * (ssf / 2) / (sse / (2 * (n - 1))) / (2 * (n - 1)), -(n - 1)), 6) as p from q, e, b, s""")
def anova_within(spark, d):
    y = ag.avg_dims(cube_a(spark, d), "l_linestatus", "l_linenumber")
    return rounded(an.anova(y, None, within=["l_returnflag"], id_dim="l_suppkey"), "stat", "es", "p")


@query(f"""with {A_SQL}, y as (select s_nationkey % 3 as grp, l_suppkey as id, avg(value) as v from a join supplier on l_suppkey = s_suppkey group by all), m as (select avg(v) as g, count(*) as n from y), c as (select grp, avg(v) as v, count(*) as k from y group by 1),
b as (select sum(k * power(c.v - g, 2)) as ssb from c, m), w as (select sum(power(y.v - c.v, 2)) as ssw from y join c using (grp))
select 'grp' as modelterm, round((ssb / 2) / (ssw / (n - 3)), 6) as stat, 2.0::double as df1, cast(n - 3 as double) as df2, round(ssb / (ssb + ssw), 6) as es, round(power(1 + 2 * (ssb / 2) / (ssw / (n - 3)) / (n - 3), -(n - 3) / 2.0), 6) as p from b, w, m""")
def anova_between(spark, d):
    y = ag.avg_dims(cube_a(spark, d), "l_returnflag", "l_linestatus", "l_linenumber")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 3).alias("grp"))
    return rounded(an.anova(y, s, between=["grp"], id_dim="l_suppkey"), "stat", "es", "p")


@query(f"""with {A_SQL}, y as (select l_suppkey % 2 as grp, l_returnflag as flag, l_suppkey as id, avg(value) as v from a group by all), m as (select avg(v) as g from y), n as (select count(distinct id) as n from y),
i as (select id, any_value(grp) as grp, avg(v) as v from y group by 1), c as (select grp, avg(v) as v from y group by 1), f as (select flag, avg(v) as v from y group by 1), cf as (select grp, flag, avg(v) as v from y group by 1, 2),
t as (select (select 3 * any_value(n.n) / 2.0 * sum(power(c.v - g, 2)) from c, m, n) as ssg, (select 3 * sum(power(i.v - c.v, 2)) from i join c using (grp)) as sse1, (select any_value(n.n) * sum(power(f.v - g, 2)) from f, m, n) as ssf,
(select any_value(n.n) / 2.0 * sum(power(cf.v - c.v - f.v + g, 2)) from cf join c using (grp) join f using (flag), m, n) as ssi, (select sum(power(y.v - i.v - cf.v + c.v, 2)) from y join i using (id) join cf on y.grp = cf.grp and y.flag = cf.flag join c on c.grp = y.grp) as sse2, (select n.n from n) as n)
select 'grp' as modelterm, round(ssg / (sse1 / (n - 2)), 6) as stat, 1.0::double as df1, cast(n - 2 as double) as df2, round(ssg / (ssg + sse1 + sse2), 6) as es from t
union all select 'l_returnflag', round((ssf / 2) / (sse2 / (2 * (n - 2))), 6), 2, 2 * (n - 2), round(ssf / (ssf + sse1 + sse2), 6) from t union all select 'grp:l_returnflag', round((ssi / 2) / (sse2 / (2 * (n - 2))), 6), 2, 2 * (n - 2), round(ssi / (ssi + sse1 + sse2), 6) from t""")
def anova_mixed(spark, d):
    y = ag.avg_dims(cube_a(spark, d), "l_linestatus", "l_linenumber")
    s = y.df.select("l_suppkey").distinct().withColumn("grp", F.col("l_suppkey") % 2)
    return rounded(an.anova(y, s, ["grp"], ["l_returnflag"], "l_suppkey", with_p=False), "stat", "es")


@query(f"""with {A_SQL}, y as (select l_returnflag, l_suppkey, avg(v) as y, l_suppkey % 2 as a, case when l_suppkey % 3 = 0 then 1 else 0 end as b from (select l_returnflag, l_suppkey, avg(value) as v from a group by 1, 2) group by 1, 2),
m as (select *, avg(y) over (partition by l_returnflag) as g, avg(y) over (partition by l_returnflag, a) as ya, avg(b) over (partition by l_returnflag, a) as ba, avg(y) over (partition by l_returnflag, a, b) as yab from y),
s as (select l_returnflag, count(*) as n, sum((ya - g) * (ya - g)) as ssa, sum((y - ya) * (b - ba)) * sum((y - ya) * (b - ba)) / sum((b - ba) * (b - ba)) as ssb, sum((yab - g) * (yab - g)) as ssc, sum((y - yab) * (y - yab)) as sse from m group by 1),
t as (select l_returnflag, 'a' as modelterm, ssa as ss, sse, n from s union all select l_returnflag, 'b', ssb, sse, n from s union all select l_returnflag, 'a:b', ssc - ssa - ssb, sse, n from s)
select l_returnflag, modelterm, round(ss / (sse / (n - 4)), 6) as stat, 1.0::double as df1, (n - 4)::double as df2, round(ss / (ss + sse), 6) as es from t""")
def anova_unbalanced(spark, d):
    """Two factors between subjects in groups of unequal sizes: sums of squares in sequence."""
    y = ag.avg_dims(cube_a(spark, d), "l_linestatus", "l_linenumber")
    s = y.df.select("l_suppkey").distinct().select("l_suppkey", (F.col("l_suppkey") % 2).alias("a"), F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0).alias("b"))
    return rounded(an.anova(y, s, ["a", "b"], [], "l_suppkey", with_p=False), "stat", "es")


#: A fixed table of relabellings that both engines can make.
_PERMS = "w as (select p.range as perm, s_suppkey as id, case when (s_suppkey * 7 + p.range * 13 + (s_suppkey * s_suppkey + p.range) % 11) % 2 = 0 then 1 else 2 end as g from supplier, range(0, 11) p)"


def fixed_permutations(spark: SparkSession, d: str, id_name: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias(id_name)).crossJoin(F.broadcast(spark.range(11).select(F.col("id").alias("perm"))))
    i, p = F.col(id_name), F.col("perm")
    return s.withColumn("g", F.when((i * 7 + p * 13 + (i * i + p) % 11) % 2 == 0, 1).otherwise(2))


@query(f"""with {A_SQL}, {_PERMS}, m as (select l_returnflag, l_linenumber, l_suppkey as id, avg(value) as v from a group by all), t as (select perm, l_returnflag, l_linenumber, avg(case when g = 1 then v end) as m1, avg(case when g = 2 then v end) as m2, var_samp(case when g = 1 then v end) as v1, var_samp(case when g = 2 then v end) as v2,
count(case when g = 1 then v end) as n1, count(case when g = 2 then v end) as n2 from m join w using (id) group by 1, 2, 3) select perm, l_returnflag, round(max(abs((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)))), 6) as most from t group by 1, 2""")
def perm_fixed(spark, d):
    m = ag.avg_dims(cube_a(spark, d), "l_linestatus")
    return rounded(pm.group_maxima(m, fixed_permutations(spark, d, "l_suppkey"), "l_suppkey", ["l_returnflag"]), "most")


@query(f"""with {A_SQL}, {_PERMS}, m as (select l_returnflag, l_linenumber, l_suppkey as id, avg(value) as v from a group by all),
w2 as (select perm, id, g from w union all select -1, s_suppkey, s_nationkey % 2 + 1 from supplier),
t as (select perm, l_returnflag, l_linenumber, avg(case when g = 1 then v end) as m1, avg(case when g = 2 then v end) as m2, var_samp(case when g = 1 then v end) as v1, var_samp(case when g = 2 then v end) as v2,
count(case when g = 1 then v end) as n1, count(case when g = 2 then v end) as n2 from m join w2 using (id) group by 1, 2, 3),
s as (select perm, l_returnflag, l_linenumber, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) as stat from t),
x as (select perm, l_returnflag, max(abs(stat)) as most from s where perm >= 0 group by 1, 2)
select l_returnflag, l_linenumber, round(stat, 6) as stat, round((count(*) filter (where most > abs(stat)) + 1) / (count(*) + 1), 6) as p_corr from s join x using (l_returnflag) where s.perm = -1 group by l_returnflag, l_linenumber, stat""")
def perm_corrected(spark, d):
    m = ag.avg_dims(cube_a(spark, d), "l_linestatus")
    maxima = pm.group_maxima(m, fixed_permutations(spark, d, "l_suppkey"), "l_suppkey", ["l_returnflag"])
    grouped = m.but(m.df.join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 2).alias("grp")), "l_suppkey"))
    out = pm.corrected_p(tt.ttest_independent(grouped, "grp", 0, 1, "l_suppkey", var_equal=True), maxima, ["l_returnflag"])
    return rounded(out.select("l_returnflag", "l_linenumber", "stat", "p_corr"), "stat", "p_corr")


_TANOVA = f"""with {A_SQL}, {_PERMS}, e as (select perm, g, l_returnflag, l_linenumber, avg(value) as m from a join w on w.id = l_suppkey group by 1, 2, 3, 4),
r as (select perm, l_returnflag, l_linenumber, avg(m) as gm from e group by 1, 2, 3), s as (select perm, g, l_returnflag, stddev_samp(m - gm) as s from e join r using (perm, l_returnflag, l_linenumber) group by 1, 2, 3), x as (select perm, l_returnflag, avg(s) as effect from s group by 1, 2)"""


def fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    """Return flags as conditions, line numbers as channels, suppliers as ids; relabelling 0 stands for the observed one."""
    a = ag.avg_dims(cube_a(spark, d), "l_linestatus")
    a = a.but(a.df.join(fixed_permutations(spark, d, "l_suppkey"), "l_suppkey"))
    return pm.tanova_effect(a, "g", "l_linenumber", "l_suppkey", keys=["perm"])


@query(_TANOVA.replace("avg(value) as m from a join w", "avg(value) as m from (select l_returnflag, l_linenumber, l_suppkey, avg(value) as value from a group by all) a join w") + " select perm, l_returnflag, round(effect, 6) as effect from x")
def tanova_effect(spark, d):
    return rounded(fixed_effects(spark, d), "effect")


@query(_TANOVA.replace("avg(value) as m from a join w", "avg(value) as m from (select l_returnflag, l_linenumber, l_suppkey, avg(value) as value from a group by all) a join w") + """, o as (select l_returnflag, effect as obs from x where perm = 0)
select l_returnflag, round(obs, 6) as effect, round((count(*) filter (where effect > obs * (1 + 1e-9)) + 1) / (count(*) + 1), 6) as p, round((obs - avg(effect)) / stddev_samp(effect), 5) as z from x join o using (l_returnflag) where perm > 0 group by l_returnflag, obs""")
def tanova_p_fixed(spark, d):
    return rounded(rounded(pm.tanova_p(fixed_effects(spark, d), ["l_returnflag"]), "effect", "p"), "z", digits=5)


@query()
def tanova_duration(spark, d):
    b = cube_b10(spark, d)
    return pm.tanova(b, parities(spark), 49, ["grp"], alphas=[0.05, 0.1])


def parities(spark: SparkSession) -> DataFrame:
    """The ten ids of cube B10 in two groups."""
    return spark.range(10).select(F.col("id").cast("int").alias("id"), (F.col("id") % 2).alias("grp"))


def cube_b10(spark: SparkSession, d: str) -> DimFrame:
    """Cube B with ten ids, every combination present: 0 where there was none."""
    cols = {"chan": F.col("event_type"), "time": F.hour("ts").cast("int"), "id": (F.col("user_id") % 10).cast("int")}
    b = densified(cube_of(read(spark, d, "events"), cols, F.col("value"), {"chan": CHANS}))
    return b.but(b.df.fillna({"value": 0.0}))


NEIGHBOURS = {c: [x for x in (CHANS[max(0, k - 1)], c, CHANS[min(len(CHANS) - 1, k + 1)])] for k, c in enumerate(CHANS)}


#: Enhanced planes z (plane, chan, time, v) of planes y (plane, chan, time, x), clusters by the closure of "next to"; H is the power of thresholds.
_TFCE_SQL = """o as (select chan, row_number() over (order by chan) as c from (select distinct chan from y)), x as (select plane, c, time as t, x, max(abs(x)) over (partition by plane) / 50 as step from y join o using (chan)),
k as (select plane, sgn, s, step, step / 2 + s * step as thr, c, t, c * 100 + t as cell from x, (values (1), (-1)) as u(sgn), (select range as s from range(0, 50)) where step > 0 and sgn * x >= step / 2 + s * step),
r as (select plane, sgn, s, cell as a, cell as b from k union select r.plane, r.sgn, r.s, r.a, k.cell from r join k on k.plane = r.plane and k.sgn = r.sgn and k.s = r.s and abs(k.c - r.b // 100) <= 1 and abs(k.t - r.b % 100) <= 1),
n as (select plane, sgn, s, a as cell, count(*) as size from r group by all), g as (select plane, cell, sum(sgn * power(size, 0.66) * power(thr, H) * step) as v from n join k using (plane, sgn, s, cell) group by all),
z as (select x.plane, chan, t as time, coalesce(v, 0) as v from x join o using (c) left join g on g.plane = x.plane and g.cell = x.c * 100 + x.t)"""


@query(f"""with recursive e as (select event_type as chan, cast(hour(ts) as int) as time, cast(user_id % 10 as int) as id, avg(value) as value from events group by all),
b10 as (select c.chan, t.time, i.id, coalesce(e.value, 0) as value from (select distinct chan from e) c, (select distinct time from e) t, (select distinct id from e) i left join e on e.chan = c.chan and e.time = t.time and e.id = i.id),
y as (select id as plane, chan, time, value - 50 as x from b10), {_TFCE_SQL.replace("H)", "2.0)")} select chan, time, plane as id, round(v, 3) as value from z""")
def tfce(spark, d):
    b = cube_b10(spark, d)
    return rounded(cl.tfce_cube(b.but(b.df.withColumn("value", F.col("value") - 50)), NEIGHBOURS), digits=3)


@query()
def tfce_permutations(spark, d):
    return inf.ttest_tfce(cube_b10(spark, d), NEIGHBOURS, 49, {k: k % 2 for k in range(10)}, kind="pooled")


@query()
def anova_permuted(spark, d):
    y = ag.avg_dims(cube_a(spark, d), "l_linestatus")
    return rs.anova_permuted(y, None, within=["l_returnflag"], n=19, id_dim="l_suppkey")


_B10_SQL = """e as (select event_type as chan, cast(hour(ts) as int) as time, cast(user_id % 10 as int) as id, avg(value) as value from events group by all),
b10 as (select c.chan, t.time, i.id, coalesce(e.value, 0) as value from (select distinct chan from e) c, (select distinct time from e) t, (select distinct id from e) i left join e on e.chan = c.chan and e.time = t.time and e.id = i.id)"""


#: Relabellings of the ten ids by a rule that both engines know.
_LABELS10 = [[1 if (i * 7 + p * 13 + (i * i + p) % 11) % 2 == 0 else 2 for i in range(10)] for p in range(11)]
_LABELS10_SQL = "w as (select p.range as perm, i.range as id, case when (i.range * 7 + p.range * 13 + (i.range * i.range + p.range) % 11) % 2 = 0 then 1 else 2 end as g from range(0, 11) p, range(0, 10) i)"


@query(f"""with {_B10_SQL}, {_LABELS10_SQL}, t as (select perm, chan, time, avg(case when g = 1 then value end) as m1, avg(case when g = 2 then value end) as m2, var_samp(case when g = 1 then value end) as v1, var_samp(case when g = 2 then value end) as v2,
count(case when g = 1 then value end) as n1, count(case when g = 2 then value end) as n2 from b10 join w using (id) group by 1, 2, 3) select cast(perm as int) as perm, chan, time, round((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0), 6) as stat from t""")
def perm_welch(spark, d):
    return rounded(inf.permuted_t(cube_b10(spark, d), _LABELS10, list(range(10))).df, "stat")


@query(f"""with {_B10_SQL}, {_LABELS10_SQL}, v as (select perm, chan, time, (2 * g - 3) * (value - 50) as v from b10 join w using (id)) select cast(perm as int) as perm, chan, time, round(avg(v) / nullif(stddev_samp(v) / sqrt(count(*)), 0), 6) as stat from v group by 1, 2, 3""")
def perm_signs(spark, d):
    b = cube_b10(spark, d)
    signs = [[2 * g - 3 for g in row] for row in _LABELS10]
    return rounded(inf.permuted_t(b.but(b.df.withColumn("value", F.col("value") - 50)), signs, list(range(10)), "one").df, "stat")


@query(f"""with {_B10_SQL}, {_LABELS10_SQL.replace("range(0, 11)", "range(0, 22)")}, m as (select perm, g, time, chan, avg(value) as m from b10 join w using (id) group by all), gm as (select perm, time, chan, avg(m) as gm from m group by all),
s as (select perm, g, time, stddev_samp(m - gm) as s from m join gm using (perm, time, chan) group by all), x as (select perm, time, round(avg(s), 6) as effect from s group by all), o as (select time, effect as obs from x where perm = 0),
p as (select time, obs as effect, (count(*) filter (where x.effect > obs * (1 + 1e-9)) + 1) / (count(*) + 1) as p, (obs - avg(x.effect)) / stddev_samp(x.effect) as z from x join o using (time) where perm > 0 group by time, obs),
q as (select perm, time, (count(*) over (partition by time) - rank() over (partition by time order by effect) + 1) / count(*) over (partition by time) as p from x), a as (select unnest([0.5::double, 0.3::double]) as alpha),
h as (select alpha, perm, time, p < alpha as hit from q, a union all select alpha, -1, time, p < alpha from p, a), r as (select *, (hit is distinct from lag(hit) over (partition by alpha, perm order by time))::int as new from h),
k as (select *, sum(new) over (partition by alpha, perm order by time rows unbounded preceding) as run from r), l as (select *, count(*) over (partition by alpha, perm, run) as n from k),
c as (select alpha, quantile_cont(n, 0.5) as least from l where perm >= 0 and hit and alpha = 0.5 group by 1 union all select alpha, quantile_cont(n, 0.7) from l where perm >= 0 and hit and alpha = 0.3 group by 1), f as (select time, min(alpha) as p_corr from l join c using (alpha) where perm = -1 and hit and n >= least group by 1)
select time, round(effect, 6) as effect, round(p, 6) as p, round(z, 5) as z, coalesce(p_corr, 1) as p_corr from p left join f using (time)""")
def tanova_duration_fixed(spark, d):
    """Runs of significant times against those of 21 fixed relabellings."""
    b = cube_b10(spark, d)
    i, n = F.col("id").cast("long"), F.col("perm")
    labelled = b.df.crossJoin(F.broadcast(spark.range(22).select(F.col("id").alias("perm")))).withColumn("g", F.when((i * 7 + n * 13 + (i * i + n) % 11) % 2 == 0, 1).otherwise(2))
    effects = pm.tanova_effect(b.but(labelled), "g", "chan", keys=["perm"]).withColumn("effect", F.round("effect", 6))
    out = pm.duration_corrected(pm.tanova_p(effects, ["time"]), effects, ["time"], "time", [0.5, 0.3])
    return rounded(rounded(out, "effect", "p"), "z", digits=5)


@query(f"""with recursive {_B10_SQL}, {_LABELS10_SQL}, l as (select perm + 1 as perm, id, g from w union all select 0, range, range % 2 + 1 from range(0, 10)),
y as (select perm as plane, chan, time, (avg(case when g = 1 then value end) - avg(case when g = 2 then value end)) / sqrt(var_samp(case when g = 1 then value end) / count(case when g = 1 then 1 end) + var_samp(case when g = 2 then value end) / count(case when g = 2 then 1 end)) as x from b10 join l using (id) group by 1, 2, 3),
{_TFCE_SQL.replace("H)", "2.0)")}, most as (select plane, max(abs(v)) as most from z group by 1)
select chan, time, round(x, 6) as stat, round(v, 5) as tfce, round(((select count(*) from most where most.plane > 0 and most.most > abs(v)) + 1) / 12, 6) as p_corr from z join y using (plane, chan, time) where plane = 0""")
def ttest_tfce_fixed(spark, d):
    """A t test of two groups of ids with enhancement, corrected by eleven fixed relabellings."""
    out = inf.ttest_tfce(cube_b10(spark, d), NEIGHBOURS, 11, {k: k % 2 for k in range(10)}, relabellings=_LABELS10)
    return rounded(rounded(out, "stat", "p_corr"), "tfce", digits=5)


@query()
def ttest_tfce(spark, d):
    return inf.ttest_tfce(cube_b10(spark, d), NEIGHBOURS, 49, {k: k % 2 for k in range(10)})


@query()
def anova_tfce(spark, d):
    b = cube_b10(spark, d)
    parted = b.but(b.df.select("chan", "id", F.col("time") % 12, F.when(F.col("time") < 12, "am").otherwise("pm"), "value").toDF("chan", "id", "time", "half", "value"), [*b.dims, Dim("half", ("am", "pm"))])
    return inf.anova_tfce(parted, None, NEIGHBOURS, 19, within=["half"])


#: Cube M: lineitem as line number % 3 (part) x return flag x supplier, every combination present; ids in two groups.
_M_SQL = "m as (select l_linenumber % 3 as part, array_position(['A', 'N', 'R'], l_returnflag) - 1 as k, l_suppkey as i, avg(l_quantity) as v from lineitem group by all), n as (select count(distinct i) as n from m)"
#: Ten fixed shuffles q of (i, k): the observation that comes to each place.
_FACTORS = (1, 3, 7, 9, 11, 13, 17, 19, 21, 23)
_Q_SQL = "q as (select p, i, k, ((i // 2 + (i % 2) * (n // 2)) * f + p) % n as i2, (k * (1 + (i + p) % 2) + (i * i + p * i) // 2 + i // 3) % 3 as k2 from (values " + ", ".join(f"({p}, {f})" for p, f in enumerate(_FACTORS)) + ") as u(p, f), (select distinct i, k from m), n)"
_RESIDUALS_SQL = "r as (select part, i, k, v - avg(v) over (partition by part, i % 2, k) as v from m)"
_MOVED_SQL = "y as (select p, part, q.i, q.k, q.i % 2 as grp, r.v from q join r on r.i = q.i2 and r.k = q.k2)"
#: Observations stay while the design moves: the value of (i, k) stands at (i2, k2).
_STAYED_SQL = "y as (select p, part, q.i2 as i, q.k2 as k, q.i2 % 2 as grp, m.v from q join m using (i, k))"
_MEANS_SQL = "w as (select *, avg(v) over (partition by p, part) as g, avg(v) over (partition by p, part, i) as mi, avg(v) over (partition by p, part, grp) as mc, avg(v) over (partition by p, part, k) as mf, avg(v) over (partition by p, part, grp, k) as mcf from y)"
_F_SQL = """s as (select p, part, sum(power(mc - g, 2)) as ssg, sum(power(mi - mc, 2)) as sse1, sum(power(mf - g, 2)) as ssf, sum(power(mcf - mc - mf + g, 2)) as ssi, sum(power(v - mi - mcf + mc, 2)) as sse2, count(distinct i) as n from w group by 1, 2),
f as (select p, part, 'grp' as modelterm, ssg / (sse1 / (n - 2)) as stat from s union all select p, part, 'flag', ssf / (sse2 / (n - 2)) from s union all select p, part, 'grp:flag', ssi / (sse2 / (n - 2)) from s)"""


def cube_m(spark: SparkSession, d: str) -> DimFrame:
    cols = {"part": (F.col("l_linenumber") % 3).cast("int"), "flag": F.col("l_returnflag"), "id": F.col("l_suppkey")}
    return cube_of(read(spark, d, "lineitem"), cols, F.col("l_quantity"), {"flag": FLAGS})


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).alias("grp"), F.col("s_acctbal").cast("double").alias("bal"))


def fixed_shuffles(spark: SparkSession, design: pe.Design, what: str, between: list[str]) -> pe.Given:
    """The shuffles q, by the numbers of ids as in SQL: where a factor and the number of ids have a common divisor, some are drawn repeatedly and others never."""
    ids, n = np.array(design.ids, int), len(design.ids)
    i, k = np.repeat(ids, 3), np.tile(np.arange(3), n)
    new = [(((i // 2 + (i % 2) * (n // 2)) * f + p) % n, (k * (1 + (i + p) % 2) + (i * i + p * i) // 2 + i // 3) % 3) for p, f in enumerate(_FACTORS)]
    if what == "residuals":  # an id has nothing where there is no id of the number drawn
        return pe.Given(design, np.array([np.where(np.isin(i2, ids), np.searchsorted(ids, i2) * 3 + k2, -1) for i2, k2 in new]))
    numbers = spark.range(n).select("id", (F.col("id") % 2).alias("grp"), F.lit(FLAGS[0]).alias("flag"), F.lit(0.0).alias("value"))
    places = pe.design_of(from_long(numbers, {"id": None, "flag": FLAGS}), numbers, between, ["flag"])
    return pe.Given(design, np.array([i2 * 3 + k2 for i2, k2 in new]), places)


def _shuffled(spark: SparkSession, d: str, what: str) -> DataFrame:
    m = cube_m(spark, d)
    design = pe.design_of(m, suppliers(spark, d), ["grp"], ["flag"])
    return rounded(pe.each_shuffle(pe.permuted_f(m, design, fixed_shuffles(spark, design, what, ["grp"]), what), ["part", "modelterm"]), "stat")


@query(f"with {_M_SQL}, {_Q_SQL}, {_RESIDUALS_SQL}, {_MOVED_SQL}, {_MEANS_SQL}, {_F_SQL} select part::int as part, modelterm, p::int as perm, round(stat, 6) as stat from f")
def anova_residuals(spark, d):
    """F of a mixed design for fixed shuffles of what the model leaves of the responses."""
    return _shuffled(spark, d, "residuals")


@query(f"with {_M_SQL}, {_Q_SQL}, {_STAYED_SQL}, {_MEANS_SQL}, {_F_SQL} select part::int as part, modelterm, p::int as perm, round(stat, 6) as stat from f")
def anova_observations(spark, d):
    """F of a mixed design for fixed shuffles of the responses."""
    return _shuffled(spark, d, "observations")


@query(f"""with {_M_SQL}, {_Q_SQL}, {_RESIDUALS_SQL}, y as (select p, part, q.i, q.k, q.i % 2 as grp, r.v from q join r on r.i = q.i2 and r.k = q.k2 union all select -1, part, i, k, i % 2, v from m), {_MEANS_SQL}, {_F_SQL},
x as (select p, modelterm, max(stat) as most from f where p >= 0 group by 1, 2)
select part::int as part, modelterm, round(stat, 6) as stat, round((count(*) filter (where most > stat) + 1) / (count(*) + 1), 6) as p_corr from f join x using (modelterm) where f.p = -1 group by part, modelterm, stat""")
def anova_permuted_fixed(spark, d):
    """ANOVA of a mixed design, p corrected by the largest F of ten fixed shuffles."""
    m, s = cube_m(spark, d), suppliers(spark, d)
    out = rs.anova_permuted(m, s, ["grp"], ["flag"], shuffles=fixed_shuffles(spark, pe.design_of(m, s, ["grp"], ["flag"]), "residuals", ["grp"]))
    return rounded(out.select("part", "modelterm", "stat", "p_corr"), "stat", "p_corr")


#: Maps are over part; a term's effect is the mean of their standard deviations.
_MAPS_SQL = """select p, 'grp' as modelterm, avg(s) as effect from (select p, grp, stddev_samp(x) as s from (select distinct p, grp, part, mc - g as x from w) group by 1, 2) group by 1
union all select p, 'flag', avg(s) from (select p, k, stddev_samp(x) as s from (select distinct p, k, part, mf - g as x from w) group by 1, 2) group by 1
union all select p, 'grp:flag', avg(s) from (select p, grp, k, stddev_samp(x) as s from (select distinct p, grp, k, part, mcf - mc - mf + g as x from w) group by 1, 2, 3) group by 1"""


def _maps(spark: SparkSession, d: str, between: list[str], what: str) -> DimFrame:
    m = cube_m(spark, d)
    design = pe.design_of(m, suppliers(spark, d) if between else None, between, ["flag"])
    return pe.permuted_maps(m, design, fixed_shuffles(spark, design, what, between), what, chan="part")


@query(f"""with {_M_SQL}, {_Q_SQL}, {_RESIDUALS_SQL}, y as (select p + 1 as p, part, q.i, q.k, q.i % 2 as grp, r.v from q join r on r.i = q.i2 and r.k = q.k2 union all select 0, part, i, k, i % 2, v from m), {_MEANS_SQL}, e as ({_MAPS_SQL}) select modelterm, p::int as perm, round(effect, 6) as effect from e""")
def tanova_mixed(spark, d):
    """Effects on maps of a factor between ids, one within and their interaction, observed and for fixed shuffles of residuals."""
    return rounded(_maps(spark, d, ["grp"], "residuals").df, "effect")


@query(f"""with {_M_SQL}, {_Q_SQL}, y as (select p + 1 as p, part, q.i2 as i, q.k2 as k, q.i2 % 2 as grp, m.v from q join m using (i, k) union all select 0, part, i, k, i % 2, v from m), {_MEANS_SQL}, e as ({_MAPS_SQL}), o as (select effect as obs from e where p = 0 and modelterm = 'flag')
select modelterm, round(obs, 6) as effect, round((count(*) filter (where effect > obs * (1 + 1e-9)) + 1) / (count(*) + 1), 6) as p, round((obs - avg(effect)) / stddev_samp(effect), 4) as z from e, o where p > 0 and modelterm = 'flag' group by modelterm, obs""")
def tanova_within(spark, d):
    """Topographic ANOVA of a factor within ids: p and z by fixed shuffles of the responses."""
    out = pm.tanova_p(_maps(spark, d, [], "observations").df, ["modelterm"])
    return rounded(rounded(out, "effect", "p"), "z", digits=4)


@query(f"""with {_M_SQL}, y as (select part, i, i % 2 as a, avg(v) as y, any_value(s_acctbal)::double as x from m join supplier on s_suppkey = i group by 1, 2, 3),
w as (select *, avg(y) over (partition by part) as g, avg(y) over (partition by part, a) as ya, avg(x) over (partition by part, a) as xa from y),
h as (select part, a, sum((y - ya) * (x - xa)) as sxy, sum((x - xa) * (x - xa)) as sxx, sum((y - ya) * (y - ya)) as syy, sum((ya - g) * (ya - g)) as ssa, count(*) as n from w group by 1, 2),
s as (select part, sum(ssa) as ssa, sum(sxy) * sum(sxy) / sum(sxx) as ssx, sum(sxy * sxy / sxx) as slopes, sum(syy) as syy, sum(n) as n from h group by 1),
t as (select part, 'grp' as modelterm, ssa as ss, syy - slopes as sse, n from s union all select part, 'bal', ssx, syy - slopes, n from s union all select part, 'grp:bal', slopes - ssx, syy - slopes, n from s)
select part::int as part, modelterm, round(ss / (sse / (n - 4)), 5) as stat, 1.0::double as df1, (n - 4)::double as df2, round(ss / (ss + sse), 6) as es from t""")
def ancova(spark, d):
    """A factor, a number and their interaction between subjects: sums of squares in sequence."""
    y = ag.avg_dims(cube_m(spark, d), "flag")
    return rounded(rounded(an.anova(y, suppliers(spark, d), ["grp"], covariates=["bal"], with_p=False), "stat", digits=5), "es")


@query(f"""with {_B10_SQL}, m as (select time, id, time % 2 as part, avg(value) as v from b10 group by 1, 2, 3), w as (select *, avg(v) over (partition by id, part order by time rows between 1 preceding and 1 following) as am from m),
k as (select id, part, cast(arg_max(time, v) as double) as peak, arg_max(am, v) as amplitude from w where time between 2 and 20 group by 1, 2),
l as (select id, part, 'peak' as measure, peak as x from k union all select id, part, 'amplitude', amplitude from k),
d as (select measure, id, max(case when part = 1 then x end) - max(case when part = 0 then x end) as d, avg(x) as a from l group by 1, 2)
select measure, 'part' as modelterm, round(count(*) * avg(d) * avg(d) / var_samp(d), 6) as stat, 1.0::double as df1, (count(*) - 1)::double as df2,
round(count(*) * avg(d) * avg(d) / 2 / (count(*) * avg(d) * avg(d) / 2 + (count(*) - 1) * var_samp(d) / 2 + 2 * (count(*) - 1) * var_samp(a)), 6) as es from d group by measure""")
def peak_anova(spark, d):
    b = cube_b10(spark, d)
    out = rs.peak_anova(ag.avg_dims(b.but(b.df.withColumn("part", F.pmod("time", F.lit(2))), [*b.dims, Dim("part")]), "chan"), None, 2, 20, within=["part"])
    return rounded(out.drop("p"), "stat", "es")


@query(f"with {B_SQL}, p as (select chan, time, id, value / 200 as p from b), c as (select *, case when p <= 0.3 then 1 else 0 end + case when p <= 0.2 then 1 else 0 end as code from p) select chan, time, id, cast(greatest(code, coalesce(lead(code) over (partition by chan, id order by time), 0)) as int) as code from c where time between 3 and 20")
def p_codes(spark, d):
    b = cube_b(spark, d)
    r = rs.extract(b.df.select("chan", "time", "id", (F.col("value") / 200).alias("p"), F.lit(1.0).alias("stat")), ["p"], window=(3, 20))
    return rs.p_codes(r, "p", [0.3, 0.2], ["chan", "id"], shift=True).drop("p")


# ---- geometry

_POS = "p as (select c_custkey as k, (c_custkey * 37 % 1790) / 10.0 as theta, (c_custkey * 91 % 3600) / 10.0 - 180 as phi from customer)"


def positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("k"), ((k * 37 % 1790) / 10.0).alias("theta"), ((k * 91 % 3600) / 10.0 - 180).alias("phi"))


@query(f"with {_POS} select k, round(sin(radians(theta)) * cos(radians(phi)), 6) + 0.0 as x, round(sin(radians(theta)) * sin(radians(phi)), 6) + 0.0 as y, round(cos(radians(theta)), 6) + 0.0 as z from p")
def coords_cartesian(spark, d):
    out = positions(spark, d).select("k", *[c.alias(n) for n, c in geo.sph2cart(F.col("theta"), F.col("phi")).items()])
    return out.select("k", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z")])


@query(f"with {_POS} select k, round(theta, 4) as theta, case when theta > 0 then round(cos(radians(phi)), 6) + 0.0 end as cos_phi from p")
def coords_round_trip(spark, d):
    xyz = geo.sph2cart(F.col("theta"), F.col("phi"), 2.0)
    back = positions(spark, d).select("k", "theta", *[c.alias(n) for n, c in xyz.items()])
    sph = geo.cart2sph(F.col("x"), F.col("y"), F.col("z"))
    # the pole has every longitude
    return back.select("k", F.round(sph["theta"], 4).alias("theta"), F.when(F.col("theta") > 0, F.round(F.cos(F.radians(sph["phi"])), 6) + 0.0).alias("cos_phi"))


@query(f"with {_POS} select k, round(phi, 6) as long, round(90 - theta, 6) as lat from p")
def coords_geographic(spark, d):
    g = geo.sph2geo(F.col("theta"), F.col("phi"))
    return positions(spark, d).select("k", *[F.round(c, 6).alias(n) for n, c in g.items()])


@query(f"with {_POS}, g as (select k, radians(phi - 270) as a, radians(90 - theta) as b from p) select k, round(sqrt(2 / (1 + sin(b))) * cos(b) * sin(a), 6) + 0.0 as px, round(-sqrt(2 / (1 + sin(b))) * cos(b) * cos(a), 6) + 0.0 as py from g")
def laea(spark, d):
    p = positions(spark, d)
    out = p.select("k", *[c.alias(n) for n, c in geo.laea(F.col("phi"), 90 - F.col("theta")).items()])
    return out.select("k", *[(F.round(c, 6) + 0.0).alias(c) for c in ("px", "py")])


@query("select a.vec_id, b.vec_id as other, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine from embeddings a, embeddings b where b.vec_id < 5")
def cos_angle(spark, d):
    e = read(spark, d, "embeddings")
    return rounded(geo.cos_angles(e, e.where("vec_id < 5"), "vec_id", "embedding"), "cosine")


ELECTRODES = {c: tuple(float(v) for v in xyz) for c, xyz in zip(CHANS, ((0, 0, 1), (0.8, 0, 0.6), (-0.8, 0, 0.6), (0, 0.8, 0.6), (0, -0.8, 0.6)), strict=True)}
_ELECTRODES = "e as (select * from (values ('click', 0, 0, 1), ('error', 0.8, 0, 0.6), ('purchase', -0.8, 0, 0.6), ('signup', 0, 0.8, 0.6), ('view', 0, -0.8, 0.6)) t(chan, x, y, z))"


@query(f"with {B_SQL}, {_ELECTRODES} select time, id, case when value - 50 < 0 then 'negative' else 'positive' end as side, round(avg(cast(x as double)), 6) as x, round(avg(cast(y as double)), 6) as y, round(avg(cast(z as double)), 6) as z from b join e using (chan) group by 1, 2, 3")
def centroid(spark, d):
    b = cube_b(spark, d)
    at = spark.createDataFrame([(k, *v) for k, v in ELECTRODES.items()], "chan string, x double, y double, z double")
    return rounded(ag.centroid(b.but(b.df.withColumn("value", F.col("value") - 50)), at), "x", "y", "z")


#: The weights at "view" of the spline through the other four electrodes, the bordered system solved in fractions.
_SPLINE_WEIGHTS = "('click', 0.1491670644945434::double), ('error', 0.8837261460994089::double), ('purchase', 0.8837261460994089::double), ('signup', -0.916619356693267::double)"


@query(f"""with {_B10_SQL}, s as (select time, id, sum(value * w) as v from b10 join (values {_SPLINE_WEIGHTS}) u(chan, w) using (chan) group by 1, 2)
select chan, time, id, round(case when chan = 'view' and time % 3 = 0 then v else value end, 6) as value from b10 join s using (time, id)""")
def spline_interp(spark, d):
    b = cube_b10(spark, d)
    lost = b.df.withColumn("value", F.when((F.col("chan") == "view") & (F.col("time") % 3 == 0), None).otherwise(F.col("value")))
    return rounded(geo.interpolated(b.but(lost), ELECTRODES))


@query(f"""with {B_SQL}, g as (select distinct time, power(time / 23.0, 1.3) as gamma from b), s as (select chan, id, min(time) as t0, max(time) as t1 from b group by 1, 2), x as (select s.chan, s.id, g.time, (t1 - t0) * gamma + t0 as pos from s, g),
y as (select x.*, floor(pos) as lo from x) select y.chan, y.id, y.time, round(a.value + (pos - lo) * coalesce(c.value - a.value, 0), 6) as value from y join b a on a.chan = y.chan and a.id = y.id and a.time = y.lo left join b c on c.chan = y.chan and c.id = y.id and c.time = y.lo + 1""")
def align(spark, d):
    b = cube_b(spark, d)
    gammas = spark.range(24).select(F.col("id").cast("int").alias("time"), F.pow(F.col("id") / 23.0, F.lit(1.3)).alias("gamma"))
    return rounded(al.aligned(b, gammas))


@query()
def warp(spark, d):
    return al.warped(ag.avg_dims(cube_b10(spark, d), "chan"), "id").long()


@query(f"with {B_SQL} select chan, 3 * (time // 3) as start, round(avg(v), 6) as value, count(v) as n from (select event_type as chan, hour(ts) as time, value as v from events) group by 1, 2")
def stream_bins(spark, d):
    from ..streaming.segments import binned

    e = read(spark, d, "events").select("event_type", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.hour("ts"), F.minute("ts"), F.lit(0)).alias("ts"), "value")
    out = binned(e, "event_type", "ts", "value", "3 hours")
    return rounded(out.select("chan", F.hour("bin_start").cast("long").alias("start"), "value", "n"))


def long_embeddings(spark: SparkSession, d: str) -> DimFrame:
    """Cube E."""
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "value"))
    return from_long(rows.withColumn("value", F.col("value").cast("double")), ["vec_id", "idx"])


@query("select vec_id, round(stddev_samp(cast(v as double)), 6) as value from (select vec_id, unnest(embedding) as v from embeddings) group by 1")
def embedding_gfp(spark, d):
    return rounded(ag.gfp(long_embeddings(spark, d), "idx"))
