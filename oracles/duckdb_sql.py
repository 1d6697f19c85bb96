"""DuckDB SQL that computes every registered query by a different route.

The mart is found pair by pair with ordered lookups into the log, sessions are
attached to pairs with windows, and quantiles come from the engine.
"""

from __future__ import annotations

LOG = """
ev as (
  select event_id,
    date_trunc('hour', ts) as event_time,
    case event_type when 'click' then 'cart' when 'purchase' then 'purchase' else 'view' end
      as event_type,
    case when k <> 99 then k % 40 end as product_id,
    k as category_id,
    case when k % 7 <> 0 then 'cat.' || (k % 12)::varchar end as category_code,
    case when k % 6 <> 0 then 'brand_' || (k % 20)::varchar end as brand,
    case k when 13 then 0.0::double when 14 then null when 15 then -value else value end as price,
    user_id,
    case when event_id % 101 = 0 then null
         else user_id::varchar || case user_id % 3
           when 0 then '-m'
           when 1 then '-w' || (day(ts) // 7)::varchar
           else '-d' || day(ts)::varchar end
    end as user_session,
    day(ts) // 7 as period
  from (select *, json_extract_string(props, '$.k')::bigint as k from events)
)"""

# The first view of a pair is the first row of its views in time order.
PAIRS = (
    LOG
    + """,
numbered as (
  select *, row_number() over (partition by user_session, product_id
                               order by event_time, event_id) as nth
  from ev where event_type = 'view' and user_session is not null
),
p1 as (
  select user_session, product_id, event_time as first_view,
    price as view_price, category_code, brand
  from numbered where nth = 1
),
p2 as (
  select p1.*, (select min(e.event_time) from ev e
    where e.event_type = 'cart' and e.event_time >= p1.first_view
      and e.user_session = p1.user_session and e.product_id = p1.product_id) as first_valid_cart
  from p1
),
p3 as (
  select p2.*, (select min(e.event_time) from ev e
    where e.event_type = 'purchase' and e.event_time >= p2.first_valid_cart
      and e.user_session = p2.user_session and e.product_id = p2.product_id)
      as first_valid_purchase
  from p2
),
mart as (
  select *, (first_valid_cart is not null)::int as cart_flag,
    (first_valid_purchase is not null)::int as purchase_flag,
    count(*) over (partition by user_session) as depth
  from p3
)"""
)

# A band covers prices above its lowest and up to its highest value.
BANDED = (
    PAIRS
    + """,
price_bounds(lowest, highest, label) as (
  values (-1e300, 58.95, 'Q1_low'), (58.95, 153.47, 'Q2'), (153.47, 334.13, 'Q3')
),
depth_bounds(lowest, highest, label) as (
  values (1, 1, '1'), (2, 3, '2-3'), (4, 6, '4-6'), (7, 20, '7-20'), (21, 9e18::bigint, '21+')
),
banded as (
  select mart.*, d.label as session_group,
    case when view_price = 0 then '0_price' else coalesce(p.label, 'Q4_high') end as price_group
  from mart
  join depth_bounds d on depth between d.lowest and d.highest
  left join price_bounds p on view_price > p.lowest and view_price <= p.highest
),
sess as (
  select user_session, session_group, count(*)::double as pairs, sum(cart_flag) as carts,
    sum(purchase_flag) as purchases
  from banded group by all
)"""
)


def _rate(part: str, whole: str) -> str:
    return f"round({part} * 100.0::double / nullif({whole}, 0), 6)"


COUNTS = (
    "count(*) as view_count, sum(cart_flag)::bigint as cart_count, "
    "sum(purchase_flag)::bigint as purchase_count"
)
RATES = ", ".join(
    f"{_rate(f'sum({part})', whole)} as {name}"
    for part, whole, name in (
        ("cart_flag", "count(*)", "view_to_cart_rate"),
        ("purchase_flag", "sum(cart_flag)", "cart_to_purchase_rate"),
        ("purchase_flag", "count(*)", "view_to_purchase_rate"),
    )
)
SUMMARY = f"{COUNTS}, {RATES}"
TOP = """select category_code from mart where category_code is not null
  group by 1 order by count(*) desc, 1 limit """
DEEP = f"base as (select {SUMMARY} from mart where depth >= 2)"
CROSSTAB = """crosstab as (
  select session_group, count(*) filter (cart_flag = 1) as cart_yes,
    count(*) filter (cart_flag = 0) as cart_no
  from banded group by 1
)"""
SIZE = """ceil(pow(1.96 * sqrt((p1 + p2) * (1 - (p1 + p2) / 2))
  + 0.84 * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / nullif(pow(p2 - p1, 2), 0))::bigint"""
UPLIFT = "unnest([5, 10, 15]) as uplift_pct"


def _log(select: str) -> str:
    return f"with {LOG} {select}"


def _pairs(select: str) -> str:
    return f"with {PAIRS} {select}"


def _banded(select: str) -> str:
    return f"with {BANDED} {select}"


def _first_view(column: str) -> str:
    return _pairs(f"select user_session, product_id, {column} from p1")


def _category_prices(category: str) -> str:
    return _banded(
        f"select price_group, count(*) as view_count, {RATES} from banded "
        f"where category_code = '{category}' and product_id is not null group by 1"
    )


def _top_values(column: str) -> str:
    return _pairs(
        f"select {column}, {SUMMARY} from mart "
        f"where {column} is not null and product_id is not null "
        f"group by 1 order by view_count desc, 1 limit 15"
    )


SESSION_PRODUCTS = """per_session as (
  select user_session, count(distinct product_id) as n from ev
  where user_session is not null group by 1
)"""
MART_COLUMNS = (
    "user_session, product_id, first_view, first_valid_cart, first_valid_purchase, "
    "cart_flag, purchase_flag"
)


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_row_count": "select count(*) as total_rows from events",
        "log_profile": _log(
            "select period, count(*) as total_events, count(distinct user_id) as users, "
            "count(distinct user_session) as sessions, min(event_time) as min_time, "
            "max(event_time) as max_time from ev group by 1"
        ),
        "event_type_share": _log(
            "select a.period, event_type, event_count, "
            "round(event_count * 100.0::double / rows_in_period, 2) as event_pct "
            "from (select period, event_type, count(*) as event_count from ev group by 1, 2) a "
            "join (select period, count(*) as rows_in_period from ev group by 1) b "
            "on a.period = b.period"
        ),
        "event_type_counts": _log("select event_type, count(*) as event_count from ev group by 1"),
        "column_quality": _log(
            "select count(distinct product_id) as products, "
            "count(*) filter (user_id is null) as null_user_id, "
            "count(*) filter (user_session is null) as null_session, "
            "count(*) filter (category_code is null) as null_category_code, "
            "count(*) filter (brand is null) as null_brand, "
            "count(*) filter (price is null) as null_price, "
            "count(*) filter (price <= 0) as non_positive_price, "
            "round(min(price), 6) as min_price, round(max(price), 6) as max_price, "
            "round(avg(price), 2) as avg_price from ev"
        ),
        "null_price_profile": _log(
            "select count(*) as total_rows, "
            "count(*) filter (category_code is null) as null_category, "
            "round(avg((category_code is null)::int * 100.0::double), 2) as null_category_pct, "
            "count(*) filter (brand is null) as null_brand, "
            "round(avg((brand is null)::int * 100.0::double), 2) as null_brand_pct, "
            "count(*) filter (price is null) as null_price, "
            "count(*) filter (price = 0) as zero_price, "
            "count(*) filter (price < 0) as negative_price from ev"
        ),
        "quality_long": _log(
            "select unnest(["
            "{'item': 'category_code 결측', 'count': count(*) filter (category_code is null)}, "
            "{'item': 'brand 결측', 'count': count(*) filter (brand is null)}, "
            "{'item': 'price 결측', 'count': count(*) filter (price is null)}, "
            "{'item': 'price = 0', 'count': count(*) filter (price = 0)}, "
            "{'item': 'price < 0', 'count': count(*) filter (price < 0)}], recursive := true) from ev"
        ),
        "null_session_by_type": _log(
            "select event_type, count(*) as count from ev where user_session is null group by 1"
        ),
        "session_breadth": _log(
            f", {SESSION_PRODUCTS} select count(*) as total_sessions, "
            "round(avg(n), 2) as avg_products_per_session, "
            "median(n)::double as median_products_per_session, "
            "max(n) as max_products_per_session, "
            "count(*) filter (n = 1) as single_product_sessions, "
            "count(*) filter (n > 1) as multi_product_sessions, "
            "round(count(*) filter (n > 1) * 100.0::double / nullif(count(*), 0), 2) as multi_product_pct "
            "from per_session"
        ),
        "session_breadth_summary": _log(
            f", {SESSION_PRODUCTS} select round(avg(n), 2) as avg_products, "
            "median(n)::double as median_products, max(n) as max_products from per_session"
        ),
        "stage_order_check": _log(
            ", firsts as (from (select user_session, product_id, event_type, event_time from ev "
            "where user_session is not null) "
            "pivot (min(event_time) for event_type in ('view', 'cart', 'purchase') "
            "group by user_session, product_id)) "
            "select count(*) filter (\"view\" <= cart) as view_to_cart_ordered, "
            "count(*) filter (\"view\" > cart) as view_cart_reversed, "
            "count(*) filter (cart <= purchase) as cart_to_purchase_ordered, "
            "count(*) filter (cart > purchase) as cart_purchase_reversed "
            "from firsts"
        ),
        "price_change_products": _log(
            "select count(*) as total_products, "
            "sum((n > 1)::int)::bigint as changed_price_products, "
            f"{_rate('sum((n > 1)::int)', 'count(*)')} as changed_price_pct "
            "from (select product_id, count(distinct price) as n from ev "
            "where event_type = 'view' group by 1)"
        ),
        "funnel_counts": _pairs(
            f"select count(*) as view_count, count(first_valid_cart) as cart_count, "
            f"count(first_valid_purchase) as purchase_count, {RATES} from mart"
        ),
        "funnel_view": _pairs("select user_session, product_id, first_view from p1"),
        "funnel_cart": _pairs(
            "select user_session, product_id, first_view, first_valid_cart from p2"
        ),
        "funnel_purchase": _pairs(
            "select user_session, product_id, first_view, first_valid_cart, first_valid_purchase "
            "from p3"
        ),
        "funnel_mart": _pairs(f"select {MART_COLUMNS} from mart"),
        "funnel_mart_by_weeks": _pairs(
            f"select {MART_COLUMNS}, round(view_price, 6) as view_price, category_code, brand from mart"
        ),
        "stage_row_checks": _pairs(
            "select 'view' as stage, count(*) as total, null::bigint as cart_count, "
            "null::bigint as purchase_count from p1 "
            "union all select 'cart', count(*), count(first_valid_cart), null from p2 "
            "union all select 'purchase', count(*), count(first_valid_cart), "
            "count(first_valid_purchase) from p3 "
            "union all select 'mart', count(*), sum(cart_flag)::bigint, "
            "sum(purchase_flag)::bigint from mart"
        ),
        "mart_sample": _pairs(
            f"select {MART_COLUMNS} from mart "
            "order by user_session, product_id nulls first limit 5"
        ),
        "first_view_event_attrs": _pairs(
            "select m.user_session, m.product_id, m.first_view, round(e.price, 6) as price, "
            "e.category_id, e.category_code, e.brand from mart m join ev e "
            "on e.event_type = 'view' and e.event_time = m.first_view "
            "and e.user_session = m.user_session and e.product_id = m.product_id "
            "order by m.user_session, m.product_id, m.first_view, e.price nulls first, "
            "e.category_id nulls first, e.category_code nulls first, e.brand nulls first limit 5"
        ),
        "funnel_totals": _pairs(
            f"select {SUMMARY}, "
            f"round(100 - {_rate('sum(cart_flag)', 'count(*)')}, 6) as view_to_cart_drop, "
            f"round(100 - {_rate('sum(purchase_flag)', 'sum(cart_flag)')}, 6) "
            "as cart_to_purchase_drop, "
            "(count(*) - sum(cart_flag))::bigint as view_no_cart, "
            "(sum(cart_flag) - sum(purchase_flag))::bigint as cart_no_purchase from mart"
        ),
        "first_view_price": _first_view("first_view, round(view_price, 6) as view_price"),
        "first_view_category": _first_view("category_code"),
        "first_view_brand": _first_view("brand"),
        "first_view_coverage": _pairs(
            "select count(*) as total, 'price' as attribute, count(view_price) as available, "
            "count(*) filter (view_price is null) as missing from p1 "
            "union all select count(*), 'category', count(category_code), "
            "count(*) filter (category_code is null) from p1 "
            "union all select count(*), 'brand', count(brand), count(*) filter (brand is null) from p1"
        ),
        "segment_cube": _banded(
            "select price_group, category_code, brand, session_group, product_id is not null as known_product, "
            f"coalesce(view_price > 0, false) as above_zero, {COUNTS}, count(view_price) as known_price, "
            "round(min(view_price), 6) as lowest from banded group by all"
        ),
        "price_distribution": _pairs(
            "select round(min(view_price), 6) as min_price, "
            + ", ".join(
                f"round(quantile_cont(view_price, {q}), 6) as {name}"
                for name, q in (
                    ("q1", 0.25),
                    ("median", 0.5),
                    ("q3", 0.75),
                    ("p90", 0.9),
                    ("p99", 0.99),
                )
            )
            + ", round(max(view_price), 6) as max_price, round(avg(view_price), 6) as avg_price "
            "from p1"
        ),
        "price_band_counts": _banded(
            "select price_group, count(*) as view_count from banded group by 1"
        ),
        "price_band_conversion": _banded(
            f"select price_group, {SUMMARY} from banded where product_id is not null group by 1"
        ),
        "top_category_conversion": _top_values("category_code"),
        "top_brand_conversion": _top_values("brand"),
        "category_price_mix": _banded(
            "select category_code, price_group, count(*) as view_count from banded "
            f"where product_id is not null and category_code in ({TOP} 10) group by 1, 2"
        ),
        "category_price_conversion_a": _category_prices("cat.3"),
        "category_price_conversion_b": _category_prices("cat.7"),
        "top_category_price_conversion": _banded(
            "select category_code, price_group, count(*) as view_count, "
            f"{_rate('sum(cart_flag)', 'count(*)')} as view_to_cart_rate from banded "
            f"where product_id is not null and view_price > 0 and category_code in ({TOP} 5) "
            "group by 1, 2"
        ),
        "session_depth_distribution": _banded(
            "select count(*) as sessions, round(avg(pairs), 6) as avg_products, "
            + ", ".join(
                f"round(quantile_cont(pairs, {q}), 6) as {name}"
                for name, q in (
                    ("median_products", 0.5),
                    ("p75", 0.75),
                    ("p90", 0.9),
                    ("p95", 0.95),
                    ("p99", 0.99),
                )
            )
            + ", max(pairs)::bigint as max_products from sess"
        ),
        "depth_band_conversion": _banded(
            "select session_group, count(distinct user_session) as session_count, "
            f"count(*) as view_count, {RATES} from banded group by 1"
        ),
        "category_depth_conversion": _banded(
            f"select session_group, count(*) as view_count, {RATES} from banded "
            "where category_code = 'cat.3' and product_id is not null group by 1"
        ),
        "depth_cart_crosstab": _banded(f", {CROSSTAB} from crosstab"),
        "session_depth_any_cart": _banded(
            "select session_group, count(*) filter (carts > 0) as cart_yes, "
            "count(*) filter (carts = 0) as cart_no, "
            f"{_rate('count(*) filter (carts > 0)', 'count(*)')} as cart_rate "
            "from sess group by 1"
        ),
        "depth_cart_rate": _banded(
            "select session_group, count(*) as session_count, "
            "round(avg(carts / pairs) * 100, 6) as avg_cart_rate, "
            "round(median(carts / pairs) * 100, 6) as median_cart_rate from sess group by 1"
        ),
        "depth_purchase_rate": _banded(
            "select session_group, count(*) as session_count, "
            "round(avg(purchases / pairs) * 100, 6) as avg_purchase_rate from sess group by 1"
        ),
        "multi_view_baseline": _pairs(f", {DEEP} from base"),
        "chi_square_cramers_v": _banded(
            f""", {CROSSTAB},
            cells as (
              select session_group, o, sum(o) over (partition by session_group) as r,
                sum(o) over (partition by has_cart) as c, sum(o) over () as n
              from (unpivot crosstab on cart_yes, cart_no into name has_cart value o)
            ),
            test as (
              select count(distinct session_group) - 1 as dof, max(n) as n,
                case when min(c) > 0 and dof > 0
                  then sum(pow(o - r * c / n::double, 2) / (r * c / n::double)) end as x
              from cells
            )
            select round(x, 6) as chi2, dof,
              cast(printf('%.5e', case dof when 2 then exp(-x / 2)
                when 4 then exp(-x / 2) * (1 + x / 2) end) as double) as p_value,
              round(sqrt(x / n), 6) as cramers_v
            from test"""
        ),
        "uplift_targets": _pairs(
            f", {DEEP} select uplift_pct, view_to_cart_rate as baseline_cart, "
            "round(cart / 100.0::double * (100 + uplift_pct), 6) as cart_target, "
            "view_to_purchase_rate as baseline_purchase, "
            "round(purchase / 100.0::double * (100 + uplift_pct), 6) as purchase_target "
            "from (select *, cart_count * 100.0::double / view_count as cart, "
            f"purchase_count * 100.0::double / view_count as purchase, {UPLIFT} from base)"
        ),
        "sample_size_fixed": _pairs(
            f", {DEEP}, step as (select round(cart_count / view_count::double, 4) as p1 from base), "
            "plan as (select p1, round(p1 * 1.1::double, 4) as p2 from step) "
            f"select p1, p2, {SIZE} as n_per_group, {SIZE} * 2 as total_n from plan"
        ),
        "sample_size_by_uplift": _pairs(
            f", {DEEP}, step as (select {UPLIFT}, cart_count / view_count::double as p1 from base), "
            "plan as (select uplift_pct, p1, p1 * (1 + uplift_pct / 100.0::double) as p2 from step) "
            "select uplift_pct, round(p1, 6) as p1, round(p2, 6) as p2, "
            f"{SIZE} as n_per_group, {SIZE} * 2 as total_n from plan"
        ),
    }
